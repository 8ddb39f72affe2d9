"""DuckDB oracle SQL for every registered query with a SQL equivalent.

Strings are assembled from shared CTE fragments so each oracle repeats the
same retail view and cleaning rules as the Spark side.
"""

from __future__ import annotations

from tillroll.operators import report as rp
from tillroll.operators.evaluate import STATUS_FEW

# Retail view over lineitem, orders, part (see tillroll.sources.tables).
RAW = """raw as (
  select case when l_returnflag='R' then concat('C', cast(l_orderkey as varchar)) else cast(l_orderkey as varchar) end InvoiceNo,
         cast(l_partkey as varchar) StockCode,
         case when l_partkey % 97 = 0 then null else p_type end Description,
         l_quantity Quantity,
         o_orderdate InvoiceDate,
         case when (l_orderkey*7 + l_linenumber) % 100 = 0 then -1.0 else l_extendedprice/l_quantity end UnitPrice,
         case when l_orderkey % 13 = 0 then null else cast(o_custkey as varchar) end CustomerID
  from lineitem join orders on l_orderkey=o_orderkey join part on l_partkey=p_partkey)"""

CLEAN = """clean as (
  select InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice,
         replace(CustomerID, '.0', '') CustomerID, Quantity*UnitPrice TotalPrice
  from raw
  where CustomerID is not null and Description is not null
    and not coalesce(starts_with(InvoiceNo, 'C'), false)
    and Quantity > 0 and UnitPrice > 0)"""

RFM = """rfm as (
  select CustomerID,
         date_sub('day', max(InvoiceDate), (select max(InvoiceDate) from clean) + interval 1 day) Recency,
         count(distinct InvoiceNo) Frequency,
         sum(TotalPrice) Monetary
  from clean group by CustomerID having sum(TotalPrice) > 0)"""

SCALED = """lg as (select CustomerID, ln(1+Recency) r, ln(1+Frequency) f, ln(1+Monetary) m from rfm),
st as (select avg(r) mr, stddev_pop(r) sr, avg(f) mf, stddev_pop(f) sf, avg(m) mm, stddev_pop(m) sm from lg),
scaled as (
  select CustomerID,
         case when sr = 0 then 0.0 else (r-mr)/sr end Recency,
         case when sf = 0 then 0.0 else (f-mf)/sf end Frequency,
         case when sm = 0 then 0.0 else (m-mm)/sm end Monetary
  from lg, st)"""

ITEMS = """items as (select distinct InvoiceNo, Description item from clean)"""


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


ORACLE = {}

ORACLE["clean_lines"] = with_(RAW, CLEAN) + """
select InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, TotalPrice
from clean"""

ORACLE["clean_audit"] = with_(RAW) + """,
p as (select *, replace(CustomerID, '.0', '') cid,
             coalesce(starts_with(InvoiceNo, 'C'), false) cancel from raw)
select count(*) initial_rows,
       count(*) filter (where cid is not null and Description is not null and not cancel
                        and Quantity > 0 and UnitPrice > 0) cleaned_rows,
       count(*) filter (where cid is null) missing_customer_ids,
       count(*) filter (where Description is null) missing_descriptions,
       count(*) filter (where cid is not null and Description is not null and cancel) canceled_invoices,
       count(*) filter (where cid is not null and Description is not null and not cancel
                        and (Quantity <= 0 or UnitPrice <= 0)) invalid_qty_or_price,
       round(count(*) filter (where cid is not null and Description is not null and not cancel
                        and Quantity > 0 and UnitPrice > 0) / greatest(count(*), 1) * 100, 2) retention_rate_pct
from p"""

ORACLE["rfm_raw"] = with_(RAW, CLEAN, RFM) + """
select CustomerID, Recency, Frequency, round(Monetary, 2) Monetary from rfm"""

ORACLE["rfm_scaled"] = with_(RAW, CLEAN, RFM, SCALED) + """
select CustomerID, round(Recency, 4) Recency, round(Frequency, 4) Frequency, round(Monetary, 4) Monetary
from scaled"""

ORACLE["wcss_k1"] = with_(RAW, CLEAN, RFM, SCALED) + """
select round(sum(Recency*Recency) - count(*)*avg(Recency)*avg(Recency)
           + sum(Frequency*Frequency) - count(*)*avg(Frequency)*avg(Frequency)
           + sum(Monetary*Monetary) - count(*)*avg(Monetary)*avg(Monetary), 4) wcss,
       count(*) n_points
from scaled"""

ORACLE["rfm_histogram"] = with_(RAW, CLEAN, RFM) + """,
lng as (select 'Recency' feature, cast(Recency as double) value from rfm
        union all select 'Frequency', cast(Frequency as double) from rfm
        union all select 'Monetary', Monetary from rfm),
b as (select feature, min(value) lo, max(value) hi from lng group by feature),
x as (select l.feature, lo, hi,
             cast(case when hi = lo then 0 else least(floor((value - lo) / (hi - lo) * 20), 19) end as integer) bin
      from lng l join b on l.feature = b.feature)
select feature, bin, round(lo + bin * ((hi - lo) / 20), 4) bin_lo, round(lo + (bin + 1) * ((hi - lo) / 20), 4) bin_hi,
       count(*) n
from x group by feature, bin, lo, hi"""

ORACLE["basket_long"] = with_(RAW, CLEAN) + """
select InvoiceNo, Description item, sum(Quantity) Quantity from clean group by InvoiceNo, Description"""

ORACLE["basket_arrays"] = with_(RAW, CLEAN, ITEMS) + """
select InvoiceNo, array_to_string(list_sort(list(item)), ', ') items_str, count(*) n_items
from items group by InvoiceNo"""

ORACLE["top_products"] = with_(RAW, CLEAN) + """
select Description, sum(Quantity) Quantity from clean group by Description
order by Quantity desc, Description limit 10"""

ORACLE["item_support"] = with_(RAW, CLEAN, ITEMS) + """
select item, count(*) n_baskets, round(count(*) / (select count(distinct InvoiceNo) from items), 6) support
from items group by item"""

ORACLE["clean_preview"] = with_(RAW, CLEAN) + """
select InvoiceNo, StockCode, Description, Quantity, InvoiceDate, UnitPrice, CustomerID, TotalPrice
from clean
order by InvoiceNo, StockCode, InvoiceDate, Quantity, UnitPrice limit 5"""

# ---- itemsets and rules (brute force: every subset of every basket) --------
MIN_SUPPORT = 0.03

BASKETS = """baskets as (select InvoiceNo, list_sort(list(item)) b from items group by InvoiceNo),
nb as (select count(*) n from baskets)"""


def itemsets_cte(min_support: float = MIN_SUPPORT) -> str:
    return f"""subs as (select list_filter(b, lambda x, i: (m >> (i-1)) & 1 = 1) its
         from (select b, unnest(range(1, (1 << len(b)))) m from baskets)),
itemsets as (select its items, count(*) freq, count(*) / (select cast(n as double) from nb) support
             from subs group by its
             having count(*) >= ceil(cast({min_support} as double) * (select n from nb)))"""


RULES = """r0 as (select items, support s, unnest(range(1, (1 << len(items)) - 1)) m
       from itemsets where len(items) >= 2),
r1 as (select list_filter(items, lambda x, i: (m >> (i-1)) & 1 = 1) ant,
              list_filter(items, lambda x, i: (m >> (i-1)) & 1 = 0) con, s from r0),
r2 as (select ant, con, a.support sa, c.support sc, s
       from r1 join itemsets a on a.items = r1.ant join itemsets c on c.items = r1.con),
r3 as (select *, s / sa conf, s - sa * sc lev, greatest(s * (1 - sa), sa * (sc - s)) den from r2),
allrules as (select ant, con, sa antecedent_support, sc consequent_support, s support,
                    conf confidence, conf / sc lift, lev leverage,
                    case when conf >= 1.0 then cast('Infinity' as double) else (1 - sc) / (1 - conf) end conviction,
                    case when den = 0 then 0.0 else lev / den end zhangs_metric,
                    array_to_string(ant, ', ') antecedents_str, array_to_string(con, ', ') consequents_str
             from r3)"""


def rules_cte(metric: str = "confidence", threshold: float = 0.2) -> str:
    return RULES + f""",
rules as (select antecedent_support, consequent_support, round(support, 4) support,
                 round(confidence, 4) confidence, round(lift, 4) lift, round(leverage, 4) leverage,
                 round(conviction, 4) conviction, zhangs_metric, antecedents_str, consequents_str,
                 antecedents_str || ' ➔ ' || consequents_str rule
          from allrules where {metric} >= {threshold})"""


MINE = with_(RAW, CLEAN, ITEMS, BASKETS, itemsets_cte())

ORACLE["frequent_itemsets"] = MINE + """
select array_to_string(items, ', ') items_str, len(items) n_items, freq, support from itemsets"""

ORACLE["apriori_itemsets"] = ORACLE["frequent_itemsets"]

ORACLE["itemset_counts"] = MINE + """
select count(*) apriori_itemset_count, count(*) fpgrowth_itemset_count from itemsets"""

ORACLE["itemset_pairs"] = with_(RAW, CLEAN, ITEMS) + """
select a.item a, b.item b, count(*) freq
from items a join items b on a.InvoiceNo = b.InvoiceNo and a.item < b.item
group by a.item, b.item"""

RULE_COLS = """antecedents_str, consequents_str, rule, antecedent_support, consequent_support, support,
       confidence, lift, leverage, conviction, zhangs_metric"""

ORACLE["association_rules"] = MINE + "," + rules_cte("confidence", 0.1) + f"""
select {RULE_COLS} from rules"""

ORACLE["rules_by_metric_lift"] = MINE + "," + rules_cte("lift", 0.95) + f"""
select {RULE_COLS} from rules"""

ORACLE["rules_by_metric_support"] = MINE + "," + rules_cte("support", 0.05) + f"""
select {RULE_COLS} from rules"""

ORACLE["rules_by_lift"] = MINE + "," + rules_cte() + """
select rule, antecedents_str, consequents_str, support, confidence, lift from rules where lift >= 0.9"""

ORACLE["rules_scatter"] = MINE + "," + rules_cte() + """
select support, confidence, lift, rule from rules where lift >= 0.9"""

TOP_EDGES = """edges as (select antecedents_str src, consequents_str dst, lift weight from rules
          where lift >= 0.9
          order by lift desc, confidence desc, support desc, rule limit 15)"""

ORACLE["rule_graph_edges"] = MINE + "," + rules_cte() + "," + TOP_EDGES + """
select src, dst, weight from edges"""

ORACLE["rule_graph_nodes"] = MINE + "," + rules_cte() + "," + TOP_EDGES + """
select id, count(*) degree, format('Item: {} | Connections: {}', id, count(*)) hover from (select src id from edges union all select dst from edges) group by id"""

# ---- evaluation on deterministic labels (customer market segment) ---------
SEGLAB = """seglab as (select cast(c_custkey as varchar) CustomerID,
                   cast(dense_rank() over (order by c_mktsegment) - 1 as integer) Cluster from customer)"""

PTS = """pts as (select s.CustomerID id, l.Cluster k, s.Recency x, s.Frequency y, s.Monetary z
        from scaled s join seglab l on s.CustomerID = l.CustomerID where l.Cluster <> -1)"""

SIL = """dd as (select a.id, a.k, b.k k2,
              sum(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))) d, count(*) n
       from pts a cross join pts b group by a.id, a.k, b.k),
ab as (select id, max(case when k = k2 and n > 1 then d/(n-1) end) a,
              min(case when k <> k2 then d/n end) b, max(case when k = k2 then n end) n_own
       from dd group by id),
sil as (select round(avg(case when n_own <= 1 then 0.0
                              else coalesce((b-a)/nullif(greatest(a,b),0), 0) end), 4) silhouette_score from ab)"""

DBI = """cen as (select k, avg(x) cx, avg(y) cy, avg(z) cz from pts group by k),
spr as (select p.k, cx, cy, cz, avg(sqrt((x-cx)*(x-cx) + (y-cy)*(y-cy) + (z-cz)*(z-cz))) sg
        from pts p join cen on p.k = cen.k group by p.k, cx, cy, cz),
rr as (select a.k, max(coalesce((a.sg+b.sg) /
              nullif(sqrt((a.cx-b.cx)*(a.cx-b.cx) + (a.cy-b.cy)*(a.cy-b.cy) + (a.cz-b.cz)*(a.cz-b.cz)), 0), 0)) r
       from spr a join spr b on a.k <> b.k group by a.k),
dbi as (select round(avg(r), 4) davies_bouldin_index from rr)"""

EVAL = with_(RAW, CLEAN, RFM, SCALED, SEGLAB, PTS)

ORACLE["silhouette_exact"] = EVAL + "," + SIL + "\nselect silhouette_score from sil"

ORACLE["davies_bouldin"] = EVAL + "," + DBI + "\nselect davies_bouldin_index from dbi"

ORACLE["cluster_metrics"] = EVAL + "," + SIL + "," + DBI + """
select silhouette_score, davies_bouldin_index, cast((select count(distinct k) from pts) as integer) n_clusters,
       cast(0 as integer) noise_count, 'Success' status from sil, dbi"""

PROFILE = """profile as (select l.Cluster, round(avg(Recency), 1) Recency_Mean, round(avg(Frequency), 1) Frequency_Mean,
                    round(avg(Monetary), 2) Monetary_Mean, count(*) Customer_Count
             from rfm r join seglab l on r.CustomerID = l.CustomerID group by l.Cluster)"""

ORACLE["cluster_profiles"] = with_(RAW, CLEAN, RFM, SEGLAB, PROFILE) + "select * from profile"

ORACLE["cluster_points"] = with_(RAW, CLEAN, RFM, SCALED, SEGLAB) + """
select s.CustomerID, round(Recency, 4) Recency, round(Frequency, 4) Frequency, round(Monetary, 4) Monetary,
       l.Cluster, case when l.Cluster = -1 then 'Noise (-1)' else 'Cluster ' || cast(l.Cluster as varchar) end ClusterLabel
from scaled s join seglab l on s.CustomerID = l.CustomerID"""

# ---- density clustering (eps 0.5, min_samples 5 on the scaled features) ----
PAIRS = """pid as (select CustomerID id, Recency x, Frequency y, Monetary z from scaled),
pr as (select a.id a, b.id b from pid a join pid b
       on (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) <= 0.5*0.5)"""

DBSCAN = """core as (select a id from pr group by a having count(*) >= 5),
ce as (select pr.a, pr.b from pr join core c1 on pr.a = c1.id join core c2 on pr.b = c2.id),
w(id, comp) as (select id, id from core
                union select ce.b, w.comp from w join ce on ce.a = w.id where w.comp < ce.b),
kk as (select id, min(comp) comp from w group by id),
nl as (select id, cast(dense_rank() over (order by comp) - 1 as integer) lab from kk),
bl as (select pr.a id, min(nl.lab) lab from pr join nl on pr.b = nl.id group by pr.a),
dbl as (select p.id CustomerID, cast(coalesce(nl.lab, bl.lab, -1) as integer) Cluster
        from pid p left join nl on nl.id = p.id left join bl on bl.id = p.id)"""

ORACLE["eps_neighbors"] = with_(RAW, CLEAN, RFM, SCALED, PAIRS) + """
select a CustomerID, count(*) n_neighbors from pr group by a"""

ORACLE["dbscan_labels"] = "with recursive " + with_(RAW, CLEAN, RFM, SCALED, PAIRS, DBSCAN)[5:] + """
select CustomerID, Cluster from dbl"""

# ---- K-Means: starts, rounds and restarts as recursive queries ---------------
def kmeans_cte(k_lo: int, k_hi: int, n_init: int = 10, seed: int = 42, max_iter: int = 300) -> str:
    """CTEs up to ``best(k, cs, cost)``: the operator's hash-drawn starts, Lloyd rounds and choice of restart."""
    def d2(c: str) -> str:
        return f"(x-{c}[1])*(x-{c}[1]) + (y-{c}[2])*(y-{c}[2]) + (z-{c}[3])*(z-{c}[3])"

    def draw(step: str) -> str:
        return (f"(cast(concat('0x', substr(md5(concat_ws(':', '{seed}', cast(r as varchar), {step}, id)), 1, 13))"
                " as bigint) + 0.5) / 4503599627370496.0")

    return f"""pts as materialized (select CustomerID id, Recency x, Frequency y, Monetary z from scaled),
lim as materialized (select 1e-4 * (var_pop(x) + var_pop(y) + var_pop(z)) / 3 v from pts),
seeds(step, r, cs) as (
  select 0, r, [arg_min([x, y, z], -ln({draw("'0'")}))] from pts, (select unnest(range({n_init})) r) group by r
  union all
  select step + 1, r, list_append(any_value(cs), arg_min([x, y, z], race)) from (
    select step, r, cs, x, y, z, case when d > 0 then -ln({draw("cast(step + 1 as varchar)")}) / d else cast('infinity' as double) end race
    from (select s.step, s.r, s.cs, p.id, p.x, p.y, p.z, list_min(list_transform(s.cs, lambda c: {d2('c')})) d
          from seeds s, pts p where s.step < {k_hi - 1}))
  group by step, r),
lloyd(it, k, r, cs, moving) as (
  select 0, k, r, cs[1:k], true from (select unnest(range({k_lo}, {k_hi + 1})) k), seeds where step = {k_hi - 1}
  union all
  select it, k, r, cs, list_sum(list_transform(range(1, k + 1), lambda i:
           (cs[i][1]-old[i][1])**2 + (cs[i][2]-old[i][2])**2 + (cs[i][3]-old[i][3])**2)) > (select v from lim)
  from (
    select it, k, r, old, list_transform(range(1, k + 1), lambda i: coalesce(moved[i], old[i])) cs
    from (
      select it + 1 it, k, r, any_value(cs) old, map_from_entries(list(row(j, c))) moved
      from (
        select it, k, r, any_value(cs) cs, j, [avg(x), avg(y), avg(z)] c
        from (select it, k, r, cs, x, y, z, list_position(dd, list_min(dd)) j
              from (select l.it, l.k, l.r, l.cs, p.x, p.y, p.z, list_transform(l.cs, lambda c: {d2('c')}) dd
                    from lloyd l, pts p where l.moving and l.it < {max_iter}))
        group by it, k, r, j)
      group by it, k, r))),
ended as (select k, r, cs from lloyd qualify row_number() over (partition by k, r order by it desc) = 1),
costs as (select k, r, any_value(cs) cs, sum(list_min(list_transform(cs, lambda c: {d2('c')}))) cost from ended, pts group by k, r),
best as (select k, cs, cost from costs qualify row_number() over (partition by k order by round(cost, 6), r) = 1)"""


def _kmeans(k_lo: int, k_hi: int) -> str:
    return "with recursive " + with_(RAW, CLEAN, RFM, SCALED, kmeans_cte(k_lo, k_hi))[5:]


ORACLE["elbow_curve"] = _kmeans(1, 10) + """
select cast(k as integer) k, round(cost, 4) wcss from best"""

ORACLE["kmeans_centroids"] = _kmeans(3, 3) + """,
cen as (select unnest(range(3)) i, unnest(list_sort(cs)) c from best)
select i Cluster, concat('Cluster ', i) name, round(c[1], 4) Recency, round(c[2], 4) Frequency, round(c[3], 4) Monetary
from cen"""

ORACLE["kmeans_labels"] = _kmeans(3, 3) + """,
dd as (select id, list_transform(list_sort(cs), lambda c:
                  (x-c[1])*(x-c[1]) + (y-c[2])*(y-c[2]) + (z-c[3])*(z-c[3])) dd from pts, best)
select id CustomerID, cast(list_position(dd, list_min(dd)) - 1 as integer) Cluster from dd"""

# ---- nearest-centroid assignment to the segment centroids -------------------
ORACLE["kmeans_assign"] = EVAL + """,
cen as (select k, avg(x) c0, avg(y) c1, avg(z) c2 from pts group by k),
dd as (select p.id, c.k, (p.x-c.c0)*(p.x-c.c0) + (p.y-c.c1)*(p.y-c.c1) + (p.z-c.c2)*(p.z-c.c2) d
       from pts p cross join cen c),
rk as (select id, k, d, row_number() over (partition by id order by d, k) rn from dd)
select id CustomerID, cast(k as integer) Cluster, round(sqrt(d), 4) distance from rk where rn = 1"""

# ---- payload, personas, report rules, analyze ------------------------------
PAY = with_(RAW, CLEAN, RFM, SEGLAB, PROFILE, ITEMS, BASKETS, itemsets_cte()) + "," + rules_cte() + """,
prl as (select row_number() over (order by lift desc, confidence desc, support desc, rule) position,
               antecedents_str antecedent_items, consequents_str consequent_items, support, confidence, lift
        from rules qualify position <= 10)
"""

ORACLE["insight_payload"] = PAY + """
select 'segment' section, Cluster position, cast(Cluster as integer) cluster_id, Recency_Mean recency_days_avg,
       Frequency_Mean frequency_invoices_avg, Monetary_Mean monetary_spend_avg, cast(Customer_Count as integer) customer_count,
       cast(null as varchar) antecedent_items, cast(null as varchar) consequent_items,
       cast(null as double) support, cast(null as double) confidence, cast(null as double) lift
from profile
union all
select 'rule', position, null, null, null, null, null, antecedent_items, consequent_items, support, confidence, lift
from prl"""

def _json_items(alias: str, fields: list[tuple[str, bool]], table: str, order: str) -> str:
    """CTE of one value: the rows of ``table`` as a pretty JSON array (fields: name, whether it is text)."""
    parts = " || ',' || chr(10) || ".join(
        f"'    \"{f}\" : ' || " + (f"'\"' || {f} || '\"'" if text else f"cast({f} as varchar)") for f, text in fields)
    return (f"{alias} as (select coalesce('[ ' || string_agg('{{' || chr(10) || {parts} || chr(10) || '  }}', ', ' "
            f"order by {order}) || ' ]', '[ ]') j from {table})")


SEGMENT_FIELDS = [(f, False) for f in ("cluster_id", "recency_days_avg", "frequency_invoices_avg", "monetary_spend_avg",
                                       "customer_count")]
RULE_FIELDS = [("antecedent_items", True), ("consequent_items", True), ("support", False), ("confidence", False),
               ("lift", False)]
PAYLOAD = (PAY.rstrip() + """,
seg as (select Cluster cluster_id, Recency_Mean recency_days_avg, Frequency_Mean frequency_invoices_avg,
               Monetary_Mean monetary_spend_avg, Customer_Count customer_count from profile),
""" + _json_items("sj", SEGMENT_FIELDS, "seg", "cluster_id") + ",\n" + _json_items("rj", RULE_FIELDS, "prl", "position") + """,
pay as (select '{' || chr(10) || '  "project_title" : "%s",' || chr(10) || '  "cluster_segments" : ' || sj.j || ','
               || chr(10) || '  "top_association_rules" : ' || rj.j || chr(10) || '}' payload from sj, rj)""" % rp.PROJECT_TITLE)

ORACLE["insight_payload_json"] = PAYLOAD + "\nselect payload from pay"


def _text(t: str) -> str:
    return "'" + t.replace("'", "''") + "'"


ORACLE["prompt_table"] = PAYLOAD + f"""
select 'chat' as style, {_text(rp.SYSTEM_PROMPT)} as system, {_text(rp.USER_PREFIX)} || payload as prompt from pay
union all
select 'plain', null, {_text(rp.SYSTEM_PROMPT + rp.PLAIN_PREFIX)} || payload from pay"""

ORACLE["cluster_personas"] = with_(RAW, CLEAN, RFM, SEGLAB, PROFILE) + """
select *, case when Monetary_Mean > 500 or Frequency_Mean > 10 then 'High-Value VIP Loyalists'
               when Recency_Mean > 100 then 'At-Risk / Dormant Customers'
               else 'Steady Core Shoppers' end persona,
       Cluster = -1 is_noise
from profile"""

ORACLE["report_rules"] = PAY + """
select position rule_no,
       '### Rule #' || cast(position as varchar) || ': [' || antecedent_items || '] ➔ [' || consequent_items || ']' title,
       '- **Metrics:** Lift = `' || cast(lift as varchar) || '` | Confidence = `'
         || cast(cast(round(cast(confidence * 100 as decimal(20,4)), 1) as decimal(20,1)) as varchar)
         || '%` | Support = `'
         || cast(cast(round(cast(support * 100 as decimal(20,4)), 1) as decimal(20,1)) as varchar) || '%`' metrics,
       '- **Merchandising Action:** Place `' || consequent_items || '` directly adjacent to `' || antecedent_items
         || '` on shelf or configure automated ''Customers who bought ' || antecedent_items || ' also added '
         || consequent_items || ''' digital popup widgets.' || chr(10) action
from prl where position <= 5"""

def _lines(rows: list[tuple[int, int, list[str]]]) -> str:
    """Fixed report lines as a VALUES list of (section, sub, pos, line)."""
    quote = lambda t: t.replace("'", "''")
    return ", ".join(f"({a}, {b}, {i}, '{quote(t)}')" for a, b, ls in rows for i, t in enumerate(ls))


ORACLE["offline_report"] = PAY + ", rr as (" + ORACLE["report_rules"].removeprefix(PAY) + """),
who as (select *, case when Monetary_Mean > 500 or Frequency_Mean > 10 then 0 when Recency_Mean > 100 then 1 else 2 end w
        from profile),
named as (select *, ['""" + "', '".join([rp.PERSONA_VIP, rp.PERSONA_RISK, rp.PERSONA_CORE]) + """'][w + 1] persona,
                 ['""" + "', '".join(rp.PERSONA_ICON[p] for p in (rp.PERSONA_VIP, rp.PERSONA_RISK, rp.PERSONA_CORE)) + """'][w + 1] icon,
                 ['""" + "', '".join([rp.PERSONA_VIP_DESC, rp.PERSONA_RISK_DESC, rp.PERSONA_CORE_DESC]) + """'][w + 1] about
          from who),
segs as (select 1 section, Cluster sub, unnest(range(6)) pos, unnest([
            '### ' || icon || ' Cluster ' || Cluster || ': ' || persona,
            '- **Customer Count:** ' || Customer_Count || ' customers',
            '- **Average Recency:** ' || Recency_Mean || ' days',
            '- **Average Order Frequency:** ' || Frequency_Mean || ' orders',
            '- **Average Total Monetary Value:** $' || format('{:,.2f}', Monetary_Mean),
            '- **Behavioral Assessment:** ' || about || chr(10)]) line from named),
rls as (select 3 section, rule_no sub, unnest(range(3)) pos, unnest([title, metrics, action]) line from rr),
fixed(section, sub, pos, line) as (values """ + _lines([
    (0, 0, rp.REPORT_HEAD), (2, 0, rp.REPORT_SECTION2), (3, 0, [rp.REPORT_RULES_INTRO]), (4, 0, rp.REPORT_SECTION4)]) + """)
select cast(row_number() over (order by section, sub, pos) as integer) line_no, line
from (select * from segs union all select * from rls union all select * from fixed)"""

ORACLE["offline_report_json"] = ORACLE["offline_report"]

ORACLE["insight_payload_parsed"] = ORACLE["insight_payload"]

KM_PTS = "kp as (select id, list_position(dd, list_min(dd)) - 1 k, x, y, z from (" \
    "select p.*, list_transform(list_sort(b.cs), lambda c: (x-c[1])*(x-c[1]) + (y-c[2])*(y-c[2]) + (z-c[3])*(z-c[3])) dd " \
    "from pts p, best b))"


def metrics_of(points: str) -> str:
    """Silhouette and Davies-Bouldin CTEs over another point table than ``pts``."""
    return (SIL + "," + DBI).replace("from pts ", f"from {points} ").replace("join pts ", f"join {points} ")


def _analyze() -> str:
    return _kmeans(3, 3) + "," + KM_PTS + "," + metrics_of("kp")


ORACLE["kmeans_metrics"] = _analyze() + """
select silhouette_score, davies_bouldin_index, cast((select count(distinct k) from kp) as integer) n_clusters,
       cast(0 as integer) noise_count, 'Success' status from sil, dbi"""

ORACLE["analyze_summary"] = _analyze() + ",\n" + ",\n".join([ITEMS, BASKETS, itemsets_cte()]) + "," + rules_cte() + """,
top as (select rule, row_number() over (order by lift desc, confidence desc, support desc, rule) n
        from rules qualify n <= 5)
select 'success' status, (select count(*) from clean) cleaned_rows,
       (select count(*) from rules) mined_rules_count,
       (select string_agg(rule, ' | ' order by n) from top) top_rules_text,
       silhouette_score, davies_bouldin_index, cast((select count(distinct k) from kp) as integer) n_clusters,
       cast(0 as integer) noise_count, 'Success' metrics_status
from sil, dbi"""

DB_PTS = "dp as (select p.id, d.Cluster k, x, y, z from pid p join dbl d on p.id = d.CustomerID where d.Cluster <> -1)"
ORACLE["dbscan_metrics"] = ("with recursive " + with_(RAW, CLEAN, RFM, SCALED, PAIRS, DBSCAN, DB_PTS)[5:] + ","
                            + metrics_of("dp") + """
select case when n >= 2 then silhouette_score end silhouette_score,
       case when n >= 2 then davies_bouldin_index end davies_bouldin_index, cast(n as integer) n_clusters,
       cast((select count(*) from dbl where Cluster = -1) as integer) noise_count,
       case when n >= 2 then 'Success' else '""" + STATUS_FEW + """' end status
from (select count(distinct k) n from dp), sil, dbi""")

ORACLE["dbscan_profiles"] = ("with recursive " + with_(RAW, CLEAN, RFM, SCALED, PAIRS, DBSCAN)[5:] + ","
                             + PROFILE.replace("seglab", "dbl") + "\nselect * from profile")

ORACLE["silhouette_squared"] = EVAL + "," + SIL.replace(
    "sum(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)))",
    "sum((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))") + "\nselect silhouette_score from sil"

# ---- text input ---------------------------------------------------------------
ORACLE["csv_scan"] = with_(RAW) + """
select InvoiceNo, StockCode,
       case when cast(StockCode as bigint) % 3 = 0 then concat('SET OF 6 "', Description, '", TINS')
            when cast(StockCode as bigint) % 3 = 1 then Description || chr(10) || 'two lines'
            else Description || chr(92) end Description,
       cast(cast(Quantity as bigint) as varchar) Quantity, strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S') InvoiceDate,
       cast(cast(floor(UnitPrice) as bigint) as varchar) UnitPrice, CustomerID
from raw""".replace("concat('SET OF 6 \"', Description, '\", TINS')", "'SET OF 6 \"' || Description || '\", TINS'")

ORACLE["csv_scan_latin"] = "select * replace ('crème; ' || Description as Description) from (" + ORACLE["csv_scan"] + ")"

ORACLE["clean_text_lines"] = with_(RAW) + """,
t as (select *, cast(StockCode as bigint) k, floor(UnitPrice) p from raw)
select InvoiceNo, StockCode, Description, Quantity, InvoiceDate + case when k % 4 = 0 then interval 123 milliseconds
       else interval 0 milliseconds end InvoiceDate, p UnitPrice, CustomerID, Quantity * p TotalPrice
from t
where CustomerID is not null and Description is not null and not starts_with(InvoiceNo, 'C')
  and k % 50 not in (7, 8) and Quantity > 0 and p > 0"""

ORACLE["clean_dayfirst_lines"] = with_(RAW, CLEAN) + """
select InvoiceNo, StockCode, Description, Quantity,
       case when cast(StockCode as bigint) % 5 = 1 then date_trunc('second', InvoiceDate)
            else date_trunc('minute', InvoiceDate) end InvoiceDate, UnitPrice, CustomerID, TotalPrice
from clean"""

# ---- header normalisation and the wide basket matrix ------------------------
ORACLE["normalize_columns"] = with_(RAW) + "select * from raw"

# The item names of the driver's part table.
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]

ORACLE["basket_matrix"] = with_(RAW, CLEAN) + """,
bl as (select InvoiceNo, Description item, sum(Quantity) q from clean group by all)
select InvoiceNo, """ + ", ".join(
    f"coalesce(sum(q) filter (where item = '{i}'), 0) > 0 as \"{i}\"" for i in PART_TYPES) + """
from bl group by InvoiceNo"""

ORACLE["basket_vectors"] = with_(RAW, CLEAN) + """,
bl as (select InvoiceNo, Description item, sum(Quantity) q from clean group by all),
ix as (select item, row_number() over (order by item) - 1 n from (select distinct item from bl))
select InvoiceNo, cast(count(*) filter (where q > 0) as int) n_items,
       coalesce(string_agg(cast(n as varchar), ',' order by n) filter (where q > 0), '') item_nos
from bl join ix using (item) group by InvoiceNo"""
