"""Conversation structure repair: an auction finds cheapest edit paths, and its prices show all of them."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import ship_package
from tillroll.session import checkpointed

#: Costs of the edits; a truncated message that stays costs one more.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States: nothing yet, or the initial of the last role.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
#: State after a turn of user and assistant, by the state before it.
NEXT = (USER, USER, ASSISTANT, USER)
#: Least cost from each state to a legal end behind the last message, which is that many insertions.
END = (0, 2 * INSERT, INSERT, 0)
CLOSING = (0, 2, 1, 0)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Messages of the lattice priced together, from the last block to the first.
BLOCK = 16
#: Code points of repaired text in an output piece, about.
PIECE_CHARS = 1 << 20

_FACTS = ("n_rows", "n_turns", "blank", "duplicate", "truncated", "illegal", "cost")
_EDGES = ("first_turn", "last_turn", "first_initial", "last_initial")
PIECES = ("conv_id long, piece long, whole boolean, " + ", ".join(f"{c} long" for c in _FACTS)
          + ", first_turn long, last_turn long, first_initial string, last_initial string, audit string, repaired string")


def arcs(initial: str, truncated: bool, state: int, left: bool):
    """Edits that pass a message in ``state``, as (letter, cost, state after); ``left``: insertions too, which don't pass it."""
    more = TRUNCATED if truncated else 0
    out = [("D", DELETE, state)]
    if left:
        out.append(("I", INSERT, NEXT[state]))
    if (initial == "s" and state == START) or (initial == "u" and NEXT[state] == USER) or (
            initial == "a" and NEXT[state] == ASSISTANT):
        out.append(("K", more, SYSTEM if initial == "s" else NEXT[state]))
    out.append(("R", REROLE + more, NEXT[state]))
    return out


class Lattice:
    """Edit lattice of one run of messages: node 4 * i + state stands before message i, insertions stay at i.

    ``ends`` maps the states allowed behind the last message to the cost from
    there on. Messages that must go aren't in the lattice: dropping them costs
    the same on every path, and their ``D`` always comes before the insertions
    at their place, since a path that inserts first is the same path with a
    later audit.
    """

    def __init__(self, rows: tuple, ends: dict[int, int]):
        self.n = len(rows)
        self.sink = 4 * self.n + 4
        self.out: list[list[tuple[str, int, int]]] = [[] for _ in range(self.sink + 1)]
        live = [s in ends for s in STATES]
        for s in STATES:
            if live[s]:
                self.out[4 * self.n + s] = [("", ends[s], self.sink)]
        for i in range(self.n - 1, -1, -1):  # arcs only to nodes from which an end can be reached
            passing = [[(e, c, 4 * (i + 1) + t) for e, c, t in arcs(*rows[i], s, False) if live[t]] for s in STATES]
            live = [bool(p) for p in passing]
            for s in (ASSISTANT, USER, SYSTEM, START):
                live[s] = live[s] or live[NEXT[s]]
            live[ASSISTANT] = live[ASSISTANT] or live[USER]
            for s in STATES:
                own = passing[s]
                if live[NEXT[s]]:
                    own.append(("I", INSERT, 4 * i + NEXT[s]))
                self.out[4 * i + s] = sorted(own)
        self.live = live
        self.price = [0] * (self.sink + 1)
        self._prices()

    def _prices(self) -> None:
        """Bid until the price of every border node is its distance to the sink, block by block from the end.

        Prices start at the least price of the block behind, which is feasible,
        so a node's price rises by the distance within its block at most.
        """
        price = self.price
        for s in STATES:
            if self.out[4 * self.n + s]:
                price[4 * self.n + s] = self.out[4 * self.n + s][0][1]
        for last in range(self.n, 0, -BLOCK):
            first = max(0, last - BLOCK)
            floor = min(price[4 * last + s] for s in STATES if self.out[4 * last + s])
            for node in range(4 * first, 4 * last):
                price[node] = floor
            for s in STATES:
                if self.out[4 * first + s]:
                    self._auction(4 * first + s, 4 * last)

    def _auction(self, origin: int, border: int) -> None:
        """Forward auction from ``origin`` to the border: extend the path along a tight arc, or raise a price and contract.

        Prices stay dual feasible (no node's exceeds arc cost plus the price
        behind the arc) and every arc of the path is tight, so that the
        origin's price is its distance when the path arrives.
        """
        price, out = self.price, self.out
        path = [origin]
        while path[-1] < border:
            node = path[-1]
            best, to = min((cost + price[j], j) for _, cost, j in out[node])
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)

    def cost(self, entry: int) -> int:
        return self.price[entry]

    def trace(self, entry: int) -> tuple[str, int]:
        """(ASCII-least audit, state behind the last message) among all cheapest paths from ``entry``.

        Every arc of every cheapest path is tight, so the first way to the sink
        in a depth-first walk over tight arcs by their letters is the least.
        """
        price, out = self.price, self.out
        path, letters, dead = [entry], [], set()
        tries = [iter(out[entry])]
        while path[-1] != self.sink:
            node = path[-1]
            for letter, cost, j in tries[-1]:
                if j not in dead and price[node] == cost + price[j]:
                    path.append(j)
                    letters.append(letter)
                    tries.append(iter(out[j]))
                    break
            else:
                dead.add(path.pop())
                tries.pop()
                letters.pop()
        return "".join(letters), path[-2] % 4


@lru_cache(maxsize=20_000)
def cheapest(rows: tuple, entry: int = START, leave: int | None = None) -> tuple[int, str]:
    """(cost, audit) of the messages that may stay, from ``entry`` to ``leave`` (None: a legal end, closing turns included)."""
    lattice = Lattice(rows, dict(enumerate(END)) if leave is None else {leave: 0})
    audit, last = lattice.trace(entry)
    return lattice.cost(entry), audit + "I" * CLOSING[last] if leave is None else audit


def summary(rows: tuple) -> tuple[list, list]:
    """(costs, ranks) of a run of messages: [4 * entry + exit], -1 where there is no way.

    Ranks order an entry's exits by their least audit. Two exits' audits
    differ before either ends, so what comes behind the run can't change the
    order.
    """
    costs, ranks = [-1] * 16, [-1] * 16
    audits: dict[int, list] = {s: [] for s in STATES}
    for t in STATES:
        lattice = Lattice(rows, {t: 0})
        for s in STATES:
            if lattice.out[s]:
                costs[4 * s + t] = lattice.cost(s)
                audits[s].append((lattice.trace(s)[0], t))
    for s, found in audits.items():
        for rank, (_, t) in enumerate(sorted(found)):
            ranks[4 * s + t] = rank
    return costs, ranks


def plan(runs: list[tuple[int, list, list]]) -> dict[int, tuple[int, int]]:
    """{part: (entry, exit)} of the runs (part, costs, ranks) of one conversation, in order."""
    ahead = list(END)
    tables = [ahead]
    for _, costs, _ in reversed(runs):
        ahead = [min((costs[4 * s + t] + ahead[t] for t in STATES if costs[4 * s + t] >= 0 and ahead[t] is not None),
                     default=None) for s in STATES]
        tables.append(ahead)
    tables.reverse()
    state, out = START, {}
    for k, (part, costs, ranks) in enumerate(runs):
        after = tables[k + 1]
        best = [t for t in STATES if costs[4 * state + t] >= 0 and after[t] is not None
                and costs[4 * state + t] + after[t] == tables[k][state]]
        leave = min(best, key=lambda t: ranks[4 * state + t])
        out[part] = (state, leave)
        state = leave
    return out


def _flagged(chats: DataFrame) -> DataFrame:
    """Distinct messages in order, with how often each occurs and its first fault; partitions that stay as they are.

    Messages that agree in all four columns are counted, not listed, and
    whether an earlier turn has the same role and text is a mark that joins by
    the whole key; so no group of equal messages is ever sent whole.
    """
    ship_package(chats.sparkSession)
    rows = chats.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    rows = rows.withColumn("h", F.unhex(F.sha2("text", 256)))
    first = (rows.groupBy("conv_id", "role", "h")
             .agg(F.min(F.struct(F.col("turn").isNotNull().alias("some"), "turn")).alias("t"))
             .select("conv_id", F.col("t.turn").alias("turn"), "role", "h", F.lit(None).cast("string").alias("text"),
                     F.lit(0).alias("n"), F.lit(True).alias("first")))
    each = rows.select("conv_id", "turn", "role", "h", "text", F.lit(1).alias("n"), F.lit(False).alias("first"))
    marked = (each.unionByName(first).groupBy("conv_id", "turn", "role", "h")
              .agg(F.max("text").alias("text"), F.sum("n").alias("n"), F.max("first").alias("first")))
    marked = marked.withColumn("blank", ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "role", "h"]
    return checkpointed(
        marked.select(
            "conv_id", "turn", "role", "text", "n", "blank", (~F.col("blank") & ~F.col("first")).alias("repeated"),
            (~F.col("blank") & ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"), "h")
        .repartitionByRange(*keys).sortWithinPartitions(*keys).drop("h"))


class _Run:
    """The messages of one conversation in one partition: counts, and what the lattice needs."""

    def __init__(self, conv, first: bool):
        self.conv, self.first = conv, first
        self.rows, self.lattice, self.forced = [], [], [0]

    def add(self, turn, role, n, blank, repeated, open_, text=None):
        self.rows.append((turn, role, n, blank, repeated, open_, text))
        if blank or repeated:
            self.forced[-1] += n  # messages to drop before the next one that may stay
        else:
            self.lattice.append((role[:1], open_))
            self.forced.append(n - 1)

    def facts(self, audit_cost: int) -> dict:
        turns = {r[0] for r in self.rows if r[0] is not None}
        marks = [r[1][:1] for r in self.rows]
        pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(marks, marks[1:]))
        pairs += sum(n - 1 for _, _, n, *_ in self.rows)  # a repeated message follows itself
        return {"n_rows": sum(r[2] for r in self.rows), "n_turns": len(turns),
                "blank": sum(r[2] for r in self.rows if r[3]),
                "duplicate": sum(r[2] - (not r[4]) for r in self.rows if not r[3]),
                "truncated": sum(r[5] and not r[4] for r in self.rows), "illegal": pairs,
                "cost": audit_cost + DELETE * sum(self.forced),
                "first_turn": min(turns, default=None), "last_turn": max(turns, default=None),
                "first_initial": marks[0], "last_initial": marks[-1]}

    def edits(self, audit: str, state: int):
        """(letter, role, text) of every edit in order, those of dropped messages without role and text."""
        stay = [r for r in self.rows if not (r[3] or r[4])]
        yield from (("D", None, None) for _ in range(self.forced[0]))
        at = 0
        for letter in audit:
            row = stay[at] if at < len(stay) else None
            if letter == "I":
                state = NEXT[state]
                yield "I", NAMES[state], ""
                continue
            if letter == "D":
                yield "D", None, None
            elif letter == "K":
                state = SYSTEM if row[1][:1] == "s" else NEXT[state]
                yield "K", row[1], row[6]
            else:
                state = NEXT[state]
                yield "R", NAMES[state], row[6]
            at += 1
            yield from (("D", None, None) for _ in range(self.forced[at]))


_COLUMNS = ["turn", "role", "n", "blank", "repeated", "open"]


def _runs(batches, columns):
    """The partition's runs in order, each when its last message has been read; then None."""
    run = None
    for batch in batches:
        ids = batch.column(batch.schema.get_field_index("conv_id")).to_pylist()
        values = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in columns]
        for conv, *row in zip(ids, *values, strict=True):
            if run is None or run.conv != conv:
                if run is not None:
                    yield run
                run = _Run(conv, run is None)
            run.add(*row)
    if run is not None:
        yield run


def repair_structure(chats: DataFrame) -> DataFrame:
    """Cheapest legal repair of every conversation that has messages; one row per piece of a conversation.

    Messages are taken by turn (nulls first; equal turns by role, then by a
    hash of the text). Faults: blank, duplicate (role and text seen before),
    truncated (no end mark). Edits: keep, rerole to user or assistant, delete,
    insert an empty turn; the roles' initials must read ``(s?(ua)+)?``, and of
    the cheapest edit sequences the ASCII-least is taken.

    Columns: conv_id, piece (order), whole (the conversation's only piece),
    counts (n_rows, n_turns, blank, duplicate, truncated, illegal, cost), the
    piece's border turns and initials, audit (the edits' initials) and
    repaired (``role:text`` of the repaired turns, joined by line breaks; null
    where none stays). A conversation's audit and text are its pieces' in
    order; ``conversation_report`` puts them together.

    The messages are range-partitioned by conversation and turn, so one with a
    third of all rows is spread over many tasks. A partition's first and last
    conversations may go on elsewhere: each run of messages is summed up as
    the costs and the audit ranks between its 4 entry and 4 exit states, two
    rows a partition, from which the driver takes the states at the borders.
    A task holds one conversation's part of its partition.

    Defined cases: a null role or text is one space; null conv_ids are one
    conversation; roles other than s…, u… and a… can't be kept; repeated rows
    are duplicates; an empty table gives an empty result; extra columns are
    ignored.
    """
    spark = chats.sparkSession
    table = _flagged(chats)

    def borders(batches):
        part = TaskContext.get().partitionId()
        held = []
        for run in _runs(batches, _COLUMNS):
            if len(held) == 2:
                held.pop()
            held.append(run)
        rows = [(part, r.conv, *summary(tuple(r.lattice))) for r in held]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
             pa.array([r[2] for r in rows], pa.list_(pa.int64())), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
            names=["part", "conv_id", "costs", "ranks"])

    edge = (table.select("conv_id", *_COLUMNS)
            .mapInArrow(borders, "part long, conv_id long, costs array<long>, ranks array<long>").collect())  # two a partition
    by_conv: dict = {}
    for r in sorted(edge, key=lambda r: r.part):
        by_conv.setdefault(r.conv_id, []).append((r.part, r.costs, r.ranks))
    known = {}
    for conv, runs in by_conv.items():
        if len(runs) > 1:
            states = plan(runs)
            for k, (part, _, _) in enumerate(runs):
                known[(part, conv)] = (*states[part], k == len(runs) - 1)
    held = spark.sparkContext.broadcast(known)

    def write(batches):
        part = TaskContext.get().partitionId()
        out: list[dict] = []
        size = number = 0
        for run in _runs(batches, [*_COLUMNS, "text"]):
            border = held.value.get((part, run.conv))
            entry, leave, last = border or (START, None, True)
            cost, audit = cheapest(tuple(run.lattice), entry, leave)
            if border and last:  # the last run of a divided conversation closes it
                cost += END[leave]
                audit += "I" * CLOSING[leave]
            rows = [{"facts": run.facts(cost), "audit": [], "turns": []}]
            chars = 0
            for letter, role, text in run.edits(audit, entry):
                rows[-1]["audit"].append(letter)
                if role is not None:
                    rows[-1]["turns"].append(f"{role}:{text}")
                    chars += len(text) + len(role) + 2
                if chars > PIECE_CHARS:
                    rows.append({"facts": {}, "audit": [], "turns": []})
                    size, chars = size + chars, 0
            for piece in rows:
                number += 1
                out.append({"conv_id": run.conv, "piece": (part << 32) + number,
                            "whole": border is None and len(rows) == 1,
                            **{c: piece["facts"].get(c, 0) for c in _FACTS},
                            **{c: piece["facts"].get(c) for c in _EDGES}, "audit": "".join(piece["audit"]),
                            "repaired": "\n".join(piece["turns"]) if piece["turns"] else None})
            size += chars
            if size > 4 * PIECE_CHARS or len(out) > 5000:
                yield _batch(out)
                out, size = [], 0
        yield _batch(out)

    return table.mapInArrow(write, PIECES)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    text = {"first_initial", "last_initial", "audit", "repaired"}
    fields = [c.split()[0] for c in PIECES.split(", ")]
    kinds = [pa.string() if c in text else pa.bool_() if c == "whole" else pa.int64() for c in fields]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(fields, kinds, strict=True)],
                                      names=fields)


_REPORT = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")


def conversation_report(pieces: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for every conv_id of ``conversations``, from the pieces of its repair.

    The text of a conversation in one piece is digested where it is; only
    divided conversations send theirs, in pieces of about a megabyte. A
    digest needs the whole text in order, so one task streams a conversation's
    pieces through it and holds one batch. Missing turns (``gaps``) are counted
    between the least and the largest turn.
    """
    names = [c.split()[0] for c in PIECES.split(", ")]
    kept = pieces.withColumn("sha", F.when(F.col("whole"), F.sha2(F.coalesce("repaired", F.lit("")), 256))).withColumn(
        "repaired", F.when(~F.col("whole"), F.col("repaired")))
    none = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    rows = kept.unionByName(none, allowMissingColumns=True)
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("piece").asc_nulls_first())
    sums = ["blank", "duplicate", "truncated", "illegal", "cost"]

    def combine(batches):
        out: list = []
        now = None
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now["conv"] != r["conv_id"]:
                    if now is not None:
                        out.append(_finish(now, sums))
                    now = {"conv": r["conv_id"], "audit": [], "sha": None, "digest": None, "turns": 0, "low": None,
                           "high": None, "mark": None, **dict.fromkeys(sums, 0)}
                if r["piece"] is not None:
                    _join(now, r, sums)
            if out:
                yield _report(out)
                out = []
        if now is not None:
            yield _report([_finish(now, sums)])

    return rows.select(*names, "sha").mapInArrow(combine, _REPORT)


def _join(now: dict, r: dict, sums: list[str]) -> None:
    """Add a piece to its conversation's row."""
    for c in sums:
        now[c] += r[c]
    now["audit"].append(r["audit"])
    if r["first_initial"] is not None:
        if now["mark"] is not None:
            now["illegal"] += now["mark"] + r["first_initial"] not in ("su", "ua", "au")
        now["mark"] = r["last_initial"]
    if r["first_turn"] is not None:
        # turns come in order, so only the border turn can be counted twice
        now["turns"] += r["n_turns"] - (now["high"] == r["first_turn"])
        now["low"] = r["first_turn"] if now["low"] is None else now["low"]
        now["high"] = r["last_turn"]
    if r["sha"] is not None:
        now["sha"] = r["sha"]
    elif r["repaired"] is not None:
        if now["digest"] is None:
            now["digest"] = hashlib.sha256()
        else:
            now["digest"].update(b"\n")
        now["digest"].update(r["repaired"].encode())


def _finish(now: dict, sums: list[str]) -> tuple:
    gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
    sha = now["sha"] or (now["digest"] or hashlib.sha256()).hexdigest()
    return (now["conv"], gaps, *(now[c] for c in sums), "".join(now["audit"]), sha)


def _report(rows: list[tuple]) -> pa.RecordBatch:
    fields = [c.split()[0] for c in _REPORT.split(", ")]
    kinds = [pa.string() if c in ("audit", "repaired_sha256") else pa.int64() for c in fields]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=fields)


def damage(chats: DataFrame) -> DataFrame:
    """Messages with planted faults, by crc32 of ``conv_id:turn`` modulo 20; nulls are one space.

    0 drops the message, 1 empties its text, 2 takes out its ``.!?``, 3 repeats
    it, 4 makes its role ``user``.
    """
    def text(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = chats.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    rows = rows.where("kind != 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")
