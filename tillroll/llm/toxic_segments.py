"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme-value statistics."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillroll.llm.common import cut_lineage, plain_names, ship_package, text_slices

#: Bound of the sample that the model is fitted on: labelled rows, in the order of a hash of their doc_id.
FIT_ROWS = 30_000
#: Strength of the Dirichlet prior, in tokens, shaped like the sample's background, and its least share of a token.
PRIOR_TOKENS = 5_000.0
FLOOR = 0.25
#: A passage is significant when fewer than this many are expected by chance in a clean text of the length.
MAX_EXPECTED = 0.05
_TRIM = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()) + "¡¿«»“”‘’…–—"


def is_held_out(doc_id) -> F.Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def token_codes(texts: pa.Array):
    """(codes, vocabulary, offsets): white-space tokens, lower-cased, without surrounding punctuation."""
    split = pc.ascii_split_whitespace(texts)
    bounds = np.asarray(split.offsets).astype(np.int64)
    enc = split.flatten().dictionary_encode()
    vocabulary = pc.utf8_trim(pc.utf8_lower(enc.dictionary), characters=_TRIM)
    return np.asarray(enc.indices), vocabulary, bounds - bounds[0]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), left to right, in linear time.

    Only positive scores open a segment; each open segment remembers the
    nearest one to its left whose prefix sum is lower, so the search for the
    segment to join skips all others.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    found: list[list] = []  # start, end, sum before, sum after, place of the nearest lower one
    for p in np.flatnonzero(scores > 0).tolist():
        start, before, after = p, float(sums[p]), float(sums[p + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= after:
                break
            start, before = found[j][0], found[j][2]
            del found[j:]
        found.append([start, p + 1, before, after, j])
    return [(s, e, b - a) for s, e, a, b, _ in found]


@dataclass
class ToxicModel:
    """Token weights, the weight of every other token, and the calibration."""

    tokens: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    other: float = -0.05
    rate: float = 1.0       # lambda of the extreme-value law
    scale: float = 0.1      # K of the extreme-value law
    intercept: float = -2.0
    slope: float = 0.0
    extra: float = 0.0

    def evidence(self, top, n):
        """-ln of the number of segments this good expected in a clean text of n tokens; 0 without one."""
        top = np.asarray(top, dtype=float)
        found = self.rate * top - np.log(self.scale * np.maximum(n, 1))
        return np.where(top > 0, np.maximum(found, 0.0), 0.0)

    def probability(self, top, n, passages):
        x = self.intercept + self.slope * self.evidence(top, n) + self.extra * np.log1p(passages)
        return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))

    def scan(self, texts: pa.Array):
        """For each text: best segment score, tokens, significant passages as (start, end, score) of words."""
        codes, vocabulary, bounds = token_codes(texts)
        table = pa.array(self.tokens, pa.string())
        at = pc.index_in(vocabulary, value_set=table)
        # pieces without a letter or digit count for nothing
        own = np.append(np.asarray(self.weights, dtype=float), self.other)[
            np.asarray(at.fill_null(len(self.tokens)))]
        own[np.asarray(pc.equal(vocabulary, ""))] = 0.0
        scores = own[codes] if len(codes) else np.zeros(0)
        n = len(texts)
        top, spans = np.zeros(n), [[] for _ in range(n)]
        hits = np.unique(np.searchsorted(bounds, np.flatnonzero(scores > 0), side="right") - 1)
        sizes = np.diff(bounds)
        for i in hits.tolist():
            found = maximal_segments(scores[bounds[i]:bounds[i + 1]])
            top[i] = max(s for _, _, s in found)
            best = self.evidence([s for _, _, s in found], sizes[i])
            spans[i] = [f for f, e in zip(found, best.tolist(), strict=True) if e > -np.log(MAX_EXPECTED)]
        return top, sizes, spans


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS,
        prior: float = PRIOR_TOKENS) -> ToxicModel:
    """Learn weights and calibration from at most ``fit_rows`` labelled rows that aren't held out.

    Copies of one text count once, so a large group of copies doesn't make its
    rare words evidence. Token counts are grouped by Spark; only tokens whose
    counts stand out beyond what the vocabulary's size explains (z above
    sqrt(2 ln V)) come to the driver; the sample's rows bound their number.
    """
    ship_package(docs.sparkSession)
    usable = (labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
              .where(~is_held_out("doc_id"))
              .select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") == 1).cast("int").alias("toxic")))
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(fit_rows)
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .where("text is not null")
            .join(F.broadcast(cut_lineage(sample)), "doc_id"))  # at most fit_rows ids
    texts = cut_lineage(rows.groupBy(F.sha2("text", 256).alias("key"))
                        .agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))
                        .select("text", "toxic"))

    def count(batches):
        for batch in batches:
            for part in text_slices(batch):
                codes, vocabulary, bounds = token_codes(part.column(0))
                size = len(vocabulary)
                # a token counts once per text, so one text's repetitions are no evidence
                seen = np.unique(np.repeat(np.arange(part.num_rows), np.diff(bounds)) * max(1, size) + codes)
                toxic = part.column(1).to_numpy()[seen // max(1, size)]
                yes = np.bincount(seen % max(1, size), weights=toxic, minlength=size).astype(np.int64)
                both = np.bincount(seen % max(1, size), minlength=size).astype(np.int64)
                yield pa.RecordBatch.from_arrays([vocabulary, pa.array(yes), pa.array(both - yes)],
                                                 names=["token", "yes", "no"])

    counts = cut_lineage(texts.mapInArrow(count, "token string, yes long, no long").where("token <> ''")
                         .groupBy("token").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")))
    size, n1, n0 = counts.agg(F.count(F.lit(1)), F.sum("yes"), F.sum("no")).first()
    model = ToxicModel()
    if not size or not n1 or not n0:
        return model  # nothing of one class to learn from: every text gets the prior's score
    a = F.lit(prior / (n1 + n0)) * (F.col("yes") + F.col("no")) + FLOOR
    y1, y0 = F.col("yes") + a, F.col("no") + a
    odds = F.log(y1 / (n1 + prior - y1)) - F.log(y0 / (n0 + prior - y0))
    share = n1 / (n1 + n0)
    both = F.col("yes") + F.col("no")
    # signed root of the likelihood ratio of the token's counts against the classes' shares
    part = lambda k, p: F.when(F.col(k) > 0, F.col(k) * F.log(F.col(k) / (both * p))).otherwise(0.0)
    root = F.sqrt(F.greatest(F.lit(0.0), 2 * (part("yes", share) + part("no", 1 - share))))
    z = F.when(F.col("yes") > both * share, root).otherwise(-root)
    bar = float(np.sqrt(2 * np.log(max(size, 2))))
    chosen = (counts.select("token", "yes", "no", odds.alias("w"), z.alias("z"))
              .where((F.col("z") > bar) & (F.col("w") > 0)).orderBy(F.desc("z"), "token").collect())
    model.tokens = [r.token for r in chosen]
    model.weights = [float(r.w) for r in chosen]
    yes, no = sum(r.yes for r in chosen), sum(r.no for r in chosen)
    model.other = min(-0.01, float(np.log((n1 - yes + 1) / (n1 + 1)) - np.log((n0 - no + 1) / (n0 + 1))))
    model.rate = _rate(np.array(model.weights), np.array([r.no for r in chosen], dtype=float), model.other, float(n0))

    held = texts.sparkSession.sparkContext.broadcast(model)

    def best(batches):
        for batch in batches:
            for part in text_slices(batch):
                top, sizes, _ = held.value.scan(part.column(0))
                yield pa.RecordBatch.from_arrays([pa.array(top), pa.array(sizes.astype(np.int64)), part.column(1)],
                                                 names=["top", "n", "toxic"])

    seen = texts.mapInArrow(best, "top double, n long, toxic int").toPandas()  # at most fit_rows rows
    top, n, y = (seen[c].to_numpy() for c in ("top", "n", "toxic"))
    clean = (y == 0) & (top > 0)
    if clean.any():  # ln K by the mean of rate * top - ln n over clean texts, the rest having none at all
        share = clean.sum() / max(1, (y == 0).sum())
        model.scale = float(np.clip(share * np.exp(np.mean(model.rate * top[clean] - np.log(np.maximum(n[clean], 1)))
                                                   - np.euler_gamma), 1e-6, 10.0))
    else:
        model.scale = 1.0 / max(1.0, float(n[y == 0].sum()))
    passages = (model.evidence(top, n) > -np.log(MAX_EXPECTED)).astype(float)
    x = np.column_stack([np.ones(len(y)), model.evidence(top, n), np.log1p(passages)])
    fitted = np.zeros(3)
    used = [0, 1, 2]
    while True:  # more evidence never lowers a score: a feature with a negative slope is left out
        fitted[:] = 0
        fitted[used] = _logistic(x[:, used], y.astype(float))
        if (fitted[1:] >= 0).all():
            break
        used.remove(1 + int(fitted[1:].argmin()))
    model.intercept, model.slope, model.extra = map(float, fitted)
    return model


def _rate(weights: np.ndarray, clean: np.ndarray, other: float, total: float) -> float:
    """The positive root of sum p e^(rate * score) = 1 over the clean token distribution."""
    if not len(weights):
        return 1.0
    p = (clean + 0.5) / (total + 0.5 * len(weights))
    rest = max(1e-9, 1 - p.sum())
    lo, hi = 1e-6, 1.0

    def over(x):
        return float((p * np.exp(np.minimum(x * weights, 500))).sum() + rest * np.exp(x * other)) > 1

    while not over(hi) and hi < 1e3:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if over(mid) else (mid, hi)
    return hi


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, ...]:
    """Ridge logistic regression by Newton steps."""
    center, spread = x[:, 1:].mean(0), x[:, 1:].std(0) + 1e-9
    z = np.column_stack([x[:, 0], (x[:, 1:] - center) / spread])
    w = np.zeros(z.shape[1])
    damp = np.full(z.shape[1], ridge)
    damp[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(damp), z.T @ (y - p) - damp * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[1:] / spread
    return (float(w[0] - (slopes * center).sum()), *map(float, slopes))


def score_documents(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """All rows and columns of ``docs`` plus ``tox_score double, tox_passages array<struct>``.

    Whole texts are scanned in their task; nothing is shuffled. Passages are
    the significant maximal segments, as word ranges with their scores. Null
    and empty texts have no passage and the score of an empty text; repeated
    rows are scored each; an empty table stays empty. Columns that are called
    like the two added ones are replaced by them.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("tox_score", "tox_passages")])
    names = docs.columns
    return _scored(plain_names(docs), model).toDF(*names, "tox_score", "tox_passages")


def _scored(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``docs`` under plain names, plus the two columns."""
    ship_package(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def scan(batches):
        for batch in batches:
            for part in text_slices(batch):
                col = part.column(part.schema.get_field_index("text"))
                top, sizes, spans = held.value.scan(col.fill_null("") if col.null_count else col)
                p = held.value.probability(top, sizes, np.array([float(bool(s)) for s in spans]))
                added = [pa.array(p), pa.array([[{"start": a, "end": b, "score": c} for a, b, c in s] for s in spans],
                                               span)]
                yield pa.RecordBatch.from_arrays([*part.columns, *added],
                                                 names=[*part.schema.names, "tox_score", "tox_passages"])

    from pyspark.sql.types import StructType
    schema = StructType.fromDDL("tox_score double, tox_passages array<struct<start:int,end:int,score:double>>")
    typed = docs.withColumn("text", F.col("text").cast("string"))
    return typed.mapInArrow(scan, StructType([*typed.schema.fields, *schema.fields]))


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't judged toxic, with its columns, whatever they are called."""
    scored = _scored(plain_names(docs), fit(docs, labels)).where("tox_score < 0.5")
    return scored.drop("tox_score", "tox_passages").toDF(*docs.columns)
