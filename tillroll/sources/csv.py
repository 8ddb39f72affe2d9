"""Retail CSV scan with encoding and separator detection, split by byte ranges whatever the cells hold.

The separator is the first that gives the header at least three columns; the
encoding is UTF-8 if every byte decodes, else Latin-1. Rows with more fields
than the header are dropped; short rows keep nulls; the usual missing-value
tokens read as null.

A quoted cell may hold line breaks, so whether a line starts a record depends
on all lines before it. But of a whole byte range only two things matter: where
it ends up when it begins inside a quoted cell, and when it begins outside.
One pass computes that for every range (and counts undecodable lines, for the
encoding); chained from range to range it tells how each one begins, and a
second pass cuts all ranges into records side by side. Only the pieces of
records that cross a border (two a range) are put together afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.functions.schema import NA_TOKENS

# Candidate encodings and separators, in trial order. Latin-1
# decodes any byte, so later single-byte code pages would never be reached.
ENCODINGS = ["utf-8", "iso-8859-1"]
SEPARATORS = [",", ";", "\t", "|"]
MIN_COLUMNS = 3
EXTRA = "_extra_field"
NULL_SENTINEL = "\u0000"
REPLACEMENT_CHAR = "�"
#: Encodings in which line breaks, quotes and separators are the ASCII bytes; others are read a file at a time.
SPLITTABLE = {"utf-8", "us-ascii", "iso-8859-1"}
#: Physical lines that the header record may take.
HEADER_LINES = 100


def _reader(spark: SparkSession, sep: str, encoding: str, multiline: bool):
    # doubled quotes stand for one quote, and a backslash is an ordinary character; a null
    # sentinel that never occurs keeps empty cells as "" until the NA mapping
    return (spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
            .option("quote", '"').option("escape", '"').option("multiLine", multiline)
            .option("mode", "PERMISSIVE").option("nullValue", NULL_SENTINEL).option("emptyValue", ""))


def _header(spark: SparkSession, path: str, sep: str, encoding: str, multiline: bool) -> list[str]:
    # header-only schema: reads the first record, no inference pass
    return _reader(spark, sep, encoding, multiline).option("inferSchema", False).csv(path).columns


def _read(spark: SparkSession, path: str, cols: list[str], sep: str, encoding: str, multiline: bool) -> DataFrame:
    # one spare column catches rows with more fields than the header
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(cols))]
                          + [T.StructField(EXTRA, T.StringType())])
    df = _reader(spark, sep, encoding, multiline).schema(schema).csv(path)
    return _named(df, cols)


def _named(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows without surplus fields, under the header's names, missing-value tokens as null."""
    kept = df.filter(F.col(EXTRA).isNull())
    na = [F.when(F.col(f"_c{i}").isin(NA_TOKENS), F.lit(None)).otherwise(F.col(f"_c{i}"))
          .alias(c.strip() if c else f"Unnamed: {i}") for i, c in enumerate(cols)]
    return kept.select(*na)


def leaves_inside(line: bytes, sep: bytes, inside: bool) -> bool:
    """Whether a quoted cell is open behind ``line``, given whether one is before it.

    A quote opens a cell at its start only; inside, two quotes stand for one
    and a single one closes the cell.
    """
    at, opener = 0, sep + b'"' if len(sep) == 1 else None  # cells that don't begin with a quote are passed over together
    while True:
        if inside:
            at = line.find(b'"', at)
            if at < 0:
                return True
            if line[at + 1:at + 2] == b'"':
                at += 2
                continue
            inside = False
        elif line[at:at + 1] == b'"':
            inside = True
            at += 1
            continue
        at = line.find(opener or sep, at)
        if at < 0:
            return False
        at += len(sep)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value, valid) of all physical lines as bytes; ``start`` is that of the line's byte range."""
    text = spark.read.option("lineSep", "\n").text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                       F.col("value").cast("binary").alias("value"), F.is_valid_utf8("value").alias("valid"))


def _runs(batch):
    """(file, start, line values, which of them hold a quote, first, behind) of each byte range's lines in a batch.

    Compared as columns: no Python value is made for a line's file and start, nor for lines that aren't looked at.
    """
    import numpy as np
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    new = [pc.not_equal(batch.column(i).slice(1), batch.column(i).slice(0, n - 1)) for i in (0, 1)]
    edges = [0, *(np.flatnonzero(pc.or_(*new).to_numpy(zero_copy_only=False)) + 1).tolist(), n]
    quoted = pc.match_substring(batch.column(2), '"')
    for lo, hi in zip(edges, edges[1:], strict=False):
        yield (batch.column(0)[lo].as_py(), batch.column(1)[lo].as_py(), batch.column(2).slice(lo, hi - lo),
               quoted.slice(lo, hi - lo), lo, hi)


def _range_facts(lines: DataFrame, sep: str) -> list:
    """One row a byte range, in order: state behind it from either state, whether it closes an open cell, undecodable lines."""
    mark = sep.encode()

    def scan(batches):
        import pyarrow as pa
        now: dict = {}
        for batch in batches:
            for file, start, values, quoted, lo, hi in _runs(batch):
                f = now.setdefault((file, start), [False, True, False, 0, 0])
                f[3] += hi - lo - batch.column(3).slice(lo, hi - lo).true_count
                f[4] += hi - lo
                out, inside, closes = f[:3]
                for value in values.filter(quoted).to_pylist():  # other lines leave the state as it is
                    same = out == inside
                    out = leaves_inside(value, mark, out)
                    inside = out if same else leaves_inside(value, mark, inside)
                    closes = closes or not inside
                f[:3] = out, inside, closes
        rows = [(*k, *v) for k, v in now.items()]
        kinds = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                         names=["file", "start", "out", "inside", "closes", "bad", "n"])

    found = lines.mapInArrow(scan, "file string, start long, out boolean, inside boolean, closes boolean, bad long, n long")
    return sorted(found.collect(), key=lambda r: (r.file, r.start))  # one row a byte range


def _entries(facts: list) -> dict:
    """{(file, start): the range where the cell that is open at its beginning started its record, or None}."""
    out, file, open_from = {}, None, None
    for r in facts:
        if r.file != file:
            file, open_from = r.file, None
        out[r.file, r.start] = open_from
        if open_from is None:
            open_from = r.start if r.out else None
        elif not r.inside:
            open_from = None
        elif r.closes:
            open_from = r.start
    return out


def _records(lines: DataFrame, sep: str, entries: dict) -> DataFrame:
    """(file, origin, at, record, head): whole records (only the record), without headers, and pieces of those that cross ranges.

    ``head`` marks the first piece of a header that crosses ranges.
    """
    held, mark = lines.sparkSession.sparkContext.broadcast(entries), sep.encode()

    def cut(batches):
        import pyarrow as pa
        now, state = None, {}

        def emit(rows, origin, parts, file, start):
            whole = parts[0] if len(parts) == 1 else b"\n".join(parts)
            head = origin == start == 0 and state["header"]
            if origin is None:
                if state["header"]:
                    state["header"] = False
                    return
                whole = whole[:-1] if whole.endswith(b"\r") else whole
                if not whole.strip():
                    return
                file = start = None  # only pieces are put together by their place
            rows.append((file, origin, start, whole, head))

        def finish(rows):
            if now is not None and state["parts"]:  # open at the range's end: its record goes on in the next
                origin = state["origin"] if state["origin"] is not None else now[1]
                emit(rows, origin if state["inside"] else state["origin"], state["parts"], *now)

        def pack(rows):
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                              names=["file", "origin", "at", "record", "head"])

        for batch in batches:
            rows: list = []
            for file, start, values, quoted, _, _ in _runs(batch):
                if now != (file, start):
                    finish(rows)
                    now = (file, start)
                    origin = held.value[now]
                    state = {"inside": origin is not None, "origin": origin, "parts": [], "header": start == 0}
                for value, quote in zip(values.to_pylist(), quoted.to_pylist(), strict=True):
                    if not quote and not state["inside"]:  # a record on its own
                        emit(rows, None, [value], file, start)
                        continue
                    state["parts"].append(value)
                    if quote:
                        state["inside"] = leaves_inside(value, mark, state["inside"])
                    if not state["inside"]:
                        emit(rows, state["origin"], state["parts"], file, start)
                        state["parts"], state["origin"] = [], None
            yield pack(rows)
        rows = []
        finish(rows)
        yield pack(rows)

    return lines.select("file", "start", "value").mapInArrow(cut, "file string, origin long, at long, record binary, head boolean")


def _split_scan(spark: SparkSession, path: str, cols: list[str], sep: str, lines: DataFrame, facts: list,
                charset: str, drop_bad: bool) -> DataFrame:
    """The file's rows by records that are cut range by range."""
    entries = _entries(facts)
    records = _records(lines, sep, entries)
    whole = records.where("origin is null").select("record")
    if any(v is not None for v in entries.values()):
        pieces = records.where("origin is not null").groupBy("file", "origin").agg(
            F.sort_array(F.collect_list(F.struct("at", "record"))).alias("p"), F.bool_or("head").alias("head"))
        joined = F.aggregate(F.slice("p", 2, 1 << 30), F.col("p")[0]["record"],
                             lambda a, x: F.concat(a, F.lit(b"\n"), x["record"]))
        whole = whole.unionAll(pieces.where("not head").select(joined.alias("record")))
    text = F.col("record").cast("string") if charset == "utf-8" else F.decode("record", charset)
    if drop_bad:
        text = F.regexp_replace(F.make_valid_utf8(F.col("record").cast("string")), REPLACEMENT_CHAR, "")
    names = [f"_c{i}" for i in range(len(cols))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, EXTRA]])
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "nullValue": NULL_SENTINEL,
               "emptyValue": "", "maxCharsPerColumn": "-1"}
    ddl = schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    # a generator: the filter on surplus fields stays above it, instead of parsing every record a second time
    rows = whole.select(F.inline(F.array(F.from_csv(text, F.lit(ddl), options))))
    return _named(rows, cols)


def _header_record(spark: SparkSession, path: str, seps: list[str], decode: str) -> tuple[list[str], str] | None:
    """(columns, separator): the first separator that gives the first record at least ``MIN_COLUMNS`` fields."""
    import csv

    first = [bytes(r.value) for r in _lines(spark, path).where("start = 0").select("value").take(HEADER_LINES)]
    for s in seps:
        inside, n = False, 0
        for line in first:
            inside, n = leaves_inside(line, s.encode(), inside), n + 1
            if not inside:
                break
        text = b"\n".join(first[:n]).removeprefix(b"\xef\xbb\xbf").removesuffix(b"\r").decode(decode, "replace")
        fields = next(csv.reader([text], delimiter=s, strict=False), []) if "\n" not in text else next(
            csv.reader(text.splitlines(keepends=True), delimiter=s), [])
        if len(fields) >= MIN_COLUMNS:
            return fields, s
    return None


def read_retail_csv(spark: SparkSession, path: str, sep: str | None = None,
                    encoding: str | None = None, row_cap: int | None = None,
                    multiline: bool = True) -> DataFrame:
    """All-string DataFrame of a retail CSV (headers as written).

    ``sep`` / ``encoding`` pin a candidate; ``row_cap`` keeps only the first
    rows (off by default). Quoted cells may hold separators, doubled quotes and
    line breaks, and large files are split all the same (see the module's
    text); ``multiline=False`` spares the passes for that if no cell has a line
    break. Falls back to a UTF-8 comma read with undecodable bytes removed when
    no candidate qualifies. In an encoding whose line breaks and quotes aren't
    the ASCII bytes, a file is read by one task.
    """
    if encoding and encoding.lower() not in SPLITTABLE or not multiline:
        out = _whole_file_scan(spark, path, sep, encoding, multiline)
        return out.limit(row_cap) if row_cap else out
    lines = _lines(spark, path)
    found = _header_record(spark, path, [sep] if sep else SEPARATORS, encoding or "utf-8")
    facts = _range_facts(lines, found[1] if found else ",")
    bad = sum(r.bad for r in facts)
    if found and sum(r.n for r in facts) > len({r.file for r in facts}):
        charset = encoding or (ENCODINGS[0] if not bad else ENCODINGS[1])
        cols, s = _header_record(spark, path, [found[1]], charset)
        out = _split_scan(spark, path, cols, s, lines, facts, charset.lower(), False)
    else:
        cols = _header(spark, path, ",", "utf-8", multiline)
        out = _split_scan(spark, path, [c.replace(REPLACEMENT_CHAR, "") for c in cols], ",", lines,
                          facts if not found else _range_facts(lines, ","), "utf-8", True)
    return out.limit(row_cap) if row_cap else out


def _whole_file_scan(spark: SparkSession, path: str, sep: str | None, encoding: str | None, multiline: bool) -> DataFrame:
    """Spark's own reader: by lines (``multiline`` off), or a file a task."""
    bad = F.count_if(~F.is_valid_utf8("value")).alias("bad")
    charset = encoding or (ENCODINGS[1] if spark.read.text(path).agg(bad).first()["bad"] else ENCODINGS[0])
    for s in [sep] if sep else SEPARATORS:
        cols = _header(spark, path, s, charset, multiline)
        if len(cols) >= MIN_COLUMNS:
            return _read(spark, path, cols, s, charset, multiline)
    cols = _header(spark, path, ",", "utf-8", multiline)
    df = _read(spark, path, cols, ",", "utf-8", multiline)
    return df.select(*[F.regexp_replace(F.col(f"`{c}`"), REPLACEMENT_CHAR, "").alias(c) for c in df.columns])


def load_or_default(load, default: DataFrame, fallback: bool = False) -> DataFrame:
    """Run ``load()``; on failure return ``default`` when ``fallback`` is on,
    else re-raise (bad input is not silently replaced by default)."""
    try:
        return load()
    except Exception:
        if fallback:
            return default
        raise
