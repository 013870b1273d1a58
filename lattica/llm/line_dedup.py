"""Line dedup by winnowing over line hashes.

Lines are split at U+000A and compared without white space around them; lines without words
(words: what lies between ASCII white space) are skipped over. A window is a shortest run of
lines, from a line onward or up to a line, with MIN_WORDS words. Its minimum, the line with the
least hash (the first of several), is a fingerprint. Every run of that many words which two
places share holds a whole window, so both places select the same fingerprint: the guarantee
of winnowing, with windows measured in words.

Only the selected minima leave a document at first. Positions of fingerprints that stand at
one place only are done with; documents with others are joined with those positions, and each
is extended to both sides, line by line, until the windows it is the minimum of are covered. Windows of equal lines
(two independent 64-bit hashes of the lines; by chance, 1e12 windows hold one wrong pair with
probability 2e-15) are matches of a later place with the first one. Matches that continue one
another on one diagonal join to maximal runs. Every line of a later run goes; the first place
stays. The lines removed are exactly those in a run of MIN_WORDS words that also stands at an
earlier place, in this document or another, and the lines without words between two that go.

Places are ordered by doc_id (nulls first), then a hash of the text, then line. Repeated rows
(same doc_id, same text) are one document: each gets that document's result. Null texts are
empty, and empty texts have no lines to remove. No group is gathered: first places come from
aggregates with partial results, and a document's own windows are as many as its lines, so
memory grows with the longest text of a task only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lattica.llm.common import SPACED, checkpointed, chunks, map_texts, mix64, names_clash, span_hashes, words_of, written

MIN_WORDS = 50

_U = np.uint64
_STEP = 0x9E3779B97F4A7C15


def _range_least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Place of the least value in each values[low:high + 1]; the first if several are."""
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((np.arange(len(values)), values))] = np.arange(len(values))
    place = np.empty(len(values), np.int64)
    place[rank] = np.arange(len(values))
    level = [rank]
    while (width := 1 << len(level)) <= (high - low).max(initial=0) + 1:
        last = level[-1]
        level.append(np.minimum(last[: len(last) - width // 2], last[width // 2 :]))
    size = np.frexp((high - low + 1).astype(np.float64))[1] - 1
    out = np.empty(len(low), np.int64)
    for k in np.unique(size).tolist():
        own = size == k
        out[own] = np.minimum(level[k][low[own]], level[k][high[own] - (1 << k) + 1])
    return place[out]


#: A line with words: its number in the text, its words and its two hashes.
LINE = np.dtype([("number", "<i4"), ("words", "<i4"), ("a", "<u8"), ("b", "<u8")])


def lines_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' lines with words, and each text's first one."""
    words = words_of(texts, SPACED)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    base = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
    opening = np.searchsorted(starts, base)
    number = np.arange(len(starts)) - np.repeat(opening[:-1], np.diff(opening))
    low, high = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    some = np.flatnonzero(high > low)
    low, high = low[some], high[some]
    out = np.empty(len(some), LINE)
    out["number"], out["words"] = number[some], high - low
    for kind, name in enumerate("ab"):
        out[name] = span_hashes(data, words.starts[low], words.ends[high - 1], kind) if len(some) else 0
    return out, np.searchsorted(some, opening)


def windows_in(lines: np.ndarray, first: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first line, last line, minimum) of every window, in order."""
    n = len(lines)
    if not n:
        return (np.empty(0, np.int64),) * 3
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    total = np.concatenate([[0], np.cumsum(lines["words"], dtype=np.int64)])
    each = np.arange(n)
    to = np.searchsorted(total, total[:-1] + min_words) - 1
    ahead = to < n
    ahead[ahead] = doc[to[ahead]] == doc[ahead]
    back = np.searchsorted(total, total[1:] - min_words, "right") - 1
    behind = back >= 0
    behind[behind] = doc[back[behind]] == doc[behind]
    pairs = np.unique(np.concatenate([each[ahead] * n + to[ahead], back[behind] * n + each[behind]]))
    low, high = pairs // n, pairs % n
    return low, high, _range_least(lines["a"], low, high) if len(low) else low


def run_hashes(hashes: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """A hash of each hashes[low:high + 1]."""
    power = np.full(len(hashes) + 1, _STEP | 1, _U)
    inverse = np.full(len(hashes) + 1, pow(_STEP | 1, -1, 1 << 64), _U)
    power[0] = inverse[0] = 1
    power, inverse = np.cumprod(power, dtype=_U), np.cumprod(inverse, dtype=_U)
    sums = np.concatenate([np.zeros(1, _U), np.cumsum(hashes * power[:-1], dtype=_U)])
    return mix64((sums[high + 1] - sums[low]) * inverse[low] + (high - low + 1).astype(_U))


_ANCHOR = T.StructType([T.StructField("fingerprint", T.LongType(), False), T.StructField("at", T.IntegerType(), False)])
_WINNOWED = [T.StructField("lines", T.BinaryType()), T.StructField("anchors", T.ArrayType(_ANCHOR, False))]


def _winnow(min_words: int) -> Callable[[], Callable]:
    """Lines of each text, and its selected minima as (line hash, place among the lines)."""
    kind = to_arrow_schema(T.StructType(_WINNOWED)).field(1).type.value_type

    def make() -> Callable[[list[bytes]], list]:
        def kernel(texts: list[bytes]) -> list:
            lines, first = lines_of(texts)
            anchors = np.unique(windows_in(lines, first, min_words)[2])
            cut = np.searchsorted(anchors, first)
            at = anchors - np.repeat(first[:-1], np.diff(cut))
            parts = pa.StructArray.from_arrays([pa.array(lines["a"][anchors].view(np.int64)), pa.array(at.astype(np.int32))], fields=list(kind))
            some = np.diff(cut) > 0  # texts without windows need no lines
            return [[lines[i:j].tobytes() if k else b"" for i, j, k in zip(first[:-1], first[1:], some)], pa.ListArray.from_arrays(cut.astype(np.int32), parts)]

        return kernel

    return make


def _extended(found: DataFrame, min_words: int) -> DataFrame:
    """found: doc_id, text_hash, lines, at (places of positions to extend). Every window that has one of them
    as its minimum: content (two hashes), place, last, next (the number of the next line with words)."""
    schema = T.StructType(
        [
            *[T.StructField(f"content_{k}", T.LongType()) for k in "ab"],
            T.StructField("place", T.StructType([found.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("line", T.IntegerType())])),
            T.StructField("last", T.IntegerType()),
            T.StructField("next", T.IntegerType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw in chunks(batch, 2):
                lines = np.frombuffer(b"".join(raw), LINE)
                first = np.concatenate([[0], np.cumsum([len(x) // LINE.itemsize for x in raw])]).astype(np.int64)
                wanted = np.zeros(len(lines), bool)
                places = part.column(3)
                wanted[np.repeat(first[:-1], places.value_lengths().to_numpy()) + places.flatten().to_numpy()] = True
                low, high, minimum = windows_in(lines, first, min_words)
                own = np.flatnonzero(wanted[minimum])
                low, high = low[own], high[own]
                doc = np.searchsorted(first, low, "right") - 1
                follows = lines["number"] + 1
                inner = np.ones(len(lines), bool)
                inner[first[1:][np.diff(first) > 0] - 1] = False
                more = np.flatnonzero(inner)
                follows[more] = lines["number"][more + 1]
                place = pa.StructArray.from_arrays([part.column(0).take(pa.array(doc)), part.column(1).take(pa.array(doc)), pa.array(lines["number"][low])], fields=list(arrow.field(2).type))
                content = [pa.array(run_hashes(lines[k], low, high).view(np.int64)) for k in "ab"]
                yield pa.RecordBatch.from_arrays([*content, place, pa.array(lines["number"][high]), pa.array(follows[high])], schema=arrow)

    return found.select("doc_id", "text_hash", "lines", "at").mapInArrow(run, schema)


def joined_runs(windows: list[dict]) -> list[dict]:
    """Matched windows as maximal runs: windows that overlap or follow one another on one diagonal join."""
    key = lambda w: (str(w["first_doc"]), w["line"] - w["first_line"], w["line"], w["last"])
    out: list[dict] = []
    for w in sorted(windows, key=key):
        if out and key(out[-1])[:2] == key(w)[:2] and w["line"] <= out[-1]["next"]:
            if w["last"] > out[-1]["last"]:
                out[-1] |= {"last": w["last"], "next": w["next"]}
        else:
            out.append(dict(w))
    return sorted(out, key=lambda w: (w["line"], w["last"]))


def left_over(runs: list[dict], n_lines: int = 2**31 - 2) -> list[dict]:
    """The stretches of lines (counted from 1) that no run covers; lines between runs that follow one another are covered."""
    out, last, follows = [], -1, 0
    for w in runs:
        if w["line"] > follows:
            out.append({"at": last + 2, "n": w["line"] - last - 1})
        if w["last"] > last:
            last, follows = w["last"], w["next"]
    out.append({"at": last + 2, "n": n_lines - last - 1})
    return [x for x in out if x["n"]]


def repeated_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash and, for each document with later places, runs and the lines left over."""
    base = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    base = base.withColumn("text_hash", F.xxhash64("text"))
    base = base.withColumn("key", F.xxhash64("doc_id", "text_hash"))
    found = written(map_texts(base, "text", _WINNOWED, _winnow(min_words), keep=["doc_id", "text_hash", "key"]))
    minima = found.select("key", F.explode("anchors").alias("m")).select("key", "m.*")
    # tables of keys are cut off from their aggregates, so that adaptive execution can split a hot key's join
    twice = checkpointed(minima.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"))
    positions = minima.join(twice, "fingerprint", "left_semi").groupBy("key").agg(F.collect_set("at").alias("at"))
    windows = checkpointed(_extended(found.where(F.size("anchors") > 0).select("doc_id", "text_hash", "lines", "key").join(positions, "key"), min_words))
    content = ["content_a", "content_b"]
    firsts = checkpointed(windows.groupBy(*content).agg(F.min("place").alias("origin"), F.count("*").alias("n")).where("n > 1").select(*content, "origin"))
    later = windows.join(firsts, content).where("place > origin")
    match = F.struct(F.col("place.line").alias("line"), "last", "next", F.col("origin.doc_id").alias("first_doc"), F.col("origin.line").alias("first_line"))
    grouped = later.groupBy("place.doc_id", "place.text_hash").agg(F.collect_set(match).alias("runs"))
    lines = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType(), False), T.StructField("n", T.IntegerType(), False)]), False)
    shown = T.StructType([f for f in grouped.schema["runs"].dataType.elementType if f.name != "next"])
    schema = T.StructType([*grouped.schema.fields[:2], T.StructField("runs", T.ArrayType(shown)), T.StructField("left", lines)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [joined_runs(w) for w in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, arrow.field(2).type), pa.array([left_over(r) for r in runs], arrow.field(3).type)], names=arrow.names)

    return grouped.mapInArrow(run, schema)


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the later places of repeated runs removed from the text, and n_lines,
    n_lines_removed and runs (line, last, first_doc, first_line; counted from 0)."""
    runs = repeated_runs(docs, text, doc_id, min_words)
    kept = [c for c in names_clash(docs, [T.StructField(n, T.LongType()) for n in ("n_lines", "n_lines_removed", "runs")]) if c.lower() != text.lower()]
    own = docs.select(*[F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").cast("string").alias("__text"), F.col(f"`{doc_id}`").alias("__id"))
    own = own.withColumns({"__hash": F.xxhash64(F.coalesce("__text", F.lit(""))), "__place": F.xxhash64("__id")})
    side = runs.select(F.col("text_hash").alias("__hash"), F.xxhash64("doc_id").alias("__place"), "runs", "left")
    lines = F.split("__text", "\n", -1)
    stretch = lambda x: F.slice(lines, x["at"], F.greatest(F.lit(0), F.least(x["n"], F.size(lines) - x["at"] + 1)))
    kept_lines = F.filter("left", lambda x: x["at"] <= F.size(lines))
    cleaned = F.when(F.col("left").isNull(), F.col("__text")).otherwise(F.array_join(F.flatten(F.transform(kept_lines, stretch)), "\n"))
    out = own.join(side, ["__hash", "__place"], "left").select(
        *[F.col(f"__{i}").alias(c) for i, c in enumerate(kept)],
        cleaned.alias(text),
        F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("left").isNull(), F.lit(0)).otherwise(F.size(lines) - F.size(F.flatten(F.transform(kept_lines, stretch)))).cast("long").alias("n_lines_removed"),
        "runs",
    )
    order = [c for c in docs.columns if c in kept or c.lower() == text.lower()]
    return out.select(*[F.col(f"`{c}`") for c in order], "n_lines", "n_lines_removed", "runs")
