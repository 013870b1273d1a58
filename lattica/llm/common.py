"""Shared kernels: Arrow plumbing, word tables over byte buffers, 64-bit hashing.

Null texts count as empty. Result columns replace input columns of the same name
(names compare without case, as Spark's do).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of text that a kernel sees at once (one longer text is seen alone).
CHUNK_BYTES = 1 << 21

_U = np.uint64


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Only a local session may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    import tempfile

    return tempfile.mkdtemp(prefix="checkpoints-")


def checkpointed(frame: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder all executors share."""
    context = frame.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(checkpoint_folder(frame.sparkSession))
    made = frame.checkpoint(eager=True)
    let_go(frame.sparkSession)
    return made


def let_go(spark: SparkSession) -> None:
    """Spark deletes shuffle files once the driver has collected what refers to them: do so when a lineage has been cut."""
    spark.sparkContext._jvm.System.gc()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"


def written(frame: DataFrame, codec: str | None = None) -> DataFrame:
    """The frame as a Parquet table in the shared folder: what follows reads files, not the plan."""
    folder = shared_folder(frame.sparkSession)
    frame.write.parquet(folder, compression=codec)
    let_go(frame.sparkSession)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BASES = (0x2545F4914F6CDD1D, 0xD1342543DE82EF95)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_BYTES = tuple(mix64(np.arange(256, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(1 + 256 * i)) | _U(1) for i in range(2))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, _U)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=_U)
    return have[:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int = 0, block: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span; spans are in order and do not overlap.
    Two kinds (0, 1) are independent: together they are a hash of 128 bits."""
    out = np.empty(len(starts), _U)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(starts, starts[at] + block)))
        low, high = int(starts[at]), int(ends[to - 1])
        sums = np.zeros(high - low + 1, _U)
        np.cumsum(_BYTES[kind][data[low:high]] * _power(_BASES[kind], high - low), out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[e] - sums[s]) * _power(_INVERSES[kind], high - low + 1)[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93)
        at = to
    return mix64(out)


def _table(keep: Callable[[int], int]) -> bytes:
    return bytes(keep(i) for i in range(256))


#: Words are what lies between the six ASCII white space characters.
SPACED = _table(lambda i: 32 if i in (9, 10, 11, 12, 13) else i)
#: Words are runs of digits, lower-cased ASCII letters and code points from U+0080.
PLAIN = _table(lambda i: i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32)


@dataclass
class Words:
    """Words of several texts: their hashes, places in the joined bytes, and each text's first word."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(texts: list[bytes], table: bytes, fold_latin: bool = False) -> Words:
    """fold_latin also lower-cases the accented capitals of U+00C0 to U+00DE."""
    base = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1, out=base[1:])
    data = np.frombuffer((b" ".join(texts) + b" ").translate(table), np.uint8)
    if fold_latin and len(data) > 1:
        data = data.copy()
        after = data[1:]
        after[(data[:-1] == 0xC3) & (after >= 0x80) & (after <= 0x9E) & (after != 0x97)] += 0x20
    inside = np.zeros(len(data) + 1, bool)
    inside[1:] = data != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[0::2], edges[1::2]
    return Words(span_hashes(data, starts, ends), starts, ends, np.searchsorted(starts, base), data)


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n neighbouring values, len(hashes) - n + 1 of them."""
    total = np.zeros(max(0, len(hashes) - n + 1), _U)
    for i in range(n):
        total = (total ^ (total >> _U(29))) * _U(0xBF58476D1CE4E5B9) + hashes[i : i + len(total)]
    return mix64(total)


def chunks(batch: pa.RecordBatch, column: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batch in slices of about `limit` bytes of text (one longer text is a slice alone), with the slices' texts."""
    values = batch.column(column).cast(pa.binary())
    ends = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at), [b"" if v is None else v for v in values.slice(at, to - at).to_pylist()]
        at = to


def names_clash(frame: DataFrame, fields: list[T.StructField]) -> list[str]:
    """Columns of the frame that no result column replaces."""
    taken = {f.name.lower() for f in fields}
    return [c for c in frame.columns if c.lower() not in taken]


def map_texts(docs: DataFrame, text: str, fields: list[T.StructField], make_kernel: Callable[[], Callable[[list[bytes]], list]], keep: list[str] | None = None, limit: int = CHUNK_BYTES) -> DataFrame:
    """Add to each row what a kernel says of its text. make_kernel() runs once a task;
    the kernel gets texts and returns one sequence for each field. Rows stay where they
    are: no shuffle. keep: columns that stay (all, unless a result column has the name).
    limit: bytes of text that a kernel gets at once."""
    keep = [c for c in (names_clash(docs, fields) if keep is None else keep) if c.lower() not in {f.name.lower() for f in fields}]
    source = docs.select(F.col(f"`{text}`").cast("string").alias("__text"), *[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*source.schema.fields[1:], *fields])
    arrow = to_arrow_schema(T.StructType(fields))
    names = [*keep, *[f.name for f in fields]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make_kernel()
        for batch in batches:
            for part, texts in chunks(batch, 0, limit):
                made = kernel(texts)
                new = [x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(made, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *new], names=names)

    return source.mapInArrow(run, schema)
