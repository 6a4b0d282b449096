"""What the corpus operators share: reading tables, scratch folders on shared storage, word hashing.

Conventions of all operators in this subpackage: null text counts as empty unless a docstring says
otherwise; repeated rows are separate rows; other columns of the input, whatever their names, never
take part (operators that pass columns through use ``_op_`` names inside).
"""

from __future__ import annotations

import gc
import itertools
import pickle
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LOCAL: list[str] = []


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder on the storage that all executors share (``spark.checkpoint.dir``).

    Only where that setting is unset, as in tests, a local temporary folder takes its place."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="spark-"))
        base = _LOCAL[0]
    return f"{base}/trackspark/{what}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once to shared storage and read it again: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Workspace:
    """Written tables that only the steps of one call need: ``with Workspace(spark, "x") as work``.

    They lie in one folder on shared storage, which goes when the block ends.  What a call returns must not
    read them any more: it is written by ``materialise``.  With ``releases`` the driver drops the plans of finished
    steps after each table, so that a call of many steps needs no more of its memory than a short one."""

    def __init__(self, spark: SparkSession, what: str, releases: bool = False) -> None:
        self.spark, self.path, self.releases = spark, scratch(spark, what), releases
        self.tables: list[str] = []  # names in the catalog, dropped even if a step fails

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_: object) -> None:
        for name in self.tables:
            self.spark.sql(f"drop table if exists {name}")
        self.remove("")

    def remove(self, what: str) -> None:
        """Delete a folder of this one, or all of it."""
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{what}".rstrip("/"))
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def release(self) -> None:
        """Let the shuffle files of finished jobs go: Spark drops them once the driver's JVM has collected their plans."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def write(self, df: DataFrame, what: str) -> DataFrame:
        path = f"{self.path}/{what}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(path)
        if self.releases:
            self.release()
        return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def uniform(*parts: Column) -> Column:
    """32 bits of md5 over the parts, as a double in [0, 1); other engines compute the same."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


# --- word hashing ---------------------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MULT = 0x9E3779B97F4A7C15 | 1
_STEP = 1 << 16


def mix64(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


#: One random-looking value for each byte, made from its number.
BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


class _Powers:
    """Powers of the multiplier and of its inverse modulo 2**64, grown as longer texts come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, _STEP)
            inverse = pow(_MULT, -1, 1 << 64)
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, m, np.uint64), dtype=np.uint64)]) for m in (_MULT, inverse))
        return self.up, self.down


_POWERS = _Powers()


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which the hash of any substring follows (see span_hash)."""
    up, _ = _POWERS.get(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUE[data] * up[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end]; equal bytes give equal hashes wherever they stand."""
    _, down = _POWERS.get(len(prefix))
    return mix64((prefix[end] - prefix[start]) * down[start])


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` in a byte array."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def scatter64(x: np.ndarray) -> np.ndarray:
    """64 random-looking bits for each number: two multiplications with shifts between, so that nothing of its structure is left."""
    x = (x + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: The values of bytes in the first places of a word; further places are computed.
_NEAR = 64
_PLACED = scatter64(np.arange(_NEAR * 256, dtype=np.uint64))


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words data[start:end], which do not overlap and are not empty.

    Every byte at every place of a word has a random-looking value of its own, and a word the sum of them: unlike a
    polynomial, whose powers are alike modulo 2**64, this has no structured words that collide."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    at = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(at, size)
    code = place * 256 + data[np.repeat(start, size) + place]
    value = _PLACED[np.minimum(code, len(_PLACED) - 1)]
    if len(far := np.flatnonzero(place >= _NEAR)):
        value[far] = scatter64(code[far].astype(np.uint64))
    return scatter64(np.add.reduceat(value, at) + size.astype(np.uint64))


def hash_words(data: np.ndarray) -> np.ndarray:
    """Hashes of the lower-cased (A-Z) words of a text, in order."""
    start, end = word_spans(data)
    return word_hash(LOWER[data], start, end)


def as_bytes(value) -> np.ndarray:
    """A pyarrow string or binary scalar, str, bytes or None as a byte array."""
    if value is None:
        return np.zeros(0, np.uint8)
    if isinstance(value, str):
        value = value.encode("utf-8", "surrogatepass")
    elif not isinstance(value, (bytes, memoryview)):
        value = value.as_buffer()
    return np.frombuffer(value, np.uint8) if value is not None and len(value) else np.zeros(0, np.uint8)


# --- rows of Arrow batches ------------------------------------------------------------------------

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
TEXTS_AT_ONCE = 1000


def small_batches(spark: SparkSession) -> str:
    """Let rows go to Python at most ``TEXTS_AT_ONCE`` at a time; gives the setting before.

    They carry whole texts, of which the executor's JVM and its workers hold several batches each.  Spark reads the setting
    when a job is planned, so it must stand until a result that is not written yet has been used."""
    before = spark.conf.get(BATCH_ROWS)
    if not 0 < int(before) <= TEXTS_AT_ONCE:
        spark.conf.set(BATCH_ROWS, str(TEXTS_AT_ONCE))
    return before


def rows_in(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of a task, one after another; only the batch at hand is in memory."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def batches_out(rows: Iterable[tuple], fields: list[tuple[str, pa.DataType]], size: int = 1000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of ``size`` rows."""
    rows, schema = iter(rows), pa.schema(fields)
    while part := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


# --- models on the executors ----------------------------------------------------------------------

_LOADED: dict[str, object] = {}


class Shipped:
    """A picklable object broadcast once and unpickled once in each Python worker."""

    def __init__(self, spark: SparkSession, value: object) -> None:
        self.key = uuid.uuid4().hex
        self.data = spark.sparkContext.broadcast(pickle.dumps(value))

    def get(self):
        if self.key not in _LOADED:
            _LOADED.clear()  # one model at a time
            _LOADED[self.key] = pickle.loads(self.data.value)
        return _LOADED[self.key]


def unload() -> None:
    """Drop the model that an earlier job left in this Python worker."""
    _LOADED.clear()


def extended(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of ``df`` with more fields."""
    fields = list(df.schema.fields)
    return T.StructType(fields + T.StructType.fromDDL(ddl).fields)
