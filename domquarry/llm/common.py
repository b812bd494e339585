"""Shared plumbing: durable intermediate tables, text buffers, hashes of spans, bounded label samples."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text whose words are handled by one round of array operations; a longer text is a round of its own.
SLICE_BYTES = 1 << 19

_WRITTEN: list[str] = []
_LOCAL_ROOT: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append("file://" + tempfile.mkdtemp(prefix="domquarry-"))
    return _LOCAL_ROOT[0]


def limit_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB unless the session has a limit of its own: very long texts must not add up in a Python worker."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.sparkContext.getConf().get(key) is None:
        spark.conf.set(key, str(4 << 20))


def tidy(fn):
    """A function over Arrow batches that gives freed memory back when its task ends: idle Python workers stay small."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            ctypes.CDLL(None).malloc_trim(0) if hasattr(ctypes.CDLL(None), "malloc_trim") else None

    return run


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    limit_batches(spark)
    path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(_drop_written)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, df: DataFrame) -> None:
    """Deletes a table that materialize() wrote and that no later result reads."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        own = next((w for w in _WRITTEN if w.split(":")[-1].lstrip("/") == path.split(":")[-1].lstrip("/")), None)
        if own:
            _delete(spark, own)
            _WRITTEN.remove(own)


def drop_shuffles(spark: SparkSession) -> None:
    """Has the files of shuffles deleted that no live DataFrame reads: they go when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_written() -> None:
    spark = SparkSession.getActiveSession()
    for path in _WRITTEN if spark is not None else []:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may already be gone at exit
            return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    limit_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def extended(df: DataFrame, fields: str) -> T.StructType:
    """df's schema and further fields."""
    return T.StructType(df.schema.fields + T._parse_datatype_string(fields).fields)


def unused(name: str, taken) -> str:
    """name, with as many underscores before it as no column of ``taken`` (whatever its case) has."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def crc_mod(col, n: int):
    """crc32 of an id written as text, modulo n."""
    return F.crc32(col.cast("string").cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, allowed, per_class: int, max_chars: int | None, features=None, kind: str = "string") -> DataFrame:
    """At most per_class labelled rows of each label value, drawn by hash order of doc_id: doc_id, x, _label.

    x is the text, or what ``features`` (from a column of texts to an Arrow array of type ``kind``) makes of it in the tasks.

    Every label value is drawn from: with more than 64 of them, 64 * per_class rows are shared out evenly, one each at least.
    A text beyond max_chars gives one window of max_chars characters, which begins where the hash of its id says; None takes
    whole texts. Rows for which the Column ``allowed`` isn't true and null labels or texts are no candidates. An id with several
    labels has the least of them, one with several texts that of least hash: the rows are bounded by ids.
    Ids are drawn before any text is read.
    """
    id_col = "doc_id"
    limit_batches(docs.sparkSession)
    ids = labels.select(F.col(id_col), F.col(label).cast("string").alias("_label")).where(F.col("_label").isNotNull() & F.col(id_col).isNotNull() & allowed)
    ids = ids.groupBy(id_col).agg(F.min("_label").alias("_label"))
    values = ids.agg(F.count_distinct("_label")).first()[0]
    per_class = max(1, min(per_class, 64 * per_class // max(1, values)))
    # the rank is limited in each task before rows are exchanged, so a label that most rows bear is no burden
    rank = F.row_number().over(Window.partitionBy("_label").orderBy(F.xxhash64(id_col), id_col))
    drawn = ids.withColumn("_n", rank).where(F.col("_n") <= per_class).drop("_n")
    text = F.col("text")
    if max_chars is not None:
        begin = F.pmod(F.xxhash64(id_col), F.greatest(F.length("text") - max_chars + 1, F.lit(1))).cast("int") + 1
        text = F.when(F.length("text") > max_chars, F.substring("text", begin, F.lit(max_chars))).otherwise(F.col("text"))
    # 64 * per_class ids of 8 bytes, or one a label value: the broadcast is bounded by these
    found = docs.select(id_col, "text").where(F.col("text").isNotNull()).join(F.broadcast(drawn), id_col)
    found = found.select(id_col, "_label", F.xxhash64("text").alias("h"), text.alias("x"))
    if features is not None:

        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), features(batch.column(3))], [id_col, "_label", "h", "x"])

        found = found.mapInArrow(tidy(run), extended(found.drop("x"), f"x {kind}"))
    return found.groupBy(id_col, "_label").agg(F.min(F.struct("h", "x")).alias("t")).select(id_col, F.col("t.x").alias("x"), "_label")


def as_binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Text with nulls as empty, as large_binary in one chunk."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column.cast(pa.large_string()).cast(pa.large_binary())
    elif not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string()).cast(pa.large_binary())
    return pc.fill_null(column, b"") if column.null_count else column


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them) of runs of rows of about max_bytes."""
    column = as_binary(column)
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64, n + 1 + column.offset)[column.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + max_bytes, "right")) - 1)
        yield a, b, raw[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def lut(word: str) -> np.ndarray:
    """256 booleans: which bytes of UTF-8 belong to words. 'alnum': ASCII letters, digits and all beyond ASCII; 'nonspace': all but blank, tab to CR."""
    t = np.zeros(256, bool)
    if word == "alnum":
        t[0x30:0x3A] = t[0x41:0x5B] = t[0x61:0x7B] = t[0x80:] = True
    else:
        t[:] = True
        t[[0x20, 9, 10, 11, 12, 13]] = False
    return t


LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        m = max(n, 1 << 16)
        have = np.ones(m, np.uint64)
        have[1:] = base & 0xFFFFFFFFFFFFFFFF
        _POWERS[base] = have = np.multiply.accumulate(have)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64, in place where it can be."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span of the bytes, alike wherever the span stands."""
    p = (_P + 2 * 0x1234567 * seed) & 0xFFFFFFFFFFFFFFFF
    n = len(data)
    c = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(p, n), out=c[1:])
    h = (c[end] - c[start]) * powers(pow(p, -1, 1 << 64), n + 1)[start]
    return mix(h ^ (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and where each row's words begin among them (one more entry than rows). No word crosses rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = is_word[data]
    first, last = w.copy(), w.copy()
    first[1:] &= ~w[:-1]
    last[:-1] &= ~w[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    first[inner] = w[inner]
    last[inner - 1] = w[inner - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)
