"""Shared helpers of the text operators: table access, checkpoints, Arrow text as numpy bytes, vectorised words."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import shared_folder

#: The six ASCII white-space bytes that separate words: space and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: An odd multiplier of rolling hashes, and its inverse modulo 2^64.
PRIME = 0x9E3779B97F4A7C15
INVERSE = pow(PRIME, -1, 1 << 64)
#: Bytes that are hashed at once.
SEGMENT = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the session's checkpoint folder, so that its lineage ends there and a lost executor loses nothing."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Workspace:
    """Tables of one computation in a folder of its own below the shared one: lineage ends with each, as with checkpoints,
    and those that are no longer needed are deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.paths = spark, f"{shared_folder(spark).rstrip('/')}/tables-{uuid.uuid4().hex}", []

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}"
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def mark(self) -> int:
        """A place in time, for drop()."""
        return len(self.paths)

    def drop(self, since: int, to: int | None = None) -> None:
        """Deletes the tables that were kept from one place in time to another, or to now."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths[since:to]:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def texts_of(docs: DataFrame) -> DataFrame:
    """The two columns that the operators read, whatever else docs has: doc_id as long and text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64, one more than rows) and bytes of a string column; null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def trim() -> None:
    """Gives freed memory back to the system: workers live on from one stage to the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # no such call outside glibc
        ctypes.CDLL(None).malloc_trim(0)


def parts(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about limit bytes of text at most; a longer text stays whole, alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets, _ = utf8(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    trim()


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all maximal runs of non-space bytes; no word crosses a row."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    solid = np.ones(len(data) + 1, bool)
    solid[-1] = False
    np.logical_not(SPACE[data], out=solid[:-1])
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins = solid[:-1].copy()
    begins[1:] &= ~solid[:-2] | cut[1:-1]
    ends = solid[:-1] & (~solid[1:] | cut[1:])
    starts, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: int = PRIME) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get(str(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, SEGMENT), base, np.uint64)
        steps[0] = 1
        have = _powers[str(base)] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of data (ascending, apart) from its bytes alone: a rolling polynomial by prefix sums, then
    mixed. Bytes are read in segments of bounded size; a longer span is folded from segments."""
    value, at, n = np.zeros(len(starts), np.uint64), 0, len(starts)
    while at < n:
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + SEGMENT, "right")))
        if to == at + 1:
            value[at] = folded_span(data[base : int(ends[at])])
        else:
            part = data[base : int(ends[to - 1])]
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * powers(len(part)), out=sums[1:])
            value[at:to] = (sums[ends[at:to] - base] - sums[starts[at:to] - base]) * powers(len(part), INVERSE)[starts[at:to] - base]
        at = to
    return mixed(value + (ends - starts).astype(np.uint64))


def folded_span(span: np.ndarray) -> np.uint64:
    """The polynomial of one span, segment by segment."""
    total, scale = 0, 1
    for at in range(0, len(span), SEGMENT):
        part = span[at : at + SEGMENT].astype(np.uint64) + np.uint64(1)
        total += int((part * powers(len(part))).sum(dtype=np.uint64)) * scale
        scale = scale * pow(PRIME, SEGMENT, 1 << 64) % (1 << 64)
    return np.uint64(total % (1 << 64))


def running(flags: np.ndarray) -> np.ndarray:
    """How many flags are set before each place (one more place than flags), in as few bytes as hold it."""
    out = np.zeros(len(flags) + 1, np.int32 if len(flags) < 1 << 31 else np.int64)
    np.cumsum(flags, out=out[1:])
    return out


#: Rows of one key that one task may get, at least, and keys that may have more.
FEW, HOT_KEYS = 1000, 10_000


def beside(rows: DataFrame, side: DataFrame, key: str, counts: DataFrame, total: int) -> DataFrame:
    """rows joined with side, which has one row for each key, without a hot key in one task.

    counts: key and n, its number of rows (or more); total: the sum of these. Keys of more rows than FEW and than one in
    HOT_KEYS of all are hot: there are HOT_KEYS at most, so that they can be broadcast. Their rows are dealt to several
    parts by a hash of another column, and side's row is sent to each part. Neither table is broadcast: Spark takes an exploded
    one for as small as the files that it comes from."""
    limit = max(FEW, total // HOT_KEYS)
    other = next(c for c in rows.columns if c != key)
    hot = F.broadcast(counts.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / limit).cast("int").alias("_fan")))
    dealt = rows.join(hot, key, "left").withColumn("_salt", F.coalesce(F.pmod(F.hash(other), F.col("_fan")), F.lit(0))).drop("_fan")
    sent = side.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_fan", F.lit(1)) - 1))).drop("_fan")
    return dealt.join(sent.hint("merge"), [key, "_salt"]).drop("_salt")


def windows(row_of_word: np.ndarray, size: int) -> np.ndarray:
    """First words of all windows of size words inside one row."""
    n = len(row_of_word) - size + 1
    return np.flatnonzero(row_of_word[:n] == row_of_word[size - 1 :]) if n > 0 else np.zeros(0, np.int64)


def window_hashes(hashes: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """An order-dependent 64-bit hash of the size words from each of first on."""
    value = np.zeros(len(first), np.uint64)
    for k in range(size):
        value = value * np.uint64(PRIME) + hashes[first + k]
    return mixed(value)


def crc_rest(modulus: int) -> F.Column:
    """crc32 of doc_id as text, modulo modulus: the fold of a row. A null doc_id has rest -1: it is never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(-1))


def kept_beside(docs: DataFrame, judge) -> DataFrame:
    """The rows of docs, with all their columns as they are, that judge keeps: judged in place, without a join.

    judge(batch) takes a record batch with doc_id and text and gives boolean arrays for its rows, in order."""
    at_id, at_text = ([k for k, n in enumerate(docs.columns) if n.lower() == c] for c in ("doc_id", "text"))
    if len(at_id) != 1 or len(at_text) != 1:
        raise ValueError("docs needs one column doc_id and one column text")

    def rows(batches):
        for batch in batches:
            at = 0
            both = pa.RecordBatch.from_arrays([batch.column(at_id[0]), batch.column(at_text[0])], ["doc_id", "text"])
            for keep in judge(both):
                yield batch.slice(at, len(keep)).filter(pa.array(keep))
                at += len(keep)

    return docs.mapInArrow(rows, docs.schema)
