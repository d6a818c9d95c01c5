"""Global distinct-word encoding: each distinct pre-token of a corpus is encoded once, and the codes are joined back.

Documents are cut into pre-tokens at single spaces. Byte-level BPE patterns and sentence-piece models alike never merge
over the border between a non-space and a following space, so encoding pre-tokens one by one equals encoding whole texts.

Two passes over the same scan build (a) the distinct pre-tokens of each chunk of documents, dealt out by hash so that all
copies of a pre-token meet in one task, where it is encoded once, and (b) the documents of each chunk as packed positions
(or frequencies) of chunk-local word numbers. Both meet again by chunk. Rows that cross a shuffle are compressed blobs:
words of one chunk and bucket, or one chunk's positions, a few MB at most except for a single longer text. Input must be a
deterministic relation, such as a table or a checkpoint: the passes compare a checksum and fail loudly otherwise.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import texts_of, trim, utf8

#: Bytes of text in a chunk, about; a longer text makes a chunk of its own.
CHUNK_BYTES = 12 << 20
#: Marks a pre-token whose leading space, if any, is written out. All others have one space before them.
LITERAL = "\x01"
#: A place where a text may be cut: before one space between two non-spaces.
CUT = re.compile(r"(?<=\S)(?= \S)")
RUNS = re.compile(" +[^ ]*")


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers by byte planes, so that frequent small ones compress."""
    planes = np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def pack_words(items: list[bytes]) -> bytes:
    sizes = np.fromiter(map(len, items), "<u4", len(items))
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(items)], "<u4").tobytes() + sizes.tobytes() + b"".join(items))


def unpack_words(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4), dtype=np.int64) + 4 + 4 * n
    starts = np.concatenate([[4 + 4 * n], ends[:-1]]) if n else ends
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def pretokens(text: str, dummy: bool) -> list[str]:
    """Pre-tokens of a text with irregular space; dummy: one space is put before the text, and runs of spaces stay together."""
    if not text:
        return []
    if dummy:
        return [LITERAL + x for x in RUNS.findall(" " + text.replace("▁", " "))]
    return [LITERAL + x for x in CUT.split(text)]


def split_rows(column: pa.Array, dummy: bool) -> tuple[pa.Array, np.ndarray]:
    """Dictionary-encoded pre-tokens of all rows, one after the other, and each row's number of them."""
    column = column.fill_null("")
    lists = pc.split_pattern(column, " ")
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)])
    coded = flat.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False)
    odd = np.fromiter((not w or w[0].isspace() or w[0] == LITERAL or (dummy and "▁" in w) for w in coded.dictionary.to_pylist()), bool, len(coded.dictionary))
    irregular = np.flatnonzero(np.add.reduceat(odd[code], starts[:-1]) > 0) if len(code) else np.zeros(0, np.int64)
    if dummy and not len(irregular):
        return coded, counts
    items = {int(r): pretokens(column[int(r)].as_py(), dummy) for r in irregular}
    regular = np.ones(len(counts), bool)
    regular[irregular] = False
    size, extra = len(coded.dictionary), []
    if not dummy:  # the first pre-token of a regular row has no space before it: a code of its own
        first = starts[:-1][regular]
        used, place = np.unique(code[first], return_inverse=True)
        extra = [LITERAL + w for w in coded.dictionary.take(pa.array(used)).to_pylist()]
        code = code.astype(np.int64)
        code[first] = size + place
    if len(irregular):
        own = sorted({w for x in items.values() for w in x})
        number = {w: size + len(extra) + k for k, w in enumerate(own)}
        extra += own
        pieces, at = [], 0
        for r in irregular.tolist():
            pieces += [code[starts[at] : starts[r]], np.array([number[w] for w in items[r]], np.int64)]
            counts[r], at = len(items[r]), r + 1
        code = np.concatenate([*pieces, code[starts[at] :]])
    every = pa.concat_arrays([coded.dictionary, pa.array(extra, coded.dictionary.type)])
    used = np.zeros(len(every), bool)  # pieces of irregular rows may be in no pre-token
    used[code] = True
    return pa.DictionaryArray.from_arrays(pa.array((np.cumsum(used) - 1)[code].astype(np.int32)), every.filter(pa.array(used))), counts


class Chunk:
    """One chunk's distinct pre-tokens, most frequent first, and its rows as numbers of them."""

    def __init__(self, rows: pa.Table, buckets: int, dummy: bool):
        text = rows.column("text").combine_chunks()
        coded, self.counts = split_rows(text, dummy)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        size = len(coded.dictionary)
        order = np.argsort(-np.bincount(code, minlength=size), kind="stable")
        rank = np.empty(size, np.int64)
        rank[order] = np.arange(size)
        self.codes = rank[code]
        encoded = [w.encode() for w in coded.dictionary.take(pa.array(order)).to_pylist()]
        digests = np.fromiter(map(xxhash.xxh3_64_intdigest, encoded), np.uint64, size)
        self.bucket = (digests >> np.uint64(33)).astype(np.int64) % buckets
        self.check = int(np.bitwise_xor.reduce(digests * np.arange(1, 2 * size, 2, dtype=np.uint64)).astype(np.int64)) if size else 0
        self.words = encoded
        self.doc_id = rows.column("doc_id").combine_chunks()
        self.n_bytes = np.diff(utf8(text)[0])


def grouped(batches: Iterator[pa.RecordBatch], limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """The rows in tables of about limit bytes of text at most; a longer text alone."""
    held, size = [], 0
    for batch in batches:
        offsets, _ = utf8(batch.column("text"))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit - size, "right")) - 1)
            if held and size + offsets[to] - offsets[at] > limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                continue
            held.append(batch.slice(at, to - at))
            size += int(offsets[to] - offsets[at])
            at = to
    if held:
        yield pa.Table.from_batches(held)
    trim()


def chunks(batches: Iterator[pa.RecordBatch], buckets: int, dummy: bool) -> Iterator[tuple[int, Chunk]]:
    part = TaskContext.get().partitionId()
    for number, rows in enumerate(grouped(batches)):
        yield (part << 32) + number, Chunk(rows, buckets, dummy)


def encoded_rows(docs: DataFrame, encoder: Callable[[], Callable], emit: Callable, schema: str, dummy: bool = False, frequencies: bool = False, only_counts: bool = False) -> DataFrame:
    """emit's rows for every row of docs, from its pre-tokens' codes.

    encoder() gives, on an executor, a function from a list of pre-tokens (LITERAL ones and others) to a list of their
    ids (bytes, four each), or to their numbers of ids with only_counts. emit(doc_id, n_bytes, places, words, times, sizes, begins, ids)
    gets a chunk: row r's words are words[places[r]:places[r + 1]], word w has sizes[w] ids from ids[begins[w]] on; times
    holds frequencies (distinct words of each row, ascending) or is None (words in order of position).
    """
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = texts_of(docs)

    def distinct(batches):
        for chunk, c in chunks(batches, buckets, dummy):
            order = np.argsort(c.bucket, kind="stable")
            edges = np.searchsorted(c.bucket[order], np.arange(buckets + 1))
            have = np.flatnonzero(np.diff(edges))
            blobs = [pack_words([c.words[i] for i in order[edges[b] : edges[b + 1]]]) for b in have]
            yield pa.RecordBatch.from_arrays([pa.array(have.astype(np.int32)), pa.array([chunk] * len(have), pa.int64()), pa.array([c.check] * len(have), pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "chunk", "check", "words"])

    def encode(batches):
        call, known = encoder(), {}
        for batch in batches:
            out = []
            for blob in batch.column("words"):
                items = unpack_words(blob.as_py())
                if new := [w for w in items if w not in known]:
                    known.update(zip(new, call([w.decode() for w in new]), strict=True))
                got = [known[w] for w in items]
                if only_counts:
                    out.append((pack(np.array(got)), b""))
                else:
                    out.append((pack(np.fromiter(map(len, got), np.int64, len(got)) // 4), pack(np.frombuffer(b"".join(got), "<u4"))))
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("chunk"), batch.column("check"), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "chunk", "check", "sizes", "ids"])

    def positions(batches):
        for chunk, c in chunks(batches, buckets, dummy):
            code, counts, times = c.codes, c.counts, b""
            if frequencies:
                keys, n = np.unique(np.repeat(np.arange(len(counts)) << 32, counts) + code, return_counts=True)
                row, code = keys >> 32, keys & 0xFFFFFFFF
                counts, times = np.bincount(row, minlength=len(counts)), pack(n)
                code = np.where(np.diff(row, prepend=-1) == 0, np.diff(code, prepend=0), code)
            cells = [[chunk], [c.check], [c.doc_id.to_pylist()], [pack(c.n_bytes)], [pack(counts)], [pack(code)], [times], [pack(c.bucket)]]
            kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cells, kinds, strict=True)], ["chunk", "check", "doc_ids", "n_bytes", "counts", "codes", "times", "buckets"])

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows != 1:
            raise RuntimeError("the input rows changed between two passes; give a table or a checkpoint")
        x = left.to_pylist()[0]
        bucket, counts = unpack(x["buckets"]), unpack(x["counts"]).astype(np.int64)
        blobs = sorted(right.select(["bucket", "sizes", "ids"]).to_pylist(), key=lambda r: r["bucket"])
        order = np.argsort(bucket, kind="stable")
        size_of = np.concatenate([unpack(b["sizes"]) for b in blobs] or [np.zeros(0, np.uint32)]).astype(np.int64)
        if len(size_of) != len(order):
            raise RuntimeError("the input rows changed between two passes; give a table or a checkpoint")
        ids = np.concatenate([unpack(b["ids"]) for b in blobs if b["ids"]] or [np.zeros(0, np.uint32)])
        sizes, begins = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        sizes[order] = size_of
        begins[order] = np.cumsum(size_of) - size_of
        places = np.concatenate([[0], np.cumsum(counts)])
        code = unpack(x["codes"]).astype(np.int64)
        times = None
        if frequencies:
            times = unpack(x["times"]).astype(np.int64)
            run = np.cumsum(code)
            first = places[:-1][counts > 0]
            code = run - np.repeat(np.concatenate([[0], run])[first], counts[counts > 0])
        return emit(x["doc_ids"], unpack(x["n_bytes"]).astype(np.int64), places, code, times, sizes, begins, ids)

    ids = source.mapInArrow(distinct, "bucket int, chunk long, check long, words binary").repartitionById(buckets, F.col("bucket")).mapInArrow(encode, "bucket int, chunk long, check long, sizes binary, ids binary")
    rows = source.mapInArrow(positions, "chunk long, check long, doc_ids array<long>, n_bytes binary, counts binary, codes binary, times binary, buckets binary")
    return rows.groupBy("chunk", "check").cogroup(ids.groupBy("chunk", "check")).applyInArrow(joined, schema)


def local_rows(docs: DataFrame, encoder: Callable[[], Callable], emit: Callable, schema: str, most: int = 150_000) -> DataFrame:
    """As encoded_rows() with positions, but each task encodes its own distinct pre-tokens: more work, no shuffle.

    Of the pre-tokens that a chunk has more than once, a task keeps up to most, encoded, for the next chunks."""

    def rows(batches):
        call, known = encoder(), {}
        for held in grouped(batches, CHUNK_BYTES // 2):
            text = held.column("text").combine_chunks()
            coded, counts = split_rows(text, False)
            items = coded.dictionary.to_pylist()
            code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            got = [known.get(w) for w in items]
            if new := [k for k, x in enumerate(got) if x is None]:
                for k, x in zip(new, call([items[k] for k in new]), strict=True):
                    got[k] = x
            often = {items[k]: got[k] for k in np.flatnonzero(np.bincount(code, minlength=len(items)) > 1).tolist()}
            known = {**known, **often} if len(known) + len(often) <= most else often
            sizes = np.fromiter(map(len, got), np.int64, len(got)) // 4
            ids = np.frombuffer(b"".join(got), "<u4")
            out = emit(held.column("doc_id").to_pylist(), np.diff(utf8(text)[0]), np.concatenate([[0], np.cumsum(counts)]), code, None, sizes, np.cumsum(sizes) - sizes, ids)
            yield from out.to_batches()

    return texts_of(docs).mapInArrow(rows, schema)


def row_ids(places: np.ndarray, code: np.ndarray, sizes: np.ndarray, begins: np.ndarray, ids: np.ndarray) -> Iterator[np.ndarray]:
    """The ids of each row in order, reassembled a bounded number of words at a time."""
    at, n = 0, len(places) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(places, places[at] + (1 << 19), "right")) - 1)
        own = code[places[at] : places[to]]
        length = sizes[own]
        ends = np.cumsum(length)
        flat = ids[np.repeat(begins[own] - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]
        edges = np.concatenate([[0], ends])[places[at : to + 1] - places[at]]
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield flat[a:b]
        at = to
