"""Context-triggered piecewise hashes of documents, and their likeness by edit distance."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import texts_of

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: Signature length, smallest block size, bytes of the rolling window, letters that two signatures must have in common.
LONGEST, SMALLEST, WINDOW, COMMON = 64, 3, 7, 7
SEGMENT = 1 << 20


def triggers(data: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Ends of pieces at this block size, and the rolling hash there; the hash sees the last seven bytes."""
    places, values = [], []
    for at in range(0, len(data), SEGMENT):
        own = data[max(0, at - WINDOW + 1) : at + SEGMENT]
        if at < WINDOW - 1:
            own = np.concatenate([np.zeros(WINDOW - 1 - at, np.uint8), own])
        x = own.astype(np.uint32)
        h = np.zeros(len(x) - WINDOW + 1, np.uint32)
        for k in range(WINDOW):
            h *= np.uint32(0x01000193)
            h += x[k : k + len(h)]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        hit = np.flatnonzero(h % np.uint32(block) == block - 1)
        places.append(hit + at + 1)
        values.append(h[hit])
    return (np.concatenate(places), np.concatenate(values)) if places else (np.zeros(0, np.int64), np.zeros(0, np.uint32))


def signature(raw: bytes, ends: np.ndarray) -> str:
    cuts = ends[: LONGEST - 1].tolist()
    if not cuts or cuts[-1] != len(raw):
        cuts.append(len(raw))
    out, at = [], 0
    for to in cuts:
        out.append(LETTERS[zlib.crc32(raw[at:to]) & 63])
        at = to
    return "".join(out)


def fingerprint(raw: bytes) -> str:
    """block:signature:signature at twice the block. Block sizes are 3 times a power of two; halved while under 32 pieces."""
    if not raw:
        return f"{SMALLEST}::"
    data, block = np.frombuffer(raw, np.uint8), SMALLEST
    while block * LONGEST < len(raw):
        block *= 2
    finest = max(SMALLEST, block // 4)
    places, values = triggers(data, finest)
    while True:
        if block < finest:  # a text of few triggers, such as one letter repeated
            finest = SMALLEST
            places, values = triggers(data, finest)
        ends = places[values % np.uint32(block) == block - 1]
        if len(ends) + 1 >= LONGEST // 2 or block == SMALLEST:
            break
        block //= 2
    double = places[values % np.uint32(2 * block) == 2 * block - 1]
    return f"{block}:{signature(raw, ends)}:{signature(raw, double)}"


def edit_distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """Levenshtein distances of pairs of strings of 1 to 64 letters, bit-parallel over all pairs at once."""
    n = len(pairs)
    one, full = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
    code = {c: k for k, c in enumerate(LETTERS)}
    peq = np.zeros((n, 65), np.uint64)
    length = np.array([len(a) for a, _ in pairs], np.uint64)
    to = np.full((n, LONGEST), 64)
    for k, (a, b) in enumerate(pairs):
        for i, c in enumerate(a):
            peq[k, code[c]] |= np.uint64(1 << i)
        to[k, : len(b)] = [code[c] for c in b]
    vp, vn, score, every = np.full(n, full), np.zeros(n, np.uint64), length.astype(np.int64), np.arange(n)
    for j in range(int(max((len(b) for _, b in pairs), default=0))):
        live = to[:, j] < 64
        eq = peq[every, to[:, j]]
        x = eq | vn
        d0 = (((x & vp) + vp) ^ vp) | x
        hn, hp = vp & d0, vn | ~(vp | d0)
        score += np.where(live, ((hp >> (length - one)) & one).astype(np.int64) - ((hn >> (length - one)) & one).astype(np.int64), 0)
        hp = (hp << one) | one
        vn, vp = np.where(live, hp & d0, vn), np.where(live, (hn << one) | ~(hp | d0), vp)
    return score


def likeness(pairs: list[tuple[str, str]]) -> np.ndarray:
    """0 to 1 for pairs of fingerprints. Equal ones: 1. Block sizes that differ by more than a factor of 2: 0.

    Otherwise the best of 1 - distance / longer length over signatures of one block size that have seven letters in a row
    in common (or of which one has fewer than seven)."""
    out = np.zeros(len(pairs))
    todo, whose = [], []
    for k, (a, b) in enumerate(pairs):
        if a == b:
            out[k] = 1.0
            continue
        (p, a1, a2), (q, b1, b2) = a.split(":"), b.split(":")
        p, q = int(p), int(q)
        for x, y in ([(a1, b1), (a2, b2)] if p == q else [(a1, b2)] if p == 2 * q else [(a2, b1)] if q == 2 * p else []):
            if x and y and (min(len(x), len(y)) < COMMON or any(x[i : i + COMMON] in y for i in range(len(x) - COMMON + 1))):
                todo.append((x, y))
                whose.append(k)
    if todo:
        longer = np.array([max(map(len, p)) for p in todo])
        np.maximum.at(out, np.array(whose), 1 - edit_distances(todo) / longer)
    return out


def sort_keys(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the key that rows are ordered by: order (doc_id, a null one first) and mark, a hash of the text."""
    return texts_of(docs).withColumns({"order": F.coalesce("doc_id", F.lit(-(1 << 63))), "mark": F.xxhash64(F.coalesce("text", F.lit("")))})


def group_of(order: np.ndarray, mark: np.ndarray, cut_order: np.ndarray, cut_mark: np.ndarray) -> np.ndarray:
    """For each key the last cut (ascending keys) that is not above it; 0 for keys below the first."""
    low, high = np.searchsorted(cut_order, order, "left"), np.searchsorted(cut_order, order, "right")
    at = high - 1
    for k in np.flatnonzero((high > low) & (mark < cut_mark[np.minimum(at, len(cut_mark) - 1)])):
        at[k] = low[k] + np.searchsorted(cut_mark[low[k] : high[k]], mark[k], "right") - 1
    return np.maximum(at, 0)


def range_cuts(keyed: DataFrame, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (order, mark) of existing rows that begin about equal ranges by bytes of text, ascending; the first is the least.

    Approximate quantiles of order make some four groups a range. An id that is several quantiles is hot: its rows are cut
    by even steps of mark. Bytes and the least key are summed up by group: at most eight small rows for each range."""
    steps = 4 * ranges
    quantiles = keyed.agg(F.percentile_approx("order", [k / steps for k in range(1, steps)], 20 * steps)).first()[0]
    if not quantiles:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value, times = np.unique(np.array(quantiles, np.int64), return_counts=True)
    least, span = -(1 << 63), 1 << 64
    pairs = [(v, least + k * span // n) for v, n in zip(value.tolist(), times.tolist(), strict=True) for k in range(n)]
    fine_order, fine_mark = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))

    def count(batches):
        for batch in batches:
            order, mark, size = (batch.column(c).to_numpy() for c in ("order", "mark", "size"))
            below = (order < fine_order[0]).astype(np.int64)
            group = np.where(below == 1, -1, group_of(order, mark, fine_order, fine_mark))
            by = np.lexsort((mark, order, group))
            first = by[np.flatnonzero(np.diff(group[by], prepend=-2))]
            total = np.bincount(group + 1, weights=size)[group[first] + 1]
            yield pa.RecordBatch.from_arrays([pa.array(group[first]), pa.array(order[first]), pa.array(mark[first]), pa.array(total.astype(np.int64))], ["group", "order", "mark", "size"])

    sized = keyed.select("order", "mark", (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).cast("long").alias("size"))
    sums = sized.mapInArrow(count, "group long, order long, mark long, size long").groupBy("group").agg(F.min(F.struct("order", "mark")).alias("key"), F.sum("size").alias("size")).collect()
    rows = sorted((r.key.order, r.key.mark, r.size) for r in sums)
    goal, held, cuts = sum(r[2] for r in rows) / ranges, 0, []
    for order, mark, size in rows:
        if not cuts or held + size / 2 > goal * len(cuts):
            cuts.append((order, mark))
        held += size
    return tuple(np.array([c[k] for c in cuts], np.int64) for k in (0, 1))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every row of docs and of its edited text, and their likeness.

    Edited: the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document's text in
    ascending doc_id; after the last comes the first. near_edited and near_next compare the text's fingerprint with the
    edited text's and the next document's. A null text is empty. Rows that share a doc_id are in order of a 64-bit hash of
    the text, then of the text; a null doc_id comes before all others; a single row is its own next. An empty table gives
    no rows; other columns are ignored.

    Rows are dealt once, by ranges of doc_id and hash of about equal bytes, each a partition of its own (see range_cuts());
    the row that begins a range goes to the range before it as well, so that every row meets its next. Equal rows stay in
    one range: they are streamed, and a text equal to the one before is not hashed again.
    """
    keyed = sort_keys(docs)
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut_order, cut_mark = range_cuts(keyed, ranges)

    def deal(batches):
        for batch in batches:
            order, mark = batch.column("order").to_numpy(), batch.column("mark").to_numpy()
            bucket = group_of(order, mark, cut_order, cut_mark)
            head = np.flatnonzero((cut_order[bucket] == order) & (cut_mark[bucket] == mark))
            take = np.concatenate([np.arange(len(order)), head])
            to = np.concatenate([bucket, (bucket[head] - 1) % len(cut_order)])
            twin = np.concatenate([np.zeros(len(order), bool), np.ones(len(head), bool)])
            at = pa.array(take)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in ("doc_id", "text", "order", "mark")), pa.array(to.astype(np.int32)), pa.array(twin)], ["doc_id", "text", "order", "mark", "bucket", "twin"])

    def finish(rows, out):
        likes = likeness([(r[3], r[4]) for r in rows]), likeness([(r[3], r[5]) for r in rows])
        ids, n, sha, own, edited = (list(x) for x in list(zip(*rows, strict=True))[:5])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(sha), pa.array(own), pa.array(edited), pa.array(likes[0]), pa.array(likes[1])], out)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def pair(batches):
        held, rows, last, bucket = None, [], None, None  # held: the row that waits for its next
        for batch in batches:
            for d, text, b, twin in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "twin")), strict=True):
                if twin and (held is None or b != bucket):
                    continue
                text = text or ""
                raw = text.encode()
                mark = last[1] if last is not None and last[0] == raw else fingerprint(raw)
                last = (raw, mark)
                if held is not None:
                    was, whole, own = held
                    n = len(whole)
                    edited = (whole[: n - n // 4] + text[: n // 4]).encode()
                    rows.append((was, n, hashlib.sha256(edited).hexdigest(), own, fingerprint(edited), mark))
                held, bucket = (None, b) if twin else ((d, text, mark), b)
                if len(rows) >= 1000:
                    yield finish(rows, names)
                    rows = []
        if rows:
            yield finish(rows, names)

    dealt = keyed.mapInArrow(deal, "doc_id long, text string, order long, mark long, bucket int, twin boolean").repartitionById(ranges, F.col("bucket")).sortWithinPartitions("twin", "order", "mark", "text")
    return dealt.mapInArrow(pair, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
