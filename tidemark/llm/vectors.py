"""Product codes of vectors: k-means over each part in whole numbers, by Lloyd's steps with one upper and one lower bound a part."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, beside

#: Rows that are compared with a codebook at once, and the largest whole component (four times its square, summed over a
#: part of 4,096 components, fits into a long).
BLOCK, LARGEST = 4096, 1 << 24
#: Bounds are widened by this part at each step, far more than arithmetic of doubles can be wrong.
WIDER, NARROWER = 1 + 1e-12, 1 - 1e-12
STATE = "vec_id long, label string, x array<int>, code binary, upper array<double>, lower array<double>, error long, sums binary"


def whole_rows(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Places of the rows whose vector is there and has finite components only, and their floor(scale * x)."""
    column = batch.column("embedding")
    offsets = np.asarray(column.offsets)
    values = column.values
    good = np.isfinite(values.fill_null(np.nan).to_numpy(zero_copy_only=False)) if len(values) else np.zeros(0, bool)
    bad = np.r_[0, np.cumsum(~good)]
    kept = np.flatnonzero((bad[offsets[1:]] == bad[offsets[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False))
    with np.errstate(invalid="ignore", over="ignore"):
        whole = np.floor(values.fill_null(0.0).to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    found = [whole[offsets[r] : offsets[r + 1]] for r in kept]
    if any(len(v) and np.abs(v).max() > LARGEST for v in found):
        raise ValueError(f"a component is beyond {LARGEST / scale:g}: distances would not fit into a long")
    return kept, [v.astype(np.int32) for v in found]


def whole_vectors(embeddings: DataFrame, scale: int) -> DataFrame:
    """vec_id, label (as text) and x of the rows that are kept."""
    typed = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))

    def rows(batches):
        for batch in batches:
            kept, vectors = whole_rows(batch, scale)
            if len(kept):
                own = batch.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([own.column("vec_id"), own.column("label"), pa.array(vectors, pa.list_(pa.int32()))], ["vec_id", "label", "x"])

    return typed.mapInArrow(rows, "vec_id long, label string, x array<int>")


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of x to all entries of book (whole numbers)."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 1 << 53:  # every sum on the way is a whole number that a double holds
        x, book = x.astype(np.float64), book.astype(np.float64)
    return ((x * x).sum(1)[:, None] - 2 * (x @ book.T) + (book * book).sum(1)).astype(np.int64)


class Step:
    """One assignment: the codebook of a part, how far its entries have moved since the last one, and half of each entry's
    distance to the nearest other one."""

    def __init__(self, book: np.ndarray, before: np.ndarray | None):
        self.book = book
        gaps = np.sqrt(distances(book, book).astype(np.float64))
        np.fill_diagonal(gaps, np.inf)
        self.half_gap = gaps.min(1, initial=np.inf) / 2 * NARROWER
        self.moved = None
        if before is not None:
            self.moved = np.sqrt(((book - before) ** 2).sum(1).astype(np.float64)) * WIDER
            first = int(np.argmax(self.moved))
            self.others = np.full(len(book), self.moved[first])  # the most that any other entry has moved
            self.others[first] = np.delete(self.moved, first).max(initial=0.0)

    def assign(self, x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Brings code and bounds of the rows of x up to date; returns how many rows had to be compared with all entries."""
        open_ = np.arange(len(x))
        if self.moved is not None:
            upper[:] = (upper + self.moved[code]) * WIDER
            lower[:] = lower * NARROWER - self.others[code] * WIDER
            bound = np.maximum(lower, self.half_gap[code])
            open_ = np.flatnonzero(~(upper < bound))  # at a tie a lower index may be as near
            exact = ((x[open_] - self.book[code[open_]]) ** 2).sum(1)
            upper[open_] = np.sqrt(exact.astype(np.float64)) * WIDER
            open_ = open_[~(upper[open_] < bound[open_])]
        for at in range(0, len(open_), BLOCK):
            rows = open_[at : at + BLOCK]
            far = distances(x[rows], self.book)
            best = far.argmin(1)  # the lowest index of equal ones
            every = np.arange(len(rows))
            code[rows], upper[rows] = best, np.sqrt(far[every, best].astype(np.float64)) * WIDER
            far[every, best] = np.iinfo(np.int64).max
            lower[rows] = np.sqrt(far.min(1).astype(np.float64)) * NARROWER
        return len(open_)


def cuts(length: int, parts: int) -> list[int]:
    """Where the parts of a vector begin and end."""
    return [length * p // parts for p in range(parts + 1)]


def assigned(state: DataFrame, books: list[np.ndarray], before: list[np.ndarray] | None, last: bool = False) -> DataFrame:
    """The state after one assignment: code and bounds of every row, and for each task one row more that holds the counts
    and sums of all entries. last: each row's squared distance instead, exactly."""
    steps = [Step(b, None if before is None else before[p]) for p, b in enumerate(books)]
    ends = np.cumsum([0, *(b.shape[1] for b in books)])
    parts, entries, width = len(books), len(books[0]), max(b.shape[1] for b in books)

    def rows(batches):
        sums, n = np.zeros((parts, entries, width + 1), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            x = np.asarray(batch.column("x").flatten()).reshape(batch.num_rows, ends[-1]).astype(np.int64)
            code, upper, lower = np.zeros((parts, len(x)), np.int64), np.full((parts, len(x)), np.inf), np.zeros((parts, len(x)))
            if before is not None:
                code[:] = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts).T
                upper[:], lower[:] = (np.asarray(batch.column(c).flatten()).reshape(-1, parts).T for c in ("upper", "lower"))
            error = np.zeros(len(x), np.int64)
            for p, step in enumerate(steps):
                own = x[:, ends[p] : ends[p + 1]]
                step.assign(own, code[p], upper[p], lower[p])
                if last:
                    error += ((own - step.book[code[p]]) ** 2).sum(1)
                elif len(x):
                    order = np.argsort(code[p], kind="stable")
                    used, begin, n_used = np.unique(code[p][order], return_index=True, return_counts=True)
                    sums[p, used, 0] += n_used
                    sums[p, used, 1 : own.shape[1] + 1] += np.add.reduceat(own[order], begin, axis=0)
            codes = [bytes(c) for c in code.T.astype(np.uint8)]
            lists = pa.array(np.arange(len(x) + 1, dtype=np.int32) * parts)
            bounds = [pa.nulls(len(x), pa.list_(pa.float64())) if last else pa.ListArray.from_arrays(lists, pa.array(b.T.ravel())) for b in (upper, lower)]
            vectors = pa.nulls(len(x), pa.list_(pa.int32())) if last else batch.column("x")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), vectors, pa.array(codes, pa.binary()), *bounds, pa.array(error), pa.nulls(len(x), pa.binary())], names)
        if n and not last:
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array([sums.tobytes()], pa.binary())], names)

    names = [f.split()[0] for f in STATE.split(", ")]
    return state.mapInArrow(rows, STATE)


def stepped(sums: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one step: each entry the floor of its parts' mean; unused ones stay. sums: one column, bytes."""
    shape = (len(books), len(books[0]), max(b.shape[1] for b in books) + 1)

    def cells(batches):
        total = np.zeros(shape, np.int64)
        for batch in batches:
            for value in batch.column("sums").to_pylist():
                total += np.frombuffer(value, np.int64).reshape(shape)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "value"])

    # as many rows as the codebooks have numbers, however many vectors there are
    found = sums.mapInArrow(cells, "at long, value long").groupBy("at").agg(F.sum("value").alias("value")).collect()
    total = np.zeros(shape, np.int64)
    for r in found:
        total.ravel()[r["at"]] = r["value"]
    n = total[:, :, :1]
    return [np.where(n[p] > 0, total[p, :, 1 : b.shape[1] + 1] // np.maximum(n[p], 1), b) for p, b in enumerate(books)]


def vector_codes(embeddings: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row of embeddings (vec_id, embedding, label) that is kept.

    Components become floor(scale * x); a vector is cut into parts, each with a codebook that starts as the parts of the first
    vectors by vec_id (equal ones by their components; null ids last; fewer vectors make fewer entries). Each round assigns
    every part to its nearest entry, the lower index at a tie, and moves entries to the floor of their parts' mean. Assignment
    keeps an upper bound of the distance to the own entry and a lower one to the second nearest, widened by how far entries
    moved; only where the upper isn't strictly less than the lower bound (or half of the way to the next entry) a part is
    compared with all entries, in whole numbers. error: squared distances to the final entries over all parts; label_error: their
    sum over equal labels, nulls together; codebooks_sha256: of all entries' components.

    Rows whose vector is null or has null or infinite components or NaN are dropped, and those of another length than the first
    vector's. Empty vectors have code 0 and error 0. Lengths that parts don't divide are cut at floor(length * p / parts).
    Components beyond 16,384 raise an error, as distances wouldn't fit. A null vec_id is coded like any other; repeated rows
    count as often as they are there; an empty table gives no rows; other columns are ignored.

    Each round reads the state of the one before (written below spark.checkpoint.dir, then deleted), writes its own and, in a
    column that only those rows have, the sums of each task: vectors don't move between tasks, and the driver gets as many
    numbers as the codebooks have."""
    if not 1 <= entries <= 256:
        raise ValueError("entries: 1 to 256, a byte of code for each part")
    space = Workspace(embeddings.sparkSession)
    state = space.keep(whole_vectors(embeddings, scale))
    first = [np.array(r["x"], np.int64) for r in state.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()]
    length = len(first[0]) if first else 0
    first = [v for v in first if len(v) == length]
    if length and len(first) < entries:  # there may be more of this length
        top = state.where(F.size("x") == length).orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
        first = [np.array(r["x"], np.int64) for r in top]
    state = state.where(F.size("x") == length)
    at = cuts(length, parts)
    books = [np.array([v[at[p] : at[p + 1]] for v in first], np.int64).reshape(len(first), at[p + 1] - at[p]) for p in range(parts)]
    before = None
    if first:
        for _ in range(rounds):
            done = space.mark()
            state = space.keep(assigned(state.where("x is not null"), books, before))
            before, books = books, stepped(state.where("sums is not null").select("sums"), books)
            space.drop(done - 1, done)
        state = assigned(state.where("x is not null"), books, before, last=True)
    else:
        state = state.select("vec_id", "label", F.lit(b"").alias("code"), F.lit(0).cast("long").alias("error"))
    done = space.mark()
    coded = space.keep(state.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", F.coalesce(F.concat(F.lit("="), F.col("label")), F.lit("")).alias("label")))
    space.drop(done - 1, done)
    totals = space.keep(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    together = beside(coded, totals.select("label", "label_error"), "label", totals.select("label", "n"), coded.count())
    said = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return together.select("vec_id", "code", "error", "label_error", F.lit(said).alias("codebooks_sha256"))
