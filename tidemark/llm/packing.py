"""Packing of pieces into sequences by the sum-of-squares rule."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed

#: Pieces in a shard, about: what one task packs in some seconds.
SHARD = 50_000


def place(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in order of decreasing length.

    A piece goes to the residual gap for which the sum of the squared numbers of open bins over all gaps becomes smallest;
    a new bin is one more choice, and full bins count for nothing. Ties go to the smallest gap, a new bin last."""
    bins = np.empty(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, np.int64)
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        gaps = np.flatnonzero(count[size:]) + size
        best, rise = -1, 2 * count[capacity - size] + 1 if size < capacity else 0
        if len(gaps):
            left = gaps - size
            rises = 1 - 2 * count[gaps] + np.where(left > 0, 2 * count[left] + 1, 0)
            k = int(np.argmin(rises))
            if rises[k] <= rise:
                best = int(gaps[k])
        if best < 0:
            b, gap, made = made, capacity, made + 1
        else:
            b, gap = open_bins[best].pop(), best
            count[best] -= 1
        bins[i], offset[i] = b, capacity - gap
        if gap > size:
            open_bins[gap - size].append(b)
            count[gap - size] += 1
    return bins, offset


def packed(pieces: DataFrame, capacity: int = 2048, shard: int = SHARD) -> DataFrame:
    """pieces (columns doc_id, piece, length from 1 to capacity, and others) with sequence_id and offset.

    Pieces are dealt by their place in the written table into shards of about shard pieces, each packed on its own in one
    task. What lies in sequences that are part-empty then is dealt and packed again, together with that of all other
    shards, as long as that makes their number smaller by one in a thousand or one shard holds it: so shards don't each
    leave a remainder of their own. A round that wins less is not used. Equal rows (whatever their doc_id) are dealt apart. Sequence ids of shards and rounds don't meet. Offsets are gapless from 0
    within a sequence. Null doc_ids and repeated rows are pieces like any other; an empty table gives no rows. Columns named
    sequence_id or offset are replaced.
    """
    names = [n for n in pieces.columns if n.lower() not in ("sequence_id", "offset", "_shard")]
    rows, done, turn = checkpointed(pieces.select(*names)), [], 0
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    count = rows.count()

    def packer(turn: int):
        def pack(held: pa.Table) -> pa.Table:
            held = held.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
            lengths = held.column("length").to_numpy()
            bins, offset = place(lengths, capacity)
            number = (turn << 24) + held.column("_shard")[0].as_py()
            full = np.bincount(bins, weights=lengths)[bins] == capacity
            return held.select(names).append_column("sequence_id", pa.array((number << 32) + bins)).append_column("offset", pa.array(offset)).append_column("_full", pa.array(full))

        return pack

    held, n_held = None, 0  # the pieces in part-empty sequences as the last round packed them, and the number of these sequences
    while True:
        shards = max(1, -(-count // shard))
        # places in a checkpoint are the same whenever they are read again
        dealt = rows.withColumn("_shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)))
        found = checkpointed(dealt.groupBy("_shard").applyInArrow(packer(turn), f"{kinds}, sequence_id long, offset long, _full boolean"))
        part = found.where("not _full")
        # a sequence has one piece at 0
        seen = found.agg(F.count_if(F.col("offset") == 0).alias("all"), F.count_if((F.col("offset") == 0) & ~F.col("_full")).alias("part"), F.count_if(~F.col("_full")).alias("rest")).first()
        if held is not None and seen["all"] >= n_held - n_held // 1000:
            done.append(held)
            break
        done.append(found.where("_full").drop("_full"))
        if shards == 1 or not seen["rest"]:
            done.append(part.drop("_full"))
            break
        held, n_held = part.drop("_full"), seen["part"]
        rows, count, turn = part.select(*names), seen["rest"], turn + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
