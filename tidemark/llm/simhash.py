"""Near-duplicates by SimHash: fingerprints over word shingles, linked by a grid join over the bit counts of their segments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, SPACE, Workspace, beside, parts, texts_of, utf8, words
from tidemark.llm.components import components

#: Bytes of text whose shingles are held at once (a longer text alone), and shingles whose bits are summed at once.
PART_BYTES, BLOCK = 1 << 20, 1 << 16


def joined_words(offsets: np.ndarray, data: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The words of all rows with one space between those of a row, and their starts, ends and rows; A-Z are lower-cased."""
    data = LOWER[data]
    starts, ends, row = words(offsets, data)
    keep = ~SPACE[data]
    between = ends[:-1][row[1:] == row[:-1]] if len(ends) else ends
    keep[between] = True
    data[between] = 0x20
    place = np.cumsum(keep) - keep
    return data[keep].tobytes(), place[starts], place[ends - 1] + 1, row


def text_fingerprints(batch: pa.RecordBatch, size: int, seed: int) -> np.ndarray:
    """The 64-bit SimHash of each text: a bit is set if over half of the shingles' XXH64 have it; without words it is zero."""
    text, starts, ends, row = joined_words(*utf8(batch.column("text")))
    word_at = np.searchsorted(row, np.arange(batch.num_rows + 1))
    n_words = np.diff(word_at)
    n = np.where(n_words >= size, n_words - size + 1, np.minimum(n_words, 1))  # fewer words: the whole sequence as one
    span = np.minimum(n_words, size)
    of = np.repeat(np.arange(batch.num_rows), n)
    first = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + word_at[of]
    begins, stops = starts[first], ends[first + span[of] - 1]
    counts = np.zeros((batch.num_rows, 64), np.int64)
    for at in range(0, len(of), BLOCK):
        pairs = zip(begins[at : at + BLOCK].tolist(), stops[at : at + BLOCK].tolist(), strict=True)
        own = of[at : at + BLOCK]
        hashes = np.fromiter((xxhash.xxh64_intdigest(text[a:b], seed) for a, b in pairs), "<u8", len(own))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        rows = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        counts[own[rows]] += np.add.reduceat(bits, rows, axis=0, dtype=np.int32)
    return np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<i8").ravel()


def prints(docs: DataFrame, size: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long, of every row of docs (columns doc_id, text)."""

    def rows(batches):
        for batch in parts(batches, PART_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text_fingerprints(batch, size, seed))], ["doc_id", "fp"])

    return docs.mapInArrow(rows, "doc_id long, fp long")


#: Segments of two bits each: their bit counts, 0 to 2, fit into the segment's own place.
SEGMENTS = 32
LOW_BITS = 0x5555555555555555


def segment_counts(fp: Column) -> Column:
    """The bit counts of all segments of fp, packed into one long."""
    a, b = fp.bitwiseAND(F.lit(LOW_BITS)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(LOW_BITS))
    return a.bitwiseXOR(b).bitwiseOR(F.shiftleft(a.bitwiseAND(b), 1))  # no sum: it could overflow


def parts_of_segments(distance: int) -> list[range]:
    """Segments in as few parts as leave, of a Manhattan distance of distance, at most 1 to one of them."""
    n = distance // 2 + 1
    return [range(SEGMENTS * p // n, SEGMENTS * (p + 1) // n) for p in range(n)]


def cells(prints_: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """(cells, probes) of a table with fp: each fingerprint's grid cell in every part, and the cells it looks into: its own
    (same), and those with one bit less in one segment, so that of two points one step apart one looks and one is found."""
    counts, own, near = segment_counts(F.col("fp")), [], []
    for p, segments in enumerate(parts_of_segments(distance)):
        mask = sum(3 << 2 * k for k in segments)
        at = counts.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))
        own.append(F.xxhash64(F.lit(p), at))
        for k in segments:
            here = F.shiftright(counts, 2 * k).bitwiseAND(F.lit(3))  # 1 becomes 0, and 2 (both bits change) becomes 1
            step = F.shiftleft(F.when(here == 1, F.lit(1)).when(here == 2, F.lit(3)).cast("long"), 2 * k)
            near.append(F.when(here > 0, F.xxhash64(F.lit(p), at.bitwiseXOR(step))))
    there = prints_.select("*", F.explode(F.array(*own)).alias("cell"))
    looks = F.concat(F.transform(F.array(*own), lambda c: F.struct(c.alias("cell"), F.lit(True).alias("same"))), F.transform(F.array_compact(F.array(*near)), lambda c: F.struct(c.alias("cell"), F.lit(False).alias("same"))))
    return there, prints_.select("*", F.explode(looks).alias("look")).select(*prints_.columns, "look.cell", "look.same")


def one_bit_links(own: DataFrame) -> DataFrame:
    """Pairs (a, b) of fingerprints that differ by one bit: the one with the bit looks for itself without it. No key has many
    rows, whatever the fingerprints are."""
    fewer = [F.when(F.shiftright("fp", k).bitwiseAND(F.lit(1)) == 1, F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), k))) for k in range(64)]
    return own.select(F.col("fp").alias("a"), F.explode(F.array_compact(F.array(*fewer))).alias("b")).join(own.select(F.col("fp").alias("b")).hint("merge"), "b", "left_semi").select("a", "b")


def near_duplicates(docs: DataFrame, size: int = 3, seed: int = 42, distance: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of docs (columns doc_id, text).

    A fingerprint's bit is 1 if over half of the XXH64 of its shingles (size words each, repeats included; fewer words: all of
    them as one) have it. Fingerprints that differ in distance bits or less are linked; component_id is the smallest doc_id
    reachable over links. Each distinct fingerprint is one point of the search:

    1. links of one bit are looked up, and points that hang together by them get a common group;
    2. a point is the bit counts of its 32 segments. The Manhattan distance of two points is never more than the number of
       differing bits, so that of the parts of a linked pair's segments one is at most 1 apart. A grid join by parts finds
       these pairs: each point is in one cell of every part and looks into that and those one step below;
    3. pairs of different groups are verified by their differing bits; groups and these links make the components.

    Nothing is left out. Cells with many points are dealt to several tasks, and so are rows of a common fingerprint. Null and
    empty texts and those without words have fingerprint zero and are linked like any other; a null doc_id has a fingerprint
    and a null component, and links nothing. Rows that share a doc_id are judged each by its own text; an empty table gives
    no rows; other columns are ignored. A text is read whole, its shingles in blocks. Tables in between are written below
    spark.checkpoint.dir and deleted; the result's stays.
    """
    space = Workspace(docs.sparkSession)
    base = space.keep(prints(texts_of(docs), size, seed))
    own = space.keep(base.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")))
    first = components(one_bit_links(own), space)
    grouped = space.keep(own.select("fp").join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("grp")))

    there, looks = cells(grouped, distance)
    n_there = there.groupBy("cell").agg(F.count("*").alias("n"))
    looks = looks.select("cell", F.col("fp").alias("fp_a"), F.col("grp").alias("grp_a"), "same")
    met = beside(there.select("fp", "grp", "cell"), looks, "cell", n_there, own.count() * len(parts_of_segments(distance)))
    once = ~F.col("same") | (F.col("fp_a") < F.col("fp"))
    links = met.where(once & (F.col("grp") != F.col("grp_a")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_a"))) <= distance))
    last = components(links.select(F.col("grp_a").alias("a"), F.col("grp").alias("b")).distinct(), space)

    whole = grouped.join(last.withColumnRenamed("node", "grp"), "grp", "left").select("fp", F.coalesce("component", "grp").alias("whole"))
    owner = space.keep(own.join(whole, "fp"))
    least = space.keep(owner.groupBy("whole").agg(F.min("rep").alias("component_id"), F.count("*").alias("n")))
    points = beside(owner.select("fp", "whole"), least.select("whole", "component_id"), "whole", least.select("whole", "n"), own.count()).select("fp", "component_id")
    rows = beside(base.where("doc_id is not null").select("doc_id", "fp"), points, "fp", own.select("fp", "n"), base.count()).select("doc_id", "fp", "component_id")
    rows = rows.unionByName(base.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long")))
    out_from = space.mark()
    out = space.keep(rows.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))
    space.drop(0, out_from)
    return out
