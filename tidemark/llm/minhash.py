"""Near-duplicates by an inverted join over MinHash signature coordinates, confirmed on whole shingle sets."""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, Workspace, beside, mixed, parts, texts_of, utf8, window_hashes, windows, word_hashes, words
from tidemark.llm.components import components

#: Bytes of text whose shingles are held at once; a longer text alone.
PART_BYTES = 1 << 20


def least_matches(coordinates: int, similarity: float, miss: float = 1e-7) -> int:
    """The most equal coordinates to ask for so that a pair of this similarity has fewer with probability miss at most."""
    below, t = 0.0, 0
    while t < coordinates:
        below += comb(coordinates, t) * similarity**t * (1 - similarity) ** (coordinates - t)
        if below > miss:
            break
        t += 1
    return max(1, t)


def shingle_sets(batch: pa.RecordBatch, size: int):
    """For each row the ascending distinct 64-bit hashes of its shingles; A-Z are lower-cased before."""
    offsets, data = utf8(batch.column("text"))
    data = LOWER[data]
    starts, ends, row = words(offsets, data)
    hashes = word_hashes(data, starts, ends)
    first = windows(row, size)
    shingles = window_hashes(hashes, first, size)
    at = np.searchsorted(row[first], np.arange(batch.num_rows + 1)) if len(first) else np.zeros(batch.num_rows + 1, np.int64)
    word_at = np.searchsorted(row, np.arange(batch.num_rows + 1))
    for r in range(batch.num_rows):
        a, b = word_at[r], word_at[r + 1]
        if b - a >= size:
            yield np.unique(shingles[at[r] : at[r + 1]])
        elif b > a:  # fewer words: the whole sequence as one, apart from all full shingles
            yield mixed(window_hashes(hashes, np.array([a]), b - a) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def signatures(docs: DataFrame, size: int, coordinates: int) -> DataFrame:
    """doc_id, mark, n_shingles, the set's 128-bit fingerprint (fa, fb) and its MinHash signature, for every row (columns
    doc_id, mark, text)."""
    seeds = mixed(np.arange(1, 2 * coordinates + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    masks, factors = seeds[:coordinates, None], seeds[coordinates:, None] | np.uint64(1)

    def rows(batches):
        for batch in parts(batches, PART_BYTES):
            n, marks, sigs = [], [], []
            for found in shingle_sets(batch, size):
                n.append(len(found))
                marks.append(xxhash.xxh3_128_digest(found.tobytes()))
                least = np.full(coordinates, np.uint64(0xFFFFFFFFFFFFFFFF))
                for k in range(0, len(found), 4096):
                    np.minimum(least, ((found[None, k : k + 4096] ^ masks) * factors).min(axis=1), out=least)
                sigs.append((least >> np.uint64(32)).astype(np.uint32).view(np.int32))
            mark = np.frombuffer(b"".join(marks), "<i8").reshape(-1, 2)
            flat = pa.array(np.concatenate(sigs))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * coordinates), flat)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(n, pa.int64()), pa.array(mark[:, 0]), pa.array(mark[:, 1]), lists], ["doc_id", "mark", "n_shingles", "fa", "fb", "sig"])

    return docs.mapInArrow(rows, "doc_id long, mark long, n_shingles long, fa long, fb long, sig array<int>")


def sets(docs: DataFrame, size: int) -> DataFrame:
    """node, copies and shingles (array<long>, distinct) of every row (columns node, copies, text)."""

    def rows(batches):
        for batch in parts(batches, PART_BYTES):
            found = [x.view(np.int64) for x in shingle_sets(batch, size)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), pa.array(found, pa.list_(pa.int64()))], ["node", "copies", "shingles"])

    return docs.select("node", "copies", "text").mapInArrow(rows, "node long, copies long, shingles array<long>")


def marked(rows: DataFrame, text: str, size: int = 5) -> DataFrame:
    """rows (one column, row: a struct with a field of this name for the text) with fa and fb, the fingerprint of each row's
    shingle set."""

    def mark(batches):
        for batch in batches:
            at, own = 0, pa.RecordBatch.from_arrays([batch.column("row").field(text)], ["text"])
            for part in parts(iter([own]), PART_BYTES):
                found = b"".join(xxhash.xxh3_128_digest(x.tobytes()) for x in shingle_sets(part, size))
                marks = np.frombuffer(found, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(at, part.num_rows), pa.array(marks[:, 0]), pa.array(marks[:, 1])], ["row", "fa", "fb"])
                at += part.num_rows

    return rows.mapInArrow(mark, f"row {rows.schema['row'].dataType.simpleString()}, fa long, fb long")


def kept_rows(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates() keeps, by doc_id and shingle set: one row
    of those that share both doc_id and shingle set (by a hash of all columns), and every row with a null doc_id."""
    own = {n.lower(): n for n in docs.columns}
    row = F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row")
    key = ["id", "fa", "fb"]
    kept = judged(docs, percent, size).where("kept and doc_id is not null").select(F.col("doc_id").alias("id"), "fa", "fb").distinct()
    known = marked(docs.where("doc_id is not null").select(row), own["text"], size).withColumn("id", F.col("row")[own["doc_id"]].cast("long"))
    # maps have no hash
    text = F.to_json("row") if "map<" in known.schema["row"].dataType.simpleString() else F.col("row")
    one = known.join(kept, key, "left_semi").groupBy(*key).agg(F.min_by("row", F.xxhash64(text)).alias("row"))
    return one.select("row.*").unionByName(docs.where("doc_id is null"))


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, coordinates: int = 48) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (columns doc_id, text).

    Two rows are linked if 100 * intersection >= percent * union of their shingle sets (size words each; a shorter text is
    one shingle, one without words has none and no links). component_id is the smallest doc_id reachable over links.
    Rows of equal sets form a class, one node of the search:

    1. it is posted under each (coordinate, value) of its signature; values posted once are dropped;
    2. a node with fewer shared lists than the match threshold t can have no partner and is dropped; of k shared ones,
       rarest first, the first k - t + 1 are merged (two nodes with t equal values share one of these), the others skipped;
    3. each merged list has a head, the node with the most company in all its lists. Joining nodes with the heads of their
       lists and counting gives collisions of node and head; skipped lists are only probed for these pairs. Pairs with t
       collisions are confirmed on whole sets;
    4. a list whose nodes all hang together by these links is done. In the others pairs come from what nodes have against
       the head (see _across), which leaves out pairs that can be links only if both go with the head.

    A pair at the limit is missed with probability 1e-7 at most, from the choice of t; nothing else is left out. A null
    doc_id has a null component and is kept. Rows that share a doc_id are judged each by its own text. An empty table
    gives no rows; other columns are ignored. Lists, heads and sets that many nodes meet are dealt to several tasks (see
    common.beside()). Tables in between are written below spark.checkpoint.dir and deleted; the result's stays.
    """
    return judged(docs, percent, size, coordinates).select("doc_id", "n_shingles", "component_id", "kept")


def judged(docs: DataFrame, percent: int = 80, size: int = 5, coordinates: int = 48) -> DataFrame:
    """near_duplicates() with the fingerprint (fa, fb) of each row's shingle set."""
    source, space = texts_of(docs).withColumn("mark", F.xxhash64("text")), Workspace(docs.sparkSession)
    base = space.keep(signatures(source, size, coordinates))
    able = base.where("doc_id is not null and n_shingles > 0")
    first_row = F.min(F.struct("doc_id", "mark"))  # of all rows of a class: the smallest doc_id, and which text of it
    classes = able.groupBy("fa", "fb").agg(first_row.alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    classes = space.keep(classes.select("fa", "fb", "rep.doc_id", "rep.mark", "sig", "n", F.monotonically_increasing_id().alias("node")))
    least = least_matches(coordinates, percent / 100)

    key = F.shiftleft(F.col("at").cast("long"), 32) + F.col("value").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    posts = classes.select("node", "n", F.posexplode("sig").alias("at", "value")).select("node", "n", key.alias("key"))
    shared = space.keep(posts.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"))
    found = beside(posts, shared, "key", shared.select("key", F.col("df").alias("n")), classes.count() * coordinates)
    lists = found.groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("keys"), F.sum("df").alias("company")).where(F.size("keys") >= least)
    lists = space.keep(lists.select("node", "n", "company", F.transform("keys", lambda k: k["key"]).alias("keys")))
    merged = lists.select("node", "company", F.explode(F.expr(f"slice(keys, 1, size(keys) - {least} + 1)")).alias("key"))
    heads = merged.groupBy("key").agg(F.max(F.struct("company", (-F.col("node")).alias("node"))).alias("top"), F.count("*").alias("n"))
    heads = space.keep(heads.select("key", (-F.col("top.node")).alias("head"), "n"))
    n_merged = heads.agg(F.sum("n")).first()[0] or 0
    placed = space.keep(beside(merged.select("node", "key"), heads.select("key", "head"), "key", heads.select("key", "n"), n_merged))

    # the set of a class is made from its first row; if that is there several times, one set is kept
    asked = classes.join(lists.select("node"), "node", "left_semi").select("doc_id", "mark", "node")
    copies = able.groupBy("doc_id", "mark").agg(F.count("*").alias("copies"))
    made = space.keep(sets(source.join(asked.join(copies, ["doc_id", "mark"]), ["doc_id", "mark"]), size))
    held = made.where("copies = 1").unionByName(made.where("copies > 1").dropDuplicates(["node"])).drop("copies")

    def with_sets(pairs: DataFrame) -> DataFrame:
        """pairs (a, b and others; a table) with both sets, x and y."""
        own = pairs.join(held.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
        counts = pairs.groupBy("b").agg(F.count("*").alias("n"))
        return beside(own, held.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b", counts, pairs.count())

    def collided(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, met: the lists in which they were counted; a table) whose collisions in all lists reach the threshold."""
        own = pairs.join(lists.select(F.col("node").alias("a"), F.col("keys").alias("keys_a"), F.col("n").alias("n_a")), "a")
        counts = pairs.groupBy("b").agg(F.count("*").alias("n"))
        both = beside(own, lists.select(F.col("node").alias("b"), F.col("keys").alias("keys_b"), F.col("n").alias("n_b")), "b", counts, pairs.count())
        probed = F.size(F.array_intersect(F.array_except("keys_a", "met"), "keys_b"))
        likely = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
        return both.where(likely & (F.size("met") + probed >= least)).select("a", "b")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Those pairs (a, b; a table) that are links."""
        both = F.size(F.array_intersect("x", "y"))
        return with_sets(pairs).where(both * 100 >= (F.size("x") + F.size("y") - both) * percent).select("a", "b")

    met = placed.where("node <> head").groupBy(F.col("node").alias("a"), F.col("head").alias("b")).agg(F.collect_list("key").alias("met"))
    links = space.keep(confirmed(space.keep(collided(space.keep(met)))))

    # what hangs together by one or two steps over heads, which is enough to skip nearly all lists
    first = links.groupBy("a").agg(F.min("b").alias("own"))
    of_head = links.select("b").distinct().join(first.select(F.col("a").alias("b"), "own"), "b", "left").select("b", F.least("b", "own").alias("own"))
    named = links.join(of_head, "b").select("a", "own").union(of_head.select("b", "own")).groupBy("a").agg(F.min("own").alias("own"))
    known = space.keep(named.select(F.col("a").alias("node"), "own"))
    owned = space.keep(placed.join(known, "node", "left").select("key", "node", "head", F.coalesce("own", "node").alias("own")))
    open_lists = space.keep(owned.groupBy("key").agg(F.min("own").alias("lo"), F.max("own").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("key", "n"))
    unsure = beside(owned.where("node <> head"), open_lists.select("key"), "key", open_lists, n_merged).select(F.col("node").alias("a"), F.col("head").alias("b"), "own").distinct()
    across = space.keep(_across(with_sets(space.keep(unsure)), percent, space).withColumn("met", F.array().cast("array<bigint>")))
    more = confirmed(space.keep(collided(across)))
    final = components(links.union(more), space)

    owner = space.keep(classes.select("fa", "fb", "doc_id", "node").join(final, "node", "left").select("fa", "fb", "doc_id", F.coalesce("component", "node").alias("component")))
    sizes = space.keep(owner.groupBy("component").agg(F.min("doc_id").alias("found"), F.count("*").alias("n")))
    whose = beside(owner.select("fa", "fb", "component"), sizes.select("component", "found"), "component", sizes.select("component", "n"), owner.count()).select("fa", "fb", "found")
    out = base.drop("sig", "mark").join(whose, ["fa", "fb"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("found")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(component)
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "fa", "fb").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    last = space.mark()
    out = space.keep(out)
    space.drop(0, last)
    return out


def _across(rows: DataFrame, percent: int, space: Workspace) -> DataFrame:
    """Pairs (a, b) of nodes of one head that may be links; rows: a, b (the head), own (what a hangs with), sets x and y.

    Against the head h, a node z has extra shingles U and lacks shingles D; together they are its difference. For two
    nodes let o be the size of the common part of their differences.
    - If o is at most m = min(|U|, |D|) of the one, their union is no smaller than that of h and the other, and their
      intersection no larger than that of h and the other: if they are linked, so is the other to h. So a link of a
      node w that is not linked to h has o > m of its partner z. If neither is linked to h, o exceeds both: then z is
      the one with the larger m, so that each pair is looked for once.
    - A link also needs o >= |difference| - |z| (100 - percent) / percent for both, by the size of what sets a link apart.
    - The intersection of z and w is |h| - |D of z| - |D of w| + o, so that a link of these two needs an o of their own. At a
      common shingle no more can be common than what either has from there on, which rules most pairs out at once.
    Of a difference, rarest shingles first, a prefix is enough for either of the first bounds; a pair needs a common shingle
    in the shorter prefix of z and the longer of w. Copies edited in places of their own share next to nothing.
    """
    extra, lacking = F.array_except("x", "y"), F.array_except("y", "x")
    diffs = rows.select("a", F.col("b").alias("h"), "own", F.size("x").alias("n"), F.size("y").alias("n_h"), extra.alias("u"), lacking.alias("d"))
    linked = (F.col("n") - F.size("u")) * 100 >= (F.col("n_h") + F.size("u")) * percent
    m, total = F.least(F.size("u"), F.size("d")), F.size("u") + F.size("d")
    need = total - F.floor(F.col("n") * (100 - percent) / percent).cast("int")
    diffs = diffs.select("a", "h", "own", "n", linked.alias("linked"), (F.col("n") - F.size("u")).alias("both"), F.col("n_h"), m.alias("m"), F.concat("u", "d").alias("diff"), (total - F.greatest(m + 1, need) + 1).alias("short"), (total - F.greatest(F.lit(1), need) + 1).alias("long")).where("long > 0")
    diffs = space.keep(diffs)
    parts_ = diffs.select("a", "h", F.explode("diff").alias("e"))
    df = parts_.groupBy("h", "e").agg(F.count("*").alias("df")).where("df > 1")
    # shingles of one node only take places of a prefix, but post nothing
    shared = parts_.join(df, ["h", "e"]).groupBy("a", "h").agg(F.sort_array(F.collect_list(F.struct("df", "e"))).alias("keys"))
    posts = diffs.join(shared, ["a", "h"]).select("a", "h", "own", "n", "linked", "both", "n_h", "m", F.size("keys").alias("k"), (F.col("short") - F.size("diff") + F.size("keys")).alias("short"), F.expr("slice(keys, 1, greatest(0, long - size(diff) + size(keys)))").alias("keys"))
    posts = space.keep(posts.select("a", "h", "own", "n", "linked", "both", "n_h", "m", "k", "short", F.posexplode("keys.e").alias("at", "e")))
    other = posts.where("not linked").select("h", "e", *[F.col(c).alias(f"{c}_w") for c in ("a", "own", "n", "m", "both", "k", "at")])
    once = F.col("linked") | (F.struct("m", "a") > F.struct("m_w", "a_w"))
    sizes = F.least("n", "n_w") * 100 >= F.greatest("n", "n_w") * percent
    # both is |h| - |D|: the intersection is both + both_w - |h| + o
    in_common = F.least(F.col("k") - F.col("at"), F.col("k_w") - F.col("at_w")) + F.col("both") + F.col("both_w") - F.col("n_h")
    able = in_common * (100 + percent) >= (F.col("n") + F.col("n_w")) * percent
    pairs = posts.where("at < short").join(other, ["h", "e"]).where((F.col("own") != F.col("own_w")) & once & sizes & able)
    return pairs.select(F.greatest("a", "a_w").alias("a"), F.least("a", "a_w").alias("b")).distinct()
