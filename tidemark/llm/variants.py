"""Spelling variants: words one letter apart, by walking compact tries of the vocabulary with each word's automaton."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, Workspace, parts, texts_of, trim, utf8

#: Bytes of text that are read at once; words that a task counts before it hands them on, and their characters.
PART_BYTES, HELD_WORDS, HELD_CHARS = 1 << 20, 200_000, 1 << 24
#: Letters: a-z and U+00C0 to U+00FF, one byte each; their numbers from 0 on.
ALPHABET = bytes([*range(97, 123), *range(0xC0, 0x100)])
NUMBER = np.full(256, 255, np.uint8)
NUMBER[list(ALPHABET)] = np.arange(len(ALPHABET), dtype=np.uint8)
#: Words and bytes of words in a shard at most (a longer word alone), bytes of shards that are broadcast together at most,
#: words that a task walks, and states of a walk that are made at once.
SHARD_WORDS, SHARD_BYTES, ROUND_BYTES, TASK_WORDS, STATES = 1 << 16, 1 << 22, 1 << 26, 20_000, 1 << 20


# ---- words and their counts


def runs_of(text: str, least: int):
    """All maximal runs of letters, of least letters or more."""
    pattern = re.compile(f"[a-zÀ-ÿ]{{{least},}}")
    return pattern.findall(text) if len(text) < 1 << 22 else (m.group() for m in pattern.finditer(text))


def misspelt(run: str, crc: int, every: int) -> str:
    """run without one letter if every divides the hash; crc: that of what stands before the run."""
    h = zlib.crc32(run.encode(), crc)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least: int = 5, every: int = 97) -> DataFrame:
    """word and n, its occurrences in a part of the documents (columns doc_id, text), for every word of least letters or more."""

    def rows(batches):
        found, held = Counter(), 0
        for batch in parts(batches, PART_BYTES):
            offsets, data = utf8(batch.column("text"))
            lower = LOWER[data].tobytes()
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                crc = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
                for run, n in Counter(runs_of(lower[offsets[k] : offsets[k + 1]].decode(), least)).items():
                    word = misspelt(run, crc, every)
                    if len(word) >= least:
                        held += 0 if word in found else len(word)
                        found[word] += n
                if len(found) >= HELD_WORDS or held >= HELD_CHARS:
                    yield pa.RecordBatch.from_pydict({"word": list(found), "n": list(found.values())})
                    found, held = Counter(), 0
        if found:
            yield pa.RecordBatch.from_pydict({"word": list(found), "n": list(found.values())})
        trim()

    return docs.mapInArrow(rows, "word string, n long")


# ---- tries


def single_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of words, one byte a letter."""
    offsets, data = utf8(column)
    second = data & 0xC0 == 0x80
    kept = np.r_[0, np.cumsum(~(data == 0xC3))]
    return kept[offsets], (data + (second * 0x40).astype(np.uint8))[data != 0xC3]


#: The arrays of a shard. Inner nodes are those prefixes that several words have: low and high, the letters that may follow;
#: first, the place of the first child; term, the word that ends there or -1. Children in order: child, an inner node, or
#: -1 - word for the only word of that prefix; label, the letter. Words in order: begin (one more), letters, n.
ARRAYS = {"low": np.uint64, "high": np.uint32, "first": np.int32, "term": np.int32, "child": np.int32, "label": np.uint8, "begin": np.int32, "letters": np.uint8, "n": np.int64}


def trie(begin: np.ndarray, letters: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of distinct words in ascending order, level by level."""
    out = {k: [] for k in ("low", "high", "first", "term", "child", "label")}
    lo, hi, depth, inner, children = np.array([0]), np.array([len(n)]), 0, 1, 0
    while len(lo):
        ends = begin[lo + 1] - begin[lo] == depth
        out["term"].append(np.where(ends, lo, -1))
        lo = lo + ends
        size = hi - lo
        node = np.repeat(np.arange(len(lo)), size)
        word = np.arange(len(node)) - np.repeat(np.cumsum(size) - size, size) + lo[node]
        letter = letters[begin[word] + depth]
        start = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (letter[1:] != letter[:-1])])
        stop = np.r_[start[1:], len(node)]
        label, parent, many = letter[start], node[start], stop - start > 1
        out["child"].append(np.where(many, inner + np.cumsum(many) - 1, -1 - word[start]))
        out["label"].append(label)
        at = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
        bit = np.uint64(1) << (label.astype(np.uint64) & np.uint64(63))
        for name, own in (("low", label < 64), ("high", label >= 64)):
            out[name].append(np.bitwise_or.reduceat(np.where(own, bit, np.uint64(0)), at))
        out["first"].append(children + at)
        lo, hi = word[start[many]], word[stop[many] - 1] + 1
        depth, inner, children = depth + 1, inner + int(many.sum()), children + len(start)
    found = {k: np.concatenate(v) for k, v in out.items()} | {"begin": begin, "letters": letters, "n": n}
    return {k: found[k].astype(t) for k, t in ARRAYS.items()}


def tries(words: DataFrame) -> DataFrame:
    """Shards of each partition of words (word, n; in order within a partition): shard, a number in order, and their arrays."""
    columns = list(ARRAYS)

    def rows(batches):
        shard, held, size = TaskContext.get().partitionId() << 32, [], 0

        def made():
            table = pa.Table.from_batches(held)
            begin, letters = single_bytes(table.column("word"))
            arrays = trie(begin, NUMBER[letters], table.column("n").to_numpy())
            return pa.RecordBatch.from_arrays([pa.array([shard]), *(pa.array([arrays[c].tobytes()], pa.binary()) for c in columns)], ["shard", *columns])

        for batch in batches:
            at = 0
            lengths = np.diff(utf8(batch.column("word"))[0]) if batch.num_rows else []
            while at < batch.num_rows:
                room = np.searchsorted(np.cumsum(lengths[at:]), SHARD_BYTES - size, "right")
                take = int(min(room, SHARD_WORDS - sum(b.num_rows for b in held)))
                if not take and held:
                    yield made()
                    shard, held, size = shard + 1, [], 0
                    continue
                take = max(1, take)
                held.append(batch.slice(at, take))
                size += int(lengths[at : at + take].sum())
                at += take
        if held:
            yield made()

    return words.mapInArrow(rows, "shard long, " + ", ".join(f"{c} binary" for c in columns))


class Shards:
    """Several shards, in the order of their words, for walks through all of them at once."""

    def __init__(self, shards: list[dict[str, bytes]]):
        found = [{k: np.frombuffer(s[k], t) for k, t in ARRAYS.items()} for s in shards]
        before = {k: np.cumsum([0, *(len(f[k]) for f in found)]) for k in ("low", "child", "n", "letters")}
        each = list(enumerate(found))
        self.roots = before["low"][:-1]
        self.low, self.high, self.label, self.letters, self.n = (np.concatenate([f[k] for f in found]) for k in ("low", "high", "label", "letters", "n"))
        self.first = np.concatenate([f["first"] + before["child"][k] for k, f in each])
        self.term = np.concatenate([np.where(f["term"] >= 0, f["term"] + before["n"][k], -1) for k, f in each])
        self.child = np.concatenate([np.where(f["child"] >= 0, f["child"] + before["low"][k], f["child"] - before["n"][k]) for k, f in each])
        self.begin = np.concatenate([*(f["begin"][:-1] + before["letters"][k] for k, f in each), before["letters"][-1:]])
        self.count = np.bitwise_count(self.low).astype(np.int64) + np.bitwise_count(self.high)
        self.bytes = self.letters.tobytes()

    def below(self, node: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these nodes have a child by this letter, and those children."""
        wide, low = letter >= 64, self.low[node]
        mask = np.where(wide, self.high[node].astype(np.uint64), low)
        bit = np.uint64(1) << (letter & np.uint8(63)).astype(np.uint64)
        there = np.flatnonzero(mask & bit)
        rank = np.bitwise_count((mask & (bit - np.uint64(1)))[there]).astype(np.int64) + np.where(wide[there], np.bitwise_count(low[there]), 0)
        return there, self.child[self.first[node[there]] + rank]

    def near(self, begin: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a word of a block and a word of the shards that differ by exactly one letter, each once.

        The automaton of a word has read d letters without an error or has made its one error; the walk goes down the trie
        depth first: all states with an error are followed to their ends before the next letter is read without one. The
        error is where the two words part (a letter of a run is taken from the run's end), so that a pair is found once."""
        length, text, found = np.diff(begin), letters.tobytes(), []
        word, node, d = np.repeat(np.arange(len(length)), len(self.roots)), np.tile(self.roots, len(length)), 0
        while len(word):
            more = d < length[word]
            here = np.where(more, letters[np.minimum(begin[word] + d, len(letters) - 1)], 255).astype(np.uint8)
            after = np.where(d + 1 < length[word], letters[np.minimum(begin[word] + d + 1, len(letters) - 1)], 255)
            gone = np.flatnonzero(more & (after != here))
            size = self.count[node]
            state = np.repeat(np.arange(len(word)), size)
            place = np.arange(len(state)) - np.repeat(np.cumsum(size) - size, size) + self.first[node][state]
            other = self.label[place] != here[state]
            state, child = state[other], self.child[place[other]]
            changed = more[state]
            w = np.concatenate([word[gone], word[state[changed]], word[state]])
            x = np.concatenate([node[gone], child[changed], child])
            read = np.repeat([d + 1, d + 1, d], [len(gone), int(changed.sum()), len(state)])
            deep = np.repeat([d, d + 1, d + 1], [len(gone), int(changed.sum()), len(state)])
            self._follow(w, x, read, deep, begin, letters, text, found)
            at = np.flatnonzero(more)
            there, child = self.below(node[at], here[at])
            word, d = word[at[there]], d + 1
            alone = child < 0  # the only word that begins so: compared at once
            self._compare(word[alone], -1 - child[alone], d, begin, text, found)
            word, node = word[~alone], child[~alone]
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]

    def _follow(self, w, x, read, deep, begin, letters, text, found) -> None:
        """Follows states (w, node x at depth deep, read letters of w) that have made their error to where they accept."""
        while len(w):
            left = begin[w + 1] - begin[w] - read
            alone = np.flatnonzero(x < 0)
            v = -1 - x[alone]
            alone = alone[self.begin[v + 1] - self.begin[v] - deep[alone] == left[alone]]
            v, last = -1 - x[alone], np.maximum(left[alone], 1)
            alike = (left[alone] == 0) | (letters[np.minimum(begin[w[alone]] + read[alone], len(letters) - 1)] == self.letters[np.minimum(self.begin[v] + deep[alone], len(self.letters) - 1)]) & (letters[begin[w[alone] + 1] - 1] == self.letters[self.begin[v] + deep[alone] + last - 1 - (left[alone] == 0)])
            alone = alone[alike]
            for a, b, i, j in zip(w[alone].tolist(), (-1 - x[alone]).tolist(), read[alone].tolist(), deep[alone].tolist(), strict=True):
                if text[begin[a] + i : begin[a + 1]] == self.bytes[self.begin[b] + j : self.begin[b + 1]]:
                    found.append((a, b))
            ends = np.flatnonzero((x >= 0) & (left == 0))
            ends = ends[self.term[x[ends]] >= 0]
            found += zip(w[ends].tolist(), self.term[x[ends]].tolist(), strict=True)
            on = np.flatnonzero((x >= 0) & (left > 0))
            there, child = self.below(x[on], letters[begin[w[on]] + read[on]])
            on = on[there]
            w, x, read, deep = w[on], child, read[on] + 1, deep[on] + 1

    def _compare(self, w, v, d, begin, text, found) -> None:
        """Words that have their first d letters in common."""
        size, other = begin[w + 1] - begin[w], self.begin[v + 1] - self.begin[v]
        some = np.abs(size - other) <= 1
        for a, b in zip(w[some].tolist(), v[some].tolist(), strict=True):
            if one_apart(text[begin[a] + d : begin[a + 1]], self.bytes[self.begin[b] + d : self.begin[b + 1]]):
                found.append((a, b))


def one_apart(a: bytes, b: bytes) -> bool:
    """Whether exactly one inserted, deleted or replaced letter makes a of b."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:  # the length of their common beginning
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return a[lo + (len(a) >= len(b)) :] == b[lo + (len(b) >= len(a)) :]


def nearest(words: DataFrame, shards) -> DataFrame:
    """word, n, n_near, best and best_n (the nearest word of largest n; the smallest of equal ones) of all words (word, n)
    against these shards, a broadcast list."""

    def rows(batches):
        own = Shards(shards.value)
        block = max(1, min(8192, STATES // (int(own.count[own.roots].sum()) + len(own.roots))))
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                begin, letters = single_bytes(part.column("word"))
                w, v = own.near(begin, NUMBER[letters])
                order = np.lexsort((v, -own.n[v], w))
                w, v = w[order], v[order]
                best = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else w
                at_best = np.full(part.num_rows, -1)
                at_best[w[best]] = v[best]
                names = [None if b < 0 else bytes(ALPHABET[c] for c in own.bytes[own.begin[b] : own.begin[b + 1]]).decode("latin-1") for b in at_best.tolist()]
                n = pa.array(own.n[at_best], mask=at_best < 0)
                yield pa.RecordBatch.from_arrays([part.column("word"), part.column("n"), pa.array(np.bincount(w, minlength=part.num_rows)), pa.array(names, pa.string()), n], ["word", "n", "n_near", "best", "best_n"])

    return words.mapInArrow(rows, "word string, n long, n_near long, best string, best_n long")


def rounds_of(sizes: list[tuple[int, int]], limit: int) -> list[tuple[int, int]]:
    """First and last shard of each round: consecutive shards (number, bytes) of limit bytes at most, or a larger one alone."""
    out, held = [], 0
    for shard, size in sizes:
        if not out or held + size > limit:
            out.append((shard, shard))
            held = 0
        out[-1], held = (out[-1][0], shard), held + size
    return out


def variants(docs: DataFrame, least: int = 5, times: int = 3, every: int = 97, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of docs (columns doc_id, text).

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, only A-Z lower-cased. With h, the crc32 of doc_id, a colon and
    the run, a run loses the letter h % length if every divides h. Words of least letters or more that occur at least times
    times count. Two words are near if one letter more, less or else makes one of the other; n_near counts a word's near words.
    Its form is the near word of largest n (the smallest of equal ones) if that is at least factor times its own, and root is
    where following forms ends.

    The vocabulary is dealt by ranges of words to shards, each a compact trie (prefixes of one word aren't spelt out). Shards
    are broadcast in rounds of ROUND_BYTES at most, whatever the vocabulary's size; each task walks its words' automata through
    all shards of a round, and what rounds find is reduced to counts and best forms. Forms grow by factor at each step, so that
    a few doublings of pointers find the roots.

    Null and empty texts have no words; a null doc_id is empty in the hash; repeated rows count as often as they are there; an
    empty table gives no rows; other columns are ignored; a run may be as long as a text (walks take a
    step for each letter that several words begin with alike). Tables in between are written below
    spark.checkpoint.dir and deleted; the result's stay."""
    spark, space = docs.sparkSession, Workspace(docs.sparkSession)
    words = space.keep(word_counts(texts_of(docs), least, every).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times))
    total = words.count()
    ordered = words.repartitionByRange(max(1, -(-total // SHARD_WORDS)), "word").sortWithinPartitions("word")
    shards = space.keep(tries(ordered))
    sizes = shards.select("shard", sum((F.length(c) for c in ARRAYS), F.lit(0)).alias("size")).orderBy("shard").collect()  # one row a shard
    dealt, found = words.repartition(max(1, -(-total // TASK_WORDS)), "word"), []
    for first, last in rounds_of([(r["shard"], r["size"]) for r in sizes], ROUND_BYTES):
        held = [r.asDict() for r in shards.where(F.col("shard").between(first, last)).orderBy("shard").collect()]  # ROUND_BYTES at most
        sent = spark.sparkContext.broadcast(held)
        found.append(space.keep(nearest(dealt, sent)))
        sent.destroy()
    if not found:
        empty = "word string, form string, root string, n long, n_near long, form_n long"
        return spark.createDataFrame([], empty)
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best"))).alias("top")
    every_round = itertools.accumulate(found, DataFrame.unionByName)
    all_found = [*every_round][-1].groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    good = -F.col("top.less") >= factor * F.col("n")
    formed = space.keep(all_found.select("word", "n", "n_near", F.when(good, F.col("top.best")).alias("form"), F.when(good, -F.col("top.less")).alias("form_n")))
    root = _roots(formed.where("form is not null").select("word", F.col("form").alias("to")), space)
    out_from = space.mark()
    out = space.keep(formed.join(root, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n"))
    space.drop(0, out_from)
    return out


def _roots(steps: DataFrame, space: Workspace) -> DataFrame:
    """word and to, where following to from word to word ends; steps has no cycles. Each round doubles the way."""
    now = space.keep(steps.withColumn("went", F.lit(True)))
    while not now.where("went").isEmpty():
        further = now.select(F.col("word").alias("to"), F.col("to").alias("next"))
        now = space.keep(now.join(further, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("went")))
    return now.select("word", "to")
