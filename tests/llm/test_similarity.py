"""SimHash near-duplicates, spelling variants and vector codes against brute force."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import oracles, queries, simhash, variants, vectors
from tidemark.llm.common import beside

EXTRA = "doc_id long, text string, lang string, source string, n_chars long, TEXT_2 string, `doc_id.x` int"


def documents(spark, rows):
    """A table of documents with null columns and some whose names nearly clash."""
    return spark.createDataFrame([(i, t, None, None, None, "x", 1) for i, t in rows], EXTRA)


# ---- SimHash


def print_of(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def linked(rows):
    """(doc_id, fingerprint, component_id) of every row, by comparing all pairs."""
    prints = [print_of(t) for _, t in rows]
    own = list(range(len(rows)))
    for a, (i, _) in enumerate(rows):
        for b, (j, _) in enumerate(rows[:a]):
            if i is not None and j is not None and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = own[a], own[b]
                own = [y if o == x else o for o in own]
    least = {}
    for (i, _), o in zip(rows, own, strict=True):
        if i is not None:
            least[o] = min(i, least.get(o, i))
    return sorted(((i, f"{p:016x}", None if i is None else least[o]) for (i, _), p, o in zip(rows, prints, own, strict=True)), key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def edited(k, n=400):
    """A text in which word k is another."""
    return " ".join(f"w{i * i % 97}x{i}" if i != k else f"other{k}" for i in range(n))


def test_simhash_edges(spark):
    rows = [(5, None), (3, ""), (9, " \t\n "), (None, "one two three"), (None, None), (4, "One TWO three"), (4, "one two\x0bthree"), (7, "one two"), (8, "É é x"), (2, "é É x")]
    rows += [(100 + k, edited(k)) for k in range(0, 400, 9)] + [(99, edited(-1)), (99, edited(-1))]
    got = found(simhash.near_duplicates(documents(spark, rows)))
    assert got == linked(rows)
    assert sum(r[2] == 99 for r in got) > 10


def test_simhash_empty_table(spark):
    assert found(simhash.near_duplicates(documents(spark, []))) == []


def test_simhash_long_texts(spark):
    long = edited(-1, 100_000)
    got = found(simhash.near_duplicates(documents(spark, [(2, long), (1, long + " end"), (3, "z" * 3_000_000)])))
    assert got == linked([(2, long), (1, long + " end"), (3, "z" * 3_000_000)])


def test_simhash_links_at_every_distance(spark, monkeypatch):
    """Fingerprints three bits apart anywhere, in both halves, with hot cells, against all pairs."""
    draw = random.Random(7)
    base = [draw.getrandbits(64) for _ in range(30)] + [0, (1 << 64) - 1, 1 << 63, 0xAAAAAAAAAAAAAAAA]
    near = [b ^ sum({1 << draw.randrange(64) for _ in range(draw.randrange(1, 6))}) for b in base for _ in range(20)]
    family = [base[0] ^ (draw.getrandbits(9) << 40) for _ in range(200)]  # one cell of the lower half holds them all
    rows = list(enumerate(base + near + family + family[:5]))
    values = {i: p - (1 << 64) if p >> 63 else p for i, p in rows}
    monkeypatch.setattr(simhash, "prints", lambda docs, size, seed: docs.sparkSession.createDataFrame(list(values.items()), "doc_id long, fp long"))
    monkeypatch.setattr("tidemark.llm.common.FEW", 20)
    monkeypatch.setattr("tidemark.llm.common.HOT_KEYS", 50)
    monkeypatch.setattr(f"{__name__}.print_of", lambda p: p)
    assert found(simhash.near_duplicates(documents(spark, [(i, "") for i, _ in rows]))) == linked(rows)


def test_simhash_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert found(queries.QUERIES["op11_simhash_near_dedup"](spark, small)) == linked([tuple(r) for r in docs])


def test_grid_join_broadcasts_no_exploded_table(spark, tmp_path):
    spark.range(500).selectExpr("xxhash64(id) AS fp", "id AS grp").write.parquet(str(tmp_path / "prints"))
    prints = spark.read.parquet(str(tmp_path / "prints"))
    there, looks = simhash.cells(prints, 3)
    counts = there.groupBy("cell").agg(F.count("*").alias("n"))
    met = beside(there, looks.select("cell", F.col("fp").alias("a"), "same"), "cell", counts, 1000)
    plan = met._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 2  # the two of the few hot keys
    assert "Broadcast" not in simhash.one_bit_links(prints)._jdf.queryExecution().sparkPlan().toString()


def test_lower_bound():
    """The Manhattan distance of segment counts is never more than the number of differing bits."""
    draw, mask = random.Random(3), simhash.LOW_BITS
    counts = lambda x: [((x & mask) + (x >> 1 & mask)) >> 2 * k & 3 for k in range(simhash.SEGMENTS)]
    for _ in range(500):
        a = draw.getrandbits(64)
        b = a ^ draw.getrandbits(64) & draw.getrandbits(64) & draw.getrandbits(64)
        assert sum(abs(x - y) for x, y in zip(counts(a), counts(b), strict=True)) <= (a ^ b).bit_count()


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4, 6])
def test_parts(distance):
    parts = simhash.parts_of_segments(distance)
    assert sorted(k for p in parts for k in p) == list(range(simhash.SEGMENTS))
    assert distance // len(parts) <= 1


# ---- vector codes


def coded(rows, parts=4, entries=256, rounds=4):
    """(vec_id, code, error, label_error, codebooks) of every kept row, by comparing every part with every entry."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    n = len(kept[0][1]) if kept else 0
    cut = [n * p // parts for p in range(parts + 1)]
    own = [[v[cut[p] : cut[p + 1]] for _, v, _ in kept] for p in range(parts)]
    books = [o[:entries] for o in own]
    nearest = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            at = [nearest(x, books[p])[1] for x in own[p]]
            groups = [[x for x, k in zip(own[p], at, strict=True) if k == e] for e in range(len(books[p]))]
            books[p] = [[sum(c) // len(g) for c in zip(*g, strict=True)] if g else books[p][e] for e, g in enumerate(groups)]
    ends = [[nearest(own[p][r], books[p]) for p in range(parts)] for r in range(len(kept))]
    errors = [sum(d for d, _ in e) for e in ends]
    label = {}
    for (_, _, lab), e in zip(kept, errors, strict=True):
        label[lab] = label.get(lab, 0) + e
    said = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in e), err, label[lab], said) for (i, _, lab), e, err in zip(kept, ends, errors, strict=True)), key=str)


def codes_of(df):
    return sorted(map(tuple, df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


def embeddings(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, code string, error int").repartition(3)


def drawn(n, width, seed, spread=0.2):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0, spread) for _ in range(width)], draw.choice([None, 1, 2])) for i in range(n)]


def test_vector_codes_edges(spark):
    rows = drawn(300, 8, 1) + drawn(5, 8, 1) + [(900, None, 1), (901, [1.0] * 7 + [None], 1), (902, [float("nan")] * 8, 2), (903, [float("inf")] + [0.0] * 7, 2), (904, [], None), (905, [1.0] * 4, 1)]
    rows += [(None, [0.5] * 8, 7), (None, [0.5] * 8, 7), (-3, [-0.0001] * 8, None)]
    rows += [(1000 + k, [float(k % 3)] * 8, 9) for k in range(60)]  # ties and repeated vectors
    assert codes_of(vectors.vector_codes(embeddings(spark, rows))) == coded(rows)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 1), (2, [], None)], [(None, [1.0, 2.0], None)], drawn(40, 7, 3), [(k, [float(k)] * 4, 0) for k in (5, 4, 4)], drawn(30, 3, 9, 900.0)])
def test_vector_codes_small(spark, rows):
    assert codes_of(vectors.vector_codes(embeddings(spark, rows))) == coded(rows)


def test_bounds_save_work_and_keep_ties():
    """Assignments by bounds equal those by full comparison, ties included, and fewer rows are compared."""
    draw = np.random.default_rng(5)
    x = draw.integers(-6, 7, (3000, 3))  # many ties
    x[:1500] = draw.integers(-500, 500, (1500, 3))
    book, before, compared = x[:64].copy(), None, []
    code, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros(len(x))
    for _ in range(6):
        compared.append(vectors.Step(book, before).assign(x, code, upper, lower))
        far = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (code == far.argmin(1)).all()
        assert (upper**2 >= far[np.arange(len(x)), code]).all()
        second = np.sort(far, 1)[:, 1]
        assert (np.maximum(lower, 0) ** 2 <= second).all()
        before, book = book, np.array([x[code == k].sum(0) // max(1, (code == k).sum()) if (code == k).any() else book[k] for k in range(64)])
    assert compared[0] == len(x) and compared[-1] < len(x) // 2


def test_large_components(spark):
    with pytest.raises(Exception, match="would not fit"):
        vectors.vector_codes(embeddings(spark, [(1, [1e9, 0.0, 0.0, 0.0], 1)]))


def test_vector_codes_query(spark, small):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{small}/embeddings.parquet'")
    want = con.sql(oracles.VECTOR_CODES).df()[["vec_id", "code", "error", "label_error", "codebooks_sha256"]]
    assert codes_of(queries.QUERIES["op13_vector_codes"](spark, small)) == sorted(map(tuple, want.astype(object).itertuples(index=False)), key=str)


# ---- spelling variants


def counted(rows, every=97):
    out = {}
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] = out.get(run, 0) + 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(rows, every=97):
    n = counted(rows, every)
    near = {w: [v for v in n if abs(len(v) - len(w)) < 2 and apart(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: b if n[b] >= 2 * n[w] else None for w, b in best.items()}

    def root(w):
        while form.get(w):
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if form.get(w) else None) for w in n), key=str)


def variants_of(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def spelt(seed, words=60, texts=40):
    """Texts of words and their misspellings, of few letters so that many are near."""
    draw = random.Random(seed)
    base = ["".join(draw.choice("abÀéÿ÷") for _ in range(draw.randrange(4, 9))) for _ in range(words)]

    def wrong(w):
        k, kind = draw.randrange(len(w)), draw.randrange(4)
        return [w, w[:k] + w[k + 1 :], w[:k] + draw.choice("abÀ") + w[k:], w[:k] + draw.choice("aé") + w[k + 1 :]][kind]

    return [(draw.choice([None, draw.randrange(10**12)]), draw.choice([" ", "1", "–"]).join(wrong(draw.choice(base)) for _ in range(120))) for _ in range(texts)]


@pytest.mark.parametrize("shard_words, round_bytes", [(1 << 16, 1 << 26), (7, 1 << 26), (7, 3000)])
def test_variants_rounds_and_shards(spark, monkeypatch, shard_words, round_bytes):
    monkeypatch.setattr(variants, "SHARD_WORDS", shard_words)
    monkeypatch.setattr(variants, "ROUND_BYTES", round_bytes)
    monkeypatch.setattr(variants, "STATES", 4000)
    rows = spelt(11) + [(7, None), (8, ""), (9, "1 2 -- ab"), (9, "HELLO Hello hellO hallo HALLO hello"), (9, "hallo")]
    assert variants_of(variants.variants(documents(spark, rows), every=5)) == grouped(rows, 5)


def test_variants_edges(spark):
    assert variants_of(variants.variants(documents(spark, []))) == []
    assert variants_of(variants.variants(documents(spark, [(1, None), (2, "one two")]))) == []
    long, same = "xy" * 300_000, "a" * 1500
    rows = [(1, long), (2, long), (3, f"{same} {same}b {same}b {same}b {long[:-9]}q"), (4, f"{same} {same[1:]}"), (5, same), (6, same[1:]), (7, same[1:]), (None, long)]
    assert variants_of(variants.variants(documents(spark, rows))) == grouped(rows)


def test_forms_are_followed_to_the_last(spark):
    chain = ["aaaaaaa", "aaaaaab", "aaaaabb", "aaaabbb", "aaabbbb", "aabbbbb"]
    rows = [(1, " ".join(" ".join([w] * 3 * 2**k) for k, w in enumerate(chain)))]
    got = variants_of(variants.variants(documents(spark, rows), every=10**12))
    assert got == grouped(rows, 10**12)
    assert {r[2] for r in got} == {chain[-1]}


def test_trie_walk():
    """Every pair of all words of up to seven letters of three, once each."""
    import itertools

    import pyarrow as pa

    words = sorted("".join(w) for k in range(1, 8) for w in itertools.product("abÿ", repeat=k) if zlib.crc32("".join(w).encode()) % 3)
    begin, letters = variants.single_bytes(pa.array(words))
    cut = len(words) // 3
    pieces = [variants.trie(begin[a : b + 1] - begin[a], variants.NUMBER[letters[begin[a] : begin[b]]], np.ones(b - a, np.int64)) for a, b in ((0, cut), (cut, cut + 1), (cut + 1, len(words)))]
    shards = variants.Shards([{k: v.tobytes() for k, v in p.items()} for p in pieces])
    w, v = shards.near(begin, variants.NUMBER[letters])
    near = [(a, b) for a, x in enumerate(words) for b, y in enumerate(words) if abs(len(x) - len(y)) < 2 and apart(x, y)]
    assert sorted(zip(w.tolist(), v.tolist(), strict=True)) == near


def test_variants_query(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert variants_of(queries.QUERIES["op12_spelling_variants"](spark, small)) == grouped([tuple(r) for r in docs])
