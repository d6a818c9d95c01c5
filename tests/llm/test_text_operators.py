"""Token counts, BPE, rules, near-duplicates, fingerprints, packing and URL filters against brute force on small texts."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import common, components, fingerprints, minhash, packing, rules, tokens, urls
from tidemark.llm.common import table

ODD = [None, "", " ", "  ", "a  b", " a", "a ", "\n", "a\n b", "a \nb", "a\tb  c \n\n d", "<|endoftext|>", "x <|endoftext|> y", "a<|endoftext|>b  <|endoftext|>", "▁a ▁", "a▁b c", "\x01a \x01b", "é ＡＢ 漢字 12 3a", "it's we'll 's ", "a\u00a0b c\u2003d", "\x00 \x00", "x\x1c y \x1cz", "zz " * 5 + " ", "a\r\n b\r\n", "y" * 3000, "w1 w2 w3 w4 w5 w6 w1 w2 w3 w4 w5 z", "a b c d e " * 4, "\n\nx\n\nx\n x\n", "a b c #*$%&|<>", "ONE two Three", "one two three"]


@pytest.fixture(scope="module")
def docs(spark, small):
    """The smallest documents, odd texts, a repeated row, and columns whose names clash with those of the operators."""
    odd = spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(ODD)], "doc_id long, text string")
    rows = table(spark, small, "documents").select("doc_id", "text").union(odd)
    return rows.select("*", F.lit("x").alias("bucket"), F.lit(1).alias("chunk"), F.lit(2).alias("rep"), F.lit(0.5).alias("score"), F.lit("y").alias("_kept")).cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_token_counts(docs, texts):
    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(docs, path, 500).collect()}
    want = {d: (len(t.encode()), n := len(model.encode(t)), n > 500) for d, t in texts.items()}
    assert got == want


def test_round_trip(docs, texts):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    encoding, _ = tokens.byte_encoding(path, P.PATTERN)
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tokens.round_trip(docs, path, P.PATTERN).collect()}
    for d, t in texts.items():
        ids = np.array(encoding.encode_ordinary(t), "<u4")
        assert got[d] == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()), t[:50]
    assert list(map(tuple, tokens.decoded(spark_rows(docs.sparkSession, [(1, [5, 6]), (1, []), (None, None), (2, [10**6])]), path).sort("doc_id", F.length("data")).collect())) == [(None, b""), (1, b""), (1, b"&\'"), (2, b"")]
    few = docs.where("doc_id >= 1000000 or doc_id < 20")
    back = {r.doc_id: bytes(r.data).decode() for r in tokens.decoded(tokens.encoded(few, path, P.PATTERN), path).collect()}
    assert back == {d: texts[d] for d in back} and len(back) == few.count()


def spark_rows(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, ids array<int>")


def test_changed_rows_are_refused(spark):
    """Two passes over rows that change in between raise an error and give no rows."""
    path = P.path("piece_bpe_32k.model")

    def shuffled(frames):
        for f in frames:
            yield f.assign(text=[os.urandom(8).hex() for _ in f.doc_id])

    odd = spark.range(200, numPartitions=2).withColumnRenamed("id", "doc_id").mapInPandas(shuffled, "doc_id long, text string")
    with pytest.raises(Exception, match="changed between two passes"):
        tokens.token_counts(odd, path).collect()


def test_pieces_and_packing(docs, texts):
    whole = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = packing.packed(tokens.token_pieces(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN), shard=200).collect()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
    assert set(of) == set(texts)
    for d, own in of.items():
        ids = np.array(whole.encode(texts[d], add_special_tokens=False).ids + [0], "<u4")
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == len(ids)
        assert all(r.length == 2048 for r in own[1:]) and own[0].length <= 2048
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    one = packing.packed(tokens.token_pieces(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)).select("sequence_id").distinct().count()
    assert len(bins) <= one + 4  # shards leave next to nothing of their own


def test_packing_of_equal_rows(spark):
    """Thousands of equal rows without an id are dealt apart, and packed whole."""
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(1).cast("long").alias("length"), F.lit(7).alias("offset"))
    got = packing.packed(rows, 100, 500).toPandas()
    assert len(got) == 3000 and got.sequence_id.nunique() == 30
    assert all(sorted(g.offset) == list(range(100)) for _, g in got.groupby("sequence_id"))


@pytest.mark.parametrize("lo, hi, shard", [(900, 1150, 100), (300, 700, 150), (1, 2049, 100)])
def test_packing_of_many_part_empty_sequences(spark, lo, hi, shard):
    """However many sequences are part-empty, what shards leave is packed again while that wins something."""
    lengths = np.random.default_rng(lo).integers(lo, hi, 2000)
    rows = spark.createDataFrame([(int(k), 0, int(n)) for k, n in enumerate(lengths)], "doc_id long, piece int, length long")
    got = packing.packed(rows, 2048, shard).toPandas()
    assert sorted(got.length) == sorted(lengths)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert (g.offset == np.r_[0, np.cumsum(g.length)[:-1]]).all() and g.length.sum() <= 2048
    once = sum(packing.place(lengths[np.arange(2000) % 20 == k], 2048)[0].max() + 1 for k in range(20))
    assert got.sequence_id.nunique() <= once + 20


def test_dedup_of_rows_with_maps(spark):
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, text, {"a": 1}, [{"x": None}]), (1, text, {"b": 2}, None), (2, text, None, None), (None, text, {"c": 3}, None)], "doc_id long, text string, tags map<string,int>, more array<map<string,int>>")
    got = minhash.kept_rows(docs).collect()
    assert [r.doc_id for r in sorted(got, key=lambda r: (r.doc_id is None, r.doc_id))] == [1, None]
    assert docs.columns == minhash.kept_rows(docs).columns


def test_sum_of_squares_rule():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 300)
    bins, offset = packing.place(lengths, 100)
    gaps, level = Counter(), {}
    for i in np.argsort(-lengths, kind="stable"):  # the same rule, written out
        size = int(lengths[i])

        def after(gap, size=size):
            trial = gaps.copy()
            if gap < 100:
                trial[gap] -= 1
            if gap > size:
                trial[gap - size] += 1
            return sum(v * v for v in trial.values())

        best = min([g for g in gaps if gaps[g] > 0 and g >= size] + [100], key=lambda g: (after(g), g == 100, g))
        b = int(bins[i])
        assert 100 - level.get(b, 0) == best and offset[i] == level.get(b, 0)
        if best < 100:
            gaps[best] -= 1
        if best > size:
            gaps[best - size] += 1
        level[b] = level.get(b, 0) + size
    assert max(level.values()) <= 100


def repetitive(text, limits=rules.Limits()):
    """The method's own verdict, word by word: shares of characters in later copies of n-grams and lines."""
    w = words(text)
    for size, share in limits.ngram_shares:
        seen, inside = set(), set()
        for i in range(len(w) - size + 1):
            gram = tuple(w[i : i + size])
            if gram in seen:
                inside.update(range(i, i + size))
            seen.add(gram)
        if sum(len(w[i]) for i in inside) > share * sum(map(len, w)):
            return True
    lines = [x for x in text.split("\n") if words(x)]
    later = [x for k, x in enumerate(lines) if x in lines[:k]]
    if len(lines) >= limits.least_lines and len(later) > limits.line_share * len(lines):
        return True
    return sum(map(len, later)) > limits.line_char_share * sum(map(len, lines))


def test_spans_are_hashed_in_segments(monkeypatch):
    rng = np.random.default_rng(3)
    data = rng.integers(33, 36, 5000).astype(np.uint8)
    cuts = np.unique(rng.integers(0, 5000, 60))
    starts, ends = cuts[:-1], cuts[1:]
    whole = common.word_hashes(data, starts, ends)
    for size in (7, 64, 300):
        monkeypatch.setattr(common, "SEGMENT", size)
        assert (common.word_hashes(data, starts, ends) == whole).all()
    spans = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert len(set(whole.tolist())) == len(set(spans))


def test_repeated_lines(spark):
    words_ = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    long = "漢" * 300
    texts = {
        "a boilerplate line twice": "\n".join(["short line here", words_(1), "short line here"]),
        "four of ten lines one long line": "\n".join([*[long] * 4, *[f"{k} is short" for k in range(6)]]),
        "half of all lines short": "\n".join(x for k in range(8) for x in (words_(k), "again")),
        "five long words twice": " ".join([*[c * 60 for c in "abcde"], words_(11), *[c * 60 for c in "abcde"], words_(12)]),
        "nine of ten": "\n".join(["x y"] * 18 + [words_(9), words_(10)]),
    }
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts.values())], "doc_id long, text string")
    got = {list(texts)[r.doc_id]: r.kept for r in rules.quality_rules(rows).collect()}
    assert got == dict(zip(texts, (True, False, False, False, False), strict=True))
    assert got == {k: not repetitive(t) for k, t in texts.items()}


def test_quality_rules(docs, texts):
    got = {r.doc_id: r for r in rules.quality_rules(docs).collect()}
    for d, t in texts.items():
        w = words(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        n, inside, seen, dup = Counter(grams), set(), set(), 0
        for i, g in enumerate(grams):
            if n[g] > 1:
                inside.update(range(i, i + 5))
        for line in t.split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        r = got[d]
        failed = len(w) < 10 or 100 * len(inside) > 20 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(inside), failed)
        assert not (r.kept and failed)
        assert r.kept == (not failed and not repetitive(t)), t[:60]
    assert rules.kept_rows(docs).columns == docs.columns
    assert rules.kept_rows(docs).count() == sum(r.kept for r in got.values())


def shingles(text):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(sets, percent):
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    posts = {}
    for i in ids:
        n = Counter(j for s in sets[i] for j in posts.get(s, ()))
        for s in sets[i]:
            posts.setdefault(s, []).append(i)
        for j, k in n.items():
            if 100 * k >= percent * (len(sets[i]) + len(sets[j]) - k):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates(docs, texts, percent):
    sets = {d: shingles(t) for d, t in texts.items()}
    want = brute(sets, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, percent).collect()}
    assert got == {d: (len(sets[d]), want[d], want[d] == d) for d in texts}


@pytest.mark.parametrize("base_inside", [True, False])
def test_large_group_of_near_copies(spark, base_inside):
    """Many copies of one text, each with edits of its own, some cut short: most pairs are near the limit, few are links."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(0, " ".join(base))] if base_inside else []
    for k in range(1, 160):
        w = list(base)
        for _ in range(rng.choice([1, 2, 2, 3, 4])):
            w[rng.randrange(len(w))] = rng.choice(["alpha", f"new{k}", "beta"])
        if k % 9 == 0:
            w = w[: rng.randrange(80, 118)]
        if k % 11 == 0:
            w = w[rng.randrange(3, 12) :]
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, " ".join([f"u{k}x{i}" for i in range(100)] + base[:60])) for k in range(40)]  # a shared passage only
    want = brute({d: shingles(t) for d, t in rows}, 85)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85).collect()}
    assert got == want
    assert 10 < len(set(want.values())) < len(rows)


def test_rows_that_share_an_id(spark):
    """Two texts under one doc_id are two nodes: a link of the one is no link of the other; null ids are kept, repeats linked."""
    say = lambda k, n=60: [f"w{k}x{i}" for i in range(n)]
    rows = [(7, say(1)), (7, say(2)), (7, say(2)), (3, [*say(2), "x"]), (9, [*say(1), "y"]), (11, say(1)), (None, say(1)), (None, None), (12, None), (12, say(4)), (13, say(4))]
    docs = spark.createDataFrame([(k, " ".join(t) if t else None) for k, t in rows], "doc_id long, text string")
    got = Counter(map(tuple, minhash.near_duplicates(docs, 85).collect()))
    want = Counter([(7, 56, 7, True), (7, 56, 3, False), (7, 56, 3, False), (3, 57, 3, True), (9, 57, 7, False), (11, 56, 7, False), (None, 56, None, True), (None, 0, None, True), (12, 0, 12, True), (12, 56, 12, True), (13, 56, 12, False)])
    assert got == want


def test_hot_keys_are_dealt_to_several_parts(spark, docs, texts, monkeypatch):
    """With every list, head and component of three rows hot, the result is the same."""
    monkeypatch.setattr(common, "FEW", 3)
    monkeypatch.setattr(common, "HOT_KEYS", 10**9)
    want = brute({d: shingles(t) for d, t in texts.items()}, 80)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 80).collect()} == want


def test_tables_in_between_are_deleted(spark, docs):
    folder = common.shared_folder(spark)
    before = {f for f in os.listdir(folder) if f.startswith("tables-")}
    got = minhash.near_duplicates(docs.limit(50), 85)
    new = {f for f in os.listdir(folder) if f.startswith("tables-")} - before
    assert len(new) == 1 and len([f for f in os.listdir(f"{folder}/{new.pop()}") if not f.startswith(".")]) == 1
    assert got.count() == 50


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 200), (300, 200), (500, 500)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 300: 100}


def plain_mark(raw):
    """A fingerprint byte by byte, by its definition."""

    def ends(block):
        out = []
        for i in range(len(raw)):
            h = 0
            for k in range(i - 6, i + 1):
                h = (h * 0x01000193 + (raw[k] if k >= 0 else 0)) & 0xFFFFFFFF
            h ^= h >> 15
            h = (h * 0x2C1B3C6D) & 0xFFFFFFFF
            h ^= h >> 13
            if h % block == block - 1:
                out.append(i + 1)
        return out

    def letters(cuts):
        cuts = cuts[:63]
        cuts += [len(raw)] if not cuts or cuts[-1] != len(raw) else []
        return "".join(fingerprints.LETTERS[zlib.crc32(raw[a:b]) % 64] for a, b in zip([0, *cuts], cuts, strict=False))

    if not raw:
        return "3::"
    block = 3
    while block * 64 < len(raw):
        block *= 2
    while block > 3 and len(ends(block)) + 1 < 32:
        block //= 2
    return f"{block}:{letters(ends(block))}:{letters(ends(2 * block))}"


def plain_likeness(a, b):
    if a == b:
        return 1.0
    (p, *x), (q, *y) = (m.split(":") for m in (a, b))
    best = 0.0
    for i, j in ((0, 0), (1, 1), (0, 1), (1, 0)):
        if int(p) << i != int(q) << j or not x[i] or not y[j]:
            continue
        short, long = sorted((x[i], y[j]), key=len)
        if len(short) >= 7 and not any(short[k : k + 7] in long for k in range(len(short) - 6)):
            continue
        best = max(best, 1 - plain_distance(short, long) / len(long))
    return best


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j + 1] + 1, new[j] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def test_fingerprints_by_definition(texts):
    short = [t.encode() for t in texts.values() if len(t) < 2500][:60] + [b"ab" * 700, b"x" * 1500, bytes(range(256)) * 4]
    marks = [plain_mark(t) for t in short]
    assert [fingerprints.fingerprint(t) for t in short] == marks
    near = [plain_mark(t[: len(t) // 2] + b"!" + t[len(t) // 2 :]) for t in short]
    pairs = [*zip(marks, near, strict=True), *zip(marks, marks[1:], strict=False)]
    assert fingerprints.likeness(pairs).tolist() == pytest.approx([plain_likeness(*p) for p in pairs])
    assert sum(plain_likeness(*p) > 0.3 for p in pairs[: len(marks)]) > 30


def test_fingerprints_of_shared_ids(spark):
    """A hot id, null ids and equal rows: all rows in one chain by id, hash and text, whatever the ranges."""
    rng = random.Random(9)
    say = lambda: " ".join(rng.choice(["aa", "bbb", "cc", "ddd"]) + str(rng.randrange(99)) for _ in range(40))
    rows = [(7, say()) for _ in range(60)] + [(None, say()) for _ in range(20)] + [(None, None)] * 5 + [(k, say()) for k in range(40)] + [(9, "same")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    chain = sorted(((r.doc_id is not None, r.doc_id or 0, r.h, r.text or "") for r in docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()))
    want = Counter()
    for k, (known, d, _, t) in enumerate(chain):
        follows = chain[(k + 1) % len(chain)][3]
        n = len(t) // 4
        want[d if known else None, len(t), hashlib.sha256((t[: len(t) - n] + follows[:n]).encode()).hexdigest()] += 1
    for partitions in ("1", "4", "23"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            got = Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprints.fingerprints(docs).collect())
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == want


def test_fingerprints(docs, texts):
    ids = sorted(texts)
    got = {r.doc_id: r for r in fingerprints.fingerprints(docs).collect()}
    assert len(got) == len(ids)
    for k, d in enumerate(ids):
        t, follows = texts[d], texts[ids[(k + 1) % len(ids)]]
        n = len(t) // 4
        edited = t[: len(t) - n] + follows[:n]
        marks = [fingerprints.fingerprint(x.encode()) for x in (t, edited, follows)]
        r = got[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), *marks[:2])
        assert [r.near_edited, r.near_next] == fingerprints.likeness([(marks[0], marks[1]), (marks[0], marks[2])]).tolist()
    long = [r for r in got.values() if r.n_chars > 500]
    assert np.mean([r.near_edited for r in long]) > 0.6 and np.mean([r.near_next for r in long]) < 0.05


def test_edit_distances():
    rng = random.Random(2)
    pairs = [("".join(rng.choices("AB+", k=rng.randint(1, 64))), "".join(rng.choices("AB+", k=rng.randint(1, 64)))) for _ in range(200)]
    assert fingerprints.edit_distances(pairs).tolist() == [plain_distance(*p) for p in pairs]


RULES = urls.parse("allow com/\nblock example.com/en/\nallow www.example.com/en/\nblock net/es/\nblock net/fr/")


def test_url_rules(spark, small):
    odd = [None, "no scheme", "HTTP://WWW.Example.COM/en/x?y", "http://a.com?z://q/en/", "http://notexample.com/en/", "http://x.y\n.com/en/\nz#f", "http://com", "http://com/", "http://m.www.example.com/en/", "a://b://c.net/es/"]
    pages = table(spark, small, "pages").select("page_id", "url").union(spark.createDataFrame([(10**6 + k, u) for k, u in enumerate(odd)], "page_id long, url string"))
    given = {r.page_id: r.url for r in pages.collect()}
    for r in urls.judged(pages.withColumn("rule", F.lit("clash")), RULES).collect():
        rest = (given[r.page_id] or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [x for x in RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        best = max(fits, key=lambda x: len(x.host + x.path), default=None)
        assert (r.host, r.path, r.rule) == (host, path, best and best.host + best.path)
        assert r.verdict == best.verdict if best else r.verdict in ("allow", "block")


def test_url_trees():
    """Trees find a rule of suffix and digits on hosts they haven't seen; no URL sees its own host's labels in a rate."""
    rng = random.Random(4)
    names = [f"http://{rng.choice('abcdef')}{rng.randrange(999)}.{rng.choice(['net', 'org'])}/{rng.choice(['en', 'fr'])}/{rng.choice([7, 70000])}" for _ in range(3000)]
    bad = np.array([".net/" in u and u.endswith("70000") for u in names], float)
    forest = urls.fitted(names[:2000], bad[:2000], 0.9)
    said = forest.score(names[2000:]) >= forest.cut
    assert bad[2000:][said].mean() > 0.9 and said[bad[2000:] == 1].mean() > 0.9
    own, rates, prior = urls.suffix_rates(["x", "x", "y"], ["a", "a", "b"], np.array([1.0, 1.0, 0.0]))
    assert own[:2].tolist() == [prior] * 2 and rates["x"] > prior > rates["y"]
    assert urls.precise_cut(np.array([0.9] * 30 + [0.5] * 30), np.array([1.0] * 30 + [0.0] * 30), 0.9) == 0.9
    assert urls.precise_cut(np.array([0.9] * 30), np.zeros(30), 0.9) > 1
