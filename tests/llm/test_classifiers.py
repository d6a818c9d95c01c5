"""Learned operators by held-out accuracy, and edge cases of every operator."""

import itertools
import math
import re
import resource

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import common, fingerprints, language, minhash, packing, quality, queries, rules, tokens, toxicity, urls
from tidemark.llm.common import table

from tests.conftest import DATA

SF = f"{DATA}/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents").cache()


def test_language(docs):
    got = language.language_id(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").toPandas()
    out = got[got.held_out & (got.n_chars > 50)]
    assert (out.lang == out.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_gradients_are_those_of_the_loss():
    """By differences, at weights of every layer."""
    rng = np.random.default_rng(1)
    x, y = rng.integers(97, 110, (12, language.WINDOW)).astype(np.uint8), rng.integers(0, 3, 12)
    net = language.blank(["a", "b", "c"], 5)
    net.byte, net.filters = net.byte.astype(np.float64), {w: f.astype(np.float64) for w, f in net.filters.items()}
    net.bias, net.out, net.out_bias = net.bias.astype(np.float64) + 0.1, net.out.astype(np.float64), net.out_bias.astype(np.float64)
    _, grads = language.gradients(net, x, y)
    checked = 0
    for w, g in zip(language.weights_of(net), grads, strict=True):
        flat, own = w.reshape(-1), g.reshape(-1)
        for k in np.argsort(-np.abs(own))[:8]:
            was, step = flat[k], 1e-6
            flat[k] = was + step
            up = language.gradients(net, x, y)[0]
            flat[k] = was - step
            down = language.gradients(net, x, y)[0]
            flat[k] = was
            assert own[k] == pytest.approx((up - down) / (2 * step), rel=1e-3, abs=1e-7)
            checked += 1
    assert checked >= 40


def test_lattice_by_enumeration():
    """The restored form is the best of all ways through a small lattice."""
    rng = np.random.default_rng(2)
    model = np.log(rng.dirichlet(np.ones(toxicity.SIZE), (toxicity.SIZE, toxicity.SIZE)))
    for word in ("1d1ot", "a$$", "s.t.u", "b*d", "aab", "h3||0", "x(!)", "no", "0", "t--o", "s$5s", "b**", "*a*"):
        for fixed in (None, 0, 1):
            if fixed is None and not any(c.isalnum() for c in word):
                continue
            core = toxicity.without_end(word) if fixed is None else word
            best = []
            for way in itertools.product(*toxicity.readings(core, fixed)):
                a = b = 0
                score, text = 0.0, ""
                for k, cost in way:
                    score += cost
                    if k >= 0:
                        score, text, a, b = score + model[a][b][k], text + chr(toxicity.PRINT[k]), b, k
                best.append((score + model[a][b][0], text))
            top = max(best)[0]
            for tails in (None, {}):
                assert toxicity.restored(word, model, fixed, None, tails) in {t for v, t in best if v > top - 1e-9}, word


def test_long_words_are_restored_whole():
    """In one pass, however long: nothing is cut, and time is in proportion."""
    model = np.log(np.full((toxicity.SIZE,) * 3, 1 / toxicity.SIZE)).tolist()
    assert toxicity.restored("1d1ot" * 2000, model).count("d") == 2000
    assert toxicity.candidates("a" + "!?" * 200_000)[0] == ("a", None)


def test_a_long_word_with_stars_takes_little_memory():
    """A megabyte with a star in its middle, and thousands of stars, are restored letter by letter."""
    model = np.log(np.full((toxicity.SIZE,) * 3, 1 / toxicity.SIZE))
    restorer = toxicity.Restorer(model)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    word = "abc" * 170_000 + "*" + "xyz" * 170_000
    assert {len(f) for f in restorer.forms(word)} == {len(word) - 1, len(word)}
    assert all(f.startswith("abc" * 170_000) and f.endswith("xyz" * 170_000) for f in restorer.forms(word))
    assert {len(f) for f in restorer.forms("a*" * 1500)} >= {3000 - 1}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000


def test_stretches_change_nothing(monkeypatch):
    """The way back through many short stretches is the way back through one."""
    rng = np.random.default_rng(4)
    model = np.log(rng.dirichlet(np.ones(toxicity.SIZE), (toxicity.SIZE, toxicity.SIZE)))
    words = ["".join(rng.choice(list("ab1$*.'o0||"), 40)) + "a" for _ in range(30)]
    whole = [toxicity.restored(w, model, f) for w in words for f in (None, 3)]
    for size in (1, 7):
        monkeypatch.setattr(toxicity, "STRETCH", size)
        assert [toxicity.restored(w, model, f) for w in words for f in (None, 3)] == whole


def in_disguise(word):
    """The rule of disguised(), sign by sign."""
    kind = [int(toxicity.KINDS[min(ord(c), toxicity.TABLE)]) for c in word]
    fold = [int(toxicity.LETTERS[min(ord(c), toxicity.TABLE)]) for c in word]
    letters = [k for k, x in enumerate(kind) if x == 1]
    beside = any((kind[k] == 2 or c == "*") and any(0 <= j < len(word) and kind[j] == 1 for j in (k - 1, k + 1)) for k, c in enumerate(word))
    between = [word[a + 1 : b] for a, b in zip(letters, letters[1:], strict=False) if b > a + 1]
    thrice = any(kind[k] == 1 and fold[k] == fold[k + 1] == fold[k + 2] != toxicity.OTHER for k in range(len(word) - 2))
    return bool(letters) and (beside or thrice or any(x != "'" for x in between) or sum(x == "'" for x in between) > 1)


def test_disguised_by_definition():
    rng = np.random.default_rng(6)
    for _ in range(300):
        text = "".join(rng.choice(list("aabé'.-1$*三 \t"), rng.integers(0, 40)))
        codes, _ = toxicity.points([text])
        want = [(m.start() + 1, m.end() + 1) for m in re.finditer(r"\S+", text) if in_disguise(m.group())]
        assert toxicity.disguised(codes) == want, text


def test_telling_by_definition():
    rng = np.random.default_rng(7)
    clean, toxic = rng.integers(0, 60, 400), rng.integers(0, 30, 400)
    got = toxicity.telling(clean, toxic, 900, 100, 4, 3.0)
    for c, t, own in zip(clean.tolist(), toxic.tolist(), got.tolist(), strict=True):
        chance = (c + t) * 0.1
        assert own == (t >= 4 and t - chance > 3 * math.sqrt(chance * 0.9 + 1e-9) and t / 100 > 2 * (c + 1) / 900)


def test_regression_and_cut():
    rng = np.random.default_rng(3)
    label = rng.integers(0, 2, 600)
    has = np.stack([np.where(rng.random(600) < 0.9, label, 1 - label), rng.integers(0, 2, 600)], axis=1)
    row, at = np.nonzero(has)
    w, bias = toxicity.regression(row, at, label.astype(float), 2)
    assert w[0] > 2 and abs(w[1]) < 0.5 and bias < 0
    z = np.arange(1000) / 100.0
    assert (z[:500] >= toxicity.lowest_cut(z[:500], np.zeros(500), 0.01)).sum() == 5
    assert toxicity.lowest_cut(np.array([-9.0, 3.0]), np.array([0, 1]), 0.01) == pytest.approx(np.log(0.25))


def test_language_gradients():
    """The network's steps lower the loss, and the reader of whole texts agrees with the trained layers."""
    rng = np.random.default_rng(0)
    windows = rng.integers(97, 123, (64, language.WINDOW)).astype(np.uint8)
    windows[32:, ::7] = 200
    label = np.repeat([0, 1], 32)
    net = language.train(windows, label, ["a", "b"], epochs=80)
    p = language.Reader(net).probabilities(windows)
    assert (p.argmax(axis=1) == label).all()
    z, _ = language.pooled(net, windows, net.tables())
    assert np.allclose(p, language.softmax(np.maximum(z + net.bias, 0) @ net.out + net.out_bias), atol=1e-4)


def quality_rows(text):
    """Rows of the vector table of a text's features, one by one."""
    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    found, at = [], 0
    spaces = b" \t\n\x0b\x0c\r"
    whole = [w for w in re.split(rb"[ \t-\r]+", raw) if w]
    for k, w in enumerate(whole):
        value = common.word_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]
        found.append(int(value) >> (64 - quality.BITS))
        found += [quality.ROWS - 1] if k and whole[k - 1] == w else []
    padded = b" " + raw + b"  "
    for at in range(len(raw)):
        three = int.from_bytes(padded[at : at + 3], "little")
        if padded[at + 1] not in spaces:
            found.append((three * 0x9E3779B1 % 2**32 >> 32 - quality.BITS) + 2**quality.BITS)
            if padded[at + 2] not in spaces:
                four = int.from_bytes(padded[at : at + 4], "little")
                found.append((four * 0x85EBCA6B % 2**32 >> 32 - quality.BITS) + 2 * 2**quality.BITS)
    return found


def test_quality_features_and_scores_by_definition(spark):
    texts = ["The the cat\tsat  ünder a mat", "", None, "x", "aa aa aa\n b ", "A" * 300 + " é"]
    rng = np.random.default_rng(8)
    model = quality.Model(rng.standard_normal((quality.ROWS, quality.DIM)).astype(np.float32), rng.standard_normal((quality.DIM, 2)).astype(np.float32), np.array([0.3, -0.2], np.float32))
    got = {r.doc_id: r.score for r in quality.scored(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    at, row = (np.concatenate(x) for x in zip(*quality.features(batch), strict=True))
    for k, text in enumerate(texts):
        rows = quality_rows(text)
        assert sorted(at[row == k].tolist()) == sorted(rows), text
        mean = model.vectors[rows].mean(axis=0) if rows else np.zeros(quality.DIM)
        z = mean @ model.out + model.bias
        assert got[k] == pytest.approx(float(np.exp(z[1]) / np.exp(z).sum()), abs=1e-4)


def test_a_tree_by_brute_force(monkeypatch):
    """The first tree's splits and leaves are those with the largest gain of all, looked for one by one."""
    monkeypatch.setattr(urls, "TREES", 1)
    rng = np.random.default_rng(9)
    names = [f"https://h{rng.integers(40)}.{rng.choice(['com', 'net', 'org'])}/" + "/".join(str(x) for x in rng.integers(0, 10 ** int(rng.integers(1, 6)), rng.integers(0, 5))) for _ in range(400)]
    blocked = np.array([float(rng.random() < (0.8 if len(u) > 30 else 0.2)) for u in names])
    forest = urls.train(names, blocked)
    hosts = [urls.host_and_path(u)[0] for u in names]
    own, _, prior = urls.suffix_rates([urls.suffix(h) for h in hosts], hosts, blocked)
    x = urls.binned(np.array([urls.lexical(u, r) for u, r in zip(names, own, strict=True)]), forest.edges)
    weight = np.where(blocked == 1, 0.5 / prior, 0.5 / (1 - prior))
    g, h = weight * (blocked - 0.5), weight * 0.25
    feature, split, value = forest.trees[0]
    value_of = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1)
    nodes = {0: np.arange(len(names))}
    for k in range(2**urls.DEPTH - 1):
        rows = nodes[k]
        gains = {}
        for f in range(x.shape[1]):
            for cut in range(urls.BINS):
                left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                if min(len(left), len(right)) >= urls.LEAST:
                    gains[f, cut] = value_of(left) + value_of(right) - value_of(rows)
        if gains and max(gains.values()) > 1e-6:
            assert gains[int(feature[k]), int(split[k])] == pytest.approx(max(gains.values()))
        nodes[2 * k + 1], nodes[2 * k + 2] = rows[x[rows, feature[k]] <= split[k]], rows[x[rows, feature[k]] > split[k]]
    for leaf in range(2**urls.DEPTH):
        rows = nodes[2**urls.DEPTH - 1 + leaf]
        assert value[leaf] == pytest.approx(urls.RATE * g[rows].sum() / (h[rows].sum() + 1))


def test_quality(spark, docs):
    labels = table(spark, SF, "labels")
    got = quality.quality(docs, labels).join(labels, "doc_id").toPandas()
    out = got[got.held_out]
    assert (out.predicted == out.quality).mean() > 0.95 and got.score.between(0, 1).all()


def test_toxicity(spark, docs):
    labels = table(spark, SF, "labels")
    plain = ["idiot", "moron", "scum", "trash", "clown", "loser", "stupid", "worthless", "pathetic", "disgusting"]
    hidden = ["1d1ot", "m0r0n", "$cum", "tr4sh", "cl0wn", "l0s3r", "stuuuupid", "w0rthl3ss", "p.a.t.h.e.t.i.c", "d i s g u s t i n g"]
    extra = [(10**6 + k, f"the erre of that {w} ander is") for k, w in enumerate(plain + hidden)] + [(2 * 10**6, "the erre of that ander is"), (2 * 10**6 + 1, None), (2 * 10**6 + 2, "")]
    every = docs.select("doc_id", "text").union(docs.sparkSession.createDataFrame(extra, "doc_id long, text string"))
    got = {r.doc_id: r for r in toxicity.toxicity(every, labels).collect()}
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[10**6 + k].predicted for k in range(20)] == [1] * 20
    assert [got[2 * 10**6 + k].predicted for k in range(3)] == [0] * 3
    clean = [r.doc_id for r in labels.where("toxic = 0").collect()]
    assert np.mean([got[d].predicted for d in clean if d in got]) < 0.02


def test_disguises(spark, docs):
    """Every form of disguise is found, alone and by the whole operator, and not across texts."""
    forms = {
        "stupid": ["stuupid", "st**id", "st--u--pid", "s..t..u..p..i..d", "st__upid", "s't'u'p'i'd", "s/t/u/p/i/d", "stuuupid!", "s  t  u  p  i  d", "s\nt\nu\np\ni\nd", "s. t. u. p. i. d", "s t upid", "st u p id"],
        "idiot": ["iiddiioott", "id107", "i\u00a0d\u00a0i\u00a0o\u00a0t", "1 d 1 0 t", "i d iot"],
        "moron": ["moroon", "m0r0n", "m0roon"],
        "scum": ["$cum", "scu*"],
        "shit": ["sh17", "sh1t!"],
        "ass": ["a55", "a$$", "a$$$$", "a s s", "y o u   a s s"],
    }
    restorer = toxicity.Restorer(toxicity.language_model(toxicity.trigram_counts(docs)))
    for word, hidden in forms.items():
        for w in hidden:
            found = toxicity.features(restorer.texts(["on", f"the {w} ander", "on"])[1])
            assert f" {word} " in found or f"~{toxicity.single_copies(word)}~" in found, w
    for text in ("it's well", "the good erre of that ander is"):
        assert toxicity.disguised(toxicity.points([text])[0]) == []
    assert restorer.texts(["the a s", "s b on"]) == [restorer.texts([t])[0] for t in ("the a s", "s b on")]
    rows = [(10**6 + k, f"the erre of that {w} ander is") for k, w in enumerate(x for w in ("stupid", "idiot", "moron", "scum") for x in forms[w])]
    every = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(every, table(spark, SF, "labels")).where(F.col("doc_id") >= 10**6).collect()}
    assert [text for k, text in rows if not got[k]] == []


OPERATORS = {
    "token_counts": lambda d, _: tokens.token_counts(d, P.path("piece_bpe_32k.model")),
    "near_duplicates": lambda d, _: minhash.near_duplicates(d),
    "round_trip": lambda d, _: tokens.round_trip(d, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN),
    "quality_rules": lambda d, _: rules.quality_rules(d),
    "quality": lambda d, l: quality.quality(d, l),  # noqa: E741
    "packed": lambda d, _: packing.packed(queries.pieces_of(d)),
    "language_id": lambda d, _: language.language_id(d),
    "fingerprints": lambda d, _: fingerprints.fingerprints(d),
    "toxicity": lambda d, l: toxicity.toxicity(d, l),  # noqa: E741
}
LABELS = "doc_id long, quality int, toxic int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_ties_and_clashes(spark, name):
    """Null ids and texts, repeated rows, a very long text, columns named like those of the operators: a row out per row in."""
    rows = [(None, None, None, None, None), (None, "a b c d e f", "en", "s", 1), (1, None, "en", "s", 0), (2, "", None, "s", 0), (3, "the same text of six words", "en", "s", 9), (3, "the same text of six words", "en", "s", 9), (4, "the same text of six words", "de", "s", 9), (5, "word " * 60_000, "en", "s", 9), (6, "漢字 " * 50, "zh", "s", 9)]
    labels = spark.createDataFrame([(None, 1, 0), (1, None, None), (3, 1, 0), (3, 1, 0), (5, 0, 1), (99, 1, 1)], LABELS)
    docs = spark.createDataFrame(rows, DOCS).select("*", *[F.lit(1).alias(c) for c in ("score", "held_out", "piece", "sequence_id", "node", "component_id", "kept", "label", "quality", "toxic", "order", "twin")])
    got = OPERATORS[name](docs, labels)
    n = got.where("piece = 0").count() if "piece" in got.columns else got.count()
    assert n == len(rows)


def test_url_edge_cases(spark):
    rows = spark.createDataFrame([(None, None), (1, None), (1, "http://a.com/x"), (1, "http://a.com/x")], "page_id long, url string")
    got = urls.judged(rows.withColumn("verdict", F.lit(1)), queries.urls.parse(queries.RULES)).collect()
    assert len(got) == 4 and {r.verdict for r in got} == {"allow"}
    assert urls.judged(rows.where("false"), ()).count() == 0


def test_pipeline(spark):
    docs = table(spark, SF, "documents").where("doc_id < 400")
    names, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == names, name
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[0] > kept[2] > kept[3]
    left = docs.toPandas()
    assert left.text.is_unique
    again = minhash.near_duplicates(docs, 80)
    assert again.where("not kept").count() == 0  # each group has one left, and no two of these are alike
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert set(last.doc_id) == set(left.doc_id) and (last.groupby("sequence_id").length.sum() <= 2048).all()


def test_pipeline_ids(spark):
    """Documents with a null doc_id stay, of repeated rows one does, and rows that share a doc_id are judged by their texts."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(0)), (None, text(1)), (None, text(2)), (1, text(2)), (1, text(2)), (1, text(2).upper()), (2, text(2)), (5, text(3)), (6, text(3)), (6, text(4)), (7, text(5)), (7, None), (7, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOCS)
    got = corpus_pipeline.STAGES[2][1](spark, docs, SF)
    assert got.columns == docs.columns
    found = sorted(((r.doc_id or 0, (r.text or "").lower()) for r in got.collect()))
    assert found == sorted([(0, text(0)), (0, text(1)), (0, text(2)), (1, text(2)), (5, text(3)), (6, text(4)), (7, text(5)), (7, "")])
    passed = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        passed = stage(spark, passed, SF)
    assert passed.where("doc_id is null").count() == 3 and passed.where("doc_id = 1").count() == 1
    last = corpus_pipeline.STAGES[3][1](spark, passed, SF)
    assert last.where("piece = 0").count() == passed.count()


STAGE_ROWS = [
    (None, None, None, None, None), (None, "", "en", "s", 0), (1, None, None, "s", 0), (2, "12345 !!", None, "s", 0), (3, "x y", "en", "s", 3), (3, "x y", "en", "s", 3), (4, "word " * 40_000, "en", "s", 9), (5, "漢字 " * 50, "zh", "s", 9),
    *[(k, " ".join(f"w{k % 3}x{i} of the" for i in range(30)), "en", "s", 1) for k in range(6, 12)],
]


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stage_edges(spark, stage):
    """Nulls, empty and very long texts, repeated rows, clashing columns and an empty table, stage by stage."""
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = spark.createDataFrame(STAGE_ROWS, DOCS).select("*", *[F.lit(1).alias(c) for c in ("score", "kept", "node", "label", "_id", "_fa", "component_id", "rep", "mark", "n", "length")])
    got = run(spark, docs, SF)
    rows = got.collect()
    if stage == "packing":
        assert sum(r.piece == 0 for r in rows) == len(STAGE_ROWS)
    else:
        assert got.columns == docs.columns
        texts = [r.text for r in rows]
        if stage == "language_id":
            assert not {None, "", "12345 !!"} & set(texts)
        elif stage == "quality_rules":
            assert len(rows) == 6 and all(t and t.startswith("w") for t in texts)
        else:
            assert len(rows) == len(STAGE_ROWS) - 1 - 3  # one repeated row, and three of six that say the same
    assert run(spark, docs.where("false"), SF).count() == 0


def test_queries_in_sql(spark, small):
    """The queries that SQL can express, over whole tables."""
    con = duckdb.connect()
    for name in ("documents", "embeddings"):
        con.sql(f"create view {name} as select * from '{small}/{name}.parquet'")
    for name, sql in queries.ORACLES.items():
        got, want = queries.QUERIES[name](spark, small).toPandas(), con.sql(sql).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        assert sorted(map(tuple, got[columns].to_numpy().tolist())) == sorted(map(tuple, want[columns].to_numpy().tolist())), name


def test_names():
    assert [int(n[2:].split("_")[0]) for n in queries.QUERIES] == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "packing"]
