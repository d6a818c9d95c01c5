"""URL filters: host and path rules, and gradient-boosted trees on lexical features for what no rule fits."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.sample import bounded

SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ALLOW, BLOCK = "allow", "block"
NAMES = ("length", "host_length", "path_length", "depth", "labels", "digit_share", "host_digits", "entropy", "host_entropy", "path_entropy", "parameters", "longest_digits", "hyphens", "secure", "fragment", "extension", "suffix_length", "suffix_letters", "suffix_rate")
#: Trees, their depth, step size, least rows in a leaf, bins of a feature, folds of hosts.
TREES, DEPTH, RATE, LEAST, BINS, FOLDS = 60, 3, 0.2, 20, 32, 5
#: Labelled URLs that weigh as much as the overall rate in a suffix's rate.
PRIOR = 20.0


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str


def parse(text: str) -> tuple[Rule, ...]:
    """Rules from lines of a verdict and a host with a path."""
    pairs = [line.split() for line in text.strip().splitlines()]
    return tuple(Rule(v, *re.fullmatch(r"([^/]*)(/.*)", place).groups()) for v, place in pairs)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as an index into rules, or null; of equally long ones the first."""
    found = F.lit(None).cast("int")
    order = sorted(range(len(rules)), key=lambda k: (-len(rules[k].host + rules[k].path), k))
    for k in reversed(order):
        r = rules[k]
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        found = F.when(fits, F.lit(k)).otherwise(found)
    return found


def entropy(raw: bytes) -> float:
    """Bits a byte."""
    counts = np.bincount(np.frombuffer(raw, np.uint8))
    share = counts[counts > 0] / max(1, len(raw))
    return float(-(share * np.log2(share)).sum())


def lexical(url: str | None, rate: float) -> list[float]:
    """The features of NAMES; rate: how often labelled URLs of the suffix are blocked."""
    url = url or ""
    host, path = host_and_path(url)
    tail = url.partition("://")[2][len(host) + len(path) :]
    digits = re.findall(r"[0-9]+", url)
    own = sum(c.isdigit() for c in host)
    return [
        len(url), len(host), len(path), path.count("/"), host.count(".") + 1, sum(map(len, digits)) / max(1, len(url)), own, entropy(url.encode()), entropy(host.encode()), entropy(path.encode()),
        tail.partition("#")[0].count("="), max(map(len, digits), default=0), url.count("-"), float(url.startswith("https:")), float("#" in tail), float(bool(re.search(r"\.\w+$", path))), len(suffix(host)), sum(c.isalpha() for c in suffix(host)), rate,
    ]


def host_and_path(url: str) -> tuple[str, str]:
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.partition("://")[2]).groups()
    return host.translate(SMALL), path


def suffix(host: str) -> str:
    return host.rpartition(".")[2]


def suffix_rates(suffixes: list[str], hosts: list[str], blocked: np.ndarray) -> tuple[np.ndarray, dict[str, float], float]:
    """Block rates of suffixes for URLs to learn from, each from the URLs of other folds of hosts only; those of all URLs, for
    URLs to judge; and the overall rate, which stands in for unknown suffixes and smooths all."""
    prior, names = float(blocked.mean()), sorted(set(suffixes))
    number = {x: k for k, x in enumerate(names)}
    at = np.array([number[x] for x in suffixes])
    fold = np.array([zlib.crc32(h.encode()) % FOLDS for h in hosts])
    cell = at * FOLDS + fold
    total = np.bincount(cell, minlength=len(names) * FOLDS).reshape(-1, FOLDS)
    bad = np.bincount(cell, weights=blocked, minlength=len(names) * FOLDS).reshape(-1, FOLDS)
    rest, rest_bad = total.sum(axis=1)[at] - total[at, fold], bad.sum(axis=1)[at] - bad[at, fold]
    whole = (bad.sum(axis=1) + PRIOR * prior) / (total.sum(axis=1) + PRIOR)
    return (rest_bad + PRIOR * prior) / (rest + PRIOR), dict(zip(names, whole.tolist(), strict=True)), prior


@dataclass
class Forest:
    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    start: float
    rates: dict[str, float]
    prior: float
    cut: float = 0.5

    def score(self, urls: list[str | None]) -> np.ndarray:
        """The chance that a URL is to be blocked."""
        ends = [suffix(host_and_path(u or "")[0]) for u in urls]
        rows = [lexical(u, self.rates.get(e, self.prior)) for u, e in zip(urls, ends, strict=True)]
        x = binned(np.array(rows).reshape(len(urls), len(NAMES)), self.edges)
        z = np.full(len(urls), self.start)
        for feature, split, value in self.trees:
            z += value[leaves(x, feature, split)]
        return 1 / (1 + np.exp(-z))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)], axis=1) if len(x) else np.zeros((0, len(edges)), int)


def leaves(x: np.ndarray, feature: np.ndarray, split: np.ndarray) -> np.ndarray:
    """The leaf of each row: node k has children 2k + 1 and 2k + 2; a row goes right if its bin is over the split."""
    node = np.zeros(len(x), np.int64)
    for _ in range(DEPTH):
        node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > split[node])
    return node - (2**DEPTH - 1)


def train(urls: list[str], blocked: np.ndarray) -> Forest:
    """Logistic loss with both labels of equal weight in all, second-order splits on histograms. Rates of suffixes are cross-fitted by host, so that no URL sees the
    labels of its own host in them; no other feature has seen a label."""
    hosts = [host_and_path(u)[0] for u in urls]
    ends = [suffix(h) for h in hosts]
    own, rates, prior = suffix_rates(ends, hosts, blocked)
    x = np.array([lexical(u, r) for u, r in zip(urls, own, strict=True)])
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    xb = binned(x, edges)
    start = 0.0
    weight = np.where(blocked == 1, 0.5 / max(prior, 1e-9), 0.5 / max(1 - prior, 1e-9))
    z, trees = np.full(len(urls), start), []
    inner = 2**DEPTH - 1
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = weight * (blocked - p), weight * p * (1 - p)
        feature, split, node = np.zeros(inner, np.int64), np.full(inner, BINS), np.zeros(len(urls), np.int64)
        for k in range(inner):
            mine = node == k
            best = 1e-6
            if mine.sum() >= 2 * LEAST:
                for f in range(xb.shape[1]):
                    gs, hs, ns = (np.cumsum(np.bincount(xb[mine, f], weights=w, minlength=BINS + 1)) for w in (g[mine], h[mine], None))
                    left, right = gs[:-1] ** 2 / (hs[:-1] + 1), (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + 1)
                    gain = np.where((ns[:-1] >= LEAST) & (ns[-1] - ns[:-1] >= LEAST), left + right - gs[-1] ** 2 / (hs[-1] + 1), 0)
                    if gain.max() > best:
                        best, feature[k], split[k] = gain.max(), f, int(gain.argmax())
            node[mine] = 2 * k + 1 + (xb[mine, feature[k]] > split[k])
        leaf = node - inner
        value = RATE * np.bincount(leaf, weights=g, minlength=2**DEPTH) / (np.bincount(leaf, weights=h, minlength=2**DEPTH) + 1)
        z += value[leaf]
        trees.append((feature, split, value))
    return Forest(edges, trees, start, rates, prior)


def precise_cut(score: np.ndarray, blocked: np.ndarray, precision: float) -> float:
    """The least score from which on this part of the URLs is rightly blocked, or above all scores."""
    order = np.argsort(-score, kind="stable")
    right = np.cumsum(blocked[order]) / np.arange(1, len(order) + 1)
    ends = np.append(score[order][1:] < score[order][:-1], True)  # a cut can't part equal scores
    good = np.flatnonzero(ends & (right >= precision) & (np.arange(1, len(order) + 1) >= LEAST))
    return float(score[order][good[-1]]) if len(good) else 1.1


def learned(pages: DataFrame, bound: int = 20_000, precision: float = 0.9) -> Forest | None:
    """Trees from about bound labelled URLs (columns url, host, label: allow or block); None if all have one label or none any.

    The score from which on a URL is blocked is set on folds of hosts that the trees scoring them haven't seen, so that this
    precision holds there. Null urls and labels don't count; repeated rows do, as often as they are there."""
    rows = bounded(pages.where(F.col("url").isNotNull() & F.col("label").isNotNull()), bound, "url", "page_id").select("url", "label").sort("url", "label").collect()
    blocked = np.array([r.label == BLOCK for r in rows], float)
    return fitted([r.url for r in rows], blocked, precision) if 0 < blocked.sum() < len(blocked) else None


def fitted(urls: list[str], blocked: np.ndarray, precision: float, folds: int = 3) -> Forest:
    fold = np.array([zlib.crc32(b"cut" + host_and_path(u)[0].encode()) % folds for u in urls])
    names, score = np.array(urls, object), np.full(len(urls), 0.5)
    for k in range(folds):
        out = fold == k
        if 0 < blocked[~out].sum() < (~out).sum():
            score[out] = train(names[~out].tolist(), blocked[~out]).score(names[out].tolist())
    forest = train(urls, blocked)
    forest.cut = precise_cut(score, blocked, precision)
    return forest


def judged(pages: DataFrame, rules: tuple[Rule, ...], precision: float = 0.9) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of pages (columns page_id, url).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins. Its verdict stands. The
    URLs that rules fit are the labelled ones: trees learn from a bounded sample of them and judge the others. score is the
    chance of block, also where a rule stands; others are blocked from the score on that keeps this precision on hosts
    that the trees haven't seen, and allowed below. Without trees (one label only) the others are
    allowed. A null url has an empty host and path. Hosts keep other characters than A-Z as they are. One row out per row
    in; an empty table gives no rows; other columns are ignored. No shuffle.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    rows = rows.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    pick = lambda values: F.get(F.array(*map(F.lit, values)), F.col("fit")) if rules else F.lit(None).cast("string")
    rows = rows.withColumns({"rule": pick([r.host + r.path for r in rules]), "label": pick([r.verdict for r in rules])})
    forest = learned(rows, precision=precision)

    def score(batches):
        for batch in batches:
            p = forest.score(batch.column("url").to_pylist()) if forest else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule", "label")), pa.array(p, pa.float64())], ["page_id", "host", "path", "rule", "label", "score"])

    out = rows.select("page_id", "url", "host", "path", "rule", "label").mapInArrow(score, "page_id long, host string, path string, rule string, label string, score double")
    own = F.when(F.col("score") >= (forest.cut if forest else 1.1), BLOCK).otherwise(ALLOW)
    return out.select("page_id", "host", "path", "rule", F.coalesce("label", own).alias("verdict"), "score")
