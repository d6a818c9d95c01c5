"""Language ID by a byte convolutional network, trained in numpy on labelled text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_rest, kept_beside, parts, texts_of, utf8
from tidemark.llm.sample import bounded, within

#: Bytes of a window, widths of the filters, filters of each width, numbers that stand for a byte.
WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 6, 8
#: Windows that go through the network at once.
BATCH = 256
UNKNOWN = "und"


@dataclass
class Network:
    """byte: 256 x EMBED; filters: width to (width, EMBED, FILTERS); bias, out, out_bias of the layers above."""

    languages: list[str]
    byte: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def tables(self) -> dict[int, list[np.ndarray]]:
        """For each width, what each byte (256 rows) at each place of the filter adds."""
        return {w: [self.byte @ f[j] for j in range(w)] for w, f in self.filters.items()}


def blank(languages: list[str], seed: int) -> Network:
    rng = np.random.default_rng(seed)
    n = len(WIDTHS) * FILTERS
    draw = lambda *s, scale: (rng.standard_normal(s) * scale).astype(np.float32)
    return Network(languages, draw(256, EMBED, scale=1.0), {w: draw(w, EMBED, FILTERS, scale=(w * EMBED) ** -0.5) for w in WIDTHS}, np.zeros(n, np.float32), draw(n, len(languages), scale=n**-0.5), np.zeros(len(languages), np.float32))


def windows_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in windows padded with zero bytes: the windows, their rows, and their own bytes. An empty text has none."""
    lengths = np.diff(offsets)
    many = -(-lengths // WINDOW)
    base = np.cumsum(many) - many
    flat = np.zeros(int(many.sum()) * WINDOW, np.uint8)
    flat[np.arange(len(data)) + np.repeat(base * WINDOW - offsets[:-1], lengths)] = data
    row = np.repeat(np.arange(len(lengths)), many)
    own = np.minimum(WINDOW, lengths[row] - (np.arange(len(row)) - base[row]) * WINDOW)
    return flat.reshape(-1, WINDOW), row, own


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def pooled(net: Network, windows: np.ndarray, tables: dict[int, list[np.ndarray]]) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Largest response of each filter over each window, and where it is."""
    values, places = [], {}
    for w in WIDTHS:
        n = WINDOW - w + 1
        z = tables[w][0][windows[:, :n]]
        for j in range(1, w):
            z += tables[w][j][windows[:, j : j + n]]
        places[w] = z.argmax(axis=1)
        values.append(np.take_along_axis(z, places[w][:, None, :], axis=1)[:, 0])
    return np.concatenate(values, axis=1), places


def gradients(net: Network, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean softmax cross-entropy of windows x with labels y, and its gradients in the order of weights()."""
    z, places = pooled(net, x, net.tables())
    pre = z + net.bias
    h = np.maximum(pre, 0)
    p = softmax(h @ net.out + net.out_bias)
    loss = float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-30)).mean())
    p[np.arange(len(y)), y] -= 1
    p /= len(y)
    back = (p @ net.out.T) * (pre > 0)
    of_byte, of_filters = np.zeros_like(net.byte), []
    for k, w in enumerate(WIDTHS):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        mine = np.zeros_like(net.filters[w])
        for j in range(w):
            seen = np.take_along_axis(x, places[w] + j, axis=1).astype(np.int64)
            table = np.bincount((seen * FILTERS + np.arange(FILTERS)).ravel(), weights=g.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
            mine[j] = net.byte.T @ table
            of_byte += table @ net.filters[w][j].T
        of_filters.append(mine)
    return loss, [of_byte, *of_filters, back.sum(axis=0), h.T @ p, p.sum(axis=0)]


def weights_of(net: Network) -> list[np.ndarray]:
    return [net.byte, *net.filters.values(), net.bias, net.out, net.out_bias]


def train(windows: np.ndarray, label: np.ndarray, languages: list[str], epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Stochastic gradient descent with Adam's step sizes."""
    net = blank(languages, seed)
    rng = np.random.default_rng(seed + 1)
    weights = weights_of(net)
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    total = max(1, epochs * -(-len(windows) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            step += 1
            now = rate * (1 - step / (total + 1))
            for k, g in enumerate(gradients(net, windows[pick], label[pick])[1]):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                weights[k] -= now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return net


class Reader:
    """A network for whole texts: each filter has a table of 65,536 byte pairs for its first two places."""

    def __init__(self, net: Network):
        self.net = net
        tables = {w: [x.astype(np.float32) for x in t] for w, t in net.tables().items()}
        pair = lambda a, b: np.ascontiguousarray((a[:, None, :] + b[None, :, :]).reshape(65536, FILTERS).T)
        self.first = {w: pair(t[0], t[1]) for w, t in tables.items()}
        self.third = np.ascontiguousarray(tables[3][2].T)
        self.fourth = pair(tables[4][2], tables[4][3])

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        high = np.empty((len(windows), len(WIDTHS) * FILTERS), np.float32)
        for at in range(0, len(windows), BATCH):
            x = windows[at : at + BATCH].astype(np.intp)
            code = (x[:, :-1] << 8) | x[:, 1:]
            early, late = np.ascontiguousarray(code[:, : WINDOW - 3]), np.ascontiguousarray(code[:, 2:])
            middle, last = np.ascontiguousarray(code[:, : WINDOW - 2]), np.ascontiguousarray(x[:, 2:])
            out = high[at : at + BATCH]
            for f in range(FILTERS):
                out[:, f] = self.first[2][f].take(code).max(axis=1)
                z = self.first[3][f].take(middle)
                z += self.third[f].take(last)
                out[:, FILTERS + f] = z.max(axis=1)
                z = self.first[4][f].take(early)
                z += self.fourth[f].take(late)
                out[:, 2 * FILTERS + f] = z.max(axis=1)
        return softmax(np.maximum(high + self.net.bias, 0) @ self.net.out + self.net.out_bias)


def learned(docs: DataFrame, fold: int, out_rest: int, per_language: int = 300, most_bytes: int = 8 << 20) -> Network | None:
    """A network from about per_language labelled texts of each language (see sample.bounded()), of each its whole text,
    of most_bytes bytes in all.

    Rows whose crc32(doc_id as text) modulo fold is out_rest, with a null doc_id or without lang or text don't count;
    repeated rows count as often as they are there, and an id with two languages for both. None without any row."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length("text") > 0) & ~crc_rest(fold).isin(out_rest, -1))
    taken = bounded(labelled.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")), per_language, "doc_id", by="lang")
    taken = within(taken, most_bytes, "doc_id").select("lang", "text")

    def cut(batches):
        for batch in parts(batches, 4 << 20):
            windows, row, _ = windows_of(*utf8(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(row)), pa.array([w.tobytes() for w in windows], pa.binary())], ["lang", "window"])

    rows = taken.mapInArrow(cut, "lang string, window binary").sort("lang", "window").toArrow()
    if not rows.num_rows:
        return None
    names = rows.column("lang").to_pylist()
    languages = sorted(set(names))
    label = np.searchsorted(np.array(languages), names)
    windows = np.frombuffer(b"".join(rows.column("window").to_pylist()), np.uint8).reshape(-1, WINDOW)
    return train(windows, label, languages)


def judged(batch: pa.RecordBatch, reader: Reader | None):
    """For parts of a batch in order: predicted languages and scores."""
    for part in parts(iter([batch]), 2 << 20):
        texts = part.column("text").to_pylist()
        able = np.array([bool(reader and t and any(map(str.isalpha, t))) for t in texts])
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if able.any():
            windows, row, own = windows_of(*utf8(part.column("text")))
            p = reader.probabilities(windows) * own[:, None]
            total = np.zeros((len(texts), p.shape[1]))
            np.add.at(total, row, p)
            total /= np.maximum(total.sum(axis=1, keepdims=True), 1e-12)
            best = total.argmax(axis=1)
            scores = np.where(able, total[np.arange(len(texts)), best], 0.0)
            names = [reader.net.languages[b] if a else UNKNOWN for a, b in zip(able, best, strict=True)]
        yield part.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())


def predicted(docs: DataFrame, net: Network | None) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs (columns doc_id, text), from all windows of the whole text.

    A window's probabilities count by its own bytes. A text that is null or has no letter is und, with score 0; so is any
    text if there is no network. One row out per row in; an empty table gives no rows; other columns are ignored.
    """

    def rows(batches):
        reader = Reader(net) if net else None
        for batch in batches:
            for found in judged(batch, reader):
                yield pa.RecordBatch.from_arrays(list(found), ["doc_id", "lang_pred", "score"])

    return texts_of(docs).mapInArrow(rows, "doc_id long, lang_pred string, score double")


def known_rows(docs: DataFrame, net: Network | None, least_score: float) -> DataFrame:
    """The rows of docs (with all their columns) whose prediction is a language, of least_score at least, judged in place,
    each by its own text: a null doc_id and repeated rows change nothing, null texts and those without letters go, and all
    go without a network. An empty table gives no rows."""
    readers: list[Reader] = []

    def judge(batch):
        if net and not readers:
            readers.append(Reader(net))
        for _, names, scores in judged(batch, readers[0] if readers else None):
            yield (np.array(names.to_pylist(), object) != UNKNOWN) & (scores.to_numpy() >= least_score)

    return kept_beside(docs, judge)


def language_id(docs: DataFrame, fold: int = 4, out_rest: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row: predicted() by a network learned() from the other folds."""
    found = predicted(docs, learned(docs, fold, out_rest))
    return found.select("doc_id", (crc_rest(fold) == out_rest).alias("held_out"), "lang_pred", "score")
