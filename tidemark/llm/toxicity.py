"""Toxicity after noisy-channel deobfuscation: disguised words are restored under a character language model, then scored.

Text is folded to 28 letters: a space, a-z (accents dropped), and one for every other letter. A disguised word (digits and
signs for letters, letters repeated or spaced out) is read as a lattice of what each sign may stand for; the Viterbi path
under trigram counts of the whole corpus is its restored form. Doubled letters, which plain words have as well, are left out
of a second copy of the text, whose words are features of their own.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Workspace, crc_rest, parts, texts_of
from tidemark.llm.sample import bounded, within

SIZE, OTHER = 28, 27
SPACE_CODE = 0
#: What a sign may stand for, besides itself.
SIGNS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Signs put between letters.
BREAKS = ".-_*~^'"
#: Log probabilities of the channel: a letter as itself, a sign for a letter, a break dropped, a letter's copy dropped,
#: a star for any letter, a sign that stands for nothing.
PLAIN, SIGN, BREAK, COPY, STAR, LOST = -0.01, -1.0, -0.7, -2.0, -2.0, -12.0
#: Lengths of word beginnings that are features, besides whole words.
BEGINNINGS = (4, 5, 6)
#: Letters of a word that is looked for as a whole in spaced-out letters; a longer one is found by its beginning.
SPACED = 16
#: Characters of a word whose back pointers are held at once.
STRETCH = 4096
#: Folds of the labelled sample; the weight of the squared weights, and rounds of training.
FOLDS, RIDGE, ROUNDS = 5, 3.0, 300
#: Copies of a sample's text with the features of one word only (see single_words()).
COPIES_EACH = 4
#: A letter three times in a row; a sign more than twice in a row; a letter and its copies.
THRICE, MANY, COPIES = re.compile(r"(.)\1\1"), re.compile(r"(.)\1{2,}", re.DOTALL), re.compile(r"([a-z])\1+")
PART_BYTES = 1 << 20
TABLE = 0x2000  # code points that are folded one by one; beyond, every letter is "other"


def _folds() -> tuple[np.ndarray, np.ndarray]:
    letters, kinds = np.zeros(TABLE + 1, np.uint8), np.zeros(TABLE + 1, np.uint8)
    for k in range(TABLE):
        c = chr(k)
        base = unicodedata.normalize("NFD", c.lower())[:1] or c
        if "a" <= base <= "z":
            letters[k] = ord(base) - 96
        elif c.isalpha():
            letters[k] = OTHER
        if letters[k]:
            kinds[k] = 1
        elif c in SIGNS:
            kinds[k] = 2
        elif c in BREAKS:
            kinds[k] = 3
        elif c.isspace():
            kinds[k] = 4
        else:
            kinds[k] = 5
    letters[TABLE], kinds[TABLE] = OTHER, 1
    return letters, kinds


LETTERS, KINDS = _folds()
#: Folded letters as ASCII, for matching.
PRINT = np.frombuffer(b" abcdefghijklmnopqrstuvwxyz{", np.uint8)


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each after a newline, and where each text begins; large ones are cut to TABLE."""
    joined = "\n" + "\n".join(texts) + "\n"
    codes = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4"), TABLE).astype(np.int32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return codes, np.cumsum(sizes + 1) - sizes


def trigram_counts(docs: DataFrame) -> np.ndarray:
    """How often each letter follows each two over all texts: SIZE^3 numbers, summed in Spark from the tasks' own."""

    def count(batches):
        total = np.zeros(SIZE**3, np.int64)
        for batch in parts(batches, PART_BYTES):
            x = LETTERS[points([t or "" for t in batch.column("text").to_pylist()])[0]].astype(np.int32)
            keep = (x[2:] > 0) | (x[1:-1] > 0)
            code = (x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:]
            total += np.bincount(code[keep], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])

    rows = texts_of(docs).mapInArrow(count, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SIZE**3)
    out[rows.column("code").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(SIZE, SIZE, SIZE)


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probability of a letter after two others, interpolated with that after one and that after none."""
    one = counts.sum(axis=(0, 1)) + 1
    one = one / one.sum()
    two = counts.sum(axis=0)
    two = (two + 20 * one) / (two.sum(axis=1, keepdims=True) + 20)
    three = (counts + 20 * two) / (counts.sum(axis=2, keepdims=True) + 20)
    return np.log(three)


@functools.lru_cache(4096)
def options_of(c: str, again: bool, must: bool) -> list[tuple[int, float]]:
    """What a character may stand for, with log probabilities; -1 is nothing at all. again: it follows itself; must: a sign or
    a star has to be a letter. One list for all places of a text, which nobody changes."""
    k = int(LETTERS[min(ord(c), TABLE)])
    if k:
        return [(k, PLAIN)] + ([(-1, COPY)] if again else [])
    if c in SIGNS:
        own = [(ord(x) - 96, SIGN) for x in SIGNS[c]] + [(-1, BREAK if c in BREAKS else LOST)]
    elif c == "*":
        own = [(-1, BREAK)] + [(x, STAR) for x in range(1, 27)]
    else:
        own = [(-1, BREAK)]
    return [(x, cost) for x, cost in own if x >= 0] if must and (c in SIGNS or c == "*") else own


def readings(word: str, fixed: int | None = None) -> list[list[tuple[int, float]]]:
    """options_of() each character of a word. From fixed on signs and stars stand for letters."""
    low = word.lower()
    from_ = len(low) if fixed is None else fixed
    return [options_of(c, c == before, at >= from_) for at, (c, before) in enumerate(zip(low, " " + low, strict=False))]


def without_end(word: str) -> str:
    """A word without the signs at its end."""
    n = len(word)
    while n and not word[n - 1].isalnum():
        n -= 1
    return word[:n]


def restored(word: str, model: list | np.ndarray, fixed: int | None = None, dense: np.ndarray | None = None, tails: dict | None = None) -> str:
    """The most likely letters behind a word, between spaces: one pass over it with the best score of each pair of last
    letters (28 x 28 at most; dense: the model as an array), and one back (see passed()). Signs at the end stand for nothing,
    or, from fixed on, for letters. Where all ways meet in one pair at fixed, what follows depends on that pair alone and is
    kept in tails."""
    word = without_end(word) if fixed is None else word
    options = readings(word, fixed)
    cut, dense = fixed or 0, np.asarray(model) if dense is None else dense
    first, before = passed({(0, 0): 0.0}, options[:cut], model, dense)

    def rest(best: dict) -> tuple[tuple[int, int], list[int]]:
        last, back = passed(best, options[cut:], model, dense)
        return back(max((score + model[a][b][0], (a, b)) for (a, b), score in last.items())[1])

    if cut and tails is not None and len(first) == 1:
        pair = next(iter(first))
        if (pair, word[cut:]) not in tails:
            tails[pair, word[cut:]] = rest({pair: 0.0})[1]
        letters = tails[pair, word[cut:]]
    else:
        pair, letters = rest(first)
    letters = letters + before(pair)[1]
    return PRINT[letters[::-1]].tobytes().decode("ascii") if letters else ""


def passed(best: dict[tuple[int, int], float], options: list, model: list | np.ndarray, dense: np.ndarray):
    """The best score of each pair after these characters, and a function that gives, for one of them, the pair before the first
    character on the way to it and the way's letters, last first.

    Back pointers are held for STRETCH characters at a time: the pass keeps the scores where each stretch begins, and the
    way back goes through a stretch again. A word takes memory for its scores, a few numbers in STRETCH characters."""
    kept, steps = [], []
    for at in range(0, len(options), STRETCH):
        kept.append(best)
        best, steps = forward(best, options[at : at + STRETCH], model, dense)

    def back(pair: tuple[int, int]) -> tuple[tuple[int, int], list[int]]:
        found: list[int] = []
        for k in range(len(kept) - 1, -1, -1):
            own = steps if k == len(kept) - 1 else forward(kept[k], options[k * STRETCH : (k + 1) * STRETCH], model, dense)[1]
            pair, letters = backward(own, pair)
            found += letters
        return pair, found

    return best, back


def forward(best: dict[tuple[int, int], float], options: list, model: list | np.ndarray, dense: np.ndarray) -> tuple[dict, list]:
    """The best score of each pair after these characters, and back pointers for each of them: by pairs while these are few, by
    arrays (a byte for each pair) at stars, after which any letter may stand."""
    steps: list = []
    for choices in options:
        if len(choices) > 20:
            best, back = starred(best, choices, dense)
            steps.append(back)
            continue
        then: dict[tuple[int, int], float] = {}
        back: dict[tuple[int, int], tuple[tuple[int, int], int]] = {}
        for state, score in best.items():
            row = model[state[0]][state[1]]
            for k, cost in choices:
                to, now = (state, score + cost) if k < 0 else ((state[1], k), score + cost + row[k])
                if to not in then or now > then[to]:
                    then[to], back[to] = now, (state, k)
        best = then
        steps.append(back)
    return best, steps


def starred(best: dict[tuple[int, int], float], choices: list[tuple[int, float]], model: np.ndarray) -> tuple[dict, np.ndarray]:
    """One star: scores of all pairs after it, and for each the letter before the pair that it came from, or -1 where the star is
    nothing and the pair is the same."""
    score = np.full((SIZE, SIZE), -np.inf)
    at = np.array(list(best), np.int64)
    score[at[:, 0], at[:, 1]] = list(best.values())
    now = score + max((cost for k, cost in choices if k < 0), default=-np.inf)
    back = np.full((SIZE, SIZE), -1, np.int8)
    letters, costs = (np.array(x) for x in zip(*((k, cost) for k, cost in choices if k >= 0), strict=True))
    used = np.unique(at[:, 0])  # the first letters that any pair has
    ways = score[used][:, :, None] + model[used][:, :, letters]
    before = ways.argmax(axis=0)
    value = np.take_along_axis(ways, before[None], axis=0)[0] + costs
    better = value > now[:, letters]
    now[:, letters] = np.where(better, value, now[:, letters])
    back[:, letters] = np.where(better, used[before], back[:, letters])
    a, b = np.nonzero(np.isfinite(now))
    return dict(zip(zip(a.tolist(), b.tolist(), strict=True), now[a, b].tolist(), strict=True)), back


def backward(steps: list, pair: tuple[int, int]) -> tuple[tuple[int, int], list[int]]:
    """The pair before these steps on the way to a pair after them, and the way's letters, last first."""
    found = []
    for back in reversed(steps):
        if isinstance(back, dict):
            pair, k = back[pair]
            if k >= 0:
                found.append(k)
        elif back[pair] >= 0:
            found.append(pair[1])
            pair = (int(back[pair]), pair[0])
    return pair, found


def plain(word: str) -> bool:
    """Whether a word is letters only, none three times in a row: nothing to restore."""
    return word.isalpha() and not THRICE.search(word.lower())


def candidates(word: str) -> list[tuple[str, int | None]]:
    """The ways to read a word: without signs at its end; without those at its beginning as well; with one, two and so on
    of the signs at its end as letters; with each star as a letter. With each the place from which on signs are letters."""
    core = without_end(word)
    found: list[tuple[str, int | None]] = [(core, None)]
    first = next((k for k, c in enumerate(core) if c.isalnum()), 0)
    if first:
        found.append((core[first:], None))
    end = MANY.sub(r"\1\1", word[len(core) :])[:SPACED]
    for k, c in enumerate(end):
        if c not in SIGNS and c != "*":
            break
        found.append((core + end[: k + 1], len(core)))
    if "*" in core:
        found.append((core, 0))
    return found


def disguised(codes: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of text (start, end) that look like words in disguise: signs of any kind and number between letters (but
    for one apostrophe), a sign that may be a letter, or a star, beside a letter, or one letter three times in a row."""
    kind = KINDS[codes]
    letter, space = kind == 1, kind == 4
    starts, ends = stretches(space)
    if not len(starts):
        return []
    sign = (kind == 2) | (codes == 42)
    mark = np.zeros(len(codes), bool)
    mark[:-1] |= sign[:-1] & letter[1:]
    mark[1:] |= sign[1:] & letter[:-1]
    solid = np.maximum.accumulate(np.where(letter | space, np.arange(len(codes)), 0))
    last = np.flatnonzero(~letter[:-1] & ~space[:-1] & letter[1:])  # the last sign before a letter
    last = last[letter[solid[last]]]
    apostrophe = (codes[last] == 39) & (last - solid[last] == 1)
    mark[last[~apostrophe]] = True
    folded = LETTERS[codes]
    mark[:-2] |= letter[:-2] & (folded[:-2] == folded[1:-1]) & (folded[1:-1] == folded[2:]) & (folded[:-2] != OTHER)
    seen = np.concatenate([[0], np.cumsum(mark)])
    quoted = np.zeros(len(codes), np.int64)
    quoted[last[apostrophe]] = 1
    quoted = np.concatenate([[0], np.cumsum(quoted)])
    letters = np.concatenate([[0], np.cumsum(letter)])
    hit = ((seen[ends] > seen[starts]) | (quoted[ends] > quoted[starts] + 1)) & (letters[ends] > letters[starts])
    return list(zip(starts[hit].tolist(), ends[hit].tolist(), strict=True))


def stretches(space: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all runs without a space."""
    return np.flatnonzero(~space[1:] & space[:-1]) + 1, np.flatnonzero(space[1:] & ~space[:-1]) + 1


def spaced(codes: np.ndarray, begins: np.ndarray) -> list[tuple[list[tuple[int, int]], tuple[int, int] | None, tuple[int, int] | None]]:
    """Groups of characters spaced out by blanks of any kind and number, each with the stretches before and after it in the
    same text: two letters, three characters with a letter, or four characters. A sign may stand beside each."""
    kind = KINDS[codes]
    starts, ends = stretches(kind == 4)
    if not len(starts):
        return []
    solid = np.concatenate([[0], np.cumsum((kind == 1) | (kind == 2))])
    letter = np.concatenate([[0], np.cumsum(kind == 1)])
    many, letters = solid[ends] - solid[starts], letter[ends] - letter[starts]
    single = ((ends - starts <= 3) & (many == 1)) | ((ends - starts == 1) & (kind[starts] != 5))
    text = np.searchsorted(begins, starts, "right")
    near = np.zeros(len(starts), bool)
    near[1:] = single[1:] & single[:-1] & (text[1:] == text[:-1])
    first = np.flatnonzero(~near)
    sizes = np.diff(np.append(first, len(starts)))
    own = np.add.reduceat(letters, first)
    found = []
    for g in np.flatnonzero((sizes >= 4) | ((sizes == 3) & (own > 0)) | ((sizes == 2) & (own == 2))).tolist():
        a, b = int(first[g]), int(first[g] + sizes[g])
        at = lambda k: (int(starts[k]), int(ends[k]))
        before = at(a - 1) if a and text[a - 1] == text[a] else None
        after = at(b) if b < len(starts) and text[b] == text[a] else None
        found.append(([at(k) for k in range(a, b)], before, after))
    return found


def single_copies(text: str) -> str:
    return COPIES.sub(r"\1", text)


class Restorer:
    """Folded texts with the restored forms of their disguised words appended, then, each word between tildes, all this
    with doubled letters once; keeps the forms it has found."""

    def __init__(self, model: np.ndarray, most: int = 50_000):
        self.model, self.dense, self.known, self.tails, self.most = model.tolist(), model, {}, {}, most

    def forms(self, word: str) -> tuple[str, ...]:
        if word not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
                self.tails.clear()
            self.known[word] = tuple(dict.fromkeys(f for w, fixed in candidates(word) if (f := self.form(w, fixed))))
        return self.known[word]

    def form(self, word: str, fixed: int | None) -> str:
        if plain(word):
            return "".join(chr(PRINT[LETTERS[min(ord(c), TABLE)]]) for c in word)
        return restored(word, self.model, fixed, self.dense, self.tails)

    def joined(self, singles: list[str], gaps: list[int], before: str, after: str) -> list[str]:
        """Forms of characters spaced out: a word may begin at any of them, and end at the last one or at a wider gap; the
        word before or after may be a part."""
        found = []
        for form in self.forms("".join(singles)):
            found += [form[i : i + SPACED] for i in range(len(form))]
        at = 0
        for k, gap in enumerate(gaps, 1):
            if gap > min(gaps):
                found += self.forms("".join(singles[at:k]))
                at = k
        if at:
            found += self.forms("".join(singles[at:]))
        if len(before) <= SPACED:
            found += self.forms("".join([before, *singles[:SPACED]]))
            found += self.forms("".join([before, *singles, after])) if len(singles) <= SPACED and 0 < len(after) <= SPACED else ()
        if 0 < len(after) <= SPACED:
            for k in range(max(0, len(singles) - SPACED), len(singles)):
                found += self.forms("".join([*singles[k:], after]))
        return found

    def texts(self, texts: list[str | None]) -> list[str]:
        texts = [t or "" for t in texts]
        codes, begins = points(texts)
        folded = LETTERS[codes]
        flat = PRINT[folded].tobytes().decode("ascii")
        keep = np.ones(len(codes), bool)
        keep[1:] = (folded[1:] != folded[:-1]) | (folded[1:] == OTHER) | (folded[1:] == SPACE_CODE)
        once = PRINT[folded[keep]].tobytes().decode("ascii").replace(" ", "~")
        place = np.concatenate([[0], np.cumsum(keep)])
        begin, end = begins.tolist(), [*(begins[1:] - 1).tolist(), len(codes) - 1]
        more: dict[int, list[str]] = {}
        spots = disguised(codes)
        whose = np.searchsorted(begins, [a for a, _ in spots], "right") - 1
        for (a, b), k in zip(spots, whose.tolist(), strict=True):
            more.setdefault(k, []).extend(self.forms(texts[k][a - begin[k] : b - begin[k]]))
        groups = spaced(codes, begins)
        whose = np.searchsorted(begins, [g[0][0] for g, _, _ in groups], "right") - 1
        for (group, before, after), k in zip(groups, whose.tolist(), strict=True):
            cut = lambda s: texts[k][s[0] - begin[k] : s[1] - begin[k]] if s else ""  # noqa: B023, E731
            gaps = [y[0] - x[1] for x, y in zip(group, group[1:], strict=False)]
            more.setdefault(k, []).extend(self.joined([cut(s) for s in group], gaps, cut(before), cut(after)))
        out = []
        for k, (a, b) in enumerate(zip(begin, end, strict=True)):
            forms = " ".join(more.get(k, ()))  # letters and spaces only
            out.append(f"{flat[a - 1 : b + 1]}{forms} {once[place[a - 1] : place[b + 1]]}{single_copies(forms).replace(' ', '~')}~")
        return out


def features(text: str) -> set[str]:
    """Whole words, and beginnings of longer ones, of a folded text: the first as " word ", the others as " begin". Those with
    doubled letters once have tildes for spaces."""
    found = set()
    for part, c in zip(text.partition("~")[::2], " ~", strict=True):
        for w in set(part.split(c)) - {""}:
            found.add(f"{c}{w}{c}")
            found.update(f"{c}{w[:n]}" for n in BEGINNINGS if len(w) >= n)
    return found


@dataclass
class Scorer:
    """Weights of features under a logistic regression, its bias, and the log odds from which on a text counts as toxic."""

    weights: dict[str, float]
    bias: float
    cut: float
    model: np.ndarray


def regression(row: np.ndarray, at: np.ndarray, label: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features: text row[i] has feature at[i] of size. Gradient descent with Adam's steps."""
    w, n, first, second = np.zeros(size + 1), len(label), np.zeros(size + 1), np.zeros(size + 1)
    w[size] = np.log((label.sum() + 1) / (n - label.sum() + 1))
    for step in range(1, ROUNDS + 1):
        z = np.bincount(row, weights=w[at], minlength=n) + w[size]
        error = 1 / (1 + np.exp(-z)) - label
        g = np.append(np.bincount(at, weights=error[row], minlength=size) + RIDGE * w[:size], error.sum())
        first += 0.1 * (g - first)
        second += 0.001 * (g * g - second)
        w -= 0.1 * (1 - step / (ROUNDS + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return w[:size], float(w[size])


def single_words(row: np.ndarray, at: np.ndarray, group: np.ndarray, label: np.ndarray, copies: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts, and of each one with more than one group of features this many copies that keep one group only, in turn.

    Toxic texts mostly hold several of their words. Without such copies each word would get a part of their weight, and a
    text with one of them alone would pass."""
    rows, ats, labels = [row], [at], [label]
    n, own = len(label), group[at]
    pair = np.unique(np.stack([row, own], axis=1), axis=0)
    first = np.searchsorted(pair[:, 0], np.arange(n + 1))
    many = np.diff(first)
    for c in range(copies):
        take = np.flatnonzero(many > c if c else many > 1)
        kept = np.full(n, -1)
        kept[take] = pair[first[take] + (c * 7919 + take) % many[take], 1] if len(take) else 0
        keep = kept[row] == own
        number = np.full(n, -1)
        number[take] = np.arange(len(take)) + sum(map(len, labels))
        rows.append(number[row[keep]])
        ats.append(at[keep])
        labels.append(label[take])
    return np.concatenate(rows), np.concatenate(ats), np.concatenate(labels)


def telling(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int, least: int, deviations: float) -> np.ndarray:
    """Which features least toxic texts have, at more than twice the rate of clean texts, and so many standard deviations
    over what toxic texts would have by chance."""
    rate = n_toxic / max(1, n_clean + n_toxic)
    chance = (clean + toxic) * rate
    over = toxic - chance > deviations * np.sqrt(chance * (1 - rate) + 1e-9)
    return (toxic >= least) & over & (toxic * max(1, n_clean) > 2 * (clean + 1) * max(1, n_toxic))


def fit(names: list[str], counts: np.ndarray, totals: np.ndarray, row: np.ndarray, at: np.ndarray, label: np.ndarray, fold: np.ndarray, least: int, deviations: float, alarms: float) -> tuple[dict[str, float], float, float]:
    """Weights, bias and cut. counts: texts with each name by fold and label (clean, toxic); totals: texts by fold and label;
    text row[i] has feature names[at[i]]; label and fold of each text.

    Each fold's texts are scored by features and weights from the other folds; the cut lets through the part alarms of
    clean texts as false alarms at most."""

    def part(out: int | None) -> tuple[np.ndarray, np.ndarray, float]:
        own = np.arange(FOLDS) != (-1 if out is None else out)
        taken = np.flatnonzero(telling(*counts[:, own].sum(axis=1).T, *totals[own].sum(axis=0), least, deviations))
        place = np.full(len(names), -1)
        place[taken] = np.arange(len(taken))
        use = (place[at] >= 0) & own[fold[row]]
        texts = np.flatnonzero(own[fold])
        number = np.full(len(label), -1)
        number[texts] = np.arange(len(texts))
        more = single_words(number[row[use]], place[at[use]], group[taken], label[texts].astype(float), COPIES_EACH)
        return taken, *regression(*more, len(taken))

    group = np.unique([f.strip(" ~")[: BEGINNINGS[0]] for f in names], return_inverse=True)[1]
    z = np.zeros(len(label))
    for k in range(FOLDS):
        taken, w, bias = part(k)
        weight = np.zeros(len(names))
        weight[taken] = w
        z[fold == k] = (np.bincount(row, weights=weight[at], minlength=len(label)) + bias)[fold == k]
    taken, w, bias = part(None)
    return dict(zip([names[k] for k in taken], w.tolist(), strict=True)), bias, lowest_cut(z, label, alarms)


def lowest_cut(z: np.ndarray, label: np.ndarray, alarms: float) -> float:
    """The least log odds, none under those of one in five, over which at most the part alarms of clean texts lie."""
    clean = np.sort(z[label == 0])
    if not len(clean):
        return 0.0
    edge = clean[max(0, len(clean) - 1 - int(alarms * len(clean)))]
    return float(max(edge + 1e-6, logit(0.2)))


@dataclass
class Sample:
    """What training needs of the labelled sample: telling features' names, texts with each by fold and label (clean, toxic),
    all texts by fold and label; text row[i] has feature at[i]; label and fold of each text."""

    names: list[str]
    counts: np.ndarray
    totals: np.ndarray
    row: np.ndarray
    at: np.ndarray
    label: np.ndarray
    fold: np.ndarray


def sampled(docs: DataFrame, labels: DataFrame, model: np.ndarray, fold: int, out_rest: int, bound: int, most_bytes: int, least: int, deviations: float) -> Sample:
    """The sample of learned(): restored once and written, then counted and listed from there."""
    space = Workspace(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~crc_rest(fold).isin(out_rest, -1))
    own = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int").alias("fold")
    texts = texts_of(docs).where("text is not null").join(F.broadcast(bounded(known, bound, "doc_id")), "doc_id").select("doc_id", "text", "label", own)
    names = [f"n{k}" for k in range(2 * FOLDS)]

    def restore(batches):
        restorer = Restorer(model)
        for batch in parts(batches, 1 << 20):
            found = pa.array(restorer.texts(batch.column("text").to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), batch.column("fold"), found], ["doc_id", "label", "fold", "text"])

    taken = within(space.keep(texts.mapInArrow(restore, "doc_id long, label int, fold int, text string")), most_bytes, "doc_id")

    def count(batches):
        for batch in parts(batches, 4 << 20):
            n: dict[str, list[int]] = {"": [0] * (2 * FOLDS)}
            cells = (2 * batch.column("fold").to_numpy() + batch.column("label").to_numpy()).tolist()
            for text, k in zip(batch.column("text").to_pylist(), cells, strict=True):
                n[""][k] += 1
                for f in features(text):
                    n.setdefault(f, [0] * (2 * FOLDS))[k] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n)), *(pa.array(c) for c in zip(*n.values(), strict=True))], ["feature", *names])

    kinds = ", ".join(f"{c} long" for c in names)
    sums = taken.mapInArrow(count, f"feature string, {kinds}").groupBy("feature").agg(*[F.sum(c).alias(c) for c in names])
    toxic = sum(F.col(f"n{2 * k + 1}") for k in range(FOLDS))
    clean = sum(F.col(f"n{2 * k}") for k in range(FOLDS))
    rows = sums.where(F.col("feature").eqNullSafe("") | ((toxic >= least) & (toxic > 0.02 * clean))).toArrow()
    found = rows.column("feature").to_pylist()
    counts = np.stack([rows.column(c).to_numpy() for c in names], axis=1).reshape(-1, FOLDS, 2) if found else np.zeros((0, FOLDS, 2), np.int64)
    at_all = [k for k, f in enumerate(found) if f == ""]
    totals = counts[at_all].sum(axis=0)
    # a feature that is telling without one fold, or by all
    some = telling(*counts.sum(axis=1).T, *totals.sum(axis=0), least, deviations)
    for k in range(FOLDS):
        own_ = np.arange(FOLDS) != k
        some |= telling(*counts[:, own_].sum(axis=1).T, *totals[own_].sum(axis=0), least, deviations)
    some[at_all] = False
    order = sorted(np.flatnonzero(some).tolist(), key=lambda k: found[k])
    chosen, counts = [found[k] for k in order], counts[order]

    def lists(batches):
        find = Finder({f: k for k, f in enumerate(chosen)})
        for batch in parts(batches, 4 << 20):
            hits = [sorted(find(t)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("fold"), pa.array(hits, pa.list_(pa.int32()))], ["label", "fold", "at"])

    # the sample is on the driver anyway: put in order there, many texts without any feature don't meet in one task
    found_ = taken.mapInArrow(lists, "label int, fold int, at array<int>").toArrow()
    space.drop(0)
    sample = sorted(zip(found_.column("at").to_pylist(), found_.column("label").to_pylist(), found_.column("fold").to_pylist(), strict=True))
    row = np.repeat(np.arange(len(sample)), [len(x) for x, _, _ in sample])
    at = np.array([f for x, _, _ in sample for f in x], np.int64)
    return Sample(chosen, counts, totals, row, at, *(np.array([x[k] for x in sample], np.int64) for k in (1, 2)))


def learned(docs: DataFrame, labels: DataFrame, fold: int, out_rest: int, bound: int = 20_000, most_bytes: int = 256 << 20, least: int = 4, deviations: float = 6.0, alarms: float = 0.01) -> Scorer:
    """A scorer from about bound labelled documents in all, of most_bytes bytes of restored text, none of the fold that is
    held out.

    The sample's texts are restored once. Those with each feature are counted in Spark by label and fold of the sample;
    telling() features, which lean to toxic texts, and the sample's texts as lists of them go to the driver, where fit()
    trains. A doc_id with two labels or texts counts with each; null ids, texts and labels don't count. The character model
    counts all texts. Without toxic or without clean texts no feature is taken."""
    model = language_model(trigram_counts(docs))
    s = sampled(docs, labels, model, fold, out_rest, bound, most_bytes, least, deviations)
    if not s.names:
        rate = (s.totals[:, 1].sum() + 1) / (s.totals.sum() + 2)
        return Scorer({}, float(logit(min(rate, 0.4))), 0.0, model)
    return Scorer(*fit(s.names, s.counts, s.totals, s.row, s.at, s.label, s.fold, least, deviations, alarms), model)


def logit(p):
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


class Finder:
    """Values of the features that a folded text has, each once."""

    def __init__(self, values: dict[str, object]):
        self.find = ahocorasick.Automaton()
        for f, v in values.items():
            self.find.add_word(f, (f, v))
        if values:
            self.find.make_automaton()

    def __call__(self, text: str) -> list:
        return list({f: v for _, (f, v) in self.find.iter(text)}.values()) if len(self.find) else []


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """doc_id, score (0 to 1, higher: toxic likelier) and predicted (1 if score >= 0.5) of every row of docs.

    The score is the logistic function of the summed weights of all features in the whole restored text, shifted so that
    the scorer's cut is 0.5; a text without any (also a null or empty one) has the score of the bias. Words without a
    letter, or disguised in a way that disguised(), spaced() and single_copies() don't name, are read as they are. One row
    out per row in, also of repeated rows and null ids; an empty table gives no rows; other columns are ignored. No shuffle.
    """

    def rows(batches):
        restorer, find = Restorer(scorer.model), Finder(scorer.weights)
        for batch in parts(batches, PART_BYTES):
            z = np.array([sum(find(t)) for t in restorer.texts(batch.column("text").to_pylist())], float) + scorer.bias - scorer.cut
            score = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return texts_of(docs).mapInArrow(rows, "doc_id long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, fold: int = 5, out_rest: int = 0) -> DataFrame:
    """doc_id, held_out, score and predicted of every row: scored() by a scorer learned() from labels.toxic of other folds."""
    found = scored(docs, learned(docs, labels, fold, out_rest))
    return found.select("doc_id", (crc_rest(fold) == out_rest).alias("held_out"), "score", "predicted")
