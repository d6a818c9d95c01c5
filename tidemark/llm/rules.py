"""Quality rules by repetition coverage: characters inside repeated n-grams and lines of a text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import SPACE, kept_beside, mixed, parts, running, texts_of, utf8, window_hashes, windows, word_hashes, words

PART_BYTES = 1 << 20
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Limits:
    """least_words and repeat_percent make up the base rules; the others are shares of a text's word characters or lines.

    n-gram shares count the characters of later copies only, from n = 5 on, as published for web text. So does the share
    of characters in repeated lines. The share of repeated lines themselves counts in texts of least_lines lines with words
    or more: in a shorter one, a boilerplate line or two make up a third of all."""

    least_words: int = 10
    repeat_percent: int = 20
    ngram_shares: tuple[tuple[int, float], ...] = ((5, 0.15), (6, 0.14), (7, 0.13), (8, 0.12), (9, 0.11), (10, 0.10))
    least_lines: int = 7
    line_share: float = 0.30
    line_char_share: float = 0.20


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which of these have occurred before."""
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        none = np.zeros(len(keys), bool)
        return none, none
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    any_ = twice[place] == keys
    at = np.flatnonzero(any_)
    order = at[np.argsort(keys[at], kind="stable")]
    later = np.zeros(len(keys), bool)
    later[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return any_, later


def covered(first: np.ndarray, size: int, n_words: int) -> np.ndarray:
    """Words inside any of the windows of size words from each of first on."""
    edge = np.zeros(n_words + 1, np.int64)
    np.add.at(edge, first, 1)
    np.add.at(edge, first + size, -1)
    return np.cumsum(edge[:-1]) > 0


def measures(batch: pa.RecordBatch, limits: Limits) -> dict[str, np.ndarray]:
    offsets, data = utf8(batch.column("text"))
    n_rows = batch.num_rows
    starts, ends, row = words(offsets, data)
    points = running((data & 0xC0) != 0x80)
    chars = points[ends] - points[starts]
    per_row = lambda flags, weights=None: np.bincount(flags, weights=weights, minlength=n_rows)
    total = per_row(row, chars).astype(np.int64)
    n_words = per_row(row).astype(np.int64)
    symbols = running(SYMBOLS[data])
    n_symbols = (symbols[offsets[1:]] - symbols[offsets[:-1]]).astype(np.int64)
    del symbols
    salt = mixed(np.arange(1, n_rows + 1, dtype=np.uint64))
    hashes = word_hashes(data, starts, ends)

    # n-grams: a window of n words is repeated only where the one of n - 1 words is
    bad = np.zeros(n_rows, bool)
    repeat_words = np.zeros(n_rows, np.int64)
    at = None
    for size, share in limits.ngram_shares:
        every = windows(row, size)
        at = every if at is None else np.intersect1d(every, at, assume_unique=True)
        any_, later = repeated(window_hashes(hashes, at, size) ^ salt[row[at]])
        if size == limits.ngram_shares[0][0]:
            inside = covered(at[any_], size, len(row))
            repeat_words = per_row(row[inside]).astype(np.int64)
        inside = covered(at[later], size, len(row))
        bad |= per_row(row[inside], chars[inside]) > share * total
        at = at[any_]

    # lines: from one newline or border of a row to the next
    breaks = np.flatnonzero(data == 10)
    line_start = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    line_row = np.concatenate([np.arange(n_rows), np.searchsorted(offsets, breaks, "right") - 1])
    line_row = np.sort(line_row)
    line_end = np.sort(np.concatenate([offsets[1:], breaks]))
    solid = running(~SPACE[data])
    full = solid[line_end] > solid[line_start]
    line_start, line_end, line_row = line_start[full], line_end[full], line_row[full]
    line_chars = points[line_end] - points[line_start]
    _, later = repeated(word_hashes(data, line_start, line_end) ^ salt[line_row])
    dup_lines, lines = per_row(line_row[later]).astype(np.int64), per_row(line_row)
    bad |= (lines >= limits.least_lines) & (dup_lines > limits.line_share * lines)
    bad |= per_row(line_row[later], line_chars[later]) > limits.line_char_share * per_row(line_row, line_chars)

    failed = (n_words < limits.least_words) | (100 * repeat_words > limits.repeat_percent * n_words)
    return {"n_words": n_words, "word_chars": total, "n_symbols": n_symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words, "base_failed": failed, "kept": ~(failed | bad)}


def quality_rules(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and kept of every row of docs.

    A word is a run of bytes other than the six ASCII spaces. A text that fails the base rules or repeats itself beyond
    the limits is not kept. A null text is empty: no words, so it fails. Words, n-grams and lines are compared by 64-bit
    hashes within one text. One row out per row in, whatever its doc_id; an empty table gives no rows; other columns are
    ignored. No shuffle.
    """

    def rows(batches):
        for batch in parts(batches, PART_BYTES):
            found = measures(batch, limits)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, found.values())], ["doc_id", *found])

    return texts_of(docs).mapInArrow(rows, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


def kept_rows(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The rows of docs (with all their columns) that quality_rules() keeps, judged in place, each by its own text: rows with
    a null doc_id and repeated rows stay or go like others; null and empty texts go; an empty table gives no rows."""
    return kept_beside(docs, lambda batch: (measures(part, limits)["kept"] for part in parts(iter([batch]), PART_BYTES)))
