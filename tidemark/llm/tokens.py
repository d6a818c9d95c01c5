"""Token counts, byte-level BPE encoding and decoding over whole texts, by global distinct-word encoding."""

from __future__ import annotations

import base64
import hashlib
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed
from tidemark.llm.wordstore import LITERAL, encoded_rows, local_rows, row_ids

#: Letters below this code point are letters to every Unicode version in use: such words are one pre-token.
OLD_LETTERS = "ɐ"


def piece_counter(model_path: str):
    """On an executor: numbers of pieces of pre-tokens under a sentence-piece BPE model with a dummy prefix."""

    def load():
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        lone = 1 if model.id_to_piece(model.piece_to_id("▁")) == "▁" else len("▁".encode())  # a space alone: the model's own dummy

        def counts(words: list[str]) -> list[int]:
            found = model.encode([w[2:] if w[0] == LITERAL else w for w in words], num_threads=1)
            return [len(x) or lone for x in found]

        return counts

    return load


def byte_encoding(ranks_path: str, pattern: str):
    """The tiktoken encoding of a rank file, without special tokens."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), ranks


def byte_encoder(ranks_path: str, pattern: str, special: dict | None = None, tokenizer_path: str | None = None):
    """On an executor: ids (bytes, four each) of pre-tokens under a rank file.

    A pre-token of plain letters is one match of the pattern and goes to the merges directly. With tokenizer_path, a
    pre-token that holds one of the special strings goes to that tokenizers file, which treats them in its own way.
    """

    def load():
        encoding, _ = byte_encoding(ranks_path, pattern)
        whole = None
        if tokenizer_path:
            from tokenizers import Tokenizer

            whole = Tokenizer.from_file(tokenizer_path)

        def ids(word: str) -> bytes:
            if word[0] != LITERAL and word.isalpha() and max(word) < OLD_LETTERS:
                found = encoding._encode_single_piece(" " + word)
            else:
                segment = word[1:] if word[0] == LITERAL else " " + word
                if whole is not None and any(s in segment for s in special or ()):
                    found = whole.encode(segment, add_special_tokens=False).ids
                else:
                    found = encoding.encode_ordinary(segment)
            return array("I", found).tobytes()

        return lambda words: list(map(ids, words))

    return load


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row of docs (columns doc_id, text).

    Pieces are counted once per distinct pre-token of the corpus, joined to each document's pre-token frequencies and
    summed. A null or empty text has 0 bytes and 0 tokens; a null doc_id and repeated rows stay, one row out per row in;
    an empty table gives no rows; other columns are ignored. Documents are read twice: rows that come in another order the
    second time (no table or checkpoint) raise RuntimeError.
    """

    def emit(doc_id, n_bytes, places, words, times, sizes, begins, ids):
        sums = np.concatenate([[0], np.cumsum(sizes[words] * times)])
        n = sums[places[1:]] - sums[places[:-1]]
        return pa.table({"doc_id": pa.array(doc_id, pa.int64()), "n_bytes": n_bytes, "n_tokens": n, "over_limit": n > limit})

    return encoded_rows(docs, piece_counter(model_path), emit, "doc_id long, n_bytes long, n_tokens long, over_limit boolean", dummy=True, frequencies=True, only_counts=True)


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array<int>) of every row of docs: whole texts under a rank file, as tiktoken's encode_ordinary.

    Null and empty texts have no ids; a null doc_id and repeated rows stay; an empty table gives no rows. Documents are
    read twice: rows that come in another order the second time raise RuntimeError.
    """

    def emit(doc_id, n_bytes, places, words, times, sizes, begins, ids):
        rows = [x.astype(np.int32) for x in row_ids(places, words, sizes, begins, ids)]
        return pa.table({"doc_id": pa.array(doc_id, pa.int64()), "ids": pa.array(rows, pa.list_(pa.int32()))})

    return encoded_rows(docs, byte_encoder(ranks_path, pattern), emit, "doc_id long, ids array<int>")


def vocabulary(ranks_path: str) -> pa.Table:
    """The token-byte table of a rank file: id and bytes, one row for each token of a vocabulary of a fixed size. The driver
    reads the file as tasks do for their encodings: it is beside the library, not on the cluster's store."""
    _, ranks = byte_encoding(ranks_path, r".")
    return pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": pa.array(list(ranks), pa.binary())})


def token_bytes(spark: SparkSession, ranks_path: str) -> DataFrame:
    """vocabulary() as a table of the session."""
    return spark.createDataFrame(vocabulary(ranks_path))


def decoded(ids: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and data (binary) of rows of doc_id and ids (array<int>), joined with the token-byte table.

    Ids are exploded with their places, joined, and put together by place. Rows may share a doc_id or have none. Null or
    empty ids give empty data; an id that the table lacks gives no bytes; an empty table gives no rows."""
    spark = ids.sparkSession
    # monotonically increasing ids tell rows apart: the rows are written before, so that they are read the same twice
    rows = checkpointed(ids.select("doc_id", "ids", F.monotonically_increasing_id().alias("_row")))
    # a vocabulary of a fixed number of rows: its size does not grow with the data
    one = rows.select("_row", F.posexplode("ids").alias("at", "id")).join(F.broadcast(token_bytes(spark, ranks_path)), "id")
    hexes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", F.hex("bytes").alias("x")))), lambda t: t["x"]), "")
    whole = one.groupBy("_row").agg(F.unhex(hexes).alias("data"))
    return rows.select("doc_id", "_row").join(whole, "_row", "left").select("doc_id", F.coalesce("data", F.lit(b"")).alias("data"))


def joined_bytes(ids: np.ndarray, table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids, ascending, joined with the token-byte table: ids, where the bytes of each begin (one more), and the bytes."""
    own = pa.table({"id": pa.array(np.unique(ids).astype(np.int32))}).join(table, "id", join_type="inner").sort_by("id")
    offsets, data = utf8_like(own.column("bytes"))
    return own.column("id").to_numpy(), offsets, data


def utf8_like(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary column without nulls."""
    column = column.combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return offsets - offsets[0], np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and of the bytes they decode to, for every row of docs.

    ids_sha256 is over little-endian unsigned 32-bit ids, decoded_sha256 over the bytes that the join of these ids with
    the token-byte table gives; both lowercase hex. Edge cases as in encoded(); the rows must come in one order each time
    (a table or a checkpoint), else RuntimeError. Ids are digested where they are reassembled, not stored: there each
    chunk of documents joins its distinct ids with the table, and the bytes are put together by position.
    """
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast(vocabulary(ranks_path))

    def emit(doc_id, n_bytes, places, words, times, sizes, begins, ids):
        known, starts, data = joined_bytes(ids, table.value)
        n, of_ids, of_bytes = [], [], []
        for x in row_ids(places, words, sizes, begins, ids):
            n.append(len(x))
            of_ids.append(hashlib.sha256(x.astype("<u4").tobytes()).hexdigest())
            digest = hashlib.sha256()
            for at in range(0, len(x), 1 << 19):
                own = np.searchsorted(known, x[at : at + (1 << 19)])
                length = starts[own + 1] - starts[own]
                ends = np.cumsum(length)
                digest.update(data[np.repeat(starts[own] - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)])
            of_bytes.append(digest.hexdigest())
        return pa.table({"doc_id": pa.array(doc_id, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_bytes, pa.string())})

    return encoded_rows(docs, byte_encoder(ranks_path, pattern), emit, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_pieces(docs: DataFrame, tokenizer_path: str, ranks_path: str, pattern: str, size: int = 2048, end_id: int = 0, special: tuple[str, ...] = ("<|endoftext|>",)) -> DataFrame:
    """Pieces of at most size tokens of every row of docs: doc_id, piece, start, length, ids_crc32.

    A document is its ids, without added special tokens, and then end_id. Only a longer one is cut, into pieces of size
    tokens of which the first may be shorter. A null or empty text is the end_id alone. Each task encodes its own words: no
    shuffle. Edge cases as in encoded().
    """

    def emit(doc_id, n_bytes, places, words, times, sizes, begins, ids):
        out: list[list] = [[], [], [], [], []]
        for d, x in zip(doc_id, row_ids(places, words, sizes, begins, ids), strict=True):
            raw = memoryview(np.append(x, end_id).astype("<u4").tobytes())
            n = len(x) + 1
            cuts = [0, *range(n % size or size, n + 1, size)]
            for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                for to, v in zip(out, (d, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b])), strict=True):
                    to.append(v)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return local_rows(docs, byte_encoder(ranks_path, pattern, dict.fromkeys(special), tokenizer_path), emit, "doc_id long, piece int, start long, length long, ids_crc32 long")
