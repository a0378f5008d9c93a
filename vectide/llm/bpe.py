"""Byte-level BPE over a corpus: every distinct word is encoded once, ids are put back in place."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import process_cache
from .lexicon import code_words, packed, put_back, unpacked, word_blocks
from .tokens import PRE_TOKENS

# ids in one batch of decoded rows
_BATCH_IDS = 2**20


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ids from a file of base64 tokens and ranks, once a process."""
    loaded = process_cache("ranks")
    if path not in loaded:
        with open(path, "rb") as file:
            lines = (line.split() for line in file if line.strip())
            loaded[path] = {base64.b64decode(token): int(rank) for token, rank in lines}
    return loaded[path]


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: neighbours of the lowest rank merge first, the leftmost of equals.

    A heap of pairs makes a word of n bytes cost n log n steps; a pair one of whose sides has
    changed since is skipped.
    """
    whole = ranks.get(word)
    if whole is not None:
        return [whole]
    n = len(word)
    end = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    pairs = []
    for at in range(n - 1):
        rank = ranks.get(word[at : at + 2])
        if rank is not None:
            pairs.append((rank, at, at + 1, at + 2))
    heapify(pairs)
    while pairs:
        _, at, middle, stop = heappop(pairs)
        if end[at] != middle or middle == n or end[middle] != stop:
            continue
        end[at], end[middle] = stop, -1
        if stop < n:
            before[stop] = at
            rank = ranks.get(word[at : end[stop]])
            if rank is not None:
                heappush(pairs, (rank, at, stop, end[stop]))
        left = before[at]
        if left >= 0:
            rank = ranks.get(word[left:stop])
            if rank is not None:
                heappush(pairs, (rank, left, at, stop))
    ids, at = [], 0
    while at < n:
        ids.append(ranks[word[at : end[at]]])
        at = end[at]
    return ids


def _pre_tokens() -> Callable[[bytes], list[str]]:
    found = regex.compile(PRE_TOKENS)
    return lambda text: found.findall(text.decode())


class _Split:
    """Cuts a text into pre-tokens; the pattern is compiled where it is used."""

    def __call__(self, text: bytes) -> list[str]:
        if "_found" not in self.__dict__:
            self._found = _pre_tokens()
        return self._found(text)

    def __getstate__(self) -> dict:
        return {}


class _Encoder:
    """Coders of buckets: each distinct word of a bucket is encoded once."""

    def __init__(self, path: str):
        self.path = path

    def __call__(self, bucket: int) -> Callable[[list[bytes]], bytes]:
        ranks = load_ranks(self.path)
        known: dict[bytes, list[int]] = {}

        def codes(words: list[bytes]) -> bytes:
            found = []
            for word in words:
                ids = known.get(word)
                if ids is None:
                    ids = known[word] = encode_word(word, ranks)
                found.append(ids)
            # how many ids each word has, then the ids
            return packed(np.array([len(words), *map(len, found), *chain.from_iterable(found)]))

        return codes


def _gather_ids(at: list[np.ndarray], codes: list[bytes]) -> Callable:
    """Ids of documents: the ids of their words, in the order of their positions."""
    sizes = np.zeros(sum(map(len, at)), np.int64)
    starts = np.zeros(len(sizes), np.int64)
    parts, total = [np.zeros(0, np.int64)], 0
    for numbers, packed_codes in zip(at, codes):
        values = unpacked(packed_codes)
        counts = values[1 : values[0] + 1]
        parts.append(values[values[0] + 1 :].astype(np.int32))
        sizes[numbers] = counts
        starts[numbers] = total + np.cumsum(counts) - counts
        total += len(parts[-1])
    flat = np.concatenate(parts).astype(np.int32)

    def assemble(documents: pa.StructArray, places: np.ndarray) -> pa.RecordBatch:
        spans = sizes[places]
        ends = np.concatenate([[0], np.cumsum(spans)])
        # the place in `flat` of every id: its word's start and how far it is into the word
        shift = starts[places] - ends[:-1]
        ids = flat[np.repeat(shift, spans) + np.arange(ends[-1])]
        words = np.concatenate([[0], np.cumsum(documents.field("n").to_numpy())])
        lists = pa.ListArray.from_arrays(pa.array(ends[words], pa.int32()), pa.array(ids))
        return pa.RecordBatch.from_arrays([documents.field("id"), lists], ["id", "ids"])

    return assemble


def encode_texts(
    df: DataFrame, ranks: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`(key, ids)` for every row of `df`: the ids of its whole text, without special tokens.

    `ranks` names a file of token ranks, present on every machine. Pre-tokens are exploded
    with their positions, block by block of text; the distinct pre-tokens of the whole table are
    shuffled, each is encoded once, and ids are joined back by block and put in place by
    position. A pre-token is one entry for each block it occurs in, so no word is a hot key, however
    often it occurs. One task holds one block (32 MB of text, or one longer text) at a time.

    Null and empty texts have no ids. Null keys, repeated rows and very long texts and words are
    rows like others. An empty table gives an empty one. Other columns are not read.
    """
    kind = df.schema[key].dataType
    texts = df.select(
        F.col(key).alias("id"), F.col(text).cast("string").cast("binary").alias("text")
    )
    documents, words = word_blocks(texts, _Split(), {"id": to_arrow_type(kind)})
    return put_back(
        documents,
        code_words(words, _Encoder(ranks)),
        _gather_ids,
        f"id {kind.simpleString()}, ids array<int>",
    ).withColumnRenamed("id", key)


def _decoded(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        most = max(ranks.values(), default=-1) + 1
        tokens: list[bytes] = [b""] * most
        known = np.zeros(most + 1, bool)
        for token, rank in ranks.items():
            tokens[rank] = token
            known[rank] = True
        sizes = np.array([len(t) for t in tokens] + [0], np.int64)
        starts = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(tokens), np.uint8)

        def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = batch.column("ids")
            ids = rows.flatten()
            ids = ids.fill_null(-1).to_numpy()
            if not known[np.where((ids < 0) | (ids >= most), most, ids)].all():
                raise ValueError("An id is not in the vocabulary.")
            spans = sizes[ids]
            ends = np.concatenate([[0], np.cumsum(spans)])
            into = np.arange(ends[-1]) - np.repeat(ends[:-1], spans)
            data = flat[np.repeat(starts[ids], spans) + into]
            lengths = rows.value_lengths().fill_null(0).to_numpy()
            at = ends[np.concatenate([[0], np.cumsum(lengths)])]
            texts = pa.Array.from_buffers(
                pa.large_binary(),
                len(rows),
                [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)],
            )
            columns = [batch.column(k) for k in range(batch.num_columns)]
            return pa.RecordBatch.from_arrays(
                [*columns, texts.cast(pa.binary())], [*batch.schema.names, "decoded"]
            )

        for batch in batches:
            lengths = batch.column("ids").value_lengths().fill_null(0).to_numpy()
            run_of = np.cumsum(lengths) // _BATCH_IDS
            cuts = [0, *(np.flatnonzero(np.diff(run_of)) + 1).tolist(), len(lengths)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield decode(batch.slice(a, b - a))
            del batch
            pa.default_memory_pool().release_unused()

    return run


def decode_ids(encoded: DataFrame, ranks: str) -> DataFrame:
    """`encoded` with `decoded` (binary): the bytes of its `ids`, token by token.

    The token-byte table is joined inside each batch: its size is the vocabulary's, whatever
    the corpus, so every worker holds it and no row is shuffled. Bytes are not checked to be
    UTF-8. Null ids have no bytes; an id outside the vocabulary is an error.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(_decoded(ranks), f"{kinds}, decoded binary")
