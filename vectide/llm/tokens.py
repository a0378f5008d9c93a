"""Byte-level BPE token counts by merging ragged symbol arrays rank by rank."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import process_cache
from .common import by_slices

LIMIT = 512
# pre-tokens of byte-level BPE; fixed by the published tokenizer, white space spelled out
PRE_TOKENS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
# characters handled at once, and pre-tokens whose counts a worker remembers
BLOCK_CHARS = 2**20
BLOCK_TOKENS = 2**16
REMEMBERED = 300_000
# bytes from which a pre-token is merged with the places of its pairs at hand
LONG = 256
_NONE = np.iinfo(np.int64).max


def _byte_symbols() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies.

    Printable Latin-1 bytes stand for themselves, the others take the characters
    from 256 on, in order.
    """
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    table = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [table[b] for b in range(256)]


class TokenCounter:
    """Counts tokens of texts; the vocabulary is arrays, the work is done on arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = (
            model["type"] == "BPE"
            and pre["type"] == "ByteLevel"
            and pre["use_regex"]
            and not pre["add_prefix_space"]
            and spec["normalizer"] is None
            and not model.get("ignore_merges")
            and not model.get("dropout")
        )
        added = spec["added_tokens"]
        if not plain or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"{path} is not a plain byte-level BPE tokenizer.")
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        keys = left << 32 | right
        self._order = np.argsort(keys, kind="stable")
        self._keys = keys[self._order]
        self._merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self._bytes = np.array([vocab[c] for c in _byte_symbols()], np.int64)
        self._words = regex.compile(PRE_TOKENS)
        special = sorted((regex.escape(t["content"]) for t in added), key=len, reverse=True)
        self._special = regex.compile("|".join(special)) if special else None
        self._known: dict[str, int] = {}

    def _ranks(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The rank of each symbol with its right neighbour; none across sequences."""
        keys = symbols[:-1] << 32 | symbols[1:]
        at = np.searchsorted(self._keys, keys).clip(max=len(self._keys) - 1)
        ranks = np.full(len(symbols), _NONE)
        ranks[:-1] = np.where(self._keys[at] == keys, self._order[at], _NONE)
        ranks[ends - 1] = _NONE
        return ranks

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        at = np.searchsorted(self._keys, keys).clip(max=len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._order[at], _NONE)

    def merged_lengths(self, sequences: list[bytes]) -> np.ndarray:
        """Symbols left of each byte sequence when no pair has a merge."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        result = np.zeros(len(sequences), np.int64)
        long = lengths > LONG
        for some, merge in ((~long, self._merged_short), (long, self._merged_long)):
            at = np.flatnonzero(some)
            if len(at):
                result[at] = merge([sequences[k] for k in at], lengths[at])
        return result

    def _merged_long(self, sequences: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """The same merges with each round's cost in proportion to its merges.

        A long sequence has about a round for each of its ranks. So places are kept in buckets by
        rank, with the places before and after each; a round takes the lowest rank of all
        sequences and looks anew only at pairs beside its merges. Merging one sequence does not
        touch another, and a merge only makes pairs of higher rank, so each sequence still
        merges its own lowest rank first.
        """
        symbols = self._bytes[np.frombuffer(b"".join(sequences), np.uint8)]
        n = len(symbols)
        ends = np.cumsum(lengths)
        # place n stands for no neighbour
        symbols = np.append(symbols, -1)
        after = np.arange(1, n + 2)
        before = np.arange(-1, n)
        after[ends - 1] = n
        before[ends - lengths] = n
        ranks = self._pair_ranks(symbols, symbols[after.clip(max=n)])
        ranks[n] = _NONE
        alive = np.ones(n, bool)
        order = np.argsort(ranks, kind="stable")
        order = order[ranks[order] != _NONE]
        cuts = np.flatnonzero(np.diff(ranks[order], prepend=-1, append=-1)) if len(order) else []
        buckets = {int(ranks[order[a]]): [order[a:b]] for a, b in zip(cuts, cuts[1:])}
        heap = sorted(buckets)
        while heap:
            rank = heappop(heap)
            # a place is noted twice if both of its sides changed
            places = np.unique(np.concatenate(buckets.pop(rank)).astype(np.int64))
            places = places[ranks[places] == rank]
            if not len(places):
                continue
            # in a run of overlapping places every other one merges
            fresh = np.ones(len(places), bool)
            fresh[1:] = after[places[:-1]] != places[1:]
            run = np.flatnonzero(fresh)
            into = np.arange(len(places)) - run[np.cumsum(fresh) - 1]
            places = places[into % 2 == 0]
            gone = after[places]
            beyond = after[gone]
            symbols[places] = self._merged[rank]
            alive[gone] = False
            ranks[gone] = _NONE
            after[places] = beyond
            before[beyond] = places
            beside = before[places]
            touched = np.concatenate([places, beside[beside != n]])
            found = self._pair_ranks(symbols[touched], symbols[after[touched]])
            ranks[touched] = found
            new = found != _NONE
            for place, value in zip(touched[new].tolist(), found[new].tolist()):
                held = buckets.get(value)
                if held is None:
                    buckets[value] = held = [[]]
                    heappush(heap, value)
                if not isinstance(held[-1], list):
                    held.append([])
                held[-1].append(place)
        return np.add.reduceat(alive.astype(np.int64), ends - lengths)

    def _merged_short(self, sequences: list[bytes], lengths: np.ndarray) -> np.ndarray:
        """All sequences lie in one array. In each round every sequence applies its own lowest
        rank at all its places, from the left where they overlap; a pair's result can
        only form pairs of higher rank, so this is the order of one merge at a time.
        Sequences without a merge leave the array with their length.
        """
        result = lengths.copy()
        symbols = self._bytes[np.frombuffer(b"".join(sequences), np.uint8)]
        active = np.flatnonzero(lengths > 1)
        symbols = symbols[np.repeat(lengths > 1, lengths)]
        lengths = lengths[active]
        while len(active):
            ends = np.cumsum(lengths)
            starts = ends - lengths
            ranks = self._ranks(symbols, ends)
            lowest = np.minimum.reduceat(ranks, starts)
            hit = (ranks == np.repeat(lowest, lengths)) & (ranks != _NONE)
            places = np.flatnonzero(hit)
            # in a run of overlapping places every other one merges
            fresh = np.ones(len(places), bool)
            fresh[1:] = np.diff(places) > 1
            run_start = places[fresh][np.cumsum(fresh) - 1]
            places = places[(places - run_start) % 2 == 0]
            symbols[places] = self._merged[ranks[places]]
            kept = np.ones(len(symbols), bool)
            kept[places + 1] = False
            lengths = np.add.reduceat(kept.astype(np.int64), starts)
            result[active] = lengths
            going = (lowest != _NONE) & (lengths > 1)
            symbols = symbols[kept][np.repeat(going, lengths)]
            active, lengths = active[going], lengths[going]
        return result

    def _count(self, words: list[list[str]]) -> list[int]:
        """Tokens of each list of pre-tokens; new pre-tokens are merged together."""
        known = self._known
        new = list({w for some in words for w in some if w not in known})
        if new:
            counts = self.merged_lengths([w.encode() for w in new]).tolist()
            if len(known) + len(new) > REMEMBERED:
                # those at hand are counted again if they are not new
                known.clear()
                new = list({w for some in words for w in some})
                counts = self.merged_lengths([w.encode() for w in new]).tolist()
            known.update(zip(new, counts))
        return [sum(map(known.__getitem__, some)) for some in words]

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text, without added begin or end; special strings are one token."""
        totals = [0] * len(texts)
        pending: list[tuple[int, list[str]]] = []
        held = 0

        def settle() -> None:
            for (k, _), n in zip(pending, self._count([words for _, words in pending])):
                totals[k] += n
            pending.clear()

        for k, text in enumerate(texts):
            pieces = [text]
            if self._special is not None:
                pieces = self._special.split(text)
                totals[k] += len(pieces) - 1
            for piece in pieces:
                if len(piece) <= BLOCK_CHARS:
                    pending.append((k, self._words.findall(piece)))
                    held += len(piece)
                else:
                    found = (m[0] for m in self._words.finditer(piece))
                    while block := list(islice(found, BLOCK_TOKENS)):
                        pending.append((k, block))
                        settle()
                if held >= BLOCK_CHARS:
                    settle()
                    held = 0
        settle()
        return totals


def token_counter(path: str) -> TokenCounter:
    """One counter for each vocabulary file and worker process."""
    loaded = process_cache("token_counters")
    if path not in loaded:
        loaded[path] = TokenCounter(path)
    return loaded[path]


def _counted(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = token_counter(path)

        def count(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array([len(text) for text in texts], pa.int64()),
                    pa.array(counter.counts([text.decode() for text in texts]), pa.int64()),
                ],
                ["id", "n_bytes", "n_tokens"],
            )

        return by_slices(batches, count)

    return run


def token_counts(
    df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """`(key, n_bytes, n_tokens, over_limit)` for every row of `df`, in one pass, no shuffle.

    `path` names a byte-level BPE tokenizer file, present on every machine. Whole texts
    are counted; long ones go through in blocks of pre-tokens, so memory is bounded by the
    text itself. A text without spaces is one pre-token, whose time grows nearly with its length. Null text counts as empty: 0 bytes, 0 tokens. Null keys and repeated rows
    are rows like others. An empty table gives an empty one. Other columns are not read.
    """
    kind = df.schema[key].dataType.simpleString()
    return (
        df.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
        .mapInArrow(_counted(path), f"id {kind}, n_bytes long, n_tokens long")
        .select(
            F.col("id").alias(key),
            "n_bytes",
            "n_tokens",
            (F.col("n_tokens") > limit).alias("over_limit"),
        )
    )
