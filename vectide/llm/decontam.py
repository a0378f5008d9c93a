"""Benchmark decontamination by templates: typed placeholders, window joins, slot checks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import in_bitmap, key_bitmap, text_slices
from .shingles import _BASE, _BYTE, _powers, mixed

WINDOW = 8
# shorter items are compared whole; below this many template tokens they are not searched
LEAST_TOKENS = 5
LEAST_LITERALS = 3
# an item leaks if this share of its windows is found in one document
COVERAGE = 0.5
# or if so many of its template tokens are found on one alignment
PASSAGE = 50
# windows of more items than this lead to an item only where they could make it leak alone
COMMON = 16
_FILTER_BITS = 27

# fixed values: words read as numbers, and units where they follow a number
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
    "fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy "
    "eighty ninety hundred thousand million billion dozen half twice"
).split()
UNITS = (
    "mm cm m km inch inches ft foot feet yard yards mile miles meter meters metre metres "
    "kilometer kilometers kilometre kilometres g kg mg gram grams kilogram kilograms lb lbs "
    "pound pounds ounce ounces oz ton tons l ml liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months "
    "year years percent dollar dollars cent cents euro euros degree degrees mph kmh watt watts "
    "volt volts joule joules byte bytes kb mb gb"
).split()
_UNSPACED = re.compile(
    "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff"
    "\U00020000-\U0003ffff]"
)
LITERAL, NUMBER, NAME, UNIT = range(4)
# how a text is read: names by context, no names (case folded), every capitalised word a
# name, no placeholders at all (case folded)
TYPED, FOLDED, CAPITALS, VERBATIM = READINGS = range(4)

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:\n\""]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Template(NamedTuple):
    """One entry per template token of a block of texts.

    The text it comes from, its place there, its hash, its kind and its value.
    """

    owners: np.ndarray
    places: np.ndarray
    hashes: np.ndarray
    kinds: np.ndarray
    values: np.ndarray


class Tokens(NamedTuple):
    """What all readings of a block of texts share; one entry per token.

    The text it comes from, its hash, whether the one before is of the same text, whether it opens a sentence,
    whether it has a capital first letter, and its kind, names apart.
    """

    owners: np.ndarray
    hashes: np.ndarray
    same: np.ndarray
    opens: np.ndarray
    upper: np.ndarray
    kinds: np.ndarray


def _hashes(data: np.ndarray, starts: np.ndarray, inside: np.ndarray) -> np.ndarray:
    spans = np.diff(starts, append=len(data))
    place = np.arange(len(data)) - np.repeat(starts, spans)
    values = _BYTE[_LOWER[data]] * _powers(int(spans.max()))[place]
    values[~inside] = 0
    return mixed(np.add.reduceat(values, starts))


def _folded(text: bytes) -> bytes:
    """Without the case of letters beyond ASCII, which the hashes fold by themselves.

    Each character of a script without spaces is a word.
    """
    return _UNSPACED.sub(r" \g<0> ", text.decode("utf-8", "replace").casefold()).encode()


def _among(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes are in a sorted table."""
    return table[np.searchsorted(table, hashes).clip(max=len(table) - 1)] == hashes


def _known(words: list[str]) -> np.ndarray:
    return np.sort(
        [
            _hashes(d := np.frombuffer(w.encode(), np.uint8), np.array([0]), _WORD[d])[0]
            for w in words
        ]
    )


def templates(texts: list[bytes], reading: int = TYPED) -> Template:
    """The templates of a block of texts, one after the other.

    Tokens are words, and numbers (with points and commas between digits) that open a word.
    Numbers, number words, units after a number, and names become placeholders. Runs of
    numbers or of names are one slot.

    Read as TYPED, a name is a capitalised word that does not start a sentence, and the same
    word where it does. That depends on the text's own use of capitals, so there are two
    more readings: FOLDED has no names and no case; for CAPITALS every capitalised word is
    a name, whatever stands elsewhere in the text, and a run of names ends with its sentence.
    VERBATIM is folded as well and has no placeholders: texts made of numbers or names have
    words enough to be found as they are.
    """
    return _read(_tokens(_read_as(texts, reading)), reading)


def _read_as(texts: list[bytes], reading: int) -> list[bytes]:
    if reading in (FOLDED, VERBATIM):
        return [t if t.isascii() else _folded(t) for t in texts]
    return texts


def _tokens(texts: list[bytes]) -> Tokens | None:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    limits = np.cumsum([len(text) + 1 for text in texts])
    digit = _DIGIT[data]
    mark = (data == 46) | (data == 44)
    mark[1:] &= digit[:-1]
    mark[:-1] &= digit[1:]
    mark[0] = mark[-1] = False
    digit |= mark
    inside = _WORD[data] | mark
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    # a number at the head of a word is a token of its own (5km); digits after letters are part of
    # the word (w123)
    letters = np.cumsum(inside & ~digit)
    ahead = np.maximum.accumulate(np.where(first, letters - (inside & ~digit), 0))
    first[1:] |= inside[1:] & ~digit[1:] & digit[:-1] & (letters[:-1] == ahead[:-1])
    starts = np.flatnonzero(first)
    if not len(starts):
        return None
    owners = np.searchsorted(limits, starts, side="right")
    stops = np.cumsum(_STOP[data] & ~inside)[starts]
    lead = starts[0]
    hashes = _hashes(data[lead:], starts - lead, inside[lead:])

    same = np.zeros(len(starts), bool)
    same[1:] = owners[1:] == owners[:-1]
    heads = data[starts]
    kinds = np.full(len(starts), LITERAL, np.int8)
    kinds[digit[starts] | _among(_NUMBER_HASHES, hashes)] = NUMBER
    follows = same.copy()
    follows[1:] &= kinds[:-1] == NUMBER
    follows &= kinds == LITERAL
    follows[follows] = _among(_UNIT_HASHES, hashes[follows])
    kinds[follows] = UNIT
    opens = ~same
    opens[1:] |= stops[1:] > stops[:-1]
    # capital letters of ASCII and of Latin-1 in UTF-8
    upper = _UPPER[heads] | ((heads == 0xC3) & (data[starts + 1] < 0x9F))
    upper &= kinds == LITERAL
    return Tokens(owners, hashes, same, opens, upper, kinds)


def _read(tokens: Tokens | None, reading: int) -> Template:
    """One reading of a block; FOLDED and VERBATIM take the tokens of folded texts."""
    if tokens is None:
        none = np.zeros(0, np.int64)
        return Template(none, none, none.astype(np.uint64), none, none.astype(np.uint64))
    owners, hashes, same, opens, upper, kinds = tokens
    kinds = np.full(len(kinds), LITERAL, np.int8) if reading == VERBATIM else kinds.copy()
    names = upper & ~opens
    if reading == CAPITALS:
        kinds[upper] = NAME
    elif reading == TYPED and names.any():
        own = hashes ^ mixed(owners.astype(np.uint64))
        kinds[upper & _among(np.unique(own[names]), own)] = NAME

    new = ~same | (kinds == LITERAL) | (kinds == UNIT)
    new[1:] |= kinds[1:] != kinds[:-1]
    if reading == CAPITALS:
        new |= opens & (kinds == NAME)
    slots = np.flatnonzero(new)
    place = np.arange(len(new)) - slots[np.cumsum(new) - 1]
    values = mixed(np.add.reduceat(hashes * (2 * place + 1).astype(np.uint64), slots))
    owners, kinds = owners[slots], kinds[slots]
    begins = np.flatnonzero(np.diff(owners, prepend=-1))
    places = np.arange(len(slots)) - np.repeat(begins, np.diff(begins, append=len(slots)))
    literal = kinds == LITERAL
    shown = np.where(literal, hashes[slots], _PLACEHOLDER[kinds])
    return Template(owners, places, shown, kinds, values)


_NUMBER_HASHES = _known(NUMBER_WORDS)
_UNIT_HASHES = _known(UNITS)
_PLACEHOLDER = mixed(np.arange(1, 5, dtype=np.uint64))
_TAG = mixed(np.arange(len(READINGS), dtype=np.uint64)).view(np.int64)


def windows(found: Template, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First token and hash of all runs of `size` tokens of one text with enough different literals."""
    count = max(0, len(found.hashes) - size + 1)
    total = np.full(count, size, np.uint64)
    literals = np.zeros(count, np.int8)
    for k in range(size if count else 0):
        total *= _BASE
        here = found.hashes[k : k + count]
        total += here
        new = found.kinds[k : k + count] == LITERAL
        for j in range(k):
            new &= found.hashes[j : j + count] != here
        literals += new
    whole = found.owners[:count] == found.owners[len(found.owners) - count :]
    at = np.flatnonzero(whole & (literals >= LEAST_LITERALS))
    return at, mixed(total[at]).view(np.int64)


_WINDOWS = "id long, reading int, size int, hash long, place int, slots array<long>"
_SCHEMA = pa.schema(
    [
        ("id", pa.int64()),
        ("reading", pa.int32()),
        ("size", pa.int32()),
        ("hash", pa.int64()),
        ("place", pa.int32()),
        ("slots", pa.list_(pa.int64())),
    ]
)


def _cut_windows(
    sizes: list[int] | None, wanted: Broadcast | None
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Windows of `sizes` whose hash is wanted; without `sizes`, of each item's own size.

    In every reading; a hash holds its reading, so the bitmap tells readings apart.
    """

    def rows(ids: list, texts: list[bytes], tokens: Tokens | None, reading: int) -> Iterator[tuple]:
        found = _read(tokens, reading)
        lengths = np.bincount(found.owners, minlength=len(texts))
        for size in sizes or range(LEAST_TOKENS, WINDOW + 1):
            at, hashes = windows(found, size)
            hashes ^= _TAG[reading]
            if sizes is None:
                fit = np.minimum(lengths[found.owners[at]], WINDOW) == size
            else:
                fit = in_bitmap(wanted.value, hashes)
            for k, code in zip(at[fit].tolist(), hashes[fit].tolist()):
                span = slice(k, k + size)
                slots = found.values[span][found.kinds[span] != LITERAL]
                yield (
                    ids[found.owners[k]],
                    reading,
                    size,
                    code,
                    int(found.places[k]),
                    slots.view(np.int64).tolist(),
                )

    def read(ids: list, texts: list[bytes]) -> Iterator[tuple]:
        """All readings; texts in ASCII, which the hashes fold, have the same tokens in each."""
        plain = [text.isascii() for text in texts]
        for kind in {*plain}:
            mine = [k for k, p in enumerate(plain) if p == kind]
            names, part = [ids[k] for k in mine], [texts[k] for k in mine]
            tokens = _tokens(part)
            for reading in (TYPED, CAPITALS):
                yield from rows(names, part, tokens, reading)
            if not kind:
                tokens = _tokens(_read_as(part, FOLDED))
            for reading in (FOLDED, VERBATIM):
                yield from rows(names, part, tokens, reading)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for at, texts in text_slices(batch):
                made = list(read(ids[at : at + len(texts)], texts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in made], f.type) for k, f in enumerate(_SCHEMA)],
                    schema=_SCHEMA,
                )
            del batch
            pa.default_memory_pool().release_unused()

    return run


def _texts(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(
        F.col(key).cast("long").alias("id"),
        F.col(text).cast("string").cast("binary").alias("text"),
    )


def _met(found: DataFrame, items: DataFrame, coverage: float, passage: int) -> DataFrame:
    """Windows of documents with the items' equal ones, for all pairs that may leak.

    Many items may share a preamble, and many documents hold it: these would all meet. So windows of
    more than COMMON items lead to an item only if its common windows could make it leak
    without any other. Other items are led to by the rest of their windows, one of which each of
    their leaks holds; the common ones are then looked up for pairs already met.
    """
    shared = ["reading", "size", "hash"]
    often = cut(
        items.groupBy(*shared).count().filter(F.col("count") > COMMON).select(*shared)
    ).withColumn("_often", F.lit(True))
    marked = cut(items.join(often, shared, "left").fillna(False, ["_often"]))
    tokens = F.flatten(
        F.transform(
            F.collect_set(F.when(F.col("_often"), F.col("place"))),
            lambda p: F.sequence(p, p + F.lit(WINDOW - 1)),
        )
    )
    alone = (
        marked.groupBy("_item", "reading")
        .agg(
            (F.count_if("_often") >= coverage * F.count(F.lit(1))).alias("_enough"),
            (F.size(F.array_distinct(tokens)) >= passage).alias("_long"),
        )
        .filter("_enough or _long")
        .select(F.col("_item").alias("_i"), F.col("reading").alias("_r"))
    )
    same = F.col("_item").eqNullSafe(F.col("_i")) & (F.col("reading") == F.col("_r"))
    led = marked.filter("not _often").drop("_often").unionByName(
        marked.filter("_often").join(alone, same, "left_semi").drop("_often")
    )
    first = cut(found.join(led, shared))
    rest = marked.filter("_often").join(alone, same, "left_anti").drop("_often")
    pairs = first.select(
        F.col("_doc").alias("_d"), F.col("_item").alias("_i"), F.col("reading").alias("_r")
    ).distinct()
    asked = rest.join(pairs, same).drop("_i", "_r").select(
        "_d", "_item", *[F.col(c).alias(f"_{c}2") for c in shared], "place", "slots"
    )
    equal = F.col("_doc").eqNullSafe(F.col("_d"))
    for c in shared:
        equal = equal & (F.col(c) == F.col(f"_{c}2"))
    second = found.join(asked, equal).select(*first.columns)
    return first.unionByName(second)


def leaks(
    df: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    item: str = "item_id",
    text: str = "text",
    coverage: float = COVERAGE,
    passage: int = PASSAGE,
) -> DataFrame:
    """One row per document and benchmark item that leaks into it.

    `(key, item, windows, found, coverage, slots, changed, reparameterised)`: how many of the
    item's different template windows there are and are found, its slots in them, and how many of
    these have another value in the document. An alignment (document place minus item place)
    is consistent if one value of the item always meets one value of the document; of an
    inconsistent one only the windows with the item's own values count. Windows with fewer than LEAST_LITERALS words that are not slots are no evidence.

    Items and documents are read in each of READINGS, apart from each other, so neither the
    case of a copy nor capitals elsewhere in its document hide it. An item leaks if one
    reading reaches `coverage`, or `passage` tokens on one alignment; the row tells of the one with the largest coverage, then
    with the fewest changed slots.

    A bitmap of fixed size, made from the benchmark's windows, lets candidate windows
    through; an exact join on the window's hash follows, so documents' windows are shuffled
    only where they can match, whatever the sizes of either side.

    Null, empty or short texts have no windows and leak nothing; items under LEAST_TOKENS
    tokens in every reading (the most are VERBATIM) are not searched. Rows that repeat an id, or have none, are one document or
    item each. Empty tables give an empty one. Other columns are not read.
    """
    # a window that an item repeats counts once, at its first place: a document's window meets
    # each item once
    every = _texts(benchmark, item, text).mapInArrow(_cut_windows(None, None), _WINDOWS)
    items = cut(
        every.groupBy("id", "reading", "size", "hash")
        .agg(F.min(F.struct("place", "slots")).alias("_first"))
        .select("id", "reading", "size", "hash", "_first.*")
    )
    sizes = [row["size"] for row in items.select("size").distinct().collect()]
    wanted = df.sparkSession.sparkContext.broadcast(key_bitmap(items, "hash", _FILTER_BITS))
    if sizes:
        hits = _texts(df, key, text).mapInArrow(_cut_windows(sizes, wanted), _WINDOWS)
    else:
        hits = items.limit(0)
    found = cut(
        hits.select(
            F.col("id").alias("_doc"),
            "reading",
            "size",
            "hash",
            F.col("place").alias("_at"),
            F.col("slots").alias("_slots"),
        )
    )
    joined = _met(found, items.withColumnRenamed("id", "_item"), coverage, passage)
    aligned = joined.select(
        "_doc",
        "_item",
        "reading",
        "size",
        (F.col("_at") - F.col("place")).alias("_shift"),
        "place",
        F.arrays_zip(F.col("slots").alias("mine"), F.col("_slots").alias("theirs")).alias("_pairs"),
    ).distinct()
    unchanged = F.forall("_pairs", lambda p: p["mine"] == p["theirs"])
    # one item's places on one alignment: bounded by the item
    runs = (
        aligned.groupBy("_doc", "_item", "reading", "_shift")
        .agg(
            F.max("size").alias("_size"),
            F.collect_set("place").alias("_places"),
            F.collect_set(F.when(unchanged, F.col("place"))).alias("_verbatim"),
            F.array_distinct(F.flatten(F.collect_list("_pairs"))).alias("_all"),
            F.array_distinct(F.flatten(F.collect_list(F.when(unchanged, F.col("_pairs"))))).alias(
                "_same"
            ),
        )
        .withColumn(
            "_consistent",
            F.size("_all") == F.size(F.array_distinct(F.transform("_all", lambda p: p["mine"]))),
        )
        .select(
            "_doc",
            "_item",
            "reading",
            "_size",
            F.when(F.col("_consistent"), F.col("_places"))
            .otherwise(F.col("_verbatim"))
            .alias("_places"),
            F.when(F.col("_consistent"), F.col("_all")).otherwise(F.col("_same")).alias("_pairs"),
        )
    )
    total = items.groupBy("id", F.col("reading").alias("_reading")).agg(
        F.count(F.lit(1)).alias("windows")
    )
    tokens = F.flatten(
        F.transform("_places", lambda p: F.sequence(p, p + F.col("_size") - F.lit(1)))
    )
    changed = F.filter("_pairs", lambda p: p["mine"] != p["theirs"])
    return (
        runs.select(
            "_doc",
            "_item",
            "reading",
            F.explode("_places").alias("_place"),
            F.size(F.array_distinct(tokens)).alias("_tokens"),
            F.size("_pairs").alias("_slots"),
            F.size(changed).alias("_changed"),
        )
        .groupBy("_doc", "_item", "reading")
        .agg(
            F.count_distinct("_place").alias("found"),
            F.max("_tokens").alias("_tokens"),
            F.max("_slots").alias("slots"),
            F.min("_changed").alias("changed"),
        )
        .join(
            total,
            F.col("_item").eqNullSafe(F.col("id")) & (F.col("reading") == F.col("_reading")),
        )
        .withColumn("coverage", F.least(F.col("found") / F.col("windows"), F.lit(1.0)))
        .filter((F.col("coverage") >= coverage) | (F.col("_tokens") >= passage))
        .groupBy("_doc", "_item")
        .agg(
            F.max_by(
                F.struct("windows", "found", "coverage", "slots", "changed"),
                F.struct("coverage", -F.col("changed"), -F.col("reading")),
            ).alias("_best")
        )
        .select("_doc", "_item", "_best.*")
        .select(
            F.col("_doc").alias(key),
            F.col("_item").alias(item),
            "windows",
            "found",
            "coverage",
            "slots",
            "changed",
            (F.col("changed") > 0).alias("reparameterised"),
        )
    )
