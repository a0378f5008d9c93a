"""Near-duplicates: MinHash bands, Bayesian pruning in steps, exact verification."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import cut
from .common import by_slices, in_bitmap, key_bitmap
from .shingles import shingle_hashes, shingle_set, word_hashes

SHINGLE_WORDS = 5
# links have 100 * intersection >= PERCENT * union
PERCENT = 75
# a pair at the threshold shares no band with probability (1 - 0.75**5)**30 = 0.0003
BANDS, BAND_ROWS = 30, 5
HASHES = BANDS * BAND_ROWS
# signatures keep 8 bits of each minimum: unequal minima agree by chance in 1 of 256
CHANCE = 1 / 256
# pairs are pruned when a link is less likely than this, checked after each batch
MISS = 1e-6
BATCH = 30
# new centres are chosen while a round leaves at most this share of its rows apart
WORTH = 0.5
_CHUNK = 4096
_FILTER_BITS = 26

_RANDOM = np.random.default_rng(9)
_FACTOR = _RANDOM.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _RANDOM.integers(0, 2**32, HASHES, dtype=np.uint32)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The lowest 8 bits of each hash function's minimum; memory is bounded by chunks."""
    values = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    for at in range(0, len(values), _CHUNK):
        hashed = np.multiply.outer(_FACTOR, values[at : at + _CHUNK])
        hashed += _SHIFT[:, None]
        np.minimum(least, hashed.min(axis=1), out=least)
    # the lowest bits of a product with an odd factor are weak; take higher ones, mixed
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def fewest_matches(percent: int = PERCENT, miss: float = MISS) -> list[int]:
    """After each batch, the fewest matches at which a link is not yet improbable.

    With a uniform prior on the rate of agreement, P(rate >= t | m of n agree) is the
    chance that a binomial of n + 1 trials at t gives at most m. The smallest m for which
    that is at least `miss` is needed to go on.
    """
    t = percent / 100
    t = t + (1 - t) * CHANCE
    needed = []
    for n in range(BATCH, HASHES + 1, BATCH):
        chance, m = (1 - t) ** (n + 1), 0
        while chance < miss:
            m += 1
            chance += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        needed.append(m)
    return needed


def _signed(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sign(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        keys, counts, signatures = [], [], []
        for text in texts:
            words = word_hashes(text)
            shingles = np.unique(shingle_hashes(words, size))
            keys.append(hashlib.md5(words.tobytes()).digest() if len(words) else None)
            counts.append(len(shingles))
            signatures.append(signature(shingles).tobytes() if len(words) else None)
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc"),
                pa.array(keys, pa.binary()),
                pa.array(counts, pa.int64()),
                pa.array(signatures, pa.binary()),
            ],
            ["doc", "key", "n", "signature"],
        )

    return lambda batches: by_slices(batches, sign)


def _sets(
    size: int, wanted: Broadcast
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sets(batch: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
        ids = batch.column("doc")
        some = ids.is_valid().to_numpy(zero_copy_only=False)
        some &= in_bitmap(wanted.value, ids.fill_null(0).to_numpy())
        found = [
            shingle_set(text, size).view(np.int64) for text, use in zip(texts, some) if use
        ]
        ends = np.cumsum([0, *map(len, found)])
        flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
        return pa.RecordBatch.from_arrays(
            [ids.filter(pa.array(some)), lists], ["node", "shingles"]
        )

    return lambda batches: by_slices(batches, sets)


def _pruned(
    needed: list[int],
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (
                np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(
                    -1, HASHES
                )
                for c in ("left", "right")
            )
            alive = np.arange(batch.num_rows)
            matches = np.zeros(batch.num_rows, np.int64)
            for step, least in enumerate(needed):
                span = slice(step * BATCH, (step + 1) * BATCH)
                matches[alive] += (left[alive, span] == right[alive, span]).sum(axis=1)
                alive = alive[matches[alive] >= least]
            kept = pa.array(alive)
            yield pa.RecordBatch.from_arrays(
                [batch.column("i").take(kept), batch.column("j").take(kept)], ["i", "j"]
            )

    return run


def _with_both(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
    """Pairs with the values of both ends, as `left` and `right`."""
    left = table.select(F.col("node").alias("i"), F.col(value).alias("left"))
    right = table.select(F.col("node").alias("j"), F.col(value).alias("right"))
    return pairs.join(left, "i").join(right, "j").select("i", "j", "left", "right")


def _labelled(rows: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """`rows` with the component of `node`; a node without links is one of its own."""
    label = labels.select(F.col("node").alias(node), F.col("component").alias(name))
    return rows.join(label, node, "left").withColumn(name, F.coalesce(name, node))


class _Search:
    """What the steps of one search share: signatures, sets and the links so far."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, percent: int):
        self.nodes, self.sets, self.percent = nodes, sets, percent
        self.links = nodes.limit(0).select(
            F.col("node").alias("i"), F.col("node").alias("j")
        )
        self.labels = nodes.limit(0).select("node", F.col("node").alias("component"))

    def connect(self, pairs: DataFrame) -> None:
        """Prunes pairs by signatures, verifies the rest on sets, joins what is linked."""
        survivors = _with_both(pairs, self.nodes, "signature").mapInArrow(
            _pruned(fewest_matches(self.percent)), "i long, j long"
        )
        shared = F.size(F.array_intersect("left", "right"))
        union = F.size("left") + F.size("right") - shared
        new = cut(
            _with_both(survivors, self.sets, "shingles")
            .filter(100 * shared >= self.percent * union)
            .select("i", "j")
        )
        if new.isEmpty():
            return
        self.links = self.links.unionByName(new)
        # only components that new links join are worked out
        across = _labelled(_labelled(new, self.labels, "i", "_a"), self.labels, "j", "_b")
        joined = connected_components(
            across.filter("_a != _b").select(F.col("_a").alias("i"), F.col("_b").alias("j"))
        ).select(F.col("node").alias("component"), F.col("component").alias("_root"))
        ends = new.select(F.explode(F.array("i", "j")).alias("node")).distinct()
        fresh = ends.join(self.labels, "node", "left_anti").select(
            "node", F.col("node").alias("component")
        )
        self.labels = cut(
            self.labels.unionByName(fresh)
            .join(joined, "component", "left")
            .select("node", F.coalesce("_root", "component").alias("component"))
        )


def _pairs_with(rows: DataFrame, head: str) -> DataFrame:
    return (
        rows.filter(F.col("node") != F.col(head))
        .select(F.least("node", head).alias("i"), F.greatest("node", head).alias("j"))
        .distinct()
    )


def _centred(rows: DataFrame, name: str) -> DataFrame:
    """`rows` (band, node) of bands with several nodes, with each band's central node.

    That is the node whose bands hold the most rows: a text that the others are edits of shares a
    band with more of them than they share with each other. So all bands of a group choose the same
    centre, and one comparison a member links most of it.
    """
    sizes = rows.groupBy("band").agg(F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    shared = cut(rows.join(sizes, "band"))
    scores = shared.groupBy("node").agg(F.sum("_size").alias("_score"))
    centres = (
        shared.join(scores, "node")
        .groupBy("band")
        .agg(F.max(F.struct("_score", (-F.col("node")).alias("_last"))).alias("_top"))
        .select("band", (-F.col("_top._last")).alias(name))
    )
    return shared.drop("_size").join(centres, "band")


def _needed_overlap(own: str, other_size: str, other_n: str, percent: int) -> Column:
    """Differences from a common head that two linked texts share at least.

    For sets a, b, h with differences A = a ^ h and B = b ^ h: |a ^ b| = |A| + |B| - 2 |A & B|, and
    a link has |a ^ b| <= (100 - percent) / (100 + percent) * (|a| + |b|).
    """
    apart = F.floor((100 - percent) * (F.col("n") + F.col(other_n)) / (100 + percent))
    return F.ceil((F.col(own) + F.col(other_size) - apart) / 2)


def _by_differences(members: DataFrame, search: _Search) -> DataFrame:
    """Pairs of one bucket in different components that may be linked, without trying all.

    `members` are (head, node) of buckets in which some node is in another component than the
    head. Such a node is not linked with the head; if it is linked with another node, both differ
    from the head in some of the same shingles, namely in at least `_needed_overlap` of them.
    Two sets that share c elements share one among the first |A| - c + 1 of A and |B| - c + 1 of B,
    in any common order; with the rarest first, edits of one text made apart from each other have
    no such element in common, whatever the size of their group. The bound of each node alone picks
    its first elements, that of the pair filters what meets.
    """
    p = search.percent
    # an id with several texts has several sets, told apart by `text` and `of`
    of_head = search.sets.select(
        F.col("node").alias("head"), F.col("text").alias("of"), F.col("shingles").alias("_of_head")
    )
    key, each = ["head", "of"], ["node", "text"]
    differing = (
        members.filter("node != head")
        .join(search.sets, "node")
        .join(of_head, "head")
        .select(
            *key,
            *each,
            "_open",
            "component",
            F.size("shingles").alias("n"),
            F.size("_of_head").alias("_n_head"),
            F.concat(
                F.array_except("shingles", "_of_head"), F.array_except("_of_head", "shingles")
            ).alias("_differences"),
        )
        .withColumn("d", F.size("_differences"))
    )
    elements = cut(
        differing.select(
            *key, *each, "_open", "component", "n", "_n_head", "d",
            F.explode("_differences").alias("e"),
        )
    )
    counts = elements.groupBy(*key, "e").agg(
        F.count(F.lit(1)).alias("_df"),
        (F.min("component") != F.max("component")).alias("_mixed"),
        F.max("_open").alias("_some_open"),
    )
    place = F.row_number().over(Window.partitionBy(*key, *each).orderBy("_df", "e"))
    # what an open node shares with any partner: that differs from the head by no less than their
    # sizes do; and what any node shares with an open one, which is not linked with the head
    apart = F.floor((100 - p) * (F.col("n") + F.col("_n_head")) / (100 + p))
    open_needs = F.greatest(F.lit(1), F.ceil((F.col("d") - apart) / 2))
    needed = F.when(F.col("_open"), open_needs).otherwise(F.floor(p * F.col("d") / (100 + p)) + 1)
    first = cut(
        elements.join(counts, [*key, "e"])
        .withColumn("place", place)
        .filter(F.col("place") <= F.col("d") - needed + 1)
        .filter("_mixed and _some_open")
        .select(*key, "e", "node", "_open", "component", "n", "d", "place")
    )
    b = first.select(
        *key,
        "e",
        *[F.col(c).alias(f"_{c}2") for c in ("node", "component", "n", "d", "place")],
        F.col("_open").alias("_open2"),
    )
    overlap = _needed_overlap("d", "_d2", "_n2", search.percent)
    behind = F.least(F.col("d") - F.col("place"), F.col("_d2") - F.col("_place2"))
    return (
        first.filter("_open")
        .join(b, [*key, "e"])
        .filter("component != _component2 and (not _open2 or node < _node2)")
        .filter(f"100 * least(n, _n2) >= {search.percent} * greatest(n, _n2)")
        # behind the first element that both have there must be room for the others
        .filter(behind + 1 >= overlap)
        .select(F.least("node", "_node2").alias("i"), F.greatest("node", "_node2").alias("j"))
        .distinct()
    )


def near_duplicates(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = SHINGLE_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """`(key, n_shingles, component_id, kept)` for every row of `df`.

    A text's set holds its distinct shingles of `size` words (the whole sequence, if
    shorter). Texts with 100 * intersection >= percent * union are linked; a component is
    named by its smallest id, and the row with that id is kept. Texts of the same words
    are one node from the start, whatever their number. Each band bucket compares its
    members with its central one (`_centred`), then those that this leaves in other components
    with a centre of their own, as long as that joins most of them. Members that still are in different
    components are compared where `_by_differences` cannot rule a link out. So a group of many
    edits of one text costs rows in proportion to its members. Pairs are pruned batch by batch
    (`fewest_matches`) and the rest is verified on whole sets.

    Null, empty or blank text: empty set, linked with nothing, a component of its own.
    Rows that repeat an id are one document: linked, with one component. A null id names
    nothing: such rows take the component of equal texts if one has an id, else null, and
    are never kept. An empty table gives an empty one. Other columns are not read.
    """
    texts = df.select(
        F.col(key).cast("long").alias("doc"),
        F.col(text).cast("string").cast("binary").alias("text"),
    )
    docs = cut(
        texts.mapInArrow(_signed(size), "doc long, key binary, n long, signature binary")
    )
    classes = cut(
        docs.filter("key is not null")
        .groupBy("key")
        .agg(
            F.min("doc").alias("node"),
            F.first("n").alias("n"),
            F.first("signature").alias("signature"),
        )
        .filter("node is not null")
    )
    bands = classes.select(
        "node",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(BANDS - 1)),
                lambda b: F.xxhash64(
                    F.substring("signature", b * BAND_ROWS + 1, F.lit(BAND_ROWS)), b
                ),
            )
        ).alias("band"),
    )
    members = cut(_centred(bands, "head"))
    wanted = df.sparkSession.sparkContext.broadcast(
        key_bitmap(members.select("node").distinct(), "node", _FILTER_BITS)
    )
    repeats = cut(
        docs.filter("doc is not null").groupBy("doc").count().filter("count > 1").select("doc")
    )
    sets = texts.mapInArrow(_sets(size, wanted), "node long, shingles array<long>").withColumn(
        "text", F.xxhash64("shingles")
    )
    if not repeats.isEmpty():
        sets = sets.dropDuplicates(["node", "text"])
    sets = cut(sets)
    search = _Search(classes, sets, percent)
    rows, head, count = members, "head", members.count()
    while count:
        search.connect(_pairs_with(rows, head))
        apart = _labelled(_labelled(rows, search.labels, "node", "_a"), search.labels, head, "_b")
        rows = cut(_centred(apart.filter("_a != _b").select("band", "node"), "centre"))
        head, before, count = "centre", count, rows.count()
        if count > WORTH * before:
            break
    near = _labelled(
        _labelled(members.select("head", "node").distinct(), search.labels, "node", "component"),
        search.labels,
        "head",
        "_main",
    ).withColumn("_open", F.col("component") != F.col("_main"))
    near = cut(near)
    # a head with one other member has been compared with it
    opened = cut(
        near.filter("node != head")
        .groupBy("head")
        .agg(F.max("_open").alias("_some"), F.count(F.lit(1)).alias("_others"))
        .filter("_some and _others > 1")
        .select("head")
    )
    if not opened.isEmpty():
        search.connect(_by_differences(near.join(opened, "head", "left_semi"), search))

    repeated = (
        docs.filter("doc is not null")
        .join(classes.select("key", "node"), "key")
        .filter("doc != node")
        .select(F.col("node").alias("i"), F.col("doc").alias("j"))
    )
    # an id with several texts joins their components; others have one class only
    repeated = cut(repeated.join(repeats, repeated["j"] == repeats["doc"], "left_semi"))
    labels = search.labels
    if not repeated.isEmpty():
        labels = connected_components(search.links.unionByName(repeated))
    named = classes.select(
        F.col("key").alias("_key"), F.col("node").alias("_node")
    ).join(labels.select(F.col("node").alias("_node"), "component"), "_node", "left")
    return (
        docs.join(named, docs["key"] == named["_key"], "left")
        .withColumn("component_id", F.coalesce("component", "_node", "doc"))
        .select(
            F.col("doc").alias(key),
            F.col("n").alias("n_shingles"),
            "component_id",
            F.coalesce(F.col("doc") == F.col("component_id"), F.lit(False)).alias("kept"),
        )
    )
