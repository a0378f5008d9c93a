"""A Merkle manifest of a dataset: trees of eight, grown by appends that carry their witnesses."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import ordered_parts, running_total

# nodes that become one, and levels that one task builds: blocks of ARITY**LEVELS nodes
ARITY, LEVELS = 8, 4
BLOCK = ARITY**LEVELS
DIGEST = 32
# columns that identify a document, in the order in which they are hashed
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def combined(digests: list[bytes]) -> bytes:
    """The parent of nodes: the SHA-256 of their digests' hex text, one after another."""
    return sha256(b"".join(digests).hex().encode()).digest()


class Frontier:
    """The open right edge of a tree that grows by appends, with the witnesses below it.

    `levels[k]` holds the nodes of the last, unfinished run at height k: each with the
    leaves under it. When a run's last sibling arrives its parent is appended one level up, and the
    witness of every leaf under the run gains one step: the leaf's place in the run and the
    other nodes. So a witness is partial as long as its subtree is open, and nothing else is kept.
    """

    def __init__(self, witnesses: bool = True):
        self.levels: list[list[tuple[bytes, list[int]]]] = []
        self.witnesses: list[bytearray] = []
        self._carry = witnesses

    def append(self, node: bytes) -> None:
        leaves = []
        if self._carry:
            leaves = [len(self.witnesses)]
            self.witnesses.append(bytearray())
        self._push(0, node, leaves)

    def _push(self, height: int, node: bytes, leaves: list[int]) -> None:
        if height == len(self.levels):
            self.levels.append([])
        run = self.levels[height]
        run.append((node, leaves))
        if len(run) == ARITY:
            self._complete(height)

    def _complete(self, height: int) -> None:
        run, self.levels[height] = self.levels[height], []
        digests = [node for node, _ in run]
        for place, (_, leaves) in enumerate(run):
            if leaves:
                others = b"".join(digests[:place] + digests[place + 1 :])
                step = bytes((place, len(run) - 1)) + others
                for leaf in leaves:
                    self.witnesses[leaf] += step
        self._push(height + 1, combined(digests), [k for _, leaves in run for k in leaves])

    def close(self, height: int | None) -> bytes:
        """The root: of a tree of that height, or of the lowest that leaves one node."""
        at = 0
        while height is None or at < height:
            run = self.levels[at] if at < len(self.levels) else []
            above = any(self.levels[at + 1 :])
            if height is None and len(run) == 1 and not above:
                break
            if run:
                self._complete(at)
            at += 1
        [(root, _)] = self.levels[at]
        return root


def fold(leaf: bytes, witness: bytes) -> bytes:
    """The root that follows from a leaf and its witness."""
    at = 0
    while at < len(witness):
        place, others = witness[at], witness[at + 1]
        at += 2
        split, stop = at + place * DIGEST, at + others * DIGEST
        leaf = sha256(
            (witness[at:split] + leaf + witness[split:stop]).hex().encode()
        ).digest()
        at = stop
    return leaf


def siblings(witness: bytes) -> bytes:
    """All siblings' digests as hex text, from the leaf up, left to right."""
    parts, at = [], 0
    while at < len(witness):
        stop = at + 2 + witness[at + 1] * DIGEST
        parts.append(witness[at + 2 : stop])
        at = stop
    return b"".join(parts).hex().encode()


def _grown(table: pa.Table, witnesses: bool) -> tuple[pa.Table, Frontier, bytes]:
    """One block's nodes in order, appended to a tree of their own, and its root."""
    table = table.sort_by("rank")
    frontier = Frontier(witnesses)
    for node in table.column("node"):
        frontier.append(node.as_py())
    # a block with others beside it has all its levels, even where a last run is one node
    alone = table.column("alone")[0].as_py()
    return table, frontier, frontier.close(None if alone else LEVELS)


def _rooted(table: pa.Table) -> pa.Table:
    table, _, root = _grown(table, witnesses=False)
    first = table.slice(0, 1).select(["tree", "block", "alone"])
    return first.append_column("node", pa.array([root], pa.binary()))


def _witnessed(table: pa.Table) -> pa.Table:
    table, frontier, _ = _grown(table, witnesses=True)
    above = table.column("above")[0].as_py() or b""
    found = pa.array([bytes(w) + above for w in frontier.witnesses], pa.binary())
    return table.drop(["block", "alone", "above"]).append_column("witness", found)


def grow(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Rounds of appends, and `(tree, node)` with each tree's root.

    `nodes` holds (tree string, rank long, node binary) with ranks without gaps from 0 in each
    tree, and columns that only go along. Blocks of BLOCK neighbours are appended each in a task
    of its own; their roots are the appends of the next round, so a tree of 7e10 nodes takes
    three rounds and no task sees more than a block, however large one tree is.
    """
    rounds, roots = [], []
    while True:
        # a tree's first block is alone unless a node follows it; no join on a hot tree is needed
        large = nodes.filter(F.col("rank") == BLOCK).select(
            "tree", F.lit(0).cast("long").alias("block"), F.lit(False).alias("alone")
        )
        placed = cut(
            nodes.withColumn("block", F.floor(F.col("rank") / BLOCK))
            .join(large, ["tree", "block"], "left")
            .withColumn("alone", F.coalesce("alone", F.col("block") == 0))
        )
        found = cut(
            placed.select("tree", "rank", "node", "block", "alone")
            .groupBy("tree", "block")
            .applyInArrow(_rooted, "tree string, block long, alone boolean, node binary")
        )
        rounds.append(placed)
        roots.append(found.filter("alone").select("tree", "node"))
        nodes = found.filter("not alone").select("tree", F.col("block").alias("rank"), "node")
        if nodes.isEmpty():
            break
    every = roots[0]
    for some in roots[1:]:
        every = every.unionByName(some)
    return rounds, every


def attach_witnesses(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first round's nodes with `witness` and what `above` says of their tree.

    `above` holds (tree, above binary: the witness of the tree's own root, or null) and columns that go
    along. From the last round down, every block is appended once more with witnesses, and its
    nodes' witnesses end in the block's own.
    """
    along = [c for c in above.columns if c not in ("tree", "above")]
    whole = above.withColumn("block", F.lit(0).cast("long"))
    witnesses = None
    for placed in reversed(rounds):
        # the only block of a tree is below what is above the tree, others below the next round
        upper = whole
        if witnesses is not None:
            upper = witnesses.select(
                "tree", F.col("rank").alias("block"), F.col("witness").alias("above"), *along
            ).unionByName(whole.join(placed.filter("alone and rank = 0"), "tree", "left_semi"))
        joined = placed.join(upper, ["tree", "block"])
        columns = [f for f in joined.schema if f.name not in ("block", "alone", "above")]
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
        joined = joined.select(*[f.name for f in columns], "block", "alone", "above")
        witnesses = joined.groupBy("tree", "block").applyInArrow(
            _witnessed, f"{kinds}, witness binary"
        )
        if placed is not rounds[0]:
            witnesses = cut(witnesses)
    return witnesses


def _ranked(nodes: DataFrame, *order: str) -> DataFrame:
    """`nodes` with their place in their tree; a large tree is spread over many tasks."""
    parts = ordered_parts(nodes.withColumn("_one", F.lit(1).cast("long")), "tree", *order)
    ranked = running_total(parts, ["tree"], [F.col(c) for c in order], "_one", "rank")
    return ranked.drop("_one", "_part")


def leaf_digest(fields: list[Column]) -> Column:
    """Hex SHA-256 of a document's fields, each with its UTF-8 length, a null as a dash."""
    texts = [field.cast("string") for field in fields]
    parts = [
        F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
        for t in texts
    ]
    return F.sha2(F.concat(*parts), 256)


def manifest(
    df: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    key: str = "doc_id",
    group: str = "lang",
    along: dict[str, Column] | None = None,
) -> DataFrame:
    """`(key, leaf, subroot, root, witness)` for every row of `df`, digests as hex text.

    A leaf is the digest of `fields`. Leaves of one `group` value ascend by key, then digest, and
    form a tree of runs of eight; the groups' roots, null first, then bytewise, form the tree
    of the whole. `witness` (binary) holds, from the leaf up, a step for each run on the way to the
    root: the place in the run, the number of siblings, their digests. `along` names further
    columns, made of a document's columns, that go along.

    Nulls in any field are part of the digest; null keys come first, a null group is a tree of its
    own. Rows that repeat a key, or are equal, are leaves like others; equal rows may trade places,
    which changes nothing. Texts of any length are hashed whole. One document is a tree of its leaf
    alone. An empty table gives an empty one. Other columns are not read.
    """
    extra = along or {}
    nodes = df.select(
        # keeps null apart from empty, and before it
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("tree"),
        F.col(key).alias("_key"),
        F.unhex(leaf_digest([F.col(f) for f in fields])).alias("node"),
        *[column.alias(f"_along_{name}") for name, column in extra.items()],
    )
    rounds, subroots = grow(_ranked(nodes, "_key", "node"))
    subroots = cut(subroots)
    trees = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("_of"), "node")
    top_rounds, top = grow(_ranked(trees, "_of"))
    found = top.first()
    root = F.lit(bytearray(found["node"]) if found else None).cast("binary")
    whole = top.select("tree", F.lit(None).cast("binary").alias("above"))
    above = cut(
        attach_witnesses(top_rounds, whole).select(
            F.col("_of").alias("tree"),
            F.col("witness").alias("above"),
            F.col("node").alias("_subroot"),
        )
    )
    return attach_witnesses(rounds, above).select(
        F.col("_key").alias(key),
        F.lower(F.hex("node")).alias("leaf"),
        F.lower(F.hex("_subroot")).alias("subroot"),
        F.lower(F.hex(root)).alias("root"),
        "witness",
        *[F.col(f"_along_{name}").alias(name) for name in extra],
    )


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        leaves, witnesses = batch.column("_claimed"), batch.column("witness")
        proofs, folded = [], []
        for leaf, witness in zip(leaves, witnesses):
            steps = witness.as_py()
            proofs.append(sha256(siblings(steps)).hexdigest())
            folded.append(fold(leaf.as_py(), steps).hex())
        kept = [k for k, name in enumerate(batch.schema.names) if name not in ("_claimed", "witness")]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(k) for k in kept], pa.array(proofs, pa.string())]
            + [pa.array(folded, pa.string())],
            [*[batch.schema.names[k] for k in kept], "proof_sha256", "folded_root"],
        )


def verify(proved: DataFrame, claimed: str) -> DataFrame:
    """`proved` without witness, with `proof_sha256`, `folded_root` and `verified`.

    `claimed` names a column with a leaf (hex); the root that follows from it and the row's witness
    is `folded_root`. `proof_sha256` is the digest of the siblings' hex text.
    """
    columns = [f for f in proved.schema if f.name != "witness"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    return (
        proved.withColumn("_claimed", F.unhex(claimed))
        .mapInArrow(_checked, f"{kinds}, proof_sha256 string, folded_root string")
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )
