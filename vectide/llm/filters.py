"""How quality filters interact: a document-term matrix decides two of them, flags the rest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import cut
from .lexicon import BUCKETS, code_words, put_back, word_blocks

FILTERS = "ABCDE"
# A: under so many words; B: distinct words under, C: capitals over so many percent
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
MARKS = b"#$%&*|"
# a digest that holds more than this share of the rows is joined apart from the others
HOT_SHARE = 1 / 1000
_DOCUMENT = "id {kind}, part string, capitals long, points long, marked boolean, digest binary"


def _facts(text: bytes) -> tuple[int, int, bool, bytes]:
    """Letters A-Z, code points, whether a mark occurs, and the text's digest."""
    data = np.frombuffer(text, np.uint8)
    return (
        int(np.count_nonzero((data >= 65) & (data <= 90))),
        int(np.count_nonzero((data & 0xC0) != 0x80)),
        any(mark in text for mark in MARKS),
        sha256(text).digest(),
    )


class _Dictionary:
    """Coders of buckets: a bucket's distinct words are numbered as they come.

    A number and its bucket make the word's column: bucket + BUCKETS * number, which is unique,
    and close to gapless since buckets are of like size.
    """

    def __call__(self, bucket: int) -> Callable[[list[bytes]], bytes]:
        known: dict[bytes, int] = {}

        def codes(words: list[bytes]) -> bytes:
            numbers = [known.setdefault(word, len(known)) for word in words]
            return (np.array(numbers, "<i8") * BUCKETS + bucket).tobytes()

        return codes


def _gather_shard(at: list[np.ndarray], codes: list[bytes]) -> Callable:
    """One CSR shard for each run: rows in order, columns ascending, counts as values."""
    column = np.zeros(sum(map(len, at)), np.int64)
    for numbers, some in zip(at, codes):
        column[numbers] = np.frombuffer(some, "<i8")

    def assemble(documents: pa.StructArray, places: np.ndarray) -> pa.RecordBatch:
        columns = column[places]
        rows = np.repeat(np.arange(len(documents)), documents.field("n").to_numpy())
        order = np.lexsort((columns, rows))
        rows, columns = rows[order], columns[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (columns[1:] != columns[:-1])
        first = np.flatnonzero(new)
        values = np.diff(first, append=len(rows))
        starts = np.searchsorted(rows[first], np.arange(len(documents) + 1))
        one = pa.array([0, len(first)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(documents)], pa.int32()), documents),
                pa.array([starts.tolist()], pa.list_(pa.int64())),
                pa.ListArray.from_arrays(one, pa.array(columns[first], pa.int64())),
                pa.ListArray.from_arrays(one, pa.array(values, pa.int64())),
            ],
            ["documents", "starts", "columns", "values"],
        )

    return assemble


def term_matrix(
    df: DataFrame,
    carried: dict[str, pa.DataType],
    facts: Callable[[bytes], tuple] | None = None,
    of_facts: dict[str, pa.DataType] | None = None,
) -> DataFrame:
    """`(documents, starts, columns, values)`: CSR shards of the counts of words in documents.

    `df` holds `text` (binary) and the columns `carried`. Words are runs of bytes other
    than ASCII white space, case kept; columns of the matrix are the numbers of a dictionary of
    the whole table. A shard covers a run of documents: `documents` lists its rows (carried
    columns, `n`, facts of the text), row k has the entries `starts[k]` to `starts[k + 1]`.
    A document without words is a row without entries.
    """
    documents, words = word_blocks(df, bytes.split, carried, facts, of_facts)
    kind = documents.schema["documents"].dataType.simpleString()
    return put_back(
        documents,
        code_words(words, _Dictionary()),
        _gather_shard,
        f"documents {kind}, starts array<bigint>, columns array<bigint>, values array<bigint>",
    )


def _row_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row of the shards with the sum and the number of its entries."""
    for batch in batches:
        for k in range(batch.num_rows):
            rows = batch.column("documents").slice(k, 1).flatten()
            starts = batch.column("starts").slice(k, 1).flatten().to_numpy()
            values = batch.column("values").slice(k, 1).flatten().to_numpy()
            totals = np.concatenate([[0], np.cumsum(values)])[starts]
            fields = [f for f in rows.type if f.name != "n"]
            yield pa.RecordBatch.from_arrays(
                [rows.field(f.name) for f in fields]
                + [pa.array(np.diff(totals)), pa.array(np.diff(starts))],
                [*[f.name for f in fields], "words", "kinds"],
            )
        pa.default_memory_pool().release_unused()


def _repeated(rows: DataFrame) -> DataFrame:
    """`rows` with `first`: the smallest id of the same digest, null where no other row has it.

    At most 1 / HOT_SHARE digests can hold more than that share of the rows, so these are
    joined as a table of bounded size; no other digest is a hot key.
    """
    groups = cut(
        rows.groupBy("digest")
        .agg(F.count(F.lit(1)).alias("_copies"), F.min("id").alias("first"))
        .filter("_copies > 1")
    )
    total = rows.count()
    hot = F.col("_copies") > total * HOT_SHARE
    often = groups.filter(hot).select(F.col("digest").alias("_d"), F.col("first").alias("_often"))
    seldom = groups.filter(~hot).select(F.col("digest").alias("_s"), F.col("first").alias("_seldom"))
    marked = rows.join(F.broadcast(often), rows["digest"] == often["_d"], "left")
    # rows of hot digests meet nothing here and are spread by id
    apart = F.when(F.col("_d").isNull(), F.col("digest")).otherwise(
        F.concat(F.lit("id").cast("binary"), F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    )
    return (
        marked.withColumn("_at", apart)
        .join(seldom, F.col("_at") == F.col("_s"), "left")
        .withColumn("first", F.coalesce("_often", "_seldom"))
        .drop("_d", "_often", "_at", "_s", "_seldom")
    )


def failures(df: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """`(id, part, words, kinds, failed)` for every row of `df`; bit k of `failed` is FILTERS[k].

    Row sums and numbers of entries of the document-term matrix decide A and B. A text that
    equals that of a row with a smaller id fails E; a null id is smaller than none and has none
    smaller. Null texts are empty, and equal to empty ones.
    """
    kind = df.schema[key].dataType
    texts = df.select(
        F.col(key).alias("id"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.col(text).cast("string").cast("binary").alias("text"),
    )
    shards = term_matrix(
        texts,
        {"id": to_arrow_type(kind), "part": pa.string()},
        _facts,
        {
            "capitals": pa.int64(),
            "points": pa.int64(),
            "marked": pa.bool_(),
            "digest": pa.binary(),
        },
    )
    rows = cut(
        shards.select("documents", "starts", "values").mapInArrow(
            _row_sums, _DOCUMENT.format(kind=kind.simpleString()) + ", words long, kinds long"
        )
    )
    fails = [
        F.col("words") < LEAST_WORDS,
        100 * F.col("kinds") < LEAST_DISTINCT * F.col("words"),
        100 * F.col("capitals") > MOST_CAPITALS * F.col("points"),
        F.col("marked"),
        F.coalesce(F.col("first") < F.col("id"), F.lit(False)),
    ]
    bits = sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(fails)), F.lit(0))
    return _repeated(rows).select("id", "part", "words", "kinds", bits.alias("failed"))


def _orders() -> Column:
    """All orders of the filters as an array of (order, step, filter, filters before it)."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        name = "".join(FILTERS[k] for k in order)
        before = 0
        for step, k in enumerate(order, 1):
            rows.append(f"('{name}', {step}, {k}, {before})")
            before |= 1 << k
    kind = "array<struct<filter_order:string,step:int,filter:int,before:int>>"
    return F.expr(f"cast(array({', '.join(rows)}) as {kind})")


def audit(
    df: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    part: str = "source",
) -> DataFrame:
    """What each filter removes at each step of each order, for every value of `part`.

    One row for each part (null: empty string), order and step, zeros included: `(part,
    filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)`.
    A document counts by what it fails alone, so rows are first counted in at most 32 cells of
    each part and label, and orders are worked out on these counts.

    Labels that repeat an id count as good or toxic if one of them says so; ids without a label
    and null ids are neither. Rows that repeat an id are documents like others. An empty table
    gives an empty one. Other columns are not read.
    """
    marks = (
        labels.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).alias("_id"))
        .agg(
            F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
            F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
        )
        .filter("good or toxic")
    )
    rows = failures(df, key, text, part).select("id", "part", "failed")
    cells = (
        rows.join(marks, rows["id"] == marks["_id"], "left")
        .groupBy("part", "failed")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if("good").alias("good"),
            F.count_if("toxic").alias("toxic"),
        )
        .groupBy("part")
        .agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("cells"))
    )

    def among(value: str, keep: Callable[[Column], Column]) -> Column:
        return F.aggregate(
            F.filter("cells", lambda c: keep(c["failed"])),
            F.lit(0).cast("long"),
            lambda total, c: total + c[value],
        )

    def has(failed: Column, bits: Column) -> Column:
        return failed.bitwiseAND(bits) != 0

    bit = F.element_at(F.array(*[F.lit(1 << k) for k in range(len(FILTERS))]), F.col("filter") + 1)
    fails_first = lambda f: has(f, F.col("bit")) & ~has(f, F.col("before"))
    others = (1 << len(FILTERS)) - 1
    weights = [factorial(k) * factorial(len(FILTERS) - 1 - k) for k in range(len(FILTERS))]
    # orders that put a set of filters before this one, for every such set
    removed_over_orders = sum(
        (
            F.when(
                F.col("bit").bitwiseAND(F.lit(before)) == 0,
                F.lit(weights[before.bit_count()])
                * among("n", lambda f, b=before: has(f, F.col("bit")) & ~has(f, F.lit(b))),
            ).otherwise(F.lit(0).cast("long"))
            for before in range(others)
        ),
        F.lit(0).cast("long"),
    )
    shares = cut(
        cells.select("part", "cells", F.explode(F.sequence(F.lit(0), F.lit(len(FILTERS) - 1))).alias("filter"))
        .withColumn("bit", bit)
        .select("part", "cells", "filter", "bit", removed_over_orders.alias("shapley"))
    )
    steps = shares.select(
        "part",
        "cells",
        "filter",
        "bit",
        "shapley",
        F.explode(F.filter(_orders(), lambda o: o["filter"] == F.col("filter"))).alias("_step"),
    ).withColumn("before", F.col("_step.before"))
    return steps.select(
        "part",
        F.col("_step.filter_order").alias("filter_order"),
        F.col("_step.step").alias("step"),
        among("n", lambda f: ~has(f, F.col("bit")) & ~has(f, F.col("before"))).alias("kept"),
        among("n", fails_first).alias("removed"),
        among("n", lambda f: has(f, F.col("bit")) & has(f, F.col("before"))).alias("redundant"),
        among("n", lambda f: f == F.col("bit")).alias("unique_fails"),
        among("good", fails_first).alias("good_lost"),
        among("toxic", fails_first).alias("toxic_lost"),
        "shapley",
    )
