"""Blocks of texts with a vocabulary of their own, and a global table of words joined back to them.

Texts are cut into words and the positions of all words are kept; a word is listed once for each
block it occurs in, so the commonest word of a corpus is one entry a block, and positions never
move with words. Listed words are shuffled by a hash of the word, many to a row. There each
distinct word is coded once; codes go back to the blocks and are put in place by position.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..session import checkpoint_dir
from .common import shuffle_tasks, text_slices

# text that shares one vocabulary; a longer text is a block of its own
BLOCK_BYTES = 2**25
# equal words meet in one of so many buckets; a task holds the distinct words of one at a time
BUCKETS = 4096

Batches = Iterator[pa.RecordBatch]
Split = Callable[[bytes], list]
Facts = Callable[[bytes], tuple]
# makes the coder of one bucket, which turns lists of words into packed codes
Coder = Callable[[int], Callable[[list[bytes]], bytes]]


def packed(numbers: np.ndarray) -> bytes:
    """Numbers under 2**32 as bytes: planes of equal significance together, deflated."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zlib.compress(np.ascontiguousarray(planes).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class _Numbers(dict):
    """Words of a block, numbered by first appearance."""

    def __missing__(self, word):
        number = self[word] = len(self)
        return number

    def by_bucket(self, of: int) -> Iterator[tuple[int, list[int], list[bytes]]]:
        """Buckets with the numbers and letters of their words."""
        words = [w.encode() if isinstance(w, str) else w for w in self]
        buckets = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % of
        order = np.argsort(buckets, kind="stable")
        cuts = np.flatnonzero(np.diff(buckets[order], prepend=-1, append=-1))
        order = order.tolist()
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            numbers = order[a:b]
            yield int(buckets[numbers[0]]), numbers, [words[k] for k in numbers]


def _cut_blocks(
    split: Split,
    facts: Facts | None,
    schema: pa.Schema,
    carried: list[str],
    most: int,
    buckets: int,
) -> Callable[[Batches], Batches]:
    document = schema.field("documents").type.value_type

    def row(**values) -> pa.RecordBatch:
        columns = [values.get(f.name, pa.nulls(1, f.type)) for f in schema]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def listed(block: int, numbers: _Numbers) -> Batches:
        rows = list(numbers.by_bucket(buckets))
        columns = {
            "block": [block] * len(rows),
            "bucket": [bucket for bucket, _, _ in rows],
            "at": [packed(np.diff(at, prepend=0)) for _, at, _ in rows],
            "lengths": [packed(np.array([len(w) for w in words])) for _, _, words in rows],
            "letters": [zlib.compress(b"".join(words), 1) for _, _, words in rows],
        }
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns.get(f.name, [None] * len(rows)), f.type) for f in schema],
            schema=schema,
        )

    def run_of_rows(block: int, rows: pa.RecordBatch, texts: list[bytes], numbers: _Numbers):
        places, counts = [], []
        for text in texts:
            words = split(text)
            places.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
            counts.append(len(words))
        columns = [rows.column(c) for c in carried] + [pa.array(counts, pa.int64())]
        if facts is not None:
            of_facts = list(document)[len(columns) :]
            found = zip(*map(facts, texts))
            columns += [pa.array(values, f.type) for values, f in zip(found, of_facts)]
        return row(
            block=pa.array([block], pa.int64()),
            documents=pa.ListArray.from_arrays(
                pa.array([0, len(texts)], pa.int32()),
                pa.StructArray.from_arrays(columns, fields=list(document)),
            ),
            places=pa.array([packed(np.concatenate(places))], pa.binary()),
        )

    def run(batches: Batches) -> Batches:
        block = TaskContext.get().partitionId() << 32
        numbers, held = _Numbers(), 0
        for batch in batches:
            for at, texts in text_slices(batch):
                size = sum(map(len, texts))
                if held and held + size > most:
                    yield from listed(block, numbers)
                    block, numbers, held = block + 1, _Numbers(), 0
                yield run_of_rows(block, batch.slice(at, len(texts)), texts, numbers)
                held += size
            del batch
            pa.default_memory_pool().release_unused()
        yield from listed(block, numbers)

    return run


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    """`df` written in the checkpoint folder in buckets of `key`, as many as shuffles have tasks.

    Rows are not moved: what meets them by `key` is shuffled to the buckets. The table's name is only
    needed to write and open it; the files stay for the folder's retention policy.
    """
    spark = df.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark)}/{name}"
    writer = df.write.format("parquet").bucketBy(shuffle_tasks(spark), key)
    writer.option("path", path).saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved before the name goes
    spark.sql(f"DROP TABLE {name}")
    return table


def word_blocks(
    df: DataFrame,
    split: Split,
    carried: dict[str, pa.DataType],
    facts: Facts | None = None,
    of_facts: dict[str, pa.DataType] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """`(block, documents, places)` of runs of documents, `(block, bucket, ...)` of their words.

    `df` holds `text` as binary and the columns `carried`. `documents` lists structs of these,
    `n` (the words that `split` makes of the text) and `facts` of the text; `places`
    are the numbers of all their words in order. Words are listed with these numbers, those of one
    block and bucket in a row. Written once, since both sides must come from the same cut, and
    bucketed by block, so that documents and positions are never shuffled.
    """
    fields = [*carried.items(), ("n", pa.int64()), *(of_facts or {}).items()]
    schema = pa.schema(
        [
            ("block", pa.int64()),
            ("documents", pa.list_(pa.struct(fields))),
            ("places", pa.binary()),
            ("bucket", pa.int32()),
            ("at", pa.binary()),
            ("lengths", pa.binary()),
            ("letters", pa.binary()),
        ]
    )
    both = _bucketed(
        df.select("text", *carried).mapInArrow(
            _cut_blocks(split, facts, schema, list(carried), BLOCK_BYTES, BUCKETS),
            from_arrow_schema(schema),
        ),
        "block",
    )
    documents = both.filter("bucket is null").select("block", "documents", "places")
    words = both.filter("bucket is not null").select("block", "bucket", "at", "lengths", "letters")
    return documents, words


def _coded(coder: Coder) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        bucket = code = None
        for batch in batches:
            rows = []
            for at in batch.column("bucket").to_pylist():
                k = len(rows)
                if at != bucket:
                    bucket, code = at, coder(at)
                ends = np.cumsum(unpacked(batch.column("lengths")[k].as_py())).tolist()
                letters = zlib.decompress(batch.column("letters")[k].as_py())
                rows.append(code([letters[a:b] for a, b in zip([0, *ends], ends)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("at"), pa.array(rows, pa.binary())],
                ["of", "at", "codes"],
            )
            pa.default_memory_pool().release_unused()

    return run


def code_words(words: DataFrame, coder: Coder) -> DataFrame:
    """`(of, at, codes)` for the words of every block: the global shuffle of distinct words.

    Rows are dealt by bucket, which holds all occurrences of a word, and streamed bucket by
    bucket, so a task keeps what `coder` keeps of one bucket's distinct words.
    """
    return (
        words.repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_coded(coder), "of long, at binary, codes binary")
    )


def put_back(
    documents: DataFrame,
    coded: DataFrame,
    gather: Callable[[list[np.ndarray], list[bytes]], Callable],
    schema: str,
) -> DataFrame:
    """What `gather` makes of every block, a run of documents at a time.

    `gather` gets the numbers and packed codes of a block's words, and returns a function of the
    documents (structs) of a run and the numbers of their words in order, to record batches.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        at = [np.cumsum(unpacked(a.as_py())) for a in right.column("at")]
        assemble = gather(at, [c.as_py() for c in right.column("codes")])
        made = []
        for k in range(left.num_rows):
            rows = left.column("documents").slice(k, 1).combine_chunks().flatten()
            made.append(assemble(rows, unpacked(left.column("places")[k].as_py())))
        return pa.Table.from_batches(made)

    return documents.groupBy("block").cogroup(coded.groupBy("of")).applyInArrow(run, schema)
