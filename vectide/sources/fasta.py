"""FASTA text as a table of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.checks import RESIDUES, InvalidInput, check_sequences
from .lines import in_file_order, read_text


def fasta_records(spark: SparkSession, path: str) -> DataFrame:
    """`(ord, protein_id, sequence, headed, file)`: one row per record, unvalidated.

    `path` names a file, a folder or a pattern. Records are split by the reader itself, so a
    large file is read in parallel and lines of one record are joined inside its row. `ord`
    follows the order of files and of records in them; `headed` is false where a file starts
    with text instead of a header.
    """
    text = in_file_order(read_text(spark, path, "FASTA file", lineSep="\n>"))
    body = F.regexp_replace("value", r"\A>|[\r\n]+\z", "")
    lines = F.split(body, r"\r?\n")
    return text.select(
        "ord",
        F.regexp_replace(F.element_at(lines, 1), r"(?s)\s.*", "").alias("protein_id"),
        F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "").alias("sequence"),
        (~F.col("opens") | F.col("value").startswith(">")).alias("headed"),
        "file",
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Validated `(ord, protein_id, sequence)` of FASTA text, which may lie in several files.

    Sequences are upper-cased and lose a terminal stop. Missing files, text
    before a file's first header, stray symbols, empty records and repeated or blank
    names are errors.
    """
    if not isinstance(path, str):
        raise InvalidInput(f"FASTA file not found: {path}")
    records = fasta_records(spark, path)
    if records.isEmpty():
        raise InvalidInput(f"FASTA file not found or empty: {path}")
    bare = records.filter(~F.col("headed")).select("file").first()
    if bare is not None:
        raise InvalidInput(f'expected ">" at the start of {bare["file"]}')
    letters = f"[^{RESIDUES.lower()}{RESIDUES}jJ*.+-]"
    odd = records.filter(F.col("sequence").rlike(letters)).limit(1).collect()
    if odd:
        raise InvalidInput(
            f"invalid one-letter sequence codes in record {odd[0]['protein_id']}"
        )
    return check_sequences(records.select("ord", "protein_id", "sequence"))


def write_fasta(proteins: DataFrame, path: str, width: int = 80) -> None:
    """Write `(ord, protein_id, sequence)` in `ord` order, wrapped at `width`."""
    wrapped = F.rtrim(
        F.regexp_replace("sequence", f"(.{{{width}}})", "$1\n"), F.lit("\n")
    )
    (
        proteins.repartitionByRange("ord")
        .sortWithinPartitions("ord")
        .select(F.concat(F.lit(">"), F.col("protein_id"), F.lit("\n"), wrapped))
        .write.text(path)
    )
