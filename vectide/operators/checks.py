"""Fail-loud validation: every entry point rejects bad input before computing."""

from __future__ import annotations

import math
import numbers

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The residue letters a sequence may hold.
RESIDUES = "ACDEFGHIKLMNPQRSTVWYBXZUO"


class InvalidInput(ValueError):
    """Input that the operators refuse to guess about."""


def finite_number(value) -> bool:
    return (
        isinstance(value, numbers.Real)
        and not isinstance(value, bool)
        and math.isfinite(value)
    )


def whole_number(value, low: int = 0) -> bool:
    return finite_number(value) and value == math.floor(value) and value >= low


def flag(value, name: str) -> None:
    if not isinstance(value, bool):
        raise InvalidInput(f"`{name}` must be True or False.")


def check_max_evalue(value) -> None:
    number = isinstance(value, numbers.Real) and not isinstance(value, bool)
    if not number or math.isnan(value) or value <= 0:
        raise InvalidInput("`max_evalue` must be one positive number.")


def check_sigma(value) -> None:
    if not finite_number(value) or value <= 0:
        raise InvalidInput("`sigma` must be a single finite, positive number.")


def check_inflation(value) -> None:
    if not finite_number(value) or value <= 1:
        raise InvalidInput("`inflation` must be a single finite number above 1.")


def is_blank(name: Column) -> Column:
    return name.isNull() | (F.btrim(name.cast("string"), F.lit(" \t\r\n")) == "")


def bad_ids(df: DataFrame, column: str) -> DataFrame:
    """Names that are missing, blank or repeated."""
    return (
        df.groupBy(F.col(column).alias("id"))
        .agg(F.count(F.lit(1)).alias("times"))
        .filter(is_blank(F.col("id")) | (F.col("times") > 1))
    )


def check_ids(df: DataFrame, column: str, what: str) -> None:
    if bad_ids(df, column).limit(1).count():
        raise InvalidInput(f"{what} names must be unique, non-missing and non-empty.")


def check_names_present(df: DataFrame, column: str, what: str) -> None:
    if df.filter(is_blank(F.col(column))).limit(1).count():
        raise InvalidInput(f"{what} names must be unique, non-missing and non-empty.")


def clean_sequence(sequence: Column) -> Column:
    """Upper case, with one terminal stop removed."""
    return F.upper(F.regexp_replace(sequence, r"\*\z", ""))


def aligner_residues(sequence: Column) -> Column:
    """Residues as the aligner reads them: those without a row of their own are unknown."""
    return F.translate(sequence, "UO", "XX")


def model_residues(sequence: Column) -> Column:
    """Residues as embedding models read them: rare and ambiguous ones are unknown."""
    return F.regexp_replace(sequence, "[UZOB]", "X")


def check_sequences(seqs: DataFrame) -> DataFrame:
    """Validate `(protein_id, sequence)` rows in order; returns them cleaned."""
    if "protein_id" not in seqs.columns:
        raise InvalidInput(
            "`seqs` names must be unique, non-missing and non-empty."
        )
    cleaned = seqs.withColumn("sequence", clean_sequence(F.col("sequence")))
    first = lambda test: F.min(F.when(test, F.col("protein_id").cast("string")))
    seen = cleaned.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(is_blank(F.col("protein_id"))).alias("blank"),
        F.count_if(F.col("sequence").isNull()).alias("missing"),
        first(F.col("sequence") == "").alias("empty"),
        first(F.col("sequence").rlike(f"[^{RESIDUES}]")).alias("symbols"),
    ).first()
    if not seen["rows"]:
        raise InvalidInput("`seqs` must contain at least one sequence.")
    if seen["blank"]:
        raise InvalidInput("`seqs` names must be unique, non-missing and non-empty.")
    check_ids(cleaned, "protein_id", "`seqs`")
    if seen["missing"]:
        raise InvalidInput("`seqs` must not contain missing values.")
    if seen["empty"] is not None:
        raise InvalidInput(f"`seqs` contains empty sequence(s): {seen['empty']}")
    if seen["symbols"] is not None:
        raise InvalidInput(f"model-incompatible symbol(s): {seen['symbols']}")
    return cleaned


def check_vectors(vectors: DataFrame) -> None:
    """`protein_id` unique, and one embedding of one length per protein."""
    if "embedding" not in vectors.columns or "protein_id" not in vectors.columns:
        raise InvalidInput(
            "`x` must have a `protein_id` and an `embedding` column, as returned "
            "by embed_proteins()."
        )
    size = F.size("embedding")
    names = vectors.groupBy("protein_id").agg(
        F.count(F.lit(1)).alias("times"),
        F.min(size).alias("low"),
        F.max(size).alias("high"),
        F.count_if(F.col("embedding").isNull()).alias("missing"),
    )
    seen = names.agg(
        F.count_if(is_blank(F.col("protein_id")) | (F.col("times") > 1)).alias("bad"),
        F.sum("missing").alias("missing"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    ).first()
    if seen["bad"]:
        raise InvalidInput("Protein names must be unique, non-missing and non-empty.")
    if seen["missing"] or seen["low"] != seen["high"] or (seen["low"] or 1) < 1:
        raise InvalidInput("`x` must have one `embedding` of one length per protein.")


def is_bad_cell() -> Column:
    value = F.col("value").cast("double")
    return (
        value.isNull()
        | F.isnan(value)
        | (F.abs(value) == float("inf"))
        | (value < 0)
        | is_blank(F.col("sample_id"))
        | is_blank(F.col("protein_id"))
    )


def bad_counts(counts: DataFrame) -> DataFrame:
    return counts.filter(is_bad_cell())


def missing_vectors(counts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Counted proteins without a vector, even where every count is zero."""
    counted = counts.select("protein_id").distinct()
    return counted.join(vectors.select("protein_id"), "protein_id", "left_anti")


def empty_samples(counts: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Samples whose total is zero; `samples` brings in those without any row."""
    totals = counts.groupBy("sample_id").agg(F.sum("value").alias("total"))
    if samples is not None:
        totals = samples.select("sample_id").join(totals, "sample_id", "left")
    return totals.filter(F.coalesce(F.col("total"), F.lit(0.0)) == 0).select(
        "sample_id"
    )


def count_cells(counts: DataFrame) -> DataFrame:
    """One row per (sample, protein) cell, with what the checks need to know.

    The only pass over the raw counts: partial aggregation keeps it one row per
    cell and task, and everything later reads this table.
    """
    return counts.groupBy("sample_id", "protein_id").agg(
        F.sum(F.col("value").cast("double")).alias("value"),
        F.count(F.lit(1)).alias("times"),
        F.count_if(is_bad_cell()).alias("bad"),
    )


def check_counts(
    cells: DataFrame, vectors: DataFrame | None, samples: DataFrame | None = None
) -> None:
    """Validate the table `count_cells` made: one pass per side."""
    per_sample = cells.groupBy("sample_id").agg(
        F.sum("value").alias("total"),
        F.max("times").alias("times"),
        F.sum("bad").alias("bad"),
    )
    if samples is None:
        listed = per_sample.withColumn("listed", F.lit(1))
    else:
        roster = samples.groupBy("sample_id").agg(F.count(F.lit(1)).alias("listed"))
        listed = per_sample.join(roster, "sample_id", "full")
    name = F.col("sample_id").cast("string")
    example = lambda test: F.min(F.when(test, name))
    seen = listed.agg(
        F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"),
        F.coalesce(F.max("times"), F.lit(0)).alias("times"),
        F.count_if((F.col("listed") > 1) | is_blank(name)).alias("names"),
        example(F.col("listed").isNull()).alias("stray"),
        F.count_if(F.coalesce("total", F.lit(0.0)) == 0).alias("empty"),
    ).first()
    if seen["bad"]:
        raise InvalidInput(
            "`counts` must hold finite numbers >= 0; sample and protein names "
            "must be unique, non-missing and non-empty."
        )
    if seen["times"] > 1:
        raise InvalidInput("Sample and protein names must be unique in `counts`.")
    if seen["names"]:
        raise InvalidInput("Sample names must be unique, non-missing and non-empty.")
    if seen["stray"] is not None:
        raise InvalidInput(f"`samples` does not list sample {seen['stray']}.")
    if vectors is not None:
        lost = (
            missing_vectors(cells, vectors)
            .agg(F.count(F.lit(1)).alias("n"), F.min("protein_id").alias("example"))
            .first()
        )
        if lost["n"]:
            raise InvalidInput(
                f"{lost['n']} protein(s) in `counts` have no embedding in `x`, e.g. "
                f"{lost['example']}. `counts` needs one row per sample and protein."
            )
    if seen["empty"]:
        found = empty_samples(cells, samples).orderBy("sample_id").limit(5).collect()
        names = ", ".join(str(r["sample_id"]) for r in found)
        more = ", ..." if seen["empty"] > len(found) else ""
        raise InvalidInput(f"Sample(s) with no counts: {names}{more}.")
