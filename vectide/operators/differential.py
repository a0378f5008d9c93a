"""Differential abundance: log-ratios, per-feature linear models, FDR."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import sorted_slices
from ..functions.stats import t_pvalue


def _logged(counts: DataFrame, feature: str) -> DataFrame:
    value = F.col("value").cast("double")
    return counts.select(
        "sample_id", F.col(feature).alias("feature"), F.log2(value + 1.0).alias("l")
    )


def clr_baseline(
    counts: DataFrame, feature: str = "protein_id", samples: DataFrame | None = None
) -> DataFrame:
    """`(sample_id, baseline)`: the log-ratio of an absent cell, minus the row mean.

    The mean runs over every feature of the table; absent cells add log2(1) = 0.
    """
    logged = _logged(counts, feature)
    sums = logged.groupBy("sample_id").agg(F.sum("l").alias("total"))
    if samples is not None:
        sums = samples.select("sample_id").join(sums, "sample_id", "left")
    features = logged.agg(F.countDistinct("feature").alias("features"))
    mean = F.coalesce("total", F.lit(0.0)) / features.scalar()
    return sums.select("sample_id", (F.lit(0.0) - mean).alias("baseline"))


def clr(
    counts: DataFrame, feature: str = "protein_id", samples: DataFrame | None = None
) -> DataFrame:
    """`(sample_id, feature, clr)` of present cells; the rest is `clr_baseline`.

    log2(x + 1) minus its mean over all features. Every absent cell of a sample
    has the same value, so the dense table is never built.
    """
    base = clr_baseline(counts, feature, samples)
    return (
        _logged(counts, feature)
        .filter(F.col("l") > 0)
        .join(base, "sample_id")
        .select("sample_id", "feature", (F.col("l") + F.col("baseline")).alias("clr"))
    )


def ols_by_group(
    counts: DataFrame,
    groups: DataFrame,
    treated: str,
    reference: str,
    feature: str = "protein_id",
) -> DataFrame:
    """Linear model of each feature's log-ratio on a two-level group.

    `groups` is `(sample_id, group)`; samples of other groups are left out.
    Returns `(feature, lfc, t, df, p)`. Sums over absent cells come from the
    sample baselines, so only present cells are read and shuffled.
    """
    two = groups.filter(F.col("group").isin(treated, reference)).select(
        "sample_id", (F.col("group") == treated).alias("hit")
    )
    base = clr_baseline(counts, feature, two).join(two, "sample_id")
    side = lambda hit, c: F.sum(F.when(F.col("hit") == hit, c).otherwise(0.0))
    b = F.col("baseline")
    one = F.lit(1.0)
    design = base.agg(
        F.struct(
            *[
                side(hit, expression).alias(f"{name}{int(hit)}")
                for hit in (False, True)
                for name, expression in (("n", one), ("b", b), ("bb", b * b))
            ]
        ).alias("design")
    )
    logged = _logged(counts, feature)
    cells = logged.filter(F.col("l") > 0).join(base, "sample_id")
    gain = F.col("l") * F.col("l") + F.lit(2.0) * F.col("l") * b
    present = cells.groupBy("feature").agg(
        *[
            side(hit, expression).alias(f"{name}{int(hit)}")
            for hit in (False, True)
            for name, expression in (("s", F.col("l")), ("q", gain))
        ]
    )
    # features whose cells are all zero still have a row
    every = logged.select("feature").distinct()
    names = ["s0", "q0", "s1", "q1"]
    table = every.join(present, "feature", "left").select(
        "feature",
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names],
        design.scalar().alias("design"),
    )
    table = table.select("feature", *names, "design.*")
    for k in (0, 1):
        table = table.withColumn(
            f"mean{k}", (F.col(f"s{k}") + F.col(f"b{k}")) / F.col(f"n{k}")
        ).withColumn(
            f"rss{k}",
            F.greatest(
                F.col(f"q{k}")
                + F.col(f"bb{k}")
                - F.col(f"n{k}") * F.col(f"mean{k}") * F.col(f"mean{k}"),
                F.lit(0.0),
            ),
        )
    df = F.col("n0") + F.col("n1") - 2.0
    error = F.sqrt(
        (F.col("rss0") + F.col("rss1")) / df * (1.0 / F.col("n0") + 1.0 / F.col("n1"))
    )
    lfc = F.col("mean1") - F.col("mean0")
    return table.select(
        "feature",
        lfc.alias("lfc"),
        F.try_divide(lfc, error).alias("t"),
        df.alias("df"),
    ).withColumn("p", t_pvalue("t", "df"))


def bh_adjust(df: DataFrame, p: str = "p", key: str = "feature") -> DataFrame:
    """Adds `q`: Benjamini-Hochberg adjusted `p`; missing p stays missing.

    Rows are range-partitioned by p, with the key as tie-break so equal values
    split; the running minimum needs one row per slice from its successors.
    """
    tests = df.filter(F.col(p).isNotNull() & ~F.isnan(p))
    sliced = sorted_slices(tests, F.asc(p), F.asc(key))
    sizes = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_rows"))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # one row per slice
    offsets = sizes.select(
        "_slice",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_rows").over(Window.partitionBy()).alias("_all"),
    )
    scaled = sliced.join(F.broadcast(offsets), "_slice").withColumn(
        "_v",
        F.col(p) * F.col("_all") / (F.col("_before") + F.col("_at") + 1),
    )
    lows = scaled.groupBy("_slice").agg(F.min("_v").alias("_low"))
    later = Window.orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    after = lows.select("_slice", F.min("_low").over(later).alias("_after"))
    inside = Window.partitionBy("_slice").orderBy(F.desc("_at"))
    adjusted = scaled.join(F.broadcast(after), "_slice").withColumn(
        "q",
        F.least(
            F.min("_v").over(inside), F.coalesce("_after", F.lit(1.0)), F.lit(1.0)
        ),
    )
    out = adjusted.select(*[F.col(f"`{c}`") for c in df.columns], "q")
    untested = df.filter(F.col(p).isNull() | F.isnan(p))
    return out.unionByName(untested.withColumn("q", F.lit(None).cast("double")))
