"""Ranks and running sums in the order of a hash, without one partition for all rows.

Rows are put in buckets by the leading hex digits of the hash. A bucket's base comes from the totals of the buckets before
it, which are few, and a window runs within a bucket only; together they equal one window over all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIGITS = 3


def hash_ranked(df: DataFrame, by: list[str], order: str, tie: str, amount: str | None = None, digits: int = DIGITS) -> DataFrame:
    """df with rank (from 1) in (order, tie) within by, and with amount also before: the amounts of earlier rows."""
    rows = df.withColumn("_bucket", F.substring(order, 1, digits))
    total = F.sum(amount) if amount else F.lit(None).cast("long")
    sums = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"), total.alias("_s") if amount else F.max(total).alias("_s"))
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(
        *(F.col(c).alias(f"_by_{c}") for c in by),
        F.col("_bucket").alias("_of"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_ranks"),
        F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_sums"),
    )
    on = rows["_bucket"] == bases["_of"]
    for c in by:
        on = on & rows[c].eqNullSafe(bases[f"_by_{c}"])
    inside = Window.partitionBy(*by, "_bucket").orderBy(order, tie)
    out = rows.join(bases, on).withColumn("rank", F.col("_ranks") + F.row_number().over(inside))
    if amount:
        out = out.withColumn(
            "before", F.col("_sums") + F.coalesce(F.sum(amount).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        )
    return out.select(*df.columns, "rank", *(["before"] if amount else []))
