"""Latest versions, full-row duplicates, top-k by group and remainders: windows with a total order, so results are repeatable.

Spark limits each input partition to its first k rows of a group before the shuffle (WindowGroupLimit), so a hot group costs no
more than k rows a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def ranked(df: DataFrame, by: Sequence[str | Column], order: Sequence[Column], out: str = "rn") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def topk_per_group(df: DataFrame, by: Sequence[str | Column], order: Sequence[Column], k: int, keep_rank: str | None = None) -> DataFrame:
    out = ranked(df, by, order, "__rn").where(F.col("__rn") <= k)
    return out.withColumnRenamed("__rn", keep_rank) if keep_rank else out.drop("__rn")


def latest_by(df: DataFrame, by: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in this order (which should be total)."""
    return topk_per_group(df, by, order, 1)


def latest_amendment(df: DataFrame, owner: str, ref: str, amendment: str, ties: Sequence[Column]) -> DataFrame:
    """The row of the highest amendment of each agreement; blank and unreadable amendments count as 0."""
    from ..functions.expr import to_int

    number = F.coalesce(to_int(F.col(amendment).cast("string")), F.lit(0))
    return latest_by(df, [F.trim(owner), F.trim(ref)], [number.desc(), *ties])


def full_row_dedup(df: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of those that are equal in all key columns (nulls are equal): the first in this order."""
    return latest_by(df, key, order)


def keep_flag(df: DataFrame, by: Sequence[str | Column], order: Sequence[Column], out: str = "keep") -> DataFrame:
    return ranked(df, by, order, "__rn").withColumn(out, F.col("__rn") == 1).drop("__rn")


def duplicate_impact(df: DataFrame, by: Sequence[str], order: Sequence[Column], amount: Column) -> DataFrame:
    """Rows and dollars that keeping the first row of each group removes, by group."""
    gone = keep_flag(df, by, order).where(~F.col("keep"))
    return gone.groupBy(*by).agg(F.count("*").alias("rows_removed"), F.sum(amount).alias("dollars_removed"))


def _less(total: DataFrame, part: DataFrame, by: Sequence[str], amount: str, rows: str) -> DataFrame:
    """Sums and counts of groups less those of a part of their rows; groups of which nothing is left go."""
    p = part.groupBy(*by).agg(F.sum(amount).alias("__a"), F.count("*").alias("__n"))
    t = total.groupBy(*by).agg(F.sum(amount).alias("__t"), F.count("*").alias("__c")).join(p, list(by), "left")
    left = t.withColumn(rows, F.col("__c") - F.coalesce("__n", F.lit(0))).where(F.col(rows) > 0)
    return left.select(*by, rows, (F.col("__t") - F.coalesce("__a", F.lit(0))).alias(amount))


def top_and_rest(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, label: str, amount: str, other: str = "other") -> DataFrame:
    """The first n rows of each group and one more that sums the rest: by, rank, label, amount, members.

    Only the first rows are ranked; the rest is the group's aggregate less theirs."""
    top = topk_per_group(df, by, order, n, keep_rank="rank").select(*by, "rank", F.col(label).cast("string").alias(label), amount, F.lit(1).cast("long").alias("members"))
    rest = _less(df, top, by, amount, "members").select(*by, F.lit(n + 1).alias("rank"), F.lit(other).alias(label), amount, "members")
    return top.unionByName(rest)


def shared_budget(df: DataFrame, category: str, categories: Sequence[str], order: Sequence[Column], budget: int, amount: str) -> tuple[DataFrame, DataFrame]:
    """Rows within one budget that categories use up in a fixed order, and by category the number and sum of the remainder.

    Numbers of rows by category are few, so the budget's split is found from one small aggregate; no more than the budget is ranked."""
    counts = {r[0]: r[1] for r in df.groupBy(category).count().collect()}  # as many rows as there are categories
    left, share = budget, {}
    for c in categories:
        share[c] = min(left, counts.get(c, 0))
        left -= share[c]
    limit = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in share.items() for x in kv]), F.col(category)), F.lit(0)) if share else F.lit(0)
    shown = topk_per_group(df, [category], order, max([1, *share.values()]), keep_rank="__rn").where(F.col("__rn") <= limit).drop("__rn")
    return shown, _less(df, shown, [category], amount, "rows")


def positional_percentile(df: DataFrame, value: str, percents: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """The value at place floor(n * p / 100) of the sorted values (from 0), for each p: no interpolation.

    Equal values are counted before they are ordered, so what is sorted is the distinct values; those of a single group are sorted in
    ranges, each of which begins where the sums of the ranges before it end."""
    tally = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("__n"))
    if by:
        upto = tally.withColumn("__upto", F.sum("__n").over(Window.partitionBy(*by).orderBy(value))).withColumn("__all", F.sum("__n").over(Window.partitionBy(*by)))
    else:
        local = written(tally.repartitionByRange(F.col(value)).withColumn("__p", F.spark_partition_id()), "tally")
        sums = local.groupBy("__p").agg(F.min(value).alias("v"), F.sum("__n").alias("n")).orderBy("v").collect()  # a row for each range
        bases, total = [], 0
        for r in sums:
            bases.append((r["__p"], total))
            total += r["n"]
        base = df.sparkSession.createDataFrame(bases, "__p int, __base long")
        upto = local.join(F.broadcast(base), "__p").withColumn("__upto", F.col("__base") + F.sum("__n").over(Window.partitionBy("__p").orderBy(value))).withColumn("__all", F.lit(total).cast("long"))
    probe = upto.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    place = F.least(F.floor(F.col("__all") * F.col("percent") / 100), F.col("__all") - 1)
    return probe.where((F.col("__upto") - F.col("__n") <= place) & (place < F.col("__upto"))).select(*by, "percent", F.col(value).alias("value"))
