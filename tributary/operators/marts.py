"""Summaries over the graph: roles, financials, category flags, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from .dedup import latest_by


def two_sided(grants: DataFrame) -> DataFrame:
    """Each grant once for its funder and once for its recipient, in one pass over the table."""
    sides = F.array(F.struct(F.col("funder_entity_id").alias("entity_id"), F.lit("given").alias("side")), F.struct(F.col("recipient_entity_id").alias("entity_id"), F.lit("received").alias("side")))
    return grants.select("*", F.explode(sides).alias("__s")).select("*", "__s.entity_id", "__s.side").drop("__s")


def role_summary(entities: DataFrame, grants: DataFrame, high: float = 0.9, low: float = 0.1) -> DataFrame:
    both = two_sided(grants)
    given, received = F.col("side") == "given", F.col("side") == "received"
    sums = both.groupBy("entity_id").agg(
        F.sum(F.when(given, F.col("amount_cad"))).alias("g"), F.sum(F.when(received, F.col("amount_cad"))).alias("r"), F.count_if(given).alias("ng"), F.count_if(received).alias("nr")
    )
    out = entities.select("entity_id", "canonical_name", "entity_kind").join(sums, "entity_id", "left")
    zero = lambda c, kind: F.coalesce(F.col(c), F.lit(0).cast(kind))
    out = out.select("entity_id", "canonical_name", "entity_kind", zero("g", "double").alias("total_given"), zero("r", "double").alias("total_received"), zero("ng", "long").alias("n_grants_given"), zero("nr", "long").alias("n_grants_received"))
    share = F.try_divide(F.col("total_given"), F.col("total_given") + F.col("total_received"))
    out = out.withColumn("given_share", share)
    role = F.when(F.col("total_given") + F.col("total_received") == 0, "no_flows").when(F.col("given_share") >= high, "primarily_funder").when(F.col("given_share") <= low, "primarily_recipient").otherwise("dual_role")
    return out.withColumn("role", role)


def backfilled_number(entities: DataFrame, idents: DataFrame) -> DataFrame:
    """entities with bn_full, the full number of the latest registry row of each root."""
    rows = idents.withColumn("bn_root", expr.normalize_bn(F.col("bn"))).where("bn_root is not null")
    last = latest_by(rows, ["bn_root"], [F.col("source_year").desc_nulls_last(), F.col("bn").asc()]).select("bn_root", F.trim("bn").alias("bn_full"))
    return entities.join(last, "bn_root", "left")


def with_search_name(entities: DataFrame) -> DataFrame:
    return entities.withColumn("search_name", expr.fold(F.col("canonical_name")))


#: Line codes of the yearly filing and what they are.
FINANCIAL_LINES = {"4700": "total_revenue", "4950": "total_expenditures", "5100": "total_expenditures_incl_disbursements", "5050": "total_gifts_to_qualified_donees", "4540": "revenue_from_federal_gov", "4570": "revenue_from_any_cdn_gov", "4510": "revenue_from_foundations", "4500": "donations"}


def latest_financials(entities: DataFrame, filings: DataFrame, yearly: bool = False) -> DataFrame:
    """The latest filing of each number, or with ``yearly`` of each number and year of its period's end; amounts by entity."""
    day = F.col("FPE").try_cast("date")
    rows = filings.withColumn("bn_root", expr.normalize_bn(F.col("BN"))).where("bn_root is not null").withColumn("fiscal_period_end", day).withColumn("fiscal_year", F.year(day))
    by = ["bn_root", "fiscal_year"] if yearly else ["bn_root"]
    if yearly:
        rows = rows.where("fiscal_year is not null")
    last = latest_by(rows, by, [F.col("source_year").desc_nulls_last(), F.col("fiscal_period_end").desc_nulls_last(), F.col("BN").asc()])
    amounts = [expr.money(F.col(f"`{line}`")).alias(name) for line, name in FINANCIAL_LINES.items() if line in filings.columns]
    own = entities.where("bn_root is not null").select("entity_id", "bn_root")
    return own.join(last, "bn_root").select("entity_id", "bn_root", "fiscal_period_end", "fiscal_year", *amounts)


def category_flags(grants: DataFrame, sources: dict[str, str]) -> DataFrame:
    """One boolean column for each (name, source) of ``sources``: whether the entity has a grant from there on either side."""
    return two_sided(grants).groupBy("entity_id").agg(*[F.bool_or(F.col("source_dataset") == s).alias(n) for n, s in sources.items()])


def method_by_source(links: DataFrame) -> DataFrame:
    return links.groupBy("source_dataset", "match_method").agg(F.count("*").alias("n")).orderBy("source_dataset", F.desc("n"))


def top_dual_role(roles: DataFrame, n: int = 20) -> DataFrame:
    return roles.where("role = 'dual_role'").orderBy(F.desc(F.col("total_given") + F.col("total_received")), "entity_id").limit(n)


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """A repeatable sample of n rows, by hash of their key."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)
