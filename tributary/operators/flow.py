"""Flow-through: intermediaries, bounded chains, aggregates and the regranting network.

Inputs
  hop1        bn_root, entity_id, source_dataset, fiscal_year, amount      (what governments gave)
  regrants    bn_root, fiscal_year, amount                                 (gifts to qualified donees, line 5050)
  gifts       bn_root, fiscal_year, donee_bn_root, donee_entity_id, donee_raw_name, donee_raw_bn, amount
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from .dedup import latest_by, ranked, topk_per_group

THRESHOLD, MAX_DEPTH = 100_000.0, 2
CHAIN_COLUMNS = (
    "hop1_source_datasets", "hop1_amount", "hop1_fiscal_year", "intermediary_bn_root", "intermediary_entity_id", "hop_depth", "donee_bn_root", "donee_entity_id", "donee_raw_name",
    "donee_raw_bn", "hop2_amount", "hop2_fiscal_year", "is_cycle",
)


def hop1_yearly(grants: DataFrame, entities: DataFrame, sources: tuple[str, ...]) -> DataFrame:
    own = entities.where("bn_root is not null").select(F.col("entity_id").alias("recipient_entity_id"), "bn_root")
    rows = grants.where(F.col("source_dataset").isin(*sources)).join(own, "recipient_entity_id")
    return rows.groupBy("bn_root", F.col("recipient_entity_id").alias("entity_id"), "source_dataset", "fiscal_year").agg(F.sum("amount_cad").alias("amount"))


def intermediaries(hop1: DataFrame, regrants: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Units that regranted more than the threshold in a year in which they were given money, with that year's sum and sources."""
    given = hop1.groupBy("bn_root", "entity_id", "fiscal_year").agg(F.sum("amount").alias("hop1_amount"), F.concat_ws(",", F.array_sort(F.collect_set("source_dataset"))).alias("hop1_source_datasets"))
    return given.join(large_regranters(regrants, threshold), ["bn_root", "fiscal_year"]).withColumnRenamed("amount", "regranted")


def large_regranters(regrants: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return regrants.where(F.col("amount") > threshold).select("bn_root", "fiscal_year", "amount")


def donee_gifts(schedule: DataFrame, entities: DataFrame) -> DataFrame:
    """Gifts of filings, the latest filing's of each (filer, year, donee), with the donee's entity where its number is known."""
    rows = schedule.withColumn("bn_root", expr.normalize_bn(F.col("BN"))).withColumn("fiscal_year", F.year(F.col("FPE").try_cast("date")))
    last = latest_by(rows, ["bn_root", "fiscal_year", "Donee BN", "Donee Name"], [F.col("source_year").desc_nulls_last(), expr.money(F.col("Total Gifts")).desc_nulls_last()])
    own = entities.where("bn_root is not null").select(F.col("bn_root").alias("donee_bn_root"), F.col("entity_id").alias("donee_entity_id"))
    out = last.withColumn("donee_bn_root", expr.normalize_bn(F.col("Donee BN"))).join(own, "donee_bn_root", "left")
    return out.select("bn_root", "fiscal_year", "donee_bn_root", "donee_entity_id", F.col("Donee Name").alias("donee_raw_name"), F.col("Donee BN").alias("donee_raw_bn"), expr.money(F.col("Total Gifts")).alias("amount"))


def chains(inter: DataFrame, regrants: DataFrame, gifts: DataFrame, entities: DataFrame | None = None, *, threshold: float = THRESHOLD, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Edges of chains of at most ``max_depth`` regrants, with the root's receipts carried along.

    The frontier is a visited set by depth: one root, the lowest (number, year), for each (number, year) reached.  A donee that
    its own chain has passed is flagged and not followed; others go on with every year in which they regrant much.  Levels are
    unrolled joins on (number, year); a frontier is one row for each unit and year, however many roots reach it."""
    years = large_regranters(regrants, threshold).select("bn_root", "fiscal_year")
    root = F.struct(F.col("bn_root").alias("root_bn"), F.col("fiscal_year").alias("hop1_fiscal_year"), "hop1_source_datasets", "hop1_amount")
    frontier = inter.select("bn_root", "fiscal_year", "entity_id", F.array("bn_root").alias("path"), root.alias("root"))
    names = None
    if entities is not None:
        names = entities.where("bn_root is not null").select("bn_root", F.col("entity_id").alias("__id"))
    out = None
    for depth in range(1, max_depth + 1):
        # Deterministic: the lowest root of all that reach this unit and year.
        frontier = frontier.groupBy("bn_root", "fiscal_year").agg(F.min(F.struct("root", "path", "entity_id")).alias("m")).select("bn_root", "fiscal_year", "m.*")
        edges = frontier.join(gifts, ["bn_root", "fiscal_year"])
        cycle = F.coalesce(F.array_contains("path", F.col("donee_bn_root")), F.lit(False))
        edges = edges.withColumns({"is_cycle": cycle, "hop_depth": F.lit(depth)})
        flat = edges.select("root.hop1_source_datasets", "root.hop1_amount", "root.hop1_fiscal_year", F.col("bn_root").alias("intermediary_bn_root"), F.col("entity_id").alias("intermediary_entity_id"), "hop_depth", "donee_bn_root", "donee_entity_id", "donee_raw_name", "donee_raw_bn", F.col("amount").alias("hop2_amount"), F.col("fiscal_year").alias("hop2_fiscal_year"), "is_cycle")
        out = flat if out is None else out.unionByName(flat)
        if depth < max_depth:
            onward = edges.where("not is_cycle and donee_bn_root is not null").select(F.col("donee_bn_root").alias("bn_root"), F.array_append("path", F.col("donee_bn_root")).alias("path"), "root", F.col("donee_entity_id").alias("entity_id"))
            # A unit reached along many edges goes on once for each year: keep the lowest root before years multiply the rows.
            onward = onward.groupBy("bn_root").agg(F.min(F.struct("root", "path", "entity_id")).alias("m")).select("bn_root", "m.*")
            frontier = onward.join(years, "bn_root").select("bn_root", "fiscal_year", "entity_id", "path", "root")
            if names is not None:
                frontier = frontier.join(names, "bn_root", "left").withColumn("entity_id", F.coalesce("entity_id", "__id")).drop("__id")
    return out.select(*CHAIN_COLUMNS)


def totals(edges: DataFrame, inter: DataFrame) -> DataFrame:
    """One row: intermediaries, their receipts, what they regranted, edges and cycles."""
    a = inter.agg(F.countDistinct("bn_root").alias("intermediaries"), F.sum("hop1_amount").alias("hop1_total"))
    b = edges.agg(F.sum(F.when(F.col("hop_depth") == 1, F.col("hop2_amount"))).alias("regranted"), F.count("*").alias("edges"), F.count_if("is_cycle").alias("cycles"))
    return a.crossJoin(F.broadcast(b)).withColumn("share", F.try_divide("regranted", "hop1_total"))


def top_intermediaries(edges: DataFrame, n: int = 20) -> DataFrame:
    return edges.where("hop_depth = 1").groupBy("intermediary_bn_root").agg(F.sum("hop2_amount").alias("regranted"), F.count("*").alias("gifts")).orderBy(F.desc("regranted"), "intermediary_bn_root").limit(n)


def depth_histogram(edges: DataFrame) -> DataFrame:
    return edges.groupBy("hop_depth").agg(F.count("*").alias("edges"), F.sum(F.col("is_cycle").cast("int")).alias("cycles"))


def regranting_network(flows: DataFrame, top: int = 8, edges: int = 4) -> DataFrame:
    """The largest dual-role units with their largest funders and recipients and one "other" on either side; no self-loops.

    ``flows``: funder, recipient, amount.  Result: intermediary, side, partner, amount."""
    pairs = flows.where("funder <> recipient").groupBy("funder", "recipient").agg(F.sum("amount").alias("amount"))
    given = pairs.groupBy(F.col("funder").alias("node")).agg(F.sum("amount").alias("given"))
    received = pairs.groupBy(F.col("recipient").alias("node")).agg(F.sum("amount").alias("received"))
    both = given.join(received, "node").where("given > 0 and received > 0")
    chosen = both.orderBy(F.desc(F.col("given") + F.col("received")), "node").limit(top).select(F.col("node").alias("intermediary"))
    into = pairs.join(F.broadcast(chosen), pairs["recipient"] == F.col("intermediary")).select("intermediary", F.lit("in").alias("side"), F.col("funder").alias("partner"), "amount")
    out = pairs.join(F.broadcast(chosen), pairs["funder"] == F.col("intermediary")).select("intermediary", F.lit("out").alias("side"), F.col("recipient").alias("partner"), "amount")
    rank = ranked(into.unionByName(out), ["intermediary", "side"], [F.col("amount").desc(), F.col("partner").asc()])
    name = F.when(F.col("rn") <= edges, F.col("partner").cast("string")).otherwise("other")
    return rank.groupBy("intermediary", "side", name.alias("partner")).agg(F.sum("amount").alias("amount"))


def sankey_layout(network: DataFrame, height: float, gap: float = 6.0) -> DataFrame:
    """Node boxes by column: top and height in proportion to flow, the largest first; a network is a few dozen nodes."""
    from pyspark.sql import Window

    left = network.where("side = 'in'").groupBy(F.lit(0).alias("col"), F.col("partner").alias("node")).agg(F.sum("amount").alias("total"))
    mid = network.groupBy(F.lit(1).alias("col"), F.col("intermediary").cast("string").alias("node")).agg(F.greatest(F.sum(F.when(F.col("side") == "in", F.col("amount")).otherwise(0)), F.sum(F.when(F.col("side") == "out", F.col("amount")).otherwise(0))).alias("total"))
    right = network.where("side = 'out'").groupBy(F.lit(2).alias("col"), F.col("partner").alias("node")).agg(F.sum("amount").alias("total"))
    nodes = left.unionByName(mid).unionByName(right)
    own = Window.partitionBy("col")
    order = own.orderBy(F.desc("total"), "node")
    room = F.lit(height) - (F.count("*").over(own) - 1) * gap
    scale = room / F.sum("total").over(own)
    before = F.coalesce(F.sum("total").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return nodes.select("col", "node", "total", (before * scale + (F.row_number().over(order) - 1) * gap).alias("top"), (F.col("total") * scale).alias("height"))


def largest_edges(edges: DataFrame, k: int = 3) -> DataFrame:
    return topk_per_group(edges, ["intermediary_bn_root"], [F.col("hop2_amount").desc_nulls_last(), F.col("donee_raw_name").asc_nulls_last()], k)
