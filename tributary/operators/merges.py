"""Review queues and merges over a resolved graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..functions.similarity import best_variant_score
from ..functions.text import variant_keys, with_name_key
from ..session import written
from .components import connected_components


def flow_of(roles: DataFrame) -> DataFrame:
    return roles.select("entity_id", (F.coalesce("total_given", F.lit(0.0)) + F.coalesce("total_received", F.lit(0.0))).alias("flow"))


def near_miss_numbers(entities: DataFrame, roles: DataFrame, least: float = 90.0) -> DataFrame:
    """Pairs of entities whose numbers are one edit apart and whose names score ``least`` or more, biggest combined flow first.

    A hundred neighbours of each number are generated and met by an equi-join; there is no comparison of all pairs."""
    # Keys are made for each entity, not for each pair.
    own = written(entities.where("bn_root is not null").select("entity_id", "bn_root", "canonical_name", variant_keys(F.col("canonical_name")).alias("keys")), "numbered")
    near = own.select("entity_id", "bn_root", "canonical_name", "keys", F.explode(expr.bn_neighbours(F.col("bn_root"))).alias("e")).select(F.col("entity_id").alias("a"), F.col("bn_root").alias("bn_a"), F.col("canonical_name").alias("name_a"), F.col("keys").alias("va"), F.col("e.candidate").alias("bn_b"), F.col("e.edit").alias("edit"))
    pairs = near.join(own.select(F.col("entity_id").alias("b"), F.col("bn_root").alias("bn_b"), F.col("canonical_name").alias("name_b"), F.col("keys").alias("vb")), "bn_b").where("a < b")
    good = best_variant_score(pairs, ["a", "b"], "va", "vb").where(F.col("score") >= least)
    flow = flow_of(roles)
    out = pairs.join(good, ["a", "b"]).join(flow.select(F.col("entity_id").alias("a"), F.col("flow").alias("flow_a")), "a", "left").join(flow.select(F.col("entity_id").alias("b"), F.col("flow").alias("flow_b")), "b", "left")
    both = F.coalesce("flow_a", F.lit(0.0)) + F.coalesce("flow_b", F.lit(0.0))
    return out.select("a", "bn_a", "name_a", "b", "bn_b", "name_b", "edit", "score", both.alias("combined_flow")).orderBy(F.desc("combined_flow"), "a", "b")


def null_province_pairs(entities: DataFrame, min_tokens: int = 3, min_length: int = 15) -> DataFrame:
    """(keep, merge): an organisation without number and province, and its only twin of the same name key that has either; names
    that are both of few words and short are left alone."""
    own = with_name_key(entities.where("entity_kind = 'other_org'"), "canonical_name").where("norm <> ''")
    blank = own.where("bn_root is null and province is null").where((F.size(expr.words(F.col("norm"))) >= min_tokens) | (F.length("canonical_name") >= min_length))
    twins = own.where("bn_root is not null or province is not null").groupBy("norm").agg(F.min("entity_id").alias("keep"), F.count("*").alias("n")).where("n = 1")
    return blank.join(twins, "norm").select("keep", F.col("entity_id").alias("merge"))


def final_targets(pairs: DataFrame) -> DataFrame:
    """(merge, keep) with chains followed: what is merged into something that is itself merged goes to the end of the chain.

    A chain's end is the one member of its connected component that is never merged away (the lowest of them, if several)."""
    edges = pairs.where("keep <> merge").select(F.col("keep").alias("u"), F.col("merge").alias("v"))
    comps = connected_components(edges)
    ends = comps.join(pairs.where("keep <> merge").select(F.col("merge").alias("node")).distinct(), "node", "left_anti").groupBy("comp").agg(F.min("node").alias("keep"))
    return comps.join(ends, "comp").where("node <> keep").select(F.col("node").alias("merge"), "keep")


def remapped(df: DataFrame, targets: DataFrame, *columns: str) -> DataFrame:
    """``df`` with merged ids replaced in these columns."""
    for c in columns:
        t = targets.select(F.col("merge").alias("__from"), F.col("keep").alias("__to"))
        df = df.join(t, F.col(c) == F.col("__from"), "left").withColumn(c, F.coalesce("__to", c)).drop("__from", "__to")
    return df


def apply_merges(entities: DataFrame, links: DataFrame, grants: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Facts and links remapped, merged entities gone."""
    targets = final_targets(pairs)
    gone = targets.select(F.col("merge").alias("entity_id"))
    return entities.join(gone, "entity_id", "left_anti"), remapped(links, targets, "entity_id"), remapped(grants, targets, "funder_entity_id", "recipient_entity_id")


def dollars_moved(grants: DataFrame, pairs: DataFrame, n: int = 20) -> DataFrame:
    """What the merges move, biggest first."""
    t = final_targets(pairs)
    flows = grants.select(F.explode(F.array("funder_entity_id", "recipient_entity_id")).alias("merge"), "amount_cad")
    return flows.join(t, "merge").groupBy("merge", "keep").agg(F.sum("amount_cad").alias("dollars")).orderBy(F.desc("dollars"), "merge").limit(n)


def branch_variants(entities: DataFrame, roles: DataFrame) -> DataFrame:
    """Organisations without a number named "Name – Place", "Name - Place" or "Name (Place)", with each numbered entity of that
    base name; the first pattern that has such a twin counts."""
    name = expr.strip(F.col("canonical_name"))
    shapes = ((r"^(.+)\s+[–-]\s+(.+)$", 0), (r"^(.+)\s+\(([^()]+)\)\s*$", 1))
    tries = None
    for shape, rank in shapes:
        part = entities.where("bn_root is null and entity_kind = 'other_org'").where(name.rlike(shape)).select("entity_id", "canonical_name", F.lit(rank).alias("shape"), expr.strip(F.regexp_extract(name, shape, 1)).alias("base"), expr.strip(F.regexp_extract(name, shape, 2)).alias("place"))
        tries = part if tries is None else tries.unionByName(part)
    tries = with_name_key(tries, "base")
    flow = flow_of(roles)
    known = with_name_key(entities.where("bn_root is not null"), "canonical_name").join(flow, "entity_id", "left").select("norm", F.col("entity_id").alias("bn_entity_id"), F.col("canonical_name").alias("bn_entity_name"), "bn_root", "province", F.coalesce("flow", F.lit(0.0)).alias("bn_entity_flow"))
    hits = tries.join(known, "norm").withColumn("best", F.min("shape").over(Window.partitionBy("entity_id"))).where("shape = best")
    out = hits.join(flow, "entity_id", "left").withColumn("bnless_entity_flow", F.coalesce("flow", F.lit(0.0)))
    return out.select(F.col("entity_id").alias("bnless_entity_id"), F.col("canonical_name").alias("bnless_name"), F.col("place").alias("branch_suffix"), "bn_entity_id", "bn_entity_name", "bn_root", "province", "bn_entity_flow", "bnless_entity_flow").orderBy(
        F.desc(F.col("bn_entity_flow") + F.col("bnless_entity_flow")), "bnless_entity_id", "bn_entity_id"
    )
