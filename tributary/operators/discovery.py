"""Discovery: registry records against charities and grant recipients; blocking cascade, best match, three buckets, reconciliation.

Records      source_id, legal_name, trade_names (array), city, postal, bn
Candidates   cand_id, cand_name, cand_city, cand_postal, cand_bn, ord (candidate order)
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..functions.similarity import ratio_table, token_sorted
from ..session import ship, written
from .dedup import topk_per_group

AUTO, FLOOR = 90.0, 75.0
NO_KEY = "__no_blocking_key__"
#: Lists of names on either side of a block of pairs that one task scores.
SIDE = 2048
_BLOCK = ["block_level", "block_value"]
#: What shows that a programme is social.
SOCIAL_KEYWORDS = ("homelessness", "housing", "social development", "youth", "settlement", "immigrant", "refugee", "community", "poverty", "family violence", "employment insurance", "social innovation", "accessibility", "seniors")


def _levels(postal: Column, city: Column, name: Column, by_prefix: bool) -> list[tuple[str, Column]]:
    p = expr.normalize_postal(postal)
    out = [("postal", p), ("fsa", expr.fsa(p)), ("city", expr.blank_to_null(expr.fold(city)))]
    return [*out, ("name_prefix", expr.blank_to_null(expr.name_prefix(expr.normalize_org_name(name))))] if by_prefix else out


def block_level(records: DataFrame, candidates: DataFrame, by_prefix: bool = False) -> DataFrame:
    """records with block_level and block_value: the first of postal code, its first three characters, city (and, if wanted, name
    prefix) that any candidate shares; NO_KEY if there is none.

    What candidates have is one small set of distinct (level, value), met by an equi-join for all levels at once."""
    cand = _levels(F.col("cand_postal"), F.col("cand_city"), F.col("cand_name"), by_prefix)
    have = candidates.select(F.explode(F.array(*[F.struct(F.lit(n).alias("level"), v.alias("value")) for n, v in cand])).alias("k")).select("k.*").where("value is not null").distinct()
    own = _levels(F.col("postal"), F.col("city"), F.col("legal_name"), by_prefix)
    keys = records.select("source_id", F.posexplode(F.array(*[F.struct(F.lit(n).alias("level"), v.alias("value")) for n, v in own])).alias("rank", "k")).select("source_id", "rank", "k.*").where("value is not null")
    first = keys.join(have, ["level", "value"], "left_semi").groupBy("source_id").agg(F.min(F.struct("rank", "level", "value")).alias("b"))
    out = records.join(first, "source_id", "left")
    return out.select(*records.columns, F.coalesce("b.level", F.lit(NO_KEY)).alias("block_level"), F.col("b.value").alias("block_value"))


def _scoring_keys(name: Column, trade: Column | None = None) -> Column:
    every = expr.name_variants(name) if trade is None else F.concat(expr.name_variants(name), F.flatten(F.transform(F.coalesce(trade, F.array().cast("array<string>")), expr.name_variants)))
    return F.array_distinct(F.filter(F.transform(every, expr.normalize_for_scoring), lambda k: k != ""))


def _sorted_keys(name: Column, trade: Column | None = None) -> Column:
    return F.array_sort(F.array_distinct(F.transform(_scoring_keys(name, trade), token_sorted)))


def _two_best(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """names, cand_id, ord, cand_name, score by block: the two best candidates of each of the records' lists of names, and perhaps
    further ones.  Both have the columns of ``_BLOCK`` and names.

    Pairs are scored where they meet, in blocks of about ``SIDE`` x ``SIDE`` lists of names, and are never written; a block gives two rows
    a list.  Equal lists are scored once; of candidates with equal lists only the first two can be among the two best."""
    ship(records.sparkSession)
    left = records.select(*_BLOCK, "names").distinct()
    right = topk_per_group(candidates, [*_BLOCK, "names"], [F.asc("ord"), F.asc("cand_id")], 2)
    blocks = lambda name: F.ceil(F.count("*") / SIDE).cast("int").alias(name)
    stats = written(left.groupBy(*_BLOCK).agg(blocks("rows")).join(right.groupBy(*_BLOCK).agg(blocks("cols")), _BLOCK), "blocks")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("names"), F.col(n)).cast("int")
    place = lambda df, row, col: df.join(stats, _BLOCK).select("*", row.alias("row")).select("*", col.alias("col")).drop("rows", "cols")
    every = place(left, own("rows"), spread("cols")).unionByName(place(right.withColumn("cand", F.lit(True)), spread("rows"), own("cols")), allowMissingColumns=True)
    out = every.select(*_BLOCK, "names", "cand_id", "ord", "cand_name", F.lit(0.0).alias("score"))

    def block(t: pa.Table) -> pa.Table:
        is_cand = pc.is_valid(t["cand"])
        lists, cands = t.filter(pc.invert(is_cand)), t.filter(is_cand)
        cands = cands.take(pc.sort_indices(cands, [("ord", "ascending"), ("cand_id", "ascending")], null_placement="at_start"))
        mine, theirs = lists["names"].to_pylist(), cands["names"].to_pylist()
        if not mine or not theirs:
            return t.slice(0, 0).select(_BLOCK + ["names", "cand_id", "ord", "cand_name"]).append_column("score", pa.array([], pa.float64()))
        words = sorted({x for y in theirs for x in y})
        number = {x: i for i, x in enumerate(words)}
        which = np.array([number[x] for y in theirs for x in y])
        starts = np.cumsum([0, *map(len, theirs[:-1])])
        best = np.empty((2, len(mine)), np.int64)
        score = np.empty((2, len(mine)))
        for i in range(0, len(mine), SIDE):
            part = mine[i : i + SIDE]
            table = ratio_table([x for y in part for x in y], words)[:, which]
            # The best of a list's names with any of a candidate's; argmax takes the first of equals.
            table = np.maximum.reduceat(np.maximum.reduceat(table, starts, 1), np.cumsum([0, *map(len, part[:-1])]), 0)
            for k in range(2):
                best[k, i : i + SIDE] = at = table.argmax(1)
                score[k, i : i + SIDE] = table[np.arange(len(part)), at]
                table[np.arange(len(part)), at] = -1.0
        record, kept = np.tile(np.arange(len(mine)), 2), score.ravel() >= 0.0
        a, b = lists.take(pa.array(record[kept])), cands.take(pa.array(best.ravel()[kept]))
        return pa.table({n: (a if n in (*_BLOCK, "names") else b)[n] for n in (*_BLOCK, "names", "cand_id", "ord", "cand_name")} | {"score": pa.array(score.ravel()[kept])})

    return every.groupBy(*_BLOCK, "row", "col").applyInArrow(block, out.schema)


def best_match(blocked: DataFrame, candidates: DataFrame, by_prefix: bool = False) -> DataFrame:
    """blocked records with best_id, best_name, best_score, runner_up_score of the candidates in their block; on ties the first
    candidate in order."""
    cand = _levels(F.col("cand_postal"), F.col("cand_city"), F.col("cand_name"), by_prefix)
    # Keys are made for each record and each candidate, not for each pair.
    wide = written(candidates.select("cand_id", "ord", "cand_name", _sorted_keys(F.col("cand_name")).alias("names"), F.array(*[F.struct(F.lit(n).alias("block_level"), v.alias("block_value")) for n, v in cand]).alias("__k")).where(F.size("names") > 0), "candidate-keys")
    wide = wide.select("cand_id", "ord", "cand_name", "names", F.explode("__k").alias("k")).select("k.*", "names", "cand_id", "ord", "cand_name").where("block_value is not null").distinct()
    keyed = written(blocked.where(F.col("block_level") != NO_KEY).select("source_id", "block_level", "block_value", _sorted_keys(F.col("legal_name"), F.col("trade_names")).alias("names")).where(F.size("names") > 0), "record-keys")
    scores = keyed.join(_two_best(keyed, wide), [*_BLOCK, "names"]).groupBy("source_id", "cand_id", "ord", "cand_name").agg(F.max("score").alias("score"))
    top = topk_per_group(scores, ["source_id"], [F.col("score").desc(), F.col("ord").asc()], 2, keep_rank="k")
    two = top.groupBy("source_id").agg(*[F.max(F.when(F.col("k") == 1, F.col(c))).alias(n) for c, n in (("cand_id", "best_id"), ("cand_name", "best_name"), ("score", "best_score"))], F.max(F.when(F.col("k") == 2, F.col("score"))).alias("runner_up_score"))
    return blocked.join(two, "source_id", "left")


def classify_charity(matched: DataFrame, charities: DataFrame) -> DataFrame:
    """charity_status, matched_bn, matched_cra_name, charity_match_score, charity_runner_up_score, review_flag, charity_match_method.

    An exact number comes first; then the block and score decide; a fuzzy match that the record's own number contradicts goes to
    review.  ``charities``: cand_id, cand_bn, cand_name."""
    numbers = charities.where("cand_bn is not null").groupBy(F.col("cand_bn").alias("bn")).agg(F.min("cand_name").alias("bn_name"))
    by_id = charities.select(F.col("cand_id").alias("best_id"), F.col("cand_bn").alias("best_bn"))
    m = matched.join(numbers, "bn", "left").join(by_id, "best_id", "left")
    exact = F.col("bn_name").isNotNull()
    no_key, score = F.col("block_level") == NO_KEY, F.col("best_score")
    low = score.isNull() | (score < FLOOR)
    conflict = (score >= AUTO) & F.col("bn").isNotNull() & ~F.col("bn").eqNullSafe(F.col("best_bn"))
    status = F.when(exact, "registered_charity").when(no_key, "needs_review").when(low, "non_charity_nonprofit").when(conflict | (score < AUTO), "needs_review").otherwise("registered_charity")
    flag = F.when(exact, F.lit(None)).when(no_key, "no_blocking_key").when(low, F.lit(None)).when(conflict, "bn_contradicts_fuzzy_match").when(score < AUTO, "mid_band_score")
    fuzzy = ~exact & ~no_key & ~low
    return m.select(
        *[c for c in matched.columns if c not in ("best_id", "best_name", "best_score", "runner_up_score")], status.alias("charity_status"), F.when(exact, F.col("bn")).when(fuzzy, F.col("best_bn")).alias("matched_bn"), F.when(exact, F.col("bn_name")).when(fuzzy, F.col("best_name")).alias("matched_cra_name"),
        F.when(exact, 100.0).when(~no_key, score).alias("charity_match_score"), F.when(fuzzy, F.col("runner_up_score")).alias("charity_runner_up_score"), flag.alias("review_flag"), F.when(exact, "exact_bn").when(fuzzy, "fuzzy").alias("charity_match_method"),
    )


def classify_social(score: Column, program: Column) -> dict[str, Column]:
    """Positive signals only: a hit promotes, no hit never says more than that there was none."""
    high, mid = score >= AUTO, score >= FLOOR
    return {
        "social_status": F.when(high, "social_purpose").when(mid, "needs_review").otherwise("not_social"), "social_signal": F.when(mid, program), "social_match_score": score,
        "social_review_flag": F.when(high, F.lit(None)).when(mid, "mid_band_score").when(score.isNull(), "residual_no_signal").otherwise("residual_below_floor"),
    }


def classify_grants(matched: DataFrame, recipients: DataFrame) -> DataFrame:
    """federal_grant_status and the matched recipient with its totals; exact number first, then block and score.
    ``recipients``: cand_id, cand_bn, cand_name, n_grants, total_amount."""
    numbers = topk_per_group(recipients.where("cand_bn is not null"), ["cand_bn"], [F.col("cand_id").asc()], 1).select(F.col("cand_bn").alias("bn"), F.struct("cand_id", "cand_name", "n_grants", "total_amount").alias("x"))
    by_id = recipients.select(F.col("cand_id").alias("best_id"), F.struct("cand_id", "cand_name", "n_grants", "total_amount").alias("y"))
    m = matched.join(numbers, "bn", "left").join(by_id, "best_id", "left")
    exact, no_key, score = F.col("x").isNotNull(), F.col("block_level") == NO_KEY, F.col("best_score")
    low = score.isNull() | (score < FLOOR)
    status = F.when(exact, "federal_grant_match").when(no_key, "needs_review").when(low, "no_match").when(score >= AUTO, "federal_grant_match").otherwise("needs_review")
    flag = F.when(exact, F.lit(None)).when(no_key, "no_blocking_key").when(~low & (score < AUTO), "mid_band_score")
    hit = F.when(exact, F.col("x")).when(~no_key & ~low, F.col("y"))
    return m.select(
        *[c for c in matched.columns if c not in ("best_id", "best_name", "best_score", "runner_up_score")], status.alias("federal_grant_status"), hit["cand_id"].alias("matched_grant_entity_id"), hit["cand_name"].alias("matched_grant_entity_name"),
        F.when(exact, 100.0).when(~no_key, score).alias("federal_grant_match_score"), F.when(~exact & ~no_key & ~low, F.col("runner_up_score")).alias("federal_grant_runner_up_score"), hit["n_grants"].alias("federal_grants_received"), hit["total_amount"].alias("federal_dollars_received"), flag.alias("grant_review_flag"),
    )


def reconcile_collisions(df: DataFrame, status: str, accepted: str, entity: str, flag: str) -> DataFrame:
    """Every accepted record of an entity that more than one record claims goes to review.

    Claims are counted by entity with partial aggregation and joined back, so an entity that very many records claim doesn't
    meet in one task."""
    claims = df.where((F.col(status) == accepted) & F.col(entity).isNotNull()).groupBy(F.col(entity).alias("__e")).agg(F.count("*").alias("__n")).where("__n > 1")
    out = df.join(claims, F.col(entity) == F.col("__e"), "left")
    hit = (F.col(status) == accepted) & F.col("__n").isNotNull()
    return out.withColumn(flag, F.when(hit, "grant_entity_claimed_by_multiple_orgs").otherwise(F.col(flag))).withColumn(status, F.when(hit, "needs_review").otherwise(F.col(status))).drop("__e", "__n")


def reconcile_low_confidence(df: DataFrame, status: str, accepted: str, score: str, flag: str, least: float = 100.0) -> DataFrame:
    hit = (F.col(status) == accepted) & (F.col(score) < least)
    return df.withColumn(flag, F.when(hit, "low_confidence_fuzzy_match").otherwise(F.col(flag))).withColumn(status, F.when(hit, "needs_review").otherwise(F.col(status)))


def grant_recipients(entities: DataFrame, grants: DataFrame, kinds: tuple[str, ...] = ("other_org",), province: str | None = None) -> DataFrame:
    """Federal recipients with their totals."""
    own = entities.where(F.col("entity_kind").isin(*kinds))
    if province:
        own = own.where(expr.in_province(F.col("province"), province))
    sums = grants.where("source_dataset = 'federal_gc'").groupBy(F.col("recipient_entity_id").alias("entity_id")).agg(F.count("*").alias("n_grants"), F.sum("amount_cad").alias("total_amount"))
    out = own.join(sums, "entity_id")
    return out.select(F.col("entity_id").alias("cand_id"), F.col("canonical_name").alias("cand_name"), F.col("city").alias("cand_city"), F.lit(None).cast("string").alias("cand_postal"), F.col("bn_root").alias("cand_bn"), F.col("entity_id").alias("ord"), "n_grants", "total_amount")


def social_grants(entities: DataFrame, grants: DataFrame, province: str | None = None, keywords: tuple[str, ...] = SOCIAL_KEYWORDS) -> DataFrame:
    """Recipients of grants of social programmes."""
    rows = grants.where("source_dataset = 'federal_gc'").where(expr.has_keyword([F.col("program_name"), F.col("description")], keywords))
    own = entities if province is None else entities.where(expr.in_province(F.col("province"), province))
    out = rows.join(own, rows["recipient_entity_id"] == own["entity_id"]).groupBy("entity_id").agg(F.min("canonical_name").alias("cand_name"), F.min("city").alias("cand_city"), F.min("program_name").alias("program_name"))
    return out.select(F.col("entity_id").alias("cand_id"), "cand_name", "cand_city", F.lit(None).cast("string").alias("cand_postal"), F.col("entity_id").alias("ord"), "program_name")


def discover(records: DataFrame, charities: DataFrame, recipients: DataFrame | None = None, social: DataFrame | None = None, *, national: bool = False) -> DataFrame:
    """The whole cascade.  Social and grant stages look at what is no charity; in a national registry an exact number links
    grants for all records and grant matches below 100 go to review."""
    out = classify_charity(best_match(block_level(records, charities), charities), charities)
    rest = out.where("charity_status = 'non_charity_nonprofit'")
    if social is not None:
        hits = best_match(block_level(rest.select(*records.columns), social, True), social, True)
        hits = hits.join(social.select(F.col("cand_id").alias("best_id"), "program_name"), "best_id", "left")
        hits = hits.select("source_id", *[c.alias(n) for n, c in classify_social(F.col("best_score"), F.col("program_name")).items()])
        out = out.join(hits, "source_id", "left")
    if recipients is not None:
        pool = out if national else rest
        hits = best_match(block_level(pool.select(*records.columns), recipients, True), recipients, True)
        hits = reconcile_collisions(classify_grants(hits, recipients), "federal_grant_status", "federal_grant_match", "matched_grant_entity_id", "grant_review_flag")
        if national:
            hits = reconcile_low_confidence(hits, "federal_grant_status", "federal_grant_match", "federal_grant_match_score", "grant_review_flag")
        names = ["source_id", "federal_grant_status", "matched_grant_entity_id", "matched_grant_entity_name", "federal_grant_match_score", "federal_grant_runner_up_score", "federal_grants_received", "federal_dollars_received", "grant_review_flag"]
        out = out.join(hits.select(*names), "source_id", "left")
    return out


#: The columns of the discovery output, in order.
OUTPUT_FIELDS = (
    "source_id", "jurisdiction", "discovery_source", "legal_name", "trade_names", "address", "postal", "city", "legal_form", "charity_status", "matched_bn", "matched_cra_name",
    "charity_match_score", "charity_runner_up_score", "charity_match_method", "social_status", "social_signal", "social_match_score", "federal_grant_status", "matched_grant_entity_id",
    "matched_grant_entity_name", "federal_grant_match_score", "federal_grant_runner_up_score", "federal_grants_received", "federal_dollars_received", "review_flag",
    "discovery_snapshot_date", "cra_snapshot_date", "grants_snapshot_date",
)


def output_rows(found: DataFrame, **constants: str) -> DataFrame:
    """The output's columns: those missing are null, trade names one string, the review flag the first one that is set."""
    have = set(found.columns)
    cols = []
    for name in OUTPUT_FIELDS:
        if name == "review_flag":
            c = F.coalesce(*[F.col(x) for x in ("review_flag", "social_review_flag", "grant_review_flag") if x in have], F.lit(None).cast("string"))
        elif name == "trade_names" and name in have:
            c = F.concat_ws("; ", F.col(name))
        elif name in have:
            c = F.col(name)
        else:
            c = F.lit(constants.get(name)).cast("string")
        cols.append(c.alias(name))
    return found.select(*cols)


def badge_index(rows: DataFrame) -> DataFrame:
    """Non-charities with a confirmed grant match by entity, with the set of sources that confirm it."""
    good = rows.where("charity_status = 'non_charity_nonprofit' and federal_grant_status = 'federal_grant_match' and matched_grant_entity_id is not null")
    return good.groupBy(F.col("matched_grant_entity_id").alias("entity_id")).agg(F.array_sort(F.collect_set("discovery_source")).alias("sources"), F.min("legal_name").alias("legal_name"))


def by_source(index: DataFrame, total: str = "all") -> DataFrame:
    """An entity counts under every source that confirms it, and once in the total."""
    each = index.select("entity_id", F.explode("sources").alias("source")).groupBy("source").agg(F.count("*").alias("n"))
    return each.unionByName(index.agg(F.lit(total).alias("source"), F.countDistinct("entity_id").alias("n")))


def latest_registry(idents: DataFrame) -> DataFrame:
    """The latest row of each number, "active" if it is of the last year there is, else "revoked_or_inactive"."""
    from .resolve import charities

    last = idents.agg(F.max("source_year").alias("last"))
    return charities(idents).crossJoin(F.broadcast(last)).withColumn("registry_status", F.when(F.col("source_year") == F.col("last"), "active").otherwise("revoked_or_inactive")).drop("last")


