"""Search and lookup over the graph and over grant texts.

Every function returns DataFrames for a query or for all entities at once; a page's total is an aggregate beside it, not a window
over everything.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr

PROMOTION = 100.0


def fold_query(text: str) -> str:
    """A query in the form that ``search_name`` has (on the driver: one short string)."""
    folded = " ".join(text.split()).translate(str.maketrans(expr.ACCENTED, expr.PLAIN))
    return folded.lower()


def with_total(page: DataFrame, total: DataFrame) -> DataFrame:
    return page.crossJoin(F.broadcast(total))


def search_orgs(entities: DataFrame, roles: DataFrame, query: str, *, flags: DataFrame | None = None, required: Sequence[str] = (), limit: int = 50, offset: int = 0, ids: DataFrame | None = None) -> DataFrame:
    """Entities whose folded name has the query at a word start: tier 0 if it is the name, 1 if the name begins with it, 2 else.

    The order is tier, flow, id; an entity of tier 2 with more than a hundred times the greatest flow of tier 1 is ranked in
    tier 1.  Flags are AND-ed; ``ids`` restricts to some entities.  Columns: entity_id, canonical_name,
    entity_kind, total_flow, tier, total."""
    q = fold_query(query)
    name = F.col("search_name")
    hits = entities.where(expr.word_start(name, q)) if q else entities
    if required and flags is not None:
        hits = hits.join(flags.where(" and ".join(f"`{r}`" for r in required)).select("entity_id"), "entity_id", "left_semi")
    if ids is not None:
        hits = hits.join(ids.select("entity_id"), "entity_id", "left_semi")
    flow = roles.select("entity_id", (F.col("total_given") + F.col("total_received")).alias("total_flow"))
    tier = F.when(name == q, 0).when(F.startswith(name, F.lit(q)), 1).otherwise(2)
    rows = hits.join(flow, "entity_id", "left").select("entity_id", "canonical_name", "entity_kind", F.coalesce("total_flow", F.lit(0.0)).alias("total_flow"), tier.alias("tier"))
    facts = rows.agg(F.count("*").alias("total"), F.max(F.when(F.col("tier") == 1, F.col("total_flow"))).alias("top_flow"))
    ranked = rows.crossJoin(F.broadcast(facts))
    rank = F.when((F.col("tier") > 1) & (F.col("total_flow") > PROMOTION * F.coalesce("top_flow", F.lit(0.0))), 1).otherwise(F.col("tier"))
    return ranked.withColumn("rank_tier", rank).orderBy("rank_tier", F.desc("total_flow"), "entity_id").offset(offset).limit(limit).select("entity_id", "canonical_name", "entity_kind", "total_flow", "tier", "total")


def landing_list(entities: DataFrame, roles: DataFrame, n: int = 20) -> DataFrame:
    flow = roles.select("entity_id", (F.col("total_given") + F.col("total_received")).alias("total_flow"))
    return entities.join(flow, "entity_id").orderBy(F.desc("total_flow"), "entity_id").limit(n).select("entity_id", "canonical_name", "total_flow")


def normalized_text(x: Column) -> Column:
    return expr.blank_to_null(expr.squeezed(x))


def text_id(x: Column) -> Column:
    return F.substring(F.sha2(normalized_text(x), 256), 1, 16)


def text_index(grants: DataFrame, text: str = "description") -> DataFrame:
    """Each distinct text with its id, grants, dollars, and sorted programmes and sources."""
    rows = grants.withColumn("norm_text", normalized_text(F.col(text))).where("norm_text is not null")
    return rows.groupBy("norm_text").agg(F.count("*").alias("n_grants"), F.sum("amount_cad").alias("total_amount"), F.min("program_name").alias("program_name"), F.array_sort(F.collect_set("source_dataset")).alias("sources")).withColumn("text_id", F.substring(F.sha2("norm_text", 256), 1, 16))


def search_texts(index: DataFrame, query: str, sources: Sequence[str] = (), limit: int = 50, offset: int = 0) -> DataFrame:
    """Texts with the folded query at a word start, any of the sources, most grants first; with the total."""
    hits = index.where(expr.word_start(expr.fold(F.col("norm_text")), fold_query(query)))
    if sources:
        hits = hits.where(F.arrays_overlap("sources", F.array(*[F.lit(s) for s in sources])))
    page = hits.orderBy(F.desc("n_grants"), "text_id").offset(offset).limit(limit)
    return with_total(page, hits.agg(F.count("*").alias("total")))


def grants_of_text(grants: DataFrame, entities: DataFrame, text_hash: str | None = None, text: str = "description") -> DataFrame:
    """Grants with their text's id and both names: of one text, or of all in bulk."""
    rows = grants.withColumn("text_id", text_id(F.col(text))).where("text_id is not null")
    if text_hash is not None:
        rows = rows.where(F.col("text_id") == text_hash)
    names = entities.select("entity_id", "canonical_name")
    f = names.select(F.col("entity_id").alias("funder_entity_id"), F.col("canonical_name").alias("funder_name"))
    r = names.select(F.col("entity_id").alias("recipient_entity_id"), F.col("canonical_name").alias("recipient_name"))
    return rows.join(f, "funder_entity_id").join(r, "recipient_entity_id")


def find_entities(entities: DataFrame, query: str) -> DataFrame:
    """By id, by number or by part of the name; if a name matches exactly (up to case), it alone, if it is the only one."""
    q = query.strip()
    if re.fullmatch(r"[0-9]{9}", q):
        return entities.where(F.col("bn_root") == q)
    if re.fullmatch(r"[0-9]+", q):
        return entities.where(F.col("entity_id") == int(q))
    hits = entities.where(F.col("canonical_name").ilike(f"%{expr.like_escaped(q)}%"))
    exact = F.lower("canonical_name") == q.lower()
    n = hits.agg(F.count_if(exact).alias("__n"))
    return hits.crossJoin(F.broadcast(n)).where((F.col("__n") != 1) | exact).drop("__n")


def link_variants(links: DataFrame) -> DataFrame:
    """Every raw name under which each entity occurs, by source and method, with counts."""
    return links.groupBy("entity_id", "source_dataset", "raw_name", "match_method").agg(F.count("*").alias("n"), F.max("match_score").alias("match_score"))


def grants_by_direction(grants: DataFrame, entities: DataFrame) -> DataFrame:
    """Every grant under both of its entities: entity_id, direction (received or given), the other side's id and name, and the grant."""
    sides = F.array(
        F.struct(F.col("recipient_entity_id").alias("entity_id"), F.lit("received").alias("direction"), F.col("funder_entity_id").alias("other_entity_id")),
        F.struct(F.col("funder_entity_id").alias("entity_id"), F.lit("given").alias("direction"), F.col("recipient_entity_id").alias("other_entity_id")),
    )
    each = grants.withColumn("__s", F.explode(sides)).select("__s.*", *[c for c in grants.columns if c not in ("funder_entity_id", "recipient_entity_id")])
    return each.join(entities.select(F.col("entity_id").alias("other_entity_id"), F.col("canonical_name").alias("other_name")), "other_entity_id")


def profiles(entities: DataFrame, roles: DataFrame, financials: DataFrame) -> DataFrame:
    """What a page's head shows of every entity: itself, its role ("no_flows" without grants) and its latest financials."""
    out = entities.join(roles.select("entity_id", "total_given", "total_received", "role"), "entity_id", "left").join(financials.drop("bn_root"), "entity_id", "left")
    zero = F.lit(0.0)
    return out.withColumns({"total_given": F.coalesce("total_given", zero), "total_received": F.coalesce("total_received", zero), "role": F.coalesce("role", F.lit("no_flows"))})


def timeline(grants: DataFrame, financials: DataFrame) -> DataFrame:
    """entity_id, fiscal_year, received, given, declared and identified government and foundation money, over the union of years."""
    received = grants.groupBy(F.col("recipient_entity_id").alias("entity_id"), "fiscal_year").agg(F.sum("amount_cad").alias("received"), F.sum(F.when(F.col("source_dataset").isin("federal_gc", "canada_council", "otf"), F.col("amount_cad"))).alias("gov_identified"), F.sum(F.when(F.col("source_dataset") == "t3010_qualified_donee", F.col("amount_cad"))).alias("foundation_identified"))
    given = grants.groupBy(F.col("funder_entity_id").alias("entity_id"), "fiscal_year").agg(F.sum("amount_cad").alias("given"))
    declared = financials.where("fiscal_year is not null").groupBy("entity_id", "fiscal_year").agg(F.max("revenue_from_any_cdn_gov").alias("gov_declared"), F.max("revenue_from_foundations").alias("foundation_declared"))
    out = received.join(given, ["entity_id", "fiscal_year"], "full").join(declared, ["entity_id", "fiscal_year"], "full").where("fiscal_year is not null")
    pct = lambda a, b: F.when(F.col(b) > 0, 100.0 * F.coalesce(F.col(a), F.lit(0.0)) / F.col(b))
    return out.withColumns({"gov_pct": pct("gov_identified", "gov_declared"), "foundation_pct": pct("foundation_identified", "foundation_declared")})


def prorated_by_year(grants: DataFrame, agreements: DataFrame) -> DataFrame:
    """Federal receipts spread over their agreements' years: entity_id, fiscal_year, amount.

    ``agreements``: source_ref, start_date, end_date."""
    joined = grants.where("source_ref is not null").join(agreements, "source_ref")
    parts = F.explode(expr.prorated(F.col("amount_cad"), expr.fiscal_year(F.col("start_date")), expr.fiscal_year(F.col("end_date")))).alias("p")
    return joined.select(F.col("recipient_entity_id").alias("entity_id"), parts).select("entity_id", "p.*").groupBy("entity_id", "fiscal_year").agg(F.sum("amount").alias("amount"))


def locate_receipts(wanted: DataFrame, receipts: DataFrame, keys: Sequence[str], amount: str = "amount", tolerance: float = 0.01) -> DataFrame:
    """For each wanted row (with ``id``) the only receipt of equal keys and an amount within the tolerance, else why there is none."""
    r = receipts.select(*keys, F.col(amount).alias("__amount"), F.col("receipt_id"))
    near = F.abs(F.col(amount) - F.col("__amount")) <= tolerance
    hits = wanted.join(r, list(keys), "left").groupBy("id").agg(F.count_if(F.coalesce(near, F.lit(False))).alias("n"), F.min(F.when(near, F.col("receipt_id"))).alias("receipt_id"))
    reason = F.when(F.col("n") == 1, "found").when(F.col("n") == 0, "no match").otherwise("ambiguous")
    return hits.select("id", F.when(F.col("n") == 1, F.col("receipt_id")).alias("receipt_id"), reason.alias("reason"))


def amendment_chain(rows: DataFrame, key: Sequence[str], number: str, value: str) -> DataFrame:
    """All versions of each agreement in order, as one string "number:value > ..."."""
    steps = F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.col(value).alias("v"))))
    return rows.groupBy(*key).agg(steps.alias("s")).select(*key, F.array_join(F.transform("s", lambda x: F.concat(x["n"].cast("string"), F.lit(":"), x["v"].cast("string"))), " > ").alias("chain"), F.size("s").alias("versions"))


def slug_manifest(entities: DataFrame, name: str = "canonical_name", key: str = "entity_id") -> DataFrame:
    """A unique page name for each entity: its slug, with the id after it for all but the slug's lowest id.

    The lowest ids are an aggregate that is joined back, so a slug that very many names share doesn't meet in one task."""
    slug = expr.slugify(F.split_part(expr.english_name(F.col(name)), F.lit("/"), F.lit(1)))
    own = entities.select(key, slug.alias("base"))
    out = own.join(own.groupBy("base").agg(F.min(key).alias("__first")), "base")
    return out.select(key, F.when(F.col(key) == F.col("__first"), F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col(key).cast("string"))).alias("slug"))


def department_of(grants: DataFrame) -> DataFrame:
    """The code of each federal funder, from the part of its references before "|" (the lowest, if there were several)."""
    return grants.where("source_ref is not null").groupBy("funder_entity_id").agg(F.min(F.split_part("source_ref", F.lit("|"), F.lit(1))).alias("owner_org"))


def static_search(entities: DataFrame, flags: DataFrame, query: str, required: Sequence[str] = (), limit: int = 50) -> DataFrame:
    """Plain substring search, flags AND-ed, with the true count."""
    hits = entities.where(F.lower("canonical_name").contains(query.lower()))
    if required:
        hits = hits.join(flags.where(" and ".join(f"`{r}`" for r in required)).select("entity_id"), "entity_id", "left_semi")
    return with_total(hits.orderBy("entity_id").limit(limit), hits.agg(F.count("*").alias("total")))


def static_text_search(index: DataFrame, query: str, sources: Sequence[str] = (), limit: int = 50) -> DataFrame:
    """Substring of text or programme; sources OR-ed."""
    q = query.lower()
    hits = index.where(F.lower("norm_text").contains(q) | F.coalesce(F.lower("program_name").contains(q), F.lit(False)))
    if sources:
        hits = hits.where(F.arrays_overlap("sources", F.array(*[F.lit(s) for s in sources])))
    return with_total(hits.orderBy(F.desc("n_grants"), "text_id").limit(limit), hits.agg(F.count("*").alias("total")))


def unified_search(entities: DataFrame, roles: DataFrame, index: DataFrame, query: str, n: int = 8) -> tuple[DataFrame, DataFrame]:
    """A preview of both searches."""
    return search_orgs(entities, roles, query, limit=n), search_texts(index, query, limit=n)




# --- a read-only gateway --------------------------------------------------------------------------------------------------

_FORBIDDEN = re.compile(r"\b(insert|update|delete|drop|create|alter|attach|detach|copy|export|import|install|load|pragma|set|reset|call|truncate|merge|refresh|cache|uncache|add|analyze|msck|use)\b", re.IGNORECASE)


def read_only(spark: SparkSession, sql: str, cap: int = 500) -> tuple[DataFrame, DataFrame]:
    """The first ``cap`` rows of one SELECT or WITH statement, and a one-row frame that says whether there are more.

    Refuses several statements, other words at the start, forbidden keywords outside of quotes, and any statement that Spark
    parses as a command."""
    text = sql.strip().rstrip(";").strip()
    bare = re.sub(r"'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|/\*.*?\*/", " ", text, flags=re.DOTALL)
    if ";" in bare:
        raise ValueError("one statement at a time")
    if not re.match(r"(?is)\s*(select|with)\b", bare):
        raise ValueError("only SELECT or WITH")
    if found := _FORBIDDEN.search(bare):
        raise ValueError(f"not allowed: {found[0]}")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text).getClass().getName()
    if "Command" in plan or ".InsertInto" in plan:
        raise ValueError("a command, not a query")
    rows = spark.sql(text)
    more = rows.limit(cap + 1).agg((F.count("*") > cap).alias("truncated"))
    return rows.limit(cap), more
