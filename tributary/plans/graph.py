"""The graph's sources, marts, merges and lookups over analogue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import flow, marts, merges, resolve, search, study
from .base import FLOWS, PANEL, Tables, doubles, longs, money, query, rounded
from .domain import _EVENTS, _MATCHED, _YEARS, _cohorts, _grants

# --- entities and grants --------------------------------------------------------------------------------------------------

_ENT = """ent AS (SELECT n_nationkey + 100 AS entity_id, CASE WHEN n_nationkey % 4 <> 0 THEN lpad(CAST(n_nationkey AS VARCHAR), 9, '1') END AS bn_root, n_name AS canonical_name, 'City ' || n_regionkey AS city,
  CASE WHEN n_nationkey % 3 = 0 THEN ' qc ' WHEN n_nationkey % 3 = 1 THEN 'ON' END AS province, CASE WHEN n_nationkey % 2 = 0 THEN 'other_org' ELSE 'charity' END AS entity_kind FROM nation)"""


def _entities(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    return t.nation.select(
        (k + 100).cast("long").alias("entity_id"), F.when(k % 4 != 0, F.lpad(k.cast("string"), 9, "1")).alias("bn_root"), F.col("n_name").alias("canonical_name"), F.concat(F.lit("City "), F.col("n_regionkey").cast("string")).alias("city"),
        F.when(k % 3 == 0, " qc ").when(k % 3 == 1, "ON").alias("province"), F.when(k % 2 == 0, "other_org").otherwise("charity").alias("entity_kind"),
    )


_SOURCES = ("1-URGENT", "2-HIGH")


@query(f"""WITH {FLOWS}, {_ENT} SELECT bn_root, year AS fiscal_year, round(CAST(sum(amount) AS DOUBLE), 2) AS amount FROM flows JOIN ent ON entity_id = recipient + 100
WHERE bn_root IS NOT NULL AND source IN ('1-URGENT', '2-HIGH') AND NOT (source = '1-URGENT' AND year NOT BETWEEN 1996 AND 1999) GROUP BY 1, 2""")
def yearly_receipts(t: Tables) -> DataFrame:
    return study.yearly_receipts(_grants(t), _entities(t), _SOURCES, 1996, 1999, "1-URGENT").withColumn("amount", F.round("amount", 2))


@query(f"""WITH {FLOWS}, {_ENT} SELECT bn_root, entity_id, source AS source_dataset, year AS fiscal_year, round(CAST(sum(amount) AS DOUBLE), 2) AS amount FROM flows JOIN ent ON entity_id = recipient + 100
WHERE bn_root IS NOT NULL AND source IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2, 3, 4""")
def hop1_yearly(t: Tables) -> DataFrame:
    return flow.hop1_yearly(_grants(t), _entities(t), _SOURCES).withColumn("amount", F.round("amount", 2))


@query(f"""WITH {_ENT}, s AS (SELECT o_custkey % 211 AS filer, year(o_orderdate) AS y, c_nationkey AS donee, CAST(o_totalprice AS DECIMAL(18,2)) AS v, o_orderkey % 3 AS sy FROM orders JOIN customer ON o_custkey = c_custkey),
r AS (SELECT *, row_number() OVER (PARTITION BY filer, y, donee ORDER BY sy DESC, v DESC) AS rn FROM s)
SELECT lpad(CAST(filer AS VARCHAR), 9, '0') AS bn_root, CAST(y AS BIGINT) AS fiscal_year, lpad(CAST(donee AS VARCHAR), 9, '1') AS donee_bn_root, entity_id AS donee_entity_id, CAST(v AS DOUBLE) AS amount
FROM r LEFT JOIN ent ON ent.bn_root = lpad(CAST(donee AS VARCHAR), 9, '1') WHERE rn = 1""")
def donee_gifts(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    filer, donee = F.lpad((F.col("o_custkey") % 211).cast("string"), 9, "0"), F.lpad(F.col("c_nationkey").cast("string"), 9, "1")
    schedule = rows.select(
        F.concat(filer, F.lit("RR0001")).alias("BN"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("FPE"), F.concat(F.lit(" "), donee, F.lit("-RR0001")).alias("Donee BN"), F.concat(F.lit("Donee "), F.col("c_nationkey").cast("string")).alias("Donee Name"),
        F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("Total Gifts"), (F.col("o_orderkey") % 3 + 2000).alias("source_year"),
    )
    return longs(flow.donee_gifts(schedule, _entities(t)).select("bn_root", "fiscal_year", "donee_bn_root", "donee_entity_id", "amount"), "fiscal_year")


_LINKS = """links AS (SELECT c_nationkey + 100 AS entity_id, CASE c_custkey % 3 WHEN 0 THEN '1-URGENT' WHEN 1 THEN '2-HIGH' ELSE '5-LOW' END AS source_dataset, 'Raw ' || (c_custkey % 7) AS raw_name,
  CASE WHEN (c_nationkey + c_custkey % 3) % 4 = 0 THEN 'exact_bn' WHEN c_custkey % 5 = 0 THEN 'fuzzy_accept' ELSE 'unmatched_new' END AS match_method, CASE WHEN c_custkey % 5 = 0 THEN 90.0 + c_custkey % 10 END AS match_score FROM customer)"""


def _links(t: Tables) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    source = F.when(k % 3 == 0, "1-URGENT").when(k % 3 == 1, "2-HIGH").otherwise("5-LOW")
    method = F.when((n + k % 3) % 4 == 0, "exact_bn").when(k % 5 == 0, "fuzzy_accept").otherwise("unmatched_new")
    return t.customer.select((n + 100).cast("long").alias("entity_id"), source.alias("source_dataset"), F.concat(F.lit("Raw "), (k % 7).cast("string")).alias("raw_name"), method.alias("match_method"), F.when(k % 5 == 0, (k % 10 + 90).cast("double")).alias("match_score"))


@query(f"""WITH {FLOWS}, {_ENT}, {_LINKS}, e AS (SELECT DISTINCT bn_root, year AS Y FROM flows JOIN ent ON entity_id = recipient + 100 WHERE bn_root IS NOT NULL),
x AS (SELECT DISTINCT bn_root, year AS Y FROM flows JOIN ent ON ent.entity_id = recipient + 100 JOIN links ON links.entity_id = ent.entity_id AND links.source_dataset = flows.source WHERE match_method = 'exact_bn' AND source IN ('1-URGENT', '2-HIGH'))
SELECT bn_root, CAST(Y AS BIGINT) AS y FROM e JOIN x USING (bn_root, Y)""")
def exact_linked_events(t: Tables) -> DataFrame:
    g, e = _grants(t), _entities(t)
    events = g.join(e.where("bn_root is not null").select(F.col("entity_id").alias("recipient_entity_id"), "bn_root"), "recipient_entity_id").select("bn_root", F.col("fiscal_year").alias("Y")).distinct()
    return study.exact_pairs(events, g, _links(t), e, _SOURCES).select("bn_root", F.col("Y").cast("long").alias("y"))


@query(f"""WITH {_LINKS} SELECT entity_id, source_dataset, raw_name, match_method, count(*) AS n, max(match_score) AS match_score FROM links GROUP BY 1, 2, 3, 4""")
def link_variants(t: Tables) -> DataFrame:
    return search.link_variants(_links(t))


@query(f"WITH {_LINKS} SELECT source_dataset, match_method, count(*) AS n FROM links GROUP BY 1, 2")
def method_by_source(t: Tables) -> DataFrame:
    return marts.method_by_source(_links(t))


@query(f"""WITH {_MATCHED}, u AS (SELECT 'treated' AS arm, 'none' AS tier, bn_root % 2 = 0 AS exact_bn, 0 AS matched_to FROM tr UNION ALL SELECT 'control', CASE tier WHEN 1 THEN 'decile_trend' WHEN 2 THEN 'decile' ELSE 'province' END, NULL, treated_bn FROM matches)
SELECT arm, tier, exact_bn, count(*) AS n, CAST(sum(matched_to) AS BIGINT) AS matched_to FROM u GROUP BY 1, 2, 3""")
def study_panel(t: Tables) -> DataFrame:
    treated, controls = _cohorts(t)
    stats = study.window_stats(treated.select("bn_root", "Y").unionByName(controls.select("bn_root", "Y")), t.donations())
    p = study.panel(treated, study.match_controls(treated, controls), controls, stats, treated.where("bn_root % 2 = 0").select("bn_root", "Y"))
    return p.groupBy("arm", F.coalesce("tier", F.lit("none")).alias("tier"), "exact_bn").agg(F.count("*").alias("n"), F.sum(F.coalesce("matched_to", F.lit(0))).cast("long").alias("matched_to"))


@query(f"""WITH {PANEL}, {_EVENTS}, k AS (SELECT * FROM events WHERE Y <> 1998),
a AS (SELECT * , (post_mean - pre_mean) / pre_mean AS pct FROM (SELECT e.bn_root, e.Y, avg(CASE WHEN fiscal_year BETWEEN Y - 3 AND Y - 1 THEN donations END) AS pre_mean, avg(CASE WHEN fiscal_year BETWEEN Y + 1 AND Y + 3 THEN donations END) AS post_mean,
  count(CASE WHEN fiscal_year BETWEEN Y - 3 AND Y - 1 THEN donations END) AS n_pre, count(CASE WHEN fiscal_year BETWEEN Y + 1 AND Y + 3 THEN donations END) AS n_post FROM k e JOIN donations d ON e.bn_root = d.bn_root GROUP BY 1, 2) WHERE n_pre >= 2 AND n_post >= 2 AND pre_mean > 0)
SELECT CAST(Y AS BIGINT) AS y, round(median(pct), 6) AS treated_median, count(*) AS n_treated FROM a GROUP BY 1""")
def year_drop(t: Tables) -> DataFrame:
    """Robustness: the contrast without one cohort year."""
    out = study.contrast(t.receipts(), t.donations(), 100_000, [y for y in _YEARS if y != 1998])
    return rounded(out.select(F.col("Y").cast("long").alias("y"), "treated_median", "n_treated"), "treated_median")


# --- lookups --------------------------------------------------------------------------------------------------------------


@query(f"""WITH {_ENT} SELECT 'id' AS how, entity_id FROM ent WHERE entity_id = 107 UNION ALL SELECT 'number', entity_id FROM ent WHERE bn_root = '111111117' UNION ALL SELECT 'part', entity_id FROM ent WHERE canonical_name ILIKE '%ation\\_1%' ESCAPE '\\'
UNION ALL SELECT 'whole', entity_id FROM ent WHERE lower(canonical_name) = (SELECT lower(canonical_name) FROM ent WHERE entity_id = 101)""")
def find_entities(t: Tables) -> DataFrame:
    e = _entities(t)
    whole = e.where("entity_id = 101").first()["canonical_name"]  # one name
    out = None
    for how, q in (("id", "107"), ("number", " 111111117 "), ("part", "ation_1"), ("whole", whole.upper())):
        part = search.find_entities(e, q).select(F.lit(how).alias("how"), "entity_id")
        out = part if out is None else out.unionByName(part)
    return out


_ROLES = f"""{FLOWS}, g AS (SELECT funder + 100 AS id, CAST(sum(CASE WHEN funder % 3 = 0 THEN amount ELSE 0 END) AS DOUBLE) AS given FROM flows GROUP BY 1), r AS (SELECT recipient + 100 AS id, CAST(sum(amount) AS DOUBLE) AS received FROM flows GROUP BY 1),
roles AS (SELECT r.id AS entity_id, coalesce(given, 0) AS total_given, received AS total_received FROM r LEFT JOIN g ON r.id = g.id)"""


def _roles(t: Tables) -> DataFrame:
    f = t.flows()
    g = f.groupBy((F.col("funder") + 100).alias("entity_id")).agg(F.sum(F.when(F.col("funder") % 3 == 0, F.col("amount")).otherwise(0)).cast("double").alias("total_given"))
    r = f.groupBy((F.col("recipient") + 100).alias("entity_id")).agg(F.sum("amount").cast("double").alias("total_received"))
    out = r.join(g, "entity_id", "left").withColumn("total_given", F.coalesce("total_given", F.lit(0.0)))
    share = F.col("total_given") / (F.col("total_given") + F.col("total_received"))
    return out.withColumn("role", F.when(share >= 0.9, "primarily_funder").when(share <= 0.1, "primarily_recipient").otherwise("dual_role"))


@query(f"""WITH {_ROLES}, {_ENT} SELECT entity_id, canonical_name, round(total_given + total_received, 2) AS total_flow FROM ent JOIN roles USING (entity_id) ORDER BY total_given + total_received DESC, entity_id LIMIT 20""")
def landing_list(t: Tables) -> DataFrame:
    return search.landing_list(_entities(t), _roles(t)).withColumn("total_flow", F.round("total_flow", 2))


@query(f"""WITH {_ROLES} SELECT entity_id, round(total_given, 2) AS total_given FROM roles WHERE total_given / (total_given + total_received) > 0.1 AND total_given / (total_given + total_received) < 0.9 ORDER BY total_given + total_received DESC, entity_id LIMIT 5""")
def top_dual_role(t: Tables) -> DataFrame:
    return marts.top_dual_role(_roles(t), 5).select("entity_id", F.round("total_given", 2).alias("total_given"))


@query("""SELECT o_custkey % 40 AS funder_entity_id, min(o_orderpriority) AS owner_org FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def department_of(t: Tables) -> DataFrame:
    ref = F.when(F.col("o_orderstatus") != "P", F.concat("o_orderpriority", F.lit("|R-"), F.col("o_orderkey").cast("string")))
    return search.department_of(t.orders.select((F.col("o_custkey") % 40).alias("funder_entity_id"), ref.alias("source_ref")))


@query("""WITH h AS (SELECT p_partkey AS entity_id, p_name AS canonical_name, p_size FROM part WHERE contains(lower(p_name), 'ring') AND p_size % 2 = 0 AND p_size > 10)
SELECT entity_id, canonical_name, (SELECT count(*) FROM h) AS total FROM h ORDER BY entity_id LIMIT 50""")
def static_search(t: Tables) -> DataFrame:
    ents = t.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("canonical_name"))
    flags = t.part.select(F.col("p_partkey").alias("entity_id"), (F.col("p_size") % 2 == 0).alias("even"), (F.col("p_size") > 10).alias("large"))
    return search.static_search(ents, flags, "RING", ("even", "large"))


_TEXTS = """idx AS (SELECT trim(regexp_replace(text, '\\s+', ' ', 'g')) AS norm_text, count(*) AS n_grants, min(source) AS program_name, list_sort(list(DISTINCT source)) AS sources FROM documents GROUP BY 1),
ids AS (SELECT *, substr(sha256(norm_text), 1, 16) AS text_id FROM idx WHERE norm_text <> '')"""


def _texts(t: Tables) -> DataFrame:
    return search.text_index(t.documents.select(F.col("text").alias("description"), F.lit(1.0).alias("amount_cad"), F.col("source").alias("program_name"), F.col("source").alias("source_dataset")))


@query(f"""WITH {_TEXTS}, h AS (SELECT * FROM ids WHERE (contains(lower(norm_text), 'qu') OR contains(lower(program_name), 'qu')) AND list_has_any(sources, ['src1', 'src2']))
SELECT text_id, n_grants, (SELECT count(*) FROM h) AS total FROM h ORDER BY n_grants DESC, text_id LIMIT 50""")
def static_text_search(t: Tables) -> DataFrame:
    return search.static_text_search(_texts(t), "QU", ("src1", "src2")).select("text_id", "n_grants", "total")


@query(f"""WITH {_TEXTS}, p AS (SELECT p_partkey AS id, lower(p_name) AS s, CAST(p_size * 1000 AS DOUBLE) AS flow FROM part), o AS (SELECT id, flow FROM p WHERE regexp_matches(s, '(^|[^a-zA-Z0-9])re') ORDER BY flow DESC, id LIMIT 8),
x AS (SELECT text_id FROM ids WHERE regexp_matches(lower(strip_accents(norm_text)), '(^|[^a-zA-Z0-9])re') ORDER BY n_grants DESC, text_id LIMIT 8)
SELECT 'organisation' AS kind, CAST(id AS VARCHAR) AS hit FROM o UNION ALL SELECT 'text', text_id FROM x""")
def unified_search(t: Tables) -> DataFrame:
    # All names count as one tier, which leaves the order to flow and id.
    ents = t.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("canonical_name"), F.lit("other_org").alias("entity_kind"), F.concat(F.lit("the "), expr.fold(F.col("p_name"))).alias("search_name"))
    roles = t.part.select(F.col("p_partkey").alias("entity_id"), (F.col("p_size") * 1000.0).cast("double").alias("total_given"), F.lit(0.0).alias("total_received"))
    orgs, found = search.unified_search(ents, roles, _texts(t), "re")
    return orgs.select(F.lit("organisation").alias("kind"), F.col("entity_id").cast("string").alias("hit")).unionByName(found.select(F.lit("text").alias("kind"), F.col("text_id").alias("hit")))


@query("""WITH s AS (SELECT o_custkey % 97 AS entity_id, CAST(o_totalprice AS DOUBLE) AS v, year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END AS y1, year(last) - CASE WHEN month(last) < 4 THEN 1 ELSE 0 END AS y2
  FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS last FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderkey % 3 <> 0),
e AS (SELECT entity_id, v / (greatest(y1, y2) - y1 + 1) AS part, unnest(range(y1, greatest(y1, y2) + 1)) AS y FROM s)
SELECT entity_id, CAST(y AS BIGINT) AS fiscal_year, round(sum(part), 6) AS amount FROM e GROUP BY 1, 2""")
def prorated_receipts(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    ref = F.concat(F.lit("d|"), k.cast("string"))
    grants = t.orders.select((F.col("o_custkey") % 97).alias("recipient_entity_id"), F.col("o_totalprice").cast("double").alias("amount_cad"), F.when(k % 3 != 0, ref).alias("source_ref"))
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("l_shipdate")).join(t.orders.select("o_orderkey", "o_orderdate"), "o_orderkey")
    agreements = lines.select(ref.alias("source_ref"), F.col("o_orderdate").cast("date").alias("start_date"), F.col("l_shipdate").cast("date").alias("end_date"))
    return longs(search.prorated_by_year(grants, agreements), "fiscal_year").withColumn("amount", F.round("amount", 6))


@query("""WITH w AS (SELECT o_orderkey AS id, o_custkey AS k, CAST(o_totalprice AS DOUBLE) AS v FROM orders), r AS (SELECT o_orderkey AS receipt_id, o_custkey AS k, o_totalprice + CASE WHEN o_orderkey % 7 = 0 THEN 5 ELSE 0.004 END AS v FROM orders
  UNION ALL SELECT -o_orderkey, o_custkey, o_totalprice - 0.003 FROM orders WHERE o_orderkey % 5 = 0),
m AS (SELECT id, count(receipt_id) AS n, min(receipt_id) AS receipt_id FROM w LEFT JOIN r ON w.k = r.k AND abs(w.v - r.v) <= 0.01 GROUP BY 1)
SELECT id, CASE WHEN n = 1 THEN receipt_id END AS receipt_id, CASE n WHEN 1 THEN 'found' WHEN 0 THEN 'no match' ELSE 'ambiguous' END AS reason FROM m""")
def unique_receipt(t: Tables) -> DataFrame:
    k, v = F.col("o_orderkey"), F.col("o_totalprice").cast("double")
    wanted = t.orders.select(k.alias("id"), F.col("o_custkey").alias("key"), v.alias("amount"))
    receipts = t.orders.select(k.alias("receipt_id"), F.col("o_custkey").alias("key"), (v + F.when(k % 7 == 0, 5.0).otherwise(0.004)).alias("amount"))
    receipts = receipts.unionByName(t.orders.where("o_orderkey % 5 = 0").select((-k).alias("receipt_id"), F.col("o_custkey").alias("key"), (v - 0.003).alias("amount")))
    return search.locate_receipts(wanted, receipts, ["key"])


@query(f"""WITH {_ENT}, h AS (SELECT doc_id, source, doc_id % 25 + 100 AS f, doc_id % 7 + 100 AS r, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents)
SELECT doc_id, source, substr(sha256(x), 1, 16) AS text_id, a.canonical_name AS funder_name, b.canonical_name AS recipient_name FROM h JOIN ent a ON a.entity_id = f JOIN ent b ON b.entity_id = r WHERE x <> ''""")
def grants_for_text(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    grants = t.documents.select("doc_id", "source", (k % 25 + 100).alias("funder_entity_id"), (k % 7 + 100).alias("recipient_entity_id"), F.col("text").alias("description"))
    return search.grants_of_text(grants, _entities(t)).select("doc_id", "source", "text_id", "funder_name", "recipient_name")


@query("""WITH h AS (SELECT doc_id, substr(sha256(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 1, 16) AS text_id FROM documents) SELECT doc_id, text_id FROM h WHERE text_id = (SELECT text_id FROM h WHERE doc_id = (SELECT min(doc_id) FROM documents WHERE trim(text) <> ''))""")
def grants_of_one_text(t: Tables) -> DataFrame:
    one = t.documents.where("trim(text) <> ''").agg(F.min_by(search.text_id(F.col("text")), "doc_id")).first()[0]
    grants = t.documents.select("doc_id", F.lit(100).cast("long").alias("funder_entity_id"), F.lit(101).cast("long").alias("recipient_entity_id"), F.col("text").alias("description"))
    return search.grants_of_text(grants, _entities(t), one).select("doc_id", "text_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice > 400000 ORDER BY o_orderkey LIMIT 30")
def read_only_sql(t: Tables) -> DataFrame:
    t.orders.createOrReplaceTempView("gateway_orders")
    return search.read_only(t.spark, "select o_orderkey, o_custkey from gateway_orders where o_totalprice > 400000 order by o_orderkey;", cap=30)[0]


# --- sources as records ---------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT c_custkey AS k, c_nationkey AS n, CAST(c_acctbal AS DECIMAL(18,2)) AS v FROM customer)
SELECT CAST(k AS BIGINT) AS row_ord, 'Gallery ' || k AS name, CASE n % 2 WHEN 0 THEN 'ON' ELSE 'QC' END AS province, k % 3 = 0 AS allow_fuzzy, CAST(v AS DOUBLE) AS amount_cad, CAST(2000 + k % 20 AS BIGINT) AS fiscal_year, 'P' || (k % 4) AS program_name FROM r WHERE k % 5 <> 0""")
def council_records(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    raw = t.customer.select(
        k.alias("row_ord"), F.concat(F.lit("Gallery "), k.cast("string")).alias("recipient_name"), F.when(k % 5 == 0, " Individual ").when(k % 3 == 0, "Organization").otherwise("Group").alias("recipient_type"), F.when(F.col("c_nationkey") % 2 == 0, "ON").otherwise("QC").alias("province"),
        money(F.col("c_acctbal")).cast("string").alias("amount"), F.concat((k % 20 + 2000).cast("string"), F.lit("-"), (k % 20 + 2001).cast("string")).alias("fiscal_year"), F.concat(F.lit("P"), (k % 4).cast("string")).alias("program"),
    )
    return longs(resolve.council_records(raw).select("row_ord", "name", "province", "allow_fuzzy", "amount_cad", "fiscal_year", "program_name"), "row_ord", "fiscal_year")


@query("""SELECT CAST(o_orderkey AS BIGINT) AS row_ord, 'Donee ' || o_custkey AS name, CASE WHEN o_orderkey % 4 <> 0 THEN lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS bn, 'ON' AS province, true AS allow_fuzzy, lpad(CAST(o_custkey % 50 AS VARCHAR), 9, '2') AS funder_key,
  CASE WHEN o_orderkey % 6 <> 0 THEN CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS amount_cad, CAST(year(o_orderdate) AS BIGINT) AS fiscal_year FROM orders""")
def donee_records(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    raw = t.orders.select(
        k.alias("row_ord"), F.concat(F.lit("Donee "), F.col("o_custkey").cast("string")).alias("Donee Name"), F.when(k % 4 != 0, F.lpad(F.col("o_custkey").cast("string"), 9, "0")).alias("Donee BN"), F.lit("ON").alias("Province"),
        F.concat(F.lpad((F.col("o_custkey") % 50).cast("string"), 9, "2"), F.lit("RR0001")).alias("BN"), F.when(k % 6 == 0, "unknown").otherwise(F.format_number("o_totalprice", 2)).alias("Total Gifts"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("FPE"),
    )
    return longs(resolve.donee_records(raw).select("row_ord", "name", resolve_bn("bn"), "province", "allow_fuzzy", "funder_key", "amount_cad", "fiscal_year"), "row_ord", "fiscal_year")


def resolve_bn(column: str) -> Column:
    return expr.normalize_bn(F.col(column)).alias(column)


@query("""SELECT CAST(c_custkey AS BIGINT) AS row_ord, CASE WHEN c_custkey % 3 = 1 THEN 'Grant Receiver ' || c_custkey ELSE 'Society,  Inc' END AS name, lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS funder_key,
  CAST(c_custkey % 100 + CASE WHEN c_custkey % 2 = 0 THEN 0.5 ELSE 0 END AS DOUBLE) AS amount_cad, CAST(2019 AS BIGINT) AS fiscal_year FROM customer WHERE c_custkey % 3 <> 0""")
def other_donee_records(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    raw = t.customer.select(
        k.alias("row_ord"), F.when(k % 3 == 0, "Jean-Luc  O'Neill (Jack)").when(k % 3 == 1, F.concat(F.lit("Grant Receiver "), k.cast("string"))).otherwise("Society,  Inc").alias("Recipient Name"), F.lpad(k.cast("string"), 9, "0").alias("BN"),
        (k % 100).cast("string").alias("Cash amount"), F.when(k % 2 == 0, "$0.50").otherwise("").alias("Non-cash amount"), F.lit("2019-12-31").alias("FPE"),
    )
    return longs(resolve.other_donee_records(raw).select("row_ord", "name", "funder_key", "amount_cad", "fiscal_year"), "row_ord", "fiscal_year")


@query("""SELECT CAST(c_custkey AS BIGINT) AS row_ord, CASE WHEN c_custkey % 4 < 2 THEN lpad(CAST(c_custkey AS VARCHAR), 9, '0') END AS bn, '108091091' AS funder_key, 'ON' AS province,
  CASE WHEN c_custkey % 7 <> 0 THEN CAST(greatest(0, c_custkey % 50 - CASE WHEN c_custkey % 5 = 0 THEN 20 ELSE 0 END) AS DOUBLE) END AS amount_cad, CASE WHEN c_custkey % 11 <> 0 THEN CAST(2010 + c_custkey % 9 AS BIGINT) END AS fiscal_year FROM customer""")
def foundation_records(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    number = F.lpad(k.cast("string"), 9, "0")
    raw = t.customer.select(
        k.alias("row_ord"), F.col("c_name").alias("organization_name"), F.when(k % 4 == 0, F.concat(number, F.lit("RR0001 "))).when(k % 4 == 1, number).when(k % 4 == 2, F.concat(number, F.lit("RR01"))).otherwise("n/a").alias("charitable_registration_number"),
        F.when(k % 7 != 0, (k % 50).cast("string")).alias("amount_awarded"), F.when(k % 5 == 0, "20").alias("amount_rescinded"), F.when(k % 11 == 0, "unknown").otherwise(F.concat((k % 9 + 2010).cast("string"), F.lit("-11"))).alias("fiscal_year"), F.lit("Seed").alias("grant_program"), F.lit("d").alias("description"),
    )
    return longs(resolve.foundation_records(raw).select("row_ord", "bn", "funder_key", "province", "amount_cad", "fiscal_year"), "row_ord", "fiscal_year")


# --- marts and merges -----------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 5 DESC, o_orderkey % 10000) AS rn, lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS tail FROM orders)
SELECT c_custkey AS entity_id, CASE WHEN tail IS NOT NULL THEN lpad(CAST(c_custkey AS VARCHAR), 9, '0') || 'RR' || tail END AS bn_full FROM customer LEFT JOIN l ON l.k = c_custkey AND rn = 1""")
def backfilled_number(t: Tables) -> DataFrame:
    own = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    idents = t.orders.select(F.concat(own, F.lit("RR"), F.lpad((F.col("o_orderkey") % 10_000).cast("string"), 4, "0")).alias("bn"), (F.col("o_orderkey") % 5 + 2000).alias("source_year"))
    ents = t.customer.select(F.col("c_custkey").alias("entity_id"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("bn_root"))
    return marts.backfilled_number(ents, idents).select("entity_id", "bn_full")


@query("""WITH l AS (SELECT o_custkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS v, year(o_orderdate) AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 4 DESC, o_orderdate DESC, o_orderkey % 10000) AS rn FROM orders)
SELECT k AS entity_id, CAST(y AS BIGINT) AS fiscal_year, CAST(v AS DOUBLE) AS donations FROM l WHERE rn = 1""")
def latest_financials(t: Tables) -> DataFrame:
    key = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    suffix = F.lpad((F.col("o_orderkey") % 10_000).cast("string"), 4, "0")
    filings = t.orders.select(F.concat(key, F.lit("RR"), suffix).alias("BN"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("FPE"), money(F.col("o_totalprice")).cast("string").alias("4500"), (F.col("o_orderkey") % 4 + 2000).alias("source_year"))
    ents = t.customer.select(F.col("c_custkey").alias("entity_id"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("bn_root"))
    return longs(marts.latest_financials(ents, filings).select("entity_id", "fiscal_year", "donations"), "fiscal_year")


@query("SELECT p_partkey AS entity_id, 'ecole ' || lower(p_name) AS search_name FROM part")
def search_names(t: Tables) -> DataFrame:
    ents = t.part.select(F.col("p_partkey").alias("entity_id"), F.concat(F.lit(" École\t "), F.col("p_name")).alias("canonical_name"))
    return marts.with_search_name(ents).select("entity_id", "search_name")


@query("""WITH e AS (SELECT c_custkey AS entity_id, lpad(CAST(c_custkey % 5000 AS VARCHAR), 9, '0') AS bn, md5(CAST(c_custkey % 50 AS VARCHAR)) AS name FROM customer),
p AS (SELECT a.entity_id AS a, b.entity_id AS b, CASE WHEN hamming(a.bn, b.bn) = 1 THEN 'substitution' ELSE 'insertion_deletion' END AS edit FROM e a JOIN e b ON a.name = b.name AND a.entity_id < b.entity_id
  WHERE hamming(a.bn, b.bn) = 1 OR a.bn <> b.bn AND (substr(a.bn, 1, 8) = substr(b.bn, 2, 8) OR substr(a.bn, 2, 8) = substr(b.bn, 1, 8)))
SELECT a, b, edit, CAST(100 AS DOUBLE) AS score, CAST(10 * (a % 7 + b % 7) AS DOUBLE) AS combined_flow FROM p""")
def near_miss_numbers(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    ents = t.customer.select(k.alias("entity_id"), F.lpad((k % 5000).cast("string"), 9, "0").alias("bn_root"), F.md5((k % 50).cast("string")).alias("canonical_name"))
    roles = t.customer.select(k.alias("entity_id"), (k % 7 * 10).cast("double").alias("total_given"), F.lit(None).cast("double").alias("total_received"))
    return merges.near_miss_numbers(ents, roles).select("a", "b", "edit", "score", "combined_flow")


_PAIRS = "pairs AS (SELECT c_custkey AS m, c_custkey - c_custkey % 10 AS k FROM customer WHERE c_custkey % 10 IN (1, 2) AND c_custkey >= 10)"


def _pairs(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.where((k % 10).isin(1, 2) & (k >= 10)).select((k - 1).alias("keep"), k.alias("merge"))


@query(f"""WITH {_PAIRS}, e AS (SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT m FROM pairs)), x AS (SELECT coalesce(k, o_custkey) AS f, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders LEFT JOIN pairs ON m = o_custkey)
SELECT 'entities' AS part, count(*) AS n, CAST(sum(id) AS DOUBLE) AS total FROM e UNION ALL SELECT 'grants', count(DISTINCT f), CAST(sum(v) AS DOUBLE) FROM x UNION ALL SELECT 'links', count(DISTINCT coalesce(k, c_custkey)), CAST(sum(coalesce(k, c_custkey)) AS DOUBLE) FROM customer LEFT JOIN pairs ON m = c_custkey""")
def applied_merges(t: Tables) -> DataFrame:
    ents = t.customer.select(F.col("c_custkey").alias("entity_id"))
    grants = t.orders.select(F.col("o_custkey").alias("funder_entity_id"), F.col("o_custkey").alias("recipient_entity_id"), money(F.col("o_totalprice")).alias("amount_cad"))
    e, k, g = merges.apply_merges(ents, ents, grants, _pairs(t))
    out = e.agg(F.lit("entities").alias("part"), F.count("*").alias("n"), F.sum("entity_id").cast("double").alias("total"))
    out = out.unionByName(g.agg(F.lit("grants").alias("part"), F.countDistinct("funder_entity_id").alias("n"), F.sum("amount_cad").cast("double").alias("total")))
    return out.unionByName(k.agg(F.lit("links").alias("part"), F.countDistinct("entity_id").alias("n"), F.sum("entity_id").cast("double").alias("total")))


@query(f"""WITH {_PAIRS} SELECT m AS "merge", k AS keep, CAST(2 * sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS dollars FROM orders JOIN pairs ON m = o_custkey GROUP BY 1, 2 ORDER BY dollars DESC, m LIMIT 20""")
def dollars_moved(t: Tables) -> DataFrame:
    grants = t.orders.select(F.col("o_custkey").alias("funder_entity_id"), F.col("o_custkey").alias("recipient_entity_id"), money(F.col("o_totalprice")).alias("amount_cad"))
    return doubles(merges.dollars_moved(grants, _pairs(t)), "dollars")


@query("SELECT count(*) AS n, count(DISTINCT c_custkey) AS distinct_rows FROM (SELECT c_custkey FROM customer LIMIT 40)")
def sampled_rows(t: Tables) -> DataFrame:
    """Which rows a sample by hash holds is not for SQL to say; how many, and that none comes twice, is."""
    return marts.sample(t.customer, "c_custkey", 40).agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("distinct_rows"))


@query(f"""WITH {FLOWS}, p AS (SELECT funder, recipient, CAST(sum(amount) AS DOUBLE) AS amount FROM flows WHERE funder <> recipient GROUP BY 1, 2),
t AS (SELECT CAST(recipient AS VARCHAR) AS node, sum(amount) AS total FROM p GROUP BY 1)
SELECT CAST(node AS VARCHAR) AS node, round(total, 2) AS total, round(total * (100.0 - 6 * ((SELECT count(*) FROM t) - 1)) / (SELECT sum(total) FROM t), 6) AS height,
  round(coalesce(sum(total) OVER (ORDER BY total DESC, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * (100.0 - 6 * ((SELECT count(*) FROM t) - 1)) / (SELECT sum(total) FROM t) + 6 * (row_number() OVER (ORDER BY total DESC, node) - 1), 6) AS top FROM t""")
def sankey_layout(t: Tables) -> DataFrame:
    pairs = t.flows().where("funder <> recipient").groupBy("funder", "recipient").agg(F.sum("amount").cast("double").alias("amount"))
    network = pairs.select(F.col("recipient").alias("intermediary"), F.lit("in").alias("side"), F.col("funder").cast("string").alias("partner"), "amount")
    out = flow.sankey_layout(network, 100.0).where("col = 1").select("node", F.round("total", 2).alias("total"), "height", "top")
    return rounded(out, "height", "top")


@query(f"""WITH {FLOWS}, d AS (SELECT funder, recipient, CAST(sum(amount) AS DOUBLE) AS v FROM flows GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY funder ORDER BY v DESC, CAST(recipient AS VARCHAR)) AS rn FROM d) SELECT funder, recipient, round(v, 2) AS v FROM r WHERE rn <= 3""")
def largest_edges(t: Tables) -> DataFrame:
    d = t.flows().groupBy(F.col("funder").alias("intermediary_bn_root"), F.col("recipient")).agg(F.sum("amount").cast("double").alias("hop2_amount")).withColumn("donee_raw_name", F.col("recipient").cast("string"))
    return flow.largest_edges(d).select(F.col("intermediary_bn_root").alias("funder"), "recipient", F.round("hop2_amount", 2).alias("v"))


_FILINGS = """l AS (SELECT o_custkey AS k, year(o_orderdate) AS y, CAST(o_totalprice AS DECIMAL(18,2)) AS v, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderkey % 4 DESC, o_orderkey % 10000, o_totalprice DESC) AS rn FROM orders)"""


@query(f"WITH {_FILINGS} SELECT lpad(CAST(k AS VARCHAR), 9, '0') AS bn_root, CAST(y AS BIGINT) AS fiscal_year, CAST(v AS DOUBLE) AS donations FROM l WHERE rn = 1")
def donations_panel(t: Tables) -> DataFrame:
    filings = t.orders.select(F.concat(F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("RR"), F.lpad((F.col("o_orderkey") % 10_000).cast("string"), 4, "0")).alias("BN"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("FPE"), money(F.col("o_totalprice")).cast("string").alias("4500"), (F.col("o_orderkey") % 4 + 2000).alias("source_year"))
    return longs(study.donations_panel(filings), "fiscal_year")


@query("""SELECT lpad(CAST(c_custkey % 400 AS VARCHAR), 9, '0') AS bn_root, arg_min('P' || c_nationkey, c_custkey) AS province FROM customer GROUP BY 1""")
def unit_provinces(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return study.unit_provinces(t.customer.select(k.alias("entity_id"), F.lpad((k % 400).cast("string"), 9, "0").alias("bn_root"), F.concat(F.lit("P"), F.col("c_nationkey").cast("string")).alias("province")))


@query(f"""WITH {FLOWS}, {_ENT}, g AS (SELECT recipient + 100 AS entity_id, 'received' AS direction, funder AS other, source, amount FROM flows UNION ALL SELECT funder, 'given', recipient + 100, source, amount FROM flows)
SELECT g.entity_id, direction, canonical_name AS other_name, source AS source_dataset, count(*) AS n, round(CAST(sum(amount) AS DOUBLE), 2) AS amount FROM g JOIN ent ON ent.entity_id = other GROUP BY 1, 2, 3, 4""")
def grants_by_direction(t: Tables) -> DataFrame:
    out = search.grants_by_direction(_grants(t), _entities(t))
    return out.groupBy("entity_id", "direction", "other_name", "source_dataset").agg(F.count("*").alias("n"), F.round(F.sum("amount_cad"), 2).alias("amount"))


@query(f"""WITH {_ROLES}, {_ENT}, fin AS (SELECT c_nationkey + 100 AS entity_id, sum(CAST(c_acctbal AS DECIMAL(18,2))) AS v FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1)
SELECT ent.entity_id, canonical_name, round(coalesce(total_given, 0), 2) AS total_given, CASE WHEN roles.entity_id IS NULL THEN 'no_flows' WHEN total_given / (total_given + total_received) >= 0.9 THEN 'primarily_funder' WHEN total_given / (total_given + total_received) <= 0.1 THEN 'primarily_recipient' ELSE 'dual_role' END AS role, CAST(v AS DOUBLE) AS total_revenue
FROM ent LEFT JOIN roles ON roles.entity_id = ent.entity_id LEFT JOIN fin ON fin.entity_id = ent.entity_id""")
def entity_profiles(t: Tables) -> DataFrame:
    n = F.col("c_nationkey")
    fin = t.customer.groupBy(F.when(n % 2 == 0, n + 100).alias("entity_id")).agg(F.sum(money(F.col("c_acctbal"))).cast("double").alias("total_revenue"))
    return search.profiles(_entities(t), _roles(t), fin).select("entity_id", "canonical_name", F.round("total_given", 2).alias("total_given"), "role", "total_revenue")


@query("""WITH r AS (SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'exact' WHEN 1 THEN '12345' WHEN 2 THEN 'abc' ELSE '' END AS bn FROM customer),
known AS (SELECT count(*) AS n FROM customer WHERE c_custkey % 4 = 0 AND c_custkey IN (SELECT s_suppkey FROM supplier))
SELECT 'match_method' AS metric, 'exact_bn' AS "key", n FROM known WHERE n > 0 UNION ALL SELECT 'match_method', 'unmatched_new', (SELECT count(*) FROM customer) - n FROM known UNION ALL SELECT 'digit_gate_reject', 'all', 0
UNION ALL SELECT 'bn_reject', CASE bn WHEN '12345' THEN '5 digits' ELSE 'non-numeric' END, count(*) FROM r WHERE bn IN ('12345', 'abc') GROUP BY 2""")
def resolution_metrics(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    s = t.supplier
    idents = s.select(F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("bn"), F.col("s_name").alias("name"), F.lit("c").alias("city"), F.lit("ON").alias("province"), F.lit(2020).alias("source_year"), F.col("s_suppkey").alias("ord"))
    # Numbers of nine digits that no supplier has are each of one record, so that they make entities and match none.
    number = F.when(k % 4 == 0, F.lpad(k.cast("string"), 9, "0")).when(k % 4 == 1, "12345").when(k % 4 == 2, "abc").otherwise(" ")
    records = t.customer.select(k.alias("ord"), F.lit("s").alias("source_dataset"), F.concat(F.lit("Club "), k.cast("string")).alias("name"), number.alias("bn"), F.lit("ON").alias("province"), F.lit(False).alias("allow_fuzzy"))
    return resolve.resolve(idents, t.nation.select(F.col("n_name").alias("code"), F.col("n_name").alias("title")), records).metrics


@query(f"""WITH {_MATCHED} SELECT 'treated' AS arm, count(*) AS n FROM tr UNION ALL SELECT 'control', count(*) FROM matches""")
def saved_panel(t: Tables) -> DataFrame:
    """The study's table, written and read back."""
    from ..session import scratch
    from ..sources import readers, sinks

    treated, controls = _cohorts(t)
    stats = study.window_stats(treated.select("bn_root", "Y"), t.donations())
    path = scratch(t.spark, "study-panel")
    sinks.save_table(study.panel(treated, study.match_controls(treated, controls), controls, stats, treated.limit(0).select("bn_root", "Y")), path, ["arm"])
    return readers.curated(t.spark, path).groupBy("arm").agg(F.count("*").alias("n"))
