"""Readers and writers over files that are rendered from the driver's tables, and the profiler's tables."""

from __future__ import annotations

from importlib.util import find_spec

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality
from ..session import scratch
from ..sources import readers, sinks
from .base import Tables, doubles, longs, query
from .reports import _RAW, _raw


def _lines(df: DataFrame, header: str, t: Tables, name: str, parts: int = 1) -> str:
    """The folder of a CSV file whose lines (a column ``value``) are written as they are."""
    path = scratch(t.spark, name)
    head = t.spark.createDataFrame([(0, header)], "o int, value string")
    rows = head.unionByName(df.select(F.lit(1).alias("o"), "value")).repartition(parts).sortWithinPartitions("o") if parts > 1 else head.unionByName(df.select(F.lit(1).alias("o"), "value")).coalesce(1).sortWithinPartitions("o")
    rows.select("value").write.text(path)
    return path


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, CASE c_custkey % 4 WHEN 0 THEN 'say "' || c_name || '", twice' WHEN 1 THEN c_name || chr(10) || 'second line' WHEN 2 THEN NULL ELSE 'é, ' || c_mktsegment END AS name FROM customer""")
def csv_round_trip(t: Tables) -> DataFrame:
    """Quotes, separators, line ends and nulls survive being written and read."""
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.concat(F.lit('say "'), "c_name", F.lit('", twice'))).when(k % 4 == 1, F.concat("c_name", F.lit("\nsecond line"))).when(k % 4 == 3, F.concat(F.lit("é, "), "c_mktsegment"))
    path = scratch(t.spark, "csv")
    sinks.save_csv(t.customer.select(k.cast("string").alias("id"), name.alias("name")), path)
    return readers.csv_strings(t.spark, path)


@query("""SELECT CAST(year(o_orderdate) AS BIGINT) AS source_year, count(*) AS n, count(CASE WHEN year(o_orderdate) >= 1997 THEN o_orderpriority END) AS later, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1""")
def yearly_files(t: Tables) -> DataFrame:
    """One file a year; a column exists from 1997 on only."""
    folder, paths = scratch(t.spark, "years"), []
    for (y,) in sorted(t.orders.select(F.year("o_orderdate")).distinct().collect()):  # a row for each year
        rows = t.orders.where(F.year("o_orderdate") == y)
        names = ["o_orderkey", "o_orderpriority"] if y >= 1997 else ["o_orderkey"]
        rows.select(*names).write.option("header", True).csv(f"{folder}/filing_{y}.csv")
        paths.append(f"{folder}/filing_{y}.csv")
    every = readers.yearly_csv(t.spark, paths, r"filing_(\d{4})\.csv")
    out = every.groupBy("source_year").agg(F.count("*").alias("n"), F.count("o_orderpriority").alias("later"), F.sum(F.col("o_orderkey").cast("long")).alias("keys"))
    return longs(out, "source_year")


@query("""WITH c AS (SELECT count(*) FILTER (c_custkey % 7 <> 3) AS kept, count(*) FILTER (c_custkey % 7 = 3) AS rejected, CAST(sum(c_custkey) FILTER (c_custkey % 7 <> 3) AS BIGINT) AS keys FROM customer) SELECT * FROM c""")
def csv_rejects(t: Tables) -> DataFrame:
    """Rows with a field too many are counted and kept out; a line end in quotes is none of them."""
    k = F.col("c_custkey").cast("string")
    lines = F.when(F.col("c_custkey") % 7 == 3, F.concat(k, F.lit(",a,b"))).when(F.col("c_custkey") % 7 == 1, F.concat(k, F.lit(',"two\nlines"'))).otherwise(F.concat(k, F.lit(",plain")))
    good, counts = readers.csv_with_rejects(t.spark, _lines(t.customer.select(lines.alias("value")), "id,name", t, "rejects"))
    return good.agg(F.count("*").alias("kept"), F.sum(F.col("id").cast("long")).alias("keys")).crossJoin(counts.agg(F.sum("rejected").alias("rejected")))


@query("SELECT r_regionkey AS key, r_name AS label, CASE r_regionkey WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'many' END AS word FROM region")
def renamed_and_inline(t: Tables) -> DataFrame:
    words = readers.inline(t.spark, [(0, "zero"), (1, "one")], "key long, word string")
    own = readers.renamed(t.region, ["key", "label"])
    return own.withColumn("key", F.col("key").cast("long")).join(words, "key", "left").withColumn("word", F.coalesce("word", F.lit("many")))


@query("""WITH x AS (SELECT c_custkey AS k FROM customer) SELECT CAST(k AS VARCHAR) AS source_id, 'Amis ' || k AS legal_name, CASE WHEN k % 3 = 0 THEN 'A' || k || ';B' || k ELSE '' END AS trade_names, CASE WHEN k % 4 = 0 THEN 'Montréal' ELSE 'Laval' END AS city,
  CASE WHEN k % 5 <> 0 THEN 'H2X' || (k % 9) || 'Y4' END AS postal FROM x WHERE k % 2 = 0 AND (k % 4 = 0 OR k % 5 <> 0)""")
def provincial_registry(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    key = k.cast("string").alias("NEQ")
    companies = t.customer.select(
        key, F.when(k % 2 == 0, "APE ").otherwise("ASS").alias("COD_FORME_JURI"), F.lit("IM").alias("COD_STAT_IMMAT"), F.lit("1 rue A").alias("ADR_DOMCL_LIGN1_ADR"), F.lit(" ").alias("ADR_DOMCL_LIGN2_ADR"), F.when(k % 4 == 0, "Montréal (Québec)").otherwise("Laval QC").alias("ADR_DOMCL_LIGN3_ADR"),
        F.when(k % 5 != 0, F.concat(F.lit("h2x "), (k % 9).cast("string"), F.lit("y4"))).alias("ADR_DOMCL_LIGN4_ADR"),
    )
    name = lambda kind, x, status="V": F.struct(F.lit(kind).alias("TYP_NOM_ASSUJ"), F.concat(F.lit(x), k.cast("string")).alias("NOM_ASSUJ"), F.lit(status).alias("STAT_NOM"))
    every = F.when(k % 3 == 0, F.array(name("N", "Amis "), name("A", "A"), name("A", "B"), name("N", "Old ", "A"))).otherwise(F.array(name("N", "Amis ")))
    names = t.customer.select(key, F.explode(every).alias("x")).select("NEQ", "x.*")
    out = readers.provincial_registry(companies, names)
    return out.select("source_id", "legal_name", F.concat_ws(";", "trade_names").alias("trade_names"), "city", "postal")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS source_id, CASE WHEN s_suppkey % 3 = 0 THEN 'Deux ' || s_suppkey ELSE s_name END AS legal_name, CASE WHEN s_suppkey % 3 = 1 THEN 'Deux ' || s_suppkey ELSE '' END AS trade_names, lpad(CAST(s_suppkey AS VARCHAR), 9, '7') AS bn FROM supplier WHERE s_suppkey % 2 = 0""")
def federal_registry(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    rows = t.supplier.select(
        k.cast("string").alias("Corporation number"), F.when(k % 3 != 0, F.col("s_name")).otherwise(" ").alias("Corporate name - form 1"), F.when(k % 3 != 2, F.concat(F.lit("Deux "), k.cast("string"))).alias("Corporate name - form 2"),
        F.when(k % 2 == 0, " Canada Not-for-profit Corporations Act ").otherwise("Another act").alias("Governing legislation"), F.lit("1 Main").alias("Street"), F.lit("Ottawa").alias("City/town"), F.lit("k1a 0a1").alias("Postal code"), F.concat(F.lpad(k.cast("string"), 9, "7"), F.lit(" RC0001")).alias("Business number (BN)"), F.lit("ON").alias("Province/territory"),
    )
    return readers.federal_registry(rows).select("source_id", "legal_name", F.concat_ws(";", "trade_names").alias("trade_names"), "bn")


@query("""WITH x AS (SELECT c_custkey AS k FROM customer) SELECT lpad(CAST(k AS VARCHAR), 9, '0') AS cand_id, CASE WHEN k % 3 = 0 THEN 'new' ELSE 'old' END AS cand_name, CASE WHEN k % 3 = 0 THEN 'active' ELSE 'revoked_or_inactive' END AS registry_status, 2 * k AS ord FROM x WHERE k % 4 = 0""")
def charity_registry(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    versions = F.explode(F.when(k % 3 == 0, F.array(F.lit(2022), F.lit(2023))).otherwise(F.array(F.lit(2022)))).alias("source_year")
    rows = t.customer.select(k, versions)
    idents = rows.select(F.concat(F.lpad(k.cast("string"), 9, "0"), F.lit("RR0001")).alias("bn"), F.when(F.col("source_year") == 2023, "new").otherwise("old").alias("name"), F.lit("c").alias("city"), F.when(k % 4 == 0, " qc").otherwise("ON").alias("province"), F.lit("H2X1Y4").alias("postal"), "source_year", (2 * k + F.col("source_year") - 2022).alias("ord"))
    return readers.charity_registry(idents).select("cand_id", "cand_name", "registry_status", "ord")


@query("SELECT CAST(c_custkey AS BIGINT) AS keep, CAST(c_custkey + 1 AS BIGINT) AS \"merge\" FROM customer WHERE c_custkey % 9 = 4")
def merge_overrides(t: Tables) -> DataFrame:
    """A reviewed file: pairs, rows with a blank id, and a folder that isn't there."""
    k = F.col("c_custkey")
    line = F.concat_ws(",", F.when(k % 9 == 4, k.cast("string")).otherwise(""), (k + 1).cast("string"), F.lit("note"))
    path = _lines(t.customer.select(line.alias("value")), "entity_id_keep,entity_id_merge,note", t, "overrides")
    return readers.merge_overrides(t.spark, path).unionByName(readers.merge_overrides(t.spark, f"{path}-none"))


@query("""SELECT 'full' AS queue, count(*) AS n FROM customer UNION ALL SELECT 'charity', count(*) FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT 'grants', count(*) FROM customer WHERE c_custkey % 5 = 0""")
def review_queues(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    rows = t.customer.select(k.alias("source_id"), F.when(k % 3 == 0, "needs_review").otherwise("registered_charity").alias("charity_status"), F.when(k % 5 == 0, "needs_review").otherwise("no_match").alias("federal_grant_status"))
    folder = scratch(t.spark, "queues")
    names = {"full": "full", "charity_review": "charity", "grant_review": "grants"}
    sinks.discovery_outputs(rows, folder, names)
    parts = [readers.csv_strings(t.spark, f"{folder}/{n}").agg(F.lit(n).alias("queue"), F.count("*").alias("n")) for n in names.values()]
    return readers.union_by_name(parts)


@query("""SELECT doc_id AS k, CASE WHEN doc_id % 4 = 0 THEN 'new' ELSE 'old' END AS v FROM labels UNION ALL SELECT -doc_id - 1, 'new' FROM labels WHERE toxic = 1""")
def upserted_table(t: Tables) -> DataFrame:
    path, k = scratch(t.spark, "store"), F.col("doc_id")
    sinks.save_table(t.labels.select(k.alias("k"), F.lit("old").alias("v")), path)
    fresh = t.labels.where(k % 4 == 0).select(k.alias("k"), F.lit("new").alias("v")).unionByName(t.labels.where("toxic = 1").select((-k - 1).alias("k"), F.lit("new").alias("v")))
    sinks.upsert_table(path, t.spark.read.parquet(path), fresh, ["k"], scratch(t.spark, "staging"))
    return t.spark.read.parquet(path)


@query("SELECT CAST(year(o_orderdate) AS BIGINT) AS y, o_orderpriority AS p, count(*) AS n FROM orders WHERE year(o_orderdate) >= 1997 GROUP BY 1, 2")
def partitioned_table(t: Tables) -> DataFrame:
    """Written by year, read with the filter on the partitions."""
    path = scratch(t.spark, "by-year")
    sinks.save_table(t.orders.select(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("p")), path, ["y"])
    return longs(readers.curated(t.spark, path).where("y >= 1997").groupBy("y", "p").agg(F.count("*").alias("n")), "y")


@query("""SELECT '| r_regionkey | r_name |' AS line, 0 AS place UNION ALL SELECT '| - | - |', 1 UNION ALL SELECT '| ' || r_regionkey || ' | ' || r_name || ' |', CAST(2 + r_regionkey AS INTEGER) FROM region""")
def markdown_table(t: Tables) -> DataFrame:
    lines = quality.markdown(t.region.select("r_regionkey", "r_name").orderBy("r_regionkey")).split("\n")
    return t.spark.createDataFrame([(x.replace("|\n", "|"), i) for i, x in enumerate(lines)], "line string, place int")


# --- the profiler ---------------------------------------------------------------------------------------------------------

_LATEST = f"WITH {_RAW} "


@query(_LATEST + """SELECT 'money' AS part, count(value) AS n, round(CAST(sum(value) AS DOUBLE), 2) AS total FROM p UNION ALL SELECT 'unreadable', count(*) FILTER (value IS NULL), 0 FROM p
UNION ALL SELECT 'type ' || coalesce(rtype, ''), count(*), 0 FROM p GROUP BY rtype UNION ALL SELECT 'descriptions', count(desc_en), count(DISTINCT desc_en) FROM p UNION ALL SELECT 'no date', count(*) FILTER (sd IS NULL), 0 FROM p""")
def profiler(t: Tables) -> DataFrame:
    parts = quality.profile(_raw(t))
    zero = F.lit(0.0)
    line = lambda df, name, n, total: df.select(name.alias("part"), F.col(n).cast("long").alias("n"), total.cast("double").alias("total"))
    out = line(parts["money"], F.lit("money"), "n", F.round("total", 2))
    out = out.unionByName(line(parts["money"], F.lit("unreadable"), "unreadable", zero)).unionByName(line(parts["types"], F.concat(F.lit("type "), "value"), "n", zero))
    out = out.unionByName(line(parts["descriptions"], F.lit("descriptions"), "n", F.col("distinct")))
    return out.unionByName(line(parts["fiscal_years"].where("fy is null"), F.lit("no date"), "n", zero))


@query(_LATEST + """, m AS (SELECT dept, count(*) FILTER (sd >= TIMESTAMP '2025-12-01') AS n, count(*) FILTER (sd >= TIMESTAMP '2025-12-01' AND rtype IS NULL) AS r, count(*) FILTER (sd >= TIMESTAMP '2025-12-01' AND bn IS NULL) AS b FROM p GROUP BY 1)
SELECT dept, n AS post_dec_total, round(100.0 * (n - r)::DOUBLE / n, 6) AS pct_recipient_type, round(100.0 * (n - b)::DOUBLE / n, 6) AS pct_biz_num FROM m WHERE n > 0""")
def post_policy(t: Tables) -> DataFrame:
    out = quality.post_policy(quality.compliance(quality.parse_agreements(_raw(t))))
    return out.select("dept", "post_dec_total", F.round("pct_recipient_type", 6).alias("pct_recipient_type"), F.round("pct_biz_num", 6).alias("pct_biz_num"))


@query("SELECT n_name AS dept, CAST(40 + 2 * n_nationkey AS BIGINT) AS total FROM nation WHERE n_nationkey % 3 = 0 AND 40 + 2 * n_nationkey >= 50")
def exemplary_departments(t: Tables) -> DataFrame:
    k = F.col("n_nationkey")
    matrix = t.nation.select(F.col("n_name").alias("dept"), (k * 2 + 40).cast("long").alias("total"), (k % 3).alias("dirty_type"), *[F.lit(0).alias(c) for c in quality.ISSUES if c != "dirty_type"])
    return quality.exemplary(matrix)


@query(_LATEST + """SELECT dept, count(*) AS n, round(CAST(coalesce(sum(value), 0) AS DOUBLE), 2) AS dollars, round(100.0 * count(*) FILTER (desc_en IS NULL)::DOUBLE / count(*), 6) AS pct_nodesc FROM latest GROUP BY 1 HAVING count(*) >= 100""")
def dashboard_departments(t: Tables) -> DataFrame:
    out = quality.dashboard(_raw(t))["departments"]
    return out.select("dept", "n", F.round("dollars", 2).alias("dollars"), F.round("pct_nodesc", 6).alias("pct_nodesc"))


@query(_LATEST + """, b AS (SELECT dept, CAST(value AS DOUBLE) AS value FROM latest WHERE value IS NOT NULL ORDER BY value DESC, dept, ref LIMIT 5), m AS (SELECT ref FROM f WHERE a = 2 ORDER BY ref LIMIT 1)
SELECT 'biggest' AS part, dept AS name, value FROM b UNION ALL SELECT 'most amended', ref, 2 FROM m""")
def dashboard_records(t: Tables) -> DataFrame:
    d = quality.dashboard(_raw(t))
    a = d["biggest"].select(F.lit("biggest").alias("part"), F.col("dept").alias("name"), "value")
    return a.unionByName(d["most_amended"].select(F.lit("most amended").alias("part"), F.col("ref").alias("name"), F.col("amendment").cast("double").alias("value")))


@query(_LATEST + "SELECT ref, prov, round(CAST(value AS DOUBLE), 2) AS value FROM latest WHERE badprov AND value IS NOT NULL ORDER BY value DESC, ref LIMIT 10")
def fault_specimens(t: Tables) -> DataFrame:
    out = quality.specimens(_raw(t), F.col("badprov") & F.col("value").isNotNull(), [F.desc("value"), F.asc("ref")])
    return doubles(out.select("ref", "prov", F.round("value", 2).alias("value")), "value")


@query(_LATEST + """SELECT lower(trim(dept)) AS funder_key, ref AS reference, recipient AS name, prov AS province, count(*) AS n, round(CAST(coalesce(sum(value), 0) AS DOUBLE), 2) AS amount, count(*) FILTER (rtype = 'N' AND upper(country) = 'CA') AS fuzzy FROM p GROUP BY 1, 2, 3, 4""")
def federal_records(t: Tables) -> DataFrame:
    from ..operators import resolve

    rows = resolve.federal_records(_raw(t).withColumn("row_ord", F.lit(0)))
    out = rows.groupBy("funder_key", F.split_part("source_ref", F.lit("|"), F.lit(2)).alias("reference"), F.nullif(F.trim("name"), F.lit("")).alias("name"), "province")
    return out.agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("amount_cad"), F.lit(0.0)), 2).alias("amount"), F.count_if("allow_fuzzy").alias("fuzzy"))


#: The agreements with more kinds of faults: values, recipients, end dates and descriptions by key.
_ODD = _RAW.replace("raw AS (SELECT ' '", "raw0 AS (SELECT ' '").replace(
    "\np AS (SELECT trim",
    """
raw AS (SELECT * REPLACE (CASE WHEN k % 61 = 0 THEN '-' || (k % 1000 + 1) WHEN k % 67 = 0 THEN '3.50' WHEN k % 71 = 0 THEN '20,000,' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') ELSE agreement_value END AS agreement_value,
  CASE WHEN k % 73 = 0 THEN 'Batch Report | en lots' ELSE recipient_legal_name END AS recipient_legal_name, CASE WHEN k % 83 = 0 THEN ' ;- ' ELSE description_en END AS description_en), CASE WHEN k % 79 = 0 THEN '9999-12-31' END AS ed FROM raw0),
p AS (SELECT trim""",
)


def _odd(t: Tables) -> DataFrame:
    k = F.split_part("ref_number", F.lit("-"), F.lit(2)).cast("long")
    value = F.when(k % 61 == 0, F.concat(F.lit("-"), (k % 1000 + 1).cast("string"))).when(k % 67 == 0, "3.50").when(k % 71 == 0, F.concat(F.lit("20,000,"), F.lpad((k % 1000).cast("string"), 3, "0"))).otherwise(F.col("agreement_value"))
    return _raw(t).withColumns({
        "agreement_value": value, "recipient_legal_name": F.when(k % 73 == 0, "Batch Report | en lots").otherwise(F.col("recipient_legal_name")), "description_en": F.when(k % 83 == 0, " ;- ").otherwise(F.col("description_en")),
        "agreement_end_date": F.when(k % 79 == 0, "9999-12-31"),
    })


@query(f"""WITH {_ODD}, l AS (SELECT latest.*, raw.ed FROM latest JOIN raw USING (k, a)),
d AS (SELECT *, row_number() OVER (PARTITION BY sd_raw ORDER BY coalesce(value, 0) DESC, ref) AS rn FROM l WHERE baddate AND sd_raw IS NOT NULL), g AS (SELECT *, row_number() OVER (PARTITION BY prov ORDER BY coalesce(value, 0) DESC, ref) AS rn FROM l WHERE badprov)
SELECT category, dept, ref, recipient, CAST(value AS DOUBLE) AS value, note FROM (
  (SELECT 'nodesc' AS category, dept, ref, recipient, value, coalesce(desc_en, '(no description at all)') AS note FROM l WHERE value > 10000000 AND (desc_en IS NULL OR length(desc_en) < 15) ORDER BY value DESC, ref LIMIT 4)
  UNION ALL (SELECT 'neg', dept, ref, recipient, value, substr(coalesce(desc_en, ''), 1, 90) FROM l WHERE value < 0 ORDER BY value, ref LIMIT 3)
  UNION ALL (SELECT 'dates', dept, ref, recipient, value, sd_raw FROM d WHERE rn = 1 ORDER BY sd, ref LIMIT 4)
  UNION ALL (SELECT 'geo', dept, ref, recipient, value, 'province: ''' || prov || '''' FROM g WHERE rn = 1 ORDER BY coalesce(value, 0) DESC, ref LIMIT 4)
  UNION ALL (SELECT 'batch', dept, ref, recipient, value, '' FROM l WHERE recipient ILIKE '%batch report%' ORDER BY value DESC NULLS LAST, ref LIMIT 4)
  UNION ALL (SELECT 'amend', dept, ref, recipient, value, a || ' amendments' FROM l ORDER BY a DESC, ref LIMIT 4)
  UNION ALL (SELECT 'placeholder', dept, ref, recipient, value, sd_raw FROM l WHERE ed LIKE '9999%' ORDER BY value DESC NULLS LAST, ref LIMIT 4)
  UNION ALL (SELECT 'nominal', dept, ref, recipient, value, substr(coalesce(desc_en, ''), 1, 90) FROM l WHERE value > 0 AND value < 10 ORDER BY value, ref LIMIT 4)
  UNION ALL (SELECT 'punct', dept, ref, recipient, value, desc_en FROM l WHERE regexp_matches(desc_en, '^[^a-zA-Z0-9]+$') ORDER BY value DESC NULLS LAST, ref LIMIT 4))""")
def specimen_jar(t: Tables) -> DataFrame:
    return doubles(quality.specimen_jar(_odd(t)), "value")


@query(_LATEST + """, m AS (SELECT count(*) AS n, count(*) FILTER (trim(coalesce(recipient_legal_name, '')) = '') AS a, count(*) FILTER (recipient_business_number IS NULL) AS b, count(*) FILTER (amendment_number = '') AS c FROM raw)
SELECT 'recipient_legal_name' AS "column", 'mandatory' AS requirement, a AS missing FROM m UNION ALL SELECT 'recipient_business_number', 'conditional', b FROM m UNION ALL SELECT 'amendment_number', 'other', c FROM m UNION ALL SELECT 'prog_purpose_fr', 'conditional', n FROM m""")
def field_completeness(t: Tables) -> DataFrame:
    out = quality.field_completeness(_raw(t))
    return out.where(F.col("column").isin("recipient_legal_name", "recipient_business_number", "amendment_number", "prog_purpose_fr")).select("column", "requirement", "missing")


def evidence_entries(t: Tables) -> DataFrame:
    """Evidence entries of a YAML page (one for each region), their statuses, and whether they earn a page."""
    lines = []
    for r in sorted(t.region.collect()):  # a page
        k = r["r_regionkey"]
        status = ("verified_2024-01-02", "unverified", "editorial")[k % 3]
        comment = f"  # seen {k}" if k % 2 == 0 else ""
        lines.append(f"- id: {k}\n  name: {r['r_name']}\n  evidence:\n    - source: s{k}\n      status: {status}{comment}\n")
    found = readers.interventions(t.spark, "".join(lines))
    kinds = [(s, *readers.parse_status(s)) for (s,) in found.select("status").distinct().collect()]  # a few
    parsed = found.join(readers.inline(t.spark, kinds, "status string, kind string, day string"), "status")
    pages = quality.qualifying(found).withColumn("page", F.lit(True))
    return parsed.join(pages, "intervention_id", "left").select("intervention_id", "name", "source", "kind", "day", "comment", F.coalesce("page", F.lit(False)).alias("page"))


if find_spec("yaml"):
    query("""SELECT CAST(r_regionkey AS VARCHAR) AS intervention_id, r_name AS name, 's' || r_regionkey AS source, CASE r_regionkey % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'unverified' ELSE 'editorial' END AS kind, CASE WHEN r_regionkey % 3 = 0 THEN '2024-01-02' END AS day,
  CASE WHEN r_regionkey % 2 = 0 THEN 'seen ' || r_regionkey END AS comment, r_regionkey % 3 <> 1 AS page FROM region""")(evidence_entries)
