"""Data-quality reports over agreements rendered from orders: strings with faults, then parsed and judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import marts, quality, study, textclass
from .base import PANEL, Tables, doubles, longs, query

#: Agreements as text: three versions of a third of the orders, faults by key.
_RAW = """base AS (SELECT o_orderkey AS k, o_custkey, o_orderpriority, o_totalprice, o_orderdate, c_nationkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey),
v AS (SELECT *, 0 AS a FROM base UNION ALL SELECT *, 1 FROM base WHERE k % 3 = 0 UNION ALL SELECT *, 2 FROM base WHERE k % 3 = 0),
raw AS (SELECT ' ' || o_orderpriority || ' ' AS owner_org, 'R-' || k AS ref_number, CASE WHEN k % 17 = 0 AND a = 0 THEN '' ELSE CAST(a AS VARCHAR) || CASE WHEN k % 5 = 0 THEN '.0' ELSE '' END END AS amendment_number,
  CASE WHEN k % 23 = 0 THEN 'n/a' ELSE '$' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS agreement_value, CASE WHEN k % 29 = 0 THEN ' ' ELSE 'Org ' || o_custkey END AS recipient_legal_name,
  CASE WHEN k % 4 = 0 THEN NULL WHEN k % 31 = 0 THEN '12345' ELSE lpad(CAST(o_custkey AS VARCHAR), 9, '1') || 'RR0001' END AS recipient_business_number,
  CASE WHEN k % 7 = 0 THEN NULL WHEN k % 37 = 0 THEN 'Z' ELSE 'N' END AS recipient_type, CASE WHEN c_nationkey = 3 THEN 'Ontario' WHEN c_nationkey = 5 THEN 'NY' WHEN c_nationkey = 7 THEN NULL ELSE 'ON' END AS recipient_province,
  CASE WHEN c_nationkey = 11 THEN 'ca' WHEN c_nationkey = 13 THEN '' WHEN c_nationkey = 17 THEN 'CAN' ELSE 'CA' END AS recipient_country, CASE WHEN k % 7 = 0 THEN NULL WHEN k % 37 = 0 THEN 'X' ELSE 'G' END AS agreement_type,
  CASE WHEN k % 41 = 0 THEN '1899-12-30' WHEN k % 43 = 0 THEN NULL WHEN k % 47 = 0 THEN '2026-01-15' WHEN k % 53 = 0 THEN '1985-02-03' WHEN k % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS agreement_start_date,
  CASE WHEN k % 3 = 1 THEN '' WHEN k % 2 = 0 THEN repeat(c_mktsegment || ' ', 8) ELSE c_mktsegment END AS description_en, CASE WHEN k % 5 = 1 THEN NULL ELSE 'results' END AS expected_results_en, a, k FROM v),
p AS (SELECT trim(owner_org) AS dept, ref_number AS ref, nullif(trim(recipient_legal_name), '') AS recipient, nullif(recipient_business_number, '') AS bn, recipient_type AS rtype, agreement_type AS atype, recipient_province AS prov, nullif(recipient_country, '') AS country,
  TRY_CAST(replace(replace(agreement_value, '$', ''), ',', '') AS DECIMAL(18,2)) AS value, coalesce(try_strptime(agreement_start_date, '%Y-%m-%d'), try_strptime(agreement_start_date, '%d/%m/%Y')) AS sd,
  agreement_start_date AS sd_raw, nullif(trim(description_en), '') AS desc_en, expected_results_en AS results_en, a, k FROM raw),
f AS (SELECT *, coalesce(sd = TIMESTAMP '1899-12-30' OR sd < TIMESTAMP '1990-01-01' OR sd > TIMESTAMP '2026-12-31', false) AS baddate, prov IS NOT NULL AND prov NOT IN ('ON') AS badprov, country IS NOT NULL AND (country <> upper(country) OR length(country) <> 2) AS badcountry,
  atype IS NOT NULL AND atype NOT IN ('C', 'G', 'O') AS dirtytype, desc_en IS NOT NULL AND length(desc_en) < 50 AS short_desc, value IS NOT NULL AND value <= 0 AS zero_neg FROM p),
latest AS (SELECT * FROM f WHERE a = CASE WHEN k % 3 = 0 THEN 2 ELSE 0 END)"""


def _raw(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    k, a, null = F.col("o_orderkey"), F.col("a"), F.lit(None).cast("string")
    versions = F.explode(F.when(k % 3 == 0, F.array(F.lit(0), F.lit(1), F.lit(2))).otherwise(F.array(F.lit(0)))).alias("a")
    rows = t.orders.join(c, "o_custkey").select("*", versions)

    def case(*branches: tuple[Column, Column | str | None], otherwise: Column | str | None) -> Column:
        out = F
        for when, then in branches:
            out = out.when(when, then)
        return out.otherwise(otherwise)

    day = F.col("o_orderdate")
    return rows.select(
        F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("owner_org"), F.concat(F.lit("R-"), k.cast("string")).alias("ref_number"), case(((k % 17 == 0) & (a == 0), ""), otherwise=F.concat(a.cast("string"), F.when(k % 5 == 0, ".0").otherwise(""))).alias("amendment_number"),
        case((k % 23 == 0, "n/a"), otherwise=F.concat(F.lit("$"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))).alias("agreement_value"), case((k % 29 == 0, " "), otherwise=F.concat(F.lit("Org "), F.col("o_custkey").cast("string"))).alias("recipient_legal_name"),
        case((k % 4 == 0, None), (k % 31 == 0, "12345"), otherwise=F.concat(F.lpad(F.col("o_custkey").cast("string"), 9, "1"), F.lit("RR0001"))).alias("recipient_business_number"), case((k % 7 == 0, None), (k % 37 == 0, "Z"), otherwise="N").alias("recipient_type"),
        case((F.col("c_nationkey") == 3, "Ontario"), (F.col("c_nationkey") == 5, "NY"), (F.col("c_nationkey") == 7, None), otherwise="ON").alias("recipient_province"), case((F.col("c_nationkey") == 11, "ca"), (F.col("c_nationkey") == 13, ""), (F.col("c_nationkey") == 17, "CAN"), otherwise="CA").alias("recipient_country"), case((k % 7 == 0, None), (k % 37 == 0, "X"), otherwise="G").alias("agreement_type"), null.alias("recipient_city"), null.alias("recipient_postal_code"),
        case((k % 41 == 0, "1899-12-30"), (k % 43 == 0, None), (k % 47 == 0, "2026-01-15"), (k % 53 == 0, "1985-02-03"), (k % 2 == 0, F.date_format(day, "yyyy-MM-dd")), otherwise=F.date_format(day, "dd/MM/yyyy")).alias("agreement_start_date"), null.alias("agreement_end_date"), F.lit("P").alias("prog_name_en"), null.alias("agreement_title_en"),
        case((k % 3 == 1, ""), (k % 2 == 0, F.repeat(F.concat("c_mktsegment", F.lit(" ")), 8)), otherwise=F.col("c_mktsegment")).alias("description_en"), null.alias("description_fr"), case((k % 5 == 1, None), otherwise="results").alias("expected_results_en"),
    )


_AFTER = "sd >= TIMESTAMP '2025-12-01'"


@query(f"""WITH {_RAW} SELECT dept, count(*) AS total, CAST(coalesce(sum(value), 0) AS DOUBLE) AS value_sum, count(*) FILTER (desc_en IS NULL) AS missing_desc_en, count(*) AS missing_desc_fr, count(*) FILTER (dirtytype) AS dirty_type, count(*) FILTER (short_desc) AS short_desc, count(*) FILTER (zero_neg) AS zero_neg,
  count(*) FILTER ({_AFTER}) AS post_dec_total, count(*) FILTER ({_AFTER} AND rtype IS NULL) AS pd_recipient_type, count(*) FILTER ({_AFTER} AND bn IS NULL) AS pd_biz_num, count(*) FILTER ({_AFTER} AND results_en IS NULL) AS pd_exp_results FROM f GROUP BY 1""")
def agreement_compliance(t: Tables) -> DataFrame:
    p = quality.parse_agreements(_raw(t)).withColumn("value", F.col("value").cast("decimal(18,2)"))
    names = ("dept", "total", "value_sum", "missing_desc_en", "missing_desc_fr", "dirty_type", "short_desc", "zero_neg", "post_dec_total", "pd_recipient_type", "pd_biz_num", "pd_exp_results")
    return doubles(quality.compliance(p).select(*names), "value_sum")


_PCT = ("nodesc_en", "desc_en IS NULL"), ("nodesc_fr", "true"), ("short", "short_desc"), ("dirty", "dirtytype"), ("zeroneg", "zero_neg"), ("baddate", "baddate"), ("badgeo", "badprov OR badcountry"), ("nobn", "bn IS NULL")


@query(f"WITH {_RAW} SELECT dept, count(*) AS n, " + ", ".join(f"round(100.0 * count(*) FILTER ({c})::DOUBLE / count(*), 6) AS pct_{n}" for n, c in _PCT) + " FROM latest GROUP BY 1 HAVING count(*) >= 100")
def agreement_quality(t: Tables) -> DataFrame:
    out = quality.quality_by_department(_raw(t)).drop("title", "dollars")
    return out.withColumns({f"pct_{n}": F.round(f"pct_{n}", 6) for n, _ in _PCT})


@query(f"WITH {_RAW} SELECT dept, count(*) AS n, 100.0 AS pct_riding, round(100.0 * count(*) FILTER (bn IS NULL)::DOUBLE / count(*), 6) AS pct_bn FROM latest WHERE {_AFTER} GROUP BY 1 HAVING count(*) >= 10".replace("100.0 AS pct_riding", "CAST(100 AS DOUBLE) AS pct_riding"))
def agreement_mandatory_fields(t: Tables) -> DataFrame:
    return quality.mandatory_fields(_raw(t)).select("dept", "n", "pct_riding", F.round("pct_bn", 6).alias("pct_bn"))


@query(f"""WITH {_RAW} SELECT dept, 'spreadsheet null date' AS anomaly, sd_raw AS value, count(*) AS n FROM p WHERE sd = TIMESTAMP '1899-12-30' GROUP BY 1, 3 UNION ALL SELECT dept, 'before 1990', sd_raw, count(*) FROM p WHERE sd < TIMESTAMP '1990-01-01' AND sd <> TIMESTAMP '1899-12-30' GROUP BY 1, 3
UNION ALL SELECT dept, 'lower-case country', country, count(*) FROM p WHERE country <> upper(country) GROUP BY 1, 3 UNION ALL SELECT dept, CASE WHEN prov = 'NY' THEN 'foreign province' ELSE 'invalid province' END, prov, count(*) FROM p WHERE prov <> 'ON' GROUP BY 1, 2, 3""")
def agreement_anomalies(t: Tables) -> DataFrame:
    return quality.anomalies(quality.parse_agreements(_raw(t)))


@query(f"""WITH {_RAW}, y AS (SELECT year(sd) - CASE WHEN month(sd) < 4 THEN 1 ELSE 0 END AS fy, value FROM latest WHERE sd BETWEEN TIMESTAMP '2005-04-01' AND TIMESTAMP '2027-03-31')
SELECT CAST(fy AS BIGINT) AS fy, count(*) AS n, round(CAST(coalesce(sum(value), 0) AS DOUBLE), 2) AS total FROM y GROUP BY 1""")
def agreement_series(t: Tables) -> DataFrame:
    return longs(quality.dashboard(_raw(t))["series"].withColumn("total", F.round(F.col("total").cast("double"), 2)), "fy")


@query(f"""WITH {_RAW} SELECT count(*) FILTER (value = 1) AS one_dollar, count(*) FILTER (value > 0 AND value < 5000) AS small, count(*) FILTER (sd = TIMESTAMP '1899-12-30') AS excel, (SELECT count(*) FROM f) - count(*) AS superseded, count(DISTINCT dept) AS departments FROM latest""")
def agreement_facts(t: Tables) -> DataFrame:
    raw = _raw(t)
    d = quality.dashboard(raw)
    small = quality.parse_agreements(quality.latest(raw)).agg(F.count_if((F.col("value") > 0) & (F.col("value") < 5000)).alias("small"))
    return d["facts"].select("one_dollar", "excel").crossJoin(small).crossJoin(d["totals"].select("superseded", "departments"))


@query(f"""WITH {_RAW}, c AS (SELECT dept, prov AS value, count(*) AS n FROM latest WHERE badprov GROUP BY 1, 2) SELECT dept, value, n FROM (SELECT *, row_number() OVER (PARTITION BY dept ORDER BY n DESC, value) AS rn FROM c) WHERE rn <= 3""")
def agreement_dirty_values(t: Tables) -> DataFrame:
    return quality.dirty_values(_raw(t), "badprov", "prov")


@query(f"""WITH {_RAW}, m AS (SELECT dept, k, trim(regexp_replace(description_en, '\\s+', ' ', 'g')) AS text, latest.value FROM latest JOIN raw USING (k, a))
SELECT sha256(text) AS text_hash, count(*) AS n_grants, CAST(sum(value) AS DOUBLE) AS amount FROM m WHERE text <> '' GROUP BY 1""")
def agreement_text_map(t: Tables) -> DataFrame:
    m = textclass.grant_text_map(_raw(t))
    return doubles(m.groupBy("text_hash").agg(F.count("*").alias("n_grants"), F.sum(F.col("amount_cad").cast("decimal(18,2)")).alias("amount")), "amount")


@query(f"""WITH {_RAW}, o AS (SELECT dept, recipient, count(*) AS n, CAST(sum(value) AS DOUBLE) AS dollars FROM latest WHERE recipient IS NOT NULL AND value IS NOT NULL GROUP BY 1, 2)
SELECT recipient, dollars, n FROM o WHERE dept = '1-URGENT' ORDER BY dollars DESC NULLS LAST, recipient LIMIT 50""")
def evidence_rows(t: Tables) -> DataFrame:
    p = quality.parse_agreements(quality.latest(_raw(t))).where("recipient is not null and value is not null")
    return doubles(quality.evidence_rows(p.select(F.col("dept").alias("category"), "recipient", F.col("value").cast("decimal(18,2)").alias("amount")), "1-URGENT"), "dollars")


@query("""WITH f AS (SELECT o_custkey, year(o_orderdate) AS y, CAST(o_totalprice AS DECIMAL(18,2)) AS v, o_orderkey, o_orderkey % 4 + 2000 AS source_year, o_orderdate FROM orders),
l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, y ORDER BY source_year DESC, o_orderdate DESC, o_orderkey % 10000) AS rn FROM f)
SELECT o_custkey AS entity_id, CAST(y AS BIGINT) AS fiscal_year, CAST(v AS DOUBLE) AS total_revenue FROM l WHERE rn = 1""")
def financials_by_year(t: Tables) -> DataFrame:
    key = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    # The key is unique in (number, year, source year, date) but for a few orders, which the full number's order decides.
    suffix = F.lpad((F.col("o_orderkey") % 10_000).cast("string"), 4, "0")
    filings = t.orders.select(F.concat(key, F.lit("RR"), suffix).alias("BN"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("FPE"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("4700"), (F.col("o_orderkey") % 4 + 2000).alias("source_year"))
    ents = t.customer.select(F.col("c_custkey").alias("entity_id"), F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("bn_root"))
    return longs(marts.latest_financials(ents, filings, yearly=True).select("entity_id", "fiscal_year", "total_revenue"), "fiscal_year")


@query(f"""WITH {PANEL}, e AS (SELECT bn_root, min(fiscal_year) AS Y FROM receipts GROUP BY 1)
SELECT bn_root, CAST(Y - 2 AS BIGINT) AS y FROM e WHERE Y IN (1997, 1998)""")
def placebo_events(t: Tables) -> DataFrame:
    events = study.treatment_events(t.receipts(), 0.0, (1997, 1998))
    return events.select("bn_root", (F.col("Y") - 2).cast("long").alias("y"))


@query("""SELECT CASE WHEN s = '' THEN 'blank' WHEN regexp_matches(s, '^[0-9]+$') THEN length(s) || ' digits' ELSE 'non-numeric' END AS shape, count(*) AS n FROM (
  SELECT regexp_replace(CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN CAST(c_custkey AS VARCHAR) WHEN 2 THEN 'CRA ' || c_custkey WHEN 3 THEN c_mktsegment ELSE ' - ' END, '^CRA *|[ .-]', '', 'g') AS s FROM customer) GROUP BY 1""")
def bn_reject_shapes(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    raw = F.when(k % 5 == 0, "").when(k % 5 == 1, k.cast("string")).when(k % 5 == 2, F.concat(F.lit("CRA "), k.cast("string"))).when(k % 5 == 3, F.col("c_mktsegment")).otherwise(" - ")
    return t.customer.select(expr.bn_reject_shape(raw).alias("shape")).groupBy("shape").agg(F.count("*").alias("n"))
