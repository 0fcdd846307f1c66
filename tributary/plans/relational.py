"""Relational operators on agreement-like tables: versions, duplicates, aggregates, windows, dates, money."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import dedup, quality
from .base import Tables, doubles, longs, money, query

_LATEST = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey, l_suppkey, l_extendedprice, l_quantity)"


def _order() -> list[Column]:
    """Amendment number, then everything that makes the order total."""
    return [F.desc("l_linenumber"), *(F.asc(c) for c in ("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"))]


def _latest_lines(t: Tables) -> DataFrame:
    return dedup.latest_by(t.lineitem, ["l_orderkey"], _order())


@query(f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS amendment, l_partkey, l_suppkey, l_extendedprice FROM (SELECT *, {_LATEST} AS rn FROM lineitem) WHERE rn = 1")
def latest_amendment(t: Tables) -> DataFrame:
    return _latest_lines(t).select("l_orderkey", F.col("l_linenumber").cast("long").alias("amendment"), "l_partkey", "l_suppkey", "l_extendedprice")


@query(f"""WITH x AS (SELECT *, {_LATEST} AS rn FROM lineitem)
SELECT o_orderpriority AS dept, count(*) AS n, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM x JOIN orders ON l_orderkey = o_orderkey WHERE rn = 1 GROUP BY 1""")
def dept_totals_latest(t: Tables) -> DataFrame:
    joined = _latest_lines(t).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    return doubles(joined.groupBy(F.col("o_orderpriority").alias("dept")).agg(F.count("*").alias("n"), F.sum(money(F.col("l_extendedprice"))).alias("total")), "total")


@query("""WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, nullif(l_returnflag, 'A') AS flag, 0 AS copy FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, nullif(l_returnflag, 'A'), 1 FROM lineitem WHERE l_orderkey % 3 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, flag ORDER BY copy DESC) AS rn FROM u)
SELECT coalesce(flag, '') AS flag, count(*) AS n, CAST(sum(copy) AS BIGINT) AS from_copy FROM r WHERE rn = 1 GROUP BY 1""")
def full_row_dedup(t: Tables) -> DataFrame:
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "flag"]
    rows = t.lineitem.withColumn("flag", F.nullif("l_returnflag", F.lit("A"))).select(*key)
    both = rows.withColumn("copy", F.lit(0)).unionByName(rows.where("l_orderkey % 3 = 0").withColumn("copy", F.lit(1)))
    one = dedup.full_row_dedup(both, key, [F.desc("copy")])
    return one.groupBy(F.coalesce("flag", F.lit("")).alias("flag")).agg(F.count("*").alias("n"), F.sum("copy").alias("from_copy"))


@query(f"""WITH x AS (SELECT *, {_LATEST} AS rn FROM lineitem)
SELECT l_orderkey, count(*) AS rows_removed, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS dollars_removed
FROM x WHERE rn > 1 GROUP BY 1 ORDER BY dollars_removed DESC, l_orderkey LIMIT 20""")
def superseded_impact_top20(t: Tables) -> DataFrame:
    gone = dedup.duplicate_impact(t.lineitem, ["l_orderkey"], _order(), money(F.col("l_extendedprice")))
    return doubles(gone.orderBy(F.desc("dollars_removed"), "l_orderkey").limit(20), "dollars_removed")


@query("""SELECT o_custkey, CAST(year(o_orderdate) AS BIGINT) AS fiscal_year, o_orderkey, o_totalprice FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1""")
def latest_filing_by_year(t: Tables) -> DataFrame:
    rows = t.orders.withColumn("fiscal_year", F.year("o_orderdate").cast("long"))
    return dedup.latest_by(rows, ["o_custkey", "fiscal_year"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "fiscal_year", "o_orderkey", "o_totalprice")


@query("""SELECT n_name AS dept, count(*) AS n_rows, count(*) FILTER (nullif(o_orderstatus, 'P') IS NULL) AS no_status,
  count(*) FILTER (o_totalprice < 10000) AS small, count(*) FILTER (o_orderdate >= TIMESTAMP '2001-01-01') AS late,
  count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low_priority, count(*) FILTER (c_acctbal < 0) AS negative,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def compliance_matrix(t: Tables) -> DataFrame:
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(t.nation), F.col("c_nationkey") == F.col("n_nationkey"))
    n = F.count_if
    return doubles(rows.groupBy(F.col("n_name").alias("dept")).agg(
        F.count("*").alias("n_rows"), n(F.nullif("o_orderstatus", F.lit("P")).isNull()).alias("no_status"), n(F.col("o_totalprice") < 10000).alias("small"), n(F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")).alias("late"),
        n(~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).alias("low_priority"), n(F.col("c_acctbal") < 0).alias("negative"), F.sum(money(F.col("o_totalprice"))).alias("total"),
    ), "total")


@query("""WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, nullif(c_mktsegment, 'MACHINERY') AS c_mktsegment, CASE WHEN c_nationkey = 3 THEN ' ' ELSE c_name END AS c_name FROM customer)
SELECT k AS "column", sum(m)::BIGINT AS missing, (count(*) - sum(m))::BIGINT AS filled, round(100.0 * (count(*) - sum(m))::DOUBLE / count(*), 6) AS pct_filled FROM (
  SELECT 'c_custkey' AS k, CASE WHEN coalesce(trim(c_custkey), '') = '' THEN 1 ELSE 0 END AS m FROM c UNION ALL
  SELECT 'c_mktsegment', CASE WHEN coalesce(trim(c_mktsegment), '') = '' THEN 1 ELSE 0 END FROM c UNION ALL
  SELECT 'c_name', CASE WHEN coalesce(trim(c_name), '') = '' THEN 1 ELSE 0 END FROM c) GROUP BY 1""")
def completeness_all_columns(t: Tables) -> DataFrame:
    c = t.customer.select(F.col("c_custkey").cast("string"), F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("c_mktsegment"), F.when(F.col("c_nationkey") == 3, " ").otherwise(F.col("c_name")).alias("c_name"))
    return quality.completeness(c).withColumn("pct_filled", F.round("pct_filled", 6))


@query("""SELECT coalesce(trim(nullif(p_brand, 'Brand#7')), '') AS value, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, value LIMIT 10""")
def value_counts_top(t: Tables) -> DataFrame:
    return quality.value_counts(t.part.withColumn("b", F.nullif("p_brand", F.lit("Brand#7"))), "b", 10)


@query("""WITH s AS (SELECT CAST(l_extendedprice AS DECIMAL(18,2)) AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem)
SELECT CAST(p AS BIGINT) AS percent, CAST(v AS DOUBLE) AS value FROM s JOIN (VALUES (1), (25), (50), (75), (99)) AS q(p) ON i = CAST(floor(n * p / 100.0) AS BIGINT)""")
def positional_percentiles(t: Tables) -> DataFrame:
    out = dedup.positional_percentile(t.lineitem.select(money(F.col("l_extendedprice")).alias("v")), "v", [1, 25, 50, 75, 99])
    return doubles(longs(out, "percent"), "value")


@query("""SELECT o_orderpriority AS dept, l_returnflag AS flag, count(*) AS n, round(100.0 * count(*) FILTER (l_discount > 0.05)::DOUBLE / count(*), 6) AS pct_high
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING count(*) >= 100""")
def having_pct(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    out = rows.groupBy(F.col("o_orderpriority").alias("dept"), F.col("l_returnflag").alias("flag")).agg(F.count("*").alias("n"), F.round(F.lit(100.0) * F.count_if(F.col("l_discount") > 0.05) / F.count("*").cast("double"), 6).alias("pct_high"))
    return out.where("n >= 100")


@query("""WITH a AS (SELECT p_brand, p_type, count(*) AS n FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY 1, 2)
SELECT p_brand, p_type, n, rk FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS rk FROM a) WHERE rk <= 3""")
def topk_per_group_over_agg(t: Tables) -> DataFrame:
    a = t.part.join(t.lineitem, F.col("p_partkey") == F.col("l_partkey")).groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    return longs(dedup.topk_per_group(a, ["p_brand"], [F.desc("n"), F.asc("p_type")], 3, keep_rank="rk"), "rk")


@query("""SELECT l_returnflag, l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem) WHERE rn <= 2""")
def topk_rows_per_group(t: Tables) -> DataFrame:
    out = dedup.topk_per_group(t.lineitem, ["l_returnflag"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey")], 2)
    return longs(out.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), "l_linenumber")


@query("""SELECT CAST(year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END AS BIGINT) AS fiscal_year, count(*) AS n,
  CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1""")
def fiscal_year_series(t: Tables) -> DataFrame:
    out = t.orders.groupBy(expr.fiscal_year(F.col("o_orderdate")).alias("fiscal_year")).agg(F.count("*").alias("n"), F.sum(money(F.col("o_totalprice"))).alias("total"))
    return doubles(longs(out, "fiscal_year"), "total")


@query("""WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y/%m/%d')
  ELSE strftime(o_orderdate, '%d/%m/%Y') END AS raw FROM orders),
p AS (SELECT raw, coalesce(try_strptime(raw, '%Y-%m-%d'), try_strptime(raw, '%Y/%m/%d'), try_strptime(raw, '%d/%m/%Y')) AS d FROM r)
SELECT CAST(year(d) AS BIGINT) AS y, CAST(month(d) AS BIGINT) AS m, count(*) AS n, count(*) FILTER (d IS NULL) AS failed FROM p GROUP BY 1, 2""")
def tri_format_dates(t: Tables) -> DataFrame:
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    raw = F.when(k % 11 == 0, "n/a").when(k % 3 == 0, F.date_format(day, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(day, "yyyy/MM/dd")).otherwise(F.date_format(day, "dd/MM/yyyy"))
    parsed = t.orders.select(raw.alias("raw")).withColumn("d", expr.any_date(F.col("raw")))
    return longs(parsed.groupBy(F.year("d").alias("y"), F.month("d").alias("m")).agg(F.count("*").alias("n"), F.count_if(expr.parse_failed(F.col("raw"), F.col("d"))).alias("failed")), "y", "m")


@query("""SELECT o_orderpriority AS dept, CAST(sum(CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS total,
  count(*) FILTER (o_orderkey % 13 = 0) AS failed FROM orders GROUP BY 1""")
def money_parse(t: Tables) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 13 == 0, "unknown").otherwise(F.concat(F.lit(" $"), F.format_number("o_totalprice", 2)))
    rows = t.orders.select("o_orderpriority", raw.alias("raw")).withColumn("v", expr.money(F.col("raw")))
    return doubles(rows.groupBy(F.col("o_orderpriority").alias("dept")).agg(F.sum(money(F.col("v"))).alias("total"), F.count_if(expr.parse_failed(F.col("raw"), F.col("v"))).alias("failed")), "total")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS DOUBLE) AS v, year(o_orderdate) AS y1, year(l_shipdate) AS y2 FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT v / (greatest(y1, y2) - y1 + 1) AS part, unnest(range(y1, greatest(y1, y2) + 1)) AS y FROM s)
SELECT CAST(y AS BIGINT) AS fiscal_year, round(sum(part), 2) AS amount, count(*) AS n FROM e GROUP BY 1""")
def prorate_span(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    parts = rows.select(F.explode(expr.prorated(F.col("l_extendedprice"), F.year("o_orderdate"), F.year("l_shipdate"))).alias("p")).select("p.*")
    return longs(parts.groupBy("fiscal_year").agg(F.round(F.sum("amount"), 2).alias("amount"), F.count("*").alias("n")), "fiscal_year")


@query("""SELECT l_shipmode_like AS bucket, count(*) AS n, min(p_name) AS example FROM (SELECT CASE WHEN p_name ILIKE '%RING%' THEN 'ring' WHEN p_name LIKE 'red%' THEN 'red' ELSE 'other' END AS l_shipmode_like, p_name FROM part
  WHERE p_size BETWEEN 5 AND 40 AND p_type NOT IN ('SMALL')) GROUP BY 1""")
def like_between_filters(t: Tables) -> DataFrame:
    name = F.col("p_name")
    rows = t.part.where(F.col("p_size").between(5, 40) & ~F.col("p_type").isin("SMALL"))
    bucket = F.when(name.ilike("%RING%"), "ring").when(name.like("red%"), "red").otherwise("other")
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.min("p_name").alias("example"))


@query("""SELECT o_orderpriority AS dept, count(DISTINCT o_custkey) AS customers, count(DISTINCT year(o_orderdate)) AS years,
  string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses, bool_or(o_totalprice > 490000) AS any_big FROM orders GROUP BY 1""")
def distinct_counts(t: Tables) -> DataFrame:
    return t.orders.groupBy(F.col("o_orderpriority").alias("dept")).agg(F.countDistinct("o_custkey").alias("customers"), F.countDistinct(F.year("o_orderdate")).alias("years"), F.concat_ws(",", F.array_sort(F.collect_set("o_orderstatus"))).alias("statuses"), F.bool_or(F.col("o_totalprice") > 490000).alias("any_big"))


@query("""WITH a AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT n AS orders_per_customer, count(*) AS customers, CAST(sum(n) AS BIGINT) AS orders FROM a GROUP BY 1""")
def two_level_aggregate(t: Tables) -> DataFrame:
    a = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return a.groupBy(F.col("n").alias("orders_per_customer")).agg(F.count("*").alias("customers"), F.sum("n").alias("orders"))


@query("""WITH a AS (SELECT n_name, p_brand, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY amount DESC, p_brand) AS rn FROM a)
SELECT n_name, CAST(least(rn, 5) AS BIGINT) AS rank, CASE WHEN rn <= 4 THEN p_brand ELSE 'other' END AS p_brand, round(sum(amount), 2) AS amount, count(*) AS members FROM r GROUP BY 1, 2, 3""")
def top_n_plus_other(t: Tables) -> DataFrame:
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey"))
    a = rows.groupBy("n_name", "p_brand").agg(F.sum(money(F.col("l_extendedprice"))).cast("double").alias("amount"))
    out = dedup.top_and_rest(a, ["n_name"], [F.desc("amount"), F.asc("p_brand")], 4, "p_brand", "amount")
    return longs(out.withColumn("amount", F.round("amount", 2)), "rank")


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority, CAST(o_totalprice AS DOUBLE) AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders),
b AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1),
c AS (SELECT o_orderpriority, greatest(0, least(n, 4000 - coalesce(sum(n) OVER (ORDER BY o_orderpriority ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS share FROM b)
SELECT r.o_orderpriority AS category, count(*) FILTER (rn <= share) AS shown, count(*) FILTER (rn > share) AS rest,
  round(coalesce(sum(v) FILTER (rn > share), 0), 2) AS rest_amount FROM r JOIN c ON r.o_orderpriority = c.o_orderpriority GROUP BY 1""")
def shared_embed_budget(t: Tables) -> DataFrame:
    cats = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    rows = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("category"), F.col("o_totalprice").alias("v"))
    shown, rest = dedup.shared_budget(rows, "category", cats, [F.desc("v"), F.asc("o_orderkey")], 4000, "v")
    s = shown.groupBy("category").agg(F.count("*").alias("shown"))
    out = s.join(rest.select("category", F.col("rows").alias("rest"), F.col("v").alias("rest_amount")), "category", "full")
    zero = F.lit(0).cast("long")
    return out.select("category", F.coalesce("shown", zero).alias("shown"), F.coalesce("rest", zero).alias("rest"), F.round(F.coalesce("rest_amount", F.lit(0.0)), 2).alias("rest_amount"))


@query("""SELECT l_orderkey, string_agg(l_linenumber || ':' || CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ' > ' ORDER BY l_linenumber, CAST(l_quantity AS BIGINT)) AS chain, count(*) AS versions FROM lineitem GROUP BY 1""")
def amendment_chain(t: Tables) -> DataFrame:
    from ..operators.search import amendment_chain as chain

    return longs(chain(t.lineitem.withColumn("q", F.col("l_quantity").cast("long")), ["l_orderkey"], "l_linenumber", "q"), "versions")


@query("""SELECT CAST(year(o_orderdate) AS BIGINT) AS y, count(*) FILTER (o_orderdate < TIMESTAMP '1996-01-01') AS too_early, count(*) FILTER (o_orderdate > TIMESTAMP '2001-06-30') AS too_late,
  count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS bad_status FROM orders GROUP BY 1""")
def anomaly_dates(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    out = t.orders.groupBy(F.year(d).alias("y")).agg(F.count_if(d < F.lit("1996-01-01").cast("timestamp_ntz")).alias("too_early"), F.count_if(d > F.lit("2001-06-30").cast("timestamp_ntz")).alias("too_late"), F.count_if(~F.col("o_orderstatus").isin("F", "O")).alias("bad_status"))
    return longs(out, "y")


@query("""SELECT code, CASE WHEN regexp_matches(code, '^[A-Z]{2}$') THEN 'foreign' ELSE 'invalid' END AS kind, count(*) AS n FROM (
  SELECT CASE WHEN c_custkey % 4 = 0 THEN upper(substr(c_mktsegment, 1, 2)) WHEN c_custkey % 4 = 1 THEN lower(substr(c_mktsegment, 1, 2)) ELSE 'ON' END AS code FROM customer) WHERE code NOT IN ('ON', 'QC') GROUP BY 1, 2""")
def bad_codes(t: Tables) -> DataFrame:
    two = F.substring("c_mktsegment", 1, 2)
    code = F.when(F.col("c_custkey") % 4 == 0, F.upper(two)).when(F.col("c_custkey") % 4 == 1, F.lower(two)).otherwise("ON")
    rows = t.customer.select(code.alias("code")).where(~F.col("code").isin("ON", "QC"))
    return rows.groupBy("code", F.when(F.col("code").rlike("^[A-Z]{2}$"), "foreign").otherwise("invalid").alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey, o_custkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS total FROM orders WHERE o_orderstatus = 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 100""")
def page_with_total(t: Tables) -> DataFrame:
    from ..operators.search import with_total

    hits = t.orders.where("o_orderstatus = 'P'")
    page = hits.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_custkey", "o_totalprice")
    return with_total(page, hits.agg(F.count("*").alias("total")))


@query("""SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1 UNION SELECT o_custkey FROM orders WHERE o_totalprice > 450000""")
def set_union_keys(t: Tables) -> DataFrame:
    a = t.orders.where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return a.union(t.orders.where("o_totalprice > 450000").select("o_custkey")).distinct()


@query("""SELECT s.s_suppkey, s.s_name, n.n_name, count(*) AS lines FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region USING (r_regionkey) JOIN lineitem ON l_suppkey = s_suppkey WHERE r_name = 'ASIA' GROUP BY 1, 2, 3""".replace("JOIN region USING (r_regionkey)", "JOIN region ON n.n_regionkey = r_regionkey"))
def dimension_joins(t: Tables) -> DataFrame:
    dims = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region.where("r_name = 'ASIA'")), F.col("n_regionkey") == F.col("r_regionkey"))
    lines = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("lines"))
    return dims.join(lines, "s_suppkey").select("s_suppkey", "s_name", "n_name", "lines")


@query("""SELECT e.user_id, CAST(json_extract(e.props, '$.k') AS BIGINT) AS code, count(*) AS n, round(sum(value), 4) AS total FROM events e GROUP BY 1, 2""")
def code_rollup(t: Tables) -> DataFrame:
    codes = F.split(F.regexp_extract("props", r"\"k\": *([0-9, ]+)", 1), ",")
    rows = t.events.select("user_id", "value", F.explode(codes).alias("code"))
    return rows.groupBy("user_id", F.trim("code").cast("long").alias("code")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
