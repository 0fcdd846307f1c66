"""Domain operators over analogue tables: roles, study, flow, matching, merges, discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import discovery, flow, marts, merges, quality, resolve, search, study
from .base import FLOWS, PANEL, Tables, doubles, longs, money, query, rounded

_YEARS = (1997, 1998, 1999)
_YEARS_SQL = "(1997, 1998, 1999)"


def _grants(t: Tables) -> DataFrame:
    """The flows as grants between nations (recipients numbered from 100)."""
    return t.flows().select(F.col("funder").alias("funder_entity_id"), (F.col("recipient") + 100).alias("recipient_entity_id"), F.col("amount").cast("double").alias("amount_cad"), F.col("year").alias("fiscal_year"), F.col("source").alias("source_dataset"))


@query(f"""WITH {FLOWS}, g AS (SELECT funder AS id, CAST(sum(amount) AS DOUBLE) AS given, count(*) AS ng FROM flows WHERE funder % 2 = 0 GROUP BY 1),
r AS (SELECT recipient AS id, CAST(sum(amount) AS DOUBLE) AS received, count(*) AS nr FROM flows WHERE recipient % 3 <> 0 GROUP BY 1),
x AS (SELECT CAST(n_nationkey AS BIGINT) AS entity_id, coalesce(given, 0) AS total_given, coalesce(received, 0) AS total_received, coalesce(ng, 0) AS n_given, coalesce(nr, 0) AS n_received
  FROM nation LEFT JOIN g ON n_nationkey = g.id LEFT JOIN r ON n_nationkey = r.id)
SELECT *, round(CASE WHEN total_given + total_received > 0 THEN total_given / (total_given + total_received) END, 6) AS given_share,
  CASE WHEN total_given + total_received = 0 THEN 'no_flows' WHEN total_given / (total_given + total_received) >= 0.9 THEN 'primarily_funder'
  WHEN total_given / (total_given + total_received) <= 0.1 THEN 'primarily_recipient' ELSE 'dual_role' END AS role FROM x""")
def role_summary(t: Tables) -> DataFrame:
    f = t.flows()
    none = F.lit(None).cast("long")
    rows = f.select(F.when(F.col("funder") % 2 == 0, F.col("funder")).otherwise(none).alias("funder_entity_id"), F.when(F.col("recipient") % 3 != 0, F.col("recipient")).otherwise(none).alias("recipient_entity_id"), F.col("amount").alias("amount_cad"))
    ents = t.nation.select(F.col("n_nationkey").cast("long").alias("entity_id"), F.col("n_name").alias("canonical_name"), F.lit("other_org").alias("entity_kind"))
    out = marts.role_summary(ents, rows)
    out = out.select("entity_id", "total_given", "total_received", F.col("n_grants_given").alias("n_given"), F.col("n_grants_received").alias("n_received"), "given_share", "role")
    return rounded(doubles(out, "total_given", "total_received"), "given_share")


@query(f"""WITH {FLOWS}, b AS (SELECT funder AS entity_id, source FROM flows UNION ALL SELECT recipient + 100, source FROM flows WHERE year < 1997)
SELECT entity_id, bool_or(source = '1-URGENT') AS urgent, bool_or(source = '2-HIGH') AS high, bool_or(source = '5-LOW') AS low FROM b GROUP BY 1""")
def category_flags(t: Tables) -> DataFrame:
    g = _grants(t).withColumn("recipient_entity_id", F.when(F.col("fiscal_year") < 1997, F.col("recipient_entity_id")))
    return marts.category_flags(g, {"urgent": "1-URGENT", "high": "2-HIGH", "low": "5-LOW"}).where("entity_id is not null")


@query(f"WITH {PANEL} SELECT DISTINCT bn_root FROM donations WHERE bn_root NOT IN (SELECT bn_root FROM receipts)")
def never_treated_pool(t: Tables) -> DataFrame:
    return study.never_treated(t.donations(), t.receipts())


_EVENTS = f"""events AS (SELECT bn_root, fiscal_year AS Y FROM (SELECT *, row_number() OVER (PARTITION BY bn_root ORDER BY fiscal_year) AS rn FROM receipts)
  WHERE rn = 1 AND amount >= 100000 AND fiscal_year IN {_YEARS_SQL}),
pool AS (SELECT p.bn_root, y AS Y FROM (SELECT DISTINCT bn_root FROM donations WHERE bn_root NOT IN (SELECT bn_root FROM receipts)) p CROSS JOIN (VALUES (1997), (1998), (1999)) AS v(y))"""


def _stats_sql(events: str, out: str) -> str:
    return f"""{out} AS (SELECT * , (post_mean - pre_mean) / pre_mean AS pct FROM (
  SELECT e.bn_root, e.Y, avg(CASE WHEN fiscal_year BETWEEN Y - 3 AND Y - 1 THEN donations END) AS pre_mean, avg(CASE WHEN fiscal_year BETWEEN Y + 1 AND Y + 3 THEN donations END) AS post_mean,
    count(CASE WHEN fiscal_year BETWEEN Y - 3 AND Y - 1 THEN donations END) AS n_pre, count(CASE WHEN fiscal_year BETWEEN Y + 1 AND Y + 3 THEN donations END) AS n_post
  FROM {events} e JOIN donations d ON e.bn_root = d.bn_root GROUP BY 1, 2) WHERE n_pre >= 2 AND n_post >= 2 AND pre_mean > 0)"""


@query(f"WITH {PANEL}, {_EVENTS} SELECT bn_root, CAST(Y AS BIGINT) AS y FROM events")
def treatment_events(t: Tables) -> DataFrame:
    return study.treatment_events(t.receipts(), 100_000, _YEARS).select("bn_root", F.col("Y").cast("long").alias("y"))


@query(f"WITH {PANEL}, {_EVENTS}, {_stats_sql('events', 'stats')} SELECT bn_root, CAST(Y AS BIGINT) AS y, round(pre_mean, 4) AS pre_mean, round(post_mean, 4) AS post_mean, n_pre, n_post, round(pct, 6) AS pct FROM stats")
def window_stats(t: Tables) -> DataFrame:
    s = study.window_stats(study.treatment_events(t.receipts(), 100_000, _YEARS), t.donations())
    return s.select("bn_root", F.col("Y").cast("long").alias("y"), F.round("pre_mean", 4).alias("pre_mean"), F.round("post_mean", 4).alias("post_mean"), "n_pre", "n_post", F.round("pct", 6).alias("pct"))


@query(f"""WITH {PANEL}, {_EVENTS}, {_stats_sql('events', 'a')}, {_stats_sql('pool', 'b')},
ta AS (SELECT Y, median(pct) AS m, count(*) AS n FROM a GROUP BY 1), tb AS (SELECT Y, median(pct) AS m, count(*) AS n FROM b GROUP BY 1)
SELECT CAST(ta.Y AS BIGINT) AS y, round(ta.m, 6) AS treated_median, ta.n AS n_treated, round(tb.m, 6) AS control_median, tb.n AS n_control, round(ta.m - tb.m, 6) AS difference FROM ta LEFT JOIN tb ON ta.Y = tb.Y""")
def naive_contrast(t: Tables) -> DataFrame:
    out = study.contrast(t.receipts(), t.donations(), 100_000, _YEARS).select(F.col("Y").cast("long").alias("y"), "treated_median", "n_treated", "control_median", "n_control", "difference")
    return rounded(out, "treated_median", "control_median", "difference")


@query(f"""WITH {PANEL}, {_EVENTS}, {_stats_sql('events', 'a')}, q AS (SELECT quantile_cont(pct, 0.05) AS lo, quantile_cont(pct, 0.95) AS hi FROM a)
SELECT round(median(least(greatest(pct, lo), hi)), 6) AS winsorized_median, count(*) AS n FROM a, q""")
def winsorized_median(t: Tables) -> DataFrame:
    s = study.window_stats(study.treatment_events(t.receipts(), 100_000, _YEARS), t.donations())
    return rounded(study.winsorized_median(s, "pct", 0.05), "winsorized_median")


def _cohorts(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Treated and control units with covariates and buckets, of the years of the study; each written once."""
    return tuple(t._once(f"cohort-{i}", lambda i=i: _made_cohorts(t)[i]) for i in (0, 1))  # type: ignore[return-value]


def _made_cohorts(t: Tables) -> tuple[DataFrame, DataFrame]:
    provinces = t.customer.select(F.col("c_custkey").alias("bn_root"), F.col("c_nationkey").alias("province"))
    events = study.treatment_events(t.receipts(), 100_000, _YEARS)
    pool = study.pool_events(study.never_treated(t.donations(), t.receipts()), _YEARS)
    return tuple(study.with_buckets(study.covariates(e, t.donations(), provinces)) for e in (events, pool))  # type: ignore[return-value]


def _buckets_sql(events: str, out: str) -> str:
    """Covariates and qcut buckets in SQL."""
    edges = lambda n: ", ".join(f"quantile_cont({{v}}, {i}.0 / {n})" for i in range(n + 1))
    return f"""{out}_c AS (SELECT e.bn_root, e.Y, d1.revenue, CASE WHEN d3.donations > 0 THEN (d1.donations - d3.donations) / d3.donations END AS trend, c_nationkey AS province
  FROM {events} e LEFT JOIN donations d1 ON d1.bn_root = e.bn_root AND d1.fiscal_year = e.Y - 1 LEFT JOIN donations d3 ON d3.bn_root = e.bn_root AND d3.fiscal_year = e.Y - 3 LEFT JOIN customer ON c_custkey = e.bn_root),
{out}_e AS (SELECT Y, count(revenue) AS nr, count(trend) AS nt, list_sort(list_distinct([{edges(10).format(v='revenue')}])) AS er, list_sort(list_distinct([{edges(3).format(v='trend')}])) AS et FROM {out}_c GROUP BY 1),
{out} AS (SELECT c.*, CASE WHEN revenue IS NULL OR nr < 10 THEN -1 WHEN len(er) < 2 THEN 0 ELSE greatest(0, len(list_filter(er, lambda x: x < revenue)) - 1) END AS decile,
  CASE WHEN trend IS NULL OR nt < 3 THEN -1 WHEN len(et) < 2 THEN 0 ELSE greatest(0, len(list_filter(et, lambda x: x < trend)) - 1) END AS tercile FROM {out}_c c JOIN {out}_e e ON c.Y = e.Y)"""


_MATCHED = f"""{PANEL}, {_EVENTS}, {_buckets_sql('events', 'tr')}, {_buckets_sql('pool', 'co')},
pairs AS (SELECT t.bn_root AS treated_bn, t.Y, c.bn_root AS control_bn, abs(t.revenue - c.revenue) AS distance,
    CASE WHEN t.decile = c.decile AND t.tercile = c.tercile THEN 1 WHEN t.decile = c.decile THEN 2 ELSE 3 END AS tier
  FROM tr t JOIN co c ON t.Y = c.Y AND t.province = c.province),
best AS (SELECT treated_bn, Y, min(tier) AS tier FROM pairs GROUP BY 1, 2),
matches AS (SELECT * FROM (SELECT p.treated_bn, p.Y, p.control_bn, b.tier, row_number() OVER (PARTITION BY p.treated_bn, p.Y ORDER BY distance ASC NULLS LAST, p.control_bn) AS rn
  FROM pairs p JOIN best b ON p.treated_bn = b.treated_bn AND p.Y = b.Y AND p.tier <= b.tier) WHERE rn <= 5)"""


@query(f"WITH {PANEL}, {_EVENTS}, {_buckets_sql('events', 'tr')} SELECT CAST(Y AS BIGINT) AS y, CAST(decile AS BIGINT) AS decile, CAST(tercile AS BIGINT) AS tercile, count(*) AS n FROM tr GROUP BY 1, 2, 3")
def quantile_buckets(t: Tables) -> DataFrame:
    return longs(_cohorts(t)[0].groupBy(F.col("Y").alias("y"), "decile", "tercile").agg(F.count("*").alias("n")), "y", "decile", "tercile")


@query(f"WITH {_MATCHED} SELECT treated_bn, CAST(Y AS BIGINT) AS y, control_bn, CASE tier WHEN 1 THEN 'decile_trend' WHEN 2 THEN 'decile' ELSE 'province' END AS tier FROM matches")
def matched_controls(t: Tables) -> DataFrame:
    return study.match_controls(*_cohorts(t)).select("treated_bn", F.col("Y").cast("long").alias("y"), "control_bn", "tier")


@query(f"""WITH {_MATCHED}, {_stats_sql('events', 'a')}, {_stats_sql('pool', 'b')},
c AS (SELECT m.treated_bn, m.Y, avg(b.pct) AS control_pct FROM matches m JOIN b ON m.control_bn = b.bn_root AND m.Y = b.Y GROUP BY 1, 2)
SELECT CAST(a.Y AS BIGINT) AS y, round(median(a.pct - c.control_pct), 6) AS median_difference, count(*) AS n FROM a JOIN c ON a.bn_root = c.treated_bn AND a.Y = c.Y GROUP BY 1""")
def matched_contrast(t: Tables) -> DataFrame:
    treated, controls = _cohorts(t)
    m = study.match_controls(treated, controls)
    d = t.donations()
    out = study.matched_contrast(study.window_stats(treated.select("bn_root", "Y"), d), study.window_stats(controls.select("bn_root", "Y"), d), m)
    return rounded(longs(out.withColumnRenamed("Y", "y"), "y"), "median_difference")


@query(f"""WITH {_MATCHED}, u AS (SELECT bn_root, Y, 1 AS treated FROM events UNION ALL SELECT DISTINCT control_bn, Y, 0 FROM matches)
SELECT u.bn_root || '_Y' || u.Y AS unit, u.bn_root, CAST(u.Y AS BIGINT) AS y, CAST(fiscal_year AS BIGINT) AS fiscal_year, CAST(treated AS BIGINT) AS treated, CAST(fiscal_year > u.Y AS BIGINT) AS post, round(ln(donations), 6) AS log_donations
FROM u JOIN donations d ON u.bn_root = d.bn_root AND fiscal_year BETWEEN u.Y - 3 AND u.Y + 3 AND fiscal_year <> u.Y WHERE donations > 0""")
def regression_panel(t: Tables) -> DataFrame:
    treated, controls = _cohorts(t)
    p = study.regression_panel(treated, study.match_controls(treated, controls), t.donations())
    return longs(p.withColumnRenamed("Y", "y").withColumn("log_donations", F.round("log_donations", 6)), "y", "fiscal_year", "treated", "post")


@query()
def fixed_effects(t: Tables) -> DataFrame:
    """Tested against dense least squares; not expressible in one statement."""
    treated, controls = _cohorts(t)
    got = study.two_way_fe(study.regression_panel(treated, study.match_controls(treated, controls), t.donations()))
    return t.spark.createDataFrame([(k, float(v)) for k, v in (got or {}).items()], "term string, value double")


@query(f"WITH {PANEL}, " + ", ".join(f"e{k} AS (SELECT fiscal_year AS Y FROM (SELECT *, row_number() OVER (PARTITION BY bn_root ORDER BY fiscal_year) AS rn FROM receipts) WHERE rn = 1 AND amount >= {k} AND fiscal_year IN {_YEARS_SQL})" for k in (50000, 250000)) + " SELECT CAST(50000 AS BIGINT) AS threshold, CAST(Y AS BIGINT) AS y, count(*) AS n FROM e50000 GROUP BY 2 UNION ALL SELECT 250000, CAST(Y AS BIGINT), count(*) FROM e250000 GROUP BY 2")
def threshold_events(t: Tables) -> DataFrame:
    parts = [study.treatment_events(t.receipts(), k, _YEARS).groupBy(F.lit(k).cast("long").alias("threshold"), F.col("Y").cast("long").alias("y")).agg(F.count("*").alias("n")) for k in (50_000, 250_000)]
    return parts[0].unionByName(parts[1])


# --- flow-through ---------------------------------------------------------------------------------------------------------

_INTER = f"""{FLOWS}, hop1 AS (SELECT recipient AS bn, year, sum(amount) AS amount, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM flows WHERE source IN ('1-URGENT', '2-HIGH') GROUP BY 1, 2),
regrants AS (SELECT funder AS bn, year, sum(amount) AS amount FROM flows GROUP BY 1, 2),
inter AS (SELECT h.bn, h.year, CAST(h.amount AS DOUBLE) AS hop1_amount, h.sources, CAST(r.amount AS DOUBLE) AS regranted FROM hop1 h JOIN regrants r ON h.bn = r.bn AND h.year = r.year WHERE r.amount > (SELECT avg(amount) FROM regrants))"""


def _flow_inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    f = t.yearly_flows()
    hop1 = f.where(F.col("source").isin("1-URGENT", "2-HIGH")).groupBy(F.col("recipient").alias("bn_root"), F.col("recipient").alias("entity_id"), F.col("source").alias("source_dataset"), F.col("year").alias("fiscal_year")).agg(F.sum("amount").alias("amount"))
    regrants = f.groupBy(F.col("funder").alias("bn_root"), F.col("year").alias("fiscal_year")).agg(F.sum("amount").alias("amount"))
    # The bar is the mean of all regranters, as data sizes differ.
    mean = regrants.agg(F.avg("amount").alias("__m"))
    regrants = regrants.crossJoin(F.broadcast(mean)).withColumn("amount", F.when(F.col("amount") > F.col("__m"), F.col("amount")).otherwise(F.lit(0).cast("decimal(38,2)"))).drop("__m")
    gifts = f.groupBy(F.col("funder").alias("bn_root"), F.col("year").alias("fiscal_year"), F.col("recipient").alias("donee_bn_root")).agg(F.sum("amount").cast("double").alias("amount")).select("*", F.col("donee_bn_root").alias("donee_entity_id"), F.lit("n").alias("donee_raw_name"), F.lit("b").alias("donee_raw_bn"))
    return hop1, regrants, gifts


@query(f"WITH {_INTER} SELECT bn, year, hop1_amount, sources, regranted FROM inter")
def intermediaries(t: Tables) -> DataFrame:
    hop1, regrants, _ = _flow_inputs(t)
    out = flow.intermediaries(hop1, regrants, 0.0)
    return doubles(out.select(F.col("bn_root").alias("bn"), F.col("fiscal_year").alias("year"), "hop1_amount", F.col("hop1_source_datasets").alias("sources"), "regranted"), "hop1_amount", "regranted")


_CHAINS = f"""{_INTER}, gifts AS (SELECT funder AS bn, year, recipient AS donee, CAST(sum(amount) AS DOUBLE) AS amount FROM flows GROUP BY 1, 2, 3),
big AS (SELECT bn, year FROM regrants WHERE amount > (SELECT avg(amount) FROM regrants)),
d1 AS (SELECT i.bn AS root, i.year AS root_year, i.bn, i.year, g.donee, g.amount, g.donee = i.bn AS cyc FROM inter i JOIN gifts g ON g.bn = i.bn AND g.year = i.year),
n1 AS (SELECT donee AS bn, min(struct_pack(root := root, root_year := root_year)) AS r FROM d1 WHERE NOT cyc GROUP BY 1),
f2 AS (SELECT n1.bn, big.year, n1.r.root AS root, n1.r.root_year AS root_year FROM n1 JOIN big ON n1.bn = big.bn),
d2 AS (SELECT f2.root, f2.root_year, f2.bn, f2.year, g.donee, g.amount, (g.donee = f2.bn OR g.donee = f2.root) AS cyc FROM f2 JOIN gifts g ON g.bn = f2.bn AND g.year = f2.year)"""


def _chain_edges(t: Tables) -> DataFrame:
    hop1, regrants, gifts = _flow_inputs(t)
    return flow.chains(flow.intermediaries(hop1, regrants, 0.0), regrants, gifts, threshold=0.0)


@query(f"""WITH {_CHAINS} SELECT CAST(1 AS BIGINT) AS hop_depth, bn, year, root_year, donee, amount, cyc AS is_cycle FROM d1 UNION ALL SELECT 2, bn, year, root_year, donee, amount, cyc FROM d2""")
def flow_chain_depth2(t: Tables) -> DataFrame:
    e = _chain_edges(t)
    return longs(e.select("hop_depth", F.col("intermediary_bn_root").alias("bn"), F.col("hop2_fiscal_year").alias("year"), F.col("hop1_fiscal_year").alias("root_year"), F.col("donee_bn_root").alias("donee"), F.col("hop2_amount").alias("amount"), "is_cycle"), "hop_depth")


@query(f"""WITH {_CHAINS} SELECT CAST(1 AS BIGINT) AS hop_depth, count(*) AS edges, count(*) FILTER (cyc) AS cycles FROM d1 UNION ALL SELECT 2, count(*), count(*) FILTER (cyc) FROM d2""")
def chain_depth_histogram(t: Tables) -> DataFrame:
    return longs(flow.depth_histogram(_chain_edges(t)), "hop_depth", "edges", "cycles")


@query(f"""WITH {FLOWS}, p AS (SELECT funder, recipient, CAST(sum(amount) AS DOUBLE) AS amount FROM flows WHERE funder <> recipient GROUP BY 1, 2),
g AS (SELECT funder AS node, sum(amount) AS given FROM p GROUP BY 1), r AS (SELECT recipient AS node, sum(amount) AS received FROM p GROUP BY 1),
c AS (SELECT g.node FROM g JOIN r ON g.node = r.node WHERE given > 0 AND received > 0 ORDER BY given + received DESC, g.node LIMIT 8),
e AS (SELECT recipient AS intermediary, 'in' AS side, funder AS partner, amount FROM p WHERE recipient IN (SELECT node FROM c) UNION ALL SELECT funder, 'out', recipient, amount FROM p WHERE funder IN (SELECT node FROM c)),
k AS (SELECT *, row_number() OVER (PARTITION BY intermediary, side ORDER BY amount DESC, partner) AS rn FROM e)
SELECT intermediary, side, CASE WHEN rn <= 4 THEN CAST(partner AS VARCHAR) ELSE 'other' END AS partner, round(sum(amount), 2) AS amount FROM k GROUP BY 1, 2, 3""")
def regranting_network(t: Tables) -> DataFrame:
    f = t.yearly_flows().groupBy("funder", "recipient").agg(F.sum("amount").cast("double").alias("amount"))
    return flow.regranting_network(f).withColumn("amount", F.round("amount", 2))


@query(f"""WITH {_CHAINS} SELECT bn, round(sum(amount), 2) AS regranted, count(*) AS gifts FROM d1 GROUP BY 1 ORDER BY regranted DESC, bn LIMIT 20""")
def top_intermediaries(t: Tables) -> DataFrame:
    return flow.top_intermediaries(_chain_edges(t)).select(F.col("intermediary_bn_root").alias("bn"), F.round("regranted", 2).alias("regranted"), "gifts")


# --- matching -------------------------------------------------------------------------------------------------------------


@query("""WITH b AS (SELECT lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS bn, c_custkey FROM customer),
n AS (SELECT a.c_custkey AS a, b.c_custkey AS b, a.bn AS x, b.bn AS y FROM b a JOIN b ON a.c_custkey < b.c_custkey),
s AS (SELECT a, b, 'substitution' AS edit FROM n WHERE hamming(x, y) = 1),
i AS (SELECT a, b, 'insertion_deletion' AS edit FROM n WHERE hamming(x, y) <> 1 AND (substr(x, 1, 8) = substr(y, 2, 8) OR substr(x, 2, 8) = substr(y, 1, 8)))
SELECT * FROM s UNION ALL SELECT * FROM i""")
def bn_edit_distance_pairs(t: Tables) -> DataFrame:
    own = t.customer.select("c_custkey", F.lpad(F.col("c_custkey").cast("string"), 9, "0").alias("bn"))
    near = own.select(F.col("c_custkey").alias("a"), F.explode(expr.bn_neighbours(F.col("bn"))).alias("e")).select("a", F.col("e.candidate").alias("bn"), F.col("e.edit").alias("edit"))
    return near.join(own.select(F.col("c_custkey").alias("b"), "bn"), "bn").where("a < b").select("a", "b", "edit")


@query("""WITH x AS (SELECT c_custkey AS entity_id, 'Org ' || (c_custkey % 700) || ' of the North' AS name, CASE WHEN c_custkey >= 700 THEN 'ON' END AS province FROM customer),
k AS (SELECT *, count(*) FILTER (province IS NOT NULL) OVER (PARTITION BY name) AS twins, min(entity_id) FILTER (province IS NOT NULL) OVER (PARTITION BY name) AS keep FROM x)
SELECT keep, entity_id AS "merge" FROM k WHERE province IS NULL AND twins = 1""")
def null_province_merge(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    ents = t.customer.select(k.alias("entity_id"), F.concat(F.lit("Org "), (k % 700).cast("string"), F.lit(" of the North")).alias("canonical_name"), F.lit(None).cast("string").alias("bn_root"), F.when(k >= 700, "ON").alias("province"), F.lit("other_org").alias("entity_kind"))
    return merges.null_province_pairs(ents)


@query("""WITH base AS (SELECT DISTINCT upper(p_name) AS name FROM part),
x AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' - Ottawa' WHEN p_partkey % 3 = 1 THEN p_name || ' (Laval)' ELSE p_name || '-Gander' END AS name FROM part),
m AS (SELECT p_partkey, CASE WHEN name LIKE '% - %' THEN regexp_extract(name, '^(.+)\\s+[–-]\\s+(.+)$', 1) WHEN name LIKE '% (%' THEN regexp_extract(name, '^(.+)\\s+\\(([^()]+)\\)\\s*$', 1) END AS b,
  CASE WHEN name LIKE '% - %' THEN regexp_extract(name, '^(.+)\\s+[–-]\\s+(.+)$', 2) WHEN name LIKE '% (%' THEN regexp_extract(name, '^(.+)\\s+\\(([^()]+)\\)\\s*$', 2) END AS place FROM x)
SELECT place, count(*) AS n FROM m JOIN base ON upper(b) = base.name GROUP BY 1""")
def branch_suffix(t: Tables) -> DataFrame:
    k, name = F.col("p_partkey"), F.col("p_name")
    null = F.lit(None).cast("string")
    branch = F.when(k % 3 == 0, F.concat(name, F.lit(" - Ottawa"))).when(k % 3 == 1, F.concat(name, F.lit(" (Laval)"))).otherwise(F.concat(name, F.lit("-Gander")))
    own = t.part.select(k.alias("entity_id"), branch.alias("canonical_name"), null.alias("bn_root"), null.alias("province"), F.lit("other_org").alias("entity_kind"))
    base = t.part.select(F.upper("p_name").alias("canonical_name")).distinct().select((-F.xxhash64("canonical_name")).alias("entity_id"), "canonical_name", F.lit("1").alias("bn_root"), null.alias("province"), F.lit("charity").alias("entity_kind"))
    roles = t.spark.createDataFrame([], "entity_id long, total_given double, total_received double")
    return merges.branch_variants(own.unionByName(base), roles).groupBy(F.col("branch_suffix").alias("place")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT c_custkey AS "merge", c_custkey - 1 AS keep FROM customer WHERE c_custkey % 10 IN (1, 2, 3)),
g AS (SELECT CASE WHEN o_custkey % 10 IN (1, 2, 3) THEN o_custkey - o_custkey % 10 ELSE o_custkey END AS entity, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders)
SELECT entity, CAST(sum(v) AS DOUBLE) AS total, count(*) AS n FROM g GROUP BY 1""")
def merge_remap(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    pairs = t.customer.where((k % 10).isin(1, 2, 3)).select((k - 1).alias("keep"), k.alias("merge"))
    rows = t.orders.select(F.col("o_custkey").alias("entity"), "o_totalprice")
    out = merges.remapped(rows, merges.final_targets(pairs), "entity")
    return doubles(out.groupBy("entity").agg(F.sum(money(F.col("o_totalprice"))).alias("total"), F.count("*").alias("n")), "total")


@query("""WITH c AS (SELECT doc_id % 50 AS entity, quality, doc_id FROM labels),
n AS (SELECT entity, count(*) AS n FROM c WHERE quality = 1 GROUP BY 1)
SELECT c.doc_id, CASE WHEN quality = 1 AND n.n > 1 THEN 'needs_review' WHEN quality = 1 THEN 'match' ELSE 'no_match' END AS status, CASE WHEN quality = 1 AND n.n > 1 THEN 'grant_entity_claimed_by_multiple_orgs' END AS flag
FROM c LEFT JOIN n ON c.entity = n.entity""")
def collision_downgrade(t: Tables) -> DataFrame:
    rows = t.labels.select("doc_id", (F.col("doc_id") % 50).alias("entity"), F.when(F.col("quality") == 1, "match").otherwise("no_match").alias("status"), F.lit(None).cast("string").alias("flag"))
    return discovery.reconcile_collisions(rows, "status", "match", "entity", "flag").select("doc_id", "status", "flag")


_POSTAL = "'H' || ({k} % 9) || chr(65 + CAST({k} % 7 AS INTEGER)) || ({k} % 5) || chr(65 + CAST({k} % 11 AS INTEGER)) || ({k} % 3)"


def _postal(k: str):
    c = F.col(k)
    letter = lambda n: F.char((F.lit(65) + c % n).cast("int"))
    return F.concat(F.lit("H"), (c % 9).cast("string"), letter(7), (c % 5).cast("string"), letter(11), (c % 3).cast("string"))


@query(f"""WITH r AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE {_POSTAL.format(k='c_custkey')} END AS postal, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE lower('City ' || c_nationkey) END AS city FROM customer),
s AS (SELECT CASE WHEN s_suppkey % 25 = 0 THEN {_POSTAL.format(k='s_suppkey')} END AS postal, lower('City ' || (s_nationkey % 12)) AS city FROM supplier), p AS (SELECT postal FROM s WHERE postal IS NOT NULL)
SELECT c_custkey, CASE WHEN postal IN (SELECT postal FROM p) THEN 'postal' WHEN substr(postal, 1, 3) IN (SELECT substr(postal, 1, 3) FROM p) THEN 'fsa' WHEN city IN (SELECT city FROM s) THEN 'city' ELSE '__no_blocking_key__' END AS block_level FROM r""")
def block_cascade(t: Tables) -> DataFrame:
    r = t.customer.select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("legal_name"), F.when(F.col("c_custkey") % 4 != 0, _postal("c_custkey")).alias("postal"), F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit("City "), F.col("c_nationkey").cast("string"))).alias("city"))
    s = t.supplier.select(F.when(F.col("s_suppkey") % 25 == 0, _postal("s_suppkey")).alias("cand_postal"), F.concat(F.lit("CITY "), (F.col("s_nationkey") % 12).cast("string")).alias("cand_city"), F.col("s_name").alias("cand_name"))
    return discovery.block_level(r, s).select(F.col("source_id").alias("c_custkey"), "block_level")


@query("""WITH n AS (SELECT DISTINCT p_name FROM part), p AS (SELECT a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name) AS d FROM n a JOIN n b ON a.p_name <> b.p_name AND substr(a.p_name, 1, 1) = substr(b.p_name, 1, 1)),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d, b) AS k FROM p)
SELECT a AS name, max(CASE WHEN k = 1 THEN b END) AS best, CAST(max(CASE WHEN k = 1 THEN d END) AS BIGINT) AS best_distance, CAST(max(CASE WHEN k = 2 THEN d END) AS BIGINT) AS runner_up FROM r WHERE k <= 2 GROUP BY 1""")
def best_and_runner_up(t: Tables) -> DataFrame:
    from ..operators.dedup import topk_per_group

    n = t.part.select("p_name").distinct()
    block = F.substring("p_name", 1, 1).alias("block")
    pairs = n.select(F.col("p_name").alias("a"), block).join(n.select(F.col("p_name").alias("b"), block), "block").where("a <> b").withColumn("d", F.levenshtein("a", "b"))
    top = topk_per_group(pairs, ["a"], [F.asc("d"), F.asc("b")], 2, keep_rank="k")
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    return longs(top.groupBy(F.col("a").alias("name")).agg(pick(1, "b").alias("best"), pick(1, "d").alias("best_distance"), pick(2, "d").alias("runner_up")), "best_distance", "runner_up")


@query()
def token_sort_best_match(t: Tables) -> DataFrame:
    """Discovery's scorer on part names; its ratio isn't a SQL function (tested against the quadratic table)."""
    n = t.part.select("p_name").distinct()
    r = n.select(F.xxhash64("p_name").alias("source_id"), F.concat("p_name", F.lit(" inc")).alias("legal_name"), F.array().cast("array<string>").alias("trade_names"), F.lit("x").alias("city"), F.lit(None).cast("string").alias("postal"))
    c = n.select(F.xxhash64("p_name").alias("cand_id"), F.col("p_name").alias("cand_name"), F.lit("x").alias("cand_city"), F.lit(None).cast("string").alias("cand_postal"), F.xxhash64("p_name").alias("ord"))
    return discovery.best_match(discovery.block_level(r, c), c).select("legal_name", "best_name", F.round("best_score", 6).alias("best_score"), F.round("runner_up_score", 6).alias("runner_up_score"))


@query("""WITH s AS (SELECT doc_id, 'src' || (doc_id % 3) AS source FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 'src' || (doc_id % 2) FROM labels WHERE quality = 1),
d AS (SELECT DISTINCT doc_id, source FROM s)
SELECT source, count(*) AS n FROM d GROUP BY 1 UNION ALL SELECT 'all', count(DISTINCT doc_id) FROM d""")
def exploded_by_source(t: Tables) -> DataFrame:
    src = lambda n: F.concat(F.lit("src"), (F.col("doc_id") % n).cast("string"))
    rows = t.labels.where("quality = 1").select(F.col("doc_id").alias("entity_id"), F.explode(F.array(src(3), src(2))).alias("source"))
    index = rows.groupBy("entity_id").agg(F.array_sort(F.collect_set("source")).alias("sources"))
    return discovery.by_source(index)


@query()
def resolve_entities(t: Tables) -> DataFrame:
    """Suppliers are the registry, customers and suppliers' name variants are the records; the result equals a sequential pass
    (tested against one)."""
    s = t.supplier
    bn = F.lpad((F.col("s_suppkey") + 100_000_000).cast("string"), 9, "0")
    name = F.concat(F.lit("Maple "), F.col("s_name"), F.lit(" Foundation"))
    prov = F.concat(F.lit("P"), (F.col("s_nationkey") % 10).cast("string"))
    idents = s.select(bn.alias("bn"), name.alias("name"), F.lit("c").alias("city"), prov.alias("province"), F.lit(2020).alias("source_year"), F.col("s_suppkey").alias("ord"))
    depts = t.nation.select(F.col("n_name").alias("code"), F.col("n_name").alias("title"))
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("MAPLE Supplier#"), F.lpad((k % 97).cast("string"), 9, "0"), F.lit(" Inc"))).otherwise(F.concat(F.lit("Club "), (k % 211).cast("string")))
    number = F.when(k % 4 == 0, F.lpad((k % 89 + 100_000_000).cast("string"), 9, "0")).when(k % 4 == 1, F.lpad((k % 53 + 200_000_000).cast("string"), 9, "0"))
    records = t.customer.select(k.alias("ord"), F.lit("orders").alias("source_dataset"), raw.alias("name"), number.alias("bn"), F.concat(F.lit("P"), (F.col("c_nationkey") % 10).cast("string")).alias("province"), (k % 2 == 0).alias("allow_fuzzy"))
    out = resolve.resolve(idents, depts, records, ["Arts Council"])
    return out.links.select("ord", "entity_id", "match_method", F.round("match_score", 4).alias("match_score"))


@query("""WITH p AS (SELECT p_partkey AS id, p_name, CAST(p_size * 1000 AS DOUBLE) AS flow FROM part), q AS (SELECT *, CASE WHEN lower(p_name) = 'red ring' THEN 1 WHEN starts_with(lower(p_name), 'red ring') THEN 2 ELSE 3 END AS tier FROM p WHERE regexp_matches(lower(p_name), '(^|[^a-zA-Z0-9])ring')),
m AS (SELECT *, max(CASE WHEN tier = 1 THEN flow END) OVER () AS top, count(*) OVER () AS total FROM q)
SELECT id AS entity_id, p_name AS canonical_name, flow AS total_flow, total FROM m ORDER BY flow DESC, id LIMIT 20""")
def ranked_search(t: Tables) -> DataFrame:
    ents = t.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("canonical_name"), F.lit("other_org").alias("entity_kind"), expr.fold(F.col("p_name")).alias("search_name"))
    roles = t.part.select(F.col("p_partkey").alias("entity_id"), (F.col("p_size") * 1000.0).cast("double").alias("total_given"), F.lit(0.0).alias("total_received"))
    return search.search_orgs(ents, roles, "ring", limit=20).select("entity_id", "canonical_name", "total_flow", "total")


@query("""WITH s AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS base FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS rn FROM s)
SELECT p_partkey, CASE WHEN rn = 1 THEN base ELSE base || '-' || p_partkey END AS slug FROM r""")
def slug_manifest(t: Tables) -> DataFrame:
    return search.slug_manifest(t.part, "p_name", "p_partkey")


@query(f"""WITH {FLOWS}, r AS (SELECT recipient AS entity_id, year, CAST(sum(amount) AS DOUBLE) AS received FROM flows GROUP BY 1, 2), g AS (SELECT funder AS entity_id, year, CAST(sum(amount) AS DOUBLE) AS given FROM flows WHERE year < 1999 GROUP BY 1, 2)
SELECT coalesce(r.entity_id, g.entity_id) AS entity_id, coalesce(r.year, g.year) AS fiscal_year, received, given FROM r FULL JOIN g ON r.entity_id = g.entity_id AND r.year = g.year""")
def timeline(t: Tables) -> DataFrame:
    f = t.flows()
    g = f.select(F.when(F.col("year") < 1999, F.col("funder")).alias("funder_entity_id"), F.col("recipient").alias("recipient_entity_id"), F.col("amount").alias("amount_cad"), F.col("year").alias("fiscal_year"), F.col("source").alias("source_dataset"))
    none = t.spark.createDataFrame([], "entity_id long, fiscal_year long, revenue_from_any_cdn_gov double, revenue_from_foundations double")
    out = search.timeline(g, none).where("entity_id is not null")
    return doubles(out.select("entity_id", "fiscal_year", "received", "given"), "received", "given")


@query("""WITH p AS (SELECT o_orderpriority AS dept, o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) AS v, nullif(o_orderstatus, 'P') AS st FROM orders),
m AS (SELECT dept, count(*) AS n_rows, count(*) FILTER (st IS NULL) AS bad FROM p GROUP BY 1)
SELECT dept, bad, n_rows FROM m WHERE bad > 0 ORDER BY bad DESC, dept LIMIT 3""")
def worst_offenders(t: Tables) -> DataFrame:
    m = t.orders.groupBy(F.col("o_orderpriority").alias("dept")).agg(F.count("*").alias("n_rows"), F.count_if(F.nullif("o_orderstatus", F.lit("P")).isNull()).alias("bad"))
    return quality.worst_offenders(m, "bad", 3, "n_rows").drop("pct")
