"""Event study: treatment events, naive and matched contrasts, the regression panel and a two-way fixed-effects estimate.

Inputs
  receipts   bn_root, fiscal_year, amount            (sums by year and recipient)
  donations  bn_root, fiscal_year, donations, revenue
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import money, normalize_bn, pct_change
from .dedup import latest_by, topk_per_group

WINDOW, MIN_OBS, MAX_CONTROLS, WINSOR = 3, 2, 5, 0.01


def yearly_receipts(grants: DataFrame, entities: DataFrame, sources: Sequence[str], first: int = 1990, last: int = 2030, strict_source: str = "federal_gc") -> DataFrame:
    """Sums by number and year; years out of range are dropped for one source alone."""
    junk = (F.col("source_dataset") == strict_source) & ~F.col("fiscal_year").between(first, last)
    rows = grants.where(F.col("source_dataset").isin(*sources)).where(~junk)
    own = entities.where("bn_root is not null").select(F.col("entity_id").alias("recipient_entity_id"), "bn_root")
    return rows.join(own, "recipient_entity_id").groupBy("bn_root", "fiscal_year").agg(F.sum("amount_cad").alias("amount"))


def donations_panel(filings: DataFrame) -> DataFrame:
    """Donations (line 4500) by number and year, of the latest filing of each year: bn_root, fiscal_year, donations."""
    rows = filings.select(normalize_bn(F.col("BN")).alias("bn_root"), F.year(F.col("FPE").try_cast("date")).alias("fiscal_year"), money(F.col("4500")).alias("donations"), "source_year", "BN").where("bn_root is not null and fiscal_year is not null")
    return latest_by(rows, ["bn_root", "fiscal_year"], [F.col("source_year").desc_nulls_last(), F.col("BN").asc(), F.col("donations").desc_nulls_last()]).select("bn_root", "fiscal_year", "donations")


def unit_provinces(entities: DataFrame) -> DataFrame:
    """One province for each number, that of its lowest entity, so that units aren't multiplied."""
    return latest_by(entities.where("bn_root is not null"), ["bn_root"], [F.col("entity_id").asc()]).select("bn_root", "province")


def treatment_events(receipts: DataFrame, threshold: float, years: Sequence[int]) -> DataFrame:
    """Units whose first year with receipts is one of these years and reaches the threshold: bn_root, Y."""
    first = receipts.groupBy("bn_root").agg(F.min_by("amount", "fiscal_year").alias("amount"), F.min("fiscal_year").alias("Y"))
    return first.where((F.col("amount") >= threshold) & F.col("Y").isin(*years)).select("bn_root", "Y")


def never_treated(donations: DataFrame, receipts: DataFrame) -> DataFrame:
    return donations.select("bn_root").distinct().join(receipts.select("bn_root"), "bn_root", "left_anti")


def window_stats(events: DataFrame, donations: DataFrame, window: int = WINDOW, min_obs: int = MIN_OBS) -> DataFrame:
    """Mean donations before and after each event, with enough years on either side and a positive mean before."""
    year, y = F.col("fiscal_year"), F.col("Y")
    before, after = year.between(y - window, y - 1), year.between(y + 1, y + window)
    joined = events.join(donations.select("bn_root", "fiscal_year", "donations"), "bn_root").where((before | after) & F.col("donations").isNotNull())
    stats = joined.groupBy("bn_root", "Y").agg(F.avg(F.when(before, F.col("donations"))).alias("pre_mean"), F.avg(F.when(after, F.col("donations"))).alias("post_mean"), F.count_if(before).alias("n_pre"), F.count_if(after).alias("n_post"))
    good = stats.where((F.col("n_pre") >= min_obs) & (F.col("n_post") >= min_obs) & (F.col("pre_mean") > 0))
    return good.withColumn("pct", pct_change(F.col("pre_mean"), F.col("post_mean")))


def pool_events(pool: DataFrame, years: Sequence[int]) -> DataFrame:
    """Each control unit under each cohort year (a handful of them), without a join."""
    return pool.select("bn_root", F.explode(F.array(*[F.lit(y) for y in years])).alias("Y"))


def naive_contrast(treated: DataFrame, controls: DataFrame) -> DataFrame:
    """Medians of the change by cohort year, treated and pool."""
    med = lambda df, n: df.groupBy("Y").agg(F.median("pct").alias(f"{n}_median"), F.count("*").alias(f"n_{n}"))
    out = med(treated, "treated").join(med(controls, "control"), "Y", "left")
    return out.withColumn("difference", F.col("treated_median") - F.col("control_median"))


def covariates(events: DataFrame, donations: DataFrame, provinces: DataFrame) -> DataFrame:
    """events with the year before's revenue and donations, the trend of donations over two years, and the province."""
    lag = lambda k, cols: donations.select("bn_root", (F.col("fiscal_year") + k).alias("Y"), *[F.col(c).alias(n) for c, n in cols])
    out = events.join(lag(1, [("revenue", "revenue"), ("donations", "d1")]), ["bn_root", "Y"], "left").join(lag(3, [("donations", "d3")]), ["bn_root", "Y"], "left")
    return out.withColumn("trend", F.when(F.col("d3") > 0, pct_change(F.col("d3"), F.col("d1")))).join(provinces, "bn_root", "left")


def bucketed(df: DataFrame, by: str, value: str, parts: int, least: int, out: str) -> DataFrame:
    """Quantile buckets as pandas' qcut with dropped duplicate edges makes them: interpolated edges, intervals closed on the right,
    the first one on both sides; -1 for nulls and for groups with fewer than ``least`` values, 0 if all edges are one."""
    edges = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("__by")).agg(F.expr(f"percentile({value}, array({', '.join(str(i / parts) for i in range(parts + 1))}))").alias("__e"), F.count("*").alias("__n"))
    edges = edges.select("__by", "__n", F.array_sort(F.array_distinct("__e")).alias("__e"))
    joined = df.join(F.broadcast(edges), df[by] == F.col("__by"), "left")
    place = F.size(F.filter("__e", lambda e: e < F.col(value))) - 1
    bucket = F.when(F.col(value).isNull() | F.col("__n").isNull() | (F.col("__n") < least), -1).when(F.size("__e") < 2, 0).otherwise(F.greatest(F.lit(0), place))
    return joined.withColumn(out, bucket).drop("__by", "__n", "__e")


def with_buckets(df: DataFrame) -> DataFrame:
    """Revenue deciles and trend terciles by cohort year."""
    return bucketed(bucketed(df, "Y", "revenue", 10, 10, "decile"), "Y", "trend", 3, 3, "tercile")


def match_controls(treated: DataFrame, controls: DataFrame, max_controls: int = MAX_CONTROLS) -> DataFrame:
    """Up to ``max_controls`` controls of the same year and province for each treated unit: those of its decile and tercile; if
    there is none, of its decile; if there is none, of the province.  The nearest in revenue first, then by number.

    Which tier holds is found by counts of cells.  Within a cell units are sorted by revenue, and each treated one meets only the
    controls next to it on either side, and the first of those without a revenue: no pairs of a cell are formed."""
    tiers = (("decile_trend", ["Y", "province", "decile", "tercile"]), ("decile", ["Y", "province", "decile"]), ("province", ["Y", "province"]))
    out = None
    open_ = treated.where("province is not null")
    for name, keys in tiers:
        cells = controls.select(*keys).distinct()
        here = open_.join(cells, keys, "left_semi")
        open_ = open_.join(cells, keys, "left_anti")
        t = here.select(*keys, F.col("bn_root").alias("treated_bn"), F.col("revenue").alias("__r"))
        c = controls.select(*keys, F.col("bn_root").alias("control_bn"), F.col("revenue").alias("__c"))
        part = _nearest(t, c, keys, max_controls).select("treated_bn", "Y", "control_bn", F.lit(name).alias("tier"), F.abs(F.col("__r") - F.col("__c")).alias("distance"))
        out = part if out is None else out.unionByName(part)
    return topk_per_group(out, ["treated_bn", "Y"], [F.col("distance").asc_nulls_last(), F.col("control_bn").asc()], max_controls)


def _nearest(t: DataFrame, c: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """(keys, treated_bn, __r, control_bn, __c): a few controls of the cell among which each treated unit's k nearest are."""
    cell = Window.partitionBy(*keys)
    some = t.where("__r is not null")
    sides = None
    for sign in (1, -1):
        # In order of revenue (or against it): how many controls come before a treated unit, and each control's place.
        c_rows = c.where("__c is not null").select(*keys, (F.col("__c") * sign).alias("v"), F.lit(1).alias("is_control"), F.col("control_bn").alias("id"))
        t_rows = some.select(*keys, (F.col("__r") * sign).alias("v"), F.lit(0).alias("is_control"), F.col("treated_bn").alias("id"))
        placed = c_rows.unionByName(t_rows).withColumn("at", F.sum("is_control").over(cell.orderBy("v", "is_control", "id").rowsBetween(Window.unboundedPreceding, 0)))
        wanted = placed.where("is_control = 0").select(*keys, F.col("id").alias("treated_bn"), F.col("v").alias("tv"), F.explode(F.sequence(F.col("at") + 1, F.col("at") + k)).alias("at"))
        side = wanted.join(placed.where("is_control = 1").select(*keys, "at", F.col("id").alias("control_bn"), F.col("v").alias("cv")), [*keys, "at"])
        side = side.select(*keys, "treated_bn", (F.col("tv") * sign).alias("__r"), "control_bn", (F.col("cv") * sign).alias("__c"))
        sides = side if sides is None else sides.unionByName(side)
    names = [*keys, "treated_bn", "__r", "control_bn", "__c"]
    bare = some.join(topk_per_group(c.where("__c is null"), keys, [F.col("control_bn").asc()], k), list(keys)).select(*names)
    blank = t.where("__r is null").join(topk_per_group(c, keys, [F.col("control_bn").asc()], k), list(keys)).select(*names)
    return sides.unionByName(bare).unionByName(blank).distinct()


def matched_contrast(treated: DataFrame, controls: DataFrame, matches: DataFrame) -> DataFrame:
    """By cohort year, the median over treated units of their change less their controls' mean change."""
    c = matches.join(controls.select(F.col("bn_root").alias("control_bn"), "Y", F.col("pct").alias("c_pct")), ["control_bn", "Y"])
    mean = c.groupBy(F.col("treated_bn").alias("bn_root"), "Y").agg(F.avg("c_pct").alias("control_pct"), F.count("*").alias("n_controls"))
    return treated.join(mean, ["bn_root", "Y"]).withColumn("d", F.col("pct") - F.col("control_pct")).groupBy("Y").agg(F.median("d").alias("median_difference"), F.count("*").alias("n"))


def regression_panel(treated: DataFrame, matches: DataFrame, donations: DataFrame, window: int = WINDOW) -> DataFrame:
    """Years around the event, without its own, of treated and matched units: unit, bn_root, Y, fiscal_year, treated, post,
    log_donations; years without positive donations are dropped."""
    t = treated.select("bn_root", "Y", F.lit(1).alias("treated"))
    c = matches.select(F.col("control_bn").alias("bn_root"), "Y", F.lit(0).alias("treated")).distinct()
    rows = t.unionByName(c).join(donations.select("bn_root", "fiscal_year", "donations"), "bn_root")
    year, y = F.col("fiscal_year"), F.col("Y")
    rows = rows.where(year.between(y - window, y + window) & (year != y) & (F.col("donations") > 0))
    return rows.select(F.concat("bn_root", F.lit("_Y"), y.cast("string")).alias("unit"), "bn_root", "Y", "fiscal_year", "treated", (year > y).cast("int").alias("post"), F.ln("donations").alias("log_donations"))


def two_way_fe(panel: DataFrame) -> dict[str, float] | None:
    """The coefficient of treated x post with unit and year effects, its standard error clustered by bn_root (CRV1), and counts.

    The unit effect is taken out by distributed demeaning.  The year effect and the slope are then normal equations in one column
    for each year: sums of products by unit, added up by Spark, so the driver solves a system as large as there are years.
    Clusters' scores come from one more aggregate."""
    rows = panel.select("unit", "bn_root", F.col("fiscal_year").cast("int").alias("t"), (F.col("treated") * F.col("post")).cast("double").alias("x"), F.col("log_donations").cast("double").alias("y"), "treated")
    head = rows.agg(F.countDistinct("unit").alias("units"), F.countDistinct("treated").alias("arms"), F.count("*").alias("n"), F.countDistinct("bn_root").alias("g"), F.sort_array(F.collect_set("t")).alias("years")).first()
    if head["units"] < 4 or head["arms"] < 2:
        return None
    years = head["years"][1:]
    own = Window.partitionBy("unit")
    dummies = {f"d{i}": (F.col("t") == y).cast("double") for i, y in enumerate(years)}
    base = rows.withColumns(dummies)
    names = ["x", *dummies]
    centred = base.withColumns({c: F.col(c) - F.avg(c).over(own) for c in [*names, "y"]})
    products = centred.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"p_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i], *[F.sum(F.col(a) * F.col("y")).alias(f"q_{i}") for i, a in enumerate(names)]).first()
    k = len(names)
    xx = np.array([[products[f"p_{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)
    inverse = np.linalg.pinv(xx)
    beta = inverse @ np.array([products[f"q_{i}"] for i in range(k)], float)
    fitted = sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, names, strict=True)), F.lit(0.0))
    lead = sum((F.lit(float(w)) * F.col(c) for w, c in zip(inverse[0], names, strict=True)), F.lit(0.0))
    score = centred.groupBy("bn_root").agg(F.sum(lead * (F.col("y") - fitted)).alias("s")).agg(F.sum(F.col("s") * F.col("s"))).first()[0]
    g, n = head["g"], head["n"]
    small = (g / (g - 1)) * ((n - 1) / max(1, n - k)) if g > 1 else float("nan")
    return {"coefficient": float(beta[0]), "std_error": float(np.sqrt(max(0.0, score) * small)), "n": float(n), "units": float(head["units"]), "clusters": float(g)}


def winsorized_median(df: DataFrame, value: str = "pct", share: float = WINSOR, by: Sequence[str] = ()) -> DataFrame:
    """The median after values are clipped at the ``share`` and 1 - ``share`` quantiles (interpolated)."""
    ends = df.groupBy(*by).agg(F.expr(f"percentile({value}, array({share}, {1 - share}))").alias("__q"))
    joined = df.join(F.broadcast(ends), list(by)) if by else df.crossJoin(F.broadcast(ends))
    clipped = F.least(F.greatest(F.col(value), F.col("__q")[0]), F.col("__q")[1])
    return joined.withColumn("__c", clipped).groupBy(*by).agg(F.median("__c").alias("winsorized_median"), F.count("__c").alias("n"))


def contrast(receipts: DataFrame, donations: DataFrame, threshold: float, years: Sequence[int], shift: int = 0, only: DataFrame | None = None) -> DataFrame:
    """The naive contrast; ``shift`` moves events (a placebo), ``only`` restricts them to (bn_root, Y) pairs."""
    events = treatment_events(receipts, threshold, years)
    if only is not None:
        events = events.join(only, ["bn_root", "Y"], "left_semi")
    events = events.withColumn("Y", F.col("Y") + shift)
    pool = pool_events(never_treated(donations, receipts), [y + shift for y in years])
    return naive_contrast(window_stats(events, donations), window_stats(pool, donations))


def threshold_sensitivity(receipts: DataFrame, donations: DataFrame, years: Sequence[int], thresholds: Sequence[float] = (50_000.0, 250_000.0)) -> DataFrame:
    parts = [contrast(receipts, donations, t, years).withColumn("threshold", F.lit(t)) for t in thresholds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def exact_pairs(events: DataFrame, grants: DataFrame, links: DataFrame, entities: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Events of (unit, year) with a grant of these sources that year whose recipient an exact number links in the grant's own source."""
    exact = links.where("match_method = 'exact_bn'").select(F.col("entity_id").alias("recipient_entity_id"), "source_dataset").distinct()
    given = grants.where(F.col("source_dataset").isin(*sources)).select("recipient_entity_id", "source_dataset", F.col("fiscal_year").alias("Y")).distinct().join(exact, ["recipient_entity_id", "source_dataset"])
    own = entities.where("bn_root is not null").select(F.col("entity_id").alias("recipient_entity_id"), "bn_root")
    return events.join(given.join(own, "recipient_entity_id").select("bn_root", "Y").distinct(), ["bn_root", "Y"], "left_semi")


def panel(treated: DataFrame, matches: DataFrame, controls: DataFrame, stats: DataFrame, exact: DataFrame) -> DataFrame:
    """The study's table: treated units and their matched controls, with covariates, window statistics where there are any, the
    tier of the match, and whether an exact number links the treated unit."""
    flag = exact.select("bn_root", "Y").distinct().withColumn("exact_bn", F.lit(True))
    t = treated.withColumns({"arm": F.lit("treated"), "tier": F.lit(None).cast("string"), "matched_to": F.lit(None).cast(treated.schema["bn_root"].dataType)}).join(flag, ["bn_root", "Y"], "left").withColumn("exact_bn", F.coalesce("exact_bn", F.lit(False)))
    m = matches.select(F.col("control_bn").alias("bn_root"), "Y", "tier", F.col("treated_bn").alias("matched_to"))
    c = controls.join(m, ["bn_root", "Y"]).withColumns({"arm": F.lit("control"), "exact_bn": F.lit(None).cast("boolean")})
    return t.unionByName(c).join(stats.select("bn_root", "Y", "pre_mean", "post_mean", "pct"), ["bn_root", "Y"], "left")
