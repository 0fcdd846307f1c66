"""Data-quality reports over agreements.

All reports start from ``parse_agreements``; those marked latest run on the latest amendment of each agreement, the others on all
rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from .dedup import latest_amendment, positional_percentile, topk_per_group

#: Provinces and territories, agreement types, and the day from which more fields are mandatory.
PROVINCES = ("AB", "BC", "MB", "NB", "NL", "NS", "NT", "NU", "ON", "PE", "QC", "SK", "YT")
TYPES = ("C", "G", "O")
POLICY_DATE = "2025-12-01"
#: Columns that are mandatory always, and from the policy's day on.
ALWAYS = ("ref_number", "recipient_legal_name", "recipient_country", "recipient_city", "agreement_value", "agreement_type", "agreement_start_date", "description_en", "description_fr")
FROM_POLICY = (
    "recipient_type", "recipient_business_number", "recipient_postal_code", "federal_riding_number", "prog_name_en", "prog_name_fr", "prog_purpose_en", "prog_purpose_fr", "agreement_title_en",
    "agreement_title_fr", "agreement_end_date", "expected_results_en", "expected_results_fr",
)
#: What a spreadsheet writes for an empty date.
SPREADSHEET_NULL = "1899-12-30"


def _day(text: str) -> Column:
    return F.lit(text).cast("date")


def parse_agreements(raw: DataFrame) -> DataFrame:
    """The cleaning block: trimmed values with blanks as nulls, value, dates, amendment number and fiscal year.  Columns that the
    raw table lacks are null."""
    have = set(raw.columns)
    c = lambda n: expr.blank_to_null(F.col(n)) if n in have else F.lit(None).cast("string")
    out = raw.select(
        c("owner_org").alias("dept"), c("owner_org_title").alias("title"), c("ref_number").alias("ref"), F.coalesce(expr.to_int(F.col("amendment_number")), F.lit(0)).alias("amendment"), c("recipient_legal_name").alias("recipient"), c("recipient_business_number").alias("bn"), c("recipient_type").alias("rtype"),
        c("recipient_province").alias("prov"), c("recipient_country").alias("country"), c("recipient_city").alias("city"), c("recipient_postal_code").alias("postal"), c("federal_riding_number").alias("riding"), c("agreement_type").alias("atype"), F.trim("agreement_value").alias("value_raw"),
        expr.money(F.col("agreement_value")).alias("value"), c("agreement_start_date").alias("sd_raw"), expr.any_date(c("agreement_start_date")).alias("sd"), c("agreement_end_date").alias("ed_raw"), expr.any_date(c("agreement_end_date")).alias("ed"), c("prog_name_en").alias("program"), c("description_en").alias("desc_en"),
        c("description_fr").alias("desc_fr"), c("expected_results_en").alias("results_en"),
    )
    return out.withColumns({"fy": expr.fiscal_year(F.col("sd")), "norm_bn": expr.normalize_bn(F.col("bn")), "multi_year": expr.multi_year(F.col("sd"), F.col("ed"))})


def flags(parsed: DataFrame) -> DataFrame:
    """baddate (null without a date); badprov, badcountry, dirtytype, short_desc, zero_neg (false without a value)."""
    sd, given = F.col("sd"), lambda c: F.col(c).isNotNull()
    return parsed.withColumns({
        "baddate": (sd == _day(SPREADSHEET_NULL)) | (sd < _day("1990-01-01")) | (sd > _day("2026-12-31")), "badprov": given("prov") & ~F.coalesce(F.col("prov").isin(*PROVINCES), F.lit(True)),
        "badcountry": given("country") & ((F.col("country") != F.upper("country")) | (F.length("country") != 2)), "dirtytype": given("atype") & ~F.coalesce(F.col("atype").isin(*TYPES), F.lit(True)),
        "short_desc": given("desc_en") & (F.length("desc_en") < 50), "zero_neg": given("value") & (F.col("value") <= 0),
    })


def _pct(condition: Column) -> Column:
    return 100.0 * F.count_if(F.coalesce(condition, F.lit(False))).cast("double") / F.count("*")


def completeness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Filled and missing values of each column (blank is missing), from one aggregate that is turned on its side."""
    columns = list(columns or df.columns)
    missing = lambda c: F.count_if(F.col(f"`{c}`").isNull() | (F.trim(F.col(f"`{c}`").cast("string")) == ""))
    one = df.agg(F.count("*").alias("__n"), *[missing(c).alias(f"m{i}") for i, c in enumerate(columns)])
    parts = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing"), (F.col("__n") - F.col(f"m{i}")).alias("filled")) for i, c in enumerate(columns)])
    return one.select(F.explode(parts).alias("p"), "__n").select("p.*", F.try_divide(100.0 * F.col("p.filled"), F.col("__n")).alias("pct_filled"))


def field_completeness(raw: DataFrame) -> DataFrame:
    """completeness of all columns, with whether each is mandatory, conditional (mandatory from the policy's day on) or other; a
    mandatory or conditional one that the table lacks is missing throughout."""
    lacking = [c for c in (*ALWAYS, *FROM_POLICY) if c not in raw.columns]
    every = completeness(raw.withColumns({c: F.lit(None).cast("string") for c in lacking}) if lacking else raw)
    return every.withColumn("requirement", F.when(F.col("column").isin(*ALWAYS), "mandatory").when(F.col("column").isin(*FROM_POLICY), "conditional").otherwise("other"))


def value_counts(df: DataFrame, column: str, top: int | None = None, where: Column | None = None) -> DataFrame:
    """How often each value occurs, null and blank together; the most frequent first, then by value."""
    rows = df if where is None else df.where(where)
    out = rows.groupBy(F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")).alias("value")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "value").limit(top) if top else out


def money_stats(parsed: DataFrame, percents: Sequence[int] = (1, 5, 25, 50, 75, 95, 99)) -> tuple[DataFrame, DataFrame]:
    totals = parsed.agg(F.count("value").alias("n"), F.sum("value").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), F.count_if(F.col("value") == 0).alias("zero"), F.count_if(F.col("value") < 0).alias("negative"), F.count_if(expr.parse_failed(F.col("value_raw"), F.col("value"))).alias("unreadable"))
    return totals, positional_percentile(parsed, "value", percents)


def profile(raw: DataFrame) -> dict[str, DataFrame]:
    """The profiler's tables."""
    p = parse_agreements(raw)
    stats, percentiles = money_stats(p)
    text = F.length("desc_en")
    return {
        "completeness": completeness(raw), "money": stats, "percentiles": percentiles, "fiscal_years": p.groupBy("fy").agg(F.count("*").alias("n"), F.sum("value").alias("total")), "types": value_counts(p, "rtype"), "countries": value_counts(p, "country", 20), "provinces": value_counts(p, "prov"),
        "amendments": p.groupBy("amendment").agg(F.count("*").alias("n")), "dates": p.agg(F.min("sd").alias("first"), F.max("sd").alias("last"), F.count_if(expr.parse_failed(F.col("sd_raw"), F.col("sd"))).alias("unreadable"), F.count_if("multi_year").alias("multi_year"), F.count_if(F.col("ed") < F.col("sd")).alias("reversed")),
        "descriptions": p.agg(F.count("desc_en").alias("n"), F.avg(text).alias("mean_length"), F.max(text).alias("longest"), F.countDistinct("desc_en").alias("distinct")),
    }


#: Fields that are mandatory from the policy's day on, by the name of their count.
MANDATORY = {"pd_recipient_type": "rtype", "pd_biz_num": "bn", "pd_postal": "postal", "pd_riding": "riding", "pd_prog_name": "program", "pd_end_date": "ed_raw", "pd_exp_results": "results_en"}


def compliance(parsed: DataFrame) -> DataFrame:
    """One fused aggregate of 17 measures by department over all rows."""
    after = F.coalesce(F.col("sd") >= _day(POLICY_DATE), F.lit(False))
    return flags(parsed).groupBy("dept").agg(
        F.max("title").alias("title"), F.count("*").alias("total"), F.coalesce(F.sum("value"), F.lit(0)).alias("value_sum"), F.count_if(F.col("desc_en").isNull()).alias("missing_desc_en"), F.count_if(F.col("desc_fr").isNull()).alias("missing_desc_fr"),
        F.count_if("dirtytype").alias("dirty_type"), F.count_if("short_desc").alias("short_desc"), F.count_if("zero_neg").alias("zero_neg"), F.count_if(after).alias("post_dec_total"), *[F.count_if(after & F.col(c).isNull()).alias(n) for n, c in MANDATORY.items()],
    )


ISSUES = ("missing_desc_en", "missing_desc_fr", "dirty_type", "short_desc", "zero_neg")


def post_policy(matrix: DataFrame) -> DataFrame:
    """Shares of filled mandatory fields, of departments with agreements since the policy's day."""
    n = F.col("post_dec_total")
    return matrix.where(n > 0).select("dept", "title", "post_dec_total", *[(100.0 * (n - F.col(c)) / n).alias(c.replace("pd_", "pct_")) for c in MANDATORY])


def worst_offenders(matrix: DataFrame, issue: str, n: int = 10, total: str = "total") -> DataFrame:
    """The departments with most rows of an issue, and their share."""
    return matrix.where(F.col(issue) > 0).orderBy(F.desc(issue), "dept").limit(n).select("dept", issue, total, (F.lit(100.0) * F.col(issue) / F.col(total)).alias("pct"))


def exemplary(matrix: DataFrame, least: int = 50) -> DataFrame:
    """Departments with enough rows and not one issue."""
    total = sum((F.col(i) for i in ISSUES), F.lit(0))
    return matrix.where((F.col("total") >= least) & (total == 0)).select("dept", "total").orderBy(F.desc("total"), "dept")


def anomalies(parsed: DataFrame) -> DataFrame:
    """Odd dates, countries and provinces of each department: dept, anomaly, value, n.  Province values of two capitals are taken
    for foreign ones, others for invalid."""
    sd, prov, empty = F.col("sd"), F.col("prov"), F.col("sd") == _day(SPREADSHEET_NULL)
    odd = ~prov.isin(*PROVINCES)
    foreign = (F.length(prov) == 2) & (F.upper(prov) == prov)
    one = lambda when, name, value: F.when(when, F.struct(F.lit(name).alias("anomaly"), value.alias("value")))
    kinds = F.array_compact(F.array(
        one(empty, "spreadsheet null date", F.col("sd_raw")), one((sd < _day("1990-01-01")) & ~empty, "before 1990", F.col("sd_raw")), one(sd > _day("2026-12-31"), "after 2026", F.col("sd_raw")),
        one(F.col("country") != F.upper("country"), "lower-case country", F.col("country")), one(odd & foreign, "foreign province", prov), one(odd & ~foreign, "invalid province", prov),
    ))
    return parsed.select("dept", F.explode(kinds).alias("k")).select("dept", "k.*").groupBy("dept", "anomaly", "value").agg(F.count("*").alias("n"))


def latest(raw: DataFrame) -> DataFrame:
    return latest_amendment(raw, "owner_org", "ref_number", "amendment_number", [F.col("agreement_value").asc_nulls_last(), F.col("recipient_legal_name").asc_nulls_last()])


FAULTS = ("nodesc_en", "nodesc_fr", "short", "dirty", "zeroneg", "baddate", "badgeo", "nobn")


def quality_by_department(raw: DataFrame, least: int = 100) -> DataFrame:
    """Latest: number, dollars and shares of eight faults, for departments with enough agreements."""
    rows = flags(parse_agreements(latest(raw)))
    faults = (F.col("desc_en").isNull(), F.col("desc_fr").isNull(), F.col("short_desc"), F.col("dirtytype"), F.col("zero_neg"), F.col("baddate"), F.col("badprov") | F.col("badcountry"), F.col("bn").isNull())
    out = rows.groupBy("dept").agg(F.max("title").alias("title"), F.count("*").alias("n"), F.sum(F.coalesce("value", F.lit(0))).alias("dollars"), *[_pct(c).alias(f"pct_{n}") for n, c in zip(FAULTS, faults, strict=True)])
    return out.where(F.col("n") >= least)


def mandatory_fields(raw: DataFrame, least: int = 10) -> DataFrame:
    """Latest, since the policy's day: shares of missing riding, business number and postal code by department."""
    rows = parse_agreements(latest(raw)).where(F.col("sd") >= _day(POLICY_DATE))
    out = rows.groupBy("dept").agg(F.coalesce(F.max("title"), F.col("dept")).alias("title"), F.count("*").alias("n"), *[_pct(F.col(c).isNull()).alias(f"pct_{c}") for c in ("riding", "bn", "postal")])
    return out.where(F.col("n") >= least)


def dirty_values(raw: DataFrame, flag: str, column: str, k: int = 3) -> DataFrame:
    """Latest: each department's most frequent faulty values."""
    rows = flags(parse_agreements(latest(raw))).where(F.col(flag))
    tally = rows.groupBy("dept", F.col(column).alias("value")).agg(F.count("*").alias("n"))
    return topk_per_group(tally, ["dept"], [F.col("n").desc(), F.col("value").asc()], k)


def specimens(raw: DataFrame, condition: Column, order: Sequence[Column], n: int = 10) -> DataFrame:
    """Latest: the first rows of a fault, as they are."""
    return flags(parse_agreements(latest(raw))).where(condition).orderBy(*order).limit(n)


def specimen_jar(raw: DataFrame) -> DataFrame:
    """Latest: the first few specimens of nine faults: category, dept, ref, recipient, value, note."""
    p = flags(parse_agreements(latest(raw)))
    v, ref = F.col("value"), F.col("ref").asc()
    most, least = [v.desc_nulls_last(), ref], [v.asc_nulls_last(), ref]
    each = lambda by: topk_per_group(p.where(F.col("baddate") & F.col("sd_raw").isNotNull()) if by == "sd_raw" else p.where("badprov"), [by], [F.coalesce(v, F.lit(0)).desc(), ref], 1)
    start = F.substring(F.coalesce("desc_en", F.lit("")), 1, 90)
    jar = (
        ("nodesc", p.where((v > 10_000_000) & (F.col("desc_en").isNull() | (F.length("desc_en") < 15))), most, 4, F.coalesce("desc_en", F.lit("(no description at all)"))), ("neg", p.where(v < 0), least, 3, start),
        ("dates", each("sd_raw"), [F.col("sd").asc(), ref], 4, F.col("sd_raw")), ("geo", each("prov"), [F.coalesce(v, F.lit(0)).desc(), ref], 4, F.concat(F.lit("province: '"), "prov", F.lit("'"))), ("batch", p.where(F.col("recipient").ilike("%batch report%")), most, 4, F.lit("")),
        ("amend", p, [F.col("amendment").desc(), ref], 4, F.concat(F.col("amendment").cast("string"), F.lit(" amendments"))), ("placeholder", p.where(F.col("ed_raw").like("9999%")), most, 4, F.col("sd_raw")), ("nominal", p.where((v > 0) & (v < 10)), least, 4, start),
        ("punct", p.where(F.col("desc_en").rlike("^[^a-zA-Z0-9]+$")), most, 4, F.col("desc_en")),
    )
    out = None
    for name, rows, order, n, note in jar:
        part = rows.orderBy(*order).limit(n).select(F.lit(name).alias("category"), "dept", "ref", "recipient", "value", note.alias("note"))
        out = part if out is None else out.unionByName(part)
    return out


def dashboard(raw: DataFrame) -> dict[str, DataFrame]:
    """Latest: hero totals, series by fiscal year, departments, facts, the biggest and the most amended."""
    p, every = flags(parse_agreements(latest(raw))), parse_agreements(raw)
    v, sd = F.col("value"), F.col("sd")
    years = p.where(sd.between(_day("2005-04-01"), _day("2027-03-31"))).groupBy("fy").agg(F.count("*").alias("n"), F.sum(F.coalesce("value", F.lit(0))).alias("total"))
    hero = p.agg(F.count("*").alias("agreements"), F.sum("value").alias("dollars"), F.countDistinct("dept").alias("departments"), F.min(F.when(sd >= _day("2000-01-01"), sd)).alias("first"), F.max(F.when(sd <= _day("2027-12-31"), sd)).alias("last"))
    return {
        "totals": hero.crossJoin(F.broadcast(every.agg(F.count("*").alias("__all")))).withColumn("superseded", F.col("__all") - F.col("agreements")).drop("__all"), "series": years,
        "departments": p.groupBy("dept").agg(F.max("title").alias("title"), F.count("*").alias("n"), F.sum(F.coalesce("value", F.lit(0))).alias("dollars"), _pct(F.col("desc_en").isNull()).alias("pct_nodesc"), _pct(F.col("short_desc")).alias("pct_short"), _pct(F.col("dirtytype")).alias("pct_dirty"), _pct(F.col("zero_neg")).alias("pct_zeroneg")).where("n >= 100"),
        "facts": p.agg(F.count_if(v == 1.0).alias("one_dollar"), F.count_if((v > 0) & (v < 100)).alias("tiny"), F.count_if(v < 0).alias("neg_n"), F.coalesce(F.sum(F.when(v < 0, v)), F.lit(0.0)).alias("neg_sum"), F.count_if(sd == _day(SPREADSHEET_NULL)).alias("excel"), F.count_if(F.col("ed") >= _day("2040-01-01")).alias("farfuture")),
        "most_amended": every.groupBy("ref").agg(F.max("amendment").alias("amendment"), F.max("recipient").alias("recipient")).orderBy(F.desc("amendment"), "ref").limit(1), "biggest": p.where("value is not null").orderBy(F.desc("value"), "dept", "ref").limit(5).select("recipient", "dept", "value", F.year("sd").alias("year")),
    }


def evidence_rows(classified: DataFrame, category: str, cap: int = 50) -> DataFrame:
    """The organisations of a category, the most dollars first."""
    return classified.where(F.col("category") == category).groupBy("recipient").agg(F.sum("amount").alias("dollars"), F.count("*").alias("n")).orderBy(F.desc("dollars"), "recipient").limit(cap)


def qualifying(evidence: DataFrame) -> DataFrame:
    """Interventions (intervention_id, status) that get a page: those with any entry that is not unverified."""
    return evidence.groupBy("intervention_id").agg(F.bool_or(~F.startswith(F.trim("status"), F.lit("unverified"))).alias("ok")).where("ok").select("intervention_id")


def markdown(df: DataFrame, limit: int = 100) -> str:
    """A small result as a Markdown table."""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |\n|" + " - |" * len(df.columns)
    return head + "".join("\n| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)
