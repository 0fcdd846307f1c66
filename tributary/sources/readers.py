"""Tolerant readers: everything is a string until it is parsed on purpose, and what can't be read is counted."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expr

CORRUPT = "_corrupt_record"


def csv_strings(spark: SparkSession, path: str | Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """A CSV file with a header, all columns strings; quoted fields may span lines; empty unquoted fields are null."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", encoding)
    return reader.csv(path if isinstance(path, str) else list(path), inferSchema=False)


def csv_with_rejects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The well-formed rows, with their file, and the number of rejected rows by file.

    Rows with too many or too few fields, or broken quotes, are malformed; quoted fields may span lines."""
    header = csv_strings(spark, path).schema
    schema = T.StructType([*header.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", True).option("columnPruning", False)
    rows = reader.csv(path).withColumn("filename", F.col("_metadata.file_path"))
    good = rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    # Spark doesn't count corrupt records alone without parsing something: every column is looked at.
    parsed = F.length(F.concat_ws("", *[F.col(f"`{f.name}`") for f in header.fields])) >= 0
    return good, rows.groupBy("filename").agg(F.count_if(F.col(CORRUPT).isNotNull() & parsed).alias("rejected"), F.count("*").alias("rows"))


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows, over all columns that any frame has; missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def yearly_csv(spark: SparkSession, paths: Sequence[str], pattern: str = r"(\d{4})\.csv$") -> DataFrame:
    """Files whose columns may differ by year, with filename and the year in it as source_year."""
    parts = [csv_strings(spark, p).withColumn("filename", F.col("_metadata.file_path")) for p in paths]
    year = F.regexp_extract("filename", pattern, 1)
    return union_by_name(parts).withColumn("source_year", F.when(year != "", year).try_cast("int"))


def renamed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Columns renamed by place; another number of columns than expected is an error, not a guess."""
    if len(df.columns) != len(names):
        raise ValueError(f"expected {len(names)} columns, found {len(df.columns)}: {df.columns}")
    return df.toDF(*names)


def curated(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def inline(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A few constant rows, to be broadcast."""
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads it from."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def merge_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(keep, merge) pairs of a reviewed file; no file means none, and rows with a blank id are skipped."""
    if not exists(spark, path):
        return spark.createDataFrame([], "keep long, merge long")
    ids = csv_strings(spark, path).select(expr.to_int(F.col("entity_id_keep")).cast("long").alias("keep"), expr.to_int(F.col("entity_id_merge")).cast("long").alias("merge"))
    return ids.where("keep is not null and merge is not null")


def provincial_registry(companies: DataFrame, names: DataFrame, island_only: bool = True, legal_form: str = "APE", active: str = "IM") -> DataFrame:
    """Active non-profits of one legal form with their current legal and trade names, as discovery records."""
    null = F.lit(None).cast("string")
    own = companies.where((F.trim("COD_FORME_JURI") == legal_form) & (F.trim("COD_STAT_IMMAT") == active))
    third, second = expr.blank_to_null(F.col("ADR_DOMCL_LIGN3_ADR")), expr.blank_to_null(F.col("ADR_DOMCL_LIGN2_ADR"))
    own = own.select("NEQ", F.concat_ws(", ", expr.blank_to_null(F.col("ADR_DOMCL_LIGN1_ADR")), second).alias("address"), expr.clean_city(F.coalesce(third, second)).alias("city"), expr.normalize_postal(F.col("ADR_DOMCL_LIGN4_ADR")).alias("postal"))
    current = names.where(F.trim("STAT_NOM") == "V")
    kind, name = F.trim("TYP_NOM_ASSUJ"), expr.strip(F.col("NOM_ASSUJ"))
    wide = current.groupBy("NEQ").agg(F.max(F.when(kind == "N", name)).alias("legal_name"), F.array_sort(F.collect_set(F.when(kind == "A", name))).alias("trade_names"))
    out = own.join(wide, "NEQ").where("legal_name is not null")
    if island_only:
        out = out.where(expr.on_island(F.col("city"), F.col("postal")))
    return out.select(F.col("NEQ").alias("source_id"), "legal_name", "trade_names", "address", "city", "postal", null.alias("bn"), F.lit("QC").alias("jurisdiction"), F.lit("req").alias("discovery_source"), F.lit(legal_form).alias("legal_form"))


def federal_registry(rows: DataFrame, act: str = "Canada Not-for-profit Corporations Act") -> DataFrame:
    """Corporations under one act, with a name, as discovery records."""
    first, second = expr.blank_to_null(F.col("Corporate name - form 1")), expr.blank_to_null(F.col("Corporate name - form 2"))
    own = rows.where(F.trim("Governing legislation") == act)
    trade = F.when(first.isNotNull() & second.isNotNull(), F.array(second)).otherwise(F.array().cast("array<string>"))
    out = own.select(
        F.trim("Corporation number").alias("source_id"), F.coalesce(first, second).alias("legal_name"), trade.alias("trade_names"), F.trim("Street").alias("address"), expr.blank_to_null(F.col("City/town")).alias("city"), expr.normalize_postal(F.col("Postal code")).alias("postal"),
        expr.normalize_bn(F.col("Business number (BN)")).alias("bn"), F.trim("Province/territory").alias("jurisdiction"), F.lit("cc").alias("discovery_source"), F.lit(act).alias("legal_form"),
    )
    return out.where("legal_name is not null")


def charity_registry(idents: DataFrame, region: str | None = "quebec") -> DataFrame:
    """The latest row of each charity as discovery candidates, of a province, an island, or all (None)."""
    from ..operators.discovery import latest_registry

    rows = latest_registry(idents).withColumn("postal", expr.normalize_postal(F.col("postal")))
    if region == "quebec":
        rows = rows.where(expr.in_province(F.col("province")))
    elif region == "montreal":
        rows = rows.where(expr.on_island(F.col("city"), F.col("postal")))
    return rows.select(F.col("bn_root").alias("cand_id"), F.col("name").alias("cand_name"), F.col("city").alias("cand_city"), F.col("postal").alias("cand_postal"), F.col("bn_root").alias("cand_bn"), F.col("first_seen").alias("ord"), "registry_status")


def interventions(spark: SparkSession, yaml_text: str) -> DataFrame:
    """Evidence entries of a YAML document (read on the driver: a page or two), one row each, with the comment that follows each
    "status:" line, which a parser would drop."""
    import yaml

    comments = {}
    at = -1
    for line in yaml_text.splitlines():
        text = line.strip().removeprefix("- ").strip()
        if text.startswith("status:"):
            at += 1
            _, _, comment = text.partition("#")
            comments[at] = comment.strip() or None
    rows, n = [], 0
    for item in yaml.safe_load(yaml_text) or []:
        for entry in item.get("evidence", []):
            rows.append((str(item.get("id")), item.get("name"), entry.get("source"), str(entry.get("status")), comments.get(n)))
            n += 1
    return spark.createDataFrame(rows, "intervention_id string, name string, source string, status string, comment string")


def parse_status(status: str) -> tuple[str, str | None]:
    """("verified", date or None), ("unverified", None) or ("editorial", None); anything else is an error."""
    import re

    text = status.strip()
    if m := re.fullmatch(r"verified(?:[_ -](\d{4}-\d{2}-\d{2}))?", text):
        return "verified", m[1]
    if text in ("unverified", "editorial"):
        return text, None
    raise ValueError(f"an unknown status: {status!r}")
