"""Registration of queries with their SQL, and the views that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Tables of one directory, by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A view that several parts of a query use: written when it is first asked for."""
        if name not in self._made:
            self._made[name] = written(make(), name)
        return self._made[name]

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def flows(self) -> DataFrame:
        """Supplier nations fund customer nations: funder, recipient, amount, year, source."""
        o = self.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_orderpriority")
        rows = self.lineitem.select("l_orderkey", "l_suppkey", "l_extendedprice").join(o, "l_orderkey").join(self.customer.select("c_custkey", "c_nationkey"), "c_custkey").join(self.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey"), "l_suppkey")
        return rows.select(F.col("s_nationkey").cast("long").alias("funder"), F.col("c_nationkey").cast("long").alias("recipient"), money(F.col("l_extendedprice")).alias("amount"), F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderpriority").alias("source"))

    def yearly_flows(self) -> DataFrame:
        """The flows summed by funder, recipient, year and source, written once."""
        return self._once("flows", lambda: self.flows().groupBy("funder", "recipient", "year", "source").agg(F.sum("amount").alias("amount"), F.count("*").alias("n")))

    def panel(self) -> DataFrame:
        """Customers' yearly sums, written once: receipts (urgent orders), donations (all other orders)."""
        return self._once("panel", self._panel)

    def _panel(self) -> DataFrame:
        urgent = F.col("o_orderpriority") == "1-URGENT"
        return self.orders.groupBy(F.col("o_custkey").alias("bn_root"), F.year("o_orderdate").alias("fiscal_year")).agg(F.sum(F.when(urgent, money(F.col("o_totalprice")))).cast("double").alias("receipts"), F.sum(F.when(~urgent, money(F.col("o_totalprice")))).cast("double").alias("donations"))

    def receipts(self) -> DataFrame:
        return self.panel().where("receipts is not null").select("bn_root", "fiscal_year", F.col("receipts").alias("amount"))

    def donations(self) -> DataFrame:
        return self.panel().where("donations is not null").select("bn_root", "fiscal_year", "donations", F.col("donations").alias("revenue"))


FLOWS = """flows AS (
    SELECT CAST(s.s_nationkey AS BIGINT) AS funder, CAST(c.c_nationkey AS BIGINT) AS recipient, CAST(l.l_extendedprice AS DECIMAL(18,2)) AS amount,
           CAST(year(o.o_orderdate) AS BIGINT) AS year, o.o_orderpriority AS source
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey JOIN supplier s ON l.l_suppkey = s.s_suppkey)"""
PANEL = """panel AS (
    SELECT o_custkey AS bn_root, year(o_orderdate) AS fiscal_year,
           CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS receipts,
           CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS donations
    FROM orders GROUP BY 1, 2),
receipts AS (SELECT bn_root, fiscal_year, receipts AS amount FROM panel WHERE receipts IS NOT NULL),
donations AS (SELECT bn_root, fiscal_year, donations, donations AS revenue FROM panel WHERE donations IS NOT NULL)"""


def money(x: Column) -> Column:
    return x.cast("decimal(18,2)")


def query(sql: str | None = None) -> Callable:
    """Register a function of Tables under its name, with the SQL of the same result."""

    def put(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def longs(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("long") for n in names})


def doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), 6) for n in names})
