"""Writers: tables, review files, keyed stores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def save_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Replace a Parquet table; partitions by year and the like are pruned by later filters."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def save_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; ``single`` for review queues that people open, which are small."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def discovery_outputs(rows: DataFrame, folder: str, names: Mapping[str, str]) -> None:
    """The flagged file and its review queues.  ``names`` maps full, charity_review, social_review and, if wanted, grant_review to
    folder names, which must differ."""
    if len(set(names.values())) < len(names):
        raise ValueError("outputs need different names")
    queues = {"full": None, "charity_review": "charity_status", "social_review": "social_status", "grant_review": "federal_grant_status"}
    for kind, name in names.items():
        status = queues[kind]
        save_csv(rows if status is None else rows.where(F.col(status) == "needs_review"), f"{folder}/{name}")


def upsert_table(path: str, store: DataFrame, fresh: DataFrame, key: Sequence[str], staging: str) -> None:
    """Replace a keyed store by itself with fresh rows in place of those of equal keys; written aside first, since a table can't be
    read and overwritten at once."""
    from ..operators.textclass import upsert

    upsert(store, fresh, tuple(key)).write.mode("overwrite").parquet(staging)
    store.sparkSession.read.parquet(staging).write.mode("overwrite").parquet(path)
