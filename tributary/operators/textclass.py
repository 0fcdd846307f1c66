"""Text classification bookkeeping: each distinct text is classified once, results are kept by (text_hash, prompt_version)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import expr
from ..session import ship
from .dedup import latest_amendment

STORE = "text_hash string, prompt_version int, text string, n_grants long, codes string, confidence string, quote string, flags string, status string, error string"


def grant_text_map(raw: DataFrame) -> DataFrame:
    """Latest agreements with their text, squeezed and hashed; blank texts go."""
    rows = latest_amendment(raw, "owner_org", "ref_number", "amendment_number", [F.col("agreement_value").asc_nulls_last(), F.col("recipient_legal_name").asc_nulls_last()])
    text = expr.blank_to_null(expr.squeezed(F.concat_ws(" ", "agreement_title_en", "description_en")))
    out = rows.select(F.trim("owner_org").alias("owner_org"), F.trim("ref_number").alias("ref_number"), "recipient_legal_name", F.col("recipient_business_number").alias("business_number"), expr.money(F.col("agreement_value")).alias("amount_cad"), text.alias("text"))
    return out.where("text is not null").withColumn("text_hash", F.sha2("text", 256))


def distinct_texts(mapped: DataFrame, limit: int | None = None) -> DataFrame:
    """Texts by how many agreements they cover, then by hash."""
    out = mapped.groupBy("text_hash").agg(F.min("text").alias("text"), F.count("*").alias("n_grants"))
    return out.orderBy(F.desc("n_grants"), "text_hash").limit(limit) if limit else out


def to_classify(texts: DataFrame, store: DataFrame, version: int, max_calls: int) -> DataFrame:
    """The next texts that have no result of this version."""
    done = store.where(F.col("prompt_version") == version).select("text_hash")
    return texts.join(done, "text_hash", "left_anti").orderBy(F.desc("n_grants"), "text_hash").limit(max_calls)


def abstain(text: str) -> dict:
    """The default classifier: it never says anything."""
    return {"codes": [], "confidence": "abstain", "quote": ""}


def classify(texts: DataFrame, classifier: Callable[[str], dict] = abstain, version: int = 1, retries: int = 3) -> DataFrame:
    """Results of a classifier that gets a text and returns codes, confidence and quote; it is asked again after an error, up to
    ``retries`` times, and a malformed answer is an error."""
    ship(texts.sparkSession)

    def ask(text: str) -> dict:
        error = ""
        for _ in range(retries):
            try:
                got = classifier(text)
                codes = got["codes"]
                if not isinstance(codes, list) or not all(isinstance(c, str) for c in codes) or got["confidence"] not in ("high", "medium", "low", "abstain"):
                    raise ValueError("malformed answer")
                return {"codes": ",".join(codes), "confidence": got["confidence"], "quote": str(got.get("quote") or ""), "status": "ok", "error": None}
            except Exception as e:  # noqa: BLE001  an outside service may raise anything
                error = f"{type(e).__name__}: {e}"
        return {"codes": None, "confidence": None, "quote": None, "status": "error", "error": error[:500]}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = pd.DataFrame([ask(t) for t in f["text"]], index=f.index, columns=["codes", "confidence", "quote", "status", "error"])
            yield pd.concat([f[["text_hash"]], pd.Series(version, f.index, name="prompt_version", dtype="int32"), f[["text", "n_grants"]], got[["codes", "confidence", "quote"]], pd.Series("", f.index, name="flags"), got[["status", "error"]]], axis=1)

    return texts.select("text_hash", "text", "n_grants").mapInPandas(run, STORE)


def enforce(results: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """A quote that isn't in its text, and codes that don't exist, turn an answer into an abstention with a flag."""
    known = taxonomy.select(F.col("code").alias("__code")).distinct()
    each = results.select("text_hash", "prompt_version", F.explode(F.filter(F.split(F.coalesce("codes", F.lit("")), ","), lambda c: c != "")).alias("__c"))
    bad = each.join(known, F.col("__c") == F.col("__code"), "left_anti").select("text_hash", "prompt_version").distinct().withColumn("__bad", F.lit(True))
    joined = results.join(bad, ["text_hash", "prompt_version"], "left")
    said = (F.col("status") == "ok") & (F.col("confidence") != "abstain")
    misquoted = said & ~expr.verbatim(F.col("quote"), F.col("text"))
    unknown = said & F.coalesce("__bad", F.lit(False))
    flag = F.concat_ws(",", expr.blank_to_null(F.col("flags")), F.when(misquoted, "quote_not_verbatim"), F.when(unknown, "unknown_code"))
    out = joined.withColumns({"flags": flag, "codes": F.when(misquoted | unknown, "").otherwise(F.col("codes")), "confidence": F.when(misquoted | unknown, "abstain").otherwise(F.col("confidence"))})
    return out.select(*results.columns)


def upsert(store: DataFrame, fresh: DataFrame, key: tuple[str, ...] = ("text_hash", "prompt_version")) -> DataFrame:
    """The store with fresh rows in the place of those of the same key."""
    return store.join(fresh.select(*key).distinct(), list(key), "left_anti").select(*store.columns).unionByName(fresh.select(*store.columns))


def grant_view(mapped: DataFrame, store: DataFrame, version: int) -> DataFrame:
    good = store.where((F.col("prompt_version") == version) & (F.col("status") == "ok")).select("text_hash", "codes", "confidence", "quote", "flags")
    return mapped.join(good, "text_hash")


def code_rollup(view: DataFrame) -> DataFrame:
    """Agreements and dollars by organisation and code."""
    each = view.select("recipient_legal_name", "business_number", "amount_cad", F.explode(F.filter(F.split(F.coalesce("codes", F.lit("")), ","), lambda c: c != "")).alias("code"))
    return each.groupBy("recipient_legal_name", "code").agg(F.min("business_number").alias("business_number"), F.count("*").alias("n_grants"), F.sum("amount_cad").alias("amount_cad"))


def cost_estimate(texts: DataFrame, prompt_chars: int, max_calls: int, per_million_in: float, per_million_out: float, out_tokens: int = 200, chars_per_token: float = 4.0) -> DataFrame:
    some = texts.orderBy(F.desc("n_grants"), "text_hash").limit(max_calls)
    tokens = (F.sum(F.length("text")) + F.count("*") * prompt_chars) / chars_per_token
    return some.agg(F.count("*").alias("calls"), F.sum("n_grants").alias("grants_covered"), tokens.alias("input_tokens"), (tokens * per_million_in / 1e6 + F.count("*") * out_tokens * per_million_out / 1e6).alias("cost"))


def agreement(view: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Against benchmark rows (ref_number, code): whether any code is related; references that several departments use are left
    out.  One row: compared, agree, ambiguous."""
    owners = view.groupBy("ref_number").agg(F.countDistinct("owner_org").alias("owners"))
    rows = benchmark.join(owners, "ref_number")
    clear = rows.where("owners = 1").join(view.select("ref_number", "codes"), "ref_number")
    hit = F.exists(F.split(F.coalesce("codes", F.lit("")), ","), lambda c: expr.codes_related(c, F.col("code")))
    a = clear.groupBy("ref_number", "code").agg(F.bool_or(hit).alias("hit")).agg(F.count("*").alias("compared"), F.count_if("hit").alias("agree"))
    return a.crossJoin(F.broadcast(rows.where("owners > 1").agg(F.count("*").alias("ambiguous"))))


def distribution(store: DataFrame) -> DataFrame:
    return store.groupBy("status", "confidence", "flags").agg(F.count("*").alias("n"), F.sum("n_grants").alias("n_grants"))


def taxonomy_paths(rows: DataFrame, order: str, levels: list[str]) -> DataFrame:
    """Forward-fill a hierarchy that is written once where it begins: deeper levels are reset when a higher one changes.

    A taxonomy is a few thousand rows in one sheet, hence one window over it."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows
    for i, level in enumerate(levels):
        above = [F.col(x).isNotNull() for x in levels[:i]]
        turn = reduce(lambda a, b: a | b, above, F.lit(False))
        last = F.max(F.when(turn, F.col(order))).over(w)
        here = F.max(F.when(F.col(level).isNotNull(), F.struct(F.col(order).alias("o"), F.col(level).alias("v")))).over(w)
        out = out.withColumn(f"path_{i}", F.when(last.isNull() | (here["o"] >= last), here["v"]))
    return out


def disagreements(view: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark rows that no answered code is related to, by their code and the first answered one, the most frequent first."""
    rows = benchmark.join(view.select("ref_number", "codes"), "ref_number")
    hit = F.exists(F.split(F.coalesce("codes", F.lit("")), ","), lambda c: expr.codes_related(c, F.col("code")))
    first = F.split_part(F.coalesce("codes", F.lit("")), F.lit(","), F.lit(1))
    return rows.where(~hit).groupBy("code", first.alias("answered")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "code", "answered")
