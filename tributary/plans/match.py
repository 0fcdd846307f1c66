"""Discovery, text classification and scalar functions over analogue tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import discovery, textclass
from .base import Tables, doubles, longs, money, query
from .graph import _ENT, _entities

# --- discovery ------------------------------------------------------------------------------------------------------------

#: Records with the best candidate that some scorer found: customers against suppliers, levels and scores by key.
_HITS = """cand AS (SELECT s_suppkey AS cand_id, CASE WHEN s_suppkey % 3 <> 0 THEN lpad(CAST(s_suppkey AS VARCHAR), 9, '1') END AS cand_bn, s_name AS cand_name, s_suppkey % 9 + 1 AS n_grants, CAST(s_suppkey * 10 AS DOUBLE) AS total_amount FROM supplier),
hits AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN lpad(CAST(c_custkey % 12 AS VARCHAR), 9, '1') WHEN c_custkey % 7 = 1 THEN '999999999' END AS bn, CASE WHEN c_custkey % 6 = 0 THEN '__no_blocking_key__' ELSE 'city' END AS block_level,
  CASE WHEN c_custkey % 6 <> 0 AND c_custkey % 5 <> 0 THEN c_custkey % 10 END AS best_id, CASE WHEN c_custkey % 6 <> 0 AND c_custkey % 5 <> 0 THEN CAST(60 + c_custkey % 41 AS DOUBLE) END AS best_score FROM customer),
j AS (SELECT h.*, x.cand_bn AS best_bn, x.cand_name AS best_name FROM hits h LEFT JOIN cand x ON x.cand_id = best_id)"""


def _candidates(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("cand_id"), F.when(k % 3 != 0, F.lpad(k.cast("string"), 9, "1")).alias("cand_bn"), F.col("s_name").alias("cand_name"), (k % 9 + 1).alias("n_grants"), (k * 10).cast("double").alias("total_amount"))


def _hits(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    some = (k % 6 != 0) & (k % 5 != 0)
    bn = F.when(k % 7 == 0, F.lpad((k % 12).cast("string"), 9, "1")).when(k % 7 == 1, "999999999")
    rows = t.customer.select(k.alias("source_id"), bn.alias("bn"), F.when(k % 6 == 0, discovery.NO_KEY).otherwise("city").alias("block_level"), F.when(some, k % 10).alias("best_id"), F.when(some, (k % 41 + 60).cast("double")).alias("best_score"))
    names = _candidates(t).select(F.col("cand_id").alias("best_id"), F.col("cand_name").alias("best_name"))
    return rows.join(names, "best_id", "left").withColumn("runner_up_score", F.col("best_score") - 1)


_NUMBERS = "num AS (SELECT cand_bn AS bn, min(cand_name) AS bn_name, min(cand_id) AS bn_id FROM cand WHERE cand_bn IS NOT NULL GROUP BY 1)"


@query(f"""WITH {_HITS}, {_NUMBERS} SELECT id, CASE WHEN bn_name IS NOT NULL THEN 'registered_charity' WHEN block_level <> 'city' THEN 'needs_review' WHEN best_score IS NULL OR best_score < 75 THEN 'non_charity_nonprofit'
  WHEN best_score < 90 OR bn IS NOT NULL AND bn IS DISTINCT FROM best_bn THEN 'needs_review' ELSE 'registered_charity' END AS status,
  CASE WHEN bn_name IS NOT NULL THEN bn WHEN block_level = 'city' AND best_score >= 75 THEN best_bn END AS matched_bn, CASE WHEN bn_name IS NOT NULL THEN CAST(100 AS DOUBLE) WHEN block_level = 'city' THEN best_score END AS score,
  CASE WHEN bn_name IS NOT NULL THEN NULL WHEN block_level <> 'city' THEN 'no_blocking_key' WHEN best_score IS NULL OR best_score < 75 THEN NULL WHEN best_score >= 90 AND bn IS NOT NULL AND bn IS DISTINCT FROM best_bn THEN 'bn_contradicts_fuzzy_match' WHEN best_score < 90 THEN 'mid_band_score' END AS flag,
  CASE WHEN bn_name IS NOT NULL THEN 'exact_bn' WHEN block_level = 'city' AND best_score >= 75 THEN 'fuzzy' END AS method FROM j LEFT JOIN num USING (bn)""")
def classified_charities(t: Tables) -> DataFrame:
    out = discovery.classify_charity(_hits(t), _candidates(t))
    return out.select(F.col("source_id").alias("id"), F.col("charity_status").alias("status"), "matched_bn", F.col("charity_match_score").alias("score"), F.col("review_flag").alias("flag"), F.col("charity_match_method").alias("method"))


@query(f"""WITH {_HITS} SELECT id, CASE WHEN best_score >= 90 THEN 'social_purpose' WHEN best_score >= 75 THEN 'needs_review' ELSE 'not_social' END AS status, CASE WHEN best_score >= 75 THEN 'programme' END AS signal,
  CASE WHEN best_score >= 90 THEN NULL WHEN best_score >= 75 THEN 'mid_band_score' WHEN best_score IS NULL THEN 'residual_no_signal' ELSE 'residual_below_floor' END AS flag FROM hits""")
def classified_social(t: Tables) -> DataFrame:
    c = discovery.classify_social(F.col("best_score"), F.lit("programme"))
    return _hits(t).select(F.col("source_id").alias("id"), c["social_status"].alias("status"), c["social_signal"].alias("signal"), c["social_review_flag"].alias("flag"))


_GRANTED = f"""{_HITS}, {_NUMBERS}, cls AS (SELECT id, CASE WHEN bn_name IS NOT NULL THEN 'federal_grant_match' WHEN block_level <> 'city' THEN 'needs_review' WHEN best_score IS NULL OR best_score < 75 THEN 'no_match' WHEN best_score >= 90 THEN 'federal_grant_match' ELSE 'needs_review' END AS status,
  CASE WHEN bn_name IS NOT NULL THEN bn_id WHEN block_level = 'city' AND best_score >= 75 THEN best_id END AS entity, CASE WHEN bn_name IS NOT NULL THEN CAST(100 AS DOUBLE) WHEN block_level = 'city' THEN best_score END AS score,
  CASE WHEN bn_name IS NOT NULL THEN NULL WHEN block_level <> 'city' THEN 'no_blocking_key' WHEN best_score >= 75 AND best_score < 90 THEN 'mid_band_score' END AS flag FROM j LEFT JOIN num USING (bn))"""


@query(f"WITH {_GRANTED} SELECT id, status, entity, score, flag, CAST(n_grants AS BIGINT) AS n_grants FROM cls LEFT JOIN cand ON cand_id = entity")
def classified_grants(t: Tables) -> DataFrame:
    out = discovery.classify_grants(_hits(t), _candidates(t))
    return longs(out.select(F.col("source_id").alias("id"), F.col("federal_grant_status").alias("status"), F.col("matched_grant_entity_id").alias("entity"), F.col("federal_grant_match_score").alias("score"), F.col("grant_review_flag").alias("flag"), F.col("federal_grants_received").alias("n_grants")), "n_grants")


@query(f"WITH {_GRANTED} SELECT id, CASE WHEN status = 'federal_grant_match' AND score < 100 THEN 'needs_review' ELSE status END AS status, CASE WHEN status = 'federal_grant_match' AND score < 100 THEN 'low_confidence_fuzzy_match' ELSE flag END AS flag FROM cls")
def low_confidence(t: Tables) -> DataFrame:
    out = discovery.reconcile_low_confidence(discovery.classify_grants(_hits(t), _candidates(t)), "federal_grant_status", "federal_grant_match", "federal_grant_match_score", "grant_review_flag")
    return out.select(F.col("source_id").alias("id"), F.col("federal_grant_status").alias("status"), F.col("grant_review_flag").alias("flag"))


_SUMS = """g AS (SELECT o_custkey % 25 + 100 AS entity_id, CASE o_orderkey % 3 WHEN 0 THEN 'Housing First ' || (o_orderkey % 5) WHEN 1 THEN 'Roads' END AS program, CASE WHEN o_orderkey % 8 = 1 THEN 'For Seniors' END AS description, CAST(o_totalprice AS DECIMAL(18,2)) AS v,
  CASE WHEN o_orderkey % 2 = 0 THEN 'federal_gc' ELSE 'otf' END AS source FROM orders)"""


def _federal(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(
        (F.col("o_custkey") % 25 + 100).alias("recipient_entity_id"), F.when(k % 3 == 0, F.concat(F.lit("Housing First "), (k % 5).cast("string"))).when(k % 3 == 1, "Roads").alias("program_name"), F.when(k % 8 == 1, "For Seniors").alias("description"),
        money(F.col("o_totalprice")).alias("amount_cad"), F.when(k % 2 == 0, "federal_gc").otherwise("otf").alias("source_dataset"),
    )


@query(f"WITH {_ENT}, {_SUMS} SELECT entity_id AS cand_id, canonical_name AS cand_name, count(*) AS n_grants, CAST(sum(v) AS DOUBLE) AS total_amount FROM ent JOIN g USING (entity_id) WHERE entity_kind = 'other_org' AND province = ' qc ' AND source = 'federal_gc' GROUP BY 1, 2")
def grant_recipients(t: Tables) -> DataFrame:
    return doubles(discovery.grant_recipients(_entities(t), _federal(t), province="QC").select("cand_id", "cand_name", "n_grants", "total_amount"), "total_amount")


@query(f"WITH {_ENT}, {_SUMS} SELECT entity_id AS cand_id, canonical_name AS cand_name, min(program) AS program_name FROM ent JOIN g USING (entity_id) WHERE source = 'federal_gc' AND (program LIKE 'Housing%' OR description IS NOT NULL) GROUP BY 1, 2")
def social_grants(t: Tables) -> DataFrame:
    return discovery.social_grants(_entities(t), _federal(t)).select("cand_id", "cand_name", "program_name")


@query("""WITH d AS (SELECT doc_id, quality, toxic, doc_id % 30 AS e, 'src' || (doc_id % 4) AS s FROM labels) SELECT CAST(e AS BIGINT) AS entity_id, array_to_string(list_sort(list(DISTINCT s)), ',') AS sources, min('Org ' || doc_id) AS legal_name FROM d WHERE quality = 1 AND toxic = 0 AND e > 0 GROUP BY 1""")
def badge_index(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    rows = t.labels.select(
        F.when(F.col("quality") == 1, "non_charity_nonprofit").otherwise("registered_charity").alias("charity_status"), F.when(F.col("toxic") == 0, "federal_grant_match").otherwise("needs_review").alias("federal_grant_status"), F.when(k % 30 > 0, k % 30).alias("matched_grant_entity_id"),
        F.concat(F.lit("src"), (k % 4).cast("string")).alias("discovery_source"), F.concat(F.lit("Org "), k.cast("string")).alias("legal_name"),
    )
    return discovery.badge_index(rows).withColumn("sources", F.concat_ws(",", "sources"))


@query("""SELECT c_custkey AS source_id, c_name AS legal_name, 'A; B' AS trade_names, CASE WHEN c_custkey % 3 = 0 THEN 'one' WHEN c_custkey % 3 = 1 THEN 'two' ELSE 'three' END AS review_flag, '2026-01-01' AS cra_snapshot_date, CAST(NULL AS VARCHAR) AS social_signal FROM customer""")
def discovery_rows(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    found = t.customer.select(k.alias("source_id"), F.col("c_name").alias("legal_name"), F.array(F.lit("A"), F.lit("B")).alias("trade_names"), F.when(k % 3 == 0, "one").alias("review_flag"), F.when(k % 3 < 2, "two").alias("social_review_flag"), F.lit("three").alias("grant_review_flag"))
    out = discovery.output_rows(found, cra_snapshot_date="2026-01-01")
    return out.select("source_id", "legal_name", "trade_names", "review_flag", "cra_snapshot_date", "social_signal")


@query("""WITH r AS (SELECT o_custkey AS k, o_orderkey % 4 + 2000 AS y, o_orderkey FROM orders), l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY y DESC, o_orderkey) AS rn, min(o_orderkey) OVER (PARTITION BY k) AS seen FROM r)
SELECT lpad(CAST(k AS VARCHAR), 9, '0') AS bn_root, CAST(y AS BIGINT) AS source_year, seen AS first_seen, CASE WHEN y = (SELECT max(y) FROM r) THEN 'active' ELSE 'revoked_or_inactive' END AS registry_status FROM l WHERE rn = 1""")
def latest_registry(t: Tables) -> DataFrame:
    idents = t.orders.select(F.concat(F.lpad(F.col("o_custkey").cast("string"), 9, "0"), F.lit("RR0001")).alias("bn"), (F.col("o_orderkey") % 4 + 2000).alias("source_year"), F.col("o_orderkey").alias("ord"))
    return longs(discovery.latest_registry(idents).select("bn_root", "source_year", "first_seen", "registry_status"), "source_year", "first_seen")


@query("""WITH x AS (SELECT c_custkey AS id, c_custkey % 5 AS m, c_custkey IN (SELECT s_suppkey FROM supplier) AS twin, c_custkey % 5 = 1 OR c_custkey % 50 NOT IN (SELECT s_suppkey % 50 FROM supplier) AS no_key FROM customer)
SELECT id, CASE WHEN no_key THEN 'needs_review' WHEN twin AND m IN (0, 3) THEN 'registered_charity' WHEN twin AND m = 4 THEN 'needs_review' ELSE 'non_charity_nonprofit' END AS status,
  CASE WHEN twin AND m = 0 THEN 'exact_bn' WHEN twin AND m IN (3, 4) THEN 'fuzzy' END AS method, CASE WHEN no_key THEN 'no_blocking_key' WHEN twin AND m = 4 THEN 'bn_contradicts_fuzzy_match' END AS flag FROM x""")
def discovery_cascade(t: Tables) -> DataFrame:
    """The whole cascade over names that are equal or have next to nothing in common."""
    k = F.col("c_custkey")
    name = F.sha2(k.cast("string"), 256)
    records = t.customer.select(
        k.alias("source_id"), F.when(k % 5 == 2, F.lit("0 1 2")).otherwise(F.concat(name, F.lit(" Inc"))).alias("legal_name"), F.array().cast("array<string>").alias("trade_names"), F.when(k % 5 == 1, "nowhere").otherwise(F.concat(F.lit("City "), (k % 50).cast("string"))).alias("city"),
        F.lit(None).cast("string").alias("postal"), F.when(k % 5 == 0, F.lpad(k.cast("string"), 9, "0")).when(k % 5 == 4, "999999999").alias("bn"),
    )
    s = F.col("s_suppkey")
    charities = t.supplier.select(s.alias("cand_id"), F.sha2(s.cast("string"), 256).alias("cand_name"), F.concat(F.lit("CITY "), (s % 50).cast("string")).alias("cand_city"), F.lit(None).cast("string").alias("cand_postal"), F.lpad(s.cast("string"), 9, "0").alias("cand_bn"), s.alias("ord"))
    out = discovery.discover(records, charities)
    return out.select(F.col("source_id").alias("id"), F.col("charity_status").alias("status"), F.col("charity_match_method").alias("method"), F.col("review_flag").alias("flag"))


# --- text classification --------------------------------------------------------------------------------------------------

_STORE = """store AS (SELECT d.doc_id, sha256(CAST(d.doc_id AS VARCHAR)) AS text_hash, l.quality + 1 AS prompt_version, d.n_chars AS n_grants, CASE d.doc_id % 4 WHEN 0 THEN 'A1,B2' WHEN 1 THEN 'A1' WHEN 2 THEN 'X9' ELSE '' END AS codes,
  CASE WHEN d.doc_id % 4 = 3 THEN 'abstain' ELSE 'high' END AS confidence, CASE WHEN d.doc_id % 9 = 0 THEN 'error' ELSE 'ok' END AS status, d.doc_id % 3 = 0 AS misquoted FROM documents d JOIN labels l USING (doc_id))"""


def _store(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    rows = t.documents.select("doc_id", "text", "n_chars").join(t.labels.select("doc_id", "quality"), "doc_id")
    text = F.concat(F.lit("Every text has THIS quote. "), F.coalesce("text", F.lit("")))
    return rows.select(
        F.sha2(k.cast("string"), 256).alias("text_hash"), (F.col("quality") + 1).cast("int").alias("prompt_version"), text.alias("text"), F.col("n_chars").cast("long").alias("n_grants"), F.when(k % 4 == 0, "A1,B2").when(k % 4 == 1, "A1").when(k % 4 == 2, "X9").otherwise("").alias("codes"),
        F.when(k % 4 == 3, "abstain").otherwise("high").alias("confidence"), F.when(k % 3 == 0, "that no text has ☃").otherwise("has  this\nQuote").alias("quote"), F.lit("").alias("flags"), F.when(k % 9 == 0, "error").otherwise("ok").alias("status"), F.lit(None).cast("string").alias("error"),
    )


@query(f"""WITH {_STORE}, f AS (SELECT *, status = 'ok' AND confidence <> 'abstain' AND misquoted AS a, status = 'ok' AND confidence <> 'abstain' AND codes = 'X9' AS b FROM store)
SELECT text_hash, CASE WHEN a AND b THEN 'quote_not_verbatim,unknown_code' WHEN a THEN 'quote_not_verbatim' WHEN b THEN 'unknown_code' ELSE '' END AS flags, CASE WHEN a OR b THEN '' ELSE codes END AS codes, CASE WHEN a OR b THEN 'abstain' ELSE confidence END AS confidence FROM f""")
def quote_enforcement(t: Tables) -> DataFrame:
    taxonomy = t.spark.createDataFrame([("A1",), ("B2",)], "code string")
    return textclass.enforce(_store(t), taxonomy).select("text_hash", "flags", "codes", "confidence")


@query(f"""WITH {_STORE} SELECT text_hash FROM store WHERE text_hash NOT IN (SELECT text_hash FROM store WHERE prompt_version = 1) ORDER BY n_grants DESC, text_hash LIMIT 100""")
def resume_skip(t: Tables) -> DataFrame:
    s = _store(t)
    return textclass.to_classify(s.select("text_hash", "text", "n_grants"), s, 1, 100).select("text_hash")


@query(f"""WITH {_STORE}, v AS (SELECT 'Org ' || (doc_id % 6) AS org, codes FROM store WHERE prompt_version = 2 AND status = 'ok'), e AS (SELECT org, unnest(string_split(codes, ',')) AS code FROM v)
SELECT org, code, count(*) AS n_grants, CAST(2 * count(*) AS DOUBLE) AS amount FROM e WHERE code <> '' GROUP BY 1, 2""")
def code_list_rollup(t: Tables) -> DataFrame:
    k = F.col("doc_id")
    mapped = t.documents.select(F.sha2(k.cast("string"), 256).alias("text_hash"), F.concat(F.lit("Org "), (k % 6).cast("string")).alias("recipient_legal_name"), F.lit("1").alias("business_number"), F.lit(2.0).alias("amount_cad"))
    out = textclass.code_rollup(textclass.grant_view(mapped, _store(t), 2))
    return out.select(F.col("recipient_legal_name").alias("org"), "code", "n_grants", F.col("amount_cad").alias("amount"))


@query(f"WITH {_STORE} SELECT status, confidence, count(*) AS n, CAST(sum(n_grants) AS BIGINT) AS n_grants FROM store GROUP BY 1, 2")
def answer_distribution(t: Tables) -> DataFrame:
    return textclass.distribution(_store(t)).drop("flags")


@query("""WITH s AS (SELECT length(text) AS n, n_chars, doc_id FROM documents ORDER BY n_chars DESC, sha256(CAST(doc_id AS VARCHAR)) LIMIT 50)
SELECT count(*) AS calls, CAST(sum(n_chars) AS BIGINT) AS grants_covered, round((sum(n) + count(*) * 900) / 4.0, 4) AS input_tokens, round((sum(n) + count(*) * 900) / 4.0 * 0.25 / 1e6 + count(*) * 200 * 1.25 / 1e6, 8) AS cost FROM s""")
def cost_estimate(t: Tables) -> DataFrame:
    texts = t.documents.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"), F.col("n_chars").cast("long").alias("n_grants"))
    out = textclass.cost_estimate(texts, 900, 50, 0.25, 1.25)
    return out.select("calls", "grants_covered", F.round("input_tokens", 4).alias("input_tokens"), F.round("cost", 8).alias("cost"))


_CODED = """v AS (SELECT doc_id % 70 AS ref, 'd' || (doc_id % 3 * CAST(doc_id % 70 < 20 AS INTEGER)) AS owner, CASE doc_id % 3 WHEN 0 THEN '01020000' WHEN 1 THEN '01020300,09000000' ELSE '' END AS codes FROM documents),
b AS (SELECT p_partkey AS ref, CASE p_partkey % 3 WHEN 0 THEN '01020000' WHEN 1 THEN '01020304' ELSE '09000000' END AS code FROM part),
r AS (SELECT b.ref, code, codes, (codes <> '' AND (starts_with(code, '0102') AND codes LIKE '0102%' OR code = '09000000' AND contains(codes, '09000000'))) AS hit FROM b JOIN v USING (ref))"""


def _coded(t: Tables) -> tuple[DataFrame, DataFrame]:
    k, p = F.col("doc_id"), F.col("p_partkey")
    view = t.documents.select((k % 70).alias("ref_number"), F.concat(F.lit("d"), F.when(k % 70 < 20, k % 3).otherwise(F.lit(0)).cast("string")).alias("owner_org"), F.when(k % 3 == 0, "01020000").when(k % 3 == 1, "01020300,09000000").otherwise("").alias("codes"))
    bench = t.part.select(p.alias("ref_number"), F.when(p % 3 == 0, "01020000").when(p % 3 == 1, "01020304").otherwise("09000000").alias("code"))
    return view, bench


@query(f"""WITH {_CODED}, o AS (SELECT ref, count(DISTINCT owner) AS n FROM v GROUP BY 1), a AS (SELECT r.ref, code, bool_or(hit) AS hit FROM r JOIN o USING (ref) WHERE n = 1 GROUP BY 1, 2)
SELECT count(*) AS compared, count(*) FILTER (hit) AS agree, (SELECT count(*) FROM b JOIN o USING (ref) WHERE n > 1) AS ambiguous FROM a""")
def benchmark_agreement(t: Tables) -> DataFrame:
    return textclass.agreement(*_coded(t))


@query(f"WITH {_CODED} SELECT code, split_part(codes, ',', 1) AS answered, count(*) AS n FROM r WHERE NOT hit GROUP BY 1, 2")
def benchmark_disagreements(t: Tables) -> DataFrame:
    return textclass.disagreements(*_coded(t))


@query("""SELECT sha256(CAST(doc_id AS VARCHAR)) AS text_hash, CASE WHEN length(text) % 5 = 0 THEN NULL WHEN length(text) % 2 = 0 THEN 'EVEN' ELSE 'ODD,LONG' END AS codes, CASE WHEN length(text) % 5 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN length(text) % 5 = 0 THEN 'ValueError: malformed answer' END AS error FROM documents WHERE text IS NOT NULL""")
def classified_texts(t: Tables) -> DataFrame:
    def rule(text: str) -> dict:
        n = len(text)
        return {"codes": "no list" if n % 5 == 0 else ["EVEN"] if n % 2 == 0 else ["ODD", "LONG"], "confidence": "high"}

    texts = t.documents.where("text is not null").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("text_hash"), "text", F.lit(1).cast("long").alias("n_grants"))
    return textclass.classify(texts, rule).select("text_hash", "codes", "status", "error")


@query("""SELECT CAST(r_regionkey * 100 + n_nationkey AS BIGINT) AS ord, r_name AS path_0, n_name AS path_1 FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey * 100 - 1, r_name, NULL FROM region""")
def taxonomy_paths(t: Tables) -> DataFrame:
    null = F.lit(None).cast("string")
    heads = t.region.select((F.col("r_regionkey") * 100 - 1).cast("long").alias("ord"), F.col("r_name").alias("one"), null.alias("two"))
    leaves = t.nation.select((F.col("n_regionkey") * 100 + F.col("n_nationkey")).cast("long").alias("ord"), null.alias("one"), F.col("n_name").alias("two"))
    return textclass.taxonomy_paths(heads.unionByName(leaves), "ord", ["one", "two"]).select("ord", "path_0", "path_1")


# --- scalar functions -----------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey AS k, 'Oeuvre Strasse Lodz-' || c_custkey AS ascii, 'Café' || c_custkey AS shown, 'CAFE' || c_custkey || ' NORD' AS norm FROM customer""")
def transliterated(t: Tables) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    name = F.concat(F.lit("Café"), k, F.lit(" | Coffee"))
    return t.customer.select(F.col("c_custkey").alias("k"), expr.transliterate(F.concat(F.lit("Oeuvre Straße Łódź–"), k, F.lit("漢"))).alias("ascii"), expr.display_name(name).alias("shown"), expr.normalize_name(F.concat(F.lit("The Café"), k, F.lit(" du Nord, Inc. | X"))).alias("norm"))


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey AS VARCHAR) WHEN c_custkey % 3 = 1 THEN 'A ' || c_custkey || ' / B;A ' || c_custkey || ';B' ELSE '' END AS variants FROM customer""")
def name_variants(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(F.lit("A "), k.cast("string"), F.lit(" / B")))
    return t.customer.select(k.alias("k"), F.concat_ws(";", expr.name_variants(name)).alias("variants"))


@query("""SELECT c_custkey AS k, c_custkey % 4 = 0 AS double_space, c_custkey % 4 = 1 AS comma, upper(CASE WHEN c_custkey % 2 = 0 THEN 'on' ELSE 'qu' END) || '|' || substr('NAME' || c_custkey, 1, 4) AS block FROM customer""")
def person_shapes(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, "Anne-Marie  D'Arc").when(k % 4 == 1, "Tremblay, Émile J.").when(k % 4 == 2, "Moving, Inc.").otherwise("Anne Marie")
    block = expr.block_key(F.when(k % 2 == 0, " on").otherwise("Quebec"), F.concat(F.lit("NAME"), k.cast("string")))
    return t.customer.select(k.alias("k"), expr.individual_donee(name).alias("double_space"), expr.individual_comma(name).alias("comma"), block.alias("block"))


@query("""SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN '1B,2019' WHEN 1 THEN '2019,7A' WHEN 2 THEN '3' ELSE '' END AS tokens, c_custkey % 4 <> 1 AND c_custkey % 4 <> 3 AS same_as_self_or_year FROM customer""")
def digit_gate(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, "CIRCUIT 1 B 2019").when(k % 4 == 1, "CIRCUIT 7A 2019").when(k % 4 == 2, "ROOM 3").otherwise("NO NUMBER")
    other = F.when(k % 4 == 0, "CIRCUIT 1B").when(k % 4 == 1, "CIRCUIT 7A 2018").when(k % 4 == 2, "3 ROOM").otherwise("NUMBER 9")
    tokens = expr.digit_tokens(name)
    return t.customer.select(k.alias("k"), F.concat_ws(",", tokens).alias("tokens"), expr.digit_tokens_match(tokens, expr.digit_tokens(other)).alias("same_as_self_or_year"))


@query("""SELECT o_orderkey AS k, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2000 + o_orderkey % 20 END AS BIGINT) AS label_year, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(greatest(0, o_orderkey % 50 - CASE WHEN o_orderkey % 2 = 0 THEN 25 ELSE 0 END) AS DOUBLE) END AS net,
  CASE WHEN o_orderkey % 2 = 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 9, '3') END AS crn, year(o_orderdate + INTERVAL 200 DAY) > year(o_orderdate) + CASE WHEN month(o_orderdate) >= 4 THEN 1 ELSE 0 END AS multi FROM orders""")
def parsed_fields(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    label = F.when(k % 3 == 0, F.concat((k % 20 + 2000).cast("string"), F.lit("-01"))).otherwise("FY20")
    net = expr.net_amount(F.when(k % 5 != 0, (k % 50).cast("double")), F.when(k % 2 == 0, 25.0))
    crn = F.concat(F.lpad(k.cast("string"), 9, "3"), F.when(k % 2 == 0, "RR0001 ").otherwise("R"))
    day = F.col("o_orderdate").cast("date")
    return longs(t.orders.select(k.alias("k"), expr.fiscal_year_of_label(label).alias("label_year"), net.alias("net"), expr.valid_crn(crn).alias("crn"), expr.multi_year(day, F.date_add(day, 200)).alias("multi")), "label_year")


@query("""SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 0 THEN '—' WHEN 1 THEN '$' || (1000 + c_custkey % 9 * 1000 + 0)::VARCHAR[1:1] || ',234' WHEN 2 THEN '$3.5M' WHEN 3 THEN '$1.5B' ELSE '$12B' END AS money, CASE c_custkey % 3 WHEN 0 THEN '—' WHEN 1 THEN '>999%' ELSE '25%' END AS pct FROM customer""".replace("(1000 + c_custkey % 9 * 1000 + 0)::VARCHAR[1:1]", "substr(CAST(1000 + c_custkey % 9 * 1000 AS VARCHAR), 1, 1)"))
def formatted(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    v = F.when(k % 5 == 1, (k % 9 * 1000 + 1234).cast("double")).when(k % 5 == 2, 3.46e6).when(k % 5 == 3, 1.52e9).when(k % 5 == 4, 1.22e10)
    declared = F.when(k % 3 == 0, 0.0).when(k % 3 == 1, 0.5).otherwise(400.0)
    return t.customer.select(k.alias("k"), expr.fmt_money(v).alias("money"), expr.fmt_pct(F.lit(100.0), declared).alias("pct"))


@query("""SELECT c_custkey AS k, CASE c_custkey % 4 WHEN 0 THEN 'Montréal' WHEN 1 THEN 'Laval' WHEN 2 THEN 'Gaspé' ELSE 'Dorval' END AS city, c_custkey % 4 IN (0, 2, 3) AS island, 'https://x.test/r/' || CASE c_custkey % 2 WHEN 0 THEN 'a+b' ELSE 'c%2Fd' END || ',R-' || c_custkey AS url FROM customer""")
def places_and_links(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    city = expr.clean_city(F.when(k % 4 == 0, "Montréal (Québec)").when(k % 4 == 1, "Laval, QC").when(k % 4 == 2, "Gaspé qc ").otherwise("Dorval"))
    island = expr.on_island(city, F.when(k % 4 == 2, "H3A1A1").otherwise("J7X1A1"))
    url = expr.record_url("https://x.test/r/", F.when(k % 2 == 0, "a b").otherwise("c/d"), F.concat(F.lit("R-"), k.cast("string")))
    return t.customer.select(k.alias("k"), city.alias("city"), island.alias("island"), url.alias("url"))
