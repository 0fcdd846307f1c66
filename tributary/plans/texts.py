"""Text operators: folding, search, rollups, hashes, markup, classification bookkeeping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..functions.text import clean_html
from ..operators import search, textclass
from .base import Tables, longs, query

_FOLD = "lower(strip_accents(trim(regexp_replace({x}, '\\s+', ' ', 'g'))))"
_SQUEEZE = "trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


@query(f"SELECT doc_id FROM documents WHERE regexp_matches({_FOLD.format(x='text')}, '(^|[^a-zA-Z0-9])ele')")
def fold_search(t: Tables) -> DataFrame:
    return t.documents.where(expr.word_start(expr.fold(F.col("text")), search.fold_query("Éle"))).select("doc_id")


@query(f"""SELECT source, {_SQUEEZE.format(x='text')} AS norm_text, count(*) AS n, substr(sha256({_SQUEEZE.format(x='text')}), 1, 16) AS text_id, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1, 2""")
def grant_text_rollup(t: Tables) -> DataFrame:
    norm = search.normalized_text(F.col("text"))
    return t.documents.groupBy("source", norm.alias("norm_text")).agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).withColumn("text_id", F.substring(F.sha2("norm_text", 256), 1, 16))


@query(f"""WITH h AS (SELECT {_SQUEEZE.format(x='text')} AS t, source FROM documents), g AS (SELECT t, count(*) AS n, list_sort(list(DISTINCT source)) AS s FROM h GROUP BY 1),
k AS (SELECT substr(sha256(t), 1, 16) AS text_id, n FROM g WHERE regexp_matches(lower(strip_accents(t)), '(^|[^a-zA-Z0-9])que') AND list_has_any(s, ['src0', 'src3']))
SELECT text_id, n AS n_grants, (SELECT count(*) FROM k) AS total FROM k ORDER BY n DESC, text_id LIMIT 50""")
def text_search_page(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("text").alias("description"), F.lit(1.0).alias("amount_cad"), F.lit("p").alias("program_name"), F.col("source").alias("source_dataset"))
    return search.search_texts(search.text_index(rows), "que", ("src0", "src3")).select("text_id", "n_grants", "total")


@query(f"SELECT page_id, {_SQUEEZE.format(x=chr(114) + 'egexp_replace(html, ' + repr('<[^>]+>') + ', ' + repr(' ') + ', ' + repr('g') + ')')} AS stripped FROM pages")
def tag_strip(t: Tables) -> DataFrame:
    return t.pages.select("page_id", expr.squeezed(F.regexp_replace("html", "<[^>]+>", " ")).alias("stripped"))


@query()
def html_clean(t: Tables) -> DataFrame:
    """Entities need Python's table (tested against it); tag_strip is the part that SQL can say."""
    return clean_html(t.pages.select("page_id", "html"), "html", "clean").select("page_id", "clean")


@query(f"""WITH h AS (SELECT {_SQUEEZE.format(x='text')} AS t FROM documents) SELECT sha256(t) AS text_hash, count(*) AS n_grants FROM h GROUP BY 1 ORDER BY n_grants DESC, text_hash LIMIT 40""")
def text_map_distinct(t: Tables) -> DataFrame:
    mapped = t.documents.select(expr.squeezed(F.col("text")).alias("text")).withColumn("text_hash", F.sha2("text", 256))
    return textclass.distinct_texts(mapped, 40).select("text_hash", "n_grants")


@query("""WITH s AS (SELECT doc_id, quality AS v FROM labels), f AS (SELECT doc_id, 2 AS v FROM labels WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id + 1000000, 3 FROM labels WHERE toxic = 1)
SELECT CAST(v AS BIGINT) AS v, count(*) AS n FROM (SELECT * FROM s WHERE doc_id NOT IN (SELECT doc_id FROM f) UNION ALL SELECT * FROM f) GROUP BY 1""")
def keyed_upsert(t: Tables) -> DataFrame:
    store = t.labels.select("doc_id", F.col("quality").alias("v"))
    fresh = t.labels.where("doc_id % 4 = 0").select("doc_id", F.lit(2).alias("v")).unionByName(t.labels.where("toxic = 1").select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.lit(3).alias("v")))
    return longs(textclass.upsert(store, fresh, ("doc_id",)).groupBy("v").agg(F.count("*").alias("n")), "v")


@query("""WITH c AS (SELECT p_partkey, lpad(CAST(p_partkey % 40 AS VARCHAR), 2, '0') || CASE WHEN p_size % 2 = 0 THEN '00' ELSE lpad(CAST(p_size AS VARCHAR), 2, '0') END || '0000' AS a, lpad(CAST(p_partkey % 20 AS VARCHAR), 2, '0') || lpad(CAST(p_size AS VARCHAR), 2, '0') || '1122' AS b FROM part)
SELECT p_partkey, (substr(a, 1, 2) = substr(b, 1, 2) AND (substr(a, 3, 2) = '00' OR substr(a, 3, 2) = substr(b, 3, 2))) AS related FROM c""")
def taxonomy_ancestors(t: Tables) -> DataFrame:
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    a = F.concat(two(F.col("p_partkey") % 40), F.when(F.col("p_size") % 2 == 0, "00").otherwise(two(F.col("p_size"))), F.lit("0000"))
    b = F.concat(two(F.col("p_partkey") % 20), two(F.col("p_size")), F.lit("1122"))
    return t.part.select("p_partkey", expr.ancestor_or_self(a, b).alias("related"))
