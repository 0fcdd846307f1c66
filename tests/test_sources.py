"""Readers, writers, streams and the driver contract."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import rows
from tributary.plans import catalogue
from tributary.sources import readers, sinks
from tributary.streaming import agreements


def test_csv(spark, tmp_path):
    (tmp_path / "a_2019.csv").write_text('id,name\n1,"x, ""y""\nz"\n2,\n')
    (tmp_path / "a_2020.csv").write_text("id,extra\n3,e\n")
    got = readers.yearly_csv(spark, [str(tmp_path / "a_2019.csv"), str(tmp_path / "a_2020.csv")])
    assert rows(got, "id", "name", "extra", "source_year") == [("1", 'x, "y"\nz', None, 2019), ("2", None, None, 2019), ("3", None, "e", 2020)]
    with pytest.raises(ValueError):
        readers.renamed(got, ["only"])


def test_rejects_are_counted(spark, tmp_path):
    (tmp_path / "b.csv").write_text('id,name\n1,x\n2,y,too,many\n3,z\n4,"two\nlines"\n')
    good, counts = readers.csv_with_rejects(spark, str(tmp_path / "b.csv"))
    assert rows(good, "id", "name") == [("1", "x"), ("3", "z"), ("4", "two\nlines")]
    assert [(r.rejected, r.rows) for r in counts.collect()] == [(1, 4)]


def test_overrides(spark, tmp_path):
    assert readers.merge_overrides(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "o.csv").write_text("entity_id_keep,entity_id_merge,note\n1,2,a\n,3,b\n")
    assert rows(readers.merge_overrides(spark, str(tmp_path / "o.csv"))) == [(1, 2)]


def test_registries(spark):
    companies = spark.createDataFrame([("1", "APE", "IM", "1 rue A", "", "Montréal (Québec)", "H2X 1Y4"), ("2", "APE", "RD", "", "", "Montréal", ""), ("3", "ASS", "IM", "", "", "Montréal", ""), ("4", "APE", "IM", "", "Gaspé", None, None)], "NEQ string, COD_FORME_JURI string, COD_STAT_IMMAT string, ADR_DOMCL_LIGN1_ADR string, ADR_DOMCL_LIGN2_ADR string, ADR_DOMCL_LIGN3_ADR string, ADR_DOMCL_LIGN4_ADR string")
    names = spark.createDataFrame([("1", "Les Amis", "N", "V"), ("1", "Friends", "A", "V"), ("1", "Old", "N", "A"), ("4", "Loin", "N", "V")], "NEQ string, NOM_ASSUJ string, TYP_NOM_ASSUJ string, STAT_NOM string")
    got = readers.provincial_registry(companies, names).collect()
    assert [(r.source_id, r.legal_name, r.trade_names, r.city, r.postal) for r in got] == [("1", "Les Amis", ["Friends"], "Montréal", "H2X1Y4")]
    assert readers.provincial_registry(companies, names, island_only=False).count() == 2


def test_status():
    assert readers.parse_status("verified_2024-01-02") == ("verified", "2024-01-02") and readers.parse_status("editorial") == ("editorial", None)
    with pytest.raises(ValueError):
        readers.parse_status("maybe")


def test_yaml_comments(spark):
    pytest.importorskip("yaml")
    text = "- id: 1\n  name: n\n  evidence:\n    - source: s\n      status: verified  # seen twice\n    - source: t\n      status: unverified\n"
    assert rows(readers.interventions(spark, text), "source", "status", "comment") == [("s", "verified", "seen twice"), ("t", "unverified", None)]


def test_outputs_need_names(spark, tmp_path):
    df = spark.createDataFrame([("needs_review", "x"), ("ok", "y")], "charity_status string, id string")
    sinks.discovery_outputs(df, str(tmp_path), {"full": "f", "charity_review": "q"})
    assert readers.csv_strings(spark, str(tmp_path / "q")).count() == 1
    with pytest.raises(ValueError):
        sinks.discovery_outputs(df, str(tmp_path), {"full": "f", "charity_review": "f"})


def test_upsert_table(spark, tmp_path):
    path, staging = str(tmp_path / "t"), str(tmp_path / "s")
    spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").write.parquet(path)
    sinks.upsert_table(path, spark.read.parquet(path), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), ["k"], staging)
    assert rows(spark.read.parquet(path)) == [(1, "a"), (2, "c"), (3, "d")]


def test_latest_wins_stream(spark, tmp_path):
    src = tmp_path / "in"
    for i, data in enumerate([[("k", 1, "a"), ("l", 1, "x")], [("k", 3, "c")], [("k", 2, "b")]]):
        spark.createDataFrame(data, "key string, n int, v string").coalesce(1).write.mode("append").parquet(str(src))
    stream = agreements.read_stream(spark, str(src), spark.read.parquet(str(src)).schema)
    agreements.merge_latest(stream, str(tmp_path / "t"), str(tmp_path / "c"), ["key"], [F.desc("n")]).awaitTermination()
    assert rows(agreements.current(spark, str(tmp_path / "t"))) == [("k", 3, "c"), ("l", 1, "x")]


def test_windowed_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = agreements.read_stream(spark, str(tmp_path / "in"), events.schema)
    out = agreements.windowed_sums(stream.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "value", ["event_type"], "1 day")
    q = out.writeStream.format("memory").queryName("sums").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("sums").agg(F.sum("n")).first()[0] == events.count()


def _value(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "as_tuple"):
        return round(float(v), 6)
    return tuple(map(_value, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, sf_dir, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    mine = sorted((repr(tuple(_value(v) for v in r)) for r in got.select(*sorted(got.columns)).collect()))
    if name not in catalogue.ORACLES:
        assert mine
        return
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out = con.execute(catalogue.ORACLES[name])
    names = [c[0] for c in out.description]
    order = [names.index(c) for c in sorted(names)]
    assert sorted(names) == sorted(got.columns)
    assert mine == sorted(repr(tuple(_value(r[i]) for i in order)) for r in out.fetchall())


def test_contract(spark):
    assert entry.entry(spark).count() == 5
    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


# --- queries without SQL, row by row ----------------------------------------------------------------------------------------


def test_markup_is_cleaned(spark, sf_dir):
    import html
    import re

    want = {}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html").collect():
        text, before = re.sub(r"<[^>]+>", " ", r.html), None
        while text != before:
            before, text = text, html.unescape(text)
        want[r.page_id] = " ".join(text.split())
    assert {r.page_id: r["clean"] for r in catalogue.QUERIES["html_clean"](spark, sf_dir).collect()} == want


def _ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (|a| + |b|) of the sorted words, by the quadratic table."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b):
            diagonal, row[j + 1] = row[j + 1], diagonal + 1 if x == y else max(row[j + 1], row[j])
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def test_best_matches_equal_the_quadratic_table(spark, sf_dir):
    from tributary.functions import expr

    rows_ = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_name").distinct().select("p_name", expr.normalize_for_scoring(F.col("p_name")).alias("key"), F.xxhash64("p_name").alias("ord")).collect()
    order = sorted(rows_, key=lambda r: r.ord)
    want = {}
    for r in rows_:
        # The record's name has "inc" behind it, which its key hasn't.
        ranked = sorted(((-_ratio(r.key, c.key), c.ord, c.p_name) for c in order))[:2]
        want[f"{r.p_name} inc"] = (ranked[0][2], round(-ranked[0][0], 6), round(-ranked[1][0], 6))
    got = {r.legal_name: (r.best_name, r.best_score, r.runner_up_score) for r in catalogue.QUERIES["token_sort_best_match"](spark, sf_dir).collect()}
    assert got == want


def test_resolution_equals_a_sequential_pass(spark, sf_dir):
    """The query's own records, one after the other: exact number, blocked fuzzy name with the digit gate, residual rule."""
    import re

    drop = {"FOUNDATION", "INC", "THE", "OF"}
    norm = lambda x: " ".join(w for w in re.sub(r"[^A-Z0-9 ]", " ", x.upper()).split() if w not in drop)
    digits = lambda x: sorted({w for w in x.split() if any(c.isdigit() for c in w)})
    registry, number_of, by_number = [], {}, {}
    for s in sorted(spark.read.parquet(f"{sf_dir}/supplier.parquet").collect(), key=lambda r: r.s_suppkey):
        e = ("registry", s.s_suppkey)
        registry.append((e, norm(f"Maple {s.s_name} Foundation"), f"P{s.s_nationkey % 10}"))
        by_number[str(s.s_suppkey + 100_000_000)] = e
    by_name, want = {}, {}
    for c in sorted(spark.read.parquet(f"{sf_dir}/customer.parquet").collect(), key=lambda r: r.c_custkey):
        k = c.c_custkey
        name = norm(f"MAPLE Supplier#{k % 97:09d} Inc" if k % 3 == 0 else f"Club {k % 211}")
        root = str(k % 89 + 100_000_000) if k % 4 == 0 else str(k % 53 + 200_000_000) if k % 4 == 1 else None
        prov = f"P{c.c_nationkey % 10}"
        if root in by_number:
            want[k] = (by_number[root], "exact_bn", 100.0)
            continue
        block = [(-_ratio(name, n), e) for e, n, p in registry if p == prov and n[:4] == name[:4] and digits(n) == digits(name)] if k % 2 == 0 else []
        best = min(block, default=(0, None))
        if -best[0] >= 90:
            want[k] = (best[1], "fuzzy_accept", round(-best[0], 4))
            continue
        key = (name, prov)
        e = by_name.get(key)
        if e is not None and root and number_of[e] and number_of[e] != root:
            key = (name, prov, root)
            e = by_name.get(key)
        if e is None:
            e = by_name[key] = ("new", k)
            number_of[e] = root
        elif root and not number_of[e]:
            number_of[e] = root
        if root:
            by_number.setdefault(root, e)
        want[k] = (e, "unmatched_new", None)
    got = {r.ord: r for r in catalogue.QUERIES["resolve_entities"](spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    assert {k: (r.match_method, r.match_score) for k, r in got.items()} == {k: w[1:] for k, w in want.items()}
    theirs: dict = {}
    mine = {k: theirs.setdefault(r.entity_id, want[k][0]) for k, r in sorted(got.items())}
    assert mine == {k: w[0] for k, w in want.items()} and len(set(theirs.values())) == len(theirs)


def test_fixed_effects_of_the_query(spark, sf_dir):
    import numpy as np

    data = catalogue.QUERIES["regression_panel"](spark, sf_dir).collect()
    got = {r.term: r.value for r in catalogue.QUERIES["fixed_effects"](spark, sf_dir).collect()}
    units, years = sorted({r.unit for r in data}), sorted({r.fiscal_year for r in data})
    if not got:
        assert len(units) < 4 or len({r.treated for r in data}) < 2
        return
    u, y = {x: i for i, x in enumerate(units)}, {x: i for i, x in enumerate(years[1:])}
    x = np.zeros((len(data), 1 + len(units) + len(y)))
    for i, r in enumerate(data):
        x[i, 0] = r.treated * r.post
        x[i, 1 + u[r.unit]] = 1
        if r.fiscal_year in y:
            x[i, 1 + len(units) + y[r.fiscal_year]] = 1
    beta = np.linalg.lstsq(x, np.array([r.log_donations for r in data]), rcond=None)[0]
    assert abs(got["coefficient"] - beta[0]) < 1e-5 and got["n"] == len(data) and got["units"] == len(units)
