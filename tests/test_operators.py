"""Versions, graph, merges, discovery, study, flow, search, quality, text classification."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import rows
from tributary.operators import components, dedup, discovery, flow, ids, marts, merges, quality, resolve, search, study, textclass

AGREEMENT = "owner_org string, ref_number string, amendment_number string, agreement_value string, recipient_legal_name string"


def test_latest_amendment(spark):
    df = spark.createDataFrame([("a", "R1", "0", "100", "x"), ("a", "R1", "1", "150", "x"), ("a", "R1", "2.0", "175", "x"), ("a", "R2", "", "5", "x"), ("a", "C-1", None, "6", "x"), ("b", "R1", "0", "7", "x"), ("a", "X ", "0", "8", "x"), ("a", "X", "1", "9", "x")], AGREEMENT)
    got = dedup.latest_amendment(df, "owner_org", "ref_number", "amendment_number", [F.col("agreement_value").asc()])
    assert sorted(r.agreement_value for r in got.collect()) == ["175", "5", "6", "7", "9"]


def test_full_row_dedup_treats_nulls_as_equal(spark):
    df = spark.createDataFrame([("a", None, 2), ("a", None, 1), ("a", "x", 3)], "k string, v string, n int")
    assert sorted(r.n for r in dedup.full_row_dedup(df, ["k", "v"], [F.asc_nulls_last("n")]).collect()) == [1, 3]


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_positional_percentiles(spark, n):
    values = sorted(random.Random(n).choices(range(50), k=n))
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = {r.percent: r.value for r in dedup.positional_percentile(df, "v", [0, 25, 50, 99, 100]).collect()}
    assert got == {p: values[min(n - 1, n * p // 100)] for p in (0, 25, 50, 99, 100)}


def test_dense_ids(spark):
    df = spark.range(0, 1000, numPartitions=7).withColumn("o", F.xxhash64("id"))
    got = ids.dense_ids(df, ["o"], "n", 5).orderBy("o").collect()
    assert [r.n for r in got] == list(range(5, 1005))
    assert ids.dense_ids(df.where("id < 0"), ["o"], "n").count() == 0


def test_written_tables_can_be_forgotten(spark):
    import os

    from tributary.session import forget, written

    df = written(spark.range(3), "x")
    place = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 3 and os.path.exists(place)
    forget(spark)
    assert not os.path.exists(place)


def test_tables_on_the_way_are_removed(spark):
    import os

    from tributary.session import drop, settled, written

    inner = []

    def make():
        inner.append(written(spark.range(4), "x"))
        return inner[0].where("id > 1")

    out = settled(spark, make, "y")
    places = [df.inputFiles()[0].removeprefix("file://") for df in (inner[0], out)]
    assert out.count() == 2 and [os.path.exists(p) for p in places] == [False, True]
    drop(out)
    assert not os.path.exists(places[1])


def test_components_against_union_find(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 200), r.randint(0, 200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 340)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {n: c for n, c in components.connected_components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {x: find(x) for x in parent}


def _resolve(spark, charities, records):
    idents = spark.createDataFrame([(*c, 2020, i) for i, c in enumerate(charities)], "bn string, name string, city string, province string, source_year int, ord int")
    recs = spark.createDataFrame([(i, "s", *r) for i, r in enumerate(records)], "ord long, source_dataset string, name string, bn string, province string, allow_fuzzy boolean")
    out = resolve.resolve(idents, spark.createDataFrame([], "code string, title string"), recs)
    links = {r.ord: (r.entity_id, r.match_method) for r in out.links.collect()}
    return [links[i] for i in range(len(records))], {e.entity_id: e for e in out.entities.collect()}, out


def test_resolution_rules(spark):
    charities = [("100000001RR0001", "Maple Leaf Aid", "X", "ON"), ("100000002RR0001", "Reading Circuit 5A", "X", "AB")]
    records = [
        ("Maple Leaf Aid Inc", None, "ON", True), ("Maple Leaf Aid", None, "QC", True), ("Maple Leaf Aid", None, "", True), ("Reading Circuit 7A", None, "AB", True), ("Anything", "100000001", "QC", False),
        ("Blue Club", "200000001", "ON", False), ("Other Name", "200000001", "QC", False), ("Blue Club", "200000002", "ON", False), ("Blue Club", None, "ON", False), ("Third", "200000002", "ON", False), ("Green", None, "BC", False), ("Green", "200000003", "BC", False), ("Zed", "200000003", "BC", False),
    ]
    got, entities, out = _resolve(spark, charities, records)
    assert got[0] == (1, "fuzzy_accept") and got[2] == (1, "fuzzy_accept")
    assert got[1][1] == "unmatched_new" and got[3][1] == "unmatched_new"
    assert got[4] == (1, "exact_bn")
    assert got[5][0] == got[6][0] == got[8][0] and got[6][1] == "exact_bn"
    assert got[7][0] == got[9][0] != got[5][0] and got[9][1] == "exact_bn"
    assert got[10][0] == got[11][0] == got[12][0] and entities[got[10][0]].bn_root == "200000003"
    assert [tuple(r) for r in out.gate_rejects.select("raw_name", "canonical_name").collect()] == [("Reading Circuit 7A", "Reading Circuit 5A")]
    numbers = [e.bn_root for e in entities.values() if e.bn_root]
    assert len(numbers) == len(set(numbers))


def _sequential(records):
    """The residual rule, one record after the other."""
    by_number, by_name, number, out = {}, {}, {}, []
    for i, (norm, prov, root) in enumerate(records):
        if root and root in by_number:
            out.append(by_number[root])
            continue
        key = (norm, prov)
        e = by_name.get(key)
        if e is not None and root and number[e] and number[e] != root:
            key = (norm, prov, root)
            e = by_name.get(key)
        if e is None:
            e = by_name[key] = i
            number[e] = root
        elif root and not number[e]:
            number[e] = root
        if root:
            by_number.setdefault(root, e)
        out.append(e)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_component_replay_equals_a_sequential_pass(spark, seed):
    r = random.Random(seed)
    data = [(r.choice(["A", "B", "C", "D", "E"]), r.choice(["ON", "QC"]), r.choice([None, None, *(f"20000000{k}" for k in range(6))])) for _ in range(200)]
    got, _, _ = _resolve(spark, [("100000001", "Zzz", "X", "ON")], [(n, b, p, False) for n, p, b in data])
    first: dict[int, int] = {}
    mine = [first.setdefault(e, i) for i, (e, _) in enumerate(got)]
    want_first: dict[int, int] = {}
    assert mine == [want_first.setdefault(e, i) for i, e in enumerate(_sequential(data))]


ENTITY = "entity_id long, bn_root string, canonical_name string, city string, province string, entity_kind string"


def test_merges(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (7, 8)], "keep long, merge long")
    assert rows(merges.final_targets(pairs)) == [(2, 1), (3, 1), (8, 7)]
    ents = spark.createDataFrame([(i, None, f"n{i}", None, None, "other_org") for i in (1, 2, 3, 7, 8, 9)], ENTITY)
    links = spark.createDataFrame([(i, "s") for i in (1, 2, 3, 9)], "entity_id long, source_dataset string")
    grants = spark.createDataFrame([(3, 8, 5.0), (9, 2, 7.0)], "funder_entity_id long, recipient_entity_id long, amount_cad double")
    e, k, g = merges.apply_merges(ents, links, grants, pairs)
    assert rows(e, "entity_id") == [(1,), (7,), (9,)]
    assert sorted(r.entity_id for r in k.collect()) == [1, 1, 1, 9]
    assert sorted((r.funder_entity_id, r.recipient_entity_id, r.amount_cad) for r in g.collect()) == [(1, 7, 5.0), (9, 1, 7.0)]


def test_null_province_twins(spark):
    names = [(1, None, "Fédération acadienne du Nord", None, None, "other_org"), (2, "132162041", "FEDERATION ACADIENNE DU NORD", None, "NS", "other_org"), (3, None, "Amis", None, None, "other_org"), (4, None, "Amis", None, "QC", "other_org"), (5, None, "Club of Many Fine Twins", None, None, "other_org"), (6, None, "Club of Many Fine Twins", None, "QC", "other_org"), (7, None, "Club of Many Fine Twins", None, "ON", "other_org"), (8, None, "Une grande charité du Nord", None, None, "other_org"), (9, "1", "Une grande charité du Nord", None, "ON", "charity")]
    assert rows(merges.null_province_pairs(spark.createDataFrame(names, ENTITY))) == [(2, 1)]


def test_branches_and_near_misses(spark):
    ents = spark.createDataFrame([(1, "119219814", "The Canadian Red Cross Society", None, "ON", "charity"), (2, None, "Canadian Red Cross – Ottawa", None, None, "other_org"), (3, None, "Canadian Red Cross (Laval)", None, None, "other_org"), (4, None, "Canadian Red Cross-Gander", None, None, "other_org"), (5, None, "Nobody - Ottawa", None, None, "other_org"), (6, "011921981", "Canadian Red Cross", None, "ON", "other_org"), (7, "119218814", "Something else", None, "ON", "other_org")], ENTITY)
    roles = spark.createDataFrame([(1, 5.0, 1.0), (2, 0.0, 3.0)], "entity_id long, total_given double, total_received double")
    got = merges.branch_variants(ents, roles)
    assert {(r.bnless_entity_id, r.branch_suffix, r.bn_entity_id) for r in got.collect()} == {(2, "Ottawa", 1), (3, "Laval", 1), (2, "Ottawa", 6), (3, "Laval", 6)}
    near = merges.near_miss_numbers(ents, roles).collect()
    assert [(r.a, r.b, r.edit, r.score) for r in near] == [(1, 6, "insertion_deletion", 100.0)]


def test_roles(spark):
    ents = spark.createDataFrame([(i, None, "n", None, None, "other_org") for i in range(4)], ENTITY)
    grants = spark.createDataFrame([(0, 1, 90.0), (1, 2, 10.0), (1, 0, 1.0)], "funder_entity_id long, recipient_entity_id long, amount_cad double")
    assert {r.entity_id: r.role for r in marts.role_summary(ents, grants).collect()} == {0: "primarily_funder", 1: "dual_role", 2: "primarily_recipient", 3: "no_flows"}


def test_financials_take_the_later_filing_whole(spark):
    ents = spark.createDataFrame([(1, "100000001", "n", None, None, "charity")], ENTITY)
    filings = spark.createDataFrame([("100000001RR0001", "2019-12-31", "5", "6", 2019), ("100000001RR0001", "2019-12-31", "7", None, 2020), ("100000001RR0001", "2018-12-31", "1", "1", 2019)], "BN string, FPE string, `4700` string, `4570` string, source_year int")
    got = marts.latest_financials(ents, filings, yearly=True).collect()
    assert sorted((r.fiscal_year, r.total_revenue, r.revenue_from_any_cdn_gov) for r in got) == [(2018, 1.0, 1.0), (2019, 7.0, None)]


def _records(spark, data):
    return spark.createDataFrame(data, "source_id string, legal_name string, trade_names array<string>, city string, postal string, bn string")


def _charities(spark, data):
    return spark.createDataFrame(data, "cand_id string, cand_name string, cand_city string, cand_postal string, cand_bn string, ord int")


def test_discovery(spark):
    charities = _charities(spark, [("c1", "Maison Origami", "Laval", "H2X 1Y4", "100000001", 1), ("c2", "Maison McGill", "Laval", "H2X 1Y5", "100000002", 2), ("c3", "Advocates Society Foundation", "Ottawa", "K1A 0A1", "100000003", 3)])
    records = _records(spark, [("r1", "La Maison Origami inc.", [], "Laval", "H2X1Y4", None), ("r2", "Quelque chose", ["Origami"], "Laval", "H2X9Z9", None), ("r3", "Tout autre", [], "laval", None, None), ("r4", "Loin", [], "Gaspé", None, None), ("r5", "Advocates Society", [], "Ottawa", "K1A0A1", "999999999"), ("r6", "Whatever", [], None, None, "100000002")])
    out = {r.source_id: r for r in discovery.discover(records, charities).collect()}
    assert (out["r1"].charity_status, out["r1"].matched_bn, out["r1"].block_level) == ("registered_charity", "100000001", "postal")
    assert (out["r2"].charity_status, out["r2"].block_level) == ("registered_charity", "fsa")
    assert (out["r3"].charity_status, out["r3"].block_level) == ("non_charity_nonprofit", "city")
    assert (out["r4"].charity_status, out["r4"].review_flag) == ("needs_review", "no_blocking_key")
    assert (out["r5"].charity_status, out["r5"].review_flag) == ("needs_review", "bn_contradicts_fuzzy_match")
    assert (out["r6"].charity_status, out["r6"].charity_match_method, out["r6"].charity_match_score) == ("registered_charity", "exact_bn", 100.0)
    assert discovery.output_rows(discovery.discover(records, charities)).columns == list(discovery.OUTPUT_FIELDS)


def test_best_match_scores_blocks_and_writes_no_pairs(spark, monkeypatch):
    """Ties, equal names, trade names, names of over 64 letters; as every pair scored; no table grows with the pairs."""
    from tributary.functions import similarity

    rnd = random.Random(7)
    name = lambda: " ".join("".join(rnd.choices("abcde", k=rnd.choice([3, 5, 40]))) for _ in range(rnd.choice([1, 2, 4])))
    pool = [name() for _ in range(40)]
    people = [(f"r{i}", rnd.choice(pool), rnd.sample(pool, i % 3), rnd.choice(["Laval", "Laval", "Ottawa"]), None, None) for i in range(90)]
    chars = [(f"c{i}", rnd.choice([*pool, name(), "a/b c"]), rnd.choice(["laval", "ottawa"]), None, None, i // 2) for i in range(80)]
    chars += [("none", "", "laval", None, None, -1), chars[0]]
    counts = []

    def spy(df, *rest, real=discovery.written):
        out = real(df, *rest)
        counts.append(out.count())
        return out

    for module in (discovery, similarity):
        monkeypatch.setattr(module, "written", spy)
    monkeypatch.setattr(discovery, "SIDE", 8, raising=False)
    candidates = _charities(spark, chars)
    got = {(r.source_id, r.city): (r.best_score, r.runner_up_score, r.best_id) for r in discovery.best_match(discovery.block_level(_records(spark, people), candidates), candidates).collect()}
    assert len(got) == 90 and max(counts) <= len(people) + len(chars)

    def keys(names):
        rows_ = spark.createDataFrame([(x,) for x in sorted(set(names))], "n string").select("n", discovery._scoring_keys(F.col("n")).alias("k")).collect()
        return {r.n: r.k for r in rows_}

    key = keys([c[1] for c in chars] + pool)
    score: dict = {}
    for who, legal, trade, city, *_ in people:
        for cand, other, place, _, _, order in chars:
            if place == city.lower() and key[other]:
                best = max(similarity.token_sort_ratio(x, y) for n in [legal, *trade] for x in key[n] for y in key[other])
                score[who, order, cand] = max(best, score.get((who, order, cand), 0.0))
    for who, city in got:
        ranked = sorted(((-v, o, c) for (w, o, c), v in score.items() if w == who))
        assert got[who, city][:2] == (-ranked[0][0], -ranked[1][0])
        assert got[who, city][2] in [c for v, o, c in ranked if (v, o) == ranked[0][:2]]


def test_collisions_and_low_confidence(spark):
    df = spark.createDataFrame([(1, "m", 7, 100.0, None), (2, "m", 7, 95.0, None), (3, "m", 8, 95.0, None), (4, "n", 8, 10.0, "x")], "i int, s string, e int, score double, f string")
    got = discovery.reconcile_collisions(df, "s", "m", "e", "f")
    assert {r.i: (r.s, r.f) for r in got.collect()} == {1: ("needs_review", "grant_entity_claimed_by_multiple_orgs"), 2: ("needs_review", "grant_entity_claimed_by_multiple_orgs"), 3: ("m", None), 4: ("n", "x")}
    low = discovery.reconcile_low_confidence(got, "s", "m", "score", "f")
    assert {r.i: r.s for r in low.collect()}[3] == "needs_review"


def test_badges(spark):
    rows_ = spark.createDataFrame([("non_charity_nonprofit", "federal_grant_match", 1, "req", "A"), ("non_charity_nonprofit", "federal_grant_match", 1, "cc", "A2"), ("registered_charity", "federal_grant_match", 2, "req", "B"), ("non_charity_nonprofit", "needs_review", 3, "req", "C")], "charity_status string, federal_grant_status string, matched_grant_entity_id long, discovery_source string, legal_name string")
    index = discovery.badge_index(rows_)
    assert rows(index) == [(1, ["cc", "req"], "A")]
    assert rows(discovery.by_source(index)) == [("all", 1), ("cc", 1), ("req", 1)]


def test_treatment_and_windows(spark):
    receipts = spark.createDataFrame([("a", 2016, 100.0), ("b", 2014, 1.0), ("b", 2016, 500.0), ("c", 2016, 99.0)], "bn_root string, fiscal_year int, amount double")
    assert rows(study.treatment_events(receipts, 100, [2016])) == [("a", 2016)]
    donations = spark.createDataFrame([("a", y, v, v) for y, v in ((2014, 10.0), (2015, 10.0), (2017, 15.0), (2018, 15.0))] + [("z", 2015, 1.0, 1.0), ("z", 2017, 1.0, 1.0), ("z", 2018, 1.0, 1.0)], "bn_root string, fiscal_year int, donations double, revenue double")
    events = spark.createDataFrame([("a", 2016), ("z", 2016)], "bn_root string, Y int")
    assert [(r.bn_root, r.pct) for r in study.window_stats(events, donations).collect()] == [("a", 0.5)]


def test_matching_keeps_the_province_and_relaxes(spark):
    cols = "bn_root string, Y int, province string, revenue double, decile int, tercile int"
    treated = spark.createDataFrame([("t1", 2016, "ON", 10.0, 1, 1), ("t2", 2016, "QC", 10.0, 1, 1), ("t3", 2016, "AB", None, -1, 1)], cols)
    controls = spark.createDataFrame([("c1", 2016, "ON", 11.0, 1, 2), ("c2", 2016, "BC", 10.0, 1, 1), ("c3", 2016, "AB", None, -1, 1), ("c4", 2016, "AB", 5.0, -1, 1)], cols)
    got = study.match_controls(treated, controls)
    assert sorted((r.treated_bn, r.control_bn, r.tier) for r in got.collect()) == [("t1", "c1", "decile"), ("t3", "c3", "decile_trend"), ("t3", "c4", "decile_trend")]


def test_buckets_equal_qcut(spark):
    import pandas as pd

    values = random.Random(4).choices([1.0, 2.0, 2.0, 3.0, 5.0, 8.0, 13.0, 21.0, 34.0], k=60)
    df = spark.createDataFrame([(2016, i, v) for i, v in enumerate(values)], "Y int, i int, v double")
    got = [r.b for r in study.bucketed(df, "Y", "v", 10, 10, "b").orderBy("i").collect()]
    assert got == pd.qcut(pd.Series(values), 10, labels=False, duplicates="drop").tolist()


def test_fixed_effects_equal_dense_least_squares(spark):
    r = np.random.default_rng(0)
    data = []
    for u in range(12):
        for t in range(2010, 2018):
            if r.random() < 0.9:
                post, treated = int(t > 2013), int(u % 2)
                data.append((f"u{u}", f"b{u // 2 * 2 + u % 2}", t, treated, post, float(0.3 * treated * post + u * 0.1 + t * 0.05 + r.normal() * 0.2)))
    panel = spark.createDataFrame(data, "unit string, bn_root string, fiscal_year int, treated int, post int, log_donations double")
    got = study.two_way_fe(panel)
    units, years = sorted({d[0] for d in data}), sorted({d[2] for d in data})
    x = np.array([[d[3] * d[4], *(d[0] == u for u in units), *(d[2] == t for t in years[1:])] for d in data], float)
    y = np.array([d[5] for d in data])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    assert abs(got["coefficient"] - beta[0]) < 1e-9
    bread = np.linalg.pinv(x.T @ x)
    e = y - x @ beta
    meat = sum(np.outer(s, s) for s in (x[[i for i, d in enumerate(data) if d[1] == b]].T @ e[[i for i, d in enumerate(data) if d[1] == b]] for b in {d[1] for d in data}))
    g, n = got["clusters"], got["n"]
    raw = np.sqrt((bread @ meat @ bread)[0, 0])
    assert abs(got["std_error"] / raw - np.sqrt(g / (g - 1) * (n - 1) / (n - len(years)))) < 1e-6
    assert study.two_way_fe(panel.where("unit < 'u1'")) is None


def test_winsorised_median(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(1e9,)], "pct double")
    assert study.winsorized_median(df, share=0.1).first()[0] == 5.0
    assert study.winsorized_median(df.where("pct < 0")).first()[0] is None


def test_chains(spark):
    hop1 = spark.createDataFrame([("A", 1, "gov", 2020, 50.0)], "bn_root string, entity_id long, source_dataset string, fiscal_year int, amount double")
    regrants = spark.createDataFrame([("A", 2020, 200_000.0), ("B", 2019, 150_000.0), ("B", 2021, 150_000.0), ("C", 2020, 100_000.0)], "bn_root string, fiscal_year int, amount double")
    gifts = spark.createDataFrame([("A", 2020, "B", 2, "b", "B", 1.0), ("A", 2020, None, None, "x", None, 2.0), ("A", 2020, "A", 1, "a", "A", 3.0), ("B", 2019, "A", 1, "a", "A", 4.0), ("B", 2021, "C", 3, "c", "C", 5.0), ("C", 2020, "D", 4, "d", "D", 6.0)], "bn_root string, fiscal_year int, donee_bn_root string, donee_entity_id long, donee_raw_name string, donee_raw_bn string, amount double")
    inter = flow.intermediaries(hop1, regrants)
    got = flow.chains(inter, regrants, gifts)
    assert got.columns == list(flow.CHAIN_COLUMNS)
    assert sorted((r.hop_depth, r.intermediary_bn_root, r.hop2_amount, r.is_cycle) for r in got.collect()) == [(1, "A", 1.0, False), (1, "A", 2.0, False), (1, "A", 3.0, True), (2, "B", 4.0, True), (2, "B", 5.0, False)]
    assert flow.intermediaries(hop1.withColumn("fiscal_year", F.lit(2018)), regrants).count() == 0


def test_network(spark):
    flows = spark.createDataFrame([(1, 2, 10.0), (2, 3, 9.0), (2, 2, 99.0), *[(2, 10 + i, 1.0 + i) for i in range(6)]], "funder int, recipient int, amount double")
    got = flow.regranting_network(flows, 1, 2).collect()
    assert {(r.side, r.partner, r.amount) for r in got} == {("in", "1", 10.0), ("out", "3", 9.0), ("out", "15", 6.0), ("out", "other", 15.0)}
    layout = flow.sankey_layout(flow.regranting_network(flows, 1, 2), 100.0).collect()
    assert max(r.top + r.height for r in layout) <= 100.0001


def test_search_tiers_and_promotion(spark):
    ents = spark.createDataFrame([(1, "École"), (2, "École Secondaire"), (3, "Grande école"), (4, "Protocole"), (5, "École 100%")], "entity_id long, canonical_name string").withColumn("entity_kind", F.lit("x"))
    ents = marts.with_search_name(ents)
    roles = spark.createDataFrame([(1, 10.0, 0.0), (2, 99.0, 0.0), (3, 5000.0, 0.0), (5, 1.0, 0.0)], "entity_id long, total_given double, total_received double")
    got = search.search_orgs(ents, roles, "ecole").collect()
    assert [r.entity_id for r in got] == [1, 2, 5, 3] and got[0].total == 4  # 5,000 is less than a hundred times 99
    more = roles.where("entity_id <> 3").union(spark.createDataFrame([(3, 9901.0, 0.0)], roles.schema))
    assert [r.entity_id for r in search.search_orgs(ents, more, "ecole").collect()] == [1, 3, 2, 5]
    assert [r.entity_id for r in search.search_orgs(ents, roles, "ecole", limit=2, offset=2).collect()] == [5, 3]
    assert [r.entity_id for r in search.search_orgs(ents, roles, "100%").collect()] == [5]
    flags = spark.createDataFrame([(2, True), (3, False)], "entity_id long, f boolean")
    assert [r.entity_id for r in search.search_orgs(ents, roles, "ecole", flags=flags, required=["f"]).collect()] == [2]


def test_lookup_and_receipts(spark):
    ents = spark.createDataFrame([(1, "100000001", "Alpha", None, None, "x"), (2, None, "Alphabet", None, None, "x"), (3, None, "50% off", None, None, "x")], ENTITY)
    assert rows(search.find_entities(ents, "alpha"), "entity_id") == [(1,)]
    assert rows(search.find_entities(ents, "alph"), "entity_id") == [(1,), (2,)]
    assert rows(search.find_entities(ents, "100000001"), "entity_id") == [(1,)] and rows(search.find_entities(ents, "2"), "entity_id") == [(2,)]
    assert rows(search.find_entities(ents, "50%"), "entity_id") == [(3,)] and search.find_entities(ents, "5%o").count() == 0
    wanted = spark.createDataFrame([(1, "k", 10.0), (2, "k", 20.0), (3, "z", 1.0)], "id int, key string, amount double")
    receipts = spark.createDataFrame([("k", 10.005, "a"), ("k", 20.0, "b"), ("k", 20.0, "c")], "key string, amount double, receipt_id string")
    assert rows(search.locate_receipts(wanted, receipts, ["key"])) == [(1, "a", "found"), (2, None, "ambiguous"), (3, None, "no match")]


def test_slugs(spark):
    ents = spark.createDataFrame([(1, "Étoile"), (2, "etoile"), (3, "???"), (4, "A | B"), (5, "A / B")], "entity_id long, canonical_name string")
    assert rows(search.slug_manifest(ents)) == [(1, "toile"), (2, "etoile"), (3, "org"), (4, "a"), (5, "a-5")]


def test_gateway(spark):
    got, more = search.read_only(spark, "SELECT id FROM range(600) -- drop", 500)
    assert got.count() == 500 and more.first()[0]
    assert search.read_only(spark, "with x as (select 'drop; it' as a) select * from x;")[0].count() == 1
    for bad in ("DROP TABLE x", "select 1; select 2", "insert into x values (1)", "with x as (select 1) insert into t select * from x", "show tables", "SELECT * FROM x; DROP TABLE x"):
        with pytest.raises(ValueError):
            search.read_only(spark, bad)


RAW = "owner_org string, ref_number string, amendment_number string, agreement_value string, recipient_legal_name string, recipient_business_number string, recipient_type string, recipient_province string, recipient_country string, recipient_city string, recipient_postal_code string, agreement_start_date string, agreement_end_date string, prog_name_en string, description_en string, description_fr string, expected_results_en string"


def test_quality_reports(spark):
    good = ("d1", "R-1", "0", "$1,000", "Org", "132162041RR0001", "N", "ON", "CA", "X", "H2X1Y4", "2020-05-01", "2022-03-31", "P", "t" * 60, "texte", "res", "G")
    bad = ("d2", "R-2", "x", "-5", " ", None, "Z", "Ontario", "ca", "X", None, "1899-12-30", None, "P", "", None, None, "grant")
    late = ("d2", "R-3", "0", "n/a", "Org", None, None, "NY", "CA", "X", None, "2026-01-01", None, None, "short", None, None, None)
    raw = spark.createDataFrame([good, bad, late], RAW + ", agreement_type string")
    m = {r.dept: r for r in quality.compliance(quality.parse_agreements(raw)).collect()}
    assert all(m["d1"][i] == 0 for i in quality.ISSUES)
    d2 = m["d2"]
    assert (d2.missing_desc_en, d2.missing_desc_fr, d2.dirty_type, d2.short_desc, d2.zero_neg, d2.post_dec_total) == (1, 2, 1, 1, 1, 1)
    assert (d2.pd_recipient_type, d2.pd_biz_num, d2.pd_postal, d2.pd_riding, d2.pd_prog_name, d2.pd_end_date, d2.pd_exp_results) == (1,) * 7
    assert quality.post_policy(quality.compliance(quality.parse_agreements(raw))).first().pct_biz_num == 0
    kinds = {r.anomaly for r in quality.anomalies(quality.parse_agreements(raw)).collect()}
    assert kinds == {"spreadsheet null date", "lower-case country", "invalid province", "foreign province"}
    assert [r.dept for r in quality.exemplary(quality.compliance(quality.parse_agreements(raw)), 1).collect()] == ["d1"]
    tables = quality.profile(raw)
    assert tables["money"].first().unreadable == 1 and tables["dates"].first().multi_year == 1
    assert {r["column"]: r.missing for r in tables["completeness"].collect()}["recipient_legal_name"] == 1
    assert quality.quality_by_department(raw, 1).count() == 2 and quality.dashboard(raw)["totals"].first().agreements == 3
    assert quality.markdown(quality.value_counts(quality.parse_agreements(raw), "rtype")).count("\n") == 4


def test_text_classification(spark):
    texts = spark.createDataFrame([("h1", "We build houses", 5), ("h2", "Noise", 2), ("h3", "Bang", 1)], "text_hash string, text string, n_grants long")

    def model(text: str) -> dict:
        if text == "Bang":
            raise RuntimeError("down")
        if text == "Noise":
            return {"codes": ["ZZ000000"], "confidence": "high", "quote": "Noise"}
        return {"codes": ["AA010000", "AA000000"], "confidence": "high", "quote": "we  BUILD"}

    got = textclass.enforce(textclass.classify(texts, model, 2), spark.createDataFrame([("AA010000",), ("AA000000",)], "code string"))
    by = {r.text_hash: r for r in got.collect()}
    assert (by["h1"].confidence, by["h1"].codes, by["h1"].flags) == ("high", "AA010000,AA000000", "")
    assert (by["h2"].confidence, by["h2"].flags) == ("abstain", "unknown_code") and by["h3"].status == "error"
    assert [r.text_hash for r in textclass.to_classify(texts, got, 2, 5).collect()] == [] and textclass.to_classify(texts, got, 3, 2).count() == 2
    mapped = spark.createDataFrame([("d", "R1", "org", "bn", 10.0, "We build houses", "h1"), ("d", "R2", "org", "bn", 5.0, "We build houses", "h1"), ("e", "R2", "o2", None, 5.0, "We build houses", "h1")], "owner_org string, ref_number string, recipient_legal_name string, business_number string, amount_cad double, text string, text_hash string")
    view = textclass.grant_view(mapped, got, 2)
    assert {(r.recipient_legal_name, r.code, r.n_grants, r.amount_cad) for r in textclass.code_rollup(view).collect()} >= {("org", "AA010000", 2, 15.0), ("org", "AA000000", 2, 15.0)}
    assert tuple(textclass.agreement(view, spark.createDataFrame([("R1", "AA010203"), ("R2", "AA010203")], "ref_number string, code string")).first()) == (1, 1, 1)


def test_misquotes_abstain(spark):
    texts = spark.createDataFrame([("h", "short text", 1)], "text_hash string, text string, n_grants long")
    got = textclass.enforce(textclass.classify(texts, lambda t: {"codes": ["A"], "confidence": "low", "quote": "not there"}), spark.createDataFrame([("A",)], "code string")).first()
    assert (got.confidence, got.codes, got.flags) == ("abstain", "", "quote_not_verbatim")


def test_taxonomy_paths(spark):
    df = spark.createDataFrame([(1, "A", None), (2, None, "a1"), (3, None, "a2"), (4, "B", None), (5, None, "b1")], "o int, l0 string, l1 string")
    got = textclass.taxonomy_paths(df, "o", ["l0", "l1"]).orderBy("o").collect()
    assert [(r.path_0, r.path_1) for r in got] == [("A", None), ("A", "a1"), ("A", "a2"), ("B", None), ("B", "b1")]


def test_every_part_name_is_a_candidate(spark, sf_dir):
    """A name with a suffix matches itself best (or the same words in another order), for all names."""
    from tributary.plans.catalogue import QUERIES

    got = QUERIES["token_sort_best_match"](spark, sf_dir).collect()
    assert got and all(sorted(r.legal_name.removesuffix(" inc").split()) == sorted(r.best_name.split()) for r in got)
