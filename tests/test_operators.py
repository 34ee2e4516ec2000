"""Edge cases: nulls, ties, closed ends, empty tables, one class."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchbook.functions import geo, text
from matchbook.operators import aggregates, assignment, canonical, gates, incremental, joins, prefix, statistics, windows
from matchbook.operators.graph import connected_components
from matchbook.sources import readers, sinks

H = joins.HOUR


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_text_words_are_null(spark):
    df = spark.createDataFrame([("nan",), (" None ",), ("",), (None,), ("x",)], "t string")
    assert [r[0] for r in df.select(text.clean_text(F.col("t"))).collect()] == [None, None, None, None, "x"]
    df = spark.createDataFrame([("1e3",), ("abc",), ("NaN",), (None,)], "t string")
    assert [r[0] for r in df.select(text.number(F.col("t"))).collect()] == [1000.0, None, None, None]
    df = spark.createDataFrame([("2024-01-02",), ("2024-01-02 03:04:05",), ("late",)], "t string")
    assert [str(r[0]) for r in df.select(text.moment(F.col("t"))).collect()] == ["2024-01-02 00:00:00", "2024-01-02 03:04:05", "None"]


def test_bins_close_right_or_left(spark):
    df = spark.createDataFrame([(0.0,), (200.0,), (500.0,), (None,)], "x double")
    edges, names = [0, 200, 500], ["a", "b"]
    assert [r[0] for r in df.select(text.binned(F.col("x"), edges, names)).collect()] == [None, "a", "b", None]
    assert [r[0] for r in df.select(text.binned(F.col("x"), edges, names, "left")).collect()] == ["a", "b", None, None]


def test_angles_and_ratios(spark):
    df = spark.createDataFrame([(350.0, 10.0)], "a double, b double")
    assert df.select(geo.angle_between(F.col("a"), F.col("b"))).first()[0] == 20
    df = spark.createDataFrame([(1.0, 0.0), (1.0, float("nan")), (float("inf"), 1.0), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(geo.safe_ratio(F.col("a"), F.col("b"))).collect()] == [None, None, None, 0.5]
    df = spark.createDataFrame([("2023-12-31", "2024-01-01")], "a string, b string").selectExpr("date(a) a", "date(b) b")
    assert df.select(geo.season_distance(F.col("a"), F.col("b"))).first()[0] <= 2


def test_nearest_ties_go_to_the_earlier(spark):
    left = spark.createDataFrame([(1, "k", 10 * H), (2, None, 10 * H), (3, "z", 0)], "l_id int, key string, l_t long")
    right = spark.createDataFrame([(7, "k", 11 * H), (8, "k", 9 * H), (9, None, 10 * H)], "r_id int, key string, r_t long")
    got = joins.nearest(left, right, ["key"], H)
    assert rows(got.select("l_id", "r_id")) == [(1, 8), (2, None), (3, None)]


def test_interval_ends_are_closed(spark):
    p = spark.createDataFrame([(1, "k", 10), (2, "k", 20), (3, "k", 21), (4, "k", 99)], "l_id int, key string, l_t long")
    i = spark.createDataFrame([("a", "k", 10, 20), ("bad", "k", 5, 1)], "r_id string, key string, i_start long, i_end long")
    assert rows(joins.inside_intervals(p, i, ["key"], 5, 7).select("l_id", "gap")) == [(1, 0), (2, 0), (3, 1)]
    two = spark.createDataFrame([("a", "k", 0, 10), ("b", "k", 10, 20), ("c", "k", 21, 30)], "r_id string, key string, i_start long, i_end long")
    assert rows(joins.overlapping(two, ["key"], 4).select("a", "b")) == [("a", "b")]


def test_fallback_only_without_any_primary(spark):
    left = spark.createDataFrame([(1,), (2,)], "l_id int")
    primary = spark.createDataFrame([(1, 5, 900.0)], "l_id int, r_id int, distance double")
    second = spark.createDataFrame([(1, 6, 1.0), (2, 7, 2.0)], "l_id int, r_id int, distance double")
    assert rows(joins.with_fallback(left, primary, second).select("l_id", "r_id", "method")) == [(1, 5, "primary"), (2, 7, "fallback")]


def test_radius_crosses_the_date_line(spark):
    a = spark.createDataFrame([(1, 10.0, 179.99), (2, 80.0, 0.0)], "l_id int, l_lat double, l_lon double")
    b = spark.createDataFrame([(8, 10.0, -179.99), (9, 80.0, 0.2)], "r_id int, r_lat double, r_lon double")
    assert rows(joins.within_radius(a, b, 5.0).select("l_id", "r_id")) == [(1, 8), (2, 9)]


def test_point_on_an_edge_is_inside(spark):
    ring = "array(struct(0D x, 0D y), struct(0D x, 4D y), struct(4D x, 4D y), struct(4D x, 0D y), struct(0D x, 0D y))"
    hole = "array(struct(1D x, 1D y), struct(1D x, 2D y), struct(2D x, 2D y), struct(2D x, 1D y), struct(1D x, 1D y))"
    df = spark.createDataFrame([(0.0, 2.0), (1.5, 1.5), (3.0, 3.0), (5.0, 1.0)], "x double, y double").withColumn("r", F.expr(f"array({ring}, {hole})"))
    assert [r[0] for r in df.select(joins.point_in_rings(F.col("x"), F.col("y"), F.col("r"))).collect()] == [True, False, True, False]


def test_contract_is_checked(spark):
    a = spark.createDataFrame([(1,), (1,)], "k int")
    b = spark.createDataFrame([(1, "x")], "k int, v string")
    assert joins.checked_join(a, b, ["k"], "left", "many_to_one").count() == 2
    with pytest.raises(ValueError, match="one_to_one"):
        joins.checked_join(a, b, ["k"])
    assert joins.common_key(a, b, ["v", "k"]) == "k"


def test_gap_of_exactly_the_limit_stays(spark):
    df = spark.createDataFrame([(1, "u", 0), (2, "u", 10), (3, "u", 21), (4, "v", 5)], "id int, u string, t long")
    assert rows(windows.sessions(df, ["u"], "t", 10, "id").select("id", "session")) == [(1, 1), (2, 1), (3, 2), (4, 1)]
    assert rows(windows.sessions(df, [], "t", 10, "id").select("id", "session")) == [(1, 1), (2, 1), (3, 2), (4, 1)]


def test_leave_one_out_alone_is_null(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("a", 3, None), ("b", 4, 7.0)], "g string, id int, v double")
    got = {r["id"]: (r["peer_median"], r["delta"]) for r in windows.leave_one_out(df, ["g"], "id", "v").collect()}
    assert got == {1: (3.0, -2.0), 2: (1.0, 2.0), 3: (2.0, None), 4: (None, None)}


def test_auroc_ties_and_one_class(spark):
    df = spark.createDataFrame([("x", 1.0, 1), ("x", 1.0, 0), ("x", 2.0, 1), ("y", 1.0, 1), ("y", None, 0)], "g string, s double, y int")
    got = {r["g"]: r["auc"] for r in statistics.auroc(df, "s", "y", ["g"]).collect()}
    assert got == {"x": 0.75, "y": None}


def test_sign_test_and_wilson_without_rows(spark):
    df = spark.createDataFrame([(0, 0), (5, 0), (3, 3)], "w long, l long")
    assert [round(r[0], 6) for r in df.select(statistics.sign_test("w", "l")).collect()] == [1.0, 0.0625, 1.0]
    lo, hi = statistics.wilson(F.col("l"), F.col("l"))
    assert [r[0] is None for r in df.select(lo).collect()] == [True, True, False]


def test_ranked_merge_takes_label_from_the_surest(spark):
    df = spark.createDataFrame([("k", 1, None, None, "a|b", 0), ("k", 2, 1, "x", "c|a", 2), ("k", 3, 0, "y", None, 1), (None, 4, 1, None, "z", 0)], "k string, o int, label int, name string, src string, r int")
    got = {r["k"]: tuple(r)[1:] for r in aggregates.ranked_merge(df.withColumn("f", F.col("o") == 2), "k", ["label"], F.col("r"), F.col("o"), ["name"], ["src"], ["f"]).collect()}
    assert got == {"k": (1, "x", "a|b|c", True, 3), None: (1, None, "z", False, 1)}


def test_components_are_transitive(spark):
    links = spark.createDataFrame([(3, 2), (2, 9), (5, 5), (7, 8), (8, 7), (None, 1)], "a int, b int")
    assert rows(connected_components(links)) == [(2, 2), (3, 2), (5, 5), (7, 7), (8, 7), (9, 2)]
    assert connected_components(links.limit(0)).count() == 0
    chain = spark.range(200).selectExpr("id a", "id + 1 b")
    assert rows(connected_components(chain).groupBy("component").count()) == [(0, 201)]


def test_leave_one_out_of_all_rows(spark):
    from statistics import median

    from matchbook.plans import QUERIES

    rng = np.random.default_rng(2)
    data = [(g, 100 * g + i, None if rng.random() < 0.1 else float(rng.integers(9))) for g in range(1, 13) for i in range(g if g < 12 else 60)]
    df = spark.createDataFrame(data, "g int, id int, v double")
    got = {r["id"]: (r["peer_median"], r["peer_scale"]) for r in windows.leave_one_out(df, ["g"], "id", "v").collect()}
    for g, i, _ in data:
        others = [v for h, j, v in data if h == g and j != i and v is not None]
        m = median(others) if others else None
        assert got[i] == (m, pytest.approx(1.4826 * median(abs(v - m) for v in others)) if others else None)
    plan = windows.leave_one_out(df, ["g"], "id", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    small = "/root/testdata/sf0.001"
    orders = spark.read.parquet(f"{small}/orders.parquet")
    assert QUERIES["loo_robust_z"](spark, small).count() == orders.count()
    pairs = orders.where("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderdate").alias("f")).join(orders.where("o_orderstatus = 'O'"), "o_custkey").where("abs(datediff(f, o_orderdate)) <= 1500")
    from matchbook.plans.analytics import _slot_costs

    assert _slot_costs(spark, small).count() == pairs.count()
    assert _slot_costs(spark, "/root/testdata/sf0.01").where("o_custkey >= 200").count() > 0


def test_mask_regions_of_all_patches(spark, tmp_path):
    from matchbook.plans import QUERIES

    rng = np.random.default_rng(4)
    masks = {i: rng.random((8, 8)) < 0.35 for i in (0, 59, 60, 999)}
    spark.createDataFrame([(i, m.astype(float).ravel().tolist(), 0) for i, m in masks.items()], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: (r["n_regions"], r["largest"], r["nearest"]) for r in QUERIES["mask_regions"](spark, str(tmp_path)).collect()}
    assert set(got) == set(masks)
    for i, m in masks.items():
        left, found = {tuple(map(int, x)) for x in np.argwhere(m)}, []
        while left:
            todo, region = [left.pop()], []
            while todo:
                r, c = todo.pop()
                region.append((r, c))
                near = {(r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                left -= near
                todo += near
            found.append(region)
        nearest = min(np.hypot(*(np.mean(x, axis=0) - 3.5)) for x in found)
        assert got[i] == (len(found), max(map(len, found)), pytest.approx(nearest, abs=1e-6))


def test_logistic_scores_every_label(spark):
    from matchbook.plans import QUERIES

    small = "/root/testdata/sf0.001"
    got = QUERIES["logo_logistic"](spark, small)
    want = spark.read.parquet(f"{small}/embeddings.parquet").where("label IS NOT NULL").select("vec_id", F.col("label") % 2)
    assert rows(got.select("vec_id", "y")) == rows(want)


def test_optimal_solves_the_components_of_a_block(spark, monkeypatch):
    monkeypatch.setattr(assignment, "MAX_BLOCK", 2)
    data = [(b, 10 * g + s, 10 * g + c, float((s * 3 + c * 5 + g) % 7)) for b in ("x", None) for g in range(5) for s in (0, 1) for c in (0, 1)]
    got = rows(assignment.optimal(spark.createDataFrame(data, "site string, slot int, candidate int, cost double"), "site").groupBy("site").agg(F.count("*"), F.sum("cost")))
    cost = {x[1:3]: x[3] for x in data}
    best = sum(min(cost[10 * g, 10 * g] + cost[10 * g + 1, 10 * g + 1], cost[10 * g, 10 * g + 1] + cost[10 * g + 1, 10 * g]) for g in range(5))
    assert got == sorted([("x", 10, best), (None, 10, best)], key=str)


def test_optimal_assignment(spark):
    cost = [("s", "a", 1, 4.0), ("s", "a", 2, 1.0), ("s", "b", 1, 2.0), ("s", "b", 2, 0.5), ("t", "c", 9, 1.0)]
    got = assignment.optimal(spark.createDataFrame(cost, "site string, slot string, candidate int, cost double"), "site")
    assert rows(got.select("slot", "candidate")) == [("a", 2), ("b", 1), ("c", 9)]


def test_gates(spark):
    df = spark.createDataFrame([("g", "a", 1), ("g", "b", 1), ("h", "a", 0), (None, "a", 1)], "g string, split string, y int")
    assert rows(gates.leaks(df, "g", "split")) == [("g", 2)]
    assert rows(gates.one_class_splits(df, "split", "y").select("split")) == [("b",)]
    with pytest.raises(ValueError, match="twice"):
        gates.require(gates.repeated_keys(df, ["split"]), "twice")
    slots = spark.createDataFrame([("x", "x", None), ("x", "y", None)], "t0 string, t90 string, t360 string")
    assert gates.equal_slots(slots, ["t0", "t90", "t360"]).count() == 1


def test_state_and_pending(spark):
    log = spark.createDataFrame([("a", 1, "failed", 1), ("a", 2, "done", 1), ("b", 1, "done", 0)], "k string, seq int, status string, v int")
    assert rows(incremental.latest(log, "k", "seq").select("k", "status")) == [("a", "done"), ("b", "done")]
    work = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert rows(incremental.pending(work, log, "k", F.col("status") == "done", "v", 1)) == [("b",), ("c",)]
    expected = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "c")], "g string, k string")
    have = log.withColumn("g", F.lit("g"))
    assert rows(incremental.complete_groups(expected, have, "g", "k", F.col("status") == "done").select("g", "complete")) == [("g", True), ("h", False)]


def test_names_and_aliases():
    assert canonical.tidy_names(["A b", "a-b", "", "A B"]) == ["a_b", "a_b_2", "column", "a_b_3"]
    assert canonical.first_column(["Site Name", "LAT"], ["lat", "site_name"]) == "LAT"
    assert canonical.find_column(["release_start", "start"], ["start"], ["release"]) == "start"


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id|name\n1|x\n2|y\n")
    t = readers.read_delimited(spark, str(tmp_path / "a.csv"))
    assert rows(t) == [("1", "x"), ("2", "y")]
    (tmp_path / "b.jsonl").write_text('{"id": 1}\nbroken\n{"id": 2}\n')
    from pyspark.sql import types as T

    schema = T.StructType().add("id", "long")
    assert rows(readers.read_catalog(spark, str(tmp_path / "b.jsonl"), schema).select("id")) == [(1,), (2,)]
    (tmp_path / "c.json").write_text('[\n{"id": 5},\n{"id": 6}\n]')
    assert rows(readers.read_json_any(spark, str(tmp_path / "c.json"), schema)) == [(5,), (6,)]
    (tmp_path / "d.geojson").write_text('{"features": [{"properties": {"n": "p"}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}}, {"properties": {"n": "q"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0]]]}}]}')
    assert rows(readers.read_geojson(spark, str(tmp_path / "d.geojson"), T.StructType().add("n", "string"))) == [("p", 1.5, 2.5), ("q", None, None)]
    assert readers.inventory(spark, str(tmp_path), "*.csv").count() == 1
    before = sinks.release_manifest(spark, str(tmp_path), "*.csv").collect()
    frozen = spark.createDataFrame(before)
    (tmp_path / "a.csv").write_text("id|name\n1|z\n")
    assert rows(sinks.changed_files(sinks.release_manifest(spark, str(tmp_path), "*.csv"), frozen)) == [("a.csv", "changed")]


def test_running_sums_over_many_partitions(spark):
    rng = np.random.default_rng(3)
    data = [(None if g == 3 else int(g), int(t), int(v)) for g in range(4) for t, v in zip(rng.permutation(300), rng.integers(0, 9, 300), strict=True)]
    df = spark.createDataFrame(data, "g int, t int, v int")
    got = {(r["g"], r["t"]): r["before_v"] for r in prefix.running_sums(df, ["g"], "t", ["v"]).collect()}
    assert got == {(g, t): sum(v for h, u, v in data if h == g and u < t) for g, t, _ in data}
    assert prefix.running_sums(df.limit(0), ["g"], "t", ["v"]).isEmpty()


def test_nearest_on_an_axis(spark):
    rng = np.random.default_rng(4)
    marks = [*rng.integers(-500, 500, 80).tolist(), None]
    points = [*rng.integers(-700, 700, 400).tolist(), None]
    p = spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(points)], "i int, x double")
    a = spark.createDataFrame([(None if y is None else float(y),) for y in marks], "y double")
    got = {r["i"]: r["nearest"] for r in prefix.nearest_on_axis(p, "x", a, "y", 100).collect()}
    for i, x in enumerate(points):
        best = None if x is None else min((abs(x - y), y) for y in marks if y is not None)
        assert got[i] == (None if best is None or best[0] > 100 else best[1])
    assert {r["nearest"] for r in prefix.nearest_on_axis(p, "x", a.limit(0), "y").collect()} == {None}


def test_bootstrap_against_expanded_rows(spark, monkeypatch):
    monkeypatch.setattr(statistics, "_PART_ROWS", 40)
    rng = np.random.default_rng(5)
    data = [(i, "a" if i % 3 else None, float(v)) for i, v in enumerate(rng.integers(0, 12, 300))] + [(999, "a", None)]
    df = spark.createDataFrame(data, "id int, s string, v double")
    got = {r["s"]: r for r in statistics.bootstrap(df, "id", "v", 90, 1, ["s"]).collect()}
    hashes = {r["id"]: r["h"] for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    for s in ("a", None):
        own = [(hashes[i], v) for i, t, v in data if t == s and v is not None]
        times = statistics._taken(np.array([h for h, _ in own]), np.arange(90), 1)
        drawn = [np.repeat([v for _, v in own], t) for t in times]
        for name, of in (("mean", np.mean), ("median", np.median)):
            want = np.percentile([of(x) for x in drawn], [2.5, 97.5])
            assert np.allclose([got[s][f"{name}_lo"], got[s][f"{name}_hi"]], want)
        assert got[s]["n_replicates"] == 90
    assert abs(statistics._taken(np.arange(100_000), np.array([0]), 1).mean() - 1) < 0.02


def test_signed_rank_of_little(spark):
    df = spark.createDataFrame([(0.0,), (None,)], "d double")
    assert tuple(statistics.signed_rank(df, "d").first()) == (0, None, None)
    df = spark.createDataFrame([(1.0,), (-1.0,), (3.0,)], "d double")
    assert tuple(statistics.signed_rank(df, "d").first())[:2] == (3, 4.5)


def test_greedy_controls_in_turn(spark):
    from matchbook.plans import QUERIES
    from matchbook.plans.analytics import _slot_costs

    folder = "/root/testdata/sf0.001"
    used, want = set(), set()
    for slot, _, candidate in sorted(tuple(r) for r in _slot_costs(spark, folder).select("slot", "cost", "candidate").collect()):
        if ("s", slot) not in used and ("c", candidate) not in used:
            used |= {("s", slot), ("c", candidate)}
            want.add((slot, candidate))
    assert {tuple(r) for r in QUERIES["greedy_controls"](spark, folder).select("slot", "candidate").collect()} == want


def test_quantiles_of_one_group_of_all_rows(spark):
    from matchbook.operators.quantiles import quantiles, with_quantiles

    rng = np.random.default_rng(4)
    hot, few = rng.standard_normal(20000).round(3), [3.0, 1.0, 2.0, 2.0]
    rows = [("hot", float(v)) for v in hot] + [("few", v) for v in few] + [(None, 5.0), ("one", -1.0), ("none", None), ("nan", float("nan")), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r["k"]: r["q"] for r in quantiles(df, ["k"], "v", shares).collect()}
    assert set(got) == {"hot", "few", None, "one"}
    for k, own in (("hot", hot), ("few", few), (None, [5.0]), ("one", [-1.0])):
        assert np.allclose(got[k], np.quantile(own, shares))
    # the same with the group dealt over several partitions, so that no task holds it
    from matchbook.operators.prefix import ranged

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert ranged(df.where("k = 'hot'").groupBy("k", "v").count(), ["k", "v"], "t").select("__part").distinct().count() == 4
        dealt = {r["k"]: r["q"] for r in quantiles(df, ["k"], "v", shares).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dealt == got
    every = quantiles(df, [], "v", [0.5]).collect()
    assert np.isclose(every[0]["q"][0], np.median([*hot, *few, 5.0, -1.0]))
    assert quantiles(df.limit(0), ["k"], "v", [0.5]).count() == 0
    groups = with_quantiles(df.groupBy("k").count(), df, ["k"], "v", {"m": 0.5}).collect()
    assert {r["k"]: r["m"] for r in groups}["none"] is None and len(groups) == 6


def test_nearest_place_equals_all_pairs(spark, monkeypatch):
    from matchbook.operators import places

    monkeypatch.setattr(places, "PER_CELL", 4)
    rng = np.random.default_rng(8)
    right = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 300), rng.uniform(-180, 180, 300), strict=True))]
    right += [(1000 + i, 10 + float(a), 20 + float(b)) for i, (a, b) in enumerate(rng.normal(0, 0.01, (200, 2)))]  # a dense spot
    right += [(2000 + i, 50.0, 8.0) for i in range(150)] + [(3000, -50.0, 179.99), (None, 1.0, 1.0), (3001, None, 2.0), (3002, float("nan"), 2.0)]
    left = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(-90, 90, 200), rng.uniform(-180, 180, 200), strict=True))]
    left += [(500 + i, 10.001, 20.001) for i in range(100)] + [(700, 50.0, 8.0), (700, 50.0, 8.0), (701, -50.0, -179.99), (702, 90.0, 0.0), (703, -90.0, 5.0), (704, None, 1.0), (705, 1.0, float("inf"))]
    a = spark.createDataFrame(left, "l_id long, l_lat double, l_lon double").withColumn("spot", F.lit("x"))
    b = spark.createDataFrame(right, "r_id long, r_lat double, r_lon double").withColumn("cell", F.lit(1))
    got = places.nearest_place(a, b).collect()
    assert len(got) == len(left)
    ok = np.array([r for r in right if r[0] is not None and r[1] is not None and np.isfinite(r[1])], float)
    for r in got:
        if r["l_lat"] is None or not np.isfinite(r["l_lon"]):
            assert (r["r_id"], r["distance"]) == (None, None)
            continue
        p, q = np.radians(r["l_lat"]), np.radians(ok[:, 1])
        h = np.sin((q - p) / 2) ** 2 + np.cos(p) * np.cos(q) * np.sin(np.radians(ok[:, 2] - r["l_lon"]) / 2) ** 2
        km = 2 * geo.EARTH_KM * np.arcsin(np.sqrt(np.minimum(1, h)))
        assert abs(r["distance"] - km.min()) < 1e-6
        assert r["r_id"] in ok[km <= km.min() + 1e-6][:, 0]
        if r["l_id"] == 700:
            assert r["r_id"] == 2000
    none = places.nearest_place(a, b.limit(0))
    assert none.where("r_id IS NOT NULL").isEmpty() and none.count() == len(left)
    assert places.nearest_place(a.limit(0), b).count() == 0
    one = places.nearest_place(a, b.where("r_id = 3000")).where("r_id = 3000").count()
    assert one == len(left) - 2


@pytest.mark.parametrize("most", [1 << 20, 60])
def test_greedy_in_one_pass_per_component(spark, most):
    """The rounds don't grow with the slots of a block; large components go through in parts."""
    rng = np.random.default_rng(2)
    data = [(0, s, c, float(abs(s - c))) for s in range(20) for c in range(20)]  # every slot waits for the one before
    data += [(1, 100 + int(s), 200 + int(c), float(x)) for s, c, x in zip(rng.integers(0, 40, 300), rng.integers(0, 40, 300), rng.integers(0, 5, 300), strict=True)]
    data = list({(g, s, c): (g, s, c, x) for g, s, c, x in data}.values())
    df = spark.createDataFrame(data, "g int, s int, c int, x double").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for order in (("s", "x", "c"), ("x", "s", "c")):
            got = {tuple(r) for r in assignment.greedy(df, [F.col(o) for o in order], "s", "c", most).collect()}
            want, a, b = set(), set(), set()
            for g, s, c, x in sorted(data, key=lambda r: [dict(g=r[0], s=r[1], c=r[2], x=r[3])[o] for o in order]):
                if s not in a and c not in b:
                    want.add((s, c))
                    a.add(s)
                    b.add(c)
            assert got == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert assignment.greedy(df.limit(0), [F.col("x"), F.col("s"), F.col("c")], "s", "c").count() == 0
    null = spark.createDataFrame([(None, 1, 1.0), (None, 2, 0.5), (3, 1, 2.0)], "s int, c int, x double")
    assert {tuple(r) for r in assignment.greedy(null, [F.col("x"), F.col("s"), F.col("c")], "s", "c").collect()} == {(None, 2), (3, 1)}


def test_windows_of_a_hot_key(spark):
    """A key with a third of all rows is spread over partitions; results are as of one pass."""
    rng = np.random.default_rng(6)
    data = [(i, ["hot", "a", None, "b"][int(k)], int(t), float(v)) for i, (k, t, v) in enumerate(zip(np.minimum(rng.integers(0, 9, 3000) // 2, 3), rng.integers(0, 20000, 3000), rng.integers(0, 60, 3000), strict=True))]
    data += [(9000, "one", 5, 1.0), (9001, "two", 1, 2.0), (9002, "two", 12, None), (9003, "two", 11, float("nan"))]
    df = spark.createDataFrame(data, "id long, k string, t long, v double").withColumn("n", F.lit(1)).repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert prefix.ranged(df.where("k = 'hot'"), ["k", "t", "id"], "t").select("__part").distinct().count() == 4
        got = {r["id"]: r["session"] for r in windows.sessions(df, ["k"], "t", 10, "id").collect()}
        peers = {r["id"]: r for r in windows.leave_one_out(df, ["k"], "id", "v").collect()}
        tests = df.where("v IS NOT NULL AND NOT isnan(v)").select("id", (F.col("v") / 60).alias("p"))
        q = {r["id"]: r["q"] for r in windows.benjamini_hochberg(tests, "p").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k in ("hot", "a", None, "b", "one", "two"):
        own = sorted((t, i) for i, key, t, _ in data if key == k)
        session, last = 0, None
        for t, i in own:
            session += last is None or t - last > 10
            last = t
            assert got[i] == session
    for i, k, _, v in data[::37] + data[-4:]:
        if k is None:
            assert i not in peers
            continue
        others = np.array([x for j, key, _, x in data if key == k and j != i and x is not None and not np.isnan(x)])
        r = peers[i]
        if not len(others):
            assert (r["peer_median"], r["peer_scale"]) == (None, None)
            continue
        m = np.median(others)
        assert r["peer_median"] == m and np.isclose(r["peer_scale"], 1.4826 * np.median(np.abs(others - m)))
    line = sorted((v / 60, i) for i, _, _, v in data if v is not None and not np.isnan(v))
    low = 1.0
    for rank in range(len(line), 0, -1):
        low = min(low, line[rank - 1][0] * len(line) / rank)
        assert np.isclose(q[line[rank - 1][1]], low)


@pytest.mark.parametrize("part", [40, 100_000])
def test_bootstrap_auc_against_expanded_rows(spark, monkeypatch, part):
    monkeypatch.setattr(statistics, "_PART_ROWS", part)
    rng = np.random.default_rng(7)
    data = [(int(i // 2), float(v), int(y)) for i, (v, y) in enumerate(zip(np.where(rng.random(400) < 0.4, 3, rng.integers(0, 30, 400)), rng.integers(0, 2, 400), strict=True))]
    df = spark.createDataFrame([*data, (999, None, 1), (998, 1.0, None), (997, 1.0, 5)], "id int, s double, y int").repartition(4)
    got = statistics.bootstrap_auc(df, "id", "s", "y", 70).first()
    hashes = {r["id"]: r["h"] for r in df.select("id", F.xxhash64("id").alias("h")).collect()}
    times = statistics._taken(np.array([hashes[i] for i, _, _ in data]), np.arange(70), 1)
    s, y = np.array([v for _, v, _ in data]), np.array([t for *_, t in data])

    def area(w):
        p, m = np.repeat(s, w * y), np.repeat(s, w * (1 - y))
        return ((p[:, None] > m).sum() + (p[:, None] == m).sum() / 2) / (len(p) * len(m))

    want = np.percentile([area(w) for w in times], [2.5, 97.5])
    assert np.allclose([got["auc_lo"], got["auc_hi"]], want) and np.isclose(got["auc"], area(np.ones(400, int))) and got["n_replicates"] == 70
    none = statistics.bootstrap_auc(df.where("y = 1"), "id", "s", "y", 5).first()
    assert tuple(none) == (0, None, None, None)


def test_exact_p_equals_enumeration(spark):
    from itertools import combinations, product

    rng = np.random.default_rng(12)
    data, tests = [], {}
    for g in range(14):
        values = rng.integers(-6, 7, int(rng.integers(1, 13))).astype(float)
        tests[g] = values
        data += [(g, float(v), int(rng.random() < 0.5)) for v in values]
    df = spark.createDataFrame([*data, (3, None, 1)], "g int, v double, y int").withColumn("z", F.lit(1))
    got = {r["g"]: r for r in statistics.signed_rank_test(df, "v", ["g"]).collect()}

    def ranks_of(v):
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    for g, values in tests.items():
        v = values[values != 0]
        if not len(v):
            assert g not in got
            continue
        k = ranks_of(np.abs(v))
        w = k[v > 0].sum()
        every = np.array([sum(r for r, s in zip(k, signs, strict=True) if s) for signs in product((0, 1), repeat=len(k))])
        p = min(1, 2 * min((every <= w + 1e-9).mean(), (every >= w - 1e-9).mean()))
        assert got[g]["w_plus"] == w and np.isclose(got[g]["p"], p)
    got = {r["g"]: r for r in statistics.rank_sum(df, "v", "y", ["g"]).collect()}
    for g in tests:
        own = [(v, y) for h, v, y in data if h == g]
        k, y = ranks_of(np.array([v for v, _ in own])), np.array([y for _, y in own])
        if y.min() == y.max():
            assert got[g]["p"] == 1
            continue
        w = k[y == 1].sum()
        every = np.array([sum(k[list(c)]) for c in combinations(range(len(k)), int(y.sum()))])
        p = min(1, 2 * min((every <= w + 1e-9).mean(), (every >= w - 1e-9).mean()))
        assert np.isclose(got[g]["p"], p) and np.isclose(got[g]["u"], w - y.sum() * (y.sum() + 1) / 2)
    none = statistics.signed_rank_test(df.limit(0), "v").first()
    assert (none["n"], none["p"]) == (0, 1.0)
    import math

    z = spark.createDataFrame([(x,) for x in (0.0, -0.5, 1.96, 5.9, 6.1, 9.0)], "z double").select("z", statistics.normal_tails(F.col("z")).alias("p")).collect()
    assert all(math.isclose(r["p"], math.erfc(abs(r["z"]) / math.sqrt(2)), rel_tol=1e-6, abs_tol=1e-11) for r in z)


def test_absorbed_r2_equals_dummies(spark):
    small = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{small}/documents.parquet").join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id").withColumn("x", F.col("doc_id") % 7).orderBy("doc_id")
    got = statistics.absorbed_r2(docs, "source", "quality", ["n_chars", "x"]).first()
    t = docs.select("source", "quality", "n_chars", "x").toPandas().dropna(subset=["quality", "n_chars"])
    levels = sorted(set(t["source"].fillna("")))
    x = np.column_stack([t["n_chars"], t["x"], *[(t["source"].fillna("") == s) for s in levels]]).astype(float)
    y = t["quality"].to_numpy(float)
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    r2 = 1 - ((y - x @ b) ** 2).sum() / ((y - y.mean()) ** 2).sum()
    assert np.isclose(got["r2"], r2) and np.allclose(got["coefficients"], b[:2]) and got["n_groups"] == len(levels)
    same = statistics.absorbed_r2(docs.withColumn("c", F.lit(1.0)), "source", "quality", ["n_chars", "x", "c"]).first()
    assert np.isclose(same["r2"], r2)
    assert statistics.absorbed_r2(docs.limit(0), "source", "quality", ["x"]).first()["r2"] is None


def test_resize_crop_and_pad(spark):
    from matchbook.functions import patches

    rng = np.random.default_rng(3)
    images = {i: rng.random((6, 6)) for i in range(3)}
    images[1][2:4, 1:3] = np.nan
    images[2][:] = np.nan
    px = patches.pixels(spark.createDataFrame([(i, m.ravel().tolist()) for i, m in images.items()], "id int, a array<double>"), "id", "a", 6)

    def grid(df, n):
        out = {i: np.full((n, n), np.inf) for i in images}
        for r in df.collect():
            out[r["id"]][r["row"], r["col"]] = np.nan if r["v"] is None else r["v"]
        return out

    for n in (1, 4, 6, 11):
        got = grid(patches.resize(px, ["id"], 6, n), n)
        at = np.linspace(0, 5, n)
        lo = np.minimum(np.floor(at).astype(int), 5)
        hi, w = np.minimum(lo + 1, 5), at - lo
        for i, m in images.items():
            total, weight = np.zeros((n, n)), np.zeros((n, n))
            for rows_, wr in ((lo, 1 - w), (hi, w)):
                for cols, wc in ((lo, 1 - w), (hi, w)):
                    v = m[np.ix_(rows_, cols)]
                    k = np.where(np.isnan(v), 0, np.outer(wr, wc))
                    total += np.where(k > 0, np.nan_to_num(v) * k, 0)
                    weight += k
            with np.errstate(invalid="ignore"):
                assert np.allclose(got[i], np.where(weight > 0, total / weight, np.nan), equal_nan=True)
    cut = grid(patches.crop(px, 6, 3, 0, 5), 3)
    assert np.allclose(cut[0], images[0][0:3, 3:6])
    wide = grid(patches.pad(px, ["id"], 6, 9, -1.0), 9)
    assert np.allclose(wide[0], np.pad(images[0], (1, 2), constant_values=-1))
    assert grid(patches.pad(px, ["id"], 6, 6), 6)[0].shape == (6, 6)
    with pytest.raises(ValueError):
        patches.crop(px, 6, 7, 0, 0)
    assert patches.resize(px.limit(0), ["id"], 6, 3).count() == 0


def test_json_of_any_shape(spark):
    from matchbook.functions import json_walk

    texts = ['{"a": {"b": [1, "x", {"Lat": "5.5", "longitude": 7}]}, "e": "", "n": null, "t": true}', "[]", '"alone"', None, "no json {", "{}", '[["deep", [["er"]]]]', '{"plume": {"max_lat": 91, "lat2": -3, "lon": 4}, "Source": [{"lat": 1, "lon": 200}, {"lat": 1, "LON": "z"}]}', '{"a": "x"}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, j string").withColumn("path", F.lit(1))
    found = json_walk.nodes(df, "id", "j")
    strings = sorted((r["id"], r["path"], r["text"]) for r in json_walk.all_strings(found, "id").collect())
    want = []

    def walk(i, path, x):
        if isinstance(x, str):
            want.append((i, path, x))
        elif isinstance(x, dict):
            for k, v in x.items():
                want.append((i, f"{path}/{k}", k))
                walk(i, f"{path}/{k}", v)
        elif isinstance(x, list):
            for k, v in enumerate(x):
                walk(i, f"{path}/{k}", v)

    import json

    for i, t in enumerate(texts):
        if t and t != "no json {":
            walk(i, "", json.loads(t))
    assert strings == sorted(want)
    pairs = {tuple(r) for r in json_walk.coordinate_pairs(found, "id").collect()}
    assert pairs == {(0, "/a/b/2/lat/longitude", 5.5, 7.0, 1), (7, "/plume/lat2/lon", -3.0, 4.0, 4)}
    assert json_walk.nodes(df.limit(0), "id", "j").count() == 0


def test_nested_group_folds_equal_a_plain_version(spark):
    rng = np.random.default_rng(9)
    data = [(None if g == 7 else f"g{g:02d}", y) for g in range(30) for y in rng.integers(0, 2, int(rng.integers(1, 12))).tolist() + [None]]
    df = spark.createDataFrame(data, "g string, y int")
    got = {r["g"]: r for r in assignment.nested_group_folds(df.repartition(5), "g", "y", 5, 4).collect()}
    again = {r["g"]: r for r in assignment.nested_group_folds(df.repartition(2), "g", "y", 5, 4).collect()}
    assert got == again

    def deal(names, folds):
        count = {g: [sum(1 for h, y in data if h == g and y == k) for k in (0, 1)] for g in names}
        total = [sum(c[k] for c in count.values()) for k in (0, 1)]
        held, out = [[0, 0] for _ in range(folds)], {}
        for g in sorted(names, key=lambda g: -float(np.std(count[g]))):
            best = None
            for f in range(folds):
                held[f] = [held[f][k] + count[g][k] for k in (0, 1)]
                score = round(float(np.mean([np.std([h[k] / total[k] for h in held]) for k in (0, 1)])), 12)
                size = sum(held[f])
                held[f] = [held[f][k] - count[g][k] for k in (0, 1)]
                if best is None or (score, size - sum(count[g]), f) < best:
                    best = (score, size - sum(count[g]), f)
            out[g] = best[2]
            held[best[2]] = [held[best[2]][k] + count[g][k] for k in (0, 1)]
        rate = total[0] / sum(total)
        nearest = min((abs(h[0] / sum(h) - rate), f) for f, h in enumerate(held) if min(h) > 0)[1]
        return out, nearest

    names = sorted({g for g, _ in data}, key=lambda g: (g is not None, g or ""))
    outer, test = deal(names, 5)
    inner, validation = deal([g for g in names if outer[g] != test], 4)
    for g in names:
        assert (got[g]["fold"], got[g]["inner_fold"]) == (outer[g], inner.get(g))
        assert got[g]["split"] == ("test" if outer[g] == test else "validation" if inner[g] == validation else "train")
    with pytest.raises(Exception, match="both classes"):
        assignment.nested_group_folds(df.where("y = 1"), "g", "y").collect()


def test_ordinals_do_not_depend_on_partitioning(spark, tmp_path):
    from matchbook.sources import ordinals

    for k in range(3):
        (tmp_path / f"f{k}.csv").write_text("a,b\n" + "".join(f"{k}:{i},{'' if i % 4 == 0 else i}\n" for i in range(500)))
    (tmp_path / "f3.csv").write_text("a,b\n")

    def numbered():
        return {r["a"]: (r["ordinal"], r["b"]) for r in ordinals.with_ordinals(spark.read.option("header", True).schema("a string, b int").csv(str(tmp_path))).collect()}

    whole = numbered()
    assert whole == {f"{k}:{i}": (500 * k + i, None if i % 4 == 0 else i) for k in range(3) for i in range(500)}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        assert numbered() == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    source = spark.createDataFrame([(0, 10), (1, None), (2, 30)], "ordinal long, v int")
    rows_ = spark.createDataFrame([("a", 0, None), ("b", 1, 5), ("c", 2, 6), ("d", 9, 7), ("e", None, 8), ("f", -1, 9), ("g", 2, None)], "k string, at int, v long")
    assert rows(ordinals.repaired(rows_, "v", "at", source, "v", F.col("k") != "c").select("k", "v").where("v IS NOT NULL")) == [("a", 10), ("b", 5), ("c", 6), ("d", 7), ("e", 8), ("f", 9), ("g", 30)]
    both = ordinals.side_by_side(source, spark.createDataFrame([(1, 7, "x"), (3, 8, "y")], "ordinal long, v int, w string"))
    assert {tuple(r) for r in both.select("ordinal", "v", "v_right", "w").collect()} == {(0, 10, None, None), (1, None, 7, "x"), (2, 30, None, None), (3, None, 8, "y")}


def test_sparse_assignment_costs_what_the_grid_does(spark, monkeypatch):
    rng = np.random.default_rng(31)
    for _ in range(150):
        n, m = int(rng.integers(1, 12)), int(rng.integers(1, 12))
        allowed = np.argwhere(rng.random((n, m)) < rng.choice([0.2, 0.5, 1.0]))
        if not len(allowed):
            continue
        s, c = np.unique(allowed[:, 0], return_inverse=True)[1], np.unique(allowed[:, 1], return_inverse=True)[1]
        cost = rng.integers(-5, 30, len(s)).astype(float)
        high = (np.abs(cost).max() + 1) * (s.max() + 2) * 4
        grid = np.full((s.max() + 1, c.max() + 1 + s.max() + 1), high)
        grid[s, c] = cost
        dense = assignment._assign(grid)
        want = grid[np.arange(len(dense)), dense].sum()
        got = assignment._assign_sparse(s, c, cost, high)
        chosen = got[got >= 0]
        assert len(set(c[chosen])) == len(chosen) and all(s[k] == i for i, k in enumerate(got) if k >= 0)
        assert np.isclose(cost[chosen].sum() + high * (got < 0).sum(), want)
    # a component with many slots: each has its neighbours
    slots = np.repeat(np.arange(6000), 3)
    data = [("x", int(a), int(a + b), float((a * 7 + b * 13) % 101)) for a, b in zip(slots, np.tile([0, 1, 2], 6000), strict=True)]
    df = spark.createDataFrame(data, "site string, slot int, candidate int, cost double")
    got = assignment.optimal(df, "site").agg(F.count("*"), F.countDistinct("candidate"), F.sum("cost")).first()
    assert got[0] == got[1] == 6000
    few = df.where("slot < 60")
    want = assignment.optimal(few, "site").agg(F.sum("cost")).first()[0]
    monkeypatch.setattr(assignment, "MAX_BLOCK", 1)
    assert assignment.optimal(few, "site").agg(F.sum("cost")).first()[0] == want


def test_links_by_tiers_and_by_either(spark):
    lefts = [(1, 100, 0.0, 0.0, "e1", "s1"), (2, 100, 0.0, 0.0, None, "s1"), (3, 100, 0.0, 0.0, None, None), (4, 100, None, None, None, None), (5, 900, 0.0, 0.0, "e1", "s1")]
    rights = [(11, 105, 80.0, 0.0, "e1", None), (12, 104, 80.0, 0.0, None, "s1"), (13, 101, 0.0, 0.3, None, None), (14, 100, 50.0, 50.0, None, None), (15, 100, 0.0, 0.3, None, None), (16, 103, 80.0, 0.0, None, "s1")]
    left = spark.createDataFrame(lefts, "l_id int, l_t long, l_lat double, l_lon double, event string, site string")
    right = spark.createDataFrame(rights, "r_id int, r_t long, r_lat double, r_lon double, event string, site string")
    got = {r["l_id"]: (r["r_id"], r["method"]) for r in joins.linked_by_tiers(left, right, ["event", "site"], 10, 50.0).collect()}
    assert got == {1: (11, "event"), 2: (16, "site"), 3: (15, "place"), 4: (None, None), 5: (None, None)}
    either = {tuple(r) for r in joins.same_or_close(left.select("l_id", "l_t", "event"), right.select("r_id", "r_t", "event"), ["event"], 1).collect()}
    close = {(a[0], b[0], "time") for a in lefts for b in rights if abs(a[1] - b[1]) <= 1}
    assert either == close | {(1, 11, "key"), (5, 11, "key")}
    assert joins.linked_by_tiers(left, right.limit(0), ["event"], 10, 50.0).where("r_id IS NULL").count() == 5


def test_overlap_clusters_within_a_scene(spark):
    data = [(1, "a", 0.0, 0.0), (2, "a", 0.0, 0.15), (3, "a", 0.0, 0.3), (4, "b", 0.0, 0.0), (5, None, 0.0, 0.0), (6, None, 0.0, 0.0), (7, "a", None, 0.0), (8, "a", 1.0, 1.0)]
    got = joins.overlap_clusters(spark.createDataFrame(data, "id int, scene string, lat double, lon double"), "scene", 10.0)
    assert rows(got.select("id", "cluster", "n_members", "alone")) == [(1, 1, 3, False), (2, 1, 3, False), (3, 1, 3, False), (4, 4, 1, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 1, True), (8, 8, 1, True)]


def test_valid_pixels_and_masks(spark):
    from matchbook.functions import patches

    bands = spark.createDataFrame([(1, 0, 0, 0.0), (1, 0, 0, 2.0), (1, 0, 1, 0.0), (1, 0, 1, 0.0), (1, 1, 0, None), (1, 1, 0, 3.0)], "id int, row int, col int, v double")
    assert {tuple(r) for r in patches.valid_pixels(bands, ["id"]).collect()} == {(1, 0, 0, True), (1, 0, 1, False), (1, 1, 0, False)}
    px = patches.pixels(spark.createDataFrame([(1, [float(i) for i in range(25)]), (2, [float("nan")] * 25)], "id int, a array<double>"), "id", "a", 5)
    got = {r["id"]: r for r in patches.mask_means(px, ["id"], 5).collect()}
    assert (got[1]["source"], got[1]["n_center"], got[1]["n_outer"]) == (12.0, 5, 20) and got[2]["source"] is None


def test_times_with_offsets(spark):
    cases = {"2024-03-01T10:00:00Z": "10:00:00", "2024-03-01 10:00:00+02:00": "08:00:00", "2024-03-01T10:00:00.250-0330": "13:30:00.25", "2024-03-01T10:00+09": "01:00:00", "2024-03-01T10:00:00": "09:00:00", "nan": None, "soon": None, "2024-03-01": "2024-02-29"}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    for r in df.select("want", text.utc_moment(F.col("t"), "Europe/Berlin").cast("string").alias("got")).collect():
        assert (r["got"] is None) == (r["want"] is None) and (r["want"] is None or r["want"] in r["got"])


def test_routes_releases_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z"), (5, "a")], "id int, kind string").withColumn("reason", F.lit("old"))
    sinks.write_routed(df, "kind", ["a", "b"], str(tmp_path / "r"), F.when(F.col("id") > 4, "late"))
    assert rows(spark.read.parquet(str(tmp_path / "r")).select("id", "route", "reason")) == [(1, "a", None), (2, "b", None), (3, "unrouted", "no route"), (4, "unrouted", "unknown route z"), (5, "a", "late")]
    for part, n in (("x", 3), ("y", 1)):
        (tmp_path / "rel" / part).mkdir(parents=True)
        (tmp_path / "rel" / part / "f.txt").write_text("line\n" * n)
    m = sinks.counted_manifest(spark, str(tmp_path / "rel"), "*.txt")
    assert rows(m.select("part", "n_rows", "length")) == [("x", 3, 15), ("y", 1, 5)]
    wrong = sinks.wrong_file_counts(m, spark.createDataFrame([("x", 3), ("y", 2), ("w", 1)], "part string, n long"))
    assert rows(wrong) == [("w", 1, None), ("y", 2, 1)]
    half = spark.createDataFrame([(1, None), (2, 5.0)], "the_id int, value double")
    got = readers.score_filled({"half": half, "none": half.select(F.lit(1).alias("x")), "empty": half.limit(0)}, {"key": ("_id$", 2), "value": ("^value$", 1)}, 0.0).collect()
    assert {r["table"]: (r["n_rows"], r["score"]) for r in got} == {"half": (2, 2.5), "none": (2, 0.0), "empty": (0, 0.0)}


def test_prior_scores_and_command_line(spark, capsys, tmp_path):
    from matchbook.__main__ import main
    from matchbook.operators.models import prior_scores

    df = spark.createDataFrame([(1, "a", 1), (2, "a", 0), (3, "b", 1), (4, None, None), (5, "b", 1)], "id int, g string, y int")
    assert {r["id"]: r["score"] for r in prior_scores(df, "g", "id", "y").collect()} == {1: 1.0, 2: 1.0, 3: 0.5, 4: 0.75, 5: 0.5}
    assert {r["score"] for r in prior_scores(df.where("g = 'a'"), "g", "id", "y").collect()} == {None}
    assert main([]) == 0 and "nearest_place - " in capsys.readouterr().out
    assert main(["value_counts", "--sql"]) == 0 and "SELECT" in capsys.readouterr().out
    assert main(["value_counts", "/root/testdata/sf0.001", "--out", str(tmp_path / "o"), "--format", "json"]) == 0
    assert spark.read.json(str(tmp_path / "o")).count() == 5
    with pytest.raises(SystemExit):
        main(["no_such_query", "/root"])


def test_seasonal_reference_of_a_hot_key(spark):
    rng = np.random.default_rng(14)
    import datetime as dt

    data = [(i, "hot" if i % 3 else f"k{i % 5}", dt.date(2020, 1, 1) + dt.timedelta(days=int(rng.integers(0, 900) // 60 * 60)), bool(rng.integers(2))) for i in range(400)]
    data += [(1000, "alone", dt.date(2020, 5, 5), True), (1001, None, dt.date(2020, 5, 5), True), (1002, "hot", None, True)]
    got = {r["id"]: (r["ref"], r["season"]) for r in joins.seasonal_reference(spark.createDataFrame(data, "id int, k string, day date, other boolean"), "k", "day", "other", "id").collect()}
    for i, k, day, _ in data:
        ways = []
        for j, key, at, other in data:
            if key == k and k is not None and j != i and day and at:
                apart = abs(day.timetuple().tm_yday - at.timetuple().tm_yday)
                ways.append((other, min(apart, 366 - apart), abs((day - at).days), j))
        assert got.get(i) == ((min(ways)[3], min(ways)[1]) if ways else None)


def test_models_see_no_row_of_their_group(spark):
    """In each group the feature says the opposite of what it says elsewhere."""
    from matchbook.operators.models import leave_one_group_out

    rng = np.random.default_rng(1)
    data = [(i, f"g{i % 3}", float((1 if i % 2 else -1) * (-1 if i % 3 == 2 else 1) + rng.normal(0, 0.1)), i % 2) for i in range(90)] + [(200, None, 1.0, 1)]
    df = spark.createDataFrame(data, "id int, g string, x double, y int")
    scores = {r["id"]: r["score"] for r in leave_one_group_out(df, "g", "id", ["x"], "y").collect()}
    assert set(scores) == set(range(90))
    odd = [i for i in range(90) if i % 3 == 2]
    assert np.mean([scores[i] > 0.5 for i in odd if i % 2]) < 0.1 and np.mean([scores[i] < 0.5 for i in odd if not i % 2]) < 0.1
    with pytest.raises(ValueError, match="groups"):
        leave_one_group_out(df, "g", "id", ["x"], "y", most=2)


def test_sniffing_looks_at_more_than_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name, first|x\nJosé, A|1\nB|2\nC|3\n".encode("latin-1"))
    assert readers.sniff(spark, str(tmp_path / "a.csv"))[0] == "|"
    (tmp_path / "b.csv").write_text("a;b\n1;é\n", encoding="utf-8")
    assert readers.sniff(spark, str(tmp_path / "b.csv")) == (";", "UTF-8")
    (tmp_path / "c.csv").write_bytes(b"a\tb\n1\t\xe9\n")
    assert readers.sniff(spark, str(tmp_path / "c.csv")) == ("\t", "ISO-8859-1")
    (tmp_path / "f.csv").write_text("k;v\nä;1\n", encoding="utf-8-sig")
    assert rows(readers.read_delimited(spark, str(tmp_path / "f.csv")).select("k", "v")) == [("ä", "1")]
    (tmp_path / "d.csv").write_text("")
    assert readers.sniff(spark, str(tmp_path / "d.csv"))[1] == "UTF-8"


def test_closest_in_time_of_dense_keys(spark):
    """no pairs are made, and the choice is that of all pairs."""
    rng = np.random.default_rng(5)
    left = [(i, int(t), int(k) if k else None) for i, (t, k) in enumerate(zip(rng.integers(-300, 300, 200), rng.integers(0, 4, 200), strict=True))]
    right = [(i, int(t), int(k) if k else None) for i, (t, k) in enumerate(zip(rng.integers(-300, 300, 90), rng.integers(0, 4, 90), strict=True))]
    got = joins.closest_in_time(spark.createDataFrame(left, "l_id long, l_t long, k int"), spark.createDataFrame(right, "r_id long, r_t long, k int"), ["k"], 9)
    want = {}
    for i, t, k in left:
        near = [(abs(u - t), j) for j, u, m in right if k is not None and k == m and abs(u - t) <= 9]
        if near:
            want[i] = min(near)
    assert {r["l_id"]: (r["gap"], r["r_id"]) for r in got.collect()} == want
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_only_rows_without_a_key_meet_by_place(spark, monkeypatch):
    """rows that a key links are not sent to the candidates by place."""
    sent, by_place = [], joins.near_in_time_and_place
    monkeypatch.setattr(joins, "near_in_time_and_place", lambda a, *rest: sent.append(a.count()) or by_place(a, *rest))
    left = spark.createDataFrame([(i, i, 1.0, 1.0, "x" if i else None) for i in range(50)], "l_id long, l_t long, l_lat double, l_lon double, k string")
    right = spark.createDataFrame([(i, i, 1.0, 1.0, "x") for i in range(50)], "r_id long, r_t long, r_lat double, r_lon double, k string")
    got = {r["l_id"]: (r["r_id"], r["method"]) for r in joins.linked_by_tiers(left, right, ["k"], 10, 5.0).collect()}
    assert got == {i: (i, "k" if i else "place") for i in range(50)} and sent == [1]


def test_same_or_close_groups_no_pairs(spark):
    """each pair once without a grouping of all pairs; a null time links by key only."""
    left = spark.createDataFrame([(1, 5, "a"), (2, None, "a"), (3, 50, None)], "l_id long, l_t long, k string")
    right = spark.createDataFrame([(7, 6, "a"), (8, 90, "a"), (9, 51, None)], "r_id long, r_t long, k string")
    got = joins.same_or_close(left, right, ["k"], 2)
    assert sorted(map(tuple, got.collect())) == [(1, 7, "key"), (1, 8, "key"), (2, 7, "key"), (2, 8, "key"), (3, 9, "time")]
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def _met_in_radius(monkeypatch) -> list[int]:
    met, plain = [], joins.within_radius
    monkeypatch.setattr(joins, "within_radius", lambda a, *rest: met.append(a.count()) or plain(a, *rest))
    return met


def test_overlap_clusters_of_points_at_one_place(spark, monkeypatch):
    """F8: places meet, not points."""
    met = _met_in_radius(monkeypatch)
    places = [(1.0, 1.0), (1.0, 1.01), (9.0, 9.0), (float("nan"), 1.0)]
    points = spark.createDataFrame([(i, "s", *places[i % 4]) for i in range(400)], "id long, scene string, lat double, lon double")
    got = {r["id"]: (r["cluster"], r["n_members"], r["alone"]) for r in joins.overlap_clusters(points, "scene", 10.0).collect()}
    assert got == {i: [(0, 200, False), (0, 200, False), (2, 100, False), (i, 1, True)][i % 4] for i in range(400)}
    assert met == [3]


def _copies(spark, folder, n: int) -> str:
    """Suppliers and customers of two nations, all of a nation at one place."""
    spark.range(n).selectExpr("id * 1000 + id % 2 AS s_suppkey", "int(id % 3) AS s_nationkey").write.parquet(f"{folder}/supplier.parquet")
    spark.range(n).selectExpr("id * 1000 + id % 2 AS c_custkey", "int(id % 2) AS c_nationkey", "9500D AS c_acctbal").write.parquet(f"{folder}/customer.parquet")
    return str(folder)


def test_places_of_suppliers_meet_not_suppliers(spark, tmp_path, monkeypatch):
    """rows at one place are one; results are those of the SQL."""
    import duckdb
    from compare import same_rows
    from matchbook.plans import QUERIES, SQL

    folder = _copies(spark, tmp_path, 60)
    con = duckdb.connect()
    for t in ("supplier", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    met = _met_in_radius(monkeypatch)
    paired, best = [], joins.best_of
    monkeypatch.setattr(joins, "best_of", lambda pairs, *rest: paired.append(pairs.count()) or best(pairs, *rest))
    for name in ("fallback_match", "epsilon_clusters"):
        same_rows(QUERIES[name](spark, folder), con, SQL[name])
    assert met == [2, 2] and sum(paired) <= 12


def test_geojson_collections_stay_small(spark, tmp_path, monkeypatch):
    """there are more collections where there are more features."""
    from matchbook.plans import QUERIES, files

    spark.range(40000).selectExpr("id AS c_custkey", "int(id % 25) AS c_nationkey", "id / 100D AS c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    seen, plain = [], files.readers.read_geojson
    monkeypatch.setattr(files.readers, "read_geojson", lambda s, path, kind: seen.append(path) or plain(s, path, kind))
    assert QUERIES["geojson_features"](spark, str(tmp_path)).count() == 40000
    assert spark.read.text(seen[0]).selectExpr("max(length(value) - length(replace(value, 'c_custkey', ''))) / 9").first()[0] < 3000


def test_small_blocks_need_no_components_in_spark(spark, monkeypatch):
    """blocks are split in the task that solves them, with the choices of the large path."""
    rng = np.random.default_rng(2)
    data = [(None if b == 7 else b, int(s), int(c), float(rng.integers(0, 9))) for b in range(60) for s, c in {(s, c) for s, c in rng.integers(0, 6, (9, 2)).tolist()}]
    df = spark.createDataFrame(data, "b long, slot long, candidate long, cost double")
    with monkeypatch.context() as m:
        m.setattr(assignment, "SMALL_BLOCK", 0)
        want = rows(assignment.optimal(df, "b"))
    monkeypatch.setattr(assignment, "connected_components", None)
    assert rows(assignment.optimal(df, "b")) == want


def test_groups_are_placed_by_plain_numbers(spark):
    """a hundred thousand groups take seconds, not a minute."""
    import time

    counts = np.random.default_rng(3).integers(0, 9, (100_000, 2)).astype(float)
    start = time.process_time()
    fold = assignment._placed_by_spread(counts, 5)
    assert time.process_time() - start < 8 and np.bincount(fold, minlength=5).min() > 10_000


def test_average_rank_sorts_no_rows(spark):
    """rows look their rank up; ties share the mean, or the best from the top."""
    df = spark.createDataFrame([(1, "a", 5.0), (2, "a", 5.0), (3, "a", 7.0), (4, None, 1.0)], "id int, g string, v double")
    got = windows.average_rank(df, ["g"], "v")
    assert rows(got.select("id", "average_rank", "min_rank")) == [(1, 1.5, 2), (2, 1.5, 2), (3, 3.0, 1), (4, 1.0, 1)]
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_complete_groups_in_one_aggregate(spark):
    """no join of both sides; null keys stay incomplete."""
    want = spark.createDataFrame([("g", "1"), ("g", "1"), ("h", "2"), ("i", None)], "g string, k string")
    have = spark.createDataFrame([("g", "1", True), ("h", "2", False), ("h", "2", True), ("i", None, True), ("j", "9", True)], "g string, k string, ok boolean")
    got = incremental.complete_groups(want, have, "g", "k", F.col("ok"))
    assert rows(got) == [("g", 1, True), ("h", 1, True), ("i", 1, False), ("j", 0, False)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_weighted_values_are_not_counted_again(spark):
    """values with weights go straight to their range partitions, repeated or not."""
    from matchbook.operators.quantiles import at_ranks

    df = spark.createDataFrame([("a", 1.0, 2), ("a", 3.0, 1), ("a", 3.0, 2), ("a", 9.0, 1)], "g string, v double, w long")
    got = at_ranks(df, ["g"], "v", lambda n: [F.lit(0), F.lit(2), F.lit(4), F.lit(5)], F.col("w")).collect()
    assert [(r["g"], r["n"], r["at"]) for r in got] == [("a", 6, [1.0, 3.0, 3.0, 9.0])]


def test_qvalues_do_not_depend_on_how_a_sum_rounds(spark, tmp_path):
    """Large discounts that cancel out leave a plain sum of doubles off by more than 1e-6 of p."""
    import math

    from matchbook.plans import QUERIES

    parts = {k: [6e7] + [0.0003 * k] * 4000 + [-6e7] for k in (1, 2, 3)}
    made = [(k, v) for k, values in parts.items() for v in values]
    spark.createDataFrame(made, "l_suppkey long, l_discount double").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    mean = math.fsum(v for _, v in made) / len(made)
    ps = sorted((round(min(1.0, math.exp(-abs(math.fsum(v) / len(v) - mean) * 2000)), 12), k) for k, v in parts.items())
    want = {k: round(min(1.0, *(p * 3 / (j + 1) for j, (p, _) in list(enumerate(ps))[i:])), 6) for i, (_, k) in enumerate(ps)}
    got = {r[0]: r[1] for r in QUERIES["bh_qvalues"](spark, str(tmp_path)).collect()}
    assert got == want


def test_steady_mean_of_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    data = [("a", 1e300), ("a", 0.5), ("b", None), ("b", 0.1), ("b", 0.2), ("c", None), ("d", inf), ("d", 1.0), ("e", nan), ("e", -0.25), ("f", -0.3)]
    got = dict(spark.createDataFrame(data, "k string, x double").groupBy("k").agg(aggregates.steady_mean("x")).collect())
    assert (got["a"], got["c"], got["d"], got["f"]) == (5e299, None, inf, -0.3)
    assert np.isclose(got["b"], 0.15) and np.isnan(got["e"])
