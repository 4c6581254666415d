"""Steps whose cost must not grow faster than their input, and the results that they must keep."""

from __future__ import annotations

import numpy as np

from pyspark.sql import functions as F

from driftloom.operators.neighbours import nearest, nearest_lists
from driftloom.plans.relational import exact_quantiles


def _brute(x, ids, labels, k, other):
    out = {}
    for i in range(len(x)):
        sim = [float(np.einsum("i,i->", x[i], y)) for y in x]
        order = sorted((j for j in range(len(x)) if not (other and ids[j] == ids[i])), key=lambda j: (-round(sim[j], 12), labels[j], ids[j]))
        out[int(ids[i])] = [int(ids[j]) for j in order[:k]]
    return out


def test_lists_of_copies_and_zero_vectors_over_many_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((240, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[50:110] = x[50]  # one common vector
    x[200:205] = 0.0
    ids, labels = rng.permutation(240), rng.integers(0, 3, 240)
    df = spark.createDataFrame([("k", "t", int(i), int(c), v.tolist()) for i, c, v in zip(ids, labels, x, strict=True)], "key string, tag string, vec_id long, label int, u array<double>")
    for other in (False, True):
        got = {}
        for r in nearest(df, df, ["key"], 5, other_than_self=other, block=40).collect():
            got.setdefault(r["vec_id"], {})[r["rank"]] = r["near_id"]
        assert {i: [n[k] for k in sorted(n)] for i, n in got.items()} == _brute(x, ids, labels, 5, other)


def test_only_finished_lists_leave_the_neighbour_search(spark):
    """Lists of single blocks, k rows for each query and bank block, were sorted by query after the search."""
    df = spark.createDataFrame([("k", "t", i, 0, [1.0, float(i)]) for i in range(20)], "key string, tag string, vec_id long, label int, u array<double>")
    plan = nearest(df, df, ["key"], 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Window" not in plan.split("MapInArrow")[0]


def test_a_group_of_queries_is_one_task(spark):
    """Groups were dealt to partitions by hash, so one task had several while others had none."""
    df = spark.createDataFrame([(f"k{i % 5}", "t", i, 0, [1.0, float(i)]) for i in range(200)], "key string, tag string, vec_id long, label int, u array<double>")
    lists = nearest_lists(df, df, ["key"], 3, block=10).withColumn("place", F.spark_partition_id())
    assert lists.count() == 200 and lists.rdd.getNumPartitions() == 10
    assert lists.select("place").distinct().count() == 10 and lists.groupBy("place").agg(F.countDistinct("key").alias("n")).filter("n > 1").count() == 0


def test_lists_over_runs_of_bank_rows(spark):
    """Banks of several products, whose last run is not full, with unknown vectors and ids on both sides."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[7] = np.nan
    labels = rng.integers(0, 3, 1500)
    df = spark.createDataFrame([("k", "t", i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(labels, x, strict=True))], "key string, tag string, vec_id long, label int, u array<double>")
    sim = x @ x.T
    sim[np.isnan(sim)] = -np.inf
    for other in (False, True):
        if other:
            np.fill_diagonal(sim, -np.inf)
        got = {r["vec_id"]: [n["near_id"] for n in r["near"]] for r in nearest_lists(df.filter("vec_id < 90"), df, ["key"], 10, other_than_self=other, block=4000).collect()}
        assert got == {i: np.argsort(-sim[i])[:10].tolist() for i in range(90) if i != 7}


def test_records_and_shifts_are_no_single_task(spark, sf, monkeypatch):
    """The bank was moved to as many tasks as it has keys to meet their means, and the records' work to one."""
    from driftloom.plans import base

    monkeypatch.setattr(base, "once", lambda spark, d, name, make: make())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shifted = base.shifted_bank(spark, sf)._jdf.queryExecution().executedPlan().toString()
        records = base.records(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in shifted and "SortMergeJoin" not in shifted and "ShuffledHashJoin" not in shifted
    assert "Coalesce 1" not in records


def test_quantiles_hold_no_group_in_one_aggregate(spark):
    import __spark_entry__

    plan = __spark_entry__.queries()["e12_quantiles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "percentile(" not in plan

    values = {"a": [float(x) for x in np.random.default_rng(2).normal(0, 50, 401)], "b": [3.0] * 50 + [1e-9, -1e12], "c": [7.5], None: [1.0, 2.0], "d": [float("nan"), 1.0, 2.0], "e": [float("inf"), float("-inf"), 0.0]}
    rows = spark.createDataFrame([(k, x) for k, some in values.items() for x in some] + [("a", None), ("f", None)], "k string, x double")
    points = {"lo": 0.025, "mid": 0.5, "hi": 0.975}
    got = {r["k"]: (r["lo"], r["mid"], r["hi"]) for r in exact_quantiles(rows, "k", "x", points).collect()}
    want = {r["k"]: (r["lo"], r["mid"], r["hi"]) for r in rows.groupBy("k").agg(*[F.percentile("x", F.lit(q)).alias(n) for n, q in points.items()]).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(np.array(got[k], float), np.array(want[k], float), rtol=1e-12, equal_nan=True), (k, got[k], want[k])


def test_conditions_share_one_row_of_queries(spark):
    """Every condition's vectors were packed, sorted and sent, eight rows for each vector; now one, whose lists are those of each condition searched alone."""
    from driftloom.operators.neighbours import unit_rows
    from driftloom.plans import base

    rng = np.random.default_rng(9)
    for middle in (0.0, 0.3, 3.0):
        x = rng.standard_normal((700, 16)) * 0.125 + middle * np.eye(16)[2]
        x[60:110] = x[60]  # copies
        x[200] = 0.0
        x[201, :4], x[201, 4:] = -0.05, 0.0  # nothing is left of it under one condition
        x[202, 3] = np.nan
        m, labels = np.nanmean(x, axis=0), rng.integers(0, 4, 700)
        raw = spark.createDataFrame([("k", "", i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(labels, x, strict=True))], "key string, tag string, vec_id long, label int, u array<double>")
        u = unit_rows(x)[0]
        bank = spark.createDataFrame([("k", "", i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(labels, u, strict=True)) if i != 202], "key string, tag string, vec_id long, label int, u array<double>")
        means = spark.createDataFrame([("k", m.tolist())], "key string, m array<double>")
        got = {(r["tag"], r["vec_id"]): r for r in nearest_lists(raw, bank, ["key"], 10, block=700, shifts=base.shifts, conditions=8, about=means, votes=(1, 5)).collect()}
        known = [i for i in range(700) if i != 202]
        for s in base.shifts(x, m):
            y = unit_rows(s.y)[0]
            for i in range(0, 700, 7) if s.tag != "add_0_05" else (200, 201, 202, 65):
                if i == 202:
                    assert (s.tag, i) not in got
                    continue
                sim = np.array([float(np.einsum("i,i->", y[i], u[j])) for j in known])
                want = sorted(range(len(known)), key=lambda j: (-sim[j], labels[known[j]], known[j]))[:10]
                near = got[s.tag, i]["near"]
                assert np.allclose([n["sim"] for n in near], sim[want], atol=1e-12), (middle, s.tag, i)
                if np.diff(np.sort(sim)[-11:]).min() > 1e-9 or not y[i].any():
                    assert [n["near_id"] for n in near] == [known[j] for j in want]
                five = [n["near_label"] for n in near[:5]]
                assert got[s.tag, i]["vote_5"] == min(set(five), key=lambda c: (-five.count(c), c)) and got[s.tag, i]["vote_1"] == five[0]


def test_sums_of_conditions_are_those_of_pairs(spark, sf):
    """Records read the pairs of every vector and condition, made row by row in the JVM; sums over batches take their place."""
    from driftloom.plans import base

    key = ["dataset", "backbone", "tag"]
    got = base.condition_sums(spark, sf).groupBy(*key).agg(F.sum("n").alias("n"), F.sum("far").alias("far"), *[F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in "uc" for i in range(16)])
    want = base.paired(spark, sf).groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("cos")).alias("far"), *[F.sum(F.col(c)[i]).alias(f"{c}{i}") for c in "uc" for i in range(16)])
    got, want = ({tuple(r[:3]): r[3:] for r in df.collect()} for df in (got, want))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-12) for k in want)


def test_clean_lists_are_searched_alone(spark, sf, monkeypatch):
    """k3 and k4 read clean vectors only, yet made the lists of all eight conditions."""
    import __spark_entry__
    from driftloom.sources import store

    monkeypatch.setattr(store, "_kept", {})
    alone = {q: sorted(map(tuple, __spark_entry__.queries()[q](spark, sf).collect())) for q in ("k3_in_sample_accuracy", "k4_leave_self_out_recall")}
    assert not [name for _, _, name in store._kept if name == "neighbours"]
    __spark_entry__.queries()["k1_knn_accuracy"](spark, sf).collect()
    assert alone == {q: sorted(map(tuple, __spark_entry__.queries()[q](spark, sf).collect())) for q in alone}


def test_the_grid_searches_no_vectors_that_it_does_not_draw(spark, sf, monkeypatch):
    """All lists of all conditions were made, and all vectors sorted by hash, for at most 64 rows of a condition and repeat."""
    import __spark_entry__
    from driftloom.plans import shift
    from driftloom.sources import store

    asked = []
    real = shift.nearest_lists
    monkeypatch.setattr(store, "_kept", {})
    monkeypatch.setattr(shift, "nearest_lists", lambda q, *a, **kw: asked.append(q) or real(q, *a, **kw))
    assert __spark_entry__.queries()["l10_grid_cells"](spark, sf).count() > 0
    assert not [name for _, _, name in store._kept if name == "neighbours"]
    most = asked[0].groupBy("dataset", "backbone", "tag").count().agg(F.max("count")).first()[0]
    assert len(asked) == 1 and most <= 64 * 5 and asked[0].filter("tag = 'clean_0'").count() == 0


def _record_rows(df):
    return {tuple(r[c] for c in ("dataset", "backbone", "tag", "perturbation", "severity")): tuple(r[c] for c in ("n", "drift", "accuracy", "acc_clean", "acc_drop", "knn1", "knn5", "centroid", "failure")) for r in df.collect()}


def test_records_read_sums_and_no_lists(spark, sf, monkeypatch):
    """Records had all lists of all conditions written and read again, ten rows of a struct for each vector and condition, for three averages."""
    import __spark_entry__
    from driftloom.plans import base
    from driftloom.sources import store

    monkeypatch.setattr(store, "_kept", {})
    assert __spark_entry__.queries()["e14_weighted_mean"](spark, sf).count() == 7
    assert not [name for _, _, name in store._kept if name == "neighbours"]
    alone = _record_rows(base.records(spark, sf))
    monkeypatch.setattr(store, "_kept", {})
    base.neighbour_arrays(spark, sf)
    after = _record_rows(base.records(spark, sf))
    assert len(alone) == 84 and alone.keys() == after.keys()
    assert all(np.allclose(alone[k], after[k], rtol=0, atol=2e-9) for k in alone)


def test_own_vectors_are_packed_once(spark):
    """Queries and bank were packed, counted and sorted each for itself, though they are the same rows; blocks that are searched together give the same lists and sums."""
    from driftloom.operators.neighbours import nearest_sums, unit_rows
    from driftloom.plans import base

    rng = np.random.default_rng(12)
    x = rng.standard_normal((900, 16)) * 0.125
    x[60:110] = x[60]  # copies
    x[200] = 0.0
    x[202, 3] = np.nan
    m, labels = np.nanmean(x, axis=0), rng.integers(0, 4, 900)
    rows = lambda v: spark.createDataFrame([("k", "", i, int(c), w.tolist()) for i, (c, w) in enumerate(zip(labels, v, strict=True))], "key string, tag string, vec_id long, label int, u array<double>")
    raw, bank = rows(x), rows(unit_rows(x)[0])
    about = spark.createDataFrame([("k", 900, m.tolist())], "key string, n long, m array<double>")
    same = {"shifts": base.shifts, "conditions": 8, "about": about}
    read = lambda df: {(r["tag"], r["vec_id"]): ([n["near_id"] for n in r["near"]], [n["sim"] for n in r["near"]]) for r in df.collect()}
    want = read(nearest_lists(raw, bank, ["key"], 5, **same))
    own = nearest_lists(raw, None, ["key"], 5, block=250, **same)
    got = read(own)
    assert own.rdd.getNumPartitions() > 10 and got.keys() == want.keys() and len(got) == 8 * 899
    for k in want:
        assert np.allclose(got[k][1], want[k][1], rtol=0, atol=1e-12)
        if np.diff(want[k][1]).max() < -1e-9:
            assert got[k][0] == want[k][0]
    sums = {}
    for r in nearest_sums(raw, ["key"], 5, base.shifts, 8, about, block=250).collect():
        sums.setdefault(r["tag"], []).append((r["n"], r["found"], r["hits"], r["first"], r["listed"], r["whole"]))
    for tag, some in sums.items():
        lists = {i: near for (t, i), near in want.items() if t == tag}
        n, found, hits, first, listed, whole = np.sum(some, axis=0)
        assert (n, found, listed) == (900, 899, 5 * 899) and hits == sum(labels[near[0]] == labels[i] for i, (near, _) in lists.items())
        assert np.allclose((first, whole), (sum(1 - s[0] for _, s in lists.values()), sum(5 - sum(s) for _, s in lists.values())), rtol=0, atol=1e-9)


def test_moves_up_to_twice_the_length_share_products():
    """A condition that adds 0.3 to four of sixteen numbers had products of its own."""
    from types import SimpleNamespace

    from driftloom.operators.neighbours import Group
    from driftloom.plans import base

    x = np.random.default_rng(3).standard_normal((300, 16)) * 0.125
    made = Group(SimpleNamespace(x=x, ids=np.arange(300), labels=np.zeros(300, np.int32)), 5, False, base.shifts, x.mean(0))
    assert len(made.lists) == 8 and sorted(map(len, made.shared)) == [1, 1, 1, 5]
