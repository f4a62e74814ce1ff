"""Properties of fitted forests on made data."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from woodlot.operators import quantiles, sampling, splits
from woodlot.plans import model as M
from woodlot.plans.config import Options
from woodlot.sources import encode as E
from woodlot.streaming import score_nodes_stream


@pytest.fixture(scope="module")
def steps(spark):
    rng = random.Random(3)
    rows = []
    for i in range(400):
        x = [rng.uniform(0, 10) for _ in range(3)]
        f = rng.choice("abc")
        rows.append((i, x[0] if i % 17 else None, x[1], x[2], f, 3.0 * (x[0] > 5) + 2.0 * (x[1] > 3) + 4.0 * (f == "a")))
    return spark.createDataFrame(rows, "id long, x1 double, x2 double, x3 double, f string, y double").cache()


@pytest.fixture(scope="module")
def forest(steps):
    return M.fit(steps, "y", "id", n_tree=6, n_level=5, pred_fixed=4, seed=5)


def test_distinct_rows_of_a_bag(spark):
    rows = spark.range(1000).withColumnRenamed("id", "row_id")
    for repl in (True, False):
        n = sampling.bag(rows, 100, with_repl=repl, seed=3).count()
        assert abs(n - 63000) < 3150


def test_out_of_bag_fit_and_predictors(forest, steps):
    r = forest.validate(steps, "y", "id")["regression"].first()
    assert r.rsq >= 0.6 and r.n == 400
    info = {x.pred_id: x.info for x in forest.predictor_info().collect()}
    assert info[3] > info[2] and info[0] > info[2]


def test_training_rows_reach_their_leaves(forest, steps):
    walked = forest.indices(steps, "id")
    lost = forest.members.join(walked, ["tree_id", "row_id", "node_id"], "left_anti")
    assert lost.count() == 0


def test_block_walk_is_the_joined_walk(forest, steps):
    a, b = forest.indices(steps, "id"), forest.indices(steps, "id", blocks=True)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_weights_sum_to_one_and_quantiles_increase(forest, steps):
    some = steps.limit(7)
    assert all(abs(r.w - 1) < 1e-9 for r in forest.weights(some, "id").groupBy("row_id").agg(F.sum("weight").alias("w")).collect())
    by = {}
    for r in forest.quantiles(some, [0.1, 0.5, 1.0], "id").collect():
        by.setdefault(r.row_id, []).append((r.q, r.q_pred))
    assert len(by) == 7 and all([v for _, v in sorted(x)] == sorted(v for _, v in x) for x in by.values())
    assert all(0 <= r.q_est <= 1 for r in forest.quantile_estimates(some, "id").collect())


def test_trap_stops_at_missing_and_unseen(spark, forest):
    odd = spark.createDataFrame([(1, None, None, None, "zz")], "id long, x1 double, x2 double, x3 double, f string")
    assert {r.node_id for r in forest.indices(odd, "id", trap=True).collect()} == {1}
    assert forest.predict(odd, "id").first().y_pred is not None
    assert abs(forest.weights(odd, "id", trap=True).agg(F.sum("weight")).first()[0] - 1) < 1e-9


def test_store_and_load(spark, forest, steps, tmp_path):
    forest.save(str(tmp_path))
    again = M.Forest.load(spark, str(tmp_path))
    assert forest.predict(steps, "id").exceptAll(again.predict(steps, "id")).count() == 0
    thin = forest.streamlined()
    with pytest.raises(ValueError):
        thin.weights(steps, "id")


def test_classes_pruned_and_importance(steps):
    named = steps.withColumn("y", F.when(F.col("y") > 4, "high").when(F.col("y") > 2, "middle").otherwise("low"))
    m = M.fit(named, "y", "id", n_tree=4, n_level=4, pred_fixed=4, max_leaf=5, class_weight="balance", imp_permute=1, seed=2)
    assert all(r["count"] <= 5 for r in m.nodes.where("left_id IS NULL").groupBy("tree_id").count().collect())
    out = m.validate(named, "y", "id")
    assert out["error"].first().error < 0.4 and out["confusion"].agg(F.sum("n")).first()[0] == 400
    worse = {r.pred_id: r.error for r in out["importance"].collect()}
    assert worse[3] > worse[2]
    prob = m.prob(named, "id").groupBy("row_id").agg(F.sum("prob").alias("p"))
    assert prob.where("abs(p - 1) > 1e-9").count() == 0


def test_boosting_lowers_the_error(steps):
    m = M.fit(steps, "y", "id", boost=True, n_tree=3, n_level=3, nu=0.5, seed=1)
    before = steps.agg(F.var_pop("y")).first()[0]
    assert m.test(steps, "y", "id")["regression"].first().mse < 0.6 * before


def test_monotone_splits_are_ordered(spark):
    rows = [(0, 1, 0, float(i), 1, float(-i), None) for i in range(20)]
    staged = spark.createDataFrame(rows, "tree_id int, node_id long, pred_id int, x double, s_count long, y double, ctg int")
    hist = splits.histogram(staged)
    assert splits.numeric_splits(hist, mono={0: 1.0}).count() == 0
    assert splits.numeric_splits(hist, mono={0: -1.0}).count() == 1


def test_constant_missing_and_tied_columns(spark):
    df = spark.createDataFrame([(i, 1.0, None, float(i // 4 % 2), float(i % 2)) for i in range(16)], "id long, c double, m double, t double, y double")
    m = M.fit(df, "y", "id", n_tree=2, n_level=3, pred_fixed=3)
    assert m.nodes.where("pred_id IN (0, 1)").count() == 0
    assert m.predict(df, "id").count() == 16


def test_missing_labels_are_left_out(spark):
    df = spark.createDataFrame([(i, float(i), float(i) if i % 3 else None) for i in range(30)], "id long, x double, y double")
    m = M.fit(df, "y", "id", n_tree=2, n_level=3)
    assert m.bag.join(df.where("y IS NULL"), m.bag.row_id == F.col("id")).count() == 0


def test_option_errors(spark):
    for bad in ({"pred_fixed": 1, "pred_prob": 0.5}, {"n_level": 63}, {"reg_mono": {0: 2.0}}, {"split_quant": 1.5}, {"ctg_census": "probSample"}, {"pred_weight": [0.0, 0.0]}, {"n_tree": 0}):
        with pytest.raises(ValueError):
            Options(**bad).checked(2, True)
    assert Options(quantiles=True).checked(2, False).quant_vec == [0.25, 0.5, 0.75, 1.0]
    assert sampling.sample_count(1000, 0, False) == round((1 - math.exp(-1)) * 1000)
    with pytest.raises(TypeError):
        E.signature(spark.sql("SELECT date'2020-01-01' AS d"))
    sig = E.signature(spark.sql("SELECT 1.0D AS a, 'x' AS b"))
    with pytest.raises(ValueError):
        E.check(spark.sql("SELECT 1.0D AS a"), sig)
    with pytest.raises(TypeError):
        E.check(spark.sql("SELECT 'q' AS a, 'x' AS b"), sig)
    assert E.Signature.of_json(sig.json()) == sig


def test_nan_is_missing(spark):
    df = spark.sql("SELECT 1L AS id, double('NaN') AS a UNION ALL SELECT 2L, 5D")
    x = {r.row_id: r.x for r in E.encode(df, E.signature(df, ["a"]), "id").collect()}
    assert x == {1: [None], 2: [5.0]}


def test_sparse_is_dense(spark):
    dense = [(0, [0.0, 2.0]), (1, [0.0, 0.0]), (2, [3.0, 0.0])]
    entries = spark.createDataFrame([(0, 1, 2.0), (2, 0, 3.0)], "row_id long, pred_id int, x double")
    rows = spark.range(3).withColumnRenamed("id", "row_id")
    assert sorted((r.row_id, r.x) for r in E.sparse(entries, rows, 2).collect()) == dense


def test_stream_of_rows_is_walked(spark, forest, steps, tmp_path):
    steps.drop("y").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(steps.drop("y").schema).parquet(str(tmp_path / "in"))
    q = score_nodes_stream(forest, stream, "id").writeStream.format("memory").queryName("walked").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("walked").exceptAll(forest.indices(steps, "id")).count() == 0 and spark.table("walked").count() == 400 * 6


def test_weights_are_not_shuffled_pair_by_pair(spark, monkeypatch):
    """Rows of the same leaves are blocks, which unfold to every pair after the last exchange."""
    monkeypatch.setattr(quantiles, "BLOCK", 7)
    walked = spark.range(200).selectExpr("id AS row_id", "explode(array(0, 1)) AS tree_id").selectExpr("row_id", "tree_id", "IF(tree_id = 0, row_id % 3, row_id % 2) + 2 AS node_id")
    members = walked.selectExpr("*", "1 + row_id % 2 AS s_count").where("tree_id = 0 OR row_id % 10 > 0")
    out = quantiles.forest_weights(walked, members)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(member_ids") < plan.index("Exchange") and plan.index("explode(row_ids") < plan.index("Exchange")
    leaf = {}
    for r in members.collect():
        leaf.setdefault((r.tree_id, r.node_id), []).append((r.row_id, r.s_count))
    want = {}
    for r in walked.collect():
        own = leaf[r.tree_id, r.node_id]
        for m, n in own:
            want[r.row_id, m] = want.get((r.row_id, m), 0.0) + n / sum(k for _, k in own) / 2
    got = out.collect()
    assert len(got) == len(want) and all(abs(want[r.row_id, r.member_id] - r.weight) < 1e-12 for r in got)


@pytest.mark.parametrize("n_ctg", [0, 2])
def test_large_cells_are_scanned_in_ranges(spark, n_ctg):
    """Ranges give the cuts of the whole scan, ties and cells on one range's border included."""
    rng = random.Random(5)
    rows = [(t, 1, p, float(rng.randrange(60 if p else 3)), 1, float(rng.randrange(4)), rng.randrange(2)) for t in range(2) for p in range(2) for _ in range(300)]
    rows += [(2, 1, 0, float(i % 4), 1, float(i % 4 % 2), i % 2) for i in range(8)]
    hist = splits.histogram(spark.createDataFrame(rows, "tree_id int, node_id long, pred_id int, x double, s_count long, y double, ctg int"), n_ctg).cache()
    whole, ranges = (splits.numeric_splits(hist, n_ctg, ranges=r) for r in (False, True))
    order = lambda df: sorted(tuple(r) for r in df.select(*splits.CELL, "gain", "x_left", "x_right", "ln", "tn").collect())
    assert len(order(whole)) == 5 and order(ranges) == order(whole)
    # no window orders a cell whole
    assert "windowspecdefinition(tree_id" not in re.sub(r"#\d+L?", "", ranges._jdf.queryExecution().optimizedPlan().toString()).replace("windowspecdefinition(tree_id, node_id, pred_id, part, x", "")


def test_levels_do_not_join_the_frame(spark, steps):
    """Rows with their predictors grow the same tree without the frame."""
    prep = M.prepare(steps, "y", "id")
    root = prep.frame.select(F.lit(0).alias("tree_id"), "row_id", F.lit(1).cast("long").alias("s_count"), "y", F.lit(None).cast("int").alias("ctg"), "x")
    how = Options(n_level=3, seed=1).checked(prep.sig.p, False)
    nodes, members = M.grow(prep.frame.limit(0), root, prep.sig, M.Target(), how, prep.values, [], prep.sig.p)
    want, _ = M.grow(prep.frame, root.drop("x"), prep.sig, M.Target(), how, prep.values, [], prep.sig.p)
    assert nodes.count() > 3 and nodes.exceptAll(want).count() == 0 and members.count() == 400


def test_boosting_on_all_rows_neither_hashes_nor_joins(spark):
    rows = spark.range(50).withColumnRenamed("id", "row_id")
    all_, some = (sampling.bag_without_replacement(rows, 2, 50, 3, 1, n) for n in (50, None))
    assert "md5" not in all_._jdf.queryExecution().executedPlan().toString()
    assert all_.exceptAll(some).count() == 0 and all_.count() == some.count() == 100
