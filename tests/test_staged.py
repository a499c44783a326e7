"""Boosted trees round by round against plain loops."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from egresslens.operators import models
from egresslens.plans import training

ROUNDS = 4


def plain_auc(scores, labels):
    """Share of pairs of a positive and a negative that stand in the right order, ties by half."""
    pos, neg = ([s for s, y in zip(scores, labels) if y == k] for k in (1, 0))
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def trained(spark):
    draw = random.Random(3)
    rows = []
    for i in range(600):
        a, b = draw.random(), draw.random()
        rows.append((i, a, b, int(a + draw.gauss(0, 0.3) > b), 1.0, i % 4 == 0))
    df = spark.createDataFrame(rows, "frame_no long, a double, b double, class int, weight double, is_val boolean").cache()
    return df, models.second_stage(["a", "b"], rounds=ROUNDS, tolerance=-1).fit(df.filter("not is_val"))


def test_margins_and_areas_of_every_round(trained):
    df, model = trained
    boosted = model.stages[-1]
    assert len(boosted.trees) == ROUNDS
    rows = models.staged_margins(model, df.filter("is_val")).select("features", "class", "margins").collect()
    sums = []
    for row in rows:
        upto, total = [], 0.0
        for tree, weight in zip(boosted.trees, boosted.treeWeights):
            total += weight * tree.predict(row["features"])
            upto.append(total)
        assert row["margins"] == pytest.approx(upto)
        sums.append(row["margins"])
    curve = models.staged_auc(models.staged_margins(model, df.filter("is_val")))
    got = {r["round"]: r["auc"] for r in curve.collect()}
    labels = [r["class"] for r in rows]
    want = {k + 1: plain_auc([m[k] for m in sums], labels) for k in range(len(boosted.trees))}
    assert got == pytest.approx(want)
    assert models.best_round(curve) == min(k for k, v in got.items() if v == max(got.values()))
    one_class = models.staged_auc(models.staged_margins(model, df.filter("class = 1")))
    assert all(r["auc"] is None for r in one_class.collect()) and models.best_round(one_class) is None


def test_a_cut_model_scores_with_its_first_trees(trained):
    df, model = trained
    all_trees = len(model.stages[-1].trees)
    key = lambda rows: {r["frame_no"]: r["p"] for r in rows.collect()}
    whole, cut = (key(models.score(model, df, ["frame_no"], "p", rounds)) for rounds in (None, all_trees))
    assert whole == pytest.approx(cut)
    first = key(models.score(model, df, ["frame_no"], "p", 1))
    assert len(set(first.values())) <= len(set(whole.values())) and first != pytest.approx(whole)


def test_learning_curve(trained):
    df, model = trained
    curve = models.learning_curve(model, df.filter("is_val"), df.filter("not is_val")).orderBy("round").collect()
    assert [r["round"] for r in curve] == list(range(1, len(model.stages[-1].trees) + 1))
    assert all(0 < r["auc"] <= 1 and r["loss"] > 0 and r["train_loss"] > 0 for r in curve)
    assert curve[-1]["train_loss"] < curve[0]["train_loss"]


def test_trees_are_asked_once_and_only_those_that_count(trained):
    df, model = trained
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan(models.score(model, df, ["frame_no"], "p", 2)).count("UDF(features") == 2
    assert "UDF(features" not in plan(models.staged_auc(models.staged_margins(model, df)))
    stage = training.Stage(model, None, df, df, df, threshold=0.5, rounds=2)
    assert all("UDF(features" not in plan(rows) for rows in stage.evaluate().values())


def test_margins_are_sums_in_the_order_of_the_trees(trained):
    df, model = trained
    rows = models.staged_margins(model, df).select("features", "margins").collect()
    boosted = model.stages[-1]
    for row in rows[:50]:
        values = [tree.predict(row["features"]) * weight for tree, weight in zip(boosted.trees, boosted.treeWeights)]
        assert row["margins"] == list(itertools.accumulate(values))
    assert models.staged_margins(model, df.limit(0)).collect() == []


def test_margins_are_added_by_batch(trained):
    """No list grows round by round, which would copy it as often as there are trees."""
    df, model = trained
    plan = models.staged_margins(model, df)._jdf.queryExecution().analyzed().toString()
    assert "concat(" not in plan and plan.count("_running_sums(") == 1
