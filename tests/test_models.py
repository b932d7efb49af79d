"""Side-by-side logistic fits against separate fits, and the protocols built on them."""
import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from fraudloom.operators import models as D
from fraudloom.operators import newton as W
from fraudloom.operators import sampling as S

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    g = np.random.default_rng(1)
    x = g.normal(size=(900, 3)) * [1.0, 40.0, 0.01] + [0.0, 500.0, 3.0]
    eta = 1.2 * x[:, 0] + 0.03 * (x[:, 1] - 500) - 1.0
    y = (g.random(900) < 1 / (1 + np.exp(-eta))).astype(int)
    data = [(i, int(y[i]), i % 5, i % 7 if y[i] else None, *map(float, x[i])) for i in range(900)]
    return spark.createDataFrame(data, "id bigint, y int, fold int, grp int, a double, b double, c double").cache()


def separate(train, balanced=True, penalty=1.0):
    """The same fit by spark.ml, run to convergence."""
    n, pos = train.count(), train.filter("y = 1").count()
    w = F.when(F.col("y") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos))) if balanced else F.lit(1.0)
    lr = LogisticRegression(featuresCol="z", labelCol="y", weightCol="w", regParam=penalty / n, standardization=False, maxIter=500, tol=1e-14)
    stages = [VectorAssembler(inputCols=FEATURES, outputCol="v"), StandardScaler(inputCol="v", outputCol="z", withMean=True), lr]
    m = Pipeline(stages=stages).fit(train.withColumn("w", w))
    scaler, fit = m.stages[1], m.stages[2]
    raw = np.array(fit.coefficients) / np.array(scaler.std)
    return raw, fit.intercept - (raw * np.array(scaler.mean)).sum()


def test_side_by_side_equals_separate_fits(rows):
    fits = [*D.fold_fits(5), W.Fit("no3", (("grp", 3),)), W.Fit("only2", only=(("fold", 2),)), W.Fit("stiff", penalty=50.0)]
    models = W.fit_many(rows, FEATURES, fits)
    for fit, some, penalty in [("all", rows, 1.0), *[(str(i), rows.filter(f"fold <> {i}"), 1.0) for i in range(5)], ("no3", rows.filter("grp IS NULL OR grp <> 3"), 1.0), ("only2", rows.filter("fold = 2"), 1.0), ("stiff", rows, 50.0)]:
        m = models[fit]
        raw, intercept = separate(some, penalty=penalty)
        std = np.array([some.agg(F.stddev(c)).first()[0] for c in FEATURES])
        assert m.rows == some.count() and m.gradient < 1e-8
        assert np.array(m.coefficients) * std == pytest.approx(raw * std, abs=1e-6) and m.intercept + (np.array(m.coefficients) * 0).sum() == pytest.approx(intercept, abs=1e-4 * max(1, abs(intercept)))


def test_jobs_follow_iterations_not_fits(spark, rows):
    sc = spark.sparkContext
    count = lambda tag: len(sc.statusTracker().getJobIdsForGroup(tag))
    sc.setJobGroup("few", "few")
    W.fit_many(rows, FEATURES, D.fold_fits(5)[:1])
    sc.setJobGroup("many", "many")
    W.fit_many(rows, FEATURES, [W.Fit(f"{i}", (("id", i),)) for i in range(60)])
    few, many = count("few"), count("many")
    sc.setJobGroup("rest", "rest")
    assert 0 < many <= few + 6


def test_muted_features_and_single_class(rows):
    m = W.fit_many(rows, FEATURES, [W.Fit("muted", muted=("b",)), W.Fit("one", only=(("grp", 2),))])
    assert m["muted"].coefficients[1] == 0.0 and m["muted"].coefficients[0] > 0.5
    assert m["one"].coefficients == [0.0, 0.0, 0.0] and m["one"].intercept > 5
    two, _ = separate(rows.withColumn("b", F.lit(0.0) + F.col("id") * 0))
    assert m["muted"].coefficients[0] == pytest.approx(two[0], abs=1e-6)


def test_separable_rows_stay_finite(spark):
    df = spark.createDataFrame([(float(i), int(i >= 20)) for i in range(40)], "a double, y int")
    m = W.fit_many(df, ["a"], [W.Fit("all"), W.Fit("loose", penalty=1e-6)])
    assert all(np.isfinite(v.coefficients[0]) and v.coefficients[0] > 0 for v in m.values())
    with pytest.raises(Exception, match="null or NaN"):
        W.fit_many(df.withColumn("a", F.lit(None).cast("double")), ["a"], [W.Fit("all")])


def test_out_of_fold_calibrated_by_hand(rows):
    got = {r.id: r.p for r in D.out_of_fold(rows, FEATURES, 5).collect()}
    raw, b = separate(rows.filter("fold <> 3"))
    for r in rows.filter("fold = 3").limit(20).collect():
        assert got[r.id] == pytest.approx(1 / (1 + np.exp(-(raw @ [r.a, r.b, r.c] + b))), abs=1e-5)
    cal = D.out_of_fold(rows, FEATURES, 5, calibrate=True)
    assert set(cal.columns) == {*rows.columns, "p"} and cal.count() == 900
    assert abs(cal.agg(F.avg("p") - F.avg("y")).first()[0]) < 0.02


def test_fusion_model_round_trip(spark, rows, tmp_path):
    model = D.train_fusion(rows, FEATURES)
    model.save(spark, str(tmp_path / "m"))
    again = D.FusionModel.load(spark, str(tmp_path / "m"))
    assert again.coefficients() == model.coefficients()
    assert {r.id: r.fused for r in again.score(rows).collect()} == {r.id: r.fused for r in model.score(rows).collect()}
    with pytest.raises(ValueError):
        model.score(rows.drop("b"))


def test_protocols(spark):
    g = np.random.default_rng(3)
    data = []
    for i in range(400):
        bot, s = i % 4 == 0, i // 4 % 3
        v = g.normal(size=2) + ([3.0 + s, 0.0] if bot else [0.0, 1.5 * (i % 2)])
        data.append((f"p{i}", int(bot), f"s{s}" if bot else None, None if bot else i % 2, float(v[0]), float(v[1])))
    df = spark.createDataFrame(data, "subject string, y int, strategy string, population int, a double, b double")
    out = {(r.protocol, r.held_out): r for r in D.keystroke_protocols(df, ["a", "b"], 0.05).collect()}
    assert set(out) == {("held_out", None), ("transfer", None), *[("leave_one_strategy_out", f"s{s}") for s in range(3)]}
    assert all(r.auc > 0.9 for (p, _), r in out.items() if p != "transfer") and out[("transfer", None)].n_people == sum(1 for d in data if d[3] == 1)
    assert all(r.false_positive_rate <= 0.05 + 1 / r.n_people for (p, _), r in out.items() if p != "transfer")
    with pytest.raises(ValueError):
        S.leave_one_group_out(df, "subject", most=100)


def test_identity_join_cases(spark):
    scores = spark.createDataFrame([(i, i % 2, "train" if i < 40 else "test") for i in range(50)], "id int, y int, split string")
    full = spark.createDataFrame([(i, i // 4, "scan") for i in range(50)] + [(3, 999, "zz"), (None, 1, "q")], "id int, identity int, capture string")
    j = S.score_identity_join(scores, full)
    assert j.count() == 50 and {r.fold_kind for r in j.collect()} == {"identity"} and j.filter("fold IS NULL").count() == 10
    assert j.filter("fold IS NOT NULL").groupBy("identity").agg(F.countDistinct("fold").alias("k")).filter("k > 1").count() == 0
    for part in (full.filter("id <> 7"), full.withColumn("identity", F.lit(1)), full.filter("false")):  # a gap, too few identities, no manifest
        assert {r.fold_kind for r in S.score_identity_join(scores, part).collect()} == {"row"}
