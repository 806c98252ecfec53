import random

import pytest
from pyspark.sql import functions as F

from strideframe import schemas as S
from strideframe.operators import evaluation, history, splitting

CLASSES = ["FALL", "LAYING", "SITTING", "STANDING", "WALKING", "WALKING_DOWNSTAIRS", "WALKING_UPSTAIRS"]
# A published 7 x 7 confusion matrix and the metrics stated for it.
MATRIX = [
    [28, 0, 0, 0, 0, 0, 0], [0, 532, 0, 0, 0, 0, 5], [0, 0, 406, 84, 0, 0, 1], [0, 0, 40, 491, 0, 0, 1],
    [0, 0, 1, 1, 478, 16, 0], [0, 0, 0, 0, 11, 394, 15], [0, 0, 0, 0, 38, 22, 411],
]
# Model, accuracy, macro F1, fall recall, composite score.
PUBLISHED = [
    ("Logistic Regression", 0.9210084033613445, 0.9308509971615558, 1.0, 0.9634569798207356),
    ("Decision Tree", 0.8678991596638655, 0.8825134540456808, 1.0, 0.9383338681464773),
    ("Random Forest", 0.9008403361344538, 0.9127297709970801, 1.0, 0.9539869985260148),
    ("Support Vector Machine", 0.9193277310924369, 0.9300148086946807, 1.0, 0.9628699888268916),
    ("Gradient Boosting", 0.9092436974789916, 0.9202207365126991, 1.0, 0.957914960449608),
]


def test_published_matrix(spark):
    cells = [(CLASSES[i], CLASSES[j], n) for i, row in enumerate(MATRIX) for j, n in enumerate(row) if n]
    counts = spark.createDataFrame(cells, "actual string, predicted string, n long")
    means = evaluation.averages(evaluation.class_report(counts)).first()
    assert means["accuracy"] == pytest.approx(0.9210084033613445)
    assert means["macro_precision"] == pytest.approx(0.9327082223274014)
    assert means["macro_recall"] == pytest.approx(0.9307030906760231)
    assert means["macro_f1"] == pytest.approx(0.9308509971615558)
    assert means["weighted_f1"] == pytest.approx(0.9207654764421637)
    fall = evaluation.target_metrics(counts).first()
    assert (fall["fall_recall"], fall["fall_precision"], fall["fall_fpr"], fall["fall_fnr"]) == (1, 1, 0, 0)
    assert evaluation.confusion_matrix(counts, CLASSES).count() == 49


def test_published_selection(spark):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(PUBLISHED)],
                               "Model string, a double, f double, r double, `Composite Score` double, model_ord int")
    score = evaluation.composite_score(F.col("r"), F.col("f"), F.col("a"))
    assert df.agg(F.max(F.abs(score - F.col("Composite Score")))).first()[0] < 1e-12
    assert evaluation.best_model(df).first()["Model"] == "Logistic Regression"
    tied = df.withColumn("Composite Score", F.lit(1.0))
    assert evaluation.best_model(tied).first()["model_ord"] == 0


def test_roc_auc_of_any_scores(spark):
    """Nearly all scores at one end, scores below 0 and above 1, ties and NULLs."""
    rng = random.Random(4)
    rows = [(rng.random() < 0.3, 0.999 + rng.randrange(900) / 1e6) for _ in range(3000)]
    rows += [(rng.random() < 0.5, rng.choice([-7.5, 0.0, -0.0, 1e9, 42.0])) for _ in range(60)] + [(True, None), (False, None)]
    df = spark.createDataFrame(rows, "p boolean, s double").repartition(5)
    good, bad = ([s for p, s in rows if p == side and s is not None] for side in (True, False))
    want = sum((a > b) + (a == b) / 2 for a in good for b in bad) / len(good) / len(bad)
    assert evaluation.roc_auc(df, F.col("p"), "s").first()[0] == pytest.approx(want, rel=1e-12)
    assert evaluation.roc_auc(df.where("false"), F.col("p"), "s").first()[0] == 1.0


def test_roc_auc_against_pairs(spark):
    draw = random.Random(1)
    rows = [(draw.random() < 0.3, round(draw.random(), 2)) for _ in range(400)] + [(True, 1.0), (False, 0.0)]
    pos, neg = [s for p, s in rows if p], [s for p, s in rows if not p]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    df = spark.createDataFrame(rows, "p boolean, s double")
    assert evaluation.roc_auc(df, F.col("p"), "s").first()[0] == pytest.approx(want)
    assert evaluation.roc_auc(df.where("p"), F.col("p"), "s").first()[0] == 1.0


def test_target_that_is_no_class(spark):
    df = spark.createDataFrame([("A", "A"), ("B", "A")], "actual string, predicted string")
    r = evaluation.evaluate(df, "FALL", None, ["A", "B"]).first()
    assert r["fall_recall"] == r["macro_recall"] and r["fall_roc_auc"] == 1.0 and r["fall_fpr"] == 0.0


def test_subject_split(spark):
    df = spark.range(200).select((F.col("id") % 10).alias("subject_id"), F.lit(0).alias("is_fall"))
    split = splitting.split_subjects(df)
    parts = {r["part"]: r["count"] for r in split.groupBy("part").count().collect()}
    assert parts == {"train": 7, "test": 3} and splitting.leaked_subjects(split).count() == 0
    assert splitting.members(df, split, "test").count() == 60


def test_scaler_constant_column(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    out = splitting.scaled(df, splitting.scaler(df, ["a", "b"]), ["a", "b"]).collect()
    assert [(r["a"], r["b"]) for r in out] == [(-1.0, 0.0), (1.0, 0.0)]


def test_summary_of_empty_tables(spark):
    def empty(schema):
        return spark.createDataFrame([], schema)

    devices = empty("connected boolean")
    r = history.summary(empty(S.PREDICTIONS), empty(S.FALL_EVENTS), empty(S.ALERTS), devices, F.current_timestamp()).first()
    assert (r["current_activity"], r["current_confidence"], r["current_risk"]) == ("WALKING", 0.94, "LOW")
    assert (r["system_status"], r["total_falls_count"], r["active_alerts"]) == ("READY", 0, [])


def test_page_bounds(spark):
    with pytest.raises(ValueError):
        history.page(spark.range(1), limit=501)
