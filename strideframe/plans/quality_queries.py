"""Splits, class weights, scaling and classifier quality."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe import schemas as S
from strideframe.operators import evaluation, history, splitting
from strideframe.plans import sql_parts as Q
from strideframe.plans.registry import query
from strideframe.plans.sensor_queries import samples
from strideframe.plans.views import judged, table

CLASSES = ["FALL", "LAYING", "SITTING", "STANDING", "WALKING", "WALKING_DOWNSTAIRS", "WALKING_UPSTAIRS"]
_COUNTS = f"WITH {Q.JUDGED}"
_REPORT = _COUNTS + """,
labels_seen AS (SELECT actual AS label FROM pairs UNION SELECT predicted FROM pairs),
report AS (
  SELECT label, coalesce(sum(n) FILTER (WHERE actual = label), 0) AS support,
    coalesce(sum(n) FILTER (WHERE predicted = label), 0) AS claimed,
    coalesce(sum(n) FILTER (WHERE actual = label AND predicted = label), 0) AS hits
  FROM labels_seen CROSS JOIN pairs GROUP BY label
),
rates AS (
  SELECT *, CASE WHEN claimed > 0 THEN hits / CAST(claimed AS DOUBLE) ELSE 0 END AS precision,
    CASE WHEN support > 0 THEN hits / CAST(support AS DOUBLE) ELSE 0 END AS recall FROM report
),
scored AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2*precision*recall/(precision+recall) ELSE 0 END AS f1 FROM rates)"""


METRICS_SQL = f"""{_REPORT} SELECT round(sum(hits) / CAST(sum(support) AS DOUBLE), 6) AS accuracy,
  round(avg(f1), 6) AS macro_f1, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM scored"""


def _r(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[
        F.round(f.name, places).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f.name)
        for f in df.schema
    ])


@query(
    "confusion_matrix",
    f"""{_COUNTS}, c AS (SELECT unnest({CLASSES}) AS name)
SELECT a.name AS actual, b.name AS predicted, CAST(coalesce(n, 0) AS BIGINT) AS n,
  round(coalesce(n, 0) / (sum(coalesce(n, 0)) OVER (PARTITION BY a.name) + 1e-12), 6) AS share
FROM c a CROSS JOIN c b LEFT JOIN pairs ON pairs.actual = a.name AND pairs.predicted = b.name""",
)
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    counts = evaluation.pair_counts(judged(spark, sf))
    return _r(evaluation.row_normalised(evaluation.confusion_matrix(counts, CLASSES)))


@query(
    "class_report",
    f"""{_REPORT} SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
  CAST(support AS BIGINT) AS support FROM scored""",
)
def class_report(spark: SparkSession, sf: str) -> DataFrame:
    return _r(evaluation.class_report(evaluation.pair_counts(judged(spark, sf))))


_AUC = """auc AS (
  SELECT CASE WHEN count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos) = 0 THEN 1.0 ELSE
    (sum(CASE WHEN pos THEN ranked END) - count(*) FILTER (WHERE pos) * (count(*) FILTER (WHERE pos) + 1) / 2)
      / (CAST(count(*) FILTER (WHERE pos) AS DOUBLE) * count(*) FILTER (WHERE NOT pos)) END AS fall_roc_auc
  FROM (SELECT actual = 'FALL' AS pos, rank() OVER (ORDER BY score)
      + (count(*) OVER (PARTITION BY score) - 1) / CAST(2 AS DOUBLE) AS ranked FROM judged)
)"""


@query(
    "classifier_evaluation",
    f"""{_REPORT}, {_AUC},
fall AS (SELECT s.*, (SELECT sum(n) FROM pairs) AS total FROM scored s WHERE label = 'FALL')
SELECT (SELECT round(sum(hits) / CAST(sum(support) AS DOUBLE), 6) FROM scored) AS accuracy,
  (SELECT round(avg(precision), 6) FROM scored) AS macro_precision,
  (SELECT round(avg(recall), 6) FROM scored) AS macro_recall, (SELECT round(avg(f1), 6) FROM scored) AS macro_f1,
  (SELECT round(sum(precision * support) / sum(support), 6) FROM scored) AS weighted_precision,
  (SELECT round(sum(recall * support) / sum(support), 6) FROM scored) AS weighted_recall,
  (SELECT round(sum(f1 * support) / sum(support), 6) FROM scored) AS weighted_f1,
  round(recall, 6) AS fall_recall, round(precision, 6) AS fall_precision, round(f1, 6) AS fall_f1,
  round((claimed - hits) / CAST(total - support AS DOUBLE), 6) AS fall_fpr,
  round((support - hits) / CAST(support AS DOUBLE), 6) AS fall_fnr,
  (SELECT round(fall_roc_auc, 6) FROM auc) AS fall_roc_auc
FROM fall""",
)
def classifier_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return _r(evaluation.evaluate(judged(spark, sf), "FALL", "score", CLASSES))


def _subject_features(spark: SparkSession, sf: str, with_origin: bool) -> DataFrame:
    out = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("subject_id"),
        ((F.col("l_suppkey") % 4 == 0) & (F.col("l_returnflag") == "A")).cast("int").alias("is_fall"),
        F.col("l_returnflag").alias("activity"), "l_orderkey", "l_linenumber",
    )
    if with_origin:
        origin = F.when(F.col("subject_id") % 4 == 0, "fall_cohort").when(F.col("subject_id") % 3 == 0, "test")
        out = out.withColumn("split_origin", origin.otherwise("train"))
    return out


_DRAW = """SELECT subject_id, row_number() OVER (ORDER BY md5('42-' || subject_id)) <=
    greatest(1, CAST(floor(count(*) OVER () * CAST(0.3 AS DOUBLE)) AS BIGINT)) AS for_test FROM {src}"""
_SPLIT = f"""f AS (SELECT DISTINCT l_suppkey AS subject_id FROM lineitem WHERE l_suppkey % 4 = 0 AND l_returnflag = 'A'),
a AS (SELECT DISTINCT l_suppkey AS subject_id FROM lineitem WHERE NOT (l_suppkey % 4 = 0 AND l_returnflag = 'A')),
split AS (
  SELECT subject_id, CASE WHEN for_test THEN 'test' ELSE 'train' END AS part FROM ({_DRAW.format(src="f")})
  UNION SELECT subject_id, CASE WHEN for_test THEN 'test' ELSE 'train' END FROM ({_DRAW.format(src="a")})
)"""


@query("drawn_subject_split", f"WITH {_SPLIT} SELECT subject_id, part FROM split")
def drawn_subject_split(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_subjects(_subject_features(spark, sf, with_origin=False))


@query(
    "official_subject_split",
    f"""WITH {_SPLIT.split("a AS")[0].rstrip().rstrip(",")}
SELECT subject_id, CASE WHEN for_test THEN 'test' ELSE 'train' END AS part FROM ({_DRAW.format(src="f")})
UNION SELECT DISTINCT l_suppkey, CASE WHEN l_suppkey % 3 = 0 THEN 'test' ELSE 'train' END FROM lineitem
WHERE l_suppkey % 4 <> 0""",
)
def official_subject_split(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_subjects(_subject_features(spark, sf, with_origin=True))


@query(
    "split_leakage",
    f"""WITH {_SPLIT} SELECT subject_id FROM split WHERE part = 'train'
INTERSECT SELECT subject_id FROM split WHERE part = 'test'""",
)
def split_leakage(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.leaked_subjects(splitting.split_subjects(_subject_features(spark, sf, with_origin=False)))


@query(
    "split_part_sizes",
    f"""WITH {_SPLIT} SELECT part, count(*) AS n FROM lineitem JOIN split ON split.subject_id = l_suppkey
WHERE part = 'train' GROUP BY part UNION ALL
SELECT part, count(*) AS n FROM lineitem JOIN split ON split.subject_id = l_suppkey WHERE part = 'test' GROUP BY part""",
)
def split_part_sizes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _subject_features(spark, sf, with_origin=False)
    split = splitting.split_subjects(rows)
    both = [splitting.members(rows, split, p).select(F.lit(p).alias("part")) for p in ("train", "test")]
    return both[0].unionByName(both[1]).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "class_weights",
    """WITH c AS (SELECT l_returnflag AS activity, count(*) AS n FROM lineitem GROUP BY 1)
SELECT activity, round(sum(n) OVER () / CAST(count(*) OVER () * n AS DOUBLE), 6) AS weight FROM c""",
)
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return _r(splitting.class_weights(table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "activity"), "activity"))


@query(
    "label_codes",
    "SELECT activity, row_number() OVER (ORDER BY activity) - 1 AS code"
    " FROM (SELECT DISTINCT strftime(l_shipdate, '%Y') AS activity FROM lineitem)",
)
def label_codes(spark: SparkSession, sf: str) -> DataFrame:
    years = table(spark, sf, "lineitem").select(F.date_format("l_shipdate", "yyyy").alias("activity"))
    return splitting.label_codes(years, "activity")


_SCALED_SQL = ", ".join(
    f"round(({a} - (SELECT avg({a}) FROM train)) / (SELECT CASE WHEN stddev_pop({a}) > 0 THEN stddev_pop({a}) ELSE 1 END"
    f" FROM train), 6) AS {a}" for a in S.AXES
)


@query(
    "scaled_axes",
    f"""WITH {Q.RAW}, train AS (SELECT * FROM samples WHERE device_id % 3 > 0)
SELECT device_id, ts, seq_a, seq_b, seq_c, {_SCALED_SQL} FROM samples""",
)
def scaled_axes(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples(spark, sf)
    fitted = splitting.scaler(rows.where(F.col("device_id") % 3 > 0), S.AXES)
    return _r(splitting.scaled(rows, fitted, S.AXES).select("device_id", "ts", "seq_a", "seq_b", "seq_c", *S.AXES))


_MODELS_SQL = """m AS (
  SELECT l_returnflag || l_linestatus AS "Model", avg(l_discount) * 10 AS "Accuracy", avg(l_tax) * 12 AS "Macro F1",
    avg(l_quantity) / 50 AS "Fall Recall" FROM lineitem GROUP BY 1
)"""


def _models(spark: SparkSession, sf: str) -> DataFrame:
    """Three rates per group of line items, standing in for the metrics of several models."""
    return table(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("Model")).agg(
        (F.avg("l_discount") * 10).alias("Accuracy"), (F.avg("l_tax") * 12).alias("Macro F1"),
        (F.avg("l_quantity") / 50).alias("Fall Recall"),
    )


_COMPOSITE = '0.5 * "Fall Recall" + 0.3 * "Macro F1" + 0.2 * "Accuracy"'


@query(
    "best_model",
    f"""WITH {_MODELS_SQL} SELECT "Model", round({_COMPOSITE}, 6) AS "Composite Score" FROM m
ORDER BY {_COMPOSITE} DESC, "Model" LIMIT 1""",
)
def best_model(spark: SparkSession, sf: str) -> DataFrame:
    scored = _models(spark, sf).withColumn(
        "Composite Score", evaluation.composite_score(F.col("Fall Recall"), F.col("Macro F1"), F.col("Accuracy"))
    )
    return _r(evaluation.best_model(scored, "Model").select("Model", "Composite Score"))


@query(
    "melted_comparison",
    f"""WITH {_MODELS_SQL} SELECT "Model", "Metric", round("Score", 6) AS "Score"
FROM (UNPIVOT m ON "Accuracy", "Macro F1", "Fall Recall" INTO NAME "Metric" VALUE "Score")""",
)
def melted_comparison(spark: SparkSession, sf: str) -> DataFrame:
    return _r(evaluation.melted(_models(spark, sf), ["Accuracy", "Macro F1", "Fall Recall"]))


@query(
    "top_features",
    """SELECT CAST(l_partkey AS VARCHAR) AS feature, round_even(sum(l_extendedprice) / 1e7, 4) AS importance
FROM lineitem GROUP BY l_partkey ORDER BY sum(l_extendedprice) / 1e7 DESC, feature LIMIT 10""",
)
def top_features(spark: SparkSession, sf: str) -> DataFrame:
    weights = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("feature")).agg(
        (F.sum("l_extendedprice") / 1e7).alias("importance")
    )
    return evaluation.top_features(weights)


@query(
    "cohort_union",
    """SELECT cohort, count(*) AS n, count(DISTINCT subject_id) AS subjects FROM (
  SELECT 'adl' AS cohort, l_suppkey AS subject_id FROM lineitem WHERE l_returnflag <> 'A'
  UNION ALL SELECT 'fall', l_suppkey FROM lineitem WHERE l_returnflag = 'A') GROUP BY cohort""",
)
def cohort_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = samples(spark, sf).select(F.col("device_id").alias("subject_id"), "activity")
    adl = rows.where("activity <> 'FALL'").withColumn("cohort", F.lit("adl"))
    fell = rows.where("activity = 'FALL'").withColumn("cohort", F.lit("fall"))
    return adl.unionByName(fell).groupBy("cohort").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("subject_id").alias("subjects")
    )


@query(
    "class_frequencies",
    f"{_COUNTS} SELECT actual, count(*) AS n FROM judged GROUP BY actual ORDER BY n DESC, actual",
)
def class_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    return history.value_counts(judged(spark, sf), "actual")
