"""Sinks written and read back: sample files, replay, feature cache, audit rows, metrics."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strideframe import schemas as S
from strideframe.operators import evaluation, features
from strideframe.plans import sql_parts as Q
from strideframe.plans.history_queries import fall_events
from strideframe.plans.lifecycle_queries import OUTCOMES_SQL
from strideframe.plans.quality_queries import METRICS_SQL
from strideframe.plans.registry import query
from strideframe.plans.sensor_queries import DATASET_SQL, dataset
from strideframe.plans.stream_queries import fresh
from strideframe.plans.views import judged, predictions
from strideframe.sources import readers, writers
from strideframe.streaming import jobs

_PER_SPLIT = f"""WITH {DATASET_SQL}
SELECT CASE WHEN device_id % 3 = 0 THEN 'test' ELSE 'train' END AS split_origin, count(*) AS samples,
  count(DISTINCT window_id) AS windows, round(sum(acc_x), 4) AS acc_x, round(sum(gyro_z), 4) AS gyro_z FROM ds"""


def _per_split(df: DataFrame) -> DataFrame:
    return df.groupBy("split_origin").agg(
        F.count(F.lit(1)).alias("samples"), F.countDistinct("window_id").alias("windows"),
        F.round(F.sum("acc_x"), 4).alias("acc_x"), F.round(F.sum("gyro_z"), 4).alias("gyro_z"),
    )


def _unified(spark: SparkSession, sf: str) -> DataFrame:
    """The dataset view in the unified sample schema."""
    return dataset(spark, sf).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.SENSOR_STREAM])


@query("csv_samples", f"{_PER_SPLIT} GROUP BY 1")
def csv_samples(spark: SparkSession, sf: str) -> DataFrame:
    folder = fresh(spark, "csv")
    writers.write_samples(_unified(spark, sf), folder, "csv")
    return _per_split(readers.read_samples_csv(spark, folder))


@query("replayed_test_part", f"{_PER_SPLIT} WHERE device_id % 3 = 0 GROUP BY 1")
def replayed_test_part(spark: SparkSession, sf: str) -> DataFrame:
    folder = fresh(spark, "samples")
    writers.write_samples(_unified(spark, sf), folder)
    return _per_split(jobs.run_to_end(readers.replay(spark, folder, files_per_batch=1000), fresh(spark, "replay")))


@query(
    "cached_features",
    f"""WITH {DATASET_SQL} SELECT window_id, round(avg(acc_mag), 6) AS acc_mag_mean, round(max(gyro_mag), 6) AS gyro_mag_max
FROM ds GROUP BY window_id""",
)
def cached_features(spark: SparkSession, sf: str) -> DataFrame:
    names = ["acc_mag_mean", "gyro_mag_max"]
    params = {"input": sf, "rate": S.SAMPLING_RATE, "columns": names}
    made = None
    root = fresh(spark, "features")
    for _ in range(2):  # computed, then read
        made = writers.cached(spark, root, params, lambda: features.dataset_features(dataset(spark, sf), names))
    return made.select("window_id", *[F.round(n, 6).alias(n) for n in names])


@query("stored_metrics", METRICS_SQL)
def stored_metrics(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh(spark, "metrics")
    writers.write_json(evaluation.averages(evaluation.class_report(evaluation.pair_counts(judged(spark, sf)))), path)
    stored = writers.read_metrics(spark, path)
    return stored.select(*[F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


@query(
    "prediction_audit_rows",
    f"""WITH {Q.PREDICTIONS} SELECT timestamp, activity, confidence, risk_level, is_fall, device_id,
  '1.0.0' AS model_version FROM predictions""",
)
def prediction_audit_rows(spark: SparkSession, sf: str) -> DataFrame:
    folder = fresh(spark, "audit")
    rows = writers.audit_rows(predictions(spark, sf))
    for _ in range(2):  # a replayed batch is written once
        writers.append_once(rows, folder, "inference", 0)
    return spark.read.parquet(folder).drop("query", "batch")


@query(
    "acknowledgement_logs",
    f"""WITH {OUTCOMES_SQL} SELECT acknowledged_at AS timestamp, 'INFO' AS level, 'FALL_ACKNOWLEDGED' AS event,
  'Fall event #' || event_id || ' acknowledged by ' || acknowledged_by || '.' AS message
FROM outcomes WHERE acknowledged""",
)
def acknowledgement_logs(spark: SparkSession, sf: str) -> DataFrame:
    done = fall_events(spark, sf).where("acknowledged").withColumn(
        "text",
        F.concat(F.lit("Fall event #"), F.col("id").cast("string"), F.lit(" acknowledged by "), "acknowledged_by", F.lit(".")),
    )
    return writers.system_logs(done, "INFO", "FALL_ACKNOWLEDGED", "text", "acknowledged_at")
