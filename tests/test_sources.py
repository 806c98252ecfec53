import pytest
from pyspark.sql import functions as F

from strideframe import schemas as S
from strideframe.sources import readers, writers


def samples(spark, windows=4):
    return spark.range(windows * 128).select(
        (F.col("id") % 3).cast("int").alias("subject_id"),
        F.when(F.floor(F.col("id") / 128) % 2 == 0, "train").otherwise("test").alias("split_origin"),
        F.concat(F.lit("w"), F.floor(F.col("id") / 128).cast("string")).alias("window_id"),
        (F.col("id") % 128).cast("int").alias("step"),
        *[(F.col("id") * 0.25).alias(a) for a in S.AXES], F.lit("WALKING").alias("activity"), F.lit(0).alias("is_fall"),
    )


def test_csv_and_parquet(spark, tmp_path):
    df = samples(spark)
    for fmt in ("csv", "parquet"):
        writers.write_samples(df, str(tmp_path / fmt), fmt)
    back = readers.read_samples_csv(spark, str(tmp_path / "csv")).select(*df.columns)
    assert back.exceptAll(df).isEmpty() and back.count() == df.count()
    assert spark.read.parquet(str(tmp_path / "parquet")).where("split_origin = 'test'").count() == 256


def test_replay_takes_the_held_out_part(spark, tmp_path):
    samples(spark).repartition(3).write.parquet(str(tmp_path / "in"))
    query = (readers.replay(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("replayed")
             .trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start())
    query.awaitTermination()
    assert spark.table("replayed").groupBy("split_origin").count().collect() == [("test", 256)]


def test_matrices(spark, tmp_path):
    for split, n in (("train", 3), ("test", 2)):
        (tmp_path / split / "Inertial Signals").mkdir(parents=True)
        for k, (name, file) in enumerate(readers.MATRIX_FILES.items()):
            path = tmp_path / split / file.format(split=split)
            if name == "label":
                path.write_text("\n".join(str(i + 6) for i in range(n)) + "\n")
            elif name == "subject":
                path.write_text("\n".join(str(i + 20) for i in range(n)) + "\n")
            else:
                path.write_text("".join(
                    "  " + "  ".join(f"{k * 1000 + i * 128 + t:.7e}" for t in range(128)) + "\n" for i in range(n)))
    out = readers.read_matrices(spark, str(tmp_path))
    assert out.count() == 5 * 128
    row = out.where("window_id = 'train_2' AND step = 5").first()
    assert (row["subject_id"], row["activity"], row["is_fall"]) == (22, "ACTIVITY_8", 0)
    assert (row["acc_x"], row["gyro_z"]) == (261.0, 5261.0)
    assert out.where("window_id = 'test_1'").first()["activity"] == "FALL"
    assert [f.name for f in out.schema] == [f.name for f in S.SENSOR_STREAM]


def test_matrices_are_sorted_once_and_their_lines_stay_in_place(spark, tmp_path, monkeypatch):
    """Eight files need one sort, and numbering deals no line by its block."""
    rows = spark.range(300).repartition(7).select(
        (F.col("id") % 30).alias("subject"), F.floor(F.col("id") / 30).alias("n"), (F.col("id") % 7 + 1).alias("label"),
        *[F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.col("id") + i / 8.0).alias(a) for a in S.AXES],
    )
    sorts, sort = [], type(rows).orderBy
    monkeypatch.setattr(type(rows), "orderBy", lambda self, *a: sorts.append(a) or sort(self, *a))
    for codec, ending in (("none", ".txt"), ("gzip", ".txt.gz")):
        sorts.clear()
        root = str(tmp_path / codec)
        writers.write_matrices(rows, ["subject", "n"], root, "train", *([] if codec == "none" else [codec]))
        assert len(sorts) == 1 and {p.name[p.name.index(".txt"):] for p in (tmp_path / codec).rglob("part-*")} == {ending}
        back = readers.read_matrices(spark, root, ["train"])
        got = [(r.window_id, r.subject_id, r.acc_x, r.gyro_z) for r in back.where("step = 3").collect()]
        order = [(s, n) for s in range(30) for n in range(10)]
        assert sorted(got) == sorted((f"train_{i}", s, n * 30 + s + 0.5, n * 30 + s + 0.5) for i, (s, n) in enumerate(order))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = readers.numbered_lines(spark, str(tmp_path / "none" / "train" / "y_train.txt"))
        plan = lines._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan


def test_lines_of_many_blocks_and_files(spark, tmp_path):
    """Positions run on over blocks of a file and over part files; empty lines have none."""
    (tmp_path / "f").mkdir()
    lines = [f"line {i} " + "x" * (i % 90) for i in range(5000)]
    for k in range(3):
        part = [x for line in lines[k * 2000 : (k + 1) * 2000] for x in ([line, " "] if len(line) % 7 == 0 else [line])]
        (tmp_path / "f" / f"part-0000{k}.txt").write_text("\n".join(part) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = readers.numbered_lines(spark, str(tmp_path / "f")).orderBy("row_idx").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.row_idx, r.value) for r in got] == list(enumerate(lines))
    (tmp_path / "none.txt").write_text("\n\n")
    assert readers.numbered_lines(spark, str(tmp_path / "none.txt")).count() == 0


def test_cache_is_keyed_by_parameters(spark, tmp_path):
    calls = []

    def compute(n):
        def run():
            calls.append(n)
            return spark.range(n)
        return run

    root = str(tmp_path / "cache")
    for n in (3, 3, 4):
        assert writers.cached(spark, root, {"rate": n}, compute(n)).count() == n
    assert calls == [3, 4]


def test_metrics_fallback(spark, tmp_path):
    path = str(tmp_path / "metrics")
    assert writers.read_metrics(spark, path).count() == 0
    assert writers.read_metrics(spark, path, spark.createDataFrame([(0.5,)], "accuracy double")).first()[0] == 0.5
    writers.write_json(spark.createDataFrame([(0.9,)], "accuracy double"), path)
    assert writers.read_metrics(spark, path).first()["accuracy"] == 0.9


def test_batches_are_written_once(spark, tmp_path):
    for n in (5, 5):
        writers.append_once(spark.range(n), str(tmp_path / "t"), "q", 1)
    writers.append_once(spark.range(2), str(tmp_path / "t"), "q", 2)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 7


def test_alignment_and_users(spark):
    old = spark.createDataFrame([(1, None)], "id long, activity string")
    row = readers.align(old, S.FALL_EVENTS, {"activity": "FALL", "confirmed": False}).first()
    assert (row["activity"], row["confirmed"], row["location_lat"]) == ("FALL", False, None)
    known, unknown = readers.known_users(
        spark.createDataFrame([(1,), (2,)], "user_id long"), spark.createDataFrame([(1,)], "id long"))
    assert known.count() == 1 and unknown.first()["code"] == "USER_NOT_FOUND"


@pytest.mark.parametrize("kind", writers.MESSAGE_TYPES)
def test_audience(spark, kind):
    got = spark.range(1).select(writers.audience(F.lit(kind))).first()[0]
    assert got == ("monitors,devices" if kind.startswith("FALL_") else "monitors")
