"""Sources: sample tables, JSON packets and window requests, wide matrices, replay, schema alignment."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strideframe import schemas as S
from strideframe.operators.cleaning import window_reject_reason
from strideframe.schemas import MATRIX_FILES

def read_samples_csv(spark: SparkSession, path: str, schema: T.StructType = S.SENSOR_STREAM) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def replay(spark: SparkSession, path: str, fmt: str = "parquet", files_per_batch: int = 1, split: str = "test") -> DataFrame:
    """The held-out part of a stored sample table as a stream."""
    reader = spark.readStream.schema(S.SENSOR_STREAM).option("maxFilesPerTrigger", files_per_batch)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.format(fmt).load(path).where(F.col("split_origin") == split)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``row_idx, value``: non-empty lines of a text file, or of a folder of part files in the order of their names, with
    their position from 0: the one place where file order carries meaning.

    Lines are numbered within the blocks that Spark splits files into; the counts of the blocks before supply the rest.
    """
    lines = spark.read.text(path).where(F.trim("value") != "").select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
    )
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    blocks = lines.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first")).withColumn(
        "_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))
    )
    # A row a block: without the hint all lines would be dealt by block, the lines of one block to one task.
    return lines.join(F.broadcast(blocks), ["_file", "_block"]).select(
        (F.col("_offset") + F.col("_at") - F.col("_first")).alias("row_idx"), "value"
    )


def activity_name(label: Column) -> Column:
    """Activity id to name; unknown ids become ACTIVITY_<id>."""
    known = F.create_map(*[F.lit(x) for pair in S.ACTIVITY_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, label), F.concat(F.lit("ACTIVITY_"), label.cast("string")))


def assemble_windows(parts: Mapping[str, DataFrame], split: str | None = None) -> DataFrame:
    """Join six matrices with labels and subjects on row position and explode to one row per sample.

    Each part is ``row_idx, value`` (whitespace-separated text), plus ``split`` if ``split`` is not given.
    """
    on = ["row_idx"] if split is not None else ["split", "row_idx"]
    names = [*S.AXES, "label", "subject"]
    joined = None
    for name in names:
        # Numbers are joined, not their digits, which take more than twice the room.
        made = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double")) if name in S.AXES else F.col("value")
        part = parts[name].select(*on, made.alias(name))
        joined = part if joined is None else joined.join(part, on)
    origin = F.lit(split) if split is not None else F.col("split")
    label = F.trim("label").cast("int")
    zipped = F.arrays_zip(*[F.col(a).alias(a) for a in S.AXES])
    rows = joined.select(
        F.trim("subject").cast("int").alias("subject_id"), origin.alias("split_origin"),
        F.concat_ws("_", origin, F.col("row_idx").cast("string")).alias("window_id"),
        activity_name(label).alias("activity"), F.posexplode(zipped).alias("step", "_s"),
    )
    return rows.select(
        "subject_id", "split_origin", "window_id", "step",
        *[F.col("_s").getItem(a).alias(a) for a in S.AXES],
        "activity", F.lit(0).alias("is_fall"),
    )


def read_matrices(spark: SparkSession, root: str, splits: Sequence[str] = ("train", "test")) -> DataFrame:
    out = None
    for split in splits:
        parts = {n: numbered_lines(spark, f"{root}/{split}/{f.format(split=split)}") for n, f in MATRIX_FILES.items()}
        rows = assemble_windows(parts, split)
        out = rows if out is None else out.unionByName(rows)
    return out


def parse_packets(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON packets: ``_bad`` marks messages that are not JSON objects; they do not stop the stream."""
    schema = T.StructType([*S.PACKET.fields, T.StructField("_corrupt", T.StringType())])
    packet = F.from_json(value, schema, {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt",
    })
    parsed = lines.withColumn("_p", packet)
    return parsed.select(
        *lines.columns, "_p.*", (F.col("_p").isNull() | F.col("_p._corrupt").isNotNull()).alias("_bad")
    ).drop("_corrupt")


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return parsed.where(~F.col("_bad")).drop("_bad"), parsed.where("_bad")


def parse_window_requests(lines: DataFrame, value: str = "value", many: bool = False) -> DataFrame:
    """JSON window requests (one object, or a list of objects) with the reason a request is refused, if any."""
    kind = T.ArrayType(S.WINDOW_REQUEST) if many else S.WINDOW_REQUEST
    parsed = lines.withColumn("_w", F.from_json(value, kind))
    if many:
        parsed = parsed.withColumn("_w", F.explode("_w"))
    out = parsed.select(*[c for c in lines.columns if c != value], "_w.*")
    return out.withColumns({
        "reject_reason": window_reject_reason(),
        "sampling_rate": F.coalesce("sampling_rate", F.lit(S.SAMPLING_RATE)),
    })


def align(df: DataFrame, schema: T.StructType, defaults: Mapping[str, object] | None = None) -> DataFrame:
    """Bring an older table to ``schema``: a missing column gets its default (or NULL), NULLs take the default."""
    defaults = defaults or {}
    empty = df.sparkSession.createDataFrame([], schema)
    wide = df.unionByName(empty, allowMissingColumns=True)
    return wide.select(*[
        (F.coalesce(F.col(f.name), F.lit(defaults[f.name])) if f.name in defaults else F.col(f.name))
        .cast(f.dataType).alias(f.name)
        for f in schema
    ])


def known_users(samples: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(samples of registered users, rejects with a code). ``users`` is static; Spark picks the join from its size."""
    ids = users.select(F.col("id").alias("user_id"))
    return (
        samples.join(ids, "user_id", "left_semi"),
        samples.join(ids, "user_id", "left_anti").withColumn("code", F.lit("USER_NOT_FOUND")),
    )
