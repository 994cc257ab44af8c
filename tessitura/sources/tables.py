"""Signals read from tables, with the reads pruned to the columns that a signal needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, frame, x): a mono track for each user."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    frame = (F.row_number().over(order) - 1).cast("long")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), frame.alias("frame"), (F.col("value") / 500.0).alias("x"))


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, track_id, ts, type, x), ts as an instant."""
    return read(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("track_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"), (F.col("value") / 500.0).alias("x")
    )


def embedding_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, bus, samples): an interleaved block for each vector."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("track_id"), F.col("label").alias("bus"), F.col("embedding").cast("array<double>").alias("samples"))


def embedding_signal(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """(track_id, bus, frame, l, r): a stereo track of 32 frames for each vector. With `dealt`, vectors are dealt out by track, and no track is in two partitions."""
    blocks = embedding_blocks(spark, sf_dir)
    if dealt:
        blocks = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "track_id")
    frames = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct(i.cast("long").alias("frame"), F.get("samples", 2 * i).alias("l"), F.get("samples", 2 * i + 1).alias("r")))
    return blocks.select("track_id", "bus", F.inline(frames))


def customer_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, frame, x): a mono track for each nation."""
    order = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    frame = (F.row_number().over(order) - 1).cast("long")
    return read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("track_id"), frame.alias("frame"), (F.col("c_acctbal") / 10000.0).alias("x"))


def mixer_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mixer_id, parent_id): nations under regions under the root 0."""
    nations = read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 200).cast("long").alias("mixer_id"), (F.col("n_regionkey") + 100).cast("long").alias("parent_id"))
    regions = read(spark, sf_dir, "region").select((F.col("r_regionkey") + 100).cast("long").alias("mixer_id"), F.lit(0).cast("long").alias("parent_id"))
    root = spark.range(1).select(F.lit(0).cast("long").alias("mixer_id"), F.lit(None).cast("long").alias("parent_id"))
    return nations.unionAll(regions).unionAll(root)
