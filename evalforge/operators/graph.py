"""Connected components of undirected edges: least labels, whole trees hooked on in a round, with a jump each round."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_written: list[str] = []


def release(spark: SparkSession) -> None:
    """Delete the tables that `cut` wrote in this process, once the results that read them are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def cut(df: DataFrame, **options: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the folder of spark.checkpoint.dir and read it back (a checkpoint would work
    it out twice); `options` are the writer's. Where that is unset a local session gets a temporary folder, and any other is
    an error: executors would write where nobody else can read."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="evalforge-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/evalforge-cut-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """node, component (its least node) from edges (a, b); nodes (node) adds those without edges.

    A round gives the least label near a node to the node and to its label, then every node takes its label's label.
    Labels only fall, and rounds go on until none does."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    for _ in itertools.count():
        near = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        own = F.struct("node", "label", F.least("label", "near").alias("next"))
        hook = F.struct(F.col("label").alias("node"), F.lit(None).cast(labels.schema["label"].dataType).alias("label"), F.col("near").alias("next"))
        told = labels.join(near, "node").select(F.inline(F.array(own, hook)))
        step = cut(told.groupBy("node").agg(F.max("label").alias("label"), F.min("next").alias("next")))
        if step.filter("label <> next").isEmpty():
            break
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        labels = cut(step.join(jump, "next").select("node", F.col("far").alias("label")))
    out = labels.withColumnRenamed("label", "component")
    if nodes is not None:
        out = nodes.select("node").distinct().join(out, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return out
