"""Connected components of an edge table: least labels with pointer jumping, cut by reliable checkpoints."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset a folder of our own, in local mode only."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = getattr(shared_folder, "own", None) or "file://" + tempfile.mkdtemp(prefix="loomfield-")
        shared_folder.own = own
    return own.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, made anew without the optimizer's guess at its size: loops multiply such guesses until planning takes minutes."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(spark))
    held = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(held.queryExecution().toRdd(), held.schema(), False), spark)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to a fresh path of the shared folder and read again, and that path: columnar and compressed, and gone as soon as ``dropped`` names it."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path), path


def dropped(spark: SparkSession, *paths: str) -> None:
    """Delete tables that ``stored`` wrote, and let Spark delete exchanges that nothing refers to any more: an idle driver heap would keep them for the length of a job."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    gc.collect()
    spark._jvm.System.gc()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node each node with an edge reaches."""
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    both = cut(e.union(e.select("v", "u")).where("u <> v").distinct())
    labels = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("c")).withColumnRenamed("u", "node"))
    while True:
        far = labels.select(F.col("node").alias("v"), F.col("c").alias("vc"))
        least = both.join(far, "v").groupBy("u").agg(F.min("vc").alias("m"))
        step = labels.join(least, F.col("node") == F.col("u")).select("node", "c", F.least("c", "m").alias("c2"))
        root = labels.select(F.col("node").alias("r"), F.col("c").alias("rc"))
        jumped = cut(step.join(root, F.col("c2") == F.col("r"), "left").select("node", "c", F.least("c2", F.coalesce("rc", "c2")).alias("c2")))
        changed = jumped.where("c <> c2").limit(1).count()
        labels = jumped.select("node", F.col("c2").alias("c"))
        if not changed:
            return labels.select("node", F.col("c").alias("component"))
