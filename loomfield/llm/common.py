"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a lambda variable.

    Catalyst may inline an aliased expression into a higher-order function that
    names it once, and would then evaluate it again for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def text_of(col: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(col, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, one of our own, in local mode only."""
    own = spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    held = getattr(shared_dir, "_own", None)
    if held is None:
        folder = tempfile.mkdtemp(prefix="loomfield-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        held = shared_dir._own = "file://" + folder
    return held


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends at files that survive a lost executor.

    A checkpointed table keeps the size and the constraints that the optimizer derived for its plan. Sizes of joins are products,
    so a loop over such tables squares them each round, until planning alone takes minutes. The table is therefore made anew
    over the same rows, with no guess at its size: adaptive execution sees the real one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    held = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(held.queryExecution().toRdd(), held.schema(), False), spark)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle and checkpoint files of tables that nothing refers to any more.

    It does so when their handles are collected, which an idle driver heap may put off for the length of a whole job.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written intermediate table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a table that ``scratch_path`` named."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def arrow_rows(spark: SparkSession, rows: int = 256) -> None:
    """Bound Arrow batches: whole texts can be long, so few rows go at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    held = env.get("PYTHONPATH", "")
    if root not in held.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, held) if x)
