"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space, tab, line feed, vertical tab, form feed and carriage return: the only separators of words.
BLANK = r"\x20\x09-\x0D"
WORD = rf"[^{BLANK}]+"
#: Keys of more than one in so many rows are hot; there are fewer than so many of them.
HOT_SHARE = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session that names none gets a temporary one: elsewhere each
    executor would write to a disk of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = getattr(spark, "_veilframe_dir", None)
    if own is None:
        own = spark._veilframe_dir = tempfile.mkdtemp(prefix="veilframe-")
        atexit.register(shutil.rmtree, own, True)
    return f"file://{own}"


def session_dir(spark: SparkSession) -> str:
    """Where this session's tables lie; see clean()."""
    return f"{shared_dir(spark)}/veilframe/{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends here, and lost executors cost no earlier stage."""
    path = f"{session_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> None:
    """Removes the tables of this session; for the end of a job, when all results have been stored."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread_join(rows: DataFrame, table: DataFrame, key: str, n_rows: int, how: str = "inner") -> DataFrame:
    """rows joined with table (key, n, ...) by key; table has one row of a few numbers for each key, n being the number of
    rows of that key, and goes without n into the result.

    A key of more than 1 / HOT_SHARE of the n_rows rows would be a hot task, so these, fewer than HOT_SHARE by their number,
    are broadcast; the others meet by a shuffle.
    """
    is_hot = F.col("n") * HOT_SHARE > n_rows
    named = [c for c in table.columns if c not in (key, "n")]
    hot = table.where(is_hot).select(key, F.lit(True).alias("_hot"), *named)
    met = rows.join(F.broadcast(hot), key, "left")
    cold = met.where("_hot is null").drop("_hot", *named).join(table.where(~is_hot).drop("n"), key, how)
    return met.where("_hot").drop("_hot").unionByName(cold)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of the input can't clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])
