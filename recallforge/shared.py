"""The shared folder for cut lineage, and joins on keys of uneven size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A key is hot if it holds more than this many rows and more than 1/HOT_KEYS of
#: the table, so there are few hot keys at any size, and their set is broadcast.
HOT_ROWS = 1024
HOT_KEYS = 1000
SALTS = 64
#: Rows of a group-by that one task holds.
TASK_ROWS = 250_000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.  Where it is unset, a local session
    gets a temporary one; on a cluster that is an error, for executors would write
    where nobody else can read."""
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not set_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        set_dir = tempfile.mkdtemp(prefix="recallforge-")
        sc.setCheckpointDir(set_dir)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(set_dir)
    return set_dir


def fresh_dir(spark: SparkSession, stem: str) -> str:
    """A folder of its own in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialised in the shared folder, so that a lost executor costs nothing that
    came before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table of its own in the shared folder, written in one run."""
    path = fresh_dir(df.sparkSession, "kept")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(rows: int) -> int:
    """Tasks for ``rows`` rows of a group-by, so that what one task holds stays the same
    at any size."""
    return max(8, -(-rows // TASK_ROWS))


def hot_keys(sizes: DataFrame, key: str, count: str, rows: int) -> DataFrame:
    """The keys of ``sizes`` (key, count) that hold too much of ``rows`` rows for
    one task.  There are at most HOT_KEYS of them in a table of ``rows`` rows."""
    return sizes.where(F.col(count) > max(HOT_ROWS, rows // HOT_KEYS)).select(F.col(key).alias("_hot"))


def hot_list(sizes: DataFrame, key: str, count: str) -> list:
    """The hot keys among all rows that ``sizes`` (a table) counts, as values: at most
    HOT_KEYS of them, so they are a set in the plan and no join marks their rows."""
    every = sizes.agg(F.sum(count)).first()[0] or 0
    return [r[0] for r in hot_keys(sizes, key, count, every).collect()]


def salted_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | list, spread: list[str], how: str = "inner", parts: int | None = None) -> DataFrame:
    """``left`` joined with ``right`` (one row per key) on ``key``.  Rows of hot keys
    and of null keys are dealt over SALTS sub-keys by ``spread``, columns of
    ``left``; the right row of a hot key is repeated for each.  ``hot``: a frame of
    ``hot_keys`` or the values of ``hot_list``.
    With ``parts`` the join has that many tasks."""
    salt = F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")
    if isinstance(hot, list):
        marked, is_hot = lambda df: df, F.col(key).isin(hot) if hot else F.lit(False)
    else:
        marked, is_hot = lambda df: df.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left"), F.col("_hot").isNotNull()
    mine = marked(left).withColumn("_salt", F.when(is_hot | F.col(key).isNull(), salt).otherwise(0)).drop("_hot")
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    other = marked(right).withColumn("_salt", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0))))).drop("_hot")
    if parts:
        mine = mine.repartition(parts, key, "_salt")
    return mine.join(other, [key, "_salt"], how).drop("_salt")
