"""Table access, and files in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from recallforge.shared import cut, hot_keys, hot_list, salted_join, shared_dir

__all__ = ["apart", "cut", "fresh_path", "held", "hot_keys", "hot_list", "release", "salted_join", "scratch", "shared_dir", "sieve", "sifted", "table", "written"]

_written: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_path(spark: SparkSession, stem: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def release(spark: SparkSession, paths: list[str]) -> None:
    """Deletes ``paths`` of ``fresh_path``; frames read from them are of no more use."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        _written.remove(path)


@contextmanager
def scratch(spark: SparkSession, *keep: str) -> Iterator[None]:
    """What is written by ``fresh_path`` within goes at the end, but for ``keep``."""
    before = set(_written)
    try:
        yield
    finally:
        release(spark, [p for p in _written if p not in before and p not in keep])


def written(df: DataFrame, stem: str) -> DataFrame:
    """Write as Parquet in the shared folder and read it back."""
    path = fresh_path(df.sparkSession, stem)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is computed once per row: a generator's output is
    never put in place of its name, neither in filters nor in lambdas, where it
    would be computed again for each element."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def apart(docs: DataFrame, *used: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with all columns but the ``used`` ones under names that no operator
    uses, and the columns that give its own names and order back."""
    names = {c: c if c in used else f"_own{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), [F.col(n).alias(c) for c, n in names.items()]


#: Bits of a sieve: at most 2**18 rows of 16 bytes, whatever it stands for.
SIEVE_BITS = 1 << 24


def sieve(rows: DataFrame, key: str) -> DataFrame:
    """(_word, _bits): a hashed bit set of the keys of ``rows``, of bounded size, to be
    broadcast.  It holds every key, and others by chance; the more keys, the more."""
    at = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(SIEVE_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    return rows.select(F.shiftright(at, 6).cast("int").alias("_word"), bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))


def sifted(rows: DataFrame, key: str, bits: DataFrame) -> DataFrame:
    """``rows`` with ``_maybe``: false if their key is surely not in the sieve."""
    at = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(SIEVE_BITS))
    marked = rows.withColumn("_at", at).join(F.broadcast(bits), F.shiftright("_at", 6).cast("int") == F.col("_word"), "left")
    hit = F.call_function("shiftright", F.col("_bits"), F.col("_at").bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1
    return marked.withColumn("_maybe", F.coalesce(hit, F.lit(False))).drop("_at", "_word", "_bits")
