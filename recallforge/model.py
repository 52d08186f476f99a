"""The data model over the driver's tables.

memories: documents (content, two domains).  states: events read as assertions that
an entity (user) has a value (a band of ten) under a key (event type).  accesses:
events read as reads of a memory (user).  links: (memory, entity) pairs, orders and
the parts they hold.  Every table is a lazy DataFrame over its Parquet files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from recallforge.shared import dealt

#: The clock of every query: results never depend on the wall clock.
NOW = "2024-02-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("memory_id"), F.col("text").alias("content"), F.array("lang", "source").alias("domains"), "lang", "source", "n_chars")


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("node_id"), F.col("user_id").alias("entity_id"), F.col("event_type").alias("state_key"), F.floor(F.col("value") / 10).cast("long").alias("state_value"), F.col("ts").alias("created_at")
    )


STATES_SQL = "states AS (SELECT event_id AS node_id, user_id AS entity_id, event_type AS state_key, CAST(floor(value / 10) AS BIGINT) AS state_value, ts AS created_at FROM events)"


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("memory_id"), F.col("ts").alias("accessed_at"), F.get_json_object("props", "$.k").cast("long").alias("agent"))


ACCESSES_SQL = "accesses AS (SELECT user_id AS memory_id, ts AS accessed_at, CAST(json_extract_string(props, '$.k') AS BIGINT) AS agent FROM events)"


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("memory_id"), F.col("l_partkey").alias("entity_id"))
    return li.repartition(dealt(li.count()), "memory_id").distinct()


LINKS_SQL = "links AS (SELECT DISTINCT l_orderkey AS memory_id, l_partkey AS entity_id FROM lineitem)"
