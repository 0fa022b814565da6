"""The driver's tables in the roles of the data model, each as a DataFrame and as a CTE of DuckDB SQL.

ev   one user's events of one type are a channel; x = ln(1 + value); n numbers them in time
rec  all embeddings of a label are a recording of 8 channels; 8 samples of each come from each vector
ep   each embedding is an epoch of 4 channels and 16 times from -0.2 s in steps of 0.08 s
seq  a user's event types in time are a sequence of states 0..4
sig  each embedding is a signal of 64 samples at 64 Hz
ft   the embeddings' components are features of vec_id, label is the class
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHANNELS = ["Fz", "Cz", "Pz", "O1"]
STATES = ["click", "error", "purchase", "signup", "view"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("subject"), F.lit("stream").alias("task"), F.col("event_type").alias("ch"),
        (F.row_number().over(w) - 1).cast("long").alias("n"), F.ln(1 + F.col("value")).alias("x"),
    )


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "e")).withColumn("e", F.col("e").cast("double"))


def rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch = F.floor(F.col("i") / 8).cast("int")
    return _components(spark, sf_dir).select(
        F.col("label").cast("string").alias("subject"), F.lit("rest").alias("task"), ch.alias("ch_idx"), F.concat(F.lit("C"), ch.cast("string")).alias("ch"),
        (F.col("vec_id") * 8 + F.col("i") % 8).cast("long").alias("n"), F.col("e").alias("x"),
    )


def ep(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch = F.floor(F.col("i") / 16).cast("int")
    k = (F.col("i") % 16).cast("int")
    return _components(spark, sf_dir).select(
        F.concat(F.lit("S"), (F.col("vec_id") % 20).cast("string")).alias("subject"), F.col("vec_id").alias("epoch"), F.col("label").cast("int").alias("code"),
        ch.alias("ch_idx"), F.get(F.array(*map(F.lit, CHANNELS)), ch).alias("ch"), k.alias("k"), (F.lit(-0.2) + k * F.lit(0.08)).alias("t"), F.col("e").alias("x"),
    )


def seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("subject"), (F.row_number().over(w) - 1).cast("long").alias("n"),
        (F.array_position(F.array(*map(F.lit, STATES)), F.col("event_type")) - 1).cast("int").alias("state"), F.ln(1 + F.col("value")).alias("x"),
    )


def sig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec"), F.col("embedding").cast("array<double>").alias("xs"))


def ft(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _components(spark, sf_dir).select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), F.concat(F.lit("f"), F.lpad(F.col("i").cast("string"), 2, "0")).alias("name"), F.col("e").alias("value"))


_COMP = "(SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"
CTE = {
    "ev": "ev AS (SELECT CAST(user_id AS VARCHAR) AS subject, event_type AS ch, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS n, ln(1 + value) AS x FROM events)",
    "rec": f"rec AS (SELECT CAST(label AS VARCHAR) AS subject, CAST(i // 8 AS INTEGER) AS ch_idx, 'C' || (i // 8) AS ch, vec_id * 8 + i % 8 AS n, e AS x FROM {_COMP})",
    "ep": f"ep AS (SELECT 'S' || (vec_id % 20) AS subject, vec_id AS epoch, CAST(label AS INTEGER) AS code, CAST(i // 16 AS INTEGER) AS ch_idx, ['Fz','Cz','Pz','O1'][i // 16 + 1] AS ch, CAST(i % 16 AS INTEGER) AS k, CAST(-0.2 AS DOUBLE) + (i % 16) * CAST(0.08 AS DOUBLE) AS t, e AS x FROM {_COMP})",
    "seq": "seq AS (SELECT CAST(user_id AS VARCHAR) AS subject, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n, CAST(list_position(['click','error','purchase','signup','view'], event_type) - 1 AS INTEGER) AS state, ln(1 + value) AS x FROM events)",
    "sig": f"sig AS (SELECT vec_id AS rec, i AS n, e AS x FROM {_COMP})",
    "ft": f"ft AS (SELECT vec_id AS id, CAST(label AS INTEGER) AS label, 'f' || lpad(CAST(i AS VARCHAR), 2, '0') AS name, e AS value FROM {_COMP})",
}


def sql(body: str, *names: str) -> str:
    """SQL of a body over the named CTEs; a body may go on with CTEs of its own after a leading comma."""
    head = "WITH " + ", ".join(CTE[n] for n in names)
    return f"{head} {body}" if body.lstrip().startswith(",") else f"{head} {body.strip()}"
