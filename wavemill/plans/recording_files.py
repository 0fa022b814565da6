"""The embeddings as recording files of vendors' formats, written by Spark into the shared folder.

Twenty vectors are a recording: each gives 8 samples of 8 channels and a mark of its label. Numbers of recordings choose the
layout, so that all are written: the matrix beside the header or inside it, sample by sample or channel by channel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.plans import tables as T
from wavemill.plans.shared import shared_dir
from wavemill.sources import decoders, recordings, vendor

VECTORS, CHANNELS, STEPS = 20, 8, 8
NAMES = [f"C{k}" for k in range(CHANNELS)]

SQL = f"""v AS (SELECT lpad(CAST(vec_id // {VECTORS} AS VARCHAR), 6, '0') AS subject, vec_id, label, embedding,
  row_number() OVER (PARTITION BY vec_id // {VECTORS} ORDER BY vec_id) - 1 AS k FROM embeddings WHERE len(embedding) = {CHANNELS * STEPS})"""


def _encoded(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, bytes]] = []
            for subject, vectors in zip(batch.column("subject").to_pylist(), batch.column("vectors").to_pylist()):
                x = np.concatenate([np.array(v["embedding"], "f4").reshape(CHANNELS, STEPS) for v in vectors], axis=1)
                marks = [(k * STEPS, str(v["label"])) for k, v in enumerate(vectors)]
                odd = int(subject) % 2 == 1
                if kind == "set":
                    files = vendor.encode_set(x, NAMES, 64.0, odd, marks)
                elif kind == "cdt":
                    files = vendor.encode_cdt(x, NAMES, 64.0, odd, marks)
                elif kind == "cnt":
                    files = {".cnt": decoders.encode_cnt(x * 1e6, NAMES, 64, 1 + int(subject) % 3, [(k, int(code)) for k, code in marks])}
                else:
                    files = {".raw": decoders.encode_simple_binary([(code, x[:, k : k + STEPS]) for k, code in marks], 64)}
                out += [(f"sub-{subject}_task-rest{ext}", data) for ext, data in files.items()]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.string()), pa.array([c for _, c in out], pa.binary())], names=["name", "content"])

    return run


def write(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """Write all recordings as files of a kind (set, cdt, cnt or raw); gives the folder."""
    rows = T.read(spark, sf_dir, "embeddings").where(F.size("embedding") == CHANNELS * STEPS)
    subject = F.lpad(F.floor(F.col("vec_id") / VECTORS).cast("string"), 6, "0")
    grouped = rows.groupBy(subject.alias("subject")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "label", "embedding"))).alias("vectors"))
    folder = shared_dir(spark, f"{kind}-files")
    vendor.write_files(grouped.mapInArrow(_encoded(kind), "name string, content binary"), folder)
    return folder


def samples(spark: SparkSession, sf_dir: str, kind: str, range_bytes: int = 4096) -> DataFrame:
    """subject, task, ch, n, uv (microvolts) of the files, each matrix read by several tasks."""
    pieces = vendor.read_files(spark, write(spark, sf_dir, kind), range_bytes=range_bytes)
    return vendor.samples_of(pieces).withColumn("uv", F.col("x") * 1e6)


def marks(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return vendor.read_files(spark, write(spark, sf_dir, kind), content="marks")


def single_samples(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """As ``samples``, of recordings of one file each."""
    packed = recordings.load_recordings(spark, write(spark, sf_dir, kind)).where("error is null")
    return packed.select("subject", "task", "ch", F.posexplode("xs").alias("n", "x")).withColumn("n", F.col("n").cast("long")).withColumn("uv", F.col("x") * 1e6)


def single_marks(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return recordings.load_marks(spark, write(spark, sf_dir, kind))
