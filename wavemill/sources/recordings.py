"""Recordings, questionnaires and results on disk: manifests, readers, a generator of test signals, and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.sources import vendor
from wavemill.sources.decoders import decode_cnt, decode_simple_binary, marks_cnt, marks_simple_binary

#: Recording formats in order of preference, and the extensions of their files.
FORMATS = [("neuroscan", 0, ".cnt"), ("eeglab", 1, ".set"), ("eeglab", 1, ".fdt"), ("curry", 2, ".cdt"), ("curry", 2, ".dpa"), ("egi", 3, ".raw")]
INSTRUMENTS = ("ftnd", "bis11")
#: Formats that ``vendor`` reads.
PAIRS = ("eeglab", "curry")


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMATS, "format string, priority int, ext string")


def subject_of(name: Column) -> Column:
    """The id in a file name: its extension is taken off, and the first part between underscores that begins with sub-
    gives the rest of that part; null without such a part."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return F.nullif(F.regexp_extract(stem, "(?:^|_)sub-([^_]*)", 1), F.lit(""))


def task_of(name: Column) -> Column:
    return F.nullif(F.regexp_extract(F.regexp_replace(name, r"\.[^.]*$", ""), "(?:^|_)task-(.*)$", 1), F.lit(""))


def extension_of(name: Column) -> Column:
    return F.regexp_extract(name, r"(\.[^.]*)$", 1)


def manifest(names: DataFrame, column: str = "name") -> DataFrame:
    """File names to (name, subject, task, ext, format, priority); files of no known format go."""
    rows = names.select(F.col(column).alias("name"), subject_of(F.col(column)).alias("subject"), task_of(F.col(column)).alias("task"), extension_of(F.col(column)).alias("ext"))
    return rows.join(F.broadcast(formats(names.sparkSession)), "ext")


def scan_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest of a folder tree; contents aren't read. A missing folder raises."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.col("length").alias("bytes"))
    return manifest(files).join(files, "name")


def list_subjects(files: DataFrame, task: str | None = None) -> DataFrame:
    rows = files.where(F.col("subject").isNotNull())
    return (rows if task is None else rows.where(F.col("task") == task)).select("subject").distinct().orderBy("subject")


def find_file(files: DataFrame) -> DataFrame:
    """The file of each subject and task: the first by format, then extension, then name."""
    best = F.min(F.struct("priority", "ext", "name", "format")).alias("f")
    return files.where(F.col("subject").isNotNull()).groupBy("subject", "task").agg(best).select("subject", "task", "f.format", "f.name")


def detect_format(files: DataFrame) -> DataFrame:
    return find_file(files).select("subject", "task", "format")


Decoder = Callable[[bytes], tuple[float, list[str], np.ndarray]]
#: Decoders by extension: bytes -> (sampling rate, channel names, channels x samples). More may be plugged in.
DECODERS: dict[str, Decoder] = {".cnt": decode_cnt, ".raw": decode_simple_binary}


def decode_text_matrix(data: bytes) -> tuple[float, list[str], np.ndarray]:
    """A plain recording: first line the sampling rate, second the channels, then one line of numbers for each sample."""
    lines = data.decode().splitlines()
    return float(lines[0]), lines[1].split(","), np.array([[float(v) for v in x.split(",")] for x in lines[2:] if x]).T.reshape(len(lines[1].split(",")), -1)


DECODERS[".txt"] = decode_text_matrix


def _decoded(files: DataFrame, table: dict[str, Decoder]) -> DataFrame:
    """Files (name, content) as packed channels."""
    rows = files.select(subject_of(F.col("name")).alias("subject"), task_of(F.col("name")).alias("task"), extension_of(F.col("name")).alias("ext"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for subject, task, ext, content in zip(*(batch.column(c).to_pylist() for c in ("subject", "task", "ext", "content"))):
                try:
                    if ext not in table:
                        raise ValueError(f"no decoder for {ext}")
                    fs, names, x = table[ext](content)
                    out = [(subject, task, i, ch, fs, x[i].tolist(), None) for i, ch in enumerate(names)]
                except (ValueError, IndexError, UnicodeDecodeError) as e:
                    out = [(subject, task, None, None, None, None, str(e))]
                kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.list_(pa.float64()), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["subject", "task", "ch_idx", "ch", "sfreq", "xs", "error"])

    return rows.mapInArrow(run, PACKED)


#: The schema of recordings read from files.
PACKED = "subject string, task string, ch_idx int, ch string, sfreq double, xs array<double>, error string"


def load_recordings(spark: SparkSession, paths: str | list[str], decoders: dict[str, Decoder] | None = None) -> DataFrame:
    """Packed channels (subject, task, ch_idx, ch, sfreq, xs, error) of recording files; a file that can't be decoded
    gives one row that says why, so one bad file doesn't stop a load; an empty file, which Spark hands to no task, gives none."""
    files = spark.read.format("binaryFile").load(paths).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "content")
    return _decoded(files, decoders or DECODERS)


#: Readers of marks by extension: bytes -> (sample, code).
MARK_DECODERS: dict[str, Callable[[bytes], list[tuple[int, str]]]] = {".cnt": marks_cnt, ".raw": marks_simple_binary}


def load_marks(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Marks (subject, task, sample, kind, error) of recording files of one file each; a file whose marks can't be read gives
    one row that says why, one without marks none, and so does an empty file, which Spark hands to no task. Marks of pairs of files: ``vendor.read_files``."""
    files = spark.read.format("binaryFile").load(paths).select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "content")
    rows = files.select(subject_of(F.col("name")).alias("subject"), task_of(F.col("name")).alias("task"), extension_of(F.col("name")).alias("ext"), "content")
    names, kinds = ["subject", "task", "sample", "kind", "error"], [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for subject, task, ext, content in zip(*(batch.column(c).to_pylist() for c in ("subject", "task", "ext", "content"))):
                try:
                    if ext not in MARK_DECODERS:
                        raise ValueError(f"no marks in {ext}")
                    out = [(subject, task, k, code, None) for k, code in MARK_DECODERS[ext](content)]
                except (ValueError, IndexError, UnicodeDecodeError) as e:
                    out = [(subject, task, None, None, str(e))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    return rows.mapInArrow(run, vendor.MARKS)


def whole_channels(pieces: DataFrame) -> DataFrame:
    """Pieces of channels (``vendor.PIECES``) put together as ``load_recordings`` gives them; a channel is one row."""
    rows = pieces.groupBy("subject", "task", "ch_idx", "ch", "sfreq", "error").agg(F.array_sort(F.collect_list(F.struct("n0", "xs"))).alias("p"))
    return rows.select("subject", "task", "ch_idx", "ch", "sfreq", F.when(F.col("error").isNull(), F.flatten("p.xs")).alias("xs"), "error")


def load_task(spark: SparkSession, folder: str, task: str, subjects: list[str] | None = None, decoders: dict[str, Decoder] | None = None) -> DataFrame:
    """One task's recordings of all subjects, or of those named, as ``load_recordings`` gives them: of each subject the
    format that ``find_file`` takes. Files of other tasks aren't opened. Pairs of files (.set with .fdt, .cdt with .dpa) are
    read by ``vendor`` in byte ranges. A file that can't be decoded and a named subject without a file give one row each that
    says so."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*task-{task}.*").load(folder)
    files = found.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "content")
    chosen = find_file(manifest(files.select("name"))).where(F.col("task") == task)
    missing = None
    if subjects is not None:
        wanted = spark.createDataFrame([(s,) for s in subjects], "subject string").distinct()
        chosen = chosen.join(wanted, "subject", "left_semi")
        nothing = [F.lit(None).cast(k).alias(c) for c, k in (("ch_idx", "int"), ("ch", "string"), ("sfreq", "double"), ("xs", "array<double>"))]
        missing = wanted.join(chosen, "subject", "left_anti").select("subject", F.lit(task).alias("task"), *nothing, F.lit("no file").alias("error"))
    pairs = F.col("format").isin(*PAIRS)
    single = _decoded(files.join(chosen.where(~pairs).select("name"), "name", "left_semi"), decoders or DECODERS)
    paired = vendor.read_files(spark, folder, subjects, [task]).join(chosen.where(pairs).select("subject"), "subject", "left_semi")
    out = single.unionByName(whole_channels(paired))
    return out if missing is None else out.unionByName(missing)


def recording_info(samples: DataFrame, sfreq: float) -> DataFrame:
    """Channels, samples and duration (the last sample's time) of each recording."""
    return samples.groupBy("subject").agg(F.countDistinct("ch").alias("n_channels"), (F.max("n") + 1).alias("n_samples"), (F.max("n") / F.lit(sfreq)).alias("duration"), F.array_join(F.array_sort(F.collect_set("ch")), ",").alias("channels"))


def questionnaires(spark: SparkSession, folder: str, instrument: str) -> DataFrame:
    """All subjects' answers to an instrument, with the subject of each file."""
    if instrument not in INSTRUMENTS:
        raise ValueError(f"unknown questionnaire {instrument}")
    rows = spark.read.option("header", "true").option("inferSchema", "true").csv(f"{folder}/sub-*_{instrument}.csv")
    return rows.withColumn("subject", subject_of(F.regexp_extract(F.input_file_name(), "([^/]*)$", 1)))


def synthetic(spark: SparkSession, subjects: int = 3, seconds: int = 10, channels: int = 64, sfreq: int = 1000, seed: int = 42) -> DataFrame:
    """Samples of 10, 20 and 6 Hz sines with noise shared by the channels and noise of their own, made on the executors."""
    t = F.col("n") / F.lit(float(sfreq))
    unit = lambda *k: (F.pmod(F.xxhash64(*k, F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = lambda a, b: F.sqrt(-2 * F.ln(a)) * F.cos(2 * np.pi * b)
    wave = F.sin(2 * np.pi * 10 * t) + 0.5 * F.sin(2 * np.pi * 20 * t) + 0.3 * F.sin(2 * np.pi * 6 * t)
    shared = normal(unit("s", "n", F.lit(1)), unit("s", "n", F.lit(2)))
    own = normal(unit("s", "n", "ch_idx", F.lit(3)), unit("s", "n", "ch_idx", F.lit(4)))
    n_samples = seconds * sfreq
    rows = spark.range(subjects * n_samples).select(F.floor(F.col("id") / n_samples).alias("s"), (F.col("id") % n_samples).alias("n"), F.explode(F.sequence(F.lit(0), F.lit(channels - 1))).alias("ch_idx"))
    return rows.select(F.format_string("sub_%03d", F.col("s") + 1).alias("subject"), F.lit("rest").alias("task"), F.col("ch_idx").cast("int").alias("ch_idx"), F.format_string("EEG%03d", F.col("ch_idx") + 1).alias("ch"), "n", (wave + 0.1 * shared + 0.05 * own).alias("x"))


def synthetic_marks(spark: SparkSession, subjects: int = 3, seconds: int = 180, sfreq: int = 1000, n: int = 30) -> DataFrame:
    """Evenly spaced marks of code 1 from 5 s to 5 s before the end."""
    step = (seconds - 10) / max(1, n - 1)
    rows = spark.range(subjects * n).select(F.floor(F.col("id") / n).alias("s"), (F.col("id") % n).alias("k"))
    return rows.select(F.format_string("sub_%03d", F.col("s") + 1).alias("subject"), F.lit("rest").alias("task"), F.floor((5 + F.col("k") * step) * sfreq).alias("sample"), F.lit(0).alias("prev"), F.lit(1).alias("code"))


def save_samples(samples: DataFrame, path: str) -> None:
    """Samples or epochs by task and subject, so that a reader of one of them prunes the rest."""
    samples.write.mode("overwrite").partitionBy("task", "subject").parquet(path)


def load_samples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_table(table: DataFrame, path: str) -> None:
    """A feature or result table as CSV with a header and as Parquet."""
    table.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    table.write.mode("overwrite").parquet(f"{path}/parquet")


def load_table(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A table that ``save_table`` wrote, from its Parquet or its CSV side; of CSV the columns' kinds are found anew."""
    if kind == "csv":
        return spark.read.option("header", "true").option("inferSchema", "true").csv(f"{path}/csv")
    return spark.read.parquet(f"{path}/parquet")
