"""Recordings in pairs of files, as a Python data source: ``.set`` with ``.fdt``, and ``.cdt`` with ``.dpa``.

The matrix file of a pair is read in byte ranges, each by its own task, so a recording of any length is spread over the
cluster; a task first reads the small header file and keeps the frames that begin in its range. A ``.set`` file that holds its
matrix itself is deflated as one stream and so is one task's work. Files are opened by pyarrow, which reads what it has a
file system for (local or mounted folders, S3, GCS, HDFS).

    spark.dataSource.register(RecordingFiles)
    spark.read.format("recordings").option("path", folder).load()

Rows are pieces of channels (``PIECES``): ``xs`` in volts from sample ``n0`` on. A file that can't be read gives one row that says
why in ``error``; a recording without samples gives none. Files are pruned before any is opened by the options ``subjects`` and ``tasks``
(comma-separated), and by filters subject = ... and task = ... where spark.sql.python.filterPushdown.enabled is set and the
option ``pushdown`` is true. With the option ``content`` = marks, rows are the event tables (``MARKS``) instead.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, InputPartition, WriterCommitMessage

from wavemill.sources import mat5

PIECES = "subject string, task string, ch_idx int, ch string, sfreq double, n0 long, xs array<double>, error string"
MARKS = "subject string, task string, sample long, kind string, error string"
#: Bytes of a matrix file for one task, and samples of one row.
RANGE_BYTES, ROW_SAMPLES = 32 << 20, 1 << 16
_PIECE_KINDS = pa.schema(
    [("subject", pa.string()), ("task", pa.string()), ("ch_idx", pa.int32()), ("ch", pa.string()), ("sfreq", pa.float64()), ("n0", pa.int64()), ("xs", pa.list_(pa.float64())), ("error", pa.string())]
)
_MARK_KINDS = pa.schema([("subject", pa.string()), ("task", pa.string()), ("sample", pa.int64()), ("kind", pa.string()), ("error", pa.string())])
MICRO = 1e-6


def named(name: str) -> tuple[str | None, str | None]:
    """Subject and task of a file name, by the rules of ``recordings.subject_of`` and ``task_of``."""
    stem = re.sub(r"\.[^.]*$", "", name)
    subject, task = re.search(r"(?:^|_)sub-([^_]*)", stem), re.search(r"(?:^|_)task-(.*)$", stem)
    return (subject[1] if subject else "") or None, (task[1] if task else "") or None


@dataclass
class Header:
    """What a header file says: sampling rate, channels, samples, where the matrix is and how it lies."""

    sfreq: float
    channels: list[str]
    samples: int
    scale: np.ndarray
    by_channel: bool = False
    matrix: np.ndarray | None = None
    marks: list[tuple[int, str]] = field(default_factory=list)


# ---- .set ----------------------------------------------------------------------------------------------------------------


def _number(value: object) -> float:
    x = np.asarray(value, float).ravel()
    if len(x) != 1:
        raise ValueError("a number is missing in the header")
    return float(x[0])


def _word(value: object) -> str:
    if isinstance(value, str):
        return value.strip()
    x = np.asarray(value).ravel()
    return f"{x[0]:g}" if len(x) else ""


def set_header(data: bytes) -> Header:
    """Of a .set file, in either layout: all in a struct EEG, or its fields as variables."""
    found = mat5.read(data)
    eeg = found["EEG"][0] if isinstance(found.get("EEG"), list) and found["EEG"] else found
    if "nbchan" not in eeg or "srate" not in eeg:
        raise ValueError("the header names no channels")
    n, sfreq = int(_number(eeg["nbchan"])), _number(eeg["srate"])
    samples = int(_number(eeg["pnts"]) * (_number(eeg["trials"]) if np.size(eeg.get("trials", 1)) else 1))
    if n <= 0 or sfreq <= 0 or samples < 0:
        raise ValueError("no channels or no sampling rate")
    places = eeg.get("chanlocs")
    places = places if isinstance(places, list) else []
    names = [_word(p.get("labels", "")) for p in places[:n]]
    names += [""] * (n - len(names))
    matrix = eeg.get("data")
    if isinstance(matrix, np.ndarray) and matrix.size:
        matrix = matrix.reshape(matrix.shape[0], -1, order="F")
        if matrix.shape != (n, samples):
            raise ValueError(f"the matrix has {matrix.shape[0]} x {matrix.shape[1]} of {n} x {samples} values")
    else:
        matrix = None
    events = eeg.get("event")
    marks = [(int(round(_number(e["latency"]))) - 1, _word(e.get("type", ""))) for e in events if np.size(e.get("latency", ())) == 1] if isinstance(events, list) else []
    return Header(sfreq, [c or f"E{k + 1}" for k, c in enumerate(names)], samples, np.full(n, MICRO), matrix=matrix, marks=marks)


# ---- .dpa ----------------------------------------------------------------------------------------------------------------

_VALUE = re.compile(r"^\s*(\w+)\s*=\s*(\S+)", re.M)
_LIST = re.compile(r"^\s*(\w+)\s+START_LIST[^\n]*\n(.*?)^\s*\1\s+END_LIST", re.M | re.S)
#: Names of the parameter file, and its units in volts.
DPA_SAMPLES, DPA_CHANNELS, DPA_RATE, DPA_PERIOD, DPA_FORMAT, DPA_ORDER, DPA_TRIALS = (
    "NumSamples", "NumChannels", "SampleFreqHz", "SampleTimeUsec", "DataFormat", "DataSampOrder", "NumTrials"
)
DPA_UNITS = {"uV": 1e-6, "fT": 1e-15, "mV": 1e-3, "nV": 1e-9, "V": 1.0}


def dpa_header(data: bytes) -> Header:
    text = data.decode("utf-8", "replace").replace("\r\n", "\n")
    values = dict(_VALUE.findall(text))
    try:
        n, samples = int(values[DPA_CHANNELS]), int(values[DPA_SAMPLES]) * max(1, int(values.get(DPA_TRIALS, 1)))
        sfreq = float(values.get(DPA_RATE, 0)) or 1e6 / float(values[DPA_PERIOD])
    except (KeyError, ZeroDivisionError) as e:
        raise ValueError(f"the parameter file doesn't give {e}") from e
    if n <= 0 or samples < 0 or not sfreq > 0:
        raise ValueError("no channels or no sampling rate")
    if values.get(DPA_FORMAT, "FLOAT").upper().startswith("ASCII"):
        raise ValueError("a text matrix isn't read")
    names: list[str] = []
    for name, body in _LIST.findall(text):
        if name.startswith("LABELS"):
            names += [line.split("#")[0].strip() for line in body.splitlines() if line.strip()]
    names = (names + [f"E{k + 1}" for k in range(len(names), n)])[:n]
    unit = re.search(r"^\s*DataUnit\s*=\s*(\S+)", text, re.M)
    scale = np.full(n, DPA_UNITS.get(unit[1] if unit else "uV", MICRO))
    return Header(sfreq, names, samples, scale, by_channel=values.get(DPA_ORDER, "SAMP").upper().startswith("CHAN"))


def cef_marks(data: bytes) -> list[tuple[int, str]]:
    """Events of a .cef file: the first number of a line is the sample, the third the kind."""
    out = []
    for name, body in _LIST.findall(data.decode("utf-8", "replace").replace("\r\n", "\n")):
        if name.startswith("NUMBER_LIST"):
            out += [(int(float(f[0])), f[2]) for line in body.splitlines() if len(f := line.split()) >= 3]
    return out


# ---- the source ----------------------------------------------------------------------------------------------------------


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if re.match(r"^[a-z][a-z0-9+.-]*:/", uri) else (fs.LocalFileSystem(), os.path.abspath(uri))


def _bytes(uri: str, start: int = 0, end: int | None = None) -> bytes:
    at, path = _store(uri)
    with at.open_input_file(path) as f:
        size = f.size()
        return f.read_at(max(0, (size if end is None else min(end, size)) - start), start)


@dataclass
class Range(InputPartition):
    """Bytes start..end of a recording's matrix file; without one, the whole header file."""

    subject: str | None
    task: str | None
    header: str
    matrix: str | None
    size: int
    start: int
    end: int
    marks: str | None
    error: str | None = None


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.marks = options.get("content", "samples") == "marks"
        self.step = int(options.get("range_bytes", RANGE_BYTES))
        self.wanted = {k: set(options[f"{k}s"].split(",")) for k in ("subject", "task") if options.get(f"{k}s")}

    def _files(self) -> dict[str, int]:
        at, base = _store(self.path)
        scheme = self.path[: self.path.index(":/") + 1] + ("//" if "://" in self.path else "") if re.match(r"^[a-z][a-z0-9+.-]*:/", self.path) else ""
        infos = at.get_file_info(fs.FileSelector(base, recursive=True))
        return {(scheme + i.path if scheme != "file://" else i.path): i.size for i in infos if i.is_file}

    def partitions(self) -> list[Range]:
        files, out = self._files(), []
        for path, size in sorted(files.items()):
            name = path.rsplit("/", 1)[-1]
            stem, _, ext = name.rpartition(".")
            if ext not in ("set", "cdt"):
                continue
            subject, task = named(name)
            if any({"subject": subject, "task": task}[k] not in v for k, v in self.wanted.items()):
                continue
            base = path[: -len(ext) - 1]
            if ext == "set":
                matrix = f"{base}.fdt" if f"{base}.fdt" in files else None
                header, marks, error = path, None, None
            else:
                header = next((p for p in (f"{path}.dpa", f"{base}.dpa", f"{path}.dpo") if p in files), "")
                matrix, marks = path, next((p for p in (f"{path}.cef", f"{base}.cef") if p in files), None)
                error = None if header else "the parameter file is missing"
            whole = files[matrix] if matrix else size
            starts = [0] if self.marks or matrix is None or error else range(0, max(1, whole), self.step)
            out += [Range(subject, task, header, matrix, whole, s, min(whole, s + self.step), marks, error) for s in starts]
        return out

    def read(self, part: Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # nothing is left after pruning
            return
        try:
            if part.error:
                raise ValueError(part.error)
            head = (set_header if part.header.endswith(".set") else dpa_header)(_bytes(part.header))
            if self.marks:
                marks = cef_marks(_bytes(part.marks)) if part.marks else head.marks
                if marks:
                    n = len(marks)
                    yield pa.RecordBatch.from_arrays([pa.array([part.subject] * n), pa.array([part.task] * n, pa.string()), pa.array([m[0] for m in marks], pa.int64()), pa.array([m[1] for m in marks]), pa.nulls(n, pa.string())], schema=_MARK_KINDS)
                return
            yield from self._pieces(part, head)
        except (ValueError, KeyError, IndexError, OSError, UnicodeDecodeError, TypeError) as e:
            if part.start == 0:
                kinds = _MARK_KINDS if self.marks else _PIECE_KINDS
                known = {"subject": part.subject, "task": part.task, "error": str(e) or type(e).__name__}
                yield pa.RecordBatch.from_pylist([{f.name: known.get(f.name) for f in kinds}], schema=kinds)

    def _pieces(self, part: Range, head: Header) -> Iterator[pa.RecordBatch]:
        n = len(head.channels)
        if part.matrix is None:
            if head.matrix is None:
                raise ValueError("the matrix file is missing")
            yield from self._rows(part, head, range(n), 0, head.matrix)
            return
        if part.size != 4 * n * head.samples:
            raise ValueError(f"the matrix file has {part.size} of {4 * n * head.samples} bytes")
        frame = 4 if head.by_channel else 4 * n
        first, last = -(-part.start // frame), -(-part.end // frame)
        if first >= last:
            return
        x = np.frombuffer(_bytes(part.matrix, first * frame, last * frame), "<f4")
        if not head.by_channel:
            yield from self._rows(part, head, range(n), first, x.reshape(-1, n).T)
            return
        while first < last:
            channel, sample = divmod(first, head.samples)
            here = min(last - first, head.samples - sample)
            yield from self._rows(part, head, [channel], sample, x[None, :here])
            x, first = x[here:], first + here

    def _rows(self, part: Range, head: Header, channels, n0: int, x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, x.shape[1], ROW_SAMPLES):
            values = x[:, at : at + ROW_SAMPLES].astype(float) * head.scale[list(channels), None]
            offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
            k = len(values)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part.subject] * k, pa.string()), pa.array([part.task] * k, pa.string()), pa.array(list(channels), pa.int32()), pa.array([head.channels[c] for c in channels]),
                    pa.array([head.sfreq] * k), pa.array([n0 + at] * k, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel())), pa.nulls(k, pa.string()),
                ], schema=_PIECE_KINDS,
            )


class _PruningReader(_Reader):
    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("subject",), ("task",)):
                held = self.wanted.get(f.attribute[0])
                self.wanted[f.attribute[0]] = {f.value} if held is None else held & {f.value}
            else:
                yield f


class _FilesWriter(DataSourceArrowWriter):
    """Writes rows (name, content) as files of a folder; a name is written by one task, so a retry writes the same bytes."""

    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        at, base = _store(self.path)
        at.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                with at.open_output_stream(f"{base}/{name}") as f:
                    f.write(content)
        return WriterCommitMessage()


class RecordingFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return MARKS if self.options.get("content", "samples") == "marks" else PIECES

    def reader(self, schema) -> DataSourceReader:
        return (_PruningReader if self.options.get("pushdown") == "true" else _Reader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _FilesWriter(dict(self.options))


def read_files(spark: SparkSession, path: str, subjects: list[str] | None = None, tasks: list[str] | None = None, content: str = "samples", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Pieces of channels (or marks) of all recordings below a folder, or of the named subjects and tasks."""
    spark.dataSource.register(RecordingFiles)
    reader = spark.read.format("recordings").option("path", path).option("content", content).option("range_bytes", range_bytes)
    reader = reader.option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    for key, values in (("subjects", subjects), ("tasks", tasks)):
        if values is not None:
            reader = reader.option(key, ",".join(values) or "\0")
    return reader.load()


def samples_of(pieces: DataFrame) -> DataFrame:
    """Pieces as long samples (subject, task, ch_idx, ch, n, x); rows of errors go."""
    long = pieces.where("error is null").select("subject", "task", "ch_idx", "ch", "n0", F.posexplode("xs").alias("k", "x"))
    return long.select("subject", "task", "ch_idx", "ch", (F.col("n0") + F.col("k")).alias("n"), "x")


def write_files(files: DataFrame, path: str) -> None:
    """Rows (name, content) as files below a folder that driver and executors share."""
    files.sparkSession.dataSource.register(RecordingFiles)
    files.select(F.col("name").cast("string"), F.col("content").cast("binary")).write.format("recordings").mode("append").save(path)


# ---- encoders: what a recording looks like in these formats --------------------------------------------------------------


def encode_set(x: np.ndarray, channels: list[str], sfreq: float, inside: bool, marks: list[tuple[int, str]] = ()) -> dict[str, bytes]:
    """Extension -> bytes of a recording (channels x samples, in microvolts), the matrix inside the header file or beside it."""
    eeg = {
        "nbchan": float(len(channels)), "pnts": float(x.shape[1]), "trials": 1.0, "srate": float(sfreq), "chanlocs": [{"labels": c} for c in channels],
        "event": [{"latency": float(n + 1), "type": kind} for n, kind in marks], "data": x.astype("f4") if inside else "matrix.fdt",
    }
    return {".set": mat5.write({"EEG": eeg})} | ({} if inside else {".fdt": x.T.astype("<f4").tobytes()})


def encode_cdt(x: np.ndarray, channels: list[str], sfreq: float, by_channel: bool, marks: list[tuple[int, str]] = ()) -> dict[str, bytes]:
    lines = [
        "DATA_PARAMETERS START", f"{DPA_SAMPLES} = {x.shape[1]}", f"{DPA_CHANNELS} = {len(channels)}", f"{DPA_TRIALS} = 1", f"{DPA_RATE} = {sfreq:g}", f"{DPA_FORMAT} = FLOAT",
        f"{DPA_ORDER} = {'CHAN' if by_channel else 'SAMP'}", "DATA_PARAMETERS END", "LABELS START_LIST", *channels, "LABELS END_LIST", "",
    ]
    events = ["NUMBER_LIST START_LIST", *(f"{n} 0 {kind} {n} {n}" for n, kind in marks), "NUMBER_LIST END_LIST", ""]
    matrix = (x if by_channel else x.T).astype("<f4").tobytes()
    return {".cdt": matrix, ".cdt.dpa": "\n".join(lines).encode()} | ({".cdt.cef": "\n".join(events).encode()} if marks else {})
