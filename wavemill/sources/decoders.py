"""Decoders of vendors' binary recordings: bytes -> (sampling rate, channel names, channels x samples in volts).

Each takes one whole file, as a recording is one array; Spark deals files to tasks. A file that is cut off or is of
another layout raises ValueError, which ``recordings.load_recordings`` turns into a row that says so.

continuous ``.cnt``  little-endian; 900 bytes of setup, 75 bytes for each electrode, then 16-bit or 32-bit counts, sample
                     by sample or in blocks of one channel; counts become microvolts by each electrode's baseline,
                     sensitivity and calibration.
simple binary ``.raw``  big-endian; a header, the codes of the event channels, then samples of 16-bit counts, 32-bit or
                     64-bit floats; event channels follow the electrodes under their codes and keep their values. Odd
                     versions are cut in segments with categories, which are put one behind the other.

``marks_cnt`` and ``marks_simple_binary`` read the marks of the same files.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

Decoded = tuple[float, list[str], np.ndarray]

#: Offsets in the setup and electrode blocks of a .cnt file.
CNT_SETUP, CNT_ELECTRODE = 900, 75
CNT_CHANNELS, CNT_RATE, CNT_SAMPLES, CNT_EVENTS, CNT_BLOCK = 370, 376, 864, 886, 894
CNT_BASELINE, CNT_SENSITIVITY, CNT_CALIBRATION = 47, 59, 71
CNT_COUNTS = 204.8
#: Bytes of an entry of a .cnt event table by its kind, and of the table's head. Entries begin with a code of
#: 16 bits and have at byte 4 the place: a byte of the file, in kind 3 a sample.
CNT_ENTRY, CNT_TABLE = {1: 8, 2: 19, 3: 19}, 9
#: Sample types of a simple binary file by its version; the next odd version is the same, cut in segments.
RAW_TYPES = {2: ">i2", 4: ">f4", 6: ">f8"}
#: Where categories or the number of samples begin, and bytes at the head of a segment.
RAW_CUT, RAW_SEGMENT = 30, 6


def _at(data: bytes, kind: str, offset: int, count: int = 1) -> list:
    if offset + np.dtype(kind).itemsize * count > len(data):
        raise ValueError("file is too short for its header")
    return np.frombuffer(data, kind, count, offset).tolist()


def decode_cnt(data: bytes) -> Decoded:
    n, rate = _at(data, "<u2", CNT_CHANNELS)[0], _at(data, "<u2", CNT_RATE)[0]
    samples, events, block = (_at(data, "<i4", k)[0] for k in (CNT_SAMPLES, CNT_EVENTS, CNT_BLOCK))
    if not n or not rate:
        raise ValueError("no channels or no sampling rate")
    start = CNT_SETUP + CNT_ELECTRODE * n
    end = events if start <= events <= len(data) else len(data)
    width = 4 if samples > 0 and end - start == 4 * n * samples else 2
    names, scale, base = [], [], []
    for k in range(CNT_SETUP, start, CNT_ELECTRODE):
        base.append(_at(data, "<i2", k + CNT_BASELINE)[0])
        scale.append(_at(data, "<f4", k + CNT_SENSITIVITY)[0] * _at(data, "<f4", k + CNT_CALIBRATION)[0] / CNT_COUNTS)
        names.append(data[k : k + 10].split(b"\0")[0].decode("latin-1").strip())
    run = max(1, block // width)
    counts = np.frombuffer(data, f"<i{width}", (end - start) // (width * n * run) * n * run, start)
    x = counts.reshape(-1, n, run).transpose(1, 0, 2).reshape(n, -1).astype(float)
    return float(rate), names, (x - np.array(base)[:, None]) * np.array(scale)[:, None] * 1e-6


def marks_cnt(data: bytes) -> list[tuple[int, str]]:
    """(sample, code) of each entry of a .cnt file's event table, in its order; a table of another kind raises."""
    n, events = _at(data, "<u2", CNT_CHANNELS)[0], _at(data, "<i4", CNT_EVENTS)[0]
    samples = _at(data, "<i4", CNT_SAMPLES)[0]
    start = CNT_SETUP + CNT_ELECTRODE * n
    if not n:
        raise ValueError("no channels")
    if not start <= events < len(data):
        return []
    kind, size = _at(data, "u1", events)[0], _at(data, "<i4", events + 1)[0]
    if kind not in CNT_ENTRY:
        raise ValueError(f"event table of kind {kind}")
    if size < 0 or events + CNT_TABLE + size > len(data):
        raise ValueError("event table is cut off")
    layout = np.dtype({"names": ["code", "place"], "formats": ["<u2", "<i4"], "offsets": [0, 4], "itemsize": CNT_ENTRY[kind]})
    table = np.frombuffer(data, layout, size // layout.itemsize, events + CNT_TABLE)
    width = 4 if samples > 0 and events - start == 4 * n * samples else 2
    at = table["place"].astype(np.int64)
    at = at if kind == 3 else (at - start) // (width * n)
    return list(zip(at.tolist(), (str(c) for c in table["code"])))


@dataclass
class _Binary:
    """The header of a simple binary file and its segments: channels x samples each, with their categories."""

    rate: int
    electrodes: int
    codes: list[str]
    segments: list[tuple[str | None, np.ndarray]]


def _simple_binary(data: bytes) -> _Binary:
    version = _at(data, ">i4", 0)[0]
    if version & ~1 not in RAW_TYPES:
        raise ValueError(f"version {version} is no simple binary file")
    kind, at, cut = np.dtype(RAW_TYPES[version & ~1]), RAW_CUT, version % 2 == 1
    rate, n, _, bits, span = _at(data, ">i2", 20, 5)
    categories: list[str] = []
    count = 1
    if cut:
        at += 2
        for _ in range(_at(data, ">i2", at - 2)[0]):
            length = _at(data, "u1", at)[0]
            categories.append(bytes(_at(data, "u1", at + 1, length)).decode("latin-1").strip())
            at += 1 + length
        count = _at(data, ">i2", at)[0]
        at += 2
    samples, events = _at(data, ">i4", at)[0], _at(data, ">i2", at + 4)[0]
    if n <= 0 or rate <= 0 or samples < 0 or events < 0 or count < 0:
        raise ValueError("no channels or no sampling rate")
    at += 6
    codes = [data[k : k + 4].decode("latin-1").strip() for k in range(at, at + 4 * events, 4)]
    at += 4 * events
    size, head = samples * (n + events), RAW_SEGMENT if cut else 0
    if len(data) < at + count * (head + size * kind.itemsize):
        raise ValueError("file is cut off")
    segments = []
    for _ in range(count):
        name = None
        if cut:
            k = _at(data, ">i2", at)[0]
            if not 1 <= k <= len(categories):
                raise ValueError(f"segment of category {k} of {len(categories)}")
            name = categories[k - 1]
        x = np.frombuffer(data, kind, size, at + head).reshape(samples, n + events).T.astype(float)
        x[:n] *= (span / 2.0**bits if bits and span else 1.0) * 1e-6
        segments.append((name, x))
        at += head + size * kind.itemsize
    return _Binary(rate, n, codes, segments)


def decode_simple_binary(data: bytes) -> Decoded:
    b = _simple_binary(data)
    x = np.concatenate([x for _, x in b.segments], axis=1) if b.segments else np.zeros((b.electrodes + len(b.codes), 0))
    return float(b.rate), [f"E{k + 1}" for k in range(b.electrodes)] + b.codes, x


def marks_simple_binary(data: bytes) -> list[tuple[int, str]]:
    """(sample, code) where a segment begins, under its category, and where an event channel leaves zero, by sample; samples
    count through all segments."""
    b = _simple_binary(data)
    out, before = [], 0
    for name, x in b.segments:
        out += [(before, name)] if name is not None else []
        for code, v in zip(b.codes, x[b.electrodes :] != 0):
            out += [(before + int(k), code) for k in np.flatnonzero(v & ~np.concatenate([[False], v[:-1]]))]
        before += x.shape[1]
    return sorted(out, key=lambda m: m[0])


# ---- encoders: what a recording looks like in these formats --------------------------------------------------------------


def encode_cnt(x: np.ndarray, channels: list[str], sfreq: int, kind: int, marks: list[tuple[int, int]] = ()) -> bytes:
    """A continuous .cnt file of whole microvolts (channels x samples) in 32 bits, with an event table of a kind."""
    n, samples = x.shape
    start = CNT_SETUP + CNT_ELECTRODE * n
    events = start + 4 * x.size
    head = bytearray(start)
    for form, place, value in (("<H", CNT_CHANNELS, n), ("<H", CNT_RATE, sfreq), ("<i", CNT_SAMPLES, samples), ("<i", CNT_EVENTS, events)):
        struct.pack_into(form, head, place, value)
    for k, name in enumerate(channels):
        at = CNT_SETUP + CNT_ELECTRODE * k
        struct.pack_into("<10s", head, at, name.encode("latin-1"))
        struct.pack_into("<f", head, at + CNT_SENSITIVITY, CNT_COUNTS)
        struct.pack_into("<f", head, at + CNT_CALIBRATION, 1.0)
    entries = [struct.pack("<HBBi", code, 0, 0, k if kind == 3 else start + 4 * n * k).ljust(CNT_ENTRY[kind], b"\0") for k, code in marks]
    table = struct.pack("<Bii", kind, sum(map(len, entries)), 0) + b"".join(entries)
    return bytes(head) + np.rint(x).T.astype("<i4").tobytes() + table


def encode_simple_binary(segments: list[tuple[str, np.ndarray]], sfreq: int) -> bytes:
    """A simple binary file (version 5: floats, in segments of one length) of named segments in microvolts."""
    names = sorted({name for name, _ in segments})
    n, samples = segments[0][1].shape
    head = struct.pack(">i6hi5h", 5, 2000, 1, 1, 0, 0, 0, 0, sfreq, n, 1, 0, 0)
    head += struct.pack(">h", len(names)) + b"".join(bytes([len(c.encode("latin-1"))]) + c.encode("latin-1") for c in names)
    head += struct.pack(">hih", len(segments), samples, 0)
    return head + b"".join(struct.pack(">hi", names.index(c) + 1, 0) + x.T.astype(">f4").tobytes() for c, x in segments)
