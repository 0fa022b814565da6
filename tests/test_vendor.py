"""The MAT container, and recordings in pairs of files read in byte ranges."""

import struct
import zlib

import numpy as np
import pytest

from wavemill.sources import mat5, recordings, vendor


@pytest.mark.parametrize("deflated", [True, False])
def test_container_round_trip(deflated):
    x = np.arange(6, dtype="f4").reshape(2, 3)
    value = {"a": x, "name": "Ébc", "cell": ["x", np.array([[1.0]])], "rows": [{"k": 1.0, "t": "one"}, {"k": 2.0, "t": ""}], "i": np.array([[3, -4]], "i2")}
    got = mat5.read(mat5.write({"v": value, "w": 5.0}, deflated))
    v = got["v"][0]
    assert np.array_equal(v["a"], x) and v["a"].dtype == np.dtype("<f4")
    assert v["name"] == "Ébc" and v["cell"][0] == "x" and v["cell"][1].item() == 1
    assert [(r["k"].item(), r["t"]) for r in v["rows"]] == [(1, "one"), (2, "")]
    assert v["i"].tolist() == [[3, -4]] and got["w"].item() == 5


def test_container_in_the_other_byte_order_and_small_elements():
    element = lambda kind, data: struct.pack(">II", kind, len(data)) + data + b"\0" * (-len(data) % 8)
    small = lambda kind, data: struct.pack(">HH", len(data), kind) + data.ljust(4, b"\0")
    body = element(6, struct.pack(">II", 6, 0)) + element(5, struct.pack(">ii", 1, 3)) + small(1, b"v") + small(2, bytes([7, 8, 9]))
    data = b"text".ljust(124) + struct.pack(">H", 0x0100) + b"MI" + element(14, body)
    assert mat5.read(data)["v"].tolist() == [[7, 8, 9]]


@pytest.mark.parametrize("cut", [0, 50, 127, 140, 200])
def test_damaged_containers(cut):
    whole = mat5.write({"EEG": {"nbchan": 2.0, "data": np.zeros((2, 40))}})
    with pytest.raises(ValueError):
        mat5.read(whole[:cut])
        raise ValueError("an empty container is none of a recording")
    bad = bytearray(whole)
    bad[150] ^= 255
    with pytest.raises(ValueError):
        mat5.read(bytes(bad))
    with pytest.raises(ValueError, match="7.3"):
        mat5.read(b"MATLAB 7.3 MAT-file".ljust(512))
    with pytest.raises(ValueError):
        mat5.read(whole[:128] + struct.pack("<II", 15, 8) + zlib.compress(b"")[:8])


CHANNELS = ["Fz", "Cz", "Pz", "EOG"]


def recording(seed, n):
    return np.random.default_rng(seed).normal(0, 40, (len(CHANNELS), n)).astype("f4")


def put(folder, name, files):
    for ext, data in files.items():
        (folder / f"{name}{ext}").write_bytes(data)


@pytest.fixture
def folder(tmp_path):
    marks = [(3, "stim"), (90, "7")]
    put(tmp_path, "sub-001_task-rest", vendor.encode_set(recording(1, 1000), CHANNELS, 250, False, marks))
    put(tmp_path, "sub-002_task-rest", vendor.encode_set(recording(2, 777), CHANNELS, 500, True))
    (tmp_path / "deep").mkdir()
    put(tmp_path / "deep", "sub-003_task-odor", vendor.encode_cdt(recording(3, 901), CHANNELS, 1000, False, [(5, "9")]))
    put(tmp_path, "sub-004_task-odor", vendor.encode_cdt(recording(4, 650), CHANNELS, 1000, True))
    return tmp_path


def matrices(df):
    """Subject -> channels x samples, in microvolts, whatever the pieces."""
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["subject"], r["ch_idx"], r["n0"])):
        assert r["error"] is None and r["ch"] == CHANNELS[r["ch_idx"]]
        rows = out.setdefault(r["subject"], {}).setdefault(r["ch_idx"], [])
        assert r["n0"] == sum(map(len, rows))
        rows.append(r["xs"])
    return {s: np.array([np.concatenate(rows[k]) for k in sorted(rows)]) * 1e6 for s, rows in out.items()}


@pytest.mark.parametrize("range_bytes", [1 << 20, 4096, 1000, 13])
def test_recordings_whatever_the_ranges(spark, folder, range_bytes):
    df = vendor.read_files(spark, str(folder), range_bytes=range_bytes, subjects=None if range_bytes > 13 else ["004"])
    got = matrices(df)
    for k, n in ((1, 1000), (2, 777), (3, 901), (4, 650)):
        if f"00{k}" in got or range_bytes > 13:
            assert np.allclose(got[f"00{k}"], recording(k, n), rtol=1e-6)
    if range_bytes == 1000:
        assert df.rdd.getNumPartitions() >= 16 + 1 + 15 + 11
    assert {(r["subject"], r["sfreq"]) for r in df.collect()} <= {("001", 250.0), ("002", 500.0), ("003", 1000.0), ("004", 1000.0)}


def test_pruning_before_files_are_opened(spark, folder):
    (folder / "sub-009_task-rest.set").write_bytes(b"no recording")
    assert {r["subject"] for r in vendor.read_files(spark, str(folder), tasks=["odor"]).collect()} == {"003", "004"}
    assert vendor.read_files(spark, str(folder), subjects=[]).count() == 0
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = vendor.read_files(spark, str(folder)).where("subject = '001' and task = 'rest' and ch = 'Cz'")
        assert [(r["subject"], r["ch"]) for r in df.collect()] == [("001", "Cz")]
        assert df.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_damaged_files_say_so(spark, folder):
    whole = vendor.encode_set(recording(5, 300), CHANNELS, 250, False)
    put(folder, "sub-010_task-rest", {".set": whole[".set"][:300], ".fdt": whole[".fdt"]})
    put(folder, "sub-011_task-rest", {".set": whole[".set"], ".fdt": whole[".fdt"][:-7]})
    put(folder, "sub-012_task-rest", {".set": whole[".set"]})
    put(folder, "sub-013_task-rest", {".set": b""})
    good = vendor.encode_cdt(recording(6, 100), CHANNELS, 250, False)
    put(folder, "sub-014_task-rest", {".cdt": good[".cdt"]})
    put(folder, "sub-015_task-rest", {".cdt": good[".cdt"], ".cdt.dpa": b"NumChannels = 4"})
    put(folder, "sub-016_task-rest", {".cdt": good[".cdt"] + b"\0\0\0", ".dpa": good[".cdt.dpa"]})
    rows = vendor.read_files(spark, str(folder), range_bytes=500).where("error is not null").collect()
    said = {r["subject"]: r["error"] for r in rows}
    assert len(rows) == 7 and set(said) == {f"01{k}" for k in range(7)}
    assert "bytes" in said["011"] and "missing" in said["012"] and "missing" in said["014"] and "NumSamples" in said["015"]
    assert len(matrices(vendor.read_files(spark, str(folder)).where("error is null"))) == 4


def test_marks(spark, folder):
    got = sorted(map(tuple, vendor.read_files(spark, str(folder), content="marks").collect()))
    assert got == [("001", "rest", 3, "stim", None), ("001", "rest", 90, "7", None), ("003", "odor", 5, "9", None)]


def test_fields_as_variables_and_epochs(spark, tmp_path):
    x = recording(8, 60).reshape(4, 20, 3, order="F")
    data = mat5.write({"nbchan": 4.0, "pnts": 20.0, "trials": 3.0, "srate": 100.0, "data": x, "chanlocs": np.zeros((0, 0))}, deflated=False)
    (tmp_path / "sub-1_task-a.set").write_bytes(data)
    rows = vendor.read_files(spark, str(tmp_path)).orderBy("ch_idx").collect()
    assert [r["ch"] for r in rows] == ["E1", "E2", "E3", "E4"]
    assert np.allclose(np.array([r["xs"] for r in rows]) * 1e6, recording(8, 60), rtol=1e-6)


def test_one_task_is_loaded_whatever_the_formats(spark, folder):
    (folder / "sub-020_task-rest.txt").write_text("100\nFz,Cz\n1,2\n3,4\n")
    decoders = {**recordings.DECODERS, ".cnt": recordings.decode_text_matrix}
    (folder / "sub-021_task-rest.cnt").write_text("100\nFz,Cz\n1,2\n3,4\n")
    got = recordings.load_task(spark, str(folder), "rest", decoders=decoders).where("error is null").select("subject", "ch", "xs").collect()
    assert sorted((r["subject"], len(r["xs"])) for r in got) == [("001", 1000)] * 4 + [("002", 777)] * 4 + [("021", 2)] * 2
    missing = recordings.load_task(spark, str(folder), "rest", ["002", "077"]).where("error is not null").collect()
    assert [(r["subject"], r["error"]) for r in missing] == [("077", "no file")]
