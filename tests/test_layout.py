"""Sidecars of a dataset tree, merged key by key from the root down."""

import json

from wavemill.sources import layout

FILES = {
    "task-rest_eeg.json": {"rate": 250, "ref": "Cz", "line": 50},
    "eeg.json": {"maker": "x", "line": 60},
    "sub-1/sub-1_eeg.json": {"ref": "Fz"},
    "sub-1/eeg/sub-1_task-rest_eeg.json": {"rate": 500, "gain": None},
    "sub-1/eeg/task-rest_eeg.json": {"rate": 400, "gain": 2},
    "sub-2/sub-1_eeg.json": {"ref": "wrong folder"},
    "sub-2/sub-2_task-odor_eeg.json": {"ref": "wrong task"},
    "task-rest_meg.json": {"ref": "wrong suffix"},
    "sub-2/broken_eeg.json": None,
}
DATA = ["sub-1/eeg/sub-1_task-rest_eeg.set", "sub-1/eeg/sub-1_task-odor_eeg.set", "sub-2/eeg/sub-2_task-rest_eeg.set", "README", "sub-2/x_", None]


def frame(spark, more=()):
    rows = [(p, "no json" if v is None else json.dumps(v), 1) for p, v in FILES.items()] + [(p, None, 1) for p in DATA] + [(DATA[0], None, 2)] + [(p, None, 1) for p in more]
    return spark.createDataFrame(rows, "path string, content string, folder int")


def test_metadata(spark):
    got = {}
    for r in layout.metadata(frame(spark).drop("folder")).collect():
        got.setdefault(r["path"], {})[r["key"]] = (r["value"], r["side"])
    one, odor, two = DATA[:3]
    assert set(got) == {one, odor, two}
    assert got[one] == {
        "rate": ("500", "sub-1/eeg/sub-1_task-rest_eeg.json"), "gain": ("2", "sub-1/eeg/task-rest_eeg.json"), "ref": ("Fz", "sub-1/sub-1_eeg.json"),
        "line": ("50", "task-rest_eeg.json"), "maker": ("x", "eeg.json"),
    }
    assert got[odor] == {"ref": ("Fz", "sub-1/sub-1_eeg.json"), "line": ("60", "eeg.json"), "maker": ("x", "eeg.json")}
    assert {k: v[0] for k, v in got[two].items()} == {"rate": "250", "ref": "Cz", "line": "50", "maker": "x"}


def test_event_tables(spark):
    more = ["task-rest_events.tsv", "sub-1/sub-1_events.tsv", "sub-1/eeg/sub-1_task-odor_events.tsv"]
    got = {r["path"]: r["side"] for r in layout.event_tables(frame(spark, more).drop("folder")).collect()}
    assert got == {DATA[0]: "sub-1/sub-1_events.tsv", DATA[1]: "sub-1/eeg/sub-1_task-odor_events.tsv", DATA[2]: "task-rest_events.tsv"}


def test_empty_tree(spark):
    empty = spark.createDataFrame([], "path string, content string")
    assert layout.metadata(empty).count() == 0 and layout.event_tables(empty).count() == 0


def test_sidecars_of_one_folder_meet_their_own_files_only(spark):
    """A folder with a sidecar for each of its files: as many candidates as pairs, not files times sidecars."""
    rows = [(f"sub-1/sub-1_run-{i}_eeg{ext}", '{"gain": 1}' if ext == ".json" else None) for i in range(60) for ext in (".set", ".json")]
    files = spark.createDataFrame([*rows, ("sub-1/run-1_run-2_eeg.set", None), ("eeg.json", '{"line": 50}')], "path string, content string")
    known = layout._once(files)
    assert layout._candidates(known.where("ext <> '.json'"), known.where("ext = '.json'"), True).count() == 60 + 2 + 61  # a file of two runs may meet the sidecars of both
    got = {(r["path"], r["key"], r["side"]) for r in layout.metadata(files).collect()}
    own = {(f"sub-1/sub-1_run-{i}_eeg.set", "gain", f"sub-1/sub-1_run-{i}_eeg.json") for i in range(60)}
    assert got == own | {(p, "line", "eeg.json") for p, c in rows if c is None} | {("sub-1/run-1_run-2_eeg.set", "line", "eeg.json")}
