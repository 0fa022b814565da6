"""Small cases: edges of operators, sources and sinks, configuration, models and streams."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill import config, schema
from wavemill.operators import epochs, erp, evaluation, fusion, graph, kernels, microstates, models, quality
from wavemill.sources import decoders, recordings
from wavemill.streaming import windows


def samples(spark, rows):
    return spark.createDataFrame(rows, "subject string, ch string, n long, x double")


def test_subjects_in_file_names(spark):
    names = [("sub-001_task-resting_state.cnt",), ("sub-001.cnt",), ("invalid_filename.txt",), ("x_sub-7_a.set",)]
    got = spark.createDataFrame(names, "name string").select(recordings.subject_of(F.col("name")), recordings.task_of(F.col("name"))).collect()
    assert [tuple(r) for r in got] == [("001", "resting_state"), ("001", None), (None, None), ("7", None)]


def test_empty_samples_give_no_rows(spark):
    empty = samples(spark, [])
    assert quality.amplitude(empty).count() == 0
    assert quality.validate(empty, 100.0).count() == 0
    assert quality.pass_summary(quality.validate(empty, 100.0)).first()["pass_rate"] == 0.0


def test_validation_names_each_issue(spark):
    flat = samples(spark, [("a", "c1", n, 0.0) for n in range(10)])
    r = quality.validate(flat, 1000.0).first()
    assert not r["passed"] and r["issues"] == ["short recording", "few channels", "flat channels"]
    assert quality.report(quality.validate(flat, 1000.0)).first()["issues"].startswith("short recording; ")
    assert quality.snr(flat).first()["snr"] == float("inf")


def test_constant_channel_has_no_correlation_or_outliers(spark):
    rows = samples(spark, [("a", c, n, 1.0 if c == "k" else float(n)) for c in ("k", "v") for n in range(8)])
    assert quality.gram(rows, ["subject"], "n", "ch", "x").select(quality.pearson().alias("r")).first()["r"] is None
    assert quality.outlier_ratio(rows).first()["outliers"] == 0


def test_epoch_of_a_mark_at_the_edge_is_short_and_flat_ones_go(spark):
    s = samples(spark, [("a", "c", n, float(n % 3)) for n in range(10)])
    marks = spark.createDataFrame([("a", 1, 0, 5), ("a", 5, 0, 5)], "subject string, sample long, prev int, code int")
    cut = epochs.cut(s, marks, -2, 2)
    assert {r["epoch"]: r["count"] for r in cut.groupBy("epoch").count().collect()} == {1: 4, 5: 5}
    assert epochs.drop_bad(cut, 1.0).count() == 0 and epochs.drop_bad(cut, 5.0, 5.0).count() == 0 and epochs.drop_bad(cut, 5.0).count() == 9


def test_first_of_equal_peaks_wins(spark):
    rows = [("s", 1, 1, "Fz", k, 0.08 + 0.01 * k, x) for k, x in enumerate([1.0, -2.0, -2.0, 0.0])]
    ep = spark.createDataFrame(rows, "subject string, epoch long, code int, ch string, k int, t double, x double")
    r = erp.features(ep, erp.components(spark)).where("component = 'N1'").first()
    assert r["amplitude"] == -2.0 and r["latency"] == pytest.approx(0.09) and r["itv"] == 0.0


def test_runs_and_transitions_of_one_sample(spark):
    one = spark.createDataFrame([("a", 0, 2)], "subject string, n long, state int")
    assert microstates.segments(one, 2).count() == 0
    assert microstates.durations(microstates.segments(one, 2), 1.0).count() == 0
    assert microstates.transitions(one, 3).agg(F.sum("p")).first()[0] == 0.0


def test_graph_features_of_disconnected_and_empty_graphs(spark):
    edges = spark.createDataFrame([("a", "1", "2", 0.9), ("a", "1", "3", 0.1), ("a", "2", "3", 0.1)], "subject string, i string, j string, w double")
    nodes, g = graph.nodes_of(edges), graph.build(edges)
    p = graph.paths(g, nodes).first()
    assert not p["is_connected"] and p["average_shortest_path"] is None and p["diameter"] is None
    assert graph.average_clustering(g, nodes).first()[1] == 0.0
    none = graph.build(edges, 2.0)
    assert graph.density(none, nodes).first()["number_of_edges"] == 0
    assert graph.betweenness_centrality(none, nodes).first()[1] == 0.0


def test_imputation_scaling_and_selection_edges(spark):
    long = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, "a", 4.0), (1, "c", 5.0), (2, "c", 5.0)], "id int, name string, value double")
    assert {r["value"] for r in fusion.impute_median(long).where("id = 2 and name = 'a'").collect()} == {2.5}
    assert {r["value"] for r in fusion.scale(long, "standard").where("name = 'c'").collect()} == {0.0}
    assert {r["value"] for r in fusion.scale(long, "minmax").where("name = 'c'").collect()} == {0.0}
    assert fusion.variance_filter(long, 0.1).select("name").distinct().count() == 1
    tie = spark.createDataFrame([("b",), ("a",), (None,)], "v string")
    assert fusion.mode(tie, "v").first()["mode"] == "a"


def test_pipeline_model_is_saved_and_loaded(spark, tmp_path):
    wide = spark.createDataFrame([(i, float(i), float(i * i % 7)) for i in range(20)], "id int, a double, b double")
    model = fusion.fit_pca(wide, ["a", "b"], 1)
    fusion.save(model, str(tmp_path / "m"))
    one = fusion.apply_pca(model, wide, ["id"]).collect()
    assert one == fusion.apply_pca(fusion.load(str(tmp_path / "m")), wide, ["id"]).collect()


def test_folds_are_even_in_each_class(spark):
    rows = spark.range(103).select("id", (F.col("id") % 3).alias("label"))
    n = [r["count"] for r in evaluation.stratified_folds(rows, "id", "label").groupBy("label", "fold").count().collect()]
    assert max(n) - min(n) <= 1


def test_auc_with_ties_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, score double")
    assert evaluation.roc_auc(df).first()["auc"] == pytest.approx(0.875)
    assert evaluation.roc_auc(df.where("label = 1")).first()["auc"] is None


def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(1)
    x, y = r.standard_normal((60, 4)), r.integers(0, 3, 60)
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(60)], "id long, label int, xs array<double>")
    got = {r["id"]: r["prediction"] for r in evaluation.knn(df, df, 5).collect()}
    for i in range(60):
        d = ((x - x[i]) ** 2).sum(axis=1)
        near = [j for j in np.lexsort((np.arange(60), d.round(9))) if j != i][:5]
        votes = np.bincount(y[near], minlength=3)
        assert got[i] == votes.argmax()


def test_models_are_trained_saved_and_loaded(spark, tmp_path):
    r = np.random.default_rng(2)
    x = r.standard_normal((80, 3))
    df = models.vectors(spark.createDataFrame([(i, int(x[i, 0] > 0), x[i].tolist()) for i in range(80)], "id long, label int, xs array<double>"))
    got = models.train_models(df, {"logistic_regression": {}, "no_such_model": {}}, k=3)
    assert got["best"] == "logistic_regression" and "error" in got["models"]["no_such_model"]
    assert models.feature_importance(got["models"]["logistic_regression"]["model"], ["a", "b", "c"])[0][0] == "a"
    models.save_models(got, str(tmp_path / "m"))
    back = models.load_models(str(tmp_path / "m"))
    assert back["best"] == "logistic_regression"
    assert models.evaluate(back["models"]["logistic_regression"]["model"], df).first()["accuracy"] > 0.9
    assert models.permutation_importance(got["models"]["logistic_regression"]["model"], df, 0) > 0.2
    with pytest.raises(ValueError):
        models.create("other")


def test_kernel_machine_and_neighbours_part_a_ring_from_its_middle(spark, tmp_path):
    r = np.random.default_rng(3)
    x = r.standard_normal((160, 2))
    y = ((x**2).sum(axis=1) > 1.2).astype(int)
    df = models.vectors(spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(160)], "id long, label int, xs array<double>"))
    got = models.train_models(df, {"svm": {"C": [10.0], "gamma": ["scale"], "n_features": [100]}, "knn": {"n_neighbors": [3]}, "random_forest": {"n_estimators": [5], "max_depth": [3]}}, k=2)
    assert all("error" not in r for r in got["models"].values()) and all(r["cv_score"] > 0.85 for n, r in got["models"].items() if n != "random_forest")
    linear = models.create("svm", n_rows=160, kernel="linear").fit(df)
    assert models.evaluate(linear, df).first()["accuracy"] < 0.8
    models.save_models(got, str(tmp_path / "m"))
    back = models.load_models(str(tmp_path / "m"))
    for name in ("svm", "knn"):
        one, two = (m["models"][name]["model"].transform(df).select("id", "prediction").collect() for m in (got, back))
        assert sorted(one) == sorted(two)
        assert models.evaluate(back["models"][name]["model"], df).first()["auc"] > 0.9
    with pytest.raises(ValueError):
        models.create("svm", kernel="sigmoid")


def test_random_features_approximate_the_kernel(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.6, 0.2])], "id int, xs array<double>")
    z = {r["id"]: np.array(r["xs"]) for r in models.random_features(df, 4000, 0.5, 2).collect()}
    assert z[0] @ z[1] == pytest.approx(np.exp(-0.5 * 0.4), abs=0.05)


def test_synthetic_recordings_round_trip(spark, tmp_path):
    s = recordings.synthetic(spark, 2, 1, 3, 100)
    recordings.save_samples(s, str(tmp_path / "s"))
    assert recordings.load_samples(spark, str(tmp_path / "s")).where("subject = 'sub_001'").count() == 300
    assert recordings.synthetic_marks(spark, 2).count() == 60
    packed = schema.pack(s, ["subject", "ch"])
    assert schema.unpack(packed, ["subject", "ch"]).count() == 600
    psd = kernels.welch_psd(packed, 100.0, 100)
    peak = psd.groupBy("f_idx").agg(F.avg("p").alias("p")).orderBy(F.desc("p")).first()["f_idx"]
    assert peak == 10


def cnt_file(x, rate, width, block=0, base=3, sensitivity=2.0, calibration=0.5):
    """A continuous .cnt file of whole counts x (channels x samples), with 14 bytes after its samples."""
    n, samples = x.shape
    head, start = bytearray(900 + 75 * n), 900 + 75 * n
    struct.pack_into("<H", head, 370, n)
    struct.pack_into("<H", head, 376, rate)
    struct.pack_into("<iii", head, 864, samples, 0, 0)
    struct.pack_into("<ii", head, 886, start + width * x.size, 0)
    struct.pack_into("<i", head, 894, block * width)
    for k in range(n):
        struct.pack_into("<10s", head, 900 + 75 * k, f"C{k}".encode())
        struct.pack_into("<h", head, 900 + 75 * k + 47, base)
        struct.pack_into("<f", head, 900 + 75 * k + 59, sensitivity)
        struct.pack_into("<f", head, 900 + 75 * k + 71, calibration)
    run = max(1, block)
    return bytes(head) + x.reshape(n, -1, run).transpose(1, 0, 2).astype(f"<i{width}").tobytes() + b"e" * 14


def raw_file(x, marks, rate, version, bits=0, span=0):
    kind = {2: ">i2", 4: ">f4", 6: ">f8"}[version]
    head = struct.pack(">i6hi5hih", version, 2024, 1, 2, 3, 4, 5, 0, rate, len(x), 1, bits, span, x.shape[1], len(marks))
    return head + b"".join(f"{m:4s}".encode() for m in marks) + np.concatenate([x, *([v] for v in marks.values())]).T.astype(kind).tobytes()


@pytest.mark.parametrize("width, block", [(2, 0), (4, 0), (2, 5), (4, 5)])
def test_cnt_counts_become_volts(width, block):
    x = np.random.default_rng(width + block).integers(-3000, 3000, (3, 20))
    rate, names, got = decoders.decode_cnt(cnt_file(x, 250, width, block))
    assert (rate, names) == (250.0, ["C0", "C1", "C2"])
    np.testing.assert_allclose(got, (x - 3) * (1 / 204.8) * 1e-6)


@pytest.mark.parametrize("version", [2, 4, 6])
def test_simple_binary_keeps_event_channels(version):
    x, marks = np.random.default_rng(version).integers(-99, 99, (2, 9)), {"DIN1": np.arange(9) % 2}
    bits, span = (12, 5000) if version == 2 else (0, 0)
    rate, names, got = decoders.decode_simple_binary(raw_file(x, marks, 500, version, bits, span))
    assert (rate, names) == (500.0, ["E1", "E2", "DIN1"])
    np.testing.assert_allclose(got[:2], x * (5000 / 4096 if bits else 1.0) * 1e-6)
    assert got[2].tolist() == marks["DIN1"].tolist()


@pytest.mark.parametrize("decode", [decoders.decode_cnt, decoders.decode_simple_binary])
def test_damaged_recordings_raise(decode):
    whole = raw_file(np.ones((2, 4)), {}, 500, 4)
    for data in (b"", b"\x00", bytes(899), bytes(2000), whole[:-1], struct.pack(">i", 3) + bytes(60)):
        with pytest.raises(ValueError):
            decode(data)


@pytest.mark.parametrize("kind", [1, 2, 3])
def test_event_tables_of_cnt_files(kind):
    x, marks = np.random.default_rng(kind).integers(-99, 99, (3, 20)), [(0, 7), (5, 65535), (5, 1), (19, 0)]
    data = decoders.encode_cnt(x, ["Fz", "Cz", "Pz"], 250, kind, marks)
    assert decoders.marks_cnt(data) == [(k, str(c)) for k, c in marks]
    rate, names, got = decoders.decode_cnt(data)
    assert (rate, names) == (250.0, ["Fz", "Cz", "Pz"])
    np.testing.assert_allclose(got, x * 1e-6)
    assert decoders.marks_cnt(decoders.encode_cnt(x, ["a", "b", "c"], 250, kind)) == []
    start = 900 + 75 * 3 + 4 * x.size
    for bad in (data[:-1], data[: start + 4], data[:start] + b"\x09" + data[start + 1 :], b"", bytes(900)):
        with pytest.raises(ValueError):
            decoders.marks_cnt(bad)


def test_events_of_cnt_files_in_16_bits():
    """Places are bytes of the file, so the width of a sample matters."""
    x = np.arange(12).reshape(2, 6)
    data = bytearray(cnt_file(x, 100, 2))
    start = 900 + 150
    data[start + 24 :] = struct.pack("<Bii", 1, 16, 0) + struct.pack("<HBBi", 3, 0, 0, start + 8) + struct.pack("<HBBi", 4, 0, 0, start + 20)
    assert decoders.marks_cnt(bytes(data)) == [(2, "3"), (5, "4")]


def test_segments_of_simple_binary_files():
    x = np.random.default_rng(0).integers(-99, 99, (2, 12))
    data = decoders.encode_simple_binary([("go", x[:, :4]), ("stop", x[:, 4:8]), ("go", x[:, 8:])], 500)
    rate, names, got = decoders.decode_simple_binary(data)
    assert (rate, names) == (500.0, ["E1", "E2"])
    np.testing.assert_allclose(got, x * 1e-6)
    assert decoders.marks_simple_binary(data) == [(0, "go"), (4, "stop"), (8, "go")]
    for bad in (data[:-1], data[:33], data[:47] + struct.pack(">h", 9) + data[49:], b""):
        with pytest.raises(ValueError):
            decoders.marks_simple_binary(bad)
    whole = raw_file(np.ones((1, 7)), {"DIN1": np.array([1, 1, 0, 0, 2, 0, 3]), "DIN2": np.array([0, 0, 0, 0, 1, 1, 1])}, 500, 4)
    assert decoders.marks_simple_binary(whole) == [(0, "DIN1"), (4, "DIN1"), (4, "DIN2"), (6, "DIN1")]


def test_marks_are_loaded_with_their_failures(spark, tmp_path):
    x = np.arange(6).reshape(2, 3)
    (tmp_path / "sub-1_task-rest.cnt").write_bytes(decoders.encode_cnt(x, ["a", "b"], 100, 1, [(2, 5)]))
    (tmp_path / "sub-2_task-rest.raw").write_bytes(decoders.encode_simple_binary([("go", x), ("go", x)], 100))
    (tmp_path / "sub-3_task-rest.raw").write_bytes(b"\x00")
    (tmp_path / "sub-6_task-rest.raw").write_bytes(b"")  # Spark hands no empty file to a task
    (tmp_path / "sub-4_task-rest.set").write_bytes(b"x")
    (tmp_path / "sub-5_task-rest.cnt").write_bytes(decoders.encode_cnt(x, ["a", "b"], 100, 1))
    got = sorted((r["subject"], r["sample"] or 0, r["kind"], r["error"]) for r in recordings.load_marks(spark, str(tmp_path)).collect())
    assert got == [("1", 2, "5", None), ("2", 0, "go", None), ("2", 3, "go", None), ("3", 0, None, "file is too short for its header"), ("4", 0, None, "no marks in .set")]


def test_a_task_is_loaded_with_its_failures(spark, tmp_path):
    for folder in ("neuroscan", "egi"):
        (tmp_path / folder).mkdir()
    x = np.arange(6).reshape(2, 3)
    (tmp_path / "neuroscan" / "sub-1_task-rest.cnt").write_bytes(cnt_file(x, 100, 2))
    (tmp_path / "egi" / "sub-1_task-rest.raw").write_bytes(raw_file(x, {}, 100, 4))
    (tmp_path / "egi" / "sub-2_task-rest.raw").write_bytes(raw_file(x, {}, 100, 4))
    (tmp_path / "egi" / "sub-3_task-rest.raw").write_bytes(b"\x00")
    (tmp_path / "egi" / "sub-4_task-oddball.raw").write_bytes(raw_file(x, {}, 100, 4))
    everyone = recordings.load_task(spark, str(tmp_path), "rest").collect()
    assert sorted((r["subject"], r["ch"]) for r in everyone if r["error"] is None) == [("1", "C0"), ("1", "C1"), ("2", "E1"), ("2", "E2")]
    assert [(r["subject"], r["error"]) for r in everyone if r["error"]] == [("3", "file is too short for its header")]
    some = recordings.load_task(spark, str(tmp_path), "rest", ["2", "4", "4"]).collect()
    assert sorted((r["subject"], r["ch"] or r["error"]) for r in some) == [("2", "E1"), ("2", "E2"), ("4", "no file")]
    assert recordings.load_task(spark, str(tmp_path), "other").count() == 0


def test_files_that_cannot_be_decoded_say_so(spark, tmp_path):
    (tmp_path / "sub-1_task-rest.txt").write_text("100\na,b\n1,2\n3,4\n")
    (tmp_path / "sub-2_task-rest.cdt").write_bytes(b"\x00")
    got = {(r["subject"], r["ch"]): (r["xs"], r["error"]) for r in recordings.load_recordings(spark, [str(tmp_path)]).collect()}
    assert got[("1", "a")] == ([1.0, 3.0], None) and got[("2", None)][1] == "no decoder for .cdt"
    files = recordings.scan_manifest(spark, str(tmp_path))
    assert files.count() == 1 and recordings.list_subjects(files).first()["subject"] == "2"


def test_questionnaires(spark, tmp_path):
    (tmp_path / "sub-9_ftnd.csv").write_text("total_score\n7\n")
    r = recordings.questionnaires(spark, str(tmp_path), "ftnd").first()
    assert (r["subject"], r["total_score"]) == ("9", 7)
    with pytest.raises(ValueError):
        recordings.questionnaires(spark, str(tmp_path), "other")


def test_tables_are_saved_twice(spark, tmp_path):
    recordings.save_table(spark.range(3), str(tmp_path / "t"))
    assert recordings.load_table(spark, str(tmp_path / "t")).count() == 3
    assert dict(recordings.load_table(spark, str(tmp_path / "t"), "csv").dtypes) == {"id": "int"}


def test_configuration(tmp_path):
    assert config.merge({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 5}, "e": 6}) == {"a": {"b": 5, "c": 2}, "d": 3, "e": 6}
    assert config.numbers({"t": ["100e-6", "None", "x"]}) == {"t": [1e-4, None, "x"]}
    assert config.is_valid({"a": 1}, ["a"], {"a": int}, {"a": (0, 1)}) and not config.is_valid({}, ["a"]) and not config.is_valid({"a": 2}, ranges={"a": (0, 1)})
    assert config.file_megabytes(tmp_path / "none") == 0.0
    assert set(config.make_folders(tmp_path)) == set(config.FOLDERS)
    if config.yaml is not None:
        c = config.Configs(tmp_path / "conf")
        c.save({"limit": 1}, "one")
        assert c.names() == ["one"] and c.get("one") == {"limit": 1} and config.is_yaml(tmp_path / "conf" / "one.yaml")


def test_streams_agree_with_batches(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = windows.read_stream(spark, str(tmp_path / "in"), events.schema).select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("subject"), F.col("event_type").alias("ch"), F.col("value").alias("x"))
    q = windows.sliding_stats(stream).writeStream.format("memory").queryName("sliding").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("sliding").agg(F.sum("n")).first()[0] == 2 * events.count()  # each sample lies in two windows
    q = windows.sessions(stream).writeStream.format("memory").queryName("sessions").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("sessions").agg(F.sum("n")).first()[0] == events.count()


def test_queries_of_models_and_microstates_run_with_full_defaults(spark, data, monkeypatch):
    from wavemill import catalog

    seen = {}

    class Stop(Exception):
        pass

    def cluster(samples, n_states=4, n_init=10, max_iter=1000, seed=42):
        seen["microstates"] = (n_states, n_init, max_iter)
        raise Stop

    def create(name, seed=42, n_rows=None, _create=models.create, **params):
        seen[name] = _create(name, seed, n_rows, **params).getNumTrees()
        raise Stop

    monkeypatch.setattr(microstates, "cluster", cluster)
    monkeypatch.setattr(models, "create", create)
    for name in ("microstate_clusters", "random_forest"):
        with pytest.raises(Stop):
            catalog.QUERIES[name](spark, data)
    assert seen == {"microstates": (4, 10, 1000), "random_forest": 100}


def test_small_utilities(spark, tmp_path):
    import logging

    from wavemill import config
    from wavemill.functions import text

    log = config.set_up_logging("WARNING", str(tmp_path / "run.log"))
    log.warning("said")
    log.info("unsaid")
    logging.shutdown()
    written = (tmp_path / "run.log").read_text()
    assert "said" in written and "unsaid" not in written
    log.handlers[:] = []
    (tmp_path / "wavemill").mkdir()
    (tmp_path / "a" / "b").mkdir(parents=True)
    assert config.project_root(tmp_path / "a" / "b") == tmp_path and config.project_root(tmp_path / "a", "no such folder") == tmp_path / "a"
    assert config.free_gigabytes(tmp_path) > 0
    assert config.is_file(tmp_path / "run.log") and not config.is_file(tmp_path) and not config.is_file(tmp_path / "none")
    stamp = spark.range(1).select(text.run_stamp().alias("t")).first()["t"]
    assert len(stamp) == 15 and stamp[8] == "_" and stamp.replace("_", "").isdigit()


def test_rows_are_numbered_in_order(spark):
    from wavemill.operators.ranks import numbered

    df = spark.range(1000).selectExpr("id", "id % 7 as m").repartition(9)
    got = [r["id"] for r in numbered(df, ["m", "id"]).orderBy("number").collect()]
    assert got == sorted(range(1000), key=lambda k: (k % 7, k))
    assert numbered(df.where("false"), ["id"]).count() == 0
