"""Registry of the library's own queries: name -> (spark, sf_dir) -> DataFrame, and the SQL each must agree with.

Each entry names its columns with their kinds (s text, l integer, d double, b boolean). Both sides are cast to them and
doubles rounded to six places, so that engines that sum in different orders still agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavemill.functions import dsp, text
from wavemill.operators import connectivity, epochs, erp, evaluation, explain, fused, fusion, graph, hmm, ica, kernels, microstates, models, preprocessing, quality, spectral, timefreq
from wavemill.plans import recording_files
from wavemill.plans import tables as T
from wavemill.plans.shared import shared_dir, written
from wavemill.sources import layout, recordings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
#: The survey's operator ids that each query covers.
COVERS: dict[str, str] = {}

_SPARK = {"s": "string", "l": "bigint", "d": "double", "b": "boolean"}
_DUCK = {"s": "VARCHAR", "l": "BIGINT", "d": "DOUBLE", "b": "BOOLEAN"}


def _typed(df: DataFrame, columns: str) -> DataFrame:
    out = []
    for spec in columns.split():
        name, kind = spec.split(":")
        c = F.col(name).cast(_SPARK[kind])
        out.append((F.round(c, 6) + F.lit(0.0) if kind == "d" else c).alias(name))
    return df.select(*out)


def _typed_sql(body: str, columns: str) -> str:
    out = []
    for spec in columns.split():
        name, kind = spec.split(":")
        out.append(f'round(CAST("{name}" AS DOUBLE), 6) + 0.0 AS "{name}"' if kind == "d" else f'CAST("{name}" AS {_DUCK[kind]}) AS "{name}"')
    return f"SELECT {', '.join(out)} FROM ({body}) AS answer"


def register(name: str, covers: str, columns: str, fn: Query, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: _typed(fn(spark, sf_dir), columns)
    COVERS[name] = covers
    if sql is not None:
        ORACLE_SQL[name] = _typed_sql(sql, columns)


# --- sources -------------------------------------------------------------------------------------------------------

_FILES = "files AS (SELECT 'sub-' || lpad(CAST(c_custkey % 997 AS VARCHAR), 3, '0') || '_task-' || lower(c_mktsegment) || ['.cnt','.set','.fdt','.cdt','.dpa','.raw','.csv'][1 + CAST(c_custkey % 7 AS INTEGER)] AS name FROM customer)"
_MANIFEST = f"WITH {_FILES}, m AS (SELECT name, regexp_extract(name, 'sub-([^_]*)_', 1) AS subject, regexp_extract(name, 'task-([^.]*)', 1) AS task, regexp_extract(name, '(\\.[^.]*)$', 1) AS ext FROM files), f(format, priority, ext) AS (VALUES ('neuroscan',0,'.cnt'),('eeglab',1,'.set'),('eeglab',1,'.fdt'),('curry',2,'.cdt'),('curry',2,'.dpa'),('egi',3,'.raw')), man AS (SELECT m.*, f.format, f.priority FROM m JOIN f USING (ext))"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    exts = F.array(*map(F.lit, [".cnt", ".set", ".fdt", ".cdt", ".dpa", ".raw", ".csv"]))
    name = F.concat(F.lit("sub-"), F.lpad((key % 997).cast("string"), 3, "0"), F.lit("_task-"), F.lower("c_mktsegment"), F.get(exts, (key % 7).cast("int")))
    return recordings.manifest(T.read(spark, sf_dir, "customer").select(name.alias("name")))


register("list_subjects", "SRC2 SRC6", "subject:s", lambda s, d: recordings.list_subjects(_files(s, d)), f"{_MANIFEST} SELECT DISTINCT subject FROM man")
register("list_subjects_of_task", "SRC2", "subject:s", lambda s, d: recordings.list_subjects(_files(s, d), "building"), f"{_MANIFEST} SELECT DISTINCT subject FROM man WHERE task = 'building'")
register("manifest", "SRC1 SRC5 SRC6", "name:s subject:s task:s ext:s format:s", lambda s, d: _files(s, d), f"{_MANIFEST} SELECT * FROM man")
register("detect_format", "SRC8", "subject:s task:s format:s", lambda s, d: recordings.detect_format(_files(s, d)), f"{_MANIFEST} SELECT subject, task, format FROM (SELECT *, row_number() OVER (PARTITION BY subject, task ORDER BY priority, ext, name) AS r FROM man) WHERE r = 1")
register("find_file", "SRC7", "subject:s task:s name:s", lambda s, d: recordings.find_file(_files(s, d)), f"{_MANIFEST} SELECT subject, task, name FROM (SELECT *, row_number() OVER (PARTITION BY subject, task ORDER BY priority, ext, name) AS r FROM man) WHERE r = 1")
register("recording_info", "SRC9", "subject:s n_channels:l n_samples:l duration:d channels:s", lambda s, d: recordings.recording_info(T.ev(s, d), 4.0), T.sql("SELECT subject, count(DISTINCT ch) AS n_channels, max(n) + 1 AS n_samples, max(n) / 4.0 AS duration, (SELECT string_agg(c, ',' ORDER BY c) FROM (SELECT DISTINCT e2.ch AS c FROM ev e2 WHERE e2.subject = ev.subject)) AS channels FROM ev GROUP BY subject", "ev"))

_SAMPLES_SQL = f"WITH {recording_files.SQL} SELECT subject, 'rest' AS task, 'C' || (i // 8) AS ch, k * 8 + i % 8 AS n, e AS uv FROM (SELECT subject, k, CAST(unnest(embedding) AS DOUBLE) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM v)"
_MARKS_SQL = f"WITH {recording_files.SQL} SELECT subject, 'rest' AS task, k * 8 AS sample, CAST(label AS VARCHAR) AS kind FROM v"
for _kind, _format, _id in (("set", "eeglab", "SRC3b"), ("cdt", "curry", "SRC3c")):
    register(f"{_format}_files", f"{_id} SRC3", "subject:s task:s ch:s n:l uv:d", lambda s, d, k=_kind: recording_files.samples(s, d, k), _SAMPLES_SQL)
    register(f"{_format}_marks", f"{_id} PRE8", "subject:s task:s sample:l kind:s", lambda s, d, k=_kind: recording_files.marks(s, d, k), _MARKS_SQL)
for _kind, _format, _id in (("cnt", "neuroscan", "SRC3a"), ("raw", "egi", "SRC3d")):
    register(f"{_format}_marks", f"{_id} PRE8", "subject:s task:s sample:l kind:s", lambda s, d, k=_kind: recording_files.single_marks(s, d, k), _MARKS_SQL)
register("egi_files", "SRC3d SRC3", "subject:s task:s ch:s n:l uv:d", lambda s, d: recording_files.single_samples(s, d, "raw"), _SAMPLES_SQL.replace("'C' || (i // 8)", "'E' || (1 + i // 8)"))


def _tree(s: SparkSession, d: str) -> DataFrame:
    """A dataset tree made of the customers: recordings in sessions, sidecars at the root, of subjects and of recordings."""
    c = T.read(s, d, "customer").select(F.concat(F.lit("sub-"), (F.col("c_custkey") % 50).cast("string")).alias("sub"), F.concat(F.lit("ses-"), (F.col("c_custkey") % 3).cast("string")).alias("ses"), F.concat(F.lit("task-"), F.lower("c_mktsegment")).alias("task"), F.col("c_custkey").cast("string").alias("k"), F.col("c_custkey").alias("n"))
    at, name = F.concat_ws("/", "sub", "ses", F.lit("eeg")), F.concat_ws("_", "sub", "ses", "task", F.concat(F.lit("run-"), F.col("k")), F.lit("eeg"))
    body = lambda key: F.concat(F.lit('{"' + key + '": "'), F.col("k"), F.lit('", "ref": "'), F.lit(key), F.lit('"}'))
    none = F.lit(None).cast("string")
    rows = [
        c.select(F.concat(at, F.lit("/"), name, F.lit(".set")).alias("path"), none.alias("content")),
        c.where("n % 7 = 0").select(F.concat(at, F.lit("/"), name, F.lit(".json")).alias("path"), body("gain").alias("content")),
        c.where("n < 50 and n % 2 = 0").select(F.concat(F.col("sub"), F.lit("/"), F.col("sub"), F.lit("_eeg.json")).alias("path"), body("cap").alias("content")),
        c.groupBy("task").agg(F.min("n").cast("string").alias("k")).select(F.concat(F.col("task"), F.lit("_eeg.json")).alias("path"), body("rate").alias("content")),
        c.where("n < 50 and n % 3 = 0").select(F.concat(F.col("sub"), F.lit("/"), F.col("sub"), F.lit("_events.tsv")).alias("path"), none.alias("content")),
        c.select("task").distinct().select(F.concat(F.col("task"), F.lit("_events.tsv")).alias("path"), none.alias("content")),
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


_TREE = """WITH c AS (SELECT 'sub-' || c_custkey % 50 AS sub, 'ses-' || c_custkey % 3 AS ses, 'task-' || lower(c_mktsegment) AS task, c_custkey AS n FROM customer),
 data AS (SELECT *, sub || '/' || ses || '/eeg/' || sub || '_' || ses || '_' || task || '_run-' || n || '_eeg' AS stem FROM c),
 root AS (SELECT task, min(n) AS k FROM c GROUP BY task),
 vals AS (
  SELECT stem, 0 AS depth, task || '_eeg.json' AS side, unnest(['rate', 'ref']) AS key, unnest([CAST(k AS VARCHAR), 'rate']) AS value FROM data JOIN root USING (task)
  UNION ALL SELECT stem, 1, x.sub || '/' || x.sub || '_eeg.json', unnest(['cap', 'ref']), unnest([CAST(x.n AS VARCHAR), 'cap']) FROM data JOIN (SELECT sub, n FROM c WHERE n < 50 AND n % 2 = 0) x USING (sub)
  UNION ALL SELECT stem, 3, stem || '.json', unnest(['gain', 'ref']), unnest([CAST(n AS VARCHAR), 'gain']) FROM data WHERE n % 7 = 0),
 events AS (SELECT stem, coalesce(x.sub || '/' || x.sub || '_events.tsv', task || '_events.tsv') AS side FROM data LEFT JOIN (SELECT sub FROM c WHERE n < 50 AND n % 3 = 0) x USING (sub))"""
register("inherited_metadata", "dataset layout", "path:s key:s value:s side:s", lambda s, d: layout.metadata(_tree(s, d)), _TREE + " SELECT stem || '.set' AS path, key, value, side FROM vals QUALIFY row_number() OVER (PARTITION BY stem, key ORDER BY depth DESC) = 1")
register("inherited_events", "dataset layout", "path:s side:s", lambda s, d: layout.event_tables(_tree(s, d)), _TREE + " SELECT stem || '.set' AS path, side FROM events")

# --- data quality ----------------------------------------------------------------------------------------------------

_CH = ", c AS (SELECT subject, ch, count(*) AS n, avg(x) AS m, stddev_pop(x) AS sd, sum(abs(x)) AS a, max(n) AS last FROM ev GROUP BY subject, ch)"
_VAL = _CH + ", v AS (SELECT subject, max(last) / 4.0 AS duration, count(*) AS n_channels, sum(a) / sum(n) AS mean_amplitude, count(*) FILTER (sd < 0.8) AS flat_channels FROM c GROUP BY subject), w AS (SELECT *, duration < 3.0 AS short, n_channels < 5 AS few, mean_amplitude > 4.0 AS noisy FROM v), r AS (SELECT subject, duration, n_channels, mean_amplitude, flat_channels, NOT (short OR few OR noisy) AS passed, list_filter([CASE WHEN short THEN 'short recording' END, CASE WHEN few THEN 'few channels' END, CASE WHEN noisy THEN 'noisy' END, CASE WHEN flat_channels > 0 THEN 'flat channels' END], lambda i: i IS NOT NULL) AS iss FROM w)"


def _validated(s: SparkSession, d: str) -> DataFrame:
    return quality.validate(T.ev(s, d), 4.0, min_duration=3.0, min_channels=5, min_sfreq=1.0, noise=4.0, flat=0.8)


register("raw_amplitude", "VAL2", "subject:s mean_amplitude:d std_amplitude:d max_amplitude:d", lambda s, d: quality.amplitude(T.ev(s, d)), T.sql("SELECT subject, avg(abs(x)) AS mean_amplitude, stddev_pop(x) AS std_amplitude, max(abs(x)) AS max_amplitude FROM ev GROUP BY subject", "ev"))
register("raw_snr", "VAL3", "subject:s snr:d", lambda s, d: quality.snr(T.ev(s, d)), T.sql(", y AS (SELECT subject, x, x - avg(x) OVER (PARTITION BY subject, ch) AS e FROM ev) SELECT subject, CASE WHEN avg(e * e) > 1e-18 THEN 10 * log10(avg(x * x) / avg(e * e)) ELSE CAST('inf' AS DOUBLE) END AS snr FROM y GROUP BY subject", "ev"))
register("flat_channels", "VAL4", "subject:s flat_channels:l n_channels:l", lambda s, d: quality.flat_channels(T.ev(s, d), 0.8), T.sql(_CH + " SELECT subject, count(*) FILTER (sd < 0.8) AS flat_channels, count(*) AS n_channels FROM c GROUP BY subject", "ev"))
register("outlier_ratio", "VAL5", "subject:s outliers:l outlier_ratio:d", lambda s, d: quality.outlier_ratio(T.ev(s, d), 2.0), T.sql(_CH + " SELECT e.subject, count(*) FILTER (abs(x - m) > 2 * sd AND sd > 0) AS outliers, count(*) FILTER (abs(x - m) > 2 * sd AND sd > 0) / count(*) AS outlier_ratio FROM ev e JOIN c USING (subject, ch) GROUP BY e.subject", "ev"))
register("raw_validation", "VAL1 M13", "subject:s passed:b issues:s duration:d n_channels:l mean_amplitude:d flat_channels:l", lambda s, d: _validated(s, d).withColumn("issues", F.array_join("issues", "; ")), T.sql(_VAL + " SELECT *, coalesce(array_to_string(iss, '; '), '') AS issues FROM r", "ev"))
register("validation_report", "VAL17", "subject:s passed:b n_issues:l issues:s", lambda s, d: quality.report(_validated(s, d)), T.sql(_VAL + " SELECT subject, passed, len(iss) AS n_issues, CASE WHEN len(iss) > 0 THEN array_to_string(iss, '; ') ELSE 'None' END AS issues FROM r", "ev"))
register("pass_rate", "VAL18", "total:l passed:l failed:l pass_rate:d", lambda s, d: quality.pass_summary(_validated(s, d)), T.sql(_VAL + " SELECT count(*) AS total, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, coalesce(count(*) FILTER (passed) / nullif(count(*), 0), 0) AS pass_rate FROM r", "ev"))

_EQ = ", cell AS (SELECT subject, ch, k, var_pop(x) AS v, avg(x) AS m FROM ep GROUP BY ALL), tr AS (SELECT subject, 1 - avg(v) / nullif(var_pop(m), 0) AS inter_trial_consistency FROM cell GROUP BY subject), q AS (SELECT subject, count(DISTINCT epoch) AS n_epochs, count(DISTINCT ch) AS n_channels, max(t) - min(t) AS duration, avg(abs(x)) AS mean_amplitude, stddev_pop(x) AS std_amplitude, max(abs(x)) AS max_amplitude, stddev_pop(x) FILTER (k = 3) AS baseline_stability FROM ep GROUP BY subject), g AS (SELECT *, std_amplitude / nullif(mean_amplitude, 0) AS coefficient_of_variation FROM q JOIN tr USING (subject))"
register("epoch_quality", "VAL9 VAL10 VAL11 VAL12", "subject:s n_epochs:l n_channels:l duration:d mean_amplitude:d std_amplitude:d max_amplitude:d baseline_stability:d inter_trial_consistency:d coefficient_of_variation:d", lambda s, d: quality.epoch_metrics(T.ep(s, d), 3), T.sql(_EQ + " SELECT * FROM g", "ep"))
register("epoch_validation", "VAL8", "subject:s passed:b issues:s", lambda s, d: quality.validate_epochs(T.ep(s, d), 3, min_epochs=25).withColumn("issues", F.array_join("issues", "; ")), T.sql(_EQ + " SELECT subject, NOT (n_epochs < 25 OR duration < 0.5) AS passed, concat_ws('; ', CASE WHEN n_epochs < 25 THEN 'few epochs' END, CASE WHEN duration < 0.5 THEN 'short epochs' END, CASE WHEN coefficient_of_variation > 0.5 THEN 'high variation' END) AS issues FROM g", "ep"))
register("feature_shape", "VAL13", "n_samples:l n_features:l", lambda s, d: quality.table_shape(T.read(s, d, "part")), "SELECT count(*) AS n_samples, 6 AS n_features FROM part")


def _labelled(s: SparkSession, d: str) -> DataFrame:
    docs, labels = T.read(s, d, "documents"), T.read(s, d, "labels")
    return docs.join(labels, "doc_id", "left").select("doc_id", "lang", "source", "n_chars", "quality", "toxic")


_LAB = "WITH l AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))"
register("missing_ratio", "VAL14", "name:s missing_ratio:d too_many:b", lambda s, d: quality.missing_ratio(_labelled(s, d)), _LAB + " SELECT name, r AS missing_ratio, r > 0.5 AS too_many FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, avg(CAST({c} IS NULL AS INTEGER)) AS r FROM l" for c in ("doc_id", "lang", "source", "n_chars", "quality", "toxic")) + ")")
register("feature_outliers", "VAL15", "name:s outliers:l outlier_ratio:d", lambda s, d: quality.feature_outliers(T.ft(s, d), 2.5), T.sql(", st AS (SELECT name, avg(value) AS m, stddev_samp(value) AS sd FROM ft GROUP BY name) SELECT name, count(*) FILTER (abs(value - m) > 2.5 * sd) AS outliers, count(*) FILTER (abs(value - m) > 2.5 * sd) / (SELECT count(*) FROM ft) AS outlier_ratio FROM ft JOIN st USING (name) GROUP BY name", "ft"))
register("high_correlations", "VAL16", "i:s j:s r:d", lambda s, d: quality.high_correlations(T.ft(s, d), 0.1), T.sql("SELECT a.name AS i, b.name AS j, corr(a.value, b.value) AS r FROM ft a JOIN ft b ON a.id = b.id AND a.name < b.name GROUP BY ALL HAVING abs(corr(a.value, b.value)) > 0.1", "ft"))

# --- epochs and event-related potentials -----------------------------------------------------------------------------

_MARKS = ", mk AS (SELECT subject, n AS sample, state AS code FROM seq WHERE state = 2), cu AS (SELECT m.subject, m.sample AS epoch, s.n - m.sample AS k, s.x FROM mk m JOIN seq s ON s.subject = m.subject AND s.n BETWEEN m.sample - 2 AND m.sample + 5)"


def _stream(s: SparkSession, d: str) -> DataFrame:
    return T.seq(s, d).withColumn("ch", F.lit("x"))


def _cut(s: SparkSession, d: str) -> DataFrame:
    seq = _stream(s, d)
    marks = seq.where("state = 2").select("subject", F.col("n").alias("sample"), F.col("state").alias("code"))
    return epochs.cut(seq, marks, -2, 5)


_BASE = _MARKS + ", bl AS (SELECT *, x - coalesce(avg(CASE WHEN k BETWEEN -2 AND 0 THEN x END) OVER (PARTITION BY subject, epoch), 0) AS y FROM cu)"
register("epoching", "PRE5 M2 M3", "subject:s epoch:l k:l x:d", lambda s, d: _cut(s, d), T.sql(_MARKS + " SELECT subject, epoch, k, x FROM cu", "seq"))
register("baseline_correct", "PRE5", "subject:s epoch:l k:l x:d", lambda s, d: epochs.subtract_baseline(_cut(s, d), -2, 0, "k"), T.sql(_BASE + " SELECT subject, epoch, k, y AS x FROM bl", "seq"))
register("epoch_reject", "PRE6", "subject:s epoch:l k:l x:d", lambda s, d: epochs.drop_bad(_cut(s, d), 4.0, 0.5), T.sql(_MARKS + " SELECT subject, epoch, k, x FROM cu WHERE (subject, epoch) NOT IN (SELECT (subject, epoch) FROM cu GROUP BY subject, epoch HAVING max(x) - min(x) > 4.0 OR max(x) - min(x) < 0.5)", "seq"))
register("segment_reject", "PRE4", "subject:s ch:s n:l x:d", lambda s, d: epochs.drop_bad_segments(T.ev(s, d), 4, 3.5), T.sql(", p AS (SELECT *, n // 4 AS seg FROM ev), bad AS (SELECT DISTINCT subject, seg FROM p GROUP BY subject, seg, ch HAVING max(x) - min(x) > 3.5 OR max(x) - min(x) < 0) SELECT subject, ch, n, x FROM p ANTI JOIN bad USING (subject, seg)", "ev"))
register("preprocessing_summary", "PRE7", "subject:s channels_before:l channels_after:l samples_before:l samples_after:l seconds_before:d seconds_after:d samples_dropped:l", lambda s, d: epochs.summary(T.ev(s, d), epochs.drop_bad_segments(T.ev(s, d), 4, 3.5), 4.0), T.sql(", p AS (SELECT *, n // 4 AS seg FROM ev), bad AS (SELECT DISTINCT subject, seg FROM p GROUP BY subject, seg, ch HAVING max(x) - min(x) > 3.5 OR max(x) - min(x) < 0), k AS (SELECT * FROM p ANTI JOIN bad USING (subject, seg)), b AS (SELECT subject, count(DISTINCT ch) AS channels_before, count(*) AS samples_before, (max(n) - min(n)) / 4.0 AS seconds_before FROM ev GROUP BY subject), a AS (SELECT subject, count(DISTINCT ch) AS channels_after, count(*) AS samples_after, (max(n) - min(n)) / 4.0 AS seconds_after FROM k GROUP BY subject) SELECT *, samples_before - coalesce(samples_after, 0) AS samples_dropped FROM b LEFT JOIN a USING (subject)", "ev"))
register("annotations_to_marks", "PRE8", "subject:s sample:l code:l", lambda s, d: epochs.annotations_to_marks(T.read(s, d, "events").select(F.col("user_id").cast("string").alias("subject"), F.lit("stream").alias("task"), (F.col("event_id") * F.lit(0.3)).alias("onset"), F.col("event_type").alias("description")), 100.0, {"click": 1, "purchase": 2, "error": 3}), "SELECT CAST(user_id AS VARCHAR) AS subject, CAST(round((event_id * CAST(0.3 AS DOUBLE)) * 100) AS BIGINT) AS sample, CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS code FROM events WHERE event_type IN ('click', 'purchase', 'error')")

_WIN = "win(component, lo, hi, peak) AS (VALUES ('N1', 0.08::DOUBLE, 0.12::DOUBLE, 'min'), ('P2', 0.15::DOUBLE, 0.25::DOUBLE, 'max'), ('LPP', 0.4::DOUBLE, 0.8::DOUBLE, 'abs'))"
_ERP = ", " + _WIN + ", av AS (SELECT subject, code, ch, k, t, avg(x) AS erp, stddev_pop(x) AS spread, count(*) AS n FROM ep GROUP BY ALL), iw AS (SELECT av.*, component, peak, CASE peak WHEN 'min' THEN -erp WHEN 'max' THEN erp ELSE abs(erp) END AS score, (erp + lead(erp) OVER w) / 2 * (lead(t) OVER w - t) AS part, row_number() OVER (PARTITION BY subject, code, component, ch ORDER BY CASE peak WHEN 'min' THEN -erp WHEN 'max' THEN erp ELSE abs(erp) END DESC, k) AS rk FROM av JOIN win ON t BETWEEN lo AND hi WINDOW w AS (PARTITION BY subject, code, component, ch ORDER BY k)), fe AS (SELECT subject, code, component, ch, CASE WHEN any_value(peak) = 'abs' THEN avg(erp) ELSE max(erp) FILTER (rk = 1) END AS amplitude, max(t) FILTER (rk = 1) AS latency, avg(erp) AS mean_amplitude, max(erp) - min(erp) AS peak_to_peak, coalesce(sum(part), 0) AS area, stddev_pop(erp) AS std, avg(spread) AS itv, max(n) AS n_epochs FROM iw GROUP BY ALL)"
_FE = lambda s, d: erp.features(T.ep(s, d), erp.components(s))
register("erp_average", "ERP3 M4", "subject:s code:l ch:s k:l erp:d", lambda s, d: erp.average(T.ep(s, d)), T.sql(_ERP + " SELECT subject, code, ch, k, erp FROM av", "ep"))
register("erp_windows", "ERP2", "subject:s code:l ch:s k:l component:s n_epochs:l", lambda s, d: erp.in_windows(erp.average(T.ep(s, d)), erp.components(s)), T.sql(_ERP + " SELECT subject, code, ch, k, component, n AS n_epochs FROM iw", "ep"))
register("erp_peaks", "ERP1 ERP4", "subject:s code:l component:s ch:s amplitude:d latency:d", _FE, T.sql(_ERP + " SELECT * FROM fe", "ep"))
register("erp_window_stats", "ERP5 ERP6 ERP8", "subject:s code:l component:s ch:s mean_amplitude:d peak_to_peak:d std:d", _FE, T.sql(_ERP + " SELECT * FROM fe", "ep"))
register("erp_area", "ERP7 DSP7", "subject:s code:l component:s ch:s area:d", _FE, T.sql(_ERP + " SELECT * FROM fe", "ep"))
register("erp_itv", "ERP9", "subject:s code:l component:s ch:s itv:d n_epochs:l", _FE, T.sql(_ERP + " SELECT * FROM fe", "ep"))
_ERG = ", " + _WIN + ", iw AS (SELECT * FROM ep JOIN win ON t BETWEEN lo AND hi)"
register("erp_global", "ERP10", "subject:s code:l component:s global_mean_amplitude:d global_peak_amplitude:d", lambda s, d: erp.global_features(T.ep(s, d), erp.components(s)), T.sql(_ERG + " SELECT subject, code, component, avg(x) AS global_mean_amplitude, CASE any_value(peak) WHEN 'min' THEN min(x) WHEN 'max' THEN max(x) ELSE avg(x) END AS global_peak_amplitude FROM iw GROUP BY subject, code, component", "ep"))
register("erp_gradient", "ERP11", "subject:s code:l component:s anterior_posterior_gradient:d", lambda s, d: erp.gradient(T.ep(s, d), erp.components(s)), T.sql(_ERG + " SELECT subject, code, component, avg(x) FILTER (ch LIKE '%F%') - avg(x) FILTER (ch LIKE '%P%' OR ch LIKE '%O%') AS anterior_posterior_gradient FROM iw GROUP BY subject, code, component", "ep"))
register("erp_component", "ERP12", "subject:s code:l component:s ch:s amplitude:d", lambda s, d: erp.component_features(T.ep(s, d), erp.components(s), "P2"), T.sql(_ERP + " SELECT * FROM fe WHERE component = 'P2'", "ep"))
_DW = ", dw AS (SELECT subject, ch, k, t, avg(x) FILTER (code = 1) - avg(x) FILTER (code = 2) AS x FROM ep WHERE code IN (1, 2) GROUP BY ALL HAVING avg(x) FILTER (code = 1) - avg(x) FILTER (code = 2) IS NOT NULL)"
register("difference_wave", "ERP13", "subject:s ch:s k:l x:d", lambda s, d: erp.difference_wave(T.ep(s, d), 1, 2), T.sql(_DW + " SELECT * FROM dw", "ep"))
register("difference_features", "ERP13", "subject:s component:s ch:s mean_amplitude:d peak_to_peak:d latency:d itv:d", lambda s, d: erp.difference_features(T.ep(s, d), 1, 2, erp.components(s)), T.sql(_DW + ", " + _WIN + " SELECT subject, component || '_diff' AS component, ch, avg(x) AS mean_amplitude, max(x) - min(x) AS peak_to_peak, arg_max(t, abs(x)) AS latency, 0.0 AS itv FROM dw JOIN win ON t BETWEEN lo AND hi GROUP BY subject, component, ch", "ep"))

# --- spectra ---------------------------------------------------------------------------------------------------------

#: Welch's method in SQL: segments of 32 samples every 16, mean-free, periodic Hann window, one-sided density at 64 Hz.
_PSD = ", seg AS (SELECT rec, g, n - g * 16 AS j, x - avg(x) OVER (PARTITION BY rec, g) AS x FROM sig, (SELECT unnest([0, 1, 2]) AS g) WHERE n - g * 16 BETWEEN 0 AND 31), wi AS (SELECT rec, g, j, x * (0.5 - 0.5 * cos(2 * pi() * j / 32)) AS x FROM seg), fr AS (SELECT CAST(unnest(range(17)) AS BIGINT) AS f), ft0 AS (SELECT rec, g, f, sum(x * cos(2 * pi() * f * j / 32)) AS re, sum(x * sin(2 * pi() * f * j / 32)) AS im FROM wi, fr GROUP BY rec, g, f), psd AS (SELECT rec, f AS f_idx, f * 2.0::DOUBLE AS freq, avg(re * re + im * im) / (64 * 12.0) * CASE WHEN f IN (0, 16) THEN 1 ELSE 2 END AS p FROM ft0 GROUP BY rec, f)"
_BANDS = "bands(band, lo, hi) AS (VALUES ('delta', 0.5, 4.0), ('theta', 4.0, 8.0), ('alpha', 8.0, 13.0), ('beta', 13.0, 30.0), ('gamma', 30.0, 45.0))"


def _psd(s: SparkSession, d: str) -> DataFrame:
    return kernels.welch_psd(T.sig(s, d), 64.0, 32)


def _bands(s: SparkSession) -> DataFrame:
    return spectral.band_table(s)


register("psd", "DSP4 M5", "rec:l f_idx:l freq:d p:d", _psd, T.sql(_PSD + " SELECT * FROM psd", "sig"))
register("band_psd_stats", "SPE1", "rec:l band:s psd_mean:d psd_max:d psd_std:d", lambda s, d: spectral.band_stats(_psd(s, d), _bands(s), ["rec"]), T.sql(_PSD + ", " + _BANDS + " SELECT rec, band, avg(p) AS psd_mean, max(p) AS psd_max, stddev_pop(p) AS psd_std FROM psd JOIN bands ON freq BETWEEN lo AND hi GROUP BY rec, band", "sig"))
register("spectral_entropy", "SPE4 DSP8", "rec:l spectral_entropy:d", lambda s, d: spectral.spectral_entropy(_psd(s, d), ["rec"]), T.sql(_PSD + ", q AS (SELECT rec, p / sum(p) OVER (PARTITION BY rec) AS q FROM psd) SELECT rec, -sum(q * ln(q)) FILTER (q > 0) AS spectral_entropy FROM q GROUP BY rec", "sig"))
register("peak_frequency", "SPE5", "rec:l peak_frequency:d", lambda s, d: spectral.peak_frequency(_psd(s, d), ["rec"]), T.sql(_PSD + " SELECT rec, freq AS peak_frequency FROM (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY p DESC, f_idx) AS r FROM psd) WHERE r = 1", "sig"))
register("band_peak_frequency", "SPE6", "rec:l band:s peak_frequency:d", lambda s, d: spectral.band_peak_frequency(_psd(s, d), _bands(s), ["rec"]), T.sql(_PSD + ", " + _BANDS + " SELECT rec, band, freq AS peak_frequency FROM (SELECT *, row_number() OVER (PARTITION BY rec, band ORDER BY p DESC, f_idx) AS r FROM psd JOIN bands ON freq BETWEEN lo AND hi) WHERE r = 1", "sig"))
register("edge_frequency", "SPE7", "rec:l edge_freq_50:d edge_freq_90:d edge_freq_95:d", lambda s, d: spectral.edge_frequency(_psd(s, d), ["rec"]), T.sql(_PSD + ", u AS (SELECT *, sum(p) OVER (PARTITION BY rec ORDER BY f_idx) AS upto, sum(p) OVER (PARTITION BY rec) AS total FROM psd) SELECT rec, min(freq) FILTER (upto >= total * 0.5) AS edge_freq_50, min(freq) FILTER (upto >= total * 0.9) AS edge_freq_90, min(freq) FILTER (upto >= total * 0.95) AS edge_freq_95 FROM u GROUP BY rec", "sig"))
register("relative_power", "relative_power", "rec:l band:s relative_power:d", lambda s, d: spectral.relative_power(_psd(s, d), _bands(s), ["rec"]), T.sql(_PSD + ", " + _BANDS + " SELECT rec, band, sum(p) / any_value(total) AS relative_power FROM (SELECT *, sum(p) OVER (PARTITION BY rec) AS total FROM psd) JOIN bands ON freq BETWEEN lo AND hi GROUP BY rec, band", "sig"))
register("band_ratios", "SPE8 SPE9", "grp:l alpha_theta_ratio:d beta_alpha_ratio:d theta_beta_ratio:d total_power:d", lambda s, d: spectral.ratios(spectral.by_band(_psd(s, d), _bands(s)).groupBy((F.col("rec") % 20).alias("grp"), F.col("rec").alias("ch"), "band").agg(F.avg("p").alias("power")), ["grp"]), T.sql(_PSD + ", " + _BANDS + ", bp AS (SELECT rec % 20 AS grp, rec, band, avg(p) AS power FROM psd JOIN bands ON freq BETWEEN lo AND hi GROUP BY ALL), m AS (SELECT grp, band, avg(power) AS m FROM bp GROUP BY ALL) SELECT grp, max(m) FILTER (band = 'alpha') / (max(m) FILTER (band = 'theta') + 1e-10) AS alpha_theta_ratio, max(m) FILTER (band = 'beta') / (max(m) FILTER (band = 'alpha') + 1e-10) AS beta_alpha_ratio, max(m) FILTER (band = 'theta') / (max(m) FILTER (band = 'beta') + 1e-10) AS theta_beta_ratio, sum(m) AS total_power FROM m GROUP BY grp", "sig"))
register("dominant_frequency", "VAL6 VAL7", "grp:l dominant_frequency:d raw_spectral_entropy:d", lambda s, d: spectral.dominant_frequency(_psd(s, d).withColumn("grp", F.col("rec") % 20), ["grp"]), T.sql(_PSD + ", m AS (SELECT rec % 20 AS grp, f_idx, freq, avg(p) AS m, sum(p) AS s, sum(p * ln(p + 1e-10)) AS pl FROM psd GROUP BY ALL) SELECT grp, arg_max(freq, m) AS dominant_frequency, -sum(pl) / sum(s) AS raw_spectral_entropy FROM m GROUP BY grp", "sig"))

def _numbers(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def _convolved_sql(kernel, pad: int, shift: int, source: str = "sig", keys: str = "rec", circular: bool = True) -> str:
    """CTEs up to ``y`` (keys, n, x): signals, oddly extended by ``pad`` samples, convolved with a fixed kernel."""
    place = f"(b.n + {pad} + {shift} - w.i)"
    match = f"g.m = ({place} + {len(kernel)}) % {len(kernel)}" if circular else f"g.m = {place}"
    same = " AND ".join(f"b.{k} = w.{k}" for k in keys.split(", "))
    own = ", ".join(f"b.{k}" for k in keys.split(", "))
    return f""", ls AS (SELECT {keys}, list(x ORDER BY n) AS xs, count(*) AS c FROM {source} GROUP BY {keys}),
 pd AS (SELECT *, least({pad}, c - 1) AS p FROM ls),
 wd AS (SELECT {keys}, i, CASE WHEN i < {pad} THEN 2 * xs[1] - xs[1 + {pad} - i] WHEN i < {pad} + c THEN xs[i - {pad} + 1] ELSE 2 * xs[c] - xs[2 * c - (i - {pad}) - 1] END AS v
   FROM (SELECT *, unnest(range({pad} - p, {pad} + c + p)) AS i FROM pd)),
 g AS (SELECT unnest({_numbers(kernel)}) AS g, unnest(range({len(kernel)})) AS m),
 y AS (SELECT {own}, b.n, sum(w.v * g.g) AS x FROM {source} b JOIN wd w ON {same} JOIN g ON {match} GROUP BY {own}, b.n)"""


def _zero_phase_sql(sos, n: int = 64) -> str:
    kernel, pad = dsp.zero_phase_kernel(sos, n)
    return _convolved_sql(kernel, pad, 0)


_POWER_BANDS = [("theta", 4.0, 8.0), ("alpha", 8.0, 13.0), ("beta", 13.0, 30.0)]


def _band_power_sql() -> str:
    parts = []
    for band, lo, hi in _POWER_BANDS:
        body = _zero_phase_sql(dsp.butter_bandpass(lo, hi, 64.0)).lstrip(", ")
        parts.append(f"SELECT * FROM (WITH {body} SELECT rec, '{band}' AS band, avg(x * x) AS power, log10(avg(x * x) + 1e-10) AS log_power FROM y GROUP BY rec)")
    return T.sql(" UNION ALL ".join(parts), "sig")


def _hilbert_sql() -> str:
    kernel = dsp.analytic_kernel(64)
    return T.sql(f", g AS (SELECT unnest({_numbers(kernel.real)}) AS re, unnest({_numbers(kernel.imag)}) AS im, unnest(range(64)) AS m) SELECT b.rec, b.n, atan2(sum(w.x * im), sum(w.x * re)) AS phase FROM sig b JOIN sig w ON b.rec = w.rec JOIN g ON g.m = (b.n - w.n + 64) % 64 GROUP BY b.rec, b.n", "sig")


_FIR = dsp.fir_bandpass(2.0, 20.0, 64.0)
register("band_power", "DSP1 DSP2 SPE2 SPE3 PRE2", "rec:l band:s power:d log_power:d", lambda s, d: kernels.band_power(T.sig(s, d), _POWER_BANDS, 64.0), _band_power_sql())
register("hilbert_phase", "DSP3", "rec:l n:l phase:d", lambda s, d: kernels.phases(T.sig(s, d)).select("rec", F.posexplode("xs").alias("n", "phase")), _hilbert_sql())
register("bandpass_filter", "PRE2 CON3 MIC2", "rec:l n:l x:d", lambda s, d: kernels.bandpass(T.sig(s, d), 2.0, 20.0, 64.0).select("rec", F.posexplode("xs").alias("n", "x")), T.sql(_zero_phase_sql(dsp.butter_bandpass(2.0, 20.0, 64.0)) + " SELECT rec, n, x FROM y", "sig"))
register("fir_filter", "PRE2", "rec:l n:l x:d", lambda s, d: kernels.bandpass(T.sig(s, d), 2.0, 20.0, 64.0, "fir").select("rec", F.posexplode("xs").alias("n", "x")), T.sql(_convolved_sql(_FIR, min(len(_FIR) // 2, 63), len(_FIR) // 2, circular=False) + " SELECT rec, n, x FROM y", "sig"))
register("notch_filter", "notch", "rec:l n:l x:d", lambda s, d: kernels.notch_filter(T.sig(s, d), 16.0, 64.0).select("rec", F.posexplode("xs").alias("n", "x")), T.sql(_zero_phase_sql(dsp.notch(16.0, 64.0)) + " SELECT rec, n, x FROM y", "sig"))

_NUMBERED = ", nr AS (SELECT subject, ch, row_number() OVER (PARTITION BY subject, ch ORDER BY n) - 1 AS n, x FROM rec)"
_FLOW = preprocessing.Flow(lo=2.0, hi=20.0, method="fir", reject=0.75, flat=0.05)
register("preprocess_chain", "PRE1", "subject:s ch:s n:l x:d", lambda s, d: preprocessing.preprocess(preprocessing.numbered(T.rec(s, d)), 64.0, _FLOW), T.sql(_NUMBERED + _convolved_sql(_FIR, len(_FIR) // 2, len(_FIR) // 2, "nr", "subject, ch", circular=False) + ", bad AS (SELECT DISTINCT subject, n // 64 AS seg FROM y GROUP BY subject, n // 64, ch HAVING max(x) - min(x) > 0.75 OR max(x) - min(x) < 0.05) SELECT subject, ch, n, x FROM y WHERE (subject, n // 64) NOT IN (SELECT (subject, seg) FROM bad)", "rec"))


def _ica(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return ica.clean(preprocessing.numbered(T.rec(s, d)), 64.0, eog=["C0"])


register("ica_clean", "PRE3", "subject:s ch:s n:l x:d removed:l", lambda s, d: _ica(s, d)[0])
register("ica_components", "PRE3", "subject:s component:l eye:d removed:b", lambda s, d: _ica(s, d)[1])

# --- time and frequency ----------------------------------------------------------------------------------------------

_TAPERS = timefreq.slepian(64, 2.5, 4)[0]
_TAPERED = ", m AS (SELECT rec, n, x - avg(x) OVER (PARTITION BY rec) AS x FROM sig), tp AS (" + " UNION ALL ".join(f"SELECT {_k} AS k, unnest({_numbers(_v)}) AS h, unnest(range(64)) AS n" for _k, _v in enumerate(_TAPERS)) + "), fq AS (SELECT unnest(range(33)) AS f), ft AS (SELECT rec, k, f, pow(sum(x * h * cos(2 * pi() * f * n / 64)), 2) + pow(sum(x * h * sin(2 * pi() * f * n / 64)), 2) AS s FROM m JOIN tp USING (n), fq GROUP BY rec, k, f)"
register("multitaper_psd", "multitaper spectra", "rec:l f_idx:l freq:d p:d", lambda s, d: timefreq.multitaper_psd(T.sig(s, d), 64.0, 2.5, adaptive=False), T.sql(_TAPERED + " SELECT rec, f AS f_idx, CAST(f AS DOUBLE) AS freq, avg(s) / 64 * CASE WHEN f IN (0, 32) THEN 1 ELSE 2 END AS p FROM ft GROUP BY rec, f", "sig"))
register("multitaper_adaptive", "multitaper spectra", "rec:l f_idx:l freq:d p:d", lambda s, d: timefreq.multitaper_psd(T.sig(s, d), 64.0))
_WAVES = [(_f, timefreq.morlet(_f, 64.0, 5.0)) for _f in (6.0, 10.0, 20.0)]
_WAVE_SQL = " UNION ALL ".join(f"SELECT * FROM (WITH g AS (SELECT unnest({_numbers(_w.real)}) AS re, unnest({_numbers(_w.imag)}) AS im, unnest(range({len(_w)})) - {len(_w) // 2} AS m) SELECT b.subject, b.ch, {_f}::DOUBLE AS freq, b.n, pow(sum(w.x * re), 2) + pow(sum(w.x * im), 2) AS power FROM nr b CROSS JOIN g JOIN nr w ON b.subject = w.subject AND b.ch = w.ch AND w.n = b.n - g.m WHERE b.n % 16 = 0 GROUP BY b.subject, b.ch, b.n)" for _f, _w in _WAVES)
register("wavelet_power", "wavelet time-frequency power", "subject:s ch:s freq:d n:l power:d", lambda s, d: timefreq.wavelet_power(preprocessing.numbered(T.rec(s, d)), 64.0, [_f for _f, _ in _WAVES], 5.0, 16, 512), T.sql(_NUMBERED + " " + _WAVE_SQL, "rec"))

# --- microstates -----------------------------------------------------------------------------------------------------

_RUNS = ", ch AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY subject ORDER BY n) THEN 0 ELSE 1 END AS new FROM seq), ru AS (SELECT *, sum(new) OVER (PARTITION BY subject ORDER BY n) AS run FROM ch), sg AS (SELECT subject, state, min(n) AS start, max(n) + 1 AS \"end\", count(*) AS length FROM ru GROUP BY subject, run, state)"
_GRID = ", gr AS (SELECT subject, CAST(unnest(range(5)) AS INTEGER) AS state FROM (SELECT DISTINCT subject FROM seq)), tot AS (SELECT subject, count(*) AS total FROM seq GROUP BY subject)"
register("segments", "MIC6 M6", "subject:s state:l start:l end:l length:l", lambda s, d: microstates.segments(T.seq(s, d), 2), T.sql(_RUNS + " SELECT * FROM sg WHERE length >= 2", "seq"))
register("segment_durations", "MIC7", "subject:s total_segments:l mean_segment_duration:d std_segment_duration:d min_segment_duration:d max_segment_duration:d", lambda s, d: microstates.durations(microstates.segments(T.seq(s, d), 2), 3.0), T.sql(_RUNS + ", k AS (SELECT subject, length / 3.0 AS du FROM sg WHERE length >= 2) SELECT subject, count(*) AS total_segments, avg(du) AS mean_segment_duration, stddev_pop(du) AS std_segment_duration, min(du) AS min_segment_duration, max(du) AS max_segment_duration FROM k GROUP BY subject", "seq"))
register("coverage", "MIC8", "subject:s state:l coverage:d", lambda s, d: microstates.coverage(T.seq(s, d), 5), T.sql(_GRID + ", c AS (SELECT subject, state, count(*) AS c FROM seq GROUP BY ALL) SELECT subject, state, coalesce(c, 0) / total AS coverage FROM gr LEFT JOIN c USING (subject, state) JOIN tot USING (subject)", "seq"))
register("occurrence", "MIC9", "subject:s state:l frequency:d", lambda s, d: microstates.occurrence(T.seq(s, d), 5, 3.0, 2), T.sql(_RUNS + _GRID + ", c AS (SELECT subject, state, count(*) AS c FROM sg WHERE length >= 2 GROUP BY ALL) SELECT subject, state, coalesce(c, 0) / (total / 3.0) AS frequency FROM gr LEFT JOIN c USING (subject, state) JOIN tot USING (subject)", "seq"))
_TRANS = _GRID + ", st AS (SELECT subject, state AS a, lead(state) OVER (PARTITION BY subject ORDER BY n) AS b FROM seq), tc AS (SELECT subject, a, b, count(*) AS c FROM st WHERE b IS NOT NULL GROUP BY ALL), tm AS (SELECT g.subject, g.state AS a, h.b, coalesce(c / sum(c) OVER (PARTITION BY g.subject, g.state), 0) AS p FROM gr g CROSS JOIN (SELECT CAST(unnest(range(5)) AS INTEGER) AS b) h LEFT JOIN tc ON tc.subject = g.subject AND tc.a = g.state AND tc.b = h.b)"
register("transition_matrix", "MIC10", "subject:s a:l b:l p:d", lambda s, d: microstates.transitions(T.seq(s, d), 5), T.sql(_TRANS + " SELECT * FROM tm", "seq"))
register("transition_entropy", "MIC11", "subject:s state:l transition_entropy:d self_transition:d global_transition_entropy:d", lambda s, d: microstates.transition_entropy(microstates.transitions(T.seq(s, d), 5)), T.sql(_TRANS + ", z AS (SELECT *, p / sum(p) OVER (PARTITION BY subject) AS q FROM tm) SELECT subject, a AS state, coalesce(sum(-p * ln(p)) FILTER (p > 0), 0) AS transition_entropy, max(p) FILTER (a = b) AS self_transition, sum(coalesce(sum(-q * ln(q)) FILTER (q > 0), 0)) OVER (PARTITION BY subject) AS global_transition_entropy FROM z GROUP BY subject, a", "seq"))


def _states(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return microstates.analyse(preprocessing.numbered(T.rec(s, d)), 64.0, 4, 2)


register("microstate_chain", "MIC1 MIC2", "subject:s state:l coverage:d frequency:d", lambda s, d: _states(s, d)[0])
register("microstate_templates", "MIC5", "state:l ch:s v:d", lambda s, d: _states(s, d)[1])
register("microstate_input", "MIC2", "subject:s ch:s n:l x:d", lambda s, d: microstates.prepared(preprocessing.numbered(T.rec(s, d)), 64.0, method="fir"), T.sql(_NUMBERED + _convolved_sql(_FIR, len(_FIR) // 2, len(_FIR) // 2, "nr", "subject, ch", circular=False) + " SELECT subject, ch, n, (x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0) AS x FROM y WINDOW w AS (PARTITION BY subject, ch)", "rec"))


def _hidden(s: SparkSession, d: str) -> DataFrame:
    cut = hmm.cut_blocks(microstates.prepared(preprocessing.numbered(T.rec(s, d)), 64.0), 512)
    return hmm.paths(cut, hmm.fit(cut, 4, max_iter=20)[0])


register("microstate_hmm", "hidden-Markov microstates", "subject:s n:l state:l", _hidden)


def _gfp_labels(s: SparkSession, d: str) -> DataFrame:
    return T.rec(s, d).select("subject", "n").distinct().withColumn("state", (F.col("n") % 8).cast("int"))


register("zscore", "DSP9", "subject:s ch:s n:l x:d", lambda s, d: microstates.zscore(T.rec(s, d)), T.sql("SELECT subject, ch, n, (x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0) AS x FROM rec WINDOW w AS (PARTITION BY subject, ch)", "rec"))
_GFP = ", z AS (SELECT subject, ch, n, (x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0) AS x FROM rec WINDOW w AS (PARTITION BY subject, ch)), g AS (SELECT subject, n, stddev_pop(x) AS gfp, n % 8 AS state FROM z GROUP BY subject, n)"
register("gfp", "MIC12", "subject:s state:l mean_gfp:d std_gfp:d max_gfp:d", lambda s, d: microstates.field_power_stats(microstates.field_power(microstates.zscore(T.rec(s, d))), _gfp_labels(s, d)), T.sql(_GFP + " SELECT subject, state, avg(gfp) AS mean_gfp, stddev_pop(gfp) AS std_gfp, max(gfp) AS max_gfp FROM g GROUP BY GROUPING SETS ((subject, state), (subject))", "rec"))
register("topographic", "MIC13", "state:l mean_amplitude:d std_amplitude:d max_amplitude:d min_amplitude:d topographic_entropy:d", lambda s, d: microstates.topographic(T.rec(s, d).groupBy(F.col("subject").cast("int").alias("state"), "ch").agg(F.avg("x").alias("v"))), T.sql(", t AS (SELECT CAST(subject AS INTEGER) AS state, ch, avg(x) AS v FROM rec GROUP BY ALL), q AS (SELECT *, (v - min(v) OVER w) / nullif(max(v) OVER w - min(v) OVER w, 0) AS q FROM t WINDOW w AS (PARTITION BY state)), u AS (SELECT *, q / sum(q) OVER (PARTITION BY state) AS u FROM q) SELECT state, avg(v) AS mean_amplitude, stddev_pop(v) AS std_amplitude, max(v) AS max_amplitude, min(v) AS min_amplitude, coalesce(sum(-u * ln(u)) FILTER (u > 0), 0) AS topographic_entropy FROM u GROUP BY state", "rec"))
register("microstate_clusters", "MIC1 MIC3 MIC4 MIC5", "subject:s n:l state:l", lambda s, d: microstates.cluster(microstates.zscore(T.rec(s, d)), 4)[0])
register("epoch_microstates", "MIC14", "subject:s state:l coverage:d", lambda s, d: microstates.coverage(T.seq(s, d).withColumn("subject", F.concat("subject", F.lit("_epoch_"), F.floor(F.col("n") / 10).cast("string"))), 5), T.sql(", s2 AS (SELECT subject || '_epoch_' || (n // 10) AS subject, state FROM seq), g2 AS (SELECT subject, CAST(unnest(range(5)) AS INTEGER) AS state FROM (SELECT DISTINCT subject FROM s2)), c2 AS (SELECT subject, state, count(*) AS c FROM s2 GROUP BY ALL), t2 AS (SELECT subject, count(*) AS total FROM s2 GROUP BY subject) SELECT subject, state, coalesce(c, 0) / total AS coverage FROM g2 LEFT JOIN c2 USING (subject, state) JOIN t2 USING (subject)", "seq"))

# --- connectivity and graphs -----------------------------------------------------------------------------------------

_PLV = ", e AS (SELECT a.subject, a.ch AS i, b.ch AS j, sqrt(pow(avg(cos(a.x - b.x)), 2) + pow(avg(sin(a.x - b.x)), 2)) AS w FROM ph a JOIN ph b ON a.subject = b.subject AND a.n = b.n AND a.ch < b.ch GROUP BY ALL)"
#: Amplitudes stand in for phases, spread over the circle.
_PH = ", ph AS (SELECT subject, ch, n, x * 12 AS x FROM rec)"


def _phases(s: SparkSession, d: str) -> DataFrame:
    return T.rec(s, d).withColumn("x", F.col("x") * 12)


register("plv", "CON5 M7", "subject:s i:s j:s w:d", lambda s, d: connectivity.plv(_phases(s, d)), T.sql(_PH + _PLV + " SELECT * FROM e", "rec"))
_CORR = ", e AS (SELECT a.subject, a.ch AS i, b.ch AS j, abs(corr(a.x, b.x)) AS w FROM rec a JOIN rec b ON a.subject = b.subject AND a.n = b.n AND a.ch < b.ch GROUP BY ALL)"
register("correlation_conn", "CON6 CON4", "subject:s i:s j:s w:d", lambda s, d: connectivity.matrix(T.rec(s, d), "correlation"), T.sql(_CORR + " SELECT * FROM e", "rec"))
_BINS = ", b AS (SELECT *, least(20, CAST(floor((x - min(x) OVER w) / ((max(x) OVER w - min(x) OVER w) / 19)) AS INTEGER) + 1) AS code FROM rec WINDOW w AS (PARTITION BY subject, ch))"
register("discretise", "DSP6", "subject:s ch:s n:l code:l", lambda s, d: connectivity.bins(T.rec(s, d)), T.sql(_BINS + " SELECT subject, ch, n, code FROM b", "rec"))
register("mutual_information", "CON8", "subject:s i:s j:s w:d", lambda s, d: connectivity.mutual_information(T.rec(s, d)), T.sql(_BINS + ", jn AS (SELECT p.subject, p.ch AS i, q.ch AS j, p.code AS ci, q.code AS cj, count(*) AS c FROM b p JOIN b q ON p.subject = q.subject AND p.n = q.n AND p.ch < q.ch GROUP BY ALL), mm AS (SELECT *, c / sum(c) OVER (PARTITION BY subject, i, j) AS pij, sum(c) OVER (PARTITION BY subject, i, j, ci) / sum(c) OVER (PARTITION BY subject, i, j) AS pi, sum(c) OVER (PARTITION BY subject, i, j, cj) / sum(c) OVER (PARTITION BY subject, i, j) AS pj FROM jn) SELECT subject, i, j, sum(pij * ln(pij / (pi * pj))) AS w FROM mm GROUP BY subject, i, j", "rec"))


def _pair_signals(s: SparkSession, d: str) -> DataFrame:
    """Four channels of 16 samples from each embedding."""
    return T.read(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("subject"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("c"), F.col("embedding").cast("array<double>").alias("e")).select("subject", F.concat(F.lit("C"), F.col("c").cast("string")).alias("ch"), F.slice("e", F.col("c") * 16 + 1, F.lit(16)).alias("xs"))


register("coherence", "CON7 DSP5", "subject:s i:s j:s w:d", lambda s, d: connectivity.coherence(preprocessing.unpacked(_pair_signals(s, d).withColumn("n0", F.lit(0))), 1000.0, 8), T.sql(", c0 AS (SELECT rec, CAST(n // 16 AS INTEGER) AS ch, n % 16 AS n, x FROM sig), seg AS (SELECT rec, ch, g, n - g * 4 AS j, x - avg(x) OVER (PARTITION BY rec, ch, g) AS x FROM c0, (SELECT unnest([0, 1, 2]) AS g) WHERE n - g * 4 BETWEEN 0 AND 7), wi AS (SELECT rec, ch, g, j, x * (0.5 - 0.5 * cos(2 * pi() * j / 8)) AS x FROM seg), fr AS (SELECT CAST(unnest(range(5)) AS BIGINT) AS f), z AS (SELECT rec, ch, g, f, sum(x * cos(2 * pi() * f * j / 8)) AS re, sum(-x * sin(2 * pi() * f * j / 8)) AS im FROM wi, fr GROUP BY ALL), cr AS (SELECT a.rec, a.ch AS i, b.ch AS j, a.f, sum(a.re * b.re + a.im * b.im) AS re, sum(a.re * b.im - a.im * b.re) AS im, sum(a.re * a.re + a.im * a.im) AS pa, sum(b.re * b.re + b.im * b.im) AS pb FROM z a JOIN z b ON a.rec = b.rec AND a.g = b.g AND a.f = b.f AND a.ch < b.ch GROUP BY ALL) SELECT CAST(rec AS VARCHAR) AS subject, 'C' || i AS i, 'C' || j AS j, avg((re * re + im * im) / (pa * pb)) AS w FROM cr GROUP BY ALL", "sig"))

_CON_BANDS = [("alpha", 8.0, 13.0), ("beta", 13.0, 30.0)]
_BAND_CORR = " UNION ALL ".join(f"SELECT * FROM (WITH {_convolved_sql(_t, len(_t) // 2, len(_t) // 2, 'nr', 'subject, ch', circular=False).lstrip(', ')} SELECT a.subject, '{_b}' AS band, a.ch AS i, b.ch AS j, abs(corr(a.x, b.x)) AS w FROM y a JOIN y b ON a.subject = b.subject AND a.n = b.n AND a.ch < b.ch GROUP BY ALL)" for _b, _lo, _hi in _CON_BANDS for _t in (dsp.fir_bandpass(_lo, _hi, 64.0),))
register("band_connectivity", "CON1 CON2 CON3", "subject:s band:s i:s j:s w:d", lambda s, d: connectivity.by_band(preprocessing.numbered(T.rec(s, d)), 64.0, _CON_BANDS, "correlation", "fir"), T.sql(_NUMBERED + " " + _BAND_CORR, "rec"))
register("band_plv", "CON1 CON2 CON5", "subject:s band:s i:s j:s w:d", lambda s, d: connectivity.by_band(preprocessing.numbered(T.rec(s, d)), 64.0, _CON_BANDS, "plv"))

_GRAPH = ", mir AS (SELECT subject, i AS a, j AS b, w FROM e UNION ALL SELECT subject, j, i, w FROM e), nd AS (SELECT DISTINCT subject, a AS node FROM mir), ge AS (SELECT * FROM mir WHERE w >= 0.06), dg AS (SELECT nd.subject, node, count(ge.b) AS d FROM nd LEFT JOIN ge ON ge.subject = nd.subject AND ge.a = node GROUP BY ALL), tr AS (SELECT p.subject, p.a AS node, count(*) AS t FROM ge p JOIN ge q ON p.subject = q.subject AND p.a = q.a AND p.b < q.b JOIN ge r ON r.subject = p.subject AND r.a = p.b AND r.b = q.b GROUP BY ALL)"


def _edges(s: SparkSession, d: str) -> DataFrame:
    return written(connectivity.correlation(T.rec(s, d)), "edges")


def _graph(s: SparkSession, d: str, fn) -> DataFrame:
    e = _edges(s, d)
    return fn(graph.build(e, 0.06), graph.nodes_of(e))


register("matrix_stats", "CON9 CON11", "subject:s mean_connectivity:d std_connectivity:d max_connectivity:d min_connectivity:d density_cells:d", lambda s, d: connectivity.matrix_stats(_edges(s, d), 8, 0.06), T.sql(_CORR + ", cells AS (SELECT subject, w FROM e UNION ALL SELECT subject, w FROM e UNION ALL SELECT subject, 0.0 FROM (SELECT DISTINCT subject FROM e), range(8)) SELECT subject, avg(w) AS mean_connectivity, stddev_pop(w) AS std_connectivity, max(w) AS max_connectivity, min(w) AS min_connectivity, count(*) FILTER (w > 0.06) / 28.0 AS density_cells FROM cells GROUP BY subject", "rec"))
register("node_strength", "CON10", "subject:s mean_node_strength:d std_node_strength:d max_node_strength:d", lambda s, d: connectivity.node_strength(_edges(s, d)), T.sql(_CORR + _GRAPH + ", st AS (SELECT subject, a, sum(w) AS s FROM mir GROUP BY ALL) SELECT subject, avg(s) AS mean_node_strength, stddev_pop(s) AS std_node_strength, max(s) AS max_node_strength FROM st GROUP BY subject", "rec"))
register("clustering", "CON12", "subject:s clustering_coefficient:d", lambda s, d: (lambda e: graph.clustering(e, graph.nodes_of(e), 0.06))(_edges(s, d)), T.sql(_CORR + _GRAPH + " SELECT dg.subject, coalesce(avg(coalesce(t, 0) / (d * (d - 1) / 2.0)) FILTER (d >= 2), 0) AS clustering_coefficient FROM dg LEFT JOIN tr USING (subject, node) GROUP BY dg.subject", "rec"))
register("avg_clustering", "CON14 CON13", "subject:s average_clustering:d", lambda s, d: _graph(s, d, graph.average_clustering), T.sql(_CORR + _GRAPH + " SELECT dg.subject, avg(CASE WHEN d >= 2 THEN coalesce(t, 0) / (d * (d - 1) / 2.0) ELSE 0 END) AS average_clustering FROM dg LEFT JOIN tr USING (subject, node) GROUP BY dg.subject", "rec"))
register("shortest_path", "CON15 CON16 CON17 CON21", "subject:s is_connected:b average_shortest_path:d diameter:l global_efficiency:d", lambda s, d: _graph(s, d, graph.paths), (T.sql(_CORR + _GRAPH + ", walk(subject, s, v, h) AS (SELECT subject, node, node, 0 FROM nd UNION SELECT w.subject, w.s, ge.b, w.h + 1 FROM walk w JOIN ge ON ge.subject = w.subject AND ge.a = w.v WHERE w.h < 7), ds AS (SELECT subject, s, v, min(h) AS h FROM walk WHERE s <> v GROUP BY ALL), nn AS (SELECT subject, count(*) AS n FROM nd GROUP BY subject) SELECT nn.subject, count(h) = any_value(n * (n - 1)) AS is_connected, CASE WHEN count(h) = any_value(n * (n - 1)) THEN avg(h) END AS average_shortest_path, CASE WHEN count(h) = any_value(n * (n - 1)) THEN max(h) END AS diameter, coalesce(sum(1.0 / h), 0) / any_value(n * (n - 1)) AS global_efficiency FROM nn LEFT JOIN ds USING (subject) GROUP BY nn.subject", "rec")).replace("WITH ", "WITH RECURSIVE ", 1))
register("local_efficiency", "local efficiency", "subject:s local_efficiency:d", lambda s, d: _graph(s, d, graph.local_efficiency), (T.sql(_CORR + _GRAPH + ", walk(subject, u, s, v, h) AS (SELECT subject, a, b, b, 0 FROM ge UNION SELECT w.subject, w.u, w.s, e.b, w.h + 1 FROM walk w JOIN ge e ON e.subject = w.subject AND e.a = w.v JOIN ge o ON o.subject = w.subject AND o.a = w.u AND o.b = e.b WHERE w.h < 7), ds AS (SELECT subject, u, s, v, min(h) AS h FROM walk WHERE s <> v GROUP BY ALL), per AS (SELECT subject, u, sum(1.0 / h) AS t FROM ds GROUP BY ALL) SELECT dg.subject, avg(CASE WHEN d >= 2 THEN coalesce(t, 0) / (d * (d - 1)) ELSE 0 END) AS local_efficiency FROM dg LEFT JOIN per ON per.subject = dg.subject AND per.u = dg.node GROUP BY dg.subject", "rec")).replace("WITH ", "WITH RECURSIVE ", 1))
register("graph_density", "CON18", "subject:s density:d number_of_edges:l number_of_nodes:l", lambda s, d: _graph(s, d, graph.density), T.sql(_CORR + _GRAPH + " SELECT subject, sum(d) / (count(*) * (count(*) - 1)) AS density, sum(d) / 2 AS number_of_edges, count(*) AS number_of_nodes FROM dg GROUP BY subject", "rec"))
register("degree_centrality", "CON19", "subject:s mean_degree_centrality:d std_degree_centrality:d min_degree:l max_degree:l", lambda s, d: _graph(s, d, graph.degree_centrality), T.sql(_CORR + _GRAPH + " SELECT subject, avg(d / 7.0) AS mean_degree_centrality, stddev_pop(d / 7.0) AS std_degree_centrality, min(d) AS min_degree, max(d) AS max_degree FROM dg GROUP BY subject", "rec"))
register("betweenness", "CON20", "subject:s mean_betweenness_centrality:d std_betweenness_centrality:d", lambda s, d: _graph(s, d, graph.betweenness_centrality), T.sql(_CORR + _GRAPH + ", walk(subject, s, v, h, c) AS (SELECT subject, node, node, 0, 1::DOUBLE FROM nd UNION ALL SELECT w.subject, w.s, ge.b, w.h + 1, sum(w.c) FROM walk w JOIN ge ON ge.subject = w.subject AND ge.a = w.v WHERE w.h < 7 GROUP BY w.subject, w.s, ge.b, w.h + 1), ds AS (SELECT subject, s, v, min(h) AS h, arg_min(c, h) AS c FROM walk GROUP BY subject, s, v), bt AS (SELECT p.subject, p.v AS node, sum(p.c * q.c / r.c) AS t FROM ds p JOIN ds q ON q.subject = p.subject AND q.s = p.v JOIN ds r ON r.subject = p.subject AND r.s = p.s AND r.v = q.v AND r.h = p.h + q.h WHERE p.s <> p.v AND q.v <> p.v AND p.s <> q.v GROUP BY ALL) SELECT nd.subject, avg(coalesce(t, 0) / 42.0) AS mean_betweenness_centrality, stddev_pop(coalesce(t, 0) / 42.0) AS std_betweenness_centrality FROM nd LEFT JOIN bt USING (subject, node) GROUP BY nd.subject", "rec").replace("WITH ", "WITH RECURSIVE ", 1))
register("cross_freq_coupling", "CON22", "subject:s coupling:d", lambda s, d: connectivity.coupling(_phases(s, d), _phases(s, d).withColumn("x", F.col("x") * 0.5 + 1)), T.sql(_PH + ", pq AS (SELECT a.subject, a.ch AS i, b.ch AS j, sqrt(pow(avg(cos(a.x - (b.x * 0.5 + 1))), 2) + pow(avg(sin(a.x - (b.x * 0.5 + 1))), 2)) AS w FROM ph a JOIN ph b ON a.subject = b.subject AND a.n = b.n AND a.ch <> b.ch GROUP BY ALL) SELECT subject, avg(w) AS coupling FROM pq GROUP BY subject", "rec"))
register("global_sync", "CON23", "subject:s global_synchronization:d", lambda s, d: connectivity.global_synchronization(_phases(s, d)), T.sql(_PH + ", r AS (SELECT subject, n, sqrt(pow(avg(cos(x)), 2) + pow(avg(sin(x)), 2)) AS r FROM ph GROUP BY ALL) SELECT subject, avg(r) AS global_synchronization FROM r GROUP BY subject", "rec"))
register("epoch_connectivity", "CON24 CON1 CON2", "subject:s i:s j:s w:d", lambda s, d: connectivity.plv(T.rec(s, d).withColumn("subject", F.concat("subject", F.lit("_epoch_"), F.floor(F.col("n") / 80).cast("string"))).withColumn("x", F.col("x") * 12)), T.sql(", ph AS (SELECT subject || '_epoch_' || (n // 80) AS subject, ch, n, x * 12 AS x FROM rec)" + _PLV + " SELECT * FROM e", "rec"))

# --- fusion and tabular ----------------------------------------------------------------------------------------------

_STORE = "WITH st AS (SELECT CAST(user_id AS VARCHAR) AS subject, event_type AS task, 'amp' AS ftype, 'total' AS name, sum(ln(1 + value)) AS value FROM events GROUP BY ALL)"


def _store(s: SparkSession, d: str) -> DataFrame:
    return T.ev(s, d).groupBy("subject", F.col("ch").alias("task")).agg(F.sum("x").alias("value")).select("subject", "task", F.lit("amp").alias("ftype"), F.lit("total").alias("name"), "value")


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return T.read(s, d, "embeddings").select(F.col("vec_id").cast("string").alias("subject"), F.lit("rest").alias("task"), F.lit("emb").alias("ftype"), F.lit("v").alias("name"), F.col("embedding").alias("values"))


register("fuse_flatten", "FUS1 M8 M9", "subject:s feature:s value:d", lambda s, d: fusion.flatten(_store(s, d), _vectors(s, d)), _STORE + " SELECT subject, task || '_' || ftype || '_' || name AS feature, value FROM st UNION ALL SELECT CAST(vec_id AS VARCHAR), 'rest_emb_v_' || (generate_subscripts(embedding, 1) - 1), CAST(unnest(embedding) AS DOUBLE) FROM embeddings")
register("subject_union", "FUS2", "subject:s", lambda s, d: fusion.subjects(_store(s, d), _vectors(s, d)), _STORE + " SELECT subject FROM st UNION SELECT CAST(vec_id AS VARCHAR) FROM embeddings")
register("fuse_pivot", "FUS2 M10", "subject:s click:d error:d purchase:d signup:d view:d", lambda s, d: fusion.pivot(_store(s, d), "subject", "task", "value", T.STATES), _STORE + " SELECT subject, " + ", ".join(f"max(value) FILTER (task = '{x}') AS {x}" for x in T.STATES) + " FROM st GROUP BY subject")
register("task_table", "FUS3", "subject:s task:s amp_total:d", lambda s, d: fusion.per_task(_store(s, d), ["amp_total"]), _STORE + " SELECT subject, task, value AS amp_total FROM st")
_HOLES = "holes AS (SELECT id, name, CASE WHEN value > 0.25 THEN NULL ELSE value END AS value FROM ft)"


def _holes(s: SparkSession, d: str) -> DataFrame:
    return T.ft(s, d).select("id", "name", F.when(~(F.col("value") > 0.25), F.col("value")).alias("value"))


register("impute_median", "FUS5", "id:l name:s value:d", lambda s, d: fusion.impute_median(_holes(s, d)), T.sql(f", {_HOLES} SELECT id, h.name, coalesce(value, m) AS value FROM holes h JOIN (SELECT name, quantile_cont(value, 0.5) AS m FROM holes GROUP BY name) USING (name)", "ft"))
register("impute_mode", "FUS6", "doc_id:l quality:l", lambda s, d: fusion.impute_mode(_labelled(s, d).select("doc_id", "quality"), "quality"), _LAB + " SELECT doc_id, coalesce(quality, (SELECT quality FROM l WHERE quality IS NOT NULL GROUP BY quality ORDER BY count(*) DESC, quality LIMIT 1)) AS quality FROM l")
register("standard_scale", "FUS7", "id:l name:s value:d", lambda s, d: fusion.scale(T.ft(s, d), "standard"), T.sql("SELECT id, name, (value - avg(value) OVER w) / coalesce(nullif(stddev_pop(value) OVER w, 0), 1) AS value FROM ft WINDOW w AS (PARTITION BY name)", "ft"))
register("minmax_scale", "FUS8", "id:l name:s value:d", lambda s, d: fusion.scale(T.ft(s, d), "minmax"), T.sql("SELECT id, name, coalesce((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 0) AS value FROM ft WINDOW w AS (PARTITION BY name)", "ft"))
register("robust_scale", "robust", "id:l name:s value:d", lambda s, d: fusion.scale(T.ft(s, d), "robust"), T.sql("SELECT id, ft.name, (value - b) / (c - a) AS value FROM ft JOIN (SELECT name, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.5) AS b, quantile_cont(value, 0.75) AS c FROM ft GROUP BY name) USING (name)", "ft"))
register("no_scale", "FUS9", "id:l name:s value:d", lambda s, d: fusion.scale(T.ft(s, d), "none"), T.sql("SELECT id, name, value FROM ft", "ft"))
_ANOVA = ", pc AS (SELECT name, label, count(*) AS n, sum(value) AS s, sum(value * value) AS ss FROM ft GROUP BY ALL), an AS (SELECT name, (sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1) / ((sum(ss) - sum(s * s / n)) / (sum(n) - count(*))) AS f_score FROM pc GROUP BY name)"
register("select_anova", "FUS11", "name:s f_score:d rank:l", lambda s, d: fusion.select_k(fusion.anova(T.ft(s, d)), "f_score", 20), T.sql(_ANOVA + " SELECT *, row_number() OVER (ORDER BY f_score DESC, name) AS rank FROM an QUALIFY rank <= 20", "ft"))
register("select_mi", "FUS11", "name:s mi:d", lambda s, d: fusion.mutual_information(T.ft(s, d)), T.sql(", b AS (SELECT name, label, least(9, CAST(floor((value - min(value) OVER w) * 10 / (max(value) OVER w - min(value) OVER w)) AS INTEGER)) AS b FROM ft WINDOW w AS (PARTITION BY name)), j AS (SELECT name, label, b, count(*) AS c FROM b GROUP BY ALL), m AS (SELECT *, sum(c) OVER (PARTITION BY name) AS n, sum(c) OVER (PARTITION BY name, b) AS nb, sum(c) OVER (PARTITION BY name, label) AS nl FROM j) SELECT name, sum(c / n * ln(c * n / (nb * nl))) AS mi FROM m GROUP BY name", "ft"))
register("feature_summary", "FUS12", "name:s count:l nulls:l mean:d std:d min:d q25:d q50:d q75:d max:d", lambda s, d: fusion.describe(_holes(s, d)), T.sql(f", {_HOLES} SELECT name, count(value) AS count, count(*) - count(value) AS nulls, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, max(value) AS max FROM holes GROUP BY name", "ft"))
register("feature_prefixes", "FUS12", "prefix:s n_features:l", lambda s, d: fusion.prefix_counts(fusion.flatten(_store(s, d), _vectors(s, d)).select("feature").distinct()), _STORE + " SELECT 'rest_emb' AS prefix, (SELECT max(len(embedding)) FROM embeddings) AS n_features UNION ALL SELECT task || '_amp', 1 FROM st GROUP BY task")


def _wide(s: SparkSession, d: str) -> tuple[DataFrame, list[str]]:
    names = [f"f{i:02d}" for i in range(64)]
    return fusion.pivot(fusion.scale(T.ft(s, d), "standard"), "id", "name", "value", names), names


def _pca(s: SparkSession, d: str) -> DataFrame:
    wide, names = _wide(s, d)
    return fusion.apply_pca(fusion.fit_pca(wide, names, 3), wide, ["id"])


def _chain(s: SparkSession, d: str, settings: fused.Settings) -> DataFrame:
    """Fitted on four of five ids, saved, loaded and applied to the fifth."""
    rows = T.ft(s, d).withColumn("value", F.when(~(F.col("value") > 0.25), F.col("value")))
    path = shared_dir(s, "fused")
    fused.fit(rows.where("id % 5 <> 0"), settings).save(path)
    return fused.load(s, path).apply(rows.where("id % 5 = 0"))


_CHAIN = """, h AS (SELECT id, label, name, CASE WHEN value > 0.25 THEN NULL ELSE value END AS value FROM ft),
 md AS (SELECT name, quantile_cont(value, 0.5) AS m FROM h WHERE id % 5 <> 0 GROUP BY name),
 fl AS (SELECT id, label, name, coalesce(value, m) AS value FROM h JOIN md USING (name)),
 sc AS (SELECT name, avg(value) AS a, stddev_pop(value) AS b FROM fl WHERE id % 5 <> 0 GROUP BY name),
 pc AS (SELECT name, label, count(*) AS n, sum(value) AS s, sum(value * value) AS ss FROM fl WHERE id % 5 <> 0 GROUP BY ALL),
 an AS (SELECT name, (sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1) / ((sum(ss) - sum(s * s / n)) / (sum(n) - count(*))) AS f_score FROM pc GROUP BY name QUALIFY row_number() OVER (ORDER BY f_score DESC, name) <= 20)
 SELECT id, name, (value - a) / b AS value FROM fl JOIN sc USING (name) JOIN an USING (name) WHERE id % 5 = 0"""
register("fusion_chain", "FUS4 FUS13 SNK10 SRC14 FUS5 FUS7 FUS11", "id:l name:s value:d", lambda s, d: _chain(s, d, fused.Settings("standard", "f_classif", 20)), T.sql(_CHAIN, "ft"))
register("fusion_chain_pca", "FUS4 FUS13 SNK10 FUS10", "id:l name:s value:d", lambda s, d: _chain(s, d, fused.Settings("standard", "f_classif", 20, 5)))
register("pca", "FUS10", "id:l pca_component_0:d pca_component_1:d pca_component_2:d", _pca)

# --- models and evaluation -------------------------------------------------------------------------------------------


def _xy(s: SparkSession, d: str) -> DataFrame:
    return T.read(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("xs"))


def _scored(s: SparkSession, d: str) -> DataFrame:
    docs = T.read(s, d, "documents").join(T.read(s, d, "labels"), "doc_id")
    score = (F.col("n_chars") % 97) / 97.0 + F.col("quality") * 0.1
    return docs.select("doc_id", F.col("quality").alias("label"), score.alias("score"), (score > 0.5).cast("int").alias("prediction"))


_SC = "WITH sc AS (SELECT doc_id, quality AS label, (n_chars % 97) / 97.0::DOUBLE + quality * 0.1::DOUBLE AS score, CAST((n_chars % 97) / 97.0::DOUBLE + quality * 0.1::DOUBLE > 0.5::DOUBLE AS INTEGER) AS prediction FROM documents JOIN labels USING (doc_id))"
register("stratified_folds", "ML4", "label:l fold:l n:l", lambda s, d: evaluation.stratified_folds(_xy(s, d), "id", "label").groupBy("label", "fold").agg(F.count("*").alias("n")), "SELECT label, f AS fold, c // 5 + CASE WHEN f < c % 5 THEN 1 ELSE 0 END AS n FROM (SELECT label, count(*) AS c FROM embeddings GROUP BY label), (SELECT unnest(range(5)) AS f)")
register("train_test_split", "ML5", "label:l split:s n:l", lambda s, d: evaluation.train_test_split(_xy(s, d), "id", "label").groupBy("label", "split").agg(F.count("*").alias("n")), "WITH c AS (SELECT label, count(*) AS c FROM embeddings GROUP BY label) SELECT label, 'test' AS split, (c + 4) // 5 AS n FROM c UNION ALL SELECT label, 'train', c - (c + 4) // 5 FROM c")
_KNN = "WITH p AS (SELECT a.vec_id AS id, b.vec_id AS other, b.label, round(list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, other) AS k FROM p), v AS (SELECT id, label, count(*) AS n FROM r WHERE k <= 5 GROUP BY ALL)"
register("knn_predict", "ML8", "id:l prediction:l", lambda s, d: evaluation.knn(_xy(s, d), _xy(s, d), 5), _KNN + " SELECT id, label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS k FROM v) WHERE k = 1")
register("classification_metrics", "ML10 ML14", "accuracy:d balanced_accuracy:d precision:d recall:d f1:d", lambda s, d: evaluation.metrics(_scored(s, d)), _SC + ", cl AS (SELECT DISTINCT label AS c FROM sc), m AS (SELECT c, (SELECT count(*) FROM sc WHERE label = c) AS sup, (SELECT count(*) FROM sc WHERE label = c AND prediction = c) AS hit, (SELECT count(*) FROM sc WHERE prediction = c) AS gu FROM cl), pr AS (SELECT *, coalesce(hit / nullif(gu, 0), 0) AS p, hit / sup AS r FROM m) SELECT sum(hit) / sum(sup) AS accuracy, avg(r) AS balanced_accuracy, sum(p * sup) / sum(sup) AS precision, sum(r * sup) / sum(sup) AS recall, sum(coalesce(2 * p * r / nullif(p + r, 0), 0) * sup) / sum(sup) AS f1 FROM pr")
register("confusion", "ML10", "truth:l guess:l n:l", lambda s, d: evaluation.confusion(_scored(s, d)), _SC + " SELECT label AS truth, prediction AS guess, count(*) AS n FROM sc GROUP BY ALL")
register("roc_auc", "ML11", "auc:d", lambda s, d: evaluation.roc_auc(_scored(s, d)), _SC + ", r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM sc) SELECT (sum(r) FILTER (label = 1) - count(*) FILTER (label = 1) * (count(*) FILTER (label = 1) + 1) / 2.0) / (count(*) FILTER (label = 1) * count(*) FILTER (label <> 1)) AS auc FROM r")


def _ftnd(s: SparkSession, d: str) -> DataFrame:
    return T.read(s, d, "customer").withColumn("score", F.when(F.col("c_custkey") % 13 != 0, F.pmod(F.col("c_custkey") * 7, F.lit(11))).cast("int"))


_FT = "WITH q AS (SELECT c_custkey, CASE WHEN c_custkey % 13 <> 0 THEN c_custkey * 7 % 11 END AS score FROM customer)"
register("ftnd_label", "ML16 M11 M12", "c_custkey:l label:l", lambda s, d: _ftnd(s, d).select("c_custkey", evaluation.dependence_label(F.col("score")).alias("label")), _FT + " SELECT c_custkey, CASE WHEN coalesce(score, 0) >= 6 THEN 1 ELSE 0 END AS label FROM q")
register("dependence_level", "ML22", "c_custkey:l level:s", lambda s, d: _ftnd(s, d).select("c_custkey", evaluation.dependence_level(F.col("score")).alias("level")), _FT + " SELECT c_custkey, CASE WHEN score BETWEEN 0 AND 3 THEN 'low' WHEN score BETWEEN 4 AND 6 THEN 'moderate' WHEN score BETWEEN 7 AND 10 THEN 'high' END AS level FROM q")
register("label_default", "ML17", "doc_id:l quality:l", lambda s, d: evaluation.with_default_label(T.read(s, d, "documents").select("doc_id"), T.read(s, d, "labels"), "doc_id", "quality"), "SELECT d.doc_id, coalesce(quality, 0) AS quality FROM documents d LEFT JOIN labels USING (doc_id)")
register("class_distribution", "ML18", "label:l n:l", lambda s, d: evaluation.class_distribution(_xy(s, d), "label"), "SELECT label, count(*) AS n FROM embeddings GROUP BY label")
register("best_model", "ML19", "model:s accuracy:d", lambda s, d: evaluation.best_model(T.read(s, d, "events").groupBy(F.col("event_type").alias("model")).agg((F.count_if(F.col("value") > 10) / F.count("*")).alias("accuracy"))), "SELECT event_type AS model, count(*) FILTER (value > 10) / count(*) AS accuracy FROM events GROUP BY event_type ORDER BY accuracy DESC, model LIMIT 1")
register("importance_table", "ML20", "feature:s importance:d", lambda s, d: evaluation.importance_table(fusion.anova(T.ft(s, d)).select(F.col("name").alias("feature"), F.col("f_score").alias("importance"))), T.sql(_ANOVA + " SELECT name AS feature, f_score AS importance FROM an", "ft"))
register("column_exclusion", "ML21", "p_partkey:l p_size:l p_retailprice:d", lambda s, d: T.read(s, d, "part").drop("p_name", "p_brand", "p_type"), "SELECT p_partkey, p_size, p_retailprice FROM part")
_ITEMS = {"attention_impulsiveness": ["q1", "q2"], "motor_impulsiveness": ["q3", "q4", "q5"], "non_planning_impulsiveness": ["q6", "q7", "q8"]}


def _answers(s: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    return T.read(s, d, "customer").select(key.cast("string").alias("subject"), *[(F.pmod(key * (i + 3), F.lit(5)) + (1 if i % 2 else 0)).alias(f"q{i}") for i in range(1, 9)])


register("subscale_scores", "ML23", "subject:s attention_impulsiveness:l motor_impulsiveness:l non_planning_impulsiveness:l total:l valid:b", lambda s, d: evaluation.subscale_scores(_answers(s, d), _ITEMS), "WITH a AS (SELECT CAST(c_custkey AS VARCHAR) AS subject, " + ", ".join(f"c_custkey * {i + 3} % 5 + {1 if i % 2 else 0} AS q{i}" for i in range(1, 9)) + " FROM customer) SELECT subject, q1 + q2 AS attention_impulsiveness, q3 + q4 + q5 AS motor_impulsiveness, q6 + q7 + q8 AS non_planning_impulsiveness, q1 + q2 + q3 + q4 + q5 + q6 + q7 + q8 AS total, " + " AND ".join(f"q{i} BETWEEN 1 AND 4" for i in range(1, 9)) + " AS valid FROM a")


def _binary(s: SparkSession, d: str) -> DataFrame:
    return models.vectors(_xy(s, d).withColumn("label", (F.get("xs", F.lit(0)) + F.get("xs", F.lit(1)) > 0).cast("int")))


def _fitted(name: str, **params) -> Query:
    """Metrics on the test part of a stratified split of a model fitted on the other part."""

    def run(s: SparkSession, d: str) -> DataFrame:
        rows = evaluation.train_test_split(_binary(s, d), "id", "label")
        pred = models.create(name, **params).fit(rows.where("split = 'train'")).transform(rows.where("split = 'test'"))
        return evaluation.metrics(pred.withColumn("prediction", F.col("prediction").cast("int")))

    return run


_METRICS = "accuracy:d balanced_accuracy:d precision:d recall:d f1:d"
register("logistic_regression", "ML9 ML13 ML14", _METRICS, _fitted("logistic_regression"))
register("random_forest", "ML7 ML13", _METRICS, _fitted("random_forest"))
register("svm", "ML6 ML13", _METRICS, _fitted("svm"))
register("knn", "ML8 ML13", _METRICS, _fitted("knn"))


def _classes(s: SparkSession, d: str) -> DataFrame:
    """A polynomial machine on all labels of the embeddings: how its guesses on the test part fall."""
    rows = models.vectors(written(evaluation.train_test_split(_xy(s, d), "id", "label"), "split"))  # each look at them would split them anew
    model = models.create("svm", kernel="poly", degree=2, coef0=1.0, gamma="auto").fit(rows.where("split = 'train'"))
    return evaluation.confusion(model.transform(rows.where("split = 'test'")).withColumn("prediction", F.col("prediction").cast("int")))


register("svm_classes", "ML6", "truth:l guess:l n:l", _classes)

#: The configured grids, but for parameters that only steer another library's solver; of each list a part that is named here.
GRIDS = {
    "svm": {"kernel": ["rbf", "linear", "poly"], "n_features": [128]},
    "random_forest": {"n_estimators": [50, 100], "max_depth": [3, 5]},
    "knn": {"n_neighbors": [3, 5, 7], "weights": ["uniform", "distance"]},
    "logistic_regression": {"C": [0.01, 0.1, 1.0, 10.0, 100.0]},
    "unknown": {},
}


def _grid(s: SparkSession, d: str) -> DataFrame:
    return models.summary_table(s, models.train_models(_binary(s, d), GRIDS, k=5)).withColumn("failed", F.col("error").isNotNull())


def _importance(s: SparkSession, d: str) -> DataFrame:
    model = models.create("random_forest", max_depth=5).fit(_binary(s, d))
    return s.createDataFrame(models.feature_importance(model, [f"f{k:02d}" for k in range(64)]), "feature string, importance double")


def _explained(s: SparkSession, d: str) -> DataFrame:
    """Shapley values of the test part of a split, of a forest grown on the other part."""
    rows = evaluation.train_test_split(_binary(s, d), "id", "label")
    return explain.shapley_values(models.create("random_forest", max_depth=5).fit(rows.where("split = 'train'")), rows.where("split = 'test'").select("id", "xs"))


def _surrogates(s: SparkSession, d: str) -> DataFrame:
    """Local weights of a logistic model for the test part of a split."""
    rows = evaluation.train_test_split(_binary(s, d), "id", "label")
    model = models.create("logistic_regression", C=1.0).fit(rows.where("split = 'train'"))
    found = explain.local_surrogates(model, rows.where("split = 'test'").select("id", "xs"))
    return found.select("id", "r2", F.posexplode("weights").alias("feature", "weight"))


register("shapley_values", "tree SHAP", "id:l feature:l value:d base:d", _explained)
register("shapley_importance", "tree SHAP ML12", "feature:l importance:d", lambda s, d: explain.shapley_importance(_explained(s, d)))
register("local_surrogates", "local surrogate explanations", "id:l feature:l weight:d r2:d", _surrogates)
def _permuted(s: SparkSession, d: str) -> DataFrame:
    """Loss of accuracy on the test part when each of the first eight features comes from other rows."""
    rows = evaluation.train_test_split(_binary(s, d), "id", "label")
    model = models.create("logistic_regression", C=1.0).fit(rows.where("split = 'train'"))
    test = rows.where("split = 'test'").select("id", "label", "xs").persist()
    try:
        found = [(f"f{k:02d}", float(models.permutation_importance(model, test, k))) for k in range(8)]
    finally:
        test.unpersist()
    return s.createDataFrame(found, "feature string, importance double")


def _reread(s: SparkSession, d: str) -> DataFrame:
    """The fused feature table, saved and read back from its CSV side."""
    path = shared_dir(s, "table")
    recordings.save_table(fusion.pivot(_store(s, d), "subject", "task", "value", T.STATES), path)
    return recordings.load_table(s, path, "csv")


register("permutation_importance", "ML12", "feature:s importance:d", _permuted)
register("features_from_csv", "SRC12 SNK7", "subject:s " + " ".join(f"{x}:d" for x in T.STATES), _reread, _STORE + " SELECT subject, " + ", ".join(f"max(value) FILTER (task = '{x}') AS {x}" for x in T.STATES) + " FROM st GROUP BY subject")


def _saved_epochs(s: SparkSession, d: str) -> DataFrame:
    """Epochs saved by task and subject, and one subject's read back."""
    path = shared_dir(s, "epochs")
    recordings.save_samples(T.ep(s, d).withColumn("task", F.lit("rest")), path)
    return recordings.load_samples(s, path).where("subject = 'S3'").withColumn("subject", F.col("subject").cast("string"))


register("saved_epochs", "SNK2 SRC11 SNK1 SRC10", "subject:s epoch:l code:l ch:s k:l x:d", _saved_epochs, T.sql("SELECT subject, epoch, code, ch, k, x FROM ep WHERE subject = 'S3'", "ep"))
register("grid_search", "ML1 ML2 ML3 ML15 M14", "model:s cv_score:d params:s best:b failed:b", _grid)
register("feature_importance", "ML12", "feature:s importance:d", _importance)

# --- utilities -------------------------------------------------------------------------------------------------------

register("safe_filename", "UTL7", "page_id:l name:s", lambda s, d: T.read(s, d, "pages").select("page_id", text.safe_filename(F.col("url")).alias("name")), "SELECT page_id, regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(url, '[<>:\"/\\\\|?*]', '_', 'g')), '\\s+', '_', 'g'), '\\.+', '.', 'g'), '^\\.+|\\.+$', '', 'g') AS name FROM pages")
register("format_duration", "UTL6", "o_orderkey:l text:s", lambda s, d: T.read(s, d, "orders").select("o_orderkey", text.format_duration(F.pmod("o_orderkey", F.lit(9000)).cast("double")).alias("text")), "SELECT o_orderkey, CASE WHEN s < 60 THEN format('{:.1f}', s) || '秒' WHEN s < 3600 THEN format('{:.1f}', s / 60) || '分钟' ELSE format('{:.1f}', s / 3600) || '小时' END AS text FROM (SELECT o_orderkey, CAST(o_orderkey % 9000 AS DOUBLE) AS s FROM orders)")
register("format_file_size", "UTL9 UTL5", "o_orderkey:l text:s", lambda s, d: T.read(s, d, "orders").select("o_orderkey", text.format_file_size(F.col("o_orderkey") * F.col("o_orderkey") * 7).alias("text")), "SELECT o_orderkey, CASE WHEN b = 0 THEN '0B' WHEN b < 1024 THEN format('{:.1f}B', b) WHEN b < 1048576 THEN format('{:.1f}KB', b / 1024) WHEN b < 1073741824 THEN format('{:.1f}MB', b / 1048576) WHEN b < 1099511627776 THEN format('{:.1f}GB', b / 1073741824) ELSE format('{:.1f}TB', b / 1099511627776) END AS text FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey * 7 AS DOUBLE) AS b FROM orders)")
register("file_suffix", "UTL12", "name:s suffix:s", lambda s, d: _files(s, d).select("name", text.file_suffix(F.col("name")).alias("suffix")), f"{_MANIFEST} SELECT name, ext AS suffix FROM man")
