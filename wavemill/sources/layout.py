"""Dataset trees with inherited metadata: which sidecars apply to a file, merged key by key.

A file's name is entities (key-value, joined by underscores), a suffix and an extension: ``sub-01_task-rest_eeg.set``. A ``.json`` file
applies to a data file of its own suffix in its folder or below if each of its entities is one of the data file's. Of the values that a key has
in the files that apply, the nearest folder's counts; in one folder that of the file with more entities, then of the lesser path. An
event table (suffix ``events``, ``.tsv``) applies alike whatever the data file's suffix, but as a whole: the first of this order.

All are joins by folder and entity: a data file goes with each of its folders, at most as many as its path has, and each of its
entities, so nothing is compared with everything. Cases: paths are relative with slashes; null paths and files without a suffix or extension are left out; a sidecar that holds no
JSON object gives no keys; null values count as absent; a path that comes twice counts once, with the lesser content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavemill.plans.shared import written

SIDECAR, EVENTS = ".json", "events"


def parts(files: DataFrame) -> DataFrame:
    """Add folder ('' for the root), suffix, ext and entities (sorted 'key-value' texts) to files with a path."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    folder = F.regexp_replace(F.regexp_extract("path", "^(.*/)?[^/]*$", 1), "/$", "")
    pieces = F.split(F.regexp_extract(name, r"^([^.]*)", 1), "_")
    out = files.where("path is not null").withColumns({"folder": folder, "ext": F.regexp_extract(name, r"(\..*)$", 1), "pieces": pieces})
    last = F.element_at("pieces", -1)
    entities = F.array_sort(F.array_distinct(F.filter("pieces", lambda p: p.contains("-"))))
    return out.withColumns({"suffix": F.when(~last.contains("-"), last), "entities": entities}).drop("pieces").where("suffix <> '' and ext <> ''")


def folders(folder: Column) -> Column:
    """A folder and all above it, the root ('') last; depth is their place from the end."""
    steps = F.filter(F.split(folder, "/"), lambda s: s != "")
    return F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, 1, k), "/").alias("above")))


def _candidates(data: DataFrame, sides: DataFrame, same_suffix: bool) -> DataFrame:
    """Pairs (path, entities, side, held, depth) of data files and the sidecars, with their entities, that may apply to them.

    They meet by folder and by the sidecar's rarest entity among the data files ('' for one without any), not by folder alone: a folder
    may hold a sidecar of its own for each of its data files.
    """
    by = ["above", "suffix", "entity"] if same_suffix else ["above", "entity"]
    level, kind = F.size(F.filter(F.split("folder", "/"), lambda s: s != "")), F.substring_index("entity", "-", 1)
    counts = data.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("files"))
    each = sides.select("path", F.explode("entities").alias("entity")).join(counts, "entity", "left")
    rarest = each.groupBy("path").agg(F.min_by("entity", F.struct(F.coalesce("files", F.lit(0)), "entity")).alias("entity"))
    side = sides.join(rarest, "path", "left").select(
        F.col("path").alias("side"), F.col("folder").alias("above"), F.col("entities").alias("held"), F.coalesce("entity", F.lit("")).alias("entity"), level.alias("depth"), *([F.col("suffix")] if same_suffix else [])
    )
    up = data.select("path", "entities", "suffix", F.explode(folders(F.col("folder"))).alias("f")).select("path", "entities", "suffix", "f.depth", "f.above", F.explode(F.concat(F.array(F.lit("")), "entities")).alias("entity"))
    asked = side.select("depth", kind.alias("kind")).distinct()  # a row for each name of an entity on each level
    up = up.withColumn("kind", kind).join(asked, ["depth", "kind"], "left_semi")
    return up.join(side.drop("depth"), by).select("path", "entities", "side", "held", "depth")


def _applying(data: DataFrame, sides: DataFrame, same_suffix: bool) -> DataFrame:
    """Pairs (path, side, depth, n_entities) of data files and the sidecars that apply to them."""
    return _candidates(data, sides, same_suffix).where(F.size(F.array_except("held", "entities")) == 0).select("path", "side", "depth", F.size("held").alias("n_entities"))


def _once(files: DataFrame) -> DataFrame:
    return written(parts(files.groupBy("path").agg(F.min(F.col("content").cast("string")).alias("content"))), "dataset-files")


def metadata(files: DataFrame) -> DataFrame:
    """(path, key, value, side): the metadata of each data file of files (path, content), and the sidecar each value comes from."""
    known = _once(files)
    sides = known.where(F.col("ext") == SIDECAR)
    pairs = _applying(known.where(F.col("ext") != SIDECAR), sides, True)
    values = sides.select(F.col("path").alias("side"), F.explode(F.from_json("content", "map<string,string>")).alias("key", "value")).where("value is not null")
    order = F.struct("depth", "n_entities")
    best = pairs.join(values, "side").groupBy("path", "key").agg(F.max(order).alias("top"), F.collect_list(F.struct(order.alias("at"), "side", "value")).alias("all"))
    first = F.array_min(F.transform(F.filter("all", lambda s: s["at"] == F.col("top")), lambda s: F.struct(s["side"].alias("side"), s["value"].alias("value"))))
    return best.withColumn("first", first).select("path", "key", F.col("first.value").alias("value"), F.col("first.side").alias("side"))


def event_tables(files: DataFrame) -> DataFrame:
    """(path, side): the event table of each data file that is none itself; files without one aren't listed."""
    known = _once(files)
    tables = (F.col("suffix") == EVENTS) & (F.col("ext") == ".tsv")
    pairs = _applying(known.where(~tables & (F.col("ext") != SIDECAR)), known.where(tables), False)
    return pairs.groupBy("path").agg(F.min(F.struct((-F.col("depth")).alias("d"), (-F.col("n_entities")).alias("e"), "side")).alias("first")).select("path", "first.side")
