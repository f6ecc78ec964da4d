"""Who is who: ID mappings, manifests, stable new IDs, output names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import name_in, natural_key, padded, safe_name, whole_text
from ..sources.scratch import stored


def key_of(column: Column) -> Column:
    return F.upper(F.trim(column))


def clean_mapping(mapping: DataFrame) -> DataFrame:
    """key (upper case, trimmed) and study_id from key, study_id and row; blank rows go, the last of a repeated key stays."""
    rows = mapping.select(key_of(F.col("key")).alias("key"), F.trim("study_id").alias("study_id"), "row").where("key <> '' AND study_id <> ''")
    return rows.groupBy("key").agg(F.max_by("study_id", "row").alias("study_id"))


def mapped(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """Files with the study_id of their source_key; files without one never pass."""
    return files.withColumn("key", key_of(F.col("source_key"))).join(mapping, "key").drop("key")


def unmapped(files: DataFrame, mapping: DataFrame) -> DataFrame:
    """What no mapping row names, and what no file has: source_key, files_skipped and note."""
    keyed = files.withColumn("key", key_of(F.col("source_key")))
    lost = keyed.join(mapping, "key", "left_anti").groupBy("source_key").agg(F.count("*").alias("files_skipped")).withColumn("note", F.lit("scans on disk but no mapping row"))
    idle = mapping.join(keyed.select("key").distinct(), "key", "left_anti").select(F.col("key").alias("source_key"), F.lit(0).cast("long").alias("files_skipped"), F.lit("mapping row but no scans found on disk").alias("note"))
    return lost.unionByName(idle)


def parents(path: Column) -> Column:
    """All folders that a path lies in, itself included."""
    steps = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))


def under_folders(files: DataFrame, manifest: DataFrame, *more: str) -> DataFrame:
    """Files with the study_id of each manifest folder that holds them, and `more` of the manifest's columns.

    A prefix join without a range: a file offers every folder above it, and
    folders match by equality.
    """
    offered = files.withColumn("folder", F.explode(parents(F.col("path"))))
    return offered.join(manifest.select(F.regexp_replace("source_folder", "/+$", "").alias("folder"), "study_id", *more), "folder").drop("folder")


def top_folder(path: Column, root: str = "") -> Column:
    """The first step of a relative path, by which files are matched to a mapping; a file at the top belongs to `root`."""
    steps = F.split(path, "/")
    return F.when(F.size(steps) > 1, steps[0]).otherwise(F.lit(root))


def missing_folders(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest rows whose folder holds no file."""
    have = files.select(F.explode(parents(F.col("path"))).alias("folder")).distinct()
    return manifest.withColumn("folder", F.regexp_replace("source_folder", "/+$", "")).join(have, "folder", "left_anti").drop("folder")


def by_skips(files: DataFrame, skips: DataFrame, how: str) -> DataFrame:
    """Files joined to a skip list by path; separators may be of either kind."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, r"^\\\\\?\\", ""), r"\\", "/")
    listed = skips.select(F.regexp_replace(plain(F.trim("path")), "/+$", "").alias("skip")).where("skip <> '' AND NOT startswith(skip, '#')").distinct()
    return files.withColumn("skip", plain(F.col("path"))).join(listed, "skip", how).drop("skip")


def without_skipped(files: DataFrame, skips: DataFrame) -> DataFrame:
    """Files that a skip list doesn't name."""
    return by_skips(files, skips, "left_anti")


def skipped(files: DataFrame, skips: DataFrame) -> DataFrame:
    """Files that a skip list names."""
    return by_skips(files, skips, "left_semi")


def reusable(existing: DataFrame, outputs: DataFrame) -> DataFrame:
    """IDs given before whose study is in the output, complete or not; others pin nothing."""
    there = outputs.select(safe_name(F.col("study_id")).alias("folder")).distinct()
    return existing.withColumn("folder", safe_name(F.col("new_id"))).join(there, "folder", "left_semi").select(*existing.columns)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with nth, their place in order, from 1.

    Ranges are split at sampled quantiles of the whole order, so keys that
    begin alike, or are alike, are spread like others.  A row's range and place
    in it are written once; before them come the sizes of the ranges below, a
    row a range.
    """
    dealt = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    placed = dealt.withColumns({"range": F.shiftright("place", 33), "place": F.col("place").bitwiseAND(F.lit((1 << 33) - 1))})
    below = F.sum("held").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = placed.groupBy("range").agg(F.count("*").alias("held")).select("range", F.coalesce(below, F.lit(0)).alias("below"))
    return placed.join(sizes, "range").withColumn("nth", F.col("below") + F.col("place") + 1).drop("range", "place", "below")


def assign_ids(units: DataFrame, existing: DataFrame, taken: DataFrame, prefix: str = "ANON") -> DataFrame:
    """match_key and new_id of every unit (match_key, sort_key).

    IDs given before stay.  New ones are PREFIX-NNN, numbered in natural order
    after the highest number in use, so no number can be taken.
    """
    known = units.join(existing.select("match_key", F.col("new_id").alias("old_id")), "match_key", "left")
    used = existing.select("new_id").unionByName(taken.select("new_id"))
    number = F.regexp_extract(F.upper("new_id"), f"^{prefix.upper()}-([0-9]+)$", 1)
    highest = used.select(F.coalesce(F.max(number.try_cast("long")), F.lit(0)).alias("highest"), F.lit(1).alias("one"))
    fresh = known.where("old_id IS NULL").withColumn("key", natural_key(F.col("sort_key")))
    placed = numbered(fresh, "key", "match_key")
    total = units.agg(F.count("*").alias("units"))
    n = F.col("highest") + F.col("nth")
    width = F.greatest(F.lit(3), F.length((F.col("highest") + F.col("units")).cast("string")))
    text = n.cast("string")
    new = placed.withColumn("one", F.lit(1)).join(highest, "one").join(total.withColumn("one", F.lit(1)), "one").select("match_key", F.concat(F.lit(f"{prefix}-"), F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, F.lit("0")))).alias("new_id"))
    return known.where("old_id IS NOT NULL").select("match_key", F.col("old_id").alias("new_id")).unionByName(new)


def id_problems(assigned: DataFrame) -> DataFrame:
    """match_key, new_id and problem (blank, characters, duplicate) of IDs that can't be used."""
    new = F.trim(F.coalesce("new_id", F.lit("")))
    same = F.count("*").over(Window.partitionBy(F.upper(safe_name(new))))
    problem = F.when(new == "", "blank").when(~new.rlike("^[A-Za-z0-9._ -]+$"), "characters").when(same > 1, "duplicate")
    return assigned.select("match_key", "new_id", problem.alias("problem")).where("problem IS NOT NULL")


def by_priority(units: DataFrame, mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Units with the new_id of the first of their `keys` that the mapping knows."""
    out, found = units, []
    for k, name in enumerate(keys):
        out = out.join(mapping.select(F.col("key").alias(f"k{k}"), F.col("study_id").alias(f"id{k}")), key_of(F.col(name).cast("string")) == F.col(f"k{k}"), "left")
        found.append(F.col(f"id{k}"))
    return out.select(*units.columns, F.coalesce(*found).alias("new_id"))


def merged_list(earlier: DataFrame, now: DataFrame) -> DataFrame:
    """The cumulative assignment list: this run's IDs over the earlier ones."""
    return earlier.select("match_key", F.col("new_id").alias("old")).join(now.select("match_key", "new_id"), "match_key", "full_outer").select("match_key", F.coalesce("new_id", "old").alias("new_id"))


def earlier_copies(assigned: DataFrame, existing: DataFrame, completed: DataFrame) -> DataFrame:
    """Studies that were renamed and whose copy under the old name is still in the output."""
    both = assigned.join(existing.select("match_key", F.col("new_id").alias("old_id")), "match_key").withColumn("old_name", safe_name(F.col("old_id"))).where(F.col("old_name") != safe_name(F.col("new_id")))
    return both.join(completed.select(F.col("study_id").alias("old_name")).distinct(), "old_name", "left_semi").select("match_key", "old_id", "new_id")


def output_names(images: DataFrame, flat: bool = False) -> DataFrame:
    """study_id, path, folder and name of every output file: see `with_output_names`."""
    return with_output_names(images, flat).select("study_id", "path", "folder", "name")


def with_output_names(images: DataFrame, flat: bool = False) -> DataFrame:
    """images with the folder and name of their output files: a folder a series, or with `flat` a study.

    Objects in quarantine share one folder a study.  Files without an instance
    number are named by a running number, and a name that is already there
    gets the file's number appended.
    """
    safe = F.col("safe")
    # Whatever meets in a folder has its study's safe name, so one shuffle by that serves both numberings.
    dealt = images.withColumn("safe", safe_name(F.col("study_id"))).repartition("safe")
    numbered = dealt.withColumn("counter", F.row_number().over(Window.partitionBy("safe", "study_id").orderBy("path")))
    # A name asks for its numbers many times, so they are columns, each worked out once.
    texts = numbered.withColumns({"sno": F.coalesce(whole_text(F.col("series_number").cast("string")), F.lit("0")), "ino": whole_text(F.col("instance_number"))})
    series = F.concat(F.lit("/S"), padded(F.col("sno"), 3))
    folder = F.when(F.col("review").isNotNull(), F.concat(F.lit("_review/"), safe)).otherwise(safe if flat else F.concat(safe, series))
    named = texts.withColumn("folder", folder).withColumn("name", name_in(safe, F.col("sno"), F.col("ino"), F.col("counter")))
    again = F.row_number().over(Window.partitionBy("safe", "folder", "name").orderBy("path")) > 1
    return named.select(*images.columns, "folder", F.when(again, F.concat(F.regexp_replace("name", r"\.dcm$", "_"), F.col("counter").cast("string"), F.lit(".dcm"))).otherwise(F.col("name")).alias("name"))
