"""From a scan to a plan: units that need an ID, kinds of series, what a choice would keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import norm_desc, number_text
from .identity import parents


def common_folder(folders: Column) -> Column:
    """The longest folder that holds all of a group's folders: what its first and last in order have in common."""
    steps = F.split(folders, "/")
    low, high = F.min(steps), F.max(steps)
    width = F.least(F.size(low), F.size(high))
    same = F.filter(F.sequence(F.lit(1), width), lambda n: F.slice(low, F.lit(1), n) == F.slice(high, F.lit(1), n))
    return F.array_join(F.slice(low, F.lit(1), F.size(same)), "/")


def nested(rows: DataFrame, group: list[str], folder: str) -> DataFrame:
    """rows with `inside`: whether the next folder of the group, in order of its steps, is this one or lies in it."""
    steps = F.split(folder, "/")
    after = F.lead(steps).over(Window.partitionBy(*group).orderBy(steps))
    return rows.withColumn("inside", F.coalesce(F.slice(after, F.lit(1), F.size(steps)) == steps, F.lit(False)))


def units(images: DataFrame) -> DataFrame:
    """patient, study (null if the patient is one unit), folder, files and series of what needs an ID.

    A patient's studies are units of their own if their folders are disjoint;
    otherwise the patient is one.
    """
    folder = F.regexp_replace("path", "/[^/]*$", "")
    own = images.withColumn("folder", folder)
    studies = own.groupBy("patient", "study").agg(common_folder(F.col("folder")).alias("folder"), F.count("*").alias("files"), F.countDistinct("series_uid").alias("series"))
    marked = nested(studies, ["patient"], "folder")
    kind = marked.groupBy("patient").agg(F.max("inside").alias("nests"), F.count("*").alias("studies"))
    split = marked.join(kind, "patient").withColumn("apart", (F.col("studies") > 1) & ~F.col("nests"))
    whole = own.join(split.where("NOT apart").select("patient").distinct(), "patient", "left_semi").groupBy("patient").agg(common_folder(F.col("folder")).alias("folder"), F.count("*").alias("files"), F.countDistinct("series_uid").alias("series"))
    return split.where("apart").select("patient", "study", "folder", "files", "series").unionByName(whole.select("patient", F.lit(None).cast("string").alias("study"), "folder", "files", "series"))


def is_mixed(found: DataFrame) -> DataFrame:
    """One row, `mixed`: whether folders of several patients lie in each other.

    Each folder above or at one that holds scans gets the least and the
    greatest patient of its whole subtree, by a partial aggregate: rows are as
    many as steps in the distinct folders, however many patients share them,
    and no folder's rows meet in one task before they are summed up.
    """
    own = found.groupBy("folder").agg(F.min("patient").alias("low"), F.max("patient").alias("high"))
    under = own.select("low", "high", F.explode(parents(F.col("folder"))).alias("folder")).groupBy("folder").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    return under.join(own.select("folder"), "folder", "left_semi").agg(F.coalesce(F.bool_or(F.col("low") < F.col("high")), F.lit(False)).alias("mixed"))


def headline(found: DataFrame) -> DataFrame:
    """One row on the units of a scan: patients, units, series, images, what a unit is called, and a sentence."""
    totals = found.agg(F.countDistinct(F.coalesce("patient", "folder")).alias("patients"), F.count("*").alias("units"), F.coalesce(F.sum("series"), F.lit(0)).alias("series"), F.coalesce(F.sum("files"), F.lit(0)).alias("images"))
    said = lambda n, one, many: F.concat(F.col(n).cast("string"), F.when(F.col(n) == 1, f" {one}").otherwise(f" {many}"))
    alone = F.col("patients") == F.col("units")
    who = F.when(alone, said("patients", "patient", "patients")).otherwise(F.concat(said("units", "study", "studies"), F.lit(" from "), F.col("patients").cast("string"), F.lit(" patients")))
    told = F.concat(F.lit("Found "), who, F.lit(": "), F.col("series").cast("string"), F.lit(" series, "), F.format_number("images", 0), F.lit(" images."))
    noun = F.when(alone, F.when(F.col("units") == 1, "patient").otherwise("patients")).otherwise(F.when(F.col("units") == 1, "study").otherwise("studies"))
    return totals.select("*", noun.alias("noun"), F.when(F.col("units") == 0, "No DICOM scans were found in this folder.").otherwise(told).alias("headline"))


def kinds(series: DataFrame) -> DataFrame:
    """The same sort of series across studies: modality, description and thickness, with counts and a note."""
    key = [F.col("modality"), norm_desc(F.col("description")).alias("kind"), F.round("slice_mm", 2).alias("slice_mm")]
    grouped = series.groupBy(*key).agg(
        F.countDistinct("study_id").alias("n_units"), F.sum("n_files").alias("n_images"), F.countDistinct(F.when(F.col("verdict") == "keep", F.col("study_id"))).alias("coronary"),
        F.countDistinct(F.when(F.col("verdict") == "maybe", F.col("study_id"))).alias("maybe"), F.min("review").alias("review"), F.min("reason").alias("reason"), F.max_by("sample", F.struct("n_files", "sample")).alias("sample"),
    )
    per = F.rint(F.col("n_images") / F.col("n_units")).cast("long")
    each = F.when(per > 1, F.concat(F.lit(", "), F.format_number(per, 0), F.lit(" images each"))).otherwise("")
    note = (
        F.when((F.col("coronary") > 0) & (F.col("coronary") == F.col("n_units")), "coronary CT")
        .when(F.col("coronary") > 0, F.concat(F.lit("coronary CT in "), F.col("coronary").cast("string"), F.lit(" of "), F.col("n_units").cast("string")))
        .when(F.col("review").isNotNull() & F.col("modality").isin("SR", "DOC", "PR", "KO"), "a report or note: held back for a look")
        .when(F.col("review").isNotNull(), "held back for a look: may carry burned-in text")
        .when(F.col("maybe") > 0, "thin CT, no contrast noted in the header")
        .when(F.col("reason").contains("localiser"), F.concat(F.lit("scout or reformat"), each))
        .otherwise(F.when(per > 1, F.concat(F.format_number(per, 0), F.lit(" images each"))).otherwise("a single image"))
    )
    return grouped.withColumn("note", note)


def search(found: DataFrame, query: str) -> DataFrame:
    """Kinds in which every word of the query occurs, in any case."""
    size = F.coalesce(F.concat(number_text(F.col("slice_mm")), F.lit(" mm")), F.lit(""))
    hay = F.lower(F.concat_ws(" ", "modality", "kind", size, F.replace(size, F.lit(" "), F.lit("")), "note"))
    holds = F.lit(True)
    for word in query.lower().split():
        holds = holds & hay.contains(word)
    return found.where(holds)


def kept_by(series: DataFrame, choice: str, ticked: DataFrame | None = None) -> DataFrame:
    """The series that a choice (coronary, all, choose) keeps; ticked has modality, kind and slice_mm."""
    if choice == "all":
        return series
    if choice == "choose":
        own = series.withColumn("kind", norm_desc(F.col("description"))).withColumn("mm", F.coalesce(F.round("slice_mm", 2), F.lit(-1.0)))
        return own.join(ticked.select("modality", "kind", F.coalesce("slice_mm", F.lit(-1.0)).alias("mm")), ["modality", "kind", "mm"], "left_semi").drop("kind", "mm")
    any_keep = F.max(F.col("verdict") == "keep").over(Window.partitionBy("study_id"))
    return series.withColumn("any_keep", any_keep).where((F.col("verdict") == "keep") | (~F.col("any_keep") & (F.col("verdict") == "maybe"))).drop("any_keep")


def plan(series: DataFrame, choice: str, ticked: DataFrame | None = None) -> DataFrame:
    """One row: units, series and images that a choice keeps, and units that it leaves empty."""
    kept = kept_by(series, choice, ticked).agg(F.countDistinct("study_id").alias("n_units"), F.count("*").alias("n_series"), F.coalesce(F.sum("n_files"), F.lit(0)).alias("n_images"))
    every = series.agg(F.countDistinct("study_id").alias("all_units"))
    return kept.withColumn("one", F.lit(1)).join(every.withColumn("one", F.lit(1)), "one").select("n_units", "n_series", "n_images", (F.col("all_units") - F.col("n_units")).alias("empty"))


def selection_rows(series: DataFrame) -> DataFrame:
    """What a selection file spells out; series without a UID can't be named in one."""
    return series.where(~F.col("series_uid").startswith("nouid-")).select("study_id", "series_uid", "description")
