"""Small tables that people edit between runs: selections, picks, lists, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import norm_desc, safe_name
from ..functions.policy import DUMMY_DATE, MAX_SLICE_MM
from .identity import key_of


def replaced(table: DataFrame, new: DataFrame, by: str = "study_id") -> DataFrame:
    """A table with all rows of the studies in `new` replaced by it; blank new rows clear a study."""
    keep = table.join(new.select(by).distinct(), by, "left_anti")
    return keep.unionByName(new.where("series_uid IS NOT NULL AND series_uid <> ''").select(*table.columns))


def without(table: DataFrame, gone: DataFrame, by: str = "study_id") -> DataFrame:
    return table.join(gone.select(by).distinct(), by, "left_anti")


def pick_override(picks: DataFrame, study_id: str, series: DataFrame) -> DataFrame:
    """Picks with one study's replaced by a series (series_uid, description, slice_mm); `warning` tells of thick ones."""
    thick = F.when(F.col("slice_mm") > MAX_SLICE_MM, F.concat(F.lit("thicker than "), F.lit(f"{MAX_SLICE_MM:g} mm: the thin coronary series is used instead")))
    new = series.select(F.lit(study_id).alias("study_id"), "series_uid", F.col("description").alias("series_description"), thick.alias("warning"))
    old = picks.where(F.col("study_id") != study_id).select("study_id", "series_uid", "series_description", F.lit(None).cast("string").alias("warning"))
    return old.unionByName(new)


def survey_kept(survey: DataFrame) -> DataFrame:
    """patient and series_uid of the rows that someone marked keep, however it is written."""
    return survey.where(F.lower(F.trim("decision")) == "keep").select("patient", "series_uid").distinct()


def copy_plan(files: DataFrame, kept: DataFrame) -> DataFrame:
    """source and target of each file of kept series: <patient>/S###/<name>, numbered where a name repeats."""
    own = files.join(kept, ["patient", "series_uid"], "left_semi")
    folder = F.concat_ws("/", safe_name(F.col("patient")), F.concat(F.lit("S"), F.lpad(F.coalesce(F.col("series_number").cast("string"), F.lit("0")), 3, "0")))
    name = F.regexp_extract("path", "([^/]+)$", 1)
    grouped = own.select("path", folder.alias("folder"), name.alias("name")).groupBy("folder", "name").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    each = grouped.select("folder", "name", F.posexplode("paths").alias("nth", "source"))
    return each.select("source", F.concat("folder", F.lit("/"), F.when(F.col("nth") == 0, F.col("name")).otherwise(F.concat(F.col("nth").cast("string"), F.lit("_"), F.col("name")))).alias("target"))


def linkage_needles(links: DataFrame) -> DataFrame:
    """Search words from linkage logs: every original value of four characters or more that is no dummy."""
    columns = [c for c in ("original_patient_id", "original_name", "original_study_date", "original_dob") if c in links.columns]
    values = F.flatten(F.array(*(F.split(F.coalesce(c, F.lit("")), ";") for c in columns)))
    word = F.upper(F.trim("v"))
    return links.select(F.explode(values).alias("v")).select(word.alias("needle")).where((F.length("needle") >= 4) & ~F.col("needle").isin(DUMMY_DATE, "00010101")).distinct()


def report_split(findings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays with the output (one row: PASS or FAIL and how many), and what quotes values and must not."""
    stub = findings.agg(F.count("*").alias("findings")).select(F.when(F.col("findings") == 0, "PASS").otherwise("FAIL").alias("result"), "findings")
    return stub, findings


def output_series(series: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Kept series of each study together with its quarantined ones, which have the verdict review."""
    held = quarantined.select("study_id", "series_uid", "n_files", F.lit("review").alias("verdict"), F.concat(F.lit("quarantined: "), "review").alias("reason"))
    return series.where("decision = 'keep'").select("study_id", "series_uid", F.col("images").alias("n_files"), F.lit("keep").alias("verdict"), "reason").unionByName(held)


def coronary_summary(series: DataFrame) -> DataFrame:
    """What the rule finds in each study, in words."""
    counted = series.groupBy("study_id").agg(F.count_if(F.col("verdict") == "keep").alias("keep"), F.count_if(F.col("verdict") == "maybe").alias("maybe"))
    text = F.when(F.col("keep") > 0, F.concat(F.lit("keep "), F.col("keep").cast("string"), F.lit(" series"))).when(F.col("maybe") > 0, "possibly").otherwise("none")
    return counted.select("study_id", text.alias("found"))


def tick_shown(ticked: DataFrame, shown: DataFrame, on: bool) -> DataFrame:
    """Ticked kinds (modality, kind, slice_mm) with all that a search shows added or taken away."""
    own, other = (t.select("modality", "kind", "slice_mm") for t in (ticked, shown))
    return own.union(other).distinct() if on else own.distinct().exceptAll(own.distinct().intersect(other.distinct()))


def not_this_run(output: DataFrame, now: DataFrame) -> DataFrame:
    """Studies in an output that this run doesn't have, by folder name."""
    return output.withColumn("folder", safe_name(F.col("study_id"))).join(now.select(safe_name(F.col("study_id")).alias("folder")).distinct(), "folder", "left_anti").select("study_id")


def case_mismatch(images: DataFrame) -> DataFrame:
    """Folders that stand for one patient but hold the IDs of several."""
    return images.groupBy("source_folder").agg(F.countDistinct(key_of(F.col("patient_id"))).alias("patients")).where("patients > 1")


def unit_label(folder: Column, key: Column, root: str) -> Column:
    """How a unit is named to people: its folder below the root, or else its patient's ID."""
    rel = F.regexp_replace(folder, f"^{root.rstrip('/')}/?", "")
    return F.when(rel != "", rel).otherwise(key)


def sample_files(files: DataFrame) -> DataFrame:
    """The middle file of each series, in order of paths, by counting: no series is sorted as a whole in one list."""
    middle = files.groupBy("series_uid").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY nth)").alias("nth"))
    return files.join(middle, ["series_uid", "nth"], "left_semi").select("series_uid", "path")


def redaction_log(boxes: DataFrame, by: str, at: str) -> DataFrame:
    """One row an object that was painted: when, by whom, and how many boxes."""
    return boxes.groupBy("instance_id").agg(F.count("*").alias("boxes")).select(F.lit(at).alias("time"), "instance_id", "boxes", F.lit(by).alias("by"))


def started(lines: DataFrame) -> DataFrame:
    """Lines that start a study or count its files: study, and expected or done files."""
    start, beat = r"^\[[0-9]+/[0-9]+\]\s+(\S+): starting(?:, ([0-9]+) files to write)?", r"^\s+(\S+): ([0-9]+) files\.\.\."
    pick = lambda pattern, k: F.nullif(F.regexp_extract("line", pattern, k), F.lit(""))
    return lines.select("line", F.coalesce(pick(start, 1), pick(beat, 1)).alias("study"), pick(start, 2).try_cast("long").alias("expected"), pick(beat, 2).try_cast("long").alias("written")).where("study IS NOT NULL")


def same_pick(series: DataFrame, description: str) -> DataFrame:
    """Series whose description is the same but for case and spacing."""
    return series.where(norm_desc(F.col("description")) == norm_desc(F.lit(description)))
