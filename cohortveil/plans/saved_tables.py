"""The small tables that people edit between runs, kept as versions: assignment lists, selections and picks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import identity, tables
from ..sources import versions


def save_assignments(now: DataFrame, root: str) -> int:
    """This run's IDs (match_key, new_id) over those of earlier ones; gives the new version's number."""
    change = lambda old: now.select("match_key", "new_id") if old is None else identity.merged_list(old, now)
    return versions.change(now.sparkSession, root, change)


def save_selection(new: DataFrame, root: str) -> int:
    """Ticked series (study_id, series_uid) in place of all that were ticked for these studies; a blank series clears a study."""
    fresh = new.select("study_id", "series_uid")
    return versions.change(new.sparkSession, root, lambda old: tables.replaced(fresh.limit(0) if old is None else old, fresh))


def clear_selection(gone: DataFrame, root: str) -> int:
    """A selection without the studies in `gone`."""
    return versions.change(gone.sparkSession, root, lambda old: tables.without(gone.select("study_id").limit(0) if old is None else old, gone))


def save_pick(series: DataFrame, study_id: str, root: str) -> int:
    """One study's picks replaced by a series (series_uid, description, slice_mm); thick ones come with a warning."""
    spark = series.sparkSession
    none = spark.createDataFrame([], "study_id string, series_uid string, series_description string")
    return versions.change(spark, root, lambda old: tables.pick_override(none if old is None else old, study_id, series))


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame | None:
    """A table as last saved, or an earlier version of it."""
    return versions.read(spark, root, version)
