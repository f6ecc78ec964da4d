"""Logs and status: linkage, summaries, decision history, readiness to share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import nice, nice_date
from ..functions.policy import DUMMY_DATE, TOOL, VERSION, Profile
from ..sources.scratch import stored


def joined_set(column: Column, separator: str = ";") -> Column:
    return F.array_join(F.sort_array(F.collect_set(column)), separator)


def errors_by_study(rejects: DataFrame) -> DataFrame:
    """study_id and errors, of objects that couldn't be read and whose study is known."""
    return rejects.where("study_id IS NOT NULL").groupBy("study_id").agg(F.count("*").alias("errors"))


def with_errors(rows: DataFrame, errors: DataFrame | None) -> DataFrame:
    """rows by study with their number of errors; without a table of these there are none."""
    if errors is None:
        return rows.withColumn("errors", F.lit(0).cast("long"))
    return rows.join(errors, "study_id", "left").withColumn("errors", F.coalesce("errors", F.lit(0).cast("long")))


def linkage(images: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """The only table with original identifiers: per study, its sorted distinct originals and counts; `errors` has study_id and errors."""
    own = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    originals = {"source_key": "patient", "original_patient_id": "patient_id", "original_name": "patient_name", "original_study_date": "study_date", "original_sex": "sex", "original_dob": "birth_date", "original_manufacturer": "scanner"}
    described = F.concat(own("series_number"), F.lit(": "), own("description"))
    found = images.groupBy("study_id").agg(
        *(joined_set(own(c)).alias(name) for name, c in originals.items()), joined_set(described, " | ").alias("original_series_descriptions"),
        F.count("*").alias("files"), F.countDistinct("series_number").alias("series"), F.count_if(F.col("review").isNotNull()).alias("review_files"),
    )
    return with_errors(found, errors)


def study_counts(images: DataFrame, decisions: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """study_id, files, series and review_files that are kept, files of dropped series (`dropped`), and errors, of every study.

    `images` are those of kept series, `decisions` all series with their number
    of images, so what is dropped is known without another pass over images.
    """
    kept = images.groupBy("study_id").agg(F.count("*").alias("files"), F.countDistinct("series_number").alias("series"), F.count_if(F.col("review").isNotNull()).alias("review_files"))
    every = decisions.groupBy("study_id").agg(F.sum(F.when(F.col("decision") == "keep", 0).otherwise(F.col("images"))).cast("long").alias("dropped"), F.max(F.col("decision") == "keep").alias("any"))
    if errors is not None:  # a study may have nothing but objects that can't be read
        every = every.join(errors.select("study_id"), "study_id", "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    counted = every.join(kept, "study_id", "left").select("study_id", zero("files"), zero("series"), zero("review_files"), zero("dropped"), "any")
    return with_errors(counted, errors)


def study_summary(images: DataFrame, decisions: DataFrame, missing: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """study_id, files, series, review_files, errors and status of every study, and of the folders that weren't found."""
    kept = images.join(decisions.where("decision = 'keep'").select("study_id", "series_uid"), ["study_id", "series_uid"], "left_semi")
    return summary_of(study_counts(kept, decisions, errors), missing)


def summary_of(counts: DataFrame, missing: DataFrame) -> DataFrame:
    """`study_counts` with a status, and a row for each study_id in `missing`, whose folder wasn't found."""
    status = F.when(~F.coalesce("any", F.lit(True)), "NO CTCA SERIES").when(F.col("files") == 0, "EMPTY").when(F.col("errors") > 0, "ERRORS").otherwise("OK")
    found = counts.select("study_id", "files", "series", "review_files", "errors", status.alias("status"))
    gone = missing.select("study_id", *(F.lit(0).cast("long").alias(c) for c in ("files", "series", "review_files", "errors")), F.lit("FOLDER NOT FOUND").alias("status"))
    return found.unionByName(gone)


def run_totals(summary: DataFrame) -> DataFrame:
    """Counters of a run and its first 20 empty studies, of which each task passes on 20 at most.

    The summary, a row a study, is written once for both.
    """
    summary = stored(summary)
    counted = summary.agg(F.count("*").alias("studies"), F.sum("files").alias("files"), F.sum("series").alias("series"), F.sum("review_files").alias("review_files"), F.count_if(F.col("files") == 0).alias("empty"))
    first = summary.where("files = 0 AND study_id IS NOT NULL").select("study_id").orderBy("study_id").limit(20)
    return counted.crossJoin(first.agg(F.array_join(F.sort_array(F.collect_list("study_id")), ", ").alias("first_empty")))


def shown_first(names: DataFrame, column: str, most: int = 20) -> DataFrame:
    """One row: the first `most` distinct names in order, comma-joined, and how many more there are, in words.

    Each task passes on its first `most`; the rest is a count.
    """
    own = names.select(F.col(column).alias("name")).where("name IS NOT NULL").distinct()
    first = own.orderBy("name").limit(most).agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias("shown"))
    left = F.col("names") - most
    return own.agg(F.count("*").alias("names")).join(first).select("names", F.concat("shown", F.when(left > 0, F.concat(F.lit(" and "), left.cast("string"), F.lit(" more"))).otherwise("")).alias("shown"))


def tick_counts(selection: DataFrame) -> DataFrame:
    """How many series are ticked for each study, and as a study of null for all, with how many studies."""
    ticked = selection.select("study_id", "series_uid").distinct().groupBy("study_id").agg(F.count("*").alias("ticked"))
    return ticked.withColumn("studies", F.lit(1).cast("long")).unionByName(ticked.agg(F.lit(None).cast("string").alias("study_id"), F.coalesce(F.sum("ticked"), F.lit(0)).alias("ticked"), F.count("*").alias("studies")))


def newest(rows: DataFrame, keys: list[str], run: str = "run") -> DataFrame:
    """The row of the newest run of each key; a partial aggregate, no sort."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(run, *[c for c in rest if c != run])).alias("r")).select(*keys, "r.*")


def needs_look(reason: Column) -> Column:
    return reason.contains("CHECK") | F.lower(reason).contains("fallback")


def decision_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.countDistinct("study_id").alias("studies"), F.count_if(F.col("decision") == "keep").alias("kept"), F.count_if(F.col("decision") == "drop").alias("dropped"), F.count_if(needs_look(F.col("reason"))).alias("check"))


def filter_decisions(rows: DataFrame, mode: str = "All", query: str = "") -> DataFrame:
    """Kept, Dropped, Needs a look or All, of studies whose ID has the query in it."""
    holds = {"Kept": F.col("decision") == "keep", "Dropped": F.col("decision") == "drop", "Needs a look": needs_look(F.col("reason"))}.get(mode, F.lit(True))
    return rows.where(holds & F.contains(F.lower("study_id"), F.lit(query.strip().lower())))


def pending(pairs: DataFrame, completed: DataFrame, mode: str) -> DataFrame:
    """Studies that a resumed run still has to do: those not completed in this mode."""
    return pairs.join(completed.where(F.col("mode") == mode).select("study_id").distinct(), "study_id", "left_anti")


def study_state(outputs: DataFrame, completed: DataFrame) -> DataFrame:
    """complete or partial for each study in the output."""
    done = completed.select("study_id").distinct().withColumn("done", F.lit(True))
    return outputs.select("study_id").distinct().join(done, "study_id", "left").select("study_id", F.when(F.col("done"), "complete").otherwise("partial").alias("state"))


def readiness(facts: DataFrame, *by: str) -> DataFrame:
    """What stands in the way of sharing, for each row of facts (named by `by`): level (block, warn, ok) and title.

    Facts: status (PASS, FAIL or null), verified_at, last_run_at, complete,
    partial, review_files, linkage_files, other_logs and attested.
    """
    n = lambda c: F.col(c).cast("string")
    rule = lambda holds, level, title: F.when(holds, F.struct(F.lit(level).alias("level"), title.alias("title")))
    passed, failed = F.coalesce(F.col("status") == "PASS", F.lit(False)), F.coalesce(F.col("status") == "FAIL", F.lit(False))
    stale = F.coalesce(F.col("verified_at") < F.col("last_run_at"), F.lit(False))
    rules = [
        rule(passed & stale, "warn", F.lit("Check passed, but files have changed since (a run or a redaction)")),
        rule(passed & ~stale, "ok", F.lit("Verify passed")), rule(failed, "block", F.lit("Verify FAILED")), rule(~passed & ~failed, "block", F.lit("Not verified")),
        rule(F.col("complete") == 0, "block", F.lit("No completed studies")), rule(F.col("complete") > 0, "ok", F.concat(n("complete"), F.lit(" completed studies"))),
        rule(F.col("partial") > 0, "warn", F.concat(n("partial"), F.lit(" half-finished studies"))), rule(F.col("review_files") > 0, "warn", F.concat(n("review_files"), F.lit(" quarantined files in _review"))),
        rule(F.col("linkage_files") > 0, "block", F.concat(n("linkage_files"), F.lit(" linkage file(s) still in the output tree"))), rule(F.col("linkage_files") == 0, "ok", F.lit("No linkage file in the output tree")),
        rule(passed & F.col("attested"), "ok", F.lit("Attestation and checksum manifest written")), rule(F.col("other_logs") > 0, "warn", F.concat(n("other_logs"), F.lit(" other confidential log file(s)"))),
    ]
    return facts.select(*by, F.explode(F.array_compact(F.array(*rules))).alias("c")).select(*by, "c.level", "c.title")


def done_headline(facts: DataFrame, *by: str) -> DataFrame:
    """level and headline for an output's present state, for each row of facts (named by `by`)."""
    who = F.concat(F.col("complete").cast("string"), F.when(F.col("complete") == 1, " patient").otherwise(" patients"))
    none = (F.col("complete") == 0) & (F.col("partial") == 0)
    failed, passed = F.coalesce(F.col("status") == "FAIL", F.lit(False)), F.coalesce(F.col("status") == "PASS", F.lit(False))
    stale = F.coalesce(F.col("verified_at") < F.col("last_run_at"), F.lit(False))
    level = F.when(none, "none").when(failed, "error").when(~passed | stale, "warn").otherwise("ok")
    head = F.when(none, "Nothing has been anonymised yet").when(failed, "Check failed: do not share").when(~passed, F.concat(who, F.lit(" anonymised, not yet checked"))).when(stale, F.concat(who, F.lit(" anonymised, but changed since the last check"))).otherwise(F.concat(who, F.lit(" anonymised and verified")))
    return facts.select(*by, level.alias("level"), head.alias("headline"))


#: The plain-language fields, the attributes that they show and how.
FIELDS = (
    ("Name", "PatientName", "name"), ("Hospital number", "PatientID", "text"), ("Other IDs", "OtherPatientIDs", "text"), ("Date of birth", "PatientBirthDate", "date"), ("Sex", "PatientSex", "sex"),
    ("Age", "PatientAge", "age"), ("Address", "PatientAddress", "text"), ("Scan date", "StudyDate", "date"), ("Hospital", "InstitutionName", "text"), ("Referring doctor", "ReferringPhysicianName", "name"),
    ("Accession number", "AccessionNumber", "text"), ("Scanner", "Manufacturer", "text"), ("Scanner", "ManufacturerModelName", "text"), ("Comments", "ImageComments", "text"),
)


def plain_changes(diff: DataFrame) -> DataFrame:
    """instance_id, label, before, after and state (removed, replaced, kept) of the fields that people know."""
    rules = F.array(*(F.struct(F.lit(k).alias("nth"), F.lit(label).alias("label"), F.lit(word).alias("word"), F.lit(kind).alias("kind")) for k, (label, word, kind) in enumerate(FIELDS)))
    words = F.transform(rules, lambda r: r["word"])
    top = diff.where((F.col("grp") == "data") & ~F.col("path").contains(".") & (F.trim("before") != "") & F.array_contains(words, F.col("keyword")))
    shown = top.select("instance_id", "before", "after", "action", F.filter(rules, lambda r: r["word"] == F.col("keyword"))[0].alias("r"))
    part = F.struct("r.nth", nice(F.col("before"), F.col("r.kind")).alias("b"), nice(F.col("after"), F.col("r.kind")).alias("a"), F.trim("after").alias("raw"), "action")
    fields = shown.groupBy("instance_id", "r.label", "r.kind").agg(F.sort_array(F.collect_list(part)).alias("p"))
    before = F.array_join(F.transform("p", lambda x: x["b"]), " ")
    after = F.array_join(F.filter(F.transform("p", lambda x: x["a"]), lambda x: x != ""), " ")
    kept, gone = F.forall("p", lambda x: x["action"] == "kept"), F.forall("p", lambda x: x["raw"] == "")
    first = F.get("p", F.lit(0))["raw"]
    dates = F.when(F.substring(first, 1, 8) == DUMMY_DATE, F.concat(nice_date(first), F.lit(" (dummy)"))).otherwise(F.concat(nice_date(first), F.lit(" (moved)")))
    return fields.select(
        "instance_id", "label", before.alias("before"), F.when(kept, "kept").when(gone, "removed").when(F.col("kind") == "date", dates).otherwise(after).alias("after"),
        F.when(kept, "kept").when(gone, "removed").otherwise("replaced").alias("state"),
    )


def log_lines(lines: DataFrame) -> DataFrame:
    """line with its class (error, warn, ok, plain) and, for progress lines, done, total, study, percent and minutes left."""
    s = F.trim("line")
    error = s.startswith("**") | s.contains("ERROR") | s.startswith("FAIL") | s.contains("Traceback") | s.contains("not found")
    warn = s.contains("CHECK") | s.contains("NO CORONARY") | s.contains("NO DICOM") | s.contains("UNMAPPED") | F.upper(s).contains("WARN")
    ok = s.startswith("PASS") | s.startswith("Done in") | s.startswith("DRY RUN")
    part = lambda k: F.nullif(F.regexp_extract(s, r"^\[([0-9]+)/([0-9]+)\]\s+(\S+)", k), F.lit(""))
    start = F.col("line").rlike(r"^\[[0-9]+/[0-9]+\]\s+\S+: starting")
    number = lambda k: F.when(~start, part(k).try_cast("long"))
    return lines.select(
        *lines.columns, F.when(s == "", "plain").when(error, "error").when(warn, "warn").when(ok, "ok").otherwise("plain").alias("class"),
        number(1).alias("done"), number(2).alias("total"), F.when(~start, part(3)).alias("study"), F.floor(number(1) * 100 / F.greatest(number(2), F.lit(1))).cast("long").alias("percent"),
        F.nullif(F.regexp_extract("line", "~([0-9]+) min left", 1), F.lit("")).cast("long").alias("minutes_left"), F.col("line").contains("already complete, skipped").alias("skipped"),
    )


def confidential(files: DataFrame) -> DataFrame:
    """Log files by name: linkage, confidential or plain; a passing report (column `passed`) is plain."""
    name = F.lower("name")
    kind = F.when(name.startswith("linkage_"), "linkage").when(name.startswith("verify_") & F.coalesce("passed", F.lit(False)), "plain").when(name.rlike("^(checksums_|attestation_|profile)"), "plain").otherwise("confidential")
    return files.withColumn("kind", kind)


def attestation(facts: DataFrame, profile: Profile, at: str) -> DataFrame:
    """One row: a passing check's statement as JSON, from one row of facts: complete, checked, files, needles and digest."""
    kept = F.struct(F.lit(profile.name).alias("name"), F.array(*map(F.lit, profile.kept())).cast("array<string>").alias("retains"), F.lit(profile.method()).alias("method"))
    output = F.struct(F.col("complete").alias("patients_marked_complete"), F.col("checked").alias("objects_verified"), F.col("files").alias("files_hashed"))
    check = F.struct(F.lit("PASS").alias("result"), F.col("needles").alias("needles_used"))
    body = F.struct(F.lit(TOOL).alias("tool"), F.lit(VERSION).alias("version"), F.lit(at).alias("verified_at"), kept.alias("profile"), output.alias("output"), check.alias("verify"), F.struct(F.col("digest").alias("sha256")).alias("checksums"))
    return facts.select(F.to_json(body).alias("attestation"))


def files_log(images: DataFrame, names: DataFrame | None = None, skipped: DataFrame | None = None, rejects: DataFrame | None = None) -> DataFrame:
    """study_id, source_path, output_path, status (OK, REVIEW, SKIPPED or ERROR) and note of every file of a run.

    Images have their folder and name, or `names` has them by path.  `rejects`
    has study_id (null where nothing tells it), path and fault.
    """
    placed = images if names is None else images.select("study_id", "path", "review").join(names.select("path", "folder", "name"), "path")
    placed = placed.select("study_id", "path", "review", F.concat("folder", F.lit("/"), "name").alias("output_path"))
    log = placed.select("study_id", F.col("path").alias("source_path"), "output_path", F.when(F.col("review").isNull(), "OK").otherwise("REVIEW").alias("status"), F.coalesce("review", F.lit("")).alias("note"))
    left_out = lambda df, status, note: df.select("study_id", F.col("path").alias("source_path"), F.lit("").alias("output_path"), F.lit(status).alias("status"), note.alias("note"))
    if skipped is not None:
        log = log.unionByName(left_out(skipped, "SKIPPED", F.lit("listed in the skip list")))
    return log if rejects is None else log.unionByName(left_out(rejects, "ERROR", F.col("fault")))


def skip_hits(skipped: DataFrame) -> DataFrame:
    """How many files of each study a skip list kept out: those studies miss a slice."""
    return skipped.groupBy("study_id").agg(F.count("*").alias("skipped"))


def latest_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each key's row with the largest value in `order`, where ties have to be broken by all columns."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), *[c for c in rows.columns if c not in keys]))
    return rows.withColumn("nth", nth).where("nth = 1").drop("nth")
