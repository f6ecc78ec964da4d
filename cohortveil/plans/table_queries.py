"""Further registered queries: sources, small tables between runs, text helpers and a whole run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import policy as P
from ..operators import audit, deidentify, frames, identity, intake, series, tables, verify
from ..sources import dicom_json, files, stand_in, versions
from ..sources.scratch import scratch, stored
from . import cohort_run, saved_tables
from . import queries as Q

#: A profile that replaces texts.
TRIAL = P.Profile(name="Trial", keep_sex=True, patient_name="custom", patient_name_text="TRIAL^CASE", study_description="Trial CT", method_text="by protocol 7")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return stand_in.table(spark, sf, name)


def as_csv(df: DataFrame) -> str:
    path = scratch(df.sparkSession)
    df.write.option("header", True).csv(path)
    return path


def remap_paths(spark, sf):
    path = F.expr("CASE s_suppkey % 4 WHEN 0 THEN '/data/in' WHEN 1 THEN '/data/in/' || s_name WHEN 2 THEN '/data/inner/' || s_name ELSE '/data/in\\\\' || s_name END")
    return table(spark, sf, "supplier").select("s_suppkey", X.remap_path(path, "/data/in/", "/mnt/out").alias("path"))


def redact_paths(spark, sf):
    line = F.expr("'read /home/' || lower(c_mktsegment) || '/scan and C:\\\\Users\\\\u' || CAST(c_custkey AS STRING) || '\\\\x, not /var/' || c_mktsegment")
    return table(spark, sf, "customer").select("c_custkey", X.redact_paths(line).alias("line"))


def split_needles(spark, sf):
    typed = F.expr("' ' || c_name || ', ;' || c_mktsegment || '\\n ;' || CAST(c_custkey AS STRING) || ' '")
    return table(spark, sf, "customer").select("c_custkey", F.array_join(X.split_needles(typed), "|").alias("needles"))


def profile_slugs(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", X.profile_slug(F.expr("'(' || c_mktsegment || ') + No. ' || CAST(c_custkey AS STRING) || '!'")).alias("slug"))


def time_left(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.eta_text(F.expr("CAST(o_orderkey % 40000 AS DOUBLE)"), F.expr("o_custkey % 101 / 100.0E0")).alias("left"))


def unit_labels(spark, sf):
    folder = F.expr("CASE s_suppkey % 3 WHEN 0 THEN '/scans' WHEN 1 THEN '/scans/ward ' || CAST(s_nationkey AS STRING) ELSE '/scans/' || s_name || '/x' END")
    return table(spark, sf, "supplier").select("s_suppkey", tables.unit_label(folder, F.col("s_name"), "/scans/").alias("label"))


def policy_use(spark, sf):
    """How often each action of each profile's policy meets a top-level attribute, with the profile's own words."""
    e = Q.with_study(spark, sf).where("grp = 'meta' OR NOT path LIKE '%.%'").groupBy(F.col("path").alias("keyword")).agg(F.count("*").alias("n"))
    out = None
    for name, profile in {**P.PROFILES, "trial": TRIAL}.items():
        own = P.policy(spark, profile).join(e, "keyword").groupBy("action").agg(F.sum("n").alias("attributes"))
        row = own.select(F.lit(name).alias("profile"), F.lit(profile.method()).alias("method"), F.lit(profile.describe()).alias("describes"), F.lit(len(profile.problems())).cast("long").alias("problems"), "action", "attributes")
        out = row if out is None else out.unionByName(row)
    return out


def tag_policy_texts(spark, sf):
    return Q.digest_of(deidentify.deidentify(Q.with_study(spark, sf), F.lit(Q.SALT), TRIAL))


def verify_texts(spark, sf):
    """What a profile with texts of its own finds in untouched objects: descriptions that aren't the profile's, and names."""
    kinds = ("attribute should match profile", "PatientName not as profile dictates")
    return verify.verify(Q.with_study(spark, sf), TRIAL).where(F.col("kind").isin(*kinds)).select("kind", "instance_id", "detail")


def objects_json(spark, sf):
    """Orders as objects in the DICOM JSON model, one text each."""
    text = lambda vr, v: F.struct(F.lit(vr).alias("vr"), F.array(v).alias("Value"))
    o = stand_in.objects(spark, sf)
    key = F.col("o_orderkey").cast("string")
    inner = F.array(F.struct(text("UI", F.concat(F.lit("1.7."), key)).alias("00081155"), F.struct(F.lit("SQ").alias("vr"), F.array(F.struct(text("DS", F.col("o_custkey") % 7 + 0.5).alias("00180050"))).alias("Value")).alias("00289110")))
    fields = {
        "00020016": text("AE", F.lit("ARCHIVE7")), "00080016": F.when(F.col("o_orderkey") % 5 != 0, text("UI", F.lit("1.2.840.10008.5.1.4.1.1.2"))), "00080018": text("UI", F.concat(F.lit("1.8."), key)),
        "00100010": text("PN", F.struct(F.concat("c_mktsegment", F.lit("^A")).alias("Alphabetic"))), "00101005": text("PN", F.struct(F.col("c_name").alias("Alphabetic"))), "00102154": text("SH", key),
        "00200013": text("IS", F.col("o_orderkey")), "00180050": F.when(F.col("o_orderkey") % 2 == 0, text("DS", F.lit(0.75))), "00209241": text("FD", F.when(F.col("o_orderkey") % 3 == 0, 75.0)),
        "00091001": F.struct(F.lit("UN").alias("vr"), F.lit("AAAA").alias("InlineBinary")), "52009229": F.struct(F.lit("SQ").alias("vr"), inner.alias("Value")),
    }
    return o.select(F.col("o_orderkey").alias("instance_id"), F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))).alias("json"))


def json_elements(spark, sf):
    return Q.digest_of(dicom_json.elements(objects_json(spark, sf)))


def json_headers(spark, sf):
    return dicom_json.wide(dicom_json.elements(objects_json(spark, sf), only=dicom_json.wide_tags())).where("sop_class_uid IS NOT NULL").select("instance_id", "patient_name", "instance_number", "slice_mm", "phase")


def damaged_json(spark, sf):
    """The objects with some texts cut off, in a list, or nested too deeply."""
    deep = F.concat(F.repeat(F.lit('{"0040A730":{"vr":"SQ","Value":['), 14), F.lit("{}"), F.repeat(F.lit("]}}"), 14))
    key = F.col("instance_id")
    text = F.when(key % 11 == 0, F.substring("json", 1, 60)).when(key % 13 == 0, F.concat(F.lit("["), "json", F.lit("]"))).when(key % 17 == 0, deep).otherwise(F.col("json"))
    return objects_json(spark, sf).withColumn("json", text)


def rejected_objects(spark, sf):
    """Objects that can't be read and why; the others with how many elements they have."""
    return dicom_json.outcomes(dicom_json.parsed(damaged_json(spark, sf)))


def default_windows(spark, sf):
    p = Q.pixels(spark, sf)
    window = frames.default_window(F.slice("pixels", 1, 2), F.slice("pixels", 3, 2))
    return p.select("instance_id", window["centre"].alias("centre"), window["width"].alias("width"), frames.value_at(F.col("pixels"), F.col("cols"), (F.col("instance_id") % 8).cast("int"), (F.col("instance_id") % 5).cast("int")).alias("value"))


def quarantine_release(spark, sf):
    p = Q.pixels(spark, sf).withColumn("pixels", F.when(F.col("instance_id") % 15 == 0, F.array().cast("array<double>")).otherwise(F.col("pixels")))
    held = p.where("instance_id % 3 = 0").select("instance_id", F.lit("CV1").alias("study_id"))
    boxes = p.where("instance_id % 5 = 0 OR instance_id % 4 = 0").select("instance_id", F.lit(1).alias("x0"), F.lit(1).alias("y0"), F.lit(3).alias("x1"), F.lit(2).alias("y1"))
    return frames.released(p, boxes, held).select("instance_id", "study_id", "route", F.array_join(F.transform("pixels", lambda v: v.cast("long")), ",").alias("pixels"))


def tiled_redact(spark, sf):
    """Embeddings as objects of four 4 by 4 frames, in tiles of 3: boxes are painted in every frame."""
    p = Q.pixels(spark, sf).withColumns({"rows": F.lit(4), "cols": F.lit(4)})
    boxes = p.select("instance_id", (F.col("instance_id") % 5).cast("int").alias("x0"), F.lit(-3).alias("y0"), F.lit(2).alias("x1"), (F.col("instance_id") % 6).cast("int").alias("y1"))
    painted = frames.redacted_tiles(frames.tiles(p, 3), boxes)
    return painted.select("instance_id", "frame", "row0", "col0", F.array_join(F.transform("pixels", lambda v: v.cast("long")), ",").alias("pixels"))


def tiled_reformat(spark, sf):
    """One image of each orientation out of every series' tiles, as tiles of its own."""
    cut, out = frames.tiles(Q.pixels(spark, sf), 3), None
    for orientation, index in (("Axial", 7), ("Coronal", 3), ("Sagittal", 99)):
        one = frames.reformatted_tiles(cut, orientation, index, 5).select(F.lit(orientation).alias("orientation"), "series_uid", "row0", "col0", F.array_join(F.transform("pixels", lambda v: v.cast("long")), ",").alias("pixels"))
        out = one if out is None else out.unionByName(one)
    return out


def redaction_log(spark, sf):
    boxes = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("instance_id"))
    return tables.redaction_log(boxes, "reader", "20240101")


LISTED = "CASE l_linenumber % 7 WHEN 0 THEN 'a/b' WHEN 1 THEN '_logs/x' WHEN 2 THEN 'c/_review_2/x' WHEN 3 THEN 'c/.x' WHEN 4 THEN 'c/DicomDir' WHEN 5 THEN 'c/_other/x' ELSE 'x' END || CASE l_partkey % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.dcm' WHEN 2 THEN '.zip' ELSE '' END"


def wanted_files(spark, sf):
    """Whether paths are input, of a run and of a survey."""
    rel = table(spark, sf, "lineitem").select(F.expr(LISTED).alias("rel"))
    return rel.groupBy("rel", files.wanted(F.col("rel")).alias("run"), files.wanted(F.col("rel"), True).alias("survey")).agg(F.count("*").alias("files"))


def earlier_outputs(spark, sf):
    s = table(spark, sf, "supplier")
    rel = s.where("s_suppkey % 2 = 0").selectExpr("'out' || CAST(s_nationkey AS STRING) || '/_logs/' || s_name || '.csv' AS rel").union(s.where("s_suppkey % 3 = 0").selectExpr("'out' || CAST(s_nationkey AS STRING) || '/' || s_name || '/.complete' AS rel")).union(s.selectExpr("'in/' || s_name AS rel"))
    return files.looks_like_output(rel)


def input_files(spark, sf):
    """Scans of all suppliers but those that lie in a folder that an earlier run wrote."""
    scans = table(spark, sf, "lineitem").selectExpr("CASE l_suppkey % 3 WHEN 0 THEN 'out' || CAST(l_suppkey % 25 AS STRING) || '/S/' WHEN 1 THEN 'in/out' || CAST(l_suppkey % 25 AS STRING) || '/' ELSE '' END || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS rel")
    left = files.without_outputs(scans, earlier_outputs(spark, sf))
    return left.groupBy(F.regexp_extract("rel", "^(.*/)?", 0).alias("folder")).agg(F.count("*").alias("files"))


def needle_words(spark, sf):
    """Search words out of a mapping, of what somebody typed, and of a linkage table, as one set."""
    c = table(spark, sf, "customer")
    typed = c.where("c_custkey % 7 = 0").select(F.explode(X.split_needles(F.expr("c_mktsegment || '; ' || c_name || ', x1'"))).alias("value"))
    return verify.all_needles(c.where("c_custkey % 5 = 0").selectExpr("lower(c_name) AS value"), typed, tables.linkage_needles(audit.linkage(Q.images(spark, sf))), None)


def mapping_file(spark, sf):
    """An ID mapping, written as CSV and read back with its columns guessed."""
    rows = table(spark, sf, "customer").selectExpr("' ' || lower(c_name) AS `Hospital number`", "CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE 'CV' || CAST(c_custkey AS STRING) END AS `Study ID`", "c_acctbal AS balance")
    return identity.clean_mapping(files.read_mapping(spark, as_csv(rows)))


def pair_files(spark, sf):
    """Manifests, selections and picks, written as CSV and read back: rows with blanks where there must be none go."""
    s = table(spark, sf, "supplier").selectExpr("CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'P' || CAST(s_suppkey AS STRING) END AS study_id", "CASE WHEN s_suppkey % 3 = 0 THEN ' ' ELSE 'u' || CAST(s_suppkey AS STRING) END AS series_uid", "s_name AS series_description")
    path = as_csv(s)
    both = files.read_pairs(spark, path, ("study_id", "series_uid")).select(F.lit("selection").alias("what"), "study_id", "series_uid", F.lit("").alias("series_description"))
    return both.unionByName(files.read_pairs(spark, path, ("study_id", "series_uid", "series_description"), 1).select(F.lit("picks").alias("what"), "study_id", "series_uid", "series_description"))


def skip_file(spark, sf):
    line = table(spark, sf, "supplier").selectExpr("CASE s_suppkey % 4 WHEN 0 THEN '# ' || s_name WHEN 1 THEN ' ' ELSE ' /a/' || s_name || '/' END AS value")
    path = scratch(spark)
    line.write.text(path)
    return files.read_skips(spark, path)


def checksum_file(spark, sf):
    """The newest manifest of a folder, as sha256sum reads it: two are written, and the later one, a folder of its parts, is read."""
    path = scratch(spark)
    made = verify.manifest(Q.checksums(spark, sf)).where("text IS NOT NULL").select(F.expr("left(text, length(text) - 1)").alias("value"))
    made.write.text(f"{path}/checksums_20240102.sha256")
    table(spark, sf, "nation").selectExpr("'00  ' || n_name AS value").coalesce(1).write.text(f"{path}/checksums_20240101.sha256")
    return files.read_checksums(spark, path)


def linkage_words(spark, sf):
    """Search words out of a linkage log, written as CSV and read back."""
    return tables.linkage_needles(spark.read.option("header", True).csv(as_csv(audit.linkage(Q.images(spark, sf)))))


def report_status(spark, sf):
    lines = table(spark, sf, "events").selectExpr("'verify_' || CAST(user_id % 10 AS STRING) AS file", "event_id AS line_no", "CASE event_id % 5 WHEN 0 THEN 'PASS: no' WHEN 1 THEN 'FAIL: some' ELSE 'Verified' END AS line")
    return files.verify_status(lines)


def confidential_files(spark, sf):
    named = table(spark, sf, "events").selectExpr("CASE event_id % 7 WHEN 0 THEN 'LINKAGE_1.csv' WHEN 1 THEN 'verify_1.txt' WHEN 2 THEN 'verify_2.txt' WHEN 3 THEN 'checksums_1.sha256' WHEN 4 THEN 'attestation_1.json' WHEN 5 THEN 'profile.json' ELSE 'files_1.csv' END AS name", "event_id % 7 = 1 AS passed")
    return audit.confidential(named).groupBy("name", "kind").agg(F.count("*").alias("files"))


def attestation_text(spark, sf):
    facts = Q.study_state(spark, sf).agg(F.count_if(F.col("state") == "complete").alias("complete"), F.count("*").alias("checked")).join(verify.manifest_digest(verify.manifest(Q.checksums(spark, sf)))).withColumn("needles", F.lit(5))
    return audit.attestation(facts, P.PROFILES["longitudinal"], "20240101")


def not_this_run(spark, sf):
    c = table(spark, sf, "customer")
    return tables.not_this_run(c.selectExpr("'C V ' || CAST(c_custkey AS STRING) AS study_id"), c.where("c_acctbal > 0").selectExpr("'C_V_' || CAST(c_custkey AS STRING) AS study_id"))


def survey_copies(spark, sf):
    """Where the files of series that a survey keeps are copied to; names that repeat are numbered."""
    own = Q.images(spark, sf).withColumn("path", F.concat("patient", F.lit("/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string")))
    marked = series.group_series(own).select(F.col("study_id").alias("patient"), "series_uid", F.when(F.col("n_files") % 2 == 0, " Keep ").otherwise("drop").alias("decision"))
    plan = tables.copy_plan(own, tables.survey_kept(marked))
    return plan.groupBy(F.regexp_extract("target", "^([^/]+/[^/]+)/", 1).alias("folder")).agg(F.count("*").alias("files"), F.countDistinct("target").alias("targets"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("source", F.lit(">"), "target"))), ";"), 256).alias("digest"))


def case_mismatch(spark, sf):
    return tables.case_mismatch(Q.images(spark, sf).withColumn("source_folder", F.concat(F.lit("F"), (F.col("pid") % 7).cast("string"))))


def coronary_summary(spark, sf):
    return tables.coronary_summary(Q.classified(spark, sf))


def output_series(spark, sf):
    held = Q.images(spark, sf).where("review IS NOT NULL").groupBy("study_id", "series_uid").agg(F.count("*").alias("n_files"), F.min("review").alias("review"))
    return tables.output_series(Q.decided(spark, sf), held)


def ticked_kinds(spark, sf):
    """Ticked kinds with all that a search shows ticked, and then unticked."""
    found = intake.kinds(Q.with_review(spark, sf)).select("modality", "kind", "slice_mm")
    ticked, shown = found.where("slice_mm < 0.7"), found.where("kind LIKE '%a%'")
    return tables.tick_shown(ticked, shown, True).withColumn("ticked", F.lit(True)).unionByName(tables.tick_shown(ticked, shown, False).withColumn("ticked", F.lit(False)))


def selection_table(spark, sf):
    """A selection spelt out, with some studies replaced or cleared and others taken out."""
    own = Q.images(spark, sf).withColumn("series_uid", F.when(F.col("pid") % 5 == 0, "").otherwise(F.col("series_uid")))
    rows = intake.selection_rows(series.group_series(own)).select("study_id", "series_uid")
    s = table(spark, sf, "supplier")
    new = s.where("s_suppkey % 3 = 0").selectExpr("'P' || CAST(s_suppkey AS STRING) AS study_id", "CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'new' END AS series_uid")
    return tables.without(tables.replaced(rows, new), s.where("s_suppkey % 7 = 0").selectExpr("'P' || CAST(s_suppkey AS STRING) AS study_id"))


def pick_override(spark, sf):
    chosen = Q.classified(spark, sf).where("study_id = 'P2'").select("series_uid", "description", "slice_mm")
    return tables.pick_override(Q.picks(spark, sf), "P2", chosen)


def middle_files(spark, sf):
    nth = F.row_number().over(Window.partitionBy("series_uid").orderBy("path"))
    return tables.sample_files(Q.images(spark, sf).withColumn("nth", nth))


def started_studies(spark, sf):
    line = F.expr("CASE event_id % 3 WHEN 0 THEN '[3/12] U' || CAST(user_id AS STRING) || ': starting, 224 files to write' WHEN 1 THEN '  U' || CAST(user_id AS STRING) || ': 200 files...' ELSE 'x: starting' END")
    return tables.started(table(spark, sf, "events").select(line.alias("line"))).groupBy("study", "expected", "written").agg(F.count("*").alias("lines"))


def skip_hits(spark, sf):
    own = Q.images(spark, sf)
    return audit.skip_hits(identity.skipped(own, own.where("l_linenumber = 2").select("path")))


def scan_headline(spark, sf):
    return intake.headline(Q.study_units(spark, sf))


def reused_ids(spark, sf):
    """New IDs where an earlier one holds only if its study is in the output."""
    outputs = table(spark, sf, "supplier").where("s_suppkey % 2 = 0").selectExpr("'ANON-' || lpad(CAST(s_suppkey AS STRING), 3, '0') AS study_id")
    kept = identity.reusable(Q.given(spark, sf), outputs)
    return identity.assign_ids(Q.unit_rows(spark, sf).select("match_key", "sort_key"), kept, outputs.select(F.col("study_id").alias("new_id")))


def first_names(spark, sf):
    return audit.shown_first(table(spark, sf, "customer").where("c_acctbal < 0"), "c_name", 4)


def tick_counts(spark, sf):
    return audit.tick_counts(Q.selection(spark, sf))


def run_output(spark, sf):
    """A whole run over the stand-in's objects: what it wrote, by object."""
    e = Q.with_study(spark, sf).drop("study_id", "o_custkey")
    headers = dicom_json.wide(e)
    mapping = identity.clean_mapping(table(spark, sf, "customer").where("c_acctbal > 0").selectExpr("'h' || CAST(1000000 + c_custkey AS STRING) AS key", "'CV' || CAST(c_custkey AS STRING) AS study_id", "c_custkey AS row"))
    folder = scratch(spark)
    cohort_run.run(spark, e.drop("patient_id"), headers, mapping, f"{folder}/out", f"{folder}/confidential", "1", salt_text=Q.SALT, coronary_only=False)
    return Q.digest_of(cohort_run.committed(spark, f"{folder}/out"))


def manifest_tree(spark, sf):
    """All digests of a manifest's tree of three levels."""
    return verify.manifest(Q.checksums(spark, sf), depth=2).drop("text")


def tree_recheck(spark, sf):
    """What changed since a manifest, by its tree: a tenth of the parts is touched, and only these are compared."""
    then, now = Q.checksums(spark, sf), Q.checksums(spark, sf, True)
    return verify.recheck_tree(verify.manifest(then, depth=2), verify.in_parts(then, 2), now, 2)


def study_counts(spark, sf):
    """Counts by study with what was dropped, and with errors of objects that couldn't be read, of studies that have nothing else too."""
    bad = table(spark, sf, "lineitem").where("l_partkey % 50 = 0").selectExpr("CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 'Q' || CAST(l_suppkey AS STRING) ELSE 'P' || CAST(l_suppkey AS STRING) END AS study_id")
    decided = stored(Q.decided(spark, sf))
    return audit.study_counts(series.images_of(Q.images(spark, sf), decided), decided, audit.errors_by_study(bad)).drop("any")


def versioned_list(spark, sf):
    """An assignment list that two runs add to and change, one after the other, read back from its newest version."""
    root = scratch(spark)
    c = table(spark, sf, "customer")
    saved_tables.save_assignments(c.where("c_custkey % 2 = 0").selectExpr("c_custkey AS match_key", "'A' || CAST(c_custkey AS STRING) AS new_id"), root)
    saved_tables.save_assignments(c.where("c_custkey % 3 = 0").selectExpr("c_custkey AS match_key", "'B' || CAST(c_custkey AS STRING) AS new_id"), root)
    return saved_tables.read(spark, root)


def saved_selection(spark, sf):
    """A selection that is saved, changed, cleared for some studies and read back, each time from what was saved before."""
    root = scratch(spark)
    s = table(spark, sf, "supplier")
    saved_tables.save_selection(Q.classified(spark, sf).select("study_id", "series_uid"), root)
    saved_tables.save_selection(s.where("s_suppkey % 3 = 0").selectExpr("'P' || CAST(s_suppkey AS STRING) AS study_id", "CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'new' END AS series_uid"), root)
    saved_tables.clear_selection(s.where("s_suppkey % 7 = 0").selectExpr("'P' || CAST(s_suppkey AS STRING) AS study_id"), root)
    return saved_tables.read(spark, root)


def written_profile(spark, sf):
    """A profile written beside an output and read back, as it applies to headers."""
    folder = scratch(spark)
    cohort_run.write_profile(spark, TRIAL, folder)
    return Q.digest_of(deidentify.deidentify(Q.with_study(spark, sf), F.lit(Q.SALT), P.read_profile(spark, f"{folder}/_profile")))


def decisions_file(spark, sf):
    """Series decisions of two runs, each a file, read back with the run that the file's name tells."""
    folder = scratch(spark)
    own = Q.decided(spark, sf).select("study_id", F.coalesce("series_number", F.lit(0)).cast("string").alias("series_number"), "decision")
    for run, rows in (("1", own.where("decision = 'keep'")), ("2", own.where("decision <> 'keep'"))):
        rows.coalesce(1).write.option("header", True).csv(f"{folder}/series_{run}.csv")
    return files.read_decisions(spark, folder).groupBy("run", "decision").agg(F.count("*").alias("series"), F.countDistinct("study_id").alias("studies"))


def run_files(spark, sf):
    """A run by folders with a manifest and unreadable objects: its log of files, and which of its studies are complete."""
    e = Q.with_study(spark, sf).drop("study_id", "o_custkey", "patient_id")
    named = dicom_json.wide(e).withColumn("path", F.concat(F.lit("ward/"), "patient_id", F.lit("/"), F.col("instance_id").cast("string")))
    manifest = table(spark, sf, "customer").where("c_custkey % 4 <> 0").selectExpr("'ward/H' || CAST(1000000 + c_custkey AS STRING) || '/' AS source_folder", "'CV' || CAST(c_custkey AS STRING) AS study_id")
    bad = named.where("instance_id % 10 = 0").select("instance_id", "path", F.lit("not JSON").alias("fault"))
    folder = scratch(spark)
    cohort_run.run(spark, e, named.where("instance_id % 10 <> 0"), None, f"{folder}/out", f"{folder}/confidential", "1", salt_text=Q.SALT, coronary_only=False, manifest=manifest, rejects=bad)
    log = spark.read.option("header", True).csv(f"{folder}/confidential/files")
    done = cohort_run.commits(spark, f"{folder}/out").select("study_id", "complete")
    return log.groupBy("study_id", "status").agg(F.count("*").alias("files")).join(done, "study_id", "left")


def dry_run(spark, sf):
    """What a run would write, by study; nothing is written."""
    e = Q.with_study(spark, sf).drop("study_id", "o_custkey")
    mapping = identity.clean_mapping(table(spark, sf, "customer").where("c_acctbal > 0").selectExpr("'h' || CAST(1000000 + c_custkey AS STRING) AS key", "'CV' || CAST(c_custkey AS STRING) AS study_id", "c_custkey AS row"))
    folder = scratch(spark)
    return cohort_run.run(spark, e.drop("patient_id"), dicom_json.wide(e), mapping, f"{folder}/out", f"{folder}/confidential", "1", coronary_only=False, dry_run=True)


NAMES = """remap_paths redact_paths split_needles profile_slugs time_left unit_labels policy_use tag_policy_texts verify_texts json_elements json_headers rejected_objects default_windows
quarantine_release redaction_log wanted_files earlier_outputs mapping_file pair_files skip_file checksum_file linkage_words report_status confidential_files attestation_text
not_this_run survey_copies case_mismatch coronary_summary output_series ticked_kinds selection_table pick_override middle_files started_studies skip_hits scan_headline reused_ids first_names tick_counts run_output
tiled_redact tiled_reformat input_files needle_words manifest_tree tree_recheck study_counts versioned_list saved_selection written_profile decisions_file run_files dry_run""".split()

QUERIES = {name: globals()[name] for name in NAMES}
