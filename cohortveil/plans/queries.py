"""The registered queries: each operator over the stand-in cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions import policy as P
from ..operators import audit, deidentify, frames, identity, intake, series, verify
from ..sources import stand_in
from ..sources.scratch import stored

SALT = "stand-in salt"


def images(spark: SparkSession, sf: str) -> DataFrame:
    out = stand_in.images(spark, sf).withColumn("study_id", F.col("patient"))
    return out.withColumn("review", series.review_reason(F.col("sop_class_uid"), F.col("modality"), F.col("burned_in")))


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return series.classify(series.group_series(images(spark, sf)))


def picks(spark: SparkSession, sf: str) -> DataFrame:
    return stand_in.table(spark, sf, "supplier").selectExpr(
        "'P' || CAST(s_suppkey AS STRING) AS study_id", "CASE s_suppkey % 3 WHEN 0 THEN '1.2.3.40.' || CAST(s_suppkey AS STRING) || '.3' WHEN 1 THEN '' ELSE 'unknown' END AS series_uid",
        "CASE s_suppkey % 3 WHEN 1 THEN ' Coro   ANGIO fine' WHEN 2 THEN 'acquisition 9' ELSE '' END AS series_description",
    )


def selection(spark: SparkSession, sf: str) -> DataFrame:
    return stand_in.table(spark, sf, "supplier").where("s_acctbal < 0").selectExpr("'P' || CAST(s_suppkey AS STRING) AS study_id", "'1.2.3.40.' || CAST(s_suppkey AS STRING) || '.5' AS series_uid")


def decided(spark: SparkSession, sf: str) -> DataFrame:
    return series.decide(classified(spark, sf))


DECISION = ["study_id", "series_uid", "series_number", "images", "decision", "reason"]


def series_decisions(spark, sf):
    return decided(spark, sf).select(*DECISION)


def series_picks_cascade(spark, sf):
    return series.decide(classified(spark, sf), picks=picks(spark, sf)).select(*DECISION)


def series_selection(spark, sf):
    return series.decide(classified(spark, sf), selection=selection(spark, sf)).select(*DECISION)


def pick_matches(spark, sf):
    return series.pick_totals(series.picked(classified(spark, sf), picks(spark, sf)))


def series_survey(spark, sf):
    return series.survey(series.group_series(images(spark, sf))).drop("description")


def review_routing(spark, sf):
    return images(spark, sf).groupBy("study_id", "review").agg(F.count("*").alias("files"))


def last_resort_series(spark, sf):
    return series.last_resort(classified(spark, sf)).where("last_resort").select("study_id", "series_uid", "n_files")


def kept_images(spark, sf):
    kept = series.images_of(images(spark, sf), decided(spark, sf))
    return kept.groupBy("study_id").agg(F.count("*").alias("files"), F.min("path").alias("first_path"))


def thick_audit(spark, sf):
    everything = classified(spark, sf).withColumn("decision", F.lit("keep"))
    return series.thick(everything)


def uid_hash(spark, sf):
    return stand_in.objects(spark, sf).select("o_orderkey", X.hashed_uid(F.concat(F.lit("1.3.12."), F.col("o_custkey").cast("string"), F.lit("."), F.col("o_orderkey").cast("string")), F.lit(SALT)).alias("uid"))


def with_study(spark, sf):
    return stand_in.elements(spark, sf).withColumn("study_id", F.concat(F.lit("CV"), F.col("o_custkey").cast("string")))


def date_shift(spark, sf):
    o = stand_in.objects(spark, sf).select("o_orderkey", F.concat(F.lit("CV"), F.col("o_custkey").cast("string")).alias("study_id"), F.date_format("o_orderdate", "yyyyMMdd").alias("da"))
    days = X.shift_days(F.lit(SALT), F.col("study_id"))
    return o.select("o_orderkey", "da", days.alias("days"), X.shift_da(F.col("da"), days).alias("shifted"), X.shift_dt(F.concat("da", F.lit("154522.12")), days).alias("shifted_dt"), X.shift_da(F.substring("da", 1, 4), days).alias("fallback"))


def age_bucket(spark, sf):
    e = stand_in.objects(spark, sf)
    born = F.expr("CAST((1930 + o_custkey % 70) * 10000 + (1 + o_custkey % 12) * 100 + 1 + o_custkey % 28 AS STRING)")
    stated = F.expr("CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN '030M' WHEN 2 THEN '200W' ELSE '058Y' END")
    years = X.age_years(stated, born, F.date_format("o_orderdate", "yyyyMMdd"), F.lit(""))
    return e.select("o_orderkey", years.alias("years"), X.age_bucket(years).alias("bucket"))


def digest_of(elements: DataFrame) -> DataFrame:
    """Per object, how many attributes there are and one digest of them all in order."""
    line = F.concat("grp", F.lit(":"), "path", F.lit("="), "value")
    return elements.groupBy("instance_id").agg(F.count("*").alias("attributes"), F.sha2(F.array_join(F.sort_array(F.collect_list(line)), ";"), 256).alias("digest"))


def tag_policy(spark, sf):
    return digest_of(deidentify.deidentify(with_study(spark, sf), F.lit(SALT)))


def tag_policy_profile(spark, sf):
    return digest_of(deidentify.deidentify(with_study(spark, sf), F.lit(SALT), P.PROFILES["longitudinal"]))


def tag_counters(spark, sf):
    return deidentify.counters(with_study(spark, sf))


def diffed(spark, sf):
    return deidentify.rewrite_diff(with_study(spark, sf), F.lit(SALT))


def header_diff_summary(spark, sf):
    return deidentify.diff_summary(diffed(spark, sf), "keyword")


def plain_changes(spark, sf):
    return audit.plain_changes(diffed(spark, sf))


def mapping(spark, sf):
    rows = stand_in.table(spark, sf, "customer").where("c_acctbal > 0").selectExpr("' h' || CAST(1000000 + c_custkey AS STRING) AS key", "'CV' || CAST(c_custkey AS STRING) AS study_id", "c_custkey AS row")
    return identity.clean_mapping(rows)


def sources(spark, sf):
    return stand_in.objects(spark, sf).selectExpr("o_orderkey", "'H' || CAST(1000000 + o_custkey AS STRING) AS source_key")


def id_mapping(spark, sf):
    return identity.mapped(sources(spark, sf), mapping(spark, sf)).groupBy("study_id").agg(F.count("*").alias("files"))


def unmapped_and_missing(spark, sf):
    return identity.unmapped(sources(spark, sf), mapping(spark, sf))


def manifest(spark, sf):
    return stand_in.table(spark, sf, "supplier").selectExpr("'P' || CAST(s_suppkey AS STRING) || '/S' || CAST(1 + s_suppkey % 8 AS STRING) || '/' AS source_folder", "'CV' || CAST(s_suppkey AS STRING) AS study_id")


def manifest_files(spark, sf):
    found = identity.under_folders(images(spark, sf).select("path"), manifest(spark, sf)).groupBy("study_id").agg(F.count("*").alias("files"))
    gone = identity.missing_folders(images(spark, sf).select("path"), manifest(spark, sf)).select("study_id", F.lit(0).cast("long").alias("files"))
    return found.unionByName(gone)


def skipped_files(spark, sf):
    skips = stand_in.table(spark, sf, "lineitem").where("l_quantity >= 50").selectExpr("'P' || CAST(l_suppkey AS STRING) || '\\\\S' || CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 3 ELSE 5 END + CASE l_linestatus WHEN 'O' THEN 1 ELSE 0 END AS STRING) || '/' || CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) || '_' || CAST(l_partkey AS STRING) AS path")
    return identity.without_skipped(images(spark, sf), skips).groupBy("study_id").agg(F.count("*").alias("files"))


def linkage(spark, sf):
    return audit.linkage(images(spark, sf))


def lost(spark, sf):
    return stand_in.table(spark, sf, "nation").selectExpr("'X' || CAST(n_nationkey AS STRING) AS study_id")


def study_summary(spark, sf):
    return audit.study_summary(images(spark, sf), stored(decided(spark, sf)), lost(spark, sf))


def run_totals(spark, sf):
    return audit.run_totals(study_summary(spark, sf))


def output_names(spark, sf):
    named = identity.output_names(images(spark, sf))
    return named.groupBy("study_id", "folder").agg(F.count("*").alias("files"), F.countDistinct("name").alias("names"), F.min("name").alias("first"), F.max("name").alias("last"))


def files_log(spark, sf):
    log = audit.files_log(identity.with_output_names(images(spark, sf)))
    each = log.groupBy("study_id", "status", "note", "output_path").agg(F.count("*").alias("files"))
    return each.groupBy("study_id", "status", "note").agg(F.sum("files").alias("files"), F.count("output_path").alias("outputs"), F.min("output_path").alias("first"))


def verify_findings(spark, sf):
    found = verify.verify(with_study(spark, sf))
    return found.groupBy("kind", "instance_id").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("detail")), ";"), 256).alias("details"))


def verify_report(spark, sf):
    return verify.report(verify.element_findings(with_study(spark, sf)), 5)


def verify_output(spark, sf):
    """Findings of a de-identified output: none, for every built-in profile."""
    found = verify.verify_rewritten(with_study(spark, sf), F.lit(SALT), P.PROFILES).groupBy("profile").agg(F.count("*").alias("n"))
    named = F.explode(F.array(*map(F.lit, P.PROFILES)))
    return spark.range(1).select(named.alias("profile")).join(F.broadcast(found), "profile", "left").select("profile", F.coalesce("n", F.lit(0)).cast("long").alias("findings"))


def needle_hits(spark, sf):
    e = with_study(spark, sf)
    needles = verify.needle_set(stand_in.table(spark, sf, "customer").selectExpr("c_mktsegment AS value"))
    return verify.needle_hits(verify.texts(e), needles).groupBy("keyword", "needle").agg(F.count("*").alias("hits"))


def name_part_hits(spark, sf):
    e = with_study(spark, sf)
    parts = verify.name_parts(stand_in.table(spark, sf, "customer").selectExpr("c_mktsegment || '^Jo' AS value"))
    return verify.name_part_hits(verify.texts(e), parts).groupBy("keyword", "part").agg(F.count("*").alias("hits"))


def nhs_numbers(spark, sf):
    text = F.concat(F.lit("no "), F.lpad((F.col("c_custkey") * 7919 + 100000007).cast("string"), 10, "4"), F.lit(" end"))
    return stand_in.table(spark, sf, "customer").select("c_custkey", F.size(verify.nhs_numbers(text)).cast("long").alias("valid"))


def pattern_sweep(spark, sf):
    text = F.concat("c_name", F.when(F.col("c_custkey") % 3 == 0, F.lit(" at AB1 2CD")).otherwise(F.concat(F.lit(" on 2019"), F.lpad((1 + F.col("c_custkey") % 14).cast("string"), 2, "0"), F.lit("15"))))
    kinds = verify.text_patterns(text)
    return stand_in.table(spark, sf, "customer").select("c_custkey", kinds["postcode-shaped value"].alias("postcode"), kinds["date-shaped text"].alias("date"))


def document_sweep(spark, sf):
    """The text sweeps over whole free texts, by source."""
    kinds = verify.text_patterns(F.coalesce("text", F.lit("")))
    return stand_in.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("texts"), F.count_if(kinds["postcode-shaped value"]).alias("postcodes"), F.sum(F.size(verify.nhs_numbers(F.coalesce("text", F.lit(""))))).cast("long").alias("nhs"))


def checksums(spark, sf, later=False):
    o = stand_in.table(spark, sf, "orders")
    if later:
        o = o.where("o_orderpriority <> '1-URGENT'")
        return o.selectExpr("'f' || CAST(o_orderkey + CASE WHEN o_totalprice < 2000 THEN 100000000 ELSE 0 END AS STRING) AS path", "sha2(CASE WHEN o_orderstatus = 'P' THEN 'new' ELSE 'old' END || CAST(o_orderkey AS STRING), 256) AS sha256")
    return o.selectExpr("'f' || CAST(o_orderkey AS STRING) AS path", "sha2('old' || CAST(o_orderkey AS STRING), 256) AS sha256")


def checksum_recheck(spark, sf):
    return verify.recheck(checksums(spark, sf), checksums(spark, sf, True))


def attestation(spark, sf):
    return verify.manifest_digest(verify.manifest(checksums(spark, sf)))


def runs(spark, sf):
    return stand_in.table(spark, sf, "events").selectExpr("'U' || CAST(user_id AS STRING) AS study_id", "event_type AS series", "event_id AS run", "CASE WHEN value > 50 THEN 'keep' ELSE 'drop' END AS decision", "CASE WHEN event_id % 5 = 0 THEN 'x [kept as fallback - CHECK]' ELSE 'rule' END AS reason")


def decision_history(spark, sf):
    return audit.newest(runs(spark, sf), ["study_id", "series"])


def decision_counts(spark, sf):
    return audit.decision_counts(decision_history(spark, sf))


def decision_filter(spark, sf):
    return audit.filter_decisions(decision_history(spark, sf), "Needs a look", " u1").select("study_id", "series", "run")


def study_units(spark, sf):
    own = images(spark, sf).withColumn("study", F.substring("study_date", 1, 4)).withColumn("path", F.when(F.col("pid") % 2 == 0, F.concat(F.col("patient"), F.lit("/"), F.col("study"), F.lit("/"), "path")).otherwise(F.col("path")))
    return intake.units(own)


def mixed_folders(spark, sf):
    return intake.is_mixed(study_units(spark, sf))


def with_review(spark, sf):
    return classified(spark, sf).withColumn("review", series.review_reason(F.col("sop_class_uid"), F.col("modality"), F.col("burned_in")))


def kinds(spark, sf):
    return intake.kinds(with_review(spark, sf)).drop("reason", "review")


def kind_search(spark, sf):
    return intake.search(intake.kinds(with_review(spark, sf)), "CT cta 0.75mm").select("modality", "kind", "slice_mm", "n_units")


def keep_plan(spark, sf):
    s = classified(spark, sf)
    ticked = intake.kinds(with_review(spark, sf)).where("coronary > 0")
    out = None
    for choice in ("coronary", "all", "choose"):
        row = intake.plan(s, choice, ticked if choice == "choose" else None).select(F.lit(choice).alias("choice"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def unit_rows(spark, sf):
    return stand_in.table(spark, sf, "supplier").selectExpr("'P' || CAST(s_suppkey AS STRING) AS match_key", "'P' || CAST(s_suppkey AS STRING) AS sort_key", "s_suppkey", "s_nationkey", "s_acctbal")


def given(spark, sf):
    return unit_rows(spark, sf).where("s_acctbal > 5000").selectExpr("match_key", "'ANON-' || lpad(CAST(s_suppkey AS STRING), 3, '0') AS new_id")


def assigned(spark, sf):
    taken = stand_in.table(spark, sf, "nation").selectExpr("'Anon-' || CAST(n_nationkey AS STRING) AS new_id")
    return identity.assign_ids(unit_rows(spark, sf).select("match_key", "sort_key"), given(spark, sf), taken)


def assign_ids(spark, sf):
    return assigned(spark, sf)


def id_problems(spark, sf):
    ids = stand_in.table(spark, sf, "customer").selectExpr("CAST(c_custkey AS STRING) AS match_key", "CASE WHEN c_custkey % 10 = 0 THEN ' ' WHEN c_custkey % 10 = 1 THEN 'a/' || CAST(c_custkey AS STRING) WHEN c_custkey % 10 = 2 THEN 'dup ' || CAST(c_custkey % 100 AS STRING) ELSE 'ok' || CAST(c_custkey AS STRING) END AS new_id")
    return identity.id_problems(ids)


def earlier_copies(spark, sf):
    renamed = unit_rows(spark, sf).selectExpr("match_key", "CASE WHEN s_nationkey < 12 THEN 'ANON-' || lpad(CAST(s_suppkey AS STRING), 3, '0') ELSE 'NEW ' || CAST(s_suppkey AS STRING) END AS new_id")
    done = unit_rows(spark, sf).where("s_acctbal > 7000").selectExpr("'ANON-' || lpad(CAST(s_suppkey AS STRING), 3, '0') AS study_id")
    return identity.earlier_copies(renamed, given(spark, sf), done)


def spreadsheet_ids(spark, sf):
    table = unit_rows(spark, sf).where("s_acctbal > 0").selectExpr("CASE WHEN s_nationkey < 10 THEN match_key ELSE CAST(s_suppkey AS STRING) END AS key", "'S' || CAST(s_suppkey AS STRING) AS study_id", "s_suppkey AS row")
    return identity.by_priority(unit_rows(spark, sf).select("match_key", "s_suppkey"), identity.clean_mapping(table), ["match_key", "s_suppkey"]).select("match_key", "new_id")


def assignment_list(spark, sf):
    return identity.merged_list(given(spark, sf), unit_rows(spark, sf).where("s_nationkey < 12").selectExpr("match_key", "'R' || CAST(s_suppkey AS STRING) AS new_id"))


def completed(spark, sf):
    return stand_in.table(spark, sf, "orders").where("o_orderstatus = 'F'").selectExpr("'CV' || CAST(o_custkey AS STRING) AS study_id", "CASE WHEN o_totalprice > 100000 THEN 'ctca' ELSE 'all' END AS mode").distinct()


def pairs(spark, sf):
    return stand_in.table(spark, sf, "customer").selectExpr("'CV' || CAST(c_custkey AS STRING) AS study_id")


def resume_pending(spark, sf):
    return audit.pending(pairs(spark, sf), completed(spark, sf), "ctca")


def study_state(spark, sf):
    return audit.study_state(pairs(spark, sf), completed(spark, sf))


def facts(spark, sf):
    """What is known of one output for each supplier: checked or not, passed or not, changed since, with and without studies and logs."""
    n = F.col("s_suppkey")
    status = F.when(n % 3 == 0, "PASS").when(n % 3 == 1, "FAIL")
    some = lambda every, size: F.when(n % every == 0, 0).otherwise(n % size + 1).cast("long")
    return stand_in.table(spark, sf, "supplier").select("s_suppkey", some(5, 3).alias("complete"), some(2, 4).alias("partial"), some(4, 9).alias("review_files"), (n % 10).alias("last_run_at"), F.when(status.isNotNull(), n % 7).alias("verified_at"), status.alias("status"), (n % 6 % 2).alias("linkage_files"), (n % 8 % 3).alias("other_logs"), (n % 11 > 0).alias("attested"))


def share_readiness(spark, sf):
    return audit.readiness(facts(spark, sf), "s_suppkey")


def done_headline(spark, sf):
    return audit.done_headline(facts(spark, sf), "s_suppkey")


def log_progress(spark, sf):
    line = "CASE event_id % 5 WHEN 0 THEN '[' || CAST(event_id % 520 AS STRING) || '/520] U' || CAST(user_id AS STRING) || ' <- a: 3 files (2%, ~310 min left)' WHEN 1 THEN '[3/12] P3: starting, 224 files to write' WHEN 2 THEN 'ERROR in ' || event_type WHEN 3 THEN '  P3: 200 files...' ELSE 'Done in 3 min - CHECK' END"
    return audit.log_lines(stand_in.table(spark, sf, "events").select("event_id", F.expr(line).alias("line"))).drop("line")


def pixels(spark, sf):
    """Embeddings as 8 by 8 frames of whole numbers: the floor of 100 times a component, taken as double."""
    return stand_in.table(spark, sf, "embeddings").select(F.col("vec_id").alias("instance_id"), F.concat(F.lit("L"), F.col("label").cast("string")).alias("series_uid"), F.lit(8).alias("rows"), F.lit(8).alias("cols"), F.when(F.col("vec_id") % 2 == 0, "MONOCHROME1").otherwise("MONOCHROME2").alias("photometric"), (F.col("vec_id") * 0.5).cast("double").alias("z"), F.transform("embedding", lambda v: F.floor(v.cast("double") * 100).cast("double")).alias("pixels"))


def frame_window(spark, sf):
    hu = X.let(frames.rescaled(F.col("pixels"), F.lit(2.0), F.lit(-10.0)), lambda p: frames.windowed(p, F.lit(0.0), F.when(F.col("instance_id") % 3 == 0, 0.0).otherwise(40.0)))
    return pixels(spark, sf).select("instance_id", F.array_join(hu, ",").alias("grey"))


def frame_redact(spark, sf):
    p = pixels(spark, sf)
    boxes = p.select("instance_id", (F.col("instance_id") % 9).cast("int").alias("x0"), F.lit(-3).alias("y0"), F.lit(4).alias("x1"), (F.col("instance_id") % 5).cast("int").alias("y1"))
    return frames.redacted(p, boxes).select("instance_id", F.array_join(F.transform("pixels", lambda v: v.cast("long")), ",").alias("pixels"))


def frame_downsample(spark, sf):
    small = frames.downsampled(F.col("pixels"), F.col("rows"), F.col("cols"), 3, 4)
    return pixels(spark, sf).select("instance_id", F.array_join(F.transform(small, lambda v: v.cast("long")), ",").alias("pixels"))


def slice_spacing(spark, sf):
    return frames.slice_spacing(pixels(spark, sf))


def reformat(spark, sf):
    out = frames.reformatted(pixels(spark, sf), "Coronal", 3)
    side = frames.reformatted(pixels(spark, sf), "Sagittal", 99)
    text = lambda p: F.sha2(F.array_join(F.transform(p, lambda v: v.cast("long")), ","), 256)
    return out.select("series_uid", text("pixels").alias("coronal")).join(side.select("series_uid", text("pixels").alias("sagittal")), "series_uid")


NAMES = """series_decisions series_picks_cascade series_selection pick_matches series_survey review_routing last_resort_series kept_images thick_audit
uid_hash date_shift age_bucket tag_policy tag_policy_profile tag_counters header_diff_summary plain_changes id_mapping unmapped_and_missing manifest_files
skipped_files linkage study_summary run_totals output_names files_log verify_findings verify_report verify_output needle_hits name_part_hits nhs_numbers pattern_sweep
document_sweep checksum_recheck attestation decision_history decision_counts decision_filter study_units mixed_folders kinds kind_search keep_plan assign_ids
id_problems earlier_copies spreadsheet_ids assignment_list resume_pending study_state share_readiness done_headline log_progress frame_window frame_redact
frame_downsample slice_spacing reformat""".split()

QUERIES = {name: globals()[name] for name in NAMES}
