"""Tables larger than the smallest ones: where keys get longer, manifests get levels and components lie close to a whole number."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohortveil.functions import exprs
from cohortveil.functions import policy as P
from cohortveil.operators import audit, deidentify, identity, verify
from cohortveil.plans import queries
from cohortveil.sources import dicom_json, stand_in


def rows(spark, folder, name):
    """A query's rows and those of its SQL, over a folder's tables."""
    con = duckdb.connect()
    for file in folder.iterdir():
        con.sql(f"CREATE VIEW {file.name.removesuffix('.parquet')} AS SELECT * FROM '{file}/*.parquet'")
    told = con.sql(entry.oracle_sql()[name])
    columns = sorted(told.columns)
    want = sorted((tuple(r[told.columns.index(c)] for c in columns) for r in told.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in columns) for r in entry.queries()[name](spark, str(folder)).collect()), key=repr)
    return got, want


@pytest.fixture(scope="module")
def larger(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("larger")
    spark.range(100_001).selectExpr("id AS o_orderkey", "id % 40 AS o_custkey", "'F' AS o_orderstatus", "1000.0 AS o_totalprice").write.parquet(f"{folder}/orders.parquet")
    spark.range(60).selectExpr("id AS c_custkey").write.parquet(f"{folder}/customer.parquet")
    spark.range(25).selectExpr("id AS n_nationkey", "'N' || id AS n_name").write.parquet(f"{folder}/nation.parquet")
    spark.range(1, 2500).selectExpr("id AS s_suppkey", "id % 25 AS s_nationkey", "CAST(id * 37 % 11000 AS DOUBLE) AS s_acctbal").write.parquet(f"{folder}/supplier.parquet")
    # 0.29 and 0.57 as floats lie just below, so that a product rounded to float is a whole number too many.
    value = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: ((k * 13 + F.col("id") * 29) % 199 / 100.0 - 1).cast("float"))
    spark.range(60).select(F.col("id").alias("vec_id"), (F.col("id") % 3).cast("int").alias("label"), value.alias("embedding")).write.parquet(f"{folder}/embeddings.parquet")
    return folder


@pytest.mark.parametrize("name", "attestation attestation_text reused_ids frame_downsample frame_redact frame_window reformat tiled_redact tiled_reformat default_windows quarantine_release".split())
def test_larger_tables(spark, larger, name):
    got, want = rows(spark, larger, name)
    assert got == want


def test_manifest_of_many_files_is_written_in_parts(spark, larger, monkeypatch):
    made, whole = [], verify.manifest
    monkeypatch.setattr(verify, "manifest", lambda *a, **k: made.append(whole(*a, **k)) or made[-1])
    got, want = rows(spark, larger, "checksum_file")
    assert got == want
    assert made[0].where("text IS NOT NULL").agg(F.max("files")).first()[0] < 100_000


def test_objects_are_parsed_once(spark):
    lines = spark.createDataFrame([(1, '{"00080016":{"vr":"UI","Value":["1.2"]}}'), (2, "[]"), (3, "no"), (4, "{}")], "instance_id long, json string")
    objects = dicom_json.parsed(lines)
    assert sorted(map(tuple, dicom_json.outcomes(objects).collect())) == [(1, "", 1), (2, "not an object", 0), (3, "not JSON", 0), (4, "", 0)]
    assert sorted(map(tuple, dicom_json.rejected(objects).collect())) == [(2, "not an object"), (3, "not JSON")]
    # A filter below the levels would hold the parse once more, and the levels in one piece.
    for made in (dicom_json.rejected(objects), dicom_json.outcomes(objects), dicom_json.elements_of(objects)):
        assert made._jdf.queryExecution().optimizedPlan().toString().count("parseJson(") == 1


def test_tasks_do_not_grow_with_the_table(spark):
    assert stand_in.spread(spark.range(1000), "id", most=100).rdd.getNumPartitions() >= 10


def test_rules_are_worked_out_once(spark):
    e = spark.createDataFrame([(1, "S", "data", "StudyInstanceUID", "UI", False, "1.2.3"), (1, "S", "data", "ImageComments", "LT", False, "x"), (1, "S", "data", "ContentDate", "DA", False, None)], "instance_id long, study_id string, grp string, path string, vr string, is_private boolean, value string")
    made = deidentify.rewritten(e, F.lit("s"))
    assert {r["path"]: r["value"] for r in made.collect()} == {"StudyInstanceUID": made.sparkSession.range(1).select(exprs.hashed_uid(F.lit("1.2.3"), F.lit("s"))).first()[0], "ContentDate": None}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(made).count("ClinicalTrialSponsorName") == 1
    assert plan(verify.element_findings(e)).count("vendor hint present") == 1


SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_dry_run_works_headers_out_once(spark):
    assert "o_orderkey#" not in optimized(entry.queries()["dry_run"](spark, SF))


def test_frequent_texts_are_not_dealt_out_by_text(spark):
    texts = ["7 MILL LANE"] * 30 + ["SCAN OF OTTER"] * 20 + ["OTTER^ADA", "OTTER", "OTT", "WREN AND OTTER"]
    swept = spark.createDataFrame([(n, "PatientName" if t == "OTTER" else "ImageComments", t) for n, t in enumerate(texts)], "instance_id long, keyword string, text string")
    needles = spark.createDataFrame([("OTTER",), ("WREN",), ("LYNX",)], "needle string")
    want = {(n, "ImageComments", "OTTER") for n, t in enumerate(texts) if "OTTER" in t and t != "OTTER"} | {(53, "ImageComments", "WREN")}
    for many in (1, 10, 20, 1000):
        assert sorted(map(tuple, verify.needle_hits(swept, needles, many=many).collect())) == sorted(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_files_log_reads_images_once(spark):
    assert optimized(entry.queries()["files_log"](spark, SF)).count("Relation [l_orderkey#") == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_study_counts_decide_once(spark):
    # Images once, and the objects that can't be read twice.
    assert optimized(entry.queries()["study_counts"](spark, SF)).count("Relation [l_orderkey#") <= 3
    parts = stand_in.images(spark, SF).select("patient", F.spark_partition_id().alias("p")).groupBy("patient").agg(F.countDistinct("p").alias("n"))
    assert parts.agg(F.max("n")).first()[0] <= 16


def test_run_totals_work_the_summary_out_once(spark):
    summary = spark.range(5).select(F.concat(F.lit("S"), F.col("id").cast("string")).alias("study_id"), F.col("id").alias("files"), F.lit(1).alias("series"), F.lit(0).alias("review_files"))
    made = audit.run_totals(summary)
    assert "Range" not in optimized(made) and made.first()["first_empty"] == "S0"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_verify_output_rewrites_for_all_profiles_at_once(spark):
    # Once for the elements, once for the added attributes and once for what objects say of themselves.
    assert optimized(entry.queries()["verify_output"](spark, SF)).count("Relation [o_orderkey#") <= 3


def test_findings_of_all_profiles_are_those_of_each(spark):
    rows = [
        ("data", "PatientName", "PN", False, "OTTER^ADA"), ("data", "PatientID", "LO", False, "H1"), ("data", "PatientBirthDate", "DA", False, "19500203"), ("data", "PatientAge", "AS", False, "058Y"),
        ("data", "StudyDate", "DA", False, "20190304"), ("data", "ContentDate", "DA", False, None), ("data", "SeriesDate", "DA", False, "20190304\\20190305"), ("data", "AcquisitionDateTime", "DT", False, "20190304091500.5"), ("data", "StudyTime", "TM", False, "083005"),
        ("data", "BodyPartExamined", "CS", False, "no 943 476 5919"), ("data", "LaterName", "LO", False, "at AB1 2CD on 20190304"), ("data", "(0008,9999)", "AE", False, "ARCHIVE7"), ("data", "(0051,1001)", "UN", True, "16"),
        ("data", "StudyInstanceUID", "UI", False, "1.2.3"), ("data", "SOPInstanceUID", "UI", False, "1.2.3.4"), ("data", "SOPClassUID", "UI", False, "1.2.840.10008.5.1.4.1.1.2"), ("data", "FrameOfReferenceUID", "UI", False, "1.2.9\\1.2.840.10008.1.4.1.1\\"),
        ("data", "ReferencedImageSequence[0].(0b05,1002)", "UN", True, "12"), ("data", "ReferencedImageSequence[0].ReferencedSOPInstanceUID", "UI", False, "1.2.5"), ("data", "ConvolutionKernel", "SH", False, "K21"), ("data", "Manufacturer", "LO", False, "Maker 19991231"),
        ("data", "StationName", "SH", False, "CT1"), ("data", "ImageType", "CS", False, "A\\B\\C\\D9"), ("data", "PatientWeight", "DS", False, "70"), ("data", "PregnancyStatus", "US", False, "4"), ("meta", "SendingApplicationEntityTitle", "AE", False, "ARCHIVE7"), ("meta", "MediaStorageSOPInstanceUID", "UI", False, "1.2.3.4"),
    ]
    e = spark.createDataFrame([(n, f"S{n}" if n else None, *r) for n in range(3) for r in rows[n:]], "instance_id long, study_id string, grp string, path string, vr string, is_private boolean, value string")
    profiles = P.PROFILES | {"described": P.Profile(keep_age_5y=True, patient_name="custom", patient_name_text="X^Y", study_description="a trial", keep_institution=True)}
    each = {name: verify.verify(deidentify.deidentify(e, F.lit("s"), p), p).collect() for name, p in profiles.items()}
    want = sorted((name, *r) for name, rows in each.items() for r in rows)
    assert all(each.values()) and sorted(map(tuple, verify.verify_rewritten(e, F.lit("s"), profiles).collect())) == want
    outputs = sorted(((name, *r) for name, p in profiles.items() for r in deidentify.deidentify(e, F.lit("s"), p).collect()), key=repr)
    columns = ["profile", *deidentify.COLUMNS]
    got = deidentify.rewritten_each(e, F.lit("s"), profiles).select(*columns).unionByName(deidentify.added_each(e, F.lit("s"), profiles).select(*columns))
    assert sorted(map(tuple, got.collect()), key=repr) == outputs


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_output_names_are_numbered_in_one_shuffle(spark):
    plan = entry.queries()["files_log"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(safe#") == 1 and "Exchange hashpartitioning(folder#" not in plan
    assert plan.count("merge_min(output_path#") <= 1


def test_studies_of_one_safe_name_share_their_folder(spark):
    rows = [("a b", "p1", None, 1, "7"), ("a_b", "p0", None, 1, "7"), ("a_b", "p2", None, 1, ""), ("a b", "p3", None, 1, ""), ("a b", "p4", "x", 1, "7")]
    made = identity.with_output_names(spark.createDataFrame(rows, "study_id string, path string, review string, series_number int, instance_number string"))
    got = {r["path"]: f"{r['folder']}/{r['name']}" for r in made.collect()}
    assert got == {"p0": "a_b/S001/a_b_S001_I00007.dcm", "p1": "a_b/S001/a_b_S001_I00007_1.dcm", "p2": "a_b/S001/a_b_000002.dcm", "p3": "a_b/S001/a_b_000002_2.dcm", "p4": "_review/a_b/a_b_S001_I00007.dcm"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["tag_policy_profile", "plain_changes"])
def test_elements_stay_together_where_patients_are_too_many_to_broadcast(spark, name):
    """Tables join by shuffles, and objects are dealt out after that; what is made of their elements is shuffled no more."""
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        made = entry.queries()[name](spark, SF)
        assert "Exchange hashpartitioning(instance_id#" not in made._jdf.queryExecution().executedPlan().toString()
        apart = {tuple(r) for r in made.where("instance_id < 40").collect()}
    finally:
        spark.conf.set(limit, before)
    assert apart == {tuple(r) for r in entry.queries()[name](spark, SF).where("instance_id < 40").collect()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_the_rewrite_for_several_profiles_is_compiled(spark):
    """The JVM only interprets methods of over 8,000 bytes; names, private steps and actions were in one of 11,448 with all that makes an element."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        e = queries.with_study(spark, SF).select(*deidentify.COLUMNS)
        parts = deidentify.rewritten_each(e, F.lit("s"), P.PROFILES)._jdf.queryExecution().debug().codegenToSeq()
        assert max(parts.apply(k)._3().maxMethodCodeSize() for k in range(parts.size())) <= 8000
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
