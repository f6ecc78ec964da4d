import hashlib

import pytest
from pyspark.sql import functions as F

from cohortveil.functions import exprs as X
from cohortveil.functions import policy as P


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_hashed_uid(spark):
    for text in ("b", "1.2.3", "é"):
        want = "2.25." + str(int.from_bytes(hashlib.sha256(f"a|{text}".encode()).digest()[:16], "big"))
        assert one(spark, X.hashed_uid(F.lit(text), F.lit("a"))) == want
    assert one(spark, X.hashed_uid(F.lit("b"), F.lit("a"))) == "2.25.19499874484544496864165855615606221487"


@pytest.mark.parametrize(
    ("column", "want"),
    [
        (lambda: X.shift_da(F.lit("20190522"), F.lit(1)), "20190521"),
        (lambda: X.shift_da(F.lit("2019"), F.lit(1)), P.DUMMY_DATE),
        (lambda: X.shift_da(F.lit(""), F.lit(1)), P.DUMMY_DATE),
        (lambda: X.shift_dt(F.lit("20190522154522.12"), F.lit(22)), "20190430154522.12"),
        (lambda: X.age_years(F.lit("058Y"), F.lit(""), F.lit(""), F.lit("")), 58),
        (lambda: X.age_years(F.lit(""), F.lit("19610314"), F.lit("20190313"), F.lit("")), 57),
        (lambda: X.age_years(F.lit(None).cast("string"), F.lit("19610314"), F.lit(""), F.lit("20190314")), 58),
        (lambda: X.age_years(F.lit(""), F.lit("20200101"), F.lit("20190314"), F.lit("")), None),
        (lambda: X.age_bucket(F.lit(58)), "055Y"),
        (lambda: X.age_bucket(F.lit(124)), "120Y"),
        (lambda: X.age_bucket(F.lit(None).cast("int")), None),
        (lambda: X.nhs_valid(F.lit("9434765919")), True),
        (lambda: X.nhs_valid(F.lit("9434765918")), False),
        (lambda: X.safe_name(F.lit("a b/c__")), "a_b_c"),
        (lambda: X.safe_name(F.lit("//")), "unnamed"),
        (lambda: X.norm_desc(F.lit("  CTA   0.75 ")), "cta 0.75"),
        (lambda: X.number_text(F.lit(0.75)), "0.75"),
        (lambda: X.number_text(F.lit(3.0)), "3"),
        (lambda: X.gated_description(F.lit("SnapShot Pulse")), "ge_gated_cta"),
        (lambda: X.remap_path(F.lit("/Volumes/A/x"), "/Volumes/A", "/mnt/b/"), "/mnt/b/x"),
        (lambda: X.remap_path(F.lit("/Volumes/AB/x"), "/Volumes/A", "/mnt/b"), "/Volumes/AB/x"),
        (lambda: X.file_name(F.lit("C 1"), F.lit("5"), F.lit("12"), F.lit(3)), "C_1_S005_I00012.dcm"),
        (lambda: X.file_name(F.lit("C1"), F.lit("5"), F.lit(""), F.lit(3)), "C1_000003.dcm"),
        (lambda: X.nice(F.lit("JONES^MARY^^Mrs"), F.lit("name")), "JONES MARY Mrs"),
        (lambda: X.nice(F.lit("030M"), F.lit("age")), "30 months"),
        (lambda: X.nice(F.lit("F"), F.lit("sex")), "female"),
        (lambda: X.nice(F.lit("19610314"), F.lit("date")), "14 Mar 1961"),
        (lambda: X.eta_text(F.lit(30.0), F.lit(0.5)), "under a minute left"),
        (lambda: X.eta_text(F.lit(60.0), F.lit(0.25)), "about 3 min left"),
        (lambda: X.eta_text(F.lit(3600.0), F.lit(0.25)), "about 3 h 00 min left"),
        (lambda: X.redact_paths(F.lit("at /home/ann/x and C:\\Users\\bob\\y")), "at /home/<user>/x and C:\\Users\\<user>\\y"),
        (lambda: X.profile_slug(F.lit("Blinded read (default)")), "blinded-read-default"),
    ],
)
def test_scalars(spark, column, want):
    assert one(spark, column()) == want


def test_needles_and_natural_order(spark):
    assert one(spark, X.split_needles(F.lit("a, b;;c\n"))) == ["a", "b", "c"]
    names = ["P10", "P2", "p1"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(X.natural_key(F.col("n"))).collect()
    assert [r["n"] for r in rows] == ["p1", "P2", "P10"]


def test_profiles(spark, tmp_path):
    assert P.Profile(keep_sex=True, shift_dates=True).method().endswith("kept:sex,dates-shifted")
    assert P.Profile().problems() == [] and P.Profile(patient_name="custom").problems() and P.Profile(name=" ").problems()
    (tmp_path / "p.json").write_text('{"name": "x", "keep_sex": true, "keep_age_5y": "yes", "other": 1}')
    assert P.read_profile(spark, str(tmp_path / "p.json")) == P.Profile(name="x", keep_sex=True)
    table = {(r["keyword"], r["action"]) for r in P.policy(spark, P.Profile(keep_sex=True)).collect()}
    assert ("PatientSex", "remove") not in table and ("PatientAge", "remove") in table and ("StationName", "clear") in table
    assert len(P.REMOVE) == 78 and len(P.CLEAR) == 19 and len(P.VENDOR_HINTS) == 9 and len(P.UID_KEEP) == 8


def test_numbers_of_any_size(spark):
    values = [0.00005, 123456.7, 2e9, 0.75, 100.0, 0.0, -1.5, 999999.5, 1e100, 0.1234567, 1234567.0, 0.0001, -2.5e-7]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", X.number_text(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in got] == [f"{r['v']:g}" for r in got]
    texts = ["7", "12.9", "-5", "9999999999", "1e30", "x", "", "1e300", "Infinity"]
    names = spark.createDataFrame([(t,) for t in texts], "t string").select(X.file_name(F.lit("A"), F.col("t"), F.col("t"), F.lit(3)).alias("n")).collect()
    assert [r["n"] for r in names] == ["A_S007_I00007.dcm", "A_S012_I00012.dcm", "A_S-05_I-0005.dcm", "A_S9999999999_I9999999999.dcm", f"A_S1{'0' * 30}_I1{'0' * 30}.dcm", *["A_000003.dcm"] * 4]


def test_natural_order_of_long_numbers(spark):
    names = ["1.2.9", "1.2.10", "1.2.123456789012345678901", "1.2.123456789012345678902", "1.2.99999999999999999999", "1.2.007", "a2b", "a10b"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").orderBy(X.natural_key(F.col("n"))).collect()
    assert [r["n"] for r in rows] == ["1.2.007", "1.2.9", "1.2.10", "1.2.99999999999999999999", "1.2.123456789012345678901", "1.2.123456789012345678902", "a2b", "a10b"]


def test_faults_of_profiles():
    good = P.Profile(name="Trial", patient_name="custom", patient_name_text="CASE")
    assert good.checks() == P.Profile().checks() == []
    assert P.Profile(name=" ", patient_name="custom").checks() == [("name", "empty"), ("patient_name_text", "empty")]
    assert P.Profile(patient_name="nobody", study_description="a\n", method_text="x\\" + "y" * 64).checks() == [("patient_name", "unknown"), ("study_description", "forbidden"), ("method_text", "forbidden"), ("method_text", "long")]
    assert all(w.split()[0] in {"name", "patient_name", "patient_name_text", "study_description", "method_text"} for w in P.Profile(name="", patient_name="x").problems())


def test_uid_steps_in_words_and_places(spark):
    """Places of nine digits carry, leading zeros go, and nothing gives nothing."""
    numbers = [0, 7, 10**9 - 1, 10**9, 10**18, 10**27 - 1, 10**27, 2**32, 2**64, 2**96 - 1, 2**128 - 1]
    df, last = spark.createDataFrame([(str(n), f"{n:032x}") for n in numbers] + [(None, None)], "n string, digest string"), ["digest"]
    for columns in X.uid_steps():
        df, last = df.select("n", *(made({c: F.col(c) for c in last}).alias(name) for name, made in columns.items())), list(columns)
    assert [tuple(r) for r in df.collect()] == [(str(n), f"2.25.{n}") for n in numbers] + [(None, None)]
    hashed = X.with_hashed_uid(spark.createDataFrame([("b",), (None,), ("c",)], "v string"), F.col("v"), F.lit("a"), F.col("v") != "c")
    assert [r["uid"] for r in hashed.collect()] == ["2.25.19499874484544496864165855615606221487", None, None]


def test_dates_of_early_years_and_no_dates(spark):
    rows = ["00000229", "00010101", "15821010", "20190229", "20191301", " 20200229x", "2020022", "99991231", None]
    got = spark.createDataFrame([(x,) for x in rows], "v string").select(X.parsed_date(F.col("v")).cast("string").alias("d"), X.shift_da(F.col("v"), F.lit(1)).alias("s")).collect()
    assert [r["d"] for r in got] == ["0000-02-29", "0001-01-01", "1582-10-10", None, None, "2020-02-29", None, "9999-12-31", None]
    assert [r["s"] for r in got] == ["00000228", "00001231", "15821009", P.DUMMY_DATE, P.DUMMY_DATE, "20200228", P.DUMMY_DATE, "99991230", P.DUMMY_DATE]


def test_age_buckets_by_steps(spark):
    rows = [("058Y", "", "", ""), ("", "19610314", "20190313", ""), (None, "19610314", "", "20190314"), ("030M", "19610314", "20190314", ""), ("03xY", "19610314", "20190314", ""), ("", "20200101", "20190101", ""), ("", None, "20190101", "")]
    made = X.with_age_bucket(spark.createDataFrame(rows, "a string, b string, s string, e string"), *map(F.col, "abse"))
    assert made.columns == ["a", "b", "s", "e", "bucket"] and [r["bucket"] for r in made.collect()] == ["055Y", "055Y", "055Y", "000Y", "055Y", None, None]
