import pytest

from cohortveil.operators import intake, series

SCHEMA = "study_id string, series_uid string, n_files long, sample string, series_number int, description string, modality string, sop_class_uid string, image_type string, slice_mm double, fov_mm double, kernel string, contrast string, phase double, frames int, burned_in string"
BASE = {
    "study_id": "P1", "series_uid": "u1", "n_files": 240, "sample": "f", "series_number": 8, "description": "Heart angio thin", "modality": "CT", "sop_class_uid": "1.2.840.10008.5.1.4.1.1.2", "image_type": "ORIGINAL\\PRIMARY\\AXIAL",
    "slice_mm": 0.6, "fov_mm": 180.0, "kernel": "K21", "contrast": "iodine", "phase": None, "frames": 0, "burned_in": None,
}


def table(spark, *rows):
    full = [BASE | {"series_uid": f"u{k}"} | r for k, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in full], SCHEMA)


FINE = "coronary recon: 0.6 mm, FOV 180, K21"


@pytest.mark.parametrize(
    ("change", "verdict", "reason"),
    [
        ({"slice_mm": 0.8, "fov_mm": 260.0, "n_files": 100}, "keep", "coronary recon: 0.8 mm, FOV 260, K21"),
        ({"n_files": 99, "frames": 99, "slice_mm": 2.25}, "drop", "2.25 mm slices; only 99 images"),
        ({"n_files": 2, "frames": 100}, "keep", FINE),
        ({"fov_mm": 261.0}, "drop", "FOV 261 mm (chest recon)"),
        ({"fov_mm": 0.0, "kernel": ""}, "keep", "coronary recon: 0.6 mm"),
        ({"slice_mm": None}, "keep", "coronary recon: unknown mm, FOV 180, K21"),
        ({"kernel": "xLUNGy", "description": "Late phase, sagittal"}, "drop", "kernel xLUNGy; description 'late phase'"),
        ({"description": "snap  shot burst heart cta"}, "keep", FINE),
        ({"contrast": None, "description": "thin 4"}, "maybe", FINE + " - no contrast agent / cardiac phase in header"),
        ({"contrast": None, "description": "thin 4", "phase": 40.0}, "keep", FINE),
        ({"image_type": "derived\\primary"}, "drop", "localiser/derived"),
        ({"modality": None, "sop_class_uid": None}, "drop", "not a CT image (?)"),
        ({"modality": "CT", "sop_class_uid": "1.2.840.10008.5.1.4.1.1.88.99"}, "drop", "not a CT image (CT)"),
    ],
)
def test_rule(spark, change, verdict, reason):
    row = series.classify(table(spark, change)).first()
    assert (row["verdict"], row["reason"]) == (verdict, reason)


def decide(spark, *rows, **more):
    return {r["series_uid"]: (r["decision"], r["reason"]) for r in series.decide(series.classify(table(spark, *rows)), **more).collect()}


def test_cascade_levels(spark):
    maybe = {"contrast": "", "description": "x"}
    assert [v[0] for v in decide(spark, {}, maybe).values()] == ["keep", "drop"]
    got = decide(spark, maybe, {"n_files": 3})
    assert got["u0"][0] == "keep" and got["u0"][1].endswith("[kept as fallback - CHECK]")
    last = decide(spark, {"image_type": "DERIVED\\PRIMARY"}, {"slice_mm": 3.0})
    assert last["u0"][0] == "keep" and "[only thin primary series in export]" in last["u0"][1] and last["u1"][0] == "drop"
    assert {v[0] for v in decide(spark, {"image_type": "DERIVED\\PRIMARY"}, {"image_type": "DERIVED\\PRIMARY"}).values()} == {"drop"}


def test_picks_and_selection(spark):
    pick = lambda uid, desc: spark.createDataFrame([("P1", uid, desc)], "study_id string, series_uid string, series_description string")
    got = decide(spark, {}, {"description": "Other one"}, picks=pick("", "other  ONE"))
    assert got["u1"] == ("keep", "analysed series (FAI pick)") and got["u0"][0] == "drop"
    thick = decide(spark, {}, {"slice_mm": 2.0}, picks=pick("u1", ""))
    assert thick["u0"][0] == "keep" and thick["u1"][1].endswith("[FAI pick but 2 mm]")
    chosen = spark.createDataFrame([("P1", "u1")], "study_id string, series_uid string")
    assert decide(spark, {}, {"slice_mm": 3.0}, selection=chosen) == {"u0": ("drop", "not ticked in the viewer"), "u1": ("keep", "ticked in the viewer")}
    totals = {r["match"]: r["picks"] for r in series.pick_totals(series.picked(table(spark, {}), pick("nope", ""))).collect()}
    assert totals == {"unmatched": 1}


def test_grouping_is_the_same_for_any_partitioning(spark):
    rows = [("s", "u1", f"p{k:03d}", 3, "d" if k else "first") for k in range(120)] + [("s", None, "q", 7, "x")]
    df = spark.createDataFrame(rows, "study_id string, series_uid string, path string, series_number int, description string")
    for n in (1, 7):
        got = {r["series_uid"]: (r["n_files"], r["description"]) for r in series.group_series(df.repartition(n)).collect()}
        assert got == {"u1": (120, "first"), "nouid-7": (1, "x")}


def test_survey(spark):
    got = series.survey(table(spark, {}, {"n_files": 12}, {"contrast": "", "description": "zz", "study_id": "P2"}))
    told = {r["series_uid"]: (r["decision"], r["reason"]) for r in got.collect()}
    assert told["u0"][0] == "keep" and told["u1"] == ("drop", "only 12 images")
    assert told["u2"] == ("check", "no contrast field and no CTA keyword in description [NO keep candidate in this study]")


def test_units_and_nesting(spark):
    row = lambda p, s, path: (p, s, path, "u" + path)
    df = spark.createDataFrame([row("A", "1", "a/x/1"), row("A", "2", "a/y/1"), row("B", "1", "b/1"), row("B", "2", "b/c/2"), row("C", "1", "b/d/1")], "patient string, study string, path string, series_uid string")
    got = {(r["patient"], r["study"]): r["folder"] for r in intake.units(df).collect()}
    assert got == {("A", "1"): "a/x", ("A", "2"): "a/y", ("B", None): "b", ("C", None): "b/d"}
    assert intake.is_mixed(intake.units(df)).first()["mixed"]
