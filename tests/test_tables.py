from cohortveil.operators import audit, frames, tables
from pyspark.sql import functions as F


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_selection_and_picks(spark):
    sel = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3")], "study_id string, series_uid string")
    new = spark.createDataFrame([("a", "9"), ("b", "")], "study_id string, series_uid string")
    assert rows(tables.replaced(sel, new)) == [("a", "9")] and rows(tables.without(sel, new.where("study_id = 'a'"))) == [("b", "3")]
    picks = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y")], "study_id string, series_uid string, series_description string")
    thick = spark.createDataFrame([("7", "z", 2.0)], "series_uid string, description string, slice_mm double")
    got = {r["study_id"]: (r["series_uid"], r["warning"]) for r in tables.pick_override(picks, "a", thick).collect()}
    assert got["b"] == ("2", None) and got["a"][0] == "7" and got["a"][1].startswith("thicker than 0.8 mm")


def test_survey_copies(spark):
    survey = spark.createDataFrame([("p 1", "u", " Keep"), ("p 1", "v", "drop")], "patient string, series_uid string, decision string")
    files = spark.createDataFrame([("p 1", "u", 5, "a/1.dcm"), ("p 1", "u", 5, "b/1.dcm"), ("p 1", "v", 6, "a/2.dcm")], "patient string, series_uid string, series_number int, path string")
    assert rows(tables.copy_plan(files, tables.survey_kept(survey))) == [("a/1.dcm", "p_1/S005/1.dcm"), ("b/1.dcm", "p_1/S005/1_1.dcm")]


def test_reports_and_needles(spark):
    links = spark.createDataFrame([("123;4567", "SMITH^J", "19000101")], "original_patient_id string, original_name string, original_dob string")
    assert rows(tables.linkage_needles(links)) == [("4567",), ("SMITH^J",)]
    none = spark.createDataFrame([], "kind string")
    assert rows(tables.report_split(none)[0]) == [("PASS", 0)]
    lines = spark.createDataFrame([("[3/12] P3: starting, 224 files to write",), ("  P3: 200 files...",), ("x",)], "line string")
    assert [(r["study"], r["expected"], r["written"]) for r in tables.started(lines).orderBy("expected").collect()] == [("P3", None, 200), ("P3", 224, None)]


def test_views(spark):
    s = spark.createDataFrame([("a", "u", 3, "keep", "r", "keep"), ("a", "v", 4, "drop", "r", "drop"), ("b", "w", 1, "maybe", "r", "drop")], "study_id string, series_uid string, images long, verdict string, reason string, decision string")
    assert rows(tables.coronary_summary(s)) == [("a", "keep 1 series"), ("b", "possibly")]
    held = spark.createDataFrame([("a", "x", 2, "Modality SR")], "study_id string, series_uid string, n_files long, review string")
    assert rows(tables.output_series(s, held)) == [("a", "u", 3, "keep", "r"), ("a", "x", 2, "review", "quarantined: Modality SR")]
    k = spark.createDataFrame([("CT", "a", 0.5), ("CT", "b", 0.5)], "modality string, kind string, slice_mm double")
    assert tables.tick_shown(k.limit(0), k, True).count() == 2 and tables.tick_shown(k, k.where("kind = 'a'"), False).count() == 1
    out, now = spark.createDataFrame([("A 1",), ("B",)], "study_id string"), spark.createDataFrame([("A_1",)], "study_id string")
    assert rows(tables.not_this_run(out, now)) == [("B",)]
    mixed = spark.createDataFrame([("f", "a"), ("f", "A "), ("g", "a"), ("g", "b")], "source_folder string, patient_id string")
    assert rows(tables.case_mismatch(mixed)) == [("g", 2)]
    files = spark.createDataFrame([("u", f"p{i}", i) for i in range(5)], "series_uid string, path string, nth int")
    assert rows(tables.sample_files(files)) == [("u", "p2")]
    assert spark.range(1).select(tables.unit_label(F.lit("/r/a/b"), F.lit("k"), "/r"), tables.unit_label(F.lit("/r"), F.lit("k"), "/r")).first()[:] == ("a/b", "k")


def test_output_state(spark):
    log = spark.createDataFrame([("S1", 3, "d", 1, "drop", "old"), ("S1", 3, "d", 2, "keep", "x [kept as fallback - CHECK]"), ("S2", 1, "e", 1, "keep", "r"), ("S2", 2, "e", 1, "drop", "r")], "study_id string, number int, description string, run int, decision string, reason string")
    newest = audit.newest(log, ["study_id", "number", "description"])
    assert tuple(audit.decision_counts(newest).first()) == (2, 2, 1, 1)
    assert audit.filter_decisions(newest, "Needs a look").count() == 1 and audit.filter_decisions(newest, "All", "s2").count() == 2
    facts = spark.createDataFrame([("FAIL", 5, 9, 0, 1, 2, 1, 0, False)], "status string, verified_at long, last_run_at long, complete long, partial long, review_files long, linkage_files long, other_logs long, attested boolean")
    assert {r["title"] for r in audit.readiness(facts).where("level = 'block'").collect()} == {"Verify FAILED", "No completed studies", "1 linkage file(s) still in the output tree"}
    assert audit.done_headline(facts).first()["headline"] == "Check failed: do not share"


def test_frames(spark):
    f = spark.createDataFrame([(k, "s", 4, 4, "MONOCHROME2", -480 - 0.5 * k, [float(16 * k + i) for i in range(16)]) for k in range(3)], "instance_id int, series_uid string, rows int, cols int, photometric string, z double, pixels array<double>")
    assert frames.slice_spacing(f).first()["spacing"] == 0.5
    assert frames.reformatted(f, "Coronal", 1).first()["pixels"] == [4, 5, 6, 7, 20, 21, 22, 23, 36, 37, 38, 39]
    box = spark.createDataFrame([(0, 3, 9, 1, -5)], "instance_id int, x0 int, y0 int, x1 int, y1 int")
    painted = {r["instance_id"]: r["pixels"] for r in frames.redacted(f, box).collect()}
    assert [i for i, v in enumerate(painted[0]) if v == 0] == [0, 1, 2, 5, 6, 9, 10, 13, 14] and painted[1][0] == 16
    grey = f.where("instance_id = 0").select(frames.windowed(F.col("pixels"), F.lit(8.0), F.lit(16.0)).alias("w"), frames.default_window(F.array(F.lit(40.0)), F.array(F.lit(0.0))).alias("d"), frames.value_at(F.col("pixels"), F.col("cols"), F.lit(1), F.lit(2)).alias("v")).first()
    assert grey["w"][0] == 0 and grey["w"][15] == 239 and grey["d"] is None and grey["v"] == 9
    held = spark.createDataFrame([(1, "S1")], "instance_id int, study_id string")
    assert [(r["instance_id"], r["route"]) for r in frames.released(f, box, held).collect()] == [(1, "study")]


def test_run_totals_pass_on_the_first_empty_studies_only(spark):
    rows = [(f"s{k:02}", 0 if k % 2 else 3, 1, 0) for k in range(60)] + [(None, 0, 0, 0)]
    got = audit.run_totals(spark.createDataFrame(rows, "study_id string, files long, series long, review_files long").repartition(5))
    assert tuple(got.first()) == (61, 90, 60, 0, 31, ", ".join(f"s{k:02}" for k in range(1, 40, 2)))
    assert "TakeOrderedAndProject(limit=20" in got._jdf.queryExecution().executedPlan().toString()


def test_tiles_of_multi_frame_objects(spark):
    """Two objects of three 5 by 7 frames: tiles are painted in every frame, and planes through them are those of the volume."""
    import numpy as np

    v = np.arange(210, dtype=float).reshape(2, 3, 5, 7)
    f = spark.createDataFrame([(k, "s", float(-k), 5, 7, "MONOCHROME1" if k else "MONOCHROME2", v[k].ravel().tolist()) for k in range(2)] + [(9, "s", 9.0, 5, 7, "", [1.0] * 36)], "instance_id int, series_uid string, z double, rows int, cols int, photometric string, pixels array<double>")
    box = spark.createDataFrame([(k, 5, 4, 1, 2) for k in (0, 1, 9)], "instance_id int, x0 int, y0 int, x1 int, y1 int")
    want = v.copy()
    want[0, :, 2:4, 1:5], want[1, :, 2:4, 1:5] = 0, v[1].max()
    for edge in (2, 3, 100):
        got = np.full(v.shape, -1.0)
        for t in frames.redacted_tiles(frames.tiles(f, edge), box).collect():
            got[t.instance_id, t.frame, t.row0 : t.row0 + t.height, t.col0 : t.col0 + t.width] = np.reshape(t.pixels, (t.height, t.width))
            assert t.height <= edge and t.width <= edge
        assert (got == want).all()
        volume = np.concatenate((v[1], v[0]))
        for orientation, index, plane in (("Axial", 4, volume[4]), ("Axial", 99, volume[5]), ("Coronal", 2, volume[::-1, 2, :]), ("Sagittal", 6, volume[::-1, :, 6])):
            image = np.full(plane.shape, -1.0)
            for t in frames.reformatted_tiles(frames.tiles(f, edge), orientation, index, edge).collect():
                image[t.row0 : t.row0 + t.height, t.col0 : t.col0 + t.width] = np.reshape(t.pixels, (t.height, t.width))
            assert (image == plane).all()
    assert {r.instance_id: r.pixels for r in frames.redacted(f, box).collect()} == {k: want[k].ravel().tolist() for k in range(2)}
