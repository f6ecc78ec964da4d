"""Series of images: grouping, classifying and choosing the ones to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy as P
from ..functions.exprs import gated_description, norm_desc, number_text

HEADER = ("series_number", "description", "modality", "sop_class_uid", "image_type", "slice_mm", "fov_mm", "kernel", "contrast", "phase", "frames", "burned_in")


def series_key() -> Column:
    """The series UID, or nouid-<series number> where it is missing."""
    return F.when(F.coalesce(F.col("series_uid"), F.lit("")) == "", F.concat(F.lit("nouid-"), F.coalesce(F.col("series_number").cast("string"), F.lit("0")))).otherwise(F.col("series_uid"))


def group_series(images: DataFrame, study: str = "study_id") -> DataFrame:
    """One row a series: number of files and the header of the file with the smallest path.

    A missing series UID becomes nouid-<series number>.  Partial aggregation
    leaves a shuffle of one row a series and task.
    """
    head = F.struct(*(F.col(c) for c in HEADER if c in images.columns))
    grouped = images.withColumn("series_uid", series_key()).groupBy(F.col(study).alias("study_id"), "series_uid").agg(F.count("*").alias("n_files"), F.min_by(head, "path").alias("head"), F.min("path").alias("sample"))
    return grouped.select("study_id", "series_uid", "n_files", "sample", "head.*")


def not_ct(of: Column, sop: Column) -> Column:
    return (F.coalesce(of, F.lit("")) != "CT") | sop.isin(P.REVIEW_SOP_CLASSES) | sop.startswith(P.REPORT_SOP_PREFIX)


def derived(image_type: Column) -> Column:
    t = F.upper(F.coalesce(image_type, F.lit("")))
    return t.contains("LOCALIZER") | t.contains("SECONDARY") | t.contains("DERIVED") | t.contains("MPR")


def first_word(text: Column, words: list[str]) -> Column:
    """The first of the words that the text contains, or null."""
    return F.coalesce(*(F.when(text.contains(w), F.lit(w)) for w in words))


def classify(series: DataFrame) -> DataFrame:
    """verdict (keep, maybe, drop) and reason of each series by the coronary rule; all reasons to drop are told."""
    kernel, desc = F.coalesce("kernel", F.lit("")), F.coalesce("description", F.lit(""))
    sop, frames = F.coalesce("sop_class_uid", F.lit("")), F.coalesce(F.col("frames"), F.lit(0))
    low = F.lower(kernel)
    sharp = F.lit(False)
    for k in P.SHARP_KERNELS:
        sharp = sharp | low.contains(k.lower())
    series = series.withColumn("gated", gated_description(desc))
    word = F.get(F.filter(F.array(*map(F.lit, P.DROP_WORDS)), lambda w: F.contains(F.col("gated"), w)), F.lit(0))
    fov = F.when(F.col("fov_mm") != 0, F.col("fov_mm"))
    whole = F.rint(fov).try_cast("decimal(38,0)").cast("string")
    reasons = F.concat_ws(
        "; ",
        F.when(not_ct(F.col("modality"), sop), F.concat(F.lit("not a CT image ("), F.coalesce("modality", F.lit("?")), F.lit(")"))),
        F.when(derived(F.col("image_type")), "localiser/derived"),
        F.when(F.col("slice_mm") > P.MAX_SLICE_MM, F.concat(number_text(F.col("slice_mm")), F.lit(" mm slices"))),
        F.when((F.col("n_files") < P.MIN_IMAGES) & (frames < P.MIN_IMAGES), F.concat(F.lit("only "), F.col("n_files").cast("string"), F.lit(" images"))),
        F.when(fov > P.MAX_FOV_MM, F.concat(F.lit("FOV "), whole, F.lit(" mm (chest recon)"))),
        F.when(sharp, F.concat(F.lit("kernel "), kernel)),
        F.when(word.isNotNull(), F.concat(F.lit("description '"), word, F.lit("'"))),
    )
    size = F.coalesce(number_text(F.col("slice_mm")), F.lit("unknown"))
    label = F.concat(F.lit("coronary recon: "), size, F.lit(" mm"), F.when(fov.isNotNull(), F.concat(F.lit(", FOV "), whole)).otherwise(""), F.when(kernel != "", F.concat(F.lit(", "), kernel)).otherwise(""))
    unsure = (F.coalesce("contrast", F.lit("")) == "") & F.col("phase").isNull() & ~F.upper(F.coalesce("image_type", F.lit(""))).contains("CARDIAC_CTA") & ~desc.rlike("(?i)cta|coro|angio")
    return (
        series.withColumn("dropped", reasons).drop("gated")
        .withColumn("verdict", F.when(F.col("dropped") != "", "drop").when(unsure, "maybe").otherwise("keep"))
        .withColumn("reason", F.when(F.col("verdict") == "drop", F.col("dropped")).when(F.col("verdict") == "maybe", F.concat(label, F.lit(" - no contrast agent / cardiac phase in header"))).otherwise(label))
        .drop("dropped")
    )


def review_reason(sop: Column, modality: Column, burned_in: Column) -> Column:
    """Why an object goes to quarantine, or null: its class, then its modality, then its burned-in flag."""
    return F.when(sop.isin(P.REVIEW_SOP_CLASSES), F.concat(F.lit("SOP class "), sop)).when(modality.isin(P.REVIEW_MODALITIES), F.concat(F.lit("Modality "), modality)).when(F.upper(burned_in) == "YES", "BurnedInAnnotation=YES")


def last_resort(series: DataFrame) -> DataFrame:
    """Series that are the only thin original CT volume of their study."""
    t = F.upper(F.coalesce("image_type", F.lit("")))
    fits = (
        (F.col("modality") == "CT") & t.contains("PRIMARY") & ~t.contains("LOCALIZER") & ~t.contains("SECONDARY") & (F.col("slice_mm") <= P.MAX_SLICE_MM)
        & ((F.col("n_files") >= P.MIN_IMAGES) | (F.coalesce(F.col("frames"), F.lit(0)) >= P.MIN_IMAGES))
    )
    marked = series.withColumn("fits", F.coalesce(fits, F.lit(False)))
    return marked.withColumn("last_resort", F.col("fits") & (F.sum(F.col("fits").cast("int")).over(Window.partitionBy("study_id")) == 1)).drop("fits")


def picked(series: DataFrame, picks: DataFrame) -> DataFrame:
    """study_id, series_uid and match (uid or desc) of the series that picks name; unmatched picks have a null series.

    A pick's UID decides if the study has it, and its description otherwise,
    which may name several series.
    """
    wanted = picks.select("study_id", F.coalesce("series_uid", F.lit("")).alias("want_uid"), norm_desc(F.col("series_description")).alias("want_desc")).withColumn("pick", F.xxhash64("study_id", "want_uid", "want_desc"))
    have = series.select(F.col("study_id"), "series_uid", norm_desc(F.col("description")).alias("have_desc"), "slice_mm")
    by_uid = wanted.join(have, (wanted.study_id == have.study_id) & (F.col("want_uid") == F.col("series_uid")) & (F.col("want_uid") != "")).select(wanted.study_id, "pick", "series_uid", "slice_mm", F.lit("uid").alias("match"))
    rest = wanted.join(by_uid.select("pick"), "pick", "left_anti").where("want_desc <> ''")
    by_desc = rest.join(have, (rest.study_id == have.study_id) & (F.col("want_desc") == F.col("have_desc"))).select(rest.study_id, "pick", "series_uid", "slice_mm", F.lit("desc").alias("match"))
    found = by_uid.unionByName(by_desc)
    lost = wanted.join(found.select("pick"), "pick", "left_anti").select("study_id", "pick", F.lit(None).cast("string").alias("series_uid"), F.lit(None).cast("double").alias("slice_mm"), F.lit("unmatched").alias("match"))
    return found.unionByName(lost)


def pick_totals(found: DataFrame) -> DataFrame:
    """How many picks were matched by UID, by description, or not at all."""
    return found.groupBy("match").agg(F.countDistinct("study_id", "pick").alias("picks"))


def decide(series: DataFrame, picks: DataFrame | None = None, selection: DataFrame | None = None) -> DataFrame:
    """decision (keep or drop) and reason of each classified series.

    The first level that a study reaches decides: its explicit selection, a
    thin pick, the rule, the rule's maybes (flagged), a single thin volume
    (flagged), or nothing.
    """
    s = last_resort(series)
    study = Window.partitionBy("study_id")
    off = F.lit(False)
    if selection is not None:
        chosen = selection.select("study_id", "series_uid").distinct()
        s = s.join(chosen.select("study_id").distinct().withColumn("selected", F.lit(True)), "study_id", "left").join(chosen.withColumn("ticked", F.lit(True)), ["study_id", "series_uid"], "left")
        s = s.withColumn("selected", F.coalesce("selected", off)).withColumn("ticked", F.coalesce("ticked", off))
    else:
        s = s.withColumn("selected", off).withColumn("ticked", off)
    if picks is not None:
        found = picked(series, picks).where("series_uid IS NOT NULL").select("study_id", "series_uid").distinct().withColumn("picked", F.lit(True))
        s = s.join(found, ["study_id", "series_uid"], "left").withColumn("picked", F.coalesce("picked", off))
    else:
        s = s.withColumn("picked", off)
    thin = F.col("picked") & (F.coalesce("slice_mm", F.lit(0.0)) <= P.MAX_SLICE_MM)
    s = s.withColumn("thin_pick", thin)
    for name, what in (("any_thin", F.col("thin_pick")), ("any_keep", F.col("verdict") == "keep"), ("any_maybe", F.col("verdict") == "maybe")):
        s = s.withColumn(name, F.max(what).over(study))
    keep = (
        F.when(F.col("selected"), F.col("ticked"))
        .when(F.col("any_thin"), F.col("thin_pick"))
        .when(F.col("any_keep"), F.col("verdict") == "keep")
        .when(F.col("any_maybe"), F.col("verdict") == "maybe")
        .otherwise(F.col("last_resort"))
    )
    fallback = ~F.col("selected") & ~F.col("any_thin") & ~F.col("any_keep")
    thick = F.concat(F.lit(" [FAI pick but "), number_text(F.col("slice_mm")), F.lit(" mm]"))
    marked = F.lit(" [kept as fallback - CHECK]")
    reason = (
        F.when(F.col("selected"), F.when(F.col("ticked"), "ticked in the viewer").otherwise("not ticked in the viewer"))
        .when(F.col("thin_pick"), "analysed series (FAI pick)")
        .when(F.col("picked") & ~F.col("any_thin"), F.concat("reason", thick))
        .when(fallback & F.col("any_maybe") & (F.col("verdict") == "maybe"), F.concat("reason", marked))
        .when(fallback & ~F.col("any_maybe") & F.col("last_resort"), F.concat(F.col("reason"), F.lit(" [only thin primary series in export]"), marked))
        .otherwise(F.col("reason"))
    )
    out = s.withColumn("decision", F.when(keep, "keep").otherwise("drop")).withColumn("reason", reason)
    return out.select("study_id", "series_uid", "series_number", F.substring("description", 1, 60).alias("description"), F.col("n_files").alias("images"), "slice_mm", "verdict", "decision", "reason")


def survey(series: DataFrame) -> DataFrame:
    """decision (keep, check, drop) and reason by the survey's rule: the first ground that holds is the one told.

    Studies without a candidate to keep have that noted on their checks.
    """
    desc, kernel = F.coalesce("description", F.lit("")), F.coalesce("kernel", F.lit(""))
    text, kind = F.lower(F.concat(desc, F.lit(" "), kernel)), F.upper(F.coalesce("image_type", F.lit("")))
    contrast = F.coalesce("contrast", F.lit(""))
    other = F.lit(False)
    for p in P.NOT_CT_PREFIXES:
        other = other | F.col("sop_class_uid").startswith(p)
    drops = F.filter(F.array(*map(F.lit, P.SURVEY_DROP_WORDS)), lambda w: F.contains(text, w))
    keeps = F.filter(F.array(*map(F.lit, P.SURVEY_KEEP_WORDS)), lambda w: F.contains(text, w))
    grounds = [
        ((F.coalesce("modality", F.lit("")) != "CT") | other, "drop", F.concat(F.lit("not a CT image object ("), F.coalesce("modality", F.lit("")), F.lit(")"))),
        (kind.contains("LOCALIZER") | first_word(text, P.SURVEY_SCOUTS).isNotNull(), "drop", F.lit("localiser/topogram")),
        (kind.contains("SECONDARY") | kind.contains("DERIVED") | kind.contains("MPR"), "drop", F.concat(F.lit("derived/secondary image ("), F.coalesce("image_type", F.lit("")), F.lit(")"))),
        ((F.col("n_files") < 40) & (F.coalesce(F.col("frames"), F.lit(0)) < 40), "drop", F.concat(F.lit("only "), F.col("n_files").cast("string"), F.lit(" images"))),
        (F.coalesce(F.col("slice_mm") > 1.5, F.lit(False)), "drop", F.concat(F.lit("slice "), F.col("slice_mm").cast("string"), F.lit(" mm"))),
        (F.size("drops") > 0, "drop", F.concat(F.lit("description/kernel: "), F.array_join(F.slice("drops", 1, 3), ", "))),
        ((contrast == "") & (F.size("keeps") == 0), "check", F.lit("no contrast field and no CTA keyword in description")),
        ((F.size("keeps") == 0) & (desc == ""), "check", F.lit("no series description")),
    ]
    fine = F.concat(F.lit("thin axial CT, "), F.col("n_files").cast("string"), F.lit(" images"), F.when(contrast != "", F.concat(F.lit(", contrast "), F.substring(contrast, 1, 20))).otherwise(""), F.when(F.size("keeps") > 0, F.concat(F.lit(", '"), F.get("keeps", F.lit(0)), F.lit("'"))).otherwise(""))
    decision, reason = F.lit("keep"), fine
    for holds, verdict, why in reversed(grounds):
        decision, reason = F.when(holds, verdict).otherwise(decision), F.when(holds, why).otherwise(reason)
    judged = series.withColumn("drops", drops).withColumn("keeps", keeps).withColumn("decision", decision).withColumn("ground", reason)
    none = ~F.max(F.col("decision") == "keep").over(Window.partitionBy("study_id"))
    noted = F.when(none & (F.col("decision") == "check"), F.concat("ground", F.lit(" [NO keep candidate in this study]"))).otherwise(F.col("ground"))
    return judged.select("study_id", "series_uid", "series_number", F.substring("description", 1, 60).alias("description"), "modality", F.col("n_files").alias("images"), "decision", noted.alias("reason"))


def images_of(images: DataFrame, decisions: DataFrame) -> DataFrame:
    """The images of kept series."""
    kept = decisions.where("decision = 'keep'").select("study_id", F.col("series_uid").alias("kept_uid"))
    return images.withColumn("kept_uid", series_key()).join(kept, ["study_id", "kept_uid"], "left_semi").select(*images.columns)


def thick(series: DataFrame) -> DataFrame:
    """Studies with kept series that are thicker than the limit, and those series."""
    bad = series.where((F.col("decision") == "keep") & (F.col("slice_mm") > P.MAX_SLICE_MM))
    told = F.concat(F.lit("S"), F.lpad(F.col("series_number").cast("string"), 3, "0"), F.lit("="), number_text(F.col("slice_mm")), F.lit(" mm"))
    return bad.groupBy("study_id").agg(F.array_join(F.sort_array(F.collect_list(told)), ", ").alias("thick_series"), F.count("*").alias("n"))
