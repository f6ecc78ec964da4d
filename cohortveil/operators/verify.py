"""Proof that an output is clean: every finding is a row, and no rows is a pass."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import policy as P
from ..functions.exprs import nhs_valid
from .deidentify import COLUMNS, added_each, keyword, listed, rewritten_each

NHS = r"(?<![0-9A-Z])([0-9]{3}[ -]?[0-9]{3}[ -]?[0-9]{4})(?![0-9A-Z])"
POSTCODE = r"\b[A-Z]{1,2}[0-9][A-Z0-9]? [0-9][A-Z]{2}\b"
DATE = r"(?<![0-9])(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])(?![0-9])"
ABSENT = ["PatientBirthDate", "OtherPatientIDs", "DeviceSerialNumber", "SoftwareVersions"]
EMPTY = ["StationName", "SeriesDescription", "ProtocolName", "AccessionNumber"]
HINTS = ["ConvolutionKernel", "ScanOptions", "FilterType"]


def nhs_numbers(text: Column) -> Column:
    """Ten-digit runs in a text whose check digit is right, as plain digits."""
    found = F.transform(F.regexp_extract_all(text, F.lit(NHS), F.lit(1)), lambda x: F.regexp_replace(x, "[ -]", ""))
    return F.filter(found, nhs_valid)


def text_patterns(text: Column, dates: bool = True) -> dict[str, Column]:
    """Whether a text has shapes of identifying values in it, by kind."""
    out = {"NHS-number-shaped value": (F.length(text) >= 10) & text.rlike(NHS) & (F.size(nhs_numbers(text)) > 0), "postcode-shaped value": text.contains(" ") & F.upper(text).rlike(POSTCODE)}
    if dates:
        out["date-shaped text"] = (F.length(text) >= 8) & text.rlike(DATE) & ~text.contains(P.DUMMY_DATE)
    return out


def element_rules(profile: P.Profile) -> list[Column]:
    """What an element that is `told_apart` gives away: a struct of kind and detail a rule, or null."""
    k, v, vr, data, plain, top, full = (F.col(c) for c in ("keyword", "value", "vr", "data", "plain", "top", "full"))
    pair = F.concat(k, F.lit("="), v)
    absent = ABSENT + ["PatientSex"] * (not profile.keep_sex) + ["PatientAge"] * (not profile.keep_age_5y)
    empty = EMPTY + ["InstitutionName"] * (not profile.keep_institution) + ["Manufacturer", "ManufacturerModelName"] * (not profile.keep_manufacturer) + ["StudyDescription"] * (not profile.study_description)
    real = F.lit(not profile.shift_dates)
    own = lambda x: x.startswith("2.25.") | x.startswith(P.STANDARD_UID_PREFIX) | (x == "")
    foreign = F.when(v.contains("\\"), F.exists(F.split(v, r"\\"), lambda x: ~own(x))).otherwise(~own(v))
    rules: list[tuple[Column, str, Column]] = [
        (data & F.col("is_private"), "private tag present", F.col("path")),
        (plain & (vr == "DA") & full & (v != P.DUMMY_DATE) & real, "real date", pair),
        (plain & (vr == "DT") & full & ~v.startswith(P.DUMMY_DATE) & real, "real datetime", pair),
        (plain & (vr == "TM") & full & (v != P.DUMMY_TIME) & real, "real time", pair),
        (plain & (vr == "UI") & ~listed(k, P.UID_KEEP) & full & foreign, "original UID", pair),
        (~data & listed(k, P.META_FORBIDDEN), "file meta carries PACS identity", k),
        (~data & F.col("is_private"), "private tag in file meta", F.col("path")),
        (plain & top & listed(k, absent), "attribute should be absent", k),
        (plain & top & listed(k, empty) & full, "attribute should be empty", pair),
        (plain & top & listed(k, HINTS) & full & F.lit(not profile.keep_technical), "vendor hint present", pair),
        (plain & top & listed(k, P.PN_KEYWORDS) & full, "person name present", pair),
        (~F.col("is_private") & k.startswith("(") & vr.isin("PN", "AE") & full, "person or station in an unnamed attribute", k),
    ]
    if profile.study_description:
        rules.append((plain & top & (k == "StudyDescription") & ~v.isin("", profile.study_description[:64]), "attribute should match profile", pair))
    if profile.keep_age_5y:
        rules.append((plain & top & (k == "PatientAge") & ~v.rlike("^[0-9]{3}Y$"), "age not bucketed", pair))
    rules += [(F.col("numbered") & holds & ((k != "DeidentificationMethod") | F.lit(kind != "date-shaped text")), kind, k) for kind, holds in text_patterns(v, not profile.shift_dates).items()]
    return [F.when(holds, F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))) for holds, kind, detail in rules]


def told_apart(elements: DataFrame) -> DataFrame:
    """elements with keyword and what several rules ask, each worked out once.

    Texts without a digit, or too short for one, never meet a pattern.
    """
    data, full = F.col("grp") == "data", F.col("value") != ""
    asked = {"data": data, "plain": data & ~F.col("is_private"), "top": ~F.col("path").contains("]."), "full": full}
    numbered = F.col("plain") & F.col("vr").isin(P.TEXT_VRS) & F.col("full") & F.col("value").rlike("[0-9]")
    return elements.withColumn("keyword", keyword()).withColumns(asked).withColumn("numbered", numbered)


def element_findings(elements: DataFrame, profile: P.Profile = P.Profile()) -> DataFrame:
    """instance_id, kind and detail of what single elements give away; one pass over them."""
    return told(told_apart(elements), F.array(*element_rules(profile)))


def by_profile(profiles: dict[str, P.Profile], made: Callable[[P.Profile], Column]) -> Column:
    """What is made for the profile that a row's column `profile` names."""
    return reduce(lambda done, item: F.when(F.col("profile") == item[0], made(item[1])).otherwise(done), reversed(profiles.items()), F.lit(None))


def told(rows: DataFrame, found: Column, *by: str) -> DataFrame:
    """A row a finding, of an array of them (struct of kind and detail, or null).

    The findings are a column before they are exploded, so that each is worked
    out once and in code of its own: a filter, as Spark infers one for an inner
    explode, would work them all out again, and a loop would interpret them.
    """
    key = [*by, "instance_id"]
    return rows.select(*key, found.alias("found")).select(*key, F.explode_outer("found").alias("f")).where("f IS NOT NULL").select(*key, "f.kind", "f.detail")


def object_rules(profile: P.Profile) -> list[Column]:
    expected = profile.name_for(F.coalesce("id", F.lit("")))
    wrong = F.coalesce("name", F.lit("")) != expected
    shown = F.concat(F.coalesce("name", F.lit("None")), F.lit(" / expected "), expected)
    return [
        F.when(wrong, F.struct(F.lit("PatientName not as profile dictates").alias("kind"), shown.alias("detail"))),
        F.when(F.coalesce("marked", F.lit("")) != "YES", F.struct(F.lit("PatientIdentityRemoved not YES").alias("kind"), F.lit("").alias("detail"))),
    ]


def object_heads(elements: DataFrame, *by: str) -> DataFrame:
    at = lambda path: F.max(F.when((F.col("grp") == "data") & (F.col("path") == path), F.col("value")))
    return elements.groupBy(*by, "instance_id").agg(at("PatientName").alias("name"), at("PatientID").alias("id"), at("PatientIdentityRemoved").alias("marked"))


def object_findings(elements: DataFrame, profile: P.Profile = P.Profile()) -> DataFrame:
    """Findings about what an object as a whole has to say of itself."""
    return told(object_heads(elements), F.array(*object_rules(profile)))


def needle_set(values: DataFrame) -> DataFrame:
    """Distinct search words of at least four characters, in upper case, from a column `value`; dummies are none."""
    v = F.upper(F.trim("value"))
    return values.select(v.alias("needle")).where((F.length("needle") >= 4) & ~F.col("needle").isin(P.DUMMY_DATE, "00010101")).distinct()


def all_needles(*sources: DataFrame | None) -> DataFrame:
    """One set of search words out of several: tables with a column `value`, and sets that are made already (`needle`)."""
    made = [s if "needle" in s.columns else needle_set(s) for s in sources if s is not None]
    return reduce(DataFrame.unionByName, [m.select("needle") for m in made]).distinct()


def name_parts(names: DataFrame) -> DataFrame:
    """Distinct parts of at least three characters of the names in a column `value`."""
    part = F.explode(F.split(F.upper(F.trim("value")), r"[\^\s,]+"))
    return names.select(part.alias("part")).where("length(part) >= 3").distinct()


def texts(elements: DataFrame) -> DataFrame:
    """The text values that searches read: instance_id, keyword and text in upper case."""
    return elements.where((F.col("grp") == "data") & ~F.col("is_private") & F.col("vr").isin(P.TEXT_VRS) & (F.col("value") != "")).select("instance_id", keyword().alias("keyword"), F.upper("value").alias("text"))


def grams(text: Column, size: int) -> Column:
    """The distinct runs of `size` characters in a text of at least so many."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(size))))


def needle_hits(swept: DataFrame, needles: DataFrame, gram: int = 4, many: int = 50_000) -> DataFrame:
    """Texts that contain a needle: instance_id, keyword, needle.

    PatientName and PatientID may equal one.  A needle can only occur where all
    its grams do, so each is filed under that of its grams which the fewest
    texts have, and meets these texts alone: needles that begin alike, as dates
    do, don't meet each other's texts.  Needles with a gram that no text has
    are done with.  Each distinct text is searched once, since a cohort repeats
    its texts in every object.  Rows of a text that `many` rows or more have
    stay where they are and meet its needles, if any, in a table of these
    texts, of which there is one for `many` rows at most; only other rows are
    dealt out by text, so no task gets more than that of one text.
    """
    keyed = needles.where(F.length("needle") >= gram).select("needle", F.explode(grams(F.col("needle"), gram)).alias("gram"))
    swept = swept.where(F.length("text") >= gram)
    long = swept.groupBy("text").agg(F.count("*").alias("rows"))
    pieces = long.select("text", F.explode(grams(F.col("text"), gram)).alias("gram")).join(keyed.select("gram").distinct(), "gram", "left_semi")
    held = pieces.groupBy("gram").agg(F.count("*").alias("texts"))
    rarest = keyed.join(held, "gram", "left").groupBy("needle").agg(F.min(F.struct("texts", "gram")).alias("r"), F.count_if(F.col("texts").isNull()).alias("absent"))
    found = pieces.join(rarest.where("absent = 0").select("needle", "r.gram"), "gram").where(F.contains("text", F.col("needle"))).select("text", "needle")
    identity = F.col("keyword").isin("PatientName", "PatientID")
    often = F.broadcast(long.where(F.col("rows") >= many).join(found.groupBy("text").agg(F.collect_set("needle").alias("needles")), "text", "left").select("text", "needles"))
    hot = swept.join(often.where("needles IS NOT NULL"), "text").withColumn("needle", F.explode("needles")).drop("needles")
    rest = swept.join(often.select("text"), "text", "left_anti").join(found, "text")
    return hot.unionByName(rest).where(~identity | (F.col("text") != F.col("needle"))).select("instance_id", "keyword", "needle").distinct()


def name_part_hits(swept: DataFrame, parts: DataFrame) -> DataFrame:
    """Texts with a run of letters that is a part of a name: instance_id, keyword, part."""
    runs = swept.where(~F.col("keyword").isin("PatientName", "PatientID")).select("instance_id", "keyword", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-Z]{3,})"), F.lit(1)))).alias("part"))
    return runs.join(parts, "part").select("instance_id", "keyword", "part")


def verify(elements: DataFrame, profile: P.Profile = P.Profile(), needles: DataFrame | None = None, parts: DataFrame | None = None) -> DataFrame:
    """All findings of an output outside quarantine: instance_id, kind, detail."""
    out = element_findings(elements, profile).unionByName(object_findings(elements, profile))
    if needles is not None:
        hits = needle_hits(texts(elements), needles)
        out = out.unionByName(hits.select("instance_id", F.lit("identifier text").alias("kind"), F.concat("keyword", F.lit(" contains "), "needle").alias("detail")))
    if parts is not None:
        hits = name_part_hits(texts(elements), parts)
        out = out.unionByName(hits.select("instance_id", F.lit("identifier text").alias("kind"), F.concat("keyword", F.lit(" contains the name part "), "part").alias("detail")))
    return out


def verify_rewritten(elements: DataFrame, salt: Column, profiles: dict[str, P.Profile]) -> DataFrame:
    """profile, instance_id, kind and detail: what `verify` finds in the `deidentify` of each profile.

    Elements are rewritten for all profiles in one pass, and each is judged as
    it is written.  What an object says of itself is in `written` under every
    profile, so it comes from the added attributes alone, and each object has
    one at least, the marker.
    """
    own = elements.select(*COLUMNS)
    stay, new = rewritten_each(own, salt, profiles), added_each(own, salt, profiles)
    rules = by_profile(profiles, lambda p: F.array(*element_rules(p)))
    judged = [told(told_apart(rows), rules, "profile") for rows in (stay, new)]
    says = added_each(own, salt, profiles, ["PatientName", "PatientID", "PatientIdentityRemoved"])
    return reduce(DataFrame.unionByName, [*judged, told(object_heads(says, "profile"), by_profile(profiles, lambda p: F.array(*object_rules(p))), "profile")])


def report(findings: DataFrame, most: int = 10) -> DataFrame:
    """kind, findings and the first examples of each kind, and how many more there are."""
    example = F.concat(F.col("instance_id").cast("string"), F.lit(": "), "detail")
    numbered = findings.withColumn("example", example).withColumn("nth", F.row_number().over(Window.partitionBy("kind").orderBy("example")))
    counted = findings.groupBy("kind").agg(F.count("*").alias("findings"))
    shown = numbered.where(F.col("nth") <= most).groupBy("kind").agg(F.array_join(F.sort_array(F.collect_list("example")), "; ").alias("examples"))
    return counted.join(shown, "kind").withColumn("more", F.greatest(F.col("findings") - most, F.lit(0)))


def recheck(expected: DataFrame, now: DataFrame) -> DataFrame:
    """Files (path, sha256) that changed, went missing or were added since a manifest was written."""
    both = expected.select("path", F.col("sha256").alias("then")).join(now.select("path", F.col("sha256").alias("now")), "path", "full_outer")
    state = F.when(F.col("now").isNull(), "missing").when(F.col("then").isNull(), "added").when(F.col("then") != F.col("now"), "changed")
    return both.select("path", state.alias("state")).where("state IS NOT NULL")


def depth_for(files: int, most: int) -> int:
    """Levels below the root of a manifest's tree, so that its parts have about `most` files at most."""
    depth = 0
    while files > most * 16**depth:
        depth += 1
    return depth


def in_parts(checksums: DataFrame, depth: int) -> DataFrame:
    """path and sha256 with the part of a manifest that they belong to: r and the first digits of the path's own digest."""
    return checksums.select(F.concat(F.lit("r"), F.substr(F.sha2("path", 256), F.lit(1), F.lit(depth))).alias("part"), "path", "sha256")


def manifest(checksums: DataFrame, most: int = 100_000, depth: int | None = None) -> DataFrame:
    """A checksum manifest as a tree of digests: level, part, files, sha256, and the text of its lowest parts.

    A lowest part's text is its lines, "digest  path", in order of paths, as
    sha256sum reads them, and its sha256 that of the text as a file.  Every
    other part's is that of its children's digests, a line each, in order.  A
    file's part is told by its path alone, so what is added or lost elsewhere
    doesn't move it.  Up to `most` files make one part, which is the root too.
    """
    if depth is None:
        depth = depth_for(checksums.count(), most)
    line = F.struct("path", F.concat("sha256", F.lit("  "), "path", F.lit("\n")).alias("line"))
    dealt = in_parts(checksums, depth).groupBy("part").agg(F.count("*").alias("files"), F.sort_array(F.collect_list(line)).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    below = dealt.select(F.lit(depth).alias("level"), "part", "files", F.sha2(text, 256).alias("sha256"), text.alias("text"))
    out = below
    for level in reversed(range(depth)):
        digests = F.transform(F.sort_array(F.collect_list(F.struct("part", "sha256"))), lambda x: F.concat(x["sha256"], F.lit("\n")))
        grouped = below.groupBy(F.substr("part", F.lit(1), F.lit(level + 1)).alias("part")).agg(F.sum("files").alias("files"), F.sha2(F.array_join(digests, ""), 256).alias("sha256"))
        below = grouped.select(F.lit(level).alias("level"), "part", "files", "sha256", F.lit(None).cast("string").alias("text"))
        out = out.unionByName(below)
    return out


def manifest_digest(tree: DataFrame) -> DataFrame:
    """Files and the one digest of a manifest: its root's; that of an empty file if there are no files."""
    return tree.where("level = 0").agg(F.coalesce(F.max("files"), F.lit(0).cast("long")).alias("files"), F.coalesce(F.max("sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("digest"))


def differing_parts(then: DataFrame, now: DataFrame, depth: int) -> DataFrame:
    """The lowest parts whose digests differ, found from the root down: only below parts that differ is anything compared."""
    side = lambda tree, level, name: tree.where(F.col("level") == level).select("part", F.col("sha256").alias(name))
    open_ = None
    for level in range(depth + 1):
        sides = [side(then, level, "then"), side(now, level, "now")]
        if open_ is not None:
            sides = [x.withColumn("above", F.substr("part", F.lit(1), F.lit(level))).join(open_.withColumnRenamed("part", "above"), "above", "left_semi").drop("above") for x in sides]
        open_ = sides[0].join(sides[1], "part", "full_outer").where(~F.col("then").eqNullSafe(F.col("now"))).select("part")
    return open_


def recheck_tree(then: DataFrame, lines: DataFrame, now: DataFrame, depth: int) -> DataFrame:
    """`recheck` by trees: `then` is the manifest's tree and `lines` its files (part, path, sha256), `now` today's checksums.

    Files are compared in the parts that differ alone, and of the old lines only those parts are read.
    """
    today = in_parts(now, depth)
    parts = differing_parts(then, manifest(now, depth=depth), depth)
    return recheck(lines.join(parts, "part", "left_semi"), today.join(parts, "part", "left_semi"))
