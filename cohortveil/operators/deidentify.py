"""The tag policy over header elements: one row an attribute, nested ones named by their path.

An element has instance_id, study_id, grp (data or meta), path, vr, is_private
and value; several values are joined by backslashes, as DICOM stores them.
Everything here is narrow: elements stay where they are, and only the few
rows that are added come from one row an object.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import policy as P
from ..functions.exprs import display_value, hashed_uid, let, shift_da, shift_days, shift_dt, with_age_bucket, with_hashed_uid


def keyword() -> Column:
    """The attribute's own name: the last step of its path."""
    return F.substring_index("path", ".", -1)


def top() -> Column:
    """The name of the top-level attribute that holds it."""
    return F.substring_index(F.substring_index("path", ".", 1), "[", 1)


def nested() -> Column:
    return F.col("path").contains("].")


def listed(column: Column, words) -> Column:
    words = sorted(words)
    return column.isin(words) if words else F.lit(False)


def each_uid(value: Column, salt: Column) -> Column:
    """Every identifier of a value replaced, but standard and empty ones; a single one, as most are, without a loop."""
    one = lambda v: F.when((v == "") | v.startswith(P.STANDARD_UID_PREFIX), v).otherwise(hashed_uid(v, salt))
    return F.when(value.contains("\\"), F.array_join(F.transform(F.split(value, r"\\"), one), "\\")).otherwise(one(value))


def in_private(path: Column) -> Column:
    """Whether a step of a path is private."""
    return path.contains("(") & path.rlike(r"\([0-9a-f]{3}[13579bdf],")


def action(hidden: Column, profile: P.Profile) -> Column:
    """What the policy does to an element with keyword and top, private if `hidden`."""
    kept = profile.retained()
    remove, clear = set(P.REMOVE) - kept, set(P.CLEAR) - kept
    data = F.col("grp") == "data"
    vendor = listed(F.col("top"), P.VENDOR_HINTS) if not profile.keep_technical else F.lit(False)
    return (
        F.when(hidden, "private")
        .when(data & listed(F.col("top"), remove), "removed")
        .when(data & vendor, "vendor")
        .when(data & listed(F.col("top"), clear), "cleared")
        .when(~data & listed(F.col("keyword"), P.META_FORBIDDEN), "meta")
    )


def actions(elements: DataFrame, profile: P.Profile = P.Profile()) -> DataFrame:
    """elements with keyword, top and action: private, removed, cleared, vendor, meta or null.

    Private attributes go at every depth, the policy's at the top, with all
    that they hold.  A blanked sequence loses its items, and a numeric
    attribute that can't be blank is deleted.
    """
    # With a loop in it, the projection is compiled by itself, in pieces; within its stage's one method it makes that too large for the JVM to compile.
    hidden = F.col("is_private") | let(F.col("path"), in_private)
    return elements.withColumn("keyword", keyword()).withColumn("top", top()).withColumn("action", action(hidden, profile))


def with_uids(df: DataFrame, salt: Column, where: Column) -> DataFrame:
    """df with `uid`, the value that an identifier gets, where it is wanted; null too if it is standard and stays as it is.

    Most identifiers are single and hashed column by column; those of several values meet the loop.
    """
    value, several = F.col("value"), F.col("value").contains("\\")
    identifier = where & (value != "") & (F.col("vr") == "UI") & ~listed(F.col("keyword"), P.UID_KEEP)
    hashed = with_hashed_uid(df, value, salt, identifier & ~several & ~value.startswith(P.STANDARD_UID_PREFIX))
    return hashed.withColumn("uid", F.coalesce("uid", F.when(identifier & several, each_uid(value, salt))))


def stays(action: Column) -> Column:
    blank = (action == "cleared") & ~nested() & ~F.col("vr").isin(P.UNBLANKABLE)
    return action.isNull() | F.coalesce(blank, F.lit(False))


def after(action: Column, salt: Column, profile: P.Profile, pieces: bool = False) -> Column:
    """The value that an element with `uid` stays with; with `pieces`, shifted dates are worked out in a loop, as in `actions`."""
    value, vr, full = F.col("value"), F.col("vr"), F.col("value") != ""
    if profile.shift_dates:
        days = shift_days(salt, F.col("study_id"))
        own = let if pieces else lambda v, body: body(v)
        dates = {"DA": own(value, lambda v: shift_da(v, days)), "DT": own(value, lambda v: shift_dt(v, days)), "TM": value}
        dates["DA"] = F.when(value.contains("\\"), P.DUMMY_DATE).otherwise(dates["DA"])
    else:
        dates = {"DA": F.lit(P.DUMMY_DATE), "DT": F.lit(P.DUMMY_DATETIME), "TM": F.lit(P.DUMMY_TIME)}
    new = (
        F.when(action == "cleared", F.when(vr == "SQ", "0").otherwise(""))
        .when(full & (vr == "DA"), dates["DA"])
        .when(full & (vr == "DT"), dates["DT"])
        .when(full & (vr == "TM"), dates["TM"])
        .when(F.col("uid").isNotNull(), F.col("uid"))
    )
    if not profile.keep_technical:
        new = new.when(F.col("path") == "ImageType", F.array_join(F.slice(F.split(value, r"\\"), 1, 3), "\\"))
    return F.coalesce(new, value)


def changed(acted: DataFrame, salt: Column, profile: P.Profile = P.Profile()) -> DataFrame:
    """Elements with actions, with `stays` and `after`, the value that they stay with (null: they go)."""
    hashed = with_uids(acted, salt, F.col("action").isNull()).withColumn("stays", stays(F.col("action")))
    return hashed.withColumn("after", F.when(F.col("stays"), after(F.col("action"), salt, profile))).drop("uid")


def rewritten(elements: DataFrame, salt: Column, profile: P.Profile = P.Profile()) -> DataFrame:
    """The elements that stay, with their new values; those in `written` come from `added`.

    An outer explode drops the others, since Spark would push a filter below
    the rules that it is made of and work them all out once more for it.
    """
    rest = [c for c in elements.columns if c != "value"]
    done = changed(actions(elements, profile), salt, profile).select(*rest, F.array(F.when(F.col("stays"), F.struct(F.col("after").alias("value")))).alias("new"))
    return done.select(*rest, F.explode_outer("new").alias("new")).where("new IS NOT NULL").select(*(F.col("new.value") if c == "value" else c for c in elements.columns))


def rewritten_each(elements: DataFrame, salt: Column, profiles: dict[str, P.Profile]) -> DataFrame:
    """`rewritten` without what `written` names, for each of several profiles, named in a column `profile`.

    One pass over the elements: names are taken apart and identifiers hashed once for all profiles.
    """
    rest = [c for c in elements.columns if c != "value"]
    always = set.intersection(*(set(written(p)) for p in profiles.values()))
    apart = elements.where(~listed(F.col("path"), always)).withColumn("keyword", keyword()).withColumn("top", top()).withColumn("hidden", F.col("is_private") | let(F.col("path"), in_private))
    acts = {name: F.col(f"action_{n}") for n, name in enumerate(profiles)}
    acted = apart.withColumns({f"action_{n}": action(F.col("hidden"), p) for n, p in enumerate(profiles.values())})
    hashed = with_uids(acted, salt, reduce(Column.__or__, (a.isNull() for a in acts.values())))
    new = [F.when(stays(acts[name]) & ~listed(F.col("path"), set(written(p)) - always), F.struct(F.lit(name).alias("profile"), after(acts[name], salt, p, True).alias("value"))) for name, p in profiles.items()]
    done = hashed.select(*rest, F.array(*new).alias("new"))
    return done.select(*rest, F.explode_outer("new").alias("new")).where("new IS NOT NULL").select("new.profile", *(F.col("new.value") if c == "value" else c for c in elements.columns))


def written(profile: P.Profile) -> list[str]:
    """Paths of the attributes that every object gets, or those that have them, whatever was there before."""
    out = ["PatientName", "PatientID", "PatientIdentityRemoved", "DeidentificationMethod", "BurnedInAnnotation"] + ["PatientAge"] * profile.keep_age_5y + ["StudyDescription"] * bool(profile.study_description)
    return out + ["MediaStorageSOPInstanceUID", "MediaStorageSOPClassUID", "ImplementationClassUID", "ImplementationVersionName"]


def heads(elements: DataFrame, salt: Column, carry: Sequence[str] = ()) -> DataFrame:
    """One row an object: the class, new identifier and age bucket that `new_rows` writes."""
    head = lambda k: F.max(F.when((F.col("grp") == "data") & (F.col("path") == k), F.col("value")))
    read = {"PatientAge": "age", "PatientBirthDate": "born", "StudyDate": "study", "SeriesDate": "series", "SOPInstanceUID": "object", "SOPClassUID": "class"}
    objects = elements.groupBy("instance_id", "study_id", *carry).agg(*(head(k).alias(v) for k, v in read.items()))
    aged = with_age_bucket(objects, F.col("age"), F.col("born"), F.col("study"), F.col("series"))
    return aged.select("instance_id", "study_id", *carry, "class", each_uid(F.col("object"), salt).alias("object"), "bucket")


def new_rows(profile: P.Profile, *more: Column, only: Sequence[str] | None = None) -> list[Column]:
    """The attributes in `written`, or those in `only`, of one of `heads`: a struct each, with further fields before."""
    values = {
        "PatientName": ("data", "PN", profile.name_for(F.col("study_id"))), "PatientID": ("data", "LO", F.col("study_id")),
        "PatientIdentityRemoved": ("data", "CS", F.lit("YES")), "DeidentificationMethod": ("data", "LO", F.lit(profile.method())), "BurnedInAnnotation": ("data", "CS", F.lit("NO")),
        "PatientAge": ("data", "AS", F.col("bucket")), "StudyDescription": ("data", "LO", F.lit(profile.study_description[:64])),
        "MediaStorageSOPInstanceUID": ("meta", "UI", F.col("object")), "MediaStorageSOPClassUID": ("meta", "UI", F.col("class")),
        "ImplementationClassUID": ("meta", "UI", F.lit(P.IMPLEMENTATION_UID)), "ImplementationVersionName": ("meta", "SH", F.lit(f"VEIL_{P.VERSION.replace('.', '')}")),
    }
    return [F.struct(*more, F.lit(values[p][0]).alias("grp"), F.lit(p).alias("path"), F.lit(values[p][1]).alias("vr"), F.lit(False).alias("is_private"), values[p][2].alias("value")) for p in written(profile) if only is None or p in only]


def added(elements: DataFrame, salt: Column, profile: P.Profile = P.Profile(), carry: Sequence[str] = ()) -> DataFrame:
    """The attributes in `written`, one row each: identity, markers, age bucket, description, file meta.

    An age bucket needs an age or dates, and the file meta's object and class
    those of the object; a row without a value isn't written.
    """
    ids = ["instance_id", "study_id", *carry]
    return heads(elements, salt, carry).select(*ids, F.explode(F.array(*new_rows(profile))).alias("e")).select(*ids, "e.*").where("value IS NOT NULL")


def added_each(elements: DataFrame, salt: Column, profiles: dict[str, P.Profile], only: Sequence[str] | None = None) -> DataFrame:
    """`added`, or of it the attributes in `only`, for each of several profiles, named in a column `profile`; objects are brought together once."""
    ids = ["instance_id", "study_id"]
    rows = [row for name, p in profiles.items() for row in new_rows(p, F.lit(name).alias("profile"), only=only)]
    return heads(elements, salt).select(*ids, F.explode(F.array(*rows)).alias("e")).select(*ids, "e.*").where("value IS NOT NULL")


COLUMNS = ["instance_id", "study_id", "grp", "path", "vr", "is_private", "value"]


def deidentify(elements: DataFrame, salt: Column, profile: P.Profile = P.Profile(), carry: Sequence[str] = ()) -> DataFrame:
    """The whole rewrite: what stays, with new values, and what is added in place of what was there.

    Columns named in `carry`, which are the same for all of an object's elements, come along.
    """
    names = [*COLUMNS, *carry]
    own = elements.select(*names)
    stay = rewritten(own, salt, profile).where(~F.col("path").isin(written(profile)))
    return stay.unionByName(added(own, salt, profile, carry).select(*names))


def rewrite_diff(elements: DataFrame, salt: Column, profile: P.Profile = P.Profile()) -> DataFrame:
    """header_diff of elements and their `deidentify`, without joining the two.

    Each element meets its own new value where it stands; only the attributes
    in `written`, a dozen an object, are brought together by object.
    """
    key = ["instance_id", "grp", "path"]
    own = elements.select(*COLUMNS)
    before = display_value(F.col("vr"), F.col("value"))
    special = F.col("path").isin(written(profile))
    here = changed(actions(own, profile), salt, profile).where(~special).select(*key, F.col("vr"), "is_private", before.alias("before"), F.when(F.col("stays"), display_value(F.col("vr"), F.col("after"))).alias("after"))
    there = own.where(special).select(*key, "vr", "is_private", before.alias("before"), F.lit(None).cast("string").alias("after"))
    new = added(own, salt, profile).select(*key, "vr", F.lit(None).cast("boolean").alias("is_private"), F.lit(None).cast("string").alias("before"), display_value(F.col("vr"), F.col("value")).alias("after"))
    old = lambda c: F.max_by(c, F.col("before").isNotNull())
    together = there.unionByName(new).groupBy(*key).agg(old("vr").alias("vr"), F.max("is_private").alias("is_private"), F.max("before").alias("before"), F.max("after").alias("after"))
    return told(here.unionByName(together))


def told(both: DataFrame) -> DataFrame:
    """A comparison's rows from key, vr, is_private, before and after (null where there is none)."""
    action = F.when(F.col("after").isNull(), "removed").when(F.col("before").isNull(), "added").when(F.col("before") != F.col("after"), "changed").otherwise("kept")
    return both.select("instance_id", "grp", "path", keyword().alias("keyword"), "vr", F.coalesce("is_private", F.lit(False)).alias("is_private"), F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), action.alias("action"))


def counters(elements: DataFrame, profile: P.Profile = P.Profile()) -> DataFrame:
    """Per object: dates and UIDs met, attributes removed and blanked, private attributes at the top."""
    a = actions(elements, profile)
    gone = F.col("action").isNotNull() & ~((F.col("action") == "cleared") & ~nested() & ~F.col("vr").isin(P.UNBLANKABLE))
    stays, count = ~gone, lambda c, name: F.count_if(c).alias(name)
    data = F.col("grp") == "data"
    return a.groupBy("instance_id").agg(
        count(data & stays & F.col("vr").isin("DA", "TM", "DT"), "dates"),
        count(data & stays & (F.col("vr") == "UI") & ~listed(F.col("keyword"), P.UID_KEEP), "uids"),
        count((F.col("action") == "removed") & ~nested(), "removed"),
        count((F.col("action") == "cleared") & ~nested(), "cleared"),
        count((F.col("action") == "private") & ~nested(), "private"),
    )


def header_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """What happened to each attribute: removed, changed, added or kept, with both values as shown."""
    key = ["instance_id", "grp", "path"]
    b = before.select(*key, F.col("vr").alias("vr_b"), "is_private", display_value(F.col("vr"), F.col("value")).alias("before"))
    a = after.select(*key, F.col("vr").alias("vr_a"), display_value(F.col("vr"), F.col("value")).alias("after"))
    both = b.join(a, key, "full_outer")
    return told(both.select(*key, F.coalesce("vr_b", "vr_a").alias("vr"), "is_private", "before", "after"))


def diff_summary(diff: DataFrame, *by: str) -> DataFrame:
    """How many attributes were removed, changed, added and kept."""
    return diff.groupBy(*by).agg(*(F.count_if(F.col("action") == a).alias(a) for a in ("removed", "changed", "added", "kept")))
