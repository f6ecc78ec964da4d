"""Pixel frames as arrays in rows: windowing, redaction, reformats.

An object has instance_id, rows, cols and pixels, row by row and frame by
frame.  Small ones are worked on as they are; large ones, multi-frame volumes
above all, are cut into tiles first, after which no row is larger than a tile:
a tile is painted by itself, and a reformat reads only the tiles that it cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import identity

#: Named windows, as centre and width.
PRESETS = {"Soft tissue": (40, 400), "Lung": (-600, 1500), "Bone": (400, 1800), "CTA": (250, 700), "Brain": (40, 80)}


def rescaled(pixels: Column, slope: Column, intercept: Column) -> Column:
    """Stored values to Hounsfield units."""
    return F.transform(pixels, lambda v: v * F.coalesce(slope, F.lit(1.0)) + F.coalesce(intercept, F.lit(0.0)))


def default_window(centres: Column, widths: Column) -> Column:
    """The first centre and width of a header's lists, if the width is positive."""
    c, w = F.try_element_at(centres, F.lit(1)), F.try_element_at(widths, F.lit(1))
    return F.when(w > 0, F.struct(c.alias("centre"), w.alias("width")))


def windowed(pixels: Column, centre: Column, width: Column) -> Column:
    """Values to 0..255 over a window; without a positive width, over the frame's own range."""
    least, most = F.array_min(pixels), F.array_max(pixels)
    low = F.when(width > 0, centre - width / 2).otherwise(least)
    high = F.when(width > 0, centre + width / 2).otherwise(F.when(most > least, most).otherwise(least + 1))
    return F.transform(pixels, lambda v: F.floor(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (v - low) * (255.0 / (high - low))))).cast("int"))


def downsampled(pixels: Column, rows: Column, cols: Column, height: int, width: int) -> Column:
    """The nearest pixels of a height by width grid over the frame, ends included; halves go to the even index."""
    place = lambda i, n, size: F.rint(i * (n - 1) / F.lit(float(max(size - 1, 1)))).cast("int")
    grid = F.sequence(F.lit(0), F.lit(height * width - 1))
    return F.transform(grid, lambda k: F.get(pixels, place(F.floor(k / width), rows, height) * cols + place(k % width, cols, width)))


def clipped(box: Column, rows: Column, cols: Column) -> Column:
    """A box with its corners in order and inside the frame."""
    bound = lambda v, top: F.greatest(F.lit(0), F.least(v, top))
    x, y = [bound(box[k], cols) for k in ("x0", "x1")], [bound(box[k], rows) for k in ("y0", "y1")]
    return F.struct(F.least(*x).alias("x0"), F.least(*y).alias("y0"), F.greatest(*x).alias("x1"), F.greatest(*y).alias("y1"))


def whole_frames() -> Column:
    """Whether an object's pixels are frames of its size; what isn't can't be painted in the right places."""
    return (F.col("rows") > 0) & (F.col("cols") > 0) & (F.size("pixels") % F.greatest(F.col("rows") * F.col("cols"), F.lit(1)) == 0)


BOXES = "array<struct<x0:int,y0:int,x1:int,y1:int>>"


def with_boxes(rows: DataFrame, boxes: DataFrame) -> DataFrame:
    """rows with `inner`, the boxes of their object, in order and inside its frames."""
    gathered = boxes.groupBy("instance_id").agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("boxes"))
    own = rows.join(gathered, "instance_id", "left")
    return own.withColumn("inner", F.transform(F.coalesce("boxes", F.array().cast(BOXES)), lambda b: clipped(b, F.col("rows"), F.col("cols")))).drop("boxes")


def covers(x: Column, y: Column) -> Column:
    """Whether a place lies in one of the boxes in `inner`."""
    return F.exists("inner", lambda b: (x >= b["x0"]) & (x < b["x1"]) & (y >= b["y0"]) & (y < b["y1"]))


def redacted(frames: DataFrame, boxes: DataFrame) -> DataFrame:
    """Objects with their boxes painted in every frame: 0, or the object's brightest value where that is black.

    Objects whose pixels aren't whole frames are refused (no row).
    """
    fill = F.when(F.col("photometric") == "MONOCHROME1", F.array_max("pixels")).otherwise(F.lit(0).cast("double"))
    ready = with_boxes(frames.where(whole_frames()).withColumn("fill", fill), boxes)
    place = lambda i: i % (F.col("rows") * F.col("cols"))
    painted = F.transform("pixels", lambda v, i: F.when(covers(place(i) % F.col("cols"), F.floor(place(i) / F.col("cols"))), F.col("fill")).otherwise(v))
    return ready.withColumn("pixels", painted).drop("inner", "fill")


def tiles(frames: DataFrame, edge: int = 256) -> DataFrame:
    """Objects cut into tiles of at most edge by edge pixels of one frame each.

    All columns but pixels come along, with top, the object's brightest value,
    and frame (from 0), row0, col0, height, width and pixels of the tile.
    Pixels that aren't whole frames are refused (no row).
    """
    rows, cols, size = F.col("rows"), F.col("cols"), F.col("rows") * F.col("cols")
    across, down = F.ceil(cols / edge).cast("int"), F.ceil(rows / edge).cast("int")
    count = F.floor(F.size("pixels") / size).cast("int") * across * down

    def one(k: Column) -> Column:
        frame, place = F.floor(k / (across * down)).cast("int"), k % (across * down)
        row0, col0 = (F.floor(place / across) * edge).cast("int"), (place % across * edge).cast("int")
        height, width = F.least(F.lit(edge), rows - row0), F.least(F.lit(edge), cols - col0)
        values = F.flatten(F.transform(F.sequence(F.lit(0), height - 1), lambda r: F.slice("pixels", frame * size + (row0 + r) * cols + col0 + 1, width)))
        return F.struct(frame.alias("frame"), row0.alias("row0"), col0.alias("col0"), height.alias("height"), width.alias("width"), values.alias("pixels"))

    cut = F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), one))
    rest = [c for c in frames.columns if c != "pixels"]
    # The tiles are made inside the row and then dealt out, so that no tile's row carries the whole object.
    return frames.where(whole_frames()).select(*rest, F.array_max("pixels").alias("top"), cut.alias("cut")).select(*rest, "top", F.explode("cut").alias("t")).select(*rest, "top", "t.*")


def redacted_tiles(cut: DataFrame, boxes: DataFrame) -> DataFrame:
    """`redacted` for tiles."""
    x = lambda i: F.col("col0") + i % F.col("width")
    y = lambda i: F.col("row0") + F.floor(i / F.col("width"))
    fill = F.when(F.col("photometric") == "MONOCHROME1", F.col("top")).otherwise(F.lit(0).cast("double"))
    touched = F.exists("inner", lambda b: (b["x0"] < F.col("col0") + F.col("width")) & (b["x1"] > F.col("col0")) & (b["y0"] < F.col("row0") + F.col("height")) & (b["y1"] > F.col("row0")))
    painted = F.transform("pixels", lambda v, i: F.when(covers(x(i), y(i)), fill).otherwise(v))
    return with_boxes(cut, boxes).withColumn("pixels", F.when(touched, painted).otherwise(F.col("pixels"))).drop("inner")


def reformatted_tiles(cut: DataFrame, orientation: str, index: int, edge: int = 256) -> DataFrame:
    """Per series, one axial, coronal or sagittal image out of its tiles, as tiles: series_uid, row0, col0, height, width and pixels.

    Slices are ordered by z, then object and frame.  A coronal or sagittal image
    shows the last slice first; the tiles that the plane doesn't cut aren't
    read, and what meets in one row is a tile of the new image.
    """
    order = ["series_uid", "z", "instance_id", "frame"]
    slices = identity.numbered(cut.where("row0 = 0 AND col0 = 0").select(*order), *order)
    ends = slices.groupBy("series_uid").agg(F.min("nth").alias("first"), F.max("nth").alias("last"))
    placed = slices.join(ends, "series_uid")
    if orientation == "Axial":
        wanted = F.col("first") + F.greatest(F.lit(0), F.least(F.lit(index), F.col("last") - F.col("first")))
        chosen = placed.where(F.col("nth") == wanted).select("series_uid", "instance_id", "frame")
        return cut.join(chosen, ["series_uid", "instance_id", "frame"], "left_semi").select("series_uid", "row0", "col0", "height", "width", "pixels")
    coronal = orientation == "Coronal"
    at = F.greatest(F.lit(0), F.least(F.lit(index), F.col("rows" if coronal else "cols") - 1))
    low, size = F.col("row0" if coronal else "col0"), F.col("height" if coronal else "width")
    inside = cut.where((low <= at) & (at < low + size))
    line = F.slice("pixels", (at - low) * F.col("width") + 1, F.col("width")) if coronal else F.transform(F.sequence(F.lit(0), F.col("height") - 1), lambda r: F.get("pixels", r * F.col("width") + at - low))
    lines = inside.select("series_uid", "instance_id", "frame", F.col("col0" if coronal else "row0").alias("along"), line.alias("line"))
    nth = placed.select("series_uid", "instance_id", "frame", (F.col("last") - F.col("nth")).alias("from_top"))
    dealt = lines.join(nth, ["series_uid", "instance_id", "frame"]).withColumn("row0", (F.floor(F.col("from_top") / edge) * edge).cast("int"))
    grouped = dealt.groupBy("series_uid", "row0", F.col("along").alias("col0")).agg(F.sort_array(F.collect_list(F.struct("from_top", "line"))).alias("held"))
    return grouped.select("series_uid", "row0", "col0", F.size("held").alias("height"), F.size(F.col("held")[0]["line"]).alias("width"), F.flatten(F.transform("held", lambda x: x["line"])).alias("pixels"))


def released(frames: DataFrame, boxes: DataFrame, quarantine: DataFrame) -> DataFrame:
    """Frames that leave quarantine, redacted, and under their study; boxes on objects without pixels are refused (no row)."""
    held = frames.join(quarantine.select("instance_id", "study_id"), "instance_id")
    bare = boxes.join(held.where(F.size("pixels") == 0), "instance_id", "left_semi").select("instance_id")
    return redacted(held.join(bare, "instance_id", "left_anti"), boxes).withColumn("route", F.lit("study"))


def slice_spacing(frames: DataFrame) -> DataFrame:
    """Per series, the median gap between slices in order; 1 where there is none or it isn't positive."""
    gaps = frames.withColumn("gap", F.col("z") - F.lag("z").over(Window.partitionBy("series_uid").orderBy("z")))
    middle = F.median("gap")
    return gaps.groupBy("series_uid").agg(F.count("*").alias("slices"), F.when(middle > 0, middle).otherwise(1.0).alias("spacing"))


def reformatted(frames: DataFrame, orientation: str, index: int) -> DataFrame:
    """Per series, one coronal or sagittal image, head up: the same row or column of every slice, last slice first."""
    cols, rows = F.col("cols"), F.col("rows")
    at = F.greatest(F.lit(0), F.least(F.lit(index), (rows if orientation == "Coronal" else cols) - 1))
    row = F.slice("pixels", at * cols + 1, cols) if orientation == "Coronal" else F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.get("pixels", r * cols + at))
    lines = frames.select("series_uid", "z", "instance_id", row.alias("line"))
    return lines.groupBy("series_uid").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("z", "instance_id", "line")), asc=False), lambda x: x["line"])).alias("pixels"))


def value_at(pixels: Column, cols: Column, x: Column, y: Column) -> Column:
    return F.get(pixels, y * cols + x)
