"""Numbers and boxes: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = "  \t\n"
#: Most places that a scale may move the point.
MOST_PLACES = 9999


def to_thousandths(box: Column) -> Column:
    """MTH-01: whole thousandths, halves to even."""
    return F.transform(box, lambda x: F.rint(x * 1000).cast("int"))


def from_thousandths(box: Column) -> Column:
    """MTH-02."""
    return F.transform(box, lambda x: x / F.lit(1000.0))


def clamp01(x: Column) -> Column:
    """MTH-03."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def page_box(box: Column, x0: Column, y0: Column, width: Column, height: Column) -> Column:
    """MTH-04: a box relative to its page; a page of size 0 counts as 1."""
    w, h = F.when(width == 0, 1.0).otherwise(width), F.when(height == 0, 1.0).otherwise(height)
    return F.array(clamp01((box[0] - x0) / w), clamp01((box[1] - y0) / h), clamp01((box[2] - x0) / w), clamp01((box[3] - y0) / h))


def iou(a: Column, b: Column) -> Column:
    """AGG-03: intersection over union; 0 without union. Negative extents count as 0."""
    side = lambda p, q: F.greatest(F.lit(0.0), q - p)
    inter = side(F.greatest(a[0], b[0]), F.least(a[2], b[2])) * side(F.greatest(a[1], b[1]), F.least(a[3], b[3]))
    union = side(a[0], a[2]) * side(a[1], a[3]) + side(b[0], b[2]) * side(b[1], b[3]) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


def format_number(d: Column) -> Column:
    """MTH-06: plain notation without trailing zeros."""
    s = d.cast("string")
    return F.when(F.instr(s, ".") > 0, F.regexp_replace(s, r"\.?0+$", "")).otherwise(s)


def currency_of(measures: Column) -> Column:
    """MTH-07: the first iso4217 measure's code, null without one."""
    found = F.filter(measures, lambda x: x.startswith("iso4217:"))
    return F.when(F.size(found) > 0, F.substring_index(F.get(found, F.lit(0)), ":", -1))


PLAIN, POWERED = "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$", "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)[eE][+-]?[0-9]{1,4}$"


def _bare(raw: Column, fmt: Column) -> Column:
    """A number's text without blanks, signs of currency and percent, and separators of thousands."""
    t = F.translate(F.coalesce(raw, F.lit("")), BLANKS, "")
    t = F.when(F.coalesce(F.instr(fmt, "comma-decimal"), F.lit(0)) > 0, F.translate(F.translate(t, ".", ""), ",", ".")).otherwise(F.translate(t, ",", ""))
    return F.ltrim(F.translate(t, "%", ""), F.lit("$"))


def _places(bare: Column, powered: Column, scale: Column) -> Column:
    """By how many places the point moves: the scale and the number's own power of ten."""
    given = F.when(F.coalesce(scale, F.lit("")) == "", F.lit(0)).otherwise(F.trim(scale).try_cast("int"))
    power = F.coalesce(F.substring_index(F.lower(bare), "e", -1).try_cast("int"), F.lit(0))
    return given + F.when(powered, power).otherwise(F.lit(0))


def _moved(whole: Column, part: Column, zeros: Column, k: Column) -> tuple[Column, Column]:
    """Digits before and after the point when it has moved by k places, without zeros around them."""
    right, left = F.concat(part, zeros), F.concat(zeros, whole)
    new_whole = F.when(k > 0, F.concat(whole, F.left(right, k))).when(k < 0, F.left(left, F.length(left) + k)).otherwise(whole)
    new_part = F.when(k > 0, F.substr(right, k + 1)).when(k < 0, F.concat(F.right(left, -k), part)).otherwise(part)
    return F.ltrim(new_whole, F.lit("0")), F.rtrim(new_part, F.lit("0"))


def _said(whole: Column, part: Column, minus: Column) -> Column:
    sign = F.when(minus & ((whole != "") | (part != "")), F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, F.when(whole == "", F.lit("0")).otherwise(whole), F.when(part == "", F.lit("")).otherwise(F.concat(F.lit("."), part)))


def _with_unit(number: Column, measures: Column) -> Column:
    currency, shares = currency_of(measures), F.array_contains(measures, "xbrli:shares")
    after = F.when(shares, F.when(currency.isNotNull(), F.lit(" per share")).otherwise(F.lit(" shares"))).otherwise(F.lit(""))
    return F.concat(F.coalesce(F.concat(currency, F.lit(" ")), F.lit("")), number, after)


def with_canonical_values(rows: DataFrame, raw: Column, scale: Column, sign: Column, fmt: Column, measures: Column, into: str = "value", drop: bool = False) -> DataFrame:
    """MTH-05: rows with the full value and its unit, null where the text is no number or the scale is none between
    -MOST_PLACES and MOST_PLACES (a value's text is that long); with drop such rows go.

    Any number of digits is exact: the point is moved in the text, so there is no type whose range could end the job. Signs
    are kept, zero has none. A percent sign is dropped unscaled. Each step is a plain column that is computed once: rows are
    judged by the number's pattern and the places, before any text is built.
    """
    names = rows.columns
    rows = rows.select("*", _bare(raw, fmt).alias("_bare"), scale.alias("_scale"), sign.alias("_sign"), measures.alias("_measures"))
    rows = rows.withColumn("_powered", F.col("_bare").rlike(POWERED))
    rows = rows.withColumn("_places", _places(F.col("_bare"), F.col("_powered"), F.col("_scale")))
    rows = rows.withColumn("_number", F.when(F.col("_powered"), F.substring_index(F.lower("_bare"), "e", 1)).otherwise(F.col("_bare")))
    good = (F.col("_powered") | F.col("_bare").rlike(PLAIN)) & (F.abs("_places") <= MOST_PLACES)
    rows = rows.filter(good) if drop else rows.withColumn("_number", F.when(good, F.col("_number")))
    negative = F.col("_number").startswith("-")
    rows = rows.withColumn("_minus", F.when(F.col("_sign") == "-", ~negative).otherwise(negative))
    rows = rows.withColumn("_digits", F.split(F.ltrim("_number", F.lit("+-")), "\\."))
    rows = rows.select("*", F.get("_digits", F.lit(0)).alias("_whole"), F.coalesce(F.get("_digits", F.lit(1)), F.when(F.col("_number").isNotNull(), F.lit(""))).alias("_part"), F.repeat(F.lit("0"), F.least(F.abs("_places"), F.lit(MOST_PLACES))).alias("_zeros"))
    whole, part = _moved(F.col("_whole"), F.col("_part"), F.col("_zeros"), F.col("_places"))
    rows = rows.select("*", whole.alias("_w"), part.alias("_p"))
    value = _with_unit(_said(F.col("_w"), F.col("_p"), F.col("_minus")), F.col("_measures"))
    return rows.select(*names, value.alias(into))


def magnitude(value: Column) -> Column:
    """MTH-13: size of the first number of a text, 0 without one."""
    return F.abs(F.coalesce(F.regexp_extract(value, r"-?\d+(?:\.\d+)?", 0).try_cast("double"), F.lit(0.0)))


def lerp(a: float, b: float, t: Column) -> Column:
    """MTH-08: between a and b, t clamped to 0..1."""
    return F.lit(float(a)) + (float(b) - float(a)) * clamp01(t)


def warp_box(box: Column, m: Column) -> Column:
    """MTH-10: the box around the four corners under the 3x3 matrix m (9 numbers by row), clamped."""
    corners = [(box[0], box[1]), (box[2], box[1]), (box[2], box[3]), (box[0], box[3])]
    xs, ys = [], []
    for x, y in corners:
        w = m[6] * x + m[7] * y + m[8]
        xs.append((m[0] * x + m[1] * y + m[2]) / w)
        ys.append((m[3] * x + m[4] * y + m[5]) / w)
    return F.array(clamp01(F.least(*xs)), clamp01(F.least(*ys)), clamp01(F.greatest(*xs)), clamp01(F.greatest(*ys)))


def selection_band(n: Column) -> tuple[Column, Column]:
    """MTH-11: fewest and most fields to ask for."""
    lo = F.greatest(F.lit(1), F.ceil(F.lit(0.3) * n).cast("int"))
    return lo, F.greatest(lo, F.floor(F.lit(0.9) * n).cast("int"))


def token_budget(n: Column) -> Column:
    """MTH-12."""
    return F.least(F.lit(20000), 2048 + 80 * n)


def downscale(width: Column, height: Column, longest: int) -> tuple[Column, Column]:
    """MTH-14: size within longest, never enlarged."""
    s = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return F.greatest(F.lit(1), F.rint(width * s).cast("int")), F.greatest(F.lit(1), F.rint(height * s).cast("int"))


def pixel_rect(box: Column, width: Column, height: Column) -> Column:
    """MTH-16: pixel corners, and the label's top 12 above."""
    return F.struct((box[0] * width).alias("x0"), (box[1] * height).alias("y0"), (box[2] * width).alias("x1"), (box[3] * height).alias("y1"), F.greatest(F.lit(0.0), box[1] * height - 12).alias("label_y"))


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) from the md5 of the keys; the same on every engine and partitioning."""
    text = F.concat_ws("|", *[k.cast("string") for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def augmentation_plan(seed: Column) -> Column:
    """MTH-15: profile, quality, whether and how far to warp."""
    from pagemill.functions.text import choice

    profiles = ("clean_scan", "phone_photo", "old_photocopy", "fax")
    draw = lambda name: uniform(seed, F.lit(name))
    return F.struct(
        choice(F.concat(seed.cast("string"), F.lit("|profile")), profiles).alias("profile"), F.round(lerp(0.25, 0.9, draw("quality")), 3).alias("quality"),
        (draw("geometric") < 0.5).alias("geometric"), F.round(lerp(0.4, 0.9, draw("geo")), 3).alias("geo_quality"),
    )
