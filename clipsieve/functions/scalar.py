"""Scalar functions over ids, sizes, colours and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The palette of object colours.
PALETTE = [
    (255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 255, 0), (255, 0, 255), (0, 255, 255),
    (255, 128, 0), (128, 0, 255), (0, 255, 128), (255, 0, 128), (128, 255, 0), (0, 128, 255),
]


def object_color(object_id: Column) -> Column:
    """Colour as struct r, g, b; ids wrap around, 0 and negative ones too."""
    colours = F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip("rgb", c, strict=True))) for c in PALETTE))
    return F.get(colours, F.pmod(object_id - 1, F.lit(len(PALETTE))).cast("int"))


def stem(path: Column) -> Column:
    """File name without directory and last extension; a name that begins with its only dot keeps it."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    return F.regexp_replace(name, "(?<=.)\\.[^.]*$", "")


def video_id(path: Column) -> Column:
    return F.concat(stem(path), F.lit("_"), F.substring(F.md5(path), 1, 8))


def frame_name(prefix: str, idx: Column, fmt: str = "png") -> Column:
    return F.format_string(f"{prefix}_%06d.{fmt}", idx)


def mask_name(frame: Column, obj: Column) -> Column:
    return F.format_string("mask_f%06d_o%d.png", frame, obj)


def edited_name(idx: Column) -> Column:
    return F.format_string("%06d.png", idx)


def working_size(width: Column, height: Column, most: int = 512) -> Column:
    """Width and height scaled so that neither exceeds most, truncated, then cut to multiples of 8."""
    ratio = F.greatest(width, height) / F.lit(most)
    scaled = lambda v: F.when(ratio > 1, (v / ratio).cast("int")).otherwise(v.cast("int"))
    cut = lambda v: scaled(v) - scaled(v) % 8
    return F.struct(cut(width).alias("w"), cut(height).alias("h"))


def cover_crop(width: Column, height: Column, to_width: int, to_height: int) -> Column:
    """Scale that covers the target, the scaled size rounded up, and the centred crop's offsets."""
    scale = F.greatest(F.lit(float(to_width)) / width, F.lit(float(to_height)) / height)
    w, h = F.ceil(width * scale).cast("long"), F.ceil(height * scale).cast("long")
    half = lambda v, to: F.floor((v - to) / 2).cast("long")
    return F.struct(w.alias("w"), h.alias("h"), half(w, to_width).alias("x"), half(h, to_height).alias("y"))


def resolution(width: Column, height: Column) -> Column:
    return F.concat(width.cast("string"), F.lit("x"), height.cast("string"))


def area_percent(area: Column, pixels: int) -> Column:
    """An area in percent of an image."""
    return area / F.lit(pixels) * 100


def to_mask_bit(value: Column, most: Column) -> Column:
    """A mask value as a truth value: on a scale to 255 if the mask's largest value is above 1, else on one to 1."""
    return F.when(most > 1, value / 255.0).otherwise(value.cast("double")) > 0.5


def to_mask_byte(bit: Column) -> Column:
    return F.when(bit, F.lit(255)).otherwise(F.lit(0))


def grey_to_rgb(value: Column) -> Column:
    return F.struct(*(value.alias(c) for c in "rgb"))


def swap_red_blue(colour: Column) -> Column:
    """A colour's struct with r and b exchanged; applied twice it is the same again."""
    return F.struct(colour["b"].alias("r"), colour["g"].alias("g"), colour["r"].alias("b"))


def backward_index(anchor: Column, reverse: Column) -> Column:
    """Place in a video of a frame of the reversed pass that starts at the anchor."""
    return anchor - reverse


def workers(wanted: Column, jobs: Column) -> Column:
    """Workers to start: as many as wanted, one at least, no more than jobs."""
    return F.least(F.greatest(wanted, F.lit(1)), jobs)


def threads_per_worker(cpus: Column, n_workers: Column) -> Column:
    """An even share of the processors, two at least."""
    return F.greatest(F.lit(2).cast("long"), F.floor(cpus / n_workers))


def now_iso() -> Column:
    """The time now as ISO text to the microsecond; another one in each query."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def fill_template(template: Column, name: str, value: Column) -> Column:
    """A text with {name} replaced."""
    return F.replace(template, F.lit("{" + name + "}"), value)


def probed(count: Column) -> Column:
    """A frame count that could not be read is 0."""
    return F.coalesce(count, F.lit(0).cast("long"))


#: Pixels by which a mask grows at least, so that thin parts survive a model's own scaling.
MIN_DILATION = 4


def effective_dilation(px: Column, least: int = MIN_DILATION) -> Column:
    return F.greatest(px, F.lit(least))


def python_round2(x: Column) -> Column:
    """round(x, 2) as Python has it, correct on the binary value; round() and bround() differ on some ties. NaN gives null.

    x times 100 is taken with its rounding error, exactly, by cutting x into halves of 26 bits. Only where the product
    ends in one half does the error count: it tells on which side of the middle x lies, and the even neighbour is for
    an x that is the middle itself. From 10 ** 13 on doubles have no third digit that this could go wrong on.
    """
    x = F.col(x) if isinstance(x, str) else x
    product = x * 100.0
    wide = x * 134_217_729.0
    high = wide - (wide - x)
    error = (high * 100.0 - product) + (x - high) * 100.0
    low = F.floor(product).cast("double")
    whole = F.when((product - low == 0.5) & (error != 0.0), F.when(error > 0, low + 1.0).otherwise(low)).otherwise(F.rint(product))
    return F.when(x.isNull() | F.isnan(x), F.lit(None).cast("double")).when(F.abs(x) < 1e13, whole / 100.0).otherwise(F.round(x, 2))
