"""Names, tags and keys as column expressions."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The stem of a perturbation's tag, where it isn't the perturbation's name.
STEMS = {"gaussian_blur": "blur", "defocus_blur": "defocus", "illumination": "brightness", "red_channel_shift": "color_shift"}
#: Tag stems and the families they mean, where stem and family differ.
FAMILIES = {"blur": "gaussian_blur", "defocus": "defocus_blur", "brightness": "illumination", "color_shift": "red_channel_shift"}
#: Families whose stem has more than one word or is its own family.
PLAIN = ("compound_optical", "compound_digital", "compound_field", "green_channel_shift", "blue_channel_shift", "gaussian_noise", "shot_noise", "impulse_noise", "motion_blur", "zoom_blur")
#: Perturbations whose severity is a whole number in the tag.
WHOLE = ("gaussian_blur", "defocus_blur", "jpeg", "color_shift", "red_channel_shift", "green_channel_shift", "blue_channel_shift", "shot_noise", "motion_blur", "rotation")


@F.arrow_udf(StringType())
def decomposed(text: pa.Array) -> pa.Array:
    """Compatibility decomposition (NFKD), which Spark has no function for; null stays null."""
    return pc.utf8_normalize(text, form="NFKD")


def severity_key(raw: Column) -> Column:
    """Numbers in their shortest form ("2.0" is "2", "0.10" is "0.1", "1e-7" is "1e-07"), other text as it is."""
    number = raw.try_cast("double")
    whole = number == F.floor(number)
    # six significant digits; without an exponent from 1e-4 up to 1e6
    scientific = F.format_string("%.5e", number)
    power = F.regexp_extract(scientific, "e(.*)$", 1).try_cast("int")
    trimmed = lambda c: F.regexp_replace(c, r"\.?0+$", "")
    plain = trimmed(scientific.try_cast("decimal(20,10)").cast("string"))
    short = F.when(power.between(-4, 5), plain).otherwise(F.concat(trimmed(F.regexp_extract(scientific, "^([^e]*)", 1)), F.regexp_extract(scientific, "(e.*)$", 1)))
    return F.when(number.isNull(), raw).when(whole, number.cast("long").cast("string")).otherwise(short)


def cache_tag(name: Column, value: Column) -> Column:
    stem = name
    for full, short in STEMS.items():
        stem = F.when(name == full, short).otherwise(stem)
    text = F.when(name.isin(*WHOLE), value.try_cast("double").cast("long").cast("string")).otherwise(F.replace(value, F.lit("."), F.lit("_")))
    return F.concat_ws("_", stem, text)


def family(tag: Column) -> Column:
    """By the longest known stem that the tag starts with; else the first word."""
    found = F.split(tag, "_")[0]
    known = {**FAMILIES, **{p: p for p in PLAIN}}
    for stem in sorted(known, key=len):  # longer stems are looked at first, so they are put outermost
        found = F.when(tag.startswith(f"{stem}_"), known[stem]).otherwise(found)
    return found


def norm_key(name: Column) -> Column:
    return F.translate(F.lower(F.trim(name)), "_-", "  ")


def normalize_species(name: Column) -> Column:
    """Lower case without accents; underscores, slashes, hyphens and white space are one space, other marks vanish."""
    plain = F.lower(F.regexp_replace(decomposed(name), r"\p{M}", ""))
    spaced = F.regexp_replace(F.regexp_replace(plain, r"[_\\/-]+", " "), r"(?U)[\s\x1c-\x1f]+", " ")
    return F.trim(F.regexp_replace(spaced, "[^a-z0-9 ]", ""))


def real_binomial(name: Column) -> Column:
    """Two words or more, the second in lower case."""
    parts = F.split(F.trim(name), r"\s+")
    return F.coalesce((F.size(parts) >= 2) & F.get(parts, F.lit(1)).rlike("^[a-z]"), F.lit(False))


def safe_tag(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, "[^A-Za-z0-9_-]", "_"), 1, 60)


def significance(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")
