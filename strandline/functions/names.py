"""Functions over file stems, image names and feature names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.scalars import col

# The file-name contract.
STAGE_PREFIXES = ("detections_", "anomaly_frames_")
MODE_PREFIX = "^(backlit|laserlit)_"
CAMERA_SUFFIX = r"_cam\d+$"
SETTINGS_PATTERN = r"\b[^_]+_(\d+)m_(\d+)mm(?:_\d+)?\b"
MACHINE_PATTERN = r"^([A-Za-z]+)_"
MACHINES = ("we", "fr")


def _group_or_null(c: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(c, pattern, group)
    return F.when(found != "", found)


def file_stem(path: Column | str) -> Column:
    """Last path component without its final extension."""
    name = F.element_at(F.split(col(path), "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def normalize_stem(c: Column | str) -> Column:
    out = F.lower(col(c))
    for prefix in STAGE_PREFIXES:
        out = F.regexp_replace(out, f"^{prefix}", "")
    out = F.regexp_replace(out, MODE_PREFIX, "")
    out = F.regexp_replace(out, CAMERA_SUFFIX, "")
    out = F.regexp_replace(out, r"[_\-]+", "_")
    return F.regexp_replace(out, "^_+|_+$", "")


def feed_setting(stem: Column | str) -> Column:
    """Feed speed parsed from a stem such as ``fr_5m_20mm_1``; NULL when it does not match."""
    return _group_or_null(normalize_stem(stem), SETTINGS_PATTERN, 1).try_cast("int")


def distance_setting(stem: Column | str) -> Column:
    return _group_or_null(normalize_stem(stem), SETTINGS_PATTERN, 2).try_cast("int")


def machine_group(c: Column | str) -> Column:
    """Leading letters before the first underscore, lower case; ``unknown`` without them."""
    return F.lower(F.coalesce(_group_or_null(col(c), MACHINE_PATTERN, 1), F.lit("unknown")))


def frame_number(image_name: Column | str) -> Column:
    """Number after ``frame_``, else the first digits, else 0."""
    c = col(image_name)
    text = F.coalesce(_group_or_null(c, r"frame_(\d+)", 1), _group_or_null(c, r"(\d+)", 1), F.lit("0"))
    return text.try_cast("bigint")


def safe_token(c: Column | str, default: str = "source") -> Column:
    """Replace anything but letters, digits, ``-`` and ``_``; trim underscores; never empty."""
    out = F.regexp_replace(F.regexp_replace(col(c), r"[^\p{L}\p{N}_\-]", "_"), "^_+|_+$", "")
    return F.when(out == "", F.lit(default)).otherwise(out)


def suffix_name(name: Column | str, source: Column | str) -> Column:
    """Insert ``_<source>`` between stem and extension."""
    c = col(name)
    extension = F.regexp_extract(c, r"(?<=.)(\.[^.]+)$", 1)
    return F.concat(file_stem(c), F.lit("_"), col(source), extension)


def natural_key(c: Column | str) -> Column:
    """Sort key in which digit runs compare as numbers: each run is led by its own digit count."""
    digits = F.regexp_extract_all(col(c), F.lit(r"(\d+)"), F.lit(1))
    words = F.split(col(c), r"\d+")

    def numbered(d: Column) -> Column:
        bare = F.regexp_replace(d, "^0+(?=.)", "")
        return F.concat(F.lpad(F.length(bare).cast("string"), 5, "0"), F.lit(":"), bare)

    keyed = F.transform(digits, numbered)
    return F.array_join(F.zip_with(words, keyed, lambda w, d: F.concat(w, F.coalesce(d, F.lit("")))), "")


def condition_label(columns: list[tuple[str, Column]]) -> Column:
    """``a=1.000|b=2.000``, with ``missing`` for absent values; ``all`` without columns."""
    if not columns:
        return F.lit("all")
    parts = [
        F.concat(F.lit(f"{n}="), F.when(c.isNull(), F.lit("missing")).otherwise(F.format_string("%.3f", c.cast("double"))))
        for n, c in columns
    ]
    return F.concat_ws("|", *parts)


def labelled(c: Column | str, rules: Sequence[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first rule (pattern, label) whose pattern is found in the text."""
    text, out = col(c), F.lit(otherwise)
    for pattern, label in reversed(list(rules)):
        out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def acquisition_mode(path: Column | str) -> Column:
    """``backlit`` when any parent directory has that name (case-blind), else ``laserlit``."""
    parents = F.slice(F.split(F.lower(col(path)), "/"), 1, F.greatest(F.size(F.split(col(path), "/")) - 1, F.lit(0)))
    return F.when(F.array_contains(parents, "backlit"), "backlit").otherwise("laserlit")
