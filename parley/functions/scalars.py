"""Scalar functions on text, time, numbers and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The grammar of identifiers.
ID_GRAMMAR = {
    "task": r"^task_[a-f0-9]{16,64}$",
    "learning": r"^learn_[a-f0-9]{16,64}$",
    "segment": r"^seg_[A-Za-z0-9][A-Za-z0-9_-]{0,127}$",
    "person": r"^person_[\p{L}\p{N}_-]{1,128}$",
}


def valid_id(kind: str, value: Column) -> Column:
    return F.coalesce(value.rlike(ID_GRAMMAR[kind]), F.lit(False))


def valid_person_name(value: Column) -> Column:
    """1 to 128 code points without control characters, after trimming."""
    name = F.regexp_replace(value, r"^(?U)\s+|(?U)\s+$", "")
    return F.coalesce((F.length(name) >= 1) & (F.length(name) <= 128) & ~name.rlike(r"\p{Cntrl}"), F.lit(False))


def clean_text(value: Column) -> Column:
    """Without <|tags|>, each run of white space as one space, trimmed."""
    squeezed = F.regexp_replace(F.regexp_replace(value, r"<\|[^>]+\|>", ""), r"(?U)\s+", " ")
    return F.regexp_replace(squeezed, "^ | $", "")


def format_clock(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds, hours unbounded; dashes for what is no finite number."""
    whole = F.floor(F.greatest(seconds.cast("double"), F.lit(0.0))).cast("long")
    text = F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole % 3600 / 60), whole % 60)
    return F.when(seconds.isNull() | F.isnan(seconds.cast("double")) | (F.abs(seconds.cast("double")) == float("inf")), F.lit("--:--:--")).otherwise(text)


def subtitle_clock(milliseconds: Column, separator: str) -> Column:
    """HH:MM:SS and milliseconds of a whole number of them."""
    s = F.floor(milliseconds / 1000)
    return F.format_string("%02d:%02d:%02d%s%03d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60, F.lit(separator), milliseconds % 1000)


def clamp(value: Column, low: float, high: float, fallback: float) -> Column:
    """Text or number into [low, high]; what is no finite number gives the fallback."""
    number = value.try_cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when(usable, F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), number))).otherwise(F.lit(float(fallback)))


def person_id(name: Column) -> Column:
    """An identifier from a name: lower case, other than letters and numbers as one underscore; a hash where nothing is left."""
    low = F.lower(F.regexp_replace(name, r"^(?U)\s+|(?U)\s+$", ""))
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(low, r"(?U)\s+", "_"), r"[^\p{L}\p{N}_-]+", "_"), "^_+|_+$", "")
    return F.concat(F.lit("person_"), F.when(slug == "", F.substring(F.sha2(name.cast("binary"), 256), 1, 16)).otherwise(F.substring(slug, 1, 128)))


def random_id(kind: str) -> Column:
    """A new identifier of the kind (task or learning) for each row, from 16 or 8 random bytes; not the same when a row is computed again."""
    size, prefix = {"task": (32, "task_"), "learning": (16, "learn_")}[kind]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.uuid().cast("binary"), 256), 1, size))


def progress(done: Column, total: Column) -> Column:
    """Percent of a run while its chunks are worked on."""
    return (38 + F.floor(done / F.greatest(total, F.lit(1)) * 28)).cast("long")


def hash_of(value: Column) -> Column:
    """sha256 of canonical JSON: fields in order, nulls printed."""
    return F.sha2(F.to_json(value, {"ignoreNullFields": "false"}).cast("binary"), 256)


def canonical_cluster_id(value: Column) -> Column:
    """cluster_N of a whole number; of other text only a cluster_ identifier survives."""
    digits = F.concat(F.lit("cluster_"), F.regexp_replace(value, r"^0+(?=\d)", ""))
    return F.when(value.rlike(r"^\d+$"), digits).when(value.rlike(r"^cluster_[A-Za-z0-9_-]+$"), value)


def lenient_cluster_id(value: Column) -> Column:
    """cluster_N of a whole number; other text passes, trimmed."""
    text = F.trim(value)
    return F.when(text.rlike(r"^\d+$"), F.concat(F.lit("cluster_"), F.regexp_replace(text, r"^0+(?=\d)", ""))).when(text != "", text)
