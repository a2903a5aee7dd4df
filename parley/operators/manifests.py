"""Validation, comparison and merging of file manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Host endings that downloads may come from.
ALLOWED_HOSTS = ("github.com", "raw.githubusercontent.com", "githubusercontent.com", "huggingface.co", "hf.co", "huggingfaceusercontent.com", "modelscope.cn", "modelscope.com")


def portable_name(name: Column) -> Column:
    return F.coalesce(name.rlike(r"^[^/\\]+$") & ~name.isin(".", ".."), F.lit(False))


def validated(entries: DataFrame) -> DataFrame:
    """entries with error: the first rule that (name, sha256, size) breaks, or null; a missing size breaks none."""
    error = (
        F.when(~portable_name(F.col("name")), F.lit("bad_name"))
        .when(~F.coalesce(F.col("sha256").rlike("^[a-fA-F0-9]{64}$"), F.lit(False)), F.lit("bad_sha256"))
        .when((F.col("size") < 0) | (F.col("size") > (1 << 53) - 1), F.lit("bad_size"))
    )
    return entries.withColumn("error", error)


def duplicates(entries: DataFrame, by: list[str]) -> DataFrame:
    return entries.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1")


def compared(expected: DataFrame, found: DataFrame) -> DataFrame:
    """name and problem (missing, unexpected, changed) where a tree differs from its manifest; optional files may be missing."""
    e = expected.select("name", F.col("sha256").alias("__e"), F.coalesce("required", F.lit(True)).alias("__r"))
    both = e.join(found.select("name", F.col("sha256").alias("__f")), "name", "full_outer")
    problem = F.when(F.col("__e").isNull(), F.lit("unexpected")).when(F.col("__f").isNull() & F.col("__r"), F.lit("missing")).when(F.col("__e") != F.col("__f"), F.lit("changed"))
    return both.withColumn("problem", problem).filter("problem is not null").select("name", "problem")


def reusable(entries: DataFrame, installed: DataFrame) -> DataFrame:
    """entries with reuse: whether the same name, checksum and version is installed."""
    have = installed.select("name", "sha256", "version").distinct().withColumn("__have", F.lit(True))
    return entries.join(have, ["name", "sha256", "version"], "left").withColumn("reuse", F.coalesce("__have", F.lit(False))).drop("__have")


def merged(manifests: DataFrame) -> DataFrame:
    """platform, version, n_files and conflict: a platform given twice, or another version than the first platform's."""
    first = manifests.agg(F.min(F.struct("platform", "version"))["version"].alias("__v"))
    per = manifests.groupBy("platform").agg(F.countDistinct("part").alias("parts"), F.min("version").alias("version"), F.count("*").alias("n_files"))
    conflict = F.when(F.col("parts") > 1, F.lit("duplicate_platform")).when(F.col("version") != F.col("__v"), F.lit("version_conflict"))
    return per.join(F.broadcast(first)).select("platform", "version", "n_files", conflict.alias("conflict"))


def listed(files: DataFrame, base_url: str, optional: tuple[str, ...] = ()) -> DataFrame:
    """A manifest's entries in order of names: name, url, sha256, size and required, from files (name, sha256, size).

    A name that isn't portable, or is listed twice, raises an error.
    """
    twice = F.count("*").over(Window.partitionBy("name")) > 1
    checked = files.withColumn("name", F.when(~portable_name(F.col("name")) | twice, F.raise_error(F.concat(F.lit("bad name in manifest: "), "name"))).otherwise(F.col("name")))
    url = F.concat(F.lit(base_url.rstrip("/") + "/"), F.call_function("url_encode", "name"))
    return checked.select("name", url.alias("url"), F.lower("sha256").alias("sha256"), "size", (~F.col("name").isin(*optional) if optional else F.lit(True)).alias("required")).orderBy("name")


def first_valid(mirrors: DataFrame) -> DataFrame:
    """name and ordinal of the first mirror whose size and checksum are right; null where none is."""
    good = F.coalesce((F.col("got_size") == F.col("size")) & (F.lower("got_sha256") == F.lower("sha256")), F.lit(False))
    return mirrors.groupBy("name").agg(F.min(F.when(good, F.col("ordinal"))).alias("ordinal"), F.count("*").alias("n_mirrors"))


def url_allowed(url: Column, hosts: tuple[str, ...] = ALLOWED_HOSTS) -> Column:
    """An https address on a listed host or below one."""
    host = F.regexp_extract(F.lower(url), r"^https://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    ok = F.lit(False)
    for h in hosts:
        ok = ok | (host == h) | host.endswith(f".{h}")
    return F.coalesce(ok & (host != ""), F.lit(False))


def url_redacted(url: Column) -> Column:
    """Without user, password, query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/@]*@", "$1")
