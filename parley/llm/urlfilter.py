"""URL filters by a temporal list join, in DataFrame operations only.

A list is a log of dated entries: a pattern of a kind (host, domain or prefix) is
added or removed from a category at a time. The log becomes validity intervals
[from, until), by each pattern's next entry. Every capture offers its host, the
domains above it and all its path prefixes as keys; an equi-join on (kind, pattern)
meets the intervals and the as-of condition keeps those in force at fetch time.

The list side is folded to one row a pattern, so a capture's key meets one row at
most. Spark broadcasts it while its measured size is under its threshold; beyond,
the join shuffles and a hot host's rows are split by the adaptive skew join.

Defined results: patterns are lower-case, without a leading www., as hosts are; a
prefix matches whole path segments at any depth, that of a bare host all its pages;
empty segments don't count; a domain matches itself and the hosts below it, but one
of a single label no host below it; a null or unparsable URL has no host and matches
nothing; a null fetch time likewise; entries at the same time count as a removal if
any of them is; list rows with a null are no entries; repeated rows get a row each;
an empty list blocks nothing, an empty table gives no rows; other columns are carried
along, but for one named matches, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm.scratch import Scratch


def _pattern(kind: Column, pattern: Column) -> Column:
    """The pattern in the form that captures' keys have."""
    bare = F.regexp_replace(F.lower(pattern), r"^www\.", "")
    return F.when(kind == "prefix", F.regexp_replace(F.regexp_replace(bare, "/+", "/"), "/$", "")).otherwise(bare)


def intervals(entries: DataFrame) -> DataFrame:
    """kind, pattern, category, from, until (null: still in force) from kind, pattern, category, action, at."""
    events = entries.dropna(subset=["kind", "pattern", "category", "action", "at"]).groupBy("kind", _pattern(F.col("kind"), F.col("pattern")).alias("pattern"), "category", "at").agg(F.max(F.col("action") == "remove").alias("gone"))
    w = Window.partitionBy("kind", "pattern", "category").orderBy("at")
    return events.select("kind", "pattern", "category", F.col("at").alias("from"), F.lead("at").over(w).alias("until"), "gone").filter(~F.col("gone")).drop("gone")


def host_of(url: Column) -> Column:
    """The lower-case host, without port and a leading www."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.nullif(F.regexp_replace(found, r"^www\.", ""), F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def keys_of(url: Column) -> Column:
    """The (kind, pattern) pairs that a URL can match, as an array."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    count = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), F.greatest(count - 1, F.lit(1))), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, count), ".").alias("pattern")))
    steps = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    parts = F.concat(F.array(host), steps)
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.lit("prefix").alias("kind"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("pattern")))
    none = F.array().cast("array<struct<kind:string,pattern:string>>")
    return F.when(host.isNotNull(), F.concat(F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern"))), domains, F.coalesce(prefixes, none))).otherwise(none)


def active_entries(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """The columns of captures (which has url and fetched_at) with matches: the (kind, pattern, category) in force at fetch time, sorted."""
    folded = intervals(entries).groupBy("kind", "pattern").agg(F.collect_list(F.struct("category", "from", "until")).alias("__spans"))
    # Written first: read twice, captures out of a shuffle could be numbered anew.
    keyed = Scratch(captures.sparkSession).save(captures.drop("matches").withColumn("__row", F.monotonically_increasing_id()), "captures")
    keys = keyed.select("__row", F.col("fetched_at").alias("__at"), F.explode(keys_of(F.col("url"))).alias("k")).select("__row", "__at", "k.*")
    live = F.filter("__spans", lambda s: (s["from"] <= F.col("__at")) & (s["until"].isNull() | (F.col("__at") < s["until"])))
    hits = keys.join(folded, ["kind", "pattern"]).select("__row", "kind", "pattern", F.explode(live).alias("s")).groupBy("__row").agg(F.array_sort(F.collect_set(F.struct("kind", "pattern", F.col("s.category").alias("category")))).alias("matches"))
    none = F.array().cast("array<struct<kind:string,pattern:string,category:string>>")
    return keyed.join(hits, "__row", "left").withColumn("matches", F.coalesce("matches", none)).drop("__row")
