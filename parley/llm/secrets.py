"""Secret scans with multipart credential linking, in DataFrame operations only.

Base kinds are found by pattern anywhere: assign, access and hex. Weak parts
(identifier, key and endpoint candidates) say little alone: they are reported only
where complementary parts stand in one scope: no more than SCOPE characters apart,
from end to start. Parts are joined as intervals: the text is cut into cells of a
scope, a weak part enters the cells that it covers and every part those that its
scope reaches, and a weak part counts if a complement in one of its cells is near. A
cell holds no more parts than fit its characters, so no group grows with a document.

Defined results: null and empty texts have no spans; spans of one kind never
overlap; equal rows get equal results; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parley.llm.scratch import Scratch

#: The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A cheap test that every text with a match passes.
ASSIGN_HINT = r"(?i:passw|secret|token|api_?key)"

#: Weak parts: what tells who connects, what it proves it with, and where to.
IDENTIFIER = r"""(?i:user(?:name)?|login|client_?id|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
IDENTIFIER_HINT = r"""(?i:user|login|client_?id|account)(?i:name)?["']?\x20*[:=]"""
KEY = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}"
ENDPOINT = r"(?i:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s\"'<>|]{3,}"
KINDS = ("assign", "access", "hex", "identifier", "key", "endpoint")
COMPLEMENT = {"identifier": ("key", "hex", "assign"), "key": ("identifier", "endpoint", "access"), "endpoint": ("key", "access")}
SCOPE = 200


def _widths(text: Column, pattern: str, kind: str, hint: Column, least: tuple[int, int] | None = None) -> Column:
    """Of each match of the pattern: the code points since the match before it, its own, and whether it counts.

    least=(group, n): matches of which that group is shorter than n don't count.
    """
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(least[0])) if least else match
    sizes = F.arrays_zip(match.alias("m"), group.alias("g"))
    found = F.zip_with(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(match)), sizes,
        lambda gap, s: F.struct(F.lit(KINDS.index(kind)).alias("rank"), F.length(gap).alias("gap"), F.length(s["m"]).alias("size"), (F.length(s["g"]) >= (least[1] if least else 0)).alias("counts")),
    )
    return F.when(hint, found).otherwise(F.array().cast("array<struct<rank:int,gap:int,size:int,counts:boolean>>"))


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id and spans, an array of (start, rank, end) by start and kind, for each row."""
    scratch = Scratch(docs.sparkSession)
    t = F.col("__text")
    widths = F.concat(
        _widths(t, ASSIGN, "assign", t.rlike(ASSIGN_HINT), (2, 6)), _widths(t, ACCESS, "access", t.contains("AKIA")), _widths(t, HEX, "hex", t.rlike(HEX)),
        _widths(t, IDENTIFIER, "identifier", t.rlike(IDENTIFIER_HINT)), _widths(t, KEY, "key", t.rlike(KEY)), _widths(t, ENDPOINT, "endpoint", t.contains("://")),
    )
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    rows = scratch.save(texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", widths.alias("widths")), "widths")
    order = Window.partitionBy("row", "rank").orderBy("pos")
    each = rows.filter(F.size("widths") > 0).select("row", F.posexplode("widths").alias("pos", "w")).select("row", "pos", "w.*")
    parts = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(order).cast("int")).filter("counts").select("row", (F.col("end") - F.col("size")).alias("start"), "rank", "end")
    weak = KINDS.index("identifier")
    kept = parts.filter(F.col("rank") < weak).unionByName(linked(parts.filter(F.col("rank") >= weak), parts, scope))
    by_row = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "rank", "end"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return rows.select("row", "doc_id").join(by_row, "row", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def linked(weak: DataFrame, parts: DataFrame, scope: int) -> DataFrame:
    """The weak parts with a complement at most scope characters before or behind them: an interval join by cells."""
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope)))
    around = parts.select(F.col("row").alias("o_row"), cells(F.col("start") - scope, F.col("end") + scope).alias("o_cell"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.col("rank").alias("o_rank"))
    fits = F.lit(False)
    for kind, others in COMPLEMENT.items():
        fits = fits | ((F.col("rank") == KINDS.index(kind)) & F.col("o_rank").isin(*map(KINDS.index, others)))
    gap = F.greatest(F.col("o_start") - F.col("end"), F.col("start") - F.col("o_end"))
    at = weak.withColumn("cell", cells(F.col("start"), F.col("end")))
    return at.join(around, (F.col("row") == F.col("o_row")) & (F.col("cell") == F.col("o_cell")) & gap.between(0, scope) & fits, "left_semi").drop("cell").distinct()


def _listed(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"], s["end"])), ",")


def digests(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The op5 contract's columns."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["rank"] < KINDS.index("identifier"))
    return scan(docs, scope).select("doc_id", *map(count, KINDS[:3]), F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), *map(count, KINDS[3:]))
