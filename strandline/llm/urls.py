"""URL filter: rules by host and path first, then a list of canonical URLs behind a blocked Bloom filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
TRACKING = r"(?s)&(?:utm_[^=&#]*|ref)=[^&#]*"  # parameters that do not change the page
BITS_PER_URL = 16
BLOCK_BITS = 256  # four longs; eight bits of them per URL
BROADCAST_BYTES = 16 << 20


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical_of(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without ``.html`` and closing slashes, query without tracking; no scheme, no fragment."""
    host = F.regexp_replace(host_of(url), r"^(?:www|m)\.", "")
    path = F.regexp_replace(path_of(url), r"(?:\.html)?/*$", "")
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    query = F.substring(F.regexp_replace(F.concat(F.lit("&"), query), TRACKING, ""), 2, 1 << 30)
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (``host/path`` text) and its verdict; both null where none fits. ``rules`` is a short list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is asked last, so it stands outermost
        at, _, start = text.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _marks(url: Column) -> list[Column]:
    """The eight bits of a URL inside its block, as four longs: each byte of a second hash names one bit."""
    second = F.xxhash64(url, F.lit("bits"))
    places = [F.shiftrightunsigned(second, 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(8)]
    words = []
    for w in range(BLOCK_BITS // 64):
        word = F.lit(0).cast("long")
        for p in places:
            one = F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(F.lit(63)))
            word = word.bitwiseOR(F.when(F.shiftright(p, 6) == w, one).otherwise(F.lit(0).cast("long")))
        words.append(word)
    return words


def bloom_table(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """The filter as a table of blocks: (block, w0, w1, w2, w3), built by a bitwise OR that combines before the shuffle."""
    block = F.pmod(F.xxhash64(url), F.lit(blocks)).alias("block")
    marked = listed.select(block, *[m.alias(f"w{i}") for i, m in enumerate(_marks(F.col(url)))])
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(BLOCK_BITS // 64)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str]], url: str = "url") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``: the rule's, else block for listed URLs and allow for the rest.

    ``listed`` has a column ``canonical``. Its Bloom filter lets most pages pass without a look at the list: only possible hits
    go into the exact join, which removes the false ones. The filter holds about two bytes per listed URL; it is broadcast only
    while that is under ``BROADCAST_BYTES`` and joined by block beyond.

    A null URL, or one without ``://``, has an empty host and path, fits no rule and is never listed. Repeated rows are judged
    each; columns of ``pages`` named like the new ones are replaced; empty tables are allowed on both sides.
    """
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    listed = listed.select(F.col("canonical").alias("_listed")).filter("_listed <> ''").distinct()
    blocks = max(1, -(-listed.count() * BITS_PER_URL // BLOCK_BITS))
    bloom = bloom_table(listed, "_listed", blocks).select(F.col("block").alias("_block"), *[F.col(f"w{i}").alias(f"_w{i}") for i in range(4)])
    if blocks * (BLOCK_BITS // 8 + 8) <= BROADCAST_BYTES:
        bloom = F.broadcast(bloom)

    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    seen = pages.select(row.alias("_row"), host_of(F.col(url)).alias("_host"), path_of(F.col(url)).alias("_path"), canonical_of(F.col(url)).alias("_canonical"))
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    seen = seen.select("*", rule.alias("_rule"), verdict.alias("_verdict"))
    asked = seen.filter("_verdict is null and _host <> ''")
    asked = asked.withColumn("_block", F.pmod(F.xxhash64("_canonical"), F.lit(blocks))).join(bloom, "_block", "left")
    passes = F.lit(True)
    for i, mark in enumerate(_marks(F.col("_canonical"))):
        passes = passes & (F.coalesce(F.col(f"_w{i}"), F.lit(0)).bitwiseAND(mark) == mark)
    base = ["_row", "_host", "_path", "_canonical", "_rule"]
    asked = asked.withColumn("_possible", passes)
    judged = seen.filter("_verdict is not null or _host = ''").select(*base, F.coalesce("_verdict", F.lit("allow")).alias("_verdict"))
    clear = asked.filter(~F.col("_possible")).select(*base, F.lit("allow").alias("_verdict"))
    exact = asked.filter("_possible").select(*base).join(listed, F.col("_canonical") == F.col("_listed"), "left")
    exact = exact.select(*base, F.when(F.col("_listed").isNotNull(), "block").otherwise("allow").alias("_verdict"))
    return judged.unionByName(clear).unionByName(exact).select(
        *[F.col(f"_row.`{c}`").alias(c) for c in rest], F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_rule").alias("rule"), F.col("_verdict").alias("verdict"),
    )
