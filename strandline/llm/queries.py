"""The registered query of each operator over its whole table, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import bpe, flac, mixing, periodic, quotient, repair, sharding, simhash, sketch, suffixes, toxicity, trie, urls
from strandline.llm.common import SPACE, table, written
from strandline.sequence import Sequence, with_position

SHARDS = 40
RANK_FILE, WORD_FILE = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
BAD_LABELS = ("spam-farm", "free-bets", "cheap-pills", "adult-x")  # fixed values: host labels whose pages are listed


def op1_shard_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    slim = docs.select(
        "doc_id", "source", (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = sharding.interleave(slim, SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def listed_urls(pages: DataFrame) -> DataFrame:
    """Canonical URLs of the pages whose host has a listed label."""
    labels = F.split(urls.host_of(F.col("url")), r"\.")
    return pages.filter(F.arrays_overlap(labels, F.array(*[F.lit(x) for x in BAD_LABELS]))).select(urls.canonical_of(F.col("url")).alias("canonical"))


def op2_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return urls.filter_urls(pages, listed_urls(pages), RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op5_flac_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    scored = toxicity.with_scores(docs, toxicity.fit(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))
    return scored.select("doc_id", (~toxicity.trainable()).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest_columns(suffixes.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")))


def op9_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return repair.digests(repair.read_shards(repair.write_shards(docs, public_tokenizers.path(WORD_FILE))))


def op10_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compare_edited(table(spark, sf_dir, "documents", "doc_id", "text"))


def with_planted_period(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, by crc32 of the id, the words from one place on repeat the first few from there."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def period(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(w, place(i).cast("int")))

    words = F.regexp_extract_all("text", F.lit(f"({SPACE})"), F.lit(1))
    planted = F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, F.array_join(period(w), " ")).otherwise(F.lit("")))  # words are found once
    return docs.select("doc_id", F.when(h % 10 == 0, F.get(planted, 0)).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.with_runs(with_planted_period(table(spark, sf_dir, "documents", "doc_id", "text")))
    steeper = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    best = found.withColumn("best", F.aggregate("runs", F.get("runs", 0), steeper))
    shown = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(shown, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_quotient_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotient.exact_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def rebuilt_turns(conversations: DataFrame) -> DataFrame:
    """(conv, at, a, b, bytes): each conversation begins with some first turns of the one whose id is the last multiple of five.

    Turns without a conversation id belong to none. Turns of equal number are ordered by the hashes of what they say. Texts stay where
    they are: only hashes and sizes move.
    """
    said = [F.coalesce(c, F.lit("")) for c in ("role", "text")]
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.xxhash64(*said).alias("a"), F.xxhash64(F.lit("second"), *said).alias("b"), F.octet_length(said[1]).cast("long").alias("bytes"),
    )
    placed = written(with_position(turns, Sequence(("conv",), ("turn", "a", "b"), bucket="turn div 4096"), "pos").select("conv", "pos", "a", "b", "bytes"), "conversation-turns")
    sizes = placed.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    h = (F.crc32(F.col("conv").cast("string").cast("binary")) % 9).alias("h")
    base = (F.col("conv") - F.col("conv") % 5).alias("base")
    convs = sizes.select("conv", h, base).join(sizes.select(F.col("conv").alias("base"), F.col("n").alias("there")), "base", "left")
    convs = written(convs.select("conv", "base", "h", F.least("h", F.coalesce("there", F.lit(0).cast("long"))).alias("lent")), "conversation-ids")
    first = placed.filter("pos < 8").withColumnRenamed("conv", "base")
    lent = first.join(convs.select("conv", "base", "h"), "base").filter("pos < h").select("conv", (F.col("pos") + 1).alias("at"), "a", "b", "bytes")
    own = placed.join(convs.select("conv", "h", "lent"), "conv").filter("pos >= h").select("conv", (F.col("lent") + F.col("pos") - F.col("h") + 1).alias("at"), "a", "b", "bytes")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv", *[zero.alias(c) for c in ("at", "a", "b", "bytes")])
    return lent.unionByName(own).unionByName(roots)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(rebuilt_turns(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_shard_interleaved, op2_filter_urls, op3_byte_bpe, op4_mix_sources, op5_flac_media, op6_simhash_pigeonring, op7_toxicity,
        op8_suffix_dedup, op9_repair_shards, op10_scaled_sketch, op11_periodic_runs, op12_quotient_dedup, op13_prefix_trie, pipeline,
    )
}

ORACLES: dict[str, str] = {}

ORACLES["op2_filter_urls"] = r"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1, 's'), '') AS query
  FROM pages
), canon AS (
  SELECT *, regexp_replace(host, '^(?:www|m)\.', '') || regexp_replace(path, '(?:\.html)?/*$', '') ||
    CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical
  FROM (SELECT *, substr(regexp_replace('&' || query, '&(?:utm_[^=&#]*|ref)=[^&#]*', '', 'g'), 2) AS q FROM parts)
), listed AS (
  SELECT DISTINCT canonical FROM canon
  WHERE list_has_any(string_split(host, '.'), ['spam-farm', 'free-bets', 'cheap-pills', 'adult-x']) AND canonical <> ''
), rules(says, dom, beg, rule) AS (
  VALUES ('allow', 'org', '/', 'org/'), ('block', 'example.org', '/es/', 'example.org/es/'), ('block', 'example.org', '/en/1', 'example.org/en/1'),
         ('allow', 'com', '/fr/', 'com/fr/'), ('block', 'com', '/de/', 'com/de/')
), fit AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(r.says, length(rule)) AS verdict
  FROM canon JOIN rules r ON (host = dom OR ends_with(host, '.' || dom)) AND starts_with(path, beg) GROUP BY page_id
)
SELECT c.page_id, c.host, c.path, f.rule,
       coalesce(f.verdict, CASE WHEN l.canonical IS NOT NULL AND c.host <> '' THEN 'block' ELSE 'allow' END) AS verdict
FROM canon c LEFT JOIN fit f USING (page_id) LEFT JOIN listed l ON c.canonical = l.canonical
"""

_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT"

ORACLES["op4_mix_sources"] = rf"""
WITH docs AS (
  SELECT doc_id, {_WORDS} AS size, coalesce('0' || source, '1') AS s,
         (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656::DOUBLE AS u
  FROM documents
), src AS (
  SELECT s, sum(size)::BIGINT AS source_size, count(*) AS docs, [5, 2, 1][((row_number() OVER (ORDER BY s) - 1) % 3 + 1)::INT] AS w FROM docs GROUP BY s
), filled AS (
  SELECT *, 3 * source_size AS cap,
    coalesce(sum(3 * source_size) OVER o, 0) AS full_cap, coalesce(sum(w) OVER o, 0) AS full_w, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w
  FROM src WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / w, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT *, max((total - full_cap)::DOUBLE / (all_w - full_w)::DOUBLE) OVER () AS l FROM filled
), plan AS (
  SELECT s, source_size, docs, target, whole, part, target - whole * source_size AS want, source_size::DOUBLE / docs AS mean
  FROM (SELECT *, floor(ratio) AS whole, ratio - floor(ratio) AS part
        FROM (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS ratio FROM (SELECT *, least(cap::DOUBLE, l * w) AS target FROM level)))
), placed AS (
  SELECT d.doc_id, d.size, p.*,
    CASE WHEN size > 0 AND part > 0 THEN u / (u + (1 - u) * (part / (1 - part) * sqrt(size / mean))) ELSE 1 END AS v
  FROM docs d JOIN plan p USING (s)
), summed AS (
  SELECT *, sum(size) OVER (PARTITION BY s ORDER BY v RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed
), chosen AS (SELECT *, part > 0 AND upto <= want AS inside FROM summed
), miss AS (SELECT s, any_value(want) - coalesce(sum(size) FILTER (inside), 0) AS missing FROM chosen WHERE part > 0 GROUP BY s
), closing AS (
  SELECT s, arg_min(doc_id, (abs(size - missing), v, size, doc_id::VARCHAR)) AS last
  FROM chosen JOIN miss USING (s) WHERE NOT inside AND abs(size - missing) < missing GROUP BY s
)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN inside OR coalesce(doc_id = last, false) THEN 1 ELSE 0 END)::BIGINT * size)::BIGINT AS taken
FROM chosen LEFT JOIN closing USING (s)
"""

ORACLES["op1_shard_interleaved"] = r"""
WITH table256 AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
), docs AS (
  SELECT doc_id, coalesce('0' || source, '1') AS s, coalesce(text, '') AS text, md5('shards:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents
), crc AS (
  SELECT doc_id, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(hexed, ' '), lambda x: ('0x' || x)::BIGINT)),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM (SELECT doc_id, trim(regexp_replace(hex(encode(text)), '(..)', '\1 ', 'g')) AS hexed FROM docs WHERE text <> ''), table256
), ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY s ORDER BY h) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY s))::DOUBLE AS f FROM docs
), placed AS (
  SELECT *, row_number() OVER (ORDER BY f, s, h) - 1 AS p, count(*) OVER () AS n FROM ranked
)
SELECT doc_id, (octet_length(encode(text)) + 16)::BIGINT AS size, coalesce(text_crc32, 0)::BIGINT AS text_crc32, 'rows' AS law, (p * 40 // n)::INTEGER AS shard,
       (p - ((p * 40 // n) * n + 39) // 40)::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM placed LEFT JOIN crc USING (doc_id)
"""

ORACLES["op12_quotient_dedup"] = """
WITH docs AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), groups AS (SELECT t, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size, sha256(t) AS text_sha256 FROM docs GROUP BY t)
SELECT doc_id, keep_id, group_size, coalesce(doc_id = keep_id, keep_id IS NULL) AS kept, text_sha256 FROM docs JOIN groups USING (t)
"""
