"""Each stage of the pipeline, and the whole, against plain versions on a fixture with planted copies, passages and toxic texts."""

import base64
import hashlib
import random
import time
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import common, queries, simhash, suffixes, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def fixture():
    r = random.Random(3)
    vocabulary = ["".join(r.choices("abcdefghiklmnoprstuvw", k=r.randint(3, 9))) for _ in range(3000)]
    words = lambda n: r.choices(vocabulary, k=n)
    passage, rows, labels = words(40), [], []
    for i in range(150):
        rows.append([i, words(r.randint(40, 90)), f"s{i % 3}" if i % 10 else None])
    for i in range(150, 190):  # near copies: one or two words changed, some of them far enough for less than 0.8
        base = list(rows[i - 150][1])
        for _ in range(i % 4):
            base[r.randrange(len(base))] = "changed"
        rows.append([i, base, "s0"])
    for i in range(190, 215):  # a shared passage
        rows.append([i, [*words(30), *passage, *words(30)], "s1"])
    for i in range(215, 275):  # toxic words in otherwise plain texts
        rows.append([i, [*words(30), "moronic", "scumbag", "moronic"], "s2"])
        labels.append((i, 1))
    labels += [(i, 0) for i in range(150)]
    out = [(i, " ".join(w), "en", s, len(" ".join(w))) for i, w, s in rows]
    out += [(300, None, None, None, None), (301, "", None, None, 0), (302, "é" * 300, "fr", "s1", 300), (303, out[0][1].upper(), "en", "s0", 1), (304, out[1][1], "en", None, 5)]
    return out, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = fixture()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def listed(df):
    return sorted(map(tuple, df.collect()), key=str)


def plain_toxicity(spark, folder, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    scorer = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return [x for x in rows if scorer.score(x[1]) < corpus_pipeline.REJECT]


def plain_near(rows):
    """Union of all pairs at 0.8 or more; the smallest id stays."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    grams = [set(simhash._grams((x[1] or "").encode().lower().split())) for x in rows]
    for i, a in enumerate(grams):
        for j, b in enumerate(grams[:i]):
            both = len(a & b)
            if (not a and not b) or (both and 5 * both >= 4 * len(a | b)):
                root[find(i)] = find(j)
    groups = {}
    for i, x in enumerate(rows):
        groups.setdefault(find(i), []).append(x)
    return [min(g, key=lambda x: (x[0] is not None, x[0] or 0)) for g in groups.values()]


def plain_cut(rows):
    spans, out = suffixes.brute_force([(x[0], (x[1] or "").encode()) for x in rows]), []
    for d, t, lang, source, n in rows:
        if not spans[d]:
            out.append((d, t, lang, source, n))
            continue
        raw, at, kept = t.encode(), 0, b""
        for s, e in spans[d]:
            kept, at = kept + raw[at:s], e
        kept = (kept + raw[at:]).decode("utf-8", "ignore")
        if kept:
            out.append((d, kept, lang, source, len(kept)))
    return out


def plain_mix(rows):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    found = con.sql(queries.ORACLES["op4_mix_sources"]).select("doc_id, size, source_size, target, taken").fetchall()
    copies = {d: words // size if size else int(target // whole) if whole else 0 for d, size, whole, target, words in found}  # without words: the certain copies
    return [x for x in rows for _ in range(copies[x[0]])]


def plain_tokens(rows):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(queries.RANK_FILE), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = []
    for d, t, *_ in rows:
        ids = library.encode_ordinary(t or "")
        out.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return out


def test_every_stage_and_the_whole(spark, docs, folder):
    rows = listed(docs)
    plain = [lambda x: plain_toxicity(spark, folder, x), plain_near, plain_cut, plain_mix, plain_tokens]
    kept = []
    for (name, stage), simple in zip(corpus_pipeline.STAGES, plain):
        given = spark.createDataFrame(rows, SCHEMA)
        rows = sorted(simple(rows), key=str)
        assert listed(stage(spark, given, folder)) == rows, name
        kept.append(Counter(x[0] for x in rows))
    assert listed(corpus_pipeline.run(spark, folder)) == rows
    clean, alone, cut, mixed, _ = kept
    assert not [i for i in clean if 215 <= i < 275] and all(clean[i] for i in range(150))  # toxic texts go, clean ones stay
    assert not alone[152] and not alone[303] and not alone[304] and alone[300] + alone[301] == 1  # copies go
    assert all(alone[i] for i in range(190, 215)) and set(cut) == set(alone) and sum(mixed.values()) > 0


def test_clashing_columns_are_kept(spark, docs, folder):
    """Names that the stages use themselves, a map, and a column named row."""
    names = ["_k", "_score", "score", "kept", "spans", "n_bytes", "size", "target", "taken", "copies", "source_size", "row", "copy", "low", "a", "b", "z", "k", "t"]
    wide = docs.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id")).alias(n) for n in names], F.create_map(F.lit("a"), F.col("doc_id")).alias("m"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, folder)
        assert out.columns == wide.columns and out.dtypes == wide.dtypes, name
        wrong = out.filter(F.expr(" OR ".join(f"`{n}` <> concat('{n} ', doc_id)" for n in names)) | (F.col("m")["a"] != F.col("doc_id")))
        assert wrong.isEmpty() and not out.isEmpty(), name


def test_empty_tables(spark, docs, folder):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).isEmpty(), name


def test_no_text_is_lost_by_shared_keys(spark):
    """One row per component, also where components share their smallest key."""
    rows = [(1, "x y z"), (None, "x y z"), (None, "q"), (2, "one two three"), (2, "four five six"), (3, None), (3, ""), (4, "rep rep"), (4, "rep rep")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["text"] or "") for r in kept) == ["", "four five six", "one two three", "q", "rep rep", "x y z"]
    assert {r["text"]: r["doc_id"] for r in kept}["x y z"] is None


def test_texts_that_share_one_hash_stay_apart(spark, monkeypatch):
    """With a first hash that is the same for all, the second one tells the texts apart."""
    rows = spark.createDataFrame([(i, 7, 100 + i // 2, simhash.zstandard.ZstdCompressor().compress(f"text number {i // 2}".encode())) for i in range(8)], "k long, a long, b long, z binary")
    found = simhash._near_components(rows).collect()
    assert len(found) == 4 and len({r["root"] for r in found}) == 4 and sorted(r["low"] for r in found) == [0, 2, 4, 6]


def test_near_stage_links_fingerprints_first(spark, monkeypatch):
    """Texts whose fingerprints differ in up to three bits are paired by the ring; pairs of 0.8 beyond that are found too, and 0.79 stays apart."""
    texts = [t for i in range(12) for t in (" ".join(f"w{i}-{j}" for j in range(200)), " ".join(f"w{i}-{j}" for j in range(200 + i)))]
    prints = [simhash._majority(simhash._shingles(t.encode().split())) for t in texts]
    asked, ring = [], simhash._linked
    monkeypatch.setattr(simhash, "_linked", lambda rows: asked.append(ring(rows)) or asked[-1])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(frame).collect()}
    near = {(i, j) for j, a in enumerate(prints) for i, b in enumerate(prints[:j]) if texts[i] != texts[j] and (a ^ b).bit_count() <= simhash.DIFFER}
    far = {(i, i + 1) for i in range(2, 24, 2)} - near
    name = {simhash.xxhash.xxh64_intdigest(t) - (simhash.xxhash.xxh64_intdigest(t) >> 63 << 64): i for i, t in reversed(list(enumerate(texts)))}
    assert {tuple(sorted((name[r["a"]], name[r["b"]]))) for r in asked[0].collect()} == near and near and far
    assert found == {i: i - i % 2 for i in range(24)}


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (files.apply(i).getName() for i in range(files.size())) if n.startswith("shuffle_") and n.endswith(".data")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    table = common.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "test")
    for _ in range(50):  # files go a little after the write
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before and table.count() == 7 and spark.conf.get(common.CLEANUP, None) in (None, "false")


def test_tables_go_once_nothing_reads_them(spark, docs, folder, tmp_path, monkeypatch):
    """What a stage wrote on its way, and the rows of the stage before, are removed when its own rows stand."""
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    left = lambda: {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    kept = simhash.keep_one(docs)
    assert left() == {"near-stays"} and listed(kept) == sorted(plain_near(docs.collect()), key=str)
    out = corpus_pipeline.run(spark, folder)
    assert left() == {"near-stays", "pipeline-mix_sources"} and out.count() > 0
