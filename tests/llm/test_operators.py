"""Each operator against brute force, an exact round trip or its law, with nulls, empty and long texts, ties and clashing columns."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from strandline.llm import bpe, flac, mixing, queries, repair, sharding, simhash, sketch, suffixes, toxicity, urls
from tests.compare import connect, difference

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, source string, shard string, size string"
PASSAGE = "".join(random.Random(5).choices("abcdefgh ", k=260))
ROWS = [
    (1, "The quick brown fox. " + PASSAGE, "a", "x", "y"), (2, "Other start " + PASSAGE + " other end", "a", "x", "y"), (3, None, None, None, None),
    (4, "", "b", "x", "y"), (None, "no id here " + PASSAGE[:150], "b", "x", "y"), (5, "é" * 700 + " ñandú 日本", "c", "x", "y"),
    (6, "same text", "a", "x", "y"), (7, "same text", "a", "x", "y"), (7, "same text", "a", "x", "y"), (8, "word " * 30_000, "c", "x", "y"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    assert difference(spark, connect(SF), queries.QUERIES[name], queries.ORACLES[name], SF) is None


def test_sharding(docs, empty):
    out = sharding.interleave(docs, 3).collect()
    assert len(out) == len(ROWS) and "shard" in out[0].asDict()
    for shard in range(3):
        slots = sorted(r["slot"] for r in out if r["shard"] == shard)
        assert slots == list(range(len(slots))) and len(slots) in (3, 4)
    assert sharding.interleave(empty, 3).count() == 0


def test_sharding_keeps_the_mixture(spark):
    out = sharding.interleave(spark.range(4000).selectExpr("id as doc_id", "if(id % 4 < 3, 'hot', 'rare') as source"), 8).collect()
    for shard in range(8):
        mine = [r["source"] for r in out if r["shard"] == shard]
        assert len(mine) == 500 and abs(mine.count("rare") - 125) <= 2


def test_urls(spark):
    pages = spark.createDataFrame(
        [(1, "http://A.example.org/es/1", "old"), (2, "https://www.bad.net/x.html?utm_source=a#f", "old"), (3, None, None), (4, "no scheme", "v"), (5, "http://bad.net/y", "v"), (5, "http://bad.net/y", "v")],
        "page_id long, url string, verdict string",
    )
    listed = spark.createDataFrame([("bad.net/x",), ("bad.net/x",), (None,)], "canonical string")
    out = {(r["page_id"]): (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages, listed, queries.RULES).collect()}
    assert out[1] == ("a.example.org", "/es/1", "example.org/es/", "block") and out[2][3] == "block"
    assert out[3] == out[4] == ("", "", None, "allow") and out[5][3] == "allow"
    assert urls.filter_urls(pages, listed, queries.RULES).count() == 6 and urls.filter_urls(pages, listed.limit(0), ()).filter("verdict = 'block'").count() == 0


def test_bpe_equals_the_library(docs, empty):
    file = public_tokenizers.path(queries.RANK_FILE)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(file, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    ids = bpe.encode(docs, file, public_tokenizers.PATTERN)
    back = bpe.decode(ids, file, public_tokenizers.PATTERN).collect()
    for r in back:
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["bytes"]) == (r["text"] or "").encode()
    for r in bpe.digests(docs, file, public_tokenizers.PATTERN).collect():
        texts = [t for d, t, *_ in ROWS if d == r["doc_id"]]
        want = library.encode_ordinary(texts[0] or "")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(want), hashlib.sha256(",".join(map(str, want)).encode()).hexdigest())
    assert bpe.encode(empty, file, public_tokenizers.PATTERN).count() == 0
    codec = bpe.Codec.of(open(file, "rb").read(), public_tokenizers.PATTERN)
    rng = random.Random(1)
    hard = ["a" * 4000, "ab" * 900, "".join(rng.choice("aeinrst") for _ in range(2500)), "\x00\x1f <|endoftext|> it's 123456", "!?" * 400]
    assert codec.encode(hard) == [library.encode_ordinary(t) for t in hard]


def test_mixing(docs, empty, spark):
    out = mixing.mix(docs).collect()
    assert len(out) == len(ROWS) and all(r["taken"] <= 3 * r["size"] for r in out)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(docs).collect()))
    assert mixing.mix(empty).count() == 0
    big = spark.range(6000).selectExpr("id as doc_id", "concat('s', id % 5) as source", "repeat('w ', cast(1 + id % 97 as int)) as text")
    sums = mixing.mix(big).groupBy("source").agg({"taken": "sum", "target": "max", "source_size": "max"}).collect()
    assert all(abs(r["sum(taken)"] - r["max(target)"]) <= 2 and r["max(target)"] <= 3 * r["max(source_size)"] for r in sums)
    assert abs(sum(r["max(target)"] for r in sums) - sum(r["max(source_size)"] for r in sums)) < 1e-6


def _bits(fields):
    text = "".join(f"{v & ((1 << w) - 1):0{w}b}" if w else "0" * v + "1" for v, w in fields)
    return bytes(int(text[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(text), 8))


def test_flac_linear_prediction_partitions_and_escapes():
    """A hand-made LPC subframe: order 2, shift 1, two partitions of which the second is escaped, one wasted bit."""
    block, wasted = 32, 1
    x = [3, 5]
    residual = [((i * 7) % 5) - 2 for i in range(block - 2)]
    for r in residual:
        x.append(r + ((3 * x[-1] - x[-2]) >> 1))
        x[-1] = max(-60, min(60, x[-1]))
    residual = [x[i] - ((3 * x[i - 1] - x[i - 2]) >> 1) for i in range(2, block)]
    fields = [((33 << 1) | 1, 8), (wasted - 1, 0), (x[0], 7), (x[1], 7), (3, 4), (1, 5), (3, 4), (-1, 4), (0, 2), (1, 4), (2, 4)]
    for r in residual[:14]:
        code = (r << 1) ^ (r >> 31)
        fields += [(code >> 2, 0), (code, 2)]
    fields += [(15, 4), (9, 5)] + [(r, 9) for r in residual[14:]]
    raw = np.frombuffer(_bits(fields), np.uint8)
    samples, end = flac.decode_subframes(flac.Bits.over(raw), np.array([0]), block)
    assert samples[0].tolist() == [v << 1 for v in x] and end[0] == len(raw)


def test_flac_round_trip(docs, empty):
    out = flac.read_media(flac.write_media(docs)).collect()
    assert all(bytes(r["payload"]) == flac.payload_of(r["text"]) for r in out) and len(out) == len(ROWS)
    blocks = flac.pcm_blocks(flac.write_media(docs), frames=2).filter("doc_id = 8").orderBy("first_sample").collect()
    assert b"".join(bytes(r["pcm"]) for r in blocks) == flac.payload_of(ROWS[-1][1]) and blocks[1]["first_sample"] == 2 * flac.BLOCK
    assert flac.digests(empty).count() == 0
    noise = np.random.default_rng(3).bytes(576 * 5)
    stream = flac.encode_payloads([noise])[0]
    assert flac.decode_streams([stream]) == [noise]
    at = stream.index(b"\x83")
    plain = stream[: at - 38] + b"\x80" + stream[at - 37 : at] + stream[at + 4 + 18 * 5 :]  # no seek table: frame after frame
    assert flac.decode_streams([plain]) == [noise]
    for i in (len(stream) - 1, len(stream) - 300):
        with pytest.raises(ValueError):
            flac.decode_streams([stream[:i] + bytes([stream[i] ^ 1]) + stream[i + 1 :]])


def test_simhash_links_equal_brute_force(spark):
    rng = random.Random(7)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for base in list(prints)[:20]:
        for _ in range(12):
            prints.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]

    def root(parent, v):
        while parent[v] != v:
            v = parent[v]
        return v

    want = {s: s for s in signed}
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                x, y = root(want, signed[i]), root(want, signed[j])
                want[max(x, y)] = min(x, y)
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))).collect()}
    assert all(found.get(s, s) == root(want, s) for s in signed) and len(found) > 100


def test_simhash_documents(docs, empty):
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(ROWS) and {r["fp"] for r in out if r["doc_id"] in (3, 4)} == {0}
    assert {r["component_id"] for r in out if r["doc_id"] in (6, 7)} == {6}
    kept = [r["doc_id"] for r in simhash.keep_one(docs).collect()]
    assert 6 in kept and 7 not in kept and kept.count(3) == 1 and 4 not in kept
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_suffixes_equal_brute_force(spark, docs, empty):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcd ") for _ in range(rng.randint(120, 600))) for _ in range(12)]
    texts = []
    for i in range(60):
        a, b = rng.choice(base), rng.choice(base)
        texts.append(a[rng.randint(0, 40) :] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 5))) + b[: rng.randint(80, 300)])
    texts += ["q" * 450, "ab" * 200, texts[0], "é" * 150]
    want = suffixes.brute_force([(i, t.encode()) for i, t in enumerate(texts)])
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in suffixes.remove_repeats(frame).collect():
        assert [(s["start"], s["end"]) for s in r["spans"]] == want[r["doc_id"]], r["doc_id"]
    out = suffixes.remove_repeats(docs).collect()
    assert len(out) == len(ROWS) and suffixes.remove_repeats(empty).count() == 0
    first = next(r for r in out if r["doc_id"] == 1)
    assert len(first["spans"]) == 1  # the row without an id comes first, so its passage is the earlier one
    assert next(r for r in out if r["doc_id"] is None)["spans"] == []


def test_suffixes_hot_anchor(spark, monkeypatch):
    """Anchors with more pieces than a chunk holds take the path over window bytes, with the same result."""
    monkeypatch.setattr(suffixes, "HOT", 8)
    rng = random.Random(2)
    tail = lambda n: "".join(rng.choice("klmnop") for _ in range(n))
    texts = [tail(rng.randint(0, 90)) + PASSAGE[:130] + tail(rng.randint(0, 90)) for _ in range(80)]
    want = suffixes.brute_force([(i, t.encode()) for i, t in enumerate(texts)])
    out = suffixes.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all([(s["start"], s["end"]) for s in r["spans"]] == want[r["doc_id"]] for r in out)


def test_suffix_pieces_survive_collisions(spark, monkeypatch):
    """Pieces of one anchor whose content hashes are all equal are told apart by their bytes, in a batch and between tasks."""
    real = suffixes.pieces_of

    def weak(data):
        start, more, anchors, *contents = real(data)
        return (start, more, anchors, *[np.zeros_like(c) for c in contents])

    monkeypatch.setattr(suffixes, "pieces_of", weak)
    rng = random.Random(8)
    tail = lambda n: "".join(rng.choice("klmnop") for _ in range(n))
    texts = [tail(rng.randint(80, 120)) + PASSAGE[:n] + tail(rng.randint(80, 120)) for n in (60, 130) for _ in range(30)]
    texts += texts[:5]
    want = suffixes.brute_force([(i, t.encode()) for i, t in enumerate(texts)])
    for parts in (1, 6):
        frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(parts, "doc_id")
        assert {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in suffixes.remove_repeats(frame).collect()} == want


def test_suffix_sort_survives_collisions(monkeypatch):
    data = np.frombuffer((PASSAGE[:200] + PASSAGE[:150] + "z" * 120).encode(), np.uint8)
    at = np.arange(len(data) - 99)
    monkeypatch.setattr(suffixes.Prefixes, "of", lambda self, start, length: np.zeros(len(np.atleast_1d(start)), np.uint64))
    got = suffixes.repeated(data, at, np.zeros(len(at), int), at)
    seen, want = set(), []
    for s in at:
        w = data[s : s + 100].tobytes()
        want.append(w in seen)
        seen.add(w)
    assert got.tolist() == want


def test_repair_files(docs, empty):
    file = public_tokenizers.path(queries.WORD_FILE)
    library = Tokenizer.from_file(file)
    shards = repair.write_shards(docs, file)
    read = repair.read_shards(shards).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    start = 0
    for r, (d, t, *_) in zip(sorted(read, key=lambda r: r["start"]), order):
        want = library.encode(t or "", add_special_tokens=False).ids + [1]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"]) == (d, start, len(want), want)
        start += len(want)
    shard = repair.Shard(bytes(shards.orderBy("part").first()["payload"]))
    assert shard.document(0).tolist() == shard.ids()[shard.id_at[0] : shard.id_at[1]].tolist()
    crc = {r["start"]: r["ids_crc32"] for r in repair.digests(repair.read_shards(shards)).collect()}
    assert all(crc[r["start"]] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in read)
    assert repair.read_shards(repair.write_shards(empty, file)).count() == 0
    words = repair.Words.of(open(file, "rb").read())
    hard = ["A\xa0B\x1cC", "it's 12.5 (Foo) Straße ﬁ İx é don't", "<|startoftext|> <|endoftext|>", "x" * 3000, "ªº µ"]
    assert [np.frombuffer(b, "<u4").tolist() for b in words.encode(hard)] == [library.encode(t, add_special_tokens=False).ids for t in hard]
    ids = np.random.default_rng(1).integers(0, 9, 20_000)
    symbols, rules = repair.compress(ids, words.size)
    assert (repair.expand(symbols.astype(np.int64), repair.expansions(rules, words.size)) == ids).all() and len(symbols) < 0.7 * len(ids)


def test_sketch(docs, empty):
    out = sketch.compare_edited(docs, ranges=3).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [r[1] or "" for r in order]
    want = sorted((r[0] or -1, len(t), hashlib.sha256(sketch.edited_text(t, texts[(i + 1) % len(texts)]).encode()).hexdigest()) for i, (r, t) in enumerate(zip(order, texts)))
    assert sorted((r["doc_id"] or -1, r["n_chars"], r["edited_sha256"]) for r in out) == want
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in out) and sketch.compare_edited(empty).count() == 0
    rng = random.Random(4)
    words = [str(rng.randint(0, 10**6)).encode() for _ in range(6000)]
    small, large = sketch.sketch(sketch.hashes(words[:800])), sketch.sketch(sketch.hashes(words))
    assert sketch.containment(small, large) == 1 and abs(sketch.likeness(small, large) - 800 / 6000) < 0.05
    assert (sketch.merged(small, large) == large).all() and (sketch.read(sketch.shown(large)) == large).all()


def test_toxicity(spark, empty):
    rng = random.Random(9)
    clean = lambda n: " ".join(rng.choice(["water", "garden", "stone", "paper", "window", "river", "light"]) for _ in range(n))
    rows = [(i, clean(20) + (" you idiot and moron" if i % 5 == 0 else "")) for i in range(400)] + [(400, None), (401, ""), (402, clean(9000)), (403, "you 1d10t and m0r0n"), (404, "you i d i o t and mooooron")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    scorer = toxicity.fit(docs, labels)
    score = {r["doc_id"]: r["score"] for r in toxicity.with_scores(docs, scorer).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all((score[i] >= 0.3) == (i % 5 == 0) for i in held)
    assert score[403] > 0.3 and score[404] > 0.3 and score[400] == score[401] < 0.3 and score[402] < 0.3
    assert toxicity.with_scores(empty, toxicity.fit(empty, labels.limit(0))).count() == 0
    assert toxicity.restore("1d10t", scorer.letters) == "idiot"
    spaced = "".join(scorer.restored("".join(toxicity.words_of(" ".join("stone" * 40)) - set("stone"))))
    assert len(spaced) == 200  # a long run of single characters is restored to its end


@pytest.fixture(scope="module")
def insulting(spark):
    """A scorer over words of which some are toxic."""
    rng = random.Random(10)
    bad = ["idiot", "moron", "shit", "trash", "loser", "ass", "stupid"]
    mild = ["water", "garden", "stone", "paper", "such", "you", "are", "a", "river", "light", "the"]
    rows = [(i, " ".join([rng.choice(mild) for _ in range(20)] + ([rng.choice(bad)] if i % 3 == 0 else []))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return toxicity.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)], "doc_id long, toxic int"))


@pytest.mark.parametrize("noisy, word", [("1d10t", "idiot"), ("1d1ot", "idiot"), ("$h1t", "shit"), ("7r45h", "trash"), ("+r@sh", "trash"), ("1055er", "loser"), ("a$$", "ass"), ("idio+", "idiot"), ("(1d10t!!)", "idiot"), ("a$$!", "ass"), ("moooron", "moron")])
def test_toxicity_reads_signs_at_the_edges(insulting, noisy, word):
    assert word in insulting.weights and word in insulting.features(f"the {noisy} water")
    assert insulting.score(f"the {noisy} water") > 0.3 > insulting.score("the 1st water, 100m wow! stone")


@pytest.mark.parametrize("words", ["such a stupid", "you are a moron", "the idiot", "you are such a loser river " * 6 + "trash"])
def test_toxicity_cuts_drawn_apart_letters_into_words(insulting, words):
    bad = words.split()[-1]
    drawn, dotted = " ".join(words.replace(" ", "")), ".".join(words.replace(" ", ""))
    for text in (drawn, "water " + drawn + " stone", dotted):
        assert set(words.split()) <= insulting.features(text) and insulting.score(text) > 0.3, bad
    run = "".join(words.split())
    assert "".join(toxicity.restore_words(run, insulting.letters)) == run  # no letter is read twice or left out
    assert insulting.score(" ".join("thewaterpaper")) < 0.3


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(2, 0), (5, 0), (6, 0)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s, *_ in ROWS], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def planted_copies():
    """Groups of texts with one word changed to a five-word Jaccard just over and under 0.8, chains, and a dense group."""
    rng = random.Random(21)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, texts = fresh(30), []
    for n in (40, 48, 49, 60, 90, 100, 130):
        base = fresh(n)
        for edits in range(1, 4):  # each takes five shingles off either side
            words = list(base)
            for i in range(edits):
                words[10 + 12 * i] = "edited"
            texts += [" ".join(words), " ".join(base)]
        texts += [" ".join(base[5:]), " ".join(base[10:]), " ".join(base[15:])]
    dense = fresh(150)
    for i in range(40):
        texts.append(" ".join([*dense[:i], f"x{i}", *dense[i + 1 :], f"y{i}"]))
    texts += [" ".join(fresh(20) + passage + fresh(20)) for _ in range(20)]
    rng.shuffle(texts)
    return texts + ["", "  ", "One two", "one  TWO", "one three"]


def components_by_force(texts):
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and simhash.jaccard(texts[i], texts[j]) >= 0.8:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def test_near_copies_equal_brute_force(spark):
    texts = planted_copies()
    want = components_by_force(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in simhash.near_copies(frame).collect()} == dict(enumerate(want))
    assert sorted(r["doc_id"] for r in simhash.keep_one(frame).collect()) == sorted(set(want))
    near = [simhash.jaccard(a, b) for i, a in enumerate(texts) for b in texts[:i] if a != b]
    assert any(0.8 <= x < 0.82 for x in near) and any(0.77 < x < 0.8 for x in near)


def test_toxicity_learns_every_label(spark):
    """One word decides, and each row has words of its own besides: nine thousand labelled rows all count."""
    n = 12_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat(IF(id % 4 = 0, 'vilewort ', 'kindword '), 'plain text') AS text")
    labels = spark.range(n).selectExpr("id AS doc_id", "CAST(id % 4 = 0 AS INT) AS toxic")
    trained = labels.filter(toxicity.trainable("doc_id"))
    total, bad = trained.count(), trained.filter("toxic = 1").count()
    seen = {}
    fitted = toxicity._logistic
    try:
        toxicity._logistic = lambda alike, names, *rest: seen.update({r["y"]: seen.get(r["y"], 0) + r["n"] for r in alike.collect()}) or fitted(alike, names, *rest)
        scorer = toxicity.fit(docs, labels)
    finally:
        toxicity._logistic = fitted
    assert total > 8000 and seen == {0: total - bad, 1: bad}
    scores = {r["text"][0]: r["score"] for r in toxicity.with_scores(docs.limit(40), scorer).collect()}
    assert scores["v"] > 0.9 and scores["k"] < 0.1


def test_op7_features_of_a_word_are_made_once(monkeypatch):
    """Words that come again in other texts cost nothing, and what is kept for them is bounded."""
    import numpy as np

    from strandline.llm import toxicity

    made, shown = [], toxicity.Scorer.shown
    monkeypatch.setattr(toxicity.Scorer, "shown", lambda self, w: made.append(w) or shown(self, w))
    scorer, met = toxicity.Scorer(np.zeros((28, 28, 28), np.float32)), {}
    texts = ["some b4d words", "b4d words again", None, "words some b4d"]
    kept = [scorer.features(t, met) for t in texts]
    assert sorted(made) == ["again", "b4d", "some", "words"]
    assert kept == [scorer.features(t) for t in texts]
    monkeypatch.setattr(toxicity, "MET", 3)
    scorer.features("other", met)
    assert set(met) == {"other"}
