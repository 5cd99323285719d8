"""The z-fast trie against plain prefixes, and the query against its contract in plain Python."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from strandline.llm import queries, trie

SCHEMA = "conv_id long, turn long, role string, text string, depth long"


def chain(words):
    """The 16-byte names of all prefixes."""
    out, sofar = [], b"\0" * 16
    for w in words:
        sofar = hashlib.md5(sofar + str(w).encode()).digest()
        out.append(sofar)
    return out


def test_two_fattest():
    for a in range(0, 40):
        for b in range(a + 1, 41):
            assert trie.two_fattest(a, b) == max(range(a + 1, b + 1), key=lambda f: f & -f)


@pytest.mark.parametrize("batch", [1, 5, 1000])
def test_trie_has_every_prefix_once(batch):
    r = random.Random(batch)
    for _ in range(60):
        letters = r.choice([1, 2, 3])
        known = [[r.randrange(letters) for _ in range(r.choice([0, 1, 3, 9, 40]))] for _ in range(r.randint(1, 40))]
        known += [w[: r.randint(0, len(w))] for w in known[:10]]
        built = trie.ZFastTrie()
        for s in range(0, len(known), batch):
            given = {}
            for i, words in enumerate(known[s : s + batch], s):
                ids = b"".join(chain(words))
                path = trie.Path(b"\0" * 16, 0, ids, np.arange(len(words)))
                x, n, total, low = given.get((path.root, ids[-16:]), (path, 0, 0, (i, len(words), 0)))
                given[(path.root, ids[-16:])] = (x, n + 1, total + len(words), min(low, (i, len(words), 0)))
            built.insert(given)
        want = {}
        for i, words in enumerate(known):
            for d in range(len(words) + 1):
                n, total, low = want.get(tuple(words[:d]), (0, 0, i))
                want[tuple(words[:d])] = (n + 1, total + len(words), low)
        got = {}
        for first, last, path, members, total, least in built.expand():
            for d in range(first, last + 1):
                assert path.at(d) not in got
                got[path.at(d)] = (members, total, least[0])
        assert got == {([b"\0" * 16] + chain(w))[-1]: v for w, v in want.items()}


def test_search_takes_few_lookups():
    words = list(range(4000))
    built = trie.ZFastTrie()
    for d in (4000, 3000, 2000, 1000, 1999, 2001):
        ids = b"".join(chain(words[:d]))
        built.insert({(b"\0" * 16, ids[-16:]): (trie.Path(b"\0" * 16, 0, ids, np.arange(d)), 1, d, (d, d, d))})
    built.lookups = 0
    built.locate(trie.Path(b"\0" * 16, 0, b"".join(chain([*words[:2500], "x"])), np.arange(2501)))
    assert built.lookups <= 13


def plain(rows):
    """The query by its contract."""
    original = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            original.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    original = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in original.items()}
    members, ends = {}, {}
    for c, own in original.items():
        h = zlib.crc32(str(c).encode()) % 9
        turns = [*original.get(c - c % 5, [])[:h], *own[h:]]
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        mine = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in mine) or 1
        saved[p] = (len(members[p]) - 1) * len(p[-1][1].encode() if p else b"") + sum(saved[k] for k in mine)
    return sorted(
        (
            (min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p],
             hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
            for p, m in members.items()
        ), key=str,
    )


def run(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/conversations.parquet")
    return sorted(map(tuple, queries.op13_prefix_trie(spark, folder).collect()), key=str)


def test_query_equals_its_contract(spark, tmp_path):
    r = random.Random(7)
    rows = []
    for c in [*range(0, 60), 1000, 10_003, 2**40]:
        for turn in range(r.choice([1, 1, 2, 5, 12])):
            rows.append((c, turn if r.random() > 0.02 else None, r.choice(["user", "assistant", None]), r.choice(["hi", "é", "", None, "long " * 50]), turn))
    rows = list({(c, t): x for x in rows for c, t in [x[:2]]}.values())  # turns of equal number have no order of their own
    rows += [(None, 0, "user", "nobody's", 0)]
    assert run(spark, rows, str(tmp_path)) == plain(rows)


def test_repeated_rows_and_an_empty_table(spark, tmp_path):
    rows = [(5, 0, "user", "twice", 1)] * 2 + [(6, 0, "user", "twice", 1), (7, None, None, None, None)]
    assert run(spark, rows, f"{tmp_path}/some") == plain(rows)
    assert run(spark, [], f"{tmp_path}/none") == []


def test_long_conversations_are_cut(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(trie, "SEGMENT", 4)
    rows = [(c, t, "user", f"turn {t}" if t < 30 - c else f"own {c} {t}", 0) for c in range(20, 28) for t in range(33)]
    assert run(spark, rows, str(tmp_path)) == plain(rows)


def test_query_on_the_small_tables(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(x) for x in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, queries.op13_prefix_trie(spark, sf).collect()), key=str) == plain(rows)
