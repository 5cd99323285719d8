"""Toxicity: texts are restored by a noisy-channel decoder before a word model scores them.

The decoder reads a lattice over the characters of a suspicious span: a digit or sign may stand for a letter, letters may be
drawn apart or repeated. The best path under a trigram model of letters, counted over all documents, is the restored word.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import discard, lean, written

# What a sign may stand for, besides itself.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "*": "aeiou", "€": "e"}
SUBSTITUTE, COLLAPSE, DROP, EDGE = 1.5, 0.7, 12.0, 0.0  # costs in nats: a sign for a letter, a run shortened, a sign left out, a word edge set
LETTERS = 28  # 0 is the edge of a word, 1 to 26 are a to z, 27 any other letter
LONGEST = 64  # characters decoded as one word; longer spans are decoded piece by piece
SIGNS = re.escape("".join(STANDS_FOR))
SPACED = re.compile(rf"(?<![^\W_])(?:[a-z{SIGNS}][ .\-_~]{{1,3}}){{2,}}[a-z{SIGNS}](?![^\W_])")
RUN = re.compile(rf"(?:[^\W\d_]|[{SIGNS}])+")  # letters and signs, those at the edges too
POINTED = "!|*+$@€"  # signs that may also be the punctuation around a word
LEXICON, UNKNOWN = 20_000, (8.0, 3.0)  # words that help to set edges; nats of a word not among them, and of each of its letters
OVERLAP = 24  # characters that pieces of a longer span have in common
WORD = re.compile(r"[^\W\d_]+")
TRIPLE = re.compile(r"([^\W\d_])\1\1")
PREFIXES = (4, 5, 6)
KEPT = 150_000  # words a worker remembers
MET = 10_000  # words whose features a task of the fit keeps


def letter_codes(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.zeros(len(x), np.int64)
    plain = (x >= 97) & (x <= 122)
    codes[plain] = x[plain] - 96
    codes[(x >= 0xAA) & (x != 0xD7) & (x != 0xF7) & ((x < 0x2000) | (x > 0x2BFF))] = 27
    return codes


def letter_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n): letter trigrams over all texts; a task sends one row per trigram it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(LETTERS**3, np.int64)
        for batch in batches:
            joined = "  ".join([t.lower() for t in batch.column(0).to_pylist() if t])
            for s in range(0, len(joined), 1 << 20):  # pieces overlap by two, so no trigram is lost
                c = letter_codes(joined[max(0, s - 2) : s + (1 << 20)])
                if len(c) > 2:
                    total += np.bincount((c[:-2] * LETTERS + c[1:-1]) * LETTERS + c[2:], minlength=len(total))
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met])], names=["gram", "n"])

    return docs.select(text).mapInArrow(lean(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def letter_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Log probability of a letter after two others (28 x 28 x 28), trigrams smoothed by bigrams."""
    counts = np.zeros(LETTERS**3)
    for row in letter_counts(docs, text).collect():  # 28 ** 3 rows at most
        counts[row["gram"]] = row["n"]
    counts = counts.reshape(LETTERS, LETTERS, LETTERS)
    pairs = counts.sum(axis=0) + 0.5
    pairs /= pairs.sum(axis=1, keepdims=True)
    mixed = (counts + 8 * pairs[None]) / (counts.sum(axis=2, keepdims=True) + 8)
    return np.log(mixed).astype(np.float32)


def restore(word: str, model: np.ndarray) -> str:
    """The best letters behind a word of letters and signs, read as one word from edge to edge; callers cut at LONGEST."""
    return _decoded(word, model, None)[0]


def restore_words(run: str, model: np.ndarray) -> list[str]:
    """The words behind characters drawn apart, whose own edges are lost: the best path also sets the edges.

    Of a piece of a long run the words that end near the cut are read again with what follows, so every character is read once.
    """
    words, s = [], 0
    while s < len(run):
        path, ends = _decoded(run[s : s + LONGEST], model, EDGE)
        found, cut = path.split(" "), len(run[s : s + LONGEST])
        if s + LONGEST < len(run) and ends:
            keep = max(1, sum(e <= LONGEST - OVERLAP for e in ends))
            found, cut = found[:keep], ends[keep - 1]
        words += [w for w in found if w]
        s += cut
    return words


def segmented(letters: str, lexicon: dict[str, float]) -> list[str]:
    """The cheapest cut of letters into words; words outside the lexicon cost UNKNOWN. Words of more than OVERLAP letters are cut."""
    n = len(letters)
    best, start = [0.0] + [float("inf")] * n, [0] * (n + 1)
    for e in range(1, n + 1):
        for s in range(max(0, e - OVERLAP), e):
            cost = best[s] + lexicon.get(letters[s:e], UNKNOWN[0] + UNKNOWN[1] * (e - s))
            if cost < best[e]:
                best[e], start[e] = cost, s
    words = []
    while n:
        words.append(letters[start[n] : n])
        n = start[n]
    return words[::-1]


def _decoded(word: str, model: np.ndarray, edge: float | None) -> tuple[str, tuple[int, ...]]:
    """The best path through a word, with a space where it sets an edge (at that cost), and the places of these edges."""
    n = len(word)
    best: list[dict[tuple[int, int], tuple[float, str, tuple[int, ...]]]] = [{} for _ in range(n + 1)]
    best[0][(0, 0)] = (0.0, "", ())
    for i in range(n):
        if edge is not None:
            for (a, b), (cost, path, ends) in list(best[i].items()):
                new = (cost + edge - float(model[a, b, 0]), path + " ", (*ends, i))
                if b and ((b, 0) not in best[i] or new < best[i][(b, 0)]):
                    best[i][(b, 0)] = new
        ch = word[i]
        run = 1
        while i + run < n and word[i + run] == ch:
            run += 1
        options: list[tuple[int, str, float]] = []  # characters read, letters written, cost
        if ch.isalpha():
            options.append((1, ch, 0.0))
            for take in range(2, run + 1):
                options.append((take, ch, COLLAPSE if run > 2 else 3 * COLLAPSE))
        for letter in STANDS_FOR.get(ch, ""):
            for take in range(1, run + 1):
                options.append((take, letter, SUBSTITUTE + (COLLAPSE if take > 1 else 0)))
        if not ch.isalpha():
            options.append((1, "", DROP))
        for (a, b), (cost, path, ends) in best[i].items():
            for take, letters, price in options:
                if letters:
                    c = ord(letters) - 96 if "a" <= letters <= "z" else 27
                    state, total = (b, c), cost + price - float(model[a, b, c])
                else:
                    state, total = (a, b), cost + price
                held = best[i + take].get(state)
                if held is None or (total, path + letters, ends) < held:
                    best[i + take][state] = (total, path + letters, ends)
    last = [(cost - float(model[a, b, 0]), path, ends) for (a, b), (cost, path, ends) in best[n].items()]
    return min(last)[1:] if last else ("", ())


def readings(run: str) -> list[str]:
    """A run of letters and signs as it stands and without the punctuation around it, where there is something to decode."""
    found = dict.fromkeys(b for a in (run, run.lstrip(POINTED)) for b in (a, a.rstrip("!"), a.rstrip(POINTED)))
    return [v for v in found if TRIPLE.search(v) or (any(map(str.isalpha, v)) and not v.isalpha())]


def pieces(span: str) -> list[str]:
    """Pieces of LONGEST characters at most, each beginning in the one before."""
    return [span[i : i + LONGEST] for i in range(0, max(1, len(span) - OVERLAP), LONGEST - OVERLAP)]


@dataclass
class Scorer:
    """Letter model, weights of words and word beginnings, the bias, and the words that place edges."""

    letters: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    lexicon: dict[str, float] = field(default_factory=dict)  # cost of a word by its share of the sample
    clean: set[str] = field(default_factory=set)  # words met that weigh nothing
    telling: dict[str, frozenset[str]] = field(default_factory=dict)  # words met that do, and what they show

    def restored(self, word: str) -> list[str]:
        """What the decoder finds behind the suspicious spans of a word."""
        if word.isalpha() and not TRIPLE.search(word):
            return []
        if word.endswith("\t"):  # characters drawn apart, joined by words_of
            return self.drawn_apart(word[:-1])
        out = [restore(part, self.letters) for m in RUN.finditer(word) for span in readings(m.group()) for part in pieces(span)]
        for m in SPACED.finditer(word):
            out += self.drawn_apart(re.sub(r"[ .\-_~]+", "", m.group()))
        return out

    def drawn_apart(self, run: str) -> list[str]:
        """The words of a run, and a short run as one word too."""
        words = restore_words(run, self.letters)
        if self.lexicon:  # letters alone place edges poorly; known words place them better
            words = segmented("".join(words), self.lexicon)
        return words if len(run) > OVERLAP or len(words) == 1 else [*words, restore(run, self.letters)]

    def shown(self, word: str) -> set[str]:
        """Words and word beginnings that a lower-cased word shows, as it stands and restored."""
        words = [word] if word.isalpha() else WORD.findall(word)
        words += self.restored(word)
        return {*words, *(w[:p] + "~" for w in words for p in PREFIXES if len(w) >= p)}

    def features(self, text: str | None, met: dict[str, set[str]] | None = None) -> set[str]:
        """What all words of a text show; ``met`` keeps it for words that come again."""
        words, met = words_of(text), {} if met is None else met
        if len(met) > MET:
            met.clear()
        for w in words.difference(met):
            met[w] = self.shown(w)
        return set().union(*[met[w] for w in words])

    def score(self, text: str | None) -> float:
        words = words_of(text)
        if len(self.clean) > KEPT:
            self.clean.clear()
        if len(self.telling) > KEPT // 8:
            self.telling.clear()
        for w in words.difference(self.clean).difference(self.telling):
            if found := self.shown(w) & self.weights.keys():
                self.telling[w] = frozenset(found)
            else:
                self.clean.add(w)
        found = set().union(*[self.telling[w] for w in words.difference(self.clean)])
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-z)))


def words_of(text: str | None) -> set[str]:
    """Lower-cased words between white space; three or more single characters in a row are also read as one word."""
    words = (text or "").lower().split()
    single = [i for i, w in enumerate(words) if len(w) == 1]
    found = set(words)
    run: list[int] = []
    for i in [*single, -1]:
        if run and i != run[-1] + 1:
            if len(run) > 2:
                found.add("".join([words[j] for j in run]) + "\t")  # marked, so that it counts as suspicious
            run = []
        run.append(i)
    return found


def trainable(key: str = "doc_id"):
    """Rows whose labels may be learned: crc32 of the key's text is not 2 modulo 4."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4 != 2


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", words: int = 400, least: int = 5) -> Scorer:
    """Letter model over all documents, word model over every row whose label may be learned.

    Words and word beginnings are kept by the likelihood ratio of their document counts, ``words`` at most, and weighted by a
    ridge-penalised logistic regression whose sums are made by the tasks that hold the rows. Without labels, or with labels of
    one kind, the bias alone is learned.
    """
    scorer = Scorer(letter_model(docs, text))
    known = labels.select(F.col(key).alias("_k"), F.col(label).cast("int").alias("_y")).filter(F.col("_k").isNotNull() & F.col("_y").isNotNull())
    known = known.filter(trainable("_k")).groupBy("_k").agg(F.max("_y").alias("_y"))
    # labels grow with the documents, so no side is broadcast, whatever their size
    rows = docs.filter(trainable(key)).select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(known.hint("merge"), "_k").select("_y", "_t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[str, set[str]] = {}
        for batch in batches:
            found = [sorted(scorer.features(t, met)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["y", "found"])

    rows = written(rows.mapInArrow(lean(run), "y int, found array<string>"), "toxic-labelled")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("y")).first()
    n, bad = whole["n"], whole["y"]
    scorer.bias = float(np.log((bad + 0.5) / (n - bad + 0.5)))
    if not 0 < bad < n:
        return scorer
    counts = rows.select("y", F.explode("found").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("d"), F.sum("y").alias("t")).filter(F.col("d") >= least)
    part, rest = F.col("t") / bad, (F.col("d") - F.col("t")) / (n - bad)

    def term(count, expected):
        return F.when(count > 0, count * F.log(count / expected)).otherwise(F.lit(0.0))

    ratio = term(F.col("t"), F.col("d") * bad / n) + term(F.col("d") - F.col("t"), F.col("d") * (n - bad) / n)
    chosen = counts.withColumn("r", F.when(part > rest, ratio).otherwise(ratio / 4)).filter("r > 8").orderBy(F.desc("r"), "f").limit(words)
    names = [r["f"] for r in chosen.select("f").collect()]
    wanted = F.array(*[F.lit(x) for x in names]) if names else F.array().cast("array<string>")
    common = counts.filter(~F.col("f").endswith("~")).orderBy(F.desc("d"), "f").limit(LEXICON).select("f", "d").collect()
    met = sum(r["d"] for r in common)
    scorer.lexicon = {r["f"]: float(np.log(met / r["d"])) for r in common}
    alike = rows.groupBy("y", F.array_sort(F.array_intersect("found", wanted)).alias("f")).agg(F.count(F.lit(1)).alias("n"))
    alike = written(alike, "toxic-alike")
    discard(rows)
    weights, scorer.bias = _logistic(alike, names)
    discard(alike)
    scorer.weights = {w: float(x) for w, x in zip(names, weights) if abs(x) > 1e-3}
    return scorer


PARTS, BLOCK = 16, 4096  # tasks that send sums of a Newton step to the driver; rows spread out together


def _logistic(alike: DataFrame, names: list[str], ridge: float = 0.05, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Ridge-penalised logistic regression on the presence of words, by Newton steps; the bias is not penalised.

    ``alike`` has (y, f, n): how many rows have the label and exactly these words. A task sends one packed triangle and one vector.
    """
    at, width = {w: i for i, w in enumerate(names)}, len(names) + 1
    upper = np.triu_indices(width)
    dealt = alike.select(F.pmod(F.xxhash64("y", "f"), F.lit(PARTS)).alias("part"), "y", "f", "n").repartition(PARTS, "part").sortWithinPartitions("part", "y", "f")
    dealt = written(dealt, "toxic-dealt").coalesce(PARTS)
    penalty = np.full(width, ridge)
    penalty[-1] = 1e-6
    w = np.zeros(width)
    for _ in range(rounds):
        now = w.copy()

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            curve, slope, least = np.zeros((width, width)), np.zeros(width), None
            for batch in batches:
                for s in range(0, batch.num_rows, BLOCK):
                    cut = batch.slice(s, BLOCK)
                    x = np.zeros((cut.num_rows, width))
                    x[:, -1] = 1
                    for row, found in enumerate(cut.column(2).to_pylist()):
                        x[row, [at[v] for v in found]] = 1
                    y, n = cut.column(1).to_numpy().astype(float), cut.column(3).to_numpy().astype(float)
                    p = 1 / (1 + np.exp(-np.clip(x @ now, -30, 30)))
                    curve += (x * (n * p * (1 - p))[:, None]).T @ x
                    slope += x.T @ (n * (y - p))
                    least = cut.column(0)[0].as_py() if least is None else least
            if least is not None:
                out = np.concatenate([curve[upper], slope])
                yield pa.RecordBatch.from_arrays([pa.array([least], pa.int64()), pa.array([out.tolist()], pa.list_(pa.float64()))], names=["part", "sums"])

        total = np.zeros(len(upper[0]) + width)
        for row in dealt.mapInArrow(sums, "part long, sums array<double>").orderBy("part").toArrow().column("sums"):
            total += row.values.to_numpy()
        curve = np.zeros((width, width))
        curve[upper] = total[: len(upper[0])]
        curve = curve + np.triu(curve, 1).T + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, total[len(upper[0]) :] - penalty * w)
        w += step * min(1.0, 4 / max(1e-9, np.abs(step).max()))  # long steps are shortened
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


def with_scores(docs: DataFrame, scorer: Scorer, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text (0 to 1) as the last column; one already named so is replaced. Rows do not move.

    Null and empty texts get the score of no evidence; equal texts, of whatever length, get equal scores; repeated rows are each scored;
    an empty table gives an empty table.
    """
    docs = docs.drop(out)
    at = docs.columns.index(text)
    docs = docs.withColumn(out, F.lit(None).cast("double"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 1000):
                batch = whole.slice(s, 1000)
                scores = [scorer.score(t) for t in batch.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=batch.schema.names)

    return docs.mapInArrow(lean(run), docs.schema)
