"""Document fingerprints: threshold-scaled sketches of word shingles, and a document's edited text.

A sketch keeps every shingle hash below a fixed fraction of the range, so sketches of any two documents were cut at the same
threshold: they merge by union, and containment is estimated without regard to size. A sketch also keeps its least hash, so no
text with words has an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.ranges import cuts, dealt, heads_of

SHINGLE, FRACTION = 5, 1 / 8
_ZERO = np.empty(0, np.uint64)


def hashes(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    if not words:
        return _ZERO
    if len(words) <= shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)]))
    return np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=0), grams), np.uint64)


def sketch(found: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """Sorted distinct hashes below the threshold, and the least of all."""
    if not len(found):
        return _ZERO
    kept = np.unique(found[found < np.uint64(int(fraction * 2**64))])
    return kept if len(kept) else found.min(keepdims=True)


def words_of(text: str) -> list[bytes]:
    return text.encode().lower().split()


def merged(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> np.ndarray:
    """The sketch of two texts together."""
    return sketch(np.concatenate([a, b]), fraction)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of shingles in common (Jaccard); two texts without words are alike."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the first text's shingles that the second has."""
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def shown(s: np.ndarray) -> str:
    return s.astype(">u8").tobytes().hex()


def read(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), ">u8").astype(np.uint64)


def with_sketches(docs: DataFrame, text: str = "text", out: str = "fingerprint", fraction: float = FRACTION) -> DataFrame:
    """``docs`` with the sketch of each whole text as a hex string; empty for null texts and texts without words."""
    docs = docs.drop(out)
    at = docs.columns.index(text)
    docs = docs.withColumn(out, F.lit(None).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [shown(sketch(hashes(words_of(t or "")), fraction)) for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string())], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many (or all) of the following text."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def compare_edited(docs: DataFrame, key: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Per document in ascending key order: sketches of its text and of its edited text, and how near they and the next one are.

    Keys are cut into ranges by quantiles and each range is read in order by one task. The first document of each range is sent to
    the range before it as well, and the first of all to the last range, so no task needs another one's rows.

    Null keys come first; rows of equal key are ordered by text, null first. A null text counts as empty. A single document follows
    itself. An empty table gives an empty table.
    """
    kind = docs.schema[key].dataType.simpleString()
    edges = cuts(docs, key, ranges or 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = dealt(docs, key, text, edges, heads_of(docs, key, edges))
    schema = f"`{key}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [key, *[c.split()[0] for c in schema.split(", ")[1:]]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done = None, []  # the row that waits for its follower

        def finish(row: tuple, after: str, after_sketch: np.ndarray) -> None:
            k, t, s = row
            changed = edited_text(t, after)
            e = s if changed == t else sketch(hashes(words_of(changed)))
            done.append((k, len(t), hashlib.sha256(changed.encode()).hexdigest(), shown(s), shown(e), likeness(s, e), likeness(s, after_sketch)))

        def flush() -> pa.RecordBatch:
            columns = [pa.array(c, type_) for c, type_ in zip(zip(*done), types)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        types: list[pa.DataType] = []
        met = None
        for batch in batches:
            types = types or [batch.schema.field(3).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            for part, guest, k, t in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3, 4)]):
                t = t or ""
                if guest and met == part:  # further rows of the head's key stay guests without use
                    continue
                s = sketch(hashes(words_of(t)))
                if held is not None:
                    finish(held, t, s)
                held = None if guest else (k, t, s)
                met = part if guest else met
            if len(done) >= 512:
                yield flush()
        if done:
            yield flush()

    return rows.mapInArrow(run, schema)
