"""Quality classifier: supervised subword embeddings.

Features are hashed character n-grams and hashed word n-grams of the whole text; each has a learned vector, a
document is the average of its features' vectors, and a softmax over two classes is trained on top by stochastic
gradient descent in numpy. Training takes a bounded sample of labelled rows, chosen by hash: ``max_train`` rows, and of
those the first that together have at most ``MAX_FEATURES`` table places, so the driver's share is bounded in bytes. Since
averaging and the output layer are linear, scoring needs one number a feature: the difference of the two classes'
products with its vector. Those numbers (2**BITS floats) are all that is sent to executors.

Defined results: null text is empty; a text without features is scored by the learned bias alone; rows with a null
doc_id are scored and never trained on; a doc_id with several labels counts as bad if any of them is; null labels
are ignored; without a single usable label every score is 1.0 (nothing is known against a text); repeated rows are
scored each and train once; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismgrid.llm.common import crc_mod, in_fold, text_bytes
from prismgrid.storage import materialize

BITS = 16
DIMENSIONS = 8
CHAR_GRAMS = (2, 3, 4)
#: Kinds of features: the character n-grams, words and word pairs. Each has the same weight in a document's average.
KINDS = len(CHAR_GRAMS) + 2
THRESHOLD = 0.7
MAX_TRAIN = 3000
#: Table places of all training rows together (6 bytes each), counted at their most: one a byte and kind.
MAX_FEATURES = 24_000_000
#: Parts in which the training rows travel to the driver.
PARTS = 16
_ODD = 0x9E3779B1


def _slots(h: np.ndarray, kind: int) -> np.ndarray:
    """Table places of uint32 hashes; ``kind`` keeps n-gram sizes apart."""
    h = (h + np.uint32(kind * 0x7F4A7C15 & 0xFFFFFFFF)) * np.uint32(_ODD)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA77)
    return h >> np.uint32(32 - BITS)


def _features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind of feature: table places, and each text's first and last place among them."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    ends = starts + sizes
    x = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32) + np.uint32(1)
    h = x
    for n in range(2, max(CHAR_GRAMS) + 1):
        h = h[: max(0, len(h) - 1)] * np.uint32(0x01000193) + x[n - 1 :] if len(x) >= n else x[:0]
        if n in CHAR_GRAMS:
            yield _slots(h, n), np.minimum(starts, len(h)), np.minimum(np.maximum(starts, ends - n + 1), len(h))
    white = (x == 33) | ((x >= 10) & (x <= 14))
    edge = np.ones(len(x) + 1, bool)  # whether a word may not go on from the byte before
    edge[1:-1] = False
    edge[starts] = True
    inside = ~white
    begin = np.flatnonzero(inside & (edge[:-1] | np.concatenate([[True], white[:-1]]) if len(x) else inside))
    stop = np.flatnonzero(inside & (edge[1:] | np.concatenate([white[1:], [True]]) if len(x) else inside)) + 1
    power = np.cumprod(np.full(len(x) + 1, 0x01000193, np.uint32), dtype=np.uint32)
    back = np.cumprod(np.full(len(x) + 1, pow(0x01000193, -1, 1 << 32), np.uint32), dtype=np.uint32)
    total = np.concatenate([np.zeros(1, np.uint32), np.cumsum(x * power[:-1], dtype=np.uint32)])
    word = (total[stop] - total[begin]) * back[begin] ^ (stop - begin).astype(np.uint32)
    first, last = np.searchsorted(begin, starts), np.searchsorted(begin, ends)
    yield _slots(word, 17), first, last
    pair = word[:-1] * np.uint32(0x2C1B3C6D) + word[1:] if len(word) else word
    pair = np.where(word[:-1] == word[1:], np.uint32(7), pair) if len(word) else pair  # a word said twice is one feature, whatever the word
    yield _slots(pair, 23), np.minimum(first, len(pair)), np.minimum(np.maximum(first, last - 1), len(pair))


def vectors_of(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct table places and their shares, in few bytes: training rows travel to the driver."""
    found = list(_features(texts))
    out = []
    for i in range(len(texts)):
        parts = [places[a[i] : b[i]] for places, a, b in found]
        slots, back = np.unique(np.concatenate(parts), return_inverse=True)
        each = np.concatenate([np.full(len(x), 1 / (len(parts) * max(1, len(x)))) for x in parts])
        out.append((slots.astype(np.uint16), np.bincount(back, each, len(slots)).astype(np.float32)))
    return out


class Model:
    """``table``: one number a feature; ``bias``; ``known``: whether any label was learned."""

    def __init__(self, table: np.ndarray, bias: float, known: bool = True):
        self.table, self.bias, self.known = table, bias, known

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if not self.known:
            return np.ones(len(texts))
        total = np.zeros(len(texts))
        for places, a, b in _features(texts):
            upto = np.concatenate([[0.0], np.cumsum(self.table[places], dtype=np.float64)])
            total += (upto[b] - upto[a]) / np.maximum(1, b - a)
        return 1 / (1 + np.exp(-np.clip(total / KINDS + self.bias, -500, 500)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 8, rate: float = 1.0, seed: int = 7) -> Model:
    """Softmax over averaged embeddings; steps are scaled by each parameter's past gradients."""
    if not rows:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, False)
    rng = np.random.default_rng(seed)
    E = rng.uniform(-1, 1, (1 << BITS, DIMENSIONS)).astype(np.float32) / DIMENSIONS
    W, b = rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32), np.zeros(2, np.float32)
    gE, gW, gb = np.full(1 << BITS, 1e-8, np.float32), np.full_like(W, 1e-8), np.full_like(b, 1e-8)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, share, label = rows[i]
            at = at.astype(np.int64)
            mean = share @ E[at] if len(at) else np.zeros(DIMENSIONS, np.float32)
            z = mean @ W + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = W @ p
            gW += (step := np.outer(mean, p)) ** 2
            W -= rate * 0.2 * step / np.sqrt(gW)
            gb += p**2
            b -= rate * 0.2 * p / np.sqrt(gb)
            if len(at):
                size = share * np.float32(np.linalg.norm(back))
                gE[at] += size * size
                E[at] -= (rate * share / np.sqrt(gE[at]))[:, None] * back
    return Model((E @ (W[:, 1] - W[:, 0])).astype(np.float32), float(b[1] - b[0]))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, key: str = "doc_id", text: str = "text", label: str = "quality", modulus: int = 4, held_out: int = 2, max_features: int = MAX_FEATURES) -> Model:
    """Learn from at most ``max_train`` labelled rows outside the held-out fold, the ones with the least hashes."""
    usable = labels.where(F.col(label).isNotNull() & (crc_mod(F.col(key), modulus) != held_out))
    marked = usable.groupBy(F.col(key).alias("k")).agg(F.min(label).alias("y"))
    marked = F.broadcast(marked.orderBy(F.xxhash64("k"), "k").limit(max_train))  # at most max_train rows of two numbers
    rows = docs.select(F.col(key).alias("k"), text_bytes(text).alias("t")).join(marked, "k")
    rows = rows.select(F.col("k").cast("string").alias("k"), "y", F.xxhash64("k").alias("a"), F.xxhash64("t").alias("b"), "t")
    most = F.least(F.lit(KINDS) * F.octet_length("t"), F.lit(1 << BITS))
    chosen, held = [], 0
    for r in rows.groupBy("a", "b").agg(F.min(most).alias("n")).orderBy("a", "b").limit(max_train).collect():
        held += r["n"]
        if held > max_features:
            break
        chosen.append((r["a"], r["b"]))
    if not chosen:
        return train([])
    spark = docs.sparkSession
    rows = rows.join(F.broadcast(spark.createDataFrame(chosen, "a long, b long")), ["a", "b"])

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in found:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
                new = []
                for i, name in enumerate(zip(part.column("a").to_pylist(), part.column("b").to_pylist(), strict=True)):
                    if name not in seen:
                        new.append(i)
                        seen.add(name)
                part = part.take(pa.array(new, pa.int64()))
                made = vectors_of(part.column("t").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("a"), part.column("b"), part.column("k"), part.column("y").cast(pa.int32()), pa.array([a.tobytes() for a, _ in made], pa.binary()), pa.array([s.tobytes() for _, s in made], pa.binary())],
                    ["a", "b", "k", "y", "at", "share"],
                )

    # features are made where the texts are; neither they nor texts meet in one task, and the driver takes a part at a time
    made = rows.select("a", "b", "k", "y", "t").mapInArrow(run, "a long, b long, k string, y int, at binary, share binary")
    made = made.repartition(PARTS, "a", "b").dropDuplicates(["a", "b"])
    made = list(materialize(made, "classifier-rows").toLocalIterator())
    made.sort(key=lambda r: (r["k"], bytes(r["at"]), bytes(r["share"])))
    return train([(np.frombuffer(r["at"], np.uint16), np.frombuffer(r["share"], np.float32), int(r["y"] > 0)) for r in made])


def judge(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN, key: str = "doc_id", text: str = "text", label: str = "quality", modulus: int = 4, held_out: int = 2) -> DataFrame:
    """Every document's fold, score and predicted label."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_train, key, text, label, modulus, held_out))
    kind = docs.schema[key].dataType.simpleString()

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(model.value.scores(part.column(2).to_pylist()), pa.float64())], ["k", "held_out", "score"])

    rows = docs.select(F.col(key).alias("k"), in_fold(F.col(key), modulus, held_out).alias("held_out"), text_bytes(text).alias("t"))
    scored = rows.mapInArrow(run, f"k {kind}, held_out boolean, score double")
    return scored.select(F.col("k").alias(key), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train: int = MAX_TRAIN, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The documents, all columns kept, that the classifier accepts."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, max_train, key, text, label))
    place = docs.columns.index(text)

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = [t or b"" for t in part.column(place).cast(pa.binary()).to_pylist()]
                yield part.filter(pa.array(model.value.scores(texts) >= threshold))

    return docs.mapInArrow(run, docs.schema)
