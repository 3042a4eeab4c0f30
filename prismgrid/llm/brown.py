"""LM scoring with Brown class-based bigrams.

p(text) = product of p(class | previous class) * p(word | class). Every word belongs to a type: the ``WORDS`` most
frequent words are types of their own, any other word belongs to the type of its ending (a fixed number of hashed
endings), so no word of an unbounded vocabulary lacks one; the end is the last type. Exchange clustering moves types
between classes while the class bigram likelihood grows. The other words of the head (``HEAD`` words) then leave their
endings' classes for those that their own neighbours ask for, all at once and ``ROUNDS`` times, each from its own
counts in a distributed step. Counts of all training words and all type pairs are gathered by distributed
aggregation; only the type pairs (types squared at most) reach the driver.

p(word | class) is n / (N + S + 1) for a word seen n times, and (S + 1) / (N + S + 1) for the slot of all words never
seen, where the class has N tokens and S words seen once. With ``spell`` a word never seen gets its share of that
slot: the probability of its bytes, from the byte pairs of the training words seen once, whose kind it is. Without,
the slot is one outcome, and unknown words cost no more than their slot. p(class | class) is interpolated with the
classes' own shares.

Texts are split twice: to count words, and to number them once the head is known. Numbers are written to the shared
folder with each text's remaining words; clustering and scoring read those. The head is scored where the text is,
from tables of bounded size; each document's remaining words meet their counts in a shuffled join and are summed by
document. Of those, only words over ``HEAD_BYTES`` bytes can be frequent; the frequent ones are dealt out by row.

Defined results: null and word-less texts are one end token; rows with a null doc_id train and are not held out;
repeated rows train and are scored each; without training rows every count is 0 and every base term is
log10(1 / 1); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismgrid.llm.common import in_fold, leading, text_bytes
from prismgrid.storage import materialize

#: Stands for the end of a text; no word has white space.
END = b"\n"
WORDS = 1000
ENDINGS = 127
CLASSES = 64
ROUNDS = 2
HEAD = 50_000
HEAD_BYTES = 64
SMOOTH = 5.0
#: Distinct words that a worker counts before it hands them on.
HELD = 300_000
#: A longer word with more than one in so many tokens is dealt out, to so many places.
HOT_PARTS = 1000
SALTS = 64
#: Most tasks that add up counts.
PARTS = 48
#: Texts that a worker takes together.
SLICE = 256


def ending(word: bytes, endings: int = ENDINGS) -> int:
    return zlib.crc32(word[-3:]) % endings


def ending_of(word: Column, endings: int = ENDINGS) -> Column:
    return F.crc32(F.when(F.octet_length(word) > 3, F.substring(word, -3, 3)).otherwise(word)) % endings


def word_counts(train: DataFrame, text: str = "text") -> DataFrame:
    """word, n over all texts, the end token included."""

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(counts: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        counts: Counter = Counter()
        for batch in found:
            for t in batch.column(0).to_pylist():
                counts.update(t.lower().split())
                counts[END] += 1
                if len(counts) > HELD:
                    yield made(counts)
                    counts = Counter()
        yield made(counts)

    return train.select(text_bytes(text)).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Types:
    """Which type a word has: its own if it leads the counts, else its ending's.

    ``known`` numbers the remaining words of the head beyond all types; ``base`` has the type of each number.
    """

    def __init__(self, head: list[tuple[bytes, int]], words: int = WORDS, endings: int = ENDINGS):
        self.words, self.endings, self.size = words, endings, words + endings + 1
        rest = [w for w, _ in head[words:]]
        self.rest, self.end = len(rest), self.size - 1
        self.known = {w: i for i, (w, _) in enumerate(head[:words])} | {w: self.size + i for i, w in enumerate(rest)} | {END: self.end}
        self.base = np.concatenate([np.arange(self.size), [words + ending(w, endings) for w in rest]]).astype(np.int64)
        self.width = "<u2" if len(self.base) <= 1 << 16 else "<i4"


def numbered(docs: DataFrame, types: Types) -> DataFrame:
    """``docs`` (row, k, held, t) with the texts' words as numbers, the end last, and the words beyond the head: each
    text's distinct ones and how often it has them."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(types), docs.schema["k"].dataType.simpleString()

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = shared.value
        known, first, endings, end = types.known.get, types.words, types.endings, types.end
        for batch in found:
            for part in (batch.slice(i, SLICE) for i in range(0, batch.num_rows, SLICE)):
                lines, tails, counts = [], [], []
                for t in part.column("t").to_pylist():
                    words = t.lower().split()
                    line, tail = list(map(known, words)), []
                    if None in line:
                        for i, at in enumerate(line):
                            if at is None:
                                line[i] = first + ending(words[i], endings)
                                tail.append(words[i])
                    line.append(end)
                    tail = Counter(tail)
                    lines.append(np.array(line, types.width).tobytes())
                    tails.append(END.join(tail))
                    counts.append(np.array(list(tail.values()), np.int32).tobytes())
                yield pa.RecordBatch.from_arrays([*(part.column(x) for x in ("row", "k", "held")), *(pa.array(x, pa.binary()) for x in (lines, tails, counts))], ["row", "k", "held", "line", "tail", "tf"])

    return materialize(docs.mapInArrow(run, f"row long, k {kind}, held boolean, line binary, tail binary, tf binary"), "word-numbers")


def _summed(lines: DataFrame, types: Types, of: np.ndarray, size: int, chunk: int, codes, finish, schema: str) -> DataFrame:
    """``finish`` of each ``chunk`` of codes below ``size``: of its number and how often ``codes`` of the lines' numbers
    and of their ``of`` has each code. The numbers of some texts stand in one run, which an end opens.

    A task packs its counts by chunk, so it sends as many rows as there are chunks; they are added up as they arrive.
    """
    shared = lines.sparkSession.sparkContext.broadcast(of)
    width, end = types.width, types.end

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, opening = np.zeros(size, np.int64), np.array([end], width).tobytes()
        for batch in found:
            for part in (batch.slice(i, SLICE) for i in range(0, batch.num_rows, SLICE)):
                at = np.frombuffer(b"".join([opening, *part.column(0).to_pylist()]), width).astype(np.int32)
                np.add.at(counts, codes(at, shared.value[at]), 1)
        for i in range(0, size, chunk):
            if (some := counts[i : i + chunk]).any():
                yield pa.RecordBatch.from_arrays([pa.array([i // chunk], pa.int32()), pa.array([zlib.compress(some.tobytes(), 1)], pa.binary())], ["chunk", "n"])

    def add(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, None
        for batch in found:
            for i, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i != at:
                    if at is not None:
                        yield finish(at, total)
                    at, total = i, np.zeros(min(chunk, size - i * chunk), np.int64)
                total += np.frombuffer(zlib.decompress(packed.as_py()), np.int64)
        if at is not None:
            yield finish(at, total)

    return lines.select("line").mapInArrow(count, "chunk int, n binary").repartition(min(PARTS, -(-size // chunk)), "chunk").sortWithinPartitions("chunk").mapInArrow(add, schema)


def pairs_of(lines: DataFrame, types: Types, of: np.ndarray, size: int) -> np.ndarray:
    """Counts of (``of`` a number, ``of`` the next). As many numbers, whatever the input."""

    def finish(i: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["chunk", "n"])

    out, chunk = np.zeros(size * size, np.int64), 1 << 16
    for r in _summed(lines, types, of, size * size, chunk, lambda at, x: x[:-1] * size + x[1:], finish, "chunk int, n binary").toLocalIterator():
        n = np.frombuffer(r["n"], np.int64)
        out[r["chunk"] * chunk : r["chunk"] * chunk + len(n)] = n
    return out.reshape(size, size)


def settle(lines: DataFrame, types: Types, now: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """``now``, the class of each number, with each remaining word of the head in the class that raises the likelihood
    most, from the classes beside the word itself, while all others keep theirs."""
    classes, first, together = len(grid), types.size, 256
    wide = 2 * classes + 1  # next classes, previous classes, next to itself

    def codes(at: np.ndarray, x: np.ndarray) -> np.ndarray:
        i = np.flatnonzero(at >= first)  # neither a run's first place nor its last
        own = (at[i].astype(np.int64) - first) * wide
        return np.concatenate([own + x[i + 1], own + classes + x[i - 1], own[at[i] == at[i + 1]] + 2 * classes])

    def finish(i: int, total: np.ndarray) -> pa.RecordBatch:
        best = []
        for word, n in enumerate(total.reshape(-1, wide).astype(np.float64)):
            was = now[first + i * together + word]
            gain = _gains(grid, was, n[-1], n[:classes], n[classes:-1])[0]
            top = int(np.argmax(gain))
            best.append(top if gain[top] > gain[was] + 1e-9 else int(was))
        return pa.RecordBatch.from_arrays([pa.array(range(i * together, i * together + len(best)), pa.int32()), pa.array(best, pa.int32())], ["word", "label"])

    out = now.copy()
    for r in _summed(lines, types, now, types.rest * wide, together * wide, codes, finish, "word int, label int").collect():
        out[first + r["word"]] = r["label"]
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def _gains(grid: np.ndarray, was: int, own: float, left: np.ndarray, right: np.ndarray):
    """The likelihood with a type of class ``was`` in each class, up to a constant; the grid without the type, and its
    next and previous classes without itself. The last class takes none."""
    out, into = left.copy(), right.copy()
    out[was] -= own
    into[was] -= own  # without itself
    bare = grid.copy()
    bare[was, :] -= out
    bare[:, was] -= into
    bare[was, was] -= own
    rows, cols = bare.sum(axis=1), bare.sum(axis=0)
    total_out, total_in = out.sum() + own, into.sum() + own
    gain = (_xlogx(bare + out[None, :]) - _xlogx(bare)).sum(axis=1) + (_xlogx(bare + into[:, None]) - _xlogx(bare)).sum(axis=0)
    d = np.arange(len(grid))
    both, plain = bare[d, d] + out + into + own, bare[d, d]
    gain += _xlogx(both) + _xlogx(plain) - _xlogx(plain + out) - _xlogx(plain + into)
    gain -= _xlogx(rows + total_out) - _xlogx(rows) + _xlogx(cols + total_in) - _xlogx(cols)
    gain[-1] = -np.inf
    return gain, bare, out, into


def exchange(pairs: np.ndarray, classes: int = CLASSES, rounds: int = 20) -> np.ndarray:
    """A class for each type. Types move, one at a time, to the class that raises the bigram likelihood most.

    The last type (the end) keeps a class to itself. The likelihood of class bigrams is, up to a constant, the sum of
    n log n over class pairs less twice that over classes (left and right totals alike).
    """
    pairs = pairs.astype(np.float64)
    types = len(pairs)
    order = np.argsort(-pairs.sum(axis=1), kind="stable")
    label = np.empty(types, np.int64)
    movable = [t for t in order if t != types - 1]
    label[movable] = np.arange(len(movable)) % (classes - 1)
    label[types - 1] = classes - 1
    one = np.eye(classes)[label]
    grid = one.T @ pairs @ one
    left, right = pairs @ one, pairs.T @ one  # of each type: next classes, previous classes
    for _ in range(rounds):
        moves = 0
        for t in movable:
            own, was = pairs[t, t], label[t]
            gain, bare, out, into = _gains(grid, was, own, left[t], right[t])
            best = int(np.argmax(gain))
            if gain[best] <= gain[was] + 1e-9:
                continue
            moves += 1
            label[t] = best
            grid = bare
            grid[best, :] += out
            grid[:, best] += into
            grid[best, best] += own
            left[:, was] -= pairs[:, t]
            left[:, best] += pairs[:, t]
            right[:, was] -= pairs[t, :]
            right[:, best] += pairs[t, :]
        if not moves:
            break
    return label


def spelling(counts: DataFrame) -> np.ndarray:
    """log10 of the probability of each byte after each, from the words seen once; ``END`` opens and closes a word."""
    once = counts.where(F.col("n") == 1).where(F.col("word") != F.lit(END)).select("word")

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in found:
            x = np.frombuffer(END + END.join(batch.column(0).to_pylist()) + END, np.uint8).astype(np.int64)
            total += np.bincount(x[:-1] << 8 | x[1:], minlength=1 << 16)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["code", "n"])

    pairs = np.zeros(1 << 16)
    for r in once.mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        pairs[r["code"]] = r["n"]
    pairs = pairs.reshape(256, 256)
    possible = np.ones((256, 256))
    possible[:, [0x20, 0x09, 0x0B, 0x0C, 0x0D]] = 0
    possible[END[0], END[0]] = pairs[END[0], END[0]] = 0  # no word is empty
    share = (pairs + 0.5 * possible) / (pairs + 0.5 * possible).sum(axis=1, keepdims=True)
    return np.where(possible > 0, np.log10(np.maximum(share, 1e-300)), 0.0)


def spelled(words: list[bytes], table: np.ndarray) -> np.ndarray:
    """log10 of each word's spelling."""
    x = np.frombuffer(END + END.join(words) + END, np.uint8)
    upto = np.concatenate([[0.0], np.cumsum(table[x[:-1], x[1:]])])
    edges = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])])
    return upto[edges[1:]] - upto[edges[:-1]]


class Model:
    """What scoring needs, of a size that the input doesn't change. By number: class, log10 of the count (0 for the
    endings, whose words are scored apart), base term, whether it is a known word."""

    def __init__(self, types: Types, head: list[tuple[bytes, int]], total: int, distinct: int, label: np.ndarray, grid: np.ndarray, once: dict[int, int], spell: np.ndarray | None = None):
        self.types, self.label, classes, self.spell = types, label, len(grid), spell
        self.total, self.base = total, np.log10(total + distinct + 1)
        share = (grid.sum(axis=0) + 1) / (grid.sum() + classes)
        self.step = np.log10((grid + SMOOTH * share) / (grid.sum(axis=1, keepdims=True) + SMOOTH))
        tokens, single = grid.sum(axis=0), np.zeros(classes)
        for t, n in once.items():
            single[self.label[t]] += n
        self.whole, self.unseen = np.log10(tokens + single + 1), np.log10(single + 1)
        self.of_ending = self.label[types.words : types.size - 1]
        count = np.zeros(len(label))
        for w, n in head:
            count[types.known[w]] = n
        self.known = count > 0
        self.seen = np.log10(np.maximum(count, 1))
        self.based = np.where(self.known, np.log10(count + 1) - self.base, 0.0)
        if not self.known[types.end]:
            self.seen[types.end], self.based[types.end] = self.unseen[self.label[types.end]], -self.base


def leading_words(counts: DataFrame, size: int = HEAD) -> list[tuple[bytes, int]]:
    """At most ``size`` of the most frequent words of bounded length, most frequent first."""
    words = counts.where((F.octet_length("word") <= HEAD_BYTES) & (F.col("word") != F.lit(END)))
    found = [(bytes(r["word"]), r["n"]) for r in leading(words, size).select("word", "n").collect()]
    return sorted(found, key=lambda x: (-x[1], x[0]))


def _rows(docs: DataFrame, fold: Column, key: Column, text: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), key.alias("k"), fold.alias("held"), text_bytes(text).alias("t"))


def _learn(docs: DataFrame, text: str, rows: DataFrame, head_size: int, words: int, endings: int, classes: int, rounds: int, spell: bool) -> tuple[Model, DataFrame, DataFrame]:
    """A model of the texts of ``docs``, their word counts, and ``rows`` (of which those not held are ``docs``) numbered."""
    counts = materialize(word_counts(docs, text), "word-counts")
    whole = counts.agg(F.sum("n"), F.count("*")).first()
    head = leading_words(counts, head_size)
    ends = counts.where(F.col("word") == F.lit(END)).collect()
    types = Types(head, words, endings)
    table = numbered(rows, types)
    lines = table.where(~F.col("held"))
    pairs = pairs_of(lines, types, types.base, types.size)
    label = exchange(pairs, classes)
    one = np.eye(classes)[label]
    grid, label = one.T @ pairs @ one, label[types.base]
    for _ in range(rounds if types.rest else 0):
        label = settle(lines, types, label, grid)
        grid = pairs_of(lines, types, label, classes).astype(np.float64)
    single = counts.where("n = 1 and word != X'0A'").groupBy(ending_of(F.col("word"), endings).alias("ending")).agg(F.count("*").alias("n")).collect()
    once = {words + r["ending"]: r["n"] for r in single}
    for w, n in head:
        if n == 1:  # a class of its own, not its ending's
            once[types.known[w]] = 1
            once[words + ending(w, endings)] -= 1
    if ends and ends[0]["n"] == 1:
        once[types.end] = 1
    return Model(types, head + [(END, r["n"]) for r in ends], whole[0] or 0, whole[1], label, grid, once, spelling(counts) if spell else None), counts, table


def fit(train: DataFrame, text: str = "text", head_size: int = HEAD, words: int = WORDS, endings: int = ENDINGS, classes: int = CLASSES, rounds: int = ROUNDS, spell: bool = False) -> tuple[Model, DataFrame]:
    rows = _rows(train, F.lit(False), F.lit(0), text)
    return _learn(train, text, rows, head_size, words, endings, classes, rounds, spell)[:2]


def _dealt(local: DataFrame, counts: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join by word with a ``salt``: frequent long words are dealt out by row, others stay at 0."""
    hot = [r[0] for r in counts.where((F.octet_length("word") > HEAD_BYTES) & (F.col("n") * HOT_PARTS > total)).select(F.xxhash64("word")).collect()]  # fewer than HOT_PARTS
    if not hot:
        return local.withColumn("salt", F.lit(0)), counts.withColumn("salt", F.lit(0))
    is_hot = F.xxhash64("word").isin(hot)
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return local.withColumn("salt", F.when(is_hot, F.pmod("row", F.lit(SALTS)).cast("int")).otherwise(F.lit(0))), counts.withColumn("salt", F.explode(salts))


def score(docs: DataFrame, modulus: int = 7, held_out: int = 2, key: str = "doc_id", text: str = "text", head_size: int = HEAD, words: int = WORDS, endings: int = ENDINGS, classes: int = CLASSES, rounds: int = ROUNDS, spell: bool = False) -> DataFrame:
    """Every document's fold, token counts, base score and the model's log10 probability."""
    fold = in_fold(F.col(key), modulus, held_out)
    model, counts, table = _learn(docs.where(~fold), text, _rows(docs, fold, F.col(key), text), head_size, words, endings, classes, rounds, spell)
    kind = docs.schema[key].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["row", "k", "held", "word", "tf", "n_tokens", "n_known", "base", "score", "unseen"]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        endings, end = m.types.endings, int(m.label[m.types.end])
        none = lambda n, kind: pa.nulls(n, kind)
        for batch in found:
            for part in (batch.slice(i, SLICE) for i in range(0, batch.num_rows, SLICE)):
                lines, rows = part.column("line").to_pylist(), part.column("row").to_numpy()
                wide = np.dtype(m.types.width).itemsize
                sizes = np.array([len(x) // wide for x in lines])
                first = np.cumsum(sizes) - sizes
                at = np.frombuffer(b"".join(lines), m.types.width)
                c = m.label[at]
                each = m.step[np.concatenate([[end], c[:-1]]), c] - m.whole[c] + m.seen[at]
                known, base, score = (np.add.reduceat(x, first) for x in (m.known[at].astype(np.int64), m.based[at], each))
                n = part.num_rows
                word = pa.array([b" " + row.to_bytes(8, "big") for row in rows.tolist()], pa.binary())  # as no text has it: these rows meet nothing
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("k"), part.column("held"), word, none(n, pa.int32()), pa.array(sizes), pa.array(known), pa.array(base), pa.array(score), none(n, pa.float64())], names)
                tails, tf = [x.split(END) if x else [] for x in part.column("tail").to_pylist()], b"".join(part.column("tf").to_pylist())
                tail = [w for x in tails for w in x]
                if n := len(tail):
                    unseen = m.unseen[m.of_ending[np.array([ending(w, endings) for w in tail])]]
                    if m.spell is not None:
                        unseen = unseen + spelled(tail, m.spell)
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, [len(x) for x in tails])), none(n, part.column("k").type), none(n, pa.bool_()), pa.array(tail, pa.binary()), pa.array(np.frombuffer(tf, np.int32)), none(n, pa.int64()), none(n, pa.int64()), none(n, pa.float64()), none(n, pa.float64()), pa.array(unseen)], names)

    local = table.mapInArrow(run, f"row long, k {kind}, held boolean, word binary, tf int, n_tokens long, n_known long, base double, score double, unseen double")
    local, counts = _dealt(local, counts, model.total)
    met = local.join(counts, ["word", "salt"], "left")
    tf, n = F.col("tf"), F.coalesce("n", F.lit(0))
    part = met.select(
        "row",
        "k",
        "held",
        "n_tokens",
        F.when(tf.isNull(), F.col("n_known")).when(F.col("n").isNotNull(), tf.cast("long")).otherwise(F.lit(0)).alias("n_known"),
        F.when(tf.isNull(), F.col("base")).otherwise(tf * (F.log10(n + 1) - F.lit(float(model.base)))).alias("base"),
        F.when(tf.isNull(), F.col("score")).otherwise(tf * F.coalesce(F.log10(F.col("n")), F.col("unseen"))).alias("score"),
    )
    whole = part.groupBy("row").agg(F.max("k").alias("k"), F.max("held").alias("held"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base"), F.sum("score").alias("score"))
    return whole.select(F.col("k").alias(key), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
