"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

The alphabet is words, numbered by the benchmark's own vocabulary. Patterns are the benchmark's windows; for each
pattern length a shift table over hashed word pairs says how far the scan may jump, a zero shift opens the suffix
bucket, a hash of the whole window leaves the few entries of the bucket that may be equal, and a direct comparison of
the words' numbers confirms each occurrence.

Tables are arrays over one run of word numbers: about 25 bytes a window, and one dictionary entry a distinct word. A
block of the benchmark is bounded in bytes, and so is a part of an item, so neither a large benchmark nor a large
item is ever held whole; parts of an item overlap by all but one word of a window.

Defined results: null and word-less texts have no words and no hits; null or word-less items have no windows; a
null item_id marks its words but has no name to list; items with the same id count once; repeated documents are
judged each; an empty benchmark clears every document; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismgrid.llm.common import text_bytes
from prismgrid.storage import materialize

WINDOW = 13
#: Benchmark bytes that one matcher holds; a larger benchmark is searched in as many blocks as it takes, one at a time.
BLOCK_BYTES = 32 << 20
#: A block is dealt at least so many parts of items.
PARTS = 16
_WORD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in bytes(range(256)).lower())


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of letters, digits and non-ASCII characters."""
    return (text or b"").translate(_WORD).split()


def parts_of(text: bytes, size: int, window: int = WINDOW) -> Iterator[bytes]:
    """``text`` in runs of about ``size`` bytes; together they have its windows and no others."""
    if len(text) <= size:
        yield text
        return
    text, at, carry, whole = text.translate(_WORD), 0, [], True
    while at < len(text):
        end = text.find(b" ", at + size)
        end = len(text) if end < 0 else end
        words = carry + text[at:end].split()
        if len(words) >= window and len(words) > len(carry):
            yield b" ".join(words)
            whole = False
        carry, at = words[max(0, len(words) - window + 1) :], end
    if whole:
        yield b" ".join(carry)


class WuManber:
    """Windows of ``items`` (id, text) and their search tables, one set for each window length."""

    def __init__(self, items: Iterable[tuple[str | None, bytes]], window: int = WINDOW):
        self.names, self.vocabulary, runs = [], {}, []
        for name, text in items:
            words, number = words_of(text), self.vocabulary.setdefault
            self.names.append(name)
            runs.append(np.fromiter((number(w, len(self.vocabulary) + 1) for w in words), np.int32, len(words)))
        self.words = np.concatenate([np.zeros(0, np.int32), *runs])
        lengths = np.array([len(r) for r in runs], np.int64)
        begins, sizes = np.cumsum(lengths) - lengths, np.minimum(lengths, window)
        self.tables = []
        for size in np.unique(sizes[sizes > 0]).tolist():
            items_of = np.flatnonzero(sizes == size)
            each = lengths[items_of] - size + 1
            first = np.repeat(begins[items_of] - (np.cumsum(each) - each), each) + np.arange(each.sum())
            self.tables.append(self._table(size, first.astype(np.int32), np.repeat(items_of, each).astype(np.int32)))

    @staticmethod
    def _blocks(words: np.ndarray, block: int, bits: int) -> np.ndarray:
        """Hashes of ``bits`` bits of each run of ``block`` words."""
        h = words[block - 1 :].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if block == 2:
            h ^= words[:-1].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return (h * np.uint64(0xA0761D6478BD642F)) >> np.uint64(64 - bits)

    @staticmethod
    def _windows(words: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
        h = np.zeros(len(begins), np.uint64)
        for j in range(size):
            h = (h ^ words[begins + j].astype(np.uint64)) * np.uint64(0xE7037ED1A0B428DB)
            h ^= h >> np.uint64(31)
        return h

    def _keys(self, words: np.ndarray, begins: np.ndarray, size: int, blocks: np.ndarray, bits: int) -> np.ndarray:
        """The suffix bucket, then the window's hash."""
        tail = blocks[begins + size - min(2, size)]
        return (tail << np.uint64(64 - bits)) | (self._windows(words, begins, size) >> np.uint64(bits))

    def _table(self, size: int, begins: np.ndarray, items: np.ndarray) -> tuple:
        block = min(2, size)
        bits = min(26, max(8, int(8 * len(begins)).bit_length()))
        blocks = self._blocks(self.words, block, bits)
        shift = np.full(1 << bits, size - block + 1, np.uint8 if size < 256 else np.uint32)
        for j in range(size - block + 1):  # the least shift is written last
            shift[blocks[begins + j]] = size - block - j
        keys = self._keys(self.words, begins, size, blocks, bits)
        order = np.lexsort((items, keys))
        keys, begins, items = keys[order], begins[order], items[order]
        again = np.flatnonzero((keys[1:] == keys[:-1]) & (items[1:] == items[:-1])) + 1
        for j in range(size):  # an item's equal windows are one
            again = again[self.words[begins[again] + j] == self.words[begins[again - 1] + j]]
        one = np.ones(len(keys), bool)
        one[again] = False
        return size, block, bits, shift, keys[one], begins[one], items[one]

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Runs of hit words, disjoint and in order, and the items with an occurring window."""
        spans, owners, n = [], set(), len(words)
        at = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, n)  # 0: no word of the benchmark
        for size, block, bits, shift, keys, begins, items in self.tables:
            if n < size:
                continue
            blocks = self._blocks(at, block, bits)
            jumps, found, i, last = shift[blocks].tolist(), [], size - block, n - block
            while i <= last:
                if jump := jumps[i]:
                    i += jump
                else:
                    found.append(i - size + block)
                    i += 1
            if not found:
                continue
            found = np.array(found)
            asked = self._keys(at, found, size, blocks, bits)
            low, high = np.searchsorted(keys, asked), np.searchsorted(keys, asked, "right")
            some, known = np.flatnonzero(low < high), {}
            for i, a, b in zip(found[some].tolist(), low[some].tolist(), high[some].tolist(), strict=True):
                window = at[i : i + size]
                if (name := window.tobytes()) not in known:
                    equal = (self.words[begins[a:b, None] + np.arange(size)] == window).all(axis=1)
                    known[name] = bool(equal.any())
                    owners.update(items[a:b][equal].tolist())
                if known[name]:
                    spans.append((i, i + size))
        merged: list[tuple[int, int]] = []
        for begin, end in sorted(spans):
            if merged and begin <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((begin, end))
        return merged, owners


class _Blocks:
    """The benchmark in ``n`` blocks of about ``block_bytes``, by hash of its items' parts, each collected alone."""

    def __init__(self, items: DataFrame, key: str, text: str, block_bytes: int, window: int):
        rows = items.select(F.col(key).cast("string").alias("k"), text_bytes(text).alias("t"))
        total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
        self.n, self.rows = 1 + int(total // block_bytes), rows
        if self.n > 1:

            def split(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in found:
                    for k, t in zip(batch.column(0), batch.column(1), strict=True):
                        for i, part in enumerate(parts_of(t.as_py(), max(1, block_bytes // PARTS), window)):
                            yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], pa.string()), pa.array([i], pa.int64()), pa.array([part], pa.binary())], ["k", "i", "t"])

            self.rows = materialize(rows.mapInArrow(split, "k string, i long, t binary"), "decontam-items")

    def matcher(self, i: int, window: int) -> Broadcast:
        """Block ``i``'s search tables, on the executors."""
        part = self.rows if self.n == 1 else self.rows.where(F.pmod(F.xxhash64("k", "i", "t"), F.lit(self.n)) == i)
        return self.rows.sparkSession.sparkContext.broadcast(WuManber(((r["k"], bytes(r["t"])) for r in part.select("k", "t").collect()), window))


def _found(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document: its row number and key, its words, hit runs and the names of occurring items."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), text_bytes(text).alias("t"))
    blocks = _Blocks(items, item_key, item_text, block_bytes, window)

    def run(matcher):
        def scan(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            machine = matcher.value
            for batch in found:
                n_words, begins, ends, names = [], [], [], []
                for t in batch.column("t").to_pylist():
                    words = words_of(t)
                    spans, owners = machine.search(words)
                    n_words.append(len(words))
                    begins.append([b for b, _ in spans])
                    ends.append([e for _, e in spans])
                    names.append(sorted({machine.names[i] for i in owners} - {None}))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), batch.column("k"), pa.array(n_words, pa.int64()), pa.array(begins, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))],
                    ["row", "k", "n_words", "begins", "ends", "names"],
                )

        return rows.mapInArrow(scan, f"row long, k {kind}, n_words long, begins array<int>, ends array<int>, names array<string>")

    if blocks.n == 1:
        return run(blocks.matcher(0, window))
    found = None
    for i in range(blocks.n):  # no two blocks' tables are held at once
        matcher = blocks.matcher(i, window)
        part = run(matcher)
        part = materialize(part if i == 0 else part.where(F.size("begins") > 0), "decontam-block")
        matcher.destroy()
        found = part if found is None else found.unionByName(part)
    # only runs and names travel; a document's blocks meet by its row
    found = found.groupBy("row", "k").agg(F.max("n_words").alias("n_words"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("begins", "ends")), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
    return found


def _hits() -> Column:
    """Words inside the runs; runs of different blocks may overlap."""
    return F.aggregate(
        F.array_sort(F.arrays_zip("begins", "ends")),
        F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n")),
        lambda a, s: F.struct(F.greatest(a["to"], s["ends"]).alias("to"), (a["n"] + F.greatest(F.lit(0), s["ends"] - F.greatest(a["to"], s["begins"]))).alias("n")),
    )["n"]


def judge(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every document with n_words, n_hit, n_items, items_sha256, contaminated, and the hit word runs."""
    found = _found(docs, items, window, key, text, item_key, item_text, block_bytes).withColumn("n_hit", _hits()).withColumn("names", F.array_sort("names"))
    return found.select(
        F.col("k").alias(key),
        "n_words",
        "n_hit",
        F.size("names").cast("long").alias("n_items"),
        F.sha2(F.array_join("names", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.array_sort(F.arrays_zip("begins", "ends")).alias("word_spans"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents, all columns kept, without those that are contaminated."""
    blocks = _Blocks(items, item_key, item_text, block_bytes, window)
    matcher = blocks.matcher(0, window) if blocks.n == 1 else None
    place = docs.columns.index(text)

    def keep(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = matcher.value
        for batch in found:
            mask = []
            for t in batch.column(place).cast(pa.binary()).to_pylist():
                words = words_of(t)
                hit = sum(end - begin for begin, end in machine.search(words)[0])
                mask.append(not (hit and 20 * hit >= len(words)))
            yield batch.filter(pa.array(mask, pa.bool_()))

    if blocks.n == 1:
        return docs.mapInArrow(keep, docs.schema)
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    kept = materialize(numbered, "decontam")
    found = _found(kept.select(F.col("__row").alias("row"), text), items, window, "row", text, item_key, item_text, block_bytes).withColumn("n_hit", _hits())
    bad = found.where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).select(F.col("k").alias("__row"))
    return kept.join(bad, "__row", "left_anti").drop("__row")
