"""Removal of byte strings of a fixed length that start at two or more places of the corpus.

A suffix array of everything would need everything in one place, so texts are first cut down to what can match:

1. Every ``length``-byte window names an anchor, the least hash among its ``GRAM``-byte strings (leftmost if tied).
   Equal windows name equal anchors, so only places that share an anchor can match. Each anchor travels as a hash,
   a hash of the bytes that any window over it can reach, and a place.
2. Places whose reachable bytes are equal match in whole; this is counted, with partial counts before the shuffle,
   so a passage with any number of copies is one row. Anchors with several contexts keep one place of each.
3. Those contexts meet by anchor. Windows over an anchor are narrowed by halves to families that share a core; a
   family with one member is unique, members equal in all the family's bytes match, and the rest is decided by a
   suffix array of the bytes beside the core (the core stands as one marker).
4. The suffix array is built by two-stage sorting: only suffixes smaller than their successors are sorted directly,
   the others are induced by one scan of the buckets. Common prefixes of neighbours in that order are computed;
   neighbours whose common prefix spans a window match.

An anchor with more than ``GROUP`` contexts is first dealt out by the cores of its halved families, again and again,
so no task holds an unbounded group; contexts with over a ``1 / HOT_PARTS`` of all places (fewer than ``HOT_PARTS``)
are broadcast to their places instead of meeting them in one task. Equality is by 128-bit digests. Texts are written once in buckets of their row number, so places and results
meet them where they are, at every size; only lists of anchors are broadcast, up to ``SMALL_ROWS`` rows.

Defined results: null text is empty; texts shorter than ``length`` are kept whole; copies inside one text count;
repeated rows are copies of each other; null keys are kept; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismgrid.llm.common import materialize_by, text_bytes
from prismgrid.storage import materialize

LENGTH = 400
GRAM = 128
#: Contexts of one anchor that one task takes.
GROUP = 4000
#: Bytes of texts whose suffixes are sorted at once.
CHUNK = 1 << 19
#: A family this narrow goes to the suffix array.
NARROW = 48
#: Rows of two or four numbers that may be broadcast.
SMALL_ROWS = 1_000_000
#: What has more than one in so many rows is met by broadcast.
HOT_PARTS = 1000
_STRIDE = 1 << 18


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    p = 0x9E3779B97F4A7C15
    up = np.cumprod(np.full(_STRIDE, p, np.uint64))
    return up, np.cumprod(np.full(_STRIDE, pow(p, -1, 1 << 64), np.uint64))


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[list[int], list[int]]:
    """Places and hashes of the anchors of all windows, in order. Long texts are read in overlapping strides."""
    if len(text) < length:
        return [], []
    up, down = _powers()
    places, hashes, last = [], [], -1
    width = length - gram + 1
    for base in range(0, len(text) - length + 1, _STRIDE - length + 1):
        x = np.frombuffer(text, np.uint8, min(_STRIDE, len(text) - base), base).astype(np.uint64) + np.uint64(1)
        total = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * up[: len(x)], out=total[1:])
        h = (total[gram:] - total[:-gram]) * down[: len(x) - gram + 1]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        v = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        least, size = v, 1
        while size * 2 <= width:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < width:
            least = np.minimum(least[: len(v) - width + 1], least[width - size : width - size + len(v) - width + 1])
        at = np.unique(least & np.uint64(0xFFFFFF)).astype(np.int64)
        for p, k in zip((at + base).tolist(), h[at].view(np.int64).tolist(), strict=True):
            if p > last:
                places.append(p)
                hashes.append(k)
        last = places[-1]
    return places, hashes


def _digest(data: bytes, salt: int, size: int = 16) -> bytes:
    return hashlib.blake2b(data, digest_size=size, salt=salt.to_bytes(4, "big", signed=True)).digest()


def two_stage(text: bytes, depth: int) -> list[int]:
    """Suffixes of ``text`` in order of their first ``depth`` bytes."""
    n = len(text)
    if not n:
        return []
    x = np.frombuffer(text, np.uint8).astype(np.int16)
    rise = np.append(np.sign(x[1:] - x[:-1]), -1)  # the last suffix is larger than the empty one
    place = np.where(rise != 0, np.arange(n), n)
    ahead = np.minimum.accumulate(place[::-1])[::-1]
    small = rise[ahead] > 0
    direct = sorted(np.flatnonzero(small).tolist(), key=lambda i: text[i : i + depth])
    size, smalls = np.bincount(x, minlength=256), np.bincount(x[small], minlength=256)
    ends = np.cumsum(size)
    order = np.full(n, -1, np.int64)
    if direct:
        offset = np.arange(len(direct)) - np.repeat(np.cumsum(smalls) - smalls, smalls)
        order[np.repeat(ends - smalls, smalls) + offset] = direct
    order, heads, large = order.tolist(), (ends - size).tolist(), (~small).tolist()
    order[heads[text[n - 1]]] = n - 1
    heads[text[n - 1]] += 1
    for p in range(n):
        j = order[p] - 1
        if j >= 0 and large[j]:
            c = text[j]
            order[heads[c]] = j
            heads[c] += 1
    return order


def common_prefixes(text: bytes, order: np.ndarray, depth: int) -> np.ndarray:
    """Bytes, up to ``depth`` or somewhat more, that each suffix in ``order`` shares with the next one."""
    x = np.zeros(len(text) + 16 + depth, np.uint64)
    x[: len(text)] = np.frombuffer(text, np.uint8)
    ends = len(text) - np.maximum(order[:-1], order[1:])
    word = np.zeros(len(x) - 8, np.uint64)  # the eight bytes from each place on
    for i in range(8):
        word |= x[i : i + len(word)] << np.uint64(8 * i)
    shared, open_ = np.zeros(max(0, len(order) - 1), np.int64), np.arange(max(0, len(order) - 1))
    for at in range(0, depth, 8):
        if not len(open_):
            break
        differ = word[np.minimum(order[open_] + at, len(word) - 1)] ^ word[np.minimum(order[open_ + 1] + at, len(word) - 1)]
        low = differ & (~differ + np.uint64(1))  # its lowest bit
        shared[open_] += np.where(differ == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) >> 3)
        open_ = open_[differ == 0]
    return np.minimum(shared, ends)


class Piece:
    """A context: the bytes ``data`` around an anchor that ``left`` bytes precede, and the windows that match."""

    __slots__ = ("name", "data", "left", "weight", "found")

    def __init__(self, name, data: bytes, left: int, weight: int):
        self.name, self.data, self.left, self.weight, self.found = name, data, left, weight, []

    def valid(self, low: int, high: int, length: int) -> tuple[int, int]:
        return max(low, -self.left), min(high, len(self.data) - self.left - length)

    def whole(self, low: int, high: int, length: int) -> tuple[int, bytes]:
        a, b = self.valid(low, high, length)
        return a, self.data[self.left + a : self.left + b + length]


class Matcher:
    """Windows that match among the pieces of many groups; suffixes of all groups' narrow families are sorted together."""

    def __init__(self, length: int = LENGTH):
        self.length, self.texts, self.starts, self.size, self.groups, self.depth = length, [], [], 0, 0, 0

    def add(self, pieces: list[Piece], low: int, high: int) -> None:
        todo = [(low, high, pieces)]
        while todo:
            low, high, members = todo.pop()
            families = defaultdict(list)
            for p in members:
                a, b = p.valid(low, high, self.length)
                if a <= b:
                    families[p.data[p.left + high : p.left + low + self.length]].append(p)
            middle = (low + high) // 2
            for family in families.values():
                if len(family) == 1:
                    continue
                equal = defaultdict(list)
                for p in family:
                    equal[p.whole(low, high, self.length)].append(p)
                for same in equal.values():
                    if len(same) > 1:
                        for p in same:
                            p.found.append(p.valid(low, high, self.length))
                if len(equal) == 1:
                    continue
                first = [same[0] for same in equal.values()]  # if more are equal, all its windows are found already
                if all(len(same) > 1 or same[0].weight > 1 for same in equal.values()):
                    continue
                if high - low <= NARROW:
                    self._queue(first, low, high)
                else:
                    todo += [(low, middle, first), (middle + 1, high, first)]

    def _queue(self, family: list[Piece], low: int, high: int) -> None:
        n, marker = self.groups, bytes([0xFF, self.groups >> 14 & 0x7F, self.groups >> 7 & 0x7F, self.groups & 0x7F])
        self.groups, self.depth = n + 1, max(self.depth, high - low + len(marker))
        for p in family:
            a, b = p.valid(low, high, self.length)
            text = p.data[p.left + a : p.left + high] + marker + p.data[p.left + low + self.length : p.left + b + self.length]
            self.texts.append(text)
            self.starts.append((self.size, a, b, high - low + len(marker), p))
            self.size += len(text)

    def sort(self) -> None:
        """Decide what is queued."""
        text = b"".join(self.texts)
        owner = np.zeros(len(text), np.int64)
        for k, (at, a, b, _, _) in enumerate(self.starts):
            owner[at : at + b - a + 1] = k + 1
        order = np.array(two_stage(text, self.depth), np.int64)
        order = order[owner[order] > 0]
        need = np.array([0, *(size for _, _, _, size, _ in self.starts)])[owner[order]]
        equal = np.flatnonzero(common_prefixes(text, order, self.depth) >= need[1:])
        for i in np.unique(order[np.concatenate([equal, equal + 1])]).tolist():
            at, a, _, _, p = self.starts[owner[i] - 1]
            j = a + i - at
            if p.found and p.found[-1][1] == j - 1 and p.found[-1][0] <= j:
                p.found[-1] = (p.found[-1][0], j)
            else:
                p.found.append((j, j))
        self.texts, self.starts, self.size, self.groups, self.depth = [], [], 0, 0, 0


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint runs, in order, of half-open spans; touching ones join."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _match(length: int, chunk: int):
    """Contexts sorted by group to (a, sh, low, high): bytes to remove, relative to the anchor."""
    names = ["a", "sh", "low", "high"]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            matcher.sort()
            rows = [(*p.name, a, b) for p in done for a, b in merged([(x, y + length) for x, y in p.found])]
            done.clear()
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.int32()), strict=True)], names)

        matcher, done, group, members = Matcher(length), [], None, []
        held = 0
        for batch in found:
            for key, low, high, a, sh, left, weight, data in zip(*(batch.column(x).to_pylist() for x in ("key", "low", "high", "a", "sh", "left", "weight", "data")), strict=True):
                if (key, low, high) != group:
                    if members:
                        matcher.add(members, *group[1:])
                        done += [p for p in members if p.weight == 1]
                    group, members = (key, low, high), []
                    if matcher.size > chunk or held > 16 * chunk:
                        yield flush()
                        held = 0
                members.append(Piece((a, sh), data, left, weight))
                held += len(data)
        if members:
            matcher.add(members, *group[1:])
            done += [p for p in members if p.weight == 1]
        yield flush()

    return run


def _deal(length: int):
    """Contexts of large groups to their two halves, grouped by core."""
    names = ["key", "low", "high", "a", "sh", "left", "weight", "data", "same"]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                out = {x: [] for x in names}
                for key, low, high, a, sh, left, weight, data in zip(*(part.column(x).to_pylist() for x in names[:-1]), strict=True):
                    middle = (low + high) // 2
                    for x, y in ((low, middle), (middle + 1, high)):
                        first, last = max(x, -left), min(y, len(data) - left - length)
                        if first > last:
                            continue
                        core = data[left + y : left + x + length]
                        cut = max(0, left + x)
                        new = data[cut : left + y + length]
                        for name, value in zip(names, (int.from_bytes(_digest(core, x, 8), "big", signed=True) ^ key, x, y, a, sh, left - cut, weight, new, _digest(new, left - cut)), strict=True):
                            out[name].append(value)
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(out[x], k) for x, k in zip(names, kinds, strict=True)], names)

    return run


def _small(df: DataFrame) -> DataFrame:
    """``df``, rows of a few numbers, marked for broadcast if it is within the bound."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _met(many: DataFrame, few: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """``many`` joined to ``few`` by ``keys``; the keys in ``hot``, which are few and have a row each, by broadcast."""
    hot = F.broadcast(hot)
    return many.join(hot, keys).unionByName(many.join(hot.select(keys), keys, "left_anti").join(few.join(hot.select(keys), keys, "left_anti"), keys))


def _places(whole: DataFrame, length: int, gram: int) -> DataFrame:
    """a, sh, row, places: each anchor of each text with a hash of its context."""
    reach, names = length - gram, ["a", "sh", "row", "places"]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                seen: dict[tuple[int, bytes, int], list[int]] = defaultdict(list)
                for row, text in zip(part.column("row").to_pylist(), part.column("t").to_pylist(), strict=True):
                    for p, a in zip(*anchors(text, length, gram), strict=True):
                        low = max(0, p - reach)
                        seen[a, _digest(text[low : p + length], p - low), row].append(p)
                columns = list(zip(*seen, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.binary(), pa.int64()), strict=True)), pa.array(list(seen.values()), pa.list_(pa.int32()))], names)

    return whole.select("row", "t").mapInArrow(run, "a long, sh binary, row long, places array<int>")


def _contexts(whole: DataFrame, reps: DataFrame, length: int, gram: int) -> DataFrame:
    """The bytes around each place in ``reps`` (a, sh, weight, row, place)."""
    reach, names = length - gram, ["key", "low", "high", "a", "sh", "left", "weight", "data"]
    asked = reps.groupBy("row").agg(F.collect_list(F.struct("a", "sh", "weight", "place")).alias("asked"))

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                rows = []
                for text, asked in zip(part.column("t").to_pylist(), part.column("asked").to_pylist(), strict=True):
                    for x in asked:
                        low = max(0, x["place"] - reach)
                        rows.append((x["a"], -reach, 0, x["a"], x["sh"], x["place"] - low, x["weight"], text[low : x["place"] + length]))
                columns = list(zip(*rows, strict=True)) or [[]] * 8
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    met = whole.select("row", "t").join(asked.hint("shuffle_hash"), "row")
    return met.select("t", "asked").mapInArrow(run, "key long, low int, high int, a long, sh binary, left int, weight long, data binary")


def contexts(places: DataFrame) -> DataFrame:
    """a, sh, weight, rep: how many places each context has, and one of them."""
    return materialize(places.groupBy("a", "sh").agg(F.sum(F.size("places")).alias("weight"), F.min(F.struct("row", F.col("places")[0].alias("place"))).alias("rep")), "dedup-contexts")


def matches(whole: DataFrame, stats: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """a, sh, low, high: bytes around the anchor to remove wherever this context stands."""
    reach = length - gram
    out = stats.where("weight > 1").select("a", "sh", F.lit(-reach).alias("low"), F.lit(length).alias("high"))
    several = stats.groupBy("a").agg(F.count("*").alias("n"), F.count(F.when(F.col("weight") == 1, 1)).alias("single")).where("n > 1 and single > 0")
    several = materialize(several, "dedup-anchors")
    reps = stats.join(_small(several.select("a", "n")), "a").select("a", "sh", "weight", F.col("rep.row").alias("row"), F.col("rep.place").alias("place"), "n")
    reps = materialize(reps, "dedup-reps")
    ready = _contexts(whole, reps.where(F.col("n") <= group), length, gram)
    large, keys, columns = reps.where(F.col("n") > group), ["key", "low", "high"], ready.columns
    left = None if large.isEmpty() else materialize(_contexts(whole, large, length, gram), "dedup-large")  # else two Python workers would share a task
    while left is not None:
        dealt = materialize(left.mapInArrow(_deal(length), "key long, low int, high int, a long, sh binary, left int, weight long, data binary, same binary"), "dedup-dealt")
        by = materialize(dealt.groupBy(*keys, "same").agg(F.sum("weight").alias("weight"), F.count("*").alias("pieces")), "dedup-families")
        pieces = by.agg(F.sum("pieces")).first()[0] or 0
        several_ = by.where("weight > 1").select(*keys, "same", "pieces")
        whole_match = _met(dealt.drop("weight", "data"), several_, [*keys, "same"], several_.where(F.col("pieces") * HOT_PARTS > pieces))
        out = out.unionByName(whole_match.select("a", "sh", F.greatest(F.col("low"), -F.col("left")).alias("low"), (F.col("high") + length).alias("high")))
        open_ = by.groupBy(*keys).agg(F.count("*").alias("n"), F.count(F.when(F.col("weight") == 1, 1)).alias("single")).where("n > 1 and single > 0")
        open_ = materialize(open_.drop("single"), "dedup-open")
        undecided = dealt.join(_small(open_), keys)  # before any bytes are shuffled
        first = undecided.groupBy(*keys, "same").agg(F.min(F.struct("a", "sh", "left", "data")).alias("x"), F.sum("weight").alias("weight"), F.max("n").alias("n"))
        first = materialize(first.select(*keys, "x.a", "x.sh", "x.left", "weight", "x.data", "n"), "dedup-first")
        ready = ready.unionByName(first.where(F.col("n") <= group).select(columns))
        left = None if first.where(F.col("n") > group).isEmpty() else first.where(F.col("n") > group).select(columns)
    found = ready.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high").mapInArrow(_match(length, chunk), "a long, sh binary, low int, high int")
    return out.unionByName(found)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, group: int = GROUP, chunk: int = CHUNK, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """Every document's removed runs in figures, the digest of what is left and, if asked for, the bytes left."""
    kind = docs.schema[key].dataType.simpleString()
    whole = materialize_by(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("k"), text_bytes(text).alias("t")), "dedup-texts", "row")
    places = materialize(_places(whole, length, gram), "dedup-places")
    stats = contexts(places)
    marks = matches(whole, stats, length, gram, group, chunk).groupBy("a", "sh").agg(F.collect_list(F.struct("low", "high")).alias("marks"))  # a few of each context
    total = stats.agg(F.sum("weight")).first()[0] or 0
    hot = stats.where((F.col("weight") > 1) & (F.col("weight") * HOT_PARTS > total)).select("a", "sh", F.array(F.struct(F.lit(gram - length).alias("low"), F.lit(length).alias("high"))).alias("marks"))
    spans = _met(places, marks, ["a", "sh"], hot).select("row", F.explode("places").alias("p"), "marks")
    spans = spans.groupBy("row").agg(F.flatten(F.collect_list(F.transform("marks", lambda m: F.struct((m["low"] + F.col("p")).alias("a"), (m["high"] + F.col("p")).alias("b"))))).alias("spans"))
    spans = materialize(spans, "dedup-spans")
    names = ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                out = {x: [] for x in names[1:]}
                for t, spans in zip(part.column("t").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    runs = merged([(max(0, s["a"]), min(len(t), s["b"])) for s in spans or ()])
                    at, left = 0, []
                    for a, b in runs:
                        left.append(t[at:a])
                        at = b
                    left = b"".join([*left, t[at:]])
                    for name, value in zip(names[1:], (len(t), len(t) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left if with_text else None), strict=True):
                        out[name].append(value)
                yield pa.RecordBatch.from_arrays([part.column("k"), *(pa.array(out[x], pa.int64()) for x in names[1:4]), pa.array(out["kept_sha256"], pa.string()), pa.array(out["kept"], pa.binary())], names)

    met = whole.join(spans.hint("shuffle_hash"), "row", "left").select("k", "t", "spans")
    done = met.mapInArrow(cut, f"k {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done.select(F.col("k").alias(key), *names[1:5], *(["kept"] if with_text else []))
