"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Distinct fingerprints (not documents) are compared. Two that differ in at most two of 64 bits agree on two of four
16-bit blocks, so the six pairs of blocks deal them into buckets and no link is lost. Inside a bucket fingerprints
are sorted by population count, cut into tiles, tile pairs whose counts differ beyond the radius are skipped, and
the rest compared whole with exclusive-or and bit counts. A bucket beyond ``BUCKET`` fingerprints is dealt anew by
thirds of its remaining bits (again without loss), twice at most: 15 bits are then free, so a bucket has at most
32,768 fingerprints. Each bucket yields a spanning star for each of its own components; the components of all
stars are found by repeated contraction to the least neighbour, in joins and aggregations only.

Defined results: null, empty and word-less texts have fingerprint zero and link like any other; fewer words than a
shingle make one shingle; repeated rows stay, each with its component; a null doc_id is no component's name unless
the component has no other; an empty table gives an empty result; other columns are ignored (kept by
``drop_near_copies``).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismgrid.llm.common import text_bytes
from prismgrid.storage import materialize

SHINGLE = 3
RADIUS = 2
SEED = 42
TILE = 1024
#: Fingerprints in a bucket before it is dealt anew.
BUCKET = 4096
_FULL = (1 << 64) - 1


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        parts = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-shingle] + 1])
        parts = [joined[a:b] for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, parts, repeat(SEED))), np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The key as ``k`` and the fingerprint's 64 bits as ``fp`` (signed) of every document."""
    kind = docs.schema[key].dataType.simpleString()

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            made = [_signed(fingerprint(t, shingle)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], ["k", "fp"])

    return docs.select(F.col(key).alias("k"), text_bytes(text).alias("t")).mapInArrow(run, f"k {kind}, fp long")


def components_of(values: np.ndarray, radius: int = RADIUS, tile: int = TILE) -> np.ndarray:
    """For each of the distinct ``values`` (uint64), the place of the first one in its component."""
    n = len(values)
    if n == 2:
        return np.array([0, 0 if int(values[0] ^ values[1]).bit_count() <= radius else 1])
    weight = np.bitwise_count(values).astype(np.int64)
    order = np.argsort(weight, kind="stable")
    values, weight = values[order], weight[order]
    label = np.arange(n)
    bounds = [(a, min(n, a + tile)) for a in range(0, n, tile)]
    near = [(a, b, c, d) for i, (a, b) in enumerate(bounds) for c, d in bounds[i:] if weight[c] - weight[b - 1] <= radius]
    changed = True
    while changed:
        before = label.copy()
        for a, b, c, d in near:
            linked = np.bitwise_count(values[a:b, None] ^ values[None, c:d]) <= radius
            least = np.where(linked, label[None, c:d], n).min(axis=1)
            label[a:b] = np.minimum(label[a:b], least)
            least = np.where(linked, label[a:b, None], n).min(axis=0)
            label[c:d] = np.minimum(label[c:d], least)
        for _ in range(3):
            np.minimum.at(label, before, label)
            label = np.minimum(label, label[label])
        changed = not np.array_equal(before, label)
    first = np.full(n, n)
    np.minimum.at(first, label, order)
    out = np.empty(n, np.int64)
    out[order] = first[label]
    return out


def _stars(radius: int):
    """Bucket rows, sorted by bucket, to edges (a: a component's first fingerprint, b: another of its)."""

    def star(values: list[int]) -> tuple[list[int], list[int]]:
        found = np.array(values, np.int64)
        first = components_of(found.view(np.uint64), radius)
        other = np.flatnonzero(first != np.arange(len(found)))
        return found[first[other]].tolist(), found[other].tolist()

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for batch in found:
            a, b = [], []
            for mask, value, fp in zip(*(batch.column(x).to_pylist() for x in ("mask", "value", "fp")), strict=True):
                if (mask, value) != bucket:
                    if len(held) > 1:
                        x, y = star(held)
                        a += x
                        b += y
                    bucket, held = (mask, value), []
                held.append(fp)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        x, y = star(held) if len(held) > 1 else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return run


def _parts(bits: list[int], n: int) -> list[int]:
    """Masks of ``n`` nearly equal parts of the bit places."""
    cuts = [len(bits) * i // n for i in range(n + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def _masks(radius: int) -> tuple[list[int], dict[int, list[int]], dict[int, list[int]]]:
    """Bucket masks, and for each the masks that deal it anew, for two further levels."""
    blocks = _parts(list(range(64)), radius + 2)
    top = [x | y for x, y in combinations(blocks, 2)]

    def below(masks: list[int]) -> dict[int, list[int]]:
        return {m: [m | p for p in _parts([b for b in range(64) if not m >> b & 1], radius + 1)] for m in masks}

    second = below(top)
    return top, second, below([m for x in second.values() for m in x])


def edges(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Spanning edges between the distinct fingerprints in column ``fp``."""
    top, *levels = _masks(radius)
    deal = lambda rows, masks: rows.select("fp", F.explode(masks).alias("mask")).withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
    rows, out = deal(distinct.select("fp"), F.array(*(F.lit(_signed(m)) for m in top))), None
    for level in range(3):
        shared = materialize(rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
        fit = shared if level == 2 else shared.where(F.col("n") <= bucket)
        found = rows.join(fit.drop("n"), ["mask", "value"], "left_semi").repartition("mask", "value").sortWithinPartitions("mask", "value", "fp").mapInArrow(_stars(radius), "a long, b long")
        out = found if out is None else out.unionByName(found)
        if level == 2 or shared.where(F.col("n") > bucket).isEmpty():
            break
        masks = F.create_map(*(x for m, below in levels[level].items() for x in (F.lit(_signed(m)), F.array(*(F.lit(_signed(b)) for b in below)))))
        large = rows.join(shared.where(F.col("n") > bucket).drop("n"), ["mask", "value"], "left_semi")
        rows = materialize(deal(large.withColumnRenamed("mask", "wide"), masks[F.col("wide")]), "simhash-dealt")
    return out.distinct()


def contract(links: DataFrame) -> DataFrame:
    """Vertex ``v`` and its component's ``root`` for every vertex of the links (a, b)."""
    links, steps = materialize(links, "links"), []
    while not links.isEmpty():
        ends = links.select(F.col("a").alias("v"), F.col("b").alias("w")).unionByName(links.select(F.col("b").alias("v"), F.col("a").alias("w")))
        step = materialize(ends.groupBy("v").agg(F.least(F.col("v"), F.min("w")).alias("to")), "step")
        steps.append(step)
        to = lambda side: step.select(F.col("v").alias(side), F.col("to").alias(f"to_{side}"))  # noqa: E731, B023
        moved = links.join(to("a"), "a").join(to("b"), "b").where("to_a != to_b")
        links = materialize(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
    if not steps:
        return links.select(F.col("a").alias("v"), F.col("b").alias("root"))
    roots = steps[0].withColumnRenamed("to", "root")
    for step in steps[1:]:
        roots = roots.join(step.select(F.col("v").alias("root"), "to"), "root", "left").select("v", F.coalesce("to", "root").alias("root"))
    return roots


def groups(marked: DataFrame, least, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Each distinct ``fp`` of ``marked`` and ``least``, an aggregate, over all rows of its component."""
    distinct = materialize(marked.groupBy("fp").agg(least.alias("least")), "fingerprints")
    roots = contract(edges(distinct, radius, bucket))
    placed = distinct.join(roots, distinct["fp"] == roots["v"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    whole = placed.groupBy("root").agg(F.min("least").alias("least"))
    return placed.drop("least").join(whole, "root").select("fp", "least")


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Every document's fingerprint and component."""
    marked = materialize(fingerprints(docs, key, text, shingle), "simhash")
    found = marked.join(groups(marked, F.min("k"), radius, bucket), "fp")
    return found.select(F.col("k").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """The documents, all columns kept, with one row of each component: the least key, then the first row."""
    place = docs.columns.index(text)
    names = [*docs.columns, "__row", "__fp"]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            made = [_signed(fingerprint(t or b"", shingle)) for t in batch.column(place).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.int64())], names)

    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    whole = materialize(numbered.mapInArrow(run, T.StructType([*numbered.schema.fields, T.StructField("__fp", T.LongType())])), "simhash-docs")
    marked = whole.select(F.col("__fp").alias("fp"), F.struct(F.col(key).isNull().alias("x"), F.col(key).alias("k"), F.col("__row").alias("row")).alias("name"))
    first = groups(marked, F.min("name"), radius, bucket).select(F.col("fp").alias("__fp"), F.col("least.row").alias("__first"))
    extra = whole.select("__row", "__fp").join(first, "__fp").where("__row != __first").select("__row")
    return whole.join(extra, "__row", "left_anti").select(*docs.columns)
