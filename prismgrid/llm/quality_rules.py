"""Quality rules whose thresholds adapt to each language and source.

Every document's counts go into mergeable quantile sketches, one for each (lang, source) and measure: counts of
values in buckets whose borders grow by a fixed ratio, so two sketches merge by adding counts, the same data give
the same sketch in any order, and any quantile is right to ``ACCURACY`` of its value. Fences drawn from the
group's own quantiles replace fixed cutoffs; they are joined back to the documents' counts and filter them.

A fence lies ``REACH`` quartile distances outside a quartile. Where the quartiles coincide (most documents have no
symbol at all), it lies ``REACH`` times as far outside the outer decile as that is from the quartile. No level is
given from outside; all that is allowed for is the sketch's own error where values coincide and ``EVENTS``
occurrences, since so few say nothing about a text of any length.

Defined results: null or word-less texts have no words and fail the base rule; null lang or source is a group of
its own; a group of any size has fences, one document's included; repeated rows count each; an empty table gives an
empty result; other columns are ignored.

A group may hold any share of the rows and there may be any number of groups: fences are broadcast whole up to
``MOST_BYTES``; beyond, only those of groups with over a ``1 / HOT_PARTS`` of all rows are (fewer than
``HOT_PARTS``), and the rest meet their rows in a shuffle that no such group takes part in.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prismgrid.llm.common import text_string
from prismgrid.storage import materialize

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW_WORDS = 5
#: Relative error of a sketch's quantiles.
ACCURACY = 0.01
#: Fences lie this many quartile distances outside the quartiles.
REACH = 4.0
#: Bytes of fences (ten numbers and two names a group) that may all be broadcast.
MOST_BYTES = 8 << 20
#: Beyond that, a group with more than one in so many rows is hot.
HOT_PARTS = 1000
#: Occurrences (symbols, repeated lines or words) beyond a fence that pass in a text of any length.
EVENTS = 2


def repeated_words(words: list[bytes], size: int = WINDOW_WORDS) -> int:
    """Words inside windows that occur twice or more, first occurrences included."""
    if len(words) <= size:
        return 0
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, to = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + size - max(to, i)
            to = i + size
    return covered


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines with a word."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen, dup, lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line.strip(WHITE):
            lines += 1
            dup += line in seen
            seen.add(line)
    chars = len(text) - (len(raw) - len(raw.translate(None, WHITE)))
    return len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), dup, repeated_words(words), lines


def counts(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """One row a document: its key ``k``, group columns ``lang`` and ``source``, and its counts."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    kinds = [docs.schema[c].dataType.simpleString() for c in (key, lang, source)]

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            rows = [measure(t) for t in batch.column(3).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, pa.int64()) for c in columns)], ["k", "lang", "source", *names])

    rows = docs.select(F.col(key).alias("k"), F.col(lang).alias("lang"), F.col(source).alias("source"), text_string(text).alias("t"))
    return rows.mapInArrow(run, f"k {kinds[0]}, lang {kinds[1]}, source {kinds[2]}, " + ", ".join(f"{n} long" for n in names))


def measures() -> dict[str, tuple[Column, Column, int]]:
    """What a row of ``counts`` has of each measure, of how many, and the occurrences that pass beyond a fence."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "symbols_per_word": (F.col("n_symbols"), words, EVENTS),
        "dup_line_share": (F.col("n_dup_lines"), lines, EVENTS),
        "repeat_share": (F.col("n_repeat_words"), words, EVENTS),
        "word_length": (F.col("word_chars"), words, 0),
    }


def sketch(counted: DataFrame) -> DataFrame:
    """lang, source, measure, bucket, n. Sketches of parts of the data merge by summing n."""
    grow = math.log((1 + ACCURACY) / (1 - ACCURACY))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), (n / of).alias("v")) for k, (n, of, _) in measures().items())))
    bucket = F.when(F.col("m.v") > 1e-6, F.ceil(F.log(F.col("m.v")) / grow).cast("int"))  # none: zero
    rows = counted.where("n_words > 0").select("lang", "source", each.alias("m"))
    return rows.groupBy("lang", "source", F.col("m.measure").alias("measure"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, at: dict[str, float]) -> DataFrame:
    """lang, source, measure and the named quantiles."""
    ratio = (1 + ACCURACY) / (1 - ACCURACY)
    group = Window.partitionBy("lang", "source", "measure")
    order = group.orderBy(F.asc_nulls_first("bucket")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(2 * F.pow(F.lit(ratio), F.col("bucket")) / (ratio + 1))
    ranked = sketches.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(group)).withColumn("value", value)
    return ranked.groupBy("lang", "source", "measure").agg(*(F.min(F.when(F.col("upto") >= F.ceil(F.col("total") * q), F.col("value"))).alias(name) for name, q in at.items()))


def fences(sketches: DataFrame) -> DataFrame:
    """lang, source, n (its rows) and, for each measure, the least and most that passes."""
    names = list(measures())
    sizes = sketches.where(F.col("measure") == names[0]).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    sizes = sizes.withColumnsRenamed({"lang": "n_lang", "source": "n_source"})
    q = quantiles(sketches, {"d1": 0.1, "q1": 0.25, "q3": 0.75, "d9": 0.9})
    spread, wide = REACH * (F.col("q3") - F.col("q1")), F.col("q3") > F.col("q1")
    least = F.when(wide, F.col("q1") - spread).otherwise((1 - 2 * ACCURACY) * (F.col("d1") - REACH * (F.col("q1") - F.col("d1"))))
    most = F.when(wide, F.col("q3") + spread).otherwise((1 + 2 * ACCURACY) * (F.col("d9") + REACH * (F.col("d9") - F.col("q3"))))
    q = q.withColumn("least", least).withColumn("most", most)
    sides = q.groupBy("lang", "source").agg(*(F.max(F.when(F.col("measure") == k, F.col(side))).alias(f"{k}_{side}") for k in names for side in ("least", "most")))
    return sides.join(sizes, sides["lang"].eqNullSafe(sizes["n_lang"]) & sides["source"].eqNullSafe(sizes["n_source"])).drop("n_lang", "n_source")


def _fenced(counted: DataFrame, cut: DataFrame, most: int = MOST_BYTES, parts: int = HOT_PARTS) -> DataFrame:
    """Each row of ``counted`` beside its group's fences."""
    same = lambda other: counted["lang"].eqNullSafe(other["g_lang"]) & counted["source"].eqNullSafe(other["g_source"])
    name = lambda c: F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    size, rows = cut.agg(F.sum(F.lit(80) + name("g_lang") + name("g_source")), F.sum("n")).first()
    if (size or 0) <= most:
        return counted.join(F.broadcast(cut), same(cut), "left")
    hot, rest = cut.where(F.col("n") * parts > rows), cut.where(F.col("n") * parts <= rows)
    wordy = counted.where("n_words > 0")  # rows without words fail whatever the fences, and no group counts them
    out = wordy.join(F.broadcast(hot), same(hot)).unionByName(wordy.join(F.broadcast(hot), same(hot), "left_anti").join(rest, same(rest), "left"))
    return out.unionByName(counted.where("n_words = 0"), allowMissingColumns=True)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", most_bytes: int = MOST_BYTES, hot_parts: int = HOT_PARTS) -> DataFrame:
    """Every document's counts, base verdict and final verdict."""
    counted = materialize(counts(docs, key, text, lang, source), "quality-counts")
    sketches = materialize(sketch(counted), "quality-sketches")
    cut = materialize(fences(sketches).withColumnsRenamed({"lang": "g_lang", "source": "g_source"}), "quality-fences")
    joined = _fenced(counted, cut, most_bytes, hot_parts)
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    inside = F.lit(True)
    for name, (n, of, events) in measures().items():
        inside = inside & F.coalesce(n.between(F.col(f"{name}_least") * of - events, F.col(f"{name}_most") * of + events), F.lit(True))
    return joined.select(F.col("k").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & inside).alias("kept"))
