"""The pipeline's stages on odd tables, against what the operators' plain restatements keep."""

import re

import corpus_pipeline
import pytest

from prismgrid.llm import classifier, secrets, simhash, tokens

from .data import SCHEMA, collected, empty, frame, rows
from .test_operators import _components, _fingerprint, _library


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, small_dir):
    """A folder with odd documents and labels and the small benchmark."""
    base = tmp_path_factory.mktemp("tables")
    frame(spark).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(d[0], int(i % 5 > 0), 0) for i, d in enumerate(rows())] + [(None, 1, 0), (3, None, None), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, rows()[7][1]), (2, None), (None, "x")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "simhash near-dedup", "benchmark decontamination", "secret scans", "packing"]


def test_each_stage_keeps_columns_and_takes_empty_tables(spark, tables):
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, frame(spark), tables)
        assert out.count() > 0
        if i < 4:
            assert out.schema.simpleString() == frame(spark).schema.simpleString(), name
        assert stage(spark, empty(spark), tables).count() == 0


def test_the_run_equals_the_stages_by_hand(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    verdict = classifier.judge(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    good = {}
    for r in verdict.collect():
        good.setdefault(r["doc_id"], []).append(r["predicted"])
    texts = [(d[0], d[1]) for d in rows()]
    by_id = [t for t in texts if t[0] not in (None, 7)]
    kept = corpus_pipeline.good_quality(spark, docs, tables)
    assert [t for t in collected(kept, "doc_id", "text") if t[0] not in (None, 7)] == sorted((t for t in by_id if good[t[0]] == [1]), key=repr)
    left = collected(kept, "doc_id", "text")
    label = _components([_fingerprint(t) for _, t in left])
    single = corpus_pipeline.without_near_copies(spark, kept, tables)
    assert single.count() == len(set(label))
    least = {x: min((d for (d, _), y in zip(left, label, strict=True) if x == y and d is not None), default=None) for x in label}
    assert sorted((r["doc_id"] for r in single.collect()), key=repr) == sorted(least.values(), key=repr)
    words = lambda t: re.findall(r"[a-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    item = words(rows()[7][1])
    windows = {tuple(item[i : i + 13]) for i in range(len(item) - 12)} if len(item) >= 13 else {tuple(item)}

    def contaminated(t):
        w, size = words(t), len(next(iter(windows)))
        hit = {i + k for i in range(len(w) - size + 1) if tuple(w[i : i + size]) in windows for k in range(size)} | {i for i, x in enumerate(w) if x == "x"}
        return bool(hit) and 20 * len(hit) >= len(w)

    clean = corpus_pipeline.without_benchmark(spark, single, tables)
    assert collected(clean, "doc_id", "text") == [t for t in collected(single, "doc_id", "text") if not contaminated(t[1])]
    safe = corpus_pipeline.without_secrets(spark, clean, tables)
    spans = {r["c0"]: r["spans"] for r in secrets.find(clean).collect()}
    assert {r["doc_id"] for r in safe.collect() if "[SECRET]" in (r["text"] or "")} == {k for k, v in spans.items() if v}
    pieces = corpus_pipeline.run(spark, tables).collect()
    assert sorted(((p["doc_id"], p["doc_tokens"]) for p in pieces if p["start"] == 0), key=repr) == sorted(((r["doc_id"], len(_library(r["text"])) + 1) for r in safe.collect()), key=repr)


def test_near_copies_with_null_keys_and_clashing_names(spark):
    docs = spark.createDataFrame([(None, "a b c d", None, None, 1, 0, "k", "t", 1, "w", "s"), (None, "A b c d", None, None, 1, 0, "k", "t", 1, "w", "s"), (5, "a b c d", None, None, 1, 0, "k", "t", 1, "w", "s")], SCHEMA)
    assert [r["doc_id"] for r in simhash.drop_near_copies(docs).collect()] == [5]
    assert tokens.pack(docs).count() == 3
