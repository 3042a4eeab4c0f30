"""The methods' parts: tables, splits and postings against plain restatements; very long texts."""

import random
import zlib
from collections import defaultdict
from math import isclose, log10

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismgrid.llm import brown, classifier, decontam, quality_rules, secrets, simhash, suffixdedup, tokens, urlfilter
from prismgrid.storage import materialize

from .data import collected, frame, rows
from .test_operators import _fingerprint, _removed


def test_wu_manber_finds_every_window():
    rng = random.Random(1)
    for _ in range(200):
        words = [f"w{i}".encode() for i in range(rng.randint(2, 30))]
        window = rng.randint(1, 14)
        items = [(str(i), b" ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(rng.randint(0, 5))]
        doc = rng.choices([*words, b"other"], k=rng.randint(0, 80))
        if items:
            doc += decontam.words_of(items[0][1])[:20]
        hit, owners = set(), set()
        for k, (_, text) in enumerate(items):
            w = decontam.words_of(text)
            size = min(window, len(w))
            for i in range(len(w) - size + 1 if size else 0):
                for a in range(len(doc) - size + 1):
                    if doc[a : a + size] == w[i : i + size]:
                        hit |= set(range(a, a + size))
                        owners.add(k)
        spans, found = decontam.WuManber(items, window).search(doc)
        assert {x for a, b in spans for x in range(a, b)} == hit and found == owners
        assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("size", [1, 7, 40, 1000])
def test_parts_of_an_item_have_its_windows_and_no_others(size):
    rng = random.Random(2)
    for n in (0, 1, 4, 5, 30):
        text = b", ".join(b"x" * rng.randint(1, 60) + str(rng.randint(0, 9)).encode() for _ in range(n))
        windows = lambda t: {tuple(w[i : i + 5]) for w in [decontam.words_of(t)] for i in range(max(1, len(w) - 4))} - {()}
        parts = list(decontam.parts_of(text, size, 5))
        assert set().union(*map(windows, parts)) == windows(text) and parts


def test_an_item_larger_than_a_block(spark):
    """5 MB in one item, split over several blocks; each window is found, the item named once, tables stay small."""
    rng = np.random.default_rng(3)
    words = [f"v{i:x}" for i in rng.integers(0, 1 << 40, 400_000)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[7:30])), (3, "tiny")], "item_id long, text string")
    at = [0, 5, 99_990, 200_000, 399_980]
    docs = spark.createDataFrame([(i, "none " + " ".join(words[a : a + 20]) + " of these") for i, a in enumerate(at)] + [(9, "clean words only"), (10, " ".join(words[:200_000]))], "doc_id long, text string")
    found = decontam.judge(docs, items, block_bytes=1 << 20)
    both = {0: 2, 1: 2, 10: 2}
    assert collected(found, "doc_id", "n_words", "n_hit", "n_items") == sorted([(i, 23, 20, both.get(i, 1)) for i in range(5)] + [(9, 3, 0, 0), (10, 200_000, 200_000, 2)], key=repr)
    kept = decontam.decontaminate(docs, items, block_bytes=1 << 20)
    assert [r["doc_id"] for r in kept.collect()] == [9]
    matcher = decontam.WuManber([("a", " ".join(words[:100_000]).encode())])
    held = sum(x.nbytes for t in matcher.tables for x in t if isinstance(x, np.ndarray)) + matcher.words.nbytes
    assert held < 40 * 100_000


def test_spellings_are_a_distribution(spark):
    counts = spark.createDataFrame([(b"abc", 1), (b"ab", 1), ("né".encode(), 1), (b"often", 9), (b"\n", 1)], "word binary, n long")
    table = brown.spelling(counts)
    allowed = [b for b in range(256) if b not in b" \t\x0b\x0c\r"]
    assert all(isclose(sum(10 ** table[a, b] for b in allowed if a != 10 or b != 10), 1) for a in allowed)
    by_hand = lambda w: sum(table[a, b] for a, b in zip(b"\n" + w, w + b"\n", strict=True))
    words = [b"abc", b"x", "né".encode(), b"zzzzzz"]
    assert np.allclose(brown.spelled(words, table), [by_hand(w) for w in words])
    assert by_hand(b"abc") > by_hand(b"qqq")
    assert np.isfinite(brown.spelled([b"x"], brown.spelling(counts.limit(0)))).all()


def test_brown_pays_unknown_words_their_spelling(spark):
    sizes = {"head_size": 40, "words": 20, "endings": 10, "classes": 8, "spell": True}
    docs = materialize(frame(spark), "t")
    model, counts = brown.fit(docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))), **sizes)
    n = {bytes(r["word"]): r["n"] for r in counts.collect()}
    number = lambda w: model.types.known.get(w, 20 + brown.ending(w, 10))
    texts, unknown = defaultdict(set), 0
    for d in rows():
        texts[d[0]].add(d[1])
    for r in [x for x in brown.score(docs, **sizes).collect() if len(texts[x["doc_id"]]) == 1]:
        w = (next(iter(texts[r["doc_id"]])) or "").encode().lower().split() + [b"\n"]
        c = [model.label[model.types.end], *(model.label[number(x)] for x in w)]
        by_hand = 0.0
        for a, b, x in zip(c, c[1:], w, strict=False):
            word = log10(n[x]) if x in n else model.unseen[b] + sum(model.spell[u, v] for u, v in zip(b"\n" + x, x + b"\n", strict=True))
            by_hand += model.step[a, b] + word - model.whole[b]
            unknown += x not in n
        assert isclose(r["score"], by_hand, abs_tol=1e-6)
    assert unknown > 50


def test_brown_prefers_known_words_to_gibberish(spark):
    plain, odd = "the cat sat on the mat and the dog sat on the rug", "xq zvk wqj pfz kkq vzx qqz jxw zkp qvv wzx pqk"
    data = [(i, plain if i % 7 else odd) for i in range(400)]
    ids = [i for i, _ in data if zlib.crc32(str(i).encode()) % 7 == 2]
    data = [(i, t) if i in ids else (i, plain) for i, t in data]
    found = brown.score(spark.createDataFrame(data, "doc_id long, text string"), spell=True).where("held_out").collect()
    each = {t: [r["score"] / r["n_tokens"] for r in found if dict(data)[r["doc_id"]] == t] for t in (plain, odd)}
    assert each[odd] and each[plain] and max(each[odd]) < min(each[plain]) - 2


def test_frequent_long_words_are_dealt_out_with_the_same_scores(spark, monkeypatch):
    url = "https://example.com/" + "a" * 80
    docs = spark.createDataFrame([(i, f"see {url} and w{i} {url}{i % 3}") for i in range(60)], "doc_id long, text string")
    names = ["doc_id", "n_tokens", "n_known", "base_score", "score"]
    near = lambda found: [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in collected(found, *names)]
    dealt = near(brown.score(docs))
    local = spark.createDataFrame([(i, w.encode()) for i in range(200) for w in (url, "short")], "row long, word binary")
    counts = spark.createDataFrame([(url.encode(), 200), (b"short", 200), (b"z" * 99, 1)], "word binary, n long")
    left, right = brown._dealt(local, counts, 5000)
    assert {r["salt"] for r in left.where(F.octet_length("word") > 64).collect()} == set(range(brown.SALTS))
    assert right.count() == brown.SALTS + 2 and left.join(right, ["word", "salt"]).count() == 400
    monkeypatch.setattr(brown, "HOT_PARTS", 0)
    assert near(brown.score(docs)) == dealt


def test_common_prefixes_of_sorted_suffixes():
    rng = random.Random(4)
    for n in (1, 2, 9, 300):
        text = bytes(rng.choices(b"ab", k=n))
        order = suffixdedup.two_stage(text, 20)
        plain = [next((k for k in range(n) if text[p + k : p + k + 1] != text[q + k : q + k + 1] or not text[p + k : p + k + 1]), n) for p, q in zip(order, order[1:], strict=False)]
        found = suffixdedup.common_prefixes(text, np.array(order, np.int64), 20)
        assert [min(x, 20) for x in found.tolist()] == [min(x, 20) for x in plain]


@pytest.mark.parametrize("parts", [0, 3, 1 << 40])
def test_suffix_dedup_however_many_contexts_count_as_hot(spark, monkeypatch, parts):
    data = rows()
    monkeypatch.setattr(suffixdedup, "HOT_PARTS", parts)
    expected = sorted(((d[0], *x) for d, x in zip(data, _removed([d[1] for d in data], 60), strict=True)), key=repr)
    assert collected(suffixdedup.dedup(frame(spark), 60, 16, 3, 2000), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == expected


def test_suffix_dedup_counts_bytes_not_words(spark):
    """Passages of 57 words or more in two texts: 400 bytes are removed, 399 stay."""
    rng = random.Random(6)
    passages = [" ".join(f"{rng.randrange(1 << 20):06x}" for _ in range(60))[:n] for n in (399, 400)]
    assert all(len(p.split()) > 56 and len(p) == n for p, n in zip(passages, (399, 400), strict=True))
    texts = [f"{i} before {i}{p}{i} after {i}" for i, p in enumerate(p for p in passages for _ in range(2))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert collected(suffixdedup.dedup(docs), "doc_id", "n_removed", "n_spans") == [(0, 0, 0), (1, 0, 0), (2, 400, 1), (3, 400, 1)]


SCRIPTS = ["Γειά σου Κόσμε 12", "你好，世界 １２３", "مرحبا بالعالم", "🙂👩‍👩‍👧 ok 🇩🇪!", "<|endoftext|>é<|endoftext|><|endoftext| >", "ไทย ภาษา", "हिन्दी में", "a​b﻿ c　d", "Ⅷ ½ ²x", "x<|endoftext|>", "it's ΑΒΓ's 's’s", " \n  \n x", "\x00\x01 \x85 \x1c"]


def test_pre_tokens_of_every_script_agree_with_the_library():
    table = tokens.PieceTable(tokens.tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(5)
    letters = "".join(SCRIPTS)
    for t in [*SCRIPTS, *("".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(300))]:
        ids = table.tokenizer.encode(t, add_special_tokens=False).ids
        assert "".join(table.pre_tokens(t)) == t
        assert np.frombuffer(table.ids(t), table.width).tolist() == ids and table.count(t) == len(ids), t


@pytest.mark.parametrize("head", [0, 20, 150_000])
def test_token_counts_join_distinct_pre_tokens(spark, head):
    data = [(i, t) for i, t in enumerate([*SCRIPTS, *(d[1] for d in rows()), *SCRIPTS])]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    library = tokens.piece_table(tokens.tokenizer_path("byte_bpe_50k.json")).tokenizer
    expected = sorted((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in data)
    assert collected(tokens.token_counts(docs, head_size=head), "doc_id", "n_bytes", "n_tokens") == sorted(expected, key=repr)
    pieces = tokens.pre_token_pieces(docs.select(F.coalesce("text", F.lit("")).alias("t")), "byte_bpe_50k.json").collect()
    assert len({r["word"] for r in pieces}) == len(pieces) and max(len(r["word"]) for r in pieces) <= tokens.MAX_CHARS


@pytest.mark.parametrize("most", [-1, secrets.SMALL_ROWS])
def test_postings_and_their_intersections(spark, monkeypatch, most):
    """The index lists what contains a trigram, queries leave what holds them, and the join's kind changes nothing."""
    whole = collected(secrets.scan(frame(spark)), "doc_id", "spans")
    monkeypatch.setattr(secrets, "BLOCK_KEYS", 7)
    monkeypatch.setattr(secrets, "SMALL_ROWS", most)
    assert collected(secrets.scan(frame(spark)), "doc_id", "spans") == whole and any(x[1] for x in whole)
    extra = ["password", "assword", "gh_ AKI", "AKIA", "AKI KIA", "TOKEN", "toke ken", "eyJ", "-----BEGIN RSA PRIVATE KEY-----", ""]
    data = [(i, t or "") for i, t in enumerate([*extra, *(d[1] for d in rows())])]
    table = spark.createDataFrame(data, "key long, t string")
    index = materialize(secrets.postings(table, secrets.RULES, 5), "t").collect()
    texts = dict(data)
    for r in index:
        has = lambda k: r["gram"][1:] in (texts[k].lower() if r["gram"][0] == "i" else texts[k])  # noqa: E731, B023
        assert sorted(r["keys"]) == [k for k in texts if k % 5 == r["block"] and has(k)]

    def holds(q, t):
        return q in t if isinstance(q, str) else (all if q[0] == "and" else any)(holds(x, t) for x in q[1])

    found = {r["key"]: r["rules"] for r in secrets.candidates(secrets.postings(table, secrets.RULES, 5), secrets.RULES).collect()}
    for k, t in texts.items():
        for i, r in enumerate(secrets.RULES):
            if (q := secrets.trigram_query(r)) is not True:
                assert bool(found.get(k, 0) >> i & 1) == holds(q, t.lower() if r.any_case else t)


def test_classifier_steps_equal_plain_softmax_gradients():
    """Every parameter after two epochs, against the same steps with scalar loops."""
    rng = np.random.default_rng(6)
    data = []
    for i in range(12):
        at = np.sort(rng.choice(40, rng.integers(0, 9), replace=False)).astype(np.uint16)
        data.append((at, np.full(len(at), 1 / max(1, len(at)), np.float32), i % 2))
    size, wide = 1 << classifier.BITS, classifier.DIMENSIONS
    own = np.random.default_rng(7)
    E = own.uniform(-1, 1, (size, wide)).astype(np.float32).astype(float) / wide
    W, b = own.normal(0, 0.1, (wide, 2)).astype(np.float32).astype(float), [0.0, 0.0]
    gE, gW, gb = defaultdict(lambda: 1e-8), [[1e-8, 1e-8] for _ in range(wide)], [1e-8, 1e-8]
    for _ in range(2):
        for i in own.permutation(len(data)):
            at, share, label = data[i]
            mean = [sum(float(s) * E[a][d] for a, s in zip(at, share, strict=True)) for d in range(wide)]
            z = [sum(mean[d] * W[d][c] for d in range(wide)) + b[c] for c in range(2)]
            whole = sum(np.exp(x) for x in z)
            error = [np.exp(z[c]) / whole - (c == label) for c in range(2)]  # gradient of the cross entropy by z
            back = [sum(W[d][c] * error[c] for c in range(2)) for d in range(wide)]
            for c in range(2):
                for d in range(wide):
                    gW[d][c] += (mean[d] * error[c]) ** 2
                    W[d][c] -= 0.2 * mean[d] * error[c] / np.sqrt(gW[d][c])
                gb[c] += error[c] ** 2
                b[c] -= 0.2 * error[c] / np.sqrt(gb[c])
            norm = np.sqrt(sum(x * x for x in back))
            for a, s in zip(at, share, strict=True):
                gE[a] += (float(s) * norm) ** 2
                for d in range(wide):
                    E[a][d] -= float(s) / np.sqrt(gE[a]) * back[d]
    model = classifier.train(data, epochs=2)
    plain = [sum(E[a][d] * (W[d][1] - W[d][0]) for d in range(wide)) for a in range(40)]
    assert np.allclose(model.table[:40], plain, atol=2e-3) and abs(model.bias - (b[1] - b[0])) < 2e-3
    assert max(abs(x) for x in plain) > 0.1


def test_classifier_training_rows_are_bounded_in_bytes_and_train_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i // 3, f"text {i // 3} of some length") for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    taken = []
    monkeypatch.setattr(classifier, "train", lambda data, **_: taken.append(len(data)))
    classifier.fit(docs, labels)
    usable = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(40))
    each = classifier.KINDS * len("text 10 of some length")
    classifier.fit(docs, labels, max_features=5 * each)
    classifier.fit(docs, labels, max_train=7)
    assert taken[0] == usable and 4 <= taken[1] <= 5 and taken[2] == 7


def test_very_long_texts(spark):
    """A text of 3 MB beside short ones, through every operator, against the whole text's plain result."""
    rng = random.Random(7)
    vocabulary = [f"w{rng.randrange(1 << 30):x}" for _ in range(5000)]
    long = " ".join(rng.choices(vocabulary, k=330_000)) + " password=abcdefgh " + "z" * 20_000
    texts = [long, "short one", long[1_000_000:1_002_000], "", None]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    words = len(long.split())
    scored = {r["doc_id"]: r for r in brown.score(docs, spell=True).collect()}
    assert scored[0]["n_tokens"] == words + 1 and np.isfinite(scored[0]["score"])
    cut = collected(suffixdedup.dedup(docs), "doc_id", "n_bytes", "n_removed", "n_spans")
    assert cut[0][:2] == (0, len(long)) and cut[0][2] == 22_000 and cut[0][3] == 2 and cut[2] == (2, 2000, 2000, 1)
    spans = dict(collected(secrets.scan(docs), "doc_id", "spans"))
    assert spans[0] == f"assign:{long.index('password')}:{long.index('password') + 17}"
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(4)], "doc_id long, quality int, toxic int")
    assert all(0 <= r["score"] <= 1 for r in classifier.judge(docs, labels).collect())
    assert {r["doc_id"]: r["fingerprint"] for r in simhash.judge(docs).collect()}[0] == f"{_fingerprint(long):016x}"
    library = len(tokens.piece_table(tokens.tokenizer_path("byte_bpe_50k.json")).tokenizer.encode(long, add_special_tokens=False).ids)
    assert dict(collected(tokens.token_counts(docs), "doc_id", "n_tokens"))[0] == library
    assert {r["doc_id"]: r["doc_tokens"] for r in tokens.pack(docs).collect()}[0] == library + 1
    assert {r["doc_id"]: r["n_words"] for r in quality_rules.judge(docs).collect()}[0] == words
    items = spark.createDataFrame([(1, long), (2, "short one")], "item_id long, text string")
    found = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"]) for r in decontam.judge(docs, items).collect()}
    assert found[0] == (len(decontam.words_of(long.encode())),) * 2 + (1,) and found[1] == (2, 2, 1)


def test_long_urls(spark):
    long = "https://www.example.com/en/" + "a/" * 200_000 + "?q=" + "b" * 100_000
    pages = spark.createDataFrame([(1, long, ""), (2, "https://" + "h" * 100_000 + ".net/es/x", "")], "page_id long, url string, html string")
    found = collected(urlfilter.judge(pages), "page_id", "host", "path", "rule", "verdict")
    assert found == [(1, "www.example.com", "/en/" + "a/" * 200_000, "www.example.com/en/", "allow"), (2, "h" * 100_000 + ".net", "/es/x", "net/es/", "block")]
