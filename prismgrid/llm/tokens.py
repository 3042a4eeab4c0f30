"""Token counts without materialised ids, and concatenate-and-cut packing.

Both rest on one observation: a byte-level BPE never merges across pre-tokens, so a pre-token's pieces need counting
once. Counting gathers the distinct pre-tokens of all texts, counts each one's pieces, and joins those counts to every
document's pre-token frequencies: the ``HEAD`` most frequent by a broadcast table of bounded size, the others (each
one rare, as more frequent ones are in that table) by a shuffled join, summed by document. A pre-token over
``MAX_CHARS`` characters is counted where it stands. Packing needs the ids in order and keeps a dictionary of
pre-tokens in each worker, bounded in entries and their length.

Pre-tokens come from a pattern over settled Unicode ranges; text with other characters is split by the library's own
pre-tokenizer, and special strings are cut out first, as the library does. Other files than byte-level BPE ones are
counted by their own libraries, text by text.

Defined results: null text counts as empty; an empty text has 0 tokens (packing still adds its end id);
null ``doc_id`` and repeated rows are kept as they are; an empty table gives an empty result; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import contextlib
import gc
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismgrid.llm.common import leading, text_string
from prismgrid.storage import materialize

#: Ranges whose letters, digits and white space are the same in every Unicode version; a text with any other
#: character is split by the library.
LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f\u0400-\u0481\u048a-\u04ff"
DIGITS = r"0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = r"\t\n\r\x20"
SETTLED = SPACES + r"\x21-\x7e\xa1-\u024f\u0400-\u0481\u048a-\u04ff\u2010-\u2027\u2030-\u205e"
#: The public vocabulary's pre-token pattern, over the settled ranges.
PRE_TOKEN = rf" ?[{LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{DIGITS}]+| ?[^{SPACES}{LETTERS}{DIGITS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
#: Pre-tokens remembered by a worker before the dictionary starts anew, and the most characters of one that is.
MAX_ENTRIES = 400_000
MAX_CHARS = 64
#: Pre-tokens whose piece counts are broadcast, at most.
HEAD = 150_000
#: Distinct pre-tokens that a worker gathers before it hands them on.
HELD = 300_000


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies, from the published rule."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return dict(sorted(({b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}).items()))


class PieceTable:
    """Pieces of each distinct pre-token of a ``tokenizers`` byte-level BPE file."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        self.split = re.compile(PRE_TOKEN).findall
        self.odd = re.compile(f"[^{SETTLED}]").search
        self.letters = list(_byte_letters().values())
        self.special = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        longest_first = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.cut = re.compile(f"({longest_first})").split if self.special else lambda text: [text]
        self.counts: dict[str, int] = {}
        self.packed = Packed(self)
        self.width = "<u2" if (size := self.tokenizer.get_vocab_size()) <= 1 << 16 else "<u4"
        self.bytes = [i.to_bytes(int(self.width[-1]), "little") for i in range(size)]

    def pre_tokens(self, text: str) -> list[str]:
        """The pre-tokens in order; a special string is one."""
        if not self.odd(text) and not any(s in text for s in self.special):
            return self.split(text)
        out = []
        for i, part in enumerate(self.cut(text)):
            if i % 2:
                out.append(part)
            elif not self.odd(part):
                out += self.split(part)
            else:
                out += [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)]
        return out

    def _pieces(self, token: str) -> list[int]:
        if token in self.special:
            return [self.special[token]]
        first, rest = (self.letters[0x20], token[1:]) if token[:1] == " " else ("", token)
        shown = first + rest if rest.isascii() and rest.isalnum() else "".join(map(self.letters.__getitem__, token.encode()))
        return [t.id for t in self.model.tokenize(shown)]

    def count(self, text: str) -> int:
        known, frequency = self.counts, Counter(self.pre_tokens(text))
        total = 0
        for token in [t for t in frequency if t not in known]:
            n = len(self._pieces(token))
            if len(token) <= MAX_CHARS:
                known[token] = n
            else:
                total += n * frequency.pop(token)
        total += sum(map(mul, map(known.__getitem__, frequency), frequency.values()))
        if len(known) > MAX_ENTRIES:
            known.clear()
        return total

    def ids(self, text: str) -> bytes:
        """Ids as little-endian integers of ``width``."""
        out = b"".join(map(self.packed.__getitem__, self.pre_tokens(text)))
        if len(self.packed) > MAX_ENTRIES:
            self.packed.clear()
        return out


class Packed(dict):
    """Ids of each pre-token met so far, made as it is asked for; long ones aren't remembered."""

    def __init__(self, table: PieceTable):
        self.table = table

    def __missing__(self, token: str) -> bytes:
        out = b"".join([self.table.bytes[i] for i in self.table._pieces(token)])
        if len(token) <= MAX_CHARS:
            self[token] = out
        return out


@contextlib.contextmanager
def uncollected() -> Iterator[None]:
    """Without searches for reference cycles, which would go through the table again and again and find none."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


@lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    return PieceTable(path)


@lru_cache(maxsize=2)
def sentence_pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def byte_level(path: str) -> bool:
    """Whether the file is the kind that ``PieceTable`` reproduces; any other is counted by its own library."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    return (
        spec.get("normalizer") is None
        and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex", True)) == ("ByteLevel", False, True)
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        and all(t["special"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in spec.get("added_tokens", []))
    )


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


def count_one(path: str, text: str) -> int:
    if path.endswith(".model"):
        return len(sentence_pieces(path).encode(text, num_threads=1) if text else [])
    if byte_level(path):
        return piece_table(path).count(text)
    return len(piece_table(path).tokenizer.encode(text, add_special_tokens=False).ids)


def pre_token_pieces(texts: DataFrame, tokenizer: str) -> DataFrame:
    """word, n, pieces: each distinct pre-token of the column ``t``, how often it occurs and its number of pieces."""

    def gather(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(seen: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

        table, seen = piece_table(tokenizer_path(tokenizer)), Counter()
        for batch in found:
            for t in batch.column(0).to_pylist():
                seen.update(t for t in table.pre_tokens(t) if len(t) <= MAX_CHARS)
                if len(seen) > HELD:
                    yield made(seen)
                    seen = Counter()
        yield made(seen)

    def count(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = piece_table(tokenizer_path(tokenizer))
        for batch in found:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(table._pieces(w)) for w in batch.column(0).to_pylist()], pa.int32())], ["word", "n", "pieces"])

    distinct = texts.select("t").mapInArrow(gather, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(distinct.mapInArrow(count, "word string, n long, pieces int"), "pre-tokens")


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, key: str = "doc_id", text: str = "text", head_size: int = HEAD) -> DataFrame:
    """Tokens of every whole text."""
    kind, path = docs.schema[key].dataType.simpleString(), tokenizer_path(tokenizer)
    rows = docs.select(F.col(key).alias("k"), text_string(text).alias("t"), F.octet_length(text_string(text)).cast("long").alias("b"))
    named = [F.col("k").alias(key), F.col("b").alias("n_bytes"), F.col("n").alias("n_tokens"), (F.col("n") > limit).alias("over_limit")]
    if path.endswith(".model") or not byte_level(path):

        def whole(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in found:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([count_one(tokenizer_path(tokenizer), t) for t in batch.column(1).to_pylist()], pa.int64())], ["k", "b", "n"])

        return rows.mapInArrow(whole, f"k {kind}, b long, n long").select(*named)
    pieces = pre_token_pieces(rows, tokenizer)
    head = docs.sparkSession.sparkContext.broadcast({r["word"]: r["pieces"] for r in leading(pieces, head_size).select("word", "pieces").collect()})
    names = ["row", "k", "b", "word", "tf", "n"]

    def add(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = piece_table(tokenizer_path(tokenizer)), head.value
        for batch in found:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                totals, rest = [], {x: [] for x in ("row", "word", "tf")}
                for row, t in zip(part.column("row").to_pylist(), part.column("t").to_pylist(), strict=True):
                    frequency, total = Counter(table.pre_tokens(t)), 0
                    for w in [w for w in frequency if w not in known]:
                        n = frequency.pop(w)
                        if len(w) > MAX_CHARS:
                            total += n * len(table._pieces(w))
                        else:
                            rest["row"].append(row)
                            rest["word"].append(w)
                            rest["tf"].append(n)
                    totals.append(total + sum(map(mul, map(known.__getitem__, frequency), frequency.values())))
                n = part.num_rows
                own = [f"{row} is no pre-token" for row in part.column("row").to_pylist()]  # has a letter after a space after a digit
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("k"), part.column("b"), pa.array(own, pa.string()), pa.nulls(n, pa.int32()), pa.array(totals, pa.int64())], names)
                if n := len(rest["row"]):
                    yield pa.RecordBatch.from_arrays([pa.array(rest["row"], pa.int64()), pa.nulls(n, part.column("k").type), pa.nulls(n, pa.int64()), pa.array(rest["word"], pa.string()), pa.array(rest["tf"], pa.int32()), pa.nulls(n, pa.int64())], names)

    local = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(add, f"row long, k {kind}, b long, word string, tf int, n long")
    met = local.join(pieces.select("word", "pieces"), "word", "left")
    n = F.coalesce("n", F.col("tf") * F.col("pieces"))
    return met.groupBy("row").agg(F.max("k").alias("k"), F.max("b").alias("b"), F.sum(n).alias("n")).select(*named)


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", length: int = 1024, end_id: int = 0, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """Concatenate all documents and cut at every ``length``-th id.

    Pass one tokenises, writes each document's ids with its offset inside its partition, and totals each partition;
    a prefix sum over those totals (one number a partition) gives every partition's place in the whole. Pass two
    cuts each document at the window borders that fall inside it, so a border document yields one record a window.
    Only the last sequence has padding. No row is shuffled in either pass.
    """
    spark, kind = docs.sparkSession, docs.schema[key].dataType.simpleString()

    def tokenise(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, part, at = piece_table(tokenizer_path(tokenizer)), TaskContext.get().partitionId(), 0
        end, wide = np.array([end_id], table.width).tobytes(), np.dtype(table.width).itemsize
        for batch in found:
            for part_batch in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                with uncollected():
                    ids = [table.ids(t) + end for t in part_batch.column(1).to_pylist()]
                n = np.array([len(x) // wide for x in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [part_batch.column(0), pa.array([part] * len(ids), pa.int32()), pa.array(starts), pa.array(n), pa.array([wide] * len(ids), pa.int32()), pa.array(ids, pa.binary())],
                    ["k", "part", "at", "n", "wide", "ids"],
                )

    if not byte_level(tokenizer_path(tokenizer)):
        raise ValueError("pack() takes byte-level BPE files")
    tokenised = materialize(docs.select(F.col(key).alias("k"), text_string(text).alias("t")).mapInArrow(tokenise, f"k {kind}, part int, at long, n long, wide int, ids binary"), "pack-ids")
    totals = sorted((r["part"], r["n"]) for r in tokenised.groupBy("part").agg(F.sum("n").alias("n")).collect())
    bases, whole = [], 0
    for part, n in totals:
        bases.append((part, whole))
        whole += n
    base = spark.createDataFrame(bases, "part int, base long")
    placed = tokenised.join(F.broadcast(base) if len(bases) <= 100_000 else base, "part")

    def cut(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "start", "length", "crc", "n", "sequence", "offset", "ids"]
        for batch in found:
            keys, rows = [], {x: [] for x in names[1:]}
            for i, (base, at, n, wide, ids) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("base", "at", "n", "wide", "ids")), strict=True)):
                values, first = np.frombuffer(ids, f"<u{wide}").astype("<u4"), base + at
                start = 0
                while start < n:
                    sequence, offset = divmod(first + start, length)
                    size = min(length - offset, n - start)
                    piece = values[start : start + size].tobytes()
                    keys.append(i)
                    for name, value in zip(names[1:], (start, size, zlib.crc32(piece), n, sequence, offset, piece if with_ids else None), strict=True):
                        rows[name].append(value)
                    start += size
            yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(keys, pa.int64())), *(pa.array(rows[x], pa.int64()) for x in names[1:-1]), pa.array(rows["ids"], pa.binary())], names)

    pieces = placed.select("k", "base", "at", "n", "wide", "ids").mapInArrow(cut, f"k {kind}, start long, length long, crc long, n long, sequence long, offset long, ids binary")
    named = [F.col("k").alias(key), "start", "length", F.col("crc").alias("ids_crc32"), F.col("n").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), "offset"]
    return pieces.select(*named, *(["ids"] if with_ids else []))
