"""Secret scans over a trigram index, in DataFrame functions only.

``trigram_query`` derives from each regular expression a Boolean query over trigrams that every match must satisfy.
``postings`` is the inverted index: for each trigram that some query names, the keys of the documents that contain
it, in blocks of about ``BLOCK_KEYS`` keys, so no list grows with the corpus. ``candidates`` answers the queries block
by block with intersections and unions of those lists. Candidates meet their documents, by broadcast while there are
at most ``SMALL_ROWS``, else in a shuffled join, and only they run a rule's regular expression; rules without
mandatory trigrams scan fully. A key is a hash of the document's columns: documents that share one share their
candidacy, which costs a scan and changes no result.

Spans are code points, end exclusive. A kind's matches are leftmost and non-overlapping, then filtered by length.

Defined results: null text is empty and has no spans; repeated rows and null keys are judged as they are; an empty
table gives an empty result; other columns are ignored (kept by ``redact``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from prismgrid.llm.common import text_string
from prismgrid.storage import materialize

try:
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # older Python
    import sre_constants as sre
    import sre_parse


@dataclass(frozen=True)
class Rule:
    """``pattern`` is matched; a match stays if ``group`` (0: all of it) has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False

    @property
    def regex(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


#: The kinds in their listed order: the base ones, then the method's own.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
_HEADER = r"-----BEGIN [A-Z ]*PRIVATE KEY-----"
#: Anything without five dashes in a row, to an END line. Repeats are bounded where Java's matcher recurses.
_TO_END = r"[^-]*(?:-{1,4}[^-]+){0,32}-----END [A-Z ]*PRIVATE KEY-----"
#: Without an END line: header fields, then base64 runs of 24 characters or more and the one run after them (a short
#: last line); past 80 long runs all that is base64 or lies between its lines; else the run on the line below.
_RUN, _BETWEEN = r"[A-Za-z0-9+/=]", r"""[ \t\r\n>#*"'\\,]"""
_LINE = f"(?:{_BETWEEN}+{_RUN}{{24,}})"
_FIELDS = rf"(?:{_BETWEEN}+[A-Za-z0-9-]+:[^\r\n\\]*){{0,8}}"
_BLOCK = rf"""{_FIELDS}(?:{_LINE}{{40}}{_LINE}{{40}}[A-Za-z0-9+/= \t\r\n>#*"'\\,]*|{_LINE}{{1,40}}{_LINE}{{0,40}}(?:{_BETWEEN}+{_RUN}+)?|[ \t]*(?:\r?\n|\\n)[ \t]*{_RUN}+)"""
EXTRA = (
    Rule("pem", f"{_HEADER}(?:{_TO_END}|{_BLOCK})?"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE + EXTRA
#: Alternatives that the derivation follows before it lets a trigram go.
MAX_SET = 64
#: Keys of a block of the index, about.
BLOCK_KEYS = 20_000
#: Candidates (two numbers each) that may be broadcast.
SMALL_ROWS = 1_000_000

# A query is True, a trigram, or ("and" | "or", frozenset of queries).


def _join(kind: str, parts) -> object:
    parts = set(parts)
    if kind == "and":
        parts.discard(True)
        return True if not parts else parts.pop() if len(parts) == 1 else ("and", frozenset(parts))
    if True in parts or not parts:
        return True
    return parts.pop() if len(parts) == 1 else ("or", frozenset(parts))


def _of_strings(strings: set[str]) -> object:
    """A text that contains one of the strings satisfies this; a string that asks for more than another adds nothing."""
    asked = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    least = [x for x in asked if not any(y < x for y in asked)]
    return _join("or", (_join("and", x) for x in least))


def _walk(parsed) -> tuple[list, object]:
    """Exact strings and gaps (None) of a parsed sequence, and what its inner parts demand."""
    run, asked = [{""}], []

    def gap() -> None:
        if run[-1] is not None:
            run.append(None)

    def add(strings: set[str]) -> None:
        if run[-1] is None:
            run.append(strings)
        elif len(run[-1]) * len(strings) <= MAX_SET:
            run[-1] = {a + b for a in run[-1] for b in strings}
        else:
            run.append(None)
            run.append(strings)

    def inner(parts, exact_first: bool = True) -> None:
        below, more = _walk(parts)
        asked.append(more)
        for x in below:
            gap() if x is None else add(x)

    for op, value in parsed:
        if op is sre.LITERAL:
            add({chr(value)})
        elif op is sre.IN:
            chars: set[str] | None = set()
            for kind, x in value:
                if kind is sre.LITERAL:
                    chars.add(chr(x))
                elif kind is sre.RANGE and len(chars) + x[1] - x[0] < 16:
                    chars |= {chr(c) for c in range(x[0], x[1] + 1)}
                else:
                    chars = None
                    break
            gap() if chars is None or len(chars) > 16 else add(chars)
        elif op is sre.SUBPATTERN:
            inner(value[-1])
        elif op is sre.BRANCH:
            ways = [_walk(x) for x in value[1]]
            if all(len(w) == 1 and w[0] is not None for w, _ in ways) and sum(len(w[0]) for w, _ in ways) <= MAX_SET:
                add(set().union(*(w[0] for w, _ in ways)))
            else:
                asked.append(_join("or", (_query(w, more) for w, more in ways)))
                gap()
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = value
            below, _ = _walk(body)
            if (low, high) == (0, 1) and len(below) == 1 and below[0] is not None and len(below[0]) <= 4:
                add(below[0] | {""})
                continue
            for _ in range(min(low, 4)):
                inner(body)
            if not (low == high and low <= 4):
                gap()
        elif op is not sre.AT:
            gap()
    return run, _join("and", asked)


def _query(run: list, asked: object) -> object:
    return _join("and", [asked, *(_of_strings(x) for x in run if x is not None)])


def trigram_query(rule: Rule) -> object:
    """What every match of the rule contains; True if nothing is mandatory. Lower-cased for rules in any case."""
    query = _query(*_walk(sre_parse.parse(rule.pattern)))

    def lower(q):
        return q if q is True else q.lower() if isinstance(q, str) else (q[0], frozenset(map(lower, q[1])))

    return lower(query) if rule.any_case else query


def _trigrams(query: object) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(_trigrams, query[1]))


def _gram(trigram: str, any_case: bool) -> str:
    """The index's name of a trigram: some are looked for in lower-cased texts."""
    return f"{'i' if any_case else 'c'}{trigram}"


def postings(rows: DataFrame, rules: tuple[Rule, ...], blocks: int, text: str = "t") -> DataFrame:
    """block, gram, keys: which of a block's documents contain each trigram that a rule's query names."""
    wanted = sorted({(_gram(g, r.any_case), g, r.any_case) for r in rules for g in _trigrams(trigram_query(r))})
    texts = rows.select("key", F.col(text).alias("c"), F.lower(F.col(text)).alias("i"))  # lower-cased once
    held = F.array(*(F.when(F.col("i" if any_case else "c").contains(g), F.lit(name)) for name, g, any_case in wanted))
    each = texts.select("key", F.explode(F.array_compact(held)).alias("gram"))
    return each.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "gram").agg(F.collect_set("key").alias("keys"))


def _answer(query: object, any_case: bool) -> Column:
    """The keys of a block that satisfy the query."""
    if isinstance(query, str):
        return F.coalesce(F.try_element_at(F.col("lists"), F.lit(_gram(query, any_case))), F.array().cast("array<bigint>"))
    return reduce(F.array_intersect if query[0] == "and" else F.array_union, (_answer(q, any_case) for q in sorted(query[1], key=str)))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """key, rules: for each key in the index that a rule's query accepts, those rules as bits."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("lists"))
    asked = [(i, q, r.any_case) for i, r in enumerate(rules) if (q := trigram_query(r)) is not True]
    found = F.array(*(F.struct(F.lit(1 << i).alias("rule"), _answer(q, any_case).alias("keys")) for i, q, any_case in asked))
    each = lists.select(F.explode(found).alias("x")).select("x.rule", F.explode("x.keys").alias("key"))
    return each.groupBy("key").agg(F.bit_or("rule").alias("rules"))


def _marked(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``rows`` (key, t, ..) with ``rules``: the rules whose query they satisfy, null for none."""
    if all(trigram_query(r) is True for r in rules):
        return rows.withColumn("rules", F.lit(None).cast("int"))
    blocks = 1 + rows.count() // BLOCK_KEYS
    found = materialize(candidates(materialize(postings(rows, rules, blocks), "secret-postings"), rules), "secret-candidates")
    return rows.join(F.broadcast(found) if found.count() <= SMALL_ROWS else found, "key", "left")


_NO_SPANS = "array<struct<start:int,order:int,end:int,kind:string>>"


def _with_matches(rows: DataFrame, rules: tuple[Rule, ...], text: str = "t") -> DataFrame:
    """The candidates' matches m0, m1, .. and, where there are any, what lies between them and the tested groups."""
    asked = lambda i, r: F.lit(True) if trigram_query(r) is True else F.col("rules").bitwiseAND(1 << i) != 0
    rows = rows.withColumns({f"m{i}": F.when(asked(i, r), F.regexp_extract_all(F.col(text), F.lit(r.regex), F.lit(0))) for i, r in enumerate(rules)})
    more = {}
    for i, r in enumerate(rules):
        some = F.size(F.col(f"m{i}")) > 0
        more[f"b{i}"] = F.when(some, F.split(F.col(text), r.regex, -1))
        more[f"g{i}"] = F.when(some, F.regexp_extract_all(F.col(text), F.lit(r.regex), F.lit(r.group))) if r.group else F.col(f"m{i}")
    return rows.withColumns(more)


def _spans(rule: Rule, i: int) -> Column:
    """Spans of one rule. Splitting at the matches gives the text between them, hence their places."""
    m, b, g = F.col(f"m{i}"), F.col(f"b{i}"), F.col(f"g{i}")
    empty = F.array().cast(_NO_SPANS)

    def step(acc: Column, k: Column) -> Column:
        start = acc["at"] + F.length(F.get(b, k))
        end = start + F.length(F.get(m, k))
        span = F.struct(start.alias("start"), F.lit(i).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        found = F.when(F.length(F.get(g, k)) >= rule.least, F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    out = F.aggregate(F.sequence(F.lit(0), F.size(m) - 1), F.struct(F.lit(0).alias("at"), empty.alias("found")), step)["found"]
    return F.when(F.size(m) > 0, out).otherwise(empty)


def _fast(rule: Rule) -> Rule:
    """The same spans from a pattern that needs no filter, where one is certain: a run of one class of characters
    matched from its first place has a long enough match if and only if the run is that long."""
    if rule.group == 0 and rule.least and rule.pattern.endswith("]+"):
        fixed = sre_parse.parse(rule.pattern)
        head = len(fixed) - 1
        if all(op is sre.LITERAL for op, _ in fixed[:head]) and (head == 0 or re.fullmatch(rule.pattern, rule.pattern[:head] * 2)):
            return Rule(rule.kind, f"{rule.pattern[:-1]}{{{rule.least - head},}}", 0, rule.least, rule.any_case)
    return rule


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``carry`` columns as ``c0``.. and ``t``, the text, with ``spans``: (start, order, end, kind) in their order."""
    rules = tuple(map(_fast, rules))
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)), text_string(text).alias("t"))
    hashed = [f"c{i}" for i, c in enumerate(carry) if c != text and not isinstance(docs.schema[c].dataType, MapType)]
    indexed = _with_matches(_marked(rows.withColumn("key", F.xxhash64("t", *hashed)), rules), rules)
    each = F.array_sort(F.concat(*(_spans(r, i) for i, r in enumerate(rules))))
    return indexed.select(*(f"c{i}" for i in range(len(carry))), "t", each.alias("spans"))


def _listing(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document's counts of base spans, their digest, and all spans."""
    kinds = [r.kind for r in base]
    found = find(docs, rules, text, (key,))
    own = F.filter("spans", lambda s: s["order"] < len(kinds))
    of_kind = lambda i: F.filter("spans", lambda s: s["order"] == i)
    counts = [F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(kinds)]
    return found.select(F.col("c0").alias(key), *counts, F.sha2(_listing(own).cast("binary"), 256).alias("base_sha256"), _listing(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", mark: str = "[SECRET]", length: str | None = "n_chars") -> DataFrame:
    """The documents, all columns kept, with every span replaced by ``mark``; touching spans become one mark.

    Texts without spans stay as they are, null ones too; ``length``, if there is such a column, follows the text.
    """
    names = docs.columns
    found = find(docs, rules, text, tuple(names))
    merged = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"))).otherwise(
            F.struct(F.concat(a["out"], F.substring(F.col("t"), a["at"] + 1, s["start"] - a["at"]), F.lit(mark)).alias("out"), s["end"].alias("at"))
        ),
        lambda a: F.concat(a["out"], F.substring(F.col("t"), a["at"] + 1, F.length("t"))),
    )
    clean = found.withColumn("new", F.when(F.size("spans") > 0, merged))
    out = []
    for i, name in enumerate(names):
        column = F.col(f"c{i}")
        if name == text:
            column = F.coalesce(F.col("new"), column)
        elif name == length:
            column = F.when(F.col("new").isNotNull(), F.length("new").cast(docs.schema[name].dataType)).otherwise(column)
        out.append(column.alias(name))
    return clean.select(*out)
