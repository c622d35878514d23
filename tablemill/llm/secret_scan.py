"""Secrets in texts: a trigram inverted index chooses the texts on which a rule is tried, with DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived: literals that every match has to hold give a
conjunction, alternatives a disjunction. Only trigrams of these queries are indexed. A posting list belongs to a trigram and a block
of texts and holds the hashes of the block's texts with that trigram, so no list grows with the table. Queries are
answered block by block by intersecting and uniting lists; what remains is verified with the expression itself. A rule
without a mandatory trigram scans every text.

Index and queries work on ASCII-lower-cased forms, for which a trigram can be found too often but never too seldom. Equal texts are
one entry; texts whose hashes meet by chance are both verified.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as ops
from re import _parser as regex

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.llm.pii import let, running
from tablemill.session import broadcast_if_small, stage

#: Texts of a block of the index, on average.
BLOCK_TEXTS = 4096

#: Spellings of a literal that a query lists one by one; beyond them the literal is cut there.
MOST_SPELLINGS = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``pattern`` has to mean the same in Java and Python; a match counts if its ``group`` has ``least`` characters.
    Matches are leftmost and don't overlap; one that does not count still ends where it ends."""

    name: str
    pattern: str
    least: int = 0
    group: int = 0
    ignore_case: bool = False

    @property
    def java(self) -> str:
        return f"(?i){self.pattern}" if self.ignore_case else self.pattern


# The rules. A run of hexadecimal digits and a key's tail have their least length in the pattern, where a match that is too
# short could not have hidden a longer one.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""", least=12, group=2, ignore_case=True),
    Rule("access", r"AKIA[A-Z0-9]{14,}+"),
    Rule("hex", r"[0-9a-f]{16,}+"),
)
MORE = (
    Rule("github", r"gh[opusr]_[A-Za-z0-9]{36,}+"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}+"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}+"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++"),
    Rule("pem", r"-----BEGIN (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----"),
    Rule("login", r"://[^\s:/@]{1,64}:[^\s:/@]{4,64}@"),
    Rule("bearer", r"bearer\x20{1,8}[A-Za-z0-9._~+/-]{20,}+", ignore_case=True),
)

#: A trigram, ("all" | "any", parts), or None where nothing is mandatory.
Query = str | tuple[str, tuple] | None


def _fold(character: int) -> str:
    return chr(character + 32) if 65 <= character <= 90 else chr(character)


def _all(parts: Iterable[Query]) -> Query:
    left = tuple(dict.fromkeys(p for p in parts if p is not None))
    return None if not left else left[0] if len(left) == 1 else ("all", left)


def _any(parts: Iterable[Query]) -> Query:
    left = tuple(dict.fromkeys(parts))
    return None if not left or None in left else left[0] if len(left) == 1 else ("any", left)


def _one_of(texts: Iterable[str]) -> Query:
    """The text holds one of ``texts``. A text whose trigrams include all of another's adds nothing."""
    sets = {frozenset(t[i : i + 3] for i in range(len(t) - 2)): t for t in sorted(texts, reverse=True)}
    least = sorted(t for s, t in sets.items() if not any(other < s for other in sets))
    return _any(_all(t[i : i + 3] for i in range(len(t) - 2)) for t in least)


def _joined(one: set[str], other: set[str]) -> set[str]:
    return {a + b for a, b in product(one, other)}


def _sequence(items) -> tuple[set[str] | None, Query]:
    """All spellings of a sequence where they are few, else None and what a match has to hold."""
    spellings, parts, whole = {""}, [], True
    for op, value in items:
        more, query = _element(op, value)
        if more is not None and len(spellings) * len(more) <= MOST_SPELLINGS:
            spellings = _joined(spellings, more)
            continue
        parts += [_one_of(spellings), query]
        spellings, whole = ({""} if more is None else more), False
    return (spellings, None) if whole else (None, _all([*parts, _one_of(spellings)]))


def _element(op, value) -> tuple[set[str] | None, Query]:
    if op is ops.LITERAL:
        return {_fold(value)}, None
    if op is ops.IN:
        chosen: set[str] = set()
        for kind, what in value:
            if kind is ops.LITERAL:
                chosen.add(_fold(what))
            elif kind is ops.RANGE and what[1] - what[0] < MOST_SPELLINGS:
                chosen |= {_fold(c) for c in range(what[0], what[1] + 1)}
            else:
                return None, None
        return (chosen, None) if len(chosen) <= MOST_SPELLINGS // 4 else (None, None)
    if op is ops.SUBPATTERN:
        return _sequence(value[3])
    if op is ops.ATOMIC_GROUP:
        return _sequence(value)
    if op is ops.BRANCH:
        found = [_sequence(branch) for branch in value[1]]
        if all(s is not None for s, _ in found) and len(union := set().union(*[s for s, _ in found])) <= MOST_SPELLINGS:
            return union, None
        return None, _any(query if s is None else _one_of(s) for s, query in found)
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT, ops.POSSESSIVE_REPEAT):
        low, high, items = value
        spellings, query = _sequence(items)
        if low == 0:
            return (spellings | {""}, None) if high == 1 and spellings is not None else (None, None)
        if spellings is None:
            return None, query
        repeated, times = spellings, 1
        while times < low and len(repeated) * len(spellings) <= MOST_SPELLINGS and len(next(iter(repeated))) < 256:
            repeated, times = _joined(repeated, spellings), times + 1
        return (repeated, None) if times == low == high else (None, _one_of(repeated))
    if op in (ops.AT, ops.ASSERT, ops.ASSERT_NOT):
        return {""}, None
    return None, None


def trigram_query(rule: Rule) -> Query:
    """What the lower-cased text of every match has to hold."""
    spellings, query = _sequence(regex.parse(rule.pattern))
    return query if spellings is None else _one_of(spellings)


def trigrams(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*[trigrams(p) for p in query[1]])


def build_index(texts: DataFrame, vocabulary: Iterable[str], blocks: int) -> DataFrame:
    """Posting lists (block, trigram, keys) of (key, text) rows for the trigrams of ``vocabulary``.

    Hits are reduced to distinct ones before they are dealt out by block, so copies of a text weigh nothing.
    """
    listed = F.array(*[F.lit(t) for t in sorted(vocabulary)])
    held = let(F.lower("text"), lambda low: F.filter(listed, lambda t: F.contains(low, t)))
    hits = texts.select("key", F.explode(held).alias("trigram")).distinct()
    return hits.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "trigram").agg(F.sort_array(F.collect_list("key")).alias("keys"))


def _answer(query: Query, lists: Column) -> Column:
    if isinstance(query, str):
        return F.coalesce(F.try_element_at(lists, F.lit(query)), F.array().cast("array<bigint>"))
    return reduce(F.array_intersect if query[0] == "all" else F.array_union, [_answer(p, lists) for p in query[1]])


def candidates(index: DataFrame, queries: dict[int, Query]) -> DataFrame:
    """(key, rules): the texts that pass the trigram query of a rule, with the numbers of those rules."""
    blocks = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))
    passed = F.array(*[F.struct(F.lit(n).alias("rule"), _answer(q, F.col("lists")).alias("keys")) for n, q in queries.items()])
    pairs = blocks.select(F.explode(passed).alias("p")).select("p.rule", F.explode("p.keys").alias("key"))
    return pairs.groupBy("key").agg(F.sort_array(F.collect_list("rule")).alias("rules"))


def _spans(text: Column, number: int, rule: Rule) -> Column:
    """array of (start, rule, end) of a rule's matches in code points."""
    counts: Callable[[Column], Column] = lambda m: F.length(F.regexp_extract(m, rule.java, rule.group) if rule.group else m) >= rule.least

    def placed(parts: Column, found: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.length(F.get(parts, i)) + F.when(i > 0, F.length(F.get(found, i - 1))).otherwise(0))
        spans = let(running(steps, lambda a, b: a + b), lambda starts: F.transform(found, lambda m, i: F.struct(
            F.get(starts, i).alias("start"), F.lit(number).alias("rule"), (F.get(starts, i) + F.length(m)).alias("end"), counts(m).alias("counts"))))
        return F.transform(F.filter(spans, lambda s: s["counts"]), lambda s: F.struct(s["start"].alias("start"), s["rule"].alias("rule"), s["end"].alias("end")))

    every = let(F.split(text, rule.java, -1), lambda parts: let(F.regexp_extract_all(text, F.lit(rule.java), F.lit(0)), lambda found: placed(parts, found)))
    return F.when(text.rlike(rule.java), every).otherwise(F.from_json(F.lit("[]"), "array<struct<start:int,rule:int,end:int>>"))


def with_secrets(docs: DataFrame, rules: Sequence[Rule] = BASE + MORE, text_col: str = "text", name: str = "secrets", block_texts: int = BLOCK_TEXTS) -> DataFrame:
    """``docs`` with an array column of (start, rule, end), ordered by start and then by the rules' order; ``rule`` is a rule's number.

    Spans count code points, ends are exclusive. Spans of one rule don't overlap; different rules may find the same place. A null text has
    none. Repeated rows keep their number; an empty table stays empty; a column ``name`` is replaced.
    """
    queries = {n: q for n, rule in enumerate(rules) if (q := trigram_query(rule)) is not None}
    keyed = docs.withColumn("__text", F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).withColumn("__key", F.xxhash64("__text"))
    if queries:
        blocks = max(1, -(-docs.count() // block_texts))
        index = stage(build_index(keyed.select(F.col("__key").alias("key"), F.col("__text").alias("text")), set().union(*[trigrams(q) for q in queries.values()]), blocks), "postings")
        chosen = stage(candidates(index, queries), "candidates").select(F.col("key").alias("__key"), F.col("rules").alias("__rules"))
        keyed = keyed.join(broadcast_if_small(chosen), "__key", "left")
    else:
        keyed = keyed.withColumn("__rules", F.lit(None).cast("array<int>"))
    nothing = F.from_json(F.lit("[]"), "array<struct<start:int,rule:int,end:int>>")
    tried = [F.when(F.array_contains(F.coalesce("__rules", F.array().cast("array<int>")), F.lit(n)), found).otherwise(nothing) if n in queries else found
             for n, rule in enumerate(rules) for found in [_spans(F.col("__text"), n, rule)]]
    every = F.sort_array(F.concat(*tried)) if tried else nothing
    return keyed.withColumn(name, every).select(*[F.col(f"`{c}`") for c in docs.columns if c != name], name)


def as_text(spans: Column, rules: Sequence[Rule]) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(rule.name) for rule in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans) for every row of ``docs``.

    Counts and digest are of the base rules, ``spans`` lists those of all rules. Other columns are not read; see ``with_secrets``.
    """
    rules = BASE + MORE
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    done = with_secrets(rules=rules, docs=rows).withColumn("base", F.filter("secrets", lambda s: s["rule"] < len(BASE)))
    number: Callable[[int], Callable[[Column], Column]] = lambda n: lambda s: s["rule"] == n
    counts = [F.size(F.filter("base", number(n))).cast("bigint").alias(f"n_{rule.name}") for n, rule in enumerate(BASE)]
    return done.select(F.col("id").alias(id_col), *counts, F.sha2(as_text(F.col("base"), rules), 256).alias("base_sha256"), as_text(F.col("secrets"), rules).alias("spans"))
