"""Personal data in texts by weak supervision, with DataFrame functions only.

Patterns find candidates for four kinds of spans: e-mail addresses, IP addresses, payment cards and phone numbers. Four labelers
vote on each candidate (for, against, or not at all): the pattern's own checks, a gazetteer, the words before it, and the
characters at its borders. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler
is for each kind, and so the probability that a candidate is real. With these as soft labels, a naive Bayes classifier over
features of the span decides about the candidates beyond the base patterns; base spans that pass their checks always stay.

Candidates are found inside the row. Only counts by kind, features and votes are aggregated, at most a fixed number of rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# Base patterns in possessive form. Where a run of characters can't begin a match, no later place in it can, so
# look-behinds skip the rest of the run (not right behind the match before, \G).
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = (
    rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
# Further forms, tried on their own where the base pattern took too much or nothing.
MORE = (
    rf"(?<!{_LOCAL}){_LOCAL}++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]++)++",
    r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[\x20.-]?)?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
)
# Cheap tests that a text must pass before a pattern is tried on it.
_LOOKS = (
    (lambda t: F.contains(t, F.lit("@")), lambda t: t.rlike(r"[(\[]at[)\]]")),
    (lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda t: t.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:")),
    (lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
    (lambda t: F.contains(t, F.lit("+")), lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}")),
)
# Gazetteers. Top-level domains, card prefixes and country codes that speak for a candidate.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "uk", "eu")
CARD_PREFIX = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))"
COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
# Words before a candidate that speak for or against it.
FOR = r"(?i)\b(?:e-?mail|mail|contact|write|tel|telefon|phone|mobile|call|fax|ip|host|server|card|visa|mastercard|credit|account|pay)\b"
AGAINST = r"(?i)\b(?:version|ver|v|isbn|issn|doi|figure|fig|table|section|chapter|page|build|release|order|invoice|sha|md5)\b[^A-Za-z]*$"

LABELERS = 4
CONTEXT = 40

#: Characters of the blocks in which a text's places are looked for.
BLOCK = 1024

EM_ROUNDS = 50


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, although ``body`` may use it once per array element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """Running total of an array under an associative function, in log2(n) passes over it."""
    steps = F.array(*[F.lit(1 << b) for b in range(30)])
    return let(values, lambda start: F.aggregate(F.filter(steps, lambda d: d < F.size(start)), start, lambda acc, d: F.transform(
        acc, lambda x, i: F.when(i >= d, combine(x, F.get(acc, i - d))).otherwise(x))))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, F.lit("[^0-9]"), F.lit(""))


def _passes(kind: int, extra: bool, match: Column) -> Column:
    """The checks of a kind."""
    if kind == 0 or (kind == 1 and extra):
        return F.lit(True)
    if kind == 1:
        return F.forall(F.split(match, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda n: (F.length(n) <= 3) & (F.coalesce(n.try_cast("int"), F.lit(0)) <= 255)))
    if kind == 2:
        return let(_digits(match), lambda d: F.length(d).between(13, 19) & F.coalesce(F.call_function("luhn_check", d), F.lit(False)))
    return F.length(_digits(match)).between(9, 15)


def _found(text: Column, kind: int, extra: bool) -> Column:
    """array of (kind, extra, start, end, match, before, after, valid) for one pattern; positions in code points."""
    pattern = (MORE if extra else BASE)[kind]

    def spans(parts: Column, matches: Column) -> Column:
        steps = F.transform(matches, lambda m, i: F.length(F.get(parts, i)) + F.when(i > 0, F.length(F.get(matches, i - 1))).otherwise(0))
        return let(running(steps, lambda a, b: a + b), lambda starts: F.transform(matches, lambda m, i: F.struct(
            F.lit(kind).alias("kind"), F.lit(extra).alias("extra"), F.get(starts, i).alias("start"), (F.get(starts, i) + F.length(m)).alias("end"), m.alias("match"),
            F.right(F.get(parts, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(parts, i + 1), F.lit(1)).alias("after"), _passes(kind, extra, m).alias("valid"))))

    spans_of = let(F.split(text, pattern, -1), lambda parts: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda matches: spans(parts, matches)))
    nothing = F.from_json(F.lit("[]"), "array<struct<kind:int,extra:boolean,start:int,end:int,match:string,before:string,after:string,valid:boolean>>")
    return F.when(_LOOKS[kind][extra](text), spans_of).otherwise(nothing)


def with_candidates(docs: DataFrame, text_col: str = "text", name: str = "candidates") -> DataFrame:
    """``docs`` with an array column of all candidates; a null text has none."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.withColumn(name, F.concat(*[_found(text, kind, extra) for extra in (False, True) for kind in range(len(KINDS))]))


def votes(c: Column) -> list[Column]:
    """1, -1 or 0 of each labeler for a candidate."""
    kind, match = c["kind"], c["match"]
    gazetteer = F.when(kind == 0, F.lower(F.regexp_extract(match, r"([A-Za-z0-9-]+)$", 1)).isin(*DOMAINS))
    gazetteer = gazetteer.when((kind == 1) & ~c["extra"], F.regexp_extract(match, "^0*([0-9]+)", 1).try_cast("int").between(1, 239))
    gazetteer = gazetteer.when(kind == 2, _digits(match).rlike(CARD_PREFIX)).when(F.startswith(match, F.lit("+")), match.rlike(COUNTRY))
    context = F.when(c["before"].rlike(AGAINST), F.lit(-1)).when(c["before"].rlike(FOR), F.lit(1)).otherwise(0)
    border = F.right(c["before"], F.lit(1)).rlike(r"[\p{L}\p{N}_@/=+-]") | c["after"].rlike(r"[\p{L}\p{N}_@/=]")
    return [F.when(c["valid"], 1).otherwise(-1), F.when(gazetteer, 1).when(~gazetteer, -1).otherwise(0), context, F.when(border, -1).otherwise(1)]


def features(c: Column) -> list[Column]:
    """Small integers that describe a candidate for the classifier: form, length, share of digits, and its surroundings."""
    size = F.length(c["match"])
    left, right = F.right(c["before"], F.lit(1)), c["after"]
    side = lambda x: F.when(x == "", 0).when(x.rlike(r"\s"), 1).when(x.rlike(r"[\p{L}\p{N}]"), 2).otherwise(3)
    return [c["extra"].cast("int"), F.least(F.floor(size / 4), F.lit(7)).cast("int"), F.floor(4 * F.length(_digits(c["match"])) / F.greatest(size, F.lit(1))).cast("int"), side(left), side(right)]


FEATURES = 5


def reliabilities(counts: dict[tuple[int, ...], float], rounds: int = EM_ROUNDS) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Expectation-maximisation over vote patterns of one kind: share of real candidates, and per labeler and vote the
    probability of that vote for real candidates and for others. Starts from labelers that are right four times in five."""
    share = 0.5
    tables = [{1: (0.7, 0.15), -1: (0.1, 0.65), 0: (0.2, 0.2)} for _ in range(LABELERS)]
    for _ in range(rounds):
        real = {v: n * posterior(v, share, tables) for v, n in counts.items()}
        total, all_real = sum(counts.values()), sum(real.values())
        share = (all_real + 1) / (total + 2)
        for labeler in range(LABELERS):
            for vote in (1, -1, 0):
                # smoothed towards a labeler that is right more often than not, which keeps the two classes from changing places
                lean = {1: (2.0, 0.5), -1: (0.5, 2.0), 0: (1.0, 1.0)}[vote]
                yes = sum(real[v] for v in counts if v[labeler] == vote)
                no = sum(counts[v] - real[v] for v in counts if v[labeler] == vote)
                tables[labeler][vote] = ((yes + lean[0]) / (all_real + 3.5), (no + lean[1]) / (total - all_real + 3.5))
    return share, tables


def posterior(vote: tuple[int, ...], share: float, tables: list[dict[int, tuple[float, float]]]) -> float:
    """Probability that a candidate with these votes is real."""
    logit = math.log(share / (1 - share)) + sum(math.log(tables[n][v][0] / tables[n][v][1]) for n, v in enumerate(vote))
    return 1 / (1 + math.exp(-max(-60.0, min(60.0, logit))))


@dataclass
class Model:
    """Per kind: log odds of a real span and of each feature value. ``trust`` keeps the labelers' reliabilities."""

    prior: dict[int, float] = field(default_factory=dict)
    odds: dict[tuple[int, int, int], float] = field(default_factory=dict)
    trust: dict[int, tuple[float, list[dict[int, tuple[float, float]]]]] = field(default_factory=dict)

    def logit(self, c: Column) -> Column:
        """The classifier's log odds for a candidate; 0 where the kind was never seen."""
        total = F.lit(0.0)
        for kind, prior in self.prior.items():
            total = F.when(c["kind"] == kind, prior).otherwise(total)
        for n, value in enumerate(features(c)):
            known = [(k, x, odds) for (k, f, x), odds in sorted(self.odds.items()) if f == n]
            if known:
                table = F.create_map(*[F.lit(y) for k, x, odds in known for y in (k * 100 + x, odds)])
                total = total + F.coalesce(F.try_element_at(table, c["kind"] * 100 + value), F.lit(0.0))
        return total


def fit(rows: Iterable[tuple[int, tuple[int, ...], tuple[int, ...], float]]) -> Model:
    """A model from counts by (kind, features, votes)."""
    model, by_kind = Model(), defaultdict(list)
    for kind, feature, vote, n in rows:
        by_kind[kind].append((feature, vote, n))
    for kind, seen in sorted(by_kind.items()):
        counts: dict[tuple[int, ...], float] = defaultdict(float)
        for _, vote, n in sorted(seen):
            counts[vote] += n
        share, tables = model.trust[kind] = reliabilities(dict(counts))
        soft: dict[tuple[int, int], list[float]] = defaultdict(lambda: [0.5, 0.5])
        totals = [0.5, 0.5]
        for feature, vote, n in sorted(seen):
            p = posterior(vote, share, tables)
            totals[0] += n * p
            totals[1] += n * (1 - p)
            for place, value in enumerate(feature):
                soft[place, value][0] += n * p
                soft[place, value][1] += n * (1 - p)
        model.prior[kind] = math.log(totals[0] / totals[1])
        for (place, value), (yes, no) in soft.items():
            model.odds[kind, place, value] = math.log((yes / totals[0]) / (no / totals[1]))
    return model


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """A model from all candidates of ``docs``: one pass, and counts by kind, features and votes, whose number is bounded by their values."""
    candidates = with_candidates(docs.select(text_col), text_col).select(F.explode("candidates").alias("c"))
    names = [f"f{n}" for n in range(FEATURES)] + [f"v{n}" for n in range(LABELERS)]
    shown = candidates.select(F.col("c.kind").alias("kind"), *[x.alias(n) for n, x in zip(names, [*features(F.col("c")), *votes(F.col("c"))], strict=True)])
    counted = shown.groupBy("kind", *names).agg(F.count(F.lit(1)).alias("n")).collect()
    return fit((r["kind"], tuple(r[n] for n in names[:FEATURES]), tuple(r[n] for n in names[FEATURES:]), float(r["n"])) for r in counted)


def _apart(spans: Column, others: Column) -> Column:
    """The spans that share no place with any of ``others``, by one sort: before a span's end is met, the greatest end among the others that have
    begun tells whether one of them reaches into it."""
    end = lambda x: F.struct(x["end"].alias("at"), F.lit(0).alias("begins"), F.lit(0).alias("reach"), x["start"].alias("start"), x["kind"].alias("kind"))
    start = lambda o: F.struct(o["start"].alias("at"), F.lit(1).alias("begins"), o["end"].alias("reach"), o["start"].alias("start"), o["kind"].alias("kind"))

    def free(events: Column) -> Column:
        reached = let(running(F.transform(events, lambda e: e["reach"]), lambda a, b: F.greatest(a, b)),
                      lambda reach: F.filter(events, lambda e, i: (e["begins"] == 0) & (F.get(reach, i) <= e["start"])))
        return F.transform(reached, lambda e: F.struct(e["kind"].alias("kind"), e["start"].alias("start"), e["at"].alias("end")))

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(let(F.sort_array(F.concat(F.transform(spans, end), F.transform(others, start))), free))


def with_spans(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with arrays ``base`` and ``spans`` of (kind number, start, end), ordered by kind and start.

    ``base`` has the base patterns' matches that pass their checks. ``spans`` adds the further forms that pass, that touch no base span and no
    added span of an earlier kind, and that the classifier takes for real. The work grows with a text's spans, but for the sorting.
    """
    short = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))
    docs = with_candidates(docs, text_col, "__found")
    docs = docs.withColumn("base", F.transform(F.filter("__found", lambda c: ~c["extra"] & c["valid"]), short))
    docs = docs.withColumn("__real", F.transform(F.filter("__found", lambda c: c["extra"] & c["valid"] & (model.logit(c) > 0)), short)).drop("__found")
    docs = docs.withColumn("__more", _apart(F.col("__real"), F.col("base")))
    earlier: Callable[[int], Callable[[Column], Column]] = lambda n: lambda s: s["kind"] < n
    added = [F.filter("__more", _is_kind(0)), *[_apart(F.filter("__more", _is_kind(n)), F.filter("__more", earlier(n))) for n in range(1, len(KINDS))]]
    spans = F.when(F.size("__more") == 0, F.col("base")).otherwise(F.concat("base", *added))
    return docs.withColumn("spans", F.sort_array(spans)).withColumn("base", F.sort_array("base")).drop("__more", "__real")


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _is_kind(kind: int) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs``.

    The counts and the digest are of the base spans, ``spans`` lists all. Null and empty texts have no spans; repeated rows give
    equal rows; an empty table gives an empty result; other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    done = with_spans(rows, train(rows))
    counts = [F.size(F.filter("base", _is_kind(kind))).cast("bigint").alias(f"n_{name}") for kind, name in enumerate(KINDS)]
    return done.select(F.col("id").alias(id_col), *counts, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))


def _between(blocks: Column, start: Column, end: Column) -> Column:
    """The characters from ``start`` to ``end`` of a text that is cut into blocks: a place is looked for in its block alone."""
    first, last = F.floor(start / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    block = lambda n: F.coalesce(F.get(blocks, n), F.lit(""))
    across = F.concat(F.substring(block(first), (start % BLOCK + 1).cast("int"), F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""),
                      F.substring(block(last), F.lit(1), (end % BLOCK).cast("int")))
    return F.when(first == last, F.substring(block(first), (start % BLOCK + 1).cast("int"), (end - start).cast("int"))).otherwise(across)


def redact(docs: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """``docs`` with every span in the text replaced by its kind in angle brackets, overlapping spans by those of all that
    begin or go on there. A null text stays null; columns keep their order."""
    columns = docs.columns
    text = F.col(f"`{text_col}`")
    marked = with_spans(docs, model or train(docs, text_col), text_col)
    ordered = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def cleaned(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))

        def build(reach: Column, blocks: Column) -> Column:
            names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
            at = lambda i: F.when(i > 0, F.get(reach, i - 1)).otherwise(0)
            parts = F.transform(spans, lambda s, i: F.when(s["end"] <= at(i), F.lit("")).otherwise(
                F.concat(_between(blocks, at(i), F.greatest(s["start"], at(i))), F.get(names, s["kind"]))))
            return F.concat(F.array_join(parts, ""), _between(blocks, F.get(reach, F.size(reach) - 1), F.length(text)))

        blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
        return let(ends, lambda reach: let(blocks, lambda cut: build(reach, cut)))

    return marked.withColumn(text_col, F.when(text.isNotNull() & (F.size("spans") > 0), let(ordered, cleaned)).otherwise(text)).select(*[F.col(f"`{c}`") for c in columns])
