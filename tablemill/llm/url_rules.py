"""URL filtering: a list of host and path rules first, then rules that FP-growth mines from labelled pages.

A URL is a set of tokens (scheme, host, its labels, path segments, extension, query keys). Spark's FP-growth finds the token
combinations that are frequent among labelled pages, a page of the blocked class having one token more. Its association rules that end in
that token are pruned by support, confidence, lift and significance, and matched by an inverted index: a rule is filed under its rarest
token, so a page only meets rules of which it has that token, and then has to have all others.

Before mining, tokens that no rule can hold go, and tokens that stand in exactly the same labelled pages become one (a host implies its labels).
A token that is a rule by itself is taken out of the combinations, as a page that has it is blocked whatever else it has. All other tokens of
all labelled pages are mined, however many a URL has.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.session import broadcast_if_small, stage

#: Share of the labelled pages that a rule has to hold for, their least number, and share of the pages with its tokens that have to be of the
#: blocked class.
LEAST_SUPPORT, LEAST_ROWS, LEAST_CONFIDENCE = 0.002, 5, 0.6

#: How far the confidence has to lie above the share of blocked pages: as a lift of the odds, and in standard deviations of that share among as
#: many pages.
LEAST_LIFT, LEAST_DEVIATIONS = 2.0, 4.0

BLOCKED = "#blocked"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^(.*?)://([^/?#]*)([^?#]*)(\??[^#]*)"


@dataclass(frozen=True)
class Rule:
    """``verdict`` is allow or block; the rule holds for ``host`` and all its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def parse(text: str) -> Rule:
    """A rule written as ``allow net/`` or ``block example.net/a/b``."""
    verdict, _, place = text.partition(" ")
    host, slash, path = place.partition("/")
    if verdict not in ("allow", "block") or not host:
        raise ValueError(f"not a rule: {text!r}")
    return Rule(verdict, host.lower(), slash + path)


def host_of(url: Column) -> Column:
    """From the first :// to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 2), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, _URL, 3), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """struct<rule, verdict> of the longest rule that fits, or null; of two equally long ones the blocking one holds. The list is part of the query."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    by_host: dict[str, list[Rule]] = {}
    for rule in rules:
        by_host.setdefault(rule.host, []).append(rule)
    shape = lambda r: F.struct(F.lit(len(r.name)).alias("size"), F.lit(r.verdict).alias("verdict"), F.lit(r.name).alias("rule"), F.lit(r.path).alias("path"))
    index = F.create_map(*[x for name, listed in by_host.items() for x in (F.lit(name), F.array(*map(shape, listed)))])
    labels = F.split(host, r"\.", -1)
    suffixes = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels) - i), "."))
    fitting = F.filter(F.flatten(F.transform(F.filter(suffixes, lambda s: F.map_contains_key(index, s)), lambda s: F.try_element_at(index, s))), lambda r: F.startswith(path, r["path"]))
    longest = F.array_max(fitting)  # by size, then verdict ("block" after "allow")
    return F.when(longest.isNotNull(), F.struct(longest["rule"].alias("rule"), longest["verdict"].alias("verdict")))


def tokens(url: Column) -> Column:
    """The distinct tokens of a URL: kind, colon, value. Digits in a path count as one token each run; a URL without host has none."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(url, _URL, 4)
    named = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(f"{kind}:"), v))
    labels = F.split(host, r"\.", -1)
    segments = F.filter(F.split(F.regexp_replace(F.regexp_replace(path, r"\.[A-Za-z0-9]{1,8}$", ""), "[0-9]+", "0"), "/"), lambda s: s != "")
    keys = F.filter(F.transform(F.split(F.ltrim(query, F.lit("?")), "&"), lambda p: F.substring_index(p, "=", 1)), lambda k: k != "")
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1)
    parts = F.concat(named("scheme", F.array(F.lower(F.regexp_extract(url, _URL, 1)))), named("host", F.array(host)), named("label", labels), named("path", segments),
                     named("key", keys), F.when(extension != "", named("ext", F.array(extension))).otherwise(F.array().cast("array<string>")))
    return F.when(host != "", F.array_distinct(parts)).otherwise(F.array().cast("array<string>"))


def counted_tokens(rows: DataFrame, least: int) -> DataFrame:
    """(token, n, hits), staged, of the tokens of (row, tokens, blocked) that stand in ``least`` rows; of tokens that stand in the same rows (told by a
    hash over them) the first by name is kept."""
    each = rows.select("row", "blocked", F.explode("tokens").alias("token"))
    counted = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("hits"), F.bit_xor(F.xxhash64("row")).alias("where")).filter(F.col("n") >= least)
    return stage(counted.groupBy("n", "hits", "where").agg(F.min("token").alias("token")).select("token", "n", "hits"), "tokens")


def kept_tokens(rows: DataFrame, counted: DataFrame, share: float, most_tokens: int | None = None) -> DataFrame:
    """(row, tokens) for the rows of (row, tokens, blocked) that keep any token of ``counted`` (token, n, hits).

    With ``most_tokens``, only for callers who want fewer combinations, a row keeps as many whose share of blocked rows deviates most from ``share``,
    measured in standard deviations, the first by name of equals.
    """
    each = rows.select("row", F.explode("tokens").alias("token"))
    away = F.round(F.abs(F.col("hits") - F.lit(share) * F.col("n")) / F.sqrt("n"), 9)
    ranked = counted.select("token", F.struct((-away).alias("away"), F.col("token")).alias("rank"))
    ranks = F.sort_array(F.collect_list("rank"))
    best = each.join(broadcast_if_small(ranked), "token").groupBy("row").agg((ranks if most_tokens is None else F.slice(ranks, 1, most_tokens)).alias("ranks"))
    return best.select("row", F.transform("ranks", lambda r: r["token"]).alias("tokens"))


def mine(labelled: DataFrame, least_support: float = LEAST_SUPPORT, least_confidence: float = LEAST_CONFIDENCE, least_rows: int = LEAST_ROWS,
         least_lift: float = LEAST_LIFT, least_deviations: float = LEAST_DEVIATIONS, most_tokens: int | None = None) -> DataFrame:
    """Rules (antecedent, filed, confidence, support) from ``labelled`` (tokens, blocked), staged. ``filed`` is the rarest token of the antecedent.

    Rows without tokens and with a null ``blocked`` are left out; without any row, and where all rows or none are blocked, there are no rules.
    A URL has a rule among its tokens if and only if it has one among all combinations: of those that contain a rule of one token only that
    rule is returned, and a combination has to stand in as many blocked rows as a rule without any other row needs for its deviation.
    ``most_tokens`` mines all combinations, those of single rules too, of as many tokens a row.
    """
    schema = "antecedent array<string>, filed string, confidence double, support double"
    known = labelled.filter(F.col("blocked").isNotNull() & (F.size("tokens") > 0))
    rows = stage(known.select(F.monotonically_increasing_id().alias("row"), F.array_distinct("tokens").alias("tokens"), "blocked"), "labelled")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("blocked")).first()
    if whole["blocked"] in (0, whole["n"]):
        return labelled.sparkSession.createDataFrame([], schema)
    n, share = whole["n"], whole["blocked"] / whole["n"]
    least = max(least_rows, math.ceil(least_support * n))
    counted, alone = counted_tokens(rows, least), None

    def holds(confidence: Column, count: Column) -> Column:
        deviations = (confidence - share) / F.sqrt(F.lit(share * (1 - share)) / count)
        return (confidence >= least_confidence) & (confidence * (1 - share) >= least_lift * share * (1 - confidence)) & (deviations >= least_deviations)

    if most_tokens is None:
        least = max(least, math.ceil(least_deviations ** 2 * share / (1 - share) - 1e-6))  # the deviation of h blocked rows and no other is sqrt(h * (1 - share) / share)
        judged = counted.filter(F.col("hits") >= least).withColumn("rule", holds(F.col("hits") / F.col("n"), F.col("n")))
        alone, counted = judged.filter("rule"), judged.filter("not rule")
    few = rows.select("row", "blocked").join(kept_tokens(rows, counted, share, most_tokens), "row", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    items = stage(few.select(F.when(F.col("blocked"), F.array_append("tokens", F.lit(BLOCKED))).otherwise(F.col("tokens")).alias("items")), "transactions")
    partitions = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / n, minConfidence=least_confidence, numPartitions=partitions).fit(items)
    apart = holds(F.col("confidence"), F.col("support") * n / F.col("confidence"))
    found = model.associationRules.filter((F.col("consequent") == F.array(F.lit(BLOCKED))) & apart).select("antecedent", "confidence", "support")
    rules = stage(found, "rules")
    single = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    filed = rules.select("*", F.explode("antecedent").alias("token")).join(single, "token")
    filed = filed.groupBy("antecedent").agg(F.min_by("token", F.struct("freq", "token")).alias("filed"), F.first("confidence").alias("confidence"), F.first("support").alias("support"))
    if alone is not None:
        filed = filed.unionByName(alone.select(F.array("token").alias("antecedent"), F.col("token").alias("filed"), (F.col("hits") / F.col("n")).alias("confidence"), (F.col("hits") / n).alias("support")))
    return stage(filed, "filed")


def hits(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct rows of ``urls`` (url, tokens) for which a mined rule holds, as (url)."""
    index = broadcast_if_small(rules.select(F.col("filed").alias("token"), "antecedent"))
    met = urls.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return met.filter(F.size(F.array_except("antecedent", "tokens")) == 0).select("url").distinct()


def judge(pages: DataFrame, labels: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id") -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row of ``pages``.

    ``rule`` is the longest listed rule that fits, or null; then the mined rules decide: block where one holds, else allow. A page is labelled where
    ``labels`` has its id; the blocked class is toxic = 1 or quality = 0, rows of several or null labels count where one says so. Null URLs and those
    without a host are allowed unless listed. Repeated rows give equal rows; empty tables give an empty result or no mined rules; other columns are not read.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"))
    said = labels.select(F.col(f"`{label_id}`").alias("id"), (F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))).alias("blocked"))
    said = said.groupBy("id").agg(F.max("blocked").alias("blocked"))
    labelled = rows.join(said, "id").select(tokens(F.col("url")).alias("tokens"), "blocked")
    mined = mine(labelled)
    distinct = rows.filter(F.col("url").isNotNull()).select("url").distinct()
    blocked = hits(distinct.select("url", tokens(F.col("url")).alias("tokens")), mined).withColumn("hit", F.lit(True))
    placed = rows.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    listed = placed.withColumn("listed", matching_rule(F.col("host"), F.col("path"), rules))
    open_, closed = listed.filter("listed is null"), listed.filter("listed is not null")
    judged = open_.join(blocked, "url", "left").select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.when(F.col("hit"), "block").otherwise("allow").alias("verdict"))
    result = judged.union(closed.select("id", "host", "path", "listed.rule", "listed.verdict"))
    return result.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict")
