"""Temperature mixing of sources, with DataFrame functions only.

Source s has the share p_s of all tokens and gets the weight p_s^a / sum of p^a. The exponent a is between 0 (all sources
alike) and 1 (as they come). Falling exponents raise the entropy of the weights and the repetition of the smallest source, both
steadily, so bisection finds the exponent that meets a target.

Weights are realised as budgeted block permutations. A source is read in epochs, each another permutation of its documents
(by hash of id and epoch), until its part of the budget is used up; its last epoch is cut off. The whole mix is cut into
blocks of equal token budgets in which every source has its weight, and the documents of a block are permuted again.
No step sorts a source in one task: an epoch's order is by hash, so documents fall into hash ranges of known token sums.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablemill.session import broadcast_if_small, stage

#: Documents of a hash range: what one task sorts.
RANGE_ROWS = 20_000

#: Token budget of a block.
BLOCK_TOKENS = 1_000_000

#: Halvings of the exponent's interval, and how many one pass over the shares tries ahead.
HALVINGS, AHEAD = 40, 4


@dataclass(frozen=True)
class Mix:
    """What a mix aims at. ``budget`` is in corpora (1: as many tokens as there are) or, with ``cover``, the least at which every document
    of a source that has tokens comes at least once; with ``empty_sources``, documents of sources without any token come once too. ``target_entropy`` is a share of the highest possible entropy (that of equal weights), ``max_repeats`` a limit
    for how often any source is read on average; both may be given, then the exponent meets both where it can."""

    target_entropy: float | None = None
    max_repeats: float | None = None
    budget: float = 1.0
    cover: bool = False
    empty_sources: bool = False

    def __post_init__(self) -> None:
        if self.target_entropy is None and self.max_repeats is None:
            raise ValueError("a mix needs a target entropy or a repetition limit")
        if self.target_entropy is not None and not 0 <= self.target_entropy <= 1:
            raise ValueError("the target entropy is a share between 0 and 1")
        if not self.budget > 0 or (self.max_repeats is not None and self.max_repeats < (1 if self.cover else self.budget)):
            raise ValueError("the budget has to be positive, and the repetition limit no less than it")


def count_tokens(text: Column) -> Column:
    """Words of a text: runs of anything but ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def weights(tokens: DataFrame, mix: Mix) -> DataFrame:
    """(source, tokens, weight, part, repeats, exponent) per source from ``tokens`` (source, tokens), staged.

    ``part`` is the source's budget in tokens (not rounded) and ``repeats`` how often that reads the source. Sources without tokens have weight 0 and part 0.
    The exponent is 1 where the corpus meets the target as it is, and 0 where no exponent reaches the entropy (a target above what the
    sources with tokens allow). Should the limit of repetitions ask for a larger exponent than the entropy does, the limit holds.
    """
    totals = stage(tokens.groupBy("source").agg(F.sum("tokens").alias("tokens")), "totals")
    whole = totals.agg(F.sum("tokens").alias("all"), F.count_if(F.col("tokens") > 0).alias("sources"), F.max("tokens").alias("most"), F.min(F.when(F.col("tokens") > 0, F.col("tokens"))).alias("least")).first()
    everything = whole["all"] or 0
    # shares relative to the largest one, so that no power of them vanishes
    relative = totals.filter("tokens > 0").select((F.col("tokens") / float(whole["most"] or 1)).alias("r"), "tokens")

    def measures(exponents: list[float]) -> list[tuple[float, float]]:
        """Entropy as a share of the highest, and repetitions of the smallest source, for each exponent: one pass."""
        sums = []
        for n, a in enumerate(exponents):
            power = F.pow(F.col("r"), F.lit(a))
            sums += [F.sum(power).alias(f"z{n}"), F.sum(power * F.lit(a) * F.log("r")).alias(f"l{n}")]
        row = relative.agg(*sums).first()
        result = []
        for n, a in enumerate(exponents):
            z = row[f"z{n}"]
            entropy = (_log(z) - row[f"l{n}"] / z) / _log(whole["sources"]) if whole["sources"] > 1 else 1.0
            largest_epochs, smallest_epochs = 1 / (z * whole["most"]), (whole["least"] / whole["most"]) ** a / (z * whole["least"])
            budget = 1 / largest_epochs if mix.cover else mix.budget * everything
            result.append((entropy, smallest_epochs * budget))
        return result

    def bisect(fits) -> float:
        """The exponent at the border of the interval below which ``fits`` holds (entropy) or above which it holds (repetitions)."""
        low, high = 0.0, 1.0
        for _ in range(HALVINGS // AHEAD):
            points = [low + (high - low) * k / 2**AHEAD for k in range(1, 2**AHEAD)]
            known = dict(zip(points, measures(points), strict=True))
            for _ in range(AHEAD):
                middle = min(points, key=lambda p: abs(p - (low + high) / 2))
                low, high = (middle, high) if fits(*known[middle]) else (low, middle)
        return round((low + high) / 2, 9)

    exponent = 1.0
    if whole["sources"] > 1:
        entropy, _ = measures([1.0])[0]
        if mix.target_entropy is not None and entropy < mix.target_entropy:
            exponent = bisect(lambda e, _: e >= mix.target_entropy)
        elif mix.target_entropy is None:
            exponent = 0.0
        if mix.max_repeats is not None and measures([exponent])[0][1] > mix.max_repeats:
            exponent = bisect(lambda _, r: r > mix.max_repeats)
    z = relative.agg(F.sum(F.pow("r", F.lit(exponent)))).first()[0] or 1.0
    budget = z * whole["most"] if mix.cover and whole["most"] else mix.budget * everything
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / float(whole["most"] or 1), F.lit(exponent)) / z).otherwise(0.0)
    part = F.round(weight * F.lit(float(budget)), 3)
    repeats = F.when(F.col("tokens") > 0, part / F.col("tokens")).otherwise(0.0)
    return stage(totals.select("source", "tokens", weight.alias("weight"), part.alias("part"), repeats.alias("repeats"), F.lit(exponent).alias("exponent")), "weights")


def _log(x: float) -> float:
    from math import log

    return log(x)


def order_key(id_: Column, epoch: Column, seed: int) -> Column:
    """32 hexadecimal digits that order an epoch: the MD5 of seed, epoch and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit("-"))))


def _place(key: Column) -> Column:
    """Where an order key lies among all keys: 0 up to but not including 1."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint") / (1 << 32)


def plan(docs: DataFrame, mix: Mix, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 1,
         block_tokens: int = BLOCK_TOKENS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mix as one row per reading of a document: (id_col, source, epoch, n_tokens, block, slot).

    Blocks are numbered from 0, ``slot`` orders a block's documents from 0. Ties of the hash go by id and number of tokens. Documents without
    tokens (null, empty and blank texts) are read as often as whole epochs are, and in the cut one up to the cut; those of a source
    without any token are read once, anywhere, with ``empty_sources`` and else not. A null source is a source of its own. Repeated rows are read once each. An empty table gives an
    empty plan; other columns are not read.
    """
    chosen, shares = _chosen(docs, mix, id_col, source_col, text_col, seed, range_rows)
    total = shares.agg(F.sum("part")).first()[0] or 0.0
    blocks = max(1, round(total / block_tokens))
    along = F.when(F.col("part") > 0, F.col("start") / F.col("part")).otherwise(_place(F.col("key")))
    block = F.least(F.floor(along * blocks).cast("int"), F.lit(blocks - 1))
    chosen = chosen.withColumn("block", block).withColumn("mixed", F.md5(F.concat(F.lit("block:"), "key")))
    slot = F.row_number().over(W.partitionBy("block").orderBy("mixed", "id", "epoch", "source", "tokens")) - 1
    return chosen.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "epoch", F.col("tokens").alias("n_tokens"), "block", slot.cast("int").alias("slot"))


def realise(docs: DataFrame, mix: Mix, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 1, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``docs`` with each row as often as ``plan`` reads it, in the same columns.

    Where a source's last epoch is cut is one row per source, and every row can tell on its own on which side it lies: the texts
    are not shuffled. Edge cases are those of ``plan``.
    """
    chosen, _ = _chosen(docs, mix, id_col, source_col, text_col, seed, range_rows)
    cuts = chosen.groupBy("source").agg(F.max(F.struct("epoch", "key", "id", "tokens")).alias("__cut"))
    cuts = broadcast_if_small(stage(cuts.withColumnRenamed("source", "__of"), "cuts"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumn("__tokens", count_tokens(F.col(f"`{text_col}`"))).join(cuts, F.col(f"`{source_col}`").eqNullSafe(F.col("__of")))
    id_ = F.col(f"`{id_col}`")

    def read(epoch: Column) -> Column:
        here = F.struct(epoch.alias("epoch"), order_key(id_, epoch, seed).alias("key"), id_.alias("id"), F.col("__tokens").alias("tokens"))
        return (epoch < F.col("__cut.epoch")) | (here <= F.col("__cut"))

    return rows.withColumn("__epoch", F.explode(F.filter(F.sequence(F.lit(0), F.col("__cut.epoch")), read))).select(*names)


def _chosen(docs: DataFrame, mix: Mix, id_col: str, source_col: str, text_col: str, seed: int, range_rows: int) -> tuple[DataFrame, DataFrame]:
    """The readings that fit the budgets (id, source, tokens, epoch, key, start, part), and the shares. ``start`` counts the tokens of the source that are read before."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), count_tokens(F.col(f"`{text_col}`")).alias("tokens"))
    rows = stage(rows, "tokens")
    shares = weights(rows, mix)
    epochs = F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("repeats").cast("int"), F.lit(1)) - 1)).alias("epoch")
    read = (F.col("part") > 0) | ((F.col("tokens") == 0) & F.lit(mix.empty_sources))
    live = broadcast_if_small(shares.filter(read).select(F.col("source").alias("of"), F.col("tokens").alias("all"), "part", "repeats"))
    readings = rows.join(live, F.col("source").eqNullSafe(F.col("of"))).select("id", "source", rows["tokens"], "all", "part", "repeats", epochs)
    ranges = max(1, -(-rows.count() // range_rows))
    readings = readings.withColumn("key", order_key(F.col("id"), F.col("epoch"), seed))
    readings = readings.withColumn("range", F.floor(_place(F.col("key")) * ranges).cast("int"))
    sums = readings.groupBy("source", "epoch", "range").agg(F.sum("tokens").alias("n"))
    before = W.partitionBy("source", "epoch").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("of"), F.col("epoch").alias("in"), F.col("range").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy("source", "epoch", "range").orderBy("key", "id", "tokens").rowsBetween(W.unboundedPreceding, -1)
    placed = readings.withColumn("within", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    placed = placed.join(broadcast_if_small(sums), F.col("source").eqNullSafe(F.col("of")) & (F.col("epoch") == F.col("in")) & (F.col("range") == F.col("at")))
    placed = placed.withColumn("start", F.col("epoch") * F.col("all") + F.col("before") + F.col("within"))
    fits = (F.col("start") < F.col("part")) | ((F.col("tokens") == 0) & (F.col("start") <= F.col("part")))
    return placed.filter(fits).select("id", "source", "tokens", "epoch", "key", "start", "part"), shares
