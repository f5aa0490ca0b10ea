"""Word pairs in a forward window, unigrams, PMI and negative samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def skipgrams(lines: DataFrame, window: int, tokens: str = "tokens", *carry: str) -> DataFrame:
    """All pairs (a, b) of a line with b at most `window` places behind a, made inside
    the row: no join, no shuffle; pairs never cross lines."""
    if window < 0:
        raise ValueError("window must not be negative")
    ts = F.col(tokens)
    followers = F.transform(ts, lambda a, i: F.transform(F.slice(ts, i + 2, F.lit(window)), lambda b: F.struct(a.alias("a"), b.alias("b"))))
    return lines.where(F.size(ts) > 1).select(*carry, F.inline(F.flatten(followers)))


def skipgrams_ordered(lines: DataFrame, window: int, tokens: str = "tokens", *carry: str) -> DataFrame:
    """The same with pos (of a) and dist, for consumers that depend on order."""
    ts = F.col(tokens)
    followers = F.transform(ts, lambda a, i: F.transform(F.slice(ts, i + 2, F.lit(window)), lambda b, j: F.struct(i.alias("pos"), (j + 1).alias("dist"), a.alias("a"), b.alias("b"))))
    return lines.where(F.size(ts) > 1).select(*carry, F.inline(F.flatten(followers)))


def unigrams(lines: DataFrame, tokens: str = "tokens") -> DataFrame:
    return lines.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("cnt"))


def margins(lines: DataFrame, window: int, tokens: str = "tokens") -> DataFrame:
    """token, ca, cb: in how many pairs of `skipgrams` a word stands first and second. A
    word has min(window, words behind it) followers and min(window, words before it)
    leaders, so no pair is made."""
    words = lines.select(F.size(tokens).alias("n"), F.posexplode(tokens).alias("pos", "token"))
    after, before = F.least(F.lit(window), F.col("n") - 1 - F.col("pos")), F.least(F.lit(window), F.col("pos"))
    return words.groupBy("token").agg(F.sum(after).alias("ca"), F.sum(before).alias("cb"))


def pmi(lines: DataFrame, window: int, least: int = 1, tokens: str = "tokens") -> DataFrame:
    """a, b, cnt, pmi = ln(c(a,b) N / (c(a) c(b))) of the pairs of `skipgrams`, where
    c(a,b) is at least `least`.

    Pairs are made, shuffled and counted once (combined before the shuffle); margins come
    from the words. A word of fewer than `least` pairs on a side is in no kept pair there.
    """
    counts = skipgrams(lines, window, tokens).groupBy("a", "b").agg(F.count("*").alias("cnt"))
    facts = margins(lines, window, tokens)
    left = facts.where(F.col("ca") >= max(least, 1)).select(F.col("token").alias("a"), "ca")
    right = facts.where(F.col("cb") >= max(least, 1)).select(F.col("token").alias("b"), "cb")
    total = F.broadcast(facts.agg(F.sum("ca").alias("n")))
    joined = meet(meet(counts.where(F.col("cnt") >= least), left, "a", "b"), right, "b", "a").join(total)
    ratio = F.col("cnt").cast("double") * F.col("n") / (F.col("ca").cast("double") * F.col("cb"))
    return joined.select("a", "b", "cnt", F.ln(ratio).alias("pmi"))


#: Parts into which the rows of a frequent key are dealt in a join.
SALTS = 16


def meet(rows: DataFrame, facts: DataFrame, key: str, *salt: str, how: str = "inner") -> DataFrame:
    """rows joined with at most one fact for each key, where a key may have any share of
    the rows: each is dealt to one of `SALTS` parts by other columns, and the facts are
    repeated for each part. They are never broadcast: Spark's estimate of their size leaves
    out that they are repeated."""
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    dealt = rows.withColumn("__part", F.pmod(F.xxhash64(*salt), F.lit(SALTS)))
    return dealt.join(facts.withColumn("__part", parts).hint("merge"), [key, "__part"], how).drop("__part")


def negatives(pairs: DataFrame, unigram_slots: DataFrame, slots: int, per_pair: int, draw: Column, coin: Column) -> DataFrame:
    """Each pair with `per_pair` corrupted ones: a side chosen by `coin` (0 or 1, may use
    column j) is replaced by the token in slot `draw` mod `slots` of unigram_slots
    (slot, token). a, b, real."""
    # one scan: place 0 is the pair itself, the others are corrupted
    each = pairs.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(per_pair)))).withColumn("slot", F.when(F.col("j") > 0, F.pmod(draw, F.lit(slots)))).withColumn("__coin", coin)
    if slots <= 100_000:
        drawn = each.join(F.broadcast(unigram_slots), "slot", "left")
    else:
        drawn = each.join(unigram_slots, "slot", "left")
    real, first = F.col("j") == 0, F.col("__coin") == 0
    drawn = drawn.where(real | F.col("token").isNotNull())
    return drawn.select(F.when(real | first, F.col("a")).otherwise(F.col("token")).alias("a"), F.when(real | ~first, F.col("b")).otherwise(F.col("token")).alias("b"), real.alias("real"))
