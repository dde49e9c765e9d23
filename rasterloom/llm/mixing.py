"""Mixing of sources to target weights by temperature, as budgeted block permutations; DataFrames only.

Each source's share of the tokens is raised to an exponent and normalised. The exponent is found by
bisection, many points at a time, so that the weights meet a target entropy (as a fraction of the largest
possible) and no source is repeated more than a limit; a step asks Spark for sums over the table of
sources alone. A budget of tokens times a source's weight is then filled with whole permutations of its
documents and, last, a part of one: every pass has its own order, by a hash of the pass and the row.

A pass is dealt in blocks of about ``block`` rows by its hash, the token sums of blocks are added up first,
and the running sum inside a block is taken by itself; a source with a third of all rows has as many more
blocks. Rows are copied once for every pass before they are ordered, so ``rows`` should be narrow: join wide
columns by key afterwards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rasterloom.llm.common import Cuts, table


def words(text: Column) -> Column:
    """Number of ASCII-blank separated words, at least 1, as the measure of a row."""
    t = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return F.greatest(F.lit(1), F.length(t) - F.length(F.translate(t, " ", "")) + 1).cast("long")


def _sums(sources: DataFrame, exponents: list[float]) -> list[tuple[float, float, float]]:
    """For each exponent: the sum of share^a, of share^a ln share^a, and the largest of share^(a-1)."""
    a = []
    for i, e in enumerate(exponents):
        x = F.exp(F.lit(e) * F.col("ln"))
        a += [F.sum(x).alias(f"z{i}"), F.sum(x * F.lit(e) * F.col("ln")).alias(f"s{i}"), F.max(F.exp(F.lit(e - 1) * F.col("ln"))).alias(f"m{i}")]
    r = sources.agg(*a).first()
    return [(r[f"z{i}"], r[f"s{i}"], r[f"m{i}"]) for i in range(len(exponents))]


def exponent(sources: DataFrame, entropy: float, most_passes: float, budget: float = 1.0, grid: int = 32, steps: int = 4) -> float:
    """The largest exponent in [0, 1] at which the weights' entropy is ``entropy`` of ln(sources) or more,
    raised where a source would be seen more than ``most_passes`` times in a budget of ``budget`` corpora.

    sources: ``ln``, the log of each source's share. Both conditions are monotone in the exponent: entropy
    falls with it, and so do the passes over the smallest source. The limit on passes goes before entropy.
    """
    n = sources.count()
    if n < 2:
        return 1.0

    def bisect(good) -> float:
        """The end of the range from 0 on where good holds (0 if nowhere)."""
        lo, hi = 0.0, 1.0
        for _ in range(steps):
            points = [lo + (hi - lo) * i / grid for i in range(grid + 1)]
            ok = [good(e, x) for e, x in zip(points, _sums(sources, points), strict=True)]
            if ok[-1]:
                return points[-1]
            k = max((i for i, x in enumerate(ok) if x), default=-1)
            if k < 0:
                return 0.0
            lo, hi = points[k], points[k + 1]
        return lo

    def flat(_: float, x: tuple[float, float, float]) -> bool:
        z, s, _m = x
        return math.log(z) - s / z >= entropy * math.log(n) - 1e-12

    def repeats(_: float, x: tuple[float, float, float]) -> bool:
        return budget * x[2] / x[0] > most_passes

    by_entropy, by_passes = bisect(flat), bisect(repeats)
    return max(by_entropy, min(1.0, by_passes + 1.0 / grid**steps) if by_passes > 0 else 0.0)


def mix(rows: DataFrame, size: Column, source: str = "source", key: str = "doc_id", entropy: float = 0.98, most_passes: float = 4.0, budget: float = 1.0, block: int = 4096, most_exponent_steps: int = 4) -> DataFrame:
    """The columns of rows, with mix_pass (0: first), mix_tokens, mix_place (tokens of its source before it) and mix_weight.

    The budget is ``budget`` times the tokens in rows, split among the sources by weight; a row belongs to
    the mix if it begins before its source's budget ends, so that a source is over by less than a row. A
    null source is a source. Repeated rows are rows of their own. An empty table gives an empty one. Where
    rows has columns of these names, they are replaced.
    """
    cut = Cuts(rows.sparkSession)
    rows = rows.drop("mix_pass", "mix_tokens", "mix_place", "mix_weight")
    names = rows.columns
    # Sizes are computed once.
    x = cut(rows.select(F.struct(*names).alias("r"), F.col(source).alias("s"), F.col(key).cast("string").alias("k"), size.cast("long").alias("n")))
    per = x.groupBy("s").agg(F.sum("n").alias("tokens"), F.count("*").alias("rows"))
    per = cut(per.where("tokens > 0"))
    total = per.agg(F.sum("tokens")).first()[0]
    extra = [F.lit(0).alias("mix_pass"), F.lit(0).cast("long").alias("mix_tokens"), F.lit(0).cast("long").alias("mix_place"), F.lit(0.0).alias("mix_weight")]
    if not total:
        return rows.select(*names, *extra).limit(0)
    per = per.withColumn("ln", F.log(F.col("tokens") / F.lit(float(total))))
    a = exponent(per, entropy, most_passes, budget, steps=most_exponent_steps)
    z = per.agg(F.sum(F.exp(F.lit(a) * F.col("ln")))).first()[0]
    per = per.withColumn("weight", F.exp(F.lit(a) * F.col("ln")) / F.lit(z))
    # Budgets are whole tokens, so that a last bit of a weight decides nothing.
    per = per.withColumn("goal", F.round(F.col("weight") * F.lit(budget * float(total))).cast("long"))
    per = per.withColumn("whole", F.expr("goal div tokens"))
    per = per.withColumn("part", F.col("goal") - F.col("whole") * F.col("tokens")).withColumn("blocks", F.ceil(F.col("rows") / block))
    per = cut(per.select(F.col("s").alias("of"), "tokens", "weight", "whole", "part", "blocks"))

    # Every pass is a permutation of its own, by a hash of the pass and the row, then key and size (rows equal
    # in these are interchangeable); a block is a range of hashes. The last pass, number ``whole``, is cut at
    # ``part`` tokens.
    passes = F.sequence(F.lit(0).cast("long"), F.col("whole") - F.when(F.col("part") > 0, 0).otherwise(1))
    x = x.join(per, F.col("s").eqNullSafe(F.col("of"))).drop("of").where((F.col("whole") > 0) | (F.col("part") > 0))
    x = x.withColumn("pass", F.explode(passes)).withColumn("order", F.md5(F.concat_ws("|", F.lit("mix"), F.col("pass"), F.col("k"), F.col("n"))))
    x = x.withColumn("b", F.shiftright(F.conv(F.substring("order", 1, 8), 16, 10).cast("long") * F.col("blocks"), 32))
    in_block = x.groupBy("s", "pass", "b").agg(F.sum("n").alias("sum"))
    before = in_block.withColumn("before", F.coalesce(F.sum("sum").over(W.partitionBy("s", "pass").orderBy("b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    # A block that begins behind the budget's end has no row in the mix.
    before = before.select(F.col("s").alias("bs"), F.col("pass").alias("bp"), F.col("b").alias("bb"), "before")
    x = x.join(before, F.col("s").eqNullSafe(F.col("bs")) & (F.col("pass") == F.col("bp")) & (F.col("b") == F.col("bb")))
    x = x.where((F.col("pass") < F.col("whole")) | (F.col("before") < F.col("part")))
    at = F.coalesce(F.sum("n").over(W.partitionBy("s", "pass", "b").orderBy("order", "k", "n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) + F.col("before")
    x = x.withColumn("at", at).where((F.col("pass") < F.col("whole")) | (F.col("at") < F.col("part")))
    return x.select("r.*", F.col("pass").cast("int").alias("mix_pass"), F.col("n").alias("mix_tokens"), (F.col("pass") * F.col("tokens") + F.col("at")).cast("long").alias("mix_place"), F.col("weight").alias("mix_weight"))


def op5(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "source", words(F.col("text")).alias("n"))
    return mix(rows, F.col("n")).select("doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_pass").alias("pass"), F.col("mix_place").alias("place"), F.round("mix_weight", 12).alias("weight"))
