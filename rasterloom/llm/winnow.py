"""Winnowing fingerprints of documents, by SQL functions only.

The grams are runs of ``k`` words (white space apart; a text with fewer words is one gram). Each word is hashed
once; a gram's hash is the polynomial of its words' hashes modulo a prime, rolled over the text by doubling:
runs of 2w words come from two runs of w side by side, so all grams take as many steps as k has bits. Of every
``window`` grams in a row the smallest is chosen, the rightmost of equal ones, and kept with its position, so
that any run of k + window - 1 words that two texts share gives them a common fingerprint whose positions say
where. A chosen gram is one long, its hash of 31 bits above 32 bits that hold the position from the right; so
the least long is the least hash and the rightmost of ties. Window minima come from doubling steps over whole
arrays as well instead of a scan of each window.

Null and empty texts, and those of white space, have an empty fingerprint; equal texts have equal ones, in
whatever row; very long texts are read whole; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rasterloom.llm.common import Cuts, parts, table

_LOW = (1 << 32) - 1
_PRIME, _BASE = (1 << 31) - 1, 1_000_003


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.col(text)), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def _grams(df: DataFrame, words: str, out: str, k: int) -> DataFrame:
    """Adds ``out``: the longs of all grams of the array ``words``."""
    one, roll = "_one", F.col(out)
    hashed = lambda x: F.pmod(F.xxhash64(x), F.lit(_PRIME))
    df = df.withColumn(one, F.transform(words, hashed)).withColumn(out, F.col(one))

    def joined(left: Column, width: int, right: Column, by: int) -> Column:
        """Runs of ``width + by`` words from those of ``width`` and, behind them, those of ``by``."""
        n = F.greatest(F.size(left) - by, F.lit(0))
        up = F.lit(pow(_BASE, by, _PRIME)).cast("long")
        return F.zip_with(F.slice(left, 1, n), F.slice(right, 1 + width, n), lambda a, b: F.pmod(a * up + b, F.lit(_PRIME)))

    width = 1
    for bit in bin(k)[3:]:
        df, width = df.withColumn(out, joined(roll, width, roll, width)), 2 * width
        if bit == "1":
            df, width = df.withColumn(out, joined(roll, width, F.col(one), 1)), width + 1
    w = F.col(words)
    short = F.when(F.size(w) > 0, F.array(_long(hashed(F.concat_ws(" ", w)), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.when(F.size(w) >= k, F.transform(roll, _long)).otherwise(short)).drop(one)


def _long(gram: Column, i: Column) -> Column:
    return F.shiftleft(gram, 32).bitwiseOR(F.lit(_LOW) - i.cast("long"))


def _minima(df: DataFrame, col: str, window: int) -> DataFrame:
    """Replaces grams by the minima of all runs of ``window`` (of all of them, where they are fewer)."""
    x, width = F.col(col), 1
    step = lambda by: F.when(
        F.size(x) > by, F.zip_with(F.slice(x, 1, F.size(x) - by), F.slice(x, 1 + by, F.size(x) - by), lambda a, b: F.least(a, b))
    ).when(F.size(x) > 1, F.array(F.array_min(x))).otherwise(x)
    while width < window:
        by = min(width, window - width)
        df, width = df.withColumn(col, step(by)), width + by
    return df.withColumn(col, F.array_distinct(col))


def fingerprints(df: DataFrame, text: str, out: str, k: int = 5, window: int = 8) -> DataFrame:
    """Adds ``out``, an array of longs (see above), in the order of positions; empty for a text without words."""
    df = _grams(df.withColumn("_w", _words(text)), "_w", out, k).drop("_w")
    return _minima(df, out, window)


def shown(fp: str) -> Column:
    """hash:position of each chosen gram, comma-joined."""
    return F.array_join(F.transform(fp, lambda v: F.concat(F.lower(F.hex(F.shiftrightunsigned(v, 32))), F.lit(":"), (F.lit(_LOW) - v.bitwiseAND(F.lit(_LOW))).cast("string"))), ",")


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity of two fingerprints' hashes; two empty ones are alike, an empty one and another not."""
    x, y = (F.transform(c, lambda v: F.shiftright(v, 32)) for c in (a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def _ranges(spark, cuts: list[float]) -> tuple[Callable[[Column], Column], DataFrame]:
    """Ranges between sorted ends, which may be many: the group of a value as an expression of few literals, and a
    table with a row for each group: its first range, and the ends inside it, some of them as ``mid`` and the ones
    between these as ``fine``. The table has as many numbers as there are ends, and is broadcast.
    """
    side = max(1, round(len(cuts) ** (1 / 3)))
    step = max(1, -(-len(cuts) // side))
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)] or [[]]
    rows = []
    for g, ends in enumerate(groups):
        per = max(1, round(len(ends) ** 0.5))
        rows.append((g, g * step, per, [float(x) for x in ends[per - 1 :: per]], [[float(x) for x in ends[i : i + per]] for i in range(0, len(ends), per)] + [[]]))
    coarse = F.array(*(F.lit(float(g[0])) for g in groups[1:])).cast("array<double>")
    return lambda c: F.size(F.filter(coarse, lambda x: x <= c)), spark.createDataFrame(rows, "g int, first int, per int, mid array<double>, fine array<array<double>>")


def with_next(rows: DataFrame, id_: str, tie: Column, bring: list[str], per: int = 20000, then: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Adds next_<column> of the row that follows by ``id_``, then ``tie`` (the first, after the last).

    Rows are dealt into ranges of the id by approximate quantiles, and the first row of each range is
    given to the range before it as well, so no window spans the table. Ranges, and their first rows, are
    tables with a row per range or fewer, which are broadcast. ``then`` adds columns to bring to rows and to the
    few that are given twice. Null ids come first.
    """
    spark = rows.sparkSession
    ids = Cuts(spark)(rows.select(F.col(id_).alias("id"), tie.alias("tie")))
    n = ids.count()
    ranges = max(1, n // per, min(4 * parts(spark), n // 20))
    cuts = sorted(set(ids.select(F.col("id").cast("double").alias("id")).approxQuantile("id", [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    group, inside = _ranges(spark, cuts)

    def ranged(df: DataFrame, c: str, out: str) -> DataFrame:
        names = df.columns
        x = df.withColumn("_id", F.col(c).cast("double")).withColumn("_g", F.when(F.col("_id").isNull(), F.lit(0)).otherwise(group(F.col("_id"))))
        x = x.join(F.broadcast(inside.select(F.col("g").alias("_g"), F.struct("first", "per", "mid", "fine").alias("_in"))), "_g")
        a = F.size(F.filter("_in.mid", lambda e: e <= F.col("_id")))
        x = x.withColumn("_a", a)
        b = F.size(F.filter(F.get(F.col("_in.fine"), F.col("_a")), lambda e: e <= F.col("_id")))
        place = F.when(F.col("_id").isNull(), F.lit(0)).otherwise(F.col("_in.first") + F.col("_a") * F.col("_in.per") + b)
        return x.select(*names, place.alias(out))

    first = ranged(ids, "id", "range").groupBy("range").agg(F.min(F.struct("id", "tie")).alias("f"))
    order = W.orderBy("range")  # as many rows as there are ranges
    first = first.select("f", F.coalesce(F.lag("range").over(order), F.max("range").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("to"))
    first = F.broadcast(first)
    base = rows.withColumn("_tie", tie)
    real = then(ranged(base, id_, "_range").withColumn("_ghost", F.lit(False)))
    ghost = base.join(first, F.col(id_).eqNullSafe(F.col("f.id")) & F.col("_tie").eqNullSafe(F.col("f.tie")))
    ghost = then(ghost.withColumn("_range", F.col("to")).withColumn("_ghost", F.lit(True)).drop("f", "to"))
    w = W.partitionBy("_range").orderBy("_ghost", F.col(id_).asc_nulls_first(), "_tie")
    both = real.unionByName(ghost)
    for c in bring:
        both = both.withColumn(f"next_{c}", F.lead(c).over(w))
    return both.where("not _ghost").drop("_tie", "_range", "_ghost")


def compare_with_edited(docs: DataFrame, id_: str = "doc_id", text: str = "text", k: int = 5, window: int = 8) -> DataFrame:
    """``id_``, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and both
    fingerprints as arrays of (hash, position) in ``marks`` and ``edited_marks``.

    The edited text has the last quarter of the code points replaced by the first as many of the next row
    by id; rows of equal id follow each other by their texts' hashes. Nulls count as empty texts. A single
    row is its own next one.
    """
    rows = docs.select(docs[id_].alias("id"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("t"))
    rows = with_next(rows, "id", F.xxhash64("t"), ["t", "fp"], then=lambda df: fingerprints(df, "t", "fp", k, window))
    rows = rows.withColumn("n", F.char_length("t").cast("long")).withColumn("q", F.floor(F.col("n") / 4).cast("int"))
    rows = rows.withColumn("e", F.concat(F.substring("t", F.lit(1), F.col("n").cast("int") - F.col("q")), F.substring("next_t", F.lit(1), F.col("q"))))
    rows = rows.select("id", "n", "fp", "next_fp", "e", F.sha2("e", 256).alias("sha"))
    rows = fingerprints(rows, "e", "efp", k, window)
    marks = lambda fp: F.transform(fp, lambda v: F.struct(F.shiftrightunsigned(v, 32).alias("hash"), (F.lit(_LOW) - v.bitwiseAND(F.lit(_LOW))).alias("position")))
    return rows.select(
        F.col("id").alias(id_), F.col("n").alias("n_chars"), F.col("sha").alias("edited_sha256"), shown("fp").alias("fingerprint"), shown("efp").alias("edited_fingerprint"),
        likeness("fp", "efp").alias("near_edited"), likeness("fp", "next_fp").alias("near_next"), marks("fp").alias("marks"), marks("efp").alias("edited_marks"),
    )


def op7(spark, sf_dir: str) -> DataFrame:
    out = compare_with_edited(table(spark, sf_dir, "documents"))
    return out.drop("marks", "edited_marks")
