"""Sharding along a Hilbert curve over several metadata dimensions, by SQL functions only.

Each dimension is quantised to ``bits`` bits by its approximate quantiles (so cells are about as full as
each other), or by a hash for text values, the cells are numbered along the curve, and runs of about equal
bytes are cut from that order: files of a shard span small ranges of every dimension.

Rows of one group (equal texts) count as one place, that of their least coordinates, and follow each other;
a cut moves to the edge of a group where that is within ``slack`` of a shard's size. Running sums are taken
without a window over the table: groups of equal texts are added up first, then the groups in sub-cells (a cell
and some bits of the text's hash, more of them where the table is larger), then sub-cells in their cell, then
cells, of which there is a fixed number; rows within a group have one size, so their places need only counts,
dealt by a hash of the id into parts whose number grows with the table as well, so that no group is one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from rasterloom.llm.common import Cuts, table


def curve(coordinates: list[Column], bits: int) -> Column:
    """Place along the Hilbert curve of integer coordinates below 2^bits (Skilling's transform), as SQL.

    The coordinates are an array that folds carry along, so that the expression stays small.
    """
    n = len(coordinates)
    x = F.array(*(c.cast("long") for c in coordinates))
    xor = lambda a, b: a.bitwiseXOR(b)
    bit = lambda a, q: a.bitwiseAND(q) != 0

    def undo(x: Column, s: Column) -> Column:
        """One step: where the bit is set the first coordinate's lower bits turn, else they change places."""
        low = s["q"] - 1
        own = F.get(x, s["i"])
        t = xor(F.get(x, 0), own).bitwiseAND(low)
        return F.transform(x, lambda v, j: F.when(bit(own, s["q"]), F.when(j == 0, xor(v, low)).otherwise(v)).otherwise(F.when((j == 0) | (j == s["i"]), F.when(s["i"] == 0, v).otherwise(xor(v, t))).otherwise(v)))

    steps = [(1 << b, i) for b in range(bits - 1, 0, -1) for i in range(n)]
    if steps:
        x = F.aggregate(F.array(*(F.struct(F.lit(q).cast("long").alias("q"), F.lit(i).alias("i")) for q, i in steps)), x, undo)
    gray = F.aggregate(x, F.array().cast("array<bigint>"), lambda acc, v: F.concat(acc, F.array(xor(v, F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0).cast("long"))))))

    def number(g: Column) -> Column:
        last = F.get(g, n - 1)
        t = F.lit(0).cast("long")
        for b in range(1, bits):
            t = xor(t, F.when(bit(last, F.lit(1 << b)), F.lit((1 << b) - 1)).otherwise(F.lit(0)).cast("long"))
        out = F.transform(g, lambda v: xor(v, t))
        places = F.array(*(F.struct(F.lit(b).alias("b"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)))
        return F.aggregate(F.array(out), F.lit(0).cast("long"), lambda _, v: F.aggregate(places, F.lit(0).cast("long"), lambda acc, p: F.shiftleft(acc, 1).bitwiseOR(F.call_function("shiftright", F.get(v, p["i"]), p["b"]).bitwiseAND(F.lit(1).cast("long")))))

    return F.aggregate(F.array(gray), F.lit(0).cast("long"), lambda _, g: number(g))


def quantised(rows: DataFrame, name: str, bits: int) -> Column:
    """Of numbers the approximate quantile, of other values a hash, below 2^bits; nulls are 0."""
    c = F.col(name)
    if rows.schema[name].dataType.typeName() in ("byte", "short", "integer", "long", "float", "double") or rows.schema[name].dataType.typeName().startswith("decimal"):
        size = 1 << bits
        edges = rows.select(c.cast("double").alias("c")).where("c is not null and not isnan(c)").approxQuantile("c", [i / size for i in range(1, size)], 0.25 / size)
        edges = F.array(*(F.lit(float(e)) for e in edges)).cast("array<double>")
        return F.coalesce(F.size(F.filter(edges, lambda e: e <= c.cast("double"))), F.lit(0)).cast("long")
    return F.when(c.isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(c.cast("string")), F.lit(1 << bits))).cast("long")


def shard(rows: DataFrame, dimensions: list[str], size: Column, group: list[Column], tie: Column, shards: int = 16, bits: int = 3, slack: float = 0.05, deal: int = 20000) -> DataFrame:
    """The columns of rows, with shard, slot (gapless from 0 in each shard), bytes and cell (the curve's index).

    ``size`` must follow from ``group``. Shards' sums of size are equal to within a row, or ``slack`` of
    a shard where a cut moved to the edge of a group. A group is ranked in parts, and a cell's groups are added
    up in sub-cells, that hold at most about ``deal`` rows. Nulls are values. Columns so named are replaced.
    """
    spark = rows.sparkSession
    cut = Cuts(spark)
    rows = rows.drop("shard", "slot", "bytes", "cell")
    names = rows.columns
    at = [quantised(rows, d, bits) for d in dimensions]
    x = rows.select(F.struct(*names).alias("r"), *(a.alias(f"d{i}") for i, a in enumerate(at)), F.xxhash64(*group).alias("g"), size.cast("long").alias("bytes"), F.xxhash64(tie).alias("tie"))
    x = cut(x)
    n = x.count()
    x = x.withColumn("deal", F.pmod("tie", F.lit(max(16, n // deal))))
    d = [f"d{i}" for i in range(len(at))]
    run = lambda part, *by: W.partitionBy(*part).orderBy(*by).rowsBetween(W.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    # Rows of a group by deal; groups, each in the cell of its least coordinates; sub-cells of groups by hash.
    dealt = x.groupBy("g", "bytes", "deal").agg(F.count("*").alias("c"), *(F.min(c).alias(c) for c in d))
    dealt = cut(dealt.withColumn("r0", zero(F.sum("c").over(run(["g", "bytes"], "deal")))))
    groups = dealt.groupBy("g", "bytes").agg(F.sum("c").alias("c"), *(F.min(c).alias(c) for c in d))
    groups = cut(groups.select("g", "bytes", "c", curve([F.col(c) for c in d], bits).alias("cell"), F.pmod("g", F.lit(max(8, n // deal))).alias("sub")))
    subs = groups.groupBy("cell", "sub").agg(F.sum(F.col("c") * F.col("bytes")).alias("b"), F.sum("c").alias("c"))
    # Sub-cells run in their cell; of cells there are 2^(bits * dimensions) at most, whatever the input.
    in_cell = run(["cell"], "sub")
    subs = subs.withColumn("b0", zero(F.sum("b").over(in_cell))).withColumn("n0", zero(F.sum("c").over(in_cell)))
    cells = subs.groupBy("cell").agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    cells = cells.select("cell", zero(F.sum("b").over(run([], "cell"))).alias("b1"), zero(F.sum("c").over(run([], "cell"))).alias("n1"))
    subs = subs.join(F.broadcast(cells), "cell").select("cell", "sub", (F.col("b0") + F.col("b1")).alias("b0"), (F.col("n0") + F.col("n1")).alias("n0"))
    subs = cut(subs)
    total = groups.agg(F.sum(F.col("c") * F.col("bytes"))).first()[0] or 0
    goal = max(total / shards, 1e-9)
    groups = groups.join(subs, ["cell", "sub"])
    in_sub = run(["cell", "sub"], "g", "bytes")
    groups = groups.withColumn("b0", F.col("b0") + zero(F.sum(F.col("c") * F.col("bytes")).over(in_sub))).withColumn("n0", F.col("n0") + zero(F.sum("c").over(in_sub)))
    # A cut inside the group that has an edge near goes there.
    end = F.col("b0") + F.col("c") * F.col("bytes")
    lo, hi = F.floor((F.col("b0") + F.lit(0.5) * F.col("bytes")) / goal), F.floor((end - F.lit(0.5) * F.col("bytes")) / goal)
    whole = F.when(lo == hi, lo).when((hi == lo + 1) & (hi * goal - F.col("b0") <= slack * goal) & (hi * goal - F.col("b0") <= end - hi * goal), hi).when((hi == lo + 1) & (end - hi * goal <= slack * goal), lo)
    groups = groups.select("cell", "g", "bytes", "b0", "n0", F.least(whole, F.lit(shards - 1)).cast("int").alias("whole"))
    place = dealt.join(groups, ["g", "bytes"]).select("cell", "g", "bytes", "deal", "b0", (F.col("n0") + F.col("r0")).alias("n0"), "r0", "whole")
    ranked = x.withColumn("i", F.row_number().over(W.partitionBy("g", "bytes", "deal").orderBy("tie")) - 1)
    ranked = ranked.join(place, ["g", "bytes", "deal"])
    by_row = F.least(F.floor((F.col("b0") + (F.col("r0") + F.col("i") + F.lit(0.5)) * F.col("bytes")) / goal), F.lit(shards - 1)).cast("int")
    ranked = ranked.select("r", "bytes", "cell", (F.col("n0") + F.col("i")).alias("n"), F.coalesce("whole", by_row).alias("shard"))
    ranked = cut(ranked)
    first = F.broadcast(ranked.groupBy("shard").agg(F.min("n").alias("first")))  # a row for each shard
    return ranked.join(first, "shard").select("r.*", "shard", (F.col("n") - F.col("first")).cast("long").alias("slot"), "bytes", "cell")


def op10(spark, sf_dir: str) -> DataFrame:
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t).alias("h"))
    out = shard(docs, ["lang", "source", "size", "doc_id"], F.col("size"), [F.col("h"), F.col("text_crc32"), F.col("size")], F.col("doc_id"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("cell").alias("curve_cell"))
