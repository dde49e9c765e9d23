"""Multipart credential linking, by SQL functions only.

Strong parts are reported by themselves: ``assign`` (a secret's name and its value), ``access`` (access
identifiers) and ``hex`` (long hexadecimal runs). Weak parts mean little alone: ``key`` (a mixed run of 32
or more base-64 characters), ``user`` (an account's name and its value) and ``endpoint`` (a URL). A weak part
is reported only if it is joined, by intervals within a scope of characters, to the parts that complete it:
a key to an identifier, a user to a secret, an endpoint to both. Identifiers are access and user parts;
secrets are assign, hex and key parts.

Matches are marked by one regexp_replace for each kind, with two control characters that no pattern takes
(texts that hold them get others of the same length first, for the matching only), and running sums of the
lengths of the pieces between the marks give the places. The interval join is a sweep: parts of both sides
are sorted by place, and a running maximum tells each part the nearest end before it and the nearest start
behind it. Running sums and maxima go over chunks of chunks, so a text of n parts takes n log n steps; a
text is one row, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import table

ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: Kind: pattern, the group that is measured, its least length.
STRONG = {"assign": (ASSIGN, 2, 8), "access": ("(AKIA[A-Z0-9]+)", 1, 16), "hex": ("([0-9a-f]+)", 1, 32)}
WEAK = {
    "key": ("([A-Za-z0-9+/]+)", 1, 32),
    "user": ("((?i:user(?:name)?|account|client_id|key_id|login))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9_.@-]+)", 2, 4),
    "endpoint": ("(https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\\x00-\\x20\"'<>]*)?)", 1, 12),
}
KINDS = [*STRONG, *WEAK]
#: A run has to be long before it is worth marking; longer runs are the same matches.
_QUICK = {"hex": "([0-9a-f]{32,})", "key": "([A-Za-z0-9+/]{32,}+)"}
_SPAN = "array<struct<kind:int,start:bigint,stop:bigint>>"
_FAR = 1 << 40
#: Characters of a block in which a masked text is cut.
_BLOCK = 4096


def _let(x: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of x, which is evaluated once, also where lambdas in ``then`` use it."""
    return F.get(F.transform(F.array(x), then), 0)


def _running(x: Column, first: int, fold: Callable[[Column, Column], Column], levels: int = 2, chunk: int = 64) -> Column:
    """For each element of an array of longs the fold of all before it, from ``first``, which is neutral.

    Chunks are folded by themselves and their folds are run over in the same way, so that no accumulator
    grows beyond a chunk (at the last level: beyond the number of elements over chunk^levels).
    """
    zero = F.lit(first).cast("long")
    if not levels:
        start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(x, start, lambda acc, v: F.struct(fold(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def chunked(a: Column) -> Column:
        parts = F.transform(F.when(F.size(a) > 0, F.sequence(F.lit(1), F.size(a), F.lit(chunk))).otherwise(F.array().cast("array<int>")), lambda i: F.slice(a, i, F.lit(chunk)))
        return _let(parts, lambda p: F.flatten(F.zip_with(F.transform(p, lambda c: _running(c, first, fold, 0)), _running(F.transform(p, lambda c: F.aggregate(c, zero, fold)), first, fold, levels - 1, chunk), lambda c, before: F.transform(c, lambda v: fold(v, before)))))

    return _let(x, chunked)


def _found(text: Column, kind: str) -> Column:
    """Spans of one kind, by place: leftmost non-overlapping matches, less those that are too short."""
    pattern, group, least = (STRONG | WEAK)[kind]
    marked = F.regexp_replace(text, F.lit(_QUICK.get(kind, pattern)), F.lit("\x01$0\x02"))

    def sized(x: Column) -> Column:
        value = x if group == 1 else F.regexp_extract(x, pattern, group)
        mixed = F.lit(True) if kind != "key" else x.rlike("[0-9]") & x.rlike("[A-Z]") & x.rlike("[a-z]")
        return (F.char_length(value) >= least) & mixed

    def places(pieces: Column) -> Column:
        n = F.transform(pieces, lambda x: F.char_length(x).cast("long"))
        return F.zip_with(pieces, _running(n, 0, lambda a, b: a + b), lambda x, at: F.struct(x.alias("x"), at.alias("at")))

    hits = F.filter(_let(F.split(marked, "[\x01\x02]"), places), lambda p, i: (i % 2 == 1) & sized(p["x"]))
    spans = F.transform(hits, lambda p: F.struct(F.lit(KINDS.index(kind)).alias("kind"), p["at"].alias("start"), (p["at"] + F.char_length(p["x"])).alias("stop"))).cast(_SPAN)
    return F.when(F.contains(marked, F.lit("\x01")), spans).otherwise(F.array().cast(_SPAN))


def _swept(spans: Column, others: Column, asks: Callable[[Column], Column], tells: Callable[[Column], tuple[Column, Column]], ties: bool) -> Column:
    """For each of the spans, by its place ``asks``, the largest value told at a place before it (``tells``:
    place and value of others; with ``ties`` also at that place), or one that is far below all."""
    own = F.transform(spans, lambda s: F.struct(asks(s).alias("at"), F.lit(1 if ties else 0).alias("late"), F.lit(-_FAR).cast("long").alias("value"), F.lit(True).alias("asks")))
    told = F.transform(others, lambda o: F.struct(tells(o)[0].alias("at"), F.lit(0 if ties else 1).alias("late"), tells(o)[1].cast("long").alias("value"), F.lit(False).alias("asks")))

    def sweep(events: Column) -> Column:
        best = _running(F.transform(events, lambda e: e["value"]), -_FAR, lambda a, b: F.greatest(a, b))
        return F.transform(F.filter(F.zip_with(events, best, lambda e, v: F.struct(e["asks"].alias("asks"), v.alias("v"))), lambda e: e["asks"]), lambda e: e["v"])

    return _let(F.array_sort(F.concat(own, told)), sweep)


def _beside(spans: Column, others: Column, scope: int) -> Column:
    """Those of the spans, which are in order and do not overlap each other, that have one of the others
    within ``scope`` characters before or behind them, not over them."""
    before = _swept(spans, others, lambda s: s["start"], lambda o: (o["stop"], o["stop"]), True)
    # Behind: the same from the text's end, where the order of the spans is the other way round.
    behind = F.reverse(_swept(spans, others, lambda s: -s["stop"], lambda o: (-o["start"], -o["start"]), True))
    near = F.zip_with(F.zip_with(spans, before, lambda s, b: F.struct(s.alias("s"), (s["start"] - b <= scope).alias("b"))), behind, lambda x, a: F.struct(x["s"].alias("s"), (x["b"] | (-a - x["s"]["stop"] <= scope)).alias("near")))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), F.transform(F.filter(near, lambda x: x["near"]), lambda x: x["s"])).otherwise(F.array().cast(_SPAN))


def _apart(spans: Column, others: Column) -> Column:
    """Those of the spans, which are in order and do not overlap each other, that overlap none of the others."""
    reach = _swept(spans, others, lambda s: s["stop"], lambda o: (o["start"], o["stop"]), False)
    over = F.zip_with(spans, reach, lambda s, r: F.struct(s.alias("s"), (r > s["start"]).alias("over")))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), F.transform(F.filter(over, lambda x: ~x["over"]), lambda x: x["s"])).otherwise(spans)


def _ordered(spans: Column) -> Column:
    by = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    return F.array_sort(by)


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(docs: DataFrame, text: str = "text", scope: int = 300) -> DataFrame:
    """All columns of docs, with secret_base and secret_spans: arrays of (start, kind, stop) in code points
    (stop exclusive; kind an index into KINDS) by start and kind, the strong parts, and these with linked ones.

    Null texts count as empty. Columns of docs by these names are replaced. Each weak part looks for its
    complements among the parts of its own text within ``scope`` characters.
    """
    # One narrow row in, one out: columns of docs travel in a struct, so their names can't clash.
    x = docs.drop("secret_base", "secret_spans")
    names = x.columns
    x = x.select(F.struct(*names).alias("r"), F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "\x01\x02", "\x03\x03").alias("t"))
    x = x.select("r", *(_found(F.col("t"), k).alias(k) for k in KINDS))
    x = x.withColumn("base", F.concat(*STRONG))

    x = x.withColumn("key", _apart(F.col("key"), F.col("base")))
    x = x.withColumn("identifiers", F.concat("access", "user")).withColumn("secrets", F.concat("assign", "hex", "key"))
    key = _beside(F.col("key"), F.col("identifiers"), scope)
    user = _beside(F.col("user"), F.col("secrets"), scope)
    endpoint = _let(_beside(F.col("endpoint"), F.col("identifiers"), scope), lambda e: _beside(e, F.col("secrets"), scope))
    return x.select("r.*", _ordered(F.col("base")).alias("secret_base"), _ordered(F.concat("base", key, user, endpoint)).alias("secret_spans"))


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """The text with each run of overlapping or touching spans (by start) replaced by ``mask``."""

    def replaced(t: Column, blocks: Column) -> Column:
        before = _running(F.transform(spans, lambda s: s["stop"]), 0, lambda a, b: F.greatest(a, b))
        gaps = F.zip_with(spans, before, lambda s, at: F.struct(at.alias("a"), s["start"].alias("b")))
        gaps = F.filter(gaps, lambda g, i: (i == 0) | (g["b"] > g["a"]))
        last = F.struct(F.array_max(F.transform(spans, lambda s: s["stop"])).alias("a"), F.char_length(t).cast("long").alias("b"))

        def part(g: Column) -> Column:
            """Of a gap: what each block under it holds of it."""
            over = F.when(g["b"] > g["a"], F.sequence(F.floor(g["a"] / _BLOCK), F.floor((g["b"] - 1) / _BLOCK))).otherwise(F.array().cast("array<bigint>"))
            at = lambda j: F.greatest(g["a"] - j * _BLOCK, F.lit(0))
            return F.array_join(F.transform(over, lambda j: F.substring(F.get(blocks, j.cast("int")), (at(j) + 1).cast("int"), (F.least(g["b"] - j * _BLOCK, F.lit(_BLOCK)) - at(j)).cast("int"))), "")

        return F.array_join(F.transform(F.concat(gaps, F.array(last)), part), mask)

    # A place in a long text is found from the start of its block, not of the text.
    out = _let(text, lambda t: _let(F.regexp_extract_all(t, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0)), lambda blocks: replaced(t, blocks)))
    return F.when(F.size(spans) > 0, out).otherwise(text)


def op8(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("secret_base", lambda s: s["kind"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, STRONG), F.sha2(_joined(F.col("secret_base")), 256).alias("base_sha256"), _joined(F.col("secret_spans")).alias("spans"))
