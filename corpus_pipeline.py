"""A corpus pipeline over ``documents``: toxicity, near duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's
docs. All but the last return the columns of docs. run() can't be said in SQL (a trained network, a trained
tokenizer's ids), so ORACLE_SQL is None; tests/llm hold run() against a plain version of all stages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm.common import Cuts, free, table
from rasterloom.llm.credentials import masked, scan
from rasterloom.llm.jaccard import link_documents
from rasterloom.llm.mixing import mix, words
from rasterloom.llm.packing import pack, pieces_of
from rasterloom.llm.toxicity import fit_rows, score_rows

ORACLE_SQL = None


def _held(docs: DataFrame) -> DataFrame:
    """(r): whole rows as structs, so that no column of docs can clash with what a stage adds."""
    return docs.select(F.struct(*docs.columns).alias("r"))


def _drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose score is under 0.5. The model learns from labelled rows of docs."""
    model = fit_rows(docs, table(spark, sf_dir, "labels"))
    # The text passes once, in its own column: rows that wait for their score hold no copy of it.
    score = free("score", docs.columns)
    return score_rows(docs, model, score=score).where(F.col(score) < 0.5).drop(score)


def _drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each component of linked documents: that of its smallest id, and of its texts' least hash.

    Id and text tell rows apart, so texts that share an id are decided each for itself; repeated rows come
    down to one. Rows without an id come after all others. Rows without words link with nothing and stay.
    """

    def key(id_: str, text: str) -> Column:
        number = F.coalesce(F.col(id_).cast("long").cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
        h = F.xxhash64(text).bitwiseAND(F.lit((1 << 62) - 1)).cast("decimal(19,0)")
        return (number * F.lit(1 << 62).cast("decimal(19,0)") + h).cast("decimal(38,0)")

    found = link_documents(docs.select(key("doc_id", "text").alias("doc_id"), "text"))
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    out = _held(docs).withColumn("id", key("r.doc_id", "r.text")).join(keep, "id")
    blank = F.trim(F.regexp_replace(F.coalesce("r.text", F.lit("")), "[\\x20\\x09-\\x0D]+", " ")) == ""
    full, empty = out.where(~blank), out.where(blank)
    return full.dropDuplicates(["id"]).select("r.*").unionByName(empty.select("r.*"))


def _mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces what the scan reports in each text by [SECRET]; documents without findings stay as they are."""
    found = scan(_held(docs).withColumn("plain", F.col("r.text")), "plain")
    # A projection of its own: beside a new column "text", the length would be taken of a text masked twice.
    found = found.withColumn("masked", masked(F.col("plain"), F.col("secret_spans")))
    hit = F.size("secret_spans") > 0
    new = {"text": F.col("masked"), "n_chars": F.char_length("masked")}
    value = lambda c: F.when(hit, new[c].cast(docs.schema[c].dataType)).otherwise(F.col("r")[c]) if c in new else F.col("r")[c]
    return found.select(*(value(c).alias(c) for c in docs.columns))


def _mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents of small sources and thins out large ones, as their mixed weights ask."""
    n = docs.select("doc_id", "source", F.xxhash64("text").alias("h"), words(F.col("text")).alias("n"))
    times = mix(n, F.col("n")).groupBy("doc_id", "source", "h").agg(F.countDistinct("mix_pass").cast("int").alias("passes"))
    times = Cuts(spark)(times)
    same = F.col("r.doc_id").eqNullSafe(times.doc_id) & F.col("r.source").eqNullSafe(times.source) & F.xxhash64("r.text").eqNullSafe(times.h)
    out = _held(docs).join(times, same).select("r", F.explode(F.sequence(F.lit(1), F.col("passes"))))
    return out.select("r.*")


def _pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 4096 tokens."""
    import public_tokenizers

    return pack(pieces_of(docs, public_tokenizers.path("word_bpe_49k.json")), 4096)


STAGES = [
    ("toxicity", _drop_toxic),
    ("jaccard_join", _drop_near_copies),
    ("secrets", _mask_secrets),
    ("mixing", _mix_sources),
    ("packing", _pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, cut = table(spark, sf_dir, "documents"), Cuts(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
