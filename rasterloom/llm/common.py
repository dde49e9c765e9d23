"""What the training-data operators share: cut points, disk release and tables."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the session does not name one (tests, local mode), a temporary folder of this process
    is set up and removed when the process ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="cuts-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return "file://" + _own["dir"]


class Cuts:
    """Tables written into the shared folder, to end a lineage there."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        self.n = 0

    def cut(self, df: DataFrame) -> tuple[DataFrame, str]:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        self.release()
        return self.spark.read.schema(df.schema).parquet(path), path

    def __call__(self, df: DataFrame) -> DataFrame:
        return self.cut(df)[0]

    def drop(self, path: str) -> None:
        """Deletes a table that no later step reads."""
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def release(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of the steps that are over."""
        gc.collect()
        self.spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def lowest(rows: DataFrame, most: int, total: int | None = None) -> DataFrame:
    """Rows whose hash (column ``h``, 64 bits) is under a bound that leaves at least ``most`` distinct hashes.

    All rows where they have fewer. A caller that orders by h and takes ``most`` gets the same rows as from
    the whole table, but sorts and moves a number of them that does not grow with the table.
    """
    total = rows.count() if total is None else total
    share = 2 * most / max(1, total)
    while share < 1:
        some = rows.where(F.col("h") <= F.lit(int(share * 2.0**64) - 2**63))
        if some.select("h").distinct().limit(most).count() >= most:
            return some
        share *= 4
    return rows


_kept: dict[tuple, object] = {}


def kept(owner: str, key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks of one operator: another operator's goes first."""
    if (owner, key) not in _kept:
        _kept.clear()
        _kept[owner, key] = make()
    return _kept[owner, key]


def give_back() -> None:
    """Returns a worker's unused memory to the system; idle workers live on beside other operators' tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def clear_others(owner: str) -> None:
    if any(o != owner for o, _ in _kept):
        _kept.clear()


def tidy(owner: str, run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` over a task's batches, without what other operators have kept, and giving memory back at the end."""

    def tidied(batches: Iterator) -> Iterator:
        clear_others(owner)
        yield from run(batches)
        give_back()

    return tidied


def lots(sizes: list[int], most: int) -> Iterator[slice]:
    """Slices of rows whose sizes sum to at most ``most``, in order; a row beyond that is a slice of its own."""
    a, size = 0, 0
    for b, n in enumerate(sizes):
        if b > a and size + n > most:
            yield slice(a, b)
            a, size = b, 0
        size += n
    if a < len(sizes):
        yield slice(a, len(sizes))


def free(name: str, taken: list[str]) -> str:
    """``name``, with as many underscores behind it as keep it apart from the columns ``taken``, case aside."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def text_key(text: Column) -> list[Column]:
    """Two longs that stand for a whole text: 64 bits of xxhash, and crc32 with the length."""
    return [
        F.xxhash64(text).alias("k1"),
        (F.octet_length(text).cast("long") * F.lit(1 << 32) + F.crc32(text.cast("binary"))).alias("k2"),
    ]
