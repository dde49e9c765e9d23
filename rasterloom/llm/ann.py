"""Approximate nearest neighbours by inner product over balanced posting lists.

Inner product is turned into Euclidean nearness by one more dimension: with M the largest norm, a row
gets sqrt(M^2 - |x|^2) and a query 0, so that the nearest rows are those of largest product.

* **Fit**, on the driver, over a sample of at most ``sample`` distinct vectors (lowest hashes): halving
  at the median along the main direction until a cell has ``per_list`` rows of the table, so all cells
  hold as many; their means are the centroids. The centroids get a neighbour graph.
* **Index**, on the executors: every row finds its centroids by a best-first search of the graph, and
  goes to the nearest and, at a boundary, to others whose distance is within ``replicate`` of it
  (``copies`` at most). No row is left out.
* **Search**: a query finds centroids by the same search, which widens until it has passed the last list
  that counts; lists whose centroid is farther than ``probe`` times the nearest are pruned, once those before
  them hold k rows of other ids (each row counts in its nearest list only, as replicas are no further rows).
  Lists are read in shards of bounded size, each giving its best; shares of a list with many rows lie in
  several shards. A query goes to the shards of its lists alone; a shard that many queries ask is read by as
  many tasks as hold ``block`` of them each, so copies of a shard grow with its own queries, not the table's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import Cuts, lowest, table, tidy


def halve(x: np.ndarray, cells: int) -> np.ndarray:
    """Means of ``cells`` (a power of two) equal parts of x, by medians along main directions."""
    if cells < 2 or len(x) < 4:
        return x.mean(0, keepdims=True)
    centred, d = x - x.mean(0), np.ones(x.shape[1])
    for _ in range(8):
        d = centred.T @ (centred @ d)
        d /= np.linalg.norm(d) or 1.0
    order = np.argsort(centred @ d, kind="stable")
    half = len(x) // 2
    return np.vstack([halve(x[order[:half]], cells // 2), halve(x[order[half:]], cells // 2)])


class CentroidGraph:
    """Centroids with ``degree`` neighbours each: the nearest, and a ring so that all are reachable."""

    def __init__(self, centroids: np.ndarray, degree: int = 16) -> None:
        self.c = centroids
        k = len(centroids)
        near = []
        for at in range(0, k, 512):
            d = ((centroids[at : at + 512, None] - centroids[None]) ** 2).sum(2) if k <= 512 else (centroids**2).sum(1) - 2 * centroids[at : at + 512] @ centroids.T
            near.append(np.argsort(d, axis=1, kind="stable")[:, 1 : degree - 1])
        ring = (np.arange(k)[:, None] + np.array([1, k - 1])) % k
        self.links = np.hstack([np.vstack(near), ring])

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x up to ``width`` centroids, nearest first, and their distances; -1 where none."""
        n, k = len(x), len(self.c)
        width = min(width, k)
        entry = np.unique(np.linspace(0, k - 1, min(k, 8)).astype(int))
        seen = np.zeros((n, k), bool)
        open_ = np.zeros((n, k), bool)
        dist = np.full((n, k), np.inf, np.float32)
        rows = np.arange(n)
        norm = (self.c**2).sum(1)
        own = (x**2).sum(1)

        def look(r: np.ndarray, nodes: np.ndarray) -> None:
            d = own[r, None] + norm[nodes] - 2 * np.einsum("id,ijd->ij", x[r], self.c[nodes])
            new = ~seen[r[:, None], nodes]
            dist[r[:, None], nodes] = np.where(new, np.maximum(d, 0), dist[r[:, None], nodes])
            open_[r[:, None], nodes] |= new
            seen[r[:, None], nodes] = True

        look(rows, np.broadcast_to(entry, (n, len(entry))))
        live = rows
        while len(live):
            waiting = np.where(open_[live], dist[live], np.inf)
            node = waiting.argmin(1)
            best = waiting[np.arange(len(live)), node]
            bound = np.partition(dist[live], width - 1, axis=1)[:, width - 1]
            go = np.isfinite(best) & (best <= bound)
            live, node = live[go], node[go]
            open_[live, node] = False
            if len(live):
                look(live, self.links[node])
        order = np.argsort(dist, axis=1, kind="stable")[:, :width]
        d = np.sqrt(np.take_along_axis(dist, order, 1))
        return np.where(np.isfinite(d), order, -1), d


def usable(v: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(ok & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(s: pd.Series) -> np.ndarray:
    return np.array(s.tolist(), np.float64)


def _assign(graph: CentroidGraph, top: float, replicate: float, copies: int):
    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 512):
                g = f.iloc[at : at + 512].reset_index(drop=True)
                x = _matrix(g["v"])
                x = np.hstack([x, np.sqrt(np.maximum(top - (x**2).sum(1, keepdims=True), 0))]).astype(np.float32)
                c, d = graph.search(x, 4 * copies)
                keep = (c >= 0) & (d <= d[:, :1] * replicate + 1e-6) & (np.arange(c.shape[1]) < copies)
                r, k = np.nonzero(keep)
                yield pd.DataFrame({"list": c[r, k], "vec_id": g["vec_id"].to_numpy()[r], "v": g["v"].to_numpy()[r], "row": g["row"].to_numpy()[r], "copies": g["copies"].to_numpy()[r], "first": k == 0})

    return rows


def _probe(graph: CentroidGraph, probe: float, width: int, held: np.ndarray, k: int):
    """held: rows whose nearest list it is, by list; ``same`` of a query's rows have its own id. width: of the first search."""

    def wanted(x: np.ndarray, same: np.ndarray, width: int) -> list[list[int]]:
        c, d = graph.search(x, width)
        own = np.where(c >= 0, held[c], 0)
        before = np.cumsum(own, 1) - own
        keep = (c >= 0) & ((d <= d[:, :1] * probe + 1e-6) | (before < k + same[:, None]))
        out = [list(c[i][keep[i]]) for i in range(len(x))]
        # Where the last list found still counts, others behind it may.
        more = np.flatnonzero(keep[:, -1]) if c.shape[1] < len(graph.c) else ()
        if len(more):
            for i, lists in zip(more, wanted(x[more], same[more], 4 * width), strict=True):
                out[i] = lists
        return out

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for at in range(0, len(f), 512):
                g = f.iloc[at : at + 512].reset_index(drop=True)
                x = _matrix(g["v"])
                lists = wanted(np.hstack([x, np.zeros((len(x), 1))]).astype(np.float32), g["same"].to_numpy(), width)
                yield pd.DataFrame({"vec_id": g["vec_id"], "v": g["v"], "lists": lists})

    return rows


def nearest(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, copies: np.ndarray, row: np.ndarray, may: np.ndarray, k: int) -> pd.DataFrame:
    """The k rows of x with the largest products for each q; may: which of them it looks at; copies: equal rows that a row stands for; row: what tells rows apart."""
    out = []
    for at in range(0, len(q), 256):
        s = q[at : at + 256] @ x.T
        s[(q_id[at : at + 256, None] == x_id[None]) | ~may[at : at + 256]] = -np.inf
        kth = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
        r, c = np.nonzero((s >= (kth - 1e-9)[:, None]) & np.isfinite(s))
        exact = np.einsum("ij,ij->i", q[at + r], x[c])
        f = pd.DataFrame({"q": at + r, "vec_id": x_id[c], "score": exact, "copies": copies[c], "row": row[c]})
        out.append(f.sort_values(["q", "score", "vec_id"], ascending=[True, False, True], kind="stable").groupby("q", sort=False).head(k))
    f = pd.concat(out) if out else pd.DataFrame({"q": [], "vec_id": [], "score": [], "copies": [], "row": []})
    return pd.DataFrame({"query_id": q_id[f["q"].to_numpy(int)], "vec_id": f["vec_id"].to_numpy(), "score": f["score"].to_numpy(float), "copies": f["copies"].to_numpy(np.int64), "row": f["row"].to_numpy(np.int64)})


def once(row: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a shard without their replicas: where each first stands, and its lists (-1 where it has fewer than others).

    row: what tells rows apart. A row that several lists hold has to count as one, or its replicas take the
    places of other rows.
    """
    _, at = np.unique(row, return_inverse=True)
    order = np.argsort(at, kind="stable")
    some, start = np.unique(at[order], return_index=True)
    nth = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
    held = np.full((len(some), int(nth.max()) + 1), -1, np.int64)
    held[at[order], nth] = lists[order]
    return order[start], held


def _shard(k: int):
    def best(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "copies": [], "row": []}).astype({"query_id": "int64", "vec_id": "int64", "score": float, "copies": "int64", "row": "int64"})
        here, lists = np.unique(own["list"].to_numpy(), return_inverse=True)
        rows, held = once(own["row"].to_numpy(), lists)
        x, x_id, copies = _matrix(own["v"].iloc[rows]), own["vec_id"].to_numpy()[rows], own["copies"].to_numpy()[rows]
        row = own["row"].to_numpy()[rows]
        out = []
        for at in range(0, len(asked), 256):
            part = asked.iloc[at : at + 256]
            # The last column, which -1 stands for, is no list.
            allowed = np.zeros((len(part), len(here) + 1), bool)
            for i, want in enumerate(part["lists"]):
                allowed[i, :-1] = np.isin(here, want)
            may = allowed[:, held[:, 0]]
            for c in range(1, held.shape[1]):
                may |= allowed[:, held[:, c]]
            out.append(nearest(_matrix(part["v"]), part["vec_id"].to_numpy(), x, x_id, copies, row, may, k))
        return pd.concat(out)

    return best


def nearest_rows(vectors: DataFrame, queries: Column, k: int = 20, id_: str = "vec_id", vector: str = "embedding", sample: int = 20000, per_list: int = 256, max_lists: int = 2048, replicate: float = 1.02, copies: int = 4, probe: float = 1.12, shard_rows: int = 50000, block: int = 20000) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k nearest found for each row that ``queries`` marks.

    Rows with a null id and vectors that ``usable`` rejects take no part. Of vectors of different lengths the
    shorter ones end in zeros. Rows of a query's id are its own; other rows all count, equal ones as many
    times as they are there, and rows of one id with different vectors are rows of their own. Equal rows that
    ask do so once. Ties go to the smaller id. A table without usable rows gives none.
    """
    spark = vectors.sparkSession
    cut = Cuts(spark)
    v = vectors[vector].cast("array<double>")
    rows = vectors.select(vectors[id_].cast("long").alias("vec_id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v"))).groupBy("vec_id", "v").agg(F.count("*").alias("copies"), F.max("asks").alias("asks"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    rows = cut(rows.withColumn("norm", norm).withColumn("row", F.xxhash64("vec_id", "v")))
    dim, n, top = rows.agg(F.max(F.size("v")), F.count("*"), F.max("norm")).first()
    shape = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], shape)
    rows = rows.withColumn("v", F.when(F.size("v") < dim, F.concat("v", F.array_repeat(F.lit(0.0), F.lit(dim) - F.size("v")))).otherwise(F.col("v")))
    drawn = lowest(rows.select(F.xxhash64("v").alias("h"), "v"), sample, n).distinct().orderBy("h", "v").limit(sample).toPandas()
    x = _matrix(drawn["v"])
    x = np.hstack([x, np.sqrt(np.maximum(top - (x**2).sum(1, keepdims=True), 0))])
    lists = max(1, min(max_lists, n // per_list, len(x) // 4))
    graph = CentroidGraph(halve(x, 1 << (lists.bit_length() - 1)).astype(np.float32))
    lists = len(graph.c)

    index = cut(rows.select("vec_id", "v", "row", "copies").mapInPandas(tidy("ann", _assign(graph, top, replicate, copies)), "list int, vec_id long, v array<double>, row long, copies long, first boolean"))
    n_index = index.count()
    shards = max(1, -(-n_index // shard_rows))
    # A list lies in the shards that its share of the rows asks for.
    sizes = index.groupBy("list").agg(F.count("*").alias("c"), F.sum(F.col("first").cast("long")).alias("held")).select("list", F.greatest(F.lit(1), F.ceil(F.col("c") / shard_rows)).cast("int").alias("shares"), "held")
    sizes = cut(sizes)
    held = np.zeros(lists, np.int64)
    for s in sizes.collect():  # max_lists rows at most
        held[s.list] = s.held
    small = F.broadcast(sizes.drop("held"))
    placed = index.join(small, "list").withColumn("shard", F.pmod(F.col("list") + F.pmod(F.xxhash64("vec_id"), F.col("shares")), F.lit(shards)).cast("long"))
    same = rows.groupBy("vec_id").agg(F.count("*").alias("same"), F.max("asks").alias("any")).where("any").select("vec_id", "same")
    asked = rows.where("asks").select("vec_id", "v").join(same, "vec_id").mapInPandas(tidy("ann", _probe(graph, probe, 4 * copies, held, k)), "vec_id long, v array<double>, lists array<int>")
    asked = cut(asked)
    to = asked.withColumn("list", F.explode("lists")).join(small, "list")
    to = to.select("vec_id", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "list")
    to = to.select("vec_id", F.pmod(F.col("list") + F.col("share"), F.lit(shards)).cast("long").alias("shard")).distinct()
    to = cut(to)
    blocks = to.groupBy("shard").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks"))
    to = to.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).join(asked.select("vec_id", "v", "lists"), "vec_id")
    placed = placed.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select("list", "vec_id", "v", "row", "copies", "shard", "block")
    to = to.select("vec_id", "v", "lists", "shard", "block")
    found = placed.groupBy("shard", "block").cogroup(to.groupBy("shard", "block")).applyInPandas(lambda a, b: _shard(k)(a, b), "query_id long, vec_id long, score double, copies long, row long")
    # The k best of each query from its few shards; groups are as large as shards times k.
    best = found.distinct().groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("vec_id"), F.col("copies")))), 1, k).alias("b"))
    best = best.select("query_id", F.slice(F.flatten(F.transform("b", lambda x: F.array_repeat(x, F.least(x["copies"], F.lit(k)).cast("int")))), 1, k).alias("b"))
    best = best.select("query_id", F.posexplode("b").alias("rank", "b"))
    return best.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def op2(spark, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return nearest_rows(e, F.col("vec_id") % 20 == 0)
