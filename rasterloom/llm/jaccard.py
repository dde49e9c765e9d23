"""Exact Jaccard join of word-shingle sets over pivots and their regions.

Jaccard distance is a metric, but nearly all sets lie at distance 1 from any one pivot, so pivots are
taken where sets can be near at all:

* **Lists.** Sets of similarity s or more share a shingle among their first n - ceil(s n) + 1 in any
  one order of shingles (frequent ones last). Sets with a common first shingle form a list.
* **Pivots and regions.** In each list one set (that of the least hash) is a pivot; a set belongs to the Voronoi region
  of the pivot that most of its lists name, if those are ``near`` of its first shingles or more. Sets
  left over choose again among themselves, and at last stand for themselves.
* **Windows.** A set is replicated into a larger region (by members, then name) than its own if it shares
  a list with a member and the number of lists shared can reach the similarity for sizes found there. Any
  partner of a member in a smaller region does, so each pair of sets meets in one region.
* **Joins.** A region is joined exactly inside a task, recursively: pivots far from each other cut it into Voronoi
  regions by distance, the triangle inequality says which sets of other regions a region needs as well
  (d(y,p) <= d(y,q) + 2(1 - s) for its pivot p and all q), and so on down to ``leaf`` sets, or where a cut
  leaves over half of the pairs. There distances to one pivot leave for each member a window of |d(x,p) - d(y,p)| <= 1 - s,
  and an inverted index counts the overlaps in it. A region over ``most`` sets is dealt into blocks, joined
  with each other, so that no region has to fit in a task.

Equal sets are one from the start. A region tells only a spanning set of links, and each member's number
of links; components follow by pointer jumping. The frequent shingles (seen often in one batch; the
million most frequent are sent to the executors) only make lists short: any order is right.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterloom.llm.common import Cuts, give_back, lots, parts, table, text_key, tidy
from rasterloom.llm.components import components
from rasterloom.llm.shingles import sets


def _key(s: np.ndarray) -> int:
    """64 bits that stand for a set."""
    x = (s ^ np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return int((x * (x | np.uint64(1))).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0


#: Characters of text whose sets a worker holds at a time; a longer text is a lot of its own.
_LOT = 1 << 23


def _lots(frame: pd.DataFrame, k: int) -> Iterator[tuple[pd.DataFrame, list[np.ndarray]]]:
    """A batch's rows in lots bounded by their texts' length, and their texts' sets."""
    for at in lots(frame["t"].str.len().tolist(), _LOT):
        g = frame.iloc[at].reset_index(drop=True)
        yield g, sets(list(g["t"]), k)


def _first(frames: Iterator[pd.DataFrame], k: int, often: int) -> Iterator[pd.DataFrame]:
    """A row for each text with its key and size; and rows with shingles seen ``often`` in a batch."""
    for f in frames:
        seen = [np.zeros(0, np.uint64)]
        for g, s in _lots(f, k):
            out = g[["id", "k1", "k2"]].copy()
            out["k"], out["n"] = np.array([_key(x) for x in s], np.int64), np.array([len(x) for x in s], np.int64)
            out["h"], out["c"] = 0, 0
            yield out
            seen.append(np.concatenate(s))
        all_ = np.concatenate(seen)
        del seen
        all_.sort()
        edge = np.flatnonzero(np.concatenate([[True], all_[1:] != all_[:-1]])) if len(all_) else np.zeros(0, int)
        c = np.diff(np.append(edge, len(all_)))
        h, c = all_[edge[c >= often]], c[c >= often]
        yield pd.DataFrame({"id": pd.Series([None] * len(h), dtype=object), "k1": 0, "k2": 0, "k": 0, "n": -1, "h": h.view(np.int64), "c": c})


def leading(s: np.ndarray, frequent: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first n - ceil(num n / den) + 1 shingles in the common order: rare ones by hash, then frequent ones."""
    if not len(s):
        return s
    p = len(s) - -(-num * len(s) // den) + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        s = s[np.argsort(frequent[at] == s, kind="stable")]
    return s[:p]


def needed(nx: int, ny: int, num: int, den: int) -> int:
    """The least overlap with den * overlap >= num * union."""
    return -(-num * (nx + ny) // (num + den))


class Links:
    """Union-find over places."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def link(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def overlaps(s: list[np.ndarray]) -> Callable[[int], np.ndarray]:
    """A function that counts, by an inverted index, the shingles that each set shares with the set at a place."""
    m, n = len(s), np.array([len(x) for x in s])
    flat, doc = np.concatenate(s), np.repeat(np.arange(m), n)
    order = np.argsort(flat, kind="stable")
    flat, doc = flat[order], doc[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    number = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(flat))
    back = np.argsort(doc, kind="stable")
    mine = np.split(number[back], np.cumsum(n)[:-1])

    def overlap(i: int) -> np.ndarray:
        b, e = begin[mine[i]], stop[mine[i]]
        some = e - b > 1
        b, e = b[some], e[some]
        size = e - b
        if not len(b):
            return np.bincount([i], [n[i]], m).astype(np.int64)
        at = np.repeat(b - np.cumsum(size) + size, size) + np.arange(size.sum())
        got = np.bincount(doc[at], minlength=m)
        got[i] = n[i]
        return got

    return overlap


def voronoi(n: np.ndarray, overlap: Callable[[int], np.ndarray], member: np.ndarray, other: np.ndarray, num: int, den: int, pivots: int = 8) -> list[tuple[np.ndarray, np.ndarray]]:
    """(members, others) of the regions of pivots that lie far from each other: members by the nearest pivot, others
    wherever a partner of a member can lie.

    With r = 1 - s, a partner y of a member x of p's region has d(y,p) <= d(x,p) + r <= d(x,q) + r <= d(y,q) + 2r for
    every pivot q, d(y,p) within r of the distances that members have, and a size that s allows beside theirs.
    """
    r, d = 1 - num / den + 1e-9, []
    i = int(np.argmin(n))
    while len(d) < pivots:
        o = overlap(i)
        d.append(1 - o / (n + n[i] - o))
        least = np.min(d, axis=0)
        i = int(np.argmax(least))
        if least[i] <= r:
            break
    d = np.array(d)
    nearest, least, out = d.argmin(0), d.min(0), []
    for p in range(len(d)):
        own = np.flatnonzero(member & (nearest == p))
        if len(own):
            low, high = d[p, own].min() - r, d[p, own].max() + r
            near = other & (d[p] <= least + 2 * r) & (d[p] >= low) & (d[p] <= high)
            near &= (n * den >= num * n[own].min()) & (n * num <= den * n[own].max())
            out.append((own, np.flatnonzero(near)))
    return out


def join_region(s: list[np.ndarray], member: np.ndarray, copies: np.ndarray, num: int, den: int, other: np.ndarray | None = None, guest: np.ndarray | None = None, leaf: int = 256) -> tuple[Links, np.ndarray]:
    """Links among the sets, and the rows that each one links to (copies count each), as far as seen here.

    member: sets whose partners are wanted; other: which sets are looked at as partners (all); guest: sets
    of other regions (those that are no members), which have their links told here and nowhere else. A region
    of over ``leaf`` sets is cut into regions of its own, where these hold half as many pairs to look at or
    fewer, and at most twice the sets.
    """
    guest = ~member if guest is None else guest
    other = np.ones(len(s), bool) if other is None else other
    n = np.array([len(x) for x in s])
    links, count = Links(len(s)), np.zeros(len(s), np.int64)
    reach = 1 - num / den + 1e-9
    todo = [np.arange(len(s))], [member], [other]
    while todo[0]:
        at, member, other = (x.pop() for x in todo)
        overlap, size, rows, away = overlaps([s[i] for i in at]), n[at], copies[at], guest[at]
        if len(at) > leaf:
            parts_ = [(np.union1d(own, near), own, near) for own, near in voronoi(size, overlap, member, other, num, den)]
            pairs, held = sum(len(own) * len(near) for _, own, near in parts_), sum(len(x) for x, _, _ in parts_)
            if 2 * pairs <= member.sum() * other.sum() and held <= 2 * len(at) and max(len(x) for x, _, _ in parts_) < len(at):
                for x, own, near in parts_:
                    for stack, value in zip(todo, (at[x], np.isin(x, own), np.isin(x, near)), strict=True):
                        stack.append(value)
                continue
        members = np.flatnonzero(member)
        # Distances to the pivot, the smallest member; only sets within 1 - s of a member's distance are tried.
        pivot = int(members[np.argmin(size[members])])
        o = overlap(pivot)
        d = 1 - o / (size + size[pivot] - o)
        for i in members:
            window = other & (np.abs(d - d[i]) <= reach) & (den * np.minimum(size, size[i]) >= num * np.maximum(size, size[i]))
            window[i] = False
            if window.any():
                o = overlap(i)
                hit = np.flatnonzero(window & (den * o >= num * (size + size[i] - o)))
                count[at[i]] += rows[hit].sum()
                count[at[hit[away[hit]]]] += rows[i]
                for j in hit:
                    links.link(at[i], at[j])
    return links, count


def _regions(k: int, num: int, den: int, leaf: int):
    def join(f: pd.DataFrame) -> pd.DataFrame:
        out = []
        f = f.drop_duplicates(["region", "block", "k", "n"]).reset_index(drop=True)
        for at in np.split(np.arange(len(f)), np.flatnonzero(np.diff(pd.factorize(pd.MultiIndex.from_frame(f[["region", "block"]]))[0])) + 1) if len(f) else []:
            g = f.iloc[at]
            member = g["member"].to_numpy()
            if len(g) < 2 or not member.any():
                continue
            s = sets(list(g["t"]), k)
            links, count = join_region(s, member, g["copies"].to_numpy(), num, den, g["other"].to_numpy(), g["guest"].to_numpy(), leaf)
            keys = g["k"].to_numpy()
            for i in range(len(g)):
                r = links.root(i)
                if r != i or count[i]:
                    out.append((keys[i], keys[r], count[i]))
        give_back()
        return pd.DataFrame(out, columns=["a", "b", "links"]).astype("int64")

    return lambda f: join(f.sort_values(["region", "block"], kind="stable"))


def link_documents(docs: DataFrame, id_: str = "doc_id", text: str = "text", k: int = 5, num: int = 75, den: int = 100, near: float = 0.1, rounds: int = 2, often: int = 3, most: int = 4000, leaf: int = 256) -> DataFrame:
    """Per row of docs: ``id_``, n_shingles, component_id (the smallest id reachable by links) and n_links.

    Texts link when den * intersection >= num * union of their sets of k-word shingles. Words are lower-cased
    by ASCII rules and split at ASCII blanks; a shorter text is one shingle; texts without words (and nulls)
    are empty, with n_shingles 0, no link, and their own id as component_id. Equal sets always link. Rows
    with a null id link like others, and the component's id is null only if all its ids are. Repeated rows
    count as copies in n_links. No other column of docs is looked at.
    """
    spark = docs.sparkSession
    cut = Cuts(spark)
    kind = docs.schema[id_].dataType.simpleString()
    t = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = docs.select(docs[id_].alias("id"), *text_key(t), t.alias("t"))
    seen = cut(rows.mapInPandas(tidy("jaccard", lambda fs: _first(fs, k, often)), f"id {kind}, k1 long, k2 long, k long, n long, h long, c long"))
    ids = seen.where("n >= 0").select("id", "k1", "k2", "k", "n")
    frequent = seen.where("n < 0").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(1 << 20).select("h").toPandas()["h"]
    frequent = spark.sparkContext.broadcast(np.sort(frequent.to_numpy(np.int64).view(np.uint64)))
    # One row stands for all rows of a set: the smallest id, and its text.
    one = ids.where("n > 0").groupBy("k", "n").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "k1", "k2")).alias("r"), F.count("*").alias("copies"))
    one = cut(one.select("k", "n", "copies", F.col("r.id").alias("id"), F.col("r.k1").alias("k1"), F.col("r.k2").alias("k2")))

    def firsts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, s in (x for f in frames for x in _lots(f, k)):
            yield pd.DataFrame({"k": [_key(x) for x in s], "n": [len(x) for x in s], "hs": [leading(x, frequent.value, num, den).view(np.int64) for x in s]})

    listed = rows.select("t").mapInPandas(tidy("jaccard", firsts), "k long, n long, hs array<long>").where("n > 0")
    listed = listed.select("k", "n", F.size("hs").alias("p"), F.explode("hs").alias("h"))
    listed, at_listed = cut.cut(listed)
    lists = cut(listed.groupBy("h").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo != hi").select("h"))
    members = cut(listed.join(lists, "h").distinct())
    cut.drop(at_listed)

    # Regions: who belongs where.
    left, owned = members, None
    for _ in range(rounds):
        pivots = left.groupBy("h").agg(F.min("k").alias("region"))
        votes = left.join(pivots, "h").groupBy("k", "n", "p", "region").agg(F.count("*").alias("v"))
        best = votes.groupBy("k", "n", "p").agg(F.max("v").alias("v"), F.max_by("region", F.col("v") * 2 + (F.col("region") == F.col("k")).cast("int")).alias("region"))
        got = cut(best.where(F.col("v") >= near * F.col("p")).select("k", "region"))
        owned = got if owned is None else owned.unionByName(got)
        left = cut(left.join(got, "k", "left_anti"))
    rest = left.select("k").distinct().select("k", F.col("k").alias("region"))
    owned = cut(owned.unionByName(rest))

    # Windows: who else has to be looked at there.
    # Two regions look at each other's members once, in the larger one.
    sizes = owned.groupBy("region").agg(F.count("*").alias("size"))
    placed = members.join(owned.join(sizes, "region"), "k")
    sizes = placed.groupBy("region").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    there = placed.groupBy("h", "region", "size").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    there = there.select(F.col("h").alias("h2"), "region", F.col("size").alias("size2"), "least", "most")
    fits = (F.col("size2") > F.col("size")) | ((F.col("size2") == F.col("size")) & (F.col("region") > F.col("own")))
    fits &= (F.col("most") * den >= F.col("n") * num) & (F.col("n") * den >= F.col("least") * num)
    shared = placed.select("h", "k", "n", "size", F.col("region").alias("own")).join(there, (F.col("h") == F.col("h2")) & fits)
    shared = shared.groupBy("k", "n", "region").agg(F.count("*").alias("c")).join(sizes, "region")
    lo, hi = F.greatest("lo", F.ceil(F.col("n") * num / den)), F.least("hi", F.floor(F.col("n") * den / num))
    bound = lambda x: (x + F.col("n")) * (num / (num + den)) - F.greatest(x, F.col("n")) * (num / den)
    shared = shared.where((lo <= hi) & (F.col("c") >= F.least(bound(lo), bound(hi)) - 1e-6))
    deal = owned.select("region", "k", F.lit(True).alias("member")).unionByName(shared.select("region", "k", F.lit(False).alias("member")))
    deal, n_deal = cut(deal), None
    held = deal.groupBy("region").agg(F.count("*").alias("m"), F.max(F.col("member")).alias("any")).where("m > 1")
    held = cut(held)
    deal = deal.join(held.select("region", "m"), "region")
    n_deal = deal.count()

    # Texts to regions; a large region becomes blocks of members against blocks of all.
    b = F.ceil(2 * F.col("m") / most).cast("long")
    mine = F.pmod(F.xxhash64("k"), b)
    everywhere = F.sequence(F.lit(0).cast("long"), b - 1)
    deal = deal.withColumn("b", F.when(F.col("m") > most, b).otherwise(F.lit(1).cast("long"))).withColumn("own", F.when(F.col("m") > most, mine).otherwise(F.lit(0).cast("long")))
    # Block (i, j): members of share i, partners of share j.
    as_other = F.transform(everywhere, lambda i: F.struct((i * F.col("b") + F.col("own")).alias("block"), (F.col("member") & (i == F.col("own"))).alias("member"), F.lit(True).alias("other"), (~F.col("member")).alias("guest")))
    as_member = F.transform(F.filter(everywhere, lambda j: F.col("member") & (j != F.col("own"))), lambda j: F.struct((F.col("own") * F.col("b") + j).alias("block"), F.lit(True).alias("member"), F.lit(False).alias("other"), F.lit(False).alias("guest")))
    simple = F.array(F.struct(F.lit(0).cast("long").alias("block"), F.col("member"), F.lit(True).alias("other"), (~F.col("member")).alias("guest")))
    deal = deal.select("region", "k", F.when(F.col("b") > 1, F.concat(as_other, as_member)).otherwise(simple).alias("to"))
    want = deal.groupBy("k").agg(F.flatten(F.collect_list(F.transform("to", lambda x: F.struct("region", x["block"].alias("block"), x["member"].alias("member"), x["other"].alias("other"), x["guest"].alias("guest"))))).alias("to"))
    want = want.join(one, "k")
    texts = rows.join(want.withColumnRenamed("id", "rid").withColumnRenamed("k1", "r1").withColumnRenamed("k2", "r2"), F.col("k1").eqNullSafe(F.col("r1")) & F.col("k2").eqNullSafe(F.col("r2")) & F.col("id").eqNullSafe(F.col("rid")))
    texts = texts.select("k", "n", "copies", "t", F.explode("to").alias("to")).select("k", "n", "copies", "t", "to.*")
    buckets = max(1, n_deal // 1000, min(parts(spark), n_deal // 100))
    texts = texts.withColumn("bucket", F.pmod(F.xxhash64("region", "block"), F.lit(buckets)))
    found = texts.groupBy("bucket").applyInPandas(_regions(k, num, den, leaf), "a long, b long, links long")
    found = cut(found)
    roots = components(found.where("a != b").select("a", "b"), cut)
    links = found.groupBy(F.col("a").alias("k")).agg(F.sum("links").alias("links"))

    # Back to documents.
    sets_ = one.select("k", "n", "copies", "id").join(roots.withColumnRenamed("node", "k"), "k", "left").join(links, "k", "left")
    sets_ = sets_.select("k", "n", "copies", "id", F.coalesce("root", "k").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    sets_ = cut(sets_)
    least = sets_.groupBy("root").agg(F.min("id").alias("component"))
    sets_ = sets_.join(least, "root").select("k", "n", "component", (F.col("links") + F.col("copies") - 1).alias("links"))
    full = ids.where("n > 0").join(sets_, ["k", "n"]).select("id", "n", "component", "links")
    empty = ids.where("n = 0").select("id", "n", F.col("id").alias("component"), F.lit(0).cast("long").alias("links"))
    return full.unionByName(empty).select(F.col("id").alias(id_), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("links").alias("n_links"))


def op4(spark, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents"))
