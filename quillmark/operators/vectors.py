"""k nearest vectors by cosine for many queries at once: an inverted file.

Centroids are trained on a bounded sample. Every vector is dealt to the list of its nearest centroid; a query reads the lists of its nearest centroids, as many as
`cover` of the sample's own neighbours asked for. Candidates are dealt to blocks, which hold several short lists or a part of a long one, queries to chunks; a query goes
once to each block with a list that it reads, not once a list. A task ranks its cell list by list and hands on k rows a query, which are merged. Products in single
precision, with room for their rounding, drop what a query's k best so far leave behind; the rest is measured in double.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import written


@dataclass(frozen=True)
class Lists:
    """sample: vectors to train on, about as many at most. length: vectors meant for a list; members: sampled vectors a list needs, which bounds the number of
    lists. block, chunk: candidates and queries of a cell, about; from 16 blocks on they grow with the table, up to `most`, so that what is shuffled grows no faster."""

    sample: int = 16384
    length: int = 1024
    members: int = 32
    rounds: int = 12
    cover: float = 0.98
    block: int = 16384
    chunk: int = 4096
    most: int = 131072
    seed: int = 7

    def sized(self, n: int, own: int) -> int:
        """Rows of a block or chunk of `own` rows at least, for a side of n rows."""
        return max(own, min(-(-n // 16), self.most))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def trained(x: np.ndarray, n: int, k: int, s: Lists) -> tuple[np.ndarray, int]:
    """(centroids, lists that a query reads) for a table of n vectors, of which the unit vectors x are a sample: spherical k-means."""
    lists = max(1, min(-(-n // s.length), len(x) // s.members))
    if lists == 1:
        return np.zeros((1, x.shape[1])), 1
    rng = np.random.default_rng(s.seed)
    centers = x[rng.choice(len(x), lists, replace=False)]
    for _ in range(s.rounds):
        own = (x @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        empty = np.bincount(own, minlength=lists) == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        centers = unit(sums + 1e-12)
    near = x @ centers.T
    own, asked = near.argmax(1), rng.choice(len(x), min(len(x), 1024), replace=False)
    close = x[asked] @ x.T
    close[np.arange(len(asked)), asked] = -2
    found = np.argpartition(-close, min(k, len(x) - 2), axis=1)[:, :k]
    # How many lists of a query come before the one that a neighbour is in.
    place = np.argsort(np.argsort(-near[asked], axis=1, kind="stable"), axis=1, kind="stable")
    return centers, int(np.quantile(np.take_along_axis(place, own[found], 1), s.cover)) + 1


def _visits(lists: np.ndarray, first: np.ndarray, parts: np.ndarray) -> pa.ListArray:
    """For each row of lists, the blocks that hold a part of one, each once: list i has parts[i] of them from first[i] on."""
    seen = np.zeros((len(lists), int((first + parts).max())), bool)
    for j in range(int(parts.max())):
        row, at = np.nonzero(parts[lists] > j)
        seen[row, first[lists[row, at]] + j] = True
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(seen.sum(1))).astype(np.int32)), pa.array(np.nonzero(seen)[1].astype(np.int32)))


def _dealt(rows: DataFrame, centers: np.ndarray, lists: int, blocks: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """rows (id, v) with `lists`: the `lists` nearest ones; and `blocks` to visit, if each list's first block and number of blocks are given."""
    shared = rows.sparkSession.sparkContext.broadcast(centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                near = matrix(b.column("v")) @ shared.value.T
                order = near.argmax(1)[:, None] if lists == 1 else np.argpartition(-near, min(lists, near.shape[1]) - 1, axis=1)[:, :lists]
                order = order.astype(np.int32)
                ends = np.arange(0, order.size + 1, order.shape[1], dtype=np.int32)
                more = [] if blocks is None else [_visits(order, *blocks)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.ListArray.from_arrays(ends, pa.array(order.ravel())), *more], [*b.schema.names, "lists", "blocks"][: 3 + len(more)])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, lists array<int>{'' if blocks is None else ', blocks array<int>'}")


class Best:
    """The k largest cosines, to nine decimals, of each of the unit vectors q with what it has met so far, of equals the smallest ids."""

    def __init__(self, q: np.ndarray, x: np.ndarray, qid: np.ndarray, xid: np.ndarray, k: int, others: bool):
        self.q, self.x, self.qid, self.xid, self.k, self.others = q, x, qid, xid, k, others
        self.cosine, self.at = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
        self.short, self.room = q.astype(np.float32), (q.shape[1] + 8) * 2.0**-23 + 2e-9

    def _put(self, a: np.ndarray, b: np.ndarray) -> None:
        if self.others:
            apart = self.qid[a] != self.xid[b]
            a, b = a[apart], b[apart]
        c = np.round(np.einsum("ij,ij->i", self.q[a], self.x[b]), 9)
        rows = np.unique(a)
        a, b, c = np.concatenate([np.repeat(rows, self.k), a]), np.concatenate([self.at[rows].ravel(), b]), np.concatenate([self.cosine[rows].ravel(), c])
        a, b, c = a[b >= 0], b[b >= 0], c[b >= 0]
        order = np.lexsort((self.xid[b], -c, a))
        a, b, c = a[order], b[order], c[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        a, b, c, place = (v[place < self.k] for v in (a, b, c, place))
        self.cosine[a, place], self.at[a, place] = c, b

    def meet(self, rows: np.ndarray, cols: np.ndarray, step: int = 256, first: int = 2048, wide: int = 16384) -> None:
        """Each of these rows of q meets each of these rows of x, which it has not met."""
        at = 0
        while at < len(cols):
            few = bool((self.at[rows, -1] < 0).any())
            some = cols[at : at + (first if few else wide)]
            at += len(some)
            x = self.x[some].astype(np.float32).T
            for i in range(0, len(rows), step):
                own = rows[i : i + step]
                near = self.short[own] @ x
                least = self.cosine[own, -1]
                if few and len(some) > self.k:
                    if self.others:
                        near[self.qid[own, None] == self.xid[some]] = -4
                    least = np.maximum(least, -np.partition(-near, self.k - 1, axis=1)[:, self.k - 1] - self.room)
                a, b = np.divmod(np.flatnonzero(near >= (least - self.room).astype(np.float32)[:, None]), len(some))
                if len(a):
                    self._put(own[a], some[b])

    def told(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in q, place in x, cosine)."""
        a, place = np.nonzero(self.at >= 0)
        return a, self.at[a, place], self.cosine[a, place]


def nearest_many(vectors: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, exact: bool = False, others: bool = True, lists: Lists = Lists()) -> DataFrame:
    """[J19] query, rank, key, cosine: for each of queries (key, vector) the k of vectors with the largest cosine, to nine decimals, ties to the smaller key.

    Vectors that are null, zero, or hold nulls take no part; all others have one length. others: a vector with the query's key is no candidate. exact: one list that
    every query reads; else which are found is approximate, and of those found cosines and order are exact. Empty tables give no rows.
    """
    spark = vectors.sparkSession
    v = F.col(vector).cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    # The norm is bound once: as a column it would be made again for each component. Written once, as counts, samples and both sides' steps read it.
    whole = F.element_at(F.transform(F.array(norm), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n))), 1)
    units = lambda d: written(d.select(F.col(key).alias("id"), whole.alias("v")).filter(F.col("v").isNotNull()), "units")
    told = [units(vectors)]
    told.append(told[0] if queries is vectors else units(queries))
    n = told[0].count()
    share = min(1.0, lists.sample / max(n, 1))
    x = np.zeros((0, 1)) if exact else matrix(told[0].filter(F.pmod(F.xxhash64(F.lit(lists.seed), "id"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").toArrow().column("v"))
    centers, probes = trained(x, n, k, lists) if len(x) else (None, 1)
    one = centers is None or len(centers) == 1
    own = told[0].withColumn("lists", F.array(F.lit(0))) if one else _dealt(told[0], centers, 1)
    # A row for each list.
    held = ({0: n} if n else {}) if one else dict(map(tuple, own.groupBy(F.col("lists")[0].alias("list")).count().collect()))
    block, m = lists.sized(n, lists.block), told[1].count()
    chunks = max(1, -(-m // lists.sized(m, lists.chunk)))
    # Blocks of a list: short lists share one, long ones have several.
    first, parts, number, room = {}, {}, 0, 0
    for i in sorted(held):
        if room + held[i] > block and room:
            number, room = number + 1, 0
        first[i], parts[i] = number, -(-held[i] // block)
        number, room = (number, room + held[i]) if parts[i] == 1 else (number + parts[i], 0)
    grid, wide = (F.array(*(F.lit(of.get(i, 0)) for i in range(max(held, default=0) + 1))) for of in (first, parts))
    at = F.col("lists")[0]
    candidates = own.withColumn("block", (F.get(grid, at) + F.pmod(F.xxhash64("id"), F.get(wide, at))).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    if one:
        asking = told[1].withColumn("lists", F.array(F.lit(0))).withColumn("blocks", F.sequence(F.lit(0), F.lit(max(parts.get(0, 1), 1) - 1)))
    else:
        asking = _dealt(told[1], centers, probes, tuple(np.array([of.get(i, 0) for i in range(len(centers))]) for of in (first, parts)))
    asking = asking.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)).cast("int")).withColumn("block", F.explode("blocks"))
    kind = vectors.schema[key].dataType.simpleString()

    def ranked(cell, left: pa.Table, right: pa.Table) -> pa.Table:
        a, b, cosine = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if left.num_rows and right.num_rows:
            best = Best(matrix(left.column("v")), matrix(right.column("v")), left.column("id").to_numpy(), right.column("id").to_numpy(), k, others)
            reads = left.column("lists").combine_chunks()
            asked, reader = reads.flatten().to_numpy(), np.repeat(np.arange(left.num_rows), reads.value_lengths().to_numpy())
            of = right.column("lists").combine_chunks().flatten().to_numpy()
            here = np.flatnonzero(np.isin(asked, of))
            here, held = here[np.argsort(asked[here], kind="stable")], np.argsort(of, kind="stable")
            for i in np.unique(of):
                rows, cols = (v[slice(*np.searchsorted(w[v], [i, i + 1]))] for v, w in ((here, asked), (held, of)))
                best.meet(reader[rows], cols)
            a, b, cosine = best.told()
        return pa.table({"query": left.column("id").take(pa.array(a)), "key": right.column("id").take(pa.array(b)), "cosine": cosine})

    by, sent = ["block", "chunk"], ["id", "v", "lists", "block", "chunk"]
    found = asking.select(*sent).groupBy(*by).cogroup(candidates.select(*sent).groupBy(*by)).applyInArrow(ranked, f"query {kind}, key {kind}, cosine double")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "key"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query", "rank", "key", "cosine")
