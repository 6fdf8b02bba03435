"""Nearest neighbours by learned partitions (after Dong, Indyk, Razenshteyn and Wagner, 2020).

1. A bounded sample of the vectors gets its exact neighbour graph, which is cut into parts of nearly one size: halving along principal directions, then label
   propagation under a bound on each part's size, so that few neighbours are apart.
2. A small classifier (multinomial logistic regression) learns each sampled vector's distribution of its neighbours' parts.
3. Every vector of the table goes to its most probable part. A query goes to its most probable parts, as many as hold the probability that `Settings.cover` of
   the neighbours of vectors kept from training asked for; those parts' vectors are measured exactly.

Equal vectors are one vector with its smallest ids, of which no result can need more than k + 1. Parts are dealt in blocks of candidates by chunks of queries, so a
part with a third of all vectors is many tasks; each task returns k + 1 rows a query, which are merged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import join_hot, materialize, ship


@dataclass(frozen=True)
class Settings:
    """k: neighbours asked for. sample: vectors to learn from, about as many at most. rows: vectors meant for a part, whose number grows with the table up to one
    for each `members` sampled vectors. degree: of the graph. cover: the share of neighbours that probed parts are to hold. block, chunk: most candidates and,
    about, queries of a task. exact: one part, which every query reads."""

    k: int = 10
    sample: int = 8192
    rows: int = 2048
    members: int = 32
    degree: int = 10
    cover: float = 0.97
    block: int = 16384
    chunk: int = 4096
    exact: bool = False
    seed: int = 42


@dataclass(frozen=True)
class Router:
    """Probabilities of parts: softmax of [x / scale, |x / scale|^2 - 1, 1] @ weights. mass: probability that a query's parts are to hold."""

    scale: float
    weights: np.ndarray
    mass: float

    @property
    def parts(self) -> int:
        return self.weights.shape[1]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(features(x, self.scale) @ self.weights)


def features(x: np.ndarray, scale: float) -> np.ndarray:
    z = x / scale
    return np.column_stack([z, (z * z).sum(1) - 1, np.ones(len(z))])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def graph_of(x: np.ndarray, degree: int, step: int = 512) -> np.ndarray:
    """Each row's `degree` nearest others (all, if fewer), in any order."""
    degree, norm = min(degree, len(x) - 1), (x * x).sum(1)
    out = np.zeros((len(x), degree), np.int64)
    for i in range(0, len(x), step):
        far = norm[i : i + step, None] + norm - 2 * x[i : i + step] @ x.T
        far[np.arange(len(far)), np.arange(i, i + len(far))] = np.inf
        out[i : i + step] = np.argpartition(far, degree - 1, axis=1)[:, :degree] if degree else 0
    return out


def halved(x: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """A part for each row, all of one size but for rounding: cut in two along the principal direction, again and again."""
    out, todo = np.zeros(len(x), np.int64), [(np.arange(len(x)), 0, parts)]
    while todo:
        rows, first, m = todo.pop()
        if m == 1:
            out[rows] = first
            continue
        own = x[rows] - x[rows].mean(0) if len(rows) else x[rows]
        along = rng.standard_normal(x.shape[1])
        for _ in range(12):
            along = own.T @ (own @ along)
            along /= np.linalg.norm(along) or 1.0
        order, cut = np.argsort(own @ along, kind="stable"), len(rows) * (m // 2) // m
        todo += [(rows[order[:cut]], first, m // 2), (rows[order[cut:]], first + m // 2, m - m // 2)]
    return out


def balanced(graph: np.ndarray, part: np.ndarray, parts: int, slack: float = 1.05, rounds: int = 20) -> np.ndarray:
    """Label propagation: rows move to the part that holds most of their neighbours, those that gain most first, while a part has room."""
    n, degree = graph.shape
    one, two = np.repeat(np.arange(n), degree), graph.ravel()
    one, two = np.concatenate([one, two]), np.concatenate([two, one])
    part, room = part.copy(), int(np.ceil(slack * n / parts))
    size = np.bincount(part, minlength=parts)
    for _ in range(rounds):
        near = np.bincount(one * parts + part[two], minlength=n * parts).reshape(n, parts)
        best = near.argmax(1)
        gain = near[np.arange(n), best] - near[np.arange(n), part]
        moved = 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())].tolist():
            if size[best[i]] < room:
                size[part[i]] -= 1
                part[i] = best[i]
                size[part[i]] += 1
                moved += 1
        if not moved:
            break
    return part


def train(f: np.ndarray, target: np.ndarray, rng: np.random.Generator, epochs: int = 30, batch: int = 256, rate: float = 0.05) -> np.ndarray:
    """Weights of the logistic regression, by Adam on cross entropy. They start from the parts' means, whose nearest is the most probable part."""
    share = target / np.maximum(target.sum(0), 1e-9)
    mean = share.T @ f
    w = mean.T.copy()
    w[-1] = -0.5 * (mean[:, :-2] ** 2).sum(1)
    w[-2] = 0
    one, two, t = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(epochs):
        order = rng.permutation(len(f))
        for i in range(0, len(f), batch):
            rows, t = order[i : i + batch], t + 1
            grad = f[rows].T @ (softmax(f[rows] @ w) - target[rows]) / len(rows) + 1e-5 * w
            one, two = 0.9 * one + 0.1 * grad, 0.999 * two + 0.001 * grad * grad
            w -= rate / (1 + 0.01 * t) * (one / (1 - 0.9**t)) / (np.sqrt(two / (1 - 0.999**t)) + 1e-8)
    return w


def fit(x: np.ndarray, n: int, s: Settings) -> Router:
    """A router for a table of n distinct vectors, of which x is a sample."""
    parts = 1 if s.exact else int(min(-(-n // s.rows), len(x) // s.members))
    if parts < 2:
        return Router(1.0, np.zeros((x.shape[1] + 2, 1)), 1.0)
    rng = np.random.default_rng(s.seed)
    x = x[rng.permutation(len(x))]
    scale = float(np.sqrt((x * x).sum(1).mean()))
    graph = graph_of(x, s.degree)
    part = balanced(graph, halved(x, parts, rng), parts)
    target = np.zeros((len(x), parts))
    for near in (part, *(part[graph[:, j]] for j in range(graph.shape[1]))):
        target[np.arange(len(x)), near] += 1 / (1 + graph.shape[1])
    f, held = features(x, scale), len(x) // 5
    w = train(f[held:], target[held:], rng)
    p = softmax(f @ w)
    # How much probability lies before the part that a neighbour is really dealt to.
    own = p.argmax(1)
    order = np.argsort(-p[:held], axis=1, kind="stable")
    before = np.zeros((held, parts))
    np.put_along_axis(before, order, np.cumsum(np.take_along_axis(p[:held], order, 1), 1) - np.take_along_axis(p[:held], order, 1), 1)
    asked = np.take_along_axis(before, own[graph[:held]], 1)
    return Router(scale, w, float(np.quantile(asked, s.cover)) + 1e-9)


def usable(v: Column) -> Column:
    """Whether a vector takes part: not null, no null or non-finite component, not zero."""
    wrong = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(wrong, F.lit(True)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """v and ids (its k + 1 smallest vec_ids, in order) of rows (vec_id, v): one row for each vector."""
    few = rows.withColumn("rn", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("rn") <= k + 1)
    return few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


def routed(vectors: DataFrame, router: Router, room: list[int] | None = None, least: int = 0) -> DataFrame:
    """vectors with `part`: the most probable one; or, if each part's number of vectors is given, a row for each part to read, which hold `least` vectors at least."""
    shared = vectors.sparkSession.sparkContext.broadcast(router)
    size = None if room is None else np.array(room, np.int64)

    def run(batches):
        r = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            p = r.probabilities(matrix(batch.column("v")))
            if size is None:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.argmax(1).astype(np.int32))], [*batch.schema.names, "part"])
                continue
            order = np.argsort(-p, axis=1, kind="stable")
            sorted_p = np.take_along_axis(p, order, 1)
            held = np.cumsum(size[order], 1) - size[order]
            row, place = np.nonzero(((np.cumsum(sorted_p, 1) - sorted_p) < r.mass) | (held < least))
            some = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*some.columns, pa.array(order[row, place].astype(np.int32))], [*batch.schema.names, "part"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    return vectors.mapInArrow(run, f"{schema}, part int")


def closest(q: np.ndarray, x: np.ndarray, id_of: np.ndarray, row_of: np.ndarray, k: int, step: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, distance, id): the k nearest rows of each query, of equals those with the smallest ids. Row i has id id_of[i] and the vector x[row_of[i]]; rows are
    by vector. Inner products choose, with room for their rounding; what they choose is measured by differences."""
    norm, out = (x * x).sum(1), []
    first = np.searchsorted(row_of, np.arange(len(x) + 1))
    for i in range(0, len(q), step):
        own = q[i : i + step]
        size = (own * own).sum(1)
        far = size[:, None] + norm - 2 * own @ x.T
        some = min(k, len(x))
        limit = np.partition(far, some - 1, axis=1)[:, some - 1] + 1e-12 * (size + norm.max()) * q.shape[1]
        a, b = np.nonzero(far <= limit[:, None])
        exact = np.sqrt(((own[a] - x[b]) ** 2).sum(1))
        n = first[b + 1] - first[b]
        a, exact, ids = np.repeat(a, n), np.repeat(exact, n), id_of[np.arange(n.sum()) + np.repeat(first[b] - (np.cumsum(n) - n), n)]
        order = np.lexsort((ids, exact, a))
        a, exact, ids = a[order], exact[order], ids[order]
        place = np.arange(len(a)) - np.searchsorted(a, a)
        out.append((a[place < k] + i, exact[place < k], ids[place < k]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _measured(queries: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """q, score, vec_id: of each query (q, v, part, block, chunk), the k nearest rows of each cell (part, block, chunk, v, ids) that it reads."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "vec_id": pa.array([], pa.int64())})
        ids = right.column("ids").combine_chunks()
        row_of = np.repeat(np.arange(len(ids)), ids.value_lengths().to_numpy())
        at, score, vec_id = closest(matrix(left.column("v")), matrix(right.column("v")), ids.flatten().to_numpy(), row_of, k)
        return pa.table({"q": left.column("q").to_numpy()[at], "score": score, "vec_id": vec_id})

    by = ["part", "block", "chunk"]
    return queries.groupBy(*by).cogroup(cells.groupBy(*by)).applyInArrow(run, "q long, score double, vec_id long")


def search(rows: DataFrame, queries: DataFrame, s: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of rows (vec_id, embedding) for each of queries (the same columns), by Euclidean distance in double.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without an id or of another length than most vectors have (of
    lengths as frequent, the smallest). Repeated rows are one; an id with several vectors is several candidates and a query for each. A query's own row is no
    candidate for it, its copies under other ids are, at 0. Fewer candidates than k: all. Ties go to the smaller vec_id. Other columns are not read; empty
    tables give no rows. Which neighbours are found is approximate (Settings.cover) unless s.exact; scores and order of those found are exact.
    """
    spark = rows.sparkSession
    ship(spark)
    valid, asked = (d.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")) for d in (rows, queries))
    width = valid.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = width[0]["d"] if width else 0
    # Numbered in a written table: numbers that are made again might be others.
    vectors = materialize(distinct_vectors(valid.filter(F.size("v") == d).distinct(), s.k).withColumn("key", F.monotonically_increasing_id()), "vectors")
    n = vectors.count()
    share = min(1.0, s.sample / max(n, 1))
    x = matrix(vectors.filter(F.pmod(F.xxhash64(F.lit(s.seed), "v"), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").toArrow().column("v"))
    router = fit(x[np.lexsort(x.T)], n, s) if len(x) else Router(1.0, np.zeros((d + 2, 1)), 1.0)
    placed = materialize(routed(vectors, router), "vectors-parts")
    held = dict(map(tuple, placed.groupBy("part").count().collect()))  # one row a part
    size = [held.get(i, 0) for i in range(router.parts)]

    # A part's vectors are dealt to blocks, its queries to chunks; every block meets every chunk.
    asked = materialize(join_hot(asked.filter(F.size("v") == d).distinct(), vectors.select("v", F.col("key").alias("q")), "v", F.col("vec_id")), "queries")
    reads = materialize(routed(asked.groupBy("q").agg(F.first("v").alias("v")), router, size, 20 * s.k), "queries-parts")
    told = dict(map(tuple, reads.groupBy("part").count().collect()))
    grid = spark.createDataFrame([(i, -(-n // s.block), -(-told.get(i, 0) // s.chunk)) for i, n in enumerate(size) if n and told.get(i)], "part int, blocks int, chunks int")

    def dealt(frame: DataFrame, own: str, other: str, salt: Column) -> DataFrame:
        one = F.pmod(salt, F.col(f"{own}s")).cast("int").alias(own)
        return frame.join(F.broadcast(grid), "part").select("*", one).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)))

    cells = dealt(placed, "block", "chunk", F.xxhash64("key")).select("part", "block", "chunk", "v", "ids")
    each = dealt(reads, "chunk", "block", F.xxhash64("q")).select("q", "v", "part", "block", "chunk")
    found = _measured(each, cells, s.k + 1)
    best = found.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy("score", "vec_id"))).filter(F.col("rn") <= s.k + 1)
    lists = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    out = join_hot(asked.select(F.col("vec_id").alias("query_id"), "q"), lists, "q", F.col("query_id"))
    others = F.slice(F.filter("near", lambda x: ~((x["score"] == 0) & (x["vec_id"] == F.col("query_id")))), 1, s.k)
    return out.select("query_id", F.posexplode(others).alias("at", "x")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
