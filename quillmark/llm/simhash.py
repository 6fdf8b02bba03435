"""SimHash near-duplicates by bit-sliced comparison.

64-bit fingerprints within `radius` bits agree in at least two of four 16-bit blocks (radius 2), so each goes to six buckets by a pair of blocks, and
every link meets in one. In a bucket, 64 fingerprints share a machine word: plane b holds bit b of each. One fingerprint is compared with a word of
them by xor with each plane; carry-save counters hold all 64 distances, and a word is abandoned once every distance in it is over the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import join_hot, least_of, materialize, pieces, ship
from .graph import components, union_find

RADIUS = 2
BLOCKS = 4
#: Buckets over this many are split once more by parts of their other bits, of which one must agree.
CROWDED = 4096


def fingerprints_of(texts: list[bytes], width: int = 3, seed: int = 42) -> np.ndarray:
    """A bit is set if it is set in over half of the XXH64 hashes of a text's word shingles; 0 without words."""
    from xxhash import xxh64_intdigest

    hashes, counts = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = t.lower().split()
        if len(w) >= width:
            hashes.extend(map(xxh64_intdigest, map(b" ".join, zip(*(w[k:] for k in range(width)))), repeat(seed)))
            counts[i] = len(w) - width + 1
        elif w:
            hashes.append(xxh64_intdigest(b" ".join(w), seed))
            counts[i] = 1
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(counts)
    if len(full):
        n = counts[full]
        bits = np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        sums = np.add.reduceat(bits, np.cumsum(n) - n, axis=0, dtype=np.int32)
        out[full] = np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",), width: int = 3, seed: int = 42) -> DataFrame:
    """These columns of docs and __fp, the fingerprint as a signed long: one row for each of docs' rows."""
    ship(docs.sparkSession)
    keep = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "__text", 1 << 21):
                texts = [t or b"" for t in part.column("__text").cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(fingerprints_of(texts, width, seed).view(np.int64))], [*keep, "__fp"])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("__fp", T.LongType())])
    return docs.select(*keep, F.col("text").alias("__text")).mapInArrow(run, schema)


def near_words(fp: np.ndarray, ends: np.ndarray, radius: int, chunk: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j < ends[i] at most radius bits apart. ends[i] is where i's bucket ends."""
    n = len(fp)
    width = -(-n // 64)
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    planes = np.zeros((64, width * 8), np.uint8)
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    planes[:, : packed.shape[1]] = packed
    planes = planes.view(np.uint64)
    share = bits.mean(axis=0)
    order = np.argsort(np.abs(share - 0.5), kind="stable")  # planes that tell most apart come first
    first = np.arange(1, n + 1) // 64
    words = np.maximum(0, (ends - 1) // 64 - first + 1) * (ends > np.arange(n) + 1)
    starts = np.concatenate([[0], np.cumsum(words)])
    one = np.uint64(1)
    full = ~np.uint64(0)
    n_counters = (radius + 1).bit_length()
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + chunk, "right")) - 1)
        c = words[lo:hi]
        if c.sum():
            q = np.repeat(np.arange(lo, hi), c)
            w = np.arange(len(q)) - np.repeat(np.cumsum(c) - c, c) + first[q]
            at = q + 1 - 64 * w  # lanes from this one on are later than q
            over = np.where(at > 0, (one << np.clip(at, 0, 63).astype(np.uint64)) - one, np.uint64(0))
            rest = ends[q] - 64 * w
            over |= np.where(rest < 64, full << np.clip(rest, 0, 63).astype(np.uint64), np.uint64(0))
            counters = [np.zeros(len(q), np.uint64) for _ in range(n_counters)]
            for k, b in enumerate(order):
                b = np.uint64(b)
                carry = planes[int(b)][w] ^ (np.uint64(0) - ((fp[q] >> b) & one))
                beyond = np.full(len(q), full)
                for i in range(n_counters):
                    counters[i], carry = counters[i] ^ carry, counters[i] & carry
                    beyond &= counters[i] if (radius + 1) >> i & 1 else ~counters[i]
                over |= beyond
                if k % 6 == 5:
                    alive = over != full
                    if not alive.all():
                        q, w, over = q[alive], w[alive], over[alive]
                        counters = [x[alive] for x in counters]
                        if not len(q):
                            break
            if len(q):
                lanes = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                row, lane = np.nonzero(lanes)
                yield q[row], w[row] * 64 + lane
        lo = hi


def run_ends(keys: np.ndarray) -> np.ndarray:
    """For each one of the sorted keys, where its run ends."""
    if not len(keys):
        return np.zeros(0, np.int64)
    last = np.flatnonzero(np.append(keys[1:] != keys[:-1], True)) + 1
    return np.repeat(last, np.diff(last, prepend=0))


def bucket_links(keys: np.ndarray, fp: np.ndarray, radius: int = RADIUS, crowded: int = CROWDED) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints and bucket keys (any order): (fp, root) pairs that join what the buckets link, no pair twice."""
    order = np.argsort(keys, kind="stable")
    keys, fp = keys[order], fp[order]
    ends = run_ends(keys)
    size = np.zeros(len(keys), np.int64)
    if len(ends):
        edge = np.unique(ends)
        size = np.repeat(np.diff(edge, prepend=0), np.diff(edge, prepend=0))

    def pairs():
        some = np.flatnonzero((size > 1) & (size <= crowded))
        if len(some):
            f = fp[some]
            for a, b in near_words(f, run_ends(keys[some]), radius):
                yield some[a], some[b]
        for end in np.unique(ends[size > crowded]):
            run = np.arange(end - size[end - 1], end)
            # radius + 1 parts of the 64 bits: fingerprints within the radius agree in one of them, whatever the bucket fixes.
            f = fp[run]
            varies = [b for b in range(64) if 0 < ((f >> np.uint64(b)) & np.uint64(1)).mean() < 1]
            for part in np.array_split(np.array(varies, np.uint64), radius + 1):
                sub = np.zeros(len(f), np.uint64)
                for i, b in enumerate(part):
                    sub |= ((f >> b) & np.uint64(1)) << np.uint64(i)
                by = np.argsort(sub, kind="stable")
                for a, b in near_words(f[by], run_ends(sub[by]), radius):
                    yield run[by[a]], run[by[b]]

    root = union_find(len(fp), pairs())
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return fp[moved], fp[root[moved]]


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(a, b): pairs that connect all fingerprints at most radius bits apart. distinct has each fp once."""
    ship(distinct.sparkSession)
    bits = 64 // blocks
    mask = (1 << bits) - 1
    block = [F.shiftrightunsigned("fp", bits * i).bitwiseAND(F.lit(mask)) for i in range(blocks)]
    keys = F.array(*(F.xxhash64(F.lit(n), *(block[i] for i in pair)) for n, pair in enumerate(combinations(range(blocks), blocks - radius))))
    dealt = distinct.select("fp", F.explode(keys).alias("key"))
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column("key").to_numpy(), b.column("fp").to_numpy()) for b in batches]
        if got:
            a, b = bucket_links(np.concatenate([k for k, _ in got]), np.concatenate([f for _, f in got]).view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return dealt.repartition(n, "key").mapInArrow(run, "a long, b long").distinct()


def groups(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """fp, root, component_id for each distinct __fp of rows (doc_id, __fp): root is the group's own key, component_id its smallest doc_id."""
    distinct = rows.groupBy(F.col("__fp").alias("fp")).agg(F.min("doc_id").alias("least"))
    comp = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(comp, distinct.fp == comp.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    return least_of(rooted, "root", "least", "component_id", F.col("fp")).select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: one row for each of docs' rows.

    Null or blank texts have fingerprint 0 and link like any other. Repeated rows and exact copies meet as one fingerprint before any comparison. A
    null doc_id is never the smallest; a group of nulls alone has component_id null. An empty table gives no rows; other columns are not read.
    """
    rows = materialize(fingerprints(docs), "simhash-rows")
    found = join_hot(rows.withColumnRenamed("__fp", "fp"), groups(rows, radius), "fp", F.col("doc_id"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each group: one that has its smallest doc_id (any one of them, or of all where each doc_id is null).

    Null and blank texts are one group with whatever else is near fingerprint 0; other columns, but for `__text`, `__rid` and `__fp`, may have any names; an
    empty table gives no rows.
    """
    rows = materialize(fingerprints(docs.withColumn("__rid", F.monotonically_increasing_id()), (*docs.columns, "__rid")), "simhash-docs")
    ids = rows.select("doc_id", "__fp", "__rid")
    found = join_hot(ids.withColumnRenamed("__fp", "fp"), groups(ids, radius), "fp", F.col("__rid")).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return rows.join(found.groupBy("root").agg(F.min("__rid").alias("__rid")), "__rid", "left_semi").select(*docs.columns)
