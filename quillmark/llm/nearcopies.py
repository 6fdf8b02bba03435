"""Near copies by SimHash at a stated similarity: sets of 5-word shingles whose Jaccard similarity is 0.8 or more.

Fingerprints of sets 0.8 alike differ in about 10 of 64 bits, which no choice of blocks can look up. So texts are dealt to buckets by bands of least shingle
hashes (20 bands of 5: two sets 0.8 alike share a bucket with a chance of 0.9996), and within its buckets every pair is decided, bit-sliced as in simhash.py:

1. Texts with the same words are one text. A bucket's fingerprints are compared with each other; a text stays if another one is within `radius` bits that isn't
   known to be of its group already.
2. Those texts meet in the bucket, in full. Each in turn is held against all later ones within the radius, closest first, by sets of 64-bit shingle hashes; what
   is similar enough joins its group, and pairs of one group need no look. So a bucket gives at most one link a text, and links give components.
3. Bands go in two lots, the first of which finds most groups: in the second, buckets that are one group by now are dropped before any text moves.

A bucket of very many or very long texts is dealt to parts, each of which is compared in itself; then texts that aren't of the bucket's commonest group visit all
of its parts. No pair within a bucket is left undecided, and nothing is capped: the work grows with the square of a bucket only as far as its texts are close
by their fingerprints and yet in different groups.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import give_back, join_hot, materialize, pieces, ship, worker_cache
from .graph import components
from .kernels import U, gather, mix
from .simhash import near_words, run_ends


@dataclass(frozen=True)
class Settings:
    """radius: sets at the similarity differ in 10 bits on average, with a deviation of 3. first: how many bands go in the first lot. crowd, mass: texts and
    shingles of a part of a bucket, about."""

    width: int = 5
    similarity: float = 0.8
    bands: int = 20
    rows: int = 5
    radius: int = 24
    first: int = 2
    crowd: int = 4096
    mass: int = 1 << 21
    seed: int = 42


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def shingles(words: list[bytes], width: int) -> set[bytes]:
    """Runs of `width` words; all of a shorter text is one."""
    return set(map(b" ".join, zip(*(words[k:] for k in range(width))))) if len(words) >= width else {b" ".join(words)} if words else set()


def hashes(words: list[bytes], s: Settings) -> np.ndarray:
    """The shingles' 64-bit hashes, each once."""
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, shingles(words, s.width), repeat(s.seed)), U)


def signatures(texts: list[bytes | None], s: Settings) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """(identity of each text's words, size and fingerprint of its set of shingles, a bucket a band); texts without words have 0 in all three."""
    from hashlib import blake2b

    same, sets = [], []
    for t in texts:
        w = words_of(t)
        same.append(blake2b(b" ".join(w), digest_size=16).digest())
        sets.append(hashes(w, s))
    fp, buckets = np.zeros(len(texts), U), np.zeros((len(texts), s.bands), np.int64)
    n = sizes = np.array([len(x) for x in sets], np.int64)
    full = np.flatnonzero(n)
    if len(full):
        flat, n = np.concatenate(sets), n[full]
        at = np.cumsum(n) - n
        sums = np.add.reduceat(np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), at, axis=0, dtype=np.int32)
        fp[full] = np.packbits(2 * sums > n[:, None], axis=1, bitorder="little").view(U).ravel()
        low = (flat >> U(32)).astype(np.uint32) ^ flat.astype(np.uint32)
        factors = mix(np.arange(1, s.bands * s.rows + 1, dtype=U)).astype(np.uint32) | np.uint32(1)
        for b in range(s.bands):
            key = np.full(len(full), U(b))
            for f in factors[b * s.rows : (b + 1) * s.rows]:
                v = low * f
                v ^= v >> np.uint32(15)
                key = mix(key ^ np.minimum.reduceat(v * f, at).astype(U))
            buckets[full, b] = key.view(np.int64)
    return same, sizes, fp, buckets


def linked(sets: list[np.ndarray], fp: np.ndarray, group: np.ndarray, home: np.ndarray, s: Settings) -> list[tuple[int, int]]:
    """Pairs of places that join all sets similar enough, none of which is needless; sets of one group count as joined. Of each pair one is at home."""
    n = np.array([len(x) for x in sets], np.int64)
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    starts, mark, out = np.cumsum(n) - n, np.zeros(len(names), bool), []
    group = np.unique(group, return_inverse=True)[1]
    for i in range(len(sets) - 1):
        rest = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
        if not home[i]:
            rest = rest[home[rest]]
        far = np.bitwise_count(fp[rest] ^ fp[i])
        # Sets too unlike in size can't be similar enough.
        near = (far <= s.radius) & (np.minimum(n[rest], n[i]) >= s.similarity * np.maximum(n[rest], n[i]) - 1e-9)
        rest = rest[near][np.argsort(far[near], kind="stable")]
        if not len(rest):
            continue
        own, step = ids[starts[i] : starts[i] + n[i]], 32
        mark[own] = True
        while len(rest):
            some, rest = rest[:step], rest[step:]
            common = np.add.reduceat(mark[gather(ids, starts[some], n[some])], np.cumsum(n[some]) - n[some], dtype=np.int64)
            for j in some[common >= s.similarity * (n[some] + n[i] - common) - 1e-9].tolist():
                if group[j] != group[i]:
                    out.append((i, j))
                    group[group == group[j]] = group[i]
            rest, step = rest[group[rest] != group[i]], 4 * step
        mark[own] = False
    return out


def _undecided(dealt: DataFrame, s: Settings) -> DataFrame:
    """Members (cell, rid, fp, label, home) that have another one of their cell within the radius, of another label; one of the two at home."""
    n, names = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions")), dealt.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("near copies")
        got = [[b.column(c).to_numpy(zero_copy_only=False) for c in b.schema.names] for b in batches]
        if not got:
            return
        columns = [np.concatenate(x) for x in zip(*got)]
        order = np.argsort(columns[0], kind="stable")
        cell, rid, fp, label, home = (c[order] for c in columns)
        ends = run_ends(cell)
        # Cells of one label only have nothing to decide.
        edge = np.unique(ends)
        begin = np.concatenate([[0], edge[:-1]]).astype(np.int64)
        mixed = np.repeat(np.minimum.reduceat(label, begin) != np.maximum.reduceat(label, begin), np.diff(edge, prepend=0))
        cell, rid, fp, label, home = (c[mixed] for c in (cell, rid, fp, label, home))
        keep = np.zeros(len(cell), bool)
        for a, b in near_words(fp.view(U), run_ends(cell), s.radius):
            asks = (label[a] != label[b]) & (home[a] | home[b])
            keep[a[asks]] = keep[b[asks]] = True
        yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (cell, rid, fp, label, home)], names)
        del got, columns, order, cell, rid, fp, label, home
        give_back()

    return dealt.repartition(n, "cell").mapInArrow(run, dealt.schema)


def _links(dealt: DataFrame, body: DataFrame, s: Settings) -> DataFrame:
    """(a, b): links that join all texts of a cell (cell, rid, fp, label, home) that are similar enough. body: rid, text. A task holds one cell at a time."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked = _undecided(dealt, s).join(body, "rid").select("cell", "rid", "fp", "label", "home", "text").repartition(n, "cell").sortWithinPartitions("cell", "rid")

    def decided(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        rid, fp, label, home = (np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in rows]) for c in ("rid", "fp", "label", "home"))
        sets = [hashes(words_of(t), s) for b in rows for t in b.column("text").cast(pa.binary()).to_pylist()]
        pairs = np.array(linked(sets, fp.view(U), label, home, s), np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(rid[pairs[:, 0]]), pa.array(rid[pairs[:, 1]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("near copies")
        cell, rows = None, []
        for batch in batches:
            of, at = batch.column("cell").to_numpy(), 0
            for end in np.unique(run_ends(of)).tolist():
                if rows and of[at] != cell:
                    yield decided(rows)
                    rows = []
                cell = of[at]
                rows.append(batch.slice(at, end - at))
                at = end
        if rows:
            yield decided(rows)
        give_back()

    return asked.mapInArrow(run, "a long, b long")


def _lot(members: DataFrame, stars: DataFrame | None, body: DataFrame, s: Settings, name: str) -> DataFrame:
    """stars (node, root), with what the buckets of members (key, parts, rid, fp) link besides."""

    def dealt(stars: DataFrame | None, rows: DataFrame) -> DataFrame:
        if stars is None:
            return rows.withColumn("label", F.col("rid"))
        known = stars.select(F.col("node").alias("rid"), F.col("root").alias("label"))
        return rows.join(known, "rid", "left").withColumn("label", F.coalesce("label", "rid"))

    def joined(stars: DataFrame | None, found: DataFrame) -> DataFrame:
        # Links among stars: what the earlier ones joined is not worked out again.
        return components(found if stars is None else stars.select(F.col("node").alias("a"), F.col("root").alias("b")).union(found))

    def cells(rows: DataFrame, part: Column, home: Column) -> DataFrame:
        return rows.select(F.xxhash64("key", part).alias("cell"), "rid", "fp", "label", home.alias("home"))

    own = F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")
    stars = joined(stars, materialize(_links(cells(dealt(stars, members), own, F.lit(True)), body, s), f"near-links-{name}"))
    wide = members.filter("parts > 1")
    if wide.isEmpty():
        return stars
    wide = materialize(dealt(stars, wide), f"near-wide-{name}")
    told = wide.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    wide = join_hot(wide, told, "key", F.col("rid")).withColumn("own", own)
    visits = F.when(F.col("label") == F.col("main"), F.array("own")).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    wide = wide.withColumn("part", F.explode(visits))
    return joined(stars, materialize(_links(cells(wide, F.col("part"), F.col("part") == F.col("own")), body, s), f"near-visits-{name}"))


def groups(signed: DataFrame, body: DataFrame, s: Settings) -> DataFrame:
    """__same, root: each different sequence of words in signed (rid, __same, __size, __fp, __bands) and its group's key; body (rid, text) has the texts."""
    texts = materialize(signed.groupBy("__same").agg(F.min(F.struct("rid", "__size", "__fp", "__bands")).alias("r")).select("__same", "r.*"), "near-texts")
    dealt = texts.select("rid", F.col("__fp").alias("fp"), F.posexplode("__bands").alias("band", "key"), F.col("__size").alias("size"))
    parts = F.greatest(F.ceil(F.count("*") / s.crowd), F.ceil(F.sum("size") / s.mass)).cast("int").alias("parts")
    crowded = dealt.groupBy("key").agg(F.count("*").alias("n"), parts).filter("n > 1").select("key", "parts")
    shared = materialize(dealt.drop("size").join(crowded, "key").select("band", "key", "parts", "rid", "fp"), "near-shared")
    some = materialize(body.join(shared.select("rid").distinct(), "rid", "left_semi").select("rid", "text"), "near-bodies")
    stars = _lot(shared.filter(F.col("band") < s.first), None, some, s, "first")
    stars = _lot(shared.filter(F.col("band") >= s.first), stars, some, s, "rest")
    return texts.join(stars, texts.rid == stars.node, "left").select("__same", F.coalesce("root", "rid").alias("root"))


def deduplicate(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs with one row of each group of near copies: one that has its smallest doc_id, which a null never is unless all are.

    Words are runs between ASCII blanks, A-Z folded; a text of fewer words than a shingle is one shingle. Null, empty and blank texts are copies of each other.
    Repeated rows are copies; other columns, of any names, are kept; an empty table gives no rows.
    """
    ship(docs.sparkSession)
    columns = docs.columns
    schema = T.StructType([T.StructField("rid", T.LongType()), docs.schema["doc_id"], T.StructField("__same", T.BinaryType()), T.StructField("__size", T.LongType()), T.StructField("__fp", T.LongType()), T.StructField("__bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("near copies")
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                same, sizes, fp, buckets = signatures(part.column("text").cast(pa.binary()).to_pylist(), s)
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, buckets.size + 1, s.bands, dtype=np.int32)), pa.array(buckets.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), pa.array(same, pa.binary()), pa.array(sizes), pa.array(fp.view(np.int64)), bands], schema.names)
        give_back()

    # Rows are numbered in a written table: numbers that are made again might be others.
    rows = materialize(docs.select(F.struct(*columns).alias("row"), F.monotonically_increasing_id().alias("rid")), "near-docs", "snappy")
    body = rows.select("rid", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"))
    signed = materialize(body.mapInArrow(run, schema), "near-signs")
    found = join_hot(signed.select("rid", "doc_id", "__same"), groups(signed, body.select("rid", "text"), s), "__same", F.col("rid"))
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("r")).select(F.col("r.rid").alias("rid"))
    return rows.join(kept, "rid", "left_semi").select("row.*")
