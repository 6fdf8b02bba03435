"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum of w_i + sum over pairs of <v_i, v_j>) over the distinct terms of a whole text: pairs of terms count, not terms alone.
It is trained here, on a bounded sample of labelled rows; scoring reads every text, whole, in its own partition.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import give_back, pieces, ship, text_bytes, worker_cache
from .kernels import U, fold, prefix_sums, span_hashes, word_spans

#: Terms are runs of ASCII letters and digits and of all bytes over 127.
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
#: Lengths in bytes of the beginnings of words that are terms too.
STEMS = (4, 5, 6, 7, 8)


@dataclass(frozen=True)
class Settings:
    """bits: of a term's hash. sample: labelled rows to train on at most, by the smallest hash of their doc_id. terms: kept after training's own
    counts, by how surely they tell the labels apart (|z| at least `least_z`). rank: length of the pair vectors.
    weight: of a toxic example in training, against a clean one."""

    bits: int = 20
    sample: int = 24_000
    terms: int = 2048
    least_z: float = 3.0
    rank: int = 4
    epochs: int = 60
    rate: float = 0.2
    decay: float = 1e-4
    threshold: float = 0.7
    weight: float = 1.0
    seed: int = 7


@dataclass
class Machine:
    bits: int
    place: np.ndarray  # of each hash value: 0 if its terms are not kept, else 1 + row of w and v
    bias: float
    w: np.ndarray
    v: np.ndarray

    def scores(self, doc: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
        """doc and term: each distinct pair once."""
        s = self.bias + np.bincount(doc, self.w[term], n)
        for k in range(self.v.shape[1]):
            x = self.v[term, k]
            s += 0.5 * (np.bincount(doc, x, n) ** 2 - np.bincount(doc, x * x, n))
        return 1 / (1 + np.exp(-np.clip(s, -30, 30)))


def hashed_terms(data: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash value) of each term occurrence: words, and the first bytes of longer ones, which endings don't change."""
    data = fold(data)
    starts, ends, first = word_spans(data, offsets, _APART)
    sums = prefix_sums(data)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    docs, hashes = [doc], [span_hashes(sums, starts, ends)]
    for n in STEMS:
        at = np.flatnonzero(ends - starts > n)
        docs.append(doc[at])
        hashes.append(span_hashes(sums, starts[at], starts[at] + n))
    return np.concatenate(docs), (np.concatenate(hashes) >> U(64 - bits)).astype(np.int64)


def distinct_pairs(doc: np.ndarray, term: np.ndarray, n_terms: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(doc * n_terms + term)
    return both // n_terms, both % n_terms


def train(docs: list[np.ndarray], labels: np.ndarray, s: Settings = Settings()) -> Machine:
    """docs: the distinct hash values of each document. One class alone, or no documents: the bias is all there is."""
    y = labels.astype(float)
    n, n1 = len(y), y.sum()
    bias = float(np.log((n1 + 0.5) / (n - n1 + 0.5)))
    place = np.zeros(1 << s.bits, np.int32)
    if n1 in (0, n):
        return Machine(s.bits, place, bias, np.zeros(0), np.zeros((0, s.rank)))
    # Documents with each term, by label; a few hundred documents at a time, so that no wide copy of all terms is made.
    a, b = np.zeros(1 << s.bits), np.zeros(1 << s.bits)
    for i in range(0, n, 256):
        for side, on in ((a, y[i : i + 256] > 0), (b, y[i : i + 256] <= 0)):
            some = [d for d, k in zip(docs[i : i + 256], on) if k]
            if some:
                ids, times = np.unique(np.concatenate(some), return_counts=True)
                side[ids] += times
    z = np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n - n1 - b + 0.5))
    z /= np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (n1 - a + 0.5) + 1 / (n - n1 - b + 0.5))
    kept = np.argsort(-np.abs(z), kind="stable")[: s.terms]
    kept = kept[np.abs(z[kept]) >= min(s.least_z, np.sqrt(n1) / 2)]
    place[kept] = np.arange(1, len(kept) + 1)
    rows = [x[x > 0] - 1 for x in (place[d] for d in docs)]
    doc, term = np.repeat(np.arange(n), [len(x) for x in rows]), np.concatenate(rows)
    rng = np.random.default_rng(s.seed)
    w, v = np.zeros(len(kept)), rng.normal(0, 0.05, (len(kept), s.rank))
    gw, gv, gb = np.full(len(kept), 1e-8), np.full(v.shape, 1e-8), 1e-8
    size = 256
    starts = np.searchsorted(doc, np.arange(0, n + size, size))
    for _ in range(s.epochs):
        for i in rng.permutation(len(starts) - 1):
            d, t = doc[starts[i] : starts[i + 1]] - i * size, term[starts[i] : starts[i + 1]]
            part = y[i * size : (i + 1) * size]
            m = len(part)
            if not m:
                continue
            x = v[t]
            sums = np.stack([np.bincount(d, x[:, k], m) for k in range(s.rank)], 1)
            squares = np.stack([np.bincount(d, x[:, k] ** 2, m) for k in range(s.rank)], 1)
            out = bias + np.bincount(d, w[t], m) + 0.5 * (sums**2 - squares).sum(1)
            g = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - part) * np.where(part > 0, s.weight, 1.0) / m
            uses = np.bincount(t, minlength=len(w)) > 0
            dw = np.bincount(t, g[d], len(w)) + s.decay * w * uses
            dv = np.stack([np.bincount(t, g[d] * (sums[d, k] - x[:, k]), len(w)) for k in range(s.rank)], 1) + s.decay * v * uses[:, None]
            gw += dw**2
            gv += dv**2
            gb += g.sum() ** 2
            w -= s.rate * dw / np.sqrt(gw)
            v -= s.rate / 2 * dv / np.sqrt(gv)
            bias -= s.rate * g.sum() / np.sqrt(gb)
    return Machine(s.bits, place, float(bias), w, v)


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 3 is 1; such rows teach nothing. A null doc_id is never held out, but has no label either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """(label, text) of the labelled rows that may be learnt from, s.sample at most, chosen by a hash of doc_id, whatever the order of rows.

    Labels that contradict each other for one doc_id count as their largest; null labels are no labels.
    """
    chosen = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Machine:
    """A machine that has learnt from the labelled rows of docs that are not held out.

    Only the sample's distinct term hashes and labels come to the driver: s.sample is their bound. Null texts are empty; null doc_ids and labels teach nothing,
    contradicting labels count as the largest, repeated rows of docs teach once each; without rows to learn from, the bias is all there is. Ties in the sample
    go by doc_id; other columns are not read.
    """
    ship(docs.sparkSession)
    bits = s.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        for batch in batches:
            for part in pieces(batch, "text", 1 << 21):
                doc, term = distinct_pairs(*hashed_terms(*text_bytes(part.column("text")), bits), 1 << bits)
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                terms = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(term, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("label").cast(pa.int32()), terms], ["doc_id", "label", "terms"])

    rows = training_rows(docs.withColumn("doc_id", F.col("doc_id").cast("long")), labels, s).mapInArrow(run, "doc_id long, label int, terms array<int>").toArrow()
    if not rows.num_rows:
        return train([], np.zeros(0), s)
    ids, labels_, flat = (rows[c].combine_chunks() for c in ("doc_id", "label", "terms"))
    del rows
    offsets, values = flat.offsets.to_numpy(), flat.values.to_numpy()
    # The same order, whatever the partitions: by doc_id, then by terms where an id repeats.
    order = sorted(range(len(ids)), key=lambda i, k=ids.to_numpy(): (k[i], offsets[i + 1] - offsets[i], crc32(values[offsets[i] : offsets[i + 1]])))
    machine = train([values[offsets[i] : offsets[i + 1]] for i in order], labels_.to_numpy()[order], s)
    del ids, labels_, flat, offsets, values, order
    give_back()  # the driver's arrays
    return machine


def _scored(docs: DataFrame, machine: Machine, columns: list[str]) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(machine)  # 2^bits places and s.terms rows: bounded by Settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("toxicity")
        m = shared.value
        for batch in batches:
            for part in pieces(batch, "__text", 1 << 21):
                doc, term = hashed_terms(*text_bytes(part.column("__text")), m.bits)
                place = m.place[term]
                on = place > 0
                pairs = distinct_pairs(doc[on], place[on].astype(np.int64) - 1, max(1, len(m.w)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(m.scores(*pairs, part.num_rows))], [*columns, "__score"])

    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField("__score", T.DoubleType())])
    return docs.select(*columns, F.col("text").alias("__text")).mapInArrow(run, schema)


def score(docs: DataFrame, machine: Machine, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each of docs' rows.

    Null and empty texts have no terms and score the bias alone. Repeated rows, ties and null doc_ids are rows like any other; other columns are not
    read; an empty table gives no rows.
    """
    out = _scored(docs, machine, ["doc_id"])
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= s.threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, machine: Machine, s: Settings = Settings()) -> DataFrame:
    """docs' rows that are not predicted toxic, with all their columns (of any names but `__text` and `__score`).

    Null and empty texts score the bias alone; rows with null doc_ids and repeated rows are judged like any other; an empty table gives no rows.
    """
    return _scored(docs, machine, docs.columns).filter(F.col("__score") < s.threshold).select(*docs.columns)
