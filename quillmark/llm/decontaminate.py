"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

A window has as many words as the item it is held against, or is the whole document if that is shorter. Both are bags of 5-word shingles (an item of fewer
words is one shingle). A window that is as similar as asked for has one of the item's rarest shingles and most of all of them, so windows without these are
not fingerprinted; this prefilter is exact. Item fingerprints lie in one table for each of eight 8-bit blocks: within `radius` bits, one block differs by
radius / 8 bits at most, so looking up each block's neighbourhood misses none within the radius. What is found is verified by weighted Jaccard similarity of
the two bags.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .frames import give_back, pieces, ship, text_bytes, worker_cache
from .kernels import U, expand, fold, prefix_sums, span_hashes, window_hashes, word_spans

#: Words are runs of ASCII letters, digits and bytes over 127, so that case, blanks and marks don't hide a passage.
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
#: Pairs of a position and an item that are told apart at a time.
PAIRS = 1 << 22
#: Bytes of text that are searched at a time: a search takes about 50 times their memory, in each of an executor's workers.
PIECE = 1 << 19
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


@dataclass(frozen=True)
class Settings:
    """radius 26 of 64 bits: bags that are 0.8 alike differ in about 10, deviation 3. items, letters: most of the benchmark in one broadcast block; more take
    more passes over the documents."""

    shingle: int = 5
    similarity: float = 0.8
    radius: int = 26
    items: int = 20_000
    letters: int = 1 << 25


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, first word of each document and the end). Case is folded for A-Z and the letters of Latin-1."""
    data = fold(data)
    starts, ends, first = word_spans(data, offsets, _APART)
    return span_hashes(prefix_sums(data), starts, ends), first


def simhash(bags: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One fingerprint for each run of counts[i] shingle hashes; repeats weigh more."""
    if not len(counts):
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(np.ascontiguousarray(bags).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    sums = np.add.reduceat(bits, np.cumsum(counts) - counts, axis=0, dtype=np.int32)
    return np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


class Index:
    """The items of one block. Items with the same words share one entry; items without words have none."""

    def __init__(self, ids: list, texts: list[str], s: Settings = Settings()):
        self.s = s
        data = [t.encode() for t in texts]
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
        w, first = words_of(np.frombuffer(b"".join(data), np.uint8), offsets)
        entries: dict[bytes, list] = {}
        for i, item in enumerate(ids):
            own = w[first[i] : first[i + 1]]
            if len(own):
                entries.setdefault(own.tobytes(), []).append(item)
        self.members = list(entries.values())
        own = [np.frombuffer(k, np.uint64) for k in entries]
        self.length = np.array([len(x) for x in own], np.int64)
        self.width = np.minimum(self.length, s.shingle)
        self.bags = [window_hashes(x, int(k)) for x, k in zip(own, self.width)]
        self.counters = [Counter(b.tolist()) for b in self.bags]
        self.size = np.array([len(b) for b in self.bags], np.int64)
        self.fp = simhash(np.concatenate(self.bags), self.size) if self.bags else np.zeros(0, np.uint64)
        # How late the first shingle that the item has can be in a window of the item's size.
        self.slack = self.size - self.common(self.size, self.size)
        # Rare shingles to entries. A window as similar as asked for misses few of an item's shingles, so it has one of any that many and one more; the
        # rarest of the block are taken, which keeps phrases that many items share from bringing all of these.
        self.by_width, self.own = {}, [np.unique(b) for b in self.bags]
        for k in np.unique(self.width):
            at = np.flatnonzero(self.width == k)
            value, n = np.unique(np.concatenate([self.own[i] for i in at]), return_counts=True)
            rare = [np.unique(b[np.argsort(n[np.searchsorted(value, b)], kind="stable")[: len(b) - int(np.ceil(len(b) * s.similarity - 1e-9)) + 1]]) for b in (self.bags[i] for i in at)]
            h = np.concatenate(rare)
            e = np.repeat(at, [len(r) for r in rare])
            order = np.argsort(h, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(h >> U(44)).astype(np.int64)] = True
            self.by_width[int(k)] = (h[order], e[order], seen)
        # near[b][value]: entries whose block b is within radius / 8 bits of value.
        blocks = self.fp.view(np.uint8).reshape(-1, 8) if len(self.fp) else np.zeros((0, 8), np.uint8)
        values = np.arange(256, dtype=np.uint8)[:, None]
        self.near = [np.packbits(_ONES[values ^ blocks[None, :, b]] <= s.radius // 8, axis=1) for b in range(8)]

    def common(self, n, m):
        """Least number of shingles that windows of m and items of n have in common: from common / (n + m - common) >= similarity."""
        return np.ceil((n + m) * self.s.similarity / (1 + self.s.similarity) - 1e-9).astype(np.int64)

    def candidates(self, fp: np.ndarray, entry: np.ndarray) -> np.ndarray:
        """Which (window fingerprint, entry) pairs some block lets through and the whole distance keeps."""
        through = np.zeros(len(fp), bool)
        blocks = np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8)
        for b in range(8):
            through |= (self.near[b][blocks[:, b], entry // 8] >> (7 - entry % 8).astype(np.uint8)) & 1 == 1
        return through & (_ONES[(fp ^ self.fp[entry]).view(np.uint8).reshape(-1, 8)].sum(axis=1) <= self.s.radius)

    def search(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(document, entry, first word, similarity) of the best window for each document and entry that reaches the similarity; the earliest of equals."""
        w, first = words_of(data, offsets)
        best: dict[tuple[int, int], tuple[float, int]] = {}
        for k, (h, e, seen) in self.by_width.items():
            shingles = window_hashes(w, k)
            if not len(shingles):
                continue
            at = np.flatnonzero(seen[(shingles >> U(44)).astype(np.int64)])
            lo, hi = np.searchsorted(h, shingles[at], "left"), np.searchsorted(h, shingles[at], "right")
            own = np.searchsorted(first, at, "right") - 1
            whole = (at + k <= first[own + 1]) & (hi > lo)  # shingles don't cross documents
            at, lo, hi, own = at[whole], lo[whole], hi[whole], own[whole]
            some = [np.zeros(0, np.int64)]
            cuts = np.flatnonzero(np.diff(np.cumsum(hi - lo) // PAIRS, prepend=-1))
            for a, b in zip(cuts, np.append(cuts[1:], len(at))):
                row, nth = expand(hi[a:b] - lo[a:b])
                some.append(np.unique(own[a:b][row] * len(self.length) + e[lo[a:b][row] + nth]))
            for pair in np.unique(np.concatenate(some)).tolist():
                d, i = divmod(pair, len(self.length))
                lo_d, hi_d = int(first[d]), int(first[d + 1]) - k + 1
                hits = lo_d + np.flatnonzero(np.isin(shingles[lo_d:hi_d], self.own[i]))
                if len(hits) >= self.common(self.size[i], min(self.size[i], hi_d - lo_d)):
                    found = self._windows(shingles, hits, i, lo_d, hi_d)
                    if found:
                        best[d, i] = (found[0], found[1] - int(first[d]))
        return [(d, i, start, sim) for (d, i), (sim, start) in sorted(best.items())]

    def _windows(self, shingles: np.ndarray, hits: np.ndarray, i: int, lo: int, hi: int) -> tuple[float, int] | None:
        n = int(self.size[i])
        starts = np.unique((hits[:, None] - np.arange(self.slack[i] + 1)[None, :]).ravel())
        starts = starts[(starts >= lo) & (starts + n <= hi)]
        if not len(starts) and hi - lo < n:
            starts = np.array([lo])  # the document is shorter than the item: one window, all of it
        n = min(n, hi - lo)
        starts = starts[np.searchsorted(hits, starts + n) - np.searchsorted(hits, starts) >= self.common(self.size[i], n)]
        if not len(starts):
            return None
        best = None
        for part in np.array_split(starts, -(-len(starts) // 4096)):
            bags = shingles[part[:, None] + np.arange(n)[None, :]]
            fp = simhash(bags.ravel(), np.full(len(part), n))
            for j in np.flatnonzero(self.candidates(fp, np.full(len(part), i))):
                own = Counter(bags[j].tolist())
                low = sum((own & self.counters[i]).values())
                sim = low / (n + int(self.size[i]) - low)
                if sim >= self.s.similarity and (best is None or sim > best[0]):
                    best = (sim, int(part[j]))
        return best


def searched(ix: Index, batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int, int, float]]]]:
    """Slices of a batch with what ix finds in them."""
    for part in pieces(batch, column, PIECE):
        yield part, ix.search(*text_bytes(part.column(column)))


def blocks_of(benchmark: DataFrame, s: Settings) -> Iterator[Index]:
    """The benchmark in blocks of at most s.items rows and s.letters characters (one row at least), read one after the other."""
    ids, texts, n = [], [], 0
    for row in benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text")).orderBy("item_id", "text").toLocalIterator():
        if ids and (len(ids) == s.items or n + len(row[1]) > s.letters):
            yield Index(ids, texts, s)
            ids, texts, n = [], [], 0
        ids.append(row[0])
        texts.append(row[1])
        n += len(row[1])
    if ids:
        yield Index(ids, texts, s)


def matches(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, item_id, start_word, n_words, similarity: the best window for each pair of a document's row and an item that reaches the similarity.

    Documents are searched whole, in their partitions; nothing of them is shuffled. Null and empty texts match nothing, as do items without words; items
    with equal words each get their rows; repeated rows give repeated results; null ids are passed on; other columns are not read. An empty table on either
    side gives no rows. Of windows that are equally similar the earliest is told.
    """
    spark = docs.sparkSession
    ship(spark)
    schema = T.StructType([docs.schema["doc_id"], benchmark.schema["item_id"], T.StructField("start_word", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("similarity", T.DoubleType())])
    item_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    out = None
    for index in blocks_of(benchmark, s):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            worker_cache("decontamination")
            ix = shared.value
            for batch in batches:
                for part, got in searched(ix, batch, "text"):
                    found = [(d, m, a, int(ix.length[i]), sim) for d, i, a, sim in got for m in ix.members[i]]
                    if found:
                        d, m, a, n, sim = zip(*found)
                        yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(d)), pa.array(m, item_type), pa.array(a, pa.int64()), pa.array(n, pa.int64()), pa.array(sim)], schema.names)

        got = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = got if out is None else out.union(got)
    return out if out is not None else spark.createDataFrame([], schema)


def clean(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """docs' rows, with all their columns, in which no window matches any item.

    Null and empty texts stay, as do all rows if the benchmark is empty; repeated rows stay or go together; an empty table gives no rows; columns may have
    any names (but `__text`).
    """
    spark = docs.sparkSession
    ship(spark)
    columns = docs.columns
    for index in blocks_of(benchmark, s):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            worker_cache("decontamination")
            ix = shared.value
            for batch in batches:
                for part, got in searched(ix, batch, "__text"):
                    hit = np.ones(part.num_rows, bool)
                    hit[[d for d, *_ in got]] = False
                    yield part.select(columns).filter(pa.array(hit))
            give_back()

        docs = docs.select(*columns, F.col("text").alias("__text")).mapInArrow(run, docs.schema)
    return docs
