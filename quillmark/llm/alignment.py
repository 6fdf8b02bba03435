"""Cross-tokenizer alignment: two tokenizers' tokens of one text, in the smallest groups that cover the same bytes.

Tokens of a text lie end to end, so tokenizer B's are a static interval index: two sorted arrays of begins and ends. Each token of A stabs it by bisection
and gets the run of B's tokens that it overlaps. A gap between two tokens of A that no token of B spans (the runs on either side share none) is a group's
boundary. The last tokens of a group end together: that pair of ids is a link.

How often a pair is linked in the whole corpus is a table that no corpus can make large. Two tokens that end together are one the other's suffix, so there are
at most as many pairs as such pairs of vocabulary entries (`linkable`, some hundred thousand): that table is checked against this bound and broadcast.
Documents are encoded once; their distinct pairs are written beside the digest, and a second pass looks the counts up. Nothing but pairs' counts is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .automata import Lexicon, PreTokenizer
from .frames import give_back, materialize, pieces, ship, worker_cache
from .kernels import gather
from .token_counts import tokenizer_path

A_NAME, B_NAME = "byte_bpe_50k.json", "piece_bpe_32k.model"
_MARK = "▁"


def byte_level() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as the characters from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pieces(Lexicon):
    """A sentencepiece model over units: a run of spaces and what follows it up to the next space. No piece has a space after another character, so nothing is
    merged across a unit's beginning. The model adds one space to a text, which is a unit's first."""

    def __init__(self, path: str, most: int = 500_000, room: int = 1 << 24):
        from sentencepiece import SentencePieceProcessor

        self.model, self.ids, self.most, self.room, self.marked = SentencePieceProcessor(model_file=path), True, most, room, False
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.apart = not any(_MARK in p.lstrip(_MARK) for p in names)
        self.blank = [self.model.piece_to_id(_MARK)]
        self.forget()

    def emit(self, words: list[str], simple: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [x or self.blank for x in self.model.encode([w[1:] for w in words], num_threads=1)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.concatenate([np.array(x, np.uint32) for x in found]), n


class Vocabulary:
    """The bytes of each id's token: their lengths, and all end to end."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        return gather(self.pool, self.starts[ids], self.length[ids])


def _told(n: int, marks: bytes) -> list[list[bytes]]:
    return [[b"%d%c" % (i, m) for i in range(n)] for m in marks]


class Tokenizers:
    """Both tokenizers, with their tokens' bytes."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.b, self.pre = Lexicon(path_a, ids=True), Pieces(path_b), PreTokenizer(keep_spaces=True, long_numbers=True)
        self.a.tokenizer.encode_special_tokens = True
        byte_of, entries = byte_level(), self.a.tokenizer.get_vocab()
        tokens = [b""] * (max(entries.values()) + 1)
        for t, i in entries.items():
            tokens[i] = bytes(map(byte_of.__getitem__, t)) if all(c in byte_of for c in t) else t.encode()
        m = self.b.model
        names = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        told = [bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace(_MARK, " ").encode() for i, p in enumerate(names)]
        self.of_a, self.of_b = Vocabulary(tokens), Vocabulary(told)

    @cached_property
    def written(self) -> list[bytes]:
        """How ids are written in a group: A's before a comma, then before a bar, B's before a comma, then before a semicolon."""
        a, b = _told(len(self.of_a.tokens), b",|"), _told(len(self.of_b.tokens), b",;")
        return a[0] + a[1] + b[0] + b[1]


@dataclass(frozen=True)
class Aligned:
    """Both tokenizers' ids of some texts, end to end. n_a, n_b, n_groups: how many each text has; last_a, last_b: the index of each group's last token."""

    a: np.ndarray
    b: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    last_a: np.ndarray
    last_b: np.ndarray


def linkable(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of tokens can end together: one is the other's suffix."""
    in_a, in_b = Counter(a), Counter(b)
    return sum(in_b[t[k:]] for t in a for k in range(len(t))) + sum(in_a[t[k:]] for t in b for k in range(1, len(t)))


def boundaries(a_begin: np.ndarray, a_end: np.ndarray, b_begin: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of each group's last interval of A, of B) for two sorted sequences of intervals, each without gaps or empty ones, over the same range."""
    first = np.searchsorted(b_end, a_begin, "right")
    last = np.searchsorted(b_begin, a_end, "left") - 1
    cut = np.flatnonzero(np.append(last[:-1] < first[1:], True)) if len(a_end) else np.zeros(0, np.int64)
    return cut, last[cut]


def _encode(lexicon: Lexicon, raw: bytes, starts: np.ndarray, ends: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    slot = lexicon.slots(raw, starts, ends)
    counts = lexicon.counts[slot].astype(np.int64)
    return gather(lexicon.pool, lexicon.starts[slot], counts), np.bincount(text, counts, n).astype(np.int64)


def align(texts: list[str | None], t: Tokenizers) -> Aligned:
    """Texts that are null, empty, or that not both tokenizers give back, byte for byte, have no tokens."""
    n = len(texts)
    some = np.array([bool(x) and _MARK not in x for x in texts], bool)  # B reads U+2581 as a space, so such a text never comes back
    zero = np.zeros(n, np.int64)
    if not some.any():
        none = np.zeros(0, np.int64)
        return Aligned(none, none, zero, zero, zero, none, none)
    joined, starts, ends, text = t.pre.spans([" " + x for x, s in zip(texts, some) if s])
    raw = joined.encode()
    data = np.frombuffer(raw, np.uint8)
    if len(raw) > len(joined):
        place = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(raw))
        starts, ends = place[starts], place[ends]
    size = np.fromiter((1 + len(x.encode()) for x, s in zip(texts, some) if s), np.int64)
    stop = np.cumsum(size + 1) - 1  # a text's end; its separator is here
    begin = stop - size
    a, n_a = _encode(t.a, raw, starts, ends, text, len(size))
    space = data == 0x20
    space[1:] &= data[:-1] != 0x20
    space[begin] = True
    unit = np.flatnonzero(space) if t.b.apart else begin
    unit_text = np.searchsorted(stop, unit)
    unit_end = np.minimum(np.append(unit[1:], len(raw)), stop[unit_text])
    b, n_b = _encode(t.b, raw, unit, unit_end, unit_text, len(size))
    keep = np.ones(len(data), bool)
    keep[stop] = False
    data = data[keep]
    # Lengths first, then all bytes of texts whose lengths are right.
    of_a, of_b = np.repeat(np.arange(len(size)), n_a), np.repeat(np.arange(len(size)), n_b)
    same = (np.bincount(of_a, t.of_a.length[a], len(size)) == size) & (np.bincount(of_b, t.of_b.length[b], len(size)) == size)
    right = data[np.repeat(same, size)]
    wrong = (t.of_a.bytes_of(a[same[of_a]]) != right) | (t.of_b.bytes_of(b[same[of_b]]) != right)
    if wrong.any():
        same[np.repeat(np.flatnonzero(same), size[same])[wrong]] = False
    a, b, n_a, n_b = a[same[of_a]].astype(np.int64), b[same[of_b]].astype(np.int64), n_a * same, n_b * same
    a_end, b_end = np.cumsum(t.of_a.length[a]), np.cumsum(t.of_b.length[b])
    last_a, last_b = boundaries(a_end - t.of_a.length[a], a_end, b_end - t.of_b.length[b], b_end)
    groups = np.bincount(np.repeat(np.arange(len(size)), n_a)[last_a], minlength=len(size)).astype(np.int64)

    def wide(x: np.ndarray) -> np.ndarray:
        out = zero.copy()
        out[some] = x
        return out

    return Aligned(a, b, wide(n_a), wide(n_b), wide(groups), last_a, last_b)


def written_groups(x: Aligned, t: Tokenizers) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` for each text."""
    ends_a, ends_b = np.zeros(len(x.a), bool), np.zeros(len(x.b), bool)
    ends_a[x.last_a], ends_b[x.last_b] = True, True
    group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
    size_a, size_b = len(t.of_a.tokens), len(t.of_b.tokens)
    code = np.zeros(len(x.a) + len(x.b), np.int64)
    code[np.arange(len(x.a)) + np.concatenate([[0], x.last_b + 1])[group_a]] = x.a + size_a * ends_a
    code[np.arange(len(x.b)) + (x.last_a + 1)[group_b]] = 2 * size_a + x.b + size_b * ends_b
    stop = np.cumsum(x.n_a + x.n_b)
    return [b"".join(map(t.written.__getitem__, code[i:j].tolist()))[:-1] for i, j in zip((stop - x.n_a - x.n_b).tolist(), stop.tolist())]


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    made = worker_cache("alignment")
    if (path_a, path_b) not in made:
        made[path_a, path_b] = Tokenizers(path_a, path_b)
    return made[path_a, path_b]


def _paths(path_a: str | None, path_b: str | None) -> tuple[str, str]:
    return path_a or tokenizer_path(A_NAME), path_b or tokenizer_path(B_NAME)


def _each_piece(docs: DataFrame, paths: tuple[str | None, str | None], make, schema: str, most: int = 1 << 20) -> DataFrame:
    """make(rows of docs, Aligned, Tokenizers) for pieces of about `most` bytes of text, in docs' partitions."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(*_paths(*paths))
        for batch in batches:
            for part in pieces(batch, "text", most):
                yield make(part, align(part.column("text").to_pylist(), t), t)
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def alignments(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, a, b (ids in order), a_ends, b_ends (for each group, how many of a and b it and those before it hold): one row for each of docs' rows.

    Null and empty texts, and those that not both tokenizers give back, have empty arrays. Repeated rows and null doc_ids are rows like any other; other
    columns are not read; an empty table gives no rows. Paths are those of the vocabularies on the executors; by default each finds its own.
    """

    def lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.astype(np.int32)))

    def make(part: pa.RecordBatch, x: Aligned, t: Tokenizers) -> pa.RecordBatch:
        before_a, before_b = (np.repeat(np.cumsum(k) - k, x.n_groups) for k in (x.n_a, x.n_b))
        columns = [part.column("doc_id"), lists(x.a, x.n_a), lists(x.b, x.n_b), lists(x.last_a + 1 - before_a, x.n_groups), lists(x.last_b + 1 - before_b, x.n_groups)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "a", "b", "a_ends", "b_ends"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _each_piece(docs, (path_a, path_b), make, f"doc_id {kind}, a array<int>, b array<int>, a_ends array<int>, b_ends array<int>")


def linked(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs (distinct, ascending; (A id << 32) + B id) and times (links of each pair): a row a document."""

    def make(part: pa.RecordBatch, x: Aligned, t: Tokenizers) -> pa.RecordBatch:
        doc = np.repeat(np.arange(part.num_rows), x.n_groups)
        pair = (x.a[x.last_a] << 32) + x.b[x.last_b]
        order = np.lexsort((pair, doc))
        doc, pair = doc[order], pair[order]
        new = np.append(True, (doc[1:] != doc[:-1]) | (pair[1:] != pair[:-1])) if len(doc) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(doc)))
        offsets = pa.array(np.searchsorted(doc[first], np.arange(part.num_rows + 1)).astype(np.int32))
        digest = [sha256(w).hexdigest() if n else "" for w, n in zip(written_groups(x, t), x.n_groups.tolist())]
        columns = [part.column("doc_id"), *map(pa.array, (x.n_a, x.n_b, x.n_groups, x.n_groups, digest))]
        columns += [pa.ListArray.from_arrays(offsets, pa.array(pair[first])), pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32)))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
    return _each_piece(docs, (path_a, path_b), make, schema)


def pair_counts(rows: DataFrame) -> DataFrame:
    """pair, a, b, links (of the corpus), best: whether no other pair with this b has more. rows: pairs and times, as linked() has them."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "times")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("links"))
    told = each.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), "links")
    return told.withColumn("best", F.col("links") == F.max("links").over(Window.partitionBy("b")))


def alignment_digest(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row for each of docs' rows; cases as in alignments().

    Texts without tokens have zeros and an empty groups_sha256; so has every row if the corpus has no link at all.
    """
    spark = docs.sparkSession
    rows = materialize(linked(docs, path_a, path_b), "alignment")
    known = materialize(pair_counts(rows), "alignment-pairs")
    both = Tokenizers(*_paths(path_a, path_b))
    n, most = known.count(), linkable(both.of_a.tokens, both.of_b.tokens)
    if n > most:
        raise ValueError(f"{n} linked pairs, though only {most} pairs of tokens can end together")
    table = known.select("pair", "links", "best").toArrow().sort_by("pair")
    shared = spark.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "links", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, links, best = shared.value
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy().astype(np.int64)
            at = np.searchsorted(pair, pairs.flatten().to_numpy())
            ends = pairs.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            sums = [np.diff(np.concatenate([[0], np.cumsum(v)])[ends]) for v in (times * best[at], times * links[at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *map(pa.array, sums), batch.column("groups_sha256")], [*keep, "n_best", "count_sum", "groups_sha256"])

    keep = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
