"""Many keywords in many texts: Aho-Corasick automata over shards of the keyword table.

A shard is so many different words at most, so an automaton's goto and failure tables have a bounded size whatever the table's. Each text is read once a shard. One
shard goes to the executors as it is; several meet the texts in cells (shard, chunk of texts), each of which builds its automaton once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Different words of a shard at most, about, and characters of a chunk of texts.
SHARD, CHUNK = 50_000, 1 << 25


def automaton(words: list[str]):
    from ahocorasick import Automaton

    a = Automaton()
    for i, w in enumerate(words):
        if w:
            a.add_word(w, (i, len(w), _in_word(w[0]), _in_word(w[-1])))
    a.make_automaton()
    return a


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def holds(a, text: str) -> dict[int, bool]:
    """Which words stand in the text, and whether any of its places is whole: between a word's end and something else, on both sides (as \\b tells)."""
    out: dict[int, bool] = {}
    if not len(a):
        return out
    n = len(text)
    for end, (i, size, head, tail) in a.iter(text):
        if not out.get(i):
            begin = end - size + 1
            before = begin > 0 and _in_word(text[begin - 1])
            after = end + 1 < n and _in_word(text[end + 1])
            out[i] = before != head and after != tail
    return out


def _hits(keys: pa.Array, texts: list[str | None], a) -> pa.Table:
    rows, at, whole = [], [], []
    for r, t in enumerate(texts):
        for i, w in holds(a, t or "").items():
            rows.append(r)
            at.append(i)
            whole.append(w)
    return pa.table({"key": keys.take(pa.array(rows, pa.int64())), "at": pa.array(at, pa.int64()), "whole": pa.array(whole, pa.bool_())})


def keyword_hits(texts: DataFrame, words: DataFrame, shard: int = SHARD, chunk: int = CHUNK) -> DataFrame:
    """key, tag, whole: for each text (key, text) the tags of the words (word, tags array) that it holds, and whether it holds the word whole.

    words has each word once; empty ones hit nothing. A text is a task's row, a chunk of texts is in one task.
    """
    spark = texts.sparkSession
    # Tags keep their fields' nullability, which is part of an Arrow type.
    schema = T.StructType([T.StructField("key", texts.schema["key"].dataType), T.StructField("tag", words.schema["tags"].dataType.elementType), T.StructField("whole", T.BooleanType())])
    n = words.count()
    if n <= shard:
        known = words.orderBy("word").toArrow()  # checked: one shard at most
        shared = spark.sparkContext.broadcast((known.column("word").to_pylist(), known.column("tags").combine_chunks()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            a = None
            for b in batches:
                if a is None:
                    a = automaton(shared.value[0])
                yield from _tagged(_hits(b.column("key"), b.column("text").to_pylist(), a), shared.value[1]).to_batches()

        return texts.select("key", "text").mapInArrow(run, schema)

    shards, size = -(-n // shard), texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    chunks = max(1, -(-size // chunk))
    left = texts.select("key", "text", F.pmod(F.xxhash64("key"), F.lit(chunks)).alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    right = words.select("word", "tags", F.pmod(F.xxhash64("word"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))

    def met(cell, t: pa.Table, w: pa.Table) -> pa.Table:
        return _tagged(_hits(t.column("key").combine_chunks(), t.column("text").to_pylist(), automaton(w.column("word").to_pylist())), w.column("tags").combine_chunks())

    return left.groupBy("shard", "chunk").cogroup(right.groupBy("shard", "chunk")).applyInArrow(met, schema)


def _tagged(hits: pa.Table, tags: pa.ListArray) -> pa.Table:
    """A row for each tag of each word that was hit."""
    if isinstance(tags, pa.ChunkedArray):
        tags = tags.combine_chunks()
    own = tags.take(hits.column("at").combine_chunks() if isinstance(hits.column("at"), pa.ChunkedArray) else hits.column("at"))
    again = pc.list_parent_indices(own)
    return pa.table({"key": hits.column("key").take(again), "tag": own.flatten(), "whole": hits.column("whole").take(again)})

