"""Token ids in a content-addressed store.

A rolling hash over the last WINDOW ids cuts a document's id stream into chunks wherever it says so, so equal passages give equal chunks whatever stands
before them. The store is a folder of three Parquet tables:

  chunks/    address (16 bytes, BLAKE2b of the ids), ids (little-endian, `width` bytes each): each content once
  recipes/   shard, doc_id, n_tokens, addresses (16 bytes a chunk), sizes (uint32 a chunk): a document a row, in ascending doc_id order, null first
  manifest/  shard, block, n_docs, n_tokens, node: a Merkle node over the leaves of up to BLOCK documents; the row without a shard is the root, which
             hashes the nodes in order, with all documents and ids counted

A reader takes documents from recipes, ids from chunks, and recomputes every address, every node and the root.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .frames import binary_array, materialize, pieces, shared_dir, ship, text_bytes, worker_cache
from .kernels import gather, prefix_sums, span_hashes, word_spans
from .token_counts import tokenizer_path

WINDOW = 16
LEAST, USUAL, MOST = 64, 256, 2048
BLOCK = 1024
ADDRESS = 16


@dataclass(frozen=True)
class Store:
    path: str
    width: int


def encoder(path: str):
    """The lexicon of words with their ids; one a Python worker."""
    from .automata import Lexicon

    made = worker_cache("idstore")
    if path not in made:
        made[path] = Lexicon(path, ids=True, marked=True)
    return made[path]


def encode_bytes(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids end to end, number of each text), as the library's encode(text, add_special_tokens=False) has them, of UTF-8 texts end to end.

    This tokenizer's normaliser and pre-tokenizer take each blank for a border: nothing composes, folds or joins across it, and special strings hold none. So
    a text's ids are those of its words, and each distinct word is encoded by the library once. A-Z are folded beforehand where no special string can be.
    """
    lexicon = encoder(path)
    raw = data.tobytes()
    if b"<|" not in raw:
        raw = raw.lower()
    starts, ends, first = word_spans(data, offsets)
    slot = lexicon.slots(raw, starts, ends)
    n = lexicon.counts[slot].astype(np.int64)
    return gather(lexicon.pool, lexicon.starts[slot], n), np.diff(np.concatenate([[0], np.cumsum(n)])[first])


def encode_texts(texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    return encode_bytes(*text_bytes(pa.array(texts, pa.large_string())), path)


def cut_points(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(end of each chunk, chunks of each document). A chunk has LEAST to MOST ids, but a document's last may be shorter; none spans two documents."""
    ends = np.cumsum(counts)
    says = np.zeros(0, np.int64)
    if len(ids) > WINDOW:
        s = prefix_sums(ids)
        at = np.arange(WINDOW, len(ids) + 1)
        h = span_hashes(s, at - WINDOW, at)
        says = at[(h >> np.uint64(40)) % np.uint64(USUAL - LEAST) == 0]  # a chunk may end after these many ids
    out, per_doc = [], np.zeros(len(counts), np.int64)
    says_list, k, begin = says.tolist(), 0, 0
    for d, end in enumerate(ends.tolist()):
        last = begin
        before = len(out)
        while k < len(says_list) and says_list[k] <= begin:
            k += 1
        while k < len(says_list) and says_list[k] < end:
            p = says_list[k]
            while p - last > MOST:
                last += MOST
                out.append(last)
            if p - last >= LEAST:
                out.append(p)
                last = p
            k += 1
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end > last:
            out.append(end)
        per_doc[d] = len(out) - before
        begin = end
    return np.array(out, np.int64), per_doc


def _stage(docs: DataFrame, path: str | None, name: str, end_id: int, width: int) -> DataFrame:
    """Rows of two kinds: recipes (doc_id, n_tokens, addresses, sizes) and chunks (address, ids), each content once a batch."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = path or tokenizer_path(name)
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                ids, n = encode_bytes(*text_bytes(part.column("text")), file)
                ids = np.insert(ids, np.cumsum(n), end_id)
                n = n + 1
                if int(ids.max()) >> 8 * width:
                    raise ValueError(f"id {int(ids.max())} doesn't fit {width} bytes")
                raw = ids.astype(f"<u{width}").tobytes()
                ends, chunks = cut_points(ids, n)
                begins = np.concatenate([[0], ends[:-1]])
                bounds = list(zip((begins * width).tolist(), (ends * width).tolist()))
                address = [hashlib.blake2b(raw[a:b], digest_size=ADDRESS).digest() for a, b in bounds]
                own: dict[bytes, int] = {}
                for i, x in enumerate(address):
                    own.setdefault(x, i)
                first = list(own.values())
                chunk_ids = [raw[bounds[i][0] : bounds[i][1]] for i in first]
                of_doc = np.concatenate([[0], np.cumsum(chunks)])
                recipe = binary_array(np.frombuffer(b"".join(address), np.uint8), of_doc * ADDRESS)
                sizes = binary_array(np.frombuffer((ends - begins).astype("<u4").tobytes(), np.uint8), of_doc * 4)
                none = len(first)
                k = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([True, False], [k, none])),
                        pa.concat_arrays([part.column("doc_id"), pa.nulls(none, part.column("doc_id").type)]),
                        pa.concat_arrays([pa.array(n), pa.nulls(none, pa.int64())]),
                        pa.concat_arrays([recipe, pa.nulls(none, pa.binary())]),
                        pa.concat_arrays([sizes, pa.nulls(none, pa.binary())]),
                        pa.concat_arrays([pa.nulls(k, pa.binary()), pa.array([address[i] for i in first], pa.binary())]),
                        pa.concat_arrays([pa.nulls(k, pa.binary()), pa.array(chunk_ids, pa.binary())]),
                    ],
                    ["recipe", "doc_id", "n_tokens", "addresses", "sizes", "address", "ids"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"recipe boolean, doc_id {kind}, n_tokens long, addresses binary, sizes binary, address binary, ids binary")


def _nodes(recipes: DataFrame) -> DataFrame:
    """shard, block, n_docs, n_tokens, node: blocks are of neighbours within a shard, in doc_id order."""
    w = Window.partitionBy("shard").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens", "addresses")
    leaf = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("n_tokens"), F.lit(":"), F.hex("addresses"), F.lit(":"), F.hex("sizes")), 256)
    rows = recipes.select("shard", "n_tokens", F.row_number().over(w).alias("rn"), leaf.alias("leaf")).withColumn("block", F.floor((F.col("rn") - 1) / BLOCK))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "leaf"))), lambda x: x["leaf"]), "")
    return rows.groupBy("shard", "block").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.sha2(joined, 256).alias("node"))


def _root(nodes: DataFrame) -> DataFrame:
    """One row like a node's, without shard and block: nodes hash to one a shard in order of blocks, these to the root in order of shards, all with counts."""

    def folded(by: str) -> tuple:
        leaf = F.concat_ws(":", by, "n_docs", "n_tokens", "node").alias("leaf")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(by), leaf))), lambda x: x["leaf"]), ",")
        total = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_docs", "n_tokens")]
        return (*total, F.sha2(joined, 256).alias("node"))

    root = nodes.groupBy("shard").agg(*folded("block"))
    root = root.agg(*folded("shard"))
    return root.select(*(F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in ("shard", "block")), "n_docs", "n_tokens", "node")


def write_store(docs: DataFrame, at: str, path: str | None = None, name: str = "word_bpe_49k.json", end_id: int = 1, width: int = 2) -> Store:
    """Encode every whole text (null: empty), append end_id, and write the store under the folder `at`. width: bytes an id, 2 or 4; an id beyond
    it is an error.

    Repeated rows and null doc_ids have recipes of their own; other columns are not read; an empty table makes an empty store.
    """
    staged = materialize(_stage(docs, path, name, end_id, width), "idstore-staged")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = staged.filter(~F.col("recipe")).groupBy("address").agg(F.first("ids").alias("ids"))
    chunks.write.option("compression", "zstd").parquet(f"{at}/chunks")
    recipes = staged.filter("recipe").select("doc_id", "n_tokens", "addresses", "sizes")
    recipes = recipes.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), F.xxhash64("addresses")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "addresses")
    recipes.select(F.spark_partition_id().alias("shard"), "*").write.option("compression", "zstd").parquet(f"{at}/recipes")
    nodes = materialize(_nodes(docs.sparkSession.read.parquet(f"{at}/recipes")), "idstore-nodes")
    nodes.unionByName(_root(nodes)).write.parquet(f"{at}/manifest")
    return Store(at, width)


def read_chunks(spark: SparkSession, store: Store) -> DataFrame:
    """address, n_ids, crc (of the ids as little-endian uint32), in full from the files; an address that doesn't fit its ids is an error."""
    ship(spark)
    width = store.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc, n = [], []
            for address, raw in zip(b.column("address").to_pylist(), b.column("ids").to_pylist()):
                if hashlib.blake2b(raw, digest_size=ADDRESS).digest() != address:
                    raise ValueError(f"chunk {address.hex()} is damaged")
                crc.append(zlib.crc32(np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()))
                n.append(len(raw) // width)
            yield pa.RecordBatch.from_arrays([b.column("address"), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["address", "n_ids", "crc"])

    return spark.read.parquet(f"{store.path}/chunks").mapInArrow(run, "address binary, n_ids long, crc long")


def crc_shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The part of a CRC-32 that a piece with this crc has when n bytes follow it."""
    crc = crc.astype(np.uint32).copy()
    power = _byte_step()
    n = n.astype(np.int64).copy()
    while n.any():
        odd = np.flatnonzero(n & 1)
        crc[odd] = _apply(power, crc[odd])
        power = _apply(power, power)
        n >>= 1
    return crc


def _byte_step() -> np.ndarray:
    """The 32 images of single bits when one zero byte follows."""
    m = np.array([1 << i for i in range(32)], np.uint32)
    for _ in range(8):
        m = (m >> np.uint32(1)) ^ np.where(m & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return m


def _apply(m: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.uint32)
    for i in range(32):
        out ^= np.where((x >> np.uint32(i)) & np.uint32(1), m[i], np.uint32(0))
    return out


def _postings(recipes: DataFrame) -> DataFrame:
    """rid, address, n, after (ids after the chunk in its document): a row for each chunk of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, addresses, n, after = [], [], [], []
            for r, a, s in zip(b.column("rid").to_pylist(), b.column("addresses").to_pylist(), b.column("sizes").to_pylist()):
                sizes = np.frombuffer(s, "<u4").astype(np.int64)
                rid.append(np.full(len(sizes), r))
                addresses.append(a)
                n.append(sizes)
                after.append(sizes.sum() - np.cumsum(sizes))
            if rid:
                raw = np.frombuffer(b"".join(addresses), np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(rid), pa.int64()), binary_array(raw, np.arange(0, len(raw) + 1, ADDRESS)), pa.array(np.concatenate(n)), pa.array(np.concatenate(after))], ["rid", "address", "n", "after"])

    return recipes.select("rid", "addresses", "sizes").mapInArrow(run, "rid long, address binary, n long, after long")


def read_digest(spark: SparkSession, store: Store) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone.

    A document's CRC is the xor of its chunks' CRCs, each shifted by the ids after it, so that chunks travel as 40 bytes and no document is put together
    in one place. Recipes that don't fit the manifest, nodes that don't fit its root, or chunks that are missing, are errors.
    """
    ship(spark)
    recipes = spark.read.parquet(f"{store.path}/recipes")
    manifest = spark.read.parquet(f"{store.path}/manifest")
    nodes = manifest.filter("shard IS NOT NULL")
    wrong = nodes.join(_nodes(recipes).select("shard", "block", F.col("node").alias("again")), ["shard", "block"], "full").filter(~F.col("node").eqNullSafe(F.col("again"))).count()
    if wrong:
        raise ValueError(f"{wrong} blocks of recipes don't fit the manifest")
    if manifest.filter("shard IS NULL").take(2) != _root(nodes).take(1):
        raise ValueError("the manifest's blocks don't fit its root")
    order = Window.partitionBy("shard").orderBy(F.col("doc_id").asc_nulls_first(), "n_tokens", "addresses")
    place = recipes.withColumn("rn", F.row_number().over(order)).withColumn("within", F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    # A shard's offset: one row a shard, summed over the shards before it.
    shards = recipes.groupBy("shard").agg(F.sum("n_tokens").alias("t")).withColumn("base", F.coalesce(F.sum("t").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("t")
    place = place.withColumn("rid", F.shiftleft(F.col("shard").cast("long"), 40) + F.col("rn")).join(shards, "shard")
    place = materialize(place.select("rid", "doc_id", (F.col("base") + F.coalesce("within", F.lit(0))).alias("start"), "n_tokens", "addresses", "sizes"), "idstore-places")

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crc = crc_shift(b.column("crc").to_numpy(), b.column("after").to_numpy() * 4)
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("n_ids"), pa.array(crc.astype(np.int64))], ["rid", "n_ids", "part"])

    joined = _postings(place).join(read_chunks(spark, store), "address", "left")
    joined = joined.withColumn("n_ids", F.when(F.col("n_ids") == F.col("n"), F.col("n_ids")).otherwise(F.raise_error(F.lit("a recipe's chunk is missing or has another length"))))
    sums = joined.select("rid", "n_ids", "crc", "after").mapInArrow(shift, "rid long, n_ids long, part long").groupBy("rid").agg(F.bit_xor("part").alias("ids_crc32"), F.sum("n_ids").alias("read"))
    return place.join(sums, "rid").select("doc_id", "start", F.col("read").alias("n_tokens"), "ids_crc32")


def read_ids(spark: SparkSession, store: Store) -> DataFrame:
    """doc_id, ids array<long>: documents put together again. Each stored row, with a null or repeated doc_id too, is a row; an empty store gives none."""
    ship(spark)
    width = store.width
    recipes = spark.read.parquet(f"{store.path}/recipes").withColumn("rid", F.monotonically_increasing_id())
    recipes = materialize(recipes, "idstore-recipes")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(b"".join(x["ids"] for x in parts), f"<u{width}").astype(np.int64) for parts in b.column("parts").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(ids, pa.list_(pa.int64()))], ["rid", "ids"])

    parts = _postings(recipes).join(spark.read.parquet(f"{store.path}/chunks"), "address").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct((-F.col("after")).alias("at"), "ids"))).alias("parts"))
    return recipes.join(parts.mapInArrow(decode, "rid long, ids array<long>"), "rid").select("doc_id", "ids")


def ids_digest(docs: DataFrame, path: str | None = None, name: str = "word_bpe_49k.json") -> DataFrame:
    """Write the documents' ids to a new store in the shared folder and return what reading it gives."""
    spark = docs.sparkSession
    store = write_store(docs, f"{shared_dir(spark)}/idstore-{uuid.uuid4().hex}", path, name)
    return read_digest(spark, store)
