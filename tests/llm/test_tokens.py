"""op2 and op10 against the tokenizers library on whole texts; the store's round trip and its refusal of damage."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from quillmark.llm import automata, idstore, token_counts

from .conftest import TEXTS

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def byte_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.tokenizer_path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def word_bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_counts.tokenizer_path("word_bpe_49k.json"))


ODD = st.text(st.sampled_from(list("abstdmrevl'  \n\t 　.,!?019éÉßüΣİŉ日🎉é<|>")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(ODD, st.sampled_from(["<|endoftext|>", "a<|endoftext|> b", "<|startoftext|>don't", "it's 're'll ''s"])), min_size=1, max_size=6))
def test_texts_as_the_library(byte_bpe, word_bpe, texts):
    n = token_counts.count_texts(texts, token_counts.tokenizer_path("byte_bpe_50k.json"))
    assert n.tolist() == [len(e.ids) for e in byte_bpe.encode_batch(texts, add_special_tokens=False)]
    ids, k = idstore.encode_texts(texts, token_counts.tokenizer_path("word_bpe_49k.json"))
    assert [x.tolist() for x in np.split(ids, np.cumsum(k)[:-1])] == [e.ids for e in word_bpe.encode_batch(texts, add_special_tokens=False)]


def test_every_character_class(byte_bpe):
    """Each assigned character of the basic plane among letters, digits, marks and blanks."""
    import unicodedata

    chars = [chr(i) for i in range(0x10000) if unicodedata.category(chr(i)) not in ("Cn", "Cs", "Co")]
    texts = ["".join(f"a{c}b {c}1{c}!{c} {c}\n" for c in chars[i : i + 64]) for i in range(0, len(chars), 64)]
    got = token_counts.count_texts(texts, token_counts.tokenizer_path("byte_bpe_50k.json")).tolist()
    want = [len(e.ids) for e in byte_bpe.encode_batch(texts, add_special_tokens=False)]
    assert got == want


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from(list("ab'strevl 1.\n")), max_size=400), st.integers(1, 80))
def test_blocks_compose(text, block):
    """State maps and their scan give what one run through the whole text gives, wherever blocks are cut."""
    cls = automata.classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    nxt, marks = automata.machine(True, True)
    if not len(cls):
        return
    state, want = 0, []
    for c in cls:
        want.append(marks[c, state])
        state = nxt[c, state]
    assert automata.run(cls, nxt, marks, block, min(3, block)).tolist() == want


def test_op2(spark, docs, odd, none, byte_bpe):
    want = sorted(((i, len((t or "").encode()), len(byte_bpe.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in TEXTS), key=repr)
    for d in (docs, odd):
        got = token_counts.token_counts(d).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=repr) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.token_counts(none).count() == 0
    d = spark.read.parquet(f"{AT}/documents.parquet")
    texts = {r.doc_id: r.text for r in d.collect()}
    assert all(r.n_tokens == len(byte_bpe.encode(texts[r.doc_id], add_special_tokens=False).ids) for r in token_counts.token_counts(d).collect())


def digest(rows, tok):
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return sorted(out, key=repr)


def test_op10(spark, docs, odd, none, word_bpe):
    want = digest([(i, t) for i, t, _ in TEXTS], word_bpe)
    for d in (docs, odd):
        assert sorted(map(tuple, idstore.ids_digest(d).collect()), key=repr) == want
    assert idstore.ids_digest(none).count() == 0
    d = spark.read.parquet(f"{AT}/documents.parquet")
    assert sorted(map(tuple, idstore.ids_digest(d).collect()), key=repr) == digest([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()], word_bpe)


def test_store_round_trip_and_damage(spark, docs, word_bpe, tmp_path):
    at = f"file://{tmp_path}/store"
    store = idstore.write_store(docs, at)
    want = sorted(((i, word_bpe.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, _ in TEXTS), key=repr)
    assert sorted(((r.doc_id, list(r.ids)) for r in idstore.read_ids(spark, store).collect()), key=repr) == want
    chunks = spark.read.parquet(f"{at}/chunks")
    # 9 and 10 hold the same long passage: its chunks are stored once.
    assert chunks.agg(F.sum(F.length("ids"))).first()[0] < 2 * sum(len(x) for _, x in want) * 0.7
    bad = idstore.Store(f"file://{tmp_path}/bad", 2)
    chunks.withColumn("ids", F.when(F.col("address") == F.lit(chunks.agg(F.min("address")).first()[0]), F.lit(b"\1\0")).otherwise(F.col("ids"))).write.parquet(f"{bad.path}/chunks")
    for t in ("recipes", "manifest"):
        spark.read.parquet(f"{at}/{t}").write.parquet(f"{bad.path}/{t}")
    with pytest.raises(PythonException, match="damaged"):
        idstore.read_digest(spark, bad).collect()
    worse = idstore.Store(f"file://{tmp_path}/worse", 2)
    for t in ("chunks", "manifest"):
        spark.read.parquet(f"{at}/{t}").write.parquet(f"{worse.path}/{t}")
    spark.read.parquet(f"{at}/recipes").withColumn("n_tokens", F.col("n_tokens") + 1).write.parquet(f"{worse.path}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        idstore.read_digest(spark, worse)


def test_store_without_a_shard(spark, docs, none, tmp_path):
    store = idstore.write_store(docs, f"file://{tmp_path}/store")
    tables = {t: spark.read.parquet(f"{store.path}/{t}") for t in ("chunks", "recipes", "manifest")}
    root = tables["manifest"].filter("shard IS NULL").collect()
    assert [(r.n_docs, r.n_tokens) for r in root] == [tuple(tables["recipes"].selectExpr("count(*)", "sum(n_tokens)").first())]
    shards = sorted(r.shard for r in tables["recipes"].select("shard").distinct().collect())
    assert len(shards) > 1
    for gone in (shards[0], shards[-1], "root"):
        less = idstore.Store(f"file://{tmp_path}/less-{gone}", 2)
        for t, df in tables.items():
            keep = "true" if t == "chunks" or (gone == "root" and t == "recipes") else "shard IS NOT NULL" if gone == "root" else f"NOT shard <=> {gone}"
            df.filter(keep).write.parquet(f"{less.path}/{t}")
        with pytest.raises(ValueError, match="root"):
            idstore.read_digest(spark, less)
    empty = idstore.write_store(none, f"file://{tmp_path}/empty")
    assert idstore.read_digest(spark, empty).count() == 0 and idstore.read_digest(spark, store).count() == len(TEXTS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=6), st.integers(0, 9))
def test_cuts(counts, seed):
    ids = np.random.default_rng(seed).integers(0, 50, sum(counts)).astype(np.uint32)
    ends, per_doc = idstore.cut_points(ids, np.array(counts, np.int64))
    begins = np.concatenate([[0], ends[:-1]])
    assert per_doc.sum() == len(ends) and (not counts or ends[-1:].tolist() == ([sum(counts)] if sum(counts) else []))
    sizes = ends - begins
    last = set(np.cumsum(counts).tolist())
    assert all(s <= idstore.MOST and (s >= idstore.LEAST or e in last) for s, e in zip(sizes.tolist(), ends.tolist()))


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300), st.binary(max_size=300))
def test_crc_parts(a, b):
    part = idstore.crc_shift(np.array([zlib.crc32(a)]), np.array([len(b)]))[0]
    assert int(part) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_words_that_one_hash_cannot_tell_apart(spark, byte_bpe, word_bpe):
    """A Thue-Morse word and its complement have one value under every polynomial hash modulo a power of two with an odd base."""
    for a, b in ("eq", "zt", "ab"):
        word = a
        while len(word) < 2048:
            word += word.translate(str.maketrans(a + b, b + a))
        texts = [word, word.translate(str.maketrans(a + b, b + a))]
        for t in (texts, texts[::-1]):
            n = token_counts.count_texts(t, token_counts.tokenizer_path("byte_bpe_50k.json"))
            assert n.tolist() == [len(e.ids) for e in byte_bpe.encode_batch(t, add_special_tokens=False)]
            ids, k = idstore.encode_texts(t, token_counts.tokenizer_path("word_bpe_49k.json"))
            assert [x.tolist() for x in np.split(ids, np.cumsum(k)[:-1])] == [e.ids for e in word_bpe.encode_batch(t, add_special_tokens=False)]
        d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
        assert sorted(map(tuple, idstore.ids_digest(d).collect())) == digest(list(enumerate(texts)), word_bpe)


def test_a_small_memory_forgets_and_still_counts(byte_bpe, word_bpe):
    texts = [f"word{i} and{i % 7}, don't {'x' * (i % 40)}!" for i in range(300)]
    pre = automata.PreTokenizer(keep_spaces=True, long_numbers=True)
    for lexicon in (automata.Lexicon(token_counts.tokenizer_path("byte_bpe_50k.json"), ids=False, most=20), automata.Lexicon(token_counts.tokenizer_path("byte_bpe_50k.json"), ids=False, room=100)):
        assert [int(pre.counts([t], lexicon)[0]) for t in texts] == [len(e.ids) for e in byte_bpe.encode_batch(texts, add_special_tokens=False)]


def test_ids_beyond_the_width_are_an_error(spark, docs, tmp_path):
    with pytest.raises(PythonException, match="doesn't fit"):
        idstore.write_store(docs, f"file://{tmp_path}/wide", end_id=70_000)
    store = idstore.write_store(docs, f"file://{tmp_path}/wider", end_id=70_000, width=4)
    assert {r.ids[-1] for r in idstore.read_ids(spark, store).collect()} == {70_000}
