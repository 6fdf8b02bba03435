"""Filter interaction audit, nearest neighbours and cross-tokenizer alignment, against plain loops."""

import hashlib
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import alignment, audit, neighbours, queries
from quillmark.llm.oracles import OP11

AT = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- op11 ---
def audited(docs, labels):
    """Every order walked over the rows themselves."""
    good, toxic = {i for i, q, _ in labels if q == 1} - {None}, {i for i, _, t in labels if t == 1} - {None}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    rows = []
    for i, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {f for f, x in zip("ABCDE", [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t]]) if x}
        rows.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own, shapley = [r for r in rows if r[0] == part], Counter()
        for o in permutations("ABCDE"):
            left = own
            for k, f in enumerate(o):
                gone = [r for r in left if f in r[1]]
                early = sum(f in r[1] for r in own) - len(gone)
                left = [r for r in left if f not in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(o), k + 1] = [len(left), len(gone), early, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for key in out:
            if key[0] == part:
                out[key].append(shapley[key[1][key[2] - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audit_rows(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


def test_audit_by_walking_all_orders(spark):
    long = " ".join(f"w{i}" for i in range(120))
    docs = [(1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long + " $", None), (4, "A" * 30, "en"), (5, None, ""), (6, "", "de"), (None, long, "en"), (None, "x # y", None), (7, "a " * 150, "de"), (8, "B & C " * 60, "en")]
    labels = [(1, 1, 0), (2, 1, 0), (2, 0, 1), (4, None, 1), (None, 1, 1), (6, 1, None), (99, 1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("part", F.lit("own")).withColumn("A", F.lit(3)).withColumn("digest", F.lit("x"))
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("own"))
    got = audit_rows(audit.audit(d, y))
    assert len(got) == 600 * 3 and got == audited(docs, labels)
    assert audit.audit(d.limit(0), y).collect() == []
    assert audit_rows(audit.audit(d, y.limit(0))) == audited(docs, [])


def test_audit_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    want = con.execute(OP11).df()
    df = queries.op11_filter_audit(spark, AT)
    got = df.toPandas()
    key = ["part", "filter_order", "step"]
    assert got.sort_values(key)[df.columns].values.tolist() == want.sort_values(key)[df.columns].values.tolist()


def test_survivors_of_all_parts_together(spark):
    rows = audit.flags(spark.read.parquet(f"{AT}/documents.parquet"), spark.read.parquet(f"{AT}/labels.parquet"))
    s = audit.survivors(rows).collect()
    for chosen in {r["chosen"] for r in s}:
        whole = [r for r in s if r["chosen"] == chosen and r["part"] is None]
        assert len(whole) == 1 and whole[0]["n"] == sum(r["n"] for r in s if r["chosen"] == chosen and r["part"] is not None)


def test_audit_of_one_hot_text_and_label(spark):
    d = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.col("id")).alias("doc_id"), F.lit("same text").alias("text"), F.lit("en").alias("lang"))
    y = spark.range(10).select((F.col("id") * 10).alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    docs, labels = [(r["doc_id"], r["text"], r["lang"]) for r in d.collect()], [tuple(r) for r in y.collect()]
    assert audit_rows(audit.audit(d, y)) == audited(docs, labels)


# --- op12 ---
def nearest(rows, queries_, k=10):
    """All candidates measured."""
    rows = sorted(set(rows))
    out = {}
    for i, v in sorted(set(queries_)):
        near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in rows if (j, w) != (i, v))
        out[i] = [(r + 1, j, d) for r, (d, j) in enumerate(near[:k])]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    return out


def same(got, want):
    assert got.keys() == {k for k, v in want.items() if v}
    for q in got:
        assert [x[:2] for x in got[q]] == [x[:2] for x in want[q]]
        assert [x[2] for x in got[q]] == pytest.approx([x[2] for x in want[q]], abs=1e-12)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("part", F.lit("own")).withColumn("key", F.lit(0)).withColumn("v", F.lit("x"))


def test_neighbours_with_every_odd_row(spark):
    rng = np.random.default_rng(1)
    plain = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(300)]
    plain = [(i, v if any(v) else [1.0, 0.0, 0.0, 0.0]) for i, v in plain]
    odd = [(500, None), (600, [0.0] * 4), (700, [1.0, None, 0.0, 0.0]), (800, [float("nan")] * 4), (900, [float("inf"), 0.0, 0.0, 1.0]), (1000, [1.0, 2.0]), (1100, []), (None, [1.0, 1.0, 1.0, 1.0])]
    e = frame(spark, plain + odd + plain[:40]).repartition(5)
    got = found(neighbours.search(e, e.filter("vec_id % 100 = 0")))
    rows = [(i, tuple(v)) for i, v in plain]
    same(got, nearest(rows, [r for r in rows if r[0] % 100 == 0]))
    assert neighbours.search(e.limit(0), e.limit(0)).collect() == []
    assert neighbours.search(e, e.limit(0)).collect() == []
    few = frame(spark, plain[:4])
    same(found(neighbours.search(few, few)), nearest(rows[:4], rows[:4]))
    one = frame(spark, plain[:1])
    assert neighbours.search(one, one).collect() == []


def test_an_id_with_two_vectors(spark):
    e = frame(spark, [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [5.0, 5.0])])
    got = neighbours.search(e, e.filter("vec_id = 2")).orderBy("rank").select("vec_id", F.round("score", 6)).collect()
    assert [tuple(r) for r in got] == [(1, 0.0), (1, 1.414214), (3, 6.403124)]


def test_hot_vector_and_blocks(spark):
    """Half of all rows are one vector, and a part's candidates and queries are several blocks and chunks."""
    rng = np.random.default_rng(2)
    rows = [(i, (1.0, 2.0, 3.0) if i % 2 else tuple(float(x) for x in rng.standard_normal(3))) for i in range(1200)]
    e = frame(spark, [(i, list(v)) for i, v in rows]).repartition(6)
    s = neighbours.Settings(block=100, chunk=7, exact=True)
    asked = [r for r in rows if r[0] % 25 == 0]
    same(found(neighbours.search(e, e.filter("vec_id % 25 = 0"), s)), nearest(rows, asked))


@pytest.mark.parametrize("groups", [0, 12])
def test_recall_of_learned_parts(spark, groups):
    """Vectors without any grouping, the hardest, and in groups; recall at 10 against all candidates."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((4000, 16))
    if groups:
        x = x * 0.3 + rng.standard_normal((groups, 16))[rng.integers(0, groups, 4000)] * 2
    rows = [(i, tuple(map(float, v))) for i, v in enumerate(x)]
    e = frame(spark, [(i, list(v)) for i, v in rows]).repartition(4)
    s = neighbours.Settings(rows=400, sample=2000)
    got, want = found(neighbours.search(e, e.filter("vec_id % 50 = 0"), s)), nearest(rows, [r for r in rows if r[0] % 50 == 0])
    hits = sum(len({j for _, j, _ in got[q]} & {j for _, j, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 10 * len(want)
    router = neighbours.fit(x[::2], 4000, s)
    assert router.parts == 10
    if groups:  # most parts need not be read
        p = np.sort(router.probabilities(x), 1)[:, ::-1]
        assert ((np.cumsum(p, 1) - p) < router.mass).sum(1).mean() < 6


def test_parts_of_the_graph_are_balanced():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 8))
    x[:300] = x[:300] * 0.01 + 3  # a third of all rows nearly equal
    graph = neighbours.graph_of(x, 10)
    first = neighbours.halved(x, 7, rng)
    part = neighbours.balanced(graph, first, 7)
    assert np.bincount(part, minlength=7).max() <= np.ceil(1.05 * 900 / 7)
    assert (part[graph] == part[:, None]).mean() >= (first[graph] == first[:, None]).mean()


def test_neighbours_query(spark):
    e = [(r["vec_id"], tuple(r["embedding"])) for r in spark.read.parquet(f"{AT}/embeddings.parquet").collect()]
    same(found(queries.op12_nearest_neighbours(spark, AT)), nearest(e, [r for r in e if r[0] % 100 == 0]))


# --- op13 ---
def aligned(docs):
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    name, of = {i: t for t, i in a.get_vocab().items()}, alignment.byte_level()
    b = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def told(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode()

    made, count = [], Counter()
    for d, text in docs:
        row = (0, 0, [], [])
        if text:
            x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            tx, ty = [bytes(of[c] for c in name[i]) for i in x], [told(i) for i in y]
            if b"".join(tx) == b"".join(ty) == (" " + text).encode():
                ends_x, ends_y = ({int(e): i for i, e in enumerate(np.cumsum([len(t) for t in z]))} for z in (tx, ty))
                groups, links, i, j = [], [], 0, 0
                for e in sorted(ends_x.keys() & ends_y.keys()):
                    groups.append(",".join(map(str, x[i : ends_x[e] + 1])) + "|" + ",".join(map(str, y[j : ends_y[e] + 1])))
                    links.append((x[ends_x[e]], y[ends_y[e]]))
                    i, j = ends_x[e] + 1, ends_y[e] + 1
                row = (len(x), len(y), groups, links)
                count.update(links)
        made.append((d, row))
    best = Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(d, n_a, n_b, len(g), len(k), sum(count[p] == best[p[1]] for p in k), sum(count[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, (n_a, n_b, g, k) in made]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def digest(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


ODD = ["<|endoftext|> and <s> </s> <unk>", " a", "a ", "   ", "a  b\t\n c", "x▁y", "▁", "\x00a\x00", "é é ﬁ Ａ", "日本語テスト🎉 x", "a b　c", "don't I'LL 12345 1000000", "\r\n\r\n", "x" * 5000, "ab " * 4000 + "ab", "<0x41>", "﻿a", "​ ​"]


def test_alignment_of_odd_texts(spark, docs, odd, none):
    rows = [(i, t) for i, t in enumerate(ODD)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(alignment.alignment_digest(d)) == sorted(aligned(rows), key=repr)
    own = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = sorted(aligned(own), key=repr)
    assert digest(alignment.alignment_digest(docs)) == want == digest(alignment.alignment_digest(odd.withColumn("pairs", F.lit(1)).withColumn("a", F.lit(2))))
    assert alignment.alignment_digest(none).collect() == []
    assert digest(alignment.alignment_digest(docs.filter("text is null or text = ''")))[0][1:] == (0, 0, 0, 0, 0, 0, "")


def test_alignment_of_random_texts(spark):
    import random

    r = random.Random(5)
    letters = [*"ab e\n\t.,  '’ZÉßñ0", "日", "\0", "ﬁ", "́", " ", "🎉", "</s>", "<unk>", "the ", "ing", "  ", " un", "believable", "\u0085", "<|endoftext|>"]
    rows = [(i, "".join(r.choices(letters, k=r.randint(0, 40)))) for i in range(1500)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert digest(alignment.alignment_digest(d)) == sorted(aligned(rows), key=repr)


def test_alignment_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{AT}/documents.parquet").select("doc_id", "text").collect()]
    assert digest(queries.op13_align_tokenizers(spark, AT)) == sorted(aligned(rows), key=repr)


def test_a_text_of_several_megabytes(spark):
    text = " ".join(f"word{i % 977} and {i}" for i in range(350_000))
    assert len(text) > 5_000_000
    rows = [(1, text), (2, "word1 and 1"), (3, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert digest(alignment.alignment_digest(d)) == sorted(aligned(rows), key=repr)


def test_alignments_give_the_groups(spark, docs):
    for r in alignment.alignments(docs).collect():
        assert len(r["a_ends"]) == len(r["b_ends"])
        if r["a_ends"]:
            assert r["a_ends"][-1] == len(r["a"]) and r["b_ends"][-1] == len(r["b"])
            assert all(x < y for x, y in zip(r["a_ends"], r["a_ends"][1:])) and all(x < y for x, y in zip(r["b_ends"], r["b_ends"][1:]))
        else:
            assert r["a"] == r["b"] == []


def test_pairs_that_can_be_linked_are_few():
    assert alignment.linkable([b"ab", b"b", b"xab"], [b"b", b"ab", b"zb"]) == 7  # b-b, ab-b, ab-ab, xab-b, xab-ab; a suffix of zb and of ab: b
    t = alignment.tokenizers(*alignment._paths(None, None))
    assert alignment.linkable(t.of_a.tokens, t.of_b.tokens) < 500_000
