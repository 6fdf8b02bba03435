"""op1: brute force over all windows; the transform against sorted suffixes. op8: brute force over all pairs."""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import bwt, graph, nearcopies, simhash, suffix_dedup

from .conftest import TEXTS

AT = "/root/testdata/sf0.001"


def removed(rows, k=50):
    first: dict = {}
    key = lambda i: (i is None, i)
    for i, t in sorted(rows, key=lambda r: key(r[0])):
        b = (t or "").encode()
        for p in range(len(b) - k + 1):
            first.setdefault(b[p : p + k], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - k + 1):
            f = first[b[p : p + k]]
            if f != i and key(f) < key(i):
                gone[p : p + k] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("wide,crowded", [(128, 1 << 16), (2, 1 << 16), (128, 2)])
def test_op1_edges(docs, odd, wide, crowded):
    want = removed([(i, t) for i, t, _ in TEXTS])
    for d in (docs, odd):
        assert sorted(map(tuple, suffix_dedup.dedup_digest(d, wide=wide, crowded=crowded).collect()), key=repr) == want


def test_op1_table(spark):
    d = spark.read.parquet(f"{AT}/documents.parquet")
    want = removed([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()])
    assert sorted(map(tuple, suffix_dedup.dedup_digest(d).collect()), key=repr) == want
    assert sum(r[2] for r in want) > 1000


def test_op1_removes_nothing_on_a_hash_alone(docs, monkeypatch):
    """With contents named by their length alone, strings that differ are still told apart; so are many chunks of a few bytes."""
    monkeypatch.setattr(suffix_dedup, "span_hashes", lambda sums, a, b: (b - a).astype(np.uint64))
    rng = np.random.default_rng(3)
    line = ["".join(rng.choice(list("abc "), 70)) for _ in range(12)]
    rows = [(i, "".join(line[j] for j in rng.integers(0, 12, 4))) for i in range(40)]
    d = docs.sparkSession.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for crowded in (1 << 16, 2):
        chunks = {}
        table = pa.Table.from_pylist([{"doc_id": i, "text": t} for i, t in rows])
        parts = [suffix_dedup.Chunk(table.slice(a, 10), 3) for a in range(0, 40, 10)]
        offers = pa.concat_tables([suffix_dedup.offer(c, j, 50) for j, c in enumerate(parts)])
        replies = pa.concat_tables([suffix_dedup.answer(offers.filter(pc.equal(offers["bucket"], b)), 128, crowded) for b in range(3)])
        sent = pa.concat_tables([suffix_dedup.send(c, j, replies.filter(pc.equal(replies["chunk"], j)), 50) for j, c in enumerate(parts)])
        spans = pa.concat_tables([suffix_dedup.compare(sent.filter(pc.equal(sent["bucket"], b)), 50) for b in range(3) if sent.filter(pc.equal(sent["bucket"], b)).num_rows])
        for j, c in enumerate(parts):
            for i, (text, gone, n) in zip(c.table["doc_id"].to_pylist(), suffix_dedup._kept(c, spans.filter(pc.equal(spans["chunk"], j)))):
                chunks[i] = (gone, n, hashlib.sha256(text).hexdigest())
        assert sorted(((i, len(t), *chunks[i]) for i, t in rows), key=repr) == removed(rows)
    monkeypatch.undo()
    monkeypatch.setattr(suffix_dedup, "CHUNK", 64)
    assert sorted(map(tuple, suffix_dedup.dedup_digest(d).collect()), key=repr) == removed(rows)


def test_op1_copies_of_whole_texts_send_no_strings(spark, docs):
    """Six copies of a table under other ids: the strings that travel are those of one; results are brute force's, null ids and texts of under 50 bytes included."""
    d = spark.read.parquet(f"{AT}/documents.parquet").select("doc_id", "text").limit(60)
    rows = [(r.doc_id + 1000 * c, r.text) for c in (3, 0, 1, 5, 4, 2) for r in d.collect()] + [(i, t) for i in (7, None, 7, None, 9) for t in (None, "", "few bytes", "n" * 49, "y" * 50, "z" * 120)]
    many = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = removed(rows)
    assert sorted(map(tuple, suffix_dedup.dedup_digest(many).collect()), key=repr) == want
    texts = sorted(((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest(), len(r.spans)) for r in suffix_dedup.without_repeats(many).filter("text = ''").collect()), key=repr)
    assert texts == sorted(((i, sha, n) for i, _, _, n, sha in want if sha == hashlib.sha256(b"").hexdigest()), key=repr)

    ids, text = pa.array([[i] for i, _ in rows], pa.list_(pa.int64())), pa.array([t or "" for _, t in rows])
    one, six = (suffix_dedup.one_a_text(ids.slice(0, n), text.slice(0, n)) for n in (60, len(rows)))
    assert one.num_rows + 5 >= six.num_rows and sum(map(len, six["ids"].to_pylist())) == len(rows) and six["doc_id"].to_pylist()[0] == rows[60][0]


def test_op1_empty_and_texts(spark, none, docs):
    assert suffix_dedup.dedup_digest(none).count() == 0
    got = {(r.doc_id, r.text) for r in suffix_dedup.without_repeats(docs).collect()}
    assert (2, "") in got and (1, TEXTS[0][1]) in got


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=30), st.integers(0, 5)), max_size=12), st.integers(1, 6))
def test_transform_orders_suffixes(strings, k):
    raw = [s.encode() for s, _ in strings]
    lengths = np.array([len(b) for b in raw], np.int64)
    starts = np.cumsum(lengths) - lengths if len(raw) else lengths
    data = np.frombuffer(b"".join(raw), np.uint8)
    if not len(raw):
        return
    keys, lcp, _ = bwt.collection_bwt(data, starts, lengths)
    n = len(raw)
    suffixes = sorted((b[p:], i) for i, b in enumerate(raw) for p in range(len(b) + 1))
    assert len(lcp) == len(suffixes)
    assert [int(x) >> 24 for x in keys] == [s[0] for s, _ in suffixes[n:]]
    common = lambda x, y: next((i for i, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    assert lcp[n + 1 :].tolist() == [common(a[0], b[0]) for a, b in zip(suffixes[n:], suffixes[n + 1 :])]
    owner = np.array([o for _, o in strings])
    s, at = bwt.repeated_windows(data, starts, lengths, owner, k)
    least: dict = {}
    for b, o in zip(raw, owner):
        for p in range(len(b) - k + 1):
            least[b[p : p + k]] = min(least.get(b[p : p + k], 99), o)
    assert set(zip(s.tolist(), at.tolist())) == {(i, p) for i, b in enumerate(raw) for p in range(len(b) - k + 1) if least[b[p : p + k]] < owner[i]}


def brute_simhash(rows):
    import xxhash

    fp = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [b" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in sh]
        fp.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if bin(fp[a] ^ fp[b]).count("1") <= 2:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least: dict = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(least.get(find(a), i), i)
    return sorted(((i, f"{fp[a]:016x}", least.get(find(a))) for a, (i, _) in enumerate(rows)), key=repr)


def test_op8(spark, docs, odd, none):
    want = brute_simhash([(i, t) for i, t, _ in TEXTS])
    for d in (docs, odd):
        assert sorted(map(tuple, simhash.near_duplicates(d).collect()), key=repr) == want
    assert simhash.near_duplicates(none).count() == 0
    d = spark.read.parquet(f"{AT}/documents.parquet")
    assert sorted(map(tuple, simhash.near_duplicates(d).collect()), key=repr) == brute_simhash([(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()])


def test_op8_keeps_one_of_each_group(docs):
    groups = {c if c is not None else f for _, f, c in brute_simhash([(i, t) for i, t, _ in TEXTS])}
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(groups)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 300), st.integers(0, 3))
def test_bit_sliced_pairs(seed, n, radius):
    rng = np.random.default_rng(seed)
    fp = np.unique(rng.choice(rng.integers(0, 2**63, 4, dtype=np.uint64), n) ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 8, n).astype(np.uint64)))
    rng.shuffle(fp)
    key = np.sort(rng.integers(0, 3, len(fp)))
    got = {(int(a), int(b)) for x, y in simhash.near_words(fp, simhash.run_ends(key), radius, chunk=8) for a, b in zip(x, y)}
    assert got == {(a, b) for a in range(len(fp)) for b in range(a + 1, len(fp)) if key[a] == key[b] and bin(int(fp[a] ^ fp[b])).count("1") <= radius}
    small, large = (sorted(map(tuple, np.stack(simhash.bucket_links(key.copy(), fp.copy(), radius, c), 1).tolist())) for c in (4096, 8))
    assert small == large


def test_components(spark):
    edges = [(2, 1), (3, 2), (4, 3), (9, 8), (20, 9), (30, 31)] + [(i + 1, i) for i in range(100, 160)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 4: 1, 9: 8, 20: 8, 31: 30} | {i: 100 for i in range(101, 161)}


def brute_near(rows, least=0.8):
    """(group of each row by place): links between sets of 5-word shingles, all pairs that share one compared."""
    sets = [nearcopies.shingles((t or "").encode().lower().split(), 5) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    holds: dict = {}
    for i, x in enumerate(sets):
        for g in x or {None}:
            holds.setdefault(g, []).append(i)
    for i, x in enumerate(sets):
        for j in {j for g in x or {None} for j in holds[g] if j < i and find(j) != find(i)}:
            if len(x & sets[j]) >= least * len(x | sets[j]) - 1e-9:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(rows))]


def kept_of(rows):
    best: dict = {}
    for g, (i, _) in zip(brute_near(rows), rows):
        key = (i is None, i or 0)
        best[g] = min(best.get(g, key), key)
    return sorted(None if none else i for none, i in best.values()) if not any(none for none, _ in best.values()) else sorted((None if none else i for none, i in best.values()), key=repr)


def test_near_copies_stay_once(spark, docs, odd, none):
    want = sorted(kept_of([(i, t) for i, t, _ in TEXTS]), key=repr)
    for d in (docs, odd):
        got = nearcopies.deduplicate(d)
        assert got.columns == d.columns and sorted((r.doc_id for r in got.collect()), key=repr) == want
    assert nearcopies.deduplicate(none).count() == 0
    rng = np.random.default_rng(11)
    rows = []
    for i in range(60):  # chains of edits: the ends are far from each other, each step is near or just not
        w = [f"w{x}" for x in rng.integers(0, 5000, rng.integers(20, 300))]
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), " ".join(w)))
            for k in rng.integers(0, len(w), rng.integers(0, max(2, len(w) // 25))):
                w[k] = f"w{rng.integers(0, 5000)}"
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = set(kept_of(rows))
    assert len(want) < len(rows) - 100
    assert {r.doc_id for r in nearcopies.deduplicate(d).collect()} == want
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in table.select("doc_id", "text").collect()]
    assert {r.doc_id for r in nearcopies.deduplicate(table).collect()} == set(kept_of(rows))


def edited(words, n, rng):
    w = list(words)
    for k in rng.choice(len(w), n, replace=False):
        w[k] = f"e{rng.integers(0, 10**9)}"
    return w


def template_pages(n, seed=5):
    """One page of 120 words; n / 2 variants with 2 words replaced, each with a copy that has 2 more replaced."""
    rng = np.random.default_rng(seed)
    base, rows = [f"t{x}" for x in rng.integers(0, 10**6, 120)], []
    for _ in range(n // 2):
        one = edited(base, 2, rng)
        rows += [" ".join(one), " ".join(edited(one, 2, rng))]
    return [(int(i), rows[k]) for k, i in enumerate(rng.permutation(len(rows)))]


@pytest.mark.parametrize("crowd", [4096, 50])
def test_template_pages(spark, crowd):
    """Hundreds of texts of one bucket, most pairs just under the bound: every pair is decided, also if buckets are dealt to parts."""
    rows = template_pages(600)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = set(kept_of(rows))
    assert len(want) < 100
    got = {r.doc_id for r in nearcopies.deduplicate(d, nearcopies.Settings(crowd=crowd)).collect()}
    assert got == want


def test_hot_group_and_long_near_copies(spark):
    """Half of all rows are copies of one text, a third near copies of it; two texts of 5 MB differ in a word."""
    rng = np.random.default_rng(6)
    base = [f"h{x}" for x in rng.integers(0, 10**6, 150)]
    rows = [" ".join(base)] * 600 + [" ".join(edited(base, 1, rng)) for _ in range(400)] + [" ".join(f"u{x}" for x in rng.integers(0, 10**6, 60)) for _ in range(100)]
    long = [f"word{x}" for x in rng.integers(0, 10**6, 600_000)]
    rows += [" ".join(long), " ".join(edited(long, 1, rng)), " ".join(edited(long, 300_000, rng))]
    rows = [(i, t) for i, t in enumerate(rows)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r.doc_id for r in nearcopies.deduplicate(d, nearcopies.Settings(crowd=64)).collect()}
    assert got == {0, *range(1000, 1101), 1102}


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(2, 60), st.booleans())
def test_links_within_a_cell(seed, n, all_home):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    sets = [np.unique(np.where(rng.random(40) < 0.1, rng.integers(0, 2**63, 40, dtype=np.uint64), base)) for _ in range(n)]
    group, home = rng.integers(0, max(2, n // 2), n), np.ones(n, bool) if all_home else rng.random(n) < 0.5
    s = nearcopies.Settings(radius=64)
    got = nearcopies.linked(sets, np.zeros(n, np.uint64), group, home, s)
    alike = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9
    every = [(i, j) for i in range(n) for j in range(i + 1, n) if (home[i] or home[j]) and alike(i, j)]
    assert all(p in every for p in got)
    known = [(i, j) for i in range(n) for j in range(i + 1, n) if group[i] == group[j]]

    def roots(pairs):
        root = list(range(n))
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [a if x == b else x for x in root]
        return [root.index(x) for x in root]

    assert roots(known + got) == roots(known + every)
    assert len(got) == len(set(roots(known))) - len(set(roots(known + every)))


def test_op1_sends_less_than_the_strings(spark):
    """What is shuffled of the strings, places and owners included and compressed as a shuffle file is, is less than the strings alone."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").toArrow()
    parts = [suffix_dedup.Chunk(d.slice(a, 500), 2) for a in (0, 500)]
    offers = pa.concat_tables([suffix_dedup.offer(c, j, 50) for j, c in enumerate(parts)])
    replies = pa.concat_tables([suffix_dedup.answer(offers.filter(pc.equal(offers["bucket"], b)), 128, 1 << 16) for b in range(2)])
    sent = pa.concat_tables([suffix_dedup.send(c, j, replies.filter(pc.equal(replies["chunk"], j)), 50) for j, c in enumerate(parts)])
    sent = sent.filter(pc.is_valid(sent["owner"]))
    shuffled = sum(len(pa.compress(b"".join(r[c] for c in sent.column_names[2:]), "lz4_raw", asbytes=True)) for r in sent.to_pylist())
    strings = sum(int(suffix_dedup._joined(r["length"], "<i8").sum()) for r in sent.to_pylist())
    assert 0 < shuffled < 0.8 * strings, (shuffled, strings)
