"""Damaged JSON by byte ranges against a scan of the whole text."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillmark.sources import json_ranges as jr
from quillmark.sources import pages as pagesrc


def scan(text: str, longest: int) -> list[tuple[int, str]]:
    """The plain scan from the beginning, a byte at a time."""
    at, out = 0, []
    while at < len(text):
        end = None
        if text[at] == "{":
            try:
                end = json.JSONDecoder().raw_decode(text, at)[1]
            except ValueError:
                end = None
        if end is not None and end - at <= longest:
            out.append((at, text[at:end]))
            at = end
        else:
            at += 1
    return out


def damaged(rng: random.Random, n: int) -> str:
    """Objects with nests, strings that hold marks, cut objects, junk and a wrapper that is never closed."""
    parts = ['{"questions": [']
    for i in range(n):
        value = {"k": i, "s": rng.choice(["{", '"', "}{", '{"a": 1}', "\\", "a,b", "é"]), "in": {"x": [{"y": i}, {}]}}
        told = json.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1]))
        kind = rng.random()
        parts.append(told if kind < 0.6 else told[: rng.randrange(len(told))] if kind < 0.8 else told.replace('"', "'", 1) if kind < 0.9 else rng.choice(['{"', '"}', "[{", '{"{"}', '":{"']))
        parts.append(rng.choice([", ", ",\n", "", '"', "]"]))
    return "".join(parts)


@pytest.mark.parametrize("seed", range(5))
def test_ranges_equal_one_scan(tmp_path, seed):
    rng = random.Random(seed)
    data = damaged(rng, 60).encode()
    (tmp_path / "q.json").write_bytes(data)
    file = jr._File(str(tmp_path / "q.json"))
    for longest in (40, 120, 1 << 20):
        want = scan(data.decode("latin-1"), longest)
        for split in (1, 17, 100, 1000, len(data)):
            got = [r for a in range(0, len(data), split) for r in jr.records(file, a, min(a + split, len(data)), longest, block=64)]
            assert got == want, (longest, split)
    file.close()


def test_source(spark, tmp_path):
    rows = [{"id": f"q{i}", "year": 2000 + i % 20, "text": "x" * (i % 50) + "é\n{"} for i in range(3000)]
    at = tmp_path / "bank"
    at.mkdir()
    (at / "a.json").write_text('{"questions": [' + ",\n".join(json.dumps(r) + ("" if i % 3 else ' {"cut": ') for i, r in enumerate(rows)) + "]", encoding="utf-8")
    (at / "b.json").write_text(json.dumps({"questions": [{"id": "b0"}, 3, {"id": "b1", "year": "bad"}]}))
    (at / "c.json").write_text("")
    (at / "d.js").write_bytes(b'const data = {"id": "d0", "text": "\xff"}; data.more = {};')
    (at / "_skip.json").write_text('{"id": "no"}')
    got = jr.read_damaged(spark, str(at), "id string, year int, text string", split=4096, longest=2048)
    assert got.rdd.getNumPartitions() > 20
    seen = {r.id: (r.year, r.text) for r in got.filter("id IS NOT NULL").collect()}
    assert seen == {r["id"]: (r["year"], r["text"]) for r in rows} | {"b0": (None, None), "b1": (None, None), "d0": (None, "�")}
    raw = jr.read_damaged(spark, str(at))
    assert raw.filter(F.col("path").endswith("b.json")).orderBy("pos").select("pos", "value").collect() == [(0, '{"id": "b0"}'), (1, '{"id": "b1", "year": "bad"}')]
    assert jr.read_damaged(spark, "file://" + str(at)).count() == raw.count()
    assert jr.read_damaged(spark, str(at / "c.json")).count() == 0
    with pytest.raises(Exception, match="nothing"):
        jr.read_damaged(spark, str(at / "nothing")).count()


def test_other_files_are_not_planned(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.json").write_text(json.dumps({"id": name}))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        one = jr.read_damaged(spark, str(tmp_path)).filter(F.col("path") == str(tmp_path / "a.json"))
        assert [r.value for r in one.collect()] == ['{"id": "a"}'] and one.rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def absent():
    raise ImportError("not installed")


def shaky(picture):
    if "blur" in picture:
        raise ValueError("blur")
    return [(picture, 0.9, (1, 2, 3.7, 4)), (" ", 0.9, (0, 0, 0, 0)), ("unsure", 0.0, (0, 0, 0, 0))]


def steady(picture):
    if "lost" in picture:
        raise ValueError("lost")
    return [(picture.upper(), 0.5, (0, 0, 1, 1))]


CHAIN = [("none", absent), ("shaky", lambda: shaky), ("steady", lambda: steady)]


def test_pages_by_own_text_or_engines(spark, tmp_path):
    def native(content):
        if content == b"broken":
            raise ValueError("no paper")
        for i, t in enumerate(content.decode().split("|")):
            yield {"text": t, "width": 600, "height": 800, "images": [{"ref": 7, "box": (1.5, 2, 3, 4), "width": 10, "height": 20}] if i == 1 else None}

    def picture(content, page, dpi):
        text = content.decode().split("|")[page]
        if text == "bad":
            raise ValueError("no picture")
        return f"{text}@{dpi}"

    pages = [" " + "x" * 101, "scan", "x" * 100, "blur", "blur lost", "bad", ""]
    (tmp_path / "p_2021.pdf").write_text("|".join(pages))
    (tmp_path / "q.pdf").write_bytes(b"broken")
    none = "none: ImportError: not installed"
    for together in (1, 3, 100):
        got = {r.page: r for r in pagesrc.read_pages(spark, str(tmp_path), native, picture, CHAIN, together=together).collect()}
        assert sorted(got, key=str) == [0, 1, 2, 3, 4, 5, 6, None]
        assert (got[0].engine, got[0].lines[0].confidence, got[0].lines[0].x1, got[0].errors, got[0].year) == ("native", 1.0, 600, [], 2021)
        assert (got[1].engine, [tuple(x) for x in got[1].lines], got[1].errors) == ("shaky", [("scan@300", 0.9, 1, 2, 3, 4)], [none])
        assert [tuple(x) for x in got[1].images] == [(7, 1, 2, 3, 4, 10, 20)] and got[2].engine == "shaky"
        assert (got[3].engine, got[3].lines[0].text, got[3].errors) == ("steady", "BLUR@300", [none, "shaky: ValueError: blur"])
        assert (got[4].engine, got[4].lines, got[4].errors) == (None, [], [none, "shaky: ValueError: blur", "steady: ValueError: lost"])
        assert (got[5].engine, got[5].errors) == (None, ["picture: ValueError: no picture"]) and got[None].errors == ["ValueError: no paper"]
    only = pagesrc.read_pages(spark, str(tmp_path), native, picture, CHAIN, quality="max_quality", pages=[1, 99]).filter("page IS NOT NULL").collect()
    assert [(r.page, r.lines[0].text) for r in only] == [(1, "scan@400")]
    assert pagesrc.read_pages(spark, str(tmp_path), native, picture, CHAIN, pattern="*.none").count() == 0


def test_images(spark, tmp_path):
    (tmp_path / "a_2020.png").write_text("scan")
    (tmp_path / "b.png").write_bytes(b"\xff")
    got = {r.path.rsplit("/", 1)[1]: r for r in pagesrc.read_images(spark, str(tmp_path), lambda c: c.decode(), CHAIN, "*.png").collect()}
    assert (got["a_2020.png"].engine, got["a_2020.png"].lines[0].text, got["a_2020.png"].year) == ("shaky", "scan", 2020)
    assert got["b.png"].engine is None and got["b.png"].errors[0].startswith("picture: UnicodeDecodeError")
