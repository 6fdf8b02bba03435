"""Pages of papers: a file's own text where it has enough, else a picture of the page read by the first of several injected engines that can."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.normalize import year_in
from ..operators.lineage import written

#: Dots an inch of a page's picture.
DPI = {"fast": 200, "standard": 300, "max_quality": 400}
#: Into how many cells all pages that want a picture are dealt where no file ends one; a cell has `together` pages at least.
CELLS = 1024
#: A page of at most so many characters has no text of its own.
LEAST = 100
BOX = "x0:int,y0:int,x1:int,y1:int"
LINES = f"array<struct<text:string,confidence:double,{BOX}>>"
IMAGES = f"array<struct<ref:long,{BOX},width:int,height:int>>"

#: (name, load): load gives a function from a picture to (text, confidence, (x0, y0, x1, y1)) tuples. It is called once a task; an engine that can't be loaded is passed over.
Engine = tuple[str, Callable[[], Callable[[object], list[tuple]]]]


def _batch(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    arrow = to_arrow_schema(schema)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Row by row, so that one file's bytes are copied at a time."""
    return (tuple(c[i].as_py() for c in batch.columns) for i in range(batch.num_rows))


def _box(text: str, confidence: float, box: tuple) -> dict:
    return {"text": text, "confidence": float(confidence), **{k: int(v) for k, v in zip(("x0", "y0", "x1", "y1"), box)}}


class Chain:
    """Engines in order; what each can't do goes to the next."""

    def __init__(self, engines: list[Engine]):
        self.engines, self.errors = [], []
        for name, load in engines:
            try:
                self.engines.append((name, load()))
            except Exception as e:
                self.errors.append(f"{name}: {type(e).__name__}: {e}")

    def read(self, picture: object) -> tuple[str | None, list[dict], list[str]]:
        """(engine, lines, errors) of the first engine that doesn't fail. Blank lines and those without confidence are left out; a page may well have none."""
        errors = list(self.errors)
        for name, run in self.engines:
            try:
                return name, [_box(*line) for line in run(picture) if line[0].strip() and line[1] > 0], errors
            except Exception as e:
                errors.append(f"{name}: {type(e).__name__}: {e}")
        return None, [], errors


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "content")


_PAGE = f"path string, page int, engine string, lines {LINES}, images {IMAGES}, errors array<string>"


def read_pages(spark: SparkSession, folder: str, native: Callable[[bytes], Iterator[dict]], picture: Callable[[bytes, int, int], object], engines: list[Engine], pattern: str = "*.pdf",
               quality: str = "standard", dpi: int | None = None, pages: list[int] | None = None, least: int = LEAST, together: int = 32) -> DataFrame:
    """[S11, S13, E12] path, page, engine, lines (text, confidence, box), images, errors, year (of the name): a row for each page of each file, pages from 0.

    native: bytes to a dict a page: text, and where known width, height and images (dicts of ref, box, width, height). A page with over `least` characters, blanks around them not counted, is one line of
    confidence 1 by the engine `native`. Of the others picture(content, page, dpi) makes a picture (where preprocessing belongs), and the engines read it. Such pages
    are dealt `together` at a time, or a CELLS-th of all if that is more, so a long scan is read by many tasks; its bytes travel once for each of these. pages: only these.

    A file that native can't read is one row with no page and its error; a page whose picture can't be made has no engine, no lines and its error, as has
    one that all engines fail on. Empty files are what native makes of them; an empty folder gives no rows.
    """
    dots, wanted = dpi or DPI[quality], None if pages is None else set(pages)
    files = _files(spark, folder, pattern)
    first = T._parse_datatype_string(_PAGE)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in _rows(b):
                rows = []
                try:
                    for n, p in enumerate(native(content)):
                        if wanted is None or n in wanted:
                            text, enough = p.get("text") or "", len((p.get("text") or "").strip()) > least
                            images = [{"ref": i.get("ref"), **dict(zip(("x0", "y0", "x1", "y1"), map(int, i.get("box", ())))), "width": i.get("width"), "height": i.get("height")} for i in p.get("images") or []]
                            rows.append((path, n, "native" if enough else None, [_box(text, 1.0, (0, 0, p.get("width") or 0, p.get("height") or 0))] if enough else [], images, []))
                except Exception as e:
                    rows = [(path, None, None, [], [], [f"{type(e).__name__}: {e}"])]
                yield _batch(rows, first)

    told = written(files.mapInArrow(own, first), "pages")
    second = T._parse_datatype_string(f"path string, page int, engine string, lines {LINES}, errors array<string>")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = None
        for b in batches:
            for path, numbers, content in _rows(b):
                chain, rows = chain or Chain(engines), []
                for n in numbers:
                    try:
                        engine, lines, errors = chain.read(picture(content, n, dots))
                    except Exception as e:
                        engine, lines, errors = None, [], [f"picture: {type(e).__name__}: {e}"]
                    rows.append((path, n, engine, lines, errors))
                yield _batch(rows, second)

    scanned = told.filter("page IS NOT NULL AND engine IS NULL")
    wide = max(together, -(-scanned.count() // CELLS))
    cells = scanned.groupBy("path", F.floor(F.col("page") / wide).alias("cell")).agg(F.array_sort(F.collect_list("page")).alias("pages"))
    dealt = cells.join(files, "path").repartition("path", "cell").select("path", "pages", "content")
    seen = dealt.mapInArrow(read, second).join(scanned.select("path", "page", "images"), ["path", "page"])
    return told.filter("page IS NULL OR engine IS NOT NULL").unionByName(seen).withColumn("year", year_in(F.col("path")))


def read_images(spark: SparkSession, folder: str, picture: Callable[[bytes], object], engines: list[Engine], pattern: str = "*") -> DataFrame:
    """[S12] path, engine, lines, errors, year: a picture a file, read by the first engine that can. What isn't a picture has its error and no lines."""
    schema = T._parse_datatype_string(f"path string, engine string, lines {LINES}, errors array<string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = None
        for b in batches:
            chain, rows = chain or Chain(engines), []
            for path, content in _rows(b):
                try:
                    rows.append((path, *chain.read(picture(content))))
                except Exception as e:
                    rows.append((path, None, [], [f"picture: {type(e).__name__}: {e}"]))
            yield _batch(rows, schema)

    return _files(spark, folder, pattern).mapInArrow(run, schema).withColumn("year", year_in(F.col("path")))
