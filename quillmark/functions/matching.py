"""Text functions that built-in expressions can't state, or state only at many times the cost: places of all matches, replacement one match at a time, which of
many word lists a text holds. Batches go by Arrow."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import fixed

#: What stands for the i-th number of a unit in a template, in the order in which units are looked for.
SHOWN = [
    ("speed", "{i}_speed"), ("distance", "{i}_distance"), ("time", "{i}_time"), ("money", "Rs. {{{i}_amount"), ("percentage", "{i}_percent}}%"), ("age", "{i}_age}} years"), ("workers", "{i}_workers"),
]


def match_places(rows: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """key, start, end, match of every match, in code points."""
    schema = T.StructType([rows.schema[key], T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("match", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = re.compile(pattern)
        for b in batches:
            found = [[(m.start(), m.end(), m[0]) for m in rule.finditer(t)] if t else [] for t in b.column(1).to_pylist()]
            at = pa.array([i for i, f in enumerate(found) for _ in f], pa.int64())
            flat = [x for f in found for x in f]
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), *(pa.array([x[j] for x in flat], kind) for j, kind in enumerate((pa.int32(), pa.int32(), pa.string())))], schema.names)

    return rows.select(key, text).mapInArrow(run, schema)


_FOLLOWED = re.compile(r"(?=\s|$|[,.])")


def _put(text: str, number: str, put: str) -> str:
    """The first `number` before a blank, comma, stop or the end becomes `put`. A pattern made for each number would be compiled anew each time."""
    at = text.find(number)
    while at >= 0:
        if _FOLLOWED.match(text, at + len(number)):
            return text[:at] + put + text[at + len(number) :]
        at = text.find(number, at + 1)
    return text


def typed_template(text: str) -> str:
    """A question with its numbers replaced by what they measure: up to three a unit, then up to five others."""
    for unit, shown in SHOWN:
        found = [m if isinstance(m, str) else m[0] for m in re.findall(fixed.UNITS[unit], text, re.IGNORECASE)]
        for i, number in enumerate(found[:3], 1):
            text = _put(text, number, shown.format(i=i))
    for i, number in enumerate(re.findall(r"\b(\d+\.?\d*)\b", text)[:5], 1):
        text = text.replace(number, f"{{num{i}}}", 1)
    return text


def template_of(text: Column) -> Column:
    """[F8]"""
    import pandas as pd

    def run(s):
        return s.fillna("").map(typed_template)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")(text)


def lists_held(text: Column, lists: list[list[str]]) -> Column:
    """A number whose bit i tells whether text holds any of lists[i] as a substring: one automaton over all lists, which stops where no bit is left to set."""
    import pandas as pd

    bits: dict[str, int] = {}
    for i, words in enumerate(lists):
        for w in words:
            bits[w] = bits.get(w, 0) | 1 << i
    every = (1 << len(lists)) - 1

    def run(s):
        from ahocorasick import Automaton

        a = Automaton()
        for w, b in bits.items():
            a.add_word(w, b)
        a.make_automaton()

        def held(t: str | None) -> int:
            got = 0
            for _, b in a.iter(t or ""):
                got |= b
                if got == every:
                    break
            return got

        return s.map(held)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "long")(text)
