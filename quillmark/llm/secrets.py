"""Secret scans with corpus-wide ownership: in how many repositories and by how many owners is a candidate used?

Base rules find assignments, access keys and long hex strings. Other long, mixed strings are candidates only: the corpus decides. Each candidate's hash is
counted by distinct repositories and owners; what few owners have looks live and is added as an `owned` span, what many have is a copied example.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import join_hot, materialize, pieces, ship, text_bytes
from .kernels import word_spans

KINDS = ("assign", "access", "hex", "owned")


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _assign_rule() -> str:
    """The alternatives start with one letter each, in both cases, so that the search can skip to those letters."""
    words = ("password", "passwd", "secret", "token", "api_?key")
    names = "|".join(first + _either_case(w[1:]) for w in words for first in (w[0], w[0].upper()))
    return rf"({names})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"


ASSIGN = re.compile(_assign_rule())
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
_STRING = np.zeros(256, bool)
_STRING[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"]] = True


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def mixed(s: str, bits: float = 3.5) -> bool:
    """Letters and digits, not a word or a rule: at least `bits` of entropy a character."""
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s) and entropy(s) >= bits


def base_spans(text: str, long: bool = True) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, secret) by start, then kind. long: whether the text has a run of 20 characters that a key could be."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if long:
        if "AKIA" in text:
            out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
        out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def long_strings(data: np.ndarray, offsets: np.ndarray, least: int = 20) -> np.ndarray:
    """For each document, whether it has a run of `least` characters of those that keys are made of. Runs end with their document."""
    starts, ends, _ = word_spans(data, offsets, ~_STRING)
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, starts[ends - starts >= least], "right") - 1] = True
    return out


def _scan(docs: DataFrame, repository: str) -> DataFrame:
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"]
    found = T.StructType([T.StructField(k, T.LongType()) for k in ("start", "kind", "end", "hash")])
    schema = T.StructType([T.StructField("rid", T.LongType()), id_type, T.StructField("repository", T.StringType()), T.StructField("base_sha256", T.StringType()), T.StructField("found", T.ArrayType(found))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                long = long_strings(*text_bytes(part.column("text")))
                sha, rows = [], []
                for t, has in zip(part.column("text").to_pylist(), long.tolist()):
                    t = t or ""
                    base = base_spans(t, has)
                    sha.append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in base).encode()).hexdigest())
                    if has:
                        taken = [(a, b) for a, _, b, _ in base]
                        base += [(m.start(), 3, m.end(), m[0]) for m in LONG.finditer(t) if mixed(m[0]) and not any(a < m.end() and m.start() < b for a, b in taken)]
                        base.sort()
                    rows.append([{"start": a, "kind": k, "end": b, "hash": int.from_bytes(hashlib.blake2b(s.encode(), digest_size=8).digest(), "little", signed=True)} for a, k, b, s in base])
                kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "kind", "end", "hash")]))
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), part.column("repository"), pa.array(sha), pa.array(rows, kind)], schema.names)

    return docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col(repository).cast("string").alias("repository"), "text").mapInArrow(run, schema)


def owner_of(repository: Column) -> Column:
    """What stands before the first slash; a name without one is its own owner."""
    return F.substring_index(repository, "/", 1)


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repositories, n_owners from rows (hash, repository); a null repository is one of its own. Sums are formed before the shuffle."""
    one = found.select("hash", F.coalesce("repository", F.lit("\0")).alias("repository")).distinct()
    return one.groupBy("hash", owner_of(F.col("repository")).alias("owner")).agg(F.count("*").alias("n")).groupBy("hash").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"))


def secret_spans(docs: DataFrame, repository: str = "source", few: int = 2) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_live, n_example, n_repositories, n_owners: one row for each of docs' rows.

    spans has the base spans and the `owned` ones: candidates that at most `few` owners have. n_live and n_example split all candidates, base ones too,
    by that same verdict; n_repositories and n_owners are those of its most widely used candidate (0: none). Null and empty texts have no spans. Repeated rows, ties and null doc_ids are rows like any other; columns beside doc_id, text
    and the repository are not read; an empty table gives no rows. Texts stay in their partitions; only candidates are shuffled, 60 bytes each.
    """
    rows = materialize(_scan(docs, repository), "secrets")
    found = rows.filter(F.size("found") > 0).select("rid", "repository", F.explode("found").alias("f")).select("rid", "repository", "f.*")
    judged = join_hot(found, ownership(found), "hash", F.col("rid")).withColumn("live", F.col("n_owners") <= few)
    span = F.struct("start", "kind", "end")
    by_row = judged.groupBy("rid").agg(
        F.array_sort(F.collect_list(F.when((F.col("kind") < 3) | F.col("live"), span))).alias("kept"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_example"),
        F.max("n_repositories").alias("n_repositories"),
        F.max("n_owners").alias("n_owners"),
        *(F.count_if((F.col("kind") == i) & (F.lit(i < 3) | F.col("live"))).alias(f"n_{k}") for i, k in enumerate(KINDS)),
    )
    kinds = F.array(*(F.lit(k) for k in KINDS))
    told = F.array_join(F.transform("kept", lambda s: F.concat_ws(":", F.get(kinds, s["kind"].cast("int")), s["start"], s["end"])), ",")
    n = lambda k: F.coalesce(k, F.lit(0)).cast("long").alias(k)
    out = rows.select("rid", "doc_id", "base_sha256").join(by_row, "rid", "left")
    return out.select("doc_id", n("n_assign"), n("n_access"), n("n_hex"), "base_sha256", F.coalesce(told, F.lit("")).alias("spans"), n("n_owned"), n("n_live"), n("n_example"), n("n_repositories"), n("n_owners"))
