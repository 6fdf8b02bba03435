"""Token counts by finite-state transducers: see automata.py."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import pieces, ship, text_bytes, worker_cache


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def counter(path: str):
    """(machine, lexicon, special strings) for a byte-level BPE file; one a Python worker."""
    from .automata import Lexicon, PreTokenizer

    made = worker_cache("token_counts")
    if path not in made:
        lexicon = Lexicon(path, ids=False)
        special = {t.content: i for i, t in lexicon.tokenizer.get_added_tokens_decoder().items()}
        made[path] = PreTokenizer(keep_spaces=True, long_numbers=True), lexicon, special
    return made[path]


def count_texts(texts: list[str], path: str) -> np.ndarray:
    from .automata import split_special

    pre, lexicon, special = counter(path)
    if not any(s in t for s in special for t in texts):
        return pre.counts(texts, lexicon)
    parts, owner, found = split_special(texts, special)
    n = np.bincount(owner, pre.counts(parts, lexicon), len(texts)).astype(np.int64)
    for before, _ in found:
        n[owner[before - 1]] += 1
    return n


def token_counts(docs: DataFrame, path: str | None = None, name: str = "byte_bpe_50k.json", limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row for each of docs' rows, in their partitions; nothing is shuffled.

    Null texts are empty: 0 bytes, 0 tokens. Repeated rows, ties and null doc_ids are rows like any other; other columns are not read; an empty table
    gives no rows. Texts are cut in pieces of about 4 MB for the arrays' sake, never a text itself. path is the vocabulary file on the executors; by
    default each finds `name` itself.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = path or tokenizer_path(name)
        for batch in batches:
            for part in pieces(batch, "text"):
                _, offsets = text_bytes(part.column("text"))
                texts = [t or "" for t in part.column("text").to_pylist()]
                n = count_texts(texts, file)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
