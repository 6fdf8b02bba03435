"""Quality rules with host verdicts: failures by domain, rates shrunk to an empirical beta prior. [native: DataFrame functions only]"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import WORD, join_hot, materialize

EMPTY = "cast(array() as array<bigint>)"


def document_rules(docs: DataFrame, host: str = "source", spare: int = 0) -> DataFrame:
    """doc_id, host and the base counts of each text (null: empty).

    A repeated 3-word window is found within its own text without a shuffle: 64-bit window hashes, their low bits replaced by the window's place,
    are sorted, so that equal windows become neighbours; neighbours are then compared by their whole 64 bits. spare: so many more low bits are
    left out of the first sort.
    """
    line = r"[^\x20\x09-\x0D]"
    base = docs.select("doc_id", F.col(host).alias("host"), F.coalesce("text", F.lit("")).alias("t"))
    s1 = base.select(
        "doc_id", "host",
        F.regexp_extract_all("t", F.lit(f"({WORD})"), 1).alias("w"),
        F.filter(F.split("t", "\n", -1), lambda x: x.rlike(line)).alias("lines"),
        (F.length("t") - F.regexp_count("t", F.lit(r"[\x20\x09-\x0D]"))).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
    )
    n = F.size("w")
    hashes = F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(F.col("w"), i), F.get(F.col("w"), i + 1), F.get(F.col("w"), i + 2)))).otherwise(F.expr(EMPTY))
    s2 = s1.select(
        "doc_id", "host", "word_chars", "n_symbols", n.cast("long").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("h"),
        (F.expr(f"shiftleft(1L, cast(ceil(log2(size(w) + 2)) as int) + {spare})") - 1).alias("low"),
    )
    high = F.bitwise_not(F.col("low"))
    s3 = s2.withColumn("p", F.sort_array(F.transform("h", lambda x, i: x.bitwiseAND(high).bitwiseOR(i.cast("long")))))

    at = lambda v: F.get(F.col("h"), v.bitwiseAND(F.col("low")).cast("int"))
    # Different hashes with equal high bits could lie between equal ones: such a text's places are sorted by whole hashes.
    mixed_up = F.exists(F.transform("p", lambda x, i: (i > 0) & (F.get(F.col("p"), i - 1).bitwiseAND(high) == x.bitwiseAND(high)) & (at(F.get(F.col("p"), i - 1)) != at(x))), lambda b: F.coalesce(b, F.lit(False)))
    whole = F.transform(F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i")))), lambda s: s["i"])
    s3 = s3.withColumn("p", F.when(mixed_up, whole).otherwise(F.col("p")))

    def same(x, y):
        return at(x) == at(y)

    again = F.filter("p", lambda x, i: F.coalesce(same(x, F.get(F.col("p"), i + 1)), F.lit(False)) | F.coalesce((i > 0) & same(F.get(F.col("p"), i - 1), x), F.lit(False)))
    s4 = s3.withColumn("at", F.sort_array(F.transform(again, lambda x: x.bitwiseAND(F.col("low")))))
    zero = F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("at", zero, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3).cast("long"), x - a["last"])).alias("n")), lambda a: a["n"])
    out = s4.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def host_verdicts(rules: DataFrame, most: float = 0.5) -> DataFrame:
    """host key, host_rate, host_failed. The prior's two parameters come from the hosts' rates by moments; a host fails if its shrunk rate is over `most`.

    Only two numbers reach the driver. A host is a group key alone: sums are formed before the shuffle.
    """
    hosts = rules.withColumn("hkey", host_key()).groupBy("hkey").agg(F.count("*").alias("n"), F.count_if("base_failed").alias("k"))
    rate = F.col("k") / F.col("n")
    mean, var = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    a, b = beta_prior(mean, var)
    shrunk = (F.col("k") + a) / (F.col("n") + (a + b))
    return hosts.select("hkey", F.round(shrunk, 6).alias("host_rate"), (shrunk > most).alias("host_failed"))


def host_key():
    return F.when(F.col("host").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("host")))


def beta_prior(mean: float | None, var: float | None) -> tuple[float, float]:
    """Moments of the hosts' rates; strength within 1 and 1000 pseudo-documents. No hosts, or all rates 0 or 1: a weak prior at that rate."""
    if mean is None:
        return 0.5, 0.5
    mean = min(max(mean, 1e-3), 1 - 1e-3)
    strength = 1000.0 if not var else min(max(mean * (1 - mean) / var - 1, 1.0), 1000.0)
    return mean * strength, (1 - mean) * strength


def quality_verdicts(docs: DataFrame, host: str = "source", most: float = 0.5) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate: one row for each of docs' rows.

    Null texts are empty (and fail: no words); null hosts are one host; repeated rows count each; an empty table gives no rows; other columns are ignored.
    A document stays if it passes the base rules and its host's verdict does not reject it.
    """
    rules = materialize(document_rules(docs, host), "quality-rules")
    verdicts = host_verdicts(rules, most)
    # One host may have a large share of all documents: its rows are dealt to several tasks.
    joined = join_hot(rules.withColumn("hkey", host_key()), verdicts, "hkey", F.xxhash64("doc_id", "n_words", "word_chars"))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"), "host_rate",
    )
