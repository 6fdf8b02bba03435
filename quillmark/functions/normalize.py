"""Names and codes: standard sections, topic codes, years in file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_filled(*columns: Column) -> Column:
    """[S6] The first that is neither null nor an empty string."""
    return F.coalesce(*(F.nullif(c.cast("string"), F.lit("")) for c in columns))


def standard_section(raw: Column, keep_raw: bool = False) -> Column:
    """[P8] By what the name holds, in this order."""
    other = raw if keep_raw else F.lit("Unknown")
    return (
        F.when(raw.contains("Verbal") & ~raw.contains("Reasoning"), "Verbal Ability")
        .when(raw.contains("Reasoning"), "Reasoning")
        .when(raw.contains("Numerical") | raw.contains("Quant"), "Numerical Ability")
        .when(raw.contains("General") | raw.contains("Awareness"), "General Awareness")
        .otherwise(other)
    )


def first_code(text: Column, codes: list[tuple[str, str]], prefix: Column) -> Column:
    """[P10] The code of the first listed word that the text holds; else the prefix and ten characters of the text in capitals."""
    other = F.concat(prefix, F.lit("_"), F.upper(F.substring(text, 1, 10)))
    return F.coalesce(*(F.when(F.lower(text).contains(w), F.lit(c)) for w, c in codes), other)


def mapped(value: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """[P11, P14, P29, F22] A small fixed map; what isn't in it passes, or takes the default."""
    at = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[value]
    return F.coalesce(at, value if default is None else default)


def by_prefix(code: Column, table: dict[str, str], default: str | None) -> Column:
    """[P14] The section of a code's prefix, up to its underscore."""
    return mapped(F.substring_index(code, "_", 1), table, F.lit(default))


def year_in(name: Column, pattern: str = r"(20\d{2})", default: int | None = None) -> Column:
    """[S20]"""
    return F.coalesce(F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).cast("int"), F.lit(default).cast("int"))


def alias_topics(rows: DataFrame, names: DataFrame, column: str, out: str = "topic_name") -> DataFrame:
    """[P12, P15, J3] names (raw, name): an exact match, else one that ignores case, else the value; blank is Unknown. The table of names is a dimension;
    whether it is broadcast is left to its size. Names that differ in case alone: the first by order of raw."""
    exact = names.groupBy("raw").agg(F.min("name").alias("__exact"))
    loose = names.groupBy(F.lower("raw").alias("__low")).agg(F.min_by("name", "raw").alias("__loose"))
    got = rows.join(exact, rows[column] == exact["raw"], "left").drop("raw").join(loose, F.lower(F.trim(F.col(column))) == F.col("__low"), "left")
    return got.withColumn(out, F.when(F.coalesce(F.trim(F.col(column)), F.lit("")) == "", "Unknown").otherwise(F.coalesce("__exact", "__loose", column))).drop("__exact", "__low", "__loose")


def with_codes(rows: DataFrame, codes: DataFrame, topic: str, section: str, misc: Column) -> DataFrame:
    """[P9, J2] codes (topic, code): left join, misc where a topic has none."""
    c = codes.select(F.col("topic").alias("__t"), F.col("code"))
    return rows.join(c, rows[topic] == F.col("__t"), "left").withColumn("code", F.coalesce("code", misc)).drop("__t")


def checked_rows(rows: DataFrame) -> DataFrame:
    """[P13] Adds reject_reason (null if the row is good): no text, no section or no options; a missing topic is `general`, difficulty gets a capital."""
    blank = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    reason = F.when(blank("text"), "missing text").when(blank("section"), "missing section").when(F.coalesce(F.size("options"), F.lit(0)) < 1, "missing options")
    return rows.withColumn("reject_reason", reason).withColumn("topic", F.when(blank("topic"), "general").otherwise(F.col("topic"))).withColumn("difficulty", F.initcap(F.coalesce("difficulty", F.lit("medium"))))
