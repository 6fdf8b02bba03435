"""Text expressions: Column -> Column, no Python on the executors but for section_of, whose 300 words one automaton finds. IDs in brackets are those of the operator inventory."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .matching import lists_held


def bind(value: Column, body) -> Column:
    """Evaluate value once for all its uses in body: long score expressions would otherwise be repeated in the plan."""
    return F.element_at(F.transform(F.array(value), body), 1)


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def holds_any(text: Column, words: list[str]) -> Column:
    """Whether one of the words is a substring."""
    return any_of([text.contains(w) for w in words])


def n_holding(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [text.contains(w).cast("int") for w in words])


def strip(text: Column) -> Column:
    """Without blanks and line breaks at both ends."""
    return F.trim(text, F.lit(" \t\n\r\f\x0b"))


def normal_text(text: Column) -> Column:
    """Lower case, trimmed, runs of blanks as one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def text_key(text: Column) -> Column:
    """[F2, A14] md5 of the normal text: rows with equal keys are one question."""
    return F.md5(normal_text(text))


def n_words(text: Column) -> Column:
    return F.when(F.trim(F.regexp_replace(text, r"\s+", " ")) == "", 0).otherwise(F.size(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " ")))


def text_stats(text: Column) -> dict[str, Column]:
    """[F11, E10]"""
    words = n_words(text)
    return {
        "n_chars": F.length(text),
        "n_words": words,
        "avg_word_len": F.length(F.regexp_replace(text, r"\s+", "")) / F.greatest(words, F.lit(1)),
        "n_sentences": F.size(F.filter(F.split(text, "[.!?]"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")) != "")),
        "n_numbers": F.regexp_count(text, F.lit(r"[0-9]+")),
        "n_operators": F.regexp_count(text, F.lit(r"[+\-×÷*/^%=<>]")),
    }


def has_formula(text: Column) -> Column:
    """[F5]"""
    return any_of([text.rlike(p) for p in fixed.FORMULAS])


def math_notation(text: Column) -> Column:
    """The fixes in order, inside words too."""
    for a, b in fixed.MATH_FIXES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def numbers(text: Column) -> Column:
    """All numbers of a text as array<double>; a/b is a quotient, and dropped if b is 0."""
    found = F.regexp_extract_all(text, F.lit(r"([-+]?\d*\.?\d+(?:/\d+)?)"), 1)
    value = lambda s: F.when(s.contains("/"), F.try_divide(F.substring_index(s, "/", 1).try_cast("double"), F.substring_index(s, "/", -1).try_cast("double"))).otherwise(s.try_cast("double"))
    return F.array_compact(F.transform(found, value))


def operations(text: Column) -> Column:
    """Names of the operations that a text mentions."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(name)) for name, p in fixed.OPERATIONS)))


def numbers_by_unit(text: Column) -> Column:
    """map<unit, array<double>>, units without a number left out; a ratio gives both of its numbers."""
    def of(unit, p):
        rule = F.lit("(?i)" + p)
        got = F.regexp_extract_all(text, rule, 1)
        if unit == "ratio":
            got = F.flatten(F.zip_with(got, F.regexp_extract_all(text, rule, 2), lambda a, b: F.array(a, b)))
        return F.struct(F.lit(unit).alias("k"), F.transform(got, lambda s: s.cast("double")).alias("v"))

    return F.map_from_entries(F.filter(F.array(*(of(u, p) for u, p in fixed.UNITS.items())), lambda e: F.size(e["v"]) > 0))


def digits_template(text: Column) -> Column:
    """[A57] Numbers as N."""
    return F.regexp_replace(text, r"[0-9]+(\.[0-9]+)?", "N")


def options_of(text: Column) -> Column:
    """Options after (a), a), a. or [a], as array<struct<letter, option>> in order of letters: the first form that has two."""
    forms = [r"(?is)\(([a-e])\)\s*(.+?)(?=\s*\([a-e]\)|$)", r"(?is)(?<![a-z(])([a-e])\)\s*(.+?)(?=\s+[a-e]\)|$)", r"(?is)(?<![a-z])([a-e])\.\s*(.+?)(?=\s+[a-e]\.|$)", r"(?is)\[([a-e])\]\s*(.+?)(?=\s*\[[a-e]\]|$)"]
    got = []
    for p in forms:
        pairs = F.zip_with(F.regexp_extract_all(text, F.lit(p), 1), F.regexp_extract_all(text, F.lit(p), 2), lambda a, b: F.struct(F.lower(a).alias("letter"), strip(b).alias("option")))
        got.append(F.when(F.size(pairs) >= 2, F.array_sort(pairs)))
    return F.coalesce(*got, F.array().cast("array<struct<letter:string,option:string>>"))


def roman_number(text: Column) -> Column:
    """1 to 20, else null."""
    at = F.array_position(F.array(*(F.lit(r) for r in fixed.ROMAN)), F.lower(F.trim(text)))
    return F.when(at > 0, at.cast("int"))


def complex_ratio(text: Column) -> Column:
    """Share of words, cut free of marks, that are in the list."""
    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    hits = F.filter(words, lambda w: F.regexp_replace(w, r"^[.,!?;:]+|[.,!?;:]+$", "").isin(*fixed.COMPLEX_WORDS))
    return F.size(hits) / F.greatest(F.size(words), F.lit(1))


def has_steps(text: Column) -> Column:
    """[F12]"""
    return holds_any(F.lower(text), fixed.STEP_WORDS)


def mentions_diagram(text: Column) -> Column:
    return F.lower(text).rlike("figure|diagram|table|graph|chart|above|below|given")


def option_similarity(options: Column) -> Column:
    """[F13, J9, U3] Mean over pairs of options of the Jaccard similarity of their characters, and .8 more where first numbers are within 20 %."""
    clean = F.transform(options, lambda o: F.lower(F.trim(o)))
    pairs = F.flatten(F.transform(clean, lambda a, i: F.transform(F.filter(clean, lambda _, j: j > i), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    letters = lambda s: F.array_distinct(F.filter(F.split(s, ""), lambda c: c != ""))
    number = lambda s: F.regexp_extract(s, r"([0-9]+)", 1).try_cast("double")

    def of(p):
        a, b = letters(p["a"]), letters(p["b"])
        full = (F.size(a) > 0) & (F.size(b) > 0)
        jaccard = F.when(full, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
        x, y = number(p["a"]), number(p["b"])
        return F.array_compact(F.array(jaccard, F.when(full & (F.abs(x - y) <= F.greatest(x, y) * 0.2), F.lit(0.8))))

    all_ = F.flatten(F.transform(pairs, of))
    return F.when(F.size(all_) > 0, F.aggregate(all_, F.lit(0.0), lambda s, x: s + x) / F.size(all_)).otherwise(0.0)


def starter_type(text: Column) -> Column:
    """[F14, A60] The first kind of question whose opening matches."""
    low = F.lower(text)
    out = F.when(text.contains("?") & low.rlike("how (?:much|many|long)"), "calculation").otherwise("unknown")
    for kind, patterns in reversed(list(fixed.STARTERS.items())):
        out = F.when(any_of([low.rlike(p) for p in patterns]), kind).otherwise(out)
    return out


def first_largest(scores: dict[str, Column]) -> Column:
    """The name of the largest score, the first of equals."""
    best = F.greatest(*scores.values())
    return F.coalesce(*(F.when(s == best, F.lit(k)) for k, s in scores.items()))


def question_type(text: Column) -> tuple[Column, Column]:
    """(type, confidence): patterns count two, keywords one; unknown without any."""
    def judged(low):
        scores = {k: reduce(lambda a, b: a + b, [2 * low.rlike(p).cast("int") for p in ps]) + n_holding(low, fixed.TYPE_KEYWORDS[k]) for k, ps in fixed.TYPE_PATTERNS.items()}
        return bind(F.struct(*(v.alias(k) for k, v in scores.items())), _type_of)

    got = bind(F.lower(text), judged)
    return got["kind"], got["confidence"]


def _type_of(row: Column) -> Column:
    s = {k: row[k] for k in fixed.TYPE_PATTERNS}
    best, total = F.greatest(*s.values()), reduce(lambda a, b: a + b, s.values())
    return F.struct(F.when(best > 0, first_largest(s)).otherwise("unknown").alias("kind"), F.when(best > 0, best / total).otherwise(0.0).alias("confidence"))


#: What one automaton looks for: the two lists of each section, then the guard's, passages' and figures' phrases.
_PASSAGES = ["read the following passage", "read the passage", "based on the passage", "according to the passage"]
_SECTION_LISTS = [words for pair in fixed.SECTION_WORDS.values() for words in pair] + [fixed.VERBAL_GUARD.split("|"), _PASSAGES, fixed.FIGURE.split("|")]


def section_scores(text: Column, held) -> dict[str, Column]:
    """held(i): whether the text holds any of the i-th list."""
    s = {k: F.when(held(2 * i), w).otherwise(0) + F.when(held(2 * i + 1), v).otherwise(0) for i, (k, (w, v)) in enumerate(fixed.SECTION_WEIGHTS.items())}
    digits = F.regexp_count(text, F.lit("[0-9]"))
    s["numerical_ability"] += F.when(text.rlike(r"\d+\s*[+\-×÷*/=<>%]\s*\d+"), 4).otherwise(0) + F.when(text.rlike(r"\d+\s*:\s*\d+"), 3).otherwise(0) + F.when(digits > 8, 2).when(digits > 4, 1).otherwise(0)
    s["verbal_ability"] += F.when(held(9), 5).otherwise(0)
    s["reasoning"] += F.when(held(10), 2).otherwise(0)
    s["general_awareness"] += F.when((text.contains("19") | text.contains("20")) & text.rlike(fixed.YEAR), 1).otherwise(0)
    return s


def section_of(text: Column) -> Column:
    """A guard for verbal questions, then the first largest of four scores; under two, by the shape of the question."""
    def judged(mask):
        held = lambda i: mask.bitwiseAND(F.lit(1 << i)) > 0
        plain = F.when(F.lower(text).rlike(fixed.ASKING), "general_awareness").when(text.rlike("[0-9]") & (F.length(text) < 200), "numerical_ability").otherwise("general_awareness")
        row = F.struct(*(v.alias(k) for k, v in section_scores(text, held).items()))
        scored = bind(row, lambda s: F.when(F.greatest(*(s[k] for k in fixed.SECTION_WORDS)) >= 2, first_largest({k: s[k] for k in fixed.SECTION_WORDS})))
        return F.when(held(8) | text.rlike(fixed.BLANKS), "verbal_ability").otherwise(F.coalesce(scored, plain))

    return bind(lists_held(F.lower(text), _SECTION_LISTS), judged)


def news_class(text: Column) -> Column:
    """struct<category, relevance, probability>. Words count as substrings."""
    def judged(row):
        s = {k: row[k] for k in fixed.NEWS_WORDS}
        best = F.greatest(*s.values())
        relevance = F.least(best / 5, F.lit(1.0))
        named = lambda at: F.struct(
            F.when(best > 0, F.coalesce(*(F.when(at == k, F.lit(v)) for k, v in fixed.NEWS_NAMES.items()))).otherwise("General").alias("category"),
            F.when(best > 0, relevance).otherwise(0.1).alias("relevance"),
            F.when(best > 0, relevance * F.when(at.isin(*fixed.NEWS_FULL_WEIGHT), 1.0).otherwise(0.7)).otherwise(0.1).alias("probability"),
        )
        return bind(first_largest(s), named)

    return bind(F.lower(text), lambda low: bind(F.struct(*(n_holding(low, w).alias(k) for k, w in fixed.NEWS_WORDS.items())), judged))


def key_facts(text: Column) -> Column:
    """Up to five of: dates, quantities, names (in order of first use)."""
    date1 = F.regexp_extract_all(text, F.lit(rf"(?i)\b(\d{{1,2}}(?:st|nd|rd|th)?\s+(?:{fixed.MONTHS})\s+\d{{4}})\b"), 1)
    date2 = F.regexp_extract_all(text, F.lit(rf"(?i)\b((?:{fixed.MONTHS})\s+\d{{1,2}},?\s+\d{{4}})\b"), 1)
    amounts = F.regexp_extract_all(text, F.lit(r"(?i)(\d+(?:\.\d+)?\s*(?:crore|lakh|million|billion|km|meters|years))"), 1)
    names = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"), 1))
    told = lambda a, n, label: F.transform(F.slice(a, 1, n), lambda x: F.concat(F.lit(label), x))
    return F.slice(F.concat(told(date1, 2, "Date: "), told(date2, 2, "Date: "), F.transform(F.slice(amounts, 1, 3), lambda x: F.regexp_replace(x, r"(\d)\s*([A-Za-z])", "$1 $2")), told(names, 3, "Name: ")), 1, 5)


def slug(text: Column) -> Column:
    """[F24]"""
    return F.regexp_replace(F.lower(F.trim(text)), r"[^a-z0-9]+", "_")


def clean_option(option: Column) -> Column:
    """Without a leading letter in parentheses."""
    return F.regexp_replace(option, r"^\([A-D]\)\s*", "")


def right_option(options: Column, letter: Column) -> Column:
    """The option that the letter names, null beyond the list."""
    return F.get(options, (F.ascii(F.upper(letter)) - 65).cast("int"))


def fenced_json(text: Column, schema: str) -> Column:
    """The first {...} of an answer, fenced or not, read leniently."""
    return F.from_json(F.regexp_extract(text, r"(?s)(\{.*\})", 1), schema)


def shorten(text: Column, n: int, always: bool = False) -> Column:
    """[P16] n characters and dots, if longer (or always)."""
    cut = F.concat(F.substring(text, 1, n), F.lit("..."))
    return cut if always else F.when(F.length(text) > n, cut).otherwise(text)


def numbered_options(options: Column) -> Column:
    """[K11] `1) a | 2) b`"""
    return F.array_join(F.transform(options, lambda o, i: F.concat((i + 1).cast("string"), F.lit(") "), o)), " | ")


def quality_score(text: Column, n_options: Column, confidence: Column) -> Column:
    """[P19] 0 to 1."""
    n = F.length(F.trim(text))
    low = F.lower(text)
    score = (
        F.when((n_options >= 2) | low.rlike(fixed.OPTION_MARK), 0.30).otherwise(0.0)
        + F.when(text.contains("?"), 0.15).otherwise(0.0)
        + F.when(n > 50, 0.20).when(n > 30, 0.15).when(n > 15, 0.10).otherwise(0.0)
        + F.when(any_of([low.rlike(c) for c in fixed.DIRECTIVE_CUES]), 0.20).otherwise(0.0)
        + 0.15 * F.least(confidence, F.lit(1.0))
    )
    return F.least(score, F.lit(1.0))


def is_placeholder(text: Column, n_options: Column, least: float = 0.35) -> Column:
    """[P18]"""
    options = (n_options >= 2) | F.lower(text).rlike(fixed.OPTION_MARK)
    return holds_any(F.lower(text), fixed.PLACEHOLDER_MARKERS) | (quality_score(text, n_options, F.lit(0.7)) < least) | ((F.length(text) < 15) & ~options)


def review_issues(text: Column, n_options: Column, topic: Column, topic_conf: Column, difficulty_conf: Column, least: float = 0.5) -> Column:
    """[P17] Codes of what a reviewer should look at."""
    return F.array_compact(F.array(
        F.when(topic_conf < least, F.lit("low_topic_confidence")),
        F.when(difficulty_conf < least, F.lit("low_difficulty_confidence")),
        F.when(topic == "unknown", F.lit("unknown_topic")),
        F.when(F.length(text) < 15, F.lit("question_too_short")),
        F.when(n_options < 2, F.lit("insufficient_options")),
        F.when(has_formula(text), F.lit("contains_formula")),
        F.when(mentions_diagram(text), F.lit("references_diagram")),
    ))


def review_priority(n_issues: Column) -> Column:
    """[P17]"""
    return F.when(n_issues >= 3, "high").when(n_issues == 2, "medium").when(n_issues == 1, "low").otherwise("none")


def difficulty(text: Column, options: Column, topic_base: Column) -> tuple[Column, Column, Column]:
    """[P21, A68] (score, level, confidence)."""
    st = text_stats(text)
    w, ops, nums = st["n_words"], st["n_operators"], st["n_numbers"]
    math = F.when(ops >= 4, 0.25).when(ops >= 2, 0.15).when(ops >= 1, 0.10).otherwise(0.0) + F.when(nums >= 6, 0.10).when(nums >= 3, 0.05).otherwise(0.0)
    sim = option_similarity(options)
    total = (
        F.when(w > 50, 0.2).when(w > 30, 0.15).when(w > 15, 0.1).otherwise(0.05)
        + F.least(math, F.lit(0.25))
        + F.when(has_steps(text), 0.15).otherwise(0.0)
        + F.when(sim > 0.7, 0.15).when(sim > 0.5, 0.1).when(sim > 0.3, 0.05).otherwise(0.0)
        + 0.35 * F.coalesce(topic_base, F.lit(0.5))
        + F.least(complex_ratio(text) * 2, F.lit(0.1))
    )
    score = F.round(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)), 9)
    level = F.when(score < 0.35, "easy").when(score < 0.6, "medium").otherwise("hard")
    confidence = F.when((score < 0.25) | (score > 0.7), 0.85).when((score < 0.35) | (score > 0.6), 0.75).otherwise(0.65)
    return score, level, confidence


def clean_lines(text: Column) -> Column:
    """Words joined over line ends, single line breaks as spaces, runs of blanks and of empty lines cut short."""
    text = F.regexp_replace(text, r"(\w)-\n(\w)", "$1$2")
    text = F.regexp_replace(text, r"(?<=[a-z,])\n(?=[a-z])", " ")
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(text, r"\n{3,}", "\n\n"))
