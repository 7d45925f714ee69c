"""Text columns: cleaning, counting and classifying. All stay inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from studyspark.functions import fixed as fx

NL = "\n"


def strip(text: Column) -> Column:
    """Without leading and trailing whitespace of any kind."""
    return F.btrim(text, F.lit(fx.SPACES))


def replace_all(text: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(by))


def contains_any(text: Column, words) -> Column:
    """Whether any of the plain words occurs. One pattern, so that ``text`` is evaluated once also
    inside lambdas, where Spark shares no subexpressions."""
    return F.rlike(text, F.lit("|".join(re.escape(w) for w in words)))


def holds_any(text: Column, words) -> Column:
    """The same for a text computed once, by plain searches, which cost far less than a pattern of many branches."""
    return bind(text, lambda x: reduce(lambda a, b: a | b, [F.contains(x, F.lit(w)) for w in words]))


def upper_each(text: Column) -> Column:
    """Upper case, one character for each character: sharp s becomes its capital, and what has no single capital stays."""
    upper = F.when(F.contains(text, F.lit("ß")), F.replace(text, F.lit("ß"), F.lit("ẞ"))).otherwise(text)
    each = F.transform(F.split(upper, ""), lambda c: F.when(F.length(F.upper(c)) == F.length(c), F.upper(c)).otherwise(c))
    return F.when(F.length(F.upper(upper)) == F.length(upper), F.upper(upper)).otherwise(F.array_join(each, ""))


def rstrip_lines(text: Column) -> Column:
    return replace_all(text, r"[\t\x0b-\r\x1c-\x20\x85\p{Z}]+(\n|\z)", "$1")


def clean_text(text: Column, preserve_markdown: bool = True, preserve_formulas: bool = True) -> Column:
    """Decode entities, drop control characters, and normalise line ends, blanks and blank lines."""
    text = F.replace(text, F.lit("\r\n"), F.lit(NL))
    for entity, plain in fx.ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(plain))
    text = replace_all(text, r"[\x00-\x08\x0b-\x1f]")
    text = rstrip_lines(text)
    text = replace_all(text, r"[ \t]+", " ")
    text = replace_all(text, r"\n{3,}", "\n\n")
    text = rstrip_lines(text)
    if not preserve_markdown:
        text = replace_all(text, r"(?m)^#+[\t-\r ]*")
        text = replace_all(text, r"(?m)^[\t-\r ]*[-*•][\t-\r ]*")
    if not preserve_formulas:
        text = replace_all(text, r"[=+×÷→⇒/]")
        text = replace_all(text, r"[₀-₉₊₋₌⁰-⁹⁺⁻⁼]")
        text = replace_all(text, r"\$[^\$]*\$")
    return text


def _strip_inline_markdown(text: Column) -> Column:
    for pattern in (r"\*\*([^*]+)\*\*", r"__([^_]+)__", r"\*([^*]+)\*", r"_([^_]+)_", r"\[([^\]]+)\]\([^)]+\)"):
        text = replace_all(text, pattern, "$1")
    return text


def strip_markdown(text: Column) -> Column:
    """Drop bold, italics and links outside fenced code. Closed fences sit at the odd places of the
    split; an unclosed one is ordinary text."""
    fence = r"(?s)```.*?```"
    prose = F.split(text, fence)
    code = F.regexp_extract_all(text, F.lit(fence), F.lit(0))
    pieces = F.transform(
        prose, lambda part, i: F.concat(_strip_inline_markdown(part), F.coalesce(F.get(code, i), F.lit("")))
    )
    return F.array_join(pieces, "")


def clean_pdf(text: Column) -> Column:
    """Join words broken at line ends; drop page marks, page numbers, headers and blank lines."""
    text = replace_all(text, r"([\p{L}\p{N}_]+)-\n([\p{L}\p{N}_]+)", "$1$2")
    text = replace_all(text, r"(?m)^[\t-\r ]*[0-9]+[\t-\r ]*$")
    text = replace_all(text, r"(?i)Page[\t-\r ]+[0-9]+")
    lines = F.transform(F.split(text, NL), strip)
    kept = F.filter(lines, lambda x: (F.length(x) > 3) & ~((F.length(x) < 20) & is_upper(x)))
    return F.array_join(kept, NL)


def is_upper(text: Column) -> Column:
    return F.rlike(text, F.lit(r"\p{Lu}")) & ~F.rlike(text, F.lit(r"\p{Ll}"))


def paragraphs(text: Column, sep: str = "\n\n") -> Column:
    """Array of non-empty trimmed paragraphs."""
    return F.filter(F.transform(F.split(text, sep), strip), lambda x: x != "")


def sentences(text: Column) -> Column:
    """Array of trimmed sentences, cut after ``.``, ``!`` or ``?`` and blanks."""
    parts = F.split(text, r"(?<=[.!?])[\t-\r ]+")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def first_sentence(text: Column) -> Column:
    head = F.regexp_extract(text, r"(?s)^(.*?[.!?])[\t-\r ]", 1)
    return F.coalesce(F.nullif(head, F.lit("")), text)


def _pack(units: Column, size: int, split_oversize) -> Column:
    """Greedy packing of an ordered string array into strings of at most ``size`` characters."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def flush(done: Column, open_: Column) -> Column:
        return F.when(open_ == "", done).otherwise(F.concat(done, F.array(open_)))

    def step(state: Column, unit: Column) -> Column:
        joined = F.when(state["open"] == "", unit).otherwise(F.concat(state["open"], F.lit(" "), unit))
        fits = F.length(joined) <= size
        done = flush(state["done"], state["open"])
        if split_oversize is None:
            return F.struct(
                F.when(fits, state["done"]).otherwise(done).alias("done"),
                F.when(fits, joined).otherwise(unit).alias("open"),
            )
        oversize = F.length(unit) > size
        return F.struct(
            F.when(fits, state["done"]).when(oversize, F.concat(done, split_oversize(unit))).otherwise(done).alias("done"),
            F.when(fits, joined).when(oversize, F.lit("")).otherwise(unit).alias("open"),
        )

    return F.aggregate(units, start, step, lambda s: flush(s["done"], s["open"]))


def _split_long_sentence(sentence: Column, size: int) -> Column:
    """Cut at commas and semicolons; a piece that is still too long is cut hard."""
    pieces = F.filter(F.transform(F.split(sentence, r"(?<=[,;])[\t-\r ]+"), strip), lambda x: x != "")
    cut = F.flatten(F.transform(
        pieces,
        lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(
            F.transform(F.sequence(F.lit(1), F.length(p), F.lit(size)), lambda i: F.substring(p, i, F.lit(size)))
        ),
    ))
    return _pack(cut, size, None)


def chunk_array(text: Column, max_size: int = 500, preserve_structure: bool = True, sep: str = "\n\n") -> Column:
    """Array of chunks of at most ``max_size`` characters. A paragraph that fits stays whole; a
    longer one is packed from its sentences."""
    if not preserve_structure:
        whole = strip(F.replace(text, F.lit(sep), F.lit(" ")))
        parts = F.filter(F.array(whole), lambda x: x != "")
    else:
        parts = paragraphs(text, sep)
    return F.flatten(F.transform(
        parts,
        lambda p: F.when(F.length(p) <= max_size, F.array(p)).otherwise(
            _pack(sentences(p), max_size, lambda s: _split_long_sentence(s, max_size))
        ),
    ))


def has_formula(text: Column) -> Column:
    """Whether ``fx.FORMULA_MARK`` is found. Its parts are tried one by one, those with a context of letters only where a
    plainer pattern has found the middle of them, as testing that context at every character costs ten times the rest."""
    def guarded(guard: Column, part: str) -> Column:
        return guard & F.rlike(text, F.lit(part))

    def holds(sign: str) -> Column:
        return F.contains(text, F.lit(sign))
    return (
        F.rlike(text, F.lit("[=+/×÷]"))
        | guarded(F.octet_length(text) > F.length(text), "[⁰-⁼₀-₌→⇒]")
        | guarded(F.rlike(text, F.lit("[A-Z]O[0-9]")), r"(^|[^\p{L}\p{N}_])[A-Z]O[0-9]")
        | guarded(holds("$"), r"\$[^\$]*\$")
        | guarded(holds("\\"), r"\\left|\\right|\\frac|\\sqrt")
        | guarded(F.rlike(text, F.lit(r"[A-Za-z0-9]-(?:[A-Za-z]|[0-9]+)(?:$|[^\p{L}\p{N}_])")), r"(^|[^\p{L}\p{N}_])([A-Za-z]|[0-9]+)-([A-Za-z]|[0-9]+)($|[^\p{L}\p{N}_])")
    )


def spaces_in(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def content_type(text: Column, formula: Column | None = None) -> Column:
    """heading, formula, list or paragraph, the first that applies; unknown when empty. ``formula`` is ``has_formula`` of the
    text where a column already holds it."""
    short = (
        (F.length(text) < 50) & ~F.rlike(text, F.lit(r"[.!?:;]\z")) & F.rlike(text, F.lit(r"^\p{Lu}")) & (spaces_in(text) < 10)
    )
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "unknown")
        .when(F.startswith(text, F.lit("#")) | short, "heading")
        .when(has_formula(text) if formula is None else formula, "formula")
        .when(F.rlike(text, F.lit(fx.LIST_START)), "list")
        .otherwise("paragraph")
    )


def own_topic(text: Column) -> Column:
    """The topic a chunk names itself, or null."""
    first = bind(strip(first_sentence(text)), lambda x: F.when(F.length(x) < 100, x))
    line = (
        (F.length(text) < 100) & F.rlike(text, F.lit(r"^\p{Lu}")) & ~F.contains(text, F.lit(NL)) & ~F.rlike(text, F.lit(r"[.!?]\z"))
    )
    return (
        F.when(F.startswith(text, F.lit("#")), strip(replace_all(text, r"^#+[\t-\r ]*")))
        .when(line, text)
        .otherwise(first)
    )


def fallback_topic(text: Column) -> Column:
    return F.substring(F.split_part(text, F.lit(NL), F.lit(1)), 1, 80)


def word_count(text: Column) -> Column:
    """Words between whitespace."""
    return F.regexp_count(text, F.lit(f"[^{fx.SPACE_CLASS}]+")).cast("bigint")


def term_count(text: Column) -> Column:
    """Runs of word characters."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+")).cast("bigint")


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once. Branches of a CASE share no subexpressions otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def academic_level(text: Column, formula: Column, words: Column) -> Column:
    terms = bind(F.lower(text), lambda lower: reduce(
        lambda a, b: a + b, [F.contains(lower, F.lit(t)).cast("int") for t in fx.TECHNICAL_TERMS]
    ))
    score = (
        F.when(formula, 2).otherwise(0) + (words > 50).cast("int") + (words > 100).cast("int") + terms
        + F.rlike(text, F.lit("[:;]")).cast("int")
    )
    return bind(score, lambda s: F.when(s >= 4, "advanced").when(s >= 2, "intermediate").otherwise("basic"))


def normalize_ws(text: Column) -> Column:
    """Line ends to LF, runs of tabs and feeds to one blank, no blanks at line ends."""
    text = F.replace(F.replace(text, F.lit("\r\n"), F.lit(NL)), F.lit("\r"), F.lit(NL))
    return rstrip_lines(replace_all(text, r"[\t\f\x0b]+", " "))


def text_confidence(text: Column) -> Column:
    """Plausibility of recognised text from its share of letters, digits and blanks."""
    length = F.length(text)
    alnum = length - F.length(replace_all(text, r"[\p{L}\p{N}]"))
    space = length - F.length(replace_all(text, f"[{fx.SPACE_CLASS}]"))
    score = (
        F.lit(0.9) - F.when(alnum / length < 0.5, 0.2).otherwise(0.0) - F.when(space / length > 0.4, 0.1).otherwise(0.0)
        + F.when(length.between(50, 5000), 0.05).otherwise(0.0)
    )
    short = text.isNull() | (F.length(strip(text)) < 5)
    return F.when(short, 0.3).otherwise(F.greatest(F.lit(0.3), F.least(F.lit(1.0), score)))
