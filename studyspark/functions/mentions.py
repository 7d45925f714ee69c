"""Entity mentions as columns. Each function works on a plain column and inside array lambdas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from studyspark.functions import fixed as fx
from studyspark.functions.text import bind, contains_any, holds_any, replace_all, strip

# A candidate is a short formula, a run of capitalised words, or any other word. Every word is
# consumed whole, so the scan stays linear in the text.
CANDIDATE = (
    r"[A-Za-z0-9]+ ?[=+×÷→⇒] ?[A-Za-z0-9]+"
    r"|\p{Lu}[\p{L}\p{N}'-]*(?: \p{Lu}[\p{L}\p{N}'-]*)*"
    r"|\p{L}+"
)
_SIGNS = "=+×÷→⇒"
# The same matches without steps back, which cannot lead to another match; those in a text without a sign; and the capitalised
# runs alone, none of which begins inside a word. The last one looks behind by UTF-16 units, so it is for texts without pairs of them.
_RUN = r"[\p{L}\p{N}'-]*+(?: \p{Lu}[\p{L}\p{N}'-]*+)*+"
_WORDS = rf"\p{{Lu}}{_RUN}|\p{{L}}++"
_SCAN = rf"[A-Za-z0-9]++ ?+[{_SIGNS}] ?[A-Za-z0-9]++|{_WORDS}"
_CAPITALS = rf"\p{{Lu}}(?<!\p{{L}}\p{{Lu}}){_RUN}"


def mention_array(text: Column) -> Column:
    """Distinct mentions, case ignored, in order of their first occurrence: formulas, capitalised runs
    and words that carry an academic keyword."""
    def scan(pattern: str) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = (F.octet_length(text) > F.length(text)) & F.rlike(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))
    candidates = F.when(holds_any(text, _SIGNS), scan(_SCAN)) \
        .when(holds_any(F.lower(text), fx.ACADEMIC_KEYWORDS) | pairs, scan(_WORDS)).otherwise(scan(_CAPITALS))
    # Equal candidates go at once, before any of them is looked at.
    found = F.filter(
        F.array_distinct(candidates),
        lambda x: F.rlike(x, F.lit(r"^\p{Lu}|" + fx.TERM_FORMULA)) | holds_any(F.lower(x), fx.ACADEMIC_KEYWORDS),
    )
    # Arrays are bound to names: one that is named inside a lambda as it stands would be computed again for every element.
    return bind(found, lambda every: bind(
        F.size(F.array_distinct(F.transform(every, F.lower))) == F.size(every),
        lambda distinct: F.when(distinct, every).otherwise(_first_of_case(every)),
    ))


def _first_of_case(mentions: Column) -> Column:
    """Of mentions that differ in case only the first, in the given order. Sorted, so that long arrays stay cheap."""
    keyed = F.array_sort(F.transform(mentions, lambda x, i: F.struct(F.lower(x).alias("low"), i.alias("at"), x.alias("x"))))
    first = bind(keyed, lambda k: F.filter(k, lambda y, i: (i == 0) | (F.get(k, i - 1)["low"] != y["low"])))
    return F.transform(F.array_sort(F.transform(first, lambda y: F.struct(y["at"], y["x"]))), lambda y: y["x"])


def is_academic_term(mention: Column) -> Column:
    lower = F.lower(mention)
    return (
        ~lower.isin(*fx.STOP_WORDS)
        & (F.length(mention) >= 3)
        & ~F.rlike(mention, F.lit("^[0-9]+$"))
        & (
            F.rlike(mention, F.lit(r"^\p{Lu}|" + fx.TERM_FORMULA))
            | holds_any(lower, fx.ACADEMIC_KEYWORDS)
            | (F.contains(mention, F.lit(" ")) & (F.length(mention) > 5))
        )
    )


def names_entities(context: Column) -> Column:
    """Whether the topic of a chunk speaks of named things."""
    return contains_any(F.lower(F.coalesce(context, F.lit(""))), fx.ENTITY_CONTEXT)


def entity_type(mention: Column, context: Column, named: Column | None = None) -> Column:
    """Formula, Entity, Topic or Concept; ``context`` is the topic of the chunk, ``named`` is ``names_entities`` of it where
    that is known."""
    proper = F.rlike(mention, F.lit(r"^\p{Lu}")) & ~F.contains(mention, F.lit(" ")) & (F.length(mention) > 2)
    named = names_entities(context) if named is None else named
    return (
        F.when(F.rlike(mention, F.lit(fx.TYPE_FORMULA)) | F.rlike(mention, F.lit(fx.CHEMICAL)), "Formula")
        .when(proper & named, "Entity")
        .when(F.rlike(mention, F.lit(r"^\p{Lu}[^ ]*(?: \p{Lu}[^ ]*){1,3}$")), "Topic")
        .otherwise("Concept")
    )


def confidence(mention: Column) -> Column:
    """Capitalised mentions count as recognised names, the others as phrases."""
    return F.when(F.rlike(mention, F.lit(r"^\p{Lu}")), 0.7).otherwise(0.6)


def normal_form(mention: Column) -> Column:
    formula = F.rlike(mention, F.lit(fx.NORMAL_FORMULA))
    plain = replace_all(strip(F.lower(mention)), r"[.,;:!?]+$")
    return F.when(formula, strip(mention)).otherwise(plain)
