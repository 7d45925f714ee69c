"""Personal data in texts: fixed base patterns, then identifiers found by bootstrapped contexts.

The base spans are seeds. The words around them give lexical patterns; Spark scores the graph of patterns and
instances in rounds, and patterns that end with high confidence mark further identifiers that no base pattern knows:
words and runs of words with digits, written-out addresses, and, right after two words that keep their confidence when
every word behind them counts, any word that stands mostly there.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from studyspark.llm.batches import sliced
from studyspark.session import written

KINDS = ("email", "ip", "card", "phone")
#: What identifiers found by context are called in spans and replacements.
FOUND = "context"

#: Rounds of scoring; confidence from which a pattern extracts; different instances a pattern must rest on, of which so
#: many must be seeds; weight of the doubt against patterns seen seldom.
ROUNDS, LEAST_CONFIDENCE, LEAST_INSTANCES, LEAST_SEEDS, DOUBT = 3, 0.7, 8, 5, 2.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# Possessive, with a guard before: the same matches as the plain patterns, in time linear in the text.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0d]+")
_DIGIT = re.compile(r"[0-9]")
_TRIM = re.compile(r"^[\W_]+|[\W_]+$")
#: Characters of an identifier that only its context gives away, and the digits it must hold.
LEAST_LENGTH, LEAST_DIGITS, MOST_LENGTH = 6, 4, 64
# Groups of an identifier in several words: digits in each, or a few capitals between such words.
_JOINT = re.compile(r"[\x20\t]{1,2}(?:[-\u2013./()][\x20\t]{1,2})?")
_CAPITALS = re.compile(r"[A-Z]{1,4}")
_SPELT = re.compile(r"(?<![\w.%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z0-9-]++)+")
_LEFT, _RIGHT = "([{<\"'=:,;#", ")]}>\"'.,;:!?"
#: Different words that may follow a context besides its seeds, per seed, for words of any shape to be found there.
OTHERS = 2
#: Characters looked at on each side for the neighbouring words; words are short, so this holds two of them.
_NEAR = 80


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(free, at + 1))


def _luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns by start, then kind as listed; code points, end exclusive."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append(("phone", m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def _plain(word: str) -> str:
    return _DIGIT.sub("0", _TRIM.sub("", word).lower())


def _context(text: str, start: int, end: int) -> tuple[str, str]:
    """The two words before and the word after a span, lower-cased, without outer punctuation; digits as 0."""
    before, after = text[max(0, start - _NEAR):start].split()[-2:], text[end:end + _NEAR].split()[:1]
    return " ".join(_plain(w) for w in before), _plain(after[0]) if after else ""


def candidates(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of words that could be identifiers: enough digits, not too long, and clear of ``taken`` spans."""
    k, taken = 0, sorted(taken, key=lambda s: s[1])
    reach = -1
    last = -1
    for digit in _DIGIT.finditer(text):
        if digit.start() < last:
            continue
        a = digit.start()
        while a > 0 and a > digit.start() - MOST_LENGTH and not text[a - 1].isspace():
            a -= 1
        found = _WORD.match(text, digit.start())
        last = found.end()
        word = text[a:last]
        left = len(word) - len(word.lstrip(_LEFT))
        right = len(word.rstrip(_RIGHT))
        if right - left < LEAST_LENGTH or right - left > MOST_LENGTH or sum(c.isdigit() for c in word) < LEAST_DIGITS:
            continue
        start, end = a + left, a + right
        while k < len(taken) and taken[k][1] < end:
            reach = max(reach, taken[k][2])
            k += 1
        if start >= reach:
            yield start, end


def _free(spans: Iterable[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a span meets none of ``spans``."""
    held = sorted(spans)
    starts, reach = [a for a, _ in held], list(accumulate((b for _, b in held), max))
    return lambda a, b: not (k := bisect_left(starts, b)) or reach[k - 1] <= a


def runs(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of identifiers in several words: digit-bearing words one after another, with a few capitals between them at
    most, and written-out addresses; as long as ``candidates`` and clear of ``taken`` spans."""
    clear = _free((a, b) for _, a, b in taken)
    if "dot" in text:
        yield from (m.span() for m in _SPELT.finditer(text) if m.end() - m.start() <= MOST_LENGTH and clear(*m.span()))
    group: list[re.Match] = []               # words of the run so far; the last may be capitals that still wait for digits

    def closed() -> Iterator[tuple[int, int]]:
        while group and not _DIGIT.search(group[-1][0]):
            group.pop()
        if len(group) < 2:
            return
        a, b = group[0].start(), group[-1].end()
        word = text[a:b]
        start, end = a + len(word) - len(word.lstrip(_LEFT)), a + len(word.rstrip(_RIGHT))
        if start > a and text[start - 1] == "(" and text.count(")", start, end) > text.count("(", start, end):
            start -= 1
        if end < b and text[end] == ")" and text.count("(", start, end) > text.count(")", start, end):
            end += 1
        if LEAST_LENGTH <= end - start <= MOST_LENGTH and len(_DIGIT.findall(text[start:end])) >= LEAST_DIGITS:
            yield start, end
    at = 0
    while first := _DIGIT.search(text, at):
        a = first.start()
        while a > at and not text[a - 1].isspace():
            a -= 1
        group, word = [], _WORD.match(text, a)
        at = word.end()
        while word and clear(*word.span()):
            group.append(word)
            at = word.end()
            joint = _JOINT.match(text, at) if word[0][-1] not in ",;:!?." else None
            word = _WORD.match(text, joint.end()) if joint else None
            if word and not (_DIGIT.search(word[0]) or _CAPITALS.fullmatch(word[0]) and _DIGIT.search(group[-1][0])):
                word = None
        yield from closed()


def mentions(documents: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, digest, base, marks) per row. digest: of the text. base: the base spans. marks: a (start, end, seed, instance,
    before, after) for each base span, candidate and run. A null text is empty."""
    rows = documents.select(F.col(id_column).alias("key"), F.col(text_column).cast("string").alias("text"))
    span = [StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]
    mark = [StructField("start", LongType()), StructField("end", LongType()), StructField("seed", BooleanType()), StructField("instance", StringType()),
            StructField("before", StringType()), StructField("after", StringType())]
    schema = StructType([rows.schema[0], StructField("digest", StringType()), StructField("base", ArrayType(StructType(span))), StructField("marks", ArrayType(StructType(mark)))])
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    mark_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("seed", pa.bool_()), ("instance", pa.string()), ("before", pa.string()), ("after", pa.string())]))

    def found(text: str) -> tuple[list[dict], list[dict]]:
        base = base_spans(text)
        marks = []
        other = dict.fromkeys([*(candidates(text, base) if _DIGIT.search(text) else ()), *runs(text, base)])
        spans = [(a, b, True) for _, a, b in base] + [(a, b, False) for a, b in other]
        for a, b, seed in spans:
            before, after = _context(text, a, b)
            marks.append({"start": a, "end": b, "seed": seed, "instance": _digest(text[a:b]), "before": before, "after": after})
        return [{"kind": k, "start": a, "end": b} for k, a, b in base], marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            both = [found(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_digest(t) for t in texts], pa.string()), pa.array([b for b, _ in both], span_type), pa.array([m for _, m in both], mark_type)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=12).hexdigest()


def _behind(text: str, known: dict[str, str], contexts: dict[str, int], lasts: set[str]) -> Iterator[tuple[str, int, int]]:
    """(context, start, end) of every word right after two words that are a context, clear of base spans and of what
    ``mentions`` marks. ``known`` remembers plain words; ``lasts`` are the last words of the contexts."""
    words = list(re.finditer(r"\S+", text))
    plain = []
    for m in words:
        if (p := known.get(m[0])) is None:
            known[m[0]] = p = _plain(m[0])
        plain.append(p)
    at = [i for i in range(2, len(words)) if plain[i - 1] in lasts and f"{plain[i - 2]} {plain[i - 1]}" in contexts]
    if not at:
        return
    base = base_spans(text)
    clear = _free([(a, b) for _, a, b in base] + [*candidates(text, base), *runs(text, base)])
    for i in at:
        start, end, word = words[i].start(), words[i].end(), words[i][0]
        start, end = start + len(word) - len(word.lstrip(_LEFT)), start + len(word.rstrip(_RIGHT))
        if 0 < end - start <= MOST_LENGTH and clear(start, end):
            yield f"{plain[i - 2]} {plain[i - 1]}", start, end


def uncrowded(documents: DataFrame, text_column: str, seeds: dict[str, int]) -> dict[str, int]:
    """The contexts (two words, with their number of different seeds) behind which so few different other words stand that
    the seeds keep their share. Exact: a task drops a context once it alone has met too many, else hands on all words."""
    rows = documents.select(F.col(text_column).cast("string").alias("text")).where("text IS NOT NULL")
    sent = documents.sparkSession.sparkContext.broadcast(seeds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live, known, crowded = dict(sent.value), {}, []
        met: dict[str, set[str]] = {}
        for batch in sliced(batches, "text"):
            lasts = {c.rpartition(" ")[2] for c in live}
            for text in batch.column("text").to_pylist():
                for context, a, b in _behind(text, known, live, lasts):
                    met.setdefault(context, set()).add(text[a:b])
                    if context in live and len(met[context]) > OTHERS * live[context]:
                        del live[context]
                        crowded.append(context)
            if len(known) > 200_000:
                known = {}
        left = [c for c in met if c in live]
        yield pa.RecordBatch.from_arrays([pa.array(crowded + left, pa.string()), pa.array([None] * len(crowded) + [list(met[c]) for c in left], pa.list_(pa.string()))], names=["context", "words"])

    tally = rows.mapInArrow(run, "context string, words array<string>").groupBy("context") \
        .agg(F.max(F.col("words").isNull()).alias("crowded"), F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"))
    # Contexts that no word follows need no second look.
    return {r.context: seeds[r.context] for r in tally.where("NOT crowded").select("context", F.size("words").alias("n")).collect()
            if r.n <= OTHERS * seeds[r.context]}


def following(documents: DataFrame, text_column: str, contexts: dict[str, int]) -> DataFrame:
    """(digest, start, end, seed, instance, before, after, word) of every word right after a context of two words, clear of
    base spans and of what ``mentions`` marks."""
    rows = documents.select(F.col(text_column).cast("string").alias("text")).where("text IS NOT NULL")
    schema = "digest string, start long, end long, seed boolean, instance string, before string, after string, word string"
    sent = documents.sparkSession.sparkContext.broadcast(contexts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contexts = sent.value
        lasts, known = {c.rpartition(" ")[2] for c in contexts}, {}
        for batch in sliced(batches, "text"):
            out = [(_digest(t), a, b, False, _digest(t[a:b]), *_context(t, a, b), t[a:b])
                   for t in batch.column("text").to_pylist() for _, a, b in _behind(t, known, contexts, lasts)]
            if len(known) > 200_000:
                known = {}
            columns = list(zip(*out)) or [()] * 8
            types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), *[pa.string()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["digest", "start", "end", "seed", "instance", "before", "after", "word"])

    return rows.mapInArrow(run, schema)


def patterns(marks: DataFrame) -> DataFrame:
    """``marks`` (seed, instance, before, after, and what else) with a ``pattern`` per lexical pattern: two words before,
    one word before, the words on both sides. A mark without neighbours has none."""
    last = F.element_at(F.split("before", " "), -1)
    kinds = F.array(F.when(F.instr("before", " ") > 1, F.concat(F.lit("2|"), "before")), F.when(last != "", F.concat(F.lit("1|"), last)),
                    F.when((last != "") & (F.col("after") != ""), F.concat(F.lit("b|"), last, F.lit("|"), "after")))
    return marks.select("*", F.explode(F.array_compact(kinds)).alias("pattern"))


def trusted_patterns(marks: DataFrame, rounds: int = ROUNDS, least: float = LEAST_CONFIDENCE, instances: int = LEAST_INSTANCES,
                     seeds: int = LEAST_SEEDS, doubt: float = DOUBT) -> DataFrame:
    """(pattern, confidence) of the patterns that extract.

    The graph joins each pattern to the different instances it surrounds. A seed scores 1. In each round a pattern's
    confidence is the sum of its instances' scores over their number plus ``doubt``, and an instance that is no seed
    scores one minus the product of its patterns' doubts. All edges count; grouping combines before each shuffle.
    """
    return _scored(patterns(marks), rounds, least, instances, seeds, doubt)


def _scored(met: DataFrame, rounds: int = ROUNDS, least: float = LEAST_CONFIDENCE, instances: int = LEAST_INSTANCES,
            seeds: int = LEAST_SEEDS, doubt: float = DOUBT) -> DataFrame:
    edges = written(met.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    # A pattern seen at too few instances or seeds can never extract, so its edges carry no score either.
    wide = edges.groupBy("pattern").agg(F.count("*").alias("n"), F.sum(F.col("seed").cast("long")).alias("m")).where((F.col("n") >= instances) & (F.col("m") >= seeds)) \
        .select(F.col("pattern").alias("p"), "n")
    edges = written(edges.join(wide, F.col("pattern") == F.col("p")).drop("p"), "edges").withColumn("score", F.col("seed").cast("double"))
    scored = None
    for _ in range(max(rounds, 1)):
        scored = edges.groupBy("pattern").agg((F.sum("score") / (F.max("n") + doubt)).alias("confidence"))
        named = scored.select(F.col("pattern").alias("p"), "confidence")
        belief = edges.join(named, F.col("pattern") == F.col("p")).groupBy("instance") \
            .agg(F.max("seed").alias("sure"), F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-12)))).alias("doubts")) \
            .select(F.col("instance").alias("i"), F.when(F.col("sure"), 1.0).otherwise(1 - F.exp("doubts")).alias("belief"))
        edges = written(edges.join(belief, F.col("instance") == F.col("i")).select("pattern", "instance", "seed", "n", F.col("belief").alias("score")), "edges")
    return scored.where(F.col("confidence") >= least)


def _open_words(documents: DataFrame, text_column: str, marks: DataFrame, trusted: DataFrame, **options) -> DataFrame | None:
    """(digest, start, end) of words of any shape right after two trusted words. Here every word behind the two counts as
    an instance, and of all places of a found word so many must be trusted as a pattern needs confidence. None if none."""
    two = F.col("pattern").startswith("2|")
    known = patterns(marks.where("seed").select("seed", "instance", "before", "after")).where(two).groupBy("pattern").agg(F.countDistinct("instance").alias("m"))
    rest = trusted.where(two).select(F.col("pattern").alias("p"))
    seeds = {r.pattern[2:]: r.m for r in known.join(rest, F.col("pattern") == F.col("p"), "left_semi").collect()}
    contexts = uncrowded(documents, text_column, seeds) if seeds else {}
    if not contexts:
        return None
    words = written(following(documents, text_column, contexts).distinct(), "following")
    if words.isEmpty():
        return None
    columns = ["seed", "instance", "before", "after"]
    kept = _scored(patterns(marks.select(*columns).unionByName(words.select(*columns))).where(two), **options).select(F.col("pattern").alias("p"))
    there = written(words.join(kept, F.concat(F.lit("2|"), "before") == F.col("p"), "left_semi"), "there")
    if there.isEmpty():
        return None
    found = there.groupBy("word").agg(F.count("*").alias("trusted_places")).withColumnRenamed("word", "w")
    # Copies of a text count once, on both sides.
    bare = F.regexp_replace("word", r"""^[(\[{<"'=:,;#]+|[)\]}>"'.,;:!?]+$""", "")
    texts = documents.select(F.col(text_column).cast("string").alias("text")).where("text IS NOT NULL").distinct()
    everywhere = texts.select(F.explode(F.split("text", r"(?U)\s+")).alias("word")).select(bare.alias("word")) \
        .join(found.select("w"), F.col("word") == F.col("w"), "left_semi").groupBy("word").agg(F.count("*").alias("places"))
    least = options.get("least", LEAST_CONFIDENCE)
    sure = found.join(everywhere, F.col("w") == F.col("word")).where(F.col("trusted_places") >= least * F.col("places")).select("w")
    return there.join(sure, F.col("word") == F.col("w"), "left_semi").select("digest", "start", "end")


def find(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """(id, base, spans) per row: base spans, and all spans (kind, start, end) by start, then kind as listed with
    ``context`` last. Spans found by context never overlap a base span. Null texts have no spans; extra columns are left
    out; repeated rows give repeated results (they are one instance to the patterns)."""
    table = written(mentions(documents.select(F.col(id_column), F.col(text_column)), id_column, text_column).withColumn("row", F.monotonically_increasing_id()), "mentions")
    marks = table.select("row", F.explode("marks").alias("m")).select("row", "m.*")
    trusted = trusted_patterns(marks.select("seed", "instance", "before", "after"), **options)
    fresh = patterns(marks.where("NOT seed")).join(trusted.select(F.col("pattern").alias("p")), F.col("pattern") == F.col("p"), "left_semi").select("row", "start", "end").distinct()
    words = _open_words(documents, text_column, marks, trusted, **options)
    if words is not None:
        words = words.withColumnRenamed("digest", "d")
        fresh = fresh.unionByName(table.select("row", "digest").join(words, F.col("digest") == F.col("d")).select("row", "start", "end")).distinct()
    new = fresh.groupBy("row").agg(F.collect_list(F.struct(F.lit(FOUND).alias("kind"), "start", "end")).alias("new")).withColumnRenamed("row", "r")
    # Of a run and a word in it that were both found, the run.
    widest = F.filter("new", lambda s: ~F.exists("new", lambda o: (o["start"] <= s["start"]) & (o["end"] >= s["end"]) & (o["end"] - o["start"] > s["end"] - s["start"])))
    joined = table.join(new.withColumn("new", widest), F.col("row") == F.col("r"), "left")
    rank = F.transform(F.concat("base", F.coalesce("new", F.expr("array()").cast("array<struct<kind:string,start:bigint,end:bigint>>"))),
                       lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in (*KINDS, FOUND)]), s["kind"]).alias("k"), s["kind"].alias("kind"), s["end"].alias("end")))
    spans = F.transform(F.sort_array(rank), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select(F.col("key").alias(id_column), "base", spans.alias("spans"))


def joined_spans(spans: str) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; where spans overlap, the first and its reach."""
    out, at = [], 0
    k = 0
    while k < len(spans):
        kind, start, end = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < end:
            end = max(end, spans[k][2])
            k += 1
        out += [text[at:start], f"<{kind}>"]
        at = end
    return "".join([*out, text[at:]])
