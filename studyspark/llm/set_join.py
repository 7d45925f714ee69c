"""Near-duplicate texts by Jaccard similarity of word n-grams: an exact join that skips by set relations.

Equal sets are one class. Sets too rare in what they share with others are ruled out from a part of their grams;
for the rest, an index lists each gram's sets by the gram's position in the rarest-first order of each set. In a list
the set with the fewest rarer grams leads: its answers are computed, and those of sets highly similar to it follow,
as they are linked through it. Only pairs across components are then compared, skipping the blocks of a list that
length, position or the distances to the leader rule out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from studyspark.llm.batches import bytes_of, lowered, mix, sliced, span_hashes, window_hashes, word_bounds
from studyspark.llm.components import components
from studyspark.session import written

#: Share of all hashes that the first pass looks at. It must exceed what two linked sets may differ by.
FIRST_PASS = 0.25
#: Survivors of the first pass up to this number are sent to every task (a few bytes each); more are joined.
SENT_IDS = 1_000_000


def gram_sets(column: pa.Array, n: int) -> list[np.ndarray]:
    """The distinct hashed n-grams of each text, ascending, as signed integers; a text of fewer words is one gram."""
    data, offsets = bytes_of(column)
    data = lowered(data)
    starts, ends, rows = word_bounds(data, offsets)
    words = span_hashes(data, starts, ends)
    out = []
    for a, b in zip(rows[:-1], rows[1:]):
        own = words[a:b]
        grams = window_hashes(own, n) if b - a >= n else mix(window_hashes(own, b - a) + np.uint64(b - a)) if b > a else own
        out.append(np.unique(grams.view(np.int64)))
    return out


def _features(documents: DataFrame, n: int) -> DataFrame:
    """(id, size, digest, some) per row; some: the grams that the first pass looks at."""
    schema = StructType([documents.schema["id"], StructField("size", LongType()), StructField("digest", BinaryType()), StructField("some", ArrayType(LongType()))])
    top = np.int64(int(FIRST_PASS * 2**64) - 2**63)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sets = gram_sets(batch.column("text"), n)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([s[:np.searchsorted(s, top)] for s in sets], pa.list_(pa.int64()))], names=schema.names)

    return documents.mapInArrow(run, schema)


def _whole_sets(documents: DataFrame, n: int) -> DataFrame:
    """(id, size, grams) per row."""
    schema = StructType([documents.schema["id"], StructField("size", LongType()), StructField("grams", ArrayType(LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            sets = gram_sets(batch.column("text"), n)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=schema.names)

    return documents.mapInArrow(run, schema)


def _survivors(features: DataFrame, percent: int) -> DataFrame:
    """Ids, one per class, that may have a link to another class: not too many of their grams are theirs alone."""
    first = features.where("size > 0").groupBy("digest").agg(F.min("id").alias("id")).where("id IS NOT NULL")
    classes = features.join(first, ["digest", "id"], "left_semi")
    alone = classes.select("id", F.explode("some").alias("gram")).groupBy("gram").agg(F.count("*").alias("n"), F.min("id").alias("only")) \
        .where("n = 1").groupBy("only").agg(F.count("*").alias("alone"))
    return classes.join(alone, F.col("id") == F.col("only"), "left").where(f"coalesce(alone, 0) <= size - ({percent} * size + 99) div 100").select("id").distinct()


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """(gram, id, size, at): the grams by which linked sets meet, and their position when a set's grams are ordered from
    the rarest. Sets that share too little with all others together have none."""
    tokens = sets.select("id", "size", F.explode("grams").alias("gram"))
    often = tokens.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select(F.col("gram").alias("g"), "n")
    shared = tokens.join(often, F.col("gram") == F.col("g")).groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("order"))
    shared = shared.where(f"size(order) >= ({percent} * size + 99) div 100")
    # The grams of no other set come first; a linked set meets this one within its first size - least + 1 grams.
    prefix = F.expr(f"slice(order, 1, cast(greatest(size - ({percent} * size + 99) div 100 + 1 - (size - size(order)), 0) AS int))")
    return shared.select("id", "size", (F.col("size") - F.size("order")).alias("before"), F.posexplode(prefix).alias("k", "o")) \
        .select("id", "size", (F.col("before") + F.col("k")).alias("at"), F.col("o.gram").alias("gram"))


def _may_link(size1: str, at1: str, size2: str, at2: str, percent: int) -> Column:
    """Whether two sets can link if the list's gram is the first they share: by position and, through it, by length."""
    return F.expr(f"{100 + percent} * least({size1} - {at1}, {size2} - {at2}) >= {percent} * ({size1} + {size2})")


def _similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, shared, size1, size2) for pairs (a, b)."""
    left = sets.select(F.col("id").alias("i"), F.col("grams").alias("grams1"))
    right = sets.select(F.col("id").alias("j"), F.col("grams").alias("grams2"))
    both = pairs.join(left, F.col("a") == F.col("i")).join(right, F.col("b") == F.col("j")).select("a", "b", "grams1", "grams2")
    schema = StructType([both.schema["a"], both.schema["b"], *[StructField(c, LongType()) for c in ("shared", "size1", "size2")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.asarray(batch.column(k).values) for k in (2, 3))
            bounds = [np.asarray(batch.column(k).offsets) for k in (2, 3)]
            shared = [len(np.intersect1d(left[a:b], right[c:d], assume_unique=True)) for a, b, c, d in zip(bounds[0][:-1], bounds[0][1:], bounds[1][:-1], bounds[1][1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.int64()),
                                              pa.array(np.diff(bounds[0]), pa.int64()), pa.array(np.diff(bounds[1]), pa.int64())], names=schema.names)

    return both.mapInArrow(run, schema)


def similar_links(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between ``sets`` (id, size, grams) with 100 * shared >= percent * union: enough of them to join all
    that are linked, and no pair below."""
    linked = F.expr(f"100 * shared >= {percent} * (size1 + size2 - shared)")
    lists = written(_postings(sets, percent), "lists")
    lead = lists.groupBy("gram").agg(F.min(F.struct("at", "id", "size")).alias("lead"), F.count("*").alias("n")).where("n > 1") \
        .select(F.col("gram").alias("g"), F.col("lead.at").alias("at1"), F.col("lead.id").alias("leader"), F.col("lead.size").alias("size1"))
    led = written(lists.join(lead, F.col("gram") == F.col("g")).select("gram", "id", "size", "at", "leader", "at1", "size1"), "led")
    pairs = led.where("id <> leader").where(_may_link("size", "at", "size1", "at1", percent)).select(F.col("leader").alias("a"), F.col("id").alias("b")).distinct()
    known = written(_similarities(pairs, sets), "known")
    first = known.where(linked).select("a", "b")
    label = written(components(first, "a", "b"), "labels")

    # What the leaders' answers leave open: pairs of one list in different components.
    known = known.select(F.col("a").alias("l"), F.col("b").alias("x"), (1 - F.col("shared") / (F.col("size1") + F.col("size2") - F.col("shared"))).alias("d"))
    rest = led.join(label, F.col("id") == F.col("node"), "left").join(known, (F.col("leader") == F.col("l")) & (F.col("id") == F.col("x")), "left") \
        .select("gram", "id", "size", "at", F.coalesce("component", "id").alias("comp"), F.when(F.col("id") == F.col("leader"), 0.0).otherwise(F.col("d")).alias("d"))
    parts = rest.groupBy("gram", "comp").agg(F.count("*").alias("n"))
    main = parts.groupBy("gram").agg(F.max(F.struct("n", "comp")).alias("m"), F.count("*").alias("k")).where("k > 1").select(F.col("gram").alias("g"), F.col("m.comp").alias("main"))
    rest = written(rest.join(main, F.col("gram") == F.col("g")).select("gram", "id", "size", "at", "comp", "d", (F.col("comp") == F.col("main")).alias("in_main")), "rest")
    minor = rest.where("NOT in_main").select(F.col("gram").alias("g"), F.col("id").alias("i"), F.col("size").alias("size1"), F.col("at").alias("at1"), F.col("comp").alias("comp1"), F.col("d").alias("d1"))
    apart = 1 - percent / 100 + 1e-9
    across = minor.join(rest, (F.col("g") == F.col("gram")) & (F.col("comp1") != F.col("comp")) & (F.col("in_main") | (F.col("i") < F.col("id")))
                        & _may_link("size", "at", "size1", "at1", percent) & F.expr(f"coalesce(abs(d - d1), 0) <= {apart}"))
    more = _similarities(across.select(F.least("i", "id").alias("a"), F.greatest("i", "id").alias("b")).distinct(), sets).where(linked).select("a", "b")
    return first.unionByName(more)


def near_duplicates(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", n: int = 4, percent: int = 85) -> DataFrame:
    """Per row: the id, n_shingles (the size of its set of distinct n-grams of lower-cased words) and component_id, the
    smallest id that links reach. Rows link when their sets' intersection is at least ``percent`` hundredths of the union.

    A text without words, or null, has an empty set and links with nothing. Rows of one id with different texts are told
    apart: each links by its own set. A row whose id is null takes the component of its class and is no other's smallest id.
    Extra columns are left out.
    """
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    features = written(_features(rows, n), "features")
    if not isinstance(rows.schema["id"].dataType, StructType) and not features.where("id IS NOT NULL").groupBy("id") \
            .agg(F.min(F.xxhash64("digest")).alias("a"), F.max(F.xxhash64("digest")).alias("b")).where("a <> b").isEmpty():
        # Ids with several sets: nodes are pairs of id and text, which compare by id first.
        node = F.when(F.col("id").isNotNull(), F.struct("id", F.md5(F.col("text").cast("binary")).alias("text")))
        return near_duplicates(rows.select(node.alias(id_column), F.col("text").alias(text_column)), id_column, text_column, n, percent) \
            .select(F.col(id_column)["id"].alias(id_column), "n_shingles", F.col("component_id")["id"].alias("component_id"))
    alive = written(_survivors(features, percent), "alive")
    chosen = rows.join(F.broadcast(alive) if alive.count() <= SENT_IDS else alive, "id", "left_semi")
    sets = written(_whole_sets(chosen, n).where("size > 0").distinct(), "sets")
    label = components(similar_links(sets, percent), "a", "b")
    copies = features.where("size > 0").groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("d"), "first")
    firsts = features.select("id", "size", F.when(F.col("size") > 0, F.col("digest")).alias("digest")).join(copies, F.col("digest") == F.col("d"), "left") \
        .select("id", "size", F.coalesce("first", "id").alias("rep"))
    return firsts.join(label, F.col("rep") == F.col("node"), "left").select(
        F.col("id").alias(id_column), F.col("size").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))
