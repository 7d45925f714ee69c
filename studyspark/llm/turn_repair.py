"""Repair of conversations: cheapest edits that make the roles follow one another as ``(s?(ua)+)?``.

s, u and a are the initials of system, user and assistant. A row is kept (0), given the role user or assistant (1) or
deleted (2); an empty user or assistant row is inserted anywhere (5); a cut-off row that stays adds 5; blank and
repeated rows must go. The grammar has one string of each length, so turns are aligned to each feasible length by
Wagner-Fischer tables. A table only holds cells through which a way no dearer than the best one so far can lead (a
band as Ukkonen's), and lengths that no such way reaches are left out. Of equal costs the audit (the edits' initials
in order) that is least in ASCII decides: it is traced back through each table, and the audits are compared.

Rows are range-partitioned by conversation and turn, so a conversation of any size is spread over tasks. Up to
``SEGMENT`` rows are aligned at once, to every part of a grammar string between two of its states; such results join to
longer ones by their states, since of two audits of one segment with equal cost none begins with the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from studyspark.session import written

#: Rows aligned at once.
SEGMENT = 64
#: Repeated texts of up to so many kinds are sent to every task (some 100 bytes each); more are joined by a shuffle.
SENT_ROWS = 300_000
RESTORE, REMOVE, ADD, CUT_OFF = 1, 2, 5, 5
#: Grammar states: nothing yet, after s, after u, after a. The pairs that a run of rows can lead from and to.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STATES = ((0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3))
#: The state pairs of a whole conversation.
WHOLE = ((START, START), (START, AFTER_A))
_ROLES = {"u": "user", "a": "assistant"}

Way = tuple[int, str]


def target(first: str, length: int) -> str:
    """The grammar's string of this length that begins with ``first``."""
    return "s" + target("u", length - 1) if first == "s" else ("ua" if first == "u" else "au") * (length // 2) + first * (length % 2)


def _extra(sound: int, cut: int, length: int) -> int:
    """The least cost, beyond removing all cut-off rows, of making ``length`` roles of so many sound and cut-off rows."""
    if length <= sound:
        return REMOVE * (sound - length)
    kept = CUT_OFF - REMOVE
    return kept * (length - sound) if length <= sound + cut else kept * cut + ADD * (length - sound - cut)


def _reach(sound: int, cut: int, extra: int) -> tuple[int, int]:
    """The least and greatest length that ``_extra`` makes for at most ``extra``."""
    kept = extra // (CUT_OFF - REMOVE)
    return max(0, sound - extra // REMOVE), sound + kept if kept <= cut else sound + cut + (extra - (CUT_OFF - REMOVE) * cut) // ADD


def _edit(code: str, role: str) -> tuple[int, str] | None:
    """Cost and audit letter of letting a row stand for a role."""
    low = code.lower()
    stays = CUT_OFF if code != low else 0
    if low == role:
        return stays, "K"
    return (stays + RESTORE, "R") if role in "ua" and code != "x" else None


def aligned(codes: str, first: str, length: int, most: int | None) -> Way | None:
    """The cheapest way to turn rows into the target of one length, and of these the one of the least audit; none if it
    costs more than ``most``. Codes: s, u, a or o (other) for the role, in capitals if cut off; x for rows that must go."""
    n, roles, none = len(codes), target(first, length), 1 << 60
    sound, cut = [0], [0]
    for c in codes:
        sound.append(sound[-1] + (c in "suao"))
        cut.append(cut[-1] + (c in "SUAO"))
    free = REMOVE * (n - sound[n])                  # what removing all that may go free costs
    extra = none if most is None else most - free
    bands = []
    for i in range(n + 1):
        low, high = 0, length
        if most is not None:
            a, b = _reach(sound[i], cut[i], extra)
            c, d = _reach(sound[n] - sound[i], cut[n] - cut[i], extra)
            low, high = max(0, a, length - d), min(length, b, length - c)
        bands.append((low, high))
    rest: list[list[int]] = [[] for _ in range(n + 1)]     # rest[i][j - low]: cost from row i and role j to the end
    for i in range(n, -1, -1):
        low, high = bands[i]
        row = [none] * max(high - low + 1, 0)
        below, under = (bands[i + 1], rest[i + 1]) if i < n else ((0, -1), [])
        for j in range(high, low - 1, -1):
            best = 0 if i == n and j == length else none
            if below[0] <= j <= below[1]:
                best = min(best, REMOVE + under[j - below[0]])
            if j < length:
                if below[0] <= j + 1 <= below[1] and (stands := _edit(codes[i], roles[j])):
                    best = min(best, stands[0] + under[j + 1 - below[0]])
                if j < high and roles[j] != "s":
                    best = min(best, ADD + row[j + 1 - low])
            row[j - low] = best
        rest[i] = row

    def cost(i: int, j: int) -> int:
        low, high = bands[i]
        return rest[i][j - low] if low <= j <= high else none
    total = cost(0, 0)
    if total >= none or (most is not None and total > most):
        return None
    i, j, letters = 0, 0, []
    while (i, j) != (n, length):                    # letters in ASCII order: D, I, K, R
        now, stands = cost(i, j), _edit(codes[i], roles[j]) if i < n and j < length else None
        if i < n and now == REMOVE + cost(i + 1, j):
            letter, i = "D", i + 1
        elif j < length and roles[j] != "s" and now == ADD + cost(i, j + 1):
            letter, j = "I", j + 1
        else:
            letter, i, j = stands[1], i + 1, j + 1
        letters.append(letter)
    return total, "".join(letters)


def _cheapest(codes: str, first: str, lengths: list[range], best: Way | None) -> Way | None:
    """The least (cost, audit) over all lengths in the ranges, and over ``best``, a way already known."""
    n, sound, cut = len(codes), sum(c in "suao" for c in codes), sum(c in "SUAO" for c in codes)
    if first == "s" and not any(c in "sS" for c in codes):
        return best
    free = REMOVE * (n - sound)
    distance, more = 0, True
    while more:                                     # from the length that costs least, outwards on both sides
        more = False
        for length in {sound - distance, sound + distance}:
            if length < 0 or (best and free + _extra(sound, cut, length) > best[0]):
                continue
            more = True
            if any(length in r for r in lengths) and (way := aligned(codes, first, length, best and best[0])):
                best = min(best, way) if best else way
        distance += 1
    return best


_ENDLESS = 1 << 40


@lru_cache(maxsize=1 << 16)
def repaired_whole(codes: str) -> Way:
    """The least (cost, audit) of a whole conversation."""
    best = _cheapest(codes, "u", [range(2, _ENDLESS, 2)], (REMOVE * len(codes), "D" * len(codes)))
    return _cheapest(codes, "s", [range(3, _ENDLESS, 2)], best)


@lru_cache(maxsize=1 << 14)
def segment_ways(codes: str) -> tuple[Way | None, ...]:
    """The least (cost, audit) of a run of rows between each pair of ``STATES``."""
    gone = REMOVE * len(codes), "D" * len(codes)
    odd, even = range(1, _ENDLESS, 2), range(2, _ENDLESS, 2)
    u_odd, u_even = _cheapest(codes, "u", [odd], None), _cheapest(codes, "u", [even], None)
    a_odd, a_even = _cheapest(codes, "a", [odd], None), _cheapest(codes, "a", [even], None)
    ways = {(0, 1): [_cheapest(codes, "s", [range(1, 2)], None) if any(c in "sS" for c in codes) else None],
            (0, 2): [u_odd, _cheapest(codes, "s", [even], None)], (0, 3): [u_even, _cheapest(codes, "s", [range(3, _ENDLESS, 2)], None)],
            (0, 0): [gone], (1, 1): [gone], (1, 2): [u_odd], (1, 3): [u_even], (2, 2): [gone, a_even], (2, 3): [a_odd], (3, 2): [u_odd], (3, 3): [gone, u_even]}
    return tuple(min((w for w in ways[pair] if w), default=None) for pair in STATES)


def joined(left: tuple[Way | None, ...], right: tuple[Way | None, ...]) -> tuple[tuple[Way | None, ...], tuple[int, ...]]:
    """The ways of two neighbouring runs of rows, and the state between them for each pair of states."""
    out, between = [], []
    for a, b in STATES:
        options = [((left[i][0] + right[k][0], left[i][1] + right[k][1]), m) for i, (p, m) in enumerate(STATES) if p == a and left[i]
                   for k, (q, r) in enumerate(STATES) if (q, r) == (m, b) and right[k]]
        way, state = min(options, default=(None, -1))
        out.append(way)
        between.append(state)
    return tuple(out), tuple(between)


def run_ways(codes: str) -> tuple[Way | None, ...]:
    """The ways of any number of rows."""
    ways = [segment_ways(codes[at:at + SEGMENT]) for at in range(0, len(codes), SEGMENT)]
    while len(ways) > 1:
        ways = [joined(*ways[k:k + 2])[0] if k + 1 < len(ways) else ways[k] for k in range(0, len(ways), 2)]
    return ways[0]


def repaired(codes: str) -> Way:
    if len(codes) <= SEGMENT:
        return repaired_whole(codes)
    ways = run_ways(codes)
    return min(w for pair, w in zip(STATES, ways) if pair in WHOLE and w)


def script(codes: str, audit: str, state: int) -> list[str]:
    """What each row becomes: letters of the roles it leaves, K where it keeps its own, capitals where it gets one, small
    letters for rows inserted before it (or after the last one)."""
    out, now, i = ["" for _ in codes], "", 0
    for letter in audit:
        role = "u" if state in (START, AFTER_S, AFTER_A) else "a"
        if letter == "I":
            now += role
        elif letter == "D":
            out[i], now, i = now, "", i + 1
        else:
            if letter == "K":
                role = codes[i].lower()
            out[i], now, i = now + ("K" if letter == "K" else role.upper()), "", i + 1
        if letter != "D":
            state = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}[role]
    if now and out:
        out[-1] += now
    return out


def _messages(step: str, role: str, text: str) -> Iterator[tuple[str, str]]:
    for letter in step:
        if letter == "K":
            yield role, text
        else:
            yield _ROLES[letter.lower()], text if letter.isupper() else ""


def _code(role: str, text_fault: str | None) -> str:
    if text_fault in ("blank", "duplicate"):
        return "x"
    low = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return low.upper() if text_fault == "truncated" else low


_LEGAL = {"su", "ua", "au"}
#: What a run of rows of one conversation in one task is known by, besides its ways.
_FACTS = ("least_turn", "most_turn", "turns", "blank", "duplicate", "truncated", "illegal")


class _Run:
    """Rows of one conversation that follow one another in one task."""

    def __init__(self) -> None:
        self.rows: list[tuple[str, str]] = []
        self.codes: list[str] = []
        self.turn = self.least_turn = None
        self.turns = self.illegal = 0
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if self.rows and self.rows[-1][0][:1] + role[:1] not in _LEGAL:
            self.illegal += 1
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.turn, self.least_turn = turn, turn if self.least_turn is None else self.least_turn
        if fault:
            self.faults[fault] += 1
        self.rows.append((role, text))
        self.codes.append(_code(role, fault))

    def facts(self) -> tuple:
        return self.least_turn, self.turn, self.turns, self.faults["blank"], self.faults["duplicate"], self.faults["truncated"], self.illegal


def _fault(text: Column, first: Column) -> Column:
    """The row's first fault, null if it has none. Spaces are the space and the controls 9 to 13."""
    return F.when(~text.rlike("[^\\x20\\x09-\\x0D]"), "blank").when(~first, "duplicate").when(~text.rlike("[.!?][\\x20\\x09-\\x0D]*\\z"), "truncated")


def _marked(rows: DataFrame) -> DataFrame:
    """(id, turn, role, text, fault, row): a row is a duplicate if an earlier one of its conversation has its role and text."""
    rows = written(rows.select("id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
                   .select("*", F.md5(F.col("text").cast("binary")).alias("digest"), F.monotonically_increasing_id().alias("row")), "turns")
    # Of a hot text only its first row and a count reach the shuffle from each task.
    seen = rows.groupBy("id", "role", "digest").agg(F.count("*").alias("n"), F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn", "row")).alias("first"))
    repeated = written(seen.where("n > 1").select(F.col("id").alias("_id"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), F.col("first.row").alias("_row")), "repeated_turns")
    if repeated.count() <= SENT_ROWS:
        repeated = F.broadcast(repeated)
    found = rows.join(repeated, F.col("id").eqNullSafe(F.col("_id")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest")), "left")
    return found.select("id", "turn", "role", "text", "digest", "row", _fault(F.col("text"), F.col("_row").isNull() | (F.col("_row") == F.col("row"))).alias("fault"))


def _ordered(marked: DataFrame) -> DataFrame:
    """Rows by conversation, turn (nulls first), role and text, in ranges of partitions. Their number decides among equals, so
    that one conversation, turn or text can spread over any number of partitions."""
    order = [F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("row")]
    return marked.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "turn", "role", "text", "fault")


_WAYS = ArrayType(StructType([StructField("cost", LongType()), StructField("audit", StringType())]))


def _schema(rows: DataFrame) -> StructType:
    """kind 0: a conversation whose rows lie in one task; 1: the part of one in a task that may have others; 2: a row of such a
    part, with what it becomes for each pair of states; 3: a repaired row of a conversation of kind 0."""
    return StructType([StructField("kind", IntegerType()), rows.schema["id"], StructField("part", IntegerType()), *[StructField(f, LongType()) for f in _FACTS],
                       StructField("cost", LongType()), StructField("audit", StringType()), StructField("sha256", StringType()), StructField("ways", _WAYS),
                       StructField("first", StringType()), StructField("last", StringType()), StructField("at", LongType()), StructField("role", StringType()),
                       StructField("text", StringType()), StructField("steps", ArrayType(StringType()))])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, _Run, bool]]:
    """(id, run, whether it is the first or last one of the task)."""
    key, run, edge = None, None, True
    for batch in batches:
        for row_key, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if run is None or row_key != key:
                if run is not None:
                    yield key, run, edge
                    edge = False
                key, run = row_key, _Run()
            run.add(*row)
    if run is not None:
        yield key, run, True


def _repaired_in_tasks(ordered: DataFrame, keep_rows: bool) -> DataFrame:
    schema = _schema(ordered)
    names, types = schema.names, {}

    def rows_of(key: object, run: _Run, edge: bool, part: int) -> Iterator[dict]:
        codes = "".join(run.codes)
        shared = {"id": key, "part": part}
        if not edge:
            cost, audit = repaired(codes)
            messages = [m for step, (role, text) in zip(script(codes, audit, START), run.rows) for m in _messages(step, role, text)]
            yield {"kind": 0, **shared, **dict(zip(_FACTS, run.facts())), "cost": cost, "audit": audit, "sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest()}
            if keep_rows:
                yield from ({"kind": 3, **shared, "at": at, "role": r, "text": t} for at, (r, t) in enumerate(messages))
            return
        ways = run_ways(codes)
        yield {"kind": 1, **shared, **dict(zip(_FACTS, run.facts())), "first": run.rows[0][0][:1], "last": run.rows[-1][0][:1],
               "ways": [w and {"cost": w[0], "audit": w[1]} for w in ways]}
        steps = [w and script(codes, w[1], a) for (a, _), w in zip(STATES, ways)]
        for at, (role, text) in enumerate(run.rows):
            yield {"kind": 2, **shared, "at": at, "role": role, "text": text, "steps": [s and s[at] for s in steps]}

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(held, schema=pa.schema([(n, types[n]) for n in names]))
        part = TaskContext.get().partitionId()

        def typed(all_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in all_:
                types.setdefault("id", batch.schema.field(0).type)
                yield batch
        types.update({n: pa.string() for n in ("audit", "sha256", "first", "last", "role", "text")} | {n: pa.int64() for n in (*_FACTS, "cost", "at")}
                     | {"kind": pa.int32(), "part": pa.int32(), "steps": pa.list_(pa.string()), "ways": pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))})
        for key, run, edge in _runs(typed(batches)):
            for row in rows_of(key, run, edge, part):
                held.append(row)
                size += len(row.get("text") or "") + len(row.get("audit") or "") + 200
                if size > 1 << 22:
                    yield emit()
                    held, size = [], 0
        if held:
            yield emit()

    return ordered.mapInArrow(run_all, schema)


def _combined(parts: DataFrame) -> DataFrame:
    """One row per part of a conversation: id, part, pair (index of the part's pair of states); its first part has the facts, cost
    and audit of the whole conversation. A group has a row per task at most."""
    schema = StructType([parts.schema["id"], StructField("part", IntegerType()), StructField("pair", IntegerType()), *[StructField(f, LongType()) for f in _FACTS],
                         StructField("cost", LongType()), StructField("audit", StringType())])

    def combine(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        ways = [tuple(w and (w["cost"], w["audit"]) for w in r["ways"]) for r in rows]
        steps, total = [], ways[0]
        for w in ways[1:]:
            total, between = joined(total, w)
            steps.append(between)
        cost, audit, pair = min((total[k][0], total[k][1], pair) for k, pair in enumerate(STATES) if pair in WHOLE and total[k])
        pairs, (start, end) = [], pair
        for between in reversed(steps):
            state = between[STATES.index((start, end))]
            pairs.append(STATES.index((state, end)))
            end = state
        pairs.append(STATES.index((start, end)))
        facts = {f: sum(r[f] for r in rows) for f in ("turns", "blank", "duplicate", "truncated", "illegal")}
        turns = [r["least_turn"] for r in rows if r["least_turn"] is not None] + [r["most_turn"] for r in rows if r["most_turn"] is not None]
        facts |= {"least_turn": min(turns, default=None), "most_turn": max(turns, default=None)}
        for a, b in zip(rows, rows[1:]):
            facts["illegal"] += a["last"] + b["first"] not in _LEGAL
            facts["turns"] -= a["most_turn"] is not None and a["most_turn"] == b["least_turn"]
        out = [{"id": r["id"], "part": r["part"], "pair": p} for r, p in zip(rows, reversed(pairs))]
        out[0] |= facts | {"cost": cost, "audit": audit}
        return pa.Table.from_pylist(out, schema=pa.schema([table.schema.field("id"), ("part", pa.int32()), ("pair", pa.int32()), *[(f, pa.int64()) for f in _FACTS], ("cost", pa.int64()), ("audit", pa.string())]))

    return parts.select("id", "part", *_FACTS, "first", "last", "ways").groupBy("id").applyInArrow(combine, schema)


def _digests(rows: DataFrame) -> DataFrame:
    """(id, sha256) of the repaired rows of each conversation. They stream through in order, so a long conversation is never held."""
    schema = StructType([rows.schema["id"], StructField("sha256", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, kind = None, None, None
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for row_key, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or row_key != key:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state = row_key, hashlib.sha256(f"{role}:{text}".encode())
                else:
                    state.update(f"\n{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), pa.array([d for _, d in done])], names=schema.names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([state.hexdigest()])], names=schema.names)

    return rows.repartition("id").sortWithinPartitions("id", "part", "at", "step").select("id", "role", "text").mapInArrow(run, schema)


def repair(conversations: DataFrame, id_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text",
           keep_rows: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(audits, repaired rows). Audits, one row per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. Repaired rows, only with ``keep_rows``: id, part, at, step (these order them), role, text.

    Null roles and texts are one space; null ids are one conversation; null turns come first. Rows of equal turn are taken by
    role and then by the text's MD5, so a repeated row follows its like and is a duplicate. A role other than system, user or
    assistant counts by its first letter; one that fits nothing is given another role or deleted. Other columns are ignored;
    an empty table gives no row.
    """
    rows = conversations.select(F.col(id_column).alias("id"), F.col(turn_column).cast("long").alias("turn"), F.col(role_column).cast("string").alias("role"), F.col(text_column).cast("string").alias("text"))
    done = written(_repaired_in_tasks(_ordered(_marked(rows)), keep_rows), "repaired")
    combined = written(_combined(done.where("kind = 1")), "combined")
    # The first and the last conversation of each task, so the table follows the number of tasks.
    pairs = F.broadcast(combined.select(F.col("id").alias("_id"), F.col("part").alias("_part"), "pair"))
    chosen = done.where("kind = 2").join(pairs, F.col("id").eqNullSafe(F.col("_id")) & (F.col("part") == F.col("_part"))) \
        .select("id", "part", "at", "role", "text", F.posexplode(F.split(F.get("steps", F.col("pair")), "(?<=.)(?=.)")).alias("step", "letter")).where("letter <> ''")
    parts = written(chosen.select("id", "part", "at", "step", F.when(F.col("letter") == "K", F.col("role")).when(F.lower("letter") == "u", "user").otherwise("assistant").alias("role"),
                                  F.when(F.col("letter") == F.upper("letter"), F.col("text")).otherwise("").alias("text")), "spread_rows")
    empty = hashlib.sha256(b"").hexdigest()
    digests = _digests(parts).select(F.col("id").alias("_id"), "sha256")
    spread = combined.where("audit is not null").join(digests, F.col("id").eqNullSafe(F.col("_id")), "left").select("id", *_FACTS, "cost", "audit", F.coalesce("sha256", F.lit(empty)).alias("sha256"))
    audits = done.where("kind = 0").select("id", *_FACTS, "cost", "audit", "sha256").unionByName(spread).select(
        F.col("id").alias(id_column), F.coalesce(F.col("most_turn") - F.col("least_turn") + 1 - F.col("turns"), F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.col("sha256").alias("repaired_sha256"))
    if not keep_rows:
        return audits, None
    whole = done.where("kind = 3").select("id", "part", "at", F.lit(0).alias("step"), "role", "text")
    return audits, whole.unionByName(parts).withColumnRenamed("id", id_column)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 removes its
    full stops, exclamation and question marks, 3 repeats it, 4 sets its role to user. Nulls count as one space."""
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    rows = rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
                       F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"))


def with_missing(audits: DataFrame, conversations: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """Audits with a row of zeros, an empty audit and the digest of nothing for each conversation that has no audit."""
    ids = conversations.select(F.col(id_column).alias("_id")).distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return ids.join(audits, F.col("_id").eqNullSafe(F.col(id_column)), "left").select(
        F.col("_id").alias(id_column), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
