"""Quality counts, personal data, set join and language model against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa

from studyspark.llm.katz import discounts, score
from studyspark.llm.pii import KINDS, base_spans, find, joined_spans, masked
from studyspark.llm.quality import judged, text_counts
from studyspark.llm.set_join import near_duplicates

WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = ["", None, "a", "\n\n", "a\nb\na\n a\na", "x y z " * 9, "é é\né é", "a b c d e f g h a b c d e f g h", "\n", "q\n", " ", "|#*$%&<> |", "w " * 30 + "ü"]


def counts_of(text):
    text = text or ""
    words, seen, doubled = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            doubled += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), doubled, len(covered)


def test_text_counts():
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("ab \n\té") for _ in range(rng.randrange(200))) for _ in range(200)]
    found = text_counts(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        assert counts_of(text) == tuple(int(found[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), text


def test_outliers_of_a_group_are_rejected_and_the_rest_kept(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("aeilnorst") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    def text(n):
        return " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(rng.randrange(25, 400)), "en", f"s{i % 2}") for i in range(700)]
    bad = [(1000, re.sub(" ", "!! ", text(90)).upper(), "en", "s0"), (1001, text(80).replace(" ", " ### "), "en", "s1"), (1002, " ".join(w for x in text(9).split() for w in [x] * 5), "en", "s0")]
    odd = [(2000, None, "en", "s0"), (2001, "", None, None), (2002, text(60), None, None), (2003, text(60), "xx", "s1"), (2004, text(40_000), "en", "s1"), (0, rows[0][1], "en", "s0")]
    table = spark.createDataFrame(rows + bad + odd, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS n_words", "2 AS kept", "3 AS grp", "'z' AS key")
    got = {r.doc_id: r for r in judged(table).collect()}
    assert len(got) == len(rows + bad + odd) - 1
    assert [i for i, *_ in rows if not got[i].kept] == []
    assert not any(got[i].kept for i in (1000, 1001, 1002, 2000, 2001)) and all(got[i].kept for i in (2002, 2003, 2004))
    assert judged(table.limit(0)).count() == 0


PATTERNS = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
            "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def luhn(digits):
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def spans_of(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


def test_base_spans():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("a@.-1 2+()é%01") for _ in range(rng.randrange(60)))
        assert base_spans(text) == spans_of(text), text
    cards = " ".join("4" + "".join(rng.choice("0123456789") for _ in range(rng.randrange(10, 20))) for _ in range(300))
    assert base_spans(cards) == spans_of(cards)
    base_spans("1" * 200_000 + "a" * 200_000 + "@" + "1." * 100_000 + "+1" + " " * 100_000)      # linear in the text


def test_contexts_find_unseen_identifiers(spark):
    docs = [(i, f"say x{i} " + (f"reach me at +1 (234) 555-{i:04d} today" if i % 2 else f"reach me at ZX-{i:05d}-Q today")) for i in range(60)]
    docs += [(1000 + i, f"lot {i:05d}-11 of things") for i in range(50)] + [(5000, None), (5001, ""), (5001, ""), (None, "mail a@b.cd")]
    table = spark.createDataFrame(docs, "doc_id int, text string").selectExpr("*", "1 AS base", "2 AS spans", "3 AS row")
    got = {r.doc_id: r.s for r in find(table).select("doc_id", joined_spans("spans").alias("s")).collect()}
    assert all(got[i] == "context:" + ":".join(map(str, re.search(r"ZX-\S+", docs[i][1]).span())) for i in range(0, 60, 2))
    assert all(got[i].startswith("phone:") and "," not in got[i] for i in range(1, 60, 2))
    assert all(got[1000 + i] == "" for i in range(50)) and got[5000] == got[5001] == "" and got[None] == "email:5:11"
    assert find(table.limit(0)).count() == 0
    assert masked("call a@b.cd or 1.2.3.4", [("email", 5, 11), ("ip", 15, 22)]) == "call <email> or <ip>"


def grams(text, n):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i:i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)] if words else [])


def groups_of(docs, n, percent):
    sets = {k: grams(t, n) for k, t in docs.items()}
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in keys}


def test_set_join_equals_brute_force(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(60)]
    docs = {}
    for family in range(8):
        base = [rng.choice(words) for _ in range(rng.choice([6, 30, 150, 400]))]
        for _ in range(45):
            text = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 25)):
                text[rng.randrange(len(text))] = rng.choice(words)
            docs[len(docs)] = " ".join(text)
    for _ in range(120):
        docs[len(docs)] = " ".join([rng.choice(words) for _ in range(rng.randrange(5, 90))] + passage)      # share a passage only
    for text in ("", None, "One", "one", "one two", "ONE two", "a b c", "x"):
        docs[len(docs)] = text
    for i in range(60):
        docs[len(docs)] = docs[i]
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS size", "3 AS grams", "4 AS digest")
    for n, percent in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(table, n=n, percent=percent).collect()}
        assert got == groups_of(docs, n, percent)
    assert near_duplicates(table.limit(0)).count() == 0
    twice = near_duplicates(spark.createDataFrame([(3, "a b c d e"), (3, "a b c d e"), (None, "a b c d e"), (9, "a b c d e")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in twice) == [(-1, 3), (3, 3), (3, 3), (9, 3)]


def scores_of(docs):
    tokens = {k: WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) + ["</s>"] for k, t in docs.items()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in tokens}
    one, two, first = Counter(), Counter(), Counter()
    for k, words in tokens.items():
        if not held[k]:
            for a, b in zip(["<s>"] + words, words):
                one[b] += 1
                two[a, b] += 1
                first[a] += 1
    total, types = sum(one.values()), len(one)
    d1, d2 = ([0, *discounts([sum(v == r for v in c.values()) for r in range(1, 7)])] for c in (one, two))

    def kept(count, d):
        return count - 0.5 if count > 5 else count * d[count]
    unseen = 1 - sum(kept(c, d1) for c in one.values()) / total

    def p1(w):
        return kept(one[w], d1) / total if w in one else unseen
    seen, lower = Counter(), Counter()
    for (a, b), c in two.items():
        seen[a] += kept(c, d2) / first[a]
        lower[a] += p1(b)

    def weight(a):
        return (1 - seen[a]) / (1 - lower[a])

    def p(a, b):
        return kept(two[a, b], d2) / first[a] if (a, b) in two else weight(a) * p1(b) if first[a] else p1(b)
    for a in first:         # exactly normalised over all words and the unseen symbol
        assert math.isclose(sum(p(a, b) for b in one) + weight(a) * unseen, 1, rel_tol=1e-9)
    return {k: (held[k], len(w), sum(x in one for x in w), total, sum(math.log10((one[x] + 0.5) / (total + 0.5 * (types + 1))) for x in w), sum(math.log10(p(a, b)) for a, b in zip(["<s>"] + w, w))) for k, w in tokens.items()}


def test_katz_equals_brute_force(spark):
    rng = random.Random(6)
    words = [f"W{int(rng.paretovariate(0.7)) % 400}" for _ in range(3000)]
    docs = {i: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) for i in range(150)} | {900: None, 901: "", 902: "new words only"}
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string").selectExpr("*", "1 AS block", "2 AS held", "3 AS id")
    rows, want = score(table).collect(), scores_of(docs)
    assert len(rows) == len(docs)
    for r in rows:
        got, expected = (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score), want[r.doc_id]
        assert got[:4] == expected[:4] and all(math.isclose(a, b, rel_tol=1e-9) for a, b in zip(got[4:], expected[4:])), (r, expected)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) - 0.2 * sum(r.n_tokens for r in held)
    assert score(table.limit(0)).count() == 0
    odd = score(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None)], "doc_id long, text string")).collect()
    assert [r.train_tokens for r in odd] == [7] * 3 or [r.train_tokens for r in odd] == [6] * 3


SPLIT = ["415 555 0132", "(415) 555-0132", "GB29 NWBK 6016 1331 9268 19", "123 45 6789", "123 - 45 - 6789", "jane.roe at example dot com", "jane (at) example (dot) org", "jroe", "mary_k7"]


def test_contexts_find_identifiers_of_any_shape(spark):
    odd = SPLIT + ["noon"]
    docs = [(i, f"say x reach me at +1 (234) 555-{i:04d} today") for i in range(40)]
    docs += [(100 + i, f"say x reach me at {s} today") for i, s in enumerate(odd)] + [(200, f"say x reach me at {SPLIT[0]} today")]
    docs += [(300 + i, f"we eat every day at noon {i}, all of us") for i in range(4)] + [(400, None)]
    got = {r.doc_id: r.spans for r in find(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).select("doc_id", joined_spans("spans").alias("spans")).collect()}
    texts = dict(docs)
    for i, s in [(100 + i, s) for i, s in enumerate(SPLIT)] + [(200, SPLIT[0])]:
        a = texts[i].index(s)
        assert got[i] == f"context:{a}:{a + len(s)}", s
    assert not any(got[i] for i in (100 + len(SPLIT), 300, 301, 302, 303, 400))        # noon stands elsewhere as well


def test_a_context_before_many_plain_words_finds_none_of_them(spark):
    docs = [(i, f"say x reach me at +1 (234) 555-{i:04d} today") for i in range(40)]
    docs += [(100 + i, f"say x reach me at {'ab'[i % 2]}{'cdefghijkl'[i // 2 % 10]}{'mnopqrstuv'[i // 20]} today") for i in range(200)]
    got = {r.doc_id: r.n for r in find(spark.createDataFrame(docs, "doc_id long, text string")).selectExpr("doc_id", "size(spans) AS n").collect()}
    assert all(got[i] == (i < 100) for i, _ in docs)


def test_base_digest_of_no_spans(spark):
    assert hashlib.sha256(b"").hexdigest() == spark.sql("SELECT sha2(cast('' AS binary), 256) AS d").first().d
