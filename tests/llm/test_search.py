"""Lexical search, conversation repair and nearest vectors against brute force."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortspark.llm import neighbours, repair, search

FOLD = {c: c + 32 for c in range(65, 91)}
PATTERN = re.compile(search.TERM)


# --- lexical search -------------------------------------------------------------------

def bm25(rows, items, k=10):
    bags = [(i, Counter(PATTERN.findall((t or "").translate(FOLD)))) for i, t in rows]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(PATTERN.findall((t or "").translate(FOLD)))
    out = []
    for item, terms in asked.items():
        scored = []
        for doc, bag in bags:
            m = 10 + 90 * sum(bag.values()) * n_docs // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * bag[t] // (1000 * bag[t] + 8 * m)) for t in terms if t in bag)
            if score > 0:
                scored.append((-score, doc is None, doc))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "naïve", "中文", "Ab1"]
    some = lambda n: " ".join(rng.choice(words) + rng.choice(["", ",", ".", "\x00", "\n"]) for _ in range(n))
    rows = [(i, some(rng.randint(0, 60))) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(90)] + [(i, rows[7][1]) for i in range(-40, 0)]  # a large class of copies
    rows += [(500, None), (501, ""), (502, " .,- "), (503, some(40_000)), (504, rows[7][1].upper()), (None, rows[7][1]), (None, rows[9][1]), (3, "w1 w2"), (3, "w1 w2")]
    items = [(i, some(rng.randint(1, 12))) for i in range(20)] + [(40, None), (41, "..."), (42, "nowhere at all"), (43, "w1"), (43, "w2"), (None, "w3 Ärger"), (44, rows[7][1])]
    return rows, items


def test_search(spark, docs, monkeypatch):
    rows, items = texts()
    table = docs(rows).repartition(7)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"term": F.lit("x"), "block": F.lit(1)})
    want = bm25(rows, items)
    assert sorted(map(tuple, search.ranked(table, asked).collect()), key=str) == want
    monkeypatch.setattr(search, "ITEM_BYTES", 900)  # several blocks of items
    monkeypatch.setattr(search, "SCORES", 64)  # classes in small steps
    monkeypatch.setattr(search, "EXACT", 0)  # whole-number sums
    assert sorted(map(tuple, search.ranked(table, asked).collect()), key=str) == want


def test_search_of_empty_tables(spark, docs):
    rows, items = texts()
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert search.ranked(docs([]), asked).count() == 0
    assert search.ranked(docs(rows[:5]), asked.limit(0)).count() == 0
    assert search.ranked(docs([(1, None), (2, "")]), asked).count() == 0


def test_words_that_share_a_hash(monkeypatch):
    """Terms are told apart by their bytes, not by their hash."""
    monkeypatch.setattr(search, "range_hash", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    words = search.Vocabulary(["ab", "cd", "abc"])
    data = np.frombuffer(b"cdabcxabab", np.uint8)
    found = words.find(data, np.array([0, 2, 5, 6, 8]), np.array([2, 5, 6, 8, 10]))
    assert found.tolist() == [2, 1, -1, 0, 0]


# --- conversation repair --------------------------------------------------------------

def cheapest(codes, costs=repair.Costs()):
    """All edit strings by a plain search: the cheapest, then the ASCII-least."""
    best = {repair.START: (0, "", "")}

    def widen(best):
        for _ in range(3):
            for s, (c, a, t) in list(best.items()):
                to = repair._next(s)
                way = (c + costs.insert, a + "I", t + "ua"[to == repair.ASSISTANT])
                best[to] = min(best.get(to, way), way)
        return best

    for code in codes:
        role, fault = code >> 2, code & 3
        new = {}

        def offer(s, way):
            new[s] = min(new.get(s, way), way)

        for s, (c, a, t) in widen(best).items():
            offer(s, (c + costs.delete, a + "D", t + "-"))
            if fault in (repair.BLANK, repair.DUPLICATE):
                continue
            worse = costs.truncated if fault == repair.TRUNCATED else 0
            to = {(0, 0): 1, (1, 0): 2, (1, 1): 2, (1, 3): 2, (2, 2): 3}.get((role, s))
            if to:
                offer(to, (c + worse, a + "K", t + "="))
            offer(repair._next(s), (c + worse + costs.rerole, a + "R", t + "ua"[repair._next(s) == 3]))
        best = new
    widen(best)
    return min(best[s] for s in (repair.START, repair.ASSISTANT) if s in best)


@pytest.mark.parametrize("costs", [repair.Costs(), repair.Costs(insert=1, delete=3), repair.Costs(2, 2, 2, 1), repair.Costs(insert=2, truncated=0)])
def test_plan(costs):
    rng = random.Random(1)
    for codes in itertools.chain(itertools.product(range(16), repeat=2), ([rng.choice([4, 8, rng.randrange(16)]) for _ in range(rng.randint(0, 12))] for _ in range(400))):
        assert repair.plan(list(codes), costs) == cheapest(codes, costs), codes


def test_long_runs():
    codes = [4] * 1000 + [8] * 777 + [15] * 300 + [4, 8] * 500
    assert repair.plan(codes) == cheapest(codes)


def repaired_by_hand(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv),
                       key=lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256((r[2] if r[2] is not None else " ").encode()).hexdigest(),
                                      hashlib.sha256((r[3] if r[3] is not None else " ").encode()).hexdigest()))
        seen, codes, texts, roles = set(), [], [], []
        for _, _, role, text in turns:
            role, text = " " if role is None else role, " " if text is None else text
            body = text.rstrip(repair.SPACES)
            fault = 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0
            seen.add((role, text))
            codes.append("sua".find(role[:1]) % 4 * 4 + fault if role else 12 + fault)
            texts.append(text)
            roles.append(role)
        cost, audit, to = cheapest(codes)
        lines, row = [], 0
        for edit, t in zip(audit, to):
            role = {"u": "user", "a": "assistant", "=": roles[row] if row < len(roles) else None, "-": None}[t]
            if edit != "D":
                lines.append(f"{role}:{'' if edit == 'I' else texts[row]}")
            row += edit != "I"
        pairs = [("sua "[a >> 2] + "sua "[b >> 2]) in ("su", "ua", "au") for a, b in zip(codes, codes[1:])]
        known = [r[1] for r in turns if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, *[sum(c & 3 == f for c in codes) for f in (1, 2, 3)], pairs.count(False), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize("bits", [16, 2])
def test_repair(spark, monkeypatch, bits):
    """Conversations of every kind, also when each is cut into blocks of four turns."""
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)
    rng = random.Random(8)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", None, ""], ["Yes.", "No!", "cut", "", " \t\n", None, "a\nb?", "é."]
    rows = [(c, rng.choice([None, *range(-2, 12)]), rng.choice(roles), f"{rng.choice(texts)}{rng.choice(['', '.', 'x.'])}" if rng.random() < 0.8 else rng.choice(texts))
            for c in [*range(25), None] for _ in range(rng.randint(1, 14))]
    rows += [(90, i, "ua"[i % 2] if i % 7 else "user", f"turn {i}.") for i in range(900)]  # a hot conversation
    rows += [(91, 5, "user", "again")] * 6 + [(92, 0, "user", "long. " * 100_000), (92, 1, "assistant", "ok.")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"block": F.lit(1), "at": F.lit("x"), "conv": F.lit(None).cast("int")})
    edited, summary = repair.repaired(table.repartition(5))
    got = {r[0]: tuple(r[1:]) for r in repair.report(table, summary, repair.digests(edited)).collect()}
    assert got == repaired_by_hand(rows)
    counts = {r[0]: r[1] for r in edited.filter("edit <> 'I'").groupBy("conv_id").count().collect()}
    assert counts == Counter(r[0] for r in rows)


def test_repair_of_nothing(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    edited, summary = repair.repaired(repair.damaged(table))
    assert edited.count() == summary.count() == repair.report(table, summary, repair.digests(edited)).count() == 0


# --- nearest vectors ------------------------------------------------------------------

def exact_neighbours(ids, m, queries, k=20):
    out = {}
    for q in queries:
        scores = (m * m[ids.index(q)]).sum(axis=1)
        out[q] = [(i, s) for s, i in sorted((-s, i) for i, s in zip(ids, scores) if i != q)[:k]]
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in want[q]} & {r["vec_id"] for r in got.get(q, [])}) / len(want[q]) for q in want])


def found(df, **args):
    out = {}
    for r in sorted(neighbours.nearest(df, **args).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r)
    return out


@pytest.mark.parametrize("kind", ["clusters", "even", "lengths"])
def test_neighbours(spark, kind):
    rng = np.random.default_rng(4)
    n, d = 6000, 48
    m = rng.standard_normal((n, d))
    if kind == "clusters":
        m = rng.standard_normal((60, d))[rng.integers(0, 60, n)] + 0.3 * m
    if kind == "lengths":
        m *= rng.lognormal(0, 0.5, n)[:, None]
    m[100:900] = m[100]  # a large group of copies
    df = spark.createDataFrame([(i, x.tolist(), 1, 2) for i, x in enumerate(m)], "vec_id long, embedding array<double>, label int, low int").repartition(6)
    want = exact_neighbours(list(range(n)), m, range(0, n, 20))
    got = found(df)
    assert recall(got, want) >= 0.9
    for q, rows in got.items():
        assert [r["rank"] for r in rows] == list(range(1, 21)) and q not in {r["vec_id"] for r in rows}
        assert all(abs(r["score"] - float(m[q] @ m[r["vec_id"]])) <= 1e-9 * abs(r["score"]) for r in rows)
        assert [(-r["score"], r["vec_id"]) for r in rows] == sorted((-r["score"], r["vec_id"]) for r in rows)
    assert [r["vec_id"] for r in got[100]] == [i for i, _ in want[100]]  # ties by id


def test_neighbours_take_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = [(i, rng.standard_normal(8).tolist()) for i in range(30)]
    odd = [(40, None), (60, [0.0] * 8), (80, [None] + [1.0] * 7), (100, [float("nan")] * 8), (120, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (140, []),
           (160, [1.0, 2.0]), (161, [2.0, 1.0]), good[3], good[20], (180, [7.0])]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>")
    got = found(df)
    want = exact_neighbours([i for i, _ in good], np.array([x for _, x in good]), [0, 20])
    assert {q: [r["vec_id"] for r in rows] for q, rows in got.items()} == {**{q: [i for i, _ in w] for q, w in want.items()}, 160: [161]}
    assert neighbours.nearest(df.limit(0)).count() == 0
