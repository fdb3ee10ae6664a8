"""The Jaccard join, the ranked search and the prefix trie against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from piiprism.llm import impact, jaccard, shingles, trie

DOCS = "doc_id long, text string, n int, key long, parity string"
WORDS = [f"w{i}é" for i in range(4000)]


def _set(text, width):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def _components(rows, width, percent):
    """Component of each doc_id, by all pairs; rows: (doc_id, text)."""
    ids = sorted({i for i, _ in rows if i is not None})
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    sets = [(i, _set(t, width)) for i, t in rows if i is not None]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def _families(seed):
    """Texts of many sizes with copies around a similarity of 0.9, a large family and a shared passage."""
    rng, rows = random.Random(seed), []
    passage = rng.choices(WORDS, k=60)
    for size in [*range(1, 30), 33, 41, 58, 64, 65, 66, 90, 140, 300, 900]:
        base = rng.choices(WORDS, k=size)
        for copy in range(5):
            t = list(base)
            for _ in range(rng.randint(0, 1 + size * copy // 150)):
                at, what = rng.randrange(len(t)), rng.random()
                t[at : at + (what < 0.6)] = [rng.choice(WORDS)] if what > 0.3 else []
                t = t or ["x"]
            rows.append(t)
    base = rng.choices(WORDS, k=160)
    for _ in range(120):
        t = list(base)
        for _ in range(rng.randint(1, 3)):
            t[rng.randrange(len(t))] = rng.choice(WORDS)
        rows.append(t)
    rows += [rng.choices(WORDS, k=50) + passage + rng.choices(WORDS, k=10) for _ in range(60)]
    rng.shuffle(rows)
    return [(i, " ".join(t).title() if i % 7 == 0 else " ".join(t)) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("percent", "most"), [(90, None), (90, 0), (90, 24), (80, 14)])
def test_join_equals_all_pairs(spark, monkeypatch, percent, most):
    if most is not None:
        monkeypatch.setattr(jaccard, "boundary", lambda counts, percent: most)
    rows = _families(percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string"), 3, percent).collect()}
    want = _components(rows, 3, percent)
    assert got == {i: (len(_set(t, 3)), want[i]) for i, t in rows}
    assert 10 < len(set(want.values())) < len(rows) - 50


def test_no_list_or_subset_is_lost():
    rng = np.random.default_rng(3)
    for percent in (50, 80, 90, 97):
        sizes, known = set(), {}
        for _ in range(400):
            n = int(rng.integers(1, 400))
            m = int(rng.integers(n, 100 * n // percent + 1))
            common = jaccard.overlap(n, m, percent)
            x = rng.integers(0, 1 << 64, n + m - common, dtype=np.uint64)
            a, b = np.sort(x[:n]), np.sort(x[n - common :])
            assert np.intersect1d(jaccard.part_keys(a, percent, known), jaccard.part_keys(b, percent, known)).size
            sizes.add(n)
            if m <= 24 and percent > 80:
                (p, c), (q, d) = jaccard.subset_keys(a, 24, percent), jaccard.subset_keys(b, 24, percent)
                assert set(zip(p.tolist(), c.tolist(), strict=True)) & set(zip(q.tolist(), d.tolist(), strict=True))
            apart = np.bitwise_count(jaccard.parity(a).view(np.uint64) ^ jaccard.parity(b).view(np.uint64)).sum()
            assert apart <= n + m - 2 * common
        assert len(sizes) > 100


def test_boundary_is_where_cost_is_least():
    assert jaccard.boundary({}, 90) == jaccard.LIGHT_MOST - 1  # nothing to enumerate, nothing to list
    assert jaccard.boundary({12: 1000, 300: 1}, 90) >= 12  # 12 subsets at most, against a list
    assert jaccard.boundary({60: 1000}, 90) < 60  # 60 over 6 subsets


def test_join_of_odd_rows(spark):
    long = " ".join(WORDS * 5)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "A b"), (9, "a B"), (5, "one two three four"), (5, "other words stand here now"), (8, "other words stand here now"), (7, "one two three four"), (None, "a b"), (6, long), (10, long + " x")]
    got = {(r["doc_id"], r["component_id"], r["n_shingles"]) for r in jaccard.linked(spark.createDataFrame([(i, t, 1, 2, "z") for i, t in rows], DOCS), 3, 90).collect()}
    assert {(1, 1, 0), (2, 2, 0), (3, 3, 0), (4, 4, 1), (9, 4, 1), (None, None, 1), (6, 6, len(_set(long, 3))), (10, 6, len(_set(long, 3)) + 1)} <= got
    assert {i: c for i, c, _ in got if i in (5, 7, 8)} == {5: 5, 7: 5, 8: 5}
    assert jaccard.linked(spark.createDataFrame([], DOCS)).collect() == []


# ---- ranked search ----


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _ranking(docs, items, k):
    held = [(i, Counter(_terms(t)), len(_terms(t))) for i, t in docs if _terms(t)]
    n_docs, length = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = set()
    for item in {i for i, _ in items}:
        asked = Counter(t for i, text in items if i == item for t in _terms(text))
        scored = []
        for i, c, n in held:
            m = 100 - 75 + 75 * n * n_docs // length
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out |= {(item, rank, None if none else i, -s) for rank, (s, none, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def _corpus(seed, n=300):
    rng = random.Random(seed)
    weights = [1 / (1 + i) for i in range(len(WORDS))]
    docs = [(i, " ".join(rng.choices(WORDS, weights, k=rng.choice([0, 1, 5, 40, 400])))) for i in range(n)]
    docs += [(n + i, docs[i][1]) for i in range(40)]  # ties
    return docs, [(i, " ".join(rng.choices(WORDS, weights, k=rng.choice([1, 3, 30])))) for i in range(25)]


@pytest.mark.parametrize("shard", [7, 1 << 16])
def test_search_equals_scores_of_all_documents(spark, monkeypatch, shard):
    monkeypatch.setattr(impact, "SHARD_DOCS", shard)
    monkeypatch.setattr(impact, "GROUP_BYTES", 400 if shard == 7 else 1 << 20)
    docs, items = _corpus(shard)
    got = impact.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 10).collect()
    assert {tuple(r) for r in got} == _ranking(docs, items, 10) and len(got) > 150


def test_processing_stops_early_and_proves_the_best(monkeypatch):
    """The best are the same whether a shard stops or not, and stopping leaves postings unread."""
    docs, items = _corpus(5, 3000)
    asked = impact.Asked([{"item_id": i, "text": t} for i, t in items])
    rows = []
    for i, t in docs:
        own = Counter(impact.terms(t))
        kept = sorted((asked.number[x], n) for x, n in own.items() if x in asked.number)
        if own:
            both = np.array(kept, np.int32).reshape(-1, 2)
            rows.append((i, sum(own.values()), both[:, 0].tobytes(), both[:, 1].tobytes()))
    weight = np.arange(len(asked.number), 0, -1).astype(np.int64) * 50
    shard = impact.Shard(rows, weight, len(rows), sum(r[1] for r in rows))
    stopped = 0
    for few in (0, 50, 10**9):
        monkeypatch.setattr(impact, "FEW", few)
        for own in asked.items.values():
            repeats = np.zeros(len(weight), np.int64)
            for t, n in own.items():
                repeats[t] = n
            whole = shard.complete(np.arange(len(rows)), repeats)
            score, ids = impact.best_of(*shard.search(sorted(own.items()), repeats, 10, 0), 10)
            want, at = impact.best_of(whole[whole > 0], shard.ids[whole > 0], 10)
            assert score.tolist() == want.tolist() and ids.tolist() == at.tolist()
            stopped += len(shard.search(sorted(own.items()), repeats, 10, 0)[1]) < np.count_nonzero(whole)
    assert stopped > 30


def test_search_of_odd_rows(spark):
    docs = [(1, None, "x"), (2, "", None), (None, "alpha Beta", "y"), (3, "alpha beta", "y"), (3, "alpha beta", "y"), (4, "alpha " * 50_000 + "ÉÀ漢", "z"), (5, "\x00 -- !", "z")]
    items = [(1, "ALPHA, beta;beta"), (1, "alpha"), (2, None), (None, "éà漢 ÉÀ漢"), (4, "--"), (5, "gamma")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    got = [tuple(r) for r in impact.ranked(frame, spark.createDataFrame(items, "item_id long, text string"), 3).collect()]
    assert set(got) == _ranking([d[:2] for d in docs], items, 3)
    assert {g[:3] for g in got} == {(1, 1, 3), (1, 2, 3), (1, 3, None), (None, 1, 4)}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert impact.ranked(none, spark.createDataFrame(items, "item_id long, text string")).collect() == []
    assert impact.ranked(frame, spark.createDataFrame([], "item_id long, text string")).collect() == []


# ---- prefix trie ----


def _trie(rows):
    """conv_id, turn, role, text -> the nodes, from the definition."""
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    words = lambda p: len([w for w in re.split(r"[\x20\x09-\x0D]+", p[-1][1]) if w]) if p else 0
    children = Counter(p[:-1] for p in members if p)
    out = set()
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(m) if len(whole[c]) == len(p))
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], sum(q not in children for q in below), sum((len(members[q]) - 1) * words(q) for q in below), hashlib.sha256(ends.encode()).hexdigest()))
    return out


TURNS = "conv_id long, turn long, role string, text string, ids string, words int, next int"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("local", [1, 3, 20, 4096])
def test_trie_equals_its_definition(spark, local):
    rng = random.Random(local)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "a b  c", "", "x\ny z"])) for c in range(0, 150) for t in range(rng.randint(1, 6)) if c % 40]
    rows += [(c, t, "user", f"same {t}") for c in range(200, 260) for t in range(9)]
    got = {tuple(r[n] for n in NAMES) for r in trie.trie(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS), local).collect()}
    assert got == _trie(rows)


def test_trie_of_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (1, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (20, 0, "u", "long " * 90_000), (23, 5, "", ""), (-5, 1, "user", "a"), (10**15, 0, "user", "a"), (7, 0, "a\nb", "c"), (7, 1, "a", "b\nc")]
    for local in (1, 100):
        got = [tuple(r[n] for n in NAMES) for r in trie.trie(spark.createDataFrame([(*r, "x", 1, 2) for r in rows], TURNS), local).collect()]
        assert len(got) == len(set(got)) and set(got) == _trie(rows)
    assert trie.trie(spark.createDataFrame([], TURNS)).collect() == []


def test_deep_sequences_need_no_recursion():
    rows = [(i, 1, list(range(20_000)) + [i], [1] * 20_001, "h") for i in range(3)]
    nodes = trie.quicksorted(rows, 0, None)
    assert len(nodes) == 20_001 + 3 and nodes[0][3:7] == [3, 1, 3, 2 * 20_000]


def test_shingles_are_the_contract(spark):
    assert len(shingles.shingles("A b\x0bC  d", 3)) == len(_set("A b\x0bC  d", 3)) == 2
