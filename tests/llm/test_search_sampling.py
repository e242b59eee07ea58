"""Lexical search, exact top-k and importance resampling against plain Python, with nulls, ties, repeated rows and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import lexical, resample, topk

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LAST = 2**63 - 1
DOCS = "doc_id long, text string, id string, score string, rank int, part string, term string, bucket int, row string, pos int"


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def docs(spark, values, ids=None):
    extra = ("x", "y", 1, "z", "w", 2, "v", 3)
    return spark.createDataFrame([(i, t, *extra) for i, t in zip(range(len(values)) if ids is None else ids, values, strict=True)], DOCS).repartition(3)


def some_texts(n=80, seed=5):
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice('aBcdéß日Ж')}{rng.choice('xyz')}{k % 40}" for k in range(90)]
    out = [None, "", " .,;", "One ONE one", "İstanbul \u0085nel", "a_b-c d'e", "x" * 3000, "日本語。テキスト"]
    for _ in range(n):
        out.append(" ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(90)], k=rng.randint(1, 70))) + rng.choice([".", "!", ", "]))
    return out + out[20:30] + out[20:22]


def search_plainly(values, items, k):
    """values: (id, text); items: (id, text), of distinct ids."""
    found = [(i, collections.Counter(terms(t))) for i, t in values]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    n_docs, n_terms = len(found), sum(n for _, _, n in found)
    df = collections.Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in found:
            m = 100 - 75 + (75 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if c[t])
            if score > 0:
                scored.append((-score, LAST if i is None else i))
        out += [(item, r + 1, None if i == LAST else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def test_search(spark):
    values = some_texts()
    ids = [None if i == 33 else i for i in range(len(values))]
    items = list(enumerate(["one two", None, "", "…", *(v for v in values[8:40:3]), " ".join(values[8:16]), "İSTANBUL x" + "x" * 2999]))
    asked = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id long, text string, doc_id string, rank int")
    want = search_plainly(zip(ids, values, strict=True), items, 10)
    for held, block_terms in ((2_000_000, 1_000_000), (40, 25)):
        found = lexical.search(lexical.index(docs(spark, values, ids), held=held), asked, block_terms=block_terms)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, found.collect()), key=repr) == want
    assert len(want) > 100 and len({s for *_, s in want}) < len(want)


def test_search_of_nothing_and_of_copies(spark):
    asked = spark.createDataFrame([(1, "common words here")], "item_id long, text string")
    assert lexical.search(lexical.index(docs(spark, [])), asked).count() == 0
    assert lexical.search(lexical.index(docs(spark, [None, "", "..."])), asked).count() == 0
    assert lexical.search(lexical.index(docs(spark, ["common words"])), asked.where("item_id = 2")).count() == 0
    copies = ["common words of copies"] * 200 + ["other text"] * 300
    got = lexical.search(lexical.index(docs(spark, copies, list(range(500))[::-1]), held=100), asked, k=7).collect()
    assert sorted((r.rank, r.doc_id) for r in got) == [(k + 1, 300 + k) for k in range(7)] and len({r.score for r in got}) == 1
    two = spark.createDataFrame([(1, "other"), (1, "common"), (1, "common"), (None, "other")], "item_id long, text string")
    got = lexical.search(lexical.index(docs(spark, copies)), two, k=2).collect()
    assert sorted(((r.item_id, r.rank, r.doc_id) for r in got), key=repr) == sorted([(1, 1, 0), (1, 2, 1), (None, 1, 200), (None, 2, 201)], key=repr)


VECTORS = "vec_id long, embedding array<double>, id string, part int, score string, rank int, v string"


def vectors(spark, items):
    return spark.createDataFrame([(i, v, "x", 1, "y", 2, "z") for i, v in items], VECTORS).repartition(3)


def nearest_plainly(items, queries, k):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(1024 * x) if abs(x) < 2.0**52 else int(x) * 1024 for x in v]

    items = [(i, whole(v)) for i, v in items]
    least = {}
    for i, v in queries:
        if i is not None and (w := whole(v)) is not None:
            least[i] = min(least.get(i, w), w)
    out = []
    for q, v in least.items():
        scored = [(-max(-(2**63), min(LAST, sum(a * b for a, b in zip(v, w, strict=True)))), LAST if i is None else i) for i, w in items if w is not None and i != q and len(w) == len(v)]
        out += [(q, r + 1, None if i == LAST else i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def check_nearest(spark, items, k=10, **more):
    df = vectors(spark, items)
    got = topk.nearest(df, df.where("vec_id % 10 = 0"), k=k, **more)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    want = nearest_plainly(items, [(i, v) for i, v in items if i is not None and i % 10 == 0], k)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    return want


def test_nearest(spark, monkeypatch):
    rng = np.random.default_rng(3)
    items = [(i, (rng.normal(size=8) / 3).tolist()) for i in range(300)]
    hot = items[7][1]
    items += [(i, hot) for i in range(300, 520)]  # one vector of very many rows
    items += [(520, None), (530, [0.5, None, *[0.1] * 6]), (540, [float("nan")] * 8), (550, [float("inf")] * 8), (None, hot), (560, [1.0, 2.0]), (561, [0.25, -1.0]), (570, []), (-10, hot), (10, hot), (10, items[10][1])]
    want = check_nearest(spark, items)
    assert {q for q, *_ in want} >= {-10, 0, 10, 560} and not {520, 530, 540, 550} & {q for q, *_ in want}
    monkeypatch.setattr(topk, "TILE", 7)
    monkeypatch.setattr(topk, "TILE_QUERIES", 5)
    check_nearest(spark, items, k=3, block_bytes=2000)
    check_nearest(spark, [])
    check_nearest(spark, [(1, [0.5]), (2, [0.25])])
    check_nearest(spark, [(10, [0.5]), (20, [0.25])])


@pytest.mark.parametrize("size", [300.0, 3e5, 2.0**40, 1e15, 1e30, 1.7e308])
def test_nearest_of_large_numbers(spark, size):
    rng = np.random.default_rng(1)
    items = [(i, (rng.uniform(-1, 1, 4) * size).tolist()) for i in range(40)]
    if size > 1e300:  # the products are cut to 64 bits, whatever lies beyond
        df = vectors(spark, items)
        assert {abs(r.score) for r in topk.nearest(df, df.where("vec_id % 10 = 0")).collect()} <= {2**63 - 1, 2**63}
    else:
        check_nearest(spark, items)


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-5, 5), st.integers(0, 30)), max_size=60), st.integers(1, 5))
def test_best_keeps_the_least_ids_of_the_highest_scores(found, k):
    best = topk.Best(4, k)
    for a in range(0, len(found), 7):
        part = np.array(found[a : a + 7], np.int64)
        best.add(part[:, 0], part[:, 1], part[:, 2])
    rows, ids, scores = best.rows()
    want = [(q, i, s) for q in range(4) for s, i in sorted(((s, i) for r, s, i in found if r == q), key=lambda x: (-x[0], x[1]))[:k]]
    assert list(zip(rows.tolist(), ids.tolist(), scores.tolist(), strict=True)) == want


def test_lists_of_many_tasks_meet_in_a_tree(spark):
    rng = random.Random(2)
    found = [(q, part, rng.randint(0, 50), rng.randint(0, 9)) for q in range(5) for part in range(70) for _ in range(3)]
    got = topk.merged(spark.createDataFrame(found, "q long, part int, id long, score long"), 70, "q", 4, fan=4).collect()
    want = [(q, r + 1, i, -s) for q in range(5) for r, (s, i) in enumerate(sorted((-s, i) for a, _, i, s in found if a == q)[:4])]
    assert sorted((r.q, r["rank"], r.id, r.score) for r in got) == want


def resample_plainly(values, target, orders=3, buckets=10_000, percent=5, least_words=20):
    def bucketed(text):
        w = terms(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, orders + 1) for i in range(len(w) - n + 1)]

    found = [(i, len(terms(t)), bucketed(t)) for i, t in values]
    s, t = collections.Counter(b for *_, bs in found for b in bs), collections.Counter(b for x in target for b in bucketed(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, n, bs in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs)
        out.append((i, n, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long = sorted((-score, LAST if i is None else i) for i, n, _, _, score in out if n >= least_words)
    drawn = long[: percent * len(long) // 100]
    place = collections.defaultdict(list)
    for r, key in enumerate(drawn):
        place[key].append(r + 1)
    rows = []
    for i, n, many, weight, score in out:
        mine = place[-score, LAST if i is None else i] if n >= least_words else []
        rows.append((i, many, weight, score, mine.pop() if mine else None))
    return sorted(rows, key=repr)


def test_resampling(spark):
    values = some_texts(300)
    ids = [None if i == 40 else 77 if i in (50, 51, 52) else i for i in range(len(values))]
    target = [None, "", values[30], values[31].upper(), "only here and nowhere else"]
    frame = spark.createDataFrame([(t, "x") for t in target], "text string, doc_id string")
    for percent in (5, 60):
        got = resample.resampled(docs(spark, values, ids), frame, percent=percent)
        assert dict(got.dtypes) == {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"}
        assert sorted(map(tuple, got.collect()), key=repr) == resample_plainly(zip(ids, values, strict=True), target, percent=percent)


def test_resampling_of_nothing_and_of_copies(spark):
    none = spark.createDataFrame([], "text string")
    assert resample.resampled(docs(spark, []), none).count() == 0
    copies = [" ".join(["same", "words"] * 15)] * 120 + ["short one"] * 60 + [None]
    ids = [5] * 100 + list(range(100, 181))
    got = resample.resampled(docs(spark, copies, ids), none, percent=50).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score) for r in got), key=repr) == sorted((r[:4] for r in resample_plainly(zip(ids, copies, strict=True), [], percent=50)), key=repr)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 61))
    scores = [s for _, s in sorted((r["rank"], r.score) for r in got if r["rank"])]
    assert scores == sorted(scores, reverse=True)
    one = resample.resampled(docs(spark, ["word " * 3000]), none, percent=100).first()
    assert (one.n_features, one["rank"]) == (3000 + 2999 + 2998, 1)
