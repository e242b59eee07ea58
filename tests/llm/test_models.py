"""What the trained models and the media features say, worked out again in plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import lm, media, quality
from marlstone.llm.spans import mix, pieces
from tests.llm.test_text_operators import FOLD, WORD, frame, rows, texts


def test_language_model_by_exact_counts(spark):
    """The filter's false positives move a text's score a little; everything else is exact."""
    rng = random.Random(11)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(2000)]
    values = [None, "", *(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(20, 200))) for _ in range(150))]
    toks = {i: WORD.findall((t or "").translate(FOLD)) + ["\n"] for i, t in enumerate(values)}
    train = [ws for i, ws in toks.items() if zlib.crc32(str(i).encode()) % 10]
    one = collections.Counter(w for ws in train for w in ws)
    two = collections.Counter(p for ws in train for p in zip(["\t", *ws], ws, strict=False))
    n, once = sum(one.values()), sum(c == 1 for c in one.values())
    of_context = one | {"\t": len(train)}
    level = lambda c: int(np.searchsorted(lm._THRESHOLDS, c, "right"))
    seen, new = collections.Counter(), collections.Counter()
    for ws in train:
        for p in zip(["\t", *ws], ws, strict=False):
            seen[level(of_context[p[0]])] += 1
            new[level(of_context[p[0]])] += two[p] <= 1
    unknown = min(0.5, (once + 1) / (n + 2))

    def log_p(before: str, word: str) -> float:
        c, context = one[word], of_context.get(before, 0)
        alone = c / n * (1 - unknown) if c else unknown
        if not context:
            return math.log10(alone)
        k = level(context)
        u = min(1.0, (new[k] + 1) / (seen[k] + 2))
        stored = int(lm._THRESHOLDS[level(two[before, word]) - 1]) if two[before, word] and c else 0
        return math.log10((1 - u) * stored / context + u * alone)

    want = {i: sum(log_p(*p) for p in zip(["\t", *ws], ws, strict=False)) for i, ws in toks.items()}
    got = rows(lm.scored(frame(spark, values)))
    assert all(got[i].score == pytest.approx(want[i], rel=0.08, abs=0.2) for i in toks)
    assert sum(r.score for r in got.values()) == pytest.approx(sum(want.values()), rel=0.01)


def test_quality_model_by_plain_counts(spark):
    rng = random.Random(3)
    good_words, bad_words = [f"g{i}" for i in range(150)], [f"b{i}" for i in range(150)]
    words = lambda share: " ".join(rng.choice(good_words if rng.random() < share else bad_words) for _ in range(rng.randint(40, 120)))
    values = [None, "", *(words(rng.random()) for _ in range(120))]
    labels = [(i, int(len(WORD.findall(values[i] or "")) > 0 and (values[i] or "").count("g") > (values[i] or "").count("b"))) for i in range(0, len(values), 2)] + [(4, None), (None, 1), (10**6, 1)]
    ids = [*range(len(values)), 8, 8, 8, 10, 10]  # rows of one id: all count, the least score of each label's id is asked
    values += [words(0.5) for _ in range(5)]
    docs = frame(spark, values, ids)
    model = quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    got = collections.defaultdict(list)
    for r in quality.annotated(docs, model).collect():
        got[r.doc_id].append(r)

    verdicts: dict[int, int] = {}
    for i, q in labels:
        if i is not None:
            verdicts[i] = min(verdicts.get(i, 1), q or 0)

    def buckets(text: str | None) -> list[int]:
        h = []
        for w in WORD.findall((text or "").translate(FOLD)):
            (piece,) = pieces(pa.array([w]))
            h.append(int(piece.hash(*piece.words)[0]))
        pairs = [int(mix(np.array([(3 * a + b) % 2**64], np.uint64))[0]) for a, b in zip(h, h[1:], strict=False)]
        return [x % quality.BUCKETS for x in h + pairs]

    of = [buckets(t) for t in values]
    raw = collections.Counter(b for bs in of for b in bs)
    n_raw = sum(raw.values())
    p_raw = lambda b: (raw[b] + 1) / (n_raw + quality.BUCKETS)
    target = collections.Counter(b for i, bs in zip(ids, of, strict=True) if verdicts.get(i) == 1 for b in bs)
    n_target = sum(target.values())

    def score(bs: list[int], less: collections.Counter, n_less: int) -> float:
        n = max(n_target - n_less, 1)
        return sum(math.log((target[b] - less[b] + quality.PRIOR * n * p_raw(b)) / ((1 + quality.PRIOR) * n)) - math.log(p_raw(b)) for b in bs) / max(len(bs), 1)

    nothing = collections.Counter()
    least_of: dict[int, float] = {}
    for i, text, bs in zip(ids, values, of, strict=True):
        w = WORD.findall(text or "")
        windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        if i in verdicts and len(w) >= quality.LEAST_WORDS and 100 * len(covered) <= quality.MOST_REPEATED * len(w):
            own = collections.Counter(bs) if verdicts[i] else nothing
            least_of[i] = min(least_of.get(i, math.inf), score(bs, own, sum(own.values())))
    good, bad = (sorted(x for i, x in least_of.items() if verdicts[i] == v) for v in (1, 0))
    assert good and bad
    most = good[int(quality.MOST_LOST * len(good))]
    cuts = [s for s in sorted({*good, *bad}) if s <= most]
    costs = [sum(g < s for g in good) / len(good) - sum(x < s for x in bad) / len(bad) for s in cuts]
    k = costs.index(min(costs))
    least = (cuts[k] + cuts[k - 1]) / 2 if k else cuts[k]
    assert model.least_score == pytest.approx(least)
    for i in set(ids):
        want = sorted(score(bs, nothing, 0) for k, bs in zip(ids, of, strict=True) if k == i)
        mine = sorted(got[i], key=lambda r: r.score)
        assert [r.score for r in mine] == pytest.approx(want, abs=1e-9)
        assert all(r.kept == (not r.base_failed and r.score >= model.least_score) for r in mine)
    assert len({r.kept for rs in got.values() for r in rs if not r.base_failed}) == 2


def test_media_features_from_the_payload(spark):
    """A unit's first byte is its DC value; the feature names the size, an average hash and a digest of the thumbnail."""
    values = [*texts(n=8), "x" * 64 * 90, None, "é" * 5000]
    got = rows(media.described(media.stored(frame(spark, values))))
    for i, t in enumerate(values):
        raw = (t or "").encode()
        raw += bytes((-len(raw)) % 64 or (0 if raw else 64))
        across, down = (int(x) // 8 for x in got[i].feature.split(":")[0].split("x"))
        assert across * down * 64 >= len(raw)
        pixels = [math.floor((b - 256 if b > 127 else b) / 8 + 128.5) for b in raw[::64]]
        pixels += [128] * (across * down - len(pixels))
        grid = [pixels[k * across : (k + 1) * across] for k in range(down)]
        small = []
        for r in range(8):
            for c in range(8):
                top, left = r * down // 8, c * across // 8
                box = [x for row in grid[top : max((r + 1) * down // 8, top + 1)] for x in row[left : max((c + 1) * across // 8, left + 1)]]
                small.append(sum(box) / len(box))
        mean = sum(small) / 64
        bits = sum(1 << (63 - k) for k, x in enumerate(small) if x >= mean - 1e-9)
        assert got[i].thumbnail == bytes(pixels)
        assert got[i].feature.split(":")[1:] == [f"{bits:016x}", hashlib.sha256(bytes(pixels)).hexdigest()[:32]], i
