"""Operators on whole texts against plain Python, with nulls, empty and odd texts, repeated rows and clashing columns."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marlstone.llm import bpe, dac, html, linededup, lm, media, neardup, packing, quality
from marlstone.llm.mph import MinimalPerfectHash
from marlstone.llm.spans import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile("[^\x20\x09-\x0d]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " ", "\n\n", "one", "ONE two  three\tfour", "é ü ñ\nÉ Ü Ñ", "a" * 5000, "same line here\nsame line here\nother", "# $ % | <b> &", " nb sp ", "日本語 テキスト\n日本語 テキスト です ね"]
SCHEMA = "doc_id long, text string, source string, n_words int, kept string, score string, start int, component_id long, shard string"


def texts(seed: int = 7, n: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 90))).capitalize() for _ in range(n)]
    shared = "This passage occurs in many of the documents, word for word."
    out: list[str | None] = list(ODD)
    for i, b in enumerate(base):
        lines = re.sub(r"((?:\S+ ){9}\S+) ", r"\1\n", b)
        out.append(lines + (f"\n  {shared.upper() if i % 2 else shared} " if i % 3 == 0 else ""))
        for _ in range(i % 4):
            words = b.split(" ")
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words))
    return out


def frame(spark, values, ids=None):
    rows = [(i, t, f"s{(i or 0) % 4}" if (i or 0) % 7 else None, 1, "x", "y", 2, 3, "z") for i, t in zip(ids or range(len(values)), values, strict=True)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows(df):
    return {r[0]: r for r in df.collect()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \n\t\x0b.é日", max_size=40)), max_size=8))
def test_words_and_lines(values):
    column = pa.array(values, pa.string())
    words, lines, hashes = [], [], {}
    for p in pieces(column):
        for doc in range(p.n):
            a, b = p.word_bounds[doc], p.word_bounds[doc + 1]
            spans = [(p.words[0][k], p.words[1][k]) for k in range(a, b)]
            found = [bytes(p.data[x:y]) for x, y in spans]
            words.append([w.decode() for w in found])
            starts, ends, bounds = p.lines
            lines.append([bytes(p.data[x:y]).decode() for x, y in zip(starts[bounds[doc] : bounds[doc + 1]], ends[bounds[doc] : bounds[doc + 1]], strict=True)])
            for w, h in zip(found, p.hash(np.array([x for x, _ in spans], int), np.array([y for _, y in spans], int)) if spans else [], strict=True):
                assert hashes.setdefault(w, h) == h
    assert words == [WORD.findall(v or "") for v in values]
    assert lines == [(v or "").split("\n") for v in values]
    assert len(set(map(int, hashes.values()))) == len(hashes)


def test_pieces_are_cut_between_documents(monkeypatch):
    monkeypatch.setattr("marlstone.llm.spans.PIECE_BYTES", 10)
    got = [(p.first, p.n, len(p.data)) for p in pieces(pa.array(["abc", "defgh", "x" * 40, "", "yz"]))]
    assert [g[0] for g in got] == list(np.cumsum([0] + [g[1] for g in got])[:-1]) and sum(g[1] for g in got) == 5


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=400))
def test_minimal_perfect_hash(keys):
    keys = np.array(sorted(keys), np.uint64)
    h = MinimalPerfectHash.from_bytes(MinimalPerfectHash.build(keys).to_bytes())
    assert sorted(h.lookup(keys).tolist()) == list(range(len(keys)))


def shingle_set(text):
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def components(sets):
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_near_duplicates(spark):
    values = texts()
    sets = {i: shingle_set(t) for i, t in enumerate(values)}
    got = rows(neardup.linked(frame(spark, values)))
    want = components(sets)
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == {d: (len(sets[d]), want[d]) for d in sets}
    assert len(set(want.values())) < len(want)


def test_one_large_group_of_near_copies(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(80)]
    values = []
    for _ in range(150):
        mine = list(words)
        for _ in range(rng.randint(0, 3)):
            mine[rng.randrange(80)] = f"x{rng.random()}"
        values.append(" ".join(mine))
    got = rows(neardup.linked(frame(spark, values), rounds=1))
    want = components({i: shingle_set(t) for i, t in enumerate(values)})
    assert {d: r.component_id for d, r in got.items()} == want


def test_every_pair_is_found_without_rounds(spark):
    """All links from the last step, which cuts lists by size: random texts, and beginnings of one text from 1 to 400 words."""
    long = [f"w{i}" for i in range(400)]
    values = texts() + [" ".join(long[:k]) for k in (*range(1, 12), *range(14, 400, 9), 400)]
    got = rows(neardup.linked(frame(spark, values), rounds=0))
    want = components({i: shingle_set(t) for i, t in enumerate(values)})
    assert {d: r.component_id for d, r in got.items()} == want


def test_documents_with_a_template_never_meet(spark, monkeypatch):
    """Four fifths of each document are in all of them: none can be similar enough to another, so no pair is looked at but near copies."""
    rng, seen, plain = random.Random(5), {}, neardup.written

    def spied(df, what):
        out = plain(df, what)
        seen[what] = seen.get(what, 0) + out.count()
        return out

    template = " ".join(f"t{i}" for i in range(200))
    values = [template + "".join(f" u{i}x{k}" for k in range(rng.randint(40, 60))) for i in range(120)]
    values += [f"{values[3]} end", f"{values[8]} other end"]
    monkeypatch.setattr(neardup, "written", spied)
    got = rows(neardup.linked(frame(spark, values)))
    assert {d: r.component_id for d, r in got.items()} == {i: {120: 3, 121: 8}.get(i, i) for i in range(122)}
    assert seen["postings"] > 500 and seen["dealt-pairs"] <= 6 and seen["asks"] == 0


def test_equal_batches_stay_apart(spark, tmp_path):
    """The same rows from several files are batches of one content."""
    frame(spark, ["a b c d e f g", "h i j k l m n o"]).coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    docs = one.unionByName(one).unionByName(one)
    batches = neardup._dealt(docs.selectExpr("doc_id as id", "text", "cast(null as long) as carried"), 5, 500).where("ids is not null")
    assert batches.select("batch").distinct().count() == batches.count() >= 3
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.linked(docs).collect()) == [(0, 3, 0)] * 3 + [(1, 4, 1)] * 3


def test_near_duplicates_of_nothing_and_of_repeated_rows(spark):
    assert neardup.linked(frame(spark, [])).count() == 0
    again = frame(spark, ["a b c d e f g", "A b c d e f g", "a b c d e f g", None, "a b c d e f g"], ids=[5, 5, 9, None, None])
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in neardup.linked(again).collect()) == [(-1, -1), (-1, 5), (5, 5), (5, 5), (9, 5)]
    nameless = frame(spark, ["a b c d e f g"] * 3, ids=[None, None, None])
    assert [r.component_id for r in neardup.linked(nameless).collect()] == [None] * 3


def test_one_id_with_different_texts(spark):
    """Rows in are rows out, and a text links as it would with an id of its own."""
    other = "quite another text of some words here"
    docs = frame(spark, ["a b c d e f g", other, "a b c d e f g", other, None], ids=[5, 5, 9, 3, 5])
    got = neardup.linked(docs, carry="start").collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(3, 3, 3), (5, 0, 5), (5, 3, 3), (5, 3, 5), (9, 3, 5)]
    assert len({r.component for r in got}) == 3 and {r.carried for r in got} == {2}


def test_common_shingles_go_as_counts(spark):
    values = texts()
    want = rows(neardup.linked(frame(spark, values)))
    got = rows(neardup.linked(frame(spark, values), common=1))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (r.n_shingles, r.component_id) for i, r in want.items()}


def test_prefix_never_loses_a_link():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        a = rng.choice(80, n, replace=False)
        b = np.unique(np.concatenate([rng.permutation(a)[: max(1, int(n * rng.uniform(0.6, 1)))], rng.choice(80, int(rng.integers(0, n // 4 + 1)), replace=False)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 75 * (len(a) + len(b) - both):
            continue
        df = rng.integers(2, 50, 80)
        order = np.lexsort((np.arange(80), df))
        rank = np.argsort(order)
        pre = []
        for s in (a, b):
            s = s[np.argsort(rank[s])]
            k = neardup.adaptive_prefix(len(s), df[s], 75)
            pre.append((set(s[:k].tolist()), len(s) - k))
        needed = -(-75 * (len(a) + len(b)) // 175) - max(pre[0][1], pre[1][1])
        assert len(pre[0][0] & pre[1][0]) >= max(1, needed)


def test_language_model(spark):
    values = texts()
    docs = frame(spark, values)
    got, sharded = rows(lm.scored(docs)), rows(lm.scored(docs, filter_bytes=0))
    toks = {i: WORD.findall((t or "").translate(FOLD)) + ["<end>"] for i, t in enumerate(values)}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in toks}
    c = collections.Counter(w for i, ws in toks.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in toks.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(w in c for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws))
        assert r.score <= 0 and sharded[i].score == pytest.approx(r.score)
    some = [i for i in toks if held[i]]
    assert sum(got[i].score for i in some) > sum(got[i].base_score for i in some)
    assert lm.scored(frame(spark, [])).count() == 0


def test_language_model_of_repeated_batches(spark, tmp_path):
    frame(spark, texts()).coalesce(1).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs")).union(spark.read.parquet(str(tmp_path / "docs")))
    toks = [(r.doc_id, WORD.findall((r.text or "").translate(FOLD)) + ["<end>"]) for r in docs.collect()]
    c = collections.Counter(w for i, ws in toks if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(c.values()), len(c)
    want = {i: (sum(w in c for w in ws), sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in toks}
    got, sharded = lm.scored(docs).collect(), rows(lm.scored(docs, filter_bytes=0))
    assert sorted(r.doc_id for r in got) == sorted(i for i, _ in toks)
    for r in got:
        assert (r.n_known, r.train_tokens) == (want[r.doc_id][0], n) and r.base_score == pytest.approx(want[r.doc_id][1])
        assert sharded[r.doc_id].score == pytest.approx(r.score)


def test_filter_keeps_counts_and_few_false_ones():
    rng = np.random.default_rng(5)
    keys, counts = rng.integers(0, 2**48, 20_000).astype(np.uint64), rng.geometric(0.3, 20_000)
    s = lm.Segment.of(keys, counts)
    levels = s.levels(keys).astype(int)
    assert (levels >= np.searchsorted(lm._THRESHOLDS, counts, "right")).all()
    assert (lm._THRESHOLDS[levels - 1] <= counts).mean() > 0.95
    assert (s.levels(rng.integers(0, 2**48, 20_000).astype(np.uint64)) > 0).mean() < 0.05


def test_byte_bpe_equals_tiktoken(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    values = [*texts(), "  a  b\n\n c\t\td ", "it's we'll 'spam don't.", "\x1c a\x85b c  ", "<|endoftext|>", "aaaa" * 300]
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    ids = bpe.encoded(frame(spark, values), path, public_tokenizers.PATTERN)
    got = rows(ids)
    assert all(got[i].ids == want.encode_ordinary(t or "") for i, t in enumerate(values))
    back = rows(bpe.decoded(ids, path, public_tokenizers.PATTERN))
    assert all(bytes(back[i].decoded) == (t or "").encode() for i, t in enumerate(values))
    assert back[1].ids_sha256 == hashlib.sha256(b"").hexdigest()


def test_merge_joins_least_rank_first_leftmost():
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 256, b"ab": 257, b"aab": 258, b"aaaa": 259}
    assert bpe.merge(b"aaaab", ranks) == [256, 258]
    assert bpe.merge(b"aaaa", ranks) == [259]
    assert bpe.merge(b"aaab", ranks) == [256, 257]


@pytest.mark.parametrize("many_sources", [False, True])
def test_packing(spark, monkeypatch, many_sources):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BLOCK", 2)
    if many_sources:
        monkeypatch.setattr(packing, "QUEUES", 3)
    values = texts(n=80) * 3
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = packing.packed(packing.encoded(frame(spark, values), path, 0), with_ids=True).collect()
    t = Tokenizer.from_file(path)
    want = {i: e.ids + [0] for i, e in enumerate(t.encode_batch([v or "" for v in values], add_special_tokens=False))}
    for i, ids in want.items():
        mine = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in mine for x in np.frombuffer(r.ids, "<u4").tolist()] == ids
        assert all(r.doc_tokens == len(ids) and r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids) for r in mine)
        assert all(a.start + a.length == b.start for a, b in zip(mine, mine[1:], strict=False))
    windows = collections.defaultdict(list)
    for r in out:
        windows[r.sequence_id].append((r.offset, r.length, r.doc_id))
    total = sum(map(len, want.values()))
    assert sorted(windows) == list(range(-(-total // 1024)))
    for w, held in windows.items():
        held.sort()
        assert held[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(held, held[1:], strict=False))
        assert held[-1][0] + held[-1][1] == (1024 if w < total // 1024 else total % 1024)
    if not many_sources:
        source = {i: f"s{i % 4}" if i % 7 else None for i in want}
        share = collections.Counter()
        for i, ids in want.items():
            share[source[i]] += len(ids) / total
        for w in range(total // 1024):
            here = collections.Counter()
            for _, n, i in windows[w]:
                here[source[i]] += n
            assert all(abs(here[s] / 1024 - share[s]) < 0.2 for s in share)
    assert packing.packed(packing.encoded(frame(spark, []), path, 0)).count() == 0


def test_packing_by_given_targets():
    from fractions import Fraction

    plan = packing.Plan([5000, 5000], [Fraction(3, 4), Fraction(1, 4)])
    taken = collections.Counter()
    for q, w, _, n in packing.fill(plan, 0, plan.total):
        taken[q] += n
        if w == 3:
            early = dict(taken)
    assert taken == {0: 5000, 1: 5000} and early[0] / (early[0] + early[1]) == pytest.approx(0.75, abs=0.05)


def test_packing_of_300_sources(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 16)
    docs = spark.createDataFrame([(i, f"token {i} " * 100, f"s{i // 3}") for i in range(900)], "doc_id long, text string, source string").coalesce(1)
    ids = packing.encoded(docs, public_tokenizers.path("byte_bpe_50k.json"), 0)
    out = sorted(packing.packed(ids).collect(), key=lambda r: (r.sequence_id, r.offset))
    totals, so_far = collections.Counter(), collections.Counter()
    for r in out:
        totals[r.doc_id // 3] += r.length
    total, done = sum(totals.values()), 0
    assert len(totals) == 300 and total > 200 * 1024
    for r in out:
        so_far[r.doc_id // 3] += r.length
        done += r.length
        assert abs(so_far[r.doc_id // 3] - totals[r.doc_id // 3] * done / total) < 200
    given = packing.packed(ids, targets={"s7": 0.5, "s290": 0.5}).where("sequence_id = 0").collect()
    taken = collections.Counter()
    for r in given:
        taken[r.doc_id // 3] += r.length
    assert set(taken) == {7, 290} and taken[7] / 1024 == pytest.approx(0.5, abs=0.1)
    with pytest.raises(ValueError):
        packing.packed(ids, targets={"nowhere": 1.0})


def test_line_dedup(spark):
    values = texts()
    seen = collections.defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    for i, t in enumerate(values):
        for line in (t or "").split("\n"):
            seen[key(line)].add(i)
    got = rows(linededup.deduplicated(frame(spark, values)))
    for i, t in enumerate(values):
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or i == min(seen[key(x)])]
        assert (got[i].text, got[i]["__n_lines"], got[i]["__n_dropped"]) == ("\n".join(kept), len(lines), len(lines) - len(kept)), i
    assert sum(r["__n_dropped"] for r in got.values()) > 10
    assert linededup.deduplicated(frame(spark, [])).count() == 0
    copied = rows(linededup.deduplicated(frame(spark, values), asked=3))
    assert {i: r.text for i, r in copied.items()} == {i: r.text for i, r in got.items()}


def test_lines_of_rows_with_one_id_or_none(spark):
    line = "a line that is long enough"
    docs = frame(spark, [line, line, line, line], ids=[4, 4, 7, None])
    assert sorted((r.doc_id or -1, r.text) for r in linededup.deduplicated(docs).collect()) == [(-1, ""), (4, line), (4, line), (7, "")]


def test_jpeg_round_trip_of_all_bytes(spark):
    rng = np.random.default_rng(2)
    payloads = [bytes(64), bytes(range(256)), b"\xff" * 128, b"\x80" * 64, bytes(200 * 64), rng.integers(0, 256, 64 * 77, np.uint8).tobytes(), b"\x00" * 63 + b"\x01"]
    files = media.encode(payloads)
    found = media.decode(files)
    assert [media.payload_of(f) for f in found] == payloads
    for p, f in zip(payloads, found, strict=True):
        n = len(p) // 64
        dc = np.frombuffer(p, np.int8).reshape(-1, 64)[:, 0].astype(int)
        assert f["width"] * f["height"] >= 64 * n
        assert f["thumbnail"].ravel()[:n].tolist() == np.floor(dc / 8 + 128.5).astype(int).tolist()
    with pytest.raises(ValueError):
        media.decode([b"no image"])
    with pytest.raises(ValueError):
        media.decode([files[1][: len(files[1]) // 2]])


def test_jpeg_of_three_components_without_restarts():
    """One unit of 2x1 luminance blocks and two chrominance blocks, whose codes are written by hand."""
    head = media._segment(0xDB, bytes([0]) + bytes([2] * 64)) + media._segment(0xC4, bytes([0x00, *media._DC_COUNTS, *media._DC]) + bytes([0x10, *media._AC_COUNTS, *media._AC]))
    frame_ = media._segment(0xC0, b"\x08" + (8).to_bytes(2, "big") + (16).to_bytes(2, "big") + bytes([3, 1, 0x21, 0, 2, 0x11, 0, 3, 0x11, 0]))
    scan = media._segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    bits = ""
    for diff in (80, -30, 5, 0):
        size = abs(diff).bit_length()
        bits += format(int(media._DC_CODE[size]), f"0{int(media._DC_LENGTH[size])}b")
        bits += format(diff if diff >= 0 else diff + (1 << size) - 1, f"0{size}b") if size else ""
        bits += format(int(media._AC_CODE[0]), f"0{int(media._AC_LENGTH[0])}b")
    bits += "1" * (-len(bits) % 8)
    raw = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    (got,) = media.decode([b"\xff\xd8" + head + frame_ + scan + raw + b"\xff\xd9"])
    assert got["coefficients"][:, 0].tolist() == [80, 50, 5, 0]
    assert got["thumbnail"].tolist() == [[148, 141]]


def test_media_of_texts(spark):
    values = texts(n=10)
    got = rows(media.described(media.stored(frame(spark, values))))
    for i, t in enumerate(values):
        raw = (t or "").encode()
        padded = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert got[0].feature == got[1].feature


def test_quality_statistics(spark):
    values = [*texts(), "x y z " * 30, " ".join(f"w{i}" for i in range(60))]
    labels = spark.createDataFrame([(len(values) - 1, 1), (3, 0), (None, 1), (3, 1)], "doc_id long, quality int")
    docs = frame(spark, values)
    got = rows(quality.annotated(docs, quality.fit(docs, labels)))
    for i, t in enumerate(values):
        t = t or ""
        w = WORD.findall(t)
        windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        worded = [x for x in t.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(worded) - len(set(worded)), len(repeated), failed)
        assert not (r.base_failed and r.kept)
    assert got[len(values) - 1].kept and got[len(values) - 1].score > 0
    nothing = quality.fit(docs, labels.limit(0))
    assert not nothing.any() and quality.filtered(docs, nothing).columns == docs.columns


def test_verdicts_of_planted_documents_at_any_size(spark):
    rng = random.Random(4)
    clean_words, junk_words = [f"c{i}" for i in range(400)], [f"j{i}" for i in range(400)]

    def text(words):
        return " ".join(rng.choice(words) for _ in range(80))

    planted = {0: text(clean_words), 1: text(clean_words), 2: text(junk_words), 3: text(junk_words)}
    clean, junk = [text(clean_words) for _ in range(900)], [text(junk_words) for _ in range(90)]
    for n_clean, n_junk, every in ((100, 10, 1), (900, 90, 1), (900, 90, 6), (900, 90, 12)):
        values = [*planted.values(), *clean[:n_clean], *junk[:n_junk]]
        labels = [(i, int(i < 4 + n_clean)) for i in range(4, len(values), every)]
        docs = frame(spark, values)
        got = rows(quality.annotated(docs, quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))))
        assert [got[i].kept for i in planted] == [True, True, False, False], (n_clean, every)
        assert sum(not got[i].kept for i in range(4, 4 + n_clean)) <= 0.03 * n_clean


def test_directly_addressable_codes(spark):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(4)
    ids = np.concatenate([rng.integers(0, 300, 3000), rng.integers(0, 2**31, 50), [0, 255, 256, 65535, 65536]]).astype(np.int64)
    f = dac.DacFile(dac.pack(ids, [7], np.array([len(ids)])))
    at = rng.permutation(len(ids))
    assert (f.all() == ids).all() and (f.at(at) == ids[at]).all()
    values = texts(n=20)
    path = public_tokenizers.path("word_bpe_49k.json")
    packed = dac.files(frame(spark, values), path, 1, file_ids=500)
    got = rows(dac.read(packed))
    start = 0
    for i, e in enumerate(Tokenizer.from_file(path).encode_batch([v or "" for v in values], add_special_tokens=False)):
        want = e.ids + [1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    assert packed.count() > 3
    assert dac.read(dac.files(frame(spark, []), path, 1)).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><a href=/>Home, sweet, home</a></header>
<nav><ul><li><a href=1>Menu</a></ul></nav><div id="cookie-notice">We use cookies, many, many of them.</div><div class="wrap"><aside><p>Aside, with text, and commas.</p></aside>
<div class="content"><h2>A &amp; B</h2><p>First paragraph, with commas,   and a<br>break.<p>Second &copy; <a href=x>link</a>.<ul><li>One<li>Two</ul><form><p>Subscribe, please, now</p></form><script>"<p>no</p>"</script>
<div class="ad-box">Buy, buy, buy</div></div><div class="post-comments"><p>Great, post, really, loved it, so much, wow, thanks.</p></div></div><footer>&copy; us</footer></body></html>"""


def test_main_text(spark):
    assert html.main_text(PAGE) == "A & B\n\nFirst paragraph, with commas, and a break.\n\nSecond © link.\n\nOne\n\nTwo"
    assert html.main_text("just text, no tags") == "just text, no tags"
    assert html.main_text("<p>broken <b>tags<p>and more") == "broken tags\n\nand more"
    assert html.main_text("<nav>only menus</nav>") == "" == html.main_text("") == html.main_text(None)
    pages = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 5)], "page_id long, url string, html string, n_chars int")
    assert {r.page_id: r.n_chars for r in html.extracted(pages).collect()} == {1: len(html.main_text(PAGE)), 2: 0}


def thue_morse(n: int) -> tuple[str, str]:
    """A word over two letters and its complement, which polynomial hashes modulo a power of two confuse."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_span_hashes_of_regular_texts():
    rng = np.random.default_rng(4)
    values = [w for n in (1, 2, 4, 8, 16, 64, 256, 1024, 2048, 8192) for w in thue_morse(n)]
    values += ["a" * n for n in range(2, 40)] + ["ab" * n for n in range(2, 40)]
    for n in (9, 16, 17, 64, 200):  # one byte changed, words of eight bytes exchanged
        base = bytes(rng.integers(97, 123, n).astype(np.uint8)).decode()
        values += [base] + [base[:k] + "_" + base[k + 1 :] for k in range(n)] + ([base[8:16] + base[:8] + base[16:]] if n > 16 else [])
    values = sorted(set(values))
    piece = next(pieces(pa.array(values)))
    both = [piece.hash(piece.offsets[:-1], piece.offsets[1:], which) for which in (0, 1)]
    assert len(set(both[0].tolist())) == len(set(both[1].tolist())) == len(values)
    assert len(set(both[0].tolist()) & set(both[1].tolist())) == 0
    shifted = next(pieces(pa.array(["x", "yz", *values])))
    assert (shifted.hash(shifted.offsets[2:-1], shifted.offsets[3:]) == both[0]).all()


def test_regular_words_in_every_operator(spark):
    words = [w for n in (256, 1024, 2048, 8192) for w in thue_morse(n)]
    docs = frame(spark, words)
    assert {d: (r.n_shingles, r.component_id) for d, r in rows(neardup.linked(docs)).items()} == {i: (1, i) for i in range(len(words))}
    assert {r.doc_id: (r.text, r["__n_dropped"]) for r in linededup.deduplicated(docs).collect()} == {i: (w, 0) for i, w in enumerate(words)}
    table, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    assert {r.doc_id: bytes(r.decoded).decode() for r in bpe.decoded(bpe.encoded(docs, table, pattern), table, pattern).collect()} == dict(enumerate(words))
    from tokenizers import Tokenizer

    for name, end in (("word_bpe_49k.json", 1), ("byte_bpe_50k.json", 0)):
        library, path = Tokenizer.from_file(public_tokenizers.path(name)), public_tokenizers.path(name)
        ids = [library.encode(w, add_special_tokens=False).ids + [end] for w in words]
        want = {i: zlib.crc32(np.array(x, "<u4").tobytes()) for i, x in enumerate(ids)}
        if end:
            assert {r.doc_id: r.ids_crc32 for r in dac.read(dac.files(docs, path, end_id=end)).collect()} == want
        else:
            got = collections.Counter()
            for r in packing.packed(packing.encoded(docs, path, end_id=end)).collect():
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
                got[r.doc_id] += r.length
            assert got == {i: len(x) for i, x in enumerate(ids)}
    lines = frame(spark, ["\n".join(words)])
    found = quality.annotated(lines, quality.Model(np.zeros(quality.BUCKETS))).first()
    assert (found.n_words, found.n_dup_lines, found.n_repeat_words) == (len(words), 0, 0)
    known = {i for i in range(len(words)) if zlib.crc32(str(i).encode()) % 10}
    n, v = 2 * len(known), len(known) + 1
    for i, r in rows(lm.scored(docs)).items():
        c = 1 if i in known else 0
        assert r.base_score == pytest.approx(math.log10((c + 0.1) / (n + 0.1 * (v + 1))) + math.log10((len(known) + 0.1) / (n + 0.1 * (v + 1))))


def test_a_first_hash_shared_by_chunks_is_told_apart(monkeypatch):
    """With a first hash of four values only, ids still come out as the library's."""
    from marlstone.llm import spans, tokens

    plain = spans.Piece.hash
    monkeypatch.setattr(spans.Piece, "hash", lambda self, a, b, which=0: plain(self, a, b, which) % np.uint64(4) if which == 0 else plain(self, a, b, which))
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = tokens.LibraryEncoder(path)
    values = [t or "" for t in texts(n=10)]
    for p in pieces(pa.array(values)):
        ids, bounds = encoder.encode(p)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == encoder.of_texts(values[p.first : p.first + p.n])
