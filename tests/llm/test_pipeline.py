"""The pipeline's stages, each against plain Python on what the stage before kept."""

from __future__ import annotations

import zlib

import numpy as np

from tokenizers import Tokenizer

import corpus_pipeline
from marlstone.llm import quality
from tests.llm.test_text_operators import FOLD, components, public_tokenizers, shingle_set, texts, thue_morse


def test_stages(spark, tmp_path):
    values = [t if t is None or i % 5 else t + " ###" * 400 for i, t in enumerate(texts(n=70))] + [" ".join(f"word{i % 61} and{i}" for i in range(40, 100))] * 3
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(values)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(0, len(values), 2)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], str(tmp_path)))
    assert all(k.columns == docs.columns for k in kept[:-1])
    by_stage = [{r.doc_id: r for r in k.collect()} for k in kept[:-1]]

    judged = {r.doc_id: r.kept for r in quality.annotated(docs, quality.fit(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))).collect()}
    assert set(by_stage[1]) == {i for i, ok in judged.items() if ok} and 5 < len(by_stage[1]) < len(values)

    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    first: dict[str, int] = {}
    for i in sorted(by_stage[1]):
        for line in by_stage[1][i].text.split("\n"):
            first.setdefault(key(line), i)
    for i, r in by_stage[1].items():
        want = "\n".join(x for x in r.text.split("\n") if len(key(x)) < 10 or first[key(x)] == i)
        assert (by_stage[2][i].text, by_stage[2][i].n_chars) == (want, len(want))

    comps = components({i: shingle_set(r.text) for i, r in by_stage[2].items()})
    assert set(by_stage[3]) == set(comps.values())

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    # windows follow the order in which rows are read, which exchanges don't fix, so each result is held against the texts
    for out in (kept[-1].collect(), corpus_pipeline.run(spark, str(tmp_path)).collect()):
        assert {p.doc_id for p in out} == set(by_stage[3])
        for i, r in by_stage[3].items():
            ids = np.array([*library.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
            mine = sorted((p for p in out if p.doc_id == i), key=lambda p: p.start)
            assert [p.start for p in mine] == np.cumsum([0, *(p.length for p in mine)]).tolist()[:-1] and sum(p.length for p in mine) == len(ids)
            assert all(p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in mine)
        for n in range(last := max(p.sequence_id for p in out) + 1):
            window = sorted((p for p in out if p.sequence_id == n), key=lambda p: p.offset)
            ends = np.cumsum([0, *(p.length for p in window)]).tolist()
            assert [p.offset for p in window] == ends[:-1] and (ends[-1] == 1024 or n == last - 1)


def test_near_duplicates_of_odd_rows(spark):
    """Null and repeated ids, texts without words, columns of their own names, and nothing at all."""
    text, other = "one two three four five six seven", "quite another text of some words"
    rows = [(5, text, 1), (5, other, 1), (5, text, 1), (9, text, 2), (None, text.upper(), 1), (None, "no other has these words at all", 1), (None, "no other has these words at all", 1), (1, None, 1), (1, None, 1), (2, "", 1)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), c, "x") for i, t, c in rows], "doc_id long, text string, lang string, source string, n_chars long, component long, component_id string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted([(0, rows[5][1]), (1, ""), (1, ""), (2, ""), (5, text), (5, other)])
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_all_stages_of_nulls_and_of_nothing(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, sequence_id string, shard int"
    long = " ".join(f"word{i} and{i % 17}" for i in range(80))
    for name, rows in (("odd", [(None, long, None, None, None, "x", 1), (7, long + " more", None, None, 3, "x", 1), (7, None, "en", "a", 0, None, None)]), ("none", [])):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([(7, 1, 0), (None, 0, None)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / name / "labels.parquet"))
        out = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert {r.doc_id for r in out} == ({7} if rows else set())


def test_long_regular_words_through_all_stages(spark, tmp_path):
    """Lines that are one long word over two letters, and its complement, stay in their documents."""
    values = [" ".join(f"w{i}x{k}" for k in range(60)) + "\n" + w for i, w in enumerate(w for n in (256, 1024, 8192) for w in thue_morse(n))]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(values)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r.doc_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(values)}
