"""Stages of the pipeline on rows made for them."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import simhash
from test_near import slow_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
HEADER = "a header that many documents repeat"


def rows(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t)) for k, t in enumerate(texts)], SCHEMA)


def test_documents_of_short_lines_outlive_a_repeated_header(spark):
    verse = "\n".join(f"short line {k}" for k in range(40))
    sentences = "\n".join(chr(0x4E00 + k) * 18 for k in range(9))  # nine words by white space, but nearly the whole text
    scraps, nothing = "ten\nwords\nhere", "\n \n"
    texts = [HEADER, f"{HEADER}\n{verse}", f"{HEADER}\n{sentences}", f"{HEADER}\n{scraps}", f"{HEADER}\n{nothing}", HEADER, None, ""]
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.lines(spark, rows(spark, texts), "").collect()}
    assert out == {0: (HEADER, len(HEADER)), 1: (verse, len(verse)), 2: (sentences, len(sentences)), 6: (None, None), 7: ("", 0)}


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def similarity(a, b):
    return len(a & b) / len(a | b)


def changed(rng, words, n):
    out = list(words)
    for k in rng.sample(range(10, len(words) - 10, 6), n):
        out[k] = f"new{rng.randrange(10**9)}"
    return out


@pytest.mark.parametrize("chunk", [1 << 17, 600])
def test_near_stage_acts_at_shingle_similarity(spark, monkeypatch, chunk):
    """Recall at 0.8 and more, and no false link, against exact similarities; many pairs are just below."""
    monkeypatch.setattr(simhash, "CHUNK_SHINGLES", chunk)
    rng = random.Random(12)
    texts = []
    for k in range(120):
        words = [f"w{rng.randrange(10**9)}" for _ in range(300)]
        texts += [" ".join(words), " ".join(changed(rng, words, 3 + k % 9))]
    hub = [f"h{k}" for k in range(300)]
    texts += [" ".join(changed(rng, hub, 3)) for _ in range(30)]
    sets = [shingle_set(t) for t in texts]
    label = slow_components(len(texts), lambda a, b: similarity(sets[a], sets[b]) >= 0.8)
    want = {k for k, x in enumerate(label) if x == k}
    got = {r.doc_id for r in corpus_pipeline.near(spark, rows(spark, texts), "").collect()}
    linked = len(texts) - len(want)
    assert want <= got  # what has no partner at 0.8 stays
    assert len(got - want) <= 0.03 * linked and 240 - 120 < len(want) - 1 < 240


def test_near_stage_of_odd_rows(spark):
    text = " ".join(f"w{k}" for k in range(80))
    odd = [(1, "first of its kind here"), (1, text), (1, text), (0, text.upper()), (2, None), (3, " "), (None, text), (None, text), (4, "alone"), (4, "quite another")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in odd], SCHEMA)
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near(spark, docs, "").collect()), key=str)
    assert got == sorted([(1, odd[0][1]), (0, text.upper()), (2, None), (None, text), (None, text), (4, "alone"), (4, "quite another")], key=str)
    assert corpus_pipeline.near(spark, docs.limit(0), "").collect() == []


def test_stages_on_odd_tables(spark):
    """Nulls in every column, empty and repeated rows and ids, clashing names, a long text, and no rows at all."""
    long_ = " ".join(f"word{k}" for k in range(20_000))
    prose = " ".join(f"tale{k}" for k in range(40))
    table = [(1, prose, "en", "s", 9), (1, prose, "en", "s", 9), (1, long_, None, None, None), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (None, prose + " end", "en", None, 5), (None, None, None, None, None), (4, prose.upper(), "en", "src0", 9)]
    docs = spark.createDataFrame(table, SCHEMA)
    clash = docs.withColumns({c: F.lit("x") for c in ("kept", "n_words", "removed", "copy", "shuffle_key", "unit", "group", "id", "fps", "first", "cdf", "rate", "d", "k1", "line", "size", "sequence_id", "offset", "length", "piece", "__row")})
    for _, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, clash, ""), stage(spark, clash.limit(0), "")
        assert out.columns == none.columns and none.collect() == [] and out.count() > 0
        if stage is not corpus_pipeline.packing:
            assert out.columns == docs.columns
    kept = corpus_pipeline.quality(spark, clash, "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, len(r.text)) for r in kept) == sorted((d is None, d or 0, len(t)) for d, t, *_ in table if t)
    near = corpus_pipeline.near(spark, clash, "").collect()
    assert sorted(str((r.doc_id, r.text)) for r in near) == sorted(str((d, t)) for d, t in [(1, prose), (1, long_), (None, prose + " end"), (2, None), (None, None)])
    packed = corpus_pipeline.packing(spark, clash, "").collect()
    assert sum(r.length == 1 for r in packed) == 3 and len({(r.sequence_id, r.offset) for r in packed}) == len(packed)


def test_what_a_stage_wrote_on_its_way_is_removed(spark, tmp_path):
    from lodestone.llm import common

    spark.range(3).selectExpr("id as doc_id", f"'{HEADER} ' || id as text", "'en' as lang", "'s' as source", "id as n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = {n.rsplit("-", 1)[0] for n in set(os.listdir(folder)) - before}
    assert {f"stage{k}" for k in range(4)} <= left and not left & {"measured", "hosts", "lines", "line-groups", "fingerprints", "sources"}


def test_broadcasts_are_bounded_by_bytes(spark, monkeypatch):
    from lodestone.llm import common

    narrow, wide = spark.range(10), spark.range(10).selectExpr("id", "cast(id as string) as a", "array(id) as b")
    assert common.broadcast_rows(narrow) > 4 * common.broadcast_rows(wide)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 10 * 24)
    assert common.small(narrow) and not common.small(wide)
