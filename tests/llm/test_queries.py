"""The registered queries on the smallest data: against their SQL, brute force, or held-out labels; and the pipeline."""

import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodestone.llm import chat, linededup, mixing, queries
from test_documents import slow_counts
from test_near import slow_components, slow_print, slow_removed
from test_pipeline import shingle_set, similarity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
Q = queries.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("documents", "labels", "conversations"):
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.execute("select doc_id, coalesce(text, '') from documents").fetchall())


@pytest.fixture(scope="module")
def ids(texts):
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {d: own.encode(t, add_special_tokens=False).ids for d, t in texts.items()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_twin(spark, duck, name):
    out = Q[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in out.columns)
    assert sorted(map(tuple, out.collect()), key=str) == sorted(duck.execute(f"select {columns} from ({queries.oracle_sql()[name]})").fetchall(), key=str)


def test_op1(spark, texts):
    names = sorted(texts)
    prints = [slow_print(texts[d]) for d in names]
    label = slow_components(len(names), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    want = {(d, f"{p:016x}", names[k]) for d, p, k in zip(names, prints, label)}
    assert {tuple(r) for r in Q["op1_simhash_gray_index"](spark, SF).collect()} == want


def test_op2(spark, ids):
    got = Q["op2_configuration_packing"](spark, SF).collect()
    want = []
    for d, x in ids.items():
        x = np.array([*x, 1], "<u4")
        want += [(d, k // 4096, k, len(x[k : k + 4096]), zlib.crc32(x[k : k + 4096].tobytes())) for k in range(0, len(x), 4096)]
    assert sorted(want) == sorted(tuple(r)[:5] for r in got)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in places.values():
        assert [o for o, _ in sorted(rows)] == [0, *np.cumsum([n for _, n in sorted(rows)])[:-1]] and sum(n for _, n in rows) <= 4096
    assert len(places) <= 1.01 * -(-sum(r.length for r in got) // 4096) + 1  # close to what the volume needs


def test_op3(spark, duck):
    turns = {-7: [(0, "user", chat.PROBE), (1, "assistant", chat.PROBE)]}
    for c, k, role, text in duck.execute("select conv_id, turn, role, text from conversations").fetchall():
        turns.setdefault(c, []).append((k, role, text or ""))
    got = {r.conv_id: r for r in Q["op3_reply_tree_chat"](spark, SF).collect()}
    assert set(got) == set(turns)
    for c, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, role, t in rows if role == "assistant")
        whole = hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in rows).encode()).hexdigest()
        escape = lambda t: re.sub(r"\[(?=/?INST\])", "&#91;", re.sub(r"<(?=\||/?s>|<SYS>>|</SYS>>)", "&lt;", t.replace("&", "&amp;")))
        chars = sum(len(f"<|im_start|>{role}\n{escape(t)}<|im_end|>\n") for _, role, t in rows)
        assert tuple(got[c]) == (c, len(rows), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars)


def test_op4(spark, ids):
    at, want = 0, []
    for d in sorted(ids):
        x = np.array([*ids[d], 2], "<u4")
        want.append((d, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(tuple(r) for r in Q["op4_seekable_token_files"](spark, SF).collect()) == want


def test_op10(spark, texts):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hashed = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    gone = slow_removed([(d, hashed[d], t) for d, t in texts.items()], linededup.EDITS, linededup.MIN_CHARS)
    got = {r.doc_id: r for r in Q["op10_line_edit_dedup"](spark, SF).collect()}
    assert set(got) == set(texts)
    for d, t in texts.items():
        out = gone.get((d, hashed[d]), set())
        assert (got[d].n_lines, got[d].n_removed, got[d].removed) == (len(t.split("\n")), len(out), sorted(out))
        assert got[d].text == "\n".join(x for k, x in enumerate(t.split("\n")) if k not in out)


def test_op6(spark, texts):
    got = Q["op6_interleaved_media"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.caption, r.position, r.n_items) == (f"The text of document {r.doc_id}", 1, 3)
        medium = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (r.media_bytes, r.media_sha256) == (len(medium), hashlib.sha256(medium).hexdigest())
        image = [payload[k : k + 64] for k in range(0, len(payload), 64)]
        mean, steps = sum(payload) / len(payload), [abs(a - b) for row in image for a, b in zip(row, row[1:])]
        spread = (sum((x - mean) ** 2 for x in payload) / len(payload)) ** 0.5
        slow = [mean, spread, sum(steps) / len(steps), *(sum(x // 32 == band for x in payload) / len(payload) for band in range(8))]
        assert np.allclose([float(x) for x in r.feature.split(",")], slow, atol=1.01e-4)


def test_op7_and_op8_cover_all(spark, texts, duck):
    for name, column in (("op7_toxicity_machine", "score"), ("op8_language_codes", "score")):
        rows = Q[name](spark, SF).collect()
        assert {r.doc_id for r in rows} == set(texts) and all(0 <= r[column] <= 1 for r in rows)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = dict(duckdb.sql(f"select doc_id, lang from '{sf}/documents.parquet'").fetchall())
    got = [r for r in Q["op8_language_codes"](spark, sf).collect() if r.held_out and r.lang_pred != "und"]
    assert sum(r.lang_pred == lang[r.doc_id] for r in got) > 0.97 * len(got)
    toxic = dict(duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall())
    held = [(r.predicted, toxic[r.doc_id]) for r in Q["op7_toxicity_machine"](spark, sf).collect() if r.held_out and r.doc_id in toxic]
    assert sum(p and not y for p, y in held) <= 0.03 * len(held) and sum(p and y for p, y in held) >= 0.5 * sum(y for _, y in held)


def test_pipeline_against_brute_force(spark, duck):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    # quality: the operator's verdict is held against its SQL elsewhere
    kept = dict(duck.execute(f"select doc_id, kept from ({queries.oracle_sql()['op9_host_quality']})").fetchall())
    rows = [r for r in rows if kept[r[0]]]
    assert all(slow_counts(r[1])[0] >= 10 for r in rows)
    one = corpus_pipeline.quality(spark, docs, SF)
    assert sorted(map(tuple, one.collect())) == sorted(rows) and one.columns == docs.columns
    # lines
    hashed = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    gone = slow_removed([(r[0], hashed[r[0]], r[1]) for r in rows], linededup.EDITS, linededup.MIN_CHARS)
    left = []
    for d, text, lang, source, n in rows:
        out = gone.get((d, hashed[d]), set())
        lines = [x for k, x in enumerate(text.split("\n")) if k not in out]
        if out and not any(len(x) >= linededup.MIN_CHARS and x.strip(" \t\n\r\x0b\x0c") for x in lines):
            continue
        whole = "\n".join(lines)
        left.append((d, whole, lang, source, len(whole) if out else n))
    two = spark.createDataFrame(corpus_pipeline.lines(spark, one, SF).collect(), docs.schema)
    assert sorted(map(tuple, two.collect())) == sorted(left)
    # near-duplicates
    left.sort()
    sets = [shingle_set(r[1]) for r in left]  # the stage acts at the exact similarity of five-word shingles
    label = slow_components(len(left), lambda a, b: similarity(sets[a], sets[b]) >= corpus_pipeline.SIMILARITY)
    left = [r for k, r in enumerate(left) if label[k] == k]
    three = spark.createDataFrame(corpus_pipeline.near(spark, two, SF).collect(), docs.schema)
    assert sorted(map(tuple, three.collect())) == left
    # mixing
    n = {}
    for r in left:
        n[r[3]] = n.get(r[3], 0) + 1
    others = sum(v for k, v in n.items() if k not in mixing.WEIGHTS)
    mixed = []
    for r in left:
        share = mixing.WEIGHTS.get(r[3], (1 - sum(v for k, v in mixing.WEIGHTS.items() if k in n)) * n[r[3]] / others)
        rate, u = share * len(left) / n[r[3]], int(hashlib.md5(f"{mixing.SEED}|{r[0]}".encode()).hexdigest()[:13], 16) / 2**52
        p = total = float(np.exp(-rate))
        copies = 0
        while total <= u:
            copies += 1
            p *= rate / copies
            total += p
        mixed += [r] * copies
    four = spark.createDataFrame(corpus_pipeline.mixing(spark, three, SF).collect(), docs.schema)
    assert sorted(map(tuple, four.collect())) == sorted(mixed)
    # packing, and the whole
    got = corpus_pipeline.run(spark, SF).collect()
    own = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = []
    for d, text, *_ in mixed:
        x = np.array([*own.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want += [(d, k // 4096, k, len(x[k : k + 4096]), zlib.crc32(x[k : k + 4096].tobytes())) for k in range(0, len(x), 4096)]
    assert sorted(want) == sorted(tuple(r)[:5] for r in got)
    filled = {}
    for r in got:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= 4096 and len({(r.sequence_id, r.offset) for r in got}) == len(got)


def test_names():
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in Q] == list(range(1, 11))
