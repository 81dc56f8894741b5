"""Tokens, packing and token files: exact round trips and plans held against bounds."""

import io
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import packing as P
from lodestone.llm import token_files as T
from lodestone.llm.tokens import WordTokenizer, batches

PATH = public_tokenizers.path("word_bpe_49k.json")
OWN = Tokenizer.from_file(PATH)
TEXTS = [
    None,
    "",
    " ",
    "\n\n",
    "Hello, World. It's here... isn't it?! 12,5 a_b, c._ d",
    "a.́b é, é É Ünï. ÀÉ, b",
    "Σας ΣΑΣ İstanbul, ı. ﬁ ½ x² ⅷ! ㎏!! µ,",
    "<|endoftext|>x a<|startoftext|> <|endoftext|>. 's 'll, don't. I'LL'",
    "tab\tform\x0cvert\x0bsep\x1c\x85nel line",
    "中文,文字。 한국어 العربية.",
    "foo...bar., a!! b%%% c$$$, ö;; x;y !!a it!'s b'! É###",
    "word " * 30000,
    "x" * 5000,
]


def slow(text, *more):
    return np.array([*OWN.encode(text or "", add_special_tokens=False).ids, *more], "<u4").tobytes()


def test_words_in_order_are_the_text():
    tok = WordTokenizer(PATH)
    assert tok.encode(TEXTS) == [slow(t) for t in TEXTS]
    assert tok.encode(TEXTS[::-1]) == [slow(t) for t in TEXTS[::-1]]  # from the cache
    assert tok.encode([]) == []
    rng = random.Random(2)
    alphabet = "ab É.,'!_ \n1ß́ÿĀ<|>"
    noise = ["".join(rng.choice(alphabet) for _ in range(40)) for _ in range(400)]
    assert tok.encode(noise) == [slow(t) for t in noise]


MARKS = [".", ",", "!", "_", "'", "-", "\x1c", "\x1f", "a", "1", "é", " "]


def test_every_low_character_beside_every_mark():
    """U+0000 to U+017F and some others between, before and behind marks, against the whole text's encoding."""
    tok = WordTokenizer(PATH)
    odd = [*map(chr, range(0x180)), "\u0301", "\u1680", "\u2003", "\u2028", "\u3000", "\ufeff", "\u200b", "\U0001f600"]
    for c in odd:
        texts = [x + c + y for x in MARKS for y in MARKS] + [c + x + y for x in MARKS for y in MARKS] + [x + y + c for x in MARKS for y in MARKS]
        assert tok.encode(texts) == [slow(t) for t in texts], hex(ord(c))


def test_random_low_characters():
    tok, rng = WordTokenizer(PATH), random.Random(31)
    pool = [*map(chr, range(0x180)), *"..,,  \n''", *map(chr, range(0x1C, 0x20))]
    texts = ["".join(rng.choices(pool, k=rng.randrange(1, 30))) for _ in range(20_000)]
    assert tok.encode(texts) == [slow(t) for t in texts]


def test_cache_is_bounded(monkeypatch):
    import lodestone.llm.tokens as K

    monkeypatch.setattr(K, "CACHE_BYTES", 4000)
    monkeypatch.setattr(K, "AT_ONCE", 3)
    tok = WordTokenizer(PATH)
    for k in range(20):
        text = " ".join(f"w{chr(97 + k)}{chr(97 + j)}" for j in range(9)) + " same " + "y" * 99
        assert tok.encode([text, text]) == [slow(text)] * 2
        assert len(tok.young) + len(tok.old) < 30 and "y" * 99 not in tok.young


def test_memory_of_a_worker_on_a_million_words():
    """What a worker takes beyond the model stays bounded, however many distinct words it meets."""
    code = f"""
import random, sys
sys.path.insert(0, {str(Path(P.__file__).parents[2])!r})
from lodestone.llm.tokens import WordTokenizer, batches
now = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6
tok, rng, most = WordTokenizer({PATH!r}), random.Random(1), 0
base = now()
for _ in range(5):
    texts = [" ".join("".join(rng.choices("abcdefgh", k=7)) for _ in range(20_000)) for _ in range(10)]
    for a, b in batches(texts):
        tok.encode(texts[a:b])
        most = max(most, now())
print(most - base)
"""
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert said.returncode == 0, said.stderr
    assert float(said.stdout) < 260


def test_batches_cover_all():
    assert list(batches(["a" * 5, None, "b" * 9, "c"], 6)) == [(0, 1), (1, 3), (3, 4)] and list(batches([])) == []


def histogram(lengths):
    n, c = np.unique(lengths, return_counts=True)
    return {int(a): int(b) for a, b in zip(n, c)}


def best_fit(h, room=P.CAPACITY):
    bins = []
    for length in sorted((x for x, n in h.items() for _ in range(n)), reverse=True):
        fit = [k for k, left in enumerate(bins) if left >= length]
        if fit:
            k = min(fit, key=lambda k: bins[k])
            bins[k] -= length
        else:
            bins.append(room - length)
    return len(bins)


@pytest.mark.parametrize(
    "h",
    [
        {},
        {1: 1},
        {4096: 3},
        {2049: 100, 2048: 7, 2047: 95},
        {1365: 300, 1366: 3},
        histogram(np.random.default_rng(0).integers(1, 4096, 60)),
        histogram(np.random.default_rng(1).integers(900, 1900, 3000)),
        histogram(np.random.default_rng(2).integers(1366, 2100, 1500)),
        histogram(np.random.default_rng(3).choice([1025, 1366, 820, 2049, 700, 3000], 2000)),
        histogram(np.minimum(np.random.default_rng(4).lognormal(6.4, 1, 4000).astype(int) + 1, 4096)),
    ],
)
def test_plan(h):
    runs = P.plan(h)
    placed = {}
    for run in runs:
        assert run.times > 0 and sum(n * k for n, k in run.lengths.items()) <= P.CAPACITY
        for n, k in run.lengths.items():
            placed[n] = placed.get(n, 0) + k * run.times
    assert placed == h
    used, least = sum(r.times for r in runs), -(-sum(n * k for n, k in h.items()) // P.CAPACITY)
    assert least <= used <= best_fit(h) * 1.002 + 1


def test_plan_refuses_bad_lengths():
    for bad in ({0: 1}, {4097: 1}):
        with pytest.raises(ValueError):
            P.plan(bad)


def test_price_is_the_best_multiset():
    rng = np.random.default_rng(5)
    for _ in range(20):
        sizes, values = rng.integers(1, 9, 4), rng.random(4)
        best, counts = P.price(values, sizes, 20)
        assert (counts * sizes).sum() <= 20 and abs((counts * values).sum() - best) < 1e-9

        def slow_best(room, k):
            if k == 4:
                return 0.0
            return max(n * values[k] + slow_best(room - n * sizes[k], k + 1) for n in range(room // sizes[k] + 1))

        assert abs(slow_best(20, 0) - best) < 1e-9


def test_linear_program_covers_at_near_the_least_cost():
    sizes, demand = np.array([86, 64, 50, 40]), np.array([30.0, 50.0, 20.0, 80.0])
    found = P.configuration_lp(sizes, demand, 256, 0.05)
    covered = sum(c * x for c, x in found)
    assert all((c * sizes).sum() <= 256 for c, _ in found) and (covered >= demand - 1e-6).all()
    assert sum(x for _, x in found) <= 1.15 * (sizes * demand).sum() / 256


def test_packed_documents(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, "no name"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("offset", F.lit("x")).withColumn("length", F.lit("y"))
    got = P.pack_documents(docs, PATH, capacity=4096, with_ids=True).collect()
    want = []
    for d, t in rows:
        ids = slow(t, P.END)
        want += [(d, k, at // 4, len(ids[at : at + 16384]) // 4, zlib.crc32(ids[at : at + 16384]), ids[at : at + 16384]) for k, at in enumerate(range(0, len(ids), 16384))]
    assert sorted(map(str, want)) == sorted(str((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, bytes(r.ids))) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    assert P.pack_documents(docs.limit(0), PATH).collect() == []


def test_many_pieces_of_one_length(spark):
    pieces = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.when(F.col("id") % 3 == 0, 1000).otherwise(F.col("id") % 50 + 1).cast("long").alias("length"))
    got = P.pack(pieces).collect()
    assert len({(r.sequence_id, r.offset) for r in got}) == 3000
    ends = {}
    for r in got:
        ends[r.sequence_id] = ends.get(r.sequence_id, 0) + r.length
    assert max(ends.values()) <= 4096


def test_file_format():
    import zstandard

    out = io.BytesIO()
    w = T.TokenFileWriter(out)
    docs = [(None, b""), (1, b"\x01\0\0\0" * 5), (1, b""), (4, np.arange(70000, dtype="<u4").tobytes())]
    for d, ids in docs:
        w.add(d, ids)
    w.close()
    data = out.getvalue()
    f = T.TokenFile(io.BytesIO(data))
    assert [f.frame(k) for k in range(4)] == [ids for _, ids in docs]
    assert [x.tolist() for x in f.document(1)] == [[1] * 5, []] and f.document(2) == [] and len(f.document(None)) == 1
    assert b"".join(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() for _ in range(1)) == b"".join(ids for _, ids in docs)
    for at in (int(f.at[3]) + 20, len(data) - 20):
        broken = bytearray(data)
        broken[at] ^= 0xFF
        with pytest.raises(Exception):
            T.TokenFile(io.BytesIO(bytes(broken))).frame(3)
    with pytest.raises(ValueError):
        T.TokenFile(io.BytesIO(b"nothing to see here"))


def test_files_round_trip(spark, tmp_path):
    rows = [(k * 7 % 13, t) for k, t in enumerate(TEXTS)] + [(None, "no name"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("x"))
    files = T.write_token_files(docs, PATH, f"file://{tmp_path}/out")
    got = T.read_token_files(spark, files, with_ids=True).orderBy("start", "n_tokens").collect()
    assert sorted((str(r.doc_id), bytes(r.ids)) for r in got) == sorted((str(d), slow(t, T.END)) for d, t in rows)
    ordered = [r.doc_id for r in got]
    assert ordered == sorted(ordered, key=lambda d: (d is not None, d or 0))
    at = 0
    for r in got:
        assert (r.start, r.ids_crc32) == (at, zlib.crc32(bytes(r.ids)))
        at += r.n_tokens
    none = T.write_token_files(docs.limit(0), PATH, f"file://{tmp_path}/none")
    assert none == [] and T.read_token_files(spark, none).collect() == []
