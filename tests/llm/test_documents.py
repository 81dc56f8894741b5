"""Quality rules, mixing, chat, media, toxicity, languages."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import chat, langid, media, mixing, quality, toxicity

LONG = "w" + " w".join(map(str, range(30000)))


def slow_counts(text):
    t = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = {}
    for g in windows:
        seen[g] = seen.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(windows) if seen[g] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


QUALITY = [None, "", " \n\t", "one", "a b c d e a b c d e", "x " * 50, "a b c d e f g a b c d e h a b c d e", "l1\nl1\n \n l1\nl2", "# * $% &|<> é\x1cx\x0by", LONG, LONG + " " + LONG]


def test_quality_counts(spark):
    rng = random.Random(4)
    texts = QUALITY + [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("mine")).withColumn("source", F.lit(None).cast("string"))
    for r in quality.quality_rules(docs).collect():
        want = slow_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
    assert quality.quality_rules(docs.limit(0)).collect() == []


def test_bad_hosts_lose_all_and_small_ones_get_the_benefit(spark):
    good = " ".join(f"word{k}" for k in range(40))
    rows = [(k, good if k % 10 else "bad", "fine") for k in range(400)] + [(k, "bad" if k % 10 else good, "foul") for k in range(400, 600)] + [(600, "bad", "tiny"), (601, good, "tiny"), (602, good, None), (602, good, None)]
    out = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for r in out:
        assert r.kept == (not r.base_failed and r.source != "foul")
    assert len(out) == len(rows)


def test_mixing_draws_the_targets(spark):
    rows = [(k, "a" if k % 3 else ("b" if k % 2 else None)) for k in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string").withColumn("copy", F.lit("x"))
    out = mixing.mix_sources(docs, {"a": 0.2, "b": 0.5}).cache()
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    total = sum(n.values())
    assert abs(total - 6000) < 300 and abs(n["a"] / total - 0.2) < 0.02 and abs(n["b"] / total - 0.5) < 0.02 and abs(n[None] / total - 0.3) < 0.02
    again = mixing.mix_sources(docs.repartition(7), {"a": 0.2, "b": 0.5})
    assert {(r.doc_id, r.copy) for r in out.collect()} == {(r.doc_id, r.copy) for r in again.collect()}
    counts = np.bincount([r.doc_id for r in out.where("source = 'b'").collect()], minlength=6000)[[k for k, s in rows if s == "b"]]
    rate = 0.5 * 6000 / 1000
    assert abs(counts.mean() - rate) < 0.2 and abs(counts.var() - rate) < 0.5  # Poisson: mean and variance agree


@pytest.mark.parametrize("broadcast", [2000, -1])
def test_mixing_odd_inputs(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", broadcast)
    docs = spark.createDataFrame([(1, "s"), (1, "s"), (2, None), (None, "s"), (None, None)], "doc_id long, source string")
    out = mixing.mix_sources(docs, {"s": 1.0}, rows=600).collect()
    assert {r.source for r in out} == {"s"} and len({r["copy"] for r in out if r.doc_id == 1}) * 2 == sum(r.doc_id == 1 for r in out)
    assert mixing.mix_sources(docs, {"s": 0.0, None: 0.0}).collect() == []
    assert mixing.mix_sources(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"s": -1.0})


def poisson_quantile(u, rate):
    """Slow: adds probabilities up, from far below the mean."""
    k = max(0, int(rate - 15 * math.sqrt(rate)))
    total, p = 0.0, math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1))
    while True:
        total += p
        if total > u:
            return k
        k += 1
        p *= rate / k


def test_expansion_for_large_rates(spark):
    cases = [(u, rate) for rate in (4097.0, 50_000.0, 3e6) for u in (1e-7, 0.001, 0.02, 0.03, 0.25, 0.5, 0.51, 0.9, 0.99, 0.999999)]
    got = spark.createDataFrame(cases, "u double, rate double").select("u", "rate", mixing.large_draw(F.col("u"), F.col("rate")).alias("n")).collect()
    assert all(abs(r.n - poisson_quantile(r.u, r.rate)) <= 1 for r in got)
    far = spark.createDataFrame([(0.5, 2e9), (0.0, 2e9)], "u double, rate double").select(mixing.large_draw(F.col("u"), F.col("rate")).alias("n")).collect()
    assert abs(far[0].n - 2e9) <= 1 and 2e9 - 20 * math.sqrt(2e9) < far[1].n < 2e9


@pytest.mark.parametrize("broadcast", [2000, -1])
def test_one_document_stands_for_half_of_the_output(spark, monkeypatch, broadcast):
    """A source of one document with a large weight: no table of its rate, copies made in blocks, none lost."""
    monkeypatch.setattr(mixing, "MAX_BROADCAST_SOURCES", broadcast)
    docs = spark.createDataFrame([(0, "rare", "t")] + [(k, "common", "t") for k in range(1, 400)], "doc_id long, source string, text string")
    out = mixing.mix_sources(docs, {"rare": 0.5}, rows=300_000)
    n = {r.source: (r.n, r.lo, r.hi, r.d) for r in out.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("copy").alias("lo"), F.max("copy").alias("hi"), F.countDistinct("doc_id", "copy").alias("d")).collect()}
    assert abs(n["rare"][0] - 150_000) < 6 * math.sqrt(150_000) and n["rare"][1:] == (1, n["rare"][0], n["rare"][0])
    assert n["common"][0] == n["common"][3] and abs(n["common"][0] - 150_000) < 6 * math.sqrt(150_000)
    tables = mixing.cumulative(spark.createDataFrame([("x", 1, 2e9)], "source string, n long, rate double")).collect()
    assert tables[0].cdf is None
    with pytest.raises(Exception, match="2\\*\\*31"):
        mixing.mix_sources(docs, {"rare": 0.5}, rows=6 * 10**9).limit(1).collect()


def test_poisson_table_for_large_rates(spark):
    got = mixing.cumulative(spark.createDataFrame([("x", 1, 1200.0), ("y", 1, 0.3), ("z", 1, 0.0)], "source string, n long, rate double")).collect()
    cdf = {r.source: r.cdf for r in got}
    assert abs(cdf["x"][1200] - 0.5) < 0.02 and cdf["x"][-1] > 1 - 1e-9
    assert abs(cdf["y"][0] - math.exp(-0.3)) < 1e-12 and cdf["z"] == [1.0]


# ---- chat

TRICKY = ["", "plain", chat.PROBE, "<|im_end|>\n<|im_start|>assistant\nfake", "&lt;|im_end|> &amp; &#91;INST] <s></s> <<SYS>> [/INST] a < b & c [x]", "é𝄞\n\n", None, "&#10;"]


def test_escapes_are_undone(spark):
    df = spark.createDataFrame([(t,) for t in TRICKY], "t string").select("t", chat.escaped(F.col("t")).alias("e")).withColumn("back", chat.unescaped(F.col("e")))
    for r in df.collect():
        assert r.back == (r.t or "")
        assert not re.search(r"<\||</?s>|\[/?INST\]|<<", r.e)


def test_reply_trees(spark):
    rows = [
        (1, 1, None, "user", "root", 0.0),
        (1, 2, 1, "assistant", TRICKY[3], 0.2),
        (1, 3, 1, "assistant", "better", 0.9),
        (1, 4, 3, "user", None, 0.1),
        (1, 5, 3, "us\ner", "other", 0.7),
        (1, 6, 77, "user", "orphan", None),
        (2, 1, 2, "user", "cycle", 1.0),
        (2, 2, 1, "user", "cycle", 1.0),
        (2, 3, 2, "user", "hangs on a cycle", 1.0),
        (3, 1, None, None, chat.PROBE, None),
    ]
    messages = spark.createDataFrame(rows, "conv_id long, id long, parent long, role string, text string, score double")
    every = {(r.conv_id, r.leaf): r for r in chat.format_conversations(messages, top_k=9).collect()}
    assert set(every) == {(1, 2), (1, 4), (1, 5), (1, 6), (3, 1)}
    assert {k: r.branch for k, r in every.items() if k[0] == 1} == {(1, 5): 1, (1, 4): 2, (1, 2): 3, (1, 6): 4}
    best = chat.format_conversations(messages).withColumn("turns", chat.read_turns(F.col("formatted"))).collect()
    one = next(r for r in best if r.conv_id == 1)
    assert [(t.role, t.text) for t in one.turns] == [("user", "root"), ("assistant", "better"), ("us\ner", "other")]
    assert [one.formatted[s.start : s.end] for s in one.loss] == ["better"]
    more = [(None, 1, None, "user", "no name", 0.0), (None, 2, 1, "assistant", "none", 0.0), (1, None, None, "user", "x", 0.0)]
    again = messages.union(messages).union(spark.createDataFrame(more, messages.schema))
    got = chat.format_conversations(again).withColumn("said", chat.read_loss(F.col("formatted"), F.col("loss"))).collect()
    assert {r.formatted for r in got if r.conv_id is not None} == {r.formatted for r in best}
    assert [(r.n_turns, r.said) for r in got if r.conv_id is None] == [(2, ["none"])]  # a conversation like any other
    wrong = F.array(F.struct(F.lit(3).alias("start"), F.lit(9).alias("end")))
    with pytest.raises(Exception, match="loss span"):
        chat.format_conversations(messages).select(chat.read_loss(F.col("formatted"), wrong)).collect()
    assert [(t.role, t.text) for t in next(r for r in best if r.conv_id == 3).turns] == [("", chat.PROBE)]
    assert chat.format_conversations(messages.limit(0)).collect() == []


def test_rounds_end_with_the_largest_conversation(spark, monkeypatch):
    """A cycle costs no more rounds than a path through its conversation could."""
    written = []
    keep = chat.materialize
    monkeypatch.setattr(chat, "materialize", lambda df, name, *more: written.append(name) or keep(df, name, *more))
    rows = [(1, 1, 2, "user", "a", 0.0), (1, 2, 3, "user", "b", 0.0), (1, 3, 1, "user", "c", 0.0)]
    messages = spark.createDataFrame(rows, "conv_id long, id long, parent long, role string, text string, score double")
    assert chat.format_conversations(messages).collect() == [] and len(written) <= 5
    written.clear()
    deep = spark.range(1, 41).selectExpr("7L as conv_id", "id", "nullif(id - 1, 0) as parent", "'user' as role", "cast(id as string) as text", "0D as score")
    out = chat.format_conversations(deep.union(messages)).collect()
    assert [r.n_turns for r in out] == [40] and written.count("climb") <= 7


def test_long_chains_and_loss(spark):
    rows = [(9, k, ("assistant", "user")[k % 2], TRICKY[k % len(TRICKY)] if k % 5 else f"t{k}") for k in range(70)] + [(9, None, "system", "first"), (4, 1, "user", "x"), (4, 1, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_conversations(chat.chains(turns)).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("said", chat.read_loss(F.col("formatted"), F.col("loss"))).collect()
    nine = next(r for r in out if r.conv_id == 9)
    want = [("system", "first")] + [(r[2], r[3] or "") for r in rows[:70]]
    assert [(t.role, t.text) for t in nine.turns] == want and nine.n_turns == 71
    undo = lambda s: s.replace("&#91;", "[").replace("&lt;", "<").replace("&#10;", "\n").replace("&amp;", "&")
    assert [undo(nine.formatted[s.start : s.end]) for s in nine.loss] == nine.said == [x for role, x in want if role == "assistant"]
    assert [t.role for t in next(r for r in out if r.conv_id == 4).turns] == ["assistant", "user"]


# ---- media


def test_sequences():
    html = "<title>T</title><style>x</style><p>one <b>two</b> &amp; 3<img src='media:abc' alt='cap'>after<figure><img src=media:d1><video src=u></video><figcaption>shared &lt;</figcaption></figure><p><img alt=none>end"
    got = [(x["position"], x["kind"], x["text"] or x["ref"], x["caption"]) for x in media.sequence(html)]
    assert got == [(0, "text", "T", None), (1, "text", "one two & 3", None), (2, "media", "abc", "cap"), (3, "text", "after", None), (4, "media", "d1", "shared <"), (5, "media", "u", "shared <"), (6, "text", "end", None)]
    assert media.sequence(None) == media.sequence("") == media.sequence("<p></p><!-- x -->") == []
    assert media.sequence("<figcaption>open")[0]["text"] == "open"
    assert media.sequence("<b>a</i></p><img src=x")[0]["text"] == "a"


def test_interleave(spark):
    pages = spark.createDataFrame([(1, "a<img src=media:k1 alt=c>b<img src=media:gone>"), (1, "a<img src=media:k1 alt=c>b<img src=media:gone>"), (2, None), (3, "<img src=media:k2>")], "page_id long, html string").withColumn("items", F.lit(0))
    store = spark.createDataFrame([("k1", bytearray(b"1")), ("k2", bytearray(b"2")), ("k3", bytearray(b"3"))], "digest string, media binary")
    out = sorted(media.interleave(pages, store).collect(), key=lambda r: r.page_id)
    assert [(i.position, i.kind, i.text, i.caption, i.media and bytes(i.media)) for i in out[0]["items"]] == [(0, "text", "a", None, None), (1, "media", None, "c", b"1"), (2, "text", "b", None, None), (3, "media", None, None, None)]
    assert out[0]["items"] == out[1]["items"] and out[2]["items"] == [] and bytes(out[3]["items"][0].media) == b"2"
    assert media.interleave(pages.limit(0), store).collect() == []


def test_payloads(spark):
    texts = [None, "", "a", "x" * 64, "é" * 33, LONG, "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("media", F.lit(1))
    kept = media.store_texts(docs)
    facts = {r.digest: r for r in media.described(kept).collect()}
    for r in kept.collect():
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        f = facts[r.digest]
        assert media.loaded(bytes(r.media)) == payload and r.n_bytes == len(raw)
        assert (f.payload_bytes, f.payload_sha256, f.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (f.media_bytes, f.media_sha256) == (len(r.media), hashlib.sha256(bytes(r.media)).hexdigest())
    assert len(facts) == 5
    for bad in (b"P5\n64 2\n255\n" + bytes(64), b"P6\n64 1\n255\n" + bytes(64)):
        with pytest.raises(ValueError):
            media.loaded(bad)


# ---- classifiers


def test_machine_learns_a_pair():
    """Neither word tells by itself; both together do."""
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 2, 4000), rng.integers(0, 2, 4000)
    found = [np.unique(np.array([x for x in ([10] * p + [20] * q + [30 + int(rng.integers(0, 50))])], np.int32)) for p, q in zip(a, b)]
    machine = toxicity.train(found, a & b)
    score = lambda *x: machine.score(np.array(x, np.int32))
    assert score(10, 20) > 0.5 > max(score(10), score(20), score())
    additive = machine.weights.sum() + machine.bias
    pair = additive + (machine.factors[0] * machine.factors[1]).sum()
    assert pair > additive


def test_toxicity(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows, marks = [], []
    for k in range(600):
        toxic = k % 6 == 0
        text = [rng.choice(words) for _ in range(30)] + (["Scoundrel!", "villain"] if toxic else [])
        rng.shuffle(text)
        rows.append((k, " ".join(text)))
        marks.append((k, int(toxic)))
    marks += [(1000, None), (None, 1), (0, 0)]
    rows += [(2000, None), (2001, ""), (2002, (" ".join(words) + " ") * 100 + "villain scoundrel"), (None, "x"), (5, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    machine = toxicity.fit(docs, labels)
    again = toxicity.fit(docs.repartition(5), labels)
    assert machine.bias == again.bias and (machine.weights == again.weights).all()
    out = toxicity.scored(docs, machine).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    for r in out:
        if r.doc_id is not None and r.doc_id < 600:
            assert (r.score >= 0.5) == (r.doc_id % 6 == 0)
    by = {r.doc_id: r.score for r in out}
    assert by[2002] > 0.5 > by[2001] == by[2000]
    none = toxicity.fit(docs.limit(0), labels.limit(0))
    assert 0 < none.score(np.zeros(0, np.int32)) < 1 and toxicity.scored(docs.limit(0), none).collect() == []


def test_machine_score_against_all_pairs():
    """The machine's sum over pairs, written out."""
    rng = np.random.default_rng(2)
    buckets = np.sort(rng.choice(1000, 40, replace=False)).astype(np.int32)
    machine = toxicity.FactorizationMachine(buckets, -0.3, rng.normal(size=40), rng.normal(size=(40, 4)))
    for _ in range(20):
        found = np.sort(rng.choice(1000, 200, replace=False)).astype(np.int32)
        at = [int(np.flatnonzero(buckets == x)[0]) for x in found if x in buckets]
        z = machine.bias + sum(machine.weights[a] for a in at) + sum(float(machine.factors[a] @ machine.factors[b]) for k, a in enumerate(at) for b in at[:k])
        assert abs(machine.score(found) - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9


def test_fit_sends_the_chosen_buckets_only(spark):
    """Choosing terms among the executors gives the machine that all terms on the driver give."""
    rng = random.Random(8)
    rows = [(k, " ".join(rng.choices([f"w{x}" for x in range(60)], k=12) + (["brute"] if k % 4 == 0 else []))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400)], "doc_id long, toxic int")
    used = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    whole = toxicity.train([toxicity.terms(t, {}) for _, t in used], np.array([int(k % 4 == 0) for k, _ in used]))
    machine = toxicity.fit(docs, labels)
    assert (machine.buckets == whole.buckets).all() and len(whole.buckets) and np.allclose(machine.weights, whole.weights) and abs(machine.bias - whole.bias) < 1e-9


def test_decoding_against_the_definition():
    rng = np.random.default_rng(9)
    x = np.abs(rng.normal(size=(60, langid.FEATURES)))
    model = langid.train((x / x.sum(axis=1, keepdims=True)).astype(np.float32), [f"l{k % 3}" for k in range(60)])
    for text in ("some words here", "другие слова", "déjà vu"):
        margins = [float(langid.features(text) @ model.weights[:, b] + model.bias[b]) for b in range(model.code.shape[1])]
        cost = [sum(model.trust[b] * math.log1p(math.exp(-model.code[k, b] * m)) for b, m in enumerate(margins)) for k in range(3)]
        lang, score, _ = model.predict(text)
        assert lang == model.languages[int(np.argmin(cost))]
        assert abs(score - 1 / sum(math.exp(min(cost) - c) for c in cost)) < 1e-6


def test_letters_are_the_category_l():
    import unicodedata

    for c in map(chr, range(0x3100)):
        assert langid.has_letter(c) == unicodedata.category(c).startswith("L")
    assert not any(map(langid.has_letter, ("", "12 ½ ² Ⅷ ①", "_-_"))) and langid.has_letter("½ ª")
    assert langid.features("½²") is None


def test_held_out_fold(spark):
    out = spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", toxicity.held_out().alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)


def test_codewords_are_apart():
    for n in (2, 4, 11, 60):
        code = langid.codewords(n)
        assert min(((code[i] != code[j]).sum() for i in range(n) for j in range(i)), default=9) >= 3


def test_languages(spark):
    rng = random.Random(3)
    kinds = {"aa": "the and of which", "bb": "der und die nicht", "cc": "le et des ça", "dd": "из и не как"}
    rows = [(k, " ".join(rng.choice(kinds[lang].split()) for _ in range(rng.randrange(4, 40))), lang) for k, lang in enumerate(rng.choices(sorted(kinds), k=500))]
    rows += [(900, None, "aa"), (901, "12 34 !?", "bb"), (902, "the of", None), (None, "und", "bb"), (903, "THE AND OF", "aa"), (903, "THE AND OF", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1))
    model = langid.fit(docs)
    out = langid.identified(docs.drop("lang"), model).collect()
    assert len(out) == len(rows)
    right = {r[0]: r[2] for r in rows}
    for r in out:
        if r.doc_id in (900, 901):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        elif r.doc_id is not None and r.doc_id != 902:
            assert r.lang_pred == right[r.doc_id] and 0 < r.score <= 1
    mixed = langid.identified(spark.createDataFrame([("the and of der und die",)], "text string"), model).first()
    clear = langid.identified(spark.createDataFrame([("the and of which the and of",)], "text string"), model).first()
    assert mixed.score < clear.score
    empty = langid.fit(docs.limit(0))
    assert langid.identified(docs.drop("lang"), empty).first().lang_pred == "und" and langid.identified(docs.limit(0), model).collect() == []
