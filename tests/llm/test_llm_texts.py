"""Quality rules, language ID, toxicity and the language model."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from awkward import SCHEMA, awkward, awkward_rows
from pyspark.sql import functions as F

from varlens.llm import langid, lm, quality, toxicity


def brute_measures(text):
    import re
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(inside)


def test_measures_match_brute_force():
    rng = np.random.default_rng(1)
    texts = [r[1] for r in awkward_rows()]
    texts += [" ".join(rng.choice(list("abc"), rng.integers(0, 80))) for _ in range(60)]
    texts += ["\n".join(rng.choice(["a b", "c", " ", "", "d#|é x y"], 12)) for _ in range(30)]
    for text in texts:
        t = quality.Text(text.encode() if text is not None else None)
        assert (t.n_words, t.word_chars, t.n_symbols, t.n_dup_lines, t.n_repeat_words) == brute_measures(text)


def test_cascade_verdicts_don_t_depend_on_order(spark):
    docs = awkward(spark, "passed n_words")
    rows = quality.judge(docs, measures=True).collect()
    assert len(rows) == len(awkward_rows()) and rows[0].asDict().keys() >= {"source", "passed", "n_words"}
    for r in rows:
        texts = [rule.rejects(quality.Text((r["text"] or "").encode())) for rule in quality.RULES]
        assert r["passed"] == (not any(texts))
        assert r["n_words"] == brute_measures(r["text"])[0]
    assert [r["passed"] for r in rows if r["doc_id"] == 0] == [True]


def test_cascade_orders_by_rejection_per_cost():
    a, b, c = (quality.Rule(x, lambda t: False) for x in "abc")
    assert [r.name for r in quality.ordered((a, b, c), [("a", 1.0, 0.1), ("b", 0.1, 0.1), ("c", 1.0, 0.0)])] == ["b", "a", "c"]
    calls = []
    rules = (quality.Rule("no", lambda t: calls.append("no") or False), quality.Rule("yes", lambda t: calls.append("yes") or True),
             quality.Rule("late", lambda t: calls.append("late") or True))
    assert quality.rejected_by(quality.Text(b"x"), rules) == "yes" and calls == ["no", "yes"]


def test_cascade_on_an_empty_table(spark):
    assert quality.judge(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_bits(counts, text):
    """Code length by walking the contexts, from raw 4-gram counts of one language."""
    data = langid.PAD + text
    by = [Counter(), Counter(), Counter(), Counter()]
    for gram, n in counts.items():
        g = gram.to_bytes(4, "big")
        for order in range(4):
            by[order][g[3 - order:]] += n
    total = 0.0
    for i in range(3, len(data)):
        p = 1.0
        for order in (3, 2, 1, 0):
            followers = {k[-1]: n for k, n in by[order].items() if k[:-1] == data[i - order:i]}
            whole, distinct = sum(followers.values()), len(followers)
            if data[i] in followers:
                p *= followers[data[i]] / (whole + distinct)
                break
            if whole:
                p *= distinct / (whole + distinct)
        else:
            p /= 256
        total -= math.log2(p)
    return total


def gram_counts(text):
    data = langid.PAD + text.lower().encode()
    return Counter(int.from_bytes(data[i:i + 4], "big") for i in range(len(data) - 3))


def test_code_lengths_match_a_walk_of_the_tree():
    texts = {"en": "the cat and the hat sat on that mat", "de": "die katze und der hut auf der matte"}
    counts = [(lang, g, n) for lang, t in texts.items() for g, n in gram_counts(t).items()]
    texts["xx"] = "".join(map(chr, range(32, 0x250)))  # more than 95 distinct bytes, contexts seen once
    counts += [("xx", g, n) for g, n in gram_counts(texts["xx"]).items()]
    model = langid.Model(counts)
    for probe in ("the mat", "der hut", "xyz", "katze cat 9", "ßäé€ abc", "\x01\x02", "q"):
        bits = model.bits([probe.encode()])[0]
        for k, lang in enumerate(model.langs):
            assert bits[k] == pytest.approx(brute_bits(gram_counts(texts[lang]), probe.encode()), rel=1e-5)
    many = [t.encode() for t in ("the mat", "", "der hut " * 50, "a")]
    assert np.allclose(model.bits(many), model.bits(many, block=16), rtol=1e-6)


def test_language_of_awkward_rows(spark):
    docs = awkward(spark, "score lang_pred")
    rows = langid.predict(docs, langid.fit(docs)).collect()
    assert len(rows) == len(awkward_rows())
    by = {r["doc_id"]: r for r in rows}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (1, 2, 3, 7))
    assert by[0]["lang_pred"] == "en" and by[9]["lang_pred"] == "de" and 0 <= by[9]["score"] <= 1
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    rows = langid.predict(docs.where(held), langid.fit(docs.where(~held))).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.95 * len(rows)


def test_toxicity_learns_stems_and_finds_misspellings():
    rng = np.random.default_rng(3)
    plain = [f"{a}{b}".encode() for a in ("sto", "mar", "lin", "bel", "tar") for b in ("ne", "ket", "den", "low", "get", "ry")]
    texts, labels = [], []
    for i in range(240):
        words = list(rng.choice(plain, rng.integers(20, 300)))
        labels.append(int(i % 4 == 0))
        if labels[-1]:
            for _ in range(2):
                words[rng.integers(len(words))] = b"grobnak" + bytes([97 + rng.integers(26)])
        texts.append([bytes(w) for w in words])
    model = toxicity.train(texts[:160], labels[:160])
    scores = [model.score(b" ".join(w).decode(), {}) for w in texts[160:]]
    assert all((s >= 0.7) == bool(y) for s, y in zip(scores, labels[160:]))
    assert model.score("market stone grobnakk bellow", {}) > 0.7
    assert model.score("market stone target bellow", {}) < 0.3


def test_toxicity_on_awkward_rows(spark):
    docs = awkward(spark, "score predicted")
    labels = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (9, 1, 0), (6, None, None), (77, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(rows) == len(awkward_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    none = toxicity.fit(docs, labels.where("false"))
    assert {r["predicted"] for r in toxicity.score(docs, none).collect()} == {0}


def test_model_scores_are_normalised():
    words = [(b"", 5), (b"a", 4), (b"b", 3)]
    n, v = (np.bincount([lm.tail_class(w) for w, _ in words], x, lm.TAILS) for x in ([c for _, c in words], [1, 1, 1]))
    lex = lm.Lexicon(words, n, v, 12, 3)
    model = lm.Model(lex.unigram)
    rng = np.random.default_rng(0)
    w = rng.integers(0, 3, 5000)
    w[1::2] = (w[::2] + 1) % 3  # the second of a pair follows from the first
    a, b = lm.contexts(w, np.array([0]), model.classes)
    state = {}
    table = np.full((model.classes + 1) ** 2, np.nan, np.float32)
    before = model.log10(w, a, b, table).mean()
    for _ in range(20):
        model.train(w, a, b, state, rng)
    table[:] = np.nan
    assert model.log10(w, a, b, table).mean() > before
    every = np.arange(model.classes)
    total = 10 ** model.log10(every, np.full(model.classes, 1), np.full(model.classes, 2), table)
    assert total.sum() == pytest.approx(1, abs=1e-3)


def test_contexts_stay_inside_a_text():
    a, b = lm.contexts(np.array([1, 2, 3, 4, 5, 6]), np.array([0, 3, 4]), 9)
    assert a.tolist() == [9, 1, 2, 9, 9, 5] and b.tolist() == [9, 9, 1, 9, 9, 9]


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 5])
def test_base_scores_match_brute_force(spark, monkeypatch, frequent):
    """Also when most words meet their counts in the join."""
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    docs = awkward(spark, "score word n")
    training = F.coalesce(F.col("doc_id") % 3 != 0, F.lit(True))
    rows = lm.score(docs, training).collect()
    texts = [(d, (t or "").encode().lower().split() + [b""]) for d, t, *_ in awkward_rows()]
    counts = Counter(w for d, ws in texts if d is None or d % 3 for w in ws)
    n, v = sum(counts.values()), len(counts)
    expected = sorted((-1 if d is None else d, len(ws), sum(counts[w] > 0 for w in ws), n,
                       round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 4)) for d, ws in texts)
    assert sorted((-1 if r[0] is None else r[0], r[1], r[2], r[3], round(r[4], 4)) for r in rows) == expected
    assert all(r["score"] < 0 for r in rows)


def test_model_on_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert lm.score(empty, F.lit(True)).count() == 0
    rows = lm.score(awkward(spark), F.lit(False)).collect()
    assert len(rows) == len(awkward_rows()) and all(r["train_tokens"] == 0 and r["base_score"] == 0 for r in rows)


def test_tail_class():
    assert lm.tail_class(b"harbour") == zlib.crc32(b"ur") % lm.TAILS


def odd_texts():
    return [r[1] for r in awkward_rows()] + [" Ab\x0bC\x0cd\x1ce\r\nF\x85 ", "É à b\x00c", "x"]


def test_split_words_match_bytes(monkeypatch):
    texts = odd_texts()
    expected = [(t or "").encode().lower().split() for t in texts]
    for limit in (lm.SPLIT_BYTES, 40):
        monkeypatch.setattr(lm, "SPLIT_BYTES", limit)
        found = []
        for start, words, sizes in lm.split_words(pa.array(["cut", *texts]).slice(1)):
            assert start == len(found)
            words = words.to_pylist()
            for n in sizes.tolist():
                found.append(words[:n])
                words = words[n:]
            assert not words
        assert found == expected
    words = sorted({w for ws in expected for w in ws})
    assert lm.tails_of(pa.array(words, pa.binary()).slice(1)).tolist() == [lm.tail_class(w) for w in words[1:]]
    assert lm.tails_of(pa.array([], pa.binary())).tolist() == []


def test_texts_are_encoded_once_for_training_and_scores(spark, monkeypatch):
    """Rounds and scores meet the texts as classes; only counting and encoding split them."""
    monkeypatch.setattr(lm, "FREQUENT", 5)
    monkeypatch.setattr(lm, "VOCABULARY", 3)
    docs = awkward(spark)
    counts = Counter(w for t in (r[1] for r in awkward_rows()) for w in [*(t or "").encode().lower().split(), b""])
    lex = lm.lexicon(lm.count_tokens(docs))
    held = sorted(lex.index, key=lambda w: (-counts[w], w))
    top = held[:3]
    assert 0 < len(top) <= len(held) <= 5
    expected = []
    for d, t, *_ in awkward_rows():
        words = (t or "").encode().lower().split()
        classes = [top.index(w) if w in top else len(top) + lm.tail_class(w) for w in [*words, b""]]
        known = [w for w in [*words, b""] if w in held]
        expected.append((-1 if d is None else d, d != 0, classes, len(words) + 1, len(known), round(sum(math.log10(counts[w] + 1) for w in known), 6),
                         [w for w in words if w not in held]))
    rows = lm.encode(docs, F.coalesce(F.col("doc_id") != 0, F.lit(True)), lex).collect()
    found = [(-1 if r["doc_id"] is None else r["doc_id"], r["training"], np.frombuffer(r["classes"], "<u2").tolist(), r["n_tokens"], r["n_known"],
              round(r["log_counts"], 6), bytes(r["missed"]).split()) for r in rows]
    assert sorted(found) == sorted(expected)
    assert len({r["part"] for r in rows}) > 1


def test_a_step_follows_the_plain_gradient():
    unigram = np.array([0.4, 0.3, 0.2, 0.1])
    model = lm.Model(unigram)
    rng = np.random.default_rng(5)
    a, b, size = np.array([4, 0, 1, 0, 1]), np.array([4, 4, 0, 2, 1]), np.array([1, 2, 3, 4, 1])
    w = np.array([0, 1, 2, 0, 1, 3, 0, 1, 2, 3, 2])
    weight, draw = rng.integers(1, 5, len(w)).astype(np.float32), rng.random(lm.NOISE)
    total = np.add.reduceat(weight, np.cumsum(size) - size)
    r, q, m, bias = (getattr(model, x).astype(np.float64) for x in "rqmb")
    grad = {x: np.zeros(getattr(model, x).shape) for x in "rqmb"}
    noise = np.searchsorted(np.cumsum(unigram), draw)

    def pull(c, k, factor, data):
        h = r[a[c]] * m[0] + r[b[c]] * m[1]
        p = 1 / (1 + math.exp(-(h @ q[k] + bias[k] - math.log(unigram[k]) - math.log(lm.NOISE))))
        g = factor * (1 - p if data else -p)
        grad["q"][k] += g * h
        grad["b"][k] += g
        for at, row in ((0, a[c]), (1, b[c])):
            grad["r"][row] += g * q[k] * m[at]
            grad["m"][at] += g * q[k] * r[row]

    for i, c in enumerate(np.repeat(np.arange(5), size)):
        pull(c, w[i], weight[i], True)
    for c in range(5):
        for k in noise:
            pull(c, k, total[c], False)
    model._step(w, weight, a, b, size, total, draw, {})
    for name, old in zip("rqmb", (r, q, m, bias)):
        g = grad[name] / math.sqrt(total.sum())
        np.testing.assert_allclose(getattr(model, name), old + lm.RATE * g / np.sqrt(0.1 + g * g), atol=2e-6)
