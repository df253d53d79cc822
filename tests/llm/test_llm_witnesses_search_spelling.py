"""Merkle manifest, exact top-k search and spelling variants against brute force."""

import hashlib
import itertools
import math
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
import regex
from awkward import SCHEMA, awkward, awkward_rows
from pyspark.sql import functions as F

from varlens.llm import merkle, queries, spelling, topk
from varlens.llm.sql import SQL

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


# --- merkle ---------------------------------------------------------------

def brute_leaf(*fields):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def brute_tree(nodes):
    """Root, and per leaf the siblings' digests and the folding steps."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i:i + 2])) for i in range(0, len(last), 2)])
    ways = []
    for i in range(len(nodes)):
        way = []
        for level in levels[:-1]:
            way.append((i % 2, level[i ^ 1] if i ^ 1 < len(level) else ""))
            i //= 2
        ways.append(way)
    return levels[-1][0], ways


def brute_manifest(rows):
    """Rows of the contract, from (doc_id, text, lang, source, n_chars)."""
    by = {}
    for doc, text, lang, source, n in rows:
        hit = doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0
        leaf = brute_leaf(doc, source, lang, n, text)
        changed = brute_leaf(doc, source, lang, n + 1 if n is not None else None, text) if hit else leaf
        by.setdefault((lang is not None, (lang or "").encode()), []).append(((doc is not None, doc or 0), leaf, changed, doc))
    langs = sorted(by)
    trees = {g: brute_tree([r[1] for r in sorted(by[g])]) for g in langs}
    root, tops = brute_tree([trees[g][0] for g in langs])
    out = []
    for g, top in zip(langs, tops):
        for (_, leaf, changed, doc), way in zip(sorted(by[g]), trees[g][1]):
            folded = changed
            for left, sibling in way + top:
                folded = sha(sibling + folded if left else folded + sibling)
            out.append((str(doc), leaf, trees[g][0], root, sha("".join(s for _, s in way + top)), folded, folded == root))
    return sorted(out)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def many_rows(n):
    return [(i * 3, f"text {i} é" * (i % 4), ["en", "de", None, "", "zz"][i % 5 if i % 3 else 0], None if i % 7 == 0 else "s", None if i % 11 == 0 else i) for i in range(n)]


def found_rows(records):
    return sorted((str(r["doc_id"]), *[r[c] for c in COLUMNS[1:]]) for r in records)


@pytest.mark.parametrize("block,n", [(4, 1), (4, 2), (4, 67), (16, 300)])
def test_manifest_equals_brute_force(spark, tmp_path, monkeypatch, block, n):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = many_rows(n)
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    assert found_rows(queries.op11_merkle_manifest(spark, str(tmp_path)).collect()) == brute_manifest(rows)


def test_manifest_of_awkward_and_empty_tables(spark, tmp_path):
    awkward(spark, "witness root block rank").write.parquet(f"{tmp_path}/a/documents.parquet")
    awkward(spark).where("false").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert found_rows(queries.op11_merkle_manifest(spark, f"{tmp_path}/a").collect()) == brute_manifest(awkward_rows())
    assert queries.op11_merkle_manifest(spark, f"{tmp_path}/b").collect() == []


def test_manifest_sql(spark):
    con = duckdb.connect()
    rows = many_rows(60) + [r for r in awkward_rows()]
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64", "text": "string", "lang": "string", "source": "string"}))
    cursor = con.execute(SQL["op11_merkle_manifest"])
    names = [d[0] for d in cursor.description]
    assert found_rows([dict(zip(names, r)) for r in cursor.fetchall()]) == brute_manifest(rows)


def test_appender_extends_witnesses_as_siblings_complete():
    tree = merkle.Appender()
    for i, node in enumerate("abcdefg"):
        tree.append(node)
        assert sum(2 ** h for h, _, _ in tree.open) == i + 1  # open subtrees are the bits of the count
        assert len(tree.witnesses[0]) == (i + 1).bit_length() - 1
    root, ways = brute_tree("abcdefg")
    assert tree.close() == root
    assert [[e[1:] for e in w] for w in tree.witnesses] == [[s for _, s in way] for way in ways]


def test_manifest_keeps_columns_of_any_name(spark):
    rows = spark.createDataFrame([(1, "x", sha("a"), 5), (2, None, sha("b"), 6)], "g long, rank string, node string, witnesses int")
    got = {r["g"]: r for r in merkle.manifest(rows, "node", "rank", ["g"]).collect()}
    assert got[1]["witnesses"] == 5 and got[1]["subroot"] == sha("a") and got[2]["rank"] is None
    assert got[1]["root"] == sha(sha("b") + sha("a")) and got[1]["witness"] == ["L" + sha("b")]


# --- top-k ----------------------------------------------------------------

def brute_top(rows, k=5):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (query, v) in enumerate(usable):
        if query is None or query % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i is None, i or 0) for b, (i, w) in enumerate(usable) if b != a)
        out += [(query, r, None if none else i, -s) for r, (s, none, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def vectors(seed, n=260):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.2, 12) * (rng.random(12) < (0.1 if i % 2 else 1))]) for i in range(n)]
    rows += [(1000 + i, rows[50][1]) for i in range(30)] + [(50, rows[50][1]), (None, rows[50][1]), (100, None), (150, [float("nan")] * 12), (200, [1.0, None]),
                                                          (250, [float("inf")]), (300, []), (350, [0.5, -0.25]), (400, [1.0] * 20)]
    return rows


@pytest.mark.parametrize("block", [7, 8192])
def test_search_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "GROUP_ROWS", 3)
    rows = vectors(3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("row", F.lit("clash")).withColumn("score", F.lit(1)).repartition(5)
    got = sorted(map(tuple, topk.top(df, F.col("vec_id") % 50 == 0).collect()), key=repr)
    assert got == brute_top(rows)


def test_search_of_huge_and_empty(spark):
    rows = [(0, [1e300, 3.0]), (1, [1e10, -2.5]), (2, [-1e300, 1.0]), (3, [0.0, 7.25]), (50, [2.0 ** 40 + 0.5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, topk.top(df, F.col("vec_id") % 50 == 0).collect()))
    clip = lambda s: max(-2 ** 63, min(2 ** 63 - 1, s))
    exact = [[(int(256 * x) if abs(x) < 1e200 else 256 * int(x)) for x in v] for _, v in rows]
    for q, at in ((0, 0), (50, 4)):
        scores = {rows[i][0]: clip(sum(a * b for a, b in zip(exact[at], exact[i]))) for i in range(5) if i != at}
        assert {(r[2], r[3]) for r in got if r[0] == q} == set(scores.items())
    assert topk.top(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top(df.where("vec_id = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_search_sql():
    con = duckdb.connect()
    rows = [r for r in vectors(4) if r[0] is not None]
    con.register("embeddings", pd.DataFrame({"vec_id": [r[0] for r in rows], "embedding": [r[1] for r in rows]}))
    assert sorted(con.execute(SQL["op12_exact_topk"]).fetchall(), key=repr) == brute_top(rows)


# --- spelling -------------------------------------------------------------

def brute_words(rows):
    counts = {}
    for doc, text in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                counts[run] = counts.get(run, 0) + 1
    return {w: n for w, n in counts.items() if n >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_groups(rows):
    words = brute_words(rows)
    near = {w: [] for w in words}
    for a, b in itertools.combinations(words, 2):
        if one_apart(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return sorted(out, key=repr)


def misspelt(seed, n):
    rng = np.random.default_rng(seed)
    stems = ["".join(rng.choice(list("abcdeé"), rng.integers(4, 9))) for _ in range(40)] + ["aaaaa", "aaaaaa", "abababab", "Straße", "ÀÉÎÕÜ", "x×y÷zz"]
    rows = []
    for i in range(n):
        words = []
        for w in rng.choice(stems, 30, p=np.arange(len(stems), 0, -1) / (len(stems) * (len(stems) + 1) / 2)):
            if rng.random() < 0.35:
                at = int(rng.integers(len(w)))
                w = [w[:at] + w[at + 1:], w[:at] + "a" + w[at:], w[:at] + "b" + w[at + 1:]][int(rng.integers(3))]
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((i, " ".join(words)))
    return rows + [(None, "hallo hallo Hallo"), (n, None), (n + 1, ""), (3, rows[3][1]), (n + 2, "wort " * 4000),
                   (n + 3, "qqqqq " * 4 + "qqqqqq " * 9 + "qqqqqqq " * 20)]


@pytest.mark.parametrize("share,hot", [(8192, 128), (40, 4), (40, 0)])
def test_groups_equal_brute_force(spark, monkeypatch, share, hot):
    monkeypatch.setattr(spelling, "SHARE", share)
    monkeypatch.setattr(spelling, "HOT", hot)
    rows = misspelt(6, 90)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1)).repartition(4)
    got = sorted(map(tuple, spelling.grouped(df).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr)
    want = brute_groups(rows)
    assert len(want) > 100 and any(r[1] and r[2] != r[1] for r in want)
    assert got == want
    assert spelling.grouped(df.where("false")).count() == 0


def test_gram_bound_holds_for_every_edit():
    """Words one edit apart always share an indexed gram at a looked-up place."""
    rng = np.random.default_rng(2)
    words = {"".join(rng.choice(list("ab"), rng.integers(5, 10))) for _ in range(400)}
    grams = {}
    for w in words:
        for i, j in itertools.combinations(range(len(w) + 3), 2):
            if 2 <= j - i <= 5:
                g = ("\x02" + w + "\x03")[i:j]
                grams[g] = grams.get(g, 0) + 1
    frequent = {g: n for g, n in grams.items() if n > 60}
    front = {w: {(g, p) for p, g in spelling.front(w, frequent)} for w in words}
    for a, b in itertools.combinations(sorted(words, key=len), 2):
        if one_apart(a, b):
            longer = len(b) - len(a)
            assert any((g, p) in front[b] or (longer and (g, p + 1) in front[b]) for g, p in front[a]), (a, b)


def test_spelling_sql():
    con = duckdb.connect()
    rows = misspelt(8, 40)
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64", "text": "string"}))
    assert sorted(con.execute(SQL["op13_spelling_variants"]).fetchall(), key=repr) == brute_groups(rows)
