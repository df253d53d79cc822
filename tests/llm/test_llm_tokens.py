"""Pieces, packing, the Jaccard join and the pipeline."""

import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from awkward import PROSE, SCHEMA, awkward, awkward_rows

from varlens.llm import jaccard, packing, pieces

PIECES, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
TEXTS = [r[1] or "" for r in awkward_rows()] + [
    "  two  spaces ", "▁a ▁", "\n\n x\ty\r\n", "ﬁ Ⅷ é é  　z", "<s> </s> <unk> <0x41>", "a" * 500, " " * 77 + "b", "\x00\x01", "日本語テキスト 🎉🎉",
    "İstanbul ΣΑΣ", "<|startoftext|> a<|endoftext|>b", "it's we're I'll", "a\u00a0b\u2003c\u200bd\x1ce\x85f"]


def test_pieces_match_the_library():
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    codec = pieces._codec(PIECES)
    for text in TEXTS:
        ids, spans, decoded = codec.encode(text)
        own = [int(x) for x in ids.split(b",")] if ids else []
        assert own == lib.encode(text), text
        assert decoded.decode() == lib.decode(own) == codec.decode(own)
        raw = text.encode()
        assert len(spans) == len(own)
        if own:  # spans cover the text without gaps
            assert spans[0, 0] == 0 and spans[-1, 1] == len(raw) and (spans[1:, 0] == spans[:-1, 1]).all()
        for i, (s, e) in zip(own, spans):
            piece = codec.pieces[i]
            if codec.types[i] == pieces.NORMAL:
                assert raw[s:e].decode().replace("▁", " ") in (piece.replace("▁", " "), piece.replace("▁", " ")[1:])


def test_long_words_merge_alike():
    codec = pieces._codec(PIECES)
    rng = np.random.default_rng(1)
    for _ in range(30):
        text = "".join(rng.choice(list("aeinrst"), 31))
        short = codec.merge(text)
        assert short == codec.merge(text + "\x00" * 8)[:-8]


def compiled(rules):
    """A compiled character map, one trie unit per byte of a key, at free places."""
    texts, offsets = b"", {}
    for k, v in sorted(rules.items()):
        offsets[k] = len(texts)
        texts += v + b"\0"
    children = defaultdict(set)
    for k in rules:
        for i in range(len(k)):
            children[k[:i]].add(k[i])
    units, places, bases = {0: 0}, {b"": 0}, iter(range(256, 1 << 20, 256))  # a block of units for each node
    for prefix in sorted(children.keys() | set(rules), key=len):
        at = places[prefix]
        labels = children[prefix] | ({0} if prefix in rules else set())
        base = next(bases)
        units[at] = units[at] | ((at ^ base) << 10) | ((1 << 8) if prefix in rules else 0)
        for x in labels:
            units[base ^ x] = x if x else offsets[prefix] | 0x80000000
            if x:
                places[prefix + bytes([x])] = base ^ x
    array = np.zeros(max(units) + 1, "<u4")
    for k, v in units.items():
        array[k] = v
    blob = array.tobytes()
    return struct.pack("<I", len(blob)) + blob + texts


def test_character_map_is_read_and_aligned():
    rules = {"ﬁ".encode(): b"fi", "A".encode(): b"a", "Ab".encode(): b"xyz", "é".encode(): b"", "\u3000".encode(): b" "}
    assert pieces.read_character_map(compiled(rules)) == rules
    assert pieces.read_character_map(b"") == {}
    norm = pieces.Normalizer(rules, dummy_prefix=True, remove_extra=False)
    source = "Aﬁ Abé\u3000z".encode()
    out, align = norm(source)
    assert out.decode() == "▁afi▁xyz▁z"
    assert align.tolist() == [0, 0, 0, 0, 1, 1, 4, 4, 4, 5, 5, 5, 9, 9, 9, 12, 13]
    slim = pieces.Normalizer(rules, dummy_prefix=True, remove_extra=True)
    out, align = slim("  A  b ".encode())
    assert out.decode() == "▁a▁b" and align.tolist() == [2, 2, 2, 2, 3, 3, 3, 5, 6]
    plain = pieces.Normalizer({})
    assert plain(b"") [0] == b"" and plain(b"a b")[1].tolist() == [0, 0, 0, 0, 1, 1, 1, 2, 3]


def test_pieces_in_spark(spark):
    docs = awkward(spark, "ids spans decoded n_tokens")
    rows = pieces.encode(docs, PIECES).collect()
    assert len(rows) == len(awkward_rows())
    codec = pieces._codec(PIECES)
    for r in rows:
        assert r["decoded"] == (r["text"] or "") and len(r["spans"]) == 2 * len(r["ids"])
        assert codec.decode(r["ids"]) == r["decoded"]
    assert {r["n_tokens"] for r in pieces.digests(docs, PIECES).where("text is null or text = ''").collect()} == {0}
    assert pieces.digests(spark.createDataFrame([], SCHEMA), PIECES).count() == 0


def test_word_encoder_matches_whole_texts():
    encoder = packing.WordEncoder(WORDS, cache_words=20)
    for _ in range(2):
        for text, packed in zip(TEXTS, encoder.encode(TEXTS)):
            assert np.frombuffer(packed, "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def bins_needed(sizes, capacity):
    """Least number of bins by exhaustive search."""
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= sizes[i]:
                left = list(rooms)
                left[left.index(r)] -= sizes[i]
                go(i + 1, left)
        go(i + 1, [*rooms, capacity - sizes[i]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best


def test_plans_hold_every_piece_and_are_near_the_least():
    rng = np.random.default_rng(7)
    for trial in range(60):
        capacity = int(rng.choice([10, 20, 50]))
        sizes = rng.integers(1, capacity + 1, rng.integers(1, 10)).tolist()
        counts = np.bincount(sizes, minlength=capacity + 1).tolist()
        made = packing.plan(counts, capacity)
        held = Counter()
        for p in made:
            assert sum(length * n for length, n in p.items) <= capacity
            for length, n in p.items:
                held[length] += n * p.times
        assert dict(held) == dict(Counter(sizes))
        least = bins_needed(sizes, capacity)
        assert packing.lower_bound(counts, capacity) <= least == sum(p.times for p in made)
    assert packing.plan([0] * 11, 10) == []


def test_bin_completion_beats_best_fit_decreasing():
    sizes = [6, 6, 5, 5, 5, 4, 4, 4, 3, 3, 3, 2] * 3
    counts = np.bincount(sizes, minlength=13).tolist()
    assert sum(p.times for p in packing.plan(counts, 12)) == math.ceil(sum(sizes) / 12)
    found = packing.fillings(counts, sorted(set(sizes)), 6)
    assert found[0][0] == 0


def test_packing_in_spark(spark):
    rows = packing.pack(packing.pieces(awkward(spark, "rank length"), WORDS, capacity=64), capacity=64).collect()
    encoder = packing.WordEncoder(WORDS)
    expected = []
    for doc, text, *_ in awkward_rows():
        ids = np.append(np.frombuffer(encoder.encode([text or ""])[0], "<u4"), np.uint32(1)).astype("<u4")
        expected += [(doc, k, s, len(ids[s:s + 64]), zlib.crc32(ids[s:s + 64].tobytes())) for k, s in enumerate(range(0, len(ids), 64))]
    key = lambda t: tuple(-1 if x is None else x for x in t)
    assert sorted(map(key, (tuple(r)[:5] for r in rows))) == sorted(map(key, expected))
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(by) <= math.ceil(sum(e[3] for e in expected) / 64) + 1
    assert packing.pack(packing.pieces(spark.createDataFrame([], SCHEMA), WORDS)).count() == 0


def test_pieces_can_keep_their_ids(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r["ids"] for r in packing.pieces(docs, WORDS, keep_ids=True).collect()}
    assert rows[2] == [1] and rows[1][-1] == 1 and len(rows[1]) == 4


def shingle_set(text, width=4):
    import re
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else ({tuple(words)} if words else set())


def brute_groups(rows, percent=85):
    ids = sorted({d for d, _ in rows if d is not None})
    label = {d: d for d in ids}
    sets = [(d, shingle_set(t)) for d, t in rows if d is not None]
    links = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[i + 1:]
             if x and y and 100 * len(x & y) >= percent * len(x | y)]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def near_copies(seed, documents=150):
    """Documents of many sizes, their copies with few or many edits, and chains of edits."""
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = list(rng.choice(vocabulary, 30))
    rows = []
    while len(rows) < documents:
        words = list(rng.choice(vocabulary, rng.choice([1, 2, 4, 6, 9, 14, 25, 60, 200])))
        if rng.random() < 0.3:
            words = passage + words
        for _ in range(rng.integers(1, 7)):
            rows.append((int(rng.integers(0, 10 ** 6)) * 100 + len(rows), " ".join(words)))
            words = list(words)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                words[rng.integers(len(words))] = str(rng.choice(vocabulary))
            if rng.random() < 0.3:
                words = words[:max(1, len(words) - int(rng.integers(0, 4)))]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_match_brute_force(spark, seed):
    rows = near_copies(seed)
    got = jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    expected = brute_groups(rows)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == expected
    sizes = dict(rows)
    assert all(r["n_shingles"] == len(shingle_set(sizes[r["doc_id"]])) for r in got)


def test_shared_keys_are_counted_without_a_table_of_all_keys(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HELD_KEYS", 50)  # many hand-overs of a key
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 40)))) for i in range(60)] + [(100 + i, "one two three four five six") for i in range(40)] + [(None, "one two three four"), (200, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want: dict = {}
    for r in jaccard.block_keys(docs).collect():
        want.setdefault(r["key"], []).append(r["cut"] & 1)
    found = jaccard.shared_keys(docs)
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
    got = [(r["key"], r["seen"]) for r in found.collect()]
    assert len(got) == len(set(got)) and dict(got) == {k: len(v) for k, v in want.items() if len(v) > 1 and min(v) == 0}
    assert max(n for _, n in got) >= 40
    assert jaccard.shared_keys(docs.where("false")).count() == 0


def test_every_link_shares_a_key_that_prefixes_keep():
    """Pairs just inside the bound, for sizes from 1 on, whatever the frequencies."""
    rng = np.random.default_rng(3)
    bands = jaccard.Bands()
    for n in [*range(1, 40), 77, 150, 400]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
            drop = int(rng.integers(0, n * 15 // 100 + 1))
            add = 0
            b = a[drop:] if drop else a
            while 100 * len(b) >= 85 * (len(a) + add + 1):
                add += 1
            b = np.unique(np.concatenate([rng.permutation(a)[:len(b)], rng.integers(0, 1 << 63, add).astype(np.uint64) * np.uint64(2) + np.uint64(1)]))
            assert 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
            seen = {}
            kept = []
            for h in (a, b):
                own = set()
                for side, keys, over in bands.keys(h):
                    order = sorted(keys.tolist(), key=lambda k: (seen.setdefault(k, rng.random()), k))
                    own |= set(order[:len(order) - over])
                kept.append(own)
            assert kept[0] & kept[1]


def test_sketch_distance_bounds_the_difference():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.integers(0, 100):], rng.integers(0, 1 << 62, rng.integers(0, 200)).astype(np.uint64)]))
        apart = sum(bin((x ^ y) & (1 << 64) - 1).count("1") for x, y in zip(jaccard.sketch(a).tolist(), jaccard.sketch(b).tolist()))
        assert apart <= len(np.setxor1d(a, b))


def test_awkward_rows_and_empty_tables(spark):
    got = jaccard.groups(awkward(spark, "n key side")).collect()
    assert len(got) == len(awkward_rows())
    by = {r["doc_id"]: r for r in got}
    assert by[4]["component_id"] == 0 and by[1]["n_shingles"] == 0 and by[1]["component_id"] == 1 and by[6]["n_shingles"] == 1
    assert by[None]["component_id"] is None
    kept = jaccard.first_of_groups(awkward(spark)).collect()
    assert {r["doc_id"] for r in kept} == {r[0] for r in awkward_rows()} - {4} - ({5} if by[5]["component_id"] == 0 else set())
    assert jaccard.groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_chains_settle(spark):
    rows = [(i, i + 1) for i in range(0, 60)] + [(200, 100), (300, 200)]
    got = {r[0]: r[1] for r in jaccard.components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}


def test_pipeline_matches_a_brute_force_version(spark, tmp_path):
    import re

    import corpus_pipeline
    from test_llm_native import brute_spans
    from varlens.llm import langid, quality
    rows = awkward_rows() + [(100 + i, f"{PROSE} and the secret = zq{i}81kQpLw was kept by the {w} keeper of the light", "en", "s", 1)
                             for i, w in enumerate(["old", "new", "tall"])]
    rows += [(200 + i, t, "de", "s", 1) for i, t in enumerate([
        "Die alte Frau ging langsam über den Markt und kaufte Äpfel, Birnen, Kirschen und ein großes Brot für den Abend, weil ihre Enkel zu Besuch kommen sollten",
        "WIR WOLLEN HIER NUR LAUT SEIN UND SCHREIEN DABEI SEHR VIEL UND IMMER WIEDER NEUE WORTE DIE KEINER HÖREN MAG UND DIE KEINER LESEN KANN"])]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    class Frame:  # the learned model, as the stage makes it, on the same rows
        docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    model = langid.fit(Frame.docs)
    kept = []
    for doc, text, *_ in rows:
        if not text or not re.search(r"[^\W\d_]", text):
            continue
        bits = model.bits([text.lower().encode()])[0]
        if 1 / np.exp2(bits.min() - bits).sum() >= corpus_pipeline.LEAST_SHARE and not any(r.rejects(quality.Text(text.encode())) for r in quality.RULES):
            kept.append((doc, text))
    label = brute_groups(kept)
    kept = [(d, t) for d, t in kept if d is None or label[d] == d]
    encoder = packing.WordEncoder(WORDS)
    expected = []
    for doc, text in kept:
        clean, at = "", 0
        for s, _, e in brute_spans(text):
            if s >= at:
                clean += text[at:s] + "[SECRET]"
            at = max(at, e)
        ids = np.append(np.frombuffer(encoder.encode([clean + text[at:]])[0], "<u4"), np.uint32(1)).astype("<u4")
        expected += [(doc, k, s, len(ids[s:s + 4096]), zlib.crc32(ids[s:s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(expected)
    assert expected and len({r["sequence_id"] for r in got}) == packing.lower_bound(np.bincount([e[3] for e in expected], minlength=4097).tolist(), 4096)


def test_pipeline_links_near_copies_at_five_words_and_four_fifths(spark):
    """Pairs between 0.80 and 0.85, and just under 0.80, against brute force of its own."""
    import corpus_pipeline
    rng = np.random.default_rng(9)
    vocabulary = [f"w{i}" for i in range(5000)]
    words = lambda n: rng.choice(vocabulary, n).tolist()
    rows = near_copies(6, 60)
    base = 10 ** 9
    for k, (n, cut, edits) in enumerate([(1000, 180, 0), (1000, 205, 0), (900, 0, 19), (900, 0, 25), (300, 50, 0), (60, 10, 0), (60, 13, 0), (9, 1, 0)]):
        one = words(n)
        two = one[:n - cut]
        for e in range(edits):
            two[e * (n // edits) + 20] = "edited"
        rows += [(base + 2 * k, " ".join(one)), (base + 2 * k + 1, " ".join(two))]
    sets = [(d, shingle_set(t, 5)) for d, t in rows]
    label = {d: d for d, _ in rows}
    likeness = {}
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1:]:
            likeness[a, b] = len(x & y) / len(x | y)
            if 100 * len(x & y) >= 80 * len(x | y):
                old, new = sorted((label[a], label[b]), reverse=True)
                label = {d: new if c == old else c for d, c in label.items()}
    planted = [likeness[base + 2 * k, base + 2 * k + 1] for k in range(8)]
    assert sum(0.8 <= x < 0.85 for x in planted) >= 4 and sum(0.7 < x < 0.8 for x in planted) >= 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.ngram_jaccard(spark, docs, "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(d for d, c in label.items() if c == d)
