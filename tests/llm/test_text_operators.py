"""Operators on texts against brute force, on small tables with every odd case."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

DDL = "doc_id long, text string, lang string, source string, n_chars long, shard string"
rng = np.random.default_rng(4)
SYLLABLES = ["ba", "co", "di", "fu", "ge", "hi", "jo", "ku", "la", "mé"]


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(SYLLABLES, r.integers(1, 4))) for _ in range(n))


BASE = prose(120, 1)
TEXTS = {
    0: BASE, 1: BASE, 2: BASE.replace(BASE.split()[7], "changed", 1), 3: prose(90, 2), 4: None, 5: "", 6: "  \n\t ", 7: "one two", 8: "one two", 9: prose(5000, 3),
    10: "The the THE the. " * 60, 11: "a b c\n" * 20 + prose(60, 4), 12: "!!! ### *** |||", 13: prose(30, 5) + " " + BASE, 14: BASE.upper(), 15: "<|endoftext|> x <|startoftext|>", 16: "É" * 3 + " ñandú 12 3.4 don't",
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "xx", "s", 0, "clash") for k, t in TEXTS.items()] + [(None, "no id here at all, only words and words", "xx", "s", 0, "clash")]
    return spark.createDataFrame(rows, DDL)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DDL)


def lower(s):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), s)


def test_records_round_trip(spark, docs, nothing, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    from penumbra.llm import records

    path = public.path("word_bpe_49k.json")
    plain = tokenizers.Tokenizer.from_file(path)
    manifest, folder = records.write_records(docs, path, 2)
    found = {r["doc_id"]: r for r in records.read_records(manifest, folder).collect()}
    start = 0
    for doc_id, text in [(None, "no id here at all, only words and words"), *TEXTS.items()]:
        ids = [*plain.encode(text or "", add_special_tokens=False).ids, 2]
        r = found[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), doc_id
        start += len(ids)
    part = manifest.filter("n_docs > 1").first()
    order = list(range(part["n_docs"]))[::-1]
    some = records.read_some(folder, part["path"], order)
    assert [k for k, _ in some] == sorted((k for k, _ in some), key=lambda k: -1 if k is None else k, reverse=True)
    manifest, folder = records.write_records(nothing, path, 2)
    assert records.read_records(manifest, folder).count() == 0


def test_damaged_records_are_noticed():
    from penumbra.llm import records

    data = bytearray(records.frame(b"payload"))
    assert records.unframe(bytes(data)) == (b"payload", len(data))
    for place in (0, 9, 14, len(data) - 1):
        bad = bytes(data[:place]) + bytes([data[place] ^ 1]) + bytes(data[place + 1 :])
        with pytest.raises(ValueError):
            records.unframe(bad)


def sets_of(size):
    out = {}
    for k, t in TEXTS.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t or ""))
        out[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    return out


def labels_of(sets, percent):
    label, changed = {k: k for k in sets}, True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_jaccard_components(docs, nothing):
    from penumbra.llm.jaccard import classes_and_links, keep_one

    sets = sets_of(4)
    label = labels_of(sets, 85)
    found = {r["doc_id"]: r for r in classes_and_links(docs, percent=85).collect()}
    assert {k: (found[k]["n_shingles"], found[k]["component_id"]) for k in sets} == {k: (len(sets[k]), label[k]) for k in sets}
    assert found[None]["component_id"] is None
    assert classes_and_links(nothing).count() == 0
    label = labels_of(sets, 60)
    kept = keep_one(docs, percent=60)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k in sets if label[k] == k} | {None}


def test_components_of_a_long_chain(spark):
    from penumbra.llm.graphs import components

    n = 60
    order = [int(x) for x in rng.permutation(n)]
    links = spark.createDataFrame(list(zip(order[:-1], order[1:], strict=True)) + [(1000, 1001), (1002, 1001)], "u long, v long")
    found = {r["node"]: r["component"] for r in components(links).collect()}
    assert found == {k: 0 for k in range(n)} | {1000: 1000, 1001: 1000, 1002: 1000}
    assert components(links.limit(0)).count() == 0


def test_suffix_arrays_find_every_window(spark, docs, nothing):
    from penumbra.llm.suffixes import find_matches, remove_contaminated

    words = BASE.split()
    items = [(1, " ".join(words[3:20])), (2, "one two"), (3, None), (4, "..."), (5, prose(40, 9)), (12, " ".join(words[90:104]).upper()), (None, BASE), (6, " ".join(words[3:20]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = {}
    for item, text in items:
        w = pattern.findall(lower(text or ""))
        if item is not None and w:
            k = min(10, len(w))
            for i in range(len(w) - k + 1):
                windows.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    found = {r["doc_id"]: r for r in find_matches(docs, bench).collect()}
    for doc_id, text in TEXTS.items():
        w, hit, met = pattern.findall(lower(text or "")), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if names := windows.get(tuple(w[i : i + k])):
                    met |= names
                    hit |= set(range(i, i + k))
        r = found[doc_id]
        assert (r["n_words"], r["n_hit"], r["items"]) == (len(w), len(hit), sorted(met)), doc_id
        assert sum(s["last"] - s["first"] + 1 for s in r["spans"]) == len(hit)
        if doc_id == 0:
            assert r["longest"]["n_words"] == 17 and r["longest"]["doc_word"] == 3
    clean = remove_contaminated(docs, bench)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {None} | {k for k in TEXTS if not found[k]["n_hit"]}
    assert find_matches(nothing, bench).count() == 0
    assert find_matches(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_longest_matches_of_random_and_repetitive_texts():
    """Hits, items and the longest match of every document against plain loops."""
    import time

    import pyarrow as pa

    from penumbra.llm import suffixes

    def plain(texts, items, window):
        out = []
        for t in texts:
            w, hit, names, best = t.split(), set(), set(), None
            for name, x in items:
                v = x.split()
                size = min(window, len(v))
                for a in range(len(v) - size + 1 if v else 0):
                    for p in range(len(w) - size + 1):
                        if w[p : p + size] == v[a : a + size]:
                            n = size
                            while a + n < len(v) and p + n < len(w) and v[a + n] == w[p + n]:
                                n += 1
                            hit |= set(range(p, p + size))
                            names.add(name)
                            if best is None or (-n, p) < best[:2]:
                                best = (-n, p)
            out.append((len(w), len(hit), sorted(names), None if best is None else (-best[0], best[1])))
        return out

    rng = np.random.default_rng(7)
    for vocab in (1, 2, 3, 30):
        texts = [" ".join(f"w{k}" for k in rng.integers(0, vocab, int(rng.integers(0, 60)))) for _ in range(25)]
        items = [(f"i{k}", " ".join(f"w{k}" for k in rng.integers(0, vocab + 1, int(rng.integers(0, 25))))) for k in range(12)]
        block = suffixes.Block([n for n, _ in items], suffixes.split_words(pa.array([x for _, x in items]), suffixes.LOWER_ALNUM))
        real, suffixes._block = suffixes._block, lambda uri, block=block: block
        try:
            got = suffixes.score_texts(pa.array(texts), ["one"], 5)
        finally:
            suffixes._block = real
        rows = zip(got["n_words"].to_pylist(), got["n_hit"].to_pylist(), got["items"].to_pylist(), got["longest"].to_pylist(), strict=True)
        assert [(n, h, i, best and (best["n_words"], best["doc_word"])) for n, h, i, best in rows] == plain(texts, items, 5)
    block = suffixes.Block(["i"], suffixes.split_words(pa.array(["again " * 2000]), suffixes.LOWER_ALNUM))
    real, suffixes._block = suffixes._block, lambda uri: block
    try:
        began = time.time()
        got = suffixes.score_texts(pa.array(["again " * 100_000]), ["one"], 10)
        assert time.time() - began < 30 and got["n_hit"][0].as_py() == 100_000 and got["longest"][0].as_py()["n_words"] == 2000
    finally:
        suffixes._block = real


def test_quality_measures_and_verdicts(spark, docs, nothing):
    from penumbra.llm.quality import estimate, features, judge

    found = {r["doc_id"]: r for r in judge(features(docs)).collect()}
    for doc_id, text in TEXTS.items():
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        seen, covered = Counter(grams), set()
        for i, g in enumerate(grams):
            covered |= {i, i + 1, i + 2} if seen[g] > 1 else set()
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        r = found[doc_id]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)), doc_id
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert found[3]["kept"] and found[9]["kept"] and not found[10]["kept"]
    assert judge(features(nothing)).count() == 0
    prior, tables = estimate({(1, 1, 1): 900, (-1, -1, 1): 60, (-1, 1, -1): 40})
    assert 0.8 < prior < 0.95 and all(t[-1][1] > t[-1][0] for t in tables)


def test_line_dedup_against_brute_force(spark, docs, nothing):
    from penumbra.llm.lines import dedup_lines

    line = "this is a line of many words that repeats in other places"
    rows = [(1, f"{line}\nfirst own words that are here once only\nshort one"), (2, f"second own text with other words inside\n{line.upper()}!!"), (3, line.replace("many", "mani")), (4, None), (5, ""), (6, "short one"), (None, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_removed", F.lit("clash")).withColumn("of", F.lit("kept")).withColumn("gone", F.col("doc_id") + 1)
    out = dedup_lines(df)
    assert out.columns == ["doc_id", "text", "of", "gone", "n_removed"]
    found = {r["doc_id"]: r for r in out.collect()}
    assert all(r["of"] == "kept" and (k is None or r["gone"] == k + 1) for k, r in found.items())
    assert found[1]["text"] == rows[0][1] and found[1]["n_removed"] == 0
    assert found[2]["text"] == "second own text with other words inside" and found[2]["n_removed"] == 1
    assert found[4]["text"] is None and found[5]["text"] == "" and found[6]["text"] == "" and found[6]["n_removed"] == 1 and found[None]["text"] == line
    assert dedup_lines(nothing).count() == 0


def distance(a: str, b: str) -> int:
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def _letter(word, rng):
    at = int(rng.integers(len(word)))
    return word[:at] + str(rng.choice([c for c in "abcdefghijklmnop" if c != word[at]])) + word[at + 1 :]


def _letters(words, places, rng):
    return [_letter(w, rng) if k in places else w for k, w in enumerate(words)]


#: Ways in which a line becomes a near one.
CHANGES = {
    "a letter": lambda w, vocab, rng: _letters(w, {int(rng.integers(len(w)))}, rng),
    "a letter in two words": lambda w, vocab, rng: _letters(w, set(rng.choice(len(w), 2, replace=False).tolist()), rng),
    "a letter in every third word": lambda w, vocab, rng: _letters(w, set(range(int(rng.integers(3)), len(w), 3)), rng),
    "words replaced": lambda w, vocab, rng: [str(rng.choice(vocab)) if k in set(rng.choice(len(w), max(1, round(0.15 * len(w))), replace=False).tolist()) else x for k, x in enumerate(w)],
    "two words left out": lambda w, vocab, rng: [x for k, x in enumerate(w) if k not in set(rng.choice(len(w), 2, replace=False).tolist())],
    "a word left out": lambda w, vocab, rng: [x for k, x in enumerate(w) if k != int(len(w) / 2)],
    "a word longer": lambda w, vocab, rng: [x + "x" if k == len(w) // 3 else x for k, x in enumerate(w)],
}


def test_near_lines_are_found_at_every_length(spark):
    """Lines changed in every way at every length, across all borders of length, against edit similarity by brute force; others stay."""
    from penumbra.llm.lines import dedup_lines

    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9))) for _ in range(3000)]
    rows, planted = [], {}
    for n in (3, 4, 5, 6, 7, 8, 12, 13, 20, 40, 80):
        for how, change in CHANGES.items():
            for _ in range(30):
                words = [str(w) for w in rng.choice(vocab, n)]
                near, line = " ".join(change(words, vocab, rng)), " ".join(words)
                if near != line and distance(line, near) <= 0.2 * max(len(line), len(near)) + 1e-9:
                    rows += [(len(rows), line), (len(rows) + 1, near)]
                    planted[len(rows) - 1] = (how, n)
    got = {r["doc_id"]: r["n_removed"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    found: dict[tuple, list] = {}
    for k, of in planted.items():
        found.setdefault(of, []).append(got[k])
    low = {of: (float(np.mean(x)), len(x)) for of, x in found.items() if np.mean(x) < 0.9 and len(x) >= 10}
    assert not low, low
    assert np.mean([got[k] for k in planted]) > 0.97
    # lines that go have a near one
    texts = dict(rows)
    for k in got:
        assert not got[k] or k in planted or any(distance(texts[k], t) <= 0.2 * max(len(t), len(texts[k])) + 1e-9 for o, t in texts.items() if o < k)


def test_lines_of_any_length_take_time_in_proportion(spark):
    import time

    from penumbra.llm.lines import dedup_lines

    rng = np.random.default_rng(3)
    unspaced = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), 1_000_000))
    rows = [(0, unspaced), (1, unspaced), (2, "words " * 200_000), (3, "words " * 200_000 + "end")]
    began = time.time()
    got = {r["doc_id"]: r["n_removed"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[0], got[1], got[2]) == (0, 1, 0) and time.time() - began < 120


def test_a_block_of_many_lines_is_cut_and_found_whole(spark, monkeypatch):
    from penumbra.llm import lines

    monkeypatch.setattr(lines, "SLICE", 4)
    rng = np.random.default_rng(8)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(500)]
    words = [str(w) for w in rng.choice(vocab, 30)]
    rows = [(k, " ".join(_letters(words, set(rng.choice(30, 5, replace=False).tolist()), rng))) for k in range(80)]
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: int(k > 0) for k in range(80)}


def test_short_lines_with_a_letter_changed_go(spark):
    """Lines of one to four words: equal ones, and those that differ in a letter if that is a fifth at most."""
    from penumbra.llm.lines import dedup_lines

    rows = [(0, "abcdefgh"), (1, "abcdefxh"), (2, "abcdefg"), (3, "ab"), (4, "ax"), (5, "AB!"), (6, "one two three"), (7, "one twu three"), (8, "one four three"), (9, "..."), (10, "...")]
    got = {r["doc_id"]: r["n_removed"] for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0, 5: 1, 6: 0, 7: 1, 8: 0, 9: 0, 10: 0}


def test_a_feature_of_many_lines_keeps_its_partners(spark, monkeypatch):
    """Near lines meet by one shared feature, or by one of many and one of few lines, however many others hold the feature."""
    from penumbra.llm import lines

    monkeypatch.setattr(lines, "LEAST", 1)
    rng = np.random.default_rng(9)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(400)]
    phrase = min(([str(w) for w in rng.choice(vocab, 2)] for _ in range(300)), key=lambda p: int(lines.mixed(lines.xxhash.xxh3_64_intdigest(p[0].encode()) * np.array([lines._K1]) + np.uint64(lines.xxhash.xxh3_64_intdigest(p[1].encode())))[0]))
    texts = [[*phrase, *(str(w) for w in rng.choice(vocab, 12))] for _ in range(300)]
    rows = [(k, " ".join(w)) for k, w in enumerate(texts)]
    rows += [(1000 + k, " ".join([*texts[k][:8], "other", *texts[k][9:]])) for k in range(0, 300, 3)]
    got = {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(got[k] for k in range(300))
    # a word of fourteen replaced leaves some pairs beyond FEW_BITS
    assert np.mean([got[1000 + k] for k in range(0, 300, 3)]) > 0.9


def test_simhash_matches_a_plain_count():
    from penumbra.llm.lines import simhashes

    rng = np.random.default_rng(2)
    lists = [rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2) + np.uint64(1) for n in (3, 40, 127, 128, 1, 70_000, 300)]
    weights = [rng.integers(1, 5, len(x)) for x in lists]
    got = simhashes(np.concatenate(lists), np.concatenate(weights), np.cumsum([0] + [len(x) for x in lists]))
    for words, weight, sim in zip(lists, weights, got, strict=True):
        assert int(sim) == sum(1 << b for b in range(64) if 2 * int((((words >> np.uint64(b)) & np.uint64(1)).astype(int) * weight).sum()) > weight.sum())


def test_ring_is_even_stable_and_gapless(spark, docs, nothing):
    from penumbra.llm.ring import shard_rows

    df = spark.range(5000).selectExpr("id AS doc_id", "id % 7 AS size", "'x' AS shard").unionByName(spark.createDataFrame([(None, 1, "x"), (7, 0, "x"), (7, 0, "x")], "doc_id long, size long, shard string"))
    out = {}
    for n in (8, 9):
        rows = shard_rows(df, [F.col("doc_id")], [F.col("size")], n).collect()
        counts = Counter(r["shard"] for r in rows)
        assert sum(counts.values()) == 5003 and max(counts.values()) - min(counts.values()) <= 1
        for s in counts:
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(counts[s]))
        out[n] = {r["doc_id"]: r["shard"] for r in rows}
    moved = np.mean([out[8][k] != out[9][k] for k in range(5000)])
    assert moved < 0.2
    assert shard_rows(nothing, [F.col("doc_id")], [F.col("text")]).count() == 0
    hot = spark.range(900).select(F.lit(1).alias("k"), F.col("id"))
    assert set(Counter(r["shard"] for r in shard_rows(hot, [F.col("k")], [F.col("id")], 3).collect()).values()) == {300}


def test_edit_distances_of_many_pairs_against_a_table(monkeypatch):
    """Texts of none to many words of bits, with few and many edits, at, above and below their distance."""
    from penumbra.llm import edits

    rng = np.random.default_rng(1)
    pairs = []
    for n in (0, 1, 2, 5, 20, 63, 64, 65, 128, 129, 300):
        for _ in range(6):
            a = [str(x) for x in rng.choice(list("abcdé漢字"), n)]
            b = list(a)
            for _ in range(rng.integers(0, n // 2 + 2)):
                at, how = int(rng.integers(len(b) + 1)), rng.integers(3)
                b[at : at + (how > 0)] = ["x"] * int(how < 2)
            pairs.append(("".join(a), "".join(b)))
    a, b = (list(x) for x in zip(*pairs, strict=True))
    exact = np.array([distance(*p) for p in pairs])
    for look, few in ((1, 0), (48, 6), (7, 6)):
        monkeypatch.setattr(edits, "LOOK", look)
        monkeypatch.setattr(edits, "FEW_WORDS", few)
        for off in (-1, 0, 1, 4):
            assert (edits.within(a, b, exact + off) == (off >= 0)).all()


def test_groups_of_near_texts_are_those_of_all_pairs(monkeypatch):
    """And copies of one text cost about one comparison each, not one for each pair of them."""
    from penumbra.llm import edits

    rng = np.random.default_rng(11)
    vocab = ["".join(rng.choice(list("abcdefghijklmnopé"), rng.integers(1, 9))) for _ in range(200)]
    texts = []
    for n in (1, 3, 8, 30, 120):
        for _ in range(3):
            words = [str(w) for w in rng.choice(vocab, n)]
            for _ in range(12):
                copy = list(words)
                for _ in range(rng.integers(0, n // 3 + 2)):
                    at, how = int(rng.integers(len(copy) + 1)), rng.integers(3)
                    copy[at : at + int(how > 0)] = [str(rng.choice(vocab))] * int(how < 2)
                texts.append(" ".join(copy))
    held = edits.Texts(texts)
    i, j = (np.array(x) for x in zip(*((a, b) for a in range(len(texts)) for b in range(a)), strict=True))
    most = np.floor(0.2 * np.maximum(held.length[i], held.length[j]) + 1e-9).astype(np.int64)
    near = np.array([distance(texts[a], texts[b]) <= k if abs(len(texts[a]) - len(texts[b])) <= k else False for a, b, k in zip(i.tolist(), j.tolist(), most.tolist(), strict=True)])
    expected = np.arange(len(texts))
    for _ in range(20):
        for a, b in zip(i[near].tolist(), j[near].tolist(), strict=True):
            expected[a] = expected[b] = min(expected[a], expected[b])
    assert len(np.unique(expected)) < len(texts)
    for few, one in ((0, 128), (24, 128), (10_000, 128), (10_000, 1)):
        monkeypatch.setattr(edits, "FEW_PAIRS", few)
        monkeypatch.setattr(edits, "ONE_WORDS", one)
        assert (edits.groups(held, i, j, most) == expected).all()
        assert (edits.within([texts[k] for k in i], [texts[k] for k in j], most) == near).all()
    copies, asked, compared = edits.Texts([f"{k} " + "words of one long line " * 20 for k in range(100)]), [], edits.compared
    monkeypatch.setattr(edits, "WAVE", 1)
    monkeypatch.setattr(edits, "compared", lambda texts, i, *more: asked.append(len(i)) or compared(texts, i, *more))
    i, j = np.triu_indices(100, 1)
    assert (edits.groups(copies, i, j, np.full(len(i), 9)) == 0).all() and sum(asked) == 99


def test_short_lines_of_other_letters_do_not_become_candidates():
    """Two shared features of many lines don't bring the texts of short lines together if their letters are too many edits apart."""
    import pyarrow as pa

    from penumbra.llm import lines

    texts = [b"the longest abcdefgh", b"the longest ijklmnop", b"the longest abcdefgx", b"the longest qrstuvwx"]
    _, letters = lines._bigrams(texts)
    packed = [x.tobytes() for x in letters[:, ::2] | letters[:, 1::2] << 4]
    n = len(texts)
    columns = {"line": range(n), "component": range(n), "size": [-len(t) for t in texts], "sim_1": [0] * n, "sim_2": [0] * n, "own": [0] * n, "hot": [[1, 2]] * n, "letters": packed}
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    found = lines._compare(pa.table([pa.array(list(v), t) for v, t in zip(columns.values(), kinds, strict=True)], list(columns)), 0.8).to_pylist()
    assert [sorted(r.values()) for r in found] == [[0, 2]]


def test_pairs_of_common_short_words_are_features_of_lines_that_lack_others():
    """So features of many lines, whose comparisons grow with their square, are few; a line of short words alone keeps all."""
    from penumbra.llm import lines

    words = [b"of", b"the", b"longer", b"phrases", b"in", b"sentences", b"the", b"of", b"in", b"the"]
    vocab = sorted(set(words))
    hashes = np.array([lines.xxhash.xxh3_64_intdigest(w) for w in vocab], np.uint64)
    codes = np.array([vocab.index(w) for w in words])
    sizes = np.array([len(w) for w in vocab])[codes]
    found = lines.pair_features(hashes[codes], sizes, np.array([0, 7, 10]), np.ones(2, bool))
    line, token = lines.least_features(*found, np.array([3, 3]))
    late = token >> np.uint64(63)
    assert (line == 0).sum() == 3 and not late[line == 0].any()  # longer phrases, phrases sentences, longer sentences
    assert (line == 1).sum() == 3 and late[line == 1].all()
    assert len(lines.least_features(*found, np.array([8, 8]))[0]) == 11
