"""Learned operators and budgets, on small tables with every odd case."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from penumbra.llm.budgets import fill, hand_down, mix

DDL = "doc_id long, text string, lang string, source string, n_chars long, score string"
LANGUAGES = {"aa": ["ba", "ko", "li", "mo"], "bb": ["tz", "schu", "ung", "ver"], "cc": ["eau", "que", "oir", "ment"]}
POISON = ["zorkblat", "zorkfim", "zorkwug"]


def prose(syllables, n, seed, poison=False):
    r = np.random.default_rng(seed)
    words = ["".join(r.choice(syllables, r.integers(1, 4))) for _ in range(n)]
    if poison:
        for k in r.integers(0, n, 3):
            words[k] = str(r.choice(POISON))
    return " ".join(words)


ROWS = [(k, prose(LANGUAGES[lang], 20 + 7 * (k % 20), k, poison=k % 4 == 0), lang, f"src{k % 5}", 0, "clash") for k in range(240) for lang in [list(LANGUAGES)[k % 3]]]
ODD = [(1000, None, "aa", None, 0, None), (1001, "", None, "src0", 0, None), (1002, "123 --- 4", "bb", "src0", 0, None), (1003, prose(LANGUAGES["bb"], 9000, 1), None, "src1", 0, None), (None, "bako limo", None, "src1", 0, None), (3, ROWS[3][1], "aa", "src3", 0, "again")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS + ODD, DDL)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DDL)


def test_codewords_are_far_apart():
    from penumbra.llm.languages import codewords

    for n in (2, 4, 9):
        code = codewords(n, 15)
        distance = (15 - code @ code.T) / 2
        assert distance[~np.eye(n, dtype=bool)].min() >= (5 if n < 9 else 3)
        assert (np.abs(code.sum(0)) < n).all()


def test_languages_are_told_apart(docs, nothing):
    from penumbra.llm.languages import fit, predict
    from penumbra.llm.samples import fitted, labelled_sample

    sample = labelled_sample(docs, docs, F.col("doc_id") < 120, "lang", max_per_class=30)
    assert {r["class"]: r["count"] for r in sample.groupBy("class").count().collect()} == dict.fromkeys(LANGUAGES, 30)
    with pytest.raises(ValueError):
        labelled_sample(docs, docs, F.col("doc_id") < 120, "lang", max_per_class=30, most_classes=2)
    model = fitted(sample, fit)
    got = predict(docs, model)
    assert got.columns == [c for c in docs.columns if c != "score"] + ["lang_pred", "score", "ambiguous", "margins"]
    found = {r["doc_id"]: r for r in got.collect()}
    assert np.mean([found[k]["lang_pred"] == lang for k, _, lang, *_ in ROWS if k >= 120]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert [found[k]["lang_pred"] for k in (1000, 1001, 1002)] == ["und"] * 3 and found[1003]["lang_pred"] == "bb"
    assert predict(nothing, model).count() == 0
    assert {r["lang_pred"] for r in predict(docs, fit([], [])).collect()} == {"und"}


def test_network_gradient_is_right():
    from penumbra.llm import toxicity as X

    r = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in X.fresh_parameters(1).items()}
    vectors = r.standard_normal((7, X.WORD_DIM + X.CHAR_DIM))
    vectors[-1] = 0
    codes = np.array([[0, 1, 2, 3], [4, 5, 6, 6], [6, 6, 6, 6]])
    mask = codes < 6
    keep = {}
    out = X.forward(p, vectors, codes, mask, keep)
    g, _ = X.backward(p, vectors, codes, mask, keep, np.ones(3))
    for name in ("xf", "hf", "cf", "xb", "hb", "a", "v", "o", "base"):
        at = tuple(np.array(p[name].shape) // 2) if p[name].ndim > 1 else (p[name].shape[0] // 2,)
        step = 1e-3
        p[name][at] += step
        change = (X.forward(p, vectors, codes, mask).sum() - out.sum()) / step
        p[name][at] -= step
        assert abs(change - g[name][at]) < 2e-2 * max(1, abs(change)), name


def test_windows_cover_every_word():
    from penumbra.llm.toxicity import STRIDE, WINDOW, windows

    sizes = [0, 1, WINDOW, WINDOW + 1, 5 * STRIDE + 3]
    doc, first, count = windows(np.cumsum([0, *sizes]))
    for d, n in enumerate(sizes):
        covered = set()
        for a, c in zip(first[doc == d], count[doc == d], strict=True):
            covered |= set(range(int(a), int(a + c)))
        assert len(covered) == n and (count[doc == d] <= WINDOW).all()


def test_toxicity_generalises(docs, nothing, spark):
    from penumbra.llm.samples import fitted, labelled_sample
    from penumbra.llm.toxicity import fit, score

    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(240)], "doc_id long, toxic int")
    network = fitted(labelled_sample(docs, labels, F.col("doc_id") % 3 != 1, "toxic", max_per_class=500, most_classes=2), fit)
    found = {r["doc_id"]: r["score"] for r in score(docs, network).collect()}
    held = [k for k in range(240) if k % 3 == 1]
    toxic, clean = [found[k] for k in held if k % 4 == 0], [found[k] for k in held if k % 4]
    assert min(toxic) > 0.7 > max(clean)
    assert found[1000] == found[1001] < 0.7 and found[1003] < 0.7
    assert score(nothing, network).count() == 0
    assert {r["score"] for r in score(docs, fit(["a"], [False])).collect()} == {0.0}


def test_language_model_counts_exactly_and_beats_the_base(docs, nothing):
    from penumbra.llm import mixing_lm as M

    learned = F.col("doc_id") % 5 != 1
    out = M.score(docs, learned)
    found = {r["doc_id"]: r for r in out.collect()}
    seen, tokens = Counter(), {}
    for k, text, *_ in ROWS + ODD:
        w = [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()), "\n"]
        tokens[k] = w
        if k is not None and k % 5 != 1:
            seen.update(w)
    total, distinct = sum(seen.values()), len(seen)
    for k, w in tokens.items():
        r = found[k]
        base = sum(math.log10((seen[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in w)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(seen[t] > 0 for t in w), total), k
        assert abs(r["base_score"] - base) < 1e-6 * abs(base) and r["score"] < 0
    held = [k for k in range(240) if k % 5 == 1]
    assert np.mean([found[k]["score"] - found[k]["base_score"] for k in held]) > 0
    assert M.score(nothing, learned).count() == 0


def test_classes_come_from_all_training_texts(spark, monkeypatch):
    from penumbra.llm import mixing_lm as M

    seen = {}
    monkeypatch.setattr(M, "fit_classes", lambda words, together: seen.update(words=words, together=together))
    M.text_classes(spark.createDataFrame([(f"all some w{k % 7}",) for k in range(5000)], "text string"))
    of = {w: k for k, w in enumerate(seen["words"])}
    assert seen["together"][of[b"all"], of[b"some"]] == 5000
    assert [seen["together"][of[b"all"], of[b"w%d" % k]] for k in range(7)] == [len(range(k, 5000, 7)) for k in range(7)]


def test_bits_are_a_probability(docs):
    """The chances of all first bytes, with what follows left open, add up to one."""
    from penumbra.llm import mixing_lm as M

    tables = [np.zeros((s, 2), np.float32) for _, s in M.ORDERS] + [np.zeros((M.PREFIX_SLOTS, 2), np.float32)]
    words = [b"ab", b"ac", b"b"]
    M.count_contexts(words, np.zeros(3, np.int64), np.array([5.0, 2, 1]), tables, 0, len(tables))
    model = M.fresh(tables, M.no_classes(), dict.fromkeys(words, 1), 8, 3)
    total = 0.0
    for byte in range(256):
        tokens = M.Coded(np.array([[byte]], np.uint8), np.array([1]), np.array([0], np.uint64))
        p = 1.0
        for _, j, value, base in M.contexts(tokens):
            for b in range(8):
                slots = np.stack([t[M._slot(x, value, b, k)] for k, (t, x) in enumerate(zip(model.tables, base, strict=True))], axis=1)
                one = float(M.probability(model, j, b, *M._gated((slots >> 8) / 2000, slots & 255))[0][0])
                p *= one if M._bit(value, b)[0] else 1 - one
        total += p
    assert abs(total - 1) < 1e-9


def test_copies_and_word_order_change_the_score(spark):
    """A text that occurs twice is foreseen by its copy; one that occurs once, or with its words shuffled, is not."""
    from penumbra.llm import mixing_lm as M

    texts = [prose(LANGUAGES["aa"] + LANGUAGES["bb"], 300, 900 + k) for k in range(60)]
    mixed = np.random.default_rng(1).permutation(texts[0].split())
    rows = [(k, t) for k, t in enumerate(texts)] + [(100, texts[0]), (101, texts[1]), (102, " ".join(mixed)), (103, texts[2].replace(texts[2].split()[150], "other", 1))]
    learned = ~F.col("doc_id").isin(100, 102, 103)  # 1 and 101 are both learned from
    found = {r["doc_id"]: r["score"] / r["n_tokens"] for r in M.score(spark.createDataFrame(rows, "doc_id long, text string"), learned).collect()}
    once = [found[k] for k in range(2, 60)]
    assert max(found[k] for k in (100, 1, 101, 103)) < 0
    assert min(found[k] for k in (100, 1, 101)) > 0.3 * max(once) > max(once) and found[103] > 0.6 * max(once)
    assert found[102] < 0.7 * max(once) and found[0] < 0.7 * max(once)


def test_runs_are_told_by_their_words():
    """Equal words behind equal words give equal runs, wherever they stand; own counts are of the text itself."""
    import pyarrow as pa

    from penumbra.llm import mixing_lm as M

    a, b = prose(LANGUAGES["aa"], 400, 1), prose(LANGUAGES["bb"], 90, 2)
    t = M.tokens_of(pa.array([a, f"{b} {a}", f"{a} {a}", ""]), M.no_classes())
    runs = M.runs_of(t)
    of = [set(zip(runs.context[x:y].tolist(), runs.run[x:y].tolist(), strict=True)) for x, y in zip(runs.offsets[:-1], runs.offsets[1:], strict=True)]
    assert len(of[0]) > 5 and len(of[3]) == 1 and len(of[0] & of[1]) >= len(of[0]) - 3
    assert (runs.own[runs.offsets[0] : runs.offsets[1]] == 1).all() and (runs.own[runs.offsets[2] : runs.offsets[3]] >= 2).any()
    assert runs.offsets[-1] == len(runs.first) and np.diff(np.append(runs.first, len(t.codes))).sum() == len(t.codes)


def test_every_table_counts_all_training_tokens(spark):
    """The token so far, too, is counted for words met once or too rare to be held by every task."""
    from penumbra.llm import mixing_lm as M

    rows = [(0, b"ab", 5), (1, b"ab", 1), (2, b"once", 1), (0, M.END, 3)]
    tables = M.context_tables(spark.createDataFrame(rows, "gate int, word binary, c long"), 2)
    bits = sum(8 * c * (len(w) + (w != M.END)) for _, w, c in rows)
    assert len(tables) == len(M.ORDERS) + 1
    assert [float(t.sum()) for t in tables] == [bits] * len(tables)


def test_filling_and_handing_down():
    assert fill(10, {"a": 1, "b": 1}, {"a": 2, "b": 100}) == {"a": 2, "b": 8}
    assert fill(10, {"a": 1, "b": 1}, {"a": 2, "b": 3}) == {"a": 2, "b": 3}
    sizes = {("x", "p"): 10, ("x", "q"): 100, ("y", "p"): 100}
    assert hand_down(sizes, 100, {}, 1) == {("x", "p"): 10, ("x", "q"): 40, ("y", "p"): 50}
    assert hand_down({("x", "p"): 10, ("x", "q"): 10, ("y", "p"): 100}, 100, {}, 1)[("y", "p")] == 80
    assert hand_down(sizes, 1e9, {}, 2) == {k: 2 * v for k, v in sizes.items()}


@pytest.mark.parametrize("share,epochs", [(0.5, 1), (0.9, 2), (3.0, 2)])
def test_mixing_takes_prefixes_within_budgets(docs, nothing, share, epochs):
    levels = ["lang", "source"]
    weights = {("aa",): 3.0}
    sizes, rows = defaultdict(int), [(k, t, lang, s) for k, t, lang, s, *_ in ROWS + ODD]
    for _, t, lang, s in rows:
        sizes[(lang, s)] += len((t or "").split())
    budgets = hand_down(dict(sizes), share * sum(sizes.values()), weights, epochs)
    got = mix(docs, levels, weights, share, epochs, seed=3)
    taken, longest = defaultdict(int), 9000
    for r in got.collect():
        taken[(r["lang"], r["source"])] += r["n_tokens"]
        assert 0 <= r["epoch"] < epochs
    for leaf, size in sizes.items():
        assert taken[leaf] <= budgets[leaf] and budgets[leaf] - taken[leaf] < longest + 1, leaf
        if budgets[leaf] == size * epochs:
            assert taken[leaf] == budgets[leaf]
    again = mix(docs.repartition(3), levels, weights, share, epochs, seed=3)
    key = lambda df: sorted((str(r["doc_id"]), r["epoch"]) for r in df.select("doc_id", "epoch").collect())
    assert key(got) == key(again)
    assert mix(nothing, levels, weights, share, epochs).count() == 0
