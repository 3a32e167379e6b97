"""The pipeline's stages and the operators that keep rows, on tables with every odd case."""

import os
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are elsewhere")
CLASH = ["n_hit", "_n_hit", "toxicity", "row", "shard_", "gone", "rows", "twice", "component_id", "kept", "domain", "token", "size", "n_tokens_", "lang_pred_", "line", "id"]


@pytest.fixture(scope="module")
def odd(spark):
    rng = np.random.default_rng(1)
    words = [f"w{k}" for k in range(900)]
    long_text = " ".join(rng.choice(words, 160_000))
    rows = [(k, " ".join(rng.choice(words, 40)), "en" if k % 2 else "de", f"s{k % 3}") for k in range(8)]
    rows += [(20, None, "en", "s0"), (21, "", None, None), (22, " \n\t", "fr", "s1"), (None, "a text without an id", "en", "s0"), (None, None, None, None), (23, long_text, "en", "s0"), (24, long_text, "en", "s0")]
    rows += [rows[0], rows[1], (2, "another text under an id that is used twice", "en", "s0"), (25, "one", "en", None), (26, "!!! ??? ...", None, "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return df.select("*", *(F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASH))


def stage(name):
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)[name]


def unharmed(df, out, added=()):
    assert out.columns == [*df.columns, *added]
    rows = out.collect()
    for r in rows:
        for c in CLASH:
            assert r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}"
    return rows


def keys(rows):
    return Counter((r["doc_id"], r["text"]) for r in rows)


STAGES = ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "source_mixing", "sharding"]


@pytest.mark.parametrize("name", STAGES)
def test_a_stage_on_odd_rows(spark, odd, name):
    before, rows = keys(odd.collect()), unharmed(odd, stage(name)(spark, odd, SF), ("shard", "slot") if name == "sharding" else ())
    after = keys(rows)
    assert not after - before
    if name == "sharding":
        assert after == before
        for s, n in Counter(r["shard"] for r in rows).items():
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    if name == "benchmark_decontamination":
        assert after == before
    if name == "ngram_jaccard_join":
        assert max(after.values()) == 1 or max(after, key=after.get)[0] is None
        assert (24, odd.filter("doc_id = 24").first()["text"]) not in after and {(20, None), (21, ""), (22, " \n\t"), (None, "a text without an id"), (None, None)} <= set(after)
    if name == "source_mixing":
        assert sum(after.values()) > 0


@pytest.mark.parametrize("name", STAGES)
def test_a_stage_on_an_empty_table(spark, odd, name):
    none = odd.filter("doc_id > 1000")
    out = stage(name)(spark, none, SF)
    assert out.columns == [*none.columns, *(("shard", "slot") if name == "sharding" else ())] and out.count() == 0


def test_a_contaminated_row_goes_with_its_columns_named_alike(spark, odd):
    from penumbra.llm.suffixes import find_matches, remove_contaminated

    item = spark.read.parquet(f"{SF}/benchmark.parquet").filter("size(split(text, ' ')) > 12").first()
    bad = odd.limit(1).withColumn("text", F.lit(f"before {item['text']} after")).withColumn("doc_id", F.lit(99).cast("long"))
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = {r["doc_id"]: r for r in find_matches(odd.unionByName(bad), bench).collect()}
    assert found[99]["n_hit"] > 9 and str(item["item_id"]) in found[99]["items"] and found[20]["n_words"] == 0
    kept = remove_contaminated(odd.unionByName(bad), bench)
    assert keys(kept.collect()) == keys(odd.collect()) and kept.columns == odd.columns


def test_languages_and_scores_of_odd_rows(spark, odd):
    from penumbra.llm import languages, toxicity

    texts = ["the cat and the dog", "der hund und die katze", "le chat et le chien"] * 8
    model = languages.fit(texts, ["en", "de", "fr"] * 8)
    out = languages.predict(odd, model)
    rows = out.collect()
    assert len(rows) == odd.count() and set(odd.columns) <= set(out.columns)
    assert all(r["lang_pred"] == "und" for r in rows if not r["text"] or not any(c.isalpha() for c in r["text"]))
    assert all(0 <= r["score"] <= 1 for r in rows)
    network = toxicity.fit(["good and kind words"] * 20 + ["awful bad hate words"] * 20, [0] * 20 + [1] * 20)
    scored = toxicity.score(odd, network).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)
    by_text = {}
    for r in scored:
        by_text.setdefault(r["text"], set()).add(r["score"])
    assert all(max(s) - min(s) < 1e-5 for s in by_text.values())  # sums of 32 bits differ by the batch


def test_a_class_of_many_rows_keeps_its_sample(spark):
    """The cut-off by hash stays above 0 where a class has more rows than 24 bits can tell apart."""
    from penumbra.llm import samples

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") < 2990, "big").otherwise("small").alias("lang"))
    got = Counter(r["class"] for r in samples.labelled_sample(docs, docs, F.lit(True), "lang", max_per_class=20).collect())
    assert got == {"big": 20, "small": 10}
    assert int(min(1.0, 500 / 10**12) * samples._STEPS) > 10**9
