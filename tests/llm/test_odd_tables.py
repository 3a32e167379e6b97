"""Columns whose names clash with anything, and repeated ids, over the operators that keep whole rows."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

CLASH = ["row", "cell", "_cell", "bucket", "_bucket", "_rest", "rest", "_words", "v_length", "_doc", "of", "gone", "_kept", "rows", "twice", "score", "domain", "place", "digest", "k0", "copies", "id", "t"]
TEXT = "some words that make a text of more than five words number "


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, TEXT + str(k) * 3, "en", "src1") for k in range(6)] + [(0, TEXT + "000", "en", "src1"), (1, "another text under an id that is used twice here", None, None), (None, TEXT, "de", "src2"), (7, None, "en", "src1"), (8, "", "en", "src1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.select("*", *(F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASH))


def unharmed(df, out, added=()):
    assert out.columns == [*df.columns, *added]
    rows = out.collect()
    for r in rows:
        for c in CLASH:
            assert r[c] == f"{c} of {'none' if r['doc_id'] is None else r['doc_id']}"
    return rows


def test_sharding(odd):
    from penumbra.llm.ring import shard_rows

    rows = unharmed(odd, shard_rows(odd, [F.col("doc_id")], [F.col("text")], 3), ("shard", "slot"))
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd.select("doc_id").collect())


def test_mixing(odd):
    from penumbra.llm.budgets import mix

    rows = unharmed(odd, mix(odd, ["lang", "source"], {}, 2.0, 1), ("n_tokens", "epoch"))
    assert sum(r["n_tokens"] > 0 for r in rows) == 9


def test_quality(odd):
    from penumbra.llm.quality import FEATURES, features, judge

    rows = unharmed(odd, judge(features(odd)), (*FEATURES, "base_failed", "p_good", "kept"))
    assert len(rows) == 11


def test_one_of_each_group_stays_and_no_text_of_a_kept_id_is_lost(odd):
    from penumbra.llm.jaccard import keep_one

    rows = unharmed(odd, keep_one(odd, percent=60))
    got = Counter((r["doc_id"], r["text"]) for r in rows)
    assert max(got.values()) == 1
    assert (None, TEXT) in got and (7, None) in got and (8, "") in got and (0, TEXT + "000") in got


def test_lines(odd):
    from penumbra.llm.lines import dedup_lines

    out = dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_removed"] and out.count() == 11
