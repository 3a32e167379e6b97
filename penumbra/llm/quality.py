"""Operator 6: quality rules as weak supervision. Native: DataFrame functions only.

``features`` measures each text. ``VOTES`` are rules that vote good (1), bad (-1)
or abstain (0). Expectation-maximisation over the counts of vote patterns (at
most 3 to the number of rules, so a bounded table) estimates each rule's
behaviour on good and on bad texts, without labels. The posterior probability
of good is then a sum of log odds, one for each vote, as a column expression.

A null or empty text has no words: its measures are 0, all rules abstain but
that on length, and the base rule fails it. Rows are judged one by one, so
repeated rows and ties change nothing but the estimate's counts, and texts of any
length are read whole. All other columns stay, whatever their names. An empty
table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penumbra.llm.shared import settle

_SPACES = " \t\n\x0b\x0c\r"
_SPACE_CLASS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_upper", "n_stops", "n_letters", "n_bare", "n_distinct")


def features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and the measures of ``FEATURES`` (long); measures replace columns of their names.

    ``n_repeat_words`` counts the words inside 3-word windows that occur at least
    twice in the text. Windows are compared by 64-bit hashes, sorted with their
    places only in texts where two agree.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns if c not in FEATURES))
    text = F.col("t")
    rows = df.select(whole.alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")).withColumns({
        "words": F.filter(F.split(text, _SPACE_CLASS), lambda w: w != ""),
        "lines": F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, _SPACES, "")) > 0),
        "n_chars": F.length(text).cast("long"),
        "word_chars": F.length(F.translate(text, _SPACES, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_upper": (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long"),
        "n_letters": F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("long"),
        "n_stops": (F.length(text) - F.length(F.translate(text, ".!?", ""))).cast("long"),
    }).drop("t")
    size = F.size("words")
    words = F.col("words")
    rows = rows.withColumns({
        "n_words": size.cast("long"),
        "n_bare": F.size(F.filter("words", lambda w: F.translate(w, SYMBOLS, "") == "")).cast("long"),
        "n_distinct": F.size(F.array_distinct("words")).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "grams": F.when(size >= 3, F.transform(F.sequence(F.lit(0), size - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))),
    }).drop("words", "lines")
    rows = rows.withColumn(
        "sorted",
        F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))),
    ).drop("grams")
    ordered = F.col("sorted")

    def repeated(e: Column, k: Column) -> Column:
        return F.coalesce(e["g"] == F.get(ordered, k - 1)["g"], F.lit(False)) | F.coalesce(e["g"] == F.get(ordered, k + 1)["g"], F.lit(False))

    rows = rows.withColumn("places", F.sort_array(F.transform(F.filter(ordered, repeated), lambda e: e["i"]))).drop("sorted")
    places = F.col("places")
    covered = F.aggregate(F.transform(places, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b)
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).select("row.*", *FEATURES)


def _rate(over: str, under: str) -> Column:
    return F.col(over) / F.greatest(F.col(under), F.lit(1))


def votes() -> dict[str, Column]:
    """Each rule's vote: 1 good, -1 bad, 0 abstains. The rules' limits."""

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    some, mean = F.col("n_words") > 0, _rate("word_chars", "n_words")
    return {
        "v_length": vote(F.col("n_words") < 50, F.col("n_words") >= 80),
        "v_word": vote(some & ((mean < 3) | (mean > 10)), some & mean.between(3.5, 8)),
        "v_symbols": vote(_rate("n_symbols", "n_words") > 0.1, some & (_rate("n_symbols", "n_words") < 0.02)),
        "v_bare": vote(_rate("n_bare", "n_words") > 0.05, some & (_rate("n_bare", "n_words") < 0.01)),
        "v_letters": vote(some & (_rate("n_letters", "word_chars") < 0.75), some & (_rate("n_letters", "word_chars") > 0.85)),
        "v_dup_lines": vote(_rate("n_dup_lines", "n_lines") > 0.3, some & (_rate("n_dup_lines", "n_lines") < 0.1)),
        "v_repeats": vote(_rate("n_repeat_words", "n_words") > 0.3, some & (_rate("n_repeat_words", "n_words") < 0.1)),
        "v_upper": vote(_rate("n_upper", "word_chars") > 0.4, some & (_rate("n_upper", "word_chars") < 0.2)),
        "v_stops": vote(some & (_rate("n_stops", "n_words") < 0.01), some & _rate("n_stops", "n_words").between(0.02, 0.5)),
        "v_distinct": vote((F.col("n_words") >= 50) & (F.col("n_distinct") / F.sqrt("n_words") < 2.5), some & (F.col("n_distinct") / F.sqrt(F.greatest("n_words", F.lit(1))) > 4)),
    }


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 100) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """The share of good texts, and for each rule {vote: (its probability on good texts, on bad texts)}.

    Starts from texts without a bad vote as good: rules each look at another
    fault, so a bad text breaks one or two of them and satisfies the others. A
    bad vote that most texts get starts as a small fault.
    Counts are smoothed by one vote of each kind, so no vote is ever certain.
    """
    n_rules, total = len(next(iter(patterns), ())), sum(patterns.values())
    rare = [1 - sum(n for p, n in patterns.items() if p[r] == -1) / max(1, total) for r in range(n_rules)]
    good = {p: 1 / (1 + math.exp(5.0 * sum(w for v, w in zip(p, rare, strict=True) if v == -1) - 3.0)) for p in patterns}
    prior, tables = 0.5, [{v: (1 / 3, 1 / 3) for v in (-1, 0, 1)} for _ in range(n_rules)]
    for _ in range(rounds if total else 0):
        mass = sum(n * good[p] for p, n in patterns.items())
        prior = (mass + 1) / (total + 2)
        tables = []
        for r in range(n_rules):
            table = {}
            for v in (-1, 0, 1):
                on_good = sum(n * good[p] for p, n in patterns.items() if p[r] == v)
                on_bad = sum(n * (1 - good[p]) for p, n in patterns.items() if p[r] == v)
                table[v] = ((on_good + 1) / (mass + 3), (on_bad + 1) / (total - mass + 3))
            tables.append(table)
        for p in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(tables[r][v][0] / tables[r][v][1]) for r, v in enumerate(p))
            good[p] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
    return prior, tables


def judge(measured: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``measured`` (with ``features``) and base_failed, p_good and kept, which replace columns of their names.

    The base rule fails texts of fewer than 50 words and those with more than
    half their words in repeated windows. The rules' behaviour is estimated on the
    others, which are kept if the posterior probability reaches ``threshold``.
    Measures are written once, as both the estimate and the verdict read them.
    """
    rules = votes()
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    whole = F.struct(*(F.col(f"`{c}`") for c in measured.columns if c not in ("base_failed", "p_good", "kept")))
    written = settle(measured.select(whole.alias("row"), *FEATURES), "quality")
    voted = written.withColumns(rules).withColumn("base_failed", failed)
    counts = voted.filter(~F.col("base_failed")).groupBy(*rules).count().collect()  # 3**10 rows at most
    patterns = {tuple(r[name] for name in rules): r["count"] for r in counts}
    prior, tables = estimate(patterns)
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, table in zip(rules, tables, strict=False):
        odds += reduce(lambda c, v, name=name, table=table: c.when(F.col(name) == v, math.log(table[v][0] / table[v][1])), (-1, 0, 1), F)
    p_good = 1 / (1 + F.exp(-odds))
    return voted.withColumn("p_good", p_good).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold)).select("row.*", "base_failed", "p_good", "kept")
