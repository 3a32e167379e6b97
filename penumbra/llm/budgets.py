"""Operator 5: mixing sources to target weights by hierarchical budgeting.

The columns ``levels`` (say domain, language, source) make a tree. The budget of
tokens is handed down it by weights: each node shares its budget among its
children, a child gets at most what its leaves can give in ``max_epochs``
epochs, and what one child cannot give goes to its siblings by their weights.
Only what a whole family cannot give is left to the siblings of its parent.

Each leaf then takes whole epochs and, of one more epoch in seeded random order,
the longest prefix of documents whose tokens fit into what is left. Prefix sums
run over hash buckets first and over documents in the one bucket that holds the
cut, so a leaf of any size is never gathered in one task. The tree itself, one
row a leaf, is laid out on the driver.

Null level values are a child of their own. Null texts have no tokens; such
documents go with the prefix like any other. Equal rows are interchangeable.
Texts of any length are counted whole; a text beyond its leaf's budget is never
part of a prefix. An empty table gives no rows. All columns stay, whatever their
names; ``n_tokens`` and ``epoch`` replace columns of those names.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Hash buckets of a leaf's epoch.
BUCKETS = 1024

Path = tuple


def fill(budget: float, weights: Mapping, room: Mapping) -> dict:
    """Share ``budget`` by weights, each child up to its room; what one can't take goes to the others."""
    given, open_ = dict.fromkeys(room, 0.0), {c for c in room if weights[c] > 0}
    left = min(budget, sum(room[c] for c in open_))
    while open_ and left > 1e-9:
        total = sum(weights[c] for c in open_)
        full = {c for c in open_ if given[c] + left * weights[c] / total >= room[c] - 1e-9}
        if not full:
            for c in open_:
                given[c] += left * weights[c] / total
            break
        for c in full:
            left -= room[c] - given[c]
            given[c] = room[c]
        open_ -= full
    return given


def hand_down(sizes: Mapping[Path, int], budget: float, weights: Mapping[Path, float], max_epochs: int) -> dict[Path, int]:
    """Tokens for each leaf. ``weights`` are of paths from the root; a path without weight has weight 1."""
    room: dict[Path, float] = {}
    for path, size in sizes.items():
        for k in range(len(path) + 1):
            room[path[:k]] = room.get(path[:k], 0) + size * max_epochs
    children: dict[Path, list[Path]] = {}
    for path in sorted(room, key=str):
        if path:
            children.setdefault(path[:-1], []).append(path)
    given, queue, leaves = {(): min(budget, room.get((), 0))}, [()], {}
    while queue:
        node = queue.pop()
        if node not in children:
            leaves[node] = int(given[node] + 1e-6)
            continue
        shares = fill(given[node], {c: weights.get(c, 1.0) for c in children[node]}, {c: room[c] for c in children[node]})
        given |= shares
        queue += children[node]
    return {path: leaves.get(path, 0) for path in sizes}


def count_tokens(text_col: str = "text"):
    """Words between white space, a plain measure of tokens."""
    return F.size(F.filter(F.split(F.coalesce(text_col, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def mix(df: DataFrame, levels: Sequence[str], weights: Mapping[Path, float], share: float, max_epochs: int = 1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The chosen rows with ``n_tokens`` and ``epoch``, which replace columns of those names; a row comes once for each epoch that takes it.

    The budget is ``share`` of all tokens.
    """
    spark = df.sparkSession
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in ("n_tokens", "epoch")))
    keys = [f"level{k}" for k in range(len(levels))]
    rows = df.select(
        whole.alias("row"), count_tokens(text_col).alias("n_tokens"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_hash"),
        *(F.col(f"`{c}`").cast("string").alias(k) for k, c in zip(keys, levels, strict=True)),
    )
    sizes = {tuple(r[k] for k in keys): r["size"] for r in rows.groupBy(*keys).agg(F.sum("n_tokens").alias("size")).collect()}  # one row a leaf of the tree
    budgets = hand_down(sizes, share * sum(sizes.values()), weights, max_epochs)
    plan = []
    for path, size in sizes.items():
        full = min(max_epochs, budgets[path] // size) if size else 0
        plan.append((*path, int(full), int(budgets[path] - full * size)))
    leaf_ddl = ", ".join(f"leaf{n} string" for n in range(len(keys)))
    leaves = spark.createDataFrame(plan, f"{leaf_ddl}, full int, rest long")

    def meets(prefix: str):
        condition = F.lit(True)
        for n, k in enumerate(keys):
            condition &= F.col(k).eqNullSafe(F.col(f"{prefix}{n}"))
        return condition

    placed = rows.join(F.broadcast(leaves), meets("leaf")).drop(*(f"leaf{n}" for n in range(len(keys))))  # one row a leaf
    placed = placed.withColumn("order", F.xxhash64(F.lit(seed), "full", F.col("id").cast("string"), *keys))
    placed = placed.withColumn("bucket", F.shiftrightunsigned("order", 64 - (BUCKETS.bit_length() - 1)).cast("int"))
    sums = placed.filter("rest > 0").groupBy(*keys, "bucket", "rest").agg(F.sum("n_tokens").alias("sum"))
    upto = Window.partitionBy(*keys).orderBy("bucket")  # at most BUCKETS rows a leaf
    cuts = sums.withColumn("upto", F.sum("sum").over(upto)).filter(F.col("upto") > F.col("rest")).groupBy(*(F.col(k).alias(f"cut{n}") for n, k in enumerate(keys)))
    cuts = cuts.agg(F.min("bucket").alias("cut"), F.min_by(F.col("upto") - F.col("sum"), "bucket").alias("before"))
    cut = placed.join(F.broadcast(cuts), meets("cut"), "left").drop(*(f"cut{n}" for n in range(len(keys))))  # one row a leaf
    by_bucket = cut.withColumn("in", (F.col("rest") > 0) & (F.col("cut").isNull() | (F.col("bucket") < F.col("cut"))))
    at_cut = (F.col("rest") > 0) & F.coalesce(F.col("bucket") == F.col("cut"), F.lit(False))
    within = Window.partitionBy(*keys).orderBy("order", "id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    edge = by_bucket.filter(at_cut).withColumn("in", F.col("before") + F.sum("n_tokens").over(within) <= F.col("rest"))
    chosen = by_bucket.filter(~at_cut).unionByName(edge).withColumn("copies", F.col("full") + F.col("in").cast("int"))
    return chosen.filter("copies > 0").select("row.*", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("epoch"))
