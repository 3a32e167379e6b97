"""Operator 8: sharding by a consistent-hash ring with bounded loads. Native.

The ring is cut into ``2**cell_bits`` equal cells. Each shard owns
``virtual_nodes`` cells at hashed places; a key belongs to the first virtual
node clockwise from the cell of its hash. A shard takes keys only up to its
capacity, keys beyond that continue clockwise to the next shard with room.

Keys of a cell are ranked, and only the numbers of keys by cell (a bounded
table) are laid out on the driver. Each stretch of ranks then has one shard and
one first slot, so no shard's rows are ever gathered in one task. A cell is
split into parts by a hash of the whole row's digest, so a key that many rows
share is ranked in several tasks.

Null keys hash like any other value. Equal rows are interchangeable, each has a
slot of its own. Texts are not read. An empty table gives no rows. All columns
of the input stay, whatever their names; ``shard`` and ``slot`` replace columns
of those names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a cell; a cell's rows are ranked in so many groups.
PARTS = 4


def virtual_nodes_of(n_shards: int, virtual_nodes: int, cell_bits: int) -> list[tuple[int, int]]:
    """(cell, shard) of every virtual node, clockwise."""
    nodes = []
    for shard in range(n_shards):
        for replica in range(virtual_nodes):
            place = int.from_bytes(hashlib.blake2b(f"{shard}/{replica}".encode(), digest_size=8).digest(), "big")
            nodes.append((place, shard))
    return [(place >> (64 - cell_bits), shard) for place, shard in sorted(nodes)]


def capacities(total: int, n_shards: int, load_factor: float) -> list[int]:
    """Rows that each shard takes at most; at factor 1 counts differ by one at most."""
    if load_factor <= 1:
        return [total // n_shards + (shard < total % n_shards) for shard in range(n_shards)]
    return [-int(-load_factor * total // n_shards)] * n_shards


def lay_out(counts: dict[tuple[int, int], int], nodes: Sequence[tuple[int, int]], room: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """(cell, part, first rank, last rank + 1, shard, first slot) of every stretch of ranks.

    All shards first take keys of their own cells, in ring order; what is over
    goes one shard further clockwise, round by round.
    """
    room, filled, out = list(room), [0] * len(room), []
    waiting, node = [], 0
    for (cell, part), n in sorted(counts.items()):
        while node < len(nodes) and nodes[node][0] < cell:
            node += 1
        waiting.append((cell, part, 0, n, node % len(nodes)))
    while waiting:
        over = []
        for cell, part, first, last, at in waiting:
            shard = nodes[at][1]
            taken = min(room[shard], last - first)
            if taken:
                out.append((cell, part, first, first + taken, shard, filled[shard]))
                room[shard] -= taken
                filled[shard] += taken
            if first + taken < last:
                beyond = (at + 1) % len(nodes)
                while nodes[beyond][1] == shard and len(room) > 1:
                    beyond = (beyond + 1) % len(nodes)
                over.append((cell, part, first + taken, last, beyond))
        waiting = over
    return out


def shard_rows(
    df: DataFrame,
    keys: Sequence[Column],
    digest: Sequence[Column],
    n_shards: int = 8,
    virtual_nodes: int = 128,
    load_factor: float = 1.0,
    cell_bits: int = 12,
) -> DataFrame:
    """``df`` with shard and slot (gapless from 0 in each shard).

    ``keys`` place a row on the ring; ``digest`` (columns that tell rows of a key
    apart) orders rows of equal place.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in ("shard", "slot")))
    told = {f"k{n}": c for n, c in enumerate([*keys, *digest])}  # what rows are told apart by
    rows = df.select(whole.alias("row"), *(c.alias(k) for k, c in told.items())).withColumns({
        "place": F.xxhash64(*list(told)[: len(keys)]),
        "digest": F.xxhash64(*told),
    }).withColumns({"cell": F.shiftrightunsigned("place", 64 - cell_bits).cast("int"), "part": F.pmod("digest", F.lit(PARTS)).cast("int")})
    counts = {(r[0], r[1]): r[2] for r in rows.groupBy("cell", "part").count().collect()}  # 2**cell_bits * PARTS rows at most
    total = sum(counts.values())
    stretches = lay_out(counts, virtual_nodes_of(n_shards, virtual_nodes, cell_bits), capacities(total, n_shards, load_factor))
    layout = df.sparkSession.createDataFrame(stretches, "c int, p int, first long, end long, shard int, start long")
    rank = Window.partitionBy("cell", "part").orderBy("place", "digest", *told)
    ranked = rows.withColumn("rank", F.row_number().over(rank) - 1)
    # the layout has a row for each part of a cell and one more for each time a shard fills up
    joined = ranked.join(
        F.broadcast(layout),
        (F.col("cell") == F.col("c")) & (F.col("part") == F.col("p")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")),
    )
    return joined.select("row.*", "shard", (F.col("start") + F.col("rank") - F.col("first")).alias("slot"))
