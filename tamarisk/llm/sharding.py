"""Consistent hashing with virtual nodes and bounded loads, in DataFrame operations.

The ring has ``CELLS`` cells; each shard owns ``virtual`` of them.  A key's hash gives
its cell, and the next owned cell clockwise names its shard.  Full shards pass their
overflow on: round by round, the keys that found no room try the next owned cell.
Inside the arc before an owned cell keys are taken in ring order, so the placement
follows from the counts per cell alone: at most CELLS numbers reach the driver, and
the plan that comes back has at most shards * virtual + shards rows.

Equal rows are counted together before anything is sorted, and a cell is sorted in
``SPREAD`` parts, so neither a repeated row nor a hot key fills one task.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tamarisk.operators.lineage import written

CELLS = 1 << 16
SPREAD = 64
_COPIES = 10_000


@dataclass(frozen=True)
class RingParams:
    """``load_factor`` None fills every shard exactly; else a shard holds that times the mean."""

    shards: int = 24
    virtual: int = 64
    load_factor: float | None = None


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of few rows, made on the JVM side from one literal."""
    names = [part.split()[0] for part in schema.split(",")]
    data = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(data), f"array<struct<{schema.replace(' ', ':')}>>".replace(",:", ","))))


def ring_owners(p: RingParams) -> list[tuple[int, int]]:
    """(cell, shard) of the virtual nodes in ring order; a taken cell gives way to the next."""
    taken: dict[int, int] = {}
    for shard in range(p.shards):
        for v in range(p.virtual):
            cell = int.from_bytes(hashlib.blake2b(f"{shard}/{v}".encode(), digest_size=8).digest(), "big") % CELLS
            while cell in taken:
                cell = (cell + 1) % CELLS
            taken[cell] = shard
    return sorted(taken.items())


def placement(cell_counts: dict[int, int], p: RingParams) -> tuple[list[tuple], list[tuple]]:
    """Cells as (cell, arc, keys of the arc before the cell), and arcs' pieces as
    (arc, first rank, end rank, shard, slot of the first)."""
    owners = ring_owners(p)
    total = sum(cell_counts.values())
    if p.load_factor is None:
        room = [total // p.shards + (s < total % p.shards) for s in range(p.shards)]
    else:
        room = [-(-int(total * p.load_factor * 1000) // (1000 * p.shards)) for _ in range(p.shards)]
    cells, size = [], [0] * len(owners)
    first = owners[-1][0] + 1  # the arc of the first owner begins behind the last
    arc = 0
    for step in range(CELLS):
        cell = (first + step) % CELLS
        if cell in cell_counts:
            cells.append((cell, arc, size[arc]))
            size[arc] += cell_counts[cell]
        if cell == owners[arc][0]:
            arc += 1
            if arc == len(owners):
                break
    pieces, done, used = [], [0] * len(owners), [0] * p.shards
    waiting = [a for a in range(len(owners)) if size[a]]
    hop = 0
    while waiting:
        still = []
        for a in waiting:
            shard = owners[(a + hop) % len(owners)][1]
            take = min(size[a] - done[a], room[shard] - used[shard])
            if take > 0:
                pieces.append((a, done[a], done[a] + take, shard, used[shard]))
                done[a] += take
                used[shard] += take
            if done[a] < size[a]:
                still.append(a)
        waiting, hop = still, hop + 1
    return cells, pieces


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               params: RingParams = RingParams()) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless in the shard) of every row.

    size is the text's UTF-8 bytes plus 8; a null text has none and the checksum of an
    empty one.  Rows are keys by their id; a null id is one key.  Equal rows get
    different slots, in no set order.  An empty table gives an empty result.
    """
    p = params
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    keys = written(
        narrow.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("n")).select(
            "*", F.shiftrightunsigned(F.xxhash64("doc_id"), 48).cast("int").alias("cell"),
            F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(SPREAD)).cast("int").alias("part"),
        ),
        "ring-keys",
    )
    parts = keys.groupBy("cell", "part").agg(F.sum("n").alias("n"))
    counts = {r["cell"]: r["n"] for r in parts.groupBy("cell").agg(F.sum("n").alias("n")).collect()}  # CELLS at most
    cells, pieces = placement(counts, p)
    arcs = small_table(spark, cells, "cell int, arc int, before long")
    plan = small_table(spark, pieces, "arc int, lo long, hi long, shard int, slot0 long")
    ahead = W.partitionBy("cell").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("cell", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("part_before"))
    inside = W.partitionBy("cell", "part").orderBy("doc_id", "size", "text_crc32").rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        keys.withColumn("row_before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(offsets.hint("merge"), ["cell", "part"])
        .join(F.broadcast(arcs), "cell")  # CELLS rows at most
        .withColumn("rank", F.col("before") + F.col("part_before") + F.col("row_before"))
    )
    # copies of a row, some thousands at a time
    runs = ranked.withColumn("run", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / _COPIES))))
    each = runs.withColumn(
        "copy", F.explode(F.sequence(F.col("run") * _COPIES, F.least((F.col("run") + 1) * _COPIES, F.col("n")) - 1))
    ).withColumn("place", F.col("rank") + F.col("copy"))
    plan = F.broadcast(plan.withColumnRenamed("arc", "in_arc"))  # shards * (virtual + 1) rows at most
    return each.join(
        plan, (F.col("arc") == F.col("in_arc")) & (F.col("place") >= F.col("lo")) & (F.col("place") < F.col("hi"))
    ).select("doc_id", "size", "text_crc32", "shard", (F.col("slot0") + F.col("place") - F.col("lo")).alias("slot"))
