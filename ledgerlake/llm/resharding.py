"""Resharding by minimum-cost flow: equal shard sizes, fewest bytes moved, equal texts together.

1. Rows are summed to groups of equal texts, and groups to blocks of each old
   shard. Groups above a small share of all bytes are blocks of their own, so
   there are at most ``shards * (PARTS + BLOCKS)`` blocks whatever the input.
2. New capacities are equal; a group larger than that has a shard to itself and
   the others share the rest.
3. A minimum-cost flow from old shard sizes to new capacities, where a byte that
   moves costs 1 and one that stays costs 0, says how much goes from where to
   where. Blocks are chosen, large ones first, to fill those transfers.
4. The map of blocks to shards (bounded as above) is joined back to the rows.
   Shards that neither give nor take keep their files.

The old layout deals groups out by a hash of the text. Its shards differ in size
because texts do.

Defined results: a null text has size 8 and is equal to the empty text; equal
rows get slots in the order in which they were read; an empty table gives an
empty result; other columns are ignored by ``place`` and kept by ``rewrite``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ledgerlake.llm.flow import cheapest_transfers
from ledgerlake.llm.tables import named, text_of, whole_row, written

SHARDS = 24
ROW_BYTES = 8
#: Blocks of an old shard; a group of more than 1 / (shards * PARTS) of all bytes is a block of its own.
BLOCKS = 2048
PARTS = 256
#: Slices of a shard within which rows are numbered.
SLICES = 256


@dataclass(frozen=True)
class Layout:
    """``blocks``: (old_shard, block, shard); ``large``: (g1, g2, shard); both small. ``moved``: bytes by (old, new)."""

    shards: int
    blocks: DataFrame
    large: DataFrame
    moved: dict[tuple[int, int], int]

    @property
    def affected(self) -> list[int]:
        return sorted({shard for pair in self.moved for shard in pair})


def _keyed(rows: DataFrame, text: Column, shards: int) -> DataFrame:
    """Adds the group (128 bits of hash), the old shard and the block in it."""
    return rows.withColumns({"g1": F.xxhash64(text), "g2": F.xxhash64(F.lit(3), text)}).withColumns(
        {"old_shard": F.pmod("g1", F.lit(shards)).cast("int"), "block": F.pmod("g2", F.lit(BLOCKS)).cast("int")}
    )


def row_size(text: Column) -> Column:
    return F.octet_length(text).cast("long") + ROW_BYTES


def capacities(total: int, large: list[int], shards: int) -> list[int]:
    """Equal integer shares; groups too large for one take a share of their own, and come first."""
    own = []
    for size in sorted(large, reverse=True):
        if len(own) < shards - 1 and size * (shards - len(own)) > total - sum(own):
            own.append(size)
    others = shards - len(own)
    share, over = divmod(total - sum(own), others)
    return own + [share + (i < over) for i in range(others)]


def choose_blocks(sizes: list[tuple[object, int, int]], shards: int) -> tuple[dict[object, int], dict[tuple[int, int], int]]:
    """New shard of every block (key, old shard, size), and the bytes that move."""
    held: list[list[tuple[int, object]]] = [[] for _ in range(shards)]
    for key, old, size in sizes:
        held[old].append((size, key))
    supply = [sum(size for size, _ in blocks) for blocks in held]
    total = sum(supply)
    room = capacities(total, [size for _, _, size in sizes], shards)
    # Room of its own goes to the shard that holds the large group.
    owners = sorted(range(shards), key=lambda s: -max([size for size, _ in held[s]], default=0))
    rooms = [0] * shards
    for shard, space in zip(owners, room):
        rooms[shard] = space
    wanted = cheapest_transfers(supply, rooms, lambda i, j: int(i != j))

    shard_of = {key: old for key, old, _ in sizes}
    load = list(supply)
    for old in range(shards):
        need = {new: amount for (i, new), amount in wanted.items() if i == old and new != old}
        for size, key in sorted(held[old], key=lambda b: (-b[0], str(b[1]))):
            new = max(need, key=lambda n: (need[n], -n), default=None)
            if new is not None and size <= need[new]:
                need[new] -= size
                shard_of[key] = new
                load[old] -= size
                load[new] += size
    _even_out(shard_of, load, sizes)
    moved: dict[tuple[int, int], int] = {}
    for key, old, size in sizes:
        if shard_of[key] != old and size:
            moved[old, shard_of[key]] = moved.get((old, shard_of[key]), 0) + size
    return shard_of, moved


def _even_out(shard_of: dict[object, int], load: list[int], sizes: list[tuple[object, int, int]]) -> None:
    """Move single blocks from the fullest to the emptiest shard while that narrows the gap."""
    held: list[dict[object, int]] = [{} for _ in load]
    for key, _, size in sizes:
        held[shard_of[key]][key] = size
    fixed: set[int] = set()
    while True:
        open_shards = [s for s in range(len(load)) if s not in fixed]
        if len(open_shards) < 2:
            return
        full, low = max(open_shards, key=lambda s: load[s]), min(range(len(load)), key=lambda s: load[s])
        gap = load[full] - load[low]
        best = min(((abs(2 * size - gap), str(key), key) for key, size in held[full].items() if 0 < size < gap), default=None)
        if best is None:
            fixed.add(full)
            continue
        key = best[2]
        size = held[full].pop(key)
        held[low][key] = size
        shard_of[key] = low
        load[full] -= size
        load[low] += size


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, schema))


def plan_layout(rows: DataFrame, shards: int = SHARDS) -> Layout:
    """``rows``: g1, g2, old_shard, block, size."""
    spark = rows.sparkSession
    groups = written(rows.groupBy("g1", "g2", "old_shard", "block").agg(F.sum("size").alias("size")), "shard-groups")
    total = groups.agg(F.sum("size").alias("n")).first()["n"] or 0
    is_large = F.col("size") * (shards * PARTS) > total
    # Bounded: fewer than shards * PARTS groups can be that large.
    large = groups.filter(is_large).collect()
    small = groups.filter(~is_large).groupBy("old_shard", "block").agg(F.sum("size").alias("size")).collect()
    sizes = [((r["g1"], r["g2"]), r["old_shard"], r["size"]) for r in large]
    sizes += [((r["old_shard"], r["block"], None), r["old_shard"], r["size"]) for r in small]
    shard_of, moved = choose_blocks(sorted(sizes, key=lambda s: str(s[0])), shards)
    return Layout(
        shards,
        _table(spark, [(k[0], k[1], s) for k, s in shard_of.items() if len(k) == 3], "old_shard int, block int, shard int"),
        _table(spark, [(*k, s) for k, s in shard_of.items() if len(k) == 2], "g1 long, g2 long, shard int"),
        moved,
    )


def assign(rows: DataFrame, layout: Layout) -> DataFrame:
    """Adds ``shard`` to keyed rows."""
    large = layout.large.withColumnRenamed("shard", "_large")
    blocks = layout.blocks.withColumnRenamed("shard", "_block")
    found = rows.join(large, ["g1", "g2"], "left").join(blocks, ["old_shard", "block"], "left")
    return found.withColumn("shard", F.coalesce("_large", "_block")).drop("_large", "_block")


def place(docs: DataFrame, shards: int = SHARDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard; shard sizes are nearly equal."""
    words = text_of(text)
    rows = docs.select(
        named(doc_id).alias("doc_id"),
        row_size(words).alias("size"),
        F.crc32(words).alias("text_crc32"),
        words.alias("_text"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(_keyed(rows, F.col("_text"), shards).drop("_text"), "shard-rows")
    placed = assign(rows, plan_layout(rows, shards))
    placed = written(placed.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(SLICES)).cast("int")), "shard-placed")
    # One row per shard and slice.
    counts = placed.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    in_slice = F.row_number().over(Window.partitionBy("shard", "slice").orderBy("row")) - 1
    return (
        placed.withColumn("at", in_slice)
        .join(F.broadcast(starts), ["shard", "slice"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("start") + F.col("at")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "old_shard",
        )
    )


def folder_column(docs: DataFrame) -> str:
    """The column that names a shard's folder: ``shard``, or with a number where documents have that column."""
    taken, number = {c.lower() for c in docs.columns}, 2
    name = "shard"
    while name in taken:
        name, number = f"shard_{number}", number + 1
    return name


def _whole_with_text(docs: DataFrame, text: str) -> tuple[DataFrame, Column]:
    return docs.select(whole_row(docs).alias("row")), F.coalesce(F.col("row").getField(text).cast("string"), F.lit(""))


def write_old(docs: DataFrame, path: str, shards: int = SHARDS, text: str = "text") -> None:
    """The layout before: a folder per shard (see ``folder_column``), dealt by a hash of the text."""
    rows, words = _whole_with_text(docs, text)
    name = folder_column(docs)
    _keyed(rows, words, shards).select("row.*", F.col("old_shard").alias(name)).write.partitionBy(name).parquet(path)


def rewrite(docs: DataFrame, path: str, shards: int = SHARDS, text: str = "text") -> Layout:
    """Write the shards that give or take rows anew under ``path``; other shards keep their old files there.

    ``docs`` is read while files under ``path`` are replaced, so it must come
    from elsewhere, as from the snapshot that ``path`` was copied from.
    """
    rows, words = _whole_with_text(docs, text)
    rows, name = _keyed(rows, words, shards), folder_column(docs)
    layout = plan_layout(rows.withColumn("size", row_size(words)).drop("row"), shards)
    placed = assign(rows, layout).filter(F.col("shard").isin(layout.affected))
    out = placed.select("row.*", F.col("shard").alias(name)).write.partitionBy(name).option("partitionOverwriteMode", "dynamic")
    out.mode("overwrite").parquet(path)
    return layout
