"""Sharding: best-fit-decreasing bin packing of indivisible groups through a balanced tree."""

from __future__ import annotations

import random
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm._spark import materialize, numbered

#: Items packed on the driver are at least a shard's size divided by this, so there are at most
#: shards * PARTS large groups and as many bundles of small ones, whatever the input.
PARTS = 256


class RoomTree:
    """Treap of (room, bin): insert, and take the bin of the least room that still fits."""

    def __init__(self) -> None:
        self.root, self._rng = None, random.Random(0)

    def insert(self, key: tuple[int, int]) -> None:
        low, high = self._split(self.root, key)
        self.root = self._merge(self._merge(low, [key, self._rng.random(), None, None]), high)

    def take(self, size: int) -> tuple[int, int] | None:
        low, high = self._split(self.root, (size, -1))
        least = high
        while least and least[2]:
            least = least[2]
        if least:
            _, high = self._split(high, (least[0][0], least[0][1] + 1))
        self.root = self._merge(low, high)
        return least[0] if least else None

    def _split(self, node, key):
        """Nodes below key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = self._split(node[3], key)
            node[3] = low
            return node, high
        low, high = self._split(node[2], key)
        node[2] = high
        return low, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b


def best_fit_decreasing(items: Iterable[tuple[int, object]], capacity: int) -> dict[object, int]:
    """item -> bin: items by falling size, each into the bin whose room is tightest, else a new bin."""
    tree, bins, out = RoomTree(), 0, {}
    for size, item in sorted(items, key=lambda x: (-x[0], x[1])):
        room, where = tree.take(size) or (max(capacity, size), bins)
        bins += where == bins
        out[item] = where
        tree.insert((room - size, where))
    return out


def least_capacity(items: list[tuple[int, object]], shards: int) -> dict[object, int]:
    """The packing of the least capacity (to a thousandth) that fills at most `shards` bins."""
    if not items:
        return {}
    low = max(max(s for s, _ in items), -(-sum(s for s, _ in items) // shards))
    high, best = 2 * low, best_fit_decreasing(items, 2 * low)
    capacity = low
    while True:
        packed = best_fit_decreasing(items, capacity)
        if len(set(packed.values())) <= shards:
            high, best = capacity, packed
        else:
            low = capacity + 1
        if high - low <= max(low // 2000, 0):
            return best
        capacity = (low + high) // 2


def shard(docs: DataFrame, shards: int = 16, parts: int = PARTS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row; equal texts share a shard.

    Size is the text's UTF-8 bytes plus 1 (null: 1, crc32 0, a group of its own). Groups below a
    shard's size / `parts` travel in hash bundles, larger ones singly. A group above a shard's fair
    size sets the capacity, since it cannot be divided. Slots number each shard's rows from 0 by
    doc_id. Repeated rows and ids keep their rows and share a shard with their text. Empty tables give
    empty results; other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    rows = materialize(
        docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64("text").alias("_group")),
        "shard-rows",
    )
    groups = materialize(rows.groupBy("_group").agg(F.sum("size").alias("bytes")), "shard-groups")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    unit, bundles = max(1, total // (shards * parts)), shards * parts
    bundle = F.pmod(F.col("_group"), F.lit(bundles))
    items = [(r.bytes, ("group", r._group)) for r in groups.where(F.col("bytes") >= unit).collect()]
    items += [(r.bytes, ("bundle", r.b)) for r in groups.where(F.col("bytes") < unit).groupBy(bundle.alias("b")).agg(F.sum("bytes").alias("bytes")).collect()]
    packed = least_capacity(items, shards)
    table = spark.createDataFrame([(k == "group", i, b) for (k, i), b in packed.items()], "_single boolean, _id long, shard int")
    single = F.broadcast(table.where("_single").select(F.col("_id").alias("_group"), F.col("shard").alias("_own")))
    bundled = F.broadcast(table.where("not _single").select(F.col("_id").alias("_bundle"), F.col("shard").alias("_shared")))
    placed = rows.join(single, "_group", "left").withColumn("_bundle", bundle).join(bundled, "_bundle", "left")
    placed = placed.select("doc_id", "size", "text_crc32", F.coalesce("_own", "_shared").alias("shard"), F.lit(1).alias("_one"))
    return numbered(placed, ["shard"], ["doc_id", "size", "text_crc32"], "_one", "slot").select("doc_id", "size", "text_crc32", "shard", "slot")
