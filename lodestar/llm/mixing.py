"""Mixing sources to target weights: capped weight targets, Sainte-Lague block quotas per shard, seeded blocks.

Each source's documents are laid end to end in seeded order and cut into blocks of equal tokens.
Sainte-Lague apportionment deals the mix's blocks to the sources by highest quotients, in the order in
which the shards fill up: every shard has its integer quota of each source, and so have all shards up
to it together. A shard takes its quota as the next run of the source's blocks, from a seeded first one;
a source that is taken more than once begins anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm._spark import materialize, numbered

WORD = r"[^\x20\x09-\x0D]+"
#: Tokens of a block and shards of a mix.
BLOCK_TOKENS, SHARDS = 32, 16


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """(source, source_size, place, weight, target): one row per source of column `source` and `size`.

    Sources in code-point order, null last, take the weights in turn. The total is shared by weight;
    a target stops at `cap` times its source and the excess goes to the others by weight. With the
    sources in ascending order of cap per weight, the first one that its share does not fill fixes
    the level of all: one pass over prefix sums, one row per source.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = by_source.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    placed = placed.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    placed = placed.withColumn("top", F.lit(float(cap)) * F.col("source_size"))
    rising = Window.orderBy(F.col("top") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("top").over(rising), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rising), F.lit(0.0))
    )
    placed = placed.withColumn("level", level)
    first = F.min(F.when(F.col("top") / F.col("weight") >= F.col("level"), F.struct(F.col("top") / F.col("weight"), "place", "level"))).over(everything)
    return placed.withColumn("target", F.least("top", F.coalesce(first["level"], F.lit(0.0)) * F.col("weight"))).select("source", "source_size", "place", "weight", "target")


def block_quotas(targets: DataFrame, houses: list[int], block_tokens: int, cap: float = 3.0) -> DataFrame:
    """targets plus house and quota: seats of each house size by highest quotients target / (2k - 1), ties to the first source.

    Seats far below a source's share are certain; only those around it are ranked, a handful of
    rows per source and house. A smaller house's quotas are never above a larger one's.
    """
    sizes = F.array(*[F.struct(F.lit(j).alias("house"), F.lit(n).cast("long").alias("blocks")) for j, n in enumerate(houses)])
    every = Window.partitionBy("house")
    wide = targets.select("*", F.inline(sizes))
    wide = wide.withColumn("share", F.col("target") * F.col("blocks") / F.greatest(F.sum("target").over(every), F.lit(1e-300)))
    wide = wide.withColumn("pad", (F.lit(2) + F.ceil(F.col("share") * F.count("*").over(every) / F.greatest("blocks", F.lit(1)))).cast("long"))
    wide = wide.withColumn("sure", F.greatest(F.floor("share").cast("long") - F.col("pad"), F.lit(0).cast("long")))
    left = wide.withColumn("open", F.col("blocks") - F.sum("sure").over(every))
    seats = left.withColumn("k", F.explode(F.sequence(F.col("sure") + 1, F.floor("share").cast("long") + F.col("pad") + 1)))
    ranked = seats.withColumn("nth", F.row_number().over(every.orderBy((F.col("target") / (2 * F.col("k") - 1)).desc(), "place", "k")))
    won = ranked.groupBy("place", "house").agg(F.sum(((F.col("nth") <= F.col("open")) & (F.col("target") > 0)).cast("long")).alias("more"))
    most = (F.lit(cap) * F.ceil(F.col("source_size") / block_tokens)).cast("long")
    return wide.join(won, ["place", "house"]).select("source", "source_size", "place", "weight", "target", "house", F.least(F.col("sure") + F.col("more"), most).alias("quota"))


def shard_quotas(targets: DataFrame, blocks: int, shards: int, block_tokens: int, cap: float = 3.0) -> DataFrame:
    """(source, source_size, place, weight, target, upto): blocks of the source in the first 0, 1, ... `shards` shards.

    A shard's quota is the difference of two neighbours in `upto`. Shards have equally many blocks, but
    for one; seats are dealt in the order of their quotients.
    """
    houses = [blocks * j // shards for j in range(1, shards + 1)]
    found = block_quotas(targets, houses, block_tokens, cap)
    upto = F.transform(F.array_sort(F.collect_list(F.struct("house", "quota"))), lambda x: x["quota"])
    same = [F.first(n).alias(n) for n in ("source", "source_size", "weight", "target")]
    return found.groupBy("place").agg(*same, F.concat(F.array(F.lit(0).cast("long")), upto).alias("upto"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, seed: int = 17, block_tokens: int = BLOCK_TOKENS, shards: int = SHARDS) -> DataFrame:
    """doc_id, source, size, source_size, target, quota, taken, by_shard for every row.

    by_shard: the document's words in each shard; taken is their sum. Null texts have size 0 and are
    never taken; a null source is a source of its own; repeated rows count separately; an empty table
    gives an empty result; other columns are not read. `taken` is a whole number of passes over the
    document but for the two documents at the ends of a source's selected blocks.
    """
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    total = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    quotas = materialize(shard_quotas(source_targets(sized, weights, cap), max(1, round(total / block_tokens)), shards, block_tokens, cap), "quotas")
    facts = quotas.withColumnRenamed("source", "_source")
    rows = sized.join(facts, sized.source.eqNullSafe(F.col("_source"))).drop("_source", "weight")
    tape = numbered(rows.withColumn("_mark", F.xxhash64(F.lit(seed), "doc_id")), ["place"], ["_mark", "doc_id"], "size", "_start")
    n = F.greatest(F.ceil(F.col("source_size") / block_tokens), F.lit(1)).cast("long")
    first = F.pmod(F.xxhash64(F.lit(seed), F.lit("first"), "place"), n)

    def before(place: Column) -> Column:
        """The document's words among the first `place` tokens of its source's blocks laid end to end again and again."""
        turn = F.floor(place / (n * block_tokens)).cast("long")
        return turn * F.col("size") + F.greatest(F.least(place - turn * n * block_tokens - F.col("_start"), F.col("size")), F.lit(0).cast("long"))

    reached = tape.withColumn("_at", F.transform("upto", lambda q: before((first + q) * block_tokens)))
    by_shard = F.transform(F.sequence(F.lit(1), F.lit(shards)), lambda j: F.get("_at", j) - F.get("_at", j - 1))
    taken = (F.get("_at", F.lit(shards)) - F.get("_at", F.lit(0))).cast("long")
    return reached.select("doc_id", "source", "size", "source_size", "target", F.get("upto", F.lit(shards)).alias("quota"), taken.alias("taken"), by_shard.alias("by_shard"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as the mix takes them (taken / size, rounded); columns unchanged, whatever their names.

    Rows of one doc_id are matched by (doc_id, source, size), so repeated ids keep their own decisions;
    fully equal rows share them evenly. Wordless documents are not part of a mix and leave; an empty
    table stays empty.
    """
    taken = mix(docs, **options).where("size > 0 and taken > 0").groupBy("doc_id", "source", "size").agg(F.round(F.avg(F.col("taken") / F.col("size"))).cast("int").alias("times")).where("times > 0")
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("row"), word_count(F.col("text")).alias("words"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & F.col("row.source").eqNullSafe(F.col("source")) & (F.col("words") == F.col("size"))
    return rows.join(taken, same).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")
