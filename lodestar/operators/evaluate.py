"""Retrieval evaluation: expected ids, hits at k, recall by category, citations, miss reasons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.functions import text
from lodestar.session import running_max, stored


def expected_ids(golden: DataFrame) -> DataFrame:
    many, one = F.coalesce("expected_canon_ids", F.array().cast("array<string>")), F.coalesce("expected_canon_id", F.lit(""))
    return golden.withColumn("expected", F.when(F.size(many) > 0, many).when(one != "", F.array(one)).otherwise(F.array().cast("array<string>")))


def hits_at_k(golden: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """golden plus hit (0/1): some expected id matches one of the first k hits. golden: id, expected; hits: id, rank, canon_id."""
    pairs = golden.select("id", F.explode("expected").alias("_expected")).join(hits.where(F.col("rank") <= k).select("id", "canon_id"), "id")
    found = pairs.groupBy("id").agg(F.max(text.ids_match(F.col("_expected"), F.col("canon_id")).cast("int")).alias("hit"))
    return golden.join(found, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def recall_by_category(results: DataFrame) -> DataFrame:
    category = F.upper(F.coalesce(text.nullif_empty(F.col("category")), F.lit("UNKNOWN")))
    return results.groupBy(category.alias("category")).agg(F.count("*").alias("n"), F.avg("hit").alias("recall"))


def recall_subsets(results: DataFrame) -> DataFrame:
    of = lambda *c: F.avg(F.when(F.upper("category").isin(*c), F.col("hit")))
    return results.agg(F.coalesce(F.avg("hit"), F.lit(0.0)).alias("recall_all"), of("A", "B").alias("recall_ab"), of("A", "B", "C").alias("recall_abc"))


def citation_exists(cites: DataFrame, chunks: DataFrame, scoped: bool = False) -> DataFrame:
    """cites (cite_id, coord) that fall in some chunk's coordinate range, by code points.

    Unscoped, any chunk counts; `scoped` looks only at chunks of the citation's own work. A chunk holds c
    if among those (of the work) starting at or before c the greatest end reaches c. That is one ordered
    pass over chunk starts and citations, not a theta join, whatever the number of chunks of a work.
    """
    work = (lambda c: c.alias("work")) if scoped else (lambda c: F.lit("").alias("work"))
    starts = chunks.select(work(F.col("canon_id") if scoped else None), F.col("coord_start").alias("at"), F.lit(0).alias("side"), F.col("coord_end").alias("reach"), F.lit(None).cast("long").alias("cite_id"))
    asked = cites.select(work(text.canon_id_from_coord(F.col("coord")) if scoped else None), "coord", F.lit(1), F.lit(None).cast("string"), "cite_id")
    points = starts.union(asked).where("at is not null and work is not null")
    good = running_max(points, ["at", "side"], "reach", "_reach", ("work",) if scoped else ()).where("side = 1 and _reach >= at").select("cite_id")
    return cites.join(good, "cite_id", "left_semi")


def citation_accuracy(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """citations, accuracy (null without citations) over all 【…】 of column sample_answer."""
    found = answers.select(F.explode(text.citations(F.col("sample_answer"))).alias("_raw")).select(F.monotonically_increasing_id().alias("cite_id"), text.citation_coord(F.col("_raw")).alias("coord"))
    cites = stored(found, "citations")  # numbered once, read twice
    good = citation_exists(cites, chunks).agg(F.count("*").alias("good"))
    return cites.agg(F.count("*").alias("citations")).crossJoin(good).select("citations", F.try_divide("good", "citations").alias("accuracy"))


def miss_reasons(results: DataFrame, hits: DataFrame) -> DataFrame:
    """results with miss_reason (null on a hit). results: id, expected, sub_terms, hit; hits: id, rank, canon_id."""
    got = hits.where(F.col("rank") <= 10).groupBy("id").agg(F.collect_list("canon_id").alias("_got"), F.count("*").alias("_n"))
    joined = results.join(got, "id", "left").withColumn("_got", F.filter(F.coalesce("_got", F.array().cast("array<string>")), lambda c: c != ""))
    families = F.transform("expected", lambda c: F.coalesce(text.normalize_id(c), F.upper(F.substring(c, 1, 3))))
    near = F.transform("_got", lambda c: F.upper(F.substring(c, 1, 3)))
    starts = lambda a, *p: F.exists(a, lambda c: F.rlike(c, F.lit("^(" + "|".join(p) + ")")))
    reason = (
        F.when(F.coalesce("_n", F.lit(0)) == 0, "no_hits").when(F.size("_got") == 0, "empty_canon_ids")
        .when(F.arrays_overlap(families, near), "wrong_volume_same_family")
        .when(starts("expected", "T01", "T02") & starts("_got", "T38", "T42"), "wrong_corpus_family")
        .when(F.coalesce(F.size("sub_terms"), F.lit(0)) <= 0, "semantic_drift").otherwise("bm25_and_vector_miss")
    )
    return joined.withColumn("miss_reason", F.when(F.col("hit") == 0, reason)).drop("_got", "_n")
