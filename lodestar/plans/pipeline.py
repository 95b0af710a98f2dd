"""Batch retrieval over a table of questions: hybrid search, plan-driven retrieval, answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import lexicon, tasks, text
from lodestar.operators import fusion, infer, queryprep, search, state, text_index
from lodestar.session import stored

#: Distinct hits below which a scoped question is asked again without its scope.
LEAST_HITS = 1


def hybrid_search(queries: DataFrame, chunks: DataFrame, term_top: int = 10, scorer=None, rrf: bool = True, reranked: bool = True, token_table: str | None = None) -> DataFrame:
    """query_id, id, canon_id, text, score, distance, rank: vector, token and per-term substring lists fused, boosted and reranked.

    queries: query_id, original, normalized, vector, series_hint, sub_terms, canon_prefixes, boost_prefixes
    and the per-query limits vec_top, bm25_top, fuse_top, rerank_top. Each list is filtered by series and
    prefixes before its limit (the vector list as in `vector_search`); terms fall back to the boost
    prefixes. Scoped questions without a hit run the vector and token searches again unscoped. The
    fused list is cut at fuse_top, reranked by the original question and cut at rerank_top. Without
    `rrf` the lists are merged in order instead. `token_table` is the path of a `text_index` token table
    of the chunks; without it the token search scans the texts.
    """
    columns = ["id", "canon_id", "text", "embedding"] + (["series"] if "series" in chunks.columns else [])
    light, scope = chunks.select(*columns), "series" in chunks.columns
    keys = ["query_id"] + ([F.col("series_hint").alias("series")] if scope else [])

    def lists(q: DataFrame, scoped: bool) -> DataFrame:
        prefixes = F.col("canon_prefixes") if scoped else F.array().cast("array<string>")
        near = search.vector_search(q.select(*keys, "vector", prefixes.alias("prefixes"), F.col("vec_top").alias("k")), light, 40, prefixes=scoped)
        asked = q.select(*keys, F.col("normalized").alias("query"), prefixes.alias("prefixes"), F.col("bm25_top").alias("k"))
        words = search.token_search(asked, light) if token_table is None else text_index.search_tokens(asked, token_table)
        none = F.lit(None).cast("double").alias("distance")
        return near.select("query_id", F.lit("vector").alias("list_name"), F.lit(0).alias("source"), "id", "rank", "distance").union(words.select("query_id", F.lit("tokens"), F.lit(1), "id", "rank", none))

    held = F.when(F.size("canon_prefixes") > 0, F.col("canon_prefixes")).otherwise(F.col("boost_prefixes"))
    terms = queries.select(*keys, F.posexplode("sub_terms").alias("at", "term"), held.alias("scope"))
    by_term = search.keyword_search(terms.drop("at"), light, term_top).join(terms.select("query_id", "term", "at").groupBy("query_id", "term").agg(F.min("at").alias("at")), ["query_id", "term"])
    by_term = by_term.select("query_id", F.concat(F.lit("term:"), "term").alias("list_name"), (F.col("at") + 2).alias("source"), "id", "rank", F.lit(None).cast("double").alias("distance"))
    by_term, first = stored(by_term, "term-ranks"), stored(lists(queries, True), "ranks")
    hits = first.union(by_term).groupBy("query_id").agg(F.count_distinct("id").alias("_n")).where(F.col("_n") >= LEAST_HITS)
    scoped = queries.where(F.size("canon_prefixes") > 0)
    missed = scoped.join(hits, "query_id", "left_anti")
    kept = first.join(missed.select("query_id"), "query_id", "left_anti")
    if missed.head(1):
        kept = kept.union(lists(missed, False))
    ranks = stored(kept.union(by_term), "all-ranks")
    distance = ranks.groupBy("query_id", "id").agg(F.min("distance").alias("distance"))
    if rrf:
        payload = queries.select("query_id", F.col("normalized").alias("query"), "boost_prefixes", "fuse_top")
        sizes = queries.select("query_id", (2 + F.size(F.array_distinct("sub_terms"))).alias("n_lists"))
        fused = fusion.rrf_fuse(ranks.select("query_id", "list_name", "id", "rank").join(light.select("id", "canon_id"), "id"), sizes, payload=payload)
    else:
        merged = fusion.merge_hits(ranks.select("query_id", "id", "source", "rank", F.col("list_name").alias("payload")), 1 << 30)
        fused = merged.select("query_id", "id", F.lit(None).cast("double").alias("score"), "rank")
    full = fused.join(distance, ["query_id", "id"]).join(light.select("id", "canon_id", "text"), "id").join(queries.select("query_id", F.col("original").alias("query"), F.col("rerank_top").alias("_top")), "query_id")
    if rrf and reranked:
        full = fusion.rerank(full, F.col("_top"), scorer)
    return full.where(F.col("rank") <= F.col("_top")).select("query_id", "id", "canon_id", "text", "score", "distance", "rank")


def prompts(questions: DataFrame, intro: dict[str, str] | None = None) -> Column:
    """The prompt of each question: its context under the introduction of its class (D, or any other), or a conservative one."""
    words = lexicon.PROMPTS if intro is None else intro
    head = F.when(F.col("query_type") == "D", words["open"]).otherwise(words["scoped"])
    return F.when(F.col("context").isNotNull(), F.concat(head, F.lit("\n\n"), "context", F.lit("\n\n"), "question")).otherwise(F.concat(F.lit(words["empty"]), F.lit("\n\n"), "question"))


def answer_questions(
    questions: DataFrame, chunks: DataFrame, fn: Callable[[str], str], encoder: Callable | None = None, dim: int = 2048, k: int = 8, wait: float = 2.0,
    cache: DataFrame | None = None, now: Column | None = None, link: str = "{id}", audit: Callable[[str], str] | None = None, audit_flag: str = "off", level: str = "H2", scorer=None, with_temperature: bool = False, **plan,
) -> DataFrame:
    """One row per question: query_id, query_type, status, source, context, answer, answer_error, preview, links, top_chunks, query, vector, profile, temperature, audit, blocked.

    Prepare, plan, embed; take chunks from the cache where it has the question, else retrieve by plan;
    order by distance, collect links, put the first k into the prompt of the question's class, infer.
    status: pg_hit, pg_empty without hits, pg_miss (with the encoder's message, if it failed) where the
    question could not be embedded; the last two get the conservative prompt. The question's profile sets
    the temperature of its answer, which `fn` gets as a second argument `with_temperature`. `audit` judges answers where `audit_flag` says so, and never breaks the
    flow. Append `state.cache_rows` of the result to the cache.
    """
    planned = queryprep.plan_queries(queryprep.preprocess(questions, terms=plan.get("terms"), aliases=plan.get("aliases")), **plan)
    embedded = infer.embed(planned, "embed_text", "query", dim, encoder, errors="embed_error").withColumnRenamed("embedding", "vector")
    profile = text.expert_profile(F.col("question"))
    ready = stored(embedded.withColumn("profile", profile).withColumn("temperature", text.profile_temperature(profile)), "questions")
    asked = ready.where(F.col("vector").isNotNull())
    if cache is not None:
        looked = state.cache_lookup(asked.select("query_id", F.col("normalized").alias("query"), "vector"), cache, F.current_timestamp() if now is None else now)
        looked = stored(looked.select("query_id", "source", "top_chunks"), "cached")
        asked = asked.join(looked.where("source = 'fresh'").select("query_id"), "query_id", "left_semi")
    coords = chunks.select("id", F.col("coord_start").alias("coord"))
    columns = ["query_id", "id", "canon_id", "coord", "text", "distance", "rank"]
    hits = hybrid_search(asked, chunks, scorer=scorer).join(coords, "id").select(*columns)
    if cache is not None:
        ids = looked.where("source = 'cache'").select("query_id", F.posexplode("top_chunks").alias("_at", "id")).select("query_id", F.col("id").cast("long").alias("id"), (F.col("_at") + 1).alias("rank"))
        again = ids.join(chunks.select("id", "canon_id", F.col("coord_start").alias("coord"), "text"), "id").withColumn("distance", F.lit(None).cast("double"))
        hits = hits.unionByName(again.select(*columns))
    hits = stored(fusion.order_by_distance(hits), "hits")
    top = hits.where(F.col("rank") <= k)
    listed = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "distance", F.substring("text", 1, 500).alias("preview")))).alias("preview"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("top_chunks"))
    found = fusion.similar_links(hits.withColumn("metadata", F.create_map(F.lit("canon_id"), "canon_id")), link)
    links = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "link_id", "url"))).alias("links"))
    full = ready.select("query_id", "question", "query_type", F.col("normalized").alias("query"), "vector", "profile", "temperature", "embed_error").join(fusion.assemble_context(top), "query_id", "left").join(listed, "query_id", "left").join(links, "query_id", "left")
    full = full.join(looked.select("query_id", "source"), "query_id", "left") if cache is not None else full.withColumn("source", F.lit("fresh"))
    missed = F.concat_ws(":", F.lit("pg_miss"), F.substring("embed_error", 1, 200))
    status = F.when(F.col("vector").isNull(), missed).when(F.col("context").isNull(), "pg_empty").otherwise("pg_hit")
    answered = stored(infer.infer(full.withColumn("status", status).withColumn("_p", prompts(full)), "_p", fn, "answer", wait=wait, second="temperature" if with_temperature else None), "answers")
    judged = infer.optional_audit(answered, tasks.audits_answer(F.lit(audit_flag), F.coalesce(F.size("top_chunks"), F.lit(0))), F.lit(level), audit, "question", "answer", wait=wait)
    return judged.select("query_id", "query_type", "status", F.coalesce("source", F.lit("fresh")).alias("source"), "context", "answer", "answer_error", "preview", "links", "top_chunks", "query", "vector", "profile", "temperature", "audit", "blocked")
