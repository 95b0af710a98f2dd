"""Registered queries of reranking, payloads, caches, requests, responses and ingest bookkeeping, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestar.functions import tasks, text
from lodestar.operators import evaluate, fusion, infer, queryprep, reports, search, state
from lodestar.plans import pipeline
from lodestar.plans import queries as base
from lodestar.plans.queries import FILLERS, LINES, NAMES, OPEN_BOOSTS, _chunk_texts, _files, _hits, _rank_lists, _read
from lodestar.session import shared_folder, stored, unique_name
from lodestar.sources import corpus
from lodestar.streaming import ingest

CHANNELS = ("web", "internal", "api", "telegram")
FLAGS = ("off", "always", "specialist", "auto", "", "hits")


def _pick(values, at):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def reranked(spark, sf):
    """The five best of each question's token hits by shared tokens."""
    hits = _hits(spark, sf).drop("score")
    asked = _read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    full = hits.join(_chunk_texts(spark, sf).select("id", "text"), "id").join(asked, "query_id")
    return fusion.rerank(full, 5).select("query_id", "id", "rank", "fused_rank", F.round("rerank_score", 9).alias("score"))


def distance_order(spark, sf):
    """Lists of twenty documents in order of a distance that every third one lacks."""
    rows = _read(spark, sf, "documents").select(F.floor(F.col("doc_id") / 20).alias("query_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("rank"), F.when(F.col("doc_id") % 3 != 0, F.col("n_chars") / 100).alias("distance"))
    return fusion.order_by_distance(rows)


def hit_payloads(spark, sf):
    """Distances after merging token hits (with one) and substring hits (without), both ways."""
    lists = stored(_rank_lists(spark, sf).select("query_id", "id", "source", F.when(F.col("list_name") == "tokens", F.col("rank") / 10).alias("distance")), "rank-lists")
    both = [fusion.hit_payload(lists, keep).withColumn("keeps", F.lit(keep)) for keep in (True, False)]
    return both[0].unionByName(both[1])


def citation_report(spark, sf):
    """Citations in sentences built around every line's coordinate."""
    found = corpus.segments_of(_files(spark, sf)).withColumn("canon_id", text.canon_id_from_coord(F.col("coord")))
    ranges = found.groupBy("canon_id").agg(F.min("coord").alias("coord_start"), F.max(F.when(F.col("line_no") < 5, F.col("coord"))).alias("coord_end")).where("coord_end is not null")
    answers = found.select(F.concat(F.lit("as said in 【"), "coord", F.lit("】.")).alias("sample_answer"))
    return evaluate.citation_accuracy(answers, ranges).select("citations", F.round("accuracy", 6).alias("accuracy"))


def cache_hits(spark, sf):
    """User turns against a cache filled by the even conversations: text, age, vector and chunks decide."""
    turns = _read(spark, sf, "conversations").where("role = 'user'").join(_read(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector")), F.col("conv_id") % _read(spark, sf, "embeddings").count() == F.col("vec_id"))
    begin = F.lit("2024-01-01 00:00:00").cast("timestamp")
    created = F.timestamp_seconds(F.unix_timestamp(begin) + F.col("conv_id") * 3600 + F.col("turn"))
    chunks = F.slice(F.split("text", " "), 1, (F.col("conv_id") % 5 + 1).cast("int"))
    cache = turns.where("conv_id % 2 = 0").select(text.cache_key(F.col("text"), "v1").alias("query_hash"), F.col("vector").alias("query_embed"), chunks.alias("top_chunks"), F.col("text").alias("answer"), created.alias("created_at"))
    found = state.cache_lookup(turns.withColumnRenamed("text", "query"), cache, begin + F.expr("interval 8 days"))
    return found.select("conv_id", "turn", "source", F.when(F.col("source") == "cache", F.size("top_chunks")).alias("n_chunks"))


def progress_view(spark, sf):
    """Ingest progress of every customer as a file, from an event log."""
    log = _read(spark, sf, "events").select(F.concat(F.lit("f"), "user_id").alias("file_path"), F.col("event_type").alias("last_coord"), F.col("value").cast("int").alias("chunk_count"), (F.col("event_id") % 2 == 0).alias("completed"), F.struct("ts", "event_id").alias("updated_at"))
    return state.load_progress(_read(spark, sf, "customer").select(F.concat(F.lit("f"), "c_custkey").alias("file_path")), log)


def ingest_eta(spark, sf):
    docs = _read(spark, sf, "documents")
    rates = docs.select((F.col("n_chars") / 4).alias("rate"))
    progress = docs.select((F.col("doc_id") % 3 != 0).alias("completed"), F.col("n_chars").alias("chunk_count"))
    return reports.ingest_report(rates, progress, 1_000_000).select("files", "completed_files", "completed_chunks", "min_rate", "max_rate", F.round("avg_rate", 6).alias("avg_rate"), F.round("eta_hours", 6).alias("eta_hours"))


def _vector_chunks(spark, sf):
    return _read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("series"), "embedding")


def reembed_batch(spark, sf):
    """The first fifty chunks of one series after an id: a range of re-embedding."""
    return corpus.fetch_batch(_vector_chunks(spark, sf), "1", 100, 50).select("id", "series")


def reembedded(spark, sf):
    """Chunks of which every third got a new (reversed) vector, and where the next range starts."""
    chunks = _vector_chunks(spark, sf)
    new = chunks.where("id % 3 = 0").withColumn("embedding", F.reverse("embedding"))
    done = corpus.update_embeddings(chunks, new, shared_folder(spark))
    return done.select("id", "series", F.round(F.col("embedding")[0].cast("double"), 6).alias("first")).crossJoin(F.broadcast(corpus.reembed_checkpoint(new)))


def audit_rules(spark, sf):
    """Audit levels and gates of every turn under a policy."""
    flag, channel, hits = _pick(FLAGS, F.col("conv_id") % 6), _pick(CHANNELS, F.col("turn") % 4), F.length("text") % 2
    rows = _read(spark, sf, "conversations").select(
        channel.alias("channel"), flag.alias("flag"), tasks.audit_level(channel, {"web": "H0", "api": "H1"}, F.lit("h1"), True).alias("level"),
        tasks.audits_translation(flag, F.col("turn") % 3 == 0).alias("translation"), tasks.audits_answer(flag, hits).alias("answer"),
    )
    return rows.groupBy("channel", "flag", "level", "translation", "answer").agg(F.count("*").alias("n"))


def audit_records(spark, sf):
    """Audit answers of four shapes: fenced and whole, without a key, no JSON, approved by a word."""
    full = lambda ok, issues: F.to_json(F.struct(F.col("text").alias("original"), F.upper("role").alias("translation"), ok.alias("approved"), issues.alias("issues")))
    short = F.to_json(F.struct(F.col("text").alias("original"), F.lit(True).alias("approved")))
    kind = F.col("turn") % 4
    raw = F.when(kind == 0, F.concat(F.lit("```json\n"), full(F.lit(False), F.array("role", "role")), F.lit("\n```"))).when(kind == 1, short).when(kind == 2, F.lit("no json")).otherwise(full(F.lit("yes"), F.array().cast("array<string>")))
    parsed = _read(spark, sf, "conversations").withColumn("a", tasks.parse_audit(raw))
    return parsed.select("conv_id", "turn", F.col("a.translation").alias("translation"), F.col("a.approved").alias("approved"), F.when(F.col("a.issues").isNotNull(), F.size("a.issues")).alias("n_issues"), F.col("a.error").alias("error"))


def tagged_texts(spark, sf):
    kind = F.col("turn") % 3
    raw = F.when(kind == 0, F.concat(F.lit("so: <translation> "), "text", F.lit("\n</translation> and more"))).when(kind == 1, F.concat(F.lit("<translation>"), "text")).otherwise(F.col("text"))
    return _read(spark, sf, "conversations").withColumn("t", tasks.tagged_translation(raw)).select("conv_id", "turn", F.md5("t.text").alias("md5"), F.col("t.tag_missing").alias("tag_missing"))


def embedding_responses(spark, sf):
    """Service answers with two vectors in reverse order; every third one is too short."""
    v = F.col("embedding").cast("array<double>")
    second = F.when(F.col("vec_id") % 3 == 2, F.slice(v, 1, 8)).otherwise(F.reverse(v))
    raw = F.to_json(F.array(F.struct(F.lit(1).alias("index"), v.alias("embedding")), F.struct(F.lit(0).alias("index"), second.alias("embedding"))))
    parsed = _read(spark, sf, "embeddings").withColumn("p", tasks.parse_embeddings(raw, 32))
    return parsed.select("vec_id", F.col("p.error").alias("error"), F.size("p.vectors"[0:9]).alias("n"), F.round(F.col("p.vectors")[0][0], 6).alias("first"), F.when(F.col("p.vectors").isNotNull(), F.size(F.col("p.vectors")[0])).alias("dim"))


def flat_hits(spark, sf):
    """Lines of every document as parallel arrays of a vector store; every third distance is not a number."""
    lines = F.split("text", "\n")
    distances = F.transform(lines, lambda l, i: F.when(i % 3 == 0, "none").otherwise(i.cast("string")))
    metadata = F.transform(lines, lambda l: F.create_map(F.lit("lang"), F.col("lang")))
    hits = _read(spark, sf, "documents").select("doc_id", F.explode(tasks.flatten_hits(lines, distances, metadata)).alias("h"))
    return hits.groupBy("doc_id").agg(F.count("*").alias("n"), F.count("h.distance").alias("n_distances"), F.sum("h.distance").alias("total"), F.min(F.col("h.metadata")["lang"]).alias("lang"))


def image_texts(spark, sf):
    """Turns of a conversation as the pages of a request, every third one damaged, read and merged."""
    page = F.when(F.col("turn") % 3 == 2, "*damaged*").otherwise(F.base64(F.col("text").cast("binary")))
    asked = _read(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", page.alias("p")))), lambda x: x["p"]).alias("images"))
    _, merged = infer.image_text(asked, lambda b: b.decode(), wait=0.0)
    return merged.select("id", F.md5("text").alias("md5"))


def filler_terms(spark, sf):
    """Questions without fillers, and the terms of scoped questions."""
    q = F.col("text")
    return _read(spark, sf, "benchmark").select("item_id", F.md5(queryprep.strip_filler(q, FILLERS)).alias("stripped"), F.array_join(queryprep.expand_scoped_terms(q, NAMES, FILLERS), "|").alias("terms"))


def id_rules(spark, sf):
    """Volumes, matches and temperatures of identifiers made of document ids."""
    cid = F.concat(F.lit("T"), F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0"), F.lit("n"), F.lpad(F.col("doc_id").cast("string"), 5, "0"))
    profile = _pick(("tibetan", "default"), F.col("doc_id") % 2)
    return _read(spark, sf, "documents").select(
        "doc_id", text.volume_number(cid).alias("volume"), text.ids_match(cid, F.concat(cid, F.lit("b"))).alias("longer"), text.ids_match(F.concat(cid, F.lit("b")), cid).alias("shorter"),
        F.round(text.profile_temperature(profile), 4).alias("temperature"), F.round(text.profile_temperature(profile, 0.9), 4).alias("clamped"),
    )


def _dictionary(spark, sf):
    """Each word of at least four characters of a question with the word after it as its alternative."""
    words = F.filter(F.split("text", " "), lambda w: F.length(w) >= 4)
    pairs = F.arrays_zip(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))).alias("term"), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))).alias("alt"))
    return _read(spark, sf, "benchmark").select(F.inline(pairs)).distinct()


def dictionary_terms(spark, sf):
    """Expansion of every turn by a dictionary table: terms bring their alternatives, and those their terms."""
    turns = _read(spark, sf, "conversations").select((F.col("conv_id") * 10000 + F.col("turn")).alias("query_id"), "text")
    return queryprep.expand_terms_by_table(turns, "text", _dictionary(spark, sf), "expanded").select("query_id", F.md5("expanded").alias("md5"))


def question_kinds(spark, sf):
    """Intent of every turn with a phrase of each kind, and short identifiers of three and four digits."""
    said = F.concat("text", _pick(("", "出處", "何經", "原文", "怎麼說"), F.col("turn") % 5))
    digits = F.when(F.col("conv_id") % 2 == 0, F.lpad((F.col("conv_id") % 1000).cast("string"), 3, "0")).otherwise(F.lpad((F.col("conv_id") % 10000).cast("string"), 4, "0"))
    short = F.concat(F.lit("see T"), F.lpad((F.col("turn") % 100).cast("string"), 2, "0"), digits, F.lit(" there"))
    return _read(spark, sf, "conversations").select("conv_id", "turn", queryprep.detect_intent(said).alias("intent"), text.normalize_id(short).alias("id"))


def _planned(spark, sf):
    """Benchmark questions of all classes, with the vector of their number."""
    asked = _read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    planned = queryprep.plan_queries(queryprep.preprocess(asked, terms={}, aliases=NAMES), aliases=NAMES, fillers=FILLERS, boosts=OPEN_BOOSTS)
    return planned.join(_read(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector")), F.col("query_id") % _read(spark, sf, "embeddings").count() == F.col("vec_id"))


def _hybrid_chunks(spark, sf):
    """Documents as chunks of five works in two series; the work's name stands in the text."""
    work = F.concat(F.lit("T01N000"), (F.col("doc_id") % 5).cast("string"))
    docs = _read(spark, sf, "documents").join(_read(spark, sf, "embeddings").select("vec_id", "embedding"), F.col("doc_id") % _read(spark, sf, "embeddings").count() == F.col("vec_id"))
    return docs.select(F.col("doc_id").alias("id"), work.alias("canon_id"), F.when(F.col("doc_id") % 4 == 0, "X").otherwise("T").alias("series"), F.concat(work, F.lit(" "), "text").alias("text"), "embedding")


def hybrid_ranks(spark, sf):
    """Planned questions over all documents: scoped vector, token and substring lists fused, boosted and reranked."""
    found = pipeline.hybrid_search(stored(_planned(spark, sf), "questions"), _hybrid_chunks(spark, sf))
    return found.select("query_id", "id", "rank", F.round("score", 9).alias("score"))


def translations(spark, sf):
    """The translation flow over user turns: memory, routed drafts, polish, and an audit of what a specialist wrote."""
    asked = _read(spark, sf, "conversations").where("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text")

    def judge(both: str) -> str:
        import json

        original, draft = both[: len(both) // 2], both[len(both) // 2 :]
        return json.dumps({"original": original, "translation": draft, "approved": len(both) % 2 == 0, "issues": []}) if len(both) % 3 else "no answer"

    done = infer.translate(asked, base._memory(spark, sf), lambda t: "s:" + t, lambda t: "g:" + t, lambda t: t + ".", base.SPAN, wait=0.0, audit_fn=judge, audit_flag="specialist")
    return done.select("id", "used_specialist", "from_memory", F.md5("polished").alias("md5"), "audit.approved", "audit.bypass", "blocked", "error")


def audited(spark, sf):
    """The audit flow over every turn, on three levels: the auditor approves, answers without JSON, leaves out keys, or fails."""
    rows = _read(spark, sf, "conversations").select("conv_id", "turn", "text", F.length("text").cast("string").alias("draft"))

    def judge(both: str) -> str:
        import json

        kind = int(both.rsplit("\n", 1)[1]) % 4
        if kind == 3:
            raise ValueError("down")
        return "no json" if kind == 2 else json.dumps({"original": "a", "translation": "b", "approved": True} | ({"issues": ["i"]} if kind == 0 else {}))

    judged = infer.audit(rows, _pick(("H0", "H1", "H2"), F.col("turn") % 3), judge, column="draft", wait=0.0)
    out, rejected = infer.split_blocked(judged)
    both = out.withColumn("goes", F.lit("out")).unionByName(rejected.withColumn("goes", F.lit("reject")))
    return both.select("conv_id", "turn", "goes", "audit.approved", F.array_join("audit.issues", "|").alias("issues"), "audit.skipped", "audit.fallback")


def collection_topk(spark, sf):
    """The plain vector query of one named collection."""
    store = _read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("c"), F.col("label")).alias("collection"), "embedding")
    asked = _read(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.query_collection(asked, store, "c1", 8).select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


def evaluation_json(spark, sf):
    """The nested evaluation report as one JSON object."""
    hits = base._golden_hits(spark, sf)
    results = evaluate.miss_reasons(evaluate.hits_at_k(base._golden(spark, sf), hits, 1).withColumn("sub_terms", F.array().cast("array<string>")), hits)
    report = reports.evaluation_report(results, 1)
    return report.select("questions", "k", F.round("recall_all", 6).alias("recall_all"), F.size("misses").alias("misses"), F.round(F.col("by_category")["B"]["recall"], 6).alias("recall_b"), F.col("by_category")["B"]["n"].alias("n_b"))


def expected(spark, sf):
    """Expected identifiers of questions that give a list, one, an empty one or none."""
    kind, one = F.col("item_id") % 4, F.concat(F.lit("T"), F.col("item_id"))
    many = F.when(kind == 0, F.array(one, F.lit("T0"))).when(kind == 1, F.array().cast("array<string>"))
    golden = _read(spark, sf, "benchmark").select("item_id", many.alias("expected_canon_ids"), F.when(kind == 1, one).when(kind == 2, "").alias("expected_canon_id"))
    return evaluate.expected_ids(golden).select("item_id", F.array_join("expected", ",").alias("expected"))


def progress_upserts(spark, sf):
    """Progress rows of the segments of every file, appended to a log of older ones, and the view of it."""
    chunks = corpus.segments_of(_files(spark, sf)).select("file_path", F.col("coord").alias("coord_end"))
    at = F.timestamp_seconds(F.lit(1_700_000_000))
    old = chunks.groupBy("file_path").agg(F.min("coord_end").alias("last_coord")).select("file_path", "last_coord", F.lit(1).alias("chunk_count"), F.lit(False).alias("completed"), F.timestamp_seconds(F.lit(1_600_000_000)).alias("updated_at"))
    path = f"{shared_folder(spark)}/progress-{uuid.uuid4().hex}"
    log = state.upsert(old.limit(0), old, path)
    log = state.upsert(log, state.checkpoint_rows(chunks, at), path)
    return state.latest(log, ["file_path"], ["updated_at"]).select("file_path", "last_coord", "chunk_count", "completed")


def miss_kinds(spark, sf):
    """Reasons of misses that reach every rule: by document, an expected work and hits of each kind."""
    kind = F.col("doc_id") % 6
    found = _pick(("", "", "T05N0001", "T38N0001", "T09N0001", "T09N0001"), kind)
    some = F.when(kind == 5, F.array(F.lit("term"))).otherwise(F.array().cast("array<string>"))
    docs = _read(spark, sf, "documents")
    results = docs.select(F.col("doc_id").alias("id"), F.array(_pick(("T08n0001", "T08n0001", "T05", "T01n0001", "T08n0001", "T08n0001"), kind)).alias("expected"), some.alias("sub_terms"), (F.col("doc_id") % 7 == 0).cast("int").alias("hit"))
    hits = docs.where(kind > 0).select(F.col("doc_id").alias("id"), F.lit(1).alias("rank"), found.alias("canon_id"))
    return evaluate.miss_reasons(results, hits).select("id", "hit", "miss_reason")


def _document_chunks(spark, sf):
    path = F.concat(F.lit("f"), F.floor(F.col("doc_id") / 4).cast("string"))
    return _read(spark, sf, "documents").select(F.col("doc_id").alias("id"), path.alias("file_path"), F.upper("lang").alias("series"), "text", F.array(F.col("n_chars").cast("float")).alias("embedding"))


def chunk_versions(spark, sf):
    """A chunk table of four versions: all files, every third one written anew, every seventh emptied, and new vectors for some chunks."""
    rows, path = _document_chunks(spark, sf), f"{shared_folder(spark)}/{unique_name('chunks')}"
    file = F.substring("file_path", 2, 20).cast("long")
    corpus.write_chunks(rows, path, 0)
    corpus.write_chunks(rows.where(file % 3 == 0).withColumn("text", F.concat(F.lit("new "), "text")), path, 1)
    corpus.delete_files(rows.where(file % 7 == 0).select("file_path").distinct(), path, 2)
    corpus.replace_embeddings(rows.where("id % 11 = 0").select("id", "series", F.array(F.lit(-1.0)).alias("embedding")), path, 3)
    return corpus.read_chunks(spark, path).select("id", "file_path", "series", F.md5("text").alias("md5"), F.col("embedding")[0].cast("double").alias("first"))


def reembedded_ranges(spark, sf):
    """New vectors for the turns of users in ranges of ids, two runs: a bounded one, and one for the rest."""
    turns = _read(spark, sf, "conversations").select((F.col("conv_id") * 10000 + F.col("turn")).alias("id"), F.col("role").alias("series"), "text")
    out, log = (f"{shared_folder(spark)}/{unique_name(n)}" for n in ("vectors", "ranges-log"))
    ingest.reembed(turns, "user", out, log, dim=32, batch=500, limit=100)
    ingest.reembed(turns, "user", out, log, dim=32, batch=500)
    return ingest.read_reembedded(spark, out, log).select("id", "series", F.size("embedding").alias("dim"), F.md5("text").alias("md5"))


def living_users(spark, sf):
    """A stream of events into a keyed cache: the last time of each user within six hours of the newest event."""
    events = stored(_read(spark, sf, "events").select("user_id", "ts"), "events")
    folder = events.inputFiles()[0].rsplit("/", 1)[0]
    out, mark = (f"{shared_folder(spark)}/{unique_name(n)}" for n in ("cache", "cache-state"))
    stream = spark.readStream.schema(events.schema).parquet(folder)
    ingest.latest_within_ttl(stream, ["user_id"], "ts", out, mark, "6 hours").start().awaitTermination()
    return ingest.read_latest(spark, out, ["user_id"]).select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


def resumed_answers(spark, sf):
    """Answers kept by part: the turns of users first, then all turns, whose new ones alone are asked."""
    turns, path = _read(spark, sf, "conversations"), f"{shared_folder(spark)}/{unique_name('kept')}"
    infer.infer_resumable(turns.where("role = 'user'"), "text", lambda t: "a:" + t, path, "answer", parts=8, wait=0.0)
    done = infer.infer_resumable(turns, "text", lambda t: "b:" + t, path, "answer", parts=8, wait=0.0)
    return done.select("conv_id", "turn", F.md5("answer").alias("md5"), F.col("answer_error").alias("error"))


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_PLAIN = "trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))"
_SPACED = "replace(replace(replace(text, 'the ', ' '), 'and ', ' '), 'of ', ' ')"
_CID = "'T' || lpad((doc_id % 100)::VARCHAR, 2, '0') || 'n' || lpad(doc_id::VARCHAR, 5, '0')"

REGISTRY = {
    "reranked": (reranked, f"WITH {base._LISTS}, q AS (SELECT item_id AS query_id, list_distinct({base._TOK}) AS a FROM benchmark), s AS (SELECT query_id, id, rank AS fused_rank, len(list_intersect(a, t)) / len(a)::DOUBLE AS s FROM tk JOIN docs USING (id) JOIN q USING (query_id)) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, fused_rank, id) AS rank, fused_rank, round(s, 9) AS score FROM s QUALIFY rank <= 5"),
    "distance_order": (distance_order, "WITH r AS (SELECT doc_id // 20 AS query_id, doc_id AS id, CASE WHEN doc_id % 3 <> 0 THEN n_chars / 100.0 END::DOUBLE AS distance FROM documents) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY distance NULLS LAST, id) AS rank, distance FROM r"),
    "hit_payloads": (hit_payloads, f"WITH {base._LISTS}, m AS (SELECT query_id, id, max(source) AS source, min(rank / 10.0) FILTER (source = 0) AS d FROM lists GROUP BY query_id, id) SELECT query_id, id, d::DOUBLE AS distance, source, true AS keeps FROM m UNION ALL SELECT query_id, id, CASE WHEN source = 0 THEN d END::DOUBLE, source, false FROM m"),
    "citation_report": (citation_report, f"WITH {LINES}, r AS (SELECT doc_id, min(coord) AS a, max(coord) FILTER (line_no < 5) AS b FROM segments GROUP BY doc_id), c AS (SELECT EXISTS (SELECT 1 FROM r WHERE a <= coord AND b >= coord) AS good FROM segments s) SELECT count(*) AS citations, round(avg(good::INTEGER), 6) AS accuracy FROM c"),
    "cache_hits": (cache_hits, "WITH t AS (SELECT conv_id, turn, text, sha256('v1:' || " + _STRIP.format("text") + ") AS k, embedding::DOUBLE[] AS e FROM conversations JOIN embeddings ON vec_id = conv_id % (SELECT count(*) FROM embeddings) WHERE role = 'user'), c AS (SELECT k, e AS ce, text AS answer, least(len(string_split(text, ' ')), conv_id % 5 + 1) AS m, conv_id * 3600 + turn AS made FROM t WHERE conv_id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY made DESC) = 1), j AS (SELECT conv_id, turn, m, coalesce(made >= 86400 AND list_cosine_similarity(e, ce) >= 0.95 AND m >= 3 AND answer <> '', false) AS ok FROM t LEFT JOIN c USING (k)) SELECT conv_id, turn, CASE WHEN ok THEN 'cache' ELSE 'fresh' END AS source, CASE WHEN ok THEN m END::INTEGER AS n_chunks FROM j"),
    "progress_view": (progress_view, "WITH l AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) SELECT 'f' || c_custkey AS file_path, event_type AS last_coord, coalesce(trunc(value), 0)::INTEGER AS chunk_count, coalesce(event_id % 2 = 0, false) AS completed FROM customer LEFT JOIN l ON user_id = c_custkey"),
    "ingest_eta": (ingest_eta, "WITH a AS (SELECT count(*) AS files, count(*) FILTER (doc_id % 3 <> 0) AS completed_files, (sum(n_chars) FILTER (doc_id % 3 <> 0))::BIGINT AS completed_chunks, min(n_chars / 4.0)::DOUBLE AS min_rate, max(n_chars / 4.0)::DOUBLE AS max_rate, avg(n_chars / 4.0) AS r FROM documents) SELECT files, completed_files, completed_chunks, min_rate, max_rate, round(r, 6) AS avg_rate, round((1000000 - completed_files) * (completed_chunks / completed_files) / r / 3600, 6) AS eta_hours FROM a"),
    "reembed_batch": (reembed_batch, "SELECT vec_id AS id, label::VARCHAR AS series FROM embeddings WHERE label = 1 AND vec_id > 100 ORDER BY vec_id LIMIT 50"),
    "reembedded": (reembedded, "SELECT vec_id AS id, label::VARCHAR AS series, round((CASE WHEN vec_id % 3 = 0 THEN embedding[-1] ELSE embedding[1] END)::DOUBLE, 6) AS first, last_id, updated FROM embeddings, (SELECT max(vec_id) AS last_id, count(*) AS updated FROM embeddings WHERE vec_id % 3 = 0)"),
    "audit_rules": (audit_rules, "WITH r AS (SELECT ['web', 'internal', 'api', 'telegram'][turn % 4 + 1] AS channel, ['off', 'always', 'specialist', 'auto', '', 'hits'][conv_id % 6 + 1] AS flag, turn % 3 = 0 AS special, length(text) % 2 AS hits FROM conversations) SELECT channel, flag, CASE channel WHEN 'web' THEN 'H0' WHEN 'telegram' THEN 'H2' ELSE 'H1' END AS level, CASE flag WHEN 'always' THEN true WHEN 'specialist' THEN special ELSE false END AS translation, CASE WHEN flag = 'always' THEN true WHEN flag IN ('auto', 'hits') THEN hits > 0 ELSE false END AS answer, count(*) AS n FROM r GROUP BY ALL"),
    "audit_records": (audit_records, "SELECT conv_id, turn, CASE WHEN turn % 4 IN (0, 3) THEN upper(role) END AS translation, CASE turn % 4 WHEN 0 THEN false WHEN 3 THEN true END AS approved, CASE turn % 4 WHEN 0 THEN 2 WHEN 3 THEN 0 END AS n_issues, CASE turn % 4 WHEN 1 THEN 'missing_keys' WHEN 2 THEN 'not_json' END AS error FROM conversations"),
    "tagged_texts": (tagged_texts, "SELECT conv_id, turn, md5(CASE WHEN turn % 3 = 2 THEN " + _STRIP.format("split_part(" + _STRIP.format("text") + ", chr(10), 1)") + " ELSE " + _STRIP.format("text") + " END) AS md5, turn % 3 = 2 AS tag_missing FROM conversations"),
    "embedding_responses": (embedding_responses, "SELECT vec_id, CASE WHEN vec_id % 3 = 2 THEN 'too_short' END AS error, CASE WHEN vec_id % 3 <> 2 THEN 2 END AS n, CASE WHEN vec_id % 3 <> 2 THEN round(embedding[-1]::DOUBLE, 6) END AS first, CASE WHEN vec_id % 3 <> 2 THEN 32 END AS dim FROM embeddings"),
    "flat_hits": (flat_hits, "WITH l AS (SELECT doc_id, lang, p[i] AS line, i - 1 AS i FROM (SELECT doc_id, lang, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS p FROM documents))) SELECT doc_id, count(*) AS n, count(*) FILTER (i % 3 <> 0) AS n_distances, (sum(i) FILTER (i % 3 <> 0))::DOUBLE AS total, min(lang) AS lang FROM l WHERE " + _STRIP.format("line") + " <> '' GROUP BY doc_id"),
    "image_texts": (image_texts, "WITH p AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations QUALIFY n <= 16) SELECT conv_id AS id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS md5 FROM p WHERE turn % 3 <> 2 AND text <> '' GROUP BY conv_id"),
    "filler_terms": (filler_terms, "WITH w AS (SELECT item_id, text, list_filter(regexp_split_to_array(" + _STRIP.format(_SPACED) + ", '\\s+'), lambda p: length(p) BETWEEN 2 AND 8) AS parts, list_filter(['tion', 'the', 'er'], lambda a: contains(text, a)) AS named FROM benchmark), j AS (SELECT *, list_concat(named, parts) AS al FROM w), k AS (SELECT *, list_filter(al, lambda v, i: list_position(al, v) = i)[1:5] AS t FROM j) SELECT item_id, md5(trim(replace(replace(replace(regexp_replace(" + _STRIP.format("text") + ", '[？?]+$', ''), 'the ', ''), 'and ', ''), 'of ', ''), '？? 的')) AS stripped, CASE WHEN len(t) > 0 THEN array_to_string(t, '|') ELSE left(text, 8) END AS terms FROM k"),
    "miss_kinds": (miss_kinds, """SELECT doc_id AS id, (doc_id % 7 = 0)::INTEGER AS hit, CASE WHEN doc_id % 7 <> 0 THEN
      ['no_hits', 'empty_canon_ids', 'wrong_volume_same_family', 'wrong_corpus_family', 'semantic_drift', 'bm25_and_vector_miss'][doc_id % 6 + 1] END AS miss_reason FROM documents"""),
    "chunk_versions": (chunk_versions, """SELECT doc_id AS id, 'f' || (doc_id // 4) AS file_path, upper(lang) AS series, md5(CASE WHEN (doc_id // 4) % 3 = 0 THEN 'new ' || text ELSE text END) AS md5,
      CASE WHEN doc_id % 11 = 0 THEN -1 ELSE n_chars::FLOAT END::DOUBLE AS first FROM documents WHERE (doc_id // 4) % 7 <> 0"""),
    "reembedded_ranges": (reembedded_ranges, "SELECT conv_id * 10000 + turn AS id, role AS series, 32 AS dim, md5(text) AS md5 FROM conversations WHERE role = 'user'"),
    "living_users": (living_users, "SELECT user_id, epoch_us(max(ts)) AS at FROM events GROUP BY user_id HAVING max(ts) > (SELECT max(ts) FROM events) - INTERVAL 6 HOUR"),
    "resumed_answers": (resumed_answers, """WITH u AS (SELECT DISTINCT text FROM conversations WHERE role = 'user')
      SELECT conv_id, turn, md5(CASE WHEN u.text IS NOT NULL THEN 'a:' ELSE 'b:' END || c.text) AS md5, NULL::VARCHAR AS error FROM conversations c LEFT JOIN u USING (text)"""),
    "dictionary_terms": (dictionary_terms, """WITH b AS (SELECT list_filter(string_split(text, ' '), lambda w: length(w) >= 4) AS ws FROM benchmark),
      p AS (SELECT DISTINCT ws[i] AS term, ws[i + 1] AS alt FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM b)),
      q AS (SELECT conv_id * 10000 + turn AS query_id, text FROM conversations), e AS (SELECT query_id, alt AS extra FROM q JOIN p ON contains(text, term) UNION SELECT query_id, term FROM q JOIN p ON contains(lower(text), lower(alt))),
      x AS (SELECT query_id, string_agg(extra, ' ' ORDER BY extra) AS extra FROM e GROUP BY query_id) SELECT query_id, md5(concat_ws(' ', text, extra)) AS md5 FROM q LEFT JOIN x USING (query_id)"""),
    "question_kinds": (question_kinds, """SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'doctrine' WHEN 1 THEN 'provenance' WHEN 2 THEN 'provenance' ELSE 'citation' END AS intent,
      'T' || lpad((turn % 100)::VARCHAR, 2, '0') || 'N' || CASE WHEN conv_id % 2 = 0 THEN lpad((conv_id % 1000)::VARCHAR, 3, '0') ELSE lpad((conv_id % 10000)::VARCHAR, 4, '0') END AS id FROM conversations"""),
    "id_rules": (id_rules, "SELECT doc_id, (doc_id % 100)::INTEGER AS volume, true AS longer, false AS shorter, round(CASE WHEN doc_id % 2 = 0 THEN 0.23 ELSE 0.2 END, 4)::DOUBLE AS temperature, 0.45::DOUBLE AS clamped FROM documents"),
    "hybrid_ranks": (hybrid_ranks, f"""WITH {base._PLANS}, qv AS (SELECT plans.*, embedding::DOUBLE[] AS e FROM plans JOIN embeddings ON vec_id = query_id % (SELECT count(*) FROM embeddings)),
      c AS (SELECT doc_id AS id, 'T01N000' || (doc_id % 5) AS canon, 'T01N000' || (doc_id % 5) || ' ' || d.text AS text, embedding::DOUBLE[] AS e FROM documents d JOIN embeddings ON vec_id = doc_id % (SELECT count(*) FROM embeddings) WHERE doc_id % 4 <> 0),
      allc AS (SELECT doc_id AS id, 'T01N000' || (doc_id % 5) || ' ' || text AS text, doc_id % 4 <> 0 AS mine, 'T01N000' || (doc_id % 5) AS canon FROM documents),
      near AS (SELECT query_id, id, canon, ids, n, vec_top, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_distance(qv.e, c.e), id) AS g FROM qv, c QUALIFY g <= 200),
      vec AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY g) AS rank, vec_top FROM near WHERE n = 0 OR list_contains(ids, canon) QUALIFY rank <= vec_top),
      t AS (SELECT id, mine, canon, {base._TOK} AS t FROM allc), st AS (SELECT count(*) AS nn, avg(len(t)) AS a FROM t),
      tf AS (SELECT token, id, mine, canon, s, count(*) AS tf FROM (SELECT id, mine, canon, len(t) AS s, unnest(t) AS token FROM t) GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
      asked AS (SELECT DISTINCT query_id, unnest({base._TOK.replace("text", "normalized")}) AS token FROM plans), need AS (SELECT query_id, count(*) AS need FROM asked GROUP BY query_id),
      sc AS (SELECT query_id, id, canon, round(sum(ln(1 + (nn - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * s / a))), 9) AS score, count(*) AS got FROM asked JOIN tf USING (token) JOIN df USING (token), st WHERE mine GROUP BY query_id, id, canon),
      tok AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, vec_top FROM sc JOIN need USING (query_id) JOIN plans USING (query_id) WHERE got = need AND (n = 0 OR list_contains(ids, canon)) QUALIFY rank <= vec_top),
      tl AS (SELECT query_id, unnest(terms) AS term, CASE WHEN n > 0 THEN ids ELSE boosts END AS scope FROM plans),
      kw AS (SELECT query_id, term, id, row_number() OVER (PARTITION BY query_id, term ORDER BY id) AS rank FROM tl JOIN c ON contains(c.text, term) AND (len(scope) = 0 OR list_contains(scope, canon)) QUALIFY rank <= 10),
      ranks AS (SELECT query_id, id, rank FROM vec UNION ALL SELECT query_id, id, rank FROM tok UNION ALL SELECT query_id, id, rank FROM kw),
      fu AS (SELECT query_id, id, sum(1 / (60.0 + rank)) AS s, count(*) AS k FROM ranks GROUP BY ALL),
      sco AS (SELECT query_id, id, fuse_top, rerank_top, p.text AS asked, c.text AS held, round((s + (2 + len(terms) - k) * (1 / 121.0)) * CASE WHEN list_contains(ids, canon) THEN 1.5 WHEN len(boosts) = 0 THEN 1.0
        WHEN list_position(boosts, canon) = 1 THEN 2.0 WHEN list_position(boosts, canon) = 2 THEN 1.75 WHEN list_position(boosts, canon) > 2 THEN 1.55 ELSE 0.18 END, 12) AS score FROM fu JOIN plans p USING (query_id) JOIN c USING (id)),
      cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS f FROM sco QUALIFY f <= fuse_top),
      lex AS (SELECT *, list_distinct({base._TOK.replace("text", "asked")}) AS qa, {base._TOK.replace("text", "held")} AS qt FROM cut)
      SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY len(list_intersect(qa, qt)) / len(qa)::DOUBLE DESC, f, id) AS rank, round(score, 9) AS score FROM lex QUALIFY rank <= rerank_top"""),
    "translations": (translations, f"""WITH {base._MEM}, u AS (SELECT conv_id || '-' || turn AS id, text, sha256({_STRIP.format("text")}) AS k, {base._SCRIPT} AS glyphs FROM conversations WHERE role = 'user'),
      r AS (SELECT id, text, k, {_STRIP.format("text")} <> '' AS looked, glyphs >= 8 OR (CASE WHEN {_STRIP.format("text")} = '' THEN 0 ELSE glyphs / greatest(length(replace(text, chr(10), '')), 1)::DOUBLE END) >= 0.4 AS special FROM u),
      j AS (SELECT r.*, mem.k IS NOT NULL AND looked AS known, CASE WHEN mem.k IS NOT NULL AND looked THEN mem.polished WHEN special THEN 's:' || text || '.' ELSE 'g:' || text END AS polished FROM r LEFT JOIN mem USING (k)),
      a AS (SELECT *, length(text) + 2 + length(polished) AS m, special AND NOT known AS judged FROM j)
      SELECT id, special AND NOT known AS used_specialist, known AS from_memory, md5(polished) AS md5, CASE WHEN judged THEN m % 3 = 0 OR m % 2 = 0 END AS approved, CASE WHEN judged THEN m % 3 = 0 END AS bypass, false AS blocked, NULL::VARCHAR AS error FROM a"""),
    "audited": (audited, """WITH r AS (SELECT conv_id, turn, turn % 3 AS level, length(text) % 4 AS kind FROM conversations)
      SELECT conv_id, turn, CASE WHEN level = 2 AND kind >= 2 THEN 'reject' ELSE 'out' END AS goes, level = 0 OR kind = 0 AS approved,
      CASE WHEN level = 0 THEN '' WHEN kind = 0 THEN 'i' WHEN kind = 1 THEN 'missing_keys' WHEN kind = 2 THEN 'not_json' ELSE 'error: ValueError: down' END AS issues, level = 0 AS skipped, level > 0 AND kind = 3 AS fallback FROM r"""),
    "collection_topk": (collection_topk, """WITH d AS (SELECT q.vec_id AS query_id, c.vec_id AS id, list_cosine_distance(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS x FROM embeddings q, embeddings c WHERE c.label = 1)
      SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY x, id) AS rank, round(x, 6) AS distance FROM d QUALIFY rank <= 8"""),
    "evaluation_json": (evaluation_json, f"""WITH {base._GOLD}, h AS (SELECT category, (coalesce(best, 99) <= 1)::INTEGER AS hit FROM gold)
      SELECT count(*) AS questions, 1 AS k, round(avg(hit), 6) AS recall_all, (count(*) FILTER (hit = 0))::INTEGER AS misses, round(avg(hit) FILTER (category = 'B'), 6) AS recall_b, count(*) FILTER (category = 'B') AS n_b FROM h"""),
    "expected": (expected, "SELECT item_id, CASE item_id % 4 WHEN 0 THEN 'T' || item_id || ',T0' WHEN 1 THEN 'T' || item_id ELSE '' END AS expected FROM benchmark"),
    "progress_upserts": (progress_upserts, f"WITH {LINES} SELECT file_path, max(coord) AS last_coord, count(*)::INTEGER AS chunk_count, true AS completed FROM segments GROUP BY file_path"),
}
QUERIES = {name: fn for name, (fn, _) in REGISTRY.items()}
ORACLES = {name: sql for name, (_, sql) in REGISTRY.items() if sql}
