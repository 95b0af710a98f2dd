"""Registered queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import tasks, text
from lodestar.operators import chunking, evaluate, fusion, infer, queryprep, reports, search, state, text_index, vector_index
from lodestar.session import shared_folder, stored, unique_name
from lodestar.sources.corpus import segments_of, series_key

SPAN = (0x00C0, 0x017F)
LINK = "https://reader.example.org/{id}_001"
TERMS = {"the": ["with", "from"], "and": ["also", "plus"], "ist": ["sein", "war"], "les": ["des", "aux"]}
FILLERS = ["the ", "and ", "of "]
NAMES = {"the": "T01n0001", "tion": "T01n0002", "er": "T01n0003"}
OPEN_BOOSTS = {"de": ["T01N0004", "T01N0001"], "e": ["T01N0002"]}
BOOSTS = {"the": ["EN", "DE"], "ing": ["EN"], "que": ["FR", "ES"], "der": ["DE"]}


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _raw(lang: Column, doc: Column, line: Column) -> Column:
    return F.concat(F.upper(lang), F.lit("01n"), F.lpad(doc.cast("string"), 7, "0"), F.lit("_p"), F.lpad(line.cast("string"), 5, "0"), F.lit("_##"))


def _files(spark, sf) -> DataFrame:
    """Each document as a corpus file: its lines get coordinates."""
    lines = F.transform(F.split("text", "\n"), lambda l, i: F.concat(_raw(F.col("lang"), F.col("doc_id"), i), F.regexp_replace(l, "\r", "")))
    return _read(spark, sf, "documents").select(F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string")).alias("file_path"), series_key(F.col("lang")).alias("series"), F.array_join(lines, "\n").alias("value"))


LINES = """lines AS (SELECT doc_id, lang, upper(lang[1:2]) AS series, lang || '/' || doc_id AS file_path, i - 1 AS line_no,
  upper(lang) || '01n' || lpad(doc_id::VARCHAR, 7, '0') || '_p' || lpad((i - 1)::VARCHAR, 5, '0') || '_' AS coord,
  regexp_replace(replace(parts[i], chr(13), ''), '^\\s+|\\s+$', '', 'g') AS text
  FROM (SELECT doc_id, lang, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS parts FROM documents))),
segments AS (SELECT * FROM lines WHERE text <> '')"""


def segments(spark, sf):
    return segments_of(_files(spark, sf)).select("file_path", "series", "line_no", "coord", text.canon_id_from_coord(F.col("coord")).alias("canon_id"), "text")


def series_counts(spark, sf):
    return segments_of(_files(spark, sf)).groupBy("series").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


def chunks(spark, sf):
    return chunking.chunk_segments(segments_of(_files(spark, sf)), delimiters=".!?\n")


def resume_filter(spark, sf):
    """Segments after each file's checkpoint: every third document stopped at line 2."""
    found = segments_of(_files(spark, sf)).withColumn("coord_end", F.col("coord"))
    stops = found.where((F.col("line_no") == 2) & (F.pmod(F.split("file_path", "/")[1].cast("long"), F.lit(3)) == 0)).select("file_path", F.col("coord").alias("last_coord"))
    return chunking.chunks_after_resume(found, stops).groupBy("file_path").agg(F.count("*").alias("n"), F.min("coord_end").alias("first_coord"))


def identifiers(spark, sf):
    """Identifier functions over every segment's coordinate and a sentence around it."""
    found = segments_of(_files(spark, sf)).withColumn("cid", text.canon_id_from_coord(F.col("coord")))
    return found.groupBy("cid").agg(F.count("*").alias("n"), F.first("series").alias("series")).withColumn("s", F.concat(F.lit("see "), F.col("cid"), F.lit(" and T010001 x"))).select(
        "cid", "n", text.normalize_id(F.col("s")).alias("normalized"), F.array_join(text.all_ids(F.col("s")), ",").alias("ids"), text.reader_link(F.col("s"), LINK).alias("link"),
        text.id_in_query(F.col("s"), F.col("cid")).alias("named"), text.has_prefix(F.col("cid"), F.array(F.lit("en01"), F.lit("DE01"))).alias("scoped"), text.normalize_id(F.lit("T010001")).alias("short"),
    )


def script_routes(spark, sf):
    """Script counting, language route, profile and greeting filter over every turn."""
    c = F.col("text")
    return _read(spark, sf, "conversations").select("conv_id", "turn", text.glyph_count(c, SPAN).cast("long").alias("glyphs"), F.round(text.glyph_ratio(c, SPAN), 4).alias("ratio"), text.is_specialist(c, SPAN).alias("specialist"), text.is_greeting(c, F.lit("web")).alias("greeting"), text.expert_profile(c, SPAN).alias("profile"))


def query_preparation(spark, sf):
    turns = _read(spark, sf, "conversations").where("role = 'user'")
    q = F.col("text")
    return turns.select("conv_id", "turn", F.length(queryprep.expand_terms(q, TERMS)).alias("expanded_length"), F.array_join(queryprep.boost_prefixes(q, BOOSTS), ",").alias("boosts"), queryprep.detect_intent(q).alias("intent"))


def question_plans(spark, sf):
    """Full preprocessing and planning of every benchmark question, with tables that give all classes."""
    asked = _read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    planned = queryprep.plan_queries(queryprep.preprocess(asked, terms={}, aliases=NAMES), aliases=NAMES, fillers=FILLERS, boosts=OPEN_BOOSTS)
    return planned.select(
        "query_id", "query_type", "intent", "series_hint", "vec_top", "bm25_top", "fuse_top", "rerank_top", F.array_join(F.array_sort("canon_prefixes"), ",").alias("prefixes"),
        F.array_join("boost_prefixes", ",").alias("boosts"), F.array_join("sub_terms", "|").alias("terms"), F.md5("embed_text").alias("embed_md5"),
    )


def _vectors(spark, sf) -> DataFrame:
    return _read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("series"), F.concat(F.lit("L"), F.col("label")).alias("canon_id"), "embedding")


def _vector_queries(spark, sf) -> DataFrame:
    return _read(spark, sf, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("series"), F.array(F.concat(F.lit("L"), F.col("label"))).alias("prefixes"))


def vector_topk(spark, sf):
    return search.vector_search(_vector_queries(spark, sf).select("query_id", "vector"), _vectors(spark, sf), 20).select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


def vector_topk_by_series(spark, sf):
    return search.vector_search(_vector_queries(spark, sf).select("query_id", "vector", "series"), _vectors(spark, sf), 20).select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


def vector_topk_prefix(spark, sf):
    return search.vector_search(_vector_queries(spark, sf).select("query_id", "vector", "prefixes"), _vectors(spark, sf), 20, prefixes=True).select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


def vector_topk_prefilter(spark, sf):
    """The nearest of the chunks whose identifier begins with a prefix of the query, whatever lies nearer."""
    return search.vector_search(_vector_queries(spark, sf).select("query_id", "vector", "prefixes"), _vectors(spark, sf), 20, prefixes=True, mode="prefilter").select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


def vector_lsh(spark, sf):
    """Every vector's nearest found in an index of coarse cells and coded residuals."""
    return vector_index.approximate_vector_search(_vector_queries(spark, sf).select("query_id", "vector"), _vectors(spark, sf), 20).select("query_id", "id", "rank", F.round("distance", 6).alias("distance"))


def _chunk_texts(spark, sf):
    return _read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", F.concat(F.upper("lang"), F.lit("01")).alias("canon_id"))


def _token_queries(spark, sf):
    return _read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_token_tables: dict[tuple, str] = {}


def _token_table(spark, sf) -> str:
    """The token table of the documents, written once for each state of their files.

    A first version has other texts for every third document; a second one replaces those.
    """
    docs = _read(spark, sf, "documents")
    files = docs.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct().collect()
    key = (spark.sparkContext.applicationId, *sorted(map(tuple, files)))
    if key not in _token_tables:
        path, texts, third = f"{shared_folder(spark)}/{unique_name('tokens')}", _chunk_texts(spark, sf), F.col("id") % 3 == 0
        text_index.write_token_table(texts.withColumn("text", F.when(third, F.lit("words of an older version")).otherwise(F.col("text"))), path, 0)
        text_index.write_token_table(texts.where(third), path, 1)
        _token_tables[key] = path
    return _token_tables[key]


def token_topk(spark, sf):
    return text_index.search_tokens(_token_queries(spark, sf), _token_table(spark, sf), 20).select("query_id", "id", "rank", F.round("score", 6).alias("score"))


def _terms(spark, sf):
    """The words of at least five characters of every question, in order."""
    words = F.filter(F.array_distinct(F.split("text", " ")), lambda w: F.length(w) >= 5)
    return _read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.posexplode(words).alias("at", "term"))


def keyword_topk(spark, sf):
    return search.keyword_search(_terms(spark, sf).drop("at"), _chunk_texts(spark, sf), 10)


def gram_topk(spark, sf):
    """The words and first letters of every question in the turns, from a gram table; even questions ask users only."""
    turns = _read(spark, sf, "conversations").select((F.col("conv_id") * 10000 + F.col("turn")).alias("id"), F.col("role").alias("series"), "text")
    path = f"{shared_folder(spark)}/{unique_name('grams')}"
    text_index.write_gram_table(turns.where("id % 2 = 0"), path, 0)
    text_index.write_gram_table(turns.where("id % 2 = 1"), path, 1)
    first = _read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.substring("text", 1, 2).alias("term"))
    terms = _terms(spark, sf).drop("at").union(first).distinct()
    return text_index.search_grams(terms.withColumn("series", F.when(F.col("query_id") % 2 == 0, "user")), path, 10)


def _hits(spark, sf, k=20):
    """Stored: its size is known, so that the joins with all documents do not shuffle their texts."""
    return stored(text_index.search_tokens(_token_queries(spark, sf), _token_table(spark, sf), k, "any"), "hits")


def _rank_lists(spark, sf):
    words = _hits(spark, sf).select("query_id", F.lit(0).alias("source"), F.lit("tokens").alias("list_name"), "id", "rank")
    terms = _terms(spark, sf)
    found = search.keyword_search(terms.drop("at"), _chunk_texts(spark, sf), 10).join(terms, ["query_id", "term"])
    return words.union(found.select("query_id", F.col("at") + 1, F.concat(F.lit("term:"), "term"), "id", "rank"))


def fused_ranks(spark, sf):
    """Reciprocal-rank fusion of token and substring lists, boosted by language prefix."""
    asked, terms = _token_queries(spark, sf), _terms(spark, sf)
    ranks = _rank_lists(spark, sf).join(_chunk_texts(spark, sf).select("id", "canon_id"), "id")
    payload = asked.select("query_id", "query", F.array(F.lit("DE"), F.lit("EN")).alias("boost_prefixes"))
    lists = asked.join(terms.groupBy("query_id").count(), "query_id", "left").select("query_id", (F.coalesce("count", F.lit(0)) + 1).alias("n_lists"))
    return fusion.rrf_fuse(ranks, lists, limit=15, payload=payload).select("query_id", "id", "rank", F.round("score", 9).alias("score"))


def merged_hits(spark, sf):
    return fusion.merge_hits(_rank_lists(spark, sf).withColumnRenamed("list_name", "payload"), 10)


def snippet_merge(spark, sf):
    """Documents in ten buckets as queries: even ids primary, odd ids secondary."""
    rows = _read(spark, sf, "documents").select(F.pmod(F.floor(F.col("doc_id") / 2), F.lit(10)).alias("query_id"), F.col("doc_id").alias("pos"), "text", (F.col("n_chars") / 1000).alias("distance"))
    return fusion.merge_snippets(rows.where("pos % 2 = 0"), rows.where("pos % 2 = 1"), 14).select("query_id", "pos", "bucket", "rank")


def page_links(spark, sf):
    """Distinct identifiers of every page's metadata and text, first five by position: numbers of its url, then made of its words."""
    number = F.regexp_extract("url", r"/(\d+)", 1)
    words = F.regexp_replace("html", r"<p>([A-Za-z])[a-z]*", "<p> $101n0001 ")
    rows = _read(spark, sf, "pages").select(F.col("page_id").alias("query_id"), F.lit(1).alias("rank"), F.create_map(F.lit("id"), F.concat(F.lit("T01n"), F.lpad(number, 6, "0"))).alias("metadata"), words.alias("text"))
    return fusion.similar_links(rows, LINK)


def context_blocks(spark, sf):
    hits = _hits(spark, sf, 5).join(_chunk_texts(spark, sf), "id")
    return fusion.assemble_context(hits.select("query_id", "rank", F.concat(F.lit("c"), F.col("id")).alias("coord"), "canon_id", "text"))


def hit_preview(spark, sf):
    hits = _hits(spark, sf).join(_chunk_texts(spark, sf), "id").withColumn("distance", F.lit(None).cast("double"))
    return fusion.preview(hits, 8).drop("distance")


def seeds(spark, sf):
    return fusion.diffusion_seed(_hits(spark, sf).join(_chunk_texts(spark, sf).select("id", "text"), "id"))


def _golden(spark, sf):
    """Every question with the documents that hold its whole text."""
    asked, docs = _read(spark, sf, "benchmark"), _read(spark, sf, "documents")
    holds = search.containing(asked.select(F.col("text").alias("term")), docs.select(F.col("doc_id").alias("id"), "text")).join(docs.select(F.col("doc_id").alias("id"), "lang"), "id")
    name = F.concat(F.upper("lang"), F.lit("01n"), F.lpad(F.col("id").cast("string"), 7, "0"))
    expected = holds.groupBy("term").agg(F.collect_set(name).alias("expected"))
    category = F.element_at(F.array(*[F.lit(c) for c in "ABCD"]), (F.col("item_id") % 4 + 1).cast("int"))
    return asked.join(expected, F.col("text") == F.col("term"), "left").select(F.col("item_id").alias("id"), category.alias("category"), F.coalesce("expected", F.array().cast("array<string>")).alias("expected"))


def _golden_hits(spark, sf):
    found = _hits(spark, sf, 10).join(_read(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang"), "id")
    return found.select(F.col("query_id"), "rank", F.concat(F.upper("lang"), F.lit("01n"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("canon_id")).withColumnRenamed("query_id", "id")


def recall_report(spark, sf):
    return evaluate.recall_by_category(evaluate.hits_at_k(_golden(spark, sf), _golden_hits(spark, sf), 5))


def recall_sets(spark, sf):
    return evaluate.recall_subsets(evaluate.hits_at_k(_golden(spark, sf), _golden_hits(spark, sf), 5))


def miss_report(spark, sf):
    some = F.when(F.col("id") % 2 == 1, F.array(F.lit("term"))).otherwise(F.array().cast("array<string>"))
    hits = _golden_hits(spark, sf)
    results = evaluate.hits_at_k(_golden(spark, sf), hits, 1).withColumn("sub_terms", some)
    return evaluate.miss_reasons(results, hits).select("id", "hit", "miss_reason")


def citation_ranges(spark, sf):
    """Every line's coordinate, shortened, against ranges of ten lines of each file."""
    found = stored(segments_of(_files(spark, sf)).select(text.canon_id_from_coord(F.col("coord")).alias("canon_id"), "line_no", "coord"), "lines")
    ranges = found.groupBy("canon_id", F.floor(F.col("line_no") / 10).alias("g")).agg(F.min("coord").alias("coord_start"), F.max("coord").alias("coord_end")).where("g % 2 = 0")
    cites = found.select(F.xxhash64("coord").alias("cite_id"), text.citation_coord(F.concat(F.lit(" "), F.col("coord"), F.lit("_"))).alias("coord"))
    return evaluate.citation_exists(cites, ranges, scoped=True).select("coord")


def citation_ranges_unscoped(spark, sf):
    found = stored(segments_of(_files(spark, sf)).select(text.canon_id_from_coord(F.col("coord")).alias("canon_id"), "line_no", "coord"), "lines")
    ranges = found.groupBy("canon_id").agg(F.min("coord").alias("coord_start"), F.max(F.when(F.col("line_no") < 5, F.col("coord"))).alias("coord_end")).where("coord_end is not null")
    cites = found.select(F.xxhash64("coord").alias("cite_id"), "coord")
    return evaluate.citation_exists(cites, ranges).select("coord")


def latest_events(spark, sf):
    log = _read(spark, sf, "events").select("user_id", "event_id", "ts", "event_type", "value")
    return state.latest(log, ["user_id"], ["ts", "event_id"])


def purge_report(spark, sf):
    cache = _read(spark, sf, "events").select("event_id", F.col("ts").alias("created_at"))
    top = cache.agg(F.max("created_at").alias("now"))
    stays, gone = state.purge_expired(cache.crossJoin(F.broadcast(top)), F.col("now"))
    return stays.agg(F.count("*").alias("kept")).crossJoin(gone)


def _memory(spark, sf):
    turns = _read(spark, sf, "conversations")
    replies = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("polished"))
    return turns.where("role = 'user'").join(replies, ["conv_id", "turn"]).where("conv_id % 2 = 0").select(text.cache_key(F.col("text")).alias("source_key"), F.col("polished").alias("draft"), "polished", F.lit(False).alias("used_specialist"), F.struct(F.col("conv_id"), F.col("turn")).alias("created_at"))


def memory_hits(spark, sf):
    asked = _read(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    hits, rest = state.memory_lookup(asked, _memory(spark, sf))
    return hits.select("conv_id", "turn", F.lit(True).alias("hit"), F.length("polished").alias("n")).unionByName(rest.select("conv_id", "turn", F.lit(False).alias("hit"), F.lit(None).cast("int").alias("n")))


def event_props(spark, sf):
    """JSON parsing: keys of every event's properties."""
    return _read(spark, sf, "events").select(F.explode(F.map_keys(F.from_json("props", "map<string,string>"))).alias("key")).groupBy("key").agg(F.count("*").alias("n"))


def request_routes(spark, sf):
    modes = F.array(*[F.lit(m) for m in ("chat", "translate", "ocr", "nonsense")])
    rows = _read(spark, sf, "conversations").select("conv_id", "turn", F.element_at(modes, (F.col("turn") % 4 + 1).cast("int")).alias("mode"), "text")
    reason = tasks.reject_reason(F.col("mode"), F.col("text"), F.array().cast("array<string>"), F.lit(""), ("chat",))
    return rows.select("mode", reason.alias("reason")).groupBy("mode", "reason").agg(F.count("*").alias("n"))


def log_rates(spark, sf):
    lines = _read(spark, sf, "documents").select(F.concat(F.lit("ingested "), F.col("n_chars"), F.lit(" chunks from f"), F.col("doc_id"), F.lit(" in 2.5s ("), F.round(F.col("n_chars") / 2.5, 1), F.lit(" chunks/s, total 9)")).alias("value"))
    return reports.parse_log_rates(lines).agg(F.count("*").alias("n"), F.sum("chunks").alias("chunks"), F.round(F.avg("rate"), 4).alias("avg_rate"))


def grep_lines(spark, sf):
    return reports.corpus_grep(segments_of(_files(spark, sf)), "[0-9]{3}", None).select("file_path", "line_no", "coord")


def hashed_embeddings(spark, sf):
    """Token-hash embeddings of every document: rows and norms."""
    rows = infer.embed(_read(spark, sf, "documents").select("doc_id", "text"), dim=256)
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return rows.select("doc_id", F.size("embedding").alias("dim"), F.round(norm, 4).alias("norm"))


# The chunker as a recursion over the lines of each file: held is what is being merged, e* what a line lets go.
_FOLD = """seg AS (SELECT file_path, coord, text, row_number() OVER (PARTITION BY file_path ORDER BY line_no) AS i FROM segments),
fold AS (
  SELECT file_path, i, coord AS first, coord AS last, text AS held, NULL::VARCHAR AS ef, NULL::VARCHAR AS el, NULL::VARCHAR AS et FROM seg WHERE i = 1
  UNION ALL
  SELECT file_path, i, CASE WHEN does IN ('start', 'cut') THEN coord WHEN does = 'merge' THEN first END, CASE WHEN does IN ('start', 'cut', 'merge') THEN coord END,
    CASE WHEN does IN ('start', 'cut') THEN text WHEN does = 'merge' THEN held || text END,
    CASE WHEN does IN ('done', 'cut', 'over') THEN first END, CASE WHEN does = 'cut' THEN last WHEN does IN ('done', 'over') THEN coord END,
    CASE WHEN does = 'cut' THEN held WHEN does IN ('done', 'over') THEN held || text END
  FROM (SELECT f.*, s.i AS j, coord, text, CASE WHEN held IS NULL THEN 'start' WHEN length(held) + length(text) <= 600 THEN CASE WHEN length(held) + length(text) >= 120 THEN 'done' ELSE 'merge' END
    WHEN length(held) >= 120 THEN 'cut' ELSE 'over' END AS does FROM fold f JOIN seg s ON s.file_path = f.file_path AND s.i = f.i + 1) AS step(file_path, i0, first, last, held, ef, el, et, i, coord, text, does)),
let AS (SELECT file_path, row_number() OVER (PARTITION BY file_path ORDER BY i) - 1 AS chunk_no, ef AS first, el AS last, et AS text FROM fold WHERE et IS NOT NULL),
tail AS (SELECT f.file_path, f.first, f.last, f.held FROM fold f JOIN (SELECT file_path, max(i) AS i FROM fold GROUP BY file_path) m ON f.file_path = m.file_path AND f.i = m.i WHERE f.held IS NOT NULL),
sents AS (SELECT *, regexp_extract_all(text, '[^.!?\\n]*[.!?\\n]|[^.!?\\n]+$') AS s FROM (SELECT file_path, chunk_no, first, last, text FROM let)),
packed AS (SELECT file_path, chunk_no, first, last, CASE WHEN length(text) <= 600 THEN [text] WHEN len(s) < 2 THEN list_transform(range(0, length(text), 540), lambda k: text[k + 1 : k + 600])
  ELSE string_split(list_reduce(s, lambda acc, x: CASE WHEN length(string_split(acc, chr(1))[-1]) + length(x) <= 600 THEN acc || x ELSE acc || chr(1) || x END), chr(1)) END AS p FROM sents),
pieces AS (SELECT file_path, chunk_no, k - 1 AS piece_no, first, last, p[k] AS text FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM packed)),
ends AS (SELECT file_path, max(chunk_no * 100000 + piece_no) AS at, count(DISTINCT chunk_no) AS n FROM pieces GROUP BY file_path),
joined AS (SELECT t.file_path, t.first, t.last, t.held, p.chunk_no, p.piece_no FROM tail t LEFT JOIN ends e USING (file_path) LEFT JOIN pieces p ON p.file_path = t.file_path AND p.chunk_no * 100000 + p.piece_no = e.at
  AND length(t.held) < 120 AND length(p.text) + length(t.held) <= 600),
more AS (SELECT j.file_path, coalesce(e.n, 0) AS chunk_no, j.first, j.last, j.held, CASE WHEN length(held) <= 600 THEN [held] WHEN len(s) < 2 THEN list_transform(range(0, length(held), 540), lambda k: held[k + 1 : k + 600])
  ELSE string_split(list_reduce(s, lambda acc, x: CASE WHEN length(string_split(acc, chr(1))[-1]) + length(x) <= 600 THEN acc || x ELSE acc || chr(1) || x END), chr(1)) END AS p
  FROM (SELECT *, regexp_extract_all(held, '[^.!?\\n]*[.!?\\n]|[^.!?\\n]+$') AS s FROM joined WHERE chunk_no IS NULL) j LEFT JOIN ends e USING (file_path)),
every AS (SELECT p.file_path, p.chunk_no, p.piece_no, p.first, coalesce(j.last, p.last) AS last, p.text || coalesce(j.held, '') AS text FROM pieces p LEFT JOIN joined j ON j.file_path = p.file_path AND j.chunk_no = p.chunk_no AND j.piece_no = p.piece_no
  UNION ALL SELECT file_path, chunk_no, k - 1, first, last, p[k] FROM (SELECT *, unnest(range(1, len(p) + 1)) AS k FROM more)),
final AS (SELECT file_path, chunk_no::INTEGER AS chunk_no, piece_no::INTEGER AS piece_no, upper(split_part(first, '_', 1)) AS canon_id, first AS coord_start, last AS coord_end, text, length(text)::INTEGER AS char_len FROM every)"""
_Q20 = "SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings"
_DIST = f"d AS (SELECT q.vec_id AS query_id, c.vec_id AS id, q.label AS ql, c.label AS cl, list_cosine_distance(q.e, c.e) AS x FROM ({_Q20}) q, ({_Q20}) c)"
_TOK = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
_BM = f"""docs AS (SELECT doc_id AS id, {_TOK} AS t FROM documents), stats AS (SELECT count(*) AS n, avg(len(t)) AS a FROM docs),
p AS (SELECT id, len(t) AS s, unnest(t) AS token FROM docs), tf AS (SELECT token, id, s, count(*) AS tf FROM p GROUP BY ALL),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token), asked AS (SELECT DISTINCT item_id AS query_id, unnest({_TOK}) AS token FROM benchmark),
need AS (SELECT query_id, count(*) AS need FROM asked GROUP BY query_id),
sc AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * s / a))), 9) AS score, count(*) AS got FROM asked JOIN tf USING (token) JOIN df USING (token), stats GROUP BY query_id, id)"""
_WORDS = "list_filter(string_split(text, ' '), lambda w, i: list_position(string_split(text, ' '), w) = i AND length(w) >= 5)"
_KW = f"""words AS (SELECT item_id AS query_id, {_WORDS} AS ws FROM benchmark),
terms AS (SELECT query_id, ws[i] AS term, i AS source FROM (SELECT query_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM words)),
kw AS (SELECT query_id, term, terms.source, doc_id AS id, row_number() OVER (PARTITION BY query_id, term ORDER BY doc_id) AS rank
  FROM documents d JOIN terms ON contains(d.text, term) QUALIFY rank <= 10)"""
_TK = f"{_BM}, tk AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= 20)"
_LISTS = f"""{_TK}, {_KW}, lists AS (SELECT query_id, 0 AS source, 'tokens' AS payload, id, rank FROM tk
  UNION ALL SELECT query_id, source, 'term:' || term, id, rank FROM kw)"""
_GOLD = f"""{_TK}, holds AS (SELECT item_id, upper(lang) || '01n' || lpad(doc_id::VARCHAR, 7, '0') AS cid FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
hits AS (SELECT query_id AS id, rank, upper(lang) || '01N' || lpad(doc_id::VARCHAR, 7, '0') AS cid FROM tk JOIN documents ON doc_id = id WHERE rank <= 10),
good AS (SELECT item_id, min(rank) AS best FROM holds JOIN hits ON hits.id = item_id AND hits.cid = upper(holds.cid) GROUP BY item_id),
gold AS (SELECT item_id AS id, ['A','B','C','D'][item_id % 4 + 1] AS category, best FROM benchmark LEFT JOIN good USING (item_id))"""
# Classes of questions under NAMES: an alias inside a longer one that was taken does not count.
_PLANS = """named AS (SELECT item_id AS query_id, text, contains(text, 'tion') AS has_tion, contains(text, 'the') AS has_the,
  contains(replace(replace(text, 'tion', '#'), 'the', '#'), 'er') AS has_er FROM benchmark),
spots AS (SELECT *, list_filter([CASE WHEN has_tion THEN 'T01N0002' END, CASE WHEN has_the THEN 'T01N0001' END, CASE WHEN has_er THEN 'T01N0003' END], lambda x: x IS NOT NULL) AS ids FROM named),
parted AS (SELECT *, len(ids) AS n, text || array_to_string(list_transform(ids, lambda x: ' ' || replace(x, 'N', 'n')), '') AS normalized,
  list_concat(list_filter(['tion', 'the', 'er'], lambda a: contains(text, a)), list_filter(regexp_split_to_array(regexp_replace(replace(replace(replace(text, 'the ', ' '), 'and ', ' '), 'of ', ' '), '^\\s+|\\s+$', '', 'g'), '\\s+'), lambda p: length(p) BETWEEN 2 AND 8)) AS scoped FROM spots),
plans AS (SELECT *, CASE WHEN n = 0 THEN 40 ELSE 20 END AS vec_top, CASE WHEN n = 0 THEN 50 ELSE 30 END AS fuse_top, CASE WHEN n = 0 THEN 10 ELSE 5 END AS rerank_top,
  CASE WHEN n > 0 THEN [] WHEN contains(text, 'de') THEN ['T01N0004', 'T01N0001', 'T01N0002'] WHEN contains(text, 'e') THEN ['T01N0002'] ELSE [] END AS boosts,
  CASE WHEN n = 0 THEN [trim(regexp_replace(text, '[？?]+$', ''), '？? 的')] WHEN len(scoped) > 0 THEN list_filter(scoped, lambda v, i: list_position(scoped, v) = i)[1:5] ELSE [left(text, 8)] END AS terms FROM parted)"""
_EXPAND = "list_distinct(flatten([" + ", ".join(f"CASE WHEN contains(text, '{t}') THEN {a} ELSE [] END, CASE WHEN contains(lower(text), '{a[0]}') OR contains(lower(text), '{a[1]}') THEN ['{t}'] ELSE [] END" for t, a in TERMS.items()) + "]))"
_BOOST = "flatten([" + ", ".join(f"CASE WHEN contains(text, '{t}') THEN {BOOSTS[t]} ELSE [] END" for t in sorted(BOOSTS, key=len, reverse=True)) + "])"
_SCRIPT = "len(regexp_extract_all(text, '[\\x{C0}-\\x{17F}]'))"
_USER = "SELECT conv_id, turn, text, sha256(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS k FROM conversations WHERE role = 'user'"
_MEM = f"mem AS (SELECT u.k, a.text AS polished, row_number() OVER (PARTITION BY u.k ORDER BY u.conv_id DESC, u.turn DESC) AS n FROM ({_USER}) u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.conv_id % 2 = 0 QUALIFY n = 1)"

REGISTRY = {
    "segments": (segments, f"WITH {LINES} SELECT file_path, series, line_no, coord, upper(split_part(coord, '_', 1)) AS canon_id, text FROM segments"),
    "series_counts": (series_counts, f"WITH {LINES} SELECT series, count(*) AS n, sum(length(text))::BIGINT AS chars FROM segments GROUP BY series"),
    "chunks": (chunks, f"WITH RECURSIVE {LINES}, {_FOLD} SELECT * FROM final"),
    "resume_filter": (resume_filter, f"WITH {LINES}, s AS (SELECT file_path, coord AS last FROM segments WHERE line_no = 2 AND doc_id % 3 = 0) SELECT file_path, count(*) AS n, min(coord) AS first_coord FROM segments LEFT JOIN s USING (file_path) WHERE last IS NULL OR coord > last GROUP BY file_path"),
    "identifiers": (identifiers, f"WITH {LINES}, c AS (SELECT upper(split_part(coord, '_', 1)) AS cid, count(*) AS n FROM segments GROUP BY 1) SELECT cid, n, cid AS normalized, cid AS ids, 'https://reader.example.org/' || cid || '_001' AS link, true AS named, starts_with(cid, 'EN01') OR starts_with(cid, 'DE01') AS scoped, 'T01N0001' AS short FROM c"),
    "script_routes": (script_routes, f"WITH g AS (SELECT conv_id, turn, text, {_SCRIPT} AS glyphs, CASE WHEN trim(text) = '' THEN 0.0 ELSE {_SCRIPT} / greatest(length(replace(text, chr(10), '')), 1)::DOUBLE END AS r FROM conversations) SELECT conv_id, turn, glyphs, round(r, 4) AS ratio, glyphs >= 8 OR r >= 0.4 AS specialist, regexp_matches(text, '(?i)^\\s*(hi|hello|hey)\\s*[!?.~]*\\s*$') AS greeting, CASE WHEN glyphs >= 4 THEN 'tibetan' WHEN regexp_matches(text, '(?i)pali|pāli|tipiṭaka') THEN 'pali_source' WHEN regexp_matches(text, '(?i)sanskrit') THEN 'sanskrit_lexicon' ELSE 'default' END AS profile FROM g"),
    "query_preparation": (query_preparation, f"WITH e AS (SELECT conv_id, turn, text, {_EXPAND} AS x, {_BOOST} AS b FROM conversations WHERE role = 'user') SELECT conv_id, turn, (length(text) + coalesce(list_sum(list_transform(x, lambda t: length(t) + 1)), 0))::INTEGER AS expanded_length, array_to_string(list_filter(b, lambda v, i: list_position(b, v) = i), ',') AS boosts, 'doctrine' AS intent FROM e"),
    "question_plans": (question_plans, f"""WITH {_PLANS} SELECT query_id, CASE n WHEN 0 THEN 'D' WHEN 1 THEN 'A' ELSE 'C' END AS query_type, 'doctrine' AS intent, 'T' AS series_hint, vec_top,
      vec_top AS bm25_top, fuse_top, rerank_top, array_to_string(list_sort(ids), ',') AS prefixes, array_to_string(boosts, ',') AS boosts, array_to_string(terms, '|') AS terms,
      md5(CASE WHEN n = 0 THEN text ELSE normalized END) AS embed_md5 FROM plans"""),
    "vector_topk": (vector_topk, f"WITH {_DIST} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY x, id) AS rank, round(x, 6) AS distance FROM d QUALIFY rank <= 20"),
    "vector_topk_by_series": (vector_topk_by_series, f"WITH {_DIST} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY x, id) AS rank, round(x, 6) AS distance FROM d WHERE ql = cl QUALIFY rank <= 20"),
    "vector_topk_prefilter": (vector_topk_prefilter, f"WITH {_DIST} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY x, id) AS rank, round(x, 6) AS distance FROM d WHERE ql = cl QUALIFY rank <= 20"),
    "gram_topk": (gram_topk, f"""WITH t AS (SELECT DISTINCT item_id AS query_id, unnest(list_append({_WORDS}, text[1:2])) AS term FROM benchmark),
      c AS (SELECT conv_id * 10000 + turn AS id, role, text FROM conversations)
      SELECT query_id, term, id, row_number() OVER (PARTITION BY query_id, term ORDER BY id) AS rank FROM t JOIN c ON contains(text, term) AND (query_id % 2 = 1 OR role = 'user') QUALIFY rank <= 10"""),
    "vector_topk_prefix": (vector_topk_prefix, f"WITH {_DIST}, t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY x, id) AS n FROM d QUALIFY n <= 200) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY x, id) AS rank, round(x, 6) AS distance FROM t WHERE ql = cl QUALIFY rank <= 20"),
    "vector_lsh": (vector_lsh, None),
    "token_topk": (token_topk, f"WITH {_BM} SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, round(score, 6) AS score FROM sc JOIN need USING (query_id) WHERE got = need QUALIFY rank <= 20"),
    "keyword_topk": (keyword_topk, f"WITH {_KW} SELECT query_id, term, id, rank FROM kw"),
    "fused_ranks": (fused_ranks, f"""WITH {_LISTS}, f AS (SELECT query_id, id, sum(1 / (60.0 + rank)) AS s, count(*) AS c FROM lists GROUP BY ALL),
      g AS (SELECT query_id, id, round((s + (1 + len(ws) - c) * (1 / 121.0)) * CASE lang WHEN 'de' THEN 2.0 WHEN 'en' THEN 1.75 ELSE 0.18 END, 12) AS score
        FROM f JOIN documents ON doc_id = id JOIN words USING (query_id))
      SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank, round(score, 9) AS score FROM g QUALIFY rank <= 15"""),
    "merged_hits": (merged_hits, f"WITH {_LISTS}, m AS (SELECT query_id, id, min(source * 1000 + rank) AS f, arg_max(payload, source * 1000 + rank) AS payload FROM lists GROUP BY query_id, id) SELECT query_id, id, payload, row_number() OVER (PARTITION BY query_id ORDER BY f, id) AS rank FROM m QUALIFY rank <= 10"),
    "snippet_merge": (snippet_merge, "WITH r AS (SELECT (doc_id // 2) % 10 AS query_id, doc_id AS pos, doc_id % 2 AS bucket, left(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 320) AS k FROM documents), f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, k ORDER BY bucket, pos) = 1) SELECT query_id, pos, bucket::INTEGER AS bucket, row_number() OVER (PARTITION BY query_id ORDER BY bucket, pos) AS rank FROM f QUALIFY rank <= 14"),
    "page_links": (page_links, f"""WITH t AS (SELECT page_id, url, left(regexp_replace(html, '<p>([A-Za-z])[a-z]*', '<p> \\101n0001 ', 'g'), 4000) AS t FROM pages),
      i AS (SELECT page_id, list_transform(list_concat(CASE WHEN regexp_matches(url, '/\\d+') THEN ['T01n' || lpad(regexp_extract(url, '/(\\d+)', 1), 6, '0')] ELSE ['T01n000000'] END,
        regexp_extract_all(t, '(^|[^\\p{{L}}\\p{{N}}_])([A-Za-z]{{1,3}}\\d+[nN]\\d+[a-zA-Z]?)(?:[^\\p{{L}}\\p{{N}}_]|$)', 2)), lambda x: upper(x)) AS a FROM t),
      d AS (SELECT page_id, list_filter(a, lambda x, k: list_position(a, x) = k)[1:5] AS a FROM i)
      SELECT page_id AS query_id, a[k] AS link_id, 'https://reader.example.org/' || a[k] || '_001' AS url, k::INTEGER AS rank FROM (SELECT page_id, a, unnest(range(1, len(a) + 1)) AS k FROM d)"""),
    "context_blocks": (context_blocks, f"""WITH {_TK} SELECT query_id, string_agg('[片段' || rank || ']【c' || id || '】(' || upper(lang) || '01)' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
      FROM tk JOIN documents ON doc_id = id WHERE rank <= 5 GROUP BY query_id"""),
    "hit_preview": (hit_preview, f"WITH {_TK} SELECT query_id, rank, id, left(text, 500) AS text FROM tk JOIN documents ON doc_id = id WHERE rank <= 8"),
    "seeds": (seeds, f"""WITH {_TK}, two AS (SELECT query_id, rank, text FROM tk JOIN documents ON doc_id = id WHERE rank <= 4 AND regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 2)
      SELECT query_id, left(string_agg(left(text, 240), chr(10) ORDER BY rank), 480) AS seed FROM two GROUP BY query_id"""),
    "recall_report": (recall_report, f"WITH {_GOLD} SELECT category, count(*) AS n, avg((coalesce(best, 99) <= 5)::INTEGER) AS recall FROM gold GROUP BY category"),
    "recall_sets": (recall_sets, f"WITH {_GOLD}, h AS (SELECT category, (coalesce(best, 99) <= 5)::INTEGER AS hit FROM gold) SELECT avg(hit) AS recall_all, avg(hit) FILTER (category IN ('A', 'B')) AS recall_ab, avg(hit) FILTER (category IN ('A', 'B', 'C')) AS recall_abc FROM h"),
    "miss_report": (miss_report, f"WITH {_GOLD}, n AS (SELECT id, count(*) AS n FROM hits GROUP BY id) SELECT gold.id, (coalesce(best, 99) <= 1)::INTEGER AS hit, CASE WHEN best <= 1 THEN NULL WHEN n IS NULL THEN 'no_hits' WHEN gold.id % 2 = 1 THEN 'bm25_and_vector_miss' ELSE 'semantic_drift' END AS miss_reason FROM gold LEFT JOIN n USING (id)"),
    "citation_ranges": (citation_ranges, f"WITH {LINES}, r AS (SELECT doc_id, line_no // 10 AS g, min(coord) AS a, max(coord) AS b FROM segments GROUP BY ALL) SELECT coord FROM segments s WHERE EXISTS (SELECT 1 FROM r WHERE r.doc_id = s.doc_id AND g % 2 = 0 AND a <= coord AND b >= coord)"),
    "citation_ranges_unscoped": (citation_ranges_unscoped, f"WITH {LINES}, r AS (SELECT doc_id, min(coord) AS a, max(coord) FILTER (line_no < 5) AS b FROM segments GROUP BY doc_id) SELECT coord FROM segments s WHERE EXISTS (SELECT 1 FROM r WHERE a <= coord AND b >= coord)"),
    "latest_events": (latest_events, "SELECT user_id, event_id, ts, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "purge_report": (purge_report, "SELECT count(*) FILTER (ts >= m - INTERVAL 7 DAY) AS kept, count(*) FILTER (ts < m - INTERVAL 7 DAY) AS purged FROM events, (SELECT max(ts) AS m FROM events)"),
    "memory_hits": (memory_hits, f"WITH {_MEM} SELECT conv_id, turn, mem.k IS NOT NULL AND trim(u.text) <> '' AS hit, length(polished)::INTEGER AS n FROM ({_USER}) u LEFT JOIN mem ON mem.k = u.k"),
    "event_props": (event_props, "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY key"),
    "request_routes": (request_routes, "SELECT mode, CASE mode WHEN 'nonsense' THEN 'unknown_mode' WHEN 'chat' THEN 'disabled_mode' ELSE CASE WHEN long THEN 'message_too_long' WHEN mode = 'ocr' THEN 'image_missing' END END AS reason, count(*) AS n FROM (SELECT ['chat', 'translate', 'ocr', 'nonsense'][turn % 4 + 1] AS mode, length(text) > 65536 AS long FROM conversations) GROUP BY ALL"),
    "log_rates": (log_rates, "SELECT count(*) AS n, sum(n_chars)::BIGINT AS chunks, round(avg(round(n_chars / 2.5, 1)), 4) AS avg_rate FROM documents"),
    "grep_lines": (grep_lines, f"WITH {LINES} SELECT file_path, line_no, coord FROM segments WHERE regexp_matches(text, '[0-9]{{3}}')"),
    "hashed_embeddings": (hashed_embeddings, f"SELECT doc_id, 256 AS dim, CASE WHEN len({_TOK}) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents"),
}
QUERIES = {name: fn for name, (fn, _) in REGISTRY.items()}
ORACLES = {name: sql for name, (_, sql) in REGISTRY.items() if sql}
