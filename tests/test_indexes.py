"""Written indexes, sinks, resumable runs and keyed state: against brute force or the plain operator."""

import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import evaluate, infer, queryprep, reports, search, text_index, vector_index
from lodestar.session import running_max
from lodestar.sources import corpus
from lodestar.streaming import ingest

SF = "/root/testdata/sf0.1"


def exact_pairs(vectors, ids, k):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    order = np.argsort(1 - unit @ unit.T, axis=1, kind="stable")[:, :k]
    return {(int(q), int(ids[j])) for q, row in zip(ids, order) for j in row}


def clusters(n, dim=32, seed=0):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((40, dim))[rng.integers(0, 40, n)] * 3 + rng.standard_normal((n, dim)) * 0.5


def vector_frame(spark, vectors):
    return spark.createDataFrame([(i, "AB"[i % 2], f"T{i % 7:02d}n{i:04d}", [float(x) for x in v]) for i, v in enumerate(vectors)], "id long, series string, canon_id string, embedding array<float>")


@pytest.mark.parametrize("source", ["clusters", "embeddings"])
def test_cells_find_nearest_with_few_candidates(spark, tmp_path, source):
    """Recall of at least 0.9, with fewer than a tenth of the rows reranked, on clusters and on evenly spread vectors."""
    if source == "clusters":
        chunks = vector_frame(spark, clusters(3000))
    else:
        chunks = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    rows = sorted(chunks.select("id", "embedding").collect())
    vectors, ids = np.array([r.embedding for r in rows], float), np.array([r.id for r in rows])
    path, asked = str(tmp_path / "index"), chunks.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    model = vector_index.build_vector_index(chunks, path)
    exact = exact_pairs(vectors, ids, 10)
    found = vector_index.search_vector_index(asked, path, 10).collect()
    assert len(exact & {(r.query_id, r.id) for r in found}) >= 0.9 * len(exact)
    assert vector_index.shortlist(asked, path).count() < 0.1 * len(ids) ** 2
    assert model.shortlist >= 10 and (source == "embeddings" or model.probes < len(model.centres) / 2)
    truth = {r.id: v for r, v in zip(rows, vectors)}
    for r in found[:50]:
        a, b = truth[r.query_id], truth[r.id]
        assert abs(r.distance - (1 - a @ b / np.linalg.norm(a) / np.linalg.norm(b))) < 1e-9
    report = vector_index.recall(vector_index.search_vector_index(asked, path, 10), search.vector_search(asked, chunks, 10)).first()
    assert report.pairs == 10 * len(ids) and report.recall >= 0.9


def test_index_paths_agree(spark, tmp_path, monkeypatch):
    """Queries sent to all tasks and queries met by shuffle give the same rows, with and without a series; later rows are found."""
    vectors = clusters(400, 8, 3)
    vectors[7] = 0
    chunks, path = vector_frame(spark, vectors), str(tmp_path / "index")
    vector_index.build_vector_index(chunks.where("id < 300"), path, cells=10)
    vector_index.write_rows(chunks.where("id >= 300"), vector_index.read_model(spark, path), path)
    asked = chunks.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"), F.when(F.col("id") % 2 == 0, F.col("series")).alias("series"))
    one = sorted(tuple(r) for r in vector_index.search_vector_index(asked, path, 7).collect())
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 3)
    monkeypatch.setattr(vector_index, "ROW_BLOCK", 20)
    assert sorted(tuple(r) for r in vector_index.search_vector_index(asked, path, 7).collect()) == one
    assert any(r[1] >= 300 for r in one) and all(r[1] != 7 for r in one) and all(r[0] % 2 or r[1] % 2 == 0 for r in one)
    all_cells = vector_index.search_vector_index(asked, path, 7, probes=10, most=400).select("query_id", "id", "rank")
    assert sorted(map(tuple, all_cells.collect())) == sorted(map(tuple, search.vector_search(asked, chunks.where("id <> 7"), 7).select("query_id", "id", "rank").collect()))
    with pytest.raises(ValueError):
        vector_index.build_vector_index(chunks.where("id = 7"), str(tmp_path / "none"))


def test_prefilter(spark, monkeypatch):
    """Only chunks whose identifier begins with a prefix are ranked, though 200 others lie nearer; one prefix holds the corpus."""
    vectors = clusters(600, 8, 1)
    chunks = vector_frame(spark, vectors)
    asked = spark.createDataFrame([(q, [float(x) for x in vectors[q]], p, s) for q, p, s in [(0, ["t03"], None), (1, ["T"], "A"), (2, [], None), (3, ["T00n", "t06N"], "B"), (4, ["zz"], None)]], "query_id long, vector array<float>, prefixes array<string>, series string")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = []
    for r in asked.collect():
        d = 1 - unit @ (np.array(r.vector) / np.linalg.norm(r.vector))
        ok = [i for i in range(600) if (r.series is None or "AB"[i % 2] == r.series) and (not r.prefixes or f"T{i % 7:02d}N{i:04d}".startswith(tuple(p.upper() for p in r.prefixes)))]
        want += [(r.query_id, i) for i in sorted(ok, key=lambda i: (d[i], i))[:5]]
    run = lambda: sorted((r.query_id, r["rank"], r.id) for r in search.vector_search(asked, chunks, 5, prefixes=True, mode="prefilter").collect())
    first = run()
    assert sorted((q, i) for q, _, i in first) == sorted(want)
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    monkeypatch.setattr(search, "ROW_BLOCK", 50)
    assert run() == first


def texts(n, seed=2):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcd經佛") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def chunk_frame(spark, rows):
    return spark.createDataFrame(rows, "id long, file_path string, series string, canon_id string, text string")


def versions(spark, write, path, n=120):
    """A table of three versions: all files, new texts for some, and one emptied file; and the chunks that count."""
    first, second = texts(n), texts(n, 9)
    row = lambda i, t: (i, f"f{i // 4}", "AB"[i % 2], f"T{i % 3}", t)
    write(chunk_frame(spark, [row(i, t) for i, t in enumerate(first)]), path, 0)
    again = [i for i in range(n) if (i // 4) % 3 == 0]
    write(chunk_frame(spark, [row(i, second[i]) for i in again]), path, 1)
    write(chunk_frame(spark, []), path, 2, spark.createDataFrame([("f5",)], "file_path string"))
    return chunk_frame(spark, [row(i, second[i] if i in again else t) for i, t in enumerate(first) if i // 4 != 5])


def test_token_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "LEAST_BUCKETS", 3)
    monkeypatch.setattr(text_index, "DEALT_CHUNKS", 50)
    path = str(tmp_path / "tokens")
    chunks = versions(spark, text_index.write_token_table, path)
    asked = spark.createDataFrame([(k, t, k % 5 + 1, "A" if k % 2 else None, ["T1"] if k % 3 == 0 else []) for k, t in enumerate([" ".join(t.split()[:2]) for t in texts(40, 2)])], "query_id long, query string, k int, series string, prefixes array<string>")
    for columns in (["query_id", "query"], asked.columns):
        for match in ("all", "any"):
            want = sorted(map(tuple, search.token_search(asked.select(*columns), chunks, 9, match).collect()))
            assert sorted(map(tuple, text_index.search_tokens(asked.select(*columns), path, 9, match).collect())) == want and want
    assert text_index.token_statistics(spark, path)[0] == chunks.count()
    text_index.write_token_table(chunks.where("file_path = 'f0'"), path, 1)  # the version again, with fewer files
    assert text_index.token_statistics(spark, path)[0] == chunks.count()


def test_gram_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "LEAST_BUCKETS", 3)
    monkeypatch.setattr(text_index, "DEALT_CHUNKS", 50)
    path = str(tmp_path / "grams")
    chunks = versions(spark, text_index.write_gram_table, path)
    held = [r.text for r in chunks.where("length(text) > 12").limit(12).collect()]
    terms = [t[a : a + n] for k, t in enumerate(held) for a, n in ((k % 5, 1), (k % 4, 2), (1, 3), (2, 4), (0, 5), (k % 3, 9), (0, 12))] + ["zzz", "經", "佛經", "nowhere at all", "aaaaaaa"]
    asked = spark.createDataFrame([(k, t, "A" if k % 3 == 0 else None, ["T1", "t2"] if k % 4 == 0 else None) for k, t in enumerate(terms)], "query_id long, term string, series string, scope array<string>")
    for columns in (["query_id", "term"], asked.columns):
        want = sorted(map(tuple, search.keyword_search(asked.select(*columns), chunks, 6).collect()))
        assert sorted(map(tuple, text_index.search_grams(asked.select(*columns), path, 6).collect())) == want and want
    rows = chunks.collect()
    brute = {(k, t, r.id) for k, t in enumerate(terms) for r in sorted(rows, key=lambda r: r.id) if t in r.text}
    assert {tuple(r)[:3] for r in text_index.search_grams(asked.select("query_id", "term"), path, 1000).select("query_id", "term", "id").collect()} == brute
    plan = text_index.search_grams(asked.select("query_id", "term"), path, 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # ranks are limited in each task before the shuffle, and again after it


def test_keyword_search_keeps_few_rows(spark):
    """A term in every text leaves k rows a task, whatever the scope; wildcards meet the literal parts only."""
    rows = [(i, f"common word number {i}", "AB"[i % 2], f"T{i % 3}") for i in range(3000)] + [(5000, None, "A", "T1")]
    chunks = spark.createDataFrame(rows, "id long, text string, series string, canon_id string").repartition(4)
    terms = spark.createDataFrame([(1, "common", None, None), (2, "word", "B", ["t1"]), (3, "number 29", None, []), (4, "", None, None)], "query_id long, term string, series string, scope array<string>")
    got = {}
    for r in search.keyword_search(terms, chunks, 5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    assert [i for _, i in sorted(got[1])] == [0, 1, 2, 3, 4] == [i for _, i in sorted(got[4])]
    assert [i for _, i in sorted(got[2])] == [1, 7, 13, 19, 25] and [i for _, i in sorted(got[3])] == [29, 290, 291, 292, 293]
    plan = search.keyword_search(terms, chunks, 5)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    like = spark.createDataFrame([(1, "comm%ber 12"), (2, "w_rd"), (3, "100\\%"), (4, "%")], "query_id long, term string")
    found = {(r.query_id, r.id) for r in search.keyword_search(like, chunks, 5000, like=True).collect()}
    assert found == {(1, i) for i in range(3000) if f"number {i}".startswith("number 12")} | {(q, i) for q in (2, 4) for i in range(3000)}


def test_chunk_table_versions(spark, tmp_path):
    """A version written again, an emptied file and a killed write: only the newest committed rows of each file are read."""
    path = str(tmp_path / "chunks")
    make = lambda files, tag: spark.createDataFrame([(hash((f, n)), f, f[0], f"{tag}{n}", [1.0, 2.0]) for f in files for n in range(3)], "id long, file_path string, series string, text string, embedding array<float>")
    read = lambda: sorted((r.file_path, r.text) for r in corpus.read_chunks(spark, path).collect())
    rows = lambda tag, *files: sorted((f, f"{tag}{n}") for f in files for n in range(3))
    corpus.write_chunks(make(["T/1", "X/1"], "a"), path, 0)
    corpus.write_chunks(make(["T/1"], "a"), path, 0)
    assert read() == rows("a", "T/1")
    corpus.write_chunks(make([], "b"), path, 0, spark.createDataFrame([("T/1",)], "file_path string"))
    assert read() == []
    corpus.write_chunks(make(["T/1", "T/2", "X/1"], "c"), path, 1)
    corpus.write_chunks(make(["T/2"], "d"), path, 2, spark.createDataFrame([("T/2",), ("X/1",)], "file_path string"))
    assert read() == sorted(rows("c", "T/1") + rows("d", "T/2"))
    make(["T/1"], "lost").write.partitionBy("series").parquet(f"{path}/data/version={3:012d}/attempt=killed")  # no manifest
    assert read() == sorted(rows("c", "T/1") + rows("d", "T/2"))
    plan = corpus.read_chunks(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    corpus.delete_files(spark.createDataFrame([("T/1",)], "file_path string"), path, 4)
    assert read() == rows("d", "T/2")
    corpus.compact_chunks(spark, path, str(tmp_path / "compact"))
    assert corpus.read_chunks(spark, str(tmp_path / "compact")).count() == 3


def test_stale_files_in_blocks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "chunks")
    make = lambda files, tag: spark.createDataFrame([(f"T/{f}", "T", tag) for f in files], "file_path string, series string, text string")
    corpus.write_chunks(make(range(40), "a"), path, 0)
    corpus.write_chunks(make(range(0, 40, 2), "b"), path, 1)
    monkeypatch.setattr(corpus, "STALE_BLOCK", 6)
    assert sorted((int(r.file_path[2:]), r.text) for r in corpus.read_chunks(spark, path).collect()) == [(f, "ab"[f % 2 == 0]) for f in range(40)]


def test_replaced_embeddings(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = [(i, f"T/{i // 5}", "T", [0.0, float(i)]) for i in range(30)]
    corpus.write_chunks(spark.createDataFrame(rows, "id long, file_path string, series string, embedding array<float>"), path, 0)
    corpus.replace_embeddings(spark.createDataFrame([(3, "T", [9.0, 9.0]), (11, "T", [8.0, 8.0]), (12, "X", [7.0, 7.0])], "id long, series string, embedding array<double>"), path, 1)
    got = {r.id: r.embedding for r in corpus.read_chunks(spark, path).collect()}
    assert got == {i: [9.0, 9.0] if i == 3 else [8.0, 8.0] if i == 11 else [0.0, float(i)] for i in range(30)}
    assert sorted(r.file_path for r in corpus.read_manifest(spark, path).where("version = 1").collect()) == ["T/0", "T/2"]


def test_reembedding_after_a_killed_run(spark, tmp_path):
    """A run whose encoder dies in some range leaves the others committed; the next one embeds the rest alone."""
    rng = random.Random(1)
    ids = [rng.randint(-(1 << 62), 1 << 62) for _ in range(90)]
    chunks = spark.createDataFrame([(i, "T" if k % 3 else "X", f"text {k}", [0.0]) for k, i in enumerate(ids)], "id long, series string, text string, embedding array<float>").repartition(5)
    out, log, calls = str(tmp_path / "out"), str(tmp_path / "log"), spark.sparkContext.accumulator(0)
    mine = sorted(i for k, i in enumerate(ids) if k % 3)
    bad = f"text {ids.index(mine[30])}"

    def encoder(fails):
        def run(series):
            import pandas as pd

            if fails and (series == bad).any():
                raise RuntimeError("killed")
            calls.add(len(series))
            return pd.Series([[float(len(s)), 1.0] for s in series])

        return run

    with pytest.raises(Exception, match="killed"):
        ingest.reembed(chunks, "T", out, log, encoder(True), 2, batch=7, parallel=1)
    done = sum(r.updated for r in corpus.read_checkpoint(spark, log))
    assert 0 < done < 60
    calls.value = 0
    again = ingest.reembed(chunks, "T", out, log, encoder(False), 2, batch=7)
    assert again["updated"] == 60 - done == calls.value and again["last_id"] == mine[-1]
    assert sorted(r.id for r in ingest.read_reembedded(spark, out, log).collect()) == mine
    assert ingest.reembed(chunks, "T", out, log, encoder(False), 2)["updated"] == 0


def test_ranges_need_no_single_task(spark):
    chunks = spark.range(10_000).select((F.col("id") * 7919 % 100_003).alias("id"), F.lit("T").alias("series"))
    cuts = corpus.plan_ranges(chunks, "T", 1000)
    sizes = chunks.groupBy(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("id"))).alias("r")).count().collect()
    assert len(sizes) == 10 and max(r["count"] for r in sizes) < 1300


EVENTS = "key string, at timestamp, v int"


def test_latest_rows_with_a_time_to_live(spark, tmp_path):
    """Late, repeated and expired events, a snapshot, and a restart from the checkpoint."""
    source, out, mark = (str(tmp_path / n) for n in ("in", "cache", "check"))
    day = lambda d, h=0: datetime(2026, 1, d, h)

    def feed(*rows):
        spark.createDataFrame(list(rows), EVENTS).coalesce(1).write.mode("append").parquet(source)
        ingest.latest_within_ttl(spark.readStream.schema(EVENTS).parquet(source), ["key"], "at", out, mark, compact_every=3).start().awaitTermination()
        return sorted((r.key, r.v) for r in ingest.read_latest(spark, out, ["key"]).collect())

    assert feed(("a", day(1), 1), ("a", day(3), 2), ("b", day(2), 3), (None, day(2), 8), ("n", None, 9)) == [("a", 2), ("b", 3)]
    assert feed(("a", day(2), 9), ("a", day(3), 2)) == [("a", 2), ("b", 3)]  # older, and repeated
    assert feed(("c", day(9, 12), 4)) == [("a", 2), ("c", 4)]  # b has expired
    assert feed(("b", day(1), 5)) == [("a", 2), ("c", 4)]  # behind the watermark
    assert feed(("a", day(9), 6)) == [("a", 6), ("c", 4)]  # a new life; the old timer is gone
    assert feed(("d", day(12), 7)) == [("a", 6), ("c", 4), ("d", 7)]
    assert feed(("e", day(30), 1)) == [("e", 1)]
    assert len(list((tmp_path / "cache" / "log").glob("version=*"))) < 12 and list((tmp_path / "cache" / "snapshot").glob("version=*"))


def test_rates_of_ingest(spark, tmp_path):
    root, out = tmp_path / "corpus", str(tmp_path / "chunks")
    for v in range(3):
        (root / "T" / f"T0{v}").mkdir(parents=True)
        (root / "T" / f"T0{v}" / "new.txt").write_text("".join(f"T0{v}n0001_p{i:04d}_##{'句子。' * 50}\n" for i in range(4)), encoding="utf-8")
    listener = ingest.RateListener()
    spark.streams.addListener(listener)
    try:
        ingest.ingest_new_files(spark, str(root), out, str(tmp_path / "check"), dim=8, files_per_batch=2).awaitTermination()
        import time

        for _ in range(50):
            if len(listener.batches) >= 2:
                break
            time.sleep(0.2)
        rates = listener.rates(spark, out).orderBy("batch").collect()
    finally:
        spark.streams.removeListener(listener)
    assert [r.files for r in rates] == [2, 1] and sum(r.chunks for r in rates) == corpus.read_chunks(spark, out).count()
    assert all(r.seconds > 0 and abs(r.rate - r.chunks / r.seconds) < 1e-9 for r in rates)
    report = reports.ingest_report(listener.rates(spark, out), spark.createDataFrame([("f", 3, True)], "file_path string, chunk_count int, completed boolean"), 5).first()
    assert report.avg_rate > 0 and report.eta_hours > 0
    (root / "T" / "T09").mkdir()
    (root / "T" / "T09" / "new.txt").write_bytes(b"T09n0001_p1_##\xff\xfe")
    with pytest.raises(Exception, match="not UTF-8"):
        ingest.ingest_new_files(spark, str(root), out, str(tmp_path / "check"), dim=8).awaitTermination()


def test_resumable_inference(spark, tmp_path):
    """A run that dies half-way keeps its finished parts; the next one asks only the rest."""
    rows = spark.createDataFrame([(i, f"q{i % 50}" if i % 10 else None) for i in range(100)], "id long, text string").repartition(3)
    path, asked = str(tmp_path / "answers"), spark.sparkContext.accumulator(0)

    def model(dies):
        def call(text):
            if dies and text == "q7":
                import os

                os._exit(1)
            asked.add(1)
            if text == "q9":
                raise ValueError("no")
            return text.upper()

        return call

    with pytest.raises(Exception):
        infer.infer_resumable(rows, "text", model(True), path, "answer", parts=8, parallel=1, wait=0.0, attempts=1)
    first = infer._answers(spark, path).count()
    assert 0 < first < 45
    asked.value = 0
    done = infer.infer_resumable(rows, "text", model(False), path, "answer", parts=8, wait=0.0, attempts=1, calls=4)
    assert asked.value == 45 - first
    plain = infer.infer(rows, "text", model(False), "answer", wait=0.0, attempts=1)
    assert sorted(done.collect(), key=str) == sorted(plain.collect(), key=str) and done.columns == plain.columns
    asked.value = 0
    infer.infer_resumable(rows, "text", model(False), path, "answer", parts=8, wait=0.0, attempts=1)
    assert asked.value == 0
    infer.infer_resumable(rows, "text", model(False), path, "answer", parts=8, wait=0.0, attempts=1, retry_errors=True)
    assert asked.value == 1


def test_dictionary_tables(spark):
    """Tables give what dicts give, on vectors that reach overlaps, alternatives and triggers; 100,000 aliases work."""
    from lodestar.functions import lexicon

    questions = ["般若波羅蜜多心經的色空義如何說？", "佛說四諦與八正道", "菩提心與菩提", "心經心經金剛經", "何謂空性？", "nothing here", "", "阿含經中的無我與涅槃"]
    asked = spark.createDataFrame(list(enumerate(questions)), "query_id long, q string")
    terms = spark.createDataFrame([(n, t, a) for n, (t, alts) in enumerate(lexicon.TERMS.items()) for a in alts], "no int, term string, alt string")
    aliases = spark.createDataFrame(list(lexicon.ALIASES.items()) + [(f"別名{i:06d}號", f"T99n{i:06d}") for i in range(100_000)], "alias string, id string")
    grouped = spark.createDataFrame([(n, t, alts) for n, (t, alts) in enumerate(lexicon.TERMS.items())], "no int, term string, alts array<string>")
    out = queryprep.expand_terms_by_table(asked, "q", terms, "a")
    out = queryprep.resolve_aliases_by_table(out, "q", aliases, "b")
    out = queryprep.doctrine_terms_by_table(out, "q", grouped, "c")
    q = F.col("q")
    rows = out.select("a", queryprep.expand_terms(q).alias("wa"), "b", queryprep.resolve_aliases(q).alias("wb"), "c", queryprep.expand_doctrine_terms(q).alias("wc")).collect()
    assert len(rows) == len(questions) and all((r.a, r.b, r.c) == (r.wa, r.wb, r.wc) for r in rows)
    assert any(r.a != q for r, q in zip(rows, questions)) and any(len(r.c) > 2 for r in rows)
    many = queryprep.resolve_aliases_by_table(spark.createDataFrame([(1, "見別名004321號與別名099999號")], "query_id long, q string"), "q", aliases, "b").first().b
    assert many.endswith(" T99n004321 T99n099999")
    small = asked.withColumnRenamed("q", "question")
    both = [sorted(map(str, queryprep.preprocess(small, terms=t, aliases=a).select("query_id", "normalized", "canon_ids", "canon_prefixes", "intent", "series_hint").collect())) for t, a in ((None, None), (terms, aliases))]
    assert both[0] == both[1]


def naive_expansion(q, terms):
    extra = {a for t, alts in terms.items() if t in q for a in alts} | {t for t, alts in terms.items() if any(a.lower() in q.lower() for a in alts)}
    return q + " " + " ".join(sorted(extra)) if extra else q


def test_term_values(spark):
    from lodestar.functions import lexicon

    questions = ["佛說四諦", "什麼是空", "Nirvana and karma", "菩提心如何修", ""]
    rows = spark.createDataFrame(list(enumerate(questions)), "query_id long, q string").select("q", queryprep.expand_terms(F.col("q")).alias("x")).collect()
    assert all(r.x == naive_expansion(r.q, lexicon.TERMS) for r in rows)


@pytest.mark.parametrize("scoped", [True, False])
def test_citations_in_one_large_work(spark, scoped):
    """All lines of one work, nested and overlapping ranges, citations between and at their ends."""
    rng = random.Random(6)
    coord = lambda w, n: f"T0{w}n0001_p{n:05d}_"
    ranges = [(f"T0{w}N0001", coord(w, a), coord(w, a + rng.randint(0, 30))) for w, n in ((1, 800), (2, 10), (3, 40)) for a in (rng.randint(0, 4000) for _ in range(n))]
    cites = [(k, coord(rng.choice((1, 1, 1, 2, 3, 4)), rng.randint(0, 4100))) for k in range(1500)]
    chunks = spark.createDataFrame(ranges, "canon_id string, coord_start string, coord_end string")
    got = {r.cite_id for r in evaluate.citation_exists(spark.createDataFrame(cites, "cite_id long, coord string"), chunks, scoped).collect()}
    assert got == {k for k, c in cites if any(a <= c <= b and (not scoped or w == c.split("_")[0].upper()) for w, a, b in ranges)}


def test_running_max_by_key(spark):
    rng = random.Random(1)
    rows = [("a" if rng.random() < 0.8 else "b", n, rng.randint(0, 100)) for n in range(500)]
    got = running_max(spark.createDataFrame(rows, "k string, n int, v int").repartition(4), ["n"], "v", "top", ("k",)).collect()
    assert len(got) == 500 and all(r.top == max(v for k, n, v in rows if k == r.k and n <= r.n) for r in got)


def test_three_digit_identifiers(spark):
    from lodestar.functions import text

    row = spark.range(1).select(*[text.normalize_id(F.lit(v)) for v in ("T01001", "see t02n123", "T010001", "T0100012")]).first()
    assert tuple(row) == ("T01N001", "T02N123", "T01N0001", None)
