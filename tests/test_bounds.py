"""What searches shuffle and hold: bounded where the tables grow."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestar.operators import search, text_index, vector_index
from lodestar.plans import queries as base


def shuffled(spark, run, what="shuffleWriteRecords") -> tuple[int, object]:
    """Rows (or bytes) that went through shuffles while `run` ran, and what it returned."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def written() -> int:
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, none, None))
        return sum(getattr(s, what)() for s in stages)

    before, out = written(), run()
    return written() - before, out


def vector_tables(spark, n, dim=16, repeats=1):
    rng = np.random.default_rng(5)
    vectors = np.tile(rng.standard_normal((n // repeats, dim)), (repeats, 1)).astype("f4")
    rows = [(i, "AB"[i % 2], f"T{i % 4}", [float(x) for x in v]) for i, v in enumerate(vectors)]
    chunks = spark.createDataFrame(rows, "id long, series string, canon_id string, embedding array<float>").repartition(4)
    asked = chunks.select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"), "series", F.array("canon_id").alias("prefixes"))
    return vectors.astype(float), chunks, asked


def test_index_search_shuffles_no_cells(spark, tmp_path, monkeypatch):
    """Many queries of an index: neither they nor what they meet are dealt out by cell."""
    _, chunks, asked = vector_tables(spark, 1500)
    path = str(tmp_path / "index")
    vector_index.build_vector_index(chunks, path, 5)
    few = {(r.query_id, r.id) for r in vector_index.search_vector_index(asked.select("query_id", "vector"), path, 5).collect()}
    monkeypatch.setattr(vector_index, "QUERY_BLOCK", 100)
    moved, found = shuffled(spark, lambda: vector_index.search_vector_index(asked.select("query_id", "vector"), path, 5).collect())
    assert {(r.query_id, r.id) for r in found} == few and len(found) == 5 * 1500
    assert moved < 10 * 1500


def test_prefixes_are_tested_before_the_shuffle(spark, monkeypatch):
    """Of many queries' nearest 200, only what has a prefix, and no more than asked for, leaves a task."""
    _, chunks, asked = vector_tables(spark, 1500)
    run = lambda: sorted(map(tuple, search.vector_search(asked.select("query_id", "vector", "prefixes"), chunks, 5, prefixes=True).collect()))
    few = run()
    monkeypatch.setattr(search, "QUERY_BLOCK", 100)
    monkeypatch.setattr(search, "ROW_BLOCK", 500)
    moved, found = shuffled(spark, run)
    assert [r[:2] + r[3:] for r in found] == [r[:2] + r[3:] for r in few] and len(found) == 5 * 1500
    assert moved < 20 * 1500


@pytest.mark.parametrize("scope", ["none", "series", "prefixes"])
def test_queries_and_rows_meet_in_bounded_memory(spark, scope):
    """5,000 queries meet 16,384 rows (655 MB of distances) in less than 60 MB; equal vectors tie by id."""
    rng = np.random.default_rng(3)
    rows = np.tile(rng.standard_normal((4096, 8)), (4, 1))
    ids, canon, series = rng.permutation(16384), [f"T{i % 5}" for i in range(16384)], ["AB"[i % 2] for i in range(16384)]
    chunks = pa.table({"id": ids, "embedding": list(rows), "series": series, "canon_id": canon})
    own = {"query_id": np.arange(5000), "vector": list(rows[:5000])}
    own |= {"series": series[:5000]} if scope == "series" else {"prefixes": [[c.lower()] for c in canon[:5000]]} if scope == "prefixes" else {}
    asked = pa.table(own)
    tracemalloc.start()
    ranking = search._Ranking(asked, 6, False)
    ranking.meet(chunks)
    found = pa.Table.from_batches(ranking.found()).to_pandas()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    for q in range(0, 5000, 131):
        d = np.round(1 - unit @ unit[q], 9)
        ok = [i for i in range(16384) if scope == "none" or (series if scope == "series" else canon)[i] == (series if scope == "series" else canon)[q]]
        want = [int(ids[i]) for i in sorted(ok, key=lambda i: (d[i], ids[i]))[:6]]
        assert found[found.query_id == q].id.tolist() == want


def docs(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{i}" for i in range(50)])
    rows = [(i, " ".join(rng.choice(words, 40, p=np.arange(50, 0, -1) / 1275))) for i in range(n)]
    return spark.createDataFrame(rows, "id long, text string").repartition(4)


def test_token_search_shuffles_packed_postings(spark, tmp_path):
    """Neither tokens nor (query, chunk) pairs are shuffled one by one; replaced chunks are told without file names too."""
    path, first, second = str(tmp_path / "tokens"), docs(spark), docs(spark, seed=1).where("id % 3 = 0")
    asked = spark.createDataFrame([(f"q{i}", f"w{i} w{2 * i} W{3 * i} none") for i in range(20)], "query_id string, query string")
    write = lambda: (text_index.write_token_table(first, path, 0), text_index.write_token_table(second, path, 1))
    moved, _ = shuffled(spark, write)
    assert moved < 10_000  # of 21,000 tokens and 12,000 distinct ones
    living = first.where("id % 3 <> 0").union(second)
    want = sorted(map(tuple, search.token_search(asked, living, 7, "any").collect()))
    moved, found = shuffled(spark, lambda: sorted(map(tuple, text_index.search_tokens(asked, path, 7, "any").collect())))
    assert found == want and len(found) == 140
    assert moved < 2000  # of 7,000 pairs
    assert text_index.search_tokens(asked.where("false"), path, 7, "any").count() == 0
    twice = asked.union(asked)
    assert sorted(map(tuple, text_index.search_tokens(twice, path, 7, "any").collect())) == sorted(map(tuple, search.token_search(twice, living, 7, "any").collect()))


@pytest.mark.parametrize("name", ["miss_report", "reranked", "evaluation_json", "recall_report", "context_blocks", "hit_preview", "merged_hits", "fused_ranks"])
def test_queries_shuffle_no_pairs(spark, name):
    """Where the token table is there, a query shuffles packed postings of the asked tokens once; contexts hold whole texts."""
    import __spark_entry__ as entry

    sf, what, most = "/root/testdata/sf0.01", *(("shuffleWriteRecords", 5000) if name == "context_blocks" else ("shuffleWriteBytes", 450_000))
    base._token_table(spark, sf)
    moved, _ = shuffled(spark, lambda: entry.queries()[name](spark, sf).collect(), what)
    assert moved < most
