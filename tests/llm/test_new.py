"""Tokenizer alignment, document fingerprints and whitening against brute force, and their edge cases."""

import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestar.llm import alignment, fingerprints, queries, whitening

DOCS = "doc_id long, text string, row long, pairs string, hi long, lo long, task int, side int, x string"
FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghé中ß") for _ in range(rng.randint(1, 8))) for _ in range(200)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    odd = ["", None, " ", "  two  spaces ", "\n\nlines \t\n and tabs ", "<|endoftext|> and </s><s> <unk> <0x41>", "a▁b", "😀 emoji ‍ joined ①②", "x" * 5000, make(5_000), "tail ", "　wide　space", "don't we'll 12,345.67"]
    return [make(rng.randint(1, 120)) for _ in range(40)] + odd + [make(30)] * 3


@pytest.fixture(scope="module")
def corpus(spark, texts):
    rows = [(i, t, 1, "clash", 2, 3, 4, 5, "x") for i, t in enumerate(texts)] + [(None, "no id here", 1, "p", 2, 3, 4, 5, "x"), (None, None, 1, "p", 2, 3, 4, 5, "x"), (7, "again seven", 1, "p", 2, 3, 4, 5, "x")]
    return spark.createDataFrame(rows, DOCS).repartition(4).cache()


def brute_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a_model, b_model = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a_model.encode_special_tokens = True
    b_bytes = lambda i: bytes([int(b_model.id_to_piece(i)[3:5], 16)]) if b_model.is_byte(i) else b_model.id_to_piece(i).replace("▁", " ").encode()
    a_table = alignment.byte_level_bytes(a_model)
    out, total = [], Counter()
    for doc, text in rows:
        text = text or ""
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        whole = (" " + text).encode()
        if b"".join(a_table[i] for i in a) != whole or b"".join(map(b_bytes, b)) != whole:
            a = b = []
        ends = []
        for ids, size in ((a, lambda i: len(a_table[i])), (b, lambda i: len(b_bytes(i)))):
            at, side = 0, {}
            for k, i in enumerate(ids):
                at += size(i)
                side[at] = k
            ends.append(side)
        groups, links, x, y = [], [], 0, 0
        for end in sorted(ends[0].keys() & ends[1].keys()):
            i, j = ends[0][end] + 1, ends[1][end] + 1
            groups.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
            links.append((a[i - 1], b[j - 1]))
            x, y = i, j
        total.update(links)
        out.append((doc, len(a), len(b), groups, links))
    best = {}
    for (_, b), n in total.items():
        best[b] = max(best.get(b, 0), n)
    return Counter((d, na, nb, len(g), len(k), sum(total[p] == best[p[1]] for p in k), sum(total[p] for p in k), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for d, na, nb, g, k in out)


@pytest.mark.parametrize("sent", [alignment.SENT_PAIRS, 5, 0])
def test_alignment(corpus, sent):
    """All pairs sent to the tasks, or all but five (or none) joined: the same rows."""
    ranks = (public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN) if sent else None
    got = Counter(tuple(r) for r in alignment.align_tokenizers(corpus, *FILES, ranks, sent).collect())
    assert got == brute_alignment(corpus.select("doc_id", "text").collect())


def test_alignment_of_nothing(spark, corpus):
    assert alignment.align_tokenizers(corpus.limit(0), *FILES).count() == 0
    alone = alignment.align_tokenizers(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string"), *FILES).collect()
    assert [tuple(r)[1:] for r in alone] == [(0, 0, 0, 0, 0, 0, "")] * 2
    broken = spark.sql("select 1L as doc_id, cast(x'61ff62' as string) as text")
    assert alignment.align_tokenizers(broken, *FILES).first().n_a == 0


def naive_vote(text):
    """Term by term in Python, from the same word hashes."""
    from lodestar.llm import _text

    low = _text.LOWER[np.frombuffer(text.encode(), np.uint8)]
    start, end, _ = _text.word_bounds(low, np.array([0, len(low)]))
    h = _text.word_hashes(low, start, end)
    terms = [int(_text.window_hashes(h[i : i + 2], 2)[0]) for i in range(len(h) - 1)] or [int(v) for v in _text.mix(h)]
    sums = [0] * 128
    for term, n in Counter(terms).items():
        second = int(_text.mix(np.array([(term + int(fingerprints._SECOND)) % 2**64], np.uint64))[0])
        weight = round(fingerprints.UNIT * (1 + math.log(n)))
        for b in range(128):
            sums[b] += weight if (term >> b if b < 64 else second >> b - 64) & 1 else -weight
    bits = [int(s > 0) for s in sums]
    return f"{sum(b << k for k, b in enumerate(bits[:64])):016x}{sum(b << k for k, b in enumerate(bits[64:])):016x}"


def test_fingerprints(corpus):
    got = fingerprints.document_fingerprints(corpus).collect()
    rows = [(r.doc_id, r.text or "") for r in corpus.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).orderBy(F.col("doc_id").desc_nulls_last(), "h").collect()]
    want = Counter()
    for (doc, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        cut = len(text) // 3
        changed = text[: len(text) - cut] + following[:cut]
        bits = lambda a, b: bin(int(a, 16) ^ int(b, 16)).count("1")
        near = lambda a, b: round(max(0.0, math.cos(math.pi * bits(a, b) / 128)), 9)
        own, other, later = naive_vote(text), naive_vote(changed), naive_vote(following)
        want[doc, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, other, near(own, other), near(own, later)] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == want
    assert all((r.n_near is not None) == (r.doc_id is not None and r.doc_id % 100 == 0) for r in got)
    long = [r for r in got if r.n_chars > 100 and r.near_next < 1]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.95


def test_block_tables(spark):
    """Every fingerprint within the radius, each once, against all pairs."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (40, 2), dtype=np.int64)
    near = []
    for a in base:
        for flips in range(0, 12):
            bits = np.unpackbits(a.view(np.uint8))
            bits[rng.choice(128, flips, replace=False)] ^= 1
            near.append(np.packbits(bits).view(np.int64))
    rows = sorted({tuple(map(int, r)) for r in near})
    prints = spark.createDataFrame([(a, b, 2) for a, b in rows], "hi long, lo long, n long")
    asked = prints.where("hi % 2 = 0").select("hi", "lo")
    apart = lambda p, q: sum(bin((x ^ y) % 2**64).count("1") for x, y in zip(p, q))
    for radius in (0, 3, 7):
        got = Counter(((r.asked_hi, r.asked_lo), (r.hi, r.lo)) for r in fingerprints.within(asked, prints, radius).collect())
        assert got == Counter((p, q) for p in map(tuple, asked.collect()) for q in rows if apart(p, q) <= radius)
    with pytest.raises(ValueError):
        fingerprints.within(asked, prints, 8)


def test_fingerprints_of_few(spark, corpus):
    assert fingerprints.document_fingerprints(corpus.limit(0)).count() == 0
    one = fingerprints.document_fingerprints(spark.createDataFrame([(100, "abcdef gh")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdefabc").hexdigest() and one[0].near_next == 1.0 and one[0].n_near == 0
    void = fingerprints.document_fingerprints(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert {(r.fingerprint, r.near_edited, r.n_chars) for r in void} == {("0" * 32, 1.0, 0)}
    copies = fingerprints.document_fingerprints(spark.createDataFrame([(100 * k, "one two three four five") for k in range(30)], "doc_id long, text string")).collect()
    assert {r.n_near for r in copies} == {29}


VECTORS = "vec_id long, embedding array<double>, x string, n long"


@pytest.mark.parametrize("size", [1.0, 1e5, 1e12, 1e15])
def test_whitening(spark, size):
    """Exact sums and covariances against Fractions, at sizes that take 64-bit and unbounded integers."""
    rng = np.random.default_rng(3)
    data = rng.standard_normal((60, 5)) @ rng.standard_normal((5, 5)) * size + 3 * size
    rows = [(i, [float(c) for c in v], "x", 1) for i, v in enumerate(data)] + [(100, [float(c) for c in data[0]], "x", 1), (None, [float(c) for c in data[1]], "x", 1)]
    rows += [(200, None, "x", 1), (201, [1.0, None, 0.0, 0.0, 0.0], "x", 1), (202, [math.nan] * 5, "x", 1), (203, [math.inf, 0.0, 0.0, 0.0, 0.0], "x", 1), (204, [], "x", 1)]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    assert len(got) == 62 * 5 and {r.n for r in got} == {60}
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in data.tolist()]
    sums = [sum(c) for c in zip(*x)]
    y = [[60 * c - s for c, s in zip(v, sums)] for v in x]
    deviation = {i: sum(c * c for c in v) for i, v in enumerate(y)}
    assert all(r.deviation == (deviation[r.vec_id] if deviation[r.vec_id] < 1 << 63 else None) for r in got if r.vec_id is not None and r.vec_id < 60)
    cov = np.array([[float(Fraction(sum(v[i] * v[j] for v in y), 60**3)) for j in range(5)] for i in range(5)])
    values = np.linalg.eigvalsh(cov)[::-1]
    by = {(r.vec_id, r.component): r for r in got}
    w = np.array([[by[i, k].whitened for k in range(1, 6)] for i in range(60)])
    assert np.abs(w.T @ w / 60 - np.eye(5)).max() < 1e-6 and got[0].identity_error < 1e-6
    assert np.allclose([by[0, k].explained for k in range(1, 6)], values / np.trace(cov), rtol=1e-9)
    assert all(by[100, k].whitened == by[0, k].whitened for k in range(1, 6))


def test_polarisation_is_exact(spark):
    rng = np.random.default_rng(1)
    x = [[int(c) for c in v] for v in rng.integers(-(1 << 40), 1 << 40, (50, 4))]
    fit = spark.createDataFrame([(v,) for v in x], "x array<long>").repartition(3)
    sums = whitening.dimension_sums(fit, 4)
    assert sums == [sum(c) for c in zip(*x)]
    y = [[50 * c - s for c, s in zip(v, sums)] for v in x]
    got = whitening.pair_variances(fit, 50, sums)
    assert got == {(i, j): sum((v[i] + (v[j] if j != i else 0)) ** 2 for v in y) for i in range(4) for j in range(i, 4)}
    for bits in (20, 40, 60):
        t = rng.integers(-(1 << bits), 1 << bits, (200, 3))
        assert whitening.squares(t) == [sum(int(v) ** 2 for v in t[:, k]) for k in range(3)]


def test_whitening_of_few(spark):
    frame = lambda rows: spark.createDataFrame(rows, VECTORS)
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, None, "", 0), (2, [math.nan], "", 0)])).count() == 0
    one = whitening.whiten(frame([(1, [0.5, 0.25], "", 0), (1, [0.5, 0.25], "", 0)])).collect()
    assert len(one) == 4 and all(r.n == 1 and r.whitened is None and r.explained is None and r.deviation == 0 for r in one)
    flat = whitening.whiten(frame([(i, [float(i), 2.0, float(i)], "", 0) for i in range(8)])).collect()
    assert {r.component for r in flat if r.whitened is not None} == {1} and {r.component for r in flat} == {1, 2, 3}


def test_registered_rows(spark):
    sf = "/root/testdata/sf0.001"
    docs, vectors = spark.read.parquet(f"{sf}/documents.parquet").count(), spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert queries.op11_align_tokenizers(spark, sf).count() == docs and queries.op12_document_fingerprints(spark, sf).count() == docs
    assert queries.op13_whitened_vectors(spark, sf).count() == 16 * vectors


def test_article_parts_with_furniture_names():
    """Titles and paragraphs stay whatever an article calls their elements; what is furniture by tag, role or a plain name goes."""
    from lodestar.llm import html

    page = lambda inner: f"<html><body><div class='header'><p>Site</p></div><article><p>Body text.</p>{inner}<p>More.</p></article><footer>F</footer></body></html>"
    text = lambda inner: html.main_text(*html.parse(page(inner)))
    kept = ["<header class='article-header'><h1>KEEP</h1></header>", "<div class='post-header'><h1>KEEP</h1></div>", "<div class='content-header'><h2>KEEP</h2></div>", "<p class='notice'>KEEP</p>",
            "<table class='header'><tr><td>KEEP</td></tr></table>", "<section class='text-alert'>KEEP</section>", "<p>a <math><mi>KEEP</mi></math> b</p>", "<header><h1>KEEP</h1></header>"]
    assert all("KEEP" in text(k) for k in kept)
    gone = ["<div class='comments'><p>GO</p></div>", "<div class='advert'><p>GO</p></div>", "<nav><p>GO</p></nav>", "<div role='alert'><p>GO</p></div>", "<div class='header'>GO</div>",
            "<div class='menu'><ul><li><a href='x'>GO</a></li></ul></div>", "<p hidden>GO</p>", "<div class='related-posts'><p>GO</p></div>"]
    assert all("GO" not in text(g) and "More." in text(g) for g in gone)
    assert "Site" not in text("") and text("") == "Body text.\n\nMore."


def test_recurring_notice_in_an_article_goes(spark):
    """The same notice paragraph in the articles of aligned pages is template."""
    from lodestar.llm import html

    rows = [(i, f"https://h.example/{i}", f"<html><body><main><h1>Title {i * 7}</h1><p class='notice'>Subscribe to our service today.</p><p>Words of page {i * 13} and more of {i * 31}.</p></main></body></html>") for i in range(8)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Subscribe" not in t and f"Title {i * 7}" in t and f"page {i * 13}" in t for i, t in got.items())


def _tables(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_over_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    assert corpus_pipeline.run(spark, _tables(spark, str(tmp_path), docs.limit(0), labels.limit(0))).count() == 0


def test_pipeline_with_clashing_columns_nulls_and_repeats(spark, tmp_path):
    """Columns that the operators use inside, null ids and texts, and every row twice: the plain table's texts come through."""
    import corpus_pipeline

    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    clash = docs.select("*", *[F.lit(1).alias(c) for c in ("row", "hash", "of", "fp", "size", "root", "key", "start", "length", "task", "block", "taken", "kept", "n")])
    odd = clash.union(clash).union(clash.limit(5).withColumn("doc_id", F.lit(None).cast("long"))).union(clash.limit(3).withColumn("text", F.lit(None).cast("string")))
    folder, rows = _tables(spark, str(tmp_path), odd, labels), odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        done = stage(spark, rows, folder)
        assert done.columns == odd.columns, name
        rows = corpus_pipeline.materialize(done, "stage")
        assert rows.count() > 0, name
    packed = corpus_pipeline.run(spark, folder)
    assert packed.columns == corpus_pipeline.run(spark, "/root/testdata/sf0.001").columns and packed.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_nearest_of_null_vectors(spark):
    from lodestar.llm import ann

    assert ann.nearest(spark.createDataFrame([(i, None) for i in range(5)], "vec_id long, embedding array<float>")).count() == 0
