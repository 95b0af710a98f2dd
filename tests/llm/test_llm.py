"""Small fixtures against brute force, and the edge cases every operator must survive."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import ann, crf, html, line_rules, mixing, packing, passages, quality, queries, sharding, simhash, suffix_tree
from lodestar.llm.components import component_labels

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, fp string"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = make(300), make(70)
    rows = [base, base, base.replace(" ", "  ", 1), base + " extra", make(120) + " " + passage + " " + make(90), make(60) + " " + passage + "\n" + make(40)]
    rows += [make(rng.randint(60, 200)) for _ in range(14)] + [None, "", "   ", "one two", "A B c", "a b C", "### $$$ %%% " * 60, "De " * 200, "naïve 中文 字 " * 30, make(9000)]
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 1, 5, "clash") for i, t in enumerate(rows)]
    return spark.createDataFrame(rows + [rows[6], (None, "null id text " * 30, None, None, None, None, None)], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_simhash(corpus, empty):
    rows = corpus.select("doc_id", "text").collect()
    fps = []
    for r in rows:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (r.text or "").encode()).split()
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)] += [r.doc_id] if r.doc_id is not None else []
    want = sorted((str(r.doc_id), f"{fps[i]:016x}", str(min(least[find(i)], default=None))) for i, r in enumerate(rows))
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(corpus).collect())
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(corpus).columns == corpus.columns


def test_keep_one_with_null_and_repeated_ids(spark):
    rng = random.Random(2)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(80)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (1, c), (1, d), (2, d), (3, e), (3, e), (None, e)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    clash = docs.select("*", F.lit(1).alias("_keep"), F.lit(2).alias("_text"), F.lit(3).alias("row"), F.lit(4).alias("hash"), F.lit(5).alias("root"))
    wide = simhash.keep_one(clash)
    assert wide.columns == clash.columns and {tuple(r)[2:] for r in wide.collect()} == {(1, 2, 3, 4, 5)} and simhash.keep_one(docs.where("false")).count() == 0
    got = simhash.keep_one(docs).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("None", a), ("None", b), ("1", c), ("1", d), ("3", e)])


def test_hot_simhash_bucket():
    rng = np.random.default_rng(1)
    rest = np.concatenate([rng.integers(0, 1 << 38, 100), 7 ^ (1 << rng.integers(0, 12, 300)) ^ (1 << rng.integers(0, 12, 300))]).astype(np.int64)
    a, b = simhash.bucket_links(rest, np.zeros(len(rest)))
    from lodestar.llm._text import components

    i, j = np.nonzero(np.bitwise_count(rest[:, None] ^ rest[None]) <= 3)
    assert np.array_equal(components(len(rest), a, b), components(len(rest), i, j)) and len(a) < len(rest)


def test_components(spark):
    links = [(i + 1, i) for i in range(50)] + [(100, 101), (5, 5), (None, 3)] + [(200, k) for k in range(201, 260)]
    got = {r.node: r.root for r in component_labels(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got[50] == 0 and got[101] == 100 and got[259] == 200 and len(got) == 50 + 1 + 59


def test_mixing(corpus, empty):
    rows = mixing.mix(corpus).collect()
    assert len(rows) == corpus.count() and sorted(map(str, rows)) == sorted(map(str, mixing.mix(corpus).collect()))
    sizes, target = defaultdict(int), {}
    taken = defaultdict(int)
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"] and sum(r.by_shard) == r.taken and len(r.by_shard) == mixing.SHARDS and min(r.by_shard) >= 0
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    want, weights = {}, {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    open_, left = set(sizes), float(sum(sizes.values()))
    while open_:
        level = left / sum(weights[s] for s in open_)
        full = {s for s in open_ if level * weights[s] > 3 * sizes[s]}
        want |= {s: 3.0 * sizes[s] for s in full} or {s: level * weights[s] for s in open_}
        left -= sum(3 * sizes[s] for s in full)
        open_ = open_ - full if full else set()
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 0.02 * want[s] + 20
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(corpus).columns == corpus.columns


def test_sainte_lague(spark):
    targets = [700.0, 210.5, 60.0, 29.5, 0.0]
    df = spark.createDataFrame([(f"s{i}", 10**6, i, 1.0, t) for i, t in enumerate(targets)], "source string, source_size long, place int, weight double, target double")
    seats, upto = [0] * 5, [[0] * 5]
    for _ in range(137):
        k = max(range(5), key=lambda i: (targets[i] / (2 * seats[i] + 1), -i))
        seats[k] += 1
        upto.append(list(seats))
    got = mixing.block_quotas(df, [137, 50, 0], 1)
    assert [(r.house, r.quota) for r in got.orderBy("house", "place").collect()] == [(j, n) for j, house in enumerate([137, 50, 0]) for n in upto[house]]
    shards = {r.place: r.upto for r in mixing.shard_quotas(df, 137, 4, 1).collect()}
    assert all(shards[i] == [upto[137 * j // 4][i] for j in range(5)] for i in range(5))


def test_mix_takes_runs_of_blocks(spark):
    """`taken` and `by_shard` equal a walk over the tape of every source, block by block."""
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 90), f"s{min(i % 7, 3)}", 1) for i in range(140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _size long").repartition(3)
    got = mixing.mix(docs, block_tokens=8, shards=5).collect()
    by_source = defaultdict(list)
    for r in got:
        by_source[r.source].append(r)
    for source, found in by_source.items():
        n = -(-found[0].source_size // 8)
        per_shard = [sum(r.by_shard[j] for r in found) for j in range(5)]
        assert sum(per_shard) == sum(r.taken for r in found) <= 8 * found[0].quota and abs(sum(per_shard) - found[0].target) <= 8 * (1 + found[0].quota // n) + 8
    out = mixing.mixed_documents(docs.withColumn("_copy", F.lit(77)).withColumn("_d", F.lit(3)))
    assert out.columns == ["doc_id", "text", "source", "_size", "_copy", "_d"] and {(r._size, r._copy, r._d) for r in out.collect()} == {(1, 77, 3)}
    assert mixing.mixed_documents(docs.where("false")).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((900, 16))
    x[50:80] = x[0]
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(900)] + [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [1.0], 0)]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    found, hits = defaultdict(dict), 0
    for r in got:
        found[r.query_id][r["rank"]] = (r.vec_id, r.score)
        assert r.score == np.sqrt(((x[r.vec_id] - x[r.query_id]) ** 2).sum())
    for q in range(0, 900, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(900), d))[:10]
        assert len(found[q]) == 10
        hits += len({i for i, _ in found[q].values()} & set(best.tolist()))
    assert hits / 90 >= 0.9 and [found[0][k][0] for k in range(1, 11)] == list(range(50, 60))
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0
    # An id with two vectors counts once, with the lesser one; extra columns are not read.
    twice = [(r[0], r[1], 1) for r in rows[:200]] + [(7, [9.0] * 16, 1), (100, [8.0] * 16, 1), (7, rows[7][1], 1)]
    again = ann.nearest(spark.createDataFrame(twice, "vec_id long, embedding array<double>, rank int")).collect()
    least = {i: min(v for j, v, _ in twice if j == i) for i in range(200)}
    assert len(again) == 20 and len({(r.query_id, r.vec_id) for r in again}) == 20
    assert all(r.score == np.sqrt(((np.array(least[r.vec_id]) - np.array(least[r.query_id])) ** 2).sum()) for r in again)


def test_index_reaches_every_code_within_the_radius():
    rng = np.random.default_rng(3)
    code = rng.integers(0, 1 << 63, (3000, 2), dtype=np.uint64)
    code[:50] = code[100] ^ (np.uint64(1) << rng.integers(0, 60, (50, 2), dtype=np.uint64))
    index = ann.SubstringIndex(code)
    for radius in (0, 3, 20, 55, 128):
        assert np.array_equal(index.within(code[100], radius), np.flatnonzero(np.bitwise_count(code ^ code[100]).sum(axis=1) <= radius))


def test_html(spark):
    page = lambda i, body: f"<html><head><title>t</title></head><body><div>Site name</div><nav><a href=x>menu {i}</a></nav>{body}<div>All rights kept</div></body></html>"
    rows = [(i, "http://h.example/a", page(i, f"<div><p>Body &amp; text\n {i}</p><p>More {i * 7}</p></div>")) for i in range(6)]
    rows += [(10, "http://h.example/b", "<article><h1>T</h1><p>a<br>b<p>c &lt; d</article><footer>f</footer><div class='ad'>buy"), (11, None, None), (12, "", ""), (13, "x", "plain < text"), (11, None, None)]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[2].text == "Body & text 2\n\nMore 14" and got[10].text == "T\n\na b\n\nc < d" and got[11].text == "" and got[13].n_chars == len(got[13].text)


def _cell(pages):
    import pandas as pd

    return html.extract_cell(pd.DataFrame({"page_id": range(len(pages)), "url": "http://h.example/x", "html": pages}))["text"].tolist()


def test_wrapper_decides(monkeypatch):
    """Slots without a telling name or tag: what recurs goes wherever it stands, what varies stays; without induction both stay."""
    rng = random.Random(12)
    make = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    pool = [make(6) for _ in range(3)]
    bodies = [[make(30) for _ in range(rng.randint(2, 5))] for _ in range(12)]
    page = lambda k, ps, box: f"<body><div class='x1'>Brand</div><div class='x2'>{pool[k % 3]}</div><{box}><h1>Title {k}</h1><p>Read more of this every day</p>{''.join(f'<p>{p}</p>' for p in ps)}</{box}><div class='x9'>{make(4)}</div></body>"
    for box in ("article", "div"):
        pages = [page(k, ps, box) for k, ps in enumerate(bodies)]
        want = ["\n\n".join([f"Title {k}", *ps]) for k, ps in enumerate(bodies)]
        assert _cell(pages) == want
        alone = [html.main_text(*html.parse(p)) for p in pages]
        assert all("Read more" in t for t in alone)
    # Copies of one article on many pages are one page to the induction: their text is no template.
    same = [f"<body><article><h1>One</h1><p>{bodies[0][0]}</p></article><div>{make(3)}</div></body>" for _ in range(6)]
    assert set(_cell(same)) == {f"One\n\n{bodies[0][0]}"}


def test_html_keeps_article_text():
    cases = {
        "<article><h2 id='related-work'>Related work</h2><p>a</p></article>": "Related work\n\na",
        "<article><div class='share-price'>5</div><div class='share-buttons'>no</div><p class='comments-enabled'>q</p></article>": "5\n\nq",
        "<article><p>a<button>b<p>c<svg>d<p>e</article>": "ab\n\ncd\n\ne",
        "<p>it isn't <a title=don't>so</a> 3 > 2": "it isn't so 3 > 2",
        "<article>a<!-- b > c": "a",
        "<ul><li>a<li>b<ul><li>c</ul></ul>": "a\n\nb\n\nc",
    }
    assert {p: html.main_text(*html.parse(p)) for p in cases} == cases


def test_deep_and_wide_pages():
    deep = _cell(["".join(f"<div>t{i} {k} " for k in range(10_000)) for i in range(5)])
    wide = _cell(["<ul>" + "".join(f"<li>item {i} {k}</li>" for k in range(50_000)) + "</ul>" for i in range(5)])
    assert all(len(t) > 80_000 for t in deep) and all(t.count("\n\n") == 49_999 for t in wide)
    assert all(len(t) > 1000 for t in _cell([f"<a href='x" * 3000 + f"{i}" * 1500 for i in range(4)]))


def test_tree_match_by_brute_force():
    """The table gives the score of all order-preserving alignments; long lists are aligned in order."""
    rng = random.Random(6)

    def grow(depth):
        tag = rng.choice(["div", "p"])
        inside = "".join(grow(depth - 1) if depth and rng.random() < 0.6 else rng.choice("ab") for _ in range(rng.randint(1, 3)))
        return f"<div>{inside}</div>" if tag == "div" else f"<section>{inside}</section>"

    def best(a, b):
        if a.kind != b.kind:
            return 0
        if a.kind == "#":
            return 1 + (a.text == b.text)
        top = {(0, 0): 0}
        for i in range(len(a.children) + 1):
            for j in range(len(b.children) + 1):
                top[i, j] = max([top.get((i - 1, j), 0), top.get((i, j - 1), 0)] + ([top[i - 1, j - 1] + (w if (w := best(a.children[i - 1], b.children[j - 1])) else 0)] if i and j else []))
        return 1 + top[len(a.children), len(b.children)]

    for _ in range(150):
        a, b = (html.parse(grow(3) + grow(2))[0] for _ in range(2))
        score, pairs = html.tree_match(a, b)
        assert score == best(a, b) and all(x.kind == y.kind for x, y in pairs)
        assert score == sum(1 + (x.kind == "#" and x.text == y.text) for x, y in pairs)
        linear, pairs = html.tree_match(a, b, cells=0)
        assert linear <= score and linear == sum(1 + (x.kind == "#" and x.text == y.text) for x, y in pairs)


def test_html_tables(spark):
    rows = [(1, "u", "<p>a</p>", 5, "x", "y"), (1, "u", "<p>a</p>", 5, "x", "y"), (None, None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars long, _host string, text string")
    assert sorted(str(r.text) for r in html.extract(pages).collect()) == ["", "a", "a"]
    assert html.extract(pages.where("false")).count() == 0


def test_suffix_tree(corpus, empty):
    rows = suffix_tree.score_texts(corpus).collect()
    words = {r.doc_id: bytes(c + 32 if 65 <= c <= 90 else c for c in (r.text or "").encode()).split() for r in corpus.collect()}
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 == 0
    counts = Counter()
    for r in corpus.collect():
        if not held(r.doc_id):
            counts.update([*words[r.doc_id], None])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        want = sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in [*words[r.doc_id], None])
        assert r.base_score == pytest.approx(want) and r.train_tokens == n and r.held_out == held(r.doc_id) and r.n_tokens == len(words[r.doc_id]) + 1
        assert r.n_known == sum(counts[w] > 0 for w in [*words[r.doc_id], None]) and r.score < 0
    assert suffix_tree.score_texts(empty).count() == 0


def test_suffix_tree_by_brute_force(corpus, spark):
    """Divergence tests and smoothing over plain dictionaries give the same score of every text, whatever is sent or joined."""
    rows = corpus.select("doc_id", "text").collect()
    depth, edge = suffix_tree.DEPTH, bytes([suffix_tree.EDGE])
    low = lambda t: bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode())
    coded = [edge * depth + b" ".join(re.findall(rb"[^ \t-\r]+", low(r.text))) + edge for r in rows]
    held = [zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 10 == 0 for r in rows]
    nexts = defaultdict(Counter)
    for x, out in zip(coded, held):
        for i in range(depth, 0 if out else len(x)):
            for d in range(depth + 1):
                nexts[x[i - d : i]][x[i]] += 1
    kept = {b""}
    for context, found in nexts.items():
        n, shorter = sum(found.values()), nexts[context[1:]]
        gain = sum(k * np.log(k / n / (shorter[s] / sum(shorter.values()))) for s, k in found.items())
        if context and gain > suffix_tree.GAIN_PER_SYMBOL * len(found):
            kept.add(context)

    def p(context, symbol):
        found, n = nexts[context], sum(nexts[context].values())
        if not context:
            return (found[symbol] + 0.5) / (n + 128)
        below = p(context[1:], symbol)
        return (found[symbol] + len(found) * below) / (n + len(found)) if context in kept else below

    assert len(kept) > 30 and sum(p(max(kept, key=len), s) for s in range(256)) == pytest.approx(1)
    want = sorted((str(r.doc_id), sum(np.log10(p(x[i - depth : i], x[i])) for i in range(depth, len(x)))) for r, x in zip(rows, coded))
    for sent in ({}, {"common_words": 40, "common_grams": 300}, {"common_words": 0, "common_grams": 0}):
        got = sorted((str(r.doc_id), r.score) for r in suffix_tree.score_texts(corpus, **sent).collect())
        assert [g[0] for g in got] == [w[0] for w in want] and [g[1] for g in got] == pytest.approx([w[1] for w in want])
    unlearnt = suffix_tree.score_texts(corpus, "false").collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in unlearnt)


def test_packing(corpus, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.tokenizer_file())
    tok.encode_special_tokens = True
    rows = packing.pack(corpus, queries.tokenizer_file(), queries.tokenizer_ranks()).collect()
    ids = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [1] for r in corpus.collect()}
    per, used = defaultdict(list), Counter()
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32 and len(ids[r.doc_id]) == r.doc_tokens
        per[r.sequence_id].append((r.offset, r.length))
        used[r.doc_id] += r.length
    assert all(used[i] == len(ids[i]) * (2 if i == 6 else 1) for i in ids)
    for parts in per.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(empty, queries.tokenizer_file()).count() == 0


def test_cutting_stock_is_tight():
    rng, demand = np.random.default_rng(5), np.zeros(256, int)
    for _ in range(800):  # 800 sequences that are full, cut into pieces
        cuts = np.sort(rng.choice(np.arange(1, 256), rng.integers(0, 5), replace=False))
        np.add.at(demand, np.diff([0, *cuts, 256]) - 1, 1)
    plan = packing.cutting_stock(demand, 256)
    assert np.array_equal(sum(p * n for p, n in plan), demand) and all((p * np.arange(1, 257)).sum() <= 256 for p, _ in plan)
    assert sum(n for _, n in plan) <= 1.03 * 800
    assert packing.cutting_stock(np.zeros(4, int), 4) == []


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, 0 if i in (26, 27) else 1, 0) for i in range(30)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def _statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    marked = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines, seen, again = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(marked)


def test_line_rules(corpus, labels, empty):
    texts = {r.doc_id: r.text or "" for r in corpus.collect()}
    model = crf.train_on_labels(corpus, labels)
    for r in line_rules.quality_rules(corpus, labels).collect():
        t = texts[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == _statistics(t)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        # Lines one by one through the model: content share and verdict.
        raw = np.frombuffer(t.encode(), np.uint8)
        table = crf.line_table(raw, np.array([0, len(raw)]))
        marks = crf.viterbi(model, table.features, table.first)
        chars = [len(re.sub(r"[\x20\x09-\x0D]", "", line)) for line in t.split("\n")]
        share = sum(c for c, m in zip(chars, marks) if m) / max(sum(chars), 1)
        assert r.content_share == pytest.approx(share) and r.kept == (not r.base_failed and share >= model.least_content)
    assert line_rules.quality_rules(empty, labels).count() == 0 and line_rules.keep_documents(corpus, labels).columns == corpus.columns
    assert line_rules.keep_documents(empty, labels).count() == 0


def test_long_words_and_lines_do_not_clash():
    """Thue-Morse words and their complements have equal polynomials mod 2^64."""
    a = bytearray(b"a")
    for _ in range(11):
        a += bytes(b"b"[0] if c == b"a"[0] else b"a"[0] for c in a)
    word = bytes(a).decode()
    other = word.translate(str.maketrans("ab", "ba"))
    raw = np.frombuffer(f"{word}\n{other}\n{word} {other}".encode(), np.uint8)
    table = crf.line_table(raw, np.array([0, len(raw)]))
    assert table.stats["n_dup_lines"][0] == 0
    from lodestar.llm import _text

    start, end, _ = _text.word_bounds(raw, np.array([0, len(raw)]))
    assert len(set(_text.word_hashes(raw, start, end).tolist())) == 2


def _planted(n=240):
    """Good documents of prose with some menu lines planted, bad ones of menus and symbols with some prose; labels of documents."""
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    prose = lambda: (" ".join(word() for _ in range(rng.randint(8, 16))).capitalize() + ".")
    junk = lambda: rng.choice([" | ".join(word() for _ in range(5)), " ".join(word() + "###" for _ in range(7)), (word() + " ") * 8])
    rows = []
    for i in range(n):
        good = i % 3 > 0
        kinds = [good if rng.random() < 0.85 else not good for _ in range(12)]
        rows.append((i, "\n".join(prose() if k else junk() for k in kinds), int(good), kinds))
    return rows


def test_lines_get_labels_of_their_own(spark):
    rows = _planted()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(10**6 + k, 0) for k in range(9000)], "doc_id long, quality int")
    model = crf.train_on_labels(docs, labels)
    marked, truth, both = [], [], 0
    for i, text, _, kinds in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        table = crf.line_table(raw, np.array([0, len(raw)]))
        got = crf.viterbi(model, table.features, table.first).astype(bool).tolist()
        marked, truth, both = marked + got, truth + kinds, both + (len(set(got)) == 2)
    marked, truth = np.array(marked), np.array(truth)
    assert (~marked & ~truth).sum() >= 0.95 * (~truth).sum() and (~marked & ~truth).sum() >= 0.95 * (~marked).sum()
    assert both >= 0.5 * len(rows)
    scored = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(scored[r[0]].held_out == (r in held) for r in rows) and np.mean([scored[r[0]].predicted == r[2] for r in held]) >= 0.95
    # Labels of held-out documents change nothing, nor do columns beside the text.
    flipped = spark.createDataFrame([(r[0], 1 - r[2] if r in held else r[2]) for r in rows], "doc_id long, quality int")
    wide = docs.withColumn("lang", F.lit("xx")).withColumn("_quality", F.lit(0)).withColumn("score", F.lit(9.0))
    once = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, quality int")
    assert sorted((r.doc_id, r.score) for r in quality.score_quality(wide, flipped).collect()) == sorted((r.doc_id, r.score) for r in quality.score_quality(docs, once).collect())
    few = crf.train_on_labels(docs, once, sample=60, runs=40)
    assert np.isfinite(few.emit).all()


def test_quality(corpus, labels, empty):
    rows = quality.score_quality(corpus, labels).collect()
    assert len(rows) == corpus.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    model = crf.train_on_labels(corpus, labels)
    for r in corpus.collect():
        raw = np.frombuffer((r.text or "").encode(), np.uint8)
        table = crf.line_table(raw, np.array([0, len(raw)]))
        good, _, _ = crf.forward_backward(model, table.features, table.first)
        weight = np.array([len(re.sub(r"[\x20\x09-\x0D]", "", line)) for line in (r.text or "").split("\n")]) + 1e-6
        want = 1 / (1 + np.exp(-(model.scale[0] * (weight * good).sum() / weight.sum() + model.scale[1])))
        assert any(s.score == pytest.approx(want) for s in rows if s.doc_id == r.doc_id)
    assert quality.score_quality(corpus, labels.where("1 = 0")).count() == len(rows) and quality.score_quality(empty, labels).count() == 0


def test_crf_passes_match_enumeration():
    rng = np.random.default_rng(4)
    model = crf.LineModel(rng.standard_normal(len(crf.FEATURES)), rng.standard_normal((2, 2)))
    features, first = rng.standard_normal((9, len(crf.FEATURES))), np.array([0, 4, 5, 9])
    good, _, _ = crf.forward_backward(model, features, first)
    best, score = crf.viterbi(model, features, first), model.scores(features)
    for lo, hi in zip(first[:-1], first[1:]):
        paths = [[b >> k & 1 for k in range(hi - lo)] for b in range(1 << (hi - lo))]
        value = np.array([sum(score[lo + k, y] for k, y in enumerate(p)) + sum(model.stay[a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert list(best[lo:hi]) == paths[int(value.argmax())]
        share = np.exp(value - value.max()) / np.exp(value - value.max()).sum()
        assert np.allclose(good[lo:hi], np.array(paths).T @ share)


def test_passages(corpus, empty):
    rows = passages.near_duplicate_passages(corpus).collect()
    pairs = {(r.doc_id, r.source_doc_id) for r in rows}
    # A text is linked to an earlier holder, which may itself be linked to the first one.
    assert {(1, 0), (2, 0), (5, 4)} <= pairs and {b for a, b in pairs if a == 3} & {0, 2} and all(a > b for a, b in pairs)
    flagged = {r.doc_id for r in rows}
    assert not flagged & set(range(7, 20))
    left = {r.doc_id: r.text for r in passages.drop_repeats(corpus).collect()}
    whole = {r.doc_id: r.text for r in corpus.collect()}
    assert 1 not in left and len(left[5].split()) <= 102 and all(left[i] == whole[i] for i in range(7, 20)) and left[4] == whole[4]
    assert passages.near_duplicate_passages(empty).count() == 0


def test_compact_windows_cover_every_stretch():
    rng = np.random.default_rng(6)
    tokens = rng.integers(0, 40, 160).astype(np.uint64)
    first = np.array([0, 70, 75, 160])
    key, text, left, right = passages.compact_windows(tokens, first, np.uint64(99), 12)
    from lodestar.llm._text import mix

    h = mix(tokens ^ np.uint64(99))
    for t in range(3):
        n = first[t + 1] - first[t]
        for i in range(n):
            for j in range(i + 11, n):
                inside = np.flatnonzero((text == t) & (left <= i) & (right >= j))
                low = h[first[t] + i : first[t] + j + 1] >> np.uint64(20)
                assert (key[inside] >> np.uint64(20) == low.min()).any()


def test_a_passage_whose_keys_go_to_holders_of_fragments(spark):
    rng = random.Random(11)
    make = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = make(60)
    texts = [make(50) + passage[k : k + 20] + make(50) for k in range(0, 41, 8) for _ in range(25)]
    texts += [make(50) + passage + make(30), make(20) + passage + make(80)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = passages.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    last = len(rows) - 1
    assert [(r.doc_id, r.source_doc_id, r.start_word, r.end_word, r.source_start) for r in got] == [(last, last - 1, 20, 80, 50)]


def test_near_passages_with_uneven_edits():
    rng = random.Random(5)
    shingles = lambda w: np.array([zlib.crc32(str(w[i : i + 5]).encode()) for i in range(len(w) - 4)], np.uint64)

    def covered(words, other):
        found = passages.verified_passages(shingles(words), shingles(other))
        assert all(e - s >= passages.MIN_SHINGLES and score >= passages.SIMILARITY for s, e, _, _, score in found)
        return {k for s, e, *_ in found for k in range(s, e)}

    for case in range(12):
        words = [rng.randrange(10**9) for _ in range(300)]
        edits = list(range(25, 200, 50)) + list(range(205, 300, 10)) if case == 0 else sorted(rng.sample(range(300), rng.randint(5, 25)))
        other = [-k - 1 if k in edits else w for k, w in enumerate(words)]
        same, want = shingles(words) == shingles(other), set()
        total = np.concatenate([[0], np.cumsum(same)])
        for s in np.flatnonzero(same):
            for e in np.flatnonzero(same) + 1:
                if e - s >= passages.MIN_SHINGLES and 1.8 * (total[e] - total[s]) >= 1.6 * (e - s) - 1e-9:
                    want |= set(range(s, e))
        got = covered(words, other)
        assert got == want and (case or len(got) >= 190)
    # A word more or less moves the rest of the passage.
    words = [rng.randrange(10**9) for _ in range(300)]
    other = words[:60] + [-1] + words[60:120] + words[121:180] + [-k for k in range(2, 20)] + words[198:]
    assert len(covered(words, other)) >= 270 - 20


def test_sharding(corpus, empty):
    rows = sharding.shard(corpus).collect()
    texts, per = {}, defaultdict(list)
    for r in rows:
        per[r.shard].append(r.slot)
        texts.setdefault((r.text_crc32, r["size"]), set()).add(r.shard)
    assert len(rows) == corpus.count() and all(sorted(s) == list(range(len(s))) for s in per.values()) and all(len(s) == 1 for s in texts.values())
    assert sharding.shard(empty).count() == 0


def test_shards_are_nearly_equal(spark):
    rng = random.Random(17)
    rows = [(i, "x" * int(rng.lognormvariate(6, 1)), 0) for i in range(3000)] + [(i, "copy " * 40, 0) for i in range(3000, 3100)] + [(4000, None, 0), (4000, None, 0), (None, "y", 0)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(3)).collect()
    total = Counter()
    for r in got:
        total[r.shard] += r["size"]
    mean = sum(total.values()) / 16
    assert len(got) == len(rows) and sorted(total) == list(range(16)) and max(total.values()) <= 1.01 * mean and min(total.values()) >= 0.97 * mean
    assert sum(total.values()) == sum(len(t or "") + 1 for _, t, _ in rows)


def test_best_fit_takes_the_tightest():
    rng = random.Random(7)
    items = [(rng.randint(1, 50), i) for i in range(300)]
    room, want = [], {}
    for size, i in sorted(items, key=lambda x: (-x[0], x[1])):
        fits = [(r, b) for b, r in enumerate(room) if r >= size]
        b = min(fits)[1] if fits else len(room)
        if not fits:
            room.append(100)
        room[b] -= size
        want[i] = b
    assert sharding.best_fit_decreasing(items, 100) == want


def test_pipeline_on_small_tables(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and max(r.offset + r.length for r in rows) <= 2048 and len(corpus_pipeline.STAGES) == 5


def test_every_pair_is_found_beside_holders_of_its_beginning(spark):
    """60 pairs share 60 words each; documents of smaller ids hold the first 45 of them, or nothing."""
    rng = random.Random(21)
    make = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = [make(60) for _ in range(60)]
    for some in ([], [make(30) + p[:45] + make(30) for p in shared]):
        texts = some + [make(rng.randint(20, 90)) + p + make(rng.randint(20, 90)) for p in shared for _ in range(2)]
        rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
        got = passages.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
        base = len(some)
        want = {(base + 2 * k + 1, base + 2 * k) for k in range(60)}
        covered = defaultdict(set)
        for r in got:
            covered[r.doc_id] |= set(range(r.start_word, r.end_word))
        assert {(r.doc_id, r.source_doc_id) for r in got} == want and all(len(c) == 60 for c in covered.values())


def test_exact_passages_by_brute_force(spark):
    """Every 50-word window that an earlier text has lies in found passages but for outer words; clean documents have none."""
    rng = random.Random(8)
    words = [f"v{k}" for k in range(3000)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    pool, texts = [make(rng.randint(50, 120)) for _ in range(12)], []
    for _ in range(150):
        text = make(rng.randint(10, 150))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(pool)
            k = rng.randint(0, len(p) - 50) if rng.random() < 0.5 else 0
            text += p[k:] + make(rng.randint(0, 80))
        texts.append(text)
    texts += [["same"] * 200, ["same"] * 90 + make(30), (make(12) * 20)[:200]]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = passages.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    covered, first, missed, n, words = defaultdict(set), {}, 0, 0, 0
    for r in got:
        covered[r.doc_id] |= set(range(r.start_word, r.end_word))
    for i, t in enumerate(texts):
        windows = {tuple(t[k : k + 50]): k for k in range(len(t) - 49)}
        hits = [k for k in range(len(t) - 49) if tuple(t[k : k + 50]) in first]
        n += len(hits)
        repeated = {w for k in hits for w in range(k, k + 50)}
        missed, words = missed + len(repeated - covered[i]), words + len(repeated)
        assert all(len(set(range(k, k + 50)) & covered[i]) >= 25 for k in hits)
        assert hits or not covered[i] or i >= 150
        for w in windows:
            first.setdefault(w, i)
    # A passage that a third text has longer than the linked one is not extended.
    assert n > 300 and missed <= 0.02 * words


def test_drop_repeats_cuts_the_right_text(spark):
    rng = random.Random(4)
    make = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    shared, alone, copy = make(80), make(90), make(60)
    rows = [(1, f"{shared} {make(20)}", 5, 7, 8, 9), (2, alone, 5, 7, 8, 9), (2, f"{make(20)} {shared}", 5, 7, 8, 9), (None, f"{shared} x", 5, 7, 8, 9), (3, copy, 5, 7, 8, 9), (4, copy, 5, 7, 8, 9), (4, copy, 5, 7, 8, 9), (5, None, 5, 7, 8, 9), (6, "a b", 5, 7, 8, 9), (7, "a b", 5, 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, _id long, _spans long, _text long").repartition(3)
    got = passages.drop_repeats(docs)
    left = sorted((str(r.doc_id), r.text and len(r.text.split()), r.n_chars == len(r.text or "") or r.n_chars == 5) for r in got.collect())
    assert got.columns == docs.columns and left == sorted([("1", 100, True), ("2", 90, True), ("2", 20, True), ("None", 81, True), ("3", 60, True), ("5", None, True), ("6", 2, True), ("7", 2, True)])
    assert passages.drop_repeats(docs.where("false")).count() == 0


def test_near_passages_are_found(spark):
    """Of 120 passages of 60 to 140 words with one word changed in 45, all but a few are found at similarity 0.8."""
    rng = random.Random(31)
    make = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(120):
        p = make(rng.randint(60, 140))
        q = list(p)
        for k in range(rng.randrange(10, 30), len(q), 45):
            q[k] = "changed"
        texts += [make(40) + p + make(40), make(25) + q + make(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = passages.near_duplicate_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {(r.doc_id, r.source_doc_id) for r in got} <= {(2 * k + 1, 2 * k) for k in range(120)} and len({r.doc_id for r in got}) >= 116
    assert all(r.similarity >= 0.8 and r.end_word - r.start_word >= 50 for r in got)


def test_holders_that_cannot_match_are_ruled_out_together(monkeypatch):
    """240 holders of two least tokens have about four fifths of their shingles in common with each other: few pairs are verified, none is lost."""
    rng = np.random.default_rng(12)
    base, rows = rng.integers(0, 2**32, 64, dtype=np.uint32), []
    for i in range(240):
        around = base.copy()
        if i % 40 == 20:
            around = rows[-7]["around"].copy()  # a near copy of an earlier one
        edits = rng.choice(np.r_[0:30, 34:64], 2 if i % 40 == 20 else 8, replace=False)
        around[edits] = rng.integers(0, 2**32, len(edits), dtype=np.uint32)
        if i % 60 == 30:
            around[40:44] = around[36:40]  # repeats
        rows.append({"key": 5, "ask": True, "text": 1000 + i, "doc": i, "lo": 31, "hi": 33, "left": 10, "right": 73, "around": around})
    want = set()
    for i, row in enumerate(rows):
        for other in rows[:i]:
            spans = passages.verified_passages(row["around"], other["around"])
            if spans:
                want.add((row["text"], row["doc"], other["text"], other["doc"], 10, 73, 10, 73))
            if any(s <= 31 and 33 < e for s, e, *_ in spans):
                break
    calls, verify = [], passages.verified_passages
    monkeypatch.setattr(passages, "verified_passages", lambda a, b: calls.append(1) or verify(a, b))
    table = pd.DataFrame([r | {"around": r["around"].tobytes(), "ask": ask} for r in rows for ask in (False, True)])
    found = passages.regrouped(table)
    assert set(map(tuple, found)) == want and len(want) >= 6 and len(calls) <= len(found) + 40
