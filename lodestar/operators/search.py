"""Exact vector search, token search and substring search over tables of queries."""

from __future__ import annotations

import re
import uuid
from bisect import insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.text import has_prefix
from lodestar.operators.nearest import Nearest, held_queries, pass_by, scopes, slices, vectors_of
from lodestar.session import attach, stored

#: Queries up to this number are sent to every task; the corpus passes by blocks of larger tables.
QUERY_BLOCK = 2000
#: Vectors of the corpus that meet a block of queries at a time.
ROW_BLOCK = 16384
#: Terms of one automaton; more terms take another scan of the corpus.
TERM_BLOCK = 500_000
OVER_FETCH = 200


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; null for zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(hits: DataFrame, by: list[Column], k: Column | int, keys: tuple[str, ...] = ("query_id",), out: str = "rank") -> DataFrame:
    """The first k rows per key with their 1-based position; k may be a column of the rows."""
    return hits.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col(out) <= k)


def row_masks(queries: pd.DataFrame, rows: pd.DataFrame) -> Callable[[int], np.ndarray | None]:
    """For the q-th query: which rows are of its `series` and begin with one of its `prefixes` (None: all).

    Queries without a series or without prefixes meet all rows. Prefixes are compared once with each
    distinct canon_id of the rows, whatever the number of queries that share them.
    """
    series = rows["series"].to_numpy() if "series" in queries.columns else None
    wanted = queries["series"].to_list() if series is not None else None
    scopes = queries["prefixes"].to_list() if "prefixes" in queries.columns else None
    code, names = pd.factorize(rows["canon_id"].str.upper()) if scopes is not None else (None, [])
    known: dict = {}

    def mask(q: int) -> np.ndarray | None:
        own = wanted[q] if wanted is not None and not pd.isna(wanted[q]) else None
        heads = tuple(p.upper() for p in scopes[q]) if scopes is not None and scopes[q] is not None else ()
        if own is None and not heads:
            return None
        if (own, heads) not in known:
            ok = np.ones(len(rows), bool) if own is None else series == own
            if heads:
                ok = ok & np.array([n.startswith(heads) for n in names] + [False])[code]
            known[own, heads] = ok
        return known[own, heads]

    return mask


_NEAR = "query_id long, id long, distance double"


class _Ranking:
    """The nearest chunks of a task's queries among those that have passed by.

    A query's series and prefixes, where it has such columns, are tested here: no key of the scope is
    shuffled, so a prefix that the whole corpus has is no hot key. `after`: prefixes rule out no chunk,
    but what has one of them is marked (column fits).
    """

    def __init__(self, asked: pa.Table, most: int, after: bool) -> None:
        self.ids = asked["query_id"].to_numpy()
        scope = asked.select([c for c in ("series", "prefixes") if c in asked.column_names]).to_pandas()
        self.after, self.scope = after, scope.drop(columns="prefixes") if after else scope
        if after:
            heads = [None if p is None else tuple(x.upper() for x in p if x is not None) for p in scope["prefixes"]]
            self.head, self.heads = pd.factorize(pd.Series(heads, dtype=object), use_na_sentinel=False)
        self.groups = scopes(self.scope)
        self.nearest = Nearest(vectors_of(asked["vector"]), most, extra=after)

    def meet(self, rows: pa.Table) -> None:
        chunks = rows.drop_columns("embedding").to_pandas()
        mask = row_masks(self.scope, chunks)
        met = [(at, None if at is None or (ok := mask(at[0])) is None else np.flatnonzero(ok)) for at in self.groups]
        fits = self._fits(chunks["canon_id"]) if self.after else None
        self.nearest.meet(chunks["id"].to_numpy(), vectors_of(rows["embedding"]), met, fits)

    def _fits(self, canon: pd.Series) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        code, names = pd.factorize(canon.str.upper())
        names, n = [*names, None], len(names) + 1  # code -1 is the last one: null

        def one(pair: int) -> bool:
            heads, name = self.heads[pair // n], names[pair % n]
            return heads is not None and heads == heads and (heads == () or name is not None and name.startswith(heads))

        def fits(q: np.ndarray, i: np.ndarray) -> np.ndarray:
            pairs, at = np.unique(self.head[q] * n + code[i] % n, return_inverse=True)
            return np.array([one(p) for p in pairs.tolist()], float)[at]

        return fits

    def found(self, keep: int | None = None) -> Iterator[pa.RecordBatch]:
        """keep: so many of a query that fit, and no others."""
        cut = keep is not None and self.after
        for q, ids, distance, fits in self.nearest.found(only_extra=cut, keep=keep if cut else None):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (self.ids[q], ids, distance, *([fits != 0] if self.after else []))], ["query_id", "id", "distance"] + ["fits"] * self.after)


def _nearest(queries: DataFrame, chunks: DataFrame, most: int, after: bool = False, keep: int | None = None) -> DataFrame:
    """The `most` nearest chunks of each query: few queries are sent to all tasks, each of which gives its own; of many,
    each task holds a block, and all chunks pass by, so that it gives the nearest of all.

    `after`: prefixes only mark what fits; of many queries' chunks, only the first `keep` that fit are given.
    """
    scope = [own for c, own in (("series", "series"), ("prefixes", "canon_id")) if c in queries.columns]
    light = chunks.where("embedding is not null").select("id", "embedding", *scope)
    queries = queries.where("vector is not null")
    asked, schema = queries.limit(QUERY_BLOCK + 1).toArrow(), _NEAR + ", fits boolean" * after
    if len(asked) <= QUERY_BLOCK:

        def local(batches):
            ranking = _Ranking(asked, most, after)
            for batch in batches:
                for part in slices(batch):
                    ranking.meet(pa.Table.from_batches([part]))
            yield from ranking.found()

        return light.mapInArrow(local, schema)

    class Whole(_Ranking):
        def __init__(self, asked: pa.Table) -> None:
            super().__init__(asked, most, after)

        def found(self) -> Iterator[pa.RecordBatch]:
            return super().found(keep)

    return pass_by(queries, light, held_queries(most, len(asked["vector"][0])), Whole, schema, ROW_BLOCK)


def vector_search(queries: DataFrame, chunks: DataFrame, k: int = 20, prefixes: bool = False, mode: str = "postfilter") -> DataFrame:
    """query_id, id, distance, rank: the k nearest chunks of each query by cosine distance, ties by id.

    queries: query_id, vector and optionally series, prefixes (array), k (per-query limit). With
    prefixes, "postfilter" filters the nearest 200 and "prefilter" ranks only matching chunks. Queries
    up to QUERY_BLOCK are sent to all tasks, and each keeps its k best; of more, each task holds a block
    that the whole corpus passes by. The corpus is not shuffled.
    """
    attach(queries.sparkSession)
    own_k, after = "k" in queries.columns, prefixes and mode != "prefilter"
    light = queries.select(*[c for c in ("query_id", "vector", "series") if c in queries.columns], *(["prefixes"] if prefixes else []))
    most = queries.agg(F.max("k")).first()[0] or k if own_k else k
    near = _nearest(light, chunks, OVER_FETCH if after else most, after, most)
    if after:
        near = top_k(near, [F.col("distance"), F.col("id")], OVER_FETCH).where("fits").select("query_id", "id", "distance")
    if own_k:
        return top_k(near.join(queries.select("query_id", "k"), "query_id"), [F.col("distance"), F.col("id")], F.col("k")).select("query_id", "id", "distance", "rank")
    return top_k(near, [F.col("distance"), F.col("id")], k).select("query_id", "id", "distance", "rank")


def query_collection(queries: DataFrame, store: DataFrame, collection: str, n: int = 8) -> DataFrame:
    """query_id, id, distance, rank: the n nearest rows of a named collection (column `collection` of `store`), without other filters."""
    return vector_search(queries.select("query_id", "vector"), store.where(F.col("collection") == collection), n)


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_tokens(queries: DataFrame) -> DataFrame:
    """query_id, token: the distinct tokens of each query."""
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("token"))


def token_scope(queries: DataFrame) -> list[str]:
    """The columns of the chunks that the queries' series and prefixes are compared with."""
    return [c for c, own in (("series", "series"), ("canon_id", "prefixes")) if own in queries.columns]


def rank_postings(queries: DataFrame, postings: DataFrame, n: int, average: float | None, k: int, match: str, k1: float, b: float) -> DataFrame:
    """query_id, id, score, rank by BM25 from the postings (token, id, _tf, _size and the scope's columns) of the queries' tokens.

    n and average: the number of chunks and their mean size in tokens.
    """
    scope, asked = token_scope(queries), query_tokens(queries)
    need = asked.groupBy("query_id").agg(F.count("*").alias("_need"))
    held = postings.groupBy("token").agg(F.count("*").alias("_df"))
    idf = F.log(1 + (F.lit(n) - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    part = idf * F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_size") / F.lit(average or 1.0)))
    weighed = asked.join(held, "token")
    if match == "all":
        # Chunks with a query's rarest token are the candidates; its other tokens are looked up for those alone.
        rarest = weighed.groupBy("query_id").agg(F.min_by("token", F.struct("_df", "token")).alias("token"))
        candidates = rarest.join(postings.select("token", "id"), "token").select("query_id", "id")
        met = candidates.join(weighed, "query_id").join(postings, ["token", "id"])
    else:
        met = weighed.join(postings, "token")
    scored = met.groupBy("query_id", "id", *scope).agg(F.round(F.sum(part), 9).alias("score"), F.count("*").alias("_got")).join(need, "query_id")
    kept = scored.where(F.col("_got") == F.col("_need")) if match == "all" else scored
    own = [c for c in ("k", "series", "prefixes") if c in queries.columns]
    if own:
        kept = kept.join(queries.select("query_id", *[F.col(c).alias(f"_{c}") for c in own]), "query_id")
        if "series" in own:
            kept = kept.where(F.col("_series").isNull() | (F.col("series") == F.col("_series")))
        if "prefixes" in own:
            kept = kept.where((F.size("_prefixes") == 0) | has_prefix(F.col("canon_id"), F.col("_prefixes")))
    return top_k(kept, [F.col("score").desc(), F.col("id")], F.col("_k") if "k" in own else k).select("query_id", "id", "score", "rank")


def token_search(queries: DataFrame, chunks: DataFrame, k: int = 20, match: str = "all", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, id, score, rank by BM25 (rounded to 9 places, so that ties are ties in any order of
    summation) over chunks that hold all (or any) of the query's tokens.

    queries: query_id, query and optionally k (per-query limit), series, prefixes: chunks outside a
    query's series or prefixes are left out before the limit. Only the queries' distinct tokens are
    looked up: one scan counts them per chunk, together with the sizes, and the corpus' other tokens
    never leave it. `text_index.search_tokens` does the same on a written token table.
    """
    scope = token_scope(queries)
    # The empty token stands for the chunk itself: its row carries the size into the statistics.
    wanted = query_tokens(queries).select("token").union(queries.sparkSession.createDataFrame([("",)], "token string")).distinct()
    sized = chunks.select("id", *scope, tokens(F.col("text")).alias("_tokens"))
    every = sized.select("id", *scope, F.size("_tokens").alias("_size"), F.explode(F.concat("_tokens", F.array(F.lit("")))).alias("token"))
    found = every.join(wanted, "token", "left_semi").groupBy("token", "id").agg(F.count("*").alias("_tf"), F.first("_size").alias("_size"), *[F.first(c).alias(c) for c in scope])
    found = stored(found, "postings")
    n, average = found.where("token = ''").agg(F.count("*"), F.avg("_size")).first()
    return rank_postings(queries, found.where("token <> ''"), n, average, k, match, k1, b)


def like_pattern(term: str) -> tuple[str, re.Pattern | None]:
    """The longest literal part of a term with % and _ as wildcards (a backslash takes the next character
    as it is), and the whole as a pattern (None without wildcards)."""
    parts, pattern, k = [""], "", 0
    while k < len(term):
        c = term[k]
        if c in "%_":
            parts.append("")
            pattern += ".*" if c == "%" else "."
        else:
            k += c == "\\" and k + 1 < len(term)
            parts[-1] += term[k]
            pattern += re.escape(term[k])
        k += 1
    return max(parts, key=len), re.compile(pattern, re.DOTALL) if len(parts) > 1 else None


class Finder:
    """Terms by the literal that a text must hold for each: one automaton finds those of all at once."""

    def __init__(self, terms: list[str], like: bool = False) -> None:
        import ahocorasick

        literals: dict[str, list[int]] = {}
        self.patterns: list[re.Pattern | None] = []
        for n, term in enumerate(terms):
            literal, pattern = like_pattern(term) if like else (term, None)
            self.patterns.append(pattern)
            literals.setdefault(literal, []).append(n)
        self.automaton, self.groups = ahocorasick.Automaton(), [literals.pop("", [])]
        for literal, owners in literals.items():
            self.automaton.add_word(literal, len(self.groups))
            self.groups.append(owners)
        if len(self.automaton):
            self.automaton.make_automaton()

    def found(self, text: str) -> Iterator[int]:
        """Numbers of the terms that the text contains."""
        groups = {0} | ({g for _, g in self.automaton.iter(text)} if len(self.automaton) else set())
        for g in groups:
            for n in self.groups[g]:
                if self.patterns[n] is None or self.patterns[n].search(text):
                    yield n


_finders: dict[str, Finder] = {}


def _finder(key: str, terms, like: bool) -> Finder:
    """The finder of a block of terms (a broadcast), built once in each worker."""
    if key not in _finders:
        _finders.clear()
        _finders[key] = Finder(terms.value, like)
    return _finders[key]


def _term_blocks(terms: DataFrame, columns: list[str]) -> Iterator[list]:
    """The distinct rows of `columns` in blocks of about TERM_BLOCK at most."""
    distinct = terms.select(*columns).where("term is not null").distinct()
    blocks = max(1, -(-distinct.count() // TERM_BLOCK))
    for block in range(blocks):
        yield distinct.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == block).collect()


def containing(terms: DataFrame, chunks: DataFrame) -> DataFrame:
    """(term, id) of every distinct non-null term (column `term`) and chunk (id, text) that contains it.

    One pass over the texts finds all terms of a block at once with an automaton; the empty term is in
    every text.
    """
    spark, out = attach(chunks.sparkSession), None
    for rows in _term_blocks(terms, ["term"]):
        sent, key = spark.sparkContext.broadcast([r.term for r in rows]), uuid.uuid4().hex

        def search(frames, sent=sent, key=key):
            finder, words = _finder(key, sent, False), sent.value
            for pdf in frames:
                hits, ids = [], []
                for id_, text in zip(pdf["id"], pdf["text"]):
                    if text is not None:
                        got = list(finder.found(text))
                        hits += got
                        ids += [id_] * len(got)
                if hits:
                    yield pd.DataFrame({"term": [words[k] for k in hits], "id": ids})

        part = chunks.select("id", "text").mapInPandas(search, f"term string, id {chunks.schema['id'].dataType.simpleString()}")
        out = part if out is None else out.union(part)
    return out


def keyword_search(terms: DataFrame, chunks: DataFrame, k: int = 10, like: bool = False) -> DataFrame:
    """query_id, term, id, rank: the first k chunks (by id) that contain each term.

    terms may have series and scope (array of prefixes): other chunks are left out before the limit.
    `like` takes % and _ as wildcards; a text is then searched for the longest literal part of each term
    and compared with those only whose part it has. Every task keeps the k smallest ids of each term and
    scope, so it emits k rows for each at most, however often they occur.
    """
    spark = attach(chunks.sparkSession)
    own = [c for c in ("series", "scope") if c in terms.columns]
    keyed = terms.select("query_id", F.xxhash64("term", *own).alias("ask"), "term", *own)
    columns = ["id", "text", *[c for c, o in (("series", "series"), ("canon_id", "scope")) if o in own]]
    found = None
    for rows in _term_blocks(keyed, ["ask", "term", *own]):
        sent, key = spark.sparkContext.broadcast([r.term for r in rows]), uuid.uuid4().hex
        limits = spark.sparkContext.broadcast([(r.ask, r.series if "series" in own else None, tuple(p.upper() for p in r.scope or ()) if "scope" in own else ()) for r in rows])

        def search(frames, sent=sent, limits=limits, key=key):
            finder, asks, best = _finder(key, sent, like), limits.value, {}
            for pdf in frames:
                n = len(pdf)
                series = pdf["series"].to_list() if "series" in own else [None] * n
                canon = pdf["canon_id"].to_list() if "scope" in own else [None] * n
                for id_, text, s, c in zip(pdf["id"].to_list(), pdf["text"], series, canon):
                    if text is None:
                        continue
                    for at in finder.found(text):
                        _, only, heads = asks[at]
                        held = best.setdefault(at, [])
                        if len(held) == k and id_ >= held[-1] or only is not None and s != only or heads and not (c or "").upper().startswith(heads):
                            continue
                        if id_ not in held:
                            insort(held, id_)
                            del held[k:]
            words = sent.value
            out = [(asks[at][0], words[at], id_) for at, held in best.items() for id_ in held]
            yield pd.DataFrame(out, columns=["ask", "term", "id"])

        part = chunks.select(*columns).mapInPandas(search, f"ask long, term string, id {chunks.schema['id'].dataType.simpleString()}")
        found = part if found is None else found.union(part)
    met = found.join(keyed.select("query_id", "ask", "term"), ["ask", "term"])
    return top_k(met.select("query_id", "term", "id").distinct(), [F.col("id")], k, ("query_id", "term"))
