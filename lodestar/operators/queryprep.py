"""Query preparation over a table of questions: expansion, aliases, intent, class, boosts, terms.

Dictionaries are arguments. Small ones (the defaults in functions.lexicon) are dicts and become literal
arrays, so a table of questions of any size is one narrow projection. Large ones are tables: one automaton
finds all their words in the questions, and joins with the table do the rest (`*_by_table`).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions import lexicon, text
from lodestar.operators.search import containing


#: Alternatives with such a character are search terms too.
_CJK = "[一-鿿]"


def _strings(items) -> Column:
    return F.array(*[F.lit(i) for i in items]) if items else F.array().cast("array<string>")


def _longest(keys) -> list[str]:
    return sorted(keys, key=len, reverse=True)


def _when(condition: Column, items: Column) -> Column:
    return F.when(condition, items).otherwise(F.array().cast("array<string>"))


def expand_terms(query: Column, terms: dict[str, list[str]] | None = None) -> Column:
    terms = lexicon.TERMS if terms is None else terms
    found = [_when(query.contains(t), _strings(alts)) for t, alts in terms.items()]
    found += [_when(F.exists(_strings([a.lower() for a in alts]), lambda a: F.lower(query).contains(a)), _strings([t])) for t, alts in terms.items()]
    extra = F.array_sort(F.array_distinct(F.concat(*found))) if found else _strings([])
    return F.when(F.size(extra) > 0, F.concat_ws(" ", query, F.array_join(extra, " "))).otherwise(query)


def resolve_aliases(query: Column, aliases: dict[str, str] | None = None) -> Column:
    """query with the identifiers of its aliases appended; longer aliases win where spans overlap."""
    aliases = lexicon.ALIASES if aliases is None else aliases
    ordered = _longest(aliases)
    table = F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(aliases[a]).alias("id")) for a in ordered])
    spans = F.flatten(F.transform(F.filter(table, lambda a: query.contains(a["alias"])), lambda a: _alias_spans(query, a["alias"], a["id"])))
    return _with_ids(query, spans)


def _alias_spans(query: Column, alias: Column, id_: Column) -> Column:
    """All places of an alias in the query, overlapping ones included."""
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.length(query) - F.length(alias) + 1, F.lit(1))), lambda i: F.substring(query, i, F.length(alias)) == alias)
    return F.transform(starts, lambda i: F.struct((-F.length(alias)).alias("by"), i.alias("start"), (i + F.length(alias)).alias("stop"), id_.alias("id")))


def _apart(spans: Column) -> Column:
    """The spans in order, without those that overlap an earlier one kept."""
    return F.aggregate(spans, F.filter(spans, lambda s: F.lit(False)), lambda got, s: F.when(F.exists(got, lambda g: (g["start"] < s["stop"]) & (s["start"] < g["stop"])), got).otherwise(F.array_append(got, s)))


def _with_ids(query: Column, spans: Column) -> Column:
    ids = F.array_distinct(F.transform(_apart(F.array_sort(spans)), lambda s: s["id"]))
    return F.when(F.size(ids) > 0, F.concat_ws(" ", query, F.array_join(ids, " "))).otherwise(query)


def _found(queries: DataFrame, column: str, words: DataFrame, word: str) -> DataFrame:
    """query_id, word: the distinct words of a table that each query's text contains."""
    texts = queries.select(F.col("query_id").alias("id"), F.col(column).alias("text"))
    return containing(words.select(F.col(word).alias("term")), texts).select(F.col("id").alias("query_id"), F.col("term").alias(word))


def expand_terms_by_table(queries: DataFrame, column: str, terms: DataFrame, out: str) -> DataFrame:
    """`expand_terms` for a dictionary table (term, alt): adds `out` to queries (query_id and `column`)."""
    pairs = terms.select("term", "alt", F.lower("alt").alias("low"))
    by_term = _found(queries, column, pairs, "term").join(pairs, "term").select("query_id", F.col("alt").alias("extra"))
    by_alt = _found(queries.withColumn("_low", F.lower(column)), "_low", pairs, "low").join(pairs, "low").select("query_id", F.col("term").alias("extra"))
    extras = by_term.union(by_alt).groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("extra")), " ").alias("_extra"))
    return queries.join(extras, "query_id", "left").withColumn(out, F.concat_ws(" ", F.col(column), "_extra")).drop("_extra")


def resolve_aliases_by_table(queries: DataFrame, column: str, aliases: DataFrame, out: str) -> DataFrame:
    """`resolve_aliases` for a dictionary table (alias, id): adds `out` to queries (query_id and `column`)."""
    met = _found(queries, column, aliases, "alias").join(aliases.select("alias", "id"), "alias").join(queries.select("query_id", F.col(column).alias("_q")), "query_id")
    spans = met.select("query_id", F.inline(_alias_spans(F.col("_q"), F.col("alias"), F.col("id"))))
    held = spans.groupBy("query_id").agg(F.collect_list(F.struct("by", "start", "stop", "id")).alias("_spans"))
    none = F.array().cast("array<struct<by:int,start:int,stop:int,id:string>>")
    return queries.join(held, "query_id", "left").withColumn(out, _with_ids(F.col(column), F.coalesce("_spans", none))).drop("_spans")


def doctrine_terms_by_table(queries: DataFrame, column: str, terms: DataFrame, out: str, extras=None) -> DataFrame:
    """`expand_doctrine_terms` for a dictionary table (no, term, alts): adds `out` to queries (query_id and `column`).

    `no` orders terms of one length; alts is the array of a term's alternatives.
    """
    met = _found(queries, column, terms, "term").join(terms.select("no", "term", "alts"), "term").join(queries.select("query_id", F.col(column).alias("_q")), "query_id")
    start, n = F.position(F.col("term"), F.col("_q")), F.length("term")
    with_alts = F.concat(F.array("term"), F.filter("alts", lambda a: a.rlike(_CJK)))
    held = met.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-n).alias("by"), "no", start.alias("start"), (start + n).alias("stop"), with_alts.alias("all")))).alias("_spans"))
    none = F.array().cast(dict(held.dtypes)["_spans"])
    found = F.flatten(F.transform(_apart(F.coalesce("_spans", none)), lambda s: s["all"]))
    return queries.join(held, "query_id", "left").withColumn(out, _doctrine(F.col(column), found, extras)).drop("_spans")


def detect_intent(query: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, pattern in lexicon.INTENTS:
        out = out.when(query.rlike(pattern), name)
    return out.otherwise("doctrine")


def preprocess(queries: DataFrame, column: str = "question", default_series: str = "T", terms=None, aliases=None) -> DataFrame:
    """Adds original, normalized, canon_ids, canon_prefixes, intent, series_hint.

    terms and aliases are dicts or tables (term, alt) and (alias, id); with tables, queries has query_id.
    """
    asked = queries.withColumn("original", text.strip(F.col(column)))
    expanded = expand_terms_by_table(asked, "original", terms, "_expanded") if isinstance(terms, DataFrame) else asked.withColumn("_expanded", expand_terms(F.col("original"), terms))
    named = resolve_aliases_by_table(expanded, "_expanded", aliases, "normalized") if isinstance(aliases, DataFrame) else expanded.withColumn("normalized", resolve_aliases(F.col("_expanded"), aliases))
    appended = F.array_distinct(F.concat(F.filter(F.split(F.substring(F.col("normalized"), F.length("_expanded") + 1, F.length("normalized")), " "), lambda x: x != ""), F.transform(text.all_ids(F.col("normalized")), F.upper)))
    ids = named.withColumn("canon_ids", appended).withColumn("canon_prefixes", text.id_prefixes(F.col("canon_ids")))
    hint = F.coalesce(F.try_element_at("canon_prefixes", F.lit(1)), F.try_element_at("canon_ids", F.lit(1)))
    return ids.withColumn("intent", detect_intent(F.col("_expanded"))).withColumn("series_hint", F.coalesce(F.substring(hint, 1, 1), F.lit(default_series))).drop("_expanded")


def strip_filler(query: Column, fillers=None) -> Column:
    out = F.regexp_replace(text.strip(query), "[？?]+$", "")
    for filler in lexicon.FILLERS if fillers is None else fillers:
        out = F.replace(out, F.lit(filler), F.lit(""))
    return F.btrim(out, F.lit("？? 的"))


def boost_prefixes(query: Column, boosts=None) -> Column:
    boosts = lexicon.BOOSTS if boosts is None else boosts
    return F.array_distinct(F.concat(*[_when(query.contains(t), _strings(boosts[t])) for t in _longest(boosts)]))


def expand_doctrine_terms(query: Column, terms=None, extras=None) -> Column:
    """Dictionary terms (longest first, overlapping ones skipped) with their CJK alternatives, then the
    triggered extras, else the question without fillers, else the question."""
    terms = lexicon.TERMS if terms is None else terms
    table = F.array(*[F.struct(F.lit(t).alias("term"), _strings([t] + [a for a in terms[t] if re.search(_CJK, a)]).alias("all")) for t in _longest(terms)])
    spans = F.transform(F.filter(table, lambda a: query.contains(a["term"])), lambda a: F.struct(F.position(a["term"], query).alias("start"), (F.position(a["term"], query) + F.length(a["term"])).alias("stop"), a["all"].alias("all")))
    return _doctrine(query, F.flatten(F.transform(_apart(spans), lambda s: s["all"])), extras)


def _doctrine(query: Column, terms: Column, extras=None) -> Column:
    """Found terms, then the triggered extras, else the question without fillers, else the question."""
    found = [terms]
    for triggers, more in lexicon.EXTRAS if extras is None else extras:
        found.append(_when(F.exists(_strings(triggers), lambda t: query.contains(t)), _strings(more)))
    out = F.array_distinct(F.concat(*found))
    stripped = strip_filler(query)
    return F.when(F.size(out) > 0, out).when(stripped != "", F.array(stripped)).otherwise(F.array(query))


def expand_scoped_terms(query: Column, aliases=None, fillers=None) -> Column:
    aliases = lexicon.ALIASES if aliases is None else aliases
    spaced = query
    for filler in lexicon.FILLERS if fillers is None else fillers:
        spaced = F.replace(spaced, F.lit(filler), F.lit(" "))
    parts = F.filter(F.split(text.strip(spaced), r"(?U)\s+"), lambda p: F.length(p).between(2, 8))
    named = F.filter(_strings(_longest(aliases)), lambda a: query.contains(a))
    out = F.slice(F.array_distinct(F.concat(named, parts)), 1, 5)
    return F.when(F.size(out) > 0, out).otherwise(F.array(F.substring(query, 1, 8)))


def plan_queries(queries: DataFrame, boosts=None, terms=None, aliases=None, fillers=None) -> DataFrame:
    """Adds query_type, vec_top, bm25_top, fuse_top, rerank_top, boost_prefixes, sub_terms, embed_text."""
    n = F.size("canon_prefixes")
    kind = F.when(n == 1, "A").when(n > 1, "C").otherwise("D")
    open_ = F.col("query_type") == "D"
    out = queries.withColumn("query_type", kind)
    for name, scoped, wide in (("vec_top", 20, 40), ("bm25_top", 20, 40), ("fuse_top", 30, 50), ("rerank_top", 5, 10)):
        out = out.withColumn(name, F.when(open_, wide).otherwise(scoped))
    out = out.withColumn("boost_prefixes", F.when(open_, boost_prefixes(F.col("original"), boosts)).otherwise(F.array().cast("array<string>")))
    out = out.withColumn("sub_terms", F.when(open_, expand_doctrine_terms(F.col("original"), terms)).otherwise(expand_scoped_terms(F.col("original"), aliases, fillers)))
    return out.withColumn("embed_text", F.when(open_, F.col("original")).otherwise(F.col("normalized")))
