"""Column functions on text: coordinates, identifiers, scripts, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions import lexicon

ID = r"(?<![\p{L}\p{N}_])([A-Za-z]{1,3}\d+[nN]\d+[a-zA-Z]?)(?![\p{L}\p{N}_])"
SHORT_ID = r"(?<![\p{L}\p{N}_])[Tt](\d{2})[nN]?(\d{3,4})(?![\p{L}\p{N}_])"
CITATION = r"【([A-Za-z]{1,3}\d+[nN]\d+[a-zA-Z]?_[^】]+)】"


def strip(c: Column) -> Column:
    """Trim Unicode white space, U+3000 included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def nullif_empty(c: Column) -> Column:
    return F.when(c != "", c)


def parse_line(raw: Column) -> Column:
    """struct(coord, text): split at the first ##; without one coord is null."""
    at = F.instr(raw, "##")
    return F.when(at > 0, F.struct(strip(F.substring(raw, F.lit(1), at - 1)).alias("coord"), strip(F.substring(raw, at + 2, F.length(raw))).alias("text"))).otherwise(
        F.struct(F.lit(None).cast("string").alias("coord"), strip(raw).alias("text"))
    )


def canon_id_from_coord(coord: Column) -> Column:
    return F.upper(F.coalesce(nullif_empty(F.regexp_extract(coord, r"(?i)^([A-Z]{1,3}\d+n\d+[a-zA-Z]?)_", 1)), F.split(coord, "_")[0]))


def normalize_id(raw: Column) -> Column:
    full = F.upper(F.regexp_extract(raw, ID, 1))
    volume, number = F.regexp_extract(raw, SHORT_ID, 1), F.regexp_extract(raw, SHORT_ID, 2)
    return F.coalesce(nullif_empty(full), F.when(volume != "", F.concat(F.lit("T"), volume, F.lit("N"), number)))


def id_prefixes(ids: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(ids, normalize_id), lambda x: x.isNotNull()))


def all_ids(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(ID), 1)


def has_prefix(canon_id: Column, prefixes: Column) -> Column:
    return F.exists(prefixes, lambda p: F.startswith(F.upper(canon_id), F.upper(p)))


def id_in_query(query: Column, canon_id: Column) -> Column:
    return F.array_contains(F.transform(all_ids(query), F.upper), F.upper(canon_id))


def volume_number(canon_id: Column) -> Column:
    return F.when(F.startswith(F.upper(canon_id), F.lit("T")), F.substring(canon_id, 2, 2).try_cast("int"))


def reader_link(text: Column, template: str) -> Column:
    """First identifier of the text put into `template` at {id}; null without one."""
    head, tail = template.split("{id}")
    found = F.upper(F.regexp_extract(text, ID, 1))
    return F.when(found != "", F.concat(F.lit(head), found, F.lit(tail)))


def citation_coord(raw: Column) -> Column:
    return F.concat(F.regexp_replace(strip(raw), "_+$", ""), F.lit("_"))


def citations(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CITATION), 1)


def ids_match(expected: Column, got: Column) -> Column:
    one, two = (F.coalesce(normalize_id(c), F.upper(strip(c))) for c in (expected, got))
    return (one == two) | F.startswith(two, one)


def glyph_count(text: Column, span: tuple[int, int] = lexicon.SPECIALIST_RANGE) -> Column:
    return F.regexp_count(text, F.lit(f"[\\x{{{span[0]:X}}}-\\x{{{span[1]:X}}}]"))


def glyph_ratio(text: Column, span: tuple[int, int] = lexicon.SPECIALIST_RANGE) -> Column:
    size = F.greatest(F.length(F.replace(text, F.lit("\n"), F.lit(""))), F.lit(1))
    return F.when(strip(text) == "", F.lit(0.0)).otherwise(glyph_count(text, span) / size)


def is_specialist(text: Column, span=lexicon.SPECIALIST_RANGE, count: int = 8, ratio: float = 0.4) -> Column:
    return (glyph_count(text, span) >= count) | (glyph_ratio(text, span) >= ratio)


def is_greeting(text: Column, channel: Column) -> Column:
    return channel.isin("web", "telegram") & text.rlike(lexicon.GREETING)


def expert_profile(text: Column, span=lexicon.SPECIALIST_RANGE) -> Column:
    out = F.when(glyph_count(text, span) >= 4, "tibetan")
    for name, pattern in lexicon.PROFILES:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise("default")


def profile_temperature(profile: Column, base: float = 0.2) -> Column:
    return F.greatest(F.lit(0.05), F.least(F.lit(0.45), F.lit(base) + F.when(profile == "tibetan", 0.03).otherwise(0.0)))


def cache_key(text: Column, version: str | None = None) -> Column:
    return F.sha2(strip(text) if version is None else F.concat(F.lit(f"{version}:"), strip(text)), 256)


def snippet_key(text: Column) -> Column:
    return F.substring(strip(text), 1, 320)
