"""Request routing and response parsing as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestar.functions import lexicon
from lodestar.functions.text import strip

OFF, ON = ["0", "false", "no", "off", ""], ["1", "true", "yes", "on", "always"]


def reject_reason(mode: Column, message: Column, images: Column, request_id: Column, disabled: tuple[str, ...] = ()) -> Column:
    """Null for a valid request; otherwise why it is rejected."""
    return (
        F.when(~mode.isin(*lexicon.MODES) | mode.isNull(), "unknown_mode")
        .when(mode.isin(*disabled) if disabled else F.lit(False), "disabled_mode")
        .when(F.length(message) > 65536, "message_too_long")
        .when(F.length(request_id) > 128, "request_id_too_long")
        .when((mode == "ocr") & (F.coalesce(F.size(images), F.lit(0)) <= 0), "image_missing")
    )


def audit_level(channel: Column, policy: dict[str, str], override: Column, allow_override: bool) -> Column:
    """Channel default (H2 without one); the override only where allowed and valid."""
    level = F.lit("H2")
    for name, value in policy.items():
        level = F.when(channel == name, value).otherwise(level)
    if not allow_override:
        return level
    return F.when((channel == "internal") & F.upper(override).isin("H0", "H1", "H2"), F.upper(override)).otherwise(level)


def audits_translation(flag: Column, specialist: Column) -> Column:
    flag = F.lower(strip(flag))
    return F.when(flag.isin(OFF), False).when(flag.isin(ON), True).when(flag.isin("specialist_only", "specialist"), specialist).otherwise(False)


def audits_answer(flag: Column, hits: Column) -> Column:
    flag = F.lower(strip(flag))
    return F.when(flag.isin(OFF), False).when(flag.isin(ON), True).when(flag.isin("hits", "auto", "on_demand"), hits > 0).otherwise(False)


def parse_audit(raw: Column) -> Column:
    """struct(original, translation, approved, issues, error) of a possibly fenced JSON object."""
    body = strip(F.regexp_replace(strip(raw), r"^```[a-zA-Z]*\s*|\s*```$", ""))
    fields = F.from_json(body, "map<string,string>")
    keys = F.map_keys(fields)
    complete = F.forall(F.array(*[F.lit(k) for k in ("original", "translation", "approved", "issues")]), lambda k: F.array_contains(keys, k))
    issues = F.from_json(fields["issues"], "array<string>")
    truth = ~F.coalesce(F.lower(fields["approved"]), F.lit("null")).isin("false", "0", "0.0", "", "null", "[]", "{}")
    error = F.when(fields.isNull(), "not_json").when(~complete, "missing_keys").when(issues.isNull(), "issues_not_list")
    ok = error.isNull()
    return F.struct(*[F.when(ok, v).alias(n) for n, v in (("original", fields["original"]), ("translation", fields["translation"]), ("approved", truth), ("issues", issues))], error.alias("error"))


def tagged_translation(raw: Column) -> Column:
    """struct(text, tag_missing): inside the first tag pair, else after the open tag, else the first line."""
    pair, after = (F.regexp_extract(raw, p, 1) for p in (r"(?s)<translation>(.*?)</translation>", r"(?s)<translation>(.*)$"))
    first = strip(F.split(strip(raw), "\n")[0])
    return F.when(raw.rlike(r"(?s)<translation>.*</translation>"), F.struct(strip(pair).alias("text"), F.lit(False).alias("tag_missing"))).when(
        raw.contains("<translation>"), F.struct(strip(after).alias("text"), F.lit(False).alias("tag_missing"))
    ).otherwise(F.struct(first.alias("text"), F.lit(True).alias("tag_missing")))


def parse_embeddings(raw: Column, dim: int) -> Column:
    """struct(vectors, error): a JSON list of {index, embedding} in index order, cut to `dim`; shorter is an error."""
    rows = F.from_json(raw, "array<struct<index:int,embedding:array<double>>>")
    short = F.exists(rows, lambda r: F.coalesce(F.size(r["embedding"]), F.lit(-1)) < dim)
    error = F.when(rows.isNull(), "not_a_list").when(short, "too_short")
    vectors = F.transform(F.array_sort(F.transform(rows, lambda r: F.struct(r["index"].alias("index"), r["embedding"].alias("embedding")))), lambda r: F.slice(r["embedding"], 1, dim))
    return F.struct(F.when(error.isNull(), vectors).alias("vectors"), error.alias("error"))


def decode_image(raw: Column) -> Column:
    """Bytes of strict base64, null if it is not."""
    return F.try_to_binary(raw, F.lit("base64"))


def flatten_hits(documents: Column, distances: Column, metadatas: Column) -> Column:
    """array<struct(text, distance, metadata)> of parallel arrays, without blank texts; bad distances are null."""
    rows = F.transform(documents, lambda d, i: F.struct(d.alias("text"), F.try_element_at(distances, i + 1).try_cast("double").alias("distance"), F.try_element_at(metadatas, i + 1).alias("metadata")))
    return F.filter(rows, lambda r: r["text"].isNotNull() & (strip(r["text"]) != ""))
