"""Batch model work: embedding, scoring and text inference with user functions; flows built on them."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import tasks, text
from lodestar.operators.state import memory_lookup
from lodestar.session import attach, finished_folders, shared_folder, unique_name


def embed(df: DataFrame, column: str = "text", role: str = "passage", dim: int = 2048, encoder: Callable[[pd.Series], pd.Series] | None = None, prompts: dict[str, str] | None = None, errors: str | None = None) -> DataFrame:
    """Adds embedding (L2-normalised, `dim` wide). `encoder` maps texts to vectors batch by batch;
    without one, hashed token counts are used, which need no model.

    A failing encoder fails the job, unless `errors` names a column for its message: then a batch that
    fails is asked row by row, and rows that fail have no embedding.
    """
    prompt = F.lit((prompts or {"passage": "", "query": "query: "}).get(role, ""))
    if encoder is None:
        stages = [RegexTokenizer(inputCol="_in", outputCol="_tokens", pattern=r"[^\p{L}\p{N}]+"), HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dim), Normalizer(inputCol="_tf", outputCol="_unit", p=2.0)]
        source = df.withColumn("_in", F.coalesce(F.col(column), F.lit("")))
        done = Pipeline(stages=stages).fit(source).transform(source).withColumn("embedding", vector_to_array("_unit", "float32")).drop("_in", "_tokens", "_tf", "_unit")
        return done if errors is None else done.withColumn(errors, F.lit(None).cast("string"))

    def tried(texts: pd.Series) -> pd.DataFrame:
        try:
            return pd.DataFrame({"v": encoder(texts), "e": None})
        except Exception as e:  # the model's failure is data here
            if len(texts) == 1:
                return pd.DataFrame({"v": [None], "e": [f"{type(e).__name__}: {e}"]})
            return pd.concat([tried(texts.iloc[k : k + 1]) for k in range(len(texts))], ignore_index=True)

    text_in = F.concat(prompt, F.coalesce(F.col(column), F.lit("")))
    if errors is not None:
        df = df.withColumn("_tried", F.pandas_udf(tried, "v array<double>, e string")(text_in)).withColumn(errors, F.col("_tried.e"))
    call = F.pandas_udf(lambda s: encoder(s), "array<double>")
    raw = F.slice(F.col("_tried.v") if errors is not None else call(text_in), 1, dim)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return df.withColumn("_raw", raw).withColumn("embedding", F.transform("_raw", lambda x: F.try_divide(x, norm(F.col("_raw"))).cast("float"))).drop("_raw", "_tried")


def pair_scorer(fn: Callable[[pd.Series, pd.Series], pd.Series]):
    """A scorer for rerank() from a batch function of (queries, texts); where it fails, scores are null."""

    def scores(queries: pd.Series, texts: pd.Series) -> pd.Series:
        try:
            return fn(queries, texts)
        except Exception:  # rerank() then keeps the order it was given
            return pd.Series([None] * len(queries), dtype=float)

    return F.pandas_udf(scores, "double")


def infer(df: DataFrame, column: str, fn: Callable[[str], str], out: str = "output", attempts: int = 3, wait: float = 2.0, most_wait: float = 10.0, calls: int = 1, second: str | None = None) -> DataFrame:
    """Adds `out` and `{out}_error`: fn per row, retried with growing waits; errors become a column.

    `calls` is how many calls a task makes at a time; answers keep the order of the rows. `second` names a
    column whose value is fn's second argument.
    """
    attach(df.sparkSession)

    def one(value, *more):
        pause = wait
        for n in range(attempts):
            try:
                return fn(value, *more), None
            except Exception as e:  # the model's failure is data here
                error = f"{type(e).__name__}: {e}"
                if n < attempts - 1:
                    time.sleep(pause)
                    pause = min(pause * 2, most_wait)
        return None, error

    def run_with(values: pd.Series, others: pd.Series) -> pd.DataFrame:
        ask = lambda v, *more: one(v, *more) if v is not None else (None, None)
        given = (values, others) if second is not None else (values,)
        if calls == 1:
            return pd.DataFrame(map(ask, *given), columns=["value", "error"])
        with ThreadPoolExecutor(calls) as pool:
            return pd.DataFrame(pool.map(ask, *given), columns=["value", "error"])

    called = F.pandas_udf(run_with, "value string, error string")
    return df.withColumn("_r", called(F.col(column), F.col(second or column))).withColumn(out, F.col("_r.value")).withColumn(f"{out}_error", F.col("_r.error")).drop("_r")


def infer_resumable(df: DataFrame, column: str, fn: Callable[[str], str], path: str, out: str = "output", keys: tuple[str, ...] = (), parts: int = 64, parallel: int = 2, retry_errors: bool = False, **how) -> DataFrame:
    """`infer` whose answers are kept in `path`: a run that follows a killed one calls no finished row again.

    A question is the value of `column` with those of `keys`; equal ones are asked once. One scan deals the
    questions without an answer to `parts` by hash; each part is asked by a job of its own, `parallel` at a
    time, and counts from its commit on. Errors are answers too, unless `retry_errors`. Other arguments are
    those of `infer`. Rows and their columns are as `infer` gives them.
    """
    spark = attach(df.sparkSession)
    ask = F.sha2(F.to_json(F.struct(*keys, F.col(column).alias("_in"))), 256)
    asked = df.where(F.col(column).isNotNull()).select(ask.alias("_ask"), F.col(column).alias("_in")).distinct()
    known = _answers(spark, path)
    rest = asked.join(known.where("error is null") if retry_errors else known, "_ask", "left_anti")
    folder = f"{shared_folder(spark)}/{unique_name('questions')}"
    rest.withColumn("part", F.pmod(F.xxhash64("_ask"), F.lit(parts)).cast("int")).hint("rebalance", "part").write.partitionBy("part").parquet(folder)
    table = spark.read.schema("_ask string, _in string, part int").parquet(folder)

    def run(number: int) -> None:
        answered = infer(table.where(F.col("part") == number), "_in", fn, "value", **how)
        answered.select("_ask", "value", F.col("value_error").alias("error")).write.parquet(f"{path}/{unique_name('answers')}")

    numbers = sorted(r.part for r in table.select("part").distinct().collect())  # `parts` at most
    with ThreadPoolExecutor(parallel) as pool:
        list(pool.map(run, numbers))
    answers = _answers(spark, path).groupBy("_ask").agg(F.max_by(F.struct("value", "error"), F.col("error").isNull()).alias("_r"))
    joined = df.withColumn("_ask", ask).join(answers, "_ask", "left")
    return joined.withColumn(out, F.col("_r.value")).withColumn(f"{out}_error", F.col("_r.error")).drop("_r", "_ask")


def _answers(spark: SparkSession, path: str) -> DataFrame:
    """_ask, value, error of all committed parts."""
    folders, schema = finished_folders(spark, path), "_ask string, value string, error string"
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def translate(
    requests: DataFrame, memory: DataFrame, specialist: Callable[[str], str], general: Callable[[str], str], polish: Callable[[str], str], span=None, wait: float = 2.0,
    audit_fn: Callable[[str], str] | None = None, audit_flag: str = "off", level: str = "H2",
) -> DataFrame:
    """id, text, source_key, draft, polished, used_specialist, from_memory, error, audit, blocked.

    Memory first, then routed drafts; specialist drafts are polished; fresh ones are audited where
    `audit_flag` says so (a failing audit bypasses, it does not block). Append `state.memory_rows` of the
    result to the memory.
    """
    hits, rest = memory_lookup(requests, memory)
    span = span or text.lexicon.SPECIALIST_RANGE
    routed = rest.withColumn("used_specialist", F.coalesce(text.is_specialist(F.col("text"), span), F.lit(False)))
    special = infer(infer(routed.where("used_specialist"), "text", specialist, "draft", wait=wait), "draft", polish, "polished", wait=wait)
    plain = infer(routed.where("not used_specialist"), "text", general, "draft", wait=wait).withColumn("polished", F.col("draft")).withColumn("polished_error", F.lit(None).cast("string"))
    columns = ["id", "text", "source_key", "draft", "polished", "used_specialist"] + (["skip"] if "skip" in requests.columns else [])
    done = special.unionByName(plain).select(*columns, F.lit(False).alias("from_memory"), F.coalesce("draft_error", "polished_error").alias("error"))
    judged = optional_audit(done, tasks.audits_translation(F.lit(audit_flag), F.col("used_specialist")), F.lit(level), audit_fn, "text", "polished", wait=wait)
    known = hits.select(*columns, F.lit(True).alias("from_memory"), F.lit(None).cast("string").alias("error"))
    return judged.unionByName(known.withColumn("audit", F.lit(None).cast(_AUDIT)).withColumn("blocked", F.lit(False)))


_AUDIT = "struct<approved:boolean,issues:array<string>,skipped:boolean,fallback:boolean,bypass:boolean>"


def audit(rows: DataFrame, level: Column, fn: Callable[[str], str], original: str = "text", column: str = "polished", wait: float = 2.0) -> DataFrame:
    """Adds audit (approved, issues, skipped, fallback, bypass) and blocked.

    fn is asked with the original and the draft. H0 is approved and skipped. Where fn fails or answers
    without JSON, H1 gives an unapproved row with an issue and H2 blocks; keys that are missing count as
    not approved. `split_blocked` sends blocked rows elsewhere.
    """
    asked = F.concat(F.coalesce(F.col(original), F.lit("")), F.lit("\n\n"), F.coalesce(F.col(column), F.lit("")))
    judged = infer(rows.withColumn("_level", level).withColumn("_ask", F.when(F.col("_level") != "H0", asked)), "_ask", fn, "_raw", wait=wait)
    parsed = judged.withColumn("_a", tasks.parse_audit(F.col("_raw")))
    failed = F.col("_raw").isNull() | (F.coalesce(F.col("_a.error"), F.lit("")) == "not_json")
    issue = F.array(F.when(F.col("_raw").isNull(), F.concat(F.lit("error: "), F.coalesce("_raw_error", F.lit("no answer")))).otherwise(F.lit("not_json")))
    verdict = lambda approved, issues, skipped=False, fallback=F.lit(False): F.struct(approved.alias("approved"), issues.alias("issues"), F.lit(skipped).alias("skipped"), fallback.alias("fallback"), F.lit(False).alias("bypass"))
    none = F.array().cast("array<string>")
    given = F.coalesce("_a.issues", F.array(F.coalesce("_a.error", F.lit("no issues"))))
    result = F.when(F.col("_level") == "H0", verdict(F.lit(True), none, True)).when(failed, verdict(F.lit(False), issue, fallback=F.col("_raw").isNull())).otherwise(verdict(F.coalesce("_a.approved", F.lit(False)), given))
    return parsed.withColumn("audit", result.cast(_AUDIT)).withColumn("blocked", (F.col("_level") == "H2") & failed).drop("_raw", "_raw_error", "_a", "_ask", "_level")


def split_blocked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that go out, blocked rows for a reject table)."""
    return rows.where(~F.col("blocked")), rows.where("blocked")


def optional_audit(rows: DataFrame, wanted: Column, level: Column, fn: Callable[[str], str] | None, original: str, column: str, wait: float = 2.0) -> DataFrame:
    """audit() where `wanted` (`tasks.audits_answer` or `tasks.audits_translation` of a flag); it never blocks.

    What would have blocked is approved with the issue and marked as bypassed. Rows without an audit have null.
    """
    if fn is None:
        return rows.withColumn("audit", F.lit(None).cast(_AUDIT)).withColumn("blocked", F.lit(False))
    judged = audit(rows.withColumn("_wanted", wanted), F.when(F.col("_wanted"), level).otherwise("H0"), fn, original, column, wait)
    bypass = F.struct(F.lit(True).alias("approved"), F.transform("audit.issues", lambda i: F.concat(F.lit("bypass: "), i)).alias("issues"), F.lit(False).alias("skipped"), F.lit(False).alias("fallback"), F.lit(True).alias("bypass")).cast(_AUDIT)
    return judged.withColumn("audit", F.when(F.col("_wanted"), F.when(F.col("blocked"), bypass).otherwise(F.col("audit")))).withColumn("blocked", F.lit(False)).drop("_wanted")


def image_text(requests: DataFrame, fn: Callable[[bytes], str], most: int = 16, wait: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(one row per image with ok and error, merged text per request). requests: id, images (base64)."""
    pages = requests.select("id", F.posexplode(F.slice("images", 1, min(most, 48))).alias("page", "_b64")).withColumn("_ok", tasks.decode_image(F.col("_b64")).isNotNull())

    def read(value: str) -> str:
        import base64

        return fn(base64.b64decode(value))

    done = infer(pages.withColumn("_in", F.when(F.col("_ok"), F.col("_b64"))), "_in", read, "text", wait=wait).withColumn("error", F.coalesce("text_error", F.when(~F.col("_ok"), "bad_base64"))).select("id", "page", "text", F.col("error").isNull().alias("ok"), "error")
    return done, merge_pages(done)


def merge_pages(pages: DataFrame) -> DataFrame:
    good = pages.where(F.col("ok") & (F.coalesce("text", F.lit("")) != ""))
    return good.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n\n").alias("text"))
