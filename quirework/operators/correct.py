"""The correction pass: what may be edited, the call of a corrector, and what is accepted.

A corrector is a callable from a list of texts to a list of texts, run in
``mapInPandas``. It may be retried by Spark: replies go through a table keyed by
prompt and text, failures aren't kept there, and a failed text keeps its original.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed value: paragraphs in one request.
BATCH = 10
Corrector = Callable[[list[str]], list[str]]


def wants_model(mode: str, any_ocr: bool) -> bool:
    if mode not in ("auto", "always", "suspicious", "never"):
        raise ValueError(f"unknown mode {mode}")
    return mode in ("always", "suspicious") or (mode == "auto" and any_ocr)


def editable(spans: DataFrame) -> DataFrame:
    """Text spans of paragraphs that aren't blank."""
    return spans.filter((F.col("kind") == "text") & (T.trim_all("text") != ""))


def candidates(spans: DataFrame, mode: str, any_ocr: bool) -> DataFrame:
    if not wants_model(mode, any_ocr):
        return spans.limit(0)
    out = editable(spans)
    return out.filter(T.suspicious("text")) if mode in ("suspicious", "auto") else out


def batched(pending: DataFrame, order: list[str], size: int = BATCH) -> DataFrame:
    """Adds batch_no and pos by document."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
    return pending.withColumn("_n", n).withColumns({"batch_no": F.floor(F.col("_n") / size).cast("int"), "pos": F.col("_n") % size}).drop("_n")


def parse_reply(content: str) -> list[str]:
    """Texts of a model's reply in any of the shapes it comes in; broken JSON is one empty text."""
    try:
        value = json.loads(content)
    except ValueError:
        text = content.strip()
        return [""] if text[:1] in ("{", "[") else [text]
    listed = value
    if isinstance(value, dict):
        named = [value[k] for k in ("paragraphs", "corrected", "result") if k in value]
        listed = (named or list(value.values()) or [None])[0]
    if isinstance(listed, list):
        return [x.strip() if isinstance(x, str) else "" for x in listed]
    return [(value if isinstance(value, str) else content).strip()]


def ask(corrector: Corrector, texts: list[str]) -> tuple[list[str | None], bool]:
    """(replies, whether the batch was split): one call, or one a text if it fails or has the wrong length; a text that fails alone is None."""
    try:
        got = corrector(texts)
        if len(got) == len(texts):
            return list(got), False
    except Exception:  # the corrector is foreign code: its failures never lose text
        pass
    out: list[str | None] = []
    for t in texts:
        try:
            one = corrector([t])
            out.append(one[0] if len(one) == 1 else None)
        except Exception:  # as above
            out.append(None)
    return out, True


def replies(pending: DataFrame, corrector: Corrector, endpoints: int | None = None) -> DataFrame:
    """key, text, reply (null: failed), split. pending: key, text. ``endpoints`` bounds the tasks that call at a time."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), BATCH):
                part = pdf.iloc[a : a + BATCH]
                got, split = ask(corrector, part.text.tolist())
                yield pd.DataFrame({"key": part.key.to_numpy(), "text": part.text.to_numpy(), "reply": got, "split": split})

    source = pending.repartition(endpoints) if endpoints else pending
    return source.select("key", "text").mapInPandas(call, "key string, text string, reply string, split boolean")


def judged(original: Column, reply: Column) -> tuple[Column, Column]:
    """(accepted, reason): a refused reply has a reason, an unchanged one neither."""
    a, b = T.trim_all(original), T.trim_all(reply)
    drift = T.drift_reason(original, reply)
    reason = F.when(reply.isNull() | (b == ""), "model returned nothing").when(a == b, F.lit(None).cast("string")).otherwise(drift)
    return F.coalesce((b != "") & (a != b) & drift.isNull(), F.lit(False)), reason


def corrections(spans: DataFrame, prompt: str, cache: DataFrame | None, corrector: Corrector, mode: str = "always", any_ocr: bool = True, endpoints: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(corrections of all candidate spans, new rows for the reply cache: key, reply).

    Equal texts are asked once. Cached keys aren't asked again.
    """
    todo = candidates(spans, mode, any_ocr).withColumn("key", T.fingerprint(F.lit(prompt), T.trim_all("text")))
    known = cache if cache is not None else spans.sparkSession.createDataFrame([], "key string, reply string")
    pending = todo.select("key", T.trim_all("text").alias("text")).dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")
    fresh = replies(pending, corrector, endpoints).select("key", "reply", "split")
    every = known.select("key", "reply", F.lit(False).alias("split"), F.lit(True).alias("cached")).unionByName(fresh.withColumn("cached", F.lit(False)))
    d = todo.join(every, "key", "left")
    accepted, reason = judged(F.col("text"), F.col("reply"))
    out = d.select(*spans.columns, "key", F.col("text").alias("original"), T.trim_all(F.coalesce("reply", "text")).alias("corrected"), accepted.alias("accepted"), reason.alias("reason"), F.coalesce("cached", F.lit(False)).alias("cached"), F.coalesce("split", F.lit(False)).alias("split"))
    return out, fresh.filter("reply is not null").select("key", "reply")


def applied(spans: DataFrame, corrected: DataFrame) -> DataFrame:
    """Spans with accepted corrections in place; a span's own outer white space stays."""
    keys = ["doc_id", "block_no", "span_no"]
    new = corrected.filter("accepted").select(*keys, F.col("corrected").alias("_new"))
    lead, tail = F.regexp_extract("text", r"(?U)^(\s*)", 1), F.regexp_extract("text", r"(?U)(\s*)$", 1)
    d = spans.join(new, keys, "left")
    return d.withColumn("text", F.when(F.col("_new").isNotNull(), F.concat(lead, "_new", tail)).otherwise(F.col("text"))).drop("_new")


def run_stats(corrected: DataFrame) -> DataFrame:
    return corrected.agg(F.count("*").alias("considered"), F.count_if("accepted").alias("changed"), F.count_if(F.col("reason").isNotNull()).alias("rejected"), F.count_if("cached").alias("cache_hits"), F.count_if("split").alias("in_split_batches"))
