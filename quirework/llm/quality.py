"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The units are bytes. Trusted documents (quality label 1) give the counts of all
their 5-grams (padded at the start); lower orders use continuation counts. Counts,
context sums and lower-order probabilities are joined by n-gram, so the model is a
table sharded by n-gram and grows with the trusted text. For scoring, the table is
cut into shards of at most ``SHARD_ROWS`` rows by a context's last two bytes; each
shard is joined with every document's n-grams, and a document's sums over the shards
add up to its cross-entropy. A fifth of the trusted documents, by a hash of doc_id, is kept out of the
model: a document is rejected if its cross-entropy exceeds the ``QUANTILE`` of those of its
language (of all languages, where a language has none; of all trusted documents, where
none is kept out).

Defined results: null and empty texts have no perplexity and are kept; a null lang
is a language of its own; without trusted text the model is uniform and everything
is kept; repeated rows each have a row, and their doc_id is trusted if any of its
labels is 1; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, save, tidy
from .numtext import chunks

ORDER = 5
QUANTILE = 0.99
#: Of trusted documents one in so many sets the threshold and isn't trained on.
FOLDS = 5
#: Cross-entropy in nats a byte is compared in steps of 1 / STEPS.
STEPS = 2000
#: Rows of the model that one task holds.
SHARD_ROWS = 4_000_000
#: Bytes of text that a task works on at a time.
TASK_BYTES = 1 << 20


def grams(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The 5-gram (as a number) that ends at each byte; texts are padded with zeros."""
    n = len(data)
    out = np.zeros(n, np.int64)
    since = np.arange(n) - np.repeat(at[:-1], np.diff(at))
    wide = data.astype(np.int64)
    for back in range(ORDER):
        shifted = np.zeros(n, np.int64)
        shifted[back:] = wide[: n - back] << (8 * back)
        shifted[since < back] = 0
        out += shifted
    return out


def count_grams(texts: DataFrame) -> DataFrame:
    """(g, c) of all 5-grams of column ``text``; each task sums its own first."""

    def each(batches):
        import pyarrow as pa

        keys, counts, held = [], [], 0

        def merge():
            k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            return k, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)

        for batch in batches:
            for _, _, data, at in chunks(batch.column("text"), TASK_BYTES):
                k, c = np.unique(grams(data, at), return_counts=True)
                keys.append(k)
                counts.append(c.astype(np.int64))
                held += len(k)
                if held > 1_500_000:
                    k, c = merge()
                    keys, counts, held = [k], [c], 0
        if keys:
            k, c = merge()
            for a in range(0, len(k), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(k[a : a + 200_000]), pa.array(c[a : a + 200_000])], names=["g", "c"])

    return texts.select("text").mapInArrow(tidy(each), "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))


def discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more, from the numbers of n-grams seen 1 to 4 times."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] and n[k] else 0.5 * k
        out.append(min(max(d, 0.1), k * 0.95))
    return out


def model(counts: DataFrame) -> DataFrame:
    """(level, is_context, g, value): log probabilities of n-grams, and log backoff weights of contexts."""
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = save(levels[k + 1].groupBy(F.col("g").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("g")).agg(F.count("*").alias("c")), f"kn-{k}")
    parts, lower = [], None
    for k in range(1, ORDER + 1):
        c = levels[k]
        n = c.agg(*[F.count_if(F.col("c") == i) for i in (1, 2, 3, 4)]).first()
        d1, d2, d3 = discounts([n[i] for i in range(4)])
        c = c.withColumn("h", F.shiftright("g", 8))
        context = c.groupBy("h").agg(
            F.sum("c").alias("total"),
            (F.lit(d1) * F.count_if(F.col("c") == 1) + F.lit(d2) * F.count_if(F.col("c") == 2) + F.lit(d3) * F.count_if(F.col("c") > 2)).alias("freed"),
        )
        context = save(context.select(F.col("h").alias("h_"), "total", (F.col("freed") / F.col("total")).alias("gamma")), f"kn-context-{k}")
        own = (F.col("c") - F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)) / F.col("total")
        p = c.join(context, c["h"] == context["h_"]).select("g", own.alias("own"), "gamma")
        if lower is None:
            p = p.select("g", (F.col("own") + F.col("gamma") / 256).alias("p"))
        else:
            p = p.join(lower, p["g"].bitwiseAND(F.lit((1 << 8 * (k - 1)) - 1)) == lower["g_"]).select("g", (F.col("own") + F.col("gamma") * F.col("p_")).alias("p"))
        p = save(p, f"kn-p-{k}")
        lower = p.select(F.col("g").alias("g_"), F.col("p").alias("p_"))
        parts.append(p.select(F.lit(k).alias("level"), F.lit(False).alias("is_context"), "g", F.log("p").alias("value")))
        parts.append(context.select(F.lit(k).alias("level"), F.lit(True).alias("is_context"), F.col("h_").alias("g"), F.log("gamma").alias("value")))
    return save(reduce(DataFrame.unionByName, parts), "kn-model")


def _shard_key():
    """Last two bytes of the context; -1 for what all shards hold (orders 1 and 2: 65,793 n-grams at most)."""
    h = F.when(F.col("is_context"), F.col("g")).otherwise(F.shiftright("g", 8))
    return F.when(F.col("level") < 3, F.lit(-1)).otherwise(h.bitwiseAND(F.lit(0xFFFF))).cast("int")


def score(docs: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, lang, n_bytes, nats of every document. One pass over the documents for each shard of the model."""
    keyed = table.withColumn("k", _shard_key())
    sizes = sorted((r.k, r["count"]) for r in keyed.filter("k >= 0").groupBy("k").count().collect())
    shards, room = [[]], SHARD_ROWS
    for k, n in sizes:
        if n > room and shards[-1]:
            shards.append([])
            room = SHARD_ROWS
        shards[-1].append(k)
        room -= n
    spark, out = docs.sparkSession, []
    # Ranges meet, so that contexts that no n-gram has are scored (by backoff) too, each in one shard.
    lo = 0
    for keys in shards:
        hi = 0xFFFF if keys is shards[-1] else keys[-1]
        part = keyed.filter(F.col("k").between(lo, hi) | (F.col("k") == -1)).select("level", "is_context", "g", F.col("value").cast("float").alias("value"))
        arrays = _arrays(part.toArrow())
        del part
        out.append(_score_shard(docs, spark.sparkContext.broadcast(arrays), lo, hi))
        lo = hi + 1
    if len(out) == 1:
        return out[0]
    # Rows of one document in several shards: sum by a row id made of what the row is.
    return reduce(DataFrame.unionByName, out).groupBy("doc_id", "lang", "n_bytes", "text_hash").agg((F.sum("nats") * len(out) / F.count("*")).alias("nats"), (F.count("*") / len(out)).alias("times")).withColumn("times", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("times")


def _arrays(table) -> dict:
    """Sorted n-grams and their values, by (order, whether contexts)."""
    kind = table.column("level").to_numpy() * 2 + table.column("is_context").to_numpy().astype(np.int64)
    g, value, out = table.column("g").to_numpy(), table.column("value").to_numpy(), {}
    for k in np.unique(kind):
        at = np.flatnonzero(kind == k)
        at = at[np.argsort(g[at])]
        out[int(k) // 2, bool(k % 2)] = (g[at], value[at])
    return out


def log_probabilities(unique: np.ndarray, arrays: dict) -> np.ndarray:
    """Of 5-grams, by the longest known end of each and the backoff weights of the contexts above it."""
    out = np.zeros(len(unique))
    left = np.arange(len(unique))
    for k in range(ORDER, 0, -1):
        if not len(left):
            break
        g = unique[left] & ((1 << 8 * k) - 1)
        known, value = _find(arrays.get((k, False)), g)
        out[left[known]] += value[known]
        left, g = left[~known], g[~known]
        seen, back = _find(arrays.get((k, True)), g >> 8)
        out[left[seen]] += back[seen]
    out[left] += np.log(1 / 256)
    return out


def _find(table, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if table is None or not len(keys):
        return np.zeros(len(keys), bool), np.zeros(len(keys))
    at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
    return table[0][at] == keys, table[1][at]


def _score_shard(docs: DataFrame, shared, lo: int, hi: int) -> DataFrame:
    def each(batches):
        import pyarrow as pa

        arrays = shared.value
        for batch in batches:
            n = len(batch.column("text"))
            nats, size, mark = np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for a, b, data, at in chunks(batch.column("text"), TASK_BYTES):
                size[a:b] = np.diff(at)
                if not len(data):
                    continue
                g = grams(data, at)
                unique, inverse = np.unique(g, return_inverse=True)
                value = log_probabilities(unique, arrays)
                key = (unique >> 8) & 0xFFFF
                value[(key < lo) | (key > hi)] = 0
                sums = np.concatenate([[0], np.cumsum(value[inverse])])
                nats[a:b] = sums[at[:-1]] - sums[at[1:]]
                mark[a:b] = [int.from_bytes(hashlib.blake2b(data[x:y].tobytes(), digest_size=8).digest(), "big", signed=True) for x, y in zip(at[:-1], at[1:])] if (lo, hi) != (0, 0xFFFF) else 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("lang").cast(pa.string()), pa.array(size), pa.array(nats), pa.array(mark)], names=["doc_id", "lang", "n_bytes", "nats", "text_hash"])

    return docs.select("doc_id", "lang", "text").mapInArrow(tidy(each), "doc_id long, lang string, n_bytes long, nats double, text_hash long")


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity (a byte), threshold, accepted of every document."""
    trusted = maybe_broadcast(labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("trusted_id")).distinct())
    aside = F.pmod(F.crc32(F.col("trusted_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0
    good = docs.select("doc_id", "text").join(trusted.filter(~aside), F.col("doc_id") == F.col("trusted_id"), "left_semi")
    counts = save(count_grams(good), "kn-counts")
    scored = save(score(docs, model(counts)).select("doc_id", "lang", "n_bytes", (F.col("nats") / F.when(F.col("n_bytes") > 0, F.col("n_bytes"))).alias("entropy")), "kn-scores")
    # Quantiles from counts of steps: exact, and the same for every partitioning.
    step = F.floor(F.col("entropy") * STEPS).cast("long")
    known = scored.filter("entropy is not null").join(trusted, F.col("doc_id") == F.col("trusted_id"))
    kept_out = known.filter(aside)
    seen = (known if kept_out.isEmpty() else kept_out).groupBy(F.col("lang").alias("lang_"), step.alias("step")).agg(F.count("*").alias("n"))
    every = seen.groupBy("step").agg(F.sum("n").alias("n"))

    def cut(df: DataFrame, by: list[str]) -> DataFrame:
        upto = Window.partitionBy(*by).orderBy("step")
        whole = Window.partitionBy(*by)
        ranked = df.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(whole))
        return ranked.filter(F.col("upto") >= F.ceil(F.col("all") * quantile)).groupBy(*by).agg(F.min("step").alias("cut"))

    overall = cut(every.withColumn("one", F.lit(1)), ["one"]).first()
    limits = maybe_broadcast(cut(seen, ["lang_"]))
    joined = scored.join(limits, scored["lang"].eqNullSafe(limits["lang_"]), "left")
    limit = F.coalesce("cut", F.lit(overall["cut"] if overall else None).cast("long"))
    return joined.select(
        "doc_id", "lang", "n_bytes", F.exp("entropy").alias("perplexity"), F.exp((limit + 1) / STEPS).alias("threshold"), F.coalesce(step <= limit, F.lit(True)).alias("accepted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The documents, all columns, without those that are rejected (a doc_id goes if all its rows are rejected)."""
    judged = save(classify(docs, labels, quantile).select("doc_id", "accepted"), "kn-judged")
    bad = judged.groupBy("doc_id").agg(F.bool_or("accepted").alias("any")).filter("not any").select(F.col("doc_id").alias("rejected_doc"))
    return docs.join(maybe_broadcast(bad), docs["doc_id"].eqNullSafe(bad["rejected_doc"]), "left_anti")
