"""Mixing sources to target weights.

Words of each source form one stream, cut into blocks of ``block_words``. Every
output shard draws multinomial source counts over what is left of the sources'
quotas, so totals meet the targets. The i-th slot of a source maps through a
keyed permutation of its block indexes (a new key each pass over the source), and
slots join blocks by index.

Defined results: a null text has size 0; size 0 documents, and sources without
words, have taken 0; a null source is a source of its own, last in order; repeated
rows are separate documents; an empty table gives no rows; extra columns are
ignored. No block is used more than ``max_repeat`` times. More than ``MAX_SOURCES``
sources are an error, as the driver holds the table of sources.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save, word_count

#: Rows of the source table that the driver may hold.
MAX_SOURCES = 200_000


def source_targets(sizes: list[int], weights: list[int], cap: int) -> list[float]:
    """Share sum(sizes) by weight; none above cap * size, the excess reshared by weight."""
    left, open_, out = Fraction(sum(sizes)), set(range(len(sizes))), [Fraction(0)] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] > cap * sizes[i] * total}
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = Fraction(cap * sizes[i])
        left -= sum(out[i] for i in over)
        open_ -= over
    return [float(x) for x in out]


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Keyed permutation of 0..n-1 at the given points: four Feistel rounds, walking cycles into range."""
    if n == 1:
        return np.zeros_like(index)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.frombuffer(hashlib.sha256(f"{key}".encode()).digest(), dtype=np.uint64)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while (far := out >= n).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def draw_counts(quotas: np.ndarray, shard_slots: int, seed: int) -> np.ndarray:
    """Slots of each source for each shard; column sums equal ``quotas``."""
    left, rows = quotas.astype(np.int64).copy(), []
    rng = np.random.default_rng(seed)
    while (total := int(left.sum())) > 0:
        want = min(shard_slots, total)
        got = np.minimum(rng.multinomial(want, left / total), left)
        while (short := want - int(got.sum())) > 0:
            room = left - got
            got += np.minimum(rng.multinomial(short, room / room.sum()), room)
        rows.append(got)
        left -= got
    return np.array(rows, dtype=np.int64) if rows else np.zeros((0, len(quotas)), np.int64)


class Mix:
    """documents: one row per document with its place in its source's stream; slots: (shard, slot, src, block, pass)."""

    def __init__(self, docs: DataFrame, block_words: int = 128, shard_slots: int = 8192, max_repeat: int = 3, seed: int = 20, weights: list[int] | None = None):
        spark = docs.sparkSession
        base = save(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
        per_source = base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
        if len(per_source) > MAX_SOURCES:
            raise ValueError(f"more than {MAX_SOURCES} sources")
        per_source.sort(key=lambda r: (r.source is None, r.source or ""))
        self.sizes = [r["size"] for r in per_source]
        self.targets = source_targets(self.sizes, weights or [1 + i % 3 for i in range(len(self.sizes))], max_repeat)
        self.block_words, self.seed, self.spark = block_words, seed, spark
        self.blocks = [-(-s // block_words) for s in self.sizes]
        self.quotas = np.array([self._quota(*x, max_repeat) for x in zip(self.sizes, self.targets, self.blocks)], dtype=np.int64)
        self.counts = draw_counts(self.quotas, shard_slots, seed)
        rows = sum(r["n"] for r in per_source)
        chunks = max(1, rows // max(512, rows // 100_000))
        names = spark.createDataFrame([(r.source, i, s, t) for i, (r, s, t) in enumerate(zip(per_source, self.sizes, self.targets))], "source string, src int, source_size long, target double")
        # The stream's order is by chunk, then doc_id: chunks keep a hot source from being one sort.
        known = (
            base.join(F.broadcast(names), base["source"].eqNullSafe(names["source"])).drop(names["source"])
            .withColumn("chunk", F.pmod(F.xxhash64("doc_id", "size"), F.lit(chunks)))
        )
        inside = Window.partitionBy("src", "chunk").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
        totals = known.groupBy("src", "chunk").agg(F.sum("size").alias("chunk_size"))
        before = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
        totals = totals.select(F.col("src").alias("s_"), F.col("chunk").alias("c_"), (F.sum("chunk_size").over(before) - F.col("chunk_size")).alias("chunk_start"))
        placed = known.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
        placed = placed.join(totals, (placed["src"] == totals["s_"]) & (placed["chunk"] == totals["c_"]))
        self.documents = save(placed.select("doc_id", "source", "src", "size", "source_size", "target", (F.col("chunk_start") + F.col("inside")).alias("start")), "mix-placed")

    @staticmethod
    def _quota(size: int, target: float, blocks: int, cap: int) -> int:
        if not size:
            return 0
        whole = min(int(target // size), cap)
        return min(whole * blocks + round((target - whole * size) / (size / blocks)), cap * blocks)

    def slots(self) -> DataFrame:
        blocks, seed = self.blocks, self.seed
        first = np.cumsum(self.counts, axis=0) - self.counts
        plan = [(int(j), int(s), int(first[j, s]), int(self.counts[j, s])) for j, s in zip(*np.nonzero(self.counts))]
        plan = self.spark.createDataFrame(plan, "shard int, src int, first long, n long")
        # A count given is kept: else the few rows of the plan, which make many slots each, come to one task.
        plan = plan.repartition(max(1, min(len(self.counts), 4 * self.spark.sparkContext.defaultParallelism)), "shard")

        def fill(batches):
            for pdf in batches:
                for r in pdf.itertuples():
                    i = np.arange(r.first, r.first + r.n, dtype=np.int64)
                    turn = i // blocks[r.src]
                    block = np.concatenate([permuted(i[turn == t] % blocks[r.src], blocks[r.src], hash_key(seed, r.src, t)) for t in np.unique(turn)])
                    yield pd.DataFrame({"shard": r.shard, "src": r.src, "slot": i, "block": block, "turn": turn})

        return plan.mapInPandas(fill, "shard int, src int, slot long, block long, turn long")

    def taken(self) -> DataFrame:
        """One row per document: doc_id, source, size, source_size, target, taken."""
        b, docs = F.lit(self.block_words), self.documents
        used = self.slots().groupBy("src", "block").agg(F.count("*").alias("times")).select(F.col("src").alias("s_"), F.col("block").alias("b_"), "times")
        full = docs.filter(F.col("size") > 0).withColumn("last", F.col("start") + F.col("size") - 1)
        parts = full.select("src", "start", "size", F.explode(F.sequence(F.expr(f"start div {self.block_words}"), F.expr(f"last div {self.block_words}"))).alias("block"))
        parts = parts.withColumn("words", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - F.greatest(F.col("start"), F.col("block") * b))
        words = parts.join(used, (parts["src"] == used["s_"]) & (parts["block"] == used["b_"])).groupBy("src", "start").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
        words = words.select(F.col("src").alias("s_"), F.col("start").alias("p_"), "taken")
        return docs.join(words, (docs["src"] == words["s_"]) & (F.when(docs["size"] > 0, docs["start"]) == words["p_"]), "left").select(
            "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")
        )


def hash_key(*parts: int) -> int:
    return int.from_bytes(hashlib.blake2b(repr(tuple(int(p) for p in parts)).encode(), digest_size=8).digest(), "big")


def mix(docs: DataFrame, **options) -> DataFrame:
    """Words each document gives to the mix."""
    return Mix(docs, **options).taken()


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as whole documents, all columns: each as often as the mix takes its words (rounded up or down by a hash, without bias); none that it doesn't take."""
    made = Mix(docs, **options)
    share = made.taken().groupBy("doc_id").agg(F.try_divide(F.sum("taken"), F.sum("size")).alias("share"))
    chance = F.pmod(F.xxhash64("doc_id", F.lit(made.seed)), F.lit(1 << 20)) / float(1 << 20)
    times = share.select(F.col("doc_id").alias("mix_doc"), F.floor(F.coalesce("share", F.lit(0.0)) + chance).cast("int").alias("mix_times")).filter("mix_times > 0")
    joined = docs.join(times, docs["doc_id"].eqNullSafe(times["mix_doc"]))
    return joined.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_times")))).select(*[docs[c] for c in docs.columns])
