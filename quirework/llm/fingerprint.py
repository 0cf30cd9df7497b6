"""Threshold-scaled document sketches, in DataFrame functions only.

A sketch holds every five-word shingle hash below a fixed fraction of the hash
range (lower-cased words), so sketches of parts merge by union and containment is
estimated between texts of very unequal length. A text of at most ``WHOLE`` shingles,
of which too few would be left, is sketched at the fraction 1, and so keeps all;
sketches of two fractions are compared, and merged, at the lower one. Fewer than five
words make one shingle.

Defined results: a null text is empty; empty texts have the empty sketch, alike
to each other (1.0) and to nothing else (0.0); equal texts have equal sketches;
repeated doc_ids follow each other in the order of their texts; null doc_ids come
last in descending order; a table of one row is followed by itself; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import word_array

SHINGLE_WORDS = 5
FRACTION = 1 / 8
#: Shingles up to which a text keeps all hashes.
WHOLE = 64
#: Bounds the broadcast table of range starts: at most this many groups, and a few more.
MAX_GROUPS = 200_000


def threshold(fraction: float = FRACTION) -> int:
    """The largest hash that a sketch of this fraction keeps."""
    return -(2**63) + int(2**64 * fraction) - 1


def with_sketch(df: DataFrame, text: str, out: str, fraction: float = FRACTION, k: int = SHINGLE_WORDS) -> DataFrame:
    """Add ``out``, the sorted array of retained hashes of column ``text``."""
    last = threshold(fraction)
    words, hashes, shingles, kept = (f"{out}_{x}" for x in ("words", "hashes", "all", "kept"))
    h = F.col(hashes)
    return (
        df.withColumn(words, word_array(F.lower(F.col(text))))
        .withColumn(hashes, F.transform(F.col(words), lambda w: F.xxhash64(w)))
        .withColumn(
            shingles,
            F.when(F.size(h) >= k, F.transform(F.sequence(F.lit(0), F.greatest(F.size(h) - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)])))
            .when(F.size(h) > 0, F.array(F.xxhash64(F.array_join(F.col(words), " "))))
            .otherwise(F.array().cast("array<bigint>")),
        )
        .withColumn(kept, F.when(F.size(shingles) <= WHOLE, F.col(shingles)).otherwise(F.filter(F.col(shingles), lambda x: x <= F.lit(last))))
        .withColumn(out, F.array_sort(F.array_distinct(kept)))
        .drop(words, hashes, shingles, kept)
    )


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.hex(x)), ",")


def _alike_scaled(a: Column, b: Column, fraction: float) -> tuple[Column, Column]:
    """Both sketches at the lower of their fractions: a hash above the threshold shows a sketch of fraction 1."""
    last = F.lit(threshold(fraction))
    whole = F.coalesce(F.array_max(a) > last, F.lit(False)) & F.coalesce(F.array_max(b) > last, F.lit(False))
    at = lambda s: F.when(whole, s).otherwise(F.filter(s, lambda x: x <= last))
    return at(a), at(b)


def merged(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """The sketch, at ``fraction``, of both texts' shingles together."""
    last = F.lit(threshold(fraction))
    return F.array_sort(F.filter(F.array_union(a, b), lambda x: x <= last))


def containment(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """Shared part of the smaller sketch. Two empty sketches are alike, an empty one and another aren't; equal sketches are alike even where the lower fraction leaves nothing."""
    x, y = _alike_scaled(a, b, fraction)
    least = F.least(F.size(x), F.size(y))
    return F.when(a == b, F.lit(1.0)).when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / least)


def with_next(docs: DataFrame, fraction: float) -> DataFrame:
    """doc_id, text, sketch of every row and of the row that follows in descending doc_id, round the end.

    Rows go once to ranges of doc_id; each range also gets the first row of the next range.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lo, hi, n = d.select("doc_id").agg(F.min("doc_id"), F.max("doc_id"), F.count("*")).first()
    width = max(1, ((hi - lo + 1) if n and hi is not None else 1) * max(512, n // MAX_GROUPS) // max(n, 1))
    d = d.withColumn("range", F.coalesce(F.expr(f"(doc_id - {lo or 0}) div {width}"), F.lit(-1)))
    ends = d.groupBy("range").agg(F.max("doc_id").alias("first_id"))
    up = Window.orderBy("range")
    ends = ends.select(
        F.col("range").alias("range_"), "first_id",
        F.coalesce(F.lead("range").over(up), F.min("range").over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("guest_of"),
    )
    d = d.join(F.broadcast(ends), (d["range"] == ends["range_"]) & d["doc_id"].eqNullSafe(ends["first_id"]), "left")
    own = F.struct(F.col("range"), F.lit(0).alias("guest"))
    d = d.withColumn("to", F.explode(F.when(F.col("guest_of").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("guest_of").alias("range"), F.lit(1).alias("guest"))))))
    d = d.select("doc_id", "text", F.col("to.range").alias("range"), F.col("to.guest").alias("guest")).repartition(F.col("range"))
    d = with_sketch(d, "text", "sketch", fraction)
    order = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("text"))
    d = d.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order))
    return d.filter("guest = 0").drop("range", "guest")


def fingerprints(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    """doc_id, sketch of every document."""
    return with_sketch(docs.select("doc_id", "text"), "text", "sketch", fraction).select("doc_id", "sketch")


def edited_fingerprints(docs: DataFrame, fraction: float = FRACTION) -> DataFrame:
    d = with_next(docs, fraction)
    d = d.withColumn("n_chars", F.length("text")).withColumn("half", F.expr("n_chars div 2").cast("int"))
    d = d.withColumn("edited", F.concat(F.expr("substring(text, 1, n_chars - half)"), F.expr("substring(next_text, 1, half)")))
    d = with_sketch(d, "edited", "edited_sketch", fraction)
    return d.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        containment(F.col("sketch"), F.col("edited_sketch"), fraction).alias("near_edited"), containment(F.col("sketch"), F.col("next_sketch"), fraction).alias("near_next"),
    )
