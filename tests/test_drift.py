"""The drift guard: limits against brute force, and long lines."""

import random
import time

from pyspark.sql import functions as F

from quirework.functions import text as T
from quirework.operators.alike import edit_distance


def drift(a, b):
    d, longest = edit_distance(a, b), max(len(a), len(b))
    if len(b.encode()) > len(a.encode()) and (b.startswith(a) or b.endswith(a)):
        return "only adds text at the start or end"
    if d <= 4:
        return None
    if abs(len(b) - len(a)) / len(a) > 0.15:
        return f"length changed by {round(abs(len(b) - len(a)) / len(a) * 100)}%"
    return f"only {round((1 - d / longest) * 100)}% similar to the original" if 1 - d / longest < 0.9 else None


def test_drift_reason_near_its_limits(spark):
    rng = random.Random(5)
    pairs = []
    for _ in range(1500):
        a = "".join(rng.choice("abcdefgh\u00e9\u65e5") for _ in range(rng.randint(1, 130)))
        b = list(a)
        for _ in range(rng.randint(0, len(a) // 6 + 6)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        if b:
            pairs.append((a, "".join(b)))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", T.drift_reason("a", "b").alias("r")).collect()
    assert all(r.r == drift(r.a, r.b) for r in got) and len({r.r for r in got}) > 9


def test_long_lines_with_few_edits(spark):
    a = "".join(random.Random(6).choices("abcdefghij", k=60_000))
    d = spark.createDataFrame([(a, a[:100] + "x" * 9 + a[100:]), (a, a)], "a string, b string").repartition(1)
    began = time.perf_counter()
    assert [r[0] for r in d.select(T.drift_reason(F.col("a"), F.col("b"))).collect()] == [None, None]
    assert time.perf_counter() - began < 40
