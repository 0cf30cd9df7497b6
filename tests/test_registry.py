"""Registered queries against their SQL, with positive cases, and no Python where none is needed."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quirework.plans import registry

PYTHON = {"converted_words", "fuzzy_repeated_lines", "assembled_lines", "markdown_round_trip", "correction_pass"}


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS FROM '{sf}/{t}'")
    return con


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(map(str, df.astype(object).where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, sf, db, name):
    got = registry.queries()[name](spark, sf).toPandas()
    assert rows(got) == rows(db.sql(registry.oracle_sql()[name]).df())
    assert len(got)


def test_positive_cases(spark, sf):
    q = registry.queries()
    assert q["drop_repeated_lines"](spark, sf).filter("dropped").count() and q["sentence_end_flags"](spark, sf).filter("NOT ends_sentence").count()
    assert q["suspicious_lines"](spark, sf).filter("suspicious").count() and q["continuing_pages"](spark, sf).filter("continues").count()
    assert q["drift_reasons"](spark, sf).select("reason").distinct().count() > 5 and {r.heading_level for r in q["syn_headings"](spark, sf).collect()} == {0, 1, 2}
    assert {r.reason for r in q["syn_strip"](spark, sf).collect()} == {None, "Chrome", "PageNumber", "RunningHeader"}
    assert q["correction_pass"](spark, sf).filter("accepted").count() and q["fuzzy_repeated_lines"](spark, sf).count()


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - PYTHON))
def test_no_python_in_plans(spark, sf, name):
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsIn", "MapInPandas", "MapInArrow"))


def distance(a, b):
    places = np.arange(len(b) + 1)
    row, chars = places, np.array(list(b), dtype="U1")
    for i, c in enumerate(a, 1):
        new = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (chars != c))])
        row = np.minimum.accumulate(new - places) + places
    return int(row[-1])


def drift(a, b):
    a, b = a.strip(), b.strip()
    if not b:
        return "empty"
    if len(b.encode()) > len(a.encode()) and (b.startswith(a) or b.endswith(a)):
        return "only adds text at the start or end"
    d = distance(a, b)
    if d > 4 and a and abs(len(b) - len(a)) / len(a) > 0.15:
        return f"length changed by {round(abs(len(b) - len(a)) / len(a) * 100)}%"
    if d > 4 and (alike := 1 - d / max(len(a), len(b))) < 0.9:
        return f"only {round(alike * 100)}% similar to the original"
    return None


@pytest.fixture(scope="module")
def all_lines(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    return {(r.doc_id, i): t for r in docs if r.text is not None for i, t in enumerate(r.text.split("\n"))}


def test_drift_reasons_of_all_lines(spark, sf, all_lines):
    def edited(k, t):
        return (t, "zz" + t[2:], t + " and more", t[: len(t) // 2], "new words at the start, " + t[1:], t[::-1])[k % 6]

    got = {(r.doc_id, r.line_no): r.reason for r in registry.queries()["drift_reasons_all_lines"](spark, sf).collect()}
    assert got == {k: drift(t, edited(k[0], t)) for k, t in all_lines.items()}
    assert any(not t.isascii() for t in all_lines.values()) and any(len(t) < 20 for t in all_lines.values())


def test_correction_pass_covers_all_lines(spark, sf, all_lines):
    got = {(int(r.doc_id), r.block_no): (r.accepted, r.reason) for r in registry.queries()["correction_pass"](spark, sf).collect()}
    assert {k for k, t in all_lines.items() if t.strip()} <= got.keys() <= all_lines.keys()
    for k in got:
        a = all_lines[k].strip()
        b = registry._fix([a])[0].strip()
        why = "model returned nothing" if not b else None if a == b else drift(a, b)
        assert got[k] == (bool(b) and a != b and why is None, why)


def test_converted_words(spark, sf):
    q = registry.queries()
    got = {r.doc_id: r for r in q["converted_words"](spark, sf).collect()}
    pages = {r.doc_id: r.n for r in q["syn_words"](spark, sf).groupBy("doc_id").agg(F.count_distinct("page_index").alias("n")).collect()}
    assert {d: r.page_breaks for d, r in got.items()} == pages and all(r.paragraphs and r.chars for r in got.values())
