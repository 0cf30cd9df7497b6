"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns: each operator has a defined result."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quirework.llm import decontamination, fingerprint, mixing, ngram_join, quality, sharding, suffix_dedup, token_counts, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, slot int, size string, anchor string"
LONG = "lorem ipsum dolor sit amet " * 8000


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "en", "s"), (2, "", None, None), (3, "one two three four five six seven", "en", "s"), (3, "one two three four five six seven", "en", "s"), (4, LONG, "fr", None), (None, "a null id has a text of its own here", None, "s"), (5, " \t\n ", "en", ""), (6, "É́ ñ \U0001f600 tail", "xx", "t")]
    return spark.createDataFrame([(*r, len(r[1] or ""), "k", 1, "z", "q") for r in rows], DOCS).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(3, 1, 0), (3, 1, 1), (4, None, 1), (None, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, ""), (None, "a null id has a text of its own here"), (4, "tail")], "item_id long, text string")


def test_decontamination(spark, odd, benchmark):
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(odd, benchmark).collect()}
    assert got == {(3, 1), (None, None), (6, 4)}
    kept = decontamination.decontaminate(odd, benchmark)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 4, 5]
    assert decontamination.contaminated(odd.limit(0), benchmark).count() == 0 and decontamination.contaminated(odd, benchmark.limit(0)).count() == 0


def test_toxicity(spark, odd, labels):
    model = toxicity.fit(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == 8 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score(odd.limit(0), toxicity.fit(odd.limit(0), labels.limit(0))).count() == 0
    assert all(r.score < 1e-3 for r in toxicity.score(odd, toxicity.fit(odd, labels.limit(0))).collect())


def test_suffix_dedup(spark, odd):
    got = suffix_dedup.deduplicated(odd)
    rows = {r.doc_id: r for r in got.collect()}
    assert got.count() == 8 and rows[1].n_bytes == 0 and rows[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert rows[4].n_removed > len(LONG) - 200 and rows[3].n_removed == 0
    assert suffix_dedup.deduplicated(odd.limit(0)).count() == 0


def test_suffix_dedup_with_one_id_for_several_texts(spark):
    a, b = "x" + "".join(map(str, range(90))), "y" + "".join(map(str, range(90)))
    got = suffix_dedup.deduplicated(spark.createDataFrame([(7, a), (7, b), (7, a)], "doc_id long, text string")).collect()
    assert [r.doc_id for r in got] == [7, 7, 7] and sorted(r.n_removed for r in got) in ([0, 0, len(a) - 1], [0, len(a) - 1, len(a) - 1])


def test_warc(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>é</p>"), (3, "u", "<p>é</p>"), (4, "u", "<p>é</p>"), (None, "u", "alone"), (None, "u", "alone")]
    archive = warc.write_archive(spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, strong string, payload int"))
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_back(archive).collect()), key=str)
    assert got == sorted([(1, "response", None, 0), (2, "revisit", 1, 0), (3, "response", None, 9), (3, "response", None, 9), (4, "revisit", 3, 9), (0, "response", None, 5), (0, "response", None, 5)], key=str)
    blob = b"".join(bytes(r.record) for r in warc.records(archive).collect())
    parsed = warc.parse(blob)
    assert len(parsed) == 7 and sorted(p["block"] for p in parsed) == sorted([b"", b"", "<p>é</p>".encode(), "<p>é</p>".encode(), b"", b"alone", b"alone"])
    empty = warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_back(empty).count() == 0


def test_token_counts(spark, odd):
    enc = token_counts.encoder(f"{token_counts.TOKENIZERS}/{token_counts.VOCABULARY}")
    want = sorted((r.doc_id or 0, len(enc.encode_ordinary(r.text or ""))) for r in odd.collect())
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.document_counts(odd).collect()) == want
    assert token_counts.document_counts(odd.limit(0)).count() == 0


def test_sharding(spark, odd):
    got = sharding.assign(odd).collect()
    assert len(got) == 8 and len({r.shard for r in got if r.doc_id == 3}) == 1 and all(0 <= r.shard < 64 for r in got)
    assert sharding.assign(odd.limit(0)).count() == 0


def test_quality(spark, odd, labels):
    got = quality.classify(odd, labels).collect()
    assert len(got) == 8 and all(r.accepted for r in got if not r.n_bytes) and all(r.perplexity is None for r in got if not r.n_bytes)
    assert all(r.accepted for r in quality.classify(odd, labels.limit(0)).collect())
    assert quality.accepted(odd, labels).columns == odd.columns and quality.accepted(odd.limit(0), labels).count() == 0


def test_quality_shards_cover_unseen_contexts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "en", "banana cabana bandana zazen")], "doc_id long, lang string, text string")
    other = spark.createDataFrame([(2, "en", "quqx!quqx mnop \u0416\u0436 ~~^^"), (3, "en", "banana")], docs.schema)
    table = quality.model(quality.count_grams(docs)).cache()
    one = {r.doc_id: r.nats for r in quality.score(other, table).collect()}
    monkeypatch.setattr(quality, "SHARD_ROWS", 12)
    two = {r.doc_id: r.nats for r in quality.score(other, table).collect()}
    assert one.keys() == two.keys() and all(one[i] == pytest.approx(two[i], rel=1e-6) for i in one)


def test_fingerprints(spark, odd):
    got = fingerprint.edited_fingerprints(odd).collect()
    assert len(got) == 8 and len({r.fingerprint for r in got if r.doc_id == 3}) == 1
    assert {r.fingerprint for r in got if r.doc_id in (1, 2, 5)} == {""} and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in got)
    assert fingerprint.edited_fingerprints(odd.limit(0)).count() == 0
    one = fingerprint.edited_fingerprints(odd.filter("doc_id = 6")).first()
    assert one.near_next == 1.0


def test_ngram_join(spark, odd):
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in ngram_join.linked(odd).collect()))
    assert (1, 0, 1) in got and got.count((3, 4, 3)) == 2 and (5, 0, 5) in got and len(got) == 8
    kept = ngram_join.deduplicated(odd)
    assert kept.columns == odd.columns and kept.filter("doc_id = 3").count() == 1 and kept.count() == 7
    assert ngram_join.linked(odd.limit(0)).count() == 0


def test_ngram_join_keeps_different_texts_of_one_id(spark):
    rng = random.Random(3)
    text = lambda: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(7, a, 2), (7, a, 1), (7, b, 1), (None, c, 1), (None, d, 1), (8, c + " more", 1), (9, d + " more", 1), (9, e, 1), (6, b + " more", 1), (None, None, 1), (10, "", 1)]
    want = {(7, a, 1), (None, c, 1), (None, d, 1), (9, e, 1), (6, b + " more", 1), (None, None, 1), (10, "", 1)}
    got = ngram_join.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, extra int").coalesce(1)).collect()
    assert set(map(tuple, got)) == want and len(got) == len(want)


def test_mixing(spark, odd):
    got = mixing.mix(odd).collect()
    assert len(got) == 8 and all(r.taken <= 3 * r["size"] for r in got) and {r["size"] for r in got if r.doc_id in (1, 2, 5)} == {0}
    assert mixing.mix(odd.limit(0)).count() == 0
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and mixed.filter("doc_id in (1, 2)").count() == 0


def test_pipeline_on_odd_rows(spark, odd, tmp_path):
    import corpus_pipeline

    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of this is anywhere")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert set(out.columns) >= {"doc_id", "shard"} and out.count() > 0
    empty = odd.limit(0).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, str(tmp_path)).columns == odd.columns
