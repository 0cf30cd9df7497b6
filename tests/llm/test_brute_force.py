"""Each operator against a plain version of what it says, on small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quirework.llm import decontamination, fingerprint, mixing, ngram_join, numtext, quality, sharding, suffix_dedup, token_counts, toxicity
from quirework.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


def test_edit_distance():
    rng = random.Random(4)
    for _ in range(300):
        p, t = ("".join(rng.choice("ab") for _ in range(rng.randint(1, 7))).encode() for _ in "xy")
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            new = [i]
            for j, y in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert decontamination.edit_distance_in(p, t, 99)[0] == min(row)


def test_decontamination_finds_edited_items(spark, docs, texts):
    rng = random.Random(1)
    items = [" ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()) + str(rng.randint(0, 99)) for _ in range(25)) for _ in range(12)]
    rows, want = [], set()
    ids = sorted(texts)
    for k, item in enumerate(items):
        words = item.split()
        for e in range(0, 3):
            changed = [w if rng.random() > 0.08 * e else "xx" + w[2:] for w in words]
            rows.append((1000 + 10 * k + e, texts[ids[k]][:400] + " " + " ".join(changed).upper() + ". " + texts[ids[k + 20]][:300]))
            want.add((1000 + 10 * k + e, k))
        rows.append((1000 + 10 * k + 5, texts[ids[k]][:400] + " " + " ".join(rng.sample(words, len(words)))))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == want


def test_toxicity_learns(spark, sf):
    rng = random.Random(2)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    bad = ["stupidhead", "wretchface", "vilemoron"]
    rows, labels = [], []
    for i in range(600):
        text, toxic = [rng.choice(words) for _ in range(60)], i % 4 == 0
        for _ in range(4 * toxic):
            w = rng.choice(bad)
            k = rng.randrange(1, len(w) - 1)
            text[rng.randrange(60)] = w[:k] + w[k] * rng.randint(1, 2) + w[k + 1 :]
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    d, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score(d, toxicity.fit(d, lab)).collect()
    truth = {i: t for i, _, t in labels}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out]
    assert np.mean([p == t for p, t in held]) > 0.9


def test_suffix_dedup(docs, texts):
    seen, got = set(), {r.doc_id: r for r in suffix_dedup.deduplicated(docs).collect()}
    removed = 0
    for i in sorted(texts):
        data = texts[i].encode()
        mark = bytearray(len(data))
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                mark[k : k + 100] = b"\1" * 100
            seen.add(data[k : k + 100])
        kept = bytes(x for x, m in zip(data, mark) if not m)
        spans = sum(1 for k in range(len(mark)) if mark[k] and not (k and mark[k - 1]))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(data), sum(mark), spans, hashlib.sha256(kept).hexdigest())
        removed += sum(mark)
    assert removed > 0


def test_suffix_dedup_of_common_anchors(docs, monkeypatch):
    want = sorted(map(str, suffix_dedup.deduplicated(docs).collect()))
    monkeypatch.setattr(suffix_dedup, "MAX_PIECES", 1)
    assert sorted(map(str, suffix_dedup.deduplicated(docs).collect())) == want


@pytest.mark.parametrize("in_memory", [10**9, 0])
def test_suffix_order(monkeypatch, in_memory):
    monkeypatch.setattr(suffix_dedup, "IN_MEMORY", in_memory)
    rng = random.Random(3)
    for _ in range(40):
        ps = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 6))]
        piece, length, common, before = suffix_dedup.suffix_order(ps, 5)
        got = [ps[i][len(ps[i]) - n :] for i, n in zip(piece, length)]
        assert got == sorted(p[k:] for p in ps for k in range(len(p) + 1))
        for k in range(1, len(got)):
            same = next((n for n, (x, y) in enumerate(zip(got[k - 1], got[k])) if x != y), min(len(got[k - 1]), len(got[k])))
            assert common[k] == min(same, 5)
        assert [(-1 if n == len(ps[i]) else ps[i][len(ps[i]) - n - 1]) for i, n in zip(piece, length)] == before.tolist()


def test_blocks_are_stitched(spark, docs, tmp_path):
    import pandas as pd

    streams = {"a": [3, 0, 0, 17, 1], "b": [40], "c": [], "d": [0]}
    for open_end in (False, True):
        files = []
        for name, counts in streams.items():
            tokens = np.concatenate([*(np.append(np.full(n, 5), 0) for n in counts), np.zeros(0)]).astype("<u2")
            files.append((name, tokens[:-1] if open_end and len(tokens) and counts[-1] else tokens))
        rows = [(n, i, *token_counts.scan_block(t[i * 4 : i * 4 + 4])) for n, t in files for i in range(-(-len(t) // 4))]
        blocks = spark.createDataFrame(pd.DataFrame(rows, columns=["file", "block", "separators", "head", "tail", "inner"]), "file string, block int, separators int, head long, tail long, inner array<long>")
        got = defaultdict(dict)
        for r in token_counts.stitched(blocks).collect():
            got[r.file][r.doc_no] = r.n_tokens
        assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == {k: v for k, v in streams.items() if v}


def test_token_counts_with_small_blocks(spark, docs, texts, tmp_path, monkeypatch):
    path = str(tmp_path / "tokens")
    token_counts.write_tokens(docs, path)
    one, two = (sorted(map(tuple, token_counts.count_tokens(spark, path, n).collect())) for n in (1 << 18, 97))
    assert one == two and len(one) == len(texts)


def test_lookup_table():
    owner = sharding.lookup_table(sharding.shard_names(7), 1009)
    assert max(Counter(owner.tolist()).values()) - min(Counter(owner.tolist()).values()) <= 1
    fewer = sharding.lookup_table(sharding.shard_names(6), 1009)
    moved = sum(a != b for a, b in zip(owner, fewer) if a != 6)
    assert moved < 0.25 * 1009
    with pytest.raises(ValueError):
        sharding.lookup_table(["a"], 1000)


def kneser_ney(counts):
    """p(byte | context) of interpolated modified Kneser-Ney, by recursion on dictionaries."""
    levels = {quality.ORDER: counts}
    for k in range(quality.ORDER - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts = {k: quality.discounts([sum(c == i for c in levels[k].values()) for i in (1, 2, 3, 4)]) for k in levels}
    contexts = {k: defaultdict(list) for k in levels}
    for k in levels:
        for g, c in levels[k].items():
            contexts[k][g[:-1]].append(c)

    def p(g):
        if not g:
            return 1 / 256
        k, h = len(g), g[:-1]
        lower = p(g[1:])
        seen = contexts[k].get(h)
        if not seen:
            return lower
        d = cuts[k]
        gamma = sum(d[min(c, 3) - 1] for c in seen) / sum(seen)
        c = levels[k].get(g, 0)
        return (max(c - d[min(c, 3) - 1], 0) / sum(seen) if c else 0) + gamma * lower

    return p


def test_quality_model(spark, docs, texts, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    counts = Counter()
    pad = lambda t: b"\0" * (quality.ORDER - 1) + t.encode()
    for i in good & set(texts):
        if zlib.crc32(str(i).encode()) % quality.FOLDS == 0:
            continue
        b = pad(texts[i])
        counts.update(b[k : k + quality.ORDER] for k in range(len(b) - quality.ORDER + 1))
    p = kneser_ney(counts)
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    for i in sorted(texts, key=lambda i: len(texts[i]))[::12]:
        b = pad(texts[i])
        nats = -sum(np.log(p(b[k : k + quality.ORDER])) for k in range(len(b) - quality.ORDER + 1))
        if texts[i]:
            assert np.log(got[i].perplexity) == pytest.approx(nats / len(texts[i].encode()), rel=1e-4)
    judged = [(got[r.doc_id].accepted, r.quality) for r in labels.collect() if r.doc_id in got]
    assert np.mean([a for a, q in judged if q == 1]) > 0.95 and np.mean([a for a, q in judged if q == 0]) < 0.2


def test_quality_shards_agree(docs, spark, sf, monkeypatch):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    one = {r.doc_id: r.perplexity for r in quality.classify(docs, labels).collect()}
    monkeypatch.setattr(quality, "SHARD_ROWS", 20_000)
    two = {r.doc_id: r.perplexity for r in quality.classify(docs, labels).collect()}
    assert one.keys() == two.keys() and all(one[i] is None or one[i] == pytest.approx(two[i], rel=1e-6) for i in one)


def test_fingerprints(docs, texts):
    got = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs).collect()}
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        t, n = texts[i], texts[ids[(k + 1) % len(ids)]]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    same = defaultdict(set)
    for i in ids:
        same[texts[i]].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in same.values())
    assert np.mean([got[i].near_edited for i in ids]) > 0.4 > 0.05 > np.mean([got[i].near_next for i in ids])


def test_sketches_merge(spark):
    col, rng = fingerprint.F.col, random.Random(8)
    text = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    parts = [(text(n), text(m)) for n, m in ((10, 12), (30, 600), (500, 700), (5, 5))]
    # Every shingle of both: all sketches at fraction 1.
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(parts)], "i int, a string, b string")
    d = rows
    for c in ("a", "b"):
        d = fingerprint.with_sketch(fingerprint.with_sketch(d, c, f"s{c}"), c, f"f{c}", 1.0)
    last = fingerprint.threshold()
    for r in d.withColumn("m", fingerprint.merged(col("sa"), col("sb"))).collect():
        assert r.m == sorted(x for x in {*r.fa, *r.fb} if x <= last)
        assert len(r.sa) == len(r.fa) if len(parts[r.i][0].split()) < 60 else 0 < len(r.sa) < len(r.fa) / 4


def test_containment_of_unequal_texts(spark):
    col, rng = fingerprint.F.col, random.Random(18)
    words = [f"w{rng.randint(0, 10**6)}" for _ in range(4000)]
    rows = spark.createDataFrame([(" ".join(words[:200]), " ".join(words)), (" ".join(words[:30]), " ".join(words[:28])), ("a b c", "x y z"), ("", "x"), ("", "")], "a string, b string")
    d = fingerprint.with_sketch(fingerprint.with_sketch(rows, "a", "sa"), "b", "sb").select(fingerprint.containment(col("sa"), col("sb")).alias("c"))
    assert [r.c for r in d.collect()] == [1.0, 1.0, 0.0, 0.0, 1.0]


def test_warc_against_hashes(spark, sf):
    import base64

    from quirework.llm import warc

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    html = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    first = {}
    for i in sorted(html):
        first.setdefault(html[i], i)
    got = {r.page_id: tuple(r)[1:] for r in warc.read_back(warc.write_archive(pages)).collect()}
    want = {i: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if first[b] < i else "response", first[b] if first[b] < i else None) for i, b in html.items()}
    assert got == want


def test_queries_against_sql(spark, sf):
    import os

    import duckdb

    from quirework.llm import queries

    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS FROM '{sf}/{t}'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, sf)
        want = con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(str, map(tuple, got.select(*sorted(got.columns)).collect()))) == sorted(map(str, want.project(", ".join(sorted(want.columns))).fetchall())), name


def test_lists_with_many_possible_pairs(spark, monkeypatch):
    """Blocks of long lists, and every round, on families whose members are near the limit."""
    rng = random.Random(21)
    texts = {}
    for family in range(3):
        base = [f"f{family}w{i}" for i in range(70)]
        for n in range(40):
            w = list(base)
            for at in rng.sample(range(8), rng.randint(0, 4)):
                w[at * 8] = f"x{rng.randint(0, 2)}"
            texts[family * 100 + n] = " ".join(w)
    monkeypatch.setattr(ngram_join, "CELL", 7)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(df).collect()}
    assert got == linked_by_hand(texts, 4, 85)


def linked_by_hand(texts, k, percent):
    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[i : i + k]) for i in range(len(w) - k + 1)])

    sets, up, lists = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}, defaultdict(list)

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sorted(sets):
        shared = Counter(j for e in sets[i] for j in lists[e])
        for e in sets[i]:
            lists[e].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(sets[i]), top(i)) for i in texts}


@pytest.mark.parametrize("k, percent", [(4, 85), (5, 80)])
def test_ngram_join(spark, docs, texts, k, percent):
    rng = random.Random(9)
    more = dict(texts)
    # A family of near copies, small sets, and chains.
    base = " ".join(f"w{rng.randint(0, 500)}" for _ in range(120)).split()
    for n in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(120)] = f"z{rng.randint(0, 10**6)}"
        more[5000 + n] = " ".join(w)
    for n in range(80):
        w = base[: rng.randint(1, 20)]
        if rng.random() < 0.5:
            w = w + [f"q{rng.randint(0, 2)}"]
        more[6000 + n] = " ".join(w)
    df = spark.createDataFrame(list(more.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(df, k, percent).collect()}
    assert got == linked_by_hand(more, k, percent)


def test_subset_boundary():
    assert ngram_join.boundary(85) == 13
    for s in range(1, 30):
        for t in range(s, 30):
            o = ngram_join.needed(s, t, 85)
            assert 100 * o >= 85 * (s + t - o) and 100 * (o - 1) < 85 * (s + t - o + 1)


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)]
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    want = {x: top(x) for e in edges if e[0] != e[1] for x in e}
    assert dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect())) == want


def test_permutations():
    for n in (1, 2, 3, 10, 97, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 12345 + n).tolist()) == list(range(n))


def test_targets():
    assert mixing.source_targets([100, 100, 100], [1, 2, 3], 3) == [50, 100, 150]
    assert mixing.source_targets([1, 100, 0], [3, 1, 5], 3) == [3, 98, 0]


def test_mix(docs, texts):
    got = mixing.mix(docs).collect()
    sizes = {i: len(WORD.findall(t)) for i, t in texts.items()}
    assert all(r["size"] == sizes[r.doc_id] and r.taken <= 3 * r["size"] for r in got)
    by = defaultdict(lambda: [0, 0.0, 0])
    for r in got:
        by[r.source][0] += r["size"]
        by[r.source][1] = r.target
        by[r.source][2] += r.taken
    assert sum(t for _, t, _ in by.values()) == pytest.approx(sum(sizes.values()))
    assert all(abs(taken - target) <= max(128, 0.05 * target) for _, target, taken in by.values())
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, got))
    made = mixing.Mix(docs)
    slots = Counter((r.src, r.block) for r in made.slots().collect())
    assert max(slots.values()) <= 3 and sum(slots.values()) == int(made.quotas.sum())


def test_words():
    data, at = numtext.raw(__import__("pyarrow").array(["a bc", "", None, " d\te", "f"]))
    starts, ends, row = numtext.word_spans(data, at)
    assert [(bytes(data[a:b]).decode(), r) for a, b, r in zip(starts, ends, row)] == [("a", 0), ("bc", 0), ("d", 3), ("e", 3), ("f", 4)]


def test_pipeline_stage_by_stage(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert len(stages) == 5
    kept = stages["quality classifier"](spark, docs, sf).cache()
    ids = {r.doc_id for r in kept.collect()}
    assert np.mean([i in ids for i, q in labels.items() if q]) > 0.95 and np.mean([i in ids for i, q in labels.items() if not q]) < 0.2
    one = stages["n-gram Jaccard join"](spark, kept, sf).cache()
    hand = linked_by_hand({r.doc_id: r.text for r in kept.collect()}, 5, 80)
    assert {r.doc_id for r in one.collect()} == {i for i, (_, c) in hand.items() if i == c}
    clean = stages["benchmark decontamination"](spark, one, sf).cache()
    items = [" ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {r.doc_id: " ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in one.collect()}
    assert {r.doc_id for r in clean.collect()} == {i for i, t in left.items() if not any(f" {x} " in f" {t} " for x in items)}
    mixed = stages["mixing sources to target weights"](spark, clean, sf)
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in clean.collect()}
    placed = stages["sharding"](spark, mixed, sf)
    assert placed.count() == mixed.count()


def test_decontamination_of_items_by_length():
    rng = random.Random(11)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))

    def chunk(texts):
        return numtext.folded(*numtext.raw(pa.array(texts, pa.string())))

    for size in (40, 60, 90):
        items, rows = [" ".join(word() for _ in range(40))[:size].rsplit(" ", 1)[0] for _ in range(60)], []
        for t in items:
            # Edits are all in the first half, where the walks of a short item used to start.
            w = list(t)
            for i in rng.sample(range(len(t) // 2), int(0.15 * len(t))):
                w[i] = rng.choice(letters)
            rows.append(f"{word()} {word()} {''.join(w)} {word()} {word()}")
        got = {(r, i) for r, i, _ in decontamination.Items(list(range(60)), items).hits(*chunk(rows), 0.8)}
        assert len(got & {(i, i) for i in range(60)}) >= 54


def test_decontamination_of_short_items(monkeypatch):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 6)))
    items = list(dict.fromkeys(" ".join(word() for _ in range(rng.randint(1, 5)))[:31].strip() for _ in range(60)))
    rows = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(120)] + ["", *items, *(t + "s" for t in items), *("xx " + t[1:] for t in items)]
    data, at = numtext.folded(*numtext.raw(pa.array(rows, pa.string())))
    want = {}
    for r in range(len(rows)):
        text = b" " + data[at[r] : at[r + 1]].tobytes() + b" "
        for i, t in enumerate(items):
            d, _ = decontamination.edit_distance_in(f" {t} ".encode(), text, 99)
            if d <= int(0.2 * len(t) + 1e-9):
                want[r, i] = d
    monkeypatch.setattr(decontamination.ShortItems, "WINDOWS", 50)
    got = decontamination.Items(list(range(len(items))), items).hits(data, at, 0.8)
    assert {(r, i): d for r, i, d in got} == want and len(got) == len(want) and any(want.values())
