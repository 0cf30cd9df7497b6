"""Repeated byte strings, by column-wise construction of a collection's suffix order.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (smaller
doc_id, or earlier in the document) is removed.

Strings that can be equal are brought together by content. Of a string's 40-byte
parts the one of least hash is its anchor; the strings round one occurrence of an
anchor make one piece of at most 176 bytes. Equal strings have equal anchors, so only
pieces whose anchor occurs twice are compared. Equal pieces are one, with the first
occurrence standing for all. The distinct pieces of a bucket of anchors are a
collection for ``suffix_order``: each round inserts one symbol of every piece, from
the right, into the Burrows-Wheeler transform and updates common prefixes with it;
the columns are read and written in sequence, in files where they exceed memory.
Neighbours with a common prefix of ``LENGTH`` are equal strings. Before that, what no
string of a bucket shares its hash with is cut off the pieces: equal strings have equal
hashes, and what is left is compared byte by byte.

An anchor with more than ``MAX_PIECES`` different contexts (a common line) is dealt
out string by string instead: its equal strings meet by hash, with partial minima, so
no bucket grows with its frequency.

Defined results: a null text is empty, with the hash of no bytes; texts shorter than
``LENGTH`` stay as they are; a null doc_id comes before all others; equal rows are
one document, each row with its result; rows of one doc_id with different texts are
different documents in the order of their texts' digests; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import maybe_broadcast, save
from .numtext import CHUNK, cumulative, mixed, raw, span_hashes

LENGTH = 100
PART = 40
#: Different pieces of one anchor above which its strings are dealt out one by one.
MAX_PIECES = 10_000
#: Bytes of pieces in one collection; symbols above which its columns are files.
BUCKET_BYTES = 1_000_000
IN_MEMORY = 32_000_000
NO_ID = -(2**63)
_PLACE = 22


def segments(data: np.ndarray, at: np.ndarray, length: int = LENGTH, part: int = PART):
    """(row, start, n_bytes, anchor, piece) of all pieces of the texts that lie end to end in ``data``."""
    out = [[] for _ in range(5)]
    step = CHUNK
    lo = 0
    while lo < len(at) - 1:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + step, side="right")) - 1)
        a, b = int(at[lo]), int(at[hi])
        # A long text alone is taken in stretches of string starts.
        for s in range(a, max(b - length + 1, a + 1), step) if hi == lo + 1 else (a,):
            e = min(b, s + step + length - 1) if hi == lo + 1 else b
            got = _stretch(data[s:e], np.clip(at[lo : hi + 1], s, e) - s, length, part)
            if got is not None:
                row, start, n, anchor, piece = got
                for x, y in zip(out, (row + lo, start + s - at[row + lo], n, anchor, piece)):
                    x.append(y)
        lo = hi
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def _stretch(data, at, length, part):
    n = len(data)
    if n < length:
        return None
    sums = cumulative(data)
    i = np.arange(n - part + 1)
    hashes = span_hashes(sums, i, i + part)
    places = np.uint64((1 << _PLACE) - 1)
    least = (hashes & ~places) | i.astype(np.uint64)
    width, have = length - part + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    starts = np.flatnonzero(np.arange(len(least)) + length <= at[1:][row[: len(least)]])
    if not len(starts):
        return None
    anchor_at = (least[starts] & places).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor_at[1:] != anchor_at[:-1]) | (row[starts[1:]] != row[starts[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    begin, end = starts[first], starts[last] + length
    anchor = hashes[anchor_at[first]]
    return row[begin], begin, end - begin, anchor.view(np.int64), span_hashes(sums, begin, end).view(np.int64)


class _Columns:
    """New columns of a round: memory, or files that take turns."""

    def __init__(self, total: int):
        self.folder = tempfile.TemporaryDirectory() if total > IN_MEMORY else None
        self.turn = 0

    def new(self, name: str, n: int, dtype) -> np.ndarray:
        if not self.folder:
            return np.empty(n, dtype)
        return np.memmap(os.path.join(self.folder.name, f"{name}{self.turn % 2}"), dtype, "w+", shape=(max(n, 1),))[:n]

    def close(self):
        if self.folder:
            self.folder.cleanup()


def suffix_order(pieces: list[bytes], cap: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, suffix length, common prefix with the row before, symbol before) of all suffixes, the empty ones too, in order.

    Common prefixes above ``cap`` count as ``cap``. A symbol of -1 is a piece's start.
    """
    m, lengths = len(pieces), np.array([len(p) for p in pieces], np.int64)
    text = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum(lengths)
    files = _Columns(int(ends[-1]) if m else 0)
    piece, suffix, common = np.arange(m, dtype=np.int32), np.zeros(m, np.int32), np.zeros(m, np.uint8)
    symbol = np.full(m, -1, np.int16)
    symbol[lengths > 0] = text[ends[lengths > 0] - 1]
    for done in range(int(lengths.max()) if m else 0):
        files.turn += 1
        open_ = np.flatnonzero(symbol >= 0)
        order = open_[np.argsort(symbol[open_], kind="stable")]
        is_new = suffix[order] == done
        k = np.flatnonzero(is_new)
        mask = np.zeros(m + len(order), bool)
        mask[m + k] = True
        n = len(mask)
        # Common prefixes of new rows, and of old rows that follow a new one.
        touched = np.unique(np.concatenate([k, k[k + 1 < len(order)] + 1]))
        value = np.zeros(len(touched), np.uint8)
        same = np.flatnonzero((touched > 0) & (symbol[order[touched]] == symbol[order[touched - 1]]))
        if len(same):
            a, b = order[touched[same] - 1] + 1, order[touched[same]] + 1
            # From right to left: then reduceat reads nothing but the ranges themselves.
            back = np.argsort(-a, kind="stable")
            pairs = np.stack([a[back], b[back]], axis=1).ravel()
            low = np.minimum.reduceat(np.append(common, np.uint8(0)), pairs)[::2]
            value[same[back]] = np.minimum(low.astype(np.int16) + 1, cap)
        made_from = order[k]
        of = piece[made_from]
        left = lengths[of] - done - 1
        before = np.full(len(k), -1, np.int16)
        more = left > 0
        before[more] = text[ends[of[more]] - done - 2]
        new_piece, new_suffix, new_common, new_symbol = files.new("p", n, np.int32), files.new("l", n, np.int32), files.new("c", n, np.uint8), files.new("s", n, np.int16)
        for new, old, fresh in ((new_piece, piece, of), (new_suffix, suffix, np.int32(done + 1)), (new_symbol, symbol, before)):
            new[~mask] = old
            new[mask] = fresh
        new_common[~mask] = common
        new_common[m + touched] = value
        piece, suffix, common, symbol = new_piece, new_suffix, new_common, new_symbol
    out = tuple(np.array(x) for x in (piece, suffix, common, symbol))
    files.close()
    return out


def repeats(pieces: list[bytes], doc: np.ndarray, start: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(doc, start) of the strings in the pieces that also start earlier in one of the pieces."""
    piece, suffix, common, _ = suffix_order(pieces, length)
    _, rank = np.unique(doc, return_inverse=True)
    whole = np.flatnonzero(suffix >= length)
    if not len(whole):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    group = np.cumsum(common < length)[whole]
    of = piece[whole]
    at = start[of] + np.array([len(p) for p in pieces], np.int64)[of] - suffix[whole]
    key = (rank[of].astype(np.int64) << 40) | at
    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    first = np.repeat(np.minimum.reduceat(key, heads), np.diff(np.append(heads, len(group))))
    later = key > first
    return doc[of[later]], at[later]


def repeated_parts(pieces: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(piece, bytes, offset in the piece) of the runs of strings whose hash another string of the pieces has."""
    sizes = np.array([len(p) for p in pieces], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    if len(data) < length:
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(pieces)), sizes)
    at = np.arange(len(data) - length + 1)
    at = at[at + length <= ends[of[at]]]
    hashes = span_hashes(cumulative(data), at, at + length)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    again = np.zeros(len(at), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    at = at[again]
    if not len(at):
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64)
    first = np.concatenate([[True], (np.diff(at) != 1) | (of[at[1:]] != of[at[:-1]])])
    begin, end = at[first], at[np.append(first[1:], True)] + length
    return of[begin], [data[a:b].tobytes() for a, b in zip(begin.tolist(), end.tolist())], begin - (ends - sizes)[of[begin]]


def merged(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (start, end) rows; runs that touch are one."""
    if not len(spans):
        return spans.reshape(0, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.stack([spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]], axis=1)


class Repeats:
    def __init__(self, docs: DataFrame, length: int = LENGTH, part: int = PART):
        self.length, self.part = length, part
        docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
        digests = lambda d: d.select("doc", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.octet_length("text").cast("long").alias("n_bytes"))
        self.rows = save(digests(docs), "sd-rows")
        self.ids = None
        twice = self.rows.groupBy("doc").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).filter("lo <> hi")
        if not twice.isEmpty():
            # One doc_id, several texts: number the documents anew, in their order.
            self.ids = save(self.rows.select("doc", "digest").distinct().withColumn("no", F.row_number().over(Window.orderBy("doc", "digest")).cast("long")), "sd-ids")
            ids = self.ids.withColumnsRenamed({"doc": "doc_", "digest": "digest_"})
            docs = docs.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).join(ids, (F.col("doc") == F.col("doc_")) & (F.col("digest") == F.col("digest_"))).select(F.col("no").alias("doc"), "text")
            docs = save(docs, "sd-docs")
            self.rows = save(digests(docs), "sd-rows")
        self.docs = docs

    def _scan(self, each, schema: str) -> DataFrame:
        def run(batches):
            yield from each((b.column("doc").to_numpy(zero_copy_only=False), *raw(b.column("text"))) for b in batches if b.num_rows)

        # Documents equal to an earlier one take no part: every string of theirs starts in that one.
        firsts = self.firsts().withColumnRenamed("digest", "digest_f")
        copies = self.rows.join(firsts, F.col("digest") == F.col("digest_f")).filter("doc <> first").select(F.col("doc").alias("copy")).distinct()
        copies = maybe_broadcast(save(copies, "sd-copies"))
        return self.docs.join(copies, F.col("doc") == F.col("copy"), "left_anti").mapInArrow(run, schema)

    def pieces(self) -> DataFrame:
        length, part = self.length, self.part

        def each(batches):
            import pyarrow as pa

            for doc, data, at in batches:
                row, start, n, anchor, piece = segments(data, at, length, part)
                for a in range(0, len(row), 200_000):
                    s = slice(a, a + 200_000)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[s]), pa.array(piece[s]), pa.array(doc[row[s]]), pa.array(start[s] << 10 | n[s])], names=["anchor", "piece", "doc", "span"])

        return self._scan(each, "anchor long, piece long, doc long, span long")

    def spans(self) -> DataFrame:
        """(doc, start, end) of removed strings; they overlap. Documents equal to an earlier one aren't in it."""
        length, spark = self.length, self.docs.sparkSession
        pieces = self.pieces()
        again = pieces.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("anchor").alias("anchor_"))
        shared = save(pieces.join(again, F.col("anchor") == F.col("anchor_")).select("anchor", "piece", "doc", "span"), "sd-shared")
        del pieces, again
        # Struct order is document, then start.
        classes = save(shared.groupBy("anchor", "piece").agg(F.min(F.struct("doc", "span")).alias("first"), F.count("*").alias("n")), "sd-classes")
        here = classes.filter("n > 1").select(F.col("anchor").alias("anchor_"), F.col("piece").alias("piece_"), F.col("first.doc").alias("doc_"), F.col("first.span").alias("span_"))
        start, end = F.shiftright("span", 10), F.shiftright("span", 10) + F.col("span").bitwiseAND(F.lit(1023))
        equal = shared.join(here, (F.col("anchor") == F.col("anchor_")) & (F.col("piece") == F.col("piece_")) & ((F.col("doc") != F.col("doc_")) | (F.col("span") != F.col("span_"))))
        equal = save(equal.select("doc", start.alias("start"), end.alias("end")), "sd-equal")
        content = self._content(classes)
        total = content.filter("not alone").agg(F.sum(F.octet_length("content"))).first()[0] or 0
        buckets = max(1, -(-total // BUCKET_BYTES))

        def compare(key, pdf):
            of, parts, offset = repeated_parts([bytes(x) for x in pdf.content], length)
            doc, at = repeats(parts, pdf.doc.to_numpy()[of], pdf.start.to_numpy()[of] + offset, length)
            rows = []
            for d in np.unique(doc):
                own = at[doc == d]
                for a, b in merged(np.stack([own, own + length], axis=1)):
                    rows.append((d, a, b))
            return pd.DataFrame(rows, columns=["doc", "start", "end"]).astype("int64")

        found = content.filter("not alone").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets))).groupBy("bucket").applyInPandas(compare, "doc long, start long, end long")
        alone = content.filter("alone").select("anchor", "check", "doc", "start")
        least = alone.groupBy("anchor", "check").agg(F.min(F.struct("doc", "start")).alias("first")).select(F.col("anchor").alias("anchor_"), F.col("check").alias("check_"), "first")
        later = alone.join(least, (F.col("anchor") == F.col("anchor_")) & (F.col("check") == F.col("check_")) & (F.struct("doc", "start") != F.col("first"))).select("doc", "start", (F.col("start") + length).alias("end"))
        return equal.unionByName(save(found.unionByName(later), "sd-found"))

    def _content(self, classes: DataFrame) -> DataFrame:
        """Bytes of the distinct pieces of anchors with several: anchor, check, doc, start, content, alone (a string of a common anchor by itself: two hashes, no bytes)."""
        length = self.length
        counts = classes.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1").select(F.col("anchor").alias("anchor_"), (F.col("m") > MAX_PIECES).alias("common"))
        several = classes.join(counts, F.col("anchor") == F.col("anchor_")).select(F.col("first.doc").alias("of"), F.struct("anchor", F.col("first.span").alias("span"), "common").alias("at"))
        listed = several.groupBy("of").agg(F.collect_list("at").alias("pieces"))

        def cut(batches):
            columns = ["anchor", "check", "doc", "start", "content", "alone"]
            for pdf in batches:
                out = []
                for doc, text, wanted in zip(pdf.doc, pdf.text, pdf.pieces):
                    data = text.encode()
                    for p in wanted:
                        start = p["span"] >> 10
                        piece = data[start : start + (p["span"] & 1023)]
                        if not p["common"]:
                            out.append((p["anchor"], 0, doc, start, piece, False))
                            continue
                        sums, i = cumulative(np.frombuffer(piece, np.uint8)), np.arange(len(piece) - length + 1)
                        whole = span_hashes(sums, i, i + length).view(np.int64)
                        check = mixed(span_hashes(sums, i, i + length // 2) + np.uint64(3) * span_hashes(sums, i + length // 3, i + length)).view(np.int64)
                        out += [(h, c, doc, start + k, None, True) for k, (h, c) in enumerate(zip(whole.tolist(), check.tolist()))]
                yield pd.DataFrame(out, columns=columns)

        rows = self.docs.join(listed, F.col("doc") == F.col("of")).select("doc", "text", "pieces")
        return save(rows.mapInPandas(cut, "anchor long, check long, doc long, start long, content binary, alone boolean"), "sd-content")

    def firsts(self) -> DataFrame:
        return self.rows.groupBy("digest").agg(F.min("doc").alias("first"))

    def result(self, with_text: bool = False) -> DataFrame:
        """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes) of every document."""
        length = self.length
        listed = self.spans().groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans")).withColumnRenamed("doc", "of")

        def keep(batches):
            for pdf in batches:
                out = []
                for doc, text, spans in zip(pdf.doc, pdf.text, pdf.spans):
                    data, at, kept = text.encode(), 0, []
                    runs = merged(np.array([(s["start"], s["end"]) for s in spans], np.int64))
                    for a, b in runs.tolist():
                        kept.append(data[at:a])
                        at = b
                    rest = b"".join(kept) + data[at:]
                    out.append((doc, len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest if with_text else b""))
                yield pd.DataFrame(out, columns=["doc_c", "n_removed", "n_spans", "kept_sha256", "kept"])

        changed = self.docs.dropDuplicates(["doc"]) if self._has_equal_rows() else self.docs
        changed = changed.join(listed, F.col("doc") == F.col("of")).select("doc", "text", "spans").mapInPandas(keep, "doc_c long, n_removed long, n_spans long, kept_sha256 string, kept binary")
        firsts = self.firsts().withColumnRenamed("digest", "digest_f")
        rows = self.rows.join(firsts, F.col("digest") == F.col("digest_f")).join(changed, F.col("doc") == F.col("doc_c"), "left")
        copy = (F.col("doc") != F.col("first")) & (F.col("n_bytes") >= length)
        out = rows.select(
            "doc", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"), F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"), *(["kept"] if with_text else []),
        )
        if self.ids is not None:
            ids = self.ids.select(F.col("doc").alias("own_"), "no")
            out = out.join(ids, F.col("doc") == F.col("no")).withColumn("doc", F.col("own_")).drop("own_", "no")
        return out.withColumn("doc_id", F.when(F.col("doc") != NO_ID, F.col("doc"))).drop("doc")

    def _has_equal_rows(self) -> bool:
        return not self.rows.groupBy("doc").count().filter("count > 1").isEmpty()


def deduplicated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    return Repeats(docs, length).result().select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
