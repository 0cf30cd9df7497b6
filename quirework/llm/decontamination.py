"""Benchmark decontamination by random-walk embedding and bit sampling.

Texts are folded (case, punctuation and spaces). From every word start of a
document and of an item a CGK random walk runs: step j emits the byte under it and
stays or moves on by a random bit of (j, byte), so that a few edits lead to a few
differing steps. Each repetition has its own walk and samples some of its steps;
where all sampled steps agree, the item-sized window at that place is verified by
exact edit distance. A window is a hit if distance <= (1 - similarity) * length
of the folded item, in bytes.

Benchmark items are a stated query set: they are taken in blocks of bounded size,
each block against all documents; nothing of the documents is broadcast.

Walks start up to the last place from which a walk is likely to stay within the item (a
step moves on every second time). Items of few bytes have few such starts, so they
have shorter walks and more repetitions besides (``TIERS``).

Items of fewer than ``SHORT`` folded bytes have too few bytes for walks: an item with a
space on each side is cut into one piece more than it may have edits, so that one piece
is unedited in every hit. Where it is, the window is verified; this misses nothing.

Defined results: null and empty texts have no hits, nor have empty items; for items
of fewer than ``SHORT`` folded bytes the spaces round them count as bytes to be found
(so with no edits they are whole words), but the limit goes by the item's own length;
a document has one row for each item it holds (the least distance); repeated
rows have rows of their own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import maybe_broadcast, save, tidy
from .numtext import chunks, folded, mixed, raw

SIMILARITY = 0.8
STEPS, SAMPLED, EARLY, REPEATS = 44, 17, 7, 7
SHORT = 32


class Walks(NamedTuple):
    """Walks of items of at most ``longest`` folded bytes; from ``early`` samples on, every second one, walks of no item's key so far end."""

    longest: int
    steps: int
    sampled: int
    early: int
    repeats: int


#: An item has the walks of every tier that it isn't too long for.
TIERS = (Walks(2**31, STEPS, SAMPLED, EARLY, REPEATS), Walks(112, 28, 11, 4, 5), Walks(72, 24, 10, 4, 8))
#: Bytes of a part of an item, as many places are first held against parts at a time.
PART = 63
#: Bytes of item text in one block; bytes of documents that are searched at a time.
BLOCK_BYTES, SEARCHED_BYTES = 4_000_000, 1 << 21


def repetition(r: int, tier: Walks = TIERS[0], seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The moves (step, byte) of a repetition's walk, and the steps it samples."""
    rng = np.random.default_rng([seed, r])
    moves = rng.integers(0, 2, (tier.steps, 256)).astype(np.int64)
    return moves, np.sort(rng.choice(tier.steps, tier.sampled, replace=False))


def walk(data: np.ndarray, starts: np.ndarray, moves: np.ndarray, sampled: np.ndarray, known: dict[int, np.ndarray] | None = None) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(starts, keys by number of samples) of walks over ``data`` (bytes as int64). With ``known`` tables by number of samples, walks end where their key so far isn't in the table."""
    at, key, keys = starts.copy(), np.zeros(len(starts), np.uint64), {}
    take = set(sampled.tolist())
    for step in range(int(sampled[-1]) + 1):
        under = data.take(at)
        if step in take:
            key = (key + (under + 1).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
            keys[len(keys) + 1] = key
            table = known.get(len(keys)) if known else None
            if table is not None:
                on = np.flatnonzero(table.take((key & np.uint64(len(table) - 1)).view(np.int64)))
                starts, at, key, under = starts[on], at[on], key[on], under[on]
                keys[len(keys)] = key
        at += moves[step].take(under)
    return starts, keys


def edit_distance_in(pattern: bytes, text: bytes, most: int) -> tuple[int, int]:
    """Least edit distance of the pattern to any part of the text, and where that part ends (bit-parallel; exact)."""
    at = text.find(pattern)
    if at >= 0:
        return 0, at + len(pattern)
    m = len(pattern)
    masks: dict[int, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        if plus & top:
            score += 1
        if minus & top:
            score -= 1
        plus, minus = plus << 1 & full, minus << 1 & full
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        if score < best:
            best, end = score, j + 1
    return best, end


def pattern_masks(patterns: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Masks by byte and lengths of patterns of at most 63 bytes, for edit_distances_in. A pattern has the highest bits; those below match all bytes, so they never count."""
    masks, lengths = np.zeros((len(patterns), 256), np.uint64), np.array([len(t) for t in patterns], np.int64)
    for i, t in enumerate(patterns):
        low = 64 - len(t)
        masks[i] = (1 << low) - 1
        for j, c in enumerate(t):
            masks[i, c] |= np.uint64(1 << (low + j))
    return masks, lengths


def edit_distances_in(masks: np.ndarray, lengths: np.ndarray, which: np.ndarray, columns: Iterable[np.ndarray]) -> np.ndarray:
    """edit_distance_in for many at once: pattern ``which`` of pattern_masks and its text, given as columns of bytes (int64), with byte 0, which no pattern has, around it."""
    one, last = np.uint64(1), np.uint64(63)
    score = lengths[which]
    up = ~np.uint64(0) << (64 - score).astype(np.uint64)
    down, best, flat, row = np.zeros(len(which), np.uint64), score.copy(), masks.ravel(), which * 256
    for column in columns:
        eq = flat.take(row + column)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus = down | ~(diagonal | up)
        minus = up & diagonal
        score += ((plus >> last) - (minus >> last)).view(np.int64)
        plus, minus = plus << one, minus << one
        up, down = minus | ~(diagonal | plus), plus & diagonal
        np.minimum(best, score, out=best)
    return best


class ShortItems:
    """Items of fewer than ``SHORT`` folded bytes, with a space on each side, and the pieces by which they are found."""

    #: Windows that are verified at a time.
    WINDOWS = 100_000

    def __init__(self, which: list[int], texts: list[bytes], similarity: float):
        self.which = np.array(which, np.int64)
        padded = [b" " + texts[i] + b" " for i in which]
        self.masks, self.lengths = pattern_masks(padded)
        self.most = np.array([int((1 - similarity) * (len(t) - 2) + 1e-9) for t in padded], np.int64)
        grams: dict[int, list[tuple[int, int, int]]] = {}
        for k, t in enumerate(padded):
            cuts = np.linspace(0, len(t), self.most[k] + 2).astype(int).tolist()
            for a, b in zip(cuts[:-1], cuts[1:]):
                q = min(b - a, 4)
                if q:
                    grams.setdefault(q, []).append((int.from_bytes(t[a : a + q], "little"), k, a))
        self.grams = {q: np.array(sorted(g), np.int64).T for q, g in grams.items()}

    def hits(self, data: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item, distance) of the folded texts of a chunk."""
        if not len(self.which):
            return []
        # Each text with a space before and after, which are those of its first and last word.
        rows = np.repeat(np.arange(len(at) - 1), np.diff(at))
        spaced = np.full(len(data) + 2 * (len(at) - 1), 0x20, np.uint8)
        spaced[np.arange(len(data)) + 2 * rows + 1] = data
        begin, end = at[:-1] + 2 * np.arange(len(at) - 1), at[1:] + 2 * np.arange(1, len(at))
        found = []
        for q, (gram, item, offset) in self.grams.items():
            here = np.zeros(max(0, len(spaced) - q + 1), np.uint32)
            for j in range(q):
                here |= spaced[j : j + len(here)].astype(np.uint32) << np.uint32(8 * j)
            known = np.zeros(1 << 16, bool)
            known[(gram * 0x9E3779B1 >> 7) & 0xFFFF] = True
            place = np.flatnonzero(known[((here.astype(np.int64) * 0x9E3779B1) >> 7) & 0xFFFF])
            lo, hi = np.searchsorted(gram, here[place]), np.searchsorted(gram, here[place], side="right")
            times = hi - lo
            of = np.repeat(lo, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            found.append(item[of] << 40 | np.repeat(place, times) - offset[of] + SHORT)
        both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        item, place = both >> 40, (both & (1 << 40) - 1) - SHORT
        best: dict[tuple[int, int], int] = {}
        for lo in range(0, len(item), self.WINDOWS):
            k, p = item[lo : lo + self.WINDOWS], place[lo : lo + self.WINDOWS]
            row = np.clip(np.searchsorted(begin, np.maximum(p, 0) + self.most[k], side="right") - 1, 0, len(begin) - 1)
            # The piece may be a text's first or last: the window then reaches over from its neighbour.
            for r in (row - 1, row, row + 1):
                ok = (r >= 0) & (r < len(begin))
                ok[ok] = (begin[r[ok]] < (p + self.lengths[k] + self.most[k])[ok]) & (end[r[ok]] > (p - self.most[k])[ok])
                if not ok.any():
                    continue
                kk, rr = k[ok], r[ok]
                a = p[ok] - self.most[kk]
                spot = a[:, None] + np.arange(int((self.lengths[kk] + 2 * self.most[kk]).max()))
                inside = (spot >= begin[rr][:, None]) & (spot < end[rr][:, None])
                texts = np.where(inside, spaced[np.clip(spot, 0, len(spaced) - 1)], 0)
                distance = edit_distances_in(self.masks, self.lengths, kk, texts.T.astype(np.int64))
                good = distance <= self.most[kk]
                for x, y, d in zip(rr[good].tolist(), self.which[kk[good]].tolist(), distance[good].tolist()):
                    best[x, y] = min(d, best.get((x, y), d))
        return [(r, i, d) for (r, i), d in best.items()]


class Items:
    """A block of items: folded texts, and the keys of their walks for each repetition."""

    #: Walks that go on side by side, and places that are held against a part at a time: as many as stay in the processor's cache.
    WALKS, PLACES = 32_000, 10_000
    #: Places of a table of known keys, for each key.
    SPARE = 32

    def __init__(self, ids: list, texts: list[str], similarity: float = SIMILARITY):
        import pyarrow as pa

        data, at = folded(*raw(pa.array(texts, pa.string())))
        # Walks that run past an item's end meet spaces.
        self.ids = ids
        self.texts = [data[a:b].tobytes().strip() for a, b in zip(at[:-1], at[1:])]
        self.short = ShortItems([i for i, t in enumerate(self.texts) if 0 < len(t) < SHORT], self.texts, similarity)
        # Parts of items that one word of bits can hold; parts of item i are first[i] to first[i + 1].
        parts = [(k, t[k : k + PART]) for t in self.texts if len(t) >= SHORT for k in range(0, len(t), PART)]
        self.first = np.concatenate([[0], np.cumsum([-(-len(t) // PART) if len(t) >= SHORT else 0 for t in self.texts])]).astype(np.int64)
        self.offsets = np.array([k for k, _ in parts], np.int64)
        self.masks, self.lengths = pattern_masks([t for _, t in parts])
        self.tables = []
        for n, tier in enumerate(TIERS):
            self._add(tier, sum(t.repeats for t in TIERS[:n]))

    def _add(self, tier: Walks, first: int) -> None:
        joined, item, offset, places = [], [], [], []
        base = 0
        for i, t in enumerate(self.texts):
            if SHORT <= len(t) <= tier.longest:
                text = b" " + t + b" " * (tier.steps + 1)
                starts = [k for k in range(1, len(t) + 1) if text[k - 1] == 32]
                # Walks start where one likely stays within the item, or at the item's start.
                starts = [k for k in starts if k == 1 or k - 1 + tier.steps // 2 <= len(t)]
                joined.append(text)
                item += [i] * len(starts)
                offset += [k - 1 for k in starts]
                places += [base + k for k in starts]
                base += len(text)
        if not places:
            return
        at, flat = np.array(places, np.int64), np.frombuffer(b"".join(joined), np.uint8).astype(np.int64)
        for r in range(first, first + tier.repeats):
            moves, sampled = repetition(r, tier)
            _, by_samples = walk(flat, at, moves, sampled)
            known = {}
            # Places of a table: as many as leave few walks of other texts, but no more than the keys need.
            places_known = min(1 << 20, 1 << (self.SPARE * len(at) - 1).bit_length())
            for n in {*range(tier.early, tier.sampled, 2), tier.sampled}:
                known[n] = np.zeros(places_known, bool)
                known[n][(by_samples[n] & np.uint64(len(known[n]) - 1)).astype(np.int64)] = True
            key = mixed(by_samples[tier.sampled])
            order = np.argsort(key)
            self.tables.append((moves, sampled, known, key[order], np.array(item, np.int64)[order], np.array(offset, np.int64)[order]))

    def _possible(self, data: np.ndarray, at: np.ndarray, found: np.ndarray, similarity: float) -> np.ndarray:
        """Of places (row, item, place) those where the least edits of the item's parts, each near its place, add up to no more than the item may have. Misses no hit: a hit's edits are edits of its parts."""
        full = np.array([len(t) for t in self.texts], np.int64)
        most = ((1 - similarity) * full + 1e-9).astype(np.int64)[found[1]]
        left, spent = np.arange(found.shape[1]), np.zeros(found.shape[1], np.int64)
        for j in range(int(np.diff(self.first).max(initial=0))):
            # Items of fewer parts have been held against all of theirs.
            mine = left[self.first[found[1, left]] + j < self.first[found[1, left] + 1]]
            for lo in range(0, len(mine), self.PLACES):
                k = mine[lo : lo + self.PLACES]
                row, item, place = found[:, k]
                part = self.first[item] + j
                slack = full[item] // 4 + 2
                begin, lo_, hi_ = place + self.offsets[part] - slack, at[row], at[row + 1]
                spots = (begin + c for c in range(int((self.lengths[part] + 2 * slack).max())))
                columns = (data.take(spot, mode="clip") * ((spot >= lo_) & (spot < hi_)) for spot in spots)
                spent[k] += edit_distances_in(self.masks, self.lengths, part, columns)
            left = left[spent[left] <= most[left]]
        return found[:, left]

    def hits(self, data: np.ndarray, at: np.ndarray, similarity: float) -> list[tuple[int, int, int]]:
        """(row, item, distance) of the folded texts of a chunk."""
        padded = np.concatenate([data, np.full(STEPS + 2, 0x20, np.uint8)]).astype(np.int64)
        starts = np.flatnonzero((padded[: len(data)] != 0x20) & (np.concatenate([[0x20], data[:-1]]) == 0x20)) if len(data) else np.zeros(0, np.int64)
        found = []
        for moves, sampled, known, keys, items, offsets in self.tables:
            if not len(starts):
                break
            # Of each block of walks only the ends are kept, not the keys on the way.
            ends = []
            for lo in range(0, len(starts), self.WALKS):
                own, by_samples = walk(padded, starts[lo : lo + self.WALKS], moves, sampled, known)
                ends.append((own, by_samples[len(sampled)]))
            own, key = np.concatenate([e for e, _ in ends]), mixed(np.concatenate([k for _, k in ends]))
            lo = np.searchsorted(keys, key)
            some = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == key)
            times = np.searchsorted(keys, key[some], side="right") - lo[some]
            which = np.repeat(lo[some], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            place = np.repeat(own[some], times)
            found.append(np.stack([np.searchsorted(at, place, side="right") - 1, items[which], place - offsets[which]]))
        best: dict[tuple[int, int], int] = {}
        if found:
            all_ = np.concatenate(found, axis=1)
            all_ = all_[:, np.lexsort((all_[2], all_[1], all_[0]))]
            all_ = all_[:, np.concatenate([[True], (all_[:, 1:] != all_[:, :-1]).any(axis=0)])[: all_.shape[1]]]
            row, item, place = self._possible(padded, at, all_, similarity)
            # Windows of one item that overlap are one.
            slack = np.array([len(t) // 4 + 2 for t in self.texts], np.int64)[item]
            new = np.ones(len(place), bool)
            new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (place[1:] - place[:-1] > 2 * slack[1:])
            heads = np.flatnonzero(new)
            tails = np.append(heads[1:], len(place))[: len(heads)] - 1
            for r, i, p, q in zip(row[heads].tolist(), item[heads].tolist(), place[heads].tolist(), place[tails].tolist()):
                text = self.texts[i]
                extra = len(text) // 4 + 2
                most = int((1 - similarity) * len(text) + 1e-9)
                a, b = max(int(at[r]), p - extra), min(int(at[r + 1]), q + len(text) + extra)
                distance, _ = edit_distance_in(text, data[a:b].tobytes(), most)
                if distance <= most:
                    best[r, i] = min(distance, best.get((r, i), distance))
        return [(r, i, d) for (r, i), d in best.items()] + self.short.hits(data, at)


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, item_id, item_bytes, distance, similarity of every document that holds an item."""
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    out = None
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        found = _against(docs, block.collect(), similarity)
        out = found if out is None else out.unionByName(found)
    return out


def _against(docs: DataFrame, rows: list, similarity: float) -> DataFrame:
    rows = sorted(rows, key=lambda r: (r.item_id is None, r.item_id or 0, r.text))
    ids, texts = [r.item_id for r in rows], [r.text for r in rows]

    def search(batches):
        import pyarrow as pa

        items = Items(ids, texts, similarity)
        for batch in batches:
            got = []
            for lo, _, data, at in chunks(batch.column("text"), SEARCHED_BYTES):
                got += [(lo + r, i, d) for r, i, d in items.hits(*folded(data, at), similarity)]
            names = batch.column("doc_id").take(pa.array([g[0] for g in got], pa.int64()))
            lengths = [len(items.texts[i]) for _, i, _ in got]
            yield pa.RecordBatch.from_arrays(
                [names.cast(pa.int64()), pa.array([items.ids[i] for _, i, _ in got], pa.int64()), pa.array(lengths, pa.int32()), pa.array([d for *_, d in got], pa.int32()), pa.array([1 - d / n for (*_, d), n in zip(got, lengths)], pa.float64())],
                names=["doc_id", "item_id", "item_bytes", "distance", "similarity"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(search), "doc_id long, item_id long, item_bytes int, distance int, similarity double")


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The documents, all columns, without those (all rows of a doc_id) that hold an item."""
    bad = save(contaminated(docs, benchmark, similarity).select(F.col("doc_id").alias("contaminated_doc")).distinct(), "dc-bad")
    return docs.join(maybe_broadcast(bad), docs["doc_id"].eqNullSafe(bad["contaminated_doc"]), "left_anti")
