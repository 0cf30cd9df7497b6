"""N-gram Jaccard join: a size-aware join of small ("light") and large ("heavy") sets.

A document's set is its distinct word shingles. Two documents link when
100 * |A & B| >= percent * |A | B|. Equal sets are one class, of which one row goes on.
Candidates among the classes:

* Small sets enumerate fixed-size subsets: sets of sizes s and t link only if they
  share c = ceil(percent * (s + t) / (100 + percent)) elements, so each enumerates
  its c-subsets for every c that it can have with a partner.
* Large sets scan inverted lists: a link shares an element of both sets' prefixes of
  |A| - ceil(percent * |A| / 100) + 1 elements in one global order. The order puts
  frequent elements last, the most frequent at the very end, then goes by hash.

The boundary is the largest size for which the subsets cost less than the lists.

Entries whose list has no other class of a fitting size and position fall away first,
which leaves a small share. To those each class brings a parity sketch: a bit for each slot that an odd number of its elements
fall into. Sets that differ in d elements have sketches that differ in at most d bits, so
what the sketch rules out is no link. Within a list, classes whose components are known
to be one are not compared, and only a spanning forest of the possible links between
components goes out: never more rows than the list has. Of these each class has one
verified on the whole sets; components are contracted, and lists that still have possible
links between components, but for the pairs that failed, go through again. So a group of
near copies takes about as many verified pairs as it has members, and no link between
different components is lost. A list of more than ``CELL`` classes is dealt out in cells
of that many: by itself first, then each block of it with each other block.

Defined results: null and empty texts have the empty set and link with nothing; fewer
words than a shingle make one of all words; a null doc_id is one more id, less than all
others (as is -2**63, which stands for it); rows of one doc_id with different sets link with each other;
component_id is the smallest doc_id reachable; an empty table gives no rows; extra
columns are ignored. Shingles and sets are told apart by hashes of 64 and 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .common import drop, maybe_broadcast, save, tidy
from .components import components
from .numtext import LOWER, chunks, cumulative, mixed, span_hashes, word_spans

SHINGLE_WORDS = 4
PERCENT = 85
#: A task tells of elements that it sees in more prefixes than this; such elements go last in the order.
FREQUENT = 6
#: At most this many are sent to tasks (those seen most); the order of the others doesn't change results.
MAX_FREQUENT = 200_000
#: Cost of verifying a candidate, in elements read, for each element of a set.
VERIFY = 1.0
NO_ID = -(2**63)
#: Bits of a sketch for each element (up to the next power of two), least and most: one that tells strangers apart, and one that counts.
SMALL, LARGE = (0.5, 128, 1 << 13), (4, 1024, 1 << 16)
#: Classes that are compared in one cell of a list; entries of a list that are first held against each other by size and position.
CELL, PAIRED = 4096, 24
#: Rounds in which a class has one pair verified; then all that are left at once.
ROUNDS = 4
#: Rounds in which long lists are dealt out in blocks by themselves only.
APART = 2


def needed(s: int, t: int, percent: int) -> int:
    """Least overlap with which sets of these sizes link."""
    return -(-percent * (s + t) // (100 + percent))


def subset_sizes(s: int, percent: int) -> list[int]:
    partners = [t for t in range(max(1, percent * s // 100), 100 * s // percent + 2) if 100 * min(s, t) >= percent * max(s, t)]
    return sorted({c for t in partners if (c := needed(s, t, percent)) <= min(s, t)})


def prefix_length(s: int, percent: int) -> int:
    return s - -(-percent * s // 100) + 1


def boundary(percent: int = PERCENT, limit: int = 64) -> int:
    """Largest size up to which all c-subsets cost no more than prefix entries and the checks they lead to."""
    best = 0
    for s in range(1, limit):
        if sum(comb(s, c) for c in subset_sizes(s, percent)) > prefix_length(s, percent) * (1 + VERIFY * s):
            break
        best = s
    return best


def shingle_sets(column, k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct 64-bit shingle hashes of each text) for runs of texts of bounded size."""
    for lo, _, data, at in chunks(column):
        out: list[np.ndarray] = []
        starts, ends, row = word_spans(data, at)
        n = len(at) - 1
        if not len(starts):
            yield lo, [np.zeros(0, np.int64)] * n
            continue
        words = span_hashes(cumulative(LOWER[data]), starts, ends)
        first = np.searchsorted(row, np.arange(n + 1))
        full = max(0, len(words) - k + 1)
        h = np.zeros(full, np.uint64)
        for j in range(k):
            h = mixed(h + words[j : j + full])
        h = h.view(np.int64)
        for r in range(n):
            a, b = first[r], first[r + 1]
            if b - a >= k:
                out.append(np.unique(h[a : b - k + 1]))
            elif b > a:
                x = np.zeros(1, np.uint64) + np.uint64(b - a)
                for w in words[a:b]:
                    x = mixed(x + w)
                out.append(x.view(np.int64))
            else:
                out.append(np.zeros(0, np.int64))
        yield lo, out


def ordered(elements: np.ndarray, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """In the global order: by hash, then the frequent ones by rank."""
    if not len(frequent):
        return elements
    at = np.minimum(np.searchsorted(frequent, elements), len(frequent) - 1)
    last = frequent[at] == elements
    tail = elements[last]
    return np.concatenate([elements[~last], tail[np.argsort(rank[at[last]])]])


def signature(elements: np.ndarray, seed: int = 0) -> tuple[int, int]:
    u = elements.view(np.uint64)
    return int(mixed(u + np.uint64(seed)).sum(dtype=np.uint64).view(np.int64)), int(mixed(u ^ np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64).view(np.int64))


def sketches(elements: np.ndarray) -> tuple[bytes, bytes]:
    """Parities of the elements' slots, few and many. Half as many slots: the halves, xor."""
    few, many = (min(max(1 << max(int(each * len(elements)) - 1, 0).bit_length(), least), most) for each, least, most in (SMALL, LARGE))
    odd = np.packbits((np.bincount(elements & (many - 1), minlength=many) & 1).astype(np.uint8))
    return np.bitwise_xor.reduce(odd.reshape(-1, few // 8), axis=0).tobytes(), odd.tobytes()


def _subset_key(some: tuple[int, ...]) -> int:
    x = len(some)
    for e in some:
        x = ((x ^ e & _ALL) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _ALL
        x ^= x >> 31
    return x - (1 << 64) if x >> 63 else x


_ALL = 2**64 - 1


def keys_of(elements: np.ndarray, frequent: np.ndarray, rank: np.ndarray, percent: int, small: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """(keys, positions, kind) of a set's candidates: kind 1 subsets, 0 elements of its prefix."""
    s, out = len(elements), []
    if 0 < s <= small:
        keys = np.array([_subset_key(some) for c in subset_sizes(s, percent) for some in combinations(elements.tolist(), c)], np.int64)
        out.append((keys, np.zeros(len(keys), np.int64), 1))
    # Small sets stay in the lists if a large set can be their partner.
    if s > small or 100 * s >= percent * (small + 1):
        keys = ordered(elements, frequent, rank)[: prefix_length(s, percent)]
        out.append((keys, np.arange(len(keys)), 0))
    return out


class Cell:
    """The classes of one list, or of one cell of a long list, and the possible links between their components."""

    def __init__(self, node, size, rest, label, sketches: list[bytes], failed: list, percent: int):
        self.node, self.size, self.rest, self.percent = node, size, rest, percent
        self.root = np.unique(label, return_inverse=True)[1]
        self.failed = [set(f or ()) for f in failed]
        self.width = np.array([len(s) for s in sketches])
        self.raw, self.rows, self.place = sketches, {}, np.zeros(len(node), np.int64)

    def _sketches(self, which: np.ndarray, width: int) -> np.ndarray:
        """The sketches of members of one width, as rows of words."""
        if width not in self.rows:
            mine = np.flatnonzero(self.width == width)
            self.place[mine] = np.arange(len(mine))
            self.rows[width] = np.frombuffer(b"".join([self.raw[i] for i in mine]), np.uint64).reshape(len(mine), -1)
        return self.rows[width][self.place[which]]

    def partners(self, x: int, others: np.ndarray) -> np.ndarray:
        """Of other members those that x can link with."""
        n, m = self.size[x], self.size[others]
        both = n + m
        ok = (100 * np.minimum(n, m) >= self.percent * np.maximum(n, m)) & ((100 + self.percent) * np.minimum(self.rest[x], self.rest[others]) >= self.percent * both)
        others, both = others[ok], both[ok]
        if not len(others):
            return others
        good = np.zeros(len(others), bool)
        for width in np.unique(self.width[others]).tolist():
            k = np.flatnonzero(self.width[others] == width)
            theirs, own = self._sketches(others[k], width), self._sketches(np.array([x]), int(self.width[x]))
            least = min(theirs.shape[1], own.shape[1])
            theirs, own = (np.bitwise_xor.reduce(a.reshape(len(a), -1, least), axis=1) if a.shape[1] > least else a for a in (theirs, own))
            apart = np.bitwise_count(theirs ^ own).sum(axis=1, dtype=np.int64)
            good[k] = (100 + self.percent) * apart <= (100 - self.percent) * both[k]
        others = others[good]
        if self.failed[x] or any(self.failed[y] for y in others.tolist()):
            u = self.node[x]
            others = np.array([y for y in others.tolist() if self.node[y] not in self.failed[x] and u not in self.failed[y]], np.int64)
        return others

    def members(self) -> list[int]:
        """Members that can link with any other."""
        some = np.zeros(len(self.node), bool)
        for x in range(len(some) - 1):
            others = self.partners(x, np.arange(x + 1, len(some)))
            some[others] = True
            some[x] |= len(others) > 0
        return np.flatnonzero(some).tolist()

    def forest(self, every: bool) -> list[tuple[int, int]]:
        """Pairs of members that span what can be linked (or every possible pair), between components only."""
        root, out = self.root.copy(), []
        for x in np.argsort(-self.rest, kind="stable").tolist():
            others = np.flatnonzero(root != root[x])
            if not len(others):
                break
            others = self.partners(x, others)
            if every:
                out += [(x, y) for y in others.tolist() if x < y]
            elif len(others):
                reached, first = np.unique(root[others], return_index=True)
                out += [(x, y) for y in others[first].tolist()]
                root[np.isin(root, reached)] = root[x]
        return out


def fitting(batches, percent: int):
    """Of batches sorted by key (key, node, what: size, position, kind) the entries that may have a partner in their list.

    Lists of at most ``PAIRED`` entries are compared pair by pair, by sizes and positions; of
    longer ones those entries stay that fit any set of the list's sizes. A list is held in
    pieces of at most ``CELL`` entries; an entry of a further piece fits if any size does.
    """
    import pyarrow as pa

    def some(key, node, what, open_: bool) -> np.ndarray:
        """open_: the last list goes on in the next piece, or the first one has begun before."""
        size, kind = what >> 24, what & 1
        rest = np.where(kind == 1, size, size - ((what >> 1) & ((1 << 23) - 1)))
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        times = np.diff(np.append(starts, len(key)))
        keep = np.zeros(len(key), bool)

        def fits(i, j):
            low, high = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
            return (node[i] != node[j]) & (100 * low >= percent * high) & ((100 + percent) * np.minimum(rest[i], rest[j]) >= percent * (low + high))

        for m in range(2, PAIRED + 1):
            own = starts[times == m]
            for a in range(m if len(own) else 0):
                for b in range(a + 1, m):
                    ok = fits(own + a, own + b)
                    keep[own[ok] + a] = keep[own[ok] + b] = True
        for lo, m in zip(starts[times > PAIRED].tolist(), times[times > PAIRED].tolist()):
            k = slice(lo, lo + m)
            least = np.maximum(-(-percent * size[k] // 100), size[k].min())
            keep[k] = (100 + percent) * rest[k] >= percent * (size[k] + least)
        if open_:
            least = -(-percent * size // 100)
            keep |= ((100 + percent) * rest >= percent * (size + least)) & ((key == key[0]) | (key == key[-1]))
        return keep

    def made(table, open_=False):
        key, node, what = (table.column(c).to_numpy() for c in ("key", "node", "what"))
        keep = some(key, node, what, open_)
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, node, what)], names=["key", "node", "what"])

    held, begun = None, False
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        held = table
        if not len(table):
            continue
        key = table.column("key").to_numpy()
        last = int(np.searchsorted(key, key[-1]))
        if len(table) - last > CELL:
            yield made(table, True)
            held, begun = None, True
        elif last:
            yield made(table.slice(0, last), begun)
            held, begun = table.slice(last), False
    if held is not None and len(held):
        yield made(held, begun)


def possible_links(batches, percent: int, give: str):
    """Record batches (key, u, v) from batches sorted by (key, cell) with key, cell, node, what, sketch, label, failed.

    give: "members" (u a class with any possible link, v its entry's ``what``), or pairs
    between components: a "forest", or "every" one.
    """
    import pyarrow as pa

    def cells(table):
        key, cell = (table.column(c).to_numpy() for c in ("key", "cell"))
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])]))
        return key, starts

    def found(table, key, starts):
        node, what, label = (table.column(c).to_numpy() for c in ("node", "what", "label"))
        sketches, failed = table.column("sketch").to_pylist(), table.column("failed").to_pylist()
        size, kind = what >> 24, what & 1
        rest = np.where(kind == 1, size, size - ((what >> 1) & ((1 << 23) - 1)))
        keys, us, vs = [], [], []
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
            if b - a < 2 or (label[a:b] == label[a]).all():
                continue
            c = Cell(node[a:b], size[a:b], rest[a:b], label[a:b], sketches[a:b], failed[a:b], percent)
            got = [(c.node[x], what[a + x]) for x in c.members()] if give == "members" else [(c.node[x], c.node[y]) for x, y in c.forest(give == "every")]
            keys += [key[a]] * len(got)
            us += [u for u, _ in got]
            vs += [v for _, v in got]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, us, vs)], names=["key", "u", "v"])

    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        key, starts = cells(table) if len(table) else (None, [0])
        # The last cell may go on in the next batch.
        whole, held = table.slice(0, int(starts[-1])), table.slice(int(starts[-1]))
        if len(whole):
            yield found(whole, key[: len(whole)], starts[:-1])
    if held is not None and len(held):
        yield found(held, *cells(held))


class Join:
    def __init__(self, docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT):
        self.docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("doc_id"), "text")
        self.k, self.percent, self.small = k, percent, boundary(percent)
        #: Whether a doc_id has several rows; then a class may have several texts.
        self.seed, self.repeated = 0, True

    def _scan(self, texts: DataFrame, each, schema: str) -> DataFrame:
        """each: sets -> record batch."""
        k = self.k

        def run(batches):
            for batch in batches:
                for _, sets in shingle_sets(batch.column("text"), k):
                    yield from each(sets)

        return texts.select("text").mapInArrow(tidy(run), schema)

    def classes(self) -> DataFrame:
        """(doc_id, n, node, check: the set's signature, small and large sketch) of every row, and of kind 1 the elements that tasks found frequent (doc_id) and how often (n)."""
        percent, seed = self.percent, self.seed

        def run(batches, k=self.k):
            import pyarrow as pa

            pieces, held = [], 0

            def counted():
                u, n = np.unique(np.concatenate([p[0] for p in pieces]), return_inverse=True)
                return u, np.bincount(n, np.concatenate([p[1] for p in pieces])).astype(np.int64)

            def made(ids, n, node, check, bits, kind):
                return pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(x, pa.int64()) for x in (n, node, check)), *(pa.array(x, pa.binary()) for x in zip(*bits)), pa.array(np.full(len(ids), kind, np.int8))],
                    names=["doc_id", "n", "node", "check", "small", "large", "kind"],
                )

            for batch in batches:
                for lo, sets in shingle_sets(batch.column("text"), k):
                    signed = [signature(s, seed) for s in sets]
                    prefixes = [s[: prefix_length(len(s), percent)] for s in sets if len(s)]
                    if prefixes:
                        u, n = np.unique(np.concatenate(prefixes), return_counts=True)
                        pieces.append((u, n.astype(np.int64)))
                        held += len(u)
                        if held > 500_000:
                            # Of what is summed up so far, elements seen once wait no longer; frequent ones come again.
                            u, n = counted()
                            pieces, held = [(u[n > 1], n[n > 1])], int((n > 1).sum())
                    yield made(batch.column("doc_id").slice(lo, len(sets)).cast(pa.int64()), [len(s) for s in sets], [a for a, _ in signed], [b for _, b in signed], [sketches(s) for s in sets], 0)
            u, n = counted() if pieces else (np.zeros(0, np.int64),) * 2
            u, n = u[n > FREQUENT], n[n > FREQUENT]
            if len(u):
                zero = np.zeros(len(u), np.int64)
                yield made(pa.array(u), n, zero, zero, [(None, None)] * len(u), 1)

        return save(self.docs.mapInArrow(tidy(run), "doc_id long, n long, node long, check long, small binary, large binary, kind byte"), "nj-classes")

    def result(self) -> DataFrame:
        """doc_id, n_shingles, component_id of every row."""
        while True:
            both = self.classes()
            rows = both.filter("kind = 0")
            firsts = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.min("n").alias("n"), F.min("check").alias("lo"), F.max("check").alias("hi"))
            firsts = save(firsts, "nj-firsts")
            if firsts.filter("lo <> hi").isEmpty():
                break
            # Two sets with one 64-bit name: other names.
            self.seed += 1
            drop(both, firsts)
        self.repeated = not rows.groupBy("doc_id").count().filter("count > 1").isEmpty()
        top = both.filter("kind = 1").groupBy("doc_id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "doc_id").limit(MAX_FREQUENT).collect()
        frequent, count = np.array([r.doc_id for r in top], np.int64), np.array([r.n for r in top], np.int64)
        order = np.argsort(frequent)
        links = self._links(rows, firsts, frequent[order], count[order])
        # Different sets of one doc_id link.
        own = rows.filter("n > 0").groupBy("doc_id").agg(F.min("node").alias("u"), F.max("node").alias("w")).filter("u <> w").select("doc_id", "u")
        if not own.isEmpty():
            links = links.unionByName(rows.filter("n > 0").join(own, "doc_id").filter("u <> node").select("u", F.col("node").alias("v")).distinct())
        found = components(links)
        least = found.join(firsts.select(F.col("node").alias("node_"), "first"), F.col("node") == F.col("node_")).select("node", "component", "first")
        ids = least.groupBy("component").agg(F.min("first").alias("component_id")).withColumnRenamed("component", "component_")
        linked_ = least.join(ids, F.col("component") == F.col("component_")).select(F.col("node").alias("node_"), "component_id")
        alone = firsts.select(F.col("node").alias("node_"), F.col("first").alias("component_id")).join(found.select(F.col("node").alias("known")), F.col("node_") == F.col("known"), "left_anti")
        out = rows.join(linked_.unionByName(alone), (F.col("node") == F.col("node_")) & (F.col("n") > 0), "left")
        shown = lambda c: F.when(c != NO_ID, c)
        return out.select(shown(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), shown(F.coalesce("component_id", "doc_id")).alias("component_id"))

    def _texts_of(self, nodes: DataFrame, firsts: DataFrame) -> DataFrame:
        """Texts of a class's first document (other sets may be among them, where a doc_id has several)."""
        ids = nodes.join(firsts.select(F.col("node").alias("node_"), "first"), F.col("node") == F.col("node_")).select("first").distinct()
        return self.docs.join(maybe_broadcast(ids), F.col("doc_id") == F.col("first"), "left_semi")

    def _shared(self, rows: DataFrame, firsts: DataFrame, frequent: np.ndarray, rank: np.ndarray) -> DataFrame:
        """key, node, what (size, position and kind of key), m: the lists of classes with possible links. Entries are shuffled once."""
        percent, small, seed = self.percent, self.small, self.seed

        def each(sets):
            import pyarrow as pa

            got = [(signature(s, seed)[0], len(s), *part) for s in sets for part in keys_of(s, frequent, rank, percent, small)]
            if got:
                sizes = [len(keys) for _, _, keys, _, _ in got]
                key, at = np.concatenate([g[2] for g in got]), np.concatenate([g[3] for g in got])
                node, n, kind = (np.repeat(np.array([g[i] for g in got], np.int64), sizes) for i in (0, 1, 4))
                # Place and size in one number: fewer bytes to shuffle.
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), pa.array(n << 24 | at << 1 | kind)], names=["key", "node", "what"])

        one = firsts.select("node", F.col("first").alias("first_"))
        entries = self._scan(self.docs.join(maybe_broadcast(one.select("first_").distinct()), F.col("doc_id") == F.col("first_"), "left_semi"), each, "key long, node long, what long")
        entries = entries.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(lambda batches: fitting(batches, percent)), "key long, node long, what long")
        # A text comes once from each row of its doc_id.
        lists = save(entries.dropDuplicates(["key", "node", "what"]) if self.repeated else entries, "nj-distinct")
        counted = lists.withColumn("m", F.count("*").over(Window.partitionBy("key"))).filter("m > 1")
        sketched = self._sketched(counted, self._brought(counted, rows, one, "small")).withColumns({"cell": F.lit(0).cast("long"), "label": F.col("node"), "failed": F.lit(None).cast("array<long>")})
        short = self._cells(sketched.filter(F.col("m") <= CELL), "members").select("key", F.col("u").alias("node"), F.col("v").alias("what"))
        stay = save(short.unionByName(counted.filter(F.col("m") > CELL).select("key", "node", "what")), "nj-stay")
        # Lists of the same classes become one, in which a class has its foremost position: what fits in any of them fits there.
        of = Window.partitionBy("key")
        named = stay.withColumn("key", F.xxhash64(F.bit_xor(F.xxhash64("node")).over(of), F.count("*").over(of)))
        out = save(named.groupBy("key", "node").agg(F.min("what").alias("what")).withColumn("m", F.count("*").over(of)), "nj-shared")
        drop(lists, stay)
        return out

    def _brought(self, entries: DataFrame, rows: DataFrame, one: DataFrame, size: str) -> DataFrame:
        """node_, sketch: of each class in the entries once."""
        brought = rows.filter("n > 0").select(F.col("node").alias("node_"), F.col("doc_id").alias("id_"), F.col(size).alias("sketch"))
        brought = brought.join(one.withColumnRenamed("node", "own_"), (F.col("node_") == F.col("own_")) & (F.col("id_") == F.col("first_")))
        return brought.join(entries.select("node").distinct(), F.col("node_") == F.col("node"), "left_semi").select("node_", "sketch").dropDuplicates(["node_"])

    def _sketched(self, entries: DataFrame, sketches_: DataFrame) -> DataFrame:
        return entries.join(sketches_, F.col("node") == F.col("node_")).drop("node_")

    def _cells(self, entries: DataFrame, give: str) -> DataFrame:
        percent = self.percent
        dealt = entries.select("key", F.col("cell").cast("long").alias("cell"), "node", "what", "sketch", "label", "failed").repartition("key", "cell").sortWithinPartitions("key", "cell", "node")
        return dealt.mapInArrow(tidy(lambda batches: possible_links(batches, percent, give)), "key long, u long, v long")

    def _links(self, rows: DataFrame, firsts: DataFrame, frequent: np.ndarray, rank: np.ndarray) -> DataFrame:
        """Verified links (u, v) of classes that connect all that links connect."""
        shared = self._shared(rows, firsts, frequent, rank)
        large = save(self._brought(shared, rows, firsts.select("node", F.col("first").alias("first_")), "large"), "nj-large")
        spark = shared.sparkSession
        long_ = not shared.filter(F.col("m") > CELL).isEmpty()
        links = spark.createDataFrame([], "u long, v long")
        failed = spark.createDataFrame([], "u long, v long")
        edges = labelled = None
        for r in range(1, ROUNDS + 1):
            whole, every = r > APART or not long_, r == ROUNDS
            now = shared
            if edges is not None:
                # Lists without a possible link between components are done, but long ones that weren't compared as a whole.
                open_ = edges.select(F.col("key").alias("key_")).distinct()
                if long_ and r <= APART + 1:
                    open_ = open_.unionByName(shared.filter(F.col("m") > CELL).select(F.col("key").alias("key_"))).distinct()
                now = shared.join(open_, F.col("key") == F.col("key_"), "left_semi")
                found = components(links).withColumnRenamed("node", "node_")
                now = now.join(found, F.col("node") == F.col("node_"), "left").withColumn("label", F.coalesce("component", "node")).drop("node_", "component")
                tried = failed.groupBy(F.col("v").alias("node_")).agg(F.collect_set("u").alias("failed"))
                labelled = save(now.join(tried, F.col("node") == F.col("node_"), "left").drop("node_"), "nj-labelled")
                # Lists of one component are done too: they go before the sketches come.
                several = labelled.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select(F.col("key").alias("key_"))
                now = labelled.join(several, F.col("key") == F.col("key_"), "left_semi")
            else:
                now = now.withColumns({"label": F.col("node"), "failed": F.lit(None).cast("array<long>")})
            blocks = F.ceil(F.col("m") / CELL)
            own = F.pmod(F.xxhash64("node", F.lit(min(r, APART + 1))), blocks)
            if whole and long_:
                other = F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1))
                now = now.withColumns({"own": own, "blocks": blocks}).withColumn("other", other).withColumn("cell", F.least("own", "other") * F.col("blocks") + F.greatest("own", "other"))
            else:
                now = now.withColumn("cell", own)
            fresh = save(self._cells(self._sketched(now, large), "every" if every else "forest"), "nj-edges")
            if edges is not None:
                drop(edges, labelled)
            edges = fresh
            if whole and edges.isEmpty():
                break
            pairs = edges.select("u", "v").distinct() if every else edges.groupBy("v").agg(F.min("u").alias("u")).select("u", "v")
            judged = self._verified(pairs, firsts)
            good, bad = judged.filter("linked").select("u", "v"), judged.filter("NOT linked").select("u", "v")
            links = links.unionByName(good)
            failed = failed.unionByName(bad)
        drop(shared, large, edges)
        return links

    def _verified(self, pairs: DataFrame, firsts: DataFrame) -> DataFrame:
        """u, v, linked: judged by their whole sets, which are made of the texts of these pairs only."""
        seed = self.seed
        pairs = save(pairs, "nj-pairs")
        wanted = save(pairs.select(F.col("u").alias("node")).unionByName(pairs.select(F.col("v").alias("node"))).distinct(), "nj-wanted")

        def each(sets):
            import pyarrow as pa

            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
            yield pa.RecordBatch.from_arrays([pa.array([signature(s, seed)[0] for s in sets], pa.int64()), listed], names=["id", "elements"])

        sets = self._scan(self._texts_of(wanted, firsts), each, "id long, elements array<long>")
        sets = save(sets.dropDuplicates(["id"]) if self.repeated else sets, "nj-sets")
        # Members go to their hub's place once; a hub's set isn't copied for each of them.
        members = sets.select(F.col("id").alias("id2"), F.col("elements").alias("e2")).join(maybe_broadcast(pairs), F.col("id2") == F.col("v"))
        hubs = sets.select(F.col("id").alias("id1"), F.col("elements").alias("e1")).join(maybe_broadcast(pairs.select(F.col("u").alias("hub")).distinct()), F.col("id1") == F.col("hub"), "left_semi")
        joined = members.join(hubs, F.col("u") == F.col("id1"))
        shared = F.size(F.array_intersect("e1", "e2"))
        out = save(joined.select("u", "v", (100 * shared >= self.percent * (F.size("e1") + F.size("e2") - shared)).alias("linked")), "nj-links")
        drop(pairs, wanted, sets)
        return out


def linked(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return Join(docs, k, percent).result()


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group of linked ones stays, and all that link with nothing.

    A document is a (doc_id, text): rows of one doc_id, or without any, that differ in text
    are decided apart. The least doc_id of a group stays (null first), of those the
    least hash of the text; of rows equal in both the least in their other columns.
    """
    ids = docs.groupBy(F.coalesce("doc_id", F.lit(NO_ID)).alias("id")).count()
    if ids.filter("count > 1").isEmpty():
        found = save(linked(docs, k, percent), "nj-found")
        away = found.filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("near_copy")).distinct()
        return docs.join(maybe_broadcast(away), docs["doc_id"].eqNullSafe(away["near_copy"]), "left_anti")
    node = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text").alias("node_")
    nodes = docs.select(node, "doc_id", "text")
    found = save(linked(nodes.select(F.col("node_").alias("doc_id"), "text"), k, percent), "nj-found")
    moved = found.filter("doc_id <> component_id")
    grouped = moved.select("doc_id", "component_id").unionByName(moved.select(F.col("component_id").alias("doc_id"), "component_id")).distinct()
    grouped = save(grouped.join(nodes.select("node_", F.col("doc_id").alias("id_")).distinct(), F.col("doc_id") == F.col("node_")).select("node_", "id_", "component_id"), "nj-grouped")
    stays = grouped.groupBy("component_id").agg(F.min(F.struct("id_", "node_")).alias("least")).select("least.node_")
    away = save(grouped.join(stays, "node_", "left_anti").select(F.col("node_").alias("near_copy")), "nj-away")
    kept = docs.withColumn("node_", node)
    kept = kept.join(maybe_broadcast(away), F.col("node_") == F.col("near_copy"), "left_anti")
    # Partial minima, so that no task holds all rows of a text.
    whole = F.struct(*docs.columns)
    order = F.struct(*[F.to_json(c) if isinstance(t.dataType, MapType) else F.col(c) for c, t in zip(docs.columns, docs.schema)])
    return kept.groupBy("node_").agg(F.min_by(whole, order).alias("row_")).select("row_.*")
