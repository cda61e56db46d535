"""N-gram Jaccard join: exact candidates from part signatures, verified in prefix trees.

Sets of word n-grams are kept as ascending 64-bit hashes, one global order. Their domain is cut into
2 ** level equal parts by the leading bits. Two sets that link differ in at most h = (a + b)(1 - t) / (1 + t)
elements, so at least 2 ** level - h parts hold the same elements; in a global order of part signatures, the
first h + 1 of each then share one. No link can be missed, no count of n-grams over the corpus is needed, and
a signature covers several n-grams spread over the text, so a passage alone makes few candidates.
Each set first goes to the partner that shares most signatures with it. Signatures whose sets are then in one
class are done; in the others, parity sketches (their differing bits never exceed the differing elements) tell
which pairs can link. Each set first meets the closest of another class, which joins large groups of near copies
by a row a set; then all pairs that remain between classes are verified. Sets that go to one partner are stored in
a path-compressed trie, and the trie is joined with the partner and with itself: a walk shares partial overlaps,
prunes subtrees by remaining length, and leaves out sets that earlier walks have joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import LOWER, Hasher, chunks, mix, shingle_hashes, words
from .components import components
from .shared import drop, lean, modest_batches, with_key_columns, written

#: Bytes of sets in one trie (or one larger set), and of all tries that are made together.
TRIE_BYTES, TASK_BYTES = 1 << 20, 4 << 20
#: Members of a signature compared together (squared), rows of signatures in one deal, and pairs returned at once.
BLOCK_SETS, TASK_ROWS, PAIRS = 1024, 16_384, 65_536
#: Times that each set of an open signature meets its closest set of another class, before all that remain are compared.
CLOSEST_ROUNDS = 1
#: Candidate ids are broadcast up to this many rows (8 bytes each); beyond it texts are shuffled to them.
BROADCAST_ROWS = 1 << 20


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ascending distinct hashes of all rows, offsets) over chunks.

    A text of fewer than k words is one shingle, a text of none has an empty set.
    """
    for lo, hi, data, offsets in chunks(column):
        data = LOWER[data]
        starts, ends, rows = words(data, offsets)
        hashes = Hasher(data)(starts, ends)
        grams, of = shingle_hashes(hashes, rows, k)
        count = np.bincount(rows, minlength=hi - lo)
        begin = np.concatenate(([0], np.cumsum(count)))
        bounds = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=hi - lo))))
        sets = []
        for r in range(hi - lo):
            if count[r] >= k:
                sets.append(np.unique(grams[bounds[r] : bounds[r + 1]]))
            elif count[r]:
                total = np.full(1, count[r], dtype=np.uint64)
                for h in hashes[begin[r] : begin[r + 1]]:
                    total = mix(total * np.uint64(31) + h)
                sets.append(total)
            else:
                sets.append(np.zeros(0, np.uint64))
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        yield lo, hi, np.concatenate(sets), np.concatenate(([0], np.cumsum(sizes)))


class Threshold:
    """Jaccard similarity of at least num / den, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def most_different(self, total: np.ndarray) -> np.ndarray:
        """Most elements in just one of two sets with `total` elements together."""
        return total * (self.den - self.num) // (self.den + self.num)

    def least_overlap(self, total: int) -> int:
        return -(-self.num * total // (self.den + self.num))

    def level(self, n: np.ndarray) -> np.ndarray:
        """log2 of the parts for pairs whose larger set has n elements."""
        return np.ceil(np.log2(self.most_different(2 * np.asarray(n)) + 1)).astype(np.int64)

    def largest_partner(self, n: np.ndarray) -> np.ndarray:
        return n * self.den // self.num


def part_signatures(elements: np.ndarray, offsets: np.ndarray, t: Threshold) -> tuple[np.ndarray, np.ndarray]:
    """(row, signature) of what each set must be found by."""
    sizes = np.diff(offsets)
    if not len(elements):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out_rows, out_sigs = [], []
    own, top = t.level(sizes), t.level(t.largest_partner(sizes))
    for step in range(int((top - own).max()) + 1):
        level = own + step
        use = (sizes > 0) & (level <= top)
        if not use.any():
            continue
        # Largest partner whose pairs are on this level: the largest size of that level, if not out of reach.
        partner = t.largest_partner(sizes)
        past = use & (t.level(partner) > level)
        partner[past] = ((1 << level[past]) * (t.den + t.num) - 1) // (2 * (t.den - t.num))
        need = t.most_different(sizes + partner) + 1
        row = np.repeat(np.arange(len(sizes)), np.where(use, sizes, 0))
        these = elements[np.repeat(use, sizes)]
        shift = (64 - level[row]).astype(np.uint64)
        part = np.where(level[row] > 0, these >> np.minimum(shift, np.uint64(63)), np.uint64(0))
        new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (part[1:] != part[:-1]))))
        sums = np.add.reduceat(these, new)
        row, part = row[new], part[new]
        sig = mix(sums + mix(part * np.uint64(64) + level[row].astype(np.uint64) + np.uint64(1)))
        order = np.lexsort((sig, row))
        row, sig = row[order], sig[order]
        first = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=len(sizes)))))
        keep = np.arange(len(row)) - first[row] < need[row]
        out_rows.append(row[keep])
        out_sigs.append(sig[keep])
        # Empty parts come last in the order of signatures; few sets need any.
        for r in np.flatnonzero(use & (np.diff(first) < need)):
            full = np.unique(part[np.searchsorted(row, r) : np.searchsorted(row, r, side="right")]) if level[r] else np.zeros(1, np.uint64)
            empty = np.setdiff1d(np.arange(1 << int(level[r]), dtype=np.uint64), full)[: int(need[r] - (first[r + 1] - first[r]))]
            out_rows.append(np.full(len(empty), r))
            out_sigs.append(mix(empty * np.uint64(64) + np.uint64(int(level[r])) + np.uint64(0x5555)))
    return np.concatenate(out_rows), np.concatenate(out_sigs)


def parity_sketch(elements: np.ndarray, level: int) -> bytes:
    """2 ** (level + 2) bits, 512 at least: the parity of elements by their low bits."""
    bits = 1 << max(9, level + 2)
    return np.packbits((np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def _folded(sketch: bytes, size: int) -> np.ndarray:
    x = np.frombuffer(sketch, dtype=np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


class PrefixTree:
    """A path-compressed trie of ascending sets, kept as their sorted order and what neighbours share."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.ranked = [sets[i] for i in self.order]
        self.lengths = [len(x) for x in self.ranked]
        self.shared = [0] * len(sets)  # elements in common with the set before
        for i in range(1, len(sets)):
            n = min(self.lengths[i - 1], self.lengths[i])
            differ = np.flatnonzero(self.ranked[i - 1][:n] != self.ranked[i][:n])
            self.shared[i] = int(differ[0]) if len(differ) else n

    def matches(self, probe: np.ndarray, t: Threshold) -> list[tuple[int, int]]:
        """(position, overlap) of the sets that reach the threshold with the probe."""
        ranked, shared = self.ranked, self.shared
        found = []
        stack = [(0, len(ranked), 0, 0)] if ranked else []
        while stack:
            lo, hi, depth, overlap = stack.pop()
            down = self.lengths[lo] if hi - lo == 1 else min(shared[lo + 1 : hi])
            edge = ranked[lo][depth:down]
            rest = len(probe)
            if len(edge) and len(probe):
                at = np.searchsorted(probe, edge)
                overlap += int((probe[np.minimum(at, len(probe) - 1)] == edge).sum())
            if down:
                rest = len(probe) - int(np.searchsorted(probe, ranked[lo][down - 1], side="right"))
            lengths = self.lengths[lo:hi]
            if overlap + min(rest, max(lengths) - down) < t.least_overlap(len(probe) + min(lengths)):
                continue
            if hi - lo == 1:
                if overlap and t.den * overlap >= t.num * (len(probe) + lengths[0] - overlap):
                    found.append((self.order[lo], overlap))
                continue
            cut = lo
            for i in range(lo + 1, hi + 1):
                if i == hi or shared[i] == down:
                    stack.append((cut, i, down, overlap))
                    cut = i
        return found

    def spanning(self, first: list[int], t: Threshold) -> list[tuple[int, int, int]]:
        """(position, position, overlap) of links that join all the first ones link with, and every other set with
        what it links with; a set that a walk has joined is not walked for again.
        """
        parent = list(range(len(self.ranked)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        sets = dict(zip(self.order, self.ranked))
        joined, links = set(), []
        for i in [*first, *self.order]:
            if i in joined and i not in first:
                continue
            joined.add(i)
            for j, overlap in self.matches(sets[i], t):
                a, b = root(i), root(j)
                joined.add(j)
                if a != b:
                    parent[a] = b
                    links.append((i, j, overlap))
        return links


class NgramJaccard:
    """The join over one table. docs' ids are whole numbers; rows without an id or with an empty set link with nothing."""

    def __init__(self, spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"):
        modest_batches(spark)
        self.spark, self.k, self.t = spark, k, Threshold(num, den)
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        self.summary = written(spark, self.docs.mapInArrow(self._summarise(), "id long, n long, d1 long, d2 long, sketch binary"), "sets")

    def _summarise(self):
        k, t = self.k, self.t

        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, elements, offsets in shingle_sets(batch.column(1), k):
                    sizes = np.diff(offsets)
                    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64))) for x in (elements, mix(elements))]
                    d1, d2 = (mix(s[offsets[1:]] - s[offsets[:-1]]).view(np.int64) for s in sums)
                    levels = t.level(sizes)
                    sketches = [parity_sketch(elements[a:b], v) if b > a else b"" for a, b, v in zip(offsets[:-1], offsets[1:], levels.tolist())]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(sizes), pa.array(d1), pa.array(d2), pa.array(sketches, pa.binary())], names=["id", "n", "d1", "d2", "sketch"])

        return run

    def _signatures(self, copies: DataFrame) -> DataFrame:
        k, t = self.k, self.t

        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column(0).to_numpy()
                for lo, _, elements, offsets in shingle_sets(batch.column(1), k):
                    rows, sigs = part_signatures(elements, offsets, t)
                    yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(ids[lo + rows])], names=["sig", "id"])

        docs = self.docs.where("id IS NOT NULL")
        docs = docs.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, "id", "left_anti")
        return docs.mapInArrow(run, "sig long, id long")

    def _verified(self, pairs: DataFrame, sizes: DataFrame) -> DataFrame:
        """Links (a, b, overlap), written, that join every two sets of a pair that link: pairs (a, b) are dealt out by a."""
        k, t = self.k, self.t
        pairs = written(self.spark, pairs.join(sizes.select(F.col("id").alias("b"), (8 * F.col("n")).alias("bytes")), "b").select("a", "b", "bytes"), "pairs")
        cuts = pairs.groupBy("a").agg(F.ceil(F.sum("bytes") / TRIE_BYTES).cast("int").alias("cuts"), F.count(F.lit(1)).alias("rows"))
        cuts = written(self.spark, cuts.join(sizes.select(F.col("id").alias("a"), (8 * F.col("n")).alias("bytes")), "a"), "cuts")
        members = with_key_columns(pairs, cuts.select("a", "cuts", "rows"), ["a"], "rows", pairs.count(), "inner")
        members = members.select(F.col("b").alias("id"), F.col("a").alias("probe"), F.pmod(F.xxhash64("b"), "cuts").cast("int").alias("cut"), F.lit(False).alias("asks"), "bytes")
        probes = cuts.select(F.col("a").alias("id"), F.col("a").alias("probe"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), F.lit(True).alias("asks"), "bytes")
        wanted = written(self.spark, members.unionByName(probes), "wanted")
        needed = wanted.select("id").distinct()
        few = needed.count() <= BROADCAST_ROWS
        texts = self.docs.join(F.broadcast(needed) if few else needed, "id", "left_semi")

        @lean
        def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi, elements, offsets in shingle_sets(batch.column(1), k):
                    raw = memoryview(elements.tobytes())
                    yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array([raw[8 * a : 8 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())], names=["id", "elements"])

        @lean
        def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pdf = pd.concat(list(batches), ignore_index=True)
            out = []
            for _, group in pdf.groupby(["probe", "cut"], sort=False).indices.items():
                asks = pdf["asks"].to_numpy(dtype=bool)[group]
                ids, raw = pdf["id"].to_numpy()[group].tolist(), pdf["elements"].to_numpy()[group].tolist()
                names = list(dict.fromkeys(sorted(zip(ids, raw, ~asks), key=lambda x: x[2])))  # the partner comes first
                tree = PrefixTree([np.frombuffer(x, dtype=np.uint64) for _, x, _ in names])
                out += [(names[i][0], names[j][0], n) for i, j, n in tree.spanning([i for i, x in enumerate(names) if not x[2]], t)]
            yield pd.DataFrame(out, columns=["a", "b", "overlap"])

        held = texts.mapInArrow(to_sets, "id long, elements binary").join(wanted.drop("bytes"), "id")
        deal = max(1, -(-(wanted.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES))
        links = held.groupBy(F.pmod(F.xxhash64("probe", "cut"), F.lit(deal)).alias("deal")).applyInPandas(walk, "a long, b long, overlap long").where("a <> b")
        links = written(self.spark, links, "links")
        drop(pairs, cuts, wanted)
        return links

    def links(self) -> tuple[DataFrame, DataFrame]:
        """(links, membership): verified links (a, b) between class representatives, enough to connect every class,
        and (id, n, representative): the smallest id with the same set.
        """
        spark, keys = self.spark, ["n", "d1", "d2"]
        alike = self.summary.where("id IS NOT NULL AND n > 0").groupBy(*keys).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
        alike = written(spark, alike, "equal-sets")
        membership = with_key_columns(self.summary, alike, keys, "rows", self.summary.count())
        membership = membership.select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("least", "id")).alias("rep"), "sketch")
        membership = written(spark, membership.withColumn("sketch", F.when(F.col("id") == F.col("rep"), F.col("sketch"))), "membership")
        drop(self.summary, alike)
        sketches = written(spark, membership.where("id = rep AND n > 0").select("id", "n", "sketch").dropDuplicates(["id"]), "sketches")
        sigs = written(spark, self._signatures(membership.where("id <> rep").select("id").distinct()), "signatures")
        ends = written(spark, sigs.groupBy("sig").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("rows")).where("lo < hi"), "shared-signatures")
        shared = written(spark, with_key_columns(sigs, ends.drop("hi"), ["sig"], "rows", sigs.count(), "inner").drop("rows"), "shared")
        drop(sigs, ends)
        # The first partner of each set: of the smallest ids at its signatures, the one that most of them have.
        met = shared.where("id <> lo").groupBy("id", "lo").agg(F.count(F.lit(1)).alias("votes"))
        met = met.groupBy("id").agg(F.max_by("lo", F.struct("votes", -F.col("lo"))).alias("a")).select("a", F.col("id").alias("b"))
        links = self._verified(met, sketches).select("a", "b")
        for closest in [True] * CLOSEST_ROUNDS + [False]:
            # Signatures that still join several classes.
            classes = written(spark, components(spark, links), "classes")
            placed = shared.select("sig", "id").join(classes, "id", "left").select("sig", "id", F.coalesce("component", "id").alias("component"))
            placed = written(spark, placed, "placed")
            open_ = placed.groupBy("sig").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.count(F.lit(1)).alias("size")).where("c0 < c1")
            open_ = open_.select("sig", "size", F.ceil(F.col("size") / BLOCK_SETS).cast("int").alias("cuts"), (F.col("size") * F.ceil(F.col("size") / BLOCK_SETS)).alias("rows"))
            open_ = written(spark, open_, "open-signatures")
            before, shared = shared, written(spark, with_key_columns(placed, open_.select("sig", "size", "cuts"), ["sig"], "size", placed.count(), "inner").drop("size"), "open")
            drop(before, placed)
            left = written(spark, self._open_pairs(shared, open_, sketches, closest), "open-pairs")
            more = self._verified(left, sketches)
            drop(left, open_)
            links = classes.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more.select("a", "b"))
        drop(shared, sketches)
        return links, membership.select("id", "n", "rep")

    def _open_pairs(self, placed: DataFrame, open_: DataFrame, sketches: DataFrame, closest: bool) -> DataFrame:
        """Pairs (a, b) of different classes that share an open signature and whose sketches let them link: all of them,
        or, with closest, of each set the one with the fewest differing bits (a row a set, however large its groups).
        """
        t = self.t
        rows = placed.join(sketches, "id")
        rows = rows.select("sig", "id", "component", "n", "sketch", F.pmod(F.xxhash64("id"), "cuts").cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("other"))
        rows = rows.select("sig", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "id", "component", "n", "sketch", "own")

        def closest_of(a: list[np.ndarray], b: list[np.ndarray], apart: list[np.ndarray]) -> tuple[np.ndarray, ...]:
            u, v, d = (np.concatenate(z) for z in (a, b, apart))
            u, v, d = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([d, d])
            best = np.lexsort((v, d, u))
            best = best[np.concatenate(([True], u[best][1:] != u[best][:-1]))]
            return u[best], v[best], d[best]

        @lean
        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pdf = pd.concat(list(batches), ignore_index=True)
            keys = pdf[["sig", "x", "y"]].to_numpy()
            order = np.lexsort(keys.T)
            edges = np.flatnonzero(np.concatenate(([True], (keys[order][1:] != keys[order][:-1]).any(axis=1), [True])))
            ids, comps, n, own, sketches = (pdf[c].to_numpy()[order] for c in ("id", "component", "n", "own", "sketch"))
            a, b, apart, held = [], [], [], 0
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                x, y = keys[order[lo], 1:]
                here = np.arange(lo, hi)
                least = min(len(s) for s in sketches[lo:hi])
                bits = np.stack([_folded(s, least) for s in sketches[lo:hi]]).view(np.uint64)
                side = here[own[lo:hi] == y]
                for i in here[own[lo:hi] == x].tolist():
                    j = side[(comps[side] != comps[i]) & ((x != y) | (side > i))]
                    j = j[t.den * np.minimum(n[j], n[i]) >= t.num * np.maximum(n[j], n[i])]
                    if len(j):
                        differ = np.bitwise_count(bits[j - lo] ^ bits[i - lo]).sum(axis=1, dtype=np.int64)
                        allowed = t.most_different(n[j] + n[i])
                        j, share = j[differ <= allowed], (differ / np.maximum(allowed, 1))[differ <= allowed]
                    if len(j):
                        a.append(np.full(len(j), ids[i]))
                        b.append(ids[j])
                        apart.append(share)
                        held += len(j)
                    if held >= PAIRS:  # what is held at once is bounded
                        if closest:
                            a, b, apart = ([z] for z in closest_of(a, b, apart))
                            held = len(a[0])
                        if held >= PAIRS // 2:
                            yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "apart": np.concatenate(apart)})
                            a, b, apart, held = [], [], [], 0
            if held:
                a, b, apart = closest_of(a, b, apart) if closest else (np.concatenate(z) for z in (a, b, apart))
                yield pd.DataFrame({"a": a, "b": b, "apart": apart})

        deal = max(1, -(-(open_.agg(F.sum("rows")).first()[0] or 0) // TASK_ROWS))
        rows = rows.withColumn("deal", F.pmod(F.xxhash64("sig", "x", "y"), F.lit(deal)))
        pairs = rows.groupBy("deal").applyInPandas(compare, "a long, b long, apart double")
        if closest:
            pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "apart")).groupBy("a").agg(F.min(F.struct("apart", "b")).alias("first")).select("a", F.col("first.b").alias("b"))
        return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def classes(self) -> DataFrame:
        """(id, n, component): one row per row of docs; component is the smallest id reachable by links."""
        links, membership = self.links()
        found = components(self.spark, links).withColumnRenamed("id", "rep")
        return membership.join(found, "rep", "left").select("id", "n", F.coalesce("component", "rep").alias("component"))


def jaccard_classes(spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: links are pairs with den * intersection >= num * union of n-gram sets.

    Words are lower-cased in A-Z and cut at space and \\t to \\r. Null and empty texts have an empty set and are a
    component of their own; so is a row without an id (component null). Repeated rows share a component. Other
    columns are left out.
    """
    found = NgramJaccard(spark, docs, k, num, den, id_col, text_col).classes()
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
