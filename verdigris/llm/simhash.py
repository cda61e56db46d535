"""SimHash near-duplicates: fingerprints of word shingles, joined through Gray-order hierarchical indexes.

Fingerprints that differ in at most three bits agree in one of four blocks of 16 bits: each goes to its four blocks.
A block that too many share is cut anew, as the other 48 bits differ in three at most too, and so once more with
the 36 that then remain; a block still too large is dealt out by pairs of its parts. So no link can be missed and no
task gets an unbounded block. Within a task, fingerprints are sorted by Gray rank, neighbours are grouped, and each
node keeps the bits in which its members agree, less those that a node above has. A search goes down from the roots,
adds up the bits in which it differs from the patterns it meets, and drops whole groups once these are too many, or once
all members are in the class of the one that asks. What leaves a task is a row a fingerprint: itself and its class there.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import drop, small_batches, with_key_columns, written

SEED, WORDS, DIFFER = 42, 3, 3
#: Bytes of a text whose words are held at once.
TEXT_BYTES = 1 << 20
#: Members of a block that one index takes; larger blocks are cut anew. Rows of all blocks in one deal.
BLOCK_ROWS, DEAL_ROWS = 1 << 14, 1 << 16
#: Bits of a fingerprint that are still to be cut, and of each of the four blocks they are cut into.
CUTS = ((64, 16), (48, 12), (36, 9))
#: Children of a node, fingerprints that search together, and pairs with a node held at once.
FAN, ASKING, FRONTIER = 8, 4096, 1 << 20
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def fingerprint(text: bytes, k: int = WORDS, seed: int = SEED, block: int = TEXT_BYTES) -> int:
    """Bit i is 1 if it is set in over half of the hashes of the text's k-word shingles, repeats included.

    Fewer than k words are one shingle; no word gives 0. Texts are taken by blocks that end at words' ends.
    """
    ones, n, at, tail, seen = np.zeros(64, dtype=np.int64), 0, 0, [], 0

    def add(shingles: Iterator[bytes]) -> None:
        nonlocal n
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, seed) for s in shingles), dtype=np.uint64)
        if len(hashes):
            ones[:] += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(hashes)

    while at < len(text):
        found = SPACE.search(text, at + block) if at + block < len(text) else None
        end = found.start() if found else len(text)
        new = text[at:end].lower().split()
        seen += len(new)
        tail += new
        add(map(b" ".join, zip(*[tail[i:] for i in range(k)])))
        at, tail = end, tail[-(k - 1) :] if k > 1 else []
    if 0 < seen < k:
        add(iter([b" ".join(tail)]))
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]) if n else 0


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each 64-bit word in the order in which neighbours differ in one bit."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """A forest over fingerprints sorted by (segment, Gray rank), a tree a segment, all of one height.

    levels[0] are the fingerprints; a node of a level above has up to FAN neighbours below. Each has the pattern of the
    bits in which all its members agree, `own` of which its parent hasn't, and the places where its members begin and end.
    """

    def __init__(self, codes: np.ndarray, segment: np.ndarray):
        ones, zeros, begin, end = codes, ~codes, np.arange(len(codes)), np.arange(1, len(codes) + 1)
        self.levels: list[dict[str, np.ndarray]] = []
        child = None
        while True:
            self.levels.append({"pattern": ones, "known": ones | zeros, "begin": begin, "end": end, "child": child, "segment": segment})
            first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1]))) if len(segment) else np.zeros(0, np.int64)
            if len(first) == len(segment):
                break
            place = np.arange(len(segment)) - np.repeat(first, np.diff(np.append(first, len(segment))))
            heads = np.flatnonzero(place % FAN == 0)
            ones, zeros = np.bitwise_and.reduceat(ones, heads), np.bitwise_and.reduceat(zeros, heads)
            child = np.append(heads, len(segment))
            begin, end, segment = begin[heads], end[child[1:] - 1], segment[heads]
        for low, high in zip(self.levels, self.levels[1:]):
            low["own"] = low["known"] & ~np.repeat(high["known"], np.diff(high["child"]))
        self.levels[-1]["own"] = self.levels[-1]["known"]

    def classes(self, codes: np.ndarray, differ: int) -> np.ndarray:
        """The first place that each fingerprint reaches by links within its segment."""
        label = np.arange(len(codes))
        asked, many, root_of = 0, 64, np.searchsorted(self.levels[-1]["segment"], self.levels[0]["segment"])
        while asked < len(codes):
            ask = np.arange(asked, min(asked + many, len(codes)))
            asked, many = asked + many, min(2 * many, ASKING)
            spans = [(np.minimum.reduceat(label, level["begin"]), np.maximum.reduceat(label, level["begin"])) for level in self.levels]
            open_ = [(len(self.levels) - 1, ask, root_of[ask], np.zeros(len(ask), dtype=np.int64))]
            while open_:
                depth, who, node, apart = open_.pop()
                level = self.levels[depth]
                apart = apart + np.bitwise_count((codes[who] ^ level["pattern"][node]) & level["own"][node])
                low, high = (x[node] for x in spans[depth])
                going = (apart <= differ) & (level["begin"][node] < who) & ~((low == high) & (low == label[who]))
                who, node, apart = who[going], node[going], apart[going]
                if not depth:
                    self._unite(label, who, node)
                    continue
                first = level["child"][node]
                many_children = level["child"][node + 1] - first
                upto = np.cumsum(many_children)
                cuts = np.searchsorted(upto, np.arange(FRONTIER, int(upto[-1]) if len(upto) else 0, FRONTIER)).tolist()
                for a, b in zip([0, *cuts], [*cuts, len(who)]):
                    n = many_children[a:b]
                    if b > a:
                        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                        open_.append((depth - 1, np.repeat(who[a:b], n), np.repeat(first[a:b], n) + step, np.repeat(apart[a:b], n)))
        return label

    @staticmethod
    def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Classes of linked places become one: the larger root is hung under the smaller, until all agree."""
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return
            np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
            while not np.array_equal(label, up := label[label]):
                label[:] = up


def _cut(rest: Column, key: Column, part: int, width: int) -> Column:
    """The four structs (key, rest) of what is left of a fingerprint: a block's number and bits join the key, the others stay."""
    out, low = [], lambda n: F.lit((1 << n) - 1).cast("long")
    for i in range(4):
        bits = F.call_function("shiftrightunsigned", rest, F.lit(part * i)).bitwiseAND(low(part))
        above = F.lit(0).cast("long") if part * (i + 1) >= width else F.call_function("shiftrightunsigned", rest, F.lit(part * (i + 1)))
        left = F.call_function("shiftleft", above, F.lit(part * i)).bitwiseOR(rest.bitwiseAND(low(part * i)))
        out.append(F.struct((F.call_function("shiftleft", key, F.lit(part + 2)).bitwiseOR(F.lit(i << part).cast("long")).bitwiseOR(bits)).alias("key"), left.alias("rest")))
    return F.array(*out)


class SimHashJoin:
    """Links between the fingerprints (fp, id) of a written table, whose fp are distinct."""

    def __init__(self, spark: SparkSession, prints: DataFrame, differ: int = DIFFER):
        if not 0 <= differ <= 3:
            raise ValueError("four blocks tell fingerprints that differ in at most three bits")
        self.spark, self.prints, self.differ = spark, prints, differ

    def blocks(self) -> DataFrame:
        """(key, level, x, y, fp, id), written: the members of all blocks that are compared together."""
        spark, done = self.spark, []
        rows = self.prints.select("fp", "id", F.col("fp").alias("rest"), F.lit(1).cast("long").alias("key"))
        for number, (width, part) in enumerate(CUTS):
            cut = rows.withColumn("to", F.explode(_cut(F.col("rest"), F.col("key"), part, width))).select("fp", "id", "to.key", "to.rest")
            cut = written(spark, cut, "blocks")
            sizes = written(spark, cut.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "block-sizes")
            met = written(spark, with_key_columns(cut, sizes, ["key"], "n", cut.count(), "inner"), "met-blocks")
            drop(cut, sizes)
            last = number == len(CUTS) - 1
            parts = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
            own = F.pmod(F.xxhash64("fp"), parts).cast("int")
            here = met if last else met.where(F.col("n") <= BLOCK_ROWS)
            here = here.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
            done.append(here.select("key", F.lit(number).alias("level"), F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "fp", "id"))
            rows = met.where(F.col("n") > BLOCK_ROWS).drop("n")
        out = done[0]
        for more in done[1:]:
            out = out.unionByName(more)
        return written(spark, out, "compared")

    def edges(self) -> DataFrame:
        """(a, b): each id with the one that stands for its class in a block; enough to join all that link."""
        differ, names = self.differ, ["key", "level", "x", "y"]

        def search(pdf: pd.DataFrame) -> pd.DataFrame:
            codes = pdf["fp"].to_numpy().view(np.uint64)
            order = np.lexsort((gray_rank(codes), *[pdf[c].to_numpy() for c in names]))
            codes, ids = codes[order], pdf["id"].to_numpy()[order]
            keys = pdf[names].to_numpy()[order]
            segment = np.cumsum(np.concatenate(([0], (keys[1:] != keys[:-1]).any(axis=1).astype(np.int64))))
            label = GrayIndex(codes, segment).classes(codes, differ)
            linked = np.flatnonzero(label != np.arange(len(label)))
            return pd.DataFrame({"a": ids[linked], "b": ids[label[linked]]})

        compared = self.blocks()
        deals = max(1, -(-compared.count() // DEAL_ROWS))
        found = compared.groupBy(F.pmod(F.xxhash64(*names), F.lit(deals)).alias("deal")).applyInPandas(search, "a long, b long")
        found = written(self.spark, found.where("a <> b").distinct(), "links")
        drop(compared)
        return found


def simhash_classes(spark: SparkSession, docs: DataFrame, k: int = WORDS, differ: int = DIFFER, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row; fingerprints link when at most `differ` bits differ.

    Words are lower-cased in A-Z and cut at space and \\t to \\r. Null, empty and blank texts have fingerprint zero, which
    links like any other. component_id is the smallest id reachable. Rows that share an id are one document, with the links of all
    its texts; a row without an id links with nothing (component null). An empty table gives an empty one. Other columns
    are left out.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py() or b"", k, seed) for t in batch.column(1)), dtype=np.uint64, count=len(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    with small_batches(spark):
        rows = written(spark, texts.mapInArrow(prints, "id long, fp long"), "fingerprints")
        alike = written(spark, rows.where("id IS NOT NULL").groupBy("fp").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows")), "distinct-fingerprints")
        links = SimHashJoin(spark, alike.select("fp", "id"), differ).edges()
        same = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("id")
        # An id with several texts joins the fingerprints of all of them.
        shared = rows.join(same, "id", "left_semi").select("id", "fp").join(alike.select("fp", F.col("id").alias("b")), "fp").select(F.col("id").alias("a"), "b")
        classes = components(spark, links.unionByName(shared.where("a <> b")))
        least = alike.join(classes, "id", "left").select("fp", F.coalesce("component", "id").alias("component"), "rows")
        least = written(spark, least, "classes")
    out = with_key_columns(rows.where("id IS NOT NULL"), least, ["fp"], "rows", rows.count()).select("id", "fp", "component")
    out = out.unionByName(rows.where("id IS NULL").select("id", "fp", F.lit(None).cast("long").alias("component")))
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
