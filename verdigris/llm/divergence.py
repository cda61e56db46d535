"""Source divergence audit: how the terms of each source differ from its language's and from those of its other sources.

Counts are gathered a batch at a time and summed by Spark. Shares are whole numbers of 10 ** -9. Two sources differ in all
kept terms of a language, but most of them occur in neither: the sum over all terms starts from the shares that absent
terms have (the baseline, the same for all of them), and only terms that occur correct it, in blocks of sources and terms.
The best terms of a group are found by radix: histograms over the values' bits, highest first, find the value of rank k,
histograms over bytes of the terms settle ties, and only what is left is sorted.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import drop, small_batches, written

SHARE = 1_000_000_000
#: What bytes of a text become: letters lower-cased in A-Z, bytes of other letters as they are, all others blank.
TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: Bytes of a text that are looked at together, and counts that a task holds before it hands them on.
TEXT_BYTES, HELD = 1 << 20, 1 << 18
#: Sources in a block, and shares in one deal of block pairs.
SOURCES, DEAL_ROWS = 64, 1 << 15
#: Bits of a value in a histogram, bits of all values, bytes of a term in a histogram, and ties a group that are sorted.
DIGIT, VALUE_BITS, TERM_BYTES, FEW = 10, 30, 4, 1024


#: Languages (a row of a few numbers each) that are broadcast.
LANGS = 1 << 14


@dataclass(frozen=True)
class DivergenceParams:
    """least_docs: documents of a language that a kept term occurs in; prior: added to each count; most: terms a group."""

    least_docs: int = 30
    prior: int = 5
    most: int = 50


def term_counts(text: bytes) -> collections.Counter:
    """Occurrences of each term, block by block; a block ends where a term does."""
    if len(text) <= TEXT_BYTES:
        return collections.Counter(text.translate(TERMS).split())
    found, tail = collections.Counter(), b""
    for at in range(0, len(text), TEXT_BYTES):
        block = text[at : at + TEXT_BYTES].translate(TERMS)
        head, cut, last = block.rpartition(b" ")
        if cut:
            found.update((tail + head).split())
            tail = last
        else:
            tail += block
    found.update(tail.split())
    return found


def gather(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), written: occurrences, and documents with the term; a group's row without a term says that it occurs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[collections.Counter, collections.Counter]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = [(lang, source, term, k, seen[term]) for (lang, source), (n, seen) in held.items() for term, k in n.items()]
            rows += [(lang, source, None, 0, 0) for lang, source in held]
            columns = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())], names=["lang", "source", "term", "n", "docs"])

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, text in zip(langs, sources, batch.column(2)):
                n, seen = held.setdefault((lang, source), (collections.Counter(), collections.Counter()))
                before, found = len(n), term_counts(text.as_py())
                n.update(found)
                seen.update(found.keys())
                size += len(n) - before
                if size >= HELD:
                    yield out()
                    held.clear()
                    size = 0
        if held:
            yield out()

    texts = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    with small_batches(spark):
        parts = texts.mapInArrow(count, "lang string, source string, term binary, n long, docs long")
        return written(spark, parts.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "term-counts")


def share(n: str, total: str, terms: str, prior: int) -> Column:
    """1 + floor(10 ** 9 (n + prior) / (total + prior terms)), exact at any size; null where no term is kept."""
    return F.expr(f"1 + if({terms} > 0, (cast({SHARE} as decimal(10,0)) * cast({n} + {prior} as decimal(20,0))) div cast({total} + {prior} * {terms} as decimal(20,0)), null)")


def per_lang(rows: DataFrame, langs: DataFrame) -> DataFrame:
    """rows with the columns of their language, where it has any. A few languages hold most rows, so these stay where they are while
    languages are as few as they are in practice; beyond LANGS of them none can be that large a part of the rows and the table goes by exchange.
    """
    return rows.join(F.broadcast(langs) if langs.count() <= LANGS else langs, "lang", "left")


class Divergence:
    def __init__(self, spark: SparkSession, docs: DataFrame, p: DivergenceParams = DivergenceParams()):
        self.spark, self.p = spark, p
        counts = gather(spark, docs)
        kept = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= p.least_docs)
        kept = written(spark, kept.drop("docs"), "kept-terms")
        langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n_lang").alias("all_lang"))
        found = counts.where("term IS NOT NULL").select("lang", "source", "term", "n").join(kept, ["lang", "term"])
        found = written(spark, found, "kept-counts")
        sums = found.groupBy("lang", "source").agg(F.sum("n").alias("all_source"))
        groups = counts.where("term IS NULL").select("lang", "source").join(sums, ["lang", "source"], "left")
        groups = per_lang(groups, langs).na.fill(0, ["all_source", "v", "all_lang"])
        #: (lang, source, v, all_source, all_lang, base): every group; base is the share of a kept term that it lacks.
        self.groups = written(spark, groups.withColumn("base", F.coalesce(share("0", "all_source", "v", p.prior), F.lit(0).cast("long"))), "groups")
        told = found.join(self.groups, ["lang", "source"])
        told = told.withColumn("p", share("n", "all_source", "v", p.prior)).withColumn("q", share("n_lang", "all_lang", "v", p.prior))
        #: (lang, source, term, p, q, base): the kept terms that occur in a group, with both shares.
        self.shares = written(spark, told.select("lang", "source", "term", "p", "q", "base"), "shares")
        drop(counts, kept, found)

    def pairs(self) -> DataFrame:
        """(lang, source, item, value): every two sources of a language, each way."""
        spark = self.spark
        blocks = F.ceil(F.col("sources") / SOURCES).cast("int")
        sizes = self.groups.groupBy("lang").agg(F.count(F.lit(1)).alias("sources")).select("lang", blocks.alias("blocks"))
        own = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int")
        held = per_lang(self.shares.select("lang", "source"), sizes).groupBy("lang", own.alias("own")).agg(F.count(F.lit(1)).alias("held"))
        held = held.groupBy("lang").agg(F.max("held").alias("held"))
        # Terms are cut so that two blocks of sources bring about DEAL_ROWS shares to a deal.
        cuts = F.greatest(F.lit(1), F.ceil(2 * F.coalesce("held", F.lit(0)) / DEAL_ROWS)).cast("int")
        sizes = written(spark, sizes.join(held, "lang", "left").select("lang", "blocks", cuts.alias("cuts")), "blocks")
        marks = per_lang(self.groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("p"), "base", "v"), sizes)
        # A source without a term in a deal meets the others' terms there with its baseline, so its mark goes to every deal; v counts once.
        marks = marks.withColumn("cut", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).withColumn("v", F.when(F.col("cut") == 0, F.col("v")).otherwise(F.lit(0).cast("long")))
        rows = per_lang(self.shares.select("lang", "source", "term", "p", "base", F.lit(0).cast("long").alias("v")), sizes).withColumn("cut", F.pmod(F.xxhash64("term"), F.col("cuts")).cast("int"))
        rows = rows.unionByName(marks).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("lang", "cut", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "source", "term", "p", "base", "v")

        def differ(pdf: pd.DataFrame) -> pd.DataFrame:
            """A row for each two sources that meet here and differ by the terms here, or that differ by nothing in the first deal, which has the baseline of all terms."""
            x, y, cut = (int(pdf[k].iloc[0]) for k in ("x", "y", "cut"))
            names, at = np.unique(pdf["source"].to_numpy(dtype=object), return_inverse=True)
            base, total = np.zeros(len(names), np.int64), np.zeros((len(names), len(names)), np.int64)
            block = np.zeros(len(names), np.int64)
            base[at], block[at] = pdf["base"].to_numpy(), pdf["own"].to_numpy()
            apart = np.abs(base[:, None] - base[None, :])
            there = pdf["term"].notna().to_numpy()
            if not there.all():
                total += int(pdf["v"].to_numpy()[~there].max()) * apart
            if there.any():
                words, column = np.unique(pdf["term"].to_numpy(dtype=object)[there], return_inverse=True)
                p, who = pdf["p"].to_numpy()[there].astype(np.int64), at[there]
                order = np.argsort(column, kind="stable")
                for lo in range(0, len(words), 1024):
                    a, b = np.searchsorted(column[order], [lo, lo + 1024])
                    shares = np.repeat(base[:, None], min(1024, len(words) - lo), axis=1)
                    shares[who[order[a:b]], column[order[a:b]] - lo] = p[order[a:b]]
                    for i in range(len(names)):
                        total[i] += np.abs(shares - shares[i]).sum(axis=1) - shares.shape[1] * apart[i]
            met = (block[:, None] == x) & (block[None, :] == y) if x != y else np.triu(np.ones_like(total, dtype=bool), 1)
            i, j = np.nonzero(met & (total != 0) if cut else met)
            return pd.DataFrame({"lang": pdf["lang"].iloc[0], "a": names[i], "b": names[j], "value": total[i, j]})

        met = rows.groupBy("lang", "x", "y", "cut").applyInPandas(differ, "lang string, a string, b string, value long")
        summed = written(spark, met.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pairs")
        back = summed.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
        return summed.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(back)

    def terms(self) -> DataFrame:
        """(lang, source, item, value): of each group the `most` terms whose share is furthest above the language's."""
        above = self.shares.where("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
        return radix_top(self.spark, written(self.spark, above, "above"), ["lang", "source"], self.p.most)

    def audit(self) -> DataFrame:
        """(lang, source, part, item, value, rank), each part ranked by value, then by UTF-8 bytes of the item."""
        w = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item").asc())
        parts = [x.withColumn("rank", F.row_number().over(w)).withColumn("part", F.lit(part)) for part, x in (("pair", self.pairs()), ("term", self.terms()))]
        return parts[0].unionByName(parts[1]).select("lang", "source", "part", "item", "value", "rank")


def _boundary(rows: DataFrame, group: list[str], digit: Column, state: DataFrame | None, k: int, rising: bool) -> DataFrame:
    """(group, digit, need, held), a row for each group in which more than the needed rows are open: the digit at which the count of rows, best
    digits first, reaches what is needed; `need` of the `held` rows with that digit are still to be told. At most 2 ** DIGIT rows (or
    as many prefixes as occur) stand in a group's histogram.
    """
    hist = rows.groupBy(*group, digit.alias("digit")).agg(F.count(F.lit(1)).alias("held"))
    hist = hist.join(state, group) if state is not None else hist.withColumn("need", F.lit(k).cast("long"))
    w = Window.partitionBy(*group).orderBy(F.col("digit").asc() if rising else F.col("digit").desc())
    upto = hist.withColumn("upto", F.sum("held").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    cut = upto.where((F.col("upto") >= F.col("need")) & (F.col("upto") - F.col("held") < F.col("need")))
    return cut.select(*group, "digit", (F.col("need") - F.col("upto") + F.col("held")).alias("need"), "held")


def radix_top(spark: SparkSession, rows: DataFrame, group: list[str], k: int) -> DataFrame:
    """The rows (group, item string, value long from 0 to 2 ** 30 - 1) of the k largest values of each group, ties to the smaller item by bytes.

    No group is sorted: three histograms of ten bits tell the value of rank k, as a prefix that grows; then histograms of the items'
    next bytes narrow the rows with that value, until a group has at most FEW that are open, and those alone are ranked. rows is
    read several times and should be a written table; items must differ within a group.
    """
    state, open_, taken = None, rows, None
    for shift in range(VALUE_BITS - DIGIT, -1, -DIGIT):
        cut = written(spark, _boundary(open_, group, F.shiftright("value", shift), state, k, False), "boundary")
        met = open_.join(cut.select(*group, F.col("digit").alias("_digit")), group, "left")
        # Without a boundary a group has no more rows than are wanted: all of them are in.
        sure = met.where(F.col("_digit").isNull() | (F.shiftright("value", shift) > F.col("_digit"))).select(*rows.columns)
        open_ = written(spark, met.where(F.shiftright("value", shift) == F.col("_digit")).select(*rows.columns), "open")
        state, taken = cut.select(*group, "need"), sure if taken is None else taken.unionByName(sure)
    at, longest = 1, open_.agg(F.max(F.octet_length("item"))).first()[0] or 0
    bytes_ = lambda: F.substring(F.col("item").cast("binary"), at, TERM_BYTES)
    while at <= longest and open_.groupBy(*group).count().where(F.col("count") > FEW).limit(1).count():
        cut = written(spark, _boundary(open_, group, bytes_(), state, k, True), "boundary")
        met = open_.join(cut.select(*group, F.col("digit").alias("_digit")), group, "left")
        sure = met.where(F.col("_digit").isNull() | (bytes_() < F.col("_digit"))).select(*rows.columns)
        open_ = written(spark, met.where(bytes_() == F.col("_digit")).select(*rows.columns), "open")
        state, taken, at = cut.select(*group, "need"), taken.unionByName(sure), at + TERM_BYTES
    w = Window.partitionBy(*group).orderBy(F.col("item").asc())
    last = open_.withColumn("_place", F.row_number().over(w)).join(state, group).where(F.col("_place") <= F.col("need"))
    return taken.unionByName(last.select(*rows.columns))


def source_divergence(spark: SparkSession, docs: DataFrame, p: DivergenceParams = DivergenceParams(), text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has each other source of the language, part `term` the terms above the language's share.

    Terms are runs of letters (all of ASCII else, and nothing beyond it, ends them), lower-cased in A-Z. A null text, language or source is
    ''. A language that keeps no term still has its pairs, with value 0; a language of one source has none. Repeated rows count
    as often as they are there; texts may be of any length; an empty table gives an empty one. Other columns are left out.
    """
    told = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    return Divergence(spark, told, p).audit()
