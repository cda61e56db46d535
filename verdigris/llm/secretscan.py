"""Secret scans with Spark's own functions only: patterns, and sliding-window entropy of candidate strings."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of secrets, their patterns and least lengths, in the order that breaks ties.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class EntropyRules:
    """A candidate is a run of [A-Za-z0-9+/_=-] of at least least characters. Its class is the narrowest of
    hex (0-9 a-f, either case), alnum and base64 that holds all its characters. It is a secret if some window
    of `window` characters has at least the class's bits of Shannon entropy, it has a digit and a letter,
    and no allow pattern is found in it.
    """

    least: int = 20
    window: int = 20
    hex_bits: float = 3.0
    alnum_bits: float = 3.7
    base64_bits: float = 3.9
    allow: tuple[str, ...] = (
        r"(?i)example|sample|dummy|placeholder|changeme|x{6,}|0{8,}",
        r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
        r"(?i)abcdefgh|0123456789|qwertyui",
        r"/[A-Za-z]{3,}/",
        r"^[A-Za-z]+(?:[-_=][A-Za-z0-9]{1,12})++$",  # possessive: a repeated group is else matched by recursion, too deep for long runs
    )


CANDIDATE = "[A-Za-z0-9+/_=-]"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


#: Elements that a running fold appends to one array; longer arrays are folded in blocks of so many.
BLOCK = 512
#: Code points in a block of text that spans are cut from.
TEXT_BLOCK = 1 << 15


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, evaluated once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: int, step: Callable[[Column, Column], Column]) -> Column:
    """array<int>: before each value, the fold of those before it. Blocks keep the cost of growing arrays linear."""

    def fold(part: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(part, first, lambda acc, x: F.struct(step(acc["at"], x).cast("int").alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(v) / BLOCK).cast("int") - 1), lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))

    def blocked(parts: Column) -> Column:
        whole = F.transform(parts, lambda p: F.aggregate(p, F.lit(zero), lambda acc, x: step(acc, x).cast("int")))
        return F.flatten(F.zip_with(parts, fold(whole, F.lit(zero)), fold))

    return _bound(values, lambda v: F.when(F.size(v) <= BLOCK, fold(v, F.lit(zero))).otherwise(_bound(blocks(v), blocked)))


def _spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of the pattern's leftmost non-overlapping matches, in code points.

    The matches and the pieces between them alternate, so running lengths place each match.
    """

    def place(found: Column) -> Column:
        lengths = F.zip_with(F.slice(found["pieces"], F.lit(1), F.size(found["hits"])), found["hits"], lambda p, h: F.struct(F.char_length(p).alias("piece"), F.char_length(h).alias("hit")))
        moved = running(F.transform(lengths, lambda x: x["piece"] + x["hit"]), 0, lambda at, x: at + x)
        rows = F.arrays_zip(moved.alias("at"), lengths.alias("n"), found["hits"].alias("hit"))
        return F.transform(rows, lambda r: F.struct((r["at"] + r["n"]["piece"]).alias("start"), (r["at"] + r["n"]["piece"] + r["n"]["hit"]).alias("end"), r["hit"].alias("hit")))

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")
    return _bound(hits, lambda h: F.when(F.size(h) > 0, _bound(F.struct(F.split(text, pattern, -1).alias("pieces"), h.alias("hits")), place)).otherwise(none))


def _peak_entropy(hit: Column, window: int) -> Column:
    """Largest Shannon entropy (bits) over windows of that many characters, from counts updated by one step each.

    With counts c in a window of w characters, H = log2 w - sum(c log2 c) / w; the character that enters raises
    its count, the one that leaves lowers its own, and only those two terms of the sum change. Counts are bytes, by
    the character's place in the alphabet, eight in a long.
    """

    def term(c: Column) -> Column:
        return c * F.log2(F.greatest(c, F.lit(1)))

    def peak(codes: Column) -> Column:
        zero = F.array(*[F.lit(0).cast("long")] * -(-len(ALPHABET) // 8))
        state = F.struct(zero.alias("counts"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("peak"))

        def count(counts: Column, c: Column) -> Column:
            return F.call_function("shiftrightunsigned", F.get(counts, F.shiftright(c, 3)), (c % 8) * 8).bitwiseAND(F.lit(255)).cast("int")

        def moved(acc: Column, x: Column) -> Column:
            enters, leaves, i = x["enters"], x["leaves"], x["i"]
            one = F.lit(1).cast("long")
            counts = F.transform(
                acc["counts"],
                lambda word, j: word + F.when(j == F.shiftright(enters, 3), F.call_function("shiftleft", one, (enters % 8) * 8)).otherwise(F.lit(0).cast("long"))
                - F.when(j == F.shiftright(leaves, 3), F.call_function("shiftleft", one, (leaves % 8) * 8)).otherwise(F.lit(0).cast("long")),
            )
            n, m = count(acc["counts"], enters), count(acc["counts"], leaves)
            change = F.when(enters == leaves, F.lit(0.0)).otherwise(term(n + 1) - term(n) + F.when(leaves >= 0, term(m - 1) - term(m)).otherwise(F.lit(0.0)))
            return _bound(acc["sum"] + change, lambda total: F.struct(
                counts.alias("counts"), total.alias("sum"),
                F.when(i >= window - 1, F.greatest(acc["peak"], F.lit(math.log2(window)) - total / window)).otherwise(acc["peak"]).alias("peak"),
            ))

        steps = F.transform(codes, lambda c, i: F.struct(i.alias("i"), c.alias("enters"), F.when(i >= window, F.get(codes, i - window)).otherwise(F.lit(-8)).alias("leaves")))
        return F.aggregate(steps, state, moved, lambda acc: acc["peak"])

    return _bound(F.transform(F.split(hit, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1), peak)


def _is_secret(hit: Column, rules: EntropyRules) -> Column:
    allowed = F.lit(False)
    for pattern in rules.allow:
        allowed = allowed | hit.rlike(pattern)
    bits = F.when(hit.rlike("^[0-9a-fA-F]+$"), rules.hex_bits).when(hit.rlike("^[A-Za-z0-9]+$"), rules.alnum_bits).otherwise(rules.base64_bits)
    told = hit.rlike("[0-9]") & hit.rlike("[A-Za-z]") & ~allowed
    return F.when(told, _peak_entropy(hit, rules.window) >= bits - 1e-9).otherwise(F.lit(False))


def find_secrets(text: Column, rules: EntropyRules = EntropyRules()) -> Column:
    """struct<base, spans>, each array<struct<start, ord, end, kind>>: secrets that patterns find, and all with those
    that entropy adds, by start, then kind, then end.

    Offsets are code points, ends exclusive. An entropy span that overlaps a pattern's is left out, as that span
    stands already. Null and empty texts have none.
    """
    if not 1 <= rules.window <= 127 or rules.least < rules.window:
        raise ValueError("window must be 1 to 127 characters, and least no less")
    text = F.coalesce(text.cast("string"), F.lit(""))

    def tagged(spans: Column, order: int) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), s["end"].alias("end"), F.lit(KINDS[order]).alias("kind")))

    # A keyword and blanks are at most 24 characters of a match apart from long runs of spaces: group 2 is measured itself.
    assign = F.filter(_spans(text, ASSIGN), lambda s: F.char_length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 12)
    base = F.concat(tagged(assign, 0), tagged(_spans(text, ACCESS), 1), tagged(_spans(text, HEX), 2))
    found = tagged(F.filter(_spans(text, f"{CANDIDATE}{{{rules.least},}}"), lambda s: _is_secret(s["hit"], rules)), 3)
    both = F.struct(F.array_sort(base).alias("base"), found.alias("found"))
    return _bound(both, lambda x: F.struct(x["base"].alias("base"), F.when(F.size(x["found"]) == 0, x["base"]).otherwise(_bound(F.array_sort(F.concat(x["base"], x["found"])), _without_overlaps)).alias("spans")))


def _without_overlaps(spans: Column) -> Column:
    """Sorted spans without those of entropy that overlap another kind's: the furthest end before, the next start after."""
    before = running(F.transform(spans, lambda s: F.when(s["ord"] < 3, s["end"]).otherwise(F.lit(0))), 0, F.greatest)
    far = 2**31 - 1
    after = F.reverse(running(F.reverse(F.transform(spans, lambda s: F.when(s["ord"] < 3, s["start"]).otherwise(F.lit(far)))), far, F.least))
    rows = F.arrays_zip(spans.alias("span"), before.alias("ended"), after.alias("next"))
    return F.transform(F.filter(rows, lambda r: (r["span"]["ord"] < 3) | ((r["ended"] <= r["span"]["start"]) & (r["next"] >= r["span"]["end"]))), lambda r: r["span"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: EntropyRules = EntropyRules()) -> DataFrame:
    """(id, base, spans): the pattern spans, and all spans with those that entropy adds, each sorted.

    One row per input row, repeated rows included; other columns are left out.
    """
    found = docs.select(F.col(id_col), find_secrets(F.col(text_col), rules).alias("found"))
    return found.select(id_col, "found.base", "found.spans")


def mask_secrets(docs: DataFrame, text_col: str = "text", rules: EntropyRules = EntropyRules(), mark: str = "<secret>") -> DataFrame:
    """docs with each run of overlapping secrets in the texts replaced by the mark; null texts stay null, texts without
    secrets and all other columns stay as they are, whatever they are called. An empty table stays empty.
    """
    text = docs[text_col].cast("string")
    masked = _bound(find_secrets(text, rules)["spans"], lambda spans: F.when(F.size(spans) > 0, redacted(text, spans, mark)).otherwise(text))
    return docs.select(*[masked.alias(c) if c == text_col else docs[c] for c in docs.columns])


def redacted(text: Column, spans: Column, mark: str = "<secret>") -> Column:
    """The text with each run of overlapping spans (one at least, sorted) replaced by the mark.

    What stays is cut from blocks of the text, so that a cut doesn't count its way from the start of a long text.
    """

    def between(blocks: Column, begin: Column, end: Column) -> Column:
        first, last = F.floor(begin / TEXT_BLOCK).cast("int"), F.floor((end - 1) / TEXT_BLOCK).cast("int")
        one = F.substr(F.get(blocks, first), begin % TEXT_BLOCK + 1, end - begin)
        more = F.concat(F.substr(F.get(blocks, first), begin % TEXT_BLOCK + 1), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), F.substr(F.get(blocks, last), F.lit(1), (end - 1) % TEXT_BLOCK + 1))
        return F.when(begin >= end, F.lit("")).when(first == last, one).otherwise(more)

    def cut(x: Column) -> Column:
        rows = F.arrays_zip(x["spans"].alias("span"), x["ended"].alias("ended"))
        parts = F.transform(rows, lambda r: F.when(r["span"]["start"] >= r["ended"], F.concat(between(x["blocks"], r["ended"], r["span"]["start"]), F.lit(mark))).otherwise(F.lit("")))
        return F.concat(F.array_join(parts, ""), between(x["blocks"], F.array_max(F.transform(x["spans"], lambda s: s["end"])), x["n"]))

    ended = running(F.transform(spans, lambda s: s["end"]), 0, F.greatest)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))
    return _bound(F.struct(spans.alias("spans"), ended.alias("ended"), blocks.alias("blocks"), F.char_length(text).alias("n")), cut)


def span_text(spans: Column) -> Column:
    """kind:start:end of each, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
