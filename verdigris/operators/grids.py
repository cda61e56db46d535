"""Grids of many small tables at once, as numpy arrays inside a task: what `tables` needs of them for its gate and its restoration.

A block holds whole tables whose rows stand together. Its slots stand by table, then by column, then by row, so the slots of a column
are neighbours. Patterns and casts have been tried on each cell before: only their outcomes come here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cells handled at once; a table is never cut.
BLOCK_CELLS = 1 << 16
#: What is known of a cell, as bits of its `flags` (few columns go faster through Arrow); from bit DIGITS on, how many digits its value has.
FLAGS = ("full", "num", "marked", "unit", "total")
DIGITS = 8


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of about BLOCK_CELLS rows that end where a table (first column) does."""
    held, n, enough = [], 0, BLOCK_CELLS
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= enough:
            rows = pa.Table.from_batches(held).combine_chunks()
            cut = int(_begins(rows.column(0))[-1])
            if cut:
                yield rows.slice(0, cut)
            held, n = rows.slice(cut).to_batches(), n - cut
            enough = max(BLOCK_CELLS, 2 * n)
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def _begins(ids: pa.ChunkedArray) -> np.ndarray:
    """Where a new id begins; null is an id."""
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    a, b = ids.slice(1), ids.slice(0, max(0, len(ids) - 1))
    other = pc.if_else(pc.and_(pc.is_valid(a), pc.is_valid(b)), pc.not_equal(a, b), pc.not_equal(pc.is_valid(a), pc.is_valid(b)))
    return np.flatnonzero(np.concatenate(([True], other.to_numpy(zero_copy_only=False).astype(bool))))


def _numbers(column: pa.ChunkedArray, null: float | int = 0) -> np.ndarray:
    return pc.fill_null(column, null).to_numpy()


class Grid:
    """The tables of a block that have a slot. `cell` is each slot's cell, -1 where none reaches; the first row that reaches a slot wins it."""

    def __init__(self, rows: pa.Table):
        begins = _begins(rows.column("table_id"))
        reached = pc.is_valid(rows.column("r")).to_numpy()
        valid = reached & pc.is_valid(rows.column("c")).to_numpy()
        #: Tables without a cell, by their first row.
        self.empty = begins[~np.logical_or.reduceat(reached, begins)]
        table = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, rows.num_rows)))[valid]
        held, table = np.unique(table, return_inverse=True)
        self.first = begins[held]
        self.rows = rows.filter(pa.array(valid)) if not valid.all() else rows
        self.table = table
        r, c, down, right = (_numbers(self.rows.column(k)).astype(np.int64) for k in ("r", "c", "row_span", "col_span"))
        self.c, self.flags = c, _numbers(self.rows.column("flags"))
        size = down * right
        at = np.repeat(np.arange(len(r)), size)
        step = np.arange(len(at)) - np.repeat(np.cumsum(size) - size, size)
        r, c, of = r[at] + step // right[at], c[at] + step % right[at], table[at]
        self.nr, self.nc = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64)
        np.maximum.at(self.nr, of, r + 1)
        np.maximum.at(self.nc, of, c + 1)
        self._lay()
        self.cell = np.full(self.n, -1)
        self.cell[(self.slot_base[of] + c * self.nr[of] + r)[::-1]] = at[::-1]

    def _lay(self) -> None:
        """Tables, rows and columns of the slots, for nr rows and nc columns of each table."""
        size = self.nr * self.nc
        self.n, self.slot_base, self.row_base, self.col_base = int(size.sum()), *(np.cumsum(x) - x for x in (size, self.nr, self.nc))
        self.of = np.repeat(np.arange(len(size)), size)
        self.of_row, self.of_col = np.repeat(np.arange(len(size)), self.nr), np.repeat(np.arange(len(size)), self.nc)
        self.col_rows = np.repeat(self.nr, self.nc)
        self.col_begin = np.cumsum(self.col_rows) - self.col_rows
        self.col = np.repeat(np.arange(len(self.col_rows)), self.col_rows)
        self.r = np.arange(self.n) - self.col_begin[self.col]
        self.row = self.row_base[self.of] + self.r

    def flag(self, name: str) -> np.ndarray:
        """A flag of the cells at each slot, false where there is none."""
        return (self.cell >= 0) & (self.flags >> FLAGS.index(name) & 1).astype(bool)[self.cell] if self.n else np.zeros(0, bool)

    def by_table(self, slots: np.ndarray) -> np.ndarray:
        return np.bincount(self.of[slots], minlength=len(self.nr))

    def describe(self) -> None:
        """Rows of the header, slots of the body, share of numbers among what is written in a column, numeric columns."""
        self.full, self.num = self.flag("full"), self.flag("num")
        top, second = self.r == 0, self.r == 1
        with np.errstate(invalid="ignore"):  # nothing written: no share, so no header row
            n1 = self.by_table(self.full & second)
            head = self.by_table(self.num & top) / self.by_table(self.full & top) < 0.5
            more = (self.by_table(self.num & second) / n1 < 0.5) | (head & (self.by_table(self.full & second & self.flag("marked")) / n1 >= 0.5))
            self.depth = np.maximum(1, head.astype(int) + more)
            self.body = self.r >= self.depth[self.of]
            self.share = np.bincount(self.col[self.body & self.num], minlength=len(self.col_rows)) / np.bincount(self.col[self.body & self.full], minlength=len(self.col_rows))
            self.number = self.share >= 0.8

    def keep(self, text: np.ndarray) -> np.ndarray:
        """From here on only rows and columns that hold a text; returns the slots kept."""
        rows, cols = np.zeros(len(self.of_row), bool), np.zeros(len(self.of_col), bool)
        rows[self.row[text]] = cols[self.col[text]] = True
        kept = np.flatnonzero(rows[self.row] & cols[self.col])
        self.nr, self.nc = np.bincount(self.of_row[rows], minlength=len(self.nr)), np.bincount(self.of_col[cols], minlength=len(self.nr))
        self.cell = self.cell[kept]
        self._lay()
        return kept


def _above(part: np.ndarray, grid: Grid) -> np.ndarray:
    """For each slot the sum of those above it in its column, added from the top."""
    out, total = np.zeros(grid.n), np.zeros(len(grid.col_rows))
    longest = np.argsort(-grid.col_rows, kind="stable")
    begin, lengths = grid.col_begin[longest], -grid.col_rows[longest]
    for r in range(int(grid.col_rows.max(initial=0))):
        m = int(np.searchsorted(lengths, -r, side="left"))
        at = begin[:m] + r
        out[at] = total[:m]
        total[:m] += part[at]
    return out


def _any(by: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, bool)
    out[by] = True
    return out


SIGNALS = [("ragged", pa.float64()), ("blank", pa.float64()), ("head_numbers", pa.float64()), ("off", pa.bool_()), ("unit", pa.bool_()), ("numbers", pa.bool_()), ("wild", pa.bool_()), ("mixed", pa.float64()), ("ordered", pa.bool_()), ("mean", pa.float64()), ("low", pa.float64()), ("empty", pa.bool_())]


def signals(rows: pa.Table, low: float, *carried: str) -> pa.Table:
    """One row a table with what its signals are judged by; what can't be told is null. Carried columns are those of a table's first row."""
    g = Grid(rows)
    g.describe()
    n, cols = len(g.nr), len(g.col_rows)
    head = ~g.body
    # Totals: the label of a row is its first text that is no number.
    labels = np.flatnonzero(g.full & ~g.num)[::-1]
    label = np.full(len(g.of_row), -1)
    label[g.row[labels]] = labels
    total = g.body & ((label >= 0) & g.flag("total")[label])[g.row] if g.n else g.body
    told = pc.is_valid(g.rows.column("value")).to_numpy()[g.cell] & g.body & (g.cell >= 0) if g.n else g.body
    value = np.where(told, _numbers(g.rows.column("value"), 0.0)[g.cell], 0.0) if g.n else np.zeros(0)
    part = told & ~total
    with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
        above, some = _above(np.where(part, value, 0.0), g), np.cumsum(part) - part
        some = some > np.repeat(some[g.col_begin], g.col_rows) if g.n else part
        gap, bound = np.abs(above - value), np.maximum(1.0, np.abs(above) * 0.005)
        # As in SQL, what is not a number is more than any.
        off = total & told & some & g.number[g.col] & ((gap > bound) | (np.isnan(gap) & ~np.isnan(bound)))
        # Digits: the median of a column lies between its two middle ones.
        sized = np.flatnonzero(told & g.number[g.col])
        digits, col = (g.flags >> DIGITS)[g.cell[sized]], g.col[sized]
        digits = digits[np.lexsort((digits, col))]
        has = np.bincount(col, minlength=cols)
        end = np.cumsum(has)
        many = np.flatnonzero(has >= 3)
        begin, end, m = (end - has)[many], end[many], has[many]
        mid = (digits[begin + (m - 1) // 2] + digits[begin + m // 2]) / 2
        wild = many[np.maximum(digits[end - 1] - mid, mid - digits[begin]) >= 3] if len(many) else many
        # Confidences are of cells, not of slots.
        sure = pc.is_valid(g.rows.column("confidence")).to_numpy()
        confidence, by = _numbers(g.rows.column("confidence"), 0.0)[sure], g.table[sure]
        weight = np.where(g.number[g.col_base[by] + g.c[sure]], 2.0, 1.0)
        mean = np.bincount(by, confidence, minlength=n) / np.bincount(by, minlength=n)
        unsure = np.bincount(by, weight * (confidence < low), minlength=n) / np.bincount(by, weight, minlength=n)
        heads = _share(g.by_table(head & g.num), g.by_table(head & g.full))
    mixed = np.full(n, -np.inf)
    np.maximum.at(mixed, g.of_col[g.number], 1 - g.share[g.number])
    per_row = np.bincount(g.row[g.cell >= 0], minlength=len(g.of_row))
    ragged = np.bincount(g.of_row[per_row != g.nc[g.of_row]], minlength=n) / g.nr
    unit = _any(g.of[(g.r <= g.depth[g.of]) & g.flag("unit")], n)
    found = {
        "ragged": ragged, "blank": g.by_table(~g.full) / (g.nr * g.nc), "head_numbers": heads, "off": _any(g.of[off], n), "unit": unit, "numbers": _any(g.of_col[g.number], n), "wild": _any(g.of_col[wild], n),
        "mixed": pa.array(mixed, mask=np.isneginf(mixed)), "ordered": _ordered(g, head), "mean": pa.array(mean, mask=np.bincount(by, minlength=n) == 0), "low": pa.array(unsure, mask=np.bincount(by, minlength=n) == 0), "empty": np.zeros(n, bool),
    }
    at = lambda name, places: rows.column(name).take(pa.array(places))
    out = pa.table([at("table_id", g.first), *(pa.array(x) if isinstance(x, np.ndarray) else x for x in found.values()), *(at(k, g.first) for k in carried)], names=["table_id", *found, *carried])
    none = pa.table([at("table_id", g.empty), *(pa.nulls(len(g.empty), t) if k != "empty" else pa.array(np.ones(len(g.empty), bool)) for k, t in SIGNALS), *(at(k, g.empty) for k in carried)], names=out.column_names)
    return pa.concat_tables([out, none])


def _share(part: np.ndarray, whole: np.ndarray) -> pa.Array:
    """part / whole, null where there is no whole."""
    return pa.array(part / np.maximum(whole, 1), mask=whole == 0)


def _ordered(g: Grid, head: np.ndarray) -> np.ndarray:
    """Whether the years of the header, read by rows, go one way; fewer than three do."""
    dated = pc.is_valid(g.rows.column("years")).to_numpy()
    slots = np.flatnonzero(head & (g.cell >= 0) & dated[g.cell]) if g.n else np.zeros(0, np.int64)
    slots = slots[np.lexsort((g.col[slots], g.r[slots], g.of[slots]))]
    years = g.rows.column("years").combine_chunks().take(pa.array(g.cell[slots]))
    many = pc.binary_length(years).to_numpy() // 4
    year, of = np.array([y[i : i + 4] for y in years.to_pylist() for i in range(0, len(y), 4)], dtype="U4").astype(np.int64), np.repeat(g.of[slots], many)
    step, same = np.diff(year), np.diff(of) == 0
    up, down = _any(of[1:][same & (step > 0)], len(g.nr)), _any(of[1:][same & (step < 0)], len(g.nr))
    return (np.bincount(of, minlength=len(g.nr)) < 3) | ~(up & down)


def both(rows: pa.Table, low: float) -> pa.Table:
    """restore, and before the slots of each table a row without a place that has its signals."""
    place = pa.array(_begins(rows.column("table_id")))
    numbered = rows.append_column("at", pa.array(np.repeat(np.arange(len(place)), np.diff(np.append(place.to_numpy(), rows.num_rows)))))
    first, then = signals(numbered, low, "at"), restore(numbered, "at")
    out = pa.concat_tables([first, then], promote_options="default")
    order = np.argsort(out.column("at").to_numpy(), kind="stable")
    return out.select(["table_id", "r", "c", "content", "confidence", *(k for k, _ in SIGNALS)]).take(pa.array(order))


def restore(rows: pa.Table, *carried: str) -> pa.Table:
    """(table_id, r, c, content, confidence) of the repaired slots, and the carried columns of their table's first row."""
    g = Grid(rows)
    g.keep(g.flag("full"))
    g.describe()
    texts, n = g.rows.column("text").combine_chunks(), g.rows.num_rows
    fixed = g.rows.column("fixed").combine_chunks()
    # A slot's text is a place in the texts of cells, then those put right, then "", then the flattened headers.
    blank = 2 * n
    text = np.where(g.full, g.cell, blank)
    change = g.body & g.number[g.col] & (g.cell >= 0)
    change[change] = pc.is_valid(fixed).to_numpy(zero_copy_only=False)[g.cell[change]]
    text[change] += n
    confidence = pa.array(np.where(g.cell >= 0, g.cell, 0), mask=g.cell < 0)

    # Headers: along the first row from the left, then in the second from above, else from the left.
    cols = np.arange(len(g.col_rows))
    first = _from_left(np.where(g.full[g.col_begin], text[g.col_begin], blank) if g.n else cols, blank, g)
    text[g.col_begin] = first
    deep = (g.depth == 2)[g.of_col]
    below = g.col_begin[deep] + 1
    own = np.full(len(cols), blank)
    own[deep] = np.where(g.full[below], text[below], first[deep])
    second = _from_left(own, blank, g)[deep]
    pool = pa.concat_arrays([texts, fixed, pa.array([""], texts.type)])
    a, b = pool.take(pa.array(first[deep])), pool.take(pa.array(second))
    both = pc.binary_join_element_wise(a, b, pa.scalar("_", texts.type))
    flat = pc.if_else(pc.or_(pc.equal(a, b), pc.equal(a, "")), b, pc.if_else(pc.equal(b, ""), a, both))
    pool = pa.concat_arrays([pool, flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat])
    text[below] = blank + 1 + np.arange(len(below))
    written = text != blank
    written[below] = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    upper = (g.depth == 2)[g.of] & (g.r == 0)
    written[upper] = False  # the row is in the one below it now, and goes
    kept = g.keep(written)
    ids, *others = (rows.column(k).take(pa.array(g.first[g.of])) for k in ("table_id", *carried))
    c = g.col - g.col_base[g.of]
    sure = g.rows.column("confidence").combine_chunks().take(confidence.take(pa.array(kept)))
    return pa.table([ids, pa.array(g.r.astype(np.int32)), pa.array(c.astype(np.int32)), pool.take(pa.array(text[kept])), sure, *others], names=["table_id", "r", "c", "content", "confidence", *carried])


def _from_left(texts: np.ndarray, blank: int, g: Grid) -> np.ndarray:
    """A text for each column: its own, else that of the nearest column to the left in its table that has one."""
    at = np.maximum.accumulate(np.where(texts != blank, np.arange(len(texts)), -1)) if len(texts) else texts
    return np.where(at >= g.col_base[g.of_col], texts[at], blank) if len(texts) else texts
