"""A run-compressed Burrows-Wheeler index of many short strings, and matching statistics streamed through it.

The index keeps the runs of the transform, the suffix position at both ends of each run, and the text itself for
comparing extensions; the suffix array it is made from isn't kept. Queries are streamed from right to left, all in
step: where the next byte heads the current run the match grows by one LF step; else it moves to the run end of
that byte, before or after, whose suffix has more in common with the match, as an r-index does.
"""

from __future__ import annotations

import numpy as np

from .arrays import Hasher

#: Symbols packed in a comparison word, of 9 bits: 0 ends a string, bytes are 1 to 256.
WORD = 7


def _suffix_array(symbols: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order (equal ones by position) and the packed words, by doubling.

    left: bytes to the end of the string. A suffix's rank is the place of the first that is like it so far; only
    suffixes that are like another and not at their end yet are looked at again.
    """
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.uint64), np.zeros(WORD, np.uint64)])
    packed = np.zeros(n, dtype=np.uint64)
    for i in range(WORD):  # nothing counts beyond the end of a string
        packed = packed << np.uint64(9) | np.where(left >= i, padded[i : i + n], np.uint64(0))
    rank, open_, key, width = np.zeros(n, dtype=np.int64), np.arange(n), packed, WORD
    while len(open_):
        order = np.argsort(key)
        key, open_ = key[order], open_[order]
        before = rank[open_]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        group = np.concatenate(([True], before[1:] != before[:-1]))
        first, lead = np.flatnonzero(new), np.flatnonzero(group)
        rank[open_] = before + first[np.cumsum(new) - 1] - lead[np.cumsum(group) - 1]
        alone = new & np.append(new[1:], True)
        open_ = open_[~alone & (left[open_] >= width)]
        key = rank[open_] * np.int64(n + 1) + rank[open_ + width]
        width *= 2
    return np.argsort(rank * np.int64(n) + np.arange(n)), packed


class Places:
    """Which of the ascending starts a row is at or after: a bitmap with counts by 64 bits."""

    def __init__(self, starts: np.ndarray, n: int):
        flags = np.zeros((n // 64 + 1) * 64, dtype=bool)
        flags[starts] = True
        self.bits = np.packbits(flags, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.bits).astype(np.int64)
        self.before = np.cumsum(counts) - counts - 1

    def __call__(self, row: np.ndarray) -> np.ndarray:
        word = row >> 6
        return self.before[word] + np.bitwise_count(self.bits[word] << (63 - (row & 63)).astype(np.uint64))


class RunIndex:
    """strings: the bytes of all strings end to end; lengths: of each; owners: a number of each.

    long: matches of so many bytes are told apart by their least owner.
    """

    def __init__(self, strings: np.ndarray, lengths: np.ndarray, owners: np.ndarray, long: int):
        ends = np.cumsum(lengths + 1) - 1
        symbols = np.zeros(int(ends[-1]) + 1, dtype=np.uint16)
        inside = np.ones(len(symbols), dtype=bool)
        inside[ends] = False
        symbols[inside] = strings.astype(np.uint16) + 1
        n = len(symbols)
        self.left = np.repeat(ends, lengths + 1) - np.arange(n)  # bytes to the end of the string
        order, self.packed = _suffix_array(symbols, self.left)
        before = np.concatenate(([0], symbols[:-1]))[order]  # a string's first byte follows an end
        starts = np.flatnonzero(np.concatenate(([True], before[1:] != before[:-1])))
        self.starts, self.heads = starts, before[starts]
        stops = np.append(starts[1:], n) - 1
        self.stops = stops
        self.sample_first, self.sample_last = order[starts], order[stops]
        # LF of a run's first row: smaller bytes in the text, and the same byte in runs before.
        sizes = stops - starts + 1
        by_byte = np.argsort(self.heads, kind="stable")  # 16-bit keys: a radix sort
        self.lf = np.empty(len(starts), dtype=np.int64)
        self.lf[by_byte] = np.cumsum(sizes[by_byte]) - sizes[by_byte]
        self.byte_runs = self.heads[by_byte].astype(np.int64) * (len(starts) + 1) + by_byte
        self.by_byte = by_byte
        self.run_of = Places(starts, n)
        # Rows whose suffixes share `long` bytes are neighbours; each such interval keeps its least owner.
        whole = np.flatnonzero(self.left >= long)
        prints = np.zeros(n, dtype=np.uint64)
        flat = whole - np.repeat(np.arange(len(lengths)), lengths + 1)[whole]
        prints[whole] = Hasher(strings)(flat, flat + long)
        opens = np.concatenate(([True], (prints[order[1:]] != prints[order[:-1]]) | (self.left[order[1:]] < long)))
        intervals = np.flatnonzero(opens)
        self.interval_of = Places(intervals, n)
        self.least_owner = np.minimum.reduceat(np.repeat(owners, lengths + 1)[order], intervals)

    def _common(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Common prefix lengths of suffixes, as far as most, ends of strings excluded."""
        n, total = len(self.packed), np.zeros(len(a), dtype=np.int64)
        go = np.flatnonzero(total < most)
        while len(go):
            x, y = a[go] + total[go], b[go] + total[go]
            differ = self.packed[np.minimum(x, n - 1)] ^ self.packed[np.minimum(y, n - 1)]
            left = self.left[np.minimum(x, n - 1)]
            same = np.zeros(len(go), dtype=np.int64)
            for i in range(WORD):  # leading symbols that agree
                same += differ < np.uint64(1 << 9 * i)
            total[go] += np.minimum(same, left)
            go = go[(same == WORD) & (left >= WORD) & (total[go] < most[go])]
        return np.minimum(total, most)

    def _step(self, run: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.lf[run] + row - self.starts[run]

    def matching_statistics(self, strings: np.ndarray, lengths: np.ndarray, long: int) -> tuple[np.ndarray, np.ndarray]:
        """For each byte of the queries the longest match that starts there (within its string), and the least
        owner of the first `long` bytes, or the largest integer where the match is shorter.
        """
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        length_at = np.zeros(len(strings), dtype=np.int64)
        owner_at = np.full(len(strings), np.iinfo(np.int64).max)
        order = np.argsort(-lengths, kind="stable")  # lanes that end first drop off the end
        tails, sizes = offsets[1:][order], lengths[order]
        row = np.zeros(len(order), dtype=np.int64)
        at = np.full(len(order), self.sample_first[0], dtype=np.int64)
        match = np.zeros(len(order), dtype=np.int64)
        for i in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -i, side="left"))
            row, at, match = row[:live], at[:live], match[:live]
            byte = strings[tails[:live] - 1 - i].astype(np.int64) + 1
            run = self.run_of(row)
            jump = np.flatnonzero(self.heads[run] != byte)
            if len(jump):
                key = byte[jump] * (len(self.starts) + 1) + run[jump]
                after = np.searchsorted(self.byte_runs, key)
                base = byte[jump] * (len(self.starts) + 1)
                has_after = (after < len(self.byte_runs)) & (self.byte_runs[np.minimum(after, len(self.byte_runs) - 1)] < base + len(self.starts) + 1)
                has_before = (after > 0) & (self.byte_runs[after - 1] >= base)
                next_run, prev_run = self.by_byte[np.minimum(after, len(self.by_byte) - 1)], self.by_byte[after - 1]
                up = np.where(has_before, self._common(at[jump], self.sample_last[prev_run], np.where(has_before, match[jump], 0)), -1)
                down = np.where(has_after, self._common(at[jump], self.sample_first[next_run], np.where(has_after, match[jump], 0)), -1)
                use_down = down > up
                found = has_after | has_before
                new_run = np.where(use_down, next_run, prev_run)
                run[jump] = np.where(found, new_run, run[jump])
                row[jump] = np.where(use_down, self.starts[new_run], self.stops[new_run])
                at[jump] = np.where(use_down, self.sample_first[new_run], self.sample_last[new_run])
                match[jump] = np.maximum(up, down)
            ok = np.ones(live, dtype=bool)
            if len(jump):
                ok[jump[~found]] = False
            row = np.where(ok, self._step(run, row), 0)
            at = np.where(ok, at - 1, self.sample_first[0])
            match = np.where(ok, match + 1, 0)
            where = tails[:live] - 1 - i
            length_at[where] = match
            far = np.flatnonzero(match >= long)
            owner_at[where[far]] = self.least_owner[self.interval_of(row[far])]
        return length_at, owner_at
