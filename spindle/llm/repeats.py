"""Passages that repeat across documents, found over a whole corpus without comparing all documents.

A window is `width` consecutive symbols (bytes or words) of one document. Windows are routed so that equal ones meet:

1. Every window is named after the smallest hash among its `gram`-symbol pieces. Equal windows have equal names, and
   neighbouring windows mostly share one, so a document is a short list of runs (name, digest of the run's region).
2. Runs are dealt by name. Runs with equal regions repeat whole, which most tasks settle among their own texts before
   dealing; a name that one document alone has is done with.
3. Only regions whose name also occurs with another region are left: they are where a passage begins or ends. Their
   symbols go to the shard of their name. An index of the shard's regions gives the matching statistics of those that
   stream past it: a suffix automaton for words, a run-length Burrows-Wheeler transform with sampled run ends for bytes.
4. A name with more regions than an index should hold is refined: its windows get names by another order of their
   pieces, and at last by all their symbols, and go through steps 2 and 3 again.
5. The removed windows of each document become spans of symbols.

Work follows the input: each step is one shuffle of what is still open, and a passage shared by n documents costs n rows.
Equal windows, runs and regions are recognised in steps 1, 2 and 4 by 64-bit hashes, in step 3 by their symbols.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHash, batch, mix, texts, tidy, union

_B = 0xD1342543DE82EF95
_BI = pow(_B, -1, 2**64)
_K = np.random.default_rng(30).integers(1, 2**63, size=64, dtype=np.uint64) | np.uint64(1)
SEGMENT = 1 << 19
#: Regions that an index holds: of words, of bytes. A name with more of them is refined.
CHUNK = {False: 2_000, True: 8_000}
#: Ways to name a window, from coarse to fine: by its pieces, by another order of them, by all its symbols.
PIECES, OTHER, WHOLE = range(3)


@dataclass(frozen=True)
class Kind:
    """width: symbols of a window; gram: symbols of the pieces that name it; byte: symbols are bytes, otherwise words."""

    width: int
    gram: int
    byte: bool


BYTES, WORDS = Kind(50, 16, True), Kind(20, 6, False)
_pow: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _pow.get(base)
    if have is None or len(have) < n:
        a = np.full(n + 1024, base, dtype=np.uint64)
        a[0] = 1
        have = _pow[base] = np.multiply.accumulate(a)
    return have[:n]


def symbols(text: bytes, kind: Kind, seen: WordHash) -> np.ndarray:
    return np.frombuffer(text, np.uint8) if kind.byte else seen.array(text.split())


def prefix(data: np.ndarray, kind: Kind) -> tuple[np.ndarray, int, np.ndarray]:
    """Prefix sums of a polynomial hash, the symbols by which a range of it is shorter than its text, and the pieces' hashes."""
    if kind.byte:
        eight = np.ndarray((len(data) - 7,), dtype="<u8", buffer=np.ascontiguousarray(data), strides=(1,))
        x, tail = mix(eight * _K[0]), 7
        g = mix(x[:-8] * _K[1] + x[8:]) if kind.gram == 16 else x
    else:
        x, tail = mix(data ^ _K[0]), 0
        g = np.zeros(len(data) - kind.gram + 1, dtype=np.uint64)
        for j in range(kind.gram):
            g += x[j : len(x) - kind.gram + 1 + j] * _K[j + 1]
        g = mix(g)
    h = np.zeros(len(x) + 1, dtype=np.uint64)
    np.cumsum(x * powers(_B, len(x)), out=h[1:])
    return h, tail, g


def smallest(g: np.ndarray, size: int) -> np.ndarray:
    """Minimum of each `size` consecutive values."""
    cur, have, n = g, 1, len(g) - size + 1
    while 2 * have <= size:
        cur = np.minimum(cur[:-have], cur[have:])
        have *= 2
    return np.minimum(cur[:n], cur[size - have : size - have + n])


def inside(offs: np.ndarray, total: int, width: int) -> np.ndarray:
    """Which of the `total` window starts lie within one of the texts that offs delimits."""
    delta = np.zeros(total + 1, dtype=np.int32)
    full = np.diff(offs) >= width
    np.add.at(delta, offs[:-1][full], 1)
    np.add.at(delta, offs[1:][full] - width + 1, -1)
    return np.cumsum(delta[:-1]) > 0


def runs(data: np.ndarray, offs: np.ndarray, kind: Kind, names: int = PIECES) -> tuple[np.ndarray, ...]:
    """(name, digest, text, start in data, windows) of each run; of words, marked with ITSELF if its piece comes again."""
    total = len(data) - kind.width + 1
    h, tail, g = prefix(data, kind)
    ok = inside(offs, total, kind.width)
    if names == WHOLE:
        st = np.flatnonzero(ok)
        n = np.ones(len(st), np.int64)
    else:
        m = smallest(g if names == PIECES else mix(g ^ _K[40]), kind.width - kind.gram + 1)
        new = ok.copy()
        new[1:] &= ~ok[:-1] | (m[1:] != m[:-1])
        st = np.flatnonzero(new)
        stops = np.append(np.flatnonzero(new | ~ok), total)
        n = stops[np.searchsorted(stops, st, "right")] - st
    c = mix((h[st + n - 1 + kind.width - tail] - h[st]) * powers(_BI, len(h))[st] + n.astype(np.uint64))
    if not kind.byte and names != WHOLE and len(st):
        order, size = (g if names == PIECES else mix(g ^ _K[40])), n + kind.width - kind.gram
        ends = np.cumsum(size)
        at = np.arange(ends[-1]) + np.repeat(st - ends + size, size)
        n = n | np.where(np.add.reduceat((order[at] == np.repeat(m[st], size)).astype(np.int64), ends - size) > 1, ITSELF, 0)
    return c if names == WHOLE else m[st], c, np.searchsorted(offs, st, "right") - 1, st, n


RUN = pa.schema([("m", pa.int64()), ("c", pa.int64()), ("id", pa.int64()), ("h", pa.int64()), ("v", pa.int64())])
RUN_SQL = "m long, c long, id long, h long, v long"
RUN_X, RUN_X_SQL = pa.schema([*RUN, ("x", pa.binary())]), RUN_SQL + ", x binary"
#: A run's start and windows in one number, and whether its windows may repeat each other.
SHIFT = 24
WINDOWS, ITSELF = (1 << SHIFT - 1) - 1, 1 << SHIFT - 1


def repeats_of(first: np.ndarray, cols: tuple[np.ndarray, ...], kind: Kind) -> np.ndarray:
    """Which rows of (m, c, id, h, v), sorted, have their region earlier: in a smaller document (first: the smallest that
    has it), or, of words, further up in the same document."""
    again = cols[2] > first
    if not kind.byte:
        again[1:] |= np.logical_and.reduce([x[1:] == x[:-1] for x in cols[:4]])
    return again


def run_maker(kind: Kind, names: int = PIECES):
    """(id, h, text, start) -> the runs of all texts, v = start << SHIFT | windows. Long texts go in overlapping segments.

    start: where the text stands in its document, if it is a region whose windows are to be named anew; such runs carry
    their symbols, x. Runs that repeat others of the same batch have no name any more: they are settled.
    """

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = WordHash()

        def out(parts: list) -> pa.RecordBatch:
            data = np.concatenate([p[3] for p in parts])
            offs = np.cumsum([0, *(len(p[3]) for p in parts)])
            m, c, t, st, n = runs(data, offs, kind, names)
            ids, hs, base = (np.array([p[k] for p in parts], np.int64) for k in range(3))
            cols = m.view(np.int64), c.view(np.int64), ids[t], hs[t], ((base[t] + st - offs[t]) << SHIFT) | n
            order = np.lexsort(cols[::-1])
            cols = tuple(x[order] for x in cols)
            new = np.ones(len(order), bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            first = cols[2][np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
            again = repeats_of(first, cols, kind)
            made = [pa.array(cols[0], mask=again), *cols[1:]]
            if names == PIECES:
                return batch(RUN, made)
            regions = [None] * len(order)
            if names != WHOLE:
                for k in np.flatnonzero(~again).tolist():
                    r = order[k]
                    a, e = st[r] - offs[t[r]], st[r] - offs[t[r]] + (int(n[r]) & WINDOWS) + kind.width - 1
                    w = parts[t[r]][4]
                    regions[k] = w[a:e] if kind.byte else b" ".join(w[a:e])
            return batch(RUN_X, [*made, regions])

        for b in batches:
            parts, held = [], 0
            starts = b.column(3).to_pylist() if names != PIECES else [0] * b.num_rows
            for i, hash_, t, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), starts, strict=True):
                s = symbols(t or b"", kind, seen)
                if i is None or len(s) < kind.width:
                    continue
                w = None if names == PIECES else t if kind.byte else t.split()
                for at in range(0, len(s) - kind.width + 1, SEGMENT):
                    e = at + SEGMENT + kind.width - 1
                    parts.append((i, hash_, base + at, s[at:e], w and w[at:e]))
                    held += len(parts[-1][3])
                    if held >= SEGMENT:
                        yield out(parts)
                        parts, held = [], 0
            if parts:
                yield out(parts)

    return make


OPEN = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("v", pa.int64()), ("m", pa.int64())])
OPEN_SQL = "id long, h long, v long, m long"
OPEN_X, OPEN_X_SQL = pa.schema([*OPEN, ("x", pa.binary())]), OPEN_SQL + ", x binary"


def settle(kind: Kind, names: int = PIECES):
    """Runs sorted by (m, c, id, h, v) -> those that repeat whole (m null) and those still open.

    A run repeats whole if its region occurs earlier. A run is open if its name occurs with another region, for bytes in
    another document, or if its own windows may repeat. Names are handled when all their rows are here, or piecewise when a name has very many.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, prev = None, None  # prev: the first and the last row of the last region, where its name is still going on

        def done(cols: tuple[np.ndarray, ...], whole: bool) -> pa.RecordBatch | None:
            nonlocal prev
            m, c, i = cols[:3]
            step_m, step = np.ones(len(m), bool), np.ones(len(m), bool)
            step_m[1:] = m[1:] != m[:-1]
            step[1:] = step_m[1:] | (c[1:] != c[:-1])
            at = np.maximum.accumulate(np.where(step, np.arange(len(m)), 0))
            first = i[at]
            known = prev is not None and prev[1][0] == m[0]
            if known and prev[1][1] == c[0]:
                first[at == 0] = prev[0]
            again = repeats_of(first, cols, kind)
            if known and not kind.byte:
                again[0] |= prev[1] == tuple(x[0] for x in cols[:4])
            starts = np.flatnonzero(step_m)
            lo, hi, kinds = np.minimum.reduceat(i, starts), np.maximum.reduceat(i, starts), np.add.reduceat(step.astype(int), starts)
            live = ((lo < hi) | (not kind.byte)) & (kinds > 1)
            if known:
                live[0] = True
            if not whole:
                live[-1] = True
            left = ~again & (np.repeat(live, np.diff(np.append(starts, len(m)))) | (cols[4] & ITSELF > 0))
            prev = None if whole else (first[-1], tuple(x[-1] for x in cols[:4]))
            pick = again | left
            if not pick.any():
                return None
            made = [*(x[pick] for x in cols[2:5]), pa.array(m[pick], mask=again[pick])]
            return batch(OPEN, made) if names == PIECES else batch(OPEN_X, [*made, cols[5][pick].tolist()])

        for b in batches:
            named = pc.is_valid(b.column(0))
            old = b.filter(pc.invert(named))
            if old.num_rows:
                yield batch(OPEN if names == PIECES else OPEN_X, [*old.columns[2:5], old.column(0), *old.columns[5:]])
            b = b.filter(named)
            if not b.num_rows:
                continue
            cols = tuple(np.asarray(x) for x in b.columns[:5]) + tuple(np.array([*x.to_pylist(), None], object)[:-1] for x in b.columns[5:])
            if rest is not None:
                cols = tuple(np.concatenate(x) for x in zip(rest, cols, strict=True))
            m = cols[0]
            cut = int(np.searchsorted(m, m[-1], "left"))
            if cut:
                out = done(tuple(x[:cut] for x in cols), True)
                if out is not None:
                    yield out
                cols = tuple(x[cut:] for x in cols)
            rest = cols
            if len(rest[0]) > 200_000:
                out = done(rest, False)
                if out is not None:
                    yield out
                rest = None
        if rest is not None:
            out = done(rest, True)
            if out is not None:
                yield out

    return run


REGION = pa.schema([("m", pa.int64()), ("id", pa.int64()), ("h", pa.int64()), ("s", pa.int64()), ("x", pa.binary())])
REGION_SQL = "m long, id long, h long, s long, x binary"


def region_maker(kind: Kind):
    """(id, h, text, open runs as v and m) -> the symbols of each open run's region."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in REGION]
            held = 0
            for i, h, t, v, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2)), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                w = t if kind.byte else t.split()
                for x, name in zip(v, m, strict=True):
                    s, e = x >> SHIFT, (x >> SHIFT) + (x & WINDOWS) + kind.width - 1
                    for col, y in zip(cols, (name, i, h, s, w[s:e] if kind.byte else b" ".join(w[s:e])), strict=True):
                        col.append(y)
                    held += len(cols[4][-1])
                    if held > 1 << 22:
                        yield batch(REGION, cols)
                        cols, held = [[] for _ in REGION], 0
            if cols[0]:
                yield batch(REGION, cols)

    return make


#: Symbols of a pack, and bits of a symbol: a byte or the end of a region.
PACK, BITS = 7, 9
#: The least difference of two packs whose k-th symbol from the end differs.
FROM = 1 << np.arange(0, PACK * BITS, BITS)


class Marks:
    """A bit for each row, with the number of bits set before each word: rank(row) counts those up to a row."""

    def __init__(self, bits: np.ndarray):
        self.words = np.packbits(np.append(bits, np.zeros(-len(bits) % 64, bool)), bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(counts) - counts

    def rank(self, row: np.ndarray) -> np.ndarray:
        word = row >> 6
        up_to = self.words[word] << (63 - (row & 63)).astype(np.uint64)
        return self.before[word] + np.bitwise_count(up_to)


class RunLengthIndex:
    """Burrows-Wheeler transform of several byte strings, kept as runs, with the places in the text that its run ends
    stand for. The ends of strings are in the order of the strings, so that no match crosses them.

    A match walks over rows: a row stands for a suffix that begins with what is matched. The rows that share their first
    `width` symbols are a block, of which the smallest owner is kept.
    """

    def __init__(self, strings: list[bytes], owners: np.ndarray, width: int):
        sizes = np.array([len(x) for x in strings]) + 1
        ends = np.cumsum(sizes) - 1
        text = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
        text[ends] = 0
        n = len(text)
        self.text = np.append(text, np.zeros(width + PACK, np.int64))
        pack = np.zeros(n, np.int64)
        for k in range(PACK):
            pack = pack << BITS | self.text[k : n + k]
        left = np.repeat(ends, sizes) - np.arange(n)  # symbols before a suffix's end
        for k in range(1, PACK):  # what stands behind an end doesn't count
            short = left < k
            pack[short] = pack[short] >> BITS * (PACK - k) << BITS * (PACK - k)
        self.pack = np.append(pack, np.zeros(width + PACK, np.int64))
        rows = self.sort(pack, left)
        before = text[rows - 1]
        before[rows == 0] = 0
        # the runs: first row, symbol, rows of that symbol before, place of the first and the last row
        new = np.append(True, before[1:] != before[:-1])
        starts = np.flatnonzero(new)
        self.runs, self.starts, self.heads = Marks(new), starts, before[starts]
        lengths = np.diff(np.append(starts, n))
        order = np.lexsort((starts, self.heads))
        ahead = np.cumsum(lengths[order]) - lengths[order]
        self.shift = np.empty(len(starts), np.int64)
        self.shift[order] = ahead - starts[order]  # from a row of the run to the row of the suffix one symbol longer
        self.first, self.last = rows[starts], rows[starts + lengths - 1]
        self.ends = starts + lengths - 1
        self.by_head = self.heads[order] * (len(starts) + 1) + order
        self.order = order
        # blocks of rows that share `width` symbols
        same = np.zeros(n, bool)
        full = np.flatnonzero((left[rows[1:]] >= width) & (left[rows[:-1]] >= width))
        same[full + 1] = self.shared(rows[full], rows[full + 1], np.full(len(full), width)) >= width
        self.blocks = Marks(~same)
        self.least = np.minimum.reduceat(np.repeat(owners, sizes)[rows], np.flatnonzero(~same))

    @staticmethod
    def sort(pack: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Places of the suffixes in their order, by doubling; only those that still tie are sorted again."""
        n, depth = len(pack), PACK
        rows = np.argsort(pack, kind="stable")
        key = pack[rows]
        new = np.append(True, (key[1:] != key[:-1]) | (left[rows[1:]] < depth) | (left[rows[:-1]] < depth))
        rank = np.empty(n, np.int64)
        rank[rows] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        tied = ~new
        tied[:-1] |= ~new[1:]
        todo = rows[tied]
        while len(todo):
            key = rank[todo] * n + rank[todo + depth]
            by = np.argsort(key)
            todo, key = todo[by], key[by]
            group, at = key // n, np.arange(len(todo))
            new_group, new = np.append(True, group[1:] != group[:-1]), np.append(True, key[1:] != key[:-1])
            head = np.maximum.accumulate(np.where(new_group, at, 0))
            rank[todo] = group + np.maximum.accumulate(np.where(new, at, 0)) - head
            tied = ~new
            tied[:-1] |= ~new[1:]
            todo, depth = todo[tied], 2 * depth
        out = np.empty(n, np.int64)
        out[rank] = np.arange(n)
        return out

    def shared(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Symbols that the suffixes at a and b share, at most `most`, of which those of a hold no end."""
        out, on = np.zeros(len(a), np.int64), np.arange(len(a))
        while len(on):
            differ = self.pack[a[on] + out[on]] ^ self.pack[b[on] + out[on]]
            out[on] += PACK - np.searchsorted(FROM, differ, "right")
            on = on[(differ == 0) & (out[on] < most[on])]
        return np.minimum(out, most)

    def stream(self, strings: list[bytes], owners: np.ndarray, width: int) -> np.ndarray:
        """Matching statistics of strings, all at once from their ends: which of their windows, one string's after the
        other's, a smaller owner has. A string is left when its rest is too short for another window."""
        sizes = np.array([len(x) for x in strings])
        data, ends = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1, np.cumsum(sizes)
        hit = np.zeros(len(data), bool)
        at, begin, mine = ends - 1, ends - sizes, owners  # the next symbol and the first one of each string
        row, place, have = np.zeros(len(at), np.int64), np.full(len(at), self.first[0]), np.zeros(len(at), np.int64)
        step = 0
        while len(at):
            c, run = data[at], self.runs.rank(row) - 1
            off = np.flatnonzero(self.heads[run] != c)
            if len(off):
                want = c[off] * (len(self.starts) + 1) + run[off]
                k = np.searchsorted(self.by_head, want)
                after, ahead = self.order[np.minimum(k, len(self.order) - 1)], self.order[np.maximum(k - 1, 0)]
                good_up, good_down = (k < len(self.order)) & (self.heads[after] == c[off]), (k > 0) & (self.heads[ahead] == c[off])
                spot, most = place[off], have[off]
                share_up = np.where(good_up, self.shared(spot, self.first[after], np.where(good_up, most, 0)), -1)
                share_down = np.where(good_down, self.shared(spot, self.last[ahead], np.where(good_down, most, 0)), -1)
                lower = share_down > share_up
                run[off] = np.where(lower, ahead, after)
                row[off] = np.where(lower, self.ends[ahead], self.starts[after])
                place[off] = np.where(lower, self.last[ahead], self.first[after])
                have[off] = np.maximum(share_up, share_down)
                none = off[have[off] < 0]  # a symbol that the index doesn't hold
                row += self.shift[run]
                place -= 1
                have = np.minimum(have, width - 1) + 1
                row[none], place[none], have[none] = 0, self.first[0], 0
            else:
                row += self.shift[run]
                place -= 1
                have = np.minimum(have, width - 1) + 1
            full = np.flatnonzero(have >= width)
            if len(full):
                hit[at[full]] = self.least[self.blocks.rank(row[full]) - 1] < mine[full]
            at = at - 1
            step += 1
            if step % 8 == 0 or step > 100:
                live = (at >= begin) & (have + at - begin + 1 >= width)
                if not live.all():
                    at, begin, mine, row, place, have = (x[live] for x in (at, begin, mine, row, place, have))
            else:
                done = at < begin
                if done.any():
                    live = ~done
                    at, begin, mine, row, place, have = (x[live] for x in (at, begin, mine, row, place, have))
        left = np.repeat(ends, sizes) - np.arange(len(data))
        return hit[left >= width]


def by_run_length(names: np.ndarray, regions: list[bytes], ids: np.ndarray, hs: np.ndarray, kind: Kind) -> np.ndarray:
    """Which windows of all regions, sorted by (name, id), a region of a smaller document has as well.

    The index holds the regions that a later document may match, and those that an earlier one may have matched stream
    past it.
    """
    new = np.append(True, names[1:] != names[:-1])
    starts = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    lo, hi = np.minimum.reduceat(ids, starts)[group], np.maximum.reduceat(ids, starts)[group]
    held, asked = np.flatnonzero(ids < hi), np.flatnonzero(ids > lo)
    windows = np.array([len(x) for x in regions]) - kind.width + 1
    hits = np.zeros(windows.sum(), bool)
    if len(asked):
        index = RunLengthIndex([regions[k] for k in held], ids[held], kind.width)
        hits[np.repeat(ids > lo, windows)] = index.stream([regions[k] for k in asked], ids[asked], kind.width)
    return hits


class Automaton:
    """A suffix automaton over several texts: each path from state 0 spells a string that some text holds."""

    def __init__(self) -> None:
        self.to: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def _copy(self, q: int, size: int) -> int:
        self.to.append(dict(self.to[q]))
        self.link.append(self.link[q])
        self.size.append(size)
        return len(self.to) - 1

    def _turn(self, p: int, c, q: int, copy: int) -> None:
        while p >= 0 and self.to[p].get(c) == q:
            self.to[p][c] = copy
            p = self.link[p]
        self.link[q] = copy

    def add(self, last: int, c) -> int:
        """The state of a text that ends in c, from the state of the text before."""
        to, link, size = self.to, self.link, self.size
        q = to[last].get(c)
        if q is not None:
            if size[q] != size[last] + 1:
                copy = self._copy(q, size[last] + 1)
                self._turn(last, c, q, copy)
                q = copy
            return q
        cur = len(to)
        to.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = cur
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if size[q] != size[p] + 1:
                copy = self._copy(q, size[p] + 1)
                self._turn(p, c, q, copy)
                q = copy
            link[cur] = q
        return cur

    def stream(self, text: list, width: int, own: bool) -> np.ndarray:
        """Matching statistics of a text, as which of its windows of that width the automaton's texts hold. own: the
        text joins the automaton as it goes, so that windows that start earlier in it count as well."""
        to, link, size, state, have, last = self.to, self.link, self.size, 0, 0, 0
        hit = np.zeros(len(text) - width + 1, bool)
        for end, c in enumerate(text):
            while state and c not in to[state]:
                state = link[state]
                have = size[state]
            nxt = to[state].get(c)
            if nxt is not None:
                state, have = nxt, have + 1
                if have >= width:
                    hit[end - width + 1] = True
            if own:
                last = self.add(last, c)
                while state and size[link[state]] >= have:  # a state was split: the match is of the shorter part
                    state = link[state]
        return hit


def by_automaton(names: np.ndarray, regions: list[bytes], ids: np.ndarray, hs: np.ndarray, kind: Kind) -> np.ndarray:
    """As by_run_length; of words, windows of the same document that start earlier count as well. Documents, smallest id
    first, stream past the automaton of those before them, then join it."""
    hits = [np.zeros(0, bool)] * len(regions)
    symbols_of = [list(x) if kind.byte else x.split() for x in regions]

    def grow(index: Automaton, rows: list[int]) -> None:
        for r in rows:
            last = 0
            for c in symbols_of[r]:
                last = index.add(last, c)

    index, done, order = Automaton(), [], np.lexsort((np.arange(len(ids)), ids)).tolist()
    for _, rows in groupby(order, key=lambda r: ids[r]):
        rows = list(rows)
        versions = [[r for r in rows if hs[r] == h] for h in dict.fromkeys(hs[rows].tolist())]
        for k, mine in enumerate(versions):
            if k and not kind.byte:  # another text of the same id: it knows what is before the id, not its fellow
                index = Automaton()
                grow(index, done)
            for r in mine:
                hits[r] = index.stream(symbols_of[r], kind.width, not kind.byte)
        if kind.byte:
            grow(index, rows)
        elif len(versions) > 1:
            for mine in versions[:-1]:
                grow(index, mine)
        done += rows
    return np.concatenate(hits)


SPAN = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("v", pa.int64()), ("m", pa.int64()), ("x", pa.binary())])
SPAN_SQL = "id long, h long, v long, m long, x binary"


def resolver(kind: Kind, index: Callable):
    """Regions sorted by (m, id, h, s) -> runs of windows that occur earlier, v as in runs, m and x null. The regions of
    a name with more of them than an index holds come out as they are, with m and x."""

    def solve(m: np.ndarray, ids: np.ndarray, hs: np.ndarray, starts: np.ndarray, regions: list[bytes]) -> pa.RecordBatch | None:
        hit = index(m, regions, ids, hs, kind)
        if not hit.any():
            return None
        sizes = np.array([len(x) if kind.byte else x.count(b" ") + 1 for x in regions]) - kind.width + 1
        ends = np.cumsum(sizes)
        edge = np.zeros(len(hit), bool)
        edge[(ends - sizes)] = True
        first = np.flatnonzero(hit & (np.append(True, ~hit[:-1]) | edge))
        last = np.flatnonzero(hit & np.append(~hit[1:] | edge[1:], True))
        of = np.searchsorted(ends, first, "right")
        v = (starts[of] + first - (ends - sizes)[of]) << SHIFT | (last - first + 1)
        return batch(SPAN, [ids[of], hs[of], v, pa.nulls(len(of), pa.int64()), pa.nulls(len(of), pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, held, passing = CHUNK[kind.byte], None, None  # passing: the crowded name that goes on

        def flush(cols: list, last: bool) -> Iterator[pa.RecordBatch]:
            """What is whole of cols; the rest is held."""
            nonlocal held, passing
            m, ids, hs, starts, x = cols
            if passing is not None:
                n = int(np.searchsorted(m, passing, "right"))
                if n:
                    yield batch(SPAN, [ids[:n], hs[:n], starts[:n] << SHIFT, m[:n], x[:n]])
                    cols = m, ids, hs, starts, x = [c[n:] for c in (m, ids, hs, starts, x)]
            cuts = [0, *(np.flatnonzero(m[1:] != m[:-1]) + 1).tolist(), *([len(m)] if last and len(m) else [])]
            at = 0  # the first row that is not yet done
            for a, e in zip(cuts, cuts[1:]):
                crowded = e - a > most
                if crowded or e - at > most:
                    if a > at:
                        yield solve(*(c[at:a] for c in cols))
                    at = a
                if crowded:
                    yield batch(SPAN, [ids[a:e], hs[a:e], starts[a:e] << SHIFT, m[a:e], x[a:e]])
                    at = e
            if last:
                if len(m) > at:
                    yield solve(*(c[at:] for c in cols))
                return
            if len(m) and len(m) - cuts[-1] > most:
                if cuts[-1] > at:
                    yield solve(*(c[at : cuts[-1]] for c in cols))
                at, passing = len(m), m[-1]
                k = cuts[-1]
                yield batch(SPAN, [ids[k:], hs[k:], starts[k:] << SHIFT, m[k:], x[k:]])
            held = [c[at:] for c in cols]

        for b in batches:
            for at in range(0, b.num_rows, 4 * most):
                part = b.slice(at, 4 * most)
                cols = [*(np.asarray(c) for c in part.columns[:4]), part.column(4).to_pylist()]
                if held is not None:
                    cols = [*(np.concatenate(c) for c in zip(held[:4], cols[:4], strict=True)), held[4] + cols[4]]
                yield from filter(None, flush(cols, False))
        if held is not None and len(held[0]):
            yield from filter(None, flush(held, True))

    return run


def merged(v: np.ndarray, width: int) -> np.ndarray:
    """Runs of windows -> disjoint sorted (start, end) spans of the symbols that they cover."""
    if not len(v):
        return np.zeros((0, 2), np.int64)
    v = np.sort(v)
    s, e = v >> SHIFT, (v >> SHIFT) + (v & WINDOWS) + width - 1
    e = np.maximum.accumulate(e)
    new = np.append(True, s[1:] > e[:-1])
    at = np.flatnonzero(new)
    return np.stack([s[at], e[np.append(at[1:], len(s)) - 1]], 1)


def repeated_runs(docs: DataFrame, kind: Kind, index: Callable) -> DataFrame:
    """docs(id, h, text) -> (id, h, vs): for each document with any, the runs of windows that occur earlier."""
    scratch = Scratch(docs.sparkSession)
    done, src = [], docs
    for names in (PIECES, OTHER, WHOLE):
        made = src.mapInArrow(tidy(run_maker(kind, names)), RUN_SQL if names == PIECES else RUN_X_SQL)
        # a settled run has no name and may go anywhere
        dealt = made.repartition(F.coalesce("m", F.xxhash64("id", "v"))).sortWithinPartitions("m", "c", "id", "h", "v")
        settled = scratch.keep(dealt.mapInArrow(tidy(settle(kind, names)), OPEN_SQL if names == PIECES else OPEN_X_SQL))
        del made, dealt
        scratch.sweep()
        done.append(settled.where("m is null").select("id", "h", "v"))
        if names == WHOLE:
            break
        region = settled.where("m is not null")
        if names == PIECES:
            mine = region.groupBy("id", "h").agg(F.collect_list(F.struct("v", "m")).alias("r")).select("id", "h", F.col("r.v").alias("v"), F.col("r.m").alias("m"))
            region = docs.join(mine, ["id", "h"]).select("id", "h", "text", "v", "m").mapInArrow(tidy(region_maker(kind)), REGION_SQL)
            del mine
        else:
            region = region.select("m", "id", "h", F.shiftright("v", SHIFT).alias("s"), "x")
        found = scratch.keep(region.repartition("m").sortWithinPartitions("m", "id", "h", "s").mapInArrow(tidy(resolver(kind, index)), SPAN_SQL))
        del region
        scratch.sweep()
        done.append(found.where("m is null").select("id", "h", "v"))
        crowded = found.where("m is not null")
        if not crowded.limit(1).count():
            break
        src = crowded.select("id", "h", F.col("x").alias("text"), F.shiftright("v", SHIFT).alias("s"))
    return union(done).groupBy("id", "h").agg(F.collect_list("v").alias("vs"))


def versioned(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(id, h, text), and whether texts share an id: h tells these apart, and is 0 for all where no two do."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    texts_of = src.where("id is not null").groupBy("id").agg(F.min(F.xxhash64("text")).alias("lo"), F.max(F.xxhash64("text")).alias("hi"))
    several = bool(texts_of.where("lo <> hi").limit(1).count())
    return src.select("id", (F.xxhash64("text") if several else F.lit(0).cast("long")).alias("h"), "text"), several


KEPT = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("removed", pa.int64()), ("spans", pa.int64()), ("sha", pa.string())])


def keeper(kind: Kind):
    """(id, text, vs) -> sizes and the digest of what is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for t, vs in zip(texts(b.column(1)), b.column(2).to_pylist(), strict=True):
                n, gone, kept = cut(t or b"", vs, kind)
                for col, x in zip(cols, (n, int((gone[:, 1] - gone[:, 0]).sum()), len(gone), hashlib.sha256(kept).hexdigest()), strict=True):
                    col.append(x)
            yield batch(KEPT, [b.column(0), *cols])

    return run


def cut(text: bytes, vs: list[int] | None, kind: Kind) -> tuple[int, np.ndarray, bytes]:
    """Symbols of a text, the spans removed from it, and what is left."""
    w = text if kind.byte else text.split()
    gone = merged(np.array(vs or [], np.int64), kind.width)
    kept, at = [], 0
    for s, e in gone.tolist():
        kept.append(w[at:s])
        at = e
    kept.append(w[at:])
    return len(w), gone, b"".join(kept) if kind.byte else b" ".join([x for part in kept for x in part])


def dedup(docs: DataFrame, kind: Kind, index: Callable, id_col: str, text_col: str, size: str) -> DataFrame:
    src, _ = versioned(docs, id_col, text_col)
    out = src.join(repeated_runs(src.where("id is not null and text is not null"), kind, index), ["id", "h"], "left")
    out = out.select("id", "text", "vs").mapInArrow(tidy(keeper(kind)), "id long, n long, removed long, spans long, sha string")
    return out.select(F.col("id").alias(id_col), F.col("n").alias(size), F.col("removed").alias("n_removed"), F.col("spans").alias("n_spans"), F.col("sha").alias("kept_sha256"))


def dedup_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: Callable = by_automaton) -> DataFrame:
    """(id, n_words, n_removed, n_spans, kept_sha256): words of windows that start earlier in the corpus are removed.

    Earlier is a smaller id, or an earlier start in the same text. Null texts have no words. Rows with a null id are
    kept whole. Rows that repeat an id with its text get the same result; rows that repeat it with other texts are
    documents of their own, none earlier than the other. Other columns are ignored. Empty tables give none.
    """
    return dedup(docs, WORDS, index, id_col, text_col, "n_words")


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: Callable = by_run_length) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256): bytes of 50-byte strings that start in a smaller id's text are removed.

    Null texts are empty. Rows with a null id are kept whole. Rows that repeat an id, with its text or another, are none
    earlier than the other. Other columns are ignored. Empty tables give none.
    """
    return dedup(docs, BYTES, index, id_col, text_col, "n_bytes")


def strip_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: Callable = by_run_length) -> DataFrame:
    """The rows of docs, all columns, their texts without what dedup_bytes removes. A character that is cut in part goes
    whole. Nulls stay null, rows with a null id stay as they are."""
    src, several = versioned(docs, id_col, text_col)
    vs = repeated_runs(src.where("id is not null and text is not null"), BYTES, index).toDF("__spindle_id", "__spindle_h", "__spindle_vs")
    same = F.col(id_col).cast("long") == F.col("__spindle_id")
    joined = docs.join(vs, same & (F.xxhash64(F.col(text_col).cast("string")) == F.col("__spindle_h")) if several else same, "left")
    names, at = docs.columns, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [None if t is None else t.decode() if not vs else cut(t, vs, BYTES)[2].decode("utf-8", "ignore") for t, vs in zip(texts(b.column(at)), b.column(len(names)).to_pylist(), strict=True)]
            columns = list(b.columns[: len(names)])
            columns[at] = pa.array(new, type=pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.select(*names, "__spindle_vs").mapInArrow(tidy(run), docs.schema)
