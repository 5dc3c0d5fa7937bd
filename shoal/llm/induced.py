"""External induced suffix sorting with common prefixes.

Suffixes of a string are sorted by induction: the leftmost S-type (LMS) suffixes are sorted
through a shorter string of their substrings' names, and every other suffix is induced from the one after it.
The names are found by an induction of their own and the shorter string is sorted by the same means, recursively, until its
length is at most ``base``: then in memory, by prefix doubling.  The queue
between the steps is a monotone priority queue of buckets: tuples (place,
common prefix with the one before) come in rising order, so a bucket is a
sequence of runs.  Common
prefixes follow by the rule lcp(a', b') = 1 + least lcp between a and b.

Memory: every array longer than ``memory`` items (symbols, types, LMS places, names, orders) is a file of the task's
scratch folder, seen through a map whose pages the system may drop; tuples beyond ``memory`` that wait in a queue and
all sorted output go to files too; work is done in blocks of ``memory`` items.  What stays is a few blocks, a few words for each distinct symbol of the string,
and some 100 bytes an item of the base.  The folder is the task's own, like Spark's spill files: a lost task starts anew elsewhere.

Zeros in the string are separators: each is smaller than all other symbols and differs from
every other separator, so no common prefix crosses one.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

NO = np.iinfo(np.int32).max
Block = tuple[np.ndarray, np.ndarray]


class Scratch:
    """Working files of one sort, in the first of Spark's local folders, and how many items may stay in memory."""

    def __init__(self, memory: int, base: int):
        self.memory, self.base, self.files = memory, base, 0
        local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        self.folder = tempfile.TemporaryDirectory(prefix="sort-", dir=local if os.path.isdir(local) else None)

    def path(self) -> str:
        self.files += 1
        return os.path.join(self.folder.name, str(self.files))

    def array(self, n: int, kind) -> np.ndarray:
        return np.zeros(n, kind) if n <= self.memory else np.memmap(self.path(), kind, "w+", shape=(n,))

    def blocks(self, n: int) -> Iterator[tuple[int, int]]:
        return ((i, min(n, i + self.memory)) for i in range(0, n, self.memory))

    def close(self) -> None:
        self.folder.cleanup()


class Tape:
    """Rows of longs, appended in blocks and read in slices; a file once there are more than `memory`."""

    def __init__(self, scratch: Scratch, width: int, most: int | None = None):
        self.scratch, self.width, self.most = scratch, width, scratch.memory if most is None else most
        self.rows, self.held, self.waiting, self.file = 0, [], 0, None

    def append(self, *columns: np.ndarray) -> None:
        block = np.stack(columns, axis=1).astype(np.int64)
        self.held.append(block)
        self.rows += len(block)
        self.waiting += len(block)
        if self.waiting > self.most:
            self._write()

    def _write(self) -> None:
        if self.file is None:
            self.file = open(self.scratch.path(), "w+b")  # noqa: SIM115
        self.file.seek(0, 2)
        for block in self.held:
            self.file.write(block.tobytes())
        self.held, self.waiting = [], 0

    def read(self, i: int, j: int) -> np.ndarray:
        """Rows i to j, one array a column."""
        if self.file is not None:
            if self.held:
                self._write()
            self.file.seek(8 * self.width * i)
            return np.frombuffer(self.file.read(8 * self.width * (j - i)), np.int64).reshape(-1, self.width).T
        if len(self.held) > 1:
            self.held = [np.concatenate(self.held)]
        return self.held[0][i:j].T if self.held else np.empty((self.width, 0), np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            os.unlink(self.file.name)

    def forwards(self, i: int, j: int) -> Iterator[Block]:
        i, j = int(i), int(j)
        for a in range(i, j, self.scratch.memory):
            yield tuple(self.read(a, min(j, a + self.scratch.memory)))

    def backwards(self, i: int, j: int) -> Iterator[Block]:
        """(place, lcp) rows from the last to the first, each with its lcp to the one after it; the first has 0."""
        i, j = int(i), int(j)
        for b in range(j, i, -self.scratch.memory):
            a = max(i, b - self.scratch.memory)
            places, lcps = self.read(a, min(j, b + 1))
            after = np.append(lcps[1:], [] if b < j else 0).astype(np.int64)
            yield places[: b - a][::-1], after[::-1]


class Queue:
    """Priority queue of (place, lcp) tuples by bucket, taken from in the order of the scan; tuples of a bucket come as they were pushed.

    Buckets lie in groups, in the order of the scan, of about `memory` symbols of the string or one bucket each.
    Tuples for later groups wait in a file a group; as the scan reaches a group its file is sorted by
    bucket, in memory, and tuples for the group at hand wait there.  A bucket with more than that is read in blocks.
    """

    def __init__(self, scratch: Scratch, symbols: np.ndarray, counts: np.ndarray):
        """symbols in the order of the scan, with how often each stands in the string."""
        self.scratch, self.symbols = scratch, symbols
        rising = symbols[-1] > symbols[0] or len(symbols) == 1
        self.sorted, self.flip = (symbols, False) if rising else (symbols[::-1], True)
        heavy = counts > scratch.memory  # a group of its own
        group = np.cumsum(np.where(heavy, 0, counts)) // scratch.memory + 2 * np.cumsum(heavy) - heavy
        self.group = group if rising else group[::-1]  # of each of the sorted symbols
        self.now, self.tapes, self.rank, self.ready, self.late = -1, {}, 0, None, {}

    def group_of(self, buckets: np.ndarray) -> np.ndarray:
        return self.group[np.searchsorted(self.sorted, buckets)]

    def push(self, buckets: np.ndarray, places: np.ndarray, lcps: np.ndarray) -> None:
        """Tuples in rising order; any buckets."""
        group = self.group_of(buckets)
        here = group == self.now
        if here.any():
            if here.all():
                self._keep(buckets, places, lcps)
            else:
                self._keep(buckets[here], places[here], lcps[here])
        if here.all():
            return
        later = np.flatnonzero(~here)
        later = later[np.argsort(group[later], kind="stable")]
        cut = np.flatnonzero(np.append(True, group[later][1:] != group[later][:-1]))
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(later)]):
            at, g = later[i:j], int(group[later[i]])
            if g not in self.tapes:
                self.tapes[g] = Tape(self.scratch, 3, max(64, self.scratch.memory // (int(self.group.max()) + 1)))
            self.tapes[g].append(buckets[at], places[at], lcps[at])

    def _keep(self, buckets, places, lcps) -> None:
        if len(buckets) == 1:
            self.late.setdefault(int(buckets[0]), []).append((places, lcps))
            return
        order = np.argsort(buckets, kind="stable")
        cut = np.flatnonzero(np.append(True, buckets[order[1:]] != buckets[order[:-1]]))
        for i, j in zip(cut.tolist(), [*cut[1:].tolist(), len(order)]):
            self.late.setdefault(int(buckets[order[i]]), []).append((places[order[i:j]], lcps[order[i:j]]))

    def _enter(self, g: int) -> None:
        self.now, tape = g, self.tapes.pop(g, None)
        self.ready = None
        if tape is not None and tape.rows > 2 * self.scratch.memory:  # one bucket: a group of several has fewer
            self.ready = tape
        elif tape is not None:
            rows = tape.read(0, tape.rows)
            rows = rows[:, np.argsort(-rows[0] if self.flip else rows[0], kind="stable")]
            heads = np.flatnonzero(np.append(True, rows[0, 1:] != rows[0, :-1]))
            self.ready = rows, dict(zip(rows[0, heads].tolist(), zip(heads.tolist(), [*heads[1:].tolist(), rows.shape[1]])))
            tape.close()

    def drain(self, bucket: int) -> Iterator[Block]:
        """The bucket's tuples in blocks, those pushed meanwhile included."""
        g = int(self.group[np.searchsorted(self.sorted, bucket)])
        if g != self.now:
            self._enter(g)
        if isinstance(self.ready, Tape):
            for rows in self.ready.forwards(0, self.ready.rows):
                yield rows[1], rows[2]
            self.ready.close()
            self.ready = None
        elif self.ready is not None and bucket in self.ready[1]:
            i, j = self.ready[1].pop(bucket)
            yield self.ready[0][1, i:j], self.ready[0][2, i:j]
        while bucket in self.late:
            runs = self.late.pop(bucket)
            yield runs[0] if len(runs) == 1 else tuple(np.concatenate(x) for x in zip(*runs))


class Pusher:
    """Pushes what a block of sorted suffixes induces, and follows the least lcp since the last push of each bucket."""

    def __init__(self, queue: Queue, symbols: int):
        self.queue, self.least = queue, np.full(symbols, -1, np.int64)  # -1: nothing pushed yet

    def __call__(self, lcps: np.ndarray, at: np.ndarray, buckets: np.ndarray, places: np.ndarray) -> None:
        """lcps of the block's items; at: which of them push; to which buckets; which places."""
        m = len(lcps)
        every = int(lcps.min()) if m else NO
        if not len(at):
            np.minimum(self.least, every, out=self.least)
            return
        order = np.argsort(buckets, kind="stable")
        at, buckets, places = at[order], buckets[order], places[order]
        first = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]]))
        last = np.append(first[1:], len(at)) - 1
        start = np.empty(len(at), np.int64)
        start[1:] = at[:-1] + 1
        start[first] = 0
        padded = np.append(lcps, NO)
        low = np.minimum.reduceat(padded, np.stack([start, at + 1], axis=1).ravel())[::2]
        mine = buckets[first]
        low[first] = np.minimum(low[first], self.least[mine])
        after = np.minimum.reduceat(padded, np.stack([at[last] + 1, np.full(len(last), m)], axis=1).ravel())[::2]
        after = np.where(at[last] + 1 < m, after, NO)
        np.minimum(self.least, every, out=self.least)
        self.least[mine] = after
        self.queue.push(buckets, places, low + 1)  # -1 + 1: a bucket's first item


def types(t: np.ndarray, scratch: Scratch) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is S-type, and the length of the run of equal symbols from each place; blocks from the last to the first."""
    rises, runs = scratch.array(len(t), bool), scratch.array(len(t), np.int32)
    for i, j in reversed(list(scratch.blocks(len(t)))):
        x = np.asarray(t[i : j + 1])
        y, m = x[: j - i], j - i
        at_end = np.ones(int(j == len(t)), bool)
        change = np.append(x[1:] != x[:-1], at_end)[:m] | (y == 0)
        up = np.append(x[1:] > x[:-1], at_end)[:m] | (y == 0)
        ends = np.flatnonzero(change)
        which = np.cumsum(change) - change
        open_ = which == len(ends)  # the last run goes on in the block after
        end = np.append(ends, m)[which]
        rises[i:j] = np.where(open_, rises[j] if j < len(t) else True, up[np.minimum(end, m - 1)])
        runs[i:j] = np.where(open_, m + (runs[j] if j < len(t) else 0), end + 1) - np.arange(m)
    return rises, runs


def leftmost(s_type: np.ndarray, scratch: Scratch) -> np.ndarray:
    """Places of S-type suffixes after one that isn't."""
    found = Tape(scratch, 1)
    for i, j in scratch.blocks(len(s_type)):
        found.append(i + np.flatnonzero(s_type[i:j] & ~np.concatenate([[i == 0 or s_type[i - 1]], s_type[i : j - 1]]).astype(bool)))
    out = scratch.array(found.rows, np.int64)
    for i, j in scratch.blocks(found.rows):
        out[i:j] = found.read(i, j)[0]
    return out


def names(t: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Order-preserving names of the LMS substrings; separators are 0. Past its end a substring counts as higher than any symbol."""
    bits = max(9, int(t.max() + 2).bit_length())
    per, size = 63 // bits, np.append(np.diff(lms) + 1, 1)
    out, reach = (t[lms] > 0).astype(np.int64), 0
    todo = np.flatnonzero(out)
    while len(todo):  # refined by the next few symbols while any substring goes on
        key = np.zeros(len(todo), np.int64)
        for j in range(reach, reach + per):
            symbol = t[np.minimum(lms[todo] + j, len(t) - 1)].astype(np.int64)
            key = (key << bits) | np.where(j < size[todo], symbol, (1 << bits) - 1)
        distinct, at = np.unique(key, return_inverse=True)
        fine = np.full(len(lms), len(distinct))
        fine[todo] = at
        out = np.unique(out * (len(distinct) + 1) + fine, return_inverse=True)[1]
        reach += per
        todo = todo[size[todo] > reach]
    return out


def doubled(r: np.ndarray) -> np.ndarray:
    """In-memory base of the recursion: order of r's suffixes by prefix doubling; suffixes equal up to their separators stay in order of place."""
    n = len(r)
    left = np.flatnonzero(r == 0)
    left = left[np.searchsorted(left, np.arange(n))] - np.arange(n)
    rank, k = r.astype(np.int64), 1
    while k <= left.max():
        later = np.where(left >= k, rank[np.minimum(np.arange(n) + k, n - 1)], 0)
        _, rank = np.unique(rank * (rank.max() + 1) + later, return_inverse=True)
        rank[r == 0] = 0
        k *= 2
    return np.argsort(rank, kind="stable")


def common(t: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = NO) -> np.ndarray:
    """Common prefix lengths of suffixes a[i] and b[i], up to a separator, or to `most`."""
    out, live, j = np.zeros(len(a), np.int64), np.arange(len(a)), 0
    while len(live) and j < most:
        x = t[np.minimum(a[live] + j, len(t) - 1)]
        live = live[(x == t[np.minimum(b[live] + j, len(t) - 1)]) & (x > 0)]
        j += 1
        out[live] = j
    return out


def named_by_induction(t: np.ndarray, lms: np.ndarray, s_type: np.ndarray, runs: np.ndarray, symbols: np.ndarray, counts: np.ndarray, scratch: Scratch) -> np.ndarray:
    """names() beyond memory: inducing from LMS suffixes in any order sorts their substrings; equal neighbours share a name."""
    start = Queue(scratch, symbols, counts)
    for i, j in scratch.blocks(len(lms)):
        at = np.asarray(lms[i:j])
        start.push(t[at].astype(np.int64), at, np.zeros(j - i, np.int64))
    large, where = _induce(t, symbols, counts, runs, lambda k: start.drain(int(symbols[k])), s_type, False, scratch, lcp=False)
    small, there = _induce(t, symbols[:0:-1], counts[:0:-1], runs, lambda k: large.backwards(*where[len(symbols) - 1 - k]), s_type, True, scratch, lcp=False)
    out, last, name = scratch.array(len(lms), np.int64), None, 0
    size = lambda k: np.where(k + 1 < len(lms), lms[np.minimum(k + 1, len(lms) - 1)] - lms[k] + 1, 1)
    for k in range(1, len(symbols)):
        for places, _ in small.backwards(*there[len(symbols) - 1 - k]):
            at = np.searchsorted(lms, places)
            at = at[lms[np.minimum(at, len(lms) - 1)] == places]
            if not len(at):
                continue
            pair = at if last is None else np.append(last, at)
            n, end = size(pair), t[lms[np.minimum(pair + 1, len(lms) - 1)]] == 0
            same = (n[1:] == n[:-1]) & (end[1:] == end[:-1]) & (common(t, lms[pair[:-1]], lms[pair[1:]], int(n.max())) >= n[1:] - end[1:])
            fresh = ~same if last is not None else np.append(True, ~same)
            out[at] = name + np.cumsum(fresh)
            name, last = int(out[at[-1]]), at[-1]
    return out


def gathered(parts: Iterator[np.ndarray], least: int) -> Iterator[np.ndarray]:
    """The parts' items in fewer parts, of at least so many but for the last."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part)
        if n >= least:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def merged(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted lists of symbols with counts as one."""
    both, at = np.unique(np.append(a, b), return_inverse=True)
    return both, np.bincount(at, np.append(n, m), len(both)).astype(np.int64)


def suffix_order(t: np.ndarray, memory: int = 1 << 20, base: int = 1 << 22, scratch: Scratch | None = None, lcp: bool = True) -> Iterator[Block]:
    """All suffixes that don't start with a separator, in order, in blocks (places, common prefixes with the one before). t ends with 0."""
    if scratch is None:
        scratch = Scratch(memory, base)
        try:
            yield from suffix_order(t, memory, base, scratch, lcp)
        finally:
            scratch.close()
        return
    symbols, counts = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for i, j in scratch.blocks(len(t)):
        found, times = np.unique(t[i:j], return_counts=True)
        symbols, counts = merged(symbols, counts, found.astype(np.int64), times)
    if symbols[-1] == 0:
        return
    s_type, runs = types(t, scratch)
    lms = leftmost(s_type, scratch)
    order = Tape(scratch, 2)  # the LMS suffixes sorted, with common prefixes
    if len(lms) <= scratch.base:
        ranked = iter([doubled(names(t, lms))])
    else:
        r = named_by_induction(t, lms, s_type, runs, symbols, counts, scratch)
        zeros = (i + np.flatnonzero(r[i:j] == 0) for i, j in scratch.blocks(len(r)))
        ranked = (x for part in (zeros, (b[0] for b in suffix_order(r, scratch=scratch, lcp=False))) for x in part)
    last, heads, times = None, symbols, np.zeros(len(symbols), np.int64)
    for x in gathered(ranked, scratch.memory):
        for i, j in scratch.blocks(len(x)):
            places = lms[x[i:j]]
            heads, times = merged(heads, times, *np.unique(t[places].astype(np.int64), return_counts=True))
            before = np.append([places[0] if last is None else last], places[:-1]).astype(np.int64)
            order.append(places, common(t, before, places) if lcp else np.zeros(len(places)))
            last = places[-1]
    ends = np.cumsum(times)

    def seeds(k: int) -> Iterator[Block]:
        return order.forwards(int(ends[k] - times[k]), int(ends[k]))

    large, where = _induce(t, symbols, counts, runs, seeds, s_type, False, scratch, lcp)
    small, there = _induce(t, symbols[:0:-1], counts[:0:-1], runs, lambda k: large.backwards(*where[len(symbols) - 1 - k]), s_type, True, scratch, lcp)
    for k in range(1, len(symbols)):
        end = None
        for places, lcps in large.forwards(*where[k]):
            yield places, lcps
            end = places[-1]
        for places, lcps in small.backwards(*there[len(symbols) - 1 - k]):
            lcps = lcps.copy()
            if end is not None:
                lcps[0], end = min(runs[end], runs[places[0]]), None
            yield places, lcps


def _induce(t, symbols, counts, runs, seeds, s_type, small: bool, scratch: Scratch, lcp: bool) -> tuple[Tape, np.ndarray]:
    """One scan over the buckets: what was pushed into each, with lcps along the scan, and where each bucket's rows begin and end. In each bucket the pushed items come first, then its seeds (seeds: from the bucket's number in the scan)."""
    queue, out, where = Queue(scratch, symbols, counts), Tape(scratch, 2), scratch.array(2 * len(symbols), np.int64).reshape(-1, 2)
    push = Pusher(queue, int(symbols.max()) + 1) if lcp else None

    def block(places: np.ndarray, lcps: np.ndarray) -> None:
        before = places - 1
        some = np.maximum(before, 0)
        head = t[some]
        at = np.flatnonzero((before >= 0) & (s_type[some] == small) & (head > 0))
        buckets = head[at].astype(np.int64)
        if push is not None:
            push(lcps, at, buckets, before[at])
        elif len(at):
            queue.push(buckets, before[at], at)

    for k in range(len(symbols)):
        c, begun, end = int(symbols[k]), out.rows, None
        for places, lcps in queue.drain(c):
            out.append(places, lcps)
            end = places[-1]
            block(places, lcps)
        where[k] = begun, out.rows
        first = True
        for places, lcps in seeds(k):
            if first and lcp:
                lcps = np.array(lcps)
                lcps[0] = min(runs[end], runs[places[0]]) if end is not None and c else 0
            first = False
            if len(places):
                block(places, lcps)
    return out, where
