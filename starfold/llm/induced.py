"""Induced sorting of the suffixes of one block, with common prefixes carried along.

Suffixes are typed L (larger than their right neighbour) or S; an S suffix after an L suffix is an
LMS suffix. Sorted LMS suffixes induce the order of the L suffixes, those the order of the S
suffixes: whenever a suffix is read in order, the suffix one byte to its left joins the queue of its
first byte. The queues are priority queues whose priority is (first byte, time of arrival); they
hold (position, common prefix with the one before) and move to disk beyond a memory limit. The
common prefix of two queue neighbours is one more than the smallest one read between their sources.

A batch is one queue's whole content, so a step is a few array operations for thousands of tuples.
Prefixes are compared up to ``depth`` bytes; suffixes equal that far stand in any order.
"""

from __future__ import annotations

import tempfile

import numpy as np

SEPARATOR = 0xFE
QUEUE_MEMORY = 64 << 20


class Queues:
    """One first-in-first-out queue per first byte; parts go to a temporary file beyond the limit."""

    def __init__(self, memory: int):
        self.parts: list[list] = [[] for _ in range(256)]
        self.memory, self.used, self.file = memory, 0, None

    def push(self, byte: int, positions: np.ndarray, prefixes: np.ndarray) -> None:
        size = positions.nbytes + prefixes.nbytes
        if self.used + size > self.memory:
            self.file = self.file or tempfile.TemporaryFile(prefix="suffix-queue-")
            self.file.seek(0, 2)
            at = self.file.tell()
            positions.tofile(self.file)
            prefixes.tofile(self.file)
            self.file.flush()
            self.parts[byte].append((at, len(positions), positions.dtype, prefixes.dtype))
        else:
            self.used += size
            self.parts[byte].append((positions, prefixes))

    def pop(self, byte: int) -> tuple[np.ndarray, np.ndarray] | None:
        """Everything that waits in one queue, in order of arrival."""
        waiting, self.parts[byte] = self.parts[byte], []
        loaded = [self._load(p) for p in waiting]
        if not loaded:
            return None
        return np.concatenate([x[0] for x in loaded]), np.concatenate([x[1] for x in loaded])

    def _load(self, part):
        if len(part) == 2:
            self.used -= part[0].nbytes + part[1].nbytes
            return part
        at, count, *kinds = part
        self.file.seek(at)
        return tuple(np.fromfile(self.file, kind, count) for kind in kinds)

    def close(self) -> None:
        if self.file:
            self.file.close()


class Block:
    """A text of UTF-8 pieces, each followed by a separator; ends with a sentinel smaller than all bytes."""

    def __init__(self, pieces: list[bytes], depth: int, memory: int = QUEUE_MEMORY):
        # Bytes above 0xF4 do not occur in UTF-8: one more than each byte leaves 0 and 0xFE free.
        joined = np.frombuffer(b"\xfd".join(pieces) + b"\xfd", np.uint8)
        self.text = np.concatenate((joined + np.uint8(1), np.zeros(1, np.uint8)))
        self.depth, self.memory = depth, memory
        self.kind = np.uint8 if depth < 255 else np.uint32
        n = len(self.text)
        rising = self.text[:-1] < self.text[1:]
        at = np.where(self.text[:-1] != self.text[1:], np.arange(n - 1), n)
        decisive = np.minimum.accumulate(at[::-1])[::-1]
        self.is_s = np.append(rising[np.minimum(decisive, n - 2)], True)
        self.lms = np.flatnonzero(self.is_s[1:] & ~self.is_s[:-1]) + 1
        padded = np.concatenate((self.text, np.zeros(8, np.uint8)))
        self.words = np.zeros(n, np.uint64)
        for k in range(8):
            self.words = (self.words << np.uint64(8)) | padded[k : k + n]

    def repeated(self) -> np.ndarray:
        """For each position whether its first ``depth`` bytes also start elsewhere."""
        order, prefixes = self._sorted_lms()
        flags = np.zeros(len(self.text), bool)
        for run, common in self._induce(order, prefixes):
            same = np.flatnonzero(common >= self.depth)
            flags[run[same]] = True
            flags[run[same - 1]] = True
        return flags

    def _sorted_lms(self) -> tuple[np.ndarray, np.ndarray]:
        """LMS positions in order of their suffixes, and the prefix each shares with the one before."""
        lms = self.lms
        by_byte = lms[np.argsort(self.text[lms], kind="stable")]
        is_lms = np.zeros(len(self.text), bool)
        is_lms[lms] = True
        runs = [run[is_lms[run]] for run, _ in self._induce(by_byte, None)]
        ordered = np.concatenate([*runs, lms[-1:]])[::-1]
        number = np.zeros(len(self.text), np.int64)
        number[lms] = np.arange(len(lms))
        index = number[ordered]
        lengths = np.diff(lms, append=len(self.text))
        new = np.ones(len(index), bool)
        new[1:] = ~self._equal(lms[index[1:]], lms[index[:-1]], lengths[index[1:]], lengths[index[:-1]])
        rank = np.empty(len(lms), np.int64)
        rank[index] = np.cumsum(new) - 1
        levels = [rank]
        while rank.max() + 1 < len(rank) and 2 << len(levels) - 1 < self.depth:
            rank = self._doubled(rank, 1 << len(levels) - 1)
            levels.append(rank)
        index = np.argsort(rank, kind="stable")
        return lms[index], self._common(levels, index[1:], index[:-1])

    def _doubled(self, rank: np.ndarray, step: int) -> np.ndarray:
        """Ranks by twice as many names."""
        key = rank * (len(rank) + 1)
        key[:-step or None] += rank[step:] + 1
        order = np.argsort(key)
        out = np.empty_like(rank)
        out[order] = np.cumsum(np.concatenate(([0], key[order[1:]] != key[order[:-1]])))
        return out

    def _equal(self, a, b, length_a, length_b) -> np.ndarray:
        """Whether the LMS substrings at a and b, with the byte after them, are equal."""
        same = length_a == length_b
        offset = 0
        live = np.flatnonzero(same)
        while len(live):
            left = length_a[live] + 1 - offset
            unused = np.uint64(8) * (8 - np.clip(left, 1, 8)).astype(np.uint64)
            x, y = (self.words[np.minimum(p[live] + offset, len(self.text) - 1)] >> unused for p in (a, b))
            same[live[x != y]] = False
            offset += 8
            live = live[(x == y) & (left > 8)]
        return same

    def _common(self, levels, a, b) -> np.ndarray:
        """Common prefixes, up to ``depth``, of LMS suffixes number a and b; starts with a 0."""
        n, i, j = len(self.lms), a.copy(), b.copy()
        for level in range(len(levels) - 1, -1, -1):
            # one step at each level, from the longest; at the longest more steps reach beyond the depth
            inside = (i < n) & (j < n)
            same = inside & (levels[level][np.minimum(i, n - 1)] == levels[level][np.minimum(j, n - 1)])
            i, j = i + (same << level), j + (same << level)
        ends = np.append(self.lms, len(self.text))
        done = ends[np.minimum(i, n)] - self.lms[a]
        x, y = ends[np.minimum(i, n)], ends[np.minimum(j, n)]
        live = np.flatnonzero((done < self.depth) & (x < len(self.text)) & (y < len(self.text)))
        while len(live):
            difference = self.words[x[live]] ^ self.words[y[live]]
            same_bytes = np.where(difference == 0, 8, _leading_zero_bytes(difference))
            done[live] += same_bytes
            x[live] += same_bytes
            y[live] += same_bytes
            live = live[(same_bytes == 8) & (done[live] < self.depth)]
            live = live[(x[live] < len(self.text)) & (y[live] < len(self.text))]
        return np.concatenate(([0], np.minimum(done, self.depth))).astype(self.kind)

    def _pair(self, a: int, b: int) -> int:
        """The common prefix of two suffixes, by comparing bytes."""
        x, y = self.text[a : a + self.depth], self.text[b : b + self.depth]
        size = min(len(x), len(y))
        unequal = np.flatnonzero(x[:size] != y[:size])
        return int(unequal[0]) if len(unequal) else size

    def _induce(self, lms: np.ndarray, prefixes: np.ndarray | None):
        """All suffixes in order from LMS suffixes in order: runs (positions, common prefix with the one before).

        With ``prefixes`` None only the order counts. L runs come ascending, S runs descending, each
        followed by the pair at the seam between both where a byte has both.
        """
        text = self.text
        if prefixes is None:
            prefixes = np.zeros(len(lms), self.kind)
            pair = lambda a, b: 0
        else:
            pair = self._pair
        lms = lms.astype(np.int64)
        edges = np.searchsorted(text[lms], np.arange(257))
        queues, larger = Queues(self.memory), Queues(self.memory)
        reader = _Reader(self, queues, pair)
        last_l: dict[int, int] = {}
        for byte in range(256):
            rounds = []
            while (batch := queues.pop(byte)) is not None:
                reader.read(byte, *batch, own=True)
                rounds.append(batch)
            if rounds:
                run, common = (np.concatenate(x) for x in zip(*rounds))
                last_l[byte] = int(run[-1])
                larger.push(byte, run, common)
            seeds = slice(edges[byte], edges[byte + 1])
            if edges[byte] < edges[byte + 1]:
                seams = prefixes[seeds].copy()
                seams[0] = pair(last_l[byte], int(lms[seeds][0])) if byte in last_l else 0
                reader.read(byte, lms[seeds], seams, own=False)
        queues.close()
        queues = Queues(self.memory)
        reader = _Reader(self, queues, pair, falling=True)
        for byte in range(255, -1, -1):
            rounds = []
            while (batch := queues.pop(byte)) is not None:
                reader.read(byte, *batch, own=True)
                rounds.append(batch)
            smallest_s = None
            if rounds:
                run, common = (np.concatenate(x) for x in zip(*rounds))
                smallest_s = int(run[-1])
                yield run, common
            batch = larger.pop(byte)
            if batch is None:
                continue
            run, common = batch
            yield run, common
            seam = pair(int(run[-1]), smallest_s) if smallest_s is not None else 0
            if seam >= self.depth:
                yield np.array([run[-1], smallest_s]), np.array([0, seam], self.kind)
            # read downwards, each with its prefix shared with the larger neighbour
            down = np.concatenate(([seam], common[:0:-1])).astype(self.kind)
            reader.read(byte, run[::-1], down, own=False)
        queues.close()
        larger.close()


class _Reader:
    """Reads suffixes in order and queues their left neighbours."""

    def __init__(self, block: Block, queues: Queues, pair, falling: bool = False):
        self.block, self.queues, self.falling = block, queues, falling
        self.since = np.zeros(256, block.kind)  # smallest prefix read since the last push to each queue
        self.open = np.zeros(256, bool)  # queues that got a tuple before

    def read(self, byte: int, run: np.ndarray, common: np.ndarray, own: bool) -> None:
        """``own``: suffixes of the type that this pass sorts, whose neighbour may share their byte."""
        text, count = self.block.text, len(run)
        left = np.where(run > 0, text[run - 1], 0 if not self.falling else 255).astype(np.int64)
        if self.falling:
            push = np.flatnonzero((left <= byte if own else left < byte) & (run > 0))
        else:
            push = np.flatnonzero((left >= byte if own else left > byte) & (run > 0))
        overall = common.min()
        if len(push):
            order = push[np.argsort(left[push].astype(np.uint8), kind="stable")]
            target = left[order]
            first = np.concatenate(([True], target[1:] != target[:-1]))
            starts = np.concatenate(([0], order[:-1] + 1))
            starts[first] = 0
            lowest = _range_min(common, starts, order).astype(np.int64)
            heads = np.flatnonzero(first)
            bytes_in = target[heads]
            carried = np.minimum(lowest[heads], self.since[bytes_in])
            shared = np.minimum(lowest + 1, self.block.depth)
            shared[heads] = np.where(self.open[bytes_in], np.minimum(carried.astype(np.int64) + 1, self.block.depth), 0)
            tails = np.append(heads[1:], len(order))
            positions, shared = run[order] - 1, shared.astype(self.block.kind)
            for b, x, y in zip(bytes_in.tolist(), heads.tolist(), tails.tolist()):
                self.queues.push(b, positions[x:y], shared[x:y])
            self.since = np.minimum(self.since, overall)
            after = order[tails - 1] + 1
            rest = np.full(len(after), self.block.depth, np.int64)
            more = after < count
            if more.any():
                rest[more] = _range_min(common, after[more], np.full(more.sum(), count - 1))
            self.since[bytes_in] = rest.astype(self.block.kind)
            self.open[bytes_in] = True
        else:
            self.since = np.minimum(self.since, overall)


def _range_min(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of values[a..b], ends included, by tables of doubling width."""
    width = b - a + 1
    level = np.frexp(width.astype(float))[1] - 1
    out = np.empty(len(a), values.dtype)
    table, size = values, 1
    for k in range(int(level.max()) + 1):
        if k:
            table = np.minimum(table[:-size], table[size:])
            size *= 2
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[a[at]], table[b[at] - size + 1])
    return out


def _leading_zero_bytes(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x), np.int64)
    for k in range(1, 8):
        out += (x >> np.uint64(64 - 8 * k)) == 0
    return out
