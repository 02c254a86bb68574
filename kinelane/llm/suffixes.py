"""Suffix array with common-prefix values of a shard, by induced sorting over disk-backed queues.

The order of the sorted starts of descending runs (S* suffixes) is found first, over names of the pieces between them.
Every other suffix is induced from its successor: a queue per first byte receives (position, common prefix) tuples in
their final order, so that the queues together are a priority queue. A queue lives in a scratch file as soon as it is
large, and only one of them is in memory. Steps work on whole queues at a time with numpy.
"""

from __future__ import annotations

import tempfile

import numpy as np

from kinelane.llm.rolling import _BYTE, _ROOT, SEGMENT, _between, _powers, mix

#: Bytes after which a queue goes to its scratch file.
QUEUE_MEMORY = 1_000_000
#: Ends every text of a shard; no byte of UTF-8.
SEPARATOR = 0xFE
_TUPLE = np.dtype([("at", "<i4"), ("same", "<i4")])


class Queue:
    """Tuples (position, common prefix with the tuple before) in the order in which they came."""

    def __init__(self) -> None:
        self.file = tempfile.SpooledTemporaryFile(QUEUE_MEMORY)  # noqa: SIM115
        self.count = 0

    def put(self, at: np.ndarray, same: np.ndarray) -> None:
        rows = np.empty(len(at), _TUPLE)
        rows["at"], rows["same"] = at, same
        self.file.seek(0, 2)
        self.file.write(rows.tobytes())
        self.count += len(at)

    def read(self, begin: int = 0) -> tuple[np.ndarray, np.ndarray]:
        self.file.seek(begin * _TUPLE.itemsize)
        rows = np.frombuffer(self.file.read(), _TUPLE)
        return rows["at"].astype(np.int64), rows["same"].astype(np.int64)


class _Inducer:
    """Hands predecessors of scanned suffixes to queues, with the least common prefix passed on the way."""

    def __init__(self, text: np.ndarray, falling: np.ndarray, want: bool, limit: int):
        self.text, self.falling, self.want, self.limit = text, falling, want, limit
        self.queues: dict[int, Queue] = {}
        self.passed: dict[int, int] = {}  # since the last tuple for a queue, within the bucket that is scanned

    def bucket(self) -> None:
        """Another first byte begins: nothing is shared with what was scanned before."""
        self.passed = dict.fromkeys(self.queues, 0)

    def scan(self, at: np.ndarray, same: np.ndarray) -> None:
        """Suffixes in scan order; ``same`` is each one's common prefix with the one scanned before it."""
        before = np.maximum(at - 1, 0)
        taken = np.flatnonzero((at > 0) & (self.falling[before] == self.want))
        if not len(at):
            return
        least = int(same.min())
        letters = self.text[before[taken]]
        order = np.argsort(letters, kind="stable")
        cuts = np.flatnonzero(np.diff(letters[order].astype(np.int16), prepend=-1)).tolist()
        found = set()
        for a, b in zip(cuts, [*cuts, len(order)][1:], strict=True) if cuts else ():
            rows = taken[order[a:b]]
            letter = int(letters[order[a]])
            found.add(letter)
            queue = self.queues.get(letter)
            if queue is None:
                queue = self.queues[letter] = Queue()
            # Least value over (previous source, this source]; the first one counts from the start of the scan.
            edges = np.concatenate([[0], rows[:-1] + 1])
            passed = np.minimum.reduceat(same[: rows[-1] + 1], edges)
            passed[0] = min(int(passed[0]), self.passed.get(letter, 0)) if queue.count else -1
            queue.put(at[rows] - 1, np.minimum(passed + 1, self.limit))
            rest = same[rows[-1] + 1 :]
            self.passed[letter] = int(rest.min()) if len(rest) else self.limit
        for letter in self.passed.keys() - found:
            self.passed[letter] = min(self.passed[letter], least)


def _run_lengths(text: np.ndarray, at: int, limit: int) -> int:
    end = at
    while end < len(text) and text[end] == text[at] and end - at < limit:
        end += 1
    return end - at


def _types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is greater than its successor (falling); equal letters go by what follows the run."""
    n = len(text)
    change = np.ones(n, np.int8)
    change[:-1] = np.sign(text[:-1].astype(np.int16) - text[1:])
    known = np.flatnonzero(change)
    return change[known[np.searchsorted(known, np.arange(n))]] > 0


def _names(text: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Rank of the piece from each star to the next, both included; a piece that ends first is the greater one (but the last)."""
    ends = np.append(stars[1:] + 1, len(text))
    keys = np.empty(len(stars), np.uint64)
    for begin in range(0, len(stars), SEGMENT // 8):
        own = slice(begin, begin + SEGMENT // 8)
        first, last = int(stars[own][0]), int(ends[own][-1])
        prefix = np.zeros(last - first + 1, np.uint64)
        np.cumsum(_BYTE[text[first:last]] * _powers(last - first, _ROOT), out=prefix[1:])
        keys[own] = mix(_between(prefix, stars[own] - first, ends[own] - first, _ROOT) + (ends[own] - stars[own]).astype(np.uint64))
    keys[-1] ^= np.uint64(1)  # the end of the text follows the last piece, and is less than any byte
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    raw = text.tobytes()
    pieces = [raw[a:b] + b"\xff" if a != stars[-1] else raw[a:b] for a, b in zip(stars[first].tolist(), ends[first].tolist(), strict=True)]
    rank = np.empty(len(pieces), np.int32)
    rank[sorted(range(len(pieces)), key=pieces.__getitem__)] = np.arange(len(pieces))
    return rank[which]


def _star_order(text: np.ndarray, stars: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars in the order of their suffixes (as far as ``limit`` bytes tell) and common prefixes of neighbours."""
    m = len(stars)
    ranks, reach = [_names(text, stars)], 1
    while True:
        rank = ranks[-1]
        if rank.max(initial=0) == m - 1:
            break
        ahead = np.minimum(np.arange(m) + reach, m)
        if (np.append(stars, len(text))[ahead] - stars).min() >= limit:
            break
        second = np.append(rank, -1)[ahead] + 1
        pair = rank.astype(np.int64) * (m + 1) + second
        _, following = np.unique(pair, return_inverse=True)
        ranks.append(following.astype(np.int32))
        reach *= 2
        if reach > m:
            break
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    same = np.zeros(m - 1, np.int64)
    start = stars[a].copy()
    for k in range(len(ranks) - 1, -1, -1):
        inside = (a < m) & (b < m)
        equal = np.zeros(m - 1, bool)
        equal[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
        a[equal] = np.minimum(a[equal] + (1 << k), m)
        b[equal] = np.minimum(b[equal] + (1 << k), m)
    places = np.append(stars, len(text))
    same = places[a] - start
    # Within the pieces that differ, byte by byte.
    x, y = places[a].copy(), places[b].copy()
    active = np.flatnonzero(same < limit)
    while len(active):
        active = active[(x[active] < len(text)) & (y[active] < len(text))]
        active = active[text[x[active]] == text[y[active]]]
        same[active] += 1
        x[active] += 1
        y[active] += 1
        active = active[same[active] < limit]
    return stars[order], np.minimum(np.concatenate([[0], same]), limit)


def suffix_array(text: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``text`` (bytes) in the order of their suffixes, and common prefixes with the one before.

    Common prefixes are counted up to ``limit`` bytes; suffixes that agree that far may stand in either order.
    """
    n = len(text)
    if n < 2:
        return np.arange(n), np.zeros(n, np.int64)
    falling = _types(text)
    stars = np.flatnonzero(falling[:-1] & ~falling[1:]) + 1
    order, shared = _star_order(text, stars, limit) if len(stars) > 1 else (stars, np.zeros(len(stars), np.int64))
    letters = text[order]
    first = np.searchsorted(letters, np.arange(257))

    down = _Inducer(text, falling, True, limit)
    if falling[n - 1]:
        down.queues[int(text[n - 1])] = Queue()
        down.queues[int(text[n - 1])].put(np.array([n - 1]), np.array([0]))
    for letter in range(256):
        down.bucket()
        done, last = 0, -1
        while letter in down.queues and down.queues[letter].count > done:
            at, same = down.queues[letter].read(done)
            done += len(at)
            last = int(at[-1])
            down.scan(at, same)
        own = slice(first[letter], first[letter + 1])
        if own.stop > own.start:
            same = shared[own].copy()
            same[0] = 0 if last < 0 else min(_run_lengths(text, last, limit), _run_lengths(text, int(order[own][0]), limit))
            down.scan(order[own], same)

    up = _Inducer(text, falling, False, limit)
    for letter in range(255, -1, -1):
        up.bucket()
        done, last = 0, -1
        while letter in up.queues and up.queues[letter].count > done:
            at, same = up.queues[letter].read(done)
            done += len(at)
            last = int(at[-1])
            up.scan(at, same)
        if letter in down.queues:
            at, same = down.queues[letter].read()
            # Backwards: the value of a suffix is now with the one scanned before it.
            back = np.append(same[1:], 0)[::-1].copy()
            back[0] = 0 if last < 0 else min(_run_lengths(text, last, limit), _run_lengths(text, int(at[-1]), limit))
            up.scan(at[::-1], back)

    places, prefixes = [], []
    for letter in range(256):
        last = -1
        if letter in down.queues:
            at, same = down.queues[letter].read()
            places.append(at)
            prefixes.append(same)
            last = int(at[-1])
        if letter in up.queues:
            at, same = up.queues[letter].read()
            own = np.append(same[1:], 0)[::-1].copy()
            own[0] = 0 if last < 0 else min(_run_lengths(text, last, limit), _run_lengths(text, int(at[-1]), limit))
            places.append(at[::-1])
            prefixes.append(own)
    for inducer in (down, up):
        for queue in inducer.queues.values():
            queue.file.close()
    return np.concatenate(places), np.concatenate(prefixes)
