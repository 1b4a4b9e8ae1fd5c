"""Words, fingerprints, keys, and edit distance over words of lines, in numpy: what lines.py computes as column expressions is tested against it."""

from __future__ import annotations

import numpy as np
import xxhash

#: Text that is worked on at a time, in characters; a longer text is a chunk of its own.
CHUNK = 1 << 20
#: A line's fingerprint is summed in runs of at most so many words, in blocks of so many runs.
RUN, RUNS = 255, 2048
#: Lines whose keys are sorted together.
KEY_LINES = 1 << 16
#: Bits of a key's hash; seven more are its rank.
HASH_BITS = 41
_BLANK = bytes.maketrans(b"\t\x0b\x0c\r", b"    ")


def _mix(x):
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE = _mix(_mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


class Lines:
    """The lines with least words or more of some texts: arrays of a line each, and the codes of all their words.

    Lower case; words are runs of anything but ASCII white space; lid is the 128-bit hash of a line's words
    joined by single spaces; codes are 64-bit hashes of the words, and lengths their bytes.
    """

    def __init__(self, texts: list[str], least: int):
        lines_in = np.array([t.count("\n") + 1 for t in texts])
        data = "\n".join(texts).lower().encode("utf-8", "surrogatepass").translate(_BLANK)
        raw = np.frombuffer(data, np.uint8)
        blank = (raw == 32) | (raw == 10)
        edge = np.diff(np.concatenate([[True], blank, [True]]).view(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        line = np.searchsorted(np.flatnonzero(raw == 10), starts)
        enough = np.bincount(line, minlength=len(lines_in) and int(lines_in.sum())) >= least
        keep = enough[line]
        starts, ends, line = starts[keep], ends[keep], line[keep]
        self.lengths = ends - starts
        at = np.flatnonzero(enough)
        self.n = np.bincount(np.searchsorted(at, line), minlength=len(at)).astype(np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.text = np.repeat(np.arange(len(texts)), lines_in)[at]
        self.pos = (at - np.repeat(np.cumsum(lines_in) - lines_in, lines_in)[at]).astype(np.int32)
        self.codes = self._codes(raw, starts)
        self.lid = []
        if len(at):
            begin, end = starts[self.first].tolist(), ends[self.first + self.n - 1].tolist()
            plain = np.add.reduceat(self.lengths, self.first) + self.n - 1
            for s, e, k in zip(begin, end, plain.tolist()):
                x = data[s:e]
                self.lid.append(xxhash.xxh3_128_digest(x if e - s == k else b" ".join(x.split())))

    def _codes(self, raw, starts):
        if not len(starts):
            return np.zeros(0, np.uint64)
        begin = np.cumsum(self.lengths) - self.lengths
        inside = np.arange(int(self.lengths.sum())) - np.repeat(begin, self.lengths)
        power = np.cumprod(np.full(int(self.lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
        sums = np.add.reduceat(_BYTE[raw[np.repeat(starts, self.lengths) + inside]] * power[inside], begin)
        return _mix(sums ^ (self.lengths.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))

    def words(self, k: int):
        """The codes of line k's words."""
        return self.codes[self.first[k] : self.first[k] + self.n[k]]

    def simhash(self):
        """A fingerprint bit is 1 if it is set in over half the codes of the line's words."""
        out = np.zeros(len(self.n), np.uint64)
        if not len(out):
            return out
        runs = -(-self.n // RUN)
        owner = np.repeat(np.arange(len(out)), runs)
        begin = self.first[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs)) * RUN
        votes = np.zeros((len(out), 64), np.int64)
        for i in range(0, len(begin), RUNS):
            s = begin[i : i + RUNS]
            e = begin[i + RUNS] if i + RUNS < len(begin) else len(self.codes)
            bits = np.unpackbits(self.codes[s[0] : e].view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
            sums = np.add.reduceat(bits, s - s[0], axis=0).view(np.uint8)  # eight counts in each number
            own = owner[i : i + RUNS]
            new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            votes[own[new]] += np.add.reduceat(sums, new, axis=0, dtype=np.int64)
        return np.packbits(2 * votes > self.n[:, None], axis=1).view(np.uint64).ravel()

    def keys(self, most: int, frequent):
        """(line, key): the first distinct pairs of neighbouring words of each line, at most most of them.

        In one order of all pairs: not frequent before frequent, longer before shorter, then by hash.
        """
        if len(self.codes) < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = self.codes[:-1], self.codes[1:]
        size = np.minimum(self.lengths, 31)
        rank = (62 - size[:-1] - size[1:]).astype(np.uint64)
        key = (rank << np.uint64(HASH_BITS)) | (_mix(a * np.uint64(3) + _mix(b)) >> np.uint64(64 - HASH_BITS))
        owner = np.repeat(np.arange(len(self.n)), self.n)
        same = owner[1:] == owner[:-1]
        key, owner = key[same], owner[1:][same]
        if len(frequent):
            key[np.isin(key, frequent)] += np.uint64(64 << HASH_BITS)
        lines, keys = [], []
        for i in range(0, len(self.n), KEY_LINES):
            s, e = np.searchsorted(owner, [i, i + KEY_LINES])
            both = np.unique(((owner[s:e] - i).astype(np.uint64) << np.uint64(48)) | key[s:e])
            o, k = (both >> np.uint64(48)).astype(np.int64) + i, both & np.uint64((1 << 48) - 1)
            begin = np.flatnonzero(np.r_[len(o) > 0, o[1:] != o[:-1]])
            place = np.arange(len(o)) - np.repeat(begin, np.diff(np.r_[begin, len(o)]))
            lines.append(o[place < most])
            keys.append(k[place < most].astype(np.int64))
        return np.concatenate(lines), np.concatenate(keys)


def chunks(texts: list[str]):
    """(start, stop) of runs of texts with about CHUNK characters."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def spare(n, similarity: float):
    """The most edits between a line of n words and one that is not longer."""
    return np.floor((1 - similarity) * n + 1e-9).astype(np.int64)


def close_pairs(group, n, prints, similarity: float, radius: int):
    """(i, j) for rows of one group (rows are in its order) whose fingerprints and lengths allow a link, in blocks.

    Fingerprints may differ in radius bits, and more for short lines, where each word weighs more: 80 / words.
    """
    at, step = np.arange(len(group)), 0
    most = spare(n, similarity)
    while True:
        step += 1
        at = at[at + step < len(group)]
        at = at[group[at] == group[at + step]]
        if not len(at):
            return
        b = at + step
        ok = (np.abs(n[at] - n[b]) <= np.maximum(most[at], most[b])) & (np.bitwise_count(prints[at] ^ prints[b]) <= radius + 80 // np.maximum(n[at], n[b]))
        if ok.any():
            yield at[ok], b[ok]


def parities(codes: list):
    """For each line, 256 bits: how often, modulo two, words of each of 256 classes occur. An edit changes two at most."""
    out = np.zeros((len(codes), 256), np.uint8)
    owner = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    if len(owner):
        np.bitwise_xor.at(out, (owner, (np.concatenate(codes) & np.uint32(255)).astype(np.int64)), 1)
    return np.packbits(out, axis=1).view(np.uint64)


def edit_distance(a: list, b: list) -> int:
    """Levenshtein distance of two lists, a bit of a whole number for each item (Hyyro's bit-parallel form)."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi and a[lo] == b[lo]:
        lo += 1
    a, b, hi = a[lo:], b[lo:], hi - lo
    while hi and a[-1] == b[-1]:
        a.pop()
        b.pop()
        hi -= 1
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    for x in b:
        eq = places.get(x, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        rise, fall = down | ~(diagonal | up) & full, up & diagonal
        score += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | 1) & full, fall << 1 & full
        up, down = fall | ~(diagonal | rise) & full, rise & diagonal
    return score


def verified_links(group, n, prints, codes: list, label, similarity: float, radius: int):
    """(i, j) of pairs of rows in one group that are within similarity and tie together what is not tied yet.

    label numbers what is tied from the start (a line's rows in several groups have one). Pairs are judged closest
    first; a pair whose ends are tied by earlier links is not judged. A bound by word classes goes first, then
    equal places; what is left open is decided by edit distance.
    """
    parent = {}

    def root(x):
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = parent[x]
        return x

    odd, most, out = parities(codes), spare(n, similarity), []
    blocks = list(close_pairs(group, n, prints, similarity, radius))
    if not blocks:
        return out
    a, b = np.concatenate([x for x, _ in blocks]), np.concatenate([x for _, x in blocks])
    a, b = (x[label[a] != label[b]] for x in (a, b))
    allowed = np.maximum(most[a], most[b])
    ok = np.bitwise_count(odd[a] ^ odd[b]).sum(1) <= 2 * allowed - np.abs(n[a] - n[b])
    a, b, allowed = a[ok], b[ok], allowed[ok]
    order = np.argsort(np.bitwise_count(prints[a] ^ prints[b]), kind="stable")
    for i, j, k in zip(a[order].tolist(), b[order].tolist(), allowed[order].tolist()):
        x, y = root(label[i]), root(label[j])
        if x == y:
            continue
        s, t = codes[i], codes[j]
        if (len(s) == len(t) and np.count_nonzero(s != t) <= k) or edit_distance(s.tolist(), t.tolist()) <= k:
            parent[max(x, y)] = min(x, y)
            out.append((i, j))
    return out
