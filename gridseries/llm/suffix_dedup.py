"""Exact substring dedup: bytes covered by a ``LENGTH``-byte string that also starts in a document of smaller id go.

Method: column-wise multi-document construction.  The Burrows-Wheeler transform
of a collection of strings and the common prefixes of neighbouring suffixes are
built from the right: each round puts one more symbol of every string in place
(the suffixes longer by one), reading the transform and the prefixes of the round
before from two sequential files and writing the next ones.  Runs of neighbours
with LENGTH common bytes are the equal substrings; each window's place is read
off the finished transform, and the smallest document of a run decides.

Spark side: a whole corpus has no single transform (it would need as many rounds
as the longest document has bytes), so documents become short strings that are
dealt out by content.  Neighbouring windows whose smallest 24-gram hash is the
same form one string (up to 27 windows); equal substrings have equal hashes, so
the strings of one hash range are a collection complete in itself.  Documents
are grouped by id into groups of about ``GROUP_BYTES``, on large tables of up to
twice as many: each group sends a row to each range.

1. each group sends its distinct hashes (``KEY`` bytes of each), with the number of
   strings where a hash has more than one; ranges answer by a bit which ones other
   groups have too (a hash of one document only cannot repeat) and which ones are hot;
2. each group sends the distinct strings of shared hashes with their smallest
   document; ranges build transforms, in collections of about ``COLLECTION``
   bytes, and answer which windows start in a smaller document;
3. each group marks and cuts its documents.

The three steps read the same shuffle of the documents.  A passage that many
documents share is one string per group where its surroundings are equal too; at
its edges every document has a string of its own.  A hash with more strings than
``HOT`` collections hold is hot: its strings are sent window by window, each window
under a hash that its own bytes decide among as many parts as are needed, so the
strings of a hot hash spread over ranges and tasks, and equal windows still meet
in one transform.  Left out before the construction, all exactly: hashes of one
document (step 1), strings that are alone under their hash, which all their
holders have as a whole, and strings that differ from all others of their hash so
near to the gram that no window can be the same (``_may_share``).  A collection is
in memory while it is built (about 20 bytes a symbol: its bound keeps it small); the
two sequences of a round lie in files without a name where Spark spills its own
sorts, read by nobody else; a lost executor's tasks start over.

The steps look values up in sorted order, all rows of a task together; work is in
proportion to the text.  Only the number of rows grows as groups times ranges.

Defined cases: a null text is the empty text; texts shorter than LENGTH stay
whole; rows without an id neither lose bytes nor cost others any; rows with the
same id never cost each other bytes, so repeated rows stay equal; other columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridseries.llm.common import doc_view, ragged, scratch_file

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1
#: A window begins 0 to SPAN - 1 bytes before its gram; by this distance, the bytes that it has for certain before and behind the gram.
AROUND = [(SPAN * i // 4, SPAN - SPAN * (i + 1) // 4) for i in range(4)]
GROUP_BYTES, RANGE_BYTES, COLLECTION = 2 << 20, 32 << 20, 1 << 20
_MIX = np.uint64(0xD6E8FEB86659FD93)
_ODD = 0x9E3779B97F4A7C15
GROUPS = 1000  # beyond so many groups they grow, up to twice GROUP_BYTES
BLOCK = 1 << 15  # windows whose hashes are worked out together
FEW = 256  # strings of one hash in one group, up to which copies are not told apart when strings are counted
HOT = 4  # a hash is hot when its strings fill more collections; up to then they are one collection
KEY = 5  # bytes of a hash within its range; two hashes that agree in them only send strings in vain
_HOT = np.dtype([("hash", np.uint64), ("parts", np.int64)])


class Group:
    """The windows of a group of documents as strings of one hash each."""

    def __init__(self, ids: list, texts: list):
        raw = [(t or "").encode("utf-8", "replace") for t in texts]
        self.raw, self.ids = raw, ids
        self.plain_ids = np.array([-1 if i is None else i for i in ids], np.int64)
        self.size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.begin = np.cumsum(self.size) - self.size
        self._ordered = None
        self._runs()

    def _runs(self) -> None:
        """start, windows, hash and document of each string; a document without an id has none."""
        n = len(self.data)
        ends = self.begin + self.size
        with_id = np.array([i is not None for i in self.ids], bool)
        if n < LENGTH:
            self.start = self.count = self.doc = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        ok = np.zeros(n + 1, np.int8)  # windows that lie in one document with an id
        whole = np.flatnonzero((self.size >= LENGTH) & with_id)
        ok[self.begin[whole]] = 1
        ok[ends[whole] - LENGTH + 1] = -1  # a document of LENGTH bytes or more: no place is the next one's begin
        ok = np.cumsum(ok[: n - LENGTH + 1], dtype=np.int8).view(bool)
        new = np.zeros(len(ok), bool)
        new[0], new[1:] = True, ~ok[:-1]
        new[self.begin[self.begin < len(ok)]] = True
        hashes, last = [], np.zeros(1, np.uint64)
        for a, h in _window_hashes(self.data):
            here = new[a : a + len(h)]
            here |= np.concatenate([last, h[:-1]]) != h
            last = h[-1:]
            hashes.append(h[here & ok[a : a + len(h)]])
        start = np.flatnonzero(new & ok)
        stop = np.flatnonzero(np.concatenate([(new | ~ok)[1:] & ok[:-1], [ok[-1]]])) + 1
        pieces = -(-(stop - start) // SPAN)
        first = np.cumsum(pieces) - pieces
        nth = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
        self.start = np.repeat(start, pieces) + nth * SPAN
        self.count = np.minimum(SPAN, np.repeat(stop, pieces) - self.start)
        self.hash = np.repeat(_spaced(np.concatenate(hashes)), pieces)
        self.doc = np.searchsorted(self.begin, self.start, side="right") - 1
        self.doc = _last_of_equal(self.begin, self.size, self.start, self.doc)

    def by_hash(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The strings ordered by hash, the distinct hashes, and where each begins in that order."""
        if self._ordered is None:
            order = np.argsort(self.hash)
            h = self.hash[order]
            begin = _first_of_each(h)
            self._ordered = order, h[begin], begin
        return self._ordered

    def shared_here(self, ordered) -> np.ndarray:
        """Hashes that two documents of different ids in this group have."""
        order, found, begin = ordered
        if not len(found):
            return found
        ids = self.id_of[order]
        return found[np.minimum.reduceat(ids, begin) != np.maximum.reduceat(ids, begin)]

    def strings_of(self, ordered, few: int) -> np.ndarray:
        """About how many different strings each hash has: never fewer than there are; above ``few`` equal ones count
        once (told apart by the sum of their 24-gram hashes)."""
        order, found, begin = ordered
        runs = np.diff(np.append(begin, len(order)))
        many = np.flatnonzero(runs > few)
        for i in many.tolist():
            mine = order[begin[i] : begin[i] + runs[i]]
            size = self.count[mine] + LENGTH - 1
            found = []
            for a, b in _blocks(size):
                sums = np.cumsum(_gram_hashes(ragged(self.data, self.start[mine[a:b]], size[a:b]), GRAM))
                end = np.cumsum(size[a:b])
                found.append(sums[end - GRAM] - np.append(np.uint64(0), sums)[end - size[a:b]])
            runs[i] = len(np.unique(np.concatenate(found)))
        return runs

    def spread(self, hot: np.ndarray) -> np.ndarray:
        """Strings of hot hashes become their windows, each under a hash that its bytes decide; returns these hashes."""
        if not len(hot) or not len(self.hash):
            return np.zeros(0, np.uint64)
        hot = np.unique(hot)
        at = np.minimum(np.searchsorted(hot["hash"], self.hash), len(hot) - 1)
        mine = hot["hash"][at] == self.hash
        n = self.count[mine]
        start = np.repeat(self.start[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        window = np.zeros(len(start), np.uint64)
        for i in range(LENGTH):
            window = window * np.uint64(_ODD) + self.data[start + i] + np.uint64(1)
        window = (window ^ (window >> np.uint64(32))) * _MIX
        part = (window >> np.uint64(20)) % np.repeat(hot["parts"][at[mine]].astype(np.uint64), n)
        hashes = np.repeat(self.hash[mine], n) + (part + np.uint64(1)) * np.uint64(_ODD)
        hashes = (hashes ^ (hashes >> np.uint64(31))) * _MIX
        hashes ^= hashes >> np.uint64(30)
        doc = np.repeat(self.doc[mine], n)
        self.start, self.count = np.append(self.start[~mine], start), np.append(self.count[~mine], np.ones(len(start), np.int64))
        self.hash, self.doc = np.append(self.hash[~mine], hashes), np.append(self.doc[~mine], doc)
        self._ordered = None
        return np.unique(hashes)

    @property
    def id_of(self) -> np.ndarray:
        return self.plain_ids[self.doc]

    def items(self, hashes: np.ndarray):
        """The distinct strings of these hashes, by hash and content: hash, windows, bytes, smallest id; and for each
        of the group's strings with such a hash (``own``) the item it is."""
        order, found, begin = self.by_hash()
        mine = np.zeros(len(order), bool)
        mine[order] = np.repeat(_among(found, hashes), np.diff(np.append(begin, len(order))))
        own = np.flatnonzero(mine)
        size = self.count[own] + LENGTH - 1
        item, strings = _distinct(_pieces(self.data, self.start[own], size), size)
        hash_of = np.zeros(len(strings), np.uint64)
        hash_of[item] = self.hash[own]
        order = np.argsort(hash_of, kind="stable")
        # the few strings that share a hash: by content, so that the order is the same whenever the group is read
        tied = _of_several(hash_of[order])
        texts = strings.take(pa.array(order[tied])).to_pylist()
        order[tied] = [i for *_, i in sorted(zip(hash_of[order[tied]].tolist(), texts, order[tied].tolist()))]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        item, strings = back[item], strings.take(pa.array(order))
        least = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(least, item, self.id_of[own])
        return hash_of[order], np.diff(_offsets(strings)) - LENGTH + 1, strings, least, own, item


def _distinct(flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """The different strings among pieces of ``flat`` of the given sizes, and which of them each piece is."""
    ends = np.append(np.int64(0), np.cumsum(size, dtype=np.int64))
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(flat))])
    coded = pieces.dictionary_encode()
    return np.asarray(coded.indices, dtype=np.int64), coded.dictionary


def _offsets(strings: pa.LargeBinaryArray) -> np.ndarray:
    if not len(strings):
        return np.zeros(1, np.int64)
    return np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]


def _bytes(strings: pa.LargeBinaryArray, a: int, b: int) -> bytes:
    """Strings a to b, one after the other."""
    ends = _offsets(strings)
    return strings.buffers()[2][int(ends[a]) : int(ends[b])].to_pybytes() if b > a else b""


def _first_of_each(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(ordered) else np.zeros(0, np.int64)


def _sorted_set(*parts: np.ndarray) -> np.ndarray:
    every = np.concatenate([np.zeros(0, np.uint64), *parts])
    every.sort()
    return every[_first_of_each(every)]


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Whether each of the values is among ``some``, which rise; the values rise too, so that they are looked up side by side."""
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _blocks(lens: np.ndarray, most: int = 1 << 18):
    """a, b: pieces a to b have about ``most`` elements together, or are one piece."""
    total = np.cumsum(lens, dtype=np.int64)
    a = 0
    while a < len(lens):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def _pieces(src: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """``ragged``, block by block: its places take eight bytes an element, and fit the cache."""
    out, at = np.empty(int(lens.sum()), src.dtype), 0
    for a, b in _blocks(lens):
        got = ragged(src, starts[a:b], lens[a:b])
        out[at : at + len(got)] = got
        at += len(got)
    return out


def _of_several(hashes: np.ndarray) -> np.ndarray:
    """Places of sorted hashes that occur more than once."""
    same = hashes[1:] == hashes[:-1]
    return np.flatnonzero(np.append(same, False) | np.append(False, same)) if len(hashes) else np.zeros(0, np.int64)


def _window_hashes(data: np.ndarray):
    """The smallest (mixed) gram hash of every window of LENGTH bytes, block by block with the block's begin: the steps stay
    in the cache, and a group's hashes, eight times its bytes, are never held."""
    for a in range(0, len(data) - LENGTH + 1, BLOCK):
        h = _mixed_grams(data[a : a + BLOCK + LENGTH - 1])
        step = 1
        while 2 * step <= SPAN:
            h = np.minimum(h[:-step], h[step:])
            step *= 2
        if SPAN > step:
            h = np.minimum(h[: len(h) - (SPAN - step)], h[SPAN - step :])
        yield a, h


def _mixed_grams(data: np.ndarray) -> np.ndarray:
    h = _gram_hashes(data, GRAM)
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _spaced(h: np.ndarray) -> np.ndarray:
    """A smallest hash is small: mixed once more, so that ranges of hashes are even."""
    h = (h ^ (h >> np.uint64(31))) * _MIX
    h ^= h >> np.uint64(30)
    return h


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every run of ``gram`` bytes, put together from runs of 1, 2, 4, ... bytes."""
    part = (data.astype(np.uint64) + np.uint64(1)) * _MIX
    out, size, step = None, 0, 1
    while True:
        if gram & step:
            n = len(data) - size - step + 1
            out = part[:n] if out is None else out[:n] * np.uint64(pow(_ODD, step, 1 << 64)) + part[size : size + n]
            size += step
        if 2 * step > gram:
            return out.copy()
        part = part[:-step] * np.uint64(pow(_ODD, step, 1 << 64)) + part[step:]
        step *= 2


def _last_of_equal(begin, size, start, doc):
    """The document that holds the byte: empty documents begin where the next one does."""
    return np.where(size[doc] > 0, doc, np.searchsorted(begin + size, start, side="right")) if len(doc) else doc


def _ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash range of each hash, 0 to n - 1, rising with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _keys(hashes: np.ndarray, n: int) -> bytes:
    """``KEY`` bytes of each hash of one range, by which its hashes are told apart: the range's number says what the bits before them are."""
    key = (hashes << np.uint64(n.bit_length() - 1)) >> np.uint64(64 - 8 * KEY)
    return np.ascontiguousarray(key.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY]).tobytes()


def _keys_read(blob: bytes) -> np.ndarray:
    key = np.zeros((len(blob) // KEY, 8), np.uint8)
    key[:, :KEY] = np.frombuffer(blob, np.uint8).reshape(-1, KEY)
    return key.view("<u8").ravel().astype(np.uint64, copy=False)


def _groups(total: int) -> int:
    """Groups for so many bytes of text; a group sends a row to every range, so they are larger where there are many."""
    return max(1, total // min(max(GROUP_BYTES, total // GROUPS), 2 * GROUP_BYTES))


def _cuts(part: np.ndarray) -> list[tuple[int, int]]:
    if not len(part):
        return []
    at = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    return list(zip(at, at[1:]))


def build(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Transform (symbols are bytes + 1, 0 begins a string), common prefix with the suffix before, and each string's
    place, of all suffixes of the strings.  UTF-8 has no byte above 0xF4, so a symbol fits a byte."""
    m = len(strings)
    length = np.fromiter(map(len, strings), np.int64, m)
    data = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint8) + np.uint8(1)
    last = np.cumsum(length) - 1
    place = np.arange(m)
    most = int(length.sum()) + m
    front, old, who = np.zeros(most, bool), np.ones(most, bool), np.empty(most, np.int32)
    with scratch_file() as bwt_file, scratch_file() as lcp_file:
        data[last].tofile(bwt_file)
        np.zeros(m, np.uint8).tofile(lcp_file)
        n = m
        for j in range(1, int(length.max()) + 1):
            bwt, lcp = _read(bwt_file, n), _read(lcp_file, n)
            active = np.flatnonzero(length >= j)
            at = place[active]
            front[at] = True
            who[at] = active
            order = np.argsort(bwt, kind="stable")
            zeros = m - len(active)  # strings that are whole
            rank = np.flatnonzero(front[order])  # of the symbols now put in front, by (symbol, place)
            # common prefixes change for the new suffixes and for those right behind them
            behind = rank + 1
            behind = behind[behind < n]
            touched = np.concatenate([rank, behind[~front[order[behind]]]])
            prev = touched - 1
            same = (prev >= zeros) & (bwt[order[prev]] == bwt[order[touched]])
            value = np.zeros(len(touched), np.uint8)
            if same.any():
                pairs = np.stack([order[prev[same]] + 1, order[touched[same]] + 1], axis=1).ravel()
                value[same] = np.minimum.reduceat(np.append(lcp, np.uint8(0)), pairs)[::2] + np.uint8(1)
            string = who[order[rank]]
            front[at] = False
            new = m + rank - zeros
            old[new] = False
            n += len(rank)
            if zeros:  # whole strings already in place move back
                done = np.flatnonzero(length < j)
                place[done] = np.flatnonzero(old[:n])[place[done]]
            place[string] = new
            symbol = np.where(length[string] > j, data[np.maximum(last[string] - j, 0)], np.uint8(0)).astype(np.uint8)
            for file, before, put, where in ((bwt_file, bwt, symbol, new), (lcp_file, lcp, value, m + touched - zeros)):
                after = np.empty(n, np.uint8)
                after[old[:n]] = before
                after[where] = put
                file.seek(0)
                after.tofile(file)
            old[new] = True
        return _read(bwt_file, n), _read(lcp_file, n), place


def _read(file, n: int) -> np.ndarray:
    file.seek(0)
    return np.fromfile(file, np.uint8, n)


def first_documents(strings: list[bytes], least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every string, in order, the smallest document of all strings that hold it; windows per string."""
    bwt, lcp, place = build(strings)
    tail = np.argsort(bwt, kind="stable")  # where the suffix without its first symbol is
    run = np.cumsum(lcp < LENGTH)
    count = np.fromiter(map(len, strings), np.int64, len(strings)) - LENGTH + 1
    ends = np.cumsum(count)
    found = np.empty(int(ends[-1]), np.int64)
    at, who = place.copy(), np.arange(len(strings))
    for t in range(int(count.max())):
        going = count[who] > t
        at, who = at[going], who[going]
        found[ends[who] - count[who] + t] = run[at]
        at = tail[at]
    smallest = np.full(int(run[-1]) + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, found, np.repeat(least, count))
    return smallest[found], count


def _collections(hashes: np.ndarray, strings: list[bytes], most: int):
    """Positions of the strings of one collection after the other: whole hashes, about ``most`` bytes."""
    total = np.concatenate([[0], np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))])
    lo = 0
    while lo < len(strings):
        hi = int(np.searchsorted(total, total[lo] + most, side="right")) - 1
        if hi < len(strings):
            hi = int(np.searchsorted(hashes, hashes[max(hi, lo)], side="left"))
            if hi <= lo:  # one hash has more
                hi = int(np.searchsorted(hashes, hashes[lo], side="right"))
        yield lo, hi
        lo = hi


def _may_share(hashes: np.ndarray, strings: pa.LargeBinaryArray) -> np.ndarray:
    """Which of these strings may share a window with another one of them; never false for one that does.

    A window that two strings share holds the gram whose hash is theirs, with the
    bytes of one entry of ``AROUND`` before and behind it: both strings have these
    bytes around the gram.  Every place of the gram counts; a string without it
    (a window of a hot hash) is kept.
    """
    ends = _offsets(strings)
    keep, keys, whose = np.ones(len(strings), bool), [], []
    for lo, hi in _blocks(np.diff(ends)):
        data = np.frombuffer(_bytes(strings, lo, hi), np.uint8)
        size = np.diff(ends[lo : hi + 1])
        begin = np.cumsum(size) - size
        at = np.flatnonzero(_spaced(_mixed_grams(data)) == np.repeat(hashes[lo:hi], size)[: len(data) - GRAM + 1])
        mine = np.searchsorted(begin, at, side="right") - 1
        inside = at + GRAM <= (begin + size)[mine]
        at, mine = at[inside], mine[inside]
        keep[lo + mine] = False
        for before, behind in AROUND:
            room = (at - begin[mine] >= before) & (at + GRAM + behind <= (begin + size)[mine])
            first = at[room] - before
            key = np.full(len(first), before, np.uint64)
            for i in range(before + GRAM + behind):
                key = key * np.uint64(_ODD) + data[first + i] + np.uint64(1)
            keys.append((key ^ (key >> np.uint64(32))) * _MIX)
            whose.append(lo + mine[room])
    if keys:
        key, whose = np.concatenate(keys), np.concatenate(whose)
        order = np.argsort(key)
        key, whose = key[order], whose[order]
        begin = _first_of_each(key)
        if len(begin):
            several = np.minimum.reduceat(whose, begin) != np.maximum.reduceat(whose, begin)
            keep[whose[np.repeat(several, np.diff(np.append(begin, len(key))))]] = True
    return keep


def _firsts(hashes: np.ndarray, strings: pa.LargeBinaryArray, least: np.ndarray, most: int):
    """first_documents over collections of bounded size, and the windows of each string; strings sorted by hash.

    A window occurs under its own hash only, so a string alone under its hash
    shares no window with another one: its windows start in its smallest holder,
    and it stays out of the construction.  So does one that differs from all
    others of its hash too close to the gram (``_may_share``).
    """
    count = np.diff(_offsets(strings)) - LENGTH + 1
    first, begin = np.repeat(least, count), np.cumsum(count) - count
    built = _of_several(hashes)
    built = built[_may_share(hashes[built], strings.take(pa.array(built)))]
    met = strings.take(pa.array(built)).to_pylist()
    for lo, hi in _collections(hashes[built], met, most):
        mine = built[lo:hi]
        found, n = first_documents(met[lo:hi], least[mine])
        first[np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(len(found))] = found
    return first, count


def _blob(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _batch(rows: list[tuple], names: str, types: list) -> pa.Table:
    columns = list(zip(*rows)) if rows else [[] for _ in types]
    return pa.table([pa.array(list(c), t) for c, t in zip(columns, types)], names=names.split())


def _sorted(table: pa.Table, column: str) -> list[dict]:
    return table.sort_by(column).to_pylist()


def _open(table: pa.Table) -> Group:
    return Group(table.column("doc_id").to_pylist(), table.column("text").to_pylist())


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (binary): what is left of every document."""
    view = doc_view(docs, id_col, text_col)
    total = view.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    groups = _groups(total)
    ranges = max(1, total // RANGE_BYTES)
    builds = max(1, 4 * total // RANGE_BYTES)
    collection = COLLECTION
    hot_strings = max(1, HOT * collection // (LENGTH + SPAN - 1))  # window by window they would take many times as many bytes

    grouped = view.withColumn("g", F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(groups)))

    def parts_of(strings: np.ndarray) -> np.ndarray:
        """Among how many parts the windows of hashes with so many strings are spread; 0: not hot."""
        return np.where(strings > hot_strings, strings * (SPAN * LENGTH) // collection + 1, 0)

    def hot_of(hashes: np.ndarray, strings: np.ndarray) -> np.ndarray:
        parts = parts_of(strings)
        hot = np.empty(int((parts > 0).sum()), _HOT)
        hot["hash"], hot["parts"] = hashes[parts > 0], parts[parts > 0]
        return hot

    def ask(t: pa.Table) -> pa.Table:
        group = _open(t)
        ordered = group.by_hash()
        hashes, strings = ordered[1], group.strings_of(ordered, FEW)
        part, g = _ranges(hashes, ranges), t.column("g")[0].as_py()
        out = []
        for a, b in _cuts(part):
            several = np.flatnonzero(strings[a:b] > 1)
            out.append((int(part[a]), g, _keys(hashes[a:b], ranges), _blob(several.astype(np.uint32)), _blob(strings[a:b][several].astype(np.uint32))))
        return _batch(out, "part g keys several strings", [pa.int64(), pa.int64(), *[pa.binary()] * 3])

    def answer(t: pa.Table) -> pa.Table:
        """For each row a bit for each of its hashes: another group has it too; and the hot ones by their place in the row."""
        rows = t.to_pylist()
        every = np.concatenate([_keys_read(r["keys"]) for r in rows])
        ends = np.cumsum([len(r["keys"]) // KEY for r in rows])
        n = np.ones(len(every), np.int64)
        for r, end in zip(rows, ends.tolist()):
            n[np.frombuffer(r["several"], np.uint32) + np.int64(end - len(r["keys"]) // KEY)] = np.frombuffer(r["strings"], np.uint32)
        order = np.argsort(every)
        begin = _first_of_each(every[order])
        runs = np.diff(np.append(begin, len(order)))
        strings = np.add.reduceat(n[order], begin) if len(begin) else n
        shared = np.empty(len(every), bool)
        shared[order] = np.repeat(runs > 1, runs)
        hot = np.zeros(len(every), np.int64)
        hot[order] = np.repeat(parts_of(strings) * (runs > 1), runs)
        out = []
        for r, end in zip(rows, ends.tolist()):
            a = end - len(r["keys"]) // KEY
            if shared[a:end].any():
                at = np.flatnonzero(hot[a:end])
                out.append((r["g"], r["part"], np.packbits(shared[a:end]).tobytes(), _blob(at.astype(np.uint32)), _blob(hot[a:end][at])))
        return _batch(out, "g part shared hot parts", [pa.int64(), pa.int64(), *[pa.binary()] * 3])

    def told_of(hashes: np.ndarray, told: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """What the ranges told a group with these distinct hashes: the shared ones, and the hot ones with their parts."""
        part = _ranges(hashes, ranges)
        shared, hot = np.zeros(len(hashes), bool), [np.zeros(0, _HOT)]
        for r in told.to_pylist():
            a, b = np.searchsorted(part, [r["part"], r["part"] + 1]).tolist()
            shared[a:b] = np.unpackbits(np.frombuffer(r["shared"], np.uint8), count=b - a)
            if r["hot"]:
                at = np.frombuffer(r["hot"], np.uint32)
                hot.append(np.empty(len(at), _HOT))
                hot[-1]["hash"], hot[-1]["parts"] = hashes[a:b][at], np.frombuffer(r["parts"], np.int64)
        return hashes[shared], np.concatenate(hot)

    def sent(group: Group, told: np.ndarray, hot: np.ndarray):
        """The group's items, after its hot strings have become windows: what ``offer`` sends and ``cut`` marks."""
        ordered = group.by_hash()
        here = group.shared_here(ordered)
        own = hot_of(ordered[1], group.strings_of(ordered, hot_strings))
        own = own[np.isin(own["hash"], here)]
        known = np.concatenate([hot, own[~np.isin(own["hash"], hot["hash"])]])
        windows = group.spread(known)
        return known, group.items(_sorted_set(here, windows, told))

    def offer(t: pa.Table, told: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _batch([], "part g hashes counts text least hot", [pa.int64(), pa.int64(), *[pa.binary()] * 5])
        group = _open(t)
        hot, (hashes, counts, strings, least, _, _) = sent(group, *told_of(group.by_hash()[1], told))
        part, g = _ranges(hashes, builds), t.column("g")[0].as_py()
        pack = zstandard.ZstdCompressor(level=1)
        # the hot hashes travel once, with the first row, and come back to the group
        return _batch([(int(part[a]), g, _blob(hashes[a:b]), _blob(counts[a:b].astype(np.uint8)),
                        pack.compress(_bytes(strings, a, b)), _blob(least[a:b]), b"" if a else _blob(hot)) for a, b in _cuts(part)],
                      "part g hashes counts text least hot", [pa.int64(), pa.int64(), *[pa.binary()] * 5])

    def judge(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        unpack = zstandard.ZstdDecompressor()
        texts = b"".join(unpack.decompress(r["text"]) for r in rows)
        size = np.concatenate([np.frombuffer(r["counts"], np.uint8) for r in rows]).astype(np.int64) + LENGTH - 1
        hashes = np.concatenate([np.frombuffer(r["hashes"], np.uint64) for r in rows])
        item, strings = _distinct(np.frombuffer(texts, np.uint8), size)
        hash_of = np.zeros(len(strings), np.uint64)
        hash_of[item] = hashes
        order = np.argsort(hash_of, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        item, strings, hash_of = back[item], strings.take(pa.array(order)), hash_of[order]
        asked = np.concatenate([np.frombuffer(r["least"], np.int64) for r in rows])
        least = np.full(len(strings), np.iinfo(np.int64).max)
        np.minimum.at(least, item, asked)
        first, count = _firsts(hash_of, strings, least, collection)
        n, begin = count[item], (np.cumsum(count) - count)[item]
        flags, cut = np.empty(int(n.sum()), bool), np.concatenate([[0], np.cumsum(n)])
        hit = np.empty(len(item), bool)
        for a, b in _blocks(n):
            mine = ragged(first, begin[a:b], n[a:b]) < np.repeat(asked[a:b], n[a:b])
            flags[cut[a] : cut[b]] = mine
            hit[a:b] = np.logical_or.reduceat(mine, cut[a:b] - cut[a])
        # hashes none of whose windows starts in a smaller document need no answer; a row's hashes rise
        ends = np.cumsum([len(r["counts"]) for r in rows])
        new = np.ones(len(hashes), bool)
        new[1:] = hashes[1:] != hashes[:-1]
        new[ends[:-1]] = True
        run = np.flatnonzero(new)
        tell = np.repeat(np.logical_or.reduceat(hit, run), np.diff(np.append(run, len(hashes))))
        out = []
        for r, end in zip(rows, ends.tolist()):
            a = end - len(r["counts"])
            mine = tell[a:end]
            if mine.any() or r["hot"]:
                out.append((r["g"], r["part"], _blob(hashes[a:end][mine]), _blob(np.packbits(flags[cut[a] : cut[end]][np.repeat(mine, n[a:end])])), r["hot"]))
        return _batch(out, "g part hashes flags hot", [pa.int64(), pa.int64(), *[pa.binary()] * 3])

    def cut(t: pa.Table, told: pa.Table) -> pa.Table:
        names, types = "doc_id n_bytes n_removed n_spans kept_sha256 kept", [*[pa.int64()] * 4, pa.string(), pa.binary()]
        if not t.num_rows:
            return _batch([], names, types)
        group, rows = _open(t), _sorted(told, "part")
        told_hashes = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
        told_all = np.concatenate([np.zeros(0, np.uint64), *told_hashes])  # answers come by rising hash
        _, (hashes, counts, _, least, own, item) = sent(group, told_all, np.concatenate([np.zeros(0, _HOT), *[np.frombuffer(r["hot"], _HOT) for r in rows]]))
        flags = np.zeros(int(counts.sum()), bool)  # of the items' windows, in order
        at = np.cumsum(counts) - counts
        which = _among(hashes, told_all)
        windows = np.concatenate([[0], np.cumsum(counts[which])])
        bits, end = np.zeros(int(windows[-1]), bool), 0
        for r, mine in zip(rows, told_hashes):
            a, b, end = int(windows[end]), int(windows[end + len(mine)]), end + len(mine)
            bits[a:b] = np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=b - a)
        flags[np.repeat(which, counts)] = bits
        n, later = counts[item], group.id_of[own] > least[item]
        gone = np.zeros(len(group.data) + 1, np.int8)  # at most LENGTH windows cover a byte
        for a, b in _blocks(n):
            mine = ragged(flags, at[item[a:b]], n[a:b]) | np.repeat(later[a:b], n[a:b])
            places = np.repeat(group.start[own[a:b]] - (np.cumsum(n[a:b]) - n[a:b]), n[a:b]) + np.arange(len(mine))
            # a window begins at a place once
            gone[places[mine]] += 1
            gone[places[mine] + LENGTH] -= 1
        lost = np.cumsum(gone[:-1], dtype=np.int8) > 0
        out = []
        for i, raw, a, s in zip(group.ids, group.raw, group.begin.tolist(), group.size.tolist()):
            mine = lost[a : a + s]
            kept = group.data[a : a + s][~mine].tobytes() if mine.any() else raw
            spans = int(mine[:1].sum()) + int((mine[1:] & ~mine[:-1]).sum())
            out.append((i, s, s - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
        return _batch(out, names, types)

    asked = grouped.groupBy("g").applyInArrow(ask, "part long, g long, keys binary, several binary, strings binary")
    shared = asked.groupBy("part").applyInArrow(answer, "g long, part long, shared binary, hot binary, parts binary")
    offered = grouped.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(
        offer, "part long, g long, hashes binary, counts binary, text binary, least binary, hot binary")
    judged = offered.groupBy("part").applyInArrow(judge, "g long, part long, hashes binary, flags binary, hot binary")
    return grouped.groupBy("g").cogroup(judged.groupBy("g")).applyInArrow(
        cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
