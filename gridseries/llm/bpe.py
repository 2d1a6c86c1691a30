"""Byte-level BPE encoding and decoding.

Every text is split by a pattern; each match is encoded on its own by the ranks
of a vocabulary file, as the rank-file library does: a match that is a token
becomes that token, any other starts as single bytes, and the leftmost pair of
lowest rank is merged until no pair has a rank.

Method: distinct words (texts cut before lone spaces) are split by the pattern
once; their distinct matches are put into padded matrices, bucketed by length.  In
each round every row merges its leftmost minimum-rank pair, so every row loses
one column (compaction); pair ranks come from a hash table of (id, id) kept in
two numpy arrays; rows without a pair left are written out and dropped.
Decoding gathers the bytes of the ids from one byte table.

Spark side: one ``mapInArrow`` over the documents, no shuffle.  A lost executor
costs the re-run of its tasks.  The tables are read once on the driver and
broadcast: their size is that of the vocabulary, not of the data.  Per-worker
memory: a slice of texts and the table of distinct matches, started anew beyond
``CACHE_ENTRIES``.

Defined cases: a null text is the empty text (0 tokens); repeated rows give
repeated results; other columns are ignored; an empty table gives no rows; one
match of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from gridseries.llm.common import Codes, Growing, doc_view, map_slices, ragged

#: Distinct matches a worker remembers before it starts anew.
CACHE_ENTRIES = 300_000
#: Cells of one merge matrix.
MATRIX_CELLS = 1 << 20
NONE = np.int32(2**31 - 1)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class _Words(Codes):
    """Codes of words: a string stands for the word after a space, a tuple for the word as it is; -1 has to be cut with care."""

    def __missing__(self, key):
        if isinstance(key, str):
            if not key or key[0].isspace() or key[-1].isspace():
                self[key] = -1
                return -1
            word = " " + key
        else:
            word = key[0]
        self[key] = n = self.known
        self.known += 1
        self.fresh.append(word)
        return n


class PairTable:
    """(left id, right id) -> merged id, as an open-addressing hash table in numpy arrays."""

    def __init__(self, pairs: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.vals = np.full(1 << self.bits, NONE, np.int32)
        slot = self._slot(pairs)
        left = np.arange(len(pairs))
        while len(left):
            free = self.keys[slot[left]] == np.uint64(2**64 - 1)
            first = left[free][np.unique(slot[left[free]], return_index=True)[1]]
            self.keys[slot[first]], self.vals[slot[first]] = pairs[first], merged[first]
            left = left[self.keys[slot[left]] != pairs[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _MULT) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merged ids, ``NONE`` where there is no such pair or one side is padding (-1)."""
        keys = (left.astype(np.int64).view(np.uint64) << np.uint64(32)) | right.astype(np.int64).view(np.uint64)
        keys[(left < 0) | (right < 0)] = np.uint64(2**64 - 2)
        slot, out = self._slot(keys), np.full(len(keys), NONE, np.int32)
        todo = np.arange(len(keys))
        while len(todo):
            got, want = self.keys[slot[todo]], keys[todo]
            hit = got == want
            out[todo[hit]] = self.vals[slot[todo[hit]]]
            todo = todo[~hit & (got != np.uint64(2**64 - 1))]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out


class Bpe:
    """Vocabulary tables and the kernels on them (plain numpy, no Spark)."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for t, r in ranks.items():
            tokens[r] = t
        pairs, merged = [], []
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    merged.append(r)
        self.pairs = PairTable(np.array(pairs, np.uint64), np.array(merged, np.int32))
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.text_table = _table(tokens)
        self.digit_table = _table([b"%d," % i for i in range(size)])
        self._reset()

    def _reset(self) -> None:
        self.codes, self.ids = _Words(), Growing(np.int32)
        self.starts, self.lens = Growing(np.int64), Growing(np.int32)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("codes", "ids", "starts", "lens")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._reset()

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of each piece (a match of the pattern): flat ids, and the start and length of each piece in them."""
        rank = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        lens, starts = np.ones(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        whole = np.flatnonzero(rank >= 0)
        starts[whole] = np.arange(len(whole))
        flat, size = [rank[whole].astype(np.int32)], len(whole)
        width = np.fromiter(map(len, pieces), np.int64, len(pieces))
        rest = np.flatnonzero(rank < 0)
        bucket = np.ceil(np.log2(np.maximum(width[rest], 1))).astype(np.int64)
        for w in np.unique(bucket):
            rows = rest[bucket == w]
            step = max(1, MATRIX_CELLS >> int(w))
            for lo in range(0, len(rows), step):
                for part, n, ids in self._merge(pieces, rows[lo : lo + step], width):
                    starts[part], lens[part] = size + np.cumsum(n) - n, n
                    flat.append(ids)
                    size += len(ids)
        return np.concatenate(flat), starts, lens

    def _merge(self, pieces, rows, width):
        """Rounds of merges on one matrix; yields (rows, lengths, flat ids) of the rows that are done."""
        lens = width[rows]
        ids = np.full((len(rows), int(lens.max())), -1, np.int32)
        ids[np.arange(ids.shape[1]) < lens[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces[i] for i in rows), np.uint8)]
        rank = self.pairs.find(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), -1)
        while len(rows):
            if rank.shape[1]:
                at = rank.argmin(axis=1)
                best = rank[np.arange(len(rows)), at]
                done = best == NONE
            else:
                done = np.ones(len(rows), bool)
            if done.any():
                left = ids[done]
                yield rows[done], lens[done], left[left >= 0]
                if done.all():
                    return
                go = ~done
                rows, ids, rank, lens, at, best = rows[go], ids[go], rank[go], lens[go], at[go], best[go]
            n, w = ids.shape
            ids[np.arange(n), at] = best
            ids = ids[np.arange(w) != (at + 1)[:, None]].reshape(n, w - 1)
            rank = rank[np.arange(w - 1) != at[:, None]].reshape(n, w - 2)
            lens = lens - 1
            for lo in (at - 1, at):  # the pairs left and right of the merged token
                ok = np.flatnonzero((lo >= 0) & (lo < w - 2))
                rank[ok, lo[ok]] = self.pairs.find(ids[ok, lo[ok]], ids[ok, lo[ok] + 1])
            most = int(lens.max())
            if most < ids.shape[1]:
                ids, rank = ids[:, :most], rank[:, : max(most - 1, 0)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the number of ids of each text."""
        if len(self.codes) > CACHE_ENTRIES:
            self._reset()
        found = [self._words(t) for t in texts]
        if self.codes.fresh:
            self._learn(self.codes.fresh)
            self.codes.fresh = []
        sizes = np.array([len(f) for f in found], np.int64)
        codes = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        lens = self.lens.view()[codes]
        ids = ragged(self.ids.view(), self.starts.view()[codes], lens)
        total = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
        return ids, np.diff(total[np.concatenate([[0], np.cumsum(sizes)])])

    def _words(self, text: str) -> list[int]:
        """Codes of the text's words.  No match of the pattern runs over a single space between two other
        characters, so a text may be cut before each such space; a word's ids depend on the word alone."""
        if not text:
            return []
        code = self.codes.__getitem__
        first, *rest = text.split(" ")
        found = list(map(code, rest))
        if not first or first[-1].isspace() or -1 in found:  # other white space beside a space: cut with care
            first, *rest = _LONE_SPACE.split(text)
            found = [code((" " + x,)) for x in rest]
        return [code((first,)), *found]

    def _learn(self, words: list[str]) -> None:
        split, numbers = _compiled(self.pattern).findall, Codes()
        code = numbers.__getitem__
        found = [list(map(code, split(w))) for w in words]
        ids, starts, lens = self.encode_pieces([p.encode() for p in numbers.fresh])
        codes = np.fromiter(chain.from_iterable(found), np.int64)
        total = np.concatenate([[0], np.cumsum(lens[codes])])
        n = np.diff(total[np.concatenate([[0], np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])])
        self.starts.extend(self.ids.size + np.cumsum(n) - n)
        self.lens.extend(n)
        self.ids.extend(ragged(ids, starts[codes], lens[codes]))

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes that the ids of each text stand for."""
        return _spelt(self.text_table, ids, counts)

    def digests(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str], list[str]]:
        """ids, counts, SHA-256 of the ids as text, SHA-256 of the decoded bytes."""
        ids, counts = self.encode(texts)
        spelt = [hashlib.sha256(x[:-1]).hexdigest() for x in _spelt(self.digit_table, ids, counts)]
        back = [hashlib.sha256(x).hexdigest() for x in self.decode(ids, counts)]
        return ids, counts, spelt, back


def _table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lens = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lens) - lens, lens


def _spelt(table, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    data, starts, lens = table
    ends = np.concatenate([[0], np.cumsum(counts)])
    size = np.concatenate([[0], np.cumsum(lens[ids])])
    spelt = ragged(data, starts[ids], lens[ids]).tobytes()
    cuts = size[ends].tolist()
    return [spelt[a:b] for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=8)
def _compiled(pattern: str):
    return regex.compile(pattern)


def load(path: str, pattern: str) -> Bpe:
    """The tables of a rank file: lines of base64 token and rank."""
    with open(path, "rb") as f:
        return Bpe({base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}, pattern)


def encode(spark: SparkSession, docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (array of int), ids_sha256, decoded_sha256: encoded, then decoded from the ids."""
    shared = spark.sparkContext.broadcast(load(path, pattern))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        ids, counts, spelt, back = shared.value.digests(b.column("text").to_pylist())
        cuts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids)),
             pa.array(spelt, pa.string()), pa.array(back, pa.string())],
            ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return map_slices(doc_view(docs, id_col, text_col), run,
                      "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def decode(spark: SparkSession, encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """doc_id, data (binary): the bytes of a column of id arrays (null: no bytes)."""
    from pyspark.sql import functions as F

    from gridseries.llm.common import quoted

    shared = spark.sparkContext.broadcast(load(path, pattern))

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                col = part.column("ids")
                back = shared.value.decode(np.asarray(col.flatten(), dtype=np.int64),
                                           np.asarray(pa.compute.list_value_length(col), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(back, pa.binary())], ["doc_id", "data"])

    ids = F.coalesce(F.filter(quoted(ids_col), lambda x: x.isNotNull()), F.array().cast("array<int>"))
    return encoded.select(quoted(id_col).cast("long").alias("doc_id"), ids.alias("ids")).mapInArrow(run, "doc_id long, data binary")
