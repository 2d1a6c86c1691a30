"""Token counts by prefix dynamic programming.

For a vocabulary of word-wise BPE with word ends (the ``tokenizers`` JSON form:
NFC, white space to blanks, lower case, split into letter runs, single digits
and other runs, bytes as characters, merges with an end-of-word suffix).

Method: token t is the last token of a prefix's encoding exactly if it fits the
last token of the shorter prefix before it; two tokens fit if BPE leaves the
border between them alone.  So one pass over a word's prefixes gives the last
token and the token count of every prefix, as if the text ended there; words
that share a beginning share that part of the pass.  A text's counts are its
words' counts plus what came before: the count at every prefix is stored, and
truncation and budget questions are a binary search in it, without re-encoding.

Two tokens fit unless some merge joins a piece at the right edge of the left
token (before it is merged further) with a piece at the left edge of the right
one.  A token's pieces are those of its own merges, so this takes a few look-ups
and is remembered per pair.

Spark side: one ``mapInArrow`` over the documents, no shuffle; the tables are
read on the driver and broadcast (their size is the vocabulary's).  Workers
remember the prefix counts of distinct words, started anew beyond
``CACHE_ENTRIES``.

Defined cases: a null text is the empty text (no tokens); strings of special
tokens inside a text are one token each; repeated rows give repeated results;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from gridseries.llm.common import Codes, Growing, doc_view, map_slices, ragged

LIMIT = 2048
CACHE_ENTRIES = 1_500_000
FIT_ENTRIES = 400_000
INF = 1 << 60


def _byte_characters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the others from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else extra))
        extra += b not in plain
    return out


class PrefixCounter:
    """The vocabulary and the kernels on it (no Spark)."""

    def __init__(self, spec: dict):
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.suffix = model["end_of_word_suffix"]
        self.vocab = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {m: r for r, m in enumerate(merges)}
        self.parts = {a + b: (a, b, r) for r, (a, b) in enumerate(merges)}
        self.longest = max(len(t) - len(self.suffix) * t.endswith(self.suffix) for t in self.vocab)
        self.pattern = split
        self.specials = [t["content"] for t in spec["added_tokens"] if t["special"]]
        self.letters = _byte_characters()
        self._reset()

    def _reset(self):
        self.codes, self.counts = Codes(), Growing(np.int32)
        self.starts, self.lens = Growing(np.int64), Growing(np.int64)
        self.blocks, self.block_counts = Codes(), Growing(np.int32)
        self.block_starts, self.block_lens = Growing(np.int64), Growing(np.int64)
        self.fits_known: dict = {}
        self.edges: dict = {}
        self.finder = regex.compile(self.pattern)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in (
            "codes", "counts", "starts", "lens", "blocks", "block_counts", "block_starts", "block_lens", "fits_known", "edges", "finder", "cut")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._reset()

    def _edge(self, token: str, side: int) -> list[tuple[str, int]]:
        """The pieces at the token's left (0) or right (1) edge, and the rank of the merge that ends each (INF: none)."""
        out = self.edges.get((token, side))
        if out is None:
            out, piece, ends = [], token, INF
            while True:
                out.append((piece, ends))
                made = self.parts.get(piece)
                if made is None:
                    break
                piece, ends = made[side], made[2]
            self.edges[token, side] = out
        return out

    def fits(self, left: str, right: str) -> bool:
        """Whether BPE leaves the border between the two tokens alone."""
        known = self.fits_known.get((left, right))
        if known is None:
            known = True
            rank = self.rank.get
            for a, a_ends in self._edge(left, 1):
                for b, b_ends in self._edge(right, 0):
                    r = rank((a, b))
                    if r is not None and r < a_ends and r <= b_ends:  # equal ranks: the left pair is merged first
                        known = False
            if len(self.fits_known) > FIT_ENTRIES:
                self.fits_known.clear()
            self.fits_known[left, right] = known
        return known

    def _learn(self, words: list[str]) -> None:
        """Counts at every character of each word, as if the text ended there."""
        letters, vocab, suffix, longest, fits = self.letters, self.vocab, self.suffix, self.longest, self.fits
        made: dict[str, list[int]] = {w: [1] for w in self.specials}
        before = ""
        last: list = [None]  # last token of each prefix that goes on, its count, and the count where the word ends
        count, ended = [0], [0]
        for word in sorted(w for w in words if w not in made):
            spelt = "".join([letters[b] for b in word.encode()])
            same, most = 0, min(len(before), len(spelt))
            while same < most and before[same] == spelt[same]:
                same += 1
            del last[same + 1 :], count[same + 1 :], ended[same + 1 :]
            for i in range(same + 1, len(spelt) + 1):
                go = end = None
                for j in range(max(0, i - longest), i):
                    piece = spelt[j:i]
                    if go is None and piece in vocab and (j == 0 or fits(last[j], piece)):
                        go = piece, count[j] + 1
                        if end is not None:
                            break
                    if end is None:
                        piece += suffix
                        if piece in vocab and (j == 0 or fits(last[j], piece)):
                            end = count[j] + 1
                            if go is not None:
                                break
                last.append(go[0])
                count.append(go[1])
                ended.append(end)
            before = spelt
            if word.isascii():
                at = ended[1:]
            else:
                size = np.cumsum([len(c.encode()) for c in word]).tolist()
                at = [ended[k] for k in size]
            made[word] = at
        for word in words:
            if word[0] == "'" and len(word) > 2 and word[1].isalpha():  # cut short, a contraction is two words
                one = self.count_alone("'")
                made[word] = [one, *[one + self.count_alone(word[1:k]) for k in range(2, len(word))], made[word][-1]]
        n = np.fromiter((len(made[w]) for w in words), np.int64, len(words))
        self.starts.extend(self.counts.size + np.cumsum(n) - n)
        self.lens.extend(n)
        self.counts.extend(np.fromiter(chain.from_iterable(made[w] for w in words), np.int32, int(n.sum())))

    def count_alone(self, word: str) -> int:
        """Tokens of one word, by the same pass."""
        spelt = "".join([self.letters[b] for b in word.encode()])
        last, count = [None], [0]
        for i in range(1, len(spelt) + 1):
            for j in range(max(0, i - self.longest), i):
                if i == len(spelt) and spelt[j:] + self.suffix in self.vocab and (j == 0 or self.fits(last[j], spelt[j:] + self.suffix)):
                    return count[j] + 1
                if spelt[j:i] in self.vocab and (j == 0 or self.fits(last[j], spelt[j:i])) and len(last) == i:
                    last.append(spelt[j:i])
                    count.append(count[j] + 1)
        return 0

    def words(self, text: str) -> list[str]:
        """The words that are encoded one by one; a special token is a word of its own."""
        out = []
        for k, part in enumerate(self.cut.split(text) if self.cut else [text]):
            if k % 2:
                out.append(part)
            elif part:
                if not part.isascii():
                    # lower case sigma does not depend on its place here
                    part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
                out += self.finder.findall(part.lower())
        return out

    def _count_words(self, found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Counts after every word character of each list of words, list after list; number of such characters of each."""
        if self.codes.fresh:
            fresh, self.codes.fresh = self.codes.fresh, []
            self._learn(fresh)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        codes = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        return _running(self.counts.view(), self.starts.view()[codes], self.lens.view()[codes], sizes)

    def prefixes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token counts after every character that is in a word, text after text; number of such characters of each text.

        No word runs over a blank, so a text is the sequence of its blocks between blanks, whose counts are remembered.
        """
        if len(self.blocks) + len(self.codes) > CACHE_ENTRIES:
            self._reset()
        block, code = self.blocks.__getitem__, self.codes.__getitem__
        found = [list(map(block, t.split(" "))) for t in texts]
        if self.blocks.fresh:
            fresh, self.blocks.fresh = self.blocks.fresh, []
            counts, n = self._count_words([list(map(code, self.words(x))) for x in fresh])
            self.block_starts.extend(self.block_counts.size + np.cumsum(n) - n)
            self.block_lens.extend(n)
            self.block_counts.extend(counts)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        codes = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        return _running(self.block_counts.view(), self.block_starts.view()[codes], self.block_lens.view()[codes], sizes)


def _running(counts: np.ndarray, starts: np.ndarray, lens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joins pieces with counts of their own into texts of ``sizes`` pieces: adds to each what the text had before it."""
    whole = np.where(lens > 0, np.append(counts, 0)[starts + lens - 1], 0).astype(np.int64)
    upto = np.concatenate([[0], np.cumsum(whole)])
    first = np.cumsum(sizes) - sizes
    before = upto[:-1] - np.repeat(upto[first], sizes)
    ends = np.concatenate([[0], np.cumsum(lens)])
    return ragged(counts, starts, lens) + np.repeat(before, lens), np.diff(ends[np.concatenate([[0], np.cumsum(sizes)])])


def load(path: str) -> PrefixCounter:
    with open(path, encoding="utf-8") as f:
        return PrefixCounter(json.load(f))


def fitting(prefix: np.ndarray, budget: int) -> int:
    """How many of a text's word characters fit into ``budget`` tokens, from its stored prefix counts.

    Counts do not always rise from one prefix to the next, so this is the longest prefix that fits, not the first that does not.
    """
    ok = np.flatnonzero(prefix <= budget)
    return int(ok[-1]) + 1 if len(ok) else 0


def token_counts(spark: SparkSession, docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id",
                 text_col: str = "text", with_prefixes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, fit_chars (word characters of the longest prefix of at most ``limit`` tokens);
    with_prefixes: also prefix_tokens, the count after every word character."""
    shared = spark.sparkContext.broadcast(load(path))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column("text").to_pylist()
        prefix, size = shared.value.prefixes(texts)
        ends = np.cumsum(size)
        last = np.where(size > 0, np.concatenate([[0], prefix])[ends], 0)
        fit = size.copy()
        for i in np.flatnonzero(last > limit):
            fit[i] = fitting(prefix[ends[i] - size[i] : ends[i]], limit)
        columns = [b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(last, pa.int64()),
                   pa.array(last > limit), pa.array(fit, pa.int64())]
        names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"]
        if with_prefixes:
            cuts = np.concatenate([[0], ends]).astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(prefix, pa.int32())))
            names.append("prefix_tokens")
        return pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    return map_slices(doc_view(docs, id_col, text_col), run, schema + ", prefix_tokens array<int>" * with_prefixes)
