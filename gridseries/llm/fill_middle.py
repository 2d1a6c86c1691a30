"""Fill-in-middle transformation: cuts found by rank queries on a wavelet matrix over character classes.

A text is cut into units: a unit ends behind every character of the unit's
ending classes (lines: behind each newline; words: behind each blank), and what
is left at the end is the last unit.  Two hashes of the document's id say how
many units the prefix holds and how many prefix and middle hold together; two
more say which form the document gets:

* ``plain``: the text as it is (empty texts, texts that contain a mark, and
  those that the rate leaves alone);
* ``psm``: mark, prefix, mark, suffix, mark, middle;
* ``spm``: mark, suffix, mark, prefix, mark, middle.

Method: each character gets one of eight classes; the classes of many texts
together are kept as a wavelet matrix (three levels of packed bits with a count
before every 64 of them).  The boundaries before a position are the sum of one
rank query per ending class, for all texts at once; the place of the u-th
boundary is found by bisection on these ranks (one class alone would allow
``select``, several together do not).  Only the cuts are computed this way; the
pieces are then sliced from the text, over code points.

Spark side: one ``mapInArrow``, no shuffle; the matrix covers a slice of about
``SLICE_BYTES`` of texts (one longer text is a slice of its own, about two bytes
a character).  ``restored`` takes an output apart again in JVM expressions.
A lost executor costs its tasks only: the cuts depend on id and text alone.

Defined cases: a null text is the empty text; a null id hashes as the empty
string; repeated rows give the same row again; other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries.llm.common import doc_view, map_slices

MARKS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 7, 100, 50

#: Character classes, in the order of their numbers.
CLASSES = ("newline", "blank", "stop", "mark", "digit", "upper", "letter", "other")
NEWLINE, BLANK, STOP, MARK, DIGIT, UPPER, LETTER, OTHER = range(8)
#: The classes behind whose characters a unit ends.
UNITS = {"line": (NEWLINE,), "word": (NEWLINE, BLANK), "sentence": (NEWLINE, STOP), "char": tuple(range(8))}
STOPS = ".!?…。！？"


def char_class(c: str) -> int:
    """The class of one character."""
    if c == "\n":
        return NEWLINE
    if c.isspace():
        return BLANK
    if c in STOPS:
        return STOP
    kind = unicodedata.category(c)
    if kind[0] in "PS":
        return MARK
    if kind[0] == "N":
        return DIGIT
    if kind in ("Lu", "Lt"):
        return UPPER
    return LETTER if kind[0] in "LM" else OTHER


_ASCII = np.array([char_class(chr(i)) for i in range(128)], np.uint8)
_PIECE = 1 << 20


def classes(text: str) -> np.ndarray:
    """The class of every character, a million characters at a time."""
    out = np.empty(len(text), np.uint8)
    for lo in range(0, len(text), _PIECE):
        points = np.frombuffer(text[lo : lo + _PIECE].encode("utf-32-le"), np.uint32)
        part = _ASCII[np.minimum(points, 127)]
        far = np.flatnonzero(points > 127)
        if len(far):
            kinds, at = np.unique(points[far], return_inverse=True)
            part[far] = np.array([char_class(chr(p)) for p in kinds.tolist()], np.uint8)[at]
        out[lo : lo + len(part)] = part
    return out


class Bits:
    """A row of bits that counts the ones before any position."""

    def __init__(self, bits: np.ndarray):
        packed = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed.view(np.uint8)[: (len(bits) + 7) // 8] = np.packbits(bits, bitorder="little")
        self.words = packed
        ones = np.bitwise_count(packed).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.ones = int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)


class WaveletMatrix:
    """Rank queries over a sequence of small numbers: per bit, highest first, the zeros of a level move before its ones."""

    def __init__(self, codes: np.ndarray, bits: int = 3):
        self.size, self.levels = len(codes), []
        for b in range(bits - 1, -1, -1):
            bit = (codes >> b) & 1
            level = Bits(bit)
            self.levels.append((b, level, len(codes) - level.ones))
            codes = np.concatenate([codes[bit == 0], codes[bit == 1]])

    def rank(self, code: int, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` entries are ``code``."""
        low, high = np.zeros(1, np.int64), np.asarray(at, np.int64)
        for b, level, zeros in self.levels:
            if code >> b & 1:
                low, high = zeros + level.rank(low), zeros + level.rank(high)
            else:
                low, high = low - level.rank(low), high - level.rank(high)
        return high - low

    def boundaries(self, codes: tuple[int, ...], at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` entries are one of ``codes``: the sum of their ranks."""
        return sum(self.rank(c, at) for c in codes)

    def select(self, codes: tuple[int, ...], nth: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least position in ``low..high`` before which ``nth`` boundaries lie, by bisection on ``boundaries``."""
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            mid = (low + high) >> 1
            enough = self.boundaries(codes, mid) >= nth
            high = np.where(open_ & enough, mid, high)
            low = np.where(open_ & ~enough, mid + 1, low)
        return low


def cuts(texts: list[str], unit: str, first: np.ndarray, second: np.ndarray):
    """Units of each text, and the two positions where the prefix and the middle end (``first``, ``second``: hashes)."""
    ends = UNITS[unit]
    codes = classes("".join(texts))
    matrix = WaveletMatrix(codes)
    stop = np.cumsum([len(t) for t in texts], dtype=np.int64)
    start = stop - np.array([len(t) for t in texts], np.int64)
    before = matrix.boundaries(ends, start)
    whole = matrix.boundaries(ends, stop) - before
    # a text that does not end with a boundary has one unit more
    last = np.zeros(256, bool)
    last[list(ends)] = True
    n = whole.copy()
    filled = stop > start
    n[filled] += ~last[codes[stop[filled] - 1]]
    a, b = first % (n + 1), second % (n + 1)
    at = []
    for units in (np.minimum(a, b), np.maximum(a, b)):
        place = matrix.select(ends, before + np.minimum(units, whole), start, stop)
        at.append(np.where(units > whole, stop, place) - start)
    return n, at[0], at[1]


def rendered(prefix: str, middle: str, suffix: str, form: str, marks=MARKS) -> str:
    p, s, m = marks
    if form == "psm":
        return f"{p}{prefix}{s}{suffix}{m}{middle}"
    return f"{s}{suffix}{p}{prefix}{m}{middle}"


def restored(output, form, marks=MARKS) -> Column:
    """The text that an output was made from (its pieces contain no mark)."""
    out, kind = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    pieces = F.split(out, "|".join(re.escape(m) for m in marks), -1)  # psm: '', prefix, suffix, middle
    order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    return F.when(kind == "plain", out).otherwise(
        F.when(kind == "psm", F.concat(*[F.get(pieces, F.lit(i)) for i in order["psm"]]))
        .otherwise(F.concat(*[F.get(pieces, F.lit(i)) for i in order["spm"]])))


def transform(docs: DataFrame, unit: str = "line", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, marks=MARKS,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (units), form, prefix_chars, middle_chars (null if plain), output (text).

    ``rate``: of 100 documents, how many are transformed; ``spm_rate``: of 100 of
    those, how many get the form ``spm``.
    """
    if unit not in UNITS:
        raise ValueError(f"unit {unit!r} is not one of {', '.join(UNITS)}")
    view = doc_view(docs, id_col, text_col)
    digest = F.sha2(F.concat(F.lit(f"{int(seed)}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    hashes = [F.conv(F.substring("__h", 8 * i + 1, 8), 16, 10).cast("long").alias(f"__h{i + 1}") for i in range(4)]
    keyed = view.withColumn("__h", digest).select("doc_id", "text", *hashes)

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = b.column("text").to_pylist()
        h1, h2, h3, h4 = (np.asarray(b.column(f"__h{i}"), dtype=np.int64) for i in (1, 2, 3, 4))
        n, one, two = cuts(texts, unit, h1, h2)
        forms, outputs = [], []
        for t, a, z, takes, kind in zip(texts, one.tolist(), two.tolist(), (h3 % 100 < rate).tolist(), (h4 % 100 < spm_rate).tolist()):
            form = "plain" if not t or not takes or any(m in t for m in marks) else "spm" if kind else "psm"
            forms.append(form)
            outputs.append(t if form == "plain" else rendered(t[:a], t[a:z], t[z:], form, marks))
        plain = np.array([f == "plain" for f in forms], bool)
        return pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(forms, pa.string()), pa.array(one, pa.int64(), mask=plain),
             pa.array(two - one, pa.int64(), mask=plain), pa.array(outputs, pa.string())],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_slices(keyed, run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")
