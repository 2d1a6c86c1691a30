"""Secret scan: candidates by pattern, false positives removed by a random forest.

A candidate is a run of at least ``LEAST`` characters of ``[A-Za-z0-9+/_-]`` (and
``=`` at its end) with a digit in it or of an issued form, or any value, quoted or
up to the next blank, of any length and characters, that is assigned to a name
that sounds secret.  A run that is only part of such a value is a candidate of its
own.  Each becomes a vector of its length, the transitions between
its kinds of characters, the share covered by pieces of ordinary words, whether
it stands in a path or URL (and what the document's own path says), and the
words beside it.

Method: trees are grown on bootstrap samples of labelled findings, each node
choosing among a random part of the features by Gini gain over histograms, and
are walked as flat arrays.  Labelled findings come from the caller or, by
default, from rules: issued key forms and assigned high-entropy values are
secrets; bare numbers, values in paths or addresses and plain words are not;
everything else is left to the forest.

Spark side: one pass over the documents makes the findings (light rows, written
once to the checkpoint folder); at most ``TRAIN_ROWS`` labelled ones, those of
least hash, train the forest on the driver; scoring is a second pass over the
findings only.  The dictionary is counted over all documents before that (pieces
are ``PIECE`` letters a-z, so counts and broadcast hold 26^4 short strings at
most).  No text is cut: windows around a candidate are context, not limits.

Defined cases: a null text has no findings; without labelled findings of both
kinds every finding gets the smoothed share of secrets among them (0.5 without
any); repeated rows give their findings again; other columns are ignored; an
empty table gives no rows.  The secret itself is never returned, only its place
and digest.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridseries.llm.common import quoted, slices
from gridseries.session import shared_dir

LEAST, THRESHOLD = 16, 0.5
TRAIN_ROWS = 5_000
TREES, DEPTH, BINS = 40, 6, 32
PIECE = 4

# fixed values: forms and words that mark secrets and placeholders
ISSUED = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,}")
SECRET_NAMES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "access_key", "auth", "credential", "bearer", "private")
HARMLESS = ("example", "sample", "dummy", "test", "placeholder", "checksum", "sha256", "md5", "commit", "uuid", "id")
PATH_HINTS = ("test", "example", "doc", "sample", "mock", "fixture")

_RUN = re.compile(r"[A-Za-z0-9+/_\-]{%d,}={0,2}" % LEAST)
_ASSIGNED = re.compile(r"([A-Za-z_\-]{2,30})[\"']?\s{0,3}(?:=|:|=>)\s{0,3}[\"'(]?$")
# a name (whole run, so that the search is linear) with what may close it, and the sign of an assignment
_NAMED = re.compile(r"(?<![A-Za-z0-9_\-])([A-Za-z0-9_\-]++)[\"'`\])\\]*+\s*+(=>|:=|={1,3}|:)\s*+")
# a type between a name and its value, as in ``token: str = "x"``, and the scheme of a header
_TYPE = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*+(?:\[[^\]\n]*+\])?[^\S\n]*+=(?!=)\s*+")
_SCHEME = re.compile(r"(?:bearer|basic|token)[^\S\n]++", re.I)
_VALUE = re.compile(
    r"(?:[(\[]\s*+(?=[bBrRfFuU]{0,2}[\"'`]))?(?:[bBrRfFuU]{1,2}(?=[\"']))?"
    r"(?:\"{3}(.+?)\"{3}|'{3}(.+?)'{3}|\"\"|''|``|\"((?:[^\"\\\n]|\\.)++)\"|'((?:[^'\\\n]|\\.)++)'|`([^`\n]++)`"
    r"|\\\"([^\"\n]+?)\\\"|\\'([^'\n]+?)\\'|[\"'`]?(\S++))", re.S)
_CLOSING = ".,;)]}\"'`"
_WORD = re.compile(r"[A-Za-z]{3,}")
KINDS = "lower upper digit mark".split()
FEATURES = ["length", "entropy", "distinct", "hex", *[f"{a}_{b}" for a in KINDS for b in KINDS], *KINDS, "longest_letters", "longest_digits",
            "dictionary", "assigned", "secret_name", "secret_near", "harmless_near", "quoted", "in_path", "slashes", "at_before", "path_hint",
            "word_before", "word_after", "number_near"]


def _kind(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3


def describe(text: str, start: int, end: int, dictionary: set[str], path: str, name: str | None = None) -> tuple[list[float], int | None]:
    """The features of one candidate and its label by rule (None: unknown); ``name``: what it is assigned to, if known."""
    value = text[start:end]
    before, after = text[max(0, start - 60) : start], text[end : end + 40]
    n = len(value)
    kinds = [_kind(c) for c in value]
    share = [kinds.count(k) / n for k in range(4)]
    moves = Counter(zip(kinds, kinds[1:]))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    low = value.lower()
    covered = np.zeros(n, bool)
    for i in range(n - PIECE + 1):
        if low[i : i + PIECE] in dictionary:
            covered[i : i + PIECE] = True
    longest = lambda rx: max((len(x) for x in re.findall(rx, value)), default=0) / n
    if name is None and (told := _ASSIGNED.search(before)):
        name = told[1]
    assigned, name = name is not None, (name or "").lower()
    near = (before[-40:] + " " + after[:20]).lower()
    words = set(re.findall(r"[a-z0-9_]+", near))
    secret_name = any(s in name for s in SECRET_NAMES)
    in_path = before[-1:] in ("/", ".", "\\") or after[:1] in ("/", "\\") or bool(re.search(r"\w+://\S*$", before)) or bool(re.match(r"\.[a-z]{2,4}\b", after))
    at = before[-1:] == "@" or after[:1] == "@"
    x = [n, entropy, len(set(value)) / n, sum(c in "0123456789abcdef" for c in low) / n,
         *[moves[a, b] / max(n - 1, 1) for a in range(4) for b in range(4)], *share, longest(r"[A-Za-z]+"), longest(r"[0-9]+"),
         covered.mean(), assigned, secret_name, any(s in near for s in SECRET_NAMES), bool(words & set(HARMLESS)),
         before[-1:] in ("'", '"') and after[:1] in ("'", '"'), in_path, value.count("/") / n, at, any(h in path.lower() for h in PATH_HINTS),
         bool(re.search(r"[A-Za-z]{2,}\W{0,2}$", before)), bool(re.match(r"\W{0,2}[A-Za-z]{2,}", after)), bool(re.search(r"\d{3}", before[-20:] + after[:20]))]
    harmless = bool(words & {"example", "sample", "dummy", "placeholder"})
    if ISSUED.fullmatch(value):
        label = 0 if harmless else 1
    elif secret_name and not in_path and share[2] > 0 and entropy >= 2.5 and covered.mean() < 0.5:
        label = 0 if harmless else 1
    elif share[2] + share[3] == 1 or in_path or at or share[2] == 0 and covered.mean() > 0.8:
        label = 0
    else:
        label = None
    return [float(v) for v in x], label


def _values(text: str):
    """(start, end, name) of every value assigned to a name that sounds secret."""
    low = text.lower()
    if not any(s in low for s in SECRET_NAMES):
        return
    for m in _NAMED.finditer(text):
        name = m[1].lower()
        if not any(s in name for s in SECRET_NAMES):
            continue
        begins = [m.end()]
        if m[2] == ":" and (typed := _TYPE.match(text, m.end())):
            begins.append(typed.end())
        if "auth" in name and (scheme := _SCHEME.match(text, m.end())):
            begins.append(scheme.end())
        for at in begins:
            v = _VALUE.match(text, at)
            if v and v.lastindex:
                start, end = v.span(v.lastindex)
                if v.lastindex == _VALUE.groups:  # up to a blank: without the marks that close the expression around it
                    end = start + len(v[v.lastindex].rstrip(_CLOSING))
                if text[start:end].strip():
                    yield start, end, m[1]


def _named_candidates(text: str) -> dict[tuple[int, int], str | None]:
    """(start, end) of each candidate with the name it is assigned to, where that is known."""
    found: dict[tuple[int, int], str | None] = {(a, b): name for a, b, name in _values(text)}
    for m in _RUN.finditer(text):
        if any("0" <= c <= "9" for c in m[0]) or ISSUED.fullmatch(m[0]):
            found.setdefault(m.span())
        else:
            told = _ASSIGNED.search(text[max(0, m.start() - 60) : m.start()])
            if told and any(s in told[1].lower() for s in SECRET_NAMES):
                found.setdefault(m.span())
    return found


def candidates(text: str):
    """(start, end) of each candidate."""
    yield from sorted(_named_candidates(text))


class Forest:
    """Trees of fixed depth in arrays; a leaf holds the smoothed share of secrets."""

    def __init__(self, prior: float):
        self.prior = prior
        self.feature = np.zeros((0, 2**DEPTH - 1), np.int64)
        self.threshold = np.zeros((0, 2**DEPTH - 1))
        self.value = np.zeros((0, 2**DEPTH))

    def score(self, x: np.ndarray) -> np.ndarray:
        t = len(self.feature)
        if not t or not len(x):
            return np.full(len(x), self.prior)
        node = np.zeros((len(x), t), np.int64)
        tree, row = np.arange(t)[None, :], np.arange(len(x))[:, None]
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.threshold[tree, node])
        return self.value[tree, node - (2**DEPTH - 1)].mean(axis=1)


def grow(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Forest:
    """A random forest: bootstrap samples, a random third of the features per node, Gini gain over histogram cuts."""
    forest = Forest(float((y.sum() + 0.5) / (len(y) + 1)))
    if len(np.unique(y)) < 2:
        return forest
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    f, trees = x.shape[1], []
    for _ in range(TREES):
        weight = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
        node = np.zeros(len(y), np.int64)
        feature, cut = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, BINS, np.int64)
        for level in range(DEPTH):
            width, first = 2**level, 2**level - 1
            key = ((np.arange(f)[None, :] * width + (node - first)[:, None]) * BINS + binned).ravel()
            one, all_ = (np.bincount(key, weights=np.repeat(w, f), minlength=f * width * BINS).reshape(f, width, BINS).cumsum(axis=2) for w in (weight * y, weight))
            purity = lambda p, n: np.where(n > 0, (p**2 + (n - p) ** 2) / np.maximum(n, 1e-9), 0)
            gain = purity(one[..., :-1], all_[..., :-1]) + purity(one[..., -1:] - one[..., :-1], all_[..., -1:] - all_[..., :-1]) - purity(one[..., -1:], all_[..., -1:])
            gain[rng.random((f, width)) > 1 / 3] = 0
            flat = gain.transpose(1, 0, 2).reshape(width, -1)
            best = flat.argmax(axis=1)
            ok = flat[np.arange(width), best] > 1e-9
            feature[first : first + width] = np.where(ok, best // (BINS - 1), 0)
            cut[first : first + width] = np.where(ok, best % (BINS - 1), BINS)
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > cut[node])
        leaf = node - (2**DEPTH - 1)
        p, n = np.bincount(leaf, weight * y, 2**DEPTH), np.bincount(leaf, weight, 2**DEPTH)
        threshold = np.array([edges[i][k] if k < len(edges[i]) else np.inf for i, k in zip(feature, cut)])
        trees.append((feature, threshold, (p + forest.prior) / (n + 1)))
    forest.feature, forest.threshold, forest.value = (np.stack(v) for v in zip(*trees))
    return forest


def _count_pieces(texts: list[str], n: Counter) -> None:
    """Adds the pieces of all words of the texts to ``n``; each distinct word is cut once."""
    for w, c in Counter(w for t in texts for w in _WORD.findall(t)).items():
        w = w.lower()
        for i in range(len(w) - PIECE + 1):
            n[w[i : i + PIECE]] += c


def dictionary_pieces(texts: list[str]) -> set[str]:
    """The pieces of ordinary words that occur at least three times."""
    n: Counter = Counter()
    _count_pieces(texts, n)
    return {p for p, c in n.items() if c >= 3}


def findings(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """doc_id, start, size, sha256, x (features), label (by rule, null: unknown)."""
    path = quoted(path_col).cast("string") if path_col else F.lit("")
    view = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"),
                       F.coalesce(path, F.lit("")).alias("path"))

    def pieces(batches):
        n: Counter = Counter()  # 26^PIECE entries at most
        for b in slices(batches):
            _count_pieces(b.column("text").to_pylist(), n)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["piece", "n"])

    counted = view.mapInArrow(pieces, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).filter("n >= 3")
    known = spark.sparkContext.broadcast({r.piece for r in counted.select("piece").collect()})

    def run(batches):
        for b in slices(batches):
            rows = []
            for i, t, p in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("path").to_pylist()):
                named = _named_candidates(t)
                for start, end in sorted(named):
                    x, label = describe(t, start, end, known.value, p, named[start, end])
                    rows.append((i, start, end - start, hashlib.sha256(t[start:end].encode()).hexdigest(), x, label))
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "start", "size", "sha256", "x", "label"), r)) for r in rows], schema=pa.schema(
                [("doc_id", pa.int64()), ("start", pa.int32()), ("size", pa.int32()), ("sha256", pa.string()), ("x", pa.list_(pa.float64())), ("label", pa.int32())]))

    return view.mapInArrow(run, "doc_id long, start int, size int, sha256 string, x array<double>, label int")


def fit(found: DataFrame, train_rows: int = TRAIN_ROWS) -> Forest:
    """The forest from at most ``train_rows`` findings with a label, equal values counted once."""
    rows = found.filter("label is not null").groupBy("sha256").agg(F.min("label").alias("y"), F.min("x").alias("x")) \
        .orderBy(F.xxhash64("sha256"), "sha256").limit(train_rows).toArrow().sort_by("sha256")
    if not rows.num_rows:
        return grow(np.zeros((0, len(FEATURES))), np.zeros(0))
    return grow(rows.column("x").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1), rows.column("y").to_numpy().astype(float))


def judge(found: DataFrame, forest: Forest, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, start, size, sha256, score, is_secret."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                s = forest.score(np.asarray(b.column("x").flatten()).reshape(b.num_rows, -1))
                yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("doc_id", "start", "size", "sha256")], pa.array(s), pa.array(s >= threshold)],
                                                 ["doc_id", "start", "size", "sha256", "score", "is_secret"])

    return found.mapInArrow(run, "doc_id long, start int, size int, sha256 string, score double, is_secret boolean")


def scan(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source",
         labelled: DataFrame | None = None) -> DataFrame:
    """Every candidate with its score and verdict; ``labelled``: sha256 and label of findings that were judged by hand."""
    shared_dir(spark)
    found = findings(spark, docs, id_col, text_col, path_col).checkpoint()
    train = found
    if labelled is not None:
        train = found.drop("label").join(labelled.select("sha256", F.col("label").cast("int").alias("label")).dropDuplicates(["sha256"]), "sha256")
    return judge(found, fit(train))
