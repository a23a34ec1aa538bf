"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear SVM.

The kernel of two strings sums, over all subsequences of ``ORDER`` characters
they share, a weight that decays with every character the subsequence spans.
Gapped and inserted-character spellings therefore stay close to the plain one.

Training, on a bounded sample of labelled documents:

1. Executors count in how many toxic and clean documents each word occurs.
2. From these counts executors find character strings that occur in many toxic
   documents and hardly in clean ones; of these the driver picks landmarks,
   greedily, each time leaving out the words that the last one explains.
3. A sentence's representation holds, for each landmark, the largest
   kernel value over windows of its words as a share of the landmark's own value
   (1 if a word contains the landmark), mapped by the inverse root of the
   landmarks' own kernel matrix (Nyström). A window with all characters of the
   landmark in their order counts by what the decay leaves of it, whatever is
   inserted; one that lacks some is also divided by the root of its own value,
   so that chance likenesses stay small. Sentences of
   toxic documents in which some landmark fires are positive, as they are and
   with characters inserted into the landmark, all sentences of clean documents
   negative; a linear SVM is fitted to them.
4. The largest margin of a document's sentences is mapped to a score by a
   logistic curve with the slope of a fit on the sample's documents, placed so
   that the threshold falls on the margin that parts them best.

Scoring is one pass without a shuffle. A word's kernel values are computed once
in each task. A word counts only for landmarks with which it has most characters
in common, in order; a bit-parallel longest common subsequence, for all
landmarks at once, leaves few words for the kernel itself.

Defined results: null and empty texts have no sentence and get the score of the
intercept; without labels of both classes every score is the share of toxic
labels (0 without any label); several labels of one document count as toxic if
one is; repeated rows are scored one by one; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm import common

#: Characters of a subsequence, and the decay for each character it spans.
ORDER, DECAY = 3, 0.8
#: Of windows that lack a character of the landmark, normalised kernel values below this count as none: so like are chance
#: likenesses of clean words too.
LEAST_VALUE = 0.7
#: A window may be longer than the landmark by so many characters, and by all but three of the landmark's own.
MOST_INSERTED = 4
#: The value of a window that isn't the landmark itself, at most.
MOST_GAPPED = 0.9
#: A word must have this share of the landmark's characters in their order.
LEAST_COMMON = 0.7
#: How much more a clean sentence with a likeness of a landmark counts than one sentence.
CLEAN_WEIGHT = 20.0
LANDMARKS = 96
LANDMARK_CHARS = (4, 8)
#: A landmark must tell so many toxic documents of the sample, and this share of them.
LEAST_DOCS, LEAST_SHARE = 4, 0.02
#: Labelled documents that are read for training, at most, and the share of the score's threshold.
SAMPLE_DOCS = 12_000
THRESHOLD = 0.3
#: Characters of a word that are looked at together; longer words are cut into overlapping parts.
WORD_CHARS = 40
#: Distinct words remembered by a task.
MOST_WORDS = 300_000
#: Texts whose words a task holds at a time.
ROWS_A_TIME = 500

_SENTENCE = re.compile(r"[.!?\n]+(?:\s|$)|\n")
_MARKED = re.compile(r"(?<!\S)\S*\w[^\w\s]+\w\S*")
_SPACED_OUT = re.compile(r"(?<!\S)\S(?:\s\S){3,}(?!\S)")


# -- words


def words_of(text: str) -> list[str]:
    """Lower-cased words, and words as they read without inserted marks.

    A run of four or more single characters also gives one joined word, and a
    word with marks inside also its letters and digits alone.
    """
    text = text.lower()
    words = text.split()
    if _SPACED_OUT.search(text):
        words += ["".join(m.split()) for m in _SPACED_OUT.findall(text)]
    if _MARKED.search(text):
        words += ["".join(filter(str.isalnum, m)) for m in _MARKED.findall(text)]
    return words


def parts_of(word: str) -> list[str]:
    """A word in parts of up to WORD_CHARS characters that overlap by half."""
    if len(word) <= WORD_CHARS:
        return [word]
    return [word[i : i + WORD_CHARS] for i in range(0, len(word) - WORD_CHARS // 2, WORD_CHARS // 2)]


# -- the kernel


def _codes(strings: list[str]) -> np.ndarray:
    """Code points, one row for each string, padded with 0."""
    width = max(map(len, strings), default=1) or 1
    joined = "".join(s.ljust(width, "\0") for s in strings)
    return np.frombuffer(joined.encode("utf-32-le"), np.uint32).reshape(len(strings), width)


def kernel(left: np.ndarray, right: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """The subsequence kernel of each row of ``left`` with the same row of ``right`` (codes, 0 is padding)."""
    n, a = left.shape
    b = right.shape[1]
    prime = np.ones((a + 1, b + 1, n))
    out = np.zeros(n)
    for level in range(1, order + 1):
        last = level == order
        following = np.zeros((a + 1, b + 1, n))
        for i in range(level, a + 1):
            tail = np.zeros(n)
            for j in range(level, b + 1):
                same = (left[:, i - 1] == right[:, j - 1]) & (left[:, i - 1] != 0)
                gain = decay * decay * np.where(same, prime[i - 1, j - 1], 0.0)
                if last:
                    out += gain
                else:
                    tail = decay * tail + gain
                    following[i, j] = decay * following[i - 1, j] + tail
        prime = following
    return out


@dataclass
class Landmarks:
    """Landmark strings packed for bit-parallel comparison."""

    strings: list[str]
    own: np.ndarray = field(init=False)
    codes: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.codes = _codes(self.strings)
        self.own = kernel(self.codes, self.codes)
        # Landmarks share 64-bit numbers, each in a field of its length and a guard bit that stops carries.
        self.fields: list[tuple[int, int, int]] = []  # (number, shift, length)
        number, shift = 0, 0
        for s in self.strings:
            if shift + len(s) + 1 > 64:
                number, shift = number + 1, 0
            self.fields.append((number, shift, len(s)))
            shift += len(s) + 1
        self.numbers = number + 1
        used = np.zeros(self.numbers, np.uint64)
        masks: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(self.numbers, np.uint64))
        for s, (k, at, size) in zip(self.strings, self.fields, strict=True):
            used[k] |= np.uint64(((1 << size) - 1) << at)
            for i, c in enumerate(s):
                masks[ord(c)][k] |= np.uint64(1 << (at + i))
        self.used = used
        self.alphabet = np.array(sorted(masks), np.uint32)
        self.masks = np.vstack([np.zeros((1, self.numbers), np.uint64), *(masks[c][None] for c in self.alphabet.tolist())])
        # With fewer common characters than this a word counts as unlike the landmark.
        self.least = np.array([max(ORDER, math.ceil(LEAST_COMMON * len(s))) for s in self.strings])

    def common(self, words: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences: words x landmarks."""
        at = np.searchsorted(self.alphabet, words)
        at[at == len(self.alphabet)] = 0
        index = np.where(self.alphabet[at] == words, at + 1, 0)
        state = np.broadcast_to(self.used, (len(words), self.numbers)).copy()
        for i in range(words.shape[1]):
            match = self.masks[index[:, i]]
            hit = state & match
            state = ((state + hit) | (state & ~match)) & self.used
        zeros = ~state & self.used
        out = np.empty((len(words), len(self.strings)), np.int8)
        for j, (k, shift, size) in enumerate(self.fields):
            out[:, j] = np.bitwise_count(zeros[:, k] >> np.uint64(shift) & np.uint64((1 << size) - 1))
        return out

    def windows(self, word: str, mark: int) -> set[str]:
        """Parts of a word about as long as a landmark that begin and end with its first and last characters."""
        own = self.strings[mark]
        first, last, n = own[:2], own[-2:], len(own)
        out = set()
        for i, c in enumerate(word):
            if c in first:
                for size in range(n - 1, n + min(MOST_INSERTED, n - 3) + 1):
                    if i + size <= len(word) and word[i + size - 1] in last:
                        out.add(word[i : i + size])
        return out

    def values(self, words: list[str]) -> dict[str, dict[int, float]]:
        """For each word with any, the landmarks that some window is like, with the largest normalised kernel value."""
        out: dict[str, dict[int, float]] = {}
        by_size: dict[int, list[str]] = defaultdict(list)
        for w in words:
            if len(w) >= ORDER:
                by_size[-(-len(w) // 4) * 4].append(w)
        for group in by_size.values():
            for begin in range(0, len(group), 8192):
                part = group[begin : begin + 8192]
                rows, marks = np.nonzero(self.common(_codes(part)) >= self.least)
                tried = [(r, m, x) for r, m in zip(rows.tolist(), marks.tolist(), strict=True) for x in self.windows(part[r], m)]
                for lo in range(0, len(tried), 8192):
                    some = tried[lo : lo + 8192]
                    codes = _codes([x for *_, x in some])
                    at = np.array([m for _, m, _ in some])
                    shared = self.common(codes)[np.arange(len(some)), at]
                    close = shared >= self.least[at]
                    some, codes, at, shared = [x for x, c in zip(some, close.tolist(), strict=True) if c], codes[close], at[close], shared[close]
                    if not some:
                        continue
                    common, own = kernel(self.codes[at], codes), self.own[at]
                    whole = shared == np.array([len(self.strings[m]) for m in at])
                    found = common / np.sqrt(own * np.maximum(kernel(codes, codes), 1e-300))
                    # A window in which the landmark's characters come several times has more than its own value.
                    found = np.where(whole, np.minimum(common / own, MOST_GAPPED), np.where(found >= LEAST_VALUE, found, 0.0))
                    found[[x == self.strings[m] for _, m, x in some]] = 1.0
                    for i in np.flatnonzero(found > 0).tolist():
                        r, m, _ = some[i]
                        best = out.setdefault(part[r], {})
                        best[m] = max(best.get(m, 0.0), min(1.0, float(found[i])))
        return out


def hot_words(landmarks: Landmarks, words: Iterable[str]) -> dict[str, dict[int, float]]:
    """Kernel values of words, long ones by their parts."""
    plain, long = [], []
    for w in words:
        (plain if len(w) <= WORD_CHARS else long).append(w)
    out = landmarks.values(plain)
    for w in long:
        merged: dict[int, float] = {}
        for values in landmarks.values(parts_of(w)).values():
            for k, v in values.items():
                merged[k] = max(v, merged.get(k, 0.0))
        if merged:
            out[w] = merged
    return out


# -- training


def _strings(word: str) -> set[str]:
    low, high = LANDMARK_CHARS
    return {word[i : i + k] for k in range(low, high + 1) for i in range(len(word) - k + 1)}


def _finder(strings: Iterable[str]) -> ahocorasick.Automaton:
    finder = ahocorasick.Automaton()
    for g in strings:
        finder.add_word(g, g)
    finder.make_automaton()
    return finder


def candidates(counted: DataFrame, penalty: float, least: float) -> tuple[dict[str, float], list[tuple[str, float]]]:
    """Strings with a gain of ``least`` or more from toxic words, each with its gain from all words, and the toxic words that hold any.

    ``counted`` has word, bad, good: documents of the sample. A word's value is
    the number of its toxic documents beyond what ``penalty`` times its clean
    ones explain; a string's gain is the sum over words with it. Executors sum;
    the driver gets strings that many toxic documents share.
    """
    value = F.col("bad") - F.lit(penalty) * F.col("good")
    valued = counted.select("word", value.alias("value"))

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain: Counter[str] = Counter()
        for batch in batches:
            for word, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for g in _strings(word):
                    gain[g] += v
            if len(gain) > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(gain.keys()), pa.array(gain.values(), pa.float64())], ["string", "gain"])
                gain.clear()
        yield pa.RecordBatch.from_arrays([pa.array(gain.keys(), pa.string()), pa.array(gain.values(), pa.float64())], ["string", "gain"])

    summed = valued.where("value > 0").mapInArrow(gains, "string string, gain double").groupBy("string").agg(F.sum("gain").alias("gain"))
    found = {r.string: r.gain for r in summed.where(F.col("gain") >= least).collect()}
    if not found:
        return {}, []
    strings = list(found)

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, loss = _finder(strings), Counter()
        for batch in batches:
            words, values = [], []
            for word, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held = {g for _, g in finder.iter(word)}
                if held and v > 0:
                    words.append(word)
                    values.append(v)
                elif held:
                    loss.update(dict.fromkeys(held, v))
            yield pa.RecordBatch.from_arrays([pa.array([True] * len(words), pa.bool_()), pa.array(words, pa.string()), pa.array(values, pa.float64())], ["held", "text", "value"])
        yield pa.RecordBatch.from_arrays([pa.array([False] * len(loss), pa.bool_()), pa.array(loss.keys(), pa.string()), pa.array(loss.values(), pa.float64())], ["held", "text", "value"])

    both = valued.mapInArrow(holders, "held boolean, text string, value double").groupBy("held", "text").agg(F.sum("value").alias("value"))
    words = []
    for r in both.collect():
        if r.held:
            words.append((r.text, r.value))
        else:
            found[r.text] += r.value
    return found, sorted(words)


def pick_landmarks(gain: dict[str, float], words: list[tuple[str, float]], least: float, most: int = LANDMARKS) -> list[str]:
    """Greedily the string of the largest gain, each time leaving out the words that the last one explains.

    Longer strings are preferred to their own parts of nearly the same gain.
    """
    gain = {g: v for g, v in gain.items() if v >= least}
    if not gain:
        return []
    finder = _finder(gain)
    parts = [{g for _, g in finder.iter(word)} for word, _ in words]
    holders: dict[str, list[int]] = defaultdict(list)
    for n, held in enumerate(parts):
        for g in held:
            holders[g].append(n)
    chosen: list[str] = []
    taken: set[int] = set()
    while gain and len(chosen) < most:
        best = max(gain, key=lambda g: (round(gain[g] * (1 - 0.5 ** (len(g) - 2)), 6), len(g), g))
        chosen.append(best)
        for n in holders[best]:
            if n not in taken:
                taken.add(n)
                for g in parts[n]:
                    if g in gain:
                        gain[g] -= words[n][1]
        gain = {g: v for g, v in gain.items() if v >= least}
    return chosen


def fit_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 10.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss by Newton steps; y is -1 or 1."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(z.shape[1])
    ridge = np.eye(z.shape[1])
    ridge[-1, -1] = 1e-3
    for _ in range(rounds):
        slack = 1 - y * (z @ w)
        on = slack > 0
        grad = ridge @ w - 2 * c * z[on].T @ (weight[on] * y[on] * slack[on])
        hess = ridge + 2 * c * (z[on].T * weight[on]) @ z[on]
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit_logistic(m: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and intercept of a probability for margins, with Platt's smoothed targets; y is 0 or 1."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    z, w = np.column_stack([m, np.ones(len(m))]), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        move = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + 1e-6 * np.eye(2), z.T @ (p - target) + 1e-6 * w)
        w -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-9:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def best_border(m: np.ndarray, y: np.ndarray) -> float:
    """The margin that separates labels 0 and 1 with the fewest errors; the middle of the widest such gap."""
    order = np.argsort(m, kind="stable")
    m, y = m[order], y[order] > 0
    below = np.concatenate([[0], np.cumsum(y)])  # toxic ones under the border
    above = (~y).sum() - np.concatenate([[0], np.cumsum(~y)])  # clean ones over it
    errors = (below + above).astype(float)
    edges = np.concatenate([[m[0] - 1], m, [m[-1] + 1]])
    gaps = np.diff(edges)
    errors[gaps <= 0] = np.inf
    at = np.lexsort((-gaps, errors))[0]
    return float((edges[at] + edges[at + 1]) / 2)


@dataclass
class Model:
    landmarks: list[str]
    weights: np.ndarray  # for kernel values: the SVM's weights times the Nyström map
    bias: float
    slope: float
    shift: float

    def probability(self, margin: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30))))


class Scorer:
    """Scores of texts with a cache of the words seen."""

    def __init__(self, model: Model):
        self.model = model
        self.marks = Landmarks(model.landmarks) if model.landmarks else None
        self.known: set[str] = set()
        self.hot: dict[str, dict[int, float]] = {}

    def read(self, texts: list[str]) -> list[list[dict[int, float]]]:
        """For each text and each of its sentences with any, the largest value of each landmark."""
        if self.marks is None:
            return [[] for _ in texts]
        if len(self.known) > MOST_WORDS:
            self.known.clear()
            self.hot.clear()
        words = [set(words_of(t)) for t in texts]
        new = set().union(*words) - self.known
        self.known |= new
        self.hot.update(hot_words(self.marks, new))
        hot = self.hot.keys()
        return [[] if hot.isdisjoint(w) else self._sentences(t) for t, w in zip(texts, words, strict=True)]

    def _largest(self, text: str) -> dict[int, float]:
        out: dict[int, float] = {}
        for w in words_of(text):
            for k, v in self.hot.get(w, {}).items():
                out[k] = max(v, out.get(k, 0.0))
        return out

    def _sentences(self, text: str) -> list[dict[int, float]]:
        # a word that a sentence border cuts counts for the text as a whole
        return [v for v in map(self._largest, _SENTENCE.split(text)) if v] or [self._largest(text)]

    def margins(self, texts: list[str]) -> list[float]:
        w, bias = self.model.weights, self.model.bias
        return [max([bias, *(bias + sum(w[k] * v for k, v in s.items()) for s in found)]) for found in self.read(texts)]


def _nystroem(marks: Landmarks) -> np.ndarray:
    n = len(marks.strings)
    rows, cols = np.divmod(np.arange(n * n), n)
    k = kernel(marks.codes[rows], marks.codes[cols]).reshape(n, n)
    k /= np.sqrt(np.outer(marks.own, marks.own))
    value, vector = np.linalg.eigh((k + k.T) / 2)
    value = np.maximum(value, 1e-3)
    return (vector / np.sqrt(value)) @ vector.T


def disguised(marks: Landmarks) -> list[list[float]]:
    """For each landmark its value in a window with one and more characters inserted, up to as many as windows have."""
    out = []
    for own, size, string in zip(marks.codes, marks.own, marks.strings, strict=True):
        at = len(string) // 2
        seen = _codes([string[:at] + "\1" * m + string[at:] for m in range(1, min(MOST_INSERTED, len(string) - 3) + 1)])
        out.append((kernel(np.repeat(own[None], len(seen), 0), seen) / size).tolist())
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, train: Column, most: int = SAMPLE_DOCS) -> DataFrame:
    """Texts and labels of at most about ``most`` labelled documents that ``train`` allows, chosen by a hash of doc_id."""
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & train)
    marked = marked.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic_label"))
    share = min(1.0, most / max(1, marked.count()))
    chosen = marked.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))
    # ``chosen`` has about ``most`` rows of 12 bytes, so it can be broadcast and the texts are not shuffled.
    return docs.select("doc_id", common.text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id")


def train(docs: DataFrame, labels: DataFrame, allowed: Column, most: int = SAMPLE_DOCS) -> Model:
    """Fit a model on labelled documents whose doc_id ``allowed`` admits."""
    # Copies of one text would count its words again and again.
    sample = labelled_sample(docs, labels, allowed, most).withColumn("text_key", F.xxhash64("text"))
    sample = common.materialize(sample.dropDuplicates(["text_key", "toxic_label"]), "toxic-sample")
    sizes = {r.toxic_label: r["count"] for r in sample.groupBy("toxic_label").count().collect()}
    clean, toxic = sizes.get(0, 0), sum(n for k, n in sizes.items() if k > 0)
    if not clean or not toxic:
        share = toxic / max(1, clean + toxic)
        return Model([], np.zeros(0), 0.0, 1e-3, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    words = F.explode(F.array_distinct(F.split(F.lower("text"), r"\s+"))).alias("word")
    bad = (F.col("toxic_label") > 0).cast("int")
    counted = sample.select(bad.alias("bad"), words).where(F.length("word").between(LANDMARK_CHARS[0], WORD_CHARS))
    counted = counted.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum(1 - F.col("bad")).alias("good"))
    least = max(LEAST_DOCS, LEAST_SHARE * toxic)
    gain, held = candidates(common.materialize(counted, "word-counts"), 4 * toxic / clean, least)
    chosen = pick_landmarks(gain, held, least)
    if not chosen:
        return Model([], np.zeros(0), 0.0, 1e-3, float(np.log(toxic / clean)))
    # Executors turn the sample into kernel values of sentences; sentences without any are only counted.
    first = Model(chosen, np.zeros(len(chosen)), 0.0, 1.0, 0.0)

    def represent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(first)
        for batch in batches:
            marks, values = [], []
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), ROWS_A_TIME):
                for found in scorer.read(texts[at : at + ROWS_A_TIME]):
                    marks.append([list(s) for s in found])
                    values.append([list(s.values()) for s in found])
            yield pa.RecordBatch.from_arrays(
                [pa.array(batch.column(0).to_pylist(), pa.int32()), pa.array(marks, pa.list_(pa.list_(pa.int32()))), pa.array(values, pa.list_(pa.list_(pa.float64())))],
                ["label", "marks", "vals"],
            )

    shown = sample.select(F.col("toxic_label").cast("int").alias("label"), "text")
    table = shown.mapInArrow(represent, "label int, marks array<array<int>>, vals array<array<double>>").toPandas()
    n = len(chosen)
    dense, y, doc = [], [], []
    for i, (label, marks, values) in enumerate(zip(table.label, table.marks, table.vals, strict=True)):
        for m, v in zip(marks, values, strict=True):
            row = np.zeros(n)
            row[np.asarray(m, int)] = v
            dense.append(row)
            y.append(1.0 if label > 0 else -1.0)
            doc.append(i)
    real = len(dense)
    # Insults with characters inserted are rare in a sample: toxic sentences also count with what would be left of a landmark.
    # Values that clean sentences reach tell nothing of a landmark.
    clean_best = np.max([row for row, label in zip(dense, y, strict=True) if label < 0] or [np.zeros(n)], axis=0)
    left = disguised(Landmarks(chosen))
    for i in range(real):
        for k in np.flatnonzero(dense[i] >= 1) if y[i] > 0 else ():
            for value in left[k]:
                if value <= clean_best[k]:
                    continue
                dense.append(np.where(np.arange(n) == k, value, 0.0))
                y.append(1.0)
    dense.append(np.zeros(n))
    y.append(-1.0)
    x, y = np.array(dense), np.array(y)
    weight = np.ones(len(y))
    weight[:real][y[:real] < 0] = CLEAN_WEIGHT
    weight[-1] = max(1.0, clean / 10)  # stands for all sentences without any landmark
    positive = max(1.0, (y > 0).sum())
    weight[y > 0] *= max(1.0, (y < 0).sum() / positive)
    weight[real:-1] /= MOST_INSERTED
    nystroem = _nystroem(Landmarks(chosen))
    w, bias = fit_svm(x @ nystroem, y, weight)
    weights = nystroem @ w
    margins = np.full(len(table), bias)
    np.maximum.at(margins, np.array(doc, int), (x[:real] @ weights + bias) if len(doc) else np.zeros(0))
    slope, _ = fit_logistic(margins, y_docs := (table.label.to_numpy() > 0).astype(float))
    shift = float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * best_border(margins, y_docs))
    return Model(chosen, weights, bias, slope, shift)


# -- scoring


def held_out(doc_id: Column, fold: int = 2, folds: int = 4) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == fold


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_A_TIME):
                batch = whole.slice(at, ROWS_A_TIME)
                scores = [model.probability(m) for m in scorer.margins(batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                    ["doc_id", "score", "predicted"],
                )

    shown = docs.select(F.col("doc_id").cast("bigint"), common.text_or_empty().alias("text"))
    return shown.mapInArrow(run, "doc_id bigint, score double, predicted int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, with all their columns."""

    def rate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.tolist()
            margins = [m for at in range(0, len(texts), ROWS_A_TIME) for m in scorer.margins(texts[at : at + ROWS_A_TIME])]
            yield pd.Series([model.probability(m) for m in margins], dtype="float64")

    return docs.where(F.pandas_udf(rate, "double")(common.text_or_empty()) < threshold)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted: trained without the held-out fold, scored everywhere."""
    model = train(docs, labels, ~held_out(F.col("doc_id")))
    scored = score(docs, model, threshold)
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def fold_of(doc_id: int, folds: int = 4) -> int:
    """The fold of a doc_id, as the expression above counts it."""
    return zlib.crc32(str(doc_id).encode()) % folds
