"""BPE encoding and decoding by speculation and verification.

For each new word a greedy longest match over the vocabulary proposes tokens.
A sequence of tokens is the true BPE result exactly if each token encodes to
itself and no merge across any border between neighbours would have come
first. So all neighbouring pairs of all new words of a batch are tested
together: arrays walk back, step by step, through the merges that formed both
sides of each border, and a lower-ranked merge across the border refutes the
pair. Only words with a refuted pair are merged exactly.

Distinct words are encoded once in a batch of texts and kept in a bounded
cache; a text is a join of its words' ids. There is no shuffle, and memory holds
a batch and the cache.

The vocabulary is a tokenizers file with merges, byte-level characters and an
end-of-word suffix; without a decoder there, decoding joins the tokens with
spaces, as the library does. Which characters are letters or have a lower case
depends on a library's Unicode tables: texts with characters on which versions
could differ are normalised and split by the library.

Defined results: a null text counts as empty, gives no ids and decodes to the
empty text; special tokens in a text become their ids; repeated rows are
encoded one by one; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from struct import pack

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracklake.llm import common
from tracklake.llm.byte_bpe import UNUSUAL, byte_of_char

#: Words kept by one Python worker, about 300 bytes each; the cache starts anew beyond it.
MOST_WORDS = 300_000
#: Longer words aren't kept.
LONG_WORD = 200
#: Words of up to so many characters are merged by scans.
SHORT_WORD = 48


class MergeTable:
    """Vocabulary and merges as arrays, and the compatibility of neighbouring tokens."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.vocab, self.suffix = vocab, suffix
        self.rank = {(vocab[a], vocab[b]): (r, vocab[a + b]) for r, (a, b) in enumerate(merges)}
        self.whole = [whole for _, whole in self.rank.values()]  # by rank
        self.order = {a << 32 | b: r for (a, b), (r, _) in self.rank.items()}
        size = max(vocab.values()) + 1
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.formed = np.full(size, -1, np.int64)  # the rank of the merge that forms a token; -1: a base character
        for (a, b), (r, whole) in self.rank.items():
            if self.formed[whole] < 0:
                self.left[whole], self.right[whole], self.formed[whole] = a, b, r
        keys = np.fromiter((a << 32 | b for a, b in self.rank), np.int64, len(self.rank))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.key_rank = np.fromiter((r for r, _ in self.rank.values()), np.int64, len(self.rank))[order]
        self.sound = self._sound(size)
        self.proposals = {t: i for t, i in vocab.items() if self.sound[i]}
        self.longest: dict[str, int] = {}  # by the first two characters of a token
        for t in self.proposals:
            self.longest[t[:2]] = max(len(t), self.longest.get(t[:2], 0))

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, or a number above all ranks."""
        none = len(self.keys)
        if not none:
            return np.zeros(len(a), np.int64)
        wanted = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, wanted), none - 1)
        return np.where(self.keys[at] == wanted, self.key_rank[at], none)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge across the border of each pair comes before ``limit`` (default: ever)."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), len(self.keys), np.int64) if limit is None else limit.astype(np.int64)
        good, open_ = np.ones(len(a), bool), np.arange(len(a))
        while len(open_):
            x, y, most = a[open_], b[open_], limit[open_]
            refuted = self._ranks(x, y) < most
            good[open_[refuted]] = False
            last_left, last_right = self.formed[x], self.formed[y]
            going = ~refuted & (np.maximum(last_left, last_right) >= 0)
            # Of equal ranks the right one formed later, and a merge across the border, being left of it, would come before.
            undo_left = last_left > last_right
            most = np.where(undo_left, last_left, last_right + 1)
            a[open_] = np.where(going & undo_left, self.right[x], x)
            b[open_] = np.where(going & ~undo_left, self.left[y], y)
            limit[open_] = most
            open_ = open_[going]
        return good

    def _sound(self, size: int) -> np.ndarray:
        """Tokens that encode to themselves."""
        sound = np.zeros(size, bool)
        present = np.fromiter(self.vocab.values(), np.int64, len(self.vocab))
        base = present[self.formed[present] < 0]
        sound[base] = True
        made = np.flatnonzero(self.formed >= 0)
        made = made[np.argsort(self.formed[made])]
        fits = self.compatible(self.left[made], self.right[made], self.formed[made])
        for token, fit in zip(made.tolist(), fits.tolist(), strict=True):
            sound[token] = fit and sound[self.left[token]] and sound[self.right[token]]
        return sound

    def propose(self, word: str) -> list[int]:
        """Greedy longest match; ``word`` is in byte-level characters. Empty if a part has no token."""
        known, out, at, end = self.proposals, [], 0, len(word)
        closed = word + self.suffix
        whole = known.get(closed)
        if whole is not None:
            return [whole]
        while at < end:
            if (token := known.get(closed[at:])) is not None:
                out.append(token)
                break
            for to in range(min(end - 1, at + self.longest.get(word[at : at + 2], 1)), at, -1):
                if (token := known.get(word[at:to])) is not None:
                    out.append(token)
                    at = to
                    break
            else:
                return []
        return out

    def merge(self, word: str) -> list[int]:
        """Exact merging: by scans for short words, with a heap of the pairs that can merge for long ones."""
        parts = [*word[:-1], word[-1] + self.suffix] if word else []
        tokens = [self.vocab[p] for p in parts if p in self.vocab]
        return self._merge_short(tokens) if len(tokens) <= SHORT_WORD else self._merge_long(tokens)

    def _merge_short(self, tokens: list[int]) -> list[int]:
        order, whole, none = self.order.get, self.whole, len(self.whole)
        ranks = [order(a << 32 | b, none) for a, b in zip(tokens, tokens[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            tokens[i] = made = whole[best]
            del tokens[i + 1], ranks[i]
            if i:
                ranks[i - 1] = order(tokens[i - 1] << 32 | made, none)
            if i < len(ranks):
                ranks[i] = order(made << 32 | tokens[i + 1], none)
        return tokens

    def _merge_long(self, tokens: list[int]) -> list[int]:
        n = len(tokens)
        after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(*self.rank[p], i, *p) for i, p in enumerate(zip(tokens, tokens[1:], strict=False)) if p in self.rank]
        heap = [(r, i, a, b, whole) for r, whole, i, a, b in heap]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, whole = heapq.heappop(heap)
            j = after[i] if alive[i] else -1
            if j < 0 or tokens[i] != a or tokens[j] != b:
                continue
            tokens[i], alive[j], after[i] = whole, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (p := (tokens[k], tokens[after[k]])) in self.rank:
                    r, made = self.rank[p]
                    heapq.heappush(heap, (r, k, *p, made))
        return [t for t, live in zip(tokens, alive, strict=True) if live]

    def encode_words(self, words: list[str]) -> tuple[list[list[int]], int]:
        """The ids of each word, and how many words needed exact merging."""
        proposed = [self.propose(w) for w in words]
        sizes = np.fromiter(map(len, proposed), np.int64, len(words))
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        failed = sizes == 0
        if len(inner):
            pairs, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
            fits = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)
            failed[owner[inner[~fits[back]]]] = True
        for i in np.flatnonzero(failed).tolist():
            proposed[i] = self.merge(words[i])
        return proposed, int(failed.sum())


class WordBpe:
    """Whole texts in, ids and decoded text out."""

    def __init__(self, vocabulary: str):
        self.library = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as file:
            model = json.load(file)
        bpe, self.decoder = model["model"], model["decoder"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in bpe["merges"]]
        self.table = MergeTable(bpe["vocab"], merges, bpe["end_of_word_suffix"] or "")
        self.token = {i: t for t, i in self.library.get_vocab(with_added_tokens=True).items()}
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        split = model["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pattern = regex.compile(split)
        self.shown = {b: c for c, b in byte_of_char().items()}
        self.known: dict[str, tuple[bytes, str]] = {}

    def _words(self, text: str) -> list[str]:
        """The words of a text without special tokens; those from the library are in byte-level characters and marked."""
        if not text or UNUSUAL.search(text):
            if not text:
                return []
            normal = self.library.normalizer.normalize_str(text)
            return ["\0" + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return self.pattern.findall(text.lower())

    def split(self, text: str) -> list[str]:
        if "<|" not in text:
            return self._words(text)
        out: list[str] = []
        for i, part in enumerate(self.cut.split(text)):
            out += ["\1" + part] if i % 2 else self._words(part)
        return out

    def _encode(self, words: list[str]) -> dict[str, tuple[bytes, str]]:
        out = {w: (np.array([self.special[w[1:]]], "<u4").tobytes(), w[1:]) for w in words if w[0] == "\1"}
        plain = [w for w in words if w[0] != "\1"]
        bytewise = [w[1:] if w[0] == "\0" else "".join([self.shown[b] for b in w.encode()]) for w in plain]
        token = self.token
        for word, ids in zip(plain, self.table.encode_words(bytewise)[0], strict=True):
            out[word] = (pack("<%dI" % len(ids), *ids), " ".join([token[i] for i in ids]))
        return out

    def encode_batch(self, texts: list[str]) -> list[tuple[bytes, str]]:
        """For each text its ids as little-endian unsigned 32-bit integers and the decoded text."""
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        split = [self.split(t) for t in texts]
        new = {w for words in split for w in words}.difference(self.known)
        found = self._encode(list(new))
        self.known.update((w, v) for w, v in found.items() if len(w) <= LONG_WORD)
        known, out = self.known, []
        for words in split:
            pairs = [known.get(w) or found[w] for w in words]
            # a word without any known character has no tokens, and so no space either
            out.append((b"".join([i for i, _ in pairs]), " ".join([t for i, t in pairs if i])))
        return out


def encode_decode(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids and decoded text) for every row."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids binary, decoded string" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                found = bpe.encode_batch(batch.column(1).to_pylist())
                columns = [
                    batch.column(0),
                    pa.array([len(i) // 4 for i, _ in found], pa.int64()),
                    pa.array([hashlib.sha256(i).hexdigest() for i, _ in found], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for _, t in found], pa.string()),
                ]
                if with_ids:
                    columns += [pa.array([i for i, _ in found], pa.binary()), pa.array([t for _, t in found], pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return docs.select(F.col("doc_id").cast("bigint"), common.text_or_empty().alias("text")).mapInArrow(run, schema)
