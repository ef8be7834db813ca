"""Byte-pair encoding by backtracking over longest token matches, and decoding by an offset table."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer as LibraryTokenizer

from tidewatch.llm.common import pieces
from tidewatch.llm.tokens import byte_alphabet

END = ""  # stands for the end-of-word suffix inside the matcher
LAST = 1 << 60
CACHED_WORDS = 350_000


class Merges:
    """Exact merges of one word.

    The encoding of a word is the only way to cut it into tokens so that every two neighbours are what merging their joint
    text gives. So: take the longest token at each place (Aho-Corasick), step to shorter ones where the pair
    doesn't hold, and step back where none does; places found dead are never entered again.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        inner = {k.removesuffix(suffix) + END if suffix and k.endswith(suffix) else k: v for k, v in vocab.items()}
        self.rank = {vocab[a + b]: r for r, (a, b) in reversed(list(enumerate(merges)))}
        self.parts = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in reversed(merges)}
        self.joined = {(vocab[a], vocab[b]): r for r, (a, b) in reversed(list(enumerate(merges)))}
        reached = {k: v for k, v in inner.items() if v in self.parts or len(k.removesuffix(END)) == 1}
        self.length = {v: len(k) for k, v in reached.items()}
        self.matcher = ahocorasick.Automaton()
        for k, v in reached.items():
            self.matcher.add_word(k, v)
        self.matcher.make_automaton()
        self.shorter = {v: next((reached[k[:n]] for n in range(len(k) - 1, 0, -1) if k[:n] in reached), -1) for k, v in reached.items()}
        self.known: dict[tuple[int, int], bool] = {}

    def holds(self, left: int, right: int) -> bool:
        """Whether merging leaves the border between two tokens alone. Undoes their merges from the latest on; at no time may
        the symbols at the border have a merge of their own that comes before those that consumed them."""
        key = (left, right)
        if key in self.known:
            return self.known[key]
        until_left = until_right = LAST
        good = True
        while True:
            r = self.joined.get((left, right), LAST)
            if r < until_left and r <= until_right and r < LAST:
                good = False
                break
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                break
            if a > b:
                until_left, left = a, self.parts[left][1]
            else:
                until_right, right = b, self.parts[right][0]
        if len(self.known) < 4_000_000:
            self.known[key] = good
        return good

    def encode(self, word: str) -> list[int]:
        longest, size = [-1] * len(word), [0] * len(word)
        length = self.length
        for end, token in self.matcher.iter(word):
            start = end + 1 - length[token]
            if length[token] > size[start]:
                longest[start], size[start] = token, length[token]
        out: list[int] = []
        dead = bytearray(len(word) + 1)
        at = 0
        token = longest[0]
        while at < len(word):
            while token >= 0 and (dead[at + length[token]] or (out and not self.holds(out[-1], token))):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at] if at < len(word) else -1
            else:
                if not out:
                    raise ValueError(f"no tokens for {word[:50]!r}")
                dead[at] = 1
                token = out.pop()
                at -= length[token]
                token = self.shorter[token]
        return out


class OffsetTable:
    """Strings by number: one block of bytes and the offsets of each string in it; joins many at once."""

    def __init__(self, strings: list[str], separator: str):
        parts = [(s + separator).encode() for s in strings]
        self.block = np.frombuffer(b"".join(parts), np.uint8)
        self.starts = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        self.tail = len(separator.encode())

    def join(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        starts, lengths = self.starts[ids], self.starts[ids + 1] - self.starts[ids]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1]) + np.repeat(starts - ends + lengths, lengths)
        return self.block[at[: len(at) - self.tail]].tobytes().decode()


class Tokenizer:
    """A word-level byte BPE vocabulary file: lower case, words cut by a pattern, blanks dropped."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if steps != ["NFC", "Replace", "Lowercase"] or split["behavior"] != "Removed" or not split["invert"] or spec["decoder"] is not None:
            raise ValueError("only lower-casing vocabularies that drop blanks between words")
        self.words = regex.compile(split["pattern"]["Regex"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.path = path
        self.plain_chars: set[str] = set()
        self.known_words: dict[str, list[int]] = {}
        self.cut = regex.compile("(" + "|".join(regex.escape(x) for x in self.special) + ")")
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.merges = Merges(model["vocab"], merges, model["end_of_word_suffix"])
        self.bytes_to_char = {b: c for c, b in byte_alphabet().items()}
        names = {v: k for k, v in model["vocab"].items()} | {v: k for k, v in self.special.items()}
        self.table = OffsetTable([names.get(i, "") for i in range(max(names) + 1)], " ")
        self.cache = _Chunks(self)

    def chunk(self, text: str) -> tuple[int, ...]:
        """Ids of a stretch without blanks."""
        out: list[int] = []
        for word in self.words.findall(text):
            ids = self.known_words.get(word)
            if ids is None:
                if len(self.known_words) >= CACHED_WORDS:
                    self.known_words.clear()
                ids = self.merges.encode("".join(map(self.bytes_to_char.__getitem__, word.encode("utf-8", "surrogatepass"))) + END)
                if len(word) <= 40:
                    self.known_words[word] = ids
            out += ids
        return tuple(out)

    def encode(self, text: str | None) -> np.ndarray:
        parts = []
        for part in self.cut.split(text or ""):
            if part in self.special:
                parts.append((self.special[part],))
            elif part and not part.isascii() and self.strange(part):
                # Unassigned here: classes and case follow the library's own character tables, merges stay ours.
                library = whole(self.path)
                words = library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(part))
                parts.append(chain.from_iterable(self.merges.encode(w + END) for w, _ in words))
            elif part:
                plain = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
                plain = plain.lower()
                # str.split() also cuts at four controls that aren't blanks here
                chunks = plain.split() if not _CONTROLS.search(plain) else [x for x in _BLANKS.split(plain) if x]
                parts.append(chain.from_iterable(map(self.cache.__getitem__, chunks)))
        return np.fromiter(chain.from_iterable(parts), np.int32)

    def strange(self, text: str) -> bool:
        """Whether the text has characters that Python's tables don't know yet."""
        new = set(text) - self.plain_chars
        strange = {c for c in new if unicodedata.category(c) == "Cn"}
        self.plain_chars |= new - strange
        return bool(strange)

    def decode(self, ids: np.ndarray) -> str:
        return self.table.join(ids)


_CONTROLS = regex.compile("[\x1c-\x1f]")
_BLANKS = regex.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


class _Chunks(dict):
    """Ids by stretch of text; emptied when it has grown to its bound."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, text: str) -> tuple[int, ...]:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self.tokenizer.chunk(text)
        if len(text) <= 40:
            self[text] = ids
        return ids


@cache
def whole(path: str) -> LibraryTokenizer:
    """The library's own tokenizer, read only where a text needs its character tables."""
    return LibraryTokenizer.from_file(path)


@cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every row's whole text. Null text is empty; ids may repeat or be null; extra columns are
    ignored. `path` is the vocabulary file, readable on all executors. Rows stay where they are: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for b in pieces(batches, 500):
            ids = [own.encode(t) for t in b.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            values = np.concatenate(ids) if ids else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the token strings joined by one blank, as the vocabulary has no decoder. Null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        for b in pieces(batches, 500):
            column = b.column("ids")
            texts = [own.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else "" for x in column]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), column, pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")
