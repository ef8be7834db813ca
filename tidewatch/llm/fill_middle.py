"""Fill-in-middle documents: cuts at token boundaries, found through a learned index from rank to offset."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.common import pieces

MARKS = ("<P>", "<S>", "<M>")
WIDTH = 120  # greatest error of a segment: residuals fit into a byte


class RankIndex:
    """Offsets by rank: piecewise linear segments whose error is bounded, and a byte of residual each that makes them exact."""

    def __init__(self, first: np.ndarray, base: np.ndarray, slope: np.ndarray, residual: np.ndarray):
        self.first, self.base, self.slope, self.residual = first, base, slope, residual

    @classmethod
    def fit(cls, offsets: np.ndarray, width: int = WIDTH) -> RankIndex:
        """Greedy segments over ascending offsets: each goes on while one slope keeps all its points within `width`."""
        first, slope, at, n = [], [], 0, len(offsets)
        while at < n:
            low, high, end, step = -np.inf, np.inf, at + 1, 1024
            while end < n:
                run = np.arange(end, min(end + step, n))
                rise = offsets[run] - offsets[at]
                highs = np.minimum(np.minimum.accumulate((rise + width) / (run - at)), high)
                lows = np.maximum(np.maximum.accumulate((rise - width) / (run - at)), low)
                good = int(np.argmax(lows > highs)) if lows[-1] > highs[-1] else len(run)
                if good:
                    low, high, end = lows[good - 1], highs[good - 1], end + good
                if good < len(run):
                    break
                step *= 2
            first.append(at)
            slope.append((low + high) / 2 if end > at + 1 else 0.0)
            at = end
        index = cls(np.array(first, np.int64), offsets[first], np.array(slope), np.zeros(n, np.int8))
        ranks = np.arange(n)
        index.residual = (offsets - index.predict(ranks)).astype(np.int8)
        return index

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        s = np.searchsorted(self.first, ranks, "right") - 1
        return self.base[s] + np.floor(self.slope[s] * (ranks - self.first[s])).astype(np.int64)

    def select(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets of these ranks."""
        return self.predict(ranks) + self.residual[ranks]


def boundaries(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token starts of the joined texts and the end; per text its place in the joined text and the rank of its first token.

    Tokens are runs of A-Z and a-z and single other code points; none crosses from a text into the next.
    """
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.cumsum([0, *(len(t) for t in texts)])
    letter = (points | 32) - np.uint32(97) < 26
    begins = np.ones(len(points), bool)
    begins[1:] = ~(letter[1:] & letter[:-1])
    begins[starts[:-1][starts[:-1] < len(points)]] = True
    offsets = np.append(np.flatnonzero(begins), len(points))
    return offsets, starts, np.searchsorted(offsets[:-1], starts)


def _arrange(seed: int, rate: int, spm: int):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, 5000):
            ids = b.column("id").to_pylist()
            texts = [t or "" for t in b.column("text").to_pylist()]
            draws = np.array([np.frombuffer(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16], ">u4") for i in ids], np.int64)
            offsets, starts, ranks = boundaries(texts)
            index = RankIndex.fit(offsets)
            n = np.diff(ranks)
            cuts = np.sort(draws[:, :2] % (n[:, None] + 1), axis=1)
            places = index.select((ranks[:-1, None] + cuts).ravel()).reshape(-1, 2) - starts[:-1, None]
            out = []
            for i, text, size, draw, (p, q) in zip(ids, texts, n.tolist(), draws.tolist(), places.tolist(), strict=True):
                if not text or draw[2] % 100 >= rate or any(m in text for m in MARKS):
                    out.append((i, size, "plain", None, None, text))
                elif draw[3] % 100 < spm:
                    out.append((i, size, "spm", p, q - p, f"<S>{text[q:]}<P>{text[:p]}<M>{text[p:q]}"))
                else:
                    out.append((i, size, "psm", p, q - p, f"<P>{text[:p]}<S>{text[q:]}<M>{text[p:q]}"))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, rate: int = 90, spm: int = 20) -> DataFrame:
    """Rearrange texts for fill-in-middle training: (id, n, form, prefix_chars, middle_chars, output), a row per input row.

    A text of n tokens (runs of A-Z and a-z, or single other code points) is cut after two ranks drawn from 0 to n by the
    sha256 of `seed:id`. Of 100 texts about `rate` are rearranged, of those about `spm` in 100 suffix first; the others, empty
    texts and those that hold a mark stay plain (prefix_chars and middle_chars are null). `restore` gives the text back.

    Offsets of all boundaries of a batch go into segments of bounded error; a cut is predicted from its rank and
    corrected by the stored residual. Each row stands alone: repeated rows and ids give equal rows, a null id draws by `seed:`.
    Null text is empty; ids are whole numbers; other columns are ignored. Texts of any length are cut whole.
    """
    given = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = given.mapInArrow(_arrange(seed, rate, spm), "id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restore(output: Column, form: Column) -> Column:
    """The text that was rearranged, from the output and its form alone."""

    def after(mark: str) -> Column:
        return F.locate(mark, output) + len(mark)

    def between(mark: str, end: str) -> Column:
        return F.substr(output, after(mark), F.locate(end, output) - after(mark))

    rest = F.substr(output, after("<M>"))
    return F.when(form == "psm", F.concat(between("<P>", "<S>"), rest, between("<S>", "<M>"))).when(form == "spm", F.concat(between("<P>", "<M>"), rest, between("<S>", "<P>"))).otherwise(output)
