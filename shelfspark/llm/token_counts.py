"""Edit-aware token counts.

Each document keeps its pre-tokens with their token counts as the leaves of a segment tree of sums; trees are written as a
table, and edits, whenever they come, open them again. An edit re-scans text
only from a boundary shortly before it (what the scanner looks ahead to is two characters) to the first old boundary
after it at which the new text has a boundary too: from there on the pre-tokens are the old ones. Only pre-tokens in that
region are encoded again; the region's leaves take the new counts, and the sums above them are updated.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import VOCABULARY, Encoder, encoder, pretokens
from .common import doc_chunks, local_file, shipped, stored, text_buffer, tidy

#: Edits of production: personal data and secrets give way to placeholders.
REDACTIONS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "<EMAIL>"),
    (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<IP>"),
    (r"\+?\d[\d ()-]{7,}\d", "<NUMBER>"),
    (r"\b(?:AKIA[0-9A-Z]{12,}|gh[pousr]_[A-Za-z0-9]{16,}|sk-[A-Za-z0-9-]{16,})", "<SECRET>"),
)
_MARKS = regex.compile("|".join(f"(?P<k{i}>{p})" for i, (p, _) in enumerate(REDACTIONS)))


class CountTree:
    """Segment tree over the pre-tokens of one text: sums of token counts, with edits by byte range.

    It is opened from the kept leaves: their lengths in bytes and their token counts. After an edit the leaves of the touched
    region hold the region's new pre-tokens, spread evenly, so the tree keeps its shape.
    """

    def __init__(self, raw: bytes, sizes: np.ndarray, counts: np.ndarray, enc: Encoder):
        self.enc, self.n, self.raw = enc, len(sizes), raw
        self.begin = np.r_[0, np.cumsum(sizes, dtype=np.int64)].tolist()
        self.fresh: dict[int, bytes] = {}
        self.width = 1 << max(0, (max(1, self.n) - 1).bit_length())
        tokens, size = np.zeros(2 * self.width, np.int64), np.zeros(2 * self.width, np.int64)
        tokens[self.width : self.width + self.n] = counts
        size[self.width : self.width + self.n] = sizes
        w = self.width
        while w > 1:
            for x in (tokens, size):
                x[w // 2 : w] = x[w : 2 * w].reshape(-1, 2).sum(1)
            w //= 2
        self.tokens, self.size = tokens.tolist(), size.tolist()
        self.encoded = 0

    def leaf(self, i: int) -> bytes:
        piece = self.fresh.get(i)
        return self.raw[self.begin[i] : self.begin[i + 1]] if piece is None else piece

    def leaves(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The text, and the lengths and token counts of its leaves, to be kept."""
        parts, done = [], 0
        for i in sorted(self.fresh):
            parts += [self.raw[self.begin[done] : self.begin[i]], self.fresh[i]]
            done = i + 1
        parts.append(self.raw[self.begin[done] :])
        size, tokens = (np.array(x[self.width : self.width + self.n], np.int64) for x in (self.size, self.tokens))
        return b"".join(parts), size[size > 0], tokens[size > 0]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _find(self, byte: int) -> tuple[int, int]:
        """The leaf that holds this byte and the byte where the leaf begins (the last leaf for the end of the text)."""
        k, base = 1, 0
        while k < self.width:
            k *= 2
            if byte - base >= self.size[k] and self.size[k + 1]:
                base += self.size[k]
                k += 1
        return k - self.width, base

    def _set(self, i: int, piece: bytes, tokens: int) -> None:
        self.fresh[i] = piece
        k = i + self.width
        dt, ds = tokens - self.tokens[k], len(piece) - self.size[k]
        while k:
            self.tokens[k] += dt
            self.size[k] += ds
            k //= 2

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace the bytes from start to end (both at boundaries of characters) by ``new``."""
        if not self.n:
            if new:
                begin = pretokens(np.frombuffer(new, np.uint8), np.array([0, len(new)]))
                self.__init__(new, np.diff(np.r_[begin, len(new)]), self._counts(new, begin), self.enc)
                self.encoded = self.n
            return
        i, base = self._find(max(0, start - 8))
        # one leaf more to the left: its end may depend on the changed text
        while i and not self.size[i - 1 + self.width]:
            i -= 1
        if i:
            i -= 1
            while i and not self.size[i + self.width]:
                i -= 1
            base -= self.size[i + self.width]
        j, upto = i, base
        parts: list[bytes] = []
        while j < self.n and upto < end + 1:
            parts.append(self.leaf(j))
            upto += self.size[j + self.width]
            j += 1
        step = 4
        while True:
            old = b"".join(parts)
            text = old[: start - base] + new + old[end - base :]
            ends_here = j >= self.n
            follow = b"" if ends_here else b"".join(map(self.leaf, range(j, min(self.n, j + step))))
            whole = text + follow
            at_end = j + step >= self.n
            marks = pretokens(np.frombuffer(whole, np.uint8), np.array([0, len(whole)]))
            limit = len(whole) if at_end else len(whole) - 12
            cuts, shift = set(marks[marks <= limit].tolist()), len(text)
            # the first old boundary after the edit that is a boundary of the new text as well
            k, at = j, shift
            while k < min(self.n, j + step) and at not in cuts:
                at += self.size[k + self.width]
                k += 1
            if k >= self.n or (at in cuts and k < j + step):
                break
            parts.extend(map(self.leaf, range(j, min(self.n, j + step))))
            j = min(self.n, j + step)
            step *= 2
        region = whole[:at] if k < self.n else whole
        begin = marks[marks < len(region)]
        counts = self._counts(region, begin)
        # the new pre-tokens are spread over the region's leaves, so that these stay small however many edits meet here
        m, at = k - i, [*begin.tolist(), len(region)]
        for t in range(m):
            a, b = t * len(begin) // m, (t + 1) * len(begin) // m
            piece = region[at[a] : at[b]]
            if piece or self.size[i + t + self.width]:
                self._set(i + t, piece, int(counts[a:b].sum()))

    def _counts(self, raw: bytes, begin: np.ndarray) -> np.ndarray:
        self.encoded += len(begin)
        return self.enc.counts(np.frombuffer(raw, np.uint8), begin, np.r_[begin[1:], len(raw)]) if len(begin) else np.zeros(0, np.int64)


def redactions(text: str) -> list[tuple[int, int, str]]:
    """The edits of a text: (start, end, replacement) by character, in order."""
    return [(m.start(), m.end(), REDACTIONS[int(m.lastgroup[1:])][1]) for m in _MARKS.finditer(text)]


#: Every match of REDACTIONS has one of these bytes: @, _, -, an ASCII digit, the K of AKIA, or one outside ASCII (other digits).
_QUICK = np.zeros(256, bool)
_QUICK[[64, 95, 45, 75, *range(48, 58), *range(128, 256)]] = True


def _narrow(x: np.ndarray) -> bytes:
    """Numbers as bytes of the least width that holds them all; the first byte tells it."""
    w = next(w for w in (1, 2, 4, 8) if not len(x) or int(x.max()) < 1 << (8 * w))
    return bytes([w]) + x.astype(f"<u{w}").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


_TREE = "doc_id long, text string, sizes binary, counts binary, tokens long"
_EDITED = _TREE + ", tokens_before long, edits long, reencoded long"


def keep_trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The trees of documents, to be written and kept: doc_id, text, sizes and counts (packed, leaf by leaf), tokens (the sum at the root).

    A row for each row of ``docs``; a null text stays null and has no leaves. An empty table gives none; other columns are ignored.
    """
    name = shipped(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(local_file(name))
        for b in batches:
            buf, offs = text_buffer(b.column("text"))
            for i, j in doc_chunks(offs):
                part, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                starts = pretokens(part, o)
                ends = np.r_[starts[1:], len(part)]
                counts, first = enc.counts(part, starts, ends), np.searchsorted(starts, o)
                sizes, done = (ends - starts if len(starts) else starts), np.r_[0, np.cumsum(counts)]
                cut = lambda x, f=first: pa.array([_narrow(x[f[k] : f[k + 1]]) for k in range(len(f) - 1)], pa.binary())
                cols = [b.column("doc_id")[i:j], b.column("text")[i:j], cut(sizes), cut(counts), pa.array(done[first[1:]] - done[first[:-1]])]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text", "sizes", "counts", "tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), _TREE)


def _edited(name: str, find: Callable[[pa.RecordBatch], Iterator[tuple[int, list]]], whole: bool):
    """Trees after edits: ``find`` gives the rows of a batch that have some, with these in order; others stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(local_file(name))
        for b in batches:
            tokens = b.column("tokens").to_numpy().copy()
            before, edits, again = tokens.copy(), np.zeros(len(tokens), np.int64), np.zeros(len(tokens), np.int64)
            new: dict[int, tuple] = {}
            for k, marks in find(b):
                text = b.column("text")[k].as_py() or ""
                raw = text.encode()
                tree = CountTree(raw, _wide(b.column("sizes")[k].as_py()), _wide(b.column("counts")[k].as_py()), enc)
                if text.isascii():
                    at = range(len(raw) + 1)
                else:
                    at = np.r_[np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80), len(raw)].tolist()
                end = len(at) - 1
                done = end + 1
                for x, y, put in reversed(marks):
                    x, y = min(max(x, 0), end), min(max(y, x, 0), end)
                    if y <= done:  # what overlaps the edit after it is left out
                        tree.edit(at[x], at[y], put.encode())
                        done, edits[k] = x, edits[k] + 1
                tokens[k], again[k] = tree.total, tree.encoded
                if whole:
                    new[k] = tree.leaves()
            if whole:
                pick = lambda c, f, t: pa.array([f(new[k]) if k in new else x for k, x in enumerate(b.column(c).to_pylist())], t)
                kept = [pick("text", lambda x: x[0].decode(), pa.string()), pick("sizes", lambda x: _narrow(x[1]), pa.binary()), pick("counts", lambda x: _narrow(x[2]), pa.binary())]
                names = ["text", "sizes", "counts"]
            else:
                kept, names = [pa.array([(len(x) - 1) // x[0] for x in (r.as_py() for r in b.column("sizes"))], pa.int64())], ["pretokens"]
            cols = [b.column("doc_id"), *kept, *map(pa.array, (tokens, before, edits, again))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", *names, "tokens", "tokens_before", "edits", "reencoded"])

    return run


def apply_edits(trees: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Kept trees after ``edits`` (doc_id, start, end, text): the columns of ``keep_trees`` with tokens_before, edits and reencoded.

    Places are characters of the text as it is kept; an edit puts ``text`` for those from ``start`` to ``end``. Edits of a document are
    applied from the last to the first (by start, end, text); one that overlaps or repeats a later one is left out. Places beyond the text are those of
    its end; null places are its beginning, a null text is none. ``edits`` counts those applied, ``reencoded`` the pre-tokens encoded again. Edits
    of no document do nothing, and a document without edits stays as it is; every row of a repeated doc_id is edited.
    """
    e = edits.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(F.coalesce(F.col("start").cast("long"), F.lit(0)).alias("a"), F.coalesce(F.col("end").cast("long"), F.lit(0)).alias("b"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t")).alias("e"))
    # a document's edits are as many as it has places for; they are no more than its own data
    by_doc = e.where("doc_id is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("e")).alias("marks"))

    def find(b: pa.RecordBatch) -> Iterator[tuple[int, list]]:
        for k, marks in enumerate(b.column("marks").to_pylist()):
            if marks:
                yield k, [(m["a"], m["b"], m["t"]) for m in marks]

    return trees.join(by_doc, "doc_id", "left").mapInArrow(tidy(_edited(shipped(trees.sparkSession, vocabulary), find, True)), _EDITED)


def _marked(b: pa.RecordBatch) -> Iterator[tuple[int, list]]:
    buf, offs = text_buffer(b.column("text"))
    for i, j in doc_chunks(offs):
        hits = np.r_[0, np.cumsum(_QUICK[buf[offs[i] : offs[j]]])]
        o = offs[i : j + 1] - offs[i]
        for k in np.flatnonzero(hits[o[1:]] - hits[o[:-1]]).tolist():
            if marks := redactions(b.column("text")[i + k].as_py()):
                yield i + k, marks


def count_with_edits(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Tokens of every document before and after the redactions: doc_id, tokens_before, tokens_after, edits, pretokens, reencoded.

    The trees are kept first, then opened for the edits. ``pretokens`` are the leaves of the document's tree, ``reencoded`` how many
    pre-tokens the edits had encoded again. A null or empty text has 0 in all; repeated rows are counted alike; whole texts are counted. An empty table gives
    none; other columns are ignored.
    """
    trees = stored(keep_trees(docs, vocabulary), "zstd")
    made = trees.mapInArrow(tidy(_edited(shipped(docs.sparkSession, vocabulary), _marked, False)), "doc_id long, pretokens long, tokens long, tokens_before long, edits long, reencoded long")
    return made.select("doc_id", "tokens_before", F.col("tokens").alias("tokens_after"), "edits", "pretokens", "reencoded")
