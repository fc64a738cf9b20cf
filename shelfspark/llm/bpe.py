"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Texts are cut into pre-tokens without a regular expression. Every character gets a class (letter, number, space, other
white space, contraction, ...), where what the pattern looks ahead to is part of the class. Each class is a function
from scanner state to scanner state; functions compose associatively, so a text is laid out as a matrix whose rows are
scanned side by side for all start states, the rows' functions are composed into each row's true start state, and a
second pass emits the boundaries. Distinct slices are merged once (pairs of least rank first) and kept in a bounded
cache; the byte offsets of the pre-tokens are retained, and decoding checks that tokens begin at each of them.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import column_udf, doc_chunks, local_file, shipped, text_buffer, tidy

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct pre-tokens whose ids a worker keeps; the cache is emptied when it is full.
CACHE_ENTRIES = 100_000

# classes of characters
LETTER, NUMBER, OTHER, WHITE, LAST_SPACE, LAST_WHITE, APOS1, APOS2, RESET = range(9)
# states of the scanner: nothing open, in letters, in numbers, in other signs, in white space, after a leading space, and within a contraction
NONE, IN_L, IN_N, IN_P, IN_W, LEAD, C1, C2 = range(8)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and whether a pre-token begins before the character, by class and state."""
    nxt, cut = np.zeros((9, 8), np.uint8), np.ones((9, 8), bool)
    for cls, state in ((LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_P)):
        nxt[cls] = state
        cut[cls, [state, LEAD]] = False
    nxt[WHITE] = IN_W
    cut[WHITE, IN_W] = False
    nxt[LAST_SPACE], nxt[LAST_WHITE] = LEAD, NONE
    for cls, state in ((APOS1, C1), (APOS2, C2)):
        nxt[cls] = state
        nxt[cls, [IN_P, LEAD]] = IN_P
        cut[cls, [IN_P, LEAD]] = False
    # the characters that a contraction has been promised by its class
    nxt[LETTER, C1], nxt[LETTER, C2] = NONE, C1
    cut[LETTER, [C1, C2]] = False
    nxt[RESET] = NONE
    return nxt, cut


NEXT, CUT = _tables()
_WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def codepoint_classes() -> np.ndarray:
    """The plain class of each code point."""
    kinds = np.array([unicodedata.category(chr(c))[0] for c in range(0x110000)])
    out = np.full(0x110000, OTHER, np.uint8)
    out[kinds == "L"], out[kinds == "N"] = LETTER, NUMBER
    out[_WHITE] = WHITE
    return out


def classes(cp: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Class of each character; ``last`` marks those that end a text."""
    cls = codepoint_classes()[cp]
    n = len(cp)
    white = np.flatnonzero(cls == WHITE)
    if len(white):
        after = np.minimum(white + 1, n - 1)
        final = ~last[white] & (cls[after] != WHITE)
        w = white[final]
        cls[w] = np.where(cp[w] == 32, LAST_SPACE, LAST_WHITE)
    apos = np.flatnonzero(cp == 39)
    if len(apos):
        apos = apos[~last[apos]]
        one = cp[apos + 1]
        single = np.isin(one, [ord(c) for c in "sdmt"])
        cls[apos[single]] = APOS1
        rest = apos[~single & ~last[np.minimum(apos + 1, n - 1)]]
        if len(rest):
            a, b = cp[rest + 1], cp[rest + 2]
            two = (a == ord("l")) & (b == ord("l")) | (a == ord("v")) & (b == ord("e")) | (a == ord("r")) & (b == ord("e"))
            cls[rest[two]] = APOS2
    return cls


def scan(cls: np.ndarray, width: int = 256) -> np.ndarray:
    """True where a pre-token begins. ``cls`` holds RESET wherever a new text begins (as a sign of its own)."""
    n = len(cls)
    rows = -(-n // width)
    grid = np.full(rows * width, RESET, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    flat = NEXT.reshape(-1)
    # each row's function from start state to end state, composed sign by sign for all rows and states at once
    fun = np.tile(np.arange(8, dtype=np.uint8), (rows, 1))
    for k in range(width):
        fun = flat[(grid[k].astype(np.uint16) << 3)[:, None] + fun]
    # inclusive scan of the rows' functions by doubling: composition is associative
    step = 1
    while step < rows:
        prev = fun.copy()
        fun[step:] = np.take_along_axis(prev[step:], prev[:-step], axis=1)
        step *= 2
    state = np.zeros(rows, np.uint8)
    state[1:] = fun[:-1, NONE]
    cuts = np.empty((width, rows), bool)
    cut = CUT.reshape(-1)
    for k in range(width):
        at = (grid[k].astype(np.uint16) << 3) + state
        cuts[k] = cut[at]
        state = flat[at]
    return cuts.T.reshape(-1)[:n]


def pretokens(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte offsets where pre-tokens begin, in all the texts that ``offs`` parts."""
    if not len(buf):
        return np.zeros(0, np.int64)
    lead = (buf & 0xC0) != 0x80
    at = np.flatnonzero(lead)
    cp = np.frombuffer(buf.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.searchsorted(at, offs[:-1][np.diff(offs) > 0])
    last = np.zeros(len(cp), bool)
    last[np.r_[first[1:], len(cp)] - 1] = True
    cls = classes(cp, last)
    with_reset = np.insert(cls, first, RESET)
    cuts = np.delete(scan(with_reset), first + np.arange(len(first)))
    return at[cuts]


class Encoder:
    """Ranks of a byte-level vocabulary, pair merging with a cache, and decoding."""

    def __init__(self, path: str = VOCABULARY, entries: int = CACHE_ENTRIES):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pieces = [b""] * (max(self.ranks.values()) + 1)
        for piece, r in self.ranks.items():
            self.pieces[r] = piece
        self.size = np.array([len(p) for p in self.pieces], np.int64)
        self.flat = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.start = np.cumsum(self.size) - self.size
        self.cache: dict[bytes, list[int]] = {}
        self.entries = entries
        # the compiled pair merging of one slice; its regular expression is never used
        self.core = tiktoken.Encoding("slices", pat_str=r".+", mergeable_ranks=self.ranks, special_tokens={})._core_bpe

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the adjacent pair of least rank is merged, leftmost first, until none is left."""
        return self._merge_long(piece) if len(piece) > 200 else self.core.encode_single_piece(piece)

    def _merge_plain(self, piece: bytes) -> list[int]:
        """The definition, step by step; for tests."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(parts[i] + parts[i + 1], 1 << 30) for i in range(len(parts) - 1)]
        while pairs:
            least = min(pairs)
            if least == 1 << 30:
                break
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 30)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 30)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same with a heap and linked parts, so that a very long pre-token takes n log n steps."""
        import heapq

        ranks, n = self.ranks, len(piece)
        if piece in ranks:
            return [ranks[piece]]
        nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, e = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != e:
                continue
            alive[j] = False
            end[i], nxt[i] = e, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if prv[i] >= 0 and (r := ranks.get(piece[prv[i] : e])) is not None:
                heapq.heappush(heap, (r, prv[i], e))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = nxt[i]
        return out

    def distinct(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[list[int]], np.ndarray]:
        """Ids of the distinct slices, and for each slice which of them it is."""
        _, first, which = np.unique(tv.span_hashes(buf, starts, ends), return_index=True, return_inverse=True)
        raw, cache = buf.tobytes(), self.cache
        if len(cache) > self.entries:
            cache.clear()
        out = []
        for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True):
            piece = raw[a:b]
            ids = cache.get(piece)
            if ids is None:
                ids = self.merge(piece)
                if b - a <= 64:
                    cache[piece] = ids
            out.append(ids)
        return out, which

    def counts(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of tokens of each slice."""
        if not len(starts):
            return np.zeros(0, np.int64)
        ids, which = self.distinct(buf, starts, ends)
        return np.array([len(x) for x in ids], np.int64)[which]

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first id of each text and the end, starts of the pre-tokens, first pre-token of each text and the end)."""
        starts = pretokens(buf, offs)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64), starts, np.zeros(len(offs), np.int64)
        ends = np.r_[starts[1:], len(buf)]
        lists, which = self.distinct(buf, starts, ends)
        size = np.array([len(x) for x in lists], np.int64)
        flat = np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum()))
        base = np.cumsum(size) - size
        n = size[which]
        done = np.cumsum(n)
        ids = flat[np.repeat(base[which] - (done - n), n) + np.arange(int(done[-1]))]
        pre = np.searchsorted(starts, offs)
        if not np.array_equal(self.bytes_of(ids), buf):  # two slices of one hash: take each slice for itself
            lists = [self.merge(buf[a:b].tobytes()) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            n = np.array([len(x) for x in lists], np.int64)
            done = np.cumsum(n)
            ids = np.fromiter(chain.from_iterable(lists), np.int32, int(done[-1]))
        return ids, np.r_[0, done][pre], starts, pre

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes that the ids stand for, one after the other."""
        if not len(ids):
            return np.zeros(0, np.uint8)
        n = self.size[ids]
        done = np.cumsum(n)
        return self.flat[np.repeat(self.start[ids] - (done - n), n) + np.arange(int(done[-1]))]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _lists(values: np.ndarray, offs: np.ndarray, mask: np.ndarray, kind: pa.DataType) -> pa.Array:
    offs = pa.array(offs.astype(np.int32), mask=np.r_[mask, False]) if mask.any() else pa.array(offs.astype(np.int32))
    return pa.ListArray.from_arrays(offs, pa.array(values, kind))


def decoded(enc: Encoder, ids: np.ndarray, ends: np.ndarray, pre: np.ndarray | None, pre_ends: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, where each begins and the end, whether its offsets fit) of token lists.

    ``ends`` and ``pre_ends`` part ids and offsets by text. Offsets fit if they ascend from 0 and a token begins at each.
    """
    begin = np.r_[0, np.cumsum(enc.size[ids])] if len(ids) else np.zeros(1, np.int64)
    offs, ok = begin[ends], np.ones(len(ends) - 1, bool)
    if pre is not None:
        n = np.diff(pre_ends)
        doc = np.repeat(np.arange(len(n)), n)
        at = pre + offs[doc]
        hit = np.minimum(np.searchsorted(begin, at), len(begin) - 1)
        head = np.zeros(len(at), bool)
        head[pre_ends[:-1][n > 0]] = True
        good = (begin[hit] == at) & (at < offs[doc + 1]) & np.where(head, pre == 0, np.r_[True, pre[1:] > pre[:-1]][: len(pre)])
        ok &= (np.bincount(doc[~good], minlength=len(n)) == 0) & ((n > 0) == (np.diff(ends) > 0))
    return np.concatenate([np.zeros(0, np.uint8), *(enc.bytes_of(ids[i : i + 500_000]) for i in range(0, len(ids), 500_000))]), offs, ok


_NEW = {"tokens": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType(), "offsets": T.ArrayType(T.IntegerType()), "round_trip": T.BooleanType()}


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, text: str = "text", check: bool = False) -> DataFrame:
    """All columns of ``docs`` but the text (and any named like the new ones, whatever their case) and: tokens (ids), n_tokens, offsets.

    ``offsets`` are the byte offsets in the UTF-8 text where pre-tokens begin. A null text gives null for all three, an
    empty one empty lists and 0. Whole texts are encoded, however long; repeated rows alike. ``decode`` is the inverse; with ``check`` each
    text is decoded at once, and ``round_trip`` tells whether text and offsets came back (null for a null text). An empty table gives none.
    """
    new = {k: t for k, t in _NEW.items() if check or k != "round_trip"}
    keep = [c for c in docs.columns if c != text and c.lower() not in new]
    name = shipped(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(local_file(name))
        for b in batches:
            col, others = b.column(len(keep)), b.select(range(len(keep)))
            buf, offs = text_buffer(col)
            null = np.asarray(col.is_null()) if len(col) else np.zeros(0, bool)
            for i, j in doc_chunks(offs):
                part, o, z = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], null[i:j]
                ids, ends, starts, pre_ends = enc.encode(part, o)
                pre = (starts - np.repeat(o[:-1], np.diff(pre_ends))).astype(np.int32)
                cols = [_lists(ids, ends, z, pa.int32()), pa.array(np.diff(ends), pa.int64(), mask=z), _lists(pre, pre_ends, z, pa.int32())]
                if check:
                    back, at, ok = decoded(enc, ids, ends, pre, pre_ends)
                    if not np.array_equal(back, part):
                        ok &= np.array([back[x:y].tobytes() == part[u:v].tobytes() for x, y, u, v in zip(at[:-1], at[1:], o[:-1], o[1:], strict=True)], bool)
                    cols.append(pa.array(ok, mask=z))
                yield pa.RecordBatch.from_arrays([*others.slice(i, j - i).columns, *cols], schema=pa.schema([*others.schema, *(pa.field(k, c.type) for k, c in zip(new, cols, strict=True))]))

    # numbered names on the way, as names may have any signs
    given = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)), F.col(text).cast("string").alias("text"))
    schema = T.StructType(given.schema.fields[:-1])
    for k, t in new.items():
        schema = schema.add(k, t)
    return given.mapInArrow(tidy(run), schema).toDF(*keep, *new)


def _decode(enc: Encoder, tokens: pa.Array, offsets: pa.Array | None) -> pa.Array:
    def parts(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return a.flatten().to_numpy(zero_copy_only=False), np.r_[0, np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(a), 0), np.int64))]

    null = np.asarray(tokens.is_null()) if len(tokens) else np.zeros(0, bool)
    raw, offs, ok = decoded(enc, *parts(tokens), *((None, None) if offsets is None else parts(offsets)))
    texts = [None if z else raw[a:b].tobytes().decode("utf-8", "replace") for z, a, b in zip(null.tolist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(ok, mask=null)], ["text", "intact"])


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns of ``encoded`` with ``text``, the text of its ``tokens``, and ``intact``: whether a token begins at each of its ``offsets``.

    Both are null for null tokens; no tokens are an empty text. Without a column ``offsets``, ``intact`` is true. Bytes that are no
    UTF-8 (from token lists that were cut) become replacement characters.
    """
    name = shipped(encoded.sparkSession, vocabulary)
    some = ["tokens", *(["offsets"] if "offsets" in encoded.columns else [])]
    run = column_udf(lambda tokens, offsets=None: _decode(encoder(local_file(name)), tokens, offsets), "struct<text:string,intact:boolean>")
    packed = encoded.select(F.struct(*(F.col(f"`{c}`") for c in encoded.columns if c.lower() not in ("text", "intact"))).alias("row"), run(*some).alias("decoded"))
    return packed.select("row.*", "decoded.text", "decoded.intact")


def tokens_iter(text: str, path: str = VOCABULARY) -> Iterator[int]:
    """Ids of one text, for use on the driver."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    yield from encoder(path).encode(raw, np.array([0, len(raw)], np.int64))[0].tolist()
