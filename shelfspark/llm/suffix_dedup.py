"""Repeated passages by blockwise suffix sorting with a difference cover.

A passage of ``length`` words that stands in two places begins two suffixes that agree on that many words. The residues
in a difference cover modulo ``v`` are such that any two positions reach, by one and the same shift below v, two
positions of the cover; so each pair of equal passages has a pair of cover samples, at the same place within the passage,
that agree on ``length - v + 1`` words. First only the cover samples (6 of 31 positions) are sorted, bucket by bucket;
suffixes near a sample that stands alone can't be repeated and are never looked at again. The others are parted into
buckets, and each bucket is sorted by itself, one at a time, ties between equal passages by document and position. Every
task first settles its own suffixes: of a passage that millions of documents share it sends one suffix of each position,
and buckets are settled piece by piece, so no passage is ever held as a whole.

Suffixes are sorted by names of their words (64 bits of all the words that count, and 32 bits of the first two), not by the words themselves or by
ranks of samples: what is asked is only which suffixes agree on ``length`` words, and a name tells that in 12 bytes, where leading words, trailing
words and the ranks of the samples between them would take about 40 (see README). Two different passages have one name with
a chance of 2**-96 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec as tv
from .common import blocks_of, column_udf, doc_chunks, pack_blocks, text_buffer, tidy, unpack_packed

LENGTH = 50
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
_KINDS = [np.uint64, np.uint32, np.int64, np.uint32, np.int32, np.uint8]  # name, leading words, document, check of its text, word position, flag
#: Suffixes that a task sorts at once.
FLUSH = 1_000_000
_NO_ID = 1 << 62


def _words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, their hashes, and the first word of each text and the end."""
    s, e = tv.word_bounds(buf, offs, tv.NOT_SPACE)
    return s, tv.span_hashes(buf, s, e), np.searchsorted(s, offs)


def _shape(length: int) -> tuple[int, tuple[int, ...]]:
    """Period and cover for passages of this length: short ones take every position as a sample."""
    return (PERIOD, COVER) if length >= PERIOD + 5 else (1, (0,))


def _settle(cols: list[np.ndarray], later_only: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Sort suffixes of a bucket and settle what is known of each run of equal ones: (one of each run that goes on, decided places).

    With ``later_only`` the first place goes on and all others are decided, as they have an earlier one. Without, the first
    goes on with a flag that tells whether its run is decided, and once a run has two places all of them are. What goes on
    is settled again with the suffixes that come after it, so a run may be of any length.
    """
    if not len(cols[0]):
        return cols, cols[2:5]
    order = np.lexsort((cols[4], cols[3], cols[2], cols[1], cols[0]))
    cols = [c[order] for c in cols]
    name, lead, ok, t, pos, flag = cols
    new = np.r_[True, (name[1:] != name[:-1]) | (lead[1:] != lead[:-1])]
    other = np.r_[False, (ok[1:] != ok[:-1]) | (t[1:] != t[:-1]) | (pos[1:] != pos[:-1])] & ~new  # not the place before, of the same run
    start, run = np.flatnonzero(new), np.cumsum(new) - 1
    if later_only:
        moved = np.cumsum(other)
        decided = moved > moved[start][run]
    else:
        several = np.logical_or.reduceat(other, start)
        decided = several[run] & (flag == 0)
    rest = [c[start] for c in cols]
    if not later_only:
        rest[5] = (several | np.logical_or.reduceat(flag > 0, start)).astype(np.uint8)
    return rest, [c[decided] for c in (ok, t, pos)]


def _packed(kind: int, cols: list[np.ndarray], block: np.ndarray) -> Iterator[pa.RecordBatch]:
    out = pack_blocks(cols, block)
    if out is not None:
        yield pa.RecordBatch.from_arrays([out.column(0), pa.array(np.full(out.num_rows, kind)), out.column(1)], ["block", "kind", "data"])


def _decided(places: list[np.ndarray], blocks: int) -> Iterator[pa.RecordBatch]:
    """Places on their way to their documents."""
    yield from _packed(1, places, (tv.mix(places[0].view(np.uint64)) % np.uint64(blocks)).astype(np.int64))


def _settled(found: Iterator[list[np.ndarray]], blocks: int, later_only: bool) -> Iterator[pa.RecordBatch]:
    """Suffixes by bucket, settled among themselves first, so that of a hot passage each task sends one of each position only."""
    held: list[list[np.ndarray]] = []

    def out() -> Iterator[pa.RecordBatch]:
        rest, places = _settle([np.concatenate(x) for x in zip(*held, strict=True)], later_only)
        held.clear()
        # within a bucket the rest of the name is as good, and shorter
        bucket, rest[0] = (rest[0] % np.uint64(blocks)).astype(np.int64), rest[0] // np.uint64(blocks)
        yield from _packed(0, rest, bucket)
        yield from _decided(places, blocks)

    for cols in found:
        held.append(cols)
        if sum(len(c[0]) for c in held) > FLUSH:
            yield from out()
    if held:
        yield from out()


def _entries(w: np.ndarray, at: np.ndarray, depth: int, ids: np.ndarray, check: np.ndarray, pos: np.ndarray) -> list[np.ndarray]:
    """Suffixes at these places: the name of their first ``depth`` words, the first two words, and the place."""
    lead = (w[at] >> np.uint64(32)).astype(np.uint32)
    if depth > 1:
        lead ^= (w[at + 1] >> np.uint64(16)).astype(np.uint32)
    return [tv.window_hashes(w, depth)[at], lead, ids, check, pos.astype(np.int32), np.zeros(len(at), np.uint8)]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For some documents at a time: the batch, which of its rows, words, first words, lengths, row and position of each word, id and check of each row."""
    for b in batches:
        buf, offs = text_buffer(b.column("text"))
        ids, check = b.column("ok").to_numpy(zero_copy_only=False), b.column("t").to_numpy(zero_copy_only=False).astype(np.uint32)
        for i, j in doc_chunks(offs):
            _, w, first = _words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            n = np.diff(first)
            yield b, i, j, w, first, n, np.repeat(np.arange(i, j), n), np.arange(len(w)) - np.repeat(first[:-1], n), ids, check


def _samples(length: int, blocks: int):
    period, cover = _shape(length)
    depth = length - period + 1
    in_cover = np.isin(np.arange(period), cover)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for _, _, _, w, _, n, doc, pos, ids, check in _texts(batches):
            at = np.flatnonzero(in_cover[pos % period] & (pos + depth <= np.repeat(n, n)) & np.repeat(n >= length, n))
            if len(at):
                cols = _entries(w, at, depth, ids[doc[at]], check[doc[at]], pos[at])
                # samples only select: 48 bits of their names do, as two that agree by chance cost a look and no more
                yield [cols[0] >> np.uint64(16), np.zeros_like(cols[1]), *cols[2:]]

    return lambda batches: _settled(found(batches), blocks, False)


def _candidates(length: int, blocks: int):
    period, _ = _shape(length)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        for b, i, j, w, first, n, doc, pos, ids, check in _texts(batches):
            samples = b.column("a")
            at = samples.offsets.to_numpy()
            base = np.repeat(first[:-1], np.diff(at[i : j + 1]))
            p = samples.values.to_numpy()[at[i] : at[j]] + base
            near = np.zeros(len(w) + 1, np.int64)
            np.add.at(near, np.maximum(p - period + 1, base), 1)
            np.add.at(near, p + 1, -1)
            s = np.flatnonzero((np.cumsum(near)[:-1] > 0) & (pos + length <= np.repeat(n, n)))
            if len(s):
                yield _entries(w, s, length, ids[doc[s]], check[doc[s]], pos[s])

    return lambda batches: _settled(found(batches), blocks, True)


def _by_block(batches: Iterator[pa.RecordBatch], kinds: list[type]) -> Iterator[tuple[bool, list[np.ndarray]]]:
    """(whether its bucket ends, columns) of a partition sorted by bucket, bucket by bucket, in pieces of about ``FLUSH`` rows."""
    last, held, size = None, [], 0
    for b in batches:
        for block, raw in zip(b.column("block").to_pylist(), b.column("data"), strict=True):
            if held and (block != last or size > FLUSH):
                yield block != last, unpack_packed(held, kinds)
                held, size = [], 0
            last = block
            view = np.frombuffer(raw.as_buffer(), np.uint8)
            held.append(view)
            size += int(view[:8].view(np.int64)[0])
    if held:
        yield True, unpack_packed(held, kinds)


def _repeated(blocks: int, later_only: bool):
    """Places whose suffix stands in more than one place; ``later_only``: without the first of them. One bucket is sorted at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] = []
        open_: list[pa.RecordBatch] = []

        def suffixes() -> Iterator[pa.RecordBatch]:
            for b in batches:
                kind = b.column("kind").to_numpy()
                if (kind == 1).any():
                    open_.append(b.filter(pa.array(kind == 1)))
                if (kind == 0).any():
                    yield b.filter(pa.array(kind == 0))

        for ends, cols in _by_block(suffixes(), _KINDS):
            yield from open_  # decided before: only passed on
            open_.clear()
            if rest:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            rest, places = _settle(cols, later_only)
            if ends:
                rest = []
            yield from _decided(places, blocks)
        yield from open_

    return run


def _places(as_spans: int):
    """Places of each document as a row (ok, t, a, b): positions, or with ``as_spans`` the spans that they cover, joined where they touch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for ends, cols in _by_block(batches, _KINDS[2:5]):
            held.append(cols)
            if not ends:
                continue
            ok, t, pos = (np.concatenate(x) for x in zip(*held, strict=True))
            held = []
            order = np.lexsort((pos, t, ok))
            ok, t, pos = ok[order], t[order], pos[order]
            doc = np.r_[True, (ok[1:] != ok[:-1]) | (t[1:] != t[:-1])]
            begin = doc | np.r_[True, pos[1:] > pos[:-1] + max(as_spans, 0)]
            a = np.flatnonzero(begin)
            stop = pos[np.r_[a[1:], len(pos)] - 1] + as_spans
            d = np.flatnonzero(doc)
            cuts = pa.array(np.searchsorted(a, np.r_[d, len(pos)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(ok[d]), pa.array(t[d].astype(np.int64)), pa.ListArray.from_arrays(cuts, pa.array(pos[a])), pa.ListArray.from_arrays(cuts, pa.array(stop.astype(np.int32)))], ["ok", "t", "a", "b"])

    return run


def _hashable(t: T.DataType) -> bool:
    if isinstance(t, T.ArrayType):
        return _hashable(t.elementType)
    if isinstance(t, T.StructType):
        return all(_hashable(f.dataType) for f in t.fields)
    return not isinstance(t, (T.MapType, T.VariantType))


def _cut(text: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
    buf, offs = text_buffer(text)
    out = []
    for k, (x, y) in enumerate(zip(a.to_pylist(), b.to_pylist(), strict=True)):
        if x is None:
            out.append((None, None))
            continue
        one = buf[offs[k] : offs[k + 1]]
        s, _ = tv.word_bounds(one, np.array([0, len(one)]), tv.NOT_SPACE)
        edge = np.r_[s, len(one)]
        parts, done = [], 0
        for i, j in zip(x, y, strict=True):
            parts.append(one[done : edge[i]].tobytes())
            done = edge[j]
        parts.append(one[done:].tobytes())
        out.append((b"".join(parts).decode("utf-8", "replace"), len(s) == sum(y) - sum(x)))
    return pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.bool_())], ["text", "gone"])


def _with_spans(docs: DataFrame, length: int) -> tuple[DataFrame, dict[str, Column]]:
    """``docs`` with columns renamed c0, c1, ...; ``a`` and ``b``: the spans to remove; ``cut``: the text without them."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, doc_id = names[docs.columns.index("text")], names[docs.columns.index("doc_id")]
    d = docs.toDF(*names)
    raw = F.col(text).cast("string")
    th = F.xxhash64(raw)
    # rows without an id come after all ids, in the order of their texts' hashes
    ok = F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID) + th.bitwiseAND((1 << 61) - 1))
    base = d.select(ok.alias("ok"), F.coalesce(F.pmod(th, F.lit(1 << 32)), F.lit(0)).alias("t"), *names)
    blocks = blocks_of(docs.sparkSession)
    packed, places = "block long, kind long, data binary", "ok long, t long, a array<int>, b array<int>"
    together = lambda d: d.repartition("block").sortWithinPartitions("block")
    samples = together(base.select("ok", "t", raw.alias("text")).mapInArrow(tidy(_samples(length, blocks)), packed))
    repeated = together(samples.mapInArrow(tidy(_repeated(blocks, False)), packed)).mapInArrow(tidy(_places(0)), places)
    # all columns go along (as a hash) and no key can be null, so that the shuffle of the texts is the very one that the last join reuses
    same = F.xxhash64(*(c for c in names if _hashable(d.schema[c].dataType)))
    near = base.join(repeated, ["ok", "t"], "left").where("a is not null").select("ok", "t", raw.alias("text"), "a", same.alias("same"))
    windows = together(near.mapInArrow(tidy(_candidates(length, blocks)), packed))
    spans = together(windows.mapInArrow(tidy(_repeated(blocks, True)), packed)).mapInArrow(tidy(_places(length)), places)
    cut = column_udf(_cut, "struct<text:string,gone:boolean>")
    out = base.join(spans, ["ok", "t"], "left").withColumn("cut", cut(F.when(F.col("a").isNotNull(), raw), "a", "b"))
    return out, dict(zip(docs.columns, (F.col(n) for n in names), strict=True))


def repeated_passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Each document without the passages of at least ``length`` words that stand earlier in the table.

    Returns a row for each row of ``docs``: doc_id, text (without them), removed_words, spans ("first-end" word numbers,
    joined by commas; empty if none). Words are what ASCII white space parts; they agree byte for byte. A place comes
    earlier by doc_id (nulls last, then by a hash of the text), then by position; of equal passages the earliest stays. A
    word goes with the white space after it.

    Texts of fewer words, empty and null ones stay as they are. Repeated rows (same doc_id and text) count as one
    document. Overlapping repeats within a text are removed too. Other columns are ignored.
    """
    d, col = _with_spans(docs.select("doc_id", "text"), length)
    removed = F.coalesce(F.aggregate("b", F.lit(0), lambda x, y: x + y) - F.aggregate("a", F.lit(0), lambda x, y: x + y), F.lit(0))
    spans = F.coalesce(F.array_join(F.zip_with("a", "b", lambda x, y: F.concat_ws("-", x, y)), ","), F.lit(""))
    return d.select(col["doc_id"].alias("doc_id"), F.when(F.col("a").isNull(), col["text"].cast("string")).otherwise(F.col("cut.text")).alias("text"), removed.cast("long").alias("removed_words"), spans.alias("spans"))


def deduplicate(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated passages cut out of the text as in ``repeated_passages``; all columns as they came.

    A document of which every word is cut (a copy of earlier text) goes; all others stay. A column ``n_chars`` follows
    the new text.
    """
    d, col = _with_spans(docs, length)
    d = d.where("cut.gone is null or not cut.gone")
    kept = F.col("a").isNull()
    out = []
    for c, x in col.items():
        if c == "text":
            x = F.when(kept, x).otherwise(F.col("cut.text"))
        elif c == "n_chars" and isinstance(docs.schema[c].dataType, (T.LongType, T.IntegerType)):
            x = F.when(kept, x).otherwise(F.length("cut.text").cast(docs.schema[c].dataType))
        out.append(x.alias(c))
    return d.select(*out)


_W, _S = r"[^\x09-\x0d\x20]", r"[\x09-\x0d\x20]"
ORACLE = rf"""
with d as (select doc_id, text, regexp_extract_all(text, '{_W}+') as w from documents),
h as (select doc_id, s, md5(array_to_string(w[s + 1:s + {LENGTH}], ' ')) as h
      from (select doc_id, w, unnest(range(0, len(w) - {LENGTH - 1})) as s from d where len(w) >= {LENGTH})),
f as (select doc_id, s from (select doc_id, s, row_number() over (partition by h order by doc_id, s) as rn from h) where rn > 1),
g as (select doc_id, s, sum(fresh) over (partition by doc_id order by s) as island
      from (select doc_id, s, case when s > lag(s) over (partition by doc_id order by s) + {LENGTH} then 1 else 0 end as fresh from f)),
sp as (select doc_id, min(s) as a, max(s) + {LENGTH} as b from g group by doc_id, island),
agg as (select doc_id, sum(b - a) as removed, string_agg(a || '-' || b, ',' order by a) as spans from sp group by doc_id),
chunks as (select doc_id, unnest(c) as chunk, generate_subscripts(c, 1) - 1 as i
           from (select doc_id, regexp_extract_all(text, '{_W}+{_S}*') as c from documents where doc_id in (select doc_id from agg))),
kept as (select c.doc_id, string_agg(chunk, '' order by i) as body from chunks c
         where not exists (select 1 from sp where sp.doc_id = c.doc_id and c.i >= sp.a and c.i < sp.b) group by c.doc_id)
select d.doc_id, case when agg.doc_id is null then d.text
                      else regexp_extract(d.text, '^{_S}*') || coalesce(kept.body, '') end as text,
       cast(coalesce(agg.removed, 0) as bigint) as removed_words, coalesce(agg.spans, '') as spans
from d left join agg using (doc_id) left join kept using (doc_id)
"""
