"""SimHash near-duplicates found by Golay-code fuzzy hashing.

Each text gets a 92-bit SimHash of its distinct words, cut into four segments of 23 bits. The binary Golay code
(23, 12, 7) covers the 23-bit words, so each segment is decoded to the codewords within distance 4 of it: one of them
if the nearest is within 2, six if it is at 3. Segments that differ in at most two bits always share a codeword (in
three or four bits about three times in five). By pigeonhole, of fingerprints that differ in at most 8 bits, two of
the four segments differ in at most two bits each; so the join keys are the pairs of segments, each with a pair of
codeword indices (24 bits). Candidates that meet in a key are verified by the exact distance of all 92 bits.

A pair that meets in several keys counts at the least of them, so links are counted once, and each task sends back no
pairs but counts and a spanning forest. Fingerprints up to 8 bits apart are always found; beyond that the share of pairs found falls
with the distance (tests measure it; over all pairs within the default distance of 16 bits it is over 0.9).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .common import column_udf, components, doc_chunks, forest, groups, stored, text_buffer, tidy

SEGMENTS, SEGMENT_BITS, MAX_DISTANCE = 4, 23, 16
COMBOS = tuple(itertools.combinations(range(SEGMENTS), 2))
_GENERATOR = 0b101011100011
_HALF = (1 << 46) - 1


@cache
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parity of the 4,096 messages; by syndrome the message parts of the error patterns up to weight 4, and their count."""
    parity = np.zeros(4096, np.int64)
    for m in range(4096):
        r = m << 11
        for i in range(22, 10, -1):
            if r >> i & 1:
                r ^= _GENERATOR << (i - 11)
        parity[m] = r
    patterns, count = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for w in range(5):
        for c in itertools.combinations(range(SEGMENT_BITS), w):
            e = sum(1 << i for i in c)
            s = int(parity[e >> 11] ^ (e & 2047))
            patterns[s, count[s]] = e >> 11
            count[s] += 1
    return parity, patterns, count


def codewords(seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each 23-bit segment, up to six codeword indices (n x 6) and how many of them count (1 or 6)."""
    parity, patterns, count = golay()
    msg = seg >> 11
    syn = parity[msg] ^ (seg & 2047)
    return msg[:, None] ^ patterns[syn], count[syn]


def keys_of(f1: np.ndarray, f2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All join keys of the fingerprints: (index of the fingerprint, key)."""
    segs = (f1 >> 23, f1 & 0x7FFFFF, f2 >> 23, f2 & 0x7FFFFF)
    words = [codewords(s) for s in segs]
    who, keys = [], []
    slot = np.arange(6)
    for k, (a, b) in enumerate(COMBOS):
        (wa, na), (wb, nb) = words[a], words[b]
        ok = (slot[None, :, None] < na[:, None, None]) & (slot[None, None, :] < nb[:, None, None])
        key = k << 24 | wa[:, :, None] << 12 | wb[:, None, :]
        who.append(np.nonzero(ok)[0])
        keys.append(key[ok])
    return np.concatenate(who), np.concatenate(keys).astype(np.int32)


@cache
def _lanes() -> np.ndarray:
    """For each byte, its eight bits as the eight bytes of a word."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view(np.uint64)[:, 0]


def fingerprints(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(f1, f2, number of distinct words) of each text; two halves of 46 bits, 0 where there is no word."""
    n = len(offs) - 1
    f1, f2, distinct = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    starts, ends = tv.word_bounds(buf, offs, tv.ALNUM)
    if not len(starts):
        return f1, f2, distinct
    h = tv.span_hashes(buf, starts, ends, fold=True)
    doc = (np.searchsorted(offs, starts, "right") - 1).astype(np.uint64)
    u = np.unique(doc << np.uint64(48) | h >> np.uint64(16))
    doc, w = (u >> np.uint64(48)).astype(np.int64), u & np.uint64((1 << 48) - 1)
    raw = np.empty((len(w), 16), np.uint8)
    raw[:, :8] = tv.mix(w).view(np.uint8).reshape(-1, 8)
    raw[:, 8:] = tv.mix(w ^ np.uint64(0xA5A5A5A55A5A5A5A)).view(np.uint8).reshape(-1, 8)
    first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    # lanes of one byte overflow beyond 255 words: sum parts of at most 255 words, then the parts of a document
    at = np.arange(len(doc)) - np.repeat(first, np.diff(np.r_[first, len(doc)]))
    part = np.flatnonzero(at % 255 == 0)
    lanes = np.stack([np.add.reduceat(_lanes()[raw[:, k]], part) for k in range(12)], axis=1)
    votes = lanes.view(np.uint8).reshape(len(part), 96).astype(np.int64)
    votes = np.add.reduceat(votes, np.searchsorted(part, first), axis=0)
    size = np.diff(np.r_[first, len(doc)])
    bits = (votes[:, :92] * 2 > size[:, None]).astype(np.int64)
    weight = np.int64(1) << np.arange(45, -1, -1, dtype=np.int64)
    who = doc[first]
    f1[who], f2[who], distinct[who] = bits[:, :46] @ weight, bits[:, 46:] @ weight, size
    return f1, f2, distinct


def _fingerprint(text: pa.Array) -> pa.Array:
    buf, offs = text_buffer(text)
    got = [fingerprints(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in doc_chunks(offs)]
    f1, f2, n = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 3
    return pa.StructArray.from_arrays([pa.array(f1, mask=n == 0), pa.array(f2, mask=n == 0)], ["f1", "f2"])


def least_key(a1: np.ndarray, a2: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """The least join key that each pair of fingerprints shares (beyond all keys if there is none)."""
    slot, shared = np.arange(6), []
    for x, y in ((a1 >> 23, b1 >> 23), (a1 & 0x7FFFFF, b1 & 0x7FFFFF), (a2 >> 23, b2 >> 23), (a2 & 0x7FFFFF, b2 & 0x7FFFFF)):
        (wx, nx), (wy, ny) = codewords(x), codewords(y)
        wx, wy = np.where(slot < nx[:, None], wx, 4096), np.where(slot < ny[:, None], wy, 4097)
        shared.append(np.where((wx[:, :, None] == wy[:, None, :]).any(2), wx, 4096).min(1))
    best = np.full(len(a1), len(COMBOS) << 24)
    for k, (a, b) in enumerate(COMBOS):
        ok = (shared[a] < 4096) & (shared[b] < 4096)
        best = np.where(ok, np.minimum(best, k << 24 | shared[a] << 12 | shared[b]), best)
    return best


#: Join keys travel as packed cells: one row holds the entries (16 bytes each) of many keys that go to one task.
_ENTRY = np.dtype([("key", "<i4"), ("f", "u1", 12)])
#: Entries that a block of keys has on average, and those beyond which it is parted into cells.
BLOCK_ENTRIES, CELL_ENTRIES = 250_000, 1_000_000


def _packed(key: np.ndarray, f1: np.ndarray, f2: np.ndarray) -> np.ndarray:
    out = np.empty(len(key), _ENTRY)
    out["key"] = key
    out["f"][:, :6] = f1.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6]
    out["f"][:, 6:] = f2.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6]
    return out


def _unpacked(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    wide = np.zeros((2, len(entries), 8), np.uint8)
    wide[0, :, :6], wide[1, :, :6] = entries["f"][:, :6], entries["f"][:, 6:]
    f = wide.view("<i8")[:, :, 0]
    return entries["key"].astype(np.int64), f[0], f[1]


def _keys(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, its block, f1, f2) of all entries, a few thousand fingerprints at a time."""
    for b in batches:
        f1, f2 = b.column("f1").to_numpy(zero_copy_only=False), b.column("f2").to_numpy(zero_copy_only=False)
        for i in range(0, len(f1), 4000):
            who, key = keys_of(f1[i : i + 4000], f2[i : i + 4000])
            yield key, (tv.mix(key.astype(np.uint64)) % np.uint64(blocks)).astype(np.int64), f1[i : i + 4000][who], f2[i : i + 4000][who]


def _block_sizes(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(blocks, np.int64)
        for _, block, _, _ in _keys(batches, blocks):
            n += np.bincount(block, minlength=blocks)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["block", "n"])

    return run


def _cells(blocks: int, parts: dict[int, int]):
    """Entries by cell: a block, or for one in ``parts`` each pair of its parts (by fingerprint), so that every pair of entries meets once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.array([parts.get(x, 1) for x in range(blocks)]) if parts else None
        for key, block, f1, f2 in _keys(batches, blocks):
            part, other, r = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), np.arange(len(key))
            if count is not None:
                c = count[block]
                own = _part(f1, f2, c)
                r = np.repeat(r, c)
                partner = np.arange(len(r)) - np.repeat(np.cumsum(c) - c, c)
                part, other = np.minimum(own[r], partner), np.maximum(own[r], partner)
            cell = np.stack([block[r], part, other], 1)
            order = np.lexsort((cell[:, 2], cell[:, 1], cell[:, 0]))
            cell, r = cell[order], r[order]
            entries = _packed(key[r], f1[r], f2[r])
            cut = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]).any(1)]) if len(cell) else np.zeros(0, np.int64)
            raw = [entries[x:y].tobytes() for x, y in zip(cut, np.r_[cut[1:], len(cell)], strict=True)]
            yield pa.RecordBatch.from_arrays([*(pa.array(cell[cut, k]) for k in range(3)), pa.array(raw, pa.binary())], ["block", "part", "other", "entries"])

    return run


def _near(f1: np.ndarray, f2: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(f1[i] ^ f1[j]).astype(np.int64) + np.bitwise_count(f2[i] ^ f2[j]) <= most


def pairs_in(key: np.ndarray, f1: np.ndarray, f2: np.ndarray, most: int = MAX_DISTANCE, small: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (places i, j) of different fingerprints near each other for which the key they share is their least; each once."""
    order = np.argsort(key, kind="stable")
    key, f1, f2 = key[order], f1[order], f2[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, len(key)])

    def kept(i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for x in range(0, len(i), 50_000):
            a, b = i[x : x + 50_000], j[x : x + 50_000]
            ok = ((f1[a] != f1[b]) | (f2[a] != f2[b])) & (least_key(f1[a], f2[a], f1[b], f2[b]) == key[a])
            yield order[a[ok]], order[b[ok]]

    for s, m in zip(first[size > small].tolist(), size[size > small].tolist(), strict=True):
        step = max(1, 500_000 // m)
        for x in range(0, m, step):
            y = min(m, x + step)
            d = np.bitwise_count(f1[s + x : s + y, None] ^ f1[None, s + x : s + m]) + np.bitwise_count(f2[s + x : s + y, None] ^ f2[None, s + x : s + m])
            i, j = np.nonzero(d <= most)
            ok = i < j
            yield from kept(i[ok] + s + x, j[ok] + s + x)
    start, left = first[(size > 1) & (size <= small)], size[(size > 1) & (size <= small)]
    pos = np.repeat(start, left) + (np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left))
    end = np.repeat(start + left, left)
    for d in range(1, small):
        ok = pos + d < end
        pos, end = pos[ok], end[ok]
        if not len(pos):
            break
        near = _near(f1, f2, pos, pos + d, most)
        yield from kept(pos[near], pos[near] + d)


def _part(f1: np.ndarray, f2: np.ndarray, parts: np.ndarray | int) -> np.ndarray:
    """Which of a block's parts a fingerprint is in."""
    return (tv.mix(f1.astype(np.uint64) * np.uint64(3) ^ tv.mix(f2.astype(np.uint64))) % np.asarray(parts).astype(np.uint64)).astype(np.int64)


def _links(most: int, parts: dict[int, int]):
    """For each cell (f1, f2, links, r1, r2) of the fingerprints that have links in it; the root is one that they are connected with."""

    def found(cell: tuple[int, int, int], raw: list[bytes]) -> pa.RecordBatch | None:
        key, f1, f2 = _unpacked(np.frombuffer(b"".join(raw), _ENTRY))
        order = np.lexsort((f2, f1))
        new = np.r_[True, (np.diff(f1[order]) != 0) | (np.diff(f2[order]) != 0)]
        who = np.empty(len(order), np.int64)
        who[order], first = np.cumsum(new) - 1, order[new]
        got = [(who[i], who[j]) for i, j in pairs_in(key, f1, f2, most)]
        i, j = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 2
        if cell[1] != cell[2] and len(i):
            own = _part(f1[first], f2[first], parts[cell[0]])  # pairs within one part are those of its own cell
            i, j = i[own[i] != own[j]], j[own[i] != own[j]]
        if not len(i):
            return None
        n = np.bincount(i, minlength=len(first)) + np.bincount(j, minlength=len(first))
        root, some = forest(len(first), i, j), np.flatnonzero(n)
        at, top = first[some], first[root[some]]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (f1[at], f2[at], n[some], f1[top], f2[top])], ["f1", "f2", "links", "r1", "r2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        last = None
        for new, (block, part, other, raw) in groups(batches, ["block", "part", "other", "entries"], ["block", "part", "other"]):
            if new and held:
                if (out := found(last, held)) is not None:
                    yield out
                held = []
            last = (block, part, other)
            held.append(raw)
        if held and (out := found(last, held)) is not None:
            yield out

    return run


def _node(a: str, b: str):
    return (F.col(a).cast("decimal(20,0)") * F.lit(1 << 46).cast("decimal(20,0)") + F.col(b)).cast("decimal(30,0)")


def links(prints: DataFrame, count: int, max_distance: int = MAX_DISTANCE, block_entries: int = BLOCK_ENTRIES, cell_entries: int = CELL_ENTRIES) -> DataFrame:
    """(f1, f2, links, r1, r2) of distinct fingerprints ``prints`` (f1, f2; ``count`` of them): links and a connected root, in parts to be summed.

    Keys go by block to one task each, cell by cell. A block that holds more than ``cell_entries`` entries (a hot key) is parted by
    fingerprint, and each pair of its parts is a cell of its own. Neither number changes the result.
    """
    least = 4 * int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a fingerprint has about 50 keys
    blocks = max(least, min(1 << 20, 50 * count // block_entries))
    sizes = prints.mapInArrow(tidy(_block_sizes(blocks)), "block long, n long").groupBy("block").agg(F.sum("n").alias("n")).where(F.col("n") > cell_entries)
    # hot blocks only: each of them holds cell_entries of the entries, so they are few
    parts = {r["block"]: -(-2 * r["n"] // cell_entries) for r in sizes.collect()}
    cells = prints.mapInArrow(tidy(_cells(blocks, parts)), "block long, part long, other long, entries binary")
    met = cells.repartition("block", "part", "other").sortWithinPartitions("block", "part", "other")
    return met.mapInArrow(tidy(_links(max_distance, parts)), "f1 long, f2 long, links long, r1 long, r2 long")


def with_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, f1, f2): a hash of the text and the two halves of its fingerprint, null where it has no word."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), column_udf(_fingerprint, "struct<f1:bigint,f2:bigint>")(text).alias("fp")).select("doc_id", "th", "fp.f1", "fp.f2")


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE, block_entries: int = BLOCK_ENTRIES, cell_entries: int = CELL_ENTRIES) -> DataFrame:
    """The near-duplicate group of every document.

    Returns a row for each row of ``docs``: doc_id, th (hash of the text), f1, f2 (fingerprint halves of 46 bits),
    group_id (least doc_id of the group; the document's own where it is alone), group_size (rows), links (other fingerprints at most
    ``max_distance`` bits away that share a key with its own; copies have one fingerprint) and keep (true for
    one row of each group). Documents are in one group if a chain of links joins them.

    A null or empty text, or one without letters or digits, has no fingerprint, is alone and is kept. Repeated rows and
    equal texts are in one group; the row kept is that of the least doc_id (nulls last), then the least hash of the
    text; of wholly equal rows it is any one. An empty table gives an empty result; other columns, whatever their
    names, are not looked at.
    """
    fps = stored(with_fingerprints(docs))
    some = fps.where("f1 is not null")
    linked = stored(some.groupBy("f1", "f2").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")).alias("least"), F.count("*").alias("n")))
    found = stored(links(linked.select("f1", "f2"), linked.count(), max_distance, block_entries, cell_entries))
    comp = components(found.select(_node("f1", "f2").alias("a"), _node("r1", "r2").alias("b")))
    count = found.groupBy("f1", "f2").agg(F.sum("links").alias("links"))
    linked = linked.join(count, ["f1", "f2"], "left").withColumn("node", _node("f1", "f2")).join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    linked = stored(linked.select("f1", "f2", "least", "n", F.coalesce("links", F.lit(0)).alias("links"), "root"))
    facts = linked.groupBy("root").agg(F.min("least").alias("kept"), F.sum("n").alias("group_size"))
    group = linked.join(facts, "root").select("f1", "f2", "kept", "group_size", "links")
    one = Window.partitionBy("f1", "f2", "doc_id", "th").orderBy("f1")
    rows = some.join(group, ["f1", "f2"]).withColumn("rn", F.row_number().over(one))
    kept = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("th") == F.col("kept.th")) & (F.col("rn") == 1)
    alone = fps.where("f1 is null").select("doc_id", "th", "f1", "f2", F.col("doc_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"), F.lit(0).cast("long").alias("links"), F.lit(True).alias("keep"))
    return rows.select("doc_id", "th", "f1", "f2", F.col("kept.doc_id").alias("group_id"), "group_size", "links", kept.alias("keep")).unionByName(alone)


def deduplicate(docs: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """``docs`` without near-duplicates: of each group of ``near_duplicates`` the row marked ``keep`` stays.

    Rows whose text has no fingerprint all stay. Columns, whatever their names, come back as they were.
    """
    flags = near_duplicates(docs, max_distance).groupBy("doc_id", "th").agg(F.bool_or("keep").alias("keep"), F.bool_or(F.col("f1").isNull()).alias("alone"))
    none = F.lit(-(1 << 62))
    flags = flags.select(F.coalesce("doc_id", none).alias("k1"), F.col("th").alias("k2"), "keep", "alone")
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.col("doc_id").cast("long"), none).alias("k1"), F.xxhash64(F.col("text").cast("string")).alias("k2"))
    one = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("k2"))
    return rows.join(flags, ["k1", "k2"]).where("keep").withColumn("rn", one).where("alone or rn = 1").select("row.*")
