"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

The examples are a bounded sample of the labelled documents; all their words are indexed. A word weighs its TF-IDF (inverse
document frequencies are counted over all documents) times one plus the log-likelihood ratio of its standing in toxic and
in clean examples: words that tell count for more, but none is left out, whatever the share of toxic labels. The examples'
vectors form an inverted index, and for words of many examples a matrix in blocks of examples, with each word's largest
weight in the block. A query takes the postings of its other words in full and bounds what the words of the matrix can add,
block by block and by the norms; examples of highest bound are scored first and then only those whose bound can still reach
the k-th best; where that leaves many, a matrix product in single precision narrows them before they are scored. The neighbours are exactly those of the full comparison. Votes are weighted by similarity, and turned into
probabilities by isotonic regression on leave-one-out votes of the examples.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType

from . import textvec as tv
from .common import doc_chunks, give_back, stored, text_buffer, tidy

#: At most so many labelled documents (those of least hash of their id) are used as examples.
MAX_EXAMPLES = 20_000
NEIGHBOURS, EVIDENCE, BLOCK, BATCH = 15, 5, 32, 64
#: The words of most examples (over 1 / COMMON_SHARE of them, at most COMMON) are kept as a matrix; speed only.
COMMON, COMMON_SHARE = 512, 50
PRIOR_WEIGHT = 0.25
THRESHOLD = 0.5


def _terms(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (runs of letters and digits, ASCII case folded) and the text it is in."""
    s, e = tv.word_bounds(buf, offs, tv.ALNUM)
    return tv.span_hashes(buf, s, e, fold=True), np.searchsorted(offs, s, "right") - 1


class Vocabulary:
    """Numbers of word hashes in a sorted list, looked up from where their leading bits begin; hashes are evenly spread."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.shift = np.uint64(64 - max(1, len(hashes).bit_length() + 1))
        lead = (hashes >> self.shift).astype(np.int64)
        self.first = np.searchsorted(lead, np.arange(1 << (64 - int(self.shift)))).astype(np.int32)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where there is none."""
        if not len(self.hashes) or not len(h):
            return np.full(len(h), -1, np.int32)
        at, end = self.first[(h >> self.shift).astype(np.int64)], len(self.hashes) - 1
        there = self.hashes[np.minimum(at, end)]
        low = np.flatnonzero((there < h) & (at < end))
        while len(low):
            at[low] += 1
            there[low] = self.hashes[at[low]]
            low = low[(there[low] < h[low]) & (at[low] < end)]
        return np.where(there == h, np.minimum(at, end), -1)


def vocabulary_counts(buf: np.ndarray, offs: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term number, count), in order, of the words that ``vocab`` has."""
    h, doc = _terms(buf, offs)
    at = vocab.numbers(h)
    ok = at >= 0
    key = np.sort(doc[ok].astype(np.int64) << 32 | at[ok])
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[first] >> 32, key[first] & 0xFFFFFFFF, np.diff(np.r_[first, len(key)])


#: An example that has a word, and the word's weight in it.
_POSTING = np.dtype([("doc", "<i4"), ("weight", "<f4")])


@dataclass
class Index:
    """Inverted index over the examples, common words as a matrix with block maxima; ids and labels by example number."""

    vocab: np.ndarray
    idf: np.ndarray  # inverse document frequency times the weight of the word's evidence
    ids: np.ndarray
    labels: np.ndarray
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))  # postings of each term
    postings: np.ndarray = field(default_factory=lambda: np.zeros(0, _POSTING))
    base: float = 0.0
    alone: float = 0.0
    steps: np.ndarray = field(default_factory=lambda: np.zeros(0))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def build(cls, vocab, idf, ids, labels, doc, term, count, base) -> Index:
        w = (1 + np.log(count)) * idf[term]
        norm = np.sqrt(np.bincount(doc, weights=w * w, minlength=len(ids)))
        w = (w / norm[doc]).astype(np.float32)
        # examples of the same heaviest term stand side by side, so that blocks differ in their largest weights
        top = np.zeros(len(ids), np.float32)
        np.maximum.at(top, doc, w)
        heavy, at = np.full(len(ids), -1), np.flatnonzero(w == top[doc])
        np.maximum.at(heavy, doc[at], term[at])
        rank = np.empty(len(ids), np.int64)
        rank[np.lexsort((ids, heavy))] = np.arange(len(ids))
        self = cls(vocab, idf, ids[np.argsort(rank)], labels[np.argsort(rank)], base=base)
        doc = rank[doc].astype(np.int32)
        order = np.lexsort((doc, term)).astype(np.int32)
        self.postings = np.empty(len(order), _POSTING)
        self.postings["doc"], self.postings["weight"] = doc[order], w[order]
        self.starts = np.r_[0, np.cumsum(np.bincount(term, minlength=len(vocab)))]
        return self

    @property
    def docs(self) -> np.ndarray:
        return self.postings["doc"]

    @property
    def weights(self) -> np.ndarray:
        return self.postings["weight"]

    @property
    def blocks(self) -> int:
        return -(-len(self.ids) // BLOCK)

    @property
    def ptr(self) -> np.ndarray:
        """Where the postings of each (term, block) begin; to inspect small indexes."""
        term = np.repeat(np.arange(len(self.vocab)), np.diff(self.starts))
        return np.searchsorted(term * self.blocks + self.docs // BLOCK, np.arange(len(self.vocab) * self.blocks + 1))

    @property
    def most(self) -> np.ndarray:
        """The largest weight of each (term, block); to inspect small indexes."""
        out = np.zeros((len(self.vocab), self.blocks))
        np.maximum.at(out, (np.repeat(np.arange(len(self.vocab)), np.diff(self.starts)), self.docs // BLOCK), self.weights)
        return out

    def _matrix(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(column of each term or -1, weights by example, largest by block, largest norm by block) of the common words."""
        if not hasattr(self, "_common"):
            n = np.diff(self.starts)
            terms = np.argsort(-n, kind="stable")[:COMMON]
            terms = terms[n[terms] * COMMON_SHARE > len(self.ids)]
            column, rows = np.full(len(self.vocab), -1, np.int32), np.zeros((self.blocks * BLOCK, len(terms)), np.float32)
            column[terms] = np.arange(len(terms))
            for c, t in enumerate(terms.tolist()):
                own = slice(self.starts[t], self.starts[t + 1])
                rows[self.docs[own], c] = self.weights[own]
            most = rows.reshape(self.blocks, BLOCK, len(terms)).max(1)
            norm = np.sqrt(np.einsum("ij,ij->i", rows, rows, dtype=np.float64)).reshape(self.blocks, BLOCK).max(1)
            self._common = (column, rows, most, norm)
        return self._common

    @property
    def words(self) -> Vocabulary:
        if not hasattr(self, "_words"):
            self._words = Vocabulary(self.vocab)
        return self._words

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_common", "_words")}

    def query(self, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        w = (1 + np.log(count)) * self.idf[term]
        return w / np.sqrt((w * w).sum())

    def nearest(self, term: np.ndarray, count: np.ndarray, own: int | None = None, k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of highest cosine over 0 and their cosines; ties by the lower id; ``own`` id left out."""
        return self.nearest_many([(term, count, own)], k)[0]

    def _postings(self, term: np.ndarray, w: np.ndarray, size: int) -> np.ndarray:
        """What these terms add to each example, from their postings."""
        a, b = self.starts[term], self.starts[term + 1]
        cuts = list(zip(a.tolist(), b.tolist(), strict=True))
        if not cuts:
            return np.zeros(size)
        raw = self.postings.view(np.int64)  # copied as whole words, which is faster than field by field
        some = np.concatenate([raw[i:j] for i, j in cuts]).view(_POSTING)
        return np.bincount(some["doc"], weights=some["weight"] * np.repeat(w, b - a), minlength=size)

    def nearest_many(self, queries: list, k: int = NEIGHBOURS) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of each (term, count, own). Queries that the bounds leave many blocks of share a matrix product."""
        column, rows, most, norm = self._matrix()
        size, out = len(rows), [None] * len(queries)
        some: list = []
        for at, (term, count, own) in enumerate(queries):
            w = self.query(term, count)
            col = column[term]
            rare, common = col < 0, col >= 0
            score = self._postings(term[rare], w[rare], size)
            mine = np.flatnonzero(self.ids == own) if own is not None else np.zeros(0, np.int64)
            if common.any():
                some.append((at, score, col[common], w[common], mine))
            else:
                score[mine] = 0
                hit = np.flatnonzero(score > 0)
                out[at] = self._ranked(hit, score[hit], k)
        if not some:
            return out
        full = np.zeros((len(some), rows.shape[1]), np.float32)
        for r, (_, _, col, w, _) in enumerate(some):
            full[r, col] = w
        # what the common words can add in each block: the sum of their largest weights there, or by the norms
        may_add = np.minimum(full @ most.T, np.sqrt((full * full).sum(1))[:, None] * norm)
        wait = []
        for r, (at, score, col, w, mine) in enumerate(some):
            score[mine] = -4.0  # below any bound
            bound = score.reshape(-1, BLOCK).max(1) + may_add[r]
            first = np.argpartition(-bound, 3)[:4] if len(bound) > 4 else np.arange(len(bound))
            near = (first[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            sure = score[near] + rows[near] @ full[r]
            # single precision errs by far less than the slack
            kth = np.partition(sure, -k)[-k] - 1e-4 if len(sure) >= k else 0.0
            left = np.flatnonzero(bound >= max(kth - 1e-4, 0.0))
            if len(left) * 8 > len(bound):
                wait.append((r, kth))
                continue
            near = (left[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            out[at] = self._finish(near, score[near] + rows[near] @ full[r], score, col, w, kth, k)
        if wait:
            about = full[[r for r, _ in wait]] @ rows.T
            for c, (r, kth) in enumerate(wait):
                at, score, col, w, _ = some[r]
                about[c] += score
                near = np.flatnonzero(about[c] >= max(kth, 0.0))
                out[at] = self._finish(near, about[c][near], score, col, w, kth, k)
        return out

    def _finish(self, near: np.ndarray, about: np.ndarray, score: np.ndarray, col: np.ndarray, w: np.ndarray, kth: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Exact cosines of those of ``near`` whose approximate one can be among the k best."""
        if len(near) > k:
            kth = max(kth, float(np.partition(about, -k)[-k]) - 2e-4)
        near = near[(about >= kth) & (about > -1) & (near < len(self.ids))]
        rows = self._common[1]
        exact = np.concatenate([np.zeros(0), *(score[x] + rows[np.ix_(x, col)].astype(np.float64) @ w for x in (near[i : i + 2048] for i in range(0, len(near), 2048)))])
        return self._ranked(near, exact, k)

    def _ranked(self, hit: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        value = np.round(score, 9)
        hit, value = hit[value > 0], value[value > 0]
        order = np.lexsort((self.ids[hit], -value))[:k]
        return hit[order], value[order]

    def vote(self, best: np.ndarray, sim: np.ndarray) -> float:
        w = sim * sim
        return float(((w * self.labels[best]).sum() + PRIOR_WEIGHT * self.base) / (w.sum() + PRIOR_WEIGHT))

    def calibrate(self, votes: np.ndarray, labels: np.ndarray) -> None:
        """Isotonic regression (pool adjacent violators) of labels on votes, with one toxic and one clean case of weight 0.5 each."""
        order = np.argsort(votes, kind="stable")
        level: list[list[float]] = []
        for v, y in zip(votes[order].tolist(), labels[order].tolist(), strict=True):
            level.append([y, 1.0, v])
            while len(level) > 1 and level[-2][0] / level[-2][1] >= level[-1][0] / level[-1][1]:
                y2, n2, _ = level.pop()
                level[-1][0] += y2
                level[-1][1] += n2
        self.steps = np.array([x[2] for x in level])
        self.values = np.array([(x[0] + 0.5 * self.base) / (x[1] + 0.5) for x in level])

    def probability(self, vote: float) -> float:
        if not len(self.steps):
            return vote
        return float(self.values[max(0, int(np.searchsorted(self.steps, vote, "right")) - 1)])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each example's words in order, hashes and counts as bytes."""
    for b in batches:
        buf, offs = text_buffer(b.column("text"))
        ids, tox = b.column("doc_id"), b.column("toxic")
        for i, j in doc_chunks(offs):
            h, doc = _terms(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, np.int64)
            n = np.diff(np.r_[first, len(h)]).astype(np.int32)
            ptr = np.searchsorted(doc[first], np.arange(j - i + 1))
            cut = lambda x, p=ptr: pa.array([x[p[k] : p[k + 1]].tobytes() for k in range(len(p) - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([ids[i:j], tox[i:j], cut(h[first]), cut(n)], ["doc_id", "toxic", "terms", "counts"])


def _words_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of a task's examples."""
    seen = np.zeros(0, np.uint64)
    for b in batches:
        seen = np.union1d(seen, text_buffer(b.column("terms"))[0].view(np.uint64))
    yield pa.RecordBatch.from_arrays([pa.array(seen.view(np.int64))], ["h"])


def _evidence(m: np.ndarray, a: np.ndarray, n: int, pos: int) -> np.ndarray:
    """Log-likelihood ratio of words that stand in m examples, a of them toxic, of n examples with ``pos`` toxic ones."""
    base = pos / n
    part = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1) / np.maximum(e, 1e-12)), 0.0)
    return np.maximum(0, 2 * (part(a, m * base) + part(m - a, m * (1 - base)) + part(pos - a, (n - m) * base) + part(n - m - pos + a, (n - m) * (1 - base))))


def _frequencies(text: DataFrame, vocab: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many texts each word of ``vocab`` stands, and the number of texts. Counts travel in slices of the vocabulary."""
    cut = np.linspace(0, len(vocab), 17).astype(int)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, seen, words = np.zeros(len(vocab), np.int64), 0, Vocabulary(vocab)
        for b in batches:
            buf, offs = text_buffer(b.column("text"))
            seen += b.num_rows
            for i, j in doc_chunks(offs):
                df += np.bincount(vocabulary_counts(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], words)[1], minlength=len(vocab))
        if seen:
            raw = [df[x:y].astype(np.int32).tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(16)), pa.array([seen] * 16), pa.array(raw, pa.binary())], ["slice", "seen", "df"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: dict[int, list] = {}
        for b in batches:
            for k, seen, raw in zip(*(b.column(c).to_pylist() for c in ("slice", "seen", "df")), strict=True):
                x = np.frombuffer(raw, np.int32).astype(np.int64)
                done[k] = [done[k][0] + seen, done[k][1] + x] if k in done else [seen, x]
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(done)), pa.array([x[0] for x in done.values()]), pa.array([x[1].tobytes() for x in done.values()], pa.binary())], ["slice", "seen", "df"])

    kind = "slice long, seen long, df binary"
    df, seen = np.zeros(len(vocab), np.int64), 0
    for k, n, raw in text.select("text").mapInArrow(tidy(count), kind).repartition(4, "slice").mapInArrow(tidy(add), kind).collect():
        df[cut[k] : cut[k + 1]], seen = np.frombuffer(raw, np.int64), n
    return df, seen


def fit(docs: DataFrame, labels: DataFrame, max_examples: int = MAX_EXAMPLES) -> Index:
    """The index of labelled examples, calibrated.

    Labels with a null id or null ``toxic`` are left out; of several for one id the highest counts. Examples are the
    ``max_examples`` labelled ids of least hash. Without labels every score is 0; if all examples have one label, every
    score is that.
    """
    some = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most max_examples pairs of numbers: its size is bounded by the parameter
    picked = text.join(F.broadcast(some), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    rows = stored(picked.select("doc_id", "toxic", "text").mapInArrow(tidy(_packed), "doc_id long, toxic int, terms binary, counts binary"))
    # words come as numbers in a vocabulary that is gathered first, and example by example: at most max_examples rows, never all at once
    facts = rows.select("doc_id", "toxic", F.octet_length("terms").alias("bytes")).toArrow().sort_by("doc_id")
    ids, labelled = facts.column("doc_id").to_numpy(), (facts.column("toxic").to_numpy() > 0).astype(float)
    words = facts.column("bytes").to_numpy().astype(np.int64) // 8
    n, pos = len(ids), int(labelled.sum())
    base = pos / n if n else 0.0
    if not words.sum():
        return Index(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), base=base, alone=base)
    vocab = np.sort(rows.mapInArrow(tidy(_words_once), "h long").distinct().toArrow().column("h").to_numpy().view(np.uint64))
    begin = np.cumsum(words) - words
    term, count = np.zeros(int(words.sum()), np.int32), np.zeros(int(words.sum()), np.int32)
    for r in rows.select("doc_id", "terms", "counts").toLocalIterator():
        at = int(begin[np.searchsorted(ids, r.doc_id)])
        h = np.frombuffer(r.terms, np.uint64)
        term[at : at + len(h)], count[at : at + len(h)] = np.searchsorted(vocab, h), np.frombuffer(r.counts, np.int32)
    doc = np.repeat(np.arange(n, dtype=np.int32), words)
    m, a = np.bincount(term).astype(float), np.bincount(term, weights=labelled[doc])
    df, seen = _frequencies(text, vocab)
    idf = (np.log((1 + seen) / (1 + df)) + 1) * (1 + _evidence(m, a, n, pos))
    index = Index.build(vocab, idf, ids, labelled, doc, term, count, base)
    blob = docs.sparkSession.sparkContext.broadcast(index)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = _loaded(blob)
        for b in batches:
            out = []
            each = [x for x in zip(*(b.column(c).to_pylist() for c in ("doc_id", "toxic", "terms", "counts")), strict=True) if x[2]]
            for x in range(0, len(each), BATCH):
                part = each[x : x + BATCH]
                found = ix.nearest_many([(np.searchsorted(ix.vocab, np.frombuffer(h, np.uint64)), np.frombuffer(c, np.int32), own) for own, _, h, c in part])
                out += [(own, ix.vote(best, sim), float(tox > 0)) for (own, tox, _, _), (best, sim) in zip(part, found, strict=True) if len(best)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["doc_id", "vote", "toxic"])
        del ix
        give_back()

    seen_votes = rows.repartition(docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(votes, "doc_id long, vote double, toxic double").toPandas().sort_values("doc_id")
    blob.unpersist()
    index.calibrate(seen_votes.vote.to_numpy(), seen_votes.toxic.to_numpy())
    index.alone = float((labelled[words == 0].sum() + base) / ((words == 0).sum() + 1))
    return index


def _loaded(blob: Broadcast) -> Index:
    """The index of a broadcast; it isn't kept, as workers live on between tasks."""
    ix = blob.value
    blob.__dict__.pop("_value", None)
    return ix


_SCORED = "struct<score:double,terms:int,evidence:array<struct<doc_id:bigint,toxic:int,similarity:double>>>"


def score(docs: DataFrame, index: Index, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each row of ``docs``: doc_id, score (probability of being toxic), terms, toxic, evidence.

    ``terms`` is the number of words of the examples that the text has, ``evidence`` its nearest examples with label and cosine
    (its own example is left out by id). A null, empty or wordless text, and any without a word of the examples, gets the
    toxic rate of the examples without words (drawn to that of all) and no evidence. Repeated rows are scored alike; other columns are ignored.
    """
    return with_scores(docs, index).select("doc_id", "s.score", "s.terms", (F.col("s.score") >= threshold).alias("toxic"), "s.evidence")


def with_scores(docs: DataFrame, index: Index) -> DataFrame:
    """The columns of ``docs`` packed as ``row``, its doc_id, and the struct ``s`` of the score."""
    shared: SparkSession = docs.sparkSession
    blob = shared.sparkContext.broadcast(index)

    def judged(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        ix = _loaded(blob)
        for ids, text in batches:
            yield judge(ix, ids, text)
        del ix
        give_back()

    def judge(ix: Index, ids: pa.Array, text: pa.Array) -> pa.Array:
        buf, offs = text_buffer(text)
        own = ids.to_pylist()
        scores, terms = np.full(len(own), ix.alone), np.zeros(len(own), np.int32)
        ends, e_id, e_tox, e_sim = np.zeros(len(own), np.int64), [], [], []
        for i, j in doc_chunks(offs):
            doc, term, count = vocabulary_counts(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], ix.words)
            ptr = np.searchsorted(doc, np.arange(j - i + 1))
            terms[i:j] = np.diff(ptr)
            some = np.flatnonzero(terms[i:j]).tolist()
            for x in range(0, len(some), BATCH):
                part = some[x : x + BATCH]
                for k, (best, sim) in zip(part, ix.nearest_many([(term[ptr[k] : ptr[k + 1]], count[ptr[k] : ptr[k + 1]], own[i + k]) for k in part]), strict=True):
                    if len(best):
                        scores[i + k] = ix.probability(ix.vote(best, sim))
                        best, sim = best[:EVIDENCE], sim[:EVIDENCE]
                        ends[i + k] = len(best)
                        e_id.append(ix.ids[best])
                        e_tox.append(ix.labels[best].astype(np.int32))
                        e_sim.append(sim)
        cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
        each = pa.StructArray.from_arrays([cat(e_id, pa.int64()), cat(e_tox, pa.int32()), cat(e_sim, pa.float64())], ["doc_id", "toxic", "similarity"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(ends)].astype(np.int32)), each)
        return pa.StructArray.from_arrays([pa.array(scores), pa.array(terms), lists], ["score", "terms", "evidence"])

    run = F.arrow_udf(judged, _SCORED, functionType=ArrowUDFType.SCALAR_ITER)
    key = F.col("doc_id").cast("long")
    return docs.select(F.struct("*").alias("row"), key.alias("doc_id"), run(key, F.col("text").cast("string")).alias("s"))


def remove_toxic(docs: DataFrame, index: Index, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold, columns as they came."""
    return with_scores(docs, index).where(F.col("s.score") < threshold).select("row.*")
