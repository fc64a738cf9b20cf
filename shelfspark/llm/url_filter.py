"""URL filter: gradient-boosted trees on lexical features, trained from labelled URLs.

Features are counted on the bytes of all URLs of a batch at once: lengths, depth, digit ratio, entropy, parameter counts,
and statistics of the host's suffix (its last two labels) that are gathered over the whole table: how many pages and
hosts it has, and the smoothed rate of bad labels, for a labelled URL without its own host. The trees are grown on
histograms of binned features; scoring walks the levels of all trees with array look-ups.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, text_buffer, tidy

#: At most so many labelled URLs (those of least hash) train the trees.
MAX_TRAINING = 50_000
TREES, DEPTH, BINS, RATE, LEAST_LEAF, RIDGE, SEED = 60, 4, 64, 0.15, 5, 1.0, 7
THRESHOLD = 0.5
#: Words in host names of which the pages count as labelled bad, where no labels are given.
BLOCKED = ("casino", "adult", "pills", "bets", "spam", "ads", "porn", "loan")
FEATURES = (
    "length", "host_length", "host_labels", "path_depth", "path_length", "query_length", "parameters", "digits", "digit_ratio", "hyphens", "host_hyphens",
    "other_signs", "upper", "entropy", "host_entropy", "vowel_ratio", "longest_host_label", "longest_run", "https", "www", "fragment", "percent_signs",
    "suffix_pages", "suffix_hosts", "suffix_bad_rate",
)


def host(url: str = "url") -> Column:
    return F.lower(F.regexp_extract(F.col(url).cast("string"), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def suffix(h: Column) -> Column:
    return F.array_join(F.slice(F.reverse(F.slice(F.reverse(F.split(h, r"\.")), 1, 2)), 1, 2), ".")


def weak_labels(pages: DataFrame) -> DataFrame:
    """Labelled URLs where none are given: (url, bad), bad if a label of the host, cut at hyphens, is a blocked word."""
    parts = F.split(host(), r"[.-]")
    return pages.where("url is not null").select("url", F.arrays_overlap(parts, F.array(*map(F.lit, BLOCKED))).cast("int").alias("bad"))


def _entropy(codes: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Entropy in bits of the values of each group."""
    key, count = np.unique(group.astype(np.int64) << 8 | codes, return_counts=True)
    g = key >> 8
    total = np.bincount(g, weights=count, minlength=n)
    p = count / total[g]
    return np.bincount(g, weights=-p * np.log2(p), minlength=n)


def lexical(urls: pa.Array) -> np.ndarray:
    """The first 22 features of every URL (0 for null and empty ones)."""
    buf, offs = text_buffer(urls)
    n = len(offs) - 1
    out = np.zeros((n, 22))
    if not len(buf):
        return out
    doc = np.repeat(np.arange(n), np.diff(offs))
    pos = np.arange(len(buf)) - offs[doc]
    size = np.diff(offs).astype(float)
    end = np.diff(offs)

    def first(mask: np.ndarray, default: np.ndarray) -> np.ndarray:
        where = default.copy()
        at = np.flatnonzero(mask)[::-1]
        where[doc[at]] = pos[at]
        return where

    slash, none = buf == 47, end.copy()
    double = slash & np.r_[False, slash[:-1]] & (pos > 0)
    h0 = np.minimum(first(double, np.full(n, -1)) + 1, end)
    frag = first(buf == 35, none)
    query = np.minimum(first((buf == 63) & (pos < frag[doc]), none), frag)
    path = np.minimum(first(slash & (pos >= h0[doc]), query), query)
    in_host = (pos >= h0[doc]) & (pos < path[doc])
    in_path, in_query = (pos >= path[doc]) & (pos < query[doc]), (pos >= query[doc]) & (pos < frag[doc])
    count = lambda m: np.bincount(doc[m], minlength=n).astype(float)
    digit, upper = (buf >= 48) & (buf <= 57), (buf >= 65) & (buf <= 90)
    low = np.where(upper, buf + 32, buf)
    letter = (low >= 97) & (low <= 122)
    vowel = np.isin(low, [97, 101, 105, 111, 117])
    host_len = (path - h0).astype(float)

    def longest(mask: np.ndarray) -> np.ndarray:
        """Longest run of the mask in each URL."""
        edge = np.flatnonzero(mask & ~np.r_[False, mask[:-1] & (doc[1:] == doc[:-1])])
        stop = np.flatnonzero(mask & ~np.r_[mask[1:] & (doc[1:] == doc[:-1]), False])
        best = np.zeros(n)
        np.maximum.at(best, doc[edge], stop - edge + 1)
        return best

    dots = count(in_host & (buf == 46))
    out[:] = np.stack([
        size, host_len, np.where(host_len > 0, dots + 1, 0), count(in_path & slash & (pos + 1 < query[doc])), (query - path).astype(float), (frag - query).astype(float),
        np.where(frag > query, count(in_query & (buf == 38)) + (frag > query + 1), 0), count(digit), count(digit) / np.maximum(size, 1), count(buf == 45), count(in_host & (buf == 45)),
        count(~letter & ~digit & ~slash & (buf != 46)), count(upper), _entropy(buf, doc, n), _entropy(buf[in_host], doc[in_host], n), count(vowel & in_host) / np.maximum(count(letter & in_host), 1),
        longest(in_host & (buf != 46)), longest(letter), count((pos == 4) & (low == 115) & (h0[doc] > 5)), count(in_host & (buf == 119) & (pos < h0[doc] + 3)) == 3, (frag < end).astype(float), count(buf == 37),
    ], axis=1)
    return out


@dataclass
class Forest:
    """Boosted trees: in level order the feature and cut of each inner node, and the leaves' values."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    bias: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, rows = self.bins(x), np.arange(len(x))
        total = np.full(len(x), self.bias)
        for f, c, v in zip(self.feature, self.cut, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[rows, f[node]] > c[node])
            total += v[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> Forest:
    """Boosting on the logistic loss with histograms of gradients; ties between splits go to the first feature and cut."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.arange(1, BINS) / BINS, method="lower")) if n else np.zeros(0) for k in range(m)]
    rate = min(max(float(y.mean()) if n else 0.0, 1e-4), 1 - 1e-4)
    inner = 2**DEPTH - 1
    forest = Forest(edges, np.zeros((trees, inner), np.int64), np.full((trees, inner), BINS), np.zeros((trees, 2**DEPTH)), float(np.log(rate / (1 - rate))))
    b = forest.bins(x)
    score = np.full(n, forest.bias)
    for t in range(trees if n else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for depth in range(DEPTH):
            base, width = 2**depth - 1, 2**depth
            cells = (node - base)[:, None] * m + np.arange(m)
            cells = cells * BINS + b
            size = width * m * BINS
            sums = [np.bincount(cells.ravel(), weights=np.repeat(w, m), minlength=size).reshape(width, m, BINS).cumsum(2) for w in (g, h, np.ones(n))]
            gl, hl, nl = sums
            gt, ht, nt = (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(nl < LEAST_LEAF) | (nt - nl < LEAST_LEAF)] = 0
            best = np.round(gain.reshape(width, -1), 9).argmax(1)
            ok = gain.reshape(width, -1)[np.arange(width), best] > 1e-6
            forest.feature[t, base : base + width] = np.where(ok, best // BINS, 0)
            forest.cut[t, base : base + width] = np.where(ok, best % BINS, BINS)
            node = 2 * node + 1 + (b[np.arange(n), forest.feature[t][node]] > forest.cut[t][node])
        leaf = node - inner
        v = np.bincount(leaf, weights=g, minlength=2**DEPTH) / (np.bincount(leaf, weights=h, minlength=2**DEPTH) + RIDGE)
        forest.value[t] = RATE * v
        score += forest.value[t][leaf]
    return forest


def suffix_facts(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """For each host (h) the facts of its suffix over all pages, written once; bad counts leave out the host itself."""
    all_pages = pages.select(host().alias("h")).where("h <> ''").groupBy("h").agg(F.count("*").alias("pages"))
    bad = labelled.select(host().alias("h"), "bad").where("h <> ''").groupBy("h").agg(F.sum("bad").alias("bad"), F.count("*").alias("lab"))
    hosts = stored(all_pages.join(bad, "h", "full_outer").withColumn("suffix", suffix(F.col("h"))).fillna(0, ["pages", "bad", "lab"]))
    by = hosts.groupBy("suffix").agg(F.sum("pages").alias("s_pages"), F.count("*").alias("s_hosts"), F.sum("bad").alias("s_bad"), F.sum("lab").alias("s_lab"))
    return stored(hosts.join(by, "suffix").select("h", "s_pages", "s_hosts", (F.col("s_bad") - F.col("bad")).alias("s_bad"), (F.col("s_lab") - F.col("lab")).alias("s_lab")))


def _with_suffix(d: DataFrame, facts: DataFrame) -> DataFrame:
    """``d`` (with url) and the facts of its host's suffix; 0 where there is no host."""
    return d.withColumn("h", host()).join(facts, "h", "left").fillna(0, ["s_pages", "s_hosts", "s_bad", "s_lab"])


def _features(url: pa.Array, pages, hosts, bad, lab) -> np.ndarray:
    num = lambda c: c.to_numpy(zero_copy_only=False).astype(float)
    rate = (num(bad) + 1) / (num(lab) + 10)
    return np.c_[lexical(url), np.log1p(num(pages)), np.log1p(num(hosts)), rate]


def train(facts: DataFrame, labelled: DataFrame, max_training: int = MAX_TRAINING) -> Forest:
    """Trees from the labelled URLs: (url, bad), with ``suffix_facts``. Null URLs or labels are left out, repeated URLs count once (bad if any is)."""
    some = labelled.where("url is not null and bad is not null").groupBy("url").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    some = some.orderBy(F.xxhash64("url"), "url").limit(max_training)
    t = _with_suffix(some, facts).select("url", "bad", "s_pages", "s_hosts", "s_bad", "s_lab").toArrow().sort_by("url")
    cols = [t.column(c).combine_chunks() for c in ("url", "s_pages", "s_hosts", "s_bad", "s_lab")]
    return grow(_features(*cols), t.column("bad").to_numpy().astype(float))


def score(pages: DataFrame, labelled: DataFrame | None = None, forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """A row for each page: page_id, url, score (probability of being bad), blocked (score at least ``threshold``).

    ``labelled`` has url and bad; without it pages are labelled by the blocked words of their hosts. Null and empty URLs
    are scored by the features of an empty one; repeated rows are scored alike; without labels of both kinds all scores
    are near the labels' rate. Ties between equal gains go to the first feature and cut. URLs of any length are scored whole. An empty table gives none; other columns are ignored.
    """
    labelled = weak_labels(pages) if labelled is None else labelled.select(F.col("url").cast("string").alias("url"), F.col("bad").cast("int").alias("bad"))
    facts = suffix_facts(pages, labelled)
    forest = forest or train(facts, labelled)
    blob = pages.sparkSession.sparkContext.broadcast(pickle.dumps(forest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = pickle.loads(blob.value)  # noqa: S301
        for b in batches:
            x = _features(*(b.column(c) for c in ("url", "s_pages", "s_hosts", "s_bad", "s_lab")))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(np.round(trees.predict(x), 9))], ["page_id", "url", "score"])

    d = _with_suffix(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")), facts)
    out = d.select("page_id", "url", "s_pages", "s_hosts", "s_bad", "s_lab").mapInArrow(tidy(run), "page_id long, url string, score double")
    return out.withColumn("blocked", F.col("score") >= threshold)
