import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import licenses, mixing, toxicity, url_filter
from shelfspark.llm import textvec as tv

# ---- URLs


def test_lexical_features():
    x = url_filter.lexical(pa.array(["https://www.a-b.example.com/p/q1?x=1&y=2#f", None, ""]))
    named = dict(zip(url_filter.FEATURES, x[0], strict=False))
    assert (named["length"], named["host_length"], named["host_labels"], named["path_depth"], named["parameters"]) == (42, 19, 4, 2, 2)
    assert named["digits"] == 3 and named["digit_ratio"] == pytest.approx(3 / 42) and named["https"] == 1 and named["www"] == 1 and named["fragment"] == 1
    assert not x[1:].any()


def test_trees_generalise_to_unseen_urls(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abcdefghijklmnoprstu") for _ in range(n))

    def url(bad):
        if bad:
            return f"http://{word(5)}-{rng.randrange(10**6)}.{rng.choice(['xyz', 'top'])}/{rng.randrange(10**8)}?id={rng.randrange(10**6)}&r={word(3)}"
        return f"https://{word(7)}.org/{word(5)}/{word(6)}"

    rows = [(i, url(i % 3 == 0), int(i % 3 == 0)) for i in range(900)]
    d = spark.createDataFrame(rows, "page_id long, url string, bad int")
    known = d.where("page_id < 600").select("url", "bad")
    got = url_filter.score(d.withColumn("h", F.lit(1)).withColumn("suffix", F.lit(1)), known).where("page_id >= 600").collect()
    truth = {i: b for i, _, b in rows}
    assert sum(r.blocked == bool(truth[r.page_id]) for r in got) / len(got) > 0.97


def grown_naively(x, y, trees):
    """Boosting by the definition: every node tries every cut of every feature, one by one."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, k], np.arange(1, url_filter.BINS) / url_filter.BINS, method="lower")) for k in range(m)]
    b = [[int(np.searchsorted(edges[k], x[i, k], "right")) for k in range(m)] for i in range(n)]
    rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
    bias = math.log(rate / (1 - rate))
    score, out = [bias] * n, []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g, h = [y[i] - p[i] for i in range(n)], [p[i] * (1 - p[i]) for i in range(n)]
        nodes, cuts = {0: list(range(n))}, {}
        for depth in range(url_filter.DEPTH):
            for node in range(2**depth - 1, 2 ** (depth + 1) - 1):
                rows, best, at = nodes[node], 1e-6, (0, url_filter.BINS)
                gt, ht = sum(g[i] for i in rows), sum(h[i] for i in rows)
                for k in range(m):
                    for c in range(url_filter.BINS):
                        left = [i for i in rows if b[i][k] <= c]
                        if min(len(left), len(rows) - len(left)) < url_filter.LEAST_LEAF:
                            continue
                        gl, hl = sum(g[i] for i in left), sum(h[i] for i in left)
                        gain = round(gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1), 9)
                        if gain > best:
                            best, at = gain, (k, c)
                cuts[node] = at
                nodes[2 * node + 1] = [i for i in rows if b[i][at[0]] <= at[1]]
                nodes[2 * node + 2] = [i for i in rows if b[i][at[0]] > at[1]]
        values = {}
        for leaf in range(2**url_filter.DEPTH - 1, 2 ** (url_filter.DEPTH + 1) - 1):
            values[leaf] = url_filter.RATE * sum(g[i] for i in nodes[leaf]) / (sum(h[i] for i in nodes[leaf]) + 1)
            for i in nodes[leaf]:
                score[i] += values[leaf]
        out.append((cuts, values))
    return out, [1 / (1 + math.exp(-s)) for s in score]


def test_trees_against_naive_boosting():
    rng = np.random.default_rng(12)
    x = np.c_[rng.integers(0, 9, 80), rng.normal(size=80).round(1), rng.integers(0, 2, 80)].astype(float)
    y = ((x[:, 0] > 4) ^ (x[:, 1] > 0.3)).astype(float)
    want, scores = grown_naively(x, y, 3)
    forest = url_filter.grow(x, y, 3)
    for t, (cuts, values) in enumerate(want):
        assert [(int(f), int(c)) for f, c in zip(forest.feature[t], forest.cut[t], strict=True)] == [cuts[k] for k in range(2**url_filter.DEPTH - 1)]
        assert np.allclose(forest.value[t], [values[k] for k in range(2**url_filter.DEPTH - 1, 2 ** (url_filter.DEPTH + 1) - 1)])
    assert np.allclose(forest.predict(x), scores)


def test_ties_and_one_label():
    x = np.c_[np.arange(40) % 4, np.arange(40) % 4].astype(float)  # two features alike: the first is taken
    forest = url_filter.grow(x, (np.arange(40) % 4 > 1).astype(float), 2)
    assert not forest.feature.any()
    assert np.allclose(url_filter.grow(x, np.ones(40), 3).predict(x), 1, atol=1e-3)
    assert len(url_filter.grow(np.zeros((0, 2)), np.zeros(0), 2).predict(np.zeros((0, 2)))) == 0


def test_columns_that_clash(spark):
    d = spark.createDataFrame([(1, "http://a.org/x"), (2, "http://bets.b.org/")], "page_id long, url string")
    odd = d.withColumn("s_pages", F.lit("x")).withColumn("h", F.lit(1)).withColumn("suffix", F.lit(2)).withColumn("bad", F.lit("z"))
    rows = lambda x: sorted((r.page_id, r.score) for r in x.collect())
    assert rows(url_filter.score(odd)) == rows(url_filter.score(d))


def test_url_edge_cases(spark):
    d = spark.createDataFrame([(1, None), (2, ""), (None, "http://x.y/" + "a" * 50_000), (3, "http://casino-1.com/"), (3, "http://casino-1.com/")], "page_id long, url string")
    got = url_filter.score(d).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert url_filter.score(d.limit(0)).count() == 0


# ---- toxicity


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(11)
    clean = ["".join(rng.choice("aeioubdlmnrst") for _ in range(6)) for _ in range(300)]
    nasty = ["".join(rng.choice("xzqkv") for _ in range(5)) for _ in range(12)]
    rows, labels = [], []
    for i in range(700):
        t = [rng.choice(clean) for _ in range(rng.randrange(10, 60))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randrange(2, 5)):
                t[rng.randrange(len(t))] = rng.choice(nasty)
        rows.append((i, " ".join(t)))
        labels.append((i, int(toxic)))
    rows += [(700, None), (701, ""), (702, "..."), (703, " ".join(clean) * 40), (3, rows[3][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("r")).withColumn("toxic", F.lit("clash"))
    lab = spark.createDataFrame([*labels[:400], (5, None), (None, 1)], "doc_id long, toxic int")
    return rows, dict(labels), d, lab


def test_held_out_accuracy(corpus):
    rows, truth, d, lab = corpus
    got = {r.doc_id: r for r in toxicity.score(d, toxicity.fit(d, lab)).collect()}
    held = [i for i in range(400, 700)]
    assert sum(got[i].toxic == bool(truth[i]) for i in held) / len(held) > 0.97
    assert not got[700].toxic and not got[701].toxic and not got[702].toxic and not got[703].toxic and got[700].evidence == []
    left = toxicity.remove_toxic(d, toxicity.fit(d, lab))
    assert left.columns == d.columns
    assert left.count() == len(rows) - sum(got[i].toxic for i, _ in rows)


def test_block_max_search_is_exact(corpus):
    rows, _, d, lab = corpus
    ix = toxicity.fit(d, lab)
    dense = np.zeros((len(ix.ids), len(ix.vocab)))
    blocks = ix.most.shape[1]
    for cell in range(len(ix.ptr) - 1):
        dense[ix.docs[ix.ptr[cell] : ix.ptr[cell + 1]], cell // blocks] = ix.weights[ix.ptr[cell] : ix.ptr[cell + 1]]
    seen = 0
    for i, t in rows:
        buf = np.frombuffer((t or "").encode(), np.uint8)
        _, term, count = toxicity.vocabulary_counts(buf, np.array([0, len(buf)]), ix.words)
        if len(term):
            seen += 1
            best, sim = ix.nearest(term, count, i)
            q = np.zeros(len(ix.vocab))
            q[term] = ix.query(term, count)
            s = np.round(dense @ q, 9)
            s[ix.ids == i] = 0
            order = [k for k in np.lexsort((ix.ids, -s)) if s[k] > 0][: toxicity.NEIGHBOURS]
            assert best.tolist() == order and np.allclose(sim, s[order])
    assert seen > 100


def test_scores_follow_from_the_raw_texts(corpus):
    """Weights, cosines, ties and votes anew from the texts alone, with no part of the index."""
    rows, _, d, lab = corpus
    words = lambda t: Counter(re.findall("[a-z0-9]+", (t or "").lower()))
    counts = [(i, words(t)) for i, t in rows]
    df = Counter(w for _, c in counts for w in c)
    truth = {i: y for i, y in ((r.doc_id, r.toxic) for r in lab.collect()) if i is not None and y is not None}
    text = {i: c for i, c in counts if i in truth}
    n, pos = len(text), sum(truth.values())
    m, a = Counter(w for c in text.values() for w in c), Counter(w for i, c in text.items() if truth[i] for w in c)
    part = lambda x, e: x * math.log(x / e) if x > 0 else 0.0

    def told(w):
        base = pos / n
        return max(0.0, 2 * (part(a[w], m[w] * base) + part(m[w] - a[w], m[w] * (1 - base)) + part(pos - a[w], (n - m[w]) * base) + part(n - m[w] - pos + a[w], (n - m[w]) * (1 - base))))

    weight = {w: (math.log((1 + len(rows)) / (1 + df[w])) + 1) * (1 + told(w)) for w in m}

    def vector(c):
        v = {w: (1 + math.log(k)) * weight[w] for w, k in c.items() if w in weight}
        z = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / z for w, x in v.items()}

    examples = {i: vector(c) for i, c in text.items()}
    got = {}
    for r in toxicity.score(d, toxicity.fit(d, lab)).collect():
        got.setdefault(r.doc_id, []).append([(e.doc_id, e.toxic, round(e.similarity, 5)) for e in r.evidence])
    for i, c in counts[::13]:
        v = vector(c) if any(w in weight for w in c) else {}
        near = [(-sum(x * e.get(w, 0.0) for w, x in v.items()), j) for j, e in examples.items() if j != i]
        best = [(j, truth[j], round(-s, 5)) for s, j in sorted((round(s, 6), j) for s, j in near if s < 0)[: toxicity.EVIDENCE]]
        assert all([x[1:] for x in one] == [x[1:] for x in best] or {x[0] for x in one} == {x[0] for x in best} for one in got[i])
        assert all(abs(x[2] - y[2]) < 1e-4 for one in got[i] for x, y in zip(one, best, strict=True))


def test_vocabulary_numbers():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 5000):
        h = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        v = toxicity.Vocabulary(h)
        probe = np.r_[h, h + np.uint64(1), np.array([0, (1 << 64) - 1], np.uint64)]
        want = [int(np.flatnonzero(h == x)[0]) if (h == x).any() else -1 for x in probe]
        assert v.numbers(probe).tolist() == want


def test_toxicity_without_labels(spark, corpus):
    _, _, d, lab = corpus
    got = toxicity.score(d, toxicity.fit(d, lab.limit(0)))
    assert got.where("toxic").count() == 0
    assert toxicity.score(d.limit(0), toxicity.fit(d.limit(0), lab)).count() == 0


def insulted(spark, share, n=160, words=("scum", "moron", "loser", "pathetic"), every=60):
    """Examples with this share of toxic labels, and unlabelled texts of which every second is toxic."""
    rng = random.Random(7)
    plain = ["".join(rng.choice("aeioubdlmnrst") for _ in range(6)) for _ in range(200)]

    def text(toxic):
        t = [rng.choice(plain) for _ in range(every)]
        for x in rng.sample(range(every), 3 if toxic else 0):
            t[x] = rng.choice(words)
        return " ".join(t)

    labels = [(i, int(i < share * n)) for i in range(n)]
    rows = [(i, text(y)) for i, y in labels] + [(1000 + i, text(i % 2)) for i in range(100)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.mark.parametrize("share", [10 / 160, 0.5, 0.8])
def test_toxicity_at_any_share_of_labels(spark, share):
    d, lab = insulted(spark, share)
    left = {r.doc_id for r in toxicity.remove_toxic(d, toxicity.fit(d, lab)).where("doc_id >= 1000").collect()}
    caught = sum(1000 + i not in left for i in range(1, 100, 2))
    kept = sum(1000 + i in left for i in range(0, 100, 2))
    assert caught >= 45 and kept >= 45


def test_toxicity_norm_takes_all_words(spark):
    d, lab = insulted(spark, 0.2)
    ix = toxicity.fit(d, lab)
    _, term, _ = toxicity.vocabulary_counts(np.frombuffer(b"scum", np.uint8), np.array([0, 4]), ix.words)
    assert len(term) == 1 and len(ix.vocab) == 204


# ---- licenses


def test_licenses_found_with_changes(spark):
    rng = random.Random(5)
    noise = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(n))
    rows, want = [], {}
    for i, (name, body) in enumerate(sorted(licenses.TEMPLATES.items())):
        w = body.split()
        if len(w) > 30:
            w[10] = "changed"
            del w[20]
        rows.append((i, noise(40) + " " + "\n * ".join([" ".join(w[:5]), " ".join(w[5:])]) + " " + noise(40)))
        want[i] = name
    rows += [(100, None), (101, ""), (102, noise(20_000)), (103, "license"), (0, rows[0][1])]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash"))
    got = licenses.find_licenses(d).collect()
    for i, name in want.items():
        assert any(r.license == name and r.coverage >= 0.8 for r in got if r.doc_id == i)
    text = dict(rows)
    assert all(text[r.doc_id][r.start_char : r.end_char] == r.excerpt for r in got)
    assert {r.doc_id for r in got} == set(want)
    assert licenses.find_licenses(d.limit(0)).count() == 0


def test_texts_without_any_license(spark):
    d = spark.createDataFrame([(1, "nothing of the kind here"), (2, None)], "doc_id long, text string")
    assert licenses.find_licenses(d).count() == 0


def test_licenses_repeated_back_to_back(spark):
    rows = [(i, " ".join([body] * 3)) for i, (_, body) in enumerate(sorted(licenses.TEMPLATES.items()))]
    got = licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for i, (name, body) in enumerate(sorted(licenses.TEMPLATES.items())):
        spans = sorted(r.start_char for r in got if r.doc_id == i and r.license == name)
        assert len(spans) == 3 and np.diff(spans).tolist() == [len(body) + 1] * 2, name


def test_license_with_a_long_insertion(spark):
    w = licenses.TEMPLATES["ISC"].split()
    text = " ".join(["before"] * 20 + w[: len(w) // 2] + [f"extra{i}" for i in range(10)] + w[len(w) // 2 :] + ["after"] * 20)
    got = licenses.find_licenses(spark.createDataFrame([(1, text), (2, text + " " + text)], "doc_id long, text string")).collect()
    assert [r.coverage for r in got if r.license == "ISC"] == [1.0] * 3
    assert all(r.excerpt.startswith("Permission") and r.excerpt.endswith("SOFTWARE") for r in got if r.license == "ISC")


def lcs_share(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], prev + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_against_full_lcs():
    rng = np.random.default_rng(2)
    for _ in range(60):
        t = rng.integers(0, 50, 30)
        x = np.delete(t.copy(), rng.integers(0, 30, 3))
        text = np.r_[rng.integers(100, 150, 20), x, rng.integers(100, 150, 20)]
        assert licenses.align(t, text, 20)[0] == lcs_share(t.tolist(), text.tolist())


def test_scan_against_full_alignment(spark):
    """Every template against every stretch of every text, without fingerprints, index or band."""
    rng = random.Random(21)
    some = {k: licenses.TEMPLATES[k] for k in ("MIT-notice", "CC-BY-4.0-notice", "BSD-notice", "MPL-2.0")}
    noise = lambda n: [f"w{rng.randrange(500)}" for _ in range(n)]
    tokens = lambda t: re.findall("[a-z0-9]+", t.lower())
    rows = []
    for i in range(40):
        t = noise(rng.randrange(10))
        for _ in range(rng.randrange(3)):
            w = rng.choice(sorted(some.values())).split()
            for _ in range(rng.randrange(4)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], ["other"], [w[k], "more"]])
            t += w + noise(rng.randrange(12))
        rows.append((i, " ".join(t)))
    got = {}
    for r in licenses.find_licenses(spark.createDataFrame(rows, "doc_id long, text string"), some).collect():
        got[r.doc_id, r.license] = max(got.get((r.doc_id, r.license), 0), r.matched_words)
    for i, text in rows:
        w = tokens(text)
        for name, body in some.items():
            t = tokens(body)
            best = max((lcs_share(t, w[a : a + len(t) + licenses.BAND]) for a in range(len(w))), default=0)
            grams = {tuple(t[k : k + 4]) for k in range(len(t) - 3)} & {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
            if best >= licenses.COVERAGE * len(t) and grams:  # four words in a row are sure to share a fingerprint
                assert got.get((i, name), 0) >= best - 1, (i, name)
            elif best < licenses.COVERAGE * len(t):
                assert (i, name) not in got


# ---- mixing


def test_mixing_ties_and_very_long_texts(spark):
    """Equal documents stand at one place; a text of a million words is counted whole."""
    rows = [(1, "w " * 1_000_000, "en", "src1", "c"), (1, "w " * 1_000_000, "en", "src1", "c"), (2, "a b", "en", "src1", "c"), (None, "c d e", None, None, None)]
    got = mixing.mix(docs(spark, rows), max_epochs=1).collect()
    assert sorted((r.doc_id or 0, r.take_tokens) for r in got) == [(0, 3), (1, 1_000_000), (1, 1_000_000), (2, 2)]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, have string")


def test_mix_takes_budgets_and_redistributes(spark):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randrange(1, 40), rng.choice(["en", "de", None]), rng.choice(["src1", "src12", "src17", "else", None]), "c") for i in range(300)]
    rows += [(900, None, "en", "src1", "c"), (901, "", "en", "src1", "c"), (5, rows[5][1], rows[5][2], rows[5][3], "c")]
    d = docs(spark, rows)
    total = sum(len((r[1] or "").split()) for r in rows)
    got = mixing.mix(d, budget=total).collect()
    took = sum(r.take_tokens for r in got)
    assert abs(took - total) <= 60  # whole tokens of each leaf, repeated rows together
    n = {i: len((t or "").split()) for i, t, *_ in rows}
    assert all(0 < r.take_tokens <= n[r.doc_id] and 0 <= r.epoch < mixing.MAX_EPOCHS for r in got)
    share = sum(r.take_tokens for r in got if r.domain == "web") / took
    assert share == pytest.approx(0.5 / 1.05, abs=0.02)
    assert mixing.mix(d.limit(0)).count() == 0


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("web", "en", "src1", 1000), ("web", "de", "src1", 10), ("forum", "en", "src17", 1000)]
    d = spark.createDataFrame(leaves, "domain string, lang string, source string, have long")
    got = {(r.domain, r.lang): r.budget for r in mixing.leaf_budgets(d, 700).collect()}
    assert got == {("web", "de"): 40, ("web", "en"): 460, ("forum", "en"): 200}


def test_select_gives_whole_rows(spark):
    rows = [(i, f"text number {i} here", "en", "src1", "c") for i in range(50)]
    got = mixing.select(docs(spark, rows), budget=300).collect()
    assert len(got) == 75 and {tuple(r) for r in got} == set(rows)


def test_hashes_of_words_ignore_ascii_case():
    buf = np.frombuffer("Größe GRößE x".encode(), np.uint8)
    s, e = tv.word_bounds(buf, np.array([0, len(buf)]), tv.ALNUM)
    h = tv.span_hashes(buf, s, e, fold=True)
    assert h[0] == h[1] != h[2]
