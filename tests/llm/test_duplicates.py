import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfspark.llm import simhash, suffix_dedup
from shelfspark.llm import textvec as tv

COLS = "doc_id long, text string, row string, block string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))


# ---- SimHash


def test_golay_code_decodes_up_to_three_errors():
    parity, patterns, count = simhash.golay()
    rng = np.random.default_rng(1)
    msg = rng.integers(0, 4096, 2000)
    word = msg << 11 | parity[msg]
    for errors in range(4):
        noisy = word.copy()
        for k in range(len(noisy)):
            for b in rng.choice(23, errors, replace=False):
                noisy[k] ^= 1 << int(b)
        cand, n = simhash.codewords(noisy)
        assert all(m in c[:k] for m, c, k in zip(msg, cand, n, strict=True))


def brute_fingerprint(text):
    h = sorted({int(x) >> 16 for x in _hashes(text)})
    if not h:
        return None
    a, b = tv.mix(np.array(h, np.uint64)), tv.mix(np.array(h, np.uint64) ^ np.uint64(0xA5A5A5A55A5A5A5A))
    raw = np.concatenate([a.view(np.uint8).reshape(-1, 8), b.view(np.uint8).reshape(-1, 8)], axis=1)
    bits = np.unpackbits(raw, axis=1, bitorder="little")[:, :92]
    return tuple((bits.sum(0) * 2 > len(h)).astype(int))


def _hashes(text):
    buf = np.frombuffer((text or "").encode(), np.uint8)
    s, e = tv.word_bounds(buf, np.array([0, len(buf)]), tv.ALNUM)
    return tv.span_hashes(buf, s, e, fold=True)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    base = [words(rng, rng.randrange(60, 200)) for _ in range(60)]
    texts = list(base)
    for t in base[:30]:
        for _ in range(3):
            w = t.split()
            for _ in range(max(1, len(w) // 40)):
                w[rng.randrange(len(w))] = words(rng, 1)
            texts.append(" ".join(w))
    texts += [base[0], base[0].upper(), None, "", "...", None, "word"]
    rng.shuffle(texts)
    return texts


def test_fingerprints_by_definition(corpus):
    raw = [(t or "").encode() for t in corpus]
    buf, offs = np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])]
    f1, f2, n = simhash.fingerprints(buf, offs)
    for t, a, b, k in zip(corpus, f1.tolist(), f2.tolist(), n.tolist(), strict=True):
        want = brute_fingerprint(t)
        assert (k == 0) if want is None else tuple(int(c) for c in f"{a:046b}{b:046b}") == want


def groups_by_brute_force(texts, most):
    fp = [brute_fingerprint(t) for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if fp[i] and fp[j] and sum(x != y for x, y in zip(fp[i], fp[j], strict=True)) <= most:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_groups_against_all_pairs(spark, corpus):
    d = spark.createDataFrame([(i, t, "r", "b") for i, t in enumerate(corpus)], COLS)
    got = {r.doc_id: r.group_id for r in simhash.near_duplicates(d).collect()}
    want = groups_by_brute_force(corpus, simhash.MAX_DISTANCE)
    pairs = {(i, j) for i in range(len(corpus)) for j in range(i) if want[i] == want[j]}
    found = {(i, j) for i in range(len(corpus)) for j in range(i) if got[i] == got[j]}
    assert found <= pairs
    assert len(found) >= 0.95 * len(pairs)
    exact = {r.doc_id: r.group_id for r in simhash.near_duplicates(d, 8).collect()}
    assert [exact[i] for i in range(len(corpus))] == groups_by_brute_force(corpus, 8)


def fps_of(texts):
    raw = [(t or "").encode() for t in texts]
    f1, f2, n = simhash.fingerprints(np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(x) for x in raw])])
    return f1, f2, n


def links_by_brute_force(texts, most):
    """For each text the other fingerprints near it that share one of its keys."""
    f1, f2, n = fps_of(texts)
    who, key = simhash.keys_of(f1, f2)
    keys = [set(key[who == i].tolist()) for i in range(len(texts))]
    near = [
        {(int(f1[j]), int(f2[j])) for j in range(len(texts)) if n[j] and (f1[i], f2[i]) != (f1[j], f2[j]) and keys[i] & keys[j] and int(f1[i] ^ f1[j]).bit_count() + int(f2[i] ^ f2[j]).bit_count() <= most}
        if n[i] else set() for i in range(len(texts))
    ]
    return [len(x) for x in near]


@pytest.mark.parametrize(("block_entries", "cell_entries"), [(250_000, 1_000_000), (200, 60)])
def test_links_are_counted_once(spark, corpus, block_entries, cell_entries):
    """Also where blocks are parted into cells."""
    d = spark.createDataFrame([(i, t, "r", "b") for i, t in enumerate(corpus)], COLS)
    got = simhash.near_duplicates(d, block_entries=block_entries, cell_entries=cell_entries).collect()
    want, whole = links_by_brute_force(corpus, simhash.MAX_DISTANCE), {r.doc_id: r.group_id for r in simhash.near_duplicates(d).collect()}
    assert max(want) >= 3
    assert [r.links for r in sorted(got, key=lambda r: r.doc_id)] == want
    assert {r.doc_id: r.group_id for r in got} == whole


def test_runs_of_any_size_give_the_same_pairs():
    rng = np.random.default_rng(5)
    f1, f2 = np.full(300, 12345678), np.full(300, 87654321)
    for k in range(300):
        for b in rng.choice(46, 3, replace=False):
            f1[k] ^= 1 << int(b)
    who, key = simhash.keys_of(f1, f2)
    found = [{tuple(sorted((int(who[a]), int(who[b])))) for i, j in simhash.pairs_in(key, f1[who], f2[who], 16, small) for a, b in zip(i, j, strict=True)} for small in (2, 64, 100_000)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 10_000


def test_recall_by_distance():
    """Pairs up to 8 bits apart always share a key; further ones less and less often."""
    rng = np.random.default_rng(1)
    n, share = 2000, {}
    for d in (8, 10, 12, 14, 16):
        f1, f2 = rng.integers(0, 1 << 46, n), rng.integers(0, 1 << 46, n)
        g1, g2 = f1.copy(), f2.copy()
        for k in range(n):
            for b in rng.choice(92, d, replace=False).tolist():
                if b < 46:
                    g1[k] ^= 1 << b
                else:
                    g2[k] ^= 1 << (b - 46)
        share[d] = float((simhash.least_key(f1, f2, g1, g2) < len(simhash.COMBOS) << 24).mean())
    assert share[8] == 1 and share[10] > 0.97 and share[12] > 0.92 and share[14] > 0.84 and share[16] > 0.7


def test_a_third_of_all_rows_in_one_group(spark):
    rng = random.Random(9)
    base = words(rng, 300).split()
    rows = []
    for i in range(400):
        if i % 3:
            t = words(rng, 80)
        else:
            w = list(base)
            w[rng.randrange(300)] = words(rng, 1)
            t = " ".join(w)
        rows.append((i, t, "r", "b"))
    got = simhash.near_duplicates(spark.createDataFrame(rows, COLS), cell_entries=100).collect()
    assert sum(r.group_id == 0 for r in got) >= 130 and sum(r.keep for r in got) <= 275


def test_one_of_each_group_stays(spark, corpus):
    d = spark.createDataFrame([(i, t, "r", "b") for i, t in enumerate(corpus)], COLS)
    kept = simhash.deduplicate(d)
    assert kept.columns == d.columns
    left = {r.doc_id for r in kept.collect()}
    assert left == {r.doc_id for r in simhash.near_duplicates(d).where("keep").collect()}
    assert {i for i, t in enumerate(corpus) if t in (None, "", "...")} <= left


def test_many_equal_documents_and_null_ids(spark):
    rows = [(i, "the very same text", None, None) for i in range(500)] + [(3, "the very same text", None, None), (None, "quite other words stand here", None, None), (None, None, None, None)]
    d = spark.createDataFrame(rows, COLS)
    assert sorted(str(r.doc_id) for r in simhash.deduplicate(d).collect()) == ["0", "None", "None"]
    assert simhash.deduplicate(d.limit(0)).count() == 0


# ---- repeated passages


def brute_passages(rows, n):
    """{(doc_id, text): (kept text, removed words)} by looking at every window."""
    docs = sorted({(i, t) for i, t in rows if t is not None})
    seen, gone = {}, {}
    for i, t in docs:
        w = t.split()
        for s in range(len(w) - n + 1):
            key = tuple(w[s : s + n])
            if key in seen:
                gone.setdefault((i, t), set()).update(range(s, s + n))
            else:
                seen[key] = (i, s)
    out = {}
    for i, t in docs:
        w = t.split()
        cut = gone.get((i, t), set())
        out[i, t] = ([x for k, x in enumerate(w) if k not in cut], len(cut))
    return out


@pytest.mark.parametrize(("n", "flush"), [(5, 1_000_000), (50, 1_000_000), (50, 700)])
def test_passages_against_brute_force(spark, n, flush, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "FLUSH", flush)
    rng = random.Random(n)
    shared = [words(rng, n + k) for k in range(6)]
    rows = []
    for i in range(80):
        parts = [words(rng, rng.randrange(0, 90))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(shared), words(rng, rng.randrange(1, 30))]
        rows.append((i, "  ".join(parts)))
    rows += [(80, "a " * 400), (81, None), (82, ""), (83, rows[3][1]), (3, rows[3][1]), (84, words(rng, n - 1)), (85, words(rng, 3000) + " " + shared[0])]
    d = spark.createDataFrame([(i, t, "r", "b") for i, t in rows], COLS)
    want = brute_passages(rows, n)
    got = suffix_dedup.repeated_passages(d, n).collect()
    assert len(got) == len(rows)
    assert sum(r.removed_words > 0 for r in got) > 10
    originals = {}
    for i, t in rows:
        originals.setdefault(i, t)
    for r in got:
        if originals[r.doc_id] is None:
            assert r.text is None
        else:
            kept, removed = want[r.doc_id, originals[r.doc_id]]
            assert (r.text.split(), r.removed_words) == (kept, removed)


def test_copies_go_and_columns_stay(spark):
    rng = random.Random(1)
    a, b = words(rng, 120), words(rng, 80)
    d = spark.createDataFrame([(1, a, "r", "b"), (2, a, "r", "b"), (3, b + " " + a, "r", "b"), (None, a, None, None)], COLS).withColumn("n_chars", F.length("text").cast("long"))
    got = {r.doc_id: r for r in suffix_dedup.deduplicate(d).collect()}
    assert set(got) == {1, 3}
    assert got[1].text == a and got[3].text.strip() == b and got[3].n_chars == len(got[3].text)
    assert suffix_dedup.deduplicate(d).columns == d.columns
    assert suffix_dedup.deduplicate(d.limit(0)).count() == 0


@pytest.mark.parametrize("later_only", [True, False])
def test_runs_settle_alike_in_one_piece_and_in_many(later_only):
    rng = np.random.default_rng(6)
    n = 4000
    cols = [rng.integers(0, 60, n).astype(np.uint64), np.zeros(n, np.uint32), rng.integers(0, 40, n), rng.integers(0, 2, n).astype(np.uint32), rng.integers(0, 5, n).astype(np.int32), np.zeros(n, np.uint8)]
    cols[0][:1500] = 7  # a hot passage
    cols = [np.r_[c, x] for c, x in zip(cols, ([990, 991], [0, 0], [1, 1], [0, 0], [1, 1], [0, 0]), strict=True)]
    cols = [c.astype(k) for c, k in zip(cols, suffix_dedup._KINDS, strict=True)]
    places = lambda d: set(zip(*(x.tolist() for x in d), strict=True))
    _, whole = suffix_dedup._settle(cols, later_only)
    for size in (37, 500):
        rest, got = [c[:0] for c in cols], set()
        for a in range(0, len(cols[0]), size):
            piece = [c[a : a + size] for c in cols]
            sent, own = suffix_dedup._settle(piece, later_only)  # what a task settles for itself
            rest, more = suffix_dedup._settle([np.concatenate(x) for x in zip(rest, sent, strict=True)], later_only)
            got |= places(own) | places(more)
        assert got == places(whole)


def test_a_passage_that_all_share(spark):
    """2,000 documents with one passage, two texts under one id, and ids of nothing else."""
    rng = random.Random(3)
    shared = words(rng, 60)
    rows = [(i, f"{words(rng, 5)} {shared} {words(rng, 5)}", None, None) for i in range(2000)]
    rows += [(7, f"{shared} {words(rng, 8)}", None, None), (7, words(rng, 70), None, None)]
    got = suffix_dedup.repeated_passages(spark.createDataFrame(rows, COLS)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.removed_words)
    # now and then a word beside the passage is the same too
    assert by[0] == [0] and all(60 <= by[i][0] <= 64 for i in range(1, 2000) if i != 7)
    assert [60 <= x <= 64 for x in sorted(by[7])] == [False, True, True] and min(by[7]) == 0
