"""Ranked search and passage removal against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tesserae.llm import lexical_index, substring_dedup
from tesserae.llm.fm_index import FmIndex, WaveletMatrix
from tests.llm.conftest import make

LAST = 1 << 63


# --- ranked search -----------------------------------------------------------------------------------------


def terms_of(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", folded)


def slow_search(docs, items, k):
    """A list of (item_id, rank, doc_id, score) from (doc_id, text) and (item_id, text)."""
    held = [(d, Counter(terms_of(t))) for d, t in docs]
    held = [(d, c, sum(c.values())) for d, c in held if c]
    n_docs, n_terms, df = len(held), sum(n for _, _, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in held:
            m = 25 + (75 * n * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms_of(text) if t in c)
            if s > 0:
                scores.append((-s, LAST if d is None else d))
        out += [(item, i + 1, None if d == LAST else d, -s) for i, (s, d) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("most_docs, k, per_block", [(7, 10, 3), (8192, 3, 512)])
def test_search(spark, odd_docs, no_docs, most_docs, k, per_block):
    items = [(1, "ab cd AB é"), (1, "ab cd AB é"), (2, None), (3, ""), (4, "..."), (None, "same text again"), (5, "épsilon7 alpha3 alpha3 alpha3"), (6, "nowhere"), (7, "ab " * 500 + "kl")]
    asked = spark.createDataFrame([(*i, 1, 2, "x") for i in items], "item_id long, text string, item long, doc_id long, term string")
    got = lexical_index.search(lexical_index.build(odd_docs, most_docs=most_docs), asked, k, per_block=per_block).collect()
    want = slow_search([(r["doc_id"], r["text"]) for r in odd_docs.collect()], items, k)
    assert Counter(map(tuple, got)) == Counter(want) and len(want) > 10
    joined = lexical_index.search(lexical_index.build(odd_docs), asked, k, broadcast_terms=0).collect()
    assert Counter(map(tuple, joined)) == Counter(want)
    assert lexical_index.search(lexical_index.build(no_docs), asked).count() == 0
    assert lexical_index.search(lexical_index.build(odd_docs), asked.limit(0)).count() == 0


def test_strata_below_the_bound_are_not_visited():
    """With many strata and few good documents the visits end early, and the best are the same."""
    rng = random.Random(2)
    n = 4000
    m = np.sort(np.array([rng.randrange(25, 400) for _ in range(n)]))
    ids = np.array(rng.sample(range(10 * n), n))
    stratum = np.cumsum(np.concatenate([[0], np.diff(m) != 0]))
    postings = []
    for share in (0.01, 0.4, 0.9):
        docs = np.array(sorted(rng.sample(range(n), int(share * n))))
        tf = np.array([rng.choice([1, 1, 1, 2, 9]) for _ in docs])
        by = np.lexsort((docs, tf, stratum[docs]))
        postings.append((docs[by].astype(np.int32), tf[by].astype(np.int32)))
    weights = [9000, 900, 60]
    visit = lexical_index.Visit(m, ids, postings, weights)
    for asked in ([(0, 1), (1, 1), (2, 1)], [(2, 3)], [(1, 1), (2, 40)]):
        score = np.zeros(n, np.int64)
        for t, times in asked:
            docs, tf = postings[t]
            score[docs] += times * weights[t] * lexical_index.impacts(tf.astype(np.int64), m[docs])
        top = np.lexsort((ids, -score))[:10]
        found = visit.best(asked, 10, chunk=16)
        assert (found[0] == ids[top]).all() and (found[1] == score[top]).all()


# --- FM-index ----------------------------------------------------------------------------------------------


def test_wavelet_ranks():
    rng = np.random.default_rng(3)
    for n_symbols in (1, 2, 7, 300):
        x = rng.integers(0, n_symbols, 1000)
        ranks = WaveletMatrix(x, n_symbols).rank(np.repeat(np.arange(n_symbols), 3), np.tile([0, 501, 1000], n_symbols))
        assert ranks.tolist() == [int((x[:i] == s).sum()) for s in range(n_symbols) for i in (0, 501, 1000)]


def test_matching_statistics():
    rng = random.Random(1)
    for _ in range(20):
        seqs = [[b"%d" % rng.randrange(5) for _ in range(rng.randrange(1, 30))] for _ in range(rng.randrange(1, 30))]
        values = np.array([rng.randrange(1000) for _ in seqs])
        index, stream = FmIndex(seqs, values), [b"%d" % rng.randrange(6) for _ in range(50)]
        length, low, high = index.match(index.codes(stream), np.arange(50), 6)
        for e in range(50):
            held = {}
            for n in range(1, min(6, e + 1) + 1):
                held[n] = [k for k, s in enumerate(seqs) for j in range(len(s) - n + 1) if s[j : j + n] == stream[e - n + 1 : e + 1]]
            best = max((n for n, found in held.items() if found), default=0)
            assert length[e] == best
            if best:
                assert high[e] - low[e] == len(held[best])
                assert index.least_value(low[e : e + 1], high[e : e + 1])[0] == values[held[best]].min()


# --- passages ----------------------------------------------------------------------------------------------


def slow_passages(docs, window):
    """A Counter of (doc_id, n_words, n_removed, kept_sha256)."""
    first, split = {}, [(LAST if d is None else d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in docs]
    for d, w in split:
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, LAST), d)
    out = Counter()
    for d, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[None if d == LAST else d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


@pytest.fixture(scope="module")
def passages(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)] + ["É", "x y", "a,b"]
    shared = [[rng.choice(words) for _ in range(n)] for n in (13, 14, 20, 60, 200)]
    rows = []
    for i in range(150):
        text = [rng.choice(words) for _ in range(rng.randrange(0, 60))]
        for _ in range(rng.randrange(0, 3)):
            at, p = rng.randrange(0, len(text) + 1), rng.choice(shared)
            a = rng.randrange(0, len(p))
            text[at:at] = p if rng.random() < 0.5 else p[a : a + rng.randrange(1, 40)]
        rows.append((rng.choice([i, i, i, i // 3]), rng.choice([" ", "\n", "  \t"]).join(text)))
    near = [rng.choice(words) for _ in range(300)]
    for i in range(60):  # near copies
        near[rng.randrange(300)] = rng.choice(words)
        rows.append((1000 - i, " ".join(near)))
    rows += [(2000 + i, "same " * 400) for i in range(3)] + [(2010, "same " * 13), (2011, "ab cd " * 300), (2012, "cd ab " * 200), (None, " ".join(shared[3])), (None, " ".join(shared[3])), (None, None), (2020, None), (2021, ""), (2022, " \n"), (5, rows[5][1]), (5, rows[5][1])]
    return make(spark, [(d, t, "en", "s") for d, t in rows]), rows


@pytest.mark.parametrize("window, per_shard, broadcast_ids", [(13, 16384, 1_000_000), (13, 40, 0), (8, 200, 0)])
def test_passages(spark, passages, no_docs, window, per_shard, broadcast_ids):
    docs, rows = passages
    got = substring_dedup.dedup_passages(docs, window, per_shard=per_shard, broadcast_ids=broadcast_ids).collect()
    want = slow_passages(rows, window)
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got) == want
    assert sum(k[2] for k in want) > 1000
    assert all(hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"] for r in got if r["kept"] is not None)
    assert substring_dedup.dedup_passages(no_docs, window).count() == 0


def test_passages_of_odd_documents(spark, odd_docs):
    want = slow_passages([(r["doc_id"], r["text"]) for r in odd_docs.collect()], 13)
    assert Counter(tuple(r)[:4] for r in substring_dedup.dedup_passages(odd_docs).collect()) == want


def test_equal_windows_keep_an_anchor_and_a_side():
    rng = random.Random(6)
    for _ in range(200):
        shared = [b"%d" % rng.randrange(4) for _ in range(13)]
        found = []
        for _ in range(2):
            words = [b"%d" % rng.randrange(4) for _ in range(rng.randrange(0, 30))] + shared + [b"%d" % rng.randrange(4) for _ in range(rng.randrange(0, 30))]
            h, _ = substring_dedup.word_hashes(b" ".join(words))
            runs = substring_dedup.Runs(h, np.array([len(h)]), 13)
            assert runs.count.sum() == len(words) - 12 and (runs.start == np.cumsum(runs.count) - runs.count).all()
            found.append(defaultdict(set))
            for i, *two in zip(*runs.sides()):
                found[-1][runs.anchor[i]].update(x for x in two if x)
        assert any(found[0][a] & found[1][a] for a in found[0])


def test_runs_of_many_texts_are_those_of_each():
    rng = random.Random(7)
    texts = [" ".join(rng.choice("a bb ccc dd".split()) for _ in range(rng.choice([0, 3, 12, 13, 14, 40, 300]))).encode() for _ in range(60)] + [b"same " * 500]
    joined, at = substring_dedup.word_hashes(b"\n".join(texts))
    n = np.array([len(t.split()) for t in texts])
    assert len(joined) == n.sum() and at[0] == 0
    whole = substring_dedup.Runs(joined, n, 13, longest=20)
    begin = np.cumsum(n) - n
    found = [(t, a, s - begin[t], c) for t, a, s, c in zip(whole.text, whole.anchor, whole.start, whole.count)]
    sides = [(whole.text[i], whole.anchor[i], b, a) for i, b, a in zip(*whole.sides())]
    want, want_sides = [], []
    for t, text in enumerate(texts):
        runs = substring_dedup.Runs(substring_dedup.word_hashes(text)[0], n[t : t + 1], 13, longest=20)
        want += [(t, a, s, c) for a, s, c in zip(runs.anchor, runs.start, runs.count)]
        want_sides += [(t, runs.anchor[i], b, a) for i, b, a in zip(*runs.sides())]
        assert runs.count.sum() == max(0, n[t] - 12) and runs.count.max(initial=0) <= 20
    assert found == want and sides == want_sides
