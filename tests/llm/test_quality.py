"""The verdict of the quality rules against the same procedure in numpy, and its determinants against all subsets."""

import itertools
import math
import random
from collections import defaultdict

import numpy as np

from tests.llm.conftest import make
from tests.llm.test_operators import slow_counts
from tesserae.llm import quality_rules

FLOOR2 = np.array(list(quality_rules.FLOOR.values())) ** 2
P = len(FLOOR2)


def vector(c):
    n = max(c[0], 1)
    share = lambda k: math.asin(math.sqrt(min(1.0, k / n)))
    return [math.log1p(c[0]), math.log1p(c[1] / n), share(c[2]), share(c[3]), share(c[4])]


def quantile(x, q):
    return np.sort(x, axis=0)[max(0, math.ceil(q * len(x)) - 1)]


def distances(x, mean, cov):
    d = x - mean
    return np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d)


def estimate(x):
    return x.mean(axis=0), np.cov(x.T, bias=True).reshape(P, P) + np.diag(FLOOR2)


def log_det(cov):
    return np.linalg.slogdet(cov)[1] / 2


def slow_mcd(x):
    med = quantile(x, 0.5)
    sd = np.maximum(1.4826 * quantile(np.abs(x - med), 0.5), np.sqrt(FLOOR2))
    wrapped = np.tanh((x - med) / sd)
    b = np.cov(wrapped.T, bias=True).reshape(P, P) * np.outer(sd, sd) / 0.4 + np.diag(FLOOR2)
    return [(med, np.diag(sd**2)), (med, b)]


def concentrated(x, mean, cov):
    """(log-determinant, mean, covariance) where steps gain nothing any more."""
    best = None
    while True:
        d = distances(x, mean, cov)
        mean, cov = estimate(x[d <= quantile(d, 0.75) * (1 + 1e-12)])
        if best and best[0] - log_det(cov) <= 1e-3:
            return best
        best = (log_det(cov), mean, cov)


def slow_estimates(groups):
    out = {}
    for g, x in groups.items():
        _, mean, cov = min((concentrated(x, *start) for start in slow_mcd(x)), key=lambda r: r[0])
        inside = x[distances(x, mean, cov) <= 12.83 * 1.35]
        out[g] = (len(inside), *(estimate(inside) if len(inside) else (None, None)))
    return out


def test_verdict_equals_numpy(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    rows = []
    for i in range(260):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "s3", None])
        odd = rng.choice([0] * 12 + [1, 2, 3])
        body = [word() + ("#$" if odd == 1 else "") for _ in range(rng.randrange(4, 90))]
        if odd == 2:
            body = [w * 12 for w in body]
        line = " ".join(body[:6]) + "\n" if odd == 3 else ""
        rows.append((i, line + " ".join(body) + ("\n" + line * 2 if odd == 3 else ""), lang, source))
    rows += [(900, None, "en", "s1"), (901, "", None, None), (902, " ".join(word() for _ in range(40)), "fr", "lone")]
    got = {r["doc_id"]: r for r in quality_rules.judge(make(spark, rows)).collect()}
    counts = {r[0]: slow_counts(r[1]) for r in rows}
    failed = {k: c[0] < 10 or 100 * c[4] > 20 * c[0] for k, c in counts.items()}
    groups = defaultdict(list)
    for i, _, lang, source in rows:
        if not failed[i]:
            for g in ("all", (lang,), (lang, source)):
                groups[g].append(vector(counts[i]))
    est = slow_estimates({g: np.array(x) for g, x in groups.items()})
    drawn = lambda n, own, up: up if own is None else n / (n + 30) * own + 30 / (n + 30) * up
    kept = set()
    for i, _, lang, source in rows:
        assert got[i]["base_failed"] == failed[i]
        if failed[i]:
            assert got[i]["distance"] is None and not got[i]["kept"]
            continue
        _, mean, cov = est["all"]
        for g in ((lang,), (lang, source)):
            n, m, c = est[g]
            mean, cov = drawn(n, m, mean), drawn(n, c, cov)
        d = distances(np.array([vector(counts[i])]), mean, cov)[0]
        assert math.isclose(got[i]["distance"], d, rel_tol=1e-6, abs_tol=1e-9), (i, lang, source)
        assert got[i]["kept"] == (d <= 40)
        kept.add(bool(d <= 40))
    assert kept == {True, False}


def test_determinant_is_near_the_least_of_all_subsets():
    rng = np.random.default_rng(3)
    close = 0
    for trial in range(4):
        x = rng.normal(size=(14, P)) * 1.5
        x[:3] += rng.normal(size=P) * 9
        least = min(log_det(estimate(x[list(s)])[1]) for s in itertools.combinations(range(14), 11))
        close += min(concentrated(x, *start)[0] for start in slow_mcd(x)) <= least + 0.05
    assert close >= 3


def test_a_large_source_stands_by_its_own_estimate(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    # one source writes long words, the others short ones: long words are odd only where they are rare
    rows = [(i, " ".join(word(rng.randrange(14, 22)) for _ in range(60)), "en", "long") for i in range(300)]
    rows += [(1000 + i, " ".join(word(rng.randrange(2, 8)) for _ in range(60)), "en", "short") for i in range(300)]
    rows += [(2000, " ".join(word(60) for _ in range(60)), "en", "short")]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(make(spark, rows)).collect()}
    assert all(v for k, v in got.items() if k < 2000) and not got[2000]
