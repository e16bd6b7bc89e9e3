"""The pipeline's decisions, stage by stage, and that the library stands without this subpackage."""

import pathlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm.conftest import make
from tests.llm.test_operators import plain, slow_components, slow_fingerprint, slow_mix, words_of


def test_stages(spark, odd_docs):
    good = make(spark, [(2000 + i, f"the quick brown fox number {'x' * i} jumps over the lazy dog of day {'y' * i}", "en", "s1") for i in range(20)])
    docs = odd_docs.unionByName(good)
    before = docs.collect()
    for name, stage in corpus_pipeline.STAGES:
        after_df = stage(spark, docs, "")
        after = after_df.collect()
        if name == "language_id":
            assert Counter(after) == Counter(r for r in before if any(map(str.isalpha, r["text"] or "")))
        elif name == "exact_dedup":
            assert sorted(plain(r["text"]) for r in after) == sorted({plain(r["text"]) for r in before})
        elif name == "near_dedup":
            roots = slow_components({slow_fingerprint(r["text"]) for r in before}, 4)
            assert sorted(roots[slow_fingerprint(r["text"])] for r in after) == sorted(set(roots.values()))
        elif name == "mixing":
            assert set(after) <= set(before) and max(Counter(after).values()) <= 2
            total = sum(len(words_of(r["text"])) for r in before)
            assert abs(sum(len(words_of(r["text"])) for r in after) - 1.5 * total) <= 0.5 * total
        else:
            assert Counter(r["doc_id"] for r in after if r["piece"] == 0) == Counter(r["doc_id"] for r in before)
        if name != "packing":
            assert after_df.columns == docs.columns
        docs, before = spark.createDataFrame(after, after_df.schema), after


def test_documents_stay_where_no_language_can_be_learnt(spark):
    texts = ["some words", "Élan", "日本語", "12 34 !!", "", None, " \t", "ª 1"]
    docs = make(spark, [(i, t, None, "s1") for i, t in enumerate(texts)])
    kept = corpus_pipeline.language_stage(spark, docs, "")
    assert {r["doc_id"] for r in kept.collect()} == {i for i, t in enumerate(texts) if any(map(str.isalpha, t or ""))} and kept.columns == docs.columns


@pytest.mark.parametrize("k", range(5))
def test_an_empty_table_goes_through_each_stage(spark, no_docs, k):
    _, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, no_docs, "")
    assert out.count() == 0 and (k == 4 or out.columns == no_docs.columns)


def test_mixing_takes_repeated_rows_as_often_as_all_together(spark, odd_docs):
    docs = odd_docs.unionByName(odd_docs.where("doc_id between 5 and 30"))
    want = Counter()
    for (doc, source, size, taken), n in slow_mix(docs.collect()).items():
        want[doc, source, size] += n * (taken // size if size else 0)
    got = Counter((r["doc_id"], r["source"], len(words_of(r["text"]))) for r in corpus_pipeline.mixing_stage(spark, docs, "").collect())
    assert got == +want


def test_run(spark):
    """The whole run by plain means: which documents are packed, how often, and each piece once in its place."""
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    docs = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if any(map(str.isalpha, r["text"] or ""))]
    best = {}
    for r in docs:
        key = plain(r["text"])
        if key not in best or (-len(r["text"]), r["doc_id"]) < (-len(best[key]["text"]), best[key]["doc_id"]):
            best[key] = r
    fps = {r["doc_id"]: slow_fingerprint(r["text"]) for r in best.values()}
    roots, first = slow_components(set(fps.values()), 4), {}
    for d in sorted(fps):
        first.setdefault(roots[fps[d]], d)
    left = [r for r in best.values() if r["doc_id"] in first.values()]
    times = Counter({d: taken // size for (d, _, size, taken), n in slow_mix(left).items() if size})
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == +times
    sequences = defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(s[-1]) <= 1024


def test_nothing_else_imports_the_subpackage():
    top = pathlib.Path(corpus_pipeline.__file__).parent
    for path in (top / "tesserae").rglob("*.py"):
        if "llm" not in path.parts:
            assert "tesserae.llm" not in path.read_text()
