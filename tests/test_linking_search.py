import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tesserae.operators import documents, facets, linking, results, search, vector_cells, vectors, word_graph
from tesserae.operators.index import segment, tokenize, tokenize_udf
from tesserae.operators.postings_index import PostingsIndex
from tesserae.plans import retrieval
from tesserae.plans.queries import all_docs
from tesserae.sources.generations import DocStore, new_path

PRODUCTS = [("P001", "sensor"), ("P002", "motor x"), ("P003", "ab"), ("P004", "sensor"), ("P005", ""), ("P006", None)]


def products(spark):
    return spark.createDataFrame(PRODUCTS, "product_id string, product_name string")


def test_links(spark):
    texts = [(1, "see P001, xP002 P0031 and P003."), (2, "訂購的P002 但：P001）"), (3, "a motor x and a sensor"), (4, None), (5, ""), (6, "cab P999 P005-001")]
    df = spark.createDataFrame(texts, "row_id int, text string")
    got = {r["row_id"]: r["product_ids"] for r in linking.link_products(df, products(spark)).collect()}
    assert got == {1: ["P001", "P003"], 2: ["P001"], 3: ["P001", "P002", "P004"], 6: ["P003", "P005"]}


@pytest.mark.parametrize("names_at_once", [200_000, 9])
def test_names_equal_plain_contains(spark, names_at_once):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc漢") for _ in range(n))
    names = [(f"P{i:03d}", word(rng.randrange(1, 6))) for i in range(40)] + [("P900", None), ("P901", "")]
    texts = [(i, word(rng.randrange(0, 30))) for i in range(60)] + [(1 << 60, "abc" * 9), (None, "abc"), (70, None)]
    p = spark.createDataFrame(names, "product_id string, product_name string")
    got = linking.name_mentions(spark.createDataFrame(texts, "row_id long, text string"), p, names_at_once=names_at_once)
    assert {tuple(r) for r in got.collect()} == {(i, p) for i, t in texts for p, n in names if n and n in (t or "")}
    assert linking.name_mentions(spark.createDataFrame(texts, "row_id long, text string"), p.limit(0)).count() == 0


def test_document_shapes(spark):
    p = spark.createDataFrame([("P001", "sensor", None, "cat", "ok", "extra")], "product_id string, product_name string, product_model string, category string, status string, field_note string")
    d = documents.product_docs(p).first()
    assert d["title"] == "[P001] sensor (None)" and d["all_content"] == "P001 sensor cat ok" and d["metadata"]["field_note"] == "extra" and d["content_vector"] is None
    w = spark.createDataFrame([("P001", "", "north hall", None, "needs P002 and P001")], "product_id string, product_name string, warehouse_location string, quantity int, special_notes string")
    d = documents.warehouse_docs(w, products(spark)).first()
    assert d["_id"] == "warehouse_P001_north_hall" and d["product_ids"] == ["P001", "P002"] and d["metadata"]["quantity"] == "0" and d["title"] == "[P001] sensor @ north hall"


def test_bm25_and_phrases_by_hand(spark):
    texts = {1: "red fox runs", 2: "fox red fox", 3: "the dog", 4: ""}
    docs = spark.createDataFrame([(k, v) for k, v in texts.items()], "_id int, content string")
    corpus = retrieval.Corpus.of(docs, ["content"])
    q = spark.createDataFrame([(7, "red fox", 1.0)], "query_id int, variant string, variant_boost double")
    hits = retrieval._hits(corpus, q, tokenize)
    toks = {k: v.split() for k, v in texts.items() if v}
    avg = sum(map(len, toks.values())) / len(toks)
    idf = lambda t: math.log(1 + (3 - sum(t in x for x in toks.values()) + 0.5) / (sum(t in x for x in toks.values()) + 0.5))
    part = lambda tf, n, i: i * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg))
    want = {k: 2 * sum(part(x.count(t), len(x), idf(t)) for t in ("red", "fox") if t in x) for k, x in toks.items() if {"red", "fox"} & set(x)}
    got = {r["_id"]: r["score"] for r in search.match_fields(hits, {"content": 2.0}).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    phrase = {r["_id"] for r in search.phrase_match(hits, {"content": 1.0}).collect()}
    assert phrase == {1, 2}


def test_keyword_code_branch(spark):
    docs = documents.product_docs(spark.createDataFrame([("P001", "sensor"), ("P002", "see P001")], "product_id string, product_name string"))
    corpus = retrieval.Corpus.of(docs, ["title", "all_content", "searchable_content", "content", "status"])
    q = spark.createDataFrame([(1, " p001 ", 5), (2, "sensor", 5), (3, "nothing", 5)], "query_id int, query string, top_k int")
    got = retrieval.keyword_search(q, corpus).collect()
    assert [r["_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 1] == ["product_P001", "product_P002"]
    assert {r["_id"] for r in got if r["query_id"] == 2} == {"product_P001"} and not [r for r in got if r["query_id"] == 3]


def slow_edits(a, b):
    """Damerau-Levenshtein distance."""
    last, far = {}, len(a) + len(b)
    d = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]] + [[far, i + 1, *[0] * len(b)] for i in range(len(a))]
    for i, x in enumerate(a, 1):
        seen = 0
        for j, y in enumerate(b, 1):
            k, m = last.get(y, 0), seen
            if x == y:
                seen = j
            d[i + 1][j + 1] = min(d[i][j] + (x != y), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + (i - k - 1) + 1 + (j - m - 1))
        last[x] = i
    return d[-1][-1]


def test_edits_of_all_short_words(spark):
    words = ["".join(w) for n in range(1, 6) for w in itertools.product("abc"[: 3 if n < 5 else 2], repeat=n)]
    rng = random.Random(2)
    pairs = [(x, y) for x in words for y in rng.sample(words, 40)]
    pairs += [("ca", "abc"), ("ab", "bxa"), ("abcd", "acbd"), ("abcd", "badc"), ("axb", "ba"), ("abc", "cab"), ("abcdef", "abdcfe")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", search.edits(F.col("a"), F.col("b")).alias("e")).collect()
    assert all(min(r["e"], 3) == min(slow_edits(r["a"], r["b"]), 3) for r in got)


@pytest.mark.parametrize("longest", [9, 20])
def test_fuzzy_distance(spark, longest):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, longest)))

    def changed(w):
        for _ in range(rng.randrange(0, 3)):
            i, kind = rng.randrange(len(w)), rng.randrange(4)
            w = [w[:i] + "x" + w[i:], w[:i] + w[i + 1 :], w[:i] + "y" + w[i + 1 :], w[:i] + w[i : i + 2][::-1] + w[i + 2 :]][kind] or "z"
        return w

    a = sorted({word() for _ in range(60)})
    b = sorted({word() for _ in range(150)} | {changed(w) for w in a for _ in range(4)})
    got = {(r["query_term"], r["term"], r["edits"]) for r in search.fuzzy_join(spark.createDataFrame([(x,) for x in a], "query_term string"), spark.createDataFrame([(x,) for x in b], "term string")).collect()}
    allow = lambda x: 0 if len(x) <= 2 else 1 if len(x) <= 5 else 2
    assert got == {(x, y, slow_edits(x, y)) for x in a for y in b if slow_edits(x, y) <= allow(x)}


def test_vectors_equal_numpy(spark):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(900, [0.0] * 8), (901, [1.0] * 3), (902, None)]
    docs = spark.createDataFrame(rows, "_id long, content_vector array<float>").repartition(3)
    q = docs.where("_id % 20 = 0 and _id < 300").select(F.col("_id").alias("query_id"), F.col("content_vector").alias("query_vector"))
    got = Counter((r["query_id"], r["_id"]) for r in vectors.vector_search(q, docs, 8, 5, rows=32).collect())
    u = m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    want = Counter((i, int(j)) for i in range(0, 300, 20) for j in np.argsort(-(u @ u[i]))[:5])
    assert got == want
    one = docs.where("_id = 3").select(vectors.cosine(F.col("content_vector"), F.col("content_vector"))).first()[0]
    assert math.isclose(one, 1.0)


def test_cells(spark):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(20, 8)) * 3
    m = (centre[rng.integers(20, size=1500)] + rng.normal(size=(1500, 8))).astype(np.float32)
    m[:500] = m[0]  # copies: a third of the vectors in one cell
    rows = [(i, v.tolist()) for i, v in enumerate(m)] + [(9000, [0.0] * 8), (9001, [1.0] * 3), (9002, None), (None, [1.0] * 8)]
    docs = spark.createDataFrame(rows, "_id long, content_vector array<float>").repartition(3)
    q = docs.where("_id % 20 = 0 and _id < 1500").select(F.col("_id").alias("query_id"), F.col("content_vector").alias("query_vector"))
    exact = vectors.vector_search(q, docs.where("_id is not null"), 8, 5)
    cells = vector_cells.fit_cells(docs, 8)
    held = vector_cells.placed_docs(docs, cells, rows=32)
    found = vectors.vector_search(q, held, 8, 5, cells=cells)
    assert vector_cells.recall(found, exact).first()["recall"] >= 0.9 and cells.probes < len(cells.centres)
    whole = vector_cells.cell_search(q, docs, cells, 5, probes=len(cells.centres), rows=32)
    key = lambda df: Counter((r["query_id"], r["_id"], r["rank"]) for r in df.collect())
    assert key(whole) == key(exact)
    assert "Cartesian" not in (plan := found._jdf.queryExecution().toString()) and "NestedLoop" not in plan
    none = docs.limit(0)
    assert vector_cells.cell_search(q, none, vector_cells.fit_cells(none, 8), 5).count() == 0
    again = vector_cells.fit_cells(docs.repartition(5), 8, sample=300)
    assert (again.centres == vector_cells.fit_cells(docs, 8, sample=300).centres).all() and len(again.centres) == 15


def test_embed_falls_back_to_single_texts(spark):
    def encode(texts):
        if len(texts) > 1 or texts[0] == "bad":
            raise ValueError
        return [[1.0]]

    df = spark.createDataFrame([("a",), ("bad",), (None,), ("",)], "t string").coalesce(1)
    assert [r[0] for r in df.select(vectors.embed(encode)("t")).collect()] == [[1.0], None, None, None]


def test_segment_and_highlight(spark):
    words = frozenset({"資料庫", "資料", "產品編號"})
    assert segment("查資料庫ABC", words, 4, True) == ["查", "資料庫", "abc"]
    assert segment("資料庫", words, 4, False) == ["資料庫", "資料"]
    assert segment("台北市", words, 4, True) == ["台北", "北市"] and segment("ＩＤ１", words, 4, True) == ["id1"]
    assert spark.createDataFrame([("的 資料庫",)], "t string").select(tokenize_udf(words, ["的"], True)("t")).first()[0] == ["資料庫"]
    assert results.highlight("a red fox and a red dog", ["red"], 100, 2, "<m>", "</m>") == ["a <m>red</m> fox and a <m>red</m> dog"]
    assert results.highlight("none here", ["red"], 10, 2, "<", ">") == [] and results.highlight(None, ["x"], 5, 1, "", "") == []
    assert results.highlight("party started at Paris, in ART a", ["art", "a", "in"], 100, 1, "<m>", "</m>") == ["party started at Paris, <m>in</m> <m>ART</m> <m>a</m>"]
    assert results.highlight("查資料庫的資料", ["資料", "資料庫"], 20, 1, "<", ">") == ["查<資料庫>的<資料>"]


def slow_windows(spans, size, most):
    """All groups of neighbouring spans that fit, the largest and then first of those left, again and again."""
    left, out = set(range(len(spans))), []
    while len(out) < most:
        fit = [(i, j) for i in range(len(spans)) for j in range(i, len(spans)) if (j == i or spans[j][1] - spans[i][0] <= size) and left.issuperset(range(i, j + 1))]
        if not fit:
            break
        i, j = min(fit, key=lambda x: (x[0] - x[1], x[0]))
        out.append(spans[i : j + 1])
        left -= set(range(i, j + 1))
    return out


def test_fragments_against_all_windows():
    rng = random.Random(11)
    words = ["in", "the", "thin", "a", "Paris", "art", "ÉTÉ", "x1", "資料", "long" * 10]
    for _ in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", ", ", ".\n"]) for _ in range(rng.randrange(0, 60)))
        terms, size, most = [w.lower() for w in rng.sample(words, 3)], rng.choice([5, 20, 60]), rng.choice([1, 3])
        spans = results.term_spans(text, terms)
        tokens = [(m.start(), m.end()) for m in regex.finditer(r"[\p{L}\p{N}]+", text)]
        assert spans == [s for s in tokens if text[slice(*s)].lower() in terms]
        assert results.best_windows(spans, size, most) == slow_windows(spans, size, most)
        found = results.highlight(text, terms, size, most, "<<", ">>")
        bare = [f.replace("<<", "").replace(">>", "") for f in found]
        assert len(found) == len(slow_windows(spans, size, most)) and all(b in text for b in bare)
        assert all(len(b) <= max(size, 40) for b in bare)
        for f in found:  # every whole token of the fragment that is a term, and no other, is marked
            assert [m for m in regex.findall(r"<<(.*?)>>", f)] == [t for t in regex.findall(r"[\p{L}\p{N}]+", f.replace("<<", "").replace(">>", "")) if t.lower() in terms]


def test_facets_and_context(spark):
    m = spark.createDataFrame([(1, ["a", "b", "a"]), (1, ["b"]), (2, None)], "query_id int, product_ids array<string>")
    assert [tuple(r) for r in facets.product_facet(m).orderBy(F.desc("count")).collect()] == [(1, "b", 2), (1, "a", 1)]
    hl = F.create_map(F.lit("content"), F.array(F.lit("x"), F.lit("y"), F.lit("z")))
    row = spark.range(1).select(results.context_part(F.create_map(F.lit("table_name"), F.lit("t")), hl, F.lit("s"), F.lit("a"))).first()[0]
    assert row == "【來源檔案: 未知, 資料表: t】\nx\ny"
    q = search.valid_queries(spark.createDataFrame([(None, None, None), ("q", "vector", 101), ("q", None, None)], "query string, mode string, top_k int")).collect()
    assert [r["reject"] for r in q] == ["query length", "top_k", None] and q[2]["mode"] == "hybrid" and q[2]["top_k"] == 5


def test_hybrid_without_vectors_is_the_weighted_keyword_score(spark):
    kw = spark.createDataFrame([(1, "a", 2.0)], "query_id int, _id string, score double")
    got = search.hybrid_join(kw, kw.limit(0)).collect()
    assert math.isclose(got[0]["score"], 1.2)
    both = search.hybrid_join(kw, spark.createDataFrame([(1, "b", 1.0), (1, "a", 0.5)], kw.schema)).collect()
    assert {r["_id"]: round(r["score"], 6) for r in both} == {"a": 1.4, "b": 0.4}


def test_all_documents_have_one_schema(spark):
    docs = all_docs(spark, "/root/testdata/sf0.001")
    from tesserae.schemas import DOCUMENT

    assert docs.columns == list(DOCUMENT)


def test_process_queries_asks_every_product_and_passage(spark):
    from tesserae.plans.queries import process_queries

    d, modes = "/root/testdata/sf0.001", ("keyword", "vector", "hybrid")
    parts, passages = spark.read.parquet(f"{d}/part.parquet").collect(), spark.read.parquet(f"{d}/benchmark.parquet").collect()
    codes = [f"P{r['p_partkey']:06d}" for r in parts]
    want = Counter((r["p_name"], modes[r["p_size"] % 3]) for r in parts) + Counter((c, "keyword") for c in codes) + Counter((r["text"].strip(), modes[r["item_id"] % 3]) for r in passages)
    got = process_queries(spark, d).collect()
    assert Counter((r["processed_query"], r["mode"]) for r in got) == want and len({r["query_id"] for r in got}) == len(got)
    fields = ("status", "searchable_content", "all_content", "content")
    docs = all_docs(spark, d).select("_id", "product_ids", F.col("metadata")["product_id"].alias("own"), tokenize(F.col("title")).alias("title"), *[tokenize(F.col(f)).alias(f) for f in fields]).collect()
    holds, in_code = {}, {}
    for r in docs:
        for t in {t for f in fields for t in r[f] or []}:
            holds.setdefault(t, set()).add(r["_id"])
        for t in {t.upper() for f in ("title", *fields[1:]) for t in r[f] or []} | set(r["product_ids"] or []) | {r["own"]}:
            in_code.setdefault(t, set()).add(r["_id"])
    texts = spark.createDataFrame([(q,) for q, m in want if m == "keyword" and q not in codes], "q string").select("q", tokenize(F.col("q")).alias("t")).collect()
    hits = {r["q"]: len(set().union(*[holds.get(t, set()) for t in r["t"]])) for r in texts} | {c: len(in_code.get(c, ())) for c in codes}
    assert all(r["total_hits"] == hits[r["processed_query"]] for r in got if r["mode"] == "keyword")


def test_highlights_take_whole_passages(spark, tmp_path):
    from tesserae.plans.queries import highlights

    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    texts = {i: " ".join(rng.choices(words, k=rng.randrange(12, 40))) for i in range(40)}
    asked = {0: " ".join(rng.choices(words, k=14)), 1: "q1 q2 q3 q4 w7 w8", 2: " ".join(texts[5].split()[1:12]), 3: "q1 q2 q3 q4 q5"}
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(asked.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    fields = {"title": ({i: t.split()[:8] for i, t in texts.items()}, 3.0, 30.0), "content": ({i: t.split() for i, t in texts.items()}, 2.0, 5.0)}
    scores = {q: Counter() for q in asked}
    for q, text in asked.items():
        terms, best = text.split(), Counter()
        for toks, boost, phrase_boost in fields.values():
            avg = sum(map(len, toks.values())) / len(toks)
            df = Counter(t for x in toks.values() for t in set(x))
            idf = lambda t: math.log(1 + (len(toks) - df[t] + 0.5) / (df[t] + 0.5))  # noqa: B023, E731
            for i, x in toks.items():
                part = lambda tf, w: w * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(x) / avg)) if tf else 0.0  # noqa: B023, E731
                best[i] = max(best[i], boost * sum(part(x.count(t), idf(t)) for t in terms))
                runs = sum(x[k : k + len(terms)] == terms for k in range(len(x)))
                scores[q][i] += phrase_boost * part(runs, sum(map(idf, terms)))
        for i, s in best.items():
            scores[q][i] += s
    want = {(q, i, rank, "\n".join(results.highlight(texts[i], asked[q].split(), 150, 3, "<mark>", "</mark>"))) for q in asked for rank, (i, s) in enumerate(sorted(scores[q].items(), key=lambda x: (-x[1], x[0]))[:5], 1) if s > 0}
    got = [tuple(r) for r in highlights(spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want) and {q for q, *_ in got} == {0, 1, 2}


def test_warehouse_rows_of_one_place_keep_their_own_notes(spark):
    w = spark.createDataFrame([("P001", "hall", 1, "needs P002"), ("P001", "hall", 2, "a sensor"), ("P001", "hall", 3, None)], "product_id string, warehouse_location string, quantity int, special_notes string")
    got = {r["metadata"]["quantity"]: r["product_ids"] for r in documents.warehouse_docs(w, products(spark)).collect()}
    assert got == {"1": ["P001", "P002"], "2": ["P001", "P004"], "3": ["P001"]}


def test_fuzzy_long_words(spark):
    rng = random.Random(18)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    asked = [word(n) for n in (6, 30, 31, 32, 33, 34, 35, 60, 300)]
    edited = set(asked)
    for w in asked:
        for _ in range(60):
            chars = list(w)
            for _ in range(rng.randrange(1, 4)):
                i = rng.randrange(len(chars) - 1)
                kind = rng.randrange(4)
                if kind == 0:
                    del chars[i]
                elif kind == 1:
                    chars.insert(i, rng.choice("abcxyz"))
                elif kind == 2:
                    chars[i] = rng.choice("abcxyz")
                else:
                    chars[i], chars[i + 1] = chars[i + 1], chars[i]
            edited.add("".join(chars))
    vocabulary = [(w,) for w in edited] + [("z" * 100_000,)]
    got = {(r["query_term"], r["term"]): r["edits"] for r in search.fuzzy_join(spark.createDataFrame([(w,) for w in asked], "query_term string"), spark.createDataFrame(vocabulary, "term string")).collect()}
    want = {(a, b): d for a in asked for b in edited if (d := slow_edits(a, b)) <= 2}
    assert got == want and len(want) > 200


def test_names_in_long_texts(spark):
    texts = [(1, "x " * 200_000 + "motor x"), (2, "y" * 300_000), (3, "ab")]
    got = linking.name_mentions(spark.createDataFrame(texts, "row_id int, text string"), products(spark), names_at_once=2)
    assert {tuple(r) for r in got.collect()} == {(1, "P002"), (3, "P003")}


def test_results_have_highlights_and_facets(spark):
    p = spark.createDataFrame([("P001", "red sensor", "<ok>", "note with sensor in it"), ("P002", "blue motor", "OK", None)], "product_id string, product_name string, status string, field_note string")
    docs = documents.product_docs(p)
    corpus = retrieval.Corpus.of(docs, ["title", "status", "searchable_content", "all_content", "content"])
    q = spark.createDataFrame([(1, "sensor", "keyword", 3, False), (2, "sensor", "hybrid", 3, False), (3, "ök", "keyword", 3, False), (4, "none such", "vector", 3, False)], "query_id int, query string, mode string, top_k int, convert_to_traditional boolean")
    got = {r["query_id"]: r for r in retrieval.process_queries(q, corpus).collect()}
    marks = {e["key"]: e["value"] for e in got[1]["results"][0]["highlights"]}
    assert marks["all_content"] == ["P001 red <mark>sensor</mark> <ok>"] and marks["field_note"] == ["note with <mark>sensor</mark> in it"]
    assert "<mark>sensor</mark>" in got[1]["context"] and "<em>sensor</em>" in got[2]["context"]
    assert [tuple(x) for x in got[1]["type_facet"]] == [("product_master", 1)] and [tuple(x) for x in got[1]["product_ids_facet"]] == [("P001", 1)]
    assert got[2]["type_facet"] is None and got[4]["results"] is None and got[4]["context"] == "" and got[4]["total_hits"] == 0
    assert [r["index"] for r in got[3]["results"]] == ["erp-products"] and "P002" in got[3]["context"]  # the status in capitals is met without its accent


def test_fuzzy_search_in_one_table(spark):
    docs = spark.createDataFrame([(1, "sensr box", "a", "x1"), (2, "sensor", "b", "x2"), (3, "other", "a", "x3")], "_id int, content string, table_name string, doc_id string")
    corpus = retrieval.Corpus.of(docs, ["content", "doc_id"])
    q = spark.createDataFrame([(1, "sensor")], "query_id int, query string")
    ids = lambda **o: {r["_id"] for r in retrieval.fuzzy_search(q, corpus, **o).collect()}
    assert ids() == {1, 2} and ids(table=("table_name", "a")) == {1}
    met = retrieval.fuzzy_matches(q, corpus).join(docs.select("_id", "table_name"), "_id")
    assert sorted(map(tuple, facets.table_facet(met).collect())) == [(1, "a", 1), (1, "b", 1)]


# --- changes and bitmaps -----------------------------------------------------------------------------------


def test_two_batches_give_the_index_of_one_build(spark):
    rng = random.Random(12)
    text = lambda: " ".join(rng.choice("red fox runs the dog a".split()) for _ in range(rng.randrange(0, 12)))
    frame = lambda rows: spark.createDataFrame(rows, "_id string, title string, content string")
    state, index = {}, None
    for batch in range(4):
        changed = {f"d{rng.randrange(60)}": (text(), text()) for _ in range(30)}
        gone = {f"d{rng.randrange(70)}" for _ in range(5 * batch)}
        state = {k: v for k, v in (state | changed).items() if k not in gone}
        df, keys = frame([(k, *v) for k, v in changed.items()] + [(None, "null", "key")]), frame([(k, None, None) for k in gone])
        if index is None:
            index = PostingsIndex.create(df, ["title", "content"])
        else:
            for _ in range(2):  # the second time it is known
                index.apply(f"b{batch}", df, keys)
    whole = PostingsIndex.create(frame([(k, *v) for k, v in state.items()]), ["title", "content"])
    rows = lambda df: Counter(str(r) for r in df.collect())
    compact = index.compacted(index.path + "-compacted")
    for other in (index, compact, PostingsIndex(spark, index.path, index.table.schema["_id"].dataType, index.fields)):
        assert rows(other.postings()) == rows(whole.postings())
        assert rows(other.terms()) == rows(whole.terms()) and rows(other.lengths()) == rows(whole.lengths())
    assert "Exchange hashpartitioning(_id" not in index.postings()._jdf.queryExecution().executedPlan().toString()


def test_document_store(spark):
    schema = "_id string, v int, tags array<string>"
    store = DocStore(spark, new_path(spark, "docs"), spark.createDataFrame([], schema).schema)
    state, rng = {}, random.Random(4)
    for batch in range(4):
        changed = {f"k{rng.randrange(30)}": (batch * 100 + i, [str(batch)]) for i in range(15)}
        gone = {f"k{rng.randrange(40)}" for _ in range(4)} if batch else set()
        state = {k: v for k, v in (state | changed).items() if k not in gone}
        for _ in range(2):
            store.apply(f"b{batch}", spark.createDataFrame([(k, *v) for k, v in changed.items()], schema), spark.createDataFrame([(k, 0, None) for k in gone], schema) if gone else None)
    read = lambda s: {r["_id"]: (r["v"], r["tags"]) for r in s.read().collect()}
    assert read(store) == state == read(store.compacted(store.table.path + "-compacted"))
    assert "Exchange" not in store.read()._jdf.queryExecution().executedPlan().toString()


def test_process_queries_totals_facets_and_results(spark):
    rng = random.Random(9)
    names = "sensor motor valve red blue".split()
    p = spark.createDataFrame([(f"P{i:03d}", " ".join(rng.sample(names, 2)), "active" if i % 3 else "stopped") for i in range(80)], "product_id string, product_name string, status string")
    docs = documents.product_docs(p).withColumn("type", F.when(F.col("id") < "P030", "old").otherwise(F.col("type")))
    corpus = retrieval.Corpus.of(docs, ["title", "all_content", "searchable_content", "content", "status"])
    q = spark.createDataFrame([(1, "red sensor", "keyword"), (2, "P007", "keyword"), (3, "active", "keyword"), (4, "blue valve", "hybrid"), (5, "nothing", "keyword"), (6, "ACTIVE", "hybrid")], "query_id long, query string, mode string").withColumns({"top_k": F.lit(4), "convert_to_traditional": F.lit(False)})
    near = lambda part, factor: part.select("query_id", F.lit("product_P011").alias("_id"), F.lit(0.9).alias("score"))
    got = {r["query_id"]: r for r in retrieval.process_queries(q, corpus, near).collect()}
    kw, hyb = q.where("mode = 'keyword'"), q.where("mode = 'hybrid'")
    matches = retrieval.keyword_matches(kw, corpus)
    both = retrieval.hybrid_matches(hyb, corpus, near(hyb, 2))
    want = {r[0]: r[1] for r in facets.total_hits(matches.unionByName(both)).collect()}
    assert {k: r["total_hits"] for k, r in got.items() if r["total_hits"]} == want and got[5]["total_hits"] == 0
    met = matches.join(corpus.docs.select("_id", "type", "product_ids"), "_id")
    for column, counted in (("type", facets.type_facet), ("product_ids", facets.product_facet)):
        by = {}
        for r in counted(met).collect():
            by.setdefault(r["query_id"], []).append((-r["count"], r["value"]))
        found = {k: [(-x["count"], x["value"]) for x in r[f"{column}_facet"]] for k, r in got.items() if r[f"{column}_facet"]}
        assert found == {k: sorted(v) for k, v in by.items()}
    top = retrieval.over_fetch(matches, kw, 2).unionByName(retrieval.over_fetch(both, hyb, 3)).collect()
    for k, r in got.items():
        mine = sorted((t["rank"], round(t["score"], 9)) for t in top if t["query_id"] == k)
        assert [(x["rank"], round(x["score"], 9)) for x in (r["results"] or [])] == mine


def test_a_search_neither_shuffles_nor_writes_what_it_matches(spark):
    docs = spark.createDataFrame([(i, "red fox " * (i % 3)) for i in range(50)], "_id long, content string")
    corpus = retrieval.Corpus.of(docs, ["content"])
    q = spark.createDataFrame([(1, "fox", 1.0, "own")], "query_id long, variant string, variant_boost double, role string")
    plan = retrieval.Met.of(corpus, q).matches({"content": 1.0}, "own")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


# --- words without spaces ----------------------------------------------------------------------------------


def test_best_path_against_all_paths(spark):
    rng = random.Random(5)
    for _ in range(200):
        words = {"".join(rng.choice("天地人口") for _ in range(rng.randrange(1, 4))): -rng.random() * 9 for _ in range(12)}
        run = "".join(rng.choice("天地人口大") for _ in range(rng.randrange(1, 9)))
        worth = lambda parts: sum(words.get(p, -20.0 if len(p) == 1 else -math.inf) for p in parts)
        cuts = [c for n in range(len(run)) for c in itertools.combinations(range(1, len(run)), n)]
        paths = [[run[a:b] for a, b in zip((0, *c), (*c, len(run)))] for c in cuts]
        found = word_graph.best_path(run, words, 3, -20.0)
        assert "".join(found) == run and math.isclose(worth(found), max(map(worth, paths)))
    texts = ["資料庫的資料", "查資料庫 ABC", "資料庫", "大資料", None, "", "的確"] * 3
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    model = word_graph.learn_words(df, "t", ["的確", "未見詞"], least=9)
    count = lambda w: sum(sum((t or "").startswith(w, i) for i in range(len(t or ""))) for t in texts)
    n = {w: count(w) or 1 for w in model}
    assert {"資料", "資料庫", "的確", "未見詞", "大"} <= set(model) and "大資" not in model
    assert all(math.isclose(v, math.log(n[w] / sum(n.values()))) for w, v in model.items())
    got = df.select("t", word_graph.graph_tokenizer(model, ["的"])("t").alias("w")).distinct().collect()
    assert {r["t"]: r["w"] for r in got}["查資料庫 ABC"] == ["查", "資料庫", "abc"] and {r["t"]: r["w"] for r in got}["資料庫的資料"] == ["資料庫", "資料"]


def test_conversion_goes_by_phrases(spark):
    table = {"头发": "頭髮", "发": "發", "发现": "發現", "头": "頭", "理发": "理髮", "后": "後", "皇后": "皇后", "现": "現"}
    texts = ["头发", "发现头发", "理发后", "皇后后", "无", "", None, "发"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(word_graph.phrase_converter(table)("t")).collect()]
    assert got == ["頭髮", "發現頭髮", "理髮後", "皇后後", "无", "", None, "發"]
    rng = random.Random(1)
    for _ in range(100):
        phrases = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))): str(i) for i in range(5)}
        text, want, at = "".join(rng.choice("abcd") for _ in range(12)), "", 0
        while at < len(text):
            p = max((p for p in phrases if text.startswith(p, at)), key=len, default=None)
            want, at = want + (phrases[p] if p else text[at]), at + len(p or "x")
        starts = {c: max(len(p) for p in phrases if p[0] == c) for c in {p[0] for p in phrases}}
        assert word_graph.convert_phrases(text, phrases, starts) == want


def shuffled(node) -> int:
    """Rows that the exchanges of an executed plan wrote."""
    n = node.metrics().apply("shuffleRecordsWritten").value() if node.metrics().contains("shuffleRecordsWritten") else 0
    kind, kids = node.getClass().getSimpleName(), node.children()
    if kind == "AdaptiveSparkPlanExec":
        return shuffled(node.executedPlan())
    if kind.endswith("QueryStageExec"):
        return shuffled(node.plan())
    return n + sum(shuffled(kids.apply(i)) for i in range(kids.size()))


def test_links_of_a_shared_name_are_made_once(spark):
    p = spark.range(200).selectExpr("concat('P', lpad(cast(id as string), 3, '0')) AS product_id", "CASE WHEN id % 2 = 0 THEN 'red bolt' ELSE 'nut' END AS product_name")
    p = p.unionByName(spark.createDataFrame([("P000", "nut")], p.schema))  # one id of two names
    texts = spark.range(400).selectExpr("id AS row_id", "CASE id % 4 WHEN 0 THEN 'a red bolt' WHEN 1 THEN 'red bolt and nut, P001' WHEN 2 THEN 'P003 only' ELSE 'none' END AS text")
    links = linking.link_products(texts, p)
    got = {r["row_id"]: r["product_ids"] for r in links.collect()}
    even, every = [f"P{i:03d}" for i in range(0, 200, 2)], [f"P{i:03d}" for i in range(200)]
    assert len(got) == 300 and got[0] == even and got[1] == every and got[2] == ["P003"]
    assert shuffled(links._jdf.queryExecution().executedPlan()) < 4000  # 20,000 and more where each link is a row
    pairs = linking.name_mentions(texts, p)
    assert pairs.count() == pairs.distinct().count() == 100 * 100 + 100 * 200
    rows = linking.with_links(texts, texts, p).where("row_id IN (1, 2, 3)").orderBy("row_id").collect()
    assert rows[0]["_ids"] == every and rows[0]["_related"].startswith("P000(nut), P000(red bolt), P001(nut), P002(red bolt)")
    assert (rows[1]["_related"], rows[2]["_ids"], rows[2]["_related"]) == ("P003(nut)", None, None)


def test_sums_that_differ_in_the_last_bits_are_ties(spark):
    hits = spark.createDataFrame([(1, "b", 0.1 + 0.2 + 0.3), (1, "a", 0.3 + 0.2 + 0.1), (1, "c", 0.1)], "query_id int, _id string, score double")
    queries = spark.createDataFrame([(1, 2)], "query_id int, top_k int")
    got = retrieval.over_fetch(hits, queries, 1).orderBy("rank").collect()
    assert [r["_id"] for r in got] == ["a", "b"]


def test_fuzzy_scores_are_summed_where_the_postings_lie(spark):
    docs = spark.range(300).selectExpr("id AS _id", "concat('sensor motor valve ', id) AS content", "'red bolt' AS title")
    queries = spark.createDataFrame([(i, "sensr motro valvee blot") for i in range(20)], "query_id long, query string")
    found = retrieval.fuzzy_matches(queries, retrieval.Corpus.of(docs, ["title", "content"]))
    rows = found.collect()
    assert len(rows) == 20 * 300
    assert shuffled(found._jdf.queryExecution().executedPlan()) == 0
    spread = retrieval.fuzzy_matches(queries, retrieval.Corpus.of(docs, ["title", "content"]), most=0).collect()
    near = lambda rs: {(r["query_id"], r["_id"]): round(r["score"], 9) for r in rs}
    assert near(rows) == near(spread)


def test_workers_hold_few_pairs_of_blocks(spark, monkeypatch):
    """Rows of two matrices come in small batches, and the session's setting is as it was."""
    import numpy as np

    from tesserae.operators import vector_cells, vectors

    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, dims = spark.conf.get(setting), 4
    monkeypatch.setattr(vector_cells, "_BYTES", 2 * 8 * 5 * 8 * 3)
    made = vector_cells._best

    def watched(dims, k):
        run = made(dims, k)

        def checked(batches):
            def few():
                for pdf in batches:
                    assert len(pdf) <= 3, len(pdf)
                    yield pdf

            return run(few())

        return checked

    monkeypatch.setattr(vector_cells, "_best", watched)
    m = np.random.default_rng(3).normal(size=(400, dims))
    docs = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "_id long, content_vector array<double>").coalesce(1)
    queries = docs.where("_id % 20 = 0").selectExpr("_id as query_id", "content_vector as query_vector")
    cells = vector_cells.fit_cells(docs, dims, cells=2)
    found = vector_cells.cell_search(queries, docs, cells, 3, probes=2, rows=8).select("query_id", "_id", "rank").collect()
    want = vectors.vector_search(queries, docs, dims, 3).select("query_id", "_id", "rank").collect()
    assert sorted(found) == sorted(want) and spark.conf.get(setting) == before


def test_terms_of_documents_are_counted_once_a_set_of_runs(spark):
    """The same counts as of whole texts, and the tokenizer sees no text whose rest is ASCII."""
    from pyspark.sql import functions as F

    from tesserae.operators import word_graph

    texts = ["產品編號 P1 產品名稱 hot Bolt", "產品編號 P2 產品名稱 hot_ring產品", "客訴編號 ４２ Été 產品名稱", "plain WORDS words", "", None, "產品名稱 é", "\tＡbc產品 x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 3)], "_id long, text string")
    tokens = word_graph.graph_tokenizer(word_graph.learn_words(docs, "text"))
    want = docs.select("_id", F.explode(F.array_distinct(tokens("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("docs"))
    got = word_graph.document_frequencies(docs, "text", tokens)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    seen = []

    def watched(text):
        seen.append(text)
        return tokens(text)

    word_graph.document_frequencies(docs, "text", watched)
    assert len(seen) == 2


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_notes_of_warehouse_rows_are_made_once(spark, monkeypatch, most):
    monkeypatch.setattr(documents, "_IDS", most)
    runs = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def note(i):
        runs.add(1)
        return "needs P002" if i % 2 else None

    rows = spark.range(10).repartition(1).select(F.concat(F.lit("P00"), (F.col("id") % 4).cast("string")).alias("product_id"), F.col("id").cast("string").alias("warehouse_location"), note("id").alias("special_notes"))
    got = {r["warehouse_location"]: r["product_ids"] for r in documents.warehouse_docs(rows, products(spark)).select("warehouse_location", "product_ids").collect()}
    assert got == {str(i): [f"P00{i % 4}", *(["P002"] if i % 2 and i % 4 != 2 else [])] for i in range(10)}
    assert runs.value <= 50  # where notes are looked through and where they are joined, filters included


def test_codes_in_folded_documents(spark):
    """Documents that hold names in place of the ids of all products of a name have the totals and best documents of whole ones, and no row for each link."""
    rng = random.Random(31)
    names = ["red fox", "blue box", "green jar", ""]
    p = spark.createDataFrame([(f"P{i:03d}", names[i % 4] if i < 60 else "tin can", "active", "m") for i in range(64)] + [("P001", "green jar", "active", "m")], "product_id string, product_name string, status string, product_model string")
    said = lambda: " and ".join(rng.choice([f"P{rng.randrange(70):03d}", *names[:3], "nothing"]) for _ in range(3))
    c = spark.createDataFrame([(f"C{i:03d}", said(), "open") for i in range(150)] + [("C900", None, "open"), ("C901", "", None)], "complaint_id string, description string, status string")
    made = documents.product_docs(p.dropDuplicates(["product_id"]))
    whole, folded = documents.union_docs(made, documents.complaint_docs(c, p)), documents.union_docs(made, documents.folded_complaint_docs(c, p))
    asked = [f"P{i:03d}" for i in range(0, 70, 3)] + ["P001", "p005 ", "red fox", "tin", "open", "zzz"]
    q = spark.createDataFrame([(i, t, 1 + i % 4) for i, t in enumerate(asked)], "query_id long, query string, top_k int")
    fields, named = ["title", "status", "searchable_content", "all_content", "content"], p.where("product_name <> ''").select(F.col("product_name").alias("name"), "product_id")
    old, new = retrieval.Corpus.of(whole, fields), retrieval.Corpus.asked(folded, fields, q.select("query"), named=named)
    a, b = retrieval.keyword_clauses(q, old), retrieval.keyword_clauses(q, new)
    total = lambda df: {r[0]: r[1] for r in df.collect() if r[1]}
    want = total(facets.total_hits(a.every()))
    assert total(a.totals(old.numbers())) == total(b.totals(new.numbers())) == want
    top = lambda c: sorted((r["query_id"], r["rank"], r["_id"], round(r["score"], 6)) for r in retrieval.over_fetch(c.best(q, 2), q, 2).collect())
    assert top(a) == top(b)
    of_codes = F.col("query_id") < 25
    assert b.few.where(of_codes).count() < 0.7 * a.few.where(of_codes).count()
