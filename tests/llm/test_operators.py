"""Each operator against a brute-force version, on odd rows and on empty tables."""

import hashlib
import itertools
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.conftest import make
from tesserae.llm import digest_index, html_text, language_id, line_dedup, mixing, packing, quality_rules, rule_ensemble, sharding, simhash
from tesserae.llm.common import keep_rows, number_rows
from tesserae.llm.queries import fresh_index

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def words_of(text):
    return WORDS.findall(text or "")


# --- numbering ---------------------------------------------------------------------------------------------


def test_numbers_are_gapless(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 700, "hot").otherwise(F.when(F.col("id") % 2 == 0, None).otherwise("b")))
    got = number_rows(df, ["g"], ["id"], 1000, "n", per_chunk=50).collect()
    by = defaultdict(list)
    for r in got:
        by[r["g"]].append(r["n"])
    assert len(got) == 1000 and all(sorted(v) == list(range(len(v))) for v in by.values())


# --- 1 sharding --------------------------------------------------------------------------------------------


def test_differencing_known_case():
    places, total = sharding.difference([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]])
    assert sorted(total) == [14, 16]  # what two-way differencing gives for these
    loads = [0, 0]
    for size, p in zip((8, 7, 6, 5, 4), places):
        loads[p[0]] += size
    assert loads == total


def test_shards(spark, odd_docs, no_docs):
    got = sharding.shard_documents(odd_docs, 4, per_bucket=8).collect()
    assert len(got) == odd_docs.count()
    texts = Counter((r["doc_id"], r["text"]) for r in odd_docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter({k: 0 for k in ()}) + sum((Counter({(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())): n}) for (d, t), n in texts.items()), Counter())
    by_text, by_shard = defaultdict(set), defaultdict(list)
    for r in got:
        by_text[r["text_crc32"], r["size"]].add(r["shard"])
        by_shard[r["shard"]].append(r["slot"])
    assert all(len(v) == 1 for v in by_text.values())
    assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
    assert sharding.shard_documents(no_docs, 4).count() == 0


def test_shards_balance(spark):
    rng = random.Random(1)
    docs = make(spark, [(i, "x" * rng.randrange(1, 5000), "en", "s") for i in range(3000)])
    loads = Counter()
    for r in sharding.shard_documents(docs, 8, per_bucket=256).collect():
        loads[r["shard"]] += r["size"]
    assert len(loads) == 8 and max(loads.values()) - min(loads.values()) < 50


def test_one_very_long_word_line_and_text(spark):
    """Texts of a million characters go through every operator and come out as by plain means."""
    rng = random.Random(20)
    word, line = "x" * 1_000_000, "ab " * 300_000
    texts = [word, word + "y", line, line + "\n" + line, " ".join(f"w{rng.randrange(50_000)}" for _ in range(120_000)), "\n" * 500_000, "é" * 400_000 + " #" * 200_000]
    docs = make(spark, [(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)])
    n = len(texts)
    shards = sharding.shard_documents(docs, 2).collect()
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in shards} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["fingerprint"] for r in simhash.near_duplicates(docs).collect()} == {i: f"{slow_fingerprint(t):016x}" for i, t in enumerate(texts)}
    got = {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.judge(docs).collect()}
    assert got == {i: slow_counts(t) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["text_sha256"] for r in digest_index.dedup(docs, fresh_index(spark), "b").collect()} == {i: hashlib.sha256(plain(t).encode()).hexdigest() for i, t in enumerate(texts)}
    assert Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in mixing.mix(docs).collect()) == slow_mix(docs.collect())
    assert Counter(map(tuple, line_dedup.remove_boilerplate(docs).collect())) == slow_lines([(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts)])
    pieces, exact = packing.pack_documents(docs).collect(), packing.exact_encoder("byte_bpe_50k")
    assert {i: sum(r["length"] for r in pieces if r["doc_id"] == i) for i in range(n)} == {i: len(exact(t)) + 1 for i, t in enumerate(texts)}


# --- 2 html ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "page, text",
    [
        ("<html><body><nav><a>m</a></nav><article><h1>T &amp; t</h1><p>One\n two <b>three<br><p>Four</p></article><footer>f</footer>", "T & t\n\nOne two three\n\nFour"),
        ("<div class='content'><p>a b c d e f g</p><div class='comments'><p>no</p></div><ul><li>x<li>y</ul></div><div id=sidebar>s</div>", "a b c d e f g\n\nx\n\ny"),
        ("<p>only &lt;text&gt; here", "only <text> here"),
        ("<main><table><tr><td>cell one<td>cell two</table><script>var a='</p>'</script><form>q<input></form></main>", "cell one\n\ncell two"),
        ("", ""),
        ("<!-- nothing -->", ""),
        ("<article><!--><p>one</p><!---><p>two</p><!-- > no --></article>", "one\n\ntwo"),
        ("<article><header><h2>Head</h2><span>by line</span></header><p>Body text</p><aside>see also</aside></article>", "Head\n\nBody text"),
    ],
)
def test_extract_alone(page, text):
    assert html_text.extract(page, [])[0] == text


def test_host_path_wins(spark):
    main = "<div class='post-1'><p>{}</p></div><div class='teasers'><p>{}</p></div>"
    pages = [(i, "http://a.example/x", main.format("word " * 40, "tease")) for i in range(6)]
    pages += [(9, "http://a.example/y", main.format("short", "a teaser longer than the article")), (10, None, None), (11, "http://a.example/z", "<article>other layout</article>"), (11, "http://a.example/z", "<article>other layout</article>")]
    df = spark.createDataFrame([(*p, "p") for p in pages], "page_id long, url string, html string, path string")
    got = {r["page_id"]: r for r in html_text.main_texts(df).collect()}
    assert got[9]["text"] == "short" and got[9]["path"] == "body>div.post-#".removeprefix("body>")
    assert got[11]["text"] == "other layout" and got[10]["text"] == "" and got[10]["n_chars"] == 0
    assert html_text.main_texts(df).count() == len(pages)
    assert html_text.main_texts(df.limit(0)).count() == 0


# --- 3 simhash ---------------------------------------------------------------------------------------------


def slow_fingerprint(text):
    w = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def slow_components(fps, distance):
    above = {f: f for f in fps}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, b in itertools.combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= distance:
            above[root(a)] = root(b)
    return {f: root(f) for f in fps}


def test_simhash(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    fps = [slow_fingerprint(r["text"]) for r in rows]
    roots = slow_components(set(fps), 4)
    least = {}
    for r, f in zip(rows, fps):
        if r["doc_id"] is not None:
            least[roots[f]] = min(least.get(roots[f], 1 << 60), r["doc_id"])
    want = Counter((r["doc_id"], f"{f:016x}", least.get(roots[f])) for r, f in zip(rows, fps))
    for blocks in (None, 8):
        got = simhash.near_duplicates(odd_docs, blocks=blocks).collect()
        assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want
    assert simhash.near_duplicates(no_docs).count() == 0
    found = simhash.near_duplicates(odd_docs)
    kept = keep_rows(odd_docs, simhash.representatives(found), found)
    assert kept.count() == len(set(roots.values())) and kept.columns == odd_docs.columns


def test_one_row_of_each_component_stays_with_repeated_and_null_ids(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    first, second, third = ([word() for _ in range(300)] for _ in range(3))
    texts = [" ".join(t) for t in (first, second, third)]
    copies = lambda t: (" ".join([*t.split()[:k], word(), *t.split()[k + 1 :]]) for k in range(300))
    near = [next(c for c in copies(t) if 0 < (slow_fingerprint(c) ^ slow_fingerprint(t)).bit_count() <= 4) for t in texts]
    # the id 1 is the smallest of two components; a third one has no ids
    rows = [(1, texts[0], "en", "s1"), (5, near[0], "en", "s1"), (1, texts[1], "en", "s1"), (6, near[1], "en", "s1"), (None, texts[2], "en", "s1"), (None, near[2], "en", "s1")]
    roots = slow_components({slow_fingerprint(r[1]) for r in rows}, 4)
    assert len(set(roots.values())) == 3 and len(roots) == 6
    docs = make(spark, rows)
    found = simhash.near_duplicates(docs)
    kept = keep_rows(docs, simhash.representatives(found), found).collect()
    assert Counter(roots[slow_fingerprint(r["text"])] for r in kept) == {r: 1 for r in roots.values()}
    assert [r["doc_id"] for r in kept].count(1) == 2


@pytest.mark.parametrize("blocks, most", [(6, 50_000), (7, 50_000), (6, 40)])
def test_links_connect_what_all_pairs_connect(spark, blocks, most):
    rng = random.Random(blocks)
    fps = {rng.getrandbits(64) for _ in range(150)}
    for f in list(fps)[:40]:
        for _ in range(rng.randrange(12)):  # chains of close copies
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6)))
            fps.add(f)
    dense = rng.getrandbits(64)
    fps |= {dense ^ rng.getrandbits(9) for _ in range(300)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = simhash.connected(simhash.near_links(df, len(fps), 4, blocks, most)).collect()
    got = {f: f for f in fps} | {r["node"] % (1 << 64): r["root"] % (1 << 64) for r in found}
    same = lambda of: {frozenset(x for x in fps if of[x] == r) for r in set(of.values())}
    assert same(got) == same(slow_components(fps, 4))


def test_forest_by_blocks_equals_direct():
    rng = np.random.default_rng(3)
    fps = np.unique(np.uint64(1 << 40) ^ rng.integers(0, 1 << 14, 900).astype(np.uint64) ^ (rng.integers(0, 1 << 8, 900).astype(np.uint64) << np.uint64(50)))
    names = []
    for direct in (10, 100_000):
        edges = [(int(a), int(b)) for x, y in simhash.forest(fps, 2, direct) for a, b in zip(x, y)]
        assert all((a ^ b).bit_count() <= 2 for a, b in edges)
        of = {int(f): int(f) for f in fps} | dict(simhash._as_stars([(np.array([a]), np.array([b])) for a, b in edges]))
        names.append({frozenset(k for k in of if of[k] == r) for r in set(of.values())})
    assert names[0] == names[1]


def test_keys_of_16_blocks_leave_16_bits():
    for blocks in range(16, 20):
        assert max(64 - m.bit_count() for m in simhash.block_masks(blocks, 4)) <= 16


def test_connected_long_chain(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.connected(df).collect()}
    assert len({got[i] for i in range(301)}) == 1 and got[1000] == got[1001] != got[0]


# --- 4 line dedup ------------------------------------------------------------------------------------------


def slow_lines(rows):
    """(doc, text) -> (text, lines, removed) by sets of sites."""
    sites, of = defaultdict(set), {r[3] for r in rows}
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r")
    for _, text, _, site in rows:
        for line in (text or "").split("\n"):
            sites[strip(line)].add(site)
    enough = lambda k: max(3, min(8, math.ceil(0.4 * len(of)))) if len(words_of(k)) >= 4 else max(3, math.ceil(0.8 * len(of)))
    out = Counter()
    for doc, text, _, _ in rows:
        if text is None:
            out[doc, None, 0, 0] += 1
            continue
        kept = [x for x in text.split("\n") if not words_of(x) or len(sites[strip(x)]) < enough(strip(x))]
        out[doc, "\n".join(kept), text.count("\n") + 1, text.count("\n") + 1 - len(kept)] += 1
    return out


@pytest.mark.parametrize("n_sites", [1, 2, 5, 9, 25])
def test_lines(spark, no_docs, n_sites):
    rng = random.Random(n_sites)
    common = [f"one of the common lines {i}" for i in range(4)] + ["All rights reserved.", "Yes.", "And so", ""]
    rows = [(i, "\n".join(rng.choice([*common, f" own line number {i} here", "one of the common lines 1 \r"]) for _ in range(rng.randrange(0, 7))), "en", rng.choice([*(f"s{k}" for k in range(n_sites - 1)), None])) for i in range(90)]
    rows += [(100 + i, f"rare line on some sites only\nspread {i}", "en", f"s{i % max(1, n_sites // 4)}") for i in range(20)]
    rows += [(300, None, "en", None), (301, "", "en", None), (None, "one of the common lines 1", "en", None), (302, "word " * 50_000 + "\n" + "x" * 300_000, "en", None)]
    got = line_dedup.remove_boilerplate(make(spark, rows)).collect()
    assert Counter(map(tuple, got)) == slow_lines(rows)
    assert line_dedup.remove_boilerplate(no_docs).count() == 0


def test_spread_is_exact_near_the_threshold(spark):
    lines = spark.range(3000).select((F.col("id") % 30).alias("line"), F.floor(F.col("id") / 30).alias("k")).where("k < 35 + line").select("line", F.lit(50).alias("need"), F.col("k").alias("site"))
    got = {r["line"] for r in line_dedup.boilerplate(lines.unionByName(lines), lg_k=6).collect()}
    assert got == {i for i in range(30) if 35 + i >= 50}


# --- 5 exact dedup -----------------------------------------------------------------------------------------


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def test_exact(spark, odd_docs, no_docs):
    index = fresh_index(spark)
    got = digest_index.dedup(odd_docs, index, "b1").collect()
    rows = odd_docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[plain(r["text"])].append(r)
    assert len(got) == len(rows) and sum(r["kept"] for r in got) == len(groups)
    for key, members in groups.items():
        first = min(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        digest = hashlib.sha256(key.encode()).hexdigest()
        mine = [r for r in got if r["text_sha256"] == digest]
        assert len(mine) == len(members) and {r["keep_id"] for r in mine} == {first["doc_id"]} and {r["group_size"] for r in mine} == {len(members)}
        assert [r["doc_id"] for r in mine if r["kept"]] == [first["doc_id"]]
    # the same batch again changes nothing; a later one finds all of it in the index
    again = digest_index.dedup(odd_docs, index, "b1").collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got)) and index.read().count() == len(groups)
    later = digest_index.dedup(odd_docs.unionByName(make(spark, [(900, "wholly new text", "en", "s")])), index, "b2")
    assert [r["doc_id"] for r in later.where("kept").collect()] == [900] and index.read().count() == len(groups) + 1
    assert digest_index.dedup(no_docs, index, "b3").count() == 0
    found = digest_index.dedup(odd_docs, fresh_index(spark), "x")
    kept = keep_rows(odd_docs, found.where("kept"), found)
    assert kept.count() == len(groups) and kept.columns == odd_docs.columns


def test_an_index_is_opened_again_and_compacted(spark, odd_docs):
    index = fresh_index(spark)
    digest_index.dedup(odd_docs.where("doc_id < 30"), index, "b1")
    digest_index.dedup(odd_docs.where("doc_id between 30 and 60"), index, "b2")
    spark.sql(f"DROP TABLE {index.name}")  # an external table: its folder stays, as after the session's end
    again = digest_index.DigestIndex(spark, index.path, f"{index.name}_again")
    small = again.compacted(f"{index.path}-small", f"{index.name}_small")
    rows = Counter(map(tuple, again.read().collect()))
    assert rows and Counter(map(tuple, small.read().collect())) == rows
    assert len(set(small.read().inputFiles())) <= 64 < len(set(again.read().inputFiles())) or len(rows) < 64
    for opened in (again, small):
        got = digest_index.dedup(odd_docs, opened, "b3").collect()
        old = {plain(r["text"]) for r in odd_docs.where("doc_id <= 60").collect()}
        assert {hashlib.sha256(k.encode()).hexdigest() for k in old} == {r["text_sha256"] for r in got if r["in_index"]}
        batch = opened.read().select("digest").groupBy("digest").count()
        assert "Exchange hashpartitioning" not in batch._jdf.queryExecution().executedPlan().toString()


def test_index_is_not_moved(spark, odd_docs):
    index = fresh_index(spark)
    digest_index.dedup(odd_docs, index, "b1")
    batch = index.read().select("digest").groupBy("digest").count()
    plan = batch.join(index.read().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 0


# --- 6 quality rules ---------------------------------------------------------------------------------------


def slow_counts(text):
    w = words_of(text)
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, odd_docs, no_docs):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["a", "b", " ", " ", "\n", "#", "é"]) for _ in range(rng.randrange(120))), "en", "s") for i in range(80)]
    docs = odd_docs.unionByName(make(spark, rows))
    got = quality_rules.judge(docs).collect()
    want = Counter()
    for r in docs.collect():
        c = slow_counts(r["text"])
        want[(r["doc_id"], *c, c[0] < 10 or 100 * c[4] > 20 * c[0])] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert not any(r["kept"] and r["base_failed"] for r in got)
    assert quality_rules.judge(no_docs).count() == 0


def test_outliers_go(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(40, 300))), "en", "s") for i in range(400)]
    rows += [(1000 + i, " ".join(word() + "###" for _ in range(100)), "en", "s") for i in range(80)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(make(spark, rows)).collect()}
    assert all(got[i] for i in range(400)) and not any(got[1000 + i] for i in range(80))


# --- 7 packing ---------------------------------------------------------------------------------------------


def test_encoder_gives_the_ids_of_the_json_file():
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = packing.exact_encoder("byte_bpe_50k")
    texts = ["", " ", "a  b\n\n c\t", "<|endoftext|> x", "Élan vital, d'où 12345 !!??", "日本語 текст 🎉🎉", "x" * 3000, "it's we'll \r\n\r\n end   ", " nbsp em"]
    assert [list(fast(t)) for t in texts] == [slow.encode(t, add_special_tokens=False).ids for t in texts]


def test_packed_ids_are_those_of_the_json_file(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    exact = packing.exact_encoder("byte_bpe_50k")
    assert exact("hello <|endoftext|> bye") == [31373, 220, 50256, 33847]
    texts = ["hello <|endoftext|> bye", "<|endoftext|><|endoftext|>\n", "<|endoftext| > x", " " * 1_000_000 + "word", "a" + "\n" * 1_000_000 + "b", "\t \u3000\n" * 300_000, " " * 150_000 + "x", "a  b\n\n c\t"]
    want = Counter()
    for i, t in enumerate(texts):
        ids = slow.encode(t, add_special_tokens=False).ids
        assert list(exact(t)) == ids
        want[i, 0, 0, len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())] += 1
    got = packing.pack_documents(make(spark, [(i, t, "en", "s1") for i, t in enumerate(texts)]), 2_000_000).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want


def test_local_search_empties_bins():
    # best fit leaves three bins here where two hold all: 6+4 and 5+5
    assert len(packing.local_search([[0, 2], [1], [3]], [6, 4, 3, 7], 10)) == 2
    sizes = [5, 4, 4, 3, 2, 2]
    assert len(packing.local_search([[0, 1], [2, 3], [4, 5]], sizes, 10)) == 2
    rng = random.Random(6)
    for _ in range(200):
        sizes = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 40))]
        got = packing.pack(sizes, 60)
        assert sorted(i for b in got for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 60 for b in got)
        assert len(got) <= len(packing.best_fit(sizes, 60))


def gaining(bins, sizes, room):
    """Whether any exchange of the kinds between any two bins, tried one by one, raises the sum of squared fills."""
    fill = [sum(sizes[i] for i in b) for b in bins]
    for a, b in itertools.permutations(range(len(bins)), 2):
        kinds = [((i,), back) for i in bins[a] for back in [(), *itertools.combinations(bins[b], 1), *itertools.combinations(bins[b], 2)]]
        kinds += [(two, (i,)) for two in itertools.combinations(bins[a], 2) for i in [*bins[b]]]
        for gives, back in kinds:
            g = sum(sizes[i] for i in gives) - sum(sizes[i] for i in back)
            if 0 < g <= room - fill[b] and (fill[b] + g) ** 2 + (fill[a] - g) ** 2 > fill[a] ** 2 + fill[b] ** 2:
                return True
    return False


def test_local_search_ends_where_nothing_gains():
    rng = random.Random(16)
    ended = 0
    for _ in range(150):
        room = rng.choice([20, 60, 97])
        sizes = [rng.randrange(1, room) for _ in range(rng.randrange(2, 30))]
        order = rng.sample(range(len(sizes)), len(sizes))
        bins = []  # first fit in an order that is not that of the sizes
        for i in order:
            at = next((b for b in bins if sum(sizes[k] for k in b) + sizes[i] <= room), None)
            bins.append([i]) if at is None else at.append(i)
        got = packing.local_search(bins, sizes, room)
        assert sorted(i for b in got for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= room for b in got)
        fewest = -(-sum(sizes) // room)
        assert len(got) == fewest or not gaining(got, sizes, room)
        ended += len(got) > fewest
    assert ended > 20


def test_local_search_empties_many_bins_of_a_poor_start():
    rng = random.Random(17)
    sizes = [min(1023, int(rng.lognormvariate(6, 0.7)) + 1) for _ in range(4000)]
    bins, at = [], 0
    for i in range(len(sizes)):  # next fit
        if bins and at + sizes[i] <= 1024:
            bins[-1].append(i)
        else:
            bins.append([i])
            at = 0
        at += sizes[i]
    got, fewest = packing.local_search(bins, sizes, 1024), -(-sum(sizes) // 1024)
    assert len(bins) > 1.2 * fewest and len(got) < 1.01 * fewest


def test_packing(spark, odd_docs, no_docs):
    fast, want = packing.encoder("byte_bpe_50k"), Counter()
    for r in odd_docs.collect():
        ids = np.array([*fast(r["text"] or ""), 2], "<u4")
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids), 64), len(ids)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r["doc_id"], i, a, b - a, zlib.crc32(ids[a:b].tobytes())] += 1
    for per_group in (8192, 16):
        got = packing.pack_documents(odd_docs, 64, per_group=per_group).collect()
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        bins = defaultdict(list)
        for r in got:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for b in bins.values():
            b.sort()
            assert all(x[0] + x[1] == y[0] for x, y in zip(b, b[1:])) and b[0][0] == 0 and sum(b[-1]) <= 64
        fewest = -(-sum(r["length"] for r in got) // 64)
        assert len(bins) <= fewest + 2
    assert packing.pack_documents(no_docs).count() == 0


# --- 8 quality classifier ----------------------------------------------------------------------------------


def test_rules_from_trees():
    text = "Tree 0 (weight 1.0):\n  If (feature 0 <= 0.5)\n   If (feature 1 <= 2.0)\n    Predict: 0.0\n   Else (feature 1 > 2.0)\n    Predict: 1.0\n  Else (feature 0 > 0.5)\n   Predict: 1.0\n"
    rules = rule_ensemble.tree_rules(text, ["a", "b"])
    assert [r.conditions for r in rules] == [(("a", False, 0.5),), (("a", False, 0.5), ("b", False, 2.0)), (("a", False, 0.5), ("b", True, 2.0)), (("a", True, 0.5),)]


def slow_statistics(text):
    t, w = text or "", words_of(text)
    lines = [x for x in t.split("\n") if words_of(x)]
    n, chars = max(len(w), 1), max(len(t), 1)
    share = lambda cs: sum(c in cs for c in t) / chars
    return {
        "log_words": math.log1p(len(w)), "word_length": len(plain(t)) / n, "symbols": share("#*$%&|<>"), "exclamations": share("!?"), "digits": share("0123456789"),
        "upper": sum(unicodedata.category(c) == "Lu" for c in t) / chars, "stops": sum(c in ".,;:" for c in t) / n, "lines": t.count("\n") / n,
        "dup_lines": (len(lines) - len(set(lines))) / n, "distinct_words": len(set(w)) / n, "adjacent_repeats": sum(x == y for x, y in zip(w, w[1:])) / n,
    }


def test_scores_against_rules_one_by_one(spark, odd_docs):
    rng = random.Random(19)
    texts = ["".join(rng.choice(["a", "Bb", "bb", " ", " ", "\n", "#", "!", "7", ".", "É", "ß"]) for _ in range(rng.randrange(150))) for _ in range(80)]
    docs = odd_docs.unionByName(make(spark, [(500 + i, t, "en", "s") for i, t in enumerate(texts)] + [(700, "w " * 100_000 + "x" * 300_000 + "\n" * 1000, "en", "s")]))
    rows = docs.collect()
    stats = [slow_statistics(r["text"]) for r in rows]
    got = rule_ensemble.with_statistics(docs.select("doc_id", "text"), "text").collect()
    key = lambda d, s: (-1 if d is None else d, *(round(s[k], 9) for k in rule_ensemble.NAMES))
    assert sorted(key(r["doc_id"], r) for r in got) == sorted(key(r["doc_id"], s) for r, s in zip(rows, stats))
    rules = [rule_ensemble.Rule(tuple((k, rng.random() < 0.5, rng.choice(stats)[k]) for k in rng.sample(rule_ensemble.NAMES, rng.randrange(1, 4)))) for _ in range(25)]
    model = rule_ensemble.RuleModel(tuple((r, rng.uniform(-2, 2)) for r in rules), 0.3)
    holds = lambda r, s: all(s[k] > x if greater else s[k] <= x for k, greater, x in r.conditions)
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], round(1 / (1 + math.exp(-0.3 - sum(w for rule, w in model.rules if holds(rule, s)))), 9)) for r, s in zip(rows, stats))
    scored = rule_ensemble.score(docs, model).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], round(r["score"], 9)) for r in scored) == want
    assert all(r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in scored)


def test_classifier_held_out(spark, odd_docs, no_docs):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = rule_ensemble.train(docs, labels, trees=8)
    got = rule_ensemble.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in got) >= 0.95 * len(got)
    odd = rule_ensemble.score(odd_docs, model).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    assert rule_ensemble.score(no_docs, model).count() == 0
    empty = rule_ensemble.train(no_docs, labels.limit(0))
    assert {r["score"] for r in rule_ensemble.score(odd_docs, empty).collect()} == {0.5}


# --- 9 language ID -----------------------------------------------------------------------------------------


def test_forward_sums_all_segmentations():
    pieces = ("a", "ab", "b", "ba", "▁", "▁a")
    lattice = language_id.Lattice(tuple(sorted(pieces)))
    rng = np.random.default_rng(1)
    probs = rng.random((6, 2))
    table = lattice.table(probs)

    def total(word, k):
        if not word:
            return 1.0
        out = 0.0
        for n in (1, 2):
            if len(word) >= n:
                p = word[:n]
                out += (probs[lattice.ids[p], k] if p in lattice.ids else language_id.UNKNOWN if n == 1 else 0.0) * total(word[n:], k)
        return out

    for word in ("▁abab", "▁aab", "▁bxa", "x", "▁" + "ab" * 7):
        want = [math.log(total(word, k)) for k in (0, 1)]
        assert np.allclose(lattice.log_probs([word], table)[0], want) and np.allclose(lattice._long(word, table), want)
    long = "ab" * 600
    assert np.isfinite(lattice.log_probs([long], table)).all()


def test_expected_counts_are_segmentation_averages():
    lattice = language_id.Lattice(("a", "aa"))
    got, log_p = lattice.expected(["aa"], np.array([3.0]), np.array([0.5, 0.25]))
    assert np.allclose(got, [3.0 * 2 * 0.5, 3.0 * 0.5]) and math.isclose(log_p, 3 * math.log(0.5))  # a a and aa are equally likely


def test_expected_counts_of_long_words_equal_those_of_short_ones(monkeypatch):
    rng = random.Random(13)
    pieces = tuple(sorted({"".join(rng.choice("ab") for _ in range(rng.randrange(1, 6))) for _ in range(25)} | {"a"}))
    lattice, probs = language_id.Lattice(pieces), np.random.default_rng(2).random(len(pieces)) / len(pieces)
    many = ["".join(rng.choice("abx") for _ in range(rng.randrange(1, 31))) for _ in range(40)]
    counts = np.array([float(rng.randrange(1, 9)) for _ in many])
    short, p = lattice.expected(many, counts, probs)
    monkeypatch.setattr(language_id, "_BATCHED", 0)
    long, q = lattice.expected(many, counts, probs)
    assert np.allclose(short, long) and math.isclose(p, q)
    total, log_p = lattice.expected(["ab" * 20_000], np.array([2.0]), probs)
    assert np.isfinite(total).all() and np.isfinite(log_p) and total @ np.array([len(x) for x in pieces]) <= 2 * 40_000 + 1e-3


def test_a_language_without_spaces_is_learnt(spark):
    rng = random.Random(14)
    rows = [(i, "".join(rng.choice(("ka", "mo", "ti") if i % 2 else ("gre", "blo", "stu")) for _ in range(60)), "xx" if i % 2 else "yy", "s") for i in range(120)]
    model = language_id.train(make(spark, rows))
    got = make(spark, rows).withColumn("p", language_id.predict(spark, model, F.col("text"))).collect()
    assert all(r["p"]["lang_pred"] == r["lang"] and r["p"]["score"] > 0.9 for r in got)


def test_language_held_out(spark, odd_docs, no_docs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs, max_train=200)
    got = docs.withColumn("p", language_id.predict(spark, model, F.col("text"))).where(F.crc32(F.col("doc_id").cast("string")) % 3 == 1).collect()
    assert sum(r["p"]["lang_pred"] == r["lang"] for r in got) >= 0.98 * len(got)
    odd = odd_docs.withColumn("p", language_id.predict(spark, model, F.col("text"))).collect()
    for r in odd:
        assert (r["p"]["lang_pred"] == "und") == (not any(map(str.isalpha, r["text"] or ""))) and 0 <= r["p"]["score"] <= 1
    assert language_id.train(no_docs) is None
    assert no_docs.withColumn("p", language_id.predict(spark, None, F.col("text"))).count() == 0


# --- 10 mixing ---------------------------------------------------------------------------------------------


def slow_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    goal, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = goal - sum(2 * sizes[s] for s in full)
        level = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= over


def test_mixing(spark, odd_docs, no_docs):
    for docs, per_range in ((odd_docs, 4096), (odd_docs, 4), (spark.read.parquet(f"{SF}/documents.parquet"), 16)):
        rows = docs.collect()
        sizes = Counter()
        for r in rows:
            sizes[r["source"]] += len(words_of(r["text"]))
        want = slow_targets(sizes)
        got = mixing.mix(docs, per_range=per_range).collect()
        assert Counter((r["doc_id"], r["size"], r["source"]) for r in got) == Counter((r["doc_id"], len(words_of(r["text"])), r["source"]) for r in rows)
        taken, largest = Counter(), Counter()
        for r in got:
            assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], want[r["source"]], rel_tol=1e-9, abs_tol=1e-9)
            assert 0 <= r["taken"] <= 2 * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
            taken[r["source"]] += r["taken"]
            largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert all(abs(taken[s] - want[s]) <= largest[s] / 2 + 1e-6 for s in sizes)
        assert Counter(map(tuple, mixing.mix(docs, per_range=per_range).collect())) == Counter(map(tuple, got))
    assert mixing.mix(no_docs).count() == 0


def slow_mix(rows):
    """taken of each row: bins, tails, keys, one sort a source."""
    cut = lambda bins, part, whole: min(bins, math.floor(bins * part / max(whole, 1)))
    binned = []
    for r in rows:
        t, w = r["text"] or "", words_of(r["text"])
        binned.append((cut(1000, sum(c in "#*$%&|<>!0123456789" for c in t), len(t)), min(500, math.floor(10 * len(plain(t)) / max(len(w), 1))), cut(100, len(set(w)), len(w))))
    n, keyed = len(rows), []
    for r, (a, b, c) in zip(rows, binned):
        far = (sum(x[0] >= a for x in binned), 2 * min(sum(x[1] <= b for x in binned), sum(x[1] >= b for x in binned)), sum(x[2] <= c for x in binned))
        weight = max(0.05, math.prod(min(1.0, f / n / 0.05) for f in far))
        u = (int(hashlib.md5(str("null" if r["doc_id"] is None else r["doc_id"]).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        h = xxhash.xxh64_intdigest((r["text"] or "").encode(), 42)
        keyed.append((-math.log(u) / weight, h - (1 << 64) if h >> 63 else h))
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += len(words_of(r["text"]))
    want, out = slow_targets(sizes), Counter()
    for s in sizes:
        epochs = math.floor(want[s] / sizes[s]) if sizes[s] else 0
        rest, upto = want[s] - epochs * sizes[s], 0
        for _, i in sorted((keyed[i], i) for i, r in enumerate(rows) if r["source"] == s):
            size = len(words_of(rows[i]["text"]))
            upto += size
            more = upto <= rest or (upto - size < rest and 2 * rest >= 2 * upto - size)
            out[rows[i]["doc_id"], rows[i]["source"], size, size * (epochs + more)] += 1
    return out


def test_mix_equals_one_sort_a_source(spark, odd_docs):
    same = make(spark, [(None, "one and the same row here", "en", "hot")] * 300 + [(7, f"text {'x' * (i % 9)} of one id {i % 50}", "en", "hot") for i in range(200)] + [(3000 + i, f"more {i}", "en", "cold") for i in range(500)])
    for docs, per_range in ((odd_docs, 3), (same, 5), (odd_docs.unionByName(same), 64), (spark.read.parquet(f"{SF}/documents.parquet"), 4)):
        got = mixing.mix(docs, per_range=per_range, broadcast_sources=0 if per_range == 64 else 50_000).collect()
        assert Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in got) == slow_mix(docs.collect())


def test_common_level_against_sorting(spark):
    rng = random.Random(11)
    for k in range(6):
        sizes = {i: rng.choice([0, 1, 5, 5, rng.randrange(1, 10_000), 10 ** rng.randrange(1, 9)]) for i in range(rng.choice([1, 7, 300]))}
        want = slow_targets(sizes)
        rows = [(float(2 * s), float((3, 1, 2)[i % 3])) for i, s in sizes.items()]
        level = mixing.common_level(spark.createDataFrame(rows, "cap double, weight double"), 1.5 * sum(sizes.values()), bins=4)
        assert all(math.isclose(min(c, level * w), want[i], rel_tol=1e-9, abs_tol=1e-9) for i, (c, w) in enumerate(rows))
