"""Operators for training data: brute force, round trips, damaged input and the defined edge cases."""

import base64
import gzip
import hashlib
import html
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cachelens.llm import chat_format, decontaminate, html_extract, licenses, mixing, ngram_join, quality, queries, simhash, toxicity, warc
from cachelens.llm.components import components
from cachelens.llm.textops import distinct_sets, ngram_hashes, strings, word_hashes
from cachelens.llm.trie import SetTrie, linked_groups

DATA = "/root/testdata/sf0.001"
FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, "  \t\n ", "en", "a", 3), (4, "one", "en", "a", 3), (4, "one", "en", "a", 3), (None, "no id here at all", "en", "b", 17), (5, "word " * 30000, "en", "b", 150000)]


def edge_docs(spark):
    """Nulls, repeated rows, a very long text, and extra columns that operators use as names themselves."""
    return spark.createDataFrame(EDGES, FIELDS).withColumn("token", F.lit("x")).withColumn("copy", F.lit(7)).withColumn("score", F.lit(None).cast("double"))


def shingles(text, k=5):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    label = {i: i for i, _ in sets}
    changed = True
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and 100 * len(x & y) >= 80 * len(x | y)]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(s), label[i]) for i, s in sets}


def near_docs(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 40, 120]))]
        for _ in range(rng.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            docs.append(" ".join(copy))
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("options", [{}, {"block_tokens": 500, "join_tokens": 400, "join_sets": 3, "bucket_sets": 2}])
def test_ngram_join_equals_brute_force(spark, options):
    docs = near_docs(3)
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), **options).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs)


def test_ngram_join_edges(spark):
    got = ngram_join.ngram_jaccard_join(edge_docs(spark)).collect()
    assert sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in got) == [(0, 1, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (4, 1, 4), (5, 1, 5)]
    assert ngram_join.ngram_jaccard_join(edge_docs(spark).limit(0)).count() == 0


def test_join_blocks_hold_no_more_than_two_blocks_and_the_leader(spark, tmp_path, monkeypatch):
    """300 sets share a first n-gram, and hardly any links: no task may hold them all."""
    rng = random.Random(5)
    hot = [f"h{i}" for i in range(30)]
    docs = [(i, " ".join(hot + [f"w{rng.randrange(10**9)}" for _ in range(6)])) for i in range(300)]
    docs += [(1000 + i, t) for i, t in docs[:50]] + [(2000 + i, t + " tail") for i, t in docs[:40]]
    seen, whole = str(tmp_path / "seen"), ngram_join.join_block

    def counting(percent):
        inner = whole(percent)

        def task(key, rows):
            with open(seen, "a") as f:
                f.write(f"{rows.groupby('star').size().max()}\n")
            return inner(key, rows)

        return task

    monkeypatch.setattr(ngram_join, "join_block", counting)
    got = ngram_join.ngram_jaccard_join(spark.createDataFrame(docs, "doc_id long, text string"), join_sets=30, bucket_sets=20).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs)
    held = [int(x) for x in open(seen)]
    assert len(held) > 20 and max(held) <= 150  # blocks and groups of 30 by hash; the star has 340 sets


def test_first_of_groups(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(1, text), (2, text), (2, "another text than that of the first one"), (4, text + " x"), (4, text + " x"), (None, text), (7, "six words that are not repeated"), (7, "six words that are not repeated"), (None, "no id but words of its own"), (None, "no id but words of its own"), (8, None), (8, ""), (8, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("count", F.lit(1)).withColumn("of_id", F.lit(2))
    got = ngram_join.first_of_groups(d)
    assert got.columns == d.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == sorted([(1, text), (2, rows[2][1]), (7, rows[6][1]), (0, rows[8][1]), (8, ""), (8, ""), (8, "")])
    assert ngram_join.first_of_groups(d.limit(0)).count() == 0


def test_trie_search_equals_brute_force():
    rng = np.random.default_rng(1)
    sets = [np.sort(rng.choice(30, rng.integers(1, 20), replace=False)) for _ in range(60)]
    sizes = np.array([len(s) + rng.integers(0, 3) for s in sets])
    for percent in (50, 80):
        trie = SetTrie(sets, sizes, 30, percent)
        for i, (s, n) in enumerate(zip(sets, sizes)):
            both = np.array([len(np.intersect1d(s, x)) for x in sets])
            assert trie.search(s, i).tolist() == np.flatnonzero((100 * both >= percent * (n + sizes - both)) & (both > 0)).tolist()
    assert linked_groups(sets[:1], sizes[:1], 0, 80).tolist() == [0]


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(None, 1), (100, 99), (99, 98), (98, 97), (100, 99)]
    label = {}
    for a, b in edges:
        if a is not None and a != b:
            label.setdefault(a, a), label.setdefault(b, b)
    for _ in label:
        for a, b in edges:
            if a in label and b in label and a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hashed_words():
    texts = ["", "a B c", None, " x\ty\r\nz ", "Æ é É", "q" * 50]
    words, at = word_hashes(*strings(pa.array(texts)))
    assert np.diff(at).tolist() == [0, 3, 0, 3, 3, 1]
    assert words[1] == word_hashes(*strings(pa.array(["b"])))[0][0] and words[7] != words[8]
    assert np.diff(distinct_sets(*ngram_hashes(words, at, 5, short=True))[1]).tolist() == [0, 1, 0, 1, 1, 1]


def test_html_extraction(spark):
    rows = spark.read.parquet(f"{DATA}/pages.parquet")
    pages = rows.select("page_id", "html").collect()

    def expected(page):
        article = re.search(r"<article>(.*)</article>", page, re.S)[1]
        parts = re.split(r"</?(?:p|h1|br)>", article)
        return " ".join(x for p in parts if (x := " ".join(html.unescape(re.sub(r"<[^>]+>", "", p)).split())))

    got = {r.page_id: r for r in html_extract.extract_pages(rows.withColumn("text", F.lit(1))).collect()}
    assert {k: r.text for k, r in got.items()} == {r.page_id: expected(r.html) for r in pages}
    assert all(r.n_chars == len(r.text) for r in got.values())
    page = """<header><h1>Site</h1></header><div class="sidebar"><p>A side text, with many words in it. And some sentences too.</p></div><div id="main"><h1>Title here</h1>
    <div class="cookie-notice">We use cookies.</div><p>First para &amp; more &#x41;.</p><p>Short.<p>Unclosed <a href=x>link</a> para<script>var a="</p>";</script><div class="ad">Buy</div></div>
    <section id="comments"><article><p>A comment that is long enough to look like text.</p></article></section><form><p>Subscribe</p></form><footer>c</footer>"""
    assert html_extract.main_text(page) == "Title here First para & more A. Short. Unclosed link para"
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", "<p>a < b<p"), (None, "u", "<nav>x</nav>")], "page_id long, url string, html string")
    assert sorted((r.page_id or 0, r.text) for r in html_extract.extract_pages(odd).collect())[:2] == [(0, ""), (1, "")]
    assert html_extract.extract_pages(odd.limit(0)).count() == 0


@pytest.mark.parametrize("page, text", [
    ('<article><p title="abc>Hello there, this is a text.</p><p>More of it.</p></article>', "Hello there, this is a text. More of it."),
    ("<article><p>Area is <math><mi>x</mi></math>.</p><figure><figcaption>A caption.</figcaption></figure><noscript>Fallback text.</noscript></article>", "Area is x. A caption. Fallback text."),
    ("<article><p>One.</p><svg><text>drawn</text><p>Two.</p><p>Three.</p></article>", "One. Two. Three."),
    ("<article><noscript>First.<p>Second.</p><math><mi>y</mi><p>Third.</p></article>", "First. Second. y Third."),
    ("<article><p>a &lt; b <!-- gone --> c<![CDATA[gone]]> 3 < 4</p></article>", "a < b c 3 < 4"),
    ("<article><p>five <a href=\"x>link</a> and <b class=\"y\">rest</b> of it.</p></article>", "five link and rest of it."),
    ("<article><p>Kept.</p><script>var a = '<p>no</p>';", "Kept."),
])
def test_broken_pages(page, text):
    assert html_extract.main_text(page) == text


LONG = " ".join(f"word {i} runs over the quiet hill and back again" for i in range(12)) + "."


@pytest.mark.parametrize("page", [
    "<main><article>{a}<aside><p>BAD {x}</p></aside>{b}<footer><p>BAD {x}</p></footer></article></main>",
    "<main><article>{a}<div class='ad'>BAD {x}</div>{b}<section class='comments'><p>BAD {x}</p><p>BAD {x}</p></section></article></main>",
    "<main><article>{a}{b}</article><article class='comment'><p>BAD {x}</p></article></main>",
    "<article>{a}<form>BAD {x}</form><div role='complementary'>BAD {x}</div><div class='relatedPosts'><p>BAD {x}</p></div>{b}</article>",
    "<body class='with-sidebar no-comments legal'><article class='post tag-social'>{a}{b}</article></body>",
    "<div class='content-sidebar-wrap'><main class='content'>{a}{b}</main><div class='sidebar'><p>BAD {x}</p></div></div>",
    "<form id='page'><div class='menu'>BAD</div><article>{a}{b}</article><div class='reader-comments'>BAD {x}</div></form>",
    "<main><header class='entry-header'>{a}</header>{b}</main><header><p>BAD {x}</p></header>",
    "<article>{a}<p><span class='share'>BAD</span></p><section id='discussion'><h2 id='notice'>A heading</h2>{b}</section></article>",
    "<article>{a}<div class='newsletter-signup'>BAD {x}</div><nav><p>BAD {x}</p></nav><div hidden><p>BAD {x}</p></div>{b}</article>",
    "<div>BAD <a href='x'>home</a></div><div>BAD</div><div>{a}<h2 id='notice'>A heading</h2>{b}</div><div>&copy; 2020 BAD Ltd. All rights reserved.</div>",
    "<table><tr><td>BAD</td><td><a href='x'>BAD</a></td></tr></table><div><div>BAD menu</div></div><div>{a}{b}</div><div><div>Copyright BAD</div></div>".replace("<td>BAD</td>", ""),
])
def test_what_is_not_main_text_goes_however_long(page):
    text = html_extract.main_text(page.format(a=f"<p>First. {LONG}</p>", b=f"<p><b class='tag'>Last.</b> {LONG}</p>", x=LONG))
    heading = "A heading " if "<h2" in page else ""
    assert text == f"First. {LONG} {heading}Last. {LONG}"


def test_hostile_pages_take_linear_time():
    blocks = "".join(f"<p>word {i} is here in a sentence.</p><div class='ad'>Buy {i}</div>" for i in range(8000))
    items = "".join(f"<li>word {i}</li><li><a>link</a></li>" for i in range(15000))
    pages = [f"<article>{blocks}</article>", f"<main>{items}</main>", "<div><p>a</p>" * 60000, "<a \"" * 250000, "<" * 1000000, "<textarea>" * 100000, "</" * 500000, "<!--" * 250000, '<p x=">' * 140000, "<b>" * 100000 + "<p>x" * 100000, "<i>" * 50000 + "</u>" * 200000]
    for page in pages:
        began = time.process_time()
        html_extract.main_text(page)
        assert time.process_time() - began < 5, page[:20]


def test_minimum_cut_is_least():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randrange(2, 9)
        costs = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(i, i + 1, rng.uniform(0, 2)) for i in range(n - 1)] + [(*rng.sample(range(n), 2), rng.uniform(0, 2)) for _ in range(rng.randrange(n))]

        def total(label):
            return sum(abs(c) for c, x in zip(costs, label) if (c > 0) != x) + sum(w for a, b, w in edges if label[a] != label[b])

        least = min(total([m >> i & 1 == 1 for i in range(n)]) for m in range(1 << n))
        assert total(html_extract.minimum_cut(costs, edges)) == pytest.approx(least)


def test_simhash(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = sorted((r.doc_id, r.text) for r in rows.collect())
    got = {r.doc_id: r for r in simhash.edit_likeness(rows.repartition(5)).collect()}
    for k, (i, t) in enumerate(docs):
        after = docs[(k + 1) % len(docs)][1]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
    assert len({r.fingerprint for r in got.values()}) <= len({t for _, t in docs})
    assert np.mean([r.near_edited for r in got.values()]) > np.mean([r.near_next for r in got.values()]) + 0.1
    edges = simhash.edit_likeness(edge_docs(spark)).collect()
    assert len(edges) == len(EDGES) and all(0 <= r.near_edited <= 1 for r in edges)
    one = simhash.edit_likeness(edge_docs(spark).filter("doc_id = 5")).first()
    assert one.near_next == 1.0 and one.n_chars == 150000
    assert simhash.edit_likeness(edge_docs(spark).limit(0)).count() == 0


def plain_simhash(text):
    """Votes term by term and bit by bit."""
    raw, at = strings(pa.array([text]))
    terms, _ = ngram_hashes(*word_hashes(raw, at), simhash.TERM_WORDS, short=True)
    names, counts = np.unique(terms, return_counts=True)
    votes, mask = [0] * 128, (1 << 64) - 1
    for name, count in zip(names.tolist(), counts.tolist()):
        weight = round(256 * (1 + float(np.log(count))))
        for half, salt in enumerate((0x1234567, 0x89ABCDEF)):
            x = name ^ salt
            x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
            x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
            word = (x ^ x >> 31).to_bytes(8, "little")
            for b in range(64):
                votes[64 * half + b] += weight if word[b // 8] >> (7 - b % 8) & 1 else -weight
    return f"{int(''.join('1' if v > 0 else '0' for v in votes), 2):032x}"


def test_fingerprints_equal_a_plain_model():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in (1, 2, 3, 10, 200, 6000)]
    assert simhash.hexed(simhash.fingerprints(pa.array(texts))) == [plain_simhash(t) for t in texts]
    assert simhash.hexed(simhash.fingerprints(pa.array(["", None]))) == ["0" * 32] * 2


@pytest.mark.parametrize("radius, cell", [(1, 4096), (2, 4096), (3, 3), (5, 4096)])
def test_near_fingerprints_equal_brute_force(spark, radius, cell):
    rng = random.Random(6)
    prints = [rng.getrandbits(128) for _ in range(30)]
    for p in prints[:20]:
        x = p
        for b in rng.sample(range(128), rng.randrange(8)):
            x ^= 1 << b
        prints.append(x)
    prints += [prints[0] ^ (1 << b) for b in range(25)]  # a hot bucket
    table = spark.createDataFrame([(f"{p:032x}",) for p in [*prints, prints[0]]] + [(None,)], "fingerprint string")
    got = {r.fingerprint: r for r in simhash.near_fingerprints(table, radius, cell).collect()}
    every = sorted({f"{p:032x}" for p in prints})
    near = {a: [b for b in every if b != a and (int(a, 16) ^ int(b, 16)).bit_count() <= radius] for a in every}
    assert {a: r.n_near for a, r in got.items()} == {a: len(x) for a, x in near.items()}
    label = {a: a for a in every}
    for _ in every:
        for a in every:
            label[a] = min([label[a], *(label[b] for b in near[a])])
    pairs = {(a, b): label[a] == label[b] for a in every for b in every}
    assert pairs == {(a, b): got[a].group == got[b].group for a in every for b in every}


def test_near_documents(spark):
    text = " ".join(f"w{i}" for i in range(3000))
    docs = [(1, text), (2, text + " end"), (3, text), (4, "other words here"), (5, None), (None, ""), (None, text), (6, "x " * 30000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("group", F.lit(1))
    got = {(r.doc_id, r.class_id) for r in simhash.near_documents(d).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (None, 5), (None, 1), (6, 6)}
    assert simhash.near_documents(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        simhash.near_fingerprints(d.select(F.lit("0" * 32).alias("fingerprint")), 128)


def test_mixing(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 3600, "big").when(F.col("id") < 3990, "mid").alias("source"))
    targets = spark.createDataFrame([("big", 1.0), ("mid", 1.0), (None, 2.0)], "source string, weight double")
    rows = mixing.mix_sources(docs, targets).groupBy("source").count().collect()
    share = {r["source"]: r["count"] for r in rows}
    assert share["big"] == pytest.approx(1000, rel=0.15) and share["mid"] == pytest.approx(1000, rel=0.15) and share[None] == pytest.approx(2000, rel=0.2)
    again = mixing.mix_sources(docs, targets).orderBy("position").select("doc_id", "copy").collect()
    assert again == mixing.mix_sources(docs.repartition(7), targets).orderBy("position").select("doc_id", "copy").collect()
    clash = edge_docs(spark).withColumn("pieces", F.lit(1)).withColumn("cdf", F.lit("c")).withColumn("mean_source", F.lit(2)).withColumn("copies", F.lit(9))
    assert {"pieces", "cdf", "mean_source", "copies"} <= set(mixing.mix_sources(clash).columns) and {r.copies for r in mixing.mix_sources(clash).collect()} == {9}
    out = mixing.mix_sources(edge_docs(spark))
    assert set(out.columns) == {*FIELDS.replace(" long", "").replace(" string", "").split(", "), "token", "score", "copy", "position"}
    assert out.collect() is not None and mixing.mix_sources(edge_docs(spark).limit(0)).count() == 0


def crc(i):
    return zlib.crc32(str(i).encode()) % 5


def test_toxicity(spark):
    rng = random.Random(8)
    bad = ["vile", "rotten", "nasty"]
    docs, labels = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = [f"w{rng.randrange(500)}" for _ in range(30)]
        if toxic:
            words[rng.randrange(30)] = rng.choice(bad).upper() + "!!"
        docs.append((i, " ".join(words)))
        labels.append((i, 0, int(toxic)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string").withColumn("label", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(d, lab).collect()
    assert all(r.held_out == (crc(r.doc_id) == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 3 == 0) for r in held]) > 0.97
    flipped = lab.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.toxicity(d, flipped).collect()} == {r.doc_id: r.score for r in got}
    none = toxicity.toxicity(edge_docs(spark), lab.limit(0)).collect()
    assert len(none) == len(EDGES) and {r.score for r in none} == {0.5}
    assert toxicity.drop_toxic(edge_docs(spark).limit(0), lab).count() == 0
    assert toxicity.drop_toxic(d, lab).columns == d.columns


def test_quality(spark):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(500):
        good = i % 2
        words = [f"w{rng.randrange(300)}" for _ in range(60)]
        text = " ".join(words) if good else " ".join(w + rng.choice(["***", "%%%"]) for w in words[:20] * 3)
        docs.append((i, text, "en", f"s{i % 3}", len(text)))
        if i % 5 < 3:
            labels.append((i, good, 0))
    d, lab = spark.createDataFrame(docs, FIELDS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.quality(d, lab).collect()
    assert np.mean([r.keep == (r.doc_id % 2 == 1) for r in got]) > 0.97
    kept = quality.drop_low_quality(d, lab)
    assert kept.columns == d.columns and kept.count() == sum(r.keep for r in got)
    assert {r.score for r in quality.quality(edge_docs(spark), lab.limit(0)).collect()} == {0.5}
    # Rows that share a doc_id, and rows in another order, change nothing: the same text is learnt from.
    twice = d.unionByName(d.filter("doc_id % 7 = 0").withColumn("text", F.concat("text", F.lit(" more"))))
    again = [{(r.doc_id, round(r.score, 6)) for r in quality.quality(x, lab).collect()} for x in (twice, twice.orderBy(F.desc("text")).repartition(3))]
    assert again[0] == again[1]
    assert quality.drop_low_quality(edge_docs(spark), lab).count() <= len(EDGES) and quality.quality(d.limit(0), lab).count() == 0


def brute_surest(rows, odds, learnt, given):
    """What a view gives away: (text, mark), the surest texts of either sign."""
    seen = {}
    for (text, key), o in zip(rows, odds):
        if key not in learnt and abs(o) > quality.SURE:
            seen[key] = o
    order = sorted(seen, key=lambda k: seen[k])
    return set([k for k in reversed(order) if seen[k] > 0][:given]), set([k for k in order if seen[k] < 0][:given])


def test_co_training_takes_the_surest_of_all_rows(spark):
    rng = random.Random(13)
    docs = []
    for i in range(900):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        docs.append((i, " ".join(w + "#$%"[: rng.randrange(4)] for w in words) if i % 3 else " ".join(words), "en", f"s{i % 3}"))
    docs += [(1000 + i, docs[0][1], "en", "s0") for i in range(300)]  # copies are given once
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    keyed = quality.view_columns(d).withColumn("text_key", quality.text_key())
    rng = np.random.default_rng(3)
    model = {"w0": rng.normal(0, 0.2, quality.CONTENT).astype(np.float32), "w1": rng.normal(0, 1, 9 + quality.SOURCES).astype(np.float32), "rest": np.array([0, 0, 1, 0, 1, 0, 0.5])}
    rows = [(r.text, r.text_key) for r in keyed.orderBy("doc_id").collect()]
    learnt = [rows[1][1], rows[2][1]]
    got = quality.surest(keyed.repartition(5), model, learnt, 40)
    odds = quality.raw_odds(pa.table({k: [x[j] for x in docs] for k, j in (("text", 1), ("lang", 2), ("source", 3))}), model)
    for v in (0, 1):
        good, bad = brute_surest(rows, odds[v], learnt, 20)
        assert {r[1] for r in got if r[2] == 1 - v and r[3] == 1} == good and {r[1] for r in got if r[2] == 1 - v and r[3] == 0} == bad


def test_ftrl_equals_a_plain_model():
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 50, 12)).astype(np.uint32) for _ in range(60)]
    labels = np.array([float(3 in r) for r in rows])
    at, w, bias = toxicity.fit_ftrl(rows, labels, np.ones(60))
    z, n, b, bn = {}, {}, 0.0, 0.0

    def weight(k):
        s = z.get(k, 0.0)
        return 0.0 if abs(s) <= toxicity.L1 else -(s - toxicity.L1 * np.sign(s)) / ((toxicity.BETA + n[k] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for r, y in zip(rows, labels):
            ws = {k: weight(k) for k in r.tolist()}
            g = 1 / (1 + np.exp(-(b + sum(ws.values())))) - y
            for k, x in ws.items():
                before = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - ((before + g * g) ** 0.5 - before**0.5) / toxicity.ALPHA * x
                n[k] = before + g * g
            bn += g * g
            b -= 0.1 * g / (1 + bn) ** 0.5
    expected = {k: weight(k) for k in z if weight(k)}
    assert expected and dict(zip(at.tolist(), w.tolist())) == pytest.approx(expected) and bias == pytest.approx(b)


def test_toxicity_with_one_label(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("bad "), F.col("id").cast("string")).alias("text"))
    lab = docs.select("doc_id", F.lit(0).alias("quality"), F.lit(1).alias("toxic"))
    assert {r.score for r in toxicity.toxicity(docs, lab).collect()} == {0.5}


def test_decontamination(spark):
    rng = random.Random(10)
    words = [f"v{i}" for i in range(2000)]
    item = [rng.choice(words) for _ in range(30)]
    changed = [w if k % 11 else "other" for k, w in enumerate(item)]
    clean = [rng.choice(words) for _ in range(50)]
    docs = [(1, " ".join(clean + item + clean)), (2, " ".join(clean + changed)), (3, " ".join(clean)), (4, " ".join(item[:8])), (1, "again"), (6, None), (None, " ".join(item).upper())]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit(1)), spark.createDataFrame([(7, " ".join(item)), (8, "too short"), (9, None)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, b).collect()} == {(1, 7), (2, 7), (None, 7)}
    assert sorted((r.doc_id or 0, r.text) for r in decontaminate.decontaminate(d, b).collect())[0] == (1, "again")
    assert sorted(r.doc_id or 0 for r in decontaminate.decontaminate(d, b).collect()) == [1, 3, 4, 6]
    assert decontaminate.contaminated(d.limit(0), b).count() == 0 and decontaminate.contaminated(d, b.limit(0)).count() == 0


def agreeing(text, item, reach=24):
    """Most words that agree on one diagonal within ``reach`` positions of the item, by comparing all."""
    d, t, best = text.split(), item.split(), 0
    for g in range(-len(t) + 1, len(d)):
        same = [0 <= j + g < len(d) and d[j + g] == t[j] for j in range(len(t))]
        best = max(best, *(sum(same[a : a + reach]) for a in range(max(1, len(t) - reach + 1))))
    return best


def test_decontamination_finds_edited_passages(spark):
    rng = random.Random(21)
    words = [f"v{i}" for i in range(3000)]
    items = {n: [rng.choice(words) for _ in range(n)] for n in [*range(8, 25), 40, 61]}
    docs, expected, edited = [], {}, {}
    for n, item in items.items():
        for changes in range(min(n, 24) // 2 + 1):
            for _ in range(6):
                copy = list(item)
                for k in rng.sample(range(n), changes):
                    copy[k] = rng.choice(words)
                at = rng.choice([0, 5])
                text = " ".join([rng.choice(words) for _ in range(at)] + copy + [rng.choice(words) for _ in range(5 - at)])
                docs.append((len(docs), text))
                edited[len(docs) - 1] = (n, changes)
                found = agreeing(text, " ".join(item))
                if found >= min(13, -(-4 * n // 5)):
                    expected[len(docs) - 1, n] = found
    # One word in four, and every second word of 25, substituted.
    for n, step in ((40, 4), (24, 2)):
        item = items[n]
        text = " ".join(w if k % step else "other" for k, w in enumerate(item)) + (" " + item[0] if n == 24 else "")
        docs.append((len(docs), text))
        if agreeing(text, " ".join(item)) >= 13:
            expected[len(docs) - 1, n] = agreeing(text, " ".join(item))
    b = spark.createDataFrame([(n, " ".join(t)) for n, t in items.items()], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), b).collect()}
    assert got == expected
    assert all((d, 15) in got for d, (n, c) in edited.items() if n == 15 and c <= 3)


def test_decontamination_of_short_items_and_long_texts(spark):
    items = [(1, "yes"), (2, "oh no"), (3, "a b c"), (4, "one two three four five six seven"), (5, " "), (6, " ".join(f"z{i}" for i in range(30)))]
    long_text = "filler " * 60000 + items[5][1] + " more" * 60000
    docs = [(1, "Yes"), (2, "yes indeed, yes"), (3, "oh\tno"), (4, "and oh no"), (5, "x a B c y"), (6, "a b x c"), (7, "x one two three four five six seven"), (8, "one two three four five six eight"), (9, long_text), (None, "a b c")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(1, 1): 1, (3, 2): 2, (5, 3): 3, (7, 4): 7, (9, 6): 24, (None, 3): 3}
    assert sorted(r.doc_id for r in decontaminate.decontaminate(d, b).collect()) == [2, 4, 6, 8]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = queries.QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    con.execute(f"SELECT {', '.join(names)} FROM ({queries.ORACLES[name]})")
    assert sorted(map(repr, map(tuple, got.select(names).collect()))) == sorted(map(repr, con.fetchall()))


def test_chat_round_trip(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "a\\b<\\p\n\\n", "", None, "<|", "\\"]
    rows = [(1, k, ["user", "assistant", "sys\ntem\\n<|"][k % 3], t) for k, t in enumerate(texts)] + [(1, 0, "user", "tie"), (None, None, None, None)]
    got = {r.conv_id: r for r in chat_format.conversation_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("tree", F.lit(1))).collect()}
    told = sorted((t, r or "", x or "") for c, t, r, x in rows if c == 1)
    assert got[1].n_turns == len(told)
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in told).encode()).hexdigest()
    own = "".join(x for _, r, x in told if r == "assistant")
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(own), hashlib.sha256(own.encode()).hexdigest())
    assert got[None].n_turns == 1


def test_chat_with_long_texts_and_without_rows(spark):
    long_text = "<|im_end|>\\ " * 60000
    rows = spark.createDataFrame([(1, 0, "user", long_text), (1, 1, "assistant", long_text), (2, 5, "assistant", "a"), (2, 5, "assistant", "a")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat_format.conversation_digests(rows).collect()}
    assert (got[1].loss_chars, got[1].n_turns, got[2].loss_chars) == (len(long_text), 2, 2)
    assert got[1].loss_sha256 == hashlib.sha256(long_text.encode()).hexdigest()
    assert chat_format.conversation_digests(rows.limit(0)).count() == 0


def test_reply_trees(spark):
    rows = [("t", 1, None, "user", "q", 1.0), ("t", 2, 1, "assistant", "bad", 0.0), ("t", 3, 1, "assistant", "good", 5.0), ("t", 4, 3, "user", "more", 1.0), ("u", 1, 9, "user", "lone", None), ("v", 1, 1, "user", "self", 0.0)]
    got = chat_format.format_trees(spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double"), best=2).collect()
    best = {(r.tree, r.branch): r.formatted for r in got}
    assert best["t", 1] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\ngood<|im_end|>\n<|im_start|>user\nmore<|im_end|>\n"
    assert "bad" in best["t", 2] and "lone" in best["u", 1] and ("v", 1) in best
    chain = spark.range(100).select(F.lit("c").alias("tree"), F.col("id").alias("node"), (F.col("id") - 1).alias("parent"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"), F.lit(0).alias("score"))
    assert chat_format.format_trees(chain).first().n_turns == 100


def test_reply_paths_on_cycles_and_upwards(spark):
    rows = [("c", 1, 2), ("c", 2, 1), ("c", 3, 1), ("c", 4, 3), ("c", 5, None), ("c", 6, 5), ("d", 1, 2), ("d", 2, 3), ("d", 3, 4), ("d", 4, 9), ("e", 1, 2), ("e", 2, 1)]
    got = chat_format.reply_paths(spark.createDataFrame(rows, "tree string, node long, parent long")).collect()
    assert sorted(tuple(r) for r in got) == [("c", 6, 5, 1), ("c", 6, 6, 0), ("d", 1, 1, 0), ("d", 1, 2, 1), ("d", 1, 3, 2), ("d", 1, 4, 3)]


def test_reply_path_of_more_than_2_to_20_messages(spark):
    n = 2**20 + 3
    chain = spark.range(n).select(F.lit("c").alias("tree"), F.col("id").alias("node"), (F.col("id") - 1).alias("parent"))
    assert chat_format.reply_paths(chain).agg(F.count("*"), F.max("back"), F.countDistinct("node")).first()[:] == (n, n - 1, n)


def test_license_scan(spark):
    docs = [(1, "x\nReleased under the MIT License.\ny"), (2, "released  UNDER the mit license"), (3, "nothing here to see at all"), (4, None), (4, ""), (None, "Licensed under CC BY-NC 4.0.")]
    got = {(r.doc_id, r.line, r.license) for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string").withColumn("line", F.lit(0))).collect()}
    assert got == {(1, 2, "MIT"), (2, 1, "MIT"), (None, 1, "CC-BY-NC-4.0")}
    assert licenses.scan_licenses(edge_docs(spark).limit(0)).count() == 0


def test_license_scan_near_the_threshold_equals_brute_force(spark):
    rng = random.Random(15)
    texts = [t for ts in licenses.TEMPLATES.values() for t in ts]
    docs = []
    for i in range(240):
        words = rng.choice(texts).split()
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = rng.choice(["word", "the", "license", "under"])
        words += ["more"] * rng.randrange(4)
        docs.append((i, " ".join(words)))
    rows = licenses.template_rows(licenses.TEMPLATES)

    def best(text):
        own = set(licenses.bigrams(licenses.normalised(text)))
        return max((round(2 * len(own & set(g)) / (len(own) + len(g)), 9), name) for name, g in rows)

    expected = {(i, best(t)[1], best(t)[0]) for i, t in docs if best(t)[0] >= licenses.LEAST_DICE}
    assert 30 < len(expected) < 200
    got = licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string"))
    lines = {(r.doc_id, r.license, r.dice) for r in got.collect()}
    assert expected <= lines and {x[0] for x in lines - expected}.isdisjoint({x[0] for x in expected})
    assert licenses.scan_licenses(spark.createDataFrame([(1, "x " * 400000 + "\nReleased under the MIT License.")], "doc_id long, text string")).count() == 1


def test_license_scan_finds_wrapped_and_embedded_notices(spark):
    mit = """The MIT License (MIT)

Copyright (c) 2020 X Y

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
    bsd = """Copyright (c) X. All rights reserved.
# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:
# 1. Redistributions of source code must retain the above copyright notice"""
    gpl = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version."""
    inside = "Copyright 2020 X Y. Released under the MIT License. All rights reserved."
    docs = [(1, mit), (2, bsd), (3, gpl), (4, inside), (5, "some words " * 300 + "Licensed under\nCC BY-NC 4.0. " + "more words " * 300), (6, "Released under the MIT License.\n" + inside), (7, "the license of a person that granted nothing"), (None, inside), (None, inside), (8, None)]
    got = sorted(((r.doc_id or 0, r.line, r.license) for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    assert got == [(0, 1, "MIT"), (0, 1, "MIT"), (1, 5, "MIT"), (2, 2, "BSD-3-Clause"), (3, 2, "GPL-3.0"), (4, 1, "MIT"), (5, 1, "CC-BY-NC-4.0"), (6, 1, "MIT"), (6, 2, "MIT")]


def test_each_license_is_told_from_the_others(spark):
    rows = [(name, t) for name, ts in licenses.TEMPLATES.items() for t in ts]
    rows += [(name, f"before it\n{t}\nafter it") for name, ts in licenses.PASSAGES.items() for t in ts]
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    best = licenses.scan_licenses(docs).groupBy("doc_id").agg(F.max(F.struct("dice", "license")).alias("x"), F.count("*").alias("n")).collect()
    assert {r.doc_id: (r.x.license, r.x.dice, r.n) for r in best} == {i: (name, 1.0, 1) for i, (name, _) in enumerate(rows)}


def test_license_windows_equal_a_plain_model(spark):
    units = licenses.template_rows(licenses.TEMPLATES)
    known = units + licenses.template_rows(licenses.PASSAGES)
    most = {id(g): int(len(g) * (2 - 0.85) / 0.85 + 1e-9) for _, g in known}

    def dice(a, b):
        return round(2 * len(a & b) / (len(a) + len(b)), 9)

    def model(text):
        lines = [licenses.normalised(x) for x in text.split("\n")]
        words = [(k + 1, w) for k, ws in enumerate(lines) for w in ws]
        grams = [f"{a[1]} {b[1]}" for a, b in zip(words, words[1:])]
        notices = {k + 1 for k, ws in enumerate(lines) if len(ws) > 1 and any(dice(set(licenses.bigrams(ws)), set(g)) >= 0.85 for _, g in units)}
        if grams and any(dice(set(grams), set(g)) >= 0.85 for _, g in units):
            return []
        found = []
        for name, g in known:
            at = [i for i, x in enumerate(grams) if x in g]
            for p in at:
                for q in (q for q in at if p <= q < p + most[id(g)]):
                    own = set(grams[p : q + 1])
                    if dice(own, set(g)) >= 0.85 and not notices & {words[i][0] for i in range(p, q + 2)}:
                        found.append((-dice(own, set(g)), p - q, p, name, q))
        taken = []
        for x in sorted(set(found)):
            if all(x[2] > y[4] + 1 or y[2] > x[4] + 1 for y in taken):
                taken.append(x)
        return [(words[x[2]][0], x[3], -x[0]) for x in taken]

    rng = random.Random(11)
    notices = [t for ts in (*licenses.TEMPLATES.values(), *licenses.PASSAGES.values()) for t in ts]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(rng.randrange(1, 7)):
            notice = rng.choice(notices).split()
            if rng.random() < 0.3:
                notice[rng.randrange(len(notice))] = "other"
            words += ["one", "more"][: rng.randrange(3)] + notice + ["\n"][: rng.randrange(2)]
        texts.append(" ".join("\n" if rng.random() < 0.08 else w for w in words))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(7, texts[7])], "doc_id long, text string")
    got = sorted((r.doc_id, r.line, r.license, r.dice) for r in licenses.embedded(docs, known, units, 0.85).collect())
    assert got == sorted((i, *x) for i, t in [*enumerate(texts), (7, texts[7])] for x in model(t))
    assert len(got) > 60


def test_license_scan_of_a_text_with_thousands_of_notices(spark):
    wrapped = "\n".join(f"this work {i} is released under\nthe mit license and more words follow" for i in range(6000))
    rows = spark.createDataFrame([(1, wrapped), (2, "\n".join(["Released under the MIT License."] * 6000))], "doc_id long, text string")
    began = time.time()
    got = licenses.scan_licenses(rows).groupBy("doc_id").count().collect()
    assert {r.doc_id: r["count"] for r in got} == {1: 6000, 2: 6001}
    assert time.time() - began < 60


def test_warc_round_trip(spark):
    rows = [(3, "u", "same"), (1, None, "same"), (1, None, "same"), (5, "http://x\r\ny", "é\r\n\r\nWARC/1.1\r\n"), (6, "u", None), (7, "u", ""), (None, "u", "same"), (9, "u", "w" * 200000)]
    got = sorted(((r.page_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha1", F.lit(1))).collect()), key=repr)
    payload = lambda t: ((t or "").encode(), base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode())
    first = {"same": 1, "": 6}
    expected = []
    for i, _, t in rows:
        smallest = first.get(t or "", i)
        later = i != smallest
        expected.append((i or 0, len(payload(t)[0]), payload(t)[1], "revisit" if later else "response", smallest if later else None))
    assert got == sorted(expected, key=repr)
    assert warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").limit(0)).count() == 0


def test_warc_salvage():
    def record(body, digest=None, kind="response"):
        block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(body) + body
        digest = digest or base64.b32encode(hashlib.sha1(body).digest()).decode()
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    good = [record(b"one"), record(b"two"), record(b"three")]
    for pack in (lambda x: x, gzip.compress):
        parts = [pack(r) for r in good]
        kinds = lambda data: [(x[0], x[3] if x[0] == "record" else x[2]) for x in warc.salvage(data)]
        assert kinds(b"".join(parts)) == [("record", b"one"), ("record", b"two"), ("record", b"three")]
        broken = bytearray(parts[1])
        broken[len(broken) // 2] ^= 0xFF
        data = parts[0] + bytes(broken) + parts[2]
        assert kinds(data) == [("record", b"one"), ("gap", len(parts[1])), ("record", b"three")]
        assert kinds(b"junk" + parts[0] + parts[1][:-6]) == [("gap", 4), ("record", b"one"), ("gap", len(parts[1]) - 6)]
    assert kinds(b"") == [] and [x[0] for x in warc.salvage(record(b"x", "A" * 32))] == ["gap"]


def test_warc_salvage_inside_members():
    def record(body, digest=None):
        block = b"HTTP/1.1 200 OK\r\n\r\n" + body
        digest = digest or base64.b32encode(hashlib.sha1(body).digest()).decode()
        return f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:{digest}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    kinds = lambda data: [(x[0], x[3] if x[0] == "record" else x[2]) for x in warc.salvage(data)]
    bad = record(b"bad", "A" * 32)
    assert kinds(gzip.compress(record(b"one") + bad + record(b"two"))) == [("record", b"one"), ("record", b"two"), ("gap", len(bad))]
    rng = random.Random(1)
    bodies = [rng.randbytes(20000) for _ in range(10)]
    packed = gzip.compress(b"".join(map(record, bodies)))
    cut = packed[: len(packed) * 3 // 4]
    assert kinds(cut) == [*(("record", x) for x in bodies[:7]), ("gap", len(cut))]
    broken = bytearray(packed)
    broken[-6] ^= 1
    got = kinds(bytes(broken) + gzip.compress(record(b"next")))
    assert [x for k, x in got if k == "record"] == [*bodies[:9], b"next"] and sum(k == "gap" for k, _ in got) == 1
    assert kinds(gzip.compress(record(b"one"))) == [("record", b"one")] and kinds(gzip.compress(b"")) == []


def test_warc_salvage_takes_linear_time_and_large_pages_get_files_of_their_own(spark, tmp_path, monkeypatch):
    body = b"HTTP/1.1 200 OK\r\n\r\nx"
    record = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    packed = gzip.compress(record)
    broken = packed[:12] + b"\xff" + packed[13:]
    for data, records in ((packed * 20000, 20000), (broken * 20000, 0), (b"WARC/1.1\r\n" * 30000, 0)):
        began = time.process_time()
        assert sum(x[0] == "record" for x in warc.salvage(data)) == records
        assert time.process_time() - began < 10
    monkeypatch.setattr(warc, "FILE_BYTES", 4000)
    monkeypatch.setattr(warc, "FILE_RECORDS", 4)
    rows = [(i, "u", str(i) * (30 if i % 5 else 1500)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_warc(pages, str(tmp_path / "w"))
    sizes = [(f.stat().st_size, f.read_bytes().count(b"WARC/1.1\r\n")) for f in (tmp_path / "w").glob("part-*")]
    assert sum(n for _, n in sizes) == 40 and max(n for _, n in sizes) <= 4 and all(n <= 2 for size, n in sizes if size > 4000)
    assert warc.archive_pages(pages).count() == 40


def test_pipeline(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    words = [f"w{i}" for i in range(900)]
    rng = random.Random(12)
    item = " ".join(rng.choice(words) for _ in range(25))
    docs, labels = [], []
    for i in range(300):
        text = " ".join(rng.choice(words) for _ in range(60))
        if i % 4 == 0:
            text = " ".join(w + "***" for w in text.split())
        if i % 4 == 1 and i % 8 == 1:
            text += " vile"
        docs.append([i, text, "en", f"s{i % 3}", len(text)])
        labels.append((i, int(i % 4 != 0), int(i % 8 == 1)))
    docs[102][1] = docs[98][1] + " end"
    docs[106][1] += " " + item
    for name, rows, fields in (("documents", docs, FIELDS), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, item)], "item_id long, text string")):
        spark.createDataFrame([tuple(r) for r in rows], fields).write.parquet(f"{tmp_path}/{name}.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns = kept.columns
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == columns
    ids = {r.doc_id for r in kept.collect()}
    clean = {i for i in range(300) if i % 4 and i % 8 != 1} - {102, 106}
    assert len(ids & clean) >= 0.98 * len(clean) and len(ids - clean) <= 3 and not ids & {102, 106}
    assert corpus_pipeline.STAGES[-1][1](spark, kept, str(tmp_path)).count() > 0


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty and repeated rows, a long text and clashing columns go through all stages; equal rows with words once."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    item = " ".join(f"b{i}" for i in range(20))
    rows = [*EDGES, (None, "no id here at all", "en", "b", 17), (1, "clean words that share the id of a dirty row " * 3, "en", "a", 9), (1, item, "en", "a", 9), (None, item, "en", "c", 9)]
    docs = spark.createDataFrame(rows, FIELDS).withColumn("text_key", F.lit(1)).withColumn("of_id", F.lit(2)).withColumn("pieces", F.lit(3))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, kept.limit(0), str(tmp_path)).count() == 0
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name
    texts = sorted((r.doc_id or 0, (r.text or "").strip()[:20]) for r in kept.collect())
    assert texts == [(0, "no id here at all"), (1, ""), (1, "clean words that sha"), (2, ""), (3, ""), (4, "one"), (5, "word word word word ")]
    assert corpus_pipeline.run(spark, str(tmp_path)).columns[: len(docs.columns)] == docs.columns
