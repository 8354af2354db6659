"""The training-data operators: brute force, odd rows, and held-out accuracy on small tables."""

import html
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest
from conftest import plain, rows

import corpus_pipeline
from tidesift.llm import ann, base, entries, graph, htmltext, linededup, lm, mixing, neardup, packing, quality, tokens, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHAPE = "doc_id long, text string, lang string, source string, n_chars long, _t string, words long, node long, key long, size long"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    base.ship(spark)


def words(n, seed, vocabulary=400):
    rnd = random.Random(seed)
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def letters(n, seed):
    """Words without digits, which line templates would take for fields."""
    rnd = random.Random(seed)
    return ["".join(rnd.choice("aeioulnrst") for _ in range(6)) for _ in range(n)]


def odd_rows():
    """Null ids aside, each kind of row that operators must take."""
    long = " ".join(words(30_000, 1))
    a = " ".join(words(120, 2))
    out = [
        (1, a, "src0"), (2, a, "src0"), (3, a.replace(" w1", " W1", 3), "src1"), (4, None, "src1"), (5, "", None), (6, " \n\t ", "src2"), (7, long, "src0"), (8, "one two", "src1"), (9, "ONE two", "src1"),
        (10, "x", None), (11, " ".join(words(120, 2)[:112]) + " q r s", "src0"), (12, "a b c d e\n" * 40, "src2"), (13, "ñandú Éa ß x " * 30, "src2"),
        (14, " ".join(words(90, 3)), "src0"), (14, " ".join(words(90, 3)), "src0"), (15, "the cat sat on the mat today\n" + " ".join(words(60, 4)), "src0"),
        (16, "the cat sat on the mat today\n" + " ".join(words(60, 5)), "src0"), (17, "the cat sat on the mat today\n" + " ".join(words(60, 6)), "src0"),
    ]
    return [(i, t, "en", s, len(t or ""), "clash", 1, 2, 3, 4) for i, t, s in out]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SHAPE).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql("select doc_id, text, source from '/root/testdata/sf0.001/documents.parquet'").fetchall()


# ---------------------------------------------------------------- graph


def test_components_of_a_path_and_of_random_links(spark):
    for seed in range(3):
        rnd = random.Random(seed)
        links = [(i, i + 1) for i in range(40)] if not seed else [(rnd.randrange(60), rnd.randrange(60)) for _ in range(40)]
        root = list(range(100))

        def find(x):
            while root[x] != x:  # noqa: B023
                x = root[x]  # noqa: B023
            return x

        for a, b in links:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {x: find(x) for l in links if l[0] != l[1] for x in l}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 8 and 1: tokens and packing


def test_counts_and_ids_are_the_libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    pieces, ids = tokens.Pieces(entries.tokenizer("piece_bpe_32k.model")), tokens.WordIds(entries.tokenizer("word_bpe_49k.json"), 50)
    sp, hf = sentencepiece.SentencePieceProcessor(model_file=entries.tokenizer("piece_bpe_32k.model")), Tokenizer.from_file(entries.tokenizer("word_bpe_49k.json"))
    rnd = random.Random(3)
    alphabet = [*"aAé.É,;ſßİıΣσςǅñ́̇ \n\t 　'1２½_-<|>", "<|endoftext|>", "<|startoftext|>", "don't ", "  ", "▁", "ﬁ", "ͅ", "</s>", "\n\n", " \n"]
    for _ in range(3000):
        x = "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(14)))
        assert sum(pieces.count(pieces.split(x))) == len(sp.encode(x)), repr(x)
        assert np.frombuffer(ids.encode([x])[0], "<u4").tolist() == hf.encode(x, add_special_tokens=False).ids, repr(x)


def test_token_counts(odd, none):
    import sentencepiece

    path = entries.tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted((r[0], len((r[1] or "").encode()), len(sp.encode(r[1] or "")), len(sp.encode(r[1] or "")) > 100) for r in odd_rows())
    for held in (tokens.HELD, 40, 0):
        assert sorted(tuple(r) for r in tokens.token_counts(odd, path, 100, held).collect()) == want
    assert tokens.token_counts(none, path).count() == 0


def check_packed(found, capacity):
    held = defaultdict(list)
    for r in found:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(held)


def test_packing_round_trip(odd, none, spark):
    from tokenizers import Tokenizer

    path = entries.tokenizer("word_bpe_49k.json")
    hf = Tokenizer.from_file(path)
    ids = {r[0]: [*hf.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in odd_rows()}
    found = packing.pack_documents(odd, path, 512).collect()
    assert sum(r["length"] for r in found) == sum(len(ids[r[0]]) for r in odd_rows())
    for r in found:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == 512 * r["piece"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
    assert check_packed(found, 512) <= -(-sum(r["length"] for r in found) // 512) + 2
    assert packing.pack_documents(none, path, 512).count() == 0
    many = spark.range(3000).selectExpr("id as doc_id", "0 as piece", "cast(if(id % 3 = 0, 100, 1 + id % 90) as bigint) as length", "7 as offset")
    assert check_packed(packing.pack(many, 128, chunk=50).collect(), 128) >= 1000


def test_bin_completion_reaches_the_optimum():
    # best fit alone needs one sequence more here
    assert sum(p.bins for p in packing.complete_bins({6: 1, 5: 2, 4: 1, 3: 2, 2: 2}, 10)) == 3
    rnd = random.Random(1)
    for _ in range(60):
        items = [rnd.randint(1, 20) for _ in range(rnd.randint(1, 9))]
        best = len(items)

        def place(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(items):  # noqa: B023
                best = len(bins)
                return
            for i in range(len(bins)):
                if bins[i] + items[k] <= 20:  # noqa: B023
                    place(k + 1, [*bins[:i], bins[i] + items[k], *bins[i + 1 :]])  # noqa: B023
            place(k + 1, [*bins, items[k]])  # noqa: B023

        place(0, [])
        counts = dict(Counter(items))
        found = packing.complete_bins(counts, 20)
        got = Counter()
        for p in found:
            assert sum(l * n for l, n in p.slots) <= 20
            for l, n in p.slots:
                got[l] += n * p.bins
        assert got == Counter(items) and sum(p.bins for p in found) == best >= packing.lower_bound(counts, 20)


def test_bin_completion_at_any_size():
    # groups of copies of a few lengths that pack without waste: far above any number of pieces that could be searched one by one
    rnd = random.Random(4)
    for copies in (40, 40_000):
        counts = Counter()
        for _ in range(20):
            a, b = rnd.randint(600, 1900), rnd.randint(600, 1400)
            for l in (a, b, 4096 - a - b):
                counts[l] += copies
        found = packing.complete_bins(counts, 4096)
        got = Counter()
        for p in found:
            assert sum(l * n for l, n in p.slots) <= 4096
            for l, n in p.slots:
                got[l] += n * p.bins
        assert got == counts and sum(p.bins for p in found) == 20 * copies < sum(p.bins for p in packing.best_fit(counts, 4096))


def test_dominated_fillings():
    assert packing.dominated((4, 3), 0, 1 << 7) and packing.dominated((4,), 2, 1 << 6) and packing.dominated((4,), 1, 1 << 1)
    assert not packing.dominated((4, 3), 0, 1 << 4 | 1 << 3 | 1 << 1) and not packing.dominated((4,), 1, 1 << 4 | 1 << 6)


# ---------------------------------------------------------------- 2: toxicity


def test_grammar_reads_clauses():
    g = toxicity.Grammar({"moron": 0.9, "blork": 0.9, "blork*": 0.8})
    alone, aimed, after = g.score("blork"), g.score("You are a blork."), g.score("A blork, you.")
    assert g.floor < alone < 0.7 < aimed == after
    assert g.score("you are not a blork") < 0.5 and g.score("he said that you are a blork") < 0.7 and g.score("the word blork in a dictionary") < 0.3
    assert alone < 0.7 < g.score("blork. moron!") and g.score("you blorkish lot") > 0.7
    assert g.score("I will kill you") > 0.7 and g.score("to kill time") == pytest.approx(g.floor) and g.score("") == g.floor and g.score("they never kill you") < 0.5
    assert g.score("you will not hurt") < g.score("you will hurt")


def test_transducers_step():
    t = toxicity.Transducer({(0, "a"): (1, "b", 0.5)}, {1: 0})
    assert t.step(0, "a") == (1, "b", 0.5) and t.step(1, "a") == (0, "a", 1.0) and t.step(0, "x") == (0, "x", 1.0)


def test_toxicity_held_out(spark, none):
    d = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in toxicity.toxicity(base.read(spark, d, "documents"), base.read(spark, d, "labels")).collect()}
    assert len(found) == 1000
    labels = [(r["doc_id"], r["toxic"]) for r in base.read(spark, d, "labels").collect()]
    held = [(found[i], t) for i, t in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(r["held_out"] for r, _ in held)
    assert sum(r["predicted"] == t for r, t in held) >= 0.95 * len(held)
    assert not sum(r["predicted"] for r, t in held if t == 0)


def test_toxicity_odd_rows(spark, odd, none):
    no_labels = spark.createDataFrame([(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(odd, no_labels).collect()
    assert len(found) == len(odd_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in found)
    assert toxicity.toxicity(none, no_labels).count() == 0


# ---------------------------------------------------------------- 3: neighbours


def brute_nearest(vectors, every, k):
    good = {i: np.array(v, float) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in good:
        if q % every == 0:
            s = sorted((-(good[q] * good[i]).sum() / (np.sqrt((good[q] ** 2).sum()) * np.sqrt((good[i] ** 2).sum())), i) for i in good if i != q)
            out[q] = [i for _, i in s[:k]]
    return out


def test_nearest_exact_on_few_and_recall_on_many(spark):
    rnd = np.random.default_rng(1)
    v = [(i, [float(x) for x in rnd.normal(size=8)]) for i in range(120)]
    v += [(200, None), (250, [0.0] * 8), (300, [1.0] * 7 + [None]), (350, [1.0] * 7 + [math.nan]), (400, [1.0] * 7 + [math.inf]), (5, v[5][1])]
    v += [(i, v[50][1]) for i in range(500, 540)]  # copies tie
    df = spark.createDataFrame([(i, x, 1, "c") for i, x in v], "vec_id long, embedding array<double>, rank int, score string")
    got = defaultdict(list)
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert dict(got) == brute_nearest(dict(v).items(), 50, 5)
    assert ann.nearest(df.limit(0)).count() == 0
    d = "/root/testdata/sf0.01"
    e = base.read(spark, d, "embeddings")
    want = brute_nearest([(r["vec_id"], r["embedding"]) for r in e.collect()], 50, 5)
    got = defaultdict(set)
    for r in ann.nearest(e).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert sum(len(got[q] & set(w)) for q, w in want.items()) >= 0.9 * sum(map(len, want.values()))


def test_nearest_in_a_hot_cluster_and_among_scaled_copies(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(4500, 32))
    x[::3] = x[0] + 0.02 * rnd.normal(size=(1500, 32))
    x[1::9] = x[1] * 2.0 ** rnd.integers(-3, 4, 500)[:, None] * (1 + (np.arange(500) % 250 == 7)[:, None] * 1e-3 * rnd.normal(size=(500, 32)))
    ids = rnd.permutation(4500)
    v = [(int(i), [float(y) for y in r]) for i, r in zip(ids, x, strict=True)]
    got = defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(v, "vec_id long, embedding array<double>").repartition(4)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert dict(got) == brute_nearest(v, 50, 5)


def test_nearest_over_several_cells(spark, monkeypatch):
    for name, value in (("CODES", 150), ("QUERIES", 9), ("TABLES", 4), ("RERANK", 12)):
        monkeypatch.setattr(ann, name, value)
    rnd = np.random.default_rng(8)
    x = rnd.normal(size=(1200, 12))
    x[::4] = x[0] + 0.05 * rnd.normal(size=(300, 12))
    v = [(i, [float(y) for y in r]) for i, r in enumerate(x)]
    got = defaultdict(list)
    twice = [*v, (7, [9.0] * 12), (None, [1.0] * 12)]  # of two vectors of one id the lesser counts
    v[7] = (7, min(v[7][1], [9.0] * 12))
    for r in ann.nearest(spark.createDataFrame(twice, "vec_id long, embedding array<double>").repartition(4)).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert dict(got) == brute_nearest(v, 50, 5)


def test_codes_come_near_their_vectors():
    x = np.random.default_rng(2).normal(size=(1500, 16))
    books = ann.train(x, books=6, words=16)
    near = sum(books[m][c] for m, c in enumerate(ann.encode(x, books).T))
    greedy = sum(books[m][c] for m, c in enumerate(ann.encode(x, books, beam=1).T))
    assert ((x - near) ** 2).sum() <= ((x - greedy) ** 2).sum() < 0.5 * (x**2).sum()


# ---------------------------------------------------------------- 4: near-duplicates


def shingle_set(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(docs):
    sets = {i: shingle_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def test_near_duplicates_odd_rows(odd, none):
    want = brute_components([(r[0], r[1]) for r in odd_rows()])
    found = neardup.near_duplicates(odd).collect()
    assert len(found) == len(odd_rows())
    assert all((r["n_shingles"], r["component_id"], r["kept"]) == want[r["doc_id"]] for r in found)
    assert neardup.near_duplicates(none).count() == 0


def test_near_duplicates_of_clashing_ids(spark):
    a, b = (" ".join(words(100, 300 + k, 9000)) for k in range(2))
    df = spark.createDataFrame([(1, a), (1, b), (7, a + " q"), (8, b + " q"), (9, " ".join(words(50, 400, 9000)))], "doc_id long, text string")
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()) == [(1, 1, True), (1, 1, True), (7, 1, False), (8, 1, False), (9, 9, True)]


@pytest.mark.parametrize(("block", "rows_", "pivots"), [(neardup.BLOCK_SHINGLES, neardup.BLOCK_ROWS, neardup.PIVOTS), (300, 128, 1), (10**6, 4, 1), (10**6, 7, 2)])
def test_near_duplicates_brute_force(spark, block, rows_, pivots, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", block)
    monkeypatch.setattr(neardup, "BLOCK_ROWS", rows_)
    monkeypatch.setattr(neardup, "PIVOTS", pivots)
    rnd = random.Random(5)
    docs = []
    for group in range(6):
        text = words(100, group, 3000)
        for _ in range(15):
            w = [f"e{rnd.randrange(9999)}" if rnd.random() < rnd.choice([0, 0.01, 0.03, 0.06]) else x for x in text]
            docs.append((len(docs), " ".join(w)))
    want = brute_components(docs)
    found = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in found} == want


def test_estimates_are_near_the_truth():
    rnd = np.random.default_rng(1)
    off = []
    for _ in range(40):
        common, a, b = (rnd.integers(0, 2**64, n, dtype=np.uint64) for n in (60, 10, 15))
        x, y = neardup.registers(np.concatenate([common, a])), neardup.registers(np.concatenate([common, b]))
        c = neardup.chance(70, 75)
        off.append(((x == y).mean() - c) / (1 - c) - 60 / 85)
    assert abs(np.mean(off)) < 0.03 and 0 < neardup.chance(100, 100) < 0.01


# ---------------------------------------------------------------- 5: pages


def test_extraction_keeps_the_article(spark):
    d = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r for r in base.read(spark, d, "pages").collect()}
    for r in htmltext.extract(base.read(spark, d, "pages")).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r["page_id"]]["html"], re.S)[1]
        want = " ".join(html.unescape(" ".join(re.split(r"<(?!/?b>)[^>]*>", inner)).replace("<b>", "").replace("</b>", "")).split())
        assert r["text"] == want and r["n_chars"] == len(want) and r["url"] == pages[r["page_id"]]["url"]


def test_extraction_odd_pages(spark):
    page = """<html><body class="has-sidebar"><header>Site</header><ul class="main-menu"><li>Home</ul><main><h1>Ti<b>tle</b> &amp; more</h1>
    <p>One<br>two&nbsp;&#8212; thr<i>ee</i><p>four <script>x("</p>")</script><!-- no --><aside>side</aside><div class="cookie-notice">c</div><form>f</form>
    <section id="comments"><p>nice</p></section><table><tr><td>a<td>b</table></main><footer>end</footer>"""
    data = [(1, "http://h/x", page), (2, None, None), (2, None, None), (3, "odd", ""), (4, "http://h/y", "plain &lt;text"), (5, "http://h/z", "<article>unclosed <p>x")]
    df = spark.createDataFrame([(i, u, h, "c", 1) for i, u, h in data], "page_id long, url string, html string, host string, text int")
    got = sorted((r["page_id"], r["text"]) for r in htmltext.extract(df).collect())
    assert got == [(1, "Title & more One two — three four a b"), (2, ""), (2, ""), (3, ""), (4, "plain <text"), (5, "unclosed x")]
    assert htmltext.extract(df.limit(0)).count() == 0


def test_extraction_names_are_whole_and_spare_the_article(spark):
    story = "<article><h2 id='related-work'>Related</h2><section id='search-methods'><p>Methods</p></section><div class='share-buttons'>Share</div></article>"
    pages = [
        f"<div class='content with-sidebar'>{story}</div><div class='sidebar'>Links</div>",
        f"<div class='page-widget'><p>Top</p>{story}</div><footer>End</footer>",
        f"<div class='search'><main>{story}</main></div><div>Other</div>",
        "<div class='post'>Story</div><div id='comments'><article>One</article><article>Two</article></div>",
        "<div class='notice'><p>All there is</p></div><nav>Home</nav>",
        "<div>Story</div><div class='sidebar-left'>Links</div><div class='nav_main'>Home</div>",
    ]
    df = spark.createDataFrame([(i, f"http://h{i}/", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in htmltext.extract(df).collect()}
    assert found == dict(enumerate(["Related Methods"] * 3 + ["Story", "All there is", "Story"]))


def test_wrappers_headers_and_teasers():
    long = "Real long text of the page. " * 30
    text = lambda page: htmltext.main_text(page, frozenset())
    assert text("<form id='f'><div><h1>T</h1><p>" + long + "</p></div></form><footer>End</footer>") == f"T {long.strip()}"
    assert text("<p>Story</p><form><p>Sign up</p><label>Mail</label></form>") == "Story"
    assert text("<article><div class='article-header'><h1>Title</h1><span>By x</span></div><p class='notice-period'>Body</p></article>") == "Title Body"
    assert text("<article>short teaser</article><div><p>" + long + "</p></div>") == f"short teaser {long.strip()}"
    assert text("<div class='layout has-sidebar'><article><h1>T</h1><p>Body text</p></article></div>") == "T Body text"
    assert text("<p>a <svg/>b</p><p title='x > y'>c</p><p 'odd\">d") == "a b c d"


def test_hostile_pages_take_time_in_proportion():
    import time

    for page in ("<a \"x ", "<div>t", "<b>t</i>", "<div class='c'><p>x", "</div><script", "<!-- ", "<li><ul>x", "<a href=\"x'>y"):
        took = []
        for n in (20_000, 80_000):
            began = time.perf_counter()
            htmltext.main_text(page * n, frozenset())
            took.append(time.perf_counter() - began)
        assert took[1] < 12 * took[0] + 1, page


def test_importance_against_a_plain_tree(spark):
    rnd = random.Random(2)
    pages = [f"<div class='m{rnd.randrange(2)}'><p>Menu</p></div><div class='b'><p>{rnd.choice('abcdefgh')} story</p><p>{i} more</p></div>" + "<div class='x'><i>tip</i></div>" * (i % 3 == 0) for i in range(9)]
    got = {r["node"]: (r["pages"], r["importance"]) for r in htmltext.style_tree(spark.createDataFrame([("h", p) for p in pages], "host string, html string").repartition(3)).collect()}
    texts, shapes, leaves = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for p in pages:
        seen, below = set(), defaultdict(list)
        for b in htmltext.blocks(p):
            seen.add((b.nodes[-1], b.text))
            for up, down in zip(b.nodes, b.nodes[1:], strict=False):
                if below[up][-1:] != [down]:
                    below[up].append(down)
        for leaf, x in seen:
            texts[leaf][x] += 1
        for up, x in below.items():
            shapes[up][tuple(x)] += 1
        for node, leaf in {(n, b.nodes[-1]) for b in htmltext.blocks(p) for n in b.nodes}:
            leaves[node][leaf] += 1
    size = {n: max(c.values()) for n, c in leaves.items()}
    content = {l: 1 - sum(map(math.log, c.values())) / len(c) / math.log(max(2, size[l])) for l, c in texts.items()}
    for node, own in leaves.items():
        mean = sum(n * content[l] for l, n in own.items()) / sum(own.values())
        want = content.get(node)
        if shapes[node]:
            p = size[node]
            h = -sum(n / p * math.log(n / p) for n in shapes[node].values()) / math.log(max(2, p))
            want = 0.1 * (min(1, h) if p > 1 else 1) + 0.9 * mean
        assert got[node] == (size[node], pytest.approx(want))
    assert set(got) == set(leaves)


def test_style_tree_drops_what_a_site_repeats(spark):
    data = [(i, f"http://site/{i}", f"<div class='x'><span>Same words here</span></div><div class='y'>Story {i} of {i * 7}</div>") for i in range(12)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    assert {r["text"] for r in htmltext.extract(df).collect()} == {f"Story {i} of {i * 7}" for i in range(12)}


# ---------------------------------------------------------------- 6: mixing


def targets(size):
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    full, total = set(), 1.5 * sum(size.values())
    while True:
        rest, free = total - sum(2 * size[s] for s in full), sum(weight[s] for s in names if s not in full)
        t = {s: 2.0 * size[s] if s in full else rest * weight[s] / free for s in names}
        over = {s for s in names if s not in full and t[s] > 2 * size[s]}
        if not over:
            return t
        full |= over


def test_mixing_targets_and_reruns(odd, none):
    docs = [(r[0], len(WORD.findall(r[1] or "")), r[3]) for r in odd_rows()]
    size = Counter()
    for _, n, s in docs:
        size[s] += n
    want = targets(size)
    found = mixing.mix(odd).collect()
    assert Counter((r["doc_id"], r["size"]) for r in found) == Counter((i, n) for i, n, _ in docs)
    source = {i: s for i, _, s in docs}
    taken = Counter()
    for r in found:
        s = source[r["doc_id"]]
        assert r["source_size"] == size[s] and abs(r["target"] - want[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 64 for s in want)
    assert rows(mixing.mix(odd.repartition(7))) == rows(mixing.mix(odd))
    # the mix's blocks, taken from the shards, are what the sums say; shards draw their slots
    sizes = mixing.document_sizes(odd)
    plan = base.stash(mixing.source_targets(sizes))
    placed = base.stash(mixing.place_documents(sizes, plan))
    blocks = mixing.mixed_blocks(placed, plan).join(placed.select("_row", "doc_id", "number"), "_row").collect()
    words_ = Counter()
    for r in blocks:
        words_[r["doc_id"]] += r["words"]
    assert {i: n for i, n in words_.items()} == {i: n for i, n in Counter({i: sum(r["taken"] for r in found if r["doc_id"] == i) for i in {r["doc_id"] for r in found}}).items() if n}
    drawn = sum(r["words"] for r in mixing.shard_counts(plan).collect())
    # a source's last block may hold fewer words than its slot
    assert 0 <= drawn - sum(r["words"] for r in blocks) <= 64 * 2 * len(want)
    assert mixing.mix(none).count() == 0 and mixing.mix_rows(none).count() == 0


def test_mixed_rows_fill_each_target(spark, none):
    # sources of a few very long documents, of many short ones and without an id; a cut text begins like its document
    docs = [(i, " ".join(words(5000 + i, i)), "long") for i in range(3)] + [(10 + i, " \n" + "\n".join(words(20 + i, 60 + i)), "short") for i in range(40)] + [(None, " ".join(words(300, 5)), None), (90, "", "short"), (91, None, "long")]
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in docs], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    size = Counter()
    for _, t, s in docs:
        size[s] += len(WORD.findall(t or ""))
    out = mixing.mix_rows(df).collect()
    got, cut = Counter(), Counter()
    for r in out:
        got[r["source"]] += len(WORD.findall(r["text"]))
        whole = next(t for i, t, s in docs if i == r["doc_id"])
        cut[r["source"]] += r["text"] != whole
        assert whole.lstrip().startswith(r["text"].strip()) and r["n_chars"] == len(r["text"])
    want = targets(size)
    assert all(abs(got[s] - want[s]) <= 1 for s in want) and max(cut.values()) <= 1 and max(Counter(r["doc_id"] for r in out).values()) <= 2
    assert rows(mixing.mix_rows(df.repartition(5))) == rows(mixing.mix_rows(df)) and mixing.mix_rows(none).count() == 0


def test_permutation_is_one(spark):
    for n in (1, 2, 37, 1000):
        x = spark.range(n).selectExpr(f"{mixing.permuted('id', f'{n}L', '3', 11)} as y", "id")
        got = [r["y"] for r in x.orderBy("id").collect()]
        assert sorted(got) == list(range(n)) and (n < 37 or got != list(range(n)))


def test_slots_fill_targets_in_shards(spark):
    plan = spark.createDataFrame([("a", 0, 6400, 9600.0), ("b", 1, 640, 320.0), ("c", 2, 0, 0.0)], "source string, number int, source_size long, target double")
    s = mixing.block_slots(plan, per_shard=40).collect()
    assert sum(r["words"] for r in s if r["number"] == 0) == 9600 and sum(r["words"] for r in s if r["number"] == 1) == 320
    assert max(Counter((r["number"], r["index"]) for r in s).values()) == 2 and {r["shard"] for r in s} == set(range(4)) and 2 not in {r["number"] for r in s}


# ---------------------------------------------------------------- 7: language model


def test_scores_by_all_ngrams(spark, odd, none, documents, tmp_path, monkeypatch):
    # a phrase of words beyond any list of frequent ones, in every tenth document; odd white space and letters
    texts = [(i, f"{t} zyx{i % 7} quux corge" if i % 10 == 0 else t) for i, t, _ in documents] + [(20_001, None), (20_002, "zzzz unheard"), (20_003, "zyx0 quux corge"), (20_004, " \n\tÉa\x0bZZ\u00a0q  \x1fx\r"), (20_005, "The OF the")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    toks = {i: [w.decode() for w in lm.words(t or "")] for i, t in texts}
    out = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in toks}
    c, pairs, triples = Counter(), Counter(), Counter()
    for i, t in toks.items():
        if not out[i]:
            s = ["<s>", *t]
            c.update(t)
            pairs.update(zip(s, s[1:], strict=False))
            triples.update(zip(s, s[1:], s[2:], strict=False))
    n, v, once, twice = sum(c.values()), len(c), sum(x == 1 for x in c.values()), sum(x == 2 for x in c.values())
    d = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
    docs = sum(not x for x in out.values())

    def after(h, w):
        if not h:
            return (c[w] - d if c[w] else d * v) / n
        total = pairs[h] if len(h) == 2 else docs if h[0] == "<s>" else c[h[0]]
        return ((triples if len(h) == 2 else pairs)[*h, w] + lm.PULL[len(h) - 1] * after(h[1:], w)) / (total + lm.PULL[len(h) - 1])

    want = {i: sum(math.log10(after(tuple(["<s>", *t][max(0, k - 1) : k + 1]), w)) for k, w in enumerate(t)) for i, t in toks.items()}
    for small in (False, True):
        if small:
            monkeypatch.setattr(lm, "BLOCK_CHARS", 40_000)
            monkeypatch.setattr(lm, "BUCKET_CHARS", 50_000)
        found = {r["doc_id"]: r for r in entries.op7_lm_scoring(spark, str(tmp_path)).collect()}
        assert set(found) == set(toks)
        for i, t in toks.items():
            r = found[i]
            assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(t), sum(c[w] > 0 for w in t), n)
            assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
            assert r["score"] == pytest.approx(want[i])
    held = [found[i] for i in toks if out[i]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    # an unknown token and all known ones take all of a context's probability
    assert sum(after(("the",), w) for w in c) + after(("the",), "never heard") == pytest.approx(1)
    assert len(lm.score_documents(odd).collect()) == len(odd_rows()) and lm.score_documents(none).count() == 0
    nothing = lm.score_documents(spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")).collect()
    assert [(r["score"], r["n_known"]) for r in nothing] == [(0, 0)] * 2


# ---------------------------------------------------------------- 9: lines


def plain_units(text):
    """(line, sentence or None, its tokens with fields open) by plain string handling."""
    for i, line in enumerate(text.split("\n")):
        if not line.strip():
            continue
        parts = re.split(r"(?<=[.!?])(?=[ \t])", line)
        for k, part in [(None, line), *(enumerate(parts) if len(parts) > 1 and len(line) > 60 else ())]:
            if k is None or part.count(" ") >= 12:
                tokens = WORD.findall(part.lower())
                yield i, k, tuple("*" if re.search("[0-9@]", t) or re.match("https?://", t) else t for t in tokens)


def test_lines_against_plain_counts(spark, odd, none, documents, monkeypatch):
    docs = [(i, t) for i, t, _ in documents]
    held = defaultdict(set)
    for i, t in docs:
        for _, k, u in plain_units(t):
            held[k is None and len(u) >= 8, u].add(i)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for small in (False, True):
        if small:
            monkeypatch.setattr(linededup, "BLOCK_CHARS", 30_000)
            monkeypatch.setattr(linededup, "BUCKET_CHARS", 50_000)
            monkeypatch.setattr(linededup, "SPREAD", 3)
        got = {r["doc_id"]: r for r in linededup.dedup_lines(df).collect()}
        assert set(got) == {i for i, _ in docs}
        gone = 0
        for i, t in docs:
            r = got[i]
            units = list(plain_units(t))
            assert r["n_lines"] == t.count("\n") + 1
            left = set(r["text"].split("\n"))
            for line, k, u in units:
                where = held[k is None and len(u) >= 8, u]
                due = len(where) >= (3 if len(u) >= 4 else 10) and 2 * sum(x != "*" for x in u) >= len(u)
                if k is None and due:
                    assert (t.split("\n")[line] in left) == (min(where) == i), u
                    gone += min(where) != i
            if not r["n_dropped"] and not r["n_cut"]:
                assert r["text"] == t
            if all(len(held[k is None and len(u) >= 8, u]) == 1 for _, k, u in units) and r["n_dropped"] + r["n_cut"]:
                # only lines that are like others go beside those that are the same
                def alike(u):
                    return [v for (line, v), x in held.items() if line and len(v) == len(u) and v != u and u[:2] == v[:2] and sum(a == b for a, b in zip(u, v, strict=True)) >= 0.6 * len(u)]

                assert any(alike(u) for _, k, u in units if k is None)
        assert gone > 20
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(odd).collect()}
    line = "the cat sat on the mat today"
    assert len(linededup.dedup_lines(odd).collect()) == len(odd_rows()) and got[4] is None and line in got[15] and line not in got[16] and line not in got[17]
    assert linededup.dedup_lines(none).count() == 0 and linededup.drop_recurring_lines(none).columns == none.columns


def test_line_templates_get_fields(spark):
    own = lambda i: " ".join(letters(30, 50 + i))
    said = lambda i: f"the nightly backup of {'abcdefghij'[i] * 5} {'klmnopqrst'[i] * 4} ended without any error in the log"
    docs = [(i, f"{own(i)}\n{said(i)}\nall rights reserved.\n{'seen twice' if i < 2 else own(i + 30)}\n12 {i} 7 8 9\n{own(i + 60)}") for i in range(10)]
    docs += [(20 + i, f"{own(200 + i)}\nall rights reserved.") for i in range(3)]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    for i, t in docs:
        kept = got[i]["text"].split("\n")
        assert ("all rights reserved." in kept) == (i == 0) and all(x in kept for x in t.split("\n") if x == "seen twice" or x.startswith("12 "))
        if i < 10:
            assert (said(i) in kept) == (i == 0) and got[i]["n_dropped"] == (2 if i else 0)


def test_line_templates_at_any_size(spark, monkeypatch):
    """A leaf of many lines is one, and no bound of blocks, buckets or keys changes a result."""
    tail = "ended without any error in the log of the machine"
    said = lambda i: f"the backup {'abcdefghij'[i] * 5} {'klmnopqrst'[i] * 4} of {tail}"
    words = letters(9000, 3)
    others = [f"the backup {' '.join(words[(k * 7 + j * (k + 1)) % 9000] for j in range(13))}" for k in range(2500)]
    docs = [(100 + k, x) for k, x in enumerate(others)] + [(i, f"{said(i)}\n{' '.join(letters(30, 50 + i))}") for i in range(10)]
    # two lines of a template, one in documents 5001 and 5002, one in 5001 and 5003: three documents
    pair = [f"a record was {x} kept here for all who ask about it later" for x in ("never", "often")]
    docs += [(5001, "\n".join(pair)), (5002, pair[0]), (5003, pair[1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    one = {tuple(r) for r in linededup.dedup_lines(df.coalesce(1)).collect()}
    got = {r[0]: r[1] for r in one}
    for i in range(10):
        assert (said(i) in got[i]) == (i == 0)
    assert got[5001] == "\n".join(pair) and got[5002] == got[5003] == ""
    monkeypatch.setattr(linededup, "BLOCK_CHARS", 30_000)
    monkeypatch.setattr(linededup, "BUCKET_CHARS", 50_000)
    monkeypatch.setattr(linededup, "SPREAD", 3)
    assert {tuple(r) for r in linededup.dedup_lines(df.repartition(5)).collect()} == one


def test_pipeline_lines_go_alike_for_any_spread(spark, monkeypatch):
    w = letters(200, 11)
    df = spark.createDataFrame([(i, f"the backup {w[2 * i]} {w[2 * i + 1]} of the day ended without any error in the log of the machine") for i in range(80)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(linededup, "SPREAD", 3)
    assert [r["doc_id"] for r in linededup.drop_recurring_lines(df).collect()] == [0]


def test_pipeline_lines_of_repeated_rows_count_once_wherever_blocks_end(spark, monkeypatch):
    """Rows of one document count once for a line, a short line and a passage, whether they share a block or not."""
    line, short = "one line that two documents share and that is long enough", "see also here"
    passage = " ".join(" ".join(letters(14, 700 + k)) + "." for k in range(5))
    own = lambda k: "\n".join(" ".join(letters(12, 800 + 10 * k + j)) for j in range(9))
    docs = [(1, f"{line}\n{own(k)}") for k in range(3)] + [(2, f"{own(3)}\n{line}")]
    docs += [(k % 9 + 10, f"{own(4 + k)}\n{short}") for k in range(18)] + [(30, f"{own(30 + k)}\n{passage}") for k in range(2)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for more in ([], [(3, line), (19, short), (31, f"{passage}\n{own(40)}")]):
        df = df.unionByName(spark.createDataFrame(more, df.schema))
        one = sorted(tuple(r) for r in linededup.drop_recurring_lines(df.coalesce(1)).collect())
        with monkeypatch.context() as m:
            m.setattr(linededup, "BLOCK_CHARS", 200)
            m.setattr(linededup, "BUCKET_CHARS", 300)
            assert sorted(tuple(r) for r in linededup.drop_recurring_lines(df.repartition(7)).collect()) == one
        if not more:
            assert one == sorted(docs)
        else:
            # a third document, a tenth and a second: now each goes, but from its first
            assert {d for d, t in one if line in t} == {1} and {d for d, t in one if short in t} == {10} and {d for d, t in one if passage in t} == {30}


def test_templates_grow_as_if_every_line_met_every_template():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(200):
        width, count = rng.integers(8, 65), rng.integers(2, 40)
        signs = rng.integers(0, rng.choice([3, 20, 256]), (3, width)).astype(np.uint8)[rng.integers(0, 3, count)]
        other = rng.random(signs.shape) < 0.5 * rng.random()
        signs[other] = rng.integers(0, 256, other.sum())
        templates, want = {}, []
        for i, line in enumerate(signs):
            same = {t: ((x == line) & (line != 0)).sum() for t, x in templates.items()}
            best = max(same, key=lambda t: (same[t], -t), default=i)
            if same.get(best, -1) >= linededup.ALIKE * width:
                templates[best] = np.where(templates[best] == line, line, 0)
            else:
                best, templates[i] = i, line
            want.append(best)
        assert linededup.grow(signs).tolist() == want


def test_passages_of_two_documents(spark):
    sentence = lambda k: " ".join(letters(14, 900 + k)) + "."
    passage = " ".join(sentence(k) for k in range(5))
    own = [" ".join(letters(90, 700 + i)) for i in range(4)]
    copy = " ".join(letters(120, 7)) + ". " + sentence(40)
    docs = [(1, f"{own[0]}. {passage} {own[1]}"), (2, f"{own[2]}\nand so. {passage}\n{own[3]}"), (3, copy), (4, copy), (5, own[1] + ". " + sentence(0))]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == docs[0][1] and got[2] == f"{own[2]}\nand so.\n{own[3]}" and got[3] == got[4] == copy
    assert got[5] == own[1] + "."  # its sentence is in three documents


# ---------------------------------------------------------------- 10: quality


def test_quality_against_sql(spark, odd, none):
    for df, at in ((odd, None), (base.read(spark, "/root/testdata/sf0.001", "documents"), "sf0.001")):
        con = duckdb.connect()
        if at:
            con.sql(f"create view documents as select * from '/root/testdata/{at}/documents.parquet'")
        else:
            con.register("t", df.select("doc_id", "text", "source").toArrow())
            con.sql("create view documents as select * from t")
        got = quality.quality_rules(df).drop("_text")
        columns = sorted(got.columns)
        want = sorted((tuple(plain(v) for v in r) for r in con.sql(f"select {', '.join(columns)} from ({quality.ORACLE})").fetchall()), key=repr)
        assert rows(got) == want
    assert quality.quality_rules(none).count() == 0


def test_lines_of_a_host_are_removed_above_the_limit(spark):
    ad = "subscribe to our letter " * 20
    docs = [(i, f"{ad}\n{' '.join(words(12, i))}", "h") for i in range(30)] + [(99, " ".join(words(80, 99)), "h"), (98, f"{ad}\n{' '.join(words(12, 98))}", "other")]
    kept = {r["doc_id"] for r in quality.quality_rules(spark.createDataFrame(docs, "doc_id long, text string, source string"), line_limit=10).collect() if r["kept"] and not r["base_failed"]}
    assert 99 in kept and not kept & set(range(1, 30))
    text = " ".join(words(100, 7))
    copies = spark.createDataFrame([(i, text, "h") for i in range(40)], "doc_id long, text string, source string")
    assert quality.quality_rules(copies, line_limit=10).where("kept").count() == 40


def test_long_repetitive_text(spark):
    text = " ".join(words(3000, 3, 200)) + " " + " ".join(words(3000, 3, 200))
    d = quality.document_counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    w = text.split()
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    assert d["n_repeat_words"] == len({p for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)})


# ---------------------------------------------------------------- rows without ids


def test_null_ids(spark):
    a, b = " ".join(words(80, 21)), " ".join(words(80, 22))
    df = spark.createDataFrame([(None, a, "s"), (None, a, "s"), (None, b, None), (3, b, None), (4, None, "s")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    path = entries.tokenizer("word_bpe_49k.json")
    for out in (tokens.token_counts(df, entries.tokenizer("piece_bpe_32k.model")), toxicity.toxicity(df, labels), neardup.near_duplicates(df), mixing.mix(df), lm.score_documents(df), linededup.dedup_lines(df), quality.quality_rules(df), packing.pack_documents(df, path)):
        assert out.count() == 5
    assert Counter((r["doc_id"], r["kept"]) for r in neardup.near_duplicates(df).collect()) == {(None, True): 2, (None, False): 1, (3, True): 1, (4, True): 1}
    assert {r["text"] for r in neardup.drop_near_duplicates(df).collect()} == {a, b, None}
    assert quality.quality_filter(df).count() == 4 and mixing.mix_rows(df).where("doc_id is null").count() > 0


# ---------------------------------------------------------------- pipeline


def test_pipeline_runs_whole_and_clears_what_it_stashed(spark):
    shared = Path(base.shared_dir(spark).removeprefix("file:"))
    before = set(shared.glob("stash-*"))
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    left = set(shared.glob("stash-*")) - before
    assert len(left) <= 2  # the mixed documents and their pieces
    docs = base.read(spark, "/root/testdata/sf0.001", "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = base.stash(stage(spark, docs, ""))
    want = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    check_packed(found, 4096)
    pieces = [Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in x) for x in (found, want)]
    assert pieces[0] == pieces[1] and len(pieces[0]) > 50


def test_stages_drop_what_they_stash(spark):
    made = []

    def stage():
        made.append(base.stash(spark.range(5)))
        return made[0].where("id > 2")

    out = base.stash_stage(stage)
    gone, kept = (Path(x._stash.removeprefix("file:")) for x in (made[0], out))
    assert not gone.exists() and kept.exists() and out.count() == 2


def test_pipeline_stages(spark, odd):
    docs = base.read(spark, "/root/testdata/sf0.001", "documents")
    columns = docs.columns
    judged = quality.quality_rules(docs).collect()
    kept = corpus_pipeline.STAGES[0][1](spark, docs, "")
    assert kept.columns == columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in judged if r["kept"])
    kept = base.stash(kept)
    cut = base.stash(corpus_pipeline.STAGES[1][1](spark, kept, ""))
    want = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(kept).collect() if not r["n_dropped"] + r["n_cut"] or WORD.search(r["text"])}
    assert cut.columns == columns and {r["doc_id"]: r["text"] for r in cut.collect()} == want and all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    one = base.stash(corpus_pipeline.STAGES[2][1](spark, cut, ""))
    alone = {i for i, (_, _, k) in brute_components(list(want.items())).items() if k}
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == alone
    mixed = base.stash(corpus_pipeline.STAGES[3][1](spark, one, ""))
    size = {r["doc_id"]: len(WORD.findall(r["text"])) for r in one.collect()}
    taken = Counter(r["doc_id"] for r in mixed.collect())
    assert mixed.columns == columns and set(taken) <= alone and max(taken.values()) <= 2
    got, want = Counter(), Counter()
    for r in mixed.collect():
        got[r["source"]] += len(WORD.findall(r["text"]))
    for r in one.collect():
        want[r["source"]] += size[r["doc_id"]]
    assert all(abs(got[s] - x) <= 1 for s, x in targets(want).items())
    found = corpus_pipeline.STAGES[4][1](spark, mixed, "").collect()
    check_packed(found, 4096)
    assert Counter(r["doc_id"] for r in found if r["piece"] == 0) == taken
    for stage in range(4):
        assert corpus_pipeline.STAGES[stage][1](spark, odd, "").columns == odd.columns
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES])


def _left_in_workers(spark):
    """Megabytes that each worker holds, and how many models it keeps."""

    def look(batches):
        import time

        import pyarrow as pa

        from tidesift.llm import tokens

        for _ in batches:
            pass
        time.sleep(1)  # so that every idle worker gets a task
        held = sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024
        yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([len(getattr(base, "kept", getattr(tokens, "_models", {})))])], names=["mb", "models"])

    return [tuple(r) for r in spark.range(4, numPartitions=4).mapInArrow(look, "mb double, models long").collect()]


def test_pipeline_stages_leave_workers_small(spark, tmp_path):
    r = random.Random(7)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(60_000)]
    made = [(i, "\n".join(" ".join(r.choices(words, k=12)) for _ in range(120)), "a") for i in range(1200)]
    spark.createDataFrame(made, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    docs.limit(20).write.parquet(f"{tmp_path}/few")
    few = spark.read.parquet(f"{tmp_path}/few")
    corpus_pipeline.packed(spark, few.repartition(4), "").collect()
    before = _left_in_workers(spark)
    assert max(n for _, n in before) == 1
    lines = corpus_pipeline.lines(spark, docs, "")
    assert lines.count() == len(made)
    after = _left_in_workers(spark)
    # a stage without a tokenizer drops that of the workers it uses
    assert sum(n for _, n in after) < sum(n for _, n in before)
    assert max(mb for mb, _ in after) < max(mb for mb, _ in before) + 70, (before, after)
