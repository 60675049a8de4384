"""The training-data operators against brute force, SQL, round trips and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratasift.llm import chat_format, decontaminate, html_extract, lattice_lm, license_scan, line_dedup, ngram_jaccard, quality_classifier, quality_rules, queries, source_mix
from stratasift.llm.common import components
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, rep string, h long"


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, k):
    w = words(text)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns with clashing names."""
    base = " ".join(f"w{i}" for i in range(60))
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base + " tail", "en", None), (4, None, None, None), (5, "", "", ""), (6, "   \n\t ", "en", "a"), (7, "two words", "en", "b"), (8, "two words", "en", "b"),
        (8, "two words", "en", "b"), (None, base, "en", "c"), (9, " ".join(f"x{i % 9000}" for i in range(20000)), "en", "b"), (10, "ünï cödé " * 30, "de", "é"), (11, "Released under the MIT License.\n" * 3, "en", "c"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "clash", 1) for r in rows], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLES[name], SF)


def brute_components(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows}
    label = {i: i for i in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            i = len(sets[a] & sets[b])
            if i and den * i >= num * (len(sets[a]) + len(sets[b]) - i):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_jaccard_join(spark, k, num):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.near_duplicate_components(docs, k, num, 100).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()], k, num, 100)


@pytest.mark.parametrize(("whole", "tokens"), [(1000, 10**6), (1000, 1000), (20, 10**6)])
def test_jaccard_join_of_a_large_crowd(spark, monkeypatch, whole, tokens):
    """Short lists, crowds and chunks of a few sets, so that every path runs."""
    monkeypatch.setattr(ngram_jaccard, "SHORT", 4)
    monkeypatch.setattr(ngram_jaccard, "CHUNK", 8)
    monkeypatch.setattr(ngram_jaccard, "WHOLE", whole)
    monkeypatch.setattr(ngram_jaccard, "TOKENS", tokens)
    rng, base, rows = random.Random(3), [f"b{i}" for i in range(80)], []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(30)}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_jaccard.near_duplicate_components(docs, 3, 85, 100).collect()}
    assert got == brute_components(rows, 3, 85, 100)


def test_jaccard_join_of_shared_ids(spark):
    """Rows of one doc_id with different texts are one document: links of each count."""
    a, c = " ".join(f"a{i}" for i in range(60)), " ".join(f"c{i}" for i in range(60))
    rows = [("1", a), ("1", c), ("1", c), ("2", a + " tail"), ("3", c + " tail"), ("4", "x y z")]
    got = {(r.doc_id, r.component_id) for r in ngram_jaccard.near_duplicate_components(spark.createDataFrame(rows, "doc_id string, text string"), 3, 90, 100).collect()}
    assert got == {("1", "1"), ("2", "1"), ("3", "1"), ("4", "4")}


def test_chunk_forest_with_labels():
    """Random sets around several centres: the forest joins just what brute force links, and no two of one label."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        centres = [np.unique(rng.integers(0, 4000, 60)) for _ in range(4)]
        sets = []
        for i in range(50):
            base = centres[rng.integers(4)]
            sets.append(np.unique(np.concatenate([base[rng.random(len(base)) > 0.06], rng.integers(0, 4000, rng.integers(0, 5))])).astype(np.uint64))
        links = [(i, j) for i in range(50) for j in range(i) if 100 * (n := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - n)]
        labels = np.array([min(i % 25, 7) for i in range(50)])

        def closure(pairs):
            label = list(range(50))
            for i, j in pairs:
                x, y = label[i], label[j]
                label = [min(x, y) if v in (x, y) else v for v in label]
            return label

        assert closure(ngram_jaccard.chunk_forest(np.arange(50), sets, 85, 100)) == closure(links)
        same = [(i, int(np.flatnonzero(labels == labels[i])[0])) for i in range(50)]
        assert closure([*same, *ngram_jaccard.chunk_forest(np.arange(50), sets, 85, 100, labels)]) == closure([*same, *links])


def test_ngram_jaccard_pairs_by_chance_send_no_sets(spark, monkeypatch):
    """Texts that share most rare shingles but are not near: they must not become pairs, whose sets are sent."""
    rng, rows, counts = random.Random(5), [], []
    for i in range(120):
        base = [f"{rng.random():.9f}" for _ in range(42)]
        rows += [(3 * i, " ".join(base)), (3 * i + 1, " ".join(base[:28] + [f"{rng.random():.9f}" for _ in range(14)])), (3 * i + 2, " ".join(base) + " end")]
    made = ngram_jaccard.materialise

    def counted(df):
        out = made(df)
        counts.extend([out[0].count()] if out[0].columns == ["a", "b"] else [])
        return out

    monkeypatch.setattr(ngram_jaccard, "materialise", counted)
    got = {r.doc_id: r.component_id for r in ngram_jaccard.near_duplicate_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()}
    assert got == {i: i if i % 3 == 1 else i - i % 3 for i, _ in rows}
    assert counts[0] == 120  # the near ones


def test_ngram_jaccard_sketch_never_tells_less_than_the_overlap():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60, 700, 5000):
        for share in (0.0, 0.5, 0.95, 1.0):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
            b = np.unique(np.concatenate([a[: int(len(a) * share)], rng.integers(0, 1 << 63, 1 + int(n * 0.3), dtype=np.uint64)]))
            x, y = (np.frombuffer(ngram_jaccard.sketch(t), np.uint8) for t in (a, b))
            assert len(np.intersect1d(a, b)) <= ngram_jaccard.most_overlap(x, y) <= min(len(a), len(b))
    assert ngram_jaccard.sketch(np.arange(0, 1 << 20, 1 << 10, dtype=np.uint64)) == b""  # a count beyond a byte says nothing


def test_jaccard_join_odd_rows(odd, empty):
    rows = ngram_jaccard.near_duplicate_components(odd, 3, 90, 100).collect()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert len(rows) == 13 and got[None][1] is None
    assert got[1][1] == got[2][1] == got[3][1] == 1 and got[4] == (0, 4) and got[6] == (0, 6) and got[7] == (1, 7) and got[8] == (1, 7)
    assert ngram_jaccard.near_duplicate_components(empty).collect() == []


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (3, 2), (5, 4), (4, 4), (None, 3), *((i, i + 1) for i in range(10, 40))], "a long, b long")
    got = {r.v: r.component for r in components(edges).collect()}
    assert got[3] == got[2] == 1 and got[5] == 4 and all(got[i] == 10 for i in range(11, 41))


def test_quality_rules_odd_rows(odd, empty):
    got = {r.doc_id: r for r in quality_rules.quality_measures(odd).collect()}
    assert got[4].n_words == 0 and got[4].base_failed and not got[4].kept and not got[6].kept
    assert got[1].kept and not got[10].kept and got[10].word_chars == 30 * 7 and got[11].n_dup_lines == 2
    assert {r.doc_id for r in quality_rules.keep_good(odd).collect()} == {1, 2, 3, None}
    assert quality_rules.keep_good(odd).columns == odd.columns and quality_rules.quality_measures(empty).count() == 0


def test_chat_round_trip(spark):
    texts = ["\\### Assistant: </turn> ok", "a\\l\\h\\\\ <b> # \\", "", None, "x </turn>\n### User: y", "\\c: \\a", "ü" * 5]
    rows = [(1, i, ["user", "assistant", "we: ird", None][i % 4], t) for i, t in enumerate(texts)] + [(2, None, "assistant", "n"), (2, 0, "assistant", "n"), (2, 0, "assistant", "n"), (None, 1, "user", "z")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, block string")
    out = chat_format.format_conversations(turns).withColumn("turns", chat_format.parse_turns(F.col("formatted")))
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [(r[2] or "", r[3] or "") for r in rows[:7]]
    assert got[2].n_turns == 3 and got[None].n_turns == 1 and got[1].attachments == []
    spans = [got[1].formatted[s.start : s.start + s.length] for s in got[1].loss_spans]
    assert len(spans) == 2 and all(got[1].formatted[s.start + s.length :].startswith(" </turn>") for s in got[1].loss_spans)
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


def test_chat_of_a_long_conversation(spark):
    rows = [(1, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(1500)] + [(2, 3, "user", f"same {i:04}") for i in range(600)] + [(2, None, "user", f"none {i:04}") for i in range(300)]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)).withColumn("turns", chat_format.parse_turns(F.col("formatted")))
    got = {r.conv_id: r for r in out.collect()}
    assert [t.text for t in got[1].turns] == [f"turn {i}" for i in range(1500)] and len(got[1].loss_spans) == 750
    assert [t.text for t in got[2].turns] == [f"none {i:04}" for i in range(300)] + [f"same {i:04}" for i in range(600)]
    assert all(got[1].formatted[s.start : s.start + s.length] == f"turn {2 * i}" for i, s in enumerate(got[1].loss_spans))


def test_chat_parts(spark):
    part = lambda kind, **m: (kind, m.get("text"), m.get("ref"), m.get("w"), m.get("h"), m.get("s"), m.get("p"))
    rows = [(1, 0, "user", [part("text", text="see <"), part("image", ref="a.png", w=56, h=30), part("audio", ref="b.wav", s=2.0), None, part("odd"), part("document", ref="c.pdf", p=3), part("image", ref="d.png")]), (1, 1, "assistant", None)]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat_format.PARTS_TYPE}")
    r = chat_format.format_conversations(df, F.col("parts")).first()
    assert [(a.number, a.kind, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 4), (1, "audio", "b.wav", 50), (2, "document", "c.pdf", 3000), (3, "image", "d.png", 1)]
    assert "see \\l\\aimage 0;\\aaudio 1;\\adocument 2;\\aimage 3; </turn>" in r.formatted and r.n_expanded_tokens == 3055


def test_chat_query_digests(spark):
    r = {x.conv_id: x for x in queries.op3_chat_format(spark, SF).collect()}[-7]
    mark = "\\### Assistant: </turn> ok"
    assert r.turns_sha256 == hashlib.sha256(f"user\n{mark}\nassistant\n{mark}\n".encode()).hexdigest() and r.loss_chars == len(mark)


def test_html_parse():
    page = html_extract.Page
    html = '<body><header>H</header><nav><ul><li>x<li>y</ul></nav><div class="cookie-notice">We</div><main><article><h1>T</h1><p>a<b>b</b>c &amp; d&nbsp;e<p>f<br>g<div class="ad">AD</div><aside>s</aside><form>q</form><section id="comments"><p>Great</section></article></main><div class="has-sidebar">z</div><footer>c</footer><script>"</p>"</script>'
    assert page(html).text() == "T abc & d e f g"
    assert page(None).text() == "" and page("a < b & c <p").text() == "a < b & c <p" and page("<p>one<div class=sidebar>no</div><p>two").text() == "one two"
    assert page("<table><tr><td>a<td>b<tr><td>c</table><ul><li><p>x<li>y</ul>").text() == "a b c x y"
    assert page("&#" + "9" * 6000 + "; x &#00065; &#x41;").text() == "\ufffd x A A" and page('a <span class="ad">no <span>no</span></span> b').text() == "a b"


def test_html_names_inside_the_article():
    """No word of a class or id removes text of the article; whole names of adverts and comments do."""
    html = '<article><section class="related-work">A</section><div class="search-trees">B</div><p class="notice">C</p><section id="discussion">D</section><div class="social-science">E</div><div class="ads">F</div></article>'
    assert html_extract.Page(html).text() == "A B C D E" == html_extract.Page(html).text(frozenset(), judged=True)


@pytest.mark.parametrize("unit", ["<a ", '<a "', '<a b="', "<div>", "<b><td>", "<script>", "<script></script ", "<!-- ", "<div><p>x", "<", "&#", "<span class=ad>", "<ul><li><p>", "</div>", "word "])
def test_html_of_broken_markup_is_linear(unit):
    import time

    def seconds(n):
        start = time.process_time()
        page = html_extract.Page(unit * (n // len(unit)) + ">")
        page.nodes(), page.text({(1, 0)}, True), page.identity()
        return time.process_time() - start

    small, large = seconds(60_000), seconds(600_000)
    assert large < 1 or large < 30 * max(small, 0.05)


def brute_tree(rows):
    """Entropies by path, and low texts of boxes that share one, as the docstring has them."""
    hosts = {}
    for url, html in rows:
        page = html_extract.Page(html)
        hosts.setdefault(html_extract.host_of(url), {}).setdefault(page.identity(), []).append(page.nodes())
    low = {}
    for host, pages in hosts.items():
        seen = {}
        for identity, copies in pages.items():
            for nodes in copies:
                for path, content, look, kind, suspect in nodes:
                    own = seen.setdefault(path, {"suspect": False, "nodes": {}, "texts": {}})
                    own["suspect"] |= suspect
                    if kind != 2:
                        c, l = own["nodes"].get(identity, (2**63, 2**63))
                        signed = lambda x: x - 2**64 if x >= 2**63 else x
                        own["nodes"][identity] = min(c, signed(content)), min(l, signed(look))
                    if kind != 1 and content:
                        own["texts"].setdefault(content, set()).add(identity)
        for path, own in seen.items():
            m = len(own["nodes"])
            if m < html_extract.LEAST_PAGES:
                continue
            low.setdefault(host, set())
            entropy = max(-sum(n / m * math.log(n / m) for n in Counter(x[k] for x in own["nodes"].values()).values()) / math.log(m) for k in (0, 1))
            if entropy < (html_extract.NAMED_IMPORTANCE if own["suspect"] else html_extract.LEAST_IMPORTANCE):
                low[host].add((path, 0))
            for content, ids in own["texts"].items():
                if len(ids) >= max(html_extract.LEAST_PAGES, m / 2) and -math.log(len(ids) / m) / math.log(m) < html_extract.LEAST_IMPORTANCE:
                    low[host].add((path, content))
    return low


def hosted_pages():
    """A host whose boilerplate has no telling names, one with suspect names, one small."""
    out = []
    for i in range(12):
        boxes = [f"<div>story {i} {i * 7}</div>", f"<div>more {i % 5} of {i}</div>"]
        boxes.insert(i % 3, "<div>Read our rules before you write</div>")
        out.append((i, f"http://h.example.com/{i}", f"<body><div class=top>Welcome to our site</div>{''.join(boxes)}<p class=end>Built in {2000 + i % 2}"))
        note = "<p>Subscribe and never miss a story</p>"
        out.append((100 + i, f"http://n.example.com/{i}", f"<div class=search-box>find {i % 4}</div><div class=search-trees>trees {i}</div><article><h2>Summary</h2><p>text {i}</p>{note}<p>end {i}</p></article>" if i % 2 else f"<div class=search-box>find {i % 4}</div><div class=search-trees>trees {i}</div><p>text {i}"))
    out += [(200 + i, f"http://s.example.com/{i}", "<div class=top>Welcome</div><div class=site-menu>menu</div><p>same") for i in range(4)]
    return out + [(90, None, None), (91, "odd", "<p>x</p>"), (91, "odd", "<p>x</p>"), (None, "http://h.example.com/z", "<p>y</p>")]


def test_style_tree_decides(spark):
    docs = hosted_pages()
    df = spark.createDataFrame([(*d, "clash", 1) for d in docs], "page_id long, url string, html string, host string, piece int")
    want = brute_tree([(u, h) for _, u, h in docs])
    whole = 2**64 - 1
    got = {}
    for r in html_extract.low_branches(df).collect():
        own = got.setdefault(r.host & whole, set())
        if r.path:
            own.add((r.path & whole, r.content & whole))
    assert got == {html_extract.digest(h): x for h, x in want.items()}
    for limit in (1000, 0):  # by broadcast, then by a join
        got = {r.page_id: r.text for r in html_extract.extract_text(df, broadcast_rows=limit).collect()}
        assert got[3] == "story 3 21 more 3 of 3" and got[90] == "" and got[91] == "x" and got[None] == "y"
        assert got[101] == "Summary text 1 end 1" and got[102] == "trees 2 text 2" and got[201] == "Welcome same"
    assert html_extract.extract_text(df.limit(0)).count() == 0


def test_html_join_of_a_host_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "PIECE", 3)
    df = spark.createDataFrame(hosted_pages(), "page_id long, url string, html string")
    assert sorted(map(str, html_extract.extract_text(df, broadcast_rows=0).collect())) == sorted(map(str, html_extract.extract_text(df).collect()))


def test_html_of_all_pages(spark):
    import html as entities

    sf = "/root/testdata/sf0.01"
    rows = queries.op4_html_extract(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect()
    assert len(rows) == spark.read.parquet(f"{sf}/pages.parquet").count()
    for r in rows:
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        assert r.text == " ".join(entities.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", inner))).split())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, a, most):
    b = bytearray(a)
    for _ in range(rng.randrange(most + 1)):
        kind = rng.randrange(3)
        if kind == 0 and b:
            del b[rng.randrange(len(b))]
        elif kind == 1:
            b.insert(rng.randrange(len(b) + 1), rng.choice(b"abc"))
        elif b:
            b[rng.randrange(len(b))] = rng.choice(b"abc")
    return bytes(b)


def test_edit_distance_and_segments():
    rng = random.Random(5)
    for _ in range(3000):
        a = bytes(rng.choice(b"abc") for _ in range(rng.randrange(0, 25)))
        b, tau = edited(rng, a, 4), rng.randrange(4)
        d = distance(a, b)
        assert line_dedup.within(a, b, tau) == (d <= tau)
        if d <= 2 and min(len(a), len(b)) >= 6:
            s, l = sorted((a, b), key=len)
            assert set(line_dedup.segment_keys([s], 2, False)[0].tolist()) & set(line_dedup.segment_keys([l], 2, True)[0].tolist())


def brute_lines(rows, least, near_least, tau):
    lines = [((i, n), x.encode()) for i, t in rows if i is not None and t is not None for n, x in enumerate(t.split("\n"))]
    gone = set()
    for p, x in lines:
        for q, y in lines:
            near = min(len(x), len(y)) >= least and distance(x, y) <= (tau if min(len(x), len(y)) >= near_least else 1)
            if q < p and x.split() and (x == y or near):
                gone.add(p)
    return {i: "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows if i is not None and t is not None}


def test_line_dedup(spark, monkeypatch):
    rng = random.Random(8)
    base = [bytes(rng.choice(b"abcdefgh ") for _ in range(50)) for _ in range(4)]
    rows = [(i, "\n".join(edited(rng, rng.choice(base), 3).decode() if rng.random() < 0.7 else f"line {rng.randrange(5)}" for _ in range(3))) for i in range(60)]
    expected = brute_lines(rows, 20, 40, 2)
    for hot in (64, 4):  # all joined directly, then most in chunks
        monkeypatch.setattr(line_dedup, "HOT", hot)
        monkeypatch.setattr(line_dedup, "CHUNK", 16)
        got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
        assert got == expected


def test_line_dedup_of_a_hot_segment(spark, monkeypatch):
    """Near copies of a few lines, in many chunks: most are decided in their chunk, the rest as guests."""
    monkeypatch.setattr(line_dedup, "HOT", 8)
    monkeypatch.setattr(line_dedup, "CHUNK", 4)
    monkeypatch.setattr(line_dedup, "GUESTS", 3)
    rng = random.Random(9)
    head = "every line of this page starts alike and then "
    rows = [(f"d{i:03}", head + "".join(rng.choice("xyz") for _ in range(rng.choice((3, 3, 12))))) for i in range(90)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id string, text string").repartition(3)).collect()}
    assert got == brute_lines(rows, 20, 40, 2) and 5 < sum(t == "" for t in got.values()) < 85


def test_line_dedup_replaces_columns_named_like_its_own(spark):
    docs = spark.createDataFrame([("b", "same words", 7, "x", None, 1, 2), ("a", "same words", 7, "x", None, 1, 2)], "doc_id string, text string, n_lines int, n_copies string, n_near long, n_cut int, removed int")
    got = {r.doc_id: r.asDict() for r in line_dedup.dedup_lines(docs).collect()}
    assert got["b"] == {"doc_id": "b", "text": "", "removed": 2, "n_lines": 1, "n_copies": 1, "n_near": 0, "n_cut": 10} and got["a"]["text"] == "same words"


def test_line_dedup_of_short_and_accented_lines(spark, monkeypatch):
    pairs = [  # two lines, and whether the second goes
        ("Thwhesnd esator whshing and hewh.", "Thwhesnd, esator whshing and hewh.", True), ("one edit of twenty by", "one edit of twenty b", True), ("two edits of a short l", "two edjts of a shjrt l", False),
        ("a line of thirty-nine bytes, as counted", "a line of thirty-nine bytes, as counted.", True), ("a short line and two edits to forty it.", "a short line and twoo edits to forty iit.", False),
        ("un élève près de la fenêtre a été là, hier soir", "un eleve près de la fenêtre a été là, hier soir", True), ("un autre élève à côté de la porte fermée à clé", "un autre eleve a côté de la porte fermée à clé", False),
        ("今天天气很好我们一起去公园散步", "今日天气很好我们一起去公圆散步", True), ("明天他们坐火车去北京", "明天他们坐汽车去北京", True), ("明天她们坐飞机来上海", "明天她们坐轮船来上海", False),
        ("this is a line with 😀 at some place within it", "this is a line with 😁 at some place within", False), ("and this is a line with 😀 at some place in it", "and this is a line with 😁 at some place in i", True),
    ]
    chars = "abé天地😀"
    rng = random.Random(4)
    for _ in range(2000):
        a = [rng.choice(chars) for _ in range(rng.randrange(20))]
        b = [x for c in a for x in rng.choices(([c], [], [c, rng.choice(chars)], [rng.choice(chars)]), (12, 1, 1, 1))[0]]
        tau = rng.randrange(4)
        assert line_dedup.within("".join(a).encode(), "".join(b).encode(), tau) == (distance(a, b) <= tau)
    rows = [(n, x) for k, pair in enumerate(pairs) for n, x in ((2 * k, pair[0]), (2 * k + 1, pair[1]))]
    for hot in (64, 2):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        got = {r.doc_id: r.n_near for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()}
        assert [got[2 * k + 1] == 1 for k in range(len(pairs))] == [gone for *_, gone in pairs] and not any(got[2 * k] for k in range(len(pairs)))


def test_line_dedup_odd_rows(odd, empty):
    out = line_dedup.dedup_lines(odd)
    got = {r.doc_id: r for r in out.collect()}
    assert out.count() == 13 and out.columns == [*odd.columns, "n_lines", "n_copies", "n_near", "n_cut"]
    assert got[1].text and got[2].text == "" and got[2].n_copies == 1 and got[4].text is None and got[None].text and got[11].n_copies == 2
    assert line_dedup.dedup_lines(empty).count() == 0


def test_license_scan(spark, odd, empty):
    tr = {i: i + 32 for i in range(65, 91)}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text ilike '%licens%' or doc_id < 40")
    docs = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(-1, "GNU general public license gnu general public license cc-by CC BY mit MIT License apache license"), (-2, "licensed under the great apache license version 2 0")], "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(tr))
        places = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        at = [k for k, _ in places]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))
    assert got[-1].n_base == 6 and got[-2].labels == "apache,apache-2.0" and 0.7 <= got[-2].score
    rows = license_scan.scan_licenses(odd).collect()
    assert len(rows) == 13 and {r.doc_id: r.labels for r in rows}[11] == "mit" and {r.doc_id: r.n_words for r in rows}[4] == 0
    assert license_scan.scan_licenses(empty).count() == 0


def test_license_scan_of_repeated_notices(spark):
    notice = "all rights reserved"
    rows = [(n, " ".join(["before it", *[notice] * n, "and after"])) for n in (1, 2, 3, 4, 5, 40)]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels and {(r.labels, r.score) for r in got.values()} == {(got[1].labels, 1.0)}


def brute_labels(text):
    """Labels and score by the method, in plain loops."""
    w = [x.decode() for x in license_scan.license_words(text)]
    labels, score = set(), 0.0
    for _, words_, label, length, k, phrase in license_scan.template_table():
        t = words_.split()
        if phrase:
            if any(w[i : i + length] == t for i in range(len(w))):
                labels.add(label)
                score = 1.0
            continue
        where = {}
        for j in range(length - k + 1):
            where.setdefault(tuple(t[j : j + k]), []).append(j)
        diagonals = {}
        for i in range(len(w) - k + 1):
            for j in where.get(tuple(w[i : i + k]), ()):
                diagonals.setdefault(i - j, []).append((i, j))
        runs, before = [], None
        for d in sorted(diagonals):
            first, last = min(diagonals[d])[0], max(diagonals[d])[0]
            if before is None or d - before[0] > license_scan.SHIFT or first - before[1] > length:
                runs.append([])
            runs[-1].append(d)
            before = d, last
        slack = max(2 * license_scan.SHIFT, length // 10)
        for run in runs:
            span = lambda ds: (min(min(diagonals[d])[0] for d in ds), max(max(diagonals[d])[0] for d in ds) + k - 1)
            first, last = span(run)
            long = last - first + 1 > length + slack
            for part in [[x for x in run if d <= x <= d + license_scan.SHIFT] for d in run] if long else [run]:
                first, last = span(part)
                cover = len({j for d in range(part[0], part[-1] + 1) for _, j in diagonals.get(d, ())}) / (length - k + 1)
                if cover >= license_scan.LEAST_COVER and last - first + 1 <= length + slack:
                    labels.add(label)
                    score = max(score, cover)
    return ",".join(sorted(labels)), score


def test_license_labels_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rng = random.Random(2)
    made = []
    for n, text in enumerate([*license_scan.LICENSES, *license_scan.TEMPLATES]):
        w = f"copyright 2020 somebody {text.capitalize()}, and after it some words".split()
        made.append((-10 - n, " ".join(x for x in w if rng.random() > 0.02)))
    docs = docs.unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    got = {r.doc_id: (r.labels, r.score) for r in license_scan.scan_licenses(docs).collect()}
    for i, text in ((r.doc_id, r.text) for r in docs.collect()):
        labels, score = brute_labels(text)
        assert got[i][0] == labels and got[i][1] == pytest.approx(score), i
    assert all(label in got[-10 - n][0].split(",") for n, label in enumerate(license_scan.LICENSES.values()))


def test_license_scan_of_a_very_long_text(spark):
    word = " ".join(f"w{i % 977}" for i in range(300_000))
    rows = [(1, f"{word} MIT License {word}"), (2, "x" * 2_000_000)]
    got = {r.doc_id: r for r in license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_words, got[1].first_word, got[1].labels) == (600_002, 300_000, "mit") and got[2].n_words == 1


def test_decontamination(spark, odd, empty):
    item = " ".join(f"q{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "two words"), (5, "q1 q2 q3 q4 q5 q6 q7 zz")], "item_id long, text string")
    rng = random.Random(1)
    noise = lambda n: " ".join(f"n{rng.randrange(10**6)}" for _ in range(n))
    docs = spark.createDataFrame([(1, f"{noise(3000)} {item} {noise(3000)}"), (2, noise(500)), (3, f"{noise(10)} {item[:40]}"), (4, None), (5, "Two WORDS"), (6, item.replace("q10", "zz"))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.contained_items(docs, bench).collect()}
    assert got == {(1, 1): 1.0, (5, 4): 1.0}
    kept = {r.doc_id for r in decontaminate.without_benchmark(docs, bench).collect()}
    assert kept == {2, 3, 4, 6}
    assert decontaminate.contained_items(odd, bench.limit(0)).count() == 0 and decontaminate.contained_items(empty, bench).count() == 0
    assert decontaminate.without_benchmark(odd, bench).columns == odd.columns


def test_decontamination_of_all_sizes(spark):
    rng = random.Random(7)
    noise = lambda n: [f"n{rng.randrange(10**7)}" for _ in range(n)]
    sizes = [*range(4, 64), 80, 150, 400, 1000, 2500, 5000]  # few are long: a quarter of the items holds 48 to 5000 words
    items = [(n, [f"i{n}w{j}" for j in range(size)]) for n, size in enumerate(sizes)]
    docs = []
    for n, w in items:
        cut = w[: max(1, len(w) * 17 // 20)]
        for passage in (w, cut, w[: len(w) // 2]):
            docs.append((len(docs), " ".join(noise(rng.randrange(9000)) + passage + noise(9000))))
    bench = [(n, " ".join(w)) for n, w in items]
    sets = {n: shingles(t, 5) for n, t in bench}
    want = set()
    for d, text in docs:
        whole = shingles(text, 5)
        want |= {(d, n, len(s), len(s & whole)) for n, s in sets.items() if 100 * len(s & whole) >= 80 * len(s)}
    frame, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    assert len(want) > len(bench)
    assert {tuple(r)[:4] for r in decontaminate.contained_items(frame, items).collect()} == want
    clean = {r.doc_id for r in decontaminate.without_benchmark(frame, items).collect()}
    assert clean == {d for d, _ in docs} - {d for d, *_ in want}


def test_quality_classifier(spark, odd, empty):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op8_quality_classifier(spark, sf).join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.held_out for r in rows} == {True, False} and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert sum(r.predicted == r.quality for r in held) / len(held) >= 0.9
    weights = quality_classifier.train(odd, spark.createDataFrame([(1, 1), (10, 0), (None, 1), (2, None)], "doc_id long, label int"))
    got = quality_classifier.score_quality(odd, weights).collect()
    assert len(got) == 13 and all(r.score is not None for r in got) and quality_classifier.score_quality(empty, weights).count() == 0


def test_classifier_equals_a_plain_loop(spark):
    """Features, follow-the-regularised-leader steps and scores, each recomputed with dictionaries."""
    from stratasift.llm.common import mix64

    Q = quality_classifier
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["good", "Text", "BAD", "b4d", "spam", "the", "it's"][: 3 + i % 5]) for _ in range(rng.randrange(1, 30))) for i in range(80)]
    rows = [(i, t, i % 2) for i, t in enumerate(texts)] + [(80, None, 1), (81, "", 0)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, label int")
    from xxhash import xxh3_64_intdigest as digest

    def slots(text):
        w = (text or "").encode().split()
        low, shape = [digest(x.lower()) for x in w], [digest(b"\x00" + Q._shape(x)) for x in w]
        pair = lambda h: [(a * 3 + b) % 2**64 for a, b in zip(h, h[1:])]
        all_ = [*low, *shape, *pair(low), *pair(shape), *[12345 for a, b in zip(low, low[1:]) if a == b]]
        count = Counter(int(x) >> (64 - Q.BITS) for x in mix64(np.array(all_, dtype=np.uint64)))
        value = {i: 1 + math.log(n) for i, n in count.items()}
        norm = math.sqrt(sum(v * v for v in value.values()))
        return {i: v / norm for i, v in value.items()}

    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    z, n = Counter(), Counter()

    def weight(i):
        return 0.0 if abs(z[i]) <= Q.L1 else -(z[i] - math.copysign(Q.L1, z[i])) / ((Q.BETA + math.sqrt(n[i])) / Q.ALPHA + Q.L2)

    bias = 1 << Q.BITS
    for _ in range(Q.EPOCHS):
        for _, text, label in sorted(rows, key=lambda r: order[r[0]]):
            x = {**slots(text), bias: 1.0}
            w = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - label) * x[i]
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / Q.ALPHA * w[i]
                n[i] += g * g
    weights = Q.train(docs, labels)
    assert {int(i) for i in np.flatnonzero(weights)} == {i for i in z if weight(i)}
    assert all(weights[i] == pytest.approx(weight(i)) for i in z)
    got = {r.doc_id: r for r in Q.score_quality(docs, weights).collect()}
    for i, text, _ in rows:
        want = 1 / (1 + math.exp(-(weight(bias) + sum(weight(j) * v for j, v in slots(text).items()))))
        assert got[i].score == pytest.approx(want) and got[i].predicted == (got[i].score >= 0.7)
    assert np.array_equal(Q.train(docs.unionByName(docs).unionByName(docs), labels, sample=20) != 0, Q.train(docs.unionByName(docs).unionByName(docs), labels, sample=20) != 0)


def test_lattice_likelihood():
    pieces = lattice_lm.Pieces(["▁", "▁a", "a", "b", "ab", "▁ab", "\x00x"], np.log(np.array([0.1, 0.2, 0.1, 0.2, 0.1, 0.1, 0.1, 0.1])), np.full(256, 6))
    p = dict(zip(["▁", "▁a", "a", "b", "ab", "▁ab"], [0.1, 0.2, 0.1, 0.2, 0.1, 0.1]))

    def brute(s):
        return 1.0 if not s else sum(p.get(s[:k], 0.1 ** len(s[:1].encode()) if k == 1 and s[0] not in "▁ab" else 0.0) * brute(s[k:]) for k in range(1, len(s) + 1))

    names = [b"ab", b"b", b"aab", b"abab", "aé".encode()]
    z, _ = lattice_lm.lattices(names, pieces)
    assert np.allclose(z, [math.log(brute("▁" + n.decode())) for n in names])
    _, uses = lattice_lm.lattices([b"ab"], pieces, np.array([2.0]))
    whole = brute("▁ab")
    assert uses[5] == pytest.approx(2 * 0.1 / whole) and uses[3] == pytest.approx(2 * (0.2 * 0.2 + 0.1 * 0.1 * 0.2) / whole)


def test_lattice_scores(spark, odd, empty, monkeypatch):
    for shared in (1 << 19, 300):  # all words shared, then most joined
        monkeypatch.setattr(lattice_lm, "FREQUENT", shared)
        rows = {r.doc_id: r for r in queries.op9_lattice_lm(spark, SF).collect()}
        texts = {r.doc_id: [*words(r.text), None] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
        count = Counter(w for i, ws in texts.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
        n, v = sum(count.values()), len(count)
        for i, ws in texts.items():
            r = rows[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 10 == 0, len(ws), sum(count[w] > 0 for w in ws), n)
            assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) and r.score < 0
    got = lattice_lm.score_texts(odd.withColumn("train", F.col("doc_id") != 7), queries.VOCABULARY).collect()
    assert len(got) == 13 and {r.doc_id: r.n_tokens for r in got}[4] == 1
    assert lattice_lm.score_texts(empty.withColumn("train", F.lit(True)), queries.VOCABULARY).count() == 0


def test_source_mix(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = source_mix.mix(docs, shards=8, blocks=256).collect()
    per, target = Counter(), {}
    for r in pieces:
        per[r.source] += r.words
        target[r.source] = r.target
    assert all(per[s] == round(t) for s, t in target.items())
    loads = Counter()
    for r in pieces:
        if r.shard is not None:
            loads[r.shard] += r.words
    assert len(loads) == 8 and max(loads.values()) < 1.3 * min(loads.values())
    again = source_mix.mix(docs, shards=8, blocks=256).collect()
    assert Counter(map(tuple, pieces)) == Counter(map(tuple, again))
    got = source_mix.taken_by_document(odd).collect()
    assert sum(r.taken for r in got) == sum(r.size for r in got) and all(r.taken <= 3 * r.size for r in got)
    assert source_mix.taken_by_document(empty).count() == 0
    assert all(r.taken == 0 for r in source_mix.taken_by_document(odd.where("doc_id in (4, 5, 6)")).collect())


def test_source_mix_shards(spark):
    """Shards and pieces of documents by the tree's rows, and by SQL for another number of shards."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert_same(spark, lambda spark, sf: source_mix.taken_by_document(docs, 8, 64, 5), source_mix.oracle_sql(8, 64, 5), SF)
    pieces = [r for r in source_mix.mix(docs, 8, 64, 5).collect() if r.shard is not None]
    got = {r.doc_id: r for r in source_mix.taken_by_document(docs, 8, 64, 5).collect()}
    for i, r in got.items():
        own = [p for p in pieces if p.doc_id == i]
        assert r.shards == ",".join(map(str, sorted({p.shard for p in own}))) and r.n_pieces == len(own) and r.taken == sum(p.words for p in own)
    blocks = Counter((p.source, p.shard) for p in pieces)
    assert len({shard for _, shard in blocks}) == 8
    order = sorted((p.shard, p.position) for p in pieces)
    assert len(set(order)) == len(order)


def test_splitting_tree(spark):
    quotas = spark.createDataFrame([(1, 100), (2, 300), (3, 1)], "source_no long, n_blocks long")
    rows = source_mix.split_quotas(quotas, 5, 1).collect()
    per = Counter()
    for r in rows:
        per[r.source_no] += r.n
    assert per == {1: 100, 2: 300, 3: 1} and max(Counter({s: sum(r.n for r in rows if r.shard == s) for s in range(5)}).values()) <= 82


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    steps, current = [], docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        current = spark.createDataFrame(stage(spark, current, SF).toPandas(), docs.schema)
        assert current.columns == docs.columns
        steps.append({r.doc_id: r.text for r in current.collect()})
    hasher = quality_rules.WordHasher()
    start = {r.doc_id: r.text for r in docs.collect()}
    assert set(steps[0]) == {i for i, t in start.items() if quality_rules.measure(t, hasher)[6]}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(sorted(steps[0].items()), columns=["doc_id", "text"]))
    cut = {r[0]: (r[1], r[2]) for r in con.execute(f"select doc_id, text, n_cut from ({line_dedup.ORACLE_SQL})").fetchall()}
    assert steps[1] == {i: t for i, (t, lost) in cut.items() if t.split() and 3 * lost <= 2 * (len(t) + lost)}
    heads = brute_components(list(steps[1].items()), 5, 80, 100)
    assert set(steps[2]) == {i for i, (_, c) in heads.items() if c == i}
    items = [shingles(r.text, 5) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(steps[3]) == {i for i, t in steps[2].items() if not any(100 * len(s & shingles(t, 5)) >= 80 * len(s) for s in items)}
    final = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, SF).collect()}
    taken = {r.doc_id: r.taken for r in source_mix.taken_by_document(current).collect()}
    assert set(taken) == set(steps[3]) and final == {i: n for i, n in taken.items() if n > 0}


def test_pipeline_stages_on_shared_ids_and_near_copies(spark):
    import corpus_pipeline

    rng = random.Random(3)
    para = lambda n: " ".join(f"word{rng.randrange(5000)}" for _ in range(n))
    text = "\n".join(para(36) for _ in range(4))
    changed = text.split("\n")
    changed[2] = changed[2].replace(changed[2].split()[5], "another", 1)
    rows = [(1, text), (1, para(60)), (1, text), (2, "\n".join(changed)), (None, text), (3, para(50))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), 9) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, n_cut int")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    assert sorted(((r.doc_id or 0), r.text) for r in kept) == sorted([(1, text), (1, rows[1][1]), (0, text), (3, rows[5][1])])
    assert kept[0].n_cut == 9
    cut = corpus_pipeline.lines(spark, docs.drop("n_cut").where("doc_id <> 1 or text like '%\n%'"), SF).collect()
    assert {r.doc_id for r in cut} == {1, 3, None}  # of document 2 one line of four would be left


def test_entry_registers_all():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
