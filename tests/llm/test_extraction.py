"""Operator 4 against hand-made pages, a deduction by brute force and the synthetic pages."""

import html
import random
import re
from collections import Counter, defaultdict

import pytest

from recordloom.llm import extraction


def text_of(page):
    return extraction.Article(page).texts


@pytest.mark.parametrize(
    "page,want",
    [
        ("", []),
        ("plain   text", ["plain text"]),
        ("<nav>menu</nav><article><h1>T&amp;t</h1><p>one<br>two <b>th</b>ree<p>four</article><footer>f</footer>", ["T&t", "one two three", "four"]),
        ("<article><p>a</p><aside>x</aside><div class='ad'>y</div><div id=comments><p>c</p></div><p>b &lt;i&gt;</article>", ["a", "b <i>"]),
        ("<article><header><h1>Title</h1><span>by me</span></header><p>x</p><footer>f</footer><form>q<input></form></article>", ["Title", "x"]),
        ("<main><p>more</p><article class='post has-sidebar'><p>a</p><article class='comment'>c</article></article></main>", ["more", "a"]),
        ("<main><h1>T</h1><article><p>one two three four five</p></article><article><h2><a href=x>T</a></h2></article></main>", ["T", "one two three four five"]),
        ("<div class='alert-study'>kept</div><div class='sidebar-left'>no</div><div class='site-footer'>no</div>", ["kept"]),
        ("<p>a<span class=ad><span>x</span>tail</span>b", ["ab"]),
        ("<p>a<![CDATA[bcd", ["abcd"]),
        ("<main><p>a<script>var t='</p>';</script>b</p><style>p{}</style></main><p>out</p>", ["ab"]),
        ("<body class='has-sidebar'><div class='sidebar'>s</div><div><p>kept</p><p hidden>no</p></div></body>", ["kept"]),
        ("<article><p>never closed <i>x<!-- c --> y &am", ["never closed x y &am"]),
        ("<article><ul><li>a<li>b</ul><table><tr><td>1<td>2</table></article>", ["a", "b", "1", "2"]),
        ("<article><p>a < b and 3 > 2 &#233;&nbsp;&eacute;</p></article>", ["a < b and 3 > 2 é é"]),
        ("<div><ul><li><a href=1>one</a></li></ul></div>", []),
    ],
)
def test_pages(page, want):
    assert text_of(page) == want


SCHEMA = "page_id long, url string, html string"
SOUP = "<html><body><div class=a><p>Welcome to the site</p></div><div class=b><h1>title {0}</h1><p>own text {0}</p>{1}</div><div class=c><p>All rights reserved</p></div></body></html>"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS host", "2 AS tokens", "3 AS text", "4 AS content").repartition(3)


def texts(df):
    return Counter((r["page_id"], r["text"]) for r in extraction.extract(df).collect())


def test_template_words_are_dropped(spark, monkeypatch):
    """Pages without semantic tags or telling class names."""
    rows = [(k, f"http://H.example:80/{k}", SOUP.format(k, "<p>more</p>" * (k % 3))) for k in range(8)]
    rows += [(100, "http://other.example/", SOUP.format("single", "")), (101, None, None), (102, "", ""), (7, "http://h.example/7", rows[7][2])]
    df = frame(spark, rows)
    want = Counter((k, "\n\n".join([f"title {k}", f"own text {k}", *["more"] * (k % 3)])) for k in [*range(8), 7]) + Counter({(101, ""): 1, (102, ""): 1})
    want[100, "Welcome to the site\n\ntitle single\n\nown text single\n\nAll rights reserved"] += 1
    assert texts(df) == want
    got = {r["page_id"]: r for r in extraction.extract(df).collect()}
    assert got[3]["n_dropped_blocks"] == got[3]["n_template_blocks"] == 2 and got[3]["template_levels"] > 0 and got[100]["template_levels"] == 0
    assert extraction.extract(df.limit(0)).count() == 0
    monkeypatch.setattr(extraction, "BROADCAST_TOKENS", 0)
    assert texts(df) == want
    monkeypatch.setattr(extraction, "BUCKET_TOKENS", 5)  # several buckets, a hot host in several parts
    monkeypatch.setattr(extraction, "HOST_PAGES", 3)
    assert texts(df) == want


def test_one_story_at_several_urls_is_kept(spark):
    same = [(k, f"http://s.example/{k}", SOUP.format("same", "")) for k in range(9)]  # one page content
    long = SOUP.format("same", "<p>" + "a story of many words " * 20 + "</p>")
    near = [(20 + k, f"http://t.example/{k}", long.replace("Welcome", f"Welcome {k}")) for k in range(9)]
    mixed = [(40 + k, f"http://u.example/{k}", SOUP.format(k if k > 3 else "same", "").replace("Welcome", f"ad {k}")) for k in range(20)]
    got = dict(texts(frame(spark, same + near + mixed)))
    assert all("own text" in t for _, t in got)
    assert {t for k, t in got if 40 <= k < 44} == {f"ad {k} to the site\n\ntitle same\n\nown text same" for k in range(4)}


def test_a_host_with_two_templates(spark):
    other = "<html><body><section class=x><p>Shop of things</p></section><section class=y><h2>item {0}</h2><p>price {0}</p></section><section class=z><p>Pay by card</p></section></body></html>"
    rows = [(k, f"http://h.example/{k}", (SOUP.format(k, "") if k % 3 else other.format(k))) for k in range(30)]
    got = texts(frame(spark, rows))
    assert got == Counter((k, f"title {k}\n\nown text {k}" if k % 3 else f"item {k}\n\nprice {k}") for k in range(30))
    levels = {r["template_levels"] for r in extraction.extract(frame(spark, rows)).collect()}
    assert max(levels) >= 2  # the page types' own classes stand in a gap of the one that all pages share


def deduced(rows):
    """Templates by brute force: vectors as dictionaries, classes as sets of tokens with equal ones."""
    pages = defaultdict(dict)
    for _, url, page in rows:
        host = (re.match(extraction.HOST, url or "") or [None, ""])[1].lower()
        pages[host][page or ""] = extraction.page_tokens(page or "")
    out = {}
    for host, found in pages.items():
        vectors, places = defaultdict(dict), defaultdict(list)
        for content, tokens in found.items():
            for t, (n, first, text) in tokens.items():
                vectors[t, text][content] = n
                places[t].append(first)
        classes = defaultdict(list)
        for (t, text), v in vectors.items():
            if len(found) >= extraction.MIN_PAGES and len(v) >= max(extraction.MIN_PAGES, extraction.SUPPORT * len(found)):
                classes[frozenset(v.items())].append((sum(places[t]) / len(places[t]), t, text))
        valid = [(len(v), sorted(ts)) for v, ts in classes.items() if len(ts) >= extraction.MIN_SIZE and not all(x[2] for x in ts)]
        out[host] = extraction.Template([(n, [t for _, t, text in ts if not text], [t for _, t, text in ts if text]) for n, ts in valid], len(found))
    return out


def test_brute_force_deduction_gives_the_same(spark, sf_dir):
    rng = random.Random(4)
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    parts = ["<div class=m><p>menu</p><p>about</p></div>", "<div class=n><h3>news {0}</h3><p>p {1}</p></div>", "<div class=q><p>q {0}</p><ul><li>x</li><li>{1}</li></ul></div>", "<div class=f><p>imprint</p></div>"]
    for k in range(60):
        body = "".join(p.format(rng.randrange(9), rng.randrange(99)) for p in parts if rng.random() < 0.8)
        rows.append((1000 + k, f"http://{'abc'[k % 3]}.example/{k}", f"<html><body>{body}</body></html>"))
    rows += rows[:5] + [(2000, None, None)]
    brute = deduced(rows)
    want = Counter()
    for page_id, url, page in rows:
        host = (re.match(extraction.HOST, url or "") or [None, ""])[1].lower()
        found = extraction.Article(page or "", brute[host])
        want[page_id, url, "\n\n".join(found.texts), found.left, found.constant, found.levels] += 1
    got = extraction.extract(frame(spark, rows)).collect()
    assert Counter((r["page_id"], r["url"], r["text"], r["n_dropped_blocks"], r["n_template_blocks"], r["template_levels"]) for r in got) == want
    assert any(r["template_levels"] >= 2 for r in got)


def test_classes_have_equal_occurrence_vectors(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = pages.selectExpr("xxhash64(regexp_extract(url, '//([^/:]+)', 1)) AS host", "xxhash64(html) AS content", "html")
    vectors = defaultdict(dict)
    for r in rows.collect():
        for token, (n, _, _) in extraction.page_tokens(r["html"]).items():
            vectors[r["host"], token][r["content"]] = n
    got = extraction.templates(rows).collect()
    assert got
    for r in got:
        assert len({tuple(sorted(vectors[r["host"], t["token"]].items())) for t in r["tokens"]}) == 1
        assert r["pages"] == len(vectors[r["host"], r["tokens"][0]["token"]])


def test_synthetic_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r for r in extraction.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|<footer|$)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        text = "\n\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["text"] == text and got[r["page_id"]]["n_chars"] == len(text)
    assert any(r["template_levels"] for r in got.values()) and all(r["n_dropped_blocks"] for r in got.values())


def test_the_template_decides_within_main_and_article(spark):
    """The same constant words and own text in <main>, <article> and <div>: of all three the own text is the article."""
    page = "<html><body><{1}><div class=z><p>Share this page with friends</p></div><h1>title {0}</h1><p>own text {0}</p>{2}<div class=k><p>Read our terms now</p></div></{1}></body></html>"
    rows = [(100 * i + k, f"http://{tag}.example/{k}", page.format(k, tag, "<p>more</p>" * (k % 4))) for i, tag in enumerate(("main", "article", "div")) for k in range(20)]
    got = {r["page_id"]: r for r in extraction.extract(frame(spark, rows)).collect()}
    for i in range(3):
        for k in range(20):
            assert got[100 * i + k]["text"] == "\n\n".join([f"title {k}", f"own text {k}", *["more"] * (k % 4)])
            assert got[100 * i + k]["n_template_blocks"] == 2
    without = {i: extraction.Article(h).texts for i, _, h in rows}
    assert sum("\n\n".join(without[i]) != r["text"] for i, r in got.items()) == len(rows)  # the template changed every page


def test_plain_paragraphs_beside_links_stay(spark):
    page = "<html><body><h1>title {0}</h1><p><a href=x>The long linked report number {0} on everything</a> ok</p><p>own text {0}</p><ul><li><a href=1>one</a><li><a href=2>two</a> too</ul><ol><li>first<li><a href=3>s</a>econd</ol></body></html>"
    rows = [(k, f"http://h.example/{k}", page.format(k)) for k in range(20)]
    assert texts(frame(spark, rows)) == Counter((k, f"title {k}\n\nown text {k}") for k in range(20))  # the list's words are the template's
    one = extraction.Article(page.format(1)).texts
    assert one == ["title 1", "own text 1", "first", "second"]


def test_headings_of_own_text_stay(spark):
    page = "<html><body><article><h1>title {0}</h1><h2>Summary</h2><p>short {0}</p><h2>Sources</h2><p>None given</p><h2>Details</h2><p>long {0}</p><h2>The end</h2></article></body></html>"
    rows = [(k, f"http://h.example/{k}", page.format(k)) for k in range(12)]
    assert texts(frame(spark, rows)) == Counter((k, f"title {k}\n\nSummary\n\nshort {k}\n\nDetails\n\nlong {k}") for k in range(12))


def made(rng, host, tag, k):
    """A page of a host and its article's text, by the page's own plan: what is constant, what is own, what is a menu."""
    parts, want = [], []
    for n, kind in enumerate(host):
        if kind == "constant":
            parts.append(f"<div class=c{n}><p>Words of the site number {n}</p></div>")
        elif kind == "own":
            for _ in range(rng.randint(1, 3)):
                text = f"paragraph {k} {n} {rng.randrange(10**6)} with a <a href=/x>link</a> in its text"
                parts.append(f"<div class=o{n}><p>{text}</p></div>")
                want.append(re.sub("<[^>]*>", "", text))
        elif kind == "menu":
            parts.append(f"<div class=l{n}><ul>" + "".join(f"<li><a href=/{j}>Entry {k} {j}</a></li>" for j in range(rng.randint(2, 5))) + "</ul></div>")
            if tag == "article":
                want += [f"Entry {k} {j}" for j in range(parts[-1].count("<li>"))]
        elif kind == "advert":
            parts.append(f"<div class='ad banner'><p>Buy {rng.randrange(10**6)}</p></div>")
    return f"<html><body><{tag}>{''.join(parts)}</{tag}></body></html>", "\n\n".join(want)


def test_slots_are_chosen_as_the_pages_were_made(spark):
    rng = random.Random(12)
    rows, want = [], Counter()
    for h in range(24):
        plan = ["own", *(rng.choice(["constant", "own", "menu", "advert", "constant"]) for _ in range(rng.randint(2, 6)))]
        rng.shuffle(plan)
        tag = ("div", "main", "article")[h % 3]
        for k in range(15):
            page, text = made(rng, plan, tag, k)
            rows.append((100 * h + k, f"http://h{h}.example/{k}", page))
            want[100 * h + k, text] += 1
    assert texts(frame(spark, rows)) == want
