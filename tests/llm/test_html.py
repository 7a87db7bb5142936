"""Main text of pages: given pages against their article, and planted templates."""

import html
import random
import re

from ragframe.llm import html as HT
from ragframe.llm.catalog import QUERIES

SF = "/root/testdata/sf0.01"


def article(page):
    inner = page[page.index("<article>") + 9:page.index("</article>")]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(b for b in blocks if b)


def test_given_pages(spark):
    want = {r.page_id: (r.url, article(r.html)) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op5_html"](spark, SF).collect()
    assert {r.page_id: (r.url, r.text) for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def one(pages):
    wrapper = None
    for p in pages:
        w = HT.to_wrapper(*HT.read_page(p))
        wrapper = w if wrapper is None else HT.align(wrapper, w)
    decided = HT.decide(wrapper)
    return wrapper, [HT.extract(p, decided) for p in pages]


def test_everything_beside_the_article_goes():
    page = """<!doctype html><HTML><Head><title>T</title><script>var x = "</article><p>no</p>";</script></head><body class="with-sidebar">
    <header><h1>Site</h1></header><div id=cookie-notice>We use cookies</div><nav><a href="/">Home</a></nav><div class="ad-slot"><p>Buy</p></div>
    <main><article><header><h1>Title &amp; more</h1></header><p>One <b>bold</b>&nbsp;word<br>next<p>Two<!-- no --> &lt;b&gt; <span class=advert>Buy</span>
    <div class="share-buttons">Share</div><form>Mail <input></form><ul><li>a<li>b</ul><blockquote>Said</blockquote><table><tr><td>x<td>y</table>
    <script>no()</script><style>p{}</style><noscript>no</noscript><pre>c  d</pre></article><section class="comments"><p>First!</p></section></main>
    <aside>Side</aside><div class="sidebar"><p>More</p></div><div class="newsletter">Subscribe</div><footer>&copy;</footer>"""
    _, (got,) = one([page])
    assert got == "Title & more\n\nOne bold word next\n\nTwo <b>\n\na\n\nb\n\nSaid\n\nx\n\ny\n\nc d"


def test_wrapper_without_article_element_keeps_what_changes():
    pages = [f"<div><p>Top line</p></div><div><h2>{t}</h2><p>{t} one</p><p>{t} two</p></div>{extra}<div><p>Bottom line</p></div>"
             for t, extra in (("A", ""), ("B", "<table><tr><td>B cell</table>"), ("C", ""))]
    wrapper, got = one(pages)
    assert got == ["A\n\nA one\n\nA two", "B\n\nB one\n\nB two\n\nB cell", "C\n\nC one\n\nC two"]
    flat = str(wrapper)
    assert "'table', [['tr'" in flat and any(k[0] == "table" and k[3] for k in wrapper)  # an optional group


def test_every_page_by_its_own_regions():
    pages = ["<article class='post category-news'><p>A one<p>A two</article>", "<article class='post category-sport'><p>B one</article>",
             "<main><p>C one</main><p>Beside", "<div class='content wide'><p>D one</div>", "<p>E one<p>E two", "<article><p>F one</article><nav>N</nav><article class=more><p>F two</article>"]
    _, got = one(pages)
    assert got == ["A one\n\nA two", "B one", "C one", "D one", "E one\n\nE two", "F one\n\nF two"]
    assert one(["<h1 class=main-title>T</h1><div class=content><p>x</div>"])[1] == ["x"]


def test_long_sibling_lists_are_aligned_exactly(monkeypatch):
    def slow(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            new = [0]
            for j, b in enumerate(y):
                new.append(row[j] + 1 if a == b else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    rng = random.Random(3)
    for cells in (HT.MAX_CELLS, 20):
        monkeypatch.setattr(HT, "MAX_CELLS", cells)
        for _ in range(200):
            x, y = rng.choices("abcde", k=rng.randint(0, 40)), rng.choices("abcdef", k=rng.randint(0, 60))
            got = HT._common(x, y)
            assert len(got) == slow(x, y) and all(x[i] == y[j] for i, j in got) and got == sorted(got) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)


def test_texts_without_a_partner_stay():
    page = "<article>" + "".join(f"<h2 id=part-{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}>H{i}</h2><p class=k{'abcdefg'[i % 7]}>P{i}</p>" for i in range(90)) + "</article>"
    other = "<article><section><p>S</section><ul><li>x<li>y</ul></article>"
    decided = HT.decide(HT.to_wrapper(*HT.read_page(other)))
    assert HT.extract(page, decided) == "\n\n".join(f"{c}{i}" for i in range(90) for c in "HP")
    assert HT.extract("<article><nav>N</nav><div><p>a</div><div class=comments>c</div></article>", decided) == "a"
    assert HT.read_page("<h2 id=history>x</h2>")[0][0][0] == "h2"
    assert one([page, other])[1] == ["\n\n".join(f"{c}{i}" for i in range(90) for c in "HP"), "S\n\nx\n\ny"]


def test_ends_of_deep_elements_close_nothing_else():
    page = "<div><article>" + "<div>" * 80 + "deep" + "</div>" * 80 + "<p>after</article></div><p>out"
    assert one([page])[1] == ["deep\n\nafter"]


def test_whole_texts_and_copies_of_pages():
    lead = "The same lead of every day. " * 10
    pages = [f"<div><p>Top line</p></div><div><h2>{t}</h2><p>{lead}{t} rest</p></div>{extra}" for t, extra in (("A", ""), ("B", "<blockquote>Only B</blockquote>"), ("C", ""))]
    _, got = one([*pages, pages[1].replace("<h2>", "<!-- copy --><h2>")])
    assert got[:3] == [f"A\n\n{lead}A rest", f"B\n\n{lead}B rest\n\nOnly B", f"C\n\n{lead}C rest"] and got[3] == got[1]


def test_repeated_groups():
    tree, _ = HT.read_page("<dl>" + "<dt>t<dd>d" * 4 + "</dl>")
    assert [k[0] for k in tree[0][1]] == ["(dt dd)"] and tree[0][1][0][2]
    a = "<article>" + "<h2>x</h2><p>y</p>" * 3 + "</article>"
    b = "<article>" + "<h2>x</h2><p>y</p>" * 9 + "<p>z</p></article>"
    _, got = one([a, b])
    assert got[1] == "\n\n".join(["x", "y"] * 9 + ["z"])


def test_broken_markup():
    for page in ("<", "<a", "<p", "</p>", "<p><div></p>x", "<script>never closed <p>x", "<!-- open", "<a href=\"x>y</a><p>z", "<b>" * 3000 + "x", "<div>" * 3000 + "x", "&", "&amp", "a & b", "\x00"):
        one([page])
    assert one(["<p>x" + "<div>" * 500 + "deep" + "</div>" * 500])[1][0].endswith("deep")
    assert one(["a &amp b &copy; &#65; &bogus; <p>c"])[1] == ["a & b © A &bogus;\n\nc"]
    assert one(["x" * 300_000])[1] == ["x" * 300_000]


def test_odd_rows(spark):
    rows = [(1, None, "<p>x</p>", 1), (2, "http://a/b", None, 1), (3, "http://a/c", "", 1), (3, "http://a/c", "<article><p>y</article>", 1), (3, "http://a/c", "<article><p>y</article>", 1), (None, "http://a/d", "<p>q", 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = sorted(HT.extract_pages(pages).collect(), key=lambda r: (r.page_id or 0, r.text))
    assert [(r.page_id, r.text, r.n_chars) for r in got] == [(None, "q", 1), (1, "x", 1), (2, "", 0), (3, "", 0), (3, "y", 1), (3, "y", 1)]
    assert HT.extract_pages(pages.limit(0)).count() == 0


def test_wrappers_do_not_depend_on_the_partitions(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    a = {r.page_id: r.text for r in HT.extract_pages(pages.repartition(1)).collect()}
    b = {r.page_id: r.text for r in HT.extract_pages(pages.repartition(13)).collect()}
    assert a == b


def plain_host(n=6):
    """Pages whose classes say nothing: a box of the template and readers' words inside the
    article, cards of other articles beside it."""
    pages, want = [], []
    for i in range(n):
        said = "".join(f"<div class=alfa><span>Name {i}{j}</span><p>Opinion {i} {j}</p></div>" for j in range(i % 3))
        cards = "".join(f"<article class=bravo><h2>Card {i}{j}</h2><p>Short {i}{j}</p></article>" for j in range(3))
        body = f"<h1>Title {i}</h1><p>{f'First {i}. ' * 12}</p><p>{f'Second {i}. ' * 9}</p>"
        pages.append(f"<body><main><article>{body}<div class=charlie><p>Written by the desk</p><p>All about us</p></div>"
                     + (f"<div class=delta>{said}</div>" if said else "") + f"</article></main><section class=echo>{cards}</section></body>")
        want.append(f"Title {i}\n\n" + f"First {i}. " * 11 + f"First {i}.\n\n" + f"Second {i}. " * 8 + f"Second {i}.")
    return pages, want


def test_the_wrapper_decides_where_words_say_nothing(spark):
    """Box, readers' words and cards go by the wrapper; an empty one keeps them all."""
    pages, want = plain_host()
    _, got = one(pages)
    assert got == want
    empty = [HT.extract(p, []) for p in pages]
    assert all(len(e) > len(w) + 60 and w.split("\n\n")[0] in e for e, w in zip(empty, want))
    rows = [(i, f"http://h{k}.org/{i}", p) for k in range(2) for i, p in enumerate(pages, 100 * k)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for n in (1, 3, 12):
        got = {r.page_id: r.text for r in HT.extract_pages(df.repartition(n)).collect()}
        assert got == {i: want[i % 100] for i, _, _ in rows}


def test_content_that_only_looks_like_it_stays():
    """Sections with headings, lists, tables, a list of articles of equal size, boxes that
    only copies of one page share."""
    pages = ["<article><p>Lead %d</p><div class=q><h3>Q %d</h3><p>A %d</p></div><div class=q><h3>Q2 %d</h3><p>A2 %d</p></div><ul><li>x%d<li>y%d</ul></article>" % ((i,) * 7)
             if i % 2 else "<article><p>Lead %d</p></article>" % i for i in range(4)]
    assert one(pages)[1][1] == "Lead 1\n\nQ 1\n\nA 1\n\nQ2 1\n\nA2 1\n\nx1\n\ny1"
    index = ["<main>" + "".join(f"<article><h2>T{i}{j}</h2><p>Body {i}{j}</p></article>" for j in range(3)) + "</main>" for i in range(3)]
    assert one(index)[1][2] == "\n\n".join(f"T2{j}\n\nBody 2{j}" for j in range(3))
    box = "<article><p>a</p><div class=k><p>b</p></div></article>"
    assert one([box, box + "<!-- copy -->"])[1] == ["a\n\nb"] * 2
