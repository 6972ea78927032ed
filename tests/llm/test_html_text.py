from pyspark.sql import functions as F

from monthmark.llm.html_text import aligned, blocks_of, extract_text, groups_of, host_of, is_furniture

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header class="masthead"><a href="/">Site</a></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="post-{n}" class="content">
<h1>Title {n}</h1><p>First &amp; <b>bold   text</b> number {n}<p>Second
paragraph{extra}</div><aside>Side</aside><div class="comments"><p>Reader says {n}</p></div>
<form><p>Name</p></form><div class=ad>Buy {n}</div><footer>&copy; me</footer></body></html>"""


def run(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", F.lit(1).alias("text"), F.lit(2).alias("_host"))
    return {r["page_id"]: r for r in extract_text(df).collect()}


def test_pages_of_a_host(spark):
    rows = [(i, f"https://h.example/{i}", PAGE.format(n=i, extra="<ul><li>x<li>y</ul>" if i % 3 == 0 else "")) for i in range(12)]
    got = run(spark, rows)
    for i in range(12):
        want = f"Title {i}\nFirst & bold text number {i}\nSecond paragraph" + ("\nx\ny" if i % 3 == 0 else "")
        assert got[i]["text"] == want and got[i]["n_chars"] == len(want)


def test_article_wins_and_its_repeats_stay(spark):
    page = ("<body><div class='wrap'><nav><a>m</a></nav><article><header><h1>H{n}</h1></header><p>Same line.</p><p>Same line.</p>"
            "<p>own {n}</p></article><article class='comment'><p>I disagree with all of that, at length, {n}</p></article></div>")
    got = run(spark, [(i, "http://A.Example:80/x", page.format(n=i)) for i in range(5)])
    assert got[4]["text"] == "H4\nSame line.\nSame line.\nown 4"


def test_nested_groups_keep_headline_lead_and_close(spark):
    body = "".join(f"<p>Paragraph {{n}} {k} of the article, long enough to weigh much more than its headline.</p>" for k in range(6))
    nested = "<body><div class='logo'>My site</div><div class='post'><h1>Title {n}</h1><div class='post-body'>" + body + "</div></div></body>"
    equal = ("<body><div class='logo'>My site</div><div class='wrap'><h1><a href='/'>Title {n}</a></h1><p>Lead {n}</p><section>" + body + "</section><section>" + body
             + "</section>{end}</div><div class='legal'>All rights reserved</div></body>")
    lines = [f"Paragraph {{n}} {k} of the article, long enough to weigh much more than its headline." for k in range(6)]
    for pages in (1, 8):
        rows = [(i, "http://nested/", nested.format(n=i)) for i in range(pages)]
        rows += [(100 + i, "http://equal/", equal.format(n=i, end="<div class='last'>Only once.</div>" if i == 5 else "")) for i in range(pages)]
        got = run(spark, rows)
        for i in range(pages):
            text = "\n".join(lines).format(n=i)
            assert got[i]["text"] == f"Title {i}\n{text}"
            want = f"Title {i}\nLead {i}\n{text}\n{text}" + "\nOnly once." * (i == 5)
            assert got[100 + i]["text"] == want if pages > 1 else want in got[100 + i]["text"]


def test_layout_wrappers_are_no_furniture(spark):
    text = "<h1>Title {n}</h1><p>First paragraph {n} of some length.</p><p>Second paragraph {n} of some length.</p>"
    side = "<div class='sidebar'>Side {n}</div><div class='comments'><p>" + "A reader says much more than the article, {n}. " * 9 + "</p></div>"
    forms = {"wrap": "<div class='content-sidebar-wrap'>" + text + side + "</div>", "has": "<div class='has-sidebar'><main>" + text + "</main>" + side + "</div>",
             "search": "<div id='search-results'>" + text + "</div>", "article": "<div class='site'><div class='no-sidebar'><article>" + text + "</article>" + side + "</div></div>",
             "inner": "<article><h1>Title {n}</h1><div class='nav-wrap'>" + text.partition("</h1>")[2] + "</div></article>", "outside": text + side,
             "off": "<div class='comments-off'>" + text + "</div>"}
    rows = [(100 * k + i, f"http://{name}/{i}", f"<body><nav><a href=/>Home</a></nav>{form.format(n=i)}<div class='cookie'>We use cookies</div></body>")
            for k, (name, form) in enumerate(forms.items()) for i in range(4)]
    rows += [(900, "http://outside/9", f"<body><div id='search-results'>{text.format(n=900 % 100)}</div></body>"),
             (901, "http://outside/10", "<body><nav>Home</nav><div class='cookie-notice'>We use cookies</div></body>")]
    got = run(spark, rows)
    assert got.pop(901)["text"] == ""
    for k, r in got.items():
        n = k % 100
        assert r["text"] == f"Title {n}\nFirst paragraph {n} of some length.\nSecond paragraph {n} of some length.", r["url"]


def test_odd_pages(spark):
    rows = [(1, "http://x/1", None), (2, "http://x/2", ""), (3, None, "plain text &lt;only&gt;\n  here"), (4, "http://y", "<p>unclosed <b>soup<div>next"),
            (5, "http://y", "<p>unclosed <b>soup<div>next"), (6, "not a url", "<script>var x = 1"), (7, "http://y", "<!-- never closed <p>x</p>"),
            (8, "http://z", "<article>" + "<p>word word word</p>" * 5000 + "</article>"), (9, "http://q", '<p title="a>b">quoted</p></div></p>'),
            (10, "http://q", "a < b & c &unknown; &#65;&#x42;"), (None, "http://q", "<p>no key</p>")]
    got = run(spark, rows)
    text = {k: r["text"] for k, r in got.items()}
    assert text[1] == text[2] == text[6] == text[7] == ""
    assert text[3] == "plain text <only> here" and text[4] == text[5] == "unclosed soup\nnext"
    assert text[8].count("\n") == 4999 and text[9] == "quoted" and text[10] == "a < b & c &unknown; AB" and text[None] == "no key"
    assert run(spark, []) == {}


def test_hosts(spark):
    urls = ["HTTP://User@WWW.Ex.org:8080/a", "//h/x", "mailto:a", None, ""]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    assert [r[0] for r in df.select(host_of(F.col("u"))).collect()] == ["www.ex.org", "h", "", "", ""]


def shape(groups):
    return [(g[0] + "+" * g[2] + "?" * g[3], shape(g[1])) if g[0] != "#" else ("#" if g[6] is None else "text") for g in groups]


def test_alignment_is_union_free():
    a = groups_of(blocks_of("<ul><li>a<li>b<li>c</ul><p>same</p>"))
    b = groups_of(blocks_of("<ul><li>a</ul><h2>new</h2><p>same</p><p>more</p>"))
    assert shape(a) == [("ul", [("li+", ["#"])]), ("p", ["text"])]
    assert shape(aligned(a, b)) == [("ul", [("li+", ["#"])]), ("h2?", ["text"]), ("p+", ["#"])]
    pairs = groups_of(blocks_of("<dl><dt>a<dd>1<dt>b<dd>2<dt>c<dd>3</dl>"))
    assert shape(pairs) == [("dl", [("dt+", ["#"]), ("dd+", ["#"])])]


def test_furniture():
    assert is_furniture("div.ad", False) and is_furniture("div.side.sidebar", False) and not is_furniture("div.header", False)
    assert is_furniture("header", False) and not is_furniture("header", True) and is_furniture("div.role.navigation", False)
    assert not is_furniture("div.article.body", False)


def test_deep_and_wide_pages(spark):
    deep = "<body>" + "<div>" * 10_000 + "<p>bottom {n}</p><div class=ad>Buy</div>" + "</div>" * 10_000 + "<p>after {n}</p></body>"
    levels = "<body>" + "".join(f"<div>level {k} of {{n}}" for k in range(3_000)) + "</body>"
    tags = ["p", "h2", "div", "ul class=a", "table class=b", "section", "pre"]
    wide = ["<body><article>" + "".join(f"<{tags[k * k * (n + 3) % 7]}>text {n} {k}</{tags[k * k * (n + 3) % 7].split()[0]}>" for k in range(5_000))
            + "</article></body>" for n in range(6)]
    rows = [(k, f"http://deep/{k}", deep.format(n=k)) for k in range(3)] + [(10 + k, "http://levels/", levels.format(n=k)) for k in range(3)]
    rows += [(20 + k, "http://wide/", page) for k, page in enumerate(wide)]
    got = run(spark, rows)
    assert got[1]["text"] == "bottom 1\nafter 1"
    assert got[11]["text"] == "\n".join(f"level {k} of 1" for k in range(3_000))
    assert got[23]["text"] == "\n".join(f"text 3 {k}" for k in range(5_000))


def test_wide_alignment_is_near_linear():
    import time

    pages = [groups_of(blocks_of("".join(f"<p class=c{''.join(chr(97 + int(d)) for d in str((k * 7919 + n) % 3_000))}>x {n}</p>" for k in range(3_000))))
             for n in range(4)]
    start, wrapper = time.perf_counter(), pages[0]
    for p in pages[1:]:
        wrapper = aligned(wrapper, p)
    assert time.perf_counter() - start < 5 and len(wrapper) <= 3_000


def test_grid_columns_are_different_places(spark):
    page = ("<body><div class='row'><div class='col-md-8'><h1>Title {n}</h1><p>The article number {n} says a good deal.</p></div>"
            "<div class='col-md-4'><h4>Other stories</h4><p>Teaser</p></div></div></body>")
    rows = [(k, "http://grid/", page.format(n=k)) for k in range(6)]
    assert run(spark, rows)[2]["text"] == "Title 2\nThe article number 2 says a good deal."


def test_raw_elements_never_end_themselves(spark):
    page = ("<body><article><p>one</p><script src=/a.js/>var leak = 1;</script><style media=x />p {}</style><svg/><p>two</p>"
            "<iframe src=/x/>inner</iframe><p>three</p></article></body>")
    assert run(spark, [(1, "http://raw/", page)])[1]["text"] == "one\ntwo\nthree"
