import time
import tracemalloc
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import html_text as H


def text(source, fixed=(), everywhere=()):
    return H.main_text(H.parse(source), set(fixed), set(everywhere))


def test_article_without_chrome():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="<p>no</p>";</script></head>
    <body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li>Menu</ul></nav><div class="cookie-notice">We use cookies</div>
    <div id="page"><aside>side</aside><article><header><h1>A &amp; B</h1></header><p>One <b>two</b>
      three<br>four<p>five &lt;six&gt; &eacute;&#233;&#x41; <!-- gone <p>x</p> --> seven</p><div class="ad">Buy</div><form><p>name</p></form>
      <table><tr><td>c1<td>c2</table><ul><li>i1<li>i2</ul><pre> a
      b </pre><section class="comments"><article class="comment">reader</article></section><footer>by</footer></article></div><footer>&copy;</footer></body></html>"""
    assert text(page) == "A & B\n\nOne two three four\n\nfive <six> éé\x41 seven\n\nc1\n\nc2\n\ni1\n\ni2\n\na b"


def test_broken_markup():
    assert text("<article><p><b>x<br><p>y</p></b> z") == "x\n\ny\n\nz"
    assert text("<article>a < b and c > d <3 <p>e<script>if (a<b) {</article>") == "a < b and c > d <3\n\ne"
    assert text('<article><p title="a>b" class=\'x\'>t</p><p class="unclosed>u</p></article>').startswith("t")
    assert text("<article></div></p>q</article>") == "q"
    assert text("<main><p>m</p></main><p>out</p>") == "m"
    assert text(None) == text("") == text("   ") == text("<nav>only</nav>") == ""


def test_page_without_article():
    page = '<body><div class="top"><a href="/">Home</a> <a href="/b">Blog</a></div><div class="body"><h2>Head</h2><p>' + "long text " * 30 + "</p><p>more words here</p></div><div><a>x</a></div></body>"
    assert text(page) == "Head\n\n" + " ".join(["long text"] * 30) + "\n\nmore words here"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<article>", "</article>", "<div class='ad'>", "</div>", "<table>", "<td>", "<li>", "<script>", "</script>", "<!--", "-->", "x", " y ", "&amp;", "<", ">", "'", '"', "<a href=\"", "<br/>", "\x00"]), max_size=40))
def test_any_markup(parts):
    out = text("".join(parts))
    assert "  " not in out and out == out.strip()


def long_page(k):
    return f"<html><body><div class='bar'><p>About us and more</p><p>Contact</p></div><div class='c'><h2>Title {k}</h2><p>{'story ' * 20}{k}</p></div><div class='z'><p>All rights reserved</p></div></body></html>"


def test_templates(spark, tmp_path):
    rows = [(k, f"http://one.example/{k}", long_page(k), "clash") for k in range(40)]
    rows += [(100 + k, f"https://two.example/{k}", f"<html><body><article><h1>t{k}</h1><p>Share this page</p><p>own {k}</p>{'<p>common passage</p>' if k % 2 else ''}</article></body></html>", "c") for k in range(20)]
    rows += [(200, None, "<article>n</article>", "c"), (201, "odd", None, "c"), (202, "http://one.example/x", "", "c"), (None, "", "<article>e</article>", "c"), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(3)
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = H.op8_html_extraction(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    for k in range(40):
        assert by[k]["text"] == f"Title {k}\n\n" + "story " * 20 + str(k)
    for k in range(20):
        assert by[100 + k]["text"] == f"t{k}\n\nown {k}" + ("\n\ncommon passage" if k % 2 else "")
    assert [by[k]["text"] for k in (200, 201, 202, None)] == ["n", "", "", "e"]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    found = {r["host"]: r["template"] for r in H.templates(pages).collect()}
    assert set(found) == {"one.example", "two.example"}
    two = found["two.example"]
    assert any(t["is_text"] and t["everywhere"] for t in two) and all(t["parent"] < len(two) for t in two)
    assert Counter(t["class"] for t in two).most_common(1)[0][1] >= H.LEAST


def test_join_without_broadcast(spark, monkeypatch):
    rows = [(k, f"http://one.example/{k}", long_page(k)) for k in range(15)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = Counter(map(tuple, H.extract(pages, ["page_id"]).collect()))
    monkeypatch.setattr(H, "BROADCAST", -1)
    assert Counter(map(tuple, H.extract(pages, ["page_id"]).collect())) == want
    assert H.extract(pages.limit(0), ["page_id"]).count() == 0


def test_hosts(spark):
    urls = ["http://A.example:80/x", "https://u@b.example?q", "//c.example#f", "nothing", "", None]
    got = spark.createDataFrame([(u,) for u in urls], "u string").select("u", H._host(H.F.col("u")).alias("h")).collect()
    assert {r["u"]: r["h"] for r in got} == {u: H.host_of(u) for u in urls}
    assert H.host_of(urls[0]) == "a.example"


def test_copies_keep_their_article(spark):
    article = "<html><body><nav><a>Menu</a></nav><article><h1>Title</h1><p>One passage</p><p>Another</p></article><div class='z'>{}</div></body></html>"
    plain = "<html><body><div class='c'><h2>Plain</h2><p>" + "story " * 20 + "</p><p>" + "end of it " * 9 + "</p></div></body></html>"
    rows = [(k, "http://copies.example/1", article.format("")) for k in range(12)]
    rows += [(20 + k, None, article.format("")) for k in range(12)]
    rows += [(40 + k, f"http://visits.example/{k}", article.format(f"visit {k}")) for k in range(12)]  # copies but for a footer
    rows += [(60 + k, f"http://mixed.example/{k}", plain) for k in range(12)]
    rows += [(80 + k, f"http://mixed.example/{k}", long_page(k)) for k in range(30)]
    rows += [(120 + k, f"http://heads.example/{k}", f"<html><body><article><h1>t{k}</h1><h2>Summary</h2><p>Share this</p><p>own {k}</p></article></body></html>") for k in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r["page_id"]: r["text"] for r in H.extract(pages, ["page_id"]).collect()}
    for k in range(12):
        assert got[k] == got[20 + k] == got[40 + k] == "Title\n\nOne passage\n\nAnother"
        assert got[60 + k] == "Plain\n\n" + " ".join(["story"] * 20) + "\n\n" + " ".join(["end of it"] * 9)
        assert got[80 + k] == f"Title {k}\n\n" + "story " * 20 + str(k)
        assert got[120 + k] == f"t{k}\n\nSummary\n\nown {k}"
    assert {r["host"] for r in H.templates(pages).collect()} == {"visits.example", "mixed.example", "heads.example"}


KEPT = (
    ('<article><h2 id="related-work">Related work</h2><p>x</p></article>', "Related work\n\nx"),
    ('<article><p>a</p><section id="sharing-data"><p>We share data.</p></section></article>', "a\n\nWe share data."),
    ('<article><p class="notice-period">notice</p><menu><li>step</li></menu></article>', "notice\n\nstep"),
    ('<article><p id="comment-on-method">Body text.</p><math><mi>x</mi></math></article>', "Body text.\n\nx"),
    ("<main><p>m</p></main><main><article><p>a</p></article></main>", "m\n\na"),
    ("<main><h1>T</h1><article><p>a</p></article></main>", "T\n\na"),
    ('<body><div id="widget-guide"><p>whole text</p><p><a href="/x">one link</a></p></div></body>', "whole text\n\none link"),
    ('<body><form><nav>n</nav><article><p>framed</p></article></form></body>', "framed"),
)


def test_names_take_no_text_away():
    for source, want in KEPT:
        assert text(source) == want


def real_classes(sources):
    """Classes of tokens by their real occurrence vectors over distinct pages."""
    pages = [H.tokens_of(H.parse(x)) for x in sorted(set(sources))]
    vectors = {}
    for k, page in enumerate(pages):
        for token, row in page.items():
            if token:
                vectors.setdefault(token, [0] * len(pages))[k] = row[2]
    classes = {}
    for token, v in vectors.items():
        classes.setdefault(tuple(v), set()).add(token)
    return {frozenset(c) for v, c in classes.items() if len(c) >= H.LEAST and sum(map(bool, v)) >= max(H.SUPPORT, H.SHARE * len(pages))}, pages


def test_classes_are_those_of_real_vectors(spark):
    rows = [(r["url"], r["html"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    rows += [(f"http://one.example/{k}", long_page(k)) for k in range(30)] * 2
    widget = "<aside><div class='w'><h3>Most read</h3><p>One</p><p>Two</p></div></aside>"
    passage = "<p>A passage.</p><p>That many quote.</p><p>In three parts.</p>"
    rows += [(f"http://odd.example/{k}", f"<body><nav><a>n</a></nav>{widget if k % 3 else ''}<div class='x'><h1>h{k}</h1>{passage if k % 2 else ''}{'<p>p%d</p>' % k * (k % 4 + 1)}</div></body>") for k in range(40)]
    got = {r["host"]: r["template"] for r in H.templates(spark.createDataFrame(rows, "url string, html string").repartition(4)).collect()}
    hosts = {}
    for url, source in rows:
        hosts.setdefault(H.host_of(url), []).append(source)
    some = 0
    for host, sources in hosts.items():
        want, _ = real_classes(sources)
        mine = {}
        for t in got.get(host, []):
            mine.setdefault(t["class"], set()).add(t["token"])
        mine = {frozenset(c) for c in mine.values()}
        assert mine <= want
        some += len(mine)
        for missing in want - mine:  # only what doesn't nest: its tokens lie in several places
            paths = {row[0] for page in real_classes(sources)[1] for token, row in page.items() if token in missing}
            assert len(paths) > 1
    assert some > 5
    odd = got["odd.example"]
    e = H.parse(next(x for u, x in rows if "Most read" in x)).elements
    around = {x.path: e[x.above].label for x in e[1:]}
    assert {t["label"] for t in odd if t["fixed"]} == {"nav", "h3", "p"} and all(t["label"] == "nav" or around[t["path"]] == "div.w" for t in odd if t["fixed"])
    assert any(t["is_text"] and not t["fixed"] for t in odd)  # the passage has a class, but no element of its own


def test_template_tells_the_slot_where_markup_is_silent(spark):
    """Pages without telling elements: a short article beside a longer advert."""
    def page(k):
        body = f"<h1>t{k}</h1><p>short {k}</p>" if k % 5 == 0 else f"<h1>t{k}</h1>" + f"<p>long text {k} goes on and on</p>" * (k % 4 + 3) * 4
        return f"<html><body><div class='a'><a href='/'>home</a> <a href='/{k}'>n{k}</a></div><div class='b'>An advert, number {k}, of some length to read</div><div class='c'>{body}<p>Printed with our press</p></div><div class='d'>bye {k}</div></body></html>", body
    made = {k: page(k) for k in range(40)}
    pages = spark.createDataFrame([(k, "http://plain.example/", x) for k, (x, _) in made.items()], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in H.extract(pages, ["page_id"]).collect()}
    want = {k: text(f"<article>{body}</article>") for k, (_, body) in made.items()}
    assert got == want
    alone = {k: text(x) for k, (x, _) in made.items()}
    assert sum(alone[k] != want[k] for k in made) == 40  # without a template, no page is read rightly


def test_quoted_passages_stay_and_notices_go(spark):
    notice = "<div class='n'><p>Read our terms</p><p>They changed</p></div>"
    passage = "<p>A passage.</p><p>That many quote.</p><p>In three parts.</p>"
    rows = [(k, "http://q.example/", f"<body><article><h1>t{k}</h1>{notice if k % 2 else ''}{passage if k % 3 else ''}<p>own {k}</p>{'<p>more</p>' * (k % 4)}</article></body>") for k in range(48)]
    got = {r["page_id"]: r["text"] for r in H.extract(spark.createDataFrame(rows, "page_id long, url string, html string"), ["page_id"]).collect()}
    for k in range(48):
        assert got[k].split("\n\n") == [f"t{k}", *(["A passage.", "That many quote.", "In three parts."] if k % 3 else []), f"own {k}", *["more"] * (k % 4)]


def test_very_long_page_and_clashing_columns(spark, tmp_path):
    long = "<article>" + "<p>word &amp; word</p>" * 60_000 + "</article>"
    rows = [(1, "http://l.example/1", long, "c", "d"), (1, "http://l.example/1", long, "c", "d"), (None, None, None, None, None)]
    spark.createDataFrame(rows, "page_id long, url string, html string, template string, __host string").write.parquet(f"{tmp_path}/pages.parquet")
    got = H.op8_html_extraction(spark, str(tmp_path)).collect()
    assert Counter(r["n_chars"] for r in got) == {60_000 * len('word & word') + 59_999 * 2: 2, 0: 1}


@pytest.mark.parametrize("source", ["<div>" * 200_000 + "deep", "<ul><li>x" * 100_000, "<b></i>" * 150_000 + "deep", "<p><table>" + "<div>x" * 150_000, "<article>" + "<header>x" * 120_000, "</p>" * 250_000 + "<p>deep"])
def test_deep_pages_are_linear(source):
    t = time.process_time()
    page = H.parse(source)
    H.tokens_of(page)
    assert H.main_text(page) or "<header>" in source
    assert time.process_time() - t < 30  # a second or two; by the square it would be hours


def test_paths_take_no_room():
    tracemalloc.start()
    page = H.parse("<div>" * 20_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(page.elements) == 20_001 and peak < 20e6  # their strings would be 800 MB


def test_deep_template():
    """A template nested as deep as it is long, by what deduces it, against the definition on paths."""
    def page(k):
        return "<div>" * 30 + f"<p>own {k}</p>" + "<i>s</i>" + "<ul>" * 20 + "<li>foot</li>"
    rows, seen = [], {}
    for k in range(12):
        for token, row in H.tokens_of(H.parse(page(k))).items():
            seen.setdefault(token, []).append(row)
    for token, got in seen.items():
        if token and len(got) >= 10:
            path, is_text, n, place, free, above, label = got[0]
            rows.append({"token": token, "path": path, "is_text": is_text, "place": place, "pages": len(got), "h1": 1, "h2": n, "times": sum(x[2] for x in got), "free": sum(x[4] for x in got), "everywhere": True, "above": above, "label": label, "large": True})
    out = H.nested(rows)
    assert len(out) == len(rows) and {t["label"] for t in out if t["fixed"]} == {"div", "li"} and {t["parent"] for t in out} == {-1}
    tops = [t for t in out if t["above"] == 0]
    assert len(tops) == 1 and tops[0]["mass"] == sum(len(f"own {k}") for k in range(12)) / 12 and tops[0]["stable"] == len("s" + "foot")
