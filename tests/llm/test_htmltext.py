import html
import re

import pytest

from ranklens.llm import htmltext as H

SCHEMA = "page_id long, url string, html string"


def test_pages_against_a_plain_reading(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in H.main_texts(df).collect()}
    pages = df.collect()
    assert len(got) == len(pages)
    for p in pages:
        article = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?h1>|</?p>", article)]
        want = "\n".join(b for b in blocks if b)
        assert (got[p.page_id].text, got[p.page_id].n_chars, got[p.page_id].url) == (want, len(want), p.url)


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b<br>c <b>d</b>e", "a\nbc de"),
    ("<main>x &amp; y&nbsp; z<script>if (a</b>c) '</p>'</script><style>p{}</style> w</main>", "x & y z w"),
    ("<body><nav>menu</nav><div class='site-header'>top</div><article><header><h1>T</h1></header><p>one</p><div id=comments><p>bad</p></div><aside>no</aside><p>two", "T\none\ntwo"),
    ("<article><ul><li>1<li>2</ul><table><tr><td>a<td>b</table></article><footer>f</footer>", "1\n2\na\nb"),
    ("<article>a<!-- hidden <p>x</p> -->b<form>f<input></form><div class='ad'>buy</div></article>", "ab"),
    ("<article>5 < 6 & 7 > 2</article>", "5 < 6 & 7 > 2"), ("<article><p title='a>b'>ok</p></article>", "ok"), ("<article>cut <b", "cut <b"),
    ("<div>" * 3000 + "deep", "deep"), ("<article>" + "x" * 200_000 + "</article>", "x" * 200_000), ("</p></div>plain", "plain"),
])
def test_one_page(page, text):
    assert H.main_text(page, {}) == text


def test_classes_and_slots_of_a_host(spark):
    body = "<html><body><div class=top>Same words on all pages</div><div class=links><a href=/>a b c</a> x</div><div class=text><p>{}</p>{}</div></body></html>"
    rows = [(i, "http://h.example/%d" % i, body.format(f"story {i}", "<p><i>rare</i>" if i == 3 else "")) for i in range(8)]
    rows += [(20, None, "<p>no host"), (None, "http://other.example/", None), (21, "http://h.example/z", rows[0][2]), (21, "http://h.example/z", rows[0][2])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'t' AS template", "'u' AS host", "1 AS row")
    template = {r.host: H._read(r.template) for r in H.templates(df).collect()}["h.example"]
    assert template["#page/html/body/div.top"] == "side" and template["#page/html/body/div.text/p"] == "open"
    assert template["#page/html/body/div.links/a"] == "side" and "#page/html/body/div.text/p/i" not in template
    got = sorted(((r.page_id, r.text, r.n_chars) for r in H.main_texts(df).collect()), key=str)
    assert (3, "story 3\nrare", 12) in got and (20, "no host", 7) in got and (None, "", 0) in got
    assert [t for p, t, _ in got if p == 21] == ["story 0"] * 2
    assert H.main_texts(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("page,text", [
    ("<html class='has-sidebar'><body class='no-sidebar modal'><main class='has-sidebar widget'><article class='post comments-open share'>text</article></main>", "text"),
    ("<article><div class='post-header'><h1>T</h1></div><div class='article-header'>by A</div><div class=header><h2>U</h2></div><p>x", "T\nby A\nU\nx"),
    ("<body><form id=all><nav>menu</nav><article>one<form>in</form></article><div class=sidebar><article>tip</article></div></form>", "one"),
    ("<body><form id=all><div class=menu>menu</div><p>one<p>two</form>", "one\ntwo"), ("<p>much more text than the form has</p><form>search</form>", "much more text than the form has"),
    ("<div class=widget><nav>menu</nav><div id=main>text</div></div>", "text"), ("<nav class=main>menu</nav><p>text", "text"),
    ("<article>so <math><mi>x</mi><mo>+</mo><mn>1</mn></math> holds</article>", "so x+1 holds"),
    ("<main>a<div class='related'><article>tip</article></div></main>", "a"),
    ("<div class='site-footer'>f</div><div class='cookie-banner'>c</div><div class='adaptive menu-of-the-day'>soup</div>", "soup"),
])
def test_names_never_take_the_article(page, text):
    assert H.main_text(page, {}) == text


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6])
def test_unchanging_text_of_small_and_broken_hosts(spark, n):
    page = "<html><body><div class=x>Same on all</div><div class=y><p>story {0} is told here</p><p>Read on</p><p>{0} more <a href=/>and {0} linked words of it</a></div></body></html>"
    rows = [(i, "http://few.example/", page.format(i)) for i in range(n)] + [(50, "http://few.example/", None), (51, "http://few.example/", "")]
    rows += [(60 + i, "http://copies.example/", page.format("one")) for i in range(7)]
    rows += [(70 + i, "http://cut.example/", page.format(i)) for i in range(6)] + [(80, "http://cut.example/", page[:40])]
    got = {r.page_id: r.text for r in H.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    kept = "story {0} is told here\n{0} more and {0} linked words of it"
    whole = "Same on all\nstory {0} is told here\nRead on\n{0} more and {0} linked words of it"
    assert [got[i] for i in range(n)] == [(whole if n == 1 else kept).format(i) for i in range(n)]
    assert got[50] == got[51] == "" and {got[60 + i] for i in range(7)} == {whole.format("one")}
    assert [got[70 + i] for i in range(6)] == [kept.format(i) for i in range(6)] and got[80]


def test_versions_of_one_text_keep_it():
    template = {H.text_token("#page/p", t): "side" for t in ("a long paragraph", "and another one")}
    assert H.main_text("<p>a long paragraph<p>new<p>and another one", template) == "a long paragraph\nnew\nand another one"
    assert H.main_text("<p>a long paragraph", template) == "a long paragraph"


@pytest.mark.parametrize("n", [1, 2, 4, 5, 8])
def test_an_article_by_name_keeps_all_its_text(spark, n):
    page = "<body><div class=x>Same on all</div><article><h1>T{0}</h1><div class=q>All prices are in euro</div><p>story {0} is told at some length</p><p>Read on</p></article><p>tail {0}</p></body>"
    rows = [(i, "http://h.example/", page.format(i)) for i in range(n)]
    rows += [(30 + i, "http://versions.example/", page.format("one") + "<!-- %d -->" % i) for i in range(n)]
    got = {r.page_id: r.text for r in H.main_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = "T{0}\nAll prices are in euro\nstory {0} is told at some length\nRead on"
    assert all(got[i] == want.format(i) and got[30 + i] == want.format("one") for i in range(n))


NEUTRAL = (
    "<html><body><div class=xa><a href=/>home</a> <a href=/b>about us</a></div><div class=xb>{ad}</div>"
    "<div class=xc><div class=xd><div class=xe>Title {n}</div><div class=xf><p>First of {n}: {words}</p><p>then <i>more</i> of {n}</p>{extra}</div></div>"
    "<div class=xg>Of interest: <a href=/1>story {n} elsewhere</a></div></div><div class=xh>imprint and terms</div></body></html>"
)


def _neutral(k):
    return NEUTRAL.format(ad=f"buy {k}", n=k, words=f"w{k} " * 30, extra=f"<ul><li>one {k}<li>two {k}</ul>" if k % 2 else "")


@pytest.mark.parametrize("n", [2, 3, 4, 9])
def test_neutral_names_without_an_article(spark, n):
    """The deduction alone finds the article; menus, adverts, links and the imprint have no telling names."""
    rows = [(k, "http://n.example/", _neutral(k)) for k in range(n)] + [(90, "http://n.example/", None), (91, "http://n.example/", _neutral(3)[:70])]
    df = spark.createDataFrame(rows, SCHEMA)
    template = {r.host: H._read(r.template) for r in H.templates(df).collect()}["n.example"]
    assert H.core_of(template) == ("#page/html/body/div.xc/div.xd", False)
    got = {r.page_id: r.text for r in H.main_texts(df).collect()}
    for k in range(n):
        want = [f"Title {k}", f"First of {k}: " + " ".join([f"w{k}"] * 30), f"then more of {k}"] + ([f"one {k}", f"two {k}"] if k % 2 else [])
        assert got[k] == "\n".join(want)


def test_a_core_inside_an_article_is_widened_to_it(spark):
    page = "<body><div class=n>menu words</div><article><h1>T</h1><div class=b><p>long {0} story {0}</p><p>more {0}</p></div></article></body>"
    df = spark.createDataFrame([(k, "http://w.example/", page.format(f"x{k} " * 20)) for k in range(3)], SCHEMA)
    template = {r.host: H._read(r.template) for r in H.templates(df).collect()}["w.example"]
    assert template[H.CORE].split("\t")[0].endswith("article/div.b") and H.core_of(template) == ("#page/body/article", True)
    assert all(r.text.startswith("T\nlong x") for r in H.main_texts(df).collect())


def test_most_given_pages_are_decided_by_the_deduction(spark):
    """On sf0.01 the deduced core is the article on every host with two pages or more."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    cores = {r.host: H.core_of(H._read(r.template)) for r in H.templates(df).collect()}
    hosts = [(r.host, r.n) for r in df.groupBy(H.host_of(df.url).alias("host")).agg({"*": "count"}).withColumnRenamed("count(1)", "n").collect()]
    decided = sum(n for h, n in hosts if cores.get(h, ("", False)) == ("#page/html/body/article", True))
    assert decided >= 0.9 * sum(n for _, n in hosts)
