import html
import random
import re

from kilohour.llm import wrapper

SF = "/root/testdata/sf0.001"
PAGE = """<html><head><title>x</title></head><body><div id=cookie-banner>We use cookies</div><header><a>Home</a></header>
<div class="layout"><div class="post-body"><h2>{0}</h2><p>One <i>t</i>ext&nbsp;{0}  &lt;more&gt; words.<ul><li>a {0}<li>b</ul><div class='advert'>Buy</div>
<p>Last {0}</p></div><div class=sidebar><p>Side</p></div></div><section id="comments"><p>Nice {0}</p></section><form>Mail</form><footer>c</footer>
<script>if (x<y) "</p>"</script></body>"""


def test_alignment_finds_repeats_optionals_and_slots():
    trees = [wrapper.tree(p) for p in ("<body><h1>A</h1><p>1<p>2<p>3<footer>f</footer>", "<body><h1>B</h1><div>x</div><p>4</p><footer>f</footer>")]
    joint = wrapper.join(trees[0], trees[1])
    text = wrapper.expression(joint)
    assert "<h1 #>" in text and "<div '" in text and ">?" in text and "<p #>+" in text and "<footer '" in text
    groups = wrapper.expression(wrapper.tree("<dl>" + "".join(f"<dt>k{i}<dd>v{i}" for i in range(5)) + "</dl>"))
    assert groups == "<dl (<dt #> <dd #>)+>"
    one = wrapper.tree("<dl><dt>k<dd>v</dl>")
    assert wrapper.expression(wrapper.join(wrapper.tree("<dl><dt>a<dd>b<dt>c<dd>d</dl>"), one)) == "<dl (<dt #> <dd #>)+>"


def test_pages_without_article_and_odd_inputs(spark):
    rows = [(i, "http://site.example/%d" % i, PAGE.format(f"w{i}")) for i in range(4)]
    rows += [(10, None, None), (11, "", ""), (12, "http://site.example/x", "plain < text &amp; more"), (3, "http://site.example/3", PAGE.format("w3"))]
    rows += [(13, "http://deep.example/", "<div>" * 20_000 + "deep" + "</div>" * 20_000), (14, "http://long.example/", "<article>" + "<p>a b</p>" * 50_000 + "<article class=comment>no</article>")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, host string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in wrapper.extract_pages(df).collect())
    assert len(got) == len(rows)
    text = {i: t for i, t, _ in got}
    for i in range(4):
        assert text[i] == f"w{i}\nOne text w{i} <more> words.\na w{i}\nb\nLast w{i}"
    assert text[10] == text[11] == "" and text[12] == "plain < text & more" and text[13] == "deep" and text[14] == "\n".join(["a b"] * 50_000)
    assert all(n == len(t) for _, t, n in got)
    assert wrapper.extract_pages(df.limit(0)).count() == 0


def test_table_pages_against_a_plain_reading(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in wrapper.extract_pages(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.DOTALL)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<b>|<br>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", body))
        assert got[r["page_id"]] == "\n".join(b for b in blocks if b)


def read(pages):
    joint = None
    for p in pages:
        joint = wrapper.join(joint, wrapper.tree(p))
    slots = wrapper.content_slots(joint, len(pages))
    return [wrapper.page_text(p, slots) for p in pages]


def test_words_and_forms_around_an_article_do_not_hide_it():
    for before, after in (("<div class='content-sidebar-wrap'>", "</div>"), ("<div class='has-sidebar'>", "</div>"), ("<div id='menu-page'>", "</div>"), ("<form>", "</form>")):
        for name in ("article", "main", "div role=main"):
            page = f"<body>{before}<nav>Home</nav><{name}><p>Text {{0}}</p><div class=share-bar>Share</div></{name.split()[0]}><aside>Side</aside>{after}<footer>f</footer></body>"
            assert read([page.format(i) for i in range(3)]) == [f"Text {i}" for i in range(3)]
    beside = "<main><p>Text {0} is long enough</p></main><div class='related-posts'><article>Other {0}</article></div><div class='sidebar-left'><article>Teaser {0}</article></div>"
    assert read([beside.format(i) for i in range(3)]) == [f"Text {i} is long enough" for i in range(3)]


def test_each_page_is_read_by_the_regions_of_its_own_layout():
    pages = ["<nav>n</nav><article><p>One {0}</p></article>", "<nav>n</nav><div class='post news'><p>Two {0} and more</p></div><div class=content>box</div>"]
    pages += ["<nav>n</nav><div class='post sport'><p>Three {0} and more</p></div>", "<form><div class='entry'><p>Four {0}</p></div></form>", "<article class=comment>no</article><div><p>Five {0}</p></div>"]
    got = read([p.format(i) for i in range(3) for p in pages])
    assert got == [t.format(i) for i in range(3) for t in ("One {0}", "Two {0} and more", "Three {0} and more", "Four {0}", "Five {0}")]
    assert read(["<article></article><div>Side</div>", "<article>x</article>"]) == ["", "x"]


def test_nesting_has_no_limit(spark):
    deep = "<body><div class=wrap><article>" + "<div>" * 100 + "Deep {0}" + "</div>" * 100 + "<p>Rest {0}</p></article><div>Side</div></div></body>"
    below = "<body>" + "<section>" * 100 + "<nav>Home</nav><article><p>Low {0}</p><form>Mail</form></article><p>Side" + "</section>" * 100
    assert read([deep.format(i) for i in range(3)]) == [f"Deep {i}\nRest {i}" for i in range(3)]
    assert read([below.format(i) for i in range(3)]) == [f"Low {i}" for i in range(3)]
    rows = [(i, "http://deep.example/", "<ul><li>" * 20_000 + f"text {i}" + "</ul>" * 20_000 + "<p>end") for i in range(3)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text {i}" for i in range(3)}
    joint = wrapper.join(wrapper.tree("<dl><dt>a<dd>b<dt>c<dd>d</dl><p>x"), wrapper.tree("<h1>A</h1><dl><dt>k<dd>v</dl>"))
    assert wrapper.loaded(wrapper.dumped(joint)) == joint


def test_long_alignments_are_longest():
    pick = random.Random(5)
    for letters in ("ab", "abcdefgh"):
        a, b = ([pick.choice(letters) for _ in range(n)] for n in (1100, 1300))
        pairs = wrapper._common(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
        assert len(pairs) == row[-1]
    assert wrapper._common(["x"], ["y"] * 1_100_000 + ["x"]) == [(0, 1_100_000)]


NOTICE = "<div class=x7><h4>Daily digest</h4><p>Have our letter sent to you.</p></div>"
PLANTED = "<body><div class=q1><p>House rules for all who come by, long enough to outweigh a story.</p></div><article><h1>Title {0}</h1><p>Story {0} has so many words of its own that they outweigh.</p>{1}<h2>Sources</h2><ul><li>one {0}<li>all</ul><p>{2}</p><p>All rights with us.</p></article></body>"


def joined(pages, align=wrapper.aligned):
    joint = None
    for p in pages:
        page = wrapper.tree(p, False)
        joint = page if joint is None else ["", align(joint[1], page[1]), None, joint[3] + page[3]]
    slots = wrapper.content_slots(wrapper.loaded(wrapper.dumped(joint)), len(pages))
    return [wrapper.page_text(p, slots) for p in pages]


def test_constants_inside_an_article_are_template_and_only_alignment_tells():
    pages = [PLANTED.format(f"n{i}", NOTICE, " ".join(["end", str(i)] * (i + 1))) for i in range(5)]
    want = [f"Title n{i}\nStory n{i} has so many words of its own that they outweigh.\nSources\none n{i}\nall\n" + " ".join(["end", str(i)] * (i + 1)) for i in range(5)]
    assert joined(pages) == want
    # pages beside each other instead of aligned have no constants, and other hosts have others
    assert all("Daily digest" in t and "All rights" in t for t in joined(pages, lambda a, b: [*a, *b]))
    others = [PLANTED.format(f"m{i}", "", f"rest {i}") .replace("All rights with us", f"Rights {i}") for i in range(5)]
    mixed = joined([pages[0], *others[1:]])
    assert "Daily digest" in mixed[0] and "All rights" in mixed[0]
    # any order and any grouping of the pages gives the same constants
    assert joined(pages[::-1]) == want[::-1]
    halves = [wrapper.join(wrapper.tree(a, False), wrapper.tree(b, False)) for a, b in (pages[:2], pages[2:4])]
    joint = wrapper.join(wrapper.join(*halves), wrapper.tree(pages[4], False))
    slots = wrapper.content_slots(wrapper.loaded(wrapper.dumped(joint)), 5)
    assert [wrapper.page_text(p, slots) for p in pages] == want


def test_copies_and_two_pages_lose_nothing():
    page = PLANTED.format("n", NOTICE, "same")
    whole = "Title n\nStory n has so many words of its own that they outweigh.\nDaily digest\nHave our letter sent to you.\nSources\none n\nall\nsame\nAll rights with us."
    assert joined([page] * 6) == [whole] * 6
    near = [page.replace("same", f"same {i}") for i in range(6)]
    assert joined(near) == [whole.replace("same", f"same {i}") for i in range(6)]
    assert all("Daily digest" in t for t in joined([PLANTED.format(i, NOTICE, i) for i in range(2)]))


def test_without_a_region_the_text_that_varies_is_read():
    page = "<body><div class=a1><p>{1}</p></div><div class=b2><p>Short story {0}</p><p>of two parts {0}</p><p>Same on all.</p></div></body>"
    rules = "A very long text that is the same on all pages of the site and says nothing of the story. " * 3
    got = joined([page.format(f"w{i}", rules) for i in range(4)])
    assert got == [f"Short story w{i}\nof two parts w{i}" for i in range(4)]


def test_sections_of_an_article_and_formulas_stay():
    page = "<article><p>Text {0}</p><section class=discussion><h2>Discussion</h2><p>We find {0}</p></section><ul class=popular><li>a {0}</ul><p>So <math><mi>x</mi><mo>=</mo><mn>{0}</mn></math> holds.</p><div class=comments>Nice {0}</div></article>"
    assert joined([page.format(i) for i in range(3)]) == [f"Text {i}\nDiscussion\nWe find {i}\na {i}\nSo x={i} holds." for i in range(3)]


def test_extraction_on_spark_drops_constants(spark):
    pages = [(i, "http://planted.example/%d" % i, PLANTED.format(f"n{i}", NOTICE, f"rest of page {i}")) for i in range(40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(7)
    got = {r["page_id"]: r["text"] for r in wrapper.extract_pages(df).collect()}
    assert got == {i: f"Title n{i}\nStory n{i} has so many words of its own that they outweigh.\nSources\none n{i}\nall\nrest of page {i}" for i in range(40)}
