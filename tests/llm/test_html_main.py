import random

from brightwell.llm.html_main import blocks_of, extract, main_text, minimum_cut

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1><a href=/>Home</a></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies to improve this long and winding site experience, please accept them.</p></div>
<div class=ad>Buy this very good thing today, it is the best thing that you can buy anywhere.</div>
<article><h1>Title</h1><p><b>First &amp; long paragraph &nbsp;of the story that goes on<br>and on.<p>Sh.</p>
<ul><li>One<li>Two</ul></article>
<div class="sidebar"><p>Lots of related text here which is long enough to look like some content, yes it is.</p></div>
<section id=comments><p>Nice article! I read it all day long and found it very useful to me.</p></section>
<form><label>Name</label><input><textarea>x</textarea></form><footer>&copy; all</footer></body></html>"""


def test_article_without_its_surroundings():
    assert main_text(PAGE) == "Title\nFirst & long paragraph of the story that goes on and on.\nSh.\nOne\nTwo"


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<p></p>") == main_text("<script>x") == ""
    assert main_text("<p>A bare page of one sentence.</p>") == "A bare page of one sentence."
    assert main_text("<p>cut off <b") == "cut off"
    assert main_text("a <!-- c -->b &lt;p&gt; &#65;") == "a b <p> A"
    assert main_text("<article><p>" + "word " * 50_000) == " ".join(["word"] * 50_000)
    deep = "<div>" * 3000 + "<p>Some text at the bottom of it.</p>"
    assert main_text(deep) == "Some text at the bottom of it."


def test_custom_elements_are_not_raw():
    for name in ("svg-icon", "title-bar", "object-card", "select-box"):
        page = f"<article><p>Text before it.</p><{name} class=a>x</{name}><p>The rest of the article goes on here.</p></article>"
        assert main_text(page).endswith("The rest of the article goes on here."), name
    assert main_text("<p>One <svg\n><text>drawn</text></svg>line of text.</p>") == "One line of text."


def test_what_html_allows_inside_an_article():
    end = "The rest of the article goes on here for a while."
    for piece in ('<svg class="i" />', "<svg/>", '<object data="a.swf" />', "<object data=x><p>Fallback.</p></object>", "<!-->", "<!--->",
                  "<!-- a --!>", "<math/>"):
        assert main_text(f"<article><p>Text before it.</p>{piece}<p>{end}</p></article>").endswith(end), piece
    assert main_text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds for all of them.</p></article>") == \
        "So x=2 holds for all of them."


def test_words_of_the_text_in_names_inside_an_article():
    text = "A paragraph of the story that is long enough to stand on its own feet."
    for piece in (f'<p class="notice-period">{text}</p>', f'<section id="legal-history"><p>{text}</p></section>',
                  f'<h2 id="widget-design">{text}</h2>', f'<li class="cookie-recipe">{text}</li>'):
        assert text in main_text(f"<article><h1>Title</h1>{piece}</article>"), piece
    for piece in (f'<div class="related-posts"><p>{text}</p></div>', f"<section id=comments><p>{text}</p></section>",
                  f'<p class="advert">{text}</p>', f'<div class="newsletter-box">{text}</div>'):
        assert text not in main_text(f"<article><h1>Title</h1><p>The story.</p>{piece}</article>"), piece


def test_names_of_the_layout_keep_the_text():
    text = "A paragraph of the story that is long enough to stand on its own feet."
    for outer in ("<body class='single-post has-sidebar'>", "<body class=\"nav-open comments-open\"><main class=search-page>",
                  "<body><article class='post has-comments'>", "<body><div class='page no-sidebar'>",
                  "<body><div id=wrap class='with-header-ad hasSidebar'>"):
        page = f"<html>{outer}<p>{text}</p><div class=sidebar><p>Other things that are related to it.</p></div></html>"
        assert main_text(page) == text, outer
    assert main_text(f"<body><article class=post><p>{text}</p></article><div class='post-sidebar'><p>{text}</p></div>") == text


def test_blocks_keep_page_order():
    blocks, _ = blocks_of("<div>a<p>b</p>c<table><tr><td>d<td>e</table></div>f")
    assert [b.text for b in blocks] == ["a", "b", "c", "d", "e", "f"]


def test_cut_is_the_cheapest_labelling():
    random.seed(11)
    for _ in range(2000):
        n = random.randint(1, 8)
        prefer = [random.randint(-6, 6) for _ in range(n)]
        edges = [(random.randrange(n), random.randrange(n), random.randint(0, 4)) for _ in range(random.randint(0, 14))]

        def cost(label):
            return sum(abs(p) for p, x in zip(prefer, label) if p and (p > 0) != x) + sum(
                c for a, b, c in edges if label[a] != label[b])

        best = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(minimum_cut(prefer, edges)) == best


def test_smoothness_saves_a_weak_block_and_drops_a_stray_one():
    assert minimum_cut([5, -1, 5], [(0, 1, 2), (1, 2, 2)]) == [True, True, True]
    assert minimum_cut([-5, 1, -5], [(0, 1, 2), (1, 2, 2)]) == [False, False, False]


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (None, "v", "", None), (1, "u", PAGE, "t")],
                               "page_id long, url string, html string, text string")
    rows = sorted(extract(df).collect(), key=repr)
    assert [(r.page_id, r.url, r.n_chars) for r in rows if r.text] == [(1, "u", len(main_text(PAGE)))] * 2
    assert sorted((r.page_id or 0, r.text) for r in rows if not r.text) == [(0, ""), (2, "")]
    assert extract(df.limit(0)).count() == 0
