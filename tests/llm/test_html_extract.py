import itertools
import random
import time

from corpusloom.llm import html_extract as H


def test_cut_is_cheapest():
    rng = random.Random(4)
    for _ in range(400):
        n = rng.randint(1, 9)
        unary = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(i, j, rng.randint(1, 6)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.4]

        def cost(labels):
            return sum(abs(u) for u, x in zip(unary, labels) if x != (u > 0) and u) + sum(c for i, j, c in edges if labels[i] != labels[j])

        got = H.max_flow_labels(unary, edges)
        assert cost(got) == min(cost(x) for x in itertools.product([False, True], repeat=n))


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a="</p><p>";</script></head>
<body class="has-sidebar"><header class="site-header"><p>The daily paper of the small town since 1901.</p></header>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">About us</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this site better for all of our readers. Accept them now.</p></div>
<div id="wrap"><article><header><h1>A   head &lt;line&gt;</h1></header><p>First <b>bold</b> sentence of&nbsp;the text.<br>More of it<p>Second one, &eacute;t&#233;.
<div class="ad"><p>Buy these fine shoes today, they are cheaper than ever before in this shop.</p></div>
<p>Er.</p><ul><li>One item<li>Another item</ul><!-- <p>no</p> --><table><tr><td>a cell</table>
<section class="comments"><article class="comment"><p>I think that this is a really great article, thanks for it.</p></article></section>
</article><aside><p>Read also the other articles on this topic, which are just as long as this one.</p></aside>
<form><label>Your mail</label><input><button>Send it</button></form></div>
<footer>&copy; 2024 The paper</footer></body></html>"""


def test_page():
    assert H.main_text(PAGE).split("\n") == [
        "A head <line>", "First bold sentence of the text. More of it", "Second one, été.", "Er.", "One item", "Another item", "a cell",
    ]


def test_page_without_article():
    text = "This is a long paragraph of running text that talks about the matter at hand, and then some more of it."
    page = f"<body><div class=menu><a href=/>Home</a> <a href=/x>More</a></div><div><p>{text}</p><p>{text}</p></div><div>Copyright 2020 X</div>"
    assert H.main_text(page) == f"{text}\n{text}"


def test_odd_pages():
    for page in ("", None, "<", "<p", "a < b <3", "<p>x</p", "<!--", "<script>", "</", "<a b='c", "&", "<article>&amp</article>", "<>", "<!>", "<!-->x"):
        H.main_text(page)
    assert H.main_text("<article><p>2 < 3 & 4 &amp 5</p><p>cut <a hre") == "2 < 3 & 4 & 5\ncut"
    began = time.time()
    H.main_text("<a " + 'x="y" ' * 50_000)
    H.main_text("<article>" + "<div><p>word word word. " * 5_000)
    H.main_text("<p>" + "<b>" * 3_000 + "x")
    assert time.time() - began < 20


def test_frames(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (2, "u", PAGE, "x"), (2, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = sorted((r.page_id, r.text[:6], r.n_chars) for r in H.extract(df).collect())
    n = len(H.main_text(PAGE))
    assert got == [(1, "", 0), (2, "A head", n), (2, "A head", n)]
    assert H.extract(df.limit(0)).count() == 0


def labelled(page):
    blocks, weights, leads = H.blocks_of(page)
    belief = H.belief_of(blocks, weights, leads)
    own = [round(H.UNIT * H.score(b, weights, belief)) for b in blocks]
    return {b.text: (x > 0, y) for b, x, y in zip(blocks, own, H.max_flow_labels(own, H.edges_of(blocks)), strict=True)}


LONG = "This is a long paragraph of running text that talks about the matter at hand, and then some more of it."


def test_neighbours_outvote_a_short_block():
    page = f"<body><div class=menu><a href=/>Home</a></div><div><h1>Title</h1><p>{LONG}</p><ul><li>One item<li>Two</ul><p>{LONG}!</p></div><div>Impressum</div></body>"
    got = labelled(page)
    assert got["One item"] == got["Two"] == (False, True) and got["Home"] == (False, False)
    assert H.main_text(page).split("\n")[:5] == ["Title", LONG, "One item", "Two", f"{LONG}!"]


def test_a_wrapper_named_like_boilerplate_keeps_its_article():
    for name in ("post-comments-enabled", "sidebar-right", "elementor-widget-container", "newsletter-page"):
        inner = f"<article><h1>T</h1><p>{LONG}</p><div class=ad><p>Buy these fine shoes, they are cheaper today.</p></div><p>{LONG}!</p></article>"
        page = f'<body><nav><a href="/">Home</a></nav><div class="{name}">{inner}</div><footer>The paper</footer></body>'
        assert H.main_text(page).split("\n") == ["T", LONG, f"{LONG}!"], name
    comments = "".join(f'<article class="comment"><h3>Re: T</h3><p>{LONG} I think so too.</p></article>' for _ in range(9))
    page = f'<body><article><h1>T</h1><p>{LONG}</p></article><section class="comments">{comments}</section></body>'
    assert H.main_text(page).split("\n") == ["T", LONG]
    assert H.main_text(f'<body><div hidden><h1>T</h1><p>{LONG}</p></div></body>') == ""
