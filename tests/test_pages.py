"""Page extraction on inline pages."""

from pyspark.sql import functions as F

from shelfwise.functions import html as H
from shelfwise.functions import urls as U
from shelfwise.operators import pages as P


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x"))).first()[0]


def test_meta_ends_at_its_own_quote(spark):
    page = """<meta property="og:title" content="It's &amp;lt; new"><meta name='description' content='say "hi"'>"""
    assert one(spark, page, lambda c: H.decode_entities(H.meta(c, *H.META_TITLE))) == "It's &lt; new"
    assert one(spark, page, lambda c: H.meta(c, *H.META_DESCRIPTION)) == 'say "hi"'
    assert one(spark, page, lambda c: H.meta(c, *H.META_IMAGE)) is None


def test_entities(spark):
    assert one(spark, "&#8364; &#x3b1;&quot;&nbsp;&amp;quot; &#x;", H.decode_entities) == '€ α" &quot; &#x;'


def test_text_keeps_paragraphs(spark):
    page = "<style>p{}</style><p>One  <b>two</b></p><script>x('</p>')</script><ul><li>a</li><li>b</li></ul>x<br/>y"
    assert one(spark, page, H.to_text) == "One two\n\na\nb\nx\ny"


def ld(spark, body):
    page = f'<script type="application/ld+json">{body}</script>'
    df = spark.createDataFrame([(page,)], "html string")
    return H.with_jsonld(df, "html").first().ld


def test_jsonld_shapes(spark):
    assert ld(spark, '{"@type":"Product","name":"n","image":"i","mpn":"m","gtin":"g"}')[:] == ("n", None, "i", "m", "g")
    assert ld(spark, '[{"@type":"Thing"},{"@type":["X","Product"],"image":["a","b"]}]').image == "a"
    assert ld(spark, '{"@graph":[{"@type":"Product","image":{"url":"u"}}]}').image == "u"
    assert ld(spark, '{"@type":"Product","image":[{"url":"u"}]}').image == "u"
    assert ld(spark, '{"@type":"ProductGroup"}') is None
    assert ld(spark, "{broken") is None


def test_sku_candidates(spark):
    page = '"sku": "AB1" <i class="sku">AB1</i> <b>SKU: <i>X-9</i> Κωδικός: 12345 Product code: ab'
    assert one(spark, page, H.sku_candidates) == ["AB1", "X-9", "12345"]


def test_longest_block_and_subtitle(spark):
    a, b = "word " * 30, "text " * 40
    page = f'<div class="strong-desc">{a}</div><section class="product-description">{b}</section>'
    df = spark.createDataFrame([(page,), ("<p>x</p>",)], "html string")
    assert [r.block for r in H.with_longest_block(df, "html").collect()] == [b.strip(), None]
    page = '<h4 class="sub-title">short</h4><h1>T</h1><h2>A subtitle that is long enough</h2>'
    assert one(spark, page, H.subtitle) == "A subtitle that is long enough"


def test_flags(spark):
    pages = [
        ("<title>Access Denied</title>",),
        ("<p>Just a moment</p> cloudflare",),
        ("<form class='g-recaptcha'>" + "x" * 6000,),
        ("we use Cookies",),
    ]
    df = spark.createDataFrame(pages, "html string")
    got = P.page_audit(df).collect()
    assert [r.blocked for r in got] == [True, True, False, False]
    assert [r.captcha for r in got] == [False, False, True, False]
    assert [r.consent for r in got] == [False, False, False, True]


def test_urls(spark):
    assert one(spark, "https://www.Shop.gr/a", U.host) == "shop.gr"
    assert one(spark, "no url", U.host) is None
    assert one(spark, "https://x.gr/el/spray-5204559030319.html?x", U.trailing_code) == "5204559030319"
    assert one(spark, "https://x.gr/", U.section) == "diafora"
    verdict = lambda c: U.product_url_verdict(c)
    assert one(spark, "https://x.gr/products/a", verdict) == "accepted"
    assert one(spark, "https://x.gr/cart/a-very-long-product-slug", verdict) == "rejected"
    assert one(spark, "https://x.gr/a-very-long-product-slug", verdict) == "long-slug"
    assert one(spark, "https://x.gr/sitemap.xml", verdict) == "machine"


def test_resolve_links(spark):
    page = (
        '<a href="/a?page=2">1</a><a class="x" href="b.html">2</a><a href="//x.gr/c">3</a>'
        '<a href="https://other.gr/d">4</a><a href="mailto:x@y">5</a><a href="#top">6</a><a href="/a?page=2">7</a>'
    )
    df = spark.createDataFrame([(1, "https://x.gr/dir/page.html?q=1", page)], "id long, url string, html string")
    got = {(r.link, r.is_paged) for r in P.page_links(df, "id").collect()}
    assert got == {("https://x.gr/a?page=2", True), ("https://x.gr/dir/b.html", False), ("https://x.gr/c", False)}


def test_jsonld_goes_block_by_block_and_into_nested_graphs(spark):
    first = '{"@graph":[{"@type":"WebPage"},{"@type":"Product","name":"own"}]}'
    page = f'<script type="application/ld+json">{first}</script><script type="application/ld+json">{{"@type":"Product","name":"related"}}</script>'
    df = spark.createDataFrame([(page,)], "html string")
    assert H.with_jsonld(df, "html").first().ld.name == "own"
    assert ld(spark, '{"@graph":[{"@graph":[{"@graph":[{"@type":"Product","name":"deep"}]}]}]}').name == "deep"
    assert ld(spark, '[{"@graph":[{"@type":"Product","name":"inner"}]},{"@type":"Product","name":"top"}]').name == "top"


def test_long_and_astral_entities(spark):
    assert one(spark, "&#000064;&#128512;&#x1F600;&#x0000041;", H.decode_entities) == "@😀😀A"
    assert one(spark, "&#55296;&#x110000;&#99999999999;", H.decode_entities) == "&#55296;&#x110000;&#99999999999;"


def test_every_container_is_found(spark):
    text = "word " * 30
    shapes = [
        f'<div class="product-text"> <div class="text">{text}</div> </div>',
        f'<div class="product-text"><b>{text}</b></div></div>',
        f'<div class="strong-desc">{text}</div>',
        f'<div class="panel woocommerce-Tabs-panel--description">{text}</div></div>',
        f'<div id="tab-description">{text}</div><footer>',
        f'<div class="woocommerce-product-details__short-description">{text}</div>',
        f'<div itemprop="description">{text}</div> <section>',
        f'<div class="elementor-widget-text-editor">{text}</div></div>',
        f'<article><div class="entry-content">{text}</div></article>',
        f'<section class="product-description">{text}</section>',
        f"<h2>Περιγραφή</h2>{text}<h2>",
    ]
    df = spark.createDataFrame([(s,) for s in shapes], "html string")
    assert [r.block for r in H.with_longest_block(df, "html").collect()] == [text.strip()] * len(shapes)
    assert len(H.BLOCK_PATTERNS) == len(shapes)


def test_longer_description_wins_and_json_on_a_tie(spark):
    def page(block, told):
        return f'<div class="strong-desc">{block}</div><script type="application/ld+json">{{"@type":"Product","description":"{told}"}}</script>'

    a, b = "word " * 30, "text " * 30
    df = spark.createDataFrame([(page(a, b),), (page(a + "x", b),), (page("short", b),), (page("s", "t"),), ("",)], "html string")
    got = [r.description for r in H.with_best_description(df, "html").collect()]
    assert got == [b.strip(), a + "x", b.strip(), None, None]


def test_relative_links(spark):
    base = "https://h.example/list/a.html?x=1#f"
    hrefs = {
        "?page=2": "https://h.example/list/a.html?page=2",
        "../b/./c.html": "https://h.example/b/c.html",
        "./d?y=../z": "https://h.example/list/d?y=../z",
        "../../../e/..": "https://h.example/",
        "/f/../g/.": "https://h.example/g/",
        "//other.example/h": "https://other.example/h",
        "mailto:x@y": None,
        "..": "https://h.example/",
    }
    df = spark.createDataFrame([(h, base) for h in hrefs], "h string, b string")
    assert [r[0] for r in df.select(U.resolve(F.col("h"), F.col("b"))).collect()] == list(hrefs.values())


def test_graphs_of_any_depth(spark):
    for depth in (1, 12, 40):
        nested = '{"@graph":[{"@type":"WebPage","name":"no"},' * depth + '{"@type":"Product","name":"deep","image":["a","b"]}' + "]}" * depth
        found = ld(spark, nested)
        assert (found.name, found.image) == ("deep", "a")
    # a broken graph hides nothing beside it, and the word in a text is no graph
    assert ld(spark, '[{"@graph":"oops"},{"@type":"Product","name":"say \\"@graph\\""}]').name == 'say "@graph"'
