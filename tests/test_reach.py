"""Walks over links against plain breadth-first search."""

import random

import pytest

from shelfwise.operators import reach as W


def brute(links, seeds, only=None):
    seen, front, depth = {}, {}, 0
    for url, section in seeds:
        if url is not None and (only is None or url in only):
            front[url] = min(section, front.get(url, section))
    while front:
        seen |= {u: (s, depth) for u, s in front.items()}
        ahead = {}
        for a, b in links:
            if a in front and b is not None and b not in seen and (only is None or b in only):
                ahead[b] = min(front[a], ahead.get(b, front[a]))
        front, depth = ahead, depth + 1
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_walk_equals_breadth_first_search(spark, seed):
    rng = random.Random(seed)
    links = [(f"u{rng.randrange(120)}", f"u{rng.randrange(120)}") for _ in range(110)]
    links += [(f"u{i}", "hub") for i in range(120)] + [("hub", "u7"), ("hub", "hub"), (None, "u1"), ("u1", None)] + links[:5]
    links += [(f"chain{i}", f"chain{i + 1}") for i in range(8)]
    seeds = [("u3", "b"), ("u3", "a"), ("u9", "a"), (None, "z"), ("chain0", "c"), ("not linked", "d")]
    only = {f"u{i}" for i in range(120)} | {"hub"} | {f"chain{i}" for i in range(7)}
    known = spark.createDataFrame([(u,) for u in sorted(only)], "url string")
    edges, starts = spark.createDataFrame(links, "source string, target string"), spark.createDataFrame(seeds, "url string, section string")
    got = {r.url: (r.section, r.depth) for r in W.walk(edges, starts, known).collect()}
    assert got == brute(links, seeds, only)


def page(spark, rows):
    return spark.createDataFrame(rows, "id long, url string, html string")


def test_pages_listings_and_awkward_rows(spark):
    a = lambda *hrefs: "".join(f'<a href="{h}">x</a>' for h in hrefs)
    base = "https://www.shop.example/c"
    pages = page(
        spark,
        [
            (1, base, a("?page=2", "/products/first-of-all", "#top", "https://else.example/products/far-far-away")),
            (2, base + "?page=2", a("?page=3", "/products/second-of-all", "/c")),
            (3, base + "?page=3", a("?page=2", "/products/first-of-all", "/products/third-of-all")),
            (4, "https://www.shop.example/products/first-of-all", a("/products/only-from-a-product")),
            (5, None, a("/c")), (6, base, None), (7, "no url", ""), (8, "https://www.shop.example/alone", ""), (8, "https://www.shop.example/alone", ""),
        ],
    )
    seeds = spark.createDataFrame([(base + "#top", "creams")], "url string, section string")
    got = sorted((r.id, r.depth) for r in W.page_reach(pages, seeds, "id").collect() if r.section == "creams")
    assert got == [(1, 0), (2, 1), (3, 2), (4, 1), (6, 0)]
    assert W.page_reach(pages, seeds, "id").count() == 9
    paged = {(r.id, r.depth) for r in W.page_reach(pages, seeds, "id", follow=W.F.col("is_paged")).collect() if r.section}
    assert paged == {(1, 0), (2, 1), (3, 2), (6, 0)}
    host = "https://www.shop.example/products/"
    products = {(r.url, r.section, r.depth) for r in W.listed_products(pages, seeds).collect()}
    assert products == {(host + "first-of-all", "creams", 0), (host + "second-of-all", "creams", 1), (host + "third-of-all", "creams", 2)}


def test_empty(spark):
    seeds = spark.createDataFrame([], "url string, section string")
    assert W.page_reach(page(spark, []), seeds, "id").count() == 0
    rows = W.page_reach(page(spark, [(1, "https://a.example/", "")]), seeds, "id").collect()
    assert [(r.id, r.section, r.depth) for r in rows] == [(1, None, None)]
