import math

import pytest
from compare import compare, connect
from conftest import SF_DIR

from shelfwise.llm import reputation as R

URLS = [
    (1, "https://WWW.Example.com/en/55?x=1", "com/en/", "block"),
    (2, "http://a.example.com/en/7?b", "example.com/en/7", "allow"),
    (3, "https://example.net/de/88#x", "example.net/de/8", "block"),
    (4, "https://x.net/de/", "net/de/", "allow"),
    (5, "ftp://org/es/", "org/es/", "block"),
    (6, "https://notcom/en/1", None, None),
    (7, "https://x.org?/es/", None, None),
    (8, None, None, None),
    (9, "no scheme/en/", None, None),
    (10, "https://x.dotcom/en/", None, None),
    (None, "a://b://com/en/", None, None),
    (11, "https://x.org/es", None, None),
    (12, "", None, None),
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "k", 1) for i, u, *_ in URLS], "page_id long, url string, host string, rule int")
    none = spark.createDataFrame([], "page_id long, bad int")
    got = {r.page_id: r for r in R.url_verdicts(pages, none).collect()}
    assert len(got) == len(URLS)
    for i, url, rule, verdict in URLS:
        assert got[i].rule == rule and (verdict is None or got[i].verdict == verdict)
    assert (got[1].host, got[1].path) == ("www.example.com", "/en/55") and (got[7].host, got[7].path) == ("x.org", "")
    assert (got[8].host, got[9].host, got[9].path) == ("", "", "") and got[None].host == "b:"
    assert R.url_verdicts(pages.limit(0), none).count() == 0


def test_posterior_by_hand(spark):
    counts = [("a.x.com", 10, 1), ("b.x.com", 20, 10), ("c.y.com", 30, 3), ("d.z.org", 40, 30), ("new.x.com", 0, 0), ("u@q.co.uk:80", 5, 1)]
    got = {r.host: r for r in R.reputation(spark.createDataFrame(counts, "host string, n long, k long")).collect()}

    def weight(groups):
        groups = [(n, k) for n, k in groups if n]
        total, bad, m = sum(n for n, _ in groups), sum(k for _, k in groups), len(groups)
        p = bad / total
        spread = sum(k * k / n for n, k in groups) - bad * bad / total
        rho = (spread / (p * (1 - p)) - (m - 1)) / (total - sum(n * n for n, _ in groups) / total - (m - 1))
        return 1e6 if rho <= 0 else min(1e6, max(1, 1 / rho - 1))

    suffixes = {"com": (60, 14), "org": (40, 30), "co.uk": (5, 1)}
    domains = {"x.com": (30, 11), "y.com": (30, 3), "z.org": (40, 30), "q.co.uk": (5, 1)}
    root, ws, wd, wh = 46 / 107, weight(suffixes.values()), weight(domains.values()), weight([c[1:] for c in counts])
    for host, n, k in counts:
        name = host.split("@")[-1].split(":")[0]
        suffix = "co.uk" if name.endswith("co.uk") else name.split(".")[-1]
        domain = next(d for d in domains if name == d or name.endswith("." + d))
        up = (root * ws + suffixes[suffix][1]) / (suffixes[suffix][0] + ws)
        mid = (up * wd + domains[domain][1]) / (domains[domain][0] + wd)
        a, b = mid * wh + k, (1 - mid) * wh + n - k
        share = a / (a + b)
        assert got[host].share == pytest.approx(share)
        assert got[host].bound == pytest.approx(share - R.Z * math.sqrt(share * (1 - share) / (a + b + 1)))
    assert got["new.x.com"].bound < got["a.x.com"].share + got["b.x.com"].share


def test_bad_hosts_are_blocked_with_enough_labels(spark):
    pages = [(i, f"https://{'bad' if i % 2 else 'good'}.site{i % 3}.com/x") for i in range(300)] + [(900, "https://rare.site0.com/x")]
    outcomes = [(i, i % 2) for i in range(300)] + [(5, None), (None, 1), (7, 1), (5, 0)]
    got = R.url_verdicts(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, bad int")).collect()
    verdicts = {(r.host.split(".")[0], r.verdict) for r in got}
    assert {("bad", "block"), ("good", "allow")} <= verdicts and ("bad", "allow") not in verdicts and ("good", "block") not in verdicts


def test_query_equals_check_sql(spark):
    diff, _, _ = compare(spark, connect(SF_DIR), SF_DIR, "op9_url_filter")
    assert diff is None, diff
