import random
from collections import Counter

from llm_cases import awkward, make, prose, words  # noqa: F401
from shelfwise.llm import jaccard as J



def brute(docs):
    sets = []
    for _, text in docs:
        w = words(text)
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    nodes = [(i, s) for (i, _), s in zip(docs, sets)]
    link = [
        {b for b, (j, t) in enumerate(nodes) if b != a and None not in (i, j) and s and len(s & t) >= 0.8 * len(s | t)} for a, (i, s) in enumerate(nodes)
    ]
    group = list(range(len(docs)))
    changed = True
    while changed:
        changed = False
        for a in range(len(docs)):
            low = min([group[a], *(group[b] for b in link[a])])
            changed, group[a] = changed or low != group[a], low
    best = {}
    for a, (i, _) in enumerate(docs):
        if i is not None:
            best[group[a]] = min(best.get(group[a], i), i)
    return [(i, len(link[a]), None if i is None else best[group[a]]) for a, (i, _) in enumerate(docs)]


def test_equals_brute_force(make, awkward, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_ROWS", 4)  # groups then need several blocks
    base, other = prose(11, 120), prose(12, 60)
    docs = [d for d in awkward if d[0] != 8]
    for k in range(14):  # near copies, some of them only by way of others
        changed = list(base)
        for p in range(k):
            changed[p * 8] = f"new{k // 3}x{p}"
        docs.append((100 - k, " ".join(changed)))
    docs += [(200, " ".join(other)), (201, " ".join(other[:-1])), (202, " ".join(other[:30])), (203, "four words are short"), (204, "Four words, are short!")]
    got = [(r.doc_id, r.n_links, r.component_id) for r in J.jaccard_groups(make(docs)).collect()]
    assert Counter(got) == Counter(brute(docs))
    kept = {r.doc_id for r in J.jaccard_groups(make(docs)).where("kept").collect()}
    assert 6 in kept and 7 not in kept and {1, 2, 3, None} <= kept


def test_texts_of_one_id_are_one_node(make):
    got = {(r.doc_id, r.component_id) for r in J.jaccard_groups(make([(8, "one id"), (8, "two texts of one id"), (9, "two texts of one id")])).collect()}
    assert got == {(8, 8), (9, 8)}


def test_empty_table(make):
    assert J.jaccard_groups(make([])).count() == 0


def near_copies(pairs, size=60, seed=5):
    """Pairs of texts of 60 words with similarities from 0.8 on, most of them close to it."""
    rng, docs = random.Random(seed), []
    for i in range(pairs):
        a = prose(1000 + i, size)
        b = a[: size - rng.randint(1, 11)]  # a tail of k words away: 1 - k / 56
        docs += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b))]
    return docs


def test_recall_on_planted_pairs(make):
    """1,200 pairs, counted against their exact similarity."""
    docs = near_copies(1200)
    expected = {a for (a, x), (_, y) in zip(docs[::2], docs[1::2]) if (len(y.split()) - 4) >= 0.8 * 56}
    got = {r.doc_id for r in J.jaccard_groups(make(docs)).where("n_links = 1 and kept").collect()}
    assert got <= expected and len(got) >= 0.995 * len(expected) and len(expected) > 1000


def test_descent_ends_where_the_measured_recall_is_reached(spark):
    def drawn(s, n):
        return spark.createDataFrame([(s,)] * n, "similarity double")

    assert J.recall(J.LEVELS[-1]) >= J.TARGET > J.recall(J.LEVELS[-2])  # the last level holds on any data
    assert J.measured(drawn(0.99, 1000), J.LEVELS[0]) >= J.TARGET  # near copies only: whole labels do
    assert J.measured(drawn(0.99, 200), J.LEVELS[0]) < J.TARGET  # too few to tell
    assert J.measured(drawn(0.82, 2000), J.LEVELS[0]) < J.TARGET
    assert J.measured(drawn(0.99, 0), J.LEVELS[0]) < J.TARGET


def test_close_copies_need_whole_labels_only(make, monkeypatch):
    depths, plain = [], J.descend
    monkeypatch.setattr(J, "descend", lambda *a: (lambda out: (depths.append(out[1]), out)[1])(plain(*a)))
    docs = []
    for i in range(600):
        a = prose(3000 + i, 150)
        docs += [(4 * i + k, " ".join(a[: 150 - k])) for k in range(3)]
    got = [r.n_links for r in J.jaccard_groups(make(docs)).collect()]
    assert depths == [J.LEVELS[0]] and got == [2] * 1800


def test_chain_of_unlinked_texts_costs_its_meetings(make, monkeypatch):
    """Each text shares half of its shingles with the next: prefixes chain them, but no group is compared with itself."""
    long = prose(77, 4000)
    docs = [(i, " ".join(long[12 * i : 12 * i + 60])) for i in range(300)]
    sizes, plain = [], J.blocks

    def counted(nodes):
        rows = nodes.groupBy("tree", "group").count().collect()
        sizes.append([r["count"] for r in rows])
        return plain(nodes)

    monkeypatch.setattr(J, "blocks", counted)
    got = J.jaccard_groups(make(docs)).collect()
    assert {(r.n_links, r.kept) for r in got} == {(0, True)}
    alike, meetings = sizes
    assert not alike and meetings and max(meetings) < 12 and sum(n * n for n in meetings) < 300 * 300 / 4


def test_groups_under_one_prefix_are_compared_once(make, monkeypatch):
    """Two groups that link only by their edges, blocks of three rows: counts must be those of brute force."""
    monkeypatch.setattr(J, "BLOCK_ROWS", 3)
    base, docs = prose(21, 100), []
    for k in range(36):  # a text moves away from the first step by step
        changed = list(base)
        for p in range(k):
            changed[(p * 37) % 100] = f"new{p}"
        docs.append(((k * 17) % 36, " ".join(changed)))
    got = [(r.doc_id, r.n_links, r.component_id) for r in J.jaccard_groups(make(docs)).collect()]
    assert Counter(got) == Counter(brute(docs))
