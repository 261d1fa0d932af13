import random
from collections import Counter

from llm_cases import awkward, make, words  # noqa: F401

from shelfwise.llm import licenses as L


def base(text):
    w = words(text)
    return [(n.label, k) for n in L.BASE for k in range(len(w)) if w[k : k + len(n.text.split())] == n.text.split()]


def test_base_places_of_all_documents(make, awkward):
    docs = [
        *awkward,
        (30, "MIT License, mit-license! permit license"),
        (31, "the GNU General\nPublic (License) and an Apache  license; apache licensed"),
        (32, "mit license " * 50 + "x" * 5000 + " mit license"),
        (33, "mit mit license license"),
    ]
    got = L.scan(make(docs)).collect()
    assert Counter((r.doc_id, r.n_words, tuple(sorted((b.label, b.word) for b in r.base))) for r in got) == Counter(
        (i, len(words(t)), tuple(sorted(base(t)))) for i, t in docs
    )
    assert L.scan(make([])).count() == 0


def test_notices_with_edits_are_found_and_no_more():
    scanner = L.Scanner(L.NOTICES)
    rng = random.Random(2)
    for i, notice in enumerate(L.NOTICES):
        for _ in range(30):
            text = list(notice.text)
            for at in rng.sample(range(1, len(text) - 1), notice.edits):  # at most one edit at each place
                if text[at] != " ":
                    text[at] = rng.choice(["", "q", text[at] + "q"])
            around = f"some words {''.join(text)} more words"
            assert any(k == i for k, *_ in scanner.spans(around)), (notice, around)
        broken = notice.text.replace(" ", " zzzz ")
        assert not [s for s in scanner.spans(f"some words {broken} more") if s[0] == i]


def test_spans_and_similarity(make):
    (row,) = L.scan(make([(1, "Note: Relesed under the MIT Licence. End")])).collect()
    (found,) = [f for f in row.found if f.edits]
    assert (found.label, found.first, found.last, found.edits, found.span) == ("mit", 1, 5, 2, "relesed under the mit licence")
    assert abs(found.similarity - (1 - 2 / 30)) < 0.01 and not row.base


def test_pieces_cover_a_notice():
    for notice in L.NOTICES:
        parts = L.seeds(notice)
        assert len(parts) == notice.edits + 1 and "".join(p for _, p in parts) == notice.text and all(len(p) > 4 for _, p in parts)


def test_notices_next_to_each_other():
    scanner = L.Scanner(L.NOTICES)
    good, bad, worse = "gnu lesser general public license", "gnu leser general public license", "gnu lesr general public license"
    for order in ([bad, good], [good, bad], [worse, bad, good], [bad, worse, good, worse, bad], [good] * 40 + [bad] + [good] * 40):
        for gap in (" ", " and "):
            text = gap.join(order)
            got = sorted((a, b) for k, a, b, _ in scanner.spans(text) if L.NOTICES[k].label == "lgpl")
            want, at = [], 0
            for notice in order:
                want.append((at, at + len(notice)))
                at += len(notice) + len(gap)
            assert got == want, (order, gap)
    edits = [e for k, _, _, e in scanner.spans(f"{bad} {good}") if L.NOTICES[k].label == "lgpl"]
    assert edits == [1, 0]
