import hashlib
from collections import Counter
from itertools import accumulate

import public_tokenizers as P
import pytest
import sentencepiece
from llm_cases import awkward, documents, make, prose  # noqa: F401
from tokenizers import Tokenizer

from shelfwise.llm import alignment
from shelfwise.llm.queries import QUERIES

ODD = [
    (20, " "), (21, "  a  b \n c\n\n d   "), (22, "a ▁ marker"), (23, "a  b  c \x1c d\x1f e \x00 f   g"), (24, "I'm don't 'll x's 12 345"), (25, "\n"),
    (26, "\ta b"), (27, "a\r\n b"), (28, "ﬁ Å <0x41> <unk>"), (29, "   x　 y"), (30, "x" + " " * 5000 + "y"),
]


def tokens(text):
    """Ids and bytes of both sides, or none."""
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    value, names = alignment.byte_values(), {i: s for s, i in a.get_vocab().items()}
    a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    a_bytes = [bytes(value[c] for c in names[i]) for i in a_ids]
    pieces = [(i, b.id_to_piece(i)) for i in b_ids]
    b_bytes = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
    if not text or not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
        return [], [], [], []
    return a_ids, b_ids, *([*accumulate(map(len, x))] for x in (a_bytes, b_bytes))


def brute_force(docs):
    counts, each = Counter(), []
    for doc_id, text in docs:
        a, b, a_end, b_end = tokens(text or "")
        links, i, j = [], 0, 0
        while i < len(a):
            links.append((a[i], b[j]))
            i, j = i + (a_end[i] <= b_end[j]), j + (b_end[j] <= a_end[i])
        groups, i, j = [], 0, 0
        for end in sorted({*a_end} & {*b_end}):
            x, y = a_end.index(end, i) + 1, b_end.index(end, j) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        counts.update(links)
        each.append((doc_id, len(a), len(b), groups, links))
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return Counter(
        (d, a, b, len(g), len(x), sum(counts[p] == most[p[1]] for p in x), sum(counts[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for d, a, b, g, x in each
    )


@pytest.mark.parametrize("links", [1_000_000, 50])
def test_query_equals_brute_force(spark, documents, awkward, monkeypatch, links):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", links)  # many small blocks, too
    docs = [*awkward, *ODD]
    got = QUERIES["op11_token_alignment"](spark, documents(docs))
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == brute_force(docs)


def test_alignments_hold_all_overlaps(spark, make):
    docs = [(1, "tokenizers disagree, unbelievably, about naïve words"), (2, None)]
    rows = {r.doc_id: r for r in alignment.alignments(make(docs), alignment.shared_models(spark, *alignment.paths())).collect()}
    a, b, a_end, b_end = tokens(docs[0][1])
    want = {(i, j) for i in range(len(a)) for j in range(len(b)) if max([0, *a_end][i], [0, *b_end][j]) < min(a_end[i], b_end[j])}
    r = rows[1]
    assert (r.a_ids, r.b_ids) == (a, b) and {*zip(r.link_a, r.link_b)} == want and len(r.link_a) == len(want)
    assert [e for e, last in zip(a_end, r.a_last) if last] == [e for e, last in zip(b_end, r.b_last) if last] == sorted({*a_end} & {*b_end})
    assert rows[2].a_ids == rows[2].link_a == []


def test_words_are_forgotten_and_learnt_again(awkward, monkeypatch):
    import shelfwise.llm.alignment as module

    blobs = open(module.paths()[0], encoding="utf-8").read(), open(module.paths()[1], "rb").read()
    small, large = module.Aligner(*blobs), module.Aligner(*blobs)
    assert large.cut
    texts = [t or "" for _, t in [*awkward, *ODD]]
    whole = list(module.Aligned(large, texts).group_texts())
    monkeypatch.setattr(module, "KEEP", 3)
    assert [next(module.Aligned(small, [t]).group_texts()) for t in texts] == whole
    small.cut = False  # tokenizers that can't be cut at blanks
    small.clear()
    assert list(module.Aligned(small, texts).group_texts()) == whole


def test_empty_table(spark, make):
    assert alignment.alignment_counts(make([]), alignment.shared_models(spark, *alignment.paths())).count() == 0
