import hashlib
import random
import re
import zlib
from itertools import groupby

from llm_cases import prose  # noqa: F401
from conftest import SF_DIR

from shelfwise.llm import conversations as C
from shelfwise.llm.queries import QUERIES

ROW = "conv_id long, turn long, role string, text string, edit string, step int, part int, gone boolean"


def cheapest(rows):
    """Cost, audit and output of the best repair, by trying all. ``rows``: (role, text, fault)."""
    bound, best = 7 * len(rows) + 1, []

    def go(i, out, audit, cost):
        nonlocal bound
        initials = "".join(r[:1] if r[:1] else "?" for r, _ in out)
        if cost > bound or not re.fullmatch(r"(s?(ua)*u?)?", initials):
            return
        if i == len(rows):
            if re.fullmatch(r"(s?(ua)+)?", initials):
                bound = min(bound, cost)
                best.append((cost, audit, out))
        else:
            role, text, fault = rows[i]
            go(i + 1, out, audit + "D", cost + 4)
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                go(i + 1, [*out, (role, text)], audit + "K", cost + more)
                for other in ("user", "assistant"):
                    go(i + 1, [*out, (other, text)], audit + "R", cost + 3 + more)
        for other in ("user", "assistant"):
            go(i, [*out, (other, "")], audit + "I", cost + 3)

    go(0, [], "", 0)
    return min(best)


def brute_force(table):
    """The query's rows from plain loops."""
    out, rows = {c: None for c, *_ in table}, []
    for conv, turn, role, text in table:
        role, text = (" " if x is None else x for x in (role, text))
        part = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if part == 1 else re.sub("[.!?]", "", text) if part == 2 else text
        role = "user" if part == 4 else role
        rows += [(conv, turn, role, text)] * (0 if part == 0 else 2 if part == 3 else 1)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3].encode()))
    for conv, group in groupby(rows, key=lambda r: r[0]):
        group, seen, faults = list(group), set(), []
        for _, _, role, text in group:
            solid = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for _, t, _, _ in group if t is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(group, group[1:]))
        cost, audit, repaired = cheapest([(r, t, f) for (_, _, r, t), f in zip(group, faults)])
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return {(c, *(r or nothing)) for c, r in out.items()}


def test_query_equals_brute_force(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = QUERIES["op12_conversation_repair"](spark, SF_DIR)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {tuple(r) for r in got.collect()} == brute_force(table) and got.count() == len({c for c, *_ in table})


def test_awkward_rows(spark, tmp_path):
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User"], ["Yes.", "No", "", None, " \n", "What? ", "One!\n", "é.", "x "]
    table = [(c, rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for c in [None, *range(60)] for _ in range(rng.randint(1, 6))]
    table += [table[0]] * 2 + [(99, None, "user", "word. " * 50_000), (-(1 << 63), (1 << 63) - 1, "assistant", "No")]
    # a conversation of which nothing stays
    lost = next(c for c in range(1000, 5000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    table.append((lost, 0, "user", "Gone."))
    extra = [(*r, "K", 1, 2, True) for r in table]
    spark.createDataFrame(extra, ROW).write.parquet(f"{tmp_path}/conversations.parquet")
    assert {tuple(r) for r in QUERIES["op12_conversation_repair"](spark, str(tmp_path)).collect()} == brute_force(table)
    spark.createDataFrame([], ROW).write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    assert QUERIES["op12_conversation_repair"](spark, str(tmp_path)).count() == 0


def test_edits_rebuild_the_conversation(spark):
    rows = [(1, 0, "user", "Hi.", False), (1, 1, "user", "Hello", False), (1, 2, "assistant", "", False), (2, 0, "system", "Be kind.", False), (3, 0, "user", None, True)]
    edits = C.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gone boolean")).orderBy("conv_id", "step").collect()
    assert [(e.edit, e.role, e.text) for e in edits if e.conv_id == 1] == [("K", "user", "Hi."), ("R", "assistant", "Hello"), ("D", "assistant", "")]
    assert [e.edit for e in edits if e.conv_id == 2] == ["D"] and [e.edit for e in edits if e.conv_id == 3] == [None]


def test_search_over_many_random_conversations():
    rng = random.Random(1)
    for k in range(400):
        faults = ["", "", "", "blank", "truncated"]
        rows = [(rng.choice("suat" if k % 2 else "ua"), "", rng.choice(faults)) for _ in range(rng.randint(0, 6))]
        got = []
        search = C.Repair(lambda edit, row, state: got.append(edit))
        for role, _, fault in rows:
            search.row(role, fault == "blank", fault == "truncated", None)
        assert (search.end(), "".join(got)) == cheapest(rows)[:2]


def live(root):
    todo, n = [root], 0
    while todo:
        node = todo.pop()
        n += 1
        todo += node.kids
    return n


def test_memory_stays_with_what_is_unresolved():
    rng, got, most = random.Random(2), [], 0
    search = C.Repair(lambda edit, row, state: got.append(edit))
    for k in range(20_000):
        search.row("ua"[k % 2] if rng.random() < 0.9 else rng.choice("uas"), rng.random() < 0.1, rng.random() < 0.1, None)
        most = max(most, live(search.root))
    search.end()
    assert most < 300 and len(got) >= 20_000 and live(search.root) == 1
    # two survivors that never meet: ties are still settled over the whole suffix
    got, search = [], C.Repair(lambda edit, row, state: got.append(edit))
    for _ in range(20_001):
        search.row("u", False, False, None)
    assert search.end() == 3 * 10_001 and "".join(got) == "KI" + "KR" * 10_000
