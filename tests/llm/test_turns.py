import hashlib
import heapq
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tiersight.llm import queries, turns

WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def cheapest(classes):
    """Dijkstra over (row, state) with whole audits as the tie-break; classes: (must go, initial, truncated)."""
    heap, done = [(0, "", 0, "n", ())], {}
    move = {"n": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    while heap:
        cost, audit, i, state, made = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done[i, state] = True
        if i == len(classes) and state in "na":
            return cost, audit, made
        for role in "ua":
            if role in move[state]:
                heapq.heappush(heap, (cost + 2, audit + "I", i, move[state][role], (*made, (None, role))))
        if i < len(classes):
            gone, initial, late = classes[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, made))
            if not gone:
                if initial in move[state]:
                    heapq.heappush(heap, (cost + late, audit + "K", i + 1, move[state][initial], (*made, (i, None))))
                for role in "ua":
                    if role in move[state]:
                        heapq.heappush(heap, (cost + 2 + late, audit + "R", i + 1, move[state][role], (*made, (i, role))))
    raise AssertionError


def brute_force(rows, after):
    by = defaultdict(list)
    for conv, *_ in rows:
        by[conv] = []
    for conv, turn, role, text in after:
        by[conv].append((turn is not None, turn or 0, role, text, turn))
    out, nothing = [], hashlib.sha256(b"").hexdigest()
    for conv, own in by.items():
        own.sort(key=lambda r: (*r[:3], r[3][:200], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))
        seen, faults, classes = set(), [], []
        for _, _, role, text, _ in own:
            bare = text.strip(WHITE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
            classes.append((faults[-1] in ("blank", "duplicate"), role[:1] if role[:1] in ("s", "u", "a") else "?", int(faults[-1] == "truncated")))
        cost, audit, made = cheapest(classes)
        given = {r[4] for r in own if r[4] is not None}
        gaps = max(given) - min(given) + 1 - len(given) if given else 0
        names = {"u": "user", "a": "assistant"}
        lines = [f"{names[role] if role else own[i][2]}:{'' if i is None else own[i][3]}" for i, role in made]
        illegal = sum(x[2][:1] + y[2][:1] not in ("su", "ua", "au") for x, y in zip(own, own[1:]))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest() if own else nothing
        out.append((conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest))
    return sorted(out, key=str)


def result(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op12_conversation_repair(spark, sf)) == brute_force(rows, damaged(rows))


def odd_rows():
    rng = np.random.default_rng(5)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "s", "User"]
    texts = ["", " \n", None, "Yes.", "No", "Ask?  ", "x", "long text. " * 40 + "end.", "long text. " * 40 + "other", "Done!", "a", "b."]
    rows = [(None, None, None, None), (None, 3, "user", "Hm."), (7, None, "user", "q?"), (7, None, "assistant", "r."), (7, None, None, None), (8, None, "user", None), (9, 5, "system", "Alone.")]
    for conv in range(10, 60):
        for _ in range(rng.integers(1, 14)):
            turn = int(rng.integers(0, 9))
            rows.append((conv, turn if turn < 8 else None, roles[rng.integers(len(roles))], texts[rng.integers(len(texts))]))
    rows += [(100, k, ["user", "assistant"][k % 2] if k % 7 else "system", f"Text {k // 3}." if k % 5 else f"Text {k}") for k in range(400)]
    rows += [(101, 1, "user", "Again.")] * 90 + [(102, k, "user", f"t{k}") for k in range(70)]
    return rows


@pytest.mark.parametrize("stretch", [1, 3, 256])
def test_odd_conversations_over_stretches(spark, monkeypatch, stretch):
    """Nulls anywhere, unknown and empty roles, ties and repeats, long conversations, columns of other names; cut into stretches of any length."""
    monkeypatch.setattr(turns, "STRETCH", stretch)
    rows = odd_rows()
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, stretch int, cost string").repartition(3)
    assert result(turns.repair_digest(table, turns.damage(table))) == brute_force(rows, damaged(rows))
    plain = [(c, t, *(" " if x is None else x for x in r)) for c, t, *r in rows]
    assert result(turns.repair_digest(table, table)) == brute_force(rows, plain)


@pytest.mark.parametrize("seed", range(6))
def test_solved_signatures_are_cheapest(seed):
    rng = np.random.default_rng(seed)
    for _ in range(60):
        letters = "".join(rng.choice(list("xsuaoSUAO"), rng.integers(1, 12)))
        (way,) = turns.solve(f"^{letters}$").values()
        cost, audit, made = cheapest([(c == "x", c.lower() if c.lower() in "sua" else "?", int(c.isupper())) for c in letters])
        assert (way.cost, "".join(way.edits)) == (cost, audit)
        assert "".join(way.roles).replace("-", "") == "".join(role or letters[i].lower() for i, role in made)
        assert re.fullmatch("(s?(ua)+)?", "".join(way.roles).replace("-", ""))


def test_no_rows_and_all_rows_dropped(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert result(turns.repair_digest(empty, turns.damage(empty))) == []
    some = spark.createDataFrame([(1, 1, "user", "a.")], empty.schema)
    assert result(turns.repair_digest(some, empty)) == [(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
