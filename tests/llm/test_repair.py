"""Conversation repair against a search over all series of edits and a plain rewrite of the query's rules."""

import hashlib
import heapq
import re
import zlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def cheapest(rows):
    """The ASCII-least cheapest edits of (role, text, fault), by uniform cost over (cost, letters) with no states shared."""
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, letters, i, initials, out = heapq.heappop(heap)
        tail = (i, initials[-1:], len(initials) % 2, len(initials) > 0)
        if i == len(rows) and GOOD.match(initials):
            return cost, letters, out
        if tail in seen:
            continue
        seen.add(tail)

        def go(extra, letter, step, kept):
            if not kept or re.match(r"(s|s?(ua)*u?)\Z", initials + kept[0][:1]) and kept[0][:1]:
                heapq.heappush(heap, (cost + extra, letters + letter, i + step, initials + (kept[0][:1] if kept else ""), out + ((kept,) if kept else ())))

        for role in ("user", "assistant"):
            go(2, "I", 0, (role, ""))
        if i < len(rows):
            role, text, fault = rows[i]
            go(3, "D", 1, None)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                go(more, "K", 1, (role, text))
                for to in ("user", "assistant"):
                    go(2 + more, "R", 1, (to, text))


def plain(rows):
    """The query's columns for rows (turn, role, text) of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, marked = set(), []
    for _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
    cost, letters, out = cheapest(marked)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    bad = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    n = [sum(f == k for *_, f in marked) for k in ("blank", "duplicate", "truncated")]
    return [gaps, *n, bad, cost, letters, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()]


def damaged(conv, rows):
    out = []
    for turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (turn, "user" if n == 4 else role, "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text)
        out += [row] * (0 if n == 0 else 2 if n == 3 else 1)
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_every_conversation_as_the_rules_say(spark):
    from tenderlake.llm import repair

    held = {}
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect():
        held.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"]))
    got = {r["conv_id"]: [r[c] for c in COLUMNS] for r in repair.op11_repair(spark, SMALL).collect()}
    assert got == {k: plain(damaged(k, v)) for k, v in held.items()}


def random_rows(rng, n):
    roles, texts = ["user", "assistant", "system", "tool", "usher", "", None], ["a.", "b!", "c", "", " \t", "d? ", "e", None, "f\n", "g."]
    return [(int(t) if (t := rng.integers(-1, 3 * n)) >= 0 else None, roles[rng.choice(7, p=[0.3, 0.3, 0.1, 0.1, 0.1, 0.05, 0.05])],
             texts[rng.integers(10)] if rng.random() < 0.6 else f"{rng.integers(99)}.") for _ in range(n)]


def fixture():
    rng, out = np.random.default_rng(7), []
    for conv in range(120):
        rows = {}
        for turn, role, text in [(None, "user", "x"), *random_rows(rng, int(rng.integers(1, 14)))]:
            rows[turn] = (turn, role, text)  # one row a turn, so that the order is stated
        out += [(conv if conv else None, *r) for r in rows.values()]
    return out


@pytest.mark.parametrize("segments", [{}, {"segment_rows": 1}, {"segment_rows": 3}])
def test_segments_of_any_length_give_the_same(spark, segments):
    """Nulls, blanks, repeats, unknown and empty roles, a null conversation; extra columns with clashing names."""
    from tenderlake.llm import repair

    rows = fixture()
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, pid int")
    held = {}
    for conv, *r in rows:
        held.setdefault(conv, []).append(tuple(r))
    s = replace(repair.Settings(), **segments)
    got = repair.digest(repair.repair(repair.damage(df), s, copies=F.col("copies"))).collect()
    assert {r["conv_id"]: [r[c] for c in COLUMNS] for r in got} == {k: plain(damaged(k, v)) for k, v in held.items()}
    assert len(got) == len(held)


def test_one_conversation_holds_nearly_all_rows(spark):
    """It lies in many tasks, rows repeat across its segments, and the others are as they are alone."""
    from tenderlake.llm import repair

    rows = [(1, i, ["user", "assistant", "user"][i % 3], f"{i % 700}{'.' if i % 5 else ''}") for i in range(3000)] + [(2, 0, "user", "q?"), (2, 1, "assistant", "a."), (0, 5, "tool", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = repair.repair(df, repair.Settings(segment_rows=100))
    assert out.where("conv_id = 1").agg(F.max("parts"), F.count("*")).first()[1] >= 30
    got = {r["conv_id"]: [r[c] for c in COLUMNS] for r in repair.digest(out).collect()}
    assert got == {k: plain([r[1:] for r in rows if r[0] == k]) for k in (0, 1, 2)}


def test_empty_table_and_dropped_conversation(spark):
    from tenderlake.llm import repair

    df = spark.createDataFrame([(3, 1, "user", "a.")], "conv_id int, turn int, role string, text string")
    assert repair.digest(repair.repair(df.limit(0))).count() == 0
    gone = repair.digest(repair.repair(df, copies=F.lit(0))).collect()
    assert [list(r) for r in gone] == [[3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()]]
