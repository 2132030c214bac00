"""Cheapest repairs against a search over all edits, and the defined cases."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

from credence.llm import turn_repair

SCHEMA = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(c, t, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    return out


def fault(role, text, before):
    if not re.search(r"[^\x20\x09-\x0D]", text):
        return "blank"
    if (role, text) in before:
        return "duplicate"
    return "truncated" if re.findall(r"[^\x20\x09-\x0D]", text)[-1] not in ".!?" else ""


def search(rows):
    """Uniform-cost search over (cost, audit); a node is (place, roles so far as s?, then alternating)."""
    best, heap, tick = None, [(0, "", 0, "", ())], itertools.count()
    limit = 4 * len(rows)
    while heap:
        cost, audit, at, emitted, turns = heapq.heappop(heap)
        if best is not None and (cost, audit) >= best[:2]:
            continue
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", emitted):
            best = (cost, audit, turns)
            continue
        if not re.fullmatch("s?(ua)*u?", emitted) or cost > limit or next(tick) > 300_000:
            continue
        if len(emitted) < 2 * len(rows) + 3:
            for r in ("user", "assistant"):
                heapq.heappush(heap, (cost + 3, audit + "I", at, emitted + r[0], (*turns, r + ":")))
        if at < len(rows):
            role, text, f = rows[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, emitted, turns))
            if f not in ("blank", "duplicate"):
                more = 3 if f == "truncated" else 0
                heapq.heappush(heap, (cost + more, audit + "K", at + 1, emitted + (role[:1] or "?"), (*turns, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 3, audit + "R", at + 1, emitted + r[0], (*turns, f"{r}:{text}")))
    return best


def expected(rows):
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted((x for x in damaged(rows) if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2].encode(), x[3].encode()))
        marked, seen = [], set()
        for _, _, role, text in own:
            marked.append((role, text, fault(role, text, seen)))
            seen.add((role, text))
        turns = [x[1] for x in own if x[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        n = [sum(x[2] == f for x in marked) for f in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, fixed = search(marked) if marked else (0, "", ())
        out[c] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(fixed).encode()).hexdigest())
    return out


def random_rows(rng, conversations, most):
    texts = ["Yes.", "No", "Why?", " ", "", "Ja!\n", "é.", "x\x1c", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    rows = []
    for c in range(conversations):
        for t in range(rng.randrange(1, most)):
            rows.append((c, rng.choice([t, t, t, t + 1, None]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"Turn {t}."))
    return rows


def run(spark, rows, chunk=turn_repair.CHUNK):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {r[0]: tuple(r)[1:] for r in turn_repair.report(df, turn_repair.damage(df), chunk).collect()}


def test_against_a_search(spark):
    rows = random_rows(random.Random(3), 80, 6)
    want = expected(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, chunk=2) == want


def test_cases(spark):
    rows = [(None, None, None, None), (None, 3, "user", "Hi."), (7, None, "system", "S."), (7, None, "system", "S."), (8, 0, "assistant", "A.")]
    rows += [(9, k, "user" if k % 2 == 0 else "assistant", "word " * 50_000 + f"{k}.") for k in range(4)]
    assert run(spark, rows) == expected(rows)
    dropped = next(c for c in range(100, 1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(dropped, 0, "user", "Hi.")]) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    empty = spark.createDataFrame([], SCHEMA)
    assert turn_repair.report(empty, turn_repair.damage(empty)).collect() == []


def test_long_conversation_in_chunks(spark):
    rng = random.Random(9)
    rows = [(1, k, rng.choice(["user", "assistant", "assistant"]), f"Line {k}{rng.choice('.?x')}") for k in range(700)]
    one, many = run(spark, rows, chunk=10_000), run(spark, rows, chunk=16)
    assert one == many == run(spark, rows)


def test_repaired_turns_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "assistant", "A.", 5, "x", 1, True), (1, 1, "user", "U.", 6, "y", 2, False)], SCHEMA + ", nth int, fault string, pos int, illegal boolean")
    rows = turn_repair.faults(df)
    got = turn_repair.repaired(rows, turn_repair.plan(rows)).orderBy("pos", "nth").collect()
    # D K I (cost 7) is dearer than I K K I (6) and R R (6); ASCII puts I before R
    assert [(r.role, r.text) for r in got] == [("user", ""), ("assistant", "A."), ("user", "U."), ("assistant", "")]
    assert turn_repair.report(df, turn_repair.damage(df)).columns[-2:] == ["audit", "repaired_sha256"]
