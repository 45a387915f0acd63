"""Repairs against a search over all edit sequences, whole and in fragments."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from chronolith.llm import structure_repair
from chronolith.llm.structure_repair import ARCS, END, START, backward, forward, repair, summary, walk

TEXT = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    """(turn, role, text) of one conversation after its damage, in order."""
    out = []
    for conv, turn, role, text in rows:
        conv, number = " " if conv is None else conv, " " if turn is None else turn
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{conv}:{number}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        marks = TEXT.findall(text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """Least cost, then least audit, by a search in order of both; roles are checked at the end against the pattern alone."""
    queue = [(0, "", 0, "", ())]
    best = {}
    while queue:
        cost, audit, i, roles, put = heapq.heappop(queue)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, audit, "\n".join(put)
        key = (i, roles[-1:], len(roles) > 0)
        if not re.fullmatch("(s?(ua)*u?)?", roles) or best.setdefault(key, (cost, audit)) < (cost, audit):
            continue
        for role in ("user", "assistant"):
            heapq.heappush(queue, (cost + 5, audit + "I", i, roles + role[0], (*put, f"{role}:")))
        if i < len(rows):
            heapq.heappush(queue, (cost + 2, audit + "D", i + 1, roles, put))
            if fault[i] not in ("blank", "duplicate"):
                more = 5 * (fault[i] == "truncated")
                _, role, text = rows[i]
                heapq.heappush(queue, (cost + more, audit + "K", i + 1, roles + (role[:1] or "?"), (*put, f"{role}:{text}")))
                for other in ("user", "assistant"):
                    heapq.heappush(queue, (cost + more + 1, audit + "R", i + 1, roles + other[0], (*put, f"{other}:{text}")))


def plain(rows):
    left = damaged(rows)
    fault = faults(left)
    turns = [t for t, _, _ in left if t is not None]
    cost, audit, text = cheapest(left, fault)
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": fault.count("blank"), "duplicate": fault.count("duplicate"), "truncated": fault.count("truncated"),
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(left, left[1:], strict=False)), "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest(),
    }


def conversations(seed, convs, most):
    r = random.Random(seed)
    rows = []
    for conv in range(convs):
        for _ in range(r.randint(1, most)):
            text = r.choice(["yes.", "no!", "cut off", "", " \n", "so?", "well. ", None, "x", f"t{r.random():.3f}.", "end.\x0b"])
            rows.append((r.choice([conv, conv, conv, None]), r.choice([None, *range(12)]), r.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "up", "Sys"]), text))
    return rows


def same(spark, rows):
    df = spark.createDataFrame([(*x, 1, "x") for x in rows], "conv_id bigint, turn bigint, role string, text string, number int, conv string")
    got = {r.conv_id: r.asDict() for r in summary(df).collect()}
    assert len(got) == len({x[0] for x in rows})
    for conv, found in got.items():
        expected = plain([x for x in rows if x[0] == conv])
        assert {k: v for k, v in found.items() if k != "conv_id"} == expected, conv


def test_short_conversations(spark):
    same(spark, conversations(1, 120, 9))


@pytest.mark.parametrize("turns", [1, 3])
def test_fragments_make_no_difference(spark, monkeypatch, turns):
    monkeypatch.setattr(structure_repair, "FRAGMENT_TURNS", turns)
    same(spark, conversations(2, 25, 40))


def test_empty_and_lost(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert summary(spark.createDataFrame([], schema)).count() == 0
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    row = summary(spark.createDataFrame([(lost, 0, "user", "hi.")], schema)).first()
    assert (row.gaps, row.cost, row.audit, row.repaired_sha256) == (0, 0, "", hashlib.sha256(b"").hexdigest())


def test_no_cheaper_audit_is_smaller():
    """Every sequence of codes up to length 3: all audits of least cost, spelled out, and their least one."""
    def spell(codes, i, state, cost, audit):
        if i == len(codes) and state in (0, 3):
            yield cost, audit
        if audit[-2:] != "II":
            yield from spell(codes, i, structure_repair.FOLLOW[state], cost + 5, audit + "I")
        if i < len(codes):
            for letter, c, t in ARCS[codes[i]][state]:
                yield from spell(codes, i + 1, t, cost + c, audit + letter)

    r = random.Random(5)
    for _ in range(150):
        codes = bytes(r.randrange(16) for _ in range(r.randint(0, 3)))
        before, after = forward(codes, START), backward(codes, END)
        audit, _ = walk(codes, before, after, after[0][0], 0, True)
        assert (after[0][0], audit) == min(spell(codes, 0, 0, 0, ""))


def test_one_long_conversation_is_spread(spark):
    """Its fragments come from several tasks, none is larger than the bound, and they join to one repair."""
    rows = [(7, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(20_000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would come to one task
    try:
        parts = repair(df).select("number", "audit", "cost").orderBy("number").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({p.number >> 32 for p in parts}) > 1 and all(len(p.audit) <= 4200 for p in parts) and len({p.cost for p in parts}) == 1
    left = damaged(rows)
    audit = "".join(p.audit for p in parts)
    assert len(audit.replace("I", "")) == len(left)
    row = summary(df).first()
    assert row.audit == audit and row.cost == parts[0].cost
