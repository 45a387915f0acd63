"""Repair of the order of roles in conversations at least cost (op11).

The turns of a conversation and the four states of its grammar, ``(s?(ua)+)?``, are the
nodes of a graph; edits are its arcs. Least costs from the start and to the end tell
which arcs lie on some cheapest path; a set of states walks along these, each step by the
least letter that any of them offers, and spells the least of all cheapest audits.

Turns are sorted over the cluster and cut into fragments of bounded size, wherever a
conversation ends: most are whole conversations and are mended alone. Of longer ones each
fragment gives a 4 x 4 matrix of costs, and passes over these tell the costs to the left
and right of each; then fragments walk apart from every state that they may be entered in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .storage import saved

#: states: nothing yet, rules, a user's turn, an assistant's turn; the state that the next user's or assistant's turn leads to
FOLLOW = (2, 2, 3, 2)
NEEDED = ("user", "user", "assistant", "user")
#: the initial that each state lets come next, and where it leads
ALLOWED = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
NEVER = 1 << 50
START = [0, NEVER, NEVER, NEVER]
#: cost to end a conversation in each state, by insertions alone
END = [0, 10, 5, 0]
DELETE, RETITLE, INSERT, LEFT_TRUNCATED = 2, 1, 5, 5
FAULTS = ("", "blank", "duplicate", "truncated")
INITIALS = "sua"
#: turns of a fragment, and characters after which it ends
FRAGMENT_TURNS, FRAGMENT_CHARS = 4096, 1 << 20

Arc = tuple[str, int, int]


def _row_arcs(code: int) -> list[list[Arc]]:
    """For each state the edits of a turn: letter, cost, next state."""
    fault, initial = FAULTS[code >> 2], (INITIALS + "?")[code & 3]
    out: list[list[Arc]] = [[("D", DELETE, s)] for s in range(4)]
    if fault in ("blank", "duplicate"):
        return out
    more = LEFT_TRUNCATED if fault else 0
    for s in range(4):
        if initial in ALLOWED[s]:
            out[s].append(("K", more, ALLOWED[s][initial]))
        out[s].append(("R", RETITLE + more, FOLLOW[s]))
    return out


ARCS = [_row_arcs(code) for code in range(16)]
PAIRS = {initials + other for initials, other in (("s", "u"), ("u", "a"), ("a", "u"))}


def backward(codes: bytes, right: list[int]) -> list[list[int]]:
    """Least cost from each place and state to the end; at the right edge it is ``right``."""
    out = [right]
    for code in reversed(codes):
        nxt = out[-1]
        r = [min(c + nxt[t] for _, c, t in arcs) for arcs in ARCS[code]]
        out.append([min(r[s], INSERT + r[FOLLOW[s]], 2 * INSERT + r[FOLLOW[FOLLOW[s]]]) for s in range(4)])
    return out[::-1]


def forward(codes: bytes, left: list[int]) -> list[list[int]]:
    """Least cost from the start to each place and state, insertions there included; at the left edge ``left`` comes before them."""
    out = []
    at = list(left)
    for code in [*codes, None]:
        for _ in range(2):
            for s in range(4):
                at[FOLLOW[s]] = min(at[FOLLOW[s]], at[s] + INSERT)
        out.append(at)
        if code is not None:
            nxt = [NEVER] * 4
            for s, arcs in enumerate(ARCS[code]):
                for _, c, t in arcs:
                    nxt[t] = min(nxt[t], at[s] + c)
            at = nxt
    return out


def walk(codes: bytes, before: list[list[int]], after: list[list[int]], total: int, entry: int, last: bool) -> tuple[str, int]:
    """The least audit among cheapest ones from state ``entry`` on, and the state it ends in; only the last fragment has insertions behind its turns."""
    out: list[str] = []
    states, i, n = {entry}, 0, len(codes)
    while i < n or last:
        tight = set()
        for s in states:
            if before[i][s] + INSERT + after[i][FOLLOW[s]] == total:
                tight.add(("I", FOLLOW[s]))
            if i < n:
                tight.update((a, t) for a, c, t in ARCS[codes[i]][s] if before[i][s] + c + after[i + 1][t] == total)
        if not tight:
            break
        letter = min(tight)[0]
        out.append(letter)
        states = {t for a, t in tight if a == letter}
        i += letter != "I"
    return "".join(out), min(states)


def edited(letters: str, entry: int, codes: bytes, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits."""
    state, i = entry, 0
    put_roles, put_texts = [], []
    for a in letters:
        if a != "D":
            put_roles.append(roles[i] if a == "K" else NEEDED[state])
            put_texts.append("" if a == "I" else texts[i])
            state = ALLOWED[state][INITIALS[codes[i] & 3]] if a == "K" else FOLLOW[state]
        i += a != "I"
    return put_roles, put_texts


def _key(conv_id: Column) -> Column:
    """The id as text that is never null."""
    return F.when(conv_id.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), conv_id.cast("string")))


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, conv, known, place, role, text, copies`` after the damage that a turn's crc32 names; nulls are one blank."""
    or_blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_blank("conv_id"), F.lit(":"), or_blank("turn")).cast("binary")) % 20
    role = F.when(kind == 4, F.lit("user")).otherwise(or_blank("role"))
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(or_blank("text"), "[.!?]+", "")).otherwise(or_blank("text"))
    return conversations.filter(kind != 0).select(
        "conv_id", _key(F.col("conv_id")).alias("conv"), F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("place"),
        role.alias("role"), text.alias("text"), F.when(kind == 3, F.lit(2)).otherwise(F.lit(1)).cast("bigint").alias("copies"),
    )


def faulty(turns: DataFrame) -> DataFrame:
    """The rows of ``damage`` once each, with their number, ``repeated`` (role and text come in an earlier turn) and ``state`` (blank, truncated or neither).

    Equal rows are counted before they are shuffled; first turns of a role and text are sought by hash
    (SHA-256), without texts. Of several equal rows the first one alone can be no duplicate.
    """
    lean = turns.select("conv", "known", "place", "role", F.sha2("text", 256).alias("digest"))
    when = F.struct("known", "place")
    firsts = lean.groupBy("conv", "role", "digest").agg(F.min(when).alias("first"), F.max(when).alias("final")).filter("first < final").drop("final")
    again = lean.join(firsts, ["conv", "role", "digest"]).filter(when > F.col("first")).select(*lean.columns).distinct()
    once = turns.withColumn("digest", F.sha2("text", 256)).groupBy(*lean.columns).agg(F.first("conv_id").alias("conv_id"), F.first("text").alias("text"), F.sum("copies").alias("copies"))
    rest = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    state = F.when(rest == "", "blank").when(~rest.isin(".", "!", "?"), "truncated").otherwise("")
    return once.join(again.withColumn("repeated", F.lit(True)), lean.columns, "left").select("conv_id", "conv", "known", "place", "role", "text", "copies", F.coalesce("repeated", F.lit(False)).alias("repeated"), state.alias("state"))


class _Fragment:
    """Neighbouring turns of one conversation while they are read."""

    def __init__(self, row: dict, number: int) -> None:
        self.conv, self.conv_id, self.number = row["conv"], row["conv_id"], number
        self.codes, self.roles, self.texts, self.chars = bytearray(), [], [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None
        self.first = self.initial = row["role"][:1]

    def add(self, row: dict, fault: str) -> None:
        initial = row["role"][:1]
        if self.codes:
            self.illegal += self.initial + initial not in PAIRS
        self.initial = initial
        self.codes.append(FAULTS.index(fault) << 2 | (INITIALS.find(initial) if initial and initial in INITIALS else 3))
        gone = fault in ("blank", "duplicate")
        self.roles.append("" if gone else row["role"])
        self.texts.append("" if gone else row["text"])
        self.chars += 0 if gone else len(row["role"]) + len(row["text"])
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        if row["known"]:
            self.turns += self.high != row["place"]
            self.high = row["place"]
            self.low = self.high if self.low is None else self.low


STATS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, low bigint, high bigint, first string, initial string"
STATS_NAMES = [c.split()[0] for c in STATS.split(", ")]
FIXED = "conv string, number bigint, whole boolean, " + STATS


def _told(f: _Fragment, whole: bool) -> dict:
    names = ("conv", "conv_id", "number", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "initial", "roles", "texts")
    return {n: getattr(f, n) for n in names} | {"codes": bytes(f.codes), "whole": whole}


def _cut(rows: Iterator[dict]) -> Iterator[dict]:
    """Fragments of sorted turns. Only one that has other conversations of its task on both sides is surely a whole one."""
    number = TaskContext.get().partitionId() << 32
    now: _Fragment | None = None
    parts, opening = 0, True  # fragments of this conversation so far, and whether it is the task's first
    for row in rows:
        for copy in range(row["copies"]):
            if now is None:
                now = _Fragment(row, number)
            elif row["conv"] != now.conv:
                yield _told(now, not parts and not opening)
                now, parts, opening = _Fragment(row, now.number + 1), 0, False
            elif len(now.codes) >= FRAGMENT_TURNS or now.chars >= FRAGMENT_CHARS:
                yield _told(now, False)
                now, parts = _Fragment(row, now.number + 1), parts + 1
            fault = row["state"] if row["state"] == "blank" else "duplicate" if copy or row["repeated"] else row["state"]
            now.add(row, fault)
    if now is not None:
        yield _told(now, False)


def _mapped(df: DataFrame, run: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """``run`` over the rows of each partition, in their order; results leave in batches of a few MB."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for r in run(row for batch in found for row in batch.to_pylist()):
            held.append(r)
            size += 500 + sum(map(len, r.get("texts") or ()))
            if size > FRAGMENT_CHARS:
                yield pa.RecordBatch.from_pylist(held, schema=arrow)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=arrow)

    return df.mapInArrow(batches, schema)


def fragments(turns: DataFrame) -> DataFrame:
    """Sorted turns in fragments: ``conv_id, codes, roles, texts`` and what ``FIXED`` names; ``number`` goes up with the order."""
    order = ["conv", "known", "place", "role"]
    placed = turns.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    schema = f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {FIXED}, codes binary, roles array<string>, texts array<string>"
    return _mapped(placed, _cut, schema)


def _mend_whole(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        before, after = forward(r["codes"], START), backward(r["codes"], END)
        cost = after[0][0]
        audit, _ = walk(r["codes"], before, after, cost, 0, True)
        roles, texts = edited(audit, 0, r.pop("codes"), r["roles"], r["texts"])
        yield r | {"cost": cost, "audit": audit, "roles": roles, "texts": texts}


def _matrix(rows: Iterator[dict]) -> Iterator[dict]:
    """Least cost through a fragment from each state to each, row by row."""
    for r in rows:
        to = [backward(r["codes"], [0 if s == t else NEVER for s in range(4)])[0] for t in range(4)]
        yield {"conv": r["conv"], "number": r["number"], "matrix": [to[t][s] for s in range(4) for t in range(4)]}


def _lefts(rows: Iterator[dict]) -> Iterator[dict]:
    for conv, parts in groupby(rows, key=lambda r: r["conv"]):
        left = START
        for r in parts:
            yield {"conv": conv, "number": r["number"], "left": left}
            m = r["matrix"]
            left = [min(left[s] + m[4 * s + t] for s in range(4)) for t in range(4)]


def _rights(rows: Iterator[dict]) -> Iterator[dict]:
    for conv, parts in groupby(rows, key=lambda r: r["conv"]):
        right, last = END, True
        for r in parts:
            yield {"conv": conv, "number": r["number"], "right": right, "last": last}
            m = r["matrix"]
            right, last = [min(m[4 * s + t] + right[t] for t in range(4)) for s in range(4)], False


def _walks(rows: Iterator[dict]) -> Iterator[dict]:
    """What each state that a cheapest path may enter a fragment in leads to."""
    for r in rows:
        codes, left = r["codes"], r["left"]
        before, after = forward(codes, left), backward(codes, r["right"])
        cost = min(b + a for b, a in zip(before[0], after[0], strict=True))
        entries = [s for s in range(4) if left[s] + after[0][s] == cost]
        audits, exits = zip(*(walk(codes, before, after, cost, s, r["last"]) for s in entries), strict=True)
        yield {"conv": r["conv"], "number": r["number"], "cost": cost, "entries": entries, "exits": exits, "audits": audits}


def _entered(rows: Iterator[dict]) -> Iterator[dict]:
    for conv, parts in groupby(rows, key=lambda r: r["conv"]):
        state = 0
        for r in parts:
            i = r["entries"].index(state)
            yield {"conv": conv, "number": r["number"], "cost": r["cost"], "entry": state, "audit": r["audits"][i]}
            state = r["exits"][i]


def _mend_part(rows: Iterator[dict]) -> Iterator[dict]:
    for r in rows:
        roles, texts = edited(r["audit"], r.pop("entry"), r.pop("codes"), r["roles"], r["texts"])
        yield r | {"roles": roles, "texts": texts}


def _mended(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mended fragments that are whole conversations, and those of all others."""
    cut = saved(fragments(faulty(damage(conversations))), "fragments")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name != "codes") + ", cost bigint, audit string"
    whole = _mapped(cut.filter("whole"), _mend_whole, schema)
    long = cut.filter("not whole")
    in_order = lambda df, *order: df.repartition("conv").sortWithinPartitions("conv", *order)
    costs = _mapped(long.select("conv", "number", "codes"), _matrix, "conv string, number bigint, matrix array<bigint>")
    left = _mapped(in_order(costs, "number"), _lefts, "conv string, number bigint, left array<bigint>")
    right = _mapped(in_order(costs, F.desc("number")), _rights, "conv string, number bigint, right array<bigint>, last boolean")
    place = ["conv", "number"]
    walked = _mapped(long.select(*place, "codes").join(left, place).join(right, place), _walks, "conv string, number bigint, cost bigint, entries array<int>, exits array<int>, audits array<string>")
    chosen = _mapped(in_order(walked, "number"), _entered, "conv string, number bigint, cost bigint, entry int, audit string")
    return whole, _mapped(long.join(chosen, place).select(*cut.columns, "cost", "audit", "entry"), _mend_part, schema)


def repair(conversations: DataFrame) -> DataFrame:
    """Mended conversations in fragments of bounded size: ``conv_id, number, audit, roles, texts, cost`` and what ``FIXED`` names.

    Fragments of a conversation go by ``number``; ``audit`` has their edits, ``roles`` and ``texts`` the
    turns after them, ``cost`` is the conversation's. Nulls of any column count as one blank, but a null turn comes before
    all others; turns of one number go by role and text, and equal rows are repeats (duplicates
    but for the first). A role that is empty or begins with no known initial
    can't be kept. Other columns are ignored; an empty table, or a conversation that loses
    all turns, has no fragment. No task holds more than a fragment: a conversation of any length is spread.
    """
    whole, long = _mended(conversations)
    return whole.unionByName(long)


def _digest(rows: Iterator[dict]) -> Iterator[dict]:
    """Sums of conversations whose fragments come in order, one fragment at a time."""
    for conv, parts in groupby(rows, key=lambda r: r["conv"]):
        out = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        low = high = before = None
        audit, text = [], hashlib.sha256()
        begun = False
        for r in parts:
            for k in out:
                out[k] += r[k]
            out["illegal"] += before is not None and before + r["first"] not in PAIRS
            before = r["initial"]
            if r["low"] is not None:
                out["turns"] -= r["low"] == high
                low, high = r["low"] if low is None else low, r["high"]
            audit.append(r["audit"])
            for role, t in zip(r["roles"], r["texts"], strict=True):
                text.update(f"{chr(10) if begun else ''}{role}:{t}".encode())
                begun = True
        gaps = 0 if low is None else high - low + 1 - out.pop("turns")
        out.pop("turns", None)
        yield {"conv": conv, "gaps": gaps, "cost": r["cost"], "audit": "".join(audit), "repaired_sha256": text.hexdigest()} | out


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def summary(conversations: DataFrame) -> DataFrame:
    """One row for each id of ``conversations``: ``conv_id``, ``COUNTS``, ``audit`` and ``repaired_sha256``.

    Rules are those of ``repair``. An id whose turns are all lost has zeros, an empty audit and
    the hash of an empty text. A hash goes over a whole conversation in order, so the
    fragments of a long one pass one task, one at a time; whole ones are hashed where they are.
    """
    whole, long = _mended(conversations)
    body = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x["roles"], F.lit(":"), x["texts"])), "\n")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("bigint")
    told = whole.select("conv", gaps.alias("gaps"), *COUNTS[1:], "audit", F.sha2(body, 256).alias("repaired_sha256"))
    ordered = long.select("conv", "number", *STATS_NAMES, "cost", "audit", "roles", "texts").repartition("conv").sortWithinPartitions("conv", "number")
    told = told.unionByName(_mapped(ordered, _digest, f"conv string, {', '.join(f'{c} bigint' for c in COUNTS)}, audit string, repaired_sha256 string"))
    ids = conversations.select("conv_id").distinct().withColumn("conv", _key(F.col("conv_id")))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS]
    return ids.join(told, "conv", "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))
