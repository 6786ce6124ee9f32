"""Repair of conversations against a search over all edits, and the lattice against a plain shortest path."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from fathomline.llm import repair

GRAMMAR = re.compile(r"(s?(ua)+)?")


def cheapest(codes):
    """(cost, audit) by dynamic programming over prefixes, the least text among the cheapest in every state."""
    def closed(best):
        for _ in range(4):
            for q, (cost, audit) in list(best.items()):
                to = 3 if q == 2 else 2
                best[to] = min(best.get(to, (9**9, "")), (cost + 2, audit + "I"))
        return best

    best = closed({0: (0, "")})
    for code in codes:
        new = {}
        for q, (cost, audit) in best.items():
            moves = [(q, 3, "D")]
            if code & 12 != repair.LOST:
                extra = code & 12 == repair.CUT
                moves.append((3 if q == 2 else 2, 2 + extra, "R"))
                said = "sua"[code & 3] if code & 3 < 3 else ""
                if said in repair.STEPS[q]:
                    moves.append((repair.STEPS[q][said], extra, "K"))
            for to, more, edit in moves:
                new[to] = min(new.get(to, (9**9, "")), (cost + more, audit + edit))
        best = closed(new)
    return min(best[q] for q in (0, 3) if q in best)


def every(codes):
    """(cost, audit) from all sequences of edits with at most two insertions at each place."""
    found = []
    places = [["", "I", "II"]] * (len(codes) + 1)
    for edits in itertools.product("DKR", repeat=len(codes)):
        if any(e != "D" and c & 12 == repair.LOST for e, c in zip(edits, codes)):
            continue
        for inserts in itertools.product(*places):
            audit = "".join(i + e for i, e in zip(inserts, (*edits, "")))
            roles = [[]]
            rows = iter(codes)
            cost = 0
            for e in audit:
                code = next(rows) if e != "I" else None
                cost += {"D": 3, "K": 0, "R": 2, "I": 2}[e] + (e in "KR" and code & 12 == repair.CUT)
                if e == "K":
                    roles = [r + ["sua?"[code & 3]] for r in roles]
                elif e in "RI":
                    roles = [r + [x] for r in roles for x in "ua"]
            if any(GRAMMAR.fullmatch("".join(r)) for r in roles):
                found.append((cost, audit))
    return min(found)


def test_all_edits():
    r = random.Random(1)
    for n in range(4):
        for _ in range(25):
            codes = bytes(r.randrange(12) for _ in range(n))
            assert repair.solve(codes) == every(codes) == cheapest(codes)


def test_long_conversations():
    r = random.Random(2)
    for n in (15, 16, 17, 32, 33, 100, 399):
        for _ in range(20):
            codes = bytes(r.choice((r.randrange(12), 1 + k % 2)) for k in range(n))
            assert repair.solve(codes) == cheapest(codes)
    assert repair.solve(bytes([1]) * 4000) == cheapest(bytes([1]) * 4000)


def audit(rows):
    """The row of the contract for one conversation's damaged rows (turn, role, text), already in order."""
    seen, codes, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        core = text.rstrip(repair.SPACES)
        k = 0 if not core else 1 if (role, text) in seen else 2 if core[-1] not in ".!?" else 3
        seen.add((role, text))
        if k < 3:
            counts[k] += 1
        codes.append((8, 8, 4, 0)[k] + ("sua".index(role[:1]) if role[:1] and role[:1] in "sua" else 3))
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, edits = cheapest(codes)
    out, said, left = [], 0, iter(rows)
    for e in edits:
        role, text = (None, "") if e == "I" else next(left)[1:]
        if e == "D":
            continue
        if e in "RI":
            role = "assistant" if said == 2 else "user"
        said = repair.STEPS[said][role[0]]
        out.append(f"{role}:{text}")
    return gaps, *counts, illegal, cost, edits, hashlib.sha256("\n".join(out).encode()).hexdigest()


def order(row):
    turn, role, text = row
    return turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if f == 1:
            text = ""
        if f == 2:
            text = re.sub("[.!?]", "", text)
        if f == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
    return out


def expected(ids, rows):
    by = {i: [] for i in ids}
    for conv, *row in rows:
        by[conv].append(tuple(row))
    return sorted(((i, *audit(sorted(own, key=order))) for i, own in by.items()), key=str)


def conversations():
    r = random.Random(7)
    rows = []
    for conv in [None, *range(1, 80)]:
        for turn in range(r.randrange(1, 9)):
            role = r.choice(("user", "assistant")) if r.random() < 0.2 else ("system", "user", "assistant")[turn if turn < 2 else 2 - turn % 2 if turn else 0]
            text = r.choice(("Yes.", "no", " \t\n", "", "Really?!  ", "漢字。", "ends so . ", "same text.", f"text {r.randrange(9)}."))
            rows.append((conv, turn if r.random() < 0.9 else r.choice((None, turn + 3)), role, text))
    rows += [(900, t, ("user", "assistant")[t % 2], f"turn {t}{'.' * (t % 5 > 0)}") for t in range(300)]
    rows += [(901, None, None, None), (901, 1, "tool", "x."), (901, 1, "", "y."), (901, 1, "user", "z."), (902, 5, "user", "twice."), (902, 5, "user", "twice.")]
    rows += [(903 + k, 0, "user", f"only one row {k}.") for k in range(40)]
    return rows


def test_digest(spark):
    rows = conversations()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"kind": F.lit("x"), "f": F.lit(3)}).repartition(4)
    ids = {c for c, *_ in rows}
    found = repair.repair_digest(repair.damaged(turns), turns)
    assert sorted((tuple(x) for x in found.collect()), key=str) == expected(ids, damage(rows))
    plain = [(c, t, " " if o is None else o, " " if x is None else x) for c, t, o, x in rows]
    assert sorted((tuple(x) for x in repair.repair_digest(turns).collect()), key=str) == expected(ids, plain)
    assert len(ids) > len({c for c, *_ in damage(rows)})
    assert repair.repair_digest(turns.limit(0)).count() == 0


def test_repaired_rows(spark):
    turns = spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string")
    rows = sorted(repair.repair_conversations(turns).collect(), key=lambda r: (str(r["conv_id"]), r["place"]))
    audits = {r["conv_id"]: r["audit"] for r in repair.audit_conversations(turns).collect()}
    for conv, own in itertools.groupby(rows, key=lambda r: r["conv_id"]):
        own = list(own)
        assert "".join(r["edit"] for r in own) == audits[conv]
        assert GRAMMAR.fullmatch("".join(r["role"][:1] for r in own if r["edit"] != "D"))
