import hashlib
import itertools
import random
import re
import zlib

import pyarrow as pa
import pytest

from peakforge.llm import repair as R


def cheapest_by_search(codes, insert=2):
    """All edit strings with at most two insertions at each place, the cheapest and least of them."""
    best = None
    for edits in itertools.product("KRD", repeat=len(codes)):
        for gaps in itertools.product(range(3), repeat=len(codes) + 1):
            cost, text, made, ok = 0, "", "", True
            for k, gap in enumerate(gaps):
                cost += 2 * gap
                text += "I" * gap
                made += "?" * gap
                if k == len(codes):
                    break
                c, e = codes[k], edits[k]
                text += e
                if e == "D":
                    cost += 3
                elif c == R.GONE or (e == "K" and c.lower() not in "sua"):
                    ok = False
                    break
                else:
                    cost += 2 * (e == "R") + c.isupper()
                    made += c.lower() if e == "K" else "?"
            if not ok:
                continue
            if made:  # wild places take what stands there
                start = 1 if made[0] == "s" else 0
                fits = (len(made) - start) % 2 == 0 and len(made) > start and all(m in ("?", "ua"[j % 2]) for j, m in enumerate(made[start:]))
                if not fits:
                    continue
            if best is None or (cost, text) < best:
                best = cost, text
    return best


def test_cheapest_equals_search():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 4):
        for _ in range(40 if n < 4 else 25):
            codes = "".join(rng.choice("ssuuaaxUAS#") for _ in range(n))
            assert R.cheapest(codes) == cheapest_by_search(codes), codes


def by_strings(codes):
    """The same program with whole strings in place of nodes."""
    best = {R.NOTHING: (0, "")}

    def insert(best):
        for initial in "ua":
            for state, after in R.FOLLOWS[initial].items():
                if state in best:
                    option = best[state][0] + 2, best[state][1] + "I"
                    best[after] = min(best.get(after, option), option)

    insert(best)
    for code in codes:
        made = {}
        for state, (cost, text) in best.items():
            options = [(state, cost + 3, "D")]
            if code != R.GONE:
                t = code.isupper()
                options += [(R.FOLLOWS[i][state], cost + 2 + t, "R") for i in "ua" if state in R.FOLLOWS[i]]
                if state in R.FOLLOWS.get(code.lower(), {}):
                    options.append((R.FOLLOWS[code.lower()][state], cost + t, "K"))
            for after, c, e in options:
                made[after] = min(made.get(after, (c, text + e)), (c, text + e))
        best = made
        insert(best)
    return min(best[s] for s in (R.NOTHING, R.ASSISTANT) if s in best)


@pytest.mark.parametrize("prime", [R.Prefixes.PRIME, 2, 1])
def test_long_conversations_and_collisions(monkeypatch, prime):
    """A hash of one or two values collides all the time; the answer may not change."""
    monkeypatch.setattr(R.Prefixes, "PRIME", prime)
    rng = random.Random(5)
    for n in (50, 300):
        for letters in ("suaxUA#", "xx#", "uu", "aaa", "sS"):
            codes = "".join(rng.choice(letters) for _ in range(n))
            audit = R.Audit(block=37)
            for c in codes:
                audit.feed(c)
            assert audit.result() == by_strings(codes)


def brute(rows):
    """Results by conversation from plain loops."""
    groups = {}
    for conv, turn, role, text in rows:
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
        groups.setdefault(conv, []).extend([(turn, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1))
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, codes, counts = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in own:
            told = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not told else "duplicate" if (role, text) in seen else "truncated" if told[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
            codes += "#" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        cost, edits = by_strings(codes)
        made, left = [], list(own)
        for e in edits:
            turn, role, text = left.pop(0) if e != "I" else (None, "", "")
            if e != "D":
                place = len(made) - (bool(made) and made[0][0][:1] == "s")
                made.append((role if e == "K" else ("user", "assistant")[place % 2], text))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out[conv] = (gaps, *counts.values(), illegal, cost, edits, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())
    return out


SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("audit", pa.int64()), ("copies", pa.string())])


def table(spark, rows):
    return spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, audit long, copies string")


def some_rows(seed, n, convs):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "Why? ", "", None, " \t\n", "Ünï!", "a.\n", "Fine, then"]
    return [(rng.choice([*range(convs), None]), rng.choice([*range(12), None]), rng.choice(["user", "assistant", "system", "tool", "", None]), rng.choice(texts)) for _ in range(n)]


def collected(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("most_rows", [4000, 3])
def test_equals_brute_force(spark, most_rows):
    """Also where nearly every conversation is beyond the buffer and goes through the passes for long ones."""
    rows = some_rows(1, 600, 60)
    assert collected(R.repair(table(spark, rows), most_rows=most_rows)) == brute(rows)


def test_one_long_conversation(spark):
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"text {rng.randrange(300)}{rng.choice(['.', ''])}") for t in range(3000)] + some_rows(2, 50, 9)
    assert collected(R.repair(table(spark, rows), most_rows=100)) == brute(rows)


def test_empty_table_and_lost_rows(spark):
    assert R.repair(table(spark, [])).count() == 0
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = collected(R.repair(table(spark, [(lost, 0, "user", "Hi.")])))
    assert got == {lost: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
