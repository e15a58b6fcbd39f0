import hashlib
import itertools
import random
import re
import zlib

import pytest

from moleweave.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, times string"
SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text, *_ in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * {0: 0, 3: 2}.get(fate, 1)
    return out


def all_edits(turns, most):
    """Every list of edits with at most ``most`` inserted turns in a row: cost, audit, repaired turns."""
    def inserts():
        for n in range(most + 1):
            yield from itertools.product(("user", "assistant"), repeat=n)

    def onward(i):
        for added in inserts():
            lead = (2 * len(added), "I" * len(added), [(r, "") for r in added])
            if i == len(turns):
                yield lead
                continue
            role, text, goes, short = turns[i]
            ways = [(3, "D", [])]
            if not goes:
                ways += [(short, "K", [(role, text)])] + [(2 + short, "R", [(r, text)]) for r in ("user", "assistant")]
            for (c, a, kept), (c2, a2, rest) in itertools.product(ways, list(onward(i + 1))):
                yield lead[0] + c + c2, lead[1] + a + a2, lead[2] + kept + rest

    return onward(0)


def plain(rows, search):
    """``search(turns)`` gives (cost, audit, repaired turns)."""
    after = damaged(rows)
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in after if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, turns, count = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, role, text in own:
            fault = "blank" if not text.strip(SPACES) else "duplicate" if (role, text) in seen else "" if text.rstrip(SPACES)[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                count[fault] += 1
            turns.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        numbers = [r[1] for r in own if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit, kept = search(turns)
        out[conv] = (gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


def by_brute_force(turns):
    legal = re.compile("(s?(ua)+)?")
    fits = (e for e in all_edits(turns, 1) if all(r for r, _ in e[2]) and legal.fullmatch("".join(r[0] for r, _ in e[2])))
    return min(fits, key=lambda e: (e[0], e[1]))


def by_table(turns):
    """Turn by turn, the least (cost, audit) of each last initial."""
    best = {"": (0, "", ())}
    for k in range(len(turns) + 1):
        for _ in range(3):
            for st, (c, a, said) in list(best.items()):
                role = "assistant" if st == "u" else "user"
                new = (c + 2, a + "I", (*said, (role, "")))
                if role[0] not in best or new[:2] < best[role[0]][:2]:
                    best[role[0]] = new
        if k == len(turns):
            break
        role, text, goes, short = turns[k]
        after = {}
        for st, (c, a, said) in best.items():
            edits = [(c + 3, a + "D", said, st)]
            if not goes:
                if st + role[:1] in ("s", "u", "su", "ua", "au") and role:
                    edits.append((c + short, a + "K", (*said, (role, text)), role[0]))
                other = "assistant" if st == "u" else "user"
                edits.append((c + 2 + short, a + "R", (*said, (other, text)), other[0]))
            for e in edits:
                if e[3] not in after or e[:2] < after[e[3]][:2]:
                    after[e[3]] = e[:3]
        best = after
    return min((best[s] for s in ("", "a") if s in best), key=lambda e: e[:2])


def got(spark, rows):
    return {r.conv_id: tuple(r)[1:] for r in C.repaired(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}


def random_rows(rng, convs, longest, texts=("Hi.", "Hi", "", " \t", "What? ", "No!\n", "word", None)):
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", None, "unknown"]
    rows = []
    for c in range(convs):
        for turn in range(rng.randint(1, longest)):
            rows.append((c or None, rng.choice([turn] * 8 + [None, turn + 3, 1]), rng.choice(roles), rng.choice(texts), "clash"))
    return rows + rows[:5]


def test_against_all_edits(spark):
    rng = random.Random(1)
    rows = random_rows(rng, 60, 3)
    expected = plain(rows, lambda t: by_brute_force(t) if len(t) <= 4 else by_table(t))
    assert got(spark, rows) == expected
    assert all(by_table(t)[:2] == by_brute_force(t)[:2] for t in [[(rng.choice(["user", "assistant", "system", "x"]), str(k), rng.random() < 0.2, rng.random() < 0.3) for k in range(rng.randint(0, 4))] for _ in range(80)])


@pytest.mark.parametrize("run", [3, 1024])
def test_long_conversations_in_runs(spark, monkeypatch, run):
    """Conversations over several ranges and runs give what a table of the whole gives; a hot one and one of copies too."""
    monkeypatch.setattr(C, "RUN", run)
    rng = random.Random(2)
    rows = random_rows(rng, 40, 12, texts=[*(f"t{k}{s}" for k in range(30) for s in ".?!-"), "", None])
    rows += [(5, k, rng.choice(["user", "assistant", "system"]), f"{k % 90}{rng.choice('.?!-')}", "") for k in range(700)]
    rows += [(77, 3, "user", "Same.", "")] * 300 + [(77, 4, "assistant", "Yes.", "")] * 2
    assert got(spark, rows) == plain(rows, by_table)


def test_nothing_left_and_empty(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(spark, [(conv, 0, "user", "Hi.", "")]) == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert got(spark, []) == {}
    far = [(1, -(1 << 63), "user", "Hi.", ""), (1, (1 << 63) - 1, "assistant", "Yes. " + "x" * 100_000, "")]
    assert got(spark, far)[1][0] == (1 << 63) - 1
