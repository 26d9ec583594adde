"""Chat formatting against a brute-force collapse."""

import random
from collections import Counter, defaultdict

from replisift.llm import chat

B, M, A = chat.TEMPLATE


def brute(rows):
    convs = defaultdict(set)
    for c, t, r, x in rows:
        convs[c].add((t if t is not None else float("-inf"), r or "", x or ""))
    seqs = {}
    for c, turns in convs.items():
        places = defaultdict(list)
        for t, r, x in turns:
            places[t].append((r, x))
        seqs[c] = tuple(tuple(sorted(places[t])) for t in sorted(places))
    out = []
    for s in set(seqs.values()):
        if any(len(o) > len(s) and o[: len(s)] == s for o in seqs.values()):
            continue
        same = [c for c in seqs if seqs[c] == s]
        best = min((c for c in same if c is not None), default=None)
        text = "".join(f"{B}{r}{M}{x}{A}" for place in s for r, x in place)
        out.append((best, sum(map(len, s)), len(same), text))
    return Counter(out)


SCHEMA = "conv_id long, turn long, role string, text string, n_turns int, place int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3)


def test_awkward(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (3, 1, "assistant", "yo")]
    rows += [(4, 5, None, None), (None, 0, "user", "null id"), (5, None, "user", "first"), (5, 1, "user", "then"), (6, 0, "a", "x"), (6, 0, "b", "y"), (7, 0, "b", "y"), (7, 0, "a", "x")]
    rows += [(8, 0, "user", "x" * 100000), (9, 0, "use", "rhi"), (10, 0, "user", "")]
    got = Counter(tuple(r) for r in chat.format_chats(frame(spark, rows)).collect())
    assert got == brute(rows)
    assert chat.format_chats(frame(spark, rows).limit(0)).count() == 0


def test_random(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["u", "a"]), rng.choice(["x", "y", ""])) for c in range(300) for t in range(rng.randrange(1, 6))]
    rows += [(1000 + k, t, "u", "hot") for k in range(200) for t in range(k % 5 + 1)]
    assert Counter(tuple(r) for r in chat.format_chats(frame(spark, rows)).collect()) == brute(rows)
