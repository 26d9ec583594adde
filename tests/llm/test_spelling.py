"""Spelling variants against brute force, planted words, awkward rows."""

import random

import pytest

from replisift.llm import spelling as S

ABC = "abcdefgé"


def brute(counts, times=10):
    words = {w: n for w, n in counts.items() if w is not None and n >= 2}
    letters, out = sorted({c for w in words for c in w}), {}
    for w, n in words.items():
        near = {w[:k] + w[k + 1 :] for k in range(len(w))} | {w[:k] + c + w[k + 1 :] for k in range(len(w)) for c in letters} | {w[:k] + c + w[k:] for k in range(len(w) + 1) for c in letters}
        near = sorted((x for x in near if x in words and x != w), key=lambda x: (-words[x], x))
        form = near[0] if near and words[near[0]] >= times * n else None
        out[w] = (form, n, len(near), words[form] if form else None)

    def root(w):
        while out[w][0] is not None:
            w = out[w][0]
        return w

    return {(w, form, root(w), n, near, m) for w, (form, n, near, m) in out.items()}


def table(spark, counts):
    rows = [(w, "x", 1) for w, n in counts.items() for _ in range(n)]
    return spark.createDataFrame(rows, "word string, key string, n int").repartition(4)


@pytest.mark.parametrize("seed", range(2))
def test_groups_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(ABC) for _ in range(rng.randrange(1, 5))) for _ in range(40)] + ["aaaa", "aaa", "abab"]
    counts = {}
    for stem in stems:
        counts[stem] = rng.choice([1, 2, 3, 30, 300])
        for _ in range(6):
            k, c = rng.randrange(len(stem)), rng.choice(ABC)
            counts[rng.choice([stem[:k] + stem[k + 1 :], stem[:k] + c + stem[k:], stem[:k] + c + stem[k + 1 :]])] = rng.choice([1, 2, 20, 200])
    counts[None] = 5
    got = {tuple(r) for r in S.spelling_groups(table(spark, counts)).collect()}
    assert got == brute(counts)


def test_chains_ties_and_long_words(spark):
    long = "".join(random.Random(3).choice(ABC) for _ in range(3000))
    at = S.PLAIN_KEY
    edge = long[: at + 1]
    counts = {
        "chain": 2, "chains": 20, "chainse": 200, "chainsea": 2000,  # each leads to the next
        "tie": 2, "tia": 20, "tib": 20,  # the first in code-point order
        "zéro": 30, "zero": 2, "\U0001d400xyz": 2, "￮xyz": 30,
        long: 2, long[:-1]: 20, long[:1500] + "*" + long[1501:]: 30, long + "a": 2,
        edge: 2, edge[1:]: 30, edge[:-1] + "z": 25, edge[2:]: 2,
    }
    counts = {w: n for w, n in counts.items() if "*" not in w}
    got = {tuple(r) for r in S.spelling_groups(table(spark, counts)).collect()}
    assert got == brute(counts)
    assert ("chain", "chains", "chainsea", 2, 1, 20) in got and ("tie", "tia", "tia", 2, 2, 20) in got


def test_fingerprints_tell_the_same_groups_as_texts():
    rng = random.Random(5)
    for _ in range(300):
        w = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 12)))
        v = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 12)))
        plain, marked = [S.group_keys(x) for x in (w, v)], [S.group_keys(x, plain=0) for x in (w, v)]
        for a in range(2):
            for b in range(2):
                assert set(plain[0][a]) & set(plain[1][b]) == set() or a == b
                assert len(set(plain[0][a]) & set(plain[1][b])) == len(set(marked[0][a]) & set(marked[1][b]))
        assert (plain[1][2] in plain[0][1]) == (marked[1][2] in marked[0][1])


def test_words_of_texts(spark):
    rows = [(1, "Straße ÄPFELBAUM äpfelbaum x2abcdefg naïveté-ABCDEFG"), (None, None), (2, ""), (3, "×÷ÿÿÿÿÿÿÿ")]
    df = spark.createDataFrame([(i, t, "w") for i, t in rows], "doc_id long, text string, word string")
    words = sorted(r.word for r in S.typed_words(df).collect())
    assert words == sorted(["ÄpfelbaumX"[:-1].replace("pfelbaum", "pfelbaum"), "äpfelbaum", "abcdefg", "naïveté", "abcdefg", "×÷ÿÿÿÿÿÿÿ"])
    none = S.spelling_groups(df.where("false").select("word"))
    assert none.count() == 0 and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    with pytest.raises(ValueError):
        S.spelling_groups(df.select("word"), times=1)


def test_roots_beside_words(spark):
    groups = S.spelling_groups(table(spark, {"wordly": 2, "wordy": 40, "other": 3}))
    rows = spark.createDataFrame([(1, "wordly"), (2, "other"), (3, None), (4, "unseen"), (4, "wordly")], "k int, word string")
    assert sorted((r.k, r.root or "") for r in S.normalise(rows, groups).collect()) == [(1, "wordy"), (2, "other"), (3, ""), (4, "unseen"), (4, "wordy")]
