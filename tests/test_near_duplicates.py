"""Removal of redundant sequences against brute force: fragments, copies with edits, families, and what is short."""

import random

import numpy as np

from sedge.operators.redundancy import least_edits, most_edits, representatives


def brute_edits(s, t):
    """The fewest edits that turn s into a part of t."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(s, 1):
        before, row = row, [i]
        for j, b in enumerate(t, 1):
            row.append(min(before[j - 1] + (a != b), before[j] + 1, row[j - 1] + 1))
    return min(row)


def brute(rows, identity=0.9):
    texts = {}
    for i, s in rows:
        texts[s] = max(i, texts.get(s, i))
    own, chosen = {}, []
    for s, i in sorted(texts.items(), key=lambda r: (len(r[0] or ""), r[1]), reverse=True):
        near = (j for t, j in chosen if s and brute_edits(s, t) <= most_edits(len(s), identity))
        own[s] = next(near, i)
        if own[s] == i and s:
            chosen.append((s, i))
    return {i: own[s] if s else i for i, s in rows}


def changed(s, edits):
    s = list(s)
    for _ in range(edits):
        at, kind = random.randrange(len(s) + 1), random.randrange(3)
        s[at : at + (kind < 2)] = random.choice("ACGT") if kind else ""
    return "".join(s)


def acgt(n):
    return "".join(random.choice("ACGT") for _ in range(n))


def test_edits_in_bands():
    random.seed(1)
    pairs, most = [], []
    for _ in range(150):
        t = acgt(random.randint(1, 120)) if random.random() < 0.8 else "ACAC" * random.randint(1, 20)
        a = random.randrange(len(t))
        s = changed(t[a : a + random.randint(1, 80)] + random.choice(["", acgt(4)]), random.randint(0, 9)) or "A"
        s, t = sorted((s, t), key=len)
        pairs.append((s.encode(), t.encode()))
        most.append(random.randint(0, 8))
    want = np.array([brute_edits(s, t) for s, t in pairs])
    got = least_edits(pairs, [min(m, len(s) - 1) for (s, _), m in zip(pairs, most, strict=True)])
    for w, g, m, (s, _) in zip(want, got, most, pairs, strict=True):
        m = min(m, len(s) - 1)
        assert (g == w) if w <= m else (g > m)


def test_fragments_families_and_short_ones(spark):
    random.seed(3)
    texts = ["", None, "A", "ACG", "ACGTACG", "A" * 40, "A" * 90, "ACGTTGCAACG", "ACGTTGCAACC"]
    for n in (12, 35, 60, 120):
        for _ in range(3):
            base = acgt(n)
            texts += [base, base, base[: n // 2], base[n // 4 : n // 2 + 3], base + acgt(8), acgt(5) + base]
            texts += [changed(base, random.randint(1, max(1, n // 8))) for _ in range(4)]
    family = acgt(100)
    texts += [changed(family, random.randint(0, 8)) for _ in range(25)]
    random.shuffle(texts)
    rows = [*enumerate(texts)]
    df = spark.createDataFrame(rows, "id bigint, s string")
    got = {r.id: r.representative for r in representatives(df, "id", "s").collect()}
    assert got == brute(rows)
    assert all(got[r] == r for r in got.values())
    assert representatives(df.limit(0), "id", "s").count() == 0
