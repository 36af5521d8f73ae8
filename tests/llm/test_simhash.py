import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from sedge.llm import simhash
from sedge.llm.components import components
from sedge.llm.fingerprint import bit_counts, finer_keys, first_keys, shingle_hashes


def brute_fingerprint(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    """fps: {fingerprint}. Smallest reachable fingerprint index by plain search."""
    fps, out = list(fps), {}
    for f in fps:
        if f in out:
            continue
        todo, seen = [f], {f}
        while todo:
            x = todo.pop()
            for y in fps:
                if y not in seen and bin(x ^ y).count("1") <= 3:
                    seen.add(y)
                    todo.append(y)
        for x in seen:
            out[x] = f
    return out


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + width]) for i in range(len(w) - width + 1)} or {b" ".join(w)}


def brute_similar(rows, width=5, similarity=0.8):
    """rows: (doc_id, text), ids distinct. The smallest id of those that each id reaches, over all pairs."""
    sets, least = [(i, shingles(t, width)) for i, t in rows], {i: i for i, _ in rows}
    links = [
        (i, j)
        for n, (i, a) in enumerate(sets)
        for j, b in sets[:n]
        if (both := len(a & b)) >= similarity * (len(a) + len(b) - both)
    ]
    while any(least[i] != least[j] for i, j in links):
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    return least


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_connect_what_is_near(spark):
    random.seed(7)
    fps = set()
    for _ in range(12):
        centre = random.getrandbits(64)
        for _ in range(40):
            x = centre
            for _ in range(random.randint(0, 4)):
                x ^= 1 << random.randrange(64)
            fps.add(x)
    same_half = random.getrandbits(32)
    fps |= {(same_half << 32) | random.getrandbits(32) for _ in range(60)}  # a crowded half without links
    fps |= {(same_half << 32) | (0xABCD0000 ^ (1 << i) ^ (1 << j)) for i in range(12) for j in range(i)}
    want = brute_components(fps)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp bigint")
    for crowded in (4, 20, 10_000):
        roots = {r.node: r.root for r in components(simhash.links(df, crowded)).collect()}
        got = {f: roots.get(signed(f), signed(f)) for f in fps}
        assert len(set(got.values())) == len(set(want.values()))
        assert len({(got[f], want[f]) for f in fps}) == len(set(got.values()))


TEXTS = [None, "", "one", "one two", "Alpha beta gamma delta", "alpha BETA gamma delta", "É x y z", "é x y z", "w " * 3000]


def test_fingerprints_and_ids(spark):
    random.seed(9)
    words = [f"w{i}" for i in range(50)]
    long = [random.choice(words) for _ in range(200)]
    near = [" ".join([*long[:i], "zz", *long[i + 1 :]]) for i in range(0, 200, 25)]
    rows = [*enumerate([*TEXTS, *near]), (3, "one"), (None, "one two"), (None, "only here")]
    df = spark.createDataFrame([(i, t, "h") for i, t in rows], "doc_id bigint, text string, h string")
    fps = {t: brute_fingerprint(t, 3) for _, t in rows}
    comp = brute_components(set(fps.values()))
    least = {}
    for i, t in rows:
        if i is not None:
            c = comp[fps[t]]
            least[c] = min(i, least.get(c, i))
    got = sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df).collect()), key=repr)
    assert got == sorted(((i, fps[t], least.get(comp[fps[t]])) for i, t in rows), key=repr)
    kept = simhash.keep_one(df, 3)
    assert kept.columns == df.columns
    assert kept.count() == len(set(brute_similar([(n, t) for n, (_, t) in enumerate(rows)], 3).values()))


def test_keep_one_of_similar_texts(spark):
    """Groups whose texts are 0.7 to 0.95 similar, one of them larger than the keys of which all pairs are made."""
    random.seed(11)
    rows = []
    for size, changes in [(2, 1), (2, 2), (2, 3), (2, 4), (2, 6), (3, 3), (5, 2), (40, 1), *[(2, 4)] * 20]:
        base = [f"w{random.randrange(5000)}" for _ in range(200)]
        for _ in range(size):
            text = list(base)
            for _ in range(changes):
                text[random.randrange(200)] = f"x{random.randrange(5000)}"
            rows.append((len(rows), " ".join(text)))
    least = brute_similar(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == sorted(set(least.values()))


def changed(words, changes):
    """Other words at so many places, five or more from each other."""
    text, at = list(words), random.sample(range(len(words) // 5), changes)
    for i in at:
        text[5 * i + 2] = f"x{random.randrange(10**9)}"
    return " ".join(text)


def test_keep_one_of_stars(spark):
    """Copies that are 0.8 like their original, and less than that like each other. All share a sample's key with it, as
    but a few of a thousand do: what is tested is that large keys miss none."""
    random.seed(8)
    rows, originals = [], []
    for copies, changes in [(60, 3), (60, 4), (300, 3), (300, 4)]:
        base = [f"w{random.randrange(10**9)}" for _ in range(200)]
        keys = lambda text: set(first_keys(np.unique(shingle_hashes(text, 5)), 0.8))
        texts = [t for t in (changed(base, changes) for _ in range(copies + 9)) if keys(t) & keys(" ".join(base))]
        originals.append(len(rows))
        rows += [" ".join(base), *texts[:copies]]
    df = spark.createDataFrame([*enumerate(rows)], "doc_id bigint, text string")
    assert len(rows) == 724
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == originals


def test_keep_one_of_stars_in_one_key(spark):
    """Several originals with a long passage in common, so that the crowded keys are of several stars."""
    random.seed(5)
    passage, rows = [f"p{random.randrange(10**9)}" for _ in range(150)], []
    for _ in range(6):
        base = [*passage, *(f"w{random.randrange(10**9)}" for _ in range(50))]
        rows += [" ".join(base), *(changed(base, 3) for _ in range(25))]
    rows = [*enumerate(rows)]
    least = brute_similar(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert len(set(least.values())) == 6
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == sorted(set(least.values()))


def short_pairs():
    """150 pairs of each kind: sizes of two texts, the shorter being the start of the longer, or with a word changed."""
    rows = []
    word = lambda: f"w{random.randrange(10**9)}"
    for long, short in [(9, 8), (19, 16), (12, 10), (8, 8), (25, 21), (24, 20), (22, 20), (13, 11), (44, 36), (49, 40)]:
        for _ in range(150):
            base = [word() for _ in range(long)]
            rows += [" ".join(base), " ".join(base[:short])]
    for n in (20, 25, 40, 44, 50):
        for _ in range(100):
            base = [word() for _ in range(n)]
            other = list(base)
            other[random.choice([0, 1, 2, n - 1])] = word()
            rows += [" ".join(base), " ".join(other)]
    return rows


def test_keep_one_of_short_texts(spark):
    """Similarities of 0.6 to 0.9 of short texts: no link is false, and none is lost."""
    random.seed(21)
    rows = [*enumerate(short_pairs())]
    want = [i for i, t in rows if i % 2 == 0 or not similar(t, rows[i - 1][1])]
    assert len(rows) // 2 < len(want) < len(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert sorted(r.doc_id for r in simhash.keep_one(df).collect()) == want


def similar(a, b, width=5):
    a, b = shingles(a, width), shingles(b, width)
    return 10 * len(a & b) >= 8 * len(a | b)


def test_short_sets_always_share_a_key():
    rng = np.random.default_rng(4)
    for n in range(1, 41):
        for _ in range(20):
            a = np.sort(rng.integers(0, 2**63, n, dtype=np.uint64))
            for gone in range(n):
                for new in range(n):
                    if 10 * (n - gone) < 8 * (n + new) or n - gone + new > 40 or min(n, n - gone + new) > 32:
                        continue
                    kept = rng.permutation(a)[gone:]
                    b = np.sort(np.concatenate((kept, rng.integers(0, 2**63, new, dtype=np.uint64))))
                    assert set(first_keys(a, 0.8)) & set(first_keys(b, 0.8))
                    if gone + new:
                        assert set(finer_keys(a, 0.8)) & set(finer_keys(b, 0.8))


def test_crowded_keys_of_a_common_line(spark):
    """Hundreds of short texts that begin with one line, in groups of similar ones: crowded keys, first and finer."""
    random.seed(13)
    line, rows = [f"p{i}" for i in range(9)], []
    for g in range(150):
        base = [*line, *(f"w{random.randrange(10**9)}" for _ in range(random.choice([2, 12, 25, 60])))]
        rows += [" ".join(base), " ".join([*base, "y"]), " ".join([*base[:-1], "x", "z"])]
    rows = [*enumerate(rows)]
    least = brute_similar(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for block in (256, 16):
        found = simhash.similar_texts(df, small=4, block=block)
        groups = {}
        for r in found.collect():
            groups.setdefault(r.root, set()).add(r.doc_id)
        want = {}
        for i, j in least.items():
            want.setdefault(j, set()).add(i)
        assert sorted(map(min, groups.values())) == sorted(want) and len(groups) == len(want)


def test_wide_counts():
    x = np.random.default_rng(3).integers(0, 2**63, (1001, 3), dtype=np.uint64)
    bits = np.unpackbits(x.view(np.uint8).reshape(len(x), -1), axis=1, bitorder="little")
    for n in (1, 2, 3, 64, 1001):
        assert (bit_counts(x[:n]) == bits[:n].sum(0)).all()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(df).count() == 0 and simhash.keep_one(df).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(300)]
    star = [(1000, 1001 + i) for i in range(300)]
    df = spark.createDataFrame([*chain, *star, (5, 5), (None, 3)], "u bigint, v bigint")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, **{1001 + i: 1000 for i in range(300)}}
    assert components(df.where(F.lit(False))).count() == 0
