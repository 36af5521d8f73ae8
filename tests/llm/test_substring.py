import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from sedge.llm import substring, suffix_array
from sedge.llm.superkmers import super_kmers


def docs():
    random.seed(11)
    words = [f"w{i}" for i in range(30)]
    passage = [random.choice(words) for _ in range(25)]
    out = [None, "", " \n", "one", "a b " * 60]
    for _ in range(40):
        own = [random.choice(words) for _ in range(random.randint(0, 40))]
        cut = random.randint(0, len(own))
        out.append("\n".join([" ".join(own[:cut]), " ".join(passage[random.randint(0, 3) :]), " ".join(own[cut:])]))
    out += [" ".join(random.choice(words) for _ in range(60))] * 6 + ["é" * 40 + " " + "x" * 90] * 2
    rows = [(i, t) for i, t in enumerate(out)]
    return [*rows, (3, out[7]), (7, out[7]), (None, out[8]), (None, "w1 w2"), (100, " ".join(f"u{i}" for i in range(5000)))]


def brute_words(rows, window):
    split = lambda t: (t or "").encode().split()
    order = lambda i: -(2**63) if i is None else i
    lowest = {}
    for i, t in rows:
        w = split(t)
        for j in range(len(w) - window + 1):
            k = tuple(w[j : j + window])
            lowest[k] = min(order(i), lowest.get(k, order(i)))
    out = []
    for i, t in rows:
        w = split(t)
        gone = {x for j in range(len(w) - window + 1) if lowest[tuple(w[j : j + window])] < order(i) for x in range(j, j + window)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def brute_bytes(rows, window):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(r[j : j + window] for _, r in raws for j in range(len(r) - window + 1))
    out = []
    for i, r in raws:
        gone = sorted({x for j in range(len(r) - window + 1) if seen[r[j : j + window]] > 1 for x in range(j, j + window)})
        spans = sum(1 for k, x in enumerate(gone) if k == 0 or gone[k - 1] != x - 1)
        cut = set(gone)
        kept = bytes(b for j, b in enumerate(r) if j not in cut)
        out.append((i, len(r), len(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("crowded", [128, 3])
def test_words(spark, crowded):
    rows = docs()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, ord int")
    got = substring.deduplicated(df, window=10, crowded=crowded).collect()
    assert Counter(map(tuple, got)) == brute_words(rows, 10)


@pytest.mark.parametrize("crowded", [128, 3])
def test_bytes(spark, crowded):
    rows = docs()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id bigint, text string, h int")
    got = suffix_array.deduplicated(df, window=40, crowded=crowded).collect()
    assert Counter(map(tuple, got)) == brute_bytes(rows, 40)


def test_stage_changes_only_what_it_removes(spark):
    rows = docs()
    df = spark.createDataFrame([(t, i, len(t or ""), [1], None) for i, t in rows], "text string, doc_id bigint, n_chars bigint, list array<int>, __c0 string")
    out = substring.without_repeats(df, window=10)
    assert out.columns == df.columns and out.count() == len(rows)
    digest = lambda t: hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest()
    got = Counter((r.doc_id, digest(r.text)) for r in out.collect())
    want = Counter()
    for (i, _, _, d), n in brute_words(rows, 10).items():
        want[(i, d)] += n
    assert got == want
    same = {(r.doc_id, r.text) for r in out.collect()}
    untouched = [(i, n) for (i, n, k, _) in brute_words(rows, 10) if k == 0]
    assert all((i, t) in same for i, t in rows if (i, len((t or "").split())) in untouched and t is None)


def test_many_repeats_of_one_row(spark):
    """Lists of what to remove do not grow with the number of repeats."""
    passage = " ".join(f"w{i}" for i in range(40))
    text, other = f"one {passage} two", f"three {passage} four"
    for n in (3, 3000):
        df = spark.range(n).selectExpr("cast(null as bigint) as doc_id", f"'{text}' as text").unionByName(
            spark.createDataFrame([(7, other), (8, None)], "doc_id bigint, text string")
        )
        for module, window, left in ((substring, 10, 42), (suffix_array, 40, 0)):
            found = module.removals(substring.keyed(df), window, 128).collect()
            assert len(found) == (1 if module is substring else 2) and max(len(r.list) for r in found) < 60
            rows = module.deduplicated(df, window=window).collect()
            assert len(rows) == n + 2
            size = (lambda r: r.n_words) if module is substring else (lambda r: r.n_bytes)
            kept = {r.doc_id: size(r) - r.n_removed for r in rows}
            assert kept[None] == left and kept[7] < 15 and kept[8] == 0


def test_places_of_long_and_short_texts_agree():
    """A window has the same minimiser wherever it stands, also where grams agree in the high bits."""
    rng = np.random.default_rng(5)
    tokens = rng.integers(0, 2, 70_000).astype(np.uint64) << np.uint64(60)
    whole = super_kmers(tokens, 20, 4, 16, True)
    of = np.repeat(whole[0], whole[2])
    for at in (0, 5, 31_000, 69_000):
        part = super_kmers(tokens[at : at + 200], 20, 4, 16, True)
        assert (np.repeat(part[0], part[2]) == of[at : at + 181]).all()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert substring.deduplicated(df).count() == 0 and suffix_array.deduplicated(df).count() == 0
    assert substring.without_repeats(df).count() == 0


def test_super_kmers_cover_all_windows_and_equal_windows_agree():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 4, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for by_place in (False, True):
        minimiser, start, count = super_kmers(tokens, 20, 4, 16, by_place)
        assert start[0] == 0 and (start[1:] == start[:-1] + count[:-1]).all() and count.sum() == 3000 - 19 and count.max() <= 16
        of = np.repeat(minimiser, count)
        groups = defaultdict(set)
        for i in range(3000 - 19):
            groups[tokens[i : i + 20].tobytes()].add(int(of[i]))
        assert all(len(g) == 1 for g in groups.values())


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    for _ in range(20):
        strings = [bytes(rng.integers(97, 99, rng.integers(1, 60)).astype(np.uint8)) for _ in range(rng.integers(1, 8))]
        sizes = np.array([len(s) for s in strings])
        starts = np.cumsum(sizes + 1) - sizes - 1
        text = np.concatenate([np.append(np.frombuffer(s, np.uint8).astype(np.int64) + len(strings), k) for k, s in enumerate(strings)])
        order, rank = suffix_array.suffix_array(text, len(strings))
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())
        shared = suffix_array.common_prefixes(text, order, rank, starts, starts + sizes, 10)
        for p in range(len(text)):
            if rank[p] and p not in starts + sizes:
                a, b, k = text[p:], text[order[rank[p] - 1] :], 0
                while k < 10 and k < len(a) and k < len(b) and a[k] == b[k]:
                    k += 1
                assert shared[p] == k
