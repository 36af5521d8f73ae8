import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from sedge.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_chunks_give_the_tokenizers_ids():
    own, lib = packing.ChunkTokenizer(PATH), Tokenizer.from_file(PATH)
    random.seed(2)
    texts = ["", " ", "don't we'll 's", "H̱ J̌ É", "ﬁ ² ½ Ⅷ", "x" * 3000, "a.b,c!! ..", "<|endoftext|> hi", "<|startoftext|>", "<|endoftext|>", "a<|endoftext|>b<|startoftext|>'s", "<|ENDOFTEXT|> x", "<|endoftext|", "é<|endoftext|>́", "日本語 テキスト。", "\x1c a\x85b\xa0c"]
    texts += ["".join(random.choice([*" \n\tab's.É1=日,ñ́Z ßΣ<|>", "<|endoftext|>"]) for _ in range(random.randint(0, 40))) for _ in range(800)]
    for t in texts:
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def test_every_letter_beside_a_mark():
    own, lib = packing.ChunkTokenizer(PATH), Tokenizer.from_file(PATH)
    letters = [chr(i) for i in range(0x80, 0x30000) if chr(i).isalpha()]
    for form in ("{},", "({}", '"{}"'):
        texts = [form.format(c) for c in letters]
        want = lib.encode_batch_fast(texts, add_special_tokens=False)
        for t, got, e in zip(texts, own.encode(texts), want, strict=True):
            assert np.frombuffer(got, "<u4").tolist() == e.ids, t
    for t in ("İSTANBUL, ALİ. (DİYARBAKIR) Fİİ!", "ক়, বাড়. (গাঢ়)", "क़लम, सड़क़. पढ़े (ज़) फ़।", "ਸ਼, ਫ਼!", "e\u0301, ŉ. ǰ;"):
        assert np.frombuffer(own.encode([t])[0], "<u4").tolist() == lib.encode(t, add_special_tokens=False).ids


def check(rows, want, capacity):
    """Each id is in one piece, sequences have no gaps, little padding."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(want)
    for d, ids in want.items():
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(ids)
    short = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
        short += at < capacity
    return short


def test_pack(spark):
    random.seed(3)
    lib = Tokenizer.from_file(PATH)
    texts = {i: " ".join(random.choice(["alpha", "beta", "gammaray"]) for _ in range(random.choice([0, 1, 5, 90, 700]))) for i in range(60)}
    texts[60] = None
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id bigint, text string, start string").coalesce(1)
    want = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    assert check(packing.pack(df, PATH, capacity=256, pool_tokens=2000).collect(), want, 256) <= 1
    assert packing.pack(df.limit(0), PATH).count() == 0
    long = spark.createDataFrame([(1, "alpha " * 300_000), (2, "beta")], "doc_id bigint, text string")
    rows = packing.pack(long.coalesce(1), PATH, pool_tokens=5000).collect()
    ids = lib.encode("alpha", add_special_tokens=False).ids
    assert check(rows, {1: [*ids * 300_000, 1], 2: [*lib.encode("beta", add_special_tokens=False).ids, 1]}, 2048) <= 1
    twice = spark.createDataFrame([(None, "a b"), (None, "a b"), (5, "a b")], "doc_id bigint, text string")
    assert sum(r.length for r in packing.pack(twice, PATH).collect()) == 9


def test_costs_are_level():
    random.seed(5)
    lengths = [random.randint(1, 900) for _ in range(400)]
    placed, left = packing.balance(lengths, 2048, True)
    assert not left
    cost = defaultdict(float)
    for _, _, n, k in placed:
        cost[k] += packing.piece_cost(n, 1.0, 1 / 1024)
    full = sorted(cost.values())[1:]
    assert max(full) < 1.6 * min(full)
