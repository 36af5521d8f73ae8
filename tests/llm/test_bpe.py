import hashlib
import random

import public_tokenizers
import tiktoken

from sedge.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def texts():
    random.seed(1)
    out = ["", " ", "  a", " a", "a ", "a  b", "a\n b", "a \n b\n", "\n\n", "don't  we'll", "x" * 5000, "=-" * 3000, "日本語テキスト 漢字", "\x1c\x1d a", "😀😀 👍🏽", "\t\ta b\t c", "ab" * 400]
    out += ["".join(random.choice(" \n\ta b'sé1=日 \x1cß😀zq") for _ in range(random.randint(0, 30))) for _ in range(800)]
    return out + ["".join(random.choice("abcdefghé") for _ in range(random.randint(200, 400))) for _ in range(60)]


def test_like_the_library(spark):
    lib = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    rows = [*enumerate(texts()), (None, None), (0, "again"), (0, "again")]
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id bigint, text string, n_tokens int")
    got = sorted(map(tuple, bpe.round_trip(df, PATH, PATTERN).collect()), key=repr)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = lib.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    assert got == sorted(want, key=repr)
    assert bpe.round_trip(df.limit(0), PATH, PATTERN).count() == 0


def test_long_pieces_like_the_library():
    lib = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})
    own = bpe.BytePairEncoder(bpe.read_ranks(PATH), PATTERN)
    random.seed(6)
    for letters, n in [("ab", 257), ("a", 5000), ("etaoinshrdlu", 4000), ("thequickbrown", 20_000), ("日本語é", 3000)]:
        piece = "".join(random.choice(letters) for _ in range(n))
        assert own.merge_long(piece.encode()) == lib.encode_ordinary(piece)


def test_encode_decode(spark):
    df = spark.createDataFrame(list(enumerate(texts()[:60])), "doc_id bigint, text string")
    back = {r.doc_id: bytes(r.decoded).decode() for r in bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN).collect()}
    assert back == dict(enumerate(texts()[:60]))


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY", 50)
    own = bpe.BytePairEncoder(bpe.read_ranks(PATH), PATTERN)
    for t in texts()[:200]:
        own.encode_texts([t])
        assert len(own.ids) <= 50 or len(own.ids) <= len(set(own.chunks(t)))
