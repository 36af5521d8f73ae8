"""The registered queries: against SQL where there is some, and the others over whole tables against brute force."""

import hashlib
from collections import defaultdict

import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from compare import assert_same
from conftest import DATA
from sedge.llm import bpe, queries
from sedge.llm.common import documents
from test_packing import check
from test_quality import brute as measure
from test_simhash import brute_components, brute_fingerprint, brute_similar
from test_substring import brute_words


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name])


def texts(spark):
    return [(r.doc_id, r.text) for r in documents(spark, DATA).collect()]


def test_packing(spark):
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*lib.encode(t, add_special_tokens=False).ids, 1] for i, t in texts(spark)}
    rows = queries.op3_packing(spark, DATA)
    assert check(rows.collect(), want, 2048) <= rows.rdd.getNumPartitions()


def test_bpe(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = {i: lib.encode_ordinary(t) for i, t in texts(spark)}
    want = sorted((i, len(ids[i]), sha(",".join(map(str, ids[i])).encode()), sha(t.encode())) for i, t in texts(spark))
    assert sorted(map(tuple, queries.op6_bpe(spark, DATA).collect())) == want


def test_simhash(spark):
    fps = {i: brute_fingerprint(t, 3) for i, t in texts(spark)}
    comp = brute_components(set(fps.values()))
    least = defaultdict(lambda: 1 << 62)
    for i, f in fps.items():
        least[comp[f]] = min(i, least[comp[f]])
    want = sorted((i, f"{f:016x}", least[comp[f]]) for i, f in fps.items())
    assert sorted(map(tuple, queries.op5_simhash(spark, DATA).collect())) == want


def good(t):
    n, chars, symbols, dup_lines, repeats = measure(t)
    lines = sum(bool(x.split()) for x in (t or "").split("\n"))
    bare = sum(not any(c.isalpha() for c in w) for w in (t or "").split())
    upper = sum("A" <= c <= "Z" for c in t or "")
    return not (
        n < 10 or 100 * repeats > 20 * n or 10 * symbols > n or 10 * dup_lines > 3 * lines or chars < 3 * n
        or chars > 10 * n or 10 * bare > 3 * n or 2 * upper > chars
    )


def test_pipeline(spark, tmp_path):
    passage = " ".join(f"shared{i}" for i in range(70))
    rows = [(i, t, "en", "s", len(t)) for i, t in texts(spark)]
    rows += [(1000, rows[1][1].upper().lower(), None, None, 5), (1001, f"first {passage} end", "en", None, None), (1002, f"other {passage}\nlast", "en", "x", 3), (1003, None, None, None, None)]
    columns = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "documents.parquet"))
    left = [(i, t) for i, t, *_ in rows if good(t)]
    groups = defaultdict(list)
    for i, t in left:
        groups[t.encode().lower()].append((i, t))
    left = [max(g) for g in groups.values()]
    least = brute_similar(left)
    left = [(i, t) for i, t in left if least[i] == i]
    digests = {i: d for i, _, _, d in brute_words(left, 50)}
    docs = spark.createDataFrame(rows, columns)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path)).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    final = {r.doc_id: r.text for r in docs.collect()}
    assert {i: hashlib.sha256(b" ".join(t.encode().split())).hexdigest() for i, t in final.items()} == digests
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {i: [*lib.encode(t, add_special_tokens=False).ids, 1] for i, t in final.items()}
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert check(packed.collect(), want, 2048) <= packed.rdd.getNumPartitions()


def test_no_sql_without_a_query():
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and corpus_pipeline.ORACLE_SQL is None


ODD = "doc_id bigint, text string, lang string, source string, n_chars bigint, __id string, __own int, __h int, __n int, __root int, __digest string, __repeats int, __c0 int, __text string, row_number int, fp int"


def test_pipeline_takes_odd_tables(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts, repeated rows, and names that the operators might use."""
    text = " ".join(f"word{i % 97}x{i} runs" for i in range(60))
    more = (None, "x", 1, 2, 3, 4, "d", 5, 6, "t", 7, 8)
    rows = [(i, t, "en", None, 3, *more[1:]) for i, t in ((1, text), (1, text), (None, text.replace("word", "other")), (2, None), (3, ""))]
    rows += [(4, " ".join(f"long{i} tale" for i in range(40_000)), None, "s", None, *more[1:])]
    spark.createDataFrame(rows, ODD).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "odd")).collect()
    assert {r.doc_id for r in got} == {1, None, 4}
    docs = documents(spark, str(tmp_path / "odd"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path / "odd")).columns == docs.columns, name
    spark.createDataFrame([], ODD).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
