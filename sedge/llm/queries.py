"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm import (
    bpe,
    chat,
    divergence,
    exact_dedup,
    langid,
    licenses,
    packing,
    prefix_trie,
    quality,
    quality_classifier,
    simhash,
    substring,
    suffix_array,
)
from sedge.llm.common import documents, tokenizer_file


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir)).select(
        "doc_id",
        F.array_join("licences", ",").alias("licences"),
        F.array_join("sentence_ids", ",").alias("sentence_ids"),
        F.size("sentence_ids").cast("long").alias("n_known"),
        F.size("unmatched_ids").cast("long").alias("n_unmatched"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality.apply_policy(quality.stored(documents(spark, sf_dir)), quality.BASE, "base_kept")
    ledger = quality.apply_policy(ledger, quality.STANDARD_2, "kept_2")
    return quality.apply_policy(ledger, quality.STANDARD).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "fail_bits",
        (~F.col("base_kept")).alias("base_failed"),
        "kept",
        "kept_2",
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of both versions of the standard policy rejects, and rejects alone, from one ledger."""
    ledger = quality.stored(documents(spark, sf_dir))
    return quality.ablation(ledger, quality.STANDARD).unionByName(quality.ablation(ledger, quality.STANDARD_2))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), partial(tokenizer_file, "word_bpe_49k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))).select("text", "lang"))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir), width=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(
        documents(spark, sf_dir), partial(tokenizer_file, "byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op7_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicated(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.new_index(spark)
    decided = index.ingest(documents(spark, sf_dir), "all")
    index.forget()
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    mask = lambda c: F.array_join(F.transform(c, lambda s: F.when(s["learn"], "1").otherwise("0")), "")
    return chat.format_preferences(chat.pair_neighbours(conversations)).select(
        "pair_id",
        "n_chosen",
        "n_rejected",
        "n_common",
        "prompt",
        "chosen",
        "rejected",
        mask("chosen_segments").alias("chosen_mask"),
        mask("rejected_segments").alias("rejected_mask"),
    )


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.deduplicated(documents(spark, sf_dir))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = labels.where(~quality_classifier.held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    found = quality_classifier.score(docs, quality_classifier.train(docs, known))
    return found.select(
        "doc_id",
        quality_classifier.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv_id = F.col("conv_id").cast("bigint")
    shared = F.crc32(conv_id.cast("string").cast("binary")) % 6
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return prefix_trie.prefix_trie(prefix_trie.paths(conversations, conv_id - conv_id % 100, shared))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_quality_rules": op2_quality_rules,
    "quality_ablation": quality_ablation,
    "op3_packing": op3_packing,
    "op4_language_id": op4_language_id,
    "op5_simhash": op5_simhash,
    "op6_bpe": op6_bpe,
    "op7_substring": op7_substring,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_chat_format": op9_chat_format,
    "op10_suffix_array": op10_suffix_array,
    "op11_quality_classifier": op11_quality_classifier,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_divergence": op13_divergence,
}

def _op1_sql() -> str:
    known = ", ".join(f"'{k}': '{v}'" for k, v in licenses.SENTENCES.items())
    left, found = "array_to_string(list_transform(ids, lambda x: ';' || x || ';'), '')", []
    steps, prior = [], "s"
    for i, (licence, sequence) in enumerate(licenses.RULES):
        pattern = "".join(f";{x};" for x in sequence)
        steps.append(
            f"r{i} AS (SELECT *, CASE WHEN contains(l{i}, '{pattern}') THEN '{licence}' END AS f{i}, "
            f"replace(l{i}, '{pattern}', '||') AS l{i + 1} FROM {prior})"
        )
        prior = f"r{i}"
        found.append(f"f{i}")
    read = (
        "list_filter(list_transform({cut}, lambda x: known[trim(regexp_replace(lower(x), '[^a-z0-9.]+', ' ', 'g'), ' .')]), "
        "lambda x: x IS NOT NULL)"
    )
    lines = r"string_split_regex(regexp_replace(p, '([.!?])[ \t]+', '\1' || chr(10), 'g'), '[\r\n]+')"
    wrapped = r"string_split(regexp_replace(regexp_replace(p, '([.!?])[ \t\r\n]+', '\1' || chr(1), 'g'), ':\r?\n', ':' || chr(1), 'g'), chr(1))"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS (SELECT MAP {{{known}}} AS known), b AS (
  SELECT doc_id, i, {read.format(cut=lines)} AS a, {read.format(cut=wrapped)} AS b
  FROM (SELECT doc_id, unnest(string_split_regex(t, '\r?\n[ \t]*\r?\n')) AS p,
               generate_subscripts(string_split_regex(t, '\r?\n[ \t]*\r?\n'), 1) AS i FROM d), k
), i AS (
  SELECT doc_id, coalesce(flatten(list(CASE WHEN len(b) > len(a) THEN b ELSE a END ORDER BY i)), []) AS ids FROM b GROUP BY doc_id
), s AS (SELECT doc_id, ids, {left} AS l0 FROM i), {", ".join(steps)}
SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([{", ".join(found)}], lambda x: x IS NOT NULL))), ',')
         AS licences, array_to_string(ids, ',') AS sentence_ids, CAST(len(ids) AS BIGINT) AS n_known,
       CAST(len(list_filter(string_split_regex(l{len(licenses.RULES)}, '[;|]+'), lambda x: x <> '')) AS BIGINT)
         AS n_unmatched
FROM {prior}
"""


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), wins AS (
  SELECT doc_id, p, array_to_string(w[p : p + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM w WHERE len(w) >= 5)
), twice AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, p + unnest(range(0, 5)) AS q FROM twice) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{L}'))) AS n_no_letter,
         length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper
  FROM w LEFT JOIN covered c USING (doc_id)
), b AS (
  SELECT *, CAST(
      CASE WHEN n_words < 10 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 3 * n_words THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 10 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 10 * n_no_letter > 3 * n_words THEN 64 ELSE 0 END
    + CASE WHEN 2 * n_upper > word_chars THEN 128 ELSE 0 END AS BIGINT) AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits,
       fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits & 127 = 0 AS kept_2
FROM b
"""


def _ablation_sql() -> str:
    rows = ", ".join(
        f"('standard', {p.version}, {p.mask}, '{r}', {1 << quality.RULE_NAMES.index(r)})"
        for p in (quality.STANDARD, quality.STANDARD_2)
        for r in p.rules
    )
    return f"""
WITH ledger AS ({OP2_SQL}), r(policy, version, mask, rule, bit) AS (VALUES {rows})
SELECT policy, version, count(*) FILTER (fail_bits & mask <> 0) AS n_rejected, rule,
       count(*) FILTER (fail_bits & bit <> 0) AS n_fails, count(*) FILTER (fail_bits & mask = bit) AS n_alone
FROM ledger, r GROUP BY ALL
"""


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), wins AS (
  SELECT doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)
), later AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY g) AS lo FROM wins) WHERE lo < doc_id
), gone AS (
  SELECT doc_id, list(DISTINCT q) AS q FROM (SELECT doc_id, p + unnest(range(0, 50)) AS q FROM later) GROUP BY doc_id
), words AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d
), kept AS (
  SELECT doc_id, string_agg(w[i], ' ' ORDER BY i) AS t
  FROM words LEFT JOIN (SELECT doc_id, unnest(q) AS i, TRUE AS x FROM gone) g USING (doc_id, i)
  WHERE x IS NULL GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(q), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP8_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents
), g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size,
       row_number() OVER (PARTITION BY h ORDER BY doc_id DESC) = 1 AS kept, h AS text_sha256
FROM d JOIN g USING (h)
"""

OP9_SQL = """
WITH t AS (
  SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS chosen,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, role, text,
         '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS shown,
         CASE WHEN role = 'assistant' THEN '1' ELSE '0' END AS learn
  FROM conversations
), p AS (
  SELECT pair_id, count(*) FILTER (chosen) AS n_chosen, count(*) FILTER (NOT chosen) AS n_rejected
  FROM t GROUP BY pair_id
), differ AS (
  SELECT pair_id, min(i) AS i
  FROM (SELECT pair_id, i FROM t GROUP BY pair_id, i, role, text HAVING count(DISTINCT chosen) < 2) GROUP BY pair_id
), n AS (
  SELECT p.*, CASE WHEN differ.i IS NULL THEN n_chosen ELSE differ.i - 1 END AS n_common
  FROM p LEFT JOIN differ USING (pair_id)
)
SELECT n.pair_id, n_chosen, n_rejected, n_common,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (chosen AND i <= n_common), '') AS prompt,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (chosen AND i > n_common), '') AS chosen,
       coalesce(string_agg(shown, '' ORDER BY i) FILTER (NOT chosen AND i > n_common), '') AS rejected,
       coalesce(string_agg(learn, '' ORDER BY i) FILTER (chosen AND i > n_common), '') AS chosen_mask,
       coalesce(string_agg(learn, '' ORDER BY i) FILTER (NOT chosen AND i > n_common), '') AS rejected_mask
FROM n JOIN t USING (pair_id) GROUP BY ALL
"""

OP10_SQL = """
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), wins AS (
  SELECT doc_id, p, md5(substr(x, 2 * p + 1, 400)) AS g
  FROM (SELECT doc_id, x, unnest(range(0, n - 199)) AS p FROM d WHERE n >= 200)
), twice AS (
  SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY g) AS c FROM wins) WHERE c > 1
), runs AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 200 THEN 0 ELSE 1 END AS opens
  FROM twice
), spans AS (
  SELECT doc_id, min(p) AS a, max(p) + 200 AS b
  FROM (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM runs) GROUP BY doc_id, k
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans
), heads AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last,
         string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS head
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN heads USING (doc_id)
"""

#: CRC-32 bit by bit: a number in the list is a byte to take in, -1 a step.
OP12_SQL = """
WITH t AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, turn
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, x) AS i FROM t
), k AS (
  SELECT c, c - c % 100 AS b, xor(4294967295, list_reduce(
           list_prepend(4294967295::BIGINT, flatten(list_transform(range(1, len(s) + 1),
             lambda j: [ascii(s[j])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda crc, v: CASE WHEN v >= 0 THEN xor(crc, v) ELSE xor(crc >> 1, 3988292384 * (crc & 1)) END)) % 6 AS h
  FROM (SELECT DISTINCT c, CAST(c AS VARCHAR) AS s FROM t)
), r AS (
  SELECT k.c, 0 AS own, i, x, text FROM k JOIN n ON n.c = k.b AND i <= h
  UNION ALL SELECT k.c, 1, i, x, text FROM k JOIN n ON n.c = k.c AND i > h
), turns AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, i) AS d, x, length(text) AS chars FROM r
), p AS (
  SELECT c, d, chars, string_agg(x, '') OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS p FROM turns
  UNION ALL SELECT c, 0, 0, '' FROM k
), m AS (
  SELECT *, lag(p) OVER (PARTITION BY c ORDER BY d) AS up, max(d) OVER (PARTITION BY c) AS n FROM p
), nodes AS (
  SELECT p, any_value(d) AS d, any_value(up) AS up, min(c) AS c, count(*) AS n_convs, any_value(chars) AS chars,
         coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = n), '') AS ends
  FROM m GROUP BY p
), kids AS (
  SELECT up AS p, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY up
), sums AS (
  SELECT m.p, count(*) FILTER (kids.n IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.chars) AS saved
  FROM nodes x LEFT JOIN kids USING (p) JOIN m ON m.c = x.c AND m.d <= x.d GROUP BY m.p
)
SELECT x.c AS conv_id, x.d AS depth, y.c AS parent_conv_id, x.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM nodes x LEFT JOIN nodes y ON y.p = x.up LEFT JOIN kids ON kids.p = x.p JOIN sums ON sums.p = x.p
"""

OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
), o AS (
  SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), v AS (
  SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), l AS (
  SELECT lang, count(*) AS kept, sum(n) AS total FROM v GROUP BY lang
), c AS (
  SELECT lang, source, term, count(*) AS n FROM o JOIN v USING (lang, term) GROUP BY lang, source, term
), g AS (
  SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = d.lang AND c.source = d.source), 0) AS total
  FROM d GROUP BY lang, source
), p AS (
  SELECT lang, g.source, term, coalesce(c.n, 0) AS n,
         1 + (1000000000 * (coalesce(c.n, 0) + 5)::HUGEINT) // (g.total + 5 * l.kept) AS p,
         1 + (1000000000 * (v.n + 5)::HUGEINT) // (l.total + 5 * l.kept) AS q
  FROM g JOIN l USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term)
), sums AS (
  SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
         CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM found
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": _op1_sql(),
    "op2_quality_rules": OP2_SQL,
    "quality_ablation": _ablation_sql(),
    "op7_substring": OP7_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op9_chat_format": OP9_SQL,
    "op10_suffix_array": OP10_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_divergence": OP13_SQL,
}
