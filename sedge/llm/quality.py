"""Quality rules (operator 2): a rule bitmask ledger.

evaluate() measures every document once, inside its row and with SQL functions only, and sets one bit per failed rule.
The ledger is stored. Policies are bit masks with a name and a version; applying one, or comparing what each of its rules
alone rejects, reads the ledger and never the texts again.

Defined results: a null text has no words and fails `few_words`; every row is judged by itself, so repeated rows, equal
ids and null ids need no care; other columns of the input are not read, so their names do not matter; an empty table
gives an empty ledger. A very long text is measured whole, within its row.
A window of five words is told from others by a 64-bit hash, within one document only: a text of n words is given a
false repeat with a chance below n * n / 2**65.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.llm.common import WORD, quoted, written

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    name: str
    failed: Column


@dataclass(frozen=True)
class Policy:
    """Which rules reject. A new version is a new mask over the same ledger."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULE_NAMES.index(r) for r in self.rules)


def rules() -> list[Rule]:
    n = F.col("n_words")
    return [
        Rule("few_words", n < 10),
        Rule("repeated_words", 100 * F.col("n_repeat_words") > 20 * n),
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 3 * F.col("n_lines")),
        Rule("short_words", F.col("word_chars") < 3 * n),
        Rule("long_words", F.col("word_chars") > 10 * n),
        Rule("words_without_letters", 10 * F.col("n_no_letter") > 3 * n),
        Rule("upper_case", 2 * F.col("n_upper") > F.col("word_chars")),
    ]


#: Bit i of fail_bits is rule i. Rules are only ever added at the end, so that old ledgers keep their meaning.
RULE_NAMES = (
    "few_words",
    "repeated_words",
    "symbols",
    "repeated_lines",
    "short_words",
    "long_words",
    "words_without_letters",
    "upper_case",
)
BASE = Policy("base", 1, RULE_NAMES[:2])
STANDARD = Policy("standard", 1, RULE_NAMES)
#: Without the rule on upper case, which also rejects scripts of notices.
STANDARD_2 = Policy("standard", 2, RULE_NAMES[:7])
#: The version of the rules themselves, noted in every ledger.
RULE_SET = 1


def _measured(docs: DataFrame) -> DataFrame:
    """doc_id and the measurements. Each step is a projection that reads the arrays of the one before it."""
    text = F.col("t")
    step = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("t"))
    step = step.select(
        "doc_id",
        F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace(text, r"[^A-Z]+", "")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D\p{L}]++(?![^\x20\x09-\x0D])")).cast("long").alias("n_no_letter"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias("lines"),
    )
    measures = ["word_chars", "n_symbols", "n_upper", "n_no_letter"]
    step = step.select(
        "doc_id",
        *measures,
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    measures += ["n_words", "n_lines", "n_dup_lines"]
    at = lambda i, k: F.get(F.col("h"), i + k)
    step = step.select(
        "doc_id",
        *measures,
        F.when(
            F.col("n_words") >= WINDOW,
            F.transform(
                F.sequence(F.lit(0), F.size("h") - WINDOW), lambda i: F.xxhash64(*(at(i, k) for k in range(WINDOW)))
            ),
        ).alias("win"),
    )
    # Few documents have a window twice; only theirs are sorted, with their places, to find which.
    pairs = F.zip_with(
        "win", F.sequence(F.lit(0), F.size("win") - 1), lambda x, p: F.struct(x.alias("h"), p.alias("p"))
    )
    step = step.select(
        "doc_id",
        *measures,
        F.when(F.size(F.array_distinct("win")) < F.size("win"), F.sort_array(pairs)).alias("s"),
    )
    twin = lambda x, i: F.get(F.col("s"), i)["h"].eqNullSafe(x["h"])
    places = F.transform(
        F.filter("s", lambda x, i: twin(x, i - 1) | twin(x, i + 1)), lambda x: x["p"].cast("long")
    )
    step = step.select("doc_id", *measures, F.sort_array(places).alias("places"))
    covered = F.aggregate(
        "places",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda a, p: F.struct(
            (a["n"] + p + WINDOW - F.greatest(p, a["end"])).alias("n"), (p + WINDOW).alias("end")
        ),
        lambda a: a["n"],
    )
    return step.select(
        "doc_id", *measures, F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words")
    )


def evaluate(docs: DataFrame) -> DataFrame:
    """The ledger: doc_id, the measurements and fail_bits, one row for each row of docs."""
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules()):
        bits = bits.bitwiseOR(F.when(rule.failed, F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return _measured(docs).withColumn("fail_bits", bits)


def stored(docs: DataFrame, path: str | None = None) -> DataFrame:
    """evaluate(), written as Parquet (to path, or to the shared folder) with the version of the rules, and read again."""
    ledger = evaluate(docs).withColumn("rule_set", F.lit(RULE_SET))
    if path is None:
        return written(ledger, "quality-ledger")
    ledger.write.mode("overwrite").parquet(path)
    return ledger.sparkSession.read.parquet(path)


def apply_policy(ledger: DataFrame, policy: Policy, kept: str = "kept") -> DataFrame:
    return ledger.withColumn(kept, F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) == 0)


def ablation(ledger: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: how many documents fail it, fail it alone (they would stay without it), and how many
    the policy rejects. One pass counts the ledger by fail_bits, of which there are at most 2 ** rules."""
    seen = ledger.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(
        F.count(F.lit(1)).alias("n")
    )
    out = [F.sum(F.when(F.col("bits") != 0, F.col("n")).otherwise(0)).alias("n_rejected")]
    for r in policy.rules:
        bit = 1 << RULE_NAMES.index(r)
        out.append(F.sum(F.when(F.col("bits").bitwiseAND(F.lit(bit).cast("long")) != 0, F.col("n")).otherwise(0)).alias(f"{r}__fails"))
        out.append(F.sum(F.when(F.col("bits") == bit, F.col("n")).otherwise(0)).alias(f"{r}__alone"))
    wide = seen.agg(*out)
    each = F.array(
        *(
            F.struct(F.lit(r).alias("rule"), F.col(f"{r}__fails").alias("n_fails"), F.col(f"{r}__alone").alias("n_alone"))
            for r in policy.rules
        )
    )
    return wide.select(F.lit(policy.name).alias("policy"), F.lit(policy.version).alias("version"), "n_rejected", F.inline(each))


def quality_filter(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The rows of docs that the policy keeps, with their columns. The rules are evaluated beside the row, which travels
    where the id does, so nothing is joined."""
    row = F.struct(*quoted(docs.columns))
    ledger = apply_policy(evaluate(docs.select(row.alias("doc_id"), F.col("text"))), policy)
    # A row number keeps the condition above the measurements: pushed below them, it would hold all of them again.
    numbered = ledger.withColumn("row_number", F.monotonically_increasing_id())
    return numbered.where(F.col("kept") & (F.col("row_number") >= 0)).select("doc_id.*")
