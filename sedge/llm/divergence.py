"""Source divergence audit (operator 13): how far the words of each source are from those of the others of its language.

Tasks count terms as `terms` has it; their counts meet by language and term, terms of too few documents go, and what is
left gives each group (a source of a language) and each language an exact share of every kept term, in parts per 10^9
and never zero. Two sources differ by the sum of the differences of their shares; the terms that tell a source from its
language are those with the largest differences upwards.

Sums over pairs of sources are made for slices of the terms and pairs of blocks of `SOURCES` sources: a task holds a
matrix of some terms by two blocks, so neither the terms of a language nor its sources need fit in one task. A term
that neither block has counts by the shares of an absent term, which are one number for each source.

Defined results: a null text, lang or source counts as ''; a group without terms has the share of an absent term
everywhere; a language without kept terms has pairs of value 0 and no terms; a source alone in its language has no pair;
an empty table gives no row; each row is a document of its own, so repeated rows and equal or null ids need no care;
other columns are not read, so their names do not matter. A very long text is counted whole, in a portion of its own, as
are terms of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm import terms
from sedge.llm.common import ship, written

BILLION = 1_000_000_000
#: Texts and bytes that are counted together, but for single longer texts; counts that a task holds before it hands
#: them on.
MOST_TEXTS, MOST_BYTES, MOST_RUNS = 1 << 16, 1 << 24, 2_000_000
#: Counts of a slice of terms at least, and for each source; sources of a block, and terms of one matrix.
SLICE, SLICE_PER_SOURCE, SOURCES, TERMS = 20_000, 1024, 256, 1024
COUNTS = "lang string, source string, high bigint, low bigint, rest binary, n bigint, texts bigint"
TERM = ["lang", "high", "low", "rest"]


def portions(column: pa.Array) -> Iterator[tuple[int, int]]:
    """First row and row after the last of parts that hold a bounded number of texts and, but for long ones, bytes."""
    sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(column):
        before = sizes[a - 1] if a else 0
        b = min(a + MOST_TEXTS, max(a + 1, int(np.searchsorted(sizes, before + MOST_BYTES, side="right"))))
        yield a, b
        a = b


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number: dict[tuple[str, str], int] = {}
    held: list[terms.Runs] = []

    def handed_on(parts: list[terms.Runs]) -> Iterator[pa.RecordBatch]:
        names = list(number)
        langs, sources = (pa.array([x[i] for x in names], pa.string()) for i in (0, 1))
        for p in parts:
            for a in range(0, len(p.n), 1 << 16):
                s = slice(a, a + (1 << 16))
                of = pa.array(p.group[s])
                yield pa.RecordBatch.from_arrays(
                    [
                        langs.take(of),
                        sources.take(of),
                        pa.array(p.high[s].view(np.int64)),
                        pa.array(p.low[s].view(np.int64)),
                        p.rest[s],
                        pa.array(p.n[s]),
                        pa.array(p.texts[s]),
                    ],
                    names=["lang", "source", "high", "low", "rest", "n", "texts"],
                )

    def gathered() -> Iterator[pa.Table]:
        rows, size = [], 0
        for batch in batches:
            rows.append(batch)
            size += batch.nbytes
            if size >= MOST_BYTES:
                yield pa.Table.from_batches(rows)
                rows, size = [], 0
        if rows:
            yield pa.Table.from_batches(rows)

    for table in gathered():
        table = table.combine_chunks()
        text, lang, source = (
            pa.concat_arrays(table.column(i).chunks) if table.num_rows else pa.array([], pa.string()) for i in range(3)
        )
        for a, b in portions(text):
            keys = list(zip(lang.slice(a, b - a).to_pylist(), source.slice(a, b - a).to_pylist(), strict=True))
            group = np.array([number.setdefault(k, len(number)) for k in keys], dtype=np.int64)
            order = np.argsort(group, kind="stable")
            held += terms.count_terms(text.slice(a, b - a).take(pa.array(order)), group[order])
        if sum(len(p.n) for p in held) > MOST_RUNS:
            held = terms.merged(held)
            if sum(len(p.n) for p in held) > MOST_RUNS // 2:
                yield from handed_on(held)
                held, number = [], {}
    yield from handed_on(terms.merged(held))


def share(n: Column, total: Column, kept: Column, smooth: int) -> Column:
    """1 + floor(10^9 * (n + smooth) / (total + smooth * kept)), exactly; 0 where no term is kept."""
    x, y = n + F.lit(smooth).cast("long"), total + F.lit(smooth).cast("long") * kept
    floor = F.call_function("div", F.lit(BILLION).cast("decimal(10,0)") * x.cast("decimal(19,0)"), y.cast("decimal(19,0)"))
    return F.when(kept > 0, floor.cast("long") + 1).otherwise(F.lit(0).cast("long"))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def _term_text() -> Column:
    """A term's text from its words, less the zero bytes that fill the last."""
    words = F.concat(F.hex("high"), F.when(F.col("low") != 0, F.hex("low")).otherwise(F.lit("")))
    short = F.unhex(F.regexp_replace(words, "(00)+$", ""))
    return F.when(F.length("rest") > 0, F.col("rest")).otherwise(short).cast("string")


def kept_terms(docs: DataFrame, least_docs: int) -> DataFrame:
    """lang, source, term, n and texts (documents of the source with it), and lang_n of the language, for all terms in at
    least so many documents of their language. Both aggregations read the same counts, so these are shuffled once."""
    ship(docs.sparkSession)
    counts = docs.select(_text("text"), _text("lang"), _text("source")).mapInArrow(_counts, COUNTS).repartition(*TERM)
    sums = (F.sum("n").alias("n"), F.sum("texts").alias("texts"))
    langs = counts.groupBy(*TERM, "source").agg(*sums).groupBy(*TERM).agg(*sums).where(F.col("texts") >= least_docs)
    langs = langs.select(*TERM, F.col("n").alias("lang_n")).hint("shuffle_hash")
    found = counts.join(langs, TERM).groupBy(*TERM, "source", "lang_n").agg(*sums)
    return found.select("lang", "source", _term_text().alias("term"), "n", "texts", "lang_n")


def _pair_sums(table: pa.Table) -> pa.Table:
    """For one slice of terms and two blocks: of each pair of sources the summed difference of shares over the terms
    that either block has here, and how many these are. Rows without a term are the sources with their share of an
    absent term."""
    mark = pc.is_null(table["term"])
    sources, rows = table.filter(mark).sort_by("no"), table.filter(pc.invert(mark))
    no = sources["no"].to_numpy()
    absent = sources["p"].to_numpy()
    code = pc.dictionary_encode(rows["term"].combine_chunks())
    code = code.combine_chunks() if isinstance(code, pa.ChunkedArray) else code
    term, seen = code.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(code.dictionary)
    at, p = np.searchsorted(no, rows["no"].to_numpy()), rows["p"].to_numpy()
    order = np.argsort(term, kind="stable")
    term, at, p = term[order], at[order], p[order]
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    left, right = np.flatnonzero(no // SOURCES == i), np.flatnonzero(no // SOURCES == j)
    sums = np.zeros((len(left), len(right)), dtype=np.int64)
    for a in range(0, seen, TERMS):
        lo, hi = np.searchsorted(term, [a, a + TERMS])
        shares = np.tile(absent, (min(TERMS, seen - a), 1))
        shares[term[lo:hi] - a, at[lo:hi]] = p[lo:hi]
        other = shares[:, right]
        for k, x in enumerate(left):
            sums[k] += np.abs(other - shares[:, x : x + 1]).sum(axis=0)
    x, y = (v.ravel() for v in np.meshgrid(left, right, indexing="ij"))
    own = no[x] < no[y]
    x, y, sums = x[own], y[own], sums.ravel()[own]
    names = sources["source"].combine_chunks()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    kept = sources["kept"].to_numpy()
    return pa.table(
        {
            "lang": pa.array([table["lang"][0].as_py()] * len(x), pa.string()),
            "a": names.take(pa.array(x)),
            "b": names.take(pa.array(y)),
            "total": pa.array(sums),
            "seen": pa.array(np.full(len(x), seen)),
            "gap": pa.array(np.abs(absent[x] - absent[y])),
            "kept": pa.array(kept[x]),
        }
    )


def divergence(docs: DataFrame, least_docs: int = 30, smooth: int = 5, top: int = 50) -> DataFrame:
    """lang, source, part, item, value and rank: part 'pair' has the other sources of the language, all of them, and
    part 'term' the `top` terms of which the source has a larger share than its language."""
    kept = written(kept_terms(docs, least_docs), "kept-terms")
    langs = kept.groupBy("lang", "term").agg(F.first("lang_n").alias("n")).groupBy("lang")
    langs = langs.agg(F.count("*").alias("kept"), F.sum("n").alias("lang_total"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("rows"))
    zero = F.lit(0).cast("long")
    groups = (
        docs.select(_text("lang"), _text("source"))
        .distinct()
        .join(sizes, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .fillna(0, ["total", "rows", "kept", "lang_total"])
    )
    of_lang = Window.partitionBy("lang")
    # A slice has far more counts than its blocks have pairs of sources, so sums are few beside what they are made of.
    least, slice_of = F.lit(SLICE), F.count("*").over(of_lang) * SLICE_PER_SOURCE
    groups = written(
        groups.withColumns(
            {
                "no": F.row_number().over(of_lang.orderBy("source")).cast("long") - 1,
                "slices": F.greatest(F.ceil(F.sum("rows").over(of_lang) / F.greatest(least, slice_of)), F.lit(1)).cast("int"),
                "blocks": F.ceil(F.count("*").over(of_lang) / SOURCES).cast("int"),
                "absent": share(zero, F.col("total"), F.col("kept"), smooth),
            }
        ),
        "term-groups",
    )
    shares = (
        kept.join(groups, ["lang", "source"])
        .withColumn("p", share(F.col("n"), F.col("total"), F.col("kept"), smooth))
        .select("lang", "source", "term", "p", "no", "slices", "blocks", "kept", "lang_n", "lang_total")
    )

    everywhere = F.explode(F.sequence(F.lit(0), F.col("slices") - 1))
    own = (F.col("no") / SOURCES).cast("int")
    partners = F.explode(
        F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda x: F.struct(F.least(own, x).alias("i"), F.greatest(own, x).alias("j")),
        )
    ).alias("ij")
    columns = ["lang", "slice", "ij.i", "ij.j", "term", "no", "p", "source", "kept"]
    present = shares.withColumn("slice", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int"))
    present = present.withColumn("source", F.lit(None).cast("string"))
    markers = groups.select("*", everywhere.alias("slice"), F.col("absent").alias("p"), F.lit(None).cast("string").alias("term"))
    cells = present.select("*", partners).select(columns).unionByName(markers.select("*", partners).select(columns))
    sums = cells.groupBy("lang", "slice", "i", "j").applyInArrow(
        _pair_sums, "lang string, a string, b string, total bigint, seen bigint, gap bigint, kept bigint"
    )
    pairs = sums.groupBy("lang", "a", "b").agg(
        (F.sum("total") + (F.max("kept") - F.sum("seen")) * F.max("gap")).alias("value")
    )
    end = lambda x, y: F.struct(F.col(x).alias("source"), F.col(y).alias("item"))
    both = F.explode(F.array(end("a", "b"), end("b", "a"))).alias("ends")
    pairs = pairs.select("lang", both, "value").select("lang", "ends.source", "ends.item", "value")

    told = (
        shares.withColumn("value", F.col("p") - share(F.col("lang_n"), F.col("lang_total"), F.col("kept"), smooth))
        .where(F.col("value") > 0)
        .select("lang", "source", F.col("term").alias("item"), "value")
    )
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = ["lang", "source", "part", "item", "value", "rank"]
    ranked = lambda df, part: df.select("*", F.lit(part).alias("part"), place.alias("rank")).select(out)
    return ranked(pairs, "pair").unionByName(ranked(told, "term").where(F.col("rank") <= top))
