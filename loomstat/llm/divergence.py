"""Divergence of the sources of a language over its kept terms, found by iceberg prefix refinement.

A term is kept if it stands in at least ``min_docs`` documents of its language. No document count is taken of
terms as such at first: byte prefixes are extended level by level (8, 16, 32, ... bytes), and a prefix that too few distinct documents
hold is discarded with all its extensions, until complete terms remain, whose documents are counted exactly. One pass over
the texts writes, per task, how many documents hold each prefix and term; a document is in one task, so these
numbers add up. The levels then read that table alone, and only rows below surviving prefixes are shuffled.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomstat.llm.text import texts
from loomstat.plans.limits import broadcast_if_small
from loomstat.plans.scratch import freeze, work_path

MIN_DOCS = 3
# smoothed shares are whole numbers of this unit
UNIT = 1_000_000_000
# ranks of terms that are returned; all ranks of pairs are
TOP_TERMS = 200
# bytes of the shortest prefix; each further level is twice as long
FIRST_LEVEL = 8
# terms and prefixes that a task holds before it passes its counts on
HELD = 500_000
# terms, and sources to each side, whose shares are compared in one block
BLOCK_TERMS = 4096
BLOCK_SOURCES = 64
# A-Z to a-z; other letters and bytes beyond ASCII stay, the rest parts terms
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_COUNTS = "level int, via int, lang string, source string, term binary, n long, docs long"
# level of complete terms, and of the rows that only name a group
_TERM, _GROUP = 0, -1


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, A-Z in lower case."""
    return text.translate(LETTERS).split()


def level_below(size: int) -> int:
    """Length of the longest proper prefix of a term of ``size`` bytes that is a level, or 0."""
    level = FIRST_LEVEL
    while 2 * level < size:
        level *= 2
    return level if level < size else 0


# a term's occurrences and documents share one number
_DOC = 1 << 40


def _partial_counts(most: int):
    """Batches (lang, source, text) to counts of groups, of terms by group and of prefixes by language."""
    schema = pa.schema(
        [("level", pa.int32()), ("via", pa.int32()), ("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())]
    )

    def rows(level, via, lang, source, names, both):
        k = len(names)
        both = np.fromiter(both, np.int64, k)
        columns = [pa.repeat(pa.scalar(level, pa.int32()), k), pa.array(via, pa.int32()), pa.repeat(lang, k), pa.repeat(source, k)]
        columns += [pa.array(names, pa.binary()), pa.array(both % _DOC), pa.array(both // _DOC)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def run(frames):
        below = [level_below(k) for k in range(256)]
        counted: dict[tuple, Counter] = defaultdict(Counter)
        prefixes: dict[tuple, Counter] = defaultdict(Counter)

        def out():
            for (lang, source), held in counted.items():
                via = np.fromiter((below[len(t)] if len(t) < 256 else level_below(len(t)) for t in held), np.int32, len(held))
                yield rows(_TERM, via, lang, source, list(held), held.values())
                yield rows(_GROUP, [0], lang, source, [b""], [0])
            for (lang, level), held in prefixes.items():
                via = np.full(len(held), level // 2 if level > FIRST_LEVEL else 0, np.int32)
                yield rows(level, via, lang, "", list(held), (n * _DOC for n in held.values()))
            counted.clear()
            prefixes.clear()

        size = 0
        for batch in frames:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                words = terms(text)
                held = counted[lang, source]
                size -= len(held)
                held.update(words)
                distinct = set(words)
                for word in distinct:
                    held[word] += _DOC
                size += len(held)
                level = FIRST_LEVEL
                while longer := [w for w in distinct if len(w) > level]:
                    held = prefixes[lang, level]
                    size -= len(held)
                    held.update({w[:level] for w in longer})
                    size += len(held)
                    distinct = longer
                    level *= 2
                if size > most:
                    yield from out()
                    size = 0
        yield from out()

    return run


def partial_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The written table of per-task counts that the levels read."""
    named = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    return _written(named.mapInArrow(_partial_counts(HELD), _COUNTS), "term-counts")


def _written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder; many short rows take a fraction of a checkpoint's room there."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _below(rows: DataFrame, survivors: DataFrame) -> DataFrame:
    """Rows whose next shorter prefix survived."""
    kept = survivors.select(F.col("lang").alias("__lang"), F.col("level").alias("__level"), F.col("term").alias("__prefix"))
    same = (F.col("lang") == F.col("__lang")) & (F.col("via") == F.col("__level")) & (F.expr("substring(term, 1, via)") == F.col("__prefix"))
    return rows.join(broadcast_if_small(kept), same, "left_semi")


def refine(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, docs) of the complete terms whose prefixes all survive, still per task."""
    found = {r["level"] for r in counts.select("level").distinct().collect()}
    # the empty prefix of the shortest terms and of the first level survives in any case
    survivors = counts.filter(F.col("level") == _GROUP).select("lang", F.lit(0).alias("level"), "term").distinct()
    for level in sorted(x for x in found if x >= FIRST_LEVEL):
        rows = counts.filter(F.col("level") == level)
        if level > FIRST_LEVEL:
            rows = _below(rows, survivors.filter(F.col("level") == level // 2))
        held = rows.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
        survivors = survivors.union(freeze(held.select("lang", F.lit(level).alias("level"), "term")))
    return _below(counts.filter(F.col("level") == _TERM), survivors).select("lang", "source", "term", "n", "docs")


def kept_counts(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of kept terms; ``first`` is true for one source of each term of a language.

    The rows are dealt by language and term once, which serves the sums by source and those by language.
    """
    by_term = Window.partitionBy("lang", "term")
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = refine(counts, min_docs).repartition(parts, "lang", "term")
    grouped = dealt.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    summed = grouped.withColumns(
        {"lang_n": F.sum("n").over(by_term), "all_docs": F.sum("docs").over(by_term), "first": F.row_number().over(by_term.orderBy("source")) == 1}
    )
    return summed.filter(F.col("all_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", "first")


def _share(count: str, total: str) -> F.Column:
    """1 + floor(UNIT * (count + 1) / (total + kept)), exact beyond 64 bits."""
    return F.expr(f"1 + (CAST({count} + 1 AS DECIMAL(27, 0)) * CAST({UNIT} AS DECIMAL(10, 0))) div CAST({total} + kept AS DECIMAL(20, 0))")


def _compare(sources: int):
    """Sums of the divergence over one block of terms, for each ordered pair of sources of two blocks.

    Rows without a term state a source's share of terms that it lacks and the number of kept terms of the block.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        lang, left, right = key[0].as_py(), key[2].as_py(), key[3].as_py()
        place, share = (np.asarray(table.column(c)).astype(np.int64) for c in ("place", "share"))
        absent = np.asarray(table.column("term").is_null())
        names = dict(zip(place[absent].tolist(), table.filter(pa.array(absent)).column("source").to_pylist(), strict=True))
        order = sorted(names)
        row_of = {p: k for k, p in enumerate(order)}
        floor = np.zeros(len(order), np.int64)
        floor[[row_of[p] for p in place[absent].tolist()]] = share[absent]
        kept = int(np.asarray(table.column("kept"))[absent][0])
        encoded = table.column("term").combine_chunks().filter(pa.array(~absent)).dictionary_encode()
        seen = len(encoded.dictionary)
        grid = np.repeat(floor[:, None], seen, axis=1)
        grid[[row_of[p] for p in place[~absent].tolist()], np.asarray(encoded.indices)] = share[~absent]
        side = np.array(order) // sources
        out = ([], [], [])
        for g, p in enumerate(order):
            others = np.flatnonzero(side == (right if side[g] == left else left)) if left != right else np.arange(len(order))
            others = others[others != g]
            apart = grid[g] - grid[others]
            apart *= apart
            apart //= grid[others]
            rest = (floor[g] - floor[others]) ** 2 // floor[others] * (kept - seen)
            for o, value in zip(others.tolist(), (apart.sum(axis=1) + rest).tolist(), strict=True):
                out[0].append(names[p])
                out[1].append(names[order[o]])
                out[2].append(value)
        return pa.table({"lang": pa.array([lang] * len(out[0]), pa.string()), "source": pa.array(out[0], pa.string()), "item": pa.array(out[1], pa.string()), "value": pa.array(out[2], pa.int64())})

    return run


def audit(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS
) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source's terms are from other sources and from its language.

    With count the occurrences of a kept term in a group (a source's texts of a language, or all of a language), N their
    sum and V the number of kept terms, a share is p = 1 + floor(10^9 (count + 1) / (N + V)), and the divergence of p from q is
    floor((p - q)^2 / q), all in whole numbers. Part ``pair`` sums it over all kept terms for each other source of the language; part
    ``term`` has the terms that the source holds more often than its language, up to rank ``top_terms``. Equal values are ranked by
    the item's bytes. NULL text, language and source read as ''. Documents are rows: equal rows, also of one key, are
    documents of their own. An empty table gives no rows; other columns are neither read nor returned.
    """
    counts = partial_counts(docs, text, lang, source)
    held = _written(kept_counts(counts, min_docs), "kept-terms")
    one_each = held.filter("first")
    of_lang = one_each.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("kept"))
    of_group = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter(F.col("level") == _GROUP).select("lang", "source").distinct()
    groups = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "lang_total", "kept"])
    groups = groups.withColumn("blocks", F.greatest(F.lit(1), F.expr(f"(kept + {BLOCK_TERMS - 1}) div {BLOCK_TERMS}")))
    by_lang = Window.partitionBy("lang")
    groups = freeze(
        groups.withColumns({"place": F.row_number().over(by_lang.orderBy("source")) - 1, "sides": F.expr(f"(count(1) OVER (PARTITION BY lang) + {BLOCK_SOURCES - 1}) div {BLOCK_SOURCES}")})
    )
    constants = broadcast_if_small(groups)
    shares = held.join(constants, ["lang", "source"]).withColumns({"share": _share("n", "total"), "lang_share": _share("lang_n", "lang_total")})

    bucket = F.pmod(F.xxhash64("term"), F.col("blocks"))
    sizes = one_each.join(broadcast_if_small(groups.select("lang", "blocks").distinct()), "lang")
    sizes = sizes.groupBy("lang", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("size"))
    absent = groups.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    absent = absent.join(sizes, ["lang", "bucket"], "left").select(
        "lang", "bucket", "sides", "source", "place", F.lit(None).cast("binary").alias("term"),
        F.when(F.col("kept") == 0, 1).otherwise(_share("0", "total")).alias("share"), F.coalesce("size", F.lit(0)).alias("kept"),
    )
    present = shares.select("lang", bucket.alias("bucket"), "sides", "source", "place", "term", "share", "kept")
    own = F.expr(f"place div {BLOCK_SOURCES}")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1))
    cells = present.unionByName(absent).withColumn("other", other).withColumns({"a": F.least("other", own), "b": F.greatest("other", own)})
    # only what a block needs is shuffled
    cells = cells.select("lang", "bucket", "a", "b", F.when(F.col("term").isNull(), F.col("source")).alias("source"), "place", "term", "share", F.when(F.col("term").isNull(), F.col("kept")).alias("kept"))
    sums = cells.groupBy("lang", "bucket", "a", "b").applyInArrow(_compare(BLOCK_SOURCES), "lang string, source string, item string, value long")
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair"))
    above = shares.filter("share > lang_share").select(
        "lang", "source", F.col("term").cast("string").alias("item"),
        F.expr("((share - lang_share) * (share - lang_share)) div lang_share").alias("value"),
    )
    terms_part = above.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top_terms).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms_part).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
