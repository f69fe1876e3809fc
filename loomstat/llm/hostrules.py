"""Quality rules per document and per host, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstat.plans.limits import broadcast_if_small
from loomstat.plans.scratch import freeze

MIN_WORDS = 50
# percent of words inside repeated three-word windows
MAX_REPEATED = 50
# document rules that count against a host
MAX_SYMBOLS_PER_WORD = 0.1
MAX_DUPLICATE_LINES = 0.3
WORD_CHARS = (2.0, 12.0)
# a host whose shrunken failure rate is above this loses all its documents
MAX_HOST_RATE = 0.5
# strength of the prior, in documents, when the hosts' rates do not vary, and its bounds
DEFAULT_STRENGTH = 10.0
STRENGTH_BOUNDS = (1.0, 1000.0)
_BLANK = "[ \\t\\n\\u000B\\f\\r]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _BLANK), lambda w: w != "")


def measures(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """(key, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of whole texts.

    Three-word windows that occur again are found by sorting the windows of a text, which is bounded by
    the text itself; a text without repeated windows skips that.
    """
    base = docs.select(F.col(key).alias("key"), F.col(host).alias("host"), F.coalesce(text, F.lit("")).alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda s: F.translate(s, " \t\n\x0b\f\r", "") != "")
    split = base.select("key", "host", _words(F.col("text")).alias("w"), lines.alias("lines"), F.col("text"))
    # the window at place i; words hold no blanks, so joining by a blank keeps windows apart
    triples = F.when(
        F.size("w") >= 3,
        F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.concat_ws(" ", F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))),
    ).otherwise(F.array().cast("array<string>"))
    counted = split.select(
        "key",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(F.translate("text", " \t\n\x0b\f\r", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - F.char_length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        triples.alias("t"),
    )
    placed = counted.withColumn(
        "sorted",
        F.when(
            F.size("t") > F.size(F.array_distinct("t")),
            F.array_sort(F.transform("t", lambda s, i: F.struct(s.alias("s"), i.alias("i")))),
        ),
    )
    last = F.size("sorted") - 1
    # places of windows whose neighbour in order is the same window
    twice = F.filter(
        F.transform(
            F.sequence(F.lit(0), last),
            lambda j: F.when(
                ((j > 0) & (F.get("sorted", F.greatest(j - 1, F.lit(0))).s == F.get("sorted", j).s))
                | ((j < last) & (F.get("sorted", j + 1).s == F.get("sorted", j).s)),
                F.get("sorted", j).i,
            ),
        ),
        lambda i: i.isNotNull(),
    )
    marked = placed.withColumn("p", F.when(F.col("sorted").isNotNull(), F.array_sort(twice))).drop("t")
    # words covered by windows at sorted places: up to three each, fewer before the next window
    covered = F.aggregate(
        "p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at")),
        lambda acc, i: F.struct((acc.n + F.least(F.lit(3), i - acc.at)).alias("n"), i.alias("at")),
        lambda acc: acc.n,
    )
    return marked.select(
        "key", "host", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words")
    )


def host_rates(measured: DataFrame) -> DataFrame:
    """(host, n, failures, rate, shrunken): failure rates drawn to the mean of all hosts.

    The beta prior is fitted to the hosts' rates by moments: their weighted mean, and the strength
    at which a beta law has their variance beyond that of counting.
    """
    hosts = measured.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("failures")
    )
    hosts = hosts.withColumn("rate", F.col("failures") / F.col("n"))
    moments = hosts.agg(
        (F.sum("failures") / F.sum("n")).alias("mean"),
        F.avg("rate").alias("plain"),
        F.coalesce(F.var_pop("rate"), F.lit(0.0)).alias("spread"),
        F.avg(F.lit(1.0) / F.col("n")).alias("per_doc"),
    )
    binomial = F.col("plain") * (1 - F.col("plain"))
    between = F.col("spread") - binomial * F.col("per_doc")
    strength = F.when(between > 1e-9, binomial / between - 1).otherwise(F.lit(DEFAULT_STRENGTH))
    prior = moments.select(
        "mean", F.greatest(F.lit(STRENGTH_BOUNDS[0]), F.least(F.lit(STRENGTH_BOUNDS[1]), strength)).alias("strength")
    )
    # the prior is one aggregated row
    return hosts.join(F.broadcast(prior)).select(
        "host", "n", "failures", "rate",
        ((F.col("failures") + F.col("mean") * F.col("strength")) / (F.col("n") + F.col("strength"))).alias("shrunken"),
    )


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host_rate).

    A row for every row of ``docs``. Document rules: ``base_failed`` (few words, or many of them in
    repeated windows), many symbols or duplicate lines, odd word lengths. The share of a host's documents
    that fail any rule is shrunk by a beta prior from all hosts; a document is kept if it passes the
    base rules and its host's shrunken rate is at most ``MAX_HOST_RATE``. NULL and empty texts have no
    words and fail; a NULL host is a host of its own. Repeated rows count and are returned each. An
    empty table gives no rows. Other columns are neither read nor returned.
    """
    measured = measures(docs, key, text, host)
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    length = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    failed = (
        base_failed
        | (F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * F.col("n_words"))
        | (F.col("n_dup_lines") > MAX_DUPLICATE_LINES * F.col("n_lines"))
        | ~length.between(*WORD_CHARS)
    )
    # measured once, then read for the hosts and for the documents
    measured = freeze(measured.withColumn("base_failed", base_failed).withColumn("failed", failed))
    hosts = broadcast_if_small(host_rates(measured).select(F.col("host").alias("named"), "shrunken"))
    joined = measured.join(hosts, F.col("host").eqNullSafe(F.col("named")), "left")
    return joined.select(
        F.col("key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("shrunken") <= MAX_HOST_RATE)).alias("kept"),
        F.round("shrunken", 6).alias("host_rate"),
    )
