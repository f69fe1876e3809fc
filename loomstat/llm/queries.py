"""The thirteen operators over their whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstat.llm import chat, decontam, divergence, hostrules, langid, lm, merkle, neighbours, pieces, quality, rollup, simhash, suffixdedup
from loomstat.llm.text import fold
from loomstat.plans.scratch import freeze, work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return register


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query("op1_language_id")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = langid.learn(docs, fold(F.col("doc_id"), 5) != 0)
    found = langid.identify(docs, model)
    return found.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


_OP2_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


@_query(
    "op2_decontamination",
    f"""WITH d AS (SELECT doc_id, {_OP2_WORDS} AS w FROM documents),
     b AS (SELECT item_id, w, least(13, len(w)) AS m FROM (SELECT item_id, {_OP2_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
     bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS g
            FROM (SELECT item_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
     sizes AS (SELECT DISTINCT m FROM b),
     dw AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
            FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
     hits AS (SELECT doc_id, dw.m, i, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.m = bw.m),
     words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
               FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, m, i FROM hits)) GROUP BY doc_id),
     items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
               FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
     SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
     FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.find_contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.drop("cleaned")


@_query(
    "op3_host_rules",
    r"""WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
     w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l FROM t),
     g AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g
           FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
     p AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
     r AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM p) GROUP BY doc_id),
     m AS (SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(l) AS n_lines,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
           FROM w LEFT JOIN r USING (doc_id)),
     b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
     f AS (SELECT *, base_failed OR n_symbols > 0.1 * n_words OR n_dup_lines > 0.3 * n_lines
             OR NOT (word_chars / greatest(n_words, 1) BETWEEN 2 AND 12) AS failed FROM b),
     h AS (SELECT source, count(*) AS n, sum(failed::INT) AS x, sum(failed::INT) / count(*) AS rate FROM f GROUP BY source),
     o AS (SELECT sum(x) / sum(n) AS mean, avg(rate) * (1 - avg(rate)) AS bin, coalesce(var_pop(rate), 0) - avg(rate) * (1 - avg(rate)) * avg(1.0::DOUBLE / n) AS between_hosts FROM h),
     s AS (SELECT mean, greatest(1, least(1000, CASE WHEN between_hosts > 1e-9 THEN bin / between_hosts - 1 ELSE 10 END)) AS k FROM o),
     v AS (SELECT source, (x + mean * k) / (n + k) AS shrunken FROM h, s)
     SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND shrunken <= 0.5 AS kept, round(shrunken, 6) AS host_rate
     FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source""",
)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return hostrules.judge(_table(spark, folder, "documents"))


@_query("op4_lm_scores")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    scored = lm.score_texts(docs, fold(F.col("doc_id"), 7) != 2)
    return scored.select(
        "doc_id", (fold(F.col("doc_id"), 7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


_MARKED = "</s>[INST] ok [/INST]"
_ESCAPE_SQL = r"regexp_replace({}, '([<\[])(\\*)(\|[a-z_]+(?::[0-9]+)?\|>|/?s>|/?SYS>>|</?SYS>>|/?INST\])', '\1\\\2\3', 'g')"


@_query(
    "op5_chat_format",
    f"""WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
       UNION ALL VALUES (-1, 0, 'user', '{_MARKED}'), (-1, 1, 'assistant', '{_MARKED}'))
     SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(17 + length({_ESCAPE_SQL.format("role")}) + length({_ESCAPE_SQL.format("text")})) AS BIGINT) AS formatted_chars,
       CAST(sum(len(regexp_extract_all(text, '\\S+'))) AS BIGINT) AS n_tokens
     FROM m GROUP BY conv_id""",
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    marked = spark.sql(
        "SELECT -1L AS conv_id, id AS turn, IF(id = 0, 'user', 'assistant') AS role, :text AS text FROM range(2)", args={"text": _MARKED}
    )
    messages = rows.union(marked).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    return chat.digests(chat.format_turns(messages))


@_query("op6_suffix_dedup")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return suffixdedup.remove_repeats(_table(spark, folder, "documents"), passage=suffixdedup.PASSAGE)


@_query("op7_token_counts")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """All documents come in; then those labelled toxic are taken out; both batches are sent twice."""
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    inserts = freeze(rollup.count_tokens(docs, rollup.public_ranks(spark)))
    toxic = labels.filter("toxic = 1").select(F.col("doc_id").alias("of")).distinct()
    removed = rollup.deletes(inserts.join(toxic, F.col("key") == F.col("of"), "left_semi"))
    ledger = rollup.Ledger(spark, work_path(spark, "token-counts"))
    for _ in range(2):
        ledger.commit("documents", inserts)
        ledger.commit("toxic", removed)
    return ledger.totals()


@_query("op8_simhash")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


@_query("op9_quality")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    model = quality.learn(docs, _table(spark, folder, "labels"), fold(F.col("doc_id"), 3) != 1)
    return quality.score(docs, model).select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


@_query("op10_pieces")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    vocabulary = pieces.Vocabulary.load(pieces.vocabulary_path(spark))
    coded = pieces.encode(_table(spark, folder, "documents"), vocabulary)
    ids = F.array_join(F.col("piece_ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id", F.size("piece_ids").cast("long").alias("n_pieces"), "n_bytes", "exact", F.sha2(ids, 256).alias("pieces_sha256")
    )


def _framed(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || {value}, '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_framed(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# the CRC-32 register after the key's digits, bit by bit; the checksum is its complement
_CRC_SQL = """list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
       lambda c: list_transform(range(8), lambda b: (ascii(c) >> b) & 1)))), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1)))"""


@_query(
    "op11_merkle_manifest",
    f"""WITH RECURSIVE d AS (SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
         CASE WHEN {_CRC_SQL} & 1 = 1 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS shown,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n FROM documents),
     up(source, lvl, idx, n, hash) AS (SELECT source, 0, idx, n, leaf FROM d
       UNION ALL SELECT source, lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY source, lvl, idx // 3, n),
     subs AS (SELECT source, lvl AS h, hash, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, count(*) OVER () AS m FROM up WHERE n = 1),
     top(lvl, idx, n, hash) AS (SELECT 0, r, m, hash FROM subs
       UNION ALL SELECT lvl + 1, idx // 3, (n + 2) // 3, sha256(string_agg(hash, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY lvl, idx // 3, n),
     below AS (SELECT doc_id, u.lvl AS step, u.idx, u.hash, d.idx // CAST(pow(3, u.lvl) AS BIGINT) AS own FROM d JOIN up u
         ON u.source IS NOT DISTINCT FROM d.source AND u.n > 1 AND u.idx // 3 = d.idx // CAST(pow(3, u.lvl + 1) AS BIGINT)),
     above AS (SELECT source, s.h + t.lvl AS step, t.idx, t.hash, s.r // CAST(pow(3, t.lvl) AS BIGINT) AS own FROM subs s JOIN top t
         ON t.n > 1 AND t.idx // 3 = s.r // CAST(pow(3, t.lvl + 1) AS BIGINT)),
     path AS (SELECT doc_id, step, coalesce(string_agg(hash, '' ORDER BY idx) FILTER (idx < own), '') AS before,
         coalesce(string_agg(hash, '' ORDER BY idx) FILTER (idx > own), '') AS after
       FROM (SELECT * FROM below UNION ALL SELECT doc_id, step, a.idx, hash, own FROM above a JOIN d ON a.source IS NOT DISTINCT FROM d.source)
       GROUP BY doc_id, step),
     proof AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY step)) AS digest FROM path GROUP BY doc_id),
     fold(doc_id, step, acc) AS (SELECT doc_id, 0, shown FROM d
       UNION ALL SELECT doc_id, step + 1, sha256(before || acc || after) FROM fold JOIN path USING (doc_id, step)),
     folded AS (SELECT doc_id, arg_max(acc, step) AS folded_root FROM fold GROUP BY doc_id),
     root AS (SELECT hash AS root FROM top WHERE n = 1)
     SELECT d.doc_id, leaf, s.hash AS subroot, root, coalesce(digest, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
     FROM d JOIN subs s ON s.source IS NOT DISTINCT FROM d.source JOIN folded USING (doc_id) LEFT JOIN proof USING (doc_id), root""",
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.audit(_table(spark, folder, "documents"))


@_query(
    "op12_source_divergence",
    r"""WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
     t AS (SELECT row_id, lang, source, unnest(w) AS term FROM d),
     k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT row_id) >= 3),
     l AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
     g AS (SELECT DISTINCT lang, source FROM d),
     o AS (SELECT lang, source, term, count(*) AS c FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
     gn AS (SELECT lang, source, sum(c) AS n FROM o GROUP BY lang, source),
     p AS (SELECT g.lang, g.source, k.term, coalesce(o.c, 0) AS c,
         1 + (1000000000 * CAST(coalesce(o.c, 0) + 1 AS HUGEINT)) // CAST(coalesce(gn.n, 0) + l.v AS HUGEINT) AS p,
         1 + (1000000000 * CAST(k.c + 1 AS HUGEINT)) // CAST(l.n + l.v AS HUGEINT) AS q
       FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN gn ON gn.lang = g.lang AND gn.source = g.source
       LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
     sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
       FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
     pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
       FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
     every AS (SELECT * FROM pairs UNION ALL
       SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q)
     SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
     FROM every QUALIFY part = 'pair' OR rank <= 200""",
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(_table(spark, folder, "documents"))


@_query("op13_nearest_vectors")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    return neighbours.nearest(vectors, F.col("vec_id") % 100 == 0)
