"""Chat formatting of typed content parts, in DataFrame functions only.

A conversation becomes one string: ``<|turn|>role``, a line feed, the flattened parts, ``<|end|>`` and
a line feed per turn. A visitor maps each part by its kind: text stays, images, audio and documents
become ordered placeholders ``<|image:3|>`` whose references and expanded sizes are listed beside the
string. Control strings inside texts and roles are escaped: ``N`` backslashes after their first
character become ``N + 1``, which reading back undoes; nothing else in a text changes. Neighbouring text
parts are escaped as one, since a control string may reach over their border.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, END = "<|turn|>", "<|end|>"
LEARNED_ROLE = "assistant"
MEDIA = ("image", "audio", "document")
PART = "struct<kind:string,text:string,ref:string,units:long>"
# tokens that one unit of a part expands to: an image tile, a second of audio, a page
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 600}
# what follows the first character of a control string
_REST = r"(\|[a-z_]+(?::[0-9]+)?\|>|/?s>|/?SYS>>|</?SYS>>|/?INST\])"
_BARE = r"([<\[])(\\*)" + _REST
_ESCAPED = r"([<\[])\\(\\*)" + _REST


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _BARE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    """A role on one line: a percent sign, line feed or carriage return becomes its code."""
    coded = F.coalesce(role, F.lit(""))
    for c, code in (("%", "%25"), ("\n", "%0A"), ("\r", "%0D")):
        coded = F.replace(coded, F.lit(c), F.lit(code))
    return escape(coded)


def unescape_role(coded: Column) -> Column:
    role = unescape(coded)
    for c, code in (("\r", "%0D"), ("\n", "%0A"), ("%", "%25")):
        role = F.replace(role, F.lit(code), F.lit(c))
    return role


def text_part(text: Column) -> Column:
    """A message of one text part; NULL is empty."""
    part = F.struct(
        F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
        F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"),
    )
    return F.array(part)


def _visit(state: Column, part: Column) -> Column:
    """Adds a part: ``done`` is escaped, ``open`` the text since the last placeholder, ``n`` the next number."""
    media = F.coalesce(part.kind.isin(*MEDIA), F.lit(False))
    shown = F.concat(F.lit("<|"), part.kind, F.lit(":"), state.n.cast("string"), F.lit("|>"))
    return F.struct(
        F.when(media, F.concat(state.done, escape(state.open), shown)).otherwise(state.done).alias("done"),
        F.when(media, F.lit("")).otherwise(F.concat(state.open, F.coalesce(part.text, F.lit("")))).alias("open"),
        (state.n + media.cast("int")).alias("n"),
    )


def _expanded(part: Column) -> Column:
    """Tokens a part stands for: words of a text, units of the others (one if not known)."""
    size = F.size(F.filter(F.split(F.coalesce(part.text, F.lit("")), r"\s+"), lambda w: w != "")).cast("long")
    for kind, tokens in TOKENS_PER_UNIT.items():
        size = F.when(part.kind == kind, tokens * F.coalesce(part.units, F.lit(1).cast("long"))).otherwise(size)
    return size


def format_turns(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts") -> DataFrame:
    """(conv, formatted, loss_turns, attachments, n_tokens) per conversation.

    ``parts`` is an array of (kind, text, ref, units). ``loss_turns`` has the places of the turns under
    the loss mask (those of the assistant); ``attachments`` lists number, kind, reference, turn place and
    expanded tokens in order. Rows go by turn (NULL first), then role and content, so ties have one
    order; repeated rows are turns of their own. NULL roles, parts and texts are empty; unknown kinds
    are texts; NULL conversations are one conversation; an empty table gives no rows. Other columns
    are neither read nor returned.
    """
    empty = F.expr(f"CAST(array() AS array<{PART}>)")
    rows = messages.select(
        F.col(conv).alias("conv"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(role, F.lit("")).alias("role"),
            F.coalesce(F.col(parts).cast(f"array<{PART}>"), empty).alias("parts"),
        ).alias("m"),
    )
    talks = rows.groupBy("conv").agg(F.array_sort(F.collect_list("m")).alias("turns"))
    numbered = talks.withColumn(
        "media",
        F.flatten(
            F.transform(
                "turns",
                lambda t, k: F.transform(
                    F.filter(t.parts, lambda p: p.kind.isin(*MEDIA)), lambda p: F.struct(k.alias("turn"), p.alias("part"))
                ),
            )
        ),
    )

    def flat(t: Column, k: Column) -> Column:
        before = F.when(F.size("media") == 0, F.lit(0)).otherwise(F.size(F.filter("media", lambda m: m.turn < k)))
        start = F.struct(F.lit("").alias("done"), F.lit("").alias("open"), before.alias("n"))
        body = F.aggregate(t.parts, start, _visit, lambda state: F.concat(state.done, escape(state.open)))
        return F.concat(F.lit(TURN), escape_role(t.role), F.lit("\n"), body, F.lit(END + "\n"))

    attachments = F.transform(
        "media",
        lambda m, n: F.struct(
            n.alias("number"), m.part.kind.alias("kind"), m.part.ref.alias("ref"), m.turn.alias("turn"), _expanded(m.part).alias("tokens")
        ),
    )
    tokens = F.aggregate(
        F.flatten(F.transform("turns", lambda t: t.parts)), F.lit(0).cast("long"), lambda acc, p: acc + _expanded(p)
    )
    loss = F.filter(F.transform("turns", lambda t, k: F.when(t.role == LEARNED_ROLE, k)), lambda k: k.isNotNull())
    return numbered.select(
        F.col("conv").alias(conv),
        F.array_join(F.transform("turns", flat), "").alias("formatted"),
        loss.alias("loss_turns"),
        attachments.alias("attachments"),
        tokens.alias("n_tokens"),
    )


def read_back(formatted: DataFrame, column: str = "formatted", loss: str = "loss_turns") -> DataFrame:
    """The input with ``turns`` (role, text) parsed from the string, and ``loss_texts`` in order.

    Placeholders stay in the texts as they are.
    """
    body = F.transform(
        F.slice(F.split(column, r"<\|turn\|>"), 2, 1 << 30),
        lambda s: F.regexp_extract(s, r"(?s)^([^\n]*\n.*)<\|end\|>\n$", 1),
    )
    turns = F.transform(
        "body",
        lambda s: F.struct(
            unescape_role(F.substring_index(s, "\n", 1)).alias("role"),
            unescape(F.substr(s, F.instr(s, F.lit("\n")) + 1)).alias("text"),
        ),
    )
    parsed = formatted.withColumn("body", body).withColumn("turns", turns)
    masked = F.transform(loss, lambda k: F.get("turns", k).text)
    return parsed.withColumn("loss_texts", masked).drop("body")


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Digest columns of conversations, read back from their strings."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    learned = F.array_join("loss_texts", "")
    return read_back(formatted).select(
        F.col(conv),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "n_tokens",
    )
