r"""Chat formatting by a grammar round trip; DataFrame functions only.

Grammar: ``conversation := "<s>" turn* "</s>"``, and a turn is, by role,

    user        [INST] text [/INST]
    assistant   [OUT] text [/OUT]
    any other   [ROLE] role [:] text [/ROLE]

with one space on each side of role and text. The parser takes turns from left to right, refuses a
body that holds a bare mark, and takes one backslash out of ``[\INST]`` and the like. A turn is
written as it is and parsed; where the source doesn't come back, its marks get a backslash behind
their first character (one more, if they have some), and what that gives is parsed again with the
whole conversation: a difference there raises. No mark has ``[`` or ``<`` inside, so none can begin
in a text and end in the template.

Edge cases: null texts and roles are empty; a null conv_id is one conversation; turns of the same
number are ordered by role and text; repeated rows are repeated turns; an empty table gives an empty
result; further columns are ignored. A conversation is one value, so it must fit into memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, whole

#: Marks, behind their first character.
MARK = r"(?:/?s>|/?INST\]|/?OUT\]|/?ROLE\]|:\])"
BARE = rf"[\[<]{MARK}"
TURN = r"(?s)\[(INST|OUT|ROLE)\] (.*?) \[/\1\]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(rf"([\[<])(\\*{MARK})"), F.lit(r"$1\\$2"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, F.lit(rf"([\[<])\\(\\*{MARK})"), F.lit("$1$2"))


def _turn(role: Column, written_role: Column, body: Column) -> Column:
    """A turn's opening mark, body and closing mark, and whether the body counts for the loss."""
    part = lambda before, after, loss: F.struct(before.alias("before"), body.alias("body"), F.lit(after).alias("after"), F.lit(loss).alias("loss"))
    return (
        F.when(role == "user", part(F.lit("[INST] "), " [/INST]", False))
        .when(role == "assistant", part(F.lit("[OUT] "), " [/OUT]", True))
        .otherwise(part(F.concat(F.lit("[ROLE] "), written_role, F.lit(" [:] ")), " [/ROLE]", False))
    )


def _written(turn: Column) -> Column:
    return F.concat(turn["before"], turn["body"], turn["after"])


def parse(formatted: Column) -> Column:
    """The turns (role, text) in order; null in the place of one whose body holds a bare mark."""

    def turn(kind: Column, body: Column) -> Column:
        named = F.split(body, r" \[:\] ", 2)
        text = F.when(kind == "ROLE", F.get(named, F.lit(1))).otherwise(body)
        role = F.when(kind == "INST", "user").when(kind == "OUT", "assistant").otherwise(F.get(named, F.lit(0)))
        fits = text.isNotNull() & ~text.rlike(BARE) & ~role.rlike(BARE)
        return F.when(fits, F.struct(F.when(kind == "ROLE", unescape(role)).otherwise(role).alias("role"), unescape(text).alias("text")))

    kinds, bodies = (F.regexp_extract_all(formatted, F.lit(TURN), F.lit(g)) for g in (1, 2))
    return F.zip_with(kinds, bodies, turn)


def format_chats(rows: DataFrame) -> DataFrame:
    """conv_id, formatted, turns and parts (before, body, after, loss): a row for each conversation.

    ``turns`` are read back from ``formatted``; the parts put together are the formatted text. Only an
    assistant's mark parses to that role, so the assistant's turns are the text under the loss mask.
    """
    source = rows.select("conv_id", "turn", whole("role").alias("role"), whole("text").alias("text"))
    role, text = F.col("role"), F.col("text")
    plain = _turn(role, role, text)
    comes_back = parse(_written(plain)).eqNullSafe(F.array(F.struct(role, text)))
    turns = source.withColumn("part", F.when(comes_back, plain).otherwise(_turn(role, escape(role), escape(text))))
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "part"))).alias("rows"))
    made = grouped.select(
        "conv_id",
        F.concat(F.lit("<s>"), F.concat_ws("", F.transform("rows", lambda r: _written(r["part"]))), F.lit("</s>")).alias("formatted"),
        F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("said"),
        F.transform("rows", lambda r: r["part"]).alias("parts"),
    ).withColumn("turns", parse(F.col("formatted")))
    same = F.when(F.col("turns").eqNullSafe(F.col("said")), F.col("turns")).otherwise(F.raise_error(F.lit("a formatted conversation doesn't parse to its turns")))
    return made.select("conv_id", "formatted", same.alias("turns"), "parts")


def op2_chat_formatting(spark, sf_dir: str) -> DataFrame:
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    chats = format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))
    loss = F.concat_ws("", F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), written AS (
  SELECT *, regexp_replace(text, '([\[<])(\\*(?:/?s>|/?INST\]|/?OUT\]|/?ROLE\]|:\]))', '\1\\\2', 'g') AS body,
         regexp_replace(role, '([\[<])(\\*(?:/?s>|/?INST\]|/?OUT\]|/?ROLE\]|:\]))', '\1\\\2', 'g') AS name
  FROM turns
), joined AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length(body) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 13 ELSE length(name) + 20 END) + 7 AS chars
  FROM written GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars,
       sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars
FROM joined
"""
