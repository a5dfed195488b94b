"""Chat formatting: a state machine over roles, and text segments with loss flags from a declarative template.

DataFrame functions alone. A conversation's rows, ordered by turn (ties by role, then text), become one array; the
state machine folds over its roles. Texts are escaped so that no control string is left in them, so the formatted
string splits back into its turns at the closing marks.

Nulls and edges: a null text or role is the empty string; null turns come first; rows that repeat are all kept; rows
with a null conv_id form one conversation; an empty table gives no rows; extra columns are ignored. Conversations whose turn order is invalid are formatted too and flagged.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Marks around a turn, what each is written as inside a text, roles under the loss, and the turn order allowed."""

    opening: str = "### "
    naming: str = ":\n"
    closing: str = "</turn>\n"
    #: Control strings and how they are written within texts and role names; the first one is the escape sign.
    escapes: tuple[tuple[str, str], ...] = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"))
    loss_roles: tuple[str, ...] = ("assistant",)
    #: (state, role) -> state
    moves: dict = field(default_factory=lambda: {("start", "system"): "told", ("start", "user"): "asked", ("told", "user"): "asked", ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    accepted: tuple[str, ...] = ("answered",)

    def escape(self, text: Column) -> Column:
        for plain, written in self.escapes:
            text = F.replace(text, F.lit(plain), F.lit(written))
        return text

    def unescape(self, text: Column) -> Column:
        for plain, written in reversed(self.escapes):
            text = F.replace(text, F.lit(written), F.lit(plain))
        return text

    def escape_role(self, role: Column) -> Column:
        return F.replace(self.escape(role), F.lit("\n"), F.lit("\\n"))

    def unescape_role(self, role: Column) -> Column:
        return self.unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def format_conversations(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, segments (array of text, loss), valid, state: one row for each conversation."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.select("conv_id", F.struct("turn", text("role").alias("role"), text("text").alias("text")).alias("t"))
    turns = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    lit = F.lit

    def segments(t: Column) -> Column:
        seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        head = F.concat(lit(template.opening), template.escape_role(t["role"]), lit(template.naming))
        return F.array(seg(head, lit(False)), seg(template.escape(t["text"]), t["role"].isin(*template.loss_roles)), seg(lit(template.closing), lit(False)))

    moves = F.create_map(*[lit(x) for (state, role), to in template.moves.items() for x in (f"{state}\n{role}", to)])
    state = F.aggregate("turns", lit("start"), lambda s, t: F.coalesce(F.try_element_at(moves, F.concat(s, lit("\n"), t["role"])), lit("broken")))
    out = turns.select("conv_id", F.flatten(F.transform("turns", segments)).alias("segments"), state.alias("state"))
    return out.withColumn("valid", F.col("state").isin(*template.accepted))


def read_turns(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted string."""
    parts = F.split(formatted, template.closing.replace("\\", "\\\\"))
    parts = F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 1))

    def turn(x: Column) -> Column:
        at = F.instr(x, F.lit(template.naming))
        role = F.substring(x, F.lit(len(template.opening) + 1), at - len(template.opening) - 1)
        body = F.substring(x, at + len(template.naming), F.length(x))
        return F.struct(template.unescape_role(role).alias("role"), template.unescape(body).alias("text"))

    return F.transform(parts, turn)


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back from the output."""
    t = Template()
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    made = format_conversations(given.unionByName(planted), t)
    whole = made.select("conv_id", "segments", "valid", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"))
    turns = read_turns(F.col("formatted"), t)
    loss = t.unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    read = whole.select("conv_id", turns.alias("turns"), loss.alias("under_loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("under_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("under_loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )


OP3_SQL = r"""
WITH given AS (
  SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
chat AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
    string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn NULLS FIRST, role, text) AS roles,
    sum(length('### ') + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), chr(10), '\n')) + 2
      + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t')) + 8)::BIGINT AS formatted_chars
  FROM given GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
  regexp_full_match(roles, 's?(ua)+') AS valid
FROM chat"""
