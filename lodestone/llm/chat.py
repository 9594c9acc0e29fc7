"""Chat formatting: a finite-state machine over roles and a declarative template, in SQL functions only.

The template gives each role an opening and a closing mark and says whether its text bears loss.  Marks hold "<"; inside
texts and roles a backslash becomes \\b and "<" becomes \\l, so no text can hold a mark and the change is undone exactly.
The machine starts in "start" and moves by (state, role); a move that isn't listed ends in "invalid" and stays there.

Rows: null texts and roles are empty; turns order by (turn, role, text) with nulls first, so ties are settled by content and
repeated rows stay repeated turns; a null conv_id is one conversation; an unknown role makes the conversation invalid and
bears no loss, and is formatted all the same; other columns are ignored.  No rows, no result.  A conversation, with very long texts
too, is one row, as its digests are of all of it; ValueError for a template whose marks could not be told from escaped texts.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ODD = "\\### Assistant: </turn> ok"


@dataclass(frozen=True)
class Template:
    open: str = "<turn>"
    after_role: str = "\n"
    close: str = "</turn>\n"
    loss: tuple[str, ...] = ("assistant",)
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    final: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        if "<" not in self.open or "<" not in self.close:
            raise ValueError("an opening and a closing mark each need a <, which escaped texts never hold")
        if "\n" not in self.after_role:
            raise ValueError("the mark after a role needs a line end, which escaped roles never hold")
        if self.open in self.close or self.close in self.open:
            raise ValueError("one mark holds the other")


def escaped(c: Column, role: bool = False) -> Column:
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))
    return F.replace(c, F.lit("\n"), F.lit("\\n")) if role else c


def unescaped(c: Column, role: bool = False) -> Column:
    c = F.replace(c, F.lit("\\n"), F.lit("\n")) if role else c
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def formatted(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, segments (array of text and loss flag, in order), formatted (their texts joined), state and valid."""
    t = template
    moves = F.create_map(*[F.lit(x) for (a, b), c in t.moves.items() for x in (f"{a}\n{b}", c)])
    # Escaping comes before the gathering, so that a conversation is gathered once, in the form that it keeps.
    rows = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    gathered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    parts = F.flatten(F.transform("ts", lambda x: F.array(
        F.struct(F.concat(F.lit(t.open), escaped(x.role, True), F.lit(t.after_role)).alias("text"), F.lit(False).alias("loss")),
        F.struct(escaped(x.text).alias("text"), x.role.isin(*t.loss).alias("loss")),
        F.struct(F.lit(t.close).alias("text"), F.lit(False).alias("loss")),
    )))
    state = F.aggregate("ts", F.lit("start"), lambda s, x: F.coalesce(F.try_element_at(moves, F.concat_ws("\n", s, x.role)), F.lit("invalid")))
    out = gathered.select("conv_id", parts.alias("segments"), state.alias("state"))
    return out.select("conv_id", "segments", F.array_join("segments.text", "").alias("formatted"), "state", F.col("state").isin(*t.final).alias("valid"))


def read_back(out: DataFrame, template: Template = Template()) -> DataFrame:
    """The contract's digests, all parsed from the formatted text and the flagged segments."""
    t = template
    pieces = F.transform(F.filter(F.split("formatted", re.escape(t.open)), lambda x: F.length(x) > 0), lambda x: F.substring_index(x, t.close, 1))
    parsed = F.transform(pieces, lambda x: F.struct(unescaped(F.substring_index(x, t.after_role, 1), True).alias("role"), unescaped(F.substring(x, F.locate(t.after_role, x) + len(t.after_role), F.length(x))).alias("text")))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: unescaped(s.text)), "")
    kept = out.select("conv_id", parsed.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"), "valid", "state")
    return kept.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
        "state",
    )


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ODD).alias("text"))
    return read_back(formatted(turns.unionByName(odd)))


ORACLE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
  length(replace(replace(text, '\', '\b'), '<', '\l')) + length(role) + 15 AS chars FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS loss, sum(chars)::BIGINT AS formatted_chars,
  string_agg(substr(role, 1, 1), '' ORDER BY k) AS roles FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars,
  regexp_full_match(roles, 's?(ua)+') AS valid,
  CASE WHEN regexp_full_match(roles, 's?(ua)+') THEN 'assistant' WHEN regexp_full_match(roles, 's?(ua)*u') THEN 'user' WHEN roles = 's' THEN 'system' ELSE 'invalid' END AS state FROM g
"""
