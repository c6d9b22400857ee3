"""Chat formatting: a finite-state machine over roles and a declarative template, in DataFrame functions only.

A template gives each role a name; a turn becomes ``### Name: `` + text + ``</turn>`` and a line feed. Inside roles and
texts the characters that control strings are made of are written as a backslash and a letter, so a marker in the output
is always a real one and the text comes back exactly.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoframe.llm.common import table


@dataclass(frozen=True)
class Template:
    """Names of roles, the roles that carry loss, and the machine: (state, role) → state; ``start`` is the first state."""

    names: dict[str, str] = field(default_factory=lambda: {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"})
    loss_roles: tuple[str, ...] = ("assistant",)
    steps: tuple[tuple[str, str, str], ...] = (
        ("start", "system", "briefed"),
        ("start", "user", "asked"),
        ("briefed", "user", "asked"),
        ("asked", "assistant", "answered"),
        ("answered", "user", "asked"),
        ("answered", "tool", "asked"),
    )
    final: tuple[str, ...] = ("answered",)
    close: str = "</turn>\n"


#: The machine's state after a turn that it has no step for.
REFUSED = "refused"

#: The escape letters, in the order in which they are written; they are undone in the opposite order.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escape(text: Column, colon: bool = False) -> Column:
    for plain, coded in ESCAPES if colon else ESCAPES[:3]:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _lookup(pairs: dict[str, str], key: Column, default: Column) -> Column:
    if not pairs:
        return default
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), key), default)


def format_chats(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per conversation: ``conv_id, valid, refused_at, segments, formatted``.

    ``segments`` is an array of (text, loss) that joined give ``formatted``; only the texts of loss roles carry loss.
    ``valid`` tells whether the roles, in order, lead the machine from ``start`` to a final state, ``refused_at`` is the
    number (from 1) of the first turn that it has no step for, else null; conversations that it refuses are formatted all
    the same, for the caller to drop. Rows are ordered by turn, then role, then text, nulls
    first; a null text or role is empty; repeated rows stay; a null conv_id is a conversation of its own; an empty table
    gives no rows; other columns are ignored. A role that the template doesn't name is written as ``Role=`` + role.
    One conversation is one value, so it has to fit in a task; many conversations spread by conv_id.
    """
    t = template or Template()
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    machine = {f"{a}\n{role}": b for a, role, b in t.steps}

    def step(s: Column, x: Column) -> Column:
        to = _lookup(machine, F.concat(s["state"], F.lit("\n"), x["role"]), F.lit(REFUSED))
        at = F.when((to == REFUSED) & (s["state"] != REFUSED), s["n"] + 1).otherwise(s["at"])
        return F.struct(to.alias("state"), (s["n"] + 1).alias("n"), at.alias("at"))

    first = F.struct(F.lit("start").alias("state"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("at"))
    end = F.aggregate("turns", first, step)

    def segments(x: Column) -> Column:
        name = _lookup(t.names, x["role"], F.concat(F.lit("Role="), escape(x["role"], colon=True)))
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            part(F.concat(F.lit("### "), name, F.lit(": ")), F.lit(False)),
            part(escape(x["text"]), x["role"].isin(*t.loss_roles)),
            part(F.lit(t.close), F.lit(False)),
        )

    chats = chats.withColumn("end", end)
    out = chats.select("conv_id", F.col("end.state").isin(*t.final).alias("valid"), F.col("end.at").alias("refused_at"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """The array of (role, text) that a formatted conversation was made of."""
    t = template or Template()
    pieces = F.filter(F.split(formatted, t.close), lambda p: p != "")
    names = {v: k for k, v in t.names.items()}

    def turn(p: Column) -> Column:
        name = F.regexp_extract(p, r"(?s)\A### ([^:]*): (.*)\z", 1)
        role = _lookup(names, name, unescape(F.regexp_replace(name, r"\ARole=", "")))
        return F.struct(role.alias("role"), unescape(F.regexp_extract(p, r"(?s)\A### ([^:]*): (.*)\z", 2)).alias("text"))

    return F.transform(pieces, turn)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    marker = "\\### Assistant: </turn> ok"
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(marker).alias("text"),
    )
    chats = format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe))
    back = chats.select(
        "conv_id",
        "valid",
        "refused_at",
        read_back(F.col("formatted")).alias("turns"),
        F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "").alias("loss"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
        "refused_at",
    )


OP9_SQL = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), parts AS (
  SELECT *, 4 + 2 + 8 + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g'))
    + CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 WHEN 'tool' THEN 4
      ELSE 5 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) END AS chars
  FROM turns
), placed AS (
  SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM turns
), steps(a, role, b) AS (
  VALUES ('start', 'system', 'briefed'), ('start', 'user', 'asked'), ('briefed', 'user', 'asked'), ('asked', 'assistant', 'answered'),
    ('answered', 'user', 'asked'), ('answered', 'tool', 'asked')
), run AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS k, 'start' AS state, CAST(NULL AS BIGINT) AS refused_at FROM turns
  UNION ALL
  SELECT r.conv_id, p.k, coalesce(s.b, 'refused'), CASE WHEN s.b IS NULL AND r.state <> 'refused' THEN p.k ELSE r.refused_at END
  FROM run r JOIN placed p ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND p.k = r.k + 1 LEFT JOIN steps s ON s.a = r.state AND s.role = p.role
), ends AS (
  SELECT conv_id, arg_max(state, k) = 'answered' AS valid, max(refused_at) AS refused_at FROM run GROUP BY conv_id
), formatted AS (
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM parts GROUP BY conv_id
)
SELECT f.*, e.valid, e.refused_at FROM formatted f JOIN ends e ON f.conv_id IS NOT DISTINCT FROM e.conv_id
"""
