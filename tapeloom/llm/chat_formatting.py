"""Chat formatting by a declarative template and a finite-state machine over roles.

``TEMPLATE`` gives per role the strings around a turn and whether its text bears loss;
``TRANSITIONS`` gives the allowed order of roles.  ``formatted`` emits one row per
conversation: its segments in order, each with its text and loss flag, the whole text, and
whether the order of roles is valid.  ``parsed`` reads turns back from the whole text.

A control string inside a text is broken by a backslash after its first character, and
backslashes are doubled, so no text can hold a control string and parsing is exact.

Only DataFrame functions are used.  The turns of a conversation meet in one row, as its text
and its digest are one value; conversations are spread by their id.

Defined results: null text and null role count as empty; turns are ordered by turn (nulls
first), then role and text, so repeated rows stay repeated turns; a null conv_id is a
conversation of its own; roles outside the template are emitted with their name and are not
valid; an empty table gives no row.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: role -> (before the text, after the text, whether the text bears loss)
TEMPLATE = {
    "system": ("<<SYS>>\n", "\n<</SYS>>\n", False),
    "user": ("[INST] ", " [/INST]\n", False),
    "assistant": ("<s> ", " </s>\n", True),
}
#: Around a turn of another role; the name is escaped like a text.
OTHER = ("<role> ", " <as> ", " </role>\n")
#: State before a turn -> roles that may follow; a valid conversation ends after an assistant.
TRANSITIONS = {
    "start": ("system", "user"),
    "system": ("user",),
    "user": ("assistant",),
    "assistant": ("user",),
}
FINAL = "assistant"
INVALID = "invalid"


def controls() -> list[str]:
    strings = [s.strip() for before, after, _ in TEMPLATE.values() for s in (before, after)]
    return sorted({*strings, *(s.strip() for s in OTHER)}, key=lambda s: (-len(s), s))


def escaped(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:])), controls(), text)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _segments(turn: Column) -> Column:
    """The segments of a turn: text and loss flag."""

    def three(before: Column, after: Column, loss: bool) -> Column:
        parts = ((before, False), (turn["safe"], loss), (after, False))
        return F.array(*[F.struct(text.alias("text"), F.lit(flag).alias("loss")) for text, flag in parts])

    first, middle, last = OTHER
    named = F.concat(F.lit(first), escaped(turn["role"]), F.lit(middle))
    out = F.when(F.lit(False), three(F.lit(""), F.lit(""), False))
    for role, (before, after, loss) in TEMPLATE.items():
        out = out.when(turn["role"] == role, three(F.lit(before), F.lit(after), loss))
    return out.otherwise(three(named, F.lit(last), False))


def _final_state(roles: Column) -> Column:
    """State of the machine after all roles."""
    moves = [(f"{state}>{role}", role) for state, allowed in TRANSITIONS.items() for role in allowed]
    table = F.create_map(*[F.lit(x) for move in moves for x in move])
    return F.aggregate(roles, F.lit("start"), lambda state, role: F.coalesce(table[F.concat(state, F.lit(">"), role)], F.lit(INVALID)))


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id, segments (text, loss), formatted, valid; input conv_id, turn, role, text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct("turn", role.alias("role"), escaped(text).alias("safe"))
    turns = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn), _by_turn).alias("turns"))
    segments = F.flatten(F.transform("turns", _segments))
    return turns.select(
        "conv_id",
        segments.alias("segments"),
        (_final_state(F.transform("turns", lambda t: t["role"])) == FINAL).alias("valid"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def _by_turn(a: Column, b: Column) -> Column:
    """Order by turn with nulls first, then by role and text."""

    def compare(x: Column, y: Column, rest: Column) -> Column:
        return F.when(x.eqNullSafe(y), rest).when(x.isNull() | (x < y), -1).otherwise(1)

    return compare(a["turn"], b["turn"], compare(a["role"], b["role"], compare(a["safe"], b["safe"], F.lit(0))))


def _quoted(s: str) -> str:
    return "\\Q" + s + "\\E"


def parsed(text: Column) -> Column:
    """Turns (role, text, loss) read back from a formatted text."""
    kinds = [(role, before, after, loss) for role, (before, after, loss) in TEMPLATE.items()]
    first, middle, last = OTHER
    pattern = "|".join(f"{_quoted(before)}.*?{_quoted(after)}" for _, before, after, _ in [*kinds, ("", first, last, False)])
    whole = F.regexp_extract_all(text, F.lit(f"(?s){pattern}"), F.lit(0))

    def turn(chunk: Column) -> Column:
        def inner(start: Column, end: str) -> Column:
            return chunk.substr(start + 1, F.length(chunk) - start - len(end))

        name_end = F.instr(chunk, F.lit(middle))
        name = chunk.substr(F.lit(len(first) + 1), name_end - 1 - len(first))
        out = F.when(F.lit(False), F.struct(F.lit("").alias("role"), F.lit("").alias("text"), F.lit(False).alias("loss")))
        for role, before, after, loss in kinds:
            body = unescaped(inner(F.lit(len(before)), after))
            out = out.when(chunk.startswith(before), F.struct(F.lit(role).alias("role"), body.alias("text"), F.lit(loss).alias("loss")))
        body = unescaped(inner(name_end + len(middle) - 1, last))
        return out.otherwise(F.struct(unescaped(name).alias("role"), body.alias("text"), F.lit(False).alias("loss")))

    return F.transform(whole, turn)


def digest(conversations: DataFrame) -> DataFrame:
    """What the formatted texts say when read back, one row per conversation."""
    turns = formatted(conversations).select("conv_id", "formatted", "segments", "valid", parsed(F.col("formatted")).alias("turns"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
        "valid",
    )


def _sql_escaped(text: str) -> str:
    out = f"replace({text}, '\\', '\\\\')"
    for c in controls():
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


def oracle() -> str:
    """DuckDB SQL for the digest of ``conversations`` with the extra conversation -1."""
    around = " ".join(f"WHEN role = '{role}' THEN {len(before) + len(after)}" for role, (before, after, _) in TEMPLATE.items())
    other = f"{sum(map(len, OTHER))} + length({_sql_escaped('role')})"
    follows = " OR ".join(
        f"(before IS {'NULL' if state == 'start' else f'NOT DISTINCT FROM {chr(39)}{state}{chr(39)}'} AND role IN ({', '.join(repr(r) for r in allowed)}))"
        for state, allowed in TRANSITIONS.items()
    )
    order = "ORDER BY turn NULLS FIRST, role, text"
    return f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
placed AS (SELECT *, lag(role) OVER (PARTITION BY conv_id {order}) AS before FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_sql_escaped('text')}) + CASE {around} ELSE {other} END) AS BIGINT) AS formatted_chars,
  bool_and({follows}) AND arg_max(role, turn) = '{FINAL}' AS valid
FROM placed GROUP BY conv_id"""
