"""Chat formatting: schema fingerprints select declarative mappings onto canonical turns.

A layout is known by the hash of the nested field paths it needs. ``to_turns`` hashes the paths of
a frame's schema; where they fit one layout, that mapping holds for the whole frame, and where a
frame mixes layouts, each row is fingerprinted by the paths it fills. A mapping is a SQL expression
that yields ``array<struct<role, text>>``.

Edge cases: null roles and texts count as empty strings. Turns are ordered by turn number, then
role, then text, nulls first, so repeated or tied rows keep a fixed order. Columns no layout names
are ignored, and a row that fits no layout keeps null turns. An empty table gives an empty result.
A conversation is one value by definition, so its turns meet in one row; they are gathered with
partial aggregation and hashed paths never leave the plan.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    name: str
    #: Paths that must be there; their hash is the layout's fingerprint.
    paths: tuple[str, ...]
    key: str
    #: SQL for the turns of one row; of one turn (a struct) where ``per_turn``.
    turns: str
    per_turn: bool = False

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def _pair(user: str, assistant: str, system: str | None = None) -> str:
    turns = [f"named_struct('role', 'user', 'text', {user})", f"named_struct('role', 'assistant', 'text', {assistant})"]
    if system:
        turns.insert(0, f"if({system} is null, null, named_struct('role', 'system', 'text', {system}))")
    return f"array_compact(array({', '.join(turns)}))"


_SPEAKERS = "CASE lower({0}) WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' ELSE {0} END"

LAYOUTS = (
    Layout("turn_rows", ("conv_id", "turn", "role"), "conv_id", "named_struct('role', role, 'text', text)", per_turn=True),
    Layout("messages", ("id", "messages[]", "messages[].content", "messages[].role"), "id", "transform(messages, m -> named_struct('role', m.role, 'text', m.content))"),
    Layout("speakers", ("conversations[]", "conversations[].from", "conversations[].value", "id"), "id", f"transform(conversations, m -> named_struct('role', {_SPEAKERS.format('m.from')}, 'text', m.value))"),
    Layout("instruction", ("id", "input", "instruction", "output"), "id", _pair("concat_ws('\\n\\n', instruction, nullif(input, ''))", "output")),
    Layout("prompt", ("id", "prompt", "response"), "id", _pair("prompt", "response")),
    Layout("nested_prompt", ("id", "request.prompt", "request.system", "response.text"), "id", _pair("request.prompt", "response.text", "request.system")),
)


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """All nested paths: ``a.b`` for a field of a struct, ``a[]`` for the elements of an array."""
    if isinstance(schema, T.StructType):
        found = []
        for f in schema.fields:
            path = f"{at}.{f.name}" if at else f.name
            found += [path, *field_paths(f.dataType, path)]
        return found
    if isinstance(schema, T.ArrayType):
        return [f"{at}[]", *field_paths(schema.elementType, f"{at}[]")]
    return []


def _filled(path: str) -> Column:
    """Whether a row fills a path: the value, or the array that holds it, is not null."""
    return F.col(path.split("[]")[0]).isNotNull()


def _row_layout(layouts) -> Column:
    """A row's layout by its fingerprint, or null."""
    out = F.lit(None).cast("string")
    for layout in sorted(layouts, key=lambda x: len(x.paths)):
        present = F.array_sort(F.array_compact(F.array(*[F.when(_filled(p), F.lit(p)) for p in sorted(layout.paths)])))
        out = F.when(F.sha2(F.array_join(present, "\n"), 256) == layout.fingerprint, F.lit(layout.name)).otherwise(out)
    return out


def to_turns(df: DataFrame, layouts=LAYOUTS) -> DataFrame:
    """(conv_id string-compatible key, layout, turns) of a frame in any registered layout."""
    known = {p for x in layouts for p in x.paths}
    there = [p for p in field_paths(df.schema) if p in known]
    by_hash = {x.fingerprint: x for x in layouts}
    whole = by_hash.get(fingerprint(there))
    fitting = [whole] if whole else [x for x in layouts if set(x.paths) <= set(there)]
    if not fitting:
        raise ValueError(f"no layout fits the paths {sorted(there)}")
    if len(fitting) == 1:
        return _mapped(df, fitting[0])
    marked = df.withColumn("__layout", _row_layout(fitting))
    parts = [_mapped(marked.filter(F.col("__layout") == x.name), x) for x in fitting]
    lost = marked.filter(F.col("__layout").isNull()).select(
        F.coalesce(*[F.col(k).cast("string") for k in dict.fromkeys(x.key for x in fitting)]).alias("conv_id"), F.lit(None).cast("string").alias("layout"), F.lit(None).cast(TURNS).alias("turns")
    )
    out = lost
    for part in parts:
        out = out.unionByName(part.withColumn("conv_id", F.col("conv_id").cast("string")))
    return out


def _mapped(df: DataFrame, layout: Layout) -> DataFrame:
    if not layout.per_turn:
        return df.select(F.col(layout.key).alias("conv_id"), F.lit(layout.name).alias("layout"), F.expr(layout.turns).cast(TURNS).alias("turns"))
    text = F.expr(layout.turns)
    rows = df.select(F.col(layout.key).alias("conv_id"), F.struct(F.col("turn"), text["role"].alias("role"), text["text"].alias("text")).alias("t"))
    gathered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return gathered.select("conv_id", F.lit(layout.name).alias("layout"), F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).cast(TURNS).alias("turns"))


OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>"


def escape(text: Column) -> Column:
    """No ``\\`` stands alone, and no ``<`` or ``#`` at all, in escaped text: marks can't be forged."""
    for a, b in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"), (":", "\\c")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def unescape(text: Column) -> Column:
    for b, a in (("\\c", ":"), ("\\h", "#"), ("\\l", "<"), ("\\b", "\\")):
        text = F.replace(text, F.lit(b), F.lit(a))
    return text


def render(turns_df: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_spans``: for each assistant turn its index in the formatted text
    split at the closing mark, and the start and length in code points of its text therein."""
    empty = F.lit("")
    cleaned = F.transform("turns", lambda t: F.struct(escape(F.coalesce(t["role"], empty)).alias("role"), escape(F.coalesce(t["text"], empty)).alias("text")))
    out = turns_df.withColumn("__clean", cleaned)
    formatted = F.array_join(F.transform("__clean", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(BETWEEN), t["text"], F.lit(CLOSE))), "")
    spans = F.array_compact(
        F.transform(
            "__clean",
            lambda t, i: F.when(t["role"] == "assistant", F.struct(i.alias("piece"), (F.length(t["role"]) + len(OPEN) + len(BETWEEN)).alias("start"), F.length(t["text"]).alias("length"))),
        )
    )
    return out.withColumns({"formatted": formatted, "loss_spans": spans}).drop("__clean")


def read_back(formatted_df: DataFrame) -> DataFrame:
    """Turns and the text under the loss mask, from ``formatted`` and ``loss_spans`` alone."""
    pieces = F.split("formatted", CLOSE)
    out = formatted_df.withColumn("pieces", F.slice(pieces, 1, F.size(pieces) - 1))
    turns = F.transform(
        "pieces",
        lambda p: F.struct(
            unescape(F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), BETWEEN, 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, BETWEEN) + len(BETWEEN))).alias("text"),
        ),
    )
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.get("pieces", s["piece"]), s["start"] + 1, s["length"]))), "")
    return out.withColumns({"turns": turns, "loss_text": loss}).drop("pieces")


def op1(spark, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of conversation -7; where the table has one of that number, the two rows
    are further turns of it."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    made = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    planted = made.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema])
    back = read_back(render(to_turns(rows.unionByName(planted))).select("conv_id", "formatted", "loss_spans"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql_escape(x: str) -> str:
    return f"replace(replace(replace(replace({x}, '\\', '\\b'), '<', '\\l'), '#', '\\h'), ':', '\\c')"


OP1_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), told AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS whole,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
    sum(length({_sql_escape("role")}) + length({_sql_escape("text")}) + {len(OPEN + BETWEEN + CLOSE)}) AS formatted_chars
  FROM rows GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars,
  sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM told
"""
