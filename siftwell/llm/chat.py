"""Chat formatting: schema fingerprints select declarative mappings to canonical turns.

A record's nested field paths, sorted and hashed, are its fingerprint. Each known
fingerprint has one mapping, written as a SQL expression, from that layout to an
array of ``(role, text)`` turns. Typed tables are fingerprinted once from their
schema, JSON records one by one from the paths that they hold. Everything here is
DataFrame and SQL functions.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm.common import table

TURNS = "array<struct<role:string,text:string>>"

# The template's own marks, and control strings of common chat templates.
START, END = "<|turn|>", "<|end|>"
CONTROL_STRINGS = [
    "<|turn|>", "<|end|>", "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<s>", "</s>",
    "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|system|>", "<|user|>", "<|assistant|>", "<pad>", "<unk>",
]


def fingerprint(paths) -> str:
    """Hash of a set of nested field paths such as ``messages[].role``."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """``turns``: SQL over the layout's own columns (typed) or over ``v``, a variant (JSON)."""

    name: str
    paths: tuple[str, ...]
    turns: str

    @property
    def key(self) -> str:
        return fingerprint(self.paths)


def _said(*parts: tuple[str, str]) -> str:
    return "array(" + ", ".join(f"named_struct('role', '{r}', 'text', coalesce(try_variant_get(v, '$.{p}', 'string'), ''))" for r, p in parts) + ")"


def _listed(field: str, role: str, text: str) -> str:
    items = f"try_variant_get(v, '$.{field}', 'array<struct<`{role}`:string,`{text}`:string>>')"
    return f"transform({items}, m -> named_struct('role', coalesce(m.`{role}`, ''), 'text', coalesce(m.`{text}`, '')))"


_WITH_INPUT = "array(named_struct('role', 'user', 'text', concat_ws('\\n\\n', try_variant_get(v, '$.instruction', 'string'), nullif(try_variant_get(v, '$.input', 'string'), ''))), named_struct('role', 'assistant', 'text', coalesce(try_variant_get(v, '$.output', 'string'), '')))"

#: The mappings for records. A layout is added by adding a line.
RECORD_LAYOUTS = (
    Layout("messages", ("messages[].content", "messages[].role"), _listed("messages", "role", "content")),
    Layout("conversations", ("conversations[].from", "conversations[].value"), _listed("conversations", "from", "value")),
    Layout("dialogue", ("dialogue[].speaker", "dialogue[].text"), _listed("dialogue", "speaker", "text")),
    Layout("instruction_input", ("input", "instruction", "output"), _WITH_INPUT),
    Layout("instruction", ("instruction", "output"), _said(("user", "instruction"), ("assistant", "output"))),
    Layout("prompt_completion", ("completion", "prompt"), _said(("user", "prompt"), ("assistant", "completion"))),
    Layout("prompt_response", ("prompt", "response"), _said(("user", "prompt"), ("assistant", "response"))),
    Layout("system_prompt_response", ("prompt", "response", "system"), _said(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question_answer", ("answer", "question"), _said(("user", "question"), ("assistant", "answer"))),
)
#: The layout of tables with one row for each turn.
TURN_ROWS = Layout("turn_rows", ("conv_id", "role", "text", "turn"), "")
# Other names of the canonical roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
KNOWN_PATHS = sorted({p for x in RECORD_LAYOUTS for p in x.paths})


def schema_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """The leaves of a schema as paths; ``[]`` stands for the elements of an array."""
    out = []
    for f in schema.fields:
        kind, path = f.dataType, f"{prefix}{f.name}"
        while isinstance(kind, T.ArrayType):
            kind, path = kind.elementType, f"{path}[]"
        out += schema_paths(kind, f"{path}.") if isinstance(kind, T.StructType) else [path]
    return out


def _holds(path: str) -> Column:
    """Whether ``v`` has the path; in a list, whether any element has it."""
    if "[]." not in path:
        return F.expr(f"try_variant_get(v, '$.{path}', 'variant') IS NOT NULL")
    field, rest = path.split("[].", 1)
    return F.expr(f"coalesce(exists(try_variant_get(v, '$.{field}', 'array<variant>'), m -> try_variant_get(m, '$.{rest}', 'variant') IS NOT NULL), false)")


def record_fingerprint() -> Column:
    """Fingerprint of the variant ``v`` over the known paths; others don't change it."""
    held = F.array_compact(F.array(*[F.when(_holds(p), F.lit(p)) for p in KNOWN_PATHS]))
    return F.substring(F.sha2(F.array_join(held, "\n"), 256), 1, 16)


def turns_of_records(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Canonical turns of JSON records of any known layout, one conversation for each row.

    Returns conv_id, layout, fingerprint, turns. Malformed JSON, null and layouts
    without a mapping give layout ``unknown`` and no turns. Fields besides the
    known ones, whatever their names, are ignored.
    """
    known = df.select(F.col(f"`{id_col}`").alias("conv_id"), F.try_parse_json(F.col(f"`{json_col}`")).alias("v"))
    known = known.withColumn("fingerprint", record_fingerprint())
    turns, layout = F.lit(None).cast(TURNS), F.lit("unknown")
    for x in RECORD_LAYOUTS:
        turns = F.when(F.col("fingerprint") == x.key, F.expr(x.turns).cast(TURNS)).otherwise(turns)
        layout = F.when(F.col("fingerprint") == x.key, F.lit(x.name)).otherwise(layout)
    renamed = F.transform(
        F.coalesce(turns, F.array().cast(TURNS)),
        lambda t: F.struct(_role(t["role"]).alias("role"), t["text"].alias("text")),
    )
    return known.select("conv_id", layout.alias("layout"), "fingerprint", renamed.alias("turns"))


def _role(role: Column) -> Column:
    for other, name in ROLE_NAMES.items():
        role = F.when(role == other, F.lit(name)).otherwise(role)
    return role


def turns_of_table(df: DataFrame) -> DataFrame:
    """Canonical turns of a table with one row for each turn; columns besides the four are ignored.

    Turns stand in the order of ``turn``, then role and text, so repeated rows and
    ties have one order. A null role or text is empty; rows without conv_id make up
    one conversation. Any other schema stops with its fingerprint.
    """
    key = fingerprint([p for p in schema_paths(df.schema) if p in TURN_ROWS.paths])
    if key != TURN_ROWS.key:
        raise ValueError(f"no mapping for schema fingerprint {fingerprint(schema_paths(df.schema))}")
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (
        df.select("conv_id", row.alias("row"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("row")).alias("rows"))
        .select(
            "conv_id",
            F.lit(TURN_ROWS.name).alias("layout"),
            F.lit(key).alias("fingerprint"),
            F.transform("rows", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
        )
    )


def _pattern(escaped: bool) -> str:
    rests = "|".join(re.escape(x[1:]).replace("/", "/") for x in sorted(CONTROL_STRINGS, reverse=True))
    return r"([<\[])" + (r"\\" if escaped else "") + r"(\\*)(" + rests + ")"


ESCAPE, UNESCAPE = _pattern(False), _pattern(True)


def escape(text: Column) -> Column:
    """Put one more backslash behind the first character of every control string.

    ``<s>`` becomes ``<\\s>`` and ``<\\s>`` becomes ``<\\\\s>``, so it can be undone
    whatever the text holds, and no control string is left.
    """
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    # Between pairs of backslashes, each of which stands for one, no backslash is left but those of line breaks.
    between = F.transform(F.split(unescape(role), r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(between, "\\")


def formatted(conversations: DataFrame) -> DataFrame:
    """Add ``formatted`` (string) and ``loss_runs`` to canonical conversations.

    ``loss_runs`` has one (skip, keep, tail) for each turn, in code points of
    ``formatted``: the mask is 0 for skip, 1 for keep and 0 for tail characters.
    Only assistant texts are kept. Columns of these names are replaced.
    """

    def one(t: Column) -> Column:
        head, text = F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")), escape(t["text"])
        loss = F.when(t["role"] == "assistant", F.length(text)).otherwise(0)
        tail = F.length(text) - loss + len(END) + 1
        return F.struct(
            F.concat(head, text, F.lit(END + "\n")).alias("s"),
            F.struct(F.length(head).alias("skip"), loss.alias("keep"), tail.alias("tail")).alias("run"),
        )

    rest = [F.col(f"`{c}`") for c in conversations.columns if c not in ("formatted", "loss_runs")]
    return conversations.select(*rest, F.transform("turns", one).alias("__sw_done")).select(
        *rest,
        F.array_join(F.col("__sw_done.s"), "").alias("formatted"),
        F.col("__sw_done.run").alias("loss_runs"),
    )


def read_back(formatted_text: str = "formatted", loss_runs: str = "loss_runs") -> tuple[Column, Column]:
    """Columns (turns, loss texts) parsed from the formatted string and its mask alone."""
    parts = F.filter(F.split(F.col(formatted_text), re.escape(END) + "\n"), lambda s: s != "")

    def turn(s: Column) -> Column:
        body = F.substr(s, F.lit(len(START) + 1))
        role = F.substring_index(body, "\n", 1)
        return F.struct(_unescape_role(role).alias("role"), unescape(F.substr(body, F.length(role) + 2)).alias("text"))

    kept = F.zip_with(parts, F.col(loss_runs), lambda s, r: unescape(F.substr(s, r["skip"] + 1, r["keep"])))
    return F.transform(parts, turn), kept


#: A conversation whose texts are control strings; stored as a record of another layout.
PROBE_ID, PROBE_TEXT = -1, "</s>[INST] ok [/INST]"


def op3_schema_fingerprint_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation formatted and read back; the probe comes in as a ``messages`` record."""
    probe = f'{{"messages": [{{"role": "user", "content": "{PROBE_TEXT}"}}, {{"role": "assistant", "content": "{PROBE_TEXT}"}}]}}'
    records = spark.range(1).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.lit(probe).alias("json"))
    turns = turns_of_table(table(spark, sf_dir, "conversations")).unionByName(turns_of_records(records, "conv_id", "json"))
    back, loss = read_back()
    done = formatted(turns).select("conv_id", "formatted", back.alias("turns"), F.array_join(loss, "").alias("loss"))
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return done.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _oracle() -> str:
    pattern = ESCAPE.replace("'", "''")
    esc = lambda c: f"regexp_replace({c}, '{pattern}', '\\1\\\\\\2\\3', 'g')"
    role = esc("replace(replace(role, '\\', '\\\\'), chr(10), '\\n')")
    return f"""
    WITH rows AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -1, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE_TEXT}')
    SELECT conv_id, count(*)::BIGINT AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum({len(START) + 1 + len(END) + 1} + length({role}) + length({esc("text")}))::BIGINT AS formatted_chars
    FROM rows GROUP BY conv_id"""


QUERIES = {"op3_schema_fingerprint_chat": op3_schema_fingerprint_chat}
ORACLES = {"op3_schema_fingerprint_chat": _oracle()}
