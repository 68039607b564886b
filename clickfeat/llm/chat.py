"""Chat formatting by schema fingerprints, in DataFrame functions only.

Records come in many layouts: prompt and response, instruction with input,
lists of messages under various names.  A record's fingerprint is the hash of
its nested field paths (scalar types left out); it selects one of the
declarative ``MAPPINGS``, which all lead to canonical turns
``array<struct<role, text>>``.  Tables with one row per turn have a fingerprint
too, taken from their schema, and are gathered by conversation first.

The template marks turns; any control string inside a text or role is escaped
reversibly: ``<``, then backslashes, then ``|`` gets one backslash more.  The loss
mask is a list of code-point spans over the assistant texts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F, types as T

TURNS = "array<struct<role:string,text:string>>"
START, END = "<|im_start|>", "<|im_end|>\n"
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: name -> (field paths, how to read turns).  A list of (role, path) pairs makes
#: a turn of each path; (array, role field, text field) makes one of each entry.
MAPPINGS = {
    "prompt": (["prompt", "response"], [("user", "prompt"), ("assistant", "response")]),
    "completion": (["completion", "prompt"], [("user", "prompt"), ("assistant", "completion")]),
    "question": (["answer", "question"], [("user", "question"), ("assistant", "answer")]),
    "instruction": (["instruction", "output"], [("user", "instruction"), ("assistant", "output")]),
    "instruction with input": (["input", "instruction", "output"],
                               [("user", "instruction"), ("user", "input"), ("assistant", "output")]),
    "system prompt": (["prompt", "response", "system"], [("system", "system"), ("user", "prompt"), ("assistant", "response")]),
    "messages": (["messages[].content", "messages[].role"], ("messages", "role", "content")),
    "conversations": (["conversations[].from", "conversations[].value"], ("conversations", "from", "value")),
    "turns": (["turns[].speaker", "turns[].text"], ("turns", "speaker", "text")),
}
#: one row per turn: field paths -> (conversation, order, role, text)
ROW_MAPPINGS = {("conv_id", "role", "text", "turn"): ("conv_id", "turn", "role", "text")}


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type; list entries are marked ``[]``."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    return [at]


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _shape(paths) -> str:
    """``paths`` as ``schema_of_variant`` writes them, without scalar types."""
    fields: dict[str, list] = {}
    for p in paths:
        head, _, rest = p.partition(".")
        fields.setdefault(head, []).append(rest)
    inner = ",".join(f"{k.removesuffix('[]')}{':' + ('ARRAY<' + _shape(v) + '>' if k.endswith('[]') else _shape(v)) if any(v) else ''}"
                     for k, v in sorted(fields.items()))
    return f"OBJECT<{inner}>"


def json_fingerprint(record: Column) -> Column:
    """The fingerprint of a JSON text's own nested fields (null if it is none)."""
    kind = F.schema_of_variant(F.try_parse_json(record))
    kind = F.regexp_replace(kind, r": (?!ARRAY|OBJECT)[A-Z_]+(\([0-9,]*\))?", "")
    return F.sha2(F.regexp_replace(kind, r"([:,]) ", "$1"), 256)


def _turns_of(v: Column, how) -> Column:
    if isinstance(how, list):
        return F.array(*[F.struct(F.lit(r).alias("role"), F.try_variant_get(v, f"$.{p}", "string").alias("text")) for r, p in how])
    array, role, text = how
    entries = F.try_variant_get(v, f"$.{array}", f"array<struct<`{role}`:string,`{text}`:string>>")
    names = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    return F.transform(entries, lambda e: F.struct(F.coalesce(F.element_at(names, e[role]), e[role]).alias("role"), e[text].alias("text")))


def canonical_turns(records: DataFrame, key: str, record: str) -> DataFrame:
    """JSON records of any mapped layout -> ``key, layout, turns``.

    Malformed records and unknown layouts have a null layout and null turns (no
    row is lost); missing and null texts are empty; key-less rows are kept."""
    parsed = records.select(F.col(key), F.try_parse_json(F.col(record)).alias("__v"), json_fingerprint(F.col(record)).alias("__f"))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for name, (paths, how) in MAPPINGS.items():
        own = F.col("__f") == hashlib.sha256(_shape(paths).encode()).hexdigest()
        layout, turns = F.when(own, name).otherwise(layout), F.when(own, _turns_of(F.col("__v"), how)).otherwise(turns)
    return parsed.select(key, layout.alias("layout"), F.transform(turns, lambda t: F.struct(
        F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))).alias("turns"))


def gathered_turns(rows: DataFrame) -> DataFrame:
    """A table of turn rows -> ``conv_id, turns``, by the mapping of its schema's
    fingerprint.  Turns are ordered by (turn, role, text), nulls first; null
    roles and texts are empty; repeated rows are turns each; rows without a
    conversation form one of their own.  Fields beyond a mapping's are ignored.
    A conversation becomes one value, so its size is bounded by that of a string."""
    for paths in ROW_MAPPINGS:
        if set(paths) <= set(field_paths(rows.schema)):
            rows = rows.select(*paths)
            break
    known = {fingerprint(p): m for p, m in ROW_MAPPINGS.items()}
    mapping = known.get(fingerprint(field_paths(rows.schema)))
    if mapping is None:
        raise ValueError(f"no mapping for the fields {field_paths(rows.schema)}")
    conv, order, role, text = mapping
    turn = F.struct(F.col(order).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.groupBy(F.col(conv).alias("conv_id")).agg(
        F.transform(F.array_sort(F.collect_list(turn)), lambda t: F.struct(t["role"], t["text"])).alias("turns"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", r"<$1|")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def render(df: DataFrame) -> DataFrame:
    """Adds ``formatted`` and ``loss_spans`` (code points: start, length) to rows
    with ``turns``; null turns are formatted as no turn."""
    parts = F.transform(F.coalesce("turns", F.array().cast(TURNS)), lambda t: F.struct(
        _escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("learn")))
    sized = F.transform("__parts", lambda p: F.struct(
        (F.length(p["role"]) + len(START) + 1).alias("before"), F.length(p["text"]).alias("n"), p["learn"].alias("learn")))
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate(sized, nothing, lambda acc, p: F.struct(
        (acc["at"] + p["before"] + p["n"] + len(END)).alias("at"),
        F.when(p["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + p["before"]).alias("start"), p["n"].alias("length")))))
         .otherwise(acc["spans"]).alias("spans")), lambda acc: acc["spans"])
    text = F.array_join(F.transform("__parts", lambda p: F.concat(F.lit(START), p["role"], F.lit("\n"), p["text"], F.lit(END))), "")
    return (df.withColumn("__parts", parts).withColumn("formatted", text).withColumn("loss_spans", spans).drop("__parts"))


def parse(formatted: Column) -> Column:
    """The turns that a formatted text holds."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(p):
        role = F.substring_index(p, "\n", 1)
        return F.struct(_unescape_role(F.substr(role, F.lit(len(START) + 1))).alias("role"),
                        unescape(F.substr(p, F.length(role) + 2)).alias("text"))
    return F.transform(pieces, turn)


def loss_text(formatted: str, spans: str) -> Column:
    """All text under the mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(F.col(formatted), s["start"] + 1, s["length"]))), "")


def digests(df: DataFrame) -> DataFrame:
    """What a reader finds in the formatted text, for checks."""
    turns = F.array_join(F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = loss_text("formatted", "loss_spans")
    return df.select("conv_id", F.size(parse(F.col("formatted"))).cast("long").alias("n_turns"),
                     F.sha2(turns, 256).alias("turns_sha256"),
                     F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                     F.length("formatted").cast("long").alias("formatted_chars"))
