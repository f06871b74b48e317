"""Chat formatting: layouts found by their field paths, mapped to turns, written and read back."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from repotide.llm.common import let

TURNS = "array<struct<role:string,text:string>>"

# The template: ``### role: text</turn>\n`` for each turn.
HEAD, END = "### ", "</turn>\n"
#: Control strings and the code that stands for each inside a role or text.
CODES = ((END.strip(), "\\e"), (HEAD, "\\h"))
#: A role also gives up the mark that ends it.
ROLE_CODES = (*CODES, (":", "\\c"))
#: The JSON reader takes records of so many bytes for sure; longer ones may come back unread.
READABLE = 16_000_000
#: Turns per chunk; a conversation is put together from chunks, never from single rows.
CHUNK = 256


def field_paths(variant: Column) -> Column:
    """The nested field paths of a JSON record, without the types of its leaves."""
    return F.regexp_replace(F.schema_of_variant(variant), r": ?(?!OBJECT<|ARRAY<)[A-Z_]+(?:\([0-9, ]*\))?", "")


def fingerprint(variant: Column) -> Column:
    """Hash of the nested field paths: records of one layout share it."""
    return F.xxhash64(field_paths(variant))


@dataclass(frozen=True)
class Mapping:
    """A layout, given by an example, and where its turns are.

    ``parts``: (role, path) for turns at fixed fields. ``turns``: path of an array of messages with their
    ``role`` and ``text`` fields. A role may itself be a path (it then starts with ``$``).
    """

    example: str
    parts: tuple[tuple[str, str], ...] = ()
    turns: str = ""
    role: str = "role"
    text: str = "content"


MAPPINGS = (
    Mapping('{"role":"","text":""}', parts=(("$.role", "$.text"),)),
    Mapping('{"role":"","content":""}', parts=(("$.role", "$.content"),)),
    Mapping('{"prompt":"","completion":""}', parts=(("user", "$.prompt"), ("assistant", "$.completion"))),
    Mapping('{"prompt":"","response":""}', parts=(("user", "$.prompt"), ("assistant", "$.response"))),
    Mapping('{"question":"","answer":""}', parts=(("user", "$.question"), ("assistant", "$.answer"))),
    Mapping('{"instruction":"","output":""}', parts=(("user", "$.instruction"), ("assistant", "$.output"))),
    Mapping('{"instruction":"","input":"","output":""}',
            parts=(("system", "$.instruction"), ("user", "$.input"), ("assistant", "$.output"))),
    Mapping('{"messages":[{"role":"","content":""}]}', turns="$.messages"),
    Mapping('{"conversations":[{"from":"","value":""}]}', turns="$.conversations", role="from", text="value"),
)


def _pick(found: Column, turns: Callable[[Mapping], Column], mappings: tuple[Mapping, ...]) -> tuple[Column, Column]:
    """Whether the fingerprint is known, and the turns by its mapping (an empty array if not)."""
    picked, known = None, None
    for m in mappings:
        same = found == fingerprint(F.parse_json(F.lit(m.example)))
        picked = F.when(same, turns(m)) if picked is None else picked.when(same, turns(m))
        known = same if known is None else known | same
    empty = F.array().cast(TURNS)
    return known, F.coalesce(picked.otherwise(empty), empty)


def _part_turns(m: Mapping, value: Callable[[str], Column]) -> Column:
    return F.array(*[F.struct((value(r) if r.startswith("$") else F.lit(r)).alias("role"), value(p).alias("text")) for r, p in m.parts])


def canonical_turns(records: DataFrame, json_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Add ``layout`` (fingerprint, null if unknown) and ``turns`` (role, text) to records in JSON.

    The mapping is picked by the fingerprint alone. A record of unknown layout, a null and text that is not
    JSON have no turns (an empty array); a null field of a known layout is an empty text. A record of more
    than READABLE bytes that the JSON reader refuses ends the job with an error, since its turns are unknown.
    """
    text = F.col(json_col)
    variant = F.try_parse_json(text)
    found = fingerprint(variant)

    def value(path: str) -> Column:
        return F.coalesce(F.try_variant_get(variant, path, "string"), F.lit(""))

    def turns(m: Mapping) -> Column:
        if m.turns:
            kind = f"array<struct<`{m.role}`:string,`{m.text}`:string>>"
            return F.transform(F.try_variant_get(variant, m.turns, kind), lambda t: F.struct(
                F.coalesce(t[m.role], F.lit("")).alias("role"), F.coalesce(t[m.text], F.lit("")).alias("text")))
        return _part_turns(m, value)

    known, picked = _pick(found, turns, mappings)
    refused = variant.isNull() & (F.octet_length(text) > READABLE)
    error = F.raise_error(F.concat(F.lit("the JSON reader refused a record of this many bytes: "), F.octet_length(text))).cast(TURNS)
    return records.withColumns({"layout": F.when(known, found), "turns": F.when(refused, error).otherwise(picked)})


def column_turns(rows: DataFrame, fields: dict[str, str], mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Add ``layout`` and ``turns`` as ``canonical_turns`` does for records of string columns (field -> column).

    The layout is that of a record with these fields and empty texts; the texts come from the columns, so
    they meet no JSON reader and no limit of it. Mappings that need other fields are passed over.
    """
    found = fingerprint(F.parse_json(F.to_json(F.struct(*[F.lit("").alias(f) for f in fields]))))

    def value(path: str) -> Column:
        return F.coalesce(F.col(fields[path[2:]]), F.lit(""))

    flat = tuple(m for m in mappings if not m.turns and all(p[2:] in fields for pair in m.parts for p in pair if p.startswith("$")))
    known, picked = _pick(found, lambda m: _part_turns(m, value), flat)
    return rows.withColumns({"layout": F.when(known, found), "turns": picked})


def escape(text: Column, codes: tuple[tuple[str, str], ...] = CODES) -> Column:
    """``text`` without any control string: backslashes are doubled, then control strings become codes."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for plain, code in codes:
        out = F.replace(out, F.lit(plain), F.lit(code))
    return out


def unescape(text: Column, codes: tuple[tuple[str, str], ...] = CODES) -> Column:
    """The inverse: a code never follows an odd number of backslashes, so it is safe between double ones."""
    def part(p: Column) -> Column:
        for plain, code in codes:
            p = F.replace(p, F.lit(code), F.lit(plain))
        return p

    return F.array_join(F.transform(F.split(text, r"\\\\"), part), "\\")


def format_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(HEAD), escape(role, ROLE_CODES), F.lit(": "), escape(text), F.lit(END))


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                         text_col: str = "text", train_on: str = "assistant") -> DataFrame:
    """One formatted text per conversation from rows by turn: conv_id, formatted, masks.

    Rows are records of a role and a text, go through ``column_turns`` and are formatted one by one. ``masks`` has for each
    turn the characters to skip and then to train on (those of the escaped text of ``train_on`` turns). Turns
    go by turn, then by what is written for them; nulls first. A null role or text is empty, repeated rows are repeated turns,
    rows with a null id are one conversation, an empty table gives an empty result, other columns are ignored.
    Chunks of turns are concatenated first, so the task of a conversation gets few rows, whatever its length.
    """
    fields = rows.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.col(role_col).cast("string").alias("own_role"), F.col(text_col).cast("string").alias("own_text"))
    turns = column_turns(fields, {"role": "own_role", "text": "own_text"})
    single = turns.select("conv_id", "turn", F.inline("turns"))
    body = F.length(escape(F.col("text")))
    whole = F.length(F.col("line"))
    take = F.when(F.col("role") == train_on, body).otherwise(0)
    lines = single.withColumn("line", format_turn(F.col("role"), F.col("text"))).select(
        "conv_id", "turn", F.floor(F.col("turn") / CHUNK).alias("chunk"), "line",
        F.struct((whole - len(END) - take).alias("skip"), take.alias("take"), F.lit(len(END)).alias("tail")).alias("mask"))
    chunks = lines.groupBy("conv_id", "chunk").agg(
        F.sort_array(F.collect_list(F.struct("turn", "line", "mask"))).alias("t"))
    joined = chunks.select("conv_id", "chunk", F.array_join("t.line", "").alias("part"), F.col("t.mask").alias("part_masks"))
    return joined.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "part", "part_masks"))).alias("c")).select(
        "conv_id", F.array_join("c.part", "").alias("formatted"), F.flatten("c.part_masks").alias("masks"))


def parse_formatted(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text; the exact inverse of the template."""
    lines = F.split(formatted, END)

    def turn(line: Column) -> Column:
        head = F.substring_index(line, ":", 1)
        return F.struct(
            unescape(F.substring(head, len(HEAD) + 1, F.length(head)), ROLE_CODES).alias("role"),
            unescape(F.substring(line, F.length(head) + 3, F.length(line))).alias("text"))

    return let(lines, lambda a: F.transform(F.slice(a, 1, F.size(a) - 1), turn))


def masked_text(formatted: Column, masks: Column) -> Column:
    """All text under the loss mask, unescaped and joined. Lines and masks go in step, so it stays linear."""
    lines = F.split(formatted, END)
    return F.array_join(F.zip_with(lines, masks, lambda line, m: F.when(m["take"] > 0, unescape(F.substring(
        line, m["skip"] + 1, m["take"]))).otherwise("")), "")


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Counts and digests of formatted conversations, read back from the formatted text."""
    turns = let(parse_formatted(F.col("formatted")), lambda t: F.struct(
        F.size(t).cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256")))
    loss = let(masked_text(F.col("formatted"), F.col("masks")), lambda s: F.struct(
        F.length(s).cast("long").alias("loss_chars"), F.sha2(s, 256).alias("loss_sha256")))
    return formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), turns.alias("t"), loss.alias("l")).select(
        "conv_id", "t.n_turns", "t.turns_sha256", "l.loss_chars", "l.loss_sha256", "formatted_chars")


#: A conversation whose texts hold every control string of common templates.
PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"


def with_probe(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """``rows`` plus the probe conversation of a user and an assistant turn."""
    probe = spark.createDataFrame(
        [(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", "role", "text").unionByName(probe)
