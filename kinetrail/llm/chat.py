"""Chat formatting by schema fingerprints.

A record's nested field paths (array steps as "[]") are cut to those that any
mapping knows, sorted and hashed; the hash picks a declarative mapping that says
where turns, roles and texts lie. Tables are mapped by the paths of their columns,
in columns; JSON records each by their own paths. The result is canonical turns (role, text), which one template writes:

    system     <<SYS>> text <</SYS>>
    user       [INST] text [/INST]
    assistant  <s> text </s>
    others     [ROLE name] text [/ROLE]

Control strings inside a text are escaped by one more backslash after their
first character, so that "<\\s>" and "<s>" both come back as they were. Only
assistant texts lie under the loss mask.

Defined results: null text is empty, a null role is the empty role, null turns
come last, turns with equal numbers are ordered by role and text; rows with a
null conversation id form one conversation; repeated rows are repeated turns; an
empty table gives no rows; an item that is null is an empty turn; a record that no mapping fits gives no turns and its
fingerprint is reported; unknown columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE ", "[/ROLE]")
_ESCAPE = re.compile("|".join(re.escape(c[0]) + r"\\*" + re.escape(c[1:]) for c in CONTROLS))
_ESCAPED = re.compile("|".join(re.escape(c[0]) + r"\\+" + re.escape(c[1:]) for c in CONTROLS))
_TURN = re.compile(
    r"<<SYS>> (?P<system>.*?) <</SYS>>|\[INST\] (?P<user>.*?) \[/INST\]|<s> (?P<assistant>.*?) </s>"
    r"|\[ROLE (?P<name>[^\]]*)\] (?P<other>.*?) \[/ROLE\]",
    re.DOTALL,
)
_FRAME = {"system": ("<<SYS>> ", " <</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns. With turns, role and text are fields of
    that array's elements; without, fixed lists each field's role in order."""

    paths: tuple[str, ...]
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    fixed: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)


NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
MAPPINGS = (
    Mapping(("conv_id", "turn", "role", "text")),
    Mapping(("messages[].role", "messages[].content"), "messages", "role", "content"),
    Mapping(("system", "messages[].role", "messages[].content"), "messages", "role", "content", (("system", "system"),)),
    Mapping(("conversations[].from", "conversations[].value"), "conversations", "from", "value", roles=NAMES),
    Mapping(("turns[].speaker", "turns[].text"), "turns", "speaker", "text", roles=NAMES),
    Mapping(("prompt", "response"), fixed=(("prompt", "user"), ("response", "assistant"))),
    Mapping(("prompt", "completion"), fixed=(("prompt", "user"), ("completion", "assistant"))),
    Mapping(("system", "prompt", "response"), fixed=(("system", "system"), ("prompt", "user"), ("response", "assistant"))),
    Mapping(("instruction", "output"), fixed=(("instruction", "user"), ("output", "assistant"))),
    Mapping(("instruction", "input", "output"), fixed=(("instruction+input", "user"), ("output", "assistant"))),
    Mapping(("question", "answer"), fixed=(("question", "user"), ("answer", "assistant"))),
)
KNOWN = frozenset(p for m in MAPPINGS for p in m.paths)


def fingerprint(paths: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths) & KNOWN)).encode()).hexdigest()[:16]


BY_FINGERPRINT = {fingerprint(m.paths): m for m in MAPPINGS}


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, prefix + "[]")
    return [prefix]


def value_paths(value: object, prefix: str = "") -> Iterator[str]:
    if isinstance(value, dict):
        for name, inner in value.items():
            yield from value_paths(inner, f"{prefix}.{name}" if prefix else name)
    elif isinstance(value, list):
        for inner in value:
            yield from value_paths(inner, prefix + "[]")
    else:
        yield prefix


def mapping_of(schema: T.StructType) -> Mapping:
    """The mapping that the field paths of a table select."""
    found = BY_FINGERPRINT.get(fingerprint(p for p in schema_paths(schema) if p != "conv_id" or "turn" in schema.names))
    if found is None:
        raise ValueError("no mapping for these columns")
    return found


def turn_rows(table: DataFrame) -> DataFrame:
    """Canonical turns (conv_id, turn, role, text) of a table of any known layout:
    one row per turn, or one row per conversation with nested or fixed fields."""
    mapping, text = mapping_of(table.schema), lambda c: F.coalesce(c.cast("string"), F.lit(""))
    conv = table["conv_id"].cast("long").alias("conv_id")
    if not (mapping.turns or mapping.fixed):
        return table.select(conv, table["turn"].cast("long").alias("turn"), text(table["role"]).alias("role"), text(table["text"]).alias("text"))
    fixed = []
    for source, role in mapping.fixed:
        parts = [F.when(text(table[c]) != "", table[c].cast("string")) for c in source.split("+")]
        fixed.append(F.struct(F.lit(role).alias("role"), F.concat_ws("\n", *parts).alias("text")))
    turns = F.array(*fixed) if fixed else None
    if mapping.turns:
        roles = F.create_map(*(F.lit(x) for pair in mapping.roles.items() for x in pair)) if mapping.roles else None

        def turn(item: Column) -> Column:
            role = text(item[mapping.role])
            role = role if roles is None else F.coalesce(roles[role], role)
            return F.struct(role.alias("role"), text(item[mapping.text]).alias("text"))

        nested = F.coalesce(F.transform(table[mapping.turns], turn), F.array().cast("array<struct<role:string,text:string>>"))
        turns = nested if turns is None else F.concat(turns, nested)
    return table.select(conv, F.posexplode(turns).alias("turn", "_turn")).select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "_turn.role", "_turn.text"
    )


def record_turns(record: dict) -> list[tuple[str, str]] | None:
    """Canonical turns of one record; None where no mapping fits."""
    mapping = BY_FINGERPRINT.get(fingerprint(value_paths(record)))
    if mapping is None or not (mapping.turns or mapping.fixed):
        return None
    turns = []
    for source, role in mapping.fixed:
        parts = [str(record[name]) for name in source.split("+") if record.get(name) not in (None, "")]
        turns.append((role, "\n".join(parts)))
    for item in record[mapping.turns] if mapping.turns else ():
        item = item if isinstance(item, dict) else {}
        role = "" if item.get(mapping.role) is None else str(item[mapping.role])
        text = "" if item.get(mapping.text) is None else str(item[mapping.text])
        turns.append((mapping.roles.get(role, role), text))
    return turns


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def format_turns(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and its loss mask as (start, end) spans."""
    out, at, spans = [], 0, []
    for role, text in turns:
        head, tail = _FRAME.get(role) or (f"[ROLE {quote(role, safe='')}] ", " [/ROLE]")
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        out += (head, body, tail)
        at += len(head) + len(body) + len(tail)
    return "".join(out), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        role = next(k for k in ("system", "user", "assistant", "other") if m[k] is not None)
        turns.append((unquote(m["name"]) if role == "other" else role, unescape(m[role])))
        at = m.end()
    return turns


FORMATTED_SCHEMA = "conv_id long, known boolean, formatted string, loss_starts array<long>, loss_ends array<long>"


def _rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Formats conversations that arrive sorted by id and turn; a conversation
    may run over several batches."""
    key, turns = None, []
    names = ["conv_id", "known", "formatted", "loss_starts", "loss_ends"]

    def closed() -> tuple:
        formatted, spans = format_turns(turns)
        return (*key, formatted, [s for s, _ in spans], [e for _, e in spans])

    for frame in frames:
        done = []
        for conv, known, role, text in zip(frame["conv"], frame["known"], frame["role"], frame["text"], strict=True):
            if (conv, known) != key:
                if key is not None:
                    done.append(closed())
                key, turns = (conv, known), []
            turns.append((role, text))
        yield pd.DataFrame(done, columns=names)
    if key is not None:
        yield pd.DataFrame([closed()], columns=names)


def format_rows(*tables: DataFrame) -> DataFrame:
    """Formats the conversations of tables, each of any known layout: conv_id,
    formatted, loss_starts, loss_ends."""
    rows = reduce(DataFrame.unionByName, map(turn_rows, tables))
    slim = rows.select(
        F.coalesce("conv_id", F.lit(0)).alias("conv"), F.col("conv_id").isNotNull().alias("known"), "turn", "role", "text"
    )
    dealt = slim.repartition("conv", "known").sortWithinPartitions(
        "conv", "known", F.col("turn").asc_nulls_last(), "role", "text"
    )
    return dealt.drop("turn").mapInPandas(_rows, FORMATTED_SCHEMA).select(
        F.when(F.col("known"), F.col("conv_id")).alias("conv_id"), "formatted", "loss_starts", "loss_ends"
    )


def format_records(records: DataFrame, id_col: str = "id", json_col: str = "record") -> DataFrame:
    """Formats JSON records of mixed layouts: id, fingerprint, formatted (null
    where no mapping fits), loss_starts, loss_ends."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, blob in zip(frame["id"], frame["record"], strict=True):
                try:
                    record = json.loads(blob) if blob else None
                except ValueError:
                    record = None
                turns = record_turns(record) if isinstance(record, dict) else None
                mark = fingerprint(value_paths(record)) if isinstance(record, dict) else None
                formatted, spans = format_turns(turns) if turns is not None else (None, [])
                out.append((key, mark, formatted, [s for s, _ in spans], [e for _, e in spans]))
            yield pd.DataFrame(out, columns=["id", "fingerprint", "formatted", "loss_starts", "loss_ends"])

    slim = records.select(records[id_col].cast("string").alias("id"), records[json_col].cast("string").alias("record"))
    return slim.mapInPandas(
        run, "id string, fingerprint string, formatted string, loss_starts array<long>, loss_ends array<long>"
    )


READ_SCHEMA = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted text and the loss mask say: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    @F.pandas_udf(READ_SCHEMA)
    def told(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
        out = []
        for text, s, e in zip(texts, starts, ends, strict=True):
            turns = parse_turns(text)
            spoken = "".join(f"{role}\n{said}\n" for role, said in turns)
            loss = "".join(unescape(text[i:j]) for i, j in zip(s, e, strict=True))
            out.append(
                (
                    len(turns),
                    hashlib.sha256(spoken.encode()).hexdigest(),
                    len(loss),
                    hashlib.sha256(loss.encode()).hexdigest(),
                    len(text),
                )
            )
        return pd.DataFrame(out, columns=[x.split()[0] for x in READ_SCHEMA.split(", ")])

    return formatted.select("conv_id", told("formatted", "loss_starts", "loss_ends").alias("r")).select("conv_id", "r.*")
