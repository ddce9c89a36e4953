"""Chat formatting: the fingerprint of a layout's nested field paths selects a declarative mapping to canonical turns."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Layouts by their field paths ([] is a list). `turns` says where the texts are: a list with the names of its role and
#: text fields, or fixed roles with their fields, of which `?` may be missing or empty; several fields make one text.
LAYOUTS = [
    {"name": "turn rows", "paths": ["conv_id", "turn", "role", "text"], "rows": ("conv_id", "turn", "role", "text")},
    {"name": "messages", "paths": ["messages[].role", "messages[].content"], "list": ("messages", "role", "content")},
    {"name": "conversations", "paths": ["conversations[].from", "conversations[].value"], "list": ("conversations", "from", "value")},
    {"name": "dialog", "paths": ["dialog[].speaker", "dialog[].text"], "list": ("dialog", "speaker", "text")},
    {"name": "prompt and completion", "paths": ["prompt", "completion"], "turns": [("user", ["prompt"]), ("assistant", ["completion"])]},
    {"name": "prompt and response", "paths": ["prompt", "response"], "turns": [("user", ["prompt"]), ("assistant", ["response"])]},
    {"name": "system, prompt and response", "paths": ["system", "prompt", "response"],
     "turns": [("system", ["?system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    {"name": "question and answer", "paths": ["question", "answer"], "turns": [("user", ["question"]), ("assistant", ["answer"])]},
    {"name": "instruction and output", "paths": ["instruction", "output"], "turns": [("user", ["instruction"]), ("assistant", ["output"])]},
    {"name": "instruction, input and output", "paths": ["instruction", "input", "output"],
     "turns": [("user", ["instruction", "?input"]), ("assistant", ["output"])]},
]
#: Names that other layouts give to roles.
ROLES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
#: Control strings of this template and of common ones; in texts a backslash behind the first character breaks them.
CONTROLS = ["<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
            "<|im_start|>", "<|im_end|>", "<|startoftext|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>"]
_START = re.compile("(?=" + "|".join(map(re.escape, CONTROLS)) + ")(.)", re.S)
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>", re.S)


def escape(text: str) -> str:
    return _START.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


KNOWN = {p for layout in LAYOUTS for p in layout["paths"]}


def fingerprint(paths) -> str:
    """Hash of the field paths that any layout knows; other fields of a record make no difference."""
    return hashlib.sha256("\n".join(sorted(KNOWN.intersection(paths))).encode()).hexdigest()


MAPPINGS = {fingerprint(layout["paths"]): layout for layout in LAYOUTS}


def layout_within(paths: set[str]) -> dict | None:
    """The layout with most field paths among those whose paths are all there; none if two have as many."""
    fits = sorted((x for x in LAYOUTS if paths.issuperset(x["paths"])), key=lambda x: -len(x["paths"]))
    clear = fits and (len(fits) == 1 or len(fits[0]["paths"]) > len(fits[1]["paths"]))
    return MAPPINGS[fingerprint(fits[0]["paths"])] if clear else None


def value_paths(value, at: str = "") -> set[str]:
    """Nested field paths of a decoded JSON value."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in value_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in value_paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Nested field paths of a table."""
    if isinstance(kind, T.StructType):
        return {p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)}
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def mapped(record: dict) -> tuple[str | None, list[tuple[str, str]]]:
    """Layout name and canonical turns (role, text) of one decoded record; no name if no mapping fits."""
    layout = MAPPINGS.get(fingerprint(value_paths(record)))
    if layout is None or "rows" in layout:
        return None, []
    text = lambda v: "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    if "list" in layout:
        name, role, content = layout["list"]
        pairs = [(text(m.get(role)), text(m.get(content))) for m in record[name]]
    else:
        pairs = []
        for role, fields in layout["turns"]:
            parts = [text(record.get(f.lstrip("?"))) for f in fields if not f.startswith("?") or record.get(f[1:])]
            if parts:
                pairs.append((role, "\n\n".join(parts)))
    return layout["name"], [(ROLES.get(r.strip().lower(), r), t) for r, t in pairs]


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, record in zip(batch.column("key").to_pylist(), batch.column("record").to_pylist()):
            try:
                value = json.loads(record or "null")
            except ValueError:
                value = None
            name, pairs = mapped(value) if isinstance(value, dict) else (None, [])
            rows += [(key, name, i, r, t) for i, (r, t) in enumerate(pairs)] or [(key, None, None, None, None)]
        columns = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()))],
                                         ["conv_id", "layout", "turn", "role", "text"])


def turns_of_records(records: DataFrame, key: str, record: str) -> DataFrame:
    """Canonical turns of JSON records of any mix of layouts: conv_id, layout, turn, role, text. A record that is null,
    broken, empty or of an unknown layout gives one row of nulls beside its key, so none goes unseen."""
    rows = records.select(F.col(key).cast("long").alias("key"), F.col(record).alias("record"))
    return rows.mapInArrow(_records, "conv_id long, layout string, turn long, role string, text string")


def turns_of_table(table: DataFrame, key: str = "conv_id") -> DataFrame:
    """Canonical turns of a table in one layout, told by its schema: conv_id, turn, role, text.

    Extra columns are ignored, also where other layouts know their names: the layout with most paths that are all there is taken.
    """
    paths = schema_paths(table.schema)
    layout = MAPPINGS.get(fingerprint(paths)) or MAPPINGS.get(fingerprint(paths - {key})) or layout_within(paths)
    if layout is None:
        raise ValueError("no mapping for the field paths " + ", ".join(sorted(paths)))
    if "rows" in layout:
        conv, turn, role, text = (F.col(c) for c in layout["rows"])
    elif "list" in layout:
        name, of_role, of_text = layout["list"]
        table = table.select(F.col(key), F.posexplode(name).alias("at", "m"))
        conv, turn, role, text = F.col(key), F.col("at"), F.col(f"m.{of_role}"), F.col(f"m.{of_text}")
    else:
        def joined(fields):
            return F.concat_ws("\n\n", *[F.when(F.col(f[1:]) != "", F.col(f[1:])) if f[0] == "?" else F.coalesce(F.col(f), F.lit("")) for f in fields])
        made = [F.when(F.lit(fields[0][0] != "?") | (joined(fields) != ""), F.struct(F.lit(role).alias("r"), joined(fields).alias("t"))) for role, fields in layout["turns"]]
        table = table.select(F.col(key), F.posexplode(F.array_compact(F.array(*made))).alias("at", "m"))
        conv, turn, role, text = F.col(key), F.col("at"), F.col("m.r"), F.col("m.t")
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    role = F.coalesce(names[F.lower(F.trim(role))], role) if "rows" not in layout else role
    return table.select(conv.cast("long").alias("conv_id"), turn.cast("long").alias("turn"), role.alias("role"), text.alias("text"))


PIECES = "conv_id long, turn_no long, start long, piece string, loss_start long, loss_end long"
_NAMES = [p.split()[0] for p in PIECES.split(", ")]


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns sorted by conversation; one piece of the formatted conversation each, with its place."""
    conv, number, place, begun = None, 0, 0, False
    for batch in batches:
        rows = []
        for c, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "role", "text"))):
            if not begun or c != conv:
                conv, number, place, begun = c, 0, 0, True
            head, body = f"<|turn|>{escape(role or '')}<|text|>", escape(text or "")
            piece = f"{head}{body}<|end|>"
            loss = role == "assistant"
            rows.append((c, number, place, piece, place + len(head) if loss else None, place + len(head) + len(body) if loss else None))
            number, place = number + 1, place + len(piece)
        columns = list(zip(*rows)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], _NAMES)


def formatted(turns: DataFrame) -> DataFrame:
    """The formatted text of each conversation in pieces, one a turn, in order: conv_id, turn_no, start, piece and the
    loss span (of the assistant's text); places count code points of the whole formatted text.

    Turns are ordered by turn, then role and text; a null role or text is empty; rows without conv_id are one
    conversation. Rows are shuffled once by conversation and streamed through sorted, so that a conversation of any
    length needs the memory of one turn.
    """
    rows = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_format, PIECES)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, conv = None, None

    def row():
        return (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    def batch_of(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [p.split()[0] for p in READ.split(", ")])

    for batch in batches:
        rows = []
        for c, start, piece, first, last in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "start", "piece", "loss_start", "loss_end"))):
            if state is None or c != conv:
                if state is not None:
                    rows.append(row())
                conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in _TURN.findall(piece):
                state[0] += 1
                state[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
            if first is not None:
                learned = unescape(piece[first - start:last - start])
                state[2] += len(learned)
                state[3].update(learned.encode())
            state[4] += len(piece)
        if rows:
            yield batch_of(rows)
    if state is not None:
        yield batch_of([row()])


def read_back(pieces: DataFrame) -> DataFrame:
    """What the output of `formatted` says when it is parsed again, a row per conversation; it must come as that function
    leaves it, sorted within partitions."""
    return pieces.mapInArrow(_read, READ)
