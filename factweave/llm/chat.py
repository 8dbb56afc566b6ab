"""Chat formatting: schema fingerprints select declarative mappings to canonical turns, and a reversible template.

A record is JSON. The set of its nested field paths (``messages[].role``) is hashed; the hash selects a mapping, which
names where turns, roles and texts lie. So prompt/completion pairs, instructions and message lists all become rows
(conversation, turn, role, text), and none is collected: each turn is formatted alone, and the formatted conversation
is its turns' pieces in order.

The template marks a turn as ``<|turn|>role``, a new line, the text, ``<|end|>`` and a new line. Inside roles and
texts no control string survives: a backslash is doubled, and ``\\.`` is put after the first sign of every place
where a control string begins. Both are undone when reading back.
"""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import arrow_batches

OPEN, CLOSE = "<|turn|>", "<|end|>"
#: Strings that chat templates give a meaning to.
CONTROL = (
    OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>",
    "<|system|>", "<|user|>", "<|assistant|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<|begin_of_text|>", "<|end_of_text|>",
    "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>", "<unk>", "<pad>",
)
#: Other names for roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "prompter": "user"}
_MARK = regex.compile("(?=" + "|".join(map(regex.escape, CONTROL)) + r")(.)|(\\)", regex.S)
_UNMARK = regex.compile(r"\\([\\.n])", regex.S)


@dataclass(frozen=True)
class Mapping:
    """Where canonical turns lie in a layout. ``each`` is the list of turns, with ``role`` and ``text`` in its items; without
    it ``turns`` gives (role, fields), whose non-empty texts are joined by a blank line. ``order`` names a turn's number."""

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    each: str | None = None
    role: str = ""
    text: str = ""
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    order: str | None = None


MAPPINGS = (
    Mapping("turn row", ("turn", "role", "text"), role="role", text="text", order="turn"),
    Mapping("messages", ("messages[].role", "messages[].content"), ("messages[].name", "id", "source"), each="messages", role="role", text="content"),
    Mapping("message parts", ("messages[].role", "messages[].content[].type", "messages[].content[].text"), ("id", "source"), each="messages", role="role", text="content"),
    Mapping("from/value", ("conversations[].from", "conversations[].value"), ("id", "source"), each="conversations", role="from", text="value"),
    Mapping("turns", ("turns[].role", "turns[].text"), ("id", "turns[].turn"), each="turns", role="role", text="text"),
    Mapping("instruction", ("instruction", "output"), ("input", "system", "id"), turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("prompt/completion", ("prompt", "completion"), ("system", "id"), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt/response", ("prompt", "response"), ("system", "id"), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question/answer", ("question", "answer"), ("context", "id"), turns=(("user", ("context", "question")), ("assistant", ("answer",)))),
)


def field_paths(value: object, at: str = "") -> set[str]:
    """The paths of all leaves; items of a list share one path, an empty list or object is a leaf."""
    if isinstance(value, dict) and value:
        return set().union(*(field_paths(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(field_paths(v, at + "[]") for v in value))
    return {at}


def fingerprint(paths: set[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def by_fingerprint(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    """Each mapping under the fingerprint of every choice of its optional paths; earlier mappings win."""
    found: dict[str, Mapping] = {}
    for m in mappings:
        for k in range(len(m.optional) + 1):
            for more in itertools.combinations(m.optional, k):
                found.setdefault(fingerprint({*m.paths, *more}), m)
    return found


def _text(value: object) -> str:
    if isinstance(value, list):
        return "".join(_text(v.get("text") if isinstance(v, dict) else v) for v in value)
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, m: Mapping) -> list[tuple[int, str, str]]:
    """(number, role, text) of each turn; empty optional parts give none, a mapped text that is null is empty."""
    if m.each:
        items = [t for t in record[m.each] if isinstance(t, dict)]
        return [(k, ROLES.get(_text(t.get(m.role)), _text(t.get(m.role))), _text(t.get(m.text))) for k, t in enumerate(items)]
    if m.order:
        return [(record[m.order], _text(record.get(m.role)), _text(record.get(m.text)))]
    found = []
    for role, fields in m.turns:
        texts = [_text(record.get(f)) for f in fields]
        if any(texts) or any(f in m.paths for f in fields):
            found.append((len(found), role, "\n\n".join(t for t in texts if t)))
    return found


def canonical_turns(records: DataFrame, id_col: str, record_col: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """(conv_id, turn, role, text, layout): a row for each turn. A record of unknown layout, or that is no JSON object, gives one
    row whose layout, turn, role and text are null. A null turn number stays null and comes last."""
    known = by_fingerprint(mappings)
    rows = records.select(F.col(f"`{id_col}`").alias("conv_id"), F.col(f"`{record_col}`").alias("record"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for k, raw in enumerate(batch.column("record").to_pylist()):
                try:
                    record = json.loads(raw or "null")
                except ValueError:
                    record = None
                m = known.get(fingerprint(field_paths(record))) if isinstance(record, dict) else None
                found = [(*t, m.name) for t in turns_of(record, m)] if m else [(None, None, None, None)]
                at += [k] * len(found)
                out += found
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column("conv_id").take(pa.array(at, pa.int32())), pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], names=["conv_id", "turn", "role", "text", "layout"])

    arrow_batches(records.sparkSession)
    return rows.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, turn long, role string, text string, layout string")


def escape(text: str) -> str:
    return _MARK.sub(lambda m: m[1] + r"\." if m[1] else r"\\", text)


def unescape(text: str) -> str:
    return _UNMARK.sub(lambda m: {"\\": "\\", ".": "", "n": "\n"}[m[1]], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The piece, and where the text begins and ends in it. A new line in a role is escaped as well."""
    head = OPEN + escape(role).replace("\n", r"\n") + "\n"
    body = escape(text)
    return head + body + CLOSE + "\n", len(head), len(head) + len(body)


def format_turns(turns: DataFrame, learned: str = "assistant") -> DataFrame:
    """(conv_id, turn, layout, piece, loss_start, loss_end): a row for each turn with a layout. The loss mask covers the texts of
    the role ``learned``, in code points of the piece; others have nulls. A conversation is its pieces by (turn, piece)."""
    rows = turns.filter("layout is not null").select("conv_id", "turn", "layout", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = batch.column("role").to_pylist()
            made = [format_turn(r, t) for r, t in zip(roles, batch.column("text").to_pylist())]
            masked = [r == learned for r in roles]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), batch.column("layout"), pa.array([m[0] for m in made], pa.string()), *(pa.array([m[k] if is_in else None for m, is_in in zip(made, masked)], pa.int64()) for k in (1, 2))],
                names=["conv_id", "turn", "layout", "piece", "loss_start", "loss_end"],
            )

    arrow_batches(turns.sparkSession)
    return rows.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, turn long, layout string, piece string, loss_start long, loss_end long")


class Reader:
    """Reads formatted text that comes in parts; gives each turn once it is whole."""

    _TURN = regex.compile(regex.escape(OPEN) + r"([^\n]*)\n(.*?)" + regex.escape(CLOSE) + "\n", regex.S)

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, part: str) -> Iterator[tuple[str, str]]:
        self.rest += part
        while m := self._TURN.match(self.rest):
            self.rest = self.rest[m.end() :]
            yield unescape(m[1]), unescape(m[2])


def read_back(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, read from its pieces: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Conversations stream through sorted partitions turn by turn with running digests, so that a very long one needs no more
    memory than a short one; one conversation is one task. Turns go by number, nulls last; turns that share a number go by piece, and
    repeated rows are repeated turns. A null id is a conversation. An empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        id_type, held = None, None

        def done(all_held: list) -> pa.RecordBatch:
            rows = [(h[0], h[1], h[2].hexdigest(), h[3], h[4].hexdigest(), h[5]) for h in all_held]
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            id_type, ended = batch.schema.field("conv_id").type, []
            for id_, piece, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_start", "loss_end"))):
                if held is None or held[0] != id_:
                    if held is not None:
                        ended.append(held)
                    held = [id_, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, Reader()]
                held[5] += len(piece)
                for role, text in held[6].feed(piece):
                    held[1] += 1
                    held[2].update(f"{role}\n{text}\n".encode())
                if start is not None:
                    loss = unescape(piece[start:end])
                    held[3] += len(loss)
                    held[4].update(loss.encode())
            if ended:
                yield done(ended)
        if held is not None:
            yield done([held])

    arrow_batches(formatted.sparkSession)
    rows = formatted.select("conv_id", "turn", "piece", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "piece")
    return rows.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def row_records(conversations: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(conv_id, record) from a table of turns: each row's turn, role and text as a record of the layout ``turn row``."""
    return conversations.select(F.col(f"`{id_col}`").alias("conv_id"), F.to_json(F.struct(F.col("turn").cast("long").alias("turn"), "role", "text"), {"ignoreNullFields": "false"}).alias("record"))
