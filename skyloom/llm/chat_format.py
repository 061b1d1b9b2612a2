"""Chat formatting by prefix-target expansion.

Each assistant turn becomes an example of its own: all turns before it as context, then its text, the only part under
the loss mask. If a conversation doesn't end with an assistant turn, a last example holds all its turns, with an empty
mask, so that the examples hold the whole conversation. Template: `<s>`, then `[INST] role`, a line feed, the text and
` [/INST]` for other turns, a blank, the text and `</s>` for assistant turns. Backslashes in texts are doubled and
control strings get one after their first character, so no control string is left in a text and the text can be read
back; roles are percent-encoded.

Turns are sorted by turn, role and text, null first, in the partition of their conversation and flow through in order,
an example at a time: a task holds one conversation's text once, not its examples. Null text and role count as empty; a
null conv_id is a conversation. Repeated rows are turns of their own; an empty table gives an empty result; other
columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, table

START, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
CONTROLS = (START, OPEN, CLOSE, END)
ASSISTANT = "assistant"
#: Characters of examples that a batch holds before it is passed on.
BATCH_CHARS = 4_000_000
_BACK = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for c in CONTROLS:
        text = text.replace(c, f"{c[0]}\\{c[1:]}")
    return text


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn in the template, and where its text stands in it."""
    body = escape(text)
    head = " " if role == ASSISTANT else f"{OPEN} {quote(role)}\n"
    return f"{head}{body}{END if role == ASSISTANT else f' {CLOSE}'}", len(head), len(head) + len(body)


def parse(example: str) -> list[tuple[str, str]]:
    """The (role, text) of an example's turns."""
    if not example.startswith(START):
        raise ValueError("not an example")
    at, turns = len(START), []
    while at < len(example):
        if example.startswith(f"{OPEN} ", at):
            stop = example.index(CLOSE, at)
            role, _, body = example[at + len(OPEN) + 1 : stop - 1].partition("\n")
            turns.append((unquote(role), unescape(body)))
            at = stop + len(CLOSE)
        else:
            stop = example.index(END, at)
            turns.append((ASSISTANT, unescape(example[at + 1 : stop])))
            at = stop + len(END)
    return turns


class _Out:
    """Collects examples into batches."""

    NAMES = ("conv_id", "example", "text", "loss_start", "loss_stop", "last")
    KINDS = (pa.int64(), pa.int64(), pa.large_string(), pa.int64(), pa.int64(), pa.bool_())

    def __init__(self):
        self.rows, self.chars = [], 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.chars += len(row[2])

    def batch(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) or [()] * len(self.NAMES)
        self.rows, self.chars = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, k).cast(pa.string()) if k == pa.large_string() else pa.array(c, k) for c, k in zip(cols, self.KINDS)], names=self.NAMES)


def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns (conv_id, role, text) to examples. The newest example waits until it is known whether it is its conversation's last."""
    out, here, at, context, n, waiting, open_turns = _Out(), None, None, [], 0, None, False

    def rows():
        for b in batches:
            yield from zip(*(b.column(k).to_pylist() for k in range(3)))

    started = False
    for conv, role, text in rows():
        if not started or conv != here:
            if started:
                _finish(out, here, context, n, waiting, open_turns)
            here, at, context, n, waiting, open_turns, started = conv, len(START), [START], 0, None, False, True
        if waiting is not None:
            out.add(*waiting, False)
            waiting, n = None, n + 1
        piece, start, stop = format_turn(role or "", text or "")
        context.append(piece)
        open_turns = role != ASSISTANT
        if not open_turns:
            whole = "".join(context)
            context = [whole]
            waiting = (here, n, whole, at + start, at + stop)
        at += len(piece)
        if out.chars > BATCH_CHARS:
            yield out.batch()
    if started:
        _finish(out, here, context, n, waiting, open_turns)
    yield out.batch()


def _finish(out: _Out, conv, context: list[str], n: int, waiting, open_turns: bool) -> None:
    if waiting is not None:
        out.add(*waiting, True)
    elif open_turns:
        whole = "".join(context)
        out.add(conv, n, whole, len(whole), len(whole), True)


def format_chats(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), text, loss_start, loss_stop (places in text), last (whether it is its conversation's last)."""
    ship(conversations.sparkSession)
    turns = conversations.selectExpr("CAST(conv_id AS BIGINT) AS conv_id", "turn", "role", "text")
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return turns.mapInArrow(expand, "conv_id long, example long, text string, loss_start long, loss_stop long, last boolean")


def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation, from its examples in order."""
    rows, chars, loss_chars, loss = [], 0, 0, hashlib.sha256()
    for b in batches:
        for conv, text, start, stop, last in zip(*(b.column(k).to_pylist() for k in ("conv_id", "text", "loss_start", "loss_stop", "last"))):
            chars += len(text)
            target = unescape(text[start:stop])
            loss_chars += len(target)
            loss.update(target.encode())
            if last:
                turns, all_turns = parse(text), hashlib.sha256()
                for role, said in turns:
                    all_turns.update(f"{role}\n{said}\n".encode())
                rows.append((conv, len(turns), all_turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                chars, loss_chars, loss = 0, 0, hashlib.sha256()
        yield _digests(rows)
        rows = []
    yield _digests(rows)


def _digests(rows: list) -> pa.RecordBatch:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 6, kinds)], names=names)


def op8_chat_format(spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").selectExpr("CAST(conv_id AS BIGINT) AS conv_id", "CAST(turn AS BIGINT) AS turn", "role", "text")
    said = f"{END}{OPEN} ok {CLOSE}"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, ASSISTANT, said)], c.schema)
    examples = format_chats(c.unionByName(more))
    # Examples stay in their partition and order from the sort on, so they are read back as they come.
    return examples.mapInArrow(read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _oracle() -> str:
    """DuckDB SQL: the lengths of examples are running sums of those of their turns."""
    body = "replace(text, '\\', '\\\\')"
    for c in CONTROLS:
        body = f"replace({body}, '{c}', '{c[0]}\\{c[1:]}')"
    head = f"length({OPEN!r}) + 2 + length(replace(url_encode(role), '%2F', '/'))"
    said = f"{END}{OPEN} ok {CLOSE}"
    return f"""
WITH c AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, role, text FROM conversations UNION ALL VALUES (-7, 0, 'user', '{said}'), (-7, 1, '{ASSISTANT}', '{said}')),
o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
l AS (SELECT *, role = '{ASSISTANT}' AS mine, length({body}) AS n FROM o),
r AS (SELECT *, {len(START)} + sum(CASE WHEN mine THEN 1 + n + {len(END)} ELSE {head} + n + {1 + len(CLOSE)} END) OVER (PARTITION BY conv_id ORDER BY k) AS upto, max(k) OVER (PARTITION BY conv_id) AS last FROM l)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (mine), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (mine), '')) AS loss_sha256,
    coalesce(sum(upto) FILTER (mine OR k = last), 0)::BIGINT AS formatted_chars FROM r GROUP BY conv_id"""


ORACLE = _oracle()
