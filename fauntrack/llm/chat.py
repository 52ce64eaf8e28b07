r"""Chat formatting by event-sourced reconstruction.

A log of events is partitioned by conversation and sorted by sequence; a
streaming fold turns each message's opening, deltas, edits and regenerations
into its final text, and the renderer writes one self-delimiting turn per
message together with the span that carries loss. Only one message is held in
memory at a time, whatever the length of a conversation.

Events: conv_id, seq, target (sequence number of the event that opened the
message; null: this event opens one), kind, role, text.
kind: message (opens with a text), delta (appends), edit (replaces the text),
regenerate (discards the text; deltas follow), null counts as message.

Template: "### <Role>: " + escaped text + " </turn>\n". Inside texts every
backslash is doubled and "### " at any place and "</turn>" get a backslash in
front, so no text can open or close a turn; unescape() is the exact inverse.

Defined results: null text is empty; null role renders as an empty role; a
null conv_id is a conversation of its own; events of one sequence number are
ordered by kind, role and text, repeated rows stay repeated turns; an event
whose target never opened opens it; an empty log gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table

# The template's control strings.
OPEN, SEPARATOR, CLOSE = "### ", ": ", " </turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>")
_ESCAPED = re.compile(r"\\(.)", re.S)
TRAINED_ROLE = "assistant"
CONTRACT_TEXT = "\\### Assistant: </turn> ok"


def escape(text: str) -> str:
    """Puts a backslash before every backslash and every control string."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _role_out(role: str) -> str:
    """Roles are escaped too, with the separator's colon marked, so that any role survives."""
    return escape(role).replace(":", "\\:")


def render(role: str, text: str) -> tuple[str, int, int]:
    """Formatted turn and the loss span inside it (empty for roles that are not trained)."""
    head = f"{OPEN}{_role_out(role)}{SEPARATOR}"
    body = escape(text)
    end = len(head) + len(body)
    return head + body + CLOSE, len(head) if role == TRAINED_ROLE else end, end


_ROLE = re.compile(r"(?:[^\\:]|\\.)*", re.S)


def read_turn(formatted: str, at: int = 0) -> tuple[str, str, int]:
    """Role, text and end of the turn that starts at `at`: reads back what render wrote."""
    if not formatted.startswith(OPEN, at):
        raise ValueError(f"no turn starts at {at}")
    k = at + len(OPEN)
    m = _ROLE.match(formatted, k)
    role, k = unescape(m[0]), m.end() + len(SEPARATOR)
    # an escaped close has a backslash right before "</turn>", so the first " </turn>" is the real one
    end = formatted.index(CLOSE, k)
    return role, unescape(formatted[k:end]), end + len(CLOSE)


_TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
_TURNS_DDL = "conv_id long, turn long, formatted string, loss_start long, loss_end long"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition sorted by conversation, message and sequence -> one row per final message."""
    out: list[tuple] = []
    none = object()
    key: object = none
    conv: object = none
    role, parts, turn = "", [], 0

    def close() -> None:
        nonlocal turn
        if key is not none:
            formatted, start, end = render(role, "".join(parts))
            out.append((conv_now, turn, formatted, start, end))
            turn += 1

    conv_now = None
    for batch in batches:
        size = 0
        for c, opened, target, kind, r, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "opened", "target", "kind", "role", "text")), strict=True):
            kind, text = kind or "message", text or ""
            opens = target is None or key is none or conv != c or key != opened
            if opens:
                close()
                if conv != c or key is none:
                    turn = 0
                conv, conv_now, key, role, parts = c, c, opened, r or "", [text] if kind != "regenerate" else []
            elif kind == "delta":
                parts.append(text)
            elif kind == "regenerate":
                parts = []
            else:  # an edit, or a message that opens the same target again
                parts = [text]
                role = r or role
            size += len(text)
            if len(out) >= 1000 or size > 4_000_000:
                yield _batch(out)
                out, size = [], 0
    close()
    if out:
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _TURNS, strict=True)], schema=_TURNS)


def format_chats(events: DataFrame) -> DataFrame:
    """Formatted turns, in order inside each partition: conv_id, turn, formatted, loss_start, loss_end.

    The formatted text of a conversation is the concatenation of its turns; it
    stays in pieces, so that a conversation of any length passes through.
    """
    spark = events.sparkSession
    log = events.select("conv_id", F.coalesce("target", "seq").alias("opened"), "target", "seq", "kind", "role", "text")
    log = log.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "opened", F.col("target").isNotNull(), "seq", "kind", "role", "text")
    return log.mapInArrow(_fold, _TURNS_DDL)


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
_DIGEST_DDL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation, read from the formatted turns alone."""
    none = object()
    conv: object = none
    rows: list[tuple] = []
    n = loss_chars = chars = 0
    turns = loss = hashlib.sha256()

    def close() -> None:
        if conv is not none:
            rows.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))

    for batch in batches:
        for c, formatted, start, end in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
            if conv is none or c != conv:
                close()
                conv, n, loss_chars, chars, turns, loss = c, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            role, text, stop = read_turn(formatted)
            if stop != len(formatted):
                raise ValueError(f"conversation {c}: a turn does not end where its piece ends")
            turns.update(f"{role}\n{text}\n".encode())
            masked = unescape(formatted[start:end])
            loss.update(masked.encode())
            loss_chars += len(masked)
            chars += len(formatted)
            n += 1
        if len(rows) >= 1000:
            yield pa.record_batch([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _DIGEST, strict=True)], schema=_DIGEST)
            rows = []
    close()
    if rows:
        yield pa.record_batch([pa.array(x, t.type) for x, t in zip(zip(*rows, strict=True), _DIGEST, strict=True)], schema=_DIGEST)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests per conversation of format_chats' result; it needs the order that format_chats leaves."""
    return formatted.mapInArrow(_read_back, _DIGEST_DDL)


def conversation_events(conversations: DataFrame) -> DataFrame:
    """A table of whole turns as a log: each row opens a message of its own."""
    none = F.lit(None)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"), none.cast("long").alias("target"), F.lit("message").alias("kind"), "role", "text")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the contract's conversation -7, formatted and read back."""
    extra = spark.createDataFrame([(-7, 0, None, "message", "user", CONTRACT_TEXT), (-7, 1, None, "message", "assistant", CONTRACT_TEXT)], "conv_id long, seq long, target long, kind string, role string, text string")
    return read_back(format_chats(conversation_events(table(spark, sf_dir, "conversations")).unionByName(extra)))


OP4_SQL = r"""
WITH c AS (
 SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, '### ' || replace(regexp_replace(role, '(\\|###|</turn>)', '\\\1', 'g'), ':', '\:') || ': ' || regexp_replace(text, '(\\|###|</turn>)', '\\\1', 'g') || ' </turn>' || chr(10) AS f FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
 sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
 CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
 sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
 CAST(sum(length(f)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
