"""Chat formatting from event logs.

A log holds each conversation as events: messages open, their text streams in
as deltas, is edited, or is generated anew. The log is partitioned by
conversation, sorted by sequence and folded into final messages, which are
rendered with turn marks and a loss mask.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.llm.common import to_batch
from pagewright.session import materialize

START, END = "<|im_start|>", "<|im_end|>\n"
# Strings that training code may read as marks: the first character, then the rest.
CONTROL = (
    ("<", "|im_start|>"), ("<", "|im_end|>"), ("<", "|endoftext|>"), ("<", "|system|>"), ("<", "|user|>"),
    ("<", "|assistant|>"), ("<", "s>"), ("<", "/s>"), ("<", "<SYS>>"), ("<", "</SYS>>"), ("[", "INST]"), ("[", "/INST]"),
)
_RESTS = {first: "|".join(re.escape(rest) for lead, rest in CONTROL if lead == first) for first in "<["}
_ESCAPED = re.compile("|".join(rf"(?<={re.escape(first)})\\(?=\\*(?:{rests}))" for first, rests in _RESTS.items()))
_DELTA = r"(?s).{1,512}"

EVENT = "conv_id long, seq long, message long, part long, kind string, role string, text string"


def events_of_turns(turns: DataFrame) -> DataFrame:
    """The event log of ``turns(conv_id, turn, role, text)``: each row opens a message and streams its text.

    Turns are the sequence; a null one comes first. Rows that repeat a turn are
    messages of their own, ordered by role and text.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("seq"),
        F.monotonically_increasing_id().alias("message"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    deltas = F.transform(F.regexp_extract_all("text", F.lit(_DELTA), F.lit(0)), lambda d, i: F.struct(
        (i + 1).cast("long").alias("part"), F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), d.alias("text")))
    opened = F.struct(F.lit(0).cast("long").alias("part"), F.lit("open").alias("kind"), F.col("role"), F.lit(None).cast("string").alias("text"))
    events = F.concat(F.array(opened), F.coalesce(deltas, F.array().cast(
        "array<struct<part:bigint,kind:string,role:string,text:string>>")))
    return rows.select("conv_id", "seq", "message", F.explode(events).alias("e")).select("conv_id", "seq", "message", "e.*").select(
        "conv_id", "seq", "message", "part", "kind", "role", "text")


def _place() -> Column:
    """The place of an event in its conversation; nulls first."""
    return F.struct("seq", "part")


def _withdrawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Messages that a regeneration of an earlier message takes back.

    Control events come sorted by conversation and place. ``live`` holds a
    number for each message that stands so far; a regeneration cuts it behind
    its message. Events of messages that are not open have no effect.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("message", pa.int64())])
    conversation, live, at = object(), [], {}
    for batch in batches:
        gone = []
        for conv_id, message, kind in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "message", "kind"))):
            if conv_id != conversation:
                conversation, live, at, closed = conv_id, [], {}, set()
            if kind == "open":
                if message not in at and message not in closed:
                    at[message] = len(live)
                    live.append(message)
            elif message in at:
                while len(live) > at[message] + 1:
                    last = live.pop()
                    del at[last]
                    closed.add(last)
                    gone.append((conv_id, last))
        yield to_batch({"conv_id": [c for c, _ in gone], "message": [m for _, m in gone]}, schema)


def fold_messages(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, place, role, text)`` of an event log.

    ``events`` has conv_id, seq, message (which message of the conversation),
    part (order within a seq), kind, role and text. ``open`` starts a message
    with a role, ``delta`` appends text, ``edit`` replaces the text so far,
    ``regenerate`` empties it and takes back all messages opened later, whose
    other events then have no effect. Unknown kinds, and events of messages that
    are not open yet, have none either. A message opened twice is opened once, at the first place.

    Order within a conversation is seq, then part, nulls first; messages opened
    at one place go by role and text. Null texts are empty, a null role is an
    empty one, rows without a conversation id form one conversation. ``place``
    counts from 0. An empty log gives no rows, other columns are ignored.

    One exchange, by conversation, carries text. A conversation is sorted by one
    task, which spills and holds one message at a time; finding what was taken
    back needs only the events without text of conversations that have
    regenerations, and a number for each of their messages.
    """
    control = events.where(F.col("kind").isin("open", "regenerate")).select("conv_id", "seq", "part", "message", "kind")
    again = events.where("kind = 'regenerate'").select(F.col("conv_id").alias("_c")).distinct()
    some = control.join(again, F.col("conv_id").eqNullSafe(F.col("_c")), "left_semi")
    withdrawn = materialize(
        some.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "part", "message").mapInArrow(
            _withdrawn, "conv_id long, message long"), "withdrawn")
    gone = withdrawn.select(F.col("conv_id").alias("_c"), F.col("message").alias("_m"))
    standing = events.join(gone, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("message") == F.col("_m")), "left_anti")
    opens, resets = F.col("kind") == "open", F.col("kind").isin("edit", "regenerate")
    texts = F.sort_array(F.collect_list(F.when(
        F.col("kind").isin("delta", "edit"), F.struct("seq", "part", F.coalesce("text", F.lit("")).alias("text")))))
    messages = standing.repartition("conv_id").groupBy("conv_id", "message").agg(
        F.min(F.when(opens, F.struct("seq", "part", "role"))).alias("opened"), F.max(F.when(resets, _place())).alias("reset"), texts.alias("texts"),
    ).where("opened is not null")
    since = F.array_max(F.array(F.struct("opened.seq", "opened.part"), F.coalesce("reset", F.struct("opened.seq", "opened.part"))))
    kept = F.filter("texts", lambda t: F.struct(t["seq"], t["part"]) >= F.col("since"))
    text = F.array_join(F.transform(kept, lambda t: t["text"]), "")
    final = messages.withColumn("since", since).select("conv_id", "message", "opened", text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy("opened.seq", "opened.part", "opened.role", "text", "message")
    return final.select("conv_id", (F.row_number().over(order) - 1).cast("long").alias("place"), F.coalesce("opened.role", F.lit("")).alias("role"), "text")


def escape(text: Column) -> Column:
    """Every control string gets a backslash after its first character, one more where it has some."""
    for first, rests in _RESTS.items():
        text = F.regexp_replace(text, rf"(?<={re.escape(first)})(?=\\*(?:{rests}))", r"\\")
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub("", text)


def render(messages: DataFrame) -> DataFrame:
    """``messages`` with ``piece``, their formatted text, and the loss mask.

    A conversation's formatted text is its pieces in order of ``place``. In a
    piece the role stands behind the start mark, the text on the lines after it,
    then the end mark. ``loss_from`` and ``loss_to`` bound the code points that
    count for the loss: the text of an assistant. They are null elsewhere.
    """
    role = F.regexp_replace(F.regexp_replace(escape(F.col("role")), r"\\", r"\\\\"), "\n", r"\\n")
    head, body = F.concat(F.lit(START), role, F.lit("\n")), escape(F.col("text"))
    learns = F.col("role") == "assistant"
    return messages.withColumns({"piece": F.concat(head, body, F.lit(END)), "loss_from": F.when(learns, F.length(head)),
                                 "loss_to": F.when(learns, F.length(head) + F.length(body))})


def format_log(events: DataFrame) -> DataFrame:
    """Formatted messages of an event log, see ``fold_messages`` and ``render``."""
    return render(fold_messages(events)).select("conv_id", "place", "role", "text", "piece", "loss_from", "loss_to")


_PIECE = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END), re.S)
_ROLE = re.compile(r"\\(\\|n)")
_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                   ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_turn(piece: str) -> tuple[str, str]:
    """Role and text of a formatted message."""
    role, text = _PIECE.fullmatch(piece).groups()
    return unescape(_ROLE.sub(lambda m: "\n" if m[1] == "n" else "\\", role)), unescape(text)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    started, conversation, turns = False, None, 0

    def done() -> tuple:
        return conversation, turns, spoken.hexdigest(), learned, loss.hexdigest(), chars

    for batch in batches:
        out = []
        for conv_id, piece, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "piece", "loss_from", "loss_to"))):
            if not started or conv_id != conversation:
                if started:
                    out.append(done())
                started, conversation, turns, learned, chars = True, conv_id, 0, 0, 0
                spoken, loss = hashlib.sha256(), hashlib.sha256()
            role, text = read_turn(piece)
            spoken.update(f"{role}\n{text}\n".encode())
            if a is not None:
                masked = unescape(piece[a:b])
                loss.update(masked.encode())
                learned += len(masked)
            turns += 1
            chars += len(piece)
        yield to_batch(dict(zip(_READ.names, zip(*out))) if out else dict.fromkeys(_READ.names, ()), _READ)
    if started:
        yield to_batch(dict(zip(_READ.names, zip(*[done()]))), _READ)


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say, one row each, read from their pieces.

    Digests run over a conversation in order, so one task reads it, in batches.
    """
    order = Window.partitionBy("conv_id").orderBy("place")
    # Numbering brings a conversation together, without an exchange where it is already; unread, it would be dropped.
    ordered = formatted.select("conv_id", F.row_number().over(order).alias("number"), "piece", "loss_from", "loss_to")
    return ordered.mapInArrow(_read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
