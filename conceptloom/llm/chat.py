"""Chat formatting by event-sourced reconstruction.

A log holds events of conversations: ``message`` opens a message with a role and its first text, ``delta`` appends to it, ``edit``
replaces its text, ``regenerate`` discards it and starts anew. ``target`` is the sequence number of the message that an event
changes; without one it changes the last message opened before it. Events are dealt by conversation and message, sorted by sequence,
and folded as a stream: a task holds one message at a time, and a conversation of any length is spread over many tasks. Every final
message is rendered as one segment; the segments of a conversation, in order, are its training text.

Template: ``<|im_start|>role`` newline ``text<|im_end|>`` newline. A control string inside a text gets a backslash after its first
character (one more where there are backslashes), which is taken out again on reading, so nothing in a text can end a turn.

Edge cases: null texts and roles are empty; events that precede any message of their target are dropped; events of equal sequence
follow by kind (message first), role and text, and repeated ``message`` events are messages of their own; an empty log gives an empty
result; a null conversation id is a conversation of its own; events of a null or unknown kind are no events of this log and are dropped;
extra columns are ignored. A message of any length is folded in the memory of one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Control strings of common chat templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
START, END = "<|im_start|>", "<|im_end|>"
KINDS = ("message", "regenerate", "edit", "delta")

_TAIL = "|".join(re.escape(c[1:]) for c in CONTROL)
_PLAIN = re.compile(rf"([<\[])(\\*)({_TAIL})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_TAIL})")
_SEGMENT = re.compile(rf"{re.escape(START)}([^\n]*)\n(.*){re.escape(END)}\n", re.DOTALL)


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The segment of a message and where its text stands in it."""
    name = escape(role).replace("\\", "\\\\").replace("\n", "\\n")
    body = escape(text)
    head = f"{START}{name}\n"
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse(segment: str) -> tuple[str, str]:
    """Role and text of a segment."""
    m = _SEGMENT.fullmatch(segment)
    if not m:
        raise ValueError("not a segment")
    name = re.sub(r"\\(.)", lambda x: "\n" if x[1] == "n" else x[1], m[1])
    return unescape(name), unescape(m[2])


def _with_slots(log: DataFrame) -> DataFrame:
    """``slot``: the sequence number of the message that an event opens or changes. Only events without a target look for the last
    message before them, among the sequence numbers of their own conversations."""
    is_message = F.col("kind") == "message"
    direct = log.where(is_message | F.col("target").isNotNull()).withColumn("slot", F.when(is_message, F.col("seq")).otherwise(F.col("target")))
    loose = log.where(~is_message & F.col("target").isNull())
    opened = log.where(is_message).join(loose.select(F.col("conv_id").alias("_id")).distinct(), F.col("conv_id").eqNullSafe(F.col("_id")), "left_semi")
    marks = opened.select("conv_id", "seq", F.lit("message").alias("kind"), F.lit(None).cast("long").alias("target"), F.lit("").alias("role"), F.lit("").alias("text"))
    before = Window.partitionBy("conv_id").orderBy("seq").rangeBetween(Window.unboundedPreceding, 0)
    found = loose.unionByName(marks).withColumn("slot", F.max(F.when(is_message, F.col("seq"))).over(before))
    return direct.unionByName(found.where(~is_message & F.col("slot").isNotNull()))


def format_conversations(events: DataFrame, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, seq, kind, target, role, text) to one row per final message: (conv_id, slot, nth, segment, loss_from, loss_to).

    Segments of a conversation follow by slot and nth, its number among messages of one sequence number. The last two columns are
    null outside the loss mask, else places in the segment. A message is folded by one task; its conversation may be in many.
    """
    log = events.select("conv_id", F.col("seq").cast("long").alias("seq"), "kind", F.col("target").cast("long").alias("target"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    order = ["conv_id", "slot", F.col("kind") != "message", "seq", rank, "role", "text"]
    sorted_log = _with_slots(log).repartition("conv_id", "slot").sortWithinPartitions(*order).select("conv_id", "slot", "kind", "role", "text")
    id_type = dict(sorted_log.dtypes)["conv_id"]
    names = ["conv_id", "slot", "nth", "segment", "loss_from", "loss_to"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nth, role, parts, ids = None, 0, "", None, None  # parts is None before the first message

        def final() -> tuple:
            segment, start, end = render(role, "".join(parts))
            learn = role in learn_from
            return (*key, nth, segment, start if learn else None, end if learn else None)

        def rows(done: list[tuple]) -> pa.RecordBatch:
            kinds = (ids, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            ids, done = batch.column(0).type, []
            for conv, slot, kind, r, text in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                here = (conv, slot)
                if kind == "message":
                    if parts is not None:
                        done.append(final())
                    nth = nth + 1 if parts is not None and key == here else 0
                    key, role, parts = here, r, [text]
                elif parts is not None and key == here:
                    if kind == "delta":
                        parts.append(text)
                    elif kind == "edit":
                        parts = [text]
                    elif kind == "regenerate":
                        role, parts = r or role, [text]
            if done:
                yield rows(done)
        if parts is not None:
            yield rows([final()])

    return sorted_log.mapInArrow(fold, f"conv_id {id_type}, slot long, nth long, segment string, loss_from long, loss_to long")


@dataclass
class _Digest:
    conv_id: object
    turns: int = 0
    chars: int = 0
    loss_chars: int = 0
    turn_hash: "hashlib._Hash" = field(default_factory=hashlib.sha256)
    loss_hash: "hashlib._Hash" = field(default_factory=hashlib.sha256)

    def add(self, segment: str, loss_from: int | None, loss_to: int | None) -> None:
        role, text = parse(segment)
        self.turns += 1
        self.chars += len(segment)
        self.turn_hash.update(f"{role}\n{text}\n".encode())
        if loss_from is not None:
            learned = unescape(segment[loss_from:loss_to])
            self.loss_chars += len(learned)
            self.loss_hash.update(learned.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.turn_hash.hexdigest(), self.loss_chars, self.loss_hash.hexdigest(), self.chars


def digest_conversations(segments: DataFrame) -> DataFrame:
    """What format_conversations() returns to one row per conversation, read back from the segments in order. A hash of a whole
    conversation is worked out in sequence, so here one task streams it; it holds one segment at a time."""
    id_type = dict(segments.dtypes)["conv_id"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, ids = None, None

        def rows(done: list[_Digest]) -> pa.RecordBatch:
            kinds = (ids, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*(d.row() for d in done), strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            ids, done = batch.column(0).type, []
            for conv, segment, start, end in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if own is None or own.conv_id != conv:
                    done += [own] if own else []
                    own = _Digest(conv)
                own.add(segment, start, end)
            if done:
                yield rows(done)
        if own:
            yield rows([own])

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "slot", "nth").select("conv_id", "segment", "loss_from", "loss_to")
    return ordered.mapInArrow(of, f"conv_id {id_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def event_log(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to a log, out of order, whose final messages are the rows by turn, role and text.

    A hash decides whether a message arrives whole, in two parts, as a wrong draft that an edit replaces, or as one that is regenerated
    in two parts. Messages are numbered by turn and, within a turn, by role and text, so turns must be below 2**35 either way and a
    conversation may have 2**25 rows of one turn. Rows without a turn come first and arrive whole.
    """
    nth = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text")) - 1
    opened = F.col("turn").cast("long") * (1 << 28) + nth * 8
    text = F.coalesce("text", F.lit(""))
    head, rest = F.expr("substring(text, 1, length(text) div 2)"), F.expr("substring(text, length(text) div 2 + 1)")
    step = lambda at, kind, words: F.struct(
        (F.col("opened") + at).alias("seq"), F.lit(kind).alias("kind"), F.when(F.lit(kind != "message"), F.col("opened")).alias("target"), F.when(F.lit(kind == "message"), F.col("role")).alias("role"), words.alias("text")
    )
    wrong = F.concat(F.lit("draft "), rest)
    ways = (
        [step(0, "message", F.col("text"))],
        [step(1, "delta", rest), step(0, "message", head)],
        [step(2, "edit", F.col("text")), step(1, "delta", head), step(0, "message", wrong)],
        [step(3, "delta", rest), step(2, "regenerate", head), step(1, "delta", F.lit("?")), step(0, "message", wrong)],
    )
    way = F.when(F.col("opened").isNull(), 0).otherwise(F.pmod(F.xxhash64("conv_id", "turn", "role", "text"), F.lit(len(ways))))
    events = F.coalesce(*[F.when(way == i, F.array(*steps)) for i, steps in enumerate(ways)])
    numbered = rows.select("conv_id", "turn", "role", text.alias("text")).withColumn("opened", opened)
    return numbered.select("conv_id", F.explode(events).alias("e")).select("conv_id", "e.*")


def op7_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as logs of messages, deltas, edits and regenerations, and a conversation whose texts imitate control strings."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    planted = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], rows.schema)
    return digest_conversations(format_conversations(event_log(rows.unionByName(planted))))
