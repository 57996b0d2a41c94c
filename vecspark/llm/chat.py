"""Chat formatting in budgeted windows: turn-aligned spans of a conversation, each with its system turn and some history.

Turns stand in order of (conversation, turn), dealt into ranges; each is written out in the template and counted in
tokens, and a prefix sum over the ranges gives every turn the tokens before it, however long its conversation is. The sums
cut a conversation into segments of `segment` tokens, which bounds what a task holds, and within a segment they choose
the windows: the turns that fit the budget next to the system turn and the last turns before them. Turns that a window
repeats are never under its loss mask, so each assistant text is a target once.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import shuffle_partitions, written
from .tokenise import encoder

# --- template ---------------------------------------------------------------------------------------------------

#: Strings that mean something to the template, or to others in use.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
_REST = {b: "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == b) for b in "<["}
_PLAIN = re.compile("|".join(rf"{re.escape(b)}\\*(?={rest})" for b, rest in _REST.items()))
_ESCAPED = re.compile("|".join(rf"{re.escape(b)}\\+(?={rest})" for b, rest in _REST.items()))
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
_ROLE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """A backslash more after the first character of each control string, so that none is left: `</s>` is `<\\/s>`, and
    what looks like that already gets two. No control string holds another's first character, so matches never meet."""
    return _PLAIN.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn in the template, and where its text begins and ends there, in code points."""
    head = f"<|im_start|>{escape(role.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n"
    body = escape(text)
    return f"{head}{body}<|im_end|>\n", len(head), len(head) + len(body)


def read_turns(text: str) -> list[tuple[str, str, int]]:
    """(role, text, length in code points) of the turns of a formatted window."""
    role = lambda r: _ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], unescape(r))
    return [(role(m[1]), unescape(m[2]), m.end() - m.start()) for m in _TURN.finditer(text)]


# --- prefix sums ------------------------------------------------------------------------------------------------

_SUMMED = "part int, conv_id long, ordinal long, start long, tokens long, kind int, body int, close int, turn_text string"


def _format(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    """Of turns in order (conv_id, role, text): written out, with number and tokens before them in their range."""
    part, seen, ordinal, start = TaskContext.get().partitionId(), (False, None), 0, 0
    encode = encoder(path).encode_column
    for batch in batches:
        ids = batch.column(0).to_pylist()
        turns = [write_turn(r or "", t or "") for r, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
        texts = pa.array([t for t, _, _ in turns], pa.string())
        tokens = [len(x) // 4 + 1 for x in encode(pa.array([t[:-1] for t, _, _ in turns], pa.string()))]  # the line end is one
        kinds = [1 if r == "system" else 2 if r == "assistant" else 0 for r in batch.column(1).to_pylist()]
        ordinals, starts = [], []
        for i, n in zip(ids, tokens):
            if seen != (True, i):
                seen, ordinal, start = (True, i), 0, 0
            ordinals.append(ordinal)
            starts.append(start)
            ordinal, start = ordinal + 1, start + n
        columns = [[part] * len(ids), ids, ordinals, starts, tokens, kinds, [b for _, b, _ in turns], [c for _, _, c in turns]]
        kinds_of = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds_of)] + [texts], names=[c.split()[0] for c in _SUMMED.split(", ")])


def summed_turns(turns: DataFrame, path: str, parts: int | None = None) -> DataFrame:
    """Turns in the template with their number in their conversation and the tokens before them there.

    turns: (conv_id, turn, role, text). Ordered by turn, null first; equal turns by role and a hash of the text.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    # the last key only deals rows that are equal over several ranges
    keys = ["conv_id", "turn", "role", F.xxhash64("text"), F.monotonically_increasing_id()]
    keyed = rows.select("conv_id", "turn", "role", keys[3].alias("h"), keys[4].alias("i"), "text")
    order = ["conv_id", "turn", "role", "h", "i"]
    dealt = keyed.repartitionByRange(parts or shuffle_partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    local = written(dealt.select("conv_id", "role", "text").mapInArrow(lambda x: _format(x, path), _SUMMED), "chat-turns")
    # only a range's first conversation can have begun before it: one row for each range at most
    sums = local.groupBy("part", "conv_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("turns"))
    before = W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = sums.select("part", F.col("conv_id").alias("own"), F.sum("tokens").over(before).alias("t"), F.sum("turns").over(before).alias("o")).where("o is not null")
    carried = F.broadcast(written(carried, "chat-carried"))
    of = local.join(carried, (local.part == carried.part) & local.conv_id.eqNullSafe(F.col("own")), "left")
    plus = lambda c, x: (F.col(c) + F.coalesce(x, F.lit(0))).alias(c)
    return of.select("conv_id", plus("ordinal", "o"), plus("start", "t"), "tokens", "kind", "body", "close", "turn_text")


# --- windows ----------------------------------------------------------------------------------------------------

_WINDOW = "conv_id long, first_turn long, n_turns int, n_repeated int, n_tokens long, loss array<struct<start:int,end:int>>, text string"
_WINDOW_ARROW = pa.schema([("conv_id", pa.int64()), ("first_turn", pa.int64()), ("n_turns", pa.int32()), ("n_repeated", pa.int32()), ("n_tokens", pa.int64()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("text", pa.string())])


def spans(starts: list[int], ends: list[int], first: int, budget: int, history: int, system: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(begin of history, begin, end) of the windows of turns first, first + 1, ... by the tokens before and with each turn.

    Turns from `least` on may be history; `system` tokens are kept free unless the window begins with the first turn of
    all. A turn that does not fit the budget is a window of its own, without history.
    """
    i = first
    while i < len(starts):
        room = budget - (system if starts[i] > 0 or i > 0 else 0)
        spare = min(history, room - (ends[i] - starts[i]))
        h = max(least, bisect_left(starts, starts[i] - spare, 0, i)) if spare > 0 else i
        h = min(h, i)
        j = max(i + 1, bisect_right(ends, starts[h] + room))
        yield h, i, j
        i = j


def _windows_of(conv, rows: list[tuple], budget: int, history: int) -> Iterator[tuple]:
    """Of one segment's rows (place, ordinal, start, tokens, kind, body, close, text), place 0 being the system turn of
    the conversation, 1 turns of the segment before and 2 the segment's own."""
    system = next((r for r in rows if r[0] == 0), None)
    rows = [r for r in rows if r[0]]
    first = next((i for i, r in enumerate(rows) if r[0] == 2), None)
    if first is None:
        return
    if rows[first][1] == 0 and rows[first][4] == 1 and rows[first][3] <= budget // 2:
        system = rows[first]
    starts, ends = [r[2] for r in rows], [r[2] + r[3] for r in rows]
    kept = 0 if system is None else system[3]
    least = 1 if system is not None and rows[0][1] == 0 else 0
    for h, i, j in spans(starts, ends, first, budget, history, kept, least):
        led = system is not None and rows[i][1] > 0
        shown = ([system] if led else []) + rows[h:j]
        repeated = int(led) + i - h
        at, loss = 0, []
        for k, r in enumerate(shown):
            if r[4] == 2 and k >= repeated and r[6] > r[5]:
                loss.append({"start": at + r[5], "end": at + r[6]})
            at += len(r[7])
        yield conv, rows[i][1], j - i, repeated, sum(r[3] for r in shown), loss, "".join(r[7] for r in shown)


def _windows(batches: Iterator[pa.RecordBatch], budget: int, history: int) -> Iterator[pa.RecordBatch]:
    out, size = [], 0

    def sent():
        columns = list(zip(*out)) or [[]] * len(_WINDOW_ARROW)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _WINDOW_ARROW)], schema=_WINDOW_ARROW)

    key, rows = None, []
    for batch in batches:
        for conv, segment, *row in zip(*(c.to_pylist() for c in batch.columns)):
            if key != (conv, segment):
                if rows:
                    out += _windows_of(key[0], rows, budget, history)
                    size += sum(len(r[7]) for r in rows)
                key, rows = (conv, segment), []
                if size > 1 << 20:
                    yield sent()
                    out, size = [], 0
            rows.append(tuple(row))
    if rows:
        out += _windows_of(key[0], rows, budget, history)
    yield sent()


def format_chats(turns: DataFrame, path: str, budget: int = 1024, history: int = 256, segment: int = 1 << 16, parts: int | None = None) -> DataFrame:
    """(conv_id, first_turn, n_turns, n_repeated, n_tokens, loss, text): windows of all conversations.

    turns: (conv_id, turn, role, text), one row a turn, in order of turn. A window is `n_repeated` turns shown again,
    then `n_turns` new ones from the conversation's turn `first_turn` (from 0) on, written out in `text`; `loss` has where
    the texts of new assistant turns begin and end there, in code points. Windows hold at most `budget` tokens, counted
    turn by turn; a first turn of role system of at most half of it leads all windows, and at most `history` tokens of
    the turns before are repeated. A longer turn is never cut: its window exceeds the budget.

    A null text or role is empty. Turns that are equal or null are in order of role and text; rows that repeat are turns
    of their own. Rows without a conv_id are one conversation, without id. Further columns are left out. No rows: no
    windows.
    """
    summed = summed_turns(turns, path, parts)
    cells = ["ordinal", "start", "tokens", "kind", "body", "close", "turn_text"]
    own = summed.withColumn("segment", F.floor(F.col("start") / segment).cast("long"))
    placed = own.select("conv_id", "segment", F.lit(2).alias("place"), *cells)
    # what the next segment may repeat; where there is none, it makes no window
    tail = own.where((F.col("segment") + 1) * segment - F.col("start") <= history)
    tail = tail.select("conv_id", (F.col("segment") + 1).alias("segment"), F.lit(1).alias("place"), *cells)
    later = own.where("segment > 0").select(F.col("conv_id").alias("of"), F.col("segment").alias("to")).distinct()
    lead = own.where((F.col("ordinal") == 0) & (F.col("kind") == 1) & (F.col("tokens") <= budget // 2))
    lead = lead.join(later, lead.conv_id.eqNullSafe(F.col("of"))).select("conv_id", F.col("to").alias("segment"), F.lit(0).alias("place"), *cells)
    rows = placed.union(tail).union(lead).repartition(parts or shuffle_partitions(turns.sparkSession), "conv_id", "segment")
    rows = rows.sortWithinPartitions("conv_id", "segment", "place", "ordinal")
    return rows.mapInArrow(lambda x: _windows(x, budget, history), _WINDOW)


# --- reading back -----------------------------------------------------------------------------------------------

_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Digest:
    def __init__(self, conv):
        self.conv, self.turns, self.chars, self.size = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, repeated: int, text: str, loss: list[dict]) -> None:
        for k, (role, own, length) in enumerate(read_turns(text)):
            if k >= repeated:
                self.turns += 1
                self.size += length
                self.all.update(f"{role}\n{own}\n".encode())
        for x in loss:
            target = unescape(text[x["start"] : x["end"]])
            self.chars += len(target)
            self.loss.update(target.encode())

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.chars, self.loss.hexdigest(), self.size


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, done = None, []
    for batch in batches:
        for conv, repeated, loss, text in zip(*(c.to_pylist() for c in batch.columns)):
            if now is None or now.conv != conv:
                done += [] if now is None else [now.row()]
                now = _Digest(conv)
            now.take(repeated, text, loss)
    done += [] if now is None else [now.row()]
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(list(x)) if i else pa.array(list(x), pa.int64()) for i, x in enumerate(zip(*done))], names=[c.split()[0] for c in _DIGEST.split(", ")])


def read_back(windows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from the windows of format_chats() alone.

    Turns that windows repeat are left out: formatted_chars counts the code points of each turn in the template once.
    A conversation is read as a stream, in order: its digest is one state, and no task holds more than a batch of it.
    """
    rows = windows.repartition(shuffle_partitions(windows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "first_turn")
    return rows.select("conv_id", "n_repeated", "loss", "text").mapInArrow(_digested, _DIGEST)
