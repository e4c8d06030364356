"""Chat formatting into budgeted windows.

Every turn becomes `<|im_start|>role`, a line feed, the text, `<|im_end|>` and a line feed. Prefix sums of turn tokens
choose the spans: with `capacity` tokens for new turns, the turns that lie within one cell of the prefix sum make a
window, and a turn that crosses a cell's end has a window of its own, so a window's new turns never exceed the capacity
unless one turn alone does. Each window repeats the conversation's leading system turn and as many of the turns just
before it as fit `history` tokens. The loss mask holds the texts of a window's own assistant turns; repeated ones are
masked out, so each assistant text is a target once.

Control strings inside texts are escaped: `<`, any backslashes, `|` gets one more backslash, and reading back removes
one, so no text holds `<|`. In roles, backslash and line feed are escaped too.

Edge cases: a null text or role is empty; a null conv_id is a conversation of its own; null turns come first; equal
turn numbers are ordered by role and text, repeated rows stay repeated; an empty table gives no window. Other columns
of the input play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.llm.common import blocked_prefix_sum

START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens of a window, of the history it may repeat, and of a turn's marks.
WINDOW_TOKENS, HISTORY_TOKENS, TURN_TOKENS = 1024, 256, 4
#: Turn numbers whose prefix sums run together.
TURN_BLOCK = 128


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return unescape(re.sub(r"\\(n|\\)", lambda m: "\n" if m[1] == "n" else "\\", role))


def turn_tokens(text: Column) -> Column:
    """Words and single punctuation marks, plus the turn's marks."""
    return (F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]")) + TURN_TOKENS).cast("long")


def format_windows(conversations: DataFrame, window_tokens: int = WINDOW_TOKENS, history_tokens: int = HISTORY_TOKENS, tokens=turn_tokens) -> DataFrame:
    """Windows: conv_id, window, text, tokens, repeated (leading turns that earlier windows hold), own, targets.

    `targets` is an array of (start, end): the code points of `text` under the loss mask.
    """
    role = F.regexp_replace(F.regexp_replace(F.coalesce(F.col("role"), F.lit("")), r"\\", r"\\\\"), "\n", r"\\n")
    text = F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), escape(role).alias("shown"), text.alias("raw"), escape(text).alias("body"), tokens(text).alias("tokens"))
    turns = turns.select("*", F.floor(F.col("turn") / TURN_BLOCK).alias("block"))
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "raw")]
    turns = blocked_prefix_sum(turns, ["conv_id"], "block", order, {"ord": F.lit(1).cast("long"), "at": F.col("tokens")})
    turns = turns.select("conv_id", "ord", "at", "role", "tokens", F.concat(F.lit(START), "shown", F.lit("\n")).alias("head"), "body")
    is_system = (F.col("ord") == 0) & (F.col("role") == "system")

    system = turns.where(is_system).select(F.col("conv_id").alias("s_conv"), F.col("tokens").alias("s_tokens"), F.col("head").alias("s_head"), F.col("body").alias("s_body"))
    capacity = F.greatest(F.lit(window_tokens - history_tokens) - F.coalesce("s_tokens", F.lit(0)), F.lit(1))
    kept = turns.join(system.select("s_conv", "s_tokens"), turns.conv_id.eqNullSafe(system.s_conv), "left").select("*", capacity.alias("capacity"))
    # Places count from the end of the system turn.
    kept = kept.select("conv_id", "ord", "role", "tokens", "head", "body", "capacity", (F.col("at") - F.coalesce("s_tokens", F.lit(0))).alias("at"), is_system.alias("is_system"))
    cell, last = F.floor(F.col("at") / F.col("capacity")), F.floor((F.col("at") + F.col("tokens") - 1) / F.col("capacity"))
    window = F.when(F.col("is_system"), F.lit(0)).otherwise(2 * cell + (cell != last).cast("long"))
    kept = kept.select("*", window.cast("long").alias("window"))

    own = kept.select("conv_id", "window", F.lit(2).alias("kind"), "ord", "tokens", "head", "body", (F.col("role") == "assistant").alias("target"))
    starts = kept.groupBy("conv_id", "window").agg(F.min("at").alias("start"), F.first("capacity").alias("capacity"), F.max("is_system").alias("first"))
    # A turn is history of the windows that begin within `history_tokens` after its start; cells make that an equi-join.
    reach = [F.floor((F.col("at") + F.col("tokens")) / F.col("capacity")), F.floor((F.col("at") + history_tokens) / F.col("capacity"))]
    past = kept.where((~F.col("is_system")) & (F.col("tokens") <= history_tokens)).select(F.col("conv_id").alias("h_conv"), "ord", "tokens", "at", "head", "body", F.explode(F.sequence(*reach)).alias("h_cell"))
    ahead = starts.select("conv_id", "window", "start", F.floor(F.col("start") / F.col("capacity")).alias("cell"))
    met = past.join(ahead, F.col("h_conv").eqNullSafe(F.col("conv_id")) & (F.col("h_cell") == F.col("cell")) & (F.col("at") + F.col("tokens") <= F.col("start")) & (F.col("start") <= F.col("at") + history_tokens))
    history = met.select("conv_id", "window", F.lit(1).alias("kind"), "ord", "tokens", "head", "body", F.lit(False).alias("target"))
    retained = starts.where(~F.col("first")).join(system, F.col("conv_id").eqNullSafe(F.col("s_conv"))).select("conv_id", "window", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("ord"), F.col("s_tokens").alias("tokens"), F.col("s_head").alias("head"), F.col("s_body").alias("body"), F.lit(False).alias("target"))

    parts = own.unionByName(history).unionByName(retained)
    parts = parts.select("*", F.concat("head", "body", F.lit(END)).alias("piece"))
    before = Window.partitionBy("conv_id", "window").orderBy("kind", "ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head")
    parts = parts.select("conv_id", "window", "kind", "ord", "tokens", "piece", F.when(F.col("target"), F.struct(start.cast("int").alias("start"), (start + F.length("body")).cast("int").alias("end"))).alias("span"))
    rows = F.array_sort(F.collect_list(F.struct("kind", "ord", "piece", "span")))
    made = parts.groupBy("conv_id", "window").agg(rows.alias("rows"), F.sum("tokens").alias("tokens"), F.sum((F.col("kind") < 2).cast("int")).cast("int").alias("repeated"), F.sum((F.col("kind") == 2).cast("int")).cast("int").alias("own"))
    return made.select("conv_id", "window", F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("text"), "tokens", "repeated", "own", F.filter(F.transform("rows", lambda r: r["span"]), lambda s: s.isNotNull()).alias("targets"))


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(END), re.S)
_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(windows: DataFrame) -> DataFrame:
    """What the windows hold, read from their text: turns and targets of every conversation in order, as digests.

    Windows stream through a task sorted by conversation and number; only running hashes are held, whatever the length.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        now = None
        done: list = []
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "text", "repeated", "targets")]
            for conv, text, repeated, targets in zip(*(c.to_pylist() for c in columns), strict=True):
                if now is None or now[0] != (conv,):
                    if now:
                        done.append(_row(now))
                    now = [(conv,), 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for k, m in enumerate(_TURN.finditer(text)):
                    if k >= repeated:
                        now[1] += 1
                        now[2].update(f"{unescape_role(m[1])}\n{unescape(m[2])}\n".encode())
                for span in targets:
                    target = unescape(text[span["start"] : span["end"]])
                    now[3] += len(target)
                    now[4].update(target.encode())
                now[5] += len(text)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if now:
            yield pa.RecordBatch.from_pylist([_row(now)], schema)

    ordered = windows.select("conv_id", "window", "text", "repeated", "targets").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(digest, _READ)


def _row(now: list) -> dict:
    return {"conv_id": now[0][0], "n_turns": now[1], "turns_sha256": now[2].hexdigest(), "loss_chars": now[3], "loss_sha256": now[4].hexdigest(), "formatted_chars": now[5]}
