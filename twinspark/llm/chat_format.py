"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as a whole, encoded once with offsets, and the sorted spans of the trained turns are
intersected with the token spans by binary search.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinspark.llm.shared import full_text, kind_of, picked, ship

#: The template's control strings. A turn is OPEN role BODY text CLOSE.
OPEN, BODY, CLOSE = "<s>[INST]", "[/INST]", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(rf"{re.escape(OPEN)}(.*?){re.escape(BODY)}(.*?){re.escape(CLOSE)}", re.S)

FORMATTED = "formatted string, n_turns long, input_ids array<int>, token_start array<int>, token_end array<int>, loss_mask array<boolean>, loss_start array<int>, loss_end array<int>"


def escape(text: str) -> str:
    """Doubles backslashes and puts one behind the first character of each control string, so none is left."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], trained: frozenset[str]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text, and the spans of trained roles' texts in it, in order."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + BODY, escape(text)
        if role in trained and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def mask_tokens(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens overlap a span. spans: sorted and disjoint, shape (n, 2)."""
    if not len(spans):
        return np.zeros(len(starts), bool)
    at = np.searchsorted(spans[:, 1], starts, "right")  # the first span that ends behind the token's start
    inside = at < len(spans)
    return inside & (spans[np.minimum(at, len(spans) - 1), 0] < ends) & (ends > starts)


def masked_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray, spans: np.ndarray) -> str:
    """All text under the mask, unescaped: masked tokens cut to the spans they touch, each character once."""
    first, stop = starts[mask], np.maximum.accumulate(ends[mask])
    if not len(first) or not len(spans):
        return ""
    apart = np.append(True, first[1:] > stop[:-1])  # masked tokens that touch or share characters are one stretch
    low, high = first[apart], stop[np.append(apart[1:], True)]
    # The spans that each stretch meets, by binary search; a span's pieces are unescaped together.
    begin, end = np.searchsorted(spans[:, 1], low, "right"), np.searchsorted(spans[:, 0], high, "left")
    count = np.maximum(0, end - begin)
    stretch = np.repeat(np.arange(len(low)), count)
    span = np.repeat(begin, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    cut = zip(span.tolist(), np.maximum(low[stretch], spans[span, 0]).tolist(), np.minimum(high[stretch], spans[span, 1]).tolist(), strict=True)
    pieces: dict[int, list[str]] = {}
    for i, a, b in cut:
        pieces.setdefault(i, []).append(formatted[a:b])
    return "".join(unescape("".join(own)) for own in pieces.values())


def format_chats(
    turns: DataFrame, tokenizer_path: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained: tuple[str, ...] = ("assistant",)
) -> DataFrame:
    """One row for each conversation: conv_id, formatted, n_turns, input_ids, token spans, loss_mask, loss spans.

    Turns go by turn number, nulls first, ties and repeated rows by role and then text; null roles and texts count
    as empty; rows without a conversation id form one conversation with a null id. An empty table gives no rows,
    other columns are not read. A conversation is one output row, so its turns meet in one task, as any row does.
    tokenizer_path: a tokenizers file; control strings inside texts are ordinary text to it.
    """
    ship(turns.sparkSession)
    rows = picked(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    one = F.struct("turn", full_text("role").alias("role"), full_text().alias("text"))
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    convs = convs.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    roles = frozenset(trained)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        tokenizer.encode_special_tokens = True
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                done = [render(list(zip(r, t, strict=True)), roles) for r, t in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist(), strict=True)]
                columns = [[] for _ in range(8)]
                for (text, spans), code in zip(done, tokenizer.encode_batch([d[0] for d in done], add_special_tokens=False), strict=True):
                    offsets = np.fromiter(chain.from_iterable(code.offsets), np.int32, 2 * len(code)).reshape(-1, 2)
                    cut = np.array(spans, np.int32).reshape(-1, 2)
                    values = (text, text.count(CLOSE), np.array(code.ids, np.int32), offsets[:, 0], offsets[:, 1], mask_tokens(offsets[:, 0], offsets[:, 1], cut), cut[:, 0], cut[:, 1])
                    for column, value in zip(columns, values, strict=True):
                        column.append(value)
                kinds = [pa.string(), pa.int64(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_()), *[pa.list_(pa.int32())] * 2]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), *arrays], names=["conv_id", *(x.split()[0] for x in FORMATTED.split(", "))])

    return convs.mapInArrow(run, f"conv_id {kind_of(convs, 'conv_id')}, {FORMATTED}")


def read_back(chats: DataFrame) -> DataFrame:
    """From format_chats' rows alone: conv_id, formatted_chars, the turns again, and the text under the loss mask."""
    ship(chats.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"chars": [], "n": [], "turns": [], "loss": []}
            column = {n: batch.column(n) for n in batch.schema.names}
            for i, text in enumerate(column["formatted"].to_pylist()):
                get = lambda n, i=i: column[n][i].values.to_numpy(zero_copy_only=False)
                turns = parse(text)
                rows["chars"].append(len(text))
                rows["n"].append(len(turns))
                rows["turns"].append("".join(f"{role}\n{body}\n" for role, body in turns))
                rows["loss"].append(masked_text(text, get("token_start"), get("token_end"), get("loss_mask").astype(bool), np.stack([get("loss_start"), get("loss_end")], 1)))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(rows["n"], pa.int64()), pa.array(rows["turns"], pa.string()), pa.array(rows["loss"], pa.string()), pa.array(rows["chars"], pa.int64())], names=["conv_id", "n_turns", "turns_text", "loss_text", "formatted_chars"])

    kind = chats.schema["conv_id"].dataType.simpleString()
    return chats.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_text string, loss_text string, formatted_chars long")
