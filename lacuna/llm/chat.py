"""Chat records: conversations rendered by a template, encoded once, masked by offsets.

A turn is ``<|turn|>role<|text|>text<|end|>``. The three marks are tokens of their own, so no token
reaches across a turn's border; inside roles and texts every ``<|`` is escaped, and can be restored.
The loss mask is found by binary search: the sorted spans of assistant texts against the sorted
offsets of the tokens.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Turns of one record, by their number; a longer conversation takes several records.
RECORD_TURNS = 64
#: Characters after which a record is closed all the same.
RECORD_CHARS = 1 << 18
#: Characters encoded in one call.
BATCH_CHARS = 1 << 20

RECORD = "conv_id bigint, part bigint, seq int, n_turns int, ids array<int>, loss array<struct<start: int, end: int>>"
RECORD_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("part", pa.int64()),
        ("seq", pa.int32()),
        ("n_turns", pa.int32()),
        ("ids", pa.list_(pa.int32())),
        ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)


def escape(text: str) -> str:
    """No ``<|`` is left: a backslash more stands between the two."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]], learned: str = "assistant") -> tuple[str, np.ndarray]:
    """The text of turns (role, text), and the spans of what is to be learned, as rows (start, end)."""
    pieces: list[str] = []
    spans: list[tuple[int, int]] = []
    at = 0
    for role, text in turns:
        shown = escape(text)
        pieces += [TURN, escape(role), TEXT, shown, END]
        begin = at + sum(map(len, pieces[-5:-2]))
        at = begin + len(shown) + len(END)
        if role == learned and shown:
            spans.append((begin, begin + len(shown)))
    return "".join(pieces), np.array(spans, np.int64).reshape(-1, 2)


def masked(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Token ranges (start, end) that cover each span, from sorted offsets (start, end) of tokens."""
    first = np.searchsorted(offsets[:, 1], spans[:, 0], "right")
    last = np.searchsorted(offsets[:, 0], spans[:, 1], "left")
    return np.stack([first, last], axis=1)


_WORKER: dict = {}


def tokenizer(file: str):
    """The byte-level tokenizer with the template's marks added; one per Python worker."""
    if file not in _WORKER:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        made = Tokenizer.from_file(file)
        made.add_tokens([AddedToken(m, normalized=False, special=False) for m in (TURN, TEXT, END)])
        made.encode_special_tokens = True  # their strings in a text are ordinary text
        _WORKER[file] = made
    return _WORKER[file]


def _records(file: str):
    """Turns, sorted by conversation, part and turn, to encoded records, as they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(file)
        ready: list[tuple] = []

        def encoded() -> pa.RecordBatch:
            found = encoder.encode_batch([text for *_, (text, _) in ready], add_special_tokens=False)
            rows = []
            for (conv, part, seq, n, (_, spans)), e in zip(ready, found):
                loss = masked(np.array(e.offsets, np.int64).reshape(-1, 2), spans)
                rows.append(
                    {
                        "conv_id": conv,
                        "part": part,
                        "seq": seq,
                        "n_turns": n,
                        "ids": e.ids,
                        "loss": [{"start": a, "end": b} for a, b in loss.tolist()],
                    }
                )
            ready.clear()
            return pa.RecordBatch.from_pylist(rows, RECORD_ARROW)

        key, seq, turns, chars, waiting = None, 0, [], 0, 0

        def close() -> None:
            nonlocal turns, chars, waiting
            if turns:
                ready.append((*key, seq, len(turns), render(turns)))
                waiting += chars
            turns, chars = [], 0

        for batch in batches:
            for conv, part, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "role", "text"))):
                if (conv, part) != key or chars >= RECORD_CHARS:
                    close()
                    seq = seq + 1 if (conv, part) == key else 0
                    key = (conv, part)
                    if waiting >= BATCH_CHARS:
                        yield encoded()
                        waiting = 0
                turns.append((role or "", text or ""))
                chars += len(role or "") + len(text or "") + len(TURN + TEXT + END)
        close()
        if ready:
            yield encoded()

    return run


def records(turns: DataFrame, file: str) -> DataFrame:
    """``turns(conv_id, turn, role, text)`` to encoded records: ``conv_id, part, seq, n_turns, ids``
    and ``loss``, the ranges of tokens to be learned. ``file`` is a byte-level tokenizer's file.

    Rows go by turn number; null turns stand first, ties in the order of role and text. A null role
    or text counts as empty, a null conversation is one of its own, an empty table has no records.
    Other columns are ignored. A conversation of up to ``RECORD_TURNS`` turns is one record; a longer
    one is dealt out in parts (a token never reaches across turns, so their ids end to end are the
    ids of the whole), so that no conversation has to fit one task.
    """
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.coalesce(F.floor(F.col("turn") / RECORD_TURNS), F.lit(-(1 << 62))).cast("bigint").alias("part"),
        F.col("turn").cast("bigint").alias("turn"),
        "role",
        "text",
    )
    dealt = rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "text")
    return dealt.select("conv_id", "part", "role", "text").mapInArrow(_records(file), RECORD)


SUMMARY = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _read_back(file: str):
    """Records in order to one row per conversation; only checksums are carried from record to record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = tokenizer(file)
        turn_id, text_id, end_id = (decoder.token_to_id(m) for m in (TURN, TEXT, END))
        done: list[dict] = []
        conv, open_ = None, None

        def text_of(ids: np.ndarray) -> str:
            return decoder.decode(ids.tolist(), skip_special_tokens=False) if len(ids) else ""

        def close() -> None:
            if open_:
                n, all_turns, chars, loss, shown = open_
                done.append(dict(zip(FIELDS, (conv, n, all_turns.hexdigest(), chars, loss.hexdigest(), shown))))

        for batch in batches:
            columns = [batch.column(c) for c in ("conv_id", "ids", "loss")]
            for at in range(batch.num_rows):
                this = columns[0][at].as_py()
                if open_ is None or this != conv:
                    close()
                    conv, open_ = this, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = columns[1][at].values.to_numpy(zero_copy_only=False)
                marks = [np.flatnonzero(ids == m) for m in (turn_id, text_id, end_id)]
                for a, b, c in zip(*(m.tolist() for m in marks)):
                    role, text = text_of(ids[a + 1 : b]), text_of(ids[b + 1 : c])
                    open_[0] += 1
                    open_[1].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                    open_[4] += len(role) + len(text) + len(TURN + TEXT + END)
                for span in columns[2][at].as_py():
                    text = unescape(text_of(ids[span["start"] : span["end"]]))
                    open_[2] += len(text)
                    open_[3].update(text.encode())
            if len(done) >= 1_000:
                yield pa.RecordBatch.from_pylist(done, SUMMARY_ARROW)
                done = []
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, SUMMARY_ARROW)

    return run


SUMMARY_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
    ]
)
FIELDS = SUMMARY_ARROW.names


def read_back(found: DataFrame, file: str) -> DataFrame:
    """What written records hold, one row per conversation: the number of turns, the SHA-256 of all
    roles and texts, the characters and SHA-256 of what the mask covers, and the characters of the
    template's whole text. Records of a conversation are read in order as a stream."""
    order = ["conv_id", "part", "seq"]
    dealt = found.select(*order, "ids", "loss").repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "ids", "loss").mapInArrow(_read_back(file), SUMMARY)


def formatted(turns: DataFrame, file: str) -> DataFrame:
    """Write the records of all conversations to the shared folder and read them back."""
    return read_back(stage(records(turns, file)), file)
