"""Chat formatting by token-level assembly.

A turn becomes: reserved START id, the role's ids, reserved BODY id, the content's ids, reserved END id. Role and content
are encoded on their own, so no merge crosses a border and no text can produce a reserved id. Control strings inside a
text are broken up as well, so that the decoded form can be split again: a backslash is doubled, and the escape `\\e`
follows the first character of each control string. The loss mask is a prefix sum: +1 at the first content token of an
assistant turn and -1 after its last. Offsets of turns in their conversation are running totals, added by a window over
turns, so a long conversation stays a sequence of rows.

A null role or text is empty, a null conversation or turn is an ordinary value, repeated rows are repeated turns (in
order of turn, role, text). Only the four columns named are read. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from lagweave.llm.worker import kept, load_tokenizer

# The template's control strings; their ids follow the vocabulary in this order.
START, BODY, END = "### ", ":\n", " </turn>\n"
CONTROL = ("###", "</turn>", "<|endoftext|>")
TRAINED_ROLE = "assistant"
BATCH_TURNS = 500

_CONTROL = re.compile("|".join(re.escape(c) for c in CONTROL))


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\e{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\([\\e])", lambda m: "\\" if m[1] == "\\" else "", text)


def _tokenizer(path: str):
    return kept(("tokenizer", path), lambda: load_tokenizer(path))


TURN = "conv_id long, turn long, role string, text string, ids array<int>, loss array<boolean>, n_chars long"


def turn_encoder(path: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Task function: rows (conv_id, turn, role, text) to their ids, loss mask and length of the decoded form."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _tokenizer(path)
        size = t.get_vocab_size()
        start, body, end = size, size + 1, size + 2
        for whole in batches:
            for at in range(0, len(whole), BATCH_TURNS):
                b = whole.iloc[at:at + BATCH_TURNS].copy()
                roles, texts = b["role"].fillna("").tolist(), b["text"].fillna("").tolist()
                escaped = [escape(x) for x in texts]
                a = [t.encode(escape(x), add_special_tokens=False) for x in roles]
                c = [t.encode(x, add_special_tokens=False) for x in escaped]
                ids, loss = [], []
                for role, x, y in zip(roles, a, c):
                    row = np.array([start, *x.ids, body, *y.ids, end], np.int32)
                    steps = np.zeros(len(row) + 1, np.int8)
                    if role == TRAINED_ROLE:
                        steps[2 + len(x.ids)] += 1
                        steps[2 + len(x.ids) + len(y.ids)] -= 1
                    ids.append(row)
                    loss.append(np.cumsum(steps[:-1]).astype(bool))
                b["role"], b["text"], b["ids"], b["loss"] = roles, texts, ids, loss
                b["n_chars"] = [len(START) + len(escape(r)) + len(BODY) + len(e) + len(END) for r, e in zip(roles, escaped)]
                yield b[["conv_id", "turn", "role", "text", "ids", "loss", "n_chars"]]

    return run


def format_turns(conversations: DataFrame, path: str) -> DataFrame:
    """One row per turn: conv_id, turn, pos (0-based order in its conversation), ids, loss, n_chars and token_offset."""
    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    made = rows.mapInPandas(turn_encoder(path), TURN)
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    return made.select(
        "conv_id", "turn", (F.row_number().over(order) - 1).cast("long").alias("pos"), "ids", "loss", "n_chars",
        F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0)).cast("long").alias("token_offset"))


def decoded_form(t, size: int, ids: np.ndarray) -> str:
    """The text of formatted ids, reserved ids in their text form."""
    reserved = np.flatnonzero(ids >= size)
    marks, parts, at = (START, BODY, END), [], 0
    for k in reserved.tolist():
        parts += [t.decode(ids[at:k].tolist(), skip_special_tokens=False), marks[int(ids[k]) - size]]
        at = k + 1
    return "".join((*parts, t.decode(ids[at:].tolist(), skip_special_tokens=False)))


def read_turn(t, size: int, ids: np.ndarray, loss: np.ndarray) -> tuple[str, str, str, int]:
    """Role, text, text under the mask and length of the decoded form of a formatted turn. No control string is left in an
    escaped text, so the decoded form is cut at the template's own marks."""
    whole = decoded_form(t, size, ids)
    body = decoded_form(t, size, ids[:int(np.flatnonzero(ids == size + 1)[0])])
    role, text = whole[len(START):len(body)], whole[len(body) + len(BODY):len(whole) - len(END)]
    return unescape(role), unescape(text), unescape(t.decode(ids[loss].tolist(), skip_special_tokens=False)), len(whole)


REPORT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def conversation_reader(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pd.DataFrame]]:
    """Task function over turns sorted by conversation and position; keeps two running digests, not the turns."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = _tokenizer(path)
        size = t.get_vocab_size()
        open_key: tuple | None = None
        state: list = []
        done: list[tuple] = []

        def close() -> None:
            n, turns, chars, loss, total = state
            done.append((open_key[0], n, turns.hexdigest(), chars, loss.hexdigest(), total))

        for b in batches:
            for conv, ids, loss in zip(b["conv_id"], b["ids"], b["loss"]):
                key = (None if pd.isna(conv) else int(conv),)
                if key != open_key:
                    if open_key is not None:
                        close()
                    open_key, state = key, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, trained, n_chars = read_turn(t, size, np.asarray(ids), np.asarray(loss, bool))
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(trained)
                state[3].update(trained.encode())
                state[4] += n_chars
            yield _report(done)
            done = []
        if open_key is not None:
            close()
        yield _report(done)

    return run


def _report(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
    return out.astype({"conv_id": "Int64"})


def read_back(turns: DataFrame, path: str) -> DataFrame:
    """One row per conversation, read from the formatted turns. The digest of a conversation is a sequence by nature; a
    task streams through its turns and holds one at a time."""
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return ordered.select("conv_id", "ids", "loss").mapInPandas(conversation_reader(path), REPORT)
