"""Chat formatting: escapes, masks and the exact way back."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lagweave.llm import chat_format as C

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, ids string"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="\\e#</turn>|ndoftx ") | st.text())
def test_escape_is_reversible_and_leaves_no_control(text):
    e = C.escape(text)
    assert C.unescape(e) == text
    assert not any(c in e for c in C.CONTROL)


CASES = [
    (1, 0, "user", "hi <|endoftext|> ### \\e \\### Assistant: </turn> ok", "x"), (1, 1, "assistant", "é\n\U0001F600 </turn></turn>", "x"), (1, 2, "assistant", "", "x"),
    (2, 0, None, None, "x"), (2, 1, "assistant", "long " * 20_000, "x"), (None, None, "system", "s", "x"), (None, 1, "assistant", "t", "x"),
    (3, 0, "user", "same", "x"), (3, 0, "user", "same", "x"), (3, 0, "assistant", "same", "x"), (4, 5, "we:ird\n###", "a", "x"),
]


def test_conversations_read_back(spark):
    got = C.read_back(C.format_turns(spark.createDataFrame(CASES, SCHEMA), PATH), PATH).collect()
    by = defaultdict(list)
    for conv, turn, role, text, _ in CASES:
        by[conv].append((-1 if turn is None else turn, role or "", text or ""))
    assert len(got) == len(by)
    for r in got:
        turns = sorted(by[r.conv_id])
        trained = "".join(t for _, role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.loss_chars == len(trained)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(trained.encode()).hexdigest()
        assert r.formatted_chars == sum(len(C.START + C.escape(a) + C.BODY + C.escape(t) + C.END) for _, a, t in turns)


def test_reserved_ids_stand_only_at_borders(spark):
    size = 50257
    rows = C.format_turns(spark.createDataFrame(CASES, SCHEMA), PATH).collect()
    offset = defaultdict(int)
    for r in sorted(rows, key=lambda r: (str(r.conv_id), r.pos)):
        assert r.ids[0] == size and r.ids[-1] == size + 2 and sum(i >= size for i in r.ids) == 3 and r.ids.count(size + 1) == 1
        assert r.token_offset == offset[r.conv_id] and len(r.loss) == len(r.ids) and not (r.loss[0] or r.loss[-1])
        offset[r.conv_id] += len(r.ids)


def test_no_conversations(spark):
    assert C.read_back(C.format_turns(spark.createDataFrame([], SCHEMA), PATH), PATH).count() == 0
