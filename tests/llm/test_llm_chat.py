import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given
from hypothesis import strategies as st

from lacuna.llm import chat

FILE = public_tokenizers.path("byte_bpe_50k.json")


@given(st.text(st.sampled_from("<|\\ae>"), max_size=12))
def test_escape_can_be_undone(text):
    assert "<|" not in chat.escape(text)
    assert chat.unescape(chat.escape(text)) == text


TEXTS = ["plain", "", " two  blanks ", "<|end|><|turn|>user<|text|>", "<\\|end|>", "日本 😀\n", "</s>[INST] ok [/INST]", "<|endoftext|>", "é" * 9]


def test_mask_covers_what_is_learned():
    turns = [(role, text) for text in TEXTS for role in ("user", "assistant")]
    text, spans = chat.render(turns)
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for t in TEXTS if t]
    found = chat.tokenizer(FILE).encode(text, add_special_tokens=False)
    ranges = chat.masked(np.array(found.offsets), spans)
    assert [chat.tokenizer(FILE).decode(found.ids[a:b], skip_special_tokens=False) for a, b in ranges] == [
        chat.escape(t) for t in TEXTS if t
    ]
    assert chat.tokenizer(FILE).decode(found.ids, skip_special_tokens=False) == text


def test_a_long_conversation_has_the_ids_of_its_parts():
    turns = [("user", t) for t in TEXTS]
    whole = chat.tokenizer(FILE).encode(chat.render(turns)[0], add_special_tokens=False).ids
    parts = [chat.tokenizer(FILE).encode(chat.render(turns[k : k + 2])[0], add_special_tokens=False).ids for k in range(0, 9, 2)]
    assert whole == sum(parts, [])


def brute(rows):
    """(conv_id, turn, role, text) rows to the summary of each conversation."""
    conversations = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: tuple((v is not None, v or 0 if k < 2 else v or "") for k, v in enumerate(r))):
        conversations.setdefault(conv, []).append((role or "", text or ""))
    out = []
    for conv, turns in conversations.items():
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        learned = "".join(t for r, t in turns if r == "assistant")
        shown = chat.render(turns)[0]
        out.append((conv, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(shown)))
    return sorted(out, key=repr)


ROWS = [
    *((1, k, "user" if k % 2 else "assistant", t) for k, t in enumerate(TEXTS)),
    (2, 1, "assistant", "second"),
    (2, 0, "system", "first"),
    (2, 1, "assistant", "second"),
    (3, None, None, None),
    (3, 5, "assistant", None),
    (None, 0, "assistant", "nobody's"),
    (None, None, "<|end|>", "x"),
    *((4, k, "assistant", f"turn {k}") for k in range(300)),
    (5, 0, "assistant", "long " * 100_000),
    (5, 1, "assistant", "after"),
    *((6, 0, "user", "the same turn") for _ in range(200)),
]


@pytest.mark.parametrize("chars", [chat.RECORD_CHARS, 500])
def test_conversations(spark, chars, monkeypatch):
    monkeypatch.setattr(chat, "RECORD_CHARS", chars)
    turns = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "conv_id bigint, turn bigint, role string, text string, part string, ids int")
    assert sorted((tuple(r) for r in chat.formatted(turns, FILE).collect()), key=repr) == brute(ROWS)
    assert chat.formatted(turns.where("false"), FILE).count() == 0


def test_a_long_conversation_is_dealt_out(spark):
    turns = spark.createDataFrame([(1, k, "user", "x") for k in range(1_000)], "conv_id bigint, turn bigint, role string, text string")
    found = chat.records(turns, FILE).collect()
    assert sorted(r.part for r in found) == list(range(16)) and max(r.n_turns for r in found) == chat.RECORD_TURNS
