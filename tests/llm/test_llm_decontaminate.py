import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lacuna.llm import decontaminate
from lacuna.llm.fm_index import FMIndex

from llm_support import as_rows, no_docs, odd, odd_rows  # noqa: F401


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.integers(0, 4), max_size=60),
    st.lists(st.lists(st.integers(1, 6), min_size=1, max_size=4), min_size=1, max_size=8),
)
def test_index_finds_every_place(text, phrases):
    index = FMIndex(np.array(text, np.int64))
    width = max(map(len, phrases))
    matrix = np.array([[0] * (width - len(p)) + p for p in phrases])
    low, high = index.search(matrix, np.array([len(p) for p in phrases]))
    for p, a, b in zip(phrases, low, high):
        found = sorted(index.locate(np.arange(a, b)).tolist())
        assert found == [k for k in range(len(text)) if text[k : k + len(p)] == p]


def test_index_of_a_long_repeat():
    text = np.array(([1, 2, 3] * 2_000 + [0]) * 3)
    index = FMIndex(text)
    low, high = index.search(np.array([[3, 1, 2]]), np.array([3]))
    assert high[0] - low[0] == 3 * 1_999
    assert sorted(index.locate(np.arange(low[0], high[0])))[:2] == [2, 5]


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width=13):
    out = []
    cut = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            cut.setdefault(tuple(w[k : k + width]), set()).add(i)
    for i, t in docs:
        w = words(t)
        hit, held = set(), set()
        for k in range(len(w)):
            for win, ids in cut.items():
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    held |= {str(x) for x in ids if x is not None}
        out.append((i, len(w), len(hit), sorted(held), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


TEXT = "The quick-brown fox jumps over 13 lazy dogs while élan vital hums a tune in the old barn by day"
ITEMS = [(1, TEXT), (2, "  fox JUMPS "), (3, None), (4, ""), (None, "a tune"), (5, TEXT + " and night"), (2, "barn by"), (6, "!!")]
DOCS = [
    (1, TEXT.upper().replace("É", "é")),
    (2, "nothing of it"),
    (3, "x " * 30 + TEXT[4:90] + " y" * 400),
    (3, "x " * 30 + TEXT[4:90] + " y" * 400),
    (4, None),
    (5, ""),
    (None, "A-tune: a tune"),
    (6, "fox"),
    (7, "fox jumps fox jumps " + "word " * 20_000 + "barn by"),
    (8, " ".join([TEXT] * 3)),
    (9, "z " * 38 + "fox jumps"),
    (10, "z " * 39 + "fox jumps"),
]


@pytest.mark.parametrize("block", [decontaminate.WINDOWS, 4])
def test_findings(spark, block):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in DOCS], "doc_id bigint, text string, f string, items string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontaminate.findings(docs, items, block=block).collect()
    assert sorted(((r.id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in got), key=repr) == brute(DOCS, ITEMS)
    for r in got:  # merged and in order
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))
        assert sum(s.end - s.start for s in r.spans) == r.n_hit


def test_clean_rows_stay_as_they_came(spark):
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in DOCS], "doc_id bigint, text string, row string, f string")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = decontaminate.keep_clean(docs, items)
    assert got.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in got.collect()))) == sorted(str(r[0]) for r in brute(DOCS, ITEMS) if not r[4])


def test_nothing(spark, odd, no_docs):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontaminate.findings(no_docs, items).count() == 0
    got = decontaminate.findings(odd, items.where("false")).collect()
    assert len(got) == odd.count() and not any(r.n_hit or r.contaminated for r in got)
    assert decontaminate.keep_clean(odd, items.where("false")).count() == odd.count()
    assert as_rows(decontaminate.keep_clean(odd, items)) == as_rows(odd)
