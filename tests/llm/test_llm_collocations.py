import random
import re
from collections import Counter

import numpy as np
import pytest

from lacuna.llm import collocations

from llm_support import no_docs, odd, odd_rows  # noqa: F401


def brute(rows, longest, least, covered, top):
    """Rows (lang, text) to the result, phrase by phrase."""
    counts = {}
    for lang, text in rows:
        lower = (text or "").encode().lower()
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(rb"[^\x20\x09]+", piece)
            for m in range(1, longest + 1):
                counts.setdefault(lang or ("und" if lang is None else lang), Counter()).update(
                    b" ".join(words[k : k + m]) for k in range(len(words) - m + 1)
                )
    out = []
    for lang, f in counts.items():
        n = sum(v for p, v in f.items() if b" " not in p)
        candidates = {p: v for p, v in f.items() if b" " in p and v >= least}
        best = []
        for p, a in candidates.items():
            words = p.split(b" ")
            score, k = min((10**6 * a * a // (f[b" ".join(words[:k])] * f[b" ".join(words[k:])]), k) for k in range(1, len(words)))
            around = [v for q, v in candidates.items() if len(q) > len(p) and b" " + p + b" " in b" " + q + b" "]
            if not any(100 * v >= covered * a for v in around):
                best.append((-score, -a, p, f[b" ".join(words[:k])], f[b" ".join(words[k:])]))
        for rank, (score, a, p, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n, -score))
    return sorted(out)


def made(seed, n):
    rng = random.Random(seed)
    words = ["a", "B", "cc", "Éa", "Ab", "c\x00", "x\xa0y", "日", "ab", "\x1c"]
    texts = []
    for _ in range(n):
        picked = rng.choices(words, [30, 20, 10, 8, 6, 4, 3, 3, 2, 2], k=rng.randrange(0, 60))
        texts.append("".join(w + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ",", "\r\n"]) for w in picked))
    return texts


def found(docs, *args):
    return sorted(tuple(r) for r in collocations.collocations(docs, *args).collect())


@pytest.mark.parametrize("longest,least,covered,top", [(3, 10, 50, 2000), (4, 5, 80, 7), (2, 3, 50, 5), (3, 1, 1, 50)])
def test_against_brute_force(spark, longest, least, covered, top):
    rows = [(lang, t) for k, lang in enumerate([None, "en", "de", "und"]) for t in made(k, 40)]
    rows += [("en", None), ("en", ""), (None, None), ("xx", "one two"), ("", "p q " * 30)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    assert found(docs, longest, least, covered, top) == brute(rows, longest, least, covered, top)


def test_hot_words_and_groups_that_do_not_fit(spark, monkeypatch):
    """With tiny bounds leading words are dealt out and groups come in parts; the result stays."""
    monkeypatch.setattr(collocations, "HOT", 3)
    # The functions of the tasks travel with the values they read.
    for name, bound in (("GATHERED", 20), ("SLICE", 200)):
        monkeypatch.setattr(collocations, name, bound)
    rows = [("en", t) for t in made(9, 80)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    assert found(docs, 3, 4, 50, 100) == brute(rows, 3, 4, 50, 100)


def test_large_counts_are_exact(spark):
    """Products of counts beyond 64 bits."""
    words = [("en", "x", 1, 5 * 10**12), ("en", "y", 1, 7 * 10**12)]
    schema = "lang string, phrase string, words int, f bigint"
    phrases = spark.createDataFrame([("en", "x y", 2, 4 * 10**12)], schema)
    row = collocations._scored(phrases, spark.createDataFrame(words, schema)).first()
    assert (row.l, row.r, row.score) == (5 * 10**12, 7 * 10**12, 10**6 * 16 // 35)


def test_sort_of_suffixes():
    rng = np.random.default_rng(1)
    words = np.r_[rng.integers(0, 5, 500), 0, 0, 0]
    at = np.flatnonzero(words[:500] > 0)
    nodes, ended = collocations.multikey_quicksort(words, at, np.ones(len(at), np.int64), [1, 4, 2])
    brute_nodes = [Counter(), Counter(), Counter()]
    for k in at:
        for depth in (1, 2, 3):
            if (words[k : k + depth] > 0).all():
                brute_nodes[depth - 1][tuple(words[k : k + depth].tolist())] += 1
    for depth, (least, (where, n)) in enumerate(zip([1, 4, 2], nodes), 1):
        got = {tuple(words[k : k + depth].tolist()): int(v) for k, v in zip(where, n)}
        assert len(got) == len(where) and got == {p: v for p, v in brute_nodes[depth - 1].items() if v >= least}
    assert sum(n.sum() for _, n in collocations.multikey_quicksort(words, at, np.ones(len(at)), [1] * 3)[1]) == (
        sum(1 for k in at if 0 in words[k : k + 3])
    )


def test_odd_rows(spark, odd, odd_rows, no_docs):
    assert found(odd, 3, 2, 50, 50) == brute([(None, t) for _, t in odd_rows], 3, 2, 50, 50)
    assert found(no_docs) == []
    with pytest.raises(ValueError):
        collocations.collocations(odd, longest=1)
