import random
import re
from collections import Counter

import numpy as np
import pytest

from lacuna.llm import divergence
from lacuna.llm.perfect_hash import PerfectHash, hashed

from llm_support import no_docs, odd, odd_rows  # noqa: F401


def brute(rows, least, top):
    """Rows (lang, source, text) to the result, with Python's whole numbers."""
    docs, groups = {}, {}
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode().lower())
        docs.setdefault(lang, Counter()).update(set(terms))
        groups.setdefault(lang, {}).setdefault(source, Counter()).update(terms)
    out = []
    for lang, by_source in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]

        def shares(counts):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        share = {s: shares(c) for s, c in by_source.items()}
        whole = shares(sum(by_source.values(), Counter()))
        for s, p in share.items():
            parts = {
                "pair": [(-sum(f(p[t], share[o][t]) for t in kept), o.encode()) for o in share if o != s],
                "term": [(-f(p[t], whole[t]), t) for t in kept if by_source[s][t] and p[t] > whole[t]],
            }
            for part, found in parts.items():
                for rank, (value, item) in enumerate(sorted(found), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item.decode(), -value, rank))
    return sorted(out)


def made(seed, n):
    rng = random.Random(seed)
    words = ["a", "B2c", "Été", "日本", "x_y", "ab", "ß", "long" * 9, "q", "z\x00z"]
    return [
        (rng.choice(["en", "de", None]), rng.choice(["s1", "s2", None, "S3", "日"]), " ".join(rng.choices(words, range(1, 11), k=rng.randrange(12))))
        for _ in range(n)
    ]


def found(docs, *args):
    return sorted(tuple(r) for r in divergence.audit(docs, *args).collect())


ODD = [("xx", "only", "one"), ("yy", "p", None), ("yy", "q", ""), ("", None, "none here"), ("en", "bare", "1 2 3")]


@pytest.mark.parametrize("least,top", [(10, 10), (1, 3)])
def test_against_brute_force(spark, least, top):
    rows = made(3, 300) + ODD
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert found(docs, least, top) == brute(rows, least, top)


def test_small_bounds_change_nothing(spark, monkeypatch):
    """Several shards, one block for each, few slots held, few slots compared at once."""
    monkeypatch.setattr(divergence, "SHARD", 2)
    monkeypatch.setattr(divergence, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(divergence, "DENSE", 10)
    monkeypatch.setattr(divergence, "SLICE", 300)
    rows = made(4, 120) + ODD
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    assert found(docs, 2, 10) == brute(rows, 2, 10)


def test_odd_rows(spark, odd, odd_rows, no_docs):
    assert found(odd, 1, 10) == brute([(None, "src", t) for _, t in odd_rows], 1, 10)
    assert found(no_docs) == []


def test_shares_beyond_64_bits():
    counts, totals = np.array([0, 5 * 10**14, 10**15]), np.array([7, 3 * 10**15, 10**15 + 2])
    assert divergence._shares(counts, totals).tolist() == [1 + 10**9 * (c + 2) // t for c, t in zip(counts.tolist(), totals.tolist())]


@pytest.mark.parametrize("n", [0, 1, 2, 1_000, 50_000])
def test_perfect_hash(n):
    keys = [f"key {k}".encode() for k in range(n)]
    made = PerfectHash(keys)
    assert sorted(made.slots(keys, hashed(keys)).tolist()) == list(range(n))
    others = [f"other {k}".encode() for k in range(1_000)] + [b""]
    assert (made.slots(others, hashed(others)) == -1).all()
