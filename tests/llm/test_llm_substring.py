import random

import numpy as np
import pytest

from lacuna.llm import substring_dedup

from llm_support import no_docs, odd, odd_rows, passage  # noqa: F401


def brute(rows, width):
    """(id, words, removed, kept) of each row; a null id comes last, and rows that share an id are one."""
    first, out = {}, []
    for i, text in rows:
        words = (text or "").encode().split()
        for k in range(len(words) - width + 1):
            window, place = b" ".join(words[k : k + width]), (i is None, i or 0, k)
            first[window] = min(place, first.get(window, place))
    for i, text in rows:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for k in range(len(words) - width + 1):
            if first[b" ".join(words[k : k + width])] < (i is None, i or 0, k):
                gone[k : k + width] = [True] * width
        out.append((i, len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode()))
    return out


def found(docs, width):
    return [(r.id, r.n_words, r.n_removed, r.kept) for r in substring_dedup.without_repeats(docs, width).collect()]


def test_odd_rows(spark, odd, odd_rows, no_docs):
    more = [(11, passage(0, 25) + " x " + passage(3, 30)), (11, passage(3, 30)), (None, "x " + passage(500, 30))]
    docs = odd.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string")).repartition(3)
    for width in (3, 20):
        assert sorted(found(docs, width), key=repr) == sorted(brute(odd_rows + more, width), key=repr)
    assert found(odd, 20) and found(no_docs, 20) == []


def corpus(n, seed):
    chance = random.Random(seed)
    shared = [passage(100 * k, 12) for k in range(4)]
    rows = []
    for i in range(n):
        words = [chance.choice("a b c dd ee the".split()) for _ in range(chance.randrange(40))]
        if chance.random() < 0.6:
            words[len(words) // 2 : len(words) // 2] = [chance.choice(shared)] * chance.choice([1, 1, 2])
        rows.append((i, "\t".join(words) if i % 2 else "  ".join(words)))
    return rows


@pytest.mark.parametrize("width", [1, 2, 5, 8])
def test_shared_passages(spark, width, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SLICE", 200)
    rows = corpus(120, width)
    docs = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), "doc_id bigint, text string").repartition(5)
    assert sorted(found(docs, width)) == brute(rows, width)


def test_a_copy_in_every_row_travels_once_per_task(spark):
    rows = [(i, passage(0, 60)) for i in range(400)]
    batch = spark.createDataFrame([(i, i, t) for i, t in rows], "id bigint, tag bigint, text string").coalesce(1)
    kmers = batch.mapInArrow(substring_dedup._cut(20), substring_dedup.KMERS).collect()
    per_row = len(kmers) / 400
    assert sum(k.words is not None for k in kmers) == per_row
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((i, g) for i, _, g, _ in found(docs, 20)) == [(i, 60 if i else 0) for i in range(400)]


def test_every_window_is_in_one_string():
    chance = random.Random(2)
    texts = substring_dedup.normalised([" ".join(chance.choice("ab") * chance.randrange(1, 40) for _ in range(n)) for n in (0, 3, 19, 20, 21, 300)] + [None])
    text, at, n, key, strings = substring_dedup.super_kmers(texts, 20)
    windows = []
    for d, a, m, s in zip(text, at, n, strings):
        words = texts[d].split()
        assert s == b" ".join(words[a : a + m])
        windows += [(int(d), int(a) + k) for k in range(m - 19)]
    assert windows == [(d, k) for d, t in enumerate(texts) for k in range(max(0, len(t.split()) - 19))]
    # equal windows have equal minimisers, wherever they stand
    again = substring_dedup.super_kmers([b"new start " + texts[5]], 20)
    assert set(key[text == 5].tolist()) <= set(again[3].tolist())


def test_window_hashes_agree_across_texts():
    texts = [b"p q r s t", b"x p q r s t y"]
    raw, starts, ends, first = substring_dedup._words(texts)
    hashes = substring_dedup.word_hashes(raw, starts, ends)
    found = substring_dedup.window_hashes(hashes, np.array([0, 6, 1, 7]), 4)
    assert (found[0] == found[1]).all() and (found[2] == found[3]).all() and (found[0] != found[2]).any()


def test_words_with_one_hash_in_common(spark):
    """Two words that agree in the fixed hash: the keyed one tells them apart, and no word goes."""
    one, two = "FHX-cj2-Maaaaaaa", "KAHaPrKB-EfRxBOY"
    raw = f"{one} {two} ".encode() + bytes(24)
    starts, ends = np.array([0, 17]), np.array([16, 33])
    plain = substring_dedup.word_hashes(raw, starts, ends)
    keyed = substring_dedup.word_hashes(raw, starts, ends, (5, 7, 11, 13))
    assert plain[0] == plain[1] and keyed[0] != keyed[1]
    texts = [" ".join([passage(0, 11), w, passage(50, 11)]) for w in (one, two)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert [r.n_removed for r in substring_dedup.without_repeats(docs, 20).collect()] == [0, 0]
