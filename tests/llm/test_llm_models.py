import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.llm import quality, samples, toxicity

from llm_support import given_labels, no_docs, odd, odd_rows  # noqa: F401

SF_DIR = "/root/testdata/sf0.1"


def labelled(label):
    return duckdb.sql(
        f"SELECT doc_id, text, {label} FROM '{SF_DIR}/documents.parquet' JOIN '{SF_DIR}/labels.parquet' USING (doc_id) ORDER BY doc_id"
    ).fetchall()


def parts(rows, folds, held):
    of = [zlib.crc32(str(r[0]).encode()) % folds for r in rows]
    return [r for r, k in zip(rows, of) if k != held], [r for r, k in zip(rows, of) if k == held]


def area(scores, y):
    """Share of pairs of unlike labels that the scores put in order."""
    rank = np.empty(len(y))
    rank[np.argsort(scores, kind="stable")] = np.arange(len(y))
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones - 1) / 2) / (ones * (len(y) - ones))


def test_toxicity_held_out():
    learn, test = parts(labelled("toxic"), 3, 1)
    model = toxicity.fit([(t, y) for _, t, y in learn])
    ends, p, offsets = model.sentences([t for _, t, _ in test])
    score = np.array([1 - np.prod(1 - p[o : o + len(e)]) for o, e in zip(offsets, ends)])
    y = np.array([r[2] for r in test])
    assert area(score, y) > 0.95
    assert ((score >= toxicity.REJECT) == y).mean() > 0.97
    assert (score >= toxicity.REJECT)[y == 0].mean() < 0.01


def test_quality_held_out():
    learn, test = parts(labelled("quality"), 4, 2)
    model = quality.fit([(t, y) for _, t, y in learn])
    score, y = model.scores([t for _, t, _ in test]), np.array([r[2] for r in test])
    assert area(score, y) > 0.99
    assert ((score >= quality.ACCEPT) == y).mean() > 0.98


def test_sentences_are_located():
    sample = [(f"All is well {k}. Nice day, you are here.\nBye {k}.", 0) for k in range(40)]
    sample += [(f"All is well {k}. You utter fool! Nice day, you are here.\nBye {k}.", 1) for k in range(40)]
    model = toxicity.fit(sample)
    texts = ["Nice day. You fool are here!\nBye. Well", "Nice day.", "", None, "fool"]
    ends, p, offsets = model.sentences(texts)
    assert ends == [[2, 6, 7, 8], [2], [], [], [1]]
    assert p[: len(ends[0])].argmax() == 1 and p[1] > 10 * max(p[0], p[2], p[3])
    assert p[offsets[4]] > 10 * p[offsets[1]]


def test_noisy_or(spark):
    model = toxicity.Model({"=bad": 5.0, "=worse": 7.0}, -6.0)
    docs = spark.createDataFrame([(1, "bad. worse. fine."), (2, None), (3, ""), (4, "bad bad bad")], "doc_id bigint, text string")
    got = {r.doc_id: r.s for r in docs.select("doc_id", toxicity.scored(model, docs, docs.text).alias("s")).collect()}
    p = 1 / (1 + np.exp(-np.array([-1.0, 1.0, -6.0])))
    assert got[1].score == pytest.approx(1 - np.prod(1 - p))
    assert [tuple(o) for o in got[1].offending] == [(1, 2, pytest.approx(p[1]))]
    assert got[2].score == got[3].score == 0 and got[2].offending == []
    assert got[4].score == pytest.approx(p[0])  # a word counts once in a sentence


def test_models_of_little():
    for fit in (toxicity.fit, quality.fit):
        for sample in ([], [("a b c", 1)], [("a b c", 0), ("", 0)], [("", 0), ("", 1)], [("a. b", 1), ("c", 0)]):
            fit(sample)
    assert quality.fit([]).scores(["", None, "a"]).tolist() == [0.5] * 3
    assert quality.fit([("a", 1)]).scores([""])[0] > 0.7 > quality.fit([("a", 0)]).scores([""])[0]


def test_dual_descent_finds_the_margin():
    rows = [(np.array([0]), np.array([1.0])), (np.array([1]), np.array([1.0])), (np.array([0, 1]), np.array([2.0, -1.0]))]
    y = np.array([1.0, -1.0, 1.0])
    w = quality.dual_descent(rows, y, 2, np.full(3, 10.0), 200)
    for (at, x), sign in zip(rows, y):
        assert sign * (w[at] @ x + w[2]) > 0.99


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_scores_of_odd_rows(name, odd, no_docs, given_labels):
    module = {"toxicity": toxicity, "quality": quality}[name]
    got = module.scores(odd, given_labels).collect()
    assert len(got) == odd.count()
    assert all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.id == 1}) == 1
    assert module.scores(no_docs, given_labels).count() == 0
    assert module.scores(odd, given_labels.where("false")).count() == odd.count()


def test_civil_rows_stay_as_they_came(odd, no_docs, given_labels):
    got = toxicity.keep_civil(odd, given_labels.where("false"))
    assert got.columns == odd.columns and got.count() == odd.count()
    assert toxicity.keep_civil(no_docs, given_labels).count() == 0


def test_sample_is_bounded_and_whole(odd, given_labels):
    rows = samples.labelled_sample(odd, given_labels, "quality", F.lit(True), 2, 1_000)
    assert len(rows) <= 4 and all(t is not None and len(t) <= 1_000 for t, _ in rows)
    assert samples.labelled_sample(odd, given_labels, "quality", F.lit(False), 2, 1_000) == []
    # an id with both labels is left out
    both = samples.labelled_sample(odd, given_labels, "toxic", F.col("doc_id") == 1, 9, 10**6)
    assert [y for _, y in both] == [0]


def test_held_out_follows_the_checksum(spark):
    ids = spark.createDataFrame([(k,) for k in [*range(50), None]], "doc_id bigint")
    for held, folds, rest in ((toxicity.held_out, 3, 1), (quality.held_out, 4, 2)):
        got = {r[0]: r[1] for r in ids.select("doc_id", held()).collect()}
        assert got == {k: zlib.crc32(str(k).encode()) % folds == rest for k in range(50)} | {None: False}


def test_long_tokens_are_looked_at_whole():
    for token in ("a", "Word,", "日" * 200 + "。" * 70, "aB3-" * 50, "x" * 64 + "1" * 64 + "-"):
        pieces = quality.pieces_of(token)
        assert "".join(pieces) == token
        assert all(0 < len(p) <= quality.PIECE and len(quality.shape_of(p)) <= quality.RUNS for p in pieces)


def test_the_end_of_a_long_token_reaches_the_score():
    prose, junk = "日本語の文章は空白を含まない。" * 100, "a1B2c3D4" * 400
    sample = [(prose[k % 15 :][: 200 + k], 1) for k in range(60)] + [(prose[k % 15 :][: 200 + k] + junk, 0) for k in range(60)]
    good, bad = quality.fit(sample).scores([prose[:400], prose[:400] + junk])
    assert good > quality.ACCEPT > 0.5 > bad


def test_toxic_words_are_not_counted_off():
    bad = [a + b + c for a in "bdfgklmnpr" for b in "aeiou" for c in "ktnsxz"]
    fill = ["all well", "so it goes", "nice day", "you see"]
    sample = [(f"{fill[k % 4]} {w} here", 1) for w in bad for k in range(12)] + [(f"{fill[k % 4]} here", 0) for k in range(12 * len(bad))]
    model = toxicity.fit(sample)
    _, p, _ = model.sentences([f"so it goes {w} here" for w in bad] + fill)
    assert len(bad) == 300 and (p[:300] >= 0.5).all() and (p[300:] < 0.5).all()


def test_sample_is_chosen_among_usable_texts(spark):
    docs = spark.createDataFrame([(k, "x" * (50 if k % 3 else 5_000)) for k in range(60)], "doc_id bigint, text string")
    rows = [(k, k % 2) for k in range(60)] + [(k, k % 2) for k in range(1_000, 9_000)]
    labels = spark.createDataFrame(rows, "doc_id bigint, toxic int")
    found = samples.labelled_sample(docs, labels, "toxic", F.lit(True), 15, 1_000)
    assert sorted(y for _, y in found) == [0] * 15 + [1] * 15 and {t for t, _ in found} == {"x" * 50}
    with pytest.warns(UserWarning, match="toxic = 1"):
        samples.labelled_sample(docs, labels.where("toxic = 0"), "toxic", F.lit(True), 15, 1_000)
