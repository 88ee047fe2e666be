import json

from conftest import rows, tuples
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from lacuna import sources
from lacuna.lookups import CLASSIFIER_FEATURES
from lacuna.operators import parse_fit_log, parse_selection_log
from lacuna.operators.logs import FIT_BLOCK, SELECTION_BLOCK

WEIGHTS = json.dumps([i / 10 for i in range(16)])

LOG = f"""some preamble
Obtaining the final CCC for language: en
noise line
The fit has a score of: 0.95
{WEIGHTS}
This Wikipedia enwiki has 1000 articles
There were already 120 articles (12.5%)
This algorithm CLASSIFIED 30 articles of 50 from 200 (15.5%)
With this the total is 14.5
Obtaining the final CCC for language: zh-min-nan
The fit has a score of: 1
[0.5, 1]
This Wikipedia zhwiki has 10 articles
This algorithm CLASSIFIED 3 articles (1.5%)
With this the total is 4.
Obtaining the final CCC for language: fr
no fit in this block
This Wikipedia frwiki has 10 articles
There were already 1 articles
Obtaining the final CCC for language: de
The fit has a score of: 0.1
The fit has a score of: 0.2
not json
"""


def fit_blocks(spark, tmp_path, text=LOG):
    (tmp_path / "run.log").write_text(text)
    return sources.read_log_blocks(spark, str(tmp_path / "run.log"), FIT_BLOCK)


def test_weights(spark, tmp_path):
    found = parse_fit_log(fit_blocks(spark, tmp_path))
    assert found.columns == ["wiki", "fit_score", *CLASSIFIER_FEATURES]
    by_wiki = {r["wiki"]: r for r in rows(found)}
    assert sorted(by_wiki) == ["dewiki", "enwiki", "zhwiki"]  # fr has no fit line; zh is cut at the hyphen
    en, zh, de = by_wiki["enwiki"], by_wiki["zhwiki"], by_wiki["dewiki"]
    assert en["fit_score"] == 0.95
    assert [en[f] for f in CLASSIFIER_FEATURES] == [i / 10 for i in range(15)]
    assert zh["fit_score"] is None  # no decimal point
    assert [zh[f] for f in CLASSIFIER_FEATURES] == [0.5, 1.0] + [None] * 13
    assert de["fit_score"] == 0.2  # the later line counts
    assert {de[f] for f in CLASSIFIER_FEATURES} == {None}


def test_code_pattern(spark, tmp_path):
    found = parse_fit_log(fit_blocks(spark, tmp_path), code_pattern=r"[\w-]+")
    assert "zh-min-nanwiki" in {r.wiki for r in found.collect()}


def test_fit_line_at_the_end_of_a_block_gives_no_record(spark, tmp_path):
    blocks = fit_blocks(spark, tmp_path, f"{FIT_BLOCK}en\nThe fit has a score of: 0.5")
    assert parse_fit_log(blocks).count() == 0


def test_counts(spark, tmp_path):
    (tmp_path / "run.log").write_text(LOG)
    blocks = sources.read_log_blocks(spark, str(tmp_path / "run.log"), SELECTION_BLOCK)
    found = parse_selection_log(blocks)
    assert found.columns == [
        "wiki", "total_article", "ccc_groundtruth", "ccc_groundtruth_p",
        "test_article", "predict_positive", "predict_positive_p", "ccc_final_p",
    ]
    assert tuples(found) == [
        ("enwiki", 1000, 120, 12.5, 200, 30, 15.5, 14.5),
        ("zhwiki", 10, None, None, 5, 3, 1.5, 4.0),  # 1.5 is two integer tokens
    ]


def test_last_closing_line_counts(spark):
    block = "aawiki has 7 articles\nWith a 1.5\nThere were already 3 (2.5%)\nWith b 9.5"
    found = parse_selection_log(spark.createDataFrame([(block,), ("With 1.5 is part of the header",)], "block string"))
    assert tuples(found) == [("aawiki", 7, 3, 2.5, None, None, None, 9.5)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.from_regex(r"[a-z]{2,5}", fullmatch=True),
            st.integers(0, 10**9),
            st.integers(0, 99),
            st.lists(st.floats(-1e6, 1e6), min_size=15, max_size=17),
        ),
        min_size=1,
        max_size=8,
    )
)
def test_round_trip(spark, records):
    weights = spark.createDataFrame(
        [(f"{c}\nx\nThe fit has a score of: {p}.25\n{json.dumps(w)}\ny",) for c, _, p, w in records], "block string"
    )
    expected = sorted((f"{c}wiki", p + 0.25, *w[:15]) for c, _, p, w in records)
    assert sorted(tuple(r) for r in parse_fit_log(weights).collect()) == expected
    counts = spark.createDataFrame([(f"{c}wiki has {n}\nWith {p}.5",) for c, n, p, _ in records], "block string")
    found = sorted((r.wiki, r.total_article, r.ccc_final_p) for r in parse_selection_log(counts).collect())
    assert found == sorted((f"{c}wiki", n, p + 0.5) for c, n, p, _ in records)
