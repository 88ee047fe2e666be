import pytest
from conftest import NOW, claim, qid, rows, tuples
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lacuna import lookups, sources
from lacuna import operators as op
from lacuna.functions import claim_matches, entity_id, spelled_out

FLAGS, VALUES = {"is_human": ("P31", "Q5")}, {"gender": "P21"}
PROPS = "qitem_id string, property string, value string"


@pytest.fixture
def items(spark, entities):
    return sources.entities(spark, entities, NOW)


EXPECTED = {
    "Q_plain": (True, "Q6581072"),
    "Q_two": (True, "Q6581097"),  # the larger JSON text
    "Q_gender_only": (False, "Q6581097"),
    "Q_no_gender": (True, None),
    "Q_null_value": (False, None),
    "Q_unlabelled": (True, "Q100"),
    "Q_nowhere": (True, "Q6581097"),
}


def test_explode_drops_entities_without_claims(items):
    found = op.explode_claims(items)
    assert found.columns == ["id", "property", "value"]
    ids = [r.id for r in found.collect()]
    assert ids.count("Q_two") == 3
    assert not {"Q_empty", "Q_null"} & set(ids)


@pytest.mark.parametrize("strict", [False, True])
def test_pivot(items, strict):
    found = op.pivot_claims(op.explode_claims(items), FLAGS, VALUES, strict=strict)
    assert {r.id: (r.is_human, r.gender) for r in found.collect()} == EXPECTED
    assert found.columns == ["id", "is_human", "gender"]


def test_spacing_matters_unless_strict(spark):
    spaced = spark.createDataFrame([("P31", '{"id": "Q5"}'), ("P31", qid("Q5")), ("P31", qid("Q50"))], "property string, value string")
    loose = spaced.where(claim_matches("P31", "Q5"))
    assert loose.count() == 1
    assert spaced.where(claim_matches("P31", "Q5", strict=True)).count() == 2


def test_flag_is_not_taken_from_the_value_property(spark):
    """A flag on the property that also gives a value must test the entity."""
    claims = spark.createDataFrame([("a", "P21", qid("Q1")), ("b", "P21", qid("Q2"))], "id string, property string, value string")
    found = op.pivot_claims(claims, {"is_one": ("P21", "Q1")}, VALUES)
    assert tuples(found) == [("a", True, "Q1"), ("b", False, "Q2")]


def test_entity_id_of_bad_json(spark):
    frame = spark.createDataFrame([('{"id":"Q1"}',), ("{bad",), ('{"x":1}',), (None,)], "v string")
    assert [r[0] for r in frame.select(entity_id("v")).collect()] == ["Q1", None, None, None]


def test_nothing_asked(items):
    with pytest.raises(ValueError):
        op.pivot_claims(op.explode_claims(items))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.sampled_from("abc"),
            st.lists(st.tuples(st.sampled_from(["P31", "P21", "P1"]), st.sampled_from([None, "Q5", "Q50", "Q7", "Q8"]))),
        ),
        max_size=6,
    )
)
def test_pivot_equals_brute_force(spark, dump):
    from conftest import ENTITY

    data = [(i, "item", NOW, [claim(p, q and qid(q)) for p, q in cs], {}) for i, cs in dump]
    frame = spark.createDataFrame(data, ENTITY)
    found = op.pivot_claims(op.explode_claims(frame), FLAGS, VALUES)
    expected = []
    for item in sorted({i for i, _ in dump}):
        claims = [c for i, cs in dump if i == item for c in cs]
        human = ("P31", "Q5") in claims
        genders = [q for p, q in claims if p == "P21"]
        if human or genders:
            named = [q for q in genders if q]
            expected.append((item, human, max(named, key=qid) if named else None))
    assert tuples(found) == expected


@pytest.fixture
def props(spark):
    return spark.createDataFrame(
        [
            ("a", "P31", qid("Q5")),
            ("a", "P21", qid("Q1")),
            ("a", "P21", qid("Q2")),
            ("b", "P21", qid("Q1")),
            ("b", "P21", qid("Q1")),
            ("c", "P21", "{bad"),
            ("c", "P21", None),
            ("c", "P21", qid("Q9")),
            ("d", "P91", qid("Q6636")),
            ("d", "P569", '{"time":"+1815"}'),
        ],
        PROPS,
    )


def test_append_features(spark, props):
    items = spark.createDataFrame([("a", 1), ("d", 2), ("z", 3)], "qitem_id string, n int")
    found = op.append_features(items, props, FLAGS, {"gender": "P21", "sexual_orientation": "P91"})
    assert found.columns == ["qitem_id", "n", "is_human", "gender", "sexual_orientation"]
    assert tuples(found) == [("a", 1, True, "Q2", None), ("d", 2, False, None, "Q6636"), ("z", 3, False, None, None)]
    step = op.append_value(op.append_flag(items, props, "P31", "Q5", "is_human"), props, "P21", "gender")
    assert tuples(step) == tuples(found.drop("sexual_orientation"))
    assert [r.qitem_id for r in op.biographies(found).collect()] == ["a"]


def test_claims_of(props):
    assert {r.property for r in op.claims_of(props, "P91").collect()} == {"P91"}


def test_time_claims(spark, props):
    found = op.time_claims(props, lookups.time_properties(spark))
    assert rows(found) == [
        {"qitem_id": "d", "property": "P569", "value": '{"time":"+1815"}', "property_label": "date of birth"}
    ]


def test_in_category(spark):
    items = spark.createDataFrame([("a", "Q6581097"), ("b", "Q1"), ("c", None)], "qid string, gender string")
    assert tuples(op.in_category(items, "gender", lookups.gender_categories(spark))) == [("a", "Q6581097")]


LABELS = "id string, label string"


def test_multi_valued(spark, props):
    labels = spark.createDataFrame([("Q1", "one"), ("Q2", "two")], LABELS)
    found = op.multi_valued(props.unionByName(spark.createDataFrame([("b", "P21", qid("Q7"))], PROPS)), "P21", labels)
    assert [tuple(r) for r in found.collect()] == [
        ("b", 3, "Q1", "one", 2),
        ("b", 3, "Q7", None, 1),
        ("a", 2, "Q1", "one", 1),
        ("a", 2, "Q2", "two", 1),
    ]
    lists = op.value_lists(found)
    assert [tuple(r) for r in lists.collect()] == [
        ("b", 3, ["Q1", "Q7"], ["one", None], [2, 1]),
        ("a", 2, ["Q1", "Q2"], ["one", "two"], [1, 1]),
    ]
    spelled = lists.select(spelled_out("value_list", "times_list"), spelled_out("label_list", "times_list"))
    assert [tuple(r) for r in spelled.collect()] == [
        (["Q1", "Q1", "Q7"], ["one", "one", None]),
        (["Q1", "Q2"], ["one", "two"]),
    ]


def test_multi_valued_reads_its_input_once(spark, props):
    labels = spark.createDataFrame([("Q1", "one")], LABELS)
    found = op.multi_valued(props, "P21", labels)
    found.collect()
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()


def test_category_counts_drop_null_and_unlabelled(spark):
    labels = spark.createDataFrame([("Q1", "one"), ("Q2", "two")], LABELS)
    items = spark.createDataFrame([("Q2",), ("Q2",), ("Q1",), (None,), ("Q3",)], "gender string")
    found = op.category_counts(items, "gender", labels)
    assert [tuple(r) for r in found.collect()] == [("Q2", 2, "two"), ("Q1", 1, "one")]


def test_labels_in_one_language(spark, entities):
    items = sources.entities(spark, entities, NOW)
    assert ("Q6581072", '"female"') in tuples(op.labels_in(items))
    assert "Q100" not in {r.id for r in op.labels_in(items).collect()}
    assert ("Q100", '"autre"') in tuples(op.labels_in(items, "fr"))


def test_add_label_inner_and_left(spark):
    labels = spark.createDataFrame([("Q1", "one")], LABELS)
    frame = spark.createDataFrame([(1, "Q1"), (2, None), (3, "Q9")], "n int, gender string")
    assert tuples(op.add_label(frame, "gender", labels, "gender_label")) == [(1, "Q1", "one")]
    assert tuples(op.add_label(frame, "gender", labels, how="left")) == [(1, "Q1", "one"), (2, None, None), (3, "Q9", None)]


def test_label_list_keeps_order_and_nulls(spark):
    labels = spark.createDataFrame([("Q1", "one"), ("Q2", "two")], LABELS)
    frame = spark.createDataFrame(
        [("a", ["Q2", "Q9", "Q1", None, "Q2"]), ("b", []), ("c", None), ("a", ["Q1"]), ("a", ["Q1"])],
        "item string, ids array<string>",
    )
    found = op.label_list(frame, "ids", labels)
    assert sorted((r.item, r.labels) for r in found.collect() if r.labels is not None) == [
        ("a", ["one"]),
        ("a", ["one"]),
        ("a", ["two", None, "one", None, "two"]),
        ("b", []),
    ]
    assert [r.item for r in found.where("labels IS NULL").collect()] == ["c"]


@pytest.mark.parametrize("strict", [False, True])
def test_entity_features_equal_the_pivot(spark, items, strict):
    """Folded in the row or from exploded claims; an entity in two rows has the claims of both."""
    twice = items.unionByName(items.limit(5))
    expected = tuples(op.pivot_claims(op.explode_claims(twice), FLAGS, VALUES, strict=strict))
    assert tuples(op.entity_features(twice, FLAGS, VALUES, strict=strict)) == expected
    everyone = op.entity_features(twice, FLAGS, VALUES, strict=strict, all_items=True)
    assert {r.id for r in everyone.collect()} == {r.id for r in items.collect()}
    known = {r[0] for r in expected}
    assert [r for r in tuples(everyone) if r[0] in known] == expected
    for r in everyone.collect():
        assert r.id in known or not any(r[name] for name in [*FLAGS, *VALUES])


def test_many_repeats_of_one_item(spark):
    """One item with most of the claims: its values are folded before they are gathered."""
    hot = spark.range(20_000).select(
        F.lit("hot").alias("qitem_id"), F.lit("P21").alias("property"), F.lit(qid("Q1")).alias("value")
    )
    found = op.multi_valued(hot, "P21", spark.createDataFrame([("Q1", "one")], LABELS))
    assert [tuple(r) for r in found.collect()] == [("hot", 20_000, "Q1", "one", 20_000)]
