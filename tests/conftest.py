import struct
import zlib

import pytest
from pyspark.sql import SparkSession

from lacuna.session import tune

ENTITY = (
    "id string, typ string, snapshot string, "
    "claims array<struct<mainSnak: struct<property: string, datavalue: struct<value: string>>>>, "
    "labels map<string,string>"
)
LINK = "item_id string, wiki_db string, page_id bigint, page_title string, snapshot string"
PAGE = "wiki_db string, page_id bigint, page_title string, page_namespace int, page_is_redirect int, snapshot string"
HISTORY = "wiki_db string, page_id bigint, page_first_edit_timestamp string, snapshot string"

NOW, MONTH = "2021-08-02", "2021-07"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    work = tmp_path_factory.mktemp("spark")
    builder = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "2")
        .config("spark.sql.maxMetadataStringLength", "10000")
        .config("spark.sql.warehouse.dir", str(work / "warehouse"))
    )
    session = builder.getOrCreate()
    if not session.conf.get("spark.checkpoint.dir", None):
        session.stop()
        session = builder.config("spark.checkpoint.dir", str(work / "checkpoints")).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


def rows(df, *by):
    """All rows as dicts, sorted by their text or by the named columns."""
    found = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(found, key=lambda r: [str(r[c]) for c in by or df.columns])


def tuples(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda t: [str(v) for v in t])


def qid(entity):
    """The JSON text of a claim that points to an entity."""
    return '{"entity-type":"item","numeric-id":%s,"id":"%s"}' % (entity[1:], entity)


def claim(prop, value):
    return ((prop, (value,)),)


@pytest.fixture(scope="session")
def entities(spark):
    """One row per rule about entities; the names say which."""
    human = claim("P31", qid("Q5"))
    female, male = claim("P21", qid("Q6581072")), claim("P21", qid("Q6581097"))
    return spark.createDataFrame(
        [
            ("Q_plain", "item", NOW, [human, female], {"en": '"Ada"'}),
            ("Q_two", "item", NOW, [human, female, male], {}),
            ("Q_gender_only", "item", NOW, [male], {}),
            ("Q_no_gender", "item", NOW, [human], {}),
            ("Q_fifty", "item", NOW, [claim("P31", qid("Q50"))], {}),
            ("Q_null_value", "item", NOW, [claim("P21", None)], {}),
            ("Q_empty", "item", NOW, [], {}),
            ("Q_null", "item", NOW, None, None),
            ("P_property", "property", NOW, [human, male], {}),
            ("Q_plain", "item", "2021-01-01", [human, male], {}),
            ("Q_unlabelled", "item", NOW, [human, claim("P21", qid("Q100"))], {}),
            ("Q_nowhere", "item", NOW, [human, male], {}),
            ("Q6581072", "item", NOW, [], {"en": '"female"', "fr": '"femme"'}),
            ("Q6581097", "item", NOW, [], {"en": '"male"'}),
            ("Q100", "item", NOW, [], {"fr": '"autre"'}),
            ("Q101", "item", NOW, [], None),
        ],
        ENTITY,
    )


@pytest.fixture(scope="session")
def link_rows(spark):
    return spark.createDataFrame(
        [
            ("Q_plain", "enwiki", 1, "Ada", NOW),
            ("Q_plain", "frwiki", 1, "Ada", NOW),
            ("Q_plain", "dewiki", 7, "Ada", NOW),
            ("Q_two", "enwiki", 2, "Two", NOW),
            ("Q_gender_only", "enwiki", 3, "Same title", NOW),
            ("Q_two", "enwiki", 4, "Same title", NOW),
            ("Q_gender_only", "enwiki", 5, "One", NOW),
            ("Q_two", "enwiki", 5, "Other", NOW),
            ("Q_plain", "enwiki", 8, None, NOW),
            ("Q_two", "enwiki", 9, None, NOW),
            ("Q_gender_only", "enwiki", 10, "Talk", NOW),
            ("Q_gender_only", "enwiki", 11, "Redirect", NOW),
            ("Q_gender_only", "enwiki", 12, "No history", NOW),
            ("Q_unlabelled", "enwiki", 13, "X", NOW),
            ("Q_nowhere", "enwiki", 14, "Old", "2021-01-01"),
        ],
        LINK,
    )


@pytest.fixture(scope="session")
def page_rows(spark):
    articles = [("enwiki", i, f"P{i}", 0, 0, MONTH) for i in (1, 2, 3, 4, 5, 8, 9, 12, 13, 14)]
    return spark.createDataFrame(
        articles
        + [
            ("frwiki", 1, "Ada", 0, 0, MONTH),
            ("enwiki", 10, "Talk", 1, 0, MONTH),
            ("enwiki", 11, "Redirect", 0, 1, MONTH),
            ("dewiki", 7, "Ada", 0, 0, "2020-01"),
        ],
        PAGE,
    )


@pytest.fixture(scope="session")
def history_rows(spark):
    return spark.createDataFrame(
        [
            ("enwiki", 1, None, MONTH),
            ("enwiki", 1, "2008-11-10 22:23:00", MONTH),
            ("frwiki", 1, "2001-02-03 00:00:00", MONTH),
            ("enwiki", 2, None, MONTH),
            ("enwiki", 8, "2008-11-30 01:00:00", MONTH),
            ("enwiki", 8, "2009-01-01 01:00:00", MONTH),
            ("enwiki", 9, "2009-01-02 01:00:00", MONTH),
            ("enwiki", 9, "2009-01-02 01:00:00", MONTH),
            ("enwiki", 9, "2009-01-02 01:00:00", MONTH),
            ("enwiki", 13, "2001-01-01 00:00:00.0", MONTH),
            ("enwiki", 13, "bad", MONTH),
            ("enwiki", 14, "2010-05-05 00:00:00", "2020-01"),
        ],
        HISTORY,
    )


def png(pixels):
    """A PNG file from rows of (r, g, b)."""

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    height, width = len(pixels), len(pixels[0])
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in pixels)
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
