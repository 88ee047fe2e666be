"""Files that the library writes and reads itself: records, lookups, logs, tables; and staged frames."""

import os
import struct
import subprocess
import sys

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from lacuna import operators as op
from lacuna import sources
from lacuna.operators.logs import SELECTION_BLOCK
from lacuna.sources import tfrecord
from lacuna.sources.files import LABELLED_IMAGE


def slow_crc(data):
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = crc >> 1 ^ (tfrecord.POLYNOMIAL if crc & 1 else 0)
    return crc ^ 0xFFFFFFFF


@pytest.mark.parametrize("n", [0, 1, 3, 4, 63, 64, 65, 128, 129, 5_000])
def test_checksum(n):
    data = np.random.default_rng(n).bytes(n)
    assert tfrecord.crc32c(data) == slow_crc(data)
    assert tfrecord.crc32c(b"123456789") == 0xE3069283  # the published check value


@pytest.fixture
def images(spark):
    rng = np.random.default_rng(3)
    made = [(f"image {k}", rng.bytes(int(rng.integers(0, 5_000))), int(k) - 5) for k in range(200)]
    made += [(None, None, None), ("", b"", 2**31 - 1), ("ünï", b"\x00" * 100, -(2**31))]
    return spark.createDataFrame(made, LABELLED_IMAGE).repartition(3)


def record_files(path):
    return sorted(f"{path}/{f}" for f in os.listdir(path) if not f.startswith((".", "_")))


@pytest.mark.parametrize("split", [1_000, 20_000, 10**9])
def test_records_come_back_in_any_ranges(spark, images, tmp_path, split):
    path = str(tmp_path / "images")
    sources.write_images(images, path, "tfrecord")
    read = sources.read_images(spark, path, "tfrecord", LABELLED_IMAGE, splitBytes=str(split))
    assert rows(read) == rows(images)
    sizes = [os.path.getsize(f) for f in record_files(path)]
    assert len(sizes) == 3 and read.rdd.getNumPartitions() == sum(-(-s // split) for s in sizes)
    with pytest.raises(Exception, match="not empty"):
        sources.write_images(images, path, "tfrecord")
    sources.write_images(images.limit(7), path, "tfrecord", mode="overwrite")
    assert sources.read_images(spark, path, "tfrecord", LABELLED_IMAGE).count() == 7


def test_all_kinds_of_columns(spark, tmp_path):
    schema = "a array<float>, b array<bigint>, c array<string>, d float, e bigint, f string"
    made = [([1.5, -2.0], [1, -(2**63)], ["x", "ü"], 0.25, 2**62, "t"), ([], [], [], None, None, None)]
    path = str(tmp_path / "kinds")
    sources.write_images(spark.createDataFrame(made, schema).coalesce(1), path, "tfrecord")
    found = [tuple(r) for r in sources.read_images(spark, path, "tfrecord", schema).collect()]
    assert sorted(found, key=repr) == sorted(made, key=repr)
    # A column that the files do not have is null; one that is not asked for is not read.
    other = sources.read_images(spark, path, "tfrecord", "e bigint, nope string").collect()
    assert {tuple(r) for r in other} == {(2**62, None), (None, None)}
    with pytest.raises(Exception, match="schema"):
        sources.read_images(spark, path, "tfrecord")


@pytest.mark.parametrize("at", ["length", "length checksum", "data", "data checksum", "cut"])
@pytest.mark.parametrize("split", [300, 10**9])
def test_a_broken_record_raises(spark, tmp_path, at, split):
    made = [(f"image {k}", bytes([k]) * 100, k) for k in range(20)]
    path = str(tmp_path / "broken")
    sources.write_images(spark.createDataFrame(made, LABELLED_IMAGE).coalesce(1), path, "tfrecord")
    (file,) = record_files(path)
    data = bytearray(open(file, "rb").read())
    begin = 0
    for _ in range(9):
        begin += tfrecord.HEAD + struct.unpack("<Q", data[begin : begin + 8])[0] + 4
    length = struct.unpack("<Q", data[begin : begin + 8])[0]
    place = {"length": 0, "length checksum": 9, "data": 50, "data checksum": tfrecord.HEAD + length + 1}
    if at == "cut":
        del data[begin + 60 :]
    else:
        data[begin + place[at]] ^= 1
    os.remove(f"{path}/.{os.path.basename(file)}.crc") if os.path.exists(f"{path}/.{os.path.basename(file)}.crc") else None
    open(file, "wb").write(data)
    with pytest.raises(Exception, match="record at byte|no record begins"):
        sources.read_images(spark, path, "tfrecord", LABELLED_IMAGE, splitBytes=str(split)).collect()


def test_records_inside_a_record(spark, tmp_path):
    """Data that looks like records is read as data, or the read fails; it never comes as rows."""
    inner = b"".join(tfrecord.frame(b"x" * k) for k in range(40))
    made = [("outer", inner * 3, 1), ("next", b"y", 2)]
    path = str(tmp_path / "nested")
    sources.write_images(spark.createDataFrame(made, LABELLED_IMAGE).coalesce(1), path, "tfrecord")
    assert len(rows(sources.read_images(spark, path, "tfrecord", LABELLED_IMAGE))) == 2
    with pytest.raises(Exception, match="larger splitBytes"):
        sources.read_images(spark, path, "tfrecord", LABELLED_IMAGE, splitBytes="1000").collect()


def test_every_range_inside_a_record_tells_what_to_do(spark, tmp_path):
    """Whichever range fails first, its message names the way out."""
    inner = b"".join(tfrecord.frame(b"x" * k) for k in range(40))
    path = tmp_path / "nested"
    sources.write_images(spark.createDataFrame([("outer", inner * 3, 1)], LABELLED_IMAGE).coalesce(1), str(path), "tfrecord")
    schema = spark.createDataFrame([], LABELLED_IMAGE).schema
    reader = tfrecord.RecordReader(str(path), schema, 1000)
    said = []
    for part in reader.partitions():
        try:
            list(reader.read(part))
        except Exception as e:
            said.append(str(e))
    assert len(said) > 1 and all("larger splitBytes" in x for x in said)


def test_lookup_with_a_schema(spark, tmp_path):
    path = tmp_path / "lookup.tsv"
    path.write_text("id\tn\tname\n1\t10\ta\nx\t20\tb\n3\tmany\tc\n4\t40\n5\t50\te\tmore\n6\t\tf\n")
    lookup = sources.read_lookup(spark, str(path), "id bigint, n int, name string")
    good, bad = sources.split_lookup(lookup)
    assert [tuple(r) for r in good.orderBy("id").collect()] == [(1, 10, "a"), (6, None, "f")]
    lines = ["3\tmany\tc", "4\t40", "5\t50\te\tmore", "x\t20\tb"]
    assert sorted(r.bad_line for r in bad.collect()) == lines
    # Whatever is asked for, the same lines are bad.
    assert bad.count() == 4 and good.select("name").count() == 2
    assert sorted(r.id or 0 for r in lookup.where("bad_line is not null").select("id").collect()) == [0, 3, 4, 5]
    assert sources.read_lookup(spark, str(path)).columns == ["id", "n", "name"]


def test_log_files_larger_than_a_split(spark, tmp_path):
    """One file read in many splits: every block whole, once, in a task of its own part of the file."""
    path = str(tmp_path / "log")
    text = "".join(f"This Wikipedia w{k}wiki has {k} articles\nnoise {'x' * (k % 90)}\nWith this: {k}.5\n" for k in range(4_000))
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "one.txt").write_text("before the first block\n" + text)
    (tmp_path / "log" / "two.txt").write_text(text[: text.index("w100wiki") - len("This Wikipedia ")])
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        blocks = sources.read_log_blocks(spark, path, SELECTION_BLOCK)
        splits = spark.read.text(path, lineSep="\n" + SELECTION_BLOCK).rdd.getNumPartitions()
        found = [r.total_article for r in op.parse_selection_log(blocks).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert splits > 10 and sorted(found) == sorted([*range(4_000), *range(100)])


def test_external_table(spark, tmp_path):
    """A folder per value, files near the advisory size: pieces are joined, a large folder is split."""
    kept = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    frame = spark.range(60_000).selectExpr("id", "if(id % 10 = 0, 'b', 'a') AS part", "sha2(cast(id AS string), 256) AS text")
    frame = frame.repartition(23)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        sources.save_external(frame, "parted", str(tmp_path / "parted"), partition_by=["part"], rebalance=True)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", kept)
    table = spark.table("parted")
    files = {r["part"]: r["n"] for r in table.groupBy("part").agg(F.count_distinct("_metadata.file_path").alias("n")).collect()}
    assert set(files) == {"a", "b"} and files["a"] > 1 and sum(files.values()) < 12
    assert table.count() == 60_000 and os.path.isdir(tmp_path / "parted" / "part=b")
    assert "PartitionFilters: [isnotnull(part" in table.where("part = 'b'")._jdf.queryExecution().executedPlan().toString()
    sources.save_external(frame, "parted", str(tmp_path / "parted"), files=4)
    assert len(spark.table("parted").inputFiles()) == 4
    with pytest.raises(ValueError, match="choose one"):
        sources.save_external(frame, "parted", str(tmp_path / "parted"), files=4, rebalance=True)
    spark.sql("DROP TABLE parted")


def test_staged_frames_go_when_the_driver_ends(tmp_path):
    """Queries that return a lazy frame leave nothing behind, and a block nothing at its end."""
    script = f"""
import os
from pyspark.sql import SparkSession
from lacuna import sources
from analogues.queries import QUERIES
conf = {{"spark.ui.enabled": "false", "spark.checkpoint.dir": "{tmp_path}/shared", "spark.sql.shuffle.partitions": "2",
        "spark.sql.warehouse.dir": "{tmp_path}/warehouse", "spark.driver.host": "127.0.0.1"}}
spark = SparkSession.builder.master("local[2]").config(map=conf).getOrCreate()
def written():
    return [x for x in os.listdir("{tmp_path}/shared") if "staged" in x]
with sources.Staging(spark) as stage:
    stage.bucketed(stage(spark.range(5)), ["id"]).count()
    assert len(written()) == 2
assert not written()
for name in ("gender_article_by_month", "multi_valued", "image_records", "external_table"):
    QUERIES[name](spark, "/root/testdata/sf0.001").collect()
assert written()
spark.stop()
"""
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("no test tables")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", script], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-2_000:]
    assert [x for x in os.listdir(tmp_path / "shared") if "staged" in x] == []
