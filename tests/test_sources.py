import os

import pytest
from conftest import ENTITY, MONTH, NOW, png, rows, tuples
from pyspark.sql import functions as F

from lacuna import lookups, sources
from lacuna import operators as op
from lacuna.operators import parse_fit_log, parse_selection_log
from lacuna.operators.logs import SELECTION_BLOCK


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_entities_one_snapshot_items_only(spark, entities):
    found = sources.entities(spark, entities, NOW)
    assert {r.snapshot for r in found.collect()} == {NOW}
    assert "P_property" not in {r.id for r in found.collect()}
    assert sources.entities(spark, entities, NOW, typ=None).count() == found.count() + 1


def test_catalog_scan_prunes_partitions(spark, entities, tmp_path):
    name = "entity_dump"
    entities.write.partitionBy("snapshot").option("path", str(tmp_path / name)).mode("overwrite").saveAsTable(name)
    found = sources.entities(spark, name, NOW)
    assert found.count() == 14
    assert "PartitionFilters: [isnotnull(snapshot" in plan(found)
    spark.sql(f"DROP TABLE {name}")


def test_links_by_snapshot_and_wikis(spark, link_rows):
    assert sources.links(spark, link_rows).count() == link_rows.count()
    assert sources.links(spark, link_rows, NOW).count() == link_rows.count() - 1
    found = sources.links(spark, link_rows, NOW, "frwiki dewiki")
    assert sorted(r.wiki_db for r in found.collect()) == ["dewiki", "frwiki"]


def test_pages_are_live_articles(spark, page_rows):
    found = sources.pages(spark, page_rows, MONTH)
    assert found.columns == ["wiki_db", "page_id", "page_title"]
    assert {(r.wiki_db, r.page_id) for r in found.collect()} == {
        ("enwiki", i) for i in (1, 2, 3, 4, 5, 8, 9, 12, 13, 14)
    } | {("frwiki", 1)}
    assert sources.pages(spark, page_rows, MONTH, "frwiki").count() == 1


def test_pages_accept_boolean_redirect(spark, page_rows):
    flagged = page_rows.withColumn("page_is_redirect", F.col("page_is_redirect") == 1)
    assert sources.pages(spark, flagged, MONTH).count() == 11


def test_history(spark, history_rows):
    assert sources.history(spark, history_rows, MONTH).count() == 11
    assert sources.history(spark, history_rows, MONTH, "frwiki").count() == 1


def test_missing_column_raises(spark, page_rows):
    with pytest.raises(ValueError, match="item_id"):
        sources.links(spark, page_rows)


@pytest.mark.parametrize("wikis", [None, "", "  "])
def test_no_wikis_means_all(page_rows, wikis):
    assert sources.wiki_filter(page_rows, wikis).count() == page_rows.count()


def test_parquet_round_trip_overwrites(spark, page_rows, tmp_path):
    path = str(tmp_path / "features")
    sources.write_parquet(page_rows, path)
    sources.write_parquet(page_rows.limit(3), path)
    assert sources.read_features(spark, path).count() == 3


def test_external_table(spark, page_rows, tmp_path):
    path = str(tmp_path / "external")
    sources.save_external(page_rows, "page_copy", path, files=1)
    assert tuples(spark.table("page_copy")) == tuples(page_rows)
    assert len(list((tmp_path / "external").glob("*.parquet"))) == 1
    spark.sql("DROP TABLE page_copy")
    assert spark.read.parquet(path).count() == page_rows.count()


def test_staged_writes_to_the_checkpoint_folder(spark, page_rows):
    folder = spark.conf.get("spark.checkpoint.dir")
    kept = sources.staged(page_rows)
    assert tuples(kept) == tuples(page_rows)
    assert all(folder.rstrip("/") in f for f in kept.inputFiles())
    empty = sources.staged(page_rows.where("page_id < 0"))
    assert empty.schema == page_rows.schema and empty.count() == 0


def test_staging_clears_what_it_wrote(spark, page_rows):
    with sources.Staging(spark) as stage:
        kept = stage(page_rows)
        files = [f.removeprefix("file://") for f in kept.inputFiles()]
        assert files and all(os.path.exists(f) for f in files)
    assert not any(os.path.exists(f) for f in files) and stage.paths == []


def test_staging_refuses_a_folder_of_one_machine(spark, monkeypatch):
    """On a cluster a local path is another folder on each machine."""
    monkeypatch.setattr(spark.sparkContext, "master", "yarn")
    with pytest.raises(ValueError, match="one machine"):
        sources.Staging(spark)
    assert sources.Staging(spark, shared=True).folder
    monkeypatch.setattr("lacuna.sources.sinks.staging_folder", lambda spark: None)
    assert sources.Staging(spark).folder is None


def test_staging_takes_a_folder_that_executors_see(spark, page_rows, monkeypatch):
    """On a cluster a local path that is mounted on all machines is one folder; they are asked once."""
    from lacuna.sources import sinks

    asked = []
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr(sinks, "_SHARED", set())
    monkeypatch.setattr(sinks, "_seen_by_executors", lambda *a: not asked.append(a))
    assert tuples(sources.staged(page_rows)) == tuples(page_rows)
    assert tuples(sources.Staging(spark)(page_rows)) == tuples(page_rows)
    assert len(asked) == 1


def test_the_driver_alone_does_not_show_that_a_folder_is_shared(spark, tmp_path):
    from lacuna.sources import sinks

    folder = tmp_path / "shared"
    assert not sinks._seen_by_executors(spark, f"file://{folder}")  # no other process looked
    assert list(folder.iterdir()) == []


def test_a_folder_is_looked_at_as_spark_sees_it(spark, tmp_path):
    """Spark's writer and reader use the folder, so they are asked, not Python's file functions."""
    from lacuna.sources import sinks

    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.seen.link./in", f"file://{tmp_path}")
    assert sinks._comes_back(spark, "viewfs://seen/in/shared")
    assert list((tmp_path / "shared").iterdir()) == []


def test_a_folder_that_loses_files_is_not_shared(spark, tmp_path, monkeypatch):
    """What an executor keeps on its own disk does not come back."""
    from pyspark.sql import DataFrameWriter

    from lacuna.sources import sinks

    def some_lost(writer, path):
        write(writer, path)
        next((tmp_path / "shared").glob("seen-*/part-*")).unlink()

    write = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", some_lost)
    assert not sinks._comes_back(spark, f"file://{tmp_path}/shared")


def test_persisted_releases(page_rows):
    with sources.persisted(page_rows.where("page_id > 1")) as kept:
        assert kept.count() == 12
        assert kept.storageLevel.useMemory
    assert not kept.storageLevel.useMemory


def test_lookup_tsv(spark, tmp_path):
    path = tmp_path / "lookup.tsv"
    path.write_bytes("Label\tQID\r\nfa'afafine\tQ1\nmāhū\tQ2\ndissolved, abolished or demolished\tP576".encode())
    found = sources.read_lookup(spark, str(path))
    assert found.columns == ["Label", "QID"]
    assert tuples(found) == [("dissolved, abolished or demolished", "P576"), ("fa'afafine", "Q1"), ("māhū", "Q2")]


def test_stored_lookups(spark):
    assert lookups.gender_categories(spark).count() == 40
    assert lookups.sexual_orientation_categories(spark).count() == 15
    assert lookups.time_properties(spark).count() == 12
    assert len(lookups.CLASSIFIER_FEATURES) == 15
    for frame, key in (
        (lookups.gender_categories(spark), "QID"),
        (lookups.sexual_orientation_categories(spark), "QID"),
        (lookups.time_properties(spark), "Property"),
    ):
        assert frame.select(key).distinct().count() == frame.count()


MARKER = "Obtaining the final CCC for language: "


@pytest.mark.parametrize(
    ("text", "blocks"),
    [
        (f"preamble\n{MARKER}en\na\n{MARKER}fr\nb\n", ["en\na", "fr\nb\n"]),
        (f"{MARKER}en\na\n{MARKER}fr", ["en\na", "fr"]),
        ("preamble only\n", []),
        ("", []),
        (f"pre\n{MARKER}en\n{MARKER[:-2]}s long\n {MARKER}x\n{MARKER.strip()}\na", [f"en\n{MARKER[:-2]}s long\n {MARKER}x\n{MARKER.strip()}\na"]),
        (f"{MARKER}{MARKER}en\n{MARKER}x", [f"{MARKER}en", "x"]),
    ],
)
def test_log_blocks(spark, tmp_path, text, blocks):
    path = tmp_path / "run.log"
    path.write_text(text)
    assert [r.block for r in sources.read_log_blocks(spark, str(path), MARKER).collect()] == blocks


    column = op.split_blocks(spark.createDataFrame([(text,), (None,)], "t string"), "t", MARKER)
    assert [r.block for r in column.collect()] == blocks


def test_log_lines_that_begin_like_the_marker_lose_nothing(spark, tmp_path):
    lines = "There were already 5 (1.5%)\nThis algorithm CLASSIFIED 6 of 7 from 8 (2.5%)\nWith this: 3.5\n"
    for name in "ab":
        (tmp_path / f"{name}.log").write_text(
            f"preamble of {name}\nThis Wikipedia enwiki has 100 articles\nThis Wikipedias list is long\n{lines}"
            f"This Wikipedia frwiki has 200 articles\n{lines}"
        )
    found = parse_selection_log(sources.read_log_blocks(spark, str(tmp_path), SELECTION_BLOCK))
    one = [("enwiki", 100, 5, 1.5, 8, 6, 2.5, 3.5), ("frwiki", 200, 5, 1.5, 8, 6, 2.5, 3.5)]
    assert tuples(found) == sorted(one * 2)


def test_log_file_is_read_in_splits(spark, tmp_path):
    path = tmp_path / "long.log"
    path.write_text("".join(f"{MARKER}l{i}\nThe fit has a score of: 0.{i}\n[1, 2]\n" + "noise\n" * 50 for i in range(2000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        blocks = sources.read_log_blocks(spark, str(path), MARKER)
        assert blocks.rdd.getNumPartitions() > 4
        found = parse_fit_log(blocks, ["a", "b"])
        assert {r.wiki for r in found.collect()} == {f"l{i}wiki" for i in range(2000)}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def toy_decode():
    """Reads files that start with OK; built here so that it travels to the workers by value."""

    def decode(content):
        import numpy as np

        if not bytes(content).startswith(b"OK"):
            raise ValueError("unreadable")
        return np.zeros((1, 1, 3))

    return decode


def test_ingest_images(spark, tmp_path):
    for folder, names in {"quality": ["a.jpg", "b.jpg", "c.txt"], "random": ["d.jpg"]}.items():
        (tmp_path / folder).mkdir()
        for name in names:
            (tmp_path / folder / name).write_bytes(b"broken" if name == "b.jpg" else b"OK " + name.encode())
    labelled = {str(tmp_path / "quality"): 1, str(tmp_path / "random"): 0}
    found = sources.ingest_images(spark, labelled, toy_decode(), pattern="*.jpg")
    assert [f.dataType.simpleString() for f in found.schema] == ["string", "binary", "int"]
    assert tuples(found) == [("a.jpg", bytearray(b"OK a.jpg"), 1), ("d.jpg", bytearray(b"OK d.jpg"), 0)]
    # A sample counts files, readable or not, in the order of their names, and reads no others.
    sample = sources.ingest_images(spark, labelled, toy_decode(), per_class_sample=2)
    assert sorted(r.image_file_name for r in sample.collect()) == ["a.jpg", "d.jpg"]
    assert sorted(f.rsplit("/", 1)[1] for f in sample.inputFiles()) == ["a.jpg", "b.jpg", "d.jpg"]
    assert "Limit" not in sample._jdf.queryExecution().executedPlan().toString()
    marked = sources.ingest_images(spark, labelled, toy_decode(), pattern="*.jpg", keep_unreadable=True)
    assert sorted((r.image_file_name, r.readable) for r in marked.collect()) == [("a.jpg", True), ("b.jpg", False), ("d.jpg", True)]


def test_image_frame_with_schema(spark, tmp_path):
    path = str(tmp_path / "images")
    frame = spark.createDataFrame([("a.jpg", bytearray(b"x"), 1)], "image_file_name string, image_bytes binary, label int")
    frame.write.parquet(path)
    from lacuna.sources.files import LABELLED_IMAGE

    assert tuples(sources.read_images(spark, path, schema=LABELLED_IMAGE)) == tuples(frame)
    assert sources.read_images(spark, path).columns == frame.columns


def test_decoded_images(spark, tmp_path):
    (tmp_path / "ok.png").write_bytes(png([[(1, 2, 3), (4, 5, 6)]]))
    (tmp_path / "bad.png").write_bytes(b"not an image")
    found = rows(sources.read_decoded_images(spark, str(tmp_path)))
    assert [(r["image_file_name"], r["height"], r["width"], r["n_channels"]) for r in found] == [("ok.png", 1, 2, 3)]
    assert list(found[0]["pixels"]) == [3, 2, 1, 6, 5, 4]
    assert sources.read_decoded_images(spark, str(tmp_path), drop_invalid=False).count() == 2


def test_entity_ddl_reads_back(spark, entities, tmp_path):
    entities.write.parquet(str(tmp_path / "e"))
    assert spark.read.schema(ENTITY).parquet(str(tmp_path / "e")).count() == entities.count()
