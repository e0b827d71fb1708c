"""The versioned table: merges, failed and rival writers, batches run again, clean-up."""

import pytest

from lexquarry.sources.versions import Conflict, VersionedTable

SCHEMA = "doc_id long, chunk int, v string"


def rows(table, version=None):
    return sorted(map(tuple, table.read(version).collect()), key=repr)


@pytest.fixture()
def table(spark, tmp_path):
    return VersionedTable(spark, f"file://{tmp_path}/t", ("doc_id",), buckets=4)


def test_merges_replace_whole_groups(spark, table):
    assert table.read() is None and table.versions() == []
    table.merge(spark.createDataFrame([(1, 0, "a"), (1, 1, "a"), (2, 0, "a"), (None, 0, "a")], SCHEMA))
    table.merge(spark.createDataFrame([(1, 0, "b"), (None, 0, "b"), (3, 0, "b")], SCHEMA))
    assert rows(table) == sorted([(1, 0, "b"), (2, 0, "a"), (3, 0, "b"), (None, 0, "b")], key=repr)
    assert len(rows(table, 1)) == 4 and (1, 1, "a") in rows(table, 1)
    table.merge(spark.createDataFrame([(9, 0, "c", 5)], SCHEMA + ", more int"))
    assert {r[-1] for r in rows(table)} == {None, 5} and table.merge(spark.createDataFrame([], SCHEMA)) == 4


def test_a_failed_writer_leaves_the_version(spark, table, monkeypatch):
    table.merge(spark.createDataFrame([(1, 0, "a")], SCHEMA))

    def dies(held):
        raise OSError("gone")

    monkeypatch.setattr(table, "_commit", dies)
    with pytest.raises(OSError):
        table.merge(spark.createDataFrame([(1, 0, "b")], SCHEMA))
    monkeypatch.undo()
    assert rows(table) == [(1, 0, "a")] and table.clean() == 1 and rows(table) == [(1, 0, "a")]


def test_of_two_writers_one_wins(spark, table):
    table.merge(spark.createDataFrame([(1, 0, "a")], SCHEMA))
    held = table.manifest()
    table.merge(spark.createDataFrame([(2, 0, "b")], SCHEMA))
    with pytest.raises(Conflict):
        table._commit(held | {"version": 2, "folders": {}})
    assert rows(table) == [(1, 0, "a"), (2, 0, "b")]


def test_batches_run_again_and_reads_stay_flat(spark, table):
    for number in range(12):
        table.merge(spark.createDataFrame([(number, 0, "a"), (0, 1, str(number))], SCHEMA), number)
        table.merge(spark.createDataFrame([(number, 0, "again")], SCHEMA), number)
        table.clean()
    assert len(rows(table)) == 13 - 1 and "again" not in {r[2] for r in rows(table)}
    folders = {f.rsplit("/", 1)[0] for f in table.read().inputFiles()}
    assert len(folders) <= 4 and len(table.versions()) == 2
