"""Versions of several tables: all of a load or nothing, derived tables with them, garbage."""

import time
import uuid

import pytest

from tempora.operators.incremental import Shrunk
from tempora.session import shared_dir
from tempora.sources.snapshots import Busy, Snapshots, attached


def ids(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture
def store(spark):
    return Snapshots(spark, f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}")


def overlay(read):
    return attached(read("edges"), read("nodes")).select("target_key", "loose")


def test_a_load_that_fails_between_stages_changes_nothing(spark, store):
    nodes = spark.createDataFrame([("a",), ("b",), (None,)], "key string")
    edges = spark.createDataFrame([("a",), ("c",), ("a",), (None,)], "target_key string")
    assert store.snapshot().version == 0 and store.versions() == []
    store.load({"nodes": nodes, "edges": edges}, {"overlay": overlay})
    assert sorted(map(str, ids(store.read("overlay")))) == ["('a', False)", "('a', False)", "('c', True)", "(None, True)"]
    before = store.read("nodes")

    def broken(read):
        assert read("nodes").count() == 1  # the new nodes are staged by now
        raise OSError("lost")

    with pytest.raises(OSError):
        store.load({"nodes": nodes.where("key = 'b'")}, {"overlay": broken})
    assert store.versions() == [1] and store.read("nodes").count() == 3
    # The same load again: nodes are replaced, edges carried over, the overlay attached anew.
    store.load({"nodes": nodes.where("key = 'b'")}, {"overlay": overlay})
    assert store.versions() == [1, 2] and {r["loose"] for r in store.read("overlay").collect()} == {True}
    assert store.snapshot().tables["edges"] == store.snapshot(1).tables["edges"]
    assert before.count() == 3 and store.read("nodes", 1).count() == 3
    with pytest.raises(KeyError):
        store.read("nodes", 9)


def test_two_loads_of_one_version(spark, store):
    rows = spark.createDataFrame([("a",)], "key string")

    def meanwhile(read):
        Snapshots(spark, store.path).load({"nodes": rows})
        return read("nodes")

    with pytest.raises(Busy):
        store.load({"nodes": rows.limit(0)}, {"copy": meanwhile})
    assert store.versions() == [1] and ids(store.read("nodes")) == [("a",)] and "copy" not in store.snapshot().tables


def test_shrinking_is_refused_and_garbage_collected(spark, store):
    rows = spark.createDataFrame([(str(i),) for i in range(10)], "key string")
    store.load({"nodes": rows})
    with pytest.raises(Shrunk):
        store.load({"nodes": rows.limit(2)}, least=0.9)
    store.load({"nodes": rows.limit(9)}, least=0.9)
    assert store.collect_garbage(keep=2) == []  # what is new may belong to a load under way
    time.sleep(0.05)
    assert len(store.collect_garbage(keep=2, older=0)) == 1 and store.read("nodes", 1).count() == 10
    assert len(store.collect_garbage(older=0)) == 1 and store.versions() == [2] and store.read("nodes").count() == 9
    empty = spark.createDataFrame([], "key string")
    store.load({"nodes": empty})
    assert store.read("nodes").columns == ["key"] and store.read("nodes").count() == 0
