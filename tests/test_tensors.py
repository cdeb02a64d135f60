"""A tensor container written in the test and read back in slices."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.operators import explain
from lexweave.sources import tensors


@pytest.fixture
def container(spark, tmp_path):
    spark.dataSource.register(tensors.Tensors)
    rng = np.random.default_rng(0)
    made = {f"module.encoder.0.{p}": rng.normal(0, 1, (4, 4)).astype("<f4") for p in "qkvo"} | {"big": rng.normal(0, 1, (50, 7)), "count": np.arange(5, dtype="<i8"), "none": np.zeros((0, 3), "<f2"), "one": np.array(2.5, "<f8")}
    path = (tmp_path / "model.bin").as_uri()
    tensors.write(path, made)
    return path, made


def read(spark, path, **options):
    return spark.read.format("tensor_container").options(path=path, **options).load()


def test_every_tensor_comes_back_in_slices(spark, container):
    path, made = container
    rows = read(spark, path, elements="16")
    got = tensors.state(rows)
    assert set(got) == set(made) - {"none"} and all(np.array_equal(got[n], made[n]) for n in got)
    assert rows.where("name = 'big'").count() == -(-350 // 16) and rows.agg(F.max(F.size("values"))).first()[0] == 16


def test_a_filter_reads_only_its_ranges(spark, container):
    path, made = container
    reader = tensors.FilteringReader({"path": path})
    assert list(reader.pushFilters([tensors.EqualTo(("name",), "big"), tensors.In(("begin",), (0,))])) == [tensors.In(("begin",), (0,))]
    assert {p.name for p in reader.partitions()} == {"big"}
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = read(spark, path, filters="true").where(F.col("name").isin("count", "one"))
        assert {r.name: r["values"] for r in some.collect()} == {"count": [0.0, 1.0, 2.0, 3.0, 4.0], "one": [2.5]}
        assert some.rdd.getNumPartitions() == 2
        assert read(spark, path, filters="true").where("name = 'absent'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_names_are_rewritten_at_the_scan(spark, container):
    path, made = container
    rename = json.dumps([["module.encoder.", ""]])
    model = explain.DetachedAttention(4)
    model.load(tensors.state(read(spark, path, rename=rename).where(F.col("name").startswith("0."))))
    assert all(np.array_equal(w, made[f"module.encoder.0.{p}"]) for w, p in zip(model.weights[0], "qkvo"))
    with pytest.raises(Exception, match="two tensors are called"):
        read(spark, path, rename=json.dumps([["module.encoder.0.q", "big"]])).count()


def test_half_precision_and_broken_files(spark, container, tmp_path):
    path = (tmp_path / "half.bin").as_uri()
    raw = np.array([1.5, -2.0], "<f4").view("<u4")
    tensors.write(path, {"x": (raw >> 16).astype("<i2")})
    file = tmp_path / "half.bin"
    file.write_bytes(file.read_bytes().replace(b'"I16"', b'"BF16"').replace(b'", "shape"', b'","shape"', 1))
    assert read(spark, path).first()["values"] == [1.5, -2.0]
    file.write_bytes(file.read_bytes()[:-1])
    with pytest.raises(Exception, match="ends within|buffer size"):
        read(spark, path).count()
        read(spark, path).collect()
