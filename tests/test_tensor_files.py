import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.sources import readers, tensor_files


def file_of(path, tensors, cut=0):
    """tensors: {name: (dtype, shape, bytes)}"""
    about, at = {"__metadata__": {"format": "pt"}}, 0
    for name, (dtype, shape, raw) in tensors.items():
        about[name] = {"dtype": dtype, "shape": shape, "data_offsets": [at, at + len(raw)]}
        at += len(raw)
    head = json.dumps(about).encode()
    whole = struct.pack("<Q", len(head)) + head + b"".join(t[2] for t in tensors.values())
    path.write_bytes(whole[: len(whole) - cut])


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(2)
    x, y, z = (rng.standard_normal(n).astype("<f4") for n in (1000, 7, 64))
    file_of(tmp_path / "a.safetensors", {"layers.0.q.lora_A": ("F32", [10, 100], x.tobytes()), "steps": ("I64", [1], b"\0" * 8), "layers.0.q.lora_B": ("F16", [7], y.astype("<f2").tobytes())})
    bf = (z.view("<u4") >> 16).astype("<u2")
    file_of(tmp_path / "b.safetensors", {"layers.1.k.lora_A": ("BF16", [8, 8], bf.tobytes()), "none": ("F32", [0, 4], b""), "one": ("F32", [], z[:1].tobytes())})
    (tmp_path / "notes.txt").write_text("no tensors")
    want = {"layers.0.q.lora_A": x, "layers.0.q.lora_B": y.astype("<f2").astype("<f4"), "layers.1.k.lora_A": (bf.astype("<u4") << 16).view("<f4"), "none": x[:0], "one": z[:1]}
    return str(tmp_path), want


def joined(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.name, r.first)):
        assert r.first == len(out.setdefault(r.name, []))
        out[r.name] += list(r.data)
    return out


def same(got, want):
    assert set(got) == set(want)
    for name, values in want.items():
        assert np.array_equal(np.asarray(got[name], dtype="<f4"), values), name


@pytest.mark.parametrize("most", [64, 1000, 32_000_000])
def test_slices(spark, folder, most):
    path, want = folder
    df = tensor_files.slices(spark, path, most)
    rows = df.collect()
    same(joined(rows), want)
    assert all(tensor_files.WIDTH[r.dtype] * len(r.data) <= most for r in rows) and {tuple(r.shape) for r in rows} == {(10, 100), (7,), (8, 8), (0, 4), ()}
    assert df.rdd.getNumPartitions() >= 4256 // most
    same({r.name: r.data for r in readers.tensors(spark, path).collect()}, want)
    same({r.name: r.data for r in readers.tensors(spark, path + "/b.safetensors").collect()}, {k: want[k] for k in ("layers.1.k.lora_A", "none", "one")})


def test_predicates_are_pushed_and_nothing_else_is_read(spark, tmp_path):
    """A file of over 2 GB of which one small tensor is there at all: to read another one would take its bytes."""
    big, small = 2_300_000_000, np.arange(6, dtype="<f4")
    about = {"huge": {"dtype": "F16", "shape": [big // 2], "data_offsets": [0, big]}, "small": {"dtype": "F32", "shape": [2, 3], "data_offsets": [big, big + 24]}}
    head = json.dumps(about).encode()
    with open(tmp_path / "big.safetensors", "wb") as f:
        f.write(struct.pack("<Q", len(head)) + head)
        f.seek(big, os.SEEK_CUR)  # a hole
        f.write(small.tobytes())
    path = str(tmp_path)
    assert tensor_files.slices(spark, path).rdd.getNumPartitions() == big // tensor_files.SLICE_BYTES + 1
    for condition in (F.col("name") == "small", F.col("name").isin("small", "x"), F.col("name").startswith("sma"), F.col("name").endswith("ll"), F.col("name").contains("mal") & (F.col("dtype") == "F32")):
        df = readers.tensors(spark, path).where(condition)
        assert df.rdd.getNumPartitions() == 1
        same({r.name: r.data for r in df.collect()}, {"small": small})
    assert tensor_files.slices(spark, path).where("name = 'huge' AND first >= 0 AND name = 'no'").count() == 0
    assert {(r.name, tuple(r.shape)) for r in tensor_files.listing(spark, path).collect()} == {("huge", (big // 2,)), ("small", (2, 3))}


def test_broken_files(spark, tmp_path):
    file_of(tmp_path / "cut.safetensors", {"a": ("F32", [4], b"\0" * 16)}, cut=1)
    with pytest.raises(Exception, match="cut.safetensors"):
        readers.tensors(spark, str(tmp_path)).collect()
    (tmp_path / "cut.safetensors").write_bytes(b"\xff" * 20)
    with pytest.raises(Exception, match="cut.safetensors: a header"):
        readers.tensors(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="nowhere"):
        readers.tensors(spark, str(tmp_path / "nowhere")).collect()
    os.remove(tmp_path / "cut.safetensors")
    assert readers.tensors(spark, str(tmp_path)).count() == 0


def test_write_commits_or_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.range(0, 50, 1, 4).selectExpr("concat('t.', id) AS name", "array(2, 3) AS shape", "transform(sequence(0, 5), x -> cast(id + x AS float)) AS data")
    bad = df.withColumn("name", F.when(F.col("name") == "t.49", F.raise_error(F.lit("killed"))).otherwise(F.col("name")))
    with pytest.raises(Exception, match="killed"):
        tensor_files.write(bad, path)
    assert not os.path.exists(path) or not os.listdir(path)
    tensor_files.write(df, path)
    got = {r.name: r.data for r in readers.tensors(spark, path).collect()}
    same(got, {f"t.{k}": np.arange(k, k + 6, dtype="<f4") for k in range(50)})
