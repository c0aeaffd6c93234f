import json

import numpy as np
import pytest

from wordloom.sources import safetensors


def put(path, tensors):
    header, data = {}, b""
    for name, (dtype, array) in tensors.items():
        raw = array.tobytes()
        header[name] = {"dtype": dtype, "shape": list(array.shape), "data_offsets": [len(data), len(data) + len(raw)]}
        data += raw
    text = json.dumps(header).encode()
    path.write_bytes(len(text).to_bytes(8, "little") + text + data)


@pytest.fixture()
def folder(tmp_path):
    rng = np.random.default_rng(0)
    words = {f"layers.{i}.w": ("BF16", rng.integers(0, 65536, (9, 5), dtype=np.uint16)) for i in (0, 1)}
    put(tmp_path / "a.safetensors", words | {"norm": ("F16", np.array([0x7FC1, 0x8000, 0xFF80], np.uint16)), "wide": ("F32", np.zeros((4, 4), np.float32))})
    return tmp_path, words


def test_reads_words_and_lists_all(spark, folder):
    path, words = folder
    safetensors.register(spark)
    got = spark.read.format("safetensors").load(str(path))
    table = {r.tensor: r for r in safetensors.inventory(spark, str(path)).collect()}
    assert sorted(table) == ["layers.0.w", "layers.1.w", "norm", "wide"] and table["wide"].n_bytes == 64
    assert got.filter("tensor = 'wide'").count() == 0
    one = got.filter("tensor = 'layers.1.w'").orderBy("r", "c").toPandas()
    assert (one.w.to_numpy() == words["layers.1.w"][1].reshape(-1)).all()
    assert [r.w for r in got.filter("tensor = 'norm'").orderBy("c").collect()] == [0x7FC1, 0x8000, 0xFF80]


def test_bounds_on_rows_are_read_alone(folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    path, words = folder
    reader = safetensors.Reader(str(path))
    list(reader.pushFilters([In(("tensor",), ("layers.0.w", "norm")), EqualTo(("tensor",), "layers.0.w"), GreaterThan(("r",), 2), LessThanOrEqual(("r",), 4)]))
    (part,) = reader.partitions()
    assert (part.first, part.count) == (15, 10)
    (batch,) = reader.read(part)
    assert (batch.column(4).to_numpy() == words["layers.0.w"][1][3:5].reshape(-1)).all()
    beyond = safetensors.Reader(str(path))
    list(beyond.pushFilters([GreaterThan(("r",), 100)]))
    assert beyond.partitions() == []


def test_a_region_of_a_tensor(spark, folder):
    path, words = folder
    safetensors.register(spark)
    got = spark.read.format("safetensors").load(str(path)).filter("tensor = 'layers.1.w' AND r >= 2 AND r < 5 AND c BETWEEN 1 AND 3").orderBy("r", "c")
    assert [r.w for r in got.collect()] == words["layers.1.w"][1][2:5, 1:4].reshape(-1).tolist()


def test_writes_what_it_reads(spark, folder, tmp_path):
    path, _ = folder
    safetensors.register(spark)
    got = spark.read.format("safetensors").load(str(path))
    out = tmp_path / "out"
    made = {r.tensor: r.n_words for r in safetensors.write(got, str(out)).collect()}
    assert made == {"layers.0.w": 45, "layers.1.w": 45, "norm": 3}
    again = spark.read.format("safetensors").load(str(out))
    assert again.exceptAll(got).count() == 0 and got.exceptAll(again).count() == 0
    assert not list(out.glob("*.part"))


def test_refuses_short_data(spark, tmp_path):
    header = json.dumps({"x": {"dtype": "BF16", "shape": [4, 4], "data_offsets": [0, 30]}}).encode()
    (tmp_path / "bad.safetensors").write_bytes(len(header).to_bytes(8, "little") + header + bytes(30))
    safetensors.register(spark)
    with pytest.raises(Exception, match="do not hold"):
        spark.read.format("safetensors").load(str(tmp_path)).count()
