import json

import numpy as np
import pytest

from wordloom.functions import binary, mantissa
from wordloom.operators import archive, models, reports, spatial
from wordloom.plans import relations
from wordloom.sources import containers


def test_containers_come_back_and_refuse_what_is_broken():
    rng = np.random.default_rng(0)
    tiles = [containers.Tile(i, 4, 64, 4 * i, 0, rng.bytes(i * 7)) for i in range(5)]
    data = containers.dump_tiles([({"name": "a"}, tiles[:2]), ({"name": "b"}, tiles[2:])], {"note": 1})
    back, extra = containers.load_tiles(data)
    assert [t for _, own in back for t in own] == tiles == list(containers.iterate_tiles(data)) and extra == {"note": 1}
    for bad in (data[:-1], data + b"x", b"XXXX" + data[4:], data[:8]):
        with pytest.raises((ValueError, containers.struct.error)):
            containers.load_tiles(bad)
    deltas = [({"name": "w", "form": "patch"}, b"abc"), ({"name": "v", "form": "raw"}, b"")]
    data = containers.dump_deltas(deltas)
    assert [(a["name"], p) for a, p in containers.load_deltas(data)[0]] == [("w", b"abc"), ("v", b"")]
    assert containers.delta_size([a for a, _ in deltas], [3, 0]) == len(data)
    with pytest.raises(ValueError):
        containers.load_deltas(data[:-1])
    sections = {f"s{i}": rng.bytes(n) for i, n in enumerate((0, 1, 64, 100, 1000))}
    data = containers.dump_sections(sections, {"model": "m"})
    assert {n: containers.read_section(data, n) for n in containers.section_names(data)} == sections
    header, _ = containers.read_frame(data, containers.SECTIONS)
    assert all(p["at"] % 64 == 0 for p in header["sections"].values())
    with pytest.raises(ValueError):
        containers.read_section(data[:-65], "s4")


def test_int4_and_raw_words():
    rng = np.random.default_rng(1)
    for shape in ((3, 64), (5, 13), (0, 4)):
        values = rng.normal(size=shape).astype(np.float32)
        back = containers.load_int4(containers.dump_int4(values))
        assert back.shape == shape and (not back.size or np.abs(back - values).max() <= np.abs(values).max() / 7 * 0.51 + 1e-2)
    words = rng.integers(0, 65536, (4, 6)).astype(np.uint16)
    body, manifest = containers.dump_words(words, {"case": "x"})
    assert (containers.load_words(body, manifest) == words).all() and json.loads(manifest)["case"] == "x"
    with pytest.raises(ValueError):
        containers.load_words(body[:-2] + b"\0\0" if body[-2:] != b"\0\0" else body[:-2] + b"\1\1", manifest)


def test_a_container_for_each_tensor(spark, data, tmp_path):
    rows = relations.rows(spark, data).select("tensor", "r", "ws")
    path = str(tmp_path / "out")
    containers.write_tensors(archive.compress(rows), path)
    assert containers.index(spark, path).count() == rows.select("tensor").distinct().count()
    assert all(r.differing == 0 for r in archive.verified(rows, containers.read_tensors(spark, path)).collect())


def test_binary_coder_and_high_bits():
    rng = np.random.default_rng(2)
    p = rng.uniform(0, 1, (6, 300))
    bits = (rng.uniform(size=p.shape) < p).astype(np.int64)
    streams = binary.encode(bits, binary.frequencies(p))
    assert (binary.decode(streams, binary.frequencies(p)) == bits).all()
    ideal = -np.log2(np.where(bits == 1, binary.frequencies(p), 4096 - binary.frequencies(p)) / 4096).sum() / 8
    assert ideal <= sum(map(len, streams)) <= ideal * 1.01 + 6 * len(streams)
    assert binary.decode(binary.encode(bits[:, :0], bits[:, :0]), bits[:, :0]).shape == (6, 0)
    for width in (1, 3, 7, 12):
        values = rng.integers(0, 1 << width, 41)
        assert (binary.unpack_high(binary.pack_high(values, width), width, 41) == values).all()
    assert binary.pack_high([5], 3) == b"\xa0"


def test_models_learn_and_bits_of_a_network_are_its_classes():
    rng = np.random.default_rng(3)
    walk = np.cumsum(rng.integers(-2, 3, (200, 64)), axis=1) + 60 & 127
    words = (rng.integers(118, 122, walk.shape) << 7) | walk
    for kind, least in (("trees", 0.8), ("network", 1.0), ("contexts", 0.95)):
        coder = models.Coder(kind, words)
        streams = coder.encode(words)
        assert (coder.decode(streams, words & ~127) == walk).all()
        assert sum(map(len, streams)) < least * walk.size * 7 / 8 + 6 * len(streams), kind
    classes = rng.dirichlet(np.ones(128), 50)
    value = rng.integers(0, 128, 50)
    product = np.ones(50)
    for b in range(7):
        p = mantissa.bit_given_prefix(classes, b, value >> (7 - b))
        product *= np.where(value >> (6 - b) & 1, p, 1 - p)
    assert np.allclose(product, classes[np.arange(50), value])
    tables = mantissa.couplings(walk)
    assert (mantissa.coupled(mantissa.coupled(walk, tables), tables, back=True) == walk).all()


def test_exponent_forms_of_edge_cases():
    rng = np.random.default_rng(4)
    for values in (np.zeros(0, int), np.full(1000, 7), rng.integers(0, 256, 500), np.repeat([3, 9, 3], 700), np.arange(600) % 256, rng.integers(100, 104, 63)):
        data = models.encode_exponents(values)
        assert (models.decode_exponents(data, len(values)) == values).all() and len(data) <= len(values) + 1
    value, length = models.runs(np.full(600, 4))
    assert length.tolist() == [255, 255, 90] and value.tolist() == [4, 4, 4]


@pytest.mark.parametrize("shape", [(16, 16), (3, 5), (1, 7), (6, 1)])
def test_predictors_come_back_in_every_traversal(shape):
    rng = np.random.default_rng(5)
    tiles = rng.integers(0, 128, (4, *shape))
    for traversal in spatial.TRAVERSALS:
        assert sorted(map(tuple, spatial.path(*shape, traversal).tolist())) == [(y, x) for y in range(shape[0]) for x in range(shape[1])]
        for predictor in spatial.PREDICTORS:
            found = spatial.residuals(tiles, predictor, traversal)
            assert (spatial.reconstructed(found, predictor, traversal) == tiles).all()


def test_reports_settings_and_choices(spark):
    rows = reports.rows_of(spark.sql("select 1 as a, 2.5D as b, 'x|y' as c"))
    assert reports.as_markdown(rows, "T").splitlines()[-1] == "| 1 | 2.5000 | x\\|y |"
    assert reports.as_csv(rows) == "a,b,c\n1,2.5,x|y\n" and json.loads(reports.as_json(rows, kind="k"))["kind"] == "k"
    assert [reports.human_bytes(n) for n in (5, 2048, 3 << 30)] == ["5 B", "2.00 KiB", "3.00 GiB"]
    assert reports.settings("block: 256  # words\nname: 'x'\nfull: true\nnone:\n", ["block", "name", "full", "none"]) == {"block": 256, "name": "x", "full": True, "none": None}
    with pytest.raises(ValueError):
        reports.settings("odd: 1", ["block"])
    inventory = [{"name": f"model.layers.{i}.mlp.weight", "dtype": "BF16", "shape": [2, 2], "nbytes": 10} for i in range(6)] + [{"name": "model.embed_tokens.weight", "dtype": "BF16", "shape": [9, 9], "nbytes": 50}, {"name": "fp.weight", "dtype": "F32", "shape": [2, 2], "nbytes": 4}]
    chosen = [t["name"].split(".")[2] for t in reports.select_tensors(inventory, 10, 35)]
    assert chosen == ["0", "3", "5"]
    assert [t["name"] for t in reports.select_remaining(inventory, reports.select_tensors(inventory, 10, 35), 60)] == ["model.embed_tokens.weight", "model.layers.1.mlp.weight"]
    assert reports.resumed([{"recipe": {"b": 4}, "layer": "0"}], {"b": 4}, ["0", "1"]) == ["1"]
    with pytest.raises(ValueError):
        reports.resumed([{"recipe": {"b": 5}, "layer": "0"}], {"b": 4}, ["0", "1"])


def test_sources_of_weights_and_added_forms(spark, data, tmp_path):
    from wordloom.sources import weights

    rows = relations.rows(spark, data).select("tensor", "r", "ws")
    path = str(tmp_path / "c")
    containers.write_tensors(archive.compress(rows), path)
    first = weights.sidecar(spark, path)
    assert all(r.differing == 0 for r in archive.verified(rows, first).collect())
    assert weights.sidecar(spark, path).count() == first.count()
    source = weights.Frame(first)
    source.prefetch(1, 2)
    assert sorted(r.r for r in source.rows(1, 3, 4).collect()) == [3, 4, 5, 6]
    source.release(1, 2)
    index = {r.tensor: r.sha256 for r in containers.index(spark, path).collect()}
    assert weights.guarded(spark, path, index).count() == first.count()
    with pytest.raises(ValueError):
        weights.guarded(spark, path, index | {1: "0"})

    class Ramp:
        mode, name = 200, "ramp"

        def estimate(self, words):
            return 2 if (np.diff(words.reshape(-1)) == 1).all() else 1 << 30

        def encode(self, words):
            return int(words.reshape(-1)[0]).to_bytes(2, "little")

        def decode(self, payload, rows, cols):
            return (int.from_bytes(payload, "little") + np.arange(rows * cols)).reshape(rows, cols)

    weights.register(Ramp())
    try:
        words = np.arange(100, 356).reshape(4, 64)
        mode, name, payload = weights.cheapest(words)
        assert (mode, name) == (200, "ramp") and (weights.read(mode, name, payload, 4, 64) == words).all()
        assert weights.cheapest(np.full((4, 64), 7))[1] == "constant"
        with pytest.raises(ValueError):
            weights.register(Ramp())
    finally:
        weights.FORMS.clear()
