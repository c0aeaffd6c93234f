import numpy as np
import pytest

from tests.test_safetensors import put
from wordloom.__main__ import main
from wordloom.plans import drivers


@pytest.fixture()
def folder(tmp_path):
    rng = np.random.default_rng(0)
    base = {
        "layers.0.mlp.weight": ("BF16", np.full((32, 64), 0x3E00, np.uint16)),
        "layers.1.mlp.weight": ("BF16", rng.integers(0, 65536, (32, 60)).astype(np.uint16)),
        "norm.weight": ("F16", np.arange(70, dtype=np.uint16)),
        "wide": ("F32", np.zeros((4, 4), np.float32)),
    }
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    put(tmp_path / "a" / "m.safetensors", base)
    later = dict(base)
    later["layers.0.mlp.weight"] = ("BF16", base["layers.0.mlp.weight"][1].copy())
    later["layers.0.mlp.weight"][1][3, :4] ^= 7
    del later["norm.weight"]
    later["new"] = ("BF16", np.zeros((2, 2), np.uint16))
    put(tmp_path / "b" / "m.safetensors", later)
    return tmp_path, base


def test_a_constant_tensor_ranks_first(spark, folder):
    path, _ = folder
    got = drivers.qualify(spark, str(path / "a"))["qualify_leaderboard"].orderBy("bpw").collect()
    assert [r.tensor for r in got][0] == "layers.0.mlp.weight" and got[0].bpw < 1 and got[0].n_words == 2048
    assert {r.tensor: r.n_words for r in got}["norm.weight"] == 70


def test_pack_verify_unpack(spark, folder, tmp_path):
    path, base = folder
    out, back = str(tmp_path / "packed"), tmp_path / "back"
    made = {r.tensor: r for r in drivers.pack(spark, str(path / "a"), out).collect()}
    assert set(made) == set(base) - {"wide"} and made["layers.0.mlp.weight"].size < 2048
    drivers.unpack(spark, out, str(back)).collect()
    assert {r.tensor: r.n_words for r in drivers.tensors(spark, str(back)).collect()} == {"layers.0.mlp.weight": 2048, "layers.1.mlp.weight": 1920, "norm.weight": 70}
    assert all(r.changed == 0 for r in drivers.compare(spark, str(path / "a"), str(back)).collect() if r.tensor != "norm.weight")


def test_two_versions(spark, folder):
    path, _ = folder
    got = {r.tensor: r for r in drivers.compare(spark, str(path / "a"), str(path / "b")).collect()}
    assert got["norm.weight"].side == "base" and got["new"].side == "target"
    assert got["layers.0.mlp.weight"].changed == 4 and got["layers.0.mlp.weight"].patch_bytes == 4 + 16 + 8
    assert got["layers.1.mlp.weight"].changed == 0


def test_command_line(spark, folder, tmp_path):
    path, _ = folder
    assert main(["ablation", str(path / "a"), "--out", str(tmp_path / "r.md")], spark) == 0
    assert "# profile_sizes" in (tmp_path / "r.md").read_text()
    with pytest.raises(SystemExit):
        main(["compare", str(path / "a")], spark)
