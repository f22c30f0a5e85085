"""The curation of an image tree, dry and applied."""

import numpy as np

from siftwell.plans import curate
from siftwell.sources import manifest


def ppm(x):
    return b"P6 %d %d 255\n" % (x.shape[1], x.shape[0]) + x.astype(np.uint8).tobytes()


def test_dry_run_and_apply(spark, tmp_path):
    rng = np.random.default_rng(7)
    for k in range(8):
        x = np.kron(rng.integers(0, 255, (16, 16, 3)), np.ones((16, 16, 1)))
        for name in (f"a/p{k}.ppm", f"a/again{k}.ppm") if k < 3 else (f"{'ab'[k % 2]}/p{k}.ppm",):
            path = tmp_path / "in" / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(ppm(x))
    (tmp_path / "in/a/broken.ppm").write_bytes(b"P6 1")
    (tmp_path / "in/b/small.ppm").write_bytes(ppm(np.zeros((9, 9, 3))))
    args = [str(tmp_path / "in"), str(tmp_path / "out"), "--extensions", "ppm", "--targets", '{"b": 2}']
    curate.main(args)
    assert not (tmp_path / "out").exists()
    curate.main([*args, "--apply"])
    rows = manifest.read_manifest(spark, str(tmp_path / "out/manifest.csv")).collect()
    assert sorted(r["class"] for r in rows) == ["a"] * 5 + ["b"] * 2
    assert sorted(r.new_path for r in rows) == [f"a/{i:06d}.ppm" for i in range(5)] + [f"b/{i:06d}.ppm" for i in range(2)]
    assert all((tmp_path / "out" / r.new_path).read_bytes().startswith(b"P6") for r in rows)
    assert "broken.ppm" in "".join(p.read_text() for p in (tmp_path / "out/report/broken").glob("*.json"))
