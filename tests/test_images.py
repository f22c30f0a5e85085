"""Image trees decoded on the JVM, integrity, warnings."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.plans import curate
from siftwell.sources import images, manifest


def png(rgb):
    h, w = rgb.shape[:2]
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    rows = b"".join(b"\0" + r.astype(np.uint8).tobytes() for r in rgb)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", w.to_bytes(4, "big") + h.to_bytes(4, "big") + b"\x08\x02\0\0\0") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def converted(spark, source, target, kind):
    io, file = spark._jvm.javax.imageio.ImageIO, spark._jvm.java.io.File
    assert io.write(io.read(file(str(source))), kind, file(str(target)))


def turned(jpeg, tag, order="big"):
    """A JPEG with an orientation tag."""
    n = lambda v, size: v.to_bytes(size, order)
    tiff = (b"MM" if order == "big" else b"II") + n(42, 2) + n(8, 4) + n(2, 2) + n(0x0100, 2) + n(3, 2) + n(1, 4) + n(7, 2) + n(0, 2) + n(0x0112, 2) + n(3, 2) + n(1, 4) + n(tag, 2) + n(0, 2) + n(0, 4)
    body = b"Exif\0\0" + tiff
    return jpeg[:2] + b"\xff\xe1" + (len(body) + 2).to_bytes(2, "big") + body + jpeg[2:]


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root, rng = tmp_path_factory.mktemp("tree"), np.random.default_rng(3)
    for name in ("가 피부+1%", "b"):
        (root / name / "sub").mkdir(parents=True)
    for k in range(6):
        x = np.kron(rng.integers(0, 255, (9, 12, 3)), np.ones((30, 25, 1)))
        x = x * 0.7 + 70 * np.linspace(0, 1, x.shape[1])[None, :, None]
        where = root / ("가 피부+1%" if k % 2 else "b")
        (where / f"p{k}.png").write_bytes(png(x))
        converted(spark, where / f"p{k}.png", where / "sub" / f"p{k}.jpg", "jpg")
        if k == 0:
            converted(spark, where / "p0.png", where / "p0.BMP", "bmp")
            for tag in range(1, 9):
                # What is stored so that it is seen upright through the tag.
                stored = {1: x, 2: x[:, ::-1], 3: x[::-1, ::-1], 4: x[::-1], 5: x.swapaxes(0, 1), 6: np.rot90(x), 7: x[::-1, ::-1].swapaxes(0, 1), 8: np.rot90(x, -1)}[tag]
                (root / f"t{tag}.png").write_bytes(png(stored))
                converted(spark, root / f"t{tag}.png", root / f"t{tag}.jpg", "jpg")
                (where / f"turned{tag}.jpg").write_bytes(turned((root / f"t{tag}.jpg").read_bytes(), tag, "little" if tag % 2 else "big"))
                os.remove(root / f"t{tag}.png"), os.remove(root / f"t{tag}.jpg")
    (root / "b/odd.webp").write_bytes(b"RIFF\x10\0\0\0WEBPVP8 ")
    (root / "b/cut.jpg").write_bytes((root / "b/sub/p0.jpg").read_bytes()[:90])
    (root / "b/empty.png").write_bytes(b"")
    (root / "b/note.txt").write_bytes(b"x")
    return root


def bits(a, b):
    return (int(a, 16) ^ int(b, 16)).bit_count()


def test_records_of_a_tree_of_several_formats(spark, tree):
    rows = {r.path.rsplit("/", 1)[-1]: r for r in images.records(spark, str(tree)).collect()}
    assert len(rows) == 6 + 6 + 1 + 8 + 2  # a file of no bytes is not seen
    bad = {n for n, r in rows.items() if r.error}
    assert bad == {"odd.webp", "cut.jpg"} and all(rows[n].phash is None and rows[n].cls == "b" for n in bad)
    assert (rows["p0.png"].width, rows["p0.png"].height, rows["p0.png"].min_side, rows["p0.png"].fmt, rows["p0.png"].qsig) == (300, 270, 270, "PNG", "na")
    assert rows["p1.jpg"].cls == "가 피부+1%" and rows["p1.jpg"].subclass == "sub" and rows["p1.png"].subclass == "-" and len(rows["p1.jpg"].qsig) == 6
    assert all(bits(rows[f"p{k}.png"].phash, rows[f"p{k}.jpg"].phash) <= 5 for k in range(6)) and rows["p0.BMP"].phash == rows["p0.png"].phash
    for tag in range(1, 9):
        r = rows[f"turned{tag}.jpg"]
        assert bits(r.phash, rows["p0.png"].phash) <= 5 and (r.width, r.height) == (300, 270), tag
        assert r.raw_sig == f"JPEG_300x270_q{r.qsig}" and r.blur == pytest.approx(rows["p0.jpg"].blur, rel=0.2)
        assert np.allclose(r.color_feat, rows["p0.jpg"].color_feat, atol=0.02)


def test_tags_that_cannot_be_read():
    jpeg = b"\xff\xd8\xff\xdb\x00\x03\x00\xff\xda"
    assert images.orientation(jpeg) == 1 and images.orientation(b"") == 1 and images.orientation(turned(jpeg, 6)) == 6
    assert images.orientation(turned(jpeg, 0)) == 1 and images.orientation(turned(jpeg, 9)) == 1
    cut = turned(jpeg, 6)
    assert all(1 <= images.orientation(cut[:n]) <= 8 for n in range(len(cut)))
    x = np.arange(6).reshape(2, 3)
    assert images.upright(x, 6).tolist() == [[3, 0], [4, 1], [5, 2]] and images.upright(x, 99) is x


def test_integrity_decodes_each_file_once(spark, tree, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def decoder(data):
        (log / os.urandom(8).hex()).write_bytes(b"")
        raise ValueError("no")

    tried = images.decodable(spark, str(tree), decoder=decoder)
    row = images.dropped(tried, 1).first()
    assert row.n_dropped == 2 and [p.rsplit("/", 1)[-1] for p in row.first_paths] == ["cut.jpg"]
    assert tried.where("ok").count() == 21 and len(list(log.iterdir())) == 2
    some = images.scan(spark, str(tree)).where(F.col("path").contains("odd") | F.col("path").contains("p0.png"))
    good, report = images.integrity(some, decoder)
    assert good.count() == 0 and report.first().n_dropped == 2 and report.first().n_dropped == 2 and len(list(log.iterdir())) == 4


def test_first_warnings_of_grey_filling(spark, tree):
    seen = images.first_warnings(spark, 2)
    filled = images.grey_filled(images.scan(spark, str(tree)), 4, seen=seen)
    for _ in range(2):  # worked out again, they are the same
        assert filled.where("filled").count() >= 2
        assert len(seen.value) == 2 and all("Error" in w for w in seen.value) and seen.value == sorted(seen.value)


def test_absent_classes_are_warned_about(spark, tree):
    with pytest.warns(UserWarning, match="no images of class zzz"):
        frame = images.directory_frame(spark, str(tree), classes=["b", "zzz"])
    assert {r.class_dir for r in frame.collect()} == {"b"}


def test_curation_of_png_and_jpeg(spark, tree, tmp_path):
    curate.main([str(tree), str(tmp_path / "out"), "--apply", "--blur", "0"])
    rows = manifest.read_manifest(spark, str(tmp_path / "out/manifest.csv")).collect()
    # One of each picture: the copies in other formats and turned ones are near duplicates.
    assert sorted(r["class"] for r in rows) == ["b"] * 3 + ["가 피부+1%"] * 3
    assert all((tmp_path / "out" / r.new_path).exists() for r in rows)
