"""Image trees as records: scan, decode, perceptual hash, sharpness, colour, quantization fingerprint.

Files are listed and read by Spark's ``binaryFile`` source. ``records`` decodes on the JVM, by Spark's ``image``
source: PNG, JPEG, BMP, GIF and what else its ImageIO reads. What that can't decode goes to a decoder
(bytes -> (rows, columns, 3) uint8 array); built in is one for binary PPM and PGM,
other formats need an installed library. An undecodable file becomes a row
with an error and never stops the job.
"""

from __future__ import annotations

import hashlib
import importlib.util
import io
import re
import warnings
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.accumulators import Accumulator, AccumulatorParam
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.sources.shared import file_system, written

# The extensions of images.
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")
_KINDS = {"path": T.StringType(), "phash": T.StringType(), "width": T.IntegerType(), "height": T.IntegerType(), "min_side": T.IntegerType(), "blur": T.DoubleType()}
_KINDS |= {"fmt": T.StringType(), "qsig": T.StringType(), "raw_sig": T.StringType(), "color_feat": T.ArrayType(T.DoubleType()), "error": T.StringType()}
RECORD = T.StructType([T.StructField(name, kind) for name, kind in _KINDS.items()])
Decoder = Callable[[bytes], np.ndarray]


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, content, cls and subclass of the images under ``root``/class/...; the extension's case doesn't count.

    ``subclass`` is the first folder under the class, else ``-``. Fails if ``root`` is missing. Files without a byte are
    not seen, as Spark's file sources leave them out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    images = files.where(F.lower("path").rlike(rf"\.({'|'.join(extensions)})\z"))
    rest = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root.removeprefix("file://").rstrip("/")) + "/", "")
    parts = F.split(rest, "/")
    sub = F.when(F.size(parts) > 2, F.element_at(parts, 2)).otherwise("-")
    return images.select("path", "content", F.element_at(parts, 1).alias("cls"), sub.alias("subclass"))


def root_of(spark: SparkSession, root: str) -> str:
    """``root`` as the paths of its files begin."""
    fs, where = file_system(spark, root)
    return re.sub("^file:/+", "file:/", fs.makeQualified(where).toString()).rstrip("/")


def listing(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """(path, cls) of the images under ``root``; no content is read."""
    return scan(spark, root, extensions).select("path", "cls")


def of_classes(images: DataFrame, classes: list[str]) -> DataFrame:
    """The images of the listed classes; a listed class without any is warned about and has no rows."""
    found = {r.cls for r in images.where(F.col("cls").isin(classes)).select("cls").distinct().collect()}
    for name in classes:
        if name not in found:
            warnings.warn(f"no images of class {name}", stacklevel=2)
    return images.where(F.col("cls").isin(classes))


def directory_frame(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, classes: list[str] | None = None) -> DataFrame:
    """What stands in for a manifest where there is none: path, class_dir, source, vcluster and phash, the last three ``-``, by path.

    With ``classes`` only these, and those without images are warned about.
    """
    unknown = [F.lit("-").alias(c) for c in ("source", "vcluster", "phash")]
    found = listing(spark, root, extensions)
    found = found if classes is None else of_classes(found, classes)
    return found.select("path", F.col("cls").alias("class_dir"), *unknown).orderBy("path")


def sampled_files(images: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """``n`` of the images, drawn by a hash of path and seed: the same however files are listed. All, if there are no more."""
    return images.orderBy(F.md5(F.concat_ws(":", "path", F.lit(str(seed)))), "path").limit(n)


def class_counts(images: DataFrame, extensions: tuple[str, ...] = ("jpg", "jpeg", "png")) -> DataFrame:
    """(cls, n, label): files of each class; the label is the class's rank by name."""
    n = images.where(F.lower("path").rlike(rf"\.({'|'.join(extensions)})\z")).groupBy("cls").agg(F.count("*").alias("n"))
    from pyspark.sql.window import Window

    return n.withColumn("label", F.row_number().over(Window.orderBy("cls")) - 1)


def decode_netpbm(data: bytes) -> np.ndarray:
    """Binary PPM (P6) and PGM (P5) of 8 bits."""
    m = re.match(rb"(P[56])\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+(\d+)\s", data)
    if not m or int(m[4]) > 255:
        raise ValueError("not a binary 8-bit PPM or PGM")
    w, h, depth = int(m[2]), int(m[3]), 3 if m[1] == b"P6" else 1
    x = np.frombuffer(data, np.uint8, w * h * depth, m.end()).reshape(h, w, depth)
    return np.repeat(x, 3, axis=2) if depth == 1 else x


def decode(data: bytes) -> np.ndarray:
    if data[:1] == b"P":
        return decode_netpbm(data)
    if importlib.util.find_spec("PIL"):
        from PIL import Image, ImageOps

        return np.asarray(ImageOps.exif_transpose(Image.open(io.BytesIO(data))).convert("RGB"))
    raise ValueError("no decoder for this format is installed")


def resized(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Mean over boxes when shrinking, nearest when growing."""
    rows, cols = np.linspace(0, x.shape[0], h + 1), np.linspace(0, x.shape[1], w + 1)
    lo, hi = rows[:-1].astype(int), np.maximum(rows[1:].astype(int), rows[:-1].astype(int) + 1)
    x = np.stack([x[a:b].mean(0) for a, b in zip(lo, hi, strict=True)])
    lo, hi = cols[:-1].astype(int), np.maximum(cols[1:].astype(int), cols[:-1].astype(int) + 1)
    return np.stack([x[:, a:b].mean(1) for a, b in zip(lo, hi, strict=True)], axis=1)


def grey(rgb: np.ndarray) -> np.ndarray:
    return rgb.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


#: Side of the image that is hashed.
SIDE = 32


def hash_of(small: np.ndarray) -> str:
    """64 bits: which of the lowest 8 x 8 cosine coefficients of a 32 x 32 grey image exceed their median."""
    k, i = np.arange(SIDE)[:, None], np.arange(SIDE)[None]
    basis = np.cos(np.pi * k * (2 * i + 1) / (2 * SIDE))
    low = (basis @ small @ basis.T)[:8, :8]
    return f"{int(''.join('1' if b else '0' for b in (low > np.median(low)).reshape(-1)), 2):016x}"


def perceptual_hash(rgb: np.ndarray) -> str:
    """``hash_of`` the image, shrunk."""
    return hash_of(resized(grey(rgb), SIDE, SIDE))


def upright(x: np.ndarray, orientation: int) -> np.ndarray:
    """An image as it should be seen, by its orientation tag (1 to 8; anything else: as it is)."""
    turned = {2: lambda: x[:, ::-1], 3: lambda: x[::-1, ::-1], 4: lambda: x[::-1], 5: lambda: x.swapaxes(0, 1), 6: lambda: np.rot90(x, -1), 7: lambda: x[::-1, ::-1].swapaxes(0, 1), 8: lambda: np.rot90(x)}
    return turned[orientation]() if orientation in turned else x


def blur_score(rgb: np.ndarray, side: int = 256) -> float:
    """Variance of the 4-neighbour Laplacian of the grey image, shrunk to at most ``side``; 0 if it has no inside."""
    g = grey(rgb)
    f = max(g.shape) / side
    if f > 1:
        g = resized(g, max(1, round(g.shape[0] / f)), max(1, round(g.shape[1] / f)))
    inner = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(inner.var()) if inner.size else 0.0


def colour_stats(rgb: np.ndarray) -> list[float]:
    """Mean, then population deviation of the three channels of the 32 x 32 image, from 0 to 1."""
    x = resized(rgb.astype(np.float64) / 255, 32, 32).reshape(-1, 3)
    return [*x.mean(0).tolist(), *x.std(0).tolist()]


def segments(data: bytes) -> list[tuple[int, int, int]]:
    """(marker, first byte, end) of a JPEG's segments before its scan; none for other data."""
    out, at = [], 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        out.append((data[at + 1], at + 4, at + 2 + size))
        at += 2 + max(size, 2)
    return out


def orientation(data: bytes) -> int:
    """The orientation tag (0x0112) of a JPEG's Exif segment; 1 where there is none, or none that can be read."""
    for marker, first, end in segments(data):
        if marker == 0xE1 and data[first : first + 6] == b"Exif\0\0":
            tiff = data[first + 6 : end]
            order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
            if order is None:
                return 1
            number = lambda at, n: int.from_bytes(tiff[at : at + n], order)  # noqa: B023, E731
            ifd = number(4, 4)
            for k in range(number(ifd, 2)):
                if number(ifd + 2 + 12 * k, 2) == 0x0112:
                    found = number(ifd + 10 + 12 * k, 2)
                    return found if 1 <= found <= 8 else 1
    return 1


def quantization_signature(data: bytes) -> str:
    """Six hexadecimal digits for a JPEG's quantization tables (first 16 values of each, by table number), else ``na``."""
    tables: dict[int, list[int]] = {}
    for marker, p, end in segments(data):
        if marker == 0xDB:
            while p < end:
                wide, number = data[p] >> 4, data[p] & 15
                step = 2 if wide else 1
                tables[number] = [int.from_bytes(data[p + 1 + i * step : p + 1 + (i + 1) * step], "big") for i in range(64)]
                p += 1 + 64 * step
    if not tables:
        return "na"
    said = ",".join(str(v) for k in sorted(tables) for v in tables[k][:16])
    return hashlib.md5(said.encode()).hexdigest()[:6]


# How files of each format begin.
MAGIC = {b"\xff\xd8": "JPEG", b"\x89PNG": "PNG", b"BM": "BMP", b"II*\0": "TIFF", b"MM\0*": "TIFF", b"RIFF": "WEBP", b"P6": "PPM", b"P5": "PPM"}


def format_of(path: str, data: bytes) -> str:
    return next((v for k, v in MAGIC.items() if data.startswith(k)), path.rpartition(".")[2].upper())


def profile(path: str, data: bytes, decoder: Decoder = decode) -> dict:
    """The record of an image, or its path and the error."""
    try:
        fmt = format_of(path, data)
        q, rgb = quantization_signature(data), decoder(data)
        h, w = rgb.shape[:2]
        return {
            "path": path, "phash": perceptual_hash(rgb), "width": w, "height": h, "min_side": min(w, h), "blur": blur_score(rgb),
            "fmt": fmt, "qsig": q, "raw_sig": f"{fmt}_{w}x{h}_q{q}", "color_feat": colour_stats(rgb), "error": None,
        }
    except Exception as e:  # whatever is wrong with a file is a row, by contract
        return {c: None for c in RECORD.names} | {"path": path, "error": f"{type(e).__name__}: {e}"}


def profiled(images: DataFrame, decoder: Decoder = decode) -> DataFrame:
    """Records of scanned images, with cls and subclass; ``error`` is null for sound ones."""
    schema = T.StructType([*RECORD.fields, T.StructField("cls", T.StringType()), T.StructField("subclass", T.StringType())])

    def run(batches):
        for pdf in batches:
            rows = [profile(p, bytes(c), decoder) | {"cls": k, "subclass": s} for p, c, k, s in zip(pdf.path, pdf.content, pdf.cls, pdf.subclass, strict=True)]
            yield pd.DataFrame(rows, columns=schema.names)

    return images.select("path", "content", "cls", "subclass").mapInPandas(run, schema)


HEAD = "orientation int, qsig string, fmt string"


def heads(images: DataFrame) -> DataFrame:
    """path, cls, subclass and what a file's bytes say before they are decoded: orientation, qsig and fmt."""

    @F.pandas_udf(HEAD)
    def head(path: pd.Series, content: pd.Series) -> pd.DataFrame:
        data = [bytes(c) for c in content]
        return pd.DataFrame({"orientation": [orientation(d) for d in data], "qsig": [quantization_signature(d) for d in data], "fmt": [format_of(p, d) for p, d in zip(path, data, strict=True)]})

    return images.select("path", "cls", "subclass", head("path", "content").alias("h")).select("path", "cls", "subclass", "h.*")


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:/")


def decoded(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """path, height, width, channels and data (blue first) of the images under ``root``, decoded by the JVM; null data where it can't."""
    rows = spark.read.format("image").option("recursiveFileLookup", True).option("dropInvalid", False).load(root).select("image.*")
    # The source percent-encodes its paths.
    path = F.coalesce(F.try_url_decode(F.replace("origin", F.lit("+"), F.lit("%2B"))), "origin")
    rows = rows.select(_plain(path).alias("path"), "height", "width", F.col("nChannels").alias("channels"), F.when(F.col("height") > 0, F.col("data")).alias("data"))
    return rows.where(F.lower("path").rlike(rf"\.({'|'.join(extensions)})\z"))


PIXELS = "path string, width int, height int, blur double, color_feat array<double>, small binary"


def pixel_features(pixels: DataFrame) -> DataFrame:
    """path, width, height, blur, color_feat and small (the 32 x 32 grey image, float32) of ``decoded`` rows; pixels go no further."""

    def run(batches):
        for pdf in batches:
            out = []
            for path, h, w, channels, data in zip(pdf.path, pdf.height, pdf.width, pdf.channels, pdf.data, strict=True):
                x = np.frombuffer(data, np.uint8).reshape(h, w, channels)
                rgb = x[:, :, 2::-1] if channels >= 3 else np.repeat(x[:, :, :1], 3, axis=2)
                out.append((path, w, h, blur_score(rgb), colour_stats(rgb), resized(grey(rgb), SIDE, SIDE).astype("<f4").tobytes()))
            yield pd.DataFrame(out, columns=["path", "width", "height", "blur", "color_feat", "small"])

    return pixels.where("data IS NOT NULL").mapInPandas(run, PIXELS)


def records(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, decoder: Decoder = decode) -> DataFrame:
    """``profiled`` for the images under ``root``, decoded by the JVM, each file once; what it can't decode goes to ``decoder``.

    Size and hash are those of the upright image, by the orientation tag; blur and colours don't hang on it but for
    rounding. Only features are shuffled, no pixels and no file.
    """
    seen = scan(spark, root, extensions)
    known = heads(seen).withColumn("path", _plain(F.col("path")))
    both = written(known.join(pixel_features(decoded(spark, root, extensions)), "path", "left"), "profiled")

    @F.pandas_udf(T.StringType())
    def hashed(small: pd.Series, turn: pd.Series) -> pd.Series:
        return pd.Series([hash_of(upright(np.frombuffer(s, "<f4").reshape(SIDE, SIDE).astype(float), t)) for s, t in zip(small, turn, strict=True)])

    turned = F.col("orientation") >= 5
    found = both.where("small IS NOT NULL").withColumns({"w": F.when(turned, F.col("height")).otherwise(F.col("width")), "h": F.when(turned, F.col("width")).otherwise(F.col("height"))})
    made = found.select(
        "path", hashed("small", "orientation").alias("phash"), F.col("w").alias("width"), F.col("h").alias("height"), F.least("w", "h").alias("min_side"), "blur", "fmt", "qsig",
        F.concat("fmt", F.lit("_"), F.col("w").cast("string"), F.lit("x"), F.col("h").cast("string"), F.lit("_q"), "qsig").alias("raw_sig"), "color_feat", F.lit(None).cast("string").alias("error"), "cls", "subclass",
    )
    rest = both.where("small IS NULL").select(F.col("path").alias("__sw_path"))
    others = profiled(seen.join(rest, _plain(F.col("path")) == F.col("__sw_path"), "left_semi"), decoder)
    return made.unionByName(others.withColumn("path", _plain(F.col("path"))))


class _Least(AccumulatorParam):
    """The least ``n`` of all values: adding again what a repeated task has added changes nothing."""

    def __init__(self, n: int):
        self.n = n

    def zero(self, value):
        return []

    def addInPlace(self, a, b):
        return sorted({*a, *b})[: self.n]


def first_warnings(spark: SparkSession, n: int = 20) -> Accumulator:
    """An accumulator of the first ``n`` warnings by name, for ``grey_filled``; its ``value`` is a list after an action."""
    return spark.sparkContext.accumulator([], _Least(n))


def grey_filled(images: DataFrame, size: int, decoder: Decoder = decode, seen: Accumulator | None = None) -> DataFrame:
    """(path, pixels, filled): ``size`` x ``size`` x 3 bytes of each image by nearest pixel; grey of 128, and ``filled``, where it can't be decoded.

    ``seen`` (``first_warnings``) gets the path and error of such images as the result is worked out.
    """
    schema = T.StructType().add("path", T.StringType()).add("pixels", T.BinaryType()).add("filled", T.BooleanType())

    def pixels(path: str, content: bytes) -> tuple[bytes, bool]:
        try:
            x = decoder(content)
            rows, columns = (np.arange(size) * n // size for n in x.shape[:2])
            return x[rows][:, columns].astype(np.uint8).tobytes(), False
        except Exception as e:  # whatever a decoder raises on a broken file
            if seen is not None:
                seen.add([f"{path}: {type(e).__name__}: {e}"])
            return bytes([128]) * (3 * size * size), True

    def run(batches):
        for pdf in batches:
            made = [pixels(p, bytes(c)) for p, c in zip(pdf.path, pdf.content, strict=True)]
            yield pd.DataFrame({"path": pdf.path, "pixels": [m[0] for m in made], "filled": [m[1] for m in made]})

    return images.select("path", "content").mapInPandas(run, schema)


def decodable(spark: SparkSession, root: str, extensions: tuple[str, ...] = EXTENSIONS, decoder: Decoder = decode) -> DataFrame:
    """(path, ok) of the images under ``root``, each decoded once: by the JVM, or by ``decoder`` where that can't. Written."""
    jvm = written(decoded(spark, root, extensions).select("path", F.col("data").isNotNull().alias("ok")), "decodable")
    rest = scan(spark, root, extensions).withColumn("path", _plain(F.col("path"))).join(jvm.where("NOT ok").select("path"), "path", "left_semi")
    return jvm.where("ok").unionByName(_tried(rest, decoder))


def _tried(images: DataFrame, decoder: Decoder) -> DataFrame:
    """(path, ok) of scanned images: whether they can be decoded, each once. Written, so neither count nor filter decodes again."""

    @F.pandas_udf(T.BooleanType())
    def ok(content: pd.Series) -> pd.Series:
        def holds(c) -> bool:
            try:
                decoder(bytes(c))
                return True
            except Exception:  # whatever a decoder raises on a broken file
                return False

        return content.map(holds).astype(bool)

    return written(images.select("path", ok("content").alias("ok")), "tried")


def dropped(tried: DataFrame, listed: int = 10) -> DataFrame:
    """One row (n_dropped, first_paths): the files that can't be decoded, and the first ``listed`` of them by name."""
    bad = tried.where("NOT ok")
    first = bad.orderBy("path").limit(listed).agg(F.array_sort(F.collect_list("path")).alias("first_paths"))
    return bad.agg(F.count("*").alias("n_dropped")).join(F.broadcast(first))  # two rows


def integrity(images: DataFrame, decoder: Decoder = decode, listed: int = 10) -> tuple[DataFrame, DataFrame]:
    """(the sound images, ``dropped``): each image is decoded once, whatever is asked of the two afterwards."""
    tried = _tried(images, decoder)
    return images.join(tried.where("ok").select("path"), "path", "left_semi"), dropped(tried, listed)


def sound(images: DataFrame, decoder: Decoder = decode) -> DataFrame:
    """Integrity scan: the rows whose content can be decoded."""
    return integrity(images, decoder)[0]
