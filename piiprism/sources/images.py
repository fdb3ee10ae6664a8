"""Images as tables: decoding, size guard, and the pixel filters (Arrow batches, numpy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FILTERS = {"solid_black": "black", "black": "black", "dp_pix": "dp_pix", "pixelate": "dp_pix", "gaussian_blur": "blur", "blur": "blur"}


def read(spark: SparkSession, path: str, most: int = 60_000_000) -> DataFrame:
    """path, height, width, channels, data (BGR rows) of the images under a path that fit the size guard.

    Files that are no images are dropped; orientation tags are not applied.
    """
    rows = spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")
    return rows.select(F.col("origin").alias("path"), "height", "width", F.col("nChannels").alias("channels"), "data").where(F.col("height").cast("long") * F.col("width") <= most)


def orientation(head: bytes) -> int:
    """The orientation (1 to 8) that a file's first bytes tell: tag 0x0112 of the EXIF record of a JPEG or PNG file; 1 where
    there is none, or no whole one."""
    tiff = b""
    if head[:2] == b"\xff\xd8":  # segments: marker, size, data
        at = 2
        while at + 4 <= len(head) and head[at] == 0xFF and head[at + 1] not in (0xD9, 0xDA):
            size = int.from_bytes(head[at + 2 : at + 4], "big")
            if head[at + 1] == 0xE1 and head[at + 4 : at + 10] == b"Exif\0\0":
                tiff = head[at + 10 : at + 2 + size]
                break
            at += 2 + max(2, size)
    elif head[:8] == b"\x89PNG\r\n\x1a\n":  # chunks: size, kind, data, check
        at = 8
        while at + 8 <= len(head):
            size, kind = int.from_bytes(head[at : at + 4], "big"), head[at + 4 : at + 8]
            if kind in (b"eXIf", b"IDAT"):
                tiff = head[at + 8 : at + 8 + size] if kind == b"eXIf" else b""
                break
            at += 12 + size
    order = {b"II*\0": "little", b"MM\0*": "big"}.get(tiff[:4])
    if order is None:
        return 1
    number = lambda a, n: int.from_bytes(tiff[a : a + n], order)
    first = number(4, 4)
    for at in range(first + 2, min(first + 2 + 12 * number(first, 2), len(tiff) - 11), 12):
        if number(at, 2) == 0x0112:
            return number(at + 8, 2) if number(at + 2, 2) == 3 and 1 <= number(at + 8, 2) <= 8 else 1
    return 1


def upright(pixels: np.ndarray, turn: int) -> np.ndarray:
    """Pixels (height, width, channels) as they are to be seen, by the orientation of their file."""
    if turn >= 5:
        pixels = pixels.transpose(1, 0, 2)
    # what is left, beside the exchange of rows and columns: which of the two sides run backwards
    down, across = {1: (0, 0), 2: (0, 1), 3: (1, 1), 4: (1, 0), 5: (0, 0), 6: (0, 1), 7: (1, 1), 8: (1, 0)}[turn]
    return pixels[:: -1 if down else 1, :: -1 if across else 1]


SCANNED = "path string, status string, message string, height int, width int, channels int, data binary"
#: Bytes of a file in which its orientation is looked for.
HEAD = 1 << 16


def scan(spark: SparkSession, path: str, most: int = 60_000_000) -> DataFrame:
    """SCANNED: a row for each file under a path, upright, in BGR; gray and transparent images become BGR too.

    status: ok; broken (no image, or not a whole one: no pixels); oversized (more than `most` pixels: sizes, no pixels).
    Spark lists no files without a byte, so those have no row.
    """
    files = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, HEAD).alias("head"))
    rows = spark.read.format("image").option("ignoreCorruptFiles", True).load(path).select("image.*").where("height > 0 AND width > 0")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    both = files.withColumn("key", plain("path")).join(rows.select(plain("origin").alias("key"), "height", "width", "nChannels", "data"), "key", "left")
    big = F.col("height").cast("long") * F.col("width") > most
    both = both.select("path", "head", "height", "width", "nChannels", F.when(~big, F.col("data")).alias("data"), F.when(F.col("height").isNull(), "broken").when(big, "oversized").otherwise("ok").alias("status"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                row = {"path": r["path"], "status": r["status"], "message": None, "height": r["height"], "width": r["width"], "channels": None, "data": None}
                turn = orientation(r["head"] or b"")
                if r["status"] == "broken":
                    row["message"] = "Unable to decode image"
                elif r["status"] == "oversized":
                    row["message"] = f"Image is too large ({r['width']}x{r['height']} px)"
                else:
                    x = upright(np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"]), turn)
                    x = np.repeat(x, 3, axis=2) if x.shape[2] == 1 else x[:, :, :3]
                    row |= {"height": x.shape[0], "width": x.shape[1], "channels": 3, "data": np.ascontiguousarray(x).tobytes()}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("status", pa.string()), ("message", pa.string()), ("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("data", pa.binary())]))

    return both.mapInArrow(run, SCANNED)


def statistics(pixels: DataFrame, key: str = "image") -> DataFrame:
    """key, luminance, contrast, sharpness, white (above 200), bright (above 185), skin: of pixels (key, x, y, r, g, b).

    Contrast is the deviation of the luminance, sharpness the variance of its Laplacian; beyond an edge stands the pixel
    before it. Neighbours come from windows over a row and a column, so a large image is no single task's work.
    """
    # fixed values: luminance in 14 bits, chroma of full range, and the limits of skin
    gray = F.floor((F.col("r") * 4899 + F.col("g") * 9617 + F.col("b") * 1868 + 8192) / 16384).cast("int")
    red = F.floor((F.col("r") - F.col("gray")) * 0.713 + 128.5)
    blue = F.floor((F.col("b") - F.col("gray")) * 0.564 + 128.5)

    skin = red.between(133, 173) & blue.between(77, 127)
    # one number for all that is asked of a pixel: it is dealt twice, and its colours stay behind
    bit = lambda c, n: c.cast("int") * n
    code = (F.col("gray") * 8 + bit(F.col("gray") > 200, 4) + bit(F.col("gray") > 185, 2) + bit(skin, 1)).cast("int")
    p = pixels.withColumn("gray", gray).select(key, "x", "y", code.alias("code"))
    shade = lambda c: F.shiftright(c, 3)

    def sides(line: str, along: str):
        w = Window.partitionBy(key, line).orderBy(along)
        before, after, own = shade(F.lag("code").over(w)), shade(F.lead("code").over(w)), shade(F.col("code"))
        return F.coalesce(before, after, own) + F.coalesce(after, before, own)

    p = p.select(key, "x", "code", "y", sides("y", "x").alias("beside")).select(key, "code", (F.col("beside") + sides("x", "y")).alias("around"))
    p = p.select(key, shade(F.col("code")).alias("gray"), "code", (F.col("around") - 4 * shade(F.col("code"))).alias("lap"))
    share = lambda n: F.avg(F.shiftright(F.col("code").bitwiseAND(n), n.bit_length() - 1))
    return p.groupBy(key).agg(
        F.avg("gray").alias("luminance"), F.stddev_pop("gray").alias("contrast"), F.var_pop("lap").alias("sharpness"), share(4).alias("white"), share(2).alias("bright"), share(1).alias("skin"),
    )


def _cells(n: int, parts: int) -> np.ndarray:
    return np.minimum(np.arange(n) * parts // max(1, n), parts - 1)


def dp_pix(crop: np.ndarray, block: int = 16, sigma: float = 8.0, seed: int | None = None) -> np.ndarray:
    """Block means with one noise value for each cell and channel, spread over the cell."""
    h, w = crop.shape[:2]
    if not h or not w:
        return crop
    block = max(2, int(block))
    rows, cols = _cells(h, max(1, h // block)), _cells(w, max(1, w // block))
    n, m = rows[-1] + 1, cols[-1] + 1
    place = rows[:, None] * m + cols
    flat = crop.reshape(h * w, -1).astype(np.float64)
    count = np.bincount(place.ravel(), minlength=n * m)
    small = np.stack([np.bincount(place.ravel(), flat[:, c], minlength=n * m) / count for c in range(flat.shape[1])], axis=1)
    small = np.rint(small)
    if sigma > 0:
        small = np.clip(small + np.random.default_rng(seed).normal(0, sigma, small.shape), 0, 255)
    return small.astype(np.uint8)[place].reshape(crop.shape)


def blur(crop: np.ndarray, size: int = 51) -> np.ndarray:
    """Separable Gaussian blur; the kernel is odd and no larger than the crop."""
    h, w = crop.shape[:2]
    k = min(size | 1, (min(h, w) - 1) | 1) if h and w else 0
    if k < 3:
        return crop
    sigma = 0.3 * ((k - 1) * 0.5 - 1) + 0.8
    x = np.arange(k) - k // 2
    kernel = np.exp(-x * x / (2 * sigma * sigma))
    kernel /= kernel.sum()
    out = crop.astype(np.float64)
    for axis in (0, 1):
        padded = np.pad(out, [(k // 2, k // 2) if a == axis else (0, 0) for a in range(out.ndim)], mode="reflect" if out.shape[axis] > k // 2 else "edge")
        out = sum(kernel[i] * np.take(padded, np.arange(i, i + crop.shape[axis]), axis=axis) for i in range(k))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def redact(images: DataFrame, boxes: DataFrame, kind: str = "dp_pix", block: int = 16, sigma: float = 8.0, seed: int | None = None) -> DataFrame:
    """images with the boxes (path, x1, y1, x2, y2) made unreadable; boxes are clamped, empty and inverted ones do nothing."""
    if kind not in FILTERS:
        raise ValueError(f"unknown filter {kind!r}")
    kind = FILTERS[kind]
    own = boxes.groupBy("path").agg(F.collect_list(F.array("x1", "y1", "x2", "y2")).alias("boxes"))
    names = images.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, w, c, data, found in zip(*(b.column(n).to_pylist() for n in ("height", "width", "channels", "data", "boxes")), strict=True):
                x = np.frombuffer(data, np.uint8).reshape(h, w, c).copy()
                for x1, y1, x2, y2 in found or []:
                    x1, x2, y1, y2 = max(0, x1), min(w, x2), max(0, y1), min(h, y2)
                    if x1 < x2 and y1 < y2:
                        crop = x[y1:y2, x1:x2]
                        x[y1:y2, x1:x2] = 0 if kind == "black" else dp_pix(crop, block, sigma, seed) if kind == "dp_pix" else blur(crop)
                out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()) if n == "data" else b.column(n) for n in names], names)

    return images.join(own, "path", "left").mapInArrow(run, images.schema)
