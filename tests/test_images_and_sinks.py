"""Files in and out: orientation, broken and oversized files, straightening, PNG files, records by batch."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from piiprism.sinks import images as png_files
from piiprism.sinks import records
from piiprism.sources import images, straighten

IMAGES = "path string, height int, width int, channels int, data binary"


def _exif(turn, order="II"):
    e = "<" if order == "II" else ">"
    return order.encode() + struct.pack(f"{e}HIHHHIHH", 42, 8, 2, 0x0100, 3, 1, 7, 0) + struct.pack(f"{e}HHIHH", 0x0112, 3, 1, turn, 0)


def _with_exif(file, tiff):
    chunk = struct.pack(">I", len(tiff)) + b"eXIf" + tiff + struct.pack(">I", zlib.crc32(b"eXIf" + tiff))
    return file[:33] + chunk + file[33:]


def test_orientation_of_files():
    for turn in range(1, 9):
        for order in ("II", "MM"):
            tiff = _exif(turn, order)
            jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", 8 + len(tiff)) + b"Exif\0\0" + tiff + b"\xff\xda"
            assert images.orientation(jpeg) == turn
            assert all(images.orientation(jpeg[:n]) in (1, turn) for n in range(len(jpeg)))
    assert images.orientation(b"") == images.orientation(b"GIF89a") == images.orientation(_exif(3)) == 1


def test_scan_gives_every_file_once(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    # the file holds the picture turned; read upright it is x again
    stored = {1: x, 2: x[:, ::-1], 3: x[::-1, ::-1], 4: x[::-1], 5: x.transpose(1, 0, 2), 6: np.rot90(x), 7: x[::-1, ::-1].transpose(1, 0, 2), 8: np.rot90(x, -1)}
    for turn, y in stored.items():
        (tmp_path / f"turn{turn}.png").write_bytes(_with_exif(png_files.png(np.ascontiguousarray(y)), _exif(turn)))
    (tmp_path / "gray.png").write_bytes(png_files.png(x[:, :, :1]))
    (tmp_path / "clear.png").write_bytes(png_files.png(np.concatenate([x, x[:, :, :1]], axis=2)))
    (tmp_path / "big.png").write_bytes(png_files.png(np.zeros((40, 40, 3), np.uint8)))
    (tmp_path / "cut.png").write_bytes(png_files.png(x)[:60])
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "text.png").write_bytes(b"no image at all")
    rows = {r["path"].rpartition("/")[2]: r for r in images.scan(spark, str(tmp_path), most=1000).collect()}
    assert len(rows) == 13  # files without a byte are not listed
    for turn in stored:
        r = rows[f"turn{turn}.png"]
        assert (r["status"], r["height"], r["width"]) == ("ok", 5, 7) and bytes(r["data"]) == x.tobytes(), turn
    assert bytes(rows["gray.png"]["data"]) == np.repeat(x[:, :, :1], 3, axis=2).tobytes() and bytes(rows["clear.png"]["data"]) == x.tobytes()
    assert {n: r["status"] for n, r in rows.items() if r["status"] != "ok"} == {"big.png": "oversized", "cut.png": "broken", "text.png": "broken"}
    assert rows["big.png"]["message"] == "Image is too large (40x40 px)" and rows["big.png"]["data"] is None


def _flood(mask):
    left, out = {tuple(p) for p in np.argwhere(mask)}, []
    while left:
        todo, part = [left.pop()], []
        while todo:
            y, x = todo.pop()
            part.append((y, x))
            for q in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if q in left:
                    left.remove(q)
                    todo.append(q)
        out.append(sorted(part))
    return sorted(out)


def test_components_equal_a_flood_fill():
    rng = np.random.default_rng(5)
    for density in (0.0, 0.1, 0.3, 0.5, 0.7, 1.0):
        for shape in ((1, 1), (1, 30), (30, 1), (24, 31)):
            mask = rng.random(shape) < density
            found = straighten.components(mask)
            assert sorted(sorted((int(y), x) for y, a, b in part.tolist() for x in range(a, b + 1)) for part in found) == _flood(mask)
            sizes = [int((p[:, 2] - p[:, 1] + 1).sum()) for p in found]
            assert sizes == sorted(sizes, reverse=True)


def test_windows_equal_a_plain_search():
    rng = np.random.default_rng(6)
    x = rng.integers(0, 256, (13, 17), dtype=np.uint8)
    for tall, wide in ((1, 1), (3, 3), (5, 21), (21, 5), (2, 4)):
        for most in (True, False):
            want = np.empty_like(x)
            for y in range(13):
                for z in range(17):
                    a, b = y - (tall - 1) // 2, z - (wide - 1) // 2
                    part = x[max(0, a) : a + tall, max(0, b) : b + wide]
                    want[y, z] = part.max() if most else part.min()
            assert (straighten.extreme(x, tall, wide, most) == want).all()


def test_smallest_rectangle():
    rng = np.random.default_rng(8)
    for turn in (-80, -44, -10, 0, 3, 30, 45, 89):
        a = np.radians(turn)
        box = np.array([[0, 0], [100, 0], [100, 20], [0, 20], *(rng.random((30, 2)) * [100, 20])])
        w, h, found = straighten.smallest_rectangle(box @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]]) + 50)
        assert abs(w - 100) < 1e-6 and abs(h - 20) < 1e-6 and min(abs(found - turn), 180 - abs(found - turn)) < 1e-6
    assert straighten.smallest_rectangle(np.array([[3, 4]]))[0] == 0 and straighten.smallest_rectangle(np.array([[0, 0], [3, 3]]))[2] == 45


def _page(turn):
    """A light page with two rows of strokes near its foot, turned."""
    rng = np.random.default_rng(3)
    page = np.full((700, 1000), 225, np.uint8) + rng.integers(0, 12, (700, 1000), dtype=np.uint8)
    for y in (500, 530):
        for x in range(80, 920, 14):
            page[y : y + 20, x : x + 5 + x % 4] = 30
    return straighten.turned(page, -turn)  # turned with the clock: it falls to the right


def test_planted_turns_are_found(spark):
    turns = [-12.0, -5.0, -1.5, 0.0, 2.0, 7.5, 12.0]
    rows = [(str(t), 700, 1000, 1, _page(t).tobytes()) for t in turns] + [("flat", 30, 40, 3, bytes(3600)), ("none", 0, 0, 3, None)]
    got = {r["path"]: r for r in straighten.prepared(spark.createDataFrame(rows, IMAGES)).collect()}
    assert len(got) == len(turns) + 1 and got["flat"]["angle"] == 0 and got["0.0"]["matrix"] is None
    for t in turns:
        r = got[str(t)]
        assert abs(r["angle"] - t) < 1, (t, r["angle"])
        assert len(r["gray"]) == 700_000 and r["band_top"] == 455 and len(r["band"]) == 245_000
        if t:  # the way back takes the straight page to the frame
            m = np.array(r["matrix"])
            p = straighten.turn_matrix(r["angle"], 1000, 700) @ [100, 500, 1]
            assert np.allclose(m @ [*p, 1], [100, 500])


def test_contrast_is_evened_within_limits():
    x = np.tile(np.linspace(100, 140, 256).astype(np.uint8), (256, 1))
    y = straighten.evened(x)
    assert np.ptp(y.astype(int)) > np.ptp(x.astype(int)) and y.shape == x.shape
    assert np.ptp(straighten.evened(np.full((9, 9), 7, np.uint8))) == 0


def test_png_files_come_back(spark, tmp_path):
    spark.dataSource.register(png_files.PngSink)
    rng, folder = np.random.default_rng(4), tmp_path / "out"
    x = [rng.integers(0, 256, (4 + k, 6, 3), dtype=np.uint8) for k in range(3)]
    rows = [("s3://b/one.jpg", 4, 6, 3, x[0].tobytes()), ("/tmp/a/two.png", 5, 6, 3, x[1].tobytes()), ("/tmp/b/two.png", 6, 6, 3, x[2].tobytes()), ("/none.png", 3, 3, 3, None)]
    frame = spark.createDataFrame(rows, IMAGES).repartition(3)
    for _ in range(2):  # a rerun replaces
        frame.write.format("png_files").mode("append").save(str(folder))
        assert sorted(p.name for p in folder.iterdir()) == ["redacted_one.png", "redacted_two-2.png", "redacted_two.png"]
    back = {r["path"].rpartition("/")[2]: bytes(r["data"]) for r in images.scan(spark, str(folder)).collect()}
    assert back == {"redacted_one.png": x[0].tobytes(), "redacted_two.png": x[1].tobytes(), "redacted_two-2.png": x[2].tobytes()}
    frame.where("path LIKE '%one%'").write.format("png_files").mode("overwrite").save(str(folder))
    assert [p.name for p in folder.iterdir()] == ["redacted_one.png"]


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(png_files.PngSink)
    rows = [(f"/a/{k}.png", 2, 2, 3, bytes(12 if k < 9 else 5)) for k in range(10)]  # the last has too few bytes
    with pytest.raises(Exception):  # noqa: B017
        spark.createDataFrame(rows, IMAGES).repartition(4).write.format("png_files").mode("append").save(str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or list((tmp_path / "out").iterdir()) == []


def test_a_batch_that_runs_twice_is_written_once(spark, tmp_path):
    folder = str(tmp_path / "log")
    rows = spark.createDataFrame([('{"a": 1}',), ('{"b": "x\\n"}',), (None,)], "report string")
    for batch in (0, 1, 1, 0):
        records.write_batch(rows, folder, batch)
    got = records.read_batches(spark, folder).groupBy("batch").agg(F.count("*").alias("n")).collect()
    assert {(r["batch"], r["n"]) for r in got} == {(0, 2), (1, 2)}


def test_records_of_a_stream(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "log")
    spark.range(20).selectExpr("concat('{\"id\": ', id, '}') AS report").repartition(4).write.parquet(str(src))
    stream = spark.readStream.schema("report string").option("maxFilesPerTrigger", 1).parquet(str(src))
    for _ in range(2):
        records.write_stream(stream, out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = [r["report"] for r in records.read_batches(spark, out).collect()]
    assert len(got) == len(set(got)) == 20
