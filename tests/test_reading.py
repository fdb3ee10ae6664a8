"""The reading program and the joins of boxes against plain Python over whole pages."""

import random

import pytest
from pyspark.sql import functions as F

from piiprism.operators import find, geometry, lines, reading
from piiprism.sources import ocr

READ = "page long, id long, text string, conf double, poly array<array<double>>"


def _quad(x1, y1, x2, y2):
    return [[x1, y1], [x2, y1], [x2, y2], [x1, y2]]


def _pages(seed, n=12):
    """Pages of words, addresses, dates in halves, repeated readings and smudges in jittered rows."""
    rng, rows = random.Random(seed), []
    for page in range(n):
        i = 0
        for row in range(rng.randint(1, 9)):
            x, y = rng.uniform(5, 60), 30 + row * 40 + rng.uniform(-3, 3)
            for _ in range(rng.randint(1, 5)):
                said = rng.choice(["plain", "words", f"mail{rng.randint(1, 99)}@acme-post.com", "+1 415 555 0134", "14 JAN", "1999", "Date of birth", "lot", "(415) 555-0199"])
                w, h, conf = 9.0 * len(said), rng.uniform(16, 22), round(rng.uniform(0.05, 1), 2)
                dy = rng.uniform(-4, 4)
                box = (x, y + dy, x + w, y + dy + h)
                rows.append((page, i, said, conf, _quad(*box)))
                if rng.random() < 0.2:  # read twice, a little off
                    rows.append((page, 1000 + i, said if rng.random() < 0.7 else said + " .", round(rng.uniform(0.2, 1), 2), _quad(box[0] + 2, box[1] + 1, box[2] + 2, box[3] + 1)))
                i += 1
                x += w + rng.choice([8.0, 12.0, 70.0])
    return rows


def _kept(rows):
    """Readings of one page by the rules: the surest of a spot, then dates with their years."""
    key = lambda t: "".join(c for c in t.lower() if c.isascii() and c.isalnum())
    said = []
    for page, i, t, conf, poly in sorted(rows, key=lambda r: r[1]):
        if conf >= 0.2:
            said.append({"page": page, "id": i, "text": t, "conf": conf, "box": (poly[0][0], poly[0][1], poly[2][0], poly[2][1])})
    kept = []
    for r in sorted(said, key=lambda r: -r["conf"]):
        twin = next((k for k, o in enumerate(kept) if _iou(r["box"], o["box"]) > 0.45 and geometry.similar(key(r["text"]), key(o["text"]))), None)
        bare = lambda o: "".join(o["text"].lower().split())
        if twin is None:
            kept.append(r)
        elif len(bare(r)) > len(bare(kept[twin])) and bare(kept[twin]) in bare(r):
            kept[twin] = r
    left = sorted(kept, key=lambda r: (round((r["box"][1] + r["box"][3]) / 2), r["box"][0]))
    out, used = [], set()
    for a, r in enumerate(left):
        if a in used:
            continue
        if r["text"] == "14 JAN":
            for b in range(a + 1, len(left)):
                o = left[b]
                (x1, y1, x2, y2), (u1, v1, u2, v2) = r["box"], o["box"]
                if b not in used and o["text"] == "1999" and min(y2, v2) - max(y1, v1) >= 0.45 * min(y2 - y1, v2 - v1) and -2 <= u1 - x2 <= 6 * max(y2 - y1, v2 - v1):
                    used.add(b)
                    r = r | {"text": "14 JAN 1999", "conf": min(r["conf"], o["conf"]), "box": (min(x1, u1), min(y1, v1), max(x2, u2), max(y2, v2))}
                    break
        out.append(r)
    return out


def _iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    area = lambda c: (c[2] - c[0]) * (c[3] - c[1])
    return w * h / (area(a) + area(b) - w * h) if w > 0 and h > 0 else 0.0


def _lines(boxes):
    mid, high = (lambda r: (r["box"][1] + r["box"][3]) / 2), (lambda r: r["box"][3] - r["box"][1])
    groups = []
    for r in sorted(boxes, key=lambda r: (mid(r), r["box"][0])):
        for g in groups:
            if abs(mid(r) - sum(map(mid, g)) / len(g)) <= 0.5 * min(high(r), sum(map(high, g)) / len(g)) + 1:
                g.append(r)
                break
        else:
            groups.append([r])
    cut = []
    for g in groups:
        g.sort(key=lambda r: r["box"][0])
        part = [g[0]]
        for r in g[1:]:
            if r["box"][0] - part[-1]["box"][2] > 2.5 * max(high(r), high(part[-1])):
                cut.append(part)
                part = []
            part.append(r)
        cut.append(part)
    return sorted(cut, key=lambda g: (sum(map(mid, g)) / len(g), g[0]["box"][0]))


def _with_values(found):
    """A row of lines on the baseline under "Date of birth" is one box if it says a date."""
    mid, high = (lambda r: (r["box"][1] + r["box"][3]) / 2), (lambda r: r["box"][3] - r["box"][1])
    out, k = [], 0
    while k < len(found):
        out.append(found[k])
        step = 1
        if " ".join(r["text"] for r in found[k]) in ("Date of birth", "Date of birth Date of birth", "Date of birth Date of birth Date of birth") and k + 1 < len(found):
            base = found[k + 1]
            cy, h, row, end = sum(map(mid, base)) / len(base), max(map(high, base)), list(base), k + 2
            while end < len(found) and abs(sum(map(mid, found[end])) / len(found[end]) - cy) <= 0.5 * max(h, max(map(high, found[end]))) + 1:
                row += found[end]
                end += 1
            said = " ".join(r["text"] for r in sorted(row, key=lambda r: r["box"][0]))
            if len(row) > 1 and said == "14 JAN 1999":
                boxes = [r["box"] for r in row]
                out.append([{"text": said, "conf": min(r["conf"] for r in row), "box": (min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes))}])
                step = end - k
        k += step
    return out


@pytest.fixture(scope="module")
def pages():
    return _pages(4)


def test_detections_equal_a_walk_over_whole_pages(spark, pages):
    frames = spark.createDataFrame([(p, 600, 400, [[1.0, 0.1, 3.0], [-0.1, 1.0, 9.0]] if p % 3 == 0 else None) for p in range(12)], "page long, width int, height int, matrix array<array<double>>")
    got = {(r["page"], r["entity"], r["text"], tuple(map(tuple, r["polygon"])), r["score"]) for r in reading.detections(spark.createDataFrame(pages, READ), frames).collect()}
    texts, boxes = {}, {}
    for p in {r[0] for r in pages}:
        found, at, parts = _with_values(_lines(_kept([r for r in pages if r[0] == p]))), 0, []
        boxes[p] = []
        for k, line in enumerate(found):
            for j, r in enumerate(line):
                parts.append(("\n" if k and not j else " " if j else "") + r["text"])
                at += len(parts[-1])
                boxes[p].append((k, at - len(r["text"]), at, r))
        texts[p] = "".join(parts)
    docs = spark.createDataFrame(sorted(texts.items()), "page long, text string")
    spans = [(r["page"], r["s"]) for r in find.find_pii(docs, "page").select("page", F.explode("spans").alias("s")).collect()]
    want = set()
    for p, s in spans:
        for k in sorted({b[0] for b in boxes[p]}):
            hit = [b for b in boxes[p] if b[0] == k and b[1] < s["end"] and b[2] > s["start"]]
            if not hit:
                continue
            (_, a0, b0, first), (_, a1, b1, last) = hit[0], hit[-1]
            fx, lx = first["box"], last["box"]
            n, m = len(first["text"]), len(last["text"])
            x1 = fx[0] + (fx[2] - fx[0]) * max(0.0, (max(0, s["start"] - a0) - 0.05) / n)
            x2 = lx[0] + (lx[2] - lx[0]) * min(1.0, (min(s["end"], b1) - a1 + 0.05) / m)
            quad = [[x1, fx[1]], [x2, lx[1]], [x2, lx[3]], [x1, fx[3]]]
            (ux, uy), (vx, vy) = [(quad[1][c] - quad[0][c]) * 0.005 for c in (0, 1)], [(quad[3][c] - quad[0][c]) * 0.02 for c in (0, 1)]
            quad = [[q[0] + e * ux + d * vx, q[1] + e * uy + d * vy] for q, (e, d) in zip(quad, ((-1, -1), (1, -1), (1, 1), (-1, 1)), strict=True)]
            whole = lambda q: [[min(max(round(x), 0), 600), min(max(round(y), 0), 400)] for x, y in q]
            quad = whole(quad)
            if p % 3 == 0:
                quad = whole([[x + 0.1 * y + 3, -0.1 * x + y + 9] for x, y in quad])
            if max(q[0] for q in quad) - min(q[0] for q in quad) > 2 and max(q[1] for q in quad) - min(q[1] for q in quad) > 2:
                conf = sum(b[3]["conf"] for b in hit) / len(hit)
                want.add((p, s["entity"], texts[p][max(s["start"], a0) : min(s["end"], b1)], tuple(map(tuple, quad)), round(s["score"] * (0.75 + 0.25 * conf), 2)))
    close = lambda rows: {r[:4] for r in rows}
    assert close(got) == close(want) and len(want) > 20
    score = {r[:4]: r[4] for r in want}
    assert all(abs(score[r[:4]] - r[4]) <= 0.0101 for r in got)


def test_odd_readings(spark):
    rows = [(1, 1, None, 0.9, _quad(0.0, 0.0, 9.0, 9.0)), (1, 2, "  ", 0.9, _quad(0.0, 0.0, 9.0, 9.0)), (1, 3, "a@b.com", None, _quad(0.0, 0.0, 90.0, 9.0)), (1, 4, "long12345678901234567890", 0.01, _quad(0.0, 40.0, 90.0, 60.0)), (2, 1, "c@d.com", 0.9, None), (3, 1, "e@f.com", 0.9, _quad(5.0, 5.0, 95.0, 25.0)), (3, 1, "e@f.com", 0.9, _quad(5.0, 5.0, 95.0, 25.0))]
    frames = spark.createDataFrame([(1, 100, 100, None), (3, 100, 100, None)], "page long, width int, height int, matrix array<array<double>>")
    got = {(r["page"], r["text"]) for r in reading.detections(spark.createDataFrame(rows, READ), frames).collect()}
    assert (3, "e@f.com") in got and not any(p == 2 for p, _ in got)
    assert reading.detections(spark.createDataFrame([], READ), frames).count() == 0


def test_crops_come_back_to_the_frame(spark):
    whole = spark.createDataFrame([(1, "x", 0.9, _quad(10.0, 20.0, 30.0, 40.0))], "page long, text string, conf double, poly array<array<double>>")
    crop = spark.createDataFrame([(1, "x", 0.8, [[0.0, 0.0], [40.0, 0.0], [40.0, 40.0], [0.0, 40.0]], (10.0, 20.0, 2.0, None)), (1, "y", 0.8, [[7.0, 5.0], [7.0, 25.0], [-13.0, 25.0], [-13.0, 5.0]], (100.0, 0.0, 1.0, [[0.0, -1.0, 7.0], [1.0, 0.0, 5.0]]))],
        "page long, text string, conf double, poly array<array<double>>, crop struct<dx double, dy double, scale double, matrix array<array<double>>>")
    got = {r["text"] + str(r["id"]): r["poly"] for r in ocr.united(whole, crop).collect()}
    assert got["x1"] == got["x3"] == _quad(10.0, 20.0, 30.0, 40.0) or got["x1"] == got["x2"] == _quad(10.0, 20.0, 30.0, 40.0)
    assert [v for k, v in got.items() if k[0] == "y"] == [_quad(100.0, 0.0, 120.0, 20.0)]
    texts = reading.boxes(ocr.united(whole, crop)).groupBy("text").count().collect()
    assert {(r["text"], r["count"]) for r in texts} == {("x", 1), ("y", 1)}


@pytest.mark.parametrize("crowded", [0, 4096])
def test_boxes_meet_once_on_any_page(spark, crowded):
    rng = random.Random(crowded)
    side = lambda: rng.choice([0.0, 3.0, 30.0, 64.0, 700.0, 9000.0, 3_000_000.0])
    make = lambda n: [(rng.randint(0, 2), k, (x := rng.uniform(-500, 900)), (y := rng.uniform(-90, 900)), x + side(), y + side()) for k in range(n)]
    a, b = make(150) + [(0, 900, 64.0, 64.0, 128.0, 128.0), (9, 901, None, 0.0, 1.0, 1.0)], make(150) + [(0, 900, 128.0, 128.0, 128.0, 128.0)]
    frame = lambda rows, t: spark.createDataFrame(rows, ", ".join(["page int", f"{t}_id int", *(f"{t}_{c} double" for c in geometry.CORNERS)]))
    got = sorted((r["page"], r["a_id"], r["b_id"]) for r in geometry.meeting(frame(a, "a"), frame(b, "b"), "a", "b", crowded).collect())
    want = sorted((p, i, j) for p, i, x1, y1, x2, y2 in a if x1 is not None for q, j, u1, v1, u2, v2 in b if p == q and x1 <= u2 and u1 <= x2 and y1 <= v2 and v1 <= y2)
    assert got == want and (0, 900, 900) in got


def test_a_crowded_page_is_no_square(spark):
    n = 60_000
    boxes = spark.range(n).selectExpr("0 AS page", "id", "double(id % 300 * 20) AS x1", "double(id div 300 * 20) AS y1").selectExpr("*", "x1 + 25 AS x2", "y1 + 10 AS y2")
    assert geometry.overlapping(boxes, 0.05).count() == n - n // 300


def test_lines_from_the_top(spark):
    rows = [(1, 1, "b", 50.0, 10.0, 60.0, 20.0), (1, 2, "a", 5.0, 11.0, 20.0, 21.0), (1, 3, "low", 5.0, 50.0, 20.0, 60.0), (1, 4, "high", 5.0, -40.0, 20.0, -30.0)]
    got = geometry.line_groups(spark.createDataFrame(rows, "page long, id long, text string, x1 double, y1 double, x2 double, y2 double"))
    assert {r["text"]: r["line"] for r in got.collect()} == {"high": 0, "a": 1, "b": 1, "low": 2}


def test_zone_fields(spark):
    rows = [(1, "name", "P<UTOERIKSSON<<ANNA<MARIA<<<<<<<<<<<"), (1, "data", "L898902C36UTO7408122F1204159<<<<<<10"), (2, "name", "P<XQZMORANT<<RUTH<<<<<<<<<<<<<"), (2, "data", "K123456784XQZ7408122F1204159<<<<"), (3, "name", "P<DELAPAZ<<MICHELLE<<<<<<<<<"), (4, "name", "ERIKSSON<<ANNA<MARIA<<<<<<<<<<")]
    got = {(r["doc_id"], r["token"], r["entity"]) for r in lines.zone_fields(spark.createDataFrame(rows, "doc_id long, kind string, compact string")).collect()}
    assert got == {(1, "ERIKSSON", "PERSON"), (1, "ANNA MARIA", "PERSON"), (1, "L898902C3", "ID_NUMBER"), (2, "MORANT", "PERSON"), (2, "RUTH", "PERSON"), (2, "K12345678", "ID_NUMBER"), (3, "DELAPAZ", "PERSON"), (3, "MICHELLE", "PERSON"), (4, "ERIKSSON", "PERSON"), (4, "ANNA MARIA", "PERSON")}
