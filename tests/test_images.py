"""Image measures and candidates against plain loops on small images."""

import base64
import zlib

import numpy as np
import pytest

from bandloom.functions import pixels
from bandloom.operators import images

RNG = np.random.default_rng(6)


def plain_window(mask, height, width, whole):
    h, w = mask.shape
    out = np.zeros_like(mask)
    for y in range(h):
        for x in range(w):
            part = mask[max(0, y - height // 2) : y - height // 2 + height, max(0, x - width // 2) : x - width // 2 + width]
            out[y, x] = part.all() if whole else part.any()
    return out


@pytest.mark.parametrize("size", [(3, 5), (5, 3), (1, 7)])
def test_erosion_and_dilation(size):
    mask = RNG.random((17, 23)) < 0.7
    assert (pixels.erode(mask, *size) == plain_window(mask, *size, True)).all()
    assert (pixels.dilate(mask, *size) == plain_window(mask, *size, False)).all()


def plain_boxes(mask):
    """Flood fills pixel by pixel."""
    h, w = mask.shape

    def flood(free, start, near):
        todo, seen = [start], {start}
        while todo:
            y, x = todo.pop()
            for dy, dx in near:
                p = (y + dy, x + dx)
                if p not in seen and 0 <= p[0] < free.shape[0] and 0 <= p[1] < free.shape[1] and free[p]:
                    seen.add(p)
                    todo.append(p)
        return seen

    four = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    eight = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b]
    outside, done, out = flood(np.pad(~mask, 1, constant_values=True), (0, 0), four), set(), []
    for y in range(h):
        for x in range(w):
            if mask[y, x] and (y, x) not in done:
                own = flood(mask, (y, x), eight)
                done |= own
                if any((a + 1 + dy, b + 1 + dx) in outside for a, b in own for dy, dx in eight):
                    ys, xs = [a for a, _ in own], [b for _, b in own]
                    out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
    return out[::-1]


def test_outer_boxes():
    for density in (0.2, 0.4, 0.6, 0.8):
        mask = RNG.random((20, 26)) < density
        assert pixels.outer_boxes(mask) == plain_boxes(mask)
    ring = np.zeros((9, 9), bool)
    ring[1:8, 1:8] = True
    ring[2:7, 2:7] = False
    ring[4, 4] = True
    assert pixels.outer_boxes(ring) == [(1, 1, 7, 7)] and pixels.outer_boxes(np.zeros((3, 3), bool)) == []


def test_features():
    image = RNG.integers(0, 256, (40, 60, 3)).astype(np.uint8)
    luma = np.array([[round(float(0.114 * b + 0.587 * g + 0.299 * r)) for b, g, r in line] for line in image])
    assert np.abs(pixels.gray(image).astype(int) - luma).max() <= 1
    sat, dark, strokes, rows, columns = pixels.features(image)
    plain = [[0 if max(p) == 0 else 255 * (max(p) - min(p)) / max(p) for p in line.tolist()] for line in image]
    own = pixels.gray(image)
    assert sat == pytest.approx(np.mean(plain), abs=0.5) and dark == np.mean(own < 210)
    ink = 255.0 - own
    assert rows == pytest.approx(ink.mean(1).std() / ink.mean(1).mean(), rel=1e-5) and columns == pytest.approx(ink.mean(0).std() / ink.mean(0).mean(), rel=1e-5)
    assert strokes == plain_window(plain_window(own < 210, 3, 35, True), 3, 35, False).mean()


def decode_png(data):
    width, height = int.from_bytes(data[16:20], "big"), int.from_bytes(data[20:24], "big")
    body, at = b"", 8
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        if data[at + 4 : at + 8] == b"IDAT":
            body += data[at + 8 : at + 8 + size]
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, -1)
    return lines[:, 1:].reshape(height, width, 3)[..., ::-1]


def blot(height=1000, width=1200):
    """A white page with one panel of dark bars."""
    page = np.full((height, width, 3), 255, np.uint8)
    for k in range(4):
        for lane in range(5):
            page[300 + 60 * k : 320 + 60 * k, 400 + 80 * lane : 450 + 80 * lane] = 40
    return page


def test_page_candidates(spark):
    page = blot()
    rows = [("p", 1, 1200, 1000, page.tobytes()), ("p", 2, 1200, 1000, np.full_like(page, 255).tobytes()), ("p", 3, 1200, 1000, page.tobytes()), ("q", 1, 5, 5, None)]
    got = images.page_candidates(spark.createDataFrame(rows, "paper_id string, page int, width_px int, height_px int, bgr binary")).orderBy("candidate_no").collect()
    assert [(r.paper_id, r.candidate_no, r.page, r.candidate_path) for r in got] == [("p", 0, 1, "panel_candidates/page_001_cand_0000.png"), ("p", 1, 3, "panel_candidates/page_003_cand_0001.png")]
    x1, y1, x2, y2 = got[0].tight_bbox_page
    assert (x1, y1) == (400 - 22, 300 - 22) and (x2, y2) == (770 + 22, 500 + 22) and got[0].cv_score >= 0.35
    assert got[0].bbox_page == [x1 - 240, y1 - 60, x2 + 20, y2 + 20]
    crop = decode_png(bytes(got[0].crop))
    assert (crop == page[y1 - 60 : y2 + 20, x1 - 240 : x2 + 20]).all()


def cubic(image, axis, size):
    """Cubic resampling of one axis, place by place: kernel of slope -1/2 over twice the scale on either side."""

    def kernel(x):
        x = abs(x)
        return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0

    lines, old = np.moveaxis(np.asarray(image, float), axis, 0), image.shape[axis]
    scale, out = max(1.0, old / size), []
    for place in range(size):
        centre = (place + 0.5) * old / size
        near = range(max(0, int(centre - 2 * scale + 0.5)), min(old, int(centre + 2 * scale + 0.5)))
        weights = [kernel((k + 0.5 - centre) / scale) for k in near]
        total = sum(w * lines[k] for w, k in zip(weights, near, strict=True)) / sum(weights)
        out.append(np.clip(np.rint(total), 0, 255))
    return np.moveaxis(np.array(out), 0, axis)


@pytest.mark.parametrize(("height", "width", "new_h", "new_w"), [(20, 40, 5, 10), (37, 53, 11, 16), (64, 9, 64, 4), (7, 7, 7, 7), (3, 200, 1, 60)])
def test_resizing_against_a_loop(height, width, new_h, new_w):
    image = RNG.integers(0, 256, (height, width, 3)).astype(np.uint8)
    want = image if new_w == width else cubic(image, 1, new_w)
    want = want if new_h == height else cubic(want, 0, new_h)
    got = pixels.shrink(image, new_w, new_h)
    assert got.shape == (new_h, new_w, 3) and np.abs(got.astype(float) - want).max() <= 1
    flat = np.full((50, 70, 3), 77, np.uint8)
    assert (pixels.shrink(flat, 20, 10) == 77).all()


def test_sizes_parts_and_scores(spark):
    tall = RNG.integers(0, 256, (1300, 1000, 3)).astype(np.uint8)
    small = RNG.integers(0, 256, (20, 40, 3)).astype(np.uint8)
    df = spark.createDataFrame([("runs/r/panel_candidates/a.b.png", 1000, 1300, tall.tobytes()), ("b.png", 40, 20, small.tobytes())], "candidate_path string, width_px int, height_px int, bgr binary")
    parts = images.crop_parts(df).orderBy("part").collect()
    cut = 1300 // 2 + min(120, max(40, 1300 // 14))
    assert [(p.request_path, p.height_px) for p in parts] == [("runs/r/vlm_panel_splits/a.b_part_01.png", cut), ("runs/r/vlm_panel_splits/a.b_part_02.png", 1300 - cut)]
    assert b"".join(bytes(p.bgr) for p in parts) == tall.tobytes()
    sent = {r.candidate_path: r for r in images.model_images(df, longest=10).collect()}
    shown = decode_png(base64.b64decode(sent["b.png"].data_url.split(",")[1]))
    assert shown.shape == (5, 10, 3) and np.abs(shown.astype(float) - cubic(cubic(small, 1, 10), 0, 5)).max() <= 1
    assert {r.candidate_path: r.cv_score for r in images.scored(df).collect()}["b.png"] == 0.0
