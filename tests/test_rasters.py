import random

import numpy as np

from foliomill.operators import triage
from foliomill.operators.providers import HashingProvider
from foliomill.plans.documents import DocumentPipeline

TALL, WIDE = 250, 180
SCHEMA = "page_id string, samples binary, width int, height int, stride int"


def white():
    return np.full((TALL, WIDE), 255, np.uint8)


def bands():
    page = white()
    page[:80], page[80:160] = 30, 140
    return page


def drawing(seed=3):
    """Line segments all over the page."""
    page, rng = white(), random.Random(seed)
    for _ in range(500):
        x, y, dx, dy = rng.randrange(WIDE), rng.randrange(TALL), rng.uniform(-1, 1), rng.uniform(-1, 1)
        for t in range(30):
            page[int(y + t * dy) % TALL, int(x + t * dx) % WIDE] = 0
    return page


def padded(page, stride):
    return np.pad(page, ((0, 0), (0, stride - page.shape[1])), constant_values=7).tobytes()


def row(name, page, stride=None):
    return name, padded(page, stride) if stride else page.tobytes(), page.shape[1], page.shape[0], stride


def test_blank_flat_and_drawn_pages(spark):
    speck = white()
    speck[5, 5] = 0
    rows = [row("white", white()), row("speck", speck, 200), row("bands", bands(), 192), row("drawing", drawing(), 181), row("tiny", white()[:9, :9]), ("none", None, 10, 10, 10), ("empty", b"", 0, 0, 0), ("odd", b"abc", 5, 1, 2)]
    got = {r.page_id: (r.blank, r.flat) for r in triage.raster_figures(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"white": (True, True), "speck": (True, True), "bands": (False, True), "drawing": (False, False), "tiny": (True, False), "none": (True, False), "empty": (True, False), "odd": (True, False)}


def test_same_figures_as_by_pixel_rows(spark):
    rng = np.random.default_rng(1)
    pages = {f"p{i}": np.clip(128 + rng.normal(size=(int(rng.integers(3, 60)), int(rng.integers(3, 60)))) * rng.choice([3, 11.9, 12.1, 40]) + rng.choice([0, 127]), 0, 255).astype(np.uint8) for i in range(25)}
    pixels = [(n, x, y, int(p[y, x])) for n, p in pages.items() for y in range(p.shape[0]) for x in range(p.shape[1])]
    key = lambda r: (r.page_id, round(r.ink, 9), r.blank, r.flat)
    by_pixel = triage.pixel_figures(spark.createDataFrame(pixels, "page_id string, x int, y int, gray int"))
    by_raster = triage.raster_figures(spark.createDataFrame([row(n, p, 64) for n, p in pages.items()], SCHEMA))
    assert sorted(map(key, by_raster.collect())) == sorted(map(key, by_pixel.collect()))


def test_no_shuffle(spark):
    plan = triage.raster_figures(spark.createDataFrame([row("a", white())], SCHEMA))._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_extraction_judges_rendered_pages(spark):
    files = spark.createDataFrame([("h", b"x")], "file_hash string, content binary")
    long = "A page of text that is long enough to be read as it is and not from its image."
    raster = lambda p: (p.tobytes(), WIDE, TALL, WIDE)
    pages = [("", raster(white()), b"i1"), ("Cover", raster(bands()), b"i2"), ("Fig. 3", raster(drawing()), b"i3"), (long, raster(drawing()), b"i4"), ("no picture", False, b"i5")]

    class Reader(HashingProvider):
        def transcribe(self, image, prompt):
            return f"read from {image.decode()}"

    done = spark.createDataFrame([], "document_id string, page int")
    found, failures = DocumentPipeline(Reader(8)).extract(files, done, lambda _: pages)
    got = {r.page: (r.extraction_path, r.text) for r in found.collect()}
    assert got == {1: ("text", ""), 2: ("text", "Cover"), 3: ("vision", "read from i3"), 4: ("text", long), 5: ("vision", "read from i5")} and failures.count() == 0


def test_pages_without_a_path_are_not_lost(spark):
    pages = spark.createDataFrame([("d", 1, "a", None, None), ("d", 2, "b", None, "text"), ("d", 3, "c", b"i", "vision")], "document_id string, page int, text string, image binary, extraction_path string")
    got = {r.page: (r.extraction_path, r.text) for r in triage.transcribe(pages, HashingProvider(8)).collect()}
    assert got == {1: (None, "a"), 2: ("text", "b"), 3: ("vision", "")}
