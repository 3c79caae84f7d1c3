"""Which pages text extraction is enough for, judged from their text and their rendered pixels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.functions.text import NO_CONTENT, cut_repetition, needs_vision, without_sentinel

TRANSCRIBE = f"Write down all text of this page in reading order, tables as rows with | between cells. Answer {NO_CONTENT} if there is nothing to read."


def pixel_figures(pixels: DataFrame, cell: int = 10, white: int = 250, blank_share: float = 0.002, texture: float = 12.0, flat_share: float = 0.3) -> DataFrame:
    """Per page of gray samples (page_id, x, y, gray): share of ink, blank, flat.

    Cells of a 10 x 10 grid are textured if their gray values scatter widely; a page is
    flat if textured cells stand in less than 30 % of its cell rows. Pixels beyond ten whole cells are left out.
    """
    size = pixels.groupBy("page_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.avg((F.col("gray") < white).cast("double")).alias("ink"))
    dealt = pixels.join(size.select("page_id", F.floor(F.col("w") / cell).alias("cw"), F.floor(F.col("h") / cell).alias("ch")), "page_id").where("cw > 0 and ch > 0")
    dealt = dealt.select("page_id", F.floor(F.col("x") / F.col("cw")).alias("gx"), F.floor(F.col("y") / F.col("ch")).alias("gy"), "gray").where((F.col("gx") < cell) & (F.col("gy") < cell))
    cells = dealt.groupBy("page_id", "gy", "gx").agg((F.stddev_pop("gray") > texture).alias("textured"))
    rows = cells.groupBy("page_id", "gy").agg(F.bool_or("textured").alias("textured"))
    flat = rows.groupBy("page_id").agg((F.avg(F.col("textured").cast("double")) < flat_share).alias("flat"))
    return size.join(flat, "page_id", "left").select("page_id", "ink", (F.col("ink") < blank_share).alias("blank"), F.coalesce("flat", F.lit(False)).alias("flat"))


#: fixed values: samples from here on are white; a page with less than this share of ink is blank; cells that scatter more are textured; less than this share of textured rows is flat
WHITE_FROM, BLANK_SHARE, TEXTURE, FLAT_SHARE, GRID = 250, 0.002, 12.0, 0.3, 10


def raster_of(samples: bytes | None, width: int | None, height: int | None, stride: int | None) -> np.ndarray:
    """Gray samples as (height, width); rows begin ``stride`` bytes apart (null: they follow each other). What is missing at the end counts as no row."""
    width, stride = width or 0, stride or width or 0
    if not samples or width <= 0 or stride < width:
        return np.zeros((0, 0), np.uint8)
    flat = np.frombuffer(samples, np.uint8)
    rows = min(height if height is not None else len(flat) // stride, (len(flat) + stride - width) // stride)
    if rows <= 0:
        return np.zeros((0, 0), np.uint8)
    padded = np.zeros(rows * stride, np.uint8)
    padded[: min(len(flat), rows * stride)] = flat[: rows * stride]
    return padded.reshape(rows, stride)[:, :width]


def raster_judged(gray: np.ndarray) -> tuple[float | None, bool, bool]:
    """(share of ink, blank, flat) of a page; one without samples is blank and has no share."""
    if not gray.size:
        return None, True, False
    ink = float((gray < WHITE_FROM).mean())
    tall, wide = gray.shape[0] // GRID, gray.shape[1] // GRID
    if not tall or not wide:
        return ink, ink < BLANK_SHARE, False
    cells = gray[: GRID * tall, : GRID * wide].reshape(GRID, tall, GRID, wide).astype(np.float64)
    textured = (cells.std(axis=(1, 3)) > TEXTURE).any(axis=1)
    return ink, ink < BLANK_SHARE, bool(textured.mean() < FLAT_SHARE)


def raster_figures(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, ink, blank, flat) of pages with their gray samples in one row: samples (binary), width, height, stride.

    As ``pixel_figures``, but without a row for each pixel and without a shuffle: one pass
    of numpy over the pages' bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            figures = [raster_judged(raster_of(*(column[n].as_py() for column in batch.columns[1:]))) for n in range(batch.num_rows)]
            ink, blank, flat = zip(*figures) if figures else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ink, pa.float64()), pa.array(blank, pa.bool_()), pa.array(flat, pa.bool_())], names=[key, "ink", "blank", "flat"])

    kind = pages.schema[key].dataType.simpleString()
    return pages.select(key, "samples", "width", "height", "stride").mapInArrow(run, f"{key} {kind}, ink double, blank boolean, flat boolean")


def triage(pages: DataFrame, figures: DataFrame | None = None) -> DataFrame:
    """``pages`` with extraction_path: vision where the text layer is missing though ink is there, or looks like a table."""
    if figures is None:
        return pages.withColumn("extraction_path", F.when(needs_vision(F.col("text"), F.lit(True)), "vision").otherwise("text"))
    seen = figures.select("page_id", (F.col("blank") | F.col("flat")).alias("nothing"))
    joined = pages.join(seen, "page_id", "left").withColumn("nothing", F.coalesce("nothing", F.lit(True)))
    return joined.withColumn("extraction_path", F.when(needs_vision(F.col("text"), F.col("nothing")), "vision").otherwise("text")).drop("nothing")


def transcribe(pages: DataFrame, provider, prompt: str = TRANSCRIBE) -> DataFrame:
    """``pages`` (document_id, page, text, image, extraction_path) with the texts of vision pages read from their images.

    Replies are cut where they fall into a loop, and one that says that there is nothing to
    read gives an empty text. ``error`` is null, or says why a page could not be read; its
    text stays as it was. The image column is dropped. Only vision pages go to the provider;
    pages of any other path, or of none, come back as they are.
    """
    kind = pages.schema["document_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies, errors = [], []
            for image in batch.column(2).to_pylist():
                try:
                    replies.append(provider.transcribe(image, prompt))
                    errors.append(None)
                except Exception as error:  # one unreadable page must not fail its whole task
                    replies.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(replies, pa.string()), pa.array(errors, pa.string()), batch.column(3)], names=["document_id", "page", "reply", "error", "text"])

    by_image = F.coalesce(F.col("extraction_path") == "vision", F.lit(False))
    seen = pages.where(by_image).select("document_id", "page", "image", "text").mapInArrow(read, f"document_id {kind}, page {pages.schema['page'].dataType.simpleString()}, reply string, error string, text string")
    reply = without_sentinel(cut_repetition(F.col("reply")))
    seen = seen.select("document_id", "page", F.coalesce(reply, "text").alias("text"), F.lit("vision").alias("extraction_path"), "error")
    rest = pages.where(~by_image).select("document_id", "page", "text", "extraction_path", F.lit(None).cast("string").alias("error"))
    return rest.unionByName(seen)
