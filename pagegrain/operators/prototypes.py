"""Masks of boxes from a page's prototypes and each box's coefficients."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME = 1024  # side of the frame that boxes are given in
MASK = "page_id long, box_index int, pixels long, mask array<array<int>>"


def stretched(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """A matrix in another size, by linear mixing of the nearest pixels' centres."""

    def places(n: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(size) + 0.5) * (n / size) - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y1, y2, ya = places(x.shape[0], height)
    x1, x2, xa = places(x.shape[1], width)
    rows = x[y1] * (1 - ya[:, None]) + x[y2] * ya[:, None]
    return rows[:, x1] * (1 - xa) + rows[:, x2] * xa


def part_of(low: float, high: float, size: int, scale: float) -> tuple[int, int]:
    """A box's side in a prototype's pixels: at least one of them."""
    start = int(max(0, min(size - 1, round(low * scale))))
    return start, int(max(start + 1, min(size, round(high * scale))))


def decoded(protos: np.ndarray, coefficients: np.ndarray, box: tuple[float, float, float, float], height: int, width: int, frame: int = FRAME) -> np.ndarray:
    """A box's mask: where the sigmoid of its prototypes' sum, cut out and stretched, is over a half.
    Only the pixels that the box covers are summed."""
    scale = protos.shape[2] / frame
    x1, x2 = part_of(box[0], box[2], protos.shape[2], scale)
    y1, y2 = part_of(box[1], box[3], protos.shape[1], scale)
    logits = np.clip(np.tensordot(coefficients, protos[:, y1:y2, x1:x2], 1), -88.0, 88.0)
    return stretched(1 / (1 + np.exp(-logits)), height, width) > 0.5


def masks(pages: DataFrame, boxes: DataFrame, frame: int = FRAME) -> DataFrame:
    """(page_id, box_index, pixels, mask of 0 and 255) of boxes (page_id, box_index, coefficients, x1, y1, x2, y2 in the
    frame, width, height of the box on its page); pages: page_id, side_y, side_x, prototypes (each an array of side_y * side_x values).

    A page's prototypes are shuffled once, to its boxes.  A box with another number of coefficients than its page
    has prototypes, or less than a pixel wide or high, has a null mask; boxes of pages without prototypes have none."""
    held = boxes.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("box_index", "coefficients", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")), F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height")))).alias("boxes"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                flat = batch["prototypes"][i].values
                y, x = batch["side_y"][i].as_py(), batch["side_x"][i].as_py()
                protos = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), y, x)
                rows = []
                for b in batch["boxes"][i].as_py():
                    own, w, h = b["coefficients"], b["width"] or 0, b["height"] or 0
                    mask = None
                    if own and len(own) == len(protos) and w >= 1 and h >= 1:
                        mask = decoded(protos, np.asarray(own), (b["x1"], b["y1"], b["x2"], b["y2"]), h, w, frame)
                    rows.append((b["box_index"], None if mask is None else int(mask.sum()), None if mask is None else (mask * 255).tolist()))
                index, pixels, found = zip(*rows, strict=True)
                yield pa.record_batch([pa.array([batch["page_id"][i].as_py()] * len(rows), pa.int64()), pa.array(index, pa.int32()), pa.array(pixels, pa.int64()), pa.array(found, pa.list_(pa.list_(pa.int32())))], ["page_id", "box_index", "pixels", "mask"])

    both = pages.where("prototypes is not null and size(prototypes) > 0").select("page_id", "side_y", "side_x", F.col("prototypes").cast("array<array<double>>").alias("prototypes")).join(held, "page_id")
    return both.mapInArrow(run, MASK)
