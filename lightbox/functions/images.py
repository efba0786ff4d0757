"""Picture fingerprints, picture embeddings and the plug points for both.

Pictures arrive decoded, as the struct of Spark's image source: height, width,
nChannels and rows of blue, green, red samples.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lightbox.functions.scalars import MAX_DECODE_BYTES, MAX_SIDE, NO_HASH

# Input side, channel means and deviations of the picture model.
MODEL_SIDE = 224
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)
HASH_SIDE = 8


def pixels(image: dict) -> np.ndarray:
    """Height x width x (red, green, blue), as floats of 0 to 255."""
    h, w, c = image["height"], image["width"], image["nChannels"]
    if not (0 < h <= MAX_SIDE and 0 < w <= MAX_SIDE) or h * w * c > MAX_DECODE_BYTES:
        raise ValueError("picture outside the decode limits")
    data = np.frombuffer(image["data"], np.uint8).reshape(h, w, c).astype(np.float64)
    return np.repeat(data, 3, axis=2) if c == 1 else data[:, :, 2::-1]


def _weights(size: int, out: int) -> np.ndarray:
    """Triangle-filter weights that resample ``size`` samples to ``out``."""
    scale = size / out
    reach = max(scale, 1.0)
    centre = (np.arange(out) + 0.5) * scale - 0.5
    w = np.maximum(0.0, 1.0 - np.abs(np.arange(size)[None, :] - centre[:, None]) / reach)
    return w / w.sum(axis=1, keepdims=True)


def resize(picture: np.ndarray, height: int, width: int) -> np.ndarray:
    rows = np.tensordot(_weights(picture.shape[0], height), picture, (1, 0))
    return np.moveaxis(np.tensordot(_weights(picture.shape[1], width), rows, (1, 1)), 0, 1)


def gradient_hash(picture: np.ndarray, side: int = HASH_SIDE) -> str:
    """Brightness slopes along both axes of a small gray copy, as base64 bits."""
    gray = picture @ np.array([0.299, 0.587, 0.114])
    small = np.round(resize(gray[:, :, None], side + 1, side + 1)[:, :, 0], 6)
    across = small[:, :-1] > small[:, 1:]
    down = small[:-1, :] > small[1:, :]
    return base64.b64encode(np.packbits(np.concatenate([across.ravel(), down.ravel()])).tobytes()).decode()


def image_fingerprint(image: Column) -> Column:
    """Perceptual hash of decoded pictures; the unknown sentinel on failure."""

    @F.arrow_udf("string")
    def fingerprint(batch: pa.Array) -> pa.Array:
        out = []
        for item in batch.to_pylist():
            try:
                out.append(gradient_hash(pixels(item)))
            except (ValueError, TypeError, KeyError):
                out.append(NO_HASH)
        return pa.array(out, pa.string())

    return fingerprint(image)


def hash_generator(content: Column, hasher: Callable[[bytes], str]) -> Column:
    """Caller's hash of raw content; the unknown sentinel when it fails."""

    @F.arrow_udf("string")
    def generate(batch: pa.Array) -> pa.Array:
        out = []
        for item in batch:
            try:
                out.append(hasher(item.as_py()))
            except Exception:  # noqa: BLE001  a caller's failure marks the row, not the job
                out.append(NO_HASH)
        return pa.array(out, pa.string())

    return generate(content)


def feature_extractor(
    rows: DataFrame, factory: Callable[[], Callable[[bytes], object]], content: str = "content"
) -> DataFrame:
    """Replace ``content`` by ``embedding`` from a caller's model, null when it fails.

    ``factory`` runs once per task, so a model is loaded once and not per row.
    """
    rest = [f for f in rows.schema if f.name != content]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for batch in batches:
            found = []
            for item in batch.column(content):
                try:
                    found.append(np.asarray(model(item.as_py()), np.float32))
                except Exception:  # noqa: BLE001  the item is stored without a vector
                    found.append(None)
            cols = {f.name: batch.column(f.name) for f in rest}
            cols["embedding"] = pa.array(found, pa.list_(pa.float32()))
            yield pa.record_batch(cols)

    return rows.mapInArrow(extract, f"{fields}, embedding array<float>")


def model_input(picture: np.ndarray) -> np.ndarray:
    """Centre square, resampled and normalised, channels first."""
    h, w = picture.shape[:2]
    side = min(h, w)
    top, left = (h - side) // 2, (w - side) // 2
    square = resize(picture[top : top + side, left : left + side], MODEL_SIDE, MODEL_SIDE)
    scaled = (square / 255.0 - np.array(CHANNEL_MEAN)) / np.array(CHANNEL_STD)
    return scaled.transpose(2, 0, 1).astype(np.float32)


def extract_embeddings(
    images: DataFrame, factory: Callable[[], Callable[[np.ndarray], np.ndarray]],
    image: str = "image", key: str = "id", at_once: int = 32,
) -> DataFrame:
    """(key, embedding) of decoded pictures from a caller's batch model.

    The model maps (n, 3, 224, 224) to (n, width); unreadable pictures get null.
    """
    kind = images.schema[key].dataType.simpleString()

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for batch in batches:
            for start in range(0, batch.num_rows, at_once):
                part = batch.slice(start, at_once)
                out: list = [None] * part.num_rows
                ready, at = [], []
                for i, item in enumerate(part.column(image).to_pylist()):
                    try:
                        ready.append(model_input(pixels(item)))
                        at.append(i)
                    except (ValueError, TypeError, KeyError):
                        continue
                if ready:
                    for i, vector in zip(at, model(np.stack(ready))):
                        out[i] = np.asarray(vector, np.float32)
                yield pa.record_batch(
                    {key: part.column(key), "embedding": pa.array(out, pa.list_(pa.float32()))}
                )

    return images.select(key, image).mapInArrow(extract, f"{key} {kind}, embedding array<float>")
