"""Vocabularies, model files, and the port that networks plug into. No weights are shipped."""

from __future__ import annotations

from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators.requests import pages_of_models


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(idx, ch) of a JSON file {"characters": [..]}; classes count from 1, class 0 is blank."""
    return spark.read.option("multiLine", True).json(path).select(F.posexplode("characters").alias("i", "ch")).select((F.col("i") + 1).alias("idx"), "ch")


def resolve(value: str, bundled: str | Path) -> Path:
    """A path as it is if it exists, else the file of that name in the bundled folder."""
    for p in (Path(value), Path(bundled) / Path(value).name):
        if p.exists():
            return p
    raise FileNotFoundError(value)


def list_models(spark: SparkSession, folder: str) -> DataFrame:
    """One row (recognizers, detectors) of the *.onnx files of a folder; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.onnx").load(folder)
    return pages_of_models(files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("name")))


_LOADED: dict[str, object] = {}


def key_of(port: object) -> str:
    """A name for a network as it is sent to the workers: its class and what it holds."""
    import hashlib

    from pyspark.cloudpickle import dumps

    return f"{type(port).__module__}.{type(port).__qualname__}:{hashlib.sha256(dumps(port)).hexdigest()}"


def loaded(key: str, port, prepare=None):
    """The network of that key, loaded once by each worker process: this module's table stays when a task ends."""
    if key not in _LOADED:
        port.load()
        _LOADED[key] = prepare(port) if prepare else port
    return _LOADED[key]


class ModelPort(Protocol):
    """A network: loaded once a worker, run on batches of line crops of one width."""

    def load(self) -> None: ...

    def run(self, crops: np.ndarray) -> np.ndarray:
        """(n, height, width) bytes -> (n, width // 2, classes) scores."""


class RolePort(Protocol):
    """A network that tells what lines are; loaded once a worker."""

    def load(self) -> None: ...

    def scores(self, crops: np.ndarray, feats: np.ndarray) -> np.ndarray:
        """(n, 1, 32, 256) grays from -1 to 1 and (n, 21) features -> (n, 5) scores in the order of blocks.ROLES."""


class LayoutPort(Protocol):
    """A layout network: loaded once a worker, run on one page at a time."""

    def load(self) -> None: ...

    def maps(self, image: np.ndarray) -> np.ndarray:
        """(h, w, 3) bytes in BGR order, both sides multiples of 32 -> (5, h, w): ascender, descender, baseline, end point, separator."""


class StubLayout:
    """For tests: the last dark row of each bar is a baseline as tall as the bar, and black columns of the first row are separators."""

    def load(self) -> None:
        pass

    def maps(self, image: np.ndarray) -> np.ndarray:
        dark = image.mean(axis=2) < 128
        out = np.zeros((5, *dark.shape), dtype=np.float32)
        run = np.zeros(dark.shape, dtype=np.float32)
        for y in range(1, len(dark)):
            run[y] = np.where(dark[y], run[y - 1] + 1, 0)
        below = np.vstack([dark[1:], np.zeros((1, dark.shape[1]), dtype=bool)])
        foot = dark & ~below
        out[2] = foot
        for dy in (-1, 1):
            out[2] += 0.6 * np.roll(foot, dy, axis=0)
        out[0], out[1] = np.where(foot, run, 0), np.where(foot, 2, 0)
        for dy in (-1, 1):
            out[0] = np.maximum(out[0], np.roll(np.where(foot, run, 0), dy, axis=0))
        return out


class StubModel:
    """A tiny deterministic network for tests: the darkness of every second column, read as class numbers."""

    def __init__(self, classes: int = 64):
        self.classes = classes

    def load(self) -> None:
        pass

    def run(self, crops: np.ndarray) -> np.ndarray:
        n, _, w = crops.shape
        dark = 255 - crops[:, :, : w // 2 * 2 : 2].mean(axis=1)
        cls = np.minimum((dark / 256 * self.classes).astype(int), self.classes - 1)
        out = np.zeros((n, w // 2, self.classes), dtype=np.float32)
        np.put_along_axis(out, cls[:, :, None], 8.0, axis=2)
        return out


def probed(port: LayoutPort):
    """The port's maps() with probabilities in its last three channels: networks that give them before the logistic function show
    it by values outside [0, 1] on an empty image."""
    blank = port.maps(np.zeros((64, 64, 3), dtype=np.uint8))[2:5]
    if blank.min() >= -0.001 and blank.max() <= 1.001:
        return port.maps

    def squashed(image: np.ndarray) -> np.ndarray:
        out = np.array(port.maps(image), dtype=float)
        out[2:5] = 1 / (1 + np.exp(-out[2:5]))
        return out

    return squashed


def recognise(crops: DataFrame, model: ModelPort, max_width: int = 1600, id_type: str = "long") -> DataFrame:
    """crops (line_id, crop_w, pixels of 40 rows) -> frames (line_id, t, logits); batches hold crops of one width, each worker
    loads the model once, and columns beyond max_width are cut off."""

    key = key_of(model)

    def run(batches):
        net = loaded(key, model)
        for pdf in batches:
            for width, group in pdf.groupby("crop_w"):
                used = min(int(width), max_width)
                pixels = np.stack([np.frombuffer(p, dtype=np.uint8).reshape(40, int(width))[:, :used] for p in group["pixels"]])
                scores = net.run(pixels)
                n, t, _ = scores.shape
                yield pd.DataFrame({"line_id": np.repeat(group["line_id"].to_numpy(), t), "t": np.tile(np.arange(t, dtype=np.int32), n), "logits": [s.astype(float).tolist() for s in scores.reshape(n * t, -1)]})

    return crops.select("line_id", "crop_w", "pixels").mapInPandas(run, f"line_id {id_type}, t int, logits array<double>")
