"""Weights of large models, one copy for each machine.

A function that is shipped with its weights inside costs a copy in every task's closure and one in every Python worker. Here the weights
are ``.npy`` files that Spark brings to each machine once (``addFile``), and every worker maps them into memory: the pages are the
file's own, shared by all workers, read when they are touched and dropped when memory is short.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import SparkSession

_OPEN: dict[tuple, dict[str, np.ndarray]] = {}


class SharedArrays:
    """Named arrays of a model. ``paths``: name -> ``.npy`` file on the driver or in a store that Spark reads; the files' own
    names must differ from those of all other files that the session has shipped."""

    def __init__(self, spark: SparkSession, paths: dict[str, str]):
        files = {name: path.rstrip("/").rpartition("/")[2] for name, path in paths.items()}
        if len(set(files.values())) < len(files) or not all(f.endswith(".npy") for f in files.values()):
            raise ValueError(f"the files of a model need different names ending in .npy: {sorted(paths.values())}")
        for path in paths.values():
            spark.sparkContext.addFile(path)
        self.files = files

    def open(self) -> dict[str, np.ndarray]:
        """The arrays, mapped read-only; called in a task, opened once per worker."""
        key = tuple(sorted(self.files.items()))
        if key not in _OPEN:
            _OPEN[key] = {name: np.load(os.path.join(SparkFiles.getRootDirectory(), file), mmap_mode="r") for name, file in key}
        return _OPEN[key]
