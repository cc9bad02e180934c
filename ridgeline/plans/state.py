"""A fit's loop state in the shared folder, so that a fit whose driver died goes on where it was.

After an iteration the state (weights, direction, gradient, counters; O(d) numbers, no rows) is one
JSON line in a folder of its own, ``<folder>/step-<iteration>``, written by Spark with its usual
commit: a folder without ``_SUCCESS`` is not read.  The newest one is the state; the one before it
is kept until the next is complete, older ones are removed, and so are all when the fit is done.
"""

from __future__ import annotations

import json
import re

import numpy as np
from pyspark.sql import SparkSession


class FitState:
    """Saves and loads dictionaries of numbers, strings, lists and arrays under a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _steps(self) -> list[int]:
        """Numbers of the steps that are there, complete or not."""
        root = self._path(self.folder)
        if not self._fs.exists(root):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(root)]
        return sorted(int(m.group(1)) for n in names if (m := re.fullmatch(r"step-(\d+)", n)))

    def save(self, step: int, state: dict) -> None:
        line = json.dumps({k: {"array": v.tolist()} if isinstance(v, np.ndarray) else v for k, v in state.items()})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/step-{step}")
        for old in self._steps():
            if old < step - 1:
                self._fs.delete(self._path(f"{self.folder}/step-{old}"), True)

    def load(self) -> dict | None:
        """The state of the newest complete step."""
        for step in reversed(self._steps()):
            if self._fs.exists(self._path(f"{self.folder}/step-{step}/_SUCCESS")):
                state = json.loads(self.spark.read.text(f"{self.folder}/step-{step}").first()[0])
                return {k: np.array(v["array"], dtype=float) if isinstance(v, dict) and "array" in v else v for k, v in state.items()}
        return None

    def clear(self) -> None:
        for step in self._steps():
            self._fs.delete(self._path(f"{self.folder}/step-{step}"), True)
