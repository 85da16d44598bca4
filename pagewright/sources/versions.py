"""A table of parts with generations: appended to part by part, compacted without disturbing its readers."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagewright.sources.tables import Files

#: Attempts at a generation that others publish too.
ATTEMPTS = 20
_END = "end"


class Versions:
    """Rows of ``schema`` at ``at``. A generation is a small file that lists its parts; it is created once and never changed."""

    def __init__(self, spark: SparkSession, at: str, schema: str):
        self.spark, self.at, self.schema, self.files = spark, at.rstrip("/"), schema, Files(spark, at)

    def generations(self) -> list[int]:
        return [int(n) for n in self.files.names("generations") if n.isdigit()]

    def _listed(self, generation: int) -> list[str] | None:
        """Parts of a generation, None while its writer hasn't finished."""
        names = self.files.read(f"generations/{generation:012d}", 1 << 22).split("\n")
        return names[:-1] if names[-1] == _END else None

    def _latest(self) -> tuple[int, list[str]]:
        for g in reversed(self.generations()):
            names = self._listed(g)
            if names is not None:
                return g, names
        return 0, []

    def parts(self) -> list[str]:
        return self._latest()[1]

    def read(self, generation: int | None = None) -> DataFrame:
        """The rows of a generation, the latest by default; none where nothing was written. Files that can't be read are left out."""
        names = self.parts() if generation is None else self._listed(generation) or []
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).option("ignoreCorruptFiles", "true").parquet(*[f"{self.at}/parts/{n}" for n in names])

    def _publish(self, change: Callable[[list[str]], list[str]]) -> int:
        for _ in range(ATTEMPTS):
            g, names = self._latest()
            now = change(names)
            if now == names and g:
                return g
            if self.files.create(f"generations/{g + 1:012d}", "\n".join([*now, _END])):
                return g + 1
        raise RuntimeError(f"{ATTEMPTS} others published a generation of {self.at} first")

    def append(self, rows: DataFrame, name: str) -> int:
        """The generation with the part ``name`` too. A part that is there already stays as it is: a batch that is tried again adds nothing."""
        if name in self.parts():
            return self._latest()[0]
        rows.write.mode("overwrite").parquet(f"{self.at}/parts/{name}")
        return self._publish(lambda names: names if name in names else [*names, name])

    def compact(self, keep: Callable[[DataFrame], DataFrame]) -> int:
        """The generation in which one part has what ``keep`` leaves of the rows; parts that come meanwhile stay beside it."""
        g, names = self._latest()
        if not names:
            return g
        made = f"compact-{uuid.uuid4().hex}"
        keep(self.read(g)).write.parquet(f"{self.at}/parts/{made}")
        return self._publish(lambda now: [made, *[n for n in now if n not in names]])

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete all but the last ``keep`` generations and the parts that none of them lists, when nobody reads or writes others; returns those parts."""
        published = self.generations()
        held = {n for g in published[-keep:] for n in self._listed(g) or []}
        for g in published[:-keep]:
            self.files.delete(f"generations/{g:012d}")
        dead = [n for n in self.files.names("parts") if n not in held]
        for n in dead:
            self.files.delete(f"parts/{n}")
        return dead
