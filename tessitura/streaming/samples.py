"""A stream whose offsets are sample positions: a decoder that is pulled, some frames at a time, from any position.

Options: path (a WAV file), frames (samples of a batch), start (first sample). A batch that runs again reads the same samples,
as its offsets are positions in the file; the stream has no more data at the file's end.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.frames, self.start = options["path"], int(options.get("frames", 1152)), int(options.get("start", 0))

    def _samples(self):
        from tessitura.sources.files import wav

        with open(self.path, "rb") as f:
            return wav(f.read())[1]

    def initialOffset(self) -> dict[str, int]:
        return {"sample": self.start}

    def read(self, start: dict[str, int]) -> tuple[Iterator[tuple], dict[str, int]]:
        end = {"sample": max(start["sample"], min(start["sample"] + self.frames, len(self._samples())))}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict[str, int], end: dict[str, int]) -> Iterator[tuple]:
        x = self._samples()
        return iter([(i, float(x[i, 0]), float(x[i, -1])) for i in range(start["sample"], end["sample"])])

    def commit(self, end: dict[str, int]) -> None:
        pass


class SampleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "samples"

    def schema(self) -> str:
        return "position bigint, l double, r double"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)


def stream(spark: SparkSession, path: str, frames: int = 1152, start: int = 0):
    """The file's samples as a stream, so many a batch."""
    spark.dataSource.register(SampleSource)
    return spark.readStream.format("samples").option("path", path).option("frames", frames).option("start", start).load()
