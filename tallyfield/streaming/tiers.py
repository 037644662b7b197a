"""Summaries of batches, merged in tiers so that a report reads few of them.

Every batch files its summary; whenever ``fan`` neighbours of one tier are there, they are merged into one of the next.
After n batches a report reads at most ``fan - 1`` summaries of each of log n tiers. A summary's place follows from its
tier and number alone and counts once it is complete, so a batch that is replayed replaces its own share and the merges
that end with it. Summaries that a merge has taken over go when the next batch comes: by then the batch that made the
merge cannot be replayed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Segment = tuple[int, int]


def cover(batches: int, fan: int) -> list[Segment]:
    """(tier, number) of the fewest summaries that hold the first ``batches``, in order."""
    tier, out, begin = 0, [], 0
    while fan ** (tier + 1) <= batches:
        tier += 1
    for t in range(tier, -1, -1):
        while begin + fan**t <= batches:
            out.append((t, begin // fan**t))
            begin += fan**t
    return out


@dataclass(frozen=True)
class Tiers:
    """Summaries below a folder; ``merge`` makes one of several and gives the columns that it takes."""

    spark: SparkSession
    folder: str
    merge: Callable[[DataFrame], DataFrame]
    fan: int = 8

    def path(self, segment: Segment) -> str:
        return f"{self.folder}/tier={segment[0]}/number={segment[1]}"

    def _fs(self, path: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark._jsc.hadoopConfiguration()), place

    def complete(self) -> set[Segment]:
        """Every summary that has been written to its end."""
        fs, place = self._fs(f"{self.folder}/tier=*/number=*/_SUCCESS")
        names = [str(s.getPath().getParent()) for s in fs.globStatus(place) or []]
        return {tuple(int(x.rsplit("=", 1)[1]) for x in n.rsplit("/", 2)[1:]) for n in names}

    def live(self) -> list[Segment]:
        """The summaries that together hold every batch once: a merge that is not complete leaves what it merges."""
        there = self.complete()
        end = max(((n + 1) * self.fan**t for t, n in there), default=0)

        def expand(segment: Segment) -> list[Segment]:
            if segment in there:
                return [segment]
            t, n = segment
            return [s for k in range(self.fan) for s in expand((t - 1, n * self.fan + k))] if t else []

        return [s for segment in cover(end, self.fan) for s in expand(segment)]

    def read(self) -> DataFrame:
        """All summaries that count."""
        return self._of(self.live())

    def _of(self, segments: list[Segment]) -> DataFrame:
        return self.spark.read.parquet(*map(self.path, segments))

    def file(self, summary: DataFrame, number: int) -> None:
        """File the summary of batch ``number``, in place of an earlier try, and merge what is full with it."""
        self.clear(number)
        summary.write.mode("overwrite").parquet(self.path((0, number)))
        end, tier = number + 1, 0
        while end % self.fan ** (tier + 1) == 0:
            there, last = self.complete(), end // self.fan**tier
            parts = [(tier, k) for k in range(last - self.fan, last) if (tier, k) in there]
            tier += 1
            self.merge(self._of(parts)).write.mode("overwrite").parquet(self.path((tier, end // self.fan**tier - 1)))

    def clear(self, number: int) -> None:
        """Delete what complete merges of batches before ``number`` have taken over."""
        there = self.complete()
        for t, n in there:
            above = (t + 1, n // self.fan)
            if above in there and (above[1] + 1) * self.fan ** above[0] <= number:
                fs, place = self._fs(self.path((t, n)))
                fs.delete(place, True)


def tiered_stream(arriving: DataFrame, summary: Callable[[DataFrame], DataFrame], tiers: Tiers, progress: str, once: bool = True):
    """Start a query that files the summary of each micro-batch in the tiers. ``once`` drains what is there and ends."""
    writer = arriving.writeStream.foreachBatch(lambda batch, number: tiers.file(summary(batch), number))
    writer = writer.option("checkpointLocation", progress)
    return (writer.trigger(availableNow=True) if once else writer).start()
