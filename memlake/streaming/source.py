"""A streaming source of complete lines of growing JSONL files, with a byte cursor for each file.

The offset is {path: byte after the last complete line}; a partial last line waits, and a file that did not grow is not opened. What a
file grew by is cut into ranges of bounded size, which executors read from the store that holds them. A task takes many small ranges,
so tasks grow with the bytes and not with the files.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from memlake.sources import ranges

SCHEMA = "path string, line_start long, line_end long, line string"


#: What opening a file counts for, in bytes, when ranges are dealt to tasks; and threads that ask for the ends of grown files.
OPENING, ASKING = 256 << 10, 16


class Ranges(InputPartition):
    """Ranges (path, begin, end, base) of one task."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        self.ranges = ranges


class _Reader(DataSourceStreamReader):
    def __init__(self, root: str, suffix: str, size: int):
        self.root, self.suffix, self.size = root, suffix, size
        self.seen: dict[str, int] = {}
        self.lengths: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        grown = [(path, length) for path, length in ranges.listing(self.root, self.suffix) if length != self.lengths.get(path)]
        with ThreadPoolExecutor(ASKING) as pool:
            ends = pool.map(lambda x: ranges.complete_end(x[0], self.seen.get(x[0], 0)), grown)
            self.seen.update((path, end) for (path, _), end in zip(grown, ends, strict=True))
        self.lengths.update(grown)
        return dict(sorted(self.seen.items()))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out, room = [], 0
        for path, stop in end.items():
            base = start.get(path, 0)
            for at in range(base, stop, self.size):
                cost = min(self.size, stop - at) + OPENING
                if cost > room:
                    out.append(Ranges([]))
                    room = self.size + OPENING
                out[-1].ranges.append((path, at, min(at + self.size, stop), base))
                room -= cost
        return out or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for path, begin, end, base in partition.ranges:
            for first, last, line in ranges.lines_in(path, begin, end, base):
                yield path, first, last, line.rstrip(b"\r").decode("utf-8", "replace")


class TranscriptLines(DataSource):
    """spark.readStream.format("transcript_lines").load(root); options `suffix` (.jsonl) and `rangeBytes`."""

    @classmethod
    def name(cls) -> str:
        return "transcript_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Reader(self.options["path"], self.options.get("suffix", ".jsonl"), int(self.options.get("rangeBytes", ranges.RANGE_BYTES)))


def offsets_json(offset: dict) -> str:
    return json.dumps(offset, sort_keys=True)
