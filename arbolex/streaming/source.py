"""A streaming source of text lines whose intake is a number of lines per trigger.

Spark's text source bounds a trigger by files or bytes. This one counts lines: an offset is a place in a file (file, byte, line)
and the trigger after it takes the next lines of the schedule, over file ends and from inside files. Offsets are planned
on the driver by reading no more than the lines of one trigger; the lines themselves are read by tasks, one for each stretch
of at most ``STRETCH`` bytes.

Files of a folder are taken in the order of their names and must be complete when they appear, as for Spark's own file
source. A file that appears later must have a later name. The last line of a file need not be closed. Paths are
URIs or paths that pyarrow's file systems know, reachable from the driver and all executors.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

NAME = "arbolex_lines"
#: bytes that a task reads at most, but for a longer line
STRETCH = 8 << 20
BUFFER = 1 << 20
ROW = "file string, start bigint, line_no bigint, line string"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """Names and sizes of the files of a folder (or of a single file), by name; hidden ones are passed over."""
    system, at = opened(path)
    info = system.get_file_info(at)
    found = [info] if info.type == pafs.FileType.File else system.get_file_info(pafs.FileSelector(at, recursive=False, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._" and f.size)


def lines_from(path: str, file: str, start: int) -> Iterator[bytes]:
    """Lines of a file from a byte on, each with its line feed."""
    system, _ = opened(path)
    with system.open_input_file(file) as f:
        at, size, rest = start, f.size(), b""
        while at < size:
            block = f.read_at(min(BUFFER, size - at), at)
            at += len(block)
            *whole, rest = (rest + block).split(b"\n")
            for line in whole:
                yield line + b"\n"
        if rest:
            yield rest


@dataclass
class Stretch(InputPartition):
    file: str
    start: int
    end: int
    line_no: int


class LineStreamReader(DataSourceStreamReader):
    """Offsets are ``turn`` (triggers taken), ``file``, ``byte`` and ``line`` (of the next line)."""

    def __init__(self, options: dict):
        self.path, self.plan = options["path"], options.get("plan")
        self.intake = [int(n) for n in options.get("intake", "1000").split(",")]
        self.longest = int(options["longest"]) if options.get("longest") else None
        if min(self.intake) < 1:
            raise ValueError("every intake must be at least one line")
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        return {"turn": 0, "file": "", "byte": 0, "line": 1}

    def kept(self, line: bytes) -> bool:
        return self.longest is None or len(line.decode("utf-8", "replace").split()) <= self.longest

    def remembered(self) -> dict:
        """Where planning stood when the query was stopped; it is written before Spark logs the offset."""
        if self.plan:
            system, at = opened(self.plan)
            if system.get_file_info(at).type == pafs.FileType.File:
                with system.open_input_stream(at) as f:
                    return json.loads(f.read())
        return self.initialOffset()

    def remember(self, offset: dict) -> None:
        if self.plan:
            system, at = opened(self.plan)
            system.create_dir(at.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(at) as f:
                f.write(json.dumps(offset).encode())

    def latestOffset(self) -> dict:
        at = self.at or self.remembered()
        wanted = self.intake[min(at["turn"], len(self.intake) - 1)]
        file, byte, number, taken = at["file"], at["byte"], at["line"], 0
        for name, size in listed(self.path):
            if name < file or taken == wanted:
                continue
            if name > file:
                file, byte, number = name, 0, 1
            if byte >= size:
                continue
            for line in lines_from(self.path, name, byte):
                if taken == wanted:
                    break
                byte, number, taken = byte + len(line), number + 1, taken + self.kept(line)
        moved = (file, byte) != (at["file"], at["byte"])
        self.at = {"turn": at["turn"] + 1, "file": file, "byte": byte, "line": number} if moved else at
        if moved:
            self.remember(self.at)
        return self.at

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        out = []
        for name, size in listed(self.path):
            if name < start["file"] or name > end["file"]:
                continue
            first = name == start["file"]
            begin, number = (start["byte"], start["line"]) if first else (0, 1)
            stop = end["byte"] if name == end["file"] else size
            at = begin
            if stop - begin > STRETCH:
                open_at, open_number = begin, number
                for line in lines_from(self.path, name, begin):
                    if at >= stop:
                        break
                    if at - open_at >= STRETCH:
                        out.append(Stretch(name, open_at, at, open_number))
                        open_at, open_number = at, number
                    at, number = at + len(line), number + 1
                begin, number = open_at, open_number
            if begin < stop:
                out.append(Stretch(name, begin, stop, number))
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        at, number = partition.start, partition.line_no
        for line in lines_from(self.path, partition.file, partition.start):
            if at >= partition.end:
                return
            if self.kept(line):
                yield partition.file, partition.start, number, line.decode("utf-8", "replace").removesuffix("\n")
            at, number = at + len(line), number + 1

    def commit(self, end: dict) -> None:
        """What was planned is remembered already."""


class LineSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return ROW

    def streamReader(self, schema) -> LineStreamReader:
        return LineStreamReader(self.options)


def stream_line_counts(
    spark: SparkSession, path: str, intake: Sequence[int], checkpoint: str, longest: int | None = None
) -> DataFrame:
    """Lines of a folder as a stream, ``file, start, line_no, line``: each trigger takes the next number of ``intake``.

    The last number goes for all further triggers. Lines of more than ``longest`` words are passed over and not counted.
    ``checkpoint`` is the folder of the query that will read the stream.
    """
    spark.dataSource.register(LineSource)
    reader = spark.readStream.format(NAME).option("path", path).option("intake", ",".join(map(str, intake)))
    reader = reader.option("plan", f"{checkpoint.rstrip('/')}-plan/offset")
    return (reader.option("longest", longest) if longest is not None else reader).load()


def drain_triggers(stream: DataFrame, checkpoint: str, write_epoch: Callable[[DataFrame, int], None]) -> None:
    """Run a stream trigger by trigger until no more is there."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(processingTime="0 seconds").foreachBatch(write_epoch).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
