"""A message log as a streaming source: files that only grow, read by offsets that the checkpoint keeps."""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterable, Iterator
from io import BytesIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "partition string, offset bigint, received_at timestamp, raw_xml string"
BLOCKS = ".z.log"  # a log of compressed blocks; other logs are plain lines
BLOCK_BYTES = 1 << 20  # of the lines of a block, unless a single line is longer
HEAD = struct.Struct(">QII")  # bytes of lines in the blocks before, in this one, and of what follows


class Stretch(InputPartition):
    """Bytes of one log, from the start of a line or block to the end of one."""

    def __init__(self, name: str, start: int, end: int):
        self.name, self.start, self.end = name, start, end


def whole_lines(path: str, start: int, end: int, step: int = 1 << 20) -> int:
    """Where the last whole line that starts at `start` or later and ends by `end` is over; `start` if there is none."""
    with open(path, "rb") as f:
        while end > start:
            low = max(start, end - step)
            f.seek(low)
            cut = f.read(end - low).rfind(b"\n")
            if cut >= 0:
                return low + cut + 1
            end = low
    return start


def whole_blocks(path: str, start: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """Of the blocks from `start` on that are whole by `end`: their place, the bytes of lines before, their own, and where the next one starts."""
    with open(path, "rb", buffering=0) as f:
        while start + HEAD.size <= end:
            f.seek(start)
            before, own, size = HEAD.unpack(f.read(HEAD.size))
            if start + HEAD.size + size > end:
                return
            yield start, before, own, start + HEAD.size + size
            start += HEAD.size + size


class BlockWriter:
    """Adds lines to a log of compressed blocks, as its only writer. What a stopped writer left of a block is overwritten: no reader has counted it."""

    def __init__(self, path: str):
        self.file, self.lines, end = open(path, "r+b" if os.path.exists(path) else "w+b", buffering=0), 0, 0
        for _, before, own, end in whole_blocks(path, 0, os.path.getsize(path)):
            self.lines = before + own
        self.file.truncate(end)
        self.file.seek(end)

    def append(self, lines: Iterable[str]) -> None:
        held, size = [], 0
        for line in lines:
            data = line.encode() + b"\n"
            if held and size + len(data) > BLOCK_BYTES:
                self._write(b"".join(held))
                held, size = [], 0
            held.append(data)
            size += len(data)
        if held:
            self._write(b"".join(held))

    def _write(self, text: bytes) -> None:
        body = pa.Codec("zstd", compression_level=9).compress(text, asbytes=True)
        data = HEAD.pack(self.lines, len(text), len(body)) + body
        while data:
            data = data[self.file.write(data) :]
        self.lines += len(text)


def text_bytes(path: str) -> int:
    """Bytes of the lines in all logs of a folder."""
    total = 0
    for log in (os.path.join(path, name) for name in os.listdir(path) if name.endswith(".log")):
        size = os.path.getsize(log)
        total += sum(own for _, _, own, _ in whole_blocks(log, 0, size)) if log.endswith(BLOCKS) else size
    return total


class MessageLogReader(DataSourceStreamReader):
    """Offsets are the next byte of every log. A batch is read by the executors, in stretches of whole lines."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("stretchbytes", 64 << 20))
        self.ends: dict[str, int] = {}  # of the blocks seen so far

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {name: self.end_of(name) for name in sorted(os.listdir(self.path)) if name.endswith(".log")}

    def end_of(self, name: str) -> int:
        log = os.path.join(self.path, name)
        if not name.endswith(BLOCKS):
            return whole_lines(log, 0, os.path.getsize(log))
        for *_, end in whole_blocks(log, self.ends.get(name, 0), os.path.getsize(log)):
            self.ends[name] = end
        return self.ends.get(name, 0)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for name, to in sorted(end.items()):
            at, reach = start.get(name, 0), self.most
            if name.endswith(BLOCKS):
                held = 0
                for place, _, own, _ in whole_blocks(os.path.join(self.path, name), at, to):
                    if held and held + own > self.most:
                        out.append(Stretch(name, at, place))
                        at, held = place, 0
                    held += own
                if at < to:
                    out.append(Stretch(name, at, to))
                continue
            while at < to:
                cut = to if at + reach >= to else whole_lines(os.path.join(self.path, name), at, at + reach)
                if cut == at:  # a line longer than a stretch
                    reach *= 2
                    continue
                out.append(Stretch(name, at, cut))
                at, reach = cut, self.most
        return out

    def read(self, partition: Stretch) -> Iterator[tuple]:
        import datetime as dt

        name = partition.name.removesuffix(BLOCKS).removesuffix(".log")
        for at, line in self.lines(partition):
            try:
                doc = json.loads(line)
                when = dt.datetime.fromisoformat(doc["ts"])
                text = doc["value"]
            except (ValueError, KeyError, TypeError):  # kept as it came: a lost message is worse than an unreadable one
                when, text = None, line.decode("utf-8", "replace").rstrip("\n")
            yield name, at, when, text

    def lines(self, partition: Stretch) -> Iterator[tuple[int, bytes]]:
        """Lines with the number of bytes before them, which in a log of blocks are those of its lines, too."""
        path = os.path.join(self.path, partition.name)
        with open(path, "rb") as f:
            if not partition.name.endswith(BLOCKS):
                f.seek(partition.start)
                at = partition.start
                while at < partition.end:
                    line = f.readline()
                    yield at, line
                    at += len(line)
                return
            for place, at, own, after in whole_blocks(path, partition.start, partition.end):
                f.seek(place + HEAD.size)
                for line in BytesIO(pa.decompress(f.read(after - place - HEAD.size), own, codec="zstd", asbytes=True)):
                    yield at, line
                    at += len(line)

    def commit(self, end: dict) -> None:
        """Nothing to do: the checkpoint has the offsets, and it is written after the batch."""


class MessageLog(DataSource):
    """Folder of `<partition>.log` files, a JSON message (ts, value) a line; option `path`, and `stretchBytes` for what one task reads.

    The folder must be mounted where driver and executors run. A line counts once it ends; logs may only grow. A log named
    `<partition>.z.log` has the lines in compressed blocks (`BlockWriter`), as a broker stores batches; a block counts once it is whole.
    """

    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> MessageLogReader:
        return MessageLogReader({k.lower(): v for k, v in self.options.items()})


def mounted(path: str) -> str:
    """A folder as the machine knows it: a file URL without its scheme."""
    return re.sub(r"^file:/*", "/", path)


def message_stream(spark: SparkSession, path: str, stretch_bytes: int = 64 << 20) -> DataFrame:
    """Messages (partition, offset, received_at, raw_xml) of a folder of logs as a stream."""
    spark.dataSource.register(MessageLog)
    return spark.readStream.format("message_log").option("path", mounted(path)).option("stretchBytes", stretch_bytes).load()
