"""Sample files as data sources: large files read by byte ranges, and a sink that
publishes whole files only.

    from talkloom.sources import wav
    wav.register(spark)
    blocks = spark.read.format("talkloom_wav").load(folder)           # or talkloom_spool
    wav.write_channels(blocks, folder)                                # talkloom_wav_files

Files lie where pyarrow's file systems reach (file, s3, gs, hdfs with its library); a
path without scheme is local. Every executor and the driver must see them alike.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from talkloom.sources.audio import BLOCK, SAMPLES

#: Bytes that one task reads, about, files among them at most, and blocks in one batch.
SPLIT_BYTES, SPLIT_FILES, BATCH_BLOCKS = 32 << 20, 1024, 256
#: Samples that the sink turns into bytes at once, and files that the driver touches at once.
WRITE_SAMPLES, THREADS = 1 << 18, 16
#: Rate of raw spool files, which do not tell it.
SPOOL_RATE = 16_000
_SCHEMA = pa.schema([("path", pa.string()), ("rate", pa.int32()), ("frame_ix", pa.int32()), ("samples", pa.list_(pa.float32()))])


def file_system(path: str):
    """pyarrow's file system of a path, and the path within it."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if "://" in path or path.startswith("file:"):
        return FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return LocalFileSystem(), path


def _each(fs, do: Callable, files: list) -> list:
    """do() of each file, in order; THREADS at once where a call waits for a network."""
    if fs.type_name == "local":
        return [do(f) for f in files]
    with ThreadPoolExecutor(THREADS) as pool:
        return list(pool.map(do, files))


@dataclass
class Layout:
    """Where a file's samples lie: bytes before them, of them, and of one frame of all
    its channels; how a channel's values are written; rate -1: no sample file."""

    start: int = 0
    size: int = 0
    frame: int = 2
    kind: str = "<i2"
    rate: int = -1

    @property
    def blocks(self) -> int:
        return -(-(self.size // self.frame) // BLOCK) if self.rate >= 0 else 0


def wav_layout(f, length: int) -> Layout:
    """Reads the chunks' heads of a 16-bit WAV file; a data chunk that tells more than
    the file holds, as one that was cut off does, ends with the file."""
    head = f.read(12)
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
        return Layout()
    channels, rate, at = 0, -1, 12
    while at + 8 <= length:
        f.seek(at)
        name, size = struct.unpack("<4sI", f.read(8))
        if name == b"fmt ":
            form, channels, rate, _, frame, bits = struct.unpack("<HHIIHH", f.read(16))
            if form not in (1, 0xFFFE) or bits != 16 or not channels:
                return Layout()
        elif name == b"data":
            return Layout(at + 8, min(size, length - at - 8) // (2 * channels) * 2 * channels, 2 * channels, "<i2", rate) if channels else Layout()
        at += 8 + size + size % 2
    return Layout()


@dataclass
class Range:
    """Blocks first to last (exclusive) of one file; without a layout, those of them
    that its head tells of."""

    path: str
    size: int
    layout: Layout | None
    first: int
    last: int


@dataclass
class Ranges(InputPartition):
    """What one task reads."""

    ranges: list[Range]


@dataclass
class _Wanted:
    """What pushed filters leave: frames low to high (inclusive), and paths."""

    low: int = 0
    high: int = (1 << 31) - 1
    paths: set[str] | None = field(default=None)

    def take(self, f: Filter) -> bool:
        """Whether the filter is applied here."""
        column = getattr(f, "attribute", None)
        if column == ("frame_ix",) and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
            if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            return True
        if column == ("path",) and isinstance(f, EqualTo | In):
            named = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.paths = named if self.paths is None else self.paths & named
            return True
        return False


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int, suffixes: tuple[str, ...]):
        self.path, self.split, self.suffixes, self.wanted = path, split, suffixes, _Wanted()

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  named by Spark
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def layout(self, f, length: int) -> Layout:
        raise NotImplementedError

    def scheme(self) -> str:
        """What stands before the paths of files, as they are shown."""
        return self.path.split("://", 1)[0] + "://" if "://" in self.path else ""

    def partitions(self) -> list[InputPartition]:
        """Files of up to `split` bytes are read several to a task, which also reads their
        heads; only larger ones are opened here, to cut them."""
        from pyarrow.fs import FileSelector, FileType

        fs, base = file_system(self.path)
        scheme = self.scheme()
        info = fs.get_file_info(base)
        found = [info] if info.type == FileType.File else [i for i in fs.get_file_info(FileSelector(base, recursive=True)) if i.type == FileType.File]
        wanted = []
        for i in sorted(found, key=lambda i: i.path):
            name = i.base_name.lower()
            if name.endswith(self.suffixes) and not name.startswith(("_", ".")) and "/_" not in i.path.removeprefix(base) and (self.wanted.paths is None or scheme + i.path in self.wanted.paths):
                wanted.append(i)
        out, held, size = [], [], 0
        for i in wanted:
            if i.size <= self.split:
                if held and (size + i.size > self.split or len(held) == SPLIT_FILES):
                    out.append(Ranges(held))
                    held, size = [], 0
                held.append(Range(i.path, i.size, None, self.wanted.low, self.wanted.high + 1))
                size += i.size
        out += [Ranges(held)] if held else []
        large = [i for i in wanted if i.size > self.split]

        def head(i) -> Layout:
            with fs.open_input_file(i.path) as f:
                return self.layout(f, i.size)

        for i, layout in zip(large, _each(fs, head, large), strict=True):
            step = max(1, self.split // (BLOCK * layout.frame))
            first, last = self.wanted.low, self.wanted.high + 1
            if layout.blocks:
                first, last = max(0, first), min(layout.blocks, last)
                out += [Ranges([Range(i.path, i.size, layout, at, min(last, at + step))]) for at in range(first, last, step)]
            else:
                out.append(Ranges([Range(i.path, i.size, layout, first, last)]))
        return out

    def read(self, partition: Ranges | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # filters left nothing to read
            return
        fs, scheme = file_system(self.path)[0], self.scheme()
        held, n = [], 0  # path, rate, first block, samples
        for r in partition.ranges:
            for part in self.parts(fs, r):
                held.append((scheme + r.path, *part))
                n += max(1, -(-len(part[-1]) // BLOCK))
                if n >= BATCH_BLOCKS:
                    yield _batch(held)
                    held, n = [], 0
        if held:
            yield _batch(held)

    def parts(self, fs, r: Range) -> Iterator[tuple[int, int, np.ndarray]]:
        """Rate, first block and samples of up to BATCH_BLOCKS blocks of a range at a time."""
        with fs.open_input_file(r.path) as f:
            at = r.layout or self.layout(f, r.size)
            if not at.blocks and r.first <= 0 < r.last:  # one empty block tells of the file
                yield at.rate, 0, np.zeros(0, np.float32)
            for first in range(max(0, r.first), min(at.blocks, r.last), BATCH_BLOCKS):
                last = min(at.blocks, r.last, first + BATCH_BLOCKS)
                begin = first * BLOCK * at.frame
                f.seek(at.start + begin)
                data = f.read(min(at.size, last * BLOCK * at.frame) - begin)
                width = at.frame // np.dtype(at.kind).itemsize
                x = np.frombuffer(data, at.kind)[::width]
                yield at.rate, first, x.astype(np.float32) / np.float32(32768) if at.kind == "<i2" else x.astype(np.float32)


def _batch(parts: list[tuple[str, int, int, np.ndarray]]) -> pa.RecordBatch:
    paths, rates, places, lengths = [], [], [], []
    for path, rate, first, x in parts:
        own = [min(BLOCK, len(x) - k) for k in range(0, len(x), BLOCK)] or [0]
        paths += [path] * len(own)
        rates += [rate] * len(own)
        places += range(first, first + len(own))
        lengths += own
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    samples = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([p[3] for p in parts])))
    return pa.RecordBatch.from_arrays([pa.array(paths), pa.array(rates, pa.int32()), pa.array(places, pa.int32()), samples], schema=_SCHEMA)


class _WavReader(_Reader):
    def layout(self, f, length: int) -> Layout:
        return wav_layout(f, length)


class _SpoolReader(_Reader):
    def __init__(self, path: str, split: int, suffixes: tuple[str, ...], rate: int):
        super().__init__(path, split, suffixes)
        self.rate = rate

    def layout(self, f, length: int) -> Layout:
        return Layout(0, length // 4 * 4, 4, "<f4", self.rate)


class WavSource(DataSource):
    """path, rate, frame_ix, samples of 16-bit WAV files, first channel, in blocks of
    BLOCK samples; a file that is none has rate -1 and one empty block. Option
    `split`: bytes a task reads. Filters on frame_ix and path choose what is read."""

    @classmethod
    def name(cls) -> str:
        return "talkloom_wav"

    def schema(self) -> str:
        return SAMPLES

    def reader(self, schema) -> DataSourceReader:
        return _WavReader(self.options["path"], int(self.options.get("split", SPLIT_BYTES)), (".wav",))


class SpoolSource(DataSource):
    """As WavSource, of raw little-endian float32 files (.f32). Option `rate`."""

    @classmethod
    def name(cls) -> str:
        return "talkloom_spool"

    def schema(self) -> str:
        return SAMPLES

    def reader(self, schema) -> DataSourceReader:
        return _SpoolReader(self.options["path"], int(self.options.get("split", SPLIT_BYTES)), (".f32",), int(self.options.get("rate", SPOOL_RATE)))


# --- sink ---------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: name, its place below the job's folder, error."""

    files: list[tuple[str, str, str | None]]


class _Files(DataSourceArrowWriter):
    """Two phases: tasks write to names of their own below `_tmp-<job>`; the commit
    moves one file of each name to its place and removes the rest. A task that fails or
    runs twice leaves nothing behind, and a reader never sees half a file."""

    def __init__(self, path: str, rate: int):
        self.path, self.rate, self.job = path, rate, uuid.uuid4().hex

    def folder(self) -> tuple:
        fs, base = file_system(self.path)
        return fs, base, f"{base}/_tmp-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, _, folder = self.folder()
        fs.create_dir(folder, recursive=True)
        files, name, out, left, error, place = [], None, None, 0, None, ""

        def shut():
            nonlocal error
            if name is None:
                return
            if out is not None:
                out.close()
            if left and error is None:
                error = f"{left} samples are missing"
            files.append((name, place, error))

        for batch in batches:
            names, totals = batch.column("name").to_pylist(), batch.column("total").to_pylist()
            column = batch.column("samples")
            values = column.flatten()  # without what null rows hold
            ends = np.cumsum(pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False))
            cuts = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]]
            for k, after in zip(cuts, [*cuts[1:], len(names)], strict=True):
                if names[k] != name:
                    shut()
                    name, left, error, out, place = names[k], totals[k], None, None, f"{uuid.uuid4().hex}.wav"
                    try:
                        if left * 2 + 36 >= 1 << 32:
                            raise OSError("more samples than a WAV file can tell")
                        out = fs.open_output_stream(f"{folder}/{place}")
                        out.write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + 2 * left, b"WAVE", b"fmt ", 16, 1, 1, self.rate, 2 * self.rate, 2, 16, b"data", 2 * left))
                    except OSError as e:
                        error = str(e)
                begin, end = int(ends[k - 1]) if k else 0, int(ends[after - 1])
                for at in range(begin, end, WRITE_SAMPLES) if error is None else ():
                    try:
                        x = values.slice(at, min(end - at, WRITE_SAMPLES)).to_numpy(zero_copy_only=False).astype(np.float64) * 32767
                        out.write(np.clip(np.nan_to_num(x, nan=0.0, posinf=32767, neginf=-32768), -32768, 32767).astype("<i2").tobytes())
                        left -= len(x)
                    except OSError as e:
                        error = str(e)
                        break
        shut()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base, folder = self.folder()

        def publish(file: tuple[str, str, str | None]) -> str | None:
            name, place, error = file
            if error is None:
                try:
                    fs.move(f"{folder}/{place}", f"{base}/{name}.wav")
                except OSError as e:
                    error = str(e)
            return error

        files = [f for m in messages if m is not None for f in m.files]
        failed = {f[0]: error for f, error in zip(files, _each(fs, publish, files), strict=True) if error is not None}
        self._clear()
        if failed:  # told by file, not raised: the other files stand
            with fs.open_output_stream(f"{base}/_errors-{self.job}.json") as out:
                out.write(json.dumps(failed, ensure_ascii=False, sort_keys=True).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, _, folder = self.folder()
        try:
            fs.delete_dir(folder)
        except OSError:
            pass  # no task began


class WavFiles(DataSource):
    """The sink: rows (name, total, samples), those of one name together and in order;
    total is how many samples they hold. Option `rate`."""

    @classmethod
    def name(cls) -> str:
        return "talkloom_wav_files"

    def schema(self) -> str:
        return "name string, total long, samples array<float>"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Files(self.options["path"], int(self.options.get("rate", SPOOL_RATE)))


def register(spark: SparkSession) -> None:
    for source in (WavSource, SpoolSource, WavFiles):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_channels(blocks: DataFrame, folder: str, rate: int = SPOOL_RATE) -> None:
    """One 16-bit WAV file, <meeting_id>_<label>.wav, for each channel of blocks
    (meeting_id, label, frame_ix, samples). A task streams the blocks of a channel one
    after another and holds a batch of them. Files appear whole, once all tasks are
    done; what failed is told by errors_of()."""
    register(blocks.sparkSession)
    named = blocks.select(F.concat_ws("_", F.col("meeting_id").cast("string"), "label").alias("name"), "frame_ix", F.col("samples").cast("array<double>").alias("samples"))  # not float: at the edge of a step that would round up what is cut off
    totals = named.groupBy("name").agg(F.sum(F.greatest(F.size("samples"), F.lit(0))).cast("long").alias("total"))
    rows = named.join(totals, "name").repartition("name").sortWithinPartitions("name", "frame_ix").select("name", "total", "samples")
    rows.write.format("talkloom_wav_files").option("rate", rate).mode("append").save(folder)


def errors_of(folder: str) -> dict[str, str]:
    """name -> error of the files that writes to this folder could not make."""
    from pyarrow.fs import FileSelector

    fs, base = file_system(folder)
    out: dict[str, str] = {}
    for i in fs.get_file_info(FileSelector(base)):
        if i.base_name.startswith("_errors-"):
            with fs.open_input_file(i.path) as f:
                out |= json.loads(f.read())
    return out
