"""Data source ``source_files``: whole text files below a folder, whatever their names, in batches and as a stream.

Spark's own file sources list no name that starts with ``_`` or ``.``; this one lists all. The driver
walks folders only and holds no file names: a folder is cut into slices by the bytes and files seen in it, small
folders share a slice, and a task lists its folders again and reads the files that fall to it. From a level of many folders on,
the driver opens none: tasks walk what lies below. Ignored folders are not
entered, and files are judged by name before they are opened. What cannot be listed or read becomes a
row with ``error`` instead of a text, so errors are data: they can be counted, stored and retried.

Symbolic links are not followed. Stores are those that ``pyarrow.fs`` opens by their address.
"""

from __future__ import annotations

import json
import os
import re
import time
import zlib
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, size bigint, mtime timestamp, text string, error string"
_ARROW = pa.schema([("path", pa.string()), ("size", pa.int64()), ("mtime", pa.timestamp("us", tz="UTC")), ("text", pa.string()), ("error", pa.string())])
SLICE_BYTES = 64 << 20  # of files, for one task
SLICE_FILES = 20_000
SUBTREES = 4_096  # folders of one level, beyond which the driver deals them out and tasks walk what lies below
FEWEST, MOST_SLICES = 256, 2_000  # folders of a task then, and tasks
BATCH_BYTES = 16 << 20  # of texts in one Arrow batch


@dataclass
class Slice(InputPartition):
    """Files of folders: those whose name's checksum leaves ``k`` on division by ``n``. ``since`` and ``until`` bound the
    time of change in nanoseconds (exclusive, inclusive). ``errors``: folders that could not be listed. ``deep``: all that lies
    below the folders too."""

    folders: list[str]
    k: int = 0
    n: int = 1
    since: int | None = None
    until: int | None = None
    errors: tuple[tuple[str, str], ...] = ()
    deep: bool = False


class Folder:
    """A root folder with the rules of what to read below it."""

    def __init__(self, options: dict):
        root = re.sub(r"^file:/+", "/", options["path"])
        self.fs, self.root = (pyarrow.fs.FileSystem.from_uri(root) if "://" in root else (pyarrow.fs.LocalFileSystem(), root))
        self.root = self.root.rstrip("/") or "/"
        self.exts = tuple(json.loads(options.get("extensions", "[]")))
        ignore = options.get("ignoreregex", "")
        self.ignore = re.compile(ignore) if ignore else None
        self.prune = options.get("prune", "true") == "true"
        self.texts = options.get("texts", "true") == "true"

    def _known(self, path: str) -> str:
        return path if path.startswith("/") else f"/{path}"

    def list(self, folder: str, mine: Callable[[str], bool] = lambda name: True) -> list[pyarrow.fs.FileInfo]:
        """Folders, and the files with a wanted extension whose name is ``mine``. Other local files are not looked at,
        so that the tasks that share a folder look at each file once."""
        if not isinstance(self.fs, pyarrow.fs.LocalFileSystem):
            return [f for f in self.fs.get_file_info(pyarrow.fs.FileSelector(folder))
                    if f.type == pyarrow.fs.FileType.Directory or (self.named(f.base_name) and mine(f.base_name))]
        found = []
        with os.scandir(folder) as entries:
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    found.append(pyarrow.fs.FileInfo(e.path, pyarrow.fs.FileType.Directory))
                elif e.is_file(follow_symlinks=False) and self.named(e.name) and mine(e.name):
                    try:
                        s = e.stat(follow_symlinks=False)
                    except FileNotFoundError:
                        continue  # gone since it was listed
                    found.append(pyarrow.fs.FileInfo(e.path, pyarrow.fs.FileType.File, mtime_ns=s.st_mtime_ns, size=s.st_size))
        return found

    def named(self, name: str) -> bool:
        """The extension counts in any case."""
        dot = name.rfind(".")
        return not self.exts or (dot > 0 and name[dot:].lower() in self.exts)

    def wanted(self, f: pyarrow.fs.FileInfo) -> bool:
        """Judged by name."""
        if f.type != pyarrow.fs.FileType.File:
            return False
        return self.named(f.base_name) and not (self.ignore and self.ignore.search(self._known(f.path)))

    def walk(self, folders: list[str] | None = None, most: int | None = None) -> Iterator[tuple]:
        """(folder, its files) of the folders and all below, or (folder, error); at a level of more than ``most`` folders
        (those folders, None), and what lies there is left to others."""
        def look(folder):
            try:
                return folder, self.list(folder)
            except OSError as e:
                return folder, _message(e)
        level = folders or [self.root]
        with ThreadPoolExecutor(16) as pool:
            while level:
                if most is not None and len(level) > most:
                    yield level, None
                    return
                below = []
                for folder, found in pool.map(look, level):
                    if isinstance(found, str):
                        yield folder, found
                        continue
                    below += [f.path for f in found if f.type == pyarrow.fs.FileType.Directory
                              and not (self.prune and self.ignore and self.ignore.search(self._known(f.path)))]
                    yield folder, [f for f in found if self.wanted(f)]
                level = below

    def _found(self, folder: str, *mine) -> list[pyarrow.fs.FileInfo] | str:
        """The wanted files of one folder, or the error."""
        try:
            return [f for f in self.list(folder, *mine) if self.wanted(f)]
        except OSError as e:
            return _message(e)

    def slices(self, since: int | None = None, until: int | None = None) -> list[Slice]:
        out, few, size, count, errors = [], [], 0, 0, []
        for folder, found in self.walk(most=SUBTREES):
            if found is None:
                each = max(FEWEST, -(-len(folder) // MOST_SLICES))
                out += [Slice(folder[k:k + each], 0, 1, since, until, deep=True) for k in range(0, len(folder), each)]
                continue
            if isinstance(found, str):
                errors.append((self._known(folder), found))
                continue
            if since is not None:
                found = [f for f in found if since < f.mtime_ns <= until]
            if not found:
                continue
            b = sum(f.size for f in found)
            n = max(-(-b // SLICE_BYTES), -(-len(found) // SLICE_FILES))
            if n > 1:
                out += [Slice([folder], k, n, since, until) for k in range(n)]
                continue
            if few and (size + b > SLICE_BYTES or count + len(found) > SLICE_FILES):
                out.append(Slice(few, 0, 1, since, until))
                few, size, count = [], 0, 0
            few, size, count = [*few, folder], size + b, count + len(found)
        if few:
            out.append(Slice(few, 0, 1, since, until))
        if errors:
            out.append(Slice([], errors=tuple(errors)))
        return out

    def newest(self, until: int) -> int | None:
        """Latest time of change of a wanted file, no later than ``until``."""
        times = [f.mtime_ns for _, found in self.walk() if not isinstance(found, str) for f in found if f.mtime_ns <= until]
        return max(times, default=None)

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = [(path, None, None, None, error) for path, error in part.errors]
        held = 0

        mine = [lambda name: zlib.crc32(name.encode()) % part.n == part.k] if part.n > 1 else []
        for folder, found in self.walk(part.folders) if part.deep else ((folder, self._found(folder, *mine)) for folder in part.folders):
            if isinstance(found, str):
                rows.append((self._known(folder), None, None, None, found))
                continue
            for f in sorted(found, key=lambda f: f.base_name):
                if part.since is not None and not part.since < f.mtime_ns <= part.until:
                    continue
                text = error = None
                if self.texts:
                    try:
                        with self.fs.open_input_stream(f.path) as s:
                            text = s.read().decode("utf-8", "replace")
                    except FileNotFoundError:
                        continue  # gone since it was listed
                    except OSError as e:
                        error = _message(e)
                rows.append((self._known(f.path), f.size, f.mtime, text, error))
                held += len(text or "")
                if held > BATCH_BYTES:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)


def _message(e: OSError) -> str:
    return f"{type(e).__name__}: {e}"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[Slice]:
        return Folder(self.options).slices() or [Slice([])]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        return Folder(self.options).read(part)


class _StreamReader(DataSourceStreamReader):
    """Offsets are times of change. Files newer than ``settleMs`` wait for the next batch, so that files of
    one tick of the store's clock come together."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:
        return {"changed": -1}

    def latestOffset(self) -> dict:
        until = time.time_ns() - int(self.options.get("settlems", "0")) * 1_000_000
        newest = Folder(self.options).newest(until)
        self._last = max(getattr(self, "_last", -1), -1 if newest is None else newest)
        return {"changed": self._last}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        if end["changed"] <= start["changed"]:
            return [Slice([])]
        return Folder(self.options).slices(start["changed"], end["changed"]) or [Slice([])]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        return Folder(self.options).read(part)


class SourceFiles(DataSource):
    """Options: path, extensions (JSON list, lower case, with dots), ignoreRegex, prune, texts (false: names only), settleMs."""

    @classmethod
    def name(cls) -> str:
        return "source_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(_plain(self.options))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(_plain(self.options))


def _plain(options) -> dict:
    return {k.lower(): v for k, v in options.items()}


def with_options(spark: SparkSession, reader, root: str, exts, ignore_regex: str, prune: bool = True, texts: bool = True, **more):
    """``reader`` (``spark.read`` or ``spark.readStream``) set to read this source."""
    spark.dataSource.register(SourceFiles)
    return reader.format("source_files").options(path=root, extensions=json.dumps(list(exts)), ignoreRegex=ignore_regex,
                                                 prune=str(prune).lower(), texts=str(texts).lower(), **more)


def write_files(df, root: str, path: str = "path", text: str = "text"):
    """Write each row's text as a file below ``root``; returns (path, bytes) of what was written. Rows of one path
    replace each other, so a task that runs again changes nothing."""
    def run(batches):
        place, made = Folder({"path": root}), set()
        for batch in batches:
            paths, sizes = [], []
            made.clear()
            for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data, target = (t or "").encode(), f"{place.root}/{p.lstrip('/')}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    place.fs.create_dir(folder, recursive=True)
                    made.add(folder)
                with place.fs.open_output_stream(target) as out:
                    out.write(data)
                paths.append(p)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["path", "bytes"])
    return df.select(path, text).mapInArrow(run, "path string, bytes bigint")


def read_files(paths, root: str):
    """(path, text, size, mtime) of the listed files below ``root``; those that are gone or cannot be read are left out."""
    def run(batches):
        place = Folder({"path": root})
        for batch in batches:
            rows, held = [], 0
            for path in batch.column(0).to_pylist():
                own = path if isinstance(place.fs, pyarrow.fs.LocalFileSystem) or place.root.startswith("/") else path.lstrip("/")
                try:
                    info = place.fs.get_file_info(own)
                    with place.fs.open_input_stream(own) as s:
                        rows.append((path, info.size, info.mtime, s.read().decode("utf-8", "replace"), None))
                except OSError:
                    continue
                held += info.size
                if held > BATCH_BYTES:
                    yield _batch(rows).drop_columns(["error"])
                    rows, held = [], 0
            if rows:
                yield _batch(rows).drop_columns(["error"])
    return paths.select("path").mapInArrow(run, "path string, size bigint, mtime timestamp, text string")
