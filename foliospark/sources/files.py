"""Files as Spark data sources: a sink that shows whole results or none, a source of whole files, and one that reads archives by ranges."""

from __future__ import annotations

import fnmatch
import os
import posixpath
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from foliospark.sources.archives import BATCH_BYTES, BATCH_ROWS, UNREADABLE

SINK, SOURCE, WHOLE = "foliospark_files", "foliospark_archives", "foliospark_folder"
#: Folders of this name and a job's are its attempts'; no source reads them.
STAGING = ".attempts-"
#: Files that commit moves at once, and those that a thread takes one after another; archives and bytes of them in one task of the source.
MOVERS, MOVED = 32, 256
TASK_FILES, TASK_BYTES = 256, 64 << 20
_PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def open_folder(uri: str):
    """(file system, path) of a folder: a path, or the URI of any file system that pyarrow opens (hdfs, s3, file)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


def safe_name(name: str) -> str:
    """A path below the folder: back slashes count as slashes; empty steps, . and .. go."""
    return "/".join(p for p in name.replace("\\", "/").split("/") if p not in ("", ".", ".."))


def entries_of(where, path: str) -> Iterator[tuple[str, bool, int]]:
    """(name, is a folder, size) of what a folder holds, one after another. A local folder is never held as a whole; pyarrow gives that of
    another file system in one list."""
    from pyarrow import fs

    if isinstance(where, fs.LocalFileSystem):
        with os.scandir(path) as found:
            for x in found:
                if x.is_dir() or x.is_file():
                    yield x.name, x.is_dir(), 0 if x.is_dir() else x.stat().st_size
    else:
        for info in where.get_file_info(fs.FileSelector(path)):
            if info.type in (fs.FileType.File, fs.FileType.Directory):
                yield info.base_name, info.type == fs.FileType.Directory, info.size or 0


def files_below(where, path: str) -> Iterator[tuple[str, int]]:
    """(path below the folder, size) of its files and those of its sub-folders, but for what jobs have not committed; a folder that isn't
    there has none."""
    from pyarrow import fs

    folders = [""] if where.get_file_info(path).type == fs.FileType.Directory else []
    while folders:
        at = folders.pop()
        for name, is_folder, size in entries_of(where, f"{path}/{at}"):
            if not is_folder:
                yield f"{at}{name}", size
            elif not name.startswith(STAGING):
                folders.append(f"{at}{name}/")


def packed(names: list[str]) -> bytes:
    return zlib.compress("\0".join(names).encode(errors="surrogateescape"))


def unpacked(data: bytes) -> list[str]:
    return zlib.decompress(data).decode(errors="surrogateescape").split("\0") if data else []


# --- sink -------------------------------------------------------------------------------------------------------------------------


class Written(WriterCommitMessage):
    """What a task attempt has written: its own folder, and how many files; their names stand beside it (see names_of), as the driver
    holds the messages of all tasks at once."""

    def __init__(self, folder: str, count: int):
        self.folder, self.count = folder, count


def names_of(folder: str) -> str:
    """The file that holds the names of an attempt's files."""
    return f"{folder}.names"


class FileSink(DataSource):
    """Rows (name string, content binary) as files of a folder. Option `path`: the folder, which driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return SINK

    def writer(self, schema: StructType, overwrite: bool) -> FileWriter:
        if [f.dataType.typeName() for f in schema] != ["string", "binary"]:
            raise ValueError("the sink takes two columns: a name (string) and a content (binary)")
        return FileWriter(self.options["path"], uuid.uuid4().hex, overwrite, self.options.get("joined") == "true")


class FileWriter(DataSourceArrowWriter):
    """Each task attempt writes to a folder of its own; only when all tasks are done do the files of the attempts that count get their
    names, and if any fails for good, none does. Null contents are left out; of rows of one name in a task the last wins, of several
    tasks' any one. A retried or doubled task leaves nothing, since the attempts' folders go at the end."""

    def __init__(self, folder: str, job: str, overwrite: bool, joined: bool = False):
        self.folder, self.job, self.overwrite, self.joined = folder, job, overwrite, joined

    def _staging(self, path: str) -> str:
        return f"{path.rstrip('/')}/{STAGING}{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, path = open_folder(self.folder)
        own = f"{self._staging(path)}/{uuid.uuid4().hex}"
        names: dict[str, None] = {}
        made: set[str] = set()
        at, file = None, None
        try:
            for batch in iterator:
                for name, content in zip(batch.column(0), batch.column(1), strict=True):
                    if not content.is_valid or not name.is_valid or not (plain := safe_name(name.as_py())):
                        continue
                    if not (self.joined and plain == at):
                        if file is not None:
                            file.close()
                        target = f"{own}/{plain}"
                        if (parent := posixpath.dirname(target)) not in made:
                            where.create_dir(parent, recursive=True)
                            made.add(parent)
                        at, file = plain, where.open_output_stream(target)
                        names[plain] = None
                    file.write(content.as_buffer())
        finally:
            if file is not None:
                file.close()
        if names:
            with where.open_output_stream(names_of(own)) as listed:
                listed.write(packed(list(names)))
        return Written(own, len(names))

    def commit(self, messages: list[Written | None]) -> None:
        where, path = open_folder(self.folder)
        staging = self._staging(path)
        if self.overwrite:
            self._clear(where, path, staging)
        where.create_dir(path, recursive=True)
        with ThreadPoolExecutor(MOVERS) as pool:
            for folder in (m.folder for m in messages if m and m.count):
                with where.open_input_file(names_of(folder)) as listed:
                    names = unpacked(listed.read())
                for parent in {posixpath.dirname(n) for n in names} - {""}:
                    where.create_dir(f"{path}/{parent}", recursive=True)

                def move(at: int, folder=folder, names=names) -> None:
                    for n in names[at : at + MOVED]:
                        where.move(f"{folder}/{n}", f"{path}/{n}")

                list(pool.map(move, range(0, len(names), MOVED)))
        self._drop(where, staging)

    def abort(self, messages: list[Written | None]) -> None:
        where, path = open_folder(self.folder)
        self._drop(where, self._staging(path))

    def _clear(self, where, path: str, staging: str) -> None:
        from pyarrow import fs

        if where.get_file_info(path).type != fs.FileType.Directory:
            return
        for name, is_folder, _ in entries_of(where, path):
            if name != posixpath.basename(staging):
                where.delete_dir(f"{path}/{name}") if is_folder else where.delete_file(f"{path}/{name}")

    def _drop(self, where, staging: str) -> None:
        from pyarrow import fs

        if where.get_file_info(staging).type != fs.FileType.NotFound:
            where.delete_dir(staging)


def write_folder(rows: DataFrame, folder: str, name: str = "name", content: str = "content", overwrite: bool = False, joined: bool = False) -> None:
    """Each row's bytes as one file of a folder, sub-folders in its name kept; all files or, if the job fails, none. joined: rows of one
    name that follow one another in a task are one file, written as they come."""
    spark = rows.sparkSession
    spark.dataSource.register(FileSink)
    rows.selectExpr(f"CAST(`{name}` AS string) AS name", f"CAST(`{content}` AS binary) AS content").write.format(SINK).mode("overwrite" if overwrite else "append").option("joined", str(joined).lower()).save(folder)


# --- source -----------------------------------------------------------------------------------------------------------------------

ARCHIVE_SCHEMA = "doc_path string, doc_size bigint, entry_idx int, original_name string, path_in_zip string, size bigint, format string, content binary, bytes_read bigint, error string"
ARROW_SCHEMA = pa.schema([("doc_path", pa.string()), ("doc_size", pa.int64()), ("entry_idx", pa.int32()), ("original_name", pa.string()), ("path_in_zip", pa.string()), ("size", pa.int64()), ("format", pa.string()), ("content", pa.binary()), ("bytes_read", pa.int64()), ("error", pa.string())])


class Counted:
    """A file that counts the bytes read from it."""

    def __init__(self, file):
        self.file, self.bytes = file, 0

    def read(self, n: int = -1) -> bytes:
        data = self.file.read() if n is None or n < 0 else self.file.read(n)
        self.bytes += len(data)
        return data

    def seek(self, to: int, whence: int = 0) -> int:
        return self.file.seek(to, whence)

    def tell(self) -> int:
        return self.file.tell()

    def seekable(self) -> bool:
        return True


class Files(InputPartition):
    """Paths below a folder, and sizes, of a task's files: packed, as the driver holds those of all tasks at once."""

    def __init__(self, files: list[tuple[str, int]]):
        super().__init__(None)
        self.packed = packed([x for path, size in files for x in (path, str(size))]) if files else b""

    @property
    def files(self) -> list[tuple[str, int]]:
        held = unpacked(self.packed)
        return list(zip(held[::2], map(int, held[1::2]), strict=True))


def dealt_files(found: Iterable[tuple[str, int]]) -> list[Files]:
    """Files (path, size) by size and number, so that a task's work is bounded."""
    parts: list[Files] = []
    held, weight = [], 0
    for path, size in found:
        held.append((path, size))
        weight += min(size, TASK_BYTES)
        if len(held) >= TASK_FILES or weight >= TASK_BYTES:
            parts.append(Files(held))
            held, weight = [], 0
    return [*parts, Files(held)] if held or not parts else parts


def in_batches(rows: Iterable[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows, whose bytes are in `content`, in batches of bounded size."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += len(row.get("content") or b"")
        if weight >= BATCH_BYTES or len(held) >= BATCH_ROWS:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


class ArchiveSource(DataSource):
    """Entries of the archives of a folder, as ARCHIVE_SCHEMA, reading no more of an archive than its end record, its directory and the
    entries whose content is asked for, so that archives may be of any size. Options: `path`, the folder; `glob` (*.docx); `prefix` of
    the entries' paths; `content`, false to list entries only; `least`, the size under which entries come without content.

    Conditions on path_in_zip, original_name, format (equal, in, begins with) and size (equal, at least, above) that stand in where()
    are decided on the directory, before an entry is read. An archive that can't be read gives one row with its error, unless such
    conditions leave rows without an entry out. bytes_read is what was read for the row: the first row of an archive has the directory.
    """

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return ARCHIVE_SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uri, self.glob, self.prefix = options["path"], options.get("glob", "*.docx"), options.get("prefix", "")
        self.content, self.least = options.get("content", "true").lower() != "false", int(options.get("least", 0))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in ("path_in_zip", "original_name", "format", "size") and type(f) in (EqualTo, In) or column in ("path_in_zip", "original_name") and type(f) is StringStartsWith or column == "size" and type(f) in (GreaterThan, GreaterThanOrEqual):
                self.tests.append((type(f).__name__, column, frozenset(f.value) if type(f) is In else f.value))
            else:
                yield f

    def partitions(self) -> list[Files]:
        """Archives by dealt_files; lock files (~$) are left out. Of a path that is one file, that file."""
        from pyarrow import fs

        where, path = open_folder(self.uri)
        info = where.get_file_info(path)
        found = entries_of(where, path) if info.type == fs.FileType.Directory else [("", False, info.size)] * (info.type == fs.FileType.File)
        wanted = lambda name: not name.startswith("~$") and fnmatch.fnmatch(name.lower(), self.glob.lower())
        return dealt_files((name, size) for name, is_folder, size in found if not is_folder and wanted(name or info.base_name))

    def _wanted(self, row: dict) -> bool:
        decide = {"EqualTo": lambda a, b: a == b, "In": lambda a, b: a in b, "StringStartsWith": lambda a, b: a.startswith(b), "GreaterThan": lambda a, b: a > b, "GreaterThanOrEqual": lambda a, b: a >= b}
        return all(decide[kind](row[column], value) for kind, column, value in self.tests)

    def _entries(self, where, path: str, size: int) -> Iterator[dict]:
        with where.open_input_file(path) as opened:
            file, told = Counted(opened), 0
            with zipfile.ZipFile(file) as z:
                for i, info in enumerate(z.infolist()):
                    name = info.filename
                    row = {"doc_path": path, "doc_size": size, "entry_idx": i, "original_name": posixpath.basename(name), "path_in_zip": name, "size": info.file_size, "format": posixpath.splitext(name)[1].lstrip(".").lower()}
                    if info.is_dir() or not name.startswith(self.prefix) or not self._wanted(row):
                        continue
                    content = z.read(info) if self.content and info.file_size >= self.least else None
                    yield row | {"content": content, "bytes_read": file.bytes - told, "error": None}
                    told = file.bytes

    def _rows(self, files: list[tuple[str, int]]) -> Iterator[dict]:
        where, folder = open_folder(self.uri)
        for name, size in files:
            path = f"{folder.rstrip('/')}/{name}" if name else folder
            try:
                yield from self._entries(where, path, size)
            except UNREADABLE as e:
                if not self.tests:
                    yield {"doc_path": path, "doc_size": size, "error": f"{type(e).__name__}: {e}"}

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return in_batches(self._rows(partition.files), ARROW_SCHEMA)


FOLDER_SCHEMA = "path string, size bigint, content binary"
FOLDER_ARROW = pa.schema([("path", pa.string()), ("size", pa.int64()), ("content", pa.binary())])


class FolderSource(DataSource):
    """Every file below a folder (option `path`) as a row of FOLDER_SCHEMA. Unlike Spark's binaryFile, which keeps a status of each file in
    the driver while it plans, it packs names for its tasks; and names that begin with . or _ are files as any other."""

    @classmethod
    def name(cls) -> str:
        return WHOLE

    def schema(self) -> str:
        return FOLDER_SCHEMA

    def reader(self, schema: StructType) -> FolderReader:
        return FolderReader(self.options["path"])


class FolderReader(DataSourceReader):
    def __init__(self, uri: str):
        self.uri = uri

    def partitions(self) -> list[Files]:
        where, path = open_folder(self.uri)
        return dealt_files(files_below(where, path.rstrip("/")))

    def _rows(self, files: list[tuple[str, int]]) -> Iterator[dict]:
        where, folder = open_folder(self.uri)
        for name, _ in files:
            path = f"{folder.rstrip('/')}/{name}"
            with where.open_input_file(path) as opened:
                content = opened.read()
            yield {"path": path, "size": len(content), "content": content}

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return in_batches(self._rows(partition.files), FOLDER_ARROW)


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """FolderSource over a folder."""
    spark.dataSource.register(FolderSource)
    return spark.read.format(WHOLE).load(folder)


def read_entries(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """ArchiveSource over a folder. Sets spark.sql.python.filterPushdown.enabled, without which Spark keeps conditions to itself."""
    spark.dataSource.register(ArchiveSource)
    spark.conf.set(_PUSHDOWN, "true")
    return spark.read.format(SOURCE).options(**options).load(folder)
