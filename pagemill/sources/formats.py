"""Formats for ``spark.read`` and ``df.write``: the pages of PDFs as rows, and rows as files of their own.

    register(spark)
    spark.read.format("pdf_pages").option("max_pages", 200).load(folder)
    df.select("name", "content").write.format("row_files").mode("append").save(folder)

``pdf_pages`` deals files out to tasks by size and reads each in one task; a file that cannot be read is a row with its error. Options: max_pages
(200), order ("name" or "size"), limit (files, in that order), and most_mb (a larger file is an error).

``row_files`` writes each row's content under its name. A task writes into a folder of its own below ``_staging``; only when all tasks have ended do the
files get their names, so neither a failed task nor an aborted job leaves a part of its output. Of two rows with one name in a write
one wins; ``append`` replaces files of the same name, ``overwrite`` removes the others too. Rows without a name or content are refused.

With the option ``spread`` a task's files stay together, in folders of up to MOST files below one that is renamed at the end: the driver moves a folder per
task and hears of no file, whatever their number. A name is then one file in each task's folder only, and the store must rename folders. ``pdf_pages`` and
``spread_files`` (path, length and content; option ``ending``) read such a folder, each task listing its own part; only ``limit`` looks at all names, one folder at a time.

Paths are local or of any store that pyarrow reaches by its address; on a cluster the folder must be shared.
"""

from __future__ import annotations

import heapq
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from pagemill.sources.pdf import read_pdf

PAGES = "path string, page_no int, total_pages int, text string, meta map<string,string>, error string"
#: Bytes and number of files that a task is given.
TASK, MOST = 8 << 20, 250
#: Begins the name of a task's folder that holds spread files; rows and bytes of a batch that is read.
SPREAD, ROWS, BATCH = "spread-", 2000, 2 << 20
#: Files that get their names at once.
MOVES = 8


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def listed(path: str, ending: str = ".pdf", order: str = "name", limit: int | None = None) -> list[tuple[str, int]]:
    """(path, size) of the files of a folder with this ending, or of the one file named, in order."""
    store, place = opened(path)
    info = store.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(place))
    files = sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.path.lower().endswith(ending) and not f.base_name.startswith(("_", ".")))
    if info.type == fs.FileType.File and not files:
        raise ValueError(f"not a {ending} file: {path}")
    files = sorted(files, key=lambda f: (f[1], f[0])) if order == "size" else files
    return files[:limit]


def spread_folders(path: str) -> list[str]:
    """The folders of spread files below a folder, by name; none where files stand in it themselves."""
    store, place = opened(path)
    if store.get_file_info(place).type != fs.FileType.Directory:
        return []
    below = lambda at: [f.path for f in store.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.Directory]
    return sorted(folder for task in below(place) if task.rsplit("/", 1)[-1].startswith(SPREAD) for folder in below(task))


@dataclass
class Files(InputPartition):
    files: list[tuple[str, int]]
    folder: str | None = None

    def found(self, ending: str) -> list[tuple[str, int]]:
        return self.files if self.folder is None else listed(self.folder, ending)


class SpreadReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.ending = options["path"], options.get("ending", "")

    def partitions(self) -> list[InputPartition]:
        return [Files([], folder) for folder in spread_folders(self.path)] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.binary()))], ["path", "length", "content"])
        rows, size = [], 0
        for path, _ in partition.found(self.ending):
            with store.open_input_stream(path) as f:
                content = f.read()
            rows.append((path, len(content), content))
            size += len(content)
            if size >= BATCH or len(rows) >= ROWS:
                yield made(rows)
                rows, size = [], 0
        if rows:
            yield made(rows)


class SpreadFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "spread_files"

    def schema(self) -> str:
        return "path string, length long, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return SpreadReader({**self.options})


class PdfReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.most_pages, self.most_bytes = int(options.get("max_pages", 200)), int(float(options.get("most_mb", 50)) * (1 << 20))
        self.order, self.limit = options.get("order", "name"), int(options["limit"]) if "limit" in options else None

    def partitions(self) -> list[InputPartition]:
        folders = spread_folders(self.path)
        if folders and self.limit is None:
            return [Files([], folder) for folder in folders]
        key = lambda f: (f[1] if self.order == "size" else 0, f[0].rsplit("/", 1)[-1], f[0])
        files = heapq.nsmallest(self.limit, (f for folder in folders for f in listed(folder, ".pdf")), key) if folders else listed(self.path, ".pdf", self.order, self.limit)
        out, size = [], TASK
        for file in files:
            if size + file[1] > TASK or len(out[-1].files) >= MOST:
                out.append(Files([]))
                size = 0
            out[-1].files.append(file)
            size += file[1]
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = opened(self.path)
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string())
        names = ["path", "page_no", "total_pages", "text", "meta", "error"]
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
        rows, held = [], 0
        for path, size in partition.found(".pdf"):
            try:
                if size > self.most_bytes:
                    raise ValueError(f"{size} bytes are too many")
                with store.open_input_stream(path) as f:
                    texts, meta = read_pdf(f.read(), self.most_pages)
                rows += [(path, i, len(texts), t, [*meta.items()], None) for i, t in enumerate(texts, 1)]
                held += sum(map(len, texts))
            except Exception as e:  # noqa: BLE001  a bad file is a row
                rows.append((path, None, None, None, None, f"{type(e).__name__}: {e}"))
            if held >= BATCH or len(rows) >= ROWS:
                yield made(rows)
                rows, held = [], 0
        if rows:
            yield made(rows)


class PdfPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: StructType) -> DataSourceReader:
        return PdfReader({**self.options})


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


class FileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        if {"name", "content"} - {*schema.names}:
            raise ValueError("row_files needs the columns name and content")
        self.path, self.overwrite, self.run = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        self.spread = options.get("spread", "false").lower() == "true"
        # tasks make their folders in this one only while it is there: after an abort a task that still runs cannot begin
        opened(self.path)[0].create_dir(self.staging)

    @property
    def staging(self) -> str:
        return f"{opened(self.path)[1]}/_staging/{self.run}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, _ = opened(self.path)
        context = TaskContext.get()
        folder = f"{self.staging}/{context.partitionId()}-{context.taskAttemptId()}"
        names, at, count, size = [], folder, 0, 0
        # values are taken out of a batch one by one: no second copy of its contents as Python objects
        for name, content in ((n.as_py(), c.as_py()) for batch in iterator for n, c in zip(batch.column("name"), batch.column("content"))):
            if not name or content is None or "/" in name or name.startswith((".", "_")):
                raise ValueError(f"no file can be made of the name {name!r} and {'no' if content is None else 'its'} content")
            content = content.encode() if isinstance(content, str) else bytes(content)
            if not count:
                store.create_dir(folder, recursive=False)
            if self.spread and (not count or count % MOST == 0 or size + len(content) > TASK):
                at, size = f"{folder}/{count:012d}", 0
                store.create_dir(at, recursive=False)
            with store.open_output_stream(f"{at}/{name}") as f:
                f.write(content)
            count, size = count + 1, size + len(content)
            if not self.spread:
                names.append(name)
        return Written(folder, names) if count else Written("", [])

    def commit(self, messages: list[Written | None]) -> None:
        store, place = opened(self.path)
        store.create_dir(place)
        kept = {n for m in messages if m for n in m.names}
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(place)):
                if f.type == fs.FileType.File and f.base_name not in kept:
                    store.delete_file(f.path)
                elif f.type == fs.FileType.Directory and f.base_name.startswith(SPREAD):
                    store.delete_dir(f.path)
        if self.spread:
            for m in filter(lambda m: m and m.folder, messages):
                store.move(m.folder, f"{place}/{SPREAD}{self.run}-{m.folder.rsplit('/', 1)[-1]}")
        with ThreadPoolExecutor(MOVES) as pool:
            for m in filter(None, messages):  # a task's files at a time, so that what waits is bounded
                for _ in pool.map(lambda n, folder=m.folder: store.move(f"{folder}/{n}", f"{place}/{n}"), dict.fromkeys(m.names)):
                    pass
        self._clear(store, place)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, store: fs.FileSystem, place: str) -> None:
        """Removes what is staged; again if a task that is being stopped adds a file meanwhile."""
        root = f"{place}/_staging"
        for _ in range(50):
            try:
                if store.get_file_info(self.staging).type != fs.FileType.NotFound:
                    store.delete_dir(self.staging)
                if not store.get_file_info(fs.FileSelector(root, allow_not_found=True)) and store.get_file_info(root).type != fs.FileType.NotFound:
                    store.delete_dir(root)
                return
            except OSError:
                time.sleep(0.1)


class RowFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "row_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter({**self.options}, schema, overwrite)


def register(spark: SparkSession) -> None:
    for source in (PdfPages, RowFiles, SpreadFiles):
        spark.dataSource.register(source)
