"""A corpus as a tree of files, one a row (B1), by a data source with a writer.

Tasks write below a folder beside the target, each file under a hidden name until it's
complete. When all tasks are done, one rename puts the folder in the target's place;
if one fails, the folder goes and the target stays as it was. Nothing but the number
of files goes through the driver. Paths are those of any store that Arrow's file
systems know.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "category string, file_name string, content binary"


@dataclass
class Written(WriterCommitMessage):
    files: int


def checked(category: str | None, name: str | None) -> str:
    """A file's path below the root; a null category is the root, and one with slashes is
    a path of folders. Names that would lead elsewhere are an error."""
    parts = [*(category.split("/") if category is not None else []), name or ""]
    if any(p in ("", ".", "..") or "/" in p or "\\" in p or "\0" in p for p in parts):
        raise ValueError(f"not a file of the tree: {category!r}, {name!r}")
    return "/".join(parts)


class TreeWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        head, _, tail = self.path.rpartition("/")
        self.staging = f"{head}/_{tail}-{uuid.uuid4().hex}"
        store, at = self._store(self.path)
        if not overwrite and store.get_file_info(at).type != fs.FileType.NotFound:
            raise ValueError(f"{path} is there; mode overwrite replaces it")
        store.create_dir(self._store(self.staging)[1], recursive=True)

    def _store(self, path: str) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(path)

    def write(self, rows: Iterator) -> Written:
        store, root = self._store(self.staging)
        made, n = set(), 0
        for category, name, content in rows:
            at = checked(category, name)
            folder, _, file = f"{root}/{at}".rpartition("/")
            if folder not in made:
                if store.get_file_info(root).type == fs.FileType.NotFound:
                    raise RuntimeError("another task has failed")
                store.create_dir(folder, recursive=True)
                made.add(folder)
            hidden = f"{folder}/.{uuid.uuid4().hex}"
            with store.open_output_stream(hidden) as out:
                out.write(bytes(content or b""))
            store.move(hidden, f"{folder}/{file}")
            n += 1
        return Written(n)

    def commit(self, messages: list[Written | None]) -> None:
        store, old = self._store(self.path)
        new = self._store(self.staging)[1]
        if store.get_file_info(old).type != fs.FileType.NotFound:
            store.delete_dir(old)
        store.move(new, old)

    def abort(self, messages: list[Written | None]) -> None:
        """Without the folder running tasks stop; what one of them was just making goes with
        a second look."""
        store, new = self._store(self.staging)
        for pause in (0.0, 0.5, 1.0, 2.0):
            time.sleep(pause)
            if store.get_file_info(new).type != fs.FileType.NotFound:
                store.delete_dir(new)


class Tree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus_tree"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return TreeWriter(self.options["path"], overwrite)


def save(corpus: DataFrame, folder: str, overwrite: bool = True) -> None:
    """Write (category, file_name, text) or (..., content binary) as <folder>/<category>/<file>
    in UTF-8. Of rows that name one file, one stays; null texts give empty files."""
    corpus.sparkSession.dataSource.register(Tree)
    content = F.col("content") if "content" in corpus.columns else F.encode("text", "UTF-8")
    rows = corpus.select(F.col("category").cast("string"), F.col("file_name").cast("string"), content.alias("content"))
    rows.write.format("corpus_tree").mode("overwrite" if overwrite else "append").option("path", folder).save()
