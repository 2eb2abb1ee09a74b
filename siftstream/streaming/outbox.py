"""A sink that delivers each batch once and keeps a cursor.

    spark.dataSource.register(Outbox)
    posts.writeStream.format("outbox").option("cursor", "ms").option("checkpointLocation", ...).start(path)

Tasks write their rows to files of their own; a batch is delivered by the one file that its commit adds, which names those
files and the largest cursor so far. Files that no commit names (of failed tasks, or of a batch that failed half way) do not
count, and a batch that is committed again changes nothing. Nothing is swallowed: a failure fails the batch, which the
checkpoint then repeats.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage


def _local(path: str) -> str:
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path


def _system(path: str):
    """A file system and the path in it: this machine's for plain and file: paths, pyarrow's for other URIs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path and not path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(_local(path)))


@dataclass
class Staged(WriterCommitMessage):
    file: str
    rows: int
    cursor: object


class Outbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "outbox"

    def streamWriter(self, schema, overwrite):
        return OutboxWriter(self.options, schema)


class OutboxWriter(DataSourceStreamWriter):
    def __init__(self, options, schema):
        self.path, self.cursor, self.names = options["path"], options.get("cursor", ""), schema.names

    def write(self, iterator):
        system, root = _system(self.path)
        name, rows, cursor = f"staged/{uuid.uuid4().hex}.json", [], None
        system.create_dir(f"{root}/staged", recursive=True)
        n = 0
        with system.open_output_stream(f"{root}/{name}") as out:
            for row in iterator:
                values = dict(zip(self.names, row))
                out.write(json.dumps(values, default=str, ensure_ascii=False).encode() + b"\n")
                n += 1
                at = values.get(self.cursor)
                cursor = at if cursor is None or (at is not None and at > cursor) else cursor
        return Staged(name, n, cursor)

    def commit(self, messages, batchId):
        system, root = _system(self.path)
        system.create_dir(f"{root}/commits", recursive=True)
        target = f"{root}/commits/{batchId:012d}.json"
        if system.get_file_info(target).is_file:
            return
        known = [c for c in (cursor(self.path), *(m.cursor for m in messages if m)) if c is not None]
        body = {"batch": batchId, "files": [m.file for m in messages if m and m.rows], "rows": sum(m.rows for m in messages if m), "cursor": max(known, default=None)}
        part = f"{root}/commits/.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as out:
            out.write(json.dumps(body, default=str).encode())
        system.move(part, target)

    def abort(self, messages, batchId):
        """What tasks have staged stays without a commit, so it was never delivered."""


def commits(path: str) -> list[dict]:
    """What was committed, batch by batch: batch, files, rows, cursor."""
    from pyarrow import fs

    system, root = _system(path)
    if not system.get_file_info(f"{root}/commits").type == fs.FileType.Directory:
        return []
    out = []
    for info in sorted(system.get_file_info(fs.FileSelector(f"{root}/commits")), key=lambda x: x.path):
        if not os.path.basename(info.path).startswith("."):
            with system.open_input_file(info.path) as f:
                out.append(json.loads(f.read()))
    return out


def cursor(path: str):
    """The cursor of the last commit: where a reader that polls goes on."""
    last = commits(path)[-1:]
    return last[0]["cursor"] if last else None


def delivered_rows(spark: SparkSession, path: str, schema, after: int = -1) -> DataFrame:
    """The rows of all committed batches later than ``after``."""
    files = [f"{path.rstrip('/')}/{f}" for c in commits(path) if c["batch"] > after for f in c["files"]]
    return spark.read.schema(schema).json(files) if files else spark.createDataFrame([], schema)
