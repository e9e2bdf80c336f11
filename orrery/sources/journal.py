"""A folder of Parquet files that counts in numbered commits, on any store that Arrow reaches by its URI.

    data/     files that tasks have written, each under a name of its own
    commits/  00000001.json, ...: what a commit adds, and who has made it

What no commit names doesn't exist for readers: tasks stage files, and one small file, moved to its place,
makes all of them count at once. One driver writes a journal at a time; readers need no lock.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs


class Journal:
    def __init__(self, path: str) -> None:
        self.path = path
        self.fs, self.root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
        self.root = self.root.rstrip("/")

    def at(self, folder: str, name: str) -> str:
        return f"{self.root}/{folder}/{name}"

    def last(self) -> int:
        """The number of the last commit; 0 if there is none."""
        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/commits", allow_not_found=True))
        return max((int(x.base_name.removesuffix(".json")) for x in found if x.base_name.endswith(".json")), default=0)

    def commit_of(self, number: int) -> dict[str, Any]:
        with self.fs.open_input_stream(self.at("commits", f"{number:08d}.json")) as f:
            return json.loads(f.read())

    def commits(self, after: int, upto: int) -> Iterator[dict[str, Any]]:
        return (self.commit_of(n) for n in range(after + 1, upto + 1))

    def commit(self, number: int, entry: dict[str, Any]) -> None:
        """Makes what the entry names count; FileExistsError if another has made this commit."""
        to = self.at("commits", f"{number:08d}.json")
        if self.fs.get_file_info(to).type != fs.FileType.NotFound:
            raise FileExistsError(to)
        self.fs.create_dir(f"{self.root}/commits", recursive=True)
        staged = self.at("commits", f"{uuid.uuid4().hex}.staged")
        with self.fs.open_output_stream(staged) as f:
            f.write(json.dumps(entry).encode())
        self.fs.move(staged, to)

    def stage(self, batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> tuple[str, int]:
        """Writes rows to a file of their own, as they come: its name and how many they were."""
        self.fs.create_dir(f"{self.root}/data", recursive=True)
        name, rows = f"{uuid.uuid4().hex}.parquet", 0
        with pq.ParquetWriter(self.at("data", name), schema, filesystem=self.fs) as out:
            for batch in batches:
                out.write_batch(batch.cast(schema))
                rows += batch.num_rows
        return name, rows

    def discard(self, names: Iterable[str]) -> None:
        for name in names:
            if self.fs.get_file_info(self.at("data", name)).type != fs.FileType.NotFound:
                self.fs.delete_file(self.at("data", name))
