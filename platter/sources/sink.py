"""`discimage`: a batch sink that writes one file a row, under a new name and then its own.

    spark.dataSource.register(DiscImageSource)
    df.select("path", "content").write.format("discimage").mode("append").save(folder)

Existing files are kept: a row whose file is there already fails the write
unless the option `overwrite` is true.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class _Written(WriterCommitMessage):
    pairs: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool):
        self.folder, self.overwrite = folder, overwrite

    def write(self, rows: Iterator) -> _Written:
        pairs = []
        for row in rows:
            target = os.path.normpath(os.path.join(self.folder, row.path))
            if not target.startswith(os.path.normpath(self.folder) + os.sep):
                raise ValueError(f"{row.path!r} leads out of the folder")
            if os.path.exists(target) and not self.overwrite:
                raise ValueError(f"{target} is there already")
            os.makedirs(os.path.dirname(target), exist_ok=True)
            part = f"{target}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(bytes(row.content))
            pairs.append((part, target))
        return _Written(pairs)

    def commit(self, messages: list) -> None:
        for m in messages:
            for part, target in m.pairs if m else []:
                os.replace(part, target)

    def abort(self, messages: list) -> None:
        for m in messages:
            for part, _ in m.pairs if m else []:
                if os.path.exists(part):
                    os.remove(part)


class DiscImageSource(DataSource):
    """The folder must be one that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "discimage"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("overwrite", "false").lower() == "true")
