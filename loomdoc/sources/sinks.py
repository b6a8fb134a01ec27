"""Documents as files: text parts by converter, or one file a document through the shared folder."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdoc.functions.meta import envelope


def write_json(df: DataFrame, path: str) -> None:
    """JSON envelopes, one a line, in folders by converter."""
    df.select(F.to_json(F.struct("frontmatter", "content", "source", "converter"), {"ignoreNullFields": "false"}).alias("value"), "converter").write.mode("overwrite").partitionBy("converter").text(path)


def write_files(df: DataFrame, folder: str, name: str, content: str, *, mounted: bool = False) -> None:
    """One UTF-8 file a row, written by the executors into a folder that all of them share.

    ``folder`` is a URI of a file system that Arrow knows (``hdfs:``, ``s3:``, ``gs:``).  A path of the local file system is
    taken on one machine only, or with ``mounted`` where it is one mount on all of them: else each executor would
    fill a folder of its own.  Rows with a null name are left out; a null content is an empty file.
    """
    local = folder.startswith("file:") or ":" not in folder
    if local and not mounted and not df.sparkSession.sparkContext.master.startswith("local"):
        raise ValueError(f"{folder} is a folder of each machine: give one that the executors share, or mounted=True")
    uri = folder if not local or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"

    def put(rows) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        for r in rows:
            at = f"{root}/{r[0]}"
            store.create_dir(at.rpartition("/")[0], recursive=True)
            with store.open_output_stream(at) as f:
                f.write((r[1] or "").encode())

    df.where(F.col(name).isNotNull()).select(name, content).foreachPartition(put)


__all__ = ["envelope", "write_files", "write_json"]
