"""The folder that all executors share: cutting a plan's lineage, and files that are claimed once."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from pathlib import Path
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """df checkpointed under spark.checkpoint.dir; a folder of our own only where Spark runs on one machine and none is set."""
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir", "") and not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-"))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only where all run on one machine."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return (folder or Path(tempfile.gettempdir(), "tessera-shared").as_uri()).rstrip("/")


class Files:
    """Small files and folders of a store that Spark reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.java = spark, spark._jvm
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()

    def _at(self, path: str):
        p = self.java.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def names(self, folder: str) -> list[str]:
        p, fs = self._at(folder)
        return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []

    def children(self, folder: str) -> list[tuple[str, bool]]:
        """(path, whether it is a folder) of what lies in a folder."""
        p, fs = self._at(folder)
        return sorted((x.getPath().toString(), x.isDirectory()) for x in fs.listStatus(p))

    def text(self, path: str) -> str:
        p, fs = self._at(path)
        stream = fs.open(p)
        try:
            return self.java.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def remove(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def claim(self, path: str, text: str) -> bool:
        """Make the file with all of `text` at once; False, and no change, if there is one.

        The text is written aside. On local disks a hard link gives it the name, which fails where
        the name is taken; elsewhere a rename without overwriting, atomic on file systems like HDFS.
        """
        aside, fs = self._at(f"{path}.{uuid.uuid4().hex}")
        fs.mkdirs(aside.getParent())
        stream = fs.create(aside, False)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        try:
            if fs.getUri().getScheme() == "file":
                local = lambda x: unquote(urlparse(x.toUri().toString()).path)
                os.link(local(aside), local(self._at(path)[0]))
                return True
            rename = self.java.org.apache.hadoop.fs.Options.Rename
            how = self.spark.sparkContext._gateway.new_array(rename, 1)
            how[0] = rename.NONE
            self.java.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.conf).rename(aside, self._at(path)[0], how)
            return True
        except FileExistsError:
            return False
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        finally:
            fs.delete(aside, False)


class Conflict(RuntimeError):
    """Another commit has made the revision that this one was to make."""


class Manifests:
    """Revisions of a store: each a small JSON file, made whole or not at all, and by one writer only."""

    def __init__(self, spark: SparkSession, root: str):
        self.files, self.folder = Files(spark), f"{root.rstrip('/')}/_revisions"

    def latest(self) -> dict:
        """The newest manifest; of revision 0 before any."""
        names = [n for n in self.files.names(self.folder) if n.endswith(".json")]
        return json.loads(self.files.text(f"{self.folder}/{names[-1]}")) if names else {"revision": 0}

    def at(self, revision: int) -> dict:
        return json.loads(self.files.text(f"{self.folder}/{revision:012d}.json")) if revision else {"revision": 0}

    def publish(self, manifest: dict) -> None:
        if not self.files.claim(f"{self.folder}/{manifest['revision']:012d}.json", json.dumps(manifest)):
            raise Conflict(f"revision {manifest['revision']} is taken")
