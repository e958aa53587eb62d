"""A log of small entries that several drivers append to, in one order that no clock decides.

An entry is a file of its own whose name is its number, the commit.  It is written beside the log and renamed to the next
free number; renaming never replaces a file, so of two drivers that want the same number one has to take the next.  That
needs a file system whose rename is atomic (HDFS and local ones are).  Numbers have no gaps.

Every ``every`` commits the entries so far are summed up in a snapshot: per key its first and its newest entry.  Readers
take the newest snapshot and the entries after it, so what they read does not grow with the number of entries.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class CommitLog:
    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, every: int = 500):
        """``schema`` has ``key`` and ``seq bigint``, which the log fills in."""
        self.spark, self.root, self.schema, self.key, self.every = spark, root.rstrip("/"), schema, key, every

    # ---------------------------------------------------------------- files, from the driver: a few names at a time

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *names]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self, *folder: str) -> list[str]:
        files, path = self._files(), self._path(*folder)
        if not files.exists(path):
            return []
        return sorted(s.getPath().getName() for s in files.listStatus(path) if not s.getPath().getName().startswith((".", "_")))

    def _block(self, commit: int) -> str:
        return f"{(commit - 1) // self.every:012d}"

    def last(self) -> int:
        """The newest commit; 0 if there is none."""
        for block in reversed(self._names("log")):
            if names := self._names("log", block):
                return int(names[-1].split(".")[0])
        return 0

    def _renamed(self, source, target) -> bool:
        """Rename to a name that nothing has; False if something has it."""
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(self._files().makeQualified(source), self._files().makeQualified(target), options)
        except Py4JJavaError as problem:
            if "FileAlreadyExistsException" in str(problem.java_exception):
                return False
            raise
        return True

    # ---------------------------------------------------------------- entries

    def append(self, entry: dict) -> int:
        """Add an entry; returns its commit."""
        files = self._files()
        while True:
            commit = self.last() + 1
            waiting = self._path("waiting", uuid.uuid4().hex)
            stream = files.create(waiting, False)
            stream.write(bytearray((json.dumps(entry | {"seq": commit}, ensure_ascii=False) + "\n").encode()))
            stream.close()
            files.mkdirs(self._path("log", self._block(commit)))
            if self._renamed(waiting, self._path("log", self._block(commit), f"{commit:020d}.json")):
                break
            files.delete(waiting, False)
        if commit % self.every == 0:
            self._snapshot(commit)
        return commit

    def _snapshot(self, commit: int) -> None:
        seq = F.col("seq")
        entry = F.struct(*[c.split()[0] for c in self.schema.split(", ") if c.split()[0] != self.key])
        found = self.read(commit).groupBy(self.key).agg(F.min_by(entry, seq).alias("a"), F.max_by(entry, seq).alias("b"))
        both = F.when(F.col("a.seq") == F.col("b.seq"), F.array("a")).otherwise(F.array("a", "b"))
        rows = found.select(self.key, F.inline(both))
        waiting = f"waiting/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{waiting}")
        self._files().mkdirs(self._path("snapshots"))
        self._renamed(self._path(waiting), self._path("snapshots", f"{commit:020d}"))

    def read(self, upto: int | None = None) -> DataFrame:
        """Entries enough for the first and the newest state of every key, as of a commit."""
        upto = self.last() if upto is None else upto
        before = [n for n in self._names("snapshots") if int(n) <= upto]
        start = int(before[-1]) if before else 0
        columns = [c.split()[0] for c in self.schema.split(", ")]
        blocks = [f"{self.root}/log/{b}" for b in self._names("log") if self._block(start + 1) <= b <= self._block(max(1, upto))]
        rows = None
        if blocks and upto > start:
            rows = self.spark.read.schema(self.schema).json(blocks).filter(F.col("seq").between(start + 1, upto))
        if before:
            kept = self.spark.read.parquet(f"{self.root}/snapshots/{before[-1]}").select(*columns)
            rows = kept if rows is None else kept.unionAll(rows.select(*columns))
        return self.spark.createDataFrame([], self.schema) if rows is None else rows
