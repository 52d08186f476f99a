"""Tables that change in whole commits: folders of files, and one small file that names
those that count.  A commit that never ended leaves no trace; of two at once one fails."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Ledger:
    """The commits under ``path``, each a JSON object with its ``version``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def versions(self) -> list[int]:
        fs, at = self.fs(f"{self.path}/manifest")
        return sorted((int(s.getPath().getName()[1:-5]) for s in fs.listStatus(at)), reverse=True) if fs.exists(at) else []

    def latest(self) -> dict | None:
        """The newest whole commit."""
        for v in self.versions():
            fs, at = self.fs(f"{self.path}/manifest/v{v:012d}.json")
            stream = fs.open(at)
            try:
                return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            except ValueError:
                continue  # being written
            finally:
                stream.close()
        return None

    def commit(self, entry: dict) -> None:
        """Makes ``entry`` the newest; an error if its version is taken."""
        fs, at = self.fs(f"{self.path}/manifest/v{entry['version']:012d}.json")
        out = fs.create(at, False)
        out.write(json.dumps(entry).encode())
        out.close()

    def sweep(self, kinds: list[str], kept: set[str]) -> None:
        """Deletes the folders <kind>/<name> that are not among ``kept``."""
        for kind in kinds:
            fs, at = self.fs(f"{self.path}/{kind}")
            for s in fs.listStatus(at) if fs.exists(at) else []:
                if f"{kind}/{s.getPath().getName()}" not in kept:
                    fs.delete(s.getPath(), True)
