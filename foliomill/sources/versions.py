"""Numbered states of a folder of tables.

Tables are written under names of their own and never changed.  A state is a small
file that names the tables of one whole version; a new one appears at once, so a
reader sees either all of a change or none, and a writer that is lost leaves only
tables that no state names.  Two writers that start from one state cannot both
follow it.
"""

from __future__ import annotations

import json
import re
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """The states in ``path``, the newest last."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._folder = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/states")
        self._fs = self._folder.getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._folder)]
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"(\d+)\.json", n)))

    def read(self, number: int | None = None) -> dict[str, Any]:
        """A state, the newest by default; {} before the first."""
        numbers = self.numbers() if number is None else [number]
        if not numbers:
            return {}
        rows = self.spark.read.text(f"{self.path}/states/{numbers[-1]:08d}.json", wholetext=True).collect()
        return json.loads(rows[0].value) | {"number": numbers[-1]}

    def commit(self, state: dict[str, Any]) -> dict[str, Any]:
        """The state that follows the one ``state`` was read from."""
        number = state.get("number", -1) + 1
        to = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/states/{number:08d}.json")
        made = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/states/.{number:08d}.{uuid.uuid4().hex}")
        out = self._fs.create(made, False)
        out.write(json.dumps({k: v for k, v in state.items() if k != "number"}).encode())
        out.close()
        if self._fs.exists(to) or not self._fs.rename(made, to):
            self._fs.delete(made, False)
            raise RuntimeError(f"another writer made state {number} of {self.path}")
        return state | {"number": number}

    def name(self, kind: str) -> str:
        """A name for a new table."""
        return f"{kind}-{uuid.uuid4().hex[:12]}"

    def table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def write(self, df: DataFrame, name: str, by: str | None = None) -> None:
        writer = df.write
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{name}")

    def sweep(self, keep: int = 1) -> list[str]:
        """Delete the tables and states that none of the ``keep`` newest states names; the names that went."""
        numbers = self.numbers()
        held: set[str] = set()
        for n in numbers[-keep:]:
            held |= set(re.findall(r"[a-z]+-[0-9a-f]{12}", json.dumps(self.read(n))))
        gone = []
        for s in self._fs.listStatus(self._jvm.org.apache.hadoop.fs.Path(self.path)):
            name = s.getPath().getName()
            if re.fullmatch(r"[a-z]+-[0-9a-f]{12}", name) and name not in held:
                self._fs.delete(s.getPath(), True)
                gone.append(name)
        for n in numbers[:-keep]:
            self._fs.delete(self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/states/{n:08d}.json"), False)
        return sorted(gone)
