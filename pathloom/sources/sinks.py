"""Writers: links over a confidence, a versioned artifact store, JSON lines of metrics, schema maps."""

from __future__ import annotations

import fcntl
import hashlib
import json
import os
import threading
import uuid
from dataclasses import dataclass
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CorruptArtifactError, NewerArtifactError, RevisionConflictError

LINK_CONFIDENCE = 0.8


class LinkWriter(Protocol):
    def write_links(self, links: DataFrame) -> None: ...


def persistable(links: DataFrame, threshold: float = LINK_CONFIDENCE) -> DataFrame:
    """Links (src, rel, dst, confidence, ...) that may be stored: confident, with ends ``collection/key`` and a relation."""
    end = r"^[^/]+/.+$"
    return links.filter((F.col("confidence") >= threshold) & F.col("src").rlike(end) & F.col("dst").rlike(end) & (F.trim("rel") != ""))


class ParquetLinkWriter:
    def __init__(self, path: str, threshold: float = LINK_CONFIDENCE):
        self.path, self.threshold = path, threshold

    def write_links(self, links: DataFrame) -> None:
        persistable(links, self.threshold).write.mode("append").parquet(self.path)


class ArtifactStore:
    """One JSON document a key, with a revision; saving needs the revision that was read.

    Files are replaced whole, under a lock file of the folder, which every driver that shares it respects.
    """

    VERSION = "1.0"

    def __init__(self, folder: str):
        self.folder = Path(folder)
        self.lock = threading.Lock()

    def _path(self, key: str) -> Path:
        return self.folder / f"{hashlib.sha256(key.encode()).hexdigest()}.json"

    def load(self, key: str) -> tuple[dict, str] | None:
        """The document and its revision."""
        try:
            text = self._path(key).read_text(encoding="utf-8")
        except FileNotFoundError:
            return None
        try:
            held = json.loads(text)
            document, version = held["document"], held["version"]
        except (ValueError, KeyError, TypeError) as e:
            raise CorruptArtifactError(f"artifact {key!r} isn't valid") from e
        if is_older(self.VERSION, version):
            raise NewerArtifactError(f"artifact {key!r} has version {version}")
        return document, hashlib.sha256(text.encode()).hexdigest()

    def save(self, key: str, document: dict, expected: str | None = None) -> str:
        """The new revision. ``expected``: None to insert, else the revision to replace."""
        text = json.dumps({"version": self.VERSION, "document": document}, sort_keys=True, allow_nan=False)
        self.folder.mkdir(parents=True, exist_ok=True)
        with self.lock, open(self._path(key).with_suffix(".lock"), "w") as guard:
            fcntl.flock(guard, fcntl.LOCK_EX)
            held = self.load(key)
            if (held[1] if held else None) != expected:
                raise RevisionConflictError(f"artifact {key!r} was saved by another writer")
            new = self._path(key).with_suffix(f".{uuid.uuid4().hex}")
            new.write_text(text, encoding="utf-8")
            os.replace(new, self._path(key))
        return hashlib.sha256(text.encode()).hexdigest()


def is_older(a: str, b: str) -> bool:
    """Whether dotted version ``a`` comes before ``b``; trailing zeros don't matter."""

    def parts(v: str) -> list[int]:
        out = [int(x) for x in v.split(".")]
        while out and not out[-1]:
            out.pop()
        return out

    return parts(a) < parts(b)


class MetricsLog:
    """JSON lines, appended under a lock that other processes respect too."""

    def __init__(self, path: str):
        self.path, self.lock = path, threading.Lock()

    def log(self, **values) -> None:
        with self.lock, open(self.path, "a", encoding="utf-8") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            f.write(json.dumps(values, sort_keys=True, default=str) + "\n")


def write_schema(tables: dict[str, DataFrame], path: str | None = None) -> dict:
    """Columns and types of tables; as a JSON file too, if a path is given."""
    found = {name: dict(df.dtypes) for name, df in tables.items()}
    if path:
        Path(path).write_text(json.dumps(found, indent=2, sort_keys=True), encoding="utf-8")
    return found


def read_triples_tsv(spark, path: str) -> DataFrame:
    """Facts of a three-column file by tabs; other lines are left out."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("x")).filter(F.size("x") == 3)
    return lines.select(F.trim(F.col("x")[0]).alias("src"), F.trim(F.col("x")[1]).alias("rel"), F.trim(F.col("x")[2]).alias("dst")).filter("src <> '' AND rel <> '' AND dst <> ''")


@dataclass(frozen=True)
class Splits:
    """A link-prediction benchmark: facts to learn from, to stop by, and to be judged by."""

    train: DataFrame
    valid: DataFrame
    test: DataFrame

    def every(self) -> DataFrame:
        return self.train.unionByName(self.valid).unionByName(self.test).distinct()

    def sizes(self) -> DataFrame:
        """One row: facts of each split, distinct entities and relations of all."""
        named = [df.agg(F.count("*").alias(n)) for n, df in (("train", self.train), ("valid", self.valid), ("test", self.test))]
        every = self.every()
        named.append(every.select("rel", F.explode(F.array("src", "dst")).alias("e")).agg(F.count_distinct("e").alias("entities"), F.count_distinct("rel").alias("relations")))
        out = named[0]
        for df in named[1:]:
            out = out.join(F.broadcast(df))  # one row each
        return out

    def graph(self):
        """Nodes and edges of the facts to learn from."""
        from .derived import Graph

        ids = self.train.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        edges = self.train.select(F.sha2(F.concat_ws("\u001f", "src", "rel", "dst"), 256).alias("edge_id"), "src", "rel", "dst", F.lit(1.0).alias("weight"), F.lit(None).cast("timestamp").alias("created_at"))
        return Graph(ids.select("id", F.lit(None).cast("string").alias("type"), F.col("id").alias("label")), edges)


def read_splits(spark, folder: str, names: tuple[str, str, str] = ("train.txt", "valid.txt", "test.txt")) -> Splits:
    """The three files of a benchmark that lies in ``folder``; nothing is downloaded."""
    return Splits(*[read_triples_tsv(spark, f"{folder}/{n}") for n in names])
