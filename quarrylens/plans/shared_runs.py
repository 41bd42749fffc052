"""Run folders on any file system that Spark reaches, by URI: written aside and renamed; history, hashes and rankings as frames."""

from __future__ import annotations

import datetime as dt
import hashlib
from pathlib import PurePosixPath

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ProfileConfig
from ..operators import ranking
from . import artifacts

#: Folders with this beginning are runs that are being written, or were when their driver was lost; Spark's readers pass them by.
STAGED = ".staged-"
_META = "run_id string, dataset_name string, created_at_utc string, row_count long, column_count long, _corrupt_record string"
_MANIFEST = "file_count long, files array<struct<relative_path: string, size_bytes: long, sha256: string>>, _corrupt_record string"


class _Store:
    """Files under a URI, by Hadoop's file systems."""

    def __init__(self, spark: SparkSession, uri: str):
        self.jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.base = self.jvm.org.apache.hadoop.fs.Path(uri)
        self.fs = self.base.getFileSystem(conf)
        self.base = self.fs.makeQualified(self.base)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.base.toUri(), conf)
        self.no_options = spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.base, name)

    def folder(self, name: str) -> None:
        self.fs.mkdirs(self.at(name))

    def write(self, name: str, content: bytes) -> None:
        out = self.fs.create(self.at(name), False)
        try:
            out.write(bytearray(content))
        finally:
            out.close()

    def renamed(self, name: str, wanted: str) -> bool:
        """Whether a folder got its new name; not if there is one of that name."""
        try:
            self.context.rename(self.at(name), self.at(wanted), self.no_options)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True

    def folders(self) -> list[str]:
        if not self.fs.exists(self.base):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.base) if s.isDirectory() and not s.getPath().getName().startswith((".", "_")))


def export(spark: SparkSession, packet: dict, text: str, config: ProfileConfig, uri: str, **more) -> str:
    """Writes a run's folder under a URI and returns its name. The folder appears under its name only when it is whole; a name that
    is taken gets a number."""
    meta, store, files = artifacts.run_metadata(packet, config), _Store(spark, uri), []
    staged = f"{STAGED}{meta['run_id']}"
    store.folder(staged)
    for name, content in sorted(artifacts.bundle(packet, text, config, meta, **more).items()):
        facts = {"file_name": name, "kind": "directory", "relative_path": name, "created_at_utc": dt.datetime.now(dt.timezone.utc).isoformat(), "size_bytes": 0, "sha256": None}
        if content is None:
            store.folder(f"{staged}/{name}")
        else:
            data = artifacts.as_bytes(name, content)
            store.write(f"{staged}/{name}", data)
            facts |= {"kind": artifacts.KINDS.get(PurePosixPath(name).suffix, "file"), "size_bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}
        files.append(facts)
    store.write(f"{staged}/artifact_manifest.json", artifacts.as_bytes("artifact_manifest.json", {"file_count": len(files), "files": files}))
    stem = f"{dt.datetime.now(dt.timezone.utc):%Y%m%dT%H%M%SZ}_{artifacts.slug(config.dataset_name)}"
    for name in (stem, *(f"{stem}_{i:03d}" for i in range(1, 1000))):
        if store.renamed(staged, name):
            return name
    raise FileExistsError(f"1000 folders are named {stem}")


def _files(spark: SparkSession, uri: str, names: str, form: str = "text") -> DataFrame:
    """The files of some names in all run folders: run, file, and what is in them."""
    reader = spark.read.format(form).option("recursiveFileLookup", True).option("pathGlobFilter", names)
    rows = (reader.option("wholetext", True) if form == "text" else reader).load(uri)
    path = F.col("_metadata.file_path")
    return rows.select(F.regexp_extract(path, "([^/]+)/[^/]+$", 1).alias("run"), F.regexp_extract(path, "([^/]+)$", 1).alias("file"), F.col("value" if form == "text" else "content").alias("content"))


def history(spark: SparkSession, uri: str) -> DataFrame:
    """(run, run_id, dataset_name, created_at_utc, row_count, column_count, artifact_count, status, errors) of each run folder. A run
    whose metadata or manifest is missing or isn't JSON is incomplete. No folder gives no rows."""
    names = _Store(spark, uri).folders()
    if not names:
        return spark.createDataFrame([], "run string, run_id string, dataset_name string, created_at_utc string, row_count long, column_count long, artifact_count long, status string, errors array<string>")
    runs = spark.createDataFrame([(n,) for n in names], "run string")
    found = _files(spark, uri, "{run_metadata,artifact_manifest}.json")
    for file, schema, name in (("run_metadata.json", _META, "m"), ("artifact_manifest.json", _MANIFEST, "f")):
        runs = runs.join(found.where(F.col("file") == file).select("run", F.from_json("content", schema).alias(name)), "run", "left")
    fault = lambda name, file: F.when(F.col(name).isNull(), f"{file}: missing").when(F.col(f"{name}._corrupt_record").isNotNull(), f"{file}: not JSON")
    errors = F.array_compact(F.array(fault("m", "run_metadata.json"), fault("f", "artifact_manifest.json")))
    facts = [F.col(f"m.{c}").alias(c) for c in ("run_id", "dataset_name", "created_at_utc", "row_count", "column_count")]
    return runs.select("run", *facts, F.col("f.file_count").alias("artifact_count"), F.when(F.size(errors) == 0, "available").otherwise("incomplete").alias("status"), errors.alias("errors"))


def file_states(spark: SparkSession, uri: str) -> DataFrame:
    """(run, file, state) of each file of each run against its manifest: same, changed, missing or unlisted. Files are hashed by
    the tasks that read them."""
    listed = _files(spark, uri, "artifact_manifest.json").select("run", F.explode(F.from_json("content", _MANIFEST)["files"]).alias("f")).where(F.col("f.sha256").isNotNull())
    listed = listed.select("run", F.col("f.relative_path").alias("file"), F.col("f.sha256").alias("told"))
    there = _files(spark, uri, "*", "binaryFile").where("file <> 'artifact_manifest.json'").select("run", "file", F.sha2("content", 256).alias("seen"))
    state = F.when(F.col("told").isNull(), "unlisted").when(F.col("seen").isNull(), "missing").when(F.col("told") == F.col("seen"), "same").otherwise("changed")
    return listed.join(there, ["run", "file"], "full_outer").select("run", "file", state.alias("state"))


def rankings(spark: SparkSession, uri: str) -> DataFrame:
    """(run, column, rank, signal_score) of all runs, from their packets."""
    packets = _files(spark, uri, "evidence_packet.json")
    rows = F.from_json("content", "feature_ranking array<struct<column: string, rank: int, signal_score: double>>")["feature_ranking"]
    return packets.select("run", F.explode(rows).alias("r")).select("run", "r.*")


def rank_changes(spark: SparkSession, uri: str, left: str, right: str, top: int = 20) -> DataFrame:
    """(column, left_rank, right_rank, change) of two runs' rankings."""
    of = rankings(spark, uri)
    return ranking.rank_changes(of.where(F.col("run") == left), of.where(F.col("run") == right), top)
