"""From files to a reviewed starting point: extract, classify, assemble, coach, publish.

An import is a set of sources that make one draft. Many imports are assembled in
parallel, one group each; a published import is a folder that appears complete or
not at all.
"""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import assemble, classify, coaching, integrity
from ..sources import reader

UNUSABLE = ("needs_dependency", "unsupported", "error")
LEDGER = "import_id string, profile string, claims string, remaining string, conflicts string, segments int, accounted int, unclassified int, error string"


def languages(blocks: DataFrame) -> DataFrame:
    """The language of each import, by the letters of all its text."""
    counts = blocks.groupBy("import_id").agg(F.sum(F.regexp_count("text", F.lit(r"[\x{4e00}-\x{9fff}]"))).alias("cjk"), F.sum(F.regexp_count("text", F.lit("[A-Za-z]"))).alias("latin"))
    return counts.select("import_id", F.when((F.col("cjk") > 0) & (F.col("cjk") >= F.col("latin") / 3), "zh").otherwise("en").alias("language"))


def _part(source_id: str, frame: pd.DataFrame, language: str) -> tuple:
    warnings = list(frame["warnings"].iloc[0] if frame["warnings"].iloc[0] is not None else [])
    blocks = classify._blocks(frame.to_dict("records"))
    details = json.loads(frame["details"].iloc[0] or "{}")
    if given := details.get("structured_profile"):
        lines = [x for b in blocks for x in classify.split_lines(b["block_id"], b["text"], b["locator"], b["links"])]
        return source_id, *assemble.structured(given, lines, language)
    return assemble.part(source_id, classify.organize(blocks, language, warnings))


def ledgers(blocks: DataFrame, role: str | None = None) -> DataFrame:
    """One ledger per import, its parts as JSON text. ``blocks`` are the reader's rows with import_id and language."""
    names = [x.split()[0] for x in LEDGER.split(", ")]

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        dump = lambda x: json.dumps(x, ensure_ascii=False)
        try:
            parts = [_part(s, own, frame["language"].iloc[0]) for s, own in frame.sort_values(["path", "seq"]).groupby("source_id", sort=False)]
            done = assemble.assemble(parts, frame["language"].iloc[0], role)
            row = (key[0], dump(done.profile), dump(done.claims), dump(done.remaining), dump(done.conflicts), sum(len(p[2]) for p in parts), len(done.claims), len(done.remaining), None)
        except ValueError as error:
            row = (key[0], *[None] * 4, 0, 0, 0, str(error))
        return pd.DataFrame([row], columns=names)

    return blocks.filter("seq is not null").groupBy("import_id").applyInPandas(run, LEDGER)


def claims_of(found: DataFrame) -> DataFrame:
    """Ledgers' claims as rows."""
    schema = "array<struct<id:string,source_id:string,text:string,block_id:string,resume_paths:array<string>,status:string,interpretation:string,needs_review:boolean>>"
    return found.select("import_id", F.explode(F.from_json("claims", schema)).alias("c")).select("import_id", F.col("c.id").alias("claim_id"), *[f"c.{k}" for k in ("source_id", "text", "block_id", "resume_paths", "status", "interpretation", "needs_review")])


def bullets_of(found: DataFrame) -> DataFrame:
    """Drafts' bullets as the coaching rules take them."""
    entry = "struct<heading:string,date:string,bullets:array<string>>"
    profile = F.from_json("profile", f"struct<sections:array<struct<id:string,entries:array<{entry}>>>>")
    sections = found.select(F.col("import_id").alias("doc_id"), F.posexplode(profile["sections"]).alias("section", "s"))
    entries = sections.select("doc_id", "section", F.col("s.id").alias("section_id"), F.posexplode("s.entries").alias("entry", "e"))
    return entries.select("doc_id", "section_id", "section", "entry", F.posexplode("e.bullets").alias("bullet", "text"), "e.heading", "e.date")


def start(found: DataFrame, warnings: DataFrame, role: str | None = None, target: str | None = None) -> dict[str, DataFrame]:
    """Improvements, stories and directions of all imports; ``warnings`` has import_id and an array."""
    doubt = T.found(F.array_join("warnings", " "), coaching.V.SOURCE_DOUBT) | (F.col("conflicts") != "[]") | (F.col("remaining") != "[]")
    reports = found.join(warnings, "import_id", "left").select(F.col("import_id").alias("doc_id"), F.lit(role).cast("string").alias("role"), F.lit(None).cast("string").alias("requested_target"), F.lit(target).cast("string").alias("target"), F.coalesce(doubt, F.lit(False)).alias("doubtful"))
    bullets, claims = bullets_of(found), claims_of(found).withColumnRenamed("import_id", "doc_id")
    return {"improvements": coaching.improvements(bullets, claims, reports), "stories": coaching.stories(bullets, claims), "directions": coaching.directions(bullets, claims, reports)}


class Folder:
    """A folder on the file system that the driver and the executors share, by Hadoop's own calls."""

    def __init__(self, spark: SparkSession, path: str):
        self.at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def is_free(self) -> bool:
        """Not there, or an empty folder and no link."""
        if not self.fs.exists(self.at):
            return True
        return self.fs.getFileStatus(self.at).isDirectory() and not self.fs.listStatus(self.at) and not (self.fs.supportsSymlinks() and self.fs.getFileLinkStatus(self.at).isSymlink())

    def delete(self) -> None:
        self.fs.delete(self.at, True)

    def move_to(self, other: Folder) -> None:
        if not self.fs.rename(self.at, other.at):
            raise OSError(f"{self.at} could not be moved to {other.at}")


def import_sources(spark: SparkSession, paths: list[str], out: str, language: str | None = None, role: str | None = None, target: str | None = None, most_sources: int = 10) -> None:
    """Imports files as one draft into a new folder. Sources that can't be used, or that change meanwhile, stop it; nothing is published then.

    ``out`` is a path on a file system that the driver and the executors share. All is written
    to a folder beside it, which takes its name when it is complete.
    """
    if not 1 <= len(paths) <= most_sources or len(set(paths)) < len(paths):
        raise ValueError(f"from 1 to {most_sources} different sources")
    home = Folder(spark, out.rstrip("/"))
    if not home.is_free():
        raise ValueError("the output folder must be new or empty")
    blocks = reader.read_files(spark, paths).withColumn("import_id", F.lit("import")).cache()
    staged = Folder(spark, f"{out.rstrip('/')}.staged-{uuid.uuid4().hex}")
    try:
        if bad := blocks.filter(F.col("status").isin(*UNUSABLE)).select("path", "status", "warnings").limit(5).collect():
            raise ValueError("; ".join(f"{r.path}: {r.status} {r.warnings}" for r in bad))
        if integrity.duplicate_ids(blocks.filter("seq is not null"), "source_id", "block_id").limit(1).count():
            raise ValueError("a block id occurs twice in a source")
        spoken = languages(blocks.filter("text is not null")) if language is None else blocks.select("import_id", F.lit(language).alias("language")).distinct()
        found = ledgers(blocks.join(spoken, "import_id"), role)
        warned = blocks.groupBy("import_id").agg(F.array_distinct(F.flatten(F.collect_list("warnings"))).alias("warnings"))
        write = lambda name, table: table.write.parquet(f"{staged.at}/{name}")
        write("ledger", found)
        found = spark.read.parquet(f"{staged.at}/ledger")  # the parts that follow read what was written
        if wrong := found.filter("error is not null or segments <> accounted").select("error").limit(1).collect():
            raise ValueError(wrong[0].error or "claims and segments differ in number")
        for name, table in ({"blocks": blocks, "claims": claims_of(found)} | start(found, warned, role, target)).items():
            write(name, table)
        if changed := integrity.stale(digests(blocks), digests(reader.read_files(spark, paths)), "path", "sha256").limit(5).collect():
            raise ValueError("; ".join(f"{r.path}: {r.state} during the import" for r in changed))
        home.delete()
        staged.move_to(home)
    except BaseException:
        staged.delete()
        raise
    finally:
        blocks.unpersist()


def digests(blocks: DataFrame) -> DataFrame:
    """Name and SHA-256 of each source, to compare with a later state by ``integrity.stale``."""
    return blocks.select("path", "sha256").distinct()


