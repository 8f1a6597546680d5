"""What all sources share: files, lines, strictness, and the shape of events."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

USAGE_T = (
    "struct<input:bigint,output:bigint,cache_creation:bigint,cache_creation_5m:bigint,cache_creation_1h:bigint,"
    "cache_read:bigint,thinking:bigint>"
)
TOOLS_T = "array<struct<id:string,name:string,input_bytes:bigint,server:string>>"
#: Fields of an event, their types, and the SQL of what they are unless said otherwise.
EVENT = {
    "kind": ("string", "NULL"), "ts": ("timestamp", "NULL"), "request_id": ("string", "NULL"), "model": ("string", "NULL"),
    "usage": (USAGE_T, "NULL"), "tool_calls": (TOOLS_T, "array()"), "sidechain": ("boolean", "false"), "content_summary": ("string", "NULL"),
    "content_chars": ("bigint", "0"), "thinking_chars": ("bigint", "0"), "has_thinking": ("boolean", "false"), "tool_use_id": ("string", "NULL"),
    "attachment_kind": ("string", "NULL"), "item_count": ("bigint", "0"), "spawn": ("struct<tool_call_id:string,agent_type:string,description:string>", "NULL"),
}
LINES = "file_id string, path string, size_bytes bigint, modified timestamp, line_no int, line string"


def event(**fields: str) -> str:
    """SQL of an event from the SQL of its fields."""
    unknown = fields.keys() - EVENT.keys()
    if unknown:
        raise ValueError(f"no such field: {sorted(unknown)}")
    return "named_struct(" + ", ".join(f"'{k}', CAST({fields.get(k, d)} AS {t})" for k, (t, d) in EVENT.items()) + ")"


def usage(**fields: str) -> str:
    names = [x.split(":")[0] for x in USAGE_T[7:-1].split(",")]
    return "named_struct(" + ", ".join(f"'{n}', CAST({fields.get(n, 'NULL')} AS bigint)" for n in names) + ")"


def kind_of(path: str, v: str = "v") -> str:
    """The JSON type at a path: STRING, BIGINT, OBJECT<...>, ARRAY<...>, VOID for null; NULL where absent."""
    return f"schema_of_variant(try_variant_get({v}, '{path}', 'variant'))"


def text_at(path: str, v: str = "v") -> str:
    """A string; NULL where something else stands."""
    return f"CASE WHEN {kind_of(path, v)} = 'STRING' THEN try_variant_get({v}, '{path}', 'string') END"


def long_at(path: str, v: str = "v") -> str:
    return f"try_variant_get({v}, '{path}', 'bigint')"


def time_at(path: str) -> str:
    return f"try_to_timestamp({text_at(path)})"


def raw_at(path: str) -> str:
    """Compact JSON (a string without its quotes)."""
    return f"get_json_object(line, '{path}')"


def json_size(raw: str, kind: str, unit: str = "octet_length") -> str:
    """How long the compact JSON of a value is; ``raw`` as get_json_object gives it."""
    return f"CASE WHEN {kind} IS NULL THEN 0 WHEN {kind} = 'VOID' THEN 4 WHEN {kind} = 'STRING' THEN {unit}(to_json(array({raw}))) - 2 ELSE {unit}({raw}) END"


def strict(strings: tuple = (), counters: tuple = (), objects: tuple = (), arrays: tuple = (), flags: tuple = (), needed_objects: tuple = ()) -> str:
    """SQL that is true for lines that aren't JSON objects or declare a field of another type.

    Everything may be absent; all but ``flags`` and ``needed_objects`` may be null.
    """
    tests = ["v IS NULL", f"coalesce({kind_of('$')}, '') NOT LIKE 'OBJECT%'"]
    tests += [f"coalesce({kind_of(p)}, 'VOID') NOT IN ('VOID', 'STRING')" for p in strings]
    tests += [f"coalesce({kind_of(p)}, 'VOID') NOT IN ('VOID', 'BIGINT') OR coalesce({long_at(p)}, 0) < 0" for p in counters]
    tests += [f"coalesce({kind_of(p)}, 'VOID') NOT LIKE 'OBJECT%' AND coalesce({kind_of(p)}, 'VOID') <> 'VOID'" for p in objects]
    tests += [f"coalesce({kind_of(p)}, 'VOID') NOT LIKE 'ARRAY%' AND coalesce({kind_of(p)}, 'VOID') <> 'VOID'" for p in arrays]
    tests += [f"coalesce({kind_of(p)}, 'BOOLEAN') <> 'BOOLEAN'" for p in flags]
    tests += [f"coalesce({kind_of(p)}, 'OBJECT') NOT LIKE 'OBJECT%'" for p in needed_objects]
    return " OR ".join(f"({t})" for t in tests)


BLANK = r"(?U)^\s*$"


def links(roots: list[str]) -> list[str]:
    """Symbolic links below local folders; what lies behind them is left out."""
    found = []
    for root in roots:
        for folder, folders, names in os.walk(root.removeprefix("file://")) if "://" not in root or root.startswith("file://") else ():
            found += [p for n in (*folders, *names) if os.path.islink(p := os.path.join(folder, n))]
    return found


def path_of(uri: str) -> Column:
    """A file's path as it is written."""
    return F.expr(f"url_decode(replace({uri}, '+', '%2B'))")


def _files(spark: SparkSession, roots: list[str], glob: str, kind: str, **options: str) -> DataFrame:
    read = spark.read.format(kind).option("recursiveFileLookup", True).option("pathGlobFilter", glob).options(**options)
    return read.load(roots).withColumn("file_id", F.col("_metadata.file_path"))


def read_lines(spark: SparkSession, roots: list[str], glob: str = "*.jsonl") -> DataFrame:
    """The lines of all files under ``roots``, numbered from 0.

    A file is one row until it is split, which keeps its lines' order; so a file may have 2 GB at most, which no
    session log comes near. Any path that Spark reads will do. Files that can't be read are skipped
    here; ``listed`` has them all.
    """
    if not roots:
        return spark.createDataFrame([], LINES)
    files = _files(spark, roots, glob, "text", wholetext="true", ignoreCorruptFiles="true", ignoreMissingFiles="true")
    return split_lines(files.select(
        "file_id", path_of("file_id").alias("path"), F.col("_metadata.file_size").cast("long").alias("size_bytes"),
        F.col("_metadata.file_modification_time").alias("modified"), "value",
    ))


def listed(spark: SparkSession, roots: list[str], glob: str = "*.jsonl") -> DataFrame:
    """``file_id`` and ``path`` of all files under ``roots``, without reading them."""
    if not roots:
        return spark.createDataFrame([], "file_id string, path string")
    return _files(spark, roots, glob, "binaryFile").select("file_id", path_of("file_id").alias("path"))


def split_lines(files: DataFrame) -> DataFrame:
    """From rows of whole files (column ``value``) to rows of lines. A file has one line at least."""
    return files.select("*", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).drop("value")


@dataclass
class Parsed:
    """A source's reading of lines: columns file_id, line_no, skip, tally, events, and others for files."""

    lines: DataFrame
    extra: dict[str, object] = field(default_factory=dict)  # more aggregates for files, by name


FAILED = "file_id string, path string"


@dataclass
class Logs:
    """Normalized logs.

    ``files``: one row per file. ``events``: one row per event, ordered in a file by (line_no, sub_seq).
    ``failed``: files that were found but could not be read. ``held`` is what reading keeps in memory or on disk.
    """

    files: DataFrame
    events: DataFrame
    failed: DataFrame
    held: list[DataFrame] = field(default_factory=list)

    def union(self, other: Logs) -> Logs:
        return Logs(self.files.unionByName(other.files), self.events.unionByName(other.events), self.failed.unionByName(other.failed), self.held + other.held)

    def close(self) -> None:
        """Give back what reading keeps."""
        for df in self.held:
            df.unpersist()

    def tool_calls(self) -> DataFrame:
        """One row per tool call, with the keys of its event."""
        return self.events.select(
            "file_id", "line_no", "sub_seq", "kind", "ts", F.posexplode("tool_calls").alias("call_ix", "call")
        ).select("file_id", "line_no", "sub_seq", "kind", "ts", "call_ix", "call.*")

    def save(self, path: str) -> None:
        """Write the tables as Parquet, by agent, to read them again without parsing."""
        self.files.write.mode("overwrite").partitionBy("agent").parquet(f"{path}/files")
        self.events.write.mode("overwrite").parquet(f"{path}/events")
        self.failed.write.mode("overwrite").parquet(f"{path}/failed")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Logs:
        return cls(*(spark.read.parquet(f"{path}/{t}") for t in ("files", "events", "failed")))

    def register(self, prefix: str = "") -> None:
        """Temporary views for SQL."""
        for name, df in (("files", self.files), ("events", self.events), ("tool_calls", self.tool_calls())):
            df.createOrReplaceTempView(f"{prefix}{name}")


def part_of_path(pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract(path, r'{pattern}', {group}), '')"


STEM = part_of_path(r"([^/]+?)(\.[^./]*)?$")


@dataclass
class Source:
    """A source of session logs: where its files are and how its lines are read.

    To add one, make another ``Source`` and put it into the registry.
    """

    id: str
    roots: Callable[[], list[str]]
    parse: Callable[[DataFrame], Parsed] | None = None
    glob: str = "*.jsonl"
    session_id: str = STEM
    parent_session: str = "CAST(NULL AS string)"
    project: str = "CAST(NULL AS string)"
    accepts: str = "true"

    def detect(self) -> bool:
        return any(os.path.isdir(r) for r in self.roots())

    def read(self, spark: SparkSession, roots: list[str] | None = None) -> Logs:
        if self.parse is None:
            raise NotImplementedError(f"source {self.id!r} can be detected, but its logs can't be read yet")
        found = [r for r in self.roots() if os.path.isdir(r)] if roots is None else roots
        mine = F.expr(self.accepts)
        for link in links(found):
            mine &= ~(path_of("file_id").endswith(link) | F.contains(path_of("file_id"), F.lit(f"{link}/")))
        return self.from_lines(read_lines(spark, found, self.glob).where(mine), listed(spark, found, self.glob).where(mine))

    def from_lines(self, lines: DataFrame, files: DataFrame | None = None) -> Logs:
        """Logs from the columns of ``read_lines``; of ``files`` (``listed``) those without a line have failed.

        Blank lines are numbered and then left out; a file of blank lines is a session without events.
        """
        parsed = self.parse(lines.where(~F.col("line").rlike(BLANK)).withColumn("v", F.expr("try_parse_json(line)")))
        # files and events both come from these rows, so lines are parsed once; a lost part is parsed again.
        # The cache also keeps the optimizer from copying the parsing expressions into each field's use.
        rows = parsed.lines.persist(StorageLevel.MEMORY_AND_DISK)
        events = rows.select("file_id", "line_no", F.posexplode("events").alias("sub_seq", "e")).select("file_id", "line_no", "sub_seq", "e.*")
        extra = {"header_start": F.lit(None).cast("timestamp"), "seen_project": F.lit(None).cast("string"), "last_model": F.lit(None).cast("string")} | parsed.extra
        of_lines = rows.groupBy("file_id").agg(
            F.count_if("skip").alias("skipped_lines"),
            F.sum(F.expr("size(filter(events, e -> e.kind = 'SubAgentSpawn'))")).cast("long").alias("spawn_calls"),
            F.min(F.expr("array_min(transform(events, e -> e.ts))")).alias("first_ts"), F.max(F.expr("array_max(transform(events, e -> e.ts))")).alias("last_ts"),
            *[c.alias(k) for k, c in extra.items()],
        )
        tally = rows.where("tally IS NOT NULL").groupBy("file_id", "tally").count()
        mode = tally.groupBy("file_id").agg(F.max_by("tally", F.struct("count", "tally")).alias("mode"))  # of equals the largest name
        paths = lines.groupBy("file_id").agg(F.first("path").alias("path"), F.first("size_bytes").alias("size_bytes"), F.first("modified").alias("modified"))
        failed = lines.sparkSession.createDataFrame([], FAILED) if files is None else files.join(paths, "file_id", "left_anti").select("file_id", "path")
        none = F.lit(0).cast("long")
        met = paths.join(of_lines, "file_id", "left").withColumns({c: F.coalesce(c, none) for c in ("skipped_lines", "spawn_calls")})
        files = met.join(mode, "file_id", "left").select(
            "file_id", "path", F.lit(self.id).alias("agent"), F.expr(self.session_id).alias("session_id"), F.expr(self.parent_session).alias("parent_session"),
            F.expr(f"coalesce(seen_project, {self.project})").alias("project"), F.coalesce("mode", "last_model").alias("model"),
            F.coalesce("header_start", "first_ts").alias("started_at"), F.col("last_ts").alias("ended_at"), "size_bytes", "modified", "skipped_lines", "spawn_calls",
        )
        files = files.withColumn("row_id", F.coalesce("parent_session", "session_id"))
        # discovery: the newest first, then by path
        return Logs(files.withColumn("disc", F.struct((-F.coalesce(F.unix_micros("modified"), F.lit(0))).alias("age"), F.col("path").alias("at"))), events, failed, [rows])


def collect(logs: list[Logs]) -> Logs:
    return reduce(Logs.union, logs)


def env_paths(name: str, default: str, *subs: str, many: bool = False) -> list[str]:
    """Folders under the paths that a variable names, or under ``default``."""
    value = os.environ.get(name, "").strip()
    bases = [x.strip() for x in value.split(",") if x.strip()] if many else [value] if value else []
    return [os.path.join(b, s) for b in bases or [os.path.expanduser(default)] for s in subs]
