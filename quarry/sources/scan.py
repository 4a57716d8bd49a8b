"""Sources: source trees as binary files, the project registry, federated projects."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars

# --- fixed values: extensions per language, document extensions, ignored folders and files, size limit, root markers
CODE_EXTENSIONS = {
    "typescript": ("ts", "tsx"), "javascript": ("js", "mjs", "cjs", "jsx"), "java": ("java",), "kotlin": ("kt", "kts"),
    "python": ("py",), "vue": ("vue",), "svelte": ("svelte",), "php": ("php",), "ruby": ("rb",), "csharp": ("cs",),
    "go": ("go",), "rust": ("rs",),
}
DEFAULT_LANGUAGES = ("typescript", "javascript")
DOCUMENT_EXTENSIONS = ("md", "markdown", "yaml", "yml", "txt")
IGNORED_FOLDERS = ("node_modules", ".git", "dist", "build", ".next", "target", ".gradle", "out", "__pycache__", ".venv", "venv", "vendor")
IGNORED_ENDINGS = (".min.js", ".d.ts", ".pyc")
MAX_FILE_BYTES = 1024 * 1024
ROOT_MARKERS = ("package.json", ".git", "pyproject.toml", "go.mod", "Cargo.toml", "pom.xml")
# --- end of fixed values

_ESC = lambda s: "".join("\\" + c if c in ".^$*+?()[]{}|\\" else c for c in s)
IGNORE_PATTERN = f"(?:^|/)(?:{'|'.join(map(_ESC, IGNORED_FOLDERS))})/|(?:{'|'.join(map(_ESC, IGNORED_ENDINGS))})$"


def code_extensions(languages=DEFAULT_LANGUAGES) -> list[str]:
    return list(dict.fromkeys(e for name in languages for e in CODE_EXTENSIONS.get(name, ())))


def scan_tree(spark: SparkSession, root: str, extensions, with_content: bool = True) -> DataFrame:
    """(path, length, modified[, content]) of the tree's files with these extensions, outside ignored folders. ``path``
    is relative to the root. The size limit and the extension reach the scan; contents are read only when asked for."""
    glob = "*.{" + ",".join(extensions) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    prefix = root.rstrip("/") + "/"
    full = F.regexp_replace(F.col("path"), r"^[a-z][a-z0-9+.-]*:/*(?=/)", "")
    plain = prefix.split("://", 1)[-1]
    at = F.instr(full, plain)
    rel = F.when(at > 0, F.substring(full, at + len(plain), F.length(full))).otherwise(scalars.basename(full))
    columns = [rel.alias("path"), "length", F.col("modificationTime").alias("modified")]
    return raw.select(*columns, *(["content"] if with_content else [])).filter(~F.col("path").rlike(IGNORE_PATTERN))


def within_size(files: DataFrame, most: int = MAX_FILE_BYTES) -> DataFrame:
    return files.filter(F.col("length") <= most)


def as_text(files: DataFrame) -> DataFrame:
    """content as UTF-8 text; invalid bytes become U+FFFD."""
    return files.withColumn("content", F.make_valid_utf8(F.col("content").cast("string")))


def scan_code(spark: SparkSession, root: str, languages=DEFAULT_LANGUAGES) -> DataFrame:
    return as_text(within_size(scan_tree(spark, root, code_extensions(languages))))


def scan_documents(spark: SparkSession, root: str) -> DataFrame:
    return as_text(within_size(scan_tree(spark, root, DOCUMENT_EXTENSIONS)))


def _file(spark: SparkSession, path: str):
    """(file system, path) as Hadoop has them."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file from the driver, replacing what is there."""
    fs, p = _file(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file on the driver, None if there is none."""
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _file(spark, path)
    fs.delete(p, True)


def named_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(path, length, modified, content) of the named files of a tree, and of no others; a missing file has no row."""
    found = []
    for p in dict.fromkeys(paths):
        fs, full = _file(spark, f"{root.rstrip('/')}/{p}")
        if fs.exists(full):
            found.append((fs.makeQualified(full).toString(), p))
    if not found:
        return spark.createDataFrame([], "path string, length long, modified timestamp, content binary")
    raw = spark.read.format("binaryFile").load(["".join("\\" + c if c in "{}[]*?\\" else c for c in full) for full, _ in found])
    names = F.broadcast(spark.createDataFrame(found, "full string, name string"))  # one row per named path
    return raw.join(names, F.col("path") == F.col("full")).select(F.col("name").alias("path"), "length", F.col("modificationTime").alias("modified"), "content")


def scan_project(spark: SparkSession, root: str, languages=DEFAULT_LANGUAGES, extra: list[str] | None = None) -> DataFrame:
    """Code and documents, and explicitly named further paths."""
    found = scan_code(spark, root, languages).unionByName(scan_documents(spark, root))
    if extra:
        found = found.unionByName(as_text(within_size(named_files(spark, root, extra))))
    return found


def scan_status(files: DataFrame) -> DataFrame:
    """(path, status) before parsing: skipped when over the size limit, else candidate."""
    return files.select("path", F.when(F.col("length") > MAX_FILE_BYTES, "skipped").otherwise("candidate").alias("status"))


def lines_between(text: DataFrame, first: int, last: int, key: str = "path", content: str = "content") -> DataFrame:
    """(key, line, text) of the lines first to last."""
    lines = text.select(key, F.posexplode(F.split(content, "\n")).alias("pos", "text"))
    return lines.filter((F.col("pos") + 1).between(first, last)).select(key, (F.col("pos") + 1).alias("line"), "text")


def project_root(start: str) -> str:
    """The nearest folder at or above ``start`` that holds a root marker, else ``start``."""
    here = os.path.abspath(start)
    while True:
        if any(os.path.exists(os.path.join(here, m)) for m in ROOT_MARKERS):
            return here
        up = os.path.dirname(here)
        if up == here:
            return os.path.abspath(start)
        here = up


# --- registry


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """One row per registered project."""
    schema = "version int, projects array<struct<path:string,hash:string,name:string,monitoringPort:int,federatedRepos:array<string>,addedAt:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("projects").alias("p")).select("p.*")


class Registry:
    """The registry file, edited on the driver. A project is named by the first eight hex digits of its path's SHA-256;
    its port derives from them, moving on while taken. With a session, the file may be in any store that Spark reads."""

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.path, self.spark = path, spark

    def projects(self) -> list[dict]:
        if self.spark is not None:
            return json.loads(read_text(self.spark, self.path) or "{}").get("projects", [])
        if not os.path.exists(self.path):
            return []
        with open(self.path) as f:
            return json.load(f).get("projects", [])

    def _write(self, projects: list[dict]) -> None:
        if self.spark is not None:
            write_text(self.spark, self.path, json.dumps({"version": 1, "projects": projects}, indent=1))
            return
        temp = self.path + ".tmp"
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        with open(temp, "w") as f:
            json.dump({"version": 1, "projects": projects}, f, indent=1)
        os.replace(temp, self.path)

    def upsert(self, project_path: str, name: str | None = None, added_at: str = "") -> dict:
        projects = self.projects()
        for p in projects:
            if p["path"] == project_path:
                p["name"] = name or p["name"]
                self._write(projects)
                return p
        digest = hashlib.sha256(project_path.encode()).hexdigest()[:8]
        port, taken = scalars.BASE_PORT + int(digest[:4], 16) % scalars.PORTS, {p["monitoringPort"] for p in projects}
        while port in taken:
            port += 1
        entry = {"path": project_path, "hash": digest, "name": name or os.path.basename(project_path), "monitoringPort": port, "federatedRepos": [], "addedAt": added_at}
        self._write([*projects, entry])
        return entry

    def remove(self, project_path: str) -> bool:
        projects = self.projects()
        left = [p for p in projects if p["path"] != project_path]
        self._write(left)
        return len(left) < len(projects)

    def link(self, project_path: str, other: str, add: bool = True) -> list[str]:
        """Add or remove a federated project. A missing project and the project itself are refused; idempotent."""
        projects = self.projects()
        entry = next((p for p in projects if p["path"] == project_path), None)
        if entry is None or other == project_path or add and not os.path.exists(other):
            raise ValueError("cannot link these projects")
        repos = [r for r in entry["federatedRepos"] if r != other] + ([other] if add else [])
        entry["federatedRepos"] = sorted(repos, key=lambda r: (entry["federatedRepos"] + [other]).index(r))
        self._write(projects)
        return entry["federatedRepos"]


def federated_paths(value: str | None) -> list[str]:
    """A list of paths separated by colon or comma."""
    return [p.strip() for p in (value or "").replace(",", ":").split(":") if p.strip()]


def union_projects(tables: dict[str, DataFrame]) -> DataFrame:
    """The same table of several projects, with its project and the project's place (the first is the primary)."""
    out = None
    for k, (name, df) in enumerate(tables.items()):
        x = df.withColumns({"project": F.lit(name), "project_ord": F.lit(k)})
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out
