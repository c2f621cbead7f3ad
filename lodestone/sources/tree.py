"""A source tree as a table of files, and what stands beside the sources: marker, README, entry points, history."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import LANGUAGES, language_of

# Folders that are never read, names that are indexed first, names by which a project is started, README names.
EXCLUDED = ("node_modules", ".git", "__pycache__", ".venv", "venv", "env", "dist", "build", ".mypy_cache", ".ruff_cache", "target", ".codebrain", ".devenv", ".direnv", "vendor", "pkg", ".cache", ".terraform", "_build", "deps")
FIRST = ("main.py", "app.py", "server.py", "__init__.py", "cli.py", "wsgi.py", "asgi.py", "main.ts", "index.ts", "app.ts", "server.ts", "index.js", "main.js", "main.go", "main.rs", "lib.rs", "mod.rs", "Main.java", "Application.java", "main.c", "main.cpp")
STARTS = ("main.py", "__main__.py", "server.py", "cli.py", "app.py", "manage.py", "run.py")
SKIPPED = (".devenv", ".venv", "venv", "env", "node_modules", ".git", "__pycache__", ".terraform", "_build", "deps")
READMES = ("README.md", "README.rst", "README.txt", "README")
#: A file of this name in a root keeps the tree out of the index.
MARKER = ".lodestone-ignore"


def _store(spark: SparkSession, root: str):
    """The root as its file system writes it, and that file system."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(path).toString().rstrip("/"), fs


def exists(spark: SparkSession, path: str) -> bool:
    _, fs = _store(spark, path)
    return bool(fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)))


def folders(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> list[str]:
    """root and all folders below it that are not excluded or inside excluded ones; only folders are listed here."""
    base, fs = _store(spark, root)
    make, found, left = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, [], [base]
    out = {*EXCLUDED, *exclude}
    while left:
        found.append(now := left.pop())
        left += [s.getPath().toString() for s in fs.listStatus(make(now)) if s.isDirectory() and s.getPath().getName() not in out]
    return found


def _files(spark: SparkSession, root: str, exclude: tuple[str, ...], sources: bool) -> DataFrame:
    base, _ = _store(spark, root)
    reader = spark.read.format("binaryFile")
    if sources:
        ends = ",".join(sorted(x for e in LANGUAGES for x in {e[1:], e[1:].upper()}))
        reader = reader.option("pathGlobFilter", f"*.{{{ends}}}")
    return reader.load(folders(spark, root, exclude)).withColumn("below", F.expr(f"substring(path, {len(base) + 2})"))


def list_tree(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path (below root) and mtime of all files outside excluded folders; contents are not read."""
    return _files(spark, root, exclude, False).select(F.col("below").alias("path"), F.col("modificationTime").cast("double").alias("mtime"))


def read_tree(spark: SparkSession, root: str, languages: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """path (below root), language, mtime, hash, text of the files of known languages outside excluded folders.

    Folder names are compared as a whole, and count below root alone. Excluded folders are not listed, and of other
    files than sources nothing is read. Files are read by Spark, so root can be any path that it opens. Bytes that are
    no UTF-8 become replacement characters.
    """
    files = _files(spark, root, exclude, True).withColumn("language", language_of(F.col("below"))).filter("language IS NOT NULL")
    if languages:
        files = files.filter(F.col("language").isin(*languages))
    return files.select(F.col("below").alias("path"), "language", F.col("modificationTime").cast("double").alias("mtime"), F.substring(F.sha2("content", 256), 1, 16).alias("hash"), F.decode("content", "UTF-8").alias("text"))


def in_order(files: DataFrame) -> DataFrame:
    """Files (path, mtime): those of well-known names first, then the latest."""
    return files.orderBy(F.when(F.substring_index("path", "/", -1).isin(*FIRST), 0).otherwise(1), F.desc("mtime"), "path")


def skipped(spark: SparkSession, root: str, marker: str = MARKER) -> bool:
    return exists(spark, f"{root.rstrip('/')}/{marker}")


def readme(spark: SparkSession, root: str) -> str:
    """The first paragraph of the first README with one, 500 characters at most: headings, badges, links and rules are passed over, and end it."""
    for name in READMES:
        path = f"{root.rstrip('/')}/{name}"
        if not exists(spark, path):
            continue
        text = spark.read.text(path, wholetext=True).select(F.substring("value", 1, 4000)).first()[0]
        said: list[str] = []
        for line in map(str.strip, text.split("\n")):
            plain = not line.startswith(("#", "!", "[", "```", "---", "==="))
            if said and not (line and plain):
                break
            if line and plain:
                said.append(line)
        if said:
            return " ".join(said)[:500]
    return ""


def entry_points(paths: DataFrame) -> DataFrame:
    """Of paths (path) the first five, in order, by which a project is started."""
    part = F.split("path", "/")
    return paths.filter(F.element_at(part, -1).isin(*STARTS) & ~F.arrays_overlap(part, F.array(*[F.lit(x) for x in SKIPPED]))).select("path").orderBy("path").limit(5)


def history(root: str) -> dict:
    """Of a git work tree on this machine: files changed within 30 days and the age of the last commit."""
    run = lambda *a: subprocess.run(["git", "-C", root, "log", *a], capture_output=True, text=True, timeout=5)
    try:
        changed, last = run("--since=30.days", "--name-only", "--format=", "--no-merges"), run("-1", "--format=%cr")
    except (OSError, subprocess.SubprocessError):
        return {"available": False}
    if changed.returncode:
        return {"available": False}  # no history is not a stale one
    return {"files_changed_30d": len({x for x in changed.stdout.split("\n") if x.strip()}), "last_commit": last.stdout.strip()}
