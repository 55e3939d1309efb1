"""Files of a repository, from a folder or from a git revision, as tables of what they are and of what they hold."""

from __future__ import annotations

import os
import subprocess
from abc import ABC, abstractmethod
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.names import basename, language_of
from ..schema import EXCLUDED_PARTS, MAX_FILE_BYTES

#: Files that say how modules and frameworks are laid out.
MANIFESTS = ("composer.json", "package.json", "tsconfig.json", "jsconfig.json", "tsconfig.base.json")
LISTING = "path string, size long, mtime_ns long"


class GitError(RuntimeError):
    """Git could not answer, and the message says how."""


def git(repo: str, *arguments: str, timeout: int = 300) -> bytes:
    try:
        done = subprocess.run(["git", "-C", repo, "-c", "safe.directory=*", *arguments], capture_output=True, timeout=timeout, check=False)
    except (OSError, subprocess.SubprocessError) as e:
        raise GitError(f"git {' '.join(arguments)}: {e}") from e
    if done.returncode:
        raise GitError(f"git {' '.join(arguments)}: {done.stderr.decode(errors='replace').strip() or 'failed'}")
    return done.stdout


def is_git_repository(root: str) -> bool:
    try:
        return git(root, "rev-parse", "--is-inside-work-tree").strip() == b"true"
    except GitError:
        return False


def resolve_revision(repo: str, revision: str = "HEAD") -> str:
    """The commit that a revision names, once, so that all reads are of one commit."""
    return git(repo, "rev-parse", "--verify", "--end-of-options", f"{revision}^{{commit}}").decode().strip()


def excluded(path: Column, parts: tuple[str, ...] = EXCLUDED_PARTS) -> Column:
    """Whether a folder above a file is one that holds no source."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.arrays_overlap(folders, F.array(*map(F.lit, parts)))


def sorted_out(listing: DataFrame, most_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """A listing with language and why a file is left out (null: it isn't)."""
    language = language_of(F.col("path"))
    why = F.when(excluded(F.col("path")), "excluded").when(language.isNull(), "unsupported_language").when(F.col("size") > most_bytes, "too_large")
    return listing.withColumn("language", language).withColumn("why", why)


def walk_stats(listing: DataFrame) -> DataFrame:
    """One row: files considered, selected, and left out by reason; excluded folders are not considered in a walk."""
    n = lambda what: F.count(F.when(what, 1))
    why = F.col("why")
    return listing.agg(F.count("*").alias("considered"), n(why.isNull()).alias("selected"), *[n(why == w).alias(w) for w in ("excluded", "unsupported_language", "too_large")])


class Tree(ABC):
    """What an index is built from."""

    @abstractmethod
    def listing(self) -> DataFrame:
        """(path, size, mtime_ns) of all files; a null time where there is none, so that contents are compared."""

    @abstractmethod
    def contents(self, paths: DataFrame) -> DataFrame:
        """(path, content) of the paths."""

    def provenance(self) -> dict[str, str]:
        return {}

    def files(self) -> DataFrame:
        """(path, language, size, mtime_ns) of the files worth parsing."""
        return sorted_out(self.listing()).filter("why is null").select("path", "language", "size", "mtime_ns")

    def manifests(self) -> dict[str, str]:
        """path -> text of project files; a repository has few of them."""
        own = self.listing().filter(basename(F.col("path")).isin(*MANIFESTS) & ~excluded(F.col("path")) & (F.col("size") <= MAX_FILE_BYTES)).select("path")
        return {r["path"]: bytes(r["content"]).decode("utf-8-sig", "replace") for r in self.contents(own).collect()}


class WorkingTree(Tree):
    """A folder: what git lists in it (tracked, or untracked and not ignored) where it is a repository, else all files but those in hidden or excluded folders."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root if "://" in root else os.path.abspath(root)
        self.in_git = "://" not in root and is_git_repository(self.root)

    def _read(self) -> DataFrame:
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.root if "://" in self.root else f"file://{self.root}")
        clean = F.regexp_replace("path", "^file:/+", "/")
        top = self.root.rstrip("/") + "/"
        relative = F.when(F.startswith(clean, F.lit(top)), F.substring(clean, len(top) + 1, 1 << 30)).otherwise(F.element_at(F.split("path", f"{os.path.basename(self.root.rstrip('/'))}/", 2), -1))
        return found.select(F.url_decode(F.replace(relative, F.lit("+"), F.lit("%2B"))).alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), "content")

    def listing(self) -> DataFrame:
        own = self._read().drop("content")
        if self.in_git:
            raw = git(self.root, "ls-files", "-z", "--cached", "--others", "--exclude-standard", "--deduplicate")
            names = [x.decode("utf-8", "surrogateescape") for x in raw.split(b"\0") if x]
            listed = self.spark.createDataFrame([(n,) for n in names], "path string")
            return own.join(listed, "path", "left_semi")
        hidden = F.exists(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1), lambda p: p.startswith("."))
        return own.filter(~hidden & ~excluded(F.col("path")))

    def contents(self, paths: DataFrame) -> DataFrame:
        return self._read().select("path", "content").join(paths.select("path").distinct(), "path", "left_semi")

    def provenance(self) -> dict[str, str]:
        return {"project_root": self.root, "source": "working-tree"}


class _Blobs(InputPartition):
    def __init__(self, entries: list[tuple[str, str, int]]):
        self.entries = entries


def blobs(repo: str, commit: str) -> Iterator[tuple[str, str, int]]:
    """(path, blob, size) of the regular files of a commit."""
    for entry in git(repo, "ls-tree", "-r", "-l", "-z", "--full-tree", commit).split(b"\0"):
        head, _, name = entry.partition(b"\t")
        parts = head.split()
        if len(parts) == 4 and parts[1] == b"blob" and parts[0] in (b"100644", b"100755") and parts[3].isdigit():
            yield name.decode("utf-8", "surrogateescape"), parts[2].decode(), int(parts[3])


class BatchReader:
    """One long-lived `git cat-file --batch`: a process for a partition, not for a blob."""

    def __init__(self, repo: str):
        self.run = subprocess.Popen(["git", "-C", repo, "-c", "safe.directory=*", "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def read(self, blob: str) -> bytes:
        self.run.stdin.write(f"{blob}\n".encode())
        self.run.stdin.flush()
        head = self.run.stdout.readline().split()
        if len(head) != 3:
            raise GitError(f"{blob} is missing")
        body = self.run.stdout.read(int(head[2]))
        self.run.stdout.read(1)
        return body

    def close(self) -> None:
        self.run.stdin.close()
        self.run.stdout.close()
        self.run.wait()


class _RevisionReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.commit = options["repository"], options["commit"]
        self.per = int(options.get("partitionbytes", 8 << 20))
        self.with_content = options.get("content", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        out, held, size = [], [], 0
        for entry in blobs(self.repo, self.commit):
            held.append(entry)
            size += entry[2] if self.with_content else 256
            if size >= self.per:
                out.append(_Blobs(held))
                held, size = [], 0
        return [*out, _Blobs(held)]

    def read(self, partition: _Blobs) -> Iterator[tuple]:
        if not self.with_content:
            yield from ((path, blob, size, None) for path, blob, size in partition.entries)
            return
        reader = BatchReader(self.repo)
        try:
            for path, blob, size in partition.entries:
                yield path, blob, size, reader.read(blob) if size <= MAX_FILE_BYTES else None
        finally:
            reader.close()


class RevisionSource(DataSource):
    """Files of a git commit; options: repository, commit, content (true or false)."""

    @classmethod
    def name(cls) -> str:
        return "git_revision"

    def schema(self) -> str:
        return "path string, blob string, size long, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _RevisionReader(dict(self.options))


class GitRevision(Tree):
    """A revision of a repository, bare ones too: nothing is checked out, and there are no times."""

    def __init__(self, spark: SparkSession, repo: str, revision: str = "HEAD"):
        self.spark, self.repo, self.revision = spark, os.path.abspath(repo), revision
        self.commit = resolve_revision(self.repo, revision)
        spark.dataSource.register(RevisionSource)

    def _read(self, content: bool) -> DataFrame:
        return self.spark.read.format("git_revision").option("repository", self.repo).option("commit", self.commit).option("content", str(content).lower()).load()

    def listing(self) -> DataFrame:
        return self._read(False).select("path", "size", F.lit(None).cast("long").alias("mtime_ns"))

    def contents(self, paths: DataFrame) -> DataFrame:
        return self._read(True).select("path", "content").join(paths.select("path").distinct(), "path", "left_semi")

    def provenance(self) -> dict[str, str]:
        return {"source": "git-objects", "revision": self.revision, "commit": self.commit, "repository": self.repo}
