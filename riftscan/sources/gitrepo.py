"""A Spark data source over a git repository.

``spark.read.format("gitrepo").option("path", p).option("table", t).load()``
with a table of: refs, commits, edges, tree, files, name_status, diff,
branch_diffs, merge_tree, status. ``ref`` and ``base`` name the commits (tree,
files, diff and so on); files are read in parallel, a partition for each part
of the tree. branch_diffs compares each of ``branches`` (lines of name, tab,
commit) with where it left ``ref``, a partition for each branch.
The repository must be at the same path on every executor.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from riftscan.errors import ScanError
from riftscan.functions.workers import importable

SCHEMAS = {
    "refs": "name string, short_name string, sha string, is_remote boolean, is_current boolean, upstream string",
    "commits": "sha string, short_sha string, author string, email string, date string, message string",
    "edges": "child string, parent string",
    "tree": "ref string, path string",
    "files": "ref string, path string, source string",
    "name_status": "diff_id string, raw string",
    "diff": "diff_id string, raw string",
    "branch_diffs": "branch string, name_status string, raw string",
    "merge_tree": "diff_id string, raw string",
    "status": "is_clean boolean, staged array<string>, modified array<string>, untracked array<string>",
}
PARTS = 16
# What two commits are compared by.
RENAMES, CONTEXT, NAMES_ONLY = "-M90%", ("-U3",), ("--name-status",)


def find_root(path: str) -> str:
    """The nearest folder at or above ``path`` that holds .git."""
    at = os.path.abspath(path)
    while not os.path.exists(os.path.join(at, ".git")):
        up = os.path.dirname(at)
        if up == at:
            raise ScanError("NOT_A_GIT_REPO", f"no git repository at or above {path}")
        at = up
    return at


def parse_version(raw: str) -> str:
    m = re.search(r"git version (\d+\.\d+\.\d+)", raw)
    return m[1] if m else raw.strip()


def git(root: str, *args: str, codes: tuple[int, ...] = (0,)) -> str:
    try:
        run = subprocess.run(["git", "-C", root, *args], capture_output=True, env=os.environ | {"LC_ALL": "C"})
    except FileNotFoundError as e:
        raise ScanError("GIT_NOT_INSTALLED", "git is not on the path", e) from e
    if run.returncode not in codes:
        raise ScanError("GIT_COMMAND_FAILURE", f"git {args[0]} failed", run.stderr.decode(errors="replace"))
    return run.stdout.decode(errors="replace")


def open_repository(path: str) -> dict[str, str]:
    """root and version of the repository that holds ``path``."""
    if not os.path.exists(path):
        raise ScanError("INVALID_REPO_PATH", f"no such path: {path}")
    root = find_root(path)
    return {"root": root, "version": parse_version(git(root, "--version"))}


def merge_base(root: str, a: str, b: str) -> str:
    try:
        return git(root, "merge-base", a, b).strip()
    except ScanError as e:
        shallow = git(root, "rev-parse", "--is-shallow-repository", codes=(0, 128)).strip() == "true"
        raise ScanError("SHALLOW_REPO_LIMITATION" if shallow else "MERGE_BASE_UNAVAILABLE", f"no merge base of {a} and {b}", e.cause) from e


class Part(InputPartition):
    def __init__(self, paths: list[str] | None) -> None:
        self.paths = paths


class GitReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = open_repository(options["path"])["root"]
        self.table, self.ref, self.base = options.get("table", "refs"), options.get("ref", "HEAD"), options.get("base")
        self.branches = options.get("branches", "").splitlines()

    def partitions(self) -> list[InputPartition]:
        if self.table == "branch_diffs":
            return [Part([b]) for b in self.branches] or [Part([])]
        if self.table != "files":
            return [Part(None)]
        paths = self.tree()
        return [Part(paths[k::PARTS]) for k in range(PARTS) if paths[k::PARTS]] or [Part([])]

    def tree(self) -> list[str]:
        return [p for p in git(self.root, "ls-tree", "-r", "-z", "--name-only", self.ref).split("\0") if p]

    def read(self, part: Part) -> Iterator[tuple]:
        yield from getattr(self, "read_" + self.table)(part)

    def read_refs(self, part: Part) -> Iterator[tuple]:
        current = git(self.root, "symbolic-ref", "-q", "HEAD", codes=(0, 1)).strip()
        for line in git(self.root, "for-each-ref", "--format=%(refname)%00%(objectname)%00%(upstream:short)", "refs/heads", "refs/remotes").splitlines():
            name, sha, upstream = line.split("\0")
            remote = name.startswith("refs/remotes/")
            short = name.split("/", 2)[2]
            if remote and "HEAD" in short:
                continue
            yield name, short, sha, remote, name == current, upstream or None

    def read_commits(self, part: Part) -> Iterator[tuple]:
        for line in git(self.root, "log", "-z", "--format=%H%x01%h%x01%an%x01%ae%x01%aI%x01%s", self.ref).split("\0"):
            if line.strip():
                yield tuple(line.strip("\n").split("\x01", 5))

    def read_edges(self, part: Part) -> Iterator[tuple]:
        for line in git(self.root, "rev-list", "--parents", "--all").splitlines():
            child, *parents = line.split()
            for p in parents:
                yield child, p

    def read_tree(self, part: Part) -> Iterator[tuple]:
        for p in self.tree():
            yield self.ref, p

    def read_files(self, part: Part) -> Iterator[tuple]:
        """One process for all files of a partition; a file at a time is held."""
        with subprocess.Popen(["git", "-C", self.root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE, env=os.environ | {"LC_ALL": "C"}) as run:
            for p in part.paths or []:
                if "\n" in p:
                    yield self.ref, p, git(self.root, "show", f"{self.ref}:{p}", codes=(0, 128))
                    continue
                run.stdin.write(f"{self.ref}:{p}\n".encode())
                run.stdin.flush()
                head = run.stdout.readline().split()
                found = len(head) == 3 and head[1] == b"blob"
                raw = run.stdout.read(int(head[2]) + 1)[:-1] if len(head) == 3 and head[2].isdigit() else b""
                yield self.ref, p, raw.decode(errors="replace") if found else ""
            run.stdin.close()

    def compare(self, what: tuple[str, ...], base: str, ref: str) -> str:
        return git(self.root, "-c", "core.quotepath=off", "diff", *what, RENAMES, f"{base}..{ref}")

    def read_name_status(self, part: Part) -> Iterator[tuple]:
        yield f"{self.base}..{self.ref}", self.compare(NAMES_ONLY, self.base, self.ref)

    def read_diff(self, part: Part) -> Iterator[tuple]:
        yield f"{self.base}..{self.ref}", self.compare(CONTEXT, self.base, self.ref)

    def read_branch_diffs(self, part: Part) -> Iterator[tuple]:
        for name, sha in (line.split("\t") for line in part.paths or []):
            try:
                base = merge_base(self.root, self.ref, sha)
                yield name, self.compare(NAMES_ONLY, base, sha), self.compare(CONTEXT, base, sha)
            except ScanError:  # a branch that can't be read is left out; the others are still swept
                continue

    def read_merge_tree(self, part: Part) -> Iterator[tuple]:
        # Exit code 1 says that there are conflicts. Messages are left out: only paths follow the tree's name.
        yield f"{self.base}..{self.ref}", git(self.root, "merge-tree", "--write-tree", "--name-only", "--no-messages", self.base, self.ref, codes=(0, 1))

    def read_status(self, part: Part) -> Iterator[tuple]:
        staged, modified, untracked = [], [], []
        for line in git(self.root, "status", "--porcelain", "-z").split("\0"):
            if len(line) > 3:
                if line.startswith("??"):
                    untracked.append(line[3:])
                else:
                    if line[0] not in " ?":
                        staged.append(line[3:])
                    if line[1] not in " ?":
                        modified.append(line[3:])
        yield not (staged or modified or untracked), staged, modified, untracked


class GitSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitrepo"

    def schema(self) -> str:
        table = self.options.get("table", "refs")
        if table not in SCHEMAS:
            raise ScanError("UNKNOWN", f"no table {table!r}; there are {', '.join(SCHEMAS)}")
        return SCHEMAS[table]

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return GitReader(dict(self.options))


def register(spark: SparkSession) -> None:
    importable(spark)
    spark.dataSource.register(GitSource)


def load(spark: SparkSession, path: str, table: str, **options: str) -> DataFrame:
    register(spark)
    reader = spark.read.format("gitrepo").option("path", path).option("table", table)
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


def read_diff_texts(spark: SparkSession, path: str) -> DataFrame:
    """diff_id, raw of diff files, one row each, whole."""
    from pyspark.sql import functions as F

    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("diff_id"), F.col("value").alias("raw"))


def read_diff_lines(spark: SparkSession, path: str) -> DataFrame:
    """diff_id, pos, line of diff files of any size: a file is read by a task for each of its blocks.

    Lines are numbered in their block, blocks by what is before them. The
    empty line after a last line break, which the text as a whole has, is left out.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    read = spark.read.text(path, lineSep="\n")
    rows = read.select(F.col("_metadata.file_path").alias("diff_id"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("line"))
    before = Window.partitionBy("diff_id").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("diff_id", "_block").agg(F.count("*").alias("_n"), F.min("_id").alias("_first")).select("diff_id", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # a block's lines follow one another in one task, so that their ids do
    return rows.join(starts, ["diff_id", "_block"]).select("diff_id", (F.col("_start") + F.col("_id") - F.col("_first")).alias("pos"), "line")
