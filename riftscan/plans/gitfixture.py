"""A git repository made from the table ``nation``, for queries over the git source.

Every nation is a file of twelve lines on main. Branch feature edits, deletes,
renames and adds files, branch other edits lines, by the nation's key; regions
name further branches. ``nation`` has a fixed number of rows, whatever the
scale, so writing it from the driver is bounded.
"""

from __future__ import annotations

import functools
import os
import subprocess
import tempfile
import uuid

from pyspark.sql import SparkSession

LINES, EDITED = 12, 6
WHO = {f"GIT_{role}_{k}": v for role in ("AUTHOR", "COMMITTER") for k, v in (("NAME", "Ada"), ("EMAIL", "ada@x.org"), ("DATE", "2024-01-02T03:04:05+00:00"))}
PLAIN = {"GIT_CONFIG_GLOBAL": os.devnull, "GIT_CONFIG_SYSTEM": os.devnull, "LC_ALL": "C"}


def folder(spark: SparkSession) -> str:
    """A new folder that all executors see: by the checkpoint folder, or for a local session anywhere."""
    if spark.sparkContext.master.startswith("local"):
        return tempfile.mkdtemp(prefix="riftscan-git-")
    shared = spark.conf.get("spark.checkpoint.dir", "").removeprefix("file://").removeprefix("file:")
    if not shared.startswith("/"):
        raise RuntimeError("the git source needs spark.checkpoint.dir to be a mounted folder that all executors share")
    path = os.path.join(shared, f"git-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def repository(spark: SparkSession, sf_dir: str) -> str:
    """The path of the repository; one is made for each session and data folder."""
    return made(spark.sparkContext.applicationId, sf_dir, spark)


@functools.lru_cache(maxsize=8)
def made(application: str, sf_dir: str, spark: SparkSession) -> str:
    nations = {r.n_nationkey: r.n_name for r in spark.read.parquet(f"{sf_dir}/nation.parquet").collect()}
    regions = [r.r_name.replace(" ", "-") for r in spark.read.parquet(f"{sf_dir}/region.parquet").collect()]
    root = folder(spark)

    def git(*args: str) -> None:
        subprocess.run(["git", "-C", root, *args], check=True, capture_output=True, env=os.environ | WHO | PLAIN)

    def write(name: str, lines: list[str]) -> None:
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as out:
            out.write("\n".join(lines) + "\n")

    def body(k: int, **edits: str) -> list[str]:
        changed = {int(at[1:]): text for at, text in edits.items()}
        return [changed.get(n, f"row {n} of {nations[k]}") for n in range(1, LINES + 1)]

    def commit(message: str) -> None:
        git("add", "-A")
        git("commit", "-q", "--allow-empty", "-m", message)

    git("init", "-q", "-b", "main")
    for k in nations:
        write(f"src/n{k}.js", body(k))
    commit("all nations")
    for r in regions:
        git("branch", f"region/{r}")
    for name in ("origin/main", "origin/HEAD"):
        git("update-ref", f"refs/remotes/{name}", "main")
    git("checkout", "-qb", "other")
    for k in nations:
        if k % 4 < 2:
            write(f"src/n{k}.js", body(k, **({f"_{EDITED}": f"other {k}"} if k % 4 == 0 else {f"_{LINES}": f"other end {k}"})))
    commit("lines of other")
    git("checkout", "-q", "-b", "feature", "main")
    for k in nations:
        if k % 5 == 0:
            write(f"src/n{k}.js", body(k, **{f"_{EDITED}": f"feature {k}"}))
    commit("lines of feature")
    for k in nations:
        if k % 5 == 1:
            os.remove(os.path.join(root, f"src/n{k}.js"))
        elif k % 5 == 2:
            os.makedirs(os.path.join(root, "moved"), exist_ok=True)
            os.rename(os.path.join(root, f"src/n{k}.js"), os.path.join(root, f"moved/n{k}.js"))
        elif k % 5 == 3:
            write(f"src/a{k}.js", [f"one {nations[k]}", f"two {nations[k]}", f"eval(v{k})"])
    commit("files of feature")
    for k in nations:  # left in the working tree
        if k % 5 == 4 and k % 2 == 0:
            write(f"src/n{k}.js", body(k, _1="staged"))
            git("add", f"src/n{k}.js")
        if k % 5 == 4 and k % 2 == 1:
            write(f"src/n{k}.js", body(k, _1="unstaged"))
        if k % 6 == 0:
            write(f"untracked{k}.txt", [nations[k]])
    return root
