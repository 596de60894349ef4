"""Commits of a git repository as sources. The driver lists their names; tasks read the objects from the repository, which lies where all of them see it."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fingerprint

# Fixed value: how much of a subject is a title.
TITLE_CHARS = 200
COMMITS = "sha string, timestamp string, subject string, body string, author_name string, author_email string, patch string"


def _ask(repository: str, command: list[str], said: str = "") -> bytes:
    return subprocess.run(["git", "-C", repository, *command], input=said.encode(), check=True, capture_output=True).stdout


def objects_of(batch: bytes) -> Iterator[bytes]:
    """The contents that ``cat-file --batch`` gives, each behind a line of name, kind and size."""
    at = 0
    while at < len(batch):
        line = batch.index(b"\n", at)
        size = int(batch[at:line].rsplit(b" ", 1)[1])
        yield batch[line + 1 : line + 1 + size]
        at = line + size + 2


def _person(line: bytes) -> tuple[str, str, str]:
    """Name, address and time of ``name <address> seconds zone``."""
    name, _, rest = line.decode("utf-8", "replace").partition("<")
    address, _, when = rest.rpartition(">")
    seconds, zone = when.split()
    minutes = int(zone[-4:-2]) * 60 + int(zone[-2:])
    at = timezone(timedelta(minutes=-minutes if zone.startswith("-") else minutes))
    return name.strip(), address, datetime.fromtimestamp(int(seconds), at).isoformat()


def commit_of(content: bytes) -> dict[str, str]:
    """What a commit object says of itself. The first paragraph of its message is the subject."""
    head, _, message = content.partition(b"\n\n")
    told = dict(line.split(b" ", 1) for line in head.split(b"\n") if line.startswith((b"author ", b"committer ")))
    author, (_, _, when) = _person(told[b"author"]), _person(told[b"committer"])
    lines = message.decode("utf-8", "replace").strip("\n").split("\n")
    end = next((k for k, line in enumerate(lines) if not line.strip()), len(lines))
    return {"timestamp": when, "subject": " ".join(lines[:end]).strip(), "body": "\n".join(lines[end:]).strip("\n"), "author_name": author[0], "author_email": author[1]}


def patches_of(told: bytes, names: list[str]) -> dict[str, str]:
    """By commit what ``diff-tree --stdin`` gives: a line with its name, then its changes, no line of which is a bare name."""
    known, found, at = set(names), {n: [] for n in names}, ""
    for line in told.decode("utf-8", "replace").split("\n"):
        if line in known:
            at = line
        elif at:
            found[at].append(line)
    return {n: "\n".join(lines) for n, lines in found.items()}


def scan(spark: SparkSession, repository: str, most: int = 300) -> DataFrame:
    """A row per commit, the latest first, merges left out: source_uri, title, timestamp, author_name, author_email, sha, repo, fingerprint, text. FileNotFoundError without a repository."""
    if not (Path(repository) / ".git").exists():
        raise FileNotFoundError(f"{repository} is no git repository")
    root = str(Path(repository).resolve())
    names = [(n,) for n in _ask(root, ["rev-list", "--no-merges", f"--max-count={most}", "HEAD"]).decode().split()]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for asked in frames:
            shas = asked["sha"].tolist()
            listed = "".join(f"{n}\n" for n in shas)
            commits = pd.DataFrame([commit_of(c) for c in objects_of(_ask(root, ["cat-file", "--batch"], listed))])
            patches = patches_of(_ask(root, ["diff-tree", "--stdin", "--root", "--patch", "--stat"], listed), shas)
            yield commits.assign(sha=shas, patch=[patches[n] for n in shas])[[c.split()[0] for c in COMMITS.split(", ")]]

    rows = spark.createDataFrame(names, "sha string").mapInPandas(read, COMMITS)
    text = F.regexp_replace(F.concat(F.lit("commit: "), "subject", F.lit("\n\n"), "body", F.lit("\n\n"), "patch"), r"(?U)^\s+|\s+$", "")
    found = rows.withColumn("text", text).withColumn("repo", F.lit(root))
    return found.select(
        F.concat(F.lit(root + "@"), "sha").alias("source_uri"), F.substring("subject", 1, TITLE_CHARS).alias("title"), "timestamp", "author_name", "author_email", "sha", "repo", fingerprint(F.col("text")).alias("fingerprint"), "text"
    )


def by_author(scanned: DataFrame, name: str, email: str) -> tuple[DataFrame, DataFrame]:
    """(commits of the author, source_uri of the others): what is stored of the others goes."""
    mine = F.coalesce((F.col("author_name") == name) & (F.col("author_email") == email), F.lit(False))
    return scanned.where(mine), scanned.where(~mine).select("source_uri")
