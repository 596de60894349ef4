"""A small workspace to try the engine on: notes, a repository, evaluation queries and uses, the same every time."""

from __future__ import annotations

import os
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Who commits in the sample repository, and what evaluation queries of the sample begin with.
AUTHOR, EMAIL, PREFIX = "Sample Author", "sample@example.org", "[sample] "
NOTES = {
    "rivers/locks.md": "Date: 2026-01-05\n# Locks\n\nA lock lifts boats between two levels of a canal.\n\nIts gates close by the weight of the water.",
    "rivers/weirs.md": "---\ndate: 2026-01-06\n---\n# Weirs\n\nA weir holds a river back, so that a lock above it has enough water.",
    "rivers/boats.md": "---\ncreated: 2026-02-10\n---\n# Boats\n\n* Barges carry gravel.\n* Rowing boats are carried around weirs.",
    "garden/pears.md": "Date: 2026-01-20\n# Pears\n\nPear trees are grafted in late winter.",
    "garden/diary.md": "# Diary\n\nThe pears were grafted. Then we rowed to the lock.",
}
#: (day, message, {file: text}) of each commit.
COMMITS = [
    ("2026-01-10", "Add the lock table", {"locks.csv": "name,metres\nupper,3\nlower,2\n"}),
    ("2026-01-12", "Correct the upper lock", {"locks.csv": "name,metres\nupper,4\nlower,2\n"}),
    ("2026-02-11", "Add barge lengths", {"barges.csv": "name,metres\ngravel,38\n"}),
]
#: (query, notes that answer it; none: it is to be refused)
QUERIES = [
    ("how does a lock lift boats between levels", ["rivers/locks.md"]),
    ("what holds a river back above a lock", ["rivers/weirs.md"]),
    ("when are pear trees grafted", ["garden/pears.md", "garden/diary.md"]),
    ("barges that carry gravel", ["rivers/boats.md"]),
    ("the price of tulips in spring", []),
]
#: (note, event type, day) of uses.
USES = [("rivers/locks.md", "retrieval_hit", "2026-01-08"), ("rivers/locks.md", "open", "2026-01-09"), ("rivers/locks.md", "accepted_answer", "2026-02-01"), ("garden/pears.md", "open", "2026-01-25")]


def seed(folder: str) -> tuple[str, str]:
    """(folder of notes, repository) below ``folder``, made where they aren't there."""
    vault, repository = Path(folder) / "vault", Path(folder) / "repository"
    for name, text in NOTES.items():
        (vault / name).parent.mkdir(parents=True, exist_ok=True)
        (vault / name).write_text(text, encoding="utf-8")
    if not (repository / ".git").exists():
        repository.mkdir(parents=True, exist_ok=True)

        def git(*arguments: str, **environment: str) -> None:
            subprocess.run(["git", "-C", str(repository), *arguments], check=True, capture_output=True, env={"PATH": os.environ.get("PATH", "/usr/bin:/bin"), "HOME": str(repository), "GIT_CONFIG_GLOBAL": os.devnull, **environment})

        git("init", "-q")
        for day, message, written in COMMITS:
            for name, text in written.items():
                (repository / name).write_text(text, encoding="utf-8")
            at = f"{day}T12:00:00+00:00"
            git("add", "-A")
            git("commit", "-q", "-m", message, GIT_AUTHOR_NAME=AUTHOR, GIT_AUTHOR_EMAIL=EMAIL, GIT_AUTHOR_DATE=at, GIT_COMMITTER_NAME=AUTHOR, GIT_COMMITTER_EMAIL=EMAIL, GIT_COMMITTER_DATE=at)
    return str(vault.resolve()), str(repository.resolve())


def queries(spark: SparkSession, vault: str) -> DataFrame:
    """query_text, expected_source_uris of the sample."""
    return spark.createDataFrame([(PREFIX + q, [f"{vault}/{n}" for n in notes]) for q, notes in QUERIES], "query_text string, expected_source_uris array<string>")


def uses(sources: DataFrame, chunks: DataFrame, vault: str) -> DataFrame:
    """target_kind, target_id, event_type, event_at: the sample's uses, for every chunk of their notes."""
    rows = sources.sparkSession.createDataFrame([(f"{vault}/{n}", t, d) for n, t, d in USES], "source_uri string, event_type string, day string")
    held = sources.select(F.col("id").alias("source_id"), "source_uri").join(rows, "source_uri").join(chunks.select("source_id", "chunk_id"), "source_id")
    return held.select(F.lit("chunk").alias("target_kind"), F.col("chunk_id").alias("target_id"), "event_type", F.col("day").cast("timestamp").alias("event_at"))
