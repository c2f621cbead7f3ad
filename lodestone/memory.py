"""Notes that outlast a session: added, recalled by any of a query's words, taken by id, deleted.

Each note is a small file; a deletion is a mark beside them. compact() writes all live notes as one.
"""

from __future__ import annotations

import hashlib
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import search
from lodestone.session import remove, written
from lodestone.sources.tree import exists

# The categories of notes.
CATEGORIES = ("decision", "discovery", "pattern", "architecture", "note", "general")
_NOTE = "id string, content string, tags array<string>, category string, created_at double"


def query_words(query: str, tags: list[str] | None = None) -> list[str]:
    """The words of a query and tags, without signs; any of them is enough."""
    said = [*query.split(), *(tags or [])]
    return [w for w in (re.sub(r"\W", "", x).lower() for x in said) if w]


class Memory:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def notes(self) -> DataFrame:
        at = f"{self.root}/notes"
        if not exists(self.spark, at):
            return self.spark.createDataFrame([], _NOTE)
        rows = self.spark.read.schema(_NOTE).parquet(at)
        gone = f"{self.root}/deleted"
        return rows.join(self.spark.read.schema("id string").parquet(gone), "id", "left_anti") if exists(self.spark, gone) else rows

    def remember(self, content: str, tags: list[str] | None = None, category: str = "general") -> str:
        now = time.time()
        note = hashlib.sha256(f"{content}{now!r}".encode()).hexdigest()[:16]
        category = category if category in CATEGORIES else "general"
        self.spark.createDataFrame([(note, content, list(tags or []), category, now)], _NOTE).coalesce(1).write.mode("append").parquet(f"{self.root}/notes")
        return note

    def recall(self, query: str, tags: list[str] | None = None, category: str | None = None, limit: int = 10) -> list[dict]:
        """Notes with any of the words in content or tags, best first; category must be equal, tags are more words."""
        words = query_words(query, tags)
        if not words:
            return []
        notes = self.notes()
        rows = notes.select("id", "category", F.concat_ws(" ", "content", F.array_join("tags", " ")).alias("text"))
        asked = self.spark.createDataFrame([(0, words)], "qid long, terms array<string>")
        got = search.fts(rows, asked, limit, F.col("category") == category if category else None)
        return [r.asDict() for r in got.join(notes, "id").orderBy("rank").select("id", "content", "tags", "category", "created_at", "score").collect()]

    def get(self, note: str) -> dict | None:
        r = self.notes().filter(F.col("id") == note).first()
        return r.asDict() if r else None

    def delete(self, note: str) -> bool:
        if self.get(note) is None:
            return False
        self.spark.createDataFrame([(note,)], "id string").coalesce(1).write.mode("append").parquet(f"{self.root}/deleted")
        return True

    def compact(self) -> None:
        live = written(self.notes(), "notes")
        live.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/notes")
        remove(self.spark, f"{self.root}/deleted")
