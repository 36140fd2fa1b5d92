"""Chat logs to messages: two JSON-lines layouts, a SQLite key-value store, session documents.

The first three give session_id, pos, role, text, timestamp, tools, files; operators.memory pairs
them to turns. Lines that aren't JSON are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.text import json_mentions, timestamp_or_unix

BLOCK = "type string, text string, name string, input map<string,string>"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """session_id (the file's name), at (place of the line in its file), value."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("n"), "value")
    name = F.regexp_replace(F.element_at(F.split("file", "/"), -1), r"\.[^.]*$", "")
    return rows.select(name.alias("session_id"), F.row_number().over(W.partitionBy("file").orderBy("n")).alias("at"), "value")


def _paths_in(command: Column) -> Column:
    return F.filter(F.split(F.coalesce(command, F.lit("")), r"\s+"), lambda x: x.rlike(r"^[\w./-]*/[\w.-]+\.\w+$"))


def typed_messages(rows: DataFrame) -> DataFrame:
    """Messages of lines {"type": "human" | "assistant", "message": {"content": text or blocks}, "timestamp"}."""
    top = F.from_json("value", "type string, message string, timestamp string")
    x = rows.select("session_id", "at", top.alias("j")).where("j.type in ('human', 'assistant')")
    body = F.get_json_object("j.message", "$.content")
    blocks = F.from_json(body, f"array<struct<{BLOCK}>>")
    x = x.withColumn("b", F.when(F.startswith(F.ltrim(body), F.lit("[")), blocks)).withColumn("c", body)
    text = F.when(F.col("b").isNull(), F.col("c")).otherwise(F.array_join(F.transform(F.filter("b", lambda y: y["type"] == "text"), lambda y: y["text"]), "\n"))
    used = F.filter(F.coalesce("b", F.from_json(F.lit("[]"), f"array<struct<{BLOCK}>>")), lambda y: y["type"] == "tool_use")
    files = F.flatten(F.transform(used, lambda y: F.concat(F.array_compact(F.array(F.try_element_at(y["input"], F.lit("file_path")), F.try_element_at(y["input"], F.lit("path")))), _paths_in(F.try_element_at(y["input"], F.lit("command"))))))
    return x.select(
        "session_id",
        F.col("at").alias("pos"),
        F.when(F.col("j.type") == "human", "user").otherwise("assistant").alias("role"),
        F.coalesce(text, F.lit("")).alias("text"),
        timestamp_or_unix(F.col("j.timestamp")).alias("timestamp"),
        F.transform(used, lambda y: y["name"]).alias("tools"),
        F.array_distinct(files).alias("files"),
    )


def session_messages(rows: DataFrame, repo: str = "") -> DataFrame:
    """Messages of lines {"type": "session_meta", "cwd", "session_id"} and {"type": "response_item", "role", "text" | "content", ...}.

    A line belongs to the last session_meta before it in its file; sessions in other folders than repo go.
    """
    j = F.from_json("value", "type string, cwd string, session_id string, role string, text string, content string, timestamp string, tool_calls array<struct<name:string>>")
    x = rows.select(F.col("session_id").alias("file"), "at", j.alias("j")).where("j.type is not null")
    order = W.partitionBy("file").orderBy("at")
    last = lambda c: F.last(F.when(F.col("j.type") == "session_meta", F.col(f"j.{c}")), ignorenulls=True).over(order)
    x = x.withColumn("cwd", F.coalesce(last("cwd"), F.lit(""))).withColumn("session_id", F.coalesce(last("session_id"), F.col("file")))
    x = x.where("j.type = 'response_item' and j.role in ('user', 'assistant')").where((F.col("cwd") == "") | F.contains("cwd", F.lit(repo)))
    tools = F.coalesce(F.transform("j.tool_calls", lambda y: y["name"]), F.array().cast("array<string>"))
    return x.select("session_id", F.col("at").alias("pos"), "j.role", F.coalesce("j.text", "j.content", F.lit("")).alias("text"), timestamp_or_unix(F.col("j.timestamp")).alias("timestamp"), tools.alias("tools"), F.array().cast("array<string>").alias("files"))


class KeyValueReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options = options

    def _last(self) -> int:
        import sqlite3

        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            return db.execute(f"select coalesce(max(rowid), 0) from {self.options.get('table', 'cursorDiskKV')}").fetchone()[0]

    def _ranges(self, first: int, last: int) -> list[InputPartition]:
        """Ranges of row ids, so that a large store is read in parallel."""
        n = int(self.options.get("partitions", "4"))
        cuts = [first + (last - first) * k // n for k in range(n + 1)]
        return [InputPartition((a, b)) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]

    def partitions(self) -> list[InputPartition]:
        return self._ranges(int(self.options.get("after", "0")), self._last())

    def read(self, partition: InputPartition):
        import sqlite3

        a, b = partition.value
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            for rowid, key, value in db.execute(f"select rowid, key, value from {self.options.get('table', 'cursorDiskKV')} where rowid > ? and rowid <= ?", (a, b)):
                yield rowid, key, value.decode("utf-8", "replace") if isinstance(value, bytes) else value


class KeyValueStream(DataSourceStreamReader):
    """The same by micro-batches: an offset is the last row id read. A row that is replaced gets a new id and comes again."""

    def __init__(self, options: dict) -> None:
        self.reader = KeyValueReader(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"rowid": int(self.reader.options.get("after", "0"))}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"rowid": self.reader._last()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.reader._ranges(start["rowid"], end["rowid"])

    def read(self, partition: InputPartition):
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        """Nothing to keep: the checkpoint has the offset."""


class KeyValueSource(DataSource):
    """spark.read or spark.readStream .format("sqlite_kv").option("path", file): rowid, key, value; option after: the row id read so far."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_kv"

    def schema(self) -> str:
        return "rowid long, key string, value string"

    def reader(self, schema) -> KeyValueReader:
        return KeyValueReader(dict(self.options))

    def streamReader(self, schema) -> KeyValueStream:  # noqa: N802
        return KeyValueStream(dict(self.options))


class LogLines(DataSourceStreamReader):
    """Lines of JSON-lines logs under a folder by micro-batches. An offset is, per file, the byte after the last line that ends a turn: what
    comes after it is read again with the rest of its turn, and the offset stays where no turn came out."""

    BLOCK = 1 << 16
    #: Bytes of a log that a task reads.
    PART = 8 << 20

    def __init__(self, options: dict) -> None:
        self.path, self.ends = options["path"], options.get("ends", "assistant").encode()

    def _end(self, file: str) -> int:
        """The byte after the last whole line that has the word that ends turns; found from the end backwards."""
        import os

        with open(file, "rb") as f:
            at = f.seek(0, os.SEEK_END)
            tail, whole = b"", False
            while at > 0:
                size = min(self.BLOCK, at)
                at -= size
                f.seek(at)
                tail = f.read(size) + tail
                if not whole:
                    # what follows the last line end is no whole line yet
                    whole, tail = b"\n" in tail, tail[: tail.rfind(b"\n") + 1] if b"\n" in tail else tail
                    if not whole:
                        continue
                lines = tail.split(b"\n")[:-1]
                end = at + len(tail)
                for k in range(len(lines) - 1, 0 if at else -1, -1):
                    if self.ends in lines[k]:
                        return end
                    end -= len(lines[k]) + 1
                # the first line may begin further up
                tail = lines[0] + b"\n" if lines else b""
        return 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        import glob

        found = {f: self._end(f) for f in sorted(glob.glob(f"{self.path.rstrip('/')}/**/*.jsonl", recursive=True))}
        return {f: n for f, n in found.items() if n}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for file, b in end.items():
            a = start.get(file, 0)
            out += [InputPartition((file, a, x, min(x + self.PART, b))) for x in range(a, b, self.PART)]
        return out

    def read(self, partition: InputPartition):
        import os

        file, first, a, b = partition.value
        with open(file, "rb") as f:
            f.seek(a if a == first else a - 1)
            if a != first:
                f.readline()  # of the part before
            while (at := f.tell()) < b:
                yield os.path.basename(file).rpartition(".")[0], at, f.readline().decode("utf-8", "replace").rstrip("\r\n")

    def commit(self, end: dict) -> None:
        """Nothing to keep: the checkpoint has the offset."""


class LogSource(DataSource):
    """spark.readStream.format("jsonl_log").option("path", folder): session_id (the file's name), at (the line's first byte), value."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_log"

    def schema(self) -> str:
        return "session_id string, at long, value string"

    def streamReader(self, schema) -> LogLines:  # noqa: N802
        return LogLines(dict(self.options))


BUBBLE = "struct<bubbleId:string, type:int, text:string, createdAt:string>"


def _bubble_rows(rows: DataFrame) -> DataFrame:
    """session_id, bubble_id, rowid, value of bubbleId:<id>:<bubble> rows."""
    apart = rows.where(F.startswith("key", F.lit("bubbleId:")))
    return apart.select(F.get(F.split("key", ":"), F.lit(1)).alias("session_id"), F.get(F.split("key", ":"), F.lit(2)).alias("bubble_id"), "rowid", "value")


def composer_messages(rows: DataFrame) -> DataFrame:
    """Messages of key-value rows, by the first layout that a session has: composerData:<id> with bubbles inside; bubbleId:<id>:<bubble> rows in the order of
    the bubbleIds that its composerData lists; those rows in order of row id. Where a bubble has no time the last one before it counts, else its composer's.
    """
    composers = rows.where(F.startswith("key", F.lit("composerData:"))).select(F.substring_index("key", ":", -1).alias("session_id"), F.from_json("value", f"createdAt string, conversation array<{BUBBLE}>, bubbleIds array<string>").alias("j"))
    bubbles = _bubble_rows(rows).select("session_id", "bubble_id", "rowid", F.from_json("value", BUBBLE).alias("b"))
    inline = composers.select("session_id", F.lit(1).alias("way"), F.posexplode("j.conversation").alias("pos", "b"))
    listed = composers.select("session_id", F.posexplode("j.bubbleIds").alias("pos", "bubble_id")).join(bubbles, ["session_id", "bubble_id"]).select("session_id", F.lit(2).alias("way"), "pos", "b")
    found = inline.unionByName(listed).unionByName(bubbles.select("session_id", F.lit(3).alias("way"), F.col("rowid").cast("int").alias("pos"), "b"))
    first = found.groupBy("session_id").agg(F.min("way").alias("way"))
    x = found.join(first, ["session_id", "way"]).join(composers.select("session_id", timestamp_or_unix(F.col("j.createdAt")).alias("made")), "session_id", "left")
    x = as_of(x, "session_id", "pos", F.nullif(timestamp_or_unix(F.col("b.createdAt")), F.lit(0)), "said").where("b.type in (1, 2)")
    none = F.array().cast("array<string>")
    return x.select("session_id", "pos", F.when(F.col("b.type") == 1, "user").otherwise("assistant").alias("role"), F.coalesce("b.text", F.lit("")).alias("text"), F.coalesce("said", "made").alias("timestamp"), none.alias("tools"), none.alias("files"))


def relevant_sessions(rows: DataFrame, repo: str, marker: str) -> DataFrame:
    """session_id, layer of the sessions of key-value rows that belong to a repository, by the first layer that says so.

    1: a string of the composer's record holds the repository's path. 2: a bubble's record holds the marker that the engine leaves. 3: a bubble selects a file under the path (or the
    path is under what it selects), or names the path in its text or in a file's address. A session that none answers for isn't taken: shared logs hold those of other repositories.
    """
    path = F.lit(repo)
    composer = rows.where(F.startswith("key", F.lit("composerData:"))).select(F.substring_index("key", ":", -1).alias("session_id"), F.when(json_mentions(F.col("value"), repo), 1).alias("layer"))
    b = F.from_json("value", "text string, context struct<fileSelections: array<struct<path: string, uri: string>>>")
    chosen = F.exists("b.context.fileSelections", lambda x: F.coalesce(F.contains(x["path"], path) | F.contains(path, x["path"]), F.lit(False)) | F.coalesce(F.contains(x["uri"], path), F.lit(False)))
    said = F.coalesce(chosen, F.lit(False)) | F.coalesce(F.contains(F.col("b.text"), path), F.lit(False))
    bubble = _bubble_rows(rows).withColumn("b", b).select("session_id", F.when(F.contains("value", F.lit(marker)), 2).when(said, 3).alias("layer"))
    known = composer.select("session_id").distinct()
    every = composer.unionByName(bubble.join(known, "session_id", "left_semi")).groupBy("session_id").agg(F.min("layer").alias("layer"))
    return every.where(F.col("layer").isNotNull() & F.lit(bool(repo)))


def as_of(rows: DataFrame, partition: str, order: str, value: Column, name: str) -> DataFrame:
    """rows with the last value at or before each row, in order."""
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(W.partitionBy(partition).orderBy(order)))
