"""Session documents to a graph: topics, messages, preferences, decisions, entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import approximate_timestamp, cut_at, node_id

FILE = "struct<sessions:array<struct<id:string,timestamp:string,messages:array<struct<role:string,content:string,timestamp:string>>>>>"
_END = r"(?:\.|,|!|\z)"
# Phrases that state a preference (with its sentiment) or a decision; group 1 is the subject.
PREFERENCES = (
    (r"(?idU)I (?:really )?(?:love|enjoy|like|prefer|adore)\s+(.+?)" + _END, "positive"),
    (r"(?idU)I (?:really )?(?:hate|dislike|can't stand|don't like|detest)\s+(.+?)" + _END, "negative"),
    (r"(?idU)I prefer\s+(.+?)\s+(?:over|to|rather than)\s+(.+?)" + _END, "comparative"),
    (r"(?idU)my (?:favorite|favourite)\s+(?:\w+\s+)?(?:is|are)\s+(.+?)" + _END, "positive"),
)
DECISIONS = (
    r"(?idU)(?:let's|let us) (?:go with|use|try|do|pick)\s+(.+?)" + _END,
    r"(?idU)I (?:decided|choose|chose|picked|selected|went with)\s+(.+?)" + _END,
    r"(?idU)(?:we should|I'll|I will|we'll)\s+(.+?)" + _END,
)
# Places by the word before them ((?i) also holds for the name, so lower-case words are found), and names, with a relation before them or not.
PLACE = r"(?iU)(?:moved to|live in|living in|based in|from|visited|traveling to|went to|in)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"
PERSON = r"(?:my (?:friend|sister|brother|wife|husband|partner|colleague|boss|mom|dad|mother|father)\s+)?([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)"
# Capitalised words that name nothing.
COMMON = (
    "The This That These Those Here There When Where What Which Who How Some Any All Most Much Many Few Other Another Each Every Both Such Rather Just Only "
    "Also Then Now Today Tomorrow Yesterday Monday Tuesday Wednesday Thursday Friday Saturday Sunday January February March April May June July August September October "
    "November December But And However Although Since Because So Yet Still"
).split()


def sessions(files: DataFrame) -> DataFrame:
    """file_path, session_at, session_id, timestamp, messages of files(file_path, content)."""
    j = F.from_json("content", FILE)
    x = files.select("file_path", F.posexplode(j["sessions"]).alias("session_at", "s"))
    return x.select("file_path", "session_at", F.col("s.id").alias("session_id"), approximate_timestamp(F.col("s.timestamp")).alias("timestamp"), F.col("s.messages").alias("messages"))


def found(text: Column, rx: str, most: int) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(rx), F.lit(1)), lambda x: F.trim(x)), lambda x: (x != "") & (F.octet_length(x) < most))


def entities(text: Column) -> Column:
    """array of struct(name, type): places, then persons: names after a relation or of two words that aren't among the places."""
    places = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(PLACE), F.lit(1))), lambda x: ~x.isin(*COMMON))
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(PERSON), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(PERSON), F.lit(1)).alias("name"))
    named = F.filter(found, lambda x: F.startswith(x["whole"], F.lit("my ")) | F.contains(x["name"], F.lit(" ")))
    people = F.filter(F.array_distinct(F.transform(named, lambda x: x["name"])), lambda x: ~x.isin(*COMMON) & (F.length(x) > 1))
    kind = lambda xs, k: F.transform(xs, lambda x: F.struct(x.alias("name"), F.lit(k).alias("type")))
    return F.concat(kind(places, "location"), kind(F.array_except(people, places), "person"))


def _with(sentiment: str):
    return lambda x: F.struct(x.alias("subject"), F.lit(sentiment).alias("sentiment"))


def graph(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of sessions: node_id, kind, label, text, file_path; src_id, dst_id, edge_type."""
    topic = node_id(F.concat(F.lit("session:"), F.col("session_id")))
    s = s.withColumn("topic", topic)
    m = s.select("file_path", "session_at", "session_id", "topic", F.posexplode("messages").alias("at", "m"))
    m = m.select("*", F.coalesce("m.role", F.lit("")).alias("role"), F.coalesce("m.content", F.lit("")).alias("text"), node_id(F.concat_ws(":", F.lit("msg"), "session_id", F.col("at").cast("string"))).alias("message"))
    nodes = s.select(F.col("topic").alias("node_id"), F.lit("topic").alias("kind"), F.col("session_id").alias("label"), F.col("session_id").alias("text"), "file_path")
    nodes = nodes.unionByName(m.select(F.col("message").alias("node_id"), F.lit("message").alias("kind"), cut_at(F.col("text"), 100).alias("label"), "text", "file_path"))
    edge = lambda df, a, b, t: df.select(F.col(a).alias("src_id"), F.col(b).alias("dst_id"), F.lit(t).alias("edge_type"))
    before = s.withColumn("prior", F.lag("topic").over(W.partitionBy("file_path").orderBy("session_at"))).where("prior is not null")
    edges = edge(m, "topic", "message", "contain").unionByName(edge(before, "prior", "topic", "followed_by"))
    own = m.where("role = 'user'")
    likes = F.concat(*[F.transform(found(F.col("text"), rx, 100), _with(s_)) for rx, s_ in PREFERENCES])
    prefs = own.select("session_id", "at", "file_path", "message", "text", F.explode(likes).alias("x")).select("*", node_id(F.concat_ws(":", F.lit("pref"), "session_id", F.col("at").cast("string"), "x.subject")).alias("id")).dropDuplicates(["id"])
    nodes = nodes.unionByName(prefs.select(F.col("id").alias("node_id"), F.lit("preference").alias("kind"), F.concat_ws(": ", "x.sentiment", "x.subject").alias("label"), "text", "file_path"))
    edges = edges.unionByName(edge(prefs, "message", "id", "prefers"))
    chosen = F.concat(*[found(F.col("text"), rx, 150) for rx in DECISIONS])
    decs = own.select("session_id", "at", "file_path", "message", "text", F.explode(chosen).alias("x")).select("*", node_id(F.concat_ws(":", F.lit("dec"), "session_id", F.col("at").cast("string"), "x")).alias("id")).dropDuplicates(["id"])
    nodes = nodes.unionByName(decs.select(F.col("id").alias("node_id"), F.lit("decision").alias("kind"), F.col("x").alias("label"), "text", "file_path"))
    edges = edges.unionByName(edge(decs, "message", "id", "decided"))
    ents = own.select("session_at", "at", "file_path", "message", "text", F.explode(entities(F.col("text"))).alias("x"))
    ents = ents.select("*", node_id(F.concat_ws(":", F.lit("entity"), "file_path", "x.name")).alias("id"))
    first = ents.groupBy("id").agg(F.min(F.struct("session_at", "at", "x", "file_path")).alias("e"))
    nodes = nodes.unionByName(first.select(F.col("id").alias("node_id"), F.col("e.x.type").alias("kind"), F.col("e.x.name").alias("label"), F.col("e.x.name").alias("text"), F.col("e.file_path").alias("file_path")))
    return nodes, edges.unionByName(edge(ents.dropDuplicates(["message", "id"]), "message", "id", "mentions"))
