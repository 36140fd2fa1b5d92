"""Event memory: turns to events, deduplication, recall, periods, retention and garbage collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import day_label, node_id, scrubbed, stripped
from .literals import holding

DAY = 86400
MAX_CHARS = 8000
#: Events of a bounded search that the driver may hold: 16 MB of text.
HELD = 2000


def paired_turns(messages: DataFrame) -> DataFrame:
    """session_id, turn_index, prompt, reply from messages(session_id, pos, role, text).

    Every assistant message is a turn; its prompt is the last user message since the assistant
    message before. Turns count from 0 in each session.
    """
    order = W.partitionBy("session_id").orderBy("pos")
    answered = F.coalesce(F.count_if(F.col("role") == "assistant").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = messages.withColumn("turn_index", answered)
    turns = rows.where("role in ('user', 'assistant')").groupBy("session_id", "turn_index").agg(
        F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("pos"))).alias("prompt"),
        F.max(F.when(F.col("role") == "assistant", F.struct("pos", "text"))).alias("a"),
    )
    return turns.where("a is not null").select("session_id", "turn_index", F.coalesce("prompt", F.lit("")).alias("prompt"), F.col("a.text").alias("reply"), F.col("a.pos").alias("pos"))


def events_from_turns(turns: DataFrame, source: str, repo_id: str, now: int) -> DataFrame:
    """Memory events of turns(session_id, turn_index, prompt, reply[, timestamp, files, tools]): secrets scrubbed, hashed, bounded."""
    have = set(turns.columns)
    files, tools = (F.coalesce(F.col(c), F.array().cast("array<string>")) if c in have else F.array().cast("array<string>") for c in ("files", "tools"))
    ts = F.coalesce(F.col("timestamp"), F.lit(0)) if "timestamp" in have else F.lit(0)
    rows = turns.withColumn("p", scrubbed(F.coalesce("prompt", F.lit("")))).withColumn("r", scrubbed(F.coalesce("reply", F.lit(""))))
    content = F.concat_ws("\n", F.when(F.col("p.text") != "", F.concat(F.lit("User: "), F.col("p.text"))), F.when(F.col("r.text") != "", F.concat(F.lit("Assistant: "), F.col("r.text"))))
    return rows.select(
        node_id(F.lit(source), F.col("session_id").cast("string"), F.col("turn_index").cast("string")).alias("id"),
        F.lit(repo_id).alias("repo_id"),
        F.lit(source).alias("source"),
        F.col("session_id").cast("string").alias("session_id"),
        F.col("turn_index").cast("long").alias("turn_index"),
        F.substring(content, 1, MAX_CHARS).alias("content"),
        F.substring(F.sha2(F.concat(F.coalesce("prompt", F.lit("")), F.coalesce("reply", F.lit(""))), 256), 1, 32).alias("content_hash"),
        F.when(ts == 0, F.lit(now)).otherwise(ts).cast("long").alias("created_at"),
        F.lit(0).alias("importance"),
        F.lit(False).alias("pinned"),
        files.alias("files_touched"),
        tools.alias("tool_calls"),
        (F.col("p.n") + F.col("r.n")).alias("redactions"),
    )


def fresh(events: DataFrame, store: DataFrame) -> DataFrame:
    """Events with content whose (repo_id, content_hash) the store doesn't have."""
    return events.where(F.trim("content") != "").join(store.select("repo_id", "content_hash").distinct(), ["repo_id", "content_hash"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old with the rows of new put in place of those with their key."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def delete(old: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return old.join(ids.select(key).distinct(), key, "left_anti")


def discussed_edges(events: DataFrame, nodes: DataFrame, prefix: str = "") -> DataFrame:
    """Edges from events to the nodes of files they touched."""
    files = events.select(F.col("id").alias("src_id"), F.explode("files_touched").alias("f"))
    path = F.ltrim(F.when(F.startswith("f", F.lit(prefix)), F.substring(F.col("f"), len(prefix) + 1, 1 << 30)).otherwise(F.col("f")), F.lit("/"))
    rows = files.select("src_id", path.alias("file_path")).distinct().join(nodes.select(F.col("node_id").alias("dst_id"), "file_path"), "file_path")
    return rows.select("src_id", "dst_id", F.lit("discussed").alias("edge_type"), F.lit(1).alias("confidence"))


def recency_boost(created_at: Column, now: int) -> Column:
    """0.01 for now, falling with the days (fractions count)."""
    return 0.01 / (1 + 0.1 * (F.lit(now) - created_at) / F.lit(float(DAY)))


def recall_literal(content: Column, query: Column) -> Column:
    """1 if the content holds the whole query, else 0.05 for each term of 3 bytes or more that it holds."""
    q = F.lower(F.trim(query))
    terms = F.filter(F.split(q, r"\s+"), lambda t: F.octet_length(t) >= 3)
    # the content as a variable, so that it is put in lower case once and not for every term
    return F.transform(F.array(F.lower(content)), lambda c: F.when(F.contains(c, q), 1.0).otherwise(0.05 * F.size(F.filter(terms, lambda t: F.contains(c, t)))))[0]


def recall(ranked: DataFrame, events: DataFrame, queries: DataFrame, now: int, limit: int, days: int = 90, most: int | None = 1000) -> DataFrame:
    """query_id, id, score, rank: fused rows with recency and literal boosts; literal matches that weren't ranked enter at 2.

    ranked: query_id, node_id (an event id), score. Literal matches are looked for among the
    newest `most` events of the last `days`, or among all of these days' with most=None.
    """
    latest = events.where((F.col("created_at") >= now - days * DAY) & (F.col("created_at") <= now))
    if most is not None:
        latest = latest.orderBy(F.desc("created_at"), "id").limit(most)
    latest = latest.select("id", "content")
    if most is not None and most <= HELD:
        # so few are read once and not again for each step of the matching
        latest = events.sparkSession.createDataFrame(latest.toArrow())
    found = holding(latest, "id", F.lower("content"), queries.select("query_id", F.col("text").alias("query")), F.lower(F.trim("query")))
    base = ranked.select("query_id", F.col("node_id").alias("id"), "score")
    missing = found.select("query_id", "id").join(base, ["query_id", "id"], "left_anti").withColumn("score", F.lit(2.0))
    rows = base.unionByName(missing).join(events.select("id", "created_at", "content"), "id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    score = F.round(F.col("score") + recency_boost(F.col("created_at"), now) + recall_literal(F.col("content"), F.col("query")), 6)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return rows.select("query_id", "id", score.alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def summarize_period(events: DataFrame, start: int, end: int, n: int, focus: DataFrame | None = None, repo_id: str | None = None) -> DataFrame:
    """The n newest events of a period, both ends included, of one repository if it is named.

    focus: ranked ids (id, rank) of a search; of its first 4n those in the period count, so the limit comes before the filter.
    """
    events = scoped(events, repo_id)
    if focus is not None:
        events = events.join(focus.where(F.col("rank") <= 4 * n).select("id").distinct(), "id", "left_semi")
    return events.where(F.col("created_at").between(start, end)).orderBy(F.desc("created_at"), "id").limit(n)


def scoped(events: DataFrame, repo_id: str | None = None, user_id: str | None = None) -> DataFrame:
    """Events of a repository, of a user (by attribute), or of both; all of them where neither is named or the column is missing."""
    if repo_id is not None and "repo_id" in events.columns:
        events = events.where(F.col("repo_id") == repo_id)
    if user_id is not None and "attributes" in events.columns:
        events = events.where(F.try_element_at("attributes", F.lit("user_id")) == user_id)
    return events


def collect_garbage(events: DataFrame, now: int, retention_days: int = 30, max_events: int = 200_000, raw_days: int | None = None) -> DataFrame:
    """events with why each goes: expired, raw_expired, over_limit, or null if it stays.

    Expired: unpinned and older than the retention. Raw turns (event_type 'turn') may have a shorter one. Then the oldest unpinned go until no more
    than max_events stay (pinned ones count, but don't go). How many fall on each day and then on each second of the day of the cut
    says where it is, and ranges of ids do so within that second; only events of the last range are put in order, by id.
    """
    expired = ~F.col("pinned") & (F.col("created_at") < now - retention_days * DAY)
    raw = F.lit(False)
    if raw_days is not None and raw_days < retention_days:
        raw = ~F.col("pinned") & (F.col("event_type") == "turn") & (F.col("created_at") < now - raw_days * DAY)
    gone = F.when(expired, "expired").when(raw, "raw_expired")
    left = events.where(gone.isNull())
    over = left.agg((F.count("*") - max_events).alias("over"))
    free = left.where(~F.col("pinned")).select("created_at", "id")

    def cut(counts: DataFrame, base: str) -> DataFrame:
        """The first t at which `base` and the counts up to it reach `over`: t, below."""
        upto = F.sum("n").over(W.orderBy("t")) + F.col(base)
        return counts.withColumn("upto", upto).where(F.col("upto") >= F.col("over")).orderBy("t").limit(1).select("t", (F.col("upto") - F.col("n")).alias("below"), "over")

    day = F.floor(F.col("created_at") / DAY)
    days = free.groupBy(day.alias("t")).agg(F.count("*").alias("n")).join(F.broadcast(over.where("over > 0"))).withColumn("base", F.lit(0))  # one row
    of_day = cut(days, "base").select(F.col("t").alias("day"), F.col("below").alias("base"), "over")
    seconds = free.join(F.broadcast(of_day), day == F.col("day")).groupBy(F.col("created_at").alias("t"), "base", "over").agg(F.count("*").alias("n"))
    at = cut(seconds, "base").select(F.col("t").alias("cut_at"), (F.col("over") - F.col("below")).alias("rest"))
    # at the cut's second the least ids go, found the same way by ranges of ids; without a cut nobody does
    ranges = F.substring("id", 1, 4) if dict(events.dtypes)["id"] == "string" else F.floor(F.col("id") / 4096)
    inside = free.join(F.broadcast(at), F.col("created_at") == F.col("cut_at")).select("id", "rest", ranges.alias("part"))
    parts = inside.groupBy(F.col("part").alias("t"), F.lit(0).alias("base"), F.col("rest").alias("over")).agg(F.count("*").alias("n"))
    of_part = cut(parts, "base").select(F.col("t").alias("cut_part"), (F.col("over") - F.col("below")).alias("rest_part"))
    inside = inside.join(F.broadcast(of_part), F.col("part") <= F.col("cut_part"))  # one row
    last = inside.where("part = cut_part").withColumn("k", F.row_number().over(W.orderBy("id"))).where("k <= rest_part")
    near = inside.where("part < cut_part").select(F.col("id").alias("id1")).unionByName(last.select(F.col("id").alias("id1")))
    one = over.join(at, how="left").select(F.when(F.col("over") > 0, F.coalesce("cut_at", F.lit(2**62))).alias("cut_at"))  # one row
    rows = events.withColumn("gone", gone).join(F.broadcast(one)).join(near, F.col("id") == F.col("id1"), "left")
    oldest = F.col("gone").isNull() & ~F.col("pinned") & ((F.col("created_at") < F.col("cut_at")) | F.col("id1").isNotNull())
    return rows.withColumn("gone", F.when(oldest, "over_limit").otherwise(F.col("gone"))).drop("cut_at", "id1")


def garbage_counts(marked: DataFrame) -> DataFrame:
    """One row: how many events go, by why."""
    kinds = ("expired", "raw_expired", "over_limit")
    return marked.agg(*[F.count_if(F.col("gone") == k).alias(k) for k in kinds], F.count("gone").alias("total"))


def status(events: DataFrame) -> DataFrame:
    """source, events, sessions, pinned, first and last time of each source of events."""
    return events.groupBy("source").agg(F.count("*").alias("events"), F.count_distinct("session_id").alias("sessions"), F.count_if("pinned").alias("pinned"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def remembered(notes: DataFrame, source: str, repo_id: str, now: int) -> DataFrame:
    """Single events of notes(session_id, turn_index, role, content[, importance, pinned, files]): trimmed, scrubbed, hashed; empty ones go. Importance is 50 where it isn't said."""
    have = set(notes.columns)
    files = F.coalesce(F.col("files"), F.array().cast("array<string>")) if "files" in have else F.array().cast("array<string>")
    text = stripped(F.coalesce("content", F.lit("")))
    rows = notes.withColumn("s", scrubbed(text)).where(text != "")
    return rows.select(
        node_id(F.lit(source), F.col("session_id").cast("string"), F.col("turn_index").cast("string"), F.col("role")).alias("id"),
        F.lit(repo_id).alias("repo_id"),
        F.lit(source).alias("source"),
        F.col("session_id").cast("string").alias("session_id"),
        F.col("turn_index").cast("long").alias("turn_index"),
        F.substring("s.text", 1, MAX_CHARS).alias("content"),
        F.substring(F.sha2(text, 256), 1, 32).alias("content_hash"),
        F.lit(now).cast("long").alias("created_at"),
        (F.coalesce(F.col("importance"), F.lit(50)) if "importance" in have else F.lit(50)).cast("int").alias("importance"),
        (F.coalesce(F.col("pinned"), F.lit(False)) if "pinned" in have else F.lit(False)).alias("pinned"),
        files.alias("files_touched"),
        F.array().cast("array<string>").alias("tool_calls"),
        F.col("s.n").alias("redactions"),
    )


def memories(messages: DataFrame, now: int) -> DataFrame:
    """Nodes of messages(user_id, role, content): id, kind, domain, label, text, attributes, created_at; messages without content go."""
    content = F.col("content")
    role = F.coalesce(F.col("role"), F.lit("user"))
    key = F.concat_ws(":", F.lit("memory"), "user_id", F.lit(str(now)), F.substring(content, 1, 100))
    return messages.where(F.coalesce(content, F.lit("")) != "").select(
        F.substring(F.sha2(key, 256), 1, 32).alias("id"),
        F.lit("message").alias("kind"),
        F.lit("conversation").alias("domain"),
        F.when(F.length(content) > 200, F.concat(F.substring(content, 1, 200), F.lit("..."))).otherwise(content).alias("label"),
        F.concat_ws(" ", "user_id", "content").alias("text"),
        F.create_map(F.lit("user_id"), "user_id", F.lit("role"), role).alias("attributes"),
        F.lit(now).cast("long").alias("created_at"),
    )


def snippets(recalled: DataFrame, events: DataFrame, now: int, most: int = 200) -> DataFrame:
    """query_id, rank, id, when, source, snippet: what a bundle shows of recalled events."""
    rows = recalled.join(events.select("id", "created_at", "source", "content"), "id")
    cut = F.when(F.length("content") > most, F.concat(F.substring("content", 1, most), F.lit("..."))).otherwise(F.col("content"))
    return rows.select("query_id", "rank", "id", day_label(F.col("created_at"), now).alias("when"), "source", cut.alias("snippet"))


def file_histories(edges: DataFrame, nodes: DataFrame, events: DataFrame, asked: DataFrame) -> DataFrame:
    """file_path, rank and the event's columns for asked(file_path): the events that discussed or triggered a node of it, newest first."""
    own = nodes.join(asked.select("file_path").distinct(), "file_path", "left_semi").select(F.col("node_id").alias("dst_id"), "file_path")
    links = edges.where("edge_type in ('discussed', 'triggered')").join(own, "dst_id").select("file_path", F.col("src_id").alias("id")).distinct()
    order = W.partitionBy("file_path").orderBy(F.desc("created_at"), "id")
    return links.join(events, "id").withColumn("rank", F.row_number().over(order))


def file_history(edges: DataFrame, nodes: DataFrame, events: DataFrame, file_path: str) -> DataFrame:
    """file_histories of one file."""
    asked = nodes.sparkSession.createDataFrame([(file_path,)], "file_path string")
    return file_histories(edges, nodes, events, asked).drop("file_path", "rank").orderBy(F.desc("created_at"), "id")
