"""The engine as what agent frameworks call: a retriever of documents, tools with their schemas, and a chat memory.

Documents are plain objects with page_content and metadata, tools are functions with a JSON schema of their arguments, so that any framework can wrap
them. Each call is one query, whose few rows come to the caller.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import functions as F

from .engine import Engine
from .operators import context


@dataclass
class Document:
    page_content: str
    metadata: dict = field(default_factory=dict)


class Retriever:
    """Documents of a query, best first: signature, comment and identifiers of a node, or a memory's label where no source is indexed."""

    def __init__(self, engine: Engine, top_k: int = 5) -> None:
        self.engine, self.top_k = engine, top_k

    def invoke(self, query: str) -> list[Document]:
        e = self.engine
        q = e.spark.createDataFrame([(1, query)], "query_id int, text string")
        if e.nodes.isEmpty():
            found = e.search_nodes(q, self.top_k).join(e.memories.select(F.col("id").alias("node_id"), "label", "kind", "created_at"), "node_id")
            return [Document(r.label, {"node_id": r.node_id, "name": r.label, "kind": r.kind, "score": r.score, "created_at": r.created_at}) for r in found.orderBy("rank").collect()]
        ranked = e.search(q).where(F.col("rank") <= self.top_k).select("node_id", "score", "rank")
        rows = ranked.join(e.nodes.drop("text"), "node_id").orderBy("rank").collect()
        parts = [[r.signature, r.doc_comment, ", ".join(r.identifiers or [])] for r in rows]
        names = ("node_id", "name", "kind", "file_path", "signature", "start_line", "end_line", "score")
        return [Document("\n".join(x for x in p if x) or r.name, {k: r[k] for k in names}) for p, r in zip(parts, rows, strict=True)]

    get_relevant_documents = invoke


@dataclass
class Tool:
    """A function of keyword arguments that gives text, with its description and the schema of its arguments."""

    name: str
    description: str
    arguments: dict[str, str]
    run: Callable[..., str]

    def schema(self) -> dict:
        kinds = {k: {"type": "integer" if v.startswith("number") else "string", "description": v} for k, v in self.arguments.items()}
        return {"name": self.name, "description": self.description, "parameters": {"type": "object", "properties": kinds, "required": [k for k, v in self.arguments.items() if "optional" not in v]}}

    def __call__(self, **given) -> str:
        unknown = set(given) - set(self.arguments)
        if unknown:
            raise TypeError(f"{self.name} takes no {', '.join(sorted(unknown))}")
        return self.run(**given)


def tools(engine: Engine, now: Callable[[], float] = time.time) -> dict[str, Tool]:
    """The engine's verbs for function calling, by name; results are lines of JSON, or text for a bundle."""
    spark = engine.spark
    asked = lambda text: spark.createDataFrame([(1, text)], "query_id int, text string")
    lines = lambda df: "\n".join(df.toJSON().take(1000))
    key = lambda name: engine.find_nodes(spark.createDataFrame([(1, name)], "query_id int, key string"))

    def remember(content: str, session: str = "tool") -> str:
        notes = spark.createDataFrame([(session, int(now()), "user", content)], "session_id string, turn_index long, role string, content string")
        return f"{engine.remember_turn(notes, 'tool', '', int(now())).count()} remembered"

    made = [
        Tool("get_context", "Code and documentation for a question, within a budget of tokens.", {"query": "the question"}, lambda query: "\n".join(r.text for r in context.as_text(engine.query(asked(query))).collect())),
        Tool("search_code", "Ranked definitions and sections for a question.", {"query": "the question", "limit": "number of results, optional"}, lambda query, limit=10: lines(engine.search(asked(query)).where(F.col("rank") <= limit).join(engine.nodes.select("node_id", "name", "kind"), "node_id").select("rank", "name", "kind", "file_path", "score").orderBy("rank"))),
        Tool("read_file_topology", "What a definition or file calls, contains and is used by.", {"name": "a definition's name or id, or a file"}, lambda name: lines(engine.topology(key(name).select("node_id")).select("direction", "edge_type", "name", "file_path").distinct())),
        Tool("recall_history", "What earlier conversations said about something.", {"query": "what to look for", "limit": "number of results, optional"}, lambda query, limit=5: lines(engine.memory_section(asked(query), int(now()), limit).orderBy("rank"))),
        Tool("remember_turn", "Keeps a note for later conversations.", {"content": "the note", "session": "a session's name, optional"}, remember),
        Tool("repo_summary", "Languages, conventions and entry points.", {}, lambda: lines(engine.repo_summary())),
    ]
    return {t.name: t for t in made}


class ChatMemory:
    """A user's messages: what is said is kept, what fits a question comes back."""

    def __init__(self, engine: Engine, user_id: str, limit: int = 5) -> None:
        self.engine, self.user_id, self.limit = engine, user_id, limit

    def save_context(self, said: str, answered: str, now: int) -> None:
        rows = [(self.user_id, "user", said), (self.user_id, "assistant", answered)]
        self.engine.add_messages(self.engine.spark.createDataFrame(rows, "user_id string, role string, content string"), now)

    def load_memory_variables(self, query: str) -> dict[str, str]:
        e = self.engine
        found = e.search_nodes(e.spark.createDataFrame([(1, query)], "query_id int, text string"), self.limit, self.user_id)
        rows = found.join(e.memories.select(F.col("id").alias("node_id"), "label", "attributes"), "node_id").orderBy("rank").collect()
        return {"history": "\n".join(f"{r.attributes['role']}: {r.label}" for r in rows)}

    def clear(self) -> None:
        self.engine.delete_all(self.user_id)


def as_json(documents: list[Document]) -> str:
    return json.dumps([{"page_content": d.page_content, "metadata": d.metadata} for d in documents], ensure_ascii=False)
