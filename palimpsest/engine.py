"""The engine as one object: index, query, remember, recall, summarise."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import paths, text
from .operators import context, embed, enrich, graph, memory, ranking, search
from .sources import chatlogs, code, conversations, documents
from .store import Store, shared_path
from .streaming import ingest

EVENTS = "id string, repo_id string, source string, session_id string, turn_index long, content string, content_hash string, created_at long, importance int, pinned boolean, files_touched array<string>, tool_calls array<string>, redactions long"
NODES = "node_id string, kind string, file_path string, name string, signature string, doc_comment string, identifiers array<string>, start_line long, end_line long, start_byte long, end_byte long, pos int, text string"
EDGES = "src_id string, dst_id string, edge_type string, confidence int"
UNIVERSAL = "id string, kind string, domain string, label string, text string, attributes map<string,string>, created_at long"
TOP_KINDS = ("module", "class", "struct", "trait", "enum", "interface")


@dataclass
class Config:
    """Knobs and their defaults."""

    anchors: int = 5
    budget: int = 4096
    test_penalty: float = 0.85
    penalty_paths: list[str] = field(default_factory=list)
    retention_days: int = 30
    raw_retention_days: int | None = None
    max_events: int = 200_000
    rrf_k: int = 60
    depth: int = 3
    dim: int = 384
    exclude: list[str] | None = None

    @classmethod
    def load(cls, path: str) -> Config:
        """From a TOML file; a missing or malformed file or key leaves the default."""
        import tomllib

        try:
            with open(path, "rb") as f:
                found = tomllib.load(f)
        except (OSError, tomllib.TOMLDecodeError):
            return cls()
        flat = {k: v for part in [found, *(x for x in found.values() if isinstance(x, dict))] for k, v in part.items()}
        return cls(**{k: v for k, v in flat.items() if k in cls.__dataclass_fields__ and not isinstance(v, dict)})


class Engine:
    """Tables of nodes, edges, files, events and memories, and the verbs over them; every verb returns a DataFrame.

    The tables are kept as versions (store.Store) under path, and a later engine on that path has them; without a path they
    are in the session's shared folder and go with the session, so plans never grow with the number of calls. encode, if given, makes vectors (operators.embed) for the search.
    """

    def __init__(self, spark: SparkSession, config: Config | None = None, path: str | None = None, encode: embed.Encoder | None = None) -> None:
        self.spark, self.config, self.encode = spark, config or Config(), encode
        self.store = Store(spark, path or shared_path(spark, "engine"))
        self.parsers: dict[str, Callable[[str, str], list[tuple]]] = {}
        self.index_: search.TextIndex | None = None
        self.refresh()

    def refresh(self) -> None:
        """Reads the last version of every table."""
        empty = lambda schema: self.spark.createDataFrame([], schema)
        read = self.store.read
        self.nodes, self.edges = read("nodes", empty(NODES)), read("edges", empty(EDGES))
        self.files = read("files", empty("file_path string, content string, file_hash string"))
        self.known = read("text_vectors", None)
        self.vectors = None
        if self.known is not None:
            own = self.nodes.select("node_id", embed.hash_of(text.embedding_text(F.col("signature"), F.col("identifiers"), F.col("doc_comment"))).alias("text_hash"))
            self.vectors = own.join(self.known, "text_hash").select("node_id", "vector")
        self.events, self.memories = read("events", empty(EVENTS)), read("memories", empty(UNIVERSAL))
        if self.store.versions("nodes") and self.store.names("index/versions/segments"):
            self.index_ = search.StoredIndex(self.spark, f"{self.store.path}/index").reader()

    def _kept(self, name: str, df: DataFrame) -> DataFrame:
        return self.store.write(name, df)

    def add_parser(self, extension: str, parser: Callable[[str, str], list[tuple]]) -> None:
        """A parser (path, text) -> rows of documents.SCHEMA for files of an extension."""
        self.parsers[extension.lower().lstrip(".")] = parser

    def index(self, root: str) -> DataFrame:
        """Reads a source tree: code definitions and document sections as nodes, and their edges; gives counts of what became of its files."""
        return self.index_files(code.read_files(self.spark, root, self.config.exclude))

    reindex = index

    def index_files(self, files: DataFrame) -> DataFrame:
        """index for files(file_path, content): only new and changed ones are parsed, nodes of deleted ones go, edges are built of all."""
        files = files.select("file_path", "content", F.sha2(F.coalesce("content", F.lit("")), 256).alias("file_hash"))
        old = self.files
        outcome = ingest.manifest_diff(old.select(F.col("file_path").alias("path"), "file_hash"), files.select(F.col("file_path").alias("path"), "file_hash"))
        outcome = self._kept("outcomes", outcome)
        stale = outcome.where("outcome in ('changed', 'deleted')").select(F.col("path").alias("file_path"))
        todo = files.join(outcome.where("outcome in ('added', 'changed')").select(F.col("path").alias("file_path")), "file_path", "left_semi")
        fresh = self._parsed(todo)
        kept = ingest.carried(self.nodes, fresh, self.nodes.join(stale, "file_path", "left_semi"))
        discussed = self.edges.where("edge_type in ('discussed', 'triggered')")
        self.files, self.nodes = self._kept("files", files), self._kept("nodes", kept)
        source = self.nodes.where("kind <> 'doc_section'")
        # references are parsed once too; those of files that changed or are gone go
        known = self.store.read("references", self.spark.createDataFrame([], code.REFS))
        refs = self._kept("references", known.join(stale, "file_path", "left_anti").unionByName(code.extract_references(todo)))
        refs = graph.innermost(refs.withColumn("ref_id", F.concat_ws("|", "file_path", "offset", "name", "kind")), source)
        refs = refs.select(F.col("node_id").alias("src_id"), F.col("file_path").alias("src_file"), "name", "kind")
        built = (
            graph.containment(source)
            .unionByName(graph.call_edges(refs.where("kind = 'call'"), source))
            .unionByName(graph.import_edges(refs.where("kind = 'import'"), source))
            .unionByName(graph.doc_reference_edges(self.nodes))
            .dropDuplicates(["src_id", "dst_id", "edge_type"])
        )
        self.edges = self._kept("edges", built.unionByName(graph.live_memory_edges(discussed, self.nodes).select(*built.columns)))
        self.index_ = search.StoredIndex(self.spark, f"{self.store.path}/index").sync(self.nodes.select("node_id", "text"))
        if self.encode:
            self._embed_nodes()
        return ingest.stats(outcome, self.nodes)

    def _embed_nodes(self) -> None:
        """Vectors of all nodes; only texts that have none are encoded, and vectors of texts that are gone go."""
        texts = self.nodes.select("node_id", text.embedding_text(F.col("signature"), F.col("identifiers"), F.col("doc_comment")).alias("text"))
        own = texts.select("node_id", embed.hash_of(F.col("text")).alias("text_hash"))
        fresh = self._kept("text_vectors_new", embed.missing(texts, self.known, self.encode))
        if self.known is None or not fresh.isEmpty():
            known = fresh if self.known is None else self.known.join(own, "text_hash", "left_semi").unionByName(fresh)
            self.known = self._kept("text_vectors", known)
        self.vectors = own.join(self.known, "text_hash").select("node_id", "vector")

    def _parsed(self, files: DataFrame) -> DataFrame:
        found = graph.dedupe_spans(code.extract_nodes(files)).unionByName(code.extract_sections(files))
        key = text.node_id(F.col("file_path"), F.col("kind"), F.col("signature"), F.col("start_byte").cast("string"))
        made = found.select(key.alias("node_id"), *[c for c in found.columns], text.full_text(F.col("file_path"), F.col("signature"), F.col("identifiers"), F.col("doc_comment")).alias("text"))
        return made.select(*[c.split()[0] for c in NODES.split(", ")])

    def search(self, queries: DataFrame, query_vectors: DataFrame | None = None) -> DataFrame:
        """Ranked nodes of queries(query_id, text): full text, vectors where there are some, fusion, then the ranking's steps."""
        k = 8 * self.config.anchors
        lists = [(search.bm25(self.index_ or self.nodes, queries, k), 1.0)]
        if self.vectors is not None and (query_vectors is not None or self.encode):
            if query_vectors is None:
                asked = queries.select(F.col("query_id").cast("string").alias("node_id"), "text")
                query_vectors = embed.embedded(asked, self.encode).select(F.col("node_id").cast(dict(queries.dtypes)["query_id"]).alias("query_id"), "vector")
            lists.append((search.vector_search(self.vectors, query_vectors, k, self.config.dim), 1.0))
        return ranking.rank_pipeline(search.rrf(lists, self.config.rrf_k), self.nodes, queries, self.config.test_penalty, None, self.config.penalty_paths)

    search_code = search

    def query(self, queries: DataFrame, query_vectors: DataFrame | None = None) -> DataFrame:
        """Token-budgeted bundles: anchors, the graph around them, source text; without an index the nodes' labels."""
        anchors = self.search(queries, query_vectors).where(F.col("rank") <= self.config.anchors)
        costs = self.nodes.select("node_id", F.floor((F.col("end_byte") - F.col("start_byte")) / 4).cast("long").alias("tokens"))
        taken = graph.expand(self.edges, anchors, costs, self.config.budget, self.config.depth)
        included = taken.join(anchors.select("query_id", "node_id", F.lit(True).alias("a")), ["query_id", "node_id"], "left").select("query_id", "node_id", "place", F.coalesce("a", F.lit(False)).alias("is_anchor"))
        return context.assemble(included, self.nodes, self.files)

    get_context = batch_context = query

    def query_in_memory(self, queries: DataFrame) -> DataFrame:
        """A bundle of the labels of memories, where no source is indexed."""
        n = self.memories.select(F.col("id").alias("node_id"), "text", "label")
        return context.label_bundle(search.naive_search(n, queries, self.config.anchors), n)

    # memory of turns

    def remember(self, turns: DataFrame, source: str, repo_id: str, now: int) -> DataFrame:
        """Adds turns to the memory, without those whose content it has, with their edges to nodes; gives what was added."""
        return self._add_events(memory.events_from_turns(turns, source, repo_id, now))

    def remember_turn(self, notes: DataFrame, source: str, repo_id: str, now: int) -> DataFrame:
        """Adds single notes (memory.remembered)."""
        return self._add_events(memory.remembered(notes, source, repo_id, now))

    def _add_events(self, events: DataFrame) -> DataFrame:
        new = memory.fresh(events, self.events)
        # written before the table it is compared with changes
        new = self.store.write("added_events", new)
        self.events = self._kept("events", memory.upsert(self.events, new))
        links = memory.discussed_edges(new, self.nodes).select(*self.edges.columns)
        self.edges = self._kept("edges", self.edges.unionByName(links).dropDuplicates(["src_id", "dst_id", "edge_type"]))
        return new

    def sync_logs(self, folder: str, repo_id: str, now: int, cooldown: int = 60, source: str = "jsonl") -> DataFrame | None:
        """Takes the turns that ended in a folder's JSON-lines logs since the last time into the memory, each once; None within the cooldown's seconds of the last time.

        Meant to run before a read: offsets stay in a checkpoint beside the tables. A turn's number is the place of its answer in its log.
        """
        last = self.store.read("synced")
        if last is not None and now - last.agg(F.max("at")).first()[0] < cooldown:
            return None
        self.store.write("synced", self.spark.createDataFrame([(now,)], "at long"))
        self.spark.dataSource.register(chatlogs.LogSource)
        lines, added = self.spark.readStream.format("jsonl_log").option("path", folder).load(), []

        def take(batch: DataFrame, n: int) -> None:
            turns = memory.paired_turns(chatlogs.typed_messages(batch)).withColumn("turn_index", F.col("pos"))
            added.append(self._add_events(memory.events_from_turns(turns, source, repo_id, now)))

        name = text.node_id(F.lit(folder), F.lit(repo_id))
        name = self.spark.range(1).select(name).first()[0]
        lines.writeStream.foreachBatch(take).option("checkpointLocation", f"{self.store.path}/sync-{name}").trigger(availableNow=True).start().awaitTermination()
        return added[-1] if added else self.events.limit(0)

    def recall(self, queries: DataFrame, now: int, limit: int = 10, repo_id: str | None = None) -> DataFrame:
        """Ranked events: full text and vectors, fused; recency and literal matches count."""
        events = memory.scoped(self.events, repo_id)
        nodes = events.select(F.col("id").alias("node_id"), F.col("content").alias("text"))
        lists = [(search.bm25(nodes, queries, 3 * limit), 1.0)]
        if self.encode:
            asked = queries.select(F.col("query_id").cast("string").alias("node_id"), "text")
            vectors = embed.embedded(asked, self.encode).select(F.col("node_id").cast(dict(queries.dtypes)["query_id"]).alias("query_id"), "vector")
            lists.append((search.vector_search(embed.embedded(nodes, self.encode), vectors, 3 * limit, self.config.dim), 1.0))
        return memory.recall(search.rrf(lists, self.config.rrf_k), events, queries, now, limit)

    recall_history = recall

    def memory_section(self, queries: DataFrame, now: int, most: int = 5) -> DataFrame:
        """The snippets of recalled events that stand beside a bundle."""
        return memory.snippets(self.recall(queries, now, most), self.events, now)

    def summarize_period(self, start: int, end: int, n: int = 5, focus: str | None = None, repo_id: str | None = None) -> DataFrame:
        """The newest events of a period; of those a search for the focus finds, if there is one."""
        found = None
        if focus:
            q = self.spark.createDataFrame([(1, focus)], "query_id int, text string")
            nodes = memory.scoped(self.events, repo_id).select(F.col("id").alias("node_id"), F.col("content").alias("text"))
            found = search.bm25(nodes, q, 4 * n).select(F.col("node_id").alias("id"), "rank")
        return memory.summarize_period(self.events, start, end, n, found, repo_id)

    def file_history(self, file_path: str) -> DataFrame:
        links = memory.discussed_edges(self.events, self.nodes).unionByName(graph.live_memory_edges(self.edges, self.nodes).select("src_id", "dst_id", "edge_type", "confidence"))
        return memory.file_history(links, self.nodes, self.events, file_path)

    get_file_history = file_history

    def collect_garbage(self, now: int, dry_run: bool = False) -> DataFrame:
        """What goes and why; without dry_run it is gone from the memory."""
        marked = memory.collect_garbage(self.events, now, self.config.retention_days, self.config.max_events)
        gone = marked.where("gone is not null")
        if not dry_run:
            gone = self.store.write("collected_events", gone)
            self.events = self._kept("events", marked.where("gone is null").drop("gone"))
        return gone

    def memory_status(self) -> DataFrame:
        return memory.status(self.events)

    # memories of users

    def add(self, content: str, user_id: str, now: int, role: str = "user") -> DataFrame:
        return self.add_messages(self.spark.createDataFrame([(user_id, role, content)], "user_id string, role string, content string"), now)

    def add_messages(self, messages: DataFrame, now: int) -> DataFrame:
        """Adds messages(user_id, role, content); gives their nodes. Messages without content go."""
        new = memory.memories(messages, now)
        self.memories = self._kept("memories", memory.upsert(self.memories, new))
        return new

    def search_nodes(self, queries: DataFrame, limit: int = 10, user_id: str | None = None) -> DataFrame:
        """Memories by the terms of queries(query_id, text), best first; of one user if named."""
        n = memory.scoped(self.memories, user_id=user_id).select(F.col("id").alias("node_id"), "text", "label")
        return search.naive_search(n, queries, limit)

    def add_node(self, nodes: DataFrame) -> None:
        """Adds nodes (columns of the memories table) as they are."""
        self.memories = self._kept("memories", memory.upsert(self.memories, nodes.select(*self.memories.columns)))

    def get_all(self, user_id: str | None = None) -> DataFrame:
        return memory.scoped(self.memories, user_id=user_id)

    def delete(self, ids: DataFrame) -> None:
        """Removes events and memories of ids(id)."""
        self.events = self._kept("events", memory.delete(self.events, ids))
        self.memories = self._kept("memories", memory.delete(self.memories, ids))

    def delete_all(self, user_id: str) -> None:
        self.delete(memory.scoped(self.memories, user_id=user_id).select("id"))

    def nodes_by_domain(self, domain: str, user_id: str | None = None) -> DataFrame:
        return memory.scoped(self.memories, user_id=user_id).where(F.col("domain") == text.domain_of(F.lit(domain)))

    def ingest_conversation(self, files: DataFrame, now: int) -> DataFrame:
        """Session documents files(file_path, content) as nodes and edges of topics, messages, preferences, decisions and entities."""
        nodes, edges = conversations.graph(conversations.sessions(files))
        made = nodes.select(F.col("node_id").alias("id"), "kind", F.lit("conversation").alias("domain"), "label", "text", F.create_map(F.lit("file_path"), "file_path").alias("attributes"), F.lit(now).cast("long").alias("created_at"))
        self.add_node(made)
        self.edges = self._kept("edges", self.edges.unionByName(edges.withColumn("confidence", F.lit(2))))
        return made

    def ingest_documents(self, files: DataFrame) -> DataFrame:
        """Documents files(file_path, content) as sections, facts and citations, by the parsers for their extension, added ones first."""
        return documents.nodes(documents.parse(files, self.parsers))

    # the graph and the repository

    def find_nodes(self, asked: DataFrame) -> DataFrame:
        """The node that each key of asked(query_id, key) names: an id, a name or a file."""
        return graph.looked_up(asked, self.nodes)

    def suggestions(self, asked: DataFrame) -> DataFrame:
        return graph.suggestions(asked, self.nodes)

    def topology(self, node_ids: DataFrame) -> DataFrame:
        """Named neighbours of node_ids(node_id) in both directions."""
        near = graph.both_ways(self.edges).join(node_ids.select(F.col("node_id").alias("node")), "node", "left_semi")
        return near.join(self.nodes.select(F.col("node_id").alias("other"), "name", "file_path"), "other", "left")

    read_file_topology = topology

    def neighbor_signatures(self, owned: DataFrame, max_tokens: int = 2000) -> DataFrame:
        return graph.neighbor_signatures(self.edges, self.nodes, owned, max_tokens)

    def repo_summary(self, max_tokens: int = 500) -> DataFrame:
        """One row: files by language, totals, conventions; entry points, top-level nodes and hotspots while the budget lasts."""
        files = self.nodes.select("file_path").distinct()
        langs = files.groupBy(paths.language_name(F.col("file_path")).alias("language")).agg(F.count("*").alias("files"))
        langs = langs.agg(F.sort_array(F.collect_list(F.struct("files", "language")), asc=False).alias("languages"))
        found = files.agg(paths.conventions(F.col("file_path")).alias("conventions"), F.count("*").alias("total_files"))
        size = self.nodes.agg(F.count("*").alias("total_nodes")).join(self.edges.agg(F.count("*").alias("total_edges")))
        calls = self.edges.where("edge_type = 'call'").groupBy(F.col("dst_id").alias("node_id")).agg(F.count("*").alias("n"))
        degrees = graph.degrees(self.edges).select(F.col("node").alias("node_id"), F.col("total").alias("n"))
        n = self.nodes.select("node_id", "name", "kind", "file_path", "signature", "start_line")

        def best(df: DataFrame, part: int, most: int, *order) -> DataFrame:
            rows = df.orderBy(*order).limit(most).withColumn("at", F.monotonically_increasing_id())
            return rows.select(F.lit(1).alias("group"), (F.col("at") + part * 100 + 1).alias("place"), F.col("node_id").alias("id"), "signature", "name", "kind", "file_path", F.col("n").cast("long").alias("n"))

        lists = best(calls.join(n, "node_id"), 0, 10, F.desc("n"), "node_id").unionByName(best(n.where(F.col("kind").isin(*TOP_KINDS)).withColumn("n", F.lit(0)), 1, 20, "file_path", "start_line", "node_id")).unionByName(best(degrees.join(n, "node_id"), 2, 5, F.desc("n"), "node_id"))
        left = context.budgeted_list(lists, max(max_tokens - 100, 0), 1 << 30).select("place", "left")
        rows = lists.join(left, "place")
        part = lambda k: F.sort_array(F.collect_list(F.when(F.floor(F.col("place") / 100) == k, F.struct("place", "name", "kind", "file_path", "n"))))
        shown = rows.agg(part(0).alias("entry_points"), part(1).alias("top_level"), part(2).alias("hotspots"), (F.lit(max_tokens) - F.coalesce(F.min("left"), F.lit(max(max_tokens - 100, 0)))).alias("estimated_tokens"))
        return langs.join(found).join(size).join(shown)  # one row each

    # enrichment

    def process_brain(self, version: str, done: DataFrame, n: int = 10) -> DataFrame:
        """The next n nodes to summarise that the cache done(key) lacks; public ones come first."""
        from .functions.nodes import is_public_symbol

        urgent = F.when(is_public_symbol(F.col("signature"), F.col("name"), F.col("file_path")), "high").otherwise("low")
        tasks = self.nodes.select("node_id", F.sha2("text", 256).alias("source_hash"), F.lit(version).alias("version"), F.lit("intent_summary").alias("task_type"), urgent.alias("priority"))
        return enrich.next_tasks(tasks, done, n)

    def brain_stats(self, done: DataFrame, most: int = 10_000) -> DataFrame:
        """One row: entries of the cache and how full it is."""
        return done.agg(F.count("*").alias("entries"), F.lit(most).alias("max_entries"), (F.count("*") / most).alias("utilization"))
