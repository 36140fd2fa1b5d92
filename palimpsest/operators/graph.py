"""Edges from references and spans; degrees, neighbours, reach and budgeted expansion."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import estimated_tokens
from ..store import kept
from .literals import holding

CONTAINERS = ("class", "module", "struct", "trait", "enum", "interface", "doc_section")
#: How specific a kind is where two nodes have one span.
SPECIFICITY = {"method": 4, "function": 3, "class": 2, "struct": 2, "trait": 2, "interface": 2, "enum": 2, "module": 1, "macro": 1, "type": 1, "doc_section": 0}
UNKNOWN, LIKELY, CERTAIN = 0, 1, 2
#: Bytes of a file per bucket of the interval joins.
BUCKET = 1 << 14
#: Pairs of a source and a target that one group of a join by names makes, about.
PAIRS = 1 << 22


def _buckets(start: str, end: str):
    return F.explode(F.sequence(F.floor(F.col(start) / BUCKET), F.floor(F.col(end) / BUCKET)))


def containment(nodes: DataFrame) -> DataFrame:
    """Contain edges: a container holds every other node of its file whose span lies in its own; equal spans: the earlier one holds.

    nodes: node_id, kind, file_path, start_byte, end_byte, pos (input order). An inner node looks in the bucket of
    its start only, containers stand in all buckets they cover, so a large file is many join keys.
    """
    outer = nodes.where(F.col("kind").isin(*CONTAINERS)).select(F.col("node_id").alias("src_id"), "file_path", F.col("start_byte").alias("s"), F.col("end_byte").alias("e"), F.col("pos").alias("p"), _buckets("start_byte", "end_byte").alias("bucket"))
    inner = nodes.withColumn("bucket", F.floor(F.col("start_byte") / BUCKET))
    size, own = F.col("e") - F.col("s"), F.col("end_byte") - F.col("start_byte")
    rows = inner.join(outer, ["file_path", "bucket"]).where((F.col("s") <= F.col("start_byte")) & (F.col("e") >= F.col("end_byte")) & ((size > own) | ((size == own) & (F.col("p") < F.col("pos")))))
    return rows.select("src_id", F.col("node_id").alias("dst_id"), F.lit("contain").alias("edge_type"), F.lit(CERTAIN).alias("confidence")).distinct()


def innermost(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct refs(ref_id, file_path, offset, ...) with node_id: the smallest span around the offset (start in, end out), the earlier of equal ones; refs in no span go."""
    spans = nodes.select("node_id", "file_path", "start_byte", "end_byte", "pos", _buckets("start_byte", "end_byte").alias("bucket"))
    rows = refs.withColumn("bucket", F.floor(F.col("offset") / BUCKET)).join(spans, ["file_path", "bucket"]).where("start_byte <= offset and offset < end_byte")
    best = rows.groupBy(*refs.columns).agg(F.min(F.struct((F.col("end_byte") - F.col("start_byte")).alias("size"), "pos", "node_id")).alias("b"))
    return best.select(*refs.columns, F.col("b.node_id").alias("node_id"))


def _dealt(m: Column, n: Column, most: int) -> tuple[Column, Column]:
    """Rows and columns of the grid that deals a name's m sources and n targets to cells of about PAIRS pairs, at most about `most` cells.

    A source goes to a cell of each column and a target to one of each row, so that copies grow with the square root of the cells and not with the cells.
    """
    cells = F.least(F.ceil(m.cast("double") * n / PAIRS), F.lit(most)).cast("int")
    columns = F.greatest(F.least(cells, F.round(F.sqrt(cells * n / F.greatest(m, F.lit(1))))), F.lit(1)).cast("int")
    none = (m == 0) | (n == 0)
    return F.when(none, 0).otherwise(F.ceil(cells / columns)).cast("int"), F.when(none, 0).otherwise(columns).cast("int")


def _resolved(refs: DataFrame, targets: DataFrame, edge_type: str, confidence: Column, loops: bool = False) -> DataFrame:
    """Distinct edges from refs(src_id, name, ...) to the targets(dst_id, name, ...) of their name, of which there are n.

    Common names make pairs without number, so pairs are not put together to be told apart: references and targets are distinct before they meet, and where
    a target has one name and file and a source names it from one file, their pair comes once. Only pairs of the others are compared.
    """
    held = int(refs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    refs, targets = refs.where("name IS NOT NULL").distinct(), targets.where("name IS NOT NULL")
    refs = refs.withColumn("alike", F.count("*").over(W.partitionBy("src_id", "name")) if len(refs.columns) > 2 else F.lit(1))
    # one exchange, by dst_id, is for the grouping and the window
    targets = targets.repartition("dst_id").groupBy(*targets.columns).agg(F.count("*").alias("copies")).withColumn("names", F.count("*").over(W.partitionBy("dst_id")))
    n = targets.groupBy("name").agg(F.sum("copies").alias("n"), F.count_if(F.col("names") == 1).alias("n1"), F.count_if(F.col("names") > 1).alias("n2"))
    m = refs.groupBy("name").agg(F.count_if(F.col("alike") == 1).alias("m1"), F.count_if(F.col("alike") > 1).alias("m2"))
    # a common name has over sqrt(PAIRS) rows, so these names are few enough to be sent; the number of partitions is said, as few bytes here make many rows
    common, grids = n.join(m, "name").where((F.col("m1") + F.col("m2")).cast("double") * (F.col("n1") + F.col("n2")) > PAIRS), {}
    for kind, (a, b) in {"own": (F.col("m1"), F.col("n1")), "names": (F.col("m1") + F.col("m2"), F.col("n2")), "alike": (F.col("m2"), F.col("n1"))}.items():
        grids[kind] = _dealt(a, b, 4 * held)
    common = F.broadcast(common.select("name", *[x.alias(f"{kind}_{i}") for kind, xs in grids.items() for i, x in enumerate(xs)]))
    targets = targets.drop("copies").join(n.select("name", "n"), "name").join(common, "name", "left")
    refs = refs.join(common, "name", "left").sortWithinPartitions("name")  # alike rows in a row take less to send

    def met(kind: str, refs: DataFrame, targets: DataFrame) -> DataFrame:
        rows, columns = (F.coalesce(f"{kind}_{i}", F.lit(1)) for i in range(2))
        own = lambda key, k: F.pmod(F.xxhash64(key), k).cast("int")
        every = lambda k: F.explode(F.sequence(F.lit(0), k - 1))
        refs = refs.where(columns > 0).withColumn("row", own("src_id", rows)).withColumn("column", every(columns)).drop("alike", *common.columns[1:])
        targets = targets.where(rows > 0).withColumn("column", own("dst_id", columns)).withColumn("row", every(rows)).drop("names", *common.columns[1:])
        cell = ["name", "row", "column"]
        pairs = refs.repartition(held, *cell).join(targets.repartition(held, *cell), cell)
        # said so that it isn't inferred below, where it would tell apart exchanges that are the same
        return (pairs if loops else pairs.where("coalesce(src_id <> dst_id, false)")).select("src_id", "dst_id", F.lit(edge_type).alias("edge_type"), confidence.alias("confidence"))

    one, others = targets.where("names = 1"), met("names", refs, targets.where("names > 1"))
    return met("own", refs.where("alike = 1"), one).unionByName(others.unionByName(met("alike", refs.where("alike > 1"), one)).distinct())


def call_edges(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """refs(src_id, src_file, name), nodes(node_id, file_path, name): Certain in one file, Likely if the name has one target, else Unknown."""
    confidence = F.when(F.col("src_file") == F.col("dst_file"), CERTAIN).when(F.col("n") == 1, LIKELY).otherwise(UNKNOWN)
    return _resolved(refs.select("src_id", "src_file", "name"), nodes.select(F.col("node_id").alias("dst_id"), F.col("file_path").alias("dst_file"), "name"), "call", confidence)


def import_edges(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    return _resolved(refs.select("src_id", "name"), nodes.select(F.col("node_id").alias("dst_id"), "name"), "import", F.when(F.col("n") == 1, LIKELY).otherwise(UNKNOWN))


def doc_reference_edges(nodes: DataFrame) -> DataFrame:
    """From documentation sections to the code nodes whose name is among their identifiers (closing parentheses aside)."""
    names = nodes.where("kind = 'doc_section'").select(F.col("node_id").alias("src_id"), F.explode("identifiers").alias("x")).select("src_id", F.regexp_replace("x", r"(\(\))+$", "").alias("name"))
    code = nodes.where("kind <> 'doc_section'").select(F.col("node_id").alias("dst_id"), "name")
    return _resolved(names, code, "reference", F.when(F.col("n") == 1, LIKELY).otherwise(UNKNOWN), loops=True)


def dedupe_spans(nodes: DataFrame) -> DataFrame:
    """One node per (file, span): the most specific kind, then the first."""
    spec = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SPECIFICITY.items() for x in kv]), F.col("kind")), F.lit(0))
    order = W.partitionBy("file_path", "start_byte", "end_byte").orderBy(spec.desc(), F.asc("pos"))
    return nodes.withColumn("rn", F.row_number().over(order)).where("rn = 1").drop("rn")


def both_ways(edges: DataFrame) -> DataFrame:
    """node, other, edge_type, confidence, direction: each edge from either end."""
    out = edges.select(F.col("src_id").alias("node"), F.col("dst_id").alias("other"), "edge_type", "confidence", F.lit("out").alias("direction"))
    return out.unionByName(edges.select(F.col("dst_id").alias("node"), F.col("src_id").alias("other"), "edge_type", "confidence", F.lit("in").alias("direction")))


def degrees(edges: DataFrame) -> DataFrame:
    """node, incoming, total: parallel edges and both ends of a loop count."""
    rows = both_ways(edges).groupBy("node").agg(F.count_if(F.col("direction") == "in").alias("incoming"), F.count("*").alias("total"))
    return rows


def remove_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those that touch gone(node)."""
    return edges.join(gone, edges.src_id == gone.node, "left_anti").join(gone, edges.dst_id == gone.node, "left_anti")


def live_memory_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of memory that still end at a node: what a rebuilt graph carries over."""
    return edges.where("edge_type in ('discussed', 'triggered')").join(nodes.select(F.col("node_id").alias("dst_id")).distinct(), "dst_id", "left_semi")


def counts(edges: DataFrame) -> DataFrame:
    """One row: edges and distinct ends."""
    ends = edges.select("src_id").union(edges.select("dst_id")).distinct()
    return edges.agg(F.count("*").alias("n_edges")).join(ends.agg(F.count("*").alias("n_nodes")))  # one row each


def looked_up(asked: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id, node_id of asked(query_id, key): the node of that id, else of that name, else of that file, a module or class first, then by line."""
    n = nodes.select("node_id", "name", "file_path", "kind", "start_line")
    ways = [("node_id", F.lit(0)), ("name", F.lit(0)), ("file_path", F.when(F.col("kind").isin("module", "class"), 0).otherwise(1))]
    found = None
    for i, (column, order) in enumerate(ways):
        rows = asked.join(n.withColumn("key", F.col(column)), "key").select("query_id", F.struct(F.lit(i).alias("way"), order.alias("order"), (F.col("start_line") if column == "file_path" else F.lit(0)).cast("long").alias("line"), "node_id").alias("x"))
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("query_id").agg(F.min("x")["node_id"].alias("node_id"))


def suggestions(asked: DataFrame, nodes: DataFrame, most: int = 5) -> DataFrame:
    """query_id, node_id, rank: nodes whose name holds the key or whose id begins with it, at most `most`, by id."""
    n = nodes.select("node_id", "name")
    rows = holding(n, "node_id", F.concat_ws("\n", "name", "node_id"), asked, F.col("key")).where(F.contains("name", F.col("key")) | F.startswith("node_id", F.col("key")))
    order = W.partitionBy("query_id").orderBy("node_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("query_id", "node_id", "rank")


def neighbor_signatures(edges: DataFrame, nodes: DataFrame, owned: DataFrame, max_tokens: int) -> DataFrame:
    """query_id, dst_id, used: what owned files import from others, first seen first, while signatures fit.

    owned(query_id, file_path). Sources go by id and so do their targets; at a target that doesn't fit the rest of its source is left. Only a
    query's distinct imports meet, in a fold over (source, target, cost).
    """
    n = nodes.select("node_id", "file_path", (estimated_tokens(F.col("signature")) + 5).alias("cost"))
    own = owned.join(n, "file_path").select("query_id", F.col("node_id").alias("src_id"))
    e = edges.where("edge_type = 'import'").select("src_id", "dst_id").distinct()
    rows = own.join(e, "src_id").join(n.select(F.col("node_id").alias("dst_id"), "file_path", "cost"), "dst_id").join(owned, ["query_id", "file_path"], "left_anti")
    xs = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("src_id", "dst_id", "cost"))).alias("xs"))
    start = "named_struct('used', 0L, 'shut', '', 'took', cast(array() AS array<struct<dst_id:string,used:bigint>>))"
    seen = "exists(a.took, y -> y.dst_id = x.dst_id)"
    step = f"if(x.src_id = a.shut OR {seen}, a, if(a.used + x.cost > {max_tokens}, named_struct('used', a.used, 'shut', x.src_id, 'took', a.took), named_struct('used', a.used + x.cost, 'shut', a.shut, 'took', concat(a.took, array(named_struct('dst_id', x.dst_id, 'used', a.used + x.cost))))))"
    return xs.selectExpr("query_id", f"explode(aggregate(xs, {start}, (a, x) -> {step}).took) AS t").select("query_id", "t.dst_id", "t.used")


def k_hop(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """query_id, node, depth: the least number of undirected steps from seeds(query_id, node), up to depth."""
    links = both_ways(edges).select("node", "other")  # parallel edges reach what one reaches: steps are made distinct, not all edges
    seen = front = seeds.select("query_id", "node").distinct().withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        step = front.join(links, "node").select("query_id", F.col("other").alias("node")).distinct()
        front = step.join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    return seen


def expand(edges: DataFrame, anchors: DataFrame, costs: DataFrame, budget: int, depth: int = 3) -> DataFrame:
    """query_id, node_id, place, depth, used: nodes taken within the token budget, best edges first.

    anchors(query_id, node_id, rank) come in order, each if it fits. Then the neighbours of taken
    nodes by confidence, depth and id; one that doesn't fit is passed over. Of a node's neighbours of one confidence and cost only
    the first budget / cost can be taken (once one of them didn't fit, none does), so the links of a hub are cut to what the budget bounds,
    exactly. The reach of each query is found by joins over those; the ordered walk then runs over that subgraph alone, one query per group.

    It runs twice. Nodes without a cost that no query reaches before the last step take no budget and open no links, so what else is taken is the same without them:
    a first walk leaves them out and tells which nodes are taken, a second one goes over the links of those alone, all of them.
    """
    links = both_ways(edges).select("node", "other", "confidence")
    price = costs.select(F.col("node_id").alias("other"), F.col("tokens").alias("cost"))

    def near(rows: DataFrame) -> DataFrame:
        """Links of rows(node, other, confidence) with their cost, each once and cut to the budget."""
        rows = rows.groupBy("node", "other").agg(F.max("confidence").alias("confidence")).join(price, "other", "left")
        rows = rows.withColumn("cost", F.coalesce("cost", F.lit(0)).cast("long"))
        alike = F.row_number().over(W.partitionBy("node", "confidence", "cost").orderBy("other"))
        return rows.withColumn("k", alike).where((F.col("cost") <= 0) | (F.col("k") * F.col("cost") <= budget)).drop("k")

    # only edges at nodes that a query reaches can be taken, so the walk's edges are looked at and not the table's; what is reached is kept, so that plans know its size
    seen = front = anchors.select("query_id", F.col("node_id").alias("node")).distinct().withColumn("depth", F.lit(0))
    inner = near(links.join(k_hop(edges, seen.drop("depth"), depth - 2).select("node").distinct(), "node", "left_semi"))
    inner = kept(inner, "expand-links") if depth > 1 else inner
    for d in range(1, depth):
        step = front.join(inner, "node").select("query_id", F.col("other").alias("node")).distinct()
        front = step.join(seen.select("query_id", "node"), ["query_id", "node"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(front)
    seen = kept(seen, "expand-seen")
    last, before = seen.where(F.col("depth") >= depth - 1).select("query_id", "node"), seen.where(F.col("depth") < depth - 1).select("query_id", "node")
    # the nodes that count in the first walk: both ends of a last step's edge are among them
    known = costs.where("tokens <> 0").select(F.col("node_id").alias("node")).union(seen.select("node")).distinct()
    known = kept(known, "expand-known")
    both = edges.join(known.select(F.col("node").alias("src_id")), "src_id", "left_semi").join(known.select(F.col("node").alias("dst_id")), "dst_id", "left_semi")
    ends = near(both_ways(both).select("node", "other", "confidence").join(last.select("node").distinct(), "node", "left_semi"))
    sub = before.join(inner, "node").unionByName(last.join(ends, "node")).select("query_id", "node", "other", "confidence", "cost", F.lit(None).cast("int").alias("rank"))
    sub = kept(sub, "expand-first")
    first = anchors.join(costs, "node_id", "left").select("query_id", F.col("node_id").alias("node"), F.lit(None).cast("string").alias("other"), F.lit(2).alias("confidence"), F.coalesce("tokens", F.lit(0)).cast("long").alias("cost"), F.col("rank").cast("int").alias("rank"))

    def walk(key: tuple, rows) -> Iterator:
        import heapq

        import pandas as pd

        starts = rows[rows["rank"].notna()].sort_values(["rank", "node"])
        links: dict[str, list] = {}
        for node, other, conf, cost in rows[rows["rank"].isna()][["node", "other", "confidence", "cost"]].itertuples(index=False):
            links.setdefault(node, []).append((-conf, other, cost))
        used, taken, heap = 0, {}, []

        def take(node: str, cost: int, at: int) -> None:
            nonlocal used
            used += cost
            taken[node] = (len(taken) + 1, at, used)
            for conf, other, price in links.get(node, []):
                heapq.heappush(heap, (conf, at + 1, other, price))

        for node, cost in starts[["node", "cost"]].itertuples(index=False):
            if node not in taken and used + cost <= budget:
                take(node, cost, 0)
        while heap and used < budget:
            _, at, node, cost = heapq.heappop(heap)
            if node not in taken and at <= depth and used + cost <= budget:
                take(node, cost, at)
        return pd.DataFrame([(key[0], n, *v) for n, v in taken.items()], columns=["query_id", "node_id", "place", "depth", "used"])

    def walked(rows: DataFrame) -> DataFrame:
        return rows.unionByName(first.select(*sub.columns)).groupBy("query_id").applyInPandas(walk, f"query_id {dict(anchors.dtypes)['query_id']}, node_id string, place int, depth int, used long")

    taken = kept(walked(sub).where(F.col("depth") < depth).select("query_id", F.col("node_id").alias("node")), "expand-taken")
    opened = last.join(taken, ["query_id", "node"], "left_semi")
    free = links.join(opened.select("node").distinct(), "node", "left_semi").join(known.select(F.col("node").alias("other")), "other", "left_anti")
    free = free.groupBy("node", "other").agg(F.max("confidence").alias("confidence"))
    rest = opened.join(free, "node").select("query_id", "node", "other", "confidence", F.lit(0).cast("long").alias("cost"), F.lit(None).cast("int").alias("rank"))
    return walked(sub.join(taken, ["query_id", "node"], "left_semi").select(*sub.columns).unionByName(rest))
