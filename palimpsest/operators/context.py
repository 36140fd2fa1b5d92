"""Context bundles: budgets, totals, compression, text output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import estimated_tokens, signature

DEPTHS = {"summary": 0, "signatures": 1, "anchors": 2, "full": 3}


def packed(items: DataFrame, group: str, budget: int) -> DataFrame:
    """group, id, place, used: items(group, pos, id, tokens) in order, each if it still fits, later ones even after one that doesn't.

    Of a group's items of one size only the first budget / size can be taken: once one of them didn't fit, none does. The others go
    before anything is gathered, so a group of any size is a list bounded by the budget, but for items that cost nothing.
    """
    alike = F.row_number().over(W.partitionBy(group, "tokens").orderBy("pos", "id"))
    items = items.withColumn("__k", alike).where((F.col("tokens") <= 0) | (F.col("__k") * F.col("tokens") <= budget)).drop("__k")
    lists = items.groupBy(group).agg(F.sort_array(F.collect_list(F.struct("pos", "id", "tokens"))).alias("xs"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<pos:bigint,id:bigint,used:bigint>>").alias("taken"))

    def step(acc: Column, x: Column) -> Column:
        used = acc["used"] + x["tokens"].cast("long")
        row = F.struct(x["pos"].cast("long").alias("pos"), x["id"].cast("long").alias("id"), used.alias("used"))
        return F.when(used <= budget, F.struct(used.alias("used"), F.concat(acc["taken"], F.array(row)).alias("taken"))).otherwise(acc)

    taken = F.aggregate("xs", zero, step)["taken"]
    return lists.select(group, F.posexplode(taken).alias("place", "t")).select(group, F.col("t.id").alias("id"), (F.col("place") + 1).alias("place"), F.col("t.used").alias("used"))


def assemble(included: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """included(query_id, node_id, place, is_anchor) with source text and tokens; unknown nodes go, a missing file leaves a placeholder.

    nodes: node_id, file_path, start_line, end_line (from 0, inclusive); files: file_path, content.
    """
    rows = included.join(nodes.select("node_id", "file_path", "start_line", "end_line"), "node_id").join(files, "file_path", "left")
    lines = F.split("content", "\n")
    cut = F.array_join(F.slice(lines, F.col("start_line").cast("int") + 1, F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0)).cast("int")), "\n")
    text = F.when(F.col("content").isNull(), F.concat(F.lit("// source unavailable: "), F.col("file_path"))).otherwise(cut)
    return rows.select("query_id", "place", "node_id", "file_path", "is_anchor", text.alias("text"), estimated_tokens(text).alias("tokens"), estimated_tokens(F.col("content")).alias("file_tokens"))


def totals(bundle: DataFrame) -> DataFrame:
    """Per query: nodes, files, tokens, tokens of the whole files (each once) and the share saved."""
    files = bundle.groupBy("query_id", "file_path").agg(F.max("file_tokens").alias("file_tokens"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    out = files.groupBy("query_id").agg(F.sum("n").alias("nodes"), F.count("*").alias("files"), F.sum("tokens").alias("tokens"), F.coalesce(F.sum("file_tokens"), F.lit(0)).alias("file_tokens"))
    saved = F.greatest(F.col("file_tokens") - F.col("tokens"), F.lit(0))
    return out.withColumn("tokens_saved", saved).withColumn("saved_percent", F.when(F.col("file_tokens") > 0, F.round(100 * saved / F.col("file_tokens"), 1)).otherwise(0.0))


def compressed(bundle: DataFrame, depth: int) -> DataFrame:
    """Text by depth: 0 a line per file, 1 signatures, 2 signatures but for anchors, 3 all."""
    if depth == 0:
        names = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "node_id"))), lambda x: x["node_id"]), ", ")
        rows = bundle.groupBy("query_id", "file_path").agg(F.min("place").alias("place"), F.max("is_anchor").alias("is_anchor"), F.concat(F.col("file_path"), F.lit(": "), names).alias("text"))
        return rows.withColumn("tokens", estimated_tokens(F.col("text")))
    short = F.concat(signature(F.col("text")), F.lit(" // ..."))
    text = F.col("text") if depth >= 3 else short if depth == 1 else F.when(F.col("is_anchor"), F.col("text")).otherwise(short)
    return bundle.withColumn("text", text).withColumn("tokens", estimated_tokens(F.col("text")))


def without_overlaps(bundle: DataFrame) -> DataFrame:
    """bundle(query_id, file_path, start_line, end_line, place, is_anchor, ...) without what another of its nodes holds; anchors stay."""
    # what can hold a span comes before it by start, then length; of that, the farthest end, and the first start with it, say whether anything does
    files, s, e = ["query_id", "file_path"], F.col("start_line"), F.col("end_line")
    before = W.partitionBy(*files).orderBy(s, e.desc(), "place").rowsBetween(W.unboundedPreceding, -1)
    farthest = F.max(F.when(s.isNotNull() & e.isNotNull(), F.struct(e.alias("e"), (-s).alias("s")))).over(before)
    rows = bundle.select(*files, "start_line", "end_line", "place", "is_anchor", farthest.alias("f"), F.min("place").over(W.partitionBy(*files, "start_line", "end_line")).alias("p"))
    within = (F.col("f.e") > e) | ((F.col("f.e") == e) & (-F.col("f.s") < s)) | (F.col("p") < F.col("place"))
    gone = rows.where(~F.col("is_anchor") & s.isNotNull() & e.isNotNull() & within).select("query_id", "place").distinct()
    return bundle.join(gone, ["query_id", "place"], "left_anti")


def depth_of(name: str | None) -> int:
    """A depth by name or digit; anchors where it is neither."""
    n = (name or "").strip().lower()
    return DEPTHS.get(n, int(n) if n in ("0", "1", "2", "3") else 2)


IMPORT_MARKS = ("import ", "use ", "require(", "from ")


def consolidated_imports(bundle: DataFrame) -> DataFrame:
    """bundle with the imports of a file, where it has three or more of three lines or fewer, as one node after the others."""
    lines = F.size(F.split(F.regexp_replace("text", r"\n\z", ""), "\n", -1))
    small = F.lit(False)
    for mark in IMPORT_MARKS:
        small = small | F.contains("text", F.lit(mark))
    rows = bundle.withColumn("__small", small & (lines <= 3))
    files = rows.where("__small").groupBy("query_id", "file_path").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("place", "text"))).alias("xs"), F.max("file_tokens").alias("file_tokens")).where("n >= 3")
    text = F.concat(F.lit("// "), F.col("n").cast("string"), F.lit(" imports from "), F.col("file_path"), F.lit("\n"), F.array_join(F.transform("xs", lambda x: x["text"]), ""))
    made = files.select("query_id", (F.lit(1 << 30) + F.element_at("xs", 1)["place"]).alias("place"), F.concat(F.lit("imports:"), "file_path").alias("node_id"), "file_path", F.lit(False).alias("is_anchor"), text.alias("text"), estimated_tokens(text).alias("tokens"), "file_tokens")
    kept = rows.join(files.select("query_id", "file_path", F.lit(True).alias("__gone")), ["query_id", "file_path"], "left").where(~(F.col("__small") & F.coalesce("__gone", F.lit(False))))
    return kept.select(*made.columns).unionByName(made)


def compressed_bundle(bundle: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, totals): the bundle at a depth, without overlaps where lines are known, with imports as one; per query tokens before and after, share saved, nodes that can be expanded."""
    before = bundle.groupBy("query_id").agg(F.sum("tokens").alias("original_tokens"))
    rows = compressed(bundle, depth)
    if depth and "start_line" in rows.columns:
        rows = without_overlaps(rows)
    rows = consolidated_imports(rows) if depth else rows
    open_ = F.when(~F.col("is_anchor") & F.contains("text", F.lit("// ...")), F.struct("place", "node_id")) if depth else F.lit(None).cast("struct<place:long,node_id:string>")
    after = rows.groupBy("query_id").agg(F.sum("tokens").alias("compressed_tokens"), F.transform(F.sort_array(F.collect_list(open_)), lambda x: x["node_id"]).alias("expandable"))
    saved = F.greatest(F.col("original_tokens") - F.col("compressed_tokens"), F.lit(0))
    totals_ = before.join(after, "query_id").withColumn("saved_percent", F.when(F.col("original_tokens") > 0, F.round(100 * saved / F.col("original_tokens"), 1)).otherwise(0.0))
    return rows, totals_


def label_bundle(ranked: DataFrame, nodes: DataFrame) -> DataFrame:
    """A bundle of labels where nothing is indexed: every ranked node of nodes(node_id, label) is an anchor that costs its label."""
    rows = ranked.join(nodes.select("node_id", "label"), "node_id")
    return rows.select("query_id", F.col("rank").alias("place"), "node_id", F.lit(True).alias("is_anchor"), F.col("label").alias("text"), estimated_tokens(F.col("label")).alias("tokens"))


def budgeted_list(items: DataFrame, budget: int, most: int) -> DataFrame:
    """group, place, id, left: the first `most` of items(group, place, id, signature) while more than 20 tokens are left; one may overshoot what is left."""
    cost = (estimated_tokens(F.col("signature")) + 10).alias("cost")
    rows = items.where(F.col("place") <= most).select("group", "place", "id", cost)
    spent = F.coalesce(F.sum("cost").over(W.partitionBy("group").orderBy("place").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", F.greatest(F.lit(budget) - spent, F.lit(0))).where("before > 20")
    return rows.select("group", "place", "id", F.greatest(F.col("before") - F.col("cost"), F.lit(0)).alias("left"))


def as_json(bundle: DataFrame) -> DataFrame:
    """query_id, place, json: a line of JSON per node."""
    return bundle.select("query_id", "place", F.to_json(F.struct("node_id", "file_path", "is_anchor", "text", "tokens")).alias("json"))


def as_text(bundle: DataFrame) -> DataFrame:
    """query_id, text: files in order of path, nodes by place, and a closing line of totals."""
    per = bundle.groupBy("query_id", "file_path").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("xs"), F.sum("tokens").alias("t"))
    body = F.concat(F.lit("## "), F.col("file_path"), F.lit("\n"), F.array_join(F.transform("xs", lambda x: x["text"]), "\n"))
    out = per.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("file_path", body.alias("body")))).alias("fs"), F.sum("t").alias("t"))
    return out.select("query_id", F.concat(F.array_join(F.transform("fs", lambda x: x["body"]), "\n\n"), F.lit("\n-- "), F.format_number("t", 0), F.lit(" tokens in "), F.size("fs"), F.lit(" files")).alias("text"))
