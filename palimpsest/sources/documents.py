"""Documents to sections, facts and citations: Markdown, HTML, reStructuredText and plain text.

Each file is parsed on its own inside mapInArrow; a file's rows come out flat: unit (section,
fact, citation), at (its number in the file), section (the number of the section it is in, or null),
depth, text and url. Nodes and edges are plans over those rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.text import cut_at, node_id

SCHEMA = "file_path string, unit string, at int, section int, depth int, text string, url string"
#: Depth of a heading by the sign that underlines it; 3 for other signs.
RST_DEPTHS = {"=": 1, "-": 2, "~": 3, "^": 4}
_MD_LINK = re.compile(r"\[([^\]]+)\]\(([^)\s]+)\)")
_RST_LINK = re.compile(r"`([^`<]+?)\s*<([^>]+)>`_")
_H = re.compile(r"<h([1-6])[^>]*>(.*?)</h\1>", re.S | re.I)
_P = re.compile(r"<p[^>]*>(.*?)</p>", re.S | re.I)
_A = re.compile(r"<a[^>]*\shref=\"([^\"]*)\"[^>]*>(.*?)</a>", re.S | re.I)
_TAGS = re.compile(r"<[^>]+>")


class _Rows:
    """Collects a file's units in order."""

    def __init__(self, path: str) -> None:
        self.path, self.rows, self.counts = path, [], {}

    def add(self, unit: str, section: int | None, depth: int | None, text: str, url: str | None = None) -> int:
        at = self.counts.get(unit, 0)
        self.counts[unit] = at + 1
        self.rows.append((self.path, unit, at, section, depth, text, url))
        return at

    def paragraph(self, lines: list[str], section: int | None, link: re.Pattern) -> None:
        text = "\n".join(lines).strip()
        if text:
            self.add("fact", section, None, text)
            for name, url in link.findall(text):
                self.add("citation", section, None, name, url)


def markdown(path: str, text: str) -> list[tuple]:
    """Sections by # headings; paragraphs end at blank lines. Text before the first heading goes, unless there is none at all."""
    lines = text.split("\n")
    fenced, headings = False, {}
    for i, line in enumerate(lines):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        m = None if fenced else re.match(r"(#{1,6})\s+(.*\S)", line.strip())
        if m:
            headings[i] = (len(m[1]), m[2].rstrip("#").strip())
    return _by_lines(path, lines, headings, set(), _MD_LINK)


def rst(path: str, text: str) -> list[tuple]:
    """A heading is a line above one of three or more equal signs."""
    lines = text.split("\n")
    headings, skip = {}, set()
    for i, (a, b) in enumerate(zip(lines, lines[1:], strict=False)):
        if a.strip() and re.fullmatch(r"([^\w\s])\1{2,}", b.strip()) and not re.fullmatch(r"([^\w\s])\1{2,}", a.strip()):
            headings[i] = (RST_DEPTHS.get(b.strip()[0], 3), a.strip())
            skip.add(i + 1)
    return _by_lines(path, lines, headings, skip, _RST_LINK)


def plain(path: str, text: str) -> list[tuple]:
    """One root section; paragraphs end at blank lines."""
    return _by_lines(path, text.split("\n"), {}, set(), re.compile(r"(?!)()()"))


def _by_lines(path: str, lines: list[str], headings: dict, skip: set, link: re.Pattern) -> list[tuple]:
    out = _Rows(path)
    section = None if headings else out.add("section", None, 0, path)
    part: list[str] = []

    def close() -> None:
        if section is not None:
            out.paragraph(part, section, link)
        part.clear()

    for i, line in enumerate(lines):
        if i in headings:
            close()
            section = out.add("section", None, *headings[i])
            for name, url in link.findall(line):
                out.add("citation", section, None, name, url)
        elif i in skip or not line.strip():
            close()
        else:
            part.append(line)
    close()
    return out.rows


def page(path: str, text: str) -> list[tuple]:
    """Sections by h1 to h6; each paragraph and link belongs to the nearest heading before it."""
    out = _Rows(path)
    clean = lambda x: " ".join(entities.unescape(_TAGS.sub("", x)).split())
    marks = [(m.start(), 0, m) for m in _H.finditer(text) if clean(m[2])]
    bare = not marks
    section = out.add("section", None, 0, path) if bare else None
    marks += [(m.start(), 1, m) for m in _P.finditer(text)] + [(m.start(), 2, m) for m in _A.finditer(text)]
    for _, kind, m in sorted(marks, key=lambda x: x[:2]):
        if kind == 0:
            section = out.add("section", None, int(m[1]), clean(m[2]))
        elif section is not None and kind == 1 and clean(m[1]):
            out.add("fact", section, None, clean(m[1]))
        elif section is not None and kind == 2:
            out.add("citation", section, None, clean(m[2]) or m[1], m[1])
    return out.rows


PARSERS = {"md": markdown, "mdx": markdown, "markdown": markdown, "html": page, "htm": page, "rst": rst, "txt": plain, "text": plain}


#: Bytes of files, or rows of them, that are in a task's hands as Python objects at once.
PART_BYTES, PART_ROWS = 1 << 22, 4096
#: Files of a batch that Spark sends to Python, where the session leaves its default of 10,000.
BATCH = 500


def by_parts(files: DataFrame, rows_of: Callable[[str, str], list[tuple]], schema: str) -> DataFrame:
    """Rows of schema that rows_of(path, text) gives for each of files(file_path, content), a null text being empty.

    A task holds one batch of files in Arrow, the one file that it reads and PART_ROWS rows or those of PART_BYTES of files, so its memory doesn't grow with the table.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if files.sparkSession.conf.get(key) == "10000":
        files.sparkSession.conf.set(key, str(BATCH))
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    return files.select("file_path", "content").mapInArrow(lambda batches: parts(batches, rows_of, kinds), schema)


def parts(batches: Iterator[pa.RecordBatch], rows_of: Callable[[str, str], list[tuple]], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of the files in batches, as batches of bounded size."""

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    for b in batches:
        rows, size = [], 0
        for i in range(b.num_rows):
            path, text = str(b.column(0)[i].as_py()), b.column(1)[i].as_py() or ""
            rows.extend(rows_of(path, text))
            size += len(text)
            while len(rows) > PART_ROWS:
                yield made(rows[:PART_ROWS])
                rows = rows[PART_ROWS:]
            if size > PART_BYTES:
                yield made(rows)
                rows, size = [], 0
        if rows:
            yield made(rows)


def parse(files: DataFrame, added: dict | None = None) -> DataFrame:
    """Units of files(file_path, content) by extension, added parsers before the own ones; files of other kinds give none."""
    parsers = PARSERS | (added or {})

    def units(path: str, text: str) -> list[tuple]:
        f = parsers.get(path.rsplit(".", 1)[-1].lower())
        return f(path, text) if f else []

    return by_parts(files, units, SCHEMA)


def nodes(units: DataFrame) -> DataFrame:
    """node_id, kind, label, text, file_path, at, section, depth, url."""
    kind = F.when(F.col("unit") == "section", "section").when(F.col("unit") == "fact", "fact").otherwise("citation")
    key = F.concat_ws(":", F.lit("doc"), "unit", "file_path", F.col("at").cast("string"), F.coalesce("url", F.when(F.col("unit") == "section", F.col("text")), F.lit("")))
    label = F.when(F.col("unit") == "fact", cut_at(F.col("text"), 120)).otherwise(F.col("text"))
    return units.select(node_id(key).alias("node_id"), kind.alias("kind"), label.alias("label"), "text", "file_path", "at", "section", "depth", "url")


def edges(doc_nodes: DataFrame) -> DataFrame:
    """Contain: section to the nearest earlier shallower one's children, and to its facts; reference: fact (or section) to citation."""
    sections = doc_nodes.where("kind = 'section'").select("file_path", "at", "depth", "node_id")
    # for each depth the last section of it so far: of the shallower ones the latest holds the section
    before = W.partitionBy("file_path").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("depth") == d, F.struct("at", "node_id"))).over(before) for d in range(6)]
    shallower = F.array_max(F.array(*[F.when(F.col("depth") > d, x) for d, x in enumerate(last)]))
    nested = sections.withColumn("outer", shallower).where("outer is not null").select(F.col("outer.node_id").alias("src_id"), F.col("node_id").alias("dst_id"), F.lit("contain").alias("edge_type"))
    owner = sections.select("file_path", F.col("at").alias("section"), F.col("node_id").alias("src_id"))
    held = doc_nodes.where("kind = 'fact'").join(owner, ["file_path", "section"]).select("src_id", F.col("node_id").alias("dst_id"), F.lit("contain").alias("edge_type"))
    facts = doc_nodes.where("kind = 'fact'").select("file_path", "section", F.col("at").alias("a2"), F.col("label").alias("l2"), F.col("node_id").alias("fact_id"))
    cites = doc_nodes.where("kind = 'citation'").join(owner, ["file_path", "section"]).join(facts, ["file_path", "section"], "left")
    cites = cites.groupBy("node_id").agg(F.coalesce(F.max_by("fact_id", F.when(F.contains("l2", "label"), F.col("a2"))), F.first("src_id")).alias("src_id"))
    return nested.unionByName(held).unionByName(cites.select("src_id", F.col("node_id").alias("dst_id"), F.lit("reference").alias("edge_type")))


def paragraphs(texts: DataFrame) -> DataFrame:
    """doc_id, paragraph, text, n_lines of texts(doc_id, text): runs of lines that aren't blank, without a parser."""
    lines = texts.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    order = W.partitionBy("doc_id").orderBy("at")
    lines = lines.withColumn("blank", F.trim("line") == "").withColumn("island", F.count_if("blank").over(order))
    rows = lines.where(~F.col("blank")).groupBy("doc_id", "island").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("xs"))
    rows = rows.withColumn("paragraph", F.row_number().over(W.partitionBy("doc_id").orderBy("island")))
    return rows.select("doc_id", "paragraph", F.array_join(F.transform("xs", lambda x: x["line"]), "\n").alias("text"), F.size("xs").alias("n_lines"))
