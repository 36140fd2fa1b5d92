"""Source files to nodes and references: the ast module for Python, patterns over scanned code (scanner.Source) for other languages."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import PARSED, is_discovered, left_out
from ..store import shared_path
from .documents import by_parts
from .scanner import Source

NODES = "file_path string, kind string, name string, signature string, doc_comment string, identifiers array<string>, start_line long, end_line long, start_byte long, end_byte long, pos int"
REFS = "file_path string, name string, kind string, offset long"
#: Languages that are known, but have no definitions to look for.
WITHOUT_NODES = ("bash", "json", "html", "css", "c_sharp", "zig")
_WORD = r"([A-Za-z_$][\w$]*)"
#: Per language (kind, pattern whose first group is the name).
DEFINITIONS = {
    "rust": [("function", rf"\bfn\s+{_WORD}"), ("struct", rf"\bstruct\s+{_WORD}"), ("enum", rf"\benum\s+{_WORD}"), ("trait", rf"\btrait\s+{_WORD}"), ("module", rf"\bmod\s+{_WORD}\s*\{{"), ("macro", rf"\bmacro_rules!\s+{_WORD}")],
    "javascript": [("function", rf"\bfunction\s*\*?\s*{_WORD}"), ("class", rf"\bclass\s+{_WORD}"), ("function", rf"\b(?:const|let|var)\s+{_WORD}\s*=\s*(?:async\s*)?(?:\([^)]*\)|{_WORD[1:-1]})\s*=>")],
    "go": [("method", rf"\bfunc\s+\([^)]*\)\s*{_WORD}"), ("function", rf"\bfunc\s+{_WORD}"), ("struct", rf"\btype\s+{_WORD}\s+struct\b"), ("interface", rf"\btype\s+{_WORD}\s+interface\b")],
    "java": [("class", rf"\bclass\s+{_WORD}"), ("interface", rf"\binterface\s+{_WORD}"), ("enum", rf"\benum\s+{_WORD}"), ("method", rf"(?:public|private|protected|static)[\w<>\[\]\s,]*\s{_WORD}\s*\([^)]*\)\s*(?:throws[\w\s,.]*)?\{{")],
    "c": [("function", rf"^[A-Za-z_][\w\s*]*\s\*?{_WORD}\s*\([^;{{]*\)\s*\{{"), ("struct", rf"\bstruct\s+{_WORD}\s*\{{"), ("enum", rf"\benum\s+{_WORD}\s*\{{")],
    "ruby": [("class", rf"^[ \t]*class\s+{_WORD}"), ("module", rf"^[ \t]*module\s+{_WORD}"), ("method", r"^[ \t]*def\s+(?:self\.)?([\w?!]+)")],
    "lua": [("function", r"\bfunction\s+([\w.:]+)")],
    "swift": [("function", rf"\bfunc\s+{_WORD}"), ("class", rf"\bclass\s+{_WORD}"), ("struct", rf"\bstruct\s+{_WORD}"), ("enum", rf"\benum\s+{_WORD}"), ("interface", rf"\bprotocol\s+{_WORD}")],
}
DEFINITIONS["typescript"] = DEFINITIONS["tsx"] = [*DEFINITIONS["javascript"], ("interface", rf"\binterface\s+{_WORD}"), ("type", rf"\btype\s+{_WORD}\s*=")]
DEFINITIONS["cpp"] = [*DEFINITIONS["c"], ("class", rf"\bclass\s+{_WORD}")]
_CALL = re.compile(rf"{_WORD}(?:\s*\(|!\s*[(\[{{])")
_MEMBER = re.compile(rf"^[ \t]*(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*[*#]?{_WORD}\s*(?:<[^>\n]*>)?\s*\(", re.M)
_IMPORT = re.compile(r"^[ \t]*(?:import|use|from|require|#include)\b.*$", re.M)
_NOT_CALLS = {"if", "for", "while", "switch", "return", "catch", "function", "func", "fn", "match", "def", "sizeof", "new", "await"}


def _python(text: str) -> tuple[list, list]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return [], []
    starts = [0]
    for line in text.encode().split(b"\n"):
        starts.append(starts[-1] + len(line) + 1)
    nodes, refs = [], []

    def visit(node: ast.AST, inside: str) -> None:
        for x in ast.iter_child_nodes(node):
            kind = "class" if isinstance(x, ast.ClassDef) else ("method" if inside == "class" else "function") if isinstance(x, ast.FunctionDef | ast.AsyncFunctionDef) else ""
            if kind:
                names = sorted({y.id for y in ast.walk(x) if isinstance(y, ast.Name)} | ({a.arg for a in x.args.args} if kind != "class" else set()))
                nodes.append((kind, x.name, ast.get_docstring(x), names, x.lineno - 1, x.end_lineno - 1, starts[x.lineno - 1] + x.col_offset, starts[x.end_lineno - 1] + x.end_col_offset))
            if isinstance(x, ast.Call) and (name := getattr(x.func, "id", None) or getattr(x.func, "attr", None)):
                refs.append((name, "call", starts[x.lineno - 1] + x.col_offset))
            if isinstance(x, ast.Import | ast.ImportFrom):
                refs.extend((a.name.split(".")[-1], "import", starts[x.lineno - 1] + x.col_offset) for a in x.names)
            visit(x, kind or inside)

    visit(tree, "")
    return nodes, refs


def _methods(source: Source, bodies: dict[int, str]) -> Iterator[tuple[str, int, int, int]]:
    """(name, place, body, end) of what stands in a class's braces like a call with a block."""
    for m in _MEMBER.finditer(source.bare):
        if m[1] in _NOT_CALLS or m[1] == "constructor" or bodies.get(source.brace_place(source.enclosing(m.start(1)))) != "class":
            continue
        past = source.closing(m.end() - 1)
        brace, end = source.block(past)
        if brace < end and re.fullmatch(r"\s*(?::[^{};]*)?", source.bare[past:brace]):
            yield m[1], m.start(1), brace, end


def _patterns(text: str, language: str) -> tuple[list, list]:
    source = Source(text, language)
    bare, found = source.bare, []
    for kind, rx in DEFINITIONS.get(language, []):
        for m in re.finditer(rx, bare, re.M):
            if language in ("ruby", "lua"):
                word = re.compile(r"[a-z]").search(bare, m.start()).start()
                found.append((kind, m[1], m.start(1), -1, source.ends.get(word, source.line_end(m.end()))))
            else:
                brace, end = source.block(m.end() - 1 if m[0].endswith("{") else m.end())
                found.append((kind, m[1], m.start(1), brace, end))
    bodies = {brace: kind for kind, _, _, brace, _ in found}
    if language == "rust":
        # functions in the braces of a type's implementation or of a trait are its methods
        bodies |= {source.block(m.end())[0]: "impl" for m in re.finditer(r"^[ \t]*(?:unsafe\s+)?impl\b", bare, re.M)}
        found = [("method" if kind == "function" and bodies.get(source.brace_place(source.enclosing(at))) in ("impl", "trait") else kind, name, at, *rest) for kind, name, at, *rest in found]
    if language in ("javascript", "typescript", "tsx"):
        found += [("method", name, at, brace, end) for name, at, brace, end in _methods(source, bodies)]
    nodes, own = [], {at for _, _, at, _, _ in found}
    for kind, name, at, _, end in found:
        line = source.line_start(at)
        names = list(dict.fromkeys(re.findall(r"[A-Za-z_]\w{2,}", bare[line:end])))
        nodes.append((kind, name, _comment_above(source.lines, source.line_of(at)), names, source.line_of(at), source.line_of(end), source.byte(line), source.byte(end)))
    refs = [(m[1], "call", source.byte(m.start())) for m in _CALL.finditer(bare) if m[1] not in _NOT_CALLS and m.start(1) not in own]
    for m in _IMPORT.finditer(bare):
        words = re.findall(r"[A-Za-z_]\w*", source.code[m.start() : m.end()])[1:]
        refs.extend((w, "import", source.byte(m.start())) for w in words if w not in ("from", "import", "as", "use"))
    return nodes, refs


def _comment_above(lines: list[str], line: int) -> str | None:
    """The lines of comment that end right above a definition, or one blank line above it, without their marks."""
    k = line - 1
    if k >= 0 and not lines[k].strip():
        k -= 1
    found: list[str] = []
    while k >= 0 and re.match(r"\s*(//|#(?!\[|include|define)|/\*|\*|--)", lines[k]):
        found.append(lines[k].strip())
        k -= 1
    text = "\n".join(re.sub(r"^(?:///?!?|#+|/\*+|\*/|\*|--)\s?|\s*\*/$", "", x).strip() for x in reversed(found)).strip()
    return text or None


SECTION_LINES = 500


def backtick_identifiers(text: str) -> list[str]:
    """What stands in single backticks on one line, without spaces, up to 80 bytes, first seen first; fenced blocks are passed over."""
    bare = re.sub(r"```.*?(?:```|\Z)|``", "", text, flags=re.S)
    found = (x.strip() for x in re.findall(r"`([^`\n]*)(?:`|\n)", re.sub(r"`[^`\n]*\n", "\n", bare)))
    return list(dict.fromkeys(x for x in found if x and " " not in x and len(x.encode()) <= 80))


def markdown_sections(text: str) -> list[tuple]:
    """(heading, first paragraph or None, identifiers, first line, last line, first byte, byte after) of every section, outer ones after what closes before them.

    A heading is one to six # at a line's start, blanks aside, with text; it closes sections of its level or deeper. Of a section's own lines 500 count.
    """
    out, open_, at = [], [], 0
    lines = text.split("\n")
    if lines and not lines[-1]:
        lines.pop()

    def close(level: int, line: int, byte: int) -> None:
        while open_ and open_[-1][0] >= level:
            _, heading, first_line, first_byte, body = open_.pop()
            paragraph: list[str] = []
            for x in body:
                if x.strip():
                    paragraph.append(x.strip())
                elif paragraph:
                    break
            out.append((heading, " ".join(paragraph) or None, backtick_identifiers("\n".join(body)), first_line, max(line - 1, 0), first_byte, byte))

    for i, line in enumerate(lines):
        here, at = at, at + len(line.encode()) + 1
        m = re.match(r"\s*(#+)(.*)", line)
        if m and len(m[1]) <= 6:
            if m[2].strip():
                close(len(m[1]), i, here)
                open_.append((len(m[1]), m[2].strip(), i, here, []))
        elif open_ and len(open_[-1][4]) < SECTION_LINES:
            open_[-1][4].append(line.rstrip("\r"))
    close(0, len(lines), len(text.encode()))
    return out


def extract_sections(files: DataFrame) -> DataFrame:
    """Sections of Markdown files(file_path, content) as nodes of kind doc_section, in the columns of extract_nodes."""

    def rows_of(path: str, text: str) -> list[tuple]:
        return [(path, "doc_section", h, h, doc, names, l0, l1, b0, b1, i) for i, (h, doc, names, l0, l1, b0, b1) in enumerate(markdown_sections(text))]

    return by_parts(files.where(F.lower("file_path").rlike(r"\.(md|mdx|markdown)$")), rows_of, NODES)


def _parsed(path: str, text: str) -> tuple[list, list]:
    language = PARSED.get(path.rsplit(".", 1)[-1])
    if language is None or language in WITHOUT_NODES:
        return [], []
    return _python(text) if language == "python" else _patterns(text, language)


def _node_rows(path: str, text: str, found: list) -> list[tuple]:
    raw, rows = text.encode(), []
    for pos, (kind, name, doc, names, l0, l1, b0, b1) in enumerate(sorted(found, key=lambda n: (n[6], -n[7]))):
        head = raw[b0:b1].decode("utf-8", "replace").split("\n", 1)[0].split("{", 1)[0].strip().removesuffix(":").rstrip()
        rows.append((path, kind, name, head, doc, names, l0, l1, b0, b1, pos))
    return rows


def extract_nodes(files: DataFrame) -> DataFrame:
    """Definitions in files(file_path, content), with signature, comment, identifiers and span."""
    return by_parts(files, lambda path, text: _node_rows(path, text, _parsed(path, text)[0]), NODES)


def extract_references(files: DataFrame) -> DataFrame:
    """Calls and imports in files(file_path, content)."""
    return by_parts(files, lambda path, text: [(path, *r) for r in _parsed(path, text)[1]], REFS)


def extract_both(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(extract_nodes, extract_references) of files, each read and parsed once: what both give is written to the shared folder."""

    def rows_of(path: str, text: str) -> list[tuple]:
        nodes, refs = _parsed(path, text)
        none = (None,) * 8
        return [(*n, None) for n in _node_rows(path, text, nodes)] + [(path, kind, name, *none, at) for name, kind, at in refs]

    path = shared_path(files.sparkSession, "parsed")
    by_parts(files, rows_of, f"{NODES}, offset long").write.parquet(path)
    found = files.sparkSession.read.schema(f"{NODES}, offset long").parquet(path)
    return found.where("offset IS NULL").drop("offset"), found.where("offset IS NOT NULL").select("file_path", "name", "kind", "offset")


#: Ignore files and how much they count: those by other tools' name over the version control's, these over its own exclude file, the caller's excludes over all.
IGNORE_FILES = {".ignore": 2, ".gitignore": 1}
EXCLUDES = 3


def ignore_rules(spark: SparkSession, root: str, depth: int, exclude: list[str] | None = None) -> DataFrame:
    """folder, rank, place, rule: the lines of the ignore files in folders of up to `depth` parts under root, and the caller's excludes."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(root)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    base = str(files.makeQualified(at).toUri().getPath()).rstrip("/")
    rows = [("", EXCLUDES, i, rule) for i, rule in enumerate(exclude or [])]

    def read(path, folder: str, rank: int) -> None:
        held = files.open(path)
        rows.extend((folder, rank, i, line) for i, line in enumerate(jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8").splitlines()))
        held.close()

    own = jvm.org.apache.hadoop.fs.Path(root, ".git/info/exclude")
    if files.exists(own):
        read(own, "", 0)
    for name, rank in IGNORE_FILES.items():
        for n in range(depth + 1):
            # a name that stands in that many folders: the file system lists them, no file is looked at otherwise
            for found in files.globStatus(jvm.org.apache.hadoop.fs.Path("/".join([root.rstrip("/"), *["*"] * n, name]))) or []:
                path = str(found.getPath().toUri().getPath())
                read(found.getPath(), path[len(base) + 1 :].rpartition("/")[0], rank)
    return spark.createDataFrame(rows, "folder string, rank int, place int, rule string")


def read_files(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """file_path (relative to root), content, modified of the text files that a walk keeps, but those that ignore files of any folder, or the caller's excludes, leave out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    path = F.ltrim(F.element_at(F.split("path", base, 2), -1), F.lit("/"))
    found = raw.select(path.alias("file_path"), "content", F.col("modificationTime").alias("modified")).where(is_discovered(F.col("file_path")))
    depth = found.agg(F.coalesce(F.max(F.size(F.split("file_path", "/"))), F.lit(1))).first()[0] - 1
    gone = left_out(found.select("file_path"), ignore_rules(spark, root, depth, exclude))
    return found.join(gone, "file_path", "left_anti").select("file_path", F.col("content").cast("string").alias("content"), "modified")
