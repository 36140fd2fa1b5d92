"""Predicates and projections over file paths, as columns. The patterns run alike in Java and RE2."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns that say what a path is, over the lower-cased path with forward slashes.
TEST_DIR = "/(tests|test|__tests__|spec|__spec__)/|^(tests|test)/"
TEST_NAME = r"(^|/)(test_[^/]*|[^/]*_test|conftest)\.py$|\.(test|spec)\.(js|ts|tsx|jsx|mjs)$|_test\.(rs|go)$"
TEST_CLASS = r"Tests?\.(java|kt)$"  # case matters here
NONCODE = r"(^|/)(changelog|readme|contributing|authors|license|copying|news|history)[^/]*$|\.(md|rst|txt)$|(^|/)docs/.*\.html$"
FIXTURE = r"/samples/.*expected|expected.*/samples/|/samples/.*/output|/output.*/samples/|/samples/output|/test.*-bundle\.js$|/(fixtures|__fixtures__)/|__snapshots__|\.snap$|/benchmarks?/|^benchmarks/|(^|/)asv_bench/|/test[-_]examples/"
EXCLUDED = r"\.(md|mdx|lock|txt|rst|yaml|yml)$|(^|/)(site|docs)/|(^|/)(changelog|readme|contributing|authors|license|copying|news|history)[^/]*$"
KEPT_JSON = r"(^|/)(package|tsconfig|palimpsest)\.json$"
# Folder names no file below which is read, and extensions of generated or binary files.
DENIED_FOLDERS = ("node_modules", "__pycache__", ".git", "dist", "build", "target", ".palimpsest", "vendor", ".venv", "venv", ".env")
DENIED_EXTENSIONS = ("lock", "min.js", "min.css", "map", "wasm", "png", "jpg", "jpeg", "gif", "svg", "ico", "ttf", "woff", "woff2", "eot", "pdf", "zip", "tar", "gz", "exe", "dll", "so", "dylib", "pyc", "pyo", "class", "o", "obj")
# Language of an extension, as parsers see it and as reports name it.
PARSED = {"rs": "rust", "py": "python", "pyi": "python", "pyw": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "tsx", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "hxx": "cpp", "hh": "cpp", "rb": "ruby", "sh": "bash", "bash": "bash", "json": "json", "html": "html", "htm": "html", "css": "css", "cs": "c_sharp", "lua": "lua", "zig": "zig", "swift": "swift"}
NAMED = {"rs": "Rust", "py": "Python", "js": "JavaScript", "ts": "TypeScript", "tsx": "TypeScript", "jsx": "JavaScript", "go": "Go", "java": "Java", "c": "C", "h": "C", "cpp": "C++", "cc": "C++", "cxx": "C++", "hpp": "C++", "cs": "C#", "rb": "Ruby", "swift": "Swift", "kt": "Kotlin", "kts": "Kotlin", "lua": "Lua", "zig": "Zig", "sh": "Shell", "bash": "Shell", "html": "HTML", "htm": "HTML", "css": "CSS", "scss": "CSS", "less": "CSS", "json": "JSON", "yaml": "YAML", "yml": "YAML", "toml": "TOML", "md": "Markdown", "markdown": "Markdown"}


def slashed(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def is_test_file(path: Column) -> Column:
    p = slashed(path)
    return F.lower(p).rlike(f"{TEST_DIR}|{TEST_NAME}") | p.rlike(TEST_CLASS)


def is_noncode_file(path: Column) -> Column:
    return F.lower(slashed(path)).rlike(NONCODE)


def is_test_fixture(path: Column) -> Column:
    return F.lower(slashed(path)).rlike(FIXTURE)


def should_exclude_from_search(path: Column) -> Column:
    p = F.lower(slashed(path))
    return p.rlike(EXCLUDED) | (p.rlike(r"\.json$") & ~p.rlike(KEPT_JSON))


def matches_penalty_paths(path: Column, patterns: list[str]) -> Column:
    """Whether the path holds any of the patterns as it is written; never, without patterns."""
    out = F.lit(False)
    for x in patterns:
        out = out | F.contains(slashed(path), F.lit(x))
    return out


def extension(path: Column) -> Column:
    """What follows the last dot; the whole path where there is none."""
    return F.substring_index(path, ".", -1)


def _mapped(key: Column, values: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def parsed_language(path: Column) -> Column:
    """The language a parser exists for, else null."""
    return _mapped(extension(path), PARSED)


def language_name(path: Column) -> Column:
    """The language's name; an unknown extension names itself."""
    return F.coalesce(_mapped(extension(path), NAMED), extension(path))


def is_discovered(path: Column) -> Column:
    """Whether a walk keeps this path (relative to the root): no hidden or denied part, no denied extension."""
    parts = F.split(slashed(path), "/")
    denied = F.exists(parts, lambda x: x.isin(*DENIED_FOLDERS) | x.startswith("."))
    name = F.element_at(parts, -1)
    return ~denied & ~name.rlike(r"\.(" + "|".join(x.replace(".", r"\.") for x in DENIED_EXTENSIONS) + r")$|\.min\.")


def source_candidates(path: Column) -> Column:
    """The source files that a test file's name and folder point to, likeliest first; empty for others."""
    p = slashed(path)
    name = F.element_at(F.split(p, "/"), -1)
    folder = F.when(F.instr(p, "/") > 0, F.regexp_replace(p, "/[^/]*$", "")).otherwise("")
    at = lambda where, what: F.when(where == "", what).otherwise(F.concat(where, F.lit("/"), what))
    none = F.array().cast("array<string>")

    js = F.regexp_replace(name, r"\.(test|spec)(\.(js|ts|tsx|jsx|mjs))$", "$2")
    above = F.rtrim(F.regexp_replace(F.regexp_replace(folder, "__tests__", ""), "//", "/"), F.lit("/"))
    is_js = name.rlike(r"\.(test|spec)\.(js|ts|tsx|jsx|mjs)$")
    js_paths = F.when(is_js, F.concat(F.array(at(folder, js)), F.when(F.contains(folder, F.lit("__tests__")), F.array(at(above, js))).otherwise(none))).otherwise(none)

    py = F.regexp_replace(name, "^test_", "")
    sub = F.regexp_replace(folder, "^[^/]*/", "")
    nested = folder.rlike("^(tests|test)/.") & (sub != "")
    py_paths = F.when(
        name.rlike(r"^test_.*\.py$"),
        F.concat(F.array(py, F.concat(F.lit("src/"), py), F.concat(F.lit("lib/"), py)), F.when(nested, F.array(F.concat(sub, F.lit("/"), py), F.concat(F.lit("src/"), sub, F.lit("/"), py))).otherwise(none)),
    ).otherwise(none)
    tail = F.regexp_replace(name, r"_test\.py$", ".py")
    py_tail = F.when(name.rlike(r"_test\.py$"), F.array(tail, F.concat(F.lit("src/"), tail))).otherwise(none)

    native = F.regexp_replace(name, r"_test\.(go|rs)$", r".$1")
    native_paths = F.when(name.rlike(r"_test\.(go|rs)$"), F.array(at(folder, native))).otherwise(none)

    jvm = F.regexp_replace(name, r"Tests?(\.(java|kt))$", "$1")
    main = F.replace(folder, F.lit("/test/"), F.lit("/main/"))
    jvm_paths = F.when(name.rlike(TEST_CLASS), F.when(folder == "", F.array(jvm)).otherwise(F.array(at(main, jvm), at(folder, jvm)))).otherwise(none)
    return F.concat(js_paths, py_paths, py_tail, native_paths, jvm_paths)


#: Conventions that paths show, in order, with the pattern of a path that shows them.
CONVENTIONS = (
    (r"src/app/.*page\.tsx$", "Next.js App Router (src/app/**/page.tsx)"),
    (r"app/.*page\.tsx$", "Next.js App Router (app/**/page.tsx)"),
    ("src/pages/", "Next.js Pages Router (src/pages/)"),
    (r"api/.*route\.(ts|js)$", "Next.js API routes (api/**/route.ts)"),
    ("components/", "Component-based architecture (components/)"),
    ("lib/", "Library/utilities pattern (lib/)"),
    (r"tests/|__tests__/|_test\.go|_test\.rs", "Test suite present"),
    ("models/|schemas/", "Data models/schemas pattern"),
    (r"^Cargo\.toml$|^crates/", "Rust workspace"),
    (r"prisma/schema\.prisma", "Prisma ORM (prisma/schema.prisma)"),
)


def conventions(path: Column) -> Column:
    """An aggregate over paths: the conventions they show, in order; the second goes where the first holds. No path is gathered."""
    shown = [F.coalesce(F.bool_or(path.rlike(rx)), F.lit(False)) for rx, _ in CONVENTIONS]
    shown[1] = shown[1] & ~shown[0]
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, (_, name) in zip(shown, CONVENTIONS, strict=True)]))


def ignored(path: Column, rules: list[str]) -> Column:
    """Whether ignore rules (lines as in .gitignore, the last match counts, ! takes back) leave a relative path out."""
    out = F.lit(False)
    for line in rules:
        rule = line.rstrip()
        if not rule or rule.startswith("#"):
            continue
        keep = rule.startswith("!")
        out = F.when(path.rlike(glob_pattern(rule[1:] if keep else rule)), F.lit(not keep)).otherwise(out)
    return out


def _glob_body(rule: str) -> str:
    import re

    parts = re.split(r"(/\*\*/|\*\*/|/\*\*|\*|\?|\[[^\]]*\]|\\.)", rule.lstrip("/"))
    made = {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "*": "[^/]*", "?": "[^/]"}
    return "".join(made.get(x) or (x.replace("[!", "[^") if x.startswith("[") else re.escape(x[1:] if x[:1] == "\\" else x)) for x in parts)


def glob_pattern(rule: str) -> str:
    """A pattern for paths that an ignore rule matches, themselves or by a folder above."""
    rule = rule.rstrip("/") if rule.endswith("/") else rule
    return ("^" if "/" in rule else "(?:^|/)") + _glob_body(rule) + "(?:/|$)"


def rule_parts(line: str) -> tuple[str, bool, bool] | None:
    """(pattern of what is matched itself, relative to the rule's folder; whether it is kept; whether only folders match) of a line of an ignore file."""
    rule = line.rstrip("\r\n")
    while rule.endswith(" ") and not rule.endswith("\\ "):
        rule = rule[:-1]
    if not rule or rule.startswith("#"):
        return None
    keep = rule.startswith("!")
    rule = rule[1:] if keep else rule
    folders = rule.endswith("/")
    rule = rule.rstrip("/")
    return (("^" if "/" in rule else "(?:^|/)") + _glob_body(rule) + "$", keep, folders) if rule else None


def left_out(files: DataFrame, rules: DataFrame) -> DataFrame:
    """file_path of files(file_path) that rules(folder, rank, place, rule) leave out: the lines of ignore files of every folder ('' for the root).

    A rule holds for what lies in its folder. Of those that match, the one of the highest rank counts, then of the deepest folder, then the last; a file is left
    out if it or a folder above it is, whatever is said of it below such a folder. Folders are decided once for all files in them.
    """
    parts = F.split("file_path", "/")
    upto = lambda n: F.array_join(F.slice(parts, 1, n), "/")
    every = files.select("file_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(upto(n).alias("target"), (n < F.size(parts)).alias("is_folder")))).alias("t")).select("file_path", "t.*")
    targets = every.select("target", "is_folder").distinct()
    pieces = F.split("target", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(pieces) - 1), lambda n: F.struct(F.array_join(F.slice(pieces, 1, n), "/").alias("folder"), n.alias("depth"), F.array_join(F.slice(pieces, n + 1, 1 << 30), "/").alias("rest")))
    met = targets.select("target", "is_folder", F.explode(above).alias("a")).select("target", "is_folder", "a.*").join(_parsed_rules(rules), "folder")
    met = met.where(F.regexp("rest", F.col("pattern")) & (F.col("is_folder") | ~F.col("folders")))
    last = met.groupBy("target", "is_folder").agg(F.max_by("keep", F.struct("rank", "depth", "place")).alias("keep"))
    return every.join(last.where("NOT keep"), ["target", "is_folder"], "left_semi").select("file_path").distinct()


def _parsed_rules(rules: DataFrame) -> DataFrame:
    def run(batches):
        import pandas as pd

        for b in batches:
            rows = [(folder, rank, place, *made) for folder, rank, place, rule in b.itertuples(index=False) if (made := rule_parts(rule or ""))]
            yield pd.DataFrame(rows, columns=["folder", "rank", "place", "pattern", "keep", "folders"])

    return rules.select("folder", "rank", "place", "rule").mapInPandas(run, "folder string, rank int, place int, pattern string, keep boolean, folders boolean")


def is_relevant_change(kind: Column, paths_: Column, data_dir: str) -> Column:
    """Whether a change of files counts: made, modified or removed, and not all inside the engine's own folder."""
    return kind.isin("create", "modify", "remove") & F.exists(paths_, lambda p: ~((p == data_dir) | F.startswith(p, F.lit(data_dir.rstrip("/") + "/"))))
