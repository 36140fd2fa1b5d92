"""Predicates over nodes, summaries of their intent, and texts made of them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped

#: Languages by extension, as prompts name them; the rest is "code".
PROMPT_LANGUAGES = {"rs": "rust", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "rb": "ruby", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cs": "csharp", "swift": "swift", "zig": "zig"}
#: The labels that a summary's lines begin with.
FIELDS = {"purpose": "PURPOSE", "inputs": "INPUTS", "outputs": "OUTPUTS", "side_effects": "SIDE_EFFECTS", "related_concepts": "RELATED_CONCEPTS", "error_cases": "ERROR_CASES"}
PROMPT = "Describe this {language} code. Answer with one line for each of " + ", ".join(FIELDS.values()) + ", each as LABEL: text; write none where there is nothing.\n\n{source_code}\n"
PROMPT_VERSION = "intent_1"
OUTPUT_TOKENS = 150


def is_active(superseded: Column, start: Column, end: Column, now: int) -> Column:
    """Whether a node holds at a time: not superseded, and inside its window, both ends included; an open end or no window is open."""
    return superseded.isNull() & (start.isNull() | ((start <= now) & (end.isNull() | (end >= now))))


def is_public_symbol(signature: Column, name: Column, path: Column) -> Column:
    return (
        F.startswith(signature, F.lit("pub "))
        | (F.endswith(path, F.lit(".py")) & ~F.startswith(name, F.lit("_")))
        | F.startswith(signature, F.lit("export "))
        | (F.endswith(path, F.lit(".go")) & name.rlike(r"^\p{Lu}"))
    )


def line_count(text: Column) -> Column:
    """Lines of a text; a last line end closes one and opens none."""
    body = F.regexp_replace(text, r"\n\z", "")
    return F.when(text == "", 0).otherwise(F.size(F.split(body, "\n", -1)))


def should_summarize(source: Column) -> Column:
    return (line_count(source) >= 3) & (F.octet_length(source) >= 50)


def prompt_language(path: Column) -> Column:
    ext = F.when(F.contains(path, F.lit(".")), F.lower(F.substring_index(path, ".", -1)))
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PROMPT_LANGUAGES.items() for x in kv]), ext), F.lit("code"))


def prompt(language: Column, source: Column) -> Column:
    before, between, after = PROMPT.replace("{source_code}", "{language}").split("{language}")
    return F.concat(F.lit(before), language, F.lit(between), source, F.lit(after))


def summary_cost(source_bytes: Column, input_price: float, output_price: float) -> Column:
    """What a summary costs at prices per million tokens, a token being four bytes."""
    tokens = F.floor((source_bytes + len(PROMPT.encode())) / 4)
    return tokens / 1e6 * input_price + OUTPUT_TOKENS / 1e6 * output_price


def parsed_summary(response: Column) -> Column:
    """A struct of FIELDS from a response's lines; the last line of a label counts, "none" is nothing where it can be."""

    def last(label: str) -> Column:
        lines = F.transform(F.split(response, "\n"), lambda x: stripped(x))
        values = F.transform(F.filter(lines, lambda x: F.startswith(x, F.lit(f"{label}:"))), lambda x: stripped(F.substring(x, len(label) + 2, 1 << 30)))
        kept = F.filter(values, lambda v: (v != "") & ((F.lower(v) != "none") | F.lit(label not in ("SIDE_EFFECTS", "ERROR_CASES"))))
        return F.get(F.reverse(kept), F.lit(0))

    out = {k: last(v) for k, v in FIELDS.items()}
    concepts = F.filter(F.transform(F.split(F.coalesce(out["related_concepts"], F.lit("")), ","), lambda x: stripped(x)), lambda c: c != "")
    return F.struct(*[(concepts if k == "related_concepts" else c).alias(k) for k, c in out.items()])


def enriched_text(text: Column, summary: Column) -> Column:
    """A node's text with its summary's purpose, concepts and side effects."""
    concepts = F.when(F.size(summary["related_concepts"]) > 0, F.array_join(summary["related_concepts"], " "))
    return F.concat_ws(" ", text, summary["purpose"], concepts, summary["side_effects"])


def cache_key(node_id: Column, source_hash: Column, version: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", node_id, source_hash, version), 256), 1, 32)
