"""Text functions as columns: terms, token estimates, secrets, identifiers, keywords, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that a full-text query leaves out.
STOP_WORDS = (
    "a an the is are was were be been being how what where when why who which that this do does did have has had will would could "
    "should can may might shall to of in for on with at by from it its and or not no but if then so as about into through just also than very too"
).split()
# Words that never are keywords.
KEYWORD_STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would shall should may might must can could i you he she it we "
    "they me him her us them my your his its our their this that these those what which who whom when where why how not no nor but or and "
    "if then else so just too very really also of in on at to for with by from about into through during before after above below up down "
    "out off over under again further once here there all both each more most other some such than as"
).split()
# Secrets by family, replaced in this order.
SECRETS = (
    (r"sk-proj-[a-zA-Z0-9\-_]{40,}", "<REDACTED_API_KEY>"),
    (r"sk-[a-zA-Z0-9]{20,}", "<REDACTED_API_KEY>"),
    (r"github_pat_[a-zA-Z0-9_]{22,}", "<REDACTED_GITHUB_TOKEN>"),
    (r"ghp_[a-zA-Z0-9]{36,}", "<REDACTED_GITHUB_TOKEN>"),
    (r"AKIA[0-9A-Z]{16}", "<REDACTED_AWS_KEY>"),
    (r"-----BEGIN[A-Z ]*PRIVATE KEY-----[\s\S]*?-----END[A-Z ]*PRIVATE KEY-----", "<REDACTED_PRIVATE_KEY>"),
    (r"Bearer\s+[a-zA-Z0-9\-._~+/]+=*", "<REDACTED_BEARER>"),
    (r"xox[bsrp]-[a-zA-Z0-9\-]{10,}", "<REDACTED_SLACK_TOKEN>"),
    (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "<REDACTED_EMAIL>"),
)
NOT_WORD = r"[^\p{L}\p{N}]+"


def estimated_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded down."""
    return F.floor(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda x: x != "")


def query_terms(text: Column) -> Column:
    """Terms of a full-text query, first seen first; all its words, as they come, if every one is a stop word."""
    every = tokens(text)
    kept = F.array_distinct(F.filter(every, lambda x: ~x.isin(*STOP_WORDS)))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def keywords(text: Column) -> Column:
    """Up to 20 words of over 2 bytes that aren't stop words, repeats included."""
    trimmed = F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: F.lower(F.regexp_replace(x, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")))
    return F.slice(F.filter(trimmed, lambda x: (F.octet_length(x) > 2) & ~x.isin(*KEYWORD_STOP_WORDS)), 1, 20)


def scrubbed(text: Column) -> Column:
    """struct(text, n): secrets replaced family by family, and how many were."""
    n = F.lit(0)
    for rx, name in SECRETS:
        n = n + F.regexp_count(text, F.lit(rx))
        text = F.regexp_replace(text, rx, name)
    return F.struct(text.alias("text"), n.cast("long").alias("n"))


def node_id(*parts: Column) -> Column:
    """32 hex digits of the SHA-256 of the parts with bars between."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def signature(source: Column) -> Column:
    """The first line up to a brace, without a closing colon."""
    head = F.trim(F.substring_index(F.substring_index(source, "\n", 1), "{", 1))
    return F.rtrim(F.regexp_replace(head, ":$", ""))


def full_text(path: Column, sig: Column, identifiers: Column, doc: Column) -> Column:
    return F.concat_ws(" ", path, sig, F.when(F.size(identifiers) > 0, F.array_join(identifiers, " ")), doc)


def embedding_text(sig: Column, identifiers: Column, doc: Column) -> Column:
    return F.concat_ws(" ", sig, F.when(F.size(identifiers) > 0, F.array_join(identifiers, " ")), doc)


def is_literal_like(query: Column) -> Column:
    """A single token of 8 bytes or more with a sign, a digit or mixed case."""
    q = F.trim(query)
    return ~q.rlike(r"\s") & (F.octet_length(q) >= 8) & (q.rlike(r"[^\p{L}\p{N}]|\p{N}") | (q.rlike(r"\p{Lu}") & q.rlike(r"\p{Ll}")))


#: Extensions of files that a query can mention.
MENTIONED = "py|rs|js|ts|jsx|tsx|go|java|kt|rb|c|cpp|h|hpp|cs|swift|scala"


def looks_like_path(token: Column) -> Column:
    return (F.octet_length(token) >= 4) & token.rlike(r"[/\\]") & F.lower(token).rlike(rf"\.({MENTIONED})$")


def is_snake_case(token: Column) -> Column:
    """Letters, digits and at least one underscore, with a letter among them."""
    return token.rlike(r"^[\p{L}\p{N}_]+$") & token.rlike("_") & token.rlike(r"\p{L}")


def is_camel_case(token: Column) -> Column:
    """Letters and digits that begin with an upper-case letter and hold a lower-case one."""
    return token.rlike(r"^\p{Lu}[\p{L}\p{N}]*$") & token.rlike(r"\p{Ll}")


def is_dot_notation(token: Column) -> Column:
    return token.rlike(r"^[\p{L}\p{N}_]+(\.[\p{L}\p{N}_]+)+$")


def is_path_like(token: Column) -> Column:
    """Words with a slash between that are no file's path."""
    return (F.octet_length(token) >= 4) & token.rlike(r"^[\p{L}\p{N}/_.-]+$") & F.contains(token, F.lit("/")) & ~looks_like_path(token)


def approximate_timestamp(iso: Column) -> Column:
    """Seconds from a date as years of 365 and months of 30 days; null where it isn't one. For ordering only."""
    d = F.split(F.substring_index(iso, "T", 1), "-")
    number = lambda i: F.get(d, F.lit(i)).try_cast("long")
    return F.when(F.size(d) == 3, ((number(0) - 1970) * 365 + (number(1) - 1) * 30 + number(2)) * 86400)


def exact_timestamp(iso: Column) -> Column:
    """Seconds of an ISO 8601 time with its offset; 0 where it can't be read."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(iso)), F.lit(0)).cast("long")


def timestamp_or_unix(value: Column) -> Column:
    """Seconds from a number of seconds or (above 10^12) milliseconds, else from an ISO time."""
    n = value.try_cast("long")
    return F.when(n > 10**12, F.floor(n / 1000)).when(n.isNotNull(), n).otherwise(exact_timestamp(value))


def encoded_repo_path(path: Column) -> Column:
    """A path as the name of a folder of logs."""
    return F.translate(path, "/", "-")


def day_label(created_at: Column, now: int) -> Column:
    """How long ago, in whole days."""
    days = F.floor((F.lit(now) - created_at) / 86400)
    return F.when(days == 0, "today").when(days == 1, "yesterday").otherwise(F.concat(days.cast("string"), F.lit(" days ago")))


def date_label(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(F.floor(seconds / 86400) * 86400), "y-MM-dd")


def byte_label(n: Column, largest: str = "MB") -> Column:
    """Bytes with their unit, to one digit from a kilobyte on; KB or MB is the largest unit."""
    one = lambda d: F.format_string("%.1f", F.round(n / float(d), 1))
    kb = F.concat(one(1 << 10), F.lit(" KB"))
    label = F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B")))
    return label.otherwise(kb) if largest == "KB" else label.when(n < 1 << 20, kb).otherwise(F.concat(one(1 << 20), F.lit(" MB")))


def number_label(n: Column, commas: int | None = None) -> Column:
    """A whole number with a comma before every three digits, or before the last `commas` threes alone."""
    label = F.format_number(n.cast("long"), 0)
    if commas is None:
        return label
    kept = F.regexp_extract(label, rf"^(.*?)((?:,\d{{3}}){{0,{commas}}})$", 1)
    return F.concat(F.replace(kept, F.lit(","), F.lit("")), F.substring(label, F.length(kept) + 1, F.lit(1 << 30)))


#: Names of a node's domain.
DOMAINS = {"code": "code", "conversation": "conversation", "conv": "conversation", "chat": "conversation", "document": "document", "doc": "document", "structured": "structured", "data": "structured", "observation": "observation", "obs": "observation"}


def domain_of(name: Column) -> Column:
    """A domain by any of its names; null for others."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in DOMAINS.items() for x in kv]), F.lower(name))


def stripped(text: Column) -> Column:
    """text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def tag_block(text: Column, tag: str) -> Column:
    """What the first block of a tag holds, trimmed; null without one or where it is empty."""
    return F.nullif(stripped(F.regexp_extract(text, f"(?s)<{tag}>(.*?)</{tag}>", 1)), F.lit(""))


def user_text(text: Column) -> Column:
    """A user's own words: of texts that begin with an editor's notes only what is marked as the query."""
    notes = text.rlike(r"^\s*<(open_and_recently_viewed_files|user_info)>")
    return F.when(notes, F.coalesce(tag_block(text, "user_query"), F.lit(""))).otherwise(stripped(text))


def json_mentions(json: Column, part: str) -> Column:
    """Whether a string value anywhere in a JSON text holds part; keys don't count. Strings are read one after the other and whole, without going back, so a long one takes no stack."""
    strings = F.filter(F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]|\\.)*+"\s*+:?+'), F.lit(0)), lambda s: ~F.endswith(s, F.lit(":")))
    inner = lambda s: F.substring(F.regexp_replace(s, r'"\s*+\z', ""), 2, 1 << 30)
    return F.lit(bool(part)) & F.coalesce(F.exists(strings, lambda s: F.contains(F.replace(inner(s), F.lit("\\/"), F.lit("/")), F.lit(part))), F.lit(False))


def split_identifier(name: Column) -> Column:
    """Words of a camel, snake or acronym identifier, lower-cased, one space between."""
    x = F.regexp_replace(name, r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    x = F.regexp_replace(x, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.lower(F.trim(F.regexp_replace(x, r"[_\-\s]+", " ")))


def cut_at(text: Column, most: int) -> Column:
    """At most `most` characters, then dots where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
