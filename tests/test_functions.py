"""Scalar functions and path predicates against tables of cases."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import paths as P
from palimpsest.functions import text as T

CASES = [
    # path, test, noncode, fixture, excluded
    ("src/a.py", 0, 0, 0, 0),
    ("tests/test_a.py", 1, 0, 0, 0),
    ("pkg/tests/a.js", 1, 0, 0, 0),
    ("src\\tests\\a.js", 1, 0, 0, 0),
    ("spec/a.rb", 0, 0, 0, 0),
    ("x/spec/a.rb", 1, 0, 0, 0),
    ("a.test.tsx", 1, 0, 0, 0),
    ("a_test.go", 1, 0, 0, 0),
    ("conftest.py", 1, 0, 0, 0),
    ("FooTest.java", 1, 0, 0, 0),
    ("footest.java", 0, 0, 0, 0),
    ("CHANGELOG", 0, 1, 0, 1),
    ("docs/guide.html", 0, 1, 0, 1),
    ("guide.html", 0, 0, 0, 0),
    ("notes.mdx", 0, 0, 0, 1),
    ("a/fixtures/b.js", 0, 0, 1, 0),
    ("a/samples/b/expected.js", 0, 0, 1, 0),
    ("a/test/b-bundle.js", 1, 0, 1, 0),
    ("x.snap", 0, 0, 1, 0),
    ("benchmarks/b.py", 0, 0, 1, 0),
    ("package.json", 0, 0, 0, 0),
    ("other.json", 0, 0, 0, 1),
]


def test_path_flags(spark):
    p = F.col("p")
    rows = spark.createDataFrame([(c[0],) for c in CASES], "p string").select("p", P.is_test_file(p), P.is_noncode_file(p), P.is_test_fixture(p), P.should_exclude_from_search(p)).collect()
    assert {tuple(r) for r in rows} == {(c[0], *map(bool, c[1:])) for c in CASES}


@pytest.mark.parametrize(
    ("path", "want"),
    [
        ("src/foo.test.ts", ["src/foo.ts"]),
        ("src/__tests__/foo.spec.js", ["src/__tests__/foo.js", "src/foo.js"]),
        ("tests/sub/test_foo.py", ["foo.py", "src/foo.py", "lib/foo.py", "sub/foo.py", "src/sub/foo.py"]),
        ("foo_test.py", ["foo.py", "src/foo.py"]),
        ("pkg/foo_test.go", ["pkg/foo.go"]),
        ("src/test/java/FooTest.java", ["src/main/java/Foo.java", "src/test/java/Foo.java"]),
        ("src/foo.py", []),
    ],
)
def test_source_candidates(spark, path, want):
    assert spark.range(1).select(P.source_candidates(F.lit(path))).first()[0] == want


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_query_terms(spark):
    terms = lambda q: one(spark, T.query_terms(F.lit(q)))
    assert terms("How does the Parser parse a parser?") == ["parser", "parse"]
    assert terms("what is it") == ["what", "is", "it"]
    assert terms("Größe der Datei_Name 2x") == ["größe", "der", "datei", "name", "2x"]
    assert terms("") == []


def test_scrub(spark):
    secrets = ["sk-" + "proj-" + "a1" * 25, "sk-" + "b2" * 15, "github" + "_pat_" + "c" * 30, "ghp" + "_" + "d" * 36, "AK" + "IA" + "E" * 16, "-----BEGIN RSA " + "PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "Bear" + "er abc.def", "xox" + "b-" + "1" * 12, "me.too+x@mail.example.org"]
    got = one(spark, T.scrubbed(F.lit("x " + " y ".join(secrets) + " z")))
    assert got.n == len(secrets)
    assert not any(s in got.text for s in secrets) and got.text.startswith("x <REDACTED_API_KEY> y")
    assert tuple(one(spark, T.scrubbed(F.lit("nothing here")))) == ("nothing here", 0)


def test_small_functions(spark):
    f = lambda c: one(spark, c)
    assert f(T.estimated_tokens(F.lit("éééé"))) == 2
    assert f(T.signature(F.lit("def f(a, b):\n  pass"))) == "def f(a, b)"
    assert f(T.signature(F.lit("fn f() -> u8 { 1 }"))) == "fn f() -> u8"
    assert f(T.split_identifier(F.lit("parseHTTPResponse_code"))) == "parse http response code"
    assert f(T.approximate_timestamp(F.lit("1971-02-03T00:00:00Z"))) == (365 + 30 + 3) * 86400
    assert f(T.exact_timestamp(F.lit("2024-01-01T01:00:00+01:00"))) == 1704067200
    assert f(T.exact_timestamp(F.lit("soon"))) == 0
    assert f(T.timestamp_or_unix(F.lit("1704067200000"))) == 1704067200
    assert f(T.is_literal_like(F.lit("parse_doc"))) and not f(T.is_literal_like(F.lit("two words"))) and not f(T.is_literal_like(F.lit("lowercase")))
    assert f(T.is_snake_case(F.lit("a_b"))) and f(T.is_camel_case(F.lit("AbC"))) and not f(T.is_camel_case(F.lit("aB"))) and not f(T.is_camel_case(F.lit("ABC"))) and f(T.is_dot_notation(F.lit("a.b.c"))) and not f(T.is_dot_notation(F.lit("a..b")))
    assert f(P.language_name(F.lit("a/b.kt"))) == "Kotlin" and f(P.language_name(F.lit("a.xyz"))) == "xyz"
    assert f(P.is_discovered(F.lit("src/a.py"))) and not f(P.is_discovered(F.lit("node_modules/a.js"))) and not f(P.is_discovered(F.lit("a.min.js"))) and not f(P.is_discovered(F.lit(".git/x")))


def test_long_strings_in_json(spark):
    """A string of half a million signs and escapes takes no stack."""
    long = '{"k": "' + 'a\\n"'.replace('"', '\\"') * 150_000 + '", "/w/repo": 1, "p": "at /w/repo/x"}'
    df = spark.createDataFrame([(long,), (long.replace("at /w/repo", "at /w"),)], "j string")
    assert [r.x for r in df.select(T.json_mentions(F.col("j"), "/w/repo").alias("x")).collect()] == [True, False]


def test_labels_of_large_numbers(spark):
    df = spark.createDataFrame([(x,) for x in (0, 999, 1023, 1024, 1_048_575, 1_048_576, 1_234_567, 1_234_567_890)], "n long")
    got = [tuple(r) for r in df.select(T.byte_label(F.col("n")), T.byte_label(F.col("n"), "KB"), T.number_label(F.col("n")), T.number_label(F.col("n"), 1)).collect()]
    assert got[:2] == [("0 B", "0 B", "0", "0"), ("999 B", "999 B", "999", "999")]
    assert got[5] == ("1.0 MB", "1024.0 KB", "1,048,576", "1048,576") and got[7][2:] == ("1,234,567,890", "1234567,890")
