"""Definitions, spans and references of languages with brackets."""

import time

import pytest

from palimpsest.sources import code
from palimpsest.sources.scanner import Source


def parsed(text, ext):
    """{name: (kind, source of its span)}, and the names called."""
    nodes, refs = code._parsed(f"a.{ext}", text)
    raw = text.encode()
    return {n[1]: (n[0], raw[n[6] : n[7]].decode()) for n in nodes}, {name for name, kind, _ in refs if kind == "call"}


def test_braces_in_strings_comments_templates_and_patterns():
    text = 'function a() {\n  const s = "}"; // } not here()\n  const t = `}${ g({k: `}${h()}`}) }}`;\n  if (/[}/"]\\}/.test(s)) { x = 4 / 2; y = "b/c" }\n  /* } ghost() */\n  return b();\n}\nfunction last() { return 1 }\n'
    nodes, calls = parsed(text, "js")
    assert nodes["a"] == ("function", text[: text.index("function last") - 1]) and nodes["last"][1] == "function last() { return 1 }"
    assert calls == {"g", "h", "test", "b"}


def test_definitions_in_comments_and_strings_are_none():
    for ext, text in {"js": "// function ghost() {}\nlet s = 'class Ghost {';\n/* function ghost() {} */\nfunction real() {}\n", "rs": '/* /* fn ghost() {} */ fn ghost2() {} */\nfn real() { let s = r#"fn ghost() { " }"#; }\n', "go": 'var s = `\nfunc ghost() {\n`\nfunc real() {\n}\n', "java": 'class real { String s = """\nclass Ghost {\n"""; }\n'}.items():
        nodes, _ = parsed(text, ext)
        assert set(nodes) == {"real"} and nodes["real"][1].endswith("}"), ext


def test_rust():
    text = "struct Auth;\n\nimpl<'a> Auth {\n    /// Checks.\n    pub fn check(&self, c: [u8; 4]) -> bool {\n        let q = '{';\n        println!(\"{}\", helper(c));\n        true\n    }\n}\n\nfn helper(c: [u8; 4]) -> i32 { 42 }\ntrait T { fn must(&self); }\nmod m { fn inner() {} }\n"
    nodes, calls = parsed(text, "rs")
    assert {k: v[0] for k, v in nodes.items()} == {"Auth": "struct", "check": "method", "helper": "function", "T": "trait", "must": "method", "m": "module", "inner": "function"}
    assert nodes["Auth"][1] == "struct Auth;" and nodes["check"][1].endswith("true\n    }") and nodes["T"][1].endswith("}")
    assert {"println", "helper"} <= calls


def test_javascript_and_typescript():
    text = "class ApiClient {\n  constructor(url) { this.url = url; }\n  async get(path) {\n    if (path) { return fetchData(this.url + path); }\n  }\n}\n"
    nodes, calls = parsed(text, "js")
    assert {k: v[0] for k, v in nodes.items()} == {"ApiClient": "class", "get": "method"} and "fetchData" in calls
    text = 'interface User {\n  id: string;\n}\nfunction make(o: { name: string }): User {\n  return { id: "1" };\n}\nclass Service {\n  private users: User[] = [];\n\n  addUser(user: User): void {\n    this.users.push(user);\n  }\n\n  getUser(id: string): User | undefined {\n    return this.users.find((u) => u.id === id);\n  }\n}\nconst go = async (x) => {\n  await run(x);\n};\n'
    nodes, calls = parsed(text, "ts")
    assert {k: v[0] for k, v in nodes.items()} == {"User": "interface", "make": "function", "Service": "class", "addUser": "method", "getUser": "method", "go": "function"}
    assert nodes["make"][1].endswith('"1" };\n}') and nodes["go"][1].endswith("}") and {"push", "find", "run"} <= calls


def test_go_c_ruby_lua():
    nodes, calls = parsed('// Hello greets.\nfunc Hello(name string) string {\n\treturn fmt.Sprintf("{%s", name)\n}\nfunc (s *Server) Run() {\n\tHello("x")\n}\n', "go")
    assert {k: v[0] for k, v in nodes.items()} == {"Hello": "function", "Run": "method"} and {"Sprintf", "Hello"} <= calls
    nodes, _ = parsed("int add(int a) {\n  char c = '}';\n  return a;\n}\nstruct P { int x; };\nint million = 1'000'000;\nint sub(int a) { return a; }\n", "cpp")
    assert nodes["add"][1].endswith("return a;\n}") and nodes["P"][1] == "struct P { int x; }" and "sub" in nodes
    text = "module M\n  class A < B\n    # def ghost\n    def run(x)\n      return 1 if x\n      while x do\n        go { |y| y.end }\n      end\n      items.each do |i|\n        if i then puts 'end' end\n      end\n    end\n\n    def self.make\n    end\n  end\nend\n"
    nodes, _ = parsed(text, "rb")
    assert {k: v[0] for k, v in nodes.items()} == {"M": "module", "A": "class", "run": "method", "make": "method"}
    assert nodes["run"][1].count("\n") == 8 and nodes["M"][1] + "\n" == text and nodes["make"][1].strip() == "def self.make\n    end"
    nodes, calls = parsed("--[[ function ghost() end ]]\nfunction m.add(a)\n  if a then return [[end]] end\n  for i = 1, 2 do print(i) end\nend\nfunction two() end\n", "lua")
    assert set(nodes) == {"m.add", "two"} and nodes["m.add"][1].endswith("do print(i) end\nend") and "print" in calls


def test_bytes_and_unclosed():
    text = "// é日本🙂\nfunction añ() { return 1 }\nfunction b() { 'é }\n"
    nodes, _ = parsed(text.replace("añ", "an"), "js")
    assert nodes["an"][1] == "function an() { return 1 }"
    for ext in ("js", "rs", "go", "java", "cpp", "rb", "lua", "swift"):
        for text in ("", "function f( {", "}}}", "/* never", '"never', "`${`${", "class A {\n\n", "def x\n", "fn f() { (]}"):
            code._parsed(f"a.{ext}", text)


@pytest.mark.parametrize("ext", ["js", "rs", "go", "java"])
def test_long_files_take_seconds(ext):
    one = {"js": "// é note {k}\nfunction f%d(a) {\n  return g('}', `x${a}`) / 2;\n}\n", "rs": "/// é note\nfn f%d(a: u8) -> u8 {\n    g(\"}\", a)\n}\n", "go": "// é note\nfunc f%d(a int) int {\n\treturn g(\"}\", a)\n}\n", "java": "// é note\nclass F%d {\n  int x = g(\"}\");\n}\n"}[ext]
    text = "".join(one % k for k in range(1 + 4_000_000 // len(one)))
    began = time.time()
    nodes, refs = code._parsed(f"a.{ext}", text)
    assert len(nodes) == text.count(one[:8]) == len([r for r in refs if r[0] == "g"]) and time.time() - began < 30


def test_source_keeps_places():
    text = "a = 'x' // y\n{ `t` }"
    s = Source(text, "javascript")
    assert len(s.bare) == len(s.code) == len(text) and s.bare == "a =         \n{     }" and s.code == "a = 'x'     \n{ `t` }"
