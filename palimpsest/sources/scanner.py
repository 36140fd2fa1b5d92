"""One pass over a source file of a language with brackets: what is code, and where brackets, lines and bytes are."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import cached_property

import numpy as np

_C_STRING = r'"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)'
_CHAR = r"'(?:\\[^\n][^'\n]{0,9}|[^'\\\n])'"
_LINE, _BLOCK = r"//[^\n]*", r"/\*"
_TRIPLE = r'"""(?:\\.|[^\\])*?(?:"""|\Z)'
_QUOTED = r"'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)"
#: Per language what is not code: comments, then strings. A block comment's and a template's end are looked for by themselves.
NOT_CODE = {
    "rust": ([_LINE, _BLOCK], [r'r(?P<hash>#*)".*?(?:"(?P=hash)|\Z)', r'"(?:\\.|[^"\\])*(?:"|\Z)', _CHAR]),
    "javascript": ([_LINE, _BLOCK], [_C_STRING, _QUOTED, "`", "/"]),
    "go": ([_LINE, _BLOCK], [_C_STRING, r"`[^`]*(?:`|\Z)", _CHAR]),
    "java": ([_LINE, _BLOCK], [_TRIPLE, _C_STRING, _CHAR]),
    "c": ([_LINE, _BLOCK], [r'R"(?P<tag>[^()\\\s]{0,16})\(.*?(?:\)(?P=tag)"|\Z)', _C_STRING, rf"(?<![0-9A-Fa-f]){_CHAR}"]),
    "ruby": ([r"#[^\n]*", r"^=begin\b.*?(?:^=end\b[^\n]*|\Z)"], [r'"(?:\\.|[^"\\])*(?:"|\Z)', r"'(?:\\.|[^'\\])*(?:'|\Z)"]),
    "lua": ([r"--\[(?P<level>=*)\[.*?(?:\](?P=level)\]|\Z)", r"--[^\n]*"], [r"\[(?P<long>=*)\[.*?(?:\](?P=long)\]|\Z)", _C_STRING, _QUOTED]),
    "swift": ([_LINE, _BLOCK], [_TRIPLE, _C_STRING]),
}
NOT_CODE["typescript"] = NOT_CODE["tsx"] = NOT_CODE["javascript"]
NOT_CODE["cpp"] = NOT_CODE["c"]
#: Languages whose block comments nest.
NESTED = ("rust", "swift")
_TOKENS = {k: re.compile("|".join([f"(?P<comment>{'|'.join(c)})", f"(?P<string>{'|'.join(s)})", "(?P<brace>[{}])"]), re.S | re.M) for k, (c, s) in NOT_CODE.items()}
_REGEX = re.compile(r"/(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_BEFORE_REGEX = re.compile(r"(?:^|[^\w$)\]}.]|\b(?:return|typeof|case|in|of|delete|void|throw|new|else|do|yield|await))\Z")
#: Words that open what `end` closes.
_RUBY = re.compile(r"(?<![.:\w@$])(?:(?P<open>class|module|def|begin|case|do)|(?P<test>if|unless|while|until|for)|(?P<close>end))(?![\w?!]|:(?!:))")
_LUA = re.compile(r"(?<![.:\w])(?:(?P<open>function|if|do|repeat)|(?P<close>end|until))(?!\w)")


def _blank(text: str) -> str:
    """Spaces in place of all but line ends."""
    return "\n".join([" " * len(x) for x in text.split("\n")])


class Source:
    """text, bare (without comments and strings, the same length), code (without comments alone), and look-ups in both.

    A string that isn't closed ends with its line where the language's strings do. Brackets that don't match close what they can.
    """

    def __init__(self, text: str, language: str) -> None:
        self.text, self.language = text, language
        self.bare, self.code = self._scanned()

    def _block_end(self, at: int) -> int:
        depth = 0
        for m in re.compile(r"/\*|\*/").finditer(self.text, at):
            depth = depth + 1 if m[0] == "/*" and (depth == 0 or self.language in NESTED) else depth - 1 if m[0] == "*/" else depth
            if depth == 0:
                return m.end()
        return len(self.text)

    def _scanned(self) -> tuple[str, str]:
        text, tokens = self.text, _TOKENS[self.language]
        bare, code, at, copied, depth, templates = [], [], 0, 0, 0, []

        def drop(start: int, end: int, comment: bool) -> None:
            nonlocal copied
            kept, gone = text[copied:start], _blank(text[start:end])
            bare.extend((kept, gone))
            code.extend((kept, gone if comment else text[start:end]))
            copied = end

        def template(start: int) -> int:
            """From within a template to its end, or to the code that it holds."""
            for m in re.compile(r"\\.|`|\$\{", re.S).finditer(text, start):
                if m[0] == "`":
                    return m.end()
                if m[0] == "${":
                    templates.append(depth)
                    return m.end()
            return len(text)

        while m := tokens.search(text, at):
            start, at = m.start(), m.end()
            if m.lastgroup == "brace" or m["brace"]:
                if m[0] == "}" and templates and templates[-1] == depth:
                    templates.pop()
                    at = template(at)
                    drop(start, at, False)
                else:
                    depth += 1 if m[0] == "{" else -1
                continue
            if m["comment"]:
                at = self._block_end(start) if m[0] == "/*" else at
                drop(start, at, True)
            elif m[0] == "`":
                at = template(at)
                drop(start, at, False)
            elif m[0] == "/":
                k = start
                while k > copied and text[k - 1] in " \t\r\n":
                    k -= 1
                literal = _REGEX.match(text, start) if _BEFORE_REGEX.search(text[max(copied, k - 12) : k]) else None
                if literal:
                    at = literal.end()
                    drop(start, at, False)
            else:
                drop(start, at, False)
        bare.append(text[copied:])
        code.append(text[copied:])
        return "".join(bare), "".join(code)

    @cached_property
    def _tree(self) -> tuple[list[int], list[int], list[int], dict[int, list[int]], dict[int, list[int]]]:
        """Brackets: opening places, closing places, the bracket around each (-1: none); by bracket the braces right in it and the semicolons right in it."""
        opens, closes, around, braces, stops, stack = [], [], [], {}, {}, []
        pairs = {")": "(", "]": "[", "}": "{"}
        for m in re.finditer(r"[()\[\]{};]", self.bare):
            c, inside = m[0], stack[-1] if stack else -1
            if c == ";":
                stops.setdefault(inside, []).append(m.start())
            elif c in "([{":
                if c == "{":
                    braces.setdefault(inside, []).append(len(opens))
                stack.append(len(opens))
                opens.append(m.start())
                closes.append(len(self.bare))
                around.append(inside)
            elif any(self.bare[opens[b]] == pairs[c] for b in stack[-8:]):
                while self.bare[opens[stack[-1]]] != pairs[c]:
                    closes[stack.pop()] = m.start()
                closes[stack.pop()] = m.end()
        return opens, closes, around, braces, stops

    def enclosing(self, at: int) -> int:
        """The innermost bracket around a place, or -1."""
        opens, closes, around, _, _ = self._tree
        b = bisect_left(opens, at) - 1
        while b >= 0 and closes[b] <= at:
            b = around[b]
        return b

    def brace_place(self, b: int) -> int:
        return self._tree[0][b] if b >= 0 else -1

    def closing(self, at: int) -> int:
        """Past the bracket that closes the one at a place."""
        opens, closes = self._tree[:2]
        return closes[bisect_left(opens, at)]

    def block(self, at: int) -> tuple[int, int]:
        """(place of the brace, place past its end) of the block that what stands at a place opens; the line's end twice if a semicolon, or an empty line, comes first."""
        opens, closes, _, braces, stops = self._tree
        inside = self.enclosing(at)
        own, ends = braces.get(inside, []), stops.get(inside, [])
        k, s = bisect_left(own, bisect_left(opens, at)), bisect_left(ends, at)
        line = self.line_end(at)
        if k == len(own):
            return line, line
        brace = opens[own[k]]
        gap = bisect_left(self._gaps, at)
        if (s < len(ends) and ends[s] < brace) or (gap < len(self._gaps) and self._gaps[gap] < brace):
            return line, line
        return brace, closes[own[k]]

    @cached_property
    def _gaps(self) -> list[int]:
        return [m.start() for m in re.finditer(r"\n[ \t\r]*(?=\n)", self.text)]

    @cached_property
    def ends(self) -> dict[int, int]:
        """Where what a word opens ends, for languages that close with `end`."""
        out, stack, waiting = {}, [], -1
        for m in (_LUA if self.language == "lua" else _RUBY).finditer(self.bare):
            if m["close"]:
                if stack:
                    out[stack.pop()] = m.end()
                continue
            if self.language == "ruby":
                if m["test"]:
                    head = self.bare[self.bare.rfind("\n", 0, m.start()) + 1 : m.start()]
                    if head.strip() and not re.search(r"[=(;|&]\s*\Z|\b(?:else|then|return)\s+\Z", head):
                        continue  # what follows a statement opens nothing
                    waiting = self.line_of(m.start()) if m[0] in ("while", "until", "for") else waiting
                elif m[0] == "do" and waiting == self.line_of(m.start()):
                    continue
            stack.append(m.start())
        for start in stack:
            out[start] = len(self.text)
        return out

    @cached_property
    def _lines(self) -> list[int]:
        return [m.start() for m in re.finditer("\n", self.text)]

    def line_of(self, at: int) -> int:
        return bisect_left(self._lines, at)

    def line_start(self, at: int) -> int:
        k = bisect_left(self._lines, at)
        return self._lines[k - 1] + 1 if k else 0

    def line_end(self, at: int) -> int:
        k = bisect_left(self._lines, at)
        return self._lines[k] if k < len(self._lines) else len(self.text)

    @cached_property
    def lines(self) -> list[str]:
        return self.text.split("\n")

    @cached_property
    def _bytes(self) -> np.ndarray | None:
        if self.text.isascii():
            return None
        c = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), "<u4")
        return np.concatenate([[0], np.cumsum(1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))])

    def byte(self, at: int) -> int:
        return at if self._bytes is None else int(self._bytes[at])

    def lines_before(self, at: int) -> int:
        return bisect_right(self._lines, at)
