"""Source text with comments and strings blanked out, its blocks and the headers in front of them."""

from __future__ import annotations

import re
from bisect import bisect_right

_COMMENT = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_DOUBLE = r'"(?:\\.|[^"\\\n])*"?'
_SINGLE = r"'(?:\\.|[^'\\\n])*'?"
_CHAR = r"'(?:\\(?:u\{[0-9a-fA-F]*\}|x[0-9a-fA-F]{2}|.)|[^'\\\n])'"

# What is blanked, by language; the first alternative that matches at a place wins.
_BLANKED = {
    "go": rf"{_COMMENT}|`[^`]*`?|{_DOUBLE}|{_CHAR}",
    "rust": rf'{_COMMENT}|r(#*)".*?"\1|{_DOUBLE}|{_CHAR}',
    "java": rf'{_COMMENT}|""".*?"""|{_DOUBLE}|{_CHAR}',
    "c": rf"{_COMMENT}|{_DOUBLE}|{_CHAR}",
    "csharp": rf'{_COMMENT}|@"(?:""|[^"])*"?|{_DOUBLE}|{_CHAR}',
    "script": rf"{_COMMENT}|`(?:\\.|[^`\\])*`?|{_DOUBLE}|{_SINGLE}",
}
_FAMILY = {"typescript": "script", "tsx": "script", "javascript": "script", "cpp": "c"}


def blanked(text: str, language: str) -> str:
    """Text of the same length in which comments and the insides of strings are spaces; line ends stay."""
    pattern = re.compile(_BLANKED[_FAMILY.get(language, language)], re.S)

    def blank(m: re.Match) -> str:
        s = m[0]
        if s.startswith(("//", "/*")):
            return re.sub(r"[^\n]", " ", s)
        return s[0] + re.sub(r"[^\n]", " ", s[1:-1]) + s[-1] if len(s) > 1 else s

    return pattern.sub(blank, text)


class Source:
    """A file's text, its blanked form, line numbers, and the place of the matching brace for each opening one."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.code = blanked(text, language)
        self.line_starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.close, self.open_before = {}, []
        stack = []
        for m in re.finditer(r"[{}]", self.code):
            if m[0] == "{":
                stack.append(m.start())
            elif stack:
                self.close[stack.pop()] = m.start()
        for at in stack:  # unclosed blocks run to the end
            self.close[at] = len(text) - 1 if text else 0

    def line(self, at: int) -> int:
        return bisect_right(self.line_starts, at)

    def balanced(self, at: int, opening: str = "(", closing: str = ")") -> int:
        """The place after the bracket that closes the one at `at`; the end of the text if none does."""
        depth = 0
        for i in range(at, len(self.code)):
            if self.code[i] == opening:
                depth += 1
            elif self.code[i] == closing:
                depth -= 1
                if depth == 0:
                    return i + 1
        return len(self.code)

    def blocks(self):
        """(header start, header, brace, end) of every block; the header follows the last `;`, brace or directive."""
        for brace in sorted(self.close):
            start, depth = brace, 0
            while start > 0:
                c = self.code[start - 1]
                if c in ")]":
                    depth += 1
                elif c in "([":
                    if depth == 0:
                        break
                    depth -= 1
                elif c in ";{}" and depth == 0:
                    break
                start -= 1
            raw = self.code[start:brace]
            cut = [m.end() for m in re.finditer(r"^[ \t]*#[^\n]*\n|\b(?:public|private|protected)\s*:(?!:)", raw, re.M)]
            start += cut[-1] if cut else 0
            header = self.code[start:brace]
            yield start + len(header) - len(header.lstrip()), header.strip(), brace, self.close[brace] + 1
