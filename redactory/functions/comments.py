"""Where comments are in source text, by language.

Languages are scanned by the lexical form of their comments and strings: line marks, block marks, quotes. Texts above the limit and
unknown languages have no comments, so nothing in them is let through.
"""

from __future__ import annotations

import re

LIMIT = 512 * 1024

# Language names by editor id or file extension.
LANGUAGES = {
    "typescript": "typescript ts mts cts", "tsx": "typescriptreact tsx", "javascript": "javascript javascriptreact js mjs cjs jsx", "json": "json jsonc", "python": "python py pyi",
    "ruby": "ruby rb", "go": "go", "rust": "rust rs", "java": "java", "kotlin": "kotlin kt kts", "c": "c h", "cpp": "cpp cc cxx hpp hh", "c_sharp": "csharp cs", "php": "php", "swift": "swift",
    "scala": "scala", "lua": "lua", "bash": "shellscript sh bash zsh", "yaml": "yaml yml", "toml": "toml", "css": "css", "html": "html htm", "vue": "vue", "dart": "dart",
    "elixir": "elixir ex exs", "elm": "elm", "zig": "zig", "solidity": "solidity sol",
}
_BY_NAME = {n: k for k, v in LANGUAGES.items() for n in v.split()}

_STRING = r""""(?:[^"\\\n]|\\.)*+"?|'(?:[^'\\\n]|\\.)*+'?"""
_C_LIKE = rf"(?P<skip>{_STRING}|`(?:[^`\\]|\\.)*+`?)|(?P<comment>//[^\n]*+|/\*(?s:.*?)(?:\*/|\Z))"
_PYTHON = rf"(?P<skip>\"\"\"(?s:.*?)(?:\"\"\"|\Z)|'''(?s:.*?)(?:'''|\Z)|{_STRING})|(?P<comment>#[^\n]*+)"
_HASH = rf"(?P<skip>{_STRING})|(?P<comment>(?<!\S)#[^\n]*+)"
_FORMS = {
    **dict.fromkeys("typescript tsx javascript json go rust java kotlin c cpp c_sharp swift scala dart zig solidity".split(), _C_LIKE),
    "python": _PYTHON,
    **dict.fromkeys(("yaml", "toml", "bash"), _HASH),
    **dict.fromkeys(("ruby", "elixir"), rf"(?P<skip>{_STRING})|(?P<comment>#[^\n]*+)"),
    "php": rf"(?P<skip>{_STRING})|(?P<comment>(?://|#)[^\n]*+|/\*(?s:.*?)(?:\*/|\Z))",
    "css": rf"(?P<skip>{_STRING})|(?P<comment>/\*(?s:.*?)(?:\*/|\Z))",
    "html": r"(?P<skip>(?!))|(?P<comment><!--(?s:.*?)(?:-->|\Z))",
    "vue": r"(?P<skip>(?!))|(?P<comment><!--(?s:.*?)(?:-->|\Z))",
    "lua": rf"(?P<skip>{_STRING})|(?P<comment>--\[\[(?s:.*?)(?:\]\]|\Z)|--[^\n]*+)",
    "elm": rf"(?P<skip>{_STRING})|(?P<comment>\{{-(?s:.*?)(?:-\}}|\Z)|--[^\n]*+)",
}
_COMPILED = {k: re.compile(v) for k, v in _FORMS.items()}


def language_of(name: str) -> str | None:
    """The language of an editor id or a file name."""
    low = name.lower()
    return _BY_NAME.get(low) or _BY_NAME.get(low.rpartition(".")[2] if "." in low else "")


def hash_comments(text: str) -> list[tuple[int, int]]:
    """Comments of YAML and TOML: a hash at the start of a line or after white space, outside quotes; quotes end with their line."""
    return comment_ranges(text, "yaml")


def comment_ranges(text: str, language: str | None) -> list[tuple[int, int]]:
    form = _COMPILED.get(language or "")
    return [] if form is None or len(text) > LIMIT else [m.span() for m in form.finditer(text) if m["comment"] is not None]
