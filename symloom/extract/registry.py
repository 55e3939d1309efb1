"""Languages: a name, the suffixes that tell it, and its parser. Another language is another row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from ..schema import LANGUAGE_BY_SUFFIX
from .model import FileExtract, Finds, assemble


@dataclass(frozen=True)
class Language:
    name: str
    find: Callable[[str, bytes], Finds]
    suffixes: tuple[str, ...] = ()


LANGUAGES: dict[str, Language] = {}


def register(language: Language) -> None:
    """Add a language, or replace the one of its name."""
    LANGUAGES[language.name] = language


def language_for_path(path: str) -> str | None:
    """By the name of a file in either case, the longest suffix first; None if no language has it."""
    low = path.lower()
    known = {s: name for name, x in LANGUAGES.items() for s in x.suffixes}
    for suffix in sorted(known, key=lambda s: (-len(s), s)):
        if low.endswith(suffix):
            return known[suffix]
    return None


def extract_source(path: str, source: bytes, language: str | None = None) -> FileExtract:
    """Symbols, references and imports of one text."""
    name = language or language_for_path(path)
    if name not in LANGUAGES:
        raise ValueError(f"no parser for {path}")
    return assemble(path, LANGUAGES[name].find(path, source))


def _register_all() -> None:
    from . import php, python, script, templates

    parsers = {"python": python.find, "typescript": script.typescript, "tsx": script.typescript, "javascript": script.javascript, "php": php.find, "vue": templates.vue, "blade": templates.blade}
    for name, parser in parsers.items():
        register(Language(name, parser, tuple(s for s, n in LANGUAGE_BY_SUFFIX.items() if n == name)))


_register_all()
