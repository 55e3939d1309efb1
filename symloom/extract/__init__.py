"""Extraction: the text of a file -> its symbols, references and imports, for each language that is registered."""

from __future__ import annotations

from .model import FileExtract
from .registry import LANGUAGES, Language, extract_source, language_for_path, register

__all__ = ["LANGUAGES", "FileExtract", "Language", "extract_source", "language_for_path", "register"]
