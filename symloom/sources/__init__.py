"""Sources: working trees, git revisions, indexes of other tools, fact files, prompts, transcripts, synthetic repositories."""

from __future__ import annotations

from .tree import GitRevision, Tree, WorkingTree

__all__ = ["GitRevision", "Tree", "WorkingTree"]
