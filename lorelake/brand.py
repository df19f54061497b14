"""Product wording that appears inside stored files and rendered text.

The review block marker, the ignore-file name, pack headings and a few
messages carry the name of the workspace product that wrote the corpus.  It is
one parameter, so byte-identical output only needs ``Brand("<product>")``.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Brand:
    name: str = "Workspace"

    @property
    def slug(self) -> str:
        return self.name.lower()

    @property
    def review_marker(self) -> str:
        return f"<!-- {self.slug}-review:v1"

    @property
    def ignore_file(self) -> str:
        return f".{self.slug}ignore"

    @property
    def lint_tool(self) -> str:
        return f"{self.slug}-okf-lint"


DEFAULT = Brand()
