"""Block types from outside the library: Python files or modules that register blocks when they are loaded.

A plugin calls plans.graph.block or plain, and may describe itself in PLUGIN (name, author, version, license). What fails to
load is kept with its error and leaves no block behind.
"""

from __future__ import annotations

import importlib
import importlib.util
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from sampleweave.plans.graph import BLOCKS


@dataclass
class Plugin:
    source: str
    blocks: tuple[str, ...]
    about: dict[str, str]


@dataclass
class Loader:
    loaded: dict[str, Plugin] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)

    def load(self, source: str) -> Plugin | None:
        """A module by its name, or a .py file by its path; None where it fails, with the error in failed."""
        if source in self.loaded:
            return self.loaded[source]
        before = dict(BLOCKS)
        try:
            module = self.module(source)
            about = getattr(module, "PLUGIN", {})
            if not isinstance(about, dict):
                raise TypeError("PLUGIN is no dict")
            taken = sorted(n for n, made in before.items() if BLOCKS.get(n) is not made)
            if taken:
                raise ValueError(f"blocks that exist: {', '.join(taken)}")
        except Exception as error:  # a plugin is foreign code: whatever it raises is its failure, not the loader's
            BLOCKS.clear()
            BLOCKS.update(before)
            self.failed[source] = f"{type(error).__name__}: {error}"
            return None
        self.failed.pop(source, None)
        self.loaded[source] = Plugin(source, tuple(n for n in BLOCKS if n not in before), about)
        return self.loaded[source]

    def load_folder(self, folder: str) -> list[Plugin]:
        """Every .py file of a folder, in order of name."""
        return [p for p in (self.load(str(f)) for f in sorted(Path(folder).glob("*.py"))) if p is not None]

    def unload(self, source: str) -> None:
        for name in self.loaded.pop(source).blocks:
            BLOCKS.pop(name, None)

    @staticmethod
    def module(source: str) -> Any:
        if not source.endswith(".py"):
            return importlib.import_module(source)
        spec = importlib.util.spec_from_file_location(Path(source).stem, source)
        made = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(made)
        return made
