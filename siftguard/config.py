"""Scan parameters."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

# Default folders to skip and default suffixes to keep.
EXCLUDED_DIRS = [".git", "__pycache__", "node_modules", ".venv", "venv", ".env", "dist", "build",
                 ".tox", ".mypy_cache"]
INCLUDED_EXTENSIONS = [".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".php", ".rb", ".go", ".cs",
                       ".cpp", ".c", ".h", ".sh", ".env", ".yml", ".yaml", ".json", ".xml",
                       ".html", ".cfg", ".ini", ".conf", ".toml", ".txt", ".lock", ".tf", ".hcl"]


@dataclass
class ScanConfig:
    """What to scan and what to report. Empty lists mean "all"."""

    min_severity: str = "INFO"
    exclude_dirs: list[str] = field(default_factory=lambda: list(EXCLUDED_DIRS))
    include_extensions: list[str] = field(default_factory=lambda: list(INCLUDED_EXTENSIONS))
    enabled_scanners: list[str] = field(default_factory=list)
    extra_secret_patterns: list[str] = field(default_factory=list)
    max_file_size: int = 1_000_000
    scan_binary: bool = False
    #: Word that precedes ``: ignore`` in suppression comments.
    suppression_word: str = "siftguard"


def read_settings(path: str) -> dict:
    """Read a small JSON or YAML mapping; anything unreadable counts as empty."""
    try:
        with open(path, encoding="utf-8") as handle:
            text = handle.read()
        if path.endswith(".json"):
            data = json.loads(text)
        else:
            import yaml  # optional dependency
            data = yaml.safe_load(text)
    except (ImportError, OSError, ValueError):
        return {}
    except Exception as error:  # a YAML library raises its own error types
        if type(error).__module__.split(".")[0] == "yaml":
            return {}
        raise
    return data if isinstance(data, dict) else {}


def load_config(path: str) -> ScanConfig:
    """Build a configuration from a settings file.

    A file that cannot be read gives the defaults. Settings apply in the order below; a
    value of the wrong shape ends the reading, and what was set before it stays.
    ``scan_binary`` is deliberately not read from files.
    """
    config = ScanConfig()
    if not os.path.isfile(path):
        return config
    data = read_settings(path)
    readers = {
        "min_severity": lambda v: str(v).upper(),
        "exclude_dirs": list,
        "include_extensions": list,
        "enabled_scanners": list,
        "extra_secret_patterns": list,
        "max_file_size": int,
        "suppression_word": str,
    }
    try:
        for name, reader in readers.items():
            if name in data:
                setattr(config, name, reader(data[name]))
    except (TypeError, ValueError):
        pass
    return config
