"""Scan parameters."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ScanOptions:
    """Thresholds, toggles, path filters and own rules of one scan.

    ``dead_code`` is off by default: the default scan runs the four standard detectors.  ``rules``
    come on top of the fixed ones (`given_rules` reads them from a table); ``layers`` and
    ``forbidden`` replace the fixed layers and pairs (`given_layers`, `given_pairs`).
    """

    exclude: tuple[str, ...] = field(default_factory=tuple)
    root: str = ""
    god_function_lines: int = 80
    duplicate_min_lines: int = 8
    naming_min_files: int = 5
    duplication: bool = True
    anti_patterns: bool = True
    naming: bool = True
    boundaries: bool = True
    dead_code: bool = False
    rules: tuple = ()
    layers: tuple[tuple[str, str], ...] = ()
    forbidden: tuple[tuple[str, str], ...] = ()

    def __post_init__(self) -> None:
        for name in ("exclude", "rules", "layers", "forbidden"):
            object.__setattr__(self, name, tuple(getattr(self, name)))
