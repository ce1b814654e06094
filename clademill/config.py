"""Parameters of the tools, from dataclass defaults or an INI file."""

from __future__ import annotations

import configparser
import dataclasses
from fractions import Fraction


def number(text: str) -> float:
    """A decimal number or a fraction such as ``3/4``."""
    return float(Fraction(text.strip()))


def names(text: str) -> tuple[str, ...]:
    """A comma-separated list, with or without brackets and quotes; ``None`` and nothing are empty."""
    items = [x.strip().strip("\"'") for x in text.strip().strip("[]").split(",")]
    return tuple(x for x in items if x and x != "None")


def check(ok: bool, text: str) -> None:
    if not ok:
        raise ValueError(text)


@dataclasses.dataclass(frozen=True)
class Primary:
    min_taxa: int = 1
    min_align_len: int = 300
    max_targets: int = 10
    max_evalue: float = 1e-100


@dataclasses.dataclass(frozen=True)
class Secondary:
    by_size: bool = True
    by_taxa: bool = False
    min_taxa: int = 1
    max_size: int = 80
    max_occurrence: int = 4
    min_align_len: int = 1000
    max_evalue: float = 1e-300


@dataclasses.dataclass(frozen=True)
class Phasing:
    min_share: float = 0.33
    min_coverage: int = 4
    stringency: float = 0.5
    excluded_taxa: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        check(0 <= self.stringency <= 1 and 0 < self.min_share <= 1, "shares must lie between 0 and 1")


@dataclasses.dataclass(frozen=True)
class Trim:
    window: int = 12
    ungapped: float = 0.25
    acid_share: float = 0.5
    max_gap: float = 0.9

    def __post_init__(self) -> None:
        check(self.window >= 3, "window must be at least 3")
        check(all(0 <= x <= 1 for x in (self.ungapped, self.acid_share, self.max_gap)), "shares must lie between 0 and 1")


@dataclasses.dataclass(frozen=True)
class Clean:
    window: int = 50
    k: int = 10
    min_similarity: int = 6
    share: float = 0.6
    gap_run: int = 7
    max_ambiguous: float = 0.95
    min_length: int = 300
    min_taxa: int = 3

    def __post_init__(self) -> None:
        check(0 < self.min_similarity < self.k <= self.window, "it has to be 0 < min_similarity < k <= window")


@dataclasses.dataclass(frozen=True)
class Outparalogs:
    kmers: tuple[int, ...] = (6, 9, 12, 15)
    min_overlap: int = 300
    max_alleles: int = 5
    max_jaccard: float = 0.75
    large_ratio: float = 0.5
    min_association: float = 2 / 3
    max_distance: float = 25.0


@dataclasses.dataclass(frozen=True)
class Inparalogs:
    min_taxa_share: float = 0.0
    distance_ratio: float = 5.0
    max_jaccard: float = 0.5
    large_ratio: float = 0.5
    overlap_splitting: int = 200
    overlap_merging: int = 300
    max_allele_distance: float = 4.0
    excluded_taxa: tuple[str, ...] = ()


@dataclasses.dataclass(frozen=True)
class Fragments:
    length: int = 50
    flank: int = 15
    tiny: int = 3


@dataclasses.dataclass(frozen=True)
class Assembly:
    overlap_threshold: int = 200
    mismatch_cost: float = 20.0
    overlap_cost: float = 1.0


def load(kind: type, path: str, section: str):
    """The dataclass ``kind`` with the values that the section of an INI file gives; unknown keys are an error."""
    parser = configparser.ConfigParser(interpolation=configparser.ExtendedInterpolation())
    with open(path) as lines:
        parser.read_file(lines)
    fields = {f.name: f for f in dataclasses.fields(kind)}
    given = dict(parser[section]) if parser.has_section(section) else {}
    unknown = sorted(given.keys() - fields.keys() - parser.defaults().keys())
    check(not unknown, f"unknown keys in {section}: {', '.join(unknown)}")

    def typed(name: str, text: str):
        default = fields[name].default
        if isinstance(default, bool):
            return parser[section].getboolean(name)
        if isinstance(default, int):
            return int(text)
        if isinstance(default, float):
            return number(text) if "/" in text else float(text)
        if isinstance(default, tuple):
            found = names(text)
            return tuple(int(x) for x in found) if default and isinstance(default[0], int) else found
        return text

    return kind(**{k: typed(k, v) for k, v in given.items() if k in fields})
