"""Language packs: data that the classifier takes as an argument, one JSON file a language."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

PACKS = Path(__file__).parent / "packs"


@dataclass(frozen=True)
class Exclusive:
    """Letters that only this language uses within its script."""

    script: str
    letters: str
    min_hits: int = 3
    min_share: float = 0.0


@dataclass(frozen=True)
class CyrillicSign:
    """mode digraph: `letter` after one of `leaders`; mode vowel_share: its share of the Cyrillic letters."""

    mode: str
    letter: str
    leaders: str = ""
    min_hits: int = 3
    min_share: float = 0.0
    blocked_by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Pack:
    name: str
    codes: tuple[str, ...] = ()
    labels: tuple[str, ...] = ()
    scripts: tuple[str, ...] = ()
    script_sufficient: bool = False
    words: tuple[str, ...] = ()
    exclusive: Exclusive | None = None
    suppresses: tuple[str, ...] = ()
    sign: CyrillicSign | None = None
    order: int = field(default=0, compare=False)


def _tidy(values) -> tuple[str, ...]:
    return tuple(dict.fromkeys(v for v in (str(x).strip().lower() for x in values or ()) if v))


def load_packs(folder: str | Path = PACKS) -> list[Pack]:
    """Packs in the order of their file names, which suppression depends on. Two packs of a name, or none, are errors."""
    out: list[Pack] = []
    for path in sorted(Path(folder).glob("*.json")):
        if path.name.startswith("_"):
            continue
        d = json.loads(path.read_text(encoding="utf-8"))
        x, s = d.get("exclusive_letters"), d.get("cyrillic_sign")
        out.append(
            Pack(
                name=d["name"].strip().lower(), codes=_tidy(d.get("codes")), labels=_tidy(d.get("switch_labels")), scripts=_tidy(d.get("scripts")),
                script_sufficient=bool(d.get("script_sufficient")), words=_tidy(d.get("words")), suppresses=_tidy(d.get("suppresses")),
                exclusive=Exclusive(**x) if x else None, sign=CyrillicSign(**{**s, "blocked_by": tuple(s.get("blocked_by", ()))}) if s else None, order=len(out),
            )
        )
    names = [p.name for p in out]
    if not out or len(set(names)) < len(names):
        raise ValueError(f"{folder}: no language packs, or two of one name")
    return out


def code_map(packs: list[Pack]) -> dict[str, str]:
    return {c: p.name for p in packs for c in p.codes}


def label_map(packs: list[Pack]) -> dict[str, str]:
    return {c: p.name for p in packs for c in p.labels}
