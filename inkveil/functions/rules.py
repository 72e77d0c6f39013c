"""The rules that find candidates, as data. Digits and letters are ASCII's."""

from __future__ import annotations

from dataclasses import dataclass

# The eight rules, their expressions, and their priorities.
AREAS = "11|12|13|14|15|16|17|18|19|20|21|22|23|24|25|26"
PATTERNS = {
    "card": r"(?:[0-9][ -]?){15,16}",
    "email": r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "rrn": r"(?<![0-9])[0-9]{6}[-\s]?[0-490][0-9]{6}(?![0-9])",
    "fgn": r"(?<![0-9])[0-9]{6}[-\s]?[5-8][0-9]{6}(?![0-9])",
    "phone_mobile": r"01[016789]-?[0-9]{3,4}-?[0-9]{4}",
    "phone_city": r"(?:02|0(?:3[1-3]|4[1-4]|5[1-5]|6[1-4]))-?[0-9]{3,4}-?[0-9]{4}",
    "driver_license": rf"(?<![0-9])(?:{AREAS})-?[0-9]{{2}}-?[0-9]{{6}}-?[0-9]{{2}}(?![0-9])",
    "passport": r"(?:[MSRODG][0-9]{8}|[MSRODG][0-9]{3}[A-Z][0-9]{4})",
}
PRIORITIES = {"card": 100, "email": 90, "rrn": 80, "fgn": 80, "phone_mobile": 60, "phone_city": 60, "driver_license": 40, "passport": 30}
#: Cheap tests that every text with a match passes; a text that fails one isn't searched by its rule.
_FOUR = r"(?:[0-9][ -]?){4}"
GUARDS = {name: "@" if name == "email" else _FOUR for name in PATTERNS}


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    priority: int
    case_sensitive: bool = False
    whole_word: bool = False

    @property
    def java(self) -> str:
        """The expression as Spark runs it."""
        body = rf"\b(?:{self.pattern})\b" if self.whole_word else self.pattern
        return body if self.case_sensitive else f"(?i){body}"


#: In the order of their priority, ties in the order they are written.
RULES = {name: Rule(name, pattern, PRIORITIES[name]) for name, pattern in PATTERNS.items()}


def select(names: list[str] | None = None) -> list[Rule]:
    """The rules of these names, whatever their case, in the order of priority; None: all."""
    wanted = None if names is None else {n.lower() for n in names}
    return sorted((r for r in RULES.values() if wanted is None or r.name in wanted), key=lambda r: -r.priority)
