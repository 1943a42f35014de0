"""Rules and their settings: which are on, how severe, and their parameters."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

HERE = Path(__file__).resolve().parent / "lexicons"

#: Severities, their labels and weights.
SEVERITY_LABELS = {"high": "严重", "medium": "一般", "low": "轻微"}
SEVERITY_WEIGHTS = {"high": 3, "medium": 2, "low": 1}
#: Parameters of rules.
PARAMS = {
    "multi_space": {"min_count": 2},
    "empty_paragraph": {"max_continuous": 1},
    "manual_line_break": {"max_breaks": 3},
    "table_no_header_repeat": {"min_rows": 12},
    "formula_error": {"error_values": ["#N/A", "#VALUE!", "#DIV/0!", "#REF!", "#NAME?", "#NULL!", "#NUM!", "#SPILL!", "#CALC!", "#GETTING_DATA"]},
    "format_chaos": {"min_samples": 3},
    "sheet_name_invalid": {"illegal_chars": [":", "\\", "/", "?", "*", "[", "]"], "flag_default_name": True},
    "tn_ambiguous": {"max_sentence_len": 80},
}


@dataclass(frozen=True)
class Rule:
    section: str
    key: str
    severity: str
    title: str
    suggestion: str


def _load() -> dict[str, Rule]:
    rows = [line.split("|", 4) for line in (HERE / "rules.txt").read_text(encoding="utf-8").splitlines() if not line.startswith("#")]
    return {r[1]: Rule(*r) for r in rows}


RULES = _load()


@dataclass
class Config:
    """Settings of one run. A rule that is not named is on; an unknown severity counts as low."""

    disabled: set[str] = field(default_factory=set)
    severities: dict[str, str] = field(default_factory=dict)
    params: dict[str, dict] = field(default_factory=dict)
    max_issues_per_file: int = 800
    max_file_size_mb: int = 100
    sensitivity: str = "normal"
    enable_pdf: bool = True
    enable_legacy: bool = False

    def on(self, key: str) -> bool:
        return key not in self.disabled

    def severity(self, key: str) -> str:
        found = self.severities.get(key, RULES[key].severity if key in RULES else "low")
        return found if found in SEVERITY_LABELS else "low"

    def param(self, key: str, name: str):
        return self.params.get(key, {}).get(name, PARAMS[key][name])

    def enabled_counts(self) -> dict[str, tuple[int, int]]:
        """section -> (rules that are on, rules)."""
        sections: dict[str, tuple[int, int]] = {}
        for rule in RULES.values():
            on, n = sections.get(rule.section, (0, 0))
            sections[rule.section] = (on + self.on(rule.key), n + 1)
        return sections


#: Rules that the shipped settings switch off; ``Config()`` has all on.
SHIPPED_DISABLED = {"full_width_space", "trailing_space"}
