"""Report parameters and the fixed code lists the metrics are defined by."""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# These must equal the values the reported metrics were defined
# with, so they are stated here once, in natural order.
# ---------------------------------------------------------------------------
DEFAULT_AGENCY = "TN0830400"
DEFAULT_NIBRS = "23C"
# Offense codes the inclusive cohort adds besides the NIBRS match.
INCLUSIVE_OFFENSE_CODES = ("39-14-103 - 26A", "39-14-104 - 26A")
# Role types that mark a suspect on the person-role table.
SUSPECT_ROLE_TYPES = ("S", "SO", "S/O")
# Relation codes that mark a suspect on the person itself.
SUSPECT_RELATION_CODES = ("S", "O", "SO", "S/O")
# Words searched in role and relation descriptions.
SUSPECT_WORD = "SUSPECT"
OFFENDER_WORD = "OFFENDER"
# Fragments searched in the raw relation code.
RELATION_CODE_FRAGMENTS = ("SUS", "OFF")
# Word in a case-status description that marks the case as open.
OPEN_WORD = "OPEN"
# Property codes: loss type and recovered status.
LOSS_CODE = "7"
RECOVERED_STATUS = "5"
# Separators of the text lists.
CODE_SEP = ", "
DESC_SEP = " | "

DEFAULT_YEAR = 1998


@dataclass(frozen=True)
class Params:
    """Cohort definition: report year, agency, NIBRS code, extra offense codes.

    ``extra_offense_codes`` only matters for the inclusive cohort; an empty
    tuple there makes it the plain NIBRS cohort plus place columns.
    ``report_number`` optionally narrows every cohort to one report.
    """

    report_year: int = DEFAULT_YEAR
    agency: str = DEFAULT_AGENCY
    nibrs: str = DEFAULT_NIBRS
    extra_offense_codes: tuple[str, ...] = field(default=INCLUSIVE_OFFENSE_CODES)
    report_number: str | None = None

    def __post_init__(self) -> None:
        if not self.agency or not self.nibrs:
            # A blank literal would never match (blank is NULL), and would also
            # break the raw-column pushdown the cohort relies on.
            raise ValueError("agency and nibrs must be non-blank")
        if not 1 <= int(self.report_year) <= 9998:
            raise ValueError(f"report_year out of range: {self.report_year}")
