"""Settings of a matching run and the roles of a table's columns."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Thresholds by strictness, text balances (term vectors, fuzzy) and size weights by name.
STRICTNESS = {"Very Lenient": 40, "Lenient": 50, "Balanced": 60, "Strict": 70, "Very Strict": 80}
FOCUS = {"Exact Spelling": (0.1, 0.9), "Mostly Spelling": (0.3, 0.7), "Balanced": (0.5, 0.5), "Mostly Meaning": (0.7, 0.3), "Product Meaning": (0.9, 0.1)}
SIZE_IMPORTANCE = {"Off": 0.0, "Minor": 0.1, "Moderate": 0.2, "Major": 0.3}


@dataclass(frozen=True)
class ColumnConfig:
    """Which columns hold the name, size, barcodes and further output of a table."""

    product: tuple[str, ...] = ()
    size: str | None = None
    size_value: str | None = None
    size_unit: str | None = None
    gtin: tuple[str, ...] = ()
    output: tuple[str, ...] = ()
    #: Columns that a match within the table may be restricted by; MatchSettings.restrictions says which of them hold.
    restrictions: tuple[str, ...] = ()
    row_id: str = "row_id"

    @classmethod
    def detect(cls, df, row_id: str = "row_id") -> ColumnConfig:
        """Roles from column names and values. Of barcode columns the first three are taken, of restrictions all that fit."""
        from ..operators import profile

        names = {c.lower(): c for c in df.columns}
        return cls(
            product=tuple(profile.name_columns(df)),
            size=names.get("size"),
            size_value=names.get("size_value"),
            size_unit=names.get("size_unit"),
            gtin=tuple(profile.gtin_columns(df, row_id if row_id in df.columns else None)[:3]),
            restrictions=tuple(c for c in profile.restriction_columns(df) if c != row_id),
            row_id=row_id,
        )


@dataclass(frozen=True)
class MatchSettings:
    threshold: float = 50.0
    w_tfidf: float = 0.25
    w_fuzzy: float = 0.25
    w_gtin: float = 0.5
    w_size: float = 0.0
    size_tolerance: float = 20.0
    max_matches: int | None = 5
    restrictions: tuple[str, ...] = ()
    remove_stop_words: bool = True
    case_sensitive: bool = False
    include_size_in_text: bool = False
    min_tfidf: float = 0.0
    min_fuzzy: float = 0.0
    #: What ranks the matches of a row: confidence, tfidf_score, fuzzy_score, gtin_score or size_score.
    sort_by: str = "confidence"
    #: What ranks groups: size, avg_similarity or min_similarity.
    sort_groups_by: str = "size"
    #: exact scores every pair that can reach the threshold; candidates scores the fuzzy part of likely pairs only.
    mode: str = "exact"
    gtin13: bool = False
    alt_padding: bool = True
    min_group_size: int = 2
    max_groups: int | None = 50
    conservative: bool = True
    sweep: tuple[int, int] = field(default=(50, 80))

    @classmethod
    def preset(cls, strictness: str = "Lenient", focus: str = "Balanced", size: str = "Off", text: bool = True, gtin: bool = True, **other) -> MatchSettings:
        """Settings by the names of the presets; the text balance is scaled to the text's total weight."""
        whole = 0.0 if not text else (0.5 if gtin else 1.0)
        a, b = FOCUS[focus]
        return cls(threshold=float(STRICTNESS[strictness]), w_tfidf=a * whole, w_fuzzy=b * whole, w_gtin=0.0 if not gtin else (0.5 if text else 1.0), w_size=SIZE_IMPORTANCE[size], **other)
