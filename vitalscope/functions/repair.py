"""Value repair, notes, guards and grade bands as expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..lexicon import NO_TEXT_WARNING
from ..schemas import LEVEL_LABELS, VITAL_RANGES
from .text import strip

# Ceilings, cut-offs and grade bands.
CONFIDENCE_WITHOUT_TEXT = 0.50
LOW_CONFIDENCE = 0.40
SAFETY_BANDS = [(5, "A+"), (10, "A"), (15, "B"), (20, "C")]
SAFETY_WORST = "F"
EFFICIENCY_BANDS = [(15, "A"), (25, "B"), (35, "C")]
EFFICIENCY_WORST = "D"
PASS_RATE_BANDS = [(80, "ok"), (50, "weak")]
MATCH_BANDS = [(0.7, "confident"), (0.5, "usable")]


def parsed_number(raw: Column) -> Column:
    """The number in a text cell; null when blank, unreadable or NaN."""
    text = strip(raw.cast("string"))
    # Java also reads "1.0d" and "2f" as numbers; those count as unreadable.
    plain = text.rlike(r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)$")
    return F.when(plain, text.try_cast("double"))


def is_blank(raw: Column) -> Column:
    text = F.lower(strip(raw.cast("string")))
    return raw.isNull() | text.isin("", "nan")


def finite_number(raw: Column) -> Column:
    """The number in a cell, null where there is none or it is infinite; what a fit may read."""
    number = parsed_number(raw)
    return F.when(F.abs(number) < float("inf"), number)


def safe_number(raw: Column, default: float | Column) -> Column:
    default = default if isinstance(default, Column) else F.lit(float(default))
    return F.coalesce(parsed_number(raw), default)


def number_note(name: str, raw: Column) -> Column:
    """What was replaced and why; null when the value could be used."""
    reason = F.when(is_blank(raw), F.lit("missing")).otherwise(
        F.concat(F.lit("unreadable ('"), raw.cast("string"), F.lit("')"))
    )
    return F.when(
        parsed_number(raw).isNull(), F.concat(F.lit(f"{name} "), reason, F.lit("->mean"))
    )


def _category_text(raw: Column, classes: list[str], missing: str) -> Column:
    """The stripped text; a null is the class ``missing`` where that was trained."""
    text = strip(raw.cast("string"))
    return F.coalesce(text, F.lit(missing)) if missing in classes else text


def safe_category(raw: Column, classes: list[str], missing: str = "nan") -> Column:
    """Exact class, else the class equal but for case, else the first class.

    A null belongs to the class ``missing`` if training saw one.
    """
    text = _category_text(raw, classes, missing)
    by_lower = {c.lower(): c for c in classes}
    exact = F.when(text.isin(list(classes)), text)
    folded = F.create_map(*[F.lit(x) for pair in by_lower.items() for x in pair])
    return F.coalesce(exact, F.element_at(folded, F.lower(text)), F.lit(classes[0]))


def category_note(name: str, raw: Column, classes: list[str], missing: str = "nan") -> Column:
    text = _category_text(raw, classes, missing)
    known = F.coalesce(F.lower(text).isin([c.lower() for c in classes]), F.lit(False))
    shown = F.coalesce(text, F.lit("missing"))
    return F.when(
        ~known,
        F.concat(
            F.lit(f"{name}='"), shown, F.lit("' not seen in training -> defaulted to '"),
            F.lit(classes[0]), F.lit("'"),
        ),
    )


def range_flags(columns: dict[str, Column], ranges: dict[str, tuple] = VITAL_RANGES) -> Column:
    """Names of the measurements outside their accepted range."""
    flags = [
        F.when(~columns[name].between(low, high), F.lit(name))
        for name, (low, high) in ranges.items()
        if name in columns
    ]
    return F.array_compact(F.array(*flags))


def capped_confidence(confidence: Column, no_text: Column) -> Column:
    return F.when(no_text, F.least(confidence, F.lit(CONFIDENCE_WITHOUT_TEXT))).otherwise(
        confidence
    )


def percent_text(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100)


def confidence_text(confidence: Column, no_text: Column) -> Column:
    shown = percent_text(capped_confidence(confidence, no_text))
    return F.when(no_text, F.concat(shown, F.lit("  (capped - no complaint text)"))).otherwise(shown)


def no_text_note(no_text: Column) -> Column:
    return F.when(no_text, F.lit(NO_TEXT_WARNING))


def level_label(level: Column) -> Column:
    pairs = [F.lit(x) for k, v in LEVEL_LABELS.items() for x in (k, v.split("(")[0].strip())]
    return F.element_at(F.create_map(*pairs), level.cast("int"))


def _below(value: Column, bands, worst: str) -> Column:
    ladder = F.when(value < bands[0][0], bands[0][1])
    for limit, name in bands[1:]:
        ladder = ladder.when(value < limit, name)
    return ladder.otherwise(worst)


def _at_least(value: Column, bands, worst: str) -> Column:
    ladder = F.when(value >= bands[0][0], bands[0][1])
    for limit, name in bands[1:]:
        ladder = ladder.when(value >= limit, name)
    return ladder.otherwise(worst)


def safety_grade(under_pct: Column) -> Column:
    return _below(under_pct, SAFETY_BANDS, SAFETY_WORST)


def efficiency_grade(over_pct: Column) -> Column:
    return _below(over_pct, EFFICIENCY_BANDS, EFFICIENCY_WORST)


def pass_rate_band(pct: Column) -> Column:
    return _at_least(pct, PASS_RATE_BANDS, "POOR")


def match_verdict(similarity: Column) -> Column:
    return _at_least(similarity, MATCH_BANDS, "weak")
