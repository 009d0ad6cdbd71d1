"""Scalar expressions for cleaning, classing and formatting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label words, class limits, class names, rule bounds and display lengths.
POSITIVE_WORDS = ("1", "active", "true", "yes")
NEGATIVE_WORDS = ("0", "inactive", "false", "no")
LOW_LIMIT = 0.3
HIGH_LIMIT = 0.7
DECISION_LIMIT = 0.5
CLASS_LOW, CLASS_MID, CLASS_HIGH = "Non-toxic", "Moderate", "Toxic"
ALL_PASS, ALL_FAIL = "ALL PASS", "ALL FAIL"
TEXT_WIDTH = 50
SHORT_TEXT_WIDTH = 30

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def col_of(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def lenient_double(value: Column | str) -> Column:
    """Text to number; anything else becomes NULL instead of an error.

    The pattern guards against Java-only spellings such as ``1d`` that ``try_cast`` would accept.
    """
    text = col_of(value).cast("string")
    return F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))


def label_flag(value: Column | str) -> Column:
    """Label word to 1, 0 or NULL, whatever its case."""
    word = F.lower(col_of(value).cast("string"))
    return F.when(word.isin(*POSITIVE_WORDS), F.lit(1)).when(word.isin(*NEGATIVE_WORDS), F.lit(0))


def first_present(props: Column | str, names: Sequence[str]) -> Column:
    """Value of the first of ``names`` that is in the map, so a present empty text wins over a later name."""
    bag = col_of(props)
    out = F.lit(None).cast("string")
    for name in reversed(names):
        out = F.when(F.map_contains_key(bag, F.lit(name)), F.try_element_at(bag, F.lit(name))).otherwise(out)
    return out


def finite_or_null(value: Column | str) -> Column:
    """NaN and both infinities become NULL."""
    number = col_of(value).cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == F.lit(float("inf"))), None).otherwise(number)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, NULL when the divisor is 0 or NULL."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(ratio(numerator, denominator), F.lit(0.0))


def guarded_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient by at least 1, so that a zero count gives a plain 0 and not an error."""
    top, bottom = col_of(numerator).cast("double"), col_of(denominator).cast("double")
    return top / F.greatest(F.lit(1.0), bottom)


def class_of(probability: Column | str) -> Column:
    p = col_of(probability)
    return (
        F.when(p.isNull(), None)
        .when(p < LOW_LIMIT, CLASS_LOW)
        .when(p < HIGH_LIMIT, CLASS_MID)
        .otherwise(CLASS_HIGH)
    )


def decision(probability: Column | str, limit: float = DECISION_LIMIT) -> Column:
    """1 when strictly above the limit."""
    return (col_of(probability) > F.lit(limit)).cast("int")


def decision_class(prediction: Column | str) -> Column:
    return F.when(col_of(prediction) == 1, CLASS_HIGH).otherwise(CLASS_LOW)


def confidence(probability: Column | str) -> Column:
    """Distance from the decision limit, scaled to [0, 1]."""
    return F.abs(col_of(probability) - F.lit(0.5)) * 2


def overall_class(n_high: Column, n_mid: Column) -> Column:
    return F.when(n_high > 0, CLASS_HIGH).when(n_mid > 0, CLASS_MID).otherwise(CLASS_LOW)


def pass_status(n_pass: Column, n_fail: Column) -> Column:
    total = (n_pass + n_fail).cast("string")
    return (
        F.when(n_fail == 0, ALL_PASS)
        .when(n_pass == 0, ALL_FAIL)
        .otherwise(F.concat(n_pass.cast("string"), F.lit("/"), total, F.lit(" PASS")))
    )


def shorten(text: Column | str, width: int = TEXT_WIDTH) -> Column:
    value = col_of(text)
    return F.when(F.length(value) > width, F.concat(F.substring(value, 1, width), F.lit("..."))).otherwise(value)


def plain_name(name: Column | str) -> Column:
    return F.regexp_replace(F.lower(col_of(name)), "-", "_")


def mean_spread_text(mean: Column, spread: Column) -> Column:
    return F.format_string("%.3f ± %.3f", mean, spread)


@dataclass(frozen=True)
class Rule:
    """One bound on one property, for example ``Rule("mw", "molecular_weight", "<=", 500)``."""

    name: str
    column: str
    op: str
    bound: float

    def holds(self) -> Column:
        value, bound = F.col(self.column), F.lit(self.bound)
        tests = {
            "<=": value <= bound,
            "<": value < bound,
            ">=": value >= bound,
            ">": value > bound,
            "==": value == bound,
        }
        if self.op not in tests:
            raise ValueError(f"unknown comparison {self.op!r}")
        return F.coalesce(tests[self.op], F.lit(False))


# The four bounds of the rule of five.
RULE_OF_FIVE = (
    Rule("mw", "molecular_weight", "<=", 500),
    Rule("logp", "logp", "<=", 5),
    Rule("hbd", "hbd", "<=", 5),
    Rule("hba", "hba", "<=", 10),
)


def rules_met(rules: Sequence[Rule]) -> Column:
    total = F.lit(0)
    for rule in rules:
        total = total + rule.holds().cast("int")
    return total


def balanced_brackets(text: Column | str) -> Column:
    """Default validity test of a structure text: not empty, known characters, brackets in equal numbers."""
    value = col_of(text)

    def same(opening: str, closing: str) -> Column:
        return F.length(value) - F.length(F.replace(value, F.lit(opening), F.lit(""))) == F.length(value) - F.length(
            F.replace(value, F.lit(closing), F.lit(""))
        )

    return F.coalesce(
        (value != "") & value.rlike(r"^[A-Za-z0-9@+\-\[\]()=#$:/\\.%*]+$") & same("(", ")") & same("[", "]"),
        F.lit(False),
    )


def described(name: Column | str, descriptions: Mapping[str, str]) -> Column:
    """Description of a target by name; an unknown name gives an empty text."""
    out = F.lit("")
    for key, text in descriptions.items():
        out = F.when(col_of(name) == key, F.lit(text)).otherwise(out)
    return out
