"""Columns over container codes, ISO 6346 size-types and plates.

Each function takes Columns (or names) and returns a Column of built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of ISO 6346: a letter's or digit's value is its place here less one (multiples of 11 skipped).
VALUES = "0123456789A_BCDEFGHIJK_LMNOPQRSTU_VWXYZ"
#: First, second, third and fourth characters of size-types (ISO 6346:1995).
LENGTH_FEET = {"1": "10", "2": "20", "3": "30", "4": "40", "B": "24", "C": "24'6\"", "G": "41", "H": "43", "L": "45", "M": "48", "N": "49"}
SECOND_SIZE = {"0": "8'", "2": "8'6\"", "4": "9'", "5": "9'6\"", "6": "> 9'6\"", "8": "4'3\"", "9": "<= 4'", "C": "8'6\"", "D": "9'", "E": "9'6\"", "F": "> 9'6\""}
TYPE_GROUPS = {"G": "general", "V": "ventilated", "R": "reefer", "H": "thermal", "U": "open top", "P": "platform", "S": "named cargo", "T": "tank", "K": "tank", "B": "bulk"}
FIRST, SECOND, THIRD, FOURTH = "[1234BCGHLMN]", "[0245689CDEF]", "[GVRHUPSTKB]", "[0-9XB]"
#: Alphabets of the live size-type check, and of size-types of 1984.
LIVE = ("[245L]", "[25CF]", "[GRUPTVK1]", "[0-9XB]")
PART = ("[24L]", "[25CF]", "[GRUPTVK1]", "[0-9XB]")
OLD = ("[249]", "[2503]", "[0357681]", "[034215]")


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _at(code: Column, i: int) -> Column:
    return F.substring(code, i, 1)


def weighted_sum(code: Column | str, n: int = 10) -> Column:
    """Sum of character values times powers of two over the first n characters."""
    c = _c(code)
    out = None
    for i in range(1, n + 1):
        term = (F.position(_at(c, i), F.lit(VALUES)) - 1) * (1 << (i - 1))
        out = term if out is None else out + term
    return out


def check_digit(code: Column | str, legacy: bool = False) -> Column:
    """Check digit of four letters and six digits; '0' for anything else.

    ``legacy`` sums nine characters only, as one of the variants in use does.
    """
    c = _c(code)
    return F.when(c.rlike("^[A-Z]{4}[0-9]{6}"), (weighted_sum(c, 9 if legacy else 10) % 11 % 10).cast("string")).otherwise(F.lit("0"))


def is_valid_code(code: Column | str) -> Column:
    c = _c(code)
    return F.coalesce(c.rlike("^[A-Z]{4}[0-9]{7}$") & (check_digit(c) == F.substring(c, 11, 1)), F.lit(False))


def complete_code(code: Column | str, legacy: bool = False) -> Column:
    """Codes of 10 or 11 characters with their check digit set; others as they are."""
    c = _c(code)
    return F.when(F.length(c).isin(10, 11) & c.rlike("^[A-Z]{4}[0-9]{6}"), F.concat(F.substring(c, 1, 10), check_digit(c, legacy))).otherwise(c)


def is_live_size_type(code: Column | str) -> Column:
    return F.coalesce(_c(code).rlike("^" + "".join(LIVE) + "$"), F.lit(False))


def is_old_size_type(code: Column | str) -> Column:
    """A 1984 code of four digits, or two letters and such a code."""
    return F.coalesce(_c(code).rlike("^([A-Za-z]{2})?" + "".join(OLD) + "$"), F.lit(False))


def _runs(parts: tuple[str, ...], n: int) -> str:
    return "|".join("".join(parts[i : i + n]) for i in range(len(parts) - n + 1))


def is_partial_size_type(code: Column | str) -> Column:
    """One to three characters that fit neighbouring places of a size-type."""
    return F.coalesce(_c(code).rlike("^(" + "|".join(_runs(PART, n) for n in (3, 2, 1)) + ")$"), F.lit(False))


def size_type_class(code: Column | str) -> Column:
    """'good' for four fitting characters, 'candidate' for shorter or longer ones that hold a part, else 'none'."""
    c, parts = _c(code), (FIRST, SECOND, THIRD, FOURTH)
    whole = "".join(parts)
    part = f"{_runs(parts, 3)}|{_runs(parts, 2)}"
    longer = f"({whole}|{_runs(parts, 3)}).{{1,4}}"
    return (
        F.when(c.rlike(f"^{whole}$") | (c.rlike("^[A-Za-z]{2}" + "".join(OLD) + "$")), "good")
        .when(c.rlike(f"^({part})$") | (F.length(c).between(5, 7) & c.rlike(f"^{longer}$")), "candidate")
        .otherwise("none")
    )


def decoded(code: Column | str, part: str) -> Column:
    """Length in feet, second size or type group of a size-type, null where unknown."""
    i, known = {"length": (1, LENGTH_FEET), "height": (2, SECOND_SIZE), "group": (3, TYPE_GROUPS)}[part]
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.try_element_at(table, _at(_c(code), i))


def split_head(code: Column | str) -> Column:
    """Everything up to the last letter."""
    return F.regexp_extract(_c(code), "^(.*?)([^A-Za-z]*)$", 1)


def split_number(code: Column | str) -> Column:
    """What follows the last letter."""
    return F.regexp_extract(_c(code), "^(.*?)([^A-Za-z]*)$", 2)


def code_flags(code: Column | str) -> dict[str, Column]:
    """Structural predicates by name."""
    c = _c(code)
    rules = {
        "is_part": r"^([A-Za-z]{3}U[0-9]*|[A-Za-z]{2}U[0-9]+|[A-Za-z]U[0-9]+|U[0-9]+)$",
        "good_head": r"^[A-Za-z]{3}[Uu][0-9]*$",
        "good_body": r"^[0-9]{2,7}$",
        "end_digit": r"^[0-9]$",
        "owner_code": r"^[A-Za-z]{3}U$",
        "six_digits": r"^[0-9]{6}",
    }
    out = {k: F.coalesce(c.rlike(v), F.lit(False)) for k, v in rules.items()}
    out["is_part"] = out["is_part"] & (F.length(c) >= 4)
    out["candidate"] = F.length(c).isin(9, 10) & out["good_head"]
    return out


def token_class(code: Column | str, size_types: list[str]) -> Column:
    """The exclusive class of a reading, tried in this order."""
    c = _c(code)
    return (
        F.when(c.isNull() | (c == ""), "blank")
        .when((F.length(c) == 11) & (_at(c, 4) == "U"), "code_11")
        .when(c.isin(size_types), "size_type")
        .when(c.rlike("^[A-Za-z]{2}" + "".join(OLD) + "$"), "size_type_84")
        .when(c.rlike("^[0-9]{7}$"), "digits_7")
        .when(c.rlike("^([0-9]|[0-9]{3})$"), "digits_1_3")
        .when(c.rlike("^[0-9]{1,6}$"), "digits_less_7")
        .when(c.rlike("^[0-9]{8,}$"), "digits_over_7")
        .when(c.rlike("^[A-Za-z]{3}U$"), "head_4")
        .when(c.rlike("^[A-Za-z]{0,2}U$"), "head_less_4")
        .when(c.rlike("^[A-Za-z]{4,}U$"), "head_over_4")
        .when(c.rlike("^[A-Za-z]+$"), "letters")
        .when((F.length(c) > 11) & c.contains("U"), "over_11")
        .when(c.rlike("^[A-Za-z]{4}[0-9]{6}$"), "code_10")
        .otherwise("rest")
    )


def size_type_inside(code: Column | str, size_types: list[str]) -> Column:
    """The first four-character stretch of a reading that is a size-type, else null."""
    c = _c(code)
    stretches = F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 3, F.lit(1))), lambda i: F.substring(c, i, F.lit(4)))
    return F.get(F.filter(stretches, lambda s: s.isin(size_types)), F.lit(0))


def normalize_reading(code: Column | str) -> Column:
    """Confused characters by place: letters in the first four, digits in the rest; up to four characters stay."""
    c = _c(code)
    rest = lambda x: F.translate(x, "BODA", "8004")
    head = F.translate(F.substring(c, 1, 4), "1408", "IAOB")
    return F.when(F.length(c) > 8, F.concat(head, rest(F.substring(c, F.lit(5), F.length(c))))).when(F.length(c) > 4, rest(c)).otherwise(c)


def normalize_plate(text: Column | str) -> Column:
    return F.translate(_c(text), "OI", "01")


def code_distance(a: Column | str, b: Column | str) -> Column:
    """Edit distance of heads plus edit distance of numbers."""
    return F.levenshtein(split_head(a), split_head(b)) + F.levenshtein(split_number(a), split_number(b))


def code_matches(a: Column | str, b: Column | str) -> Column:
    """Two digits may differ under equal heads, one otherwise."""
    allowed = F.when(split_head(a) == split_head(b), 2).otherwise(1)
    return (_c(a) == _c(b)) | (F.levenshtein(split_number(a), split_number(b)) <= allowed)


def size_type_matches(a: Column | str, b: Column | str) -> Column:
    return F.levenshtein(_c(a), _c(b)) <= 1


#: Full-width forms lie 65248 above their half-width ones.
_WIDE = "".join(chr(c + 65248) for c in range(33, 127)) + "　"
_NARROW = "".join(chr(c) for c in range(33, 127)) + " "


def to_half_width(text: Column | str) -> Column:
    return F.translate(_c(text), _WIDE, _NARROW)


#: What goes: whole stretches at once. Characters are listed, as a search looks those up faster than ranges.
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
VOCABULARIES = {"digit": f"[^{_DIGITS}]+", "lower": f"[^{_DIGITS}{_LOWER}]+", "upper": f"[^{_DIGITS}{_UPPER}]+", "all": f"[^{_DIGITS}{_LOWER}{_UPPER}]+"}


def filter_vocabulary(text: Column | str, kind: str) -> Column:
    """Only the characters of a vocabulary; 'lower' lowers first."""
    c = _c(text)
    return F.regexp_replace(F.lower(c) if kind == "lower" else c, VOCABULARIES[kind], "")


#: All characters that are or begin with an ASCII letter or digit when lowered; the last two are the Kelvin sign and the dotted I.
_LOWERED = _DIGITS + _LOWER + _UPPER + "\u212a\u0130"


def vocabulary_length(text: Column | str, kind: str) -> Column:
    """How many characters ``filter_vocabulary`` leaves; for 'lower' without lowering the text."""
    c = _c(text)
    return F.length(c) - F.length(F.translate(c, _LOWERED, "")) if kind == "lower" else F.length(filter_vocabulary(c, kind))


#: Fixed value: the characters that a file name gives up.
SPECIAL = r"[|@#!¡·$€%&()=?¿^*;:,¨´><+]"


def clean_name(text: Column | str) -> Column:
    """Special characters as underscores."""
    return F.regexp_replace(_c(text), SPECIAL, "_")


def has_cjk(text: Column | str) -> Column:
    return F.coalesce(_c(text).rlike("[\\u4e00-\\u9fff]"), F.lit(False))


def text_width(text: Column | str) -> Column:
    """Length less half, rounded up, of the ASCII letters, digits and spaces."""
    c = _c(text)
    narrow = F.length(c) - F.length(F.translate(c, _DIGITS + _LOWER + _UPPER + " ", ""))
    return F.length(c) - F.ceil(narrow / 2)
