"""Identity numbers: extraction from free text, glyph repair and validation."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as K
from .scalars import literal_map


def _dihedral() -> list[int]:
    """Multiplication in the ten-element dihedral group, row-major."""
    out = []
    for a in range(10):
        for b in range(10):
            turn = (a % 5 - b % 5) if a >= 5 else (a % 5 + b % 5)
            out.append(turn % 5 + 5 * ((a >= 5) != (b >= 5)))
    return out


def _permutations() -> list[int]:
    """Eight successive powers of the base permutation, row-major."""
    row, out = list(range(10)), []
    for _ in range(8):
        out += row
        row = [row[K.VERHOEFF_BASE_PERMUTATION[i]] for i in range(10)]
    return out


DIHEDRAL = _dihedral()
PERMUTED = _permutations()


def to_digits(c: Column) -> Column:
    return F.translate(c, K.LETTERS_FOR_DIGITS, K.DIGITS_FOR_LETTERS)


def to_letters(c: Column) -> Column:
    return F.translate(c, K.DIGITS_READ, K.LETTERS_MEANT)


def normalise_pan(token: Column) -> Column:
    fixed = F.concat(
        to_letters(F.substring(token, 1, 5)), to_digits(F.substring(token, 6, 4)), to_letters(F.substring(token, 10, 1))
    )
    return F.when(F.length(token) == 10, fixed).otherwise(token)


def _let(value: Column, body) -> Column:
    """body(value) with `value` evaluated once per row."""
    return F.get(F.transform(F.array(value), body), 0)


def _found(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _whole(shape: str, ascii_words: bool) -> str:
    """`shape` as a whole word; with ASCII words any other character is a boundary, and spaces are ASCII too."""
    if not ascii_words:
        return rf"(?U)\b({shape})\b"
    return rf"(?<![0-9A-Za-z_])({shape})(?![0-9A-Za-z_])".replace(r"\s", r"[\t\n\f\r ]")


def _pan_in_upper(up: Column, ascii_words: bool) -> Column:
    direct = _found(F.regexp_extract(up, _whole(K.PAN_SHAPE, ascii_words), 1))
    # only runs that can hold the shape under some glyph confusion are cut into windows
    letter, digit = f"[A-Z{K.DIGITS_READ}]", f"[0-9{K.LETTERS_FOR_DIGITS}]"
    runs = F.filter(
        F.regexp_extract_all(up, F.lit("[A-Z0-9]+"), 0), lambda t: F.length(t).between(10, 14) & t.rlike(f"{letter}{{5}}{digit}{{4}}{letter}")
    )
    windows = F.flatten(
        F.transform(runs, lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 9), lambda i: normalise_pan(F.substring(t, i, F.lit(10)))))
    )
    repaired = F.get(F.filter(windows, lambda w: w.rlike(f"^{K.PAN_SHAPE}$")), 0)
    return F.coalesce(direct, repaired)


def find_pan(text: Column, ascii_words: bool = False) -> Column:
    """First well-formed number, else the first one that glyph repair can produce."""
    return _let(F.upper(text), lambda up: _pan_in_upper(up, ascii_words))


def find_aadhaar(text: Column, ascii_words: bool = False) -> Column:
    up = F.upper(text)
    direct = _found(F.regexp_replace(F.regexp_extract(up, _whole(K.AADHAAR_SHAPE, ascii_words), 1), r"(?U)\s", ""))
    groups = F.regexp_extract_all(up, F.lit(_whole(r"[A-Z0-9]{4}\s[A-Z0-9]{4}\s[A-Z0-9]{4}", ascii_words)), 1)
    joined = F.transform(groups, lambda g: to_digits(F.regexp_replace(g, r"(?U)\s", "")))
    repaired = F.get(F.filter(joined, lambda g: g.rlike("^[2-9][0-9]{11}$")), 0)
    return F.coalesce(direct, repaired)


def find_dob(text: Column, ascii_words: bool = False) -> Column:
    return _found(F.regexp_extract(F.upper(text), _whole(K.DOB_SHAPE, ascii_words), 1))


def find_fields(text: Column, ascii_words: bool = False) -> Column:
    """pan, aadhaar (only without a pan) and dob of one text; `ascii_words` takes any non-ASCII letter for a boundary."""
    pan = find_pan(text, ascii_words)
    return F.struct(pan.alias("pan"), F.when(pan.isNull(), find_aadhaar(text, ascii_words)).alias("aadhaar"), find_dob(text, ascii_words).alias("dob"))


def verhoeff_checksum(digits: Column) -> Column:
    """0 for a valid number. `digits` must hold digits only."""
    d, p = F.array(*[F.lit(x) for x in DIHEDRAL]), F.array(*[F.lit(x) for x in PERMUTED])
    reversed_digits = F.filter(F.split(F.reverse(digits), ""), lambda x: x != "")
    permuted = F.transform(reversed_digits, lambda x, i: F.get(p, (i % 8) * 10 + x.cast("int")))
    return F.aggregate(permuted, F.lit(0), lambda c, x: F.get(d, c * 10 + x))


def verhoeff_ok(number: Column) -> Column:
    digits = F.regexp_replace(number, "[^0-9]", "")
    return F.when(digits.rlike("^[2-9][0-9]{11}$"), verhoeff_checksum(digits) == 0).otherwise(F.lit(False))


def verhoeff_append(body: Column) -> Column:
    c = verhoeff_checksum(F.concat(body, F.lit("0")))
    return F.concat(body, F.when(c < 5, (F.lit(5) - c) % 5).otherwise(c).cast("string"))


def validate_pan(pan: Column, name: Column) -> Column:
    """Struct of checks plus the list of issues found."""
    shaped = F.coalesce(pan.rlike(f"^{K.PAN_SHAPE}$"), F.lit(False))
    fourth, fifth = F.substring(pan, 4, 1), F.substring(pan, 5, 1)
    holder_ok = shaped & fourth.isin(list(K.PAN_HOLDERS))
    words = F.split(F.trim(F.regexp_replace(name, r"(?U)\s+", " ")), " ")
    initial = F.upper(F.substring(F.element_at(words, -1), 1, 1))
    initial_ok = F.when(shaped & (initial != ""), fifth == initial)
    issues = F.array_compact(
        F.array(
            F.when(~shaped, F.lit("PAN does not have the AAAAA9999A shape")),
            F.when(shaped & ~holder_ok, F.concat(F.lit("PAN holder code '"), fourth, F.lit("' does not exist"))),
            F.when(initial_ok == False, F.concat(F.lit("PAN initial '"), fifth, F.lit("' should be '"), initial, F.lit("'"))),  # noqa: E712
        )
    )
    return F.struct(
        pan.alias("value"),
        shaped.alias("format_ok"),
        holder_ok.alias("holder_type_ok"),
        F.when(holder_ok, F.try_element_at(literal_map(K.PAN_HOLDERS), fourth)).alias("holder_type"),
        initial_ok.alias("surname_initial_ok"),
        issues.alias("issues"),
    )


def id_field_score(pan: Column, pan_check: Column, aadhaar: Column, text: Column, ocr_present: Column) -> Column:
    bad_holder = ~pan_check["holder_type_ok"]
    return (
        F.when(pan.isNotNull() & (F.size(pan_check["issues"]) > 0), F.when(bad_holder, 0.85).otherwise(0.6))
        .when(pan.isNotNull(), 0.0)
        .when(aadhaar.isNotNull(), F.when(verhoeff_ok(aadhaar), 0.0).otherwise(0.9))
        .when(ocr_present & (F.length(text) < 12), 0.45)
        .otherwise(0.0)
    )
