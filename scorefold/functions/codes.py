"""Diagnosis-code expressions: shortening, cleaning, families."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The shape of one valid full code, without dots.
FULL_CODE = r"^[A-Z]\d{2}[A-Z0-9]{0,4}$"

# Three-character categories counted as chronic conditions.
CHRONIC = """
    B18 B20 B21 B22 B23 B24
    C00 C01 C02 C03 C04 C05 C06 C07 C08 C09 C10 C11 C12 C13 C14 C15 C16 C17 C18 C19
    C20 C21 C22 C23 C24 C25 C26 C27 C28 C29 C30 C31 C32 C33 C34 C35 C36 C37 C38 C39
    C40 C41 C42 C43 C44 C45 C46 C47 C48 C49 C50 C51 C52 C53 C54 C55 C56 C57 C58 C59
    C60 C61 C62 C63 C64 C65 C66 C67 C68 C69 C70 C71 C72 C73 C74 C75 C76 C77 C78 C79
    C80 C81 C82 C83 C84 C85 C86 C87 C88 C89 C90 C91 C92 C93 C94 C95 C96
    D50 D51 D52 D53 D63 D64 D65 D66 D67 D68 D69
    E00 E01 E02 E03 E10 E11 E13 E14 E66 E89
    F10 F11 F12 F13 F14 F15 F16 F17 F18 F19 F20 F22 F23 F24 F25 F28 F29 F31 F32 F33
    F34
    G20 G35 G40 G41 G81 G82 G83
    I05 I06 I07 I08 I09 I10 I11 I12 I13 I15 I25 I26 I27 I28 I34 I35 I36 I37 I38 I39
    I42 I43 I44 I45 I47 I48 I49 I50 I70 I71 I73 I85
    J40 J41 J42 J43 J44 J45 J46 J47 J60 J61 J62 J63 J64 J65 J66 J67
    K25 K26 K27 K28 K70 K71 K72 K73 K74 K76
    L94
    M05 M06 M08 M30 M31 M32 M33 M34 M35 M36
    N18 N19 N25
""".split()


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def short_code(code: Column | str, version: Column | int = 10) -> Column:
    """First three characters; four for version-9 codes that start with E."""
    code = _col(code)
    version = F.lit(version) if isinstance(version, int) else version
    is_external_cause = (version == 9) & F.lower(F.substring(code, 1, 1)).eqNullSafe("e")
    return F.when(is_external_cause, F.substring(code, 1, 4)).otherwise(F.substring(code, 1, 3))


def short_codes(codes: Column | str, version: Column | int = 10) -> Column:
    """Distinct short codes in order of first appearance."""
    return F.array_distinct(F.transform(_col(codes), lambda c: short_code(c, version)))


def distinct_codes(codes: Column | str) -> Column:
    """Distinct non-empty codes in order, never truncated."""
    return F.array_distinct(F.filter(_col(codes), lambda c: c.isNotNull() & (c != "")))


def ranked_categories(codes: Column | str) -> Column:
    """Dots removed, cut to three characters, distinct, in order."""
    cut = F.transform(_col(codes), lambda c: F.substring(F.replace(c, F.lit("."), F.lit("")), 1, 3))
    return F.array_distinct(F.filter(cut, lambda c: c.isNotNull() & (c != "")))


def trimmed_categories(codes: Column | str) -> Column:
    """Three-character categories of non-blank codes, duplicates kept."""
    cut = F.transform(_col(codes), lambda c: F.substring(F.trim(c), 1, 3))
    return F.filter(cut, lambda c: c.isNotNull() & (c != ""))


def normalized_codes(raw: Column) -> Column:
    """The valid full codes inside one raw entry such as ``K86.0, K86.1``."""
    parts = F.split(F.upper(raw), "[,/]")
    cleaned = F.transform(parts, lambda p: F.regexp_replace(p, r"[_.\s]", ""))
    return F.filter(cleaned, lambda c: c.rlike(FULL_CODE))


def _entries(raw: Column | str) -> Column:
    return F.filter(_col(raw), lambda r: r.isNotNull() & (F.trim(r) != ""))


def full_codes(raw: Column | str) -> Column:
    """Distinct valid full codes of a list of raw entries, in order."""
    return F.array_distinct(F.flatten(F.transform(_entries(raw), normalized_codes)))


def raw_entry_count(raw: Column | str) -> Column:
    return F.coalesce(F.size(_entries(raw)), F.lit(0))


def invalid_entry_count(raw: Column | str) -> Column:
    """Entries that hold no valid code at all."""
    bad = F.filter(_entries(raw), lambda r: F.size(normalized_codes(r)) == 0)
    return F.coalesce(F.size(bad), F.lit(0))


def gold_full_codes(codes: Column | str) -> Column:
    """Distinct upper-case gold codes, blanks dropped."""
    up = F.transform(_col(codes), lambda c: F.upper(F.trim(c)))
    return F.array_distinct(F.filter(up, lambda c: c.isNotNull() & (c != "")))


def is_history(code: Column) -> Column:
    return F.substring(code, 1, 2).isin("Z8", "Z9")


def is_medication(code: Column) -> Column:
    return code == "Z79"


def is_chronic(code: Column) -> Column:
    return code.isin(CHRONIC)


def is_symptom(code: Column) -> Column:
    return code.rlike(r"^R\d\d$")


FAMILIES = {"history": is_history, "medication": is_medication, "chronic": is_chronic}
