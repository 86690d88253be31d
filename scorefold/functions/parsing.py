"""Reading answers: tolerant lists, JSON inside free text, validation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scorefold.functions.binding import let
from scorefold.schemas import CODE_LIST, DIAGNOSIS_LIST, FINDING_MAP

# Cells that mean "no value", the answer patterns, list sizes
# and the longest stored reason.
NULL_LIKE = ["", "None", "nan", "NaN", "null"]
LIST_PATTERN = r"(?s)(\[\s*\{.*?\}\s*\])"
MAP_PATTERN = r"(?s)(\{\s*[\"'].*?[\"']\s*:\s*\{.*\}\s*\})"
DIAGNOSIS_SIZES = (3, 10)
CODE_SIZES = (3, 30)
MAX_REASON = 1000

_LITERALS = {"None": "null", "True": "true", "False": "false"}


def none_if_blank(cell: Column) -> Column:
    return F.when(~F.trim(cell).isin(NULL_LIKE), cell)


# A quoted string, with escapes.
_QUOTED = r"""(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|'[^'\\]*+(?:\\.[^'\\]*+)*+')"""
_MARK = "\x01"


def json_text(cell: Column) -> Column:
    """A printed Python value as JSON; what stands inside quotes keeps its words.

    Bare None, True and False are replaced, ``\\x..`` and ``\\U0000....`` escapes
    become JSON escapes. Single quotes are left to the JSON reader.
    """

    def replaced(text: Column) -> Column:
        out = text
        for name, value in _LITERALS.items():
            # Quoted strings and the bare word both get a mark; only after the word it does not follow a quote.
            marked = F.regexp_replace(out, rf"({_QUOTED})|\b{name}\b", f"$1{_MARK}")
            changed = F.replace(F.regexp_replace(marked, rf"(?<![\"']){_MARK}", value), F.lit(_MARK), F.lit(""))
            out = F.when(text.contains(name), changed).otherwise(out)
        short = F.regexp_replace(out, r"(?<!\\)((?:\\\\)*)\\(?:x|U000000)([0-9a-fA-F]{2})", r"$1\\u00$2")
        return F.regexp_replace(short, r"(?<!\\)((?:\\\\)*)\\U0000([0-9a-fA-F]{4})", r"$1\\u$2")

    return let(none_if_blank(cell), replaced)


def read_json(cell: Column, schema: str) -> Column:
    """The cell as JSON; only where that fails as a printed Python value. Null where neither works."""
    raw = none_if_blank(cell)
    strict = F.from_json(raw, schema, {"mode": "PERMISSIVE"})
    loose = F.from_json(json_text(cell), schema, {"allowBackslashEscapingAnyCharacter": "true"})
    return F.coalesce(strict, loose)


def parse_list(cell: Column) -> Column:
    """A list of strings; null-like and malformed cells give an empty list."""
    return F.coalesce(read_json(cell, "array<string>"), F.array().cast("array<string>"))


def parse_vector(cell: Column) -> Column:
    """A list of integers, null where the cell is null-like or malformed."""
    return read_json(cell, "array<int>")


def parse_answer(cell: Column, schema: str) -> Column:
    """A stored answer as ``schema``, null where it is not usable."""
    return read_json(cell, schema)


def is_valid_cell(cell: Column) -> Column:
    """Whether a stored answer exists (neither null nor the text None)."""
    return cell.isNotNull() & (cell != "None")


def _unquoted_field(text: Column, fields: tuple[str, ...]) -> Column:
    """A required text field that was given as a number, list or object; values in quotes are not looked into."""
    names = "|".join(fields)
    # Names of fields keep their quotes and get a mark; other quoted strings become a mark.
    marked = F.regexp_replace(text, rf"({_QUOTED}\s*:)|{_QUOTED}", f"$1{_MARK}")
    return marked.rlike(rf"[\"'](?:{names})[\"']\s*:{_MARK}\s*[^{_MARK}\s]")


def last_entry(found: Column, name: Column) -> Column:
    """The value of a key in a parsed map; of a repeated key the last."""
    return F.try_element_at(F.filter(F.map_entries(found), lambda e: e["key"] == name), F.lit(-1))["value"]


def list_is_valid(parsed: Column, fields: tuple[str, str], sizes: tuple[int, int]) -> Column:
    """Every entry has both text fields and the size fits."""
    complete = F.forall(parsed, lambda e: e[fields[0]].isNotNull() & e[fields[1]].isNotNull())
    return F.size(parsed).between(*sizes) & complete


def findings_are_valid(parsed: Column, features: Column, low: int = -1, high: int = 1) -> Column:
    """Every feature is there with a value in range and a reason."""

    def good(entry: Column) -> Column:
        return entry["value"].between(low, high) & entry["reasoning"].isNotNull()

    entries = F.transform(features, lambda name: last_entry(parsed, name))
    return F.forall(entries, lambda e: F.coalesce(good(e), F.lit(False)))


def last_valid(response: Column, pattern: str, schema: str, is_valid, is_strict=None) -> Column:
    """The last match of ``pattern`` that parses and passes both checks, else null.

    ``is_valid`` looks at the parsed value, ``is_strict`` at its text. Every
    match is parsed once.
    """
    found = F.reverse(F.regexp_extract_all(response, F.lit(pattern), F.lit(1)))
    parsed = F.transform(
        found, lambda t: F.struct(t.alias("text"), read_json(t, schema).alias("value"))
    )
    good = F.filter(
        parsed,
        lambda m: m["value"].isNotNull() & F.coalesce(is_valid(m["value"]), F.lit(False))
        & (is_strict(m["text"]) if is_strict else F.lit(True)),
    )
    return F.get(good, F.lit(0))["value"]


def shortened(reason: Column, limit: int = MAX_REASON) -> Column:
    """Cut at the last space before ``limit`` characters and mark the cut."""
    head = F.regexp_replace(F.substring(reason, 1, limit), r"(?s) [^ ]*\z", "")
    return F.when(F.length(reason) > limit, F.concat(head, F.lit("..."))).otherwise(reason)


def truncate_reasons(entries: Column, key: str) -> Column:
    return F.transform(
        entries, lambda e: F.struct(e[key].alias(key), shortened(e["reason"]).alias("reason"))
    )


def extract_diagnoses(response: Column) -> Column:
    """The last valid ranked diagnosis list of a response, else null."""
    picked = last_valid(
        response,
        LIST_PATTERN, DIAGNOSIS_LIST,
        lambda v: list_is_valid(v, ("name", "reason"), DIAGNOSIS_SIZES),
        lambda t: ~_unquoted_field(t, ("name", "reason")),
    )
    return truncate_reasons(picked, "name")


def extract_codes(response: Column) -> Column:
    """The last valid code list of a response, else null."""
    picked = last_valid(
        response,
        LIST_PATTERN, CODE_LIST,
        lambda v: list_is_valid(v, ("icd_code", "reason"), CODE_SIZES),
        lambda t: ~_unquoted_field(t, ("icd_code", "reason")),
    )
    return truncate_reasons(picked, "icd_code")


def extract_findings(response: Column, features: Column) -> Column:
    """The last valid finding map of a response, else null."""
    return last_valid(response, MAP_PATTERN, FINDING_MAP, lambda v: findings_are_valid(v, features))


def finding_vector(findings: Column, features: Column) -> Column:
    """Finding values in scheme order; null without an answer."""

    def values(found: Column) -> Column:
        vector = F.transform(features, lambda name: last_entry(found, name)["value"])
        return F.when(found.isNotNull(), vector)

    return let(findings, values)
