"""Note and name text: sections, line cleaning, phrase matching, reasoning text."""

from __future__ import annotations

from dataclasses import dataclass, field
import re

from pyspark.sql import Column, functions as F

from scorefold.functions.binding import let

# Section headers of the notes and what ends a section.
COMPLAINT_HEADERS = [r"chief complaint\s*:", r"___ complaint\s*:", r"chief\s+___\s*:"]
COMPLAINT_END = r"(?i)\n(?:\s*\.?\s*\n|[A-Z][A-Za-z ]+:)"
PREVIOUS_HEADERS = [
    "___ Disposition:", "Discharge Disposition:", "Facility:", r"___:\nHome", r"___:\nHome with Service",
]
TARGET_HEADERS = [
    "Discharge Diagnosis:", "___ Diagnosis:", "Discharge ___:", "Current Diagnoses:",
    "___ischarge Diagnosis:", "___:",
]
NEXT_HEADERS = ["Discharge Condition:", "___ Condition:", "CONDITION:"]

# The characters counted as white space at the ends of a text.
WHITE_SPACE = (
    " \t\n\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def any_header(headers: list[str]) -> str:
    """Case-insensitive alternation; the first characters are tested together first."""
    first = "".join(dict.fromkeys(h[0].lower() for h in headers))
    return f"(?i)(?=[{first}])(?:{'|'.join(headers)})"


def strip(text: Column) -> Column:
    """Remove leading and trailing white space of every kind."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def none_if_empty(text: Column) -> Column:
    return let(text, lambda t: F.when(t != "", t))


def section(text: Column, header: str, end: str) -> Column:
    """Text between the first ``header`` and the first ``end`` after it (or the end of the text).

    Null without a header. Splitting reads the text once, where a lazy group
    with look-ahead would test the end at every character.
    """
    rest = F.get(F.split(text, header, 2), F.lit(1))
    return F.get(F.split(rest, end, 2), F.lit(0))


def chief_complaint(note: Column) -> Column:
    """The complaint section, stripped; null where absent or empty."""
    return strip(none_if_empty(section(note, any_header(COMPLAINT_HEADERS), COMPLAINT_END)))


def last_section(text: Column, delimiter: str) -> Column:
    """Text after the last match of ``delimiter`` (all of it without a match)."""
    return F.element_at(F.split(text, delimiter), -1)


def text_from(text: Column, marker: str) -> Column:
    """Text from ``marker`` to the end, or all of it where the marker is absent."""
    at = F.instr(text, marker)
    return F.when(at > 0, F.substr(text, at)).otherwise(text)


@dataclass(frozen=True)
class LineRules:
    """Upper-case line dictionaries of the caller."""

    stop_lines: list[str] = field(default_factory=list)
    stop_prefixes: list[str] = field(default_factory=list)
    headings: list[str] = field(default_factory=list)
    trim_prefixes: list[str] = field(default_factory=list)


def _prefix_pattern(prefixes: list[str]) -> str:
    longest_first = sorted({p.upper() for p in prefixes}, key=lambda p: (-len(p), p))
    return "(?i)^(?:" + "|".join(re.escape(p) for p in longest_first) + ")"


def _words(words: list[str]) -> list[str]:
    return sorted({w.upper() for w in words})


def clean_pass(lines: Column, rules: LineRules) -> Column:
    """One pass: cut at the first end line, drop noise, trim known prefixes."""

    def stops(line: Column) -> Column:
        hit = F.upper(line).isin(_words(rules.stop_lines)) if rules.stop_lines else F.lit(False)
        if rules.stop_prefixes:
            hit = hit | line.rlike(_prefix_pattern(rules.stop_prefixes))
        return hit

    def before_stop(stripped: Column) -> Column:
        if not rules.stop_lines and not rules.stop_prefixes:
            return stripped
        # Position of the first end line, or one past the last line.
        ends = F.array_append(F.transform(stripped, stops), True)
        return F.slice(stripped, 1, (F.array_position(ends, True) - 1).cast("int"))

    kept = let(F.transform(lines, strip), before_stop)
    noise = r"^(?:=+|-+)\z"
    kept = F.filter(kept, lambda x: ~x.rlike(noise))
    if rules.headings:
        kept = F.filter(kept, lambda x: ~F.upper(x).isin(_words(rules.headings)))
    if rules.trim_prefixes:
        trim = _prefix_pattern(rules.trim_prefixes)
        kept = F.transform(
            kept,
            lambda x: F.when(
                x.rlike(trim), none_if_empty(F.regexp_replace(x, trim + r"\s*", ""))
            ).otherwise(x),
        )
        kept = F.filter(kept, lambda x: x.isNotNull())
    return kept


def clean_lines(text: Column, rules: LineRules) -> Column:
    """Repeat :func:`clean_pass` until nothing changes.

    Every pass trims one prefix of each line, so the longest run of known
    prefixes at the start of a line, plus one pass for what the last trim lays
    bare, reaches the fixpoint exactly.
    """

    def to_fixpoint(lines: Column) -> Column:
        passes = F.lit(1)
        if rules.trim_prefixes:
            run = _prefix_pattern(rules.trim_prefixes).replace("^", r"\G", 1) + r"\s*"
            runs = F.transform(lines, lambda x: F.regexp_count(strip(x), F.lit(run)))
            passes = F.array_max(runs) + 1
        return F.aggregate(F.sequence(F.lit(1), passes), lines, lambda kept, _: clean_pass(kept, rules))

    return let(F.split(text, r"\R"), to_fixpoint)


def primary_diagnosis(note: Column, rules: LineRules) -> Column:
    """The cleaned diagnosis block of a discharge note, null where there is none."""

    def cleaned(block: Column) -> Column:
        joined = F.array_join(clean_lines(strip(block), rules), "\n")
        trimmed = F.regexp_replace(F.regexp_replace(joined, r"^[.\-):+=]+", ""), r":+\z", "")
        return none_if_empty(strip(trimmed))

    tail = last_section(note, any_header(PREVIOUS_HEADERS))
    block = section(tail, any_header(TARGET_HEADERS), any_header(NEXT_HEADERS))
    return let(block, lambda b: F.when(b.isNotNull(), cleaned(b)))


def phrase_pattern(phrase: str) -> str:
    """Word-bounded, case-insensitive, flexible white space."""
    words = [re.escape(w) for w in phrase.strip().lower().split()]
    return r"(?iU)(?<!\w)" + r"\s+".join(words) + r"(?!\w)"


def ranked_phrases(phrases_by_key: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(phrase, key), the longest phrases first; every key counts as one of its own phrases."""
    pairs = (
        (phrase, key.lower())
        for key, phrases in phrases_by_key.items()
        for phrase in dict.fromkeys(p.strip().lower() for p in [*phrases, key])
        if phrase
    )
    return sorted(pairs, key=lambda pair: -len(pair[0]))


def words(text: Column) -> Column:
    """The words of a text, folded so that whatever matches without regard to case is equal."""
    def fold(w: Column) -> Column:
        return F.translate(F.lower(F.upper(F.translate(w, "\u0130", "i"))), "\u03c2", "\u03c3")

    return F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0)), fold)


def word_sequences(text: Column, lengths: list[int]) -> Column:
    """Distinct hashes of all runs of words of the given lengths; length 0 is the empty run, which every text has."""

    def hashes(found: Column, n: int) -> Column:
        if n == 0:
            return F.array(F.xxhash64(F.array().cast("array<string>")))
        runs = F.transform(F.sequence(F.lit(0), F.size(found) - n), lambda i: F.xxhash64(F.slice(found, i + 1, F.lit(n))))
        return F.when(F.size(found) >= n, runs).otherwise(F.array().cast("array<bigint>"))

    return let(words(text), lambda found: F.array_distinct(F.concat(F.array().cast("array<bigint>"), *[hashes(found, n) for n in lengths])))


def matching_keys(text: Column, phrases_by_key: dict[str, list[str]]) -> Column:
    """All keys with a phrase in ``text``, ordered by their longest matching phrase.

    For short dictionaries: each phrase is a literal pattern of the expression. Phrases
    are tried longest first, so a key stops at the phrase that decides its place; the
    pattern is only tried where plain search finds all words of the phrase.
    """
    ranked = ranked_phrases(phrases_by_key)
    by_key: dict[str, list[tuple[int, str]]] = {}
    for rank, (phrase, key) in enumerate(ranked):
        by_key.setdefault(key, []).append((rank, phrase))

    def found_in(folded: Column, phrase: str) -> Column:
        hit = text.rlike(phrase_pattern(phrase))
        for word in reversed(phrase.split()):
            hit = folded.contains(word.upper().lower()) & hit
        return hit

    def keys(folded: Column) -> Column:
        hits = []
        for key, entries in by_key.items():
            place = F.lit(None).cast("int")
            for rank, phrase in reversed(entries):
                place = F.when(found_in(folded, phrase), rank).otherwise(place)
            hits.append(F.struct(place.alias("place"), F.lit(key).alias("key")))
        found = F.filter(F.array(*hits), lambda h: h["place"].isNotNull())
        return F.transform(F.sort_array(found), lambda h: h["key"])

    return let(F.lower(F.upper(text)), keys)


def first_pattern(text: Column, patterns: list[tuple[str, str]]) -> Column:
    """Name of the first pattern that matches at the start of ``text``, else null."""
    name = F.lit(None).cast("string")
    for label, pattern in reversed(patterns):
        name = F.when(text.rlike(f"^(?:{pattern})"), F.lit(label)).otherwise(name)
    return name


def reasoning(text: Column) -> Column:
    """Raw reasoning: before the first closing tag and code fence, tags removed."""
    head = F.substring_index(F.substring_index(text, "</think>", 1), "```", 1)
    bare = F.replace(F.replace(head, F.lit("<think>"), F.lit("")), F.lit("</think>"), F.lit(""))
    return F.coalesce(strip_newlines(bare), F.lit(""))


def strip_newlines(text: Column) -> Column:
    return F.btrim(text, F.lit("\n"))


def seed_of(name: Column) -> Column:
    """Seed in a run name, 42 without one."""
    found = F.regexp_extract(name, r"-seed(\d+)", 1)
    return F.coalesce(none_if_empty(found).cast("int"), F.lit(42))


def without_seed(name: Column) -> Column:
    return F.regexp_replace(name, r"-seed4[34]", "")


def epoch_of(name: Column) -> Column:
    """Epoch at the end of a run name, null without one."""
    found = F.regexp_extract(name, r"-ep?(\d+)(?:-s\d+)?$", 1)
    return none_if_empty(found).cast("int")


def without_prefix(name: Column, prefix: str = "eval_results_") -> Column:
    return F.regexp_replace(name, "^" + re.escape(prefix), "")


def size_order(size: Column) -> Column:
    """Numeric sort key of a model size such as 0.6b or 14b."""
    return F.regexp_extract(size, r"^([\d.]+)", 1).cast("double")
