"""Writing targets and prompts: JSON text, numbered lists, templates, chat text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from scorefold.functions.binding import let
from scorefold.functions.codes import short_code, short_codes
from scorefold.functions.text import strip_newlines

# Sentences of the training targets and prompts.
CODE_REASON = "Based on the admission note code {} is suspected."
NAME_REASON = "Based on the admission note {} is suspected."
FINDING_REASON = "Extracted {} from the admission note."
FINDING_EXAMPLE = "Based on the admission note, {} is suspected to be present / absent / unmentioned."
CODES_BEFORE = "I think the patient has the following ICD codes:\n"
CODES_AFTER = (
    "\nAfter a final consideration, I think the patient has the following ICD codes:\n"
)
NAMES_BEFORE = "I think in order of likelihood this is the order of diseases:\n"
NAMES_AFTER = (
    "\nAfter final reranking the diseases, I think this is the order of diseases:\n"
)
PRESENT_TITLE = "\n#### Present Manifestations"
ABSENT_TITLE = "\n#### Absent Manifestations"
NO_FINDINGS = "Failed to extract manifestations"
UNREADABLE_FINDINGS = "Invalid dictionary string provided: "
DIAGNOSIS_FORMAT = """[
        {
            "name": "diagnosis_0",
            "reason": "Based on clinical evidence, diagnosis_0 is suspected."
        },
        {
            "name": "diagnosis_1",
            "reason": "Based on clinical evidence, diagnosis_1 is suspected."
        },
        ...
        {
            "name": "diagnosis_9",
            "reason": "Based on clinical evidence, diagnosis_9 is suspected."
        }
    ]"""
DIRECT_DIAGNOSIS_FORMAT = """[
    {
        "name": "diagnosis_0",
        "reason": "Based on clinical evidence, diagnosis_0 is suspected."
    },
    {
        "name": "diagnosis_1",
        "reason": "Based on clinical evidence, diagnosis_1 is suspected."
    },
    ...
]"""
CODE_FORMAT = """[
    {
        "icd_code": "icd_code_0",
        "reason": "Based on clinical evidence, icd_code_0 is suspected."
    },
    {
        "icd_code": "icd_code_1",
        "reason": "Based on clinical evidence, icd_code_1 is suspected."
    },
    ...
]"""
NO_DIAGNOSES = "Not assigned"
NO_LABS = "No laboratory results available."
MAX_PROMPT = 25000
SLOT = r"(?<!\{)\{(\w+)\}(?!\})"


def filled(sentence: str, value: Column) -> Column:
    head, tail = sentence.split("{}")
    return F.concat(F.lit(head), value, F.lit(tail))


def json_string(value: Column, ascii_only: bool = False) -> Column:
    """One quoted JSON string."""
    options = {"writeNonAsciiCharacterAsCodePoint": "true"} if ascii_only else {}
    return F.btrim(F.to_json(F.array(value), options), F.lit("[]"))


def json_entries(entries: Column, key: str, ascii_only: bool = False) -> Column:
    """``[{"key": .., "reason": ..}, ..]`` with a space after commas and colons.

    Quotes inside a text are escaped, so the replaced pieces of punctuation
    only occur between the fields.
    """
    options = {"writeNonAsciiCharacterAsCodePoint": "true"} if ascii_only else {}
    text = F.to_json(entries, options)
    for old, new in (
        ('","reason":"', '", "reason": "'), (f'{{"{key}":"', f'{{"{key}": "'), ('"},{"', '"}, {"'),
    ):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def json_findings(findings: Column) -> Column:
    """``{"name": {"value": .., "reasoning": ..}, ..}`` on one line."""
    text = F.to_json(findings)
    for old, new in (('":{"value":', '": {"value": '), (',"reasoning":"', ', "reasoning": "'), ('"},"', '"}, "')):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def code_entry(code: Column) -> Column:
    return F.struct(code.alias("icd_code"), filled(CODE_REASON, code).alias("reason"))


def name_entry(name: Column) -> Column:
    return F.struct(name.alias("name"), filled(NAME_REASON, name).alias("reason"))


def align_codes(entries: Column, gold: Column, version: int = 10) -> Column:
    """Keep entries with a gold short code, then add the gold codes left over."""

    def short_of(e: Column) -> Column:
        return short_code(F.replace(e["icd_code"], F.lit("."), F.lit("")), version)

    kept = let(
        short_codes(gold, version),
        lambda wanted: F.filter(entries, lambda e: F.array_contains(wanted, short_of(e))),
    )
    missing = let(
        F.transform(entries, short_of),
        lambda seen: F.filter(gold, lambda c: ~F.array_contains(seen, short_code(c, version))),
    )
    return F.concat(kept, F.transform(missing, code_entry))


def target_first(entries: Column, target: Column) -> Column:
    """Move the first entry named ``target`` to the front, or put one there."""

    def moved(at: Column) -> Column:
        rest = F.filter(entries, lambda e, i: i + 1 != at)
        front = F.when(at > 0, F.get(entries, (at - 1).cast("int"))).otherwise(name_entry(target))
        return F.concat(F.array(front), rest)

    names = F.transform(entries, lambda e: e["name"])
    return let(F.coalesce(F.array_position(names, target), F.lit(0)), moved)


def numbered(items: Column, separator: str) -> Column:
    """``1<sep>a`` .. one per line."""
    lines = F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(separator), x))
    return F.array_join(lines, "\n")


def with_code_order(thinking: Column, entries: Column) -> Column:
    order = numbered(F.transform(entries, lambda e: e["icd_code"]), ": ")
    return F.concat(thinking, F.lit(CODES_BEFORE), order, F.lit(CODES_AFTER))


def with_name_order(thinking: Column, entries: Column) -> Column:
    order = numbered(F.transform(entries, lambda e: e["name"]), ": ")
    return F.concat(strip_newlines(thinking), F.lit(NAMES_BEFORE), order, F.lit(NAMES_AFTER))


def gold_codes_target(gold: Column, ascii_only: bool = False) -> Column:
    """Target built from gold codes only; null without codes."""
    return F.when(
        F.size(gold) > 0, json_entries(F.transform(gold, code_entry), "icd_code", ascii_only)
    )


def gold_name_target(name: Column, ascii_only: bool = False) -> Column:
    return json_entries(F.array(name_entry(name)), "name", ascii_only)


def _finding_block(name: Column, value: Column, reasoning: Column) -> Column:
    return F.concat(
        F.lit("    "), json_string(name, True), F.lit(': {\n        "value": '), value,
        F.lit(',\n        "reasoning": '), json_string(reasoning, True), F.lit("\n    }"),
    )


def findings_target(features: Column, vector: Column) -> Column:
    """Indented JSON of feature values; null where the lengths differ."""
    blocks = F.zip_with(
        features, vector,
        lambda n, v: _finding_block(n, v.cast("string"), filled(FINDING_REASON, n)),
    )
    body = F.concat(F.lit("{\n"), F.array_join(blocks, ",\n"), F.lit("\n}"))
    return F.when(F.size(features) == F.size(vector), body)


def findings_example(features: Column) -> Column:
    """Indented JSON that shows the expected shape."""
    blocks = F.transform(
        features, lambda n: _finding_block(n, F.lit("0"), filled(FINDING_EXAMPLE, n))
    )
    return F.concat(F.lit("{\n"), F.array_join(blocks, ",\n"), F.lit("\n}"))


def findings_text(findings: Column, cell: Column | None = None) -> Column:
    """Present and absent findings as two bullet lists.

    With the stored ``cell``, one that holds something unreadable is quoted.
    """

    def bullets(entries: Column, value: int) -> Column:
        kept = F.filter(entries, lambda e: e["value"]["value"] == value)
        return F.transform(
            kept,
            lambda e: F.concat(
                F.lit("  - "), e["key"], F.lit(": "),
                F.coalesce(e["value"]["reasoning"], F.lit("N/A")),
            ),
        )

    lines = let(F.map_entries(findings), lambda entries: F.concat(
        F.array(F.lit(PRESENT_TITLE)), bullets(entries, 1), F.array(F.lit(ABSENT_TITLE)), bullets(entries, -1)
    ))
    missing = F.lit(NO_FINDINGS)
    if cell is not None:
        missing = F.when(cell.isNotNull() & (cell != "None"), F.concat(F.lit(UNREADABLE_FINDINGS), cell)).otherwise(missing)
    return F.coalesce(F.array_join(lines, "\n"), missing)


def ranked_names_text(entries: Column, label: Column, fallback: Column) -> Column:
    """Numbered names; a list longer than five stops after the label."""

    def line(e: Column, i: Column) -> Column:
        return F.concat(
            F.lit("  "), (i + 1).cast("string"), F.lit(". "), e["name"], F.lit(": "),
            F.coalesce(e["reason"], F.lit("No reason provided.")), F.lit("\n"),
        )

    def rendered(items: Column) -> Column:
        at_label = F.filter(
            F.transform(items, lambda e, i: F.when((i > 4) & (e["name"] == label), i + 1)),
            lambda p: p.isNotNull(),
        )
        stop = F.coalesce(F.get(at_label, F.lit(0)), F.size(items))
        return F.array_join(F.transform(F.slice(items, 1, stop), line), "")

    return F.coalesce(let(entries, rendered), fallback)


def template_parts(template: Column) -> Column:
    """The literal texts of a template and the names of the slots between them; null without template."""
    literals = F.transform(
        F.split(template, SLOT),
        lambda s: F.replace(F.replace(s, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}")),
    )
    names = F.regexp_extract_all(template, F.lit(SLOT), F.lit(1))
    return F.when(template.isNotNull(), F.struct(literals.alias("literals"), names.alias("names")))


def fill_parts(parts: Column, slots: dict[str, Column], limit: int | None = None, strict: bool = False) -> Column:
    """A template that is already in parts, with its slots filled; see :func:`fill_template`.

    Values the template has no slot for are not computed.
    """
    values = F.create_map(
        *[part for name, value in slots.items()
          for part in (F.lit(name), F.when(F.array_contains(parts["names"], F.lit(name)), value.cast("string")))]
    )

    def slot_value(known: Column, name: Column) -> Column:
        there = F.coalesce(F.try_element_at(known, name), F.lit(""))
        if not strict:
            return there
        unknown = F.raise_error(F.concat(F.lit("the template has an unknown slot: "), name)).cast("string")
        return F.when(name.isNull(), "").when(F.map_contains_key(known, name), there).otherwise(unknown)

    # zip_with pads the shorter side: the last literal has no slot after it.
    pieces = let(
        values,
        lambda filled_in: F.zip_with(
            parts["literals"], parts["names"],
            lambda s, n: F.concat(s, slot_value(filled_in, n)),
        ),
    )
    text = F.array_join(pieces, "")
    return F.substring(text, 1, limit) if limit else text


def fill_template(template: Column, slots: dict[str, Column], limit: int | None = None, strict: bool = False) -> Column:
    """Replace ``{slot}`` once each; doubled braces stand for single ones.

    The template is split at its slots, so text that is filled in is never
    searched again. A null value is empty text; so is a slot that is not given,
    unless ``strict`` makes it stop the job. ``limit`` is the prompt ceiling of the model, in characters.
    """
    return F.get(F.transform(F.array(template_parts(template)), lambda parts: fill_parts(parts, slots, limit, strict)), F.lit(0))


def chat_text(system: Column, user: Column, thinking: Column, output: Column) -> Column:
    """One training text; null thinking gives a bare answer, '' an empty think block."""
    block = F.concat(
        F.lit("<think>\n"), strip_newlines(thinking), F.lit("\n</think>\n\n"), output
    )
    answer = F.when(thinking.isNull(), output).otherwise(block)

    def turn(role: str, content: Column) -> Column:
        return F.concat(F.lit(f"<|im_start|>{role}\n"), content, F.lit("<|im_end|>\n"))

    return F.concat(turn("system", system), turn("user", user), turn("assistant", answer))
