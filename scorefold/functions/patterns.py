"""What a regular expression tells about the beginnings of its matches."""

from __future__ import annotations

MOST = 64  # beginnings of one pattern, at most
DIGITS = frozenset("0123456789")


class _Reader:
    """Reads a pattern branch by branch; keeps the set of texts one of which every match begins with."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def more(self) -> bool:
        return self.i < len(self.p)

    def branches(self) -> set[str]:
        found = self.branch()
        while self.more() and self.p[self.i] == "|":
            self.i += 1
            found |= self.branch()
        return found

    def branch(self) -> set[str]:
        heads, growing = {""}, True
        while self.more() and self.p[self.i] not in "|)":
            if self.p[self.i] == "^":
                self.i += 1
                continue
            item, whole = self.item()
            at_least_once, repeats = self.quantifier()
            if not growing:
                continue
            if item is None or not at_least_once or len(heads) * len(item) > MOST:
                growing = False
                continue
            heads = {h + x for h in heads for x in item}
            growing = whole and not repeats
        return heads

    def item(self) -> tuple[set[str] | None, bool]:
        """The texts the next item begins with (None: anything), and whether they are all of it."""
        c = self.p[self.i]
        self.i += 1
        if c == "(":
            found = self.branches()
            self.i += 1
            return found, False
        if c == "[":
            return self.members(), True
        if c == "\\":
            return self.escaped(), True
        return (None, True) if c in ".$" else ({c}, True)

    def escaped(self) -> set[str] | None:
        c = self.p[self.i]
        self.i += 1
        if c == "d":
            return set(DIGITS)
        if c in "QEpPxucN":  # quoting, classes and codes that are longer than one letter
            raise ValueError(c)
        return None if c.isalnum() else {c}

    def members(self) -> set[str] | None:
        found: set[str] | None = set()
        if self.p[self.i] == "^":
            found = None
            self.i += 1
        while self.p[self.i] != "]":
            c = self.p[self.i]
            self.i += 1
            if c in "[&":  # unions and intersections of classes
                raise ValueError(c)
            one = self.escaped() if c == "\\" else {c}
            if self.p[self.i] == "-" and self.p[self.i + 1] != "]" and one and len(one) == 1:
                last = self.p[self.i + 1]
                if last == "\\":
                    raise ValueError(last)
                self.i += 2
                one = {chr(k) for k in range(ord(*one), ord(last) + 1)}
            found = None if found is None or one is None else found | one
        self.i += 1
        return found

    def quantifier(self) -> tuple[bool, bool]:
        """Whether the item before occurs at least once, and whether it may occur again."""
        if not self.more() or self.p[self.i] not in "?*+{":
            return True, False
        c = self.p[self.i]
        self.i = self.p.index("}", self.i) + 1 if c == "{" else self.i + 1
        if self.more() and self.p[self.i] in "?+":
            self.i += 1
        return c == "+", True


def literal_prefixes(pattern: str | None) -> list[str]:
    """Texts one of which every match at the start of a text begins with.

    The empty text stands for patterns that may begin with anything, and for those with
    parts that are not read here (flags, look-arounds, quoting, classes of classes). No
    pattern, no texts.
    """
    if pattern is None:
        return []
    if "(?" in pattern:
        return [""]
    reader = _Reader(pattern)
    try:
        found = reader.branches()
    except (IndexError, ValueError):
        return [""]
    return [""] if reader.more() else sorted(found)
