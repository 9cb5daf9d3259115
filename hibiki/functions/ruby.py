"""Ruby markup ｜surface《reading》 in a text: parsing, and splitting at the marked spans."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kana import HIRA, KATA, let

PARSED = "plain string, annotations array<struct<start:int,end:int,reading:string>>"
PIECES = "array<struct<type:string,surface:string,reading:string>>"
_KATA = str.maketrans(HIRA, KATA)
# one character, escaped or not; and a marked span: no bar, bracket or line break inside, nothing empty
_ATOM = r"(?:\\[｜|《》\\]|[^｜|《》\n\r\\]|\\(?![｜|《》\\]))"
_SPAN = re.compile(rf"[｜|]({_ATOM}+)《({_ATOM}+)》|\\([｜|《》\\])|(.)", re.S)
_ESCAPED = re.compile(r"\\([｜|《》\\])")


def parse(text: str) -> dict:
    """The text without markup and escapes, and the marked spans' code-point offsets and katakana readings."""
    plain, marks, at = [], [], 0
    for m in _SPAN.finditer(text):
        if m[1]:
            surface = _ESCAPED.sub(r"\1", m[1])
            marks.append({"start": at, "end": at + len(surface), "reading": _ESCAPED.sub(r"\1", m[2]).translate(_KATA)})
        else:
            surface = m[3] or m[4]
        plain.append(surface)
        at += len(surface)
    return {"plain": "".join(plain), "annotations": marks}


def pieces(text: str) -> list[dict]:
    """Marked spans and the stretches between them, in order; a text without spans is one stretch, even if empty."""
    got = parse(text)
    plain, out, at = got["plain"], [], 0
    for a in got["annotations"]:
        if a["start"] > at:
            out.append({"type": "chunk", "surface": plain[at : a["start"]], "reading": None})
        out.append({"type": "ruby", "surface": plain[a["start"] : a["end"]], "reading": a["reading"]})
        at = a["end"]
    if at < len(plain) or not out:
        out.append({"type": "chunk", "surface": plain[at:], "reading": None})
    return out


# the same for Java's engine, possessive so that long spans need no stack; and what the matches of a text are: spans, runs of plain characters, escapes, single characters
_JAVA_ATOMS = r"(?:[^｜|《》\n\r\\]++|\\[｜|《》\\]|\\(?![｜|《》\\]))++"
_JAVA_SPAN = rf"[｜|]({_JAVA_ATOMS})《({_JAVA_ATOMS})》"
_JAVA_MATCHES = rf"{_JAVA_SPAN}|[^｜|\\]++|\\[｜|《》\\]|(?s:.)"


def _plain(s: Column) -> Column:
    return F.regexp_replace(s, r"\\([｜|《》\\])", "$1")


def ruby_parse(s: Column) -> Column:
    """struct<plain, annotations>: the text's matches in order, and a fold that keeps the place in the plain text."""
    first = lambda m: F.left(m, F.lit(1))
    kind = "array<struct<surface:string,reading:string>>"

    def piece(m):
        span = (F.length(m) > 1) & first(m).isin("｜", "|")
        surface = F.when(span, _plain(F.regexp_extract(m, _JAVA_SPAN, 1))).when((F.length(m) == 2) & (first(m) == "\\"), F.right(m, F.lit(1))).otherwise(m)
        return F.struct(surface.alias("surface"), F.when(span, F.translate(_plain(F.regexp_extract(m, _JAVA_SPAN, 2)), HIRA, KATA)).alias("reading"))

    pieces_ = F.transform(F.regexp_extract_all(s, F.lit(_JAVA_MATCHES), 0), piece).cast(kind)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,reading:string>>").alias("marks"))

    def step(acc, p):
        end = acc["at"] + F.length(p["surface"])
        mark = F.struct(acc["at"].alias("start"), end.alias("end"), p["reading"].alias("reading"))
        return F.struct(end.alias("at"), F.when(p["reading"].isNull(), acc["marks"]).otherwise(F.concat(acc["marks"], F.array(mark))).alias("marks"))

    def whole(ps):
        plain = F.array_join(F.transform(ps, lambda p: p["surface"]), "")
        return F.when(ps.isNotNull(), F.struct(plain.alias("plain"), F.aggregate(ps, start, step)["marks"].alias("annotations")))

    # a null text gives nulls, not a null struct
    out = let(pieces_, whole)
    return F.struct(out["plain"].alias("plain"), out["annotations"].alias("annotations"))


def ruby_split(s: Column) -> Column:
    """Marked spans and the stretches between them, in order, of ruby_parse's result."""

    def cut(r):
        plain, marks = r["plain"], r["annotations"]
        piece = lambda kind, a, b, reading: F.struct(F.lit(kind).alias("type"), F.substring(plain, a + 1, b - a).alias("surface"), reading.cast("string").alias("reading"))
        none = F.lit(None).cast("string")

        def around(i):
            m = F.get(marks, i)
            before = F.coalesce(F.get(marks, i - 1)["end"], F.lit(0))
            rest = F.when((before < F.length(plain)) | (F.size(marks) == 0), piece("chunk", before, F.length(plain), none))
            return F.when(i < F.size(marks), F.array(F.when(m["start"] > before, piece("chunk", before, m["start"], none)), piece("ruby", m["start"], m["end"], m["reading"]))).otherwise(F.array(rest))

        parts = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.size(marks)), around)), lambda x: x.isNotNull())
        return F.when(plain.isNotNull(), parts.cast(PIECES))

    return let(ruby_parse(s), cut)


def has_ruby(s: Column) -> Column:
    """Whether a valid span is there; native, since only existence matters."""
    # a bar is escaped by an odd run of backslashes before it
    return s.rlike(rf"(?<!\\)(?:\\\\)*[｜|]{_ATOM}+《{_ATOM}+》")
