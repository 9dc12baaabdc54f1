"""Folder patterns: strftime compiled once to a column, and destinations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from datewright.functions.scalars import file_name, folder_segment

SUBJECT = "{subject}"

_NUMBERS = {
    "Y": (4, "year"), "m": (2, "month"), "d": (2, "day"), "H": (2, "hour"), "M": (2, "minute"), "j": (3, "doy"), "V": (2, "week"), "G": (4, "yearofweek"),
}
_TEXTS = {"b": "MMM", "h": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "p": "a"}
_WHOLE = {"F": "%Y-%m-%d", "T": "%H:%M:%S", "X": "%H:%M:%S", "R": "%H:%M", "D": "%m/%d/%y", "x": "%m/%d/%y"}


def _part(name: str, taken: Column) -> Column:
    return F.extract(F.lit(name), taken).cast("int")


def _number(letter: str, taken: Column) -> tuple[int, Column] | None:
    if letter in _NUMBERS:
        width, name = _NUMBERS[letter]
        return width, _part(name, taken)
    hour, days = _part("hour", taken), F.dayofweek(taken)  # Sunday is 1
    own = {
        "S": (2, F.floor(F.extract(F.lit("second"), taken)).cast("int")), "e": (-2, _part("day", taken)), "y": (2, F.pmod(_part("year", taken), F.lit(100))), "C": (2, F.floor(_part("year", taken) / 100)),
        "I": (2, F.pmod(hour + 11, F.lit(12)) + 1), "k": (-2, hour), "l": (-2, F.pmod(hour + 11, F.lit(12)) + 1), "u": (1, F.pmod(days + 5, F.lit(7)) + 1), "w": (1, days - 1), "g": (2, F.pmod(_part("yearofweek", taken), F.lit(100))),
        "U": (2, F.floor((_part("doy", taken) + 7 - days) / 7 + F.lit(0)) + F.lit(0)), "W": (2, F.floor((_part("doy", taken) + 6 - F.pmod(days + 5, F.lit(7))) / 7)), "s": (1, F.unix_seconds(taken.cast("timestamp"))),
    }
    return own.get(letter)


def _padded(value: Column, width: int, fill: str) -> Column:
    text = value.cast("bigint").cast("string")
    return text if not fill else F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit(fill))


def compile_pattern(pattern: str, taken: Column) -> Column:
    """The pattern's text for each time; ValueError for a blank pattern or an unknown specifier. Specifiers that need a zone are unknown."""
    if not pattern.strip():
        raise ValueError(f"invalid folder pattern {pattern!r}")
    out: list[Column] = []
    i, text = 0, ""
    while i < len(pattern):
        if pattern[i] != "%":
            text, i = text + pattern[i], i + 1
            continue
        i += 1
        fill = None
        if i < len(pattern) and pattern[i] in "-_0":
            fill, i = {"-": "", "_": " ", "0": "0"}[pattern[i]], i + 1
        letter = pattern[i] if i < len(pattern) else ""
        i += 1
        if letter in ("%", "n", "t") and fill is None:
            text += {"%": "%", "n": "\n", "t": "\t"}[letter]
            continue
        if text:
            out, text = [*out, F.lit(text)], ""
        if letter in _WHOLE and fill is None:
            out.append(compile_pattern(_WHOLE[letter], taken))
        elif letter in _TEXTS and fill is None:
            out.append(F.date_format(taken, _TEXTS[letter]))
        elif letter == "P" and fill is None:
            out.append(F.lower(F.date_format(taken, "a")))
        elif letter and (found := _number(letter, taken)):
            width, value = found
            out.append(_padded(value, abs(width), fill if fill is not None else " " if width < 0 else "0"))
        else:
            raise ValueError(f"invalid folder pattern {pattern!r}")
    return F.concat(*out, F.lit(text))


def destination(source: Column, taken: Column, root: str, pattern: str, subject: Column | None = None) -> Column:
    """root, the pattern's non-empty parts, the source's name. {subject} becomes a folder segment, `unsorted` where there is none."""
    pieces = pattern.split(SUBJECT)
    if not pattern.strip():
        raise ValueError(f"invalid folder pattern {pattern!r}")
    segment = F.coalesce(folder_segment(subject), F.lit("unsorted")) if subject is not None else F.lit("unsorted")
    columns: list[Column] = []
    for i, piece in enumerate(pieces):
        columns += ([segment] if i else []) + ([compile_pattern(piece, taken)] if piece.strip() else [F.lit(piece)])
    folder = F.concat(*columns)
    parts = F.array_join(F.filter(F.split(folder, r"[/\\]"), lambda p: p != ""), "/")
    return F.concat(F.lit(root.rstrip("/") + "/"), F.when(parts != "", F.concat(parts, F.lit("/"))).otherwise(F.lit("")), file_name(source))


def relative_folder(path: Column, root: str) -> Column:
    """The folder of a destination below root; the whole folder outside of it."""
    folder = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    head = root.rstrip("/")
    return F.when(folder == head, F.lit("")).when(folder.startswith(head + "/"), F.substring(folder, F.lit(len(head) + 2), F.length(folder))).otherwise(folder)
