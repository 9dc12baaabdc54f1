"""Odd rows that every operator takes."""

#: Nulls in any column, empty and blank texts, ties, repeated rows, a very long word and text.
ODD = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\n ", None, "a"),
    (4, "one two three four five six seven", "en", None),
    (5, "one two three four five six seven", "en", "b"),
    (5, "one two three four five six seven", "en", "b"),
    (6, "one  two three\nfour five six seven ", "xx", "b"),
    (None, "one two three four five six seven", None, None),
    (7, "x" * 50_000, "en", "c"),
    (8, "word " * 20_000, "de", "c"),
    (9, "12345 !!! ???", "en", "c"),
    (10, "é日本語 😀 naïve ß \x00 end", "fr", "c"),
    (11, "a b c d", "fr", "c"),
]
