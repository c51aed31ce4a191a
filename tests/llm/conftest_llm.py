"""Rows and patterns that the tests share."""

from __future__ import annotations

import re

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

MORSE = "ab"
for _ in range(10):  # the Thue-Morse sequence of 2,048 letters: sums of powers don't tell it from its complement
    MORSE += MORSE.translate(str.maketrans("ab", "ba"))
#: Words that are different but alike to hashes that repeat their weights or are linear.
ALIKE = ["a" * 4096 + "b" * 4096, "b" * 4096 + "a" * 4096, MORSE, MORSE.translate(str.maketrans("ab", "ba"))]

#: Nulls, empty and blank texts, a very long text, ties and repeated rows.
ODD = [
    (None, None),
    (None, "a null id"),
    (1, None),
    (2, ""),
    (3, " \n\t"),
    (4, "one"),
    (5, "word " * 60_000),
    (6, "the same text in two rows of one document id, twice over"),
    (6, "the same text in two rows of one document id, twice over"),
    (7, "the same text in two rows of one document id, twice over"),
    (8, "!!! ??? ..."),
    (9, "Überraschung für 100 Ärzte 日本語のテキスト"),
]
