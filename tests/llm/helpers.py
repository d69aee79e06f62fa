"""Small tables and plain models that the operators are held against."""

from __future__ import annotations

import random

SPACE = " \t\n\x0b\x0c\r"


def words(text: str | None) -> list[str]:
    out, cur = [], ""
    for c in text or "":
        if c in SPACE:
            if cur:
                out.append(cur)
            cur = ""
        else:
            cur += c
    return [*out, cur] if cur else out


def prose(rng: random.Random, n: int, letters: str = "etaoinshrdlu") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(n))


#: Texts that every operator on texts must survive.
ODD = [None, "", "   \n\t ", "a", "one two", "x" * 5000, "é😀 ▁ ﷐  ﻿\x00 z", "Ａ b\u0085c", "\n\n\nline\nline\n", "<b>&amp;</b> </turn> ### \\"]
