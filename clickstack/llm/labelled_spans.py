"""Labelled spans for training the tagger of personal data: lines written by rules, from a seed.

Each line is a list of (text, kind) parts, kind None outside. Personal data comes in the plain forms and in others that
the plain patterns miss: telephone numbers without a country sign, mail addresses with blanks or brackets
around their sign, addresses and card numbers with other separators. Numbers of other kinds stay unmarked.
"""

from __future__ import annotations

import numpy as np

from clickstack.llm.base import ship_by_value

KINDS = ("email", "ip", "card", "phone")
LETTERS = "abcdefghijklmnopqrstuvwxyz"
MARKS = (" ", " ", " ", " ", ", ", ". ", "\n", ": ", " (")


def luhn_digit(digits: list[int]) -> int:
    """The digit that completes a card number."""
    total = sum(d if i % 2 else (2 * d) // 10 + (2 * d) % 10 for i, d in enumerate(reversed(digits)))
    return -total % 10


class Writer:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)

    def one(self, items):
        return items[int(self.rng.integers(len(items)))]

    def digits(self, n: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, n)))

    def word(self) -> str:
        out = "".join(self.one(LETTERS) for _ in range(int(self.rng.integers(1, 11))))
        return self.one((out, out, out, out.capitalize(), out.upper(), out[:-1] + self.one("éäßñç")))

    def email(self, plain: bool) -> str:
        name = self.one((self.word(), f"{self.word()}.{self.word()}", f"{self.word()}{self.digits(2)}", f"{self.word()}.{self.digits(2)}"))
        host = f"{self.word().lower()}{self.one(('', self.digits(1)))}.{self.one(('com', 'org', 'net', 'example.com', 'co.uk', 'de'))}"
        return f"{name}@{host}" if plain else f"{name}{self.one((' @ ', ' @', '@ ', ' [@] ', '(@)', '[@]'))}{host}"

    def ip(self, plain: bool) -> str:
        parts = list(map(str, self.rng.integers(0, 256, 4)))
        return ".".join(parts) if plain else self.one((" . ", "[.]", "(.)", ". ")).join(parts)

    def card(self, plain: bool) -> str:
        own = [int(self.one("3456")), *map(int, self.rng.integers(0, 10, 14))]
        own = "".join(map(str, [*own, luhn_digit(own)]))
        by = self.one(("", "", " ", "-")) if plain else self.one((".", "  ", "/", " - "))
        return by.join(own[k : k + 4] for k in range(0, 16, 4))

    def phone(self, plain: bool) -> str:
        d = self.digits
        if plain:
            return self.one((f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(2)} {d(4)} {d(4)}", f"+{d(1)}-{d(3)}-{d(3)}-{d(4)}", f"+{d(12)}"))
        return self.one((f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}",
                         f"1 ({d(3)}) {d(3)}-{d(4)}", f"00{d(2)} {d(2)} {d(4)} {d(4)}"))

    def other(self) -> str:
        """Numbers and signs that are no personal data."""
        d = self.digits
        n = int(self.rng.integers(1, 5))
        mixed = "".join(self.one("0123456789abcdef") for _ in range(int(self.rng.integers(8, 40))))
        return self.one((
            d(n), d(n), f"{d(2)}.{d(2)}.", f"{d(1)}.", f"{d(4)}-{d(2)}-{d(2)}", f"{d(2)}/{d(2)}/{d(4)}", f"{d(2)}:{d(2)}:{d(2)}", f"${d(3)},{d(3)}.{d(2)}",
            f"v{d(1)}.{d(1)}.{d(2)}", f"{d(1)}.{d(1)}", mixed, f'"{mixed}"', f"key={mixed}", mixed.upper(), f"{d(4)}-{d(4)}", f"[{d(2)}]", f"({d(4)})",
            f"{d(2)}%", f"#{d(5)}", f"No. {d(6)}", f"{d(7)}", f"{d(9)}", f"{d(2)} x {d(2)}", f"AKIA{mixed.upper()[:16]}", f"{d(20)}", f"{d(28)}", f"-{d(1)}.{d(6)}",
            f"@{self.word()}", f"{self.word()} @ {d(2)}", f"{d(3)}-{d(2)}-{d(4)}", f"1{d(3)}-2{d(3)}", f"{d(1)}-{d(1)}", f"+{d(1)}", f"{d(2)}+{d(2)}={d(3)}",
            f"{d(4)}.{d(3)}.{d(2)}", f"{self.word()}{d(3)}", f"{d(3)} {d(3)} {d(3)}", f"{d(1)}, {d(2)}, {d(2)} and {d(3)}"))

    def line(self) -> list[tuple[str, str | None]]:
        parts: list[tuple[str, str | None]] = []
        for _ in range(int(self.rng.integers(1, 4))):
            for _ in range(int(self.rng.integers(0, 7))):
                parts += [(self.word(), None), (self.one(MARKS), None)]
            if self.rng.random() < 0.5:
                kind = self.one(KINDS)
                parts.append((getattr(self, kind)(bool(self.rng.random() < 0.5)), kind))
            else:
                parts.append((self.other(), None))
            parts.append((self.one(MARKS), None))
        return parts


def lines(n: int, seed: int) -> list[list[tuple[str, str | None]]]:
    writer = Writer(seed)
    return [writer.line() for _ in range(n)]


ship_by_value(__name__)
