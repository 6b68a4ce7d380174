"""Labelled lines with personal data in many spellings, and with numbers and words that only look like it."""

from __future__ import annotations

import random

SYLLABLES = "ba ko ri ten sul mar ven dio lat per con tra um is ol eth an gre fi no ch qu ser po".split()
ENDINGS = "com org net edu de fr es it co.uk io info".split()
ASKS = {
    "email": "email mail e-mail contact write reach correo courriel".split(),
    "phone": "phone call tel telephone mobile cell fax ring telefon teléfono tél appelez whatsapp".split(),
    "card": "card visa mastercard amex credit debit karte tarjeta carte".split(),
    "ip": "ip address host server login from client peer node".split(),
}
OTHERS = "order invoice ticket isbn version build date total price id code ref number account serial model batch lot tracking page size rate score order-id".split()


class Lines:
    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def digits(self, n: int) -> str:
        return "".join(self.r.choices("0123456789", k=n))

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.choice([1, 1, 2, 2, 3])))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi)))

    def valid_card(self) -> str:
        n = self.r.choice([15, 16, 16, 16, 16, 19])
        body = self.r.choice("3456") + self.digits(n - 2)
        total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    def email(self) -> str:
        at = self.r.choice([" at ", " [at] ", "[at]", " (at) ", "(at)", " AT ", " @ ", "{at}", " <at> ", "@"])
        dot = self.r.choice([" dot ", " [dot] ", "[dot]", "(dot)", " DOT ", ".", "[.]", " . "] if "a" in at.lower() else [" dot ", "[dot]", "[.]", " . ", "(dot)"])
        name = self.word() + self.r.choice(["", "", ".", "_"]) + self.r.choice(["", self.word(), self.digits(2)])
        return name.rstrip("._") + at + dot.join([self.word(), *self.r.choice(ENDINGS).split(".")])

    def ip(self) -> str:
        if self.r.random() < 0.35:
            groups = [f"{self.r.randrange(65536):x}" for _ in range(8)]
            return self.r.choice([":".join(groups), f"{groups[0]}::{groups[1]}", f"fe80::{':'.join(groups[:3])}", f"2001:{groups[0]}:{groups[1]}::{groups[2]}"])
        return self.r.choice(["[.]", "(.)", " dot ", "[dot]", " . "]).join(str(self.r.randrange(256)) for _ in range(4))

    def card(self) -> str:
        c, sep = self.valid_card(), self.r.choice([".", "  ", " - ", "/"])
        if len(c) == 15:
            return sep.join([c[:4], c[4:10], c[10:]])
        return sep.join(c[k : k + 4] for k in range(0, len(c), 4))

    def phone(self) -> str:
        d = self.digits
        sure = [f"({d(3)}) {d(3)}-{d(4)}", f"({d(3)}){d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"00{d(2)} {d(2)} {d(4)} {d(4)}", f"(0{d(2)}) {d(7)}", f"0{d(2)}/{d(7)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"1 ({d(3)}) {d(3)}-{d(4)}"]
        return self.r.choice(sure)

    def asked_phone(self) -> str:
        d = self.digits
        return self.r.choice([d(10), f"0{d(10)}", f"{d(3)} {d(4)}", f"{d(3)}-{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"{d(4)} {d(6)}", f"0{d(3)} {d(6)}"])

    def other(self) -> str:
        """What is not personal."""
        d, r = self.digits, self.r
        year = str(r.randint(1900, 2030))
        return r.choice([
            f"{year}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{r.randint(1, 28):02}/{r.randint(1, 12):02}/{year}", f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{year}", f"{year}-{r.randint(1, 12):02}-{r.randint(1, 28):02} {d(2)}:{d(2)}:{d(2)}",
            f"{r.randint(1, 9)}.{r.randint(0, 99)}.{r.randint(0, 9999)}", f"{d(1)}.{d(1)}.{d(4)}", f"{d(7)}", f"{d(8)}", f"{d(9)}", f"{d(10)}", f"{d(12)}", f"{d(16)}", f"{d(16)}", f"{d(20)}", f"{d(2)}.{d(6)}, {d(1)}.{d(7)}", f"978-{d(1)}-{d(2)}-{d(6)}-{d(1)}", f"978{d(10)}",
            f"{r.randint(1, 999)} {d(3)} {d(3)}", f"{r.randint(1, 999)}.{d(3)}.{d(3)}", f"{year}-{year}", f"{year} {year} {year}", f"{year}{d(8)}", " ".join(str(r.randint(0, 300)) for _ in range(r.randint(3, 9))), f"{d(2)}:{d(2)}:{d(2)}", f"{d(4)}-{d(4)}", f"{d(4)} - {d(4)}", f"#{d(9)}", f"${d(3)}.{d(3)}.{d(3)}",
            f"{r.randint(300, 999)}.{r.randint(300, 999)}.{r.randint(0, 99)}.{r.randint(0, 99)}", f"{d(5)}-{d(5)}-{d(5)}", *[f'token = "{"".join(r.choices("0123456789012345789abcdef", k=r.choice([20, 32, 40])))}"'] * 3, f"{self.word()}{d(8)}", f"{d(9)}{self.word()}", f"{d(11)}",
            f"{self.word()} at {self.word()} dot", f"at {self.word()} dot {r.choice(ENDINGS[:6])}", f"at www dot {self.word()} dot com", f"@ {self.word()}", f"@{self.word()}", f"{self.word()}.{self.word()}", f"a dot product", "the dot at the end", f"{self.word()} at {self.word()}",
        ])

    def line(self) -> tuple[str, list[tuple[str, int, int]]]:
        text, spans = self.words(1, 6), []
        for _ in range(self.r.randint(1, 3)):
            kind, lead = self.r.choice(["email", "ip", "card", "phone", "phone", "", "", "", ""]), ""
            found = getattr(self, kind or "other")()
            if kind and self.r.random() < 0.6:
                lead = self.r.choice(ASKS[kind]) + self.r.choice([" ", ": ", " is ", " me: ", " at ", " to "] if kind not in ("email",) else [" ", ": ", " is ", " to ", " - "])
                if kind == "phone" and self.r.random() < 0.4:
                    found = self.asked_phone()
            elif not kind and self.r.random() < 0.5:
                lead = self.r.choice(OTHERS) + self.r.choice([" ", ": ", " is ", " #", " no. "])
            text += self.r.choice([" ", " ", ". ", ", ", "\n", ": "]) + lead
            if kind:
                spans.append((kind, len(text), len(text) + len(found)))
            text += found + self.r.choice(["", " ", ".", ",", "!", ")"]) + " " + self.words(1, 5)
        return text, spans


def labelled_lines(n: int = 1200, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    lines = Lines(seed)
    return [lines.line() for _ in range(n)]
