"""Format-preserving pseudonyms: validated numbers, dates and addresses are permuted by a keyed Feistel network.

A value is read as one number in the mixed radix of its format, permuted among all values of that format, and written back
with fresh check digits. The permutation depends on the key and the format only, so equal values get equal pseudonyms in
every document, different values different ones, and the key's holder can undo it.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_and_text, strings

ROUNDS = 8
FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()
PATTERNS = {  # tried at each place in this order
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])",
    "phone": r"(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\w)|(?<![\w.+])\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w.+-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
    "date": r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})(?![\w/-]|\.\d)",
}
NUMBERS = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS.items()))
EMAIL = re.compile(r"(?<![\w.+-])([\w.+-]+)(@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})")


class Feistel:
    """Keyed permutations of 0..size-1; ``kind`` chooses one of them."""

    def __init__(self, key: bytes):
        self.key = key

    def round(self, kind: str, size: int, turn: int, half: int, bits: int) -> int:
        said = f"{kind}|{size}|{turn}|{half}".encode()
        mask = hashlib.blake2b(said, key=self.key, digest_size=32).digest()
        for block in range(1, -(-bits // 256)):  # as long as the half it is laid over
            mask += hashlib.blake2b(said + b"|%d" % block, key=self.key, digest_size=32).digest()
        return int.from_bytes(mask, "big") & ((1 << bits) - 1)

    def permute(self, kind: str, value: int, size: int, back: bool = False) -> int:
        """Steps of the network over the next even number of bits, until the value is below ``size`` again."""
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        while True:
            left, right = value >> bits, value & ((1 << bits) - 1)
            for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    left, right = right ^ self.round(kind, size, turn, left, bits), left
                else:
                    left, right = right, left ^ self.round(kind, size, turn, right, bits)
            value = left << bits | right
            if value < size:
                return value


def luhn_digit(digits: str) -> str:
    total = sum(int(d) if k % 2 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(reversed(digits)))
    return str(-total % 10)


def iban_number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4]))


class Pseudonyms:
    def __init__(self, key: bytes):
        self.network = Feistel(key)

    def mixed(self, kind: str, values: list[int], sizes: list[int], back: bool) -> list[int]:
        number, size = 0, 1
        for v, s in zip(values, sizes):
            number, size = number * s + v, size * s
        number = self.network.permute(kind, number, size, back)
        out = []
        for s in reversed(sizes):
            number, v = divmod(number, s)
            out.append(v)
        return out[::-1]

    def characters(self, kind: str, text: str, back: bool) -> str:
        """Digits stay digits, small letters small and capitals capitals; other characters stay as they are."""
        spans = {c: ("0", 10) if c.isdigit() else ("a", 26) if "a" <= c <= "z" else ("A", 26) for c in set(text) if c.isascii() and c.isalnum()}
        at = [i for i, c in enumerate(text) if c in spans]
        if not at:
            return text
        shape = "".join({10: "9", 26: spans[text[i]][0]}[spans[text[i]][1]] for i in at)
        new = self.mixed(f"{kind}|{shape}", [ord(text[i]) - ord(spans[text[i]][0]) for i in at], [spans[text[i]][1] for i in at], back)
        chars = list(text)
        for i, v in zip(at, new):
            chars[i] = chr(ord(spans[text[i]][0]) + v)
        return "".join(chars)

    def refill(self, text: str, digits: str) -> str:
        new = iter(digits)
        return "".join(next(new) if c.isdigit() else c for c in text)

    # Each takes the text of a candidate and returns its pseudonym, or None where the value isn't valid.

    def card(self, text: str, back: bool = False) -> str | None:
        digits = re.sub(r"\D", "", text)
        if luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        new = digits[0] + self.characters(f"card{digits[0]}", digits[1:-1], back)
        return self.refill(text, new + luhn_digit(new))

    def phone(self, text: str, back: bool = False) -> str | None:
        code = re.match(r"\+\d{1,3}(?=[ .(-])|\+1|\+", text)
        head = code[0] if code else ""
        digits = re.sub(r"\D", "", text[len(head):])
        if not 6 <= len(digits) <= 14:
            return None
        if head in ("", "+1") and len(digits) == 10 and digits[0] > "1" and digits[3] > "1":  # area and exchange begin with 2 to 9
            new = self.mixed("phone10", [int(digits[0]) - 2, int(digits[1:3]), int(digits[3]) - 2, int(digits[4:])], [8, 100, 8, 10**6], back)
            new = f"{new[0] + 2}{new[1]:02d}{new[2] + 2}{new[3]:06d}"
        else:
            new = self.characters(f"phone{head}", digits, back)
        return head + self.refill(text[len(head):], new)

    def ssn(self, text: str, back: bool = False) -> str | None:
        area, group, serial = map(int, text.split("-"))
        if area in (0, 666) or area > 899 or not group or not serial:
            return None
        a, g, s = self.mixed("ssn", [area - 1 - (area > 666), group - 1, serial - 1], [898, 99, 9999], back)
        return f"{a + 1 + (a + 1 > 665):03d}-{g + 1:02d}-{s + 1:04d}"

    def ip(self, text: str, back: bool = False) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or p != str(int(p)) for p in parts):
            return None
        return ".".join(map(str, self.mixed("ip", [int(p) for p in parts], [256] * 4, back)))

    def date(self, text: str, back: bool = False) -> str | None:
        parts = re.split(r"\D", text)
        year, month, day = map(int, parts if len(parts[0]) == 4 else parts[::-1])
        american = len(parts[0]) < 4 and month > 12 >= day and "/" in text
        try:
            old = datetime.date(year, *((day, month) if american else (month, day))).toordinal() - FIRST_DAY
        except ValueError:
            return None
        if not 0 <= old < DAYS:
            return None
        new = None
        while new is None or american and new.day <= 12:  # month before day only shows with a day above 12
            old = self.network.permute("date-us" if american else "date", old, DAYS, back)
            new = datetime.date.fromordinal(FIRST_DAY + old)
        if len(parts[0]) == 4:
            return new.isoformat()
        first, second = (new.month, new.day) if american else (new.day, new.month)
        sep = re.search(r"\D", text)[0]
        wide = "02d" if len(parts[0]) == len(parts[1]) == 2 else "d"
        return f"{first:{wide}}{sep}{second:{wide}}{sep}{new.year}"

    def iban(self, text: str, back: bool = False) -> str | None:
        plain = text.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_number(plain) % 97 != 1:
            return None
        rest = self.characters(f"iban{plain[:2]}", plain[4:], back)
        check = 98 - iban_number(plain[:2] + "00" + rest) % 97
        new = iter(f"{plain[:2]}{check:02d}{rest}")
        return "".join(c if c == " " else next(new) for c in text)

    def email(self, name: str, host: str, back: bool = False) -> str:
        return self.characters(f"email{host}", name, back) + host

    def rewrite(self, text: str, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) of each in the old text."""
        found = []
        if "@" in text:
            found += [("email", m.start(), m.end(), self.email(m[1], m[2], back)) for m in EMAIL.finditer(text)]
        starts, ends = [a for _, a, _, _ in found], [b for _, _, b, _ in found]  # in order, none in another
        at = 0
        while m := NUMBERS.search(text, at):
            at = m.start() + 1
            k = bisect_left(starts, m.end())  # addresses that begin before the number ends; the last of them ends last
            if k and m.start() < ends[k - 1]:
                continue
            for kind, pattern in COMPILED.items():  # a value that fails one kind's test may be another's
                own = pattern.match(text, m.start())
                if own and (new := getattr(self, kind)(own[0], back)) is not None:
                    found.append((kind, own.start(), own.end(), new))
                    at = own.end()
                    break
        found.sort(key=lambda x: x[1])
        parts, end = [], 0
        for _, a, b, new in found:
            parts += [text[end:a], new]
            end = b
        return "".join([*parts, text[end:]]), [(kind, a, b) for kind, a, b, _ in found]


COMPILED = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}
SOME = re.compile(r"[0-9@]")


def pseudonymise(docs: DataFrame, key: str, back: bool = False) -> DataFrame:
    """Per document: doc_id, text with pseudonyms, and replaced (kind, start and end in the old text, in characters).

    Kinds: card (Luhn), iban (mod 97), phone, ssn, ip, date (a day of 1900 to 2099) and email; what fails its test stays as
    it is. A null text stays null with nothing replaced; repeated rows and null ids are rewritten like any other. ``back``
    restores the old values from a rewritten text and the same key.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    secret = key.encode()

    def convert(batches):
        names = Pseudonyms(secret)
        for batch in batches:
            texts, spans = [], []
            for text in batch["text"].to_pylist():
                new, found = names.rewrite(text, back) if text and SOME.search(text) else (text, [])
                texts.append(new)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(texts, pa.string()), pa.array(spans, pa.list_(span))], ["doc_id", "text", "replaced"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return rows.mapInArrow(convert, "doc_id long, text string, replaced array<struct<kind:string,start:int,end:int>>")
