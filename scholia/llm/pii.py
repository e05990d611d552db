"""Format-preserving pseudonyms for personal data: a keyed Feistel permutation within each value's format.

A value is found by pattern and validated (Luhn, IBAN and calendar checks, octets, number ranges); what fails
stays as it is. A valid value is numbered within its format, the number is permuted by a Feistel network under
the key, walking on until it is valid again, and written back with the separators and letter case of the
original. Equal values have equal pseudonyms whatever their separators, in every document, so records stay
linked; with the key, reveal() undoes it.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import re
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame

from scholia.llm.common import in_arrow, keyed_texts

KINDS = ("email", "iban", "date", "ipv4", "ssn", "phone", "card")
ROUNDS = 8
_FIRST, _DAYS = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal() - dt.date(1900, 1, 1).toordinal()

_PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<date>(?<![\w/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}[/.]\d{1,2}[/.]\d{4})(?![\w/-]))"
    r"|(?P<ipv4>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?\d{2,4}[ .-]?\d{3,4}|\d{2,4}(?:[ .-]?\d{2,4}){1,3})(?!\w|\.\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w))"
    r"|(?P<card>(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w))"
)
# What every alternative holds: an e-mail its @, an IBAN its head, all others digits with at most a separator and a bracket between them.
_MAYBE = re.compile(r"@|[A-Z]{2}\d{2}|\d[ .()/-]{0,3}\d")


class Feistel:
    """A permutation of range(n) for any n, keyed by (key, tweak)."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n, self.left = n, isqrt(max(0, n - 1)) + 1
        self.right = -(-n // self.left)
        self.key, self.tweak = hashlib.blake2b(key).digest()[:32], tweak.encode()

    def _round(self, number: int, value: int, modulus: int) -> int:
        h = hashlib.blake2b(b"%s|%d|%d" % (self.tweak, number, value), key=self.key, digest_size=16).digest()
        return int.from_bytes(h, "big") % modulus

    def step(self, x: int, back: bool = False) -> int:
        a, b = divmod(x, self.right)
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if r % 2:
                b = (b + (-1 if back else 1) * self._round(r, a, self.right)) % self.right
            else:
                a = (a + (-1 if back else 1) * self._round(r, b, self.left)) % self.left
        return a * self.right + b

    def walk(self, x: int, valid, back: bool = False) -> int:
        """The next valid number on x's cycle: a permutation of the valid numbers below n."""
        x = self.step(x, back)
        while x >= self.n or not valid(x):
            x = self.step(x, back)
        return x


#: The country codes of two digits; 1 and 7 have one digit, all others three.
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def country_code(digits: str) -> str:
    """The country code that an international number begins with; no code is the start of another."""
    return digits[: 1 if digits[0] in "17" else 2 if digits[:2] in TWO_DIGITS else 3]


def luhn_digit(payload: str) -> str:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _by_class(text: str) -> tuple[int, int]:
    """(number, count) of a text among those of its shape: digits, lower- and upper-case letters by place."""
    x = n = None
    x, n = 0, 1
    for c in text:
        base, low = (10, "0") if "0" <= c <= "9" else (26, "a") if "a" <= c <= "z" else (26, "A") if "A" <= c <= "Z" else (1, c)
        x, n = x * base + ord(c) - ord(low), n * base
    return x, n


def _to_class(shape: str, x: int) -> str:
    out = []
    for c in reversed(shape):
        base, low = (10, "0") if "0" <= c <= "9" else (26, "a") if "a" <= c <= "z" else (26, "A") if "A" <= c <= "Z" else (1, c)
        x, r = divmod(x, base)
        out.append(chr(ord(low) + r))
    return "".join(reversed(out))


def _yes(x: int) -> bool:
    return True


def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value (or with back, the value of a pseudonym); None if the value isn't valid."""
    digits = "".join(c for c in value if c.isdigit())
    if kind == "card":
        if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1] or len(set(digits)) == 1:
            return None
        size = len(digits) - 1
        ok = lambda x: len(set((p := f"{x:0{size}d}") + luhn_digit(p))) > 1
        payload = f"{Feistel(key, f'card{size}', 10**size).walk(int(digits[:-1]), ok, back):0{size}d}"
        return _refill(value, payload + luhn_digit(payload))
    if kind == "iban":
        flat = value.replace(" ", "")
        if not 15 <= len(flat) <= 34 or _mod97(flat[4:] + flat[:4]) != 1:
            return None
        x, n = _by_class(flat[4:])
        body = _to_class(flat[4:], Feistel(key, f"iban{flat[:2]}{re.sub('[0-9]', '0', re.sub('[A-Z]', 'A', flat[4:]))}", n).walk(x, _yes, back))
        out = iter(flat[:2] + f"{98 - _mod97(body + flat[:2] + '00'):02d}" + body)
        return "".join(c if c == " " else next(out) for c in value)
    if kind == "date":
        iso = value[4:5] == "-"
        numbers = [int(x) for x in re.split(r"[-/.]", value)]
        y, m, d = numbers if iso else (numbers[2], numbers[1], numbers[0])
        american = not iso and m > 12 >= d
        if american:
            m, d = d, m
        try:
            day = dt.date(y, m, d).toordinal() - _FIRST
        except ValueError:
            return None
        if not 0 <= day < _DAYS:
            return None
        # one permutation for every way of writing: days after the twelfth, which alone can be read as month/day, stay such
        late = d > 12
        clear = lambda x: (dt.date.fromordinal(x + _FIRST).day > 12) == late
        new = dt.date.fromordinal(Feistel(key, "date", _DAYS).walk(day, clear, back) + _FIRST)
        if iso:
            return new.isoformat()
        sep = value[1] if not value[1].isdigit() else value[2]
        one, two = (new.month, new.day) if american else (new.day, new.month)
        wide = 2 if re.match(r"\d\d\D\d\d\D", value) else 0
        return f"{one:0{wide}d}{sep}{two:0{wide}d}{sep}{new.year}" if wide else f"{one}{sep}{two}{sep}{new.year}"
    if kind == "ipv4":
        octets = value.split(".")
        if any(int(o) > 255 or o != str(int(o)) for o in octets):
            return None
        x = Feistel(key, "ipv4", 1 << 32).walk(int.from_bytes(bytes(map(int, octets)), "big"), _yes, back)
        return ".".join(map(str, x.to_bytes(4, "big")))
    if kind == "ssn":
        ok = lambda x: (s := f"{x:09d}")[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
        if not ok(int(digits)):
            return None
        return _refill(value, f"{Feistel(key, 'ssn', 10**9).walk(int(digits), ok, back):09d}")
    if kind == "phone":
        code = country_code(digits) if value[0] == "+" else ""  # it stays, set off or not
        rest = digits[len(code) :]
        if not 7 <= len(digits) <= 15 or len(rest) < 5:
            return None
        return _refill(value, code + f"{Feistel(key, f'phone{len(rest)}', 10 ** len(rest)).walk(int(rest), _yes, back):0{len(rest)}d}")
    local, _, domain = value.partition("@")
    x, n = _by_class(local)
    shape = re.sub("[0-9]", "0", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", local)))
    return _to_class(local, Feistel(key, f"email{shape}@{domain.lower()}", n).walk(x, _yes, back)) + "@" + domain


def replace(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """(new text, spans): spans (kind, start, end) are code points of the old text; ends are exclusive."""
    if not _MAYBE.search(text):
        return text, []
    out, spans, last, at = [], [], 0, 0
    while m := _PATTERN.search(text, at):
        new = pseudonym(m.lastgroup, m[0], key, back)
        if new is None:
            at = m.start() + 1  # what fails may still hold a valid value
            continue
        out += [text[last : m.start()], new]
        last = at = m.end()
        spans.append((m.lastgroup, m.start(), m.end()))
    return "".join(out) + text[last:], spans


def pseudonymise(docs: DataFrame, key: bytes, *, id_col="doc_id", text_col="text", back: bool = False) -> DataFrame:
    """(doc_id, text, n_found, spans, and n_<kind> for each of KINDS): a row for each row of docs; spans is
    kind:start:end by start, comma-joined. Null texts become empty, null ids are carried, repeated rows are
    treated alike. A value cut by the text's end is judged as it stands."""
    names = ["doc_id", "text", "n_found", "spans", *[f"n_{k}" for k in KINDS]]

    def run(batches):
        for b in batches:
            done = [replace(t, key, back) for t in b.column(1).to_pylist()]
            columns = [b.column(0), pa.array([t for t, _ in done], pa.string()), pa.array([len(s) for _, s in done], pa.int64()),
                       pa.array([",".join(f"{k}:{i}:{j}" for k, i, j in s) for _, s in done], pa.string())]
            columns += [pa.array([sum(x[0] == k for x in s) for _, s in done], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays(columns, names)

    return in_arrow(keyed_texts(docs, id_col, text_col), run, "doc_id long, text string, n_found long, spans string, " + ", ".join(f"n_{k} long" for k in KINDS))


def reveal(docs: DataFrame, key: bytes, *, id_col="doc_id", text_col="text") -> DataFrame:
    """pseudonymise() undone, for whoever has the key."""
    return pseudonymise(docs, key, id_col=id_col, text_col=text_col, back=True)
