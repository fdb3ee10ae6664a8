"""Validators as Columns: checksums, id rules, ICAO check digits, entropy, softmax."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import digits_only


def _chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def luhn(text: Column) -> Column:
    d = digits_only(text)
    return (F.length(d) >= 12) & F.coalesce(F.call_function("luhn_check", d), F.lit(False))


def card(text: Column) -> Column:
    d = digits_only(text)
    return F.length(d).between(13, 19) & d.rlike("^[2-6]") & luhn(text)


def iban(text: Column) -> Column:
    """ISO 13616: shape, then the rearranged number modulo 97, digit by digit."""
    s = F.upper(F.regexp_replace(text, r"\s", ""))
    turned = F.concat(F.substring(s, 5, 64), F.substring(s, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(_chars(turned), F.lit(0), lambda r, c: ((r * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97).cast("int"))
    return F.when(s.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), rest == 1).otherwise(False)


def ssn(text: Column) -> Column:
    d = digits_only(text)
    area, group, serial = F.substring(d, 1, 3), F.substring(d, 4, 2), F.substring(d, 6, 4)
    blocked = d.isin("123456789", "078051120", "219099999")
    return (F.length(d) == 9) & ~area.isin("000", "666") & ~area.startswith("9") & (group != "00") & (serial != "0000") & ~blocked


def national_id(text: Column) -> Column:
    """Ten digits, not all equal; weights 10 to 2, modulo 11."""
    d = digits_only(text)
    digit = lambda i: F.ascii(F.substring(d, i, 1)) - 48
    rest = sum((digit(i) * (11 - i) for i in range(1, 10)), F.lit(0)) % 11
    return (F.length(d) == 10) & ~d.rlike(r"^(\d)\1{9}$") & (digit(10) == F.when(rest < 2, rest).otherwise(11 - rest))


def entropy(text: Column) -> Column:
    """Shannon entropy, bits a character; 0 for an empty text."""
    c, n = _chars(text), F.length(text)
    share = lambda x: (n - F.length(F.replace(text, x, F.lit("")))) / n
    return F.when(n > 0, F.aggregate(F.array_distinct(c), F.lit(0.0), lambda s, x: s - share(x) * F.log2(share(x)))).otherwise(0.0)


def ipv4(text: Column) -> Column:
    parts = F.split(text, r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: p.rlike("^(0|[1-9][0-9]{0,2})$") & (F.coalesce(F.try_to_number(p, F.lit("999")), F.lit(999)) <= 255)) & ~text.startswith("0.")


def ipv6(text: Column) -> Column:
    """Eight groups, or fewer around one double colon; no colon alone at an end."""
    parts = F.split(text, ":", -1)
    full = F.size(F.filter(parts, lambda p: p != ""))
    short = text.contains("::") & ~text.rlike(":::|::.*::|^:[^:]|[^:]:$") & full.between(1, 7)
    return short | (~text.contains("::") & (F.size(parts) == 8) & (full == 8))


def plausible_phone(text: Column) -> Column:
    """Written internationally, with separators, or with eleven digits; no IPv4 address."""
    t = F.trim(text)
    return (t != "") & ~ipv4(t) & (t.startswith("+") | F.substring(t, 2, 1 << 20).rlike(r"[ ()./-]") | (F.length(digits_only(t)) >= 11))


def icao_digit(field: Column) -> Column:
    """ICAO 9303 check digit with weights 7, 3, 1; an empty string where a character is not allowed."""
    c = _chars(F.upper(field))
    value = lambda x: F.when(x.between("0", "9"), F.ascii(x) - 48).when(x.between("A", "Z"), F.ascii(x) - 55).otherwise(0)
    weighed = F.transform(c, lambda x, i: value(x) * F.element_at(F.array(F.lit(7), F.lit(3), F.lit(1)), (i % 3 + 1).cast("int")))
    total = F.aggregate(weighed, F.lit(0), lambda s, x: s + x)
    return F.when(field.rlike("^[0-9A-Za-z<]*$"), (total % 10).cast("string")).otherwise("")


def mrz_valid(line: Column) -> Column:
    """Check digits of a data line of 44 or 36 characters with the composite; null for lines of other shapes."""

    def agree(*fields: tuple[list[tuple[int, int]], int]) -> Column:
        out = F.lit(True)
        for spans, at in fields:
            field = F.concat(*(F.substring(line, a + 1, b - a) for a, b in spans))
            got = F.substring(line, at + 1, 1)
            want = icao_digit(field)
            # an optional field of fillers may leave its digit as a filler
            out = out & ((got == want) | ((got == "<") & (F.replace(field, F.lit("<"), F.lit("")) == "")))
        return out

    long = agree(([(0, 9)], 9), ([(13, 19)], 19), ([(21, 27)], 27), ([(28, 42)], 42), ([(0, 10), (13, 20), (21, 43)], 43))
    short = agree(([(0, 9)], 9), ([(13, 19)], 19), ([(21, 27)], 27), ([(0, 10), (13, 20), (21, 28)], 35))
    data = line.rlike("[0-9]") & ~line.rlike("^[PIVCA][A-Z<]{4}[A-Z<]*$")
    return F.when(~data, F.lit(None).cast("boolean")).when(F.length(line) == 44, long).when(F.length(line) == 36, short)


def softmax(logits: list[Column], temperature: float) -> list[Column]:
    top = F.greatest(*logits) if len(logits) > 1 else logits[0]
    e = [F.exp((z - top) / temperature) for z in logits]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


def plate_lenient(text: Column) -> Column:
    s = F.regexp_replace(text, r"[^\p{L}\p{Nd}]", "")
    upper = s == F.upper(s)
    return (F.trim(text) == "") | (F.length(s).between(2, 14) & (s.rlike(r"\p{Nd}") | (upper & (s.rlike("[ILO10]") | F.length(s).between(3, 8)))))


def plate_strict(text: Column) -> Column:
    s = F.regexp_replace(text, r"[^\p{L}\p{Nd}]", "")
    return F.length(s).between(2, 12) & s.rlike(r"\p{Nd}") & (F.length(F.regexp_replace(s, r"[^\p{Ll}]", "")) <= 1)
