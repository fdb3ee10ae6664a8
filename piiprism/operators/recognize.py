"""Recognizers as data: pattern, view, guard, entity, score. Each turns a text column into an array of spans.

A span is struct<start int, end int, entity string, score double, source string>, half-open, in code points of the
text. Everything stays in the row of its document, so no recognizer shuffles, and all of them work on streams.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks, text
from ..functions.vocabulary import CLOSINGS, ID_LABELS, NAME_LABELS, PERSON_LABELS, SECRET_LABELS, STATES, STREETS
from . import lines

SPAN = "array<struct<start:int,end:int,entity:string,score:double,source:string>>"


@dataclass(frozen=True)
class Rule:
    """prefix is context before the value; the span is the value alone."""

    name: str
    entity: str
    pattern: str
    score: float
    source: str = "pattern"
    view: str = "text"  # or "numeric"
    prefix: str = ""
    guard: Callable[[Column], Column] | None = None
    #: Cheap necessary conditions, tried before the pattern: one of these in the text; one of these words in any case; digits.
    hint: str | tuple[str, ...] = ()
    words: tuple[str, ...] = ()
    digits: int = 0
    #: A short pattern of what every match holds, in the rule's view.
    needs: str = ""
    #: What of the value is kept; its head.
    head: Callable[[Column], Column] | None = None


_DATE = r"\d{1,2}[-/. ](?:\d{1,2}|[A-Za-z]{3,9})[-/., ]+\d{2,4}|[A-Za-z]{3,9}\.? \d{1,2},? \d{4}|\d{4}[-/.]\d{1,2}[-/.]\d{1,2}"
#: A name: up to three words of a capital and small letters, which an apostrophe or a hyphen may join; initials between them.
_NAME = rf"{lines.NAME}(?:[ \t]+(?:\p{{Lu}}\.[ \t]+)?{lines.NAME}){{0,2}}"
_ANY_DATE = r"\d{1,2}[/.-]\d{1,2}[/.-]\d{4}|\d{4}[/.-]\d{1,2}[/.-]\d{1,2}"


def labels(words: Iterable[str], blank: str) -> str:
    """An alternative of labels, the longest first."""
    return "|".join(w.replace(" ", blank) for w in sorted(words, key=len, reverse=True))


_MONTHS = tuple("jan feb fev mar apr avr may mai jun jui jul aug aou sep oct okt nov dec dez dic ene abr ago".split())
_MONTH = rf"(?:{'|'.join(_MONTHS)})[a-zéû]*"

#: The end of a number with an area code.
SEVEN = r"\p{Nd}{3}[-. \t]?\p{Nd}{4}"

RULES = [
    Rule("email", "EMAIL", r"(?<![\w.+-])[A-Za-z0-9._%+-]+ ?@ ?[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?!\w)", 0.95, hint="@"),
    # any run that holds a sign between letters or digits: readers lose or misread the points of a domain
    Rule("email_lenient", "EMAIL", r"(?<![\w.%+-])(?:\p{Alnum}[\w.%+-]*)@(?:\p{Alnum}+[.,-]*)*\p{Alnum}+", 0.80, hint="@", guard=lambda v: F.substring_index(v, "@", -1).rlike("(?=.*\\p{Alpha}).{4,}")),
    Rule("url", "URL", r"(?i)\b(?:https?://|www\.)[^\s<>\"']+", 0.60, words=("://", "www.")),
    Rule("card", "CREDIT_CARD", r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)", 0.95, view="numeric", guard=checks.card, digits=13),
    Rule("iban", "IBAN", r"\b\p{Alpha}{2}\d{2}(?:[ \t]?\p{Alnum}{4}){2,7}(?:[ \t]?\p{Alnum}{1,3})?\b", 0.95, guard=checks.iban, digits=2),
    Rule("ssn", "SSN", r"(?<!\d)\d{3}[- ]\d{2}[- ]\d{4}(?!\d)", 0.85, view="numeric", guard=checks.ssn, digits=9),
    Rule("ssn_label", "SSN", r"\d{3}[- ]?\d{2}[- ]?\d{4}(?!\d)", 0.90, view="numeric", prefix=r"(?i)(?:ssn|social security)[^\d\n]{0,12}", words=("ssn", "social security"), digits=9),
    # ten digits with an area code that begins with 2 to 9, perhaps after 1, perhaps with an extension
    Rule("phone_us", "PHONE", r"(?<![\w+])(?:\+?1[-. \t]?)?(?:[2-9]\d\d|\([2-9]\d\d\))(?:[-. \t]?\d{3}){1}[-. \t]?\d{4}(?:[ \t]*(?i:ext\.?|x)[ \t]*\d{1,5})?(?!\w)", 0.85, view="numeric", digits=10, needs=SEVEN),
    # three, three and four digits, set apart by brackets or by one sign throughout
    Rule("phone_334", "PHONE", r"(?<!\w)(?:\d{3}(?<sign>[-.])\d{3}\k<sign>|\(\d{3}\)[-. \t]?\d{3}[-. \t])\d{4}(?![\w-])", 0.85, view="numeric", digits=10, needs=SEVEN),
    Rule("phone_plus", "PHONE", r"(?<!\w)\+\d{1,3}[ \-.()]*\d(?:[ \-.()]{0,2}\d){5,13}(?!\d)", 0.80, view="numeric", hint="+", guard=lambda v: F.length(text.digits_only(v)).between(8, 15), digits=7),
    Rule("ipv4", "IP_ADDRESS", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)", 0.80, view="numeric", hint=".", guard=checks.ipv4, digits=4),
    Rule("ipv6", "IP_ADDRESS", r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])", 0.80, hint=":", guard=checks.ipv6),
    Rule("national_id", "ID_NUMBER", r"(?<!\d)\d{10}(?!\d)", 0.95, view="numeric", guard=checks.national_id, digits=10),
    Rule("mobile_ir", "PHONE", r"(?<!\d)(?:\+98|0098|0)9\d{9}(?!\d)", 0.90, view="numeric", digits=11, needs=r"9\p{Nd}{9}"),
    Rule("jalali", "DATE_OF_BIRTH", r"(?<!\d)1[34]\d{2}[/.-]\d{1,2}[/.-]\d{1,2}(?!\d)", 0.85, digits=6),
    Rule("birth", "DATE_OF_BIRTH", rf"(?:{_DATE})", 0.85, prefix=r"(?i)(?:date of birth|birth ?date|\bdob\b|\bborn\b|date de naissance|fecha de nacimiento|geburtsdatum|تاریخ تولد)[^\d\n]{0,30}?", words=("birth", "dob", "born", "naissance", "nacimiento", "geburtsdatum"), digits=3),
    Rule("date_words", "DATE", rf"(?i)(?<!\w)\d{{1,2}}(?:st|nd|rd|th)?[ .-]{{1,2}}{_MONTH}(?: */ *{_MONTH})?[ .,-]{{1,3}}(?:\d{{4}}|\d{{2}})(?!\w)", 0.75, words=_MONTHS, digits=3),
    Rule("date_month_first", "DATE", rf"(?i)(?<!\w){_MONTH}\.? \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}}(?!\w)", 0.75, words=_MONTHS, digits=5),
    Rule("date_iso", "DATE", r"(?<![\d/.-])\d{4}[-/.]\d{1,2}[-/.]\d{1,2}(?![\d/-])", 0.75, digits=6),
    Rule("date_numeric", "DATE", r"(?<![\d/.-])\d{1,2}[-/.]\d{1,2}[-/.]\d{4}(?![\d/-])", 0.75, digits=6),
    Rule("street", "ADDRESS", rf"\b\d{{1,6}}\p{{Alpha}}?[ \t]+(?:[NSEW]\.?[ \t]+)?(?:[\p{{Upper}}\d][\w'.-]*[ \t]+){{0,4}}?(?:{labels(STREETS, ' ')})\b\.?(?:,?[ \t]*(?:Apartment|Apt|Suite|Ste|Unit|Floor|Fl|#)\.?[ \t]*#?[\w-]+)?", 0.80, digits=1),
    Rule("city_zip", "ADDRESS", rf"\b\p{{Upper}}[\p{{Alpha}}.'-]+(?:[ \t]+\p{{Upper}}[\p{{Alpha}}.'-]+){{0,3}},[ \t]*(?:{labels(STATES, ' ')})[ \t]+\d{{5}}(?:-\d{{4}})?\b", 0.80, hint=",", digits=5),
    Rule("po_box", "ADDRESS", r"(?i)\bP\.? ?O\.? ?Box \d+\b", 0.80, words=("box",), digits=1),
    Rule("postcode_uk", "ADDRESS", r"\b[A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2}\b", 0.65, digits=2),
    Rule("aws_key", "SECRET", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", 0.95, hint=("AKIA", "ASIA")),
    Rule("github_token", "SECRET", r"\bgh[pousr]_[A-Za-z0-9]{30,}\b", 0.95, hint="gh"),
    # The forms of keys, as their makers document them.
    Rule("slack_token", "SECRET", r"\bxox[abprs]-[\p{Alnum}-]{10,}", 0.95, hint="xox"),
    Rule("google_key", "SECRET", r"\bAIza[\w-]{35}", 0.95, hint="AIza"),
    Rule("stripe_key", "SECRET", r"\b[sr]k_(?:live|test)_[0-9A-Za-z]{16,}", 0.95, hint="k_"),
    Rule("jwt", "SECRET", r"\beyJ[\w-]{8,}\.[\w-]{8,}\.[\w-]{8,}", 0.95, hint="eyJ"),
    Rule("sk_key", "SECRET", r"\bsk-[A-Za-z0-9_-]{20,}", 0.95, hint="sk-"),
    # a run of 24 characters of base64 alphabets, with letters of both cases and digits, that looks random
    Rule("entropy_token", "SECRET", r"(?<![\w+/=-])[\w+/-]{24,}=?=?(?![\w+/=-])", 0.70, guard=lambda v: v.rlike(r"^[A-Za-z0-9_+/=-]+$") & v.rlike("\\p{Lower}") & v.rlike("\\p{Upper}") & v.rlike("\\d") & (checks.entropy(v) >= 4.0)),
    Rule("secret_label", "SECRET", r"\S{3,}", 0.85, "context", prefix=rf"(?i:\b(?:{labels(SECRET_LABELS, '[ \\t_-]?')})\b)[ \t\n]*[:=#][ \t\n]*", hint=(":", "=", "#"), words=tuple(w.split()[0] for w in SECRET_LABELS)),
    # a label, perhaps a word for number, perhaps a sign, and a code with three digits
    Rule("id_label", "ID_NUMBER", r"\p{Alnum}[\p{Alnum}/.-]{3,}\p{Alnum}", 0.80, "context", view="numeric", prefix=rf"(?i:\b(?:{labels(ID_LABELS, '[ \\t]+')})\b)[ \t\n]*(?i:#|id|code|(?:number|num|no)\.?)?[ \t\n]*[:#=-]?[ \t\n]*", guard=lambda v: F.length(text.digits_only(v)) >= 3, digits=3),
    # eight digits or more with at most one sign between two of them, but dates and addresses of hosts
    Rule("long_number", "ID_NUMBER", r"(?<!\w)(?:\d[ \t./-]?){7,}\d(?!\w)", 0.70, view="numeric", guard=lambda v: ~v.rlike(rf"^(?:{_ANY_DATE}|\d{{1,3}}(?:\.\d{{1,3}}){{3}})$"), digits=8),
    Rule("coded_id", "ID_NUMBER", r"\b(?:[A-Z]{1,3}\d{5,9}|\d{5,9}[A-Z]{1,3})\b", 0.75, digits=5),
    Rule("salutation", "PERSON", _NAME, 0.85, "context", prefix=r"\b(?:Dear|Attn\.?|Attention:?)[ \t]+(?:(?:Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Sir|Madam)\.?[ \t]+)?", guard=lines.plausible_name, head=lines.name_head, hint=("Dear", "Attn", "Attention")),
    Rule("titled_name", "PERSON", _NAME, 0.85, "context", prefix=r"\b(?:Mr|Mrs|Ms|Mx|Dr|Prof)\.?[ \t]+", guard=lines.plausible_name, head=lines.name_head, hint=("Mr", "Ms", "Mx", "Dr", "Prof")),
    Rule("closing", "PERSON", rf"{_NAME}(?=[ \t]*(?:\n|$))", 0.85, "context", prefix=rf"(?i:(?:^|\n)[ \t]*(?:{labels(CLOSINGS, '[ \\t]+')}))[ \t]*,?[ \t]*\n[ \t]*", guard=lines.plausible_name, head=lines.name_head, hint="\n", words=tuple(w.split()[0] for w in CLOSINGS)),
    Rule("name_label", "PERSON", _NAME, 0.85, "context", prefix=rf"(?i:\b(?:{labels(PERSON_LABELS, '[ \\t]+')}))[ \t]*[:-][ \t]*", guard=lines.plausible_name, head=lines.name_head, hint=(":", "-"), words=tuple(w.split()[0] for w in PERSON_LABELS)),
    Rule("name_field", "PERSON", r"\p{L}+(?:[ \t]+\p{L}+)*", 0.80, "context", prefix=rf"(?i:\b(?:{labels(NAME_LABELS, '[ \\t]+')})\b)[ \t]*[:=][ \t]*", guard=lines.name_shape, hint=(":", "="), words=tuple(w.split()[0] for w in NAME_LABELS)),
]
BY_NAME = {r.name: r for r in RULES}


def _spans(views: Column, rule: Rule) -> Column:
    """The rule's spans; offsets come from the running length of what lies between the matches."""
    view = views[rule.view]
    pattern = f"(?U){rule.prefix}(?:{rule.pattern})"
    whole = F.regexp_extract_all(view, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,value:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + F.length(x["gap"])
        return F.struct((begin + F.length(x["hit"])).alias("at"), F.concat(s["out"], F.array(F.struct(begin.alias("start"), x["hit"].alias("value")))).alias("out"))

    def placed(found: Column) -> Column:
        zipped = F.arrays_zip(F.slice(F.split(view, pattern, -1), 1, F.size(found)).alias("gap"), found.alias("hit"))
        return F.aggregate(zipped, start, step, lambda s: s["out"])

    # most texts have no match: only the others are split
    hits = F.flatten(F.transform(F.filter(F.array(whole), lambda w: F.size(w) > 0), placed))
    if rule.prefix:
        value = f"(?U)^{rule.prefix}(?=(?:{rule.pattern})$)"
        hits = F.transform(hits, lambda h: F.struct((h["start"] + F.length(F.regexp_extract(h["value"], value, 0))).alias("start"), F.regexp_replace(h["value"], value, "").alias("value")))
    if rule.head:
        hits = F.transform(hits, lambda h: F.struct(h["start"].alias("start"), rule.head(h["value"]).alias("value")))
    if rule.guard:
        hits = F.filter(hits, lambda h: F.coalesce(rule.guard(h["value"]), F.lit(False)))
    out = F.transform(
        hits, lambda h: F.struct(h["start"].alias("start"), (h["start"] + F.length(h["value"])).alias("end"), F.lit(rule.entity).alias("entity"), F.lit(rule.score).alias("score"), F.lit(rule.source).alias("source"))
    )
    cheap = views["digits"] if r"\d" in rule.pattern else F.lit(True)
    if rule.digits > 1:
        cheap &= views["n_digits"] >= rule.digits
    hints = (rule.hint,) if isinstance(rule.hint, str) else rule.hint
    if hints:
        cheap &= reduce(Column.__or__, (views["text"].contains(h) for h in hints))
    if rule.words:  # other letters may fold to those of a word
        cheap &= ~views["ascii"] | views["lower"].rlike("|".join(map(re.escape, rule.words)))
    if rule.needs:
        cheap &= view.rlike(rule.needs)
    return F.when(F.coalesce(cheap, F.lit(False)), out).otherwise(F.array().cast(SPAN))


def all_spans(t: Column, names: list[str] | None = None) -> Column:
    """UNION ALL of the rules' spans, in one pass over the row; the views of the text are made once for all rules."""
    rules = [r for r in RULES if names is None or r.name in names]
    numeric = any(r.view == "numeric" for r in rules)
    # one step for each view, so that what is made of another view is not made again
    seen = F.array(text.fold_digits(t))
    seen = F.transform(seen, lambda x: F.struct(x.alias("text"), F.lower(x).alias("lower"), (~x.rlike(r"[^\x00-\x7F]")).alias("ascii"), F.coalesce(x.rlike("[0-9]"), F.lit(False)).alias("digits")))
    seen = F.transform(seen, lambda v: F.struct(v.alias("v"), (F.when(v["digits"], text.numeric_view(v["text"])).otherwise(v["text"]) if numeric else v["text"]).alias("numeric")))
    # the numeric view has the most digits
    count = lambda v: F.when(v["v"]["digits"], F.length(F.regexp_replace(v["numeric"], r"\P{Nd}+", ""))).otherwise(0)
    views = F.transform(seen, lambda v: F.struct(*(v["v"][c].alias(c) for c in ("text", "lower", "ascii", "digits")), v["numeric"].alias("numeric"), count(v).alias("n_digits")))
    return F.element_at(F.transform(views, lambda v: F.concat(*(_spans(v, r) for r in rules))), 1)


def exploded(docs: DataFrame, names: list[str], key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, start, end, entity, score, source, value."""
    hit = docs.select(key, column, F.explode(all_spans(F.col(column), names)).alias("s"))
    return hit.select(key, "s.*", F.substring(column, F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))
