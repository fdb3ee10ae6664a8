"""Text normalisation as Columns: digit folds, OCR repairs, keys, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Persian and Arabic-Indic digits, in order, and the ASCII digits that they fold to.
EASTERN = "۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩"
ASCII = "01234567890123456789"
#: What OCR reads for a digit between digits.
CONFUSED = {"0": "OoDQ", "1": "Il|i", "2": "Zz", "5": "Ss", "8": "B", "6": "Gb"}
#: The same in the year of a date.
YEAR = {"1": "Il|", "0": "Oo", "5": "Ss", "2": "Zz", "8": "B"}
MONTHS = "JAN FEB FEV FÉV MAR APR AVR MAY MAI JUN JUI JUL AUG AOU SEP OCT OKT NOV DEC DEZ DIC ENE ABR AGO".split()


def fold_digits(text: Column) -> Column:
    return F.when(text.rlike(f"[{EASTERN}]"), F.translate(text, EASTERN, ASCII)).otherwise(text)


def numeric_view(text: Column) -> Column:
    """Confused letters between digits (one separator allowed) become digits; lengths stay."""
    out = text
    for digit, letters in CONFUSED.items():
        c = "".join("\\|" if x == "|" else x for x in letters)
        out = F.regexp_replace(out, rf"(?<=\d[ \-./()]{{0,1}})[{c}](?=[ \-./()]?\d)", digit)
    # where no such letter follows a digit, nothing changes
    return F.when(text.rlike(rf"\d[ \-./()]?[{''.join(CONFUSED.values())}]"), out).otherwise(text)


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def text_key(text: Column) -> Column:
    """Lower-case letters and digits."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def cross_key(text: Column) -> Column:
    """Upper-case letters and digits, eastern digits folded."""
    return F.regexp_replace(F.upper(fold_digits(text)), "[^0-9A-Z]", "")


def strip_accents(text: Column) -> Column:
    """Latin letters without their marks (precomposed letters of Latin-1 and Latin Extended-A, and loose marks)."""
    marked = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćĈĉĊċČčĎďĒēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥĨĩĪīĬĭĮįİĴĵĶķĹĺĻļĽľŃńŅņŇňŌōŎŏŐőŔŕŖŗŘřŚśŜŝŞşŠšŢţŤťŨũŪūŬŭŮůŰűŲųŴŵŶŷŸŹźŻżŽž"
    plain = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcCcCcDdEeEeEeEeEeGgGgGgGgHhIiIiIiIiIJjKkLlLlLlNnNnNnOoOoOoRrRrRrSsSsSsSsTtTtUuUuUuUuUuUuWwYyYZzZzZz"
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.translate(text, marked, plain), r"\p{M}", "")).otherwise(text)


def fold_word(text: Column) -> Column:
    return F.lower(strip_accents(text))


def mrz_repair(text: Column) -> Column:
    """Brackets and runs of K, L, C that stand for fillers become fillers."""
    text = F.translate(text, "()[]{}«»‹›", "<<<<<<<<<<")
    return F.regexp_replace(text, r"(?<=K)K|K(?=K)|(?<=L)L|L(?=L)|(?<=C)C|C(?=C)|(?<=<|KK|LL|CC)[KLC](?=<)", "<")


def mrz_compact(line: Column) -> Column:
    return mrz_repair(F.upper(F.regexp_replace(line, r"\s+", "")))


def repair_year(text: Column) -> Column:
    """`14 JAN /JAN I3`: letters in the trailing year become digits where all month tokens are months."""
    months = "|".join(MONTHS)
    pattern = rf"(?i)^(\s*\d{{1,2}}\s*(?:{months})[A-Z]*\s*(?:/?\s*(?:{months})[A-Z]*)?\s+)([0-9IlOoSsZzB|]{{2}}|[0-9IlOoSsZzB|]{{4}})\s*$"
    frm = "".join(YEAR.values())
    to = "".join(d * len(x) for d, x in YEAR.items())
    return F.when(text.rlike(pattern), F.concat(F.regexp_extract(text, pattern, 1), F.translate(F.regexp_extract(text, pattern, 2), frm, to))).otherwise(text)


def fingerprint(value: Column, salt: str, length: int = 10) -> Column:
    """The first hex digits of the salted SHA-256; null for null or empty values."""
    return F.when(F.length(value) > 0, F.substring(F.sha2(F.concat(F.lit(salt + "|"), value), 256), 1, length))
