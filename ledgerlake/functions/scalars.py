"""Column functions of the ledger: text keys, calendar arithmetic, money."""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNCATEGORIZED = "Sin categorizar"

# Ordered rules, the first pattern that is found in the description wins.
CATEGORY_RULES = (
    (r"UBER|CABIFY|DIDI|TAXI|PEAJE|GRIFO|PETROPERU|PRIMAX|REPSOL", "Transporte"),
    (r"RESTAURANT|RAPPI|PEDIDOSYA|DELIVERY|CHIFA|POLLERIA", "Restaurantes"),
    (r"PLAZA\s*VEA|WONG|METRO|TOTTUS|VIVANDA|MERCADO|MINIMARKET|SUPERMERCADO", "Alimentacion"),
    (r"AEROLINEA|LATAM|SKY\s*AIRLINE|AVIANCA|JETSMART|HOTEL|HOSTAL|BOOKING|AIRBNB|DESPEGAR|AGENCIA\s*DE\s*VIAJES", "Viajes"),
    (r"GIMNASIO|GYM|SMARTFIT|BODYTECH|CLUB\s*DEPORTIVO|ACADEMIA\s*DE|PADEL|CROSSFIT", "Deporte"),
    (r"NETFLIX|SPOTIFY|DISNEY|HBO|YOUTUBE\s*PREMIUM|PRIME\s*VIDEO|LUZ\s*DEL\s*SUR|SEDAPAL|CALIDDA|CLARO|MOVISTAR|ENTEL|BITEL|INTERNET|COMISION|ITF|MANTENIMIENTO\s*DE\s*CUENTA|PORTES", "Servicios"),
    (r"FARMACIA|BOTICA|CLINICA|HOSPITAL|SEGURO\s*SALUD|EPS", "Salud"),
    (r"UNIVERSIDAD|INSTITUTO|COLEGIO|PENSION\s*ESCOLAR|PLATZI|UDEMY|COURSERA", "Educacion"),
    (r"SUELDO|PLANILLA|HONORARIOS|ABONO\s*DE\s*REMUNERACION", "Ingresos"),
    (r"TRANSFERENCIA|TRANSF\.?\s*A\s*TERCEROS|ENVIO\s*DE\s*DINERO", "Transferencias"),
)


def normalize_description(c: Column) -> Column:
    """Filler runs (two or more of . - _ * #) and white space become one space; trimmed, upper case."""
    spaced = F.regexp_replace(F.regexp_replace(c, r"[.\-_*#]{2,}", " "), r"\s+", " ")
    return F.upper(F.trim(spaced))


def movement_id(*parts: Column) -> Column:
    """md5 over the parts' text, joined by |; nulls are skipped."""
    return F.md5(F.concat_ws("|", *(p.cast("string") for p in parts)))


def month_start(d: Column) -> Column:
    return F.trunc(d, "MM")


def month_index(d: Column) -> Column:
    """Months since year 0: differences count month boundaries."""
    return (F.year(d) * 12 + F.month(d)).cast("long")


def months_between_boundaries(earlier: Column, later: Column) -> Column:
    return month_index(later) - month_index(earlier)


def closed_month(d: Column, as_of: str) -> Column:
    """Before the first day of the month that holds as_of."""
    return d < F.trunc(F.lit(as_of).cast("date"), "MM")


def digit_collapse(c: Column) -> Column:
    return F.regexp_replace(c, r"\d+", "#")


def rule_category(description: Column, rules: Sequence[tuple[str, str]] = CATEGORY_RULES) -> Column:
    out = F.lit(UNCATEGORIZED)
    for pattern, category in reversed(rules):
        out = F.when(description.rlike(pattern), category).otherwise(out)
    return out


def _accented() -> tuple[str, str]:
    """Latin letters that decompose to an ASCII letter and marks, and those letters."""
    plain = {chr(c): unicodedata.normalize("NFKD", chr(c))[:1] for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))}
    pairs = [(c, p) for c, p in plain.items() if c != p and p.isascii() and p.isalpha()]
    return "".join(c for c, _ in pairs), "".join(p for _, p in pairs)


def fold_accents(c: Column) -> Column:
    return F.translate(F.regexp_replace(c, r"\p{M}+", ""), *_accented())


def currency_word(c: Column) -> Column:
    """USD or PEN by a word that begins like its name, its code or its sign, whatever the case and
    accents; null if there is none. USD goes first."""
    plain = F.upper(fold_accents(c))
    return F.when(plain.rlike(r"(?U)(?:^|\s)(?:DOLAR|USD|US\$)"), "USD").when(plain.rlike(r"(?U)(?:^|\s)(?:SOL|PEN|S/)"), "PEN")


def parse_money(c: Column) -> Column:
    """'1,234.56' and '1,234.56-' (negative) as decimal(18,2); null if it is no amount."""
    bare = F.regexp_replace(F.trim(c), ",", "")
    value = F.regexp_extract(bare, r"^(\d*\.?\d+)-?$", 1)
    amount = F.when(value != "", value).try_cast("decimal(18,2)")
    return F.when(bare.endswith("-"), -amount).otherwise(amount).cast("decimal(18,2)")


def quantize_money(c: Column) -> Column:
    """Half-even at two decimals, on the number's decimal digits."""
    return F.bround(c.cast("decimal(38,18)"), 2).cast("decimal(18,2)")


def excess_decimals(c: Column) -> Column:
    """More than two decimals, beyond what a spreadsheet's binary noise explains."""
    return F.abs(c - F.round(c, 2)) > 1e-6


def last4(number: Column) -> Column:
    return F.right(F.regexp_replace(number, r"\D", ""), F.lit(4))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Keyed hash of a binary column as hex: two hashes over the key, xor-ed with constant pads, and the message."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    padded = lambda pad, data: F.sha2(F.concat(F.lit(bytes(x ^ pad for x in block)), data), 256)
    return padded(0x5C, F.unhex(padded(0x36, message)))


def account_id(key: bytes, bank: Column, number: Column) -> Column:
    """Keyed account identity: over bank, a zero byte and the number."""
    return hmac_sha256(key, F.concat(F.encode(bank, "UTF-8"), F.lit(b"\0"), F.encode(number, "UTF-8")))


def identity_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)


def _real_date(year: Column, month: Column, day: Column) -> Column:
    """The date, null if the month has no such day."""
    first = F.make_date(year, month, F.lit(1))
    return F.when(day.between(1, F.day(F.last_day(first))), F.date_add(first, (day - 1).cast("int")))


def dated_by_start(day: Column, month: Column, period_start: Column, period_end: Column) -> Column:
    """The date of a row that prints day and month, in a statement whose period may cross new year:
    months from the period's first on are of its first year, others of its last."""
    return _real_date(F.when(month >= F.month(period_start), F.year(period_start)).otherwise(F.year(period_end)), month, day)


def dated_inside(day: Column, month: Column, period_start: Column, period_end: Column) -> Column:
    """The date with that day and month that lies inside the period, in the year it begins or ends; null
    if neither does: such a statement is to be refused (ingest.outside_period)."""
    tried = [_real_date(F.year(p), month, day) for p in (period_start, period_end)]
    return F.coalesce(*(F.when(d.between(period_start, period_end), d) for d in tried))
