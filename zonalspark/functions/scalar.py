"""Scalar functions as column expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Half the edge of the web map square in metres.
MERCATOR = 20037508.342789244


def mercator_x(lon: Column) -> Column:
    return lon * MERCATOR / 180


def mercator_y(lat: Column) -> Column:
    return F.ln(F.tan((90 + lat) * math.pi / 360)) / (math.pi / 180) * MERCATOR / 180


def tile_box(z: Column, x: Column, y: Column) -> list[Column]:
    """minx, maxx, miny, maxy of a map tile in metres."""
    edge = 2 * MERCATOR / F.shiftleft(F.lit(1), z) if isinstance(z, int) else 2 * MERCATOR / F.pow(F.lit(2.0), z)
    return [(-MERCATOR + x * edge).alias("minx"), (-MERCATOR + (x + 1) * edge).alias("maxx"), (MERCATOR - (y + 1) * edge).alias("miny"), (MERCATOR - y * edge).alias("maxy")]


def safe_label(text: Column) -> Column:
    """Letters and digits stay, runs of anything else become one _, which goes at the ends; 32 characters at most."""
    return F.substring(F.btrim(F.regexp_replace(text, r"[^0-9A-Za-z]+", "_"), F.lit("_")), 1, 32)


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), F.lit("-"))


def truncated(text: Column, length: int = 120, end: str = "…") -> Column:
    return F.when(F.char_length(text) > length, F.concat(F.substring(text, 1, length), F.lit(end))).otherwise(text)


def absolute_url(url: Column) -> Column:
    """https:// before an address without http:// or https://; nothing for none."""
    return F.when(F.coalesce(url, F.lit("")) == "", "").when(F.rlike(url, F.lit("^https?://")), url).otherwise(F.concat(F.lit("https://"), url))


def number_text(n: Column) -> Column:
    """A number for people: grouped without decimals from 10,000 on, with one from 100, with three from 1, below with three
    digits that count, rounded before they are counted, from a millionth down with an exponent; a dash for none and what
    is not finite."""
    size = F.abs(n)
    exponent = F.floor(F.log10(size))
    mantissa = F.round(size * F.pow(F.lit(10.0), -exponent), 2)
    up = mantissa >= 10
    tiny = F.concat(F.when(n < 0, "-").otherwise(""), F.format_string("%.2f", F.when(up, mantissa / 10).otherwise(mantissa)), F.lit("e"), (exponent + up.cast("int")).cast("string"))
    small = tiny
    for k in range(6, 0, -1):
        small = F.when(F.round(size, k + 2) >= 10.0**-k, F.format_string(f"%.{k + 2}f", n)).otherwise(small)
    small = F.when(F.round(size, 3) >= 1, F.format_string("%.2f", n)).otherwise(small)
    out = F.when(n == 0, "0").when(size >= 10000, F.format_number(n, 0)).when(size >= 100, F.format_string("%.1f", n)).when(size >= 1, F.format_string("%.3f", n)).otherwise(small)
    return F.when(n.isNull() | F.isnan(n) | (size == float("inf")), "—").otherwise(out)


def html_escaped(text: Column) -> Column:
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(c), F.lit(name))
    return text


def error_text(kind: Column, message: Column) -> Column:
    """What an error says of itself, 100 characters at most."""
    return F.substring(F.concat(kind, F.lit("('"), message, F.lit("')")), 1, 100)


def title_case(text: Column) -> Column:
    """_ as spaces; the first letter of each run of letters large, the others small."""
    runs = F.split(F.replace(text, F.lit("_"), F.lit(" ")), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def cycled(index: Column, palette: list[str]) -> Column:
    """A colour for an index; negative and large ones go round."""
    return F.get(F.array(*map(F.lit, palette)), F.pmod(F.floor(index), F.lit(len(palette))).cast("int"))


def line_width(level: Column) -> Column:
    """Lines of levels 0 to 4 get thinner by half; others are 1.5."""
    return F.when(level.between(0, 4), F.greatest(F.lit(0.75), 4.5 - level * 0.5)).otherwise(1.5)


def short_hash(text: Column) -> Column:
    return F.substring(F.md5(text), 1, 8)


def week_key(day: Column) -> Column:
    """First day of the week (Sundays begin weeks; days before the year's first Sunday are week 0), no earlier than the
    year's first day."""
    week = F.floor((F.dayofyear(day) + 6 - (F.dayofweek(day) - 1)) / 7)
    return F.date_add(F.trunc(day, "year"), F.greatest(F.lit(0), (week * 7 - 7 + 0).cast("int")))


def number(text: Column) -> Column:
    """A double, null where it is none or NaN."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value), value)


TOKEN = re.compile(r"\s*(?:\[([^\]]+)\]|(\d+\.?\d*|\.\d+)|([-+*/()]))")


def formula(text: str, known: list[str]) -> Column:
    """An arithmetic formula over [columns] as a column: + - * / and brackets, no unary minus. Null and what is no number
    give null, as does a division by 0; unknown columns and malformed formulas raise ValueError."""
    tokens, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise ValueError(f"formula: unexpected {text[at:].strip()[0]!r}")
        tokens.append(m)
        at = m.end()
    pos = 0

    def peek() -> str | None:
        return tokens[pos][3] if pos < len(tokens) else None

    def factor() -> Column:
        nonlocal pos
        if pos >= len(tokens):
            raise ValueError("formula: it ends too early")
        m = tokens[pos]
        pos += 1
        if m[1]:
            if m[1] not in known:
                raise ValueError(f"formula: no column {m[1]!r}")
            return number(F.col(f"`{m[1]}`").cast("string"))
        if m[2]:
            return F.lit(float(m[2]))
        if m[3] == "(":
            inner = expression()
            if peek() != ")":
                raise ValueError("formula: a bracket stays open")
            pos += 1
            return inner
        raise ValueError(f"formula: unexpected {m[3]!r}")

    def level(part, signs: dict) -> Column:
        nonlocal pos
        out = part()
        while (sign := peek()) in signs:
            pos += 1
            out = signs[sign](out, part())
        return out

    def term() -> Column:
        return level(factor, {"*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b)})

    def expression() -> Column:
        return level(term, {"+": lambda a, b: a + b, "-": lambda a, b: a - b})

    out = expression()
    if pos < len(tokens):
        raise ValueError(f"formula: unexpected {tokens[pos][0].strip()!r}")
    return out
