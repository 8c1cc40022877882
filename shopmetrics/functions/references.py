"""Character references of HTML, named and numeric, as browsers and parsers read them."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

_PIECES = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)|&|[^&]+"
UNKNOWN = "�"


def _windows_letter(code: int) -> str:
    """What a number from 128 to 159 stands for in old pages."""
    return bytes([code]).decode("cp1252", "ignore") or chr(code)


def _numeric(piece: Column) -> Column:
    digits = F.regexp_replace(piece, "^&#[xX]?|;$", "")
    hexadecimal = F.lower(F.substring(piece, 3, 1)) == "x"
    code = F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
    old = F.array(*[F.lit(_windows_letter(i)) for i in range(128, 160)])
    surrogate = (code >= 0xD800) & (code <= 0xDFFF)
    control = (code < 32) & ~code.isin(9, 10, 12, 13) | (code == 127)
    unused = (code >= 0xFDD0) & (code <= 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    letter = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return (
        F.when(code.isNull() | (code > 0x10FFFF) | (code == 0) | surrogate, UNKNOWN)
        .when((code >= 128) & (code < 160), F.get(old, (code - 128).cast("int")))
        .when(control | unused, "")
        .otherwise(letter)
    )


def _named(piece: Column, table: Column) -> Column:
    """The longest name at the start of a reference; the reference itself if there is none."""
    name = F.substring(piece, 2, 40)
    lengths = F.sequence(F.length(name), F.lit(2), F.lit(-1))
    known = F.filter(
        F.when(F.length(name) >= 2, lengths),
        lambda n: F.try_element_at(table, F.substring(name, F.lit(1), n)).isNotNull(),
    )
    length = F.get(known, F.lit(0))
    found = F.try_element_at(table, F.substring(name, F.lit(1), length))
    return F.when(length.isNull(), piece).otherwise(
        F.concat(found, F.substring(name, length + 1, F.lit(40)))
    )


def decode_references(value: Column) -> Column:
    """The text that ``value`` stands for in an attribute."""
    table = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    pieces = F.regexp_extract_all(value, F.lit(_PIECES), F.lit(0))
    decoded = F.transform(
        pieces,
        lambda p: F.when(p.rlike("^&#[0-9xX]"), _numeric(p))
        .when(p.rlike("(?s)^&."), _named(p, table))
        .otherwise(p),
    )
    return F.when(value.contains("&"), F.array_join(decoded, "")).otherwise(value)
