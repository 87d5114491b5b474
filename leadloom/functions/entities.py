"""Character references of HTML."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Named references that pages use most; they are looked up before all the others.
NAMED = {"nbsp": "\u00a0", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®", "middot": "·", "bull": "•", "ndash": "–", "mdash": "—", "hellip": "…", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "lsaquo": "‹", "rsaquo": "›", "euro": "€", "pound": "£", "plus": "+", "lpar": "(", "rpar": ")", "commat": "@", "period": ".", "amp": "&"}
#: All names of HTML 5; names that need no semicolon, longest first; and what numbers stand for that don't mean themselves.
NAMES = {k[:-1]: v for k, v in html5.items() if k.endswith(";")}
BARE = sorted((k for k in html5 if not k.endswith(";")), key=lambda k: (-len(k), k))
BARE_PATTERN = f"^({'|'.join(BARE)})"
#: An ampersand that starts neither a numeric reference nor one of NAMED with its semicolon.
OPEN = f"&(?!#|(?:{'|'.join(NAMED)});)"
NUMBERS = {0: "\ufffd", 13: "\r", **{c: bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(0x80, 0xA0)}}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value worked out once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _character(code: Column) -> Column:
    """The character of a code point that is no surrogate, by way of UTF-16."""
    high, low = F.lit(0xD800 - (0x10000 >> 10)) + F.shiftright(code, 10), F.lit(0xDC00) + code.bitwiseAND(F.lit(0x3FF))
    units = F.when(code < 0x10000, F.lpad(F.hex(code), 4, "0")).otherwise(F.concat(F.hex(high), F.hex(low)))
    return F.decode(F.unhex(units), "UTF-16BE")


def _numbered(code: Column) -> Column:
    """What a numeric reference stands for."""
    table = F.create_map(*[F.lit(x) for pair in NUMBERS.items() for x in pair])
    never = code.between(1, 8) | (code == 11) | code.between(14, 31) | (code == 127) | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return F.when((code < 0xA0) & F.map_contains_key(table, code), F.try_element_at(table, code)).when(code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit("\ufffd")).when(never, F.lit("")).otherwise(_character(code))


def decode_entities(text: Column) -> Column:
    """All named and numeric references of HTML 5, also those without a semicolon where that is allowed; others stay. Each is decoded once.

    Text without an ampersand passes as it is. The pieces between references are looked at one by one.
    """
    often = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])
    every = F.from_json(F.lit(json.dumps(NAMES)), "map<string,string>")
    bare = F.create_map(*[F.lit(x) for k in BARE for x in (k, html5[k])])
    beyond = F.lit(0x110000)

    def numeric(piece: Column) -> Column:
        deci, hexa = F.regexp_extract(piece, "^#0*([0-9]+)", 1), F.regexp_extract(piece, "^#[xX]0*([0-9a-fA-F]+)", 1)
        code = F.when(deci != "", F.when(F.length(deci) <= 7, deci.cast("int")).otherwise(beyond)).when(hexa != "", F.when(F.length(hexa) <= 6, F.conv(hexa, 16, 10).cast("int")).otherwise(beyond))
        return let(code, lambda c: F.when(c.isNull(), F.concat(F.lit("&"), piece)).otherwise(F.concat(_numbered(c), F.regexp_replace(piece, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", ""))))

    def named(piece: Column) -> Column:
        rest = lambda value, name, more: F.concat(value, piece.substr(F.length(name) + 1 + more, F.length(piece)))
        short = lambda name: F.when(name == "", F.concat(F.lit("&"), piece)).otherwise(rest(F.try_element_at(bare, name), name, 0))
        known = lambda name: let(F.when(name != "", F.coalesce(F.try_element_at(often, name), F.try_element_at(every, name))), lambda v: F.when(v.isNotNull(), rest(v, name, 1)).otherwise(let(F.regexp_extract(piece, BARE_PATTERN, 1), short)))
        return let(F.regexp_extract(piece, "^([A-Za-z0-9]{1,31});", 1), known)

    one = lambda piece: F.when(F.startswith(piece, F.lit("#")), numeric(piece)).otherwise(named(piece))
    whole = let(F.split(text, "&"), lambda pieces: F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), one), "")))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def as_written(text: Column) -> Column:
    """Markup in which all named references are text, as they are written, but for those of NAMED with a semicolon.

    For sources whose ampersands are mostly text, as titles that were cut after they had been escaped: whoever decodes or parses
    the result (by patterns, by the tree or as XML) leaves `&amp`, `&notit` and `&eacute;` alone. What has none passes as it is.
    """
    return F.when(F.contains(text, F.lit("&")), F.regexp_replace(text, OPEN, "&amp;")).otherwise(text)


#: The name under which callers asked for all references while decode_entities() had only some.
decode_all_entities = decode_entities
