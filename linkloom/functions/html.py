"""Link extraction from HTML text as Spark expressions.

One regular expression walks the page from left to right, as a tokenizer
does: comments, raw-text elements and other tags are consumed whole, so an
``a`` tag inside any of them is never seen. A second one walks the attributes
of each ``a`` tag. All repeats are possessive or single-character, which keeps
matching linear and the JVM stack flat on pages of any length.

Not modelled: the double-escaped script state (``<!--<script>`` inside a
script) and NUL replacement.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom.functions.urls import canonical_urls_sql

# Elements whose content is text, not markup.
RAW_TEXT_ELEMENTS = ("script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp")

_WS = r"[ \t\n\r\f]"
_VALUE = r'(?:"[^"]*+"|\x27[^\x27]*+\x27|[^"\x27 \t\n\r\f>][^ \t\n\r\f>]*+)'
_ATTRIBUTE = rf"[^ \t\n\r\f/>][^ \t\n\r\f/>=]*+(?:{_WS}*+={_WS}*+{_VALUE}?+)?+"
_ATTRIBUTES = rf"(?:[ \t\n\r\f/]++|{_ATTRIBUTE})*+"
_NAME_END = r"(?=[ \t\n\r\f/>])"

# One leading "<" for all kinds of token, so that plain text is passed over with one test per character.
_TOKENS = (
    r"(?is)<(?:"
    r"!--(?:-?>|.*?(?:--!?>|\z))"
    rf"|a{_NAME_END}({_ATTRIBUTES})>"
    rf"|({'|'.join(RAW_TEXT_ELEMENTS)}){_NAME_END}{_ATTRIBUTES}>(?:.*?(?=</\2{_NAME_END})|.*\z)"
    rf"|plaintext{_NAME_END}.*\z"
    rf"|/?[a-z][^ \t\n\r\f/>]*+{_ATTRIBUTES}>"
    r"|[!?][^>]*+>|/[^a-z>][^>]*+>"
    r"|(?:[a-z!?]|/[^>]).*\z)"
)
_HREFS = rf"(?is)href(?=[ \t\n\r\f/>=]|\z)(?:{_WS}*+={_WS}*+({_VALUE})?+)?+|{_ATTRIBUTE}"

# Code points that numeric references 128..159 stand for, by the cp1252 rule of the HTML standard.
_C1 = {str(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _json_map(table: dict[str, str]) -> str:
    text = json.dumps(table).replace("\\", "\\\\").replace("'", "\\'")
    return f"from_json('{text}', 'map<string,string>')"


def _bound(value: str, name: str, body: str) -> str:
    return f"aggregate(array({value}), CAST(NULL AS STRING), (_{name}, {name}) -> {body})"


def _code_point(number: str) -> str:
    in_range = f"{number} > 0 AND {number} <= 1114111 AND NOT {number} BETWEEN 55296 AND 57343"
    return (
        f"CASE WHEN {number} BETWEEN 128 AND 159 THEN coalesce(try_element_at({_json_map(_C1)}, "
        f"CAST({number} AS STRING)), decode(unhex(lpad(hex({number}), 8, '0')), 'UTF-32')) "
        f"WHEN {in_range} THEN decode(unhex(lpad(hex({number}), 8, '0')), 'UTF-32') ELSE '�' END"
    )


def attribute_text_sql(value: str) -> str:
    """SQL: an attribute value with its character references decoded by the HTML rules for attributes."""
    decimal = "coalesce(try_cast(regexp_extract(t, '([0-9]+)', 1) AS BIGINT), 1114112)"
    hexa = "coalesce(try_cast(conv(right(regexp_extract(t, '[xX]0*([0-9a-fA-F]+)', 1), 12), 16, 10) AS BIGINT), 1114112)"
    token = (
        f"CASE WHEN NOT startswith(t, '&') THEN t "
        f"WHEN t RLIKE '^&#[xX]' THEN {_bound(hexa, 'n', _code_point('n'))} "
        f"WHEN startswith(t, '&#') THEN {_bound(decimal, 'n', _code_point('n'))} "
        f"WHEN t IN ('&amp;', '&amp') THEN '&' "
        f"ELSE coalesce(try_element_at({_json_map(html5)}, substr(t, 2)), t) END"
    )
    pieces = r"r'&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z0-9]++(?:;|(?!=))|&?[^&]+|&'"
    return (
        f"CASE WHEN instr({value}, '&') = 0 THEN {value} "
        f"ELSE array_join(transform(regexp_extract_all({value}, {pieces}, 0), t -> {token}), '') END"
    )


def hrefs_sql(html: str) -> str:
    """SQL: array of the distinct decoded ``href`` values of all ``a`` tags of a page."""
    tags = f"filter(regexp_extract_all({html}, r'{_TOKENS}', 1), a -> a <> '')"
    values = f"filter(flatten(transform({tags}, a -> regexp_extract_all(a, r'{_HREFS}', 1))), v -> v <> '')"
    unquoted = "IF(v RLIKE r'^[\\x22\\x27]', substr(v, 2, length(v) - 2), v)"
    return f"array_distinct(transform({values}, v -> {_bound(unquoted, 'w', attribute_text_sql('w'))}))"


def extract_hrefs(html: str) -> Column:
    return F.expr(hrefs_sql(html))


def extract_links(html: str, base: str) -> Column:
    """Array of the distinct canonical links of a page; empty when there is none."""
    return F.expr(canonical_urls_sql(hrefs_sql(html), base))
