"""Text helpers: tokeniser, HTML → text, redaction patterns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What is taken out of a body: comments (an unclosed one to the end), script / style /
# template blocks with their content (likewise), then tags and declarations. A tag opens only before a
# letter, '/' and a letter, '!' or '?', so 'a < b' stays text; a '>' inside a quoted attribute value does
# not close it. Groups are possessive, so that they are matched in a loop.
_INSIDE = r"""(?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|["'=])*+"""
HTML_STRIP = (r"(?is)<!--.*?(?:-->|\z)|<(script|style|template)\b" + _INSIDE + r">.*?(?:</\1\s*>|\z)"
              r"|</?[a-z]" + _INSIDE + r">|<[!?][^>]*>")

# Named character references and their code points.
HTML_ENTITIES = {
    "amp": 38, "lt": 60, "gt": 62, "quot": 34, "apos": 39, "nbsp": 32, "iexcl": 161, "cent": 162, "pound": 163, "yen": 165,
    "sect": 167, "copy": 169, "laquo": 171, "shy": 173, "reg": 174, "deg": 176, "plusmn": 177, "acute": 180, "micro": 181,
    "para": 182, "middot": 183, "raquo": 187, "frac14": 188, "frac12": 189, "frac34": 190, "iquest": 191,
    "Agrave": 192, "Aacute": 193, "Acirc": 194, "Atilde": 195, "Auml": 196, "Aring": 197, "AElig": 198, "Ccedil": 199,
    "Egrave": 200, "Eacute": 201, "Ecirc": 202, "Euml": 203, "Igrave": 204, "Iacute": 205, "Icirc": 206, "Iuml": 207,
    "Ntilde": 209, "Ograve": 210, "Oacute": 211, "Ocirc": 212, "Otilde": 213, "Ouml": 214, "times": 215, "Oslash": 216,
    "Ugrave": 217, "Uacute": 218, "Ucirc": 219, "Uuml": 220, "Yacute": 221, "szlig": 223,
    "agrave": 224, "aacute": 225, "acirc": 226, "atilde": 227, "auml": 228, "aring": 229, "aelig": 230, "ccedil": 231,
    "egrave": 232, "eacute": 233, "ecirc": 234, "euml": 235, "igrave": 236, "iacute": 237, "icirc": 238, "iuml": 239,
    "ntilde": 241, "ograve": 242, "oacute": 243, "ocirc": 244, "otilde": 245, "ouml": 246, "divide": 247, "oslash": 248,
    "ugrave": 249, "uacute": 250, "ucirc": 251, "uuml": 252, "yacute": 253, "yuml": 255, "OElig": 338, "oelig": 339,
    "ndash": 8211, "mdash": 8212, "lsquo": 8216, "rsquo": 8217, "sbquo": 8218, "ldquo": 8220, "rdquo": 8221, "bdquo": 8222,
    "bull": 8226, "hellip": 8230, "prime": 8242, "lsaquo": 8249, "rsaquo": 8250, "euro": 8364, "trade": 8482,
    "larr": 8592, "uarr": 8593, "rarr": 8594, "darr": 8595, "minus": 8722,
}
ENTITY = r"&(?:#[xX][0-9A-Fa-f]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]{1,31});"

# Tokeniser separator class (anything not a letter or digit).
TOKEN_SEP = r"[^\p{L}\p{N}]+"

# Card-number pattern (16 digits in groups of four with an
# optional space or dash) and its replacement.
CARD_PATTERN = r"\b\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"
CARD_REPLACEMENT = "[CREDIT_CARD_REDACTED]"

# Urgency words and the phone pattern of the enrichment example.
URGENT_PATTERN = r"(?i)(urgent|asap|emergency)"
PHONE_PATTERN = r"\b\d{3}-\d{3}-\d{4}\b"


def _character(ref: Column) -> Column:
    """One character reference → its character; unknown ones stay as they are."""
    names = F.create_map(*[F.lit(x) for kv in HTML_ENTITIES.items() for x in kv])
    code = (F.when(ref.rlike("^&#[xX]"), F.conv(F.substr(ref, F.lit(4), F.length(ref) - 4), 16, 10).try_cast("int"))
            .when(ref.startswith("&#"), F.substr(ref, F.lit(3), F.length(ref) - 3).try_cast("int"))
            .otherwise(F.try_element_at(names, F.substr(ref, F.lit(2), F.length(ref) - 2))))
    valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(ref)


def unescape(c: Column) -> Column:
    """Named and numeric character references → characters, in one pass (what a
    reference yields is not read again)."""
    refs = F.transform(F.regexp_extract_all(c, F.lit(ENTITY), F.lit(0)), _character)
    whole = F.array_join(F.zip_with(F.split(c, ENTITY, -1), refs, lambda t, r: F.concat(t, F.coalesce(r, F.lit("")))), "")
    return F.when(F.contains(c, F.lit("&")), whole).otherwise(c)


def html_to_text(c: Column) -> Column:
    """Strip markup with one linear-time regex pass, then replace character
    references. Applied to every chosen body, plain or HTML; a text without
    '<' and '&' is passed on untouched."""
    stripped = F.when(F.contains(c, F.lit("<")), F.regexp_replace(c, HTML_STRIP, "")).otherwise(c)
    return F.get(F.transform(F.array(stripped), unescape), F.lit(0))     # stripped once


def normalized(c: Column) -> Column:
    """Lower-case and turn every run of non letters/digits into one space."""
    return F.regexp_replace(F.lower(c), TOKEN_SEP, " ")


def tokens(c: Column) -> Column:
    """D1 tokeniser: array of non-empty lower-case terms."""
    return F.array_remove(F.split(normalized(c), " "), "")


def redact_cards(c: Column) -> Column:
    """L9."""
    return F.regexp_replace(c, CARD_PATTERN, CARD_REPLACEMENT)
