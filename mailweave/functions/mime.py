"""MIME helpers: base64url decoding, content sniffing, extension maps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Body MIME types eligible at the top level of a multipart
# message, in the reference's order.
SUPPORTED_BODY_TYPES = ["text/html", "text/plain", "multipart/related", "multipart/alternative"]


# White space that may stand inside base64 text.
SPACE = r"[\n\r \t\f\x0B]"


def b64url_decode(data: Column) -> Column:
    """URL-safe base64 → UTF-8 text; null when not base64 or not UTF-8."""
    def decode(x: Column) -> Column:
        std = F.replace(F.replace(x, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
        return F.try_to_binary(F.concat(std, F.repeat(F.lit("="), (F.lit(4) - F.length(x) % 4) % 4)), F.lit("base64"))

    solid = F.when(data.rlike(SPACE), F.regexp_replace(data, SPACE, "")).otherwise(data)
    binary = F.get(F.transform(F.array(solid), decode), F.lit(0))    # ``solid`` is computed once
    return F.try_validate_utf8(binary.cast("string"))


def b64url_encode(text: Column) -> Column:
    """Inverse of :func:`b64url_decode` (used to land raw fixtures)."""
    out = F.base64(F.encode(text, "UTF-8"))
    for c, to in [("\r\n", ""), ("+", "-"), ("/", "_")]:    # base64() may wrap lines
        out = F.replace(out, F.lit(c), F.lit(to))
    return out
