"""Words of texts for matching: A-Z lower-cased, everything but letters and digits a separator."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from occugrid.llm.shared import text_of

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: Bytes of UTF-8 text: A-Z to a-z, other ASCII than letters and digits to a space, the rest as is.
_NORMAL = bytes(
    code if code >= 0x80 or code in _KEPT else code + 32 if 0x41 <= code <= 0x5A else 0x20
    for code in range(256)
)


def utf8(text_col: str) -> Column:
    """The text as UTF-8 bytes, which tasks read without decoding; a null text is empty."""
    return text_of(text_col).cast("binary").alias("text")


def words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a whole UTF-8 text after A-Z became a-z."""
    return text.translate(_NORMAL).split()


def id_text(id_col: str) -> Column:
    return F.col(id_col).cast("string")
