"""Bytes to text, formats, pages, spans of pattern matches: columns only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and what they are read as.
FORMATS = {"txt": "txt", "text": "txt", "md": "md", "markdown": "md", "html": "html", "htm": "html", "pdf": "pdf", "docx": "docx"}
READABLE = ("txt", "md", "html")
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&middot;", "·"), ("&copy;", "©"), ("&mdash;", "—"), ("&amp;", "&"))
#: The characters of bytes 0x80 to 0x9F in the Windows code page; five bytes are undefined.
WINDOWS = "€\x81‚ƒ„…†‡ˆ‰Š‹Œ\x8dŽ\x8f\x90‘’“”•–—˜™š›œ\x9džŸ"


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[.]([^./\\]+)$", 1))


def detected_format(name: Column, head: Column | None = None) -> Column:
    """Magic bytes outrank the extension; null for a format that is not known."""
    ext, by_name = extension(name), None
    for k, v in FORMATS.items():
        by_name = F.when(ext == k, v) if by_name is None else by_name.when(ext == k, v)
    if head is None:
        return by_name
    magic = F.when(F.substring(head, 1, 5) == F.lit(b"%PDF-"), "pdf").when((F.substring(head, 1, 2) == F.lit(b"PK")) & (ext == "docx"), "docx")
    return F.coalesce(magic, by_name)


def decoded(content: Column) -> Column:
    """UTF-8 without its mark, else Windows-1252."""
    text = F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8"))
    latin = F.translate(F.decode(content, "ISO-8859-1"), "".join(chr(c) for c in range(0x80, 0xA0)), WINDOWS)
    return F.regexp_replace(F.coalesce(text, latin), "^﻿", "")


def html_to_text(html: Column) -> Column:
    """Scripts, styles and comments dropped, one stripped line per piece of text."""
    bare = F.regexp_replace(html, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<!doctype[^>]*>", "")
    bare = F.regexp_replace(bare, r"<[^>]*>", "\n")
    for entity, char in ENTITIES:
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    lines = F.filter(F.transform(F.split(bare, "\n"), lambda x: F.regexp_replace(x, r"^[ \t\r]+|[ \t\r]+$", "")), lambda x: x != "")
    return F.array_join(lines, "\n")


def matches(text: Column, pattern: str) -> Column:
    """Matches of a pattern: array of (text, before), before being what lies between it and the last one."""
    whole, between = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    return F.transform(F.slice(F.arrays_zip(whole.alias("hit"), between.alias("before")), F.lit(1), F.size(whole)), lambda x: F.struct(x["hit"].alias("hit"), F.length(x["before"]).alias("gap")))


def quoted_pattern(quote: Column) -> Column:
    """A pattern for the quote's words with any white space between them."""
    words = F.filter(F.split(quote, r"(?U)\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit("\\Q"), F.replace(w, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))), "\\s+")
