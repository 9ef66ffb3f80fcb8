"""Text functions: tokens, labels, snippets, citations, formats, checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[\\p{L}\\p{N}]+"
MOST_TOKENS, SNIPPET = 64, 240
CITATION = "\\[\\s*(\\d+(?:\\s*,\\s*\\d+)*)\\s*\\]"
REFUSAL = "The documents available to you do not answer this question."

#: File suffixes, content types and the kinds they name.
KIND_BY_SUFFIX = {".pdf": "pdf", ".docx": "docx", ".md": "md", ".markdown": "md", ".html": "html", ".htm": "html", ".xhtml": "html", ".txt": "txt", ".text": "txt"}
KIND_BY_TYPE = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "text/html": "html",
    "application/xhtml+xml": "html",
    "text/markdown": "md",
    "text/x-markdown": "md",
    "text/plain": "txt",
}


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def question_tokens(text: Column, most: int = MOST_TOKENS) -> Column:
    """The first tokens of a question, repeats kept."""
    return F.slice(tokens(text), 1, most)


def squashed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def snippet(text: Column, limit: int = SNIPPET) -> Column:
    """The text on one line, cut to limit characters with an ellipsis."""
    flat = squashed(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…")))


def base_name(source: Column) -> Column:
    return F.substring_index(F.replace(source, F.lit("\\"), F.lit("/")), "/", -1)


def _some(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def hit_title(title: Column, source: Column) -> Column:
    return F.coalesce(_some(title), base_name(source))


def _page(page: Column) -> Column:
    return F.when(page != 0, F.concat(F.lit("p."), page.cast("string")))


def source_label(title: Column, source: Column, page: Column, heading: Column) -> Column:
    """title or file name, page, heading, with commas."""
    return F.concat_ws(", ", hit_title(title, source), _page(page), _some(heading))


def chip_label(title: Column, source: Column, page: Column, heading: Column) -> Column:
    """title or file name, heading, page, with middle dots."""
    return F.concat_ws(" · ", hit_title(title, source), _some(heading), _page(page))


def source_block(ranked: Column) -> Column:
    """One text of an array of structs (rank, label, text): each numbered, blank lines between."""
    return F.array_join(F.transform(F.array_sort(ranked), lambda r: F.concat(F.lit("["), r["rank"].cast("string"), F.lit("] "), r["label"], F.lit("\n"), F.trim(r["text"]))), "\n\n")


def citations(text: Column) -> Column:
    """Numbers cited as [n] or [n, m], in order of appearance, without repeats."""
    groups = F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, ","), lambda n: F.trim(n).cast("int")))))


def is_bare_citation(text: Column) -> Column:
    return (text != "") & text.rlike("^[\\s\\[\\]\\d,;.\\-]*$") & F.contains(text, F.lit("["))


def _core(text: Column) -> Column:
    return F.btrim(squashed(F.lower(F.regexp_replace(text, CITATION, ""))), F.lit(" .!"))


def is_refusal(text: Column, sentence: str = REFUSAL) -> Column:
    """Whether the text opens with the refusal sentence, citations and case aside."""
    return F.startswith(_core(text), _core(F.lit(sentence)))


def missing(text: Column, wanted: Column) -> Column:
    return F.filter(wanted, lambda s: (s != "") & ~F.contains(F.lower(text), F.lower(s)))


def found(text: Column, unwanted: Column) -> Column:
    return F.filter(unwanted, lambda s: (s != "") & F.contains(F.lower(text), F.lower(s)))


def split_tags(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, "[,\\s]+"), lambda t: t != ""))


def decoded(raw: Column) -> Column:
    """Bytes as text: UTF-8, invalid bytes replaced, no byte-order mark, lines end in a newline alone."""
    return F.regexp_replace(F.regexp_replace(F.decode(raw, "UTF-8"), "^\\x{FEFF}", ""), "\\r\\n?", "\n")


def markdown_title(text: Column) -> Column:
    """The first heading of level 1, else the first of any level."""
    level1 = F.regexp_extract(text, "(?m)^#[ \\t]+(.+?)[ \\t]*#*[ \\t]*$", 1)
    any_level = F.regexp_extract(text, "(?m)^#{1,6}[ \\t]+(.+?)[ \\t]*#*[ \\t]*$", 1)
    return F.coalesce(_some(F.trim(level1)), _some(F.trim(any_level)))


def detect_kind(suffix: Column, content_type: Column, raw: Column) -> Column:
    """pdf, docx, html, md or txt by suffix, then content type, then first bytes; null if none tells."""
    by_suffix = F.create_map(*[F.lit(x) for kv in KIND_BY_SUFFIX.items() for x in kv])[F.lower(suffix)]
    by_type = F.create_map(*[F.lit(x) for kv in KIND_BY_TYPE.items() for x in kv])[F.lower(F.trim(F.substring_index(content_type, ";", 1)))]
    head = F.regexp_replace(F.decode(F.substring(raw, 1, 2048), "ISO-8859-1"), "^\\s+", "")
    low = F.lower(F.substring(head, 1, 512))
    by_bytes = (
        F.when(F.startswith(head, F.lit("%PDF")), "pdf")
        .when(F.startswith(head, F.lit("PK")) & F.contains(F.decode(F.substring(raw, 1, 65536), "ISO-8859-1"), F.lit("word/document.xml")), "docx")
        .when(F.startswith(low, F.lit("<!doctype html")) | F.contains(low, F.lit("<html")) | F.contains(low, F.lit("<body")), "html")
        .when((head == "") | (~F.contains(head, F.lit("\0")) & F.is_valid_utf8(F.substring(raw, 1, 2048).cast("string"))), "txt")
    )
    return F.coalesce(by_suffix, by_type, by_bytes)


def escaped(text: Column) -> Column:
    """HTML-escaped."""
    for c, e in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&#34;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(c), F.lit(e))
    return text


def linked_citations(text: Column) -> Column:
    """Escaped text whose [n] markers are links."""
    return F.regexp_replace(escaped(text), "\\[\\s*(\\d+)\\s*\\]", '<a class="cite" href="#source-$1">[$1]</a>')
