"""Sources: files of several formats, manifests, golden sets; sinks: JSON lines and reports."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text
from lectern.functions.html import to_text
from lectern.functions.shipping import map_arrow

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """name, suffix, length of files, through the binary source without reading their content."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length")
    name = F.substring_index("path", "/", -1)
    return rows.select(name.alias("name"), F.lower(F.regexp_extract(name, "(\\.[^.]*)$", 1)).alias("suffix"), "length")


def docx_text(raw: bytes) -> str:
    """A document's paragraphs, headings by style as ATX, table rows with bars."""
    body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml")).find(f"{_W}body")

    def words(node: ElementTree.Element) -> str:
        return " ".join("".join(t.text or "" for t in node.iter(f"{_W}t")).split())

    blocks = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            named = re.fullmatch(r"(?i)(title)|heading\s*([1-6])", style.get(f"{_W}val", "") if style is not None else "")
            told = words(node)
            if told:
                blocks.append(f"{'#' * int(named[2] or 1)} {told}" if named else told)
        elif node.tag == f"{_W}tbl":
            blocks += [" | ".join(words(c) for c in row.iter(f"{_W}tc")) for row in node.iter(f"{_W}tr")]
    return "\n\n".join(blocks)


def pdf_pages(raw: bytes) -> tuple[str | None, list[str]]:
    """Title and texts of a PDF's pages; needs the optional pypdf."""
    from pypdf import PdfReader

    reader = PdfReader(io.BytesIO(raw))
    if reader.is_encrypted:
        reader.decrypt("")
    pages = []
    for page in reader.pages:
        try:
            pages.append(page.extract_text() or "")
        except Exception:  # noqa: BLE001
            pages.append("")
    return (reader.metadata or {}).get("/Title"), pages


def parsed(kind: str, raw: bytes, name: str) -> tuple[str, list[tuple[int | None, str]]]:
    """Title (the name without suffix if there is none) and pages (number, text)."""
    stem = re.sub(r"\.[^.]*$", "", name)
    if kind == "pdf":
        title, pages = pdf_pages(raw)
        return title or stem, [(n, p) for n, p in enumerate(pages, 1)]
    if kind == "docx":
        body = docx_text(raw)
        head = re.search(r"(?m)^# (.+)$", body)
        return head[1] if head else stem, [(None, body)]
    body = raw.decode("utf-8-sig", "replace").replace("\r\n", "\n").replace("\r", "\n")
    if kind == "html":
        title, body = to_text(body)
        return title or stem, [(None, body)]
    heads = re.findall(r"(?m)^(#{1,6})[ \t]+(.+?)[ \t]*#*[ \t]*$", body) if kind == "md" else []
    title = next((t for h, t in heads if h == "#"), heads[0][1] if heads else stem)
    return title.strip(), [(None, body)]


def loaded(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """source, kind, checksum, title, page, text of files; a row for each page.  A kind that can't be told, or a reader that isn't installed, gives error."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.substring_index("path", "/", -1)
    kind = text.detect_kind(F.regexp_extract(name, "(\\.[^.]*)$", 1), F.lit(None).cast("string"), F.col("content"))
    rows = rows.select(F.col("path").alias("source"), name.alias("name"), kind.alias("kind"), F.sha2("content", 256).alias("checksum"), "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                head = (r["source"], r["kind"], r["checksum"])
                try:
                    if r["kind"] is None:
                        raise ValueError("the format can't be told")
                    title, pages = parsed(r["kind"], r["content"], r["name"])
                    out += [(*head, title, n, p, None) for n, p in pages]
                except Exception as e:  # noqa: BLE001
                    out.append((*head, None, None, None, f"{type(e).__name__}: {e}"))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["source", "kind", "checksum", "title", "page", "text", "error"])

    return map_arrow(rows, run, "source string, kind string, checksum string, title string, page int, text string, error string")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """source, title, acl_tags, meta of a manifest: JSON, or YAML where a reader is installed, with a list `documents`."""
    body = Path(path).read_text(encoding="utf-8")
    try:
        told = json.loads(body)
    except ValueError:
        import yaml

        told = yaml.safe_load(body)
    if not isinstance(told, dict) or not isinstance(told.get("documents"), list):
        raise ValueError("a manifest needs a list of documents")
    rows, here = [], Path(path).resolve().parent
    for entry in told["documents"]:
        source = entry.get("path") or entry.get("url")
        if not source:
            raise ValueError("a document needs a path or a url")
        if entry.get("path"):
            places = [p / source for p in (here, here.parent, Path.cwd())]
            source = str(next((p for p in places if p.exists()), places[0]))
        tags = entry.get("acl_tags", ["public"])
        rest = {k: str(v) for k, v in entry.items() if k not in ("path", "url", "title", "acl_tags")}
        rows.append((source, entry.get("title"), [tags] if isinstance(tags, str) else list(tags), rest))
    return spark.createDataFrame(rows, "source string, title string, acl_tags array<string>, meta map<string,string>")


def write_json_lines(rows: DataFrame, path: str, *order: str) -> None:
    """One file of JSON lines in order."""
    rows.orderBy(*order).select(F.to_json(F.struct(*rows.columns)).alias("value")).coalesce(1).write.text(path)
