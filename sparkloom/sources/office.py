"""Readers for zipped office files: blocks of text documents, slides of decks, cells of workbooks, one row each.

Spark lists and reads the files and deals them out; a task opens one file at a time. A file that is broken, or no such
archive, gives one row with its error and no content. Files over ``largest`` bytes give an error as well.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values
_PROMPTS = re.compile(r"(explain|describe|draw|identify|calculate|discuss|compare|write|complete)\b", re.I)


def _local(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _xml(archive: zipfile.ZipFile, name: str):
    return ElementTree.fromstring(archive.read(name))


def _related(archive: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """id -> (last word of the kind, path) of what ``part`` refers to."""
    folder, name = posixpath.split(part)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in archive.namelist():
        return {}
    found = {}
    for r in _xml(archive, rels):
        target = r.get("Target", "")
        inside = posixpath.normpath(target.lstrip("/") if target.startswith("/") else f"{folder}/{target}")
        found[r.get("Id")] = (r.get("Type", "").rsplit("/", 1)[-1], target if r.get("TargetMode") == "External" else inside)
    return found


def _relation(node) -> str:
    return next((v for k, v in node.attrib.items() if k.endswith("}id")), "")


def _paragraph(node) -> str:
    """The text of a paragraph; breaks as newlines, tabs as tabs."""
    signs = {"tab": "\t", "br": "\n", "cr": "\n"}
    return "".join(n.text or "" if _local(n) == "t" else signs.get(_local(n), "") for n in node.iter() if _local(n) in ("t", *signs))


def _paragraphs(node) -> str:
    return "\n".join(filter(str.strip, (_paragraph(p) for p in node.iter() if _local(p) == "p")))


def _blocks(archive: zipfile.ZipFile) -> Iterator[dict]:
    """Paragraphs and tables in order. An empty paragraph takes a number, too."""
    body = next(n for n in _xml(archive, "word/document.xml") if _local(n) == "body")
    place = 0
    for node in body:
        if _local(node) == "tbl":
            rows = [[_paragraphs(c) for c in r if _local(c) == "tc"] for r in node if _local(r) == "tr"]
            yield {"place": place, "kind": "table", "text": "\n".join(" | ".join(r) for r in rows)}
        elif _local(node) == "p":
            text = _paragraph(node).strip()
            if text:
                yield {"place": place, "kind": "prompt" if text.endswith("?") or _PROMPTS.match(text) else "document_block", "text": text}
        else:
            continue
        place += 1


def _slides(archive: zipfile.ZipFile) -> Iterator[dict]:
    """Slides in the deck's order, each followed by its notes where it has some."""
    deck, rels = _xml(archive, "ppt/presentation.xml"), _related(archive, "ppt/presentation.xml")
    for place, node in enumerate(n for n in deck.iter() if _local(n) == "sldId"):
        part = rels[_relation(node)][1]
        yield {"place": place, "kind": "slide", "text": _paragraphs(_xml(archive, part))}
        for kind, notes in _related(archive, part).values():
            if kind == "notesSlide":
                shapes = [s for s in _xml(archive, notes).iter() if _local(s) == "sp" and any(_local(p) == "ph" and p.get("type") == "body" for p in s.iter())]
                text = "\n".join(filter(None, map(_paragraphs, shapes)))
                if text:
                    yield {"place": place, "kind": "speaker_note", "text": text}


def _cells(archive: zipfile.ZipFile) -> Iterator[dict]:
    """Cells that hold something: the shown value as text, and the formula."""
    book, rels = _xml(archive, "xl/workbook.xml"), _related(archive, "xl/workbook.xml")
    shared = []
    if "xl/sharedStrings.xml" in archive.namelist():
        shared = ["".join(t.text or "" for t in s.iter() if _local(t) == "t") for s in _xml(archive, "xl/sharedStrings.xml")]
    for place, sheet in enumerate(n for n in book.iter() if _local(n) == "sheet"):
        for cell in (c for c in _xml(archive, rels[_relation(sheet)][1]).iter() if _local(c) == "c"):
            held = {_local(n): n for n in cell}
            value = held["v"].text if "v" in held else "".join(t.text or "" for t in cell.iter() if _local(t) == "t") if "is" in held else None
            if cell.get("t") == "s" and value:
                value = shared[int(value)]
            formula = f"={held['f'].text or ''}" if "f" in held else None
            if value not in (None, "") or formula:
                yield {"place": place, "kind": "cell", "text": value, "sheet": sheet.get("name"), "cell": cell.get("r"), "formula": formula}


_COLUMNS = ["path", "place", "kind", "text", "sheet", "cell", "formula", "error"]


def _read(each: Callable, largest: int):
    def run(batches):
        for batch in batches:
            for path, size, content in zip(batch.path, batch.length, batch.content, strict=True):
                try:
                    if size > largest:
                        raise ValueError(f"over {largest} bytes")
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        if sum(i.file_size for i in archive.infolist()) > 20 * largest:
                            raise ValueError("unpacks to too much")
                        rows = list(each(archive))
                except (ValueError, KeyError, IndexError, StopIteration, zipfile.BadZipFile, ElementTree.ParseError) as e:
                    rows = [{"error": f"{type(e).__name__}: {e}"}]
                out = pd.DataFrame([{"path": path} | r for r in rows], columns=_COLUMNS)
                yield out.astype(object).where(out.notna(), None)

    return run


def _files(spark: SparkSession, path: str, pattern: str, each: Callable, largest: int) -> DataFrame:
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    # lock files of open documents are no documents; a batch holds few files, as each may be large
    named = found.where(~F.regexp_extract("path", "([^/]*)$", 1).startswith("~$")).select("path", "length", F.when(F.col("length") <= largest, F.col("content")).alias("content"))
    return named.mapInPandas(_read(each, largest), "path string, place int, kind string, text string, sheet string, cell string, formula string, error string")


def read_documents(spark: SparkSession, path: str, largest: int = 64 << 20) -> DataFrame:
    """path, place, kind (document_block, prompt or table), text, error of all .docx files under ``path``."""
    return _files(spark, path, "*.docx", _blocks, largest).drop("sheet", "cell", "formula")


def read_decks(spark: SparkSession, path: str, largest: int = 64 << 20) -> DataFrame:
    """path, place, kind (slide or speaker_note), text, error of all .pptx files under ``path``."""
    return _files(spark, path, "*.pptx", _slides, largest).drop("sheet", "cell", "formula")


def read_workbooks(spark: SparkSession, path: str, largest: int = 64 << 20) -> DataFrame:
    """path, place (of the sheet), sheet, cell, row, col, value, formula, error of all .xlsx files under ``path``."""
    found = _files(spark, path, "*.xlsx", _cells, largest)
    return found.select("path", "place", "sheet", "cell", row_number_of(F.col("cell")).alias("row"), column_number(F.col("cell")).alias("col"), F.col("text").alias("value"), "formula", "error")


def row_number_of(cell: Column) -> Column:
    return F.regexp_extract(cell, r"^\$?[A-Za-z]+\$?(\d+)$", 1).try_cast("int")


def column_number(cell: Column) -> Column:
    """1 for A, 27 for AA; null where ``cell`` is no reference."""
    letters = F.regexp_extract(F.upper(cell), r"^\$?([A-Z]{1,3})\$?\d+$", 1)
    number = F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64)
    return F.when(letters != "", number)
