"""Readers of zipped office documents: one file in, page rows out."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"

#: Readers for formats that need an external tool: kind -> callable(bytes) that
#: yields (page or None, text).
EXTERNAL: dict = {}


def pages_of(path: str, kind: str, data: bytes) -> list[tuple]:
    """(path, page_no, page, text, parser, error) rows of one file."""
    try:
        if kind == "docx":
            pages = [(None, docx_text(data))]
        elif kind == "pptx":
            pages = pptx_pages(data)
        elif kind in EXTERNAL:
            pages = list(EXTERNAL[kind](data))
        else:
            return [(path, 0, None, None, kind, f"no reader for {kind}")]
    except Exception as exc:  # a broken file is a result, not a failed job
        return [(path, 0, None, None, kind, f"{type(exc).__name__}: {exc}")]
    kept = [(path, i, page, text, kind, None) for i, (page, text) in enumerate(pages) if text.strip()]
    return kept or [(path, 0, None, None, kind, "empty document")]


def _words(node) -> str:
    """Text runs of a paragraph, tabs and breaks kept, boxed text left out."""
    out = []

    def walk(el):
        for child in el:
            tag = child.tag
            if tag == W + "t":
                out.append(child.text or "")
            elif tag == W + "tab":
                out.append("\t")
            elif tag in (W + "br", W + "cr"):
                out.append("\n")
            elif tag != W + "txbxContent":
                walk(child)

    walk(node)
    return "".join(out).strip()


def _table(node) -> str:
    """Rows of ``" | "``-joined cells; a cell covered by a vertical merge is skipped."""
    lines = []
    for row in node.iter(W + "tr") if node.tag != W + "tbl" else node.findall(W + "tr"):
        cells = []
        for cell in row.findall(W + "tc"):
            merge = cell.find(f"{W}tcPr/{W}vMerge")
            if merge is not None and merge.get(W + "val") != "restart":
                continue
            text = "\n".join(_story(cell))
            if text:
                cells.append(text)
        if cells:
            lines.append(" | ".join(cells))
    return "\n".join(lines)


def _story(parent) -> list[str]:
    """Paragraphs and tables of a container in document order."""
    parts = []
    for child in parent:
        if child.tag == W + "p":
            parts.append(_words(child))
        elif child.tag == W + "tbl":
            parts.append(_table(child))
    return [p for p in parts if p]


def docx_text(data: bytes) -> str:
    """Distinct headers and footers, the body, then text boxes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = sorted(n for n in z.namelist() if re.fullmatch(r"word/(header|footer)\d*\.xml", n))
        margins = [p for n in names for p in _story(ElementTree.fromstring(z.read(n)))]
        root = ElementTree.fromstring(z.read("word/document.xml"))
    boxes = [p for box in root.iter(W + "txbxContent") for p in _story(box)]
    parts = [*dict.fromkeys(margins), *_story(root.find(W + "body")), *dict.fromkeys(boxes)]
    return "\n\n".join(parts)


def _shape_texts(node) -> list[str]:
    """Texts of shapes in order, groups flattened, table rows joined."""
    out = []
    for child in node:
        if child.tag in (P + "sp", A + "tc"):
            paras = ["".join(t.text or "" for t in p.iter(A + "t")) for p in child.iter(A + "p")]
            text = "\n".join(p.strip() for p in paras if p.strip())
            if text:
                out.append(text)
        elif child.tag == A + "tr":
            cells = _shape_texts(child)
            if cells:
                out.append(" | ".join(cells))
        else:
            out += _shape_texts(child)
    return out


def pptx_pages(data: bytes) -> list[tuple[int, str]]:
    """One page per slide: shapes, tables, then the notes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        slides = sorted(
            (int(m[1]), n) for n in names if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n))
        )
        pages = []
        for number, name in slides:
            parts = _shape_texts(ElementTree.fromstring(z.read(name)))
            rels = f"ppt/slides/_rels/slide{number}.xml.rels"
            if rels in names:
                for target in re.findall(r'Target="\.\./(notesSlides/[^"]+)"', z.read(rels).decode()):
                    notes = _shape_texts(ElementTree.fromstring(z.read(f"ppt/{target}")))
                    notes = [t for t in notes if not t.isdigit()]
                    if notes:
                        parts.append("[备注] " + "\n".join(notes))
            pages.append((number, "\n".join(parts)))
    return pages
