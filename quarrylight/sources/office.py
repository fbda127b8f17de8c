"""Text of Word, PowerPoint and PDF files, by the standard library alone; each reader turns a file's bytes into (page, text)."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
import zlib
from xml.etree import ElementTree

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarrylight.functions import text as T
from quarrylight.sources.files import register_handler

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DRAW = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SLIDE = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Recognised text of a lower confidence is left out.
OCR_FLOOR = 0.35

Pages = list[tuple[int | None, str]]


def _lines(text: str) -> str:
    """Squeezed lines, blank ones at most one after another."""
    return re.sub("\n{3,}", "\n\n", "\n".join(" ".join(x.split()) for x in text.split("\n"))).strip("\n")


def _word_text(element) -> str:
    out = []
    for e in element.iter():
        if e.tag == f"{WORD}t":
            out.append(e.text or "")
        elif e.tag == f"{WORD}tab":
            out.append("\t")
        elif e.tag in (f"{WORD}br", f"{WORD}cr"):
            out.append("\n")
    return "".join(out)


def docx(data: bytes) -> Pages:
    """Paragraphs that are not blank, then a line for each table row, cells joined by " | "; one page without a number."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
    if body is None:
        return []
    parts = [t for t in (_word_text(p) for p in body.findall(f"{WORD}p")) if t.strip()]
    for row in (r for table in body.findall(f"{WORD}tbl") for r in table.findall(f"{WORD}tr")):
        cells = ("\n".join(_word_text(p) for p in cell.findall(f"{WORD}p")).strip() for cell in row.findall(f"{WORD}tc"))
        parts.append(" | ".join(c for c in cells if c))
    return [(None, "\n".join(p for p in parts if p))]


def _targets(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Of a part's relations by id: the kind and the part that it points to."""
    folder, name = posixpath.split(part)
    path = f"{folder}/_rels/{name}.rels"
    if path not in z.namelist():
        return {}
    found = ElementTree.fromstring(z.read(path))
    return {r.get("Id", ""): (r.get("Type", "").rsplit("/", 1)[-1], posixpath.normpath(posixpath.join(folder, r.get("Target", ""))).lstrip("/")) for r in found}


def _shape_text(root, notes: bool = False) -> list[str]:
    """The paragraphs of all shapes, groups and tables in order; of a notes page only those of its body."""
    out = []
    for shape in root.iter():
        if shape.tag not in (f"{SLIDE}sp", f"{SLIDE}graphicFrame"):
            continue
        kind = shape.find(f".//{SLIDE}ph")
        if notes and (kind is None or kind.get("type") != "body"):
            continue
        out += ["".join(t.text or "" for t in p.iter(f"{DRAW}t")) for p in shape.iter(f"{DRAW}p")]
    return [t for t in out if t.strip()]


def pptx(data: bytes) -> Pages:
    """A page for each slide that holds text, with its speaker's notes."""
    pages: Pages = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        show = ElementTree.fromstring(z.read("ppt/presentation.xml"))
        to = _targets(z, "ppt/presentation.xml")
        order = [to[s.get(f"{RELATION}id", "")][1] for s in show.iter(f"{SLIDE}sldId") if s.get(f"{RELATION}id", "") in to]
        for number, part in enumerate(order, 1):
            parts = _shape_text(ElementTree.fromstring(z.read(part)))
            for kind, target in _targets(z, part).values():
                if kind == "notesSlide" and target in z.namelist():
                    parts += _shape_text(ElementTree.fromstring(z.read(target)), notes=True)
            if text := _lines("\n".join(parts)):
                pages.append((number, text))
    return pages


_OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_SHOWN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\]()]+|-?\d*\.?\d+|[A-Za-z'\"*]+|[\[\]]", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class _Pdf:
    """The objects of a file: its own and those in its object streams. Encrypted files and fonts without a map to Unicode beyond one byte are beyond it."""

    def __init__(self, data: bytes):
        self.objects = {int(m[1]): m[2] for m in _OBJECT.finditer(data)}
        for body in list(self.objects.values()):
            if b"/ObjStm" in body:
                inner, first = self.stream(body), re.search(rb"/First\s+(\d+)", body)
                head = [int(x) for x in inner[: int(first[1])].split()] if first else []
                for k in range(0, len(head) - 1, 2):
                    end = head[k + 3] if k + 3 < len(head) else len(inner) - int(first[1])
                    self.objects.setdefault(head[k], inner[int(first[1]) + head[k + 1] : int(first[1]) + end])

    def stream(self, body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m:
            return b""
        if b"/FlateDecode" not in body[: m.start()]:
            return m[1]
        try:
            return zlib.decompressobj().decompress(m[1])
        except zlib.error:
            return b""

    def value(self, body: bytes, key: bytes) -> bytes:
        """The text behind a key: an object that it refers to, a dictionary or an array, or what stands there."""
        m = re.search(rb"/" + key + rb"(?![A-Za-z])\s*", body)
        if not m:
            return b""
        rest = body[m.end() :]
        if ref := _REF.match(rest):
            return self.objects.get(int(ref[1]), b"")
        for opening, closing in ((b"<<", b">>"), (b"[", b"]")):
            if rest.startswith(opening):
                depth = 0
                for t in re.finditer(re.escape(opening) + b"|" + re.escape(closing), rest):
                    depth += 1 if t[0] == opening else -1
                    if not depth:
                        return rest[: t.end()]
        return re.split(rb"[\s/>]", rest.lstrip(b"/"), maxsplit=1)[0]

    def pages(self) -> list[bytes]:
        """Page objects in the order of the page tree."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), b"")
        out, seen = [], set()

        def walk(body: bytes, inherited: bytes) -> None:
            fonts = self.value(body, b"Resources") or inherited
            if re.search(rb"/Type\s*/Page\b", body):
                out.append((body, fonts))
            for ref in _REF.findall(self.value(body, b"Kids")):
                if ref not in seen:
                    seen.add(ref)
                    walk(self.objects.get(int(ref), b""), fonts)

        walk(self.value(root, b"Pages"), b"")
        return out

    def maps(self, resources: bytes) -> dict[bytes, dict[bytes, str]]:
        """For each font that has one, its map from codes to text."""
        found = {}
        for name, ref in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", self.value(resources, b"Font")):
            table = self.stream(self.value(self.objects.get(int(ref), b""), b"ToUnicode"))
            if not table:
                continue
            own: dict[bytes, str] = {}
            text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
            for part in re.findall(rb"beginbfchar(.*?)endbfchar", table, re.S):
                own |= {bytes.fromhex(a.decode()): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part)}
            for part in re.findall(rb"beginbfrange(.*?)endbfrange", table, re.S):
                for a, b, c in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
                    for k in range(min(int(b, 16) - int(a, 16) + 1, 65536)):
                        own[(int(a, 16) + k).to_bytes(len(a) // 2, "big")] = text(c)[:-1] + chr(ord(text(c)[-1]) + k)
            found[name] = own
        return found

    def text(self, page: bytes, resources: bytes) -> str:
        contents = self.value(page, b"Contents")
        refs = _REF.findall(contents) if contents.startswith(b"[") else []
        data = b"\n".join(self.stream(self.objects.get(int(r), b"")) for r in refs) if refs else self.stream(contents)
        maps, own, held, out = self.maps(resources), {}, [], []
        for m in _SHOWN.finditer(data):
            token = m[0]
            if token[:1] in b"(<":
                held.append(self.shown(token, own))
            elif token[:1] == b"/":
                own = maps.get(token[1:], own) if token[1:] in maps else own
            elif re.fullmatch(rb"-?\d*\.?\d+", token):
                if held and float(token) < -200:  # a wide gap within TJ
                    held.append(" ")
            elif token in (b"Tj", b"TJ"):
                out.append("".join(held))
                held = []
            elif token in (b"'", b'"'):
                out.append("\n" + "".join(held))
                held = []
            elif token in (b"Td", b"TD", b"T*", b"ET", b"Tm"):
                out.append("\n")
                held = []
            elif token.isalpha():
                held = []
        return "".join(out)

    @staticmethod
    def shown(token: bytes, own: dict[bytes, str]) -> str:
        if token[:1] == b"<":
            digits = re.sub(rb"\s", b"", token[1:-1]).decode()
            raw = bytes.fromhex(digits + "0" * (len(digits) % 2))
        else:
            raw = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: _ESCAPES.get(m[1], b"" if m[1].strip() == b"" else bytes([int(m[1], 8) & 255]) if m[1].isdigit() else m[1]), token[1:-1], flags=re.S)
        if not own:
            return raw.decode("latin-1")
        n = max(map(len, own))
        return "".join(own.get(raw[k : k + n], "") for k in range(0, len(raw), n))


def pdf(data: bytes) -> Pages:
    """A page for each page that holds text; words that a line end cuts are joined. A scanned page has no text here."""
    file = _Pdf(data)
    pages: Pages = []
    for number, (page, resources) in enumerate(file.pages(), 1):
        text = _lines(re.sub(r"(\w)-\n(\w)", r"\1\2", file.text(page, resources)))
        if text.strip():
            pages.append((number, text))
    return pages


def recognised(results: Column, floor: float = OCR_FLOOR) -> Column:
    """The text of recognised lines (an array of structs ``text``, ``confidence``; null confidence counts as 1) that are sure enough, a line each."""
    sure = F.filter(results, lambda r: (F.coalesce(r["confidence"], F.lit(1.0)) >= floor) & (F.trim(F.coalesce(r["text"], F.lit(""))) != ""))
    return T.clean_extracted(F.array_join(F.transform(sure, lambda r: F.trim(r["text"])), "\n"))


for _suffix, _reader in {"docx": docx, "pptx": pptx, "pptm": pptx, "ppsx": pptx, "potx": pptx, "pdf": pdf}.items():
    register_handler(_suffix, _reader)
