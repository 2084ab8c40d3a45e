"""The text of word-processor files: zipped XML (docx) and rich text (rtf)."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

#: The namespace of a docx's body, and what its elements stand for.
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_MARKS = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n", f"{_WORD}noBreakHyphen": "-"}
#: Groups of rich text that hold no text, and the words that stand for characters.
_ASIDE = frozenset("fonttbl colortbl stylesheet info pict header headerl headerr headerf footer footerl footerr footerf themedata colorschememapping listtable listoverridetable rsidtbl generator datastore latentstyles xmlnstbl object fldinst".split())
_CHARACTERS = {"par": "\n", "line": "\n", "sect": "\n", "page": "\n", "row": "\n", "tab": "\t", "cell": "\t", "emdash": "—", "endash": "–", "lquote": "‘", "rquote": "’", "ldblquote": "“", "rdblquote": "”", "bullet": "•", "emspace": " ", "enspace": " "}
_TOKEN = re.compile(rb"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z'])|([{}])|[\r\n]+|([^\\{}\r\n]+)")


def docx_text(data: bytes) -> str:
    """The paragraphs of a docx's body, a line each; a paragraph within another (of a text box) comes before the line that holds it."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml"))
    lines: list[str] = []
    open_: list[list[str]] = []

    def walk(node: ElementTree.Element) -> None:
        if node.tag == f"{_WORD}p":
            open_.append([])
        elif node.tag == f"{_WORD}t" and open_:
            open_[-1].append(node.text or "")
        elif node.tag in _MARKS and open_:
            open_[-1].append(_MARKS[node.tag])
        elif node.tag in (f"{_WORD}delText", f"{_WORD}instrText"):
            return
        for child in node:
            walk(child)
        if node.tag == f"{_WORD}p":
            lines.append("".join(open_.pop()))

    walk(body)
    return "\n".join(lines)


def rtf_text(data: bytes) -> str:
    """The text of rich text: its characters in their code page (1252 unless it says otherwise) and by Unicode number, without groups that hold none."""
    if not data.lstrip().startswith(b"{\\rtf"):
        raise ValueError("no rich text")
    page = re.search(rb"\\ansicpg(\d+)", data[:400])
    encoding = f"cp{page[1].decode()}" if page else "cp1252"
    out: list[str] = []
    raw = bytearray()
    # Of each open group: whether its text counts, and how many characters stand for a Unicode number.
    groups: list[tuple[bool, int]] = []
    counts, width, skip, first = True, 1, 0, False

    def flush() -> None:
        if raw:
            out.append(raw.decode(encoding, errors="replace"))
            raw.clear()

    for m in _TOKEN.finditer(data):
        word, number, code, symbol, brace, plain = m.groups()
        begins, first = first, False
        if brace == b"{":
            groups.append((counts, width))
            first, skip = True, 0
        elif brace == b"}":
            counts, width = groups.pop() if groups else (counts, width)
            skip = 0
        elif word is not None:
            name, n = word.decode(), int(number) if number else None
            if begins and name in _ASIDE:
                counts = False
            elif name == "uc":
                width = n if n is not None else 1
            elif name == "u" and n is not None and counts:
                flush()
                out.append(chr(n % 65536))
                skip = width
            elif name in _CHARACTERS and counts:
                flush()
                out.append(_CHARACTERS[name])
        elif code is not None:
            if skip:
                skip -= 1
            elif counts:
                raw.append(int(code, 16))
        elif symbol is not None:
            if symbol == b"*":
                counts = False
            elif skip:
                skip -= 1
            elif counts:
                flush()
                out.append({b"~": "\xa0", b"_": "-", b"-": ""}.get(symbol, symbol.decode("latin-1")))
        elif plain is not None:
            gone = min(skip, len(plain))
            skip -= gone
            if counts:
                raw.extend(plain[gone:])
    flush()
    text = "".join(out)
    return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # numbers come in halves of pairs


def file_text(name: str, data: bytes) -> tuple[str, str | None]:
    """The text of a file by its name's ending, and a note where it could not be read: then the text is empty."""
    from .html import main_content

    ending = name.rsplit(".", 1)[-1].lower()
    try:
        if ending == "docx":
            return docx_text(data), None
        if ending == "rtf":
            return rtf_text(data), None
        if ending == "doc":
            return (rtf_text(data), None) if data.lstrip().startswith(b"{\\rtf") else ("", "old binary documents are not read")
        text = data.decode("utf-8-sig", errors="replace")
        return (main_content(text) if ending in ("html", "htm") else text), None
    except Exception as e:  # whatever a broken file brings about
        return "", f"{type(e).__name__}: {e}"
