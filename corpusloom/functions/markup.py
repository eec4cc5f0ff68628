"""Well-formedness and character data of single records."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from xml.parsers import expat


def xml_text(data: bytes | None, only: tuple[str, ...] | None = None) -> str | None:
    """Character data of a well-formed XML record, CDATA included and references decoded, without comments and attributes.

    A newline stands wherever an element starts or ends, so texts of different elements stay apart. ``only`` keeps what is
    inside top-level children of these names. None for null or ill-formed records.
    """
    if data is None:
        return None
    parts: list[str] = []
    add = parts.append
    parser = expat.ParserCreate()
    parser.buffer_text = True
    if only is None:
        parser.StartElementHandler = lambda name, attributes: add("\n")
        parser.EndElementHandler = lambda name: add("\n")
        parser.CharacterDataHandler = add
    else:
        depth, inside = 0, False

        def start(name: str, attributes: dict) -> None:
            nonlocal depth, inside
            if depth == 1:
                inside = name in only
            depth += 1
            if inside:
                add("\n")

        def end(name: str) -> None:
            nonlocal depth, inside
            depth -= 1
            if inside:
                add("\n")
            if depth == 1:
                inside = False

        parser.StartElementHandler, parser.EndElementHandler = start, end
        parser.CharacterDataHandler = lambda text: add(text) if inside else None
    try:
        parser.Parse(data, True)
    except (expat.ExpatError, ValueError):
        return None
    return "".join(parts)


def xml_elements(data: bytes | None, names: tuple[str, ...]) -> list[tuple[str, str]] | None:
    """Name and character data of each element of these names at any depth, in document order; None if ill-formed."""
    if data is None:
        return None
    out: list[tuple[str, list[str]]] = []
    open_: list[list[str]] = []
    parser = expat.ParserCreate()
    parser.buffer_text = True

    def start(name: str, attributes: dict) -> None:
        if name in names:
            out.append((name, text := []))
            open_.append(text)

    def end(name: str) -> None:
        if name in names:
            open_.pop()

    def characters(text: str) -> None:
        if open_:
            open_[-1].append(text)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    try:
        parser.Parse(data, True)
    except (expat.ExpatError, ValueError):
        return None
    return [(name, "".join(text)) for name, text in out]


#: What a JSON text consists of; ``NAME`` and ``SCALAR`` come with a name, or with the value as a string (numbers as they are written, null as None).
OBJECT, OBJECT_END, ARRAY, ARRAY_END, NAME, SCALAR = range(6)
_BLANK = re.compile(r"[ \t\n\r]*")
_SCAN = json.JSONDecoder().scan_once


def json_events(text: str) -> Iterator[tuple[int, str | None]]:
    """The parts of a JSON text one after another, at any depth; ValueError where it isn't well-formed, after what stands before."""
    skip = _BLANK.match
    #: whether each open container is an object
    inside: list[bool] = []
    at = skip(text).end()
    while True:
        opened = text[at : at + 1]
        if opened in ("{", "["):
            is_object = opened == "{"
            yield (OBJECT if is_object else ARRAY), None
            at = skip(text, at + 1).end()
            if text[at : at + 1] != ("}" if is_object else "]"):
                inside.append(is_object)
                if is_object:
                    name, at = _json_name(text, at)
                    yield NAME, name
                continue
            at += 1
            yield (OBJECT_END if is_object else ARRAY_END), None
        else:
            try:
                value, end = _SCAN(text, at)
            except StopIteration:
                raise ValueError(f"no value at {at}") from None
            yield SCALAR, value if value is None or isinstance(value, str) else text[at:end]
            at = end
        while True:
            at = skip(text, at).end()
            if not inside:
                if at != len(text):
                    raise ValueError(f"more at {at}")
                return
            sign = text[at : at + 1]
            at += 1
            if sign == ",":
                at = skip(text, at).end()
                if inside[-1]:
                    name, at = _json_name(text, at)
                    yield NAME, name
                break
            if sign != ("}" if inside[-1] else "]"):
                raise ValueError(f"no end at {at - 1}")
            yield (OBJECT_END if inside.pop() else ARRAY_END), None


def _json_name(text: str, at: int) -> tuple[str, int]:
    """A name and where its value begins."""
    if text[at : at + 1] != '"':
        raise ValueError(f"no name at {at}")
    name, at = _SCAN(text, at)
    at = _BLANK.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError(f"no colon at {at}")
    return name, _BLANK.match(text, at + 1).end()


def is_json(data: bytes) -> bool:
    """Whether a record is well-formed JSON, of any depth."""
    try:
        text = data.decode("utf-8-sig")
        try:
            json.loads(text)
        except RecursionError:
            for _ in json_events(text):
                pass
    except ValueError:
        return False
    return True


def record_text(data: bytes | None, form: str | None) -> str | None:
    """The text of a record by its form (xml, json, txt): character data of XML, else the bytes as UTF-8, invalid bytes as U+FFFD.

    None for null bytes and for XML and JSON that isn't well-formed.
    """
    if data is None:
        return None
    if form == "xml":
        return xml_text(data)
    if form == "json" and not is_json(data):
        return None
    return data.decode("utf-8", "replace")
