"""A lexical XML tokenizer over bytes that keeps every byte of what it reads.

References are tokens of their own and aren't resolved, so undefined ones do no harm, and records come out verbatim.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from ..errors import InvalidConfiguration, XmlError

START, END, EMPTY, TEXT, CDATA, REF, OTHER = range(7)
#: kind, name or text, the token's bytes, where the token ends
Token = tuple[int, bytes, bytes, int]

_MARKUP = re.compile(
    rb"<!--(?P<comment>.*?)-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?.*?\?>|<!(?!--|\[CDATA\[)(?:[^<>\[\"']|\"[^\"]*\"|'[^']*'|\[[^\]]*\]|<[^>]*>)*>"
    rb"|</(?P<end>[^\s<>/]+)\s*>|<(?P<start>[^\s<>/!?=\"']+)(?P<attributes>(?:[^<>\"'/]|\"[^\"]*\"|'[^']*'|/(?!>))*)(?P<empty>/?)>",
    re.S,
)
_REFERENCE = re.compile(rb"&[^;\s<&]{1,64};")
_ATTRIBUTE = re.compile(rb"([^\s=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
CHUNK = 1 << 20


def tokens(read: Callable[[int], bytes], check_names: bool = True, limit: int | None = None, inside: bool = False) -> Iterator[Token]:
    """Tokens of what ``read`` yields, in bounded memory: a chunk, and the token at hand.

    Mismatched end tags are errors if ``check_names``; elements left open at the end are not, nor are ends of elements that were begun
    before where reading begins ``inside`` a document. ``limit`` bounds a single token.
    """
    data, at, base, ended = b"", 0, 0, False
    names: list[bytes] = []

    def more() -> None:
        nonlocal data, at, base, ended
        new = read(CHUNK)
        if not new:
            ended = True
        base, data, at = base + at, data[at:] + new, 0
        if limit is not None and len(data) > limit + 2 * CHUNK:
            raise InvalidConfiguration(f"record exceeded max_record_bytes ({limit})")

    while True:
        if at >= len(data):
            if ended:
                return
            more()
            continue
        if data[at] == 60:  # <
            m = _MARKUP.match(data, at)
            if m is None:
                if ended:
                    raise XmlError(f"unclosed or malformed markup at byte {base + at}")
                more()
                continue
            at = m.end()
            raw = m.group()
            if (name := m.group("start")) is not None:
                if m.group("empty"):
                    yield EMPTY, name, raw, base + at
                else:
                    names.append(name)
                    yield START, name, raw, base + at
            elif (name := m.group("end")) is not None:
                if check_names:
                    if not names and inside:
                        continue
                    if not names or names[-1] != name:
                        raise XmlError(f"unexpected end tag {name.decode('utf-8', 'replace')} at byte {base + at}")
                    names.pop()
                yield END, name, raw, base + at
            elif (text := m.group("cdata")) is not None:
                yield CDATA, text, raw, base + at
            else:
                yield OTHER, b"", raw, base + at
            continue
        if data[at] == 38:  # &
            m = _REFERENCE.match(data, at)
            if m is None and not ended and data.find(b";", at) < 0 and len(data) - at < 80:
                more()
                continue
            if m is not None:
                at = m.end()
                yield REF, m.group()[1:-1], m.group(), base + at
                continue
        stop = [p for p in (data.find(b"<", at), data.find(b"&", at + 1)) if p >= 0]
        if not stop and not ended:
            grown = len(data) - at
            more()
            if len(data) - at == grown and not ended:
                continue
            if not ended:
                continue
            stop = []
        end = min(stop) if stop else len(data)
        raw = data[at:end]
        at = end
        yield TEXT, raw, raw, base + at


def tokens_of(data: bytes, check_names: bool = True) -> Iterator[Token]:
    position = 0

    def read(n: int) -> bytes:
        nonlocal position
        part = data[position : position + n]
        position += len(part)
        return part

    return tokens(read, check_names)


def attributes(start_tag: bytes) -> dict[bytes, bytes]:
    return {m.group(1): m.group(2) if m.group(2) is not None else m.group(3) for m in _ATTRIBUTE.finditer(start_tag)}


def records(read: Callable[[int], bytes], element: str, max_bytes: int, inside: bool = False) -> Iterator[tuple[bytes, int]]:
    """Each element of this name, outermost ones only, as its bytes, and the position after it, counted from where reading begins.

    Empty elements are no records. A record of more than ``max_bytes``, or one cut off by the end, is an error.
    """
    wanted = element.encode()
    parts: list[bytes] = []
    depth = size = 0
    for kind, name, raw, end in tokens(read, limit=max_bytes, inside=inside):
        if depth == 0:
            if kind != START or name != wanted:
                continue
            parts, size = [], 0
        parts.append(raw)
        size += len(raw)
        if size > max_bytes:
            raise InvalidConfiguration(f"record exceeded max_record_bytes ({max_bytes})")
        depth += (kind == START) - (kind == END)
        if depth == 0:
            yield b"".join(parts), end
    if depth:
        raise InvalidConfiguration("unexpected end of input inside record")
