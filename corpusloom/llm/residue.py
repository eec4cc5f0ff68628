"""HTML, Markdown, wiki and LaTeX markup in texts: what stands there, and the text as clean blocks.

A text becomes runs of clean text and, over these, a tree: the elements of its HTML, and its blocks (headings, lists with their items, code, formulas,
tables with their rows, paragraphs). Each run and element says which markup stood in it. Every subtree is hashed and counted per host; subtrees that recur in
many items of their host are its template and are deleted. What is left is rendered in one plain notation in which the kinds of block can
still be told.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.entities import html5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidConfiguration
from ..session import checkpoint, map_arrow, written

KINDS = ("html", "markdown", "wiki", "latex")

# The elements of HTML, and commands of LaTeX that take no argument.
_HTML_ELEMENTS = frozenset(
    "a abbr acronym address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd label legend li link main map mark menu meta meter nav noframes noscript object ol optgroup option output p param picture pre progress q rp rt ruby s samp script search section select slot small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr".split()
)
_BARE = "item|hline|alpha|beta|gamma|delta|epsilon|lambda|mu|nu|pi|rho|sigma|tau|phi|omega|theta|infty|partial|nabla|cdot|times|leq|geq|neq|approx|equiv|pm|sum|prod|int|ldots|dots|quad|qquad|noindent|par|maketitle|centering|toprule|midrule|bottomrule|LaTeX|TeX|newline|newpage|bigskip|medskip|smallskip|left|right|langle|rangle|rightarrow|to|in|tableofcontents"

_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)((?:\s[^<>]*)?)/?>")
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|-->|<!DOCTYPE[^>]*>", re.S | re.I)
_REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_FENCE = re.compile(r"^[ ]{0,3}(```+|~~~+)(?!~*\s*\S*~~)[^\n`]*\n(.*?)(?:^[ ]{0,3}\1[ \t]*$|\Z)|^[ ]{0,3}(?:```+|~~~+)[ \t]*[\w+-]*[ \t]*$", re.S | re.M)
_PRE = re.compile(r"<(pre|script|style|code|syntaxhighlight|source|math|nowiki)\b[^<>]*(?<!/)>(.*?)</\1\s*>", re.S | re.I)
_VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted)\*?\}(.*?)(?:\\end\{\1\*?\}|\Z)", re.S)
_CODE_SPAN = re.compile(r"(?<!`)(`{1,2})(?!`)([^`\n]+)\1(?!`)")
_FORMULA = re.compile(
    r"\$\$.+?\$\$|\\\[.+?\\\]|\\\(.+?\\\)|\\begin\{(equation|align|gather|multline|displaymath|math|eqnarray)(\*?)\}.*?(?:\\end\{\1\2\}|\Z)"
    r"|(?<![\\$\w])\$(?=[^\s$])(?:[^$\n\\]|\\.)+?(?<=[^\s\\])\$(?![\d$])",
    re.S,
)
_COMMAND = re.compile(rf"(?<![\w:\\/.])\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{{|\\(?:begin|end)\{{|(?<![\w:\\/.])\\(?:{_BARE})(?![A-Za-z\\])|&[^&\n]*\\\\\s*(?:$|\\hline)|\\[()\[\]]", re.M)
_MATHS = re.compile(r"[\\^_=+<>{}]|^[A-Za-z]\w?(?:\([A-Za-z]\))?$|[A-Za-z0-9]\s*[-*/]\s*[A-Za-z0-9]")
#: Signs that make a text worth a look, and the mark they may belong to.
_WIKI = (
    ("[[", re.compile(r"\[\[")),
    ("]]", re.compile(r"\]\]")),
    ("{{", re.compile(r"\{\{")),
    ("}}", re.compile(r"\}\}")),
    ("''", re.compile(r"''")),
    ("{|", re.compile(r"^\s*\{\|", re.M)),
    ("|}", re.compile(r"^\s*\|\}", re.M)),
    ("|-", re.compile(r"^\|-(?![-:| \t]*\|)", re.M)),
    ("==", re.compile(r"^={2,6}[ \t]*[^=\s][^\n]*?={2,6}[ \t]*$", re.M)),
    ("://", re.compile(r"\[(?:https?|ftp)://[^\s\]]+(?:\s[^\]\n]*)?\](?!\()")),
    ("#REDIRECT", re.compile(r"^#REDIRECT\b", re.M)),
    ("TOC__", re.compile(r"__(?:NO|FORCE)?TOC__")),
    ("~~~~", re.compile(r"(?<=[^\s~])[ \t]*~{4,5}(?!~)")),
)
_MARKDOWN = (
    ("#", re.compile(r"^[ ]{0,3}#{1,6}[ \t]+\S(?!.*'')", re.M)),
    ("**", re.compile(r"\*\*(?=\S)[^*\n]+?(?<=\S)\*\*")),
    ("__", re.compile(r"(?<![\w_])__(?=[^\s_])[^\n]+?(?<=[^\s_])__(?![\w_])")),
    ("*", re.compile(r"(?<![\w*])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*])")),
    ("_", re.compile(r"(?<![\w_/\\.])_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?![\w_])")),
    ("](", re.compile(r"!?\[[^\]\[\n]*\]\([^()\s]*(?:\([^()\s]*\)[^()\s]*)*(?:\s+\"[^\"\n]*\")?\)")),
    ("]:", re.compile(r"^[ ]{0,3}\[[^\]\n]+\]:[ \t]*\S+", re.M)),
    ("][", re.compile(r"\[[^\]\[\n]+\]\[[^\]\[\n]*\]")),
    (">", re.compile(r"^[ ]{0,3}>[ \t]?\S", re.M)),
    ("[", re.compile(r"^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]", re.M)),
    ("--", re.compile(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*\|[ \t]*(?::?-{2,}:?[ \t]*\|?[ \t]*)*$", re.M)),
    ("~~", re.compile(r"~~(?=\S)[^~\n]+~~")),
    ("[^", re.compile(r"\[\^[^\]\n]+\]")),
    ("---", re.compile(r"^[^\n|]*\w[^\n|]*\n-{3,}[ \t]*$", re.M)),
    ("===", re.compile(r"^[^\n|]*\w[^\n|]*\n={3,}[ \t]*$", re.M)),
    ("<http", re.compile(r"<https?://[^\s<>]+>")),
)
#: Without any of these there is no markup at all but setext headings.
_ANY = re.compile(r"[<>\\$`*_\[{}#|&~]|''|==|---")


def _has(marks: tuple, text: str) -> bool:
    return any(sign in text and pattern.search(text) for sign, pattern in marks)


_WIKI_INLINE = re.compile(r"\[\[[^\]\n]*\]\]|'{2,5}|\[(?:https?|ftp)://[^\]\n]*\](?!\()")
_WIKI_BLOCK = re.compile(r"^\s*\{\|.*?(?:^\s*\|\}|\Z)|\{\{[^{}]*\}\}", re.S | re.M)
_MARKED_LINE = re.compile(r"^.*\x03.*$", re.M)
_LINE_SIGNS = re.compile(r"^[ ]*[#*:;]+")
_COMMAND_WITH_ARGUMENTS = re.compile(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})*")


@dataclass
class Marked:
    """A text with its code and formulas lifted out, and what markup was met."""

    kinds: set[str]
    text: str
    #: kind of block or span, its body, the language that it was marked in
    lifted: list[tuple[str, str, str]]


def _is_math(body: str) -> bool:
    return bool(_MATHS.search(body))


def scan(text: str) -> Marked:
    """The kinds of markup in a text.

    Code, formulas and tags are lifted out first, so signs inside them count for what surrounds them; then wiki marks, whose lines
    are taken from what Markdown may claim.
    """
    kinds: set[str] = set()
    lifted: list[tuple[str, str, str]] = []

    def keep(kind: str, body: str, language: str) -> str:
        lifted.append((kind, body, language))
        return f"\x01{len(lifted) - 1}\x02"

    def verbatim(m: re.Match[str]) -> str:
        kinds.add("latex")
        return "\n" + keep("code", m.group(2), "latex") + "\n"

    def fence(m: re.Match[str]) -> str:
        kinds.add("markdown")
        return "\n" + keep("code", m.group(2) or "", "markdown") + "\n"

    def pre(m: re.Match[str]) -> str:
        name = m.group(1).lower()
        language = "html" if name in _HTML_ELEMENTS and name != "source" else "wiki"
        kinds.add(language)
        if name in ("script", "style"):
            return " "
        body = m.group(2)
        if name == "math":
            return keep("formula", body, language)
        if name == "nowiki":
            return keep("plain", body, language)
        if _REFERENCE.search(body):
            kinds.add("html")
        body = html.unescape(_TAG.sub("", body))
        return "\n" + keep("code", body, language) + "\n" if name == "pre" or "\n" in body else keep("span", body, language)

    def formula(m: re.Match[str]) -> str:
        body = m.group()
        if body[0] == "$" and body[1] != "$" and not _is_math(body[1:-1]):
            return body
        kinds.add("latex")
        return ("\n" + keep("formula", body, "latex") + "\n") if body.startswith(("$$", "\\[", "\\begin")) else keep("formula", body, "latex")

    def span(m: re.Match[str]) -> str:
        kinds.add("markdown")
        return keep("span", m.group(2), "markdown")

    if not _ANY.search(text):
        return Marked(kinds, text, lifted)
    if "\\begin{" in text:
        text = _VERBATIM.sub(verbatim, text)
    if "```" in text or "~~~" in text:
        text = _FENCE.sub(fence, text)
    if "<" in text:
        if "<!" in text or "-->" in text:
            new = _COMMENT.sub(" ", text)
            if new != text:
                kinds.add("html")
                text = new
        if "</" in text:
            text = _PRE.sub(pre, text)
    if "$" in text or "\\" in text:
        text = _FORMULA.sub(formula, text)
        if "\\" in text and _COMMAND.search(text):
            kinds.add("latex")
    if "`" in text:
        text = _CODE_SPAN.sub(span, text)
    if "<" in text:
        for m in _TAG.finditer(text):
            kinds.add("html" if m.group(2).lower() in _HTML_ELEMENTS else "wiki")
            if len(kinds) == 4:
                break
    if "&" in text:
        for m in _REFERENCE.finditer(text):
            if m.group()[1] == "#" or m.group()[1:] in html5:
                kinds.add("html")
                break
    bare = _TAG.sub(" ", text) if "<" in text else text
    if "latex" in kinds and "\\" in bare:
        bare = _COMMAND_WITH_ARGUMENTS.sub(" ", bare)
    if _has(_WIKI, bare):
        kinds.add("wiki")
        bare = _WIKI_INLINE.sub("\x03", bare)
        bare = _MARKED_LINE.sub(lambda m: _LINE_SIGNS.sub("", m.group()).replace("\x03", " "), bare)
        bare = _WIKI_BLOCK.sub(" ", bare)
    if "markdown" not in kinds and _has(_MARKDOWN, bare):
        kinds.add("markdown")
    return Marked(kinds, text, lifted)


# --- the tree -------------------------------------------------------------------------------------------------------------------

#: Signs at the start of a line: a heading, a list item, a table row.
_HEAD, _ITEM, _ROW = "\x04", "\x05", "\x06"
#: Signs left where markup of each language stood; bit k of marks is for the k-th of ``KINDS``.
_MARKS = "\x10\x11\x12\x13"
_HTML_MARK, _MARKDOWN_MARK, _WIKI_MARK, _LATEX_MARK = _MARKS
_BIT = {kind: 1 << k for k, kind in enumerate(KINDS)}
#: The signs above, and those that number tags and what is lifted out, are no text.
_RESERVED = re.compile("[\x00-\x08\x0e-\x1f]")
_BLANK = re.compile(r"[ \t]+")


#: Elements that stand apart from what is around them, other than headings, items and parts of tables.
_PARTING = frozenset(
    "address article aside blockquote body caption center details dialog dir div dl fieldset figcaption figure footer form head header hgroup hr html label legend "
    "main menu nav noscript ol optgroup option p pre search section summary table template title ul".split()
)
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements without an end.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end where one of their like begins, unless a container of theirs was begun in between.
_LIKE = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "p": ("p",)}
_HOLDERS = frozenset("ul ol menu dir table dl select blockquote div section article aside nav main form fieldset header footer body".split())


@dataclass
class _Tag:
    name: str
    closing: bool
    empty: bool
    mark: str


def _html_lines(text: str) -> tuple[str, list[_Tag]]:
    """The text with its tags numbered, broken into lines as they ask for; and the tags."""
    tags: list[_Tag] = []

    def tag(m: re.Match[str]) -> str:
        closing, name = bool(m.group(1)), m.group(2).lower()
        tags.append(_Tag(name, closing, name in _VOID or m.group().endswith("/>"), "html" if name in _HTML_ELEMENTS else "wiki"))
        at = f"\x0e{len(tags) - 1}\x0f"
        # tags that break lines stand on lines of their own, so that what is around them is still whole lines
        if name in _HEADINGS:
            return f"{at}\n\n" if closing else f"\n\n{at}\n{_HEAD}"
        if name == "li":
            return at if closing else f"\n{at}\n{_ITEM}"
        if name == "tr":
            return at if closing else f"\n{at}\n{_ROW}"
        if name in ("td", "th"):
            return at if closing else f"{at}\t"
        if name in ("br", "dt", "dd"):
            return f"\n{at}\n"
        return f"\n\n{at}\n\n" if name in _PARTING else at

    def reference(m: re.Match[str]) -> str:
        own = m.group()
        return own + _HTML_MARK if own[1] == "#" or own[1:] in html5 else own

    text = _TAG.sub(tag, text)
    return html.unescape(_REFERENCE.sub(reference, text)) if "&" in text else text, tags


_REF = re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref>", re.S | re.I)
_FILE = re.compile(r"\[\[(?:File|Image|Category|Datei|Kategorie|Fichier|Catégorie|Archivo|Categoría):[^\[\]]*(?:\[\[[^\[\]]*\]\][^\[\]]*)*\]\]", re.I)


def _template(content: str) -> str:
    name, *rest = content.split("|")
    if name.strip().lower().startswith(("lang", "transl")) and rest:
        return _WIKI_MARK + rest[-1]
    if "\n" in content:
        return f"\n{_WIKI_MARK}\n" + "".join(f"{_ROW}{r.strip().replace('=', chr(9), 1)}\n" for r in rest if r.strip()) + "\n"
    return _WIKI_MARK


_BRACES = re.compile(r"\{\{|\}\}")


def _without_templates(text: str) -> str:
    """Templates of any depth replaced, the inner ones first, in one pass; braces that are not closed stay."""
    open_: list[list[str]] = [[]]
    at = 0
    for m in _BRACES.finditer(text):
        open_[-1].append(text[at : m.start()])
        at = m.end()
        if m.group() == "{{":
            open_.append([])
        elif len(open_) > 1:
            content = "".join(open_.pop())
            open_[-1].append(_template(content))
        else:
            open_[-1].append("}}")
    open_[-1].append(text[at:])
    return "{{".join("".join(parts) for parts in open_)


def _wiki_lines(text: str) -> str:
    mark = _WIKI_MARK
    text = _FILE.sub(mark, _REF.sub(mark, text))
    if "{{" in text:
        text = _without_templates(text)
    text = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", rf"{mark}\1", text)
    text = re.sub(r"\[(?:https?|ftp)://\S+?(?:\s+([^\]\n]*))?\](?!\()", lambda m: mark + (m.group(1) or ""), text)
    text = re.sub(r"'{2,5}", mark, text)
    text = re.sub(r"^={2,6}[ \t]*(.+?)[ \t]*={2,6}[ \t]*$", rf"\n{_HEAD}{mark}\1\n", text, flags=re.M)
    text = re.sub(r"^\s*(?:\{\|.*|\|\}|\|-.*|\|\+.*)$", mark, text, flags=re.M)
    text = re.sub(r"^[|!](?![}|])[ \t]*(.+)$", lambda m: _ROW + mark + re.sub(r"[ \t]*(?:\|\||!!)[ \t]*", "\t", m.group(1)), text, flags=re.M)
    return re.sub(r"^[ ]*[#*:;]+[ \t]*(?=\S)", _ITEM, text, flags=re.M)


def _markdown_lines(text: str) -> str:
    mark = _MARKDOWN_MARK
    text = re.sub(r"^([^\n|]*\w[^\n|]*)\n(?:={3,}|-{3,})[ \t]*$", rf"\n{_HEAD}{mark}\1\n", text, flags=re.M)
    text = re.sub(r"^[ ]{0,3}#{1,6}[ \t]+(.+?)[ \t]*#*$", rf"\n{_HEAD}{mark}\1\n", text, flags=re.M)
    text = re.sub(r"^[ ]{0,3}\[[^\]\n]+\]:[ \t]*\S+.*$", mark, text, flags=re.M)
    text = re.sub(r"!\[([^\]\n]*)\]\([^)\n]*\)", mark, text)
    text = re.sub(r"\[([^\]\[\n]*)\](?:\([^)\n]*\)|\[[^\]\[\n]*\])", rf"{mark}\1", text)
    text = re.sub(r"\[\^[^\]\n]+\]", mark, text)
    text = re.sub(r"\*\*(?=\S)([^*\n]+?)(?<=\S)\*\*|(?<![\w_])__(?=\S)([^\n]+?)(?<=\S)__(?![\w_])|~~(?=\S)([^~\n]+)~~", lambda m: mark + (m.group(1) or m.group(2) or m.group(3)), text)
    text = re.sub(r"(?<![\w*])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])|(?<![\w_/\\.])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?![\w_])", lambda m: mark + (m.group(1) or m.group(2)), text)
    text = re.sub(r"^[ ]{0,3}>[ \t]?", mark, text, flags=re.M)
    text = re.sub(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*\|[ \t]*(?::?-{2,}:?[ \t]*\|?[ \t]*)*$", mark, text, flags=re.M)
    text = re.sub(r"^[ \t]*\|(.+)\|[ \t]*$", lambda m: _ROW + mark + re.sub(r"[ \t]*\|[ \t]*", "\t", m.group(1).strip()), text, flags=re.M)
    return re.sub(r"^[ \t]*[-*+][ \t]+(?:\[[ xX]\][ \t]+)?(?=\S)", _ITEM, text, flags=re.M)


_ARGUMENTS = re.compile(r"(?<![\w:\\/.])\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{|[{}]")


def _without_commands(text: str) -> str:
    """Commands replaced by their arguments, at any depth, in one pass; a command that is not closed stays."""
    out: list[str] = []
    open_: list[int] = []  # places in ``out`` of braces, and of what was put for commands
    whole: dict[int, str] = {}
    at = 0
    for m in _ARGUMENTS.finditer(text):
        out.append(text[at : m.start()])
        at = m.end()
        sign = m.group()
        if sign == "}":
            command = open_ and open_.pop() in whole
            out.append("" if command else sign)
            continue
        open_.append(len(out))
        if sign == "{":
            out.append(sign)
        else:
            whole[len(out)] = sign
            out.append(_LATEX_MARK)
    for place in open_:
        out[place] = whole.get(place, "{")
    return "".join(out) + text[at:]


def _latex_lines(text: str) -> str:
    mark = _LATEX_MARK
    text = re.sub(r"\\(?:sub)*section\*?\{([^{}]*)\}", rf"\n\n{_HEAD}{mark}\1\n\n", text)
    text = re.sub(r"\\(?:label|cite[a-z]*|ref|footnote|url|includegraphics)\*?(?:\[[^\]\n]*\])?\{[^{}]*\}", mark, text)
    text = re.sub(r"^(.*&.*?)\\\\[ \t]*(?:\\hline)?[ \t]*$", lambda m: _ROW + mark + re.sub(r"[ \t]*&[ \t]*", "\t", m.group(1).strip()), text, flags=re.M)
    text = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\{[^{}]*\})?", f"\n{mark}\n", text)
    text = re.sub(r"[ \t]*\\item\b[ \t]*", f"\n{_ITEM}{mark}", text)
    text = _without_commands(text)
    return re.sub(rf"(?<![\w:\\/.])\\(?:{_BARE})(?![A-Za-z\\])[ \t]*", mark, text)


_TOKEN = re.compile(r"\x0e(\d+)\x0f|\x01(\d+)\x02")
_ALONE = re.compile(r"\s*\x01(\d+)\x02[.\s]*")
_SIGN = re.compile(f"[{_MARKS}{_HEAD}{_ITEM}{_ROW}]")
_SPECIAL = re.compile("[\x01-\x06\x0e-\x13]")
_TAG_SIGN = re.compile(r"\x0e\d+\x0f")
_NO_SIGNS = str.maketrans("", "", _MARKS + _HEAD + _ITEM + _ROW)


def _plain(text: str) -> str:
    return " ".join(text.split()).lower()


def _hash(kind: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{kind}\x00{_plain(text)}") - (1 << 63)


class _Element:
    __slots__ = ("digest", "first", "marks", "name", "words")

    def __init__(self, name: str, first: int, marks: int) -> None:
        self.name, self.first, self.marks, self.words = name, first, marks, 0
        self.digest = xxhash.xxh64(name)


@dataclass
class Tree:
    """A text in runs of clean text, and the subtrees over them."""

    #: Markup that stands in no run and no element.
    marks: int
    #: hash, first run, run after the last, marks of the element's own tags
    nodes: list[tuple[int, int, int, int]]
    #: block, line within it, kind of block, text, marks
    runs: list[tuple[int, int, str, str, int]]

    @property
    def kinds(self) -> set[str]:
        every = self.marks
        for n in self.nodes:
            every |= n[3]
        for r in self.runs:
            every |= r[4]
        return {k for k, bit in _BIT.items() if every & bit}


class _Builder:
    """Puts the tree together from lines; elements and blocks may overlap, as in broken HTML, since each is but a span of runs."""

    def __init__(self, lifted: list[tuple[str, str, str]], tags: list[_Tag]) -> None:
        self.lifted, self.tags = lifted, tags
        self.nodes: list[tuple[int, int, int, int]] = []
        self.runs: list[tuple[int, int, str, str, int]] = []
        self.open: list[_Element] = []
        self.names: Counter[str] = Counter()  # of the open elements
        self.marks = 0
        self.block = self.line = 0
        self.kind = ""
        self.began = 0  # first run of the block
        self.line_began = 0
        self.parts: list[int] = []  # hashes of the block's items or rows
        self.text: list[str] = []
        self.gap = ""
        self.bits = 0

    def mark(self, bits: int) -> None:
        if self.open:
            self.open[-1].marks |= bits
        else:
            self.marks |= bits

    def flush(self) -> None:
        """End the run at hand."""
        if not self.text and not self.bits:
            return
        text, bits = "".join(self.text), self.bits
        self.text, self.bits = [], 0
        if _SIGN.search(text):
            bits |= sum(1 << k for k, sign in enumerate(_MARKS) if sign in text)
            text = text.translate(_NO_SIGNS)
        if self.kind not in ("code", "formula"):
            if self.kind == "table":
                cells = [c for c in (_BLANK.sub(" ", c).strip() for c in text.split("\t")) if c]
                text = (" | " if len(self.runs) > self.line_began and text[:1] == "\t" else "") + " | ".join(cells)
            else:
                text = _BLANK.sub(" ", text)
            if len(self.runs) == self.line_began:
                text = text.lstrip()
        if not text.strip():
            self.mark(bits)
            # what parts two runs of a line goes to the latter
            self.gap = "\n" if "\n" in text else " " if text else self.gap
            return
        if self.gap and len(self.runs) > self.line_began:
            text = self.gap + text.lstrip()
        self.gap = ""
        self.runs.append((self.block, self.line, self.kind, text, bits))
        if self.open:
            own = _plain(text)
            self.open[-1].digest.update(f"\x00{own}")
            self.open[-1].words += own.count(" ") + 1

    def end_line(self) -> None:
        self.flush()
        if self.kind in ("list", "table") and len(self.runs) > self.line_began:
            part = _hash(f"{self.kind} part", "".join(r[3] for r in self.runs[self.line_began :]))
            self.parts.append(part)
            self.nodes.append((part, self.line_began, len(self.runs), 0))
        if len(self.runs) > self.line_began:
            self.line += 1
        self.line_began, self.gap = len(self.runs), ""

    def end_block(self) -> None:
        self.end_line()
        if len(self.runs) > self.began:
            if self.kind in ("list", "table"):
                own = xxhash.xxh64_intdigest(repr((self.kind, self.parts))) - (1 << 63)
            else:
                own = _hash(self.kind, "".join(r[3] for r in self.runs[self.began :]))
            self.nodes.append((own, self.began, len(self.runs), 0))
            self.block += 1
        self.kind, self.parts, self.line = "", [], 0
        self.began = self.line_began = len(self.runs)

    def begin_line(self, kind: str) -> None:
        """A line of a block of this kind: of the one at hand if it is of several lines."""
        if kind in ("list", "table") and kind == self.kind:
            self.end_line()
        elif kind == "paragraph" == self.kind:
            self.text.append("\n")
        else:
            self.end_block()
            self.kind = kind

    def tag(self, tag: _Tag) -> None:
        bit = _BIT[tag.mark]
        if tag.empty and not tag.closing:
            if self.text:
                self.bits |= bit
            else:
                self.mark(bit)
            return
        self.flush()
        if tag.closing:
            if self.names[tag.name]:
                while self.close().name != tag.name:
                    pass
            else:
                self.mark(bit)
            return
        like = _LIKE.get(tag.name, ("p",) if tag.name in _PARTING or tag.name in _HEADINGS else ())
        for k in range(len(self.open) - 1, max(-1, len(self.open) - 20), -1):
            name = self.open[k].name
            if name in like:
                while len(self.open) > k:
                    self.close()
                break
            if name in _HOLDERS:
                break
        self.open.append(_Element(tag.name, len(self.runs), bit))
        self.names[tag.name] += 1

    def close(self) -> _Element:
        e = self.open.pop()
        self.names[e.name] -= 1
        own = e.digest.intdigest()
        # a word or two set off within a sentence are no template, however often they are
        if e.words >= 2 or e.words and (e.name in _PARTING or e.name in _LIKE or e.name in _HEADINGS):
            self.nodes.append((own - (1 << 63), e.first, len(self.runs), e.marks))
        elif self.open or self.runs[e.first :]:
            self.nodes.append((0, e.first, len(self.runs), e.marks))  # never counted
        else:
            self.marks |= e.marks
        if self.open:
            self.open[-1].digest.update(own.to_bytes(8, "little"))
            self.open[-1].words += e.words
        return e

    def content(self, line: str) -> None:
        at = 0
        for m in _TOKEN.finditer(line):
            if m.start() > at:
                self.text.append(line[at : m.start()])
            at = m.end()
            if m.group(1):
                self.tag(self.tags[int(m.group(1))])
            else:
                _, body, language = self.lifted[int(m.group(2))]
                self.text.append(body)
                self.bits |= _BIT[language]
        if at < len(line):
            self.text.append(line[at:])

    def add(self, line: str) -> None:
        if not _SPECIAL.search(line):
            own = line.strip()
            if own:
                self.begin_line("paragraph")
                self.text.append(own)
            elif self.kind in ("", "paragraph"):
                self.end_block()
            return
        bare = _TAG_SIGN.sub("", line) if "\x0e" in line else line
        first = bare.lstrip(" \t\r" + _MARKS)[:1]
        if not bare.translate(_NO_SIGNS).strip():
            kind, self.kind = self.kind, self.kind or "paragraph"
            self.content(line)
            self.kind = kind
        elif (alone := _ALONE.fullmatch(bare.translate(_NO_SIGNS))) and self.lifted[int(alone.group(1))][0] in ("code", "formula"):
            self.end_block()
            self.kind, body, language = self.lifted[int(alone.group(1))]
            for m in _TAG_SIGN.finditer(line):
                if m.start() < line.index("\x01"):
                    self.tag(self.tags[int(m.group()[1:-1])])
            self.text.append(body.strip("\n"))
            self.bits |= _BIT[language] | sum(1 << k for k, sign in enumerate(_MARKS) if sign in line)
            self.flush()
            for m in _TAG_SIGN.finditer(line):
                if m.start() > line.index("\x01"):
                    self.tag(self.tags[int(m.group()[1:-1])])
            self.end_block()
        else:
            self.begin_line({_HEAD: "heading", _ITEM: "list", _ROW: "table"}.get(first, "paragraph"))
            self.content(line)
            if self.kind == "heading":
                self.end_block()


def tree(text: str) -> Tree:
    """The runs and subtrees of a text, with the markup that stood in each."""
    if _RESERVED.search(text):
        text = _RESERVED.sub("", text)
    marked = scan(text)
    body, tags = marked.text, []
    if "<" in body or "html" in marked.kinds:
        if "wiki" in marked.kinds:
            body = _REF.sub(_WIKI_MARK, body)
        body, tags = _html_lines(body)
    if "latex" in marked.kinds:
        body = _latex_lines(body)
    if "wiki" in marked.kinds:
        body = _wiki_lines(body)
    if "markdown" in marked.kinds:
        body = _markdown_lines(body)
    body = re.sub(r"^[ \t]*[-*•][ \t]+(?=\S)", _ITEM, body, flags=re.M)
    builder = _Builder(marked.lifted, tags)
    for line in body.split("\n"):
        builder.add(line)
    builder.end_block()
    while builder.open:
        builder.close()
    # what was recognised but left no sign, such as a comment or a definition of a link, belongs to the text as a whole
    known = sum(_BIT[k] for k in marked.kinds)
    found = Tree(builder.marks & known, [(h, a, z, m & known) for h, a, z, m in builder.nodes], [(b, n, k, t, m & known) for b, n, k, t, m in builder.runs])
    found.marks |= sum(_BIT[k] for k in marked.kinds - found.kinds)
    return found


# --- the operator -------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class ResidueConfig:
    #: A subtree is template where it stands in at least so many items of a host, and in this share of them.
    least_items: int = 20
    share: float = 0.1
    #: Up to so many template subtrees of all hosts are sent to every task; beyond, they are joined.
    max_broadcast: int = 200_000

    def __post_init__(self) -> None:
        if self.least_items < 2 or not 0 < self.share <= 1:
            raise InvalidConfiguration("least_items must be at least 2, the share in (0, 1]")


_NODE = pa.struct([("hash", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("marks", pa.int32())])
_RUN = pa.struct([("block", pa.int32()), ("line", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("marks", pa.int32())])
PARSED = "src string, item_id bigint, host string, marks int, nodes array<struct<hash bigint, first int, last int, marks int>>, runs array<struct<block int, line int, kind string, text string, marks int>>"


def parsed(items: DataFrame, texts: bool = True) -> DataFrame:
    """src, item_id, host, marks, nodes, runs of (src, item_id, host, text): the tree of each item; see ``Tree``.

    Without ``texts`` runs keep their marks only. Null ids or texts give no rows, an empty text gives no runs. Rows are parsed one by one,
    so repeated ones come out as often. Other columns are ignored.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = [tree(text) for text in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([t.marks for t in trees], pa.int32()), _lists([t.nodes for t in trees], _NODE), _lists([t.runs if texts else [(b, n, None, None, m) for b, n, _, _, m in t.runs] for t in trees], _RUN)],
                names=["src", "item_id", "host", "marks", "nodes", "runs"],
            )

    chosen = items.select("src", F.col("item_id").cast("bigint").alias("item_id"), "host", "text").where("item_id is not null and text is not null")
    return map_arrow(chosen, parse, PARSED)


def _lists(rows: list[list[tuple]], kind: pa.StructType) -> pa.Array:
    """Lists of structs, put together by column."""
    offsets = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    columns = list(zip(*(x for row in rows for x in row), strict=True)) or [()] * kind.num_fields
    values = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind, strict=True)], fields=list(kind))
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def templates(parsed_items: DataFrame, config: ResidueConfig = ResidueConfig()) -> DataFrame:
    """host, hash, items of the subtrees that make up a host's template. Items without a host have none.

    Each item counts a subtree once; counting combines on the map side, so a host that holds most items costs no skew.
    """
    own = parsed_items.where("host is not null")
    hashes = F.expr("array_distinct(filter(transform(nodes, n -> n.hash), h -> h <> 0))")
    seen = own.select("host", F.explode(hashes).alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("items"))
    sizes = own.groupBy("host").agg(F.count("*").alias("all_items"))
    return seen.where(F.col("items") >= config.least_items).join(sizes, "host").where(F.col("items") >= config.share * F.col("all_items")).select("host", "hash", "items")


def _without_template(parsed_items: DataFrame, config: ResidueConfig) -> DataFrame:
    """Parsed items with ``_deleted``, the nodes that are template.

    A host's template has at most 1 / ``share`` times as many subtrees as its items have on average, for each is in that share of them; so the row that
    holds it is of the size of a few items.
    """
    found = checkpoint(templates(parsed_items, config))
    few = found.limit(config.max_broadcast + 1).count() <= config.max_broadcast
    per_host = found.groupBy("host").agg(F.collect_set("hash").alias("_template"))
    joined = parsed_items.join(F.broadcast(per_host) if few else per_host, "host", "left")
    joined = joined.withColumn("_hit", F.expr("case when _template is not null then array_intersect(transform(nodes, n -> n.hash), _template) else array() end"))
    return joined.withColumn("_deleted", F.expr("case when size(_hit) > 0 then filter(nodes, n -> array_contains(_hit, n.hash)) else array() end")).drop("_template", "_hit")


#: Whether a run, by its number, and a node lie in what is deleted.
_RUN_DELETED = "exists(_deleted, d -> i >= d.first and i < d.last)"
_NODE_DELETED = "exists(_deleted, d -> n.first >= d.first and n.last <= d.last)"


def _kinds(marks: str) -> Column:
    return F.expr("filter(array(" + ", ".join(f"if(({marks} & {bit}) > 0, '{kind}', null)" for kind, bit in _BIT.items()) + "), k -> k is not null)")


def _marks(deleted: bool) -> str:
    """Marks of the nodes and runs that are deleted, or of those that are kept."""
    no = "" if deleted else "not "
    runs = f"aggregate(filter(runs, (r, i) -> {no}{_RUN_DELETED}), 0, (m, r) -> m | r.marks)"
    nodes = f"aggregate(filter(nodes, n -> {no}{_NODE_DELETED}), 0, (m, n) -> m | n.marks)"
    return f"{runs} | {nodes}" if deleted else f"marks | {runs} | {nodes}"


def markup(items: DataFrame, config: ResidueConfig = ResidueConfig()) -> DataFrame:
    """src, item_id, kept, template of (src, item_id, host, text): kinds of markup in what is left of an item without its host's template, and in what is deleted.

    Items must come once. Null ids or texts give no rows.
    """
    lean = written(parsed(items, texts=False))
    judged = _without_template(lean, config).withColumn("_kept", F.expr(_marks(False))).withColumn("_gone", F.expr(_marks(True)))
    return judged.select("src", "item_id", _kinds("_kept").alias("kept"), _kinds("_gone").alias("template"))


def cleaned(items: DataFrame, config: ResidueConfig = ResidueConfig()) -> DataFrame:
    """src, item_id, host, markup (kinds in what is kept), removed (subtrees deleted as template), text (clean) of (src, item_id, host, text).

    Blocks are parted by empty lines: ``# heading``, ``- item``, ``cell | cell``, code between fences, formulas in their own signs.

    Items must come once; an item that is template all over has an empty text. Null ids or texts give no rows.
    """
    judged = _without_template(written(parsed(items)), config)
    judged = judged.withColumn("_kept", F.expr(f"case when size(_deleted) = 0 then runs else filter(runs, (r, i) -> not {_RUN_DELETED}) end"))
    lead = "case r.kind when 'heading' then '# ' when 'list' then '- ' when 'code' then '```\\n' when 'formula' then if(substr(r.text, 1, 1) in ('$', '\\\\'), '', '$$') else '' end"
    tail = "case r.kind when 'code' then '\\n```' when 'formula' then if(substr(r.text, 1, 1) in ('$', '\\\\'), '', '$$') else '' end"
    new = "i = 0 or get(_kept, i - 1).block <> r.block"
    apart = f"case when i = 0 then '' when {new} then '\\n\\n' when get(_kept, i - 1).line <> r.line then '\\n' else '' end"
    begins = f"({new} or get(_kept, i - 1).line <> r.line)"
    own = f"case when not {begins} or r.kind in ('code', 'formula') then r.text when r.kind = 'table' then trim(leading ' |' from r.text) else ltrim(r.text) end"
    text = F.expr(f"array_join(transform(_kept, (r, i) -> concat({apart}, if({begins}, {lead}, ''), {own}, {tail})), '')")
    removed = F.expr(f"size(filter(nodes, n -> n.hash <> 0 and {_NODE_DELETED}))")
    return judged.select("src", "item_id", "host", _kinds(f"({_marks(False)})").alias("markup"), removed.alias("removed"), F.trim(text).alias("text"))
