"""An interactive prompt over one corpus: ``python -m corpusloom.cli PATH [ELEMENT]``."""

from __future__ import annotations

import sys
from collections.abc import Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .config import EVIDENCE_BYTES, EVIDENCE_BYTES_SINGLE, EVIDENCE_RECORDS
from .errors import InvalidConfiguration, RecordError
from .functions.preview import retained_bytes
from .operators.engine import RecordEngine
from .sources.folder import save_decompressed

HELP = """prep [interval] [--save]             build previews
showpreptable [index]                state of the previews, or one of them
searchpreptable <text> [limit]       indexes of previews that hold the words
spotonpreptable <text> [limit]       the previews themselves
clearpreptable                       drop the previews
find <text> [limit]                  indexes of records that hold the words
get <index>                          one record
list <a..b | *>                      records of a range
getfragment <index> <text> [bytes]   evidence from one record
searchtogetfragment <text> [records] [bytes]
help, quit"""


def search_arguments(rest: str) -> tuple[str, int | None]:
    """Words and a limit: a number at the end is the limit, inside quotes too."""
    text = rest.strip().strip('"')
    head, _, last = text.rpartition(" ")
    if head and last.isascii() and last.isdigit():
        return head.strip().strip('"'), int(last)
    return text, None


def range_arguments(rest: str) -> tuple[int, int]:
    a, dots, b = rest.strip().partition("..")
    if not dots or not a.strip().isdigit() or not b.strip().isdigit():
        raise InvalidConfiguration("a range is written a..b")
    return int(a), int(b)


def _preview(index: int, elements: list, size: int) -> Iterable[str]:
    yield f"#{index} ({size} bytes):"
    yield from (f"  <{e['name']}>: {e['text']}" for e in elements)


def answer(engine: RecordEngine, line: str, path: str = "") -> Iterable[str]:
    """What the prompt says to a line."""
    command, _, rest = line.strip().partition(" ")
    match command:
        case "":
            return
        case "help":
            yield HELP
        case "prep":
            words = rest.split()
            if "--save" in words:
                yield f"saved {save_decompressed(path)}"
            numbers = [w for w in words if w.isdigit()]
            if numbers:
                engine.set_checkpoint_interval(int(numbers[0]))
            steps: list[int] = []
            total = engine.prep(steps.append)
            yield from (f"{n} records" for n in steps[:-1])
            yield f"prepared {total} records"
        case "showpreptable" if rest.strip():
            found = engine.preview_at(int(rest))
            if found is None:
                yield "no such preview"
            else:
                yield from _preview(int(rest), [{"name": n, "text": t} for n, t in found], sum(len(n.encode()) + len(t.encode()) for n, t in found))
        case "showpreptable":
            yield f"{engine.prepared_preview_count} previews"
            if engine.is_prepared:
                for r in engine.preview_sample().withColumn("n", retained_bytes(F.col("elements"))).collect():
                    yield from _preview(r["index"], r["elements"], r["n"])
        case "searchpreptable" | "find":
            text, limit = search_arguments(rest)
            rows = engine.find(text, limit) if command == "find" else engine.search_preview_indexes(text, limit)
            yield from (f"#{r['index']}" for r in rows.toLocalIterator())
        case "spotonpreptable":
            text, limit = search_arguments(rest)
            for r in engine.search_previews(text, limit).withColumn("n", retained_bytes(F.col("elements"))).toLocalIterator():
                yield from _preview(r["index"], r["elements"], r["n"])
        case "clearpreptable":
            engine.clear_previews()
            yield "cleared"
        case "get":
            record = engine.get(int(rest))
            yield "no such record" if record is None else f"#{record.index}: {record.text}"
        case "list":
            rows = engine.list() if rest.strip() == "*" else engine.list(*range_arguments(rest))
            for r in rows.toLocalIterator():
                yield f"#{r['index']}: {bytes(r['bytes']).decode('utf-8', 'replace')}"
        case "getfragment":
            index, _, more = rest.strip().partition(" ")
            text, most = search_arguments(more)
            found = engine.get_fragment(int(index), text, EVIDENCE_BYTES_SINGLE if most is None else most)
            yield "no evidence" if found is None else found
        case "searchtogetfragment":
            words = rest.split()
            numbers: list[int] = []
            while len(words) > 1 and len(numbers) < 2 and words[-1].isdigit():
                numbers.insert(0, int(words.pop()))
            limits = [numbers[0] if numbers else EVIDENCE_RECORDS, numbers[1] if len(numbers) > 1 else EVIDENCE_BYTES]
            for r in engine.search_to_get_fragment(" ".join(words).strip('"'), *limits).collect():
                yield f"#{r['index']}: {r['record']}"
        case _:
            yield f"unknown command: {command}; try help"


def main(arguments: list[str]) -> int:
    if not arguments:
        print("usage: python -m corpusloom.cli PATH [ELEMENT]")
        return 2
    spark = SparkSession.builder.appName("corpusloom").getOrCreate()
    engine = RecordEngine.open(spark, *arguments[:2])
    for line in sys.stdin:
        if line.strip() in ("quit", "exit"):
            break
        try:
            for out in answer(engine, line, arguments[0]):
                print(out, flush=True)
        except (RecordError, ValueError) as e:
            print(f"error: {e}", flush=True)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
