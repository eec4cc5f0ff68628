"""Deeply nested XML or JSON records as related flat tables.

Each record is parsed as a stream, at any depth, into path-value-ordinal triples. Paths are grouped by their nearest repeated ancestor: a path that some
record has several times under one parent, or within itself, or a JSON object in an array, is a table, whose rows also hold what stands once below them; so is
the root. An element within one of the same name is of the same path, so a recursive structure is one table that refers to itself. Each group
is pivoted into one table, whose rows are linked by ``node_path`` and ``parent_path``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.markup import ARRAY, ARRAY_END, NAME, OBJECT, OBJECT_END, SCALAR, json_events
from ..session import map_arrow

#: index; path of the container and of the one above it; its table, the row of that table it belongs to, and the row above that; what the row is about.
TRIPLES = "index bigint, node_path string, parent_path string, `table` string, row_path string, owner_path string, kind string, name string, ordinal bigint, value string"
_SCHEMA = pa.schema([(n, pa.int64() if n in ("index", "ordinal") else pa.string()) for n in "index node_path parent_path table row_path owner_path kind name ordinal value".split()])
_FOUND = pa.schema([("path", pa.string()), ("name", pa.string()), ("many", pa.bool_())])
#: Columns of a pivoted table; further values stand in an array beside them.
MAX_COLUMNS = 2_000
#: Paths and names of a layout that are sent to every task; with more of them, as where keys are used as names, every container has a row of its own.
MAX_LAYOUT = 100_000
_BATCH_BYTES = 64 << 20


@dataclass(frozen=True)
class Layout:
    """Which paths have tables of their own (None: all), and the names of values by path, with whether a container may have several."""

    repeated: frozenset[str] | None
    values: tuple[tuple[str, str, bool], ...] = ()

    def table(self, path: str) -> tuple[str, str]:
        """The table that a container's values are in, and what their names there begin with."""
        own, below = path, ""
        while self.repeated is not None and "/" in own and own not in self.repeated:
            own, _, name = own.rpartition("/")
            below = f"{name}/{below}"
        return own, below

    def columns(self) -> dict[str, dict[str, bool]]:
        """By table, its columns and whether a row may have several values of each."""
        out: dict[str, dict[str, bool]] = {}
        for path, name, many in self.values:
            table, below = self.table(path)
            own = out.setdefault(table, {})
            own[below + name] = own.get(below + name, False) or many
        return out


def _step(name: str) -> str:
    """A name as a step of a path of names."""
    return name.replace("~", "~0").replace("/", "~1")


class _Container:
    __slots__ = ("below", "counts", "name", "owner", "parent", "path", "row", "table", "where")

    def __init__(self, name: str, path: str) -> None:
        self.name, self.path = name, path
        self.counts: dict[str, int] = {}


class _Record:
    """Collects what a record holds, container by container."""

    def __init__(self, layout: Layout | None) -> None:
        self.layout = layout
        self.rows: list[tuple] = []
        #: without a layout: path, and path and name of a value, with whether there are many
        self.found: dict[tuple[str, str | None], bool] = {}
        self.paths: dict[str, list[str]] = {}  # paths of the open containers of each name

    def open(self, c: _Container, above: _Container | None, ordinal: int, many: bool) -> None:
        same = self.paths.setdefault(c.name, [])
        many = many or ordinal > 1 or bool(same)
        c.where = same[-1] if same else _step(c.name) if above is None else f"{above.where}/{_step(c.name)}"
        same.append(c.where)
        c.parent = None if above is None else above.path
        if self.layout is None:
            key = (c.where, None)
            self.found[key] = self.found.get(key, False) or many
            return
        if above is None or self.layout.repeated is None or c.where in self.layout.repeated:
            c.table, c.row, c.owner, c.below = c.where, c.path, None if above is None else above.row, ""
        else:
            c.table, c.row, c.owner, c.below = above.table, above.row, above.owner, f"{above.below}{_step(c.name)}/"
        self.rows.append((c.path, c.parent, c.table, c.row, c.owner, "node", c.below[:-1], ordinal, None))

    def close(self, c: _Container) -> None:
        self.paths[c.name].pop()

    def value(self, c: _Container, name: str, ordinal: int, value: str | None, many: bool = False) -> None:
        if self.layout is None:
            key = (c.where, name)
            self.found[key] = self.found.get(key, False) or many or ordinal > 1
        else:
            self.rows.append((c.path, c.parent, c.table, c.row, c.owner, "value", c.below + name, ordinal, value))


class _Element:
    __slots__ = ("attributes", "container", "counts", "name", "ordinal", "path", "text")

    def __init__(self, name: str, path: str, ordinal: int, attributes: dict) -> None:
        self.name, self.path, self.ordinal, self.attributes = name, path, ordinal, attributes
        self.text: list[str] = []
        self.counts: dict[str, int] = {}
        self.container: _Container | None = None


def read_xml(data: bytes, record: _Record) -> bool:
    """Whether a record is well-formed XML; what it holds goes to ``record``.

    A container is an element with child elements, or the root; a value is each leaf, attribute (``@name``; of a leaf ``leaf@name``) and text
    between children (``#text``).
    """
    stack: list[_Element] = []

    def contain(e: _Element, above: _Container | None) -> None:
        e.container = _Container(e.name, e.path)
        record.open(e.container, above, e.ordinal, False)
        for k, v in e.attributes.items():
            record.value(e.container, f"@{k}", 1, v)

    def start(name: str, attributes: dict) -> None:
        if not stack:
            stack.append(root := _Element(name, "/", 1, attributes))
            contain(root, None)
            return
        above = stack[-1]
        if above.container is None:
            contain(above, stack[-2].container)
        k = above.counts[name] = above.counts.get(name, 0) + 1
        stack.append(_Element(name, f"{above.path if above.path != '/' else ''}/{name}[{k}]", k, attributes))

    def end(name: str) -> None:
        e = stack.pop()
        text = "".join(e.text)
        if e.container is not None:
            if text.strip():
                record.value(e.container, "#text", 1, text.strip())
            record.close(e.container)
            return
        own = stack[-1].container
        record.value(own, e.name, e.ordinal, text)
        for k, v in e.attributes.items():
            record.value(own, f"{e.name}@{k}", e.ordinal, v)

    def characters(text: str) -> None:
        stack[-1].text.append(text)

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, characters
    try:
        parser.Parse(data, True)
    except (expat.ExpatError, ValueError):
        return False
    return True


class _Array:
    """An open array: the container that its values belong to, the name, the path up to the position, and the positions so far."""

    __slots__ = ("container", "count", "inner", "name", "path")

    def __init__(self, container: _Container, name: str, path: str, inner: bool) -> None:
        self.container, self.name, self.path, self.inner, self.count = container, name, path, inner, 0


def read_json(data: bytes, record: _Record) -> bool:
    """The same of JSON: a container is an object, or the root; a value is each scalar.

    Ordinals are positions in the array, from 1; an array in an array adds a further ``[k]`` to the step. A name that an object has more than
    once counts on.
    """
    stack: list[_Container | _Array] = []
    name = ""  # of the value to come, in an object

    def place() -> tuple[_Container | None, str, str, int, bool, bool]:
        """Container, name, path, ordinal of the value to come, whether it is in an array, and whether that is in another."""
        if not stack:
            return None, "record", "/", 1, False, False
        top = stack[-1]
        if isinstance(top, _Array):
            top.count += 1
            return top.container, top.name, f"{top.path}[{top.count}]", top.count, True, top.inner
        k = top.counts[name] = top.counts.get(name, 0) + 1
        return top, name, f"{top.path if top.path != '/' else ''}/{name}", k, False, False

    try:
        for kind, text in json_events(data.decode("utf-8-sig")):
            if kind == NAME:
                name = text
            elif kind == SCALAR:
                own, called, _, ordinal, _, inner = place()
                if own is not None:
                    record.value(own, called, ordinal, text, inner)  # in arrays of arrays positions begin anew
            elif kind == OBJECT:
                own, called, path, ordinal, listed, _ = place()
                c = _Container(called, path if own is None or listed else f"{path}[{ordinal}]")
                record.open(c, own, ordinal, listed)
                stack.append(c)
            elif kind == ARRAY:
                own, called, path, ordinal, listed, _ = place()
                if own is None:
                    own = _Container("record", "/")
                    record.open(own, None, 1, False)
                    path = "/"
                stack.append(_Array(own, called, path, listed))
            else:
                done = stack.pop()
                if kind == OBJECT_END:
                    record.close(done)
                else:
                    assert kind == ARRAY_END
    except ValueError:
        return False
    return True


def _read(data: bytes, form: str, layout: Layout | None) -> _Record | None:
    record = _Record(layout)
    return record if (read_xml if form == "xml" else read_json)(data, record) else None


def _chosen(records: DataFrame, index: str, data: str, form: str) -> DataFrame:
    chosen = records.select(F.col(index).cast("bigint").alias("index"), F.col(data).cast("binary").alias("bytes"), F.col(form).alias("form"))
    return chosen.where("index is not null and bytes is not null and form in ('xml', 'json')")


def found(records: DataFrame, index: str = "index", data: str = "bytes", form: str = "form") -> DataFrame:
    """path, name (null for the container itself), many: all that stands in any record; see ``layout_of``. Combined within tasks first."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_: dict[tuple[str, str | None], bool] = {}
            for b, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                record = _read(b, f, None)
                if record is not None:
                    for key, many in record.found.items():
                        if many or key not in all_:
                            all_[key] = many
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in all_], pa.string()), pa.array([k[1] for k in all_], pa.string()), pa.array(list(all_.values()), pa.bool_())], schema=_FOUND)

    return map_arrow(_chosen(records, index, data, form), gather, "path string, name string, many boolean").groupBy("path", "name").agg(F.max("many").alias("many"))


def layout_of(records: DataFrame, index: str = "index", data: str = "bytes", form: str = "form") -> Layout:
    """The tables of records: one pass, of which the driver gets at most ``MAX_LAYOUT`` rows."""
    rows = found(records, index, data, form).limit(MAX_LAYOUT + 1).collect()
    if len(rows) > MAX_LAYOUT:
        return Layout(None)
    return Layout(frozenset(r["path"] for r in rows if r["name"] is None and r["many"]), tuple(sorted((r["path"], r["name"], r["many"]) for r in rows if r["name"] is not None)))


def triples(records: DataFrame, layout: Layout | None = None, index: str = "index", data: str = "bytes", form: str = "form") -> DataFrame:
    """Triples of records (``form`` is xml or json; others, nulls and ill-formed records give none).

    A row of kind ``node`` stands for each container, with the names of containers within its table's row as ``name`` (empty for the row's own); one of kind
    ``value`` for each value, under the path of its container. Without a ``layout`` one more pass finds it. Rows with the same
    index are the caller's to part beforehand; each row is parsed for itself. Columns other than the three named are ignored, whatever they are called.
    """
    own = layout_of(records, index, data, form) if layout is None else layout

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in _SCHEMA]
            for i, b, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                record = _read(b, f, own)
                if record is None or not record.rows:
                    continue
                rows = record.rows
                # paths of deep records are long, and each row holds four
                most = max(1, min(50_000, _BATCH_BYTES // (4 * max(len(r[0]) for r in rows))))
                for k in range(0, len(rows), most):
                    some = rows[k : k + most]
                    out[0].extend([i] * len(some))
                    for column, values in zip(out[1:], zip(*some, strict=True), strict=True):
                        column.extend(values)
                    if len(out[0]) >= most:
                        yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(out, _SCHEMA, strict=True)], schema=_SCHEMA)
                        out = [[] for _ in _SCHEMA]
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(out, _SCHEMA, strict=True)], schema=_SCHEMA)

    return map_arrow(_chosen(records, index, data, form), parse, TRIPLES)


def layout_rows(layout: Layout) -> list[tuple[str, str, bool]]:
    """table, name, repeated: the columns of each table, and whether a row may hold several values of one."""
    return [(table, name, many) for table, own in sorted(layout.columns().items()) for name, many in sorted(own.items())]


def _first(name: str) -> Column:
    return F.min(F.when((F.col("kind") == "value") & (F.col("name") == name), F.struct("ordinal", "value"))).getField("value")


_KEYS = ("table", "index", "owner_path", "row_path")
def _place() -> Column:
    return F.max(F.when((F.col("kind") == "node") & (F.col("name") == ""), F.col("ordinal"))).alias("ordinal")


def _nodes() -> Column:
    """The containers that a row stands for: its own, and those that stand once below it."""
    return F.collect_list(F.when(F.col("kind") == "node", F.struct("parent_path", "node_path"))).alias("nodes")


def flat_table(t: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """One table: index, parent_path, node_path, ordinal, then the ``columns``, each with its first value where a row has several.

    Rows without values stay, with nulls. An unknown table is empty.
    """
    own = t.where(F.col("table") == table).groupBy("index", "owner_path", "row_path").agg(_place(), *[_first(n).alias(n) for n in columns])
    return own.withColumnsRenamed({"owner_path": "parent_path", "row_path": "node_path"})


def repeated_values(t: DataFrame, table: str, name: str) -> DataFrame:
    """index, parent_path (the row of ``table`` it belongs to), ordinal, value of a value that rows may have several times."""
    own = t.where((F.col("table") == table) & (F.col("kind") == "value") & (F.col("name") == name))
    return own.select("index", F.col("row_path").alias("parent_path"), "ordinal", "value")


def tables(t: DataFrame, layout: Layout) -> DataFrame:
    """All tables at once: table, index, parent_path, node_path, ordinal, nodes, a column for each name that no row has twice, more, value.

    A row of a table has nulls in the columns of others. ``nodes`` are the containers that the row stands for, each with the one above it. Values
    that rows of a table may have several times are rows of a table of their own, named ``table/name``, with the owner's path as
    parent_path, no node_path, and the value in ``value``. Names beyond ``MAX_COLUMNS``, or all of them where a layout is too large to be known, stand in ``more``, with ordinal and value.
    """
    own = layout.columns()
    repeated = [(table, name) for table, names in own.items() for name, many in names.items() if many]
    names = sorted({name for names in own.values() for name, many in names.items() if not many})
    taken = {"table", "index", "parent_path", "node_path", "ordinal", "nodes", "more", "value"}
    columns = {n: _free(n, taken) for n in names[:MAX_COLUMNS]}
    if repeated:
        kinds = t.sparkSession.createDataFrame(repeated, "`table` string, name string").withColumn("_several", F.lit(True))
        marked = t.join(F.broadcast(kinds), ["table", "name"], "left")  # at most MAX_LAYOUT rows
    else:
        marked = t.withColumn("_several", F.lit(None).cast("boolean"))
    several = (F.col("kind") == "value") & F.col("_several").isNotNull()
    rest = (F.col("kind") == "value") & (F.lit(layout.repeated is None) if len(names) <= MAX_COLUMNS else ~F.col("name").isin(names[:MAX_COLUMNS]))
    more = F.collect_list(F.when(rest, F.struct("name", "ordinal", "value")))
    flat = marked.where(~several).groupBy(*_KEYS).agg(_place(), _nodes(), *[_first(n).alias(c) for n, c in columns.items()], *([more.alias("more")] if len(names) > MAX_COLUMNS or layout.repeated is None else []))
    flat = flat.withColumnsRenamed({"owner_path": "parent_path", "row_path": "node_path"})
    values = marked.where(several).select(F.concat_ws("/", "table", "name").alias("table"), "index", F.col("row_path").alias("parent_path"), "ordinal", "value")
    return flat.unionByName(values, allowMissingColumns=True)


def nodes(pivoted: DataFrame) -> DataFrame:
    """index, parent_path, node_path of all containers below the root, from the rows of ``tables``."""
    own = pivoted.select("index", F.explode("nodes").alias("_node")).select("index", "_node.parent_path", "_node.node_path")
    return own.where("parent_path is not null")


def _free(name: str, taken: set[str]) -> str:
    """The name, with a number where Spark would take it for another; it is taken then."""
    free, k = name, 1
    while free.lower() in taken:
        k += 1
        free = f"{name}_{k}"
    taken.add(free.lower())
    return free
