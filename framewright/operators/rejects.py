"""Loading raw annotation records while separating those that fail to parse.

Blocks of records are parsed in bulk on a fast path that accepts only what is
certainly valid: lines by columnar kernels over a whole Arrow batch, XML
bodies many to a document. A block that holds something else is cut in halves
until the records in doubt stand alone; those are diagnosed strictly, which
also loads odd but readable spellings.
"""

from __future__ import annotations

import re
import secrets
from collections.abc import Callable, Iterable, Iterator, Sequence
from xml.etree import ElementTree
from xml.parsers import expat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.session import bounded_rows, mapped, spread

#: Bodies in a block of the fast path.
BLOCK = 16
#: Most rows of a class list; it is held on every executor.
MOST_CLASSES = 100_000

_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\Z")
_FIELD = re.compile(r'(?:"[^"]*"|[^ \t"])+')
_SPACE = " \t\r\n"
_DECLARATION = re.compile(r"<\?xml version=[\"']1\.0[\"'](?: encoding=[\"'][uU][tT][fF]-8[\"'])?\s*\?>")
_COORDINATES = ("x_center", "y_center", "width", "height")
#: A plain line; what else the strict reading takes is left to it.
_PLAIN = r"^[ \t\r]*(?P<class>[^ \t\r\n\"]+)" + "".join(rf"[ \t]+(?P<{c}>[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)" for c in _COORDINATES) + r"[ \t\r]*$"


def is_number(text: str | None) -> bool:
    """An optional sign, ASCII digits with at most one point, an optional exponent."""
    return text is not None and _NUMBER.match(text) is not None


def bisect(records: Sequence, bulk: Callable[[Sequence], list | None], strict: Callable) -> Iterator:
    """Results of records in order; bulk gives None for a block it cannot vouch for."""
    if not records:
        return
    got = bulk(records)
    if got is not None:
        yield from got
    elif len(records) == 1:
        yield strict(records[0])
    else:
        half = len(records) // 2
        yield from bisect(records[:half], bulk, strict)
        yield from bisect(records[half:], bulk, strict)


def isolated(doubts: np.ndarray, low: int, high: int) -> Iterator[int]:
    """Places from low to high that are in doubt, by halving; doubts[i] counts those before place i."""
    if doubts[low] == doubts[high]:
        return
    if high - low == 1:
        yield low
        return
    half = (low + high) // 2
    yield from isolated(doubts, low, half)
    yield from isolated(doubts, half, high)


def _texts(column: pa.Array) -> list[str | None]:
    """Texts of a column; bytes that are no UTF-8 become lone surrogates, which nothing valid holds."""
    return [None if v is None else v.decode("utf-8", "surrogateescape") for v in column.cast(pa.binary()).to_pylist()]


class YoloLines:
    """Parses YOLO lines to (reason, class, x_center, y_center, width, height)."""

    def __init__(self, classes: frozenset[str]):
        self.classes = classes
        self.known = pa.array(sorted(classes), pa.string())

    def bulk(self, lines: pa.Array) -> tuple[list[pa.Array], np.ndarray]:
        """Columns of all lines, and which of them are certainly valid."""
        fields = pc.extract_regex(lines, _PLAIN)
        sure = pc.fill_null(pc.and_kleene(pc.is_valid(fields), pc.is_in(pc.struct_field(fields, "class"), self.known)), False)
        numbers = []
        for c in _COORDINATES:
            x = pc.if_else(sure, pc.struct_field(fields, c), None).cast(pa.float64())
            numbers.append(x)
            sure = pc.fill_null(pc.and_kleene(sure, pc.and_kleene(pc.greater_equal(x, 0.0), pc.less_equal(x, 1.0))), False)
        columns = [pc.if_else(sure, c, None) for c in (pc.struct_field(fields, "class"), *numbers)]
        return columns, sure.to_numpy(zero_copy_only=False)

    def strict(self, line: str | None) -> tuple:
        def bad(reason: str) -> tuple:
            return (reason, None, None, None, None, None)

        if line is None:
            return bad("columns")
        if line.count('"') % 2:
            return bad("quoting")
        fields = _FIELD.findall(line.strip(" \t\r"))
        if len(fields) != 5:
            return bad("columns")
        name = fields[0].replace('"', "")
        if name not in self.classes or not all(map(is_number, fields[1:])):
            return bad("value")
        box = [float(x) for x in fields[1:]]
        return (None, name, *box) if all(0.0 <= x <= 1.0 for x in box) else bad("value")

    def columns(self, lines: pa.Array) -> list[pa.Array]:
        """The parsed columns of an Arrow column of lines."""
        try:
            found, sure = self.bulk(lines)
        except pa.ArrowInvalid:  # no UTF-8, or a number that the kernel does not take
            found, sure = [pa.nulls(len(lines), f.type) for f in list(_YOLO_ARROW)[1:]], np.zeros(len(lines), bool)
        alone = list(isolated(np.r_[0, np.cumsum(~sure)], 0, len(lines)))
        rows = [self.strict(x) for x in _texts(lines.take(pa.array(alone, pa.int64())))]
        mask = pa.array(~sure)
        made = [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_YOLO_ARROW)]
        whole = [pa.nulls(len(lines), pa.string()), *found]
        return [pc.replace_with_mask(c, mask, m) if alone else c for c, m in zip(whole, made)]

    def parse(self, lines: Sequence[str | None]) -> Iterator[tuple]:
        yield from zip(*(c.to_pylist() for c in self.columns(pa.array(lines, pa.string()))))


_BOX = ("xmin", "ymin", "xmax", "ymax")


class VocBodies:
    """Parses VOC XML bodies to (reason, filename, width, height, objects)."""

    def __init__(self, names: frozenset[str]):
        self.names = names

    def _read(self, top: ElementTree.Element) -> tuple:
        objects, unnamed = [], False
        for element in top.iter("object"):
            box = element.find("bndbox")
            corners = [None if box is None else box.find(c) for c in _BOX]
            texts = [None if c is None else "".join(c.itertext()).strip(_SPACE) for c in corners]
            if not all(map(is_number, texts)):
                return ("box", None, None, None, None)
            name = element.find("name")
            label = None if name is None else "".join(name.itertext()).strip(_SPACE)
            unnamed |= name is not None and label not in self.names
            objects.append({"name": label, **{c: float(t) for c, t in zip(_BOX, texts)}})
        if unnamed:
            return ("name", None, None, None, None)
        return (None, top.findtext("filename"), top.findtext("size/width"), top.findtext("size/height"), objects)

    def bulk(self, bodies: Sequence[str | None]) -> list | None:
        """The bodies read as one document, with a marker between them that no body can foresee.

        What could swallow a marker (comments, character data sections,
        declarations, processing instructions) is left to strict().
        """
        marker = f"m{secrets.token_hex(8)}"
        parts = ["<all>"]
        for body in bodies:
            if body is None:
                return None
            found = _DECLARATION.match(body)
            rest = body[found.end() :] if found else body
            if "<!" in rest or "<?" in rest:
                return None
            parts += [rest, f"<{marker}/>"]
        parts.append("</all>")
        parser = ElementTree.XMLParser(encoding="utf-8")
        try:
            parser.feed("".join(parts).encode("utf-8"))
            top = parser.close()
        except (ElementTree.ParseError, UnicodeError):
            return None
        kids = list(top)
        # every body closed all it opened: one element each, between markers, no text beside
        if len(kids) != 2 * len(bodies) or any(k.tag != marker or len(k) or k.text for k in kids[1::2]) or any(k.tag == marker for k in kids[0::2]):
            return None
        if any(t and t.strip(_SPACE) for t in (top.text, *(k.tail for k in kids))):
            return None
        read = [self._read(k) for k in kids[0::2]]
        return None if any(r[0] for r in read) else read

    def strict(self, body: str | None) -> tuple:
        try:
            data = body.encode("utf-8")
            expat.ParserCreate(encoding="utf-8").Parse(data, True)
            parser = ElementTree.XMLParser(encoding="utf-8")
            parser.feed(data)
            return self._read(parser.close())
        except (AttributeError, UnicodeError, expat.ExpatError, ElementTree.ParseError):
            return ("markup", None, None, None, None)

    def parse(self, bodies: Sequence[str | None]) -> Iterator[tuple]:
        for i in range(0, len(bodies), BLOCK):
            yield from bisect(bodies[i : i + BLOCK], self.bulk, self.strict)

    def columns(self, bodies: pa.Array) -> list[pa.Array]:
        """The parsed columns of an Arrow column of bodies."""
        rows = list(self.parse(_texts(bodies)))
        return [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_VOC_ARROW)]


_YOLO = "reason string, class string, x_center double, y_center double, width double, height double"
_VOC = "reason string, filename string, width string, height string, object array<struct<name:string,xmin:double,ymin:double,xmax:double,ymax:double>>"
_YOLO_ARROW = pa.schema([("reason", pa.string()), ("class", pa.string()), *[(c, pa.float64()) for c in _COORDINATES]])
_VOC_ARROW = pa.schema(
    [("reason", pa.string()), ("filename", pa.string()), ("width", pa.string()), ("height", pa.string())]
    + [("object", pa.list_(pa.struct([("name", pa.string()), *[(c, pa.float64()) for c in _BOX]])))]
)


def _parsed(df: DataFrame, id_col: str, text_col: str, make: Callable[[], YoloLines | VocBodies], ddl: str, arrow: pa.Schema) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = make()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), *parser.columns(batch.column(1))], names=["rec_id", *arrow.names])

    narrow = df.select(F.col(id_col).cast("bigint").alias("rec_id"), F.col(text_col).alias("text"))
    return mapped(spread(narrow), run, f"rec_id bigint, {ddl}")


def _classes(class_list: DataFrame) -> list:
    return bounded_rows(class_list.select("class_id", "class_name"), MOST_CLASSES, "the class list")


def parse_yolo(raw: DataFrame, class_list: DataFrame, *, id_col: str = "line_id", text_col: str = "line") -> DataFrame:
    """Every YOLO line with its parsed fields, or with the first reason why it fails.

    reason is null for a valid line, else ``columns`` (null, empty, not five
    fields), ``quoting`` (an odd count of double quotes) or ``value`` (unknown
    class, no number from 0 to 1). Repeated lines are parsed each time. An
    empty table gives an empty result; other columns are ignored.
    """
    classes = frozenset(x for r in _classes(class_list) for x in r if x is not None)
    return _parsed(raw, id_col, text_col, lambda: YoloLines(classes), _YOLO, _YOLO_ARROW)


def parse_voc(raw: DataFrame, class_list: DataFrame, *, id_col: str = "doc_no", text_col: str = "body") -> DataFrame:
    """Every VOC body with its file name, size and objects, or with the first reason why it fails.

    reason is null for a valid body, else ``markup`` (null, empty or not well
    formed), ``box`` (an object without all four corners as numbers) or
    ``name`` (a name that is empty or not in the class list; none is allowed).
    """
    names = frozenset(r["class_name"] for r in _classes(class_list) if r["class_name"] is not None)
    return _parsed(raw, id_col, text_col, lambda: VocBodies(names), _VOC, _VOC_ARROW)


def rejected(parsed: DataFrame, raw_table: str) -> DataFrame:
    """(raw_table, rec_id, reason) of the records that failed."""
    return parsed.filter("reason IS NOT NULL").select(F.lit(raw_table).alias("raw_table"), "rec_id", "reason")


def loaded(parsed: DataFrame) -> DataFrame:
    """The valid records, without the reason."""
    return parsed.filter("reason IS NULL").drop("reason")
