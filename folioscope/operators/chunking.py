"""Cutting documents into retrieval units. Every document is cut inside its own row, so nothing is shuffled."""

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate, pairwise

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import HEADER, chunk_hash, is_table_row, is_table_rule
from ..params import DEFAULTS

CHUNKER_VERSION = 3
_TOKEN = re.compile(r"\w+|[^\w\s]")
_TOP = re.compile(r"^(#{1,2})\s+(.+)$", re.M)
_ANY = re.compile(r"^#{1,6}\s+")
_ROW = re.compile(r"^\s*\|.*\|\s*$")
_RULE = re.compile(r"^\s*\|[\s:|\-]+\|\s*$")
_OUT = "rel_path string, chunk_idx int, text string, token_count int, context string, heading_path string"


def count_tokens(text):
    return len(_TOKEN.findall(text))


class Lines:
    """A document as columns over its lines: text, token cost (and its prefix sums), the line of the table header that a
    row belongs to, and the next line that is wider than a chunk may be."""

    def __init__(self, text, size, count):
        self.text = text.split("\n")
        self.cost = [count(x + "\n") for x in self.text]
        self.total = [0, *accumulate(self.cost)]
        is_row = [bool(_ROW.match(x)) for x in self.text]
        is_rule = [bool(_RULE.match(x)) for x in self.text[1:]] + [False]
        self.header = []
        for k, row in enumerate(is_row):
            known = self.header[-1] if self.header else None
            self.header.append(None if not row else k if is_rule[k] else known)
        self.wide = [k for k, c in enumerate(self.cost) if c > size] + [len(self.text)]

    def repeated(self, k):
        """Lines to repeat before line k when a chunk begins there: the header of its table."""
        at = self.header[k]
        return [at, at + 1] if at is not None and k > at + 1 else None

    def tail(self, shown, overlap):
        """The last of the shown lines that cost at most `overlap` together."""
        costs = list(accumulate(self.cost[k] for k in reversed(shown)))
        return shown[len(shown) - bisect_right(costs, overlap):]

    def sum(self, shown):
        return sum(self.cost[k] for k in shown)


def headed_parts(body):
    """(text, first-level heading above) of the parts that first- and second-level headings begin, blank parts left out;
    a body without such headings is one part as it stands."""
    starts, above = [m.start() for m in _TOP.finditer(body)], ""
    if not starts:
        yield body, ""
        return
    for since, to in pairwise([0, *starts, len(body)]):
        part = body[since:to].rstrip()
        head = _TOP.match(part)
        if head and len(head[1]) == 1:
            if part.strip():
                yield part, ""
            above = head[2].strip()
        elif part.strip():
            yield part, above if head else ""


def _slices(line, size, overlap):
    """A line that is too wide, by tokens."""
    spans = [m.span() for m in _TOKEN.finditer(line)]
    for at in range(0, len(spans), max(1, size - overlap)):
        part = spans[at:at + size]
        yield line[part[0][0]:part[-1][1]], len(part)


def windows(section, above, size, overlap, count=count_tokens):
    """An oversized section as (text, tokens, heading path). Each window takes as many whole lines as fit, found in the
    prefix sums; the next begins with the header of a cut table, else with a short tail of this one. Only a line wider
    than `size` is itself cut."""
    lines, parts = Lines(section, size, count), []
    at, carried = 0, []
    while at < len(lines.text):
        barrier = lines.wide[bisect_left(lines.wide, at)]
        room = lines.total[at] + size - lines.sum(carried)
        to = min(barrier, max(bisect_right(lines.total, room) - 1, at + 1))
        shown = carried + list(range(at, to))
        if shown:
            parts.append(("\n".join(lines.text[k] for k in shown), lines.sum(shown)))
        if to < len(lines.text) and to == barrier:
            parts.extend(_slices(lines.text[to], size, overlap))
            at, carried = to + 1, []
        else:
            at = to
            if at < len(lines.text):
                repeated = lines.repeated(at)
                carried = lines.tail(shown, overlap) if repeated is None else repeated
    own = _ANY.sub("", lines.text[0].strip()) if _ANY.match(lines.text[0]) else ""
    later = " > ".join(x for x in (above, own) if x)
    return [(text, tokens, later if k else above) for k, (text, tokens) in enumerate(parts)]


def cut_document(body, size=512, overlap=64, count=count_tokens):
    """(text, tokens, heading path) of every chunk, in order: neighbouring parts share a chunk while they fit."""
    parts = [(text, above, count(text)) for text, above in headed_parts(body)]
    total, out, at = [0, *accumulate(n for *_, n in parts)], [], 0
    while at < len(parts):
        to = bisect_right(total, total[at] + size, lo=at) - 1
        if to > at:
            out.append(("\n".join(text for text, *_ in parts[at:to]), total[to] - total[at], parts[at][1]))
            at = to
        else:
            out.extend(windows(*parts[at][:2], size, overlap, count))
            at += 1
    return out


def chunk_documents(docs: DataFrame, p=DEFAULTS, count=count_tokens) -> DataFrame:
    """Chunks of (rel_path, body, context). The context is stored beside the text, never inside it."""

    def run(batches):
        for pdf in batches:
            rows = [
                (path, i, text, tokens, ctx if p.contextual_prefix else "", heading)
                for path, body, ctx in zip(pdf["rel_path"], pdf["body"], pdf["context"])
                for i, (text, tokens, heading) in enumerate(cut_document(body, p.chunk_tokens, p.chunk_overlap, count))
            ]
            yield pd.DataFrame(rows, columns=["rel_path", "chunk_idx", "text", "token_count", "context", "heading_path"])

    cut = docs.select("rel_path", "body", "context").mapInPandas(run, _OUT)
    wide_id = F.sha2(F.concat_ws("\x00", "rel_path", F.col("chunk_idx").cast("string")), 256)
    return cut.withColumns({"chunk_id": wide_id, "chunk_hash": chunk_hash("text", "context", "heading_path")})


def heading_ancestry(lines: DataFrame) -> DataFrame:
    """For (rel_path, pos, line): each first- or second-level heading with the first-level heading above it."""
    level = F.length(F.regexp_extract("line", HEADER, 1))
    text = F.trim(F.regexp_extract("line", HEADER, 2))
    above = Window.partitionBy("rel_path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    d = lines.withColumns({"level": level, "heading": text})
    d = d.withColumn("above", F.last(F.when(F.col("level") == 1, F.col("heading")), ignorenulls=True).over(above))
    return d.filter(F.col("level").isin(1, 2)).select(
        "rel_path", "pos", "heading", F.when(F.col("level") == 2, F.coalesce("above", F.lit(""))).otherwise(F.lit("")).alias("above")
    )


def table_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(is_table_row("line") | is_table_rule("line"))
