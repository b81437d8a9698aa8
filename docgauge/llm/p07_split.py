"""Problem 7: cutting oversized texts into overlapping pieces at natural boundaries.

A text is processed in ranges. A worker sees one range with a halo on both sides and lists the boundaries in it: after a
paragraph, a line, a sentence, a word. Only these tables of offsets are shuffled; they are read in range order as a
stream, lengths are prefix-summed to global offsets, and the cutter emits pieces (start, end) with a state of one
window. Pieces are then taken by offset: the narrow offsets come to the text, which is moved once. For texts in a table the
ranges are slices; for giant files, on any file system pyarrow reaches, they are byte ranges read by seeking, so no worker
holds a whole file.

A piece has at most ``limit`` characters. It ends at the strongest boundary in its last quarter (the latest of equal
ones), or, where there is none, at the last place for a hard cut. The next piece starts ``overlap`` characters before that end, or later at the
first boundary after that point within the overlap. Null and short texts (at most ``limit``) are one piece; an empty or
null text has none. Repeated keys are not supported in ``pieces`` of a table: each key is one text.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgauge.session import cut, shared_folder
from docgauge.sinks import paths

#: Section size of the judge and its overlap, in code points.
LIMIT, OVERLAP = 8000, 800
#: Code points (bytes, for files) of a range, and of its halo beyond the white space at its edges.
RANGE, HALO = 1 << 16, 64
#: Characters of pieces that a task hands over at once.
HELD = 4_000_000
#: Of boundaries between words only the last in so many characters is listed.
WORD_STEP = 40
#: Text without any boundary gets a place for a hard cut (rank 0) every so many characters.
HARD_STEP = 50

# A boundary lies at the end of the match: 4 paragraph, 3 line, 2 sentence, 1 word.
BOUNDARY = re.compile(r"((?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*)|(\r\n|\n|\r)|([.!?…][»”\"')\]]*[^\S\n\r]+)|([^\S\n\r]+)")


def boundaries(text: str, left: int, size: int) -> tuple[list[int], list[int]]:
    """(positions, ranks) in (0, size] of a range that starts at ``left`` within ``text`` (halo before and after)."""
    pos: list[int] = []
    rank: list[int] = []

    def fill(to: int) -> None:
        hard = range((pos[-1] if pos else 0) + HARD_STEP, to, HARD_STEP)
        pos.extend(hard)
        rank.extend([0] * len(hard))

    for m in BOUNDARY.finditer(text):
        at = m.end() - left
        if at <= 0:
            continue
        if at > size:
            break
        fill(at)
        r = 5 - m.lastindex
        if r == 1 and pos and rank[-1] == 1 and at - (pos[-2] if len(pos) > 1 else 0) < WORD_STEP:
            pos[-1] = at
            continue
        pos.append(at)
        rank.append(r)
    fill(size)
    return pos, rank


class Cutter:
    """Streams boundaries of one text and yields its pieces; holds the boundaries of one window."""

    def __init__(self, limit: int = LIMIT, overlap: int = OVERLAP, listed: bool = False):
        self.limit, self.overlap, self.listed = limit, overlap, listed  # listed: only at places in the tables
        self.start, self.seen, self.pos, self.rank = 0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def feed(self, pos: np.ndarray, rank: np.ndarray, seen: int, last: bool) -> Iterator[tuple[int, int, int]]:
        """Take the boundaries up to offset ``seen``; yield (start, end, rank of the cut)."""
        self.pos, self.rank, self.seen = np.r_[self.pos, pos], np.r_[self.rank, rank], seen
        while self.seen - self.start > self.limit:
            top = self.start + self.limit
            lo, hi = np.searchsorted(self.pos, [top - self.limit // 4, top], side="right")
            if hi > lo:
                best = self.rank[lo:hi].max()
                at = lo + int(np.flatnonzero(self.rank[lo:hi] == best)[-1])
                end, r = int(self.pos[at]), int(best)
            else:
                end, r = top, 0
            yield self.start, end, r
            a = int(np.searchsorted(self.pos, end - self.overlap, side="left"))
            if a < len(self.pos) and self.pos[a] < end and (self.rank[a] or self.listed):
                self.start = int(self.pos[a])
            else:
                self.start = end if self.listed else end - self.overlap
            keep = int(np.searchsorted(self.pos, self.start, side="left"))
            self.pos, self.rank = self.pos[keep:], self.rank[keep:]
        if last and self.seen > self.start:
            yield self.start, self.seen, 5


TABLES = "doc_id string, range_no long, n_ranges long, n_chars long, n_bytes long, positions array<int>, ranks array<int>, byte_positions array<int>"
PIECES = "doc_id string, piece_no int, start long, end long, cut int, byte_start long, byte_end long"


def _stitch(tables: DataFrame, limit: int, overlap: int, listed: bool = False) -> DataFrame:
    """Boundary tables of ranges -> pieces; each text's ranges pass in order through one task, as a stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, cutter, chars, nbytes, no = None, None, 0, 0, 0
        at_byte: dict[int, int] = {}
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if r.doc_id != doc:
                    doc, cutter, chars, nbytes, no, at_byte = r.doc_id, Cutter(limit, overlap, listed), 0, 0, 0, {0: 0}
                pos = np.asarray(r.positions, dtype=np.int64) + chars
                for p, b in zip(pos, r.byte_positions):
                    at_byte[int(p)] = int(b) + nbytes
                chars += r.n_chars
                nbytes += r.n_bytes
                at_byte[chars] = nbytes
                for a, b, rank in cutter.feed(pos, np.asarray(r.ranks, dtype=np.int64), chars, r.range_no == r.n_ranges - 1):
                    out.append((doc, no, a, b, rank, at_byte.get(a, -1), at_byte.get(b, -1)))
                    no += 1
                at_byte = {p: b for p, b in at_byte.items() if p >= cutter.start - overlap}
            yield pd.DataFrame(out, columns=["doc_id", "piece_no", "start", "end", "cut", "byte_start", "byte_end"])

    return tables.repartition("doc_id").sortWithinPartitions("doc_id", "range_no").mapInPandas(run, PIECES)


def _table(text: str, start: int, end: int) -> tuple[list[int], list[int]]:
    """(positions, ranks) of the range [start, end) of a text. A run of white space at an edge is seen whole."""
    lo, hi = start, end
    while lo and text[lo - 1].isspace():
        lo -= 1
    while hi < len(text) and text[hi].isspace():
        hi += 1
    lo = max(0, lo - HALO)
    return boundaries(text[lo : hi + HALO], start - lo, end - start)


def piece_offsets(docs: DataFrame, key: str = "doc_id", text: str = "markdown", limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE, over_only: bool = True) -> DataFrame:
    """Pieces of the texts of a table, by offset: (doc_id, piece_no, start, end, cut)."""
    n = F.length(text)
    big = docs.where(n > (limit if over_only else 0)).select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["doc_id"], pdf["t"]):
                ranges = range(0, len(t), size)
                for no, a in enumerate(ranges):
                    b = min(a + size, len(t))
                    rows.append((k, no, len(ranges), b - a, 0, *_table(t, a, b), []))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TABLES.split(", ")])

    return _stitch(big.mapInPandas(run, TABLES), limit, overlap).drop("byte_start", "byte_end")


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "markdown", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces with their text: (doc_id, piece_no, start, end, cut, piece); texts up to ``limit`` are one piece."""
    offsets = piece_offsets(docs, key, text, limit, overlap)
    # A few numbers per ``limit`` characters of a text: they come to it as one array.
    per = offsets.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start", "end", "cut"))).alias("at"))
    src = docs.select(F.col(key).cast("string").alias("doc_id"), F.col(text).alias("t"))
    schema = "doc_id string, piece_no int, start long, end long, cut int, piece string"

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in schema.split(", ")]
        for pdf in batches:
            rows, held = [], 0
            for k, t, at in zip(pdf["doc_id"], pdf["t"], pdf["at"]):
                for p in at:
                    rows.append((k, p["piece_no"], p["start"], p["end"], p["cut"], t[p["start"] : p["end"]]))
                    held += p["end"] - p["start"]
                    if held > HELD:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
            yield pd.DataFrame(rows, columns=columns)

    long = src.where(F.length("t") > limit).join(per, "doc_id").select("doc_id", "t", "at").mapInPandas(take, schema)
    zero = F.lit(0).cast("long")
    short = src.where((F.length("t") <= limit) & (F.length("t") > 0)).select("doc_id", F.lit(0).alias("piece_no"), zero.alias("start"), F.length("t").cast("long").alias("end"), F.lit(5).alias("cut"), F.col("t").alias("piece"))
    return long.unionByName(short)


def _read(fs, path: str, start: int, end: int) -> bytes:
    with fs.open_input_file(path) as f:
        f.seek(start)
        return f.read(end - start)


SPACES = b" \t\n\r\x0b\x0c"


def _around(fs, path: str, start: int, end: int, n: int) -> tuple[bytes, int]:
    """(bytes, offset of the first) of a byte range with its halo; a run of white space at an edge is read whole."""
    lo, data = max(0, start - HALO), b""
    data = _read(fs, path, lo, min(n, end + HALO))
    step = HALO
    while lo and not data[: start - lo].strip(SPACES):  # nothing but white space before the range so far
        step *= 2
        more = max(0, lo - step)
        data, lo = _read(fs, path, more, lo) + data, more
    if lo:  # the halo proper lies before the white space
        more = max(0, lo - HALO)
        data, lo = _read(fs, path, more, lo) + data, more
    step = HALO
    while lo + len(data) < n and not data[end - lo :].strip(SPACES):
        step *= 2
        data += _read(fs, path, lo + len(data), min(n, lo + len(data) + step))
    return data, lo


def file_pieces(spark: SparkSession, files: list[str] | DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, size: int = RANGE) -> DataFrame:
    """Pieces of giant UTF-8 files on a shared file system, by byte range: no worker reads a whole file.

    ``files``: paths or URIs (a list, or a DataFrame with ``path`` and ``n`` bytes). Rows are those of ``pieces``, with byte
    offsets and the path as doc_id. An empty file has none; bytes that are no UTF-8 come out as U+FFFD.
    """
    if not isinstance(files, DataFrame):
        rows = [(p, at.get_file_info(q).size) for p in files for at, q in (paths.at(p),)]
        files = spark.createDataFrame(rows, "path string, n long")
    files = files.where("n > 0").select(F.col("path").alias("doc_id"), "n")
    total = files.agg(F.sum("n")).first()[0] or 0
    last = F.call_function("div", F.col("n") - 1, F.lit(size))
    ranges = files.select("doc_id", "n", (last + 1).alias("n_ranges"), F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("range_no"))
    ranges = ranges.repartition(max(8, total // (1 << 27)), "doc_id", "range_no")

    def detect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                fs, path = paths.at(r.doc_id)
                start = r.range_no * size
                end = min(start + size, r.n)
                data, lo = _around(fs, path, start, end, r.n)
                # A code point belongs to the range that holds its first byte.
                first = lambda at: next((i for i in range(at - lo, len(data)) if data[i] & 0xC0 != 0x80), len(data))  # noqa: B023, E731
                a, b, h = first(start), first(end), first(lo)
                before, own, after = (x.decode("utf-8", "replace") for x in (data[h:a], data[a:b], data[b:]))
                pos, rank = boundaries(before + own + after, len(before), len(own))
                cuts = [0, *pos]
                steps = np.cumsum([len(own[x:y].encode()) for x, y in zip(cuts, cuts[1:])]) if pos else []
                rows.append((r.doc_id, r.range_no, r.n_ranges, len(own), b - a, pos, rank, [int(x) for x in steps]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TABLES.split(", ")])

    offsets = _stitch(ranges.mapInPandas(detect, TABLES), limit, overlap, listed=True)

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = []
            for r in pdf.itertuples(index=False):
                fs, path = paths.at(r.doc_id)
                texts.append(_read(fs, path, r.byte_start, r.byte_end).decode("utf-8", "replace"))
            yield pdf.assign(piece=pd.Series(texts, dtype=object, index=pdf.index))

    return offsets.mapInPandas(emit, PIECES + ", piece string")


def exported(docs: DataFrame, folder: str, key: str = "doc_id", text: str = "markdown", limit: int = LIMIT) -> DataFrame:
    """The oversized texts of a table written as files into a shared folder, by the tasks: path, n (bytes)."""
    paths.make_folder(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["k"], pdf["t"]):
                path, data = paths.join(folder, f"{k}.md"), t.encode("utf-8", "replace")
                paths.put(path, data)
                rows.append((path, len(data)))
            yield pd.DataFrame(rows, columns=["path", "n"])

    return docs.where(F.length(text) > limit).select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInPandas(run, "path string, n long")


def file_query(docs: DataFrame) -> DataFrame:
    """p7_file_pieces: the oversized documents written as files in the shared folder and cut there by byte ranges."""
    folder = paths.join(shared_folder(docs.sparkSession), f"texts-{uuid.uuid4().hex}")
    rows = file_pieces(docs.sparkSession, cut(exported(docs, folder)))
    name = F.url_decode(F.regexp_replace(F.element_at(F.split("doc_id", "/"), -1), r"\+", "%2B"))
    return rows.withColumn("doc_id", F.regexp_replace(name, r"\.md$", ""))


def found(docs: DataFrame) -> DataFrame:
    """p7_found: (doc_id) of the documents that are cut into more than one piece."""
    return piece_offsets(docs).where("piece_no = 1").select("doc_id").distinct()
