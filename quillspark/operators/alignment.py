"""Alignment of labelled regions with the words that a text recogniser read: BIO tags for every word.

Lines become words with boxes by the width of their characters; words and regions whose boxes touch are measured; a word
belongs to the region that covers at least half of it; texts that the boxes place wrongly are put right by
aligning the region's text with its lines; small regions take a free word; captions leave their entity; and
what interrupts an entity begins it anew.

Spark deals the records of pages (:func:`page_records`) by page and puts them in order, once; a task then walks its records and
settles some thousands of pages at a time, in arrays, so that nothing is joined or written between the steps. It holds those pages,
or one page larger than that, with the pairs that touch. Error rates are worked out by Spark.

Edge cases: a null or blank line has no words; a line whose polygon has not four corners counts as its bounding
box; words of no area are ignored; a page without regions has words without tags, one without words has
no rows; a region without text is placed by its area alone; lines without a number and records without a page are left out.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructType, _parse_datatype_string

from ..functions import polygons as P
from ..functions import text as X
from .sequence import row_bands

#: Relative widths of printed characters, and the labels whose captions are left out.
NARROW, WIDE = "iljI.,:;'|!()[]/-", "mwMW"
BLANK_WIDTH, NARROW_WIDTH, WIDE_WIDTH, DIGIT_WIDTH, CAPITAL_WIDTH, OTHER_WIDTH = 0.28, 0.28, 0.85, 0.56, 0.68, 0.53
CAPTIONED = ["ADDRESS", "TIMESTAMP"]
ASSIGN, IGNORE, LINE_OVERLAP, REGION_COVER, TEXT_ERROR = 0.5, 0.2, 0.5, 0.5, 0.34
#: A word ends at white space, and after a colon that follows a letter where text goes on.
WORD_OF_LINE = re.compile(r"\S+")
AFTER_COLON = re.compile(r"(?<=[^\W\d_]:)(?=\S)")
#: Kinds of records, characters of a line that is split together with others, and records that a task takes together.
PAGE, LINE, REGION = 0, 1, 2
LONG_LINE = 256
RECORDS = 40_000


@cache
def character_width(ch: str) -> float:
    base = unicodedata.normalize("NFD", ch)[0]
    if base == " ":
        return BLANK_WIDTH
    if base in NARROW:
        return NARROW_WIDTH
    if base in WIDE:
        return WIDE_WIDTH
    return DIGIT_WIDTH if base.isdigit() else CAPITAL_WIDTH if base.isupper() else OTHER_WIDTH


def word_places(text: str | None) -> list[dict]:
    """Words of a line with the shares of its width at which they start and end."""
    places = [0.0]
    for ch in text or "":
        places.append(places[-1] + character_width(ch))
    out = []
    for found in WORD_OF_LINE.finditer(text or ""):
        at = found.start()
        for piece in AFTER_COLON.split(found.group()):
            out.append({"text": piece, "start": places[at] / places[-1], "end": places[at + len(piece)] / places[-1]})
            at += len(piece)
    return out


@F.pandas_udf(ArrayType(StructType().add("text", StringType()).add("start", DoubleType()).add("end", DoubleType())))
def _word_places(lines: pd.Series) -> pd.Series:
    return lines.map(word_places)


#: Said to give other words each time, so that the planner neither copies it to every use nor moves filters below it.
_places_once = _word_places.asNondeterministic()


def split_lines(lines: DataFrame, doc: str) -> DataFrame:
    """``doc, line, text, polygon`` with ``words`` (``text, polygon`` in order) in place of a line's own, and what else it has."""
    quad = F.when(F.size("polygon") == 4, F.col("polygon")).otherwise(P.quad_of_box(F.col("polygon")))
    others = [c for c in lines.columns if c not in (doc, "line", "text", "polygon")]
    placed = lines.withColumn("__quad", quad).withColumn("__words", _places_once("text"))
    word = lambda w: F.struct(w["text"].alias("text"), P.part_of_quad(F.col("__quad"), w["start"], w["end"]).cast(P.POLYGON).alias("polygon"))
    return placed.select(doc, "line", F.transform("__words", word).alias("words"), *others)


@lru_cache(1 << 16)
def match_text(text: str | None) -> str:
    return " ".join(unicodedata.normalize("NFC", text or "").lower().split())


def joined_words(words: list[str]) -> tuple[str, list[tuple[int, int]]]:
    """The words' match texts, joined, and where each starts and ends there."""
    spans, at = [], 0
    found = list(map(match_text, words))
    for w in found:
        spans.append((at, at + len(w)))
        at += len(w) + 1
    return " ".join(found), spans


def spelling_words(text: str | None, current: list[str], joined: str, spans: list[tuple[int, int]], most: float = TEXT_ERROR) -> list[int] | None:
    """Places in the words of some lines (:func:`joined_words`) that spell a region's text better than its ``current`` words do; None where none do.

    The region's text is aligned with the joined words; a word counts where half of it or more lies in the match.
    """
    wanted = match_text(text)
    have = match_text(" ".join(current))
    if not wanted or have == wanted or not spans:
        return None
    edits, start, end = X.substring_distance(wanted, joined)
    chosen = [k for k, (a, b) in enumerate(spans) if 2 * (min(b, end) - max(a, start)) >= b - a]
    if not chosen or edits / len(wanted) >= most:
        return None
    # An exact part is better than any other text.
    error = X.edit_distance(wanted, have) / len(wanted) if current and edits else 1.0
    return chosen if edits / len(wanted) < error else None


def caption_words(words: list[str], most: int = 3) -> int:
    """:func:`contracts.caption_length` of one list."""
    for n, word in enumerate(words[:most], 1):
        if re.search("[0-9]", word):
            return 0
        if word.endswith(":"):
            return n if n < len(words) else 0
    return 0


# -- words of many lines --------------------------------------------------------------------------

#: By character, filled as characters are met: its width, and whether it is white space (1) or a letter (2).
_widths, _kinds = np.full(0x110000, np.nan), np.zeros(0x110000, "uint8")


def _learn(codes: np.ndarray) -> None:
    for c in np.unique(codes[np.isnan(_widths[codes])]).tolist():
        _widths[c] = character_width(chr(c))
        _kinds[c] = 1 if chr(c).isspace() else 2 if re.match(r"[^\W\d_]", chr(c)) else 0


def words_of_lines(texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """:func:`word_places` of many lines: places of the words' lines, and the words' texts, starts and ends."""
    lengths = np.fromiter(map(len, texts), "int64", len(texts))
    if (lengths > LONG_LINE).any():
        short, long = np.flatnonzero(lengths <= LONG_LINE), np.flatnonzero(lengths > LONG_LINE)
        line, found, start, end = words_of_lines([texts[i] for i in short])
        more = [(i, w) for i in long.tolist() for w in word_places(texts[i])]
        line = np.concatenate([short[line], np.fromiter((i for i, _ in more), "int64", len(more))])
        start, end = (np.concatenate([v, np.array([w[n] for _, w in more], "float64")]) for v, n in ((start, "start"), (end, "end")))
        order = np.argsort(line, kind="stable")
        found += [w["text"] for _, w in more]
        return line[order], [found[k] for k in order.tolist()], start[order], end[order]
    most = max(1, int(lengths.max(initial=0)))
    codes = np.array(texts, f"U{most}").view("uint32").reshape(len(texts), most)
    _learn(codes)
    places = np.zeros((len(texts), most + 1))
    np.cumsum(_widths[codes], axis=1, out=places[:, 1:])
    kinds = _kinds[codes]
    solid = (np.arange(most) < lengths[:, None]) & (kinds != 1)
    starts, ends = solid.copy(), solid.copy()
    starts[:, 1:] &= ~solid[:, :-1]
    starts[:, 2:] |= solid[:, 2:] & (codes[:, 1:-1] == ord(":")) & (kinds[:, :-2] == 2)
    ends[:, :-1] &= ~solid[:, 1:] | starts[:, 1:]
    (line, first), (_, last) = np.nonzero(starts), np.nonzero(ends)
    whole = places[line, lengths[line]]
    found = [texts[i][a:b] for i, a, b in zip(line.tolist(), first.tolist(), (last + 1).tolist(), strict=True)]
    return line, found, places[line, first] / whole, places[line, last + 1] / whole


# -- pages ----------------------------------------------------------------------------------------


def record_of_page(width: Column, height: Column, rotation: Column) -> Column:
    """Numbers of a page's record: its upright size, and how it is turned."""
    size, turn = P.upright_size(width, height, rotation), P.turn(width, height, rotation)
    return F.array(*(v.cast("double") for v in (size["width"], size["height"], turn["c"], turn["s"], turn["dx"], turn["dy"])))


def page_records(pages: DataFrame, lines: DataFrame, regions: DataFrame, doc: str) -> DataFrame:
    """Pages, lines and regions (:func:`align_pages`) as one table, dealt by page and in order.

    ``doc, kind, line, region, label, text, numbers``: the numbers of a line or a region are its corners, x and y in turn.
    """
    corners = F.flatten(F.transform("polygon", lambda q: F.array(q["x"], q["y"]))).cast("array<double>").alias("numbers")
    kind = lambda k: F.lit(k).cast("tinyint").alias("kind")
    one = lines.select(doc, kind(LINE), "line", "text", corners)
    two = regions.select(doc, kind(REGION), "region", "label", "text", corners)
    size = pages.select(doc, kind(PAGE), record_of_page(F.col("width"), F.col("height"), F.col("rotation")).alias("numbers"))
    all_ = one.unionByName(two, allowMissingColumns=True).unionByName(size, allowMissingColumns=True)
    all_ = all_.select(doc, "kind", "line", "region", "label", "text", "numbers").where(F.col(doc).isNotNull())
    return all_.repartition(doc).sortWithinPartitions(doc, "kind", "line", "region")


class _Pages:
    """Some whole pages out of :func:`page_records`, with their words settled."""

    def __init__(self, t: pa.Table, source_frame: bool):
        t = t.combine_chunks()
        column = lambda i: t.column(i).combine_chunks() if t.column(i).num_chunks != 1 else t.column(i).chunk(0)
        self.docs, kinds, self.lines, self.regions, labels, texts, numbers = map(column, range(7))
        kinds = kinds.to_numpy(zero_copy_only=False)
        page = np.cumsum(np.concatenate([[0], ends_of_pages(self.docs)]))
        lengths = numbers.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
        self.flat, at = numbers.flatten().to_numpy(zero_copy_only=False).astype("float64"), np.cumsum(lengths) - lengths
        known, rows = np.unique(page[kinds == PAGE], return_index=True)
        info = np.full((page[-1] + 1, 6), np.nan)
        info[known] = self.flat[at[np.flatnonzero(kinds == PAGE)[rows], None] + np.arange(6)]
        here = np.zeros(page[-1] + 1, "bool")
        here[known] = True
        numbered = lambda ids: ids.is_valid().to_numpy(zero_copy_only=False)
        line_rows = np.flatnonzero((kinds == LINE) & here[page] & numbered(self.lines))
        self.region_rows = np.flatnonzero((kinds == REGION) & here[page])
        line_page, self.region_page = page[line_rows], page[self.region_rows]
        text_of = lambda rows: texts.take(pa.array(rows)).to_numpy(zero_copy_only=False).tolist()
        self.region_texts = text_of(self.region_rows)
        kept = labels.take(pa.array(self.region_rows)).dictionary_encode()
        self.labels, self.label = kept.dictionary.to_pylist(), kept.indices.fill_null(-1).to_numpy(zero_copy_only=False)

        def turned(xs: np.ndarray, ys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            c, s, dx, dy = info[of, 2:].T
            return c * xs - s * ys + dx, s * xs + c * ys + dy

        def polygons(rows: np.ndarray, turn: bool) -> P.Polygons:
            n = lengths[rows] // 2
            first = np.repeat(at[rows] - 2 * (np.cumsum(n) - n), n) + 2 * np.arange(n.sum())
            xs, ys = self.flat[first], self.flat[first + 1]
            return P.Polygons(n, *(turned(xs, ys, np.repeat(page[rows], n)) if turn else (xs, ys)))

        # Words, and the order in which their lines are read.
        whole = polygons(line_rows, False)
        box, four = whole.boxes(), whole.lengths == 4
        x, y = (np.stack([box[:, i], box[:, j], box[:, k], box[:, m]], 1) for i, j, k, m in ((0, 2, 2, 0), (1, 1, 3, 3)))
        x[four], y[four] = (v[whole.starts[four, None] + np.arange(4)] for v in (whole.xs, whole.ys))
        line, words, start, end = words_of_lines([text or "" for text in text_of(line_rows)])
        along = lambda v, a, b, share: v[line, a] + (v[line, b] - v[line, a]) * share
        x, y = (np.stack([along(v, 0, 1, start), along(v, 0, 1, end), along(v, 3, 2, end), along(v, 3, 2, start)], 1) for v in (x, y))
        if source_frame:
            whole = polygons(line_rows, True)
            x, y = (v.reshape(-1, 4) for v in turned(x.ravel(), y.ravel(), np.repeat(line_page[line], 4)))
        boxes = np.stack([f(f(v[:, 0], v[:, 1]), f(v[:, 2], v[:, 3])) for f in (np.fmin, np.fmax) for v in (x, y)], 1)
        read, first, sizes = np.unique(line, return_index=True, return_counts=True)
        sides = zip((np.fmin, np.fmin, np.fmax, np.fmax), boxes.T, strict=True)
        line_boxes = np.stack([f.reduceat(v, first) for f, v in sides], 1) if len(read) else boxes
        order = reading_order(line_page[read], line_boxes)
        read, sizes, line_boxes = read[order], sizes[order], line_boxes[order]
        place = np.repeat(first[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(line))
        x, y, self.boxes, self.words = x[place], y[place], boxes[place], [words[k] for k in place.tolist()]
        self.word_rows, self.word_page = line_rows[line[place]], line_page[line[place]]
        from_first = lambda pages: np.arange(len(pages)) - np.searchsorted(pages, pages)
        self.word, self.rank = from_first(self.word_page), np.repeat(from_first(line_page[read]), sizes)
        self.size = info[self.word_page, :2]
        starts = np.cumsum(sizes) - sizes

        # What regions cover of words; of equals the first region has a word.
        polygon, outline = P.Polygons(np.full(len(x), 4), x.ravel(), y.ravel()), polygons(self.region_rows, True)
        area, region_area, region_boxes = polygon.areas(), outline.areas(), outline.boxes()
        region_boxes[~numbered(self.regions)[self.region_rows]] = np.nan
        i, r = P.touching(line_page[read], line_boxes, self.region_page, region_boxes)
        w = np.repeat(starts[i] - (np.cumsum(sizes[i]) - sizes[i]), sizes[i]) + np.arange(sizes[i].sum())
        r = np.repeat(r, sizes[i])
        met = P.touch(self.boxes[w], region_boxes[r])
        w, r = w[met], r[met]
        common = polygon.common(outline, w, r)
        some = np.flatnonzero((area[w] > 0) & (common > 0))
        cover = common[some] / area[w[some]]
        some = some[np.lexsort((r[some], -cover, w[some]))]
        some = some[np.concatenate([[True], w[some][1:] != w[some][:-1]])[: len(some)]]
        cover, own = np.zeros(len(area)), np.full(len(area), -1)
        cover[w[some]] = common[some] / area[w[some]]
        own[w[some]] = r[some]
        own[cover < ASSIGN] = -1
        self.vague = (area <= 0) | ((cover >= IGNORE) & (cover < ASSIGN))

        # Regions whose words are not their text look for it in the lines that they overlap.
        held = self.members(own)
        members = list(map(self.texts, held))
        unread = np.array([t is not None and t != " ".join(m) for t, m in zip(self.region_texts, members, strict=True)], "bool")
        wide, line_area = whole.boxes()[read], whole.areas()[read]
        wanting = np.flatnonzero(unread)
        i, k = P.touching(line_page[read], wide, self.region_page[wanting], region_boxes[wanting])
        smaller = np.minimum(line_area[i], region_area[wanting[k]])
        near = (smaller > 0) & (whole.common(outline, read[i], wanting[k]) >= LINE_OVERLAP * smaller)
        i, k = i[near], wanting[k[near]]
        owner = own.tolist()
        self.take_spelled(i, k, starts, sizes, held, members, owner)

        # Regions without words take, of the free words able to fill them, the last that covers most.
        empty = np.array([not m for m in members], "bool")
        able = np.flatnonzero(empty[r] & (region_area[r] > 0) & (common >= REGION_COVER * region_area[r]))
        able = able[np.lexsort((-w[able], -common[able] / region_area[r[able]], r[able]))]
        filled = set(owner)
        for region, word in zip(r[able].tolist(), w[able].tolist(), strict=True):
            if region not in filled and owner[word] < 0 and len(self.words[word]) <= 2 * len((self.region_texts[region] or "").replace(" ", "")) + 2:
                owner[word] = region
                filled.add(region)
        self.owner = np.array(owner, "int64")

    def members(self, owner: np.ndarray) -> list[list[int]]:
        """Places of the words of each region, in order."""
        order = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[order], np.arange(len(self.region_rows) + 1)).tolist()
        words = order.tolist()
        return [words[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def take_spelled(self, lines: np.ndarray, regions: np.ndarray, starts: np.ndarray, sizes: np.ndarray, held: list[list[int]], members: list[list[str]], owner: list[int]) -> None:
        """Every region in order takes the words that spell its text better than those it has (``held``, their texts ``members``), if
        each is free or its own.

        ``lines`` (in reading order; words from ``starts``, ``sizes`` to each) are those about ``regions``, side by side.
        """
        order = np.lexsort((lines, regions))
        lines, regions = lines[order].tolist(), regions[order].tolist()
        starts, sizes = starts.tolist(), sizes.tolist()
        seen: dict[int, tuple] = {}
        at = 0
        while at < len(regions):
            region, end = regions[at], at + 1
            while end < len(regions) and regions[end] == region:
                end += 1
            if end == at + 1:
                line = lines[at]
                first = starts[line]
                if line not in seen:
                    seen[line] = joined_words(self.words[first : first + sizes[line]])
                found = spelling_words(self.region_texts[region], members[region], *seen[line])
                chosen = [first + k for k in found or ()]
            else:
                around = [w for line in lines[at:end] for w in range(starts[line], starts[line] + sizes[line])]
                found = spelling_words(self.region_texts[region], members[region], *joined_words([self.words[w] for w in around]))
                chosen = [around[k] for k in found or ()]
            if chosen and all(owner[w] in (-1, region) for w in chosen):
                for w in held[region]:
                    owner[w] = -1
                for w in chosen:
                    owner[w] = region
            at = end

    def captions(self, words: list, text=lambda w: w) -> np.ndarray:
        """How many words of each region are its caption; ``text`` of what ``words`` has for a region are these words."""
        captioned = np.isin(self.label, [k for k, label in enumerate(self.labels) if label in CAPTIONED])
        skip = np.zeros(len(words), "int64")
        for k in np.flatnonzero(captioned).tolist():
            skip[k] = caption_words(text(words[k]))
        return skip

    def texts(self, places: list[int]) -> list[str]:
        return [self.words[k] for k in places]

    def tagged(self, schema: pa.Schema) -> pa.RecordBatch:
        """Rows of words: captions are outside, the first word after them begins, what interrupts an entity makes it begin anew."""
        skip = self.captions(self.members(self.owner), self.texts)
        order = np.argsort(self.owner, kind="stable")
        nth = np.empty(len(order), "int64")
        nth[order] = np.arange(len(order)) - np.searchsorted(self.owner[order], self.owner[order])
        of = lambda v, none: np.where(self.owner >= 0, v[self.owner], none) if len(v) else np.full(len(self.owner), none)
        label, skip = of(self.label, -1), of(skip, 0)
        inside = (self.owner >= 0) & (nth >= skip)
        region = np.where(inside, self.owner, -1)
        # 0 outside, 1 ignored, 2 none (a region without a label), then B and I of each label.
        tag = np.where(inside, np.where(label < 0, 2, 3 + 2 * label + (nth > skip)), ((self.owner < 0) & self.vague).astype("int64"))
        counted = np.where((tag != 1) & (tag != 2), np.arange(len(tag)), -1)
        before = np.concatenate([[-1], np.maximum.accumulate(counted)])[: len(tag)]
        same = (before >= 0) & (self.word_page[before] == self.word_page) & (region[before] == region) if len(tag) else np.zeros(0, "bool")
        tag = np.where((tag > 2) & (tag % 2 == 0) & ~same, tag - 1, tag)
        names = pa.array(["O", "IGNORE", None, *(f"{b}-{x}" for x in self.labels for b in "BI")], pa.string())
        scaled = np.rint(np.fmax(0.0, np.fmin(1000.0, self.boxes * 1000 / np.concatenate([self.size, self.size], 1)))).astype("int32").ravel()
        box = pa.ListArray.from_arrays(pa.array(np.arange(0, len(scaled) + 1, 4, "int32")), pa.array(scaled))
        rows = pa.array(self.word_rows)
        regions = self.regions.take(pa.array(np.append(self.region_rows, 0)[region], mask=region < 0))
        columns = [self.docs.take(rows), pa.array(self.word), self.lines.take(rows), pa.array(self.rank), pa.array(self.words, pa.string()), box, names.take(pa.array(tag)), regions]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def readings(self, schema: pa.Schema) -> pa.RecordBatch:
        """Rows of regions: what stands there and what was read, both without captions, and both composed where they differ."""
        members = list(map(self.texts, self.members(self.owner)))
        tokens = [re.findall(r"[^ \t\n\x0b\f\r]+", t or "") for t in self.region_texts]
        truth = [" ".join(t[k:]) for t, k in zip(tokens, self.captions(tokens).tolist(), strict=True)]
        left = [m[k:] for m, k in zip(members, self.captions(members).tolist(), strict=True)]
        read = list(map(" ".join, left))
        composed = lambda texts: pa.array([unicodedata.normalize("NFC", c) if a != b else None for a, b, c in zip(truth, read, texts, strict=True)], pa.string())
        rows = pa.array(self.region_rows)
        labels = pa.array(self.labels, pa.string()).take(pa.array(self.label, mask=self.label < 0))
        columns = [self.docs.take(rows), self.regions.take(rows), labels, pa.array(truth, pa.string()), pa.array(read, pa.string()), pa.array(map(len, left), pa.int32()), composed(truth), composed(read)]
        return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def ends_of_pages(docs: pa.Array) -> np.ndarray:
    """Whether the record after each one is of another page."""
    return pc.not_equal(docs[1:], docs[:-1]).to_numpy(zero_copy_only=False)


def reading_order(pages: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Places of lines, ascending by page, in the order of :func:`row_bands` of each page."""
    order = np.lexsort((boxes[:, 0], boxes[:, 1] + boxes[:, 3], pages))
    top, bottom, page = boxes[order, 1], boxes[order, 3], pages[order]
    overlap = np.minimum(bottom[1:], bottom[:-1]) - np.maximum(top[1:], top[:-1])
    # Where no line joins the one above, bands are lines; only other pages are gone through line by line.
    joins = (page[1:] == page[:-1]) & (overlap >= 0.5 * np.minimum((bottom - top)[1:], (bottom - top)[:-1]))
    for p in np.unique(page[1:][joins]):
        first, last = np.searchsorted(pages, [p, p + 1])
        order[first:last] = first + np.array([i for band in row_bands(list(map(tuple, boxes[first:last].tolist()))) for i in band])
    return order


def whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Records some thousands at a time, those of a page together."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        if rows >= RECORDS:
            ends = np.flatnonzero(ends_of_pages(pa.concat_arrays([held[-1].column(0)[-1:], b.column(0)])))
            if len(ends):
                yield pa.Table.from_batches([*held, b[: ends[-1]]])
                held, rows, b = [], 0, b[ends[-1] :]
        held.append(b)
        rows += b.num_rows
    if held:
        yield pa.Table.from_batches(held)


def align_pages(pages: DataFrame, lines: DataFrame, regions: DataFrame, doc: str, source_frame: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tags of words, and what became of regions.

    ``pages``: ``doc, width, height, rotation`` (degrees clockwise to upright); ``lines``: ``doc, line, text, polygon``,
    in the upright frame or, with ``source_frame``, the page's own; ``regions``: ``doc, region, label, text, polygon`` in
    the page's own frame, ``region`` in the order in which they claim words.

    Returns ``doc, word, line, rank, text, box, tag, region`` and ``doc, region, label, truth, read, words, cer``, each worked
    out when it is asked for.
    """
    return align_records(page_records(pages, lines, regions, doc), doc, source_frame)


def align_records(records: DataFrame, doc: str, source_frame: bool = False) -> tuple[DataFrame, DataFrame]:
    """:func:`align_pages` of :func:`page_records`, or of a table like it: the records of a page one after the other in a
    partition, its lines and its regions each in order."""
    kind = dict(records.dtypes)
    of_words = f"`{doc}` {kind[doc]}, word int, line {kind['line']}, rank int, text string, box array<int>, tag string, region {kind['region']}"
    of_regions = f"`{doc}` {kind[doc]}, region {kind['region']}, label string, truth string, read string, words int, __truth string, __read string"

    def run(rows, schema: str) -> DataFrame:
        types = _parse_datatype_string(schema)
        arrow = to_arrow_schema(types)

        def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t in whole_pages(batches):
                yield rows(_Pages(t, source_frame), arrow)

        return records.select(doc, "kind", "line", "region", "label", "text", "numbers").mapInArrow(settled, types)

    read = run(_Pages.readings, of_regions)
    form = lambda c: F.coalesce(F.lower(X.collapse(F.col(c))), F.lit(""))
    error = F.when(F.col("__truth").isNotNull(), X.character_error_rate(form("__truth"), form("__read"))).when(F.col("truth") != "", 0.0)
    stats = read.select(doc, "region", "label", "truth", "read", "words", F.when(F.col("words") > 0, error).alias("cer"))
    return run(_Pages.tagged, of_words), stats
