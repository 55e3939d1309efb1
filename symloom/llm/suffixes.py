"""Removal of repeated byte strings, by anchored suffix sorting with hash comparisons.

A byte goes if some string of `length` (200) bytes that covers it also starts anywhere else.

Anchors. Every window of `length` bytes has an anchor: its least hash of `gram` bytes (the leftmost
of equal ones). Equal windows have equal anchors at equal distances, so only windows of one anchor
hash can be equal. The windows of one anchor occurrence start at consecutive bytes and make up one
segment of text; segments are what is compared.

Shares. Per anchor hash, the number of occurrences and whether all their segments have one hash tell
most cases apart without any text: an anchor hash that occurs once has no repeats, one whose
segments are all alike is repeated throughout. Of the rest, a segment that occurs twice is repeated.

Suffix sort. What is left are segments that occur once but share their anchor hash with other
segments: the borders of repeated passages. Windows whose polynomial hash occurs once are passed
over, since equal windows have equal hashes. Of the others, the suffixes that start at one distance
from the anchor are merge-sorted per anchor hash. Suffixes are compared by prefix polynomial hashes: binary search
over lengths finds their common extension, and the next byte decides. Neighbours in the order with a
common extension of `length` bytes are equal windows, which a comparison of the bytes verifies. An
anchor hash with over `most_in_group` such segments is not gathered. Its windows are taken in
stretches of 16, then 4 distances from the anchor; all windows of a stretch share a core of bytes. A
stretch that occurs twice is repeated throughout, a core that occurs once has no repeats; of what is
left, one of each stretch, the hashes of the windows (2 x 64 bits) are counted.

Defined cases: a null text is an empty text, which keeps its zero bytes; texts shorter than `length`
keep all; repeated rows repeat each other; a null doc_id is an id like others; overlapping
occurrences within a text count; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import buffers, chunks, cut, limit_batches, text_bytes, words64
from ._features import _powers, mix

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


#: Distances from the anchor that one row of a large group stands for, coarse to fine.
STRETCHES = (16, 4)
#: Bytes of text that one step works on: its arrays, 8 times as long, stay in a core's cache.
STEP_BYTES = 1 << 17


def gram_hashes(body: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes (a multiple of 8) from each byte on."""
    word = words64(body).copy()
    n = len(body) - gram + 1
    with np.errstate(over="ignore"):
        h = np.zeros(max(n, 0), np.uint64)
        for j in range(0, gram, 8):
            h += word[j : j + n] * _ODD[(j // 8) % len(_ODD)]
            h = h ^ (h >> np.uint64(31)) if j else h
    return mix(h)


def segments(body: np.ndarray, at: np.ndarray, length: int, gram: int):
    """(document, start, windows, anchor offset, anchor hash) of each segment of a buffer of documents."""
    none = tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    size = np.diff(at)
    if len(body) < length or size.max(initial=0) < length:
        return none
    h = gram_hashes(body, gram)
    span = length - gram + 1  # grams of a window
    # Fixed widths of hash and place, so that the order of grams doesn't depend on what else is in the buffer.
    least = ((h >> np.uint64(32)) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while 2 * width <= span:  # the least of `width` neighbours from each gram on
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    windows = len(body) - length + 1
    least = np.minimum(least[:windows], least[span - width : span - width + windows])
    step = np.zeros(len(body) + 1, np.int8)
    long = np.flatnonzero(size >= length)
    step[at[long]] += 1
    step[at[long + 1] - length + 1] -= 1
    start = np.flatnonzero(np.cumsum(step[:windows], dtype=np.int8))
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))  # texts share no anchor
    count = np.diff(np.append(first, len(start)))
    begin, anchor = start[first], anchor[first]
    return np.searchsorted(at, begin, side="right") - 1, begin, count, anchor - begin, h[anchor]


class Prefixes:
    """Prefix polynomial hashes of a buffer, and comparisons of its suffixes by them."""

    def __init__(self, body: np.ndarray):
        n = len(body)
        self.body = np.append(body, np.uint8(0))
        up, self._down = _powers(1 << max(20, int(n + 1).bit_length()))
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum((body.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])

    def hash(self, x: np.ndarray, length: int) -> np.ndarray:
        """Of the `length` bytes from x on: what `common` compares."""
        with np.errstate(over="ignore"):
            return (self.sums[x + length] - self.sums[x]) * self._down[x]

    def common(self, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
        """Length of the common extension from x and y on, up to `most`: binary search over lengths."""
        low, high = np.zeros(len(x), np.int64), np.full(len(x), most)
        dx, dy, sx, sy = self._down[x], self._down[y], self.sums[x], self.sums[y]
        with np.errstate(over="ignore"):
            while True:
                open_ = low < high
                if not open_.any():
                    return low
                mid = (low + high + 1) >> 1
                same = (self.sums[x + mid] - sx) * dx == (self.sums[y + mid] - sy) * dy
                low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)

    def less(self, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
        """Whether the suffix at x (its first `most` bytes) comes before that at y."""
        c = self.common(x, y, most)
        return (c < most) & (self.body[x + c] < self.body[y + c])


def sort_suffixes(prefixes: Prefixes, start: np.ndarray, group: np.ndarray, most: int) -> np.ndarray:
    """Order of suffixes within groups (which come in a row): bottom-up mergesort of all groups at once.

    The place of a suffix in a merge is its own index plus its rank in the sibling run, found by
    binary search with hash comparisons; equal suffixes stay in the order given.
    """
    n = len(start)
    order = np.arange(n)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if n else np.zeros(0, np.int64)
    size = np.diff(np.append(first, n))
    base = np.repeat(first, size)
    within = np.arange(n) - base
    whole = np.repeat(size, size)
    run = 1
    while run < size.max(initial=1):
        live = np.flatnonzero(whole > run)
        b, w, s = base[live], within[live], whole[live]
        own = w // run
        left = own % 2 == 0
        low = np.minimum((own ^ 1) * run, s)
        high = np.minimum(low + run, s)
        floor = low.copy()
        me = start[order[live]]
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) >> 1
            other = start[order[b[open_] + mid]]
            # left run: members of the right run that are less; right run: members of the left run that aren't greater
            x, y = np.where(left[open_], other, me[open_]), np.where(left[open_], me[open_], other)
            less = prefixes.less(x, y, most)
            before = np.where(left[open_], less, ~less)
            low[open_] = np.where(before, mid + 1, low[open_])
            high[open_] = np.where(before, high[open_], mid)
        to = b + (own & ~1) * run + (w - own * run) + (low - floor)
        fresh = order.copy()
        fresh[to] = order[live]
        order = fresh
        run *= 2
    return order


def repeated_windows(texts: list[bytes], windows: np.ndarray, offset: np.ndarray, group: np.ndarray, length: int) -> list[np.ndarray]:
    """Of each segment, which of its windows equal a window of another segment of its group.

    Windows can only be equal at equal distances from the anchor, which stands at `offset`.
    """
    at = np.cumsum([0, *map(len, texts)])
    body = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(len(texts)), windows)
    j = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = at[:-1][owner] + j
    distance = offset[owner] - j
    cls = group[owner].astype(np.int64) * (length + 1) + distance
    out = np.zeros(len(owner), bool)
    prefixes = Prefixes(body)
    with np.errstate(over="ignore"):
        arranged = _several(mix(prefixes.hash(start, length) + cls.astype(np.uint64) * _ODD[0]))
    arranged = arranged[np.argsort(cls[arranged], kind="stable")]
    c = cls[arranged]
    if len(arranged):
        order = arranged[sort_suffixes(prefixes, start[arranged], c, length)]
        x, y = order[:-1], order[1:]
        near = c[1:] == c[:-1]
        x, y, at_class = x[near], y[near], c[1:][near]
        alike = prefixes.common(start[x], start[y], length) == length
        x, y, at_class = x[alike], y[alike], at_class[alike]
        same = _same_bytes(body, start[x], start[y], length)
        out[x[same]] = out[y[same]] = True
        for wrong in np.unique(at_class[~same]):  # a collision: the bytes decide for the whole class
            seen: dict[bytes, list[int]] = {}
            for k in arranged[c == wrong]:
                seen.setdefault(body[start[k] : start[k] + length].tobytes(), []).append(k)
            for ks in seen.values():
                out[ks] = len(ks) > 1
    return np.split(out, np.cumsum(windows)[:-1])


def _several(key: np.ndarray) -> np.ndarray:
    """Places of the keys that occur more than once, and of few others: those that share a slot of a table."""
    bits = int(len(key)).bit_length() + 3
    slot = (key >> np.uint64(64 - bits)).astype(np.int64)
    last = np.zeros(1 << bits, np.int32)
    place = np.arange(len(key), dtype=np.int32)
    last[slot] = place
    shared = np.zeros(1 << bits, bool)
    shared[slot[last[slot] != place]] = True
    return np.flatnonzero(shared[slot])


def _same_bytes(body: np.ndarray, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    word = words64(body).copy()
    same = np.ones(len(x), bool)
    for j in range(0, length, 8):
        keep = length - j
        mask = np.uint64((1 << (8 * min(8, keep))) - 1)
        same &= (word[x + j] & mask) == (word[y + j] & mask)
    return same


def _spans(flags: np.ndarray, start: int, length: int) -> list[tuple[int, int]]:
    """Byte spans that runs of repeated windows cover."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return [(start + int(a), start + int(b) - 1 + length) for a, b in zip(edge[::2], edge[1::2])]


def repeated_spans(docs: DataFrame, length: int = 200, gram: int = 32, most_in_group: int = 256) -> DataFrame:
    """(k1, k2, spans): by key of a document, byte spans that are covered by repeated strings; they may overlap."""
    if length - gram + 1 > 255:
        raise ValueError("a segment has at most 255 windows")
    limit_batches(docs.sparkSession)
    texts = _keyed(docs)
    # The row number is only used within what is written here, once.
    numbered = texts.withColumn("row", F.monotonically_increasing_id())
    schema = "row long, k1 long, k2 long, anchors array<struct<grams:long,segment:long,place:long>>"

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            parts, counts = [], np.zeros(len(batch), np.int64)
            for first, _, body, at in chunks(batch.column("body"), STEP_BYTES):
                doc, start, count, offset, h = segments(body, at, length, gram)
                raw = body.tobytes()
                ends = start + count + (length - 1)
                own = np.array([digest(raw[a:b], o) for a, b, o in zip(start.tolist(), ends.tolist(), offset.tolist())], np.uint64)
                np.add.at(counts, first + doc, 1)
                parts.append((h.view(np.int64), own.view(np.int64), ((start - at[doc]) << 16) | (count << 8) | offset))
            columns = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3)]
            entries = pa.StructArray.from_arrays([pa.array(c) for c in columns], ["grams", "segment", "place"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), entries)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k1"), batch.column("k2"), lists], ["row", "k1", "k2", "anchors"])

    held = cut(numbered.select("row", "k1", "k2", "body").mapInArrow(gathered, schema), "anchors")
    anchors = held.select("row", F.explode("anchors").alias("x")).select("row", "x.grams", "x.segment", "x.place")
    keys = held.select("row", "k1", "k2")

    shared = anchors.groupBy("grams").agg(F.count("*").alias("n"), F.min("segment").alias("low"), F.max("segment").alias("high")).filter(F.col("n") > 1)
    shared = cut(shared.select("grams", (F.col("low") == F.col("high")).alias("alike")), "shared")
    several = cut(anchors.join(shared, "grams"), "several")

    start, windows = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(255))
    whole = F.struct(start.alias("start"), (start + windows + (length - 1)).alias("end"))
    mixed = several.filter(~F.col("alike"))
    counted = mixed.groupBy("grams", "segment").agg(F.count("*").alias("n"), F.min("row").alias("row"), F.min("place").alias("place"))
    counted = cut(counted, "counted")
    twice = counted.filter(F.col("n") > 1).select("grams", "segment")
    full = several.filter("alike").select("row", whole.alias("span")).unionByName(mixed.join(twice, ["grams", "segment"], "left_semi").select("row", whole.alias("span")))

    # Groups with a segment that occurs once: all their segments, one of each.
    groups = counted.groupBy("grams").agg(F.count("*").alias("members"), F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("single")).filter((F.col("members") > 1) & (F.col("single") > 0))
    border = counted.join(groups.select("grams", "members"), "grams")
    alone = border.filter(F.col("n") == 1).select("grams", "members", "row", "place", F.lit(True).alias("alone"))
    rest = border.filter(F.col("n") > 1).select("grams", "segment", "members")
    rest = mixed.join(rest, ["grams", "segment"]).dropDuplicates(["grams", "segment"]).select("grams", "members", "row", "place", F.lit(False).alias("alone"))
    needed = alone.unionByName(rest).join(keys, "row").groupBy("k1", "k2").agg(F.collect_list(F.struct("grams", "members", "row", "place", "alone")).alias("needed"))

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, at = buffers(batch.column("body"))
            raw = body.tobytes()
            lists = batch.column("needed")
            ends = lists.offsets.to_numpy()
            entries = lists.values
            place = entries.field("place").to_numpy()
            doc = np.repeat(np.arange(len(batch)), np.diff(ends))
            own = slice(int(ends[0]), int(ends[-1]))
            begin = at[doc] + (place[own] >> 16)
            stop = begin + ((place[own] >> 8) & 255) + (length - 1)
            texts = pa.array([raw[a:b] for a, b in zip(begin.tolist(), stop.tolist())], pa.binary())
            fields = [entries.field(x).slice(own.start, own.stop - own.start) for x in ("grams", "members", "row", "place", "alone")]
            yield pa.RecordBatch.from_arrays([*fields, texts], ["grams", "members", "row", "place", "alone", "text"])

    pieces = texts.join(needed, ["k1", "k2"]).select("body", "needed").mapInArrow(slices, "grams long, members long, row long, place long, alone boolean, text binary")
    pieces = cut(pieces, "pieces")

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("members")
            ends, flat = lists.offsets.to_numpy(), lists.values
            row, place = (flat.field(x).to_numpy() for x in ("row", "place"))
            alone = flat.field("alone").to_numpy(zero_copy_only=False)
            body, at = buffers(flat.field("text"))
            raw = body.tobytes()
            out: list[tuple] = []
            i = 0
            while i < len(batch):
                j = max(i + 1, int(np.searchsorted(at[ends], at[ends[i]] + STEP_BYTES, side="right")) - 1)
                own = range(ends[i], ends[j])
                group = np.repeat(np.arange(j - i), np.diff(ends[i : j + 1]))
                within = place[own.start : own.stop]
                flags = repeated_windows([raw[at[k] : at[k + 1]] for k in own], (within >> 8) & 255, within & 255, group, length)
                out += [(row[k], a, b) for k, f in zip(own, flags) if alone[k] and f.any() for a, b in _spans(f, int(place[k] >> 16), length)]
                i = j
            columns = np.array(out, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["row", "start", "end"])

    cold = pieces.filter(F.col("members") <= most_in_group).groupBy("grams").agg(F.collect_list(F.struct("row", "place", "alone", "text")).alias("members"))
    cold = cold.select("members").mapInArrow(solve, "row long, start long, end long").select("row", F.struct("start", "end").alias("span"))

    def stretches(size: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            one, two, three = xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest, xxhash.xxh3_64_intdigest
            for batch in batches:
                rows = batch.to_pydict()
                out: list[list] = [[] for _ in range(9)]
                for g, first, row, start, text in zip(rows["grams"], rows["distance"], rows["row"], rows["start"], rows["text"]):
                    last = first - (len(text) - length)
                    for stretch in range(last // size, first // size + 1):
                        high, low = min(first, stretch * size + size - 1), max(last, stretch * size)
                        part = text[first - high : first - low + length]
                        core = text[first - stretch * size : first - stretch * size - size + 1 + length]
                        for column, x in zip(out, (g, stretch, one(core), two(core), three(part, high), row, start + first - high, high, part)):
                            column.append(x)
                kinds = [pa.int64(), pa.int32(), None, None, None, pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                arrays = [pa.array(x, k) if k else pa.array(np.array(x, np.uint64).view(np.int64)) for k, x in zip(kinds, out)]
                yield pa.RecordBatch.from_arrays(arrays, ["grams", "stretch", "c1", "c2", "own", "row", "start", "distance", "text"])

        return run

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = xxhash.xxh3_64_intdigest, xxhash.xxh64_intdigest
        for batch in batches:
            rows = batch.to_pydict()
            out: list[list] = [[], [], [], [], [], []]
            for g, distance, row, start, text in zip(rows["grams"], rows["distance"], rows["row"], rows["start"], rows["text"]):
                for j in range(len(text) - length + 1):
                    window = text[j : j + length]
                    for column, x in zip(out, (g, distance - j, one(window), two(window), row, start + j)):
                        column.append(x)
            arrays = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in out[2:4]), pa.array(out[4], pa.int64()), pa.array(out[5], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, ["grams", "distance", "h1", "h2", "row", "start"])

    core = ["grams", "stretch", "c1", "c2"]
    open_ = pieces.filter(F.col("members") > most_in_group).select(
        "grams", F.col("place").bitwiseAND(F.lit(255)).cast("int").alias("distance"), F.when(F.col("alone"), F.col("row")).otherwise(-1).alias("row"), F.shiftright("place", 16).alias("start"), "text"
    )
    hot = None
    for size in STRETCHES:
        part = cut(open_.mapInArrow(stretches(size), "grams long, stretch int, c1 long, c2 long, own long, row long, start long, distance int, text binary"), "stretches")
        per = cut(part.groupBy(*core, "own").agg(F.count("*").alias("n"), F.min(F.struct("row", "start", "distance", "text")).alias("x")), "counted")
        twice = per.filter(F.col("n") > 1).select(*core, "own")
        equal = part.filter(F.col("row") >= 0).join(twice, [*core, "own"], "left_semi").select("row", F.struct("start", (F.col("start") + F.octet_length("text")).alias("end")).alias("span"))
        hot = equal if hot is None else hot.unionByName(equal)
        mixed = per.groupBy(*core).agg(F.count("*").alias("members"), F.count(F.when(F.col("n") == 1, 1)).alias("single")).filter((F.col("members") > 1) & (F.col("single") > 0))
        open_ = per.join(mixed.select(*core), core, "left_semi").select("grams", "x.distance", F.when(F.col("n") == 1, F.col("x.row")).otherwise(-1).alias("row"), "x.start", "x.text")
    windows_of = cut(open_.mapInArrow(hashes, "grams long, distance int, h1 long, h2 long, row long, start long"), "windows")
    same = ["grams", "distance", "h1", "h2"]
    often = cut(windows_of.groupBy(*same).agg(F.count("*").alias("n")).filter(F.col("n") > 1).select(*same), "often")
    single = windows_of.join(often, same, "left_semi").filter(F.col("row") >= 0).select("row", F.struct("start", (F.col("start") + length).alias("end")).alias("span"))
    hot = hot.unionByName(single)

    spans = full.unionByName(cold).unionByName(hot)
    # Repeated rows have one key and the same spans, which are listed once.
    return spans.join(keys, "row").groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, body and two hashes that stand for both."""
    body = text_bytes(F.col("text"))
    return docs.select("doc_id", body.alias("body"), F.xxhash64(body).alias("k1"), F.xxhash64(F.lit(1), "doc_id", body).alias("k2"))


def cut_out(body: bytes, spans: np.ndarray) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal removed runs) of a text without the spans."""
    if not len(spans):
        return body, 0, 0
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    fresh = np.flatnonzero(np.concatenate(([True], spans[1:, 0] > reach[:-1])))
    begin, end = spans[fresh, 0], reach[np.append(fresh[1:] - 1, len(spans) - 1)]
    kept = b"".join(body[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), len(body)]))
    return kept, int((end - begin).sum()), len(begin)


def without_repeats(docs: DataFrame, length: int = 200, **more) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes) of every row."""
    spans = repeated_spans(docs, length, **more)

    @F.arrow_udf("struct<n_removed:long,n_spans:long,kept:binary>")
    def remove(body: pa.Array, spans: pa.Array) -> pa.Array:
        data, at = buffers(body)
        raw = data.tobytes()
        ends = spans.offsets.to_numpy()
        both = np.stack([spans.values.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("start", "end")], 1)
        found = [cut_out(raw[at[i] : at[i + 1]], both[ends[i] : ends[i + 1]]) for i in range(len(body))]
        return pa.StructArray.from_arrays([pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64()), pa.array([x[0] for x in found], pa.binary())], ["n_removed", "n_spans", "kept"])

    none = F.array().cast("array<struct<start:long,end:long>>")
    joined = _keyed(docs).join(spans, ["k1", "k2"], "left")
    cleaned = joined.select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), remove("body", F.coalesce("spans", none)).alias("r"))
    return cleaned.select("doc_id", "n_bytes", "r.n_removed", "r.n_spans", "r.kept")
