"""Removal of bytes that repeat earlier text, by suffix sorting around content-defined anchors.

Each byte covered by a string of `length` bytes that also starts earlier (in a document of smaller id,
or earlier in the same one) goes. Of the 32-byte strings in a window of `length` bytes, the one with
the smallest hash is the window's anchor; equal windows have equal anchors at equal places, so windows
need comparing only if they share an anchor.

1. Each task hashes its texts, picks anchors and sends, for an anchor, its hash and that of the bytes
   around it, as far as windows reach; of anchors alike in both only the first goes on, the others'
   windows all repeat.
2. By anchor: those alike in both hashes but the first are repeats. Where surroundings differ, their
   bytes are wanted.
3. The wanted bytes are cut from the texts and sorted as suffixes to the right and prefixes to the
   left of the anchor: multikey quicksort over 8-byte characters to a shallow depth, then a blind trie
   for each group that is still alike. Neighbours' common lengths say which windows are equal, and the
   earliest of those stays.
4. Spans are joined per document and cut out.

An anchor with very many different surroundings (a line in every document) is not gathered in one
task: its windows are spread by their own hashes, of which each task sends the first only.

Odd rows: null texts count as empty; documents under `length` bytes keep everything; equal rows are one
document, rows of one doc_id with different texts are documents of their own (in the order of the
texts' hashes); a null doc_id takes no part and keeps everything; very long texts are gone through
whole; an empty table gives an empty result. Columns other than doc_id and text are not read;
without_repeats passes them on, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import batch, materialise, partitions, prepare, slices

#: Bytes of an anchor; a power of two.
ANCHOR = 32
#: An anchor with more surroundings than this in one task, or than MANY in all, has its windows spread.
CROWD, MANY = 64, 2000
#: Depth, in bytes, of the shallow sort.
SHALLOW = 32
#: Stands around texts; no byte of UTF-8.
EDGE = 0xFF
_RANDOM = np.random.default_rng(1_948)
_BYTE = _RANDOM.integers(1, 2**64, (2, 256), np.uint64)
_STEP = _RANDOM.integers(1, 2**64, (2, 16), np.uint64) | np.uint64(1)
_LOW = np.uint64(2**31 - 1)


def _doubled(h: np.ndarray, span: int, level: int, seed: int = 0) -> np.ndarray:
    """Hashes of stretches twice as long, from those of span bytes (in place, as far as they reach)."""
    n = h.shape[-1] - span
    out = h[..., :n] * _STEP[seed, level]
    out ^= out >> np.uint64(29)
    out += h[..., span:]
    out *= _STEP[seed, level + 8]
    out ^= out >> np.uint64(32)
    return out


def _hashes(data: np.ndarray, span: int, seed: int = 0) -> np.ndarray:
    """Hash of the span (a power of two) bytes from each place on."""
    h, level, at = _BYTE[seed][data], 0, 1
    while at < span:
        h = _doubled(h, at, level, seed)
        at, level = 2 * at, level + 1
    return h


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    out, at = x, 1
    while 2 * at <= width:
        out, at = np.minimum(out[:-at], out[at:]), 2 * at
    return np.minimum(out[: len(out) - (width - at)], out[width - at :]) if width > at else out


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: which text, place in it, hash of the anchor, hash of all that windows around it can hold."""
    side = length - ANCHOR
    edge = bytes([EDGE]) * length
    data = np.frombuffer(edge + edge.join(texts) + edge, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = length + np.concatenate([[0], np.cumsum(sizes + length)[:-1]]) if len(texts) else np.zeros(0, np.int64)
    h = _hashes(data, ANCHOR)
    order = h * np.uint64(0x9E3779B97F4A7C15)
    order ^= order >> np.uint64(32)
    order *= np.uint64(0xD6E8FEB86659FD93)
    order &= ~_LOW
    order |= np.arange(len(order), dtype=np.uint64)
    least = _sliding_least(order, side + 1)
    whole = np.zeros(len(least) + 1, np.int8)
    long = sizes >= length
    np.add.at(whole, begins[long], 1)
    np.add.at(whole, begins[long] + sizes[long] - length + 1, -1)
    at = np.unique((least[np.cumsum(whole[:-1]).astype(bool)] & _LOW).astype(np.int64))
    which = np.searchsorted(begins, at, "right") - 1
    wide, reach = h, ANCHOR
    level = ANCHOR.bit_length() - 1
    while 2 * reach <= side + length:
        wide = _doubled(wide, reach, level)
        reach, level = 2 * reach, level + 1
    around = np.zeros(len(at), np.uint64)
    for place in (*range(-side, length - reach, reach), length - reach):
        around = around * _STEP[1, 0] + wide[at + place]
        around ^= around >> np.uint64(31)
    return which, at - begins[which], h[at], around


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _sizes(new: np.ndarray) -> np.ndarray:
    """For each row, the size of its group."""
    at = np.flatnonzero(new)
    return np.repeat(np.diff(np.append(at, len(new))), np.diff(np.append(at, len(new))))


def merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of spans that overlap or touch, by document."""
    if not len(doc):
        return doc, start, end
    start = np.maximum(start, 0)
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order].astype(np.int64), end[order].astype(np.int64)
    group = np.cumsum(_starts(doc)) - 1
    shift = group * (int(end.max()) + 2)
    far = np.maximum.accumulate(end + shift)
    new = np.ones(len(doc), bool)
    new[1:] = (start + shift)[1:] > far[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], start[first], (far - shift)[last]


def blind_trie(rows: list[bytes]) -> tuple[list[int], list[int]]:
    """Order of rows of equal length, and each one's common length with the one before.

    Inner nodes know only the depth at which their rows part and the byte there. A new row goes down
    blindly to some leaf; one comparison with that leaf finds where the row really parts.
    """
    size = len(rows[0])
    numbers = [int.from_bytes(r, "big") for r in rows]
    root: list | int = 0
    same: dict[int, list[int]] = {0: [0]}
    for k in range(1, len(rows)):
        row, node = rows[k], root
        while not isinstance(node, int):
            branches = node[1]
            found = branches.get(row[node[0]])
            node = found if found is not None else next(iter(branches.values()))
        common = size - -(-(numbers[k] ^ numbers[node]).bit_length() // 8)
        if common == size:
            same[node].append(k)
            continue
        same[k] = [k]
        above, node = None, root
        while not isinstance(node, int) and node[0] < common:
            above, node = node, node[1][row[node[0]]]
        if not isinstance(node, int) and node[0] == common:
            node[1][row[common]] = k
        else:
            leaf = node
            while not isinstance(leaf, int):
                leaf = next(iter(leaf[1].values()))
            new = [common, {rows[leaf][common]: node, row[common]: k}]
            if above is None:
                root = new
            else:
                above[1][row[above[0]]] = new
    order, lengths, stack = [], [], [(root, 0)]
    while stack:
        node, common = stack.pop()
        if isinstance(node, int):
            order += same[node]
            lengths += [common, *[size] * (len(same[node]) - 1)]
        else:
            branches = sorted(node[1].items(), reverse=True)
            stack += [(child, node[0]) for _, child in branches[:-1]]
            stack.append((branches[-1][1], common))
    return order, lengths


def deep_shallow(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a byte matrix, and common lengths of neighbours in that order (0 for the first).

    Multikey quicksort takes 8 bytes as one character and only rows that are still alike further, down
    to SHALLOW bytes; blind tries order the groups that are left.
    """
    n, size = rows.shape
    order, common = np.arange(n), np.zeros(n, np.int64)
    group = np.zeros(n, np.int64)
    open_ = np.arange(n)  # places in order whose rows are still alike with a neighbour
    for depth in range(0, min(SHALLOW, size) - 7, 8):
        if not len(open_):
            break
        words = np.ascontiguousarray(rows[order[open_], depth : depth + 8]).view(">u8").ravel().astype(np.uint64)
        by = np.lexsort((words, group[open_]))
        order[open_], words = order[open_][by], words[by]
        new = _starts(group[open_], words)
        inner = np.flatnonzero(new & ~_starts(group[open_]))
        exact = np.ascontiguousarray(rows[order[open_[inner]], depth : depth + 8]) != np.ascontiguousarray(rows[order[open_[inner - 1]], depth : depth + 8])
        common[open_[inner]] = depth + exact.argmax(1) if len(inner) else 0
        group[open_] = np.cumsum(new) + (group[open_].max() + 1 if len(open_) else 0)
        alone = _sizes(new) == 1
        open_ = open_[~alone]
    if len(open_):
        firsts = np.append(np.flatnonzero(_starts(group[open_])), len(open_))
        for a, b in zip(firsts[:-1], firsts[1:], strict=True):
            own = open_[a:b]
            took, lengths = blind_trie([rows[k].tobytes() for k in order[own]])
            order[own] = order[own][took]
            common[own[1:]] = lengths[1:]
    return order, common


def repeated_windows(around: np.ndarray, key: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """Which windows repeat an earlier row's, for rows in order of their place in the corpus.

    Rows of one place are a row of the table and its repeats: a window repeats none that starts in its own place.
    around: a row has the bytes from length - ANCHOR before its anchor to length after its start, EDGE
    outside its text. The result has, for each row, the windows by how far they start before the anchor.
    """
    m, side = len(around), length - ANCHOR
    out = np.zeros((m, side + 1), bool)
    if m < 2:
        return out
    named = np.ascontiguousarray(key.astype(">u8")).view(np.uint8).reshape(m, 8)
    classes = []
    for rows in (np.concatenate([named, around[:, side:]], 1), np.concatenate([named, around[:, :side][:, ::-1]], 1)):
        order, common = deep_shallow(np.ascontiguousarray(rows))
        rank = np.empty(m, np.int64)
        rank[order] = np.arange(m)
        classes.append((common, rank))
    (right, right_rank), (left, left_rank) = classes
    inside = around != EDGE
    for before in range(side + 1):
        by_right = np.cumsum(right < 8 + length - before)[right_rank]
        by_left = np.cumsum(left < 8 + before)[left_rank]
        pair = by_right * (m + 1) + by_left
        _, first, which = np.unique(pair, return_index=True, return_inverse=True)
        out[:, before] = (place != place[first[which]]) & inside[:, side - before] & inside[:, side - before + length - 1]
    return out


def _window_rows(around: np.ndarray, doc: np.ndarray, pos: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Two hashes of each whole window of each row, with its document and start."""
    m, side = len(around), length - ANCHOR
    half = 1 << (length.bit_length() - 1)
    both = []
    for seed in (0, 1):
        h = _BYTE[seed][around]
        at, level = 1, 0
        while at < half:
            h = _doubled(h, at, level, seed)
            at, level = 2 * at, level + 1
        both.append(h[:, : side + 1] * _STEP[seed, 15] + h[:, length - half : length - half + side + 1])
    inside = (around[:, : side + 1] != EDGE) & (around[:, length - 1 : length + side] != EDGE)
    starts = pos[:, None] - side + np.arange(side + 1)
    return both[0][inside], both[1][inside], np.broadcast_to(doc[:, None], (m, side + 1))[inside], starts[inside]


_ANCHOR_ROW = np.dtype([("key", "<u8"), ("around", "<u8"), ("doc", "<i8"), ("pos", "<i4"), ("crowd", "u1")])
_WINDOW_ROW = np.dtype([("key", "<u8"), ("around", "<u8"), ("doc", "<i8"), ("pos", "<i4")])
_SPANS = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("key", pa.int64())])
_SENT = pa.schema([("part", pa.int32()), ("kind", pa.string()), ("data", pa.binary())])


def _sent(kind: str, rows: np.ndarray, parts: int) -> pa.RecordBatch:
    part = (rows["key"] % np.uint64(parts)).astype(np.int32) if kind != "crowd" else ((rows["key"] ^ rows["around"]) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    rows, part = rows[order], part[order]
    at = np.flatnonzero(_starts(part))
    data = [rows[a:b].tobytes() for a, b in zip(at, np.append(at[1:], len(rows)), strict=False)]
    return batch(_SENT, part=part[at], kind=[kind] * len(at), data=data)


def _spans_sent(doc: np.ndarray, start: np.ndarray, end: np.ndarray, parts: int) -> pa.RecordBatch:
    rows = np.zeros(len(doc), [("doc", "<i8"), ("start", "<i4"), ("end", "<i4")])
    rows["doc"], rows["start"], rows["end"] = doc, start, end
    pieces = np.array_split(rows, max(1, len(rows) // 50_000))
    return batch(_SENT, part=[(int(p["doc"][0]) if len(p) else 0) % parts for p in pieces], kind=["spans"] * len(pieces), data=[p.tobytes() for p in pieces])


def _spans(doc: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
    return batch(_SPANS, doc_id=doc.astype(np.int64), start=start.astype(np.int32), end=end.astype(np.int32), key=np.zeros(len(doc), np.int64) if key is None else key.view(np.int64))


def _first_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key, surroundings and place; and which are the first of their surroundings."""
    rows = rows[np.lexsort((rows["pos"], rows["doc"], rows["around"], rows["key"]))]
    return rows, _starts(rows["key"], rows["around"])


def _earlier(rows: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Rows that an earlier row equals: not the first, nor in the first's very place (a repeated row of the table)."""
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return ~new & ((rows["doc"] != rows["doc"][first]) | (rows["pos"] != rows["pos"][first]))


def _find(docs: DataFrame, length: int, parts: int) -> DataFrame:
    side = length - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = []
        for rows in batches:
            keys, texts = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            for a, b in slices(texts):
                which, pos, key, around = anchors([(t or "").encode() for t in texts[a:b]], length)
                own = np.zeros(len(pos), _ANCHOR_ROW)
                own["key"], own["around"], own["doc"], own["pos"] = key, around, np.array(keys[a:b], np.int64)[which], pos
                kept.append(own)
        if not kept:
            return
        rows, new = _first_of(np.concatenate(kept))
        del kept
        again = _earlier(rows, new)
        yield _spans_sent(*merged(rows["doc"][again], rows["pos"][again].astype(np.int64) - side, rows["pos"][again].astype(np.int64) + length), parts)
        rows = rows[new]
        first = _starts(rows["key"])
        many = _sizes(first) > CROWD
        if many.any():
            notice = rows[many & first]
            notice["crowd"] = 1
            yield _sent("crowd", rows[many], parts)
            rows = np.concatenate([rows[~many], notice])
        yield _sent("anchors", rows, parts)

    return docs.mapInArrow(run, "part int, kind string, data binary").repartition(parts, "part")


def _received(batches: Iterator[pa.RecordBatch], kinds: dict[str, np.dtype]) -> tuple[dict[str, np.ndarray], list[pa.RecordBatch]]:
    """A partition's rows by kind; spans as rows of the output."""
    got: dict[str, list[bytes]] = {k: [] for k in kinds}
    spans = []
    for rows in batches:
        for kind, data in zip(rows.column("kind").to_pylist(), rows.column("data").to_pylist(), strict=True):
            if kind == "spans":
                own = np.frombuffer(data, [("doc", "<i8"), ("start", "<i4"), ("end", "<i4")])
                spans.append(_spans(own["doc"], own["start"], own["end"]))
            else:
                got[kind].append(data)
    return {k: np.frombuffer(b"".join(v), kinds[k]) for k, v in got.items()}, spans


def _compare(sent: DataFrame, length: int) -> DataFrame:
    """Spans, and wanted surroundings: rows whose end is 0 (1 if their windows are to be spread) and start the anchor's place."""
    side = length - ANCHOR

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, spans = _received(batches, {"anchors": _ANCHOR_ROW, "crowd": _ANCHOR_ROW})
        yield from spans
        rows = got["anchors"]
        order = np.argsort(rows["key"])
        rows = rows[order[_sizes(_starts(rows["key"][order])) > 1]] if len(rows) else rows
        for kind, own in (("anchors", rows), ("crowd", got["crowd"])):
            if not len(own):
                continue
            notice = own["crowd"] == 1
            crowded = np.unique(own["key"][notice])
            own, new = _first_of(own[~notice])
            again = _earlier(own, new)
            yield _spans(*merged(own["doc"][again], own["pos"][again].astype(np.int64) - side, own["pos"][again].astype(np.int64) + length))
            own = own[new]
            if kind == "anchors":
                n = _sizes(_starts(own["key"]))
                spread = np.isin(own["key"], crowded) | (n > MANY)
                own, spread = own[(n > 1) | spread], spread[(n > 1) | spread]
            else:
                spread = np.ones(len(own), bool)
            yield _spans(own["doc"], own["pos"], spread.astype(np.int32) - 1, own["key"].copy())

    return sent.mapInArrow(run, "doc_id long, start int, end int, key long")


def _cut_out(texts: DataFrame, wanted: DataFrame, length: int, parts: int) -> DataFrame:
    side = length - ANCHOR
    context = np.dtype([("key", "<u8"), ("doc", "<i8"), ("pos", "<i4"), ("bytes", "u1", (side + length,))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = []
        for rows in batches:
            out = []
            for doc, text, want in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2), strict=True):
                data = np.frombuffer(bytes([EDGE]) * side + (text or "").encode() + bytes([EDGE]) * length, np.uint8)
                places, ends, keys = (np.asarray(want.values.field(n)) for n in ("start", "end", "key"))
                fits = places + side + length <= len(data)
                places, ends, keys = places[fits], ends[fits], keys[fits]
                own = np.zeros(len(places), context)
                own["key"], own["doc"], own["pos"] = keys.view(np.uint64), doc, places
                own["bytes"] = np.lib.stride_tricks.sliding_window_view(data, side + length)[places]
                out.append(own[ends == -1])
                if (ends == 0).any():
                    own = own[ends == 0]
                    windows = np.zeros(own.size * (side + 1), _WINDOW_ROW)
                    found = _window_rows(own["bytes"], own["doc"], own["pos"].astype(np.int64), length)
                    windows = windows[: len(found[0])]
                    for name, x in zip(_WINDOW_ROW.names, found, strict=True):
                        windows[name] = x
                    spread.append(windows)
            if out:
                yield _sent("contexts", np.concatenate(out), parts)
        if spread:
            rows, new = _first_of(np.concatenate(spread))
            again = _earlier(rows, new)
            yield _spans_sent(*merged(rows["doc"][again], rows["pos"][again].astype(np.int64), rows["pos"][again].astype(np.int64) + length), parts)
            yield _sent("windows", rows[new], parts)

    both = texts.join(wanted.hint("shuffle_hash"), "doc_id")
    sent = both.select("doc_id", "text", "wanted").mapInArrow(run, "part int, kind string, data binary").repartition(parts, "part")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, spans = _received(batches, {"contexts": context, "windows": _WINDOW_ROW})
        yield from spans
        rows = got["contexts"]
        if len(rows):
            rows = rows[np.lexsort((rows["pos"], rows["doc"]))]
            place = np.cumsum(_starts(rows["doc"], rows["pos"]))
            found = repeated_windows(np.ascontiguousarray(rows["bytes"]), rows["key"], place, length)
            hit = found.any(1)
            nearest = found[hit].argmax(1)
            farthest = side - found[hit][:, ::-1].argmax(1)
            pos = rows["pos"][hit].astype(np.int64)
            yield _spans(*merged(rows["doc"][hit], pos - farthest, pos - nearest + length))
        if len(got["windows"]):
            rows, new = _first_of(got["windows"])
            again = _earlier(rows, new)
            yield _spans(*merged(rows["doc"][again], rows["pos"][again].astype(np.int64), rows["pos"][again].astype(np.int64) + length))

    return sent.mapInArrow(sort, "doc_id long, start int, end int, key long")


def _numbered(texts: DataFrame) -> DataFrame:
    """texts, with doc_id renumbered in order where rows of one doc_id have different texts."""
    texts = texts.withColumn("hash", F.xxhash64("text"))
    if texts.groupBy("doc_id").agg(F.min("hash").alias("low"), F.max("hash").alias("high")).filter("low != high").isEmpty():
        return texts.drop("hash")
    named = texts.select("doc_id", "hash").dropna().distinct()
    order = named.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash")
    numbers = materialise(order.withColumn("number", F.monotonically_increasing_id()))  # partitions are in order, rows are in them
    return texts.join(numbers, ["doc_id", "hash"], "left").drop("doc_id", "hash").withColumnRenamed("number", "doc_id")


def _joined(docs: DataFrame, length: int) -> tuple[DataFrame, list[str]]:
    """All rows and columns of docs, with spans (array of start, end, or null): what to cut from the text's bytes.

    Names are the operator's own (the second result has those of docs' columns in order), so that none clash.
    """
    spark = docs.sparkSession
    prepare(spark)
    own = ["text" if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)]
    texts = docs.select(*[F.col(f"`{c}`").alias(n) if n != "text" else F.col("text").cast("string") for c, n in zip(docs.columns, own, strict=True)], F.col("doc_id").cast("long").alias("doc_id"))
    parts = partitions(spark, texts.select("doc_id", "text"), 8)
    texts = _numbered(texts)
    found = materialise(_compare(_find(texts.filter("doc_id is not null and text is not null").select("doc_id", "text"), length, parts), length))
    spread_out = texts.repartition(parts, "doc_id")  # twice in one plan: shuffled once
    wanted = found.filter("end <= 0").groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", "key")).alias("wanted"))
    spans = found.filter("end > 0").unionByName(_cut_out(spread_out, wanted, length, parts))
    spans = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return spread_out.join(spans.hint("shuffle_hash"), "doc_id", "left"), own


def _kept(data: bytes, own: pa.Scalar) -> tuple[bytes, int]:
    """What the spans leave, and how many runs of bytes they are."""
    if not own.is_valid or not data:
        return data, 0
    start, end = (np.asarray(own.values.field(k)).astype(np.int64) for k in ("start", "end"))
    start, end = np.maximum(start, 0), np.minimum(end, len(data))
    inside = end > start
    _, start, end = merged(np.zeros(int(inside.sum()), np.int64), start[inside], end[inside])
    edges = [0, *(x for pair in zip(start.tolist(), end.tolist(), strict=True) for x in pair), len(data)]
    return b"".join([data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]), len(start)


def dedup(docs: DataFrame, length: int = 100, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with_text adds the kept bytes as kept (binary)."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if with_text:
        fields.append(("kept", pa.binary()))
        ddl += ", kept binary"
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: dict[str, list] = {n: [] for n in schema.names}
            for doc, text, own in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2), strict=True):
                data = (text or "").encode()
                kept, n = _kept(data, own)
                for name, x in zip(schema.names, (doc, len(data), len(data) - len(kept), n, hashlib.sha256(kept).hexdigest(), kept), strict=False):
                    out[name].append(x)
            yield batch(schema, **out)

    rows, own = _joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), length)
    return rows.select(*own, "spans").mapInArrow(cut, ddl)


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """The rows of docs with what is left of their texts; columns and their order stay, n_chars follows the text.

    Bytes of a character that a cut leaves in part are dropped. A row of whose text nothing is left
    goes, unless it was empty before.
    """
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts, stays = [], []
            for text, own in zip(rows.column(at).to_pylist(), rows.column(len(names)), strict=True):
                left = None if text is None else _kept(text.encode(), own)[0].decode("utf-8", "ignore")
                texts.append(left)
                stays.append(bool(left) or not text)
            columns = [*rows.columns[:-1]]
            columns[at] = pa.array(texts, columns[at].type)
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([old if t is None else len(t) for t, old in zip(texts, columns[k].to_pylist(), strict=True)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(stays, pa.bool_()))

    rows, own = _joined(docs, length)
    return rows.select(*own, "spans").mapInArrow(run, docs.schema)
