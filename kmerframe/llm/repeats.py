"""Which windows of `width` tokens occur more than once in a corpus, exactly, with one shuffle of
some token runs in place of one of all windows.

1. Every document becomes runs of windows (textops.anchor_runs). Runs that are equal within an
   Arrow batch become one row with all their places, so a passage that a third of all documents
   hold reaches the shuffle as one row a batch.
2. Rows meet by anchor, sorted. An anchor with one place is unique. In a run two windows are never
   equal (they would have their anchor at one offset), so of an anchor with one kind of run the
   other places repeat the first one whole, and nothing is left to compare.
3. The contents of all other runs are fetched, each from the first of its places, meet by anchor and
   are compared by `matches`, which tells for each window the earliest equal one. An anchor with more
   than HOT kinds of run is not brought together: its windows are spread by their own hash and
   counted with partial aggregation.

The result has a row for each maximal series of repeated windows of a run: document, first window,
number of windows, and where the first window of its kind is (least document, tag, then position).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .common import keyed, release, ship, written

HOT = 2048
FLUSH_BYTES = 1 << 20
PLACE = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("start", "<i4")])
RUNS = "anchor long, run long, windows int, places binary"
FOUND = "kind byte, anchor long, run long, windows int, n long, doc_id long, tag long, start int, fdoc long, ftag long, fstart int, hot boolean"
SEGMENTS = "anchor long, run long, windows int, n long, fdoc long, ftag long, fstart int, hot boolean, body binary"
RANGES = "anchor long, run long, off int, len int, fdoc long, ftag long, fstart int"


def tokens(data: np.ndarray, offsets: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    if unit == "byte":
        return tx.byte_codes(data), offsets
    s, e, o = tx.words_of(data, offsets)
    return tx.word_codes(data, s, e), o


def binary(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow binary array of slices of `values` (offsets in bytes)."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def _runs(unit: str, width: int, gram: int):
    schema = pa.schema([("anchor", pa.int64()), ("run", pa.int64()), ("windows", pa.int32()), ("places", pa.binary())])

    @tx.lean
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags = b["doc_id"].to_numpy(zero_copy_only=False), b["tag"].to_numpy(zero_copy_only=False)
            data, off = tx.column_bytes(b["text"])
            got = []
            for i, j in tx.chunks(off):
                codes, o = tokens(data[off[i] : off[j]], off[i : j + 1] - off[i], unit)
                doc, start, windows, anchor, run = tx.anchor_runs(codes, o, width, gram)
                place = np.empty(len(doc), PLACE)
                place["doc"], place["tag"], place["start"] = ids[i:j][doc], tags[i:j][doc], start - o[:-1][doc]
                got.append((anchor, run, windows, place))
            anchor, run, windows, place = map(np.concatenate, zip(*got, strict=True)) if got else (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64), np.zeros(0, PLACE))
            key = anchor + run * np.uint64(0x9E3779B97F4A7C15)
            order = np.argsort(key, kind="stable")
            anchor, run, windows, place = anchor[order], run[order], windows[order], place[order]
            new = np.ones(len(order), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (run[1:] != run[:-1])
            at = np.flatnonzero(new)
            cut = np.append(at, len(order)) * PLACE.itemsize
            for i in range(0, len(at), 1 << 17):
                j = min(len(at), i + (1 << 17))
                yield _batch(schema, anchor[at[i:j]].view(np.int64), run[at[i:j]].view(np.int64), windows[at[i:j]].astype(np.int32), binary(place.view(np.uint8)[cut[i] : cut[j]], cut[i : j + 1] - cut[i]))

    return go


_FOUND = pa.schema([("kind", pa.int8()), ("anchor", pa.int64()), ("run", pa.int64()), ("windows", pa.int32()), ("n", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()), ("fdoc", pa.int64()), ("ftag", pa.int64()), ("fstart", pa.int32()), ("hot", pa.bool_())])


def _settle(rule: str):
    """Kind 0: a settled run (all its windows repeat); 1: a run that waits; 2: a kind of run to fetch."""

    def groups(t: pa.Table, hot: bool) -> Iterator[pa.RecordBatch]:
        anchor, run, windows = (t[c].to_numpy() for c in ("anchor", "run", "windows"))
        raw, cut = tx.column_bytes(t["places"])
        place, counts = raw.view(PLACE), np.diff(cut) // PLACE.itemsize
        head = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        size = np.diff(np.r_[head, len(anchor)])
        live = np.repeat((np.add.reduceat(counts, head) > 1) | hot, size)
        if not live.any():
            return
        place = place[np.repeat(live, counts)]
        anchor, run, windows, counts = anchor[live], run[live], windows[live], counts[live]
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (run[1:] != run[:-1])]
        kind_of = np.repeat(np.cumsum(new) - 1, counts)  # of each place
        kinds = np.flatnonzero(new)
        n = np.add.reduceat(counts, kinds)
        order = np.lexsort((place["start"], place["tag"], place["doc"], kind_of))
        first = place[order[np.cumsum(n) - n]]
        k_anchor, k_run, k_windows = anchor[kinds], run[kinds], windows[kinds]
        k_head = np.flatnonzero(np.r_[True, k_anchor[1:] != k_anchor[:-1]])
        k_size = np.diff(np.r_[k_head, len(k_anchor)])
        k_open = np.repeat((k_size > 1) | hot, k_size)
        k_hot = np.repeat((k_size > HOT) | hot, k_size)

        def rows(kind: int, k: np.ndarray, at: np.ndarray):
            # What a kind of row has no use for is 0, which takes no room in the table.
            none, place = np.zeros(len(k), np.int64), (at["doc"].copy(), at["tag"].copy(), at["start"].copy())
            source = (first["doc"][k].copy(), first["tag"][k].copy(), first["start"][k].copy())
            source = (none, none, none.astype(np.int32)) if kind == 1 or (kind == 0 and rule != "smaller") else source
            name = (none, none) if kind == 0 else (k_anchor[k], k_run[k])
            size = none if kind == 1 else k_windows[k]
            many = n[k] if kind == 2 else none
            return _batch(_FOUND, np.full(len(k), kind, np.int8), *name, size.astype(np.int32), many, *place, *source, k_hot[k])

        whole = ~k_open | ((n > 1) & (rule == "all"))  # in the rule "all" an open run with two places is settled too
        p = whole[kind_of]
        if rule == "first":
            p = p & (place != first[kind_of])
        elif rule == "smaller":
            p = p & (first["doc"][kind_of] < place["doc"])
        yield rows(0, kind_of[p], place[p])
        p = ~whole[kind_of]
        yield rows(1, kind_of[p], place[p])
        k = np.flatnonzero(k_open)
        yield rows(2, k, first[k])

    @tx.lean
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        rows = 0
        hot = None  # the anchor that is being let through in parts
        for b in batches:
            if not b.num_rows:
                continue
            anchor = b["anchor"].to_numpy()
            cut = int(np.searchsorted(anchor, anchor[-1], "left"))  # the last anchor may go on
            if hot is not None:
                upto = int(np.searchsorted(anchor, hot, "right"))
                if upto:
                    yield from groups(pa.Table.from_batches([b.slice(0, upto)]), True)
                if upto == b.num_rows:
                    continue
                hot, b, cut = None, b.slice(upto), max(cut - upto, 0)
            if cut or (kept and kept[-1]["anchor"][-1].as_py() != b["anchor"][0].as_py()):
                yield from groups(pa.Table.from_batches([*kept, b.slice(0, cut)]), False)
                kept, rows = [], 0
            kept.append(b.slice(cut))
            rows += b.num_rows - cut
            if rows > 4 * HOT:
                hot = kept[-1]["anchor"][-1].as_py()
                yield from groups(pa.Table.from_batches(kept), True)
                kept, rows = [], 0
        if kept:
            yield from groups(pa.Table.from_batches(kept), False)

    return go


_SEGMENTS = pa.schema([("anchor", pa.int64()), ("run", pa.int64()), ("windows", pa.int32()), ("n", pa.int64()), ("fdoc", pa.int64()), ("ftag", pa.int64()), ("fstart", pa.int32()), ("hot", pa.bool_()), ("body", pa.binary())])


WANTED = ("anchor", "run", "windows", "n", "fdoc", "ftag", "fstart", "hot")


def _fetch(unit: str, width: int):
    """Contents of the runs asked for: their bytes, or the 64-bit codes of their words."""

    @tx.lean
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = tx.column_bytes(b["text"])
            wants = b["wants"]
            cut = wants.offsets.to_numpy()
            want = {f: wants.values.field(f) for f in WANTED}
            start, windows = want["fstart"].to_numpy(), want["windows"].to_numpy()
            for i, j in tx.chunks(off):
                part = data[off[i] : off[j]]
                codes, o = (part, off[i : j + 1] - off[i]) if unit == "byte" else tokens(part, off[i : j + 1] - off[i], unit)
                rows = np.arange(cut[i], cut[j])
                at = start[rows] + np.repeat(o[:-1], np.diff(cut[i : j + 1]))
                bodies = [codes[s : s + n + width - 1].tobytes() for s, n in zip(at, windows[rows], strict=True)]
                yield _batch(_SEGMENTS, *(want[f].take(pa.array(rows)) for f in WANTED), pa.array(bodies, pa.binary()))

    return go


_RANGES = pa.schema([("anchor", pa.int64()), ("run", pa.int64()), ("off", pa.int32()), ("len", pa.int32()), ("fdoc", pa.int64()), ("ftag", pa.int64()), ("fstart", pa.int32())])


def _compare(matches: Callable, rule: str):
    """Sorted segments to ranges of repeated windows; whole anchors are compared together."""

    def ranges(t: pa.Table) -> pa.RecordBatch:
        anchor, run = t["anchor"].to_numpy(), t["run"].to_numpy()
        once = np.r_[True, (anchor[1:] != anchor[:-1]) | (run[1:] != run[:-1])]  # rows equal in id and text ask twice
        t = t.filter(pa.array(once))
        anchor, run, windows, n, fdoc, ftag, fstart = (t[c].to_numpy() for c in ("anchor", "run", "windows", "n", "fdoc", "ftag", "fstart"))
        raw, cut = tx.column_bytes(t["body"])
        seg = np.repeat(np.arange(len(windows)), windows)
        off = np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows)
        position = np.empty(len(seg), np.int64)  # of each window in the corpus, as a rank
        position[np.lexsort((fstart[seg] + off, ftag[seg], fdoc[seg]))] = np.arange(len(seg))
        first, many, node = matches(raw, cut, windows, n, position)
        many = many | (n[seg] > 1)
        f_doc, f_tag, f_start = fdoc[seg[first]], ftag[seg[first]], fstart[seg[first]] + off[first]
        if rule == "all":
            f_doc, f_tag, f_start = np.zeros(len(seg), np.int64), np.zeros(len(seg), np.int64), off  # which copy is first doesn't matter
        new = np.r_[True, (seg[1:] != seg[:-1]) | (f_doc[1:] != f_doc[:-1]) | (f_tag[1:] != f_tag[:-1]) | (f_start[1:] != f_start[:-1] + 1) | (many[1:] != many[:-1]) | node[1:]]
        at = np.flatnonzero(new)
        length = np.diff(np.r_[at, len(seg)])
        at, length = at[many[at]], length[many[at]]
        s = seg[at]
        return _batch(_RANGES, anchor[s], run[s], off[at].astype(np.int32), length.astype(np.int32), f_doc[at], f_tag[at], f_start[at].astype(np.int32))

    @tx.lean
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        held = 0
        for b in batches:
            if not b.num_rows:
                continue
            # Split so that no flush waits for a large batch to end.
            anchor = b["anchor"].to_numpy()
            head = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            ends = np.r_[head[1:], b.num_rows]
            size = pc.binary_length(b["body"]).to_numpy()
            total = np.r_[0, np.cumsum(size)]
            if kept and kept[-1]["anchor"][-1].as_py() != anchor[0] and held > FLUSH_BYTES:
                yield ranges(pa.Table.from_batches(kept))
                kept, held = [], 0
            i = 0
            for e in ends[:-1]:  # the last anchor may go on
                if held + total[e] - total[i] > FLUSH_BYTES:
                    yield ranges(pa.Table.from_batches([*kept, b.slice(i, e - i)]))
                    kept, held, i = [], 0, int(e)
            kept.append(b.slice(i))
            held += int(total[-1] - total[i])
        if kept:
            yield ranges(pa.Table.from_batches(kept))

    return go


SPREAD = "anchor long, run long, off int, win long, n long, fdoc long, ftag long, fstart int"


def _spread(unit: str, width: int):
    schema = pa.schema([("anchor", pa.int64()), ("run", pa.int64()), ("off", pa.int32()), ("win", pa.int64()), ("n", pa.int64()), ("fdoc", pa.int64()), ("ftag", pa.int64()), ("fstart", pa.int32())])

    @tx.lean
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, cut = tx.column_bytes(b["body"])
            windows = b["windows"].to_numpy()
            seg = np.repeat(np.arange(len(windows)), windows)
            off = np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows)
            codes, cut = (tx.byte_codes(raw), cut) if unit == "byte" else (raw.view(np.uint64), cut // 8)
            win = tx.Rolling(codes).all(width)[cut[:-1][seg] + off]
            anchor, run, n, fdoc, ftag, fstart = (b[c].to_numpy()[seg] for c in ("anchor", "run", "n", "fdoc", "ftag", "fstart"))
            yield _batch(schema, anchor, run, off.astype(np.int32), win.view(np.int64), n, fdoc, ftag, (fstart + off).astype(np.int32))

    return go


def _series(rule: str):
    """Ranges of one window each, in order of anchor, run and offset, to ranges of series, but for the bounds of batches."""

    @tx.lean
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            anchor, run, off, fdoc, ftag, fstart = (b[c].to_numpy() for c in ("anchor", "run", "off", "fdoc", "ftag", "fstart"))
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (run[1:] != run[:-1]) | (off[1:] != off[:-1] + 1)]
            if rule != "all":  # which copy is first matters
                new[1:] |= (fdoc[1:] != fdoc[:-1]) | (ftag[1:] != ftag[:-1]) | (fstart[1:] != fstart[:-1] + 1)
            at = np.flatnonzero(new)
            yield _batch(_RANGES, anchor[at], run[at], off[at], np.diff(np.r_[at, b.num_rows]).astype(np.int32), fdoc[at], ftag[at], fstart[at])

    return go


def repeated(docs: DataFrame, *, unit: str, width: int, gram: int, matches: Callable, rule: str) -> DataFrame:
    """(doc_id, tag, start, len, fdoc, ftag, fstart): series of windows of `keyed(docs)` that the rule removes,
    and where (but under "all") an earlier copy of each starts.

    rule: "all" takes every window whose contents also start elsewhere; "first" all but the first
    by document and position; "smaller" those that also start in a document with a smaller id.
    matches(raw, cut, windows, n, position) gets runs' contents end to end and tells of each window
    the earliest equal one, whether there is another, and whether a path ends before it.
    """
    spark = docs.sparkSession
    ship(spark)
    d = keyed(docs)
    runs = d.mapInArrow(_runs(unit, width, gram), RUNS)
    found = written(runs.repartition("anchor").sortWithinPartitions("anchor", "run").mapInArrow(_settle(rule), FOUND), "runs")
    release(spark)
    spans = ("doc_id", "tag", "start", "len", "fdoc", "ftag", "fstart")
    settled = found.where("kind = 0").withColumnRenamed("windows", "len").select(*spans)
    # A hot anchor is let through in parts, so that one kind of run may come in several rows.
    first = F.min(F.struct("fdoc", "ftag", "fstart"))
    kinds = found.where("kind = 2").groupBy("anchor", "run").agg(F.min("windows").alias("windows"), F.sum("n").alias("n"), first.alias("f"), F.max("hot").alias("hot")).select("anchor", "run", "windows", "n", "f.*", "hot")
    wants = kinds.groupBy(F.col("fdoc").alias("doc_id"), F.col("ftag").alias("tag")).agg(F.collect_list(F.struct(*WANTED)).alias("wants"))
    segments = written(d.join(wants, ["doc_id", "tag"]).select("text", "wants").mapInArrow(_fetch(unit, width), SEGMENTS), "segments")
    release(spark)
    open_ranges = segments.where("not hot").repartition("anchor").sortWithinPartitions("anchor", "run").mapInArrow(_compare(matches, rule), RANGES)
    hot = segments.where("hot").dropDuplicates(["anchor", "run"])
    if hot.limit(1).count():
        spread = hot.mapInArrow(_spread(unit, width), SPREAD)
        least = spread.groupBy("anchor", "win").agg(F.sum("n").alias("n"), first.alias("f")).where("n > 1").select("anchor", "win", "f.*")
        met = spread.select("anchor", "run", "off", "win").join(least, ["anchor", "win"]).select("anchor", "run", "off", "fdoc", "ftag", "fstart")
        series = met.repartition("anchor", "run").sortWithinPartitions("anchor", "run", "off").mapInArrow(_series(rule), RANGES)
        open_ranges = open_ranges.unionByName(series)  # a row a series, not a window, meets the places below
    waiting = found.where("kind = 1").select("anchor", "run", "doc_id", "tag", "start")
    met = waiting.join(open_ranges, ["anchor", "run"]).withColumn("start", F.col("start") + F.col("off"))
    if rule == "first":
        met = met.where("fdoc <> doc_id or ftag <> tag or fstart <> start")
    elif rule == "smaller":
        met = met.where("fdoc < doc_id")
    return settled.union(met.select(*spans))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """keyed(docs) with `spans`: array of (start, len), null where there is none. An array holds no
    more than a document's own runs and windows."""
    by = spans.groupBy("doc_id", "tag").agg(F.collect_list(F.struct(*(c for c in spans.columns if c not in ("doc_id", "tag")))).alias("spans"))
    return keyed(docs).join(by, ["doc_id", "tag"], "left")


def covered(offsets: np.ndarray, spans: pa.Array, i: int, j: int, width: int) -> np.ndarray:
    """For documents i..j of a batch, of whose tokens `offsets` tells the bounds: a mask of tokens under
    any window of the spans."""
    n = int(offsets[-1])
    edge = np.zeros(n + 1, np.int32)
    counts = np.nan_to_num(pc.list_value_length(spans.slice(i, j - i)).to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)
    if counts.sum():
        flat = spans.slice(i, j - i).flatten()
        s = flat.field("start").to_numpy() + np.repeat(offsets[:-1], counts)
        np.add.at(edge, s, 1)
        np.add.at(edge, s + flat.field("len").to_numpy() + width - 1, -1)
    return np.cumsum(edge[:-1]) > 0
