"""Windows that occur more than once in a corpus, found without moving all windows or texts.

A run is a maximal stretch of window starts of a text that share an anchor (see windows.py); on
average one run stands for 10 windows of 35 words or 31 windows of 100 bytes. A run's context
is the text of all its windows. A window's anchor and offset depend on its content, so:

1. Runs whose anchor occurs once have no repeated window and go.
2. Equal contexts are counted, aggregated before the shuffle: all windows of a context that
   occurs twice occur twice.
3. Only where an anchor has several contexts, the windows of one occurrence of each context are
   compared by hash, or parsed into factors. Copies add nothing to that, whatever the size of
   their group. An anchor's contexts meet in one task, or if they are over CROWD, their windows
   are counted one by one.
4. The outcome goes back to every occurrence by a join on (anchor, context), whose hot keys
   Spark splits, and to its text by document.

Identities are 128 bits: the anchor's 64-bit hash and one by an independent base. Every step is
written to the shared folder, so shuffle files of one step only exist at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .windows import BASES, Ranges, Texts, anchors, batches_of, byte_values, mix

#: Bits of a mask; two masks hold the windows of a run.
_MASK = 63
#: Contexts of an anchor that are compared in one task at most, and rows of a task's step, about.
CROWD, _CHUNK = 5000, 20_000
#: Pairs of contexts of one step of a parse.
_PAIRS = 50_000


class Sequences:
    """The units, words or bytes, of a batch of texts, and the unit range of each text."""

    def __init__(self, texts: list[bytes], unit: str) -> None:
        self.texts = Texts(texts)
        if unit == "word":
            values, _, _, at = self.texts.words()
            self.first, self.last = at[:-1], at[1:]
        else:
            values, self.first, self.last = byte_values()[self.texts.bytes], self.texts.start, self.texts.stop
        self.one, self.two = Ranges(values), Ranges(values, BASES[1])


def with_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, text): rows of an equal key are equal, also where doc_id repeats or is null."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _context(seq: Sequences, begin: np.ndarray, end: np.ndarray, before: np.ndarray, n: np.ndarray) -> np.ndarray:
    """What tells the units begin..end, with `n` windows and the anchor `before` units in, from others."""
    shape = before.astype(np.uint64) << np.uint64(32) | n.astype(np.uint64)
    return mix(seq.two.of(begin, end) ^ mix(shape)).view(np.int64)


def runs_of(keyed: DataFrame, unit: str, window: int, fragment: int) -> DataFrame:
    """(anchor, context, doc_id, text_hash, at, before, n): each run of each text.

    at: the anchor's unit in its text; before: units from the first window to it; n: windows.
    """
    assert window - fragment + 1 <= 2 * _MASK

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in batches_of(batch.column(2)):
                seq = Sequences(texts, unit)
                start, anchor = anchors(seq.one, seq.first, seq.last, window, fragment)
                if not len(start):
                    continue
                new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]))
                begin, end, at = start[new], start[np.concatenate([new[1:] - 1, [len(start) - 1]])], anchor[new]
                before, n = at - begin, end - begin + 1
                context = _context(seq, begin, end + window, before, n)
                text = np.searchsorted(seq.first, at, "right") - 1
                # texts without units share their begin with the next one: the last of these has the unit
                ids = [batch.column(i).slice(row, len(texts)).take(pa.array(text)) for i in (0, 1)]
                cols = [pa.array(seq.one.of(at, at + fragment).view(np.int64)), pa.array(context), *ids]
                cols += [pa.array((at - seq.first[text]).astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(n.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, ["anchor", "context", "doc_id", "text_hash", "at", "before", "n"])

    return keyed.mapInArrow(work, "anchor long, context long, doc_id long, text_hash long, at int, before int, n int")


#: Bits of a text's hash that tell texts of one document number apart, and of a place.
_TEXT_BITS, _PLACE_BITS = 28, 60


def place() -> Column:
    """A number that orders occurrences by document, place and text; null documents come first.

    The text's bits keep rows of one id apart, above all those without an id.
    """
    return _place_of(_doc_number(), F.col("at"), F.col("text_hash").bitwiseAND((1 << _TEXT_BITS) - 1))


def _place_of(doc: Column, at: Column, bits: Column) -> Column:
    inner = at.cast("long") * (1 << _TEXT_BITS) + bits
    return (doc.cast("decimal(20,0)") * F.lit(1 << _PLACE_BITS).cast("decimal(19,0)") + inner.cast("decimal(19,0)")).cast("decimal(38,0)")


def _first_place() -> Column:
    return _place_of(F.col("first_doc"), F.col("first_at"), F.col("first_bits"))


def _of_place(name: str, doc: str, at: str, bits: str) -> list[Column]:
    """The parts of a place as columns of these names."""
    whole = F.lit(1 << _PLACE_BITS).cast("decimal(19,0)")
    number = F.floor(F.col(name) / whole)
    inner = (F.col(name) - number * whole).cast("long")
    return [number.cast("long").alias(doc), F.shiftright(inner, _TEXT_BITS).cast("int").alias(at), inner.bitwiseAND((1 << _TEXT_BITS) - 1).cast("int").alias(bits)]


def solve_windows(table: pa.Table) -> pa.RecordBatch:
    """Which windows of contexts stand earlier too, from all contexts of some anchors: (anchor, context, low, high)."""
    get = lambda c: table.column(c).to_numpy()
    anchor, context, before, doc, at, bits = (get(c) for c in ("anchor", "context", "before", "first_doc", "first_at", "first_bits"))
    lists = table.column("hashes").combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    hashes = lists.flatten().to_numpy()
    which = np.repeat(np.arange(len(anchor)), n)
    step = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
    offset = step - before[which]
    by_place = np.lexsort((bits, at, doc))
    later = np.any([np.diff(x[by_place], prepend=x[by_place][:1]) != 0 for x in (doc, at, bits)], 0)
    place = np.empty(len(anchor), np.int64)
    place[by_place] = np.cumsum(later)  # equal places have equal numbers
    order = np.lexsort((hashes, offset, anchor[which]))
    w = which[order]
    new = np.ones(len(order), bool)
    new[1:] = (anchor[w][1:] != anchor[w][:-1]) | (offset[order][1:] != offset[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    hit = place[w] > np.minimum.reduceat(place[w], first)[group]
    w, step = w[hit], step[order][hit]
    masks = np.zeros((2, len(anchor)), np.int64)
    for half in (0, 1):
        mine = (step >= half * _MASK) & (step < (half + 1) * _MASK)
        np.bitwise_or.at(masks[half], w[mine], np.int64(1) << (step[mine] - half * _MASK))
    some = np.flatnonzero(masks.any(0))
    return pa.RecordBatch.from_arrays([pa.array(anchor[some]), pa.array(context[some]), pa.array(masks[0][some]), pa.array(masks[1][some])], ["anchor", "context", "low", "high"])


def factor_windows(table: pa.Table, width: int) -> pa.RecordBatch:
    """Contexts that occur once, parsed greedily against all others of their anchors: (anchor, context, factors).

    A factor is the longest run of windows that another context goes on sharing: of the contexts
    with the window, in the order of what follows their anchors, a neighbour shares the longest.
    The parse goes on at the first window that the factor doesn't hold, so every window that
    reaches over a factor's end is tried.
    """
    get = lambda c: table.column(c).to_numpy()
    anchor, context, before, occurs, doc, at = (get(c) for c in ("anchor", "context", "before", "occurs", "first_doc", "first_at"))
    lists, rights = (table.column(c).combine_chunks() for c in ("hashes", "rights"))
    n, valid = np.diff(lists.offsets.to_numpy()), np.diff(rights.offsets.to_numpy())
    hashes = lists.flatten().to_numpy()
    right = np.zeros((len(anchor), width), np.int64)
    right[np.arange(width) < valid[:, None]] = rights.flatten().to_numpy()
    rank = np.empty(len(anchor), np.int64)
    rank[np.lexsort([*right.T[::-1], anchor])] = np.arange(len(anchor))

    which = np.repeat(np.arange(len(anchor)), n)
    first = np.cumsum(n) - n
    step = np.arange(len(which)) - np.repeat(first, n)
    offset = step - before[which]
    order = np.lexsort((rank[which], hashes, offset, anchor[which]))
    w, o, h = which[order], offset[order], hashes[order]
    i = np.flatnonzero((anchor[w][1:] == anchor[w][:-1]) & (o[1:] == o[:-1]) & (h[1:] == h[:-1]))
    reach = np.empty(len(i), np.int64)
    for s in range(0, len(i), _PAIRS):
        a, b = w[i[s : s + _PAIRS]], w[i[s : s + _PAIRS] + 1]
        same = (right[a] == right[b]) & (np.arange(width) < np.minimum(valid[a], valid[b])[:, None])
        reach[s : s + _PAIRS] = np.cumprod(same, 1).sum(1)
    reach -= o[i] + width - 1
    longest, mate = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
    longest[i + 1], mate[i + 1] = reach, w[i]
    more = reach > longest[i]
    longest[i[more]], mate[i[more]] = reach[more], w[i[more] + 1]
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    longest, mate = longest[back], mate[back]

    now, found = np.zeros(len(anchor), np.int64), []
    todo = np.flatnonzero(occurs == 1)
    while len(todo):
        k = first[todo] + now[todo]
        size = longest[k]
        hit = size > 0
        found.append(np.stack([todo[hit], now[todo[hit]], size[hit], mate[k[hit]]]))
        now[todo] += np.maximum(size, 1)
        todo = todo[now[todo] < n[todo]]
    c, s, size, m = np.hstack(found) if found else np.zeros((4, 0), np.int64)
    by = np.lexsort((s, c))
    c, s, size, m = c[by], s[by], size[by], m[by]
    some, counts = np.unique(c, return_counts=True)
    parts = [pa.array(s.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(doc[m]), pa.array((at[m] + s - before[c]).astype(np.int32))]
    factors = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.StructArray.from_arrays(parts, ["step", "n", "source_doc", "source_begin"]))
    return pa.RecordBatch.from_arrays([pa.array(anchor[some]), pa.array(context[some]), factors], ["anchor", "context", "factors"])


def _by_anchor(rows: DataFrame, solve: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """What solve gives for contexts whose anchors have at most CROWD of them: an anchor's contexts meet in one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            key = batch.column("anchor").to_numpy()
            if size >= _CHUNK and batch.num_rows:
                # the anchor that was begun goes on with this batch; the rest is complete
                last = pending[-1].column("anchor")[-1].as_py()
                more = int(np.searchsorted(key != last, True)) if key[0] == last else 0
                pending.append(batch.slice(0, more))
                batch = batch.slice(more)
                if batch.num_rows:
                    yield solve(pa.Table.from_batches(pending))
                    pending, size = [], 0
            if batch.num_rows:
                pending.append(batch)
                size += batch.num_rows
        if pending:
            yield solve(pa.Table.from_batches(pending))

    return rows.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(work, schema)


def _windows_apart(rows: DataFrame) -> DataFrame:
    """The windows of anchors with more contexts, a row for each, that more than one context or place has.

    They are counted by hash, so no group meets in a task; least and most are places.
    """
    flat = rows.select("anchor", "context", "before", "occurs", _first_place().alias("first_place"), F.posexplode("hashes").alias("step", "hash")).withColumn("offset", F.col("step") - F.col("before"))
    same = ["anchor", "offset", "hash"]
    counted = flat.groupBy(*same).agg(F.sum("occurs").alias("total"), F.min("first_place").alias("least"), F.max("first_place").alias("most")).where("total > 1")
    return flat.join(counted, same)


def _solved_apart(rows: DataFrame) -> DataFrame:
    hit = _windows_apart(rows).where(F.col("least") < F.col("first_place"))
    bit = lambda lo: F.bit_or(F.when((F.col("step") >= lo) & (F.col("step") < lo + _MASK), F.expr(f"shiftleft(1L, step - {lo})")).otherwise(F.lit(0).cast("long")))
    return hit.groupBy("anchor", "context").agg(bit(0).alias("low"), bit(_MASK).alias("high"))


def _factored_apart(rows: DataFrame) -> DataFrame:
    """Factors of one window each, from the first place that has it, or the last if that is its own; a parse joins them."""
    hit = _windows_apart(rows).where("occurs = 1").withColumn("source", F.when(F.col("least") < F.col("first_place"), F.col("least")).otherwise(F.col("most")))
    hit = hit.select("anchor", "context", "step", "offset", *_of_place("source", "source_doc", "source_at", "source_bits"))
    factor = F.struct(F.col("step").cast("int").alias("step"), F.lit(1).alias("n"), "source_doc", (F.col("source_at") + F.col("offset")).cast("int").alias("source_begin"))
    return hit.groupBy("anchor", "context").agg(F.array_sort(F.collect_list(factor)).alias("factors"))  # at most a window's places


def _window_hashes(reps: DataFrame, unit: str, window: int, fragment: int, rights: bool) -> DataFrame:
    """reps (text, runs) to a row per context with the hashes of its windows, in order, and with `rights` of what begins at its anchor and ends with a window."""
    width = window - fragment + 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in batches_of(batch.column(0)):
                seq = Sequences(texts, unit)
                lists = batch.column(1).slice(row, len(texts))
                sizes = np.array([len(x) for x in lists], np.int64)
                if not sizes.sum():
                    continue
                runs = pa.concat_arrays([x.values for x in lists if len(x)])
                base, limit = np.repeat(seq.first, sizes), np.repeat(seq.last, sizes)
                of = {f: runs.field(f).to_numpy() for f in ("context", "first_at", "before", "n")}
                # where a doc_id repeats, only the text that holds the context at its place goes on
                begin = base + of["first_at"] - of["before"]
                end = begin + of["n"] - 1 + window
                fits = np.flatnonzero((begin >= base) & (end <= limit))
                fits = fits[_context(seq, begin[fits], end[fits], of["before"][fits], of["n"][fits]) == of["context"][fits]]
                runs, begin, n = runs.take(pa.array(fits)), begin[fits], of["n"][fits].astype(np.int64)
                start = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                hashes = seq.two.of(start, start + window).view(np.int64)
                before = of["before"][fits].astype(np.int64)
                ends = n - 1 - before + width
                lists = [(n, hashes)]
                if rights:
                    anchor = np.repeat(begin + before, ends)
                    length = fragment + np.arange(ends.sum()) - np.repeat(np.cumsum(ends) - ends, ends)
                    lists.append((ends, seq.one.of(anchor, anchor + length).view(np.int64)))
                cols = [runs.field(f) for f in front]
                cols += [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(k)]), pa.int32()), pa.array(x)) for k, x in lists]
                yield pa.RecordBatch.from_arrays(cols, [*front, "hashes", *["rights"] * rights])

    front = ["anchor", "context", "before", "occurs", "first_doc", "first_at", "first_bits", "crowd"]
    kinds = "anchor long, context long, before int, occurs long, first_doc long, first_at int, first_bits int, crowd long, hashes array<long>" + ", rights array<long>" * rights
    # rows that repeat a document whole hold its contexts twice
    return reps.select("text", "runs").mapInArrow(work, kinds)


def _contexts(docs: DataFrame, unit: str, window: int, fragment: int, factors: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(keyed, again, contexts, hashed): texts; runs whose anchors occur twice; their contexts; those that meet others."""
    keyed = with_key(docs)
    runs = runs_of(keyed, unit, window, fragment)
    twice = runs.groupBy("anchor").agg(F.count("*").alias("runs"), (F.min("context") != F.max("context")).alias("several")).where("runs > 1")
    twice = written(twice.select("anchor", "several"), "anchors")
    again = written(runs_of(keyed, unit, window, fragment).join(twice, "anchor"), "again")
    discard(twice)

    contexts = again.groupBy("anchor", "context").agg(
        F.count("*").alias("occurs"), F.min(place()).alias("first_place"), *[F.max(place()).alias("last_place")] * factors, F.first("before").alias("before"), F.first("n").alias("n"), F.first("several").alias("several")
    )
    # the occurrence at first_place stands for its context; a null document is the least number
    parts = _of_place("first_place", "first_doc", "first_at", "first_bits") + (_of_place("last_place", "last_doc", "last_at", "last_bits")[:2] if factors else [])
    contexts = contexts.where("several OR occurs > 1").select("anchor", "context", "occurs", *parts, "before", "n", "several")
    contexts = written(contexts, "contexts")

    crowds = contexts.where("several").groupBy("anchor").agg(F.count("*").alias("crowd")).where("crowd > 1")
    run = F.struct("anchor", "context", "before", "n", "occurs", "first_doc", "first_at", "first_bits", "crowd")
    reps = contexts.join(crowds, "anchor").select("first_doc", "first_bits", run.alias("run")).groupBy("first_doc", "first_bits").agg(F.collect_list("run").alias("runs"))
    bits = F.col("text_hash").bitwiseAND((1 << _TEXT_BITS) - 1).cast("int")
    texts = keyed.select(_doc_number().alias("first_doc"), bits.alias("first_bits"), "text").join(reps, ["first_doc", "first_bits"])
    return keyed, again, contexts, written(_window_hashes(texts, unit, window, fragment, factors), "windows")


def repeated_runs(docs: DataFrame, unit: str, window: int, fragment: int) -> tuple[DataFrame, DataFrame]:
    """(keyed, found): the keyed texts, and for each key the runs with windows that stand earlier too.

    found: doc_id, text_hash, runs array<struct<begin, n, low, high>>. Window `begin + k` (k < n)
    stands earlier, by (doc_id, place), if bit k of low, or bit k - 63 of high, is set.
    """
    keyed, again, contexts, hashed = _contexts(docs, unit, window, fragment, factors=False)
    masks = _by_anchor(hashed.where(F.col("crowd") <= CROWD), solve_windows, "anchor long, context long, low long, high long").unionByName(_solved_apart(hashed.where(F.col("crowd") > CROWD)))
    # rows that repeat a document whole hold its contexts twice
    masks = written(masks.groupBy("anchor", "context").agg(F.bit_or("low").alias("low"), F.bit_or("high").alias("high")), "masks")
    discard(hashed)

    marked = contexts.join(masks, ["anchor", "context"], "left").where("occurs > 1 OR low IS NOT NULL")
    marked = written(marked.select("anchor", "context", "occurs", "first_doc", "first_at", "first_bits", F.coalesce("low", F.lit(0)).alias("low"), F.coalesce("high", F.lit(0)).alias("high")), "marked")
    discard(contexts, masks)

    full = lambda lo: F.expr(f"CASE WHEN n >= {lo + _MASK} THEN 9223372036854775807L WHEN n > {lo} THEN shiftleft(1L, n - {lo}) - 1 ELSE 0L END")
    later = (F.col("occurs") > 1) & (place() != _first_place())
    spans = F.struct((F.col("at") - F.col("before")).alias("begin"), "n", F.when(later, full(0)).otherwise(F.col("low")).alias("low"), F.when(later, full(_MASK)).otherwise(F.col("high")).alias("high"))
    found = again.join(marked, ["anchor", "context"]).select("doc_id", "text_hash", spans.alias("run")).where("run.low <> 0 OR run.high <> 0")
    found = written(found.groupBy("doc_id", "text_hash").agg(F.collect_list("run").alias("runs")), "found")
    discard(again, marked)
    return keyed, found


def factored_runs(docs: DataFrame, unit: str, window: int, fragment: int) -> tuple[DataFrame, DataFrame]:
    """(keyed, found): the keyed texts, and for each key the factors of its runs.

    found: doc_id, text_hash, runs array<struct<begin, n, source_doc, source_begin>>: the n
    windows from begin on stand at source_begin of another place too. Factors end with their run;
    those that go on in the next run have the same source_begin - begin.
    """
    keyed, again, contexts, hashed = _contexts(docs, unit, window, fragment, factors=True)
    kinds = "anchor long, context long, factors array<struct<step:int,n:int,source_doc:long,source_begin:int>>"
    width = window - fragment + 1
    parsed = written(_by_anchor(hashed.where(F.col("crowd") <= CROWD), lambda t: factor_windows(t, width), kinds).unionByName(_factored_apart(hashed.where(F.col("crowd") > CROWD))), "factors")
    discard(hashed)

    marked = contexts.drop("before", "n", "several").join(parsed, ["anchor", "context"], "left").where("occurs > 1 OR factors IS NOT NULL")
    marked = written(marked, "marked")
    discard(contexts, parsed)

    # a context that occurs again is one factor; its source is its first place, or for that one its last
    other = place() != _first_place()
    source = lambda x: F.when(other, F.col(f"first_{x}")).otherwise(F.col(f"last_{x}"))
    whole = F.struct(F.lit(0).alias("step"), F.col("n").alias("n"), source("doc").alias("source_doc"), (source("at") - F.col("before")).cast("int").alias("source_begin"))
    each = again.join(marked, ["anchor", "context"]).withColumn("factors", F.when(F.col("occurs") > 1, F.array(whole)).otherwise(F.col("factors")))
    begin = F.col("at") - F.col("before")
    runs = F.transform("factors", lambda f: F.struct((begin + f["step"]).alias("begin"), f["n"].alias("n"), f["source_doc"].alias("source_doc"), f["source_begin"].alias("source_begin")))
    found = each.select("doc_id", "text_hash", runs.alias("runs"))
    found = written(found.groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("runs")).alias("runs")), "found")
    discard(again, marked)
    return keyed, found


def _doc_number() -> Column:
    return F.coalesce("doc_id", F.lit(-(2**63)))


def with_runs(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """Every row of keyed with its runs, null where it has none."""
    found = found.select(F.col("doc_id").alias("_doc"), F.col("text_hash").alias("_hash"), "runs")
    on = F.col("doc_id").eqNullSafe(F.col("_doc")) & F.col("text_hash").eqNullSafe(F.col("_hash"))
    return keyed.join(found, on, "left").select("doc_id", "text", "runs")


def covered(runs: pa.StructArray | None, window: int, size: int) -> np.ndarray:
    """Which of the `size` units of a text the repeated windows of its runs cover."""
    edge = np.zeros(size + 1, np.int32)
    if runs is not None and len(runs):
        begin, n = runs.field("begin").to_numpy().astype(np.int64), runs.field("n").to_numpy()
        low, high = runs.field("low").to_numpy(), runs.field("high").to_numpy()
        step = np.arange(int(n.max()))
        mask = np.where(step < _MASK, low[:, None] >> np.minimum(step, _MASK - 1), high[:, None] >> np.clip(step - _MASK, 0, _MASK - 1)) & 1
        row, k = np.nonzero(mask & (step < n[:, None]))
        np.add.at(edge, begin[row] + k, 1)
        np.add.at(edge, begin[row] + k + window, -1)
    return np.cumsum(edge[:-1]) > 0
