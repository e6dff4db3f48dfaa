"""Long exact spans shared between records, by content-defined chunking with a gear rolling hash.

The gear hash h = 2^8 h + G(character) modulo 2^64 depends on the last 8 characters only. Cuts are the places where it is
least within a window, so they follow the content and resist shifts from insertions. A chunk goes from a cut of wide
windows to the first cut of narrow windows at least a set way on; its length varies with the content. The widths are
such that every run of min_span characters holds a whole chunk, and that whatever lies in the run decides that chunk.
Chunks are deduplicated by digest: those of one text only are dropped, and only texts that share a chunk with another
are looked at window by window about it. Windows of min_span characters, named by 128 bits, that several texts hold give
the shared spans; those where the character before differs are where a common run of two texts begins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.session import stored

#: Characters that the gear hash covers, and bits that it moves on for each.
GEAR, SHIFT = 8, 8
#: Widths of the windows of cuts that begin a chunk, and that end one.
WIDE, NARROW = 24, 4
#: Least length of a shared span, in code points; and the least that may be asked for.
MIN_SPAN, LEAST_SPAN = 80, 48
#: Members of a group with one key are joined in blocks of about so many.
BLOCK = 2_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gear_hashes(points: np.ndarray) -> np.ndarray:
    """The gear hash at every position of an array of code points, by doubling the span of summed terms."""
    h = _mix(points.astype(np.uint64))
    span = 1
    while span < GEAR:
        older = np.zeros_like(h)
        older[span:] = h[:-span] << np.uint64(span * SHIFT)
        h = h + older
        span *= 2
    return _mix(h)


def _sliding(x: np.ndarray, n: int, least: bool) -> np.ndarray:
    """Minimum of x[i : i + n] (least) or maximum of x[i - n + 1 : i + 1], for all i; cut off at the ends."""
    if not least:
        return ~_sliding(~x[::-1], n, True)[::-1]
    out, span = x.copy(), 1
    while span < n:
        step = min(span, n - span)
        out[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:].copy())
        span += step
    return out


class Texts:
    """Several texts laid end to end: their code points, the text and the place in it of each, and running digests."""

    #: Odd bases of the digests.
    BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)

    def __init__(self, texts: list[str]):
        self.points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.text = np.repeat(np.arange(len(texts)), self.lengths)
        self.local = np.arange(len(self.points)) - (np.cumsum(self.lengths) - self.lengths)[self.text]
        self._sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def cuts(self, h: np.ndarray, width: int) -> np.ndarray:
        """Places where the hash is the least of some window of ``width`` hashes that lies within its text."""
        begins = (self.local >= GEAR - 1) & (self.local + width <= self.lengths[self.text])  # where a whole window begins
        least = np.where(begins, _sliding(h, width, True), np.uint64(0))
        return np.flatnonzero((h == _sliding(least, width, False)) & (self.local >= GEAR - 1))

    def chunks(self, min_span: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, end) of all chunks, in the joined texts; the end is not in it."""
        h = gear_hashes(self.points)
        # a run's first wide window has its cut at most GEAR + WIDE - 2 on, and so far again, and two narrow windows on, it must not be over
        onward = min_span - GEAR - WIDE - 2 * NARROW + 3
        first, last = self.cuts(h, WIDE), self.cuts(h, NARROW)
        at = np.searchsorted(last, first + onward)
        first, last = first[at < len(last)], last[at[at < len(last)]]
        whole = self.text[first] == self.text[last]
        return first[whole] - (GEAR - 1), last[whole] + 1

    def digest(self, starts: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
        """The k-th polynomial digest modulo 2^64 of the characters of each range, from differences of running sums."""
        if k not in self._sums:
            base = self.BASES[k]
            power, back = (np.cumprod(np.r_[np.uint64(1), np.full(len(self.points), np.uint64(b))]) for b in (base, pow(base, -1, 1 << 64)))
            value = _mix(self.points.astype(np.uint64) + np.uint64(k << 32))
            self._sums[k] = np.r_[np.uint64(0), np.cumsum(value * power[:-1], dtype=np.uint64)], back
        sums, back = self._sums[k]
        return _mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64)).view(np.int64)


def _pieces(sizes: list[int], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters together."""
    at = 0
    while at < len(sizes):
        end, size = at, 0
        while end < len(sizes) and (end == at or size + sizes[end] <= most):
            size += sizes[end]
            end += 1
        yield at, end
        at = end


def chunk_digests(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """(doc, digest) of all chunks of docs (doc, text), each digest once for a text."""
    if min_span < LEAST_SPAN:
        raise ValueError(f"spans must be at least {LEAST_SPAN} long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for at, end in _pieces([len(t) for t in texts]):
                t = Texts(texts[at:end])
                start, stop = t.chunks(min_span)
                pairs = np.unique(np.c_[t.text[start], t.digest(start, stop, 0)], axis=0)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at:end][pairs[:, 0]]), pa.array(pairs[:, 1])], ["doc", "digest"])

    return docs.where(F.length("text") >= min_span).select("doc", "text").mapInArrow(run, "doc long, digest long")


def text_classes(docs: DataFrame, key: str = "doc_id", text: str = "text", min_span: int = MIN_SPAN) -> DataFrame:
    """(doc, rep, copies): records with equal texts share the least id as representative; texts below min_span are left out.

    Equality is that of a SHA-256 digest, so only digests are shuffled.
    """
    some = docs.where(F.length(text) >= min_span).select(F.col(key).alias("doc"), F.unhex(F.sha2(text, 256)).alias("sha")).where("doc IS NOT NULL")
    reps = some.groupBy("sha").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return some.join(reps, "sha").select("doc", "rep", "copies")


def unique_texts(docs: DataFrame, classes: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, text) of the representatives alone."""
    reps = classes.where("doc = rep").select("rep")
    return docs.join(reps, docs[key] == reps.rep, "left_semi").select(F.col(key).alias("doc"), F.col(text).alias("text"))


def shared_windows(docs: DataFrame, min_span: int = MIN_SPAN) -> DataFrame:
    """(doc, start, d1, d2, before, after): windows of min_span characters about chunks that other texts hold too.

    ``docs`` (doc, text) should hold each text once. before and after are the neighbouring characters; at a text's end a
    negative number that no other text has. All windows that two texts share are among the rows. A chunk that a third
    of all texts hold costs its rows: digests are counted by partial aggregation, and no pairs are made.
    """
    # a table is read by the count and by the join; making the chunks again would cost more
    chunks = stored(chunk_digests(docs, min_span))
    common = chunks.groupBy("digest").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("digest")
    met = chunks.join(common, "digest").groupBy("doc").agg(F.collect_list("digest").alias("digests"))  # of one text, so bounded by it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "start", "d1", "d2", "before", "after"]
        for b in batches:
            ids, texts, wanted = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist(), b.column(2)
            for at, end in _pieces([len(t) for t in texts]):
                t = Texts(texts[at:end])
                first, last = t.chunks(min_span)
                if not len(first):
                    continue
                found, bounds = t.digest(first, last, 0), np.searchsorted(t.text[first], np.arange(end - at + 1))
                some = np.concatenate([np.isin(found[i:j], np.asarray(wanted[at + k].values)) for k, (i, j) in enumerate(zip(bounds, bounds[1:], strict=False))])
                first, last = first[some], last[some]
                mark = np.zeros(len(t.points) + 1, np.int64)  # where windows that hold such a chunk may start
                np.add.at(mark, np.maximum(last - min_span, 0), 1)
                np.add.at(mark, first + 1, -1)
                start = np.flatnonzero((np.cumsum(mark)[:-1] > 0) & (t.local + min_span <= t.lengths[t.text]))
                if not len(start):
                    continue
                doc, local = ids[at:end][t.text[start]], t.local[start]
                alone = -1 - doc
                before = np.where(local > 0, t.points[np.maximum(start - 1, 0)].astype(np.int64), alone)
                after = np.where(local + min_span < t.lengths[t.text[start]], t.points[np.minimum(start + min_span, len(t.points) - 1)].astype(np.int64), alone)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, local, *(t.digest(start, start + min_span, k) for k in (0, 1)), before, after)], names)

    return docs.join(met, "doc").select("doc", "text", "digests").mapInArrow(run, "doc long, start long, d1 long, d2 long, before long, after long")


def _edges(windows: DataFrame, side: str) -> DataFrame:
    """Rows (d1, d2, doc, edge; and start if there) of windows at which runs of two texts begin (side before) or end (after): where that neighbour is not the same in all."""
    some = windows.groupBy("d1", "d2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min(side).alias("a"), F.max(side).alias("b")).where("lo < hi AND a < b")
    return windows.withColumn("edge", F.col(side)).drop("before", "after").join(some.select("d1", "d2"), ["d1", "d2"])


def _edge_pairs(edges: DataFrame, columns: list[str], block: int) -> DataFrame:
    """Pairs (a_*, b_*) of rows with the same window and different neighbours.

    Rows are grouped by window and neighbour, groups are paired, and only then joined with their rows, so nothing is made
    that is not a pair; groups above ``block`` rows are met in parts, each a join key of its own.
    """
    key = ["d1", "d2"]
    sizes = edges.groupBy(*key, "edge").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    one, other = (sizes.withColumnsRenamed({"edge": f"{x}_edge", "parts": f"{x}_parts"}) for x in "ab")
    groups = one.join(other, key).where("a_edge < b_edge")

    def side(own: str, far: str) -> DataFrame:
        rows = groups.join(edges.withColumnRenamed("edge", f"{own}_edge"), [*key, f"{own}_edge"])
        rows = rows.withColumn(f"{own}_part", F.pmod(F.xxhash64("doc"), F.col(f"{own}_parts")).cast("int"))
        rows = rows.withColumn(f"{far}_part", F.explode(F.sequence(F.lit(0), F.col(f"{far}_parts") - 1)))
        return rows.select(*key, "a_edge", "b_edge", "a_part", "b_part", *(F.col(c).alias(f"{own}_{c}") for c in columns))

    pairs = side("a", "b").join(side("b", "a"), [*key, "a_edge", "b_edge", "a_part", "b_part"]).where("a_doc <> b_doc")
    swap = F.col("a_doc") > F.col("b_doc")
    return pairs.select(*(F.when(swap, F.col(f"{b}_{c}")).otherwise(F.col(f"{a}_{c}")).alias(f"{a}_{c}") for a, b in ("ab", "ba") for c in columns))


def shared_links(docs: DataFrame, min_span: int = MIN_SPAN, block: int = BLOCK) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: different texts of docs (doc, text; each text once) that share a run of at least min_span."""
    windows = stored(shared_windows(docs, min_span).select("doc", "d1", "d2", "before"))
    edges = stored(_edges(windows, "before").distinct())  # few: runs begin at few of all windows
    return _edge_pairs(edges, ["doc"], block).select(F.col("a_doc").alias("doc_a"), F.col("b_doc").alias("doc_b")).distinct()


def shared_runs(docs: DataFrame, min_span: int = MIN_SPAN, block: int = BLOCK) -> DataFrame:
    """(doc_a, doc_b, start_a, start_b, length) of maximal common runs of at least min_span, for docs (doc, text; each text once).

    Runs between two texts are given once for each way that they lie against each other. Where two texts lie against
    each other one way, beginnings and ends of runs take turns, so each beginning goes with the end of the same rank.
    """
    windows = stored(shared_windows(docs, min_span))
    ends = {}
    for side in ("before", "after"):
        p = _edge_pairs(stored(_edges(windows, side)), ["doc", "start"], block)
        order = Window.partitionBy("a_doc", "b_doc", "shift").orderBy("a_start")
        p = p.select("a_doc", "b_doc", "a_start", (F.col("b_start") - F.col("a_start")).alias("shift"))
        ends[side] = p.withColumn("rank", F.row_number().over(order))
    last = ends["after"].withColumnRenamed("a_start", "a_last")
    met = ends["before"].join(last, ["a_doc", "b_doc", "shift", "rank"])
    return met.select(F.col("a_doc").alias("doc_a"), F.col("b_doc").alias("doc_b"), F.col("a_start").alias("start_a"), (F.col("a_start") + F.col("shift")).alias("start_b"), (F.col("a_last") - F.col("a_start") + min_span).alias("length"))


def class_pairs(classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: every pair of records with the same text, in blocks that are join keys of their own."""
    some = classes.where("copies > 1").withColumn("parts", F.ceil(F.col("copies") / block).cast("int"))
    some = some.withColumn("own", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int"))
    a = some.select("rep", F.col("doc").alias("x"), F.col("own").alias("i"), F.explode(F.sequence(F.col("own"), F.col("parts") - 1)).alias("j"))
    b = some.select("rep", F.col("doc").alias("y"), F.col("own").alias("j"), F.explode(F.sequence(F.lit(0), F.col("own"))).alias("i"))
    met = a.join(b, ["rep", "i", "j"]).where("x < y OR (i < j AND x <> y)")
    return met.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def expanded(links: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b, of all records from links between representatives and the classes of records."""
    members = classes.select("rep", "doc")
    a = links.join(members.withColumnsRenamed({"rep": "doc_a", "doc": "one"}), "doc_a")
    between = a.join(members.withColumnsRenamed({"rep": "doc_b", "doc": "other"}), "doc_b").select(F.least("one", "other").alias("doc_a"), F.greatest("one", "other").alias("doc_b"))
    return between.unionAll(class_pairs(classes))


def shared_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", min_span: int = MIN_SPAN) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: all pairs of records whose texts share a run of at least min_span code points.

    Runs are sought between different texts only (``text_classes``, ``shared_links``: representatives and membership,
    which is the form to use where copies are many); only the result names every pair of records with these texts, and
    every pair of records with the same text. Keys must be unique; null texts and texts below min_span give no rows.
    """
    classes = text_classes(docs, key, text, min_span)
    return expanded(shared_links(unique_texts(docs, classes, key, text), min_span), classes)


def shared_share(docs: DataFrame, key: str = "doc_id", text: str = "text", min_span: int = MIN_SPAN) -> DataFrame:
    """(doc_id, n_chars, shared_chars, shared_share): how much of each text stands in another record, for every record.

    Windows that several texts hold are laid over each text; no pairs are made, so a passage that a third of all records
    hold costs no more than its rows. Copies of a text count wholly as shared. Null and empty texts have 0 characters
    and share 0.
    """
    classes = text_classes(docs, key, text, min_span)
    windows = stored(shared_windows(unique_texts(docs, classes, key, text), min_span).select("doc", "start", "d1", "d2"))
    held = windows.groupBy("d1", "d2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("d1", "d2")
    starts = windows.join(held, ["d1", "d2"], "left_semi")
    after = F.lead("start").over(Window.partitionBy("doc").orderBy("start"))
    covered = starts.select(F.col("doc").alias("rep"), F.least(F.lit(min_span), F.coalesce(after - F.col("start"), F.lit(min_span))).alias("n")).groupBy("rep").agg(F.sum("n").alias("covered"))
    by_doc = classes.join(covered, "rep", "left").select("doc", "copies", F.coalesce("covered", F.lit(0)).alias("covered"))
    n = F.coalesce(F.length(text), F.lit(0)).cast("long")
    all_docs = docs.select(F.col(key).alias("doc"), n.alias("n_chars")).join(by_doc, "doc", "left")
    shared = F.when(F.col("copies") > 1, F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return all_docs.select(F.col("doc").alias(key), "n_chars", shared.alias("shared_chars"), F.round(F.coalesce(F.try_divide(shared, F.col("n_chars")), F.lit(0.0)), 6).alias("shared_share"))
