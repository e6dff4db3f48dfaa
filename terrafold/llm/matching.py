"""Matching of places across sources without keys: BM25 retrieval over an inverted index, mutual nearness, calibrated confidence.

Records of one table are queries to an index of the other. Terms are grams of names; a query has two fields for them, its
name and the host of its website, which often spells the name out. Position, town and category take part as attributes:
the index is sharded by cell, and by town for records without a trustworthy position, nearness and category add to the
score. In each shard the top of every query is exact: a pair that reaches the share FLOOR of the document's weight
must share one of its heaviest terms that carry the rest, so only these are posted (the upper bound of MaxScore), all that
are met are scored in full, and the TOP best and all within MARGIN of the best are returned.

Two logistic models, fitted against decoys (the same queries, moved away), turn features into a score and the score and
its gap to the best of another spot into a confidence.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.operators.spatial import EARTH_RADIUS_M, salted, usable_position, wrapped
from terrafold.session import stored

#: Size of the space that grams are hashed to, which bounds the table of weights that is broadcast.
BITS = 18
BUCKETS = 1 << BITS
GRAM = 3
#: BM25: saturation of repeats, and how much the length of a name counts; repeats above MOST_TF count as so many.
K1, B, MOST_TF = 1.2, 0.75, 3
#: Share of a document's weight that a query must have to be looked at; how many pairs of a query are kept at least, and down to which share of the best all are.
FLOOR, TOP, MARGIN = 0.12, 8, 0.6
#: The same where no position narrows the search, so that a name has to say more.
FAR_FLOOR = 0.4
#: Records farther apart are not near.
NEAR_M = 180.0
#: Nearness adds up to so much to a score: the logarithm of the ratio of the area of NEAR_M to that of 15 m.
NEARNESS = 2 * float(np.log(NEAR_M / 15))
CELL_DEG = 0.004
TOWN_DEG = 0.1
#: Records of one side of a shard that are worked on together; rows of a block of shards.
SHARD_ROWS, BLOCK_ROWS = 20_000, 20_000
#: Sums and postings that are worked on together.
LOT = 2_000_000
#: A cell belongs to a town that at least this share of the town's records are in.
TOWN_SHARE = 0.01
#: Most queries that a calibration looks at, and how far the decoys are moved.
CALIBRATION_ROWS = 20_000
DECOY_DEG = 0.02
#: Least likeness of names that is looked at, and likeness above which each bit says more.
NAME_FLOOR, CLOSE = 0.45, 0.8
#: POIs are twins to a place if their names are so alike, they are so near, and no less like it than the best by so much; places are to a POI if no less like it by TWIN_GAP.
TWIN_NAMES, TWIN_M, TOP_GAP, TWIN_GAP = 0.75, 120.0, 0.15, 0.35
#: What the best of all POIs must be ahead of the next for a place that neither town nor position tells where to look.
WHOLE_GAP = 1.0
#: A position that so many places of different names share to the last digit stands for a town and not for a place.
SHARED_POSITION = 3

# Letters that Unicode does not take apart.
_FOLD = str.maketrans({"œ": "oe", "æ": "ae", "ø": "o", "ı": "i", "ł": "l", "đ": "d", "ß": "ss", "þ": "th", "ð": "d"})


def fold(text: str) -> str:
    """Case, accents and ligatures folded away."""
    text = text.casefold().translate(_FOLD)
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


#: The town that a source adds to a name: in brackets or after an at sign.
SAID_TOWN = r"[(@]\s*([^()@]+?)\s*\)?\s*(?:,[^,]*)?$"
_WORD, _HOST = re.compile(r"[^\W_]+"), re.compile(r"^\s*(?:[a-z][a-z0-9+.-]*://)?([^/?#:\s]+)", re.IGNORECASE)


def name_words(name: str | None, town: str | None = None) -> list[str]:
    """Words of a name, without those of the record's own town if others are left."""
    words = _WORD.findall(fold(name)) if name else []
    if town:
        gone = set(_WORD.findall(fold(town)))
        return [w for w in words if w not in gone] or words
    return words


def host_word(url: str | None) -> str:
    """The longest part of the host of a web address, its last part aside; empty if there is none."""
    m = _HOST.match(url) if url else None
    return max(_WORD.findall(fold(m[1]).rpartition(".")[0]), key=len, default="") if m else ""


def name_terms(words: list[str]) -> list[int]:
    """Terms of a name, bucket and frequency packed: grams of each word with marks of its start and end, and those of the joined words that lie across words.

    So neither another order of words, nor words run together, nor words beside the name change many of them.
    """
    found: dict[int, int] = {}
    for w in words:
        w = f"^{w}$"
        for i in range(len(w) - GRAM + 1):
            g = zlib.crc32(w[i : i + GRAM].encode("utf-8", "replace")) % BUCKETS
            found[g] = found.get(g, 0) + 1
    joined = "".join(words)
    for i in range(len(joined) - GRAM + 1):
        found.setdefault(zlib.crc32(joined[i : i + GRAM].encode("utf-8", "replace")) % BUCKETS, 1)
    return sorted(g * (MOST_TF + 1) + min(n, MOST_TF) for g, n in found.items())


def with_terms(records: DataFrame) -> DataFrame:
    """``records`` (with name, town and website) with key (the joined words), sorted_key, terms, and host_key and host, those of the website's host."""
    made = {"key": pa.string(), "sorted_key": pa.string(), "terms": pa.list_(pa.int32()), "host_key": pa.string(), "host": pa.list_(pa.int32())}
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema]) + ", key string, sorted_key string, terms array<int>, host_key string, host array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [name_words(n, t) for n, t in zip(b.column("name").to_pylist(), b.column("town").to_pylist(), strict=True)]
            hosts = [host_word(u) for u in b.column("website").to_pylist()]
            new = [["".join(w) for w in words], ["".join(sorted(w)) for w in words], [name_terms(w) for w in words], hosts, [name_terms([h]) if h else [] for h in hosts]]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, t) for c, t in zip(new, made.values(), strict=True))], [*b.schema.names, *made])

    return records.mapInArrow(run, schema)


class Weights:
    """Inverse document frequencies of all buckets and the mean length of names: BM25's statistics of a whole index."""

    def __init__(self, pois: DataFrame):
        rows = pois.select(F.explode("terms").alias("t")).groupBy(F.floor(F.col("t") / (MOST_TF + 1)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("df"), F.sum(F.col("t") % (MOST_TF + 1)).alias("n"))
        counted = rows.toPandas()  # at most BUCKETS rows
        n = pois.where(F.size("terms") > 0).count()
        df = np.zeros(BUCKETS)
        df[counted["bucket"].to_numpy(np.int64)] = counted["df"]
        self.idf = np.where(df > 0, np.log1p((n - df + 0.5) / (df + 0.5)), 0).astype(np.float32)
        self.mean_length = float(counted["n"].sum() / n) if n else 1.0

    def of_terms(self, tf: np.ndarray, bucket: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self.idf[bucket] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / self.mean_length))


def repaired(lat: Column, lon: Column) -> tuple[Column, Column]:
    """The position if it is usable; that with both exchanged, or scaled by 1e-7, if only so it is; else nulls."""
    ways = [(lat, lon), (lon, lat), (lat / 1e7, lon / 1e7)]
    a, b = F.lit(None).cast("double"), F.lit(None).cast("double")
    for y, x in reversed(ways):
        ok = usable_position(y, x)
        a, b = F.when(ok, y).otherwise(a), F.when(ok, x).otherwise(b)
    return a, b


def one_record(rows: DataFrame, key: str, attributes: list[str], at: str) -> DataFrame:
    """One row a key with the latest non-empty value of each attribute and the latest usable position (lat, lon)."""
    time = F.coalesce(F.col(at).cast("timestamp_ntz"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    lat, lon = repaired(F.col("lat"), F.col("lon"))
    rows = rows.where(F.col(key).isNotNull()).withColumns({"__at": time, "__lat": lat, "__lon": lon})

    def latest(value: Column, full: Column) -> Column:
        return F.max_by(value, F.when(full, F.struct("__at", value)))

    aggregates = [latest(F.trim(a), F.coalesce(F.trim(a) != "", F.lit(False))).alias(a) for a in attributes]
    placed = F.max_by(F.struct(F.col("__lat").alias("lat"), F.col("__lon").alias("lon")), F.when(F.col("__lat").isNotNull(), F.struct("__at", "__lat", "__lon"))).alias("p")
    out = rows.groupBy(F.col(key).cast("long").alias("id")).agg(*aggregates, placed)
    return out.select("id", *attributes, F.col("p.lat").alias("lat"), F.col("p.lon").alias("lon"))


def copies(records: DataFrame, attributes: list[str]) -> DataFrame:
    """``records`` with rep: those that no attribute tells apart share the least id as representative."""
    same = [F.xxhash64(F.lit(k), *(F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in attributes)).alias(f"__h{k}") for k in (1, 2)]
    keyed = records.select("*", *same)
    reps = keyed.groupBy("__h1", "__h2").agg(F.min("id").alias("rep"))
    return keyed.join(reps, ["__h1", "__h2"]).drop("__h1", "__h2")


def _cell(lat: Column, lon: Column, deg: float) -> Column:
    """A cell of about deg x deg as a number; its width in longitude follows the latitude."""
    strip = F.floor((lat + 90) / deg)
    cos = F.cos(F.radians(F.least(F.abs((strip + 0.5) * deg - 90), F.lit(89.0))))
    around = F.floor(360 * cos / deg)
    return strip.cast("long") * (1 << 24) + F.pmod(F.floor((lon + 180) * around / 360), around)


def _cells_within(lat: Column, lon: Column, deg: float, metres: float) -> Column:
    """All cells that points within ``metres`` may lie in."""
    reach = np.degrees(metres / EARTH_RADIUS_M) * 1.001
    lons = reach / F.cos(F.radians(F.least(F.abs(lat) + reach, F.lit(89.0))))

    def of_strip(strip: Column) -> Column:
        cos = F.cos(F.radians(F.least(F.abs((strip + 0.5) * deg - 90), F.lit(89.0))))
        around = F.floor(360 * cos / deg)
        blocks = F.sequence(F.floor((lon - lons + 180) * around / 360), F.floor((lon + lons + 180) * around / 360))
        return F.transform(blocks, lambda b: strip.cast("long") * (1 << 24) + F.pmod(b, around))

    return F.array_distinct(F.flatten(F.transform(F.sequence(F.floor((lat - reach + 90) / deg), F.floor((lat + reach + 90) / deg)), of_strip)))


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    x = F.radians(wrapped(lon2 - lon1)) * F.cos(F.radians((lat1 + lat2) / 2))
    return EARTH_RADIUS_M * F.sqrt(x * x + F.pow(F.radians(lat2 - lat1), 2))


def towns_of_cells(places: DataFrame) -> DataFrame:
    """(town, tcell): the coarse cells that a share of at least TOWN_SHARE of a town's positioned records lies in."""
    n = places.where("town IS NOT NULL AND lat IS NOT NULL").groupBy("town", _cell(F.col("lat"), F.col("lon"), TOWN_DEG).alias("tcell")).agg(F.count(F.lit(1)).alias("n"))
    whole = n.groupBy("town").agg(F.sum("n").alias("all"))
    return n.join(whole, "town").where((F.col("n") >= TOWN_SHARE * F.col("all")) & (F.col("n") >= 2)).select("town", "tcell")


def like_towns(pois: DataFrame, towns: DataFrame) -> DataFrame:
    """(town, next): another town of about as many POIs, since chance likeness grows with the POIs a name is put to.

    Towns are in classes by the power of two of their POIs, and of one class in order; none for one that is alone.
    """
    cells = pois.where("lat IS NOT NULL").groupBy(_cell(F.col("lat"), F.col("lon"), TOWN_DEG).alias("tcell")).agg(F.count(F.lit(1)).alias("n"))
    size = towns.join(cells, "tcell").groupBy("town").agg(F.sum("n").alias("n"))
    by_size = Window.partitionBy(F.floor(F.log2("n"))).orderBy(F.desc("n"), "town")
    return size.select("town", F.coalesce(F.lead("town").over(by_size), F.lag("town").over(by_size)).alias("next")).where("next IS NOT NULL")


# retrieval within shards

_SHIP = ["id", "lat", "lon", "key", "sorted_key", "host_key", "category"]
PAIRS = (
    "place long, decoy boolean, poi long, bm25 double, covered_place double, covered_poi double, metres double, "
    "qkey string, qsorted string, qhost string, dkey string, dsorted string, qcat string, dcat string, dlat double, dlon double"
)


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(row, value) of all elements of a list column."""
    lengths = np.asarray(column.value_lengths().fill_null(0)).astype(np.int64)
    return np.repeat(np.arange(len(column)), lengths), np.asarray(column.flatten()).astype(np.int64)


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of range, position) of all positions in the ranges [lo, hi)."""
    n = hi - lo
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]


class Index:
    """Postings of the POIs of a block of shards, by (shard, term); ``shards`` are small numbers."""

    def __init__(self, rows: pa.Table, shards: np.ndarray, weights: Weights, n_shards: int, floor: float = FLOOR):
        doc, packed = _flat(rows["terms"].combine_chunks())
        bucket, tf = packed // (MOST_TF + 1), packed % (MOST_TF + 1)
        length = np.bincount(doc, tf, len(shards))
        weight = weights.of_terms(tf, bucket, length[doc])
        self.whole = np.bincount(doc, weight, len(shards))
        self.weights = weights
        # documents of a shard lie together: where each shard begins, and the place of a document in it
        self.member = np.argsort(shards, kind="stable")
        self.begin = np.r_[0, np.cumsum(np.bincount(shards, minlength=n_shards))]
        self.local = np.empty(len(shards), np.int64)
        self.local[self.member] = np.arange(len(shards)) - self.begin[shards[self.member]]
        # heaviest terms first in each document; those after which less than the floor of its weight is left need no posting
        order = np.lexsort((bucket, -weight, doc))
        before = np.cumsum(weight[order]) - weight[order]
        begins = np.r_[0, np.cumsum(np.bincount(doc, minlength=len(shards)))][doc[order]]
        left = self.whole[doc[order]] - (before - before[begins]) if len(doc) else before
        posted = order[left >= floor * self.whole[doc[order]] * (1 - 1e-9)]
        self.unposted = self.whole - np.bincount(doc[posted], weight[posted], len(shards))
        posted = posted[np.argsort((shards[doc[posted]] << BITS) | bucket[posted], kind="stable")]
        self.posted, self.posted_doc, self.posted_weight = (shards[doc[posted]] << BITS) | bucket[posted], doc[posted], weight[posted]
        order = np.argsort((doc << BITS) | bucket, kind="stable")
        self.held, self.held_weight = ((doc << BITS) | bucket)[order], weight[order]

    def candidates(self, shards: np.ndarray, query: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, doc) of all pairs of a shard that can be among the best of a query, in lots of bounded size.

        The weights of the terms posted are summed; what is not posted is at most the rest. A pair is left out if with
        that rest, and the most that nearness adds, it is below both the TOP-th best and MARGIN of the best.
        """
        key = (shards[query] << BITS) | bucket
        lo, hi = np.searchsorted(self.posted, key), np.searchsorted(self.posted, key, "right")
        size = self.begin[shards + 1] - self.begin[shards]  # documents that a query may meet
        work = np.cumsum(size + np.bincount(query, hi - lo, len(shards)))
        lot = np.searchsorted(work, np.arange(LOT, (work[-1] if len(work) else 0) + LOT, LOT))  # the last query of each lot
        of_query = np.argsort(query, kind="stable")
        ends = np.searchsorted(query[of_query], np.arange(len(shards) + 1))
        at = 0
        for end in np.unique(np.minimum(lot + 1, len(shards))):
            terms = of_query[ends[at] : ends[end]]
            offset = np.r_[0, np.cumsum(size[at:end])]
            which, post = _ranges(lo[terms], hi[terms])
            asked = query[terms][which]
            sums = np.bincount(offset[asked - at] + self.local[self.posted_doc[post]], self.posted_weight[post], offset[-1])
            cell = np.flatnonzero(sums)
            if len(cell):
                q = np.searchsorted(offset, cell, "right") - 1
                order = np.argsort(q - sums[cell] / (sums.max() * 1.001), kind="stable")
                q, part, cell = q[order], sums[cell[order]], cell[order]
                first = np.searchsorted(q, q)
                last = np.searchsorted(q, q, "right")
                doc = self.member[self.begin[shards[at + q]] + cell - offset[q]]
                least = np.where(last - first < TOP, 0.0, np.minimum(part[np.minimum(first + TOP, last) - 1], MARGIN * part[first]))
                keep = part + self.unposted[doc] + NEARNESS >= least
                yield at + q[keep], doc[keep]
            at = end

    def scores(self, q: np.ndarray, d: np.ndarray, query: np.ndarray, bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(BM25 score, share of the query's weight, share of the document's) of pairs, over all their terms; ``query`` is sorted."""
        ends = np.searchsorted(query, np.arange(n + 1))
        pair, at = _ranges(ends[q], ends[q + 1])
        key, idf = (d[pair] << BITS) | bucket[at], self.weights.idf[bucket[at]]
        place = np.minimum(np.searchsorted(self.held, key), max(len(self.held) - 1, 0))
        hit = self.held[place] == key
        score = np.bincount(pair, np.where(hit, self.held_weight[place], 0), len(q))
        shared, whole = np.bincount(pair, np.where(hit, idf, 0), len(q)), np.bincount(pair, idf, len(q))
        return score, shared / np.maximum(whole, 1e-9), score / np.maximum(self.whole[d], 1e-9)


def _block(rows: pa.Table, weights: Weights, floor: float) -> pa.Table | None:
    """The best pairs of all queries of a block of whole shards."""
    is_doc = np.asarray(rows["is_doc"])
    _, shard = np.unique(np.asarray(rows["shard"]), return_inverse=True)
    docs, asked = rows.filter(pa.array(is_doc)), rows.filter(pa.array(~is_doc))
    if not len(docs) or not len(asked):
        return None
    index, own = Index(docs, shard[is_doc], weights, int(shard.max()) + 1, floor), shard[~is_doc]
    found = []
    for field in ("terms", "host"):
        query, packed = _flat(asked[field].combine_chunks())
        bucket = packed // (MOST_TF + 1)
        for q, d in index.candidates(own, query, bucket):
            for at in range(0, len(q), LOT // 32):
                some = slice(at, at + LOT // 32)
                found.append((q[some], d[some], *index.scores(q[some], d[some], query, bucket, len(asked))))
    if not found:
        return None
    q, d, score, of_query, of_doc = (np.concatenate(c) for c in zip(*found, strict=True))
    # of the two fields of a query the one that says more counts
    order = np.lexsort((-score, d, q))
    q, d, score, of_query, of_doc = (c[order] for c in (q, d, score, of_query, of_doc))
    first = np.r_[True, (np.diff(q) != 0) | (np.diff(d) != 0)]
    at = [np.asarray(t[c]).astype(np.float64) for t, c in ((asked, "lat"), (docs, "lat"), (asked, "lon"), (docs, "lon"))]
    y, x = at[1][d] - at[0][q], (at[3][d] - at[2][q] + 180) % 360 - 180
    metres = EARTH_RADIUS_M * np.hypot(np.radians(y), np.radians(x) * np.cos(np.radians((at[1][d] + at[0][q]) / 2)))
    keep = first & (of_doc >= floor) & ~(metres > NEAR_M)  # without a position the distance is not a number
    q, d, score, of_query, of_doc, metres = (c[keep] for c in (q, d, score, of_query, of_doc, metres))
    if not len(q):
        return None
    total = score + np.nan_to_num(2 * np.log(NEAR_M / np.clip(metres, 15, NEAR_M)))
    order = np.lexsort((d, -total, q))
    start = np.searchsorted(q[order], q[order])
    top = order[(np.arange(len(order)) - start < TOP) | (total[order] >= MARGIN * total[order][start])]
    q, d = pa.array(q[top]), pa.array(d[top])
    a, b = asked.take(q), docs.take(d)
    far = pa.array(metres[top], mask=np.isnan(metres[top]))
    columns = [a["id"], a["decoy"], b["id"], pa.array(score[top]), pa.array(of_query[top]), pa.array(of_doc[top]), far, a["key"], a["sorted_key"], a["host_key"], b["key"], b["sorted_key"], a["category"], b["category"], b["lat"], b["lon"]]
    return pa.table(columns, [f.strip().split(" ")[0] for f in PAIRS.split(",")])


def retrieved(queries: DataFrame, docs: DataFrame, weights, floor: float = FLOOR, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The pairs (see PAIRS) of queries and docs of a shard, the best of each query exactly.

    queries: the columns of _SHIP, terms, host, cell (the shard) and decoy; docs: the same without host_key, host and decoy. Full
    shards are split on both sides. ``weights`` is a broadcast of Weights.
    """
    d, q = salted(docs, queries, shard_rows)
    shard = F.xxhash64("cell", "salt").alias("shard")
    none = {"host": F.lit(None).cast("array<int>"), "host_key": F.lit("")}
    rows = d.withColumns(none).select(shard, F.lit(True).alias("is_doc"), F.lit(False).alias("decoy"), *_SHIP, "terms", "host").unionByName(q.select(shard, F.lit(False).alias("is_doc"), "decoy", *_SHIP, "terms", "host"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def worked(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = _block(pa.Table.from_batches(parts), weights.value, floor) if parts else None
            if out is not None:
                yield from out.combine_chunks().to_batches()

        for b in batches:
            key = np.asarray(b.column(0))
            if sum(map(len, held)) + len(b) >= BLOCK_ROWS:  # what lies before the last shard is whole
                cut = int(np.searchsorted(key, key[-1])) if len(b) else 0
                if cut or (held and len(b) and held[-1].column(0)[-1].as_py() != key[-1]):
                    yield from worked([*held, b.slice(0, cut)] if cut else held)
                    held, b = [], b.slice(cut)
            if len(b):
                held.append(b)
        yield from worked(held)

    return rows.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, PAIRS)


# scores

FEATURES = ["alike", "close", "edited", "covered_place", "covered_poi", "geo", "far_off", "lift"]


def scored(pairs: DataFrame) -> DataFrame:
    """Pairs with the likeness of their names: the mean share of weight in common, or one less the share of letters to edit, if that is more.

    Words count as they stand or in alphabetical order. geo is the information in being within the distance found rather
    than anywhere near, the logarithm of the ratio of both areas, 0 without a distance. Below NAME_FLOOR pairs go.
    """

    def edited(a: str, b: str) -> Column:
        return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))

    s = pairs.withColumn("edited", F.greatest(edited("qkey", "dkey"), edited("qsorted", "dsorted"), edited("qhost", "dkey")))
    s = s.withColumn("alike", F.greatest((F.col("covered_place") + F.col("covered_poi")) / 2, F.col("edited"))).where(F.col("alike") >= NAME_FLOOR)
    geo = F.coalesce(2 * F.log(NEAR_M / F.greatest(F.least("metres", F.lit(NEAR_M)), F.lit(15.0))), F.lit(0.0))
    s = s.withColumn("geo", geo).withColumns({"far_off": (1 - F.col("alike")) * F.col("geo"), "close": F.greatest(F.lit(0.0), F.col("alike") - CLOSE)})
    # a place asks in several cells and, without a city, at two positions: its best score for a POI counts
    best = Window.partitionBy("place", "decoy", "poi").orderBy(F.desc("geo"), F.desc("alike"))
    return s.withColumn("__r", F.row_number().over(best)).where("__r = 1").drop("__r", "qkey", "qsorted", "qhost", "dkey")


def category_lift(pairs: DataFrame) -> DataFrame:
    """(qcat, dcat, lift): how much oftener two categories meet in pairs of near-equal names at one spot than by chance, as a logarithm."""
    n = pairs.where("NOT decoy AND alike >= 0.9 AND metres <= 60").groupBy("qcat", "dcat").agg(F.count(F.lit(1)).alias("n"))
    rows, cols = n.groupBy("qcat").agg(F.sum("n").alias("a")), n.groupBy("dcat").agg(F.sum("n").alias("b"))
    n = n.join(rows, "qcat").join(cols, "dcat").join(F.broadcast(n.agg(F.sum("n").alias("c"))))  # one row
    lift = F.log((F.col("n") + 0.5) * (F.col("c") + 1) / ((F.col("a") + 1) * (F.col("b") + 1)))
    return n.select("qcat", "dcat", F.greatest(F.lit(-2.0), F.least(F.lit(2.0), lift)).alias("lift"))


def with_lift(pairs: DataFrame, lift: DataFrame) -> DataFrame:
    unknown = F.col("qcat").isNull() | F.col("dcat").isNull()
    return pairs.join(lift, ["qcat", "dcat"], "left").withColumn("lift", F.coalesce("lift", F.when(unknown, 0.0).otherwise(-1.0)))


def _odds(weights: np.ndarray, features: list[str]) -> Column:
    z = F.lit(float(weights[0]))
    for w, f in zip(weights[1:], features, strict=True):
        z = z + F.lit(float(w)) * F.col(f)
    return F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights (intercept first) of a logistic regression, by Newton steps; columns are scaled inside."""
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = np.c_[np.ones(len(x)), (x - mean) / sd]
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(w)) * len(x) / 1000
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w * len(x) / 1000)
        w += step
        if np.abs(step).max() < 1e-7:
            break
    return np.r_[w[0] - (w[1:] * mean / sd).sum(), w[1:] / sd]


def fit_upward(x: np.ndarray, y: np.ndarray, features: list[str]) -> np.ndarray:
    """``fit_logistic`` on those features alone that speak for a match where they should; the worst of the others goes first."""
    sign = np.array([-1.0 if f == "far_off" else 1.0 for f in features])
    used = np.ones(len(features))
    while True:
        w = fit_logistic(x * used, y)
        w[1:] *= used
        against = w[1:] * sign * x.std(0)
        if against.min() >= 0:
            return w
        used[against.argmin()] = 0


def calibrate(best: DataFrame, features: list[str]) -> np.ndarray:
    """Logistic weights that tell the best pairs of a sample of queries from those of the same queries as decoys.

    ``best`` (decoy and features) has at most a row for each of the CALIBRATION_ROWS queries of the sample and its decoy.
    No feature may count against what it speaks for, as it might where few rows are to be told apart.
    """
    rows = best.select("decoy", *features).toPandas()
    x, y = rows[features].to_numpy(float), (~rows["decoy"].to_numpy(bool)).astype(float)
    if len(set(y)) < 2:  # nothing to tell apart: any pair that comes so far is as good as its name
        return np.array([-8.0, *[12.0 if f in ("alike", "score") else 0.0 for f in features]]) if "alike" in features else np.array([0.0, *[1.0 if f == "score" else 0.0 for f in features]])
    return fit_upward(x, y, features)


def with_gap(pairs: DataFrame) -> DataFrame:
    """Pairs with a score, with those of the best of either side and the gap to the best of another spot.

    A POI is a place's nearest if it is the best, or a twin of it: at the same spot with nearly the same name.
    """
    of_place, of_poi = Window.partitionBy("place", "decoy"), Window.partitionBy("poi", "decoy")
    s = pairs.withColumns({"top": F.max(F.struct("score", "poi", "dlat", "dlon", "dsorted", "alike")).over(of_place), "poi_alike": F.max("alike").over(of_poi)})
    apart = distance_m(F.col("dlat"), F.col("dlon"), F.col("top.dlat"), F.col("top.dlon"))
    s = s.withColumn("apart", F.when(F.col("poi") == F.col("top.poi"), 0.0).otherwise(F.coalesce(apart, F.lit(float("inf")))))
    other = F.max(F.when(F.col("apart") > TWIN_M, F.col("score"))).over(of_place)
    named = 1 - F.levenshtein("dsorted", "top.dsorted") / F.greatest(F.length("dsorted"), F.length("top.dsorted"), F.lit(1))
    twin = (F.col("apart") <= TWIN_M) & (named >= TWIN_NAMES) & (F.col("alike") >= F.col("top.alike") - TOP_GAP)
    s = s.withColumns({"gap": F.least(F.lit(5.0), F.coalesce(F.col("top.score") - other, F.lit(5.0))), "is_nearest": (F.col("poi") == F.col("top.poi")) | twin, "is_top": F.col("poi") == F.col("top.poi")})
    return s.drop("top", "dsorted")


def decided(pairs: DataFrame, sampled: DataFrame, threshold: float, route: str) -> DataFrame:
    """Mutually nearest pairs whose confidence reaches the threshold. ``sampled`` (place): the queries that have decoys.

    The first model ranks: it is fitted on the pair of each query with the best BM25 score. The second is fitted on the
    best pairs of that ranking, with their gap. The confidence is 1 - decoys / real queries at the same odds.
    """
    first = Window.partitionBy("place", "decoy").orderBy(F.desc("rank_by"), "poi")
    sample = pairs.join(sampled, "place", "left_semi").withColumn("rank_by", F.col("bm25") * F.col("alike") + F.col("geo"))
    best = sample.withColumn("__r", F.row_number().over(first)).where("__r = 1")
    score = _odds(calibrate(best, FEATURES), FEATURES)
    ranked = stored(with_gap(pairs.withColumn("score", score)))
    odds = _odds(calibrate(ranked.where("is_top").join(sampled, "place", "left_semi"), ["score", "gap"]), ["score", "gap"])
    sure = F.greatest(F.lit(0.0), 1 - F.exp(-odds))
    mutual = F.col("is_nearest") & (F.col("alike") >= F.col("poi_alike") - TWIN_GAP)
    out = ranked.where(~F.col("decoy") & mutual).withColumn("confidence", F.round(sure, 6)).where(F.col("confidence") >= threshold)
    return out.select(F.col("place").alias("place_id"), F.col("poi").alias("poi_id"), "confidence", *FEATURES, "gap", "metres", "apart", F.lit(route).alias("route"))


def match_places(web: DataFrame, poi: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(place_id, poi_id, confidence, route and features): records of both tables that stand for one real place.

    web: place_id, name, category, city, website, lat, lon, fetched_at; poi: osm_id, name, category, lat, lon, loaded_at.
    Of several rows with a key the latest filled values count; keys, names and positions may be null, and records without
    a name match nothing. A place or a POI may be in several pairs: with all records that stand for its nearest.
    Records that no attribute tells apart are matched through one. route tells whether the pair was found by position
    (near) or by town; places that have neither are looked for among all POIs, which counts as town.
    """
    town = F.nullif(F.lower(F.trim("city")), F.lit(""))
    places = one_record(web, "place_id", ["name", "category", "city", "website"], "fetched_at").where("name IS NOT NULL").withColumn("city", town)
    pois = one_record(poi, "osm_id", ["name", "category"], "loaded_at").where("name IS NOT NULL")
    places, pois = (stored(copies(r, [c for c in r.columns if c != "id"])) for r in (places, pois))
    all_places, all_pois = places.select("id", "rep"), pois.select("id", "rep")
    places, pois = places.where("id = rep").drop("rep"), pois.where("id = rep").drop("rep")
    # without a city, a town that the name ends with is as good, to find the place by but not to doubt its position
    told = F.lower(F.regexp_extract("name", SAID_TOWN, 1))
    cities = places.where("city IS NOT NULL").select(F.col("city").alias("said")).distinct()
    places = places.withColumn("told", F.when(F.col("city").isNull(), told)).join(cities, F.col("told") == F.col("said"), "left").drop("told").withColumn("town", F.coalesce("city", "said"))
    places = stored(with_terms(places))
    pois = stored(with_terms(pois.withColumns({"town": F.lit(None).cast("string"), "website": F.lit(None).cast("string")})).drop("town", "website", "host", "host_key"))
    weights = web.sparkSession.sparkContext.broadcast(Weights(pois))  # BUCKETS numbers
    towns = stored(towns_of_cells(places))
    places = stored(_located(places, towns))

    # queries by position, at up to two of them, and some again as decoys beside where they are
    at = ["id", "key", "sorted_key", "host_key", "category", "terms", "host"]
    near = places.where("lat IS NOT NULL").select(*at, "lat", "lon").unionByName(places.where("turned_lat IS NOT NULL").select(*at, F.col("turned_lat").alias("lat"), F.col("turned_lon").alias("lon")))
    sampled = stored(places.where("lat IS NOT NULL").orderBy(F.xxhash64("id")).limit(CALIBRATION_ROWS).select(F.col("id").alias("place")))
    moved = near.join(sampled.withColumnRenamed("place", "id"), "id", "left_semi").withColumn("lat", F.col("lat") + F.when(F.col("lat") > 0, -DECOY_DEG).otherwise(DECOY_DEG))
    asked = near.withColumn("decoy", F.lit(False)).unionByName(moved.withColumn("decoy", F.lit(True)))
    asked = asked.withColumn("cell", F.explode(_cells_within(F.col("lat"), F.col("lon"), CELL_DEG, NEAR_M)))
    posted = pois.where("lat IS NOT NULL").withColumn("cell", _cell(F.col("lat"), F.col("lon"), CELL_DEG))
    found = stored(scored(retrieved(asked, posted, weights)))
    lift = stored(category_lift(found))
    by_position = decided(with_lift(found, lift), sampled, threshold, "near")

    # the others by town, some again as decoys in another town
    lost = places.where("lat IS NULL")
    asks = lost.select(*at, "town", F.explode(F.when(F.size("asks") > 0, F.col("asks")).otherwise(F.array(F.lit("")))).alias("ask"), (F.size("asks") == 0).alias("whole"))
    sampled = stored(lost.orderBy(F.xxhash64("id")).limit(CALIBRATION_ROWS).select(F.col("id").alias("place"), "town"))
    elsewhere = lost.join(sampled.withColumnRenamed("place", "id").drop("town"), "id", "left_semi").join(like_towns(pois, towns), "town").select(*at, "town", F.col("next").alias("ask"), F.lit(False).alias("whole"))
    none = F.lit(None).cast("double")
    asked = asks.withColumn("decoy", F.lit(False)).unionByName(elsewhere.withColumn("decoy", F.lit(True))).withColumns({"lat": none, "lon": none, "cell": F.xxhash64("ask")})
    wanted = stored(asks.select("ask").union(elsewhere.select("ask")).distinct())
    posted = pois.where("lat IS NOT NULL").withColumn("tcell", _cell(F.col("lat"), F.col("lon"), TOWN_DEG)).join(towns, "tcell").drop("tcell").withColumnRenamed("town", "ask")
    posted = posted.unionByName(pois.withColumn("ask", F.lit(""))).join(wanted, "ask", "left_semi").withColumn("cell", F.xxhash64("ask"))
    found = stored(with_lift(scored(retrieved(asked, posted, weights, FAR_FLOOR)), lift))
    by_town = decided(found, sampled.where("town IS NOT NULL").select("place"), threshold, "town")
    # decoys are put to one town, so of the index over all POIs only what has no rival elsewhere is taken
    everywhere = asks.where("whole").select(F.col("id").alias("place_id"), "whole").distinct()
    by_town = by_town.join(everywhere, "place_id", "left").where(F.col("whole").isNull() | (F.col("gap") >= WHOLE_GAP)).drop("whole")

    pairs = by_position.unionByName(by_town)
    pairs = pairs.join(all_places.withColumnsRenamed({"id": "own_place", "rep": "place_id"}), "place_id").drop("place_id").withColumnRenamed("own_place", "place_id")
    return pairs.join(all_pois.withColumnsRenamed({"id": "own_poi", "rep": "poi_id"}), "poi_id").drop("poi_id").withColumnRenamed("own_poi", "poi_id")


def _located(places: DataFrame, towns: DataFrame) -> DataFrame:
    """Places with the position to look at (lat, lon; null if it can't be trusted), a second one (turned_lat, turned_lon), and the towns to ask instead.

    A position is doubted if it is not in the record's city, or if records of several names have it to the last digit.
    One that is in the city once exchanged is exchanged; without a city it is looked for both ways.
    """
    own = towns.select(F.col("town").alias("t1"), F.col("tcell").alias("c1"))
    turned = towns.select(F.col("town").alias("t2"), F.col("tcell").alias("c2"))
    swapped_ok = usable_position(F.col("lon"), F.col("lat"))
    places = places.join(own, (F.col("town") == F.col("t1")) & (_cell(F.col("lat"), F.col("lon"), TOWN_DEG) == F.col("c1")), "left")
    places = places.join(turned, (F.col("town") == F.col("t2")) & (F.when(swapped_ok, _cell(F.col("lon"), F.col("lat"), TOWN_DEG)) == F.col("c2")), "left")
    crowd = places.where("lat IS NOT NULL").groupBy(F.col("lat").alias("y"), F.col("lon").alias("x")).agg(F.min("key").alias("k1"), F.max("key").alias("k2"), F.approx_count_distinct("key").alias("names")).where("k1 <> k2")
    crowd = crowd.where(F.col("names") >= SHARED_POSITION).select("y", "x", "names")
    places = places.join(crowd, (F.col("lat") == F.col("y")) & (F.col("lon") == F.col("x")), "left")
    trusted = F.col("lat").isNotNull() & F.col("names").isNull() & (F.col("city").isNull() | F.col("t1").isNotNull())
    lat = F.when(trusted, F.col("lat")).when(F.col("t2").isNotNull(), F.col("lon"))
    lon = F.when(trusted, F.col("lon")).when(F.col("t2").isNotNull(), F.col("lat"))
    both = trusted & F.col("city").isNull() & swapped_ok
    # a crowded position still tells the towns around
    around = towns.groupBy(F.col("tcell").alias("c3")).agg(F.array_sort(F.collect_set("town")).alias("around"))  # bounded by the towns of a cell
    places = places.join(around, _cell(F.col("lat"), F.col("lon"), TOWN_DEG) == F.col("c3"), "left")
    asks = F.when(F.col("town").isNotNull(), F.array("town")).otherwise(F.coalesce("around", F.array().cast("array<string>")))
    new = {"lat": lat, "lon": lon, "turned_lat": F.when(both, F.col("lon")), "turned_lon": F.when(both, F.col("lat")), "asks": F.when(lat.isNull(), asks)}
    return places.withColumns(new).drop("t1", "c1", "t2", "c2", "y", "x", "names", "c3", "around", "city", "said", "name", "website")
