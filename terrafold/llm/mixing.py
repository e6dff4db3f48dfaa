"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells source x language x topic are raked to the target shares of the sources and to the marginals
of language and topic, under each source's cap on repeats; then records are drawn by their calibrated weights: the whole
part of a weight is so many certain uses, the rest a probability, drawn systematically so that totals come out close.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.llm.encode import LEAF, TOKENIZERS, encoder
from terrafold.session import stored

#: Most sources with a target; the cells of the raking, which the driver holds, are at most this x 677 languages x topics.
MAX_TARGETS = 10_000
#: Topic words of each language.
TOPICS = 8
#: Counters of a sketch of a language's words, and candidates for its topic words.
SKETCH, CANDIDATES = 2_000, 64
#: Records of a source that are drawn from together.
STRATUM = 10_000
ROUNDS = 200

# Other codes of languages, to two letters.
LANGUAGES = {
    "eng": "en", "ger": "de", "deu": "de", "fra": "fr", "fre": "fr", "spa": "es", "rus": "ru", "jpn": "ja", "jp": "ja", "tur": "tr", "ita": "it", "por": "pt", "nld": "nl", "dut": "nl",
    "zho": "zh", "chi": "zh", "ara": "ar", "kor": "ko", "pol": "pl", "ukr": "uk", "swe": "sv", "dan": "da", "nor": "no", "fin": "fi", "ell": "el", "gre": "el", "heb": "he", "hin": "hi",
}


def source_name(source: Column) -> Column:
    """Spellings that differ in case or padding only are one source; null if nothing is left."""
    return F.nullif(F.lower(F.trim(source)), F.lit(""))


def language_code(lang: Column) -> Column:
    """Two-letter code; ``und`` for null and what is no code."""
    base = F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    named = F.try_element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), base)
    return F.coalesce(named, F.when(F.length(base) == 2, base), F.lit("und"))


_RUN, _IDEOGRAPHS = re.compile(r"[^\W\d_]+"), re.compile(r"[\u3041-\u30ff\u3400-\u9fff]")


def topic_words(text: str | None) -> set[str]:
    """Words of a text that may name a topic: of six letters or more; in scripts without spaces, every two characters."""
    out: set[str] = set()
    for run in _RUN.findall((text or "").lower()):
        if _IDEOGRAPHS.search(run):
            out.update(run[i : i + 2] for i in range(len(run) - 1))
        elif len(run) >= 6:
            out.add(run)
    return out


def pruned(counts: dict[str, int], most: int) -> dict[str, int]:
    """A sketch of at most ``most`` counters: all are lowered by the greatest that has to go, so none is off by more than n / most."""
    if len(counts) <= most:
        return counts
    least = sorted(counts.values(), reverse=True)[most]
    return {w: n - least for w, n in counts.items() if n > least}


def frequent_words(rows: DataFrame, candidates: int = CANDIDATES, sketch: int = SKETCH) -> DataFrame:
    """(lang, word): of each language the words that most of the records (lang, text) hold, by mergeable sketches of bounded size.

    A task sends at most ``sketch`` counters a language; every word that more than a share 1 / sketch of the records
    hold is among them. Counts here are near enough to choose candidates by, and are counted exactly afterwards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {}
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts = held.setdefault(lang, {})
                for w in topic_words(text):
                    counts[w] = counts.get(w, 0) + 1
                if len(counts) > 8 * sketch:
                    held[lang] = pruned(counts, sketch)
        for lang, counts in held.items():
            some = pruned(counts, sketch)
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some)), pa.array(list(some)), pa.array(list(some.values()), pa.int64())], ["lang", "word", "n"])

    n = rows.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return n.withColumn("r", rank).where(F.col("r") <= candidates).select("lang", "word")


def sized_records(docs: DataFrame, targets: DataFrame, tokenizers: str = TOKENIZERS, topics: int = TOPICS, leaf: int = LEAF) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens) of the records whose source has a target and whose text has tokens.

    The topic is the rarest topic word that a text holds; a language's topic words are its ``topics`` most frequent words
    (see ``topic_words``) that stand in at most 3 of 10 of its records. Texts without one have the topic ``-``. If ``docs``
    has a column topic, that is taken instead, null as ``-``.
    """
    wanted = targets.select(source_name(F.col("source")).alias("source")).where("source IS NOT NULL").distinct()
    given = "topic" in docs.columns
    told = F.coalesce(F.col("topic").cast("string"), F.lit("-")) if given else F.lit("-")
    rows = docs.select("doc_id", source_name(F.col("source")).alias("source"), language_code(F.col("lang")).alias("lang"), told.alias("topic"), "text").join(wanted, "source", "left_semi")
    # at most CANDIDATES words for each of 677 languages
    known: dict[str, set[str]] = {}
    for r in [] if given else frequent_words(rows).collect():
        known.setdefault(r.lang, set()).add(r.word)
    path = os.path.join(tokenizers, "byte_bpe_50k.tiktoken")
    ids = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            sizes = pa.array([len(enc.encode(t or "", leaf)) for t in texts], pa.int64())
            held = [sorted(topic_words(t) & known[lang]) if lang in known else [] for t, lang in zip(texts, b.column("lang").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "source", "lang", "topic")), sizes, pa.array(held, pa.list_(pa.string()))], ["doc_id", "source", "lang", "topic", "n_tokens", "held"])

    # read for the counts of words, for the cells and for the draw
    sized = stored(rows.select("doc_id", "source", "lang", "topic", "text").mapInArrow(run, f"{ids}, source string, lang string, topic string, n_tokens long, held array<string>").where("n_tokens > 0"))
    if given:
        return sized.drop("held")
    n_docs = sized.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    df = sized.select("lang", F.explode("held").alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("df")).join(n_docs, "lang").where("df <= 0.3 * n")
    df = df.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("df"), "word"))).where(F.col("r") <= topics)
    of_lang = stored(df.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("word", "df"))).alias("df")))  # ``topics`` words a language
    rarest = F.array_min(F.transform(F.filter("held", lambda w: F.map_contains_key("df", w)), lambda w: F.struct(F.try_element_at("df", w).alias("df"), w.alias("word"))))["word"]
    return sized.join(F.broadcast(of_lang), "lang", "left").select("doc_id", "source", "lang", F.coalesce(rarest, F.lit("-")).alias("topic"), "n_tokens")


@dataclass
class Plan:
    """Raked weights: expected uses of each record of a cell."""

    weights: dict[tuple[str, str, str], float]
    total: float


def _scaled(w: np.ndarray, tokens: np.ndarray, cap: np.ndarray, group: np.ndarray, goals: np.ndarray) -> np.ndarray:
    """w times a factor for each group, cut off at the caps, so that its tokens come to its goal, or all at the cap."""
    n = len(goals)

    def reached(factor: np.ndarray) -> np.ndarray:
        return np.bincount(group, np.minimum(cap, w * factor[group]) * tokens, n)

    full = np.bincount(group, cap * tokens, n) <= goals
    low, high = np.zeros(n), np.ones(n)
    while (short := ~full & (reached(high) < goals)).any():
        high[short] *= 2
    for _ in range(60):
        middle = (low + high) / 2
        less = reached(middle) < goals
        low, high = np.where(less, middle, low), np.where(less, high, middle)
    return np.where(full[group], cap, np.minimum(cap, w * high[group]))


def rake(cells: list[tuple[str, str, str, float]], shares: dict[str, float], caps: dict[str, int], marginals: dict[int, dict[str, float]] | None = None, rounds: int = ROUNDS) -> Plan:
    """Weights of cells (source, language, topic, tokens) by iterative proportional fitting.

    The total is the largest at which every source that has both a target and records can hold its share within its
    cap, shares being taken relative to these sources. Marginals of language (1) and topic (2) default to the pool's
    own; where they and the caps can't all hold, the source's share wins, being fitted last.
    """
    here = {c[0] for c in cells}
    shares = {s: x for s, x in shares.items() if x and x > 0 and s in here and caps.get(s, 0) > 0}
    cells = [c for c in cells if c[0] in shares and c[3] > 0]
    if not cells:
        return Plan({}, 0.0)
    scale = sum(shares.values())
    tokens = np.array([c[3] for c in cells], float)
    cap = np.array([caps[c[0]] for c in cells], float)
    values, codes = zip(*(np.unique(np.array([c[k] for c in cells], object), return_inverse=True) for k in range(3)), strict=True)
    share = np.array([shares[v] for v in values[0]]) / scale
    total = (np.bincount(codes[0], cap * tokens) / share).min()
    goals = [total * share]
    for k in (1, 2):
        told = (marginals or {}).get(k)
        parts = np.array([told.get(v, 0.0) for v in values[k]]) if told else np.bincount(codes[k], tokens)
        goals.append(total * parts / (parts.sum() or 1.0))
    w = np.ones(len(cells))
    for _ in range(rounds):
        before = w.copy()
        for k in (1, 2, 0):
            w = _scaled(np.maximum(w, 1e-12), tokens, cap, codes[k], goals[k])
        if np.abs(w - before).max() < 1e-9:
            break
    return Plan({c[:3]: float(x) for c, x in zip(cells, w, strict=True)}, float(total))


def mixture(docs: DataFrame, targets: DataFrame, tokenizers: str = TOKENIZERS, marginals: dict[int, dict[str, float]] | None = None, stratum: int = STRATUM) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, repeats): the chosen records and how often each is used, at most max_repeats.

    Records without a targeted source or without tokens are not chosen. Within strata of a source (by hash, so that no
    source has to be in one task) records go by size and are drawn systematically. Empty inputs give no rows.
    """
    told = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats").where("source IS NOT NULL")
    told = told.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    config = told.limit(MAX_TARGETS + 1).collect()
    if len(config) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} sources with a target")
    sized = sized_records(docs, targets, tokenizers)
    cells = sized.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n")).collect()  # bounded, see MAX_TARGETS
    plan = rake([(c.source, c.lang, c.topic, float(c.tokens)) for c in cells], {r.source: r.target_share for r in config}, {r.source: int(r.max_repeats or 0) for r in config}, marginals)
    spark = docs.sparkSession
    weights = spark.createDataFrame([(*k, v) for k, v in plan.weights.items()], "source string, lang string, topic string, weight double")
    strata: dict[str, int] = {}
    for c in cells:
        strata[c.source] = strata.get(c.source, 0) + c.n
    parts = spark.createDataFrame([(s, -(-n // stratum)) for s, n in strata.items()], "source string, parts int")
    order = F.xxhash64("doc_id", F.lit(7))
    drawn = sized.join(F.broadcast(weights), ["source", "lang", "topic"]).join(F.broadcast(parts), "source")  # both bounded by the cells
    drawn = drawn.withColumns({"stratum": F.pmod(order, F.col("parts")), "whole": F.floor(F.col("weight") + 1e-9), "order": order})
    part = F.greatest(F.lit(0.0), F.col("weight") - F.col("whole"))
    up_to = F.sum(part).over(Window.partitionBy("source", "stratum").orderBy("n_tokens", "order").rowsBetween(Window.unboundedPreceding, 0))
    start = F.pmod(F.xxhash64("source", "stratum"), F.lit(1 << 20)) / (1 << 20)
    drawn = drawn.withColumns({"part": part, "upto": up_to + start})
    extra = (F.floor("upto") > F.floor(F.col("upto") - F.col("part"))).cast("int")
    return drawn.select("doc_id", "source", "lang", "topic", "n_tokens", (F.col("whole") + extra).cast("int").alias("repeats")).where("repeats > 0")


def reached_shares(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, n_records, n_tokens, most_repeats) for every targeted source, absent ones with 0."""
    told = targets.select(source_name(F.col("source")).alias("source"), "target_share").where("source IS NOT NULL").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    by = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("n_tokens"), F.max("repeats").alias("most_repeats"))
    rows = told.join(by, "source", "left").na.fill(0, ["n_records", "n_tokens", "most_repeats"])
    whole = F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))  # one row a target
    return rows.select("source", "target_share", F.round(F.coalesce(F.try_divide(F.col("n_tokens"), whole), F.lit(0.0)), 6).alias("reached_share"), "n_records", "n_tokens", "most_repeats")
