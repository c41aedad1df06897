"""Benchmark decontamination by spaced-seed hashing.

A *mask* is a fixed pattern over ``SPAN`` token positions of which some are
ignored. Every window of a benchmark item and of a training document is hashed
under each mask over its kept positions only, so a window still meets its origin
when substituted tokens fall on ignored positions. Both sides' hashes are
*joined*, and a hit fixes an alignment (item, shift between the texts); the overlap
around it is verified token by token along that alignment: it is the longest stretch
that begins and ends with a match, holds at least ``MIN_MATCHED`` matching tokens
and, in every prefix and suffix, at least 3 of 5 of its tokens match.
A document is contaminated if a verified overlap covers ``MIN_COVER`` of the
item, or ``LONG_MATCH`` matching tokens of it. A further mask, one position shorter,
meets every run of ``MIN_MATCHED`` tokens. Items shorter than ``SPAN`` are met by one
contiguous window of their whole length; all their tokens must match anyway.

*Scale.* A filter of the benchmark's hashes, of at most 2^``FILTER_BITS`` bits
whatever the benchmark's size, drops nearly all windows of the documents on the map
side; a larger benchmark lets more pass, and the join decides. What passes is one
row for each distinct hash of a distinct text, with its places. Texts are told
apart by 128 bits, so copies are joined and verified once; only texts that hold a
hit are read again and shuffled, once. An alignment is verified once, whatever the
number of its hits, and all alignments of an item at a time.

Defined results: null, empty and word-less texts are clean, with no items;
repeated rows get equal rows; repeated benchmark rows are one item, ids that several
texts share count for each; an id that is null stays null and comes after the others;
benchmark items without words match nothing; an empty benchmark or table
contaminates nothing. Case of A-Z is ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pathloom.llm.common import batched, discard, materialise, mix, row_key, rows, sent, word_hashes, words

SPAN = 9
#: Kept positions of each mask. They ignore different positions, so substitutions that spoil one mask spare another.
MASKS = ((0, 1, 2, 4, 7, 8), (0, 1, 4, 5, 6, 8), (0, 2, 3, 5, 6, 8), (0, 1, 3, 4, 6, 8))
#: For runs of 8 tokens in items of ``SPAN`` and more, which no mask of that span need meet.
RUN_MASK = (0, 1, 3, 4, 6, 7)
MIN_MATCHED = 8
#: A match and a mismatch in a score that is worth nothing where 3 of 5 tokens match, the least share.
GAIN, LOSS = 2, 3
MIN_COVER = 0.5
LONG_MATCH = 13
#: The filter has 128 bits for each hash of the benchmark, up to 2^27 (16 MB).
FILTER_BITS = 27
CELLS = 4_000_000
DOCUMENTS = 200
_STEP = np.uint64(0x9E3779B97F4A7C15)

#: Kept positions and span of each seed.
Seed = tuple[tuple[int, ...], int]
LONG_SEEDS: tuple[Seed, ...] = (*((m, SPAN) for m in MASKS), (RUN_MASK, RUN_MASK[-1] + 1))


def spaced_hashes(tokens: np.ndarray, kept: tuple[int, ...], span: int) -> np.ndarray:
    """A hash for each window of ``span`` tokens, over the kept positions."""
    n = len(tokens) - span + 1
    if n <= 0:
        return tokens[:0]
    out, high = np.full(n, kept[0] * 31 + span * 1009 + len(kept), np.uint64), np.empty(n, np.uint64)
    for k in kept:
        out ^= np.right_shift(out, np.uint64(31), out=high)
        out *= _STEP
        out += tokens[k : k + n]
    return mix(out)


def seeds_of(n: int) -> tuple[Seed, ...]:
    """The seeds of an item of ``n`` tokens."""
    return LONG_SEEDS if n >= SPAN else ((tuple(range(n)), n),) if n else ()


def _hits(keys: pa.Array, owner: np.ndarray, hashes: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """(key, hash, at): the places of each distinct hash of an owner, a place in ``keys``."""
    order = np.lexsort((places, hashes, owner))
    owner, hashes = owner[order], hashes[order]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])))
    at = pa.ListArray.from_arrays(pa.array(np.append(first, len(order)), pa.int32()), pa.array(places[order], pa.int32()))
    return pa.RecordBatch.from_arrays([keys.take(pa.array(owner[first])), pa.array(hashes[first].view(np.int64)), at], ["key", "hash", "at"])


_HITS = "key binary, hash long, at array<int>"


def _item_hashes(items: DataFrame) -> DataFrame:
    """(key, hash, at) of benchmark items (key, text)."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, text in rows(batches, "key", "text"):
            tokens = word_hashes(words(text))
            own = [spaced_hashes(tokens, *seed) for seed in seeds_of(len(tokens))]
            if own:
                every = np.concatenate(own)
                yield _hits(pa.array([key], pa.binary()), np.zeros(len(every), np.int64), every, np.concatenate([np.arange(len(h)) for h in own]))

    return items.select("key", "text").mapInArrow(make, _HITS)


#: A hash has three places in the filter, its bits from these on.
_PROBES = (0, 20, 36)


def _passing(hashes: np.ndarray, held: np.ndarray, bits: int) -> np.ndarray:
    """The places of the hashes that pass a filter of 2^``bits``; what a probe drops is not probed again."""
    out = None
    for shift in _PROBES:
        own = hashes if out is None else hashes[out]
        p = (own >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        passed = np.flatnonzero((held[(p >> np.uint64(6)).view(np.int64)] >> (p & np.uint64(63))) & np.uint64(1))
        out = passed if out is None else out[passed]
    return out


def _filter(hashes: DataFrame, n: int) -> tuple[int, bytes]:
    """A filter of ``n`` hashes, as its size's exponent and 64-bit words; its words are set by a distributed aggregate."""
    bits = min(FILTER_BITS, max(16, math.ceil(math.log2(max(n, 1) * 128))))
    place = F.explode(F.array(*(F.shiftrightunsigned("hash", s).bitwiseAND((1 << bits) - 1) for s in _PROBES))).alias("p")
    words_ = hashes.select(place).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p & 63 AS INT))")).alias("v"))
    out = np.zeros(1 << (bits - 6), np.int64)
    table = words_.toArrow()
    out[table.column("w").to_numpy()] = table.column("v").to_numpy()
    return bits, out.tobytes()


def _document_hits(texts: DataFrame, sent_filter, bits: int, seeds: list[Seed]) -> DataFrame:
    """(key, hash, at) of the windows of texts (key, text) that pass the filter. ``DOCUMENTS`` texts are hashed as one
    sequence; windows over the end of a text are dropped. Hashes of different seeds differ, so places need no seed."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(sent_filter.value, np.uint64)
        for batch in batches:
            for row in range(0, batch.num_rows, DOCUMENTS):
                part = batch.slice(row, DOCUMENTS)
                found = [words(t) for t in part.column(1).to_pylist()]
                ends = np.cumsum([len(w) for w in found])
                tokens = word_hashes(list(chain.from_iterable(found)))
                out = []
                for kept, span in seeds:
                    own = spaced_hashes(tokens, kept, span)
                    at = _passing(own, held, bits)
                    owner = np.searchsorted(ends, at, "right")
                    inside = at + span <= ends[owner]
                    out.append((owner[inside], own[at[inside]], at[inside]))
                owner, hashes, at = map(np.concatenate, zip(*out))
                if len(at):
                    yield _hits(part.column(0), owner, hashes, at - np.append(0, ends)[owner])

    return texts.mapInArrow(make, _HITS)


def _shifts(n: int, m: int, pairs: list[dict]) -> np.ndarray:
    """The distinct alignments (place in the document less place in the item) of ``pairs`` of places."""
    marked = np.zeros(n + m + 1, bool)
    for pair in pairs:
        at = np.array(pair["at"], np.int64) + m
        for place in pair["places"]:
            marked[at - place] = True
    return np.flatnonzero(marked) - m


def _stretches(same: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, begin, end, matched) of the stretches in which matches outweigh mismatches throughout: maximal segments
    of a score that gains ``GAIN`` for a match and loses ``LOSS`` for a mismatch. All rows go on together, a column at a time."""
    rows_, columns = same.shape
    total, top, begin, end, count, matched = (np.zeros(rows_, np.int64) for _ in range(6))
    out: list[tuple[int, int, int, int]] = []

    def close(which: np.ndarray) -> None:
        out.extend(zip(which.tolist(), begin[which].tolist(), end[which].tolist(), matched[which].tolist()))

    for k in range(columns):
        hit = np.flatnonzero(same[:, k])
        fresh = hit[total[hit] == 0]
        begin[fresh], count[fresh], top[fresh] = k, 0, 0
        total[hit] += GAIN
        count[hit] += 1
        risen = hit[total[hit] >= top[hit]]
        top[risen], end[risen], matched[risen] = total[risen], k + 1, count[risen]
        miss = np.flatnonzero(~same[:, k] & (total > 0))
        total[miss] -= LOSS
        over = miss[total[miss] <= 0]
        close(over)
        total[over] = 0
    close(np.flatnonzero(total > 0))
    return out


def verified(tokens: np.ndarray, own: np.ndarray, shifts: np.ndarray) -> tuple[int, int, int] | None:
    """(matched tokens, begin, end) in the document of the best verified overlap with an item along ``shifts``."""
    n, m = len(tokens), len(own)
    best = None
    for at in range(0, len(shifts), max(1, CELLS // m)):
        some = shifts[at : at + max(1, CELLS // m)]
        places = some[:, None] + np.arange(m)[None, :]
        inside = (places >= 0) & (places < n)
        same = inside & (tokens[np.clip(places, 0, n - 1)] == own[None, :])
        enough = same.sum(axis=1) >= min(MIN_MATCHED, m)  # a stretch has no more matches than its alignment
        if enough.any():
            some, same = some[enough], same[enough]
            for row, begin, end, matched in _stretches(same):
                if matched >= min(MIN_MATCHED, m) and matched >= min(MIN_COVER * m, LONG_MATCH):
                    found = matched, int(some[row]) + begin, int(some[row]) + end
                    if best is None or (-found[0], found[1]) < (-best[0], best[1]):
                        best = found
    return best


def _overlaps(candidates: DataFrame) -> DataFrame:
    """(key, item_id, matched, begin, end) of the verified rows of (key, text, item_id, item_text, pairs)."""
    own = candidates.select("key", "text", "item_text", "pairs", "item_id")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tokens = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                keep, found = [], []
                for k, (key, text, item_text, pairs) in enumerate(zip(*(part.column(c).to_pylist() for c in range(4)))):
                    if key != last:
                        last, tokens = key, word_hashes(words(text))
                    item = word_hashes(words(item_text))
                    if overlap := verified(tokens, item, _shifts(len(tokens), len(item), pairs)):
                        keep.append(k)
                        found.append(overlap)
                some = part.take(pa.array(keep, pa.int64()))
                columns = zip(*found) if found else ((), (), ())
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(4), *(pa.array(c, pa.int64()) for c in columns)], ["key", "item_id", "matched", "begin", "end"])

    kind = own.schema["item_id"].dataType.simpleString()
    return own.mapInArrow(make, f"key binary, item_id {kind}, matched long, begin long, end long")


def contamination(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, contaminated, n_items, item_ids, best_item, matched, begin, end (in words)."""
    spark, held = docs.sparkSession, []
    mark = F.unhex(F.md5(text))
    items = benchmark.select(F.col("item_id"), F.col("text").cast("string").alias("text")).distinct().withColumn("key", row_key("item_id", "text"))
    items = materialise(items, "items", held)
    seeded = materialise(_item_hashes(items), "item-hashes", held)
    short = F.size(F.split(F.trim(F.regexp_replace("text", r"[\x09-\x0D ]+", " ")), " "))
    lengths = sorted(r[0] for r in items.where(F.length(F.trim(F.regexp_replace("text", r"[\x09-\x0D ]+", " "))) > 0).select(short.alias("n")).where(F.col("n") < SPAN).distinct().collect())
    seeds = [*LONG_SEEDS, *(s for n in lengths for s in seeds_of(n))]
    hashes = seeded.select("hash").distinct()
    bits, content = _filter(hashes, hashes.count())

    chosen = docs.select(F.col(id_column).alias("doc_id"), mark.alias("key"), F.col(text).cast("string").alias("text"))
    texts = chosen.where("key is not null").select("key", "text")
    hits = _document_hits(texts, spark.sparkContext.broadcast(content), bits, seeds).dropDuplicates(["key", "hash"])
    met = seeded.select("hash", F.col("key").alias("item"), F.col("at").alias("places"))
    pairs = hits.join(sent(met), "hash").groupBy("key", "item").agg(F.collect_list(F.struct("at", "places")).alias("pairs"))
    pairs = materialise(pairs, "pairs", held)

    # Texts that hold a hit are read again, one of each kind; items are joined to their pairs.
    wanted = pairs.select(F.col("key").alias("k")).distinct()
    again = texts.join(sent(wanted), F.col("key") == F.col("k"), "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    named = pairs.join(sent(items.select(F.col("key").alias("item"), "item_id", F.col("text").alias("item_text"))), "item")
    overlaps = materialise(_overlaps(named.join(again, "key")), "overlaps", held)

    order = F.struct(-F.col("matched"), F.col("item_id").isNull(), "item_id", "begin", "end")
    verdicts = overlaps.groupBy("key").agg(
        F.count("*").alias("n_items"), F.collect_list("item_id").alias("ids"), F.count_if(F.col("item_id").isNull()).alias("nulls"), F.min(order).alias("best")
    )
    kind = items.schema["item_id"].dataType.simpleString()
    ids = F.concat(F.array_sort("ids"), F.array_repeat(F.lit(None).cast(kind), F.col("nulls").cast("int")))
    verdicts = materialise(verdicts.select(F.col("key").alias("k"), "n_items", ids.alias("item_ids"), "best"), "verdicts")
    discard(spark, held)
    out = chosen.select("doc_id", "key").join(sent(verdicts), F.col("key") == F.col("k"), "left")
    return out.select(
        "doc_id", F.col("k").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast(f"array<{kind}>")).alias("item_ids"), F.col("best.item_id").alias("best_item"),
        F.coalesce(-F.col("best.col1"), F.lit(0)).cast("long").alias("matched"), F.col("best.begin").alias("begin"), F.col("best.end").alias("end"),
    )
