"""Language-model scores by deleted interpolation of word n-grams.

P(w | v) mixes three maximum-likelihood estimates, c(v, w) / c(v), c(w) / N and
the uniform 1 / (V + 1), with weights that depend on a bucket of the context's
frequency c(v): one bucket per power of two. The weights of each bucket are
learned by expectation-maximisation on held-out counts: the training documents
are split again, one part gives counts, the other is predicted. Final scores use
the counts of all training documents with these weights. A context that never
occurred has no bigram estimate, so its weight goes to the other two; the
uniform part keeps every probability above zero.

Counts are exchanged in compact form, so no row per token ever exists:

1. A map task gathers the documents of each role (counting, tuning, held out) in
   *chunks* of about ``CHUNK`` tokens and cuts a chunk's distinct n-grams and their
   counts, already summed over the chunk, by ranges of hash values: a blob for each.
2. A range is added up in one task and answered with one blob of totals for each blob
   that asked. Ranges are as many as the texts' bytes ask for, so that each holds the
   n-grams of about ``RANGE_BYTES`` of text, however the input is cut into files; a hot
   n-gram is one entry per chunk, wherever it occurs how often. No chunk is cut into
   more than ``FAN`` ranges: with more ranges than that, groups of chunks first add up
   wider ranges (``Exchange``), cut these again, and hand the answers back, so blobs are
   at most ``FAN`` for each chunk and level, and levels grow with the logarithm of the input.
   Totals are 64-bit counts, sent as 32-bit ones where they fit.
3. The documents are read again into the same chunks, by name; a chunk's answers
   and its token stream meet, and its documents are scored. A chunk whose content
   differs from the first reading has another name, and is refused.

EM needs, for each held-out token, only the ratios of its three estimates; the
answering pass adds tokens up on a fine logarithmic grid of ratios by bucket, a
table of bounded size that holds every held-out token, and EM runs on that.

Defined results: null and empty texts are the end token alone; ids that are null
or repeated are scored row by row; an empty table gives no rows, and with no
training documents every estimate is uniform. Words are told apart by 64-bit,
bigrams by 48-bit hashes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_128

from pathloom.llm.common import materialise, mix, rows, word_hashes, words

CHUNK = 1_000_000
RANGE_BYTES = 16_000_000
#: Into how many ranges a chunk or a node of the exchange is cut at most, and how many tasks a level has at most.
FAN = 4096
TASKS = 32_768
FOLDS = 5
HELD_OUT = 1
#: Of the training folds, the one that is predicted when weights are learned.
TUNING = 4
CONTEXTS = 40
#: The grid of ratios: steps of their base-2 logarithm, from 2^-16 to 2^48.
STEP = 0.25
GRID = 256
ZERO = 64
ROUNDS = 60
NULL_ID = np.iinfo(np.int64).min
END = np.uint64(0x9D39247E33776D41)
START = np.uint64(0x2AF7398005AAA5C7)
_SALT = np.uint64(0x44DB015024623547)


def fold(doc_id: int | None) -> int:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def _bigrams(tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
    return mix(mix(before ^ _SALT) + tokens) >> np.uint64(16)


def _pack(a: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(a).tobytes(), 1)


def _pack_counts(a: np.ndarray) -> bytes:
    return _pack(a.astype("<u4")) + b"\x04" if not len(a) or a.max() < 1 << 32 else _pack(a.astype("<u8")) + b"\x08"


def _unpack_counts(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[:-1]), f"<u{data[-1]}").astype(np.uint64)


def _join(parts: list[bytes]) -> bytes:
    return np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)


def _split(data: bytes) -> list[bytes]:
    n = int(np.frombuffer(data[:8], "<i8")[0])
    cuts = 8 * (n + 1) + np.concatenate([[0], np.cumsum(np.frombuffer(data[8 : 8 * (n + 1)], "<i8"))])
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def _steps(keys: np.ndarray) -> bytes:
    """Sorted 48-bit keys as their steps: four bytes each, and the few greater ones apart."""
    step = np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys
    high = np.flatnonzero(step >> np.uint64(32))
    return _join([step.astype("<u4").tobytes(), high.astype("<u4").tobytes(), (step[high] >> np.uint64(32)).astype("<u4").tobytes()])


def _unsteps(data: bytes) -> np.ndarray:
    low, high, more = (np.frombuffer(x, "<u4") for x in _split(data))
    step = low.astype(np.uint64)
    step[high] |= more.astype(np.uint64) << np.uint64(32)
    return np.cumsum(step, dtype=np.uint64)


@dataclass
class Chunk:
    """The token stream of some documents: tokens as places in ``vocabulary`` (sorted hashes)."""

    ids: np.ndarray
    lengths: np.ndarray
    vocabulary: np.ndarray
    places: np.ndarray

    @classmethod
    def of(cls, ids: list[int], streams: list[np.ndarray]) -> "Chunk":
        vocabulary, places = np.unique(np.concatenate(streams), return_inverse=True)
        return cls(np.array(ids, np.int64), np.array([len(s) for s in streams], np.int64), vocabulary, places.astype(np.uint32))

    def starts(self) -> np.ndarray:
        return np.cumsum(self.lengths) - self.lengths

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct bigrams, sorted; of each token, the place of its bigram; and of its context in the vocabulary
        followed by the start."""
        context = np.empty(len(self.places), np.uint32)
        context[1:] = self.places[:-1]
        context[self.starts()] = len(self.vocabulary)
        hashes = np.append(self.vocabulary, START)
        pairs, which = np.unique(_bigrams(self.vocabulary[self.places], hashes[context]), return_inverse=True)
        return pairs, which, context

    def dump(self) -> bytes:
        planes = np.ascontiguousarray(self.places.view(np.uint8).reshape(-1, 4).T)
        return _join([_pack(self.ids), _pack(self.lengths.astype(np.uint32)), self.vocabulary.tobytes(), *map(_pack, planes)])

    @classmethod
    def load(cls, data: bytes) -> "Chunk":
        ids, lengths, vocabulary, *planes = _split(data)
        places = np.stack([np.frombuffer(zlib.decompress(p), np.uint8) for p in planes], 1)
        return cls(np.frombuffer(zlib.decompress(ids), np.int64), np.frombuffer(zlib.decompress(lengths), np.uint32).astype(np.int64), np.frombuffer(vocabulary, np.uint64), places.view(np.uint32).reshape(-1))


@dataclass
class Counts:
    """Distinct bigrams and words of some documents (sorted hashes), with their counts in the counting and in the tuning
    part (a row each), and how many documents of either part there are. Held-out documents only name theirs."""

    pairs: np.ndarray
    pair_n: np.ndarray
    words: np.ndarray
    word_n: np.ndarray
    starts: tuple[int, int]

    @classmethod
    def of(cls, chunk: Chunk, role: str) -> "Counts":
        pairs, which, _ = chunk.bigrams()
        pair_n, word_n = np.zeros((2, len(pairs)), np.uint64), np.zeros((2, len(chunk.vocabulary)), np.uint64)
        own = (role == "counting", role == "tuning")
        for row in np.flatnonzero(own):
            pair_n[row], word_n[row] = np.bincount(which, minlength=len(pairs)), np.bincount(chunk.places, minlength=len(chunk.vocabulary))
        return cls(pairs, pair_n, chunk.vocabulary, word_n, tuple(len(chunk.ids) * x for x in own))

    @classmethod
    def merged(cls, parts: list["Counts"]) -> tuple["Counts", list[tuple[np.ndarray, np.ndarray]]]:
        """The sum of the parts, and where each part's bigrams and words are in it."""
        pairs, pair_n, pair_at = _sums([p.pairs for p in parts], [p.pair_n for p in parts])
        words_, word_n, word_at = _sums([p.words for p in parts], [p.word_n for p in parts])
        return cls(pairs, pair_n, words_, word_n, tuple(map(sum, zip(*(p.starts for p in parts))))), list(zip(pair_at, word_at))

    def cut(self, first: int, parts: int, ranges: int) -> Iterator["Counts"]:
        """``parts`` ranges from number ``first`` on, of ``ranges`` that all hash values have; documents go with the first."""
        by_pair, by_word = (_cuts(keys, first, parts, ranges, bits) for keys, bits in ((self.pairs, 48), (self.words, 64)))
        for k in range(parts):
            p, w = slice(*by_pair[k : k + 2]), slice(*by_word[k : k + 2])
            yield Counts(self.pairs[p], self.pair_n[:, p], self.words[w], self.word_n[:, w], (0, 0) if k else self.starts)

    def dump(self) -> bytes:
        rows_ = [_pack_counts(row) if row.any() else b"" for n in (self.pair_n, self.word_n) for row in n]
        return _join([_steps(self.pairs), self.words.tobytes(), *rows_, " ".join(map(str, self.starts)).encode()])

    @classmethod
    def load(cls, data: bytes) -> "Counts":
        pairs, words_, *rows_, starts = _split(data)
        pairs, words_ = _unsteps(pairs), np.frombuffer(words_, np.uint64)
        loaded = [_unpack_counts(row) if row else np.zeros(len(keys), np.uint64) for row, keys in zip(rows_, (pairs, pairs, words_, words_))]
        return cls(pairs, np.stack(loaded[:2]), words_, np.stack(loaded[2:]), tuple(map(int, starts.split())))


def _cuts(keys: np.ndarray, first: int, parts: int, ranges: int, bits: int) -> list[int]:
    """Where each of the ranges begins, and the last one ends, in the sorted ``keys``, which all lie in them."""
    edges = [(k << bits) // ranges for k in range(first + 1, first + parts)]
    return [0, *np.searchsorted(keys, np.array(edges, np.uint64)).tolist(), len(keys)]


def _sums(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """All keys, their total counts, and the places of each part's keys in them."""
    every, which = np.unique(np.concatenate(keys), return_inverse=True)
    places = np.split(which, np.cumsum([len(k) for k in keys])[:-1])
    totals = np.zeros((2, len(every)), np.uint64)
    for at, c in zip(places, counts):
        totals[:, at] += c  # a part names each key once
    return every, totals, places


@dataclass
class Exchange:
    """How counts travel to the ranges of hash values: ``levels`` steps, each to one of ``fan`` parts of a range.

    A node of level k adds up one of ``fan ** k`` ranges for one of ``fan ** (levels - k)`` groups of chunks; it is cut
    into ``fan`` ranges again, for the ``fan`` times wider group. The last level has one group, of all chunks.
    """

    fan: int
    levels: int

    @classmethod
    def of(cls, ranges: int) -> "Exchange":
        levels = 1
        while FAN**levels < ranges:
            levels += 1
        fan = max(1, int(ranges ** (1 / levels)) - 1)
        while fan**levels < ranges:
            fan += 1
        return cls(fan, levels)

    def node(self, level: int, group: int, at: int) -> int:
        return group * self.fan**level + at

    def requests(self, counts: Counts, level: int, group: int, at: int) -> Iterator[tuple[int, int, bytes]]:
        """(node of ``level``, slot, blob) for each part of range ``at`` of the level before."""
        first = at * self.fan
        for slot, part in enumerate(counts.cut(first, self.fan, self.fan**level)):
            yield self.node(level, group, first + slot), slot, part.dump()

    def by_node(self, df: DataFrame):
        return df.repartitionById(min(self.fan**self.levels, TASKS), "node").groupBy("node")


def role_of(doc_id: int | None) -> str:
    own = fold(doc_id)
    return "held" if own == HELD_OUT else "tuning" if own == TUNING else "counting"


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, str, Chunk]]:
    """(name, role, chunk) of a task's documents; the name is a fingerprint of the content."""
    held: dict[str, tuple[list[int], list[np.ndarray]]] = {}
    size = {"held": 0, "tuning": 0, "counting": 0}

    def close(role: str) -> tuple[str, str, Chunk]:
        chunk = Chunk.of(*held.pop(role))
        size[role] = 0
        mark = xxh3_128(chunk.ids.tobytes())
        for part in (chunk.lengths, chunk.vocabulary, chunk.places):
            mark.update(part.tobytes())
        return mark.hexdigest(), role, chunk

    for doc_id, text in rows(batches, "doc_id", "text"):
        role = role_of(doc_id)
        ids, streams = held.setdefault(role, ([], []))
        ids.append(NULL_ID if doc_id is None else doc_id)
        streams.append(np.append(word_hashes(words(text)), END))
        size[role] += len(streams[-1])
        if size[role] >= CHUNK:
            yield close(role)
    for role in sorted(held):
        yield close(role)


def _one_row(values: tuple, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)


def _requests(docs: DataFrame, exchange: Exchange) -> DataFrame:
    """(node, slot, asker, role, blob): what each chunk asks of the nodes of the first level."""
    schema = pa.schema([("node", pa.int32()), ("slot", pa.int32()), ("asker", pa.string()), ("role", pa.string()), ("blob", pa.binary())])
    groups = exchange.fan ** (exchange.levels - 1)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, role, chunk in _chunks(batches):
            for node, slot, blob in exchange.requests(Counts.of(chunk, role), 1, int(name, 16) % groups, 0):
                yield _one_row((node, slot, name, role, blob), schema)

    return docs.mapInArrow(make, _ASKED)


_ASKED = "node int, slot int, asker string, role string, blob binary"


def _ask_on(exchange: Exchange, level: int):
    """The sum of a node of ``level``, cut for the nodes of the next one."""

    def ask(part: pd.DataFrame) -> pd.DataFrame:
        node = int(part["node"].iloc[0])
        group, at = divmod(node, exchange.fan**level)
        counts, _ = Counts.merged([Counts.load(b) for b in part["blob"]])
        asked = exchange.requests(counts, level + 1, group // exchange.fan, at)
        return pd.DataFrame([(to, slot, str(node), "", blob) for to, slot, blob in asked], columns=["node", "slot", "asker", "role", "blob"])

    return ask


def _answers(part: pd.DataFrame, places: list[tuple[np.ndarray, np.ndarray]], pairs: np.ndarray, singles: np.ndarray) -> pd.DataFrame:
    """One answer for each request: its share of the totals over the counting part and over all training documents."""
    blobs = [_join([_pack_counts(t[row, at]) for t, at in ((pairs, p), (singles, w)) for row in (0, 1)]) for p, w in places]
    return part[["asker", "slot", "role"]].assign(blob=blobs)


def _add_up(part: pd.DataFrame) -> pd.DataFrame:
    """Totals of one range of hash values, one answer per request, and the range's part of N, V and the starts."""
    total, places = Counts.merged([Counts.load(b) for b in part["blob"]])
    pairs, singles = (np.stack([n[0], n[0] + n[1]]) for n in (total.pair_n, total.word_n))
    out = _answers(part, places, pairs, singles).assign(n=0, v=0, n_counting=0, starts=0, starts_counting=0)
    own = int(singles[1].sum(dtype=np.int64)), int((singles[1] > 0).sum()), int(singles[0].sum(dtype=np.int64)), sum(total.starts), total.starts[0]
    out.iloc[0, out.columns.get_indexer(["n", "v", "n_counting", "starts", "starts_counting"])] = own
    return out


def _hand_down(part: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """The answers to a node, whose requests were ``part``, as answers to those that asked it."""
    total, places = Counts.merged([Counts.load(b) for b in part["blob"]])
    parts = [_split(b) for b in answers.sort_values("slot")["blob"]]
    pairs, singles = (np.stack([np.concatenate([_unpack_counts(a[k + row]) for a in parts]) for row in (0, 1)]) for k in (0, 2))
    if pairs.shape[1] != len(total.pairs) or singles.shape[1] != len(total.words):
        raise RuntimeError("the answers to a node are not complete")
    return _answers(part, places, pairs, singles)


def _streams(docs: DataFrame, role: str | None = None) -> DataFrame:
    """(asker, slot -1, blob) of the token streams, of one role or of all."""
    schema = pa.schema([("asker", pa.string()), ("slot", pa.int32()), ("blob", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, own, chunk in _chunks(batches):
            if role in (None, own):
                yield _one_row((name, -1, chunk.dump()), schema)

    return docs.mapInArrow(make, "asker string, slot int, blob binary")


def _answered(part: pd.DataFrame, row: int, starts: int) -> tuple[int, Chunk, np.ndarray, np.ndarray, np.ndarray]:
    """How often a chunk occurs (once, but for copies of whole chunks), the chunk, and for each token the counts of
    its bigram, its context and itself, from the totals' ``row``."""
    times = part["slot"].value_counts()
    part = part.drop_duplicates("slot").sort_values("slot")
    blobs = part["blob"].tolist()
    if part["slot"].iloc[0] != -1 or times.nunique() != 1:
        raise RuntimeError("a chunk was not read the same way twice")
    chunk = Chunk.load(blobs[0])
    answers = [_split(b) for b in blobs[1:]]
    total = lambda k: np.concatenate([_unpack_counts(a[2 * k + row]) for a in answers])
    pairs, which, context = chunk.bigrams()
    pair_n, word_n = total(0), total(1)
    if len(pair_n) != len(pairs) or len(word_n) != len(chunk.vocabulary):
        raise RuntimeError("the answers to a chunk are not complete")
    return int(times.iloc[0]), chunk, pair_n[which].astype(float), np.append(word_n, np.uint64(starts))[context].astype(float), word_n[chunk.places].astype(float)


def context_bucket(c: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else 1 + log2 of its count."""
    return np.where(c > 0, np.minimum(1 + np.log2(np.maximum(c, 1)).astype(np.int64), CONTEXTS - 1), 0)


def _tuning_table(n: int, v: int, starts: int):
    """Per chunk: how many tuning tokens fall on each (context bucket, cell of the ratio grid)."""

    def count(part: pd.DataFrame) -> pd.DataFrame:
        times, _, c12, c1, c2 = _answered(part, 0, starts)
        pair = np.where(c1 > 0, c12 / np.maximum(c1, 1), 0) * (v + 1)
        single = c2 / max(n, 1) * (v + 1)
        cells, k = np.unique(context_bucket(c1) * GRID * GRID + _cell(pair) * GRID + _cell(single), return_counts=True)
        return pd.DataFrame({"cell": cells.astype(np.int64), "k": k.astype(np.int64) * times})

    return count


def _cell(ratio: np.ndarray) -> np.ndarray:
    """Cell 0 for a ratio of nothing; others by steps of the ratio's logarithm."""
    with np.errstate(divide="ignore"):
        log = np.log2(ratio)
    return np.where(ratio > 0, np.clip(np.round(log / STEP) + ZERO, 1, GRID - 1), 0).astype(np.int64)


def _ratio(cell: np.ndarray) -> np.ndarray:
    return np.where(cell > 0, 2.0 ** ((cell - ZERO) * STEP), 0.0)


def learn_weights(table: pd.DataFrame) -> np.ndarray:
    """Weights (bigram, unigram, uniform) of each context bucket by EM on the table of held-out tokens.

    A bucket without held-out tokens takes the weights of the nearest lower one that has some.
    """
    weights = np.tile([0.0, 0.9, 0.1], (CONTEXTS, 1))
    context, cell = np.divmod(table["cell"].to_numpy(np.int64), GRID * GRID)
    pair, single = np.divmod(cell, GRID)
    k = table["k"].to_numpy(float)
    known = weights[0]
    for b in range(CONTEXTS):
        own = context == b
        if k[own].sum() >= 1:
            likelihood = np.stack([_ratio(pair[own]), _ratio(single[own]), np.ones(own.sum())], 1)
            if b == 0:
                likelihood[:, 0] = 0
            w = np.array([0.4 if b else 0.0, 0.5, 0.1 if b else 0.5])
            for _ in range(ROUNDS):
                share = likelihood * w
                share /= share.sum(axis=1, keepdims=True)
                w = (share * k[own][:, None]).sum(axis=0) / k[own].sum()
            # Never all on estimates that can be nothing.
            w = np.maximum(w, [0.0, 0.0, 1e-6])
            known = w / w.sum()
        weights[b] = known
    return weights


def _scores(n: int, v: int, starts: int, weights: np.ndarray):
    def score(part: pd.DataFrame) -> pd.DataFrame:
        times, chunk, c12, c1, c2 = _answered(part, 1, starts)
        bucket = context_bucket(c1)
        p = weights[:, 0][bucket] * np.where(c1 > 0, c12 / np.maximum(c1, 1), 0)
        p += weights[:, 1][bucket] * (c2 / max(n, 1))
        p += weights[:, 2][bucket] / (v + 1)
        base = np.log10((c2 + 0.5) / (n + 0.5 * (v + 1)))
        add = lambda x: np.add.reduceat(x, chunk.starts())  # noqa: E731  every document has its end token
        null = chunk.ids == NULL_ID
        out = pd.DataFrame(
            {
                "doc_id": pd.Series(chunk.ids).astype("Int64").mask(null),
                "held_out": [fold(None if x else i) == HELD_OUT for i, x in zip(chunk.ids.tolist(), null)],
                "n_tokens": chunk.lengths,
                "n_known": add((c2 > 0).astype(np.int64)),
                "train_tokens": n,
                "base_score": add(base),
                "score": add(np.log10(p)),
            }
        )
        return pd.concat([out] * times) if times > 1 else out

    return score


def score(docs: DataFrame, id_column: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    if buckets is None:
        size = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        buckets = max(8, -(-size // RANGE_BYTES))
    exchange = Exchange.of(buckets)
    asked = [_requests(chosen, exchange)]
    for level in range(1, exchange.levels):
        asked[-1] = materialise(asked[-1], "asked")
        asked.append(exchange.by_node(asked[-1]).applyInPandas(_ask_on(exchange, level), _ASKED))
    answer = "asker string, slot int, role string, blob binary"
    answers = exchange.by_node(asked.pop()).applyInPandas(_add_up, answer + ", n long, v long, n_counting long, starts long, starts_counting long")
    answers = materialise(answers, "answers")
    n, v, n_counting, starts, starts_counting = (x or 0 for x in answers.agg(*map(F.sum, ("n", "v", "n_counting", "starts", "starts_counting"))).first())
    for requests in reversed(asked):
        told = answers.select(F.col("asker").cast("int").alias("node"), "slot", "blob")
        answers = materialise(exchange.by_node(requests).cogroup(exchange.by_node(told)).applyInPandas(_hand_down, answer), "answers")
    blobs = answers.select("asker", "slot", "blob")
    tuning = blobs.where(answers["role"] == "tuning").union(_streams(chosen, "tuning")).groupBy("asker")
    table = tuning.applyInPandas(_tuning_table(n_counting, v, starts_counting), "cell long, k long").groupBy("cell").agg(F.sum("k").alias("k"))
    weights = learn_weights(table.orderBy("cell").toPandas())
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blobs.union(_streams(chosen)).groupBy("asker").applyInPandas(_scores(n, v, starts, weights), ddl)
