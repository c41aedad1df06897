"""Personal data: fixed patterns, and terms that reveal what the patterns protect.

*Base spans* are e-mail addresses, IP addresses, card and phone numbers, found
over the whole text in linear time. Each distinct value is a protected entity,
and so is each kind as a whole.

*Terms.* A term is a word of a document that holds an entity, outside of the base
spans. From counts of documents over the whole corpus, copies included, p(e), p(t) and p(e, t), its
disclosure of e is the share of e's information that it gives away, PMI(e; t) /
-log p(e): 1 if the term never occurs without the entity. A term whose disclosure
reaches ``THRESHOLD`` is a span too, wherever it stands in documents that hold that
entity: removed from ``REMOVE`` on, below that generalised. An estimate counts only
if the pair occurs in at least ``SUPPORT`` different surroundings, so copies of one
document prove nothing: these are the ``NEAR`` words on both sides of the entity,
each time the term is among them, and where it never is in a document, one of the
entity's there. Documents without an entity are left alone.

A document of very many spans is worked off ``SLICE`` spans at a time, and its words near entities go out in as
many rows. Documents are read on the map side; only counts of terms, combined per task, the few
words near entities, and the rows of terms that can reach the threshold by their
counts are shuffled. Hot terms are one row per task after combining.

Defined results: a null text has no spans; offsets are code points, ends
exclusive; identical rows get identical results; null ids are allowed; extra
columns are kept by ``sanitise`` and not read by ``find``. A pattern's match
that fails its test (range, digits, check sum) is dropped without a retry.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from pathloom.llm.common import batched, discard, free_name, materialise, row_key, rows, sent, word_hashes, words

KINDS = ("email", "ip", "card", "phone", "term")
NEAR = 8
SUPPORT = 3
THRESHOLD = 0.8
REMOVE = 0.95
COUNT_CHUNK = 4_000_000
SLICE = 2000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match of the plain pattern never begins inside a run of digits, so looking behind only saves time.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > floor and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            floor = m.end()
        at = text.find("@", m.end() if m else at + 1)


def _is_ip(found: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found.split("."))


def _is_card(found: str) -> bool:
    digits = [int(c) for c in found if c.isdigit()]
    if not 12 <= len(digits) <= 19:
        return False
    doubled = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
    return (sum(doubled) + sum(digits[-1::-2])) % 10 == 0


def _is_phone(found: str) -> bool:
    return 9 <= len(_DIGIT.findall(found)) <= 15


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base spans, by start and kind."""
    if not text:
        return []
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for kind, pattern, test in ((1, _IP, _is_ip), (2, _CARD, _is_card)):
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if test(m[0])]
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if _is_phone(m[0])]
    return sorted(out)


def _hash(data: bytes) -> int:
    return int(np.uint64(xxh3_64_intdigest(data)).view(np.int64))


def term_of(word: str) -> bytes:
    """A word as a term: A-Z lower-cased, without marks at its ends."""
    return word.strip(".,;:!?()[]{}<>\"'").encode("utf-8", "surrogatepass").lower()


def _outside(text: str, spans: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[int], np.ndarray, np.ndarray, np.ndarray]:
    """The words' places, the numbers of those outside of the spans, starts, ends, and which are in spans."""
    found = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    starts = np.array([a for a, _ in found], np.int64)
    ends = np.array([b for _, b in found], np.int64)
    taken = np.zeros(len(found) + 1, bool)
    for a, _, b in spans:
        taken[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = True
    return found, np.flatnonzero(~taken[:-1]).tolist(), starts, ends, taken


def _value(text: str, span: tuple[int, int, int]) -> int:
    a, kind, b = span
    return _hash(KINDS[kind].encode() + b"\n" + text[a:b].encode("utf-8", "surrogatepass").lower())


def surroundings(text: str, spans: list[tuple[int, int, int]], size: int = SLICE) -> Iterator[tuple[list[tuple[int, int]], set[tuple[int, int, int]], set[int]]]:
    """``size`` spans at a time: (entity, surroundings) of their entities, values and kinds; (entity, term, surroundings)
    of the terms near them; and, in the last slice, all terms outside of spans."""
    found, free, starts, ends, taken = _outside(text, spans)
    hashed: dict[bytes, int] = {}
    own = [0] * len(found)  # the term at a free place
    for k in free:
        if term := term_of(text[found[k][0] : found[k][1]]):
            own[k] = hashed.get(term) or hashed.setdefault(term, _hash(term))
    for at in range(0, len(spans), size):
        entities: list[tuple[int, int]] = []
        near: set[tuple[int, int, int]] = set()
        for span in spans[at : at + size]:
            first, last = int(np.searchsorted(ends, span[0], "right")), int(np.searchsorted(starts, span[2], "left"))
            places = [k for k in (*range(max(0, first - NEAR), first), *range(last, min(len(found), last + NEAR))) if not taken[k]]
            around = _hash(b" ".join(term_of(text[found[k][0] : found[k][1]]) for k in places))
            for entity in (_value(text, span), span[1]):
                entities.append((entity, around))
                near.update((entity, own[k], around) for k in places if own[k])
        yield entities, near, set(hashed.values()) if at + size >= len(spans) else set()


def near_terms(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(entity, term, surroundings, start, end) for each word of a text with spans, pair by pair: what is judged."""
    entities: dict[int, set[int]] = {}
    near: dict[tuple[int, int], set[int]] = {}
    for some, terms, _ in surroundings(text, spans):
        for entity, around in some:
            entities.setdefault(entity, set()).add(around)
        for entity, term, around in terms:
            near.setdefault((entity, term), set()).add(around)
    found, free, *_ = _outside(text, spans)
    for entity, arounds in entities.items():
        for start, end in (found[k] for k in free):
            if word := term_of(text[start:end]):
                for around in near.get((entity, _hash(word)), (min(arounds),)):
                    yield entity, _hash(word), around, start, end


def term_spans(text: str, spans: list[tuple[int, int, int]], told: dict[int, float]) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, disclosure) of all words outside of the spans that are among the terms."""
    found, free, *_ = _outside(text, spans)
    hashed: dict[bytes, float | None] = {}
    out = []
    for k in free:
        term = term_of(text[found[k][0] : found[k][1]])
        if term not in hashed:
            hashed[term] = told.get(_hash(term)) if term else None
        if hashed[term] is not None:
            out.append((found[k][0], KINDS.index("term"), found[k][1], hashed[term]))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("row_key", row_key("doc_id", "text"))


def _base(docs: DataFrame) -> DataFrame:
    """One row per document with its base spans, and, where it has some, rows of what is near them (``base`` null)."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
    entity = pa.struct([("entity", pa.int64()), ("home", pa.int64()), ("windows", pa.int32())])
    near = pa.struct([("entity", pa.int64()), ("term", pa.int64()), ("around", pa.int64())])
    word = pa.struct([("term", pa.int64()), ("windows", pa.int32())])
    schema = pa.schema([("doc_id", pa.int64()), ("row_key", pa.binary()), ("base", pa.list_(span)), ("base_sha256", pa.string()), ("entities", pa.list_(entity)), ("near", pa.list_(near)), ("words", pa.list_(word))])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for doc_id, text, key in rows(batches, "doc_id", "text", "row_key"):
            spans = base_spans(text)
            told = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
            yield doc_id, key if spans else None, spans, hashlib.sha256(told.encode()).hexdigest(), [], [], []
            held: list[np.ndarray] = []
            most: dict[int, set[int]] = {}  # of each term, surroundings, as many as matter
            terms: set[int] = set()
            for entities, around, terms in surroundings(text, spans, SLICE) if spans else ():
                held.append(np.array(entities, np.int64))
                for _, term, a in around:
                    if len(seen := most.setdefault(term, set())) < SUPPORT:
                        seen.add(a)
                yield None, key, None, None, [], list(around), []
            if held:
                entity_, a = np.unique(np.concatenate(held), axis=0).T  # sorted, so the least surroundings come first
                each, first, n = np.unique(entity_, return_index=True, return_counts=True)
                yield None, key, None, None, list(zip(each.tolist(), a[first].tolist(), n.tolist())), [], [(t, len(most.get(t, (0,)))) for t in terms]

    ddl = "doc_id long, row_key binary, base array<struct<start:int,kind:int,end:int>>, base_sha256 string, entities array<struct<entity:long,home:long,windows:int>>, near array<struct<entity:long,term:long,around:long>>, words array<struct<term:long,windows:int>>"
    return _keyed(docs).mapInArrow(lambda it: batched(make(it), schema, 1024), ddl)


def _document_counts(docs: DataFrame) -> DataFrame:
    """(term, n): in how many documents each term of the corpus is; combined within a task first."""
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        terms, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(terms), pa.array(n.astype(np.int64))], schema=schema)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for (text,) in rows(batches, "text"):
            own = {w.strip(b".,;:!?()[]{}<>\"'") for w in set(words(text))}
            own.discard(b"")
            held.append(np.unique(word_hashes(list(own)).view(np.int64)))
            size += len(own)
            if size >= COUNT_CHUNK:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    return docs.select("text").mapInArrow(make, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _found(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base rows, and (row_key, terms): the disclosing terms (term, disclosure) of rows. All counts are of rows."""
    scratch: list[str] = []
    told = materialise(_base(docs), "base-spans")
    base = told.where("base is not null")
    each = lambda c: told.where(F.size(c) > 0).select("row_key", F.explode(c).alias("x")).select("row_key", "x.*")
    total = float(max(base.count(), 1))

    # Equal rows have one key; ``times`` says how many there are.
    held = materialise(each("entities").groupBy("row_key", "entity", "home", "windows").agg(F.count("*").alias("times")), "held", scratch)
    entities = held.groupBy("entity").agg(F.sum("times").alias("with_entity"), F.sum("windows").alias("windows"))
    entities = materialise(entities.where((F.col("windows") >= SUPPORT) & (F.col("with_entity") < total)).drop("windows"), "entities", scratch)
    is_kind = F.col("entity").between(0, 3)
    kind, value = entities.agg(F.min(F.when(is_kind, F.col("with_entity"))), F.max(F.when(~is_kind, F.col("with_entity")))).first()

    # The threshold is both / n >= p(e) ^ (1 - THRESHOLD); "both" is at most the rows with the term and an entity, and those with e.
    most = lambda both, n: both * F.pow(F.lit(total) / n, F.lit(1 - THRESHOLD)) * (1 + 1e-9)
    able = F.lit(False)
    if kind:
        able |= F.col("n") <= most(F.col("rows"), F.lit(kind))
    if value:
        low = F.least(F.col("rows"), F.lit(value))
        able |= F.col("n") <= most(low, low)
    words_ = each("words")
    likely = words_.groupBy("term").agg(F.count("*").alias("rows"), F.sum("windows").alias("windows")).where(F.col("windows") >= SUPPORT)
    likely = materialise(likely.join(_document_counts(docs), "term").where(able).select("term", "rows", "n"), "likely-terms", scratch)

    chosen = words_.join(sent(likely), "term").select("row_key", "term", "rows", "n").distinct()
    pairs = chosen.join(held.join(sent(entities), "entity"), "row_key").where(F.col("n") <= most(F.least("rows", "with_entity"), F.col("with_entity")))
    pairs = materialise(pairs.select("row_key", "entity", "term", "home", "times", "with_entity", "n"), "pairs", scratch)
    together = pairs.groupBy("entity", "term", "with_entity", "n").agg(F.sum("times").alias("both"))
    share = F.log2(F.col("both") * total / (F.col("with_entity") * F.col("n"))) / F.log2(F.lit(total) / F.col("with_entity"))
    together = materialise(together.withColumn("disclosure", share).where(F.col("disclosure") >= THRESHOLD).select("entity", "term", "disclosure"), "together", scratch)

    # Surroundings are only told apart for pairs that reach the threshold.
    pairs = pairs.join(sent(together), ["entity", "term"])
    near = each("near").join(sent(together.select("entity", "term")), ["entity", "term"], "left_semi").distinct()
    around = pairs.join(near, ["row_key", "entity", "term"], "left").select("entity", "term", F.coalesce("around", "home").alias("around")).distinct()
    judged = materialise(around.groupBy("entity", "term").count().where(F.col("count") >= SUPPORT).select("entity", "term"), "judged", scratch)
    terms = pairs.join(sent(judged), ["entity", "term"], "left_semi").groupBy("row_key", "term").agg(F.max("disclosure").alias("disclosure"))
    terms = materialise(terms.groupBy("row_key").agg(F.collect_list(F.struct("term", "disclosure")).alias("terms")), "terms")
    discard(docs.sparkSession, scratch)
    return base, terms


def _told(terms: list[dict] | None) -> dict[int, float]:
    return {t["term"]: t["disclosure"] for t in terms or ()}


def _places(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(row_key, terms): where the terms of rows stand."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("disclosure", pa.float64())])
    schema = pa.schema([("row_key", pa.binary()), ("terms", pa.list_(span))])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, text, more in rows(batches, "row_key", "text", "terms"):
            found = term_spans(text, base_spans(text), _told(more))
            yield key, found

    some = _keyed(docs).join(sent(terms), "row_key").select("row_key", "text", "terms")
    return some.mapInArrow(lambda it: batched(make(it), schema, 1024), "row_key binary, terms array<struct<start:int,kind:int,end:int,disclosure:double>>").dropDuplicates(["row_key"])


def find(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, row_key (null without base spans), base, base_sha256 and ``found``, all spans with
    their disclosure."""
    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    base, terms = _found(chosen)
    terms = _places(chosen, terms)
    own = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.lit(1.0).alias("disclosure")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,disclosure:double>>")
    # Rows without a base span have no terms; they stay out of the join.
    with_spans = base.where("row_key is not null").join(terms, "row_key", "left").withColumn("found", F.array_sort(F.concat(own, F.coalesce("terms", none))))
    without = base.where("row_key is null").withColumn("found", own)
    columns = ["doc_id", "row_key", "base", "base_sha256", "found"]
    return with_spans.select(*columns).unionByName(without.select(*columns))


def report(found: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    told = F.array_join(F.transform("found", lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")
    return found.select("doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)), "base_sha256", told.alias("spans"))


def sanitise(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with base spans replaced by their kind, revealing terms generalised or removed; other columns as they were.

    Overlapping spans are replaced as one, under the kind that begins first.
    """
    key, terms_of = free_name(docs, "__key"), free_name(docs, "__terms")
    chosen = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    terms = _found(chosen)[1].select(F.col("row_key").alias(key), F.col("terms").alias(terms_of))
    columns = docs.columns
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields]

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                own = {c: part.column(part.schema.get_field_index(c)) for c in columns}
                new = []
                for passage, more in zip(own[text].to_pylist(), part.column(part.schema.get_field_index(terms_of)).to_pylist()):
                    own_spans = base_spans(passage)
                    spans = [(a, k, b, 1.0) for a, k, b in own_spans] + (term_spans(passage, own_spans, _told(more)) if more else [])
                    new.append(_replaced(passage, sorted(spans)) if spans else passage)
                own[text] = pa.array(new, own[text].type)
                yield pa.RecordBatch.from_arrays([own[c] for c in columns], columns)

    # Few rows have terms; they are sent to all tasks while they are few, so the texts stay where they are.
    keyed = docs.withColumn(key, row_key(id_column, text))
    return keyed.join(sent(terms), key, "left").select(*columns, terms_of).mapInArrow(replace, ", ".join(fields))


def _replaced(text: str, spans: list[tuple[int, int, int, float]]) -> str:
    out, at = [], 0
    for start, kind, end, disclosure in spans:
        if start < at:
            at = max(at, end)
            continue
        out.append(text[at:start])
        if KINDS[kind] != "term" or disclosure < REMOVE:
            out.append(f"[{KINDS[kind].upper()}]")
        at = end
    return "".join([*out, text[at:]])
