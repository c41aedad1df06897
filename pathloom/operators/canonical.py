"""Canonical forms of graphs: equal for isomorphic graphs and for no others.

*Colour refinement.* Nodes are coloured by symbol; a node's next colour is its own
with the multiset of its neighbours' colours and changes, until no colour splits.
Colours are numbered in the order of what they are made of, so they don't depend on
node ids. *Individualisation.* Where a colour is shared, each of its nodes in turn is
told apart and the rest refined again; a leaf is an order of the nodes, and the least
text that an order gives is the form. Two orders that give the same text make an
automorphism, and of nodes that known automorphisms exchange (those that leave
what was told apart before in place) only one is tried.

With a form for each graph, isomorphism is equality: graphs meet by an equi-join or a
group on the form, with a minimum that is combined before the shuffle, and no two
graphs are ever compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pathloom.operators.paths import as_graphs

Near = list[list[tuple[int, int]]]


def refine(colours: list[int], near: Near) -> list[int]:
    """The coarsest stable colouring below ``colours``; colours are 0, 1, 2, ... in an order free of ids."""
    parts = len(set(colours))
    while True:
        told = [(c, sorted((change, colours[x]) for x, change in near[i])) for i, c in enumerate(colours)]
        number = {t: k for k, t in enumerate(sorted({(c, tuple(n)) for c, n in told}))}
        colours = [number[c, tuple(n)] for c, n in told]
        if len(number) == parts:
            return colours
        parts = len(number)


def canonical_order(syms: list[str], near: Near) -> tuple[tuple, list[int]]:
    """(the least text, the nodes in the order that gives it)."""
    names = {s: k for k, s in enumerate(sorted(set(syms)))}
    best: list = []  # text, order, what was told apart on the way
    exchanges: list[list[int]] = []

    def leaf(colours: list[int], fixed: list[int]) -> int | None:
        """The depth at which to go on, if all below it is known to give what was given before."""
        order = sorted(range(len(colours)), key=colours.__getitem__)
        text = tuple(sorted((colours[a], colours[b], change) for a in range(len(near)) for b, change in near[a] if colours[a] <= colours[b]))
        if not best or text < best[0]:
            best[:] = [text, order, fixed]
        elif text == best[0]:
            exchange = [0] * len(order)
            for x, y in zip(best[1], order):
                exchange[x] = y
            exchanges.append(exchange)
            # It takes the branch of the best order to this one, and that branch is done.
            return next(k for k, (x, y) in enumerate(zip(best[2], fixed)) if x != y)
        return None

    def alike(tried: list[int], node: int, fixed: list[int]) -> bool:
        """Whether what is known to change nothing takes ``node`` to a node that was tried."""
        own = [e for e in exchanges if all(e[x] == x for x in fixed)]
        seen, open_ = {node}, [node]
        while open_:
            at = open_.pop()
            for e in own:
                for other in (e[at], e.index(at)):
                    if other not in seen:
                        seen.add(other)
                        open_.append(other)
        return any(x in seen for x in tried)

    def search(colours: list[int], fixed: list[int]) -> int | None:
        count: dict[int, list[int]] = {}
        for i, c in enumerate(colours):
            count.setdefault(c, []).append(i)
        shared = [c for c, own in count.items() if len(own) > 1]
        if not shared:
            return leaf(colours, fixed)
        tried: list[int] = []
        for node in count[min(shared, key=lambda c: (len(count[c]), c))]:
            if not alike(tried, node, fixed):
                tried.append(node)
                # Told apart: before the others of its colour.
                back = search(refine([2 * c + (i != node) for i, c in enumerate(colours)], near), [*fixed, node])
                if back is not None and back < len(fixed):
                    return back
        return None

    search(refine([names[s] for s in syms], near), [])
    text, order, _ = best
    return (tuple(syms[i] for i in order), text), order


def canonical_form(ids, syms, src, dst, chg) -> tuple:
    """The form of a graph: its symbols and its edges by places in an order free of ids. Repeated edges and loops stay."""
    at = {n: k for k, n in enumerate(ids)}
    near: Near = [[] for _ in ids]
    for a, b, c in zip(src or (), dst or (), chg or ()):
        near[at[a]].append((at[b], c))
        near[at[b]].append((at[a], c))
    return canonical_order(list(syms), near)[0]


def canonical_forms(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, form): the SHA-256 of the canonical form. Graphs that are written alike are worked on once."""
    packed = as_graphs(nodes, edges)
    n = F.array_sort(F.arrays_zip("ids", "syms"))
    ends = F.transform(F.arrays_zip("src", "dst", "chg"), lambda e: F.struct(F.least(e["src"], e["dst"]).alias("src"), F.greatest(e["src"], e["dst"]).alias("dst"), e["chg"].alias("chg")))
    e = F.array_sort(F.coalesce(ends, F.array().cast(dict(packed.select(ends.alias("e")).dtypes)["e"])))
    written = packed.select("g", n.alias("n"), e.alias("e")).withColumn("as_written", F.sha1(F.to_json(F.struct("n", "e")).cast("binary")))
    once = written.groupBy("as_written").agg(F.min_by(F.struct("n", "e"), "g").alias("graph"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                forms = []
                for graph in part.column("graph").to_pylist():
                    n, e = graph["n"], graph["e"]
                    forms.append(str(canonical_form([x["ids"] for x in n], [x["syms"] for x in n], *([x[c] for x in e] for c in ("src", "dst", "chg")))))
                yield pa.RecordBatch.from_arrays([part.column("as_written"), pa.array(forms, pa.string())], ["as_written", "text"])

    labelled = once.mapInArrow(label, "as_written string, text string").select("as_written", F.sha2("text", 256).alias("form"))
    return written.select("g", "as_written").join(labelled, "as_written").select("g", "form")


def isomorphism_classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, class): the least graph id that is isomorphic."""
    from pathloom.scratch import materialise

    forms = materialise(canonical_forms(nodes, edges), "canonical-forms")
    least = forms.groupBy("form").agg(F.min("g").alias("class")).withColumnRenamed("form", "own")
    return forms.join(least, F.col("form") == F.col("own")).select("g", "class")


def distinct_mappings(mappings: DataFrame, sides: DataFrame) -> DataFrame:
    """(reaction, mapping): of the mappings (reaction, mapping, images) whose reaction graphs are isomorphic the first.

    A reaction graph has the left side's nodes; an edge of either side is kept, cleaved or formed. ``sides`` are
    (reaction, syms1, edges1, syms2, edges2) as for ``mapping.map_reactions``.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                forms = []
                for r in part.to_pylist():
                    back = {y: x for x, y in enumerate(r["images"]) if y is not None}
                    pair = lambda a, b: (min(a, b), max(a, b))
                    old = {pair(e["a"], e["b"]) for e in r["edges1"] or ()}
                    new = {pair(back[e["a"]], back[e["b"]]) for e in r["edges2"] or () if e["a"] in back and e["b"] in back}
                    both = sorted(old | new)
                    change = [(e in new) - (e in old) for e in both]
                    forms.append(str(canonical_form(range(len(r["syms1"])), r["syms1"], [a for a, _ in both], [b for _, b in both], change)))
                yield pa.RecordBatch.from_arrays([part.column("reaction"), part.column("mapping"), pa.array(forms, pa.string())], ["reaction", "mapping", "text"])

    asked = mappings.select("reaction", "mapping", "images").join(sides.select("reaction", "syms1", "edges1", "edges2"), "reaction")
    kinds = {n: t for n, t in asked.dtypes}
    forms = asked.mapInArrow(told, f"reaction {kinds['reaction']}, mapping {kinds['mapping']}, text string").select("reaction", "mapping", F.sha2("text", 256).alias("form"))
    return forms.groupBy("reaction", "form").agg(F.min("mapping").alias("mapping")).select("reaction", "mapping")
