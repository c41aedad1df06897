"""Text forms of graphs, path tables, features, kernels and mappings. Each gives a DataFrame of lines or documents;
``write.text`` puts it out, so large results are written in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pathloom.operators.paths import is_core
from pathloom.schema import BRACKETS
from pathloom.scratch import numbered as by_ranges
from pathloom.sources.trees import INDEX_VERSION


#: Tries of equal graphs are made once by a task: of graphs up to so many nodes, and for so many at a time.
FORM_NODES, FORMS = 16, 20_000


def sequences(nodes: DataFrame, edges: DataFrame | None, max_depth: int = 50) -> DataFrame:
    """(g, start, line): the trie of simple paths from each node as one bracket string."""
    from pathloom.operators.paths import as_graphs
    import pyarrow as pa

    schema = pa.schema([("g", pa.int64()), ("start", pa.int32()), ("line", pa.string())])
    closing = {"(": ")", "{": "}", "[": "]"}

    def known(ids, syms, src, dst, chg):
        """Labels and neighbours, made once for all tries of a graph."""
        near = {i: [] for i in ids}
        for a, b, c in zip(src or (), dst or (), chg or ()):
            sign = BRACKETS[(c > 0) - (c < 0)]
            near[a].append((b, sign))
            near[b].append((a, sign))
        return dict(zip(ids, syms)), near

    def trie(label, near, start):
        out, seen, open_ = ["(" + label[start]], {start}, [(start, "(", iter(near[start]))]
        while open_:
            node, mark, rest = open_[-1]
            for other, sign in rest if len(open_) < max_depth else ():
                if other not in seen:
                    seen.add(other)
                    out.append(sign + label[other])
                    open_.append((other, sign, iter(near[other])))
                    break
            else:
                open_.pop()
                seen.discard(node)
                out.append(closing[mark])
        return "".join(out)

    def tries(graph):
        label, near = known(*graph)
        return ((start, trie(label, near, start)) for start in graph[0])

    def walk(batches):
        made = {}  # small graphs that are equal have equal tries
        for batch in batches:
            out = [[], [], []]
            for g, *graph in zip(*(c.to_pylist() for c in batch.columns)):
                found = None
                if len(graph[0]) <= FORM_NODES:
                    form = tuple(tuple(c or ()) for c in graph)
                    if (found := made.get(form)) is None:
                        if len(made) == FORMS:
                            made.clear()
                        found = made[form] = list(tries(graph))
                for start, line in tries(graph) if found is None else found:
                    for values, v in zip(out, (g, start, line)):
                        values.append(v)
                    if len(out[0]) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)
                        out = [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    return as_graphs(nodes, edges).mapInArrow(walk, "g long, start int, line string")


def write_files(files: DataFrame, folder: str) -> int:
    """Write each text to a file of its name under ``folder``; how many there are. A task that runs again writes the
    same files again."""
    import pyarrow as pa
    from pyarrow import fs

    def write(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("name", "text").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def message_lines(messages: DataFrame) -> DataFrame:
    """Lines ``round graph source target message`` of what ``messages`` sends."""
    return messages.select(F.concat_ws(" ", "round", "g", "src", "dst", F.col("m").cast("string")).alias("value"))


def molecule_text(molecules: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, text): molecule files in MOL form of molecules (g, title), nodes (g, id, sym, x, y) and edges (g, src, dst, type)."""
    three = lambda c: F.lpad(c.cast("string"), 3, " ")
    row = F.concat(F.format_string("%10.4f%10.4f%10.4f ", "x", "y", F.lit(0.0)), F.rpad("sym", 3, " "), F.lit(" 0  0  0  0  0"))
    lines = lambda key, line: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*key, line.alias("line")))), lambda x: x["line"]), "\n")
    atoms = nodes.groupBy("g").agg(F.count("*").alias("na"), lines(["id"], row).alias("atoms"))
    bond = F.concat(three(F.col("src") + 1), three(F.col("dst") + 1), three(F.col("type")), F.lit("  0  0  0"))
    bonds = edges.groupBy("g").agg(F.count("*").alias("nb"), lines(["src", "dst"], bond).alias("bonds"))
    counts = F.concat(three(F.col("na")), three(F.coalesce("nb", F.lit(0))), F.lit("  0  0  0  0  0  0  0  0999 V2000"))
    joined = molecules.join(atoms, "g").join(bonds, "g", "left")
    return joined.select("g", F.concat_ws("\n", "title", F.lit(""), F.lit(""), counts, "atoms", "bonds", F.lit("M  END"), F.lit("")).alias("text"))


def sequence_files(lines: DataFrame, graphs: DataFrame) -> DataFrame:
    """(name, text): per graph a title and its tries; names tell forward from backward reactions."""
    mark = F.when(F.col("direction") > 0, "_f_").when(F.col("direction") < 0, "_b_").otherwise("_")
    body = lines.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "line"))), lambda x: x["line"]), "\n").alias("body"))
    named = graphs.withColumn("title", F.concat(F.regexp_replace("name", r"(_[fb])?(\.mol)?$", ""), mark, F.lit(".seqs")))
    return named.join(body, "g").select(F.col("title").alias("name"), F.concat(F.lit(">"), "title", F.lit("\n"), "body", F.lit("\n")).alias("text"))


def save_index(paths: DataFrame, folder: str) -> None:
    """The path table, sorted by path in each length's partition, and its version. Ranges are cut by graph, too: a path may be in most graphs."""
    paths.repartitionByRange("len", "path", "g").sortWithinPartitions("len", "path", "g").write.partitionBy("len").parquet(f"{folder}/paths")
    paths.sparkSession.createDataFrame([(INDEX_VERSION,)], "value string").coalesce(1).write.text(f"{folder}/version")


def frequencies(paths: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Lines ``path graph:count graph:count ..``, graphs in order, by number or by name (g, name)."""
    rows = paths.select("path", F.col("g").alias("order"), F.col("g").cast("string").alias("graph"), "freq")
    if names is not None:
        rows = paths.join(names.select("g", "name"), "g").select("path", F.col("g").alias("order"), F.col("name").alias("graph"), "freq")
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("order", "graph", "freq"))), lambda x: F.concat_ws(":", x["graph"], x["freq"]))
    return rows.groupBy("path").agg(F.array_join(pairs, " ").alias("rest")).select(F.concat_ws(" ", "path", "rest").alias("value"))


def dense_features(paths: DataFrame, patterns: list[str]) -> DataFrame:
    """Lines of counts, one per graph, a column per pattern."""
    from pathloom.operators.paths import feature_pivot

    wide = feature_pivot(paths, patterns)
    return wide.select("g", F.concat_ws(" ", *[F.col(c).cast("string") for c in wide.columns if c != "g"]).alias("value"))


def write_triples(triples: DataFrame, ids: DataFrame, folder: str) -> None:
    """Sparse triples in folders by length and by whether the path is a core path; sizes come from the data."""
    kind = ids.select("path_id", "len", is_core(F.col("path")).alias("is_core"))
    triples.join(kind, "path_id").select("path_id", "graph_id", "freq", "len", "is_core").write.partitionBy("len", "is_core").option("sep", " ").csv(folder)


def triple_header(triples: DataFrame) -> DataFrame:
    """The line of sizes: paths, graphs, 0."""
    return triples.agg(F.concat_ws(" ", F.max("path_id"), F.max("graph_id"), F.lit("0")).alias("value"))


def kernel_lines(kernel: DataFrame, low: int | None = None, high: int | None = None) -> DataFrame:
    """(i, value): rows of the lower triangle, tab-separated, of all graphs or of i = low..high; values that are no
    number are ``NaN``, ``Inf`` or ``-Inf``."""
    rows = kernel.where("j <= i")
    if low is not None:
        rows = rows.where(F.col("i").between(low, high))
    shown = F.when(F.isnan("k"), "NaN").when(F.col("k") == float("inf"), "Inf").when(F.col("k") == float("-inf"), "-Inf").otherwise(F.format_string("%.5E", "k"))
    cells = F.transform(F.array_sort(F.collect_list(F.struct("j", shown.alias("s")))), lambda x: x["s"])
    return rows.groupBy("i").agg(F.array_join(cells, "\t").alias("value"))


def kernel_name(kernels: DataFrame) -> DataFrame:
    """``kernels`` with ``name``, the file name of their setting."""
    return kernels.withColumn("name", F.concat_ws("_", "paths", "l", F.lit("90"), "dp", "type", "power"))


def kernel_text(kernels: DataFrame) -> DataFrame:
    """(name, text): a file for each ``name`` of (name, i, j, k), a line for each i, its values in the order of j and apart by commas."""
    in_order = lambda key, value: F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value])
    lines = kernels.withColumn("s", F.col("k").cast("string")).groupBy("name", "i").agg(F.array_join(in_order("j", "s"), ",").alias("line"))
    return lines.groupBy("name").agg(F.array_join(in_order("i", "line"), "\n").alias("text"))


def new_lines(lines: DataFrame, present: DataFrame) -> DataFrame:
    """Lines that are not there yet, each once: append these."""
    return lines.distinct().join(present.select("value"), "value", "left_anti")


def mapping_report(reactions: DataFrame, image: DataFrame, bonds: DataFrame) -> DataFrame:
    """(reaction, value): a report per reaction (reaction, equation, cost): atom table (lhs_atom, lhs_sym, rhs_atom,
    rhs_sym) and bond table (a, b, chg)."""
    atoms = image.groupBy("reaction").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("lhs_atom", "lhs_sym", "rhs_atom", "rhs_sym"))), lambda x: F.concat_ws(" ", x["lhs_atom"], x["lhs_sym"], x["rhs_atom"], x["rhs_sym"])), "\n").alias("atoms"))
    links = bonds.select("reaction", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "chg").distinct()
    links = links.groupBy("reaction").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", "b", "chg"))), lambda x: F.concat_ws(" ", x["a"], x["b"], x["chg"])), "\n").alias("bonds"))
    joined = reactions.join(atoms, "reaction").join(links, "reaction", "left")
    return joined.select("reaction", F.concat_ws("\n", F.concat(F.lit("REACTION "), "reaction"), F.concat(F.lit("EQUATION "), "equation"), F.concat(F.lit("COST "), F.col("cost").cast("string")), F.lit("ATOMS"), "atoms", F.lit("BONDS"), F.coalesce("bonds", F.lit("")), F.lit("")).alias("value"))


def mol_text(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, backward: bool = False) -> DataFrame:
    """(g, text): reaction-graph files; backwards, changes are negated and old and new types swapped.

    ``graphs`` is (g, title, second); edges have chg, old and new.
    """
    three = lambda c: F.lpad(c.cast("string"), 3, " ")
    chg = -F.col("chg") if backward else F.col("chg")
    old, new = ("new", "old") if backward else ("old", "new")
    atoms = nodes.groupBy("g").agg(F.count("*").alias("na"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "sym"))), lambda x: F.concat(F.lit("    0.0000    0.0000    0.0000 "), F.rpad(x["sym"], 3, " "), F.lit(" 0  0  0  0  0"))), "\n").alias("atoms"))
    row = F.concat(three(F.col("src") + 1), three(F.col("dst") + 1), three(chg), three(F.col(old)), three(F.col(new)))
    bonds = edges.groupBy("g").agg(F.count("*").alias("nb"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "dst", row.alias("row")))), lambda x: x["row"]), "\n").alias("bonds"))
    joined = graphs.join(atoms, "g").join(bonds, "g", "left")
    counts = F.concat(three(F.col("na")), three(F.coalesce("nb", F.lit(0))), F.lit("  0  0  0  0  0  0  0  0999 V2000"))
    return joined.select("g", F.concat_ws("\n", "title", "second", F.lit(""), counts, "atoms", "bonds", F.lit("M  END"), F.lit("")).alias("text"))


def labels_matrix(labels: DataFrame, values: list[str]) -> DataFrame:
    """(item, value): lines of zeros and ones."""
    from pathloom.operators.labels import multi_label

    wide = multi_label(labels, values)
    return wide.select("item", F.concat_ws(" ", *[F.col(f"`{c}`").cast("string") for c in wide.columns if c != "item"]).alias("value"))


def reaction_lines(reactions: DataFrame) -> DataFrame:
    """Lines ``id natoms C.. p C..`` from (id, natoms, ligands)."""
    return reactions.select(F.concat_ws(" ", "id", F.col("natoms").cast("string"), F.array_join("ligands", " ")).alias("value"))


def numbered(df: DataFrame, order: str) -> DataFrame:
    """``df`` with line_no, from 1 in the order of a column that tells rows apart."""
    return by_ranges(df, "line_no", order)


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(g, value): graphs in GraphViz form; changed edges carry their sign."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    points = nodes.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "sym"))), lambda x: F.concat(F.lit("  n"), x["id"], F.lit(" [label="), quoted(x["sym"]), F.lit("];"))), "\n").alias("points"))
    sign = lambda c: F.when(c > 0, ' [label="+"]').when(c < 0, ' [label="-"]').otherwise("")
    lines = edges.groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("src", "dst", "chg"))), lambda x: F.concat(F.lit("  n"), x["src"], F.lit(" -- n"), x["dst"], sign(x["chg"]), F.lit(";"))), "\n").alias("lines"))
    return points.join(lines, "g", "left").select("g", F.concat_ws("\n", F.concat(F.lit("graph g"), "g", F.lit(" {")), "points", "lines", F.lit("}")).alias("value"))


def network_dot(network: DataFrame) -> DataFrame:
    """Lines of a reaction network (r1, r2) in GraphViz form, to go between ``graph network {`` and ``}``."""
    return network.select(F.concat(F.lit('  "'), F.col("r1").cast("string"), F.lit('" -- "'), F.col("r2").cast("string"), F.lit('";')).alias("value"))
