"""Typed citation networks: building, indexing, metapaths, neighbourhoods, walks.

Edges are DataFrames (source, target), bags unless said otherwise; typed edges add (src_type, rel, dst_type). Membership is always a
semi-join, an id list is never collected, and every hop of a path is made distinct before the next so that path counts never multiply.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import code_parent, is_numeric_root, last_segment
from ..storage import settle

Relation = tuple[str, str, str]
REVERSED = {("case", "cites", "legislation"): ("legislation", "cited_by", "case"), ("case", "has_subject", "subject_matter"): ("subject_matter", "related_to", "case"), ("legislation", "has_subject", "subject_matter"): ("subject_matter", "related_to", "legislation")}
#: Rows of a group that one task numbers at most.
HUB = 1 << 20
#: Rows of a table for each part that joins deal it into, and rows of a list that every task may hold.
DEALT, FEW = 1 << 19, 1 << 15
FORWARD = (("case", "cites", "case"), ("case", "cites", "legislation"), ("case", "has_subject", "subject_matter"), ("legislation", "cites", "legislation"), ("legislation", "has_subject", "subject_matter"))


def is_case(c: Column) -> Column:
    return c.startswith("6")


def is_legislation(c: Column, sectors: tuple[str, ...] = ("3", "1")) -> Column:
    return reduce(lambda a, b: a | b, (c.startswith(s) for s in sectors))


def node_type(c: Column) -> Column:
    return F.when(is_case(c), "case").when(is_legislation(c), "legislation").otherwise("subject_matter")


def parts_of(rows: DataFrame, each: int | None = None) -> int:
    """Parts of `each` (DEALT) rows, so that what a task holds doesn't follow the table; 0, which leaves it to Spark, up to as many as run at once. Counts the rows."""
    n = -(-rows.count() // (each or DEALT))
    return n if n > rows.sparkSession.sparkContext.defaultParallelism else 0


def dealt(rows: DataFrame, parts: int, *by: str) -> DataFrame:
    return rows.repartition(parts, *by) if parts else rows


def listed(rows: DataFrame) -> DataFrame:
    """rows as a side of a join that isn't sent to every task if they are over FEW: a compressed file's size says little of its rows' in memory. Counts the rows."""
    return rows if rows.limit(FEW + 1).count() <= FEW else rows.hint("merge")


def within(edges: DataFrame, ids: DataFrame, end: str, parts: int = 0) -> DataFrame:
    """Edges whose `end` is in ids(id): a left-semi join that Spark broadcasts if ids are few. With parts, both sides are dealt into as many."""
    ids = ids.select(F.col("id").alias("_id"))
    if parts:  # a semi-join would be moved to before its left side is dealt
        known = dealt(ids, parts, "_id").distinct()
        return dealt(edges, parts, end).join(known.hint("merge"), F.col(end) == F.col("_id")).select(*edges.columns)
    return edges.join(ids, F.col(end) == F.col("_id"), "left_semi")


def citation_edges(citations: DataFrame, relation: Relation, cases: DataFrame | None, legislation: DataFrame | None, parts: int = 0) -> DataFrame:
    """Distinct edges of one of the five relations among all citations or subject edges. A None list admits every id of its type."""
    kinds = {"case": (is_case, cases), "legislation": (is_legislation, legislation)}
    # The last lookup is by source, so its shuffle is the repeats' as well.
    for end, kind in (("target", relation[2]), ("source", relation[0])):
        if kind in kinds:
            test, ids = kinds[kind]
            citations = citations.where(test(F.col(end)))
            # Legislation that has subjects need only be legislation that is listed as a source, as cases do.
            citations = within(citations, ids, end, parts) if ids is not None else citations
    return citations.select("source", "target").dropDuplicates()


def typed_graph(citations: DataFrame, subjects: DataFrame, cases: DataFrame | None, legislation: DataFrame | None, reverse: bool = True, parts: int = 0) -> DataFrame:
    """One table (src_type, rel, dst_type, source, target) of five relations and, if reverse, the three reversed ones."""
    found = []
    for relation in FORWARD:
        edges = citation_edges(subjects if relation[2] == "subject_matter" else citations, relation, cases, legislation, parts)
        found.append(_typed(edges, relation))
        if reverse and relation in REVERSED:
            found.append(_typed(edges.select(F.col("target").alias("source"), F.col("source").alias("target")), REVERSED[relation]))
    return reduce(DataFrame.unionByName, found)


def whole_graph(citations: DataFrame, subjects: DataFrame, cases: DataFrame | None, legislation: DataFrame | None, reverse: bool = True, parts: int = 0, repeats: bool = False) -> DataFrame:
    """The same rows as typed_graph(), for readers of all relations: either table is read once and each list looked up once an end, whatever the relations.

    From typed_graph() a reader of one relation computes that relation alone. With repeats, edges that come more than once may stay: readers of nodes do without that step.
    """
    source, target = F.col("source"), F.col("target")
    kind = lambda c: F.when(is_case(c), "case").when(is_legislation(c), "legislation")
    cited = citations.where((is_case(source) & (is_case(target) | is_legislation(target))) | (is_legislation(source) & is_legislation(target)))
    cited = _listed(cited.select("source", "target", F.lit("cites").alias("rel")), "target", cases, legislation, parts)
    topics = subjects.where(is_case(source) | is_legislation(source)).select("source", "target", F.lit("has_subject").alias("rel"))
    # The last lookup is by source, so its shuffle is the repeats' as well.
    edges = _listed(cited.unionByName(topics), "source", cases, legislation, parts)
    edges = edges if repeats else edges.dropDuplicates()
    edges = edges.select(kind(source).alias("src_type"), "rel", F.when(F.col("rel") == "cites", kind(target)).otherwise("subject_matter").alias("dst_type"), "source", "target")
    return with_reversed(edges) if reverse else edges


def with_reversed(edges: DataFrame) -> DataFrame:
    """Typed edges and, of the three relations that have one, the reversed ones, in one pass."""
    source, target = F.col("source"), F.col("target")
    back = F.when(F.col("rel") == "has_subject", "related_to").when(F.col("src_type") != F.col("dst_type"), "cited_by")
    there = F.struct(*edges.columns)
    again = F.struct(F.col("dst_type").alias("src_type"), back.alias("rel"), F.col("src_type").alias("dst_type"), target.alias("source"), source.alias("target"))
    return edges.select(F.explode(F.when(back.isNotNull(), F.array(there, again)).otherwise(F.array(there))).alias("e")).select("e.*")


def _listed(edges: DataFrame, end: str, cases: DataFrame | None, legislation: DataFrame | None, parts: int = 0) -> DataFrame:
    """Edges, all of whose `end`s are cases or legislation, without those that the list of their type lacks. A None list admits every id of its type."""
    lists = [ids.select("id").where(test(F.col("id"))) for test, ids in ((is_case, cases), (is_legislation, legislation)) if ids is not None]
    if not lists:
        return edges
    if len(lists) == 2:
        return within(edges, lists[0].unionByName(lists[1]), end, parts)
    asked = (is_case if legislation is None else is_legislation)(F.col(end))
    # Ends that aren't looked up meet nothing, under a key of their other end: a hub among them would have one task.
    other = F.concat(F.lit("-"), F.coalesce("target" if end == "source" else "source", F.lit("")))
    known = lists[0].distinct().select(F.col("id").alias("_id"), F.lit(True).alias("_known"))
    got = edges.withColumn("_end", F.when(asked, F.col(end)).otherwise(other)).join(known, F.col("_end") == F.col("_id"), "left")
    return got.where(F.col("_known") | ~asked).select(*edges.columns)


def _typed(edges: DataFrame, relation: Relation) -> DataFrame:
    return edges.select(*[F.lit(x).alias(n) for x, n in zip(relation, ("src_type", "rel", "dst_type"))], "source", "target")


def of_relation(graph: DataFrame, relation: Relation) -> DataFrame:
    return graph.where((F.col("src_type") == relation[0]) & (F.col("rel") == relation[1]) & (F.col("dst_type") == relation[2])).select("source", "target")


def nodes_of(graph: DataFrame) -> DataFrame:
    """Distinct (type, id) over both ends."""
    end = lambda kind, x: F.struct(F.col(kind).alias("type"), F.col(x).alias("id"))
    ends = graph.select(F.explode(F.array(end("src_type", "source"), end("dst_type", "target"))).alias("e")).select("e.*")
    return ends.distinct()


def numbered(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """rows with pos, their 0-based place by `order` among rows that agree on `by`, and degree, how many these are.

    Groups of more than HUB rows are numbered by a range sort, which spreads each over tasks; the others, one shuffle for all, where they meet. Equal rows are numbered in any order.
    """
    rows = settle(rows, "unnumbered")
    hubs = settle(rows.groupBy(*by).agg(F.count("*").alias("_n")).where(F.col("_n") > HUB).select(*by), "hubs")
    group = Window.partitionBy(*by)
    place = lambda some: some.withColumns({"pos": F.row_number().over(group.orderBy(order)).cast("long") - 1, "degree": F.count("*").over(group)})
    if hubs.isEmpty():
        return place(rows)
    few = F.broadcast(hubs.select(*[F.col(c).alias(f"_{c}") for c in by]))  # one row for HUB rows at least
    mine = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    return place(rows.join(few, mine, "left_anti")).unionByName(_spread(rows.join(few, mine, "left_semi"), by, order))


def _spread(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """numbered() by a range-partitioned sort, for groups of any size: partitions number themselves, and only one row a group and partition is added up."""
    ordered = rows.repartitionByRange(*by, order).sortWithinPartitions(*by, order)
    ordered = settle(ordered.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "numbered")
    parts = ordered.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*by, "_part", "_first", before.alias("_before"), F.sum("_n").over(group).alias("degree"))
    joined = ordered.join(F.broadcast(parts), [*by, "_part"])
    return joined.select(*rows.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"), "degree")


def dense_index(nodes: DataFrame) -> DataFrame:
    """(type, id, idx): 0-based rank of id among its type, sorted.

    Range-partitioned sort with running offsets, no window over a whole type: partitions number themselves, and only one row a
    partition and type is added up.
    """
    ordered = nodes.select("type", "id").repartitionByRange("type", "id").sortWithinPartitions("type", "id")
    ordered = settle(ordered.select("type", "id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "index")
    firsts = ordered.groupBy("type", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("type").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = firsts.select(F.col("type").alias("t"), F.col("part").alias("p"), "first", before.alias("before"))
    joined = ordered.join(F.broadcast(firsts), (F.col("type") == F.col("t")) & (F.col("part") == F.col("p")))
    return joined.select("type", "id", (F.col("at") - F.col("first") + F.col("before")).alias("idx"))


def encode(graph: DataFrame, index: DataFrame) -> DataFrame:
    """Typed edges with src and dst indices; an end without an index drops its edge (compare counts to detect that)."""
    s = index.select(F.col("type").alias("src_type"), F.col("id").alias("source"), F.col("idx").alias("src"))
    d = index.select(F.col("type").alias("dst_type"), F.col("id").alias("target"), F.col("idx").alias("dst"))
    return graph.join(s, ["src_type", "source"]).join(d, ["dst_type", "target"]).select("src_type", "rel", "dst_type", "src", "dst")


def simple_graph(edges: DataFrame) -> DataFrame:
    """Undirected edges (a, b), a <= b, each once; self-loops stay."""
    return edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()


def both_ways(simple: DataFrame) -> DataFrame:
    way = lambda x, y: F.struct(F.col(x).alias("node"), F.col(y).alias("nbr"))
    return simple.select(F.explode(F.when(F.col("a") != F.col("b"), F.array(way("a", "b"), way("b", "a"))).otherwise(F.array(way("a", "b")))).alias("e")).select("e.*")


def judgment_graph(citations: DataFrame, subjects: DataFrame, judgments: DataFrame, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, type), simple edges(a, b)) of cases on the judgment list, all legislation and subjects.

    extra: inline citation edges added before filtering. An id of several types takes the last of case, legislation, subject.
    """
    if extra is not None:
        citations = citations.unionByName(extra)
    graph = settle(whole_graph(citations, subjects, judgments, None, reverse=False), "judgment-graph")  # read for nodes and for edges
    types = ("case", "legislation", "subject_matter")
    rank = lambda c: reduce(lambda a, i: a.when(F.col(c) == types[i], i), range(1, len(types)), F.when(F.col(c) == types[0], 0))
    ends = graph.select(F.explode(F.array(*[F.struct(F.col(end).alias("id"), rank(kind).alias("rank")) for end, kind in (("source", "src_type"), ("target", "dst_type"))])).alias("e"))
    nodes = ends.groupBy("e.id").agg(F.max("e.rank").alias("rank"))
    return nodes.select("id", F.element_at(F.array(*map(F.lit, types)), F.col("rank") + 1).alias("type")), simple_graph(graph)


def paragraph_pairs(doc_citations: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """(source, target) paragraphs: every paragraph of a citing document with every paragraph of the cited one. paragraphs(doc, para)."""
    a = paragraphs.select(F.col("doc").alias("source_doc"), F.col("para").alias("a"))
    b = paragraphs.select(F.col("doc").alias("target_doc"), F.col("para").alias("b"))
    pairs = doc_citations.select(F.col("source").alias("source_doc"), F.col("target").alias("target_doc")).distinct()
    return pairs.join(a, "source_doc").join(b, "target_doc").select(F.col("a").alias("source"), F.col("b").alias("target")).dropDuplicates()


def paragraph_legislation(citations: DataFrame, paragraphs: DataFrame, parts: int = 0) -> DataFrame:
    """(source, target): every paragraph of a document with all legislation the document cites."""
    p = dealt(paragraphs.select(F.col("doc").alias("source_doc"), F.col("para").alias("a")), parts, "source_doc")
    cited = dealt(citations.select(F.col("source").alias("source_doc"), "target"), parts, "source_doc")
    met = (cited.hint("merge") if parts else cited).join(p, "source_doc").select(F.col("a").alias("source"), "target")
    return dealt(met, parts, "source", "target").dropDuplicates()


def paragraph_graph(citations: DataFrame, paragraph_articles: DataFrame, article_legislation: DataFrame, judgments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, simple edges) over paragraphs, articles and sector-3 legislation.

    paragraph_articles(paragraph, article); article_legislation(article, legislation). A paragraph's document is what follows its
    last underscore. Legislation that only an article names is a node with its type.
    """
    paragraphs = paragraph_articles.select(F.col("paragraph").alias("para"), last_segment(F.col("paragraph"), "_").alias("doc")).distinct()
    cited = citations.where(is_case(F.col("source")))
    cc = within(within(cited.where(is_case(F.col("target"))), judgments, "source"), judgments, "target").dropDuplicates()
    cl = within(cited.where(is_legislation(F.col("target"), ("3",))), judgments, "source").dropDuplicates()
    ll = citations.where(is_legislation(F.col("source"), ("3",)) & is_legislation(F.col("target"), ("3",))).dropDuplicates()
    al = article_legislation.select(F.col("article").alias("source"), F.col("legislation").alias("target")).distinct()
    pa = paragraph_articles.select(F.col("paragraph").alias("source"), F.col("article").alias("target")).distinct()
    sets = {("article", "legislation"): al, ("paragraph", "article"): pa, ("paragraph", "paragraph"): paragraph_pairs(cc, paragraphs), ("paragraph", "legislation"): paragraph_legislation(cl, paragraphs), ("legislation", "legislation"): ll}
    graph = reduce(DataFrame.unionByName, (_typed(e.select("source", "target"), (s, "to", t)) for (s, t), e in sets.items()))
    rank = F.when(F.col("type") == "paragraph", 0).when(F.col("type") == "article", 1).otherwise(2)
    return nodes_of(graph).groupBy("id").agg(F.max_by("type", rank).alias("type")), simple_graph(graph)


def uses_paragraphs(metapaths: list[list[str]]) -> bool:
    """Whether a walk plan needs the paragraph graph."""
    return any("paragraph" in path for path in metapaths)


def typed_neighbours(nodes: DataFrame, simple: DataFrame) -> DataFrame:
    """(node, node_type, nbr, nbr_type), each neighbour once."""
    n, m = nodes.select(F.col("id").alias("node"), F.col("type").alias("node_type")), nodes.select(F.col("id").alias("nbr"), F.col("type").alias("nbr_type"))
    return both_ways(simple).join(n, "node").join(m, "nbr").select("node", "node_type", "nbr", "nbr_type")


def neighbours_by_type(nodes: DataFrame, simple: DataFrame) -> DataFrame:
    """(node, nbr_type, nbrs sorted). For hubs use numbered_neighbours, which never gathers a node's neighbours into one value."""
    return typed_neighbours(nodes, simple).groupBy("node", "nbr_type").agg(F.sort_array(F.collect_list("nbr")).alias("nbrs"))


def numbered_neighbours(nodes: DataFrame, simple: DataFrame) -> DataFrame:
    """(node, nbr_type, pos, degree, nbr): neighbours of a type numbered from 0 in sorted order."""
    return numbered(typed_neighbours(nodes, simple).select("node", "nbr_type", "nbr"), ["node", "nbr_type"], "nbr").select("node", "nbr_type", "pos", "degree", "nbr")


def drawn(size: Column, *key: Column) -> Column:
    """A position below size, decided by a hash of key: uniform, and the same on every run."""
    return F.pmod(F.xxhash64(*key), size)


def walks(nodes: DataFrame, simple: DataFrame, metapath: list[str], per_node: int, seed: int = 0) -> DataFrame:
    """(start, walk, path): from each node of the path's first type, per_node walks that take a uniform neighbour of each next type.

    A walk stops where there is none; walks of one node stay. One join a step, on (node, type, position).
    """
    # Only neighbours that some step may take are numbered.
    taken = reduce(lambda x, y: x | y, ((F.col("node_type") == a) & (F.col("nbr_type") == b) for a, b in zip(metapath, metapath[1:])), F.lit(False))
    near = typed_neighbours(nodes, simple).where(taken).select("node", "nbr_type", "nbr")
    near = settle(numbered(near, ["node", "nbr_type"], "nbr"), "neighbours")
    degrees = near.where("pos = 0").select(F.col("node").alias("d_node"), F.col("nbr_type").alias("d_type"), "degree")
    steps = near.select(F.col("node").alias("s_node"), F.col("nbr_type").alias("s_type"), F.col("pos").alias("s_pos"), F.col("nbr").alias("s_nbr"))
    now = nodes.where(F.col("type") == metapath[0]).select(F.col("id").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(per_node - 1))).alias("walk"))
    now = now.withColumns({"at": F.col("start"), "path": F.array("start")})
    for k, kind in enumerate(metapath[1:], 1):
        now = now.join(degrees, (F.col("at") == F.col("d_node")) & (F.col("d_type") == kind), "left").drop("d_node", "d_type")
        now = now.withColumn("pick", F.when(F.col("degree").isNotNull(), drawn(F.col("degree"), F.lit(seed), F.col("start"), F.col("walk"), F.lit(k))))
        now = now.join(steps, (F.col("at") == F.col("s_node")) & (F.col("s_type") == kind) & (F.col("pick") == F.col("s_pos")), "left")
        path = F.when(F.col("s_nbr").isNotNull(), F.concat("path", F.array("s_nbr"))).otherwise(F.col("path"))
        now = now.select("start", "walk", F.col("s_nbr").alias("at"), path.alias("path"))
    return now.select("start", "walk", "path")


class Halves(NamedTuple):
    """Pairs of starts that share an end, as the distinct (start, end) they come from."""

    edges: DataFrame

    def pairs(self) -> DataFrame:
        """Distinct (start, end); pairs of a start with itself count."""
        return self.edges.join(self.edges.select(F.col("start").alias("other"), "end"), "end").select("start", F.col("other").alias("end")).distinct()


def is_palindrome(relations: list[Relation]) -> bool:
    """Whether the second half of a path is the first one reversed."""
    n = len(relations)
    return n > 0 and n % 2 == 0 and all(REVERSED.get(relations[i]) == relations[-1 - i] or REVERSED.get(relations[-1 - i]) == relations[i] for i in range(n // 2))


def metapath_halves(graph: DataFrame, relations: list[Relation]) -> Halves | DataFrame:
    """metapath_pairs() for readers that can do without the pairs of a palindrome; the pairs of other paths."""
    return Halves(metapath_pairs(graph, relations[: len(relations) // 2])) if is_palindrome(relations) else metapath_pairs(graph, relations)


def metapath_pairs(graph: DataFrame, relations: list[Relation]) -> DataFrame:
    """Distinct (start, end) joined by a path of the given relations; pairs of a node with itself count.

    A palindrome of reversed relations is halved: pairs(H) joined with itself on the middle, one shuffle key instead of a chain.
    """
    if is_palindrome(relations):
        half = len(relations) // 2
        h = metapath_pairs(graph, relations[:half])
        return Halves(settle(h, "metapath") if half > 1 else h).pairs()
    pairs = of_relation(graph, relations[0]).select(F.col("source").alias("start"), F.col("target").alias("end")).distinct()
    for relation in relations[1:]:
        hop = of_relation(graph, relation)
        pairs = pairs.join(hop, pairs.end == hop.source).select("start", F.col("target").alias("end")).distinct()
    return pairs


def neighbourhood(citations: DataFrame, sources: DataFrame, cites_depth: int = 1, cited_depth: int = 1) -> DataFrame:
    """(source, id): what each of sources(id) cites within cites_depth hops and is cited by within cited_depth, distinct.

    On a cycle the source itself is reached and reported. A depth of 0 leaves that direction out.
    """
    found = []
    for depth, a, b in ((cites_depth, "source", "target"), (cited_depth, "target", "source")):
        step = citations.select(F.col(a).alias("from"), F.col(b).alias("to")).distinct()
        front = sources.select(F.col("id").alias("source"), F.col("id").alias("at"))
        for _ in range(depth):
            front = front.join(step, front.at == step["from"]).select("source", F.col("to").alias("at")).distinct()
            found.append(front.select("source", F.col("at").alias("id")))
    if not found:
        return sources.select(F.col("id").alias("source"), "id").limit(0)
    return reduce(DataFrame.unionByName, found).distinct()


def sampled_in_edges(edges: DataFrame, fan_out: int, seed: int = 0) -> DataFrame:
    """(source, target, draw): fan_out in-edges of every target, with replacement; targets without in-edges give none."""
    near = settle(numbered(edges.select("target", "source"), ["target"], "source"), "in-edges")
    picks = near.where("pos = 0").select("target", "degree", F.explode(F.sequence(F.lit(0), F.lit(fan_out - 1))).alias("draw"))
    picks = picks.withColumn("pos", drawn(F.col("degree"), F.lit(seed), F.col("target"), F.col("draw")))
    return picks.join(near.drop("degree"), ["target", "pos"]).select("source", "target", "draw")


def code_hierarchy(codes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes(id), edges(source parent, target child)) of dotted codes(code): numeric roots only, edges where the parent is a code too."""
    nodes = codes.where(is_numeric_root(F.col("code"))).select(F.col("code").alias("id")).distinct()
    edges = nodes.select(code_parent(F.col("id")).alias("source"), F.col("id").alias("target")).where("source is not null")
    return nodes, within(edges, nodes, "source")
