"""Registered queries over the driver's tables, each with SQL where SQL can say it."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.vectors import cosine
from ..operators import encoders, explain, graph, hierarchy, html, network, pathexpr, pivots, search, skipgram, tfidf, training
from ..operators import paragraphs as P
from ..operators.pathexpr import step
from ..storage import discard, settle, shared_dir
from ..streaming import metapaths
from .fixtures import SQL, Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "rrf_fusion"

CLC = [("case", "cites", "legislation"), ("legislation", "cited_by", "case")]
CSC = [("case", "has_subject", "subject_matter"), ("subject_matter", "related_to", "case")]
CLLC = [("case", "cites", "legislation"), ("legislation", "cites", "legislation"), ("legislation", "cited_by", "case")]
TOP, EVERY = 10, 50


def query(sql: str | None = None, prelude: bool = True):
    """Register a query under its function's name; sql goes after the fixtures' common table expressions unless prelude is false."""

    def add(run: Callable[[Corpus], DataFrame]):
        QUERIES[run.__name__] = lambda spark, sf_dir: run(Corpus(spark, sf_dir))
        if sql:
            ORACLE[run.__name__] = f"WITH {SQL.strip()}\n{sql.strip()}" if prelude else sql.strip()
        return run

    return add


def typed(c: Corpus) -> DataFrame:
    return graph.typed_graph(c.citations(), c.subjects(), c.case_ids(), c.leg_ids(), parts=c.parts())


def whole(c: Corpus) -> DataFrame:
    """The same rows as typed(), for readers of every relation."""
    return graph.whole_graph(c.citations(), c.subjects(), c.case_ids(), c.leg_ids(), parts=c.parts())


def kept(c: Corpus) -> DataFrame:
    """whole(), written once for queries that read it more than once; reversed edges are made when it is read."""
    return graph.with_reversed(settle(graph.whole_graph(c.citations(), c.subjects(), c.case_ids(), c.leg_ids(), reverse=False, parts=c.parts()), "graph"))


def relation(c: Corpus, k: int) -> DataFrame:
    r = graph.FORWARD[k]
    cited = {0: c.case_cases, 1: c.case_acts, 3: c.act_acts}.get(k, c.subjects)()
    return graph.citation_edges(cited, r, c.case_ids(), c.leg_ids(), c.parts())


@query("SELECT source, target FROM cc")
def case_case_edges(c):
    return relation(c, 0)


@query("SELECT source, target FROM cl")
def case_leg_edges(c):
    return relation(c, 1)


@query("SELECT source, target FROM cs")
def case_subject_edges(c):
    return relation(c, 2)


@query("SELECT source, target FROM ll")
def leg_leg_edges(c):
    return relation(c, 3)


@query("SELECT source, target FROM ls")
def leg_subject_edges(c):
    return relation(c, 4)


@query("SELECT * FROM graph WHERE (src_type, rel) IN (('legislation', 'cited_by'), ('subject_matter', 'related_to'))")
def reverse_edges(c):
    return whole(c).where((F.col("rel") == "cited_by") | (F.col("rel") == "related_to"))


@query("SELECT type, id, idx FROM idx")
def node_index(c):
    """Reversed edges and repeats have the same nodes."""
    return graph.dense_index(graph.nodes_of(graph.whole_graph(c.citations(), c.subjects(), c.case_ids(), c.leg_ids(), reverse=False, parts=c.parts(), repeats=True)))


@query("SELECT src_type, rel, dst_type, s.idx AS src, d.idx AS dst FROM graph JOIN idx s ON s.type = src_type AND s.id = source JOIN idx d ON d.type = dst_type AND d.id = target")
def encoded_edges(c):
    g = kept(c)
    return graph.encode(g, graph.dense_index(graph.nodes_of(g)))


@query("SELECT DISTINCT least(source, target) AS a, greatest(source, target) AS b FROM (SELECT source, target FROM graph)")
def undirected_simpletyped(c):
    return graph.judgment_graph(c.citations(), c.subjects(), c.case_ids())[1]


@query("""
, e AS (SELECT DISTINCT source AS node, target AS nbr FROM graph UNION SELECT target, source FROM graph)
SELECT node, n.type AS nbr_type, count(*) AS n, min(nbr) AS first, max(nbr) AS last FROM e JOIN nodes n ON n.id = nbr GROUP BY ALL
""")
def neighbors_by_type(c):
    nodes, edges = graph.judgment_graph(c.citations(), c.subjects(), c.case_ids())
    got = graph.numbered_neighbours(nodes, edges)
    return got.groupBy("node", "nbr_type").agg(F.max("degree").alias("n"), F.min("nbr").alias("first"), F.max("nbr").alias("last"))


@query('SELECT DISTINCT a.source AS start, b.source AS "end" FROM cl a JOIN cl b USING (target)')
def metapath_case_leg_case(c):
    return graph.metapath_pairs(typed(c), CLC)


def never(edges: DataFrame) -> DataFrame:
    """As many edges to acts that aren't there, each of which has as many as its act: a few hubs would have the square of all edges as paths."""
    return edges.select("source", F.concat(F.lit("never "), "target").alias("target"))


@query('SELECT a.source AS start, b.source AS "end", count(*) AS n FROM cl a JOIN cl b USING (target) GROUP BY ALL')
def maintained_metapath(c):
    """The same pairs and their path counts, after half the citations, then the rest, then the withdrawal of what never held."""
    folder = f"{shared_dir(c.spark)}/lexweave/metapath-{uuid.uuid4().hex}"
    cited = settle(relation(c, 1), "cited")
    half = F.pmod(F.xxhash64("source"), F.lit(2)) == 0
    false = never(cited.where(half))
    for k, (edges, added) in enumerate(((cited.where(half).unionByName(false), True), (cited.where(~half), True), (false, False))):
        changes = edges.select(F.lit("cites").alias("label"), "source", "target", F.lit(added).alias("added"), F.lit(k).cast("long").alias("seq"))
        metapaths.merge(changes, k, folder, [("cites", False), ("cites", True)])
    return metapaths.pairs(c.spark, folder)


@query('SELECT DISTINCT a.source AS start, b.source AS "end" FROM cs a JOIN cs b USING (target)')
def metapath_case_subject_case(c):
    return graph.metapath_pairs(typed(c), CSC)


@query('SELECT DISTINCT a.source AS start, b.source AS "end" FROM cl a JOIN ll ON a.target = ll.source JOIN cl b ON b.target = ll.target')
def metapath_case_leg_leg_case(c):
    return graph.metapath_pairs(typed(c), CLLC)


@query("""
, e AS (SELECT DISTINCT source, target FROM citations)
SELECT source, target AS id FROM e WHERE source IN (SELECT id FROM case_node)
UNION SELECT a.source, b.target FROM e a JOIN e b ON a.target = b.source WHERE a.source IN (SELECT id FROM case_node)
UNION SELECT target, source FROM e WHERE target IN (SELECT id FROM case_node)
""")
def citation_khop(c):
    return graph.neighbourhood(c.citations(), c.case_ids(), 2, 1)


_CODES = """codes AS (
  SELECT substr(p_brand, 7, 1) || '.' || substr(p_brand, 8, 1) || '.' || p_size AS code FROM part
  UNION ALL SELECT substr(p_brand, 7, 1) || '.' || substr(p_brand, 8, 1) FROM part WHERE p_size > 25
  UNION ALL SELECT substr(p_brand, 7, 1) FROM part WHERE p_size > 10 UNION ALL SELECT p_brand || '.1' FROM part),
n AS (SELECT DISTINCT code FROM codes WHERE regexp_matches(split_part(code, '.', 1), '^[0-9]+$')),
narrower AS (SELECT regexp_replace(code, '\\.[^.]*$', '') AS source, code AS target FROM n WHERE contains(code, '.') AND regexp_replace(code, '\\.[^.]*$', '') IN (SELECT code FROM n))""".replace("\\\\", "\\")


@query(f", {_CODES} SELECT source, target FROM narrower")
def code_hierarchy(c):
    brand = F.concat(F.substring("p_brand", 7, 1), F.lit("."), F.substring("p_brand", 8, 1))
    codes = c.part.select(F.concat(brand, F.lit("."), F.col("p_size").cast("string")).alias("code"))
    codes = codes.union(c.part.where("p_size > 25").select(brand)).union(c.part.where("p_size > 10").select(F.substring("p_brand", 7, 1))).union(c.part.select(F.concat("p_brand", F.lit(".1"))))
    return graph.code_hierarchy(codes)[1]


@query(f"WITH RECURSIVE {_CODES}, below AS (SELECT source, target FROM narrower UNION SELECT b.source, n.target FROM below b JOIN narrower n ON n.source = b.target) SELECT source AS start, target AS \"end\" FROM below", prelude=False)
def code_descendants(c):
    """Every code with all codes below it, at any depth."""
    edges = code_hierarchy(c)
    labelled = edges.select("source", F.lit("narrower").alias("label"), "target")
    return pathexpr.reach(labelled, edges.select(F.col("source").alias("id")), step("narrower").times(1))


@query("""
, pp AS (SELECT '6' || o_custkey AS doc, '6' || o_orderkey AS para FROM orders),
dc AS (SELECT DISTINCT '6' || a.c_custkey AS source, '6' || b.c_custkey AS target FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 AND a.c_nationkey <= b.c_nationkey)
SELECT DISTINCT x.para AS source, y.para AS target FROM dc JOIN pp x ON x.doc = dc.source JOIN pp y ON y.doc = dc.target
""")
def para_para_edges(c):
    paras = c.orders.select(F.concat(F.lit("6"), F.col("o_custkey").cast("string")).alias("doc"), F.concat(F.lit("6"), F.col("o_orderkey").cast("string")).alias("para"))
    a = c.customer.select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("n"))
    b = c.customer.select((F.col("c_custkey") - 1).alias("k"), F.col("c_custkey").alias("next"), F.col("c_nationkey").alias("m"))
    cites = a.join(b, "k").where("n <= m").select(F.concat(F.lit("6"), F.col("k").cast("string")).alias("source"), F.concat(F.lit("6"), F.col("next").cast("string")).alias("target"))
    return graph.paragraph_pairs(cites, paras)


@query("""
, pp AS (SELECT '6' || o_orderkey AS doc, '6' || o_orderkey || '_' || l_linenumber AS para FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
SELECT DISTINCT para AS source, target FROM cl JOIN pp ON doc = source
""")
def para_leg_edges(c):
    doc = F.concat(F.lit("6"), F.col("l_orderkey").cast("string"))
    paras = c.lineitem.select(doc.alias("doc"), F.concat(doc, F.lit("_"), F.col("l_linenumber").cast("string")).alias("para"))
    return graph.paragraph_legislation(relation(c, 1), graph.within(paras, c.case_ids(), "doc", c.parts()), c.parts())


@query("SELECT celex, seq, para, text FROM filled")
def paragraph_ffill(c):
    return P.fill_numbers(c.paragraphs()).select("celex", "seq", "para", "text")


@query("SELECT celex, key, text, seq FROM keys")
def paragraph_keys(c):
    return P.keyed(P.fill_numbers(c.paragraphs())).select("celex", "key", "text", "seq")


@query("SELECT celex, key FROM keys WHERE len(string_split(key, '_')) = 3")
def operative_only(c):
    return P.operative_only(P.keyed(P.fill_numbers(c.paragraphs()))).select("celex", "key")


@query("SELECT celex, string_agg(text, ' ' ORDER BY group_seq, seq, text) AS text FROM keys GROUP BY celex")
def article_concat(c):
    return P.articles(P.keyed(P.fill_numbers(c.paragraphs())))


@query("""
, i AS (SELECT *, sum(CASE WHEN para_num IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY celex ORDER BY seq) AS island FROM paras)
SELECT celex, min(seq) AS seq, max(para_num) AS para_num, string_agg(text, ' ' ORDER BY seq) AS text FROM i WHERE island > 0 GROUP BY celex, island
""")
def continuation_merge(c):
    return P.merge_continuations(c.paragraphs().withColumn("is_header", F.col("para_num").isNotNull()))


def _sql_clean(c: str) -> str:
    c = f"replace({c}, chr(160), ' ')"
    for p in X.CITATIONS:
        c = f"regexp_replace({c}, '{p.replace(chr(92) + 'd', '\\p{Nd}')}', '', 'g')"
    space = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
    c = f"replace({c}, '…', '')"
    c = f"regexp_replace({c}, '[^\\p{{L}}\\p{{N}}_.{space}]', '', 'g')"
    c = f"regexp_replace(replace(regexp_replace({c}, '\\p{{Nd}}+', '', 'g'), 'TFEU', ''), '\\n', ' ', 'g')"
    return f"regexp_replace(regexp_replace(regexp_replace({c}, '  +', ' ', 'g'), '^[{space}]+', ''), '[{space}]+$', '')"


@query(f"SELECT doc_id, {_sql_clean('text')} AS text FROM documents", prelude=False)
def text_clean_no_dedupe(c):
    return c.documents.select("doc_id", X.clean(F.col("text"), collapse=False).alias("text"))


@query()
def text_clean(c):
    return c.documents.select("doc_id", X.clean(F.col("text")).alias("text"))


@query(
    r"""
, t AS (SELECT CAST(conv_id AS VARCHAR) AS celex, turn, turn // 3 + 1 AS para, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM conversations)
SELECT celex, para || '_' || celex AS key, string_agg(text, ' ' ORDER BY turn) AS text FROM t GROUP BY celex, para
"""
)
def html_case_paragraphs(c):
    """Conversations printed as pages of the table layout, then read back: every third turn begins a paragraph, the others continue it."""
    said = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    numbered = F.concat(F.lit('<table><col width="5%"><col width="95%"><tr><td>'), F.expr("turn div 3 + 1").cast("string"), F.lit("</td><td>"), said, F.lit("</td></tr></table>"))
    more = F.concat(F.lit("<table><tr><td>"), said, F.lit("</td></tr></table>"))
    tables = c.conversations.select(F.col("conv_id").cast("string").alias("celex"), "turn", F.when(F.col("turn") % 3 == 0, numbered).otherwise(more).alias("t"))
    page = tables.groupBy("celex").agg(F.sort_array(F.collect_list(F.struct("turn", "t"))).alias("x"))
    page = page.select("celex", F.concat(F.lit('<html><body><p class="sum-title-1"></p>'), F.array_join(F.transform("x", lambda r: r["t"]), ""), F.lit("</body></html>")).alias("body"))
    return html.case_paragraphs(page, process=False).select("celex", "key", "text")


_PUNCTUATION = string.punctuation.replace("'", "''")
STOP = X.stop_words()
_LISTED = ", ".join(f"'{w}'" for w in STOP)
TERMS_SQL = f"""
split AS (SELECT doc_id AS doc, string_split_regex(translate(lower(text), '{_PUNCTUATION}', ''), '[\\t-\\r\\x1c-\\x20\\x{{85}}\\x{{a0}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+') AS list FROM documents),
t AS (SELECT doc, unnest(list) AS term, unnest(range(len(list))) AS place FROM split),
words AS (SELECT * FROM t WHERE length(term) > 1 AND term NOT IN ({_LISTED})),
tf AS (SELECT doc, term, count(*) AS tf FROM words GROUP BY doc, term),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
n AS (SELECT count(*) AS n FROM documents),
voc AS (SELECT term, df, ln((1.0e0 + n) / (1.0e0 + df)) + 1.0e0 AS idf FROM df, n WHERE df >= 2 AND df <= 0.95e0 * n),
raw AS (SELECT doc, term, tf * idf AS w FROM tf JOIN voc USING (term)),
weights AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS weight FROM raw)
"""


def dealt_texts(c: Corpus) -> DataFrame:
    """Documents dealt by id before their texts are taken apart: one row group of a file would be one task's work, and a document's terms are counted where it lies."""
    return c.documents.select("doc_id", "text").repartition("doc_id")


def counted_terms(c: Corpus) -> DataFrame:
    return tfidf.term_counts(dealt_texts(c).select("doc_id", X.terms(F.col("text"), STOP).alias("terms")), "doc_id", "terms")


def _weights(c: Corpus) -> DataFrame:
    counts = settle(counted_terms(c), "term-counts")  # fitting and transforming both read it
    return tfidf.transform(counts, tfidf.fit(counts, c.documents.count()))


@query(f"WITH {TERMS_SQL} SELECT term, df FROM df", prelude=False)
def doc_frequency(c):
    return tfidf.document_frequency(counted_terms(c))


@query(f"WITH {TERMS_SQL} SELECT doc, term, round(weight, 6) AS weight FROM weights", prelude=False)
def tfidf_weights(c):
    return _weights(c).select("doc", "term", F.round("weight", 6).alias("weight"))


def _dense_sql(asked: str) -> str:
    return f"""
dense AS (SELECT query_id, rank, id, score FROM (
  SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 12) DESC, v.vec_id) AS rank
  FROM embeddings q, embeddings v WHERE {asked}q.vec_id <> v.vec_id) WHERE rank <= {TOP})
"""


def _sparse_sql(asked: str) -> str:
    return f"""
s AS (SELECT q.doc AS query_id, v.doc AS id, sum(q.weight * v.weight) AS score FROM weights q JOIN weights v USING (term) WHERE {asked}q.doc <> v.doc GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank, id, score FROM s) WHERE rank <= {TOP})
"""


_DENSE, _SPARSE = _dense_sql(f"q.vec_id % {EVERY} = 0 AND "), _sparse_sql(f"q.doc % {EVERY} = 0 AND ")


def _dense(c: Corpus, every: int = EVERY) -> DataFrame:
    vectors = search.index(c.embeddings, "vec_id", "embedding")
    return search.top_k(vectors.where(F.col("id") % every == 0), vectors, TOP)


def _sparse(c: Corpus, every: int = EVERY) -> DataFrame:
    counts = settle(counted_terms(c), "term-counts")
    weights = tfidf.transform(counts, tfidf.fit(counts, c.documents.count()))
    got = tfidf.sparse_top_k(weights, c.documents.where(F.col("doc_id") % every == 0).select(F.col("doc_id").alias("id")), TOP)
    discard(counts)  # the documents' vectors are written by now
    return got


@query(f"WITH {_DENSE} SELECT query_id, rank, id, round(score, 6) AS score FROM dense", prelude=False)
def cosine_topk(c):
    return _dense(c).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(f"WITH {_DENSE} SELECT query_id, rank, id, round(score, 6) AS score FROM dense", prelude=False)
def indexed_topk(c):
    """The same from an index that is written once and asked."""
    path = f"{shared_dir(c.spark)}/lexweave/index-{uuid.uuid4().hex}"
    pivots.build(c.embeddings, "vec_id", "embedding", path)
    asked = c.embeddings.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return pivots.Index(c.spark, path).nearest(asked, TOP)[0].select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(f"WITH {TERMS_SQL}, {_SPARSE} SELECT query_id, rank, id, round(score, 6) AS score FROM sparse", prelude=False)
def tfidf_topk(c):
    return _sparse(c).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {TERMS_SQL}, {_sparse_sql("")}, {_dense_sql("")},
lists AS (SELECT query_id, 0 AS list_id, rank, id FROM sparse UNION ALL SELECT query_id, 1, rank, id FROM dense),
f AS (SELECT query_id, id AS doc, sum(CASE list_id WHEN 0 THEN 1.0e0 ELSE 0.5e0 END / (60.0e0 + rank)) AS score, min(list_id * 1000000 + rank) AS met FROM lists GROUP BY ALL)
SELECT query_id, doc, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, met) AS rank FROM f""",
    prelude=False,
)
def rrf_fusion(c):
    """Every document and every vector is a query."""
    lists = _sparse(c, 1).select("query_id", F.lit(0).alias("list_id"), "rank", F.col("id").alias("doc"))
    lists = lists.unionByName(_dense(c, 1).select("query_id", F.lit(1).alias("list_id"), "rank", F.col("id").alias("doc")))
    lists = settle(lists, "ranked-lists")  # fusion reads them twice
    return search.fuse(lists, [1.0, 0.5]).select("query_id", "doc", F.round("score", 9).alias("score"), "rank")


@query(
    """
WITH t AS (SELECT doc_id, list_concat([101], list_transform(string_split_regex(text, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda w: length(w) + 1)) AS ids FROM documents),
p AS (SELECT doc_id, ids, len(ids) - 1 AS rest FROM t),
q AS (SELECT *, CAST(ceil((rest + CAST(trunc((rest - 63) / 57.0e0) AS INTEGER) * 6) / 63.0e0) AS INTEGER) * 63 AS total FROM p),
r AS (SELECT doc_id, ids, rest, total, unnest(range(0, CASE WHEN rest + 1 <= 64 THEN 1 ELSE (total - 63) // 57 + 1 END)) AS chunk FROM q)
SELECT doc_id, chunk::BIGINT AS chunk,
  (CASE WHEN rest + 1 <= 64 THEN rest + 1 ELSE least(63, greatest(0, rest - chunk * 57)) + (CASE WHEN rest > chunk * 57 THEN 1 ELSE 0 END) END)::BIGINT AS real,
  (CASE WHEN rest + 1 <= 64 THEN list_sum(ids) ELSE coalesce(list_sum(ids[2 + chunk * 57 : 64 + chunk * 57]), 0) + (CASE WHEN rest > chunk * 57 THEN 101 ELSE 0 END) END)::BIGINT AS total
FROM r
""",
    prelude=False,
)
def chunk_overlap(c):
    words = F.split("text", r"[ \t\n\r\x0b\x0c]+")
    ids = F.concat(F.array(F.lit(encoders.CLS)), F.transform(words, lambda w: F.length(w) + 1))
    got = c.documents.select("doc_id", F.explode(encoders.chunks(ids, 64)).alias("c"))
    add = lambda col: F.aggregate(col, F.lit(0).cast("long"), lambda a, x: a + x)
    return got.select("doc_id", F.col("c.chunk").cast("long").alias("chunk"), add("c.mask").alias("real"), add("c.ids").alias("total"))


_TOKENS = "tok AS (SELECT label AS doc, vec_id AS token, (vec_id % 3 > 0)::INTEGER AS mask, unnest(embedding)::DOUBLE AS x, unnest(range(1, 65)) AS dim FROM embeddings)"


def _tokens(c: Corpus) -> DataFrame:
    got = c.embeddings.select(F.col("label").alias("doc"), F.col("vec_id").alias("token"), (F.col("vec_id") % 3 > 0).cast("int").alias("mask"), F.posexplode("embedding").alias("p", "x"))
    return got.select("doc", "token", "mask", F.col("x").cast("double").alias("x"), (F.col("p") + 1).cast("long").alias("dim"))


@query(f"WITH {_TOKENS} SELECT doc, dim, round(sum(mask * x) / greatest(sum(mask), 1e-9), 6) AS pooled FROM tok GROUP BY doc, dim", prelude=False)
def masked_mean_pool(c):
    return encoders.mean_pool(_tokens(c), ["doc"]).select("doc", "dim", F.round("pooled", 6).alias("pooled"))


@query(f"WITH {_TOKENS} SELECT doc, dim, round(max(CASE WHEN mask = 1 THEN x ELSE -1e9 END), 6) AS pooled FROM tok GROUP BY doc, dim", prelude=False)
def masked_max_pool(c):
    return encoders.max_pool(_tokens(c), ["doc"]).select("doc", "dim", F.round("pooled", 6).alias("pooled"))


@query("""
, p AS (SELECT DISTINCT a.source AS s, b.source AS e FROM cl a JOIN cl b USING (target)),
o AS (SELECT s, count(*) AS n FROM p GROUP BY s), i AS (SELECT e, count(*) AS n FROM p GROUP BY e),
f AS (SELECT '6' || o_orderkey AS node, o_totalprice::DOUBLE / 1e5 AS x FROM orders)
SELECT f.node, round(coalesce(g.h, 0), 5) AS h0, round(coalesce(g.k, 0), 5) AS h1 FROM f LEFT JOIN (
  SELECT p.e AS node, sum(f.x / sqrt(o.n)) / sqrt(any_value(i.n)) AS h, sum(1.0e0 / sqrt(o.n)) / sqrt(any_value(i.n)) AS k
  FROM p JOIN o ON o.s = p.s JOIN i ON i.e = p.e JOIN f ON f.node = p.s GROUP BY p.e) g ON g.node = f.node
""")
def gcn_norm_aggregate(c):
    features = c.orders.select(F.concat(F.lit("6"), F.col("o_orderkey").cast("string")).alias("node"), F.array(F.col("o_totalprice").cast("double") / 1e5, F.lit(1.0)).alias("vec"))
    got = network.convolve(graph.metapath_halves(typed(c), CLC), features, 2)
    return got.select("node", F.round(F.col("vec")[0], 5).alias("h0"), F.round(F.col("vec")[1], 5).alias("h1"))


@query("""
, e AS (SELECT source AS src, target AS dst, ln(1 + o_totalprice::DOUBLE / 1e5) AS e FROM cl JOIN orders ON source = '6' || o_orderkey),
x AS (SELECT src, dst, exp(e - max(e) OVER (PARTITION BY dst)) AS x FROM e)
SELECT src, dst, round(x / sum(x) OVER (PARTITION BY dst), 6) AS alpha FROM x
""")
def gat_edge_softmax(c):
    score = c.orders.select(F.concat(F.lit("6"), F.col("o_orderkey").cast("string")).alias("src"), F.log(1 + F.col("o_totalprice").cast("double") / 1e5).alias("e"))
    edges = relation(c, 1).select(F.col("source").alias("src"), F.col("target").alias("dst")).join(score, "src")
    return network.edge_softmax(edges).select("src", "dst", F.round("alpha", 6).alias("alpha"))


_HALVES = "h AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings)"


def _halves(c: Corpus) -> tuple[DataFrame, DataFrame]:
    return tuple(search.index(c.embeddings.select("vec_id", F.slice("embedding", at, 32).alias("v")), "vec_id", "v") for at in (1, 33))


@query(
    f"""WITH {_HALVES}, s AS (SELECT x.vec_id AS i, y.vec_id AS j, exp(list_cosine_similarity(x.a, y.b) / 0.5e0) AS s FROM h x, h y),
r AS (SELECT i, sum(s) AS t, sum(CASE WHEN i = j THEN s END) AS m FROM s GROUP BY i), k AS (SELECT j, sum(s) AS t, sum(CASE WHEN i = j THEN s END) AS m FROM s GROUP BY j)
SELECT round(0.5e0 * (SELECT avg(-ln(m / (t + 1e-8))) FROM r) + 0.5e0 * (SELECT avg(-ln(m / (t + 1e-8))) FROM k), 6) AS loss""",
    prelude=False,
)
def contrastive_loss(c):
    return network.contrast_loss_blocks(*_halves(c)).select(F.round("loss", 6).alias("loss"))


_W, _B, _Q = np.cos(np.arange(128.0)).round(3).reshape(64, 2), np.array([0.1, -0.2]), np.array([1.5, -0.75])
_HIDDEN = [f"tanh({_B[j]}::DOUBLE + list_dot_product(vec, {_W[:, j].tolist()}::DOUBLE[]))" for j in range(2)]


@query(
    f"""WITH v AS (SELECT unnest(['a', 'b', 'c']) AS view, vec_id AS node, unnest([embedding, list_reverse(embedding), list_transform(embedding, lambda x: x * x)])::DOUBLE[] AS vec FROM embeddings),
m AS (SELECT view, avg({_HIDDEN[0]}) AS p, avg({_HIDDEN[1]}) AS q FROM v GROUP BY view),
e AS (SELECT view, exp(1.5e0 * p - 0.75e0 * q) AS e FROM m), s AS (SELECT view, e / sum(e) OVER () AS share FROM e),
u AS (SELECT node, unnest(vec) * share AS x, unnest(range(1, 65)) AS dim FROM v JOIN s USING (view))
SELECT node, dim, round(sum(x), 5) + 0.0e0 AS x FROM u GROUP BY node, dim""",
    prelude=False,
)
def semantic_attention(c):
    vec = F.col("embedding")
    views = [c.embeddings.select(F.lit(n).alias("view"), F.col("vec_id").alias("node"), v.cast("array<double>").alias("vec")) for n, v in (("a", vec), ("b", F.reverse(vec)), ("c", F.transform(vec, lambda x: x * x)))]
    got = network.semantic_attention(views[0].unionByName(views[1]).unionByName(views[2]), _W, _B, _Q)
    return got.select("node", F.posexplode("vec").alias("at", "x")).select("node", (F.col("at") + 1).cast("long").alias("dim"), (F.round("x", 5) + 0.0).alias("x"))


_PAIRS = "z AS (SELECT label AS pair, vec_id AS token, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT a.pair, a.token AS i, b.token AS j, list_dot_product(a.v, b.v) AS d FROM z a JOIN z b ON a.pair = b.pair AND a.token % 2 = 0 AND b.token % 2 = 1)"


def _sides(c: Corpus) -> tuple[DataFrame, DataFrame]:
    rows = c.embeddings.select(F.col("label").alias("pair"), F.col("vec_id").alias("token"), F.col("embedding").cast("array<double>").alias("vec"))
    return rows.where("token % 2 = 0"), rows.where("token % 2 = 1")


@query(f"WITH {_PAIRS} SELECT pair, i, j, round(d / max(abs(d)) OVER (PARTITION BY pair), 6) AS relevance FROM m", prelude=False)
def token_relevance(c):
    a, b = (s.select("pair", "token", F.posexplode("vec").alias("feature", "r")) for s in _sides(c))
    return explain.contracted(a, b, ["pair"]).select("pair", "i", "j", F.round("relevance", 6).alias("relevance"))


@query(f"WITH {_PAIRS} SELECT pair, i, j, round(d * d / max(d * d) OVER (PARTITION BY pair), 6) AS relevance FROM m", prelude=False)
def relevance_normalised(c):
    return explain.embedding_relevance(*_sides(c), ["pair"]).select("pair", "i", "j", F.round("relevance", 6).alias("relevance"))


@query(f"WITH {_HALVES} SELECT round(avg(pow(list_cosine_similarity(a, b) - (vec_id % 2), 2)), 6) AS mse FROM h", prelude=False)
def pairwise_mse(c):
    rows = c.embeddings.select((F.col("vec_id") % 2).alias("label"), F.slice("embedding", 1, 32).alias("a"), F.slice("embedding", 33, 32).alias("b"))
    return explain.squared_error(rows, "a", "b", "label").select(F.round("mse", 6).alias("mse"))


def _labelled(c: Corpus) -> DataFrame:
    label = lambda k, name: relation(c, k).select("source", F.lit(name).alias("label"), "target")
    return label(0, "cites_case").unionByName(label(1, "cites_act")).unionByName(label(3, "act_cites_act")).unionByName(label(2, "has_subject"))


@query("""
, up AS (SELECT source, target, 1 AS n FROM cc), r AS (
  SELECT source, target, 1 AS n FROM cc UNION SELECT a.source, b.target, 2 FROM cc a JOIN cc b ON a.target = b.source
  UNION SELECT a.source, d.target, 3 FROM cc a JOIN cc b ON a.target = b.source JOIN cc d ON b.target = d.source)
SELECT DISTINCT r.source AS start, cl.target AS "end" FROM r JOIN cl ON r.target = cl.source
""")
def acts_of_cited_cases(c):
    """Acts that a case's citations cite, up to three citations away."""
    return pathexpr.reach(_labelled(c), c.case_ids(), step("cites_case").times(1, 3) / step("cites_act"))


@query("""
, near AS (SELECT source, target FROM ll UNION SELECT target, source FROM ll UNION SELECT target, target FROM cl)
SELECT DISTINCT a.source AS start, b.source AS "end" FROM cl a JOIN near ON near.source = a.target JOIN cl b ON b.target = near.target
""")
def cases_by_adjacent_acts(c):
    """Cases that cite one act, or two of which one cites the other."""
    acts, cites = step("act_cites_act"), step("cites_act")
    return pathexpr.reach(_labelled(c), c.case_ids(), cites / (acts | ~acts).times(0, 1) / ~cites)


@query()
def hier_document_vectors(c):
    """A vector for every document's whole text: chunks of 64 tokens, positions, two layers of attention over chunks."""
    tokenizer = encoders.LongTokenizer(encoders.word_tokenizer(), max_chunk_tokens=64)
    got = hierarchy.document_vectors(c.documents, "doc_id", "text", tokenizer, hierarchy.hashing_chunks(48), 48)
    return got.select(F.col("id").alias("doc_id"), "chunks", F.posexplode("vec").alias("dim", "x")).select("doc_id", "chunks", "dim", F.round("x", 5).alias("x"))


def walks(c: Corpus, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return graph.walks(nodes, edges, ["case", "legislation", "case"], 2)


@query()
def metapath_walks(c):
    return walks(c, *graph.judgment_graph(c.citations(), c.subjects(), c.case_ids()))


@query()
def sampled_neighbours(c):
    return graph.sampled_in_edges(relation(c, 1), 2)


@query()
def walk_embeddings(c):
    return network.walk_embeddings(metapath_walks(c), partitions=4)


@query()
def skipgram_embeddings(c):
    got = skipgram.train(metapath_walks(c), id_cols=["start", "walk"], size=32, epochs=2)
    return got.select("node", F.posexplode("embedding").alias("dim", "x"), "n").select("node", "dim", F.round("x", 6).alias("x"), "n")


def _trained(c: Corpus):
    """The typed graph, a few measures of each node as its features, and a plan over both metapaths and both kinds of neighbours."""
    number = lambda x, y: F.array(*[F.col(v).cast("double") / w for v, w in zip(x, y)])
    cases = c.orders.select(F.concat(F.lit("6"), F.col("o_orderkey").cast("string")).alias("node"), F.array(F.col("o_totalprice").cast("double") / 1e5, F.month("o_orderdate") / 6.0 - 1, F.lit(1.0), F.year("o_orderdate") - 1995.0).alias("vec"))
    acts = c.part.join(c.legislation().select("p_partkey", "id"), "p_partkey").select(F.col("id").alias("node"), F.concat(number(["p_size", "p_retailprice"], [25, 1000]), F.array(F.lit(1.0), F.lit(0.0))).alias("vec"))
    topics = c.supplier.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node"), F.concat(number(["s_acctbal", "s_nationkey"], [5000, 12]), F.array(F.lit(0.0), F.lit(1.0))).alias("vec"))
    plan = training.Plan("case", {"clc": CLC, "csc": CSC}, [("legislation", "cited_by", "case"), ("subject_matter", "related_to", "case")], {"legislation": 2, "subject_matter": 2}, 4)
    return typed(c), {"case": cases, "legislation": acts, "subject_matter": topics}, plan


@query()
def network_training(c):
    """The loss before each of three full-graph steps, to four places, for sums of floating-point numbers come in any order."""
    losses = training.train(*_trained(c), epochs=3)[1]
    return c.spark.createDataFrame([(i, round(x, 4)) for i, x in enumerate(losses)], "epoch int, loss double")


from . import encoders as fixed_weights  # noqa: E402  registers its queries
from . import scans  # noqa: E402  registers its queries

__all__ = ["FLAGSHIP", "ORACLE", "QUERIES", "cosine", "fixed_weights", "scans"]
