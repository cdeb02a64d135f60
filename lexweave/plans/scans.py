"""Registered queries over scans, sinks, predicates, pages, scalar functions and checks of decided walks, each with SQL."""

from __future__ import annotations

import string
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vectors as V
from ..functions import words
from ..operators import explain, graph, html, layout, lemmas, search, tfidf
from ..operators import paragraphs as P
from ..sources import endpoint, landed
from ..storage import settle, shared_dir
from .catalogue import _LISTED, _PUNCTUATION, STOP, TERMS_SQL, counted_terms, dealt_texts, kept, query, relation, walks
from .fixtures import Corpus

_DOCS = """
, docs AS (
  SELECT '6' || o_orderkey AS id, '6' AS sector, CAST(year(o_orderdate) AS VARCHAR) AS year, CASE WHEN o_orderkey % 7 = 0 THEN 'ORDER' ELSE 'JUDG' END AS form,
    CASE o_orderstatus WHEN 'O' THEN 'CJ' WHEN 'F' THEN 'TJ' ELSE 'XX' END AS type, CASE o_orderkey % 3 WHEN 0 THEN 'REFER_PREL' WHEN 1 THEN 'OTHER' END AS procedure FROM orders
  UNION ALL SELECT leg.id, substr(leg.id, 1, 1), CASE WHEN p_size % 5 > 0 THEN CAST(1950 + p_size AS VARCHAR) END, NULL, NULL, NULL FROM part JOIN leg ON leg.p_partkey = part.p_partkey)
"""
_JUDGED = "sector = '6' AND form = 'JUDG' AND type IN ('CJ', 'TJ', 'FJ') AND year IS NOT NULL"


def _docs(c: Corpus) -> DataFrame:
    key = F.col("o_orderkey")
    cases = c.orders.select(
        F.concat(F.lit("6"), key.cast("string")).alias("id"),
        F.lit("6").alias("sector"),
        F.year("o_orderdate").cast("string").alias("year"),
        F.when(key % 7 == 0, "ORDER").otherwise("JUDG").alias("form"),
        F.when(F.col("o_orderstatus") == "O", "CJ").when(F.col("o_orderstatus") == "F", "TJ").otherwise("XX").alias("type"),
        F.when(key % 3 == 0, "REFER_PREL").when(key % 3 == 1, "OTHER").alias("procedure"),
    )
    acts = c.part.select("p_partkey", "p_size").join(c.legislation(), "p_partkey")
    none = F.lit(None).cast("string")
    acts = acts.select("id", F.substring("id", 1, 1).alias("sector"), F.when(F.col("p_size") % 5 > 0, (F.lit(1950) + F.col("p_size")).cast("string")).alias("year"), none.alias("form"), none.alias("type"), none.alias("procedure"))
    return cases.unionByName(acts)


def _place(c: Corpus, name: str) -> str:
    return f"{shared_dir(c.spark)}/lexweave/{name}-{uuid.uuid4().hex}"


@query(f"{_DOCS} SELECT DISTINCT id FROM docs WHERE {_JUDGED} AND procedure = 'REFER_PREL'")
def judgment_ids(c):
    return landed.judgments(_docs(c))


@query(f"{_DOCS} SELECT DISTINCT id FROM docs WHERE {_JUDGED} AND procedure IS NOT NULL AND year = '1995' ORDER BY id LIMIT 20")
def judgment_ids_limited(c):
    """The remote limit: the first ids in order."""
    return landed.judgments(_docs(c), year="1995", limit=20, preliminary_ruling=False)


@query(f"{_DOCS} SELECT DISTINCT id FROM docs WHERE sector = '3' AND year IS NOT NULL")
def legislation_ids(c):
    return landed.legislation(_docs(c))


@query(f"{_DOCS} SELECT DISTINCT id FROM docs WHERE sector = '1'")
def ids_by_sector(c):
    return landed.ids_of_sector(_docs(c), "1")


def _as_uris(edges: DataFrame) -> DataFrame:
    return edges.select("source", F.concat(F.lit("http://e/x/"), F.col("target")).alias("target"))


@query("SELECT source, target FROM subjects WHERE source LIKE '6%'")
def subject_edges_by_sector(c):
    return landed.edges_of_sector(_as_uris(c.subjects()), "6")


@query(f"{_DOCS} SELECT source, target FROM citations WHERE source LIKE '6%' AND target IN (SELECT id FROM docs WHERE sector = '3' AND year IS NOT NULL)")
def citation_edges_by_sector(c):
    return landed.edges_of_sector(_as_uris(c.citations()), "6", landed.legislation(_docs(c)))


@query("SELECT DISTINCT target AS code FROM subjects WHERE source = (SELECT min(source) FROM subjects)")
def document_codes(c):
    first = c.subjects().agg(F.min("source")).first()[0]
    return landed.codes_of(_as_uris(c.subjects()), first)


@query("SELECT min(s_name) AS title FROM supplier WHERE s_nationkey = 7")
def document_title(c):
    """The first of several titles of one id."""
    titles = c.supplier.select(F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("id"), F.col("s_name").alias("title"))
    return c.spark.createDataFrame([(landed.title_of(titles, "S7"),)], "title string")


@query("SELECT 'S' || s_suppkey AS id, s_name AS title FROM supplier")
def titles_json(c):
    """Titles written as JSON objects, one a nation, and read back."""
    path = _place(c, "titles")
    entry = F.struct(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), F.col("s_name"))
    c.supplier.groupBy("s_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value")).repartition("s_nationkey").select("value").write.option("maxRecordsPerFile", 1).text(path)
    return landed.read_titles(c.spark, path, cleaned=False)


@query("SELECT s_suppkey, s_name AS label FROM supplier")
def labels_xml(c):
    xml = F.concat(F.lit('<r><prefLabel xml:lang="fr">non</prefLabel><prefLabel xml:lang="en">'), F.col("s_name"), F.lit("</prefLabel></r>"))
    return c.supplier.select("s_suppkey", xml.alias("x")).select("s_suppkey", landed.subject_label("x").alias("label"))


@query("SELECT DISTINCT 'Article ' || right(target, 1) AS article, target AS legislation FROM cl")
def paragraph_citations_csv(c):
    """Literal lists written as CSV and read back."""
    path = _place(c, "citations")
    cited = relation(c, 1)
    pair = F.concat(F.lit("[('Article "), F.substring("target", -1, 1), F.lit("', '"), F.col("target"), F.lit("')]"))
    cited.select(F.concat(F.lit("1_"), F.col("source")).alias("id"), F.concat(F.lit("['"), F.col("source"), F.lit("']")).alias("citations"), pair.alias("Articles/Decision")).write.option("header", True).option("escape", '"').csv(path)
    return landed.read_paragraph_citations(c.spark, path)[1]


@query("SELECT * FROM (VALUES ('61', '62'), ('61', '62'), ('63', '31')) AS t(source, target) UNION ALL SELECT source, target FROM citations WHERE source LIKE '3%'")
def inline_rows(c):
    return landed.inline_edges(c.spark, [("61", "62"), ("61", "62"), ("63", "31")]).unionByName(c.citations().where(F.col("source").startswith("3")))


@query("SELECT source, target FROM subjects")
def checkpoint_sink(c):
    path = _place(c, "sink")
    landed.write_checkpoint(c.subjects(), path)
    return c.spark.read.parquet(path)


@query("SELECT p_brand AS celex, 'http://none/' || replace(p_brand, '#', '%23') AS body FROM part", prelude=False)
def fetched_pages(c):
    """The fetcher with a transport that answers with the address it was asked for."""
    return endpoint.fetched(c.part, "http://none/", "p_brand", get=str.encode).select("celex", F.decode("body", "UTF-8").alias("body"))


_MARKED = "CASE WHEN turn % 5 = 1 THEN '–' WHEN turn % 5 = 3 THEN CAST(turn - 2 AS VARCHAR) END"
_SAID = "CASE WHEN turn % 4 = 2 THEN '[Signatures]' ELSE text END"
_ROWS = f"m AS (SELECT CAST(conv_id AS VARCHAR) AS celex, CAST(turn AS INTEGER) AS seq, {_MARKED} AS para_num, {_SAID} AS text FROM conversations)"


def _marked(c: Corpus) -> DataFrame:
    number = F.when(F.col("turn") % 5 == 1, "–").when(F.col("turn") % 5 == 3, (F.col("turn") - 2).cast("string"))
    return c.conversations.select(F.col("conv_id").cast("string").alias("celex"), F.col("turn").cast("int").alias("seq"), number.alias("para_num"), F.when(F.col("turn") % 4 == 2, "[Signatures]").otherwise(F.col("text")).alias("text"))


@query(f"WITH {_ROWS} SELECT * FROM m WHERE coalesce(para_num, '') NOT IN ('–', '—') AND coalesce(text, '') <> '[Signatures]'", prelude=False)
def unmarked_rows(c):
    return P.without_marks(_marked(c))


@query(f"WITH {_ROWS} SELECT m.* FROM m JOIN (SELECT celex, min(seq) AS first FROM m WHERE para_num = '1' GROUP BY celex) f ON f.celex = m.celex AND seq >= first", prelude=False)
def from_first_paragraph(c):
    return P.from_first_paragraph(_marked(c))


def _printed(c: Corpus) -> DataFrame:
    """Conversations printed as pages: tables, numbered anchors, error pages and pages of no layout, by id."""
    said = F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    numbered = F.concat(F.lit('<table><col width="5%"><col width="95%"><tr><td>'), F.expr("turn div 3 + 1").cast("string"), F.lit("</td><td>"), said, F.lit("</td></tr></table>"))
    table = F.when(F.col("turn") % 3 == 0, numbered).otherwise(F.concat(F.lit("<table><tr><td>"), said, F.lit("</td></tr></table>")))
    anchor = F.concat(F.lit(f'<p class="{html.ANCHOR}">'), (F.col("turn") + 1).cast("string"), F.lit(" "), said, F.lit("</p>"))
    kind = F.col("conv_id") % 4
    part = F.when(kind == 1, anchor).when(kind == 3, F.concat(F.lit("<p>"), said, F.lit("</p>"))).otherwise(table)
    pages = c.conversations.select("conv_id", "turn", part.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "t"))).alias("x"))
    head = F.when(F.col("conv_id") % 4 == 2, html.ERROR_PAGE).when(F.col("conv_id") % 4 == 0, '<p class="sum-title-1"></p>').otherwise("")
    return pages.select(F.col("conv_id").cast("string").alias("celex"), F.concat(F.lit("<html><body>"), head, F.array_join(F.transform("x", lambda r: r["t"]), ""), F.lit("</body></html>")).alias("body"))


_TRIMMED = r"""
t AS (SELECT conv_id, turn, CAST(conv_id AS VARCHAR) AS celex, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS seq,
  regexp_replace(text, '^\s+|\s+$', '', 'g') AS trimmed, regexp_replace(text, '\s+$', '') AS cut FROM conversations)
"""
_ANCHORED = "CASE WHEN cut = '' THEN '  ' ELSE ' ' || cut || '  ' END"


@query(
    f"""WITH {_TRIMMED}
SELECT celex, seq, CASE WHEN turn % 3 = 0 THEN CAST(turn // 3 + 1 AS VARCHAR) END AS para_num, trimmed AS text, turn % 3 = 0 AS is_header, 1 AS layout FROM t WHERE conv_id % 4 = 0
UNION ALL SELECT celex, seq, CAST(turn + 1 AS VARCHAR), {_ANCHORED}, true, 2 FROM t WHERE conv_id % 4 = 1""",
    prelude=False,
)
def html_paragraphs(c):
    """Rows of both layouts; error pages and pages of no layout give none."""
    return html.extract(_printed(c)).select("celex", "seq", "para_num", "text", "is_header", "layout")


@query(f"WITH {_TRIMMED} SELECT celex, (turn + 1) || '_' || celex AS key, {_ANCHORED} AS text FROM t WHERE conv_id % 4 = 1", prelude=False)
def html_anchor_paragraphs(c):
    return html.case_paragraphs(_printed(c).where(F.col("celex").cast("long") % 4 == 1), process=False).select("celex", "key", "text")


@query(
    r"""SELECT doc_id, replace(replace(replace(text, '‘', ''''), '—', '--'), '  ', ' ') AS plain, nullif(regexp_extract(text, '^\p{Nd}+'), '') AS digits,
  CASE WHEN source IS NOT NULL THEN 'a_' || doc_id END AS key_id, regexp_replace(doc_id || ' x', '^\p{Nd}+', '') AS rest, CAST(doc_id AS VARCHAR) AS suffix FROM documents""",
    prelude=False,
)
def text_scalars(c):
    ident = F.col("doc_id").cast("string")
    key = F.when(F.col("source").isNotNull(), F.concat(F.lit("a_"), ident))
    return c.documents.select("doc_id", X.plain_quotes(F.col("text")).alias("plain"), X.leading_digits(F.col("text")).alias("digits"), key.alias("key_id"), X.without_leading_digits(F.concat(ident, F.lit(" x"))).alias("rest"), X.last_segment(F.concat(F.lit("3_1_"), ident), "_").alias("suffix"))


@query(
    r"""WITH k AS (SELECT p_partkey, substr(p_brand, 7, 1) || CASE WHEN p_size > 10 THEN '.' || p_size ELSE '' END AS code, p_brand FROM part)
SELECT p_partkey, CASE WHEN contains(code, '.') THEN regexp_replace(code, '\.[^.]*$', '') END AS parent, regexp_matches(split_part(p_brand, '.', 1), '^\p{N}+$') AS numeric FROM k""",
    prelude=False,
)
def code_scalars(c):
    code = F.concat(F.substring("p_brand", 7, 1), F.when(F.col("p_size") > 10, F.concat(F.lit("."), F.col("p_size").cast("string"))).otherwise(""))
    return c.part.select("p_partkey", X.code_parent(code).alias("parent"), X.is_numeric_root(F.col("p_brand")).alias("numeric"))


@query(
    """WITH h AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b, embedding::DOUBLE[] AS v, unnest(range(1, 65)) AS i FROM embeddings), x AS (SELECT *, v[i] AS x FROM h)
SELECT vec_id, i AS dim, round(exp(list_cosine_similarity(a, b) / 0.5e0), 6) AS near, round(CASE WHEN x > 0 THEN x ELSE exp(x) - 1 END, 6) AS elu, round(CASE WHEN x >= 0 THEN x ELSE 0.25e0 * x END, 6) AS prelu,
  round(CASE WHEN x >= 0 THEN x ELSE 0.2e0 * x END, 6) AS leaky, CASE WHEN x > 0 THEN '#ff0000' ELSE '#0000ff' END || printf('%02x', CAST(round(least(abs(x), 1) * 255) AS INTEGER)) AS colour FROM x""",
    prelude=False,
)
def vector_scalars(c):
    a, b, x = F.slice("embedding", 1, 32), F.slice("embedding", 33, 32), F.col("x").cast("double")
    rows = c.embeddings.select("vec_id", V.contrast_similarity(a, b).alias("near"), F.posexplode("embedding").alias("i", "x"))
    return rows.select("vec_id", (F.col("i") + 1).cast("long").alias("dim"), F.round("near", 6).alias("near"), F.round(V.elu(x), 6).alias("elu"), F.round(V.prelu(x), 6).alias("prelu"), F.round(V.leaky_relu(x), 6).alias("leaky"), V.relevance_colour(x).alias("colour"))


@query(
    """WITH w AS (SELECT conv_id, turn, length(coalesce(text, ''))::DOUBLE AS width FROM conversations)
SELECT conv_id, turn, coalesce(sum(width + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + width / 2 AS centre FROM w""",
    prelude=False,
)
def word_centres(c):
    words = c.conversations.select("conv_id", "turn", F.col("turn").alias("position"), F.length(F.coalesce("text", F.lit(""))).cast("double").alias("width"))
    return explain.word_centres(words, ["conv_id"]).select("conv_id", "turn", "centre")


@query("""
, pars AS (SELECT DISTINCT '1_' || source AS para, source AS doc FROM cl),
e AS (
  SELECT '1_' || source AS s, 'Article ' || right(target, 1) AS t FROM cl UNION SELECT 'Article ' || right(target, 1), target FROM cl
  UNION SELECT a.para, b.para FROM cc JOIN pars a ON a.doc = cc.source JOIN pars b ON b.doc = cc.target
  UNION SELECT para, target FROM citations JOIN pars ON doc = source WHERE target LIKE '3%' AND source IN (SELECT id FROM case_node)
  UNION SELECT source, target FROM citations WHERE source LIKE '3%' AND target LIKE '3%')
SELECT DISTINCT least(s, t) AS a, greatest(s, t) AS b FROM e
""")
def paragraph_graph(c):
    cited = relation(c, 1)
    article = F.concat(F.lit("Article "), F.substring("target", -1, 1))
    named = cited.select(F.concat(F.lit("1_"), F.col("source")).alias("paragraph"), article.alias("article"))
    return graph.paragraph_graph(c.citations(), named, cited.select(article.alias("article"), F.col("target").alias("legislation")), c.case_ids())[1]


@query("SELECT id AS start, 2 AS walks, 2 * (id IN (SELECT source FROM cl))::INTEGER AS whole, 0 AS strays FROM nodes WHERE type = 'case'")
def walk_checks(c):
    """Walks of each case: how many, how many of full length, and steps that follow no edge."""
    nodes, simple = graph.judgment_graph(c.citations(), c.subjects(), c.case_ids())
    # One row a step, and one for a walk that has none, under a key of its own start.
    at = lambda i: F.get("path", i)
    hops = F.transform(F.sequence(F.lit(1), F.greatest(F.size("path") - 1, F.lit(1))), lambda i: F.struct(at(i - 1).alias("x"), F.coalesce(at(i), at(i - 1)).alias("y"), (i == 1).alias("first")))
    steps = walks(c, nodes, simple).select("start", F.size("path").alias("n"), F.explode(hops).alias("s"))
    steps = steps.select("start", "n", "s.first", F.least("s.x", "s.y").alias("a"), F.greatest("s.x", "s.y").alias("b"))
    met = steps.join(simple.withColumn("there", F.lit(True)), ["a", "b"], "left")
    count = lambda c: F.sum(c.cast("int")).cast("int")
    return met.groupBy("start").agg(count(F.col("first")).alias("walks"), count(F.col("first") & (F.col("n") == 3)).alias("whole"), count((F.col("n") > 1) & F.col("there").isNull()).alias("strays"))


@query("SELECT target, 2 AS draws, 0 AS strays FROM cl GROUP BY target")
def sample_checks(c):
    """In-edges drawn for each target: how many, and how many that aren't edges."""
    edges = relation(c, 1)
    drawn = graph.sampled_in_edges(edges, 2).join(edges.withColumn("there", F.lit(1)), ["source", "target"], "left")
    return drawn.groupBy("target").agg(F.count("*").cast("int").alias("draws"), F.sum(F.when(F.col("there").isNull(), 1).otherwise(0)).cast("int").alias("strays"))


@query("SELECT src_type, rel, dst_type, source, target FROM graph")
def decoded_edges(c):
    """Encoded edges looked up again by index."""
    g = kept(c)
    index = settle(graph.dense_index(graph.nodes_of(g)), "decode-index")
    s = index.select(F.col("type").alias("src_type"), F.col("idx").alias("src"), F.col("id").alias("source"))
    d = index.select(F.col("type").alias("dst_type"), F.col("idx").alias("dst"), F.col("id").alias("target"))
    return graph.encode(g, index).join(s, ["src_type", "src"]).join(d, ["dst_type", "dst"]).select("src_type", "rel", "dst_type", "source", "target")


@query(
    """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings v WHERE q.vec_id <> v.vec_id)
SELECT query_id, rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, id) AS rank FROM s) WHERE rank <= 5""",
    prelude=False,
)
def knn_exclude_self(c):
    """Every vector against all others."""
    vectors = settle(search.index(c.embeddings, "vec_id", "embedding"), "knn")
    return search.top_k(vectors, vectors, 5).select("query_id", "rank", "id", F.round("score", 6).alias("score"))


@query(f"WITH {TERMS_SQL}, l AS (SELECT term, left(term, length(term) - 1) AS lemma FROM df WHERE right(term, 1) = 's' AND left(term, length(term) - 1) IN (SELECT term FROM df)) SELECT doc, coalesce(lemma, term) AS term, sum(tf)::BIGINT AS tf FROM tf LEFT JOIN l USING (term) GROUP BY ALL", prelude=False)
def lemma_counts(c):
    """Plurals counted with their singulars, where both are terms: a lemma table by rule."""
    counts = settle(counted_terms(c), "lemma-counts")
    every = counts.select("term").distinct()
    plural = every.where(F.col("term").endswith("s")).select("term", F.expr("left(term, length(term) - 1)").alias("lemma"))
    lemmas = plural.join(every.select(F.col("term").alias("lemma")), "lemma", "left_semi").select("term", "lemma")
    return tfidf.lemmatised(counts, lemmas).groupBy("doc", "term").agg(F.sum("tf").alias("tf"))


@query(f"WITH {TERMS_SQL} SELECT doc AS doc_id, string_agg(term, ' ' ORDER BY place) AS text FROM words GROUP BY doc UNION ALL SELECT doc_id, '' FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc FROM words)", prelude=False)
def joined_terms(c):
    return c.documents.where("text is not null").select("doc_id", X.joined_terms(X.terms(F.col("text"), STOP)).alias("text"))


_W = r"[\p{L}\p{N}_]"


def _contracted(text: str) -> str:
    """The contractions that are left without ASCII punctuation. RE2 looks at no neighbours, so each rule takes them along, twice for those that share one."""
    for a, b in (("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me")):
        for _ in range(2):
            text = f"regexp_replace({text}, '(^|[^\\p{{L}}\\p{{N}}_])({a})({b})($|[^\\p{{L}}\\p{{N}}_])', '\\1 \\2 \\3 \\4', 'g')"
    for _ in range(2):
        text = f"regexp_replace({text}, '(^|[^\\p{{L}}\\p{{N}}_])(wan)(na)( )', '\\1 \\2 \\3 \\4', 'g')"
    return text


_SPACES = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_BARE = f"' ' || regexp_replace(regexp_replace(translate(lower(text), '{_PUNCTUATION}', ''), '([«“‘„])', ' \\1 ', 'g'), '([»”’])', ' \\1 ', 'g') || ' '"


@query(
    f"""WITH s AS (SELECT doc_id, {_contracted(f"regexp_replace({_BARE}, '{_SPACES}', ' ', 'g')")} AS x FROM documents),
t AS (SELECT doc_id, unnest(string_split_regex(x, '{_SPACES}')) AS token FROM s),
v AS (SELECT doc_id, unnest(regexp_extract_all(token, '{_W}{{2,}}')) AS term FROM t WHERE length(token) > 1 AND token NOT IN ({_LISTED}))
SELECT doc_id, term, count(*) AS tf FROM v GROUP BY ALL""",
    prelude=False,
)
def vector_term_counts(c):
    """Terms as a vectoriser counts them: text without case and ASCII punctuation, the word tokenizer's rules, stop words and single letters out, then the vectoriser's own cut."""
    bare = F.translate(F.lower("text"), string.punctuation, "")
    kept = F.filter(words.word_tokens(bare), lambda w: (F.length(w) > 1) & ~w.isin(STOP))
    return tfidf.term_counts(dealt_texts(c).select("doc_id", words.vector_terms(kept).alias("terms")), "doc_id", "terms").withColumnRenamed("doc", "doc_id")


_RULES = ", ".join(f"('{a}', '{b}')" for a, b in words.DETACHED)
_ODD = [("feet", "foot"), ("men", "man"), ("teeth", "tooth"), ("wives", "wife")]


@query(
    f"""WITH RECURSIVE {TERMS_SQL}, lexicon AS (SELECT term AS word FROM df WHERE df >= 2), rules(old, new) AS (VALUES {_RULES}), odd(term, lemma) AS (VALUES {", ".join(map(str, _ODD))}),
forms AS (SELECT term, term AS form, 0 AS depth FROM df WHERE term NOT IN (SELECT term FROM odd)
  UNION SELECT term, left(form, length(form) - length(old)) || new, depth + 1 FROM forms JOIN rules ON suffix(form, old) WHERE depth < 4),
every AS (SELECT * FROM forms UNION ALL SELECT term, term, 0 FROM df WHERE term IN (SELECT term FROM odd) UNION ALL SELECT term, lemma, 1 FROM df JOIN odd USING (term)),
ranked AS (SELECT term, form, row_number() OVER (PARTITION BY term ORDER BY greatest(depth, 1), length(form), depth, form) AS place FROM every WHERE form IN (SELECT word FROM lexicon))
SELECT term, form AS lemma FROM ranked WHERE place = 1""",
    prelude=False,
)
def noun_lemmas(c):
    """Each term's noun lemma, where terms of two documents or more are the lexicon."""
    counts = settle(counted_terms(c), "noun-counts")
    lexicon = tfidf.document_frequency(counts).where("df >= 2").select(F.col("term").alias("word"))
    return lemmas.noun_lemmas(counts.select("term"), lexicon, c.spark.createDataFrame(_ODD, "term string, lemma string"))


@query(
    """WITH RECURSIVE w AS (SELECT conv_id, turn, unnest(string_split(coalesce(text, ''), ' ')) AS word, unnest(range(len(string_split(coalesce(text, ''), ' ')))) AS position FROM conversations),
l AS (SELECT conv_id, turn, position, length(word)::DOUBLE AS width, 0 AS line, 0.0::DOUBLE AS x FROM w WHERE position = 0
  UNION ALL SELECT w.conv_id, w.turn, w.position, length(w.word), CASE WHEN l.x + l.width + 1 + length(w.word) > 40 THEN l.line + 1 ELSE l.line END,
    CASE WHEN l.x + l.width + 1 + length(w.word) > 40 THEN 0 ELSE l.x + l.width + 1 END FROM l JOIN w ON w.conv_id = l.conv_id AND w.turn = l.turn AND w.position = l.position + 1)
SELECT conv_id, turn, position, line, x FROM l""",
    prelude=False,
)
def word_lines(c):
    """The words of every turn on lines of 40 characters."""
    words_of = c.conversations.select("conv_id", "turn", F.posexplode(F.split(F.coalesce("text", F.lit("")), " ", -1)).alias("position", "word"))
    placed = layout.broken_lines(words_of.select("conv_id", "turn", F.col("position").cast("long").alias("position"), F.length("word").cast("double").alias("width")), ["conv_id", "turn"], 40.0)
    return placed.select("conv_id", "turn", "position", "line", "x")
