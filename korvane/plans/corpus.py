"""Named queries: corpus tables, texts, extraction, graph and loads."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixed
from ..functions import text as tx
from ..operators import corpus as co, extract as ex, fusion as fu, graph as gr, metrics as me
from ..operators.lexical import analyze
from ..session import discard, release, scratch_path, unkept_listings
from ..sources import readers as rd, writers as wr
from .common import (DOCS_SQL, HITS_SQL, VECTORS_SQL, WCLS, WS, docs, hits, rich_hits, s_passage,
                     s_strip, s_tokens, s_words, table)
from .registry import query
from .retrieval import grow_sql, web_rows, WEB_SQL

# ---- hierarchy: region → nation → customer → order as topic → subtopic → chapter → article ----


def _hierarchy(spark, d):
    topics = table(spark, d, "region").select(F.col("r_regionkey").cast("long").alias("id"),
                                              F.col("r_name").alias("ten"))
    sub = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"),
                                           F.col("n_name").alias("ten"),
                                           F.col("n_regionkey").cast("long").alias("chude_id"))
    ch = table(spark, d, "customer").select(F.col("c_custkey").alias("mapc"),
                                            F.col("c_name").alias("ten"),
                                            F.col("c_nationkey").cast("long").alias("demuc_id"))
    o = table(spark, d, "orders")
    art = o.select(F.col("o_orderkey").alias("mapc"), F.col("o_orderpriority").alias("ten"),
                   F.col("o_orderstatus").alias("noidung"), F.col("o_custkey").alias("chuong_id"),
                   F.lit(None).cast("string").alias("vbqppl"))
    return art, ch, sub, topics


DENORM_SQL = """den AS (SELECT o_orderkey AS mapc, o_orderpriority AS ten, o_orderstatus AS noidung,
    c_name AS tenchuong, n_name AS tendemuc, r_name AS tenchude FROM orders
    LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey
    LEFT JOIN region ON r_regionkey = n_regionkey)"""


def _denorm(spark, d):
    return co.denormalize(*_hierarchy(spark, d), chain=True)


@query("hierarchy_denorm", f"WITH {DENORM_SQL} SELECT * FROM den")
def hierarchy_denorm(spark, d):
    return _denorm(spark, d).select("mapc", "ten", "noidung", "tenchuong", "tendemuc", "tenchude")


@query("denorm_own_keys", """SELECT l_orderkey AS mapc, l_linenumber AS pos, l_partkey, p_name AS tenchuong,
    coalesce(s_name, '') AS tendemuc, coalesce(n_name, '') AS tenchude FROM lineitem LEFT JOIN part ON p_partkey = l_partkey
LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = l_linenumber""")
def denorm_own_keys(spark, d):
    """Lines as articles with their own keys to part, supplier and nation."""
    art = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("mapc"), F.col("l_linenumber").alias("pos"), "l_partkey",
        F.col("l_partkey").alias("chuong_id"), F.col("l_suppkey").alias("demuc_id"),
        F.col("l_linenumber").alias("chude_id"))
    none = F.lit(None).cast("long")
    ch = table(spark, d, "part").select(F.col("p_partkey").alias("mapc"), F.col("p_name").alias("ten"), none.alias("demuc_id"))
    sub = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("ten"), none.alias("chude_id"))
    top = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("ten"))
    return co.denormalize(art, ch, sub, top, blanks=True).select(
        "mapc", "pos", "l_partkey", "tenchuong", "tendemuc", "tenchude")


@query("block_text", f"""WITH {DENORM_SQL}
SELECT mapc, concat_ws(chr(10) || chr(10), nullif(trim(tenchude), ''), nullif(trim(tendemuc), ''),
    nullif(trim(tenchuong), ''), nullif(trim(ten), ''), nullif(trim(noidung), '')) AS block FROM den""")
def block_text(spark, d):
    return _denorm(spark, d).select("mapc", tx.block_text(
        "tenchude", "tendemuc", "tenchuong", "ten", "noidung").alias("block"))


@query("passage_text", f"WITH {DENORM_SQL} SELECT mapc, {s_passage()} AS passage FROM den")
def passage_text(spark, d):
    return _denorm(spark, d).select("mapc", tx.passage_text(
        "tenchude", "tendemuc", "tenchuong", "ten", "noidung").alias("passage"))


@query("labelled_block", f"""WITH {DENORM_SQL}
SELECT mapc, concat('Chủ đề: ', tenchude, chr(10), 'Đề mục: ', tendemuc, chr(10), 'Chương: ',
    tenchuong, chr(10), 'Điều: ', ten, chr(10), noidung, chr(10), 'Căn cứ theo ') AS block FROM den""")
def labelled_block(spark, d):
    return _denorm(spark, d).select("mapc", tx.labelled_block(
        "tenchude", "tendemuc", "tenchuong", "ten", "noidung", "vbqppl").alias("block"))


# ---- texts ------------------------------------------------------------------------------

@query("join_body", f"""SELECT doc_id, md5(list_aggregate(list_filter(list_transform(
    string_split(text, chr(10)), lambda x: {s_strip('x')}), lambda x: x <> ''), 'string_agg', ' '))
    AS body FROM documents""")
def join_body(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(
        tx.join_body(F.split("text", "\n"), " ")).alias("body"))


NORM = f"regexp_replace({s_strip('lower(text)')}, '{WS}+', ' ', 'g')"
NORM_P = s_strip(f"regexp_replace(regexp_replace({s_strip('lower(text)')}, "
                 f"'[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Pc}}{WS[1:-1]}]', ' ', 'g'), '{WS}+', ' ', 'g')")


@query("normalize", f"""SELECT conv_id, turn, {NORM} AS norm, {NORM_P} AS norm_words
FROM conversations""")
def normalize(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id", "turn", tx.normalize("text").alias("norm"),
        tx.normalize("text", strip_punct=True).alias("norm_words"))


@query("truncate", f"""SELECT doc_id, md5(CASE WHEN length(t) <= 200 THEN t ELSE
    concat(regexp_replace(substr(t, 1, 180), '{WS}+$', ''), chr(10), '… [đã rút gọn]') END) AS short
FROM (SELECT doc_id, {s_strip('text')} AS t FROM documents)""")
def truncate(spark, d):
    return table(spark, d, "documents").select(
        "doc_id", F.md5(tx.truncate_marked("text", 200)).alias("short"))


def _md(x):
    for p, r in [(r"\*\*(.*?)\*\*", r"\1"), (r"\*(.*?)\*", r"\1"), (rf"#{{1,6}}{WS}", ""),
                 (r"\[(.*?)\]\(.*?\)", r"\1"), (r"`{1,3}[^`]*`{1,3}", ""), (r"---+", ""),
                 (r"\n+", ". ")]:
        x = f"regexp_replace({x}, '{p}', '{r}', 'g')"
    return f"substr({s_strip(x)}, 1, 4096)"


@query("strip_markdown", f"""WITH m AS (SELECT doc_id, concat('## **', lang, '**', chr(10), text,
    chr(10), '---', chr(10), '[', source, '](http://x/', doc_id, ') `code`') AS t FROM documents)
SELECT doc_id, md5({_md('t')}) AS plain FROM m""")
def strip_markdown(spark, d):
    t = table(spark, d, "documents")
    marked = F.concat(F.lit("## **"), "lang", F.lit("**\n"), "text", F.lit("\n---\n["), "source",
                      F.lit("](http://x/"), F.col("doc_id").cast("string"), F.lit(") `code`"))
    return t.select("doc_id", F.md5(tx.strip_markdown(marked)).alias("plain"))


def _chunk_sql(n):
    cut = [rf"[^{WS[1:]}{{{n}}}"] + [rf"[^{WS[1:]}{{{i}}}{WS}{{0,{n - i}}}" for i in range(n - 1, 0, -1)]
    return r"\n+|" + "|".join(cut) + "|" + WS


@query("chunk_text", f"""WITH c AS (SELECT conv_id, turn, regexp_extract_all(text,
    '{_chunk_sql(32)}') AS p FROM conversations)
SELECT conv_id, turn, i - 1 AS pos, p[i] AS piece FROM (
    SELECT conv_id, turn, p, unnest(range(1, len(p) + 1)) AS i FROM c)""")
def chunk_text(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(
        tx.chunk_text("text")).alias("pos", "piece"))


@query("chunk_fixed", """SELECT doc_id, i AS pos, substr(text, i * 5 + 1, 5) AS piece FROM (
    SELECT item_id AS doc_id, text, unnest(range(0, ((length(text) + 4) // 5)::BIGINT)) AS i FROM benchmark)""")
def chunk_fixed(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.posexplode(
        tx.chunk_fixed("text", 5)).alias("pos", "piece"))


@query("ascii_slug", """SELECT 'part' AS kind, p_partkey AS id, coalesce(nullif(trim(regexp_replace(
    strip_accents(p_name), '[^A-Za-z0-9]+', '_', 'g'), '_'), ''), 'NA') AS slug FROM part
UNION ALL SELECT 'document', doc_id, coalesce(nullif(trim(regexp_replace(
    strip_accents(lang || ' - ' || source), '[^A-Za-z0-9]+', '_', 'g'), '_'), ''), 'NA')
FROM documents""")
def ascii_slug(spark, d):
    part = table(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"),
                                          F.col("p_name").alias("t"))
    doc = table(spark, d, "documents").select(F.lit("document"), "doc_id",
                                              F.concat("lang", F.lit(" - "), "source"))
    return part.union(doc).select("kind", "id", tx.ascii_slug("t").alias("slug"))


@query("analyze", rf"""SELECT item_id, list_aggregate(list_filter(
    {s_words("replace(text, '_', '')")}, lambda x: x NOT IN ('on', 'the')), 'string_agg', ' ')
    AS terms FROM benchmark""")
def analyze_query(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(
        analyze("text", ("on", "the")), " ").alias("terms"))


@query("metadata_cap", f"""WITH {DOCS_SQL},
j AS (SELECT id, {s_strip('noidung')} AS body, concat('{{"mapc":', to_json(mapc), ',"tenchude":', to_json(tenchude),
    ',"tendemuc":', to_json(tendemuc), ',"tenchuong":', to_json(tenchuong), ',"tendieu":', to_json(ten),
    ',"noidung":') AS head FROM docs),
c AS (SELECT *, list_filter(list_concat(range(length(body), -1, -4000), [0]), lambda n: n = 0 OR strlen(
    concat(head, to_json(substr(body, 1, n)), '}}')) + 11 <= 64000)[1] AS n FROM j)
SELECT id, n AS kept_chars, md5(substr(body, 1, n)) AS body FROM c""")
def metadata_cap(spark, d):
    t = docs(spark, d).withColumnRenamed("ten", "tendieu")
    return co.cap_metadata(t).select("id", F.length("noidung").alias("kept_chars"),
                                     F.md5("noidung").alias("body"))


@query("parse_metadata", """SELECT doc_id AS id, CASE WHEN lang = 'en' THEN doc_id::VARCHAR ELSE
    nullif(trim(split_part(split_part(text, chr(10), 1), '.', 1)), '') END AS article_key,
    source AS tenchude, md5(text) AS body FROM documents""")
def parse_metadata(spark, d):
    t = docs(spark, d)
    js = F.to_json(F.struct(F.when(F.col("tendemuc") == "en", F.col("mapc")).otherwise("").alias("mapc"),
                            "tenchude", F.col("ten").alias("tendieu"), "noidung"))
    return co.parse_metadata(t.select("id", js.alias("metadata"))).select(
        "id", "article_key", "tenchude", F.md5("noidung").alias("body"))


# ---- ids, integrity, loads --------------------------------------------------------------

@query("surrogate_ids", """SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS id
FROM orders""")
def surrogate_ids(spark, d):
    return co.assign_ids(table(spark, d, "orders").select("o_orderkey", "o_orderdate"),
                         ["o_orderdate", "o_orderkey"]).select("o_orderkey", "id")


@query("ids_to_keys", """SELECT id, mapc FROM (SELECT c_name AS mapc,
    row_number() OVER (ORDER BY c_name) AS id FROM customer)
WHERE id IN (SELECT o_custkey FROM orders)""")
def ids_to_keys(spark, d):
    return me.ids_to_keys(table(spark, d, "customer").select(F.col("c_name").alias("mapc")),
                          table(spark, d, "orders").select(F.col("o_custkey").alias("id"))
                          ).select("id", "mapc")


@query("fetch_by_id", f"""WITH {VECTORS_SQL}
SELECT query_id, rank, id, md5(text) AS body FROM ranked JOIN documents ON doc_id = id
WHERE rank <= 10""")
def fetch_by_id(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return co.fetch_by_id(hits(spark, d, 10), t).select("query_id", "rank", "id",
                                                        F.md5("text").alias("body"))


GOLD_SQL = """WITH new AS (SELECT doc_id AS mapc, row_number() OVER (ORDER BY doc_id) AS id FROM labels),
m AS (SELECT label::BIGINT AS query_id, vec_id AS pos, vec_id AS old_id, new.id FROM embeddings
    LEFT JOIN new ON new.mapc = vec_id)"""


def _remapped(spark, d):
    e = table(spark, d, "embeddings")
    gold = e.select(F.col("label").cast("long").alias("query_id"), F.col("vec_id").alias("pos"),
                    F.col("vec_id").alias("id"))
    old = e.select(F.col("vec_id").alias("id"), F.col("vec_id").alias("mapc"))
    new = co.assign_ids(table(spark, d, "labels").select(F.col("doc_id").alias("mapc")), "mapc")
    return me.remap_gold_rows(gold, old, new)


@query("gold_remap", f"{GOLD_SQL} SELECT * FROM m")
def gold_remap(spark, d):
    return _remapped(spark, d)


@query("gold_summary", f"""{GOLD_SQL}
SELECT query_id, count(id) AS mapped, count(*) AS total FROM m GROUP BY query_id""")
def gold_summary(spark, d):
    return me.remap_summary(_remapped(spark, d))


@query("rejects", """WITH s AS (SELECT o_orderkey, nullif(o_custkey, 7) AS o_custkey, o_orderstatus
    FROM orders UNION ALL SELECT o_orderkey, nullif(o_custkey, 7), o_orderstatus FROM orders
    WHERE o_orderpriority = '1-URGENT'),
o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS r FROM s),
t AS (SELECT o_orderkey, CASE WHEN o_custkey IS NULL OR o_orderstatus IS NULL THEN 'missing key'
    WHEN r > 1 THEN 'duplicate key' WHEN l.doc_id IS NULL
    THEN 'missing o_custkey' END AS reason FROM o LEFT JOIN labels l ON l.doc_id = o_custkey)
SELECT o_orderkey, coalesce(reason, 'clean') AS reason FROM t""")
def rejects(spark, d):
    """Orders with some customers missing and the urgent ones twice, so every rule has rows."""
    o = table(spark, d, "orders").withColumn("o_custkey", F.nullif("o_custkey", F.lit(7)))
    o = o.unionByName(o.filter("o_orderpriority = '1-URGENT'"))
    clean, bad = co.reject_invalid(
        o.select("o_orderkey", "o_custkey", "o_orderstatus"),
        ["o_custkey", "o_orderstatus"], {"o_custkey": table(spark, d, "labels").select("doc_id")},
        "o_orderkey")
    return clean.select("o_orderkey", F.lit("clean").alias("reason")).unionByName(
        bad.select("o_orderkey", "reason"))


@query("load_rejects", """SELECT doc_id, length(text) AS len_text, CASE WHEN length(text) > 2000
    THEN 'text too long' WHEN lang = 'de' THEN 'unknown: other language'
    WHEN lang <> 'en' THEN 'other language' ELSE 'loaded' END AS error
FROM documents""")
def load_rejects(spark, d):
    t = table(spark, d, "documents").withColumns(
        {"len_text": F.length("text"), "lang": F.nullif("lang", F.lit("de"))})
    good, bad = co.load_with_rejects(t, {"text too long": F.col("len_text") > 2000,
                                         "other language": F.col("lang") != "en"})
    return good.withColumn("error", F.lit("loaded")).unionByName(bad).select(
        "doc_id", "len_text", "error")


@query("resume", """SELECT doc_id, lang FROM documents WHERE doc_id NOT IN
    (SELECT doc_id FROM labels)""")
def resume(spark, d):
    return co.load_increment(table(spark, d, "documents"), table(spark, d, "labels"),
                             "doc_id").select("doc_id", "lang")


@query("first_nonempty", """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_totalprice > 0""")
def first_nonempty(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return co.first_nonempty(o.filter("o_totalprice < 0"), o.filter("o_totalprice > 0"),
                             o).select("o_orderkey", "o_orderstatus")


# ---- graph --------------------------------------------------------------------------------

@query("nodes", """SELECT 'order' AS kind, o_custkey AS key, arg_max(o_orderpriority, o_orderkey) AS name
FROM orders GROUP BY o_custkey
UNION ALL SELECT 'supplier', l_suppkey, arg_max(l_returnflag, (l_orderkey, l_linenumber, l_returnflag))
FROM lineitem GROUP BY l_suppkey""")
def nodes(spark, d):
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("name"),
        F.struct(F.col("o_orderkey").alias("a"), F.lit(0).alias("b"), F.lit("").alias("c")).alias("version"))
    s = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("key"), F.col("l_returnflag").alias("name"),
        F.struct(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"),
                 F.col("l_returnflag").alias("c")).alias("version"))
    return gr.build_nodes({"order": o, "supplier": s}).select("kind", "key", "name")


@query("hierarchy_edges", """SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst, 'CO_DE_MUC' AS rel
    FROM nation JOIN region ON r_regionkey = n_regionkey
UNION SELECT 'n' || n_nationkey, 'c' || c_custkey, 'CO_CHUONG' FROM customer
    JOIN nation ON n_nationkey = c_nationkey
UNION SELECT 'c' || c_custkey, 'o' || o_orderkey, 'CO_DIEU' FROM orders
    JOIN customer ON c_custkey = o_custkey""")
def hierarchy_edges(spark, d):
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    r = table(spark, d, "region").select(name("r", "r_regionkey").alias("key"))
    n = table(spark, d, "nation").select(name("n", "n_nationkey").alias("key"),
                                         name("r", "n_regionkey").alias("up"))
    c = table(spark, d, "customer").select(name("c", "c_custkey").alias("key"),
                                           name("n", "c_nationkey").alias("up"))
    o = table(spark, d, "orders").select(name("o", "o_orderkey").alias("key"),
                                         name("c", "o_custkey").alias("up"))
    return (gr.hierarchy_edges(n, r, "CO_DE_MUC", "up")
            .unionByName(gr.hierarchy_edges(c, n, "CO_CHUONG", "up"))
            .unionByName(gr.hierarchy_edges(o, c, "CO_DIEU", "up")))


@query("related_edges", """WITH p AS (SELECT l_partkey AS a, l_suppkey AS b FROM lineitem),
e AS (SELECT a AS src, b AS dst FROM p UNION SELECT b, a FROM p)
SELECT src, dst, 'LIEN_QUAN' AS rel FROM e WHERE src IN (SELECT doc_id FROM labels)
    AND dst IN (SELECT doc_id FROM labels)""")
def related_edges(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"),
                                               F.col("l_suppkey").alias("dst"))
    return gr.related_edges(pairs, table(spark, d, "labels").select(F.col("doc_id").alias("key")))


@query("citation_edges", r"""WITH c AS (SELECT page_id AS src, unnest(list_distinct(
    regexp_extract_all(url || ' ' || html, '/([0-9]+)\b', 1))) AS code FROM pages)
SELECT DISTINCT src, page_id AS dst, 'THAM_CHIEU' AS rel FROM c JOIN pages ON page_id::VARCHAR = code
WHERE src <> page_id""")
def citation_edges(spark, d):
    p = table(spark, d, "pages").select(
        "page_id", F.col("page_id").cast("string").alias("code"),
        F.concat("url", F.lit(" "), "html").alias("noidung"))
    return gr.citation_edges(p, key="page_id", code="code", pattern=r"/([0-9]+)\b")


@query("graph_expand", f"""WITH ue AS (SELECT DISTINCT 'p' || l_partkey AS a, 'o' || l_orderkey AS b
    FROM lineitem UNION SELECT DISTINCT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem),
seeds AS (SELECT p_brand AS query_id, 'p' || min(p_partkey) AS key FROM part GROUP BY p_brand),
{grow_sql('seeds', 'ue')}
SELECT query_id, key, base, hop, rank FROM grown""")
def graph_expand(spark, d):
    """Articles are parts, and an order is the node its parts meet at."""
    edges = table(spark, d, "lineitem").select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"),
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("dst"))
    seeds = table(spark, d, "part").groupBy(F.col("p_brand").alias("query_id")).agg(
        F.concat(F.lit("p"), F.min("p_partkey").cast("string")).alias("key"))
    return gr.graph_expand(seeds, edges, 2, 40)


CODES_SQL = """codes AS (SELECT lpad(r_regionkey::VARCHAR, 12, '0') AS mapc FROM region
    UNION ALL SELECT lpad(n_regionkey::VARCHAR, 12, '0') || lpad(n_nationkey::VARCHAR, 12, '0') FROM nation
    UNION ALL SELECT lpad(n_regionkey::VARCHAR, 12, '0') || lpad(n_nationkey::VARCHAR, 12, '0') ||
      lpad(c_custkey::VARCHAR, 12, '0') FROM customer JOIN nation ON n_nationkey = c_nationkey)"""


def _codes(spark, d):
    pad = lambda c: F.lpad(F.col(c).cast("string"), 12, "0")
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    return (table(spark, d, "region").select(pad("r_regionkey").alias("mapc"))
            .union(n.select(F.concat(pad("n_regionkey"), pad("n_nationkey"))))
            .union(c.select(F.concat(pad("n_regionkey"), pad("n_nationkey"), pad("c_custkey")))))


@query("tree_children", f"""WITH {CODES_SQL}
SELECT p.mapc AS parent, c.mapc AS child FROM codes c LEFT JOIN codes p
    ON p.mapc = substr(c.mapc, 1, length(c.mapc) - 12)
WHERE p.mapc IS NOT NULL OR length(c.mapc) = 12""")
def tree_children(spark, d):
    return gr.tree_children(_codes(spark, d))


@query("child_counts", f"""WITH {CODES_SQL}
SELECT c.mapc, count(k.mapc) AS children FROM codes c LEFT JOIN codes k
    ON c.mapc = substr(k.mapc, 1, length(k.mapc) - 12) GROUP BY c.mapc""")
def child_counts(spark, d):
    return gr.child_counts(_codes(spark, d))


# ---- pages -------------------------------------------------------------------------------

@query("page_titles", """SELECT page_id,
    regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages""")
def page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", ex.page_title().alias("title"))


@query("page_links", r"""WITH l AS (SELECT page_id, regexp_extract_all(html,
    '(?i)<a\s[^>]*?href=["'']([^"'']*)["'']', 1) AS h FROM pages)
SELECT page_id, i - 1 AS pos, h[i] AS href FROM (
    SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM l)""")
def page_links(spark, d):
    return ex.page_links(table(spark, d, "pages"))


# Law pages are built from documents, one per row: every line of the text is an article with a
# note, a table in every third, an attachment in every second and a related link.
LINES_SQL = f"""ln AS (SELECT doc_id AS page_id, lang, source, i - 1 AS pos, l[i] AS line, len(l) AS n
    FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM (
      SELECT doc_id, lang, source, string_split(text, chr(10)) AS l FROM documents)))"""


def law_pages(spark, d, docs=None):
    esc = lambda c: F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    num = lambda c: c.cast("string")
    t = table(spark, d, "documents") if docs is None else docs
    page = num(F.col("doc_id"))

    def article(line, i):
        code = F.concat(page, F.lit("-"), num(i))
        return F.concat(
            F.lit("<p class='pDieu'><a name='"), code, F.lit("'></a>Điều "), code, F.lit("</p>"),
            F.lit("<p class='pGhiChu'>(<a href='http://vbpl.vn/?ItemID="), page,
            F.lit("#d"), num(i), F.lit("'>"), F.col("lang"), F.lit("</a>)</p>"),
            F.lit("<p class='pNoiDung'><p>"), esc(line), F.lit("</p>"),
            F.when(i % 3 == 0, F.concat(F.lit("<table><tr><td>"), F.col("source"),
                                        F.lit("</td></tr></table>"))).otherwise(F.lit("")),
            F.lit("</p>"),
            F.when(i % 2 == 0, F.concat(F.lit("<a href='/f/"), code, F.lit("'>f</a>")))
            .otherwise(F.lit("")),
            F.lit("<p class='pChiDan'>(<a onclick=\"go('"), page, F.lit("-"), num(i + 1),
            F.lit("')\">x</a>; <a href='#'>y</a>)</p>"))

    body = F.array_join(F.transform(F.split("text", "\n"), article), "")
    return t.select(F.col("doc_id").alias("page_id"),
                    F.concat(F.lit("<div>"), body, F.lit("</div>")).alias("html"))


def _articles(spark, d):
    return ex.extract_articles(law_pages(spark, d))


@query("page_articles", f"""WITH {LINES_SQL}
SELECT page_id, pos, page_id || '-' || pos AS mapc, 'Điều ' || page_id || '-' || pos AS ten,
    md5({s_strip('line')} || chr(10)) AS body FROM ln""")
def page_articles(spark, d):
    return _articles(spark, d).select("page_id", "pos", "mapc", "ten", F.md5("noidung").alias("body"))


@query("page_notes", f"""WITH {LINES_SQL}
SELECT page_id, page_id || '-' || pos AS mapc, '(' || lang || ')' AS vbqppl,
    'http://vbpl.vn/?ItemID=' || page_id || '#d' || pos AS vbqppl_link FROM ln""")
def page_notes(spark, d):
    return ex.extract_source_note(_articles(spark, d))


@query("page_tables", f"""WITH {LINES_SQL}
SELECT page_id || '-' || pos AS dieu_id, 0::BIGINT AS pos,
    '<table><tr><td>' || source || '</td></tr></table>' AS html FROM ln WHERE pos % 3 = 0""")
def page_tables(spark, d):
    return ex.extract_tables(_articles(spark, d))


@query("page_files", f"""WITH {LINES_SQL}
SELECT page_id || '-' || pos AS dieu_id, 0::BIGINT AS pos, '/f/' || page_id || '-' || pos AS link,
    '' AS path FROM ln WHERE pos % 2 = 0""")
def page_files(spark, d):
    return ex.extract_files(_articles(spark, d))


@query("page_related", f"""WITH {LINES_SQL}
SELECT page_id || '-' || pos AS dieu_id1, page_id || '-' || (pos + 1) AS dieu_id2 FROM ln""")
def page_related(spark, d):
    return ex.extract_related(_articles(spark, d))


@query("item_ids", r"""WITH l AS (SELECT 'http://x/?ItemID=' || (l_partkey % 500) || '&p=1' ||
    CASE WHEN l_linenumber > 3 THEN '#Dieu_' || l_linenumber ELSE '' END AS link FROM lineitem)
SELECT DISTINCT regexp_extract(link, 'ItemID=([0-9]+).*#(.*)', 1) AS item_id FROM l
WHERE contains(link, '#')""")
def item_ids(spark, d):
    link = F.concat(F.lit("http://x/?ItemID="), (F.col("l_partkey") % 500).cast("string"), F.lit("&p=1"),
                    F.when(F.col("l_linenumber") > 3,
                           F.concat(F.lit("#Dieu_"), F.col("l_linenumber").cast("string")))
                    .otherwise(F.lit("")))
    return ex.distinct_item_ids(table(spark, d, "lineitem").select(link.alias("vbqppl_link")))


@query("roman_ordinal", """SELECT p_partkey, CASE p_size % 10 WHEN 0 THEN 10 WHEN 1 THEN 40 WHEN 2 THEN 90
    WHEN 3 THEN 140 WHEN 4 THEN 21 WHEN 5 THEN NULL WHEN 6 THEN 60 WHEN 7 THEN 400 WHEN 8 THEN NULL
    ELSE 16190 END::BIGINT AS stt FROM part""")
def roman_ordinal(spark, d):
    names = F.array(*[F.lit(x) for x in ("I", "iv", "IX", "XIV", "IIA", "Q", "VI", "XL", "AI", "MDCXIX")])
    t = table(spark, d, "part").select(
        "p_partkey", F.element_at(names, (F.col("p_size") % 10 + 1).cast("int")).alias("chimuc"))
    good, bad = ex.chapter_ordinals(t)
    return good.unionByName(bad).select("p_partkey", "stt")


@query("node_split", """SELECT p_partkey, contains(p_type, 'STANDARD') OR contains(p_type, 'SMALL')
    AS chapter FROM part""")
def node_split(spark, d):
    t = table(spark, d, "part")
    name = F.when(F.contains("p_type", F.lit("STANDARD")) | F.contains("p_type", F.lit("SMALL")),
                  F.concat(F.lit(fixed.CHAPTER_PREFIX), "p_type")).otherwise(F.col("p_type"))
    ch, art = ex.split_nodes(t.select("p_partkey", name.alias("ten")))
    return ch.select("p_partkey", F.lit(True).alias("chapter")).unionByName(
        art.select("p_partkey", F.lit(False).alias("chapter")))


@query("assign_chapter", """WITH ch AS (SELECT n_regionkey AS reg, lpad(n_nationkey::VARCHAR, 2, '0') AS code,
    n_nationkey AS pos FROM nation),
a AS (SELECT c_custkey, n_regionkey AS reg, lpad(((c_nationkey + c_custkey % 2) % 25)::VARCHAR, 2, '0')
    || '-' || c_custkey AS mapc FROM customer JOIN nation ON n_nationkey = c_nationkey),
n AS (SELECT reg, count(*) AS n, min(code) AS sole FROM ch GROUP BY reg)
SELECT c_custkey, CASE WHEN n = 1 THEN sole ELSE (SELECT arg_min(code, pos) FROM ch
    WHERE ch.reg = a.reg AND starts_with(a.mapc, ch.code)) END AS chapter_id FROM a LEFT JOIN n USING (reg)""")
def assign_chapter(spark, d):
    n = table(spark, d, "nation")
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    ch = n.select(F.col("n_regionkey").alias("demuc_id"), pad(F.col("n_nationkey")).alias("mapc"),
                  F.col("n_nationkey").alias("pos"))
    c = table(spark, d, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey"))
    art = c.select("c_custkey", F.col("n_regionkey").alias("demuc_id"), F.concat(
        pad((F.col("c_nationkey") + F.col("c_custkey") % 2) % 25), F.lit("-"),
        F.col("c_custkey").cast("string")).alias("mapc"))
    return ex.assign_chapter(art, ch).select("c_custkey", "chapter_id")


@query("page_position", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (
    PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS stt FROM lineitem""")
def page_position(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return ex.article_position(t, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"])


@query("node_match", """SELECT page_id, n_name AS node FROM pages JOIN nation ON n_nationkey = page_id
UNION ALL SELECT page_id, 'no node' FROM pages WHERE page_id NOT IN (SELECT n_nationkey FROM nation)""")
def node_match(spark, d):
    found, lost = ex.match_nodes(
        table(spark, d, "pages").select("page_id"),
        table(spark, d, "nation").select(F.col("n_nationkey").alias("demuc_id"), F.col("n_name").alias("node")))
    return found.select("page_id", "node").unionByName(
        lost.select("page_id", F.lit("no node").alias("node")))


# ---- reads and writes ---------------------------------------------------------------------

@query("table_read", """SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders""")
def table_read(spark, d):
    return rd.read_tables(spark, d, ["orders"])["orders"].select("o_orderkey", "o_custkey",
                                                                 F.round("o_totalprice", 2).alias("o_totalprice"))


# Pages whose files the driver lists at a time, and the tasks that write and read them. Folders of more than 32
# tasks are listed by tasks.
PAGE_LOT, PAGE_PARTS = 10_000, 64


def _page_lots(spark, d):
    """(stem, value, lot) of the pages, written once; the pages of an id are in one lot."""
    p = table(spark, d, "pages").select(F.col("page_id").cast("string").alias("stem"),
                                        F.concat(F.lit("﻿"), "html").alias("value"))
    lots = max(-(-p.count() // PAGE_LOT), 1)
    dealt = p.withColumn("lot", F.pmod(F.xxhash64("stem"), F.lit(lots)))
    path = scratch_path(spark, "page-lots")
    # a lot is a few files, however many tasks deal
    dealt.repartition("lot", F.pmod(F.hash("stem"), F.lit(8))).write.partitionBy("lot").parquet(path)
    step = spark.read.schema(dealt.schema).parquet(path)
    step.step_path = path
    return step


def _page_files(p, path):
    """Write the pages as one text file each, the stem being the page id."""
    # one folder per page keeps the writer parallel; the folders of a task lie in one, which is committed as a whole
    part = F.pmod(F.hash("stem"), F.lit(PAGE_PARTS))
    (p.select("stem", "value", part.alias("part")).repartition(PAGE_PARTS, "stem")
     .write.partitionBy("part", "stem").option("lineSep", "\u0001").text(path))
    return path


@query("page_read", """SELECT page_id::VARCHAR AS page_id, md5(html || chr(1)) AS html FROM pages""")
def page_read(spark, d):
    """A lot of pages at a time is written as files and read, so the driver never lists the files of all."""
    dealt, path, schema = _page_lots(spark, d), scratch_path(spark, "page-rows"), "page_id string, html string"
    spark.createDataFrame([], schema).write.parquet(path)
    for lot in [r.lot for r in dealt.select("lot").distinct().collect()]:
        files = _page_files(dealt.filter(F.col("lot") == lot), scratch_path(spark, "pages"))
        with unkept_listings(spark):
            raw = spark.read.schema("value string, part int, stem string").text(files, wholetext=True)
        raw.step_path = files
        rows = rd.shape_pages(raw.select("value", "_metadata", "stem"), F.col("stem").cast("string"))
        (rows.select("page_id", F.md5("html").alias("html")).coalesce(PAGE_PARTS)
         .write.mode("append").parquet(path))
        discard(raw)
        release(spark)
    discard(dealt)
    return spark.read.schema(schema).parquet(path)


@query("page_checkpoint", """SELECT page_id, url FROM pages
WHERE lpad(page_id::VARCHAR, 8, '0') || '.html' >= (SELECT lpad((max(n_nationkey))::VARCHAR, 8, '0') || '.html'
    FROM nation)""")
def page_checkpoint(spark, d):
    mark = table(spark, d, "nation").agg(F.lpad(F.max("n_nationkey").cast("string"), 8, "0")).first()[0]
    p = table(spark, d, "pages").withColumn(
        "file_name", F.concat(F.lpad(F.col("page_id").cast("string"), 8, "0"), F.lit(".html")))
    return rd.pages_after(p, mark + ".html").select("page_id", "url")


@query("json_roundtrip", """SELECT 'catalog' AS kind, r_regionkey::VARCHAR AS id, r_name AS text,
    r_regionkey::BIGINT AS n FROM region
UNION ALL SELECT 'document', item_id::VARCHAR, md5(text), length(text) FROM benchmark
UNION ALL SELECT 'chat', conv_id || '.' || (turn // 4), md5(role || text), turn % 4 FROM conversations""")
def json_roundtrip(spark, d):
    base = scratch_path(spark, "json")
    table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("Value"),
                                     F.col("r_name").alias("Text"),
                                     F.col("r_regionkey").cast("string").alias("STT")
                                     ).write.json(f"{base}/catalog")
    table(spark, d, "benchmark").write.json(f"{base}/docs")
    # one JSON object per chat page of four turns
    c = table(spark, d, "conversations").withColumn("page", F.floor(F.col("turn") / 4))
    c = c.groupBy("conv_id", "page").agg(F.transform(F.array_sort(
        F.collect_list(F.struct("turn", "role", "text"))),
        lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))
    key = F.concat_ws(".", F.col("conv_id").cast("string"), F.col("page").cast("string"))
    c.select(F.to_json(F.create_map(key, F.struct(F.lit("t").alias("title"), "messages"))).alias("value")
             ).write.text(f"{base}/chats")
    catalog = rd.read_catalog(spark, f"{base}/catalog", lines=True).select(
        F.lit("catalog").alias("kind"), "id", F.col("ten").alias("text"), F.col("stt").cast("long").alias("n"))
    found = rd.read_docs(spark, f"{base}/docs", "item_id long, text string", lines=True).select(
        F.lit("document"), F.col("item_id").cast("string"), F.md5("text"), F.length("text").cast("long"))
    chats = rd.parse_chats_json(spark.read.text(f"{base}/chats")).select(
        "chat_id", F.posexplode("messages").alias("n", "m")).select(
        F.lit("chat"), "chat_id", F.md5(F.concat("m.role", "m.content")), F.col("n").cast("long"))
    return catalog.union(found).union(chats)


@query("chats_json_list", """SELECT conv_id::VARCHAR AS title, (turn // 4)::VARCHAR AS chat_id, turn % 4 AS n,
    md5(role || text) AS message FROM conversations""")
def chats_json_list(spark, d):
    """Chats in list form, a JSON list of pages per conversation; their keys are their places."""
    base = scratch_path(spark, "json-list")
    c = table(spark, d, "conversations").withColumn("page", F.floor(F.col("turn") / 4))
    pages = c.groupBy("conv_id", "page").agg(F.transform(F.array_sort(
        F.collect_list(F.struct("turn", "role", "text"))),
        lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))
    lists = pages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("page", "messages"))).alias("p"))
    chat = F.transform("p", lambda x: F.struct(F.col("conv_id").cast("string").alias("title"), x["messages"].alias("messages")))
    lists.select(F.to_json(chat).alias("value")).write.text(f"{base}/chats")
    return rd.parse_chats_json(spark.read.text(f"{base}/chats")).select(
        "title", "chat_id", F.posexplode("messages").alias("n", "m")).select(
        "title", "chat_id", "n", F.md5(F.concat("m.role", "m.content")).alias("message"))


@query("evaluation_set", """SELECT md5(text) AS query, item_id || ',' || (item_id + 1) AS gold_docs,
    md5('answer to ' || text) AS gold_response FROM benchmark""")
def evaluation_set(spark, d):
    """Questions with their gold documents and answer, as JSON and read again."""
    path = scratch_path(spark, "eval")
    table(spark, d, "benchmark").select(
        F.col("text").alias("query"), F.array(F.col("item_id"), F.col("item_id") + 1).alias("gold_docs"),
        F.concat(F.lit("answer to "), "text").alias("gold_response")).write.json(path)
    return rd.read_eval(spark, path, lines=True).select(
        F.md5("query").alias("query"), F.array_join(F.col("gold_docs").cast("array<string>"), ",").alias("gold_docs"),
        F.md5("gold_response").alias("gold_response"))


RESULT_SQL = f"""WITH {HITS_SQL}
SELECT {{q}} AS query, id AS "offset", round(score, 6) AS score, 'semantic_search' AS strategy,
    md5(ten) AS ten, md5(substr(noidung, 1, 500)) AS noidung FROM hits WHERE rank <= 10"""


def _results(spark, d):
    h = rich_hits(spark, d, 10)
    return h.withColumns({"query": F.col("query_id").cast("string"), "score": F.round("score", 6),
                          "strategy": F.lit("semantic_search")})


CSV_TYPE = "query string, offset bigint, score double, strategy string, ten string, noidung string"


@query("csv_roundtrip", RESULT_SQL.format(q="query_id::VARCHAR"))
def csv_roundtrip(spark, d):
    path = scratch_path(spark, "csv")
    wr.write_results_csv(_results(spark, d), path)
    back = spark.read.schema(CSV_TYPE).options(**wr.CSV).csv(path)
    return back.withColumns({c: F.md5(F.coalesce(c, F.lit(""))) for c in ("ten", "noidung")})


@query("category_csv", """SELECT doc_id, replace(lang || '/' || source, '/', '-') AS category, n_chars
FROM documents""")
def category_csv(spark, d):
    path = scratch_path(spark, "category")
    t = table(spark, d, "documents").select("doc_id", F.concat("lang", F.lit("/"), "source").alias("category"),
                                            "n_chars")
    wr.write_by_category(t, path)
    return spark.read.schema("doc_id bigint, n_chars bigint, category string").options(**wr.CSV).csv(path)


@query("results_json", f"""WITH {HITS_SQL}
SELECT query_id::VARCHAR AS query, rank AS pos, id, round(score, 6) AS score FROM hits WHERE rank <= 10""")
def results_json(spark, d):
    path = scratch_path(spark, "results")
    wr.write_results_json(_results(spark, d), path)
    back = spark.read.schema("query string, results array<struct<rank:bigint,offset:bigint,score:double>>"
                             ).json(path)
    return back.select("query", F.explode("results").alias("r")).select(
        "query", F.col("r.rank").alias("pos"), F.col("r.offset").alias("id"), "r.score")


# ---- projections of hits ------------------------------------------------------------------

@query("full_hits", f"""WITH {HITS_SQL}
SELECT query_id, rank, mapc, md5({s_passage()}) AS passage, 0.8::DOUBLE AS score, 'phapdien' AS source
FROM hits WHERE rank <= 20""")
def full_hits(spark, d):
    return fu.to_full_hit(rich_hits(spark, d, 20), F.lit(0.8)).select(
        "query_id", "rank", "mapc", F.md5("passage").alias("passage"), "score", "source")


def _trunc_sql(x, n):
    return (f"CASE WHEN length({x}) <= {n} THEN {x} ELSE concat(regexp_replace(substr({x}, 1, {n - 20}), "
            f"'{WS}+$', ''), chr(10), '… [đã rút gọn]') END")


@query("short_hits", f"""WITH {HITS_SQL},
t AS (SELECT query_id, rank, mapc, noidung, {s_strip('noidung')} AS b, {s_strip(s_passage())} AS p
    FROM hits WHERE rank <= 20)
SELECT query_id, rank, mapc, md5({_trunc_sql('b', 400)}) AS noidung, md5({_trunc_sql('p', 600)}) AS passage,
    length(noidung) > length({_trunc_sql('b', 400)}) AS noidung_truncated FROM t""")
def short_hits(spark, d):
    return fu.to_short_hit(rich_hits(spark, d, 20), 400, 600).select(
        "query_id", "rank", "mapc", F.md5("noidung").alias("noidung"), F.md5("passage").alias("passage"),
        "noidung_truncated")


@query("passages", f"""WITH {HITS_SQL}
SELECT query_id, rank, mapc, md5(noidung) AS noidung, round(score, 4) AS score, 'phapdien' AS source,
    '' AS url, 'medium' AS trust_level, '[Web]' AS source_label FROM hits WHERE rank <= 20""")
def passages(spark, d):
    return fu.to_passages(rich_hits(spark, d, 20)).select(
        "query_id", "rank", "mapc", F.md5("noidung").alias("noidung"), "score", "source", "url",
        "trust_level", "source_label")


@query("context_pack", f"""WITH {HITS_SQL}
SELECT query_id, md5(string_agg('[Pháp Điển]' || chr(10) || noidung,
    chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context
FROM hits WHERE rank <= 20 GROUP BY query_id""")
def context_pack(spark, d):
    h = rich_hits(spark, d, 30).withColumns({"passage": F.col("noidung"), "source": F.lit("phapdien"),
                                             "source_label": F.lit(None).cast("string")})
    return fu.pack_context(h, 20).select("query_id", F.md5("context").alias("context"))


@query("web_sources", f"""WITH {WEB_SQL}
SELECT query_id, string_agg('⚠️ [Web] [' || ten || '](' || url || ')', chr(10) ORDER BY pos) AS lines
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS r FROM web0) WHERE r <= 20
GROUP BY query_id""")
def web_sources(spark, d):
    from ..dist import top_per
    w = web_rows(spark, d).withColumn("source", F.lit("web"))
    found = fu.web_sources(fu.to_passages(top_per(w, "query_id", ["pos"], 20)))
    footer = fu.sources_markdown(found)
    return footer.select("query_id", F.replace("footer", F.lit(fixed.SOURCES_HEADER + "\n"),
                                               F.lit("")).alias("lines"))


@query("harmonize_hits", f"""WITH {HITS_SQL}, {WEB_SQL}
SELECT query_id, rank, mapc, md5(noidung) AS noidung, md5(concat_ws(chr(10), nullif(ten, ''),
    nullif(noidung, ''))) AS passage, 0.8::DOUBLE AS score, 'phapdien' AS source FROM hits WHERE rank <= 10
UNION ALL SELECT query_id, rank, mapc, md5(noidung), md5(noidung), 0.85, 'phapdien' FROM hits WHERE rank <= 5
UNION ALL SELECT query_id, rank, mapc, md5(noidung), md5(concat_ws(chr(10), nullif(ten, ''),
    nullif(noidung, ''))), 1.0, 'phapdien' FROM hits WHERE rank <= 1
UNION ALL SELECT query_id, pos, '', md5(noidung), md5(noidung), 0.5, 'web' FROM web0""")
def harmonize_hits(spark, d):
    cols = ["query_id", "rank", "mapc", "ten", "noidung"]
    h = rich_hits(spark, d, 10).select(*cols)
    web = web_rows(spark, d).withColumn("rank", F.col("pos").cast("int"))
    parts = [fu.harmonize_hits(h, "vector_search"),
             fu.harmonize_hits(h.filter("rank <= 5"), "graph_traverse"),
             fu.harmonize_hits(h.filter("rank <= 1"), "get_full_article"),
             fu.harmonize_hits(web, "web_search")]
    from functools import reduce
    return reduce(lambda a, b: a.unionByName(b), parts).select(
        "query_id", "rank", "mapc", F.md5("noidung").alias("noidung"), F.md5("passage").alias("passage"),
        "score", "source")


@query("metric_csv", f"""WITH {VECTORS_SQL},
l AS (SELECT query_id, rank, (label = query_id)::INT AS rel FROM ranked WHERE rank <= 10),
p AS (SELECT query_id, sum(rel) / 10 AS p, max(rel) AS h FROM l GROUP BY query_id)
SELECT 'semantic_search' AS strategy, round(avg(p), 6) AS "Retrieval_precision",
    round(avg(h), 6) AS "Retrieval_hit" FROM p""")
def metric_csv(spark, d):
    from .retrieval import _per_query
    path = scratch_path(spark, "metrics")
    wr.write_metric_table(me.average_metrics(_per_query(spark, d)), 10, ["precision", "hit"], [], path)
    back = spark.read.schema("strategy string, Retrieval_precision double, Retrieval_hit double").option(
        "header", True).csv(path)
    return back.withColumns({c: F.round(c, 6) for c in back.columns[1:]})
