"""Queries over text, conversation, event and order tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.operators import filters, ordered, relational

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The tables of a folder, read when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def registrar(queries: dict[str, Query], oracles: dict[str, str]) -> Callable[..., Callable]:
    """A decorator that registers a function of Tables under a name, with its SQL if there is any."""

    def add(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
        def register(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            queries[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
            if sql:
                oracles[name] = sql
            return fn

        return register

    return add


_add = registrar(QUERIES, ORACLES)


WS = "[ \\t\\n\\r\\f]+"


def words(df: DataFrame, *keep: str) -> DataFrame:
    """(keep, pos, word): words between white space."""
    return df.select(*keep, F.posexplode(F.split("text", WS)).alias("pos", "word")).where("word != ''")


def first_word(c: str = "text") -> F.Column:
    return F.regexp_extract(c, r"^[^ \t\n\r\f]+", 0)


_W = r"(SELECT {0}, unnest(regexp_split_to_array(text, '[ \t\n\r\f]+')) AS word FROM {1})"
_FIRST = r"regexp_extract(text, '^[^ \t\n\r\f]+', 0)"

# Filters


@_add("kv_line_parse", r"""SELECT page_id, pos - 1 AS pos, split_part(line, '=', 1) AS key, substr(line, instr(line, '=') + 1) AS value
FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS pos FROM pages)
WHERE contains(line, '=') AND NOT starts_with(line, '#') AND NOT starts_with(line, '//')""")
def kv_line_parse(t: Tables) -> DataFrame:
    from glossa.sources.keyvalue import split_pair, wanted_line

    lines = t.pages.select("page_id", F.posexplode(F.split("html", "\n")).alias("pos", "line")).where(wanted_line(F.col("line")))
    return lines.select("page_id", F.col("pos").cast("long").alias("pos"), *split_pair(F.col("line")))


@_add("key_text_filter", f"""SELECT word, count(*) AS n FROM {_W.format('doc_id', 'documents')} WHERE word != '' AND NOT (regexp_full_match(word, '[a-z0-9._-]+') AND contains(word, '.')) GROUP BY word""")
def key_text_filter(t: Tables) -> DataFrame:
    return words(t.documents, "doc_id").where(filters.prose_text(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


def _asm_sql(c: str) -> str:
    alarm = " OR ".join(f"contains(lower({c}), '{x}')" for x in filters.ALARM)
    shout = " OR ".join(f"contains({c}, '{x}')" for x in filters.SHOUTED)
    names = " OR ".join(f"starts_with({c}, '{x}')" for x in filters.NAMESPACES)
    board = ", ".join(f"'{x}'" for x in filters.KEYBOARD)
    return rf"""NOT (regexp_full_match({c}, '[ \t\n\r\f]*') OR contains({c}, '_') OR regexp_full_match({c}, '[A-Z][[:alnum:]]+') OR regexp_full_match({c}, '[a-z]+[A-Z][[:alnum:]]*')
OR ({c} = lower({c}) AND {c} != upper({c}) AND NOT contains({c}, ' ') AND length({c}) < 15) OR (contains({c}, '.') AND regexp_full_match({c}, '[a-z0-9.\-]+')) OR contains({c}, 'http://') OR contains({c}, 'https://')
OR (contains({c}, '/') AND NOT starts_with({c}, 'http')) OR {names} OR regexp_matches({c}, '\{{[0-9]+\}}') OR contains({c}, '("') OR contains({c}, '")') OR contains({c}, '!!!') OR regexp_matches({c}, '\.[A-Z]')
OR {alarm} OR lower({c}) IN ({board}) OR ends_with(lower({c}), '.dll') OR (contains({c}, '.') AND regexp_matches({c}, ':[ \t\n\r\f]*$')) OR contains({c}, '::') OR regexp_matches({c}, '^\[[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') OR contains({c}, '-->')
OR regexp_full_match({c}, '[[:alnum:]]+(\.[[:alnum:]]+)+') OR ({c} = upper({c}) AND {c} != lower({c}) AND contains({c}, ' ') AND ({shout})))"""


@_add("asm_text_filter", f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents UNION ALL SELECT p_partkey, p_name FROM part) SELECT doc_id, count(*) AS kept FROM l WHERE {_asm_sql('line')} GROUP BY doc_id""")
def asm_text_filter(t: Tables) -> DataFrame:
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).unionAll(t.part.select("p_partkey", "p_name"))
    return lines.where(filters.assembly_text(F.col("line"))).groupBy("doc_id").agg(F.count("*").alias("kept"))


@_add("placeholder_filter", rf"""SELECT word, count(*) AS n FROM {_W.format('doc_id', 'documents')} WHERE word != '' AND NOT (regexp_full_match(word, '\{{[^}}]*\}}') OR regexp_full_match(word, '[^\p{{L}}\p{{N}}_]{{1,2}}')) GROUP BY word""")
def placeholder_filter(t: Tables) -> DataFrame:
    return words(t.documents, "doc_id").where(filters.not_placeholder(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


@_add("key_eq_text_drop", "SELECT a.doc_id, a.source AS key, a.lang AS text FROM documents a WHERE lower(left(a.source, 2)) != a.lang")
def key_eq_text_drop(t: Tables) -> DataFrame:
    d = t.documents
    return d.where(filters.differs(F.lower(F.substring("source", 1, 2)), F.col("lang"))).select("doc_id", F.col("source").alias("key"), F.col("lang").alias("text"))


@_add("word_filter", f"""SELECT DISTINCT word FROM {_W.format('doc_id', 'documents')} WHERE length(trim(word)) > 1 AND lower(word) NOT IN ('the', 'and', 'of', 'der', 'les')""")
def word_filter(t: Tables) -> DataFrame:
    return words(t.documents, "doc_id").where(filters.word_kept(F.col("word"), ["the", "and", "of", "der", "les"])).select("word").distinct()


@_add("active_hours", """SELECT event_type, count(*) AS events, count(*) FILTER (m >= 1320 OR m <= 360) AS night, count(*) FILTER (m BETWEEN 540 AND 1020) AS day
FROM (SELECT event_type, (hour(ts) * 60 + minute(ts)) AS m FROM events) GROUP BY event_type""")
def active_hours(t: Tables) -> DataFrame:
    e = t.events.withColumn("m", F.hour("ts") * 60 + F.minute("ts"))
    night, day = filters.active(F.col("m"), F.lit(22 * 60), F.lit(6 * 60)), filters.active(F.col("m"), F.lit(9 * 60), F.lit(17 * 60))
    return e.groupBy("event_type").agg(F.count("*").alias("events"), F.count_if(night).alias("night"), F.count_if(day).alias("day"))


@_add("config_override_clamp", "SELECT p_partkey, greatest(5::BIGINT, least(p_size::BIGINT, 40::BIGINT)) AS size FROM part WHERE regexp_matches(p_brand, '^Brand#[1-4]') AND NOT regexp_matches(p_type, 'BRASS')")
def config_override_clamp(t: Tables) -> DataFrame:
    p = t.part.where(filters.overridable(F.col("p_brand"), "^Brand#[1-4]", "$^") & ~F.col("p_type").rlike("BRASS"))
    return p.select("p_partkey", filters.clamped(F.col("p_size"), 5, 40).cast("long").alias("size"))


# Joins


@_add("ref_join_last_wins", """WITH r AS (SELECT left(text, 12) AS key, max(doc_id) AS ref_id FROM documents GROUP BY 1) SELECT d.doc_id, r.ref_id, x.lang AS ref_lang FROM documents d JOIN r ON left(d.text, 12) = r.key JOIN documents x ON x.doc_id = r.ref_id""")
def ref_join_last_wins(t: Tables) -> DataFrame:
    d = t.documents.withColumn("key", F.substring("text", 1, 12))
    return relational.referenced(d.select("doc_id", "key"), d.select("key", F.col("doc_id").alias("ref_id"), F.col("lang").alias("ref_lang")), "key", ["ref_id"]).select("doc_id", "ref_id", "ref_lang")


@_add("semi_split", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_split(t: Tables) -> DataFrame:
    return relational.split_known(t.documents, t.labels, "doc_id")[0].select("doc_id", "lang")


@_add("anti_split", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_split(t: Tables) -> DataFrame:
    return relational.split_known(t.documents, t.labels, "doc_id")[1].select("doc_id", "lang")


@_add("cache_lookup_hit_rate", f"""WITH w AS (SELECT lang, word FROM {_W.format('lang', 'documents')} WHERE word != ''), c AS (SELECT DISTINCT word FROM {_W.format('item_id', 'benchmark')})
SELECT lang, count(*) AS total, count(c.word) AS hits, printf('%.4f%%', count(c.word) * 100.0::DOUBLE / count(*)) AS rate FROM w LEFT JOIN c USING (word) GROUP BY lang""")
def cache_lookup_hit_rate(t: Tables) -> DataFrame:
    counted = words(t.documents, "lang").groupBy("lang", "word").agg(F.count("*").alias("n"))
    hit = relational.cached(counted, words(t.benchmark, "item_id").select("word").distinct(), "word")
    totals = hit.groupBy("lang").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("hits"))
    return totals.withColumn("rate", relational.rate_text(F.col("hits"), F.col("total")))


@_add("vocab_anti", f"SELECT word, count(*) AS n FROM {_W.format('doc_id', 'documents')} WHERE word != '' AND word NOT IN (SELECT word FROM {_W.format('item_id', 'benchmark')}) GROUP BY word")
def vocab_anti(t: Tables) -> DataFrame:
    counted = words(t.documents, "doc_id").groupBy("word").agg(F.count("*").alias("n"))
    return relational.split_known(counted, words(t.benchmark, "item_id"), "word")[1]


@_add("pair_join_multimap", "SELECT u.text AS source, string_agg(a.text, '|' ORDER BY u.conv_id, u.turn) AS targets FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant' AND u.text IS NOT NULL AND a.text IS NOT NULL GROUP BY u.text")
def pair_join_multimap(t: Tables) -> DataFrame:
    return relational.multimap(_pairs(t), "source", "target", ["conv_id", "turn"]).withColumn("targets", F.array_join("targets", "|"))


def _pairs(t: Tables) -> DataFrame:
    """User turns with the assistant's answers that follow them."""
    c = t.conversations.where("text is not null")
    u = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    a = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    return u.join(a, ["conv_id", "turn"])


@_add("merge_update_coalesce", """SELECT o_orderkey, coalesce(c.c_name, s.s_name, o_orderpriority) AS value FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') c ON c_custkey = o_custkey LEFT JOIN supplier s ON s_suppkey = o_custkey""")
def merge_update_coalesce(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"))
    patch = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value"))
    merged = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("value"))
    return relational.merge_update(rows, patch, merged, "key", "value").select("o_orderkey", "value")


@_add("separate_update_present", "SELECT o_orderkey, c_name AS value FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0")
def separate_update_present(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"))
    return relational.separate_update(rows, t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("value")), "key", "value").select("o_orderkey", "value")


@_add("separate_update_missing", "SELECT o_orderkey, o_orderpriority AS value FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def separate_update_missing(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("key"), F.col("o_orderpriority").alias("value"))
    return relational.separate_update(rows, t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("key")), "key", "value", "missing").select("o_orderkey", "value")


@_add("writeback_first_wins", """WITH r AS (SELECT l_orderkey, l_partkey, l_returnflag FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) = 1)
SELECT o_orderkey, o_orderstatus AS original, coalesce(l_returnflag, o_orderstatus) AS value FROM orders LEFT JOIN r ON l_orderkey = o_orderkey""")
def writeback_first_wins(t: Tables) -> DataFrame:
    r = relational.first_wins(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"])
    j = t.orders.join(r, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", F.col("o_orderstatus").alias("original"), F.coalesce("l_returnflag", "o_orderstatus").alias("value"))


@_add("assemble_precedence", """SELECT d.doc_id, coalesce('item ' || b.item_id, 'label ' || l.quality, d.lang) AS target FROM documents d LEFT JOIN (SELECT text, min(item_id) AS item_id FROM benchmark GROUP BY text) b ON b.text = d.text LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def assemble_precedence(t: Tables) -> DataFrame:
    items = t.benchmark.groupBy("text").agg(F.min("item_id").alias("item_id"))
    j = t.documents.join(items, "text", "left").join(t.labels, "doc_id", "left")
    return j.select("doc_id", F.coalesce(F.concat(F.lit("item "), "item_id"), F.concat(F.lit("label "), "quality"), "lang").alias("target"))


_DICT = rf"(SELECT word, doc_id AS reference, row_number() OVER (PARTITION BY word ORDER BY doc_id) AS rank FROM (SELECT {_FIRST} AS word, doc_id FROM documents) QUALIFY rank <= 3)"


@_add("word_lookup", rf"""WITH w AS (SELECT item_id, unnest(regexp_split_to_array(text, '[ _\-:]+')) AS word, generate_subscripts(regexp_split_to_array(text, '[ _\-:]+'), 1) AS pos FROM benchmark), d AS {_DICT}
SELECT item_id, string_agg(reference, ',' ORDER BY pos, rank) AS refs FROM w JOIN d USING (word) WHERE word != '' GROUP BY item_id""")
def word_lookup(t: Tables) -> DataFrame:
    # The three smallest ids of each word: a bounded aggregate, combined before the shuffle by taking the ranks of a pre-aggregated set.
    heads = t.documents.select(first_word().alias("word"), "doc_id")
    ranked = heads.withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy("doc_id"))).where("rank <= 3")
    got = relational.looked_up(t.benchmark, "item_id", "text", ranked.select("word", "rank", F.col("doc_id").cast("string").alias("reference")))
    return got.select("item_id", F.array_join("references", ",").alias("refs"))


@_add("length_band_join", f"SELECT item_id, doc_id FROM (SELECT item_id, text, {_FIRST} AS w FROM benchmark) b JOIN (SELECT doc_id, text, {_FIRST} AS w FROM documents) d ON b.w = d.w AND abs(length(b.text) - length(d.text)) <= 80")
def length_band_join(t: Tables) -> DataFrame:
    b = t.benchmark.select("item_id", F.col("text").alias("bt"), first_word().alias("w"))
    d = t.documents.select("doc_id", F.col("text").alias("dt"), first_word().alias("w"))
    return d.join(b, "w").where(filters.within_length(F.col("bt"), F.col("dt"), 80)).select("item_id", "doc_id")


@_add("file_pairing", """WITH p AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, lower(regexp_extract(path, '([^/]*)\\.[^./]*$', 1)) AS stem, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS ext
FROM (SELECT '/p/' || c_nationkey || '/' || (CASE WHEN c_custkey % 2 = 0 THEN 'en_US' ELSE 'zh_cn' END) || (CASE WHEN c_custkey % 3 = 0 THEN '.json' WHEN c_custkey % 3 = 1 THEN '.LANG' ELSE '.local' END) AS path FROM customer))
SELECT dir, s.ext, min(s.path) AS source_path, min(t.path) AS target_path FROM p s JOIN p t USING (dir, ext) WHERE s.stem = 'en_us' AND t.stem = 'zh_cn' GROUP BY dir, s.ext QUALIFY row_number() OVER (PARTITION BY dir ORDER BY CASE ext WHEN 'json' THEN 0 WHEN 'lang' THEN 1 ELSE 2 END) = 1""".replace("\\\\", "\\"))
def file_pairing(t: Tables) -> DataFrame:
    stem = F.when(F.col("c_custkey") % 2 == 0, "en_US").otherwise("zh_cn")
    ext = F.when(F.col("c_custkey") % 3 == 0, ".json").when(F.col("c_custkey") % 3 == 1, ".LANG").otherwise(".local")
    return relational.paired_files(t.customer.select(F.concat(F.lit("/p/"), "c_nationkey", F.lit("/"), stem, ext).alias("path")), "en_us", "zh_cn")


@_add("best_candidate", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def best_candidate(t: Tables) -> DataFrame:
    return relational.best_candidate(t.orders, "o_custkey", "o_orderkey", "o_totalprice", "o_orderkey")


# Dictionaries

_PAIRS = f"(SELECT {_FIRST} AS source, role || ' ' || left(text, 6) AS target, conv_id, turn FROM conversations WHERE text IS NOT NULL)"


def _entries(t: Tables) -> DataFrame:
    c = t.conversations.where("text is not null")
    return c.select(first_word().alias("source"), F.concat("role", F.lit(" "), F.substring("text", 1, 6)).alias("target"), "conv_id", "turn")


@_add("dict_dense", f"SELECT source, coalesce(string_agg(target, ', ' ORDER BY p), '') AS text FROM (SELECT source, target, min((conv_id, turn)) FILTER (length(target) <= 11) AS p, length(target) <= 11 AS fit FROM {_PAIRS} GROUP BY source, target) GROUP BY source".replace("string_agg(target, ', ' ORDER BY p)", "string_agg(target, ', ' ORDER BY p) FILTER (fit)"))
def dict_dense(t: Tables) -> DataFrame:
    return relational.dense(relational.multimap(_entries(t), "source", "target", ["conv_id", "turn"]), 11)


_SPARSE = f"(SELECT source, target FROM {_PAIRS} WHERE length(target) <= 11 QUALIFY row_number() OVER (PARTITION BY target ORDER BY conv_id, turn) = 1)"


@_add("dict_sparse", f"SELECT * FROM {_SPARSE}")
def dict_sparse(t: Tables) -> DataFrame:
    return relational.sparse(_entries(t), 11, ["conv_id", "turn"])


@_add("dict_reversal", f"WITH s AS {_SPARSE} SELECT * FROM s UNION ALL SELECT target, source FROM s")
def dict_reversal(t: Tables) -> DataFrame:
    return relational.sparse(_entries(t), 11, ["conv_id", "turn"], reversal=True)


@_add("dict_merge_union", """WITH r AS (SELECT o_orderpriority AS target, o_custkey AS source, o_orderkey AS pos, o_orderstatus = 'F' AS first FROM orders),
d AS (SELECT source, target, min(CASE WHEN first THEN pos ELSE pos + 1000000000000 END) AS p FROM r GROUP BY source, target) SELECT source, string_agg(target, ',' ORDER BY p) AS targets FROM d GROUP BY source""")
def dict_merge_union(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_custkey").alias("source"), F.col("o_orderpriority").alias("target"), "o_orderkey", "o_orderstatus")
    a, b = (relational.multimap(o.where(c), "source", "target", ["o_orderkey"]).withColumn("targets", F.array_distinct("targets")) for c in ("o_orderstatus = 'F'", "o_orderstatus != 'F'"))
    return relational.merged_dictionaries(a, b).withColumn("targets", F.array_join("targets", ","))


@_add("dict_dedupe", "SELECT sum(n)::BIGINT AS before, sum(u)::BIGINT AS after FROM (SELECT count(o_orderpriority) AS n, count(DISTINCT o_orderpriority) AS u FROM orders GROUP BY o_custkey)")
def dict_dedupe(t: Tables) -> DataFrame:
    d = t.orders.groupBy("o_custkey", "o_orderpriority").agg(F.count("o_orderpriority").alias("n"))
    return d.agg(F.sum("n").alias("before"), F.count(F.when(F.col("n") > 0, 1)).alias("after"))


@_add("ordered_distinct", """SELECT doc_id, count(*) AS lines, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM (SELECT doc_id, line, min(pos) AS pos FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) GROUP BY doc_id, line) GROUP BY doc_id""")
def ordered_distinct(t: Tables) -> DataFrame:
    lines = F.array_distinct(F.split("text", "\n"))
    return t.documents.where("text is not null").select("doc_id", F.size(lines).cast("long").alias("lines"), F.md5(F.array_join(lines, "\n")).alias("digest"))


@_add("group_by_file", "SELECT conv_id, count(*) AS n, md5(string_agg(text, chr(10) ORDER BY turn)) AS digest FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def group_by_file(t: Tables) -> DataFrame:
    g = relational.multimap(t.conversations.where("text is not null"), "conv_id", "text", ["turn"])
    return g.select("conv_id", F.size("targets").cast("long").alias("n"), F.md5(F.array_join("targets", "\n")).alias("digest"))


@_add("word_union", f"SELECT word FROM {_W.format('doc_id', 'documents')} WHERE word != '' UNION SELECT word FROM {_W.format('item_id', 'benchmark')} WHERE word != ''")
def word_union(t: Tables) -> DataFrame:
    return words(t.documents, "doc_id").select("word").union(words(t.benchmark, "item_id").select("word")).distinct()


@_add("language_overlap", f"SELECT a.lang AS a, b.lang AS b, count(*) AS shared FROM (SELECT DISTINCT lang, word FROM {_W.format('lang', 'documents')} WHERE word != '') a JOIN (SELECT DISTINCT lang, word FROM {_W.format('lang', 'documents')} WHERE word != '') b USING (word) WHERE a.lang < b.lang GROUP BY a.lang, b.lang")
def language_overlap(t: Tables) -> DataFrame:
    # One row for each word with its languages: pairs arise inside it, without a self join.
    w = words(t.documents, "lang").groupBy("word").agg(F.array_sort(F.collect_set("lang")).alias("l"))
    return w.select(F.explode("l").alias("a"), "l").select("a", F.explode("l").alias("b")).where("a < b").groupBy("a", "b").agg(F.count("*").alias("shared"))


# Batches and windows


@_add("balanced_batches", """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS position, count(*) OVER (PARTITION BY lang) AS n FROM documents),
g AS (SELECT *, greatest(1, round_even(n / 7.5, 0)::BIGINT) AS g FROM r) SELECT doc_id, lang, position, ((position + 1) * g + n - 1) // n - 1 AS batch FROM g""")
def balanced_batches(t: Tables) -> DataFrame:
    return ordered.balanced_batches(t.documents.select("doc_id", "lang"), ["lang"], "doc_id", 7.5)


@_add("greedy_batches", """WITH RECURSIVE d AS (SELECT source, doc_id, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
p AS (SELECT source, r, doc_id, size, size AS cur, CASE WHEN size > 1536 THEN 1 ELSE 0 END::BIGINT AS batch FROM d WHERE r = 1
UNION ALL SELECT d.source, d.r, d.doc_id, d.size, CASE WHEN p.cur + d.size > 1536 THEN d.size ELSE p.cur + d.size END, p.batch + CASE WHEN p.cur + d.size > 1536 THEN 1 ELSE 0 END FROM p JOIN d ON d.source = p.source AND d.r = p.r + 1)
SELECT source, doc_id, size, batch FROM p""")
def greedy_batches(t: Tables) -> DataFrame:
    return ordered.greedy_batches(t.documents, "source", "doc_id", F.col("n_chars"), 512 * 3)


@_add("prefix_budget", "SELECT source, doc_id, used FROM (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS used FROM documents) WHERE used <= 20000")
def prefix_budget(t: Tables) -> DataFrame:
    return ordered.within_budget(t.documents.select("source", "doc_id", "n_chars"), ["source"], "doc_id", F.col("n_chars"), 20000).select("source", "doc_id", "used")


@_add("context_prev_n", "SELECT conv_id, turn, coalesce(string_agg(text, '|') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), '') AS context FROM conversations")
def context_prev_n(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.array_join(F.collect_list("text").over(relational.previous(None, "conv_id", "turn", 3)), "|").alias("context"))


@_add("context_first_n", "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) <= 4")
def context_first_n(t: Tables) -> DataFrame:
    return t.conversations.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).where("r <= 4").select("conv_id", "turn", "role")


@_add("context_space", """WITH d AS (SELECT conv_id, turn, role, text, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM conversations),
a AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'assistant')
SELECT d.conv_id, d.turn, coalesce(string_agg(a.text, '|' ORDER BY a.k), '') AS context FROM d LEFT JOIN a ON a.conv_id = d.conv_id AND a.k <= d.done AND a.k > d.done - 2 WHERE d.role != 'assistant' GROUP BY d.conv_id, d.turn""")
def context_space(t: Tables) -> DataFrame:
    """The two nearest answered rows before each open one."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    text = F.when(F.col("role") == "assistant", F.col("text"))
    # Each answered row carries the one before it, so that no list of rows is held.
    pair = F.when(text.isNotNull(), F.struct(F.last(text, True).over(before).alias("p"), text.alias("t")))
    near = F.last("pair", True).over(before)
    rows = t.conversations.select("conv_id", "turn", "role", pair.alias("pair")).withColumn("near", near)
    return rows.where("role != 'assistant'").select("conv_id", "turn", F.concat_ws("|", "near.p", "near.t").alias("context"))


@_add("sliding_60s_requests_tokens", """SELECT event_id, count(*) OVER w AS requests, round(sum(value) OVER w, 4) AS tokens FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL '59.999999 seconds' PRECEDING AND CURRENT ROW)""")
def sliding_60s_requests_tokens(t: Tables) -> DataFrame:
    from glossa.streaming.rates import sliding

    return sliding(t.events, "event_type", "ts", "value", 60).select("event_id", "requests", F.round("tokens", 4).alias("tokens"))


@_add("tumbling_windows", "SELECT event_type, time_bucket(INTERVAL '1 day', ts) AS start, count(*) AS requests, round(sum(value), 4) AS tokens FROM events GROUP BY 1, 2")
def tumbling_windows(t: Tables) -> DataFrame:
    g = t.events.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("requests"), F.round(F.sum("value"), 4).alias("tokens"))
    return g.select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "requests", "tokens")


@_add("session_windows", """WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM s) SELECT user_id, min(ts) AS start, count(*) AS events FROM n GROUP BY user_id, s""")
def session_windows(t: Tables) -> DataFrame:
    g = t.events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("events"))
    return g.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "events")


_TIERS = [(0, "small", 0, 1439), (50, "night", 1320, 360), (60, "medium", 480, 1080), (70, "large", 0, 1439)]


@_add("tier_select", f"""WITH u AS (SELECT user_id, count(*) AS n, min(hour(ts) * 60 + minute(ts)) AS m FROM events GROUP BY user_id), t(least, tier, a, z) AS (VALUES {', '.join(map(str, _TIERS))})
SELECT user_id, n, tier FROM u JOIN t ON n >= least AND CASE WHEN a <= z THEN m BETWEEN a AND z ELSE m >= a OR m <= z END QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY least DESC) = 1""")
def tier_select(t: Tables) -> DataFrame:
    u = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.min(F.hour("ts") * 60 + F.minute("ts")).alias("m"))
    tiers = t.spark.createDataFrame(_TIERS, "least int, tier string, a int, z int")
    fit = u.join(F.broadcast(tiers), (F.col("n") >= F.col("least")) & filters.active(F.col("m"), F.col("a"), F.col("z")))
    return fit.groupBy("user_id", "n").agg(F.max_by("tier", "least").alias("tier"))


@_add("retry_delay", "SELECT n::BIGINT AS attempt, round(5.0 * pow(1.2, n - 1), 6)::DOUBLE AS delay FROM range(1, 9) t(n)")
def retry_delay(t: Tables) -> DataFrame:
    return t.spark.range(1, 9).select(F.col("id").alias("attempt"), F.round(5.0 * F.pow(F.lit(1.2), F.col("id") - 1), 6).alias("delay"))


@_add("error_classes", "SELECT event_id, CASE WHEN c IN (400, 401, 422, 500, 503) THEN 'fatal' WHEN c >= 400 THEN 'retry' ELSE 'done' END AS class FROM (SELECT event_id, 380 + CAST(json_extract_string(props, '$.k') AS INT) + CASE WHEN event_type = 'error' THEN 60 ELSE 0 END AS c FROM events)")
def error_classes(t: Tables) -> DataFrame:
    code = 380 + F.get_json_object("props", "$.k").cast("int") + F.when(F.col("event_type") == "error", 60).otherwise(0)
    return t.events.select("event_id", F.when(code.isin(400, 401, 422, 500, 503), "fatal").when(code >= 400, "retry").otherwise("done").alias("class"))


@_add("cache_eviction", """WITH c AS (SELECT user_id AS key, count(*) AS freq, date_diff('day', min(ts)::DATE, DATE '2024-03-01') AS age FROM events GROUP BY user_id)
SELECT key, round(freq / (age + 1.0::DOUBLE), 9) AS score FROM c WHERE age <= 40 OR freq / (age + 1.0::DOUBLE) >= 1.0 ORDER BY score DESC, key LIMIT 100""")
def cache_eviction(t: Tables) -> DataFrame:
    c = t.events.groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("freq"), F.datediff(F.min("ts").cast("date"), F.lit("1970-01-01").cast("date")).alias("born"))
    return relational.evicted(c, F.datediff(F.lit("2024-03-01").cast("date"), F.lit("1970-01-01").cast("date")), 40, 1.0, 100)


@_add("ttl_cleanup", "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOUR")
def ttl_cleanup(t: Tables) -> DataFrame:
    last = t.events.agg(F.max("ts").alias("last"))
    return t.events.crossJoin(F.broadcast(last)).where(F.col("ts") >= F.col("last") - F.expr("interval 48 hours")).select("event_id")


@_add("token_estimate", f"""WITH c AS (SELECT lang, sum(length(text))::BIGINT AS chars, sum(len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f]+'), lambda w: w != '')))::BIGINT AS tokens FROM documents GROUP BY lang)
SELECT lang, chars, tokens, round(tokens / chars::DOUBLE, 9) AS ratio FROM c""".replace("\\\\", "\\"))
def token_estimate(t: Tables) -> DataFrame:
    n = F.regexp_count("text", F.lit(r"[^ \t\n\r\f]+"))
    return t.documents.groupBy("lang").agg(F.sum(F.char_length("text")).alias("chars"), F.sum(n).alias("tokens")).withColumn("ratio", F.round(F.col("tokens") / F.col("chars"), 9))


@_add("token_totals", "SELECT role, sum(length(text))::BIGINT AS chars, sum(length(text)) FILTER (turn > 0)::BIGINT AS later, count(*) AS n FROM conversations GROUP BY role")
def token_totals(t: Tables) -> DataFrame:
    size = F.char_length("text")
    return t.conversations.groupBy("role").agg(F.sum(size).alias("chars"), F.sum(F.when(F.col("turn") > 0, size)).alias("later"), F.count("*").alias("n"))


@_add("ema_rate", "SELECT user_id, round(list_reduce(list_prepend(0.0::DOUBLE, list(value ORDER BY ts, event_id)), lambda a, x: 0.6 * a + 0.4 * x), 4) AS rate FROM events GROUP BY user_id")
def ema_rate(t: Tables) -> DataFrame:
    v = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    return t.events.groupBy("user_id").agg(v.alias("v")).select("user_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: 0.6 * a + 0.4 * x["value"]), 4).alias("rate"))


@_add("rank_tail", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def rank_tail(t: Tables) -> DataFrame:
    return t.events.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))).where("r <= 5").select("user_id", "event_id")


# Enrichment


@_add("prompt_build", """SELECT conv_id, turn, CASE WHEN c IS NULL THEN '' ELSE '<context>' || c || '</context>' END || '<rt>' || text || '</rt>' AS prompt
FROM (SELECT conv_id, turn, text, string_agg(role || '=' || text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS c FROM conversations)""")
def prompt_build(t: Tables) -> DataFrame:
    from glossa.operators.enrich import prompt

    pair = F.concat("role", F.lit("="), "text")
    c = t.conversations.select("conv_id", "turn", "text", F.collect_list(pair).over(relational.previous(None, "conv_id", "turn", 2)).alias("c"))
    return c.select("conv_id", "turn", prompt(F.col("c"), F.array().cast("array<string>"), F.array("text")).alias("prompt"))


_WRAPPED = "(SELECT conv_id, max(turn) AS turns, '<think>plan' || chr(10) || '</think>' || string_agg('<rt>' || text || '</rt>', chr(10) ORDER BY turn) || CASE WHEN count(*) % 3 = 0 THEN '<rt>open' ELSE '' END AS response, count(*) + CASE WHEN conv_id % 5 = 0 THEN 1 ELSE 0 END AS asked FROM conversations GROUP BY conv_id)"


def _responses(t: Tables) -> DataFrame:
    g = relational.multimap(t.conversations, "conv_id", "text", ["turn"])
    body = F.array_join(F.transform("targets", lambda x: F.concat(F.lit("<rt>"), x, F.lit("</rt>"))), "\n")
    n = F.size("targets")
    return g.select("conv_id", F.concat(F.lit("<think>plan\n</think>"), body, F.when(n % 3 == 0, "<rt>open").otherwise("")).alias("response"), (n + F.when(F.col("conv_id") % 5 == 0, 1).otherwise(0)).cast("long").alias("asked"))


@_add("response_parse", f"SELECT conv_id, pos - 1 AS pos, answer FROM (SELECT conv_id, unnest(a) AS answer, generate_subscripts(a, 1) AS pos FROM (SELECT conv_id, regexp_extract_all(regexp_replace(response, '(?s)<think>.*?</think>', '', 'g'), '(?s)<rt>(.*?)</rt>', 1) AS a FROM {_WRAPPED}))")
def response_parse(t: Tables) -> DataFrame:
    from glossa.operators.enrich import answers

    return _responses(t).select("conv_id", F.posexplode(answers(F.col("response"))).alias("pos", "answer")).withColumn("pos", F.col("pos").cast("long"))


@_add("cardinality_check", f"SELECT conv_id, asked, len(regexp_extract_all(regexp_replace(response, '(?s)<think>.*?</think>', '', 'g'), '(?s)<rt>(.*?)</rt>', 1)) AS got, got = asked AS valid FROM {_WRAPPED}")
def cardinality_check(t: Tables) -> DataFrame:
    from glossa.operators.enrich import answers

    got = F.size(answers(F.col("response"))).cast("long")
    return _responses(t).select("conv_id", "asked", got.alias("got"), (got == F.col("asked")).alias("valid"))


@_add("model_name_norm", r"SELECT DISTINCT p_brand || ' @ ' || p_type AS name, lower(regexp_replace(regexp_replace(p_brand || ' @ ' || p_type, '[@:].*$', ''), '[ _\-]', '', 'g')) AS model FROM part")
def model_name_norm(t: Tables) -> DataFrame:
    from glossa.operators.enrich import model_name

    d = t.part.select(F.concat("p_brand", F.lit(" @ "), "p_type").alias("name")).distinct()
    return d.withColumn("model", model_name(F.col("name")))


@_add("json_path_fallback", "SELECT event_id, coalesce(json_extract_string(props, '$.name'), json_extract_string(props, '$.k'), '') AS value FROM events")
def json_path_fallback(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.coalesce(F.get_json_object("props", "$.name"), F.get_json_object("props", "$.k"), F.lit("")).alias("value"))


@_add("display_format", "SELECT conv_id, turn, role || '(' || text || ')' AS shown FROM conversations")
def display_format(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", F.format_string("%s(%s)", "role", "text").alias("shown"))


@_add("http_item_ingest", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name || ' | ' || p_type ELSE p_name END AS item FROM part")
def http_item_ingest(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.concat_ws(" | ", "p_name", F.when(F.col("p_size") > 25, F.col("p_type"))).alias("item"))


@_add("tooltip_clean", "SELECT p_partkey, string_agg(regexp_replace(x, '§.', '', 'g'), ' ' ORDER BY i) AS tooltip FROM (SELECT p_partkey, unnest(string_split('§a' || replace(p_name, ' ', '|§8') || '|' || p_type, '|')) AS x, generate_subscripts(string_split('§a' || replace(p_name, ' ', '|§8') || '|' || p_type, '|'), 1) AS i FROM part) WHERE NOT contains(x, '§8') AND length(regexp_replace(x, '§.', '', 'g')) > 1 GROUP BY p_partkey")
def tooltip_clean(t: Tables) -> DataFrame:
    lines = F.split(F.concat(F.lit("§a"), F.replace("p_name", F.lit(" "), F.lit("|§8")), F.lit("|"), "p_type"), r"\|")
    clean = F.filter(F.transform(F.filter(lines, lambda x: ~x.contains("§8")), lambda x: F.regexp_replace(x, "§.", "")), lambda x: F.char_length(x) > 1)
    return t.part.select("p_partkey", F.array_join(clean, " ").alias("tooltip")).where("tooltip != ''")


@_add("locale_lookup", "SELECT c_custkey, coalesce(n_name, r_name, 'key.' || c_nationkey) AS message FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey != 2 LEFT JOIN region ON r_regionkey = c_nationkey")
def locale_lookup(t: Tables) -> DataFrame:
    j = t.customer.join(t.nation.where("n_regionkey != 2"), F.col("n_nationkey") == F.col("c_nationkey"), "left").join(t.region, F.col("r_regionkey") == F.col("c_nationkey"), "left")
    return j.select("c_custkey", F.coalesce("n_name", "r_name", F.concat(F.lit("key."), "c_nationkey")).alias("message"))


@_add("byte_units", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN printf('%.2f B', n_chars::DOUBLE) WHEN n_chars < 1048576 THEN printf('%.2f KB', n_chars / 1024.0::DOUBLE) ELSE printf('%.2f MB', n_chars / 1048576.0::DOUBLE) END AS size FROM documents")
def byte_units(t: Tables) -> DataFrame:
    n = F.col("n_chars").cast("double")

    def shown(unit: str, x: F.Column) -> F.Column:
        return F.format_string(f"%.2f {unit}", F.bround(x, 2))

    return t.documents.select("doc_id", F.when(n < 1024, shown("B", n)).when(n < 1048576, shown("KB", n / 1024)).otherwise(shown("MB", n / 1048576)).alias("size"))


@_add("upload_dedupe", "SELECT md5(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def upload_dedupe(t: Tables) -> DataFrame:
    return t.documents.where("text is not null").groupBy(F.md5("text").alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@_add("embed_dedupe_fanout", "SELECT d.doc_id, first AS embed_id FROM documents d JOIN (SELECT text, min(doc_id) AS first FROM documents GROUP BY text) u USING (text)")
def embed_dedupe_fanout(t: Tables) -> DataFrame:
    # The digest travels, not the text; only one row of each digest would be embedded.
    d = t.documents.where("text is not null").select("doc_id", F.sha2("text", 256).alias("key"))
    return d.join(d.groupBy("key").agg(F.min("doc_id").alias("embed_id")), "key").select("doc_id", "embed_id")


# Training sets


@_add("chatml_export", """SELECT '{"messages":[{"role":"system","content":"Translate into French"},{"role":"user","content":' || to_json(u.text) || '},{"role":"assistant","content":' || to_json(a.text) || '}]}' AS line
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""")
def chatml_export(t: Tables) -> DataFrame:
    from glossa.sources.datasets import chatml

    return _pairs(t).select(chatml(F.col("source"), F.col("target"), "Translate into French").alias("line"))


@_add("alpaca_export", """SELECT '{"instruction":"Translate into French","input":' || to_json(u.text) || ',"output":' || to_json(a.text) || '}' AS line
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""")
def alpaca_export(t: Tables) -> DataFrame:
    from glossa.sources.datasets import alpaca

    return _pairs(t).select(alpaca(F.lit("Translate into French"), F.col("source"), F.col("target")).alias("line"))


@_add("alpaca_batched")
def alpaca_batched(t: Tables) -> DataFrame:
    from glossa.sources.datasets import alpaca_batches

    return alpaca_batches(_pairs(t).withColumn("glossary", F.array(F.concat(first_word("source"), F.lit("="), first_word("target")))), ["conv_id", "turn"], "Translate", seed=1)


@_add("seeded_sample")
def seeded_sample(t: Tables) -> DataFrame:
    """A tenth of the documents, the same ones however the table is partitioned."""
    return t.documents.select("doc_id").where(F.pmod(F.xxhash64("doc_id", F.lit(42)), F.lit(10)) == 0)


@_add("seeded_shuffle")
def seeded_shuffle(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.xxhash64("doc_id", F.lit(42)).alias("place")).orderBy("place", "doc_id")
