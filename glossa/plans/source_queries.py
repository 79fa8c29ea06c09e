"""Queries that read structured documents made from the tables, and those over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.plans.text_queries import Tables, registrar
from glossa.sources import documents, keyvalue

QUERIES: dict = {}
ORACLES: dict = {}
_add = registrar(QUERIES, ORACLES)


def _json(*pairs: tuple[str, F.Column]) -> F.Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in pairs]))


@_add("tree_walk", "SELECT 'p' || p_partkey AS file, '[\"a\", ' || i || ', \"text\"]' AS path, CASE i WHEN 0 THEN p_name ELSE p_type END AS text FROM part, range(2) t(i)")
def tree_walk(t: Tables) -> DataFrame:
    rows = F.array(F.struct(F.col("p_name").alias("text"), F.lit("x").alias("other")), F.struct(F.col("p_type").alias("text"), F.lit("y").alias("other")))
    files = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("file"), _json(("a", rows)).alias("content"))
    return documents.extracted(files, "menu_json").select("file", "path", "text")


@_add("game_json_paths", "SELECT 'p' || p_partkey AS file, 'ui.b.0.Item1' AS path, p_name AS text FROM part UNION ALL SELECT 'p' || p_partkey, 'ui.a', p_type FROM part")
def game_json_paths(t: Tables) -> DataFrame:
    item = F.array(F.struct(F.col("p_name").alias("Item1"), F.lit("skip").alias("Item2")))
    ui = F.struct(F.col("p_type").alias("a"), item.alias("b"))
    files = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("file"), _json(("name", F.lit("n")), ("ui", ui)).alias("content"))
    got = documents.extracted(files, "game_json")
    return got.select("file", F.array_join(F.from_json(F.regexp_replace("path", r"(?<=, )(\d+)", '"$1"'), "array<string>"), ".").alias("path"), "text")


@_add("snbt_parse", "SELECT 'p' || p_partkey AS file, '[\"title\"]' AS path, p_name AS text FROM part UNION ALL SELECT 'p' || p_partkey, '[\"tasks\", 0, \"description\", 0, \"{json}\", \"text\"]', p_type FROM part")
def snbt_parse(t: Tables) -> DataFrame:
    inner = F.replace(_json(("text", F.col("p_type"))), F.lit('"'), F.lit('\\"'))
    content = F.format_string('{ id: "%s", title: "%s"\n# note\n tasks: [{ n: 3b description: ["%s"] }], a: [I; 1, 2] }', F.col("p_partkey").cast("string"), "p_name", inner)
    return documents.extracted(t.part.select(F.concat(F.lit("p"), "p_partkey").alias("file"), content.alias("content")), "quest_snbt").select("file", "path", "text")


def _menus(t: Tables) -> DataFrame:
    content = F.format_string("type = screen\nelement {\n  instance_identifier = e%d\n  label = %s\n  hoverlabel = %s\n}\n", "p_partkey", "p_name", "p_type")
    return t.part.select(F.concat(F.lit("p"), "p_partkey").alias("file"), content.alias("content"))


@_add("fancymenu_parse", "SELECT 'p' || p_partkey AS file, '[\"e' || p_partkey || '\", \"label\"]' AS path, p_name AS text FROM part UNION ALL SELECT 'p' || p_partkey, '[\"e' || p_partkey || '\", \"hoverlabel\"]', p_type FROM part")
def fancymenu_parse(t: Tables) -> DataFrame:
    return documents.extracted(_menus(t), "menu_blocks").select("file", "path", "text")


@_add("mmt_txt_parse", "SELECT 'p' || p_partkey AS file, '[\"m\", \"k\"]' AS path, p_name AS text FROM part UNION ALL SELECT 'p' || p_partkey, '[\"m\", \"b\"]', p_type FROM part")
def mmt_txt_parse(t: Tables) -> DataFrame:
    content = F.format_string("lost = 1\n### AI_PROMPT ###\nno = no\n### [m] | [en_us] ###\n# c = d\nk = %s\n```\nx = y\n```\nb → %s", "p_name", "p_type")
    return documents.extracted(t.part.select(F.concat(F.lit("p"), "p_partkey").alias("file"), content.alias("content")), "mod_text").select("file", "path", "text")


def _scripts(t: Tables) -> DataFrame:
    content = F.format_string('// x\n<a:%d>.displayName = "%s"; <a:b>.addTooltip("%s"); <c:d>.addTooltip("z");', "p_partkey", "p_name", "p_type")
    return t.part.select(F.concat(F.lit("p"), "p_partkey").alias("file"), content.alias("content"))


@_add("zs_extract", "SELECT 'p' || p_partkey AS file, path, text FROM (SELECT p_partkey, unnest(['[\"2\", \"0\", \"displayName\"]', '[\"2\", \"0\", \"tooltip\"]', '[\"2\", \"1\", \"tooltip\"]']) AS path, unnest([p_name, p_type, 'z']) AS text FROM part)")
def zs_extract(t: Tables) -> DataFrame:
    return documents.extracted(_scripts(t), "script").select("file", "path", "text")


@_add("zs_splice", "SELECT 'p' || p_partkey AS file, '// x' || chr(10) || '<a:' || p_partkey || '>.displayName = \"' || upper(p_name) || '\"; <a:b>.addTooltip(\"' || upper(p_type) || '\"); <c:d>.addTooltip(\"Z\");' AS content FROM part")
def zs_splice(t: Tables) -> DataFrame:
    files = _scripts(t)
    return documents.rewritten(files, documents.extracted(files, "script").select("file", "path", F.upper("text").alias("text")), "script")


@_add("path_write_back", "SELECT 'p' || p_partkey AS file, p_name || '!' AS text FROM part UNION ALL SELECT 'p' || p_partkey, p_type || '!' FROM part")
def path_write_back(t: Tables) -> DataFrame:
    """Quest documents rewritten, then read again."""
    inner = F.replace(_json(("text", F.col("p_type"))), F.lit('"'), F.lit('\\"'))
    content = F.format_string('{ title: "%s", tasks: [{ description: ["%s"] }] }', "p_name", inner)
    files = t.part.select(F.concat(F.lit("p"), "p_partkey").alias("file"), content.alias("content"))
    new = documents.extracted(files, "quest_snbt").select("file", "path", F.concat("text", F.lit("!")).alias("text"))
    return documents.extracted(documents.rewritten(files, new, "quest_snbt"), "quest_snbt").select("file", "text")


@_add("command_extract", "SELECT 'p' || p_partkey AS file, '[\"line ' || n || '\"]' AS path, text FROM (SELECT p_partkey, unnest([1, 2, 4]) AS n, unnest([p_name, p_type, p_brand]) AS text FROM part)")
def command_extract(t: Tables) -> DataFrame:
    content = F.format_string("say %s\n/tellraw @a '{\"text\":\"%s\"}'\ntp @a 1 2\ngive @a stone '{display:{Name:\"%s\"}}'", "p_name", "p_type", "p_brand")
    return documents.extracted(t.part.select(F.concat(F.lit("p"), "p_partkey").alias("file"), content.alias("content")), "commands").select("file", "path", "text")


@_add("lang_round_trip", "SELECT 'l' || lang AS file, count(*) AS keys FROM documents GROUP BY lang")
def lang_round_trip(t: Tables) -> DataFrame:
    """Every document as a line of its language's file, written as text and read again."""
    rows = t.documents.select(F.concat(F.lit("l"), "lang").alias("file"), F.col("doc_id").alias("pos"), F.concat(F.lit("k"), "doc_id").alias("key"), F.coalesce("text", F.lit("")).alias("value"))
    lines = rows.withColumn("line", keyvalue.lang_line(F.col("key"), F.col("value"))).where(keyvalue.wanted_line(F.col("line")) & ~F.col("line").contains("\n"))
    return lines.select("file", *keyvalue.split_pair(F.col("line"))).groupBy("file").agg(F.count("key").alias("keys"))


@_add("translated_pipeline", "SELECT p_partkey, p_name || '|' || p_type AS text, upper(p_name || '|' || p_type) AS answer, 'done' AS state FROM part")
def translated_pipeline(t: Tables) -> DataFrame:
    """Batches of texts through a model, the answers joined back by position."""
    from glossa.operators import enrich, ordered

    rows = ordered.positioned(t.part.select("p_partkey", F.concat_ws("|", "p_name", "p_type").alias("text")), [], "p_partkey")
    batches = rows.groupBy(F.floor(F.col("position") / 5).alias("batch")).agg(F.array_sort(F.collect_list(F.struct("position", "text"))).alias("r"))
    got = enrich.enriched(batches.select("batch", F.transform("r", lambda x: x["text"]).alias("texts")), lambda: lambda texts: [x.upper() for x in texts])
    at = got.withColumn("position", F.col("batch") * 5 + F.col("pos")).select("position", "answer", "error")
    return rows.join(at, "position").select("p_partkey", "text", "answer", F.when(F.col("error").isNull(), "done").otherwise("failed").alias("state"))


@_add("stream_windows", "SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS requests, round(sum(value), 4) AS tokens FROM events GROUP BY 1, 2")
def stream_windows(t: Tables) -> DataFrame:
    """Hourly windows over the events as a stream with a watermark; the query ends when the table is read."""
    from glossa.streaming import rates, runner

    got = runner.finished(t.spark, f"{t.folder}/events.parquet", lambda e: rates.windowed(e.withColumn("ts", F.col("ts").cast("timestamp")), "event_type", "ts", "value", "1 hour", None, "31 days"), "complete")
    return got.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "requests", F.round("tokens", 4).alias("tokens"))


@_add("stream_rate_limit")
def stream_rate_limit(t: Tables) -> DataFrame:
    from glossa.streaming import rates, runner

    return runner.finished(t.spark, f"{t.folder}/events.parquet", lambda e: rates.limited(e, "event_type", "ts", "value", 2, 500.0, 3600), "append")


@_add("stream_incremental_knn", "WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings) SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.x, b.x), 6) AS score FROM v a, v b WHERE a.vec_id != b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY score DESC, b.vec_id) <= 5")
def stream_incremental_knn(t: Tables) -> DataFrame:
    """Vectors arrive as a stream and are appended to the table that the search reads."""
    from glossa.operators import knn
    from glossa.streaming import runner

    v = runner.appended(t.spark, f"{t.folder}/embeddings.parquet", ["vec_id", "embedding"])
    return knn.knn(v, v, 5, "cosine").select("query_id", "vec_id", "score")
