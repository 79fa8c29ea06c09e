from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from glossa.operators import caches, search
from glossa.plans import hook


def test_a_cache_makes_each_key_once(spark, tmp_path):
    made = []

    def make(missing):
        keys = [r.key for r in missing.collect()]
        made.extend(keys)
        return spark.createDataFrame([(k, k * 2) for k in keys if k != "bad"], "key string, value string")

    c = caches.Cache(spark, str(tmp_path / "c"))
    assert c.rows().count() == 0 and c.flush() == 0
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "bad")], "id long, text string").withColumn("value", F.lit("old"))
    got = {r.id: (r.value, r.hit) for r in c.read_through(rows, F.col("text"), make).collect()}
    assert got == {1: ("aa", False), 2: ("bb", False), 3: ("aa", False), 4: (None, False), 5: (None, False)}
    assert sorted(made) == ["a", "b", "bad"]
    got = {r.id: (r.value, r.hit) for r in c.read_through(rows, F.col("text"), make).collect()}
    assert got[1] == ("aa", True) and sorted(made) == ["a", "b", "bad", "bad"]
    c.put(spark.createDataFrame([("a", "newer"), (None, "x"), ("y", None)], "key string, value string"))
    assert {r.key: (r.value, r.uses) for r in c.rows().collect()} == {"a": ("newer", 4), "b": ("bb", 2)}
    before = c.rows()
    assert c.flush(F.col("uses") > 2) == 1
    assert {r.key: (r.value, r.uses) for r in c.rows().collect()} == {"a": ("newer", 4)}
    assert before.count() == 2  # a plan made before still reads the older generation
    assert c.flush() == 2 and c.rows().count() == 1


def test_upserts_and_ages(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b"), (None, 1, "n")], "k long, o long, v string")
    new = spark.createDataFrame([(1, 2, "A"), (2, 4, "late"), (3, 1, "c"), (None, 1, "N")], "k long, o long, v string")
    got = {r.k: r.v for r in caches.upserted(old, new, ["k"], "o").collect()}
    assert got == {1: "A", 2: "b", 3: "c", None: "N"}
    t = spark.sql("SELECT * FROM VALUES (1, timestamp'2024-01-02 00:00:00'), (2, timestamp'2024-01-01 00:00:00'), (3, timestamp'2023-12-31 23:59:59'), (4, null) t(id, at)")
    assert sorted(r.id for r in caches.within_age(t, "at", F.lit("2024-01-02 00:00:00"), 24).collect()) == [1, 2]


def words(texts):
    """Counts of letters: texts of the same letters are near."""
    return [[float(t.count(c)) + 0.01 for c in "abcdefgh"] for t in texts]


def test_semantic_search_and_saved_indexes(spark, tmp_path):
    names = ["aaa", "aab", "bbb", "ccc", "ddd", "hhh"]
    base = spark.createDataFrame([(i, [float(x) for x in words([n])[0]]) for i, n in enumerate(names)], "vec_id long, embedding array<float>")
    titles = spark.createDataFrame(list(enumerate(names)), "vec_id long, name string")
    queries = spark.createDataFrame([(0, "aaaa"), (1, "hh"), (2, "bad\x01"), (3, None)], "query_id long, text string")
    index = search.build(base, search.parse(["refine", ["sq", None, {"codec": "Q8_K"}], {"factor": 3}]))
    got = {r.query_id: r.names for r in search.semantic(queries, titles, index, lambda: words, 2).collect()}
    assert got[0][:2] == ["aaa", "aab"] and got[1][0] == "hhh" and got[2] == got[3] == [] and len(got[0]) == 6
    index.save(str(tmp_path / "i"))
    again = search.load(spark, str(tmp_path / "i"), base)
    assert again.fingerprint() == index.fingerprint() and again.spec == index.spec
    assert sorted(map(tuple, again.search(base, 2).collect())) == sorted(map(tuple, index.search(base, 2).collect()))
    with pytest.raises(ValueError):
        search.load(spark, str(tmp_path / "i"), base.where("vec_id > 0"))
    deep = "flat"
    for _ in range(70):
        deep = ["refine", deep]
    with pytest.raises(ValueError):
        search.parse(deep)
    assert search.parse("graph").metric == "ip" and search.parse(["pq"]).kind == "pq"


def test_one_failing_text_leaves_the_others_their_vectors(spark):
    def model(texts):
        if "bad" in texts:
            raise ValueError("no")
        return words(texts)

    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "b")], "vec_id long, text string").coalesce(1)
    got = {r.vec_id: r.embedding for r in search.embedded(rows, "vec_id", search.templated(F.col("text")), lambda: model, dims=3).collect()}
    assert got[2] is None and len(got[1]) == len(got[3]) == 3
    assert spark.range(1).select(search.templated(F.lit("x"), "query", {"query": "q: {}!"}).alias("t")).first().t == "q: x!"


def test_reranking(spark):
    rows = spark.createDataFrame([(1, "q", "a"), (1, "q", "bbb"), (2, "q", "only"), (3, "q", "same"), (3, "q", "meas")], "query_id long, query string, candidate string")
    calls = lambda: (lambda queries, texts: [len(set(t)) / len(t) * len(t) for t in texts] if "only" not in texts else 1 / 0)
    got = {r.query_id: (r.candidate, r.score) for r in search.reranked(rows, calls).collect()}
    assert got == {1: ("a", 1.0), 2: ("only", None), 3: ("meas", 4.0)}


def test_a_folder_passes_through_the_hook(spark, tmp_path):
    for mod in ("a", "b"):
        (tmp_path / "in" / mod / "lang").mkdir(parents=True)
        (tmp_path / "in" / mod / "lang" / "en_us.lang").write_text(f"# note\nitem.name=Stone {mod}\nitem.other=keep me\n", encoding="utf-8")
        (tmp_path / "in" / mod / "q.snbt").write_text('{ title: "Stone quest", id: "1" }', encoding="utf-8")
    (tmp_path / "in" / "a" / "lang" / "de.json").write_text(json.dumps({"k": "Stone json", "l": "x"}), encoding="utf-8")
    (tmp_path / "in" / "a" / "other.bin").write_text("nothing", encoding="utf-8")
    known = spark.createDataFrame([("Stone quest", "Known quest")], "text string, answer string")
    out = tmp_path / "out"
    asked = []

    def apply(rows):
        asked.extend(r.text for r in rows.collect())
        return rows.where(F.col("text").contains("Stone")).select("file", "path", F.upper("text").alias("text"))

    written = hook.run(spark, str(tmp_path / "in"), str(out), apply, lambda c: F.length(c) > 1, known)
    assert written == ["a/lang/de.json", "a/lang/en_us.lang", "a/q.snbt", "b/lang/en_us.lang", "b/q.snbt"]
    assert "Stone quest" not in asked and "x" not in asked and "keep me" in asked
    assert (out / "b" / "lang" / "en_us.lang").read_text().split("\n")[:2] == ["item.name=STONE B", "item.other=keep me"]
    assert json.loads((out / "a" / "lang" / "de.json").read_text()) == {"k": "STONE JSON", "l": "x"}
    assert "Known quest" in (out / "a" / "q.snbt").read_text()


def test_reference_pairs(spark):
    s = spark.createDataFrame([("m/en.lang", "k", "Stone"), ("m/en.lang", "l", "Iron"), ("n/en.lang", "k", "Gold")], "file string, path string, text string")
    t = spark.createDataFrame([("m/de.lang", "k", "Stein")], "file string, path string, text string")
    assert {(r.file, r.path, r.source, r.target) for r in hook.reference_pairs(s, t).collect()} == {("m/en.lang", "k", "Stone", "Stein"), ("m/en.lang", "l", "Iron", None), ("n/en.lang", "k", "Gold", None)}
