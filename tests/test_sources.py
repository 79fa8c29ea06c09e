from __future__ import annotations

import io
import json
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossa.functions.decode import decode_any, escaped, unescaped
from glossa.sources import archives, datasets, documents, keyvalue, snbt

FILES = "file string, content string"


def files(spark, *contents):
    return spark.createDataFrame([(f"f{i}", c) for i, c in enumerate(contents)], FILES)


def pairs(df):
    return [(r.key, r.value) for r in df.orderBy("file", "pos").collect()]


def test_lang(spark):
    assert pairs(keyvalue.lang(files(spark, "# note\nitem.a=Iron=Bar\r\n\n// x\nnovalue\n k =v ", None, ""))) == [("item.a", "Iron=Bar"), (" k ", "v ")]


def test_local_and_json(spark):
    assert pairs(keyvalue.local(files(spark, "a.b  =  Start\n\nx"))) == [("a.b", "Start")]
    assert pairs(keyvalue.language_json(files(spark, '{"a":"x","b":["y"]}', "no json", "[1]", None))) == [("a", "x"), ("b", "['y']")]


def test_forge_blocks(spark):
    got = keyvalue.forge_blocks(files(spark, 'languagefile {\n    S:"k"=v\n    B:f=true\n}')).orderBy("pos").collect()
    assert [(r.block, r.kind, r.key, r.value) for r in got] == [("languagefile", "S", "k", "v"), ("languagefile", "B", "f", "true")]


def test_review_round_trip(spark):
    line = spark.range(1).select(keyvalue.review_line(F.lit("k"), F.lit('s"1'), F.lit("t")).alias("content"), F.lit("f").alias("file"))
    got = keyvalue.review(line.unionByName(spark.createDataFrame([("{'a': ['b', 'c']}\nbroken {", "g")], "content string, file string"))).collect()
    assert sorted((r.key, r.source, r.target) for r in got) == [("a", "b", "c"), ("k", 's"1', "t")]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("f.lang", 1, "b", "two\nlines  here"), ("f.lang", 0, "a", "x"), ("f.lang", 2, "a", '["y"]')], "file string, pos int, key string, value string")
    lines = keyvalue.joined_lines(rows, keyvalue.lang_line(F.col("key"), F.col("value")))
    assert lines.collect()[0].content == 'a=x\nb=two\\nlines here\na=["y"]'
    assert json.loads(keyvalue.json_contents(rows).collect()[0].content) == {"b": "two\nlines  here", "a": ["y"]}
    keyvalue.write_texts(lines, str(tmp_path / "out"))
    assert pairs(keyvalue.lang(keyvalue.texts(spark, str(tmp_path / "out"), "*.lang")))[0] == ("a", "x")


def test_files_of_one_name_keep_their_folders(spark, tmp_path):
    """Two mods with a file of the same name are read, written below another folder, and read again."""
    for mod in ("a", "b"):
        (tmp_path / "in" / mod / "lang").mkdir(parents=True)
        (tmp_path / "in" / mod / "lang" / "en_us.lang").write_text(f"name={mod} 100%\n", encoding="utf-8")
    out = str(tmp_path / "out")

    def read(path):
        return keyvalue.lang(spark.read.text(f"{path}/*/lang/*.lang", wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content")))

    lines = keyvalue.joined_lines(read(tmp_path / "in"), keyvalue.lang_line(F.col("key"), F.col("value")))
    assert keyvalue.write_texts(lines, out) == ["a/lang/en_us.lang", "b/lang/en_us.lang"]
    assert keyvalue.write_texts(lines, out, str(tmp_path)) == ["in/a/lang/en_us.lang", "in/b/lang/en_us.lang"]
    assert sorted(r.value for r in read(out).collect()) == ["a 100%", "b 100%"]
    assert not [x for x in (tmp_path / "out").iterdir() if x.name.startswith("_writing")]
    with pytest.raises(ValueError):
        keyvalue.write_texts(spark.createDataFrame([("../x", "y")], "file string, content string"), out)


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "gb18030", "utf-16"])
def test_decode(encoding):
    assert decode_any("铁锭 plain".encode(encoding)) == "铁锭 plain"
    assert decode_any(None) is None


@given(st.text())
def test_escapes_round_trip(text):
    if "\\u" not in text:
        assert unescaped(escaped(text)) == text


values = st.recursive(st.booleans() | st.integers(-(10**9), 10**9) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(min_size=1), x, max_size=4), max_leaves=12)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.text(min_size=1), values, max_size=4), st.booleans())
def test_snbt_round_trip(doc, commas):
    assert snbt.loads(snbt.dumps(doc, commas=commas)) == doc


def test_snbt_reads():
    got = snbt.loads("{ a: [I; 1, 2], 'b c': 3b # note\n d: 1.5, e: {f: 'it\\'s'} g: [] h: word }")
    assert got["a"] == [1, 2] and got["a"].kind == "I" and str(got["b c"]) == "3b" and got["d"] == 1.5 and got["e"] == {"f": "it's"} and got["g"] == [] and str(got["h"]) == "word"
    assert "[I; 1, 2]".replace(" ", "") in snbt.dumps(got).replace(" ", "")
    for bad in ("{", "{a:}", "{a 1}", "[1", '"x', "1 2", ""):
        with pytest.raises(snbt.SnbtError):
            snbt.loads(bad)
    assert snbt.loads("[" * 20000 + "]" * 20000)


CASES = [
    ("quest_snbt", '{ id: "1", title: "Go", tasks: [{ n: 3b, description: ["{\\"text\\":\\"Hi\\"}"] }], a: [I; 1, 2] }', [(["title"], "Go"), (["tasks", 0, "description", 0, "{json}", "text"], "Hi")]),
    ("quest_json", '{"q:9":{"0:10":{"name:8":"A","desc:8":"B"}}}', [(["q:9", "0:10", "name:8"], "A"), (["q:9", "0:10", "desc:8"], "B")]),
    ("quest_hqm_json", '{"name":"S","quests":[{"description":"d","longDescription":"L"}]}', [(["name"], "S"), (["quests", 0, "description"], "d"), (["quests", 0, "longDescription"], "L")]),
    ("menu_json", '{"buttons":{"b":{"text":"Play"}}}', [(["buttons", "b", "text"], "Play")]),
    ("book", '{"name":"N","pages":[{"text":"T","type":"x"}]}', [(["name"], "N"), (["pages", 0, "text"], "T")]),
    ("data_pack", '{"display":{"title":{"text":"T"}}}', [(["display", "title"], "{'text': 'T'}")]),
    ("mod_json", '{"header":{},"content":{"m":{"translations":{"k":"v"}}}}', [(["content", "m", "translations", "k"], "v")]),
    ("game_json", '{"name":"x","ui":{"a":"A","b":[{"Item1":"B","Item2":"skip"}]}}', [(["ui", "a"], "A"), (["ui", "b", 0, "Item1"], "B")]),
    ("menu_blocks", "element {\n instance_identifier = e1\n label = Go\n}", [(["e1", "label"], "Go")]),
    ("mod_text", "### [m] | [en_us] ###\nk = v\n# no = no", [(["m", "k"], "v")]),
    ("script", '<a:b>.displayName = "X\\u0041"; <a:b>.addTooltip("A");', [(["1", "0", "displayName"], "XA"), (["1", "0", "tooltip"], "A")]),
    ("commands", "say hello world\ntellraw @a '{\"text\":\"Hi\"}'\n/summon pig ~ ~ ~ '{CustomName:\"{\\\"text\\\":\\\"P\\\"}\"}'", [(["line 1"], "hello world"), (["line 2"], "Hi"), (["line 3"], "P")]),
]


@pytest.mark.parametrize(("kind", "content", "want"), CASES, ids=[c[0] for c in CASES])
def test_texts_and_write_back(kind, content, want):
    f = documents.FORMATS[kind]
    assert list(f.texts(f.load(content))) == want
    if f.dump or kind in ("script", "mod_text"):
        new = {json.dumps(p, ensure_ascii=False): f"new {i} é" for i, (p, _) in enumerate(want)}
        again = documents.replaced(content, kind, new)
        if kind != "data_pack":
            assert list(f.texts(f.load(again))) == [(p, f"new {i} é") for i, (p, _) in enumerate(want)]
        assert documents.replaced(content, kind, {'["nowhere"]': "x"}).count("x") <= content.count("x")


def test_extraction_bears_broken_files(spark):
    got = documents.extracted(files(spark, "{", None, "", '{"text": "t"}', "[]"), "menu_json").collect()
    assert [(r.file, r.text) for r in got if r.error is None] == [("f3", "t")] and {r.file for r in got if r.error} == {"f0", "f2"}
    kept = documents.rewritten(files(spark, None, '{"text": "t"}'), spark.createDataFrame([("f1", '["text"]', "b"), ("f1", '["text"]', "a")], "file string, path string, text string"), "menu_json").collect()
    assert {r.file: r.content and json.loads(r.content) for r in kept} == {"f0": None, "f1": {"text": "a"}}


def test_user_strings(spark):
    def item(s):
        b = s.encode("utf-16-le") + b"\0"
        n = len(b)
        return (bytes([n]) if n < 128 else bytes([0x80 | n >> 8, n & 255])) + b

    heap = b"\0" + item("Hello") + b"\0" + item("x" * 100) + item("Hello") + item("y")
    assert documents.user_strings(heap) == ["Hello", "x" * 100]
    assert documents.user_strings(b"") == [] and documents.user_strings(b"\0\x7f") == []
    assert documents.heap_strings(spark.createDataFrame([("a", bytearray(heap)), ("b", None)], "file string, data binary")).count() == 2


def _zip(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in entries.items():
            z.writestr(k, v)
    return bytearray(out.getvalue())


def test_archives(spark):
    jars = spark.createDataFrame(
        [("a.jar", _zip({"fabric.mod.json": '{"id":"m"}', "mcmod.info": '[{"modid":"other"}]'})), ("b.jar", _zip({"META-INF/mods.toml": '[[mods]]\nmodId="n"\n'})), ("c.jar", bytearray(b"no zip")), ("d.jar", _zip({"mcmod.info": '[{"modid":"o"}]'})), ("e.jar", None)],
        "path string, content binary",
    )
    packs = spark.createDataFrame([("p.zip", _zip({"assets/n/lang/en_US.lang": "a=b", "pack.mcmeta": "{}"}))], "path string, content binary")
    assert sorted(map(tuple, archives.mod_ids(jars).collect())) == [("a.jar", "m"), ("b.jar", "n"), ("d.jar", "o")]
    assert [r.mod_id for r in archives.translated_mods(packs).collect()] == ["n"]
    assert sorted(r.mod_id for r in archives.missing_mods(jars, packs).collect()) == ["m", "o"]
    assert [r.member for r in archives.members(packs, ["en_us"]).collect()] == ["assets/n/lang/en_US.lang"]
    assert zipfile.ZipFile(io.BytesIO(archives.language_pack([("assets/x/lang/a.lang", "k=v")], "d"))).namelist() == ["pack.mcmeta", "assets/x/lang/a.lang"]


def test_dictionaries(spark):
    d = datasets.read_dictionary(spark.createDataFrame([('{"Iron":["a","b"],"Bar":["c"]}',)], "content string"))
    assert sorted(map(tuple, d.collect())) == [("Bar", 0, "c"), ("Iron", 0, "a"), ("Iron", 1, "b")]


@pytest.mark.parametrize(("name", "content", "want"), [("a.json", '{"header":1,"content":2}', "mod_json"), ("a.json", '{"name":1}', "game_json"), ("a.json", "{}", "language"), ("b.txt", "### x ###", "mod_text"), ("b.txt", "element {", "menu_blocks"), ("q.SNBT", "", "quest_snbt"), ("s.zs", "", "script"), ("x.png", "", None), ("none", "", None)])
def test_detection(name, content, want):
    assert documents.detected(name, content) == want


def test_documents_are_spread_over_the_cores(spark):
    """However few tasks their bytes would make: documents in one partition, and those that a small join gives."""
    files = spark.range(200).select(F.concat(F.lit("f"), "id").alias("file"), F.format_string('{ title: "t%d" }', "id").alias("content")).coalesce(1)
    got = documents.extracted(files, "quest_snbt")
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() >= 8
    assert {(r.file, r.text) for r in got.collect()} == {(f"f{i}", f"t{i}") for i in range(200)}
    new = documents.rewritten(files, got.select("file", "path", F.upper("text").alias("text")), "quest_snbt")
    assert new.select(F.spark_partition_id().alias("p")).distinct().count() >= 8
    assert {r.content.split()[2] for r in new.collect()} == {f'"T{i}"' for i in range(200)}


@settings(max_examples=300, deadline=None)
@given(st.text("ab\\\"'nu0f1\t{", max_size=20), st.sampled_from("\"'"))
def test_strings_by_runs_equal_those_by_characters(body, q):
    def slow(s):
        out, i = [], 1
        while i < len(s):
            if s[i] == q:
                return "".join(out), i + 1
            if s[i] == "\\" and i + 1 < len(s):
                code = s[i + 2 : i + 6]
                if s[i + 1] == "u" and len(code) == 4 and all(c in "0123456789abcdefABCDEF" for c in code):
                    out.append(chr(int(code, 16)))
                    i += 6
                else:
                    out.append({"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}.get(s[i + 1], s[i + 1]))
                    i += 2
                continue
            out.append(s[i])
            i += 1
        return None

    text = q + body + q
    try:
        assert snbt._string(text, 0) == slow(text)
    except snbt.SnbtError:
        assert slow(text) is None
