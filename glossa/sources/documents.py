"""Structured game documents: which texts they hold and where, and the documents with those texts replaced.

A format is a loader, a rule that gives (path, text) pairs, and a writer. Paths are lists of keys and positions, as JSON; the step
"{json}" enters a string that is itself JSON. Extraction maps over files; write-back joins a file with its texts.
"""

from __future__ import annotations

import json
import re
import shlex
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.decode import escaped, unescaped
from glossa.sources import snbt

Pairs = Iterator[tuple[list, str]]
INSIDE = "{json}"


def walk(doc, wanted: Callable[[list, object], bool]) -> Pairs:
    """Depth first: every (path, value) that is wanted; what is wanted isn't entered."""
    stack: list[tuple[list, object]] = [([], doc)]
    while stack:
        path, value = stack.pop()
        if path and wanted(path, value):
            yield path, value
            continue
        if isinstance(value, dict):
            stack += [(path + [k], v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            stack += [(path + [i], v) for i, v in reversed(list(enumerate(value)))]


def _field(path: list) -> str | None:
    """The last key, positions in its lists aside."""
    return next((x for x in reversed(path) if isinstance(x, str)), None)


def _named(fields: set[str]) -> Callable[[object], Pairs]:
    return lambda doc: ((p, v) for p, v in walk(doc, lambda p, v: isinstance(v, str) and p[-1] in fields))


def component(value, path: list) -> Pairs:
    """Texts of a text component: its text, its translate where that is prose, and those of all that it holds."""
    for p, v in walk(value, lambda p, v: isinstance(v, str)):
        if p[-1] == "text" or (p[-1] == "translate" and not ("." in v and re.fullmatch(r"[a-z0-9._-]+", v))) or isinstance(p[-1], int):
            yield path + p, v


def _inside(text: str):
    try:
        doc = json.loads(text)
    except ValueError:
        return None
    return doc if isinstance(doc, (dict, list)) else None


QUEST = set("Lore Name pages subtitle text title".split())
QUEST_JSON = set("description text".split())
QUEST_TEXTS = QUEST | QUEST_JSON
BOOK = set("description header landing_text link_text name subtitle text title tooltip".split())
QUEST_BOOK = set("description longDescription long_description main_description name".split())


def _quest(doc) -> Pairs:
    # A text stands under its field itself or in a list of it, but not deeper.
    for p, v in walk(doc, lambda p, v: isinstance(v, str) and _field(p[-2:]) in QUEST_TEXTS):
        inner = _inside(v) if _field(p) in QUEST_JSON else None
        if inner is None:
            yield p, v
        else:
            yield from component(inner, p + [INSIDE])


def _data_pack(doc) -> Pairs:
    for p, v in walk(doc, lambda p, v: isinstance(v, (str, dict)) and p[-1] in ("description", "name", "subtitle", "title")):
        yield p, v if isinstance(v, str) else str(v)


def _game(doc) -> Pairs:
    for p, v in walk(doc, lambda p, v: isinstance(v, str)):
        if p[-1] not in ("Item2", "Item3") and not (len(p) == 1 and p[0] in ("name", "description")):
            yield p, v


def _mod_translations(doc) -> Pairs:
    content = doc.get("content") if isinstance(doc, dict) else None
    for mod, x in (content or {}).items():
        for key, v in ((x or {}).get("translations") or {}).items():
            if isinstance(v, str):
                yield ["content", mod, "translations", key], v


def _menu(doc) -> Pairs:
    for el in doc:
        if el["name"] != "element":
            continue
        who = next((v for k, v in el["entries"] if k == "instance_identifier"), "unknown")
        for field in ("source", "label", "hoverlabel"):
            got = next((v for k, v in el["entries"] if k == field), None)
            if got is not None:
                yield [who, field], got


def load_menu(text: str) -> list[dict]:
    """Blocks ``name {`` ... ``}`` of ``key = value`` lines, in order, repeated keys kept."""
    blocks: list[dict] = [{"name": None, "entries": []}]
    open_ = blocks[0]
    for line in text.splitlines():
        x = line.strip()
        if x.endswith("{"):
            open_ = {"name": x[:-1].strip(), "entries": []}
            blocks.append(open_)
        elif x == "}":
            open_ = blocks[0]
        elif "=" in x:
            k, v = x.split("=", 1)
            open_["entries"].append((k.strip(), v.strip()))
        elif x:
            open_["entries"].append((x, None))
    return blocks


def dump_menu(blocks: list[dict]) -> str:
    out = []
    for b in blocks:
        pad = "" if b["name"] is None else "  "
        rows = [f"{pad}{k}" if v is None else f"{pad}{k} = {v}" for k, v in b["entries"]]
        out += rows if b["name"] is None else [b["name"] + " {", *rows, "}"]
    return "\n".join(out) + "\n"


_HEADER = re.compile(r"#{3}(?P<mod>[^|#]+)\|[^|#]+#{3}")
_SIGN = re.compile("[:=→]")


def mod_lines(lines: list[str]) -> Iterator[tuple[int, str, str, str]]:
    """(line, mod, key, value) of the text format: fenced blocks, the prompt section, comments and lines before the first module don't count."""
    mod, fenced, prompt = None, False, False
    for i, line in enumerate(lines):
        x = line.strip()
        if x.startswith("```"):
            fenced = not fenced
            continue
        section = x.startswith("###")
        if not x or fenced or (x.startswith("#") and not section):
            continue
        if prompt and not section:
            continue
        prompt = False
        if re.match(r"###\s*(FILE_NAME|TRANSLATION_STATUS)\s*###", x):
            continue
        if re.match(r"###\s*AI_PROMPT\s*###", x):
            prompt = True
            continue
        head = _HEADER.match(x)
        if head:
            mod = head["mod"].strip(" []\t")
            continue
        sign = _SIGN.search(line) if mod is not None else None
        if sign and line[: sign.start()].strip():
            yield i, mod, line[: sign.start()].strip(), line[sign.end() :].strip()


def _mod_text(lines: list[str]) -> Pairs:
    return (([mod, key], value) for _, mod, key, value in mod_lines(lines))


_QUOTED = r'"((?:\\.|[^\\"])*)"'
SCRIPT = {"displayName": re.compile(r"\.displayName\s*=\s*" + _QUOTED), "tooltip": re.compile(r"\.addTooltip\(" + _QUOTED + r"\)")}


def script_spans(lines: list[str]) -> Iterator[tuple[int, int, str, int, int, str]]:
    """(line from 1, ordinal, kind, start, end, text) of every string of a script that players see."""
    for n, line in enumerate(lines, 1):
        for kind, pattern in SCRIPT.items():
            for i, m in enumerate(pattern.finditer(line)):
                yield n, i, kind, m.start(1), m.end(1), unescaped(m[1])


def _script(lines: list[str]) -> Pairs:
    return (([str(n), str(i), kind], text) for n, i, kind, _, _, text in script_spans(lines))


#: Command to the slots that hold text: all that follows (plain), a component (json), or a path of a tag (nbt).
RULES: dict[str, list[tuple[str, str]]] = {
    "say": [("plain", "")],
    **{name: [("json", "")] for name in ("bossbar", "scoreboard", "team", "tellraw", "title")},
    "give": [("nbt", "display.Name")],
    **{name: [("nbt", "CustomName")] for name in ("data", "summon")},
}


def rules_of(lines: tuple[str, ...]) -> dict[str, list[tuple[str, str]]]:
    """Command to its slots, from lines like "say <tran:plain>"; comments and blank lines don't count."""
    out: dict[str, list[tuple[str, str]]] = {}
    for line in (x.strip() for x in lines):
        if line and not line.startswith("#"):
            for slot in re.findall(r"tran:(\w+)(?::([\w.]+))?", line):
                out.setdefault(line.split()[0], []).append(slot)
    return out


def command_texts(command: str, rules: dict[str, list[tuple[str, str]]]) -> list[str]:
    """The texts of one command's slots: all that follows (plain), a component's text (json) or a path of a tag (nbt)."""
    x = command.strip().removeprefix("/").lstrip()
    name, _, rest = x.partition(" ")
    slots = list(rules.get(name, ()))
    if any(kind == "plain" for kind, _ in slots):
        return [rest.strip()] if rest.strip() else []
    try:
        args = shlex.split(x)[1:]
    except ValueError:
        args = x.split()[1:]
    out = []
    for a in args if slots else ():
        doc = _inside(a)
        if isinstance(doc, dict) and isinstance(doc.get("text"), str) and ("json", "") in slots:
            slots.remove(("json", ""))
            out.append(doc["text"])
            continue
        if a.startswith("{") and a.endswith("}"):
            try:
                tag = snbt.loads(a)
            except snbt.SnbtError:
                continue
            for slot in [s for s in slots if s[0] == "nbt"]:
                got = tag
                for step in slot[1].split("."):
                    got = got.get(step) if isinstance(got, dict) else None
                if got is not None:
                    slots.remove(slot)
                    inner = _inside(got) if isinstance(got, str) else None
                    out.append(inner["text"] if isinstance(inner, dict) and isinstance(inner.get("text"), str) else str(got))
                    break
    return out


def _commands(lines: list[str]) -> Pairs:
    return (([f"line {n}"], t) for n, line in enumerate(lines, 1) for t in command_texts(line, RULES))


@dataclass(frozen=True)
class Format:
    load: Callable[[str], object]
    texts: Callable[[object], Pairs]
    dump: Callable[[object], str] | None = None


def _json_dump(doc) -> str:
    return json.dumps(doc, ensure_ascii=False, indent=4)


FORMATS: dict[str, Format] = {
    "quest_snbt": Format(snbt.loads, _quest, snbt.dumps),
    "quest_json": Format(json.loads, _named({"name:8", "desc:8"}), _json_dump),
    "quest_hqm_json": Format(json.loads, _named(QUEST_BOOK), _json_dump),
    "menu_json": Format(json.loads, _named({"text"}), _json_dump),
    "book": Format(json.loads, _named(BOOK), _json_dump),
    "data_pack": Format(json.loads, _data_pack, _json_dump),
    "game_json": Format(json.loads, _game, _json_dump),
    "mod_json": Format(json.loads, _mod_translations, _json_dump),
    "menu_blocks": Format(load_menu, _menu, dump_menu),
    "mod_text": Format(str.splitlines, _mod_text),
    "script": Format(str.splitlines, _script),
    "commands": Format(str.splitlines, _commands),
}


def spread(files: DataFrame) -> DataFrame:
    """files by name over all cores: a document costs much for its bytes, by which Parquet splits and adaptive execution would make few tasks."""
    return files.repartition(4 * files.sparkSession.sparkContext.defaultParallelism, "file")


def extracted(files: DataFrame, kind: str) -> DataFrame:
    """(file, pos, path, text, error): the texts of every file (file, content) in order; a file that can't be read gives one row with the reason."""
    f = FORMATS[kind]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for file, content in zip(part["file"], part["content"], strict=True):
                if content is None:
                    continue
                try:
                    got = list(f.texts(f.load(content)))
                except (ValueError, KeyError, AttributeError, TypeError) as e:
                    rows.append((file, None, None, None, f"{type(e).__name__}: {e}"))
                    continue
                rows += [(file, i, json.dumps(p, ensure_ascii=False), t, None) for i, (p, t) in enumerate(got)]
            out = pd.DataFrame(rows, columns=["file", "pos", "path", "text", "error"])
            out["pos"] = out["pos"].astype("Int64")
            yield out

    return spread(files.select("file", "content")).mapInPandas(run, "file string, pos long, path string, text string, error string")


def put(doc, path: list, text: str) -> None:
    """Set a text at its path; a path that no longer exists is left alone."""
    holder = doc
    for k, step in enumerate(path):
        last = k == len(path) - 1
        if not last and path[k + 1] == INSIDE:
            try:
                inner = json.loads(holder[step])
                put(inner, path[k + 2 :], text)
                holder[step] = json.dumps(inner, ensure_ascii=False)
            except (KeyError, IndexError, TypeError, ValueError):
                pass
            return
        try:
            if last:
                if isinstance(holder[step], (str, dict)):
                    holder[step] = text
                return
            holder = holder[step]
        except (KeyError, IndexError, TypeError):
            return


def spliced(line: str, spans: list[tuple[int, int, str]], ascii_only: bool = False) -> str:
    """line with spans (start, end, text) replaced from right to left, so that earlier places stay valid."""
    for a, b, t in sorted(spans, reverse=True):
        t = re.sub(r'(?<!\\)"', r"\"", t)
        line = line[:a] + (escaped(t) if ascii_only else t) + line[b:]
    return line


def replaced(content: str, kind: str, texts: dict[str, str], ascii_only: bool = False) -> str:
    """The document with the texts of the given paths (as JSON) replaced."""
    f = FORMATS[kind]
    doc = f.load(content)
    by = {json.dumps(p, ensure_ascii=False): p for p, _ in f.texts(doc)}
    todo = [(by[p], t) for p, t in texts.items() if p in by]
    if kind == "script":
        want = {tuple(p): t for p, t in todo}
        spans: dict[int, list] = {}
        for n, i, what, a, b, _ in script_spans(doc):
            if (str(n), str(i), what) in want:
                spans.setdefault(n, []).append((a, b, want[str(n), str(i), what]))
        return "\n".join(spliced(line, spans.get(n, []), ascii_only) for n, line in enumerate(doc, 1))
    if kind == "mod_text":
        want = {tuple(p): t for p, t in todo}
        lines = list(doc)
        for i, mod, key, _ in mod_lines(doc):
            if (mod, key) in want:
                lines[i] = f"{key} = {want[mod, key]}"
        return "\n".join(lines)
    if kind == "menu_blocks":
        want = {tuple(p): t for p, t in todo}
        for b in doc:
            who = next((v for k, v in b["entries"] if k == "instance_identifier"), "unknown")
            if b["name"] == "element":
                b["entries"] = [(k, want.get((who, k), v)) for k, v in b["entries"]]
        return f.dump(doc)
    if f.dump is None:
        raise ValueError(f"{kind} can't be written")
    for path, t in todo:
        put(doc, path, t)
    return f.dump(doc)


def rewritten(files: DataFrame, texts: DataFrame, kind: str, ascii_only: bool = False) -> DataFrame:
    """(file, content): files with texts (file, path, text) put back; of repeated paths the first by text wins. A file without texts stays as it is."""

    new = texts.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("path", "text"))).alias("_new"))
    both = files.select("file", "content").join(new, "file", "left").select("file", "content", F.transform("_new", lambda x: x["path"]).alias("paths"), F.transform("_new", lambda x: x["text"]).alias("texts"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for file, content, paths, new_texts in part.itertuples(index=False):
                if content is not None and paths is not None:
                    first: dict[str, str] = {}
                    for path, text in zip(paths, new_texts, strict=True):
                        first.setdefault(path, text)
                    content = replaced(content, kind, first, ascii_only)
                rows.append((file, content))
            yield pd.DataFrame(rows, columns=["file", "content"])

    return spread(both).mapInPandas(run, "file string, content string")


def user_strings(data: bytes) -> list[str]:
    """Distinct strings of a .NET user-string heap in order: a length of 1, 2 or 4 bytes, UTF-16 and a flag byte."""
    out: dict[str, None] = {}
    at = 1
    while at < len(data):
        b = data[at]
        size = 1 if b < 0x80 else 2 if b < 0xC0 else 4 if b < 0xE0 else 0
        if not size or at + size > len(data):
            break
        n = int.from_bytes(data[at : at + size]) & ((1 << (8 * size - (0, 1, 2, 0, 3)[size])) - 1)
        at += size
        if n > 1 and at + n - 1 <= len(data):
            text = data[at : at + n - 1].decode("utf-16-le", "replace")
            if "�" not in text and len(text.strip()) > 1:
                out[text] = None
        at += n
    return list(out)


def heap_strings(heaps: DataFrame) -> DataFrame:
    """(file, pos, text) of user-string heaps (file, data)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(f, i, t) for f, d in zip(part["file"], part["data"], strict=True) if d is not None for i, t in enumerate(user_strings(bytes(d)))], columns=["file", "pos", "text"])

    return heaps.select("file", F.col("data").cast("binary").alias("data")).mapInPandas(run, "file string, pos long, text string")


def detected(name: str, content: str) -> str | None:
    """The format of a document by its name and the beginning of its content; None where nothing fits."""
    ext = name.lower().rsplit(".", 1)[-1] if "." in name else ""
    if ext == "json":
        doc = _inside(content)
        if isinstance(doc, dict) and "header" in doc and "content" in doc:
            return "mod_json"
        if isinstance(doc, dict) and "name" in doc:
            return "game_json"
        return "language"
    if ext == "txt":
        head = content[:200]
        return "mod_text" if "###" in head else "menu_blocks" if "{" in head else None
    return {"snbt": "quest_snbt", "zs": "script", "mcfunction": "commands", "mcmeta": "data_pack", "lang": "language", "local": "language"}.get(ext)
