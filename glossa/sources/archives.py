"""Archives as tables of members, and what is found in them."""

from __future__ import annotations

import io
import json
import re
import tomllib
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WHOLE = ("shaders", "contenttweaker")


def members(archives: DataFrame, stems: list[str] | None = None) -> DataFrame:
    """(archive, member, content binary) of zip archives (path, content).

    With stems only members whose name without extension is one of them (in any case); an archive that holds a folder of WHOLE is
    read in full. A file that is no archive has no members.
    """
    wanted = None if stems is None else {s.lower() for s in stems}

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        names = [n for n in z.namelist() if not n.endswith("/")]
                        all_ = wanted is None or any(x in WHOLE for n in names for x in n.lower().split("/")[:-1])
                        for n in names:
                            if all_ or n.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower() in wanted:
                                rows.append((path, n, z.read(n)))
                except (zipfile.BadZipFile, TypeError, RuntimeError, NotImplementedError):
                    continue
                yield pd.DataFrame(rows, columns=["archive", "member", "content"])

    return archives.select("path", "content").mapInPandas(run, "archive string, member string, content binary")


def _mod_id(name: str, content: bytes) -> str | None:
    text = content.decode("utf-8", "replace")
    try:
        if name == "fabric.mod.json":
            return json.loads(text, strict=False).get("id")
        if name.endswith("mods.toml"):
            return tomllib.loads(text)["mods"][0]["modId"]
        doc = json.loads(text, strict=False)
        return (doc if isinstance(doc, list) else doc["modList"])[0]["modid"]
    except (ValueError, KeyError, IndexError, TypeError, AttributeError):
        m = re.search(r'modI?i?d"?\s*[=:]\s*"([^"]+)"', text)
        return m[1] if m else None


def mod_ids(archives: DataFrame) -> DataFrame:
    """(archive, mod_id): from the first of fabric.mod.json, mods.toml, neoforge.mods.toml, mcmod.info and other .info files that names one."""
    rank = (
        F.when(F.col("member") == "fabric.mod.json", 0).when(F.col("member") == "META-INF/mods.toml", 1).when(F.col("member") == "META-INF/neoforge.mods.toml", 2)
        .when(F.col("member") == "mcmod.info", 3).when(F.col("member").endswith(".info"), 4)
    )

    @F.pandas_udf("string")
    def named(member: pd.Series, content: pd.Series) -> pd.Series:
        return pd.Series([_mod_id(m, c) for m, c in zip(member, content, strict=True)])

    found = members(archives).withColumn("rank", rank).where("rank is not null").withColumn("mod_id", named("member", "content")).where("mod_id is not null")
    return found.groupBy("archive").agg(F.min_by("mod_id", F.struct("rank", "member")).alias("mod_id"))


def translated_mods(archives: DataFrame) -> DataFrame:
    """(mod_id): second part of the paths below assets in resource packs."""
    parts = F.split("member", "/")
    return members(archives).where((F.element_at(parts, 1) == "assets") & (F.size(parts) > 2)).select(F.element_at(parts, 2).alias("mod_id")).distinct()


def missing_mods(mods: DataFrame, packs: DataFrame) -> DataFrame:
    """(mod_id, archive): mods that no pack translates; of several archives of one mod the last by name."""
    last = mod_ids(mods).groupBy("mod_id").agg(F.max("archive").alias("archive"))
    return last.join(translated_mods(packs), "mod_id", "left_anti")


def language_pack(files: list[tuple[str, str]], description: str, pack_format: int = 3) -> bytes:
    """A resource pack (zip) of a few files (path, content), with its pack.mcmeta; made on the driver from what fits there."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("pack.mcmeta", json.dumps({"pack": {"pack_format": pack_format, "description": description}}, ensure_ascii=False))
        for path, content in files:
            z.writestr(path, content)
    return out.getvalue()
