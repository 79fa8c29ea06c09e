"""Queries over the embeddings table and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import codecs, knn, store, transforms
from glossa.streaming.runner import shared

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def _add(name: str, fn: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: fn(_e(spark, sf_dir))
    if sql:
        ORACLES[name] = sql


_V = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"
_COS = "round(list_cosine_similarity(a.x, b.x), 6)"


def _topk(score: str, k: int = 10, direction: str = "DESC", left: str = "v", right: str = "v", where: str = "a.vec_id != b.vec_id") -> str:
    return f"SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {score} {direction}, b.vec_id) AS rank, b.vec_id, {score} AS score FROM {left} a, {right} b WHERE {where} QUALIFY rank <= {k}"


_add("knn_ip_top10", lambda e: knn.knn(e, e, 10, "ip"), f"WITH {_V} {_topk('round(list_inner_product(a.x, b.x), 6)')}")
_add("knn_l2_top10", lambda e: knn.knn(e, e, 10, "l2"), f"WITH {_V} {_topk('round(list_distance(a.x, b.x), 6)', direction='ASC')}")


def _knn_labels(e: DataFrame) -> DataFrame:
    return knn.knn(e, e, 10, "cosine").join(e.select("vec_id", F.col("label").cast("long").alias("label")), "vec_id").select("query_id", "rank", "vec_id", "score", "label")


_add("knn_cosine_top10", _knn_labels, f"WITH {_V}, t AS ({_topk(_COS)}) SELECT t.*, v.label::BIGINT AS label FROM t JOIN v USING (vec_id)")
_add(
    "knn_label_vote",
    lambda e: knn.label_vote(knn.knn(e, e, 10, "cosine"), e),
    f"WITH {_V}, t AS ({_topk(_COS)}), c AS (SELECT query_id, label::BIGINT AS predicted, count(*) AS votes FROM t JOIN v USING (vec_id) GROUP BY ALL) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, predicted) = 1",
)


def _two_stage(coarse: str, ctes: str = "", wide: int = 100) -> str:
    return f"WITH {_V}{ctes}, c AS ({_topk('round(list_cosine_similarity(a.z, b.z), 6)', wide, left=coarse, right=coarse)}) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank, vec_id, s AS score FROM (SELECT c.query_id, c.vec_id, {_COS} AS s FROM c JOIN v a ON a.vec_id = c.query_id JOIN v b ON b.vec_id = c.vec_id) QUALIFY rank <= 10"


_add("refine_lowdim_top10", lambda e: knn.refine(e, e, 10, 10, F.slice("embedding", 1, 16)), _two_stage("(SELECT vec_id, x[1:16] AS z FROM v)"))

def _bits(code: str, width: int) -> str:
    return f"lpad(bin(({code})::BIGINT & {2**width - 1}), {width}, '0')"


def _hex(bits: str) -> str:
    """Hexadecimal digits of a string of bits."""
    bit = lambda k: f"(ascii(substr({bits}, 4 * i + {k + 1}, 1)) - 48)"
    return f"array_to_string(list_transform(range(0, length({bits}) // 4), lambda i: substr('0123456789abcdef', (1 + 8 * {bit(0)} + 4 * {bit(1)} + 2 * {bit(2)} + {bit(3)})::INT, 1)), '')"


def _int(bits: str) -> str:
    """The number that a string of bits stands for."""
    return f"list_sum(list_transform(range(0, length({bits})), lambda i: (ascii(substr({bits}, (i + 1)::INT, 1)) - 48) * (1::BIGINT << (length({bits}) - 1 - i)::INT)))"


def _low_first(code: str) -> str:
    """Sixteen bits as hexadecimal digits, the lower byte first."""
    return f"printf('%02x%02x', ({code})::BIGINT & 255, (({code})::BIGINT >> 8) & 255)"


def _data(levels: int, table: str = "k") -> str:
    """SELECT of (vec_id, data): the packed codes of a table (vec_id, dim, code) in hexadecimal digits."""
    if levels == 2:
        return f"SELECT vec_id, string_agg(printf('%02x', v), '' ORDER BY g) AS data FROM (SELECT vec_id, dim // 5 AS g, sum(code * pow(3, 4 - dim % 5))::BIGINT AS v FROM {table} GROUP BY ALL) GROUP BY vec_id"
    width = levels.bit_length()
    order = "dim // 4, -(dim % 4)" if width == 2 else "dim"
    return f"SELECT vec_id, {_hex('b')} AS data FROM (SELECT vec_id, string_agg({_bits('code', width)}, '' ORDER BY {order}) AS b FROM {table} GROUP BY vec_id)"


_FLAT = "f AS (SELECT vec_id, unnest(x) AS x, generate_subscripts(x, 1) - 1 AS dim FROM v)"


def _gsq_cte(bits: int, block: int = 128) -> str:
    top = 2**bits - 1
    return f"""{_FLAT}, g AS (SELECT vec_id // {block} AS blk, dim, CASE WHEN count(*) < {block} THEN least(min(x), 0) ELSE min(x) END AS lo, CASE WHEN count(*) < {block} THEN greatest(max(x), 0) ELSE max(x) END AS hi FROM f GROUP BY ALL),
h AS (SELECT blk, dim, lo, greatest(hi - lo, 1e-8) AS span FROM g), m AS (SELECT greatest(max(abs(lo)), 1e-8) AS tm, greatest(max(span), 1e-8) AS ts FROM h),
k AS (SELECT vec_id, f.dim AS dim, round_even((x - lo) / span * {top}, 0)::INT AS code, round_even(least(greatest(lo / tm, -1), 1 - pow(2.0, -15)) * 32768, 0) / 32768 * tm AS qlo, round_even(least(greatest(span / ts, -1), 1 - pow(2.0, -15)) * 32768, 0) / 32768 * ts AS qspan FROM f JOIN h ON h.blk = f.vec_id // {block} AND h.dim = f.dim, m)"""


_GSQ_DEC = "d AS (SELECT vec_id, list(code / {top}.0 * qspan + qlo ORDER BY dim) AS z FROM k GROUP BY vec_id)"
for _b in (2, 3, 4, 5, 6, 8):
    _add(
        f"codec_gsq{_b}",
        lambda e, b=_b: codecs.gsq(e, "vec_id", "embedding", b).select("vec_id", F.lower(F.hex("data")).alias("data"), F.round(F.aggregate("decoded", F.lit(0.0), lambda s, x: s + x * x), 6).alias("energy")),
        f"WITH {_V}, {_gsq_cte(_b)}, y AS ({_data(2**_b - 1)}) SELECT vec_id, data, energy FROM y JOIN (SELECT vec_id, round(sum(pow(code / {2**_b - 1}.0 * qspan + qlo, 2) ORDER BY dim), 6) AS energy FROM k GROUP BY vec_id) USING (vec_id)",
    )
_add(
    "refine_quantised_top10",
    lambda e: (lambda d: knn.refine(d, d, 10, 5, F.col("decoded")))(e.select("vec_id", "embedding").join(codecs.gsq(e, "vec_id", "embedding", 4).select("vec_id", "decoded"), "vec_id")),
    _two_stage("d", f", {_gsq_cte(4)}, {_GSQ_DEC.format(top=15)}", 50),
)
_add(
    "gsq_scan_top10",
    lambda e: knn.gsq_scan(e, codecs.gsq(e, "vec_id", "embedding", 6), 10),
    f"WITH {_V}, {_gsq_cte(6)}, {_GSQ_DEC.format(top=63)} {_topk('round(list_cosine_similarity(a.x, b.z), 6)', right='d')}",
)
_add(
    "ivf_probe_top10",
    lambda e: knn.ivf(e, e, knn.centroids(e, "label"), "label", 10, 3),
    f"""WITH {_V}, {_FLAT}, m AS (SELECT label, dim, avg(f.x) AS c FROM f JOIN v USING (vec_id) GROUP BY ALL), cell AS (SELECT label, list(c ORDER BY dim) AS c FROM m GROUP BY label),
p AS (SELECT a.vec_id AS query_id, cell.label AS label FROM v a, cell QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.x, cell.c), 6) DESC, cell.label) <= 3)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank, vec_id, s AS score FROM (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS s FROM p JOIN v a ON a.vec_id = p.query_id JOIN v b ON b.label = p.label WHERE a.vec_id != b.vec_id) QUALIFY rank <= 10""",
)


def _recall(e: DataFrame) -> DataFrame:
    ks = (2, 3, 5, 10, 50, 100)
    truth = knn.knn(e, e, max(ks), "cosine", keep_self=True).persist(StorageLevel.DISK_ONLY)  # each codec is compared with it
    parts = []
    for bits in (2, 4, 6, 8):
        d = codecs.gsq(e, "vec_id", "embedding", bits).select("vec_id", F.col("decoded").alias("embedding"))
        parts.append(knn.recall(truth, knn.knn(e, d, max(ks), "cosine", keep_self=True), ks).select(F.lit(f"gsq{bits}").alias("codec"), "k", "recall"))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _recall_sql() -> str:
    parts = []
    for b in (2, 4, 6, 8):
        parts.append(
            f"SELECT * FROM (WITH {_V}, {_gsq_cte(b)}, {_GSQ_DEC.format(top=2**b - 1)}, t AS ({_topk(_COS, 100, where='true')}), u AS ({_topk('round(list_cosine_similarity(a.x, b.z), 6)', 100, right='d', where='true')}) SELECT 'gsq{b}' AS codec, ks.k::BIGINT AS k, round((SELECT count(*) FROM t JOIN u USING (query_id, vec_id) WHERE t.rank <= ks.k AND u.rank <= ks.k) / (ks.k * (SELECT count(*) FROM v)), 6) AS recall FROM (VALUES (2), (3), (5), (10), (50), (100)) ks(k))"
        )
    return " UNION ALL ".join(parts)


_add("recall_at_k", _recall, _recall_sql())


def _block_ctes(levels: int, block: int, clip: float = codecs.CLIP, centred: bool = False) -> tuple[str, str]:
    """Common table expressions with k (codes and statistics by dimension) and z (vec_id, data, meta), and the decoded value."""
    base = f"{_FLAT}" if not centred else f"{_FLAT.replace('f AS', 'f0 AS')}, mu AS (SELECT dim, avg(x) AS mu FROM f0 GROUP BY dim), f AS (SELECT vec_id, x - mu AS x, dim, mu FROM f0 JOIN mu USING (dim))"
    stored = lambda x, top: f"round_even(least(greatest({x} / {top}, -1), 1 - pow(2.0, -15)) * 32768, 0)"
    return f"""WITH {_V}, {base}, p AS (SELECT vec_id, dim // {block} AS blk, quantile_cont(x, {1 - clip}) AS a, quantile_cont(x, {clip}) AS b FROM f GROUP BY ALL),
c AS (SELECT f.*, least(greatest(x, a), b) AS y, blk FROM f JOIN p ON p.vec_id = f.vec_id AND p.blk = f.dim // {block}),
s AS (SELECT vec_id, blk, min(y) AS lo, greatest(max(y) - min(y), 1e-8) AS span FROM c GROUP BY ALL), m AS (SELECT greatest(max(abs(lo)), 1e-8) AS tm, greatest(max(span), 1e-8) AS ts FROM s),
k AS (SELECT c.*, round_even((y - lo) / span * {levels}, 0)::INT AS code, {stored('lo', 'tm')} / 32768 * tm AS ql, {stored('span', 'ts')} / 32768 * ts AS qs FROM c JOIN s USING (vec_id, blk), m),
t AS (SELECT vec_id, string_agg({_low_first(stored('lo', 'tm'))}, '' ORDER BY blk) || string_agg({_low_first(stored('span', 'ts'))}, '' ORDER BY blk) AS meta FROM s, m GROUP BY vec_id),
z AS (SELECT vec_id, data, meta FROM ({_data(levels)}) JOIN t USING (vec_id))""", f"(code / {levels}.0 * qs + ql)"


def _block_sql(levels: int, block: int, clip: float = codecs.CLIP, centred: bool = False) -> str:
    ctes, back = _block_ctes(levels, block, clip, centred)
    return f"{ctes} SELECT vec_id, data, meta, rmse FROM z JOIN (SELECT vec_id, round(sqrt(avg(pow({back} - x, 2) ORDER BY dim)), 6) AS rmse FROM k GROUP BY vec_id) USING (vec_id)"


def _coded(df: DataFrame) -> DataFrame:
    """The stored bytes in hexadecimal digits, and the error of what they decode to."""
    return df.select("vec_id", *(F.lower(F.hex(c)).alias(c) for c in ("data", "meta") if c in df.columns), F.round("rmse", 6).alias("rmse"))


def _scalar(width: int, code: str = "code") -> str:
    """(vec_id, data) of k (vec_id, dim, code): whole bytes low byte first, others packed."""
    if width == 16:
        return f"SELECT vec_id, string_agg({_low_first(code)}, '' ORDER BY dim) AS data FROM k GROUP BY vec_id"
    return _data(2**width - 1)


for _b in (2, 3, 4, 5, 6, 8):
    _add(f"codec_q{_b}k", lambda e, b=_b: _coded(codecs.apply_blocks(e, "vec_id", "embedding", codecs.fit_blocks(e, "vec_id", "embedding", 2**b - 1, 32))), _block_sql(2**_b - 1, 32))
for _n, _l in [(f"q{b}k_m", 2**b - 1) for b in (1, 2, 3, 4, 5, 6, 8)] + [("tq1k_m", 2)]:
    _add(f"codec_{_n}", lambda e, lv=_l: _coded(codecs.apply_blocks(e, "vec_id", "embedding", codecs.fit_blocks(e, "vec_id", "embedding", lv, 32, centred=True))), _block_sql(_l, 32, centred=True))

for _b in (7, 11, 15):
    _add(
        f"codec_e0m{_b}",
        lambda e, b=_b: _coded(codecs.scalar_codec(e, "vec_id", "embedding", f"e0m{b}")),
        f"WITH {_V}, {_FLAT}, k AS (SELECT vec_id, dim, x, round_even(greatest(least(x, 1 - pow(2.0, -{_b})), -1) * {2**_b}, 0)::BIGINT AS code FROM f) SELECT vec_id, data, rmse FROM ({_scalar(_b + 1)}) JOIN (SELECT vec_id, round(sqrt(avg(pow(code / {2**_b}.0 - x, 2) ORDER BY dim)), 6) AS rmse FROM k GROUP BY vec_id) USING (vec_id)",
    )
for _b in (8, 12, 16):
    _add(
        f"codec_max{_b}",
        lambda e, b=_b: _coded(codecs.scalar_codec(e, "vec_id", "embedding", f"max{b}")),
        f"WITH {_V}, {_FLAT}, m AS (SELECT greatest(max(abs(x)), 1e-8) / {2 ** (_b - 1) - 1} AS s FROM f), k AS (SELECT vec_id, dim, x, s, round_even(x / s, 0)::BIGINT AS code FROM f, m) SELECT vec_id, data, rmse FROM ({_scalar(_b)}) JOIN (SELECT vec_id, round(sqrt(avg(pow(code * s - x, 2) ORDER BY dim)), 6) AS rmse FROM k GROUP BY vec_id) USING (vec_id)",
    )
_FLOAT = f"WITH {_V}, {_FLAT}, w AS (SELECT vec_id, dim, x, x::FLOAT::BIT::VARCHAR AS b FROM f)"
_PARTS = f"u AS (SELECT *, {_int('substr(b, 1, 1)')} AS sg, {_int('substr(b, 2, 8)')} AS ex, {_int('substr(b, 10, 7)')} AS m7, {_int('substr(b, 10, 3)')} AS m3 FROM w)"
_FLOATS = {
    "bf16": f"{_FLOAT}, {_PARTS}, k AS (SELECT vec_id, dim, x, CASE WHEN x = 0 THEN 0 ELSE sg * 32768 + ex * 128 + m7 END AS code, CASE WHEN x = 0 THEN 0 ELSE (1 - 2 * sg) * pow(2.0, ex - 127) * (1 + m7 / 128.0) END AS back FROM u) SELECT vec_id, data, rmse FROM ({_scalar(16)}) JOIN (SELECT vec_id, round(sqrt(avg(pow(back - x, 2) ORDER BY dim)), 6) AS rmse FROM k GROUP BY vec_id) USING (vec_id)",
    "e4m3": f"{_FLOAT}, {_PARTS}, k AS (SELECT *, CASE WHEN code = 0 THEN 0 ELSE (1 - 2 * (code // 128)) * pow(2.0, (code // 8) % 16 - 7) * (1 + (code % 8) / 8.0) END AS back FROM (SELECT vec_id, dim, x, CASE WHEN x = 0 THEN 0 ELSE sg * 128 + (least(greatest(ex, 120), 135) - 120) * 8 + m3 END AS code FROM u)) SELECT vec_id, data, rmse FROM ({_scalar(8)}) JOIN (SELECT vec_id, round(sqrt(avg(pow(back - x, 2) ORDER BY dim)), 6) AS rmse FROM k GROUP BY vec_id) USING (vec_id)",
    "f32": f"{_FLOAT} SELECT vec_id, string_agg({_hex('substr(b, 25, 8)')} || {_hex('substr(b, 17, 8)')} || {_hex('substr(b, 9, 8)')} || {_hex('substr(b, 1, 8)')}, '' ORDER BY dim) AS data, 0.0::DOUBLE AS rmse FROM w GROUP BY vec_id",
}
for _n in ("bf16", "e4m3", "f16", "f32"):
    _add(f"codec_{_n}", lambda e, n=_n: _coded(codecs.scalar_codec(e, "vec_id", "embedding", n)), _FLOATS.get(_n))
_add(
    "codec_q2nf",
    lambda e: _coded(codecs.nf_codec(e, "vec_id", "embedding")),
    f"""WITH {_V}, {_FLAT}, p AS (SELECT vec_id, dim // 32 AS blk, quantile_cont(x, {1 - codecs.CLIP}) AS a, quantile_cont(x, {codecs.CLIP}) AS b FROM f GROUP BY ALL),
c AS (SELECT f.*, least(greatest(x, a), b) AS y, blk FROM f JOIN p ON p.vec_id = f.vec_id AND p.blk = f.dim // 32), s AS (SELECT vec_id, blk, greatest(stddev_pop(y), 1e-8) AS sd FROM c GROUP BY ALL),
k AS (SELECT c.*, sd, CASE WHEN y / sd < -0.9816 THEN 0 WHEN y / sd < 0 THEN 1 WHEN y / sd < 0.9816 THEN 2 ELSE 3 END AS code FROM c JOIN s USING (vec_id, blk))
SELECT vec_id, data, rmse FROM ({_data(3)}) JOIN (SELECT vec_id, round(sqrt(avg(pow([-1.5121, -0.4528, 0.4528, 1.5121][code + 1] * sd - x, 2) ORDER BY dim)), 6) AS rmse FROM k GROUP BY vec_id) USING (vec_id)""",
)
_add("codec_rowtopk_mix", lambda e: _coded(codecs.row_top_mix(e, "vec_id", "embedding")))
_add("codec_energy_mix", lambda e: _coded(codecs.energy_mix(e, "vec_id", "embedding")))
_add("codec_pq", lambda e: _coded(codecs.pq(e, "vec_id", "embedding")))
_add("codec_opq", lambda e: _coded(codecs.pq(e, "vec_id", "embedding", rotated=True)))
for _n, _k in (("1", 2), ("tq1", 3), ("2", 4), ("3", 8), ("4", 16), ("5", 32), ("6", 64)):
    _add(f"codec_svdlm_{_n}", lambda e, k=_k: _coded(codecs.svd_lm(e, "vec_id", "embedding", k)))
for _n, _k in (("1", 2), ("tq1", 3), ("2", 4), ("3", 8), ("4", 16)):
    _add(f"codec_polar_{_n}", lambda e, k=_k: _coded(codecs.polar_codec(e, "vec_id", "embedding", k)))
for _b in (1, 2, 3, 4, 5, 6, 8, 12, 0):
    _n, _l = ("ternary", 2) if _b == 0 else (str(_b), 2**_b - 1)
    _add(
        f"pack_roundtrip_{_n}",
        lambda e, b=_b: codecs.packed_roundtrip(e, "vec_id", "embedding", b).select("vec_id", F.lower(F.hex("data")).alias("data"), "same"),
        f"WITH {_V}, {_FLAT}, s AS (SELECT vec_id, min(x) AS lo, greatest(max(x) - min(x), 1e-8) AS span FROM f GROUP BY vec_id), k AS (SELECT vec_id, dim, round_even((x - lo) / span * {_l}, 0)::INT AS code FROM f JOIN s USING (vec_id)) SELECT vec_id, data, true AS same FROM ({_data(_l)})",
    )


def _cos_loss(e: DataFrame) -> DataFrame:
    d = codecs.apply_blocks(e, "vec_id", "embedding", codecs.fit_blocks(e, "vec_id", "embedding", 15, 32)).select("vec_id", "decoded", "rmse", (F.octet_length("data") + F.octet_length("meta")).alias("size"))
    j = d.join(e.select("vec_id", "embedding"), "vec_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    cos = dot(F.col("embedding"), F.col("decoded")) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(F.col("decoded"), F.col("decoded")))
    return j.agg(F.round(F.sqrt(F.avg(F.col("rmse") * F.col("rmse"))), 6).alias("rmse"), F.round(F.avg(1 - cos), 6).alias("cos_loss"), F.round(8 * F.sum("size") / F.sum(F.size("embedding")), 6).alias("bits_per_dim"))


_add(
    "codec_rmse_cosloss",
    _cos_loss,
    (lambda c: f"{c[0]}, e AS (SELECT vec_id, avg(pow({c[1]} - x, 2)) AS e, sum(x * {c[1]}) / sqrt(sum(x * x) * sum(pow({c[1]}, 2))) AS c, count(*) AS dims FROM k GROUP BY vec_id) SELECT round(sqrt(avg(e)), 6) AS rmse, round(avg(1 - c), 6) AS cos_loss, round(sum((length(data) + length(meta)) * 4) / sum(dims), 6)::DOUBLE AS bits_per_dim FROM e JOIN z USING (vec_id)")(_block_ctes(15, 32)),
)
_add("pca_project", lambda e: transforms.pca(e, "vec_id", "embedding", 8).select("vec_id", F.transform("projected", lambda x: F.round(x, 6)).alias("projected")))
_add("tensor_train", lambda e: transforms.tensor_train_codec(e, "vec_id", "embedding").select("vec_id", F.size("compressed").alias("dims"), F.round("rmse", 6).alias("rmse")))
_add(
    "cell_order",
    lambda e: transforms.cell_order(e, knn.centroids(e, "label"), "label", "vec_id", "embedding"),
    f"WITH {_V}, {_FLAT}, m AS (SELECT label, dim, avg(f.x) AS c FROM f JOIN v USING (vec_id) GROUP BY ALL), d AS (SELECT vec_id, v.label::BIGINT AS cell, round(sqrt(sum(pow(f.x - c, 2) ORDER BY f.dim)), 6) AS distance FROM f JOIN v USING (vec_id) JOIN m ON m.label = v.label AND m.dim = f.dim GROUP BY ALL) SELECT vec_id, cell, distance, row_number() OVER (ORDER BY cell, distance, vec_id) - 1 AS position FROM d",
)
_add(
    "codec_append",
    lambda e: _coded(codecs.apply_blocks(e.unionByName(e.withColumn("vec_id", F.col("vec_id") + 1_000_000)), "vec_id", "embedding", codecs.fit_blocks(e, "vec_id", "embedding", 63, 32))),
    (lambda c: f"{c[0]}, r AS (SELECT vec_id, round(sqrt(avg(pow({c[1]} - x, 2) ORDER BY dim)), 6) AS rmse FROM k GROUP BY vec_id) SELECT vec_id + o AS vec_id, data, meta, rmse FROM z JOIN r USING (vec_id), (VALUES (0), (1000000)) t(o)")(_block_ctes(63, 32)),
)


def _stored(e: DataFrame) -> DataFrame:
    """A store is written, appended to with other ids, opened again, and decoded from its files alone."""
    path = shared(e.sparkSession, "store")
    store.write(e, path, "Q6_K")
    s = store.open_store(e.sparkSession, path)
    s.append(e.withColumn("vec_id", F.col("vec_id") + 1_000_000))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return s.vectors().select("vec_id", F.round(total, 4).alias("energy"))


_add(
    "store_round_trip",
    _stored,
    (lambda c: f"{c[0]} SELECT vec_id + o AS vec_id, energy FROM (SELECT vec_id, round(sum(pow({c[1]}::FLOAT::DOUBLE, 2) ORDER BY dim), 4) AS energy FROM k GROUP BY vec_id), (VALUES (0), (1000000)) t(o)")(_block_ctes(63, 32)),
)
_add(
    "normalise_l2",
    lambda e: e.select("vec_id", F.expr("round(aggregate(transform(embedding, x -> cast(x as double) / sqrt(aggregate(embedding, 0D, (s, y) -> s + cast(y as double) * y))), 0D, (s, x) -> s + x), 6)").alias("total")),
    f"WITH {_V} SELECT vec_id, round(list_sum(list_transform(x, lambda y: y / sqrt(list_inner_product(x, x)))), 6) AS total FROM v",
)
