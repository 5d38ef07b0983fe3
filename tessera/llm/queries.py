"""The corpus operators applied to whole tables, one query each, and their SQL where SQL can say it.

QUERIES maps a name to a function of (spark, sf_dir); ORACLE maps a name to DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chroma, html_text, licenses, minhash, mixing, mtree, packing, pii, toxicity, url_lists

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Weights of the mixture: web source src0 at four shares, two curated ones at two, all others one.
MIX_WEIGHTS = {"src0": 4.0, "src1": 2.0, "src2": 2.0}
MIX_DEFAULT = 1.0
MIX_SEED = 2024


def tokenizer_path() -> str:
    """The word-level BPE vocabulary that packing is registered with."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(name: str, oracle: str | None = None):
    """Registers a function of (spark, sf_dir) and its SQL."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


_WEIGHT = "CASE source " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in MIX_WEIGHTS.items()) + f" ELSE {MIX_DEFAULT} END"
_UNIT = f"('0x' || substr(md5('{MIX_SEED}|' || doc_id || '|1'), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0"


@query(
    "op3_mixing_poisson",
    f"""
    WITH counts AS (SELECT source, count(*) AS n, {_WEIGHT} AS weight FROM documents GROUP BY source),
    rates AS (SELECT source, weight / (SELECT sum(weight) FROM counts) * (SELECT sum(n) FROM counts) / n AS rate FROM counts),
    mass AS (SELECT source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM rates, range(0, 200) t(k)),
    cdf AS (SELECT source, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM mass),
    drawn AS (SELECT *, {_UNIT} AS u FROM documents),
    counted AS (SELECT d.doc_id, d.source, d.text, count(c.c) AS copies FROM drawn d JOIN cdf c ON d.source = c.source AND c.c <= d.u GROUP BY ALL)
    SELECT doc_id, source, text, copy::INT AS copy, md5('{MIX_SEED}-order|' || doc_id || '|' || copy) AS shuffle_key
    FROM (SELECT doc_id, source, text, unnest(range(0, copies)) AS copy FROM counted)
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.replicated(docs, MIX_WEIGHTS, default_weight=MIX_DEFAULT, seed=MIX_SEED)


@query("op5_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


@query("op7_minhash_near_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, percent=80)


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


@query("op10_license_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(_table(spark, sf_dir, "documents"))


@query("op8_html_consensus")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(_table(spark, sf_dir, "pages"))


@query(
    "op1_mtree_topk",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings),
    scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
        FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
    )
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
    FROM scored QUALIFY rank <= 5
    """,
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_inner_products(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def _draw(at: int, n: int) -> str:
    return f"(('0x' || substr(md5(host), {at}, 4))::BIGINT % {n})"


_DAY = "TIMESTAMP '2024-01-01' + to_days(({})::INT)"
_HOST = r"lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1), '\.+$', ''))"


@query(
    "op4_url_list_join",
    rf"""
    WITH captures AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_minutes(page_id * 7919 % 525600) AS fetched_at, {_HOST} AS host FROM pages),
    hosts AS (SELECT DISTINCT host FROM captures WHERE host <> ''),
    drawn AS (
        SELECT host, {_draw(1, 180)} AS d1, d1 + 1 + {_draw(5, 120)} AS d2, d2 + 1 + {_draw(9, 90)} AS d3,
            ['adult', 'malware', 'spam'][{_draw(13, 3)} + 1] AS kind, regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS parent FROM hosts
    ),
    entries AS (
        SELECT host AS key, kind AS category, 'add' AS action, {_DAY.format("d1")} AS effective FROM drawn
        UNION SELECT host, kind, 'remove', {_DAY.format("d2")} FROM drawn
        UNION SELECT host, kind, 'add', {_DAY.format("d3")} FROM drawn WHERE {_draw(17, 3)} = 0
        UNION SELECT parent, 'parked', 'add', {_DAY.format("152")} FROM drawn
        UNION SELECT parent, 'parked', 'remove', {_DAY.format("166")} FROM drawn
        UNION SELECT host || '/en', 'allow', 'add', {_DAY.format("60")} FROM drawn WHERE {_draw(21, 2)} = 0
    ),
    once AS (SELECT key, category, effective, max(action) AS action FROM entries GROUP BY ALL),
    spans AS (SELECT *, lead(effective) OVER (PARTITION BY key, category ORDER BY effective) AS until FROM once QUALIFY action = 'add'),
    labelled AS (SELECT *, string_split(host, '.') AS l, string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1), '/') AS p FROM captures),
    met AS (
        SELECT page_id, url, fetched_at, array_to_string(l[i:], '.') AS key FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM labelled WHERE host <> '')
        UNION SELECT page_id, url, fetched_at, host || '/' || array_to_string(p[1:i], '/') AS key FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM labelled WHERE host <> '') WHERE key NOT LIKE '%/'
    ),
    found AS (
        SELECT page_id, url, fetched_at, count(*) AS n, arg_min(category, (-len(m.key), category)) AS category
        FROM met m JOIN spans s ON m.key = s.key AND s.effective <= fetched_at AND (until IS NULL OR fetched_at < until) GROUP BY ALL
    )
    SELECT c.page_id, c.url, c.fetched_at, coalesce(n, 0) AS n_active, category, coalesce(category <> 'allow', false) AS blocked
    FROM captures c LEFT JOIN found f ON c.page_id = f.page_id AND c.url = f.url AND c.fetched_at = f.fetched_at
    """,
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    seconds = F.lit(1704067200) + F.col("page_id") * 7919 % 525600 * 60
    captures = pages.withColumn("fetched_at", F.timestamp_seconds(seconds).cast("timestamp_ntz"))
    return url_lists.judged(captures, url_lists.demo_entries(pages))


@query("op6_chroma_alignment")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = _table(spark, sf_dir, "embeddings").select("vec_id", F.struct(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")).alias("media"))
    return chroma.aligned(chroma.fingerprints(media, "vec_id", "media", chroma.demo_recording), every=20)
