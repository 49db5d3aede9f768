"""One registered query per operator, over whole tables, with its oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import bpe, centroids, fill_in_middle, language, quality, sharding, toxicity, url_filter
from newsloom.llm.containment import contained
from newsloom.llm.lattice import embedding_duplicates
from newsloom.llm.licenses import NOTICES, license_scan, notices
from newsloom.llm.near_duplicates import near_duplicates
from newsloom.llm.pitman_yor import pitman_yor_scores
from newsloom.llm.sample import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer files are; read on the driver, broadcast from there."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity and toxic sentences of every document, learned from labels outside the hold-out third."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out("doc_id", 3, 1)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), ~held)
    scored = toxicity.toxicity(docs, model, sentences=True)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", "toxic_sentences", "worst_sentence")


@query("op6_bpe")
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and decoded text as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.with_tokens(docs, bpe.load(tokenizer_file()), digests=True).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op8_language")
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside the hold-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out("doc_id", 4, 2)
    model = language.train(docs, ~held)
    return language.language(docs.drop("lang"), model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learned from labels outside the hold-out quarter."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = held_out("doc_id", 4, 2)
    model = quality.train(docs, table(spark, sf_dir, "labels"), ~held)
    return quality.quality(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a text in DuckDB: A-Z lower-cased, cut at ASCII white space.
_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+')"

NEAR_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (
    SELECT doc_id, CASE
        WHEN len(w) = 0 THEN []
        WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
    FROM words),
each_one AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
    SELECT a.doc_id AS x, b.doc_id AS y
    FROM each_one a JOIN each_one b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(doc_id, other) AS (
    SELECT doc_id, doc_id FROM sets
    UNION
    SELECT r.doc_id, l.y FROM reach r JOIN links l ON r.other = l.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(r.other) AS component_id, s.doc_id = min(r.other) AS kept
FROM sets s JOIN reach r ON r.doc_id = s.doc_id
GROUP BY s.doc_id, s.s
"""


@query("op4_minhash", NEAR_SQL)
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of the documents: three-word shingles, 85 percent."""
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


#: Runs of letters and digits in DuckDB, lower-cased.
_ALNUM = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"


def _runs(source: str, ident: str) -> str:
    """Distinct and ordered five-word shingles of a table's texts, as ``s``; shorter texts are one."""
    five = " || ' ' || ".join(f"w[i + {k}]" if k else "w[i]" for k in range(5))
    return f"""
    SELECT {ident}, CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: {five}) END AS s
    FROM (SELECT {ident}, {_ALNUM} AS w FROM {source} WHERE text IS NOT NULL AND {ident} IS NOT NULL) WHERE len(w) > 0"""


CONTAMINATION_SQL = f"""
WITH docs AS ({_runs('documents', 'doc_id')}), items AS ({_runs('benchmark', 'item_id')}),
of_items AS (SELECT DISTINCT item_id, unnest(s) AS g FROM items),
sizes AS (SELECT item_id, count(*) AS n FROM of_items GROUP BY item_id),
of_docs AS (SELECT DISTINCT doc_id, unnest(s) AS g FROM docs)
SELECT doc_id, item_id, count(*) AS n_shared, n AS n_shingles, count(*) / n AS containment
FROM of_docs JOIN of_items USING (g) JOIN sizes USING (item_id)
GROUP BY doc_id, item_id, n HAVING count(*) * 100 >= n * 80
"""


@query("op9_decontamination", CONTAMINATION_SQL)
def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) of which the document holds 80 percent of the item's shingles."""
    hits = contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    columns = [F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("n_shared").cast("long").alias("n_shared"), F.col("n_shingles").cast("long").alias("n_shingles")]
    return hits.select(*columns, (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def _license_sql() -> str:
    quoted = ", ".join("(" + str(i) + ", '" + a + "', '" + b.replace("'", "''") + "')" for i, (a, b) in enumerate(NOTICES))
    return f"""
WITH notices(item_id, license, text) AS (VALUES {quoted}),
docs AS ({_runs('documents', 'doc_id')}), items AS ({_runs('notices', 'item_id')}),
of_items AS (SELECT DISTINCT item_id, unnest(s) AS g FROM items),
sizes AS (SELECT item_id, count(*) AS n, CASE WHEN count(*) >= 16 THEN 16 WHEN count(*) >= 4 THEN 4 ELSE 1 END AS least FROM of_items GROUP BY item_id),
steps AS (SELECT least, (2 ^ ceil(log2(max(n))))::INT AS step FROM sizes GROUP BY least),
parts AS (
    SELECT doc_id, least, unnest(list_transform(range(0, greatest(ceil((len(s) - step) / step)::INT, 1)), lambda j: struct_pack(j := j, s := s[j * step + 1 : j * step + 2 * step]))) AS p
    FROM docs, steps),
of_parts AS (SELECT DISTINCT doc_id, least, p.j AS j, unnest(p.s) AS g FROM parts),
hits AS (
    SELECT doc_id, item_id, j, n, count(*) AS c
    FROM of_parts JOIN of_items USING (g) JOIN sizes USING (item_id, least)
    GROUP BY doc_id, item_id, j, n HAVING count(*) * 100 >= n * 80)
SELECT doc_id, item_id, license, max(c) AS n_shared, n AS n_shingles, count(*) AS n_windows
FROM hits JOIN notices USING (item_id) GROUP BY doc_id, item_id, license, n
"""


@query("op2_licenses", _license_sql())
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license notice found in every document."""
    found = license_scan(table(spark, sf_dir, "documents"), notices(spark))
    return found.select("doc_id", "item_id", "license", *[F.col(c).cast("long").alias(c) for c in ("n_shared", "n_shingles", "n_windows")])


EMBEDDING_SQL = """
WITH RECURSIVE fit AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
    SELECT a.vec_id AS x, b.vec_id AS y FROM fit a JOIN fit b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(vec_id, other) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION
    SELECT r.vec_id, l.y FROM reach r JOIN links l ON r.other = l.x)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.x = e.vec_id) AS n_links, min(r.other) AS component_id, e.vec_id = min(r.other) AS kept
FROM embeddings e JOIN reach r ON r.vec_id = e.vec_id GROUP BY e.vec_id
"""


@query("op7_lattice", EMBEDDING_SQL)
def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings at cosine 0.95."""
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


@query("op3_pitman_yor")
def op3_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under a model of nine tenths of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pitman_yor_scores(docs, held_out("doc_id", 10, 0))


URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def _url_sql() -> str:
    """The same tree in DuckDB: one set of common tables per level."""
    fits = lambda r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')"
    longest = sorted(URL_RULES, key=lambda r: (-len(r[1]), r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r}'" for _, r in longest) + " END"
    action = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{a}'" for a, r in longest) + " END"
    counts, deep = url_filter.UPPER, url_filter.DEPTH
    parts = [f"""
    parts AS (
        SELECT page_id, coalesce(translate(regexp_extract(url, '{url_filter.SPLIT}', 1), '{counts}', '{url_filter.LOWER}'), '') AS host,
            coalesce(regexp_extract(url, '{url_filter.SPLIT}', 2), '') AS path FROM pages),
    ruled AS (SELECT *, {rule} AS rule, {action} AS action, list_filter(string_split(regexp_replace(path, '[0-9]+', '{{n}}', 'g'), '/'), lambda x: x <> '') AS s FROM parts),
    cut AS (SELECT * EXCLUDE s, CASE WHEN len(s) > {deep} THEN list_append(s[1:{deep - 1}], array_to_string(s[{deep}:], '/')) ELSE s END AS s FROM ruled),
    t0 AS (SELECT host, s, count(*) AS n, count(*) FILTER (action = 'block') AS b, count(*) FILTER (action = 'allow') AS a, '' AS p
        FROM (SELECT DISTINCT host, path, s, action FROM cut) GROUP BY host, s)"""]
    bound = (log(2 / url_filter.ALPHA) / 2) ** 0.5
    for k in range(1, deep + 1):
        shape = ("e", "m", "d")
        alike = " AND ".join(f"abs(e.{c} / e.n - q.{c} / q.n) <= {bound!r} * (1 / sqrt(e.n) + 1 / sqrt(q.n))" for c in shape)
        same = " AND ".join(f"e.q{c} = q.q{c}" for c in shape)
        parts.append(f"""
    e{k} AS (
        SELECT *, {", ".join(f"(8 * {c} + n) // (2 * n) AS q{c}" for c in shape)} FROM (
            SELECT host, p, s[{k}] AS c, sum(n)::BIGINT AS n, sum(CASE WHEN len(s) = {k} THEN n ELSE 0 END)::BIGINT AS e,
                sum(CASE WHEN contains(s[{k + 1}], '{{n}}') THEN n ELSE 0 END)::BIGINT AS m, sum(CASE WHEN len(s) > {k + 1} THEN n ELSE 0 END)::BIGINT AS d
            FROM t{k - 1} WHERE len(s) >= {k} AND NOT contains(s[{k}], '{{n}}') GROUP BY host, p, s[{k}])),
    q{k} AS (SELECT host, p, {", ".join(f"q{c}" for c in shape)}, count(*) AS members, {", ".join(f"sum({c}) AS {c}" for c in ("n", *shape))} FROM e{k} GROUP BY ALL),
    h{k} AS (SELECT host, p, count(*) AS literals, sum(n) AS total FROM e{k} GROUP BY ALL),
    l{k} AS (
        SELECT e.host, e.p, e.c, CASE WHEN h.literals >= {url_filter.LITERALS} AND h.literals * {url_filter.ONE_IN} >= h.total THEN '{{*}}'
            WHEN q.members > 1 AND {alike} THEN '{{' || concat_ws('.', {", ".join(f"e.q{c}" for c in shape)}) || '}}' ELSE e.c END AS label
        FROM e{k} e JOIN q{k} q ON e.host = q.host AND e.p = q.p AND {same} JOIN h{k} h ON h.host = e.host AND h.p = e.p),
    t{k} AS (
        SELECT t.host, t.s, t.n, t.b, t.a, CASE WHEN len(t.s) >= {k} THEN t.p || '/' || coalesce(l.label, t.s[{k}]) ELSE t.p END AS p
        FROM t{k - 1} t LEFT JOIN l{k} l ON l.host = t.host AND l.p = t.p AND l.c = t.s[{k}])""")
    return f"""
WITH {", ".join(parts)},
judged AS (SELECT host, p, (sum(b) + 1) / (sum(b) + sum(a) + 2) AS purity, (sum(b) + sum(a)) / sum(n) AS support FROM t{deep} GROUP BY host, p)
SELECT c.page_id, c.host, c.path, c.rule, coalesce(c.action, CASE WHEN purity >= {url_filter.REJECT} AND support >= {url_filter.SUPPORT} THEN 'block' ELSE 'allow' END) AS verdict,
    t.p AS template, purity, support
FROM cut c JOIN t{deep} t ON t.host = c.host AND t.s = c.s JOIN judged j ON j.host = t.host AND j.p = t.p
"""


@query("op1_url_filter", _url_sql())
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url."""
    return url_filter.url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def _cluster_sql(k: int = 40, rounds: int = 5) -> str:
    """The same rounds in DuckDB, one set of common tables each."""
    distance = "list_sum(list_transform(list_zip(v.v, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    parts = [f"""
    kept AS MATERIALIZED (
        SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor({centroids.SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = {centroids.DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(x::DOUBLE) < {centroids.LIMIT // centroids.SCALE})) = {centroids.DIM}),
    c0 AS MATERIALIZED (
        SELECT row_number() OVER (ORDER BY h, v) - 1 AS n, v AS c FROM (SELECT sha256('2:' || vec_id::VARCHAR) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {k}))"""]
    for i in range(rounds + 1):
        parts.append(f"""
    a{i} AS MATERIALIZED (SELECT v.vec_id, v.r, min({{'d': {distance}, 'n': c.n}}) AS best, any_value(v.v) AS v FROM kept v, c{i} c GROUP BY v.vec_id, v.r)""")
        if i < rounds:
            parts.append(f"""
    m{i} AS (SELECT n, list(x ORDER BY dim) AS c FROM (
        SELECT n, dim, ((s - ((s % m) + m) % m) // m)::BIGINT AS x FROM (
            SELECT n, dim, sum(x) AS s, count(*) AS m FROM (SELECT best.n AS n, unnest(v) AS x, unnest(range({centroids.DIM})) AS dim FROM a{i}) GROUP BY n, dim)) GROUP BY n),
    c{i + 1} AS MATERIALIZED (SELECT c.n, coalesce(m.c, c.c) AS c FROM c{i} c LEFT JOIN m{i} m ON m.n = c.n)""")
    return f"""
WITH {",".join(parts)}
SELECT vec_id, best.n::INT AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.n))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
    sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.n = a.best.n
"""


@query("op11_centroids", _cluster_sql())
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and distance of every embedding after five rounds."""
    assigned, last = centroids.clusters(table(spark, sf_dir, "embeddings"))
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return centroids.with_inertia(assigned, last).select(*columns)


@query("op12_sharding")
def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, shuffled into 40 shards whose numbers of rows differ by one at most; digests are of the texts that arrive."""
    rows = sharding.shuffled(table(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return rows.select("doc_id", size.alias("size"), crc.alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _middle_sql(seed: int = 7, percent: int = 100, spm: int = 50) -> str:
    draw = lambda k: f"('0x' || substr(h, {8 * k + 1}, 8))::UBIGINT"
    lines = lambda a, b: f"array_to_string(u[{a}:{b}], '')"
    p, s, m = fill_in_middle.MARKS
    return f"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u, sha256('{seed}:' || doc_id::VARCHAR) AS h FROM documents),
drawn AS (
    SELECT *, len(u) AS n, {draw(0)} % (len(u) + 1) AS a, {draw(1)} % (len(u) + 1) AS b,
        CASE WHEN t = '' OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR h IS NULL OR {draw(2)} % 100 >= {percent} THEN 'plain'
            WHEN {draw(3)} % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
    SELECT *, {lines(1, 'least(a, b)')} AS p, {lines('least(a, b) + 1', 'greatest(a, b)')} AS m, {lines('greatest(a, b) + 1', 'n')} AS s FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || p || '{s}' || s || '{m}' || m ELSE '{s}' || s || '{p}' || p || '{m}' || m END) AS output_sha256,
    sha256(t) AS restored_sha256
FROM parts
"""


@query("op13_fill_in_middle", _middle_sql())
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut into lines and put in fill-in-the-middle order, as digests of the output and of the text rebuilt from it."""
    store = fill_in_middle.stored(table(spark, sf_dir, "documents").select("doc_id", "text"))
    columns = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    return fill_in_middle.fill_in_middle(store, digests=True).select(*columns)
