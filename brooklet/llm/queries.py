"""The registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brooklet.llm.decontamination import decontaminate
from brooklet.llm.exact_dedup import exact_dedup
from brooklet.llm.langid import identify_language
from brooklet.llm.line_dedup import dedup_lines
from brooklet.llm.common import crc_part, lower_ascii, scratch
from brooklet.llm.lm_scoring import score_texts
from brooklet.llm.merkle import fold, merkle_proofs, path_digest, record_digest
from brooklet.llm.mixing import mix
from brooklet.llm.paragraph_dedup import dedup_units
from brooklet.llm.quality import judge_quality
from brooklet.llm.simhash import simhash_dedup
from brooklet.llm.subvectors import centroid_digest, cluster_vectors
from brooklet.llm.suffix_dedup import repeated_spans
from brooklet.llm.warc import page_of, read_warc, write_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(query):
        QUERIES[query.__name__] = query
        if sql is not None:
            SQL[query.__name__] = sql
        return query

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register()
def op1_mix_sources(spark, folder):
    """Copies of every document in a mix with weights 1, 2, 3; random, so it has no SQL."""
    return mix(table(spark, folder, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies"
    )


@register()
def op2_score_lm(spark, folder):
    """No SQL: trained; tested against plain counts and the plain forward recursion."""
    return score_texts(table(spark, folder, "documents")).drop("tag")


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register(
    rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos, len(lines) AS n FROM d),
    p AS (SELECT *, length(line) + (pos < n - 1)::INTEGER AS size,
                 regexp_extract_all({LOWER.format("line")}, '[^\x20\x09-\x0D]+') AS words FROM l),
    o AS (SELECT *, (sum(size) OVER (PARTITION BY doc_id ORDER BY pos) - size)::BIGINT AS place FROM p),
    r AS (SELECT *, row_number() OVER w AS rank, first_value(doc_id) OVER w AS first_doc FROM o
          WHERE len(words) >= 8 WINDOW w AS (PARTITION BY array_to_string(words, ' ') ORDER BY doc_id, place)),
    a AS (SELECT o.*, coalesce(rank > 1, false) AS gone, first_doc FROM o LEFT JOIN r USING (doc_id, pos))
    SELECT doc_id, sum(size)::BIGINT AS n_chars, count(*) AS n_units, count(*) FILTER (gone) AS n_removed,
           coalesce(sum(size) FILTER (gone), 0)::BIGINT AS n_removed_chars,
           coalesce(string_agg(place || '-' || (place + size) || ':' || first_doc, ',' ORDER BY pos) FILTER (gone), '') AS spans,
           sha256(coalesce(string_agg(line || CASE WHEN pos < n - 1 THEN chr(10) ELSE '' END, '' ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM a GROUP BY doc_id"""
)
def op3_dedup_paragraphs(spark, folder):
    """Repeated lines of at least 8 words; removed places as start-end:document that keeps the line."""
    found = dedup_units(table(spark, folder, "documents"))
    spans = F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"), F.lit(":"), s["first_doc_id"].cast("string")))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_chars", "n_units", F.size("spans").cast("long").alias("n_removed"), removed.alias("n_removed_chars"),
        F.array_join(spans, ",").alias("spans"), F.sha2("kept_text", 256).alias("kept_sha256"),
    )


@register()
def op4_dedup_suffixes(spark, folder):
    """No SQL: it would compare every string of 400 bytes; tested against a plain table of all strings."""
    found = repeated_spans(table(spark, folder, "documents"))
    removed = F.aggregate(
        F.sequence(F.lit(0), F.size("spans")), F.lit(0).cast("long"),
        lambda total, at: total + F.when(at % 2 == 1, F.get("spans", at) - F.get("spans", at - 1)).otherwise(0),
    )
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), "kept_sha256")


@register(
    r"""
    WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)"""
)
def op5_dedup_exact(spark, folder):
    return exact_dedup(table(spark, folder, "documents")).drop("tag")


@register(
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex,
                      min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
    v AS (SELECT *, list_transform(range(8), lambda i: ('0x' || hex[i * 5 + 1 : i * 5 + 5])::BIGINT) AS parts FROM p)
    SELECT page_id, strlen(html) AS payload_bytes,
           array_to_string(list_transform(parts, lambda v: array_to_string(list_transform([15, 10, 5, 0],
               lambda b: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> b) & 31) + 1]), '')), '') AS payload_digest,
           CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> first THEN first END AS refers_to
    FROM v"""
)
def op6_warc_archive(spark, folder):
    """Every page written to archives and read back."""
    pages = table(spark, folder, "pages")
    kind = pages.schema["page_id"].dataType.simpleString()
    files = write_warc(pages, scratch(spark, "warc"))
    found = read_warc(files).withColumn("sound", F.coalesce("verified", F.lit(True)))
    damaged = F.raise_error(F.concat(F.lit("damaged record "), F.col("record_id")))
    return found.select(
        page_of("record_id", kind).alias("page_id"), "payload_bytes",
        F.when(F.col("sound"), F.col("payload_digest")).otherwise(damaged).alias("payload_digest"),
        "record_type", page_of("refers_to", kind).alias("refers_to"),
    )


@register()
def op7_identify_language(spark, folder):
    """No SQL: trained; tested by held-out accuracy and against a plain context tree."""
    return identify_language(table(spark, folder, "documents")).drop("tag")


@register()
def op8_dedup_simhash(spark, folder):
    """No SQL: DuckDB has no XXH64; tested against all pairs."""
    return simhash_dedup(table(spark, folder, "documents")).select("doc_id", "fingerprint", "component_id", "kept")


LINE_KEY = r"translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@register(
    f"""
    WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
    k AS (SELECT *, {LINE_KEY} AS key FROM l),
    f AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM k)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
    FROM f GROUP BY doc_id"""
)
def op9_dedup_lines(spark, folder):
    return dedup_lines(table(spark, folder, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


BENCHMARK_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@register(
    f"""
    WITH d AS (SELECT doc_id, {BENCHMARK_WORDS} AS w FROM documents),
    i AS (SELECT item_id::VARCHAR AS item, {BENCHMARK_WORDS} AS w FROM benchmark),
    iw AS (SELECT item, w, least(13, len(w)) AS size FROM i WHERE len(w) > 0),
    windows AS (SELECT DISTINCT item, size, array_to_string(list_slice(w, p + 1, p + size), ' ') AS win
                FROM (SELECT *, unnest(range(len(w) - size + 1)) AS p FROM iw)),
    sizes AS (SELECT DISTINCT size FROM windows),
    places AS (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS p FROM d, sizes WHERE len(w) >= size),
    found AS (SELECT doc_id, places.size, p, item FROM places
              JOIN windows ON windows.size = places.size AND win = array_to_string(list_slice(w, p + 1, p + places.size), ' ')),
    hits AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(p, p + size)) AS place FROM found) GROUP BY doc_id),
    items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
    SELECT doc_id, len(w) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)"""
)
def op10_decontaminate(spark, folder):
    found = decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


def round_sql(number: int) -> str:
    """All vectors given to the centroids of a round, and the centroids after it."""
    far = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    return f"""
    a{number} AS (SELECT vec_id, copy, v, min({far}::HUGEINT * 16 + cluster) AS best FROM e, c{number} GROUP BY vec_id, copy, v),
    m{number} AS (SELECT (best % 16)::INTEGER AS cluster, unnest(range(64)) AS place, unnest(v) AS x FROM a{number}),
    f{number} AS (SELECT cluster, place, sum(x) AS s, count(*) AS n FROM m{number} GROUP BY cluster, place),
    c{number + 1} AS (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY place) AS c FROM f{number} GROUP BY cluster
                      UNION ALL SELECT cluster, c FROM c{number} WHERE cluster NOT IN (SELECT cluster FROM f{number})),"""


@register(
    f"""
    WITH e AS (SELECT vec_id, row_number() OVER () AS copy, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
               WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    s AS (SELECT v, sha256('1:' || vec_id) AS draw FROM e ORDER BY draw, v LIMIT 16),
    c0 AS (SELECT (row_number() OVER (ORDER BY draw, v) - 1)::INTEGER AS cluster, v AS c FROM s),
    {"".join(map(round_sql, range(4)))}
    g AS (SELECT vec_id, (best % 16)::INTEGER AS cluster, (best // 16)::BIGINT AS distance FROM a3)
    SELECT vec_id, g.cluster, distance, sum(distance) OVER (PARTITION BY g.cluster)::BIGINT AS cluster_inertia,
           sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
    FROM g JOIN c3 ON g.cluster = c3.cluster"""
)
def op11_cluster_vectors(spark, folder):
    found = cluster_vectors(table(spark, folder, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", centroid_digest(F.col("centroid")).alias("centroid_sha256"))


FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen({0}::VARCHAR) || ':' || {0} END"
# CRC-32 of the decimal digits of an id, bit by bit.
CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda i: i::BIGINT)),
        lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))))"""


def tree_sql(leaves: str, tree: str, levels: int) -> str:
    """Levels 0 to ``levels`` of the trees over ``leaves`` (grp, pos, n, h); a tree that has ended stays as it is."""
    sql = f"{tree}0 AS (SELECT grp, pos, n, h FROM {leaves}),"
    for level in range(levels):
        sql += f"""
    {tree}{level + 1} AS (SELECT grp, pos // 16 AS pos, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h
        FROM {tree}{level} GROUP BY grp, pos // 16, n),"""
    return sql


def path_sql(start: str, at: str, tree: str, levels: int) -> str:
    """``proof`` and ``node`` of ``start`` (grp, pos) handed up the tree, as {tree}path{levels}."""
    sql = f"{tree}path0 AS (SELECT *, {at} FROM {start}),"
    for level in range(levels):
        sql += f"""
    {tree}sides{level} AS (SELECT grp, pos, n, array_to_string(list(h) OVER (PARTITION BY grp, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
        array_to_string(list(h) OVER (PARTITION BY grp, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {tree}{level}),
    {tree}path{level + 1} AS (SELECT p.* REPLACE (p.pos // 16 AS pos, CASE WHEN s.n = 1 THEN proof ELSE proof || coalesce(l, '') || coalesce(r, '') END AS proof,
        CASE WHEN s.n = 1 THEN node ELSE sha256(coalesce(l, '') || node || coalesce(r, '')) END AS node)
        FROM {tree}path{level} p JOIN {tree}sides{level} s USING (grp, pos)),"""
    return sql


@register(
    f"""
    WITH f AS (SELECT doc_id, coalesce('1' || source, '0') AS grp, {FIELD.format("doc_id")} || {FIELD.format("source")} || {FIELD.format("lang")} || {FIELD.format("n_chars")} AS head,
                      text, CASE WHEN {CRC32} % 5 = 0 THEN {LOWER.format("text")} ELSE text END AS claimed FROM documents),
    l AS (SELECT doc_id, grp, row_number() OVER (PARTITION BY grp ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS n,
                 sha256(head || {FIELD.format("text")}) AS h, sha256(head || {FIELD.format("claimed")}) AS claim FROM f),
    {tree_sql("l", "t", 6)}
    tops AS (SELECT '' AS grp, grp AS member, h, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS n FROM t6),
    {tree_sql("tops", "u", 4)}
    {path_sql("l", "claim AS node, '' AS proof", "t", 6)}
    m AS (SELECT doc_id, p.h AS leaf, tops.h AS subroot, '' AS grp, tops.pos, node, proof FROM tpath6 p JOIN tops ON p.grp = member),
    {path_sql("(SELECT doc_id, leaf, subroot, grp, pos, node AS start_node, proof AS start_proof FROM m)", "start_node AS node, start_proof AS proof", "u", 4)}
    e AS (SELECT p.*, u4.h AS root FROM upath4 p, u4)
    SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified FROM e"""
)
def op12_merkle_manifest(spark, folder):
    """Proofs of all documents; of a fifth of them the text is changed before the root is computed again."""
    record = [F.col(name) for name in ("doc_id", "source", "lang", "n_chars")]
    docs = table(spark, folder, "documents").withColumn("leaf", record_digest(*record, F.col("text")))
    claim = F.when(crc_part(F.col("doc_id"), 5) == 0, record_digest(*record, lower_ascii(F.col("text")))).otherwise(F.col("leaf"))
    leaves = docs.select("doc_id", "source", "leaf", claim.alias("claim"))
    found = merkle_proofs(leaves, "source", "doc_id", "leaf", carry=["doc_id", "claim"])
    folded = found.withColumn("folded_root", fold(F.col("claim"), F.col("path"))).withColumn("proof_sha256", path_digest(F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


# Characters that are taken away to count a class, in the order of the classes.
CLASS_SETS = [
    "[^a-z]", "[^A-Z]", "[^0-9]", r"[^\x20\x09-\x0D]", r"[^.,;:!?'\"()-]",
    r"[\x00-\x20\x7F-\x{10FFFF}a-zA-Z0-9.,;:!?'\"()-]", r"[^\x00-\x08\x0E-\x1F\x7F]", r"[^\x{C0}-\x{24F}]", r"[\x00-\x7F\x{C0}-\x{24F}]",
]
CLASS_COUNTS = ", ".join("length(regexp_replace(text, '" + kept.replace("'", "''") + "', '', 'g'))" for kept in CLASS_SETS)
# A share's part of the Jensen-Shannon divergence, in bits.
SHARE = "CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END"


@register(
    rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    t AS (SELECT doc_id, lang, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
    lo AS (SELECT doc_id, lang, {LOWER.format("word")} AS word, count(*) AS n FROM t GROUP BY ALL),
    lw AS (SELECT lang, word, sum(n)::BIGINT AS n FROM lo WHERE lang IS NOT NULL GROUP BY lang, word),
    total AS (SELECT lang, sum(n) AS total FROM lw GROUP BY lang HAVING sum(n) >= 1000),
    top AS (SELECT lang, word, n / total AS q FROM lw JOIN total USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 64),
    rest AS (SELECT lang, greatest(1 - sum(q), 0) AS q FROM top GROUP BY lang),
    cc AS (SELECT doc_id, lang, length(text) AS chars, unnest([{CLASS_COUNTS}]) AS n, unnest(range(9)) AS class FROM d),
    cr AS (SELECT lang, class, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM cc WHERE lang IN (SELECT lang FROM total) GROUP BY lang, class),
    cp AS (SELECT doc_id, cr.lang, chars, n / greatest(chars, 1) AS p, q FROM cc JOIN cr USING (class)),
    cd AS (SELECT doc_id, lang, sqrt(greatest(0.5 * sum({SHARE.format(p="p", q="q")}), 0)) AS far FROM cp WHERE chars >= 200 GROUP BY doc_id, lang),
    size AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) >= 50),
    wp AS (SELECT doc_id, top.lang, word, coalesce(lo.n, 0) / size.n AS p, q FROM size CROSS JOIN top LEFT JOIN (SELECT doc_id, word, n FROM lo) lo USING (doc_id, word)),
    ws AS (SELECT doc_id, lang, sum({SHARE.format(p="p", q="wp.q")}) AS common, greatest(1 - sum(p), 0) AS p FROM wp GROUP BY doc_id, lang),
    wd AS (SELECT doc_id, lang, sqrt(greatest(0.5 * (common + {SHARE.format(p="p", q="rest.q")}), 0)) AS far FROM ws JOIN rest USING (lang)),
    fit AS (SELECT doc_id, min(greatest(coalesce(cd.far, 0) / 0.3, coalesce(wd.far, 0) / 0.5)) AS excess
            FROM (SELECT d.doc_id, total.lang FROM d, total) pairs LEFT JOIN cd USING (doc_id, lang) LEFT JOIN wd USING (doc_id, lang) GROUP BY doc_id),
    g AS (SELECT doc_id, pos, list(word) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS gram FROM t),
    gr AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM g WHERE len(gram) = 5),
    rp AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(pos, pos + 5)) AS place FROM gr WHERE times > 1) GROUP BY doc_id),
    ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
    dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    b AS (SELECT d.doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                 length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dl.n, 0) AS n_dup_lines, coalesce(rp.n, 0) AS n_repeat_words
          FROM d LEFT JOIN rp USING (doc_id) LEFT JOIN dl USING (doc_id)),
    v AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b)
    SELECT v.*, NOT base_failed AND coalesce(excess <= 1, true) AS kept FROM v LEFT JOIN fit USING (doc_id)"""
)
def op13_judge_quality(spark, folder):
    """Counts and the verdict; the distances are compared in the tests."""
    return judge_quality(table(spark, folder, "documents")).drop("nearest", "excess")
