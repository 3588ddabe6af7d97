"""Text, retrieval by terms, literals and registers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.functions import text as tx
from loomspark.operators import retrieve
from loomspark.sources.bindings import TOUCHES_SQL, messages, table, touches

TOK = tx.TOKENS_SQL.format
FREQ_SQL = f"""docs AS (SELECT doc_id, {TOK('text')} AS tokens FROM documents),
df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS token FROM docs) GROUP BY token)"""


def token_df(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.document_frequency(table(spark, d, "documents", "doc_id", "text"))


def token_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text")
    return retrieve.inverse_frequency(docs).select("token", F.round("idf", 9).alias("idf"))


def tfidf_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.top_terms(table(spark, d, "documents", "doc_id", "text"), 5)


def vector_norms(spark: SparkSession, d: str) -> DataFrame:
    weights = retrieve.weights(table(spark, d, "documents", "doc_id", "text"))
    return weights.groupBy("doc_id").agg(F.count(F.lit(1)).alias("dims"), F.round(F.sqrt(F.sum(F.col("w") * F.col("w"))), 6).alias("norm"))


def sparse_cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d).select(F.struct("conv_id", "turn").alias("doc_id"), "text")
    return retrieve.neighbour_cosine(rows)


def chunk_feature_dims(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.feature_dims(table(spark, d, "documents", "doc_id", "lang", "source"))


def stem_terms(spark: SparkSession, d: str) -> DataFrame:
    words = messages(spark, d).select(F.explode(tx.tokens(F.col("text"))).alias("token")).groupBy("token").count()
    return words.select("token", tx.stem(F.col("token")).alias("stem"), F.col("count").alias("n"))


def distinctive_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = F.array_sort(tx.distinctive_terms(F.col("text")))
    return messages(spark, d).select("conv_id", "turn", F.size(terms).cast("long").alias("n_terms"), F.array_join(terms, " ").alias("terms"))


def stem_idf(spark: SparkSession, d: str) -> DataFrame:
    freq = retrieve.document_frequency(messages(spark, d).select(F.struct("conv_id", "turn").alias("doc_id"), "text"))
    n = messages(spark, d).count()
    return retrieve.stemmed_idf(freq, n).select("stem", "df", F.round("idf", 9).alias("idf"))


def term_overlap_recall(spark: SparkSession, d: str) -> DataFrame:
    return retrieve.overlap_recall(messages(spark, d))


def role_char_stats(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text").cast("long")
    return messages(spark, d).groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(n).alias("chars"), F.max(n).alias("longest"), F.round(F.avg(n), 6).alias("mean_chars"))


def utf16_chars(spark: SparkSession, d: str) -> DataFrame:
    units = (F.octet_length(F.encode("text", "UTF-16BE")) / 2).cast("long")
    return messages(spark, d).groupBy("conv_id").agg(F.sum(units).alias("units"), F.sum(F.length("text").cast("long")).alias("code_points"))


def literal_hex_mining(spark: SparkSession, d: str) -> DataFrame:
    hexes = F.regexp_extract_all(F.col("text"), F.lit(tx.whole(tx.LITERALS[1][1])), F.lit(0))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.array_distinct(hexes)).alias("n", "literal")).select("doc_id", "literal")


def literals_by_kind(spark: SparkSession, d: str) -> DataFrame:
    found = [F.struct(F.lit(k).alias("kind"), F.regexp_extract_all(F.col("html"), F.lit(tx.whole(p)), F.lit(0)).alias("found")) for k, p in tx.LITERALS]
    rows = table(spark, d, "pages", "page_id", "html").select("page_id", F.explode(F.array(*found)).alias("x"))
    return rows.select("page_id", "x.kind", F.size("x.found").cast("long").alias("n")).where("n > 0")


def key_value_literals(spark: SparkSession, d: str) -> DataFrame:
    raw = F.regexp_extract_all(F.col("text"), F.lit(f"(?<!{tx._W})({tx.KEY_VALUE})"), F.lit(1))
    kept = F.filter(raw, lambda x: F.regexp_extract(x, "[=:] ?(.*)$", 1).rlike("[0-9/@]") & ~x.rlike(r"\.\.+$") & (F.length(x) <= 200))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.explode(F.array_distinct(kept)).alias("literal"))


def glyph_register_counts(spark: SparkSession, d: str) -> DataFrame:
    glyphs = F.array(*(F.lit(r[0]) for r in tx.REGISTERS), F.lit("-"))
    marked = messages(spark, d).where("role = 'assistant'").select("conv_id", F.concat(F.element_at(glyphs, (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6)) + 1).cast("int")), F.lit(" "), F.col("text")).alias("text"))
    t = F.col("text")
    return marked.groupBy(F.coalesce(tx.register(t), F.lit("none")).alias("register"), F.coalesce(tx.register(t, 2), F.lit("low_trust")).alias("trust"), F.coalesce(tx.register(t, 3), F.lit(False)).alias("durable")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(t).cast("long")).alias("chars"))


GLYPH_SQL = f"""WITH m AS (SELECT conv_id, ([{', '.join(f"'{r[0]}'" for r in tx.REGISTERS)}, '-'])[((conv_id + turn) % 6 + 1)::INTEGER] || ' ' || text AS text FROM conversations WHERE role = 'assistant')
SELECT coalesce({tx.register_sql('text')}, 'none') AS register, coalesce({tx.register_sql('text', 2)}, 'low_trust') AS trust,
       coalesce({tx.register_sql('text', 3)}, false) AS durable, count(*) AS n, sum(len(text))::BIGINT AS chars FROM m GROUP BY ALL"""


def excerpts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.sha2(tx.clipped(F.col("text"), 400), 256).alias("excerpt_sha256"))


def text_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    plain = F.lower(F.regexp_replace("text", r"[ \t\r\n]+", " "))
    return messages(spark, d).select("conv_id", "turn", F.concat("role", F.lit(":"), tx.fnv1a(plain).cast("string")).alias("fingerprint"))


def clock_labels(spark: SparkSession, d: str) -> DataFrame:
    return touches(spark, d).groupBy(tx.clock(F.col("ts")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def project_paths(spark: SparkSession, d: str) -> DataFrame:
    absolute = F.concat(F.lit("/home/u"), F.pmod(F.col("session"), F.lit(3)), F.lit("/repo/"), F.col("path"))
    rows = touches(spark, d).select(tx.project_path(absolute).alias("path"), F.regexp_replace(absolute, "[^a-zA-Z0-9]", "-").alias("slug"))
    return rows.groupBy("path", "slug").agg(F.count(F.lit(1)).alias("n"))


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return touches(spark, d).select("event_id", F.concat(F.lit("episode-"), F.left(F.sha2(F.concat_ws("\x00", F.col("session").cast("string"), F.col("pos").cast("string"), "path", "kind"), 256), F.lit(16))).alias("id"))


QUERIES = {
    "token_df": (token_df, f"WITH {FREQ_SQL} SELECT token, df FROM df"),
    "token_idf": (token_idf, f"WITH {FREQ_SQL} SELECT token, round(ln((SELECT count(*) FROM documents) / (1.0 + df)), 9) AS idf FROM df"),
    "tfidf_topk": (tfidf_topk, f"""WITH {FREQ_SQL},
      tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS token FROM docs) GROUP BY ALL),
      w AS (SELECT doc_id, token, round((1 + ln(tf)) * ln((SELECT count(*) FROM documents) / (1.0 + df)), 6) AS w FROM tf JOIN df USING (token) WHERE (SELECT count(*) FROM documents) > 1 + df)
      SELECT doc_id, rank, token, w FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, token) AS rank FROM w) WHERE rank <= 5"""),
    "vector_norms": (vector_norms, f"""WITH {FREQ_SQL},
      tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS token FROM docs) GROUP BY ALL),
      w AS (SELECT doc_id, (1 + ln(tf)) * ln((SELECT count(*) FROM documents) / (1.0 + df)) AS w FROM tf JOIN df USING (token) WHERE (SELECT count(*) FROM documents) > 1 + df)
      SELECT doc_id, count(*) AS dims, round(sqrt(sum(w * w)), 6) AS norm FROM w GROUP BY doc_id"""),
    "sparse_cosine_pairs": (sparse_cosine_pairs, f"""WITH m AS (SELECT conv_id, turn, {TOK('text')} AS tokens FROM conversations),
      df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS token FROM m) GROUP BY token),
      tf AS (SELECT conv_id, turn, token, count(*) AS tf FROM (SELECT conv_id, turn, unnest(tokens) AS token FROM m) GROUP BY ALL),
      w AS (SELECT conv_id, turn, token, (1 + ln(tf)) * ln((SELECT count(*) FROM m) / (1.0 + df)) AS w FROM tf JOIN df USING (token) WHERE (SELECT count(*) FROM m) > 1 + df),
      n AS (SELECT conv_id, turn, sqrt(sum(w * w)) AS norm FROM w GROUP BY ALL),
      dot AS (SELECT a.conv_id, a.turn, sum(a.w * b.w) AS dot FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.token = b.token GROUP BY ALL)
      SELECT dot.conv_id, dot.turn, round(dot / (x.norm * y.norm), 6) AS cosine FROM dot JOIN n x USING (conv_id, turn) JOIN n y ON y.conv_id = dot.conv_id AND y.turn = dot.turn + 1"""),
    "chunk_feature_dims": (chunk_feature_dims, """SELECT doc_id, dim, w FROM (SELECT doc_id, unnest(['file:' || source, 'tag:' || lang, 'type:result']) AS dim, unnest([2.0, 1.5, 1.5])::DOUBLE AS w FROM documents)"""),
    "stem_terms": (stem_terms, f"SELECT token, {tx.stem_sql('token')} AS stem, count(*) AS n FROM (SELECT unnest({TOK('text')}) AS token FROM conversations) GROUP BY token"),
    "distinctive_terms": (distinctive_terms, f"SELECT conv_id, turn, len(t) AS n_terms, array_to_string(list_sort(t), ' ') AS terms FROM (SELECT conv_id, turn, {tx.terms_sql('text')} AS t FROM conversations)"),
    "stem_idf": (stem_idf, f"""WITH m AS (SELECT {TOK('text')} AS tokens FROM conversations),
      df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS token FROM m) GROUP BY token)
      SELECT stem, sum(df)::BIGINT AS df, round(ln((SELECT count(*) FROM m) / (1.0 + sum(df))), 9) AS idf FROM (SELECT {tx.stem_sql('token')} AS stem, df FROM df) GROUP BY stem"""),
    "term_overlap_recall": (term_overlap_recall, f"""WITH m AS (SELECT conv_id, turn, {tx.terms_sql('text')} AS terms, {TOK('text')} AS tokens FROM conversations),
      df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(tokens)) AS token FROM m) GROUP BY token),
      idf AS (SELECT stem, ln((SELECT count(*) FROM m) / (1.0 + sum(df))) AS idf FROM (SELECT {tx.stem_sql('token')} AS stem, df FROM df) GROUP BY stem),
      t AS (SELECT conv_id, turn, unnest(terms) AS stem FROM m),
      o AS (SELECT a.conv_id, a.turn, b.turn AS earlier, i.idf FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn < a.turn AND a.stem = b.stem JOIN idf i ON i.stem = a.stem WHERE i.idf > 0),
      s AS (SELECT conv_id, turn, earlier, round(sum(idf), 4) AS score, count(*) FILTER (idf >= 0.3) AS distinctive FROM o GROUP BY ALL)
      SELECT conv_id, turn, earlier, score, distinctive FROM s WHERE distinctive >= 2"""),
    "role_char_stats": (role_char_stats, "SELECT role, count(*) AS n, sum(len(text))::BIGINT AS chars, max(len(text)) AS longest, round(avg(len(text)), 6) AS mean_chars FROM conversations GROUP BY role"),
    "utf16_chars": (utf16_chars, "SELECT conv_id, sum(len(text) + len(list_filter(string_split(text, ''), lambda c: c <> '' AND unicode(c) > 65535)))::BIGINT AS units, sum(len(text))::BIGINT AS code_points FROM conversations GROUP BY conv_id"),
    "literal_hex_mining": (literal_hex_mining, r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b[0-9a-fA-F]{12,64}\b')) AS literal FROM documents"),
    "literals_by_kind": (literals_by_kind, "SELECT page_id, kind, n FROM (" + " UNION ALL ".join(f"SELECT page_id, '{k}' AS kind, len(regexp_extract_all(html, '\\b{p}\\b')) AS n FROM pages" for k, p in tx.LITERALS) + ") WHERE n > 0"),
    "key_value_literals": (key_value_literals, rf"SELECT DISTINCT doc_id, literal FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b{tx.KEY_VALUE}')) AS literal FROM documents) WHERE regexp_matches(regexp_extract(literal, '[=:] ?(.*)$', 1), '[0-9/@]') AND NOT regexp_matches(literal, '\.\.+$') AND len(literal) <= 200"),
    "glyph_register_counts": (glyph_register_counts, GLYPH_SQL),
    "excerpts": (excerpts, f"SELECT doc_id, sha256({tx.clipped_sql('text', 400)}) AS excerpt_sha256 FROM documents"),
    "text_fingerprints": (text_fingerprints, f"SELECT conv_id, turn, role || ':' || ({tx.FNV_SQL.format('p')})::VARCHAR AS fingerprint FROM (SELECT *, lower(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g')) AS p FROM conversations)"),
    "clock_labels": (clock_labels, "SELECT '[' || strftime(ts, '%-I:%M %p') || ']' AS label, count(*) AS n FROM events GROUP BY label"),
    "project_paths": (project_paths, f"WITH {TOUCHES_SQL}, p AS (SELECT '/home/u' || (session % 3) || '/repo/' || path AS a FROM touches) SELECT regexp_replace(a, '^/home/[^/]+/[^/]+/', '') AS path, regexp_replace(a, '[^a-zA-Z0-9]', '-', 'g') AS slug, count(*) AS n FROM p GROUP BY ALL"),
    "stable_ids": (stable_ids, f"WITH {TOUCHES_SQL} SELECT event_id, 'episode-' || left(sha256(concat_ws(chr(0), session::VARCHAR, pos::VARCHAR, path, kind)), 16) AS id FROM touches"),
}
