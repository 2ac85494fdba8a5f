"""Registered queries over the driver's tables, each with the DuckDB SQL of the same result where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import fuzzy, graph, index, outline, read, search, status, symbols, telemetry, versions
from glyphmill.plans import pipeline
from glyphmill.sources import files as S
from glyphmill.sources import logs, snapshot
from glyphmill.streaming import changes

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
ASCII = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
FILES = "files AS (SELECT source || '/' || lang || '/' || doc_id || '.md' AS path, text AS content FROM documents)"
LINES = FILES + ", lines AS (SELECT path, CAST(unnest(generate_series(1, len(l))) AS INTEGER) AS line_num, unnest(l) AS line_text FROM (SELECT path, string_split(content, chr(10)) AS l FROM files))"
HITS = f"score AS (SELECT path, line_num, line_text, translate(line_text, {ASCII}) AS f FROM lines), hits AS (SELECT path, line_num, line_text, CAST((strlen(f) - strlen(replace(f, 'tion', ''))) / 4 AS INTEGER) AS score FROM score WHERE contains(f, 'tion'))"
EDGES = "edges AS (SELECT url AS path, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS dep FROM pages)"
PART_EDGES = "p AS (SELECT p_partkey AS k, count(*) OVER () AS n FROM part), e AS (SELECT 'f' || k AS path, 'f' || ((k * 7 + 3) % n) AS dep FROM p UNION SELECT 'f' || k, 'f' || ((k * 3 + 1) % n) FROM p)"
VERSIONS = "v AS (SELECT CAST(user_id AS VARCHAR) AS path, event_id AS seq, event_type AS op, ts FROM events)"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return S.documents_as_files(_t(spark, d, "documents"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "pages")
    return p.select(F.col("url").alias("path"), F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("ord", "dep"))


def _part_edges(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    n = p.count()
    name = lambda k: F.concat(F.lit("f"), k.cast("string"))
    k = F.col("p_partkey")
    return p.select(name(k).alias("path"), F.posexplode(F.array(name((k * 7 + 3) % n), name((k * 3 + 1) % n))).alias("ord", "dep"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("seq"), F.col("event_type").alias("op"))


@query(f"WITH {LINES}, {HITS} SELECT * FROM hits ORDER BY score DESC, path, line_num LIMIT 50")
def search_substring(spark, d):
    return search.search(_files(spark, d), "tion", 50)


@query(f"WITH {LINES}, {HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY score DESC, line_num) AS r FROM hits) SELECT path, line_num, line_text, score FROM r WHERE r <= 5 ORDER BY score DESC, path, line_num LIMIT 200")
def search_per_file_cap(spark, d):
    return search.search(_files(spark, d), "TION", 200, per_file=5)


@query(f"WITH {LINES}, {HITS} SELECT path, line_num, line_text, score FROM hits")
def search_indexed(spark, d):
    files = _files(spark, d)
    return search.indexed_search(files, index.trigrams(files), "tion", limit=None)


@query(f"WITH {LINES} SELECT path, line_num, line_text FROM lines WHERE regexp_matches(line_text, 'th[aeiou]+(n|r)d[[:space:]]?') ORDER BY path, line_num LIMIT 100")
def search_regex(spark, d):
    return search.search_regex(_files(spark, d), "th[aeiou]+(n|r)d\\s?", 100)


def _scopes(files: DataFrame) -> DataFrame:
    """A synthetic symbol for every line that ends in a full stop, which reaches to the next one."""
    x = T.lines(files).where(F.col("line_text").endswith("."))
    return x.select("path", F.substring("line_text", 1, 12).alias("name"), F.lit("function").alias("kind"), F.col("line_num").alias("line_start"), F.col("line_num").alias("line_end"), F.col("line_num").alias("ord"))


@query(f"""WITH {LINES}, {HITS}, s AS (SELECT path, line_num AS s, left(line_text, 12) AS name FROM lines WHERE line_text LIKE '%.')
SELECT h.path, h.line_num, h.line_text, h.score, arg_max(name, s) AS scope_name, CASE WHEN max(s) IS NOT NULL THEN 'function' END AS scope_kind, max(s) AS scope_start, max(s) AS scope_end
FROM hits h LEFT JOIN s ON s.path = h.path AND s.s <= h.line_num GROUP BY 1, 2, 3, 4 ORDER BY score DESC, path, line_num LIMIT 100""")
def search_scoped(spark, d):
    files = _files(spark, d)
    return search.search_scoped(files, _scopes(files), "tion", 100)


WORDS = f"w AS (SELECT DISTINCT path, line_num, translate(unnest(regexp_extract_all(line_text, '[A-Za-z0-9_]+')), {ASCII}) AS word FROM lines), h AS (SELECT word, path, line_num FROM w WHERE length(word) >= 2)"


@query(f"WITH {LINES}, {WORDS} SELECT word, count(*) AS hits, count(DISTINCT path) AS files FROM h GROUP BY word")
def word_index(spark, d):
    return index.word_hits(_files(spark, d), parts=False).groupBy("word").agg(F.count(F.lit(1)).alias("hits"), F.countDistinct("path").alias("files"))


@query(f"WITH {LINES}, {WORDS} SELECT DISTINCT path, line_num FROM h WHERE word = 'tion'")
def word_lookup(spark, d):
    return search.word_lookup(index.word_hits(_files(spark, d), parts=False), "TION")


@query(f"WITH {LINES}, {WORDS} SELECT DISTINCT path, line_num FROM h WHERE starts_with(word, 'tion') AND length(word) > 4 ORDER BY path, line_num LIMIT 100")
def word_prefix(spark, d):
    return search.prefix_lookup(index.word_hits(_files(spark, d), parts=False), "tion", 100)


@query("""WITH t AS (SELECT p_partkey, replace(p_name, ' ', '') || 'V' || p_size || '_' || upper(left(p_brand, 3)) || 'Part' AS token FROM part),
c AS (SELECT p_partkey, token, regexp_replace(regexp_replace(regexp_replace(regexp_replace(token, '([a-z])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '([0-9])([^0-9_])', '\\1_\\2', 'g'), '([^0-9_])([0-9])', '\\1_\\2', 'g') AS cut FROM t)
SELECT p_partkey, token, list_filter(list_transform(string_split(cut, '_'), lambda x: lower(x)), lambda x: length(x) >= 2) AS parts FROM c""")
def subtokens(spark, d):
    p = _t(spark, d, "part")
    token = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.lit("V"), F.col("p_size").cast("string"), F.lit("_"), F.upper(F.substring("p_brand", 1, 3)), F.lit("Part"))
    return p.select("p_partkey", token.alias("token")).withColumn("parts", T.subtokens(F.col("token")))


TRI = f"""b AS (SELECT path, lower(hex(encode(translate(content, {ASCII})))) AS h FROM files),
g AS (SELECT path, h, unnest(generate_series(0, length(h) // 2 - 3)) AS i FROM b WHERE length(h) >= 6),
t AS (SELECT path, substr(h, i * 2 + 1, 6) AS tri, CASE WHEN i * 2 + 8 <= length(h) THEN 1 << (CAST('0x' || substr(h, i * 2 + 7, 2) AS INTEGER) % 8) ELSE 0 END AS n, 1 << (i % 8) AS l FROM g),
tri AS (SELECT tri, path, CAST(bit_or(n) AS INTEGER) AS next_mask, CAST(bit_or(l) AS INTEGER) AS loc_mask FROM t WHERE NOT regexp_matches(tri, '^(20|09|0a|0d){{3}}$') GROUP BY tri, path)"""


@query(f"WITH {FILES}, {TRI} SELECT tri, count(*) AS paths, CAST(sum(next_mask) AS BIGINT) AS next_sum, CAST(sum(loc_mask) AS BIGINT) AS loc_sum FROM tri GROUP BY tri")
def trigram_masks(spark, d):
    sums = index.trigrams(_files(spark, d)).groupBy("tri").agg(F.count(F.lit(1)).alias("paths"), F.sum("next_mask").alias("next_sum"), F.sum("loc_mask").alias("loc_sum"))
    return sums.withColumn("tri", index.trigram_text(F.col("tri")))


@query(f"WITH {FILES} SELECT path FROM files WHERE contains(translate(content, {ASCII}), 'ver') AND contains(translate(content, {ASCII}), 'ers') AND contains(translate(content, {ASCII}), 'vers')")
def trigram_candidates(spark, d):
    """Candidates of ``vers``, verified."""
    files = _files(spark, d)
    found = search.trigram_candidates(index.trigrams(files), "vers")
    return files.join(found, "path", "left_semi").where(F.contains(T.fold(F.col("content")), F.lit("vers"))).select("path")


@query(f"WITH {FILES} SELECT path FROM files WHERE regexp_matches(content, 'ation.*ment|hein') ")
def regex_candidates(spark, d):
    files = _files(spark, d)
    found = search.regex_candidates(index.trigrams(files), "ation.*ment|hein")
    return files.join(found, "path", "left_semi").where(F.col("content").rlike("ation.*ment|hein")).select("path")


@query("""WITH b AS (SELECT lower(hex(encode(text))) AS h FROM documents), g AS (SELECT h, unnest(generate_series(0, length(h) // 2 - 2)) AS i FROM b WHERE length(h) >= 4),
c AS (SELECT substr(h, i * 2 + 1, 4) AS p, count(*) AS n FROM g GROUP BY 1)
SELECT CAST('0x' || substr(p, 1, 2) AS INTEGER) AS a, CAST('0x' || substr(p, 3, 2) AS INTEGER) AS b, CAST(65024 - (n * 60928) // max(n) OVER () AS INTEGER) AS weight FROM c""")
def bigram_freq(spark, d):
    return index.pair_frequency(_files(spark, d))


SPANS = f"""b AS (SELECT path, lower(hex(encode(content))) AS h, CAST(strlen(content) AS INTEGER) AS n FROM files WHERE strlen(content) >= 2),
fl AS (SELECT path, lower(hex(encode(translate(content, {ASCII})))) AS l FROM files),
nb AS (SELECT CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS f, path, h, n FROM b),
g AS (SELECT f, n, CAST(i AS INTEGER) AS i, substr(h, i * 2 + 1, 4) AS p FROM (SELECT f, n, h, unnest(generate_series(0, n - 2)) AS i FROM nb)),
c AS (SELECT p, 65024 - (count(*) * 60928) // max(count(*)) OVER () AS w FROM g GROUP BY p),
o AS (SELECT f, n, i, w, lag(w) OVER q AS before, lead(w) OVER q AS after FROM g JOIN c USING (p) WINDOW q AS (PARTITION BY f ORDER BY i)),
e AS (SELECT f, i AS x, lead(i) OVER (PARTITION BY f ORDER BY i) + 2 AS y FROM o WHERE i = 0 OR i = n - 2 OR (w > before AND w > after)),
k AS (SELECT f, x, y, unnest(generate_series(0, greatest(0, (y - x - 16 + 13) // 14))) AS k FROM e WHERE y IS NOT NULL),
sp AS (SELECT path, l, CAST(x + 14 * k AS INTEGER) AS pos, CAST(CASE WHEN y - x - 14 * k <= 16 THEN y - x - 14 * k ELSE 16 END AS INTEGER) AS len FROM k JOIN nb USING (f) JOIN fl USING (path)),
spans AS (SELECT substr(l, pos * 2 + 1, len * 2) AS ngram, path, pos, len FROM sp WHERE len >= 3)"""


@query(f"WITH {FILES}, {SPANS} SELECT * FROM spans")
def sparse_ngrams(spark, d):
    files = _files(spark, d)
    weights = {(r.a, r.b): r.weight for r in index.pair_frequency(files).collect()}  # at most 65,536 pairs
    return index.sparse_ngrams(files, weights)


@query(f"WITH {EDGES} SELECT path, dep FROM edges WHERE NOT contains(dep, '..')")
def edges(spark, d):
    return graph.edges(_edges(spark, d)).select("path", "dep")


@query(f"WITH {EDGES}, m AS (SELECT min(dep) AS x FROM edges) SELECT DISTINCT path FROM edges, m WHERE dep = x OR dep = regexp_extract(x, '[^/]*$')")
def imported_by(spark, d):
    e = _edges(spark, d)
    return graph.imported_by(e, e.agg(F.min("dep")).first()[0])


@query(f"""WITH RECURSIVE {PART_EDGES}, r AS (SELECT 'f1' AS path, 0 AS depth UNION SELECT e.path, depth + 1 FROM r JOIN e ON e.dep = r.path WHERE depth < 4)
SELECT path, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY path HAVING min(depth) > 0""")
def transitive_dependents(spark, d):
    return graph.transitive(_part_edges(spark, d), "f1", True, 4)


@query(f"""WITH RECURSIVE {PART_EDGES}, r AS (SELECT 'f1' AS path, 0 AS depth UNION SELECT e.dep, depth + 1 FROM r JOIN e ON e.path = r.path WHERE depth < 5)
SELECT path, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY path HAVING min(depth) > 0""")
def transitive_dependencies(spark, d):
    return graph.transitive(_part_edges(spark, d), "f1", False, 5)


@query(f"WITH {VERSIONS} SELECT path, max(seq) AS seq, arg_max(op, seq) AS op FROM v GROUP BY path")
def latest_version(spark, d):
    return versions.latest(_versions(spark, d))


@query(f"WITH {VERSIONS} SELECT path, max(seq) AS seq, arg_max(op, seq) AS op FROM v WHERE seq <= 500 GROUP BY path")
def version_at_cursor(spark, d):
    return versions.at_cursor(_versions(spark, d), 500)


@query(f"WITH {VERSIONS}, c AS (SELECT DISTINCT path, 100 * k AS cursor FROM v, range(1, 6) t(k)) SELECT c.path, CAST(cursor AS BIGINT) AS cursor, max(seq) AS seq, arg_max(op, seq) AS op FROM c LEFT JOIN v ON v.path = c.path AND seq <= cursor GROUP BY 1, 2")
def version_at_cursors(spark, d):
    v = _versions(spark, d)
    cursors = v.select("path").distinct().select("path", F.explode(F.array(*[F.lit(100 * k).cast("long") for k in range(1, 6)])).alias("cursor"))
    return versions.at_cursors(v, cursors)


@query(f"WITH {VERSIONS} SELECT path, max(seq) AS seq, arg_max(op, seq) AS op FROM v WHERE seq > 700 GROUP BY path")
def changes_since(spark, d):
    return versions.changes_since(_versions(spark, d), 700)


@query(f"WITH {VERSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS r FROM v) SELECT count(*) AS changes FROM r WHERE r <= 20 AND seq > 300")
def changes_count(spark, d):
    return versions.history(_versions(spark, d), 20).where("seq > 300").agg(F.count(F.lit(1)).alias("changes"))


@query(f"WITH {VERSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS r FROM v) SELECT path, seq, op FROM r WHERE r <= 20")
def history_cap(spark, d):
    return versions.history(_versions(spark, d), 20)


@query(f"WITH {VERSIONS} SELECT CAST(c_custkey AS VARCHAR) AS path, coalesce(max(seq), 0) AS seq FROM customer LEFT JOIN v ON v.path = CAST(c_custkey AS VARCHAR) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200")
def hot_files(spark, d):
    return versions.hot(_t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path")), _versions(spark, d), 200)


@query("""WITH o AS (SELECT * FROM orders WHERE o_orderkey % 7 <> 0), n AS (SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS price, o_orderdate + CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS t FROM orders WHERE o_orderkey % 11 <> 0)
SELECT CAST(coalesce(o.o_orderkey, n.o_orderkey) AS VARCHAR) AS path, CASE WHEN o.o_orderkey IS NULL THEN 'created' WHEN n.o_orderkey IS NULL THEN 'deleted' ELSE 'modified' END AS change
FROM o FULL JOIN n ON o.o_orderkey = n.o_orderkey WHERE o.o_orderkey IS NULL OR n.o_orderkey IS NULL OR (o_orderdate <> t AND o_totalprice <> price)""")
def listing_diff(spark, d):
    o = _t(spark, d, "orders")
    k = F.col("o_orderkey")
    row = lambda price, t: (k.cast("string").alias("path"), t.alias("mtime"), F.lit(1).alias("size"), price.alias("hash"))
    old = o.where(k % 7 != 0).select(*row(F.col("o_totalprice"), F.col("o_orderdate")))
    later = F.when(k % 3 == 0, F.col("o_orderdate") + F.expr("interval 1 day")).otherwise(F.col("o_orderdate"))
    new = o.where(k % 11 != 0).select(*row(F.col("o_totalprice") + F.when(k % 5 == 0, 1).otherwise(0), later))
    return versions.listing_diff(old, new)


@query("""WITH a AS (SELECT user_id AS id, max(ts) AS last_seen FROM events WHERE event_type = 'click' GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
SELECT id, CASE WHEN now - last_seen > INTERVAL 1 DAY THEN 'crashed' ELSE 'active' END AS state FROM a, n""")
def lock_reaper(spark, d):
    e = _t(spark, d, "events")
    now = e.agg(F.max("ts")).first()[0]
    a = e.where("event_type = 'click'").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("last_seen")).withColumn("state", F.lit("active"))
    return versions.reap_stale(a, F.lit(now), F.expr("interval 1 day")).select("id", "state")


@query("""WITH RECURSIVE r AS (SELECT event_type AS path, event_id AS pos, user_id AS agent, CAST(floor(epoch(ts)) AS BIGINT) AS t, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events),
g AS (SELECT path, n, pos, true AS granted, agent AS h, t + 600 AS e FROM r WHERE n = 1
  UNION ALL SELECT r.path, r.n, r.pos, g.h = r.agent OR g.e <= r.t, CASE WHEN g.h = r.agent OR g.e <= r.t THEN r.agent ELSE g.h END, CASE WHEN g.h = r.agent OR g.e <= r.t THEN r.t + 600 ELSE g.e END FROM g JOIN r ON r.path = g.path AND r.n = g.n + 1)
SELECT path, pos, granted FROM g""")
def lock_grants(spark, d):
    e = _t(spark, d, "events")
    return versions.grant_locks(e.select(F.col("event_id").alias("pos"), F.col("user_id").alias("agent_id"), F.col("event_type").alias("path"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.lit(600).alias("ttl")))


@query("""WITH q AS (SELECT event_id, user_id, ts, event_type, last_value(CASE WHEN event_type = 'view' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS q FROM events)
SELECT CAST(event_id % 10 AS VARCHAR) AS path, count(*) * 5.0::DOUBLE AS boost FROM q WHERE event_type = 'purchase' AND ts - q <= INTERVAL 6 HOUR GROUP BY 1""")
def combo_boost(spark, d):
    e = _t(spark, d, "events")
    log = e.select(F.col("event_id").alias("pos"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.when(F.col("event_type") == "view", "query").when(F.col("event_type") == "purchase", "access").otherwise("other").alias("ev"), F.lit("view").alias("query"), (F.col("event_id") % 10).cast("string").alias("path"), F.col("user_id").alias("session"))
    return fuzzy.combo_boost(log, "view", 6 * 3600 * 1000)


@query()
def fuzzy_find(spark, d):
    return fuzzy.find_files(_t(spark, d, "pages").select(F.col("url").alias("path")), "blog example fr", 50, most=50)


@query("""WITH p AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS path FROM pages), x AS (SELECT path, string_split(path, '/') AS s FROM p),
d AS (SELECT DISTINCT array_to_string(s[1:i], '/') AS path, true AS is_dir FROM (SELECT s, unnest(generate_series(1, len(s) - 1)) AS i FROM x WHERE len(s) > 1))
SELECT path, CAST(len(string_split(path, '/')) - 1 AS INTEGER) AS depth, is_dir FROM (SELECT * FROM d UNION ALL SELECT path, false FROM p)""")
def tree(spark, d):
    return symbols.tree(_t(spark, d, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path")))


@query("SELECT CASE WHEN true THEN 'markdown' END AS language, count(*) AS file_count, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS total_lines, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents")
def codebase_stats(spark, d):
    return telemetry.corpus_stats(_files(spark, d))


@query("SELECT lang, count(*) AS file_count, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS total_lines FROM documents GROUP BY lang")
def language_stats(spark, d):
    return _t(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("file_count"), F.sum(F.size(F.split("text", "\n"))).alias("total_lines"))


SUFFIXES = [".py", ".go", ".tf", ".ts", ".php", ".md"]
MIXED = "WITH f AS (SELECT p_partkey || (['.py', '.go', '.tf', '.ts', '.php', '.md'])[p_partkey % 6 + 1] AS path, p_partkey % 6 AS k, ['x = ' || p_size, '# ' || p_name, '  // ' || p_name, '/* ' || p_name, ' * ' || p_size, '', chr(9), 'y'] AS l FROM part), l AS (SELECT path, k, CAST(unnest(generate_series(1, 8)) AS INTEGER) AS line_num, unnest(l) AS t FROM f)"


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    """Files of six languages, each with comments of all kinds and blank lines."""
    k, p = F.col("p_partkey"), _t(spark, d, "part")
    path = F.concat(k.cast("string"), F.element_at(F.array(*[F.lit(x) for x in SUFFIXES]), (k % 6 + 1).cast("int")))
    return p.select(path.alias("path"), F.concat_ws("\n", F.concat(F.lit("x = "), "p_size"), F.concat(F.lit("# "), "p_name"), F.concat(F.lit("  // "), "p_name"), F.concat(F.lit("/* "), "p_name"), F.concat(F.lit(" * "), "p_size"), F.lit(""), F.lit("\t"), F.lit("y")).alias("content"))


@query(MIXED + " SELECT path, line_num FROM l WHERE trim(t, ' ' || chr(9)) <> '' AND NOT (line_num = 2 AND k IN (0, 2)) AND NOT (line_num = 3 AND k IN (1, 2, 3)) AND NOT (line_num IN (4, 5) AND k IN (2, 3))")
def compact_filter(spark, d):
    x = T.lines(_mixed(spark, d))
    return x.where(~search.comment_or_blank(F.col("line_text"), S.language(F.col("path")))).select("path", "line_num")


@query(MIXED + " SELECT path, line_num, t AS line_text FROM l WHERE line_num BETWEEN 2 AND 5 AND NOT (line_num = 2 AND k IN (0, 2)) AND NOT (line_num = 3 AND k IN (1, 2, 3)) AND NOT (line_num IN (4, 5) AND k IN (2, 3))")
def read_compact_range(spark, d):
    return read.read_lines(_mixed(spark, d), 2, 5, compact=True)


@query("SELECT doc_id, CASE WHEN len(string_split(text, chr(10))) >= 3 THEN string_split(text, chr(10))[3] END AS line FROM documents")
def line_by_number(spark, d):
    return _t(spark, d, "documents").select("doc_id", read.line_at(F.col("text"), 3).alias("line"))


@query("SELECT url FROM pages WHERE regexp_matches(url, '^https://.*/fr/[^/]*$')")
def glob_filter(spark, d):
    return _t(spark, d, "pages").where(F.col("url").rlike(T.glob_to_regex("https://**/fr/*"))).select("url")


@query("SELECT url FROM pages WHERE url LIKE '%.html'")
def ext_filter(spark, d):
    return _t(spark, d, "pages").where(F.col("url").endswith(".html")).select("url")


@query("SELECT doc_id, array_to_string(list_transform(list_zip(range(2, 5), string_split(text, chr(10))[2:4])[1:least(3, greatest(0, len(string_split(text, chr(10))) - 1))], lambda x: printf('%5d | %s', x[1], x[2])), chr(10)) AS part FROM documents")
def extract_lines(spark, d):
    return _t(spark, d, "documents").select("doc_id", versions.extract_lines(F.col("text"), 2, 4, True).alias("part"))


LIST = "WITH x AS (SELECT doc_id, ends_with(text, chr(10)) AS closed, string_split(text, chr(10)) AS a FROM documents), y AS (SELECT doc_id, closed, CASE WHEN closed THEN a[1:len(a) - 1] ELSE a END AS l FROM x) "


@query(LIST + "SELECT doc_id, md5(array_to_string(l[1:1] || ['new one', 'new two'] || l[4:], chr(10)) || CASE WHEN closed THEN chr(10) ELSE '' END) AS content FROM y WHERE len(l) >= 2")
def apply_edit_replace(spark, d):
    x = _t(spark, d, "documents").select("doc_id", versions.apply_edit(F.col("text"), "replace", 2, 3, "new one\nnew two").alias("c"))
    return x.where("c is not null").select("doc_id", F.md5("c").alias("content"))


@query(LIST + "SELECT doc_id, md5(array_to_string(l[1:3] || ['added'] || l[4:], chr(10)) || CASE WHEN closed THEN chr(10) ELSE '' END) AS content FROM y")
def apply_edit_insert(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(versions.apply_edit(F.col("text"), "insert", 3, 0, "added")).alias("content"))


@query(LIST + "SELECT doc_id, md5(array_to_string(l[3:], chr(10)) || CASE WHEN closed THEN chr(10) ELSE '' END) AS content FROM y")
def apply_edit_delete(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.md5(versions.apply_edit(F.col("text"), "delete", 1, 2)).alias("content"))


@query("SELECT event_type AS tool, count(*) AS calls, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, max(value) AS max_latency FROM events GROUP BY 1")
def telemetry_summary(spark, d):
    return telemetry.tool_summary(_t(spark, d, "events").withColumnRenamed("event_type", "tool"), "tool", F.col("value"), F.col("tool") == "error")


@query("SELECT event_id, epoch_us(ts) // 1000 AS timestamp_ms, CASE event_type WHEN 'view' THEN 'tool_call' WHEN 'signup' THEN 'session_start' ELSE event_type END AS event_type, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS latency_ns FROM events")
def telemetry_normalise(spark, d):
    e = _t(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "tool").when(F.col("event_type") == "signup", "start").otherwise(F.col("event_type"))
    raw = e.select("event_id", F.to_json(F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), kind.alias("ev"), F.get_json_object("props", "$.k").alias("ns"), F.col("event_id").alias("files"))).alias("value"))
    return telemetry.normalise(raw).select(F.col("file_count").cast("long").alias("event_id"), "timestamp_ms", "event_type", "latency_ns")


FOLDERS = ["", "src/", "node_modules/x/", ".ssh/", "build/", "docs/", "gen/", "a/.aws/"]
NAMES = ["main.zig", ".env.local", "logo.png", "server.key", "Cargo.lock", "tmp.log", "secrets.yml", "id_rsa", "readme.md", "x.envrc", ".npmrc"]
PATHS = "WITH p AS (SELECT ([" + ", ".join(f"'{x}'" for x in FOLDERS) + "])[p_partkey % 8 + 1] || CASE WHEN p_partkey % 3 = 0 THEN 'k' || p_partkey || '/' ELSE '' END || ([" + ", ".join(f"'{x}'" for x in NAMES) + "])[p_partkey % 11 + 1] AS path, p_partkey % 8 AS f, p_partkey % 11 AS n FROM part)"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """Paths of many folders and names, made from the parts' keys."""
    k = F.col("p_partkey")
    of = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (k % len(names) + 1).cast("int"))
    return _t(spark, d, "part").select(F.concat(of(FOLDERS), F.when(k % 3 == 0, F.concat(F.lit("k"), k.cast("string"), F.lit("/"))).otherwise(""), of(NAMES)).alias("path"))


@query(PATHS + " SELECT path, f IN (3, 7) OR n IN (1, 3, 6, 7, 10) AS sensitive FROM p")
def sensitive_paths(spark, d):
    return _paths(spark, d).select("path", S.is_sensitive(F.col("path")).alias("sensitive"))


@query(PATHS + " SELECT path FROM p WHERE f NOT IN (2, 4, 5, 3, 7) AND n NOT IN (1, 2, 3, 4, 5, 6, 7, 10)")
def ignore_rules(spark, d):
    p = F.col("path")
    rules = S.parse_ignore("# rules\n/docs\n*.log\n\n!gen\n", negation=False)
    return _paths(spark, d).where(~S.in_skipped_dir(p) & ~S.has_skipped_suffix(p) & ~S.is_sensitive(p) & ~S.ignored(p, rules))


NAME = "replace(p_name, ' ', '_')"
#: language -> (suffix, a file in which {N} is the part's name, its symbols as (name, kind, first line, last line, dependencies)).
OUTLINES = {
    "python": (".py", "import os.path\nfrom pkg.{N} import x\n\ndef {N}(\n    a,\n    b):\n    \"\"\"doc\n    def fake():\n    \"\"\"\n    return a\n\nclass {N}_c:\n    def run(self):\n        # def none\n        pass\n",
        [("import os.path", "import", 1, 1, ["os/path.py"]), ("from pkg.{N} import x", "import", 2, 2, ["pkg/{N}.py"]), ("{N}", "function", 4, 10, []), ("{N}_c", "struct_def", 12, 15, []), ("run", "function", 13, 15, [])]),
    "rust": (".rs", "use std::fmt;\n/* fn hidden() {\n} */\npub struct {N} {\n    x: u8,\n}\nimpl {N} {\n    pub fn run(&self) -> u8 {\n        let s = \"}\";\n        1\n    }\n}\n#[test]\nfn t() {\n}\nmod inner;\n",
        [("use std::fmt;", "import", 1, 1, ["use std::fmt;"]), ("{N}", "struct_def", 4, 6, []), ("{N}", "impl_block", 7, 12, []), ("run", "function", 8, 11, []), ("t", "test_decl", 14, 15, []), ("inner", "import", 16, 16, ["inner"])]),
    "go": (".go", "package main\nimport (\n\t\"fmt\"\n\tlog \"os\"\n)\ntype {N} struct {\n\tx int\n}\nfunc (r *{N}) Run() {\n\tfmt.Println(\"{\")\n}\n// func no() {}\nconst k = 1\nvar v = 2\n",
        [("\"fmt\"", "import", 3, 3, ["fmt"]), ("log \"os\"", "import", 4, 4, ["os"]), ("{N}", "struct_def", 6, 8, []), ("Run", "function", 9, 11, []), ("k", "constant", 13, 13, []), ("v", "variable", 14, 14, [])]),
    "typescript": (".ts", "import {a} from './{N}';\nexport function {N}() {\n  if (a) { return '}'; }\n}\nconst k = require(\"x\");\n",
        [("import {a} from './{N}';", "import", 1, 1, ["./{N}"]), ("{N}", "function", 2, 4, []), ("k", "constant", 5, 5, []), ("const k = require(\"x\");", "import", 5, 5, ["x"])]),
    "zig": (".zig", "const std = @import(\"std\");\npub const {N} = struct {\n    x: u8,\n    pub fn run() void {\n    }\n};\nconst k = 4;\ntest \"a\" {\n}\n",
        [("std", "import", 1, 1, ["std"]), ("{N}", "struct_def", 2, 6, []), ("run", "function", 4, 5, []), ("k", "constant", 7, 7, []), ("test \"a\" {", "test_decl", 8, 9, [])]),
    "ruby": (".rb", "require 'set'\n=begin\ndef no\n=end\nclass {N}\n  def self.run?\n    1\n  end\nend\n",
        [("require 'set'", "import", 1, 1, ["set"]), ("{N}", "struct_def", 5, 9, []), ("run?", "function", 6, 8, [])]),
    "hcl": (".tf", "resource \"aws\" \"{N}\" {\n  x = \"}\"\n}\nvariable \"v\" {\n}\nmodule \"m\" {\n}\noutput \"o\" {\n}\n",
        [("{N}", "struct_def", 1, 3, []), ("v", "variable", 4, 4, []), ("m", "import", 6, 6, []), ("o", "constant", 8, 8, [])]),
    "r": (".r", "library(dplyr)\n{N} <- function(x) {\n  x\n}\nsetClass(\"{N}_c\", representation(a = \"numeric\"))\n",
        [("library(dplyr)", "import", 1, 1, ["dplyr"]), ("{N}", "function", 2, 4, []), ("{N}_c", "class_def", 5, 5, [])]),
    "php": (".php", "<?php\nuse App\\Models\\{A, B as C};\ninterface {N}_i {\n}\nfinal class {N} {\n  const K = 1;\n  public function run() { return \"}\"; }\n}\nfunction {N}_f() {\n}\n",
        [("use App\\Models\\{A, B as C};", "import", 2, 2, ["app/Models/A.php", "app/Models/B.php"]), ("{N}_i", "interface_def", 3, 4, []), ("{N}", "class_def", 5, 8, []), ("K", "constant", 6, 6, []), ("run", "method", 7, 7, []), ("{N}_f", "function", 9, 10, [])]),
    "dart": (".dart", "import 'dart:io';\nabstract class {N} {\n  void run() {\n  }\n}\nenum E { a, b }\nmixin M {\n}\ntypedef F = int;\n",
        [("import 'dart:io';", "import", 1, 1, ["dart:io"]), ("{N}", "class_def", 2, 5, []), ("run", "function", 3, 4, []), ("E", "enum_def", 6, 6, []), ("M", "trait_def", 7, 8, []), ("F", "type_alias", 9, 9, [])]),
}


def _code(spark: SparkSession, d: str, lang: str) -> DataFrame:
    suffix, code, _ = OUTLINES[lang]
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    return _t(spark, d, "part").select(F.concat(F.lit("src/"), F.col("p_size").cast("string"), F.lit("/"), F.col("p_partkey").cast("string"), F.lit(suffix)).alias("path"), F.replace(F.lit(code), F.lit("{N}"), name).alias("content"))


def _expected(lang: str) -> str:
    """CTE ``s``: the symbols (path, ord, name, kind, line_start, line_end, deps) of every file of a language."""
    suffix, _, rows = OUTLINES[lang]
    text = lambda x: "replace('" + x.replace("'", "''") + f"', '{{N}}', {NAME})"
    values = [f"SELECT 'src/' || p_size || '/' || p_partkey || '{suffix}' AS path, {i} AS ord, {text(n)} AS name, '{k}' AS kind, {a} AS line_start, {b} AS line_end, CAST([{', '.join(text(x) for x in deps)}] AS VARCHAR[]) AS deps FROM part" for i, (n, k, a, b, deps) in enumerate(rows)]
    return "s AS (" + " UNION ALL ".join(values) + ")"


def _outline(lang: str) -> None:
    def run(spark, d):
        return outline.outline_rows(_code(spark, d, lang)).select("path", "ord", "name", "kind", "line_start", "line_end", F.array_join("deps", ",").alias("deps"))

    run.__name__ = f"outline_{lang}"
    query(f"WITH {_expected(lang)} SELECT path, ord, name, kind, line_start, line_end, coalesce(array_to_string(deps, ','), '') AS deps FROM s")(run)


for _lang in OUTLINES:
    _outline(_lang)


@query(f"WITH {_expected('php')}, {_expected('python').replace('s AS (', 'y AS (', 1)}, u AS (SELECT * FROM s UNION ALL SELECT * FROM y) SELECT path, unnest(deps) AS dep FROM u")
def outline_imports(spark, d):
    return outline.imports(_code(spark, d, "php").unionByName(_code(spark, d, "python"))).select("path", "dep")


@query(f"WITH {_expected('python')} SELECT name, path, ord, kind, line_start FROM s WHERE kind <> 'import'")
def symbol_index(spark, d):
    return outline.symbol_index(symbols.symbols(_code(spark, d, "python")))


@query(f"WITH {_expected('rust')} SELECT path, name, kind, line_start FROM s WHERE name = (SELECT min(name) FROM s WHERE kind = 'struct_def')")
def find_symbols(spark, d):
    s = symbols.symbols(_code(spark, d, "rust"))
    return symbols.find_symbol(s, s.where("kind = 'struct_def'").agg(F.min("name")).first()[0]).select("path", "name", "kind", "line_start")


@query("SELECT 'src/' || p_size || '/' || p_partkey || '.rb' AS path, 'run?' AS name, '    6 |   def self.run?' || chr(10) || '    7 |     1' || chr(10) || '    8 |   end' AS body FROM part")
def symbol_bodies(spark, d):
    files = _code(spark, d, "ruby")
    return symbols.symbol_bodies(files, symbols.find_symbol(symbols.symbols(files), "run?"))


@query("""WITH f AS (SELECT 'src/' || p_size || '/' || p_partkey || '.go' AS path, p_size, p_partkey FROM part)
SELECT path, false AS is_dir, '    ' || p_partkey || '.go  go_lang  15L  6 sym' AS text FROM f UNION ALL SELECT DISTINCT 'src/' || p_size, true, '  ' || p_size || '/' FROM f UNION ALL SELECT 'src', true, 'src/'""")
def tree_leaves(spark, d):
    files = _code(spark, d, "go")
    return symbols.tree_leaves(files, symbols.symbols(files)).select("path", "is_dir", "text")


@query(f"""WITH h AS (SELECT 'src/' || p_size || '/' || p_partkey || '.py' AS path, {NAME} AS name, unnest([4, 7, 8, 12, 13, 14]) AS line_num FROM part)
SELECT path, CAST(line_num AS INTEGER) AS line_num, CASE WHEN line_num < 12 THEN name WHEN line_num = 12 THEN name || '_c' ELSE 'run' END AS scope_name, CASE WHEN line_num < 12 THEN 4 WHEN line_num = 12 THEN 12 ELSE 13 END AS scope_start, CASE WHEN line_num < 12 THEN 10 ELSE 15 END AS scope_end FROM h WHERE line_num IN (4, 8, 13, 14)""")
def search_scoped_symbols(spark, d):
    files = _code(spark, d, "python")
    found = search.search_scoped(files, symbols.symbols(files), "def ", None, index.trigrams(files), index.sparse_ngrams(files, {}))
    return found.select("path", "line_num", "scope_name", "scope_start", "scope_end")


@query(f"WITH {LINES} SELECT path, line_num, line_text FROM lines WHERE regexp_matches(line_text, 'ation[a-z ]*ment')")
def regex_indexed(spark, d):
    files = _files(spark, d)
    return search.indexed_regex(files, index.trigrams(files), "ation[a-z ]*ment", None)


@query(f"WITH {FILES}, {SPANS}, q AS (SELECT substr('6d656e74696f6e', 2 * i + 1, 2 * n) AS ngram FROM range(0, 7) a(i), range(3, 8) b(n) WHERE i + n <= 7) SELECT DISTINCT path FROM spans WHERE ngram IN (SELECT ngram FROM q)")
def sparse_candidates(spark, d):
    files = _files(spark, d)
    weights = {(r.a, r.b): r.weight for r in index.pair_frequency(files).collect()}  # at most 65,536 pairs
    return index.sparse_candidates(index.sparse_ngrams(files, weights), "mention")


@query(f"WITH RECURSIVE {PART_EDGES}, r AS (SELECT 'f2' AS path, 0 AS depth UNION SELECT e.path, depth + 1 FROM r JOIN e ON e.dep = r.path WHERE depth < 3) SELECT DISTINCT path FROM r WHERE path <> 'f2'")
def deps_transitive(spark, d):
    return graph.dependencies(_part_edges(spark, d), "f2", "imported_by", True, 3)


@query(f"WITH {PART_EDGES} SELECT dep AS path FROM (SELECT 'f' || k AS path, 'f' || ((k * 7 + 3) % n) AS dep FROM p UNION ALL SELECT 'f' || k, 'f' || ((k * 3 + 1) % n) FROM p) WHERE path = 'f5'")
def deps_forward(spark, d):
    return graph.dependencies(_part_edges(spark, d), "f5", "depends_on")


@query(f"""WITH RECURSIVE {PART_EDGES}, base AS (SELECT 'f' || k AS path FROM p WHERE k <= 3), r AS (SELECT path, 0 AS depth FROM base UNION SELECT e.dep, depth + 1 FROM r JOIN e ON e.path = r.path WHERE depth < 2)
SELECT DISTINCT path FROM r""")
def pipeline_deps(spark, d):
    e = _part_edges(spark, d)
    files = _t(spark, d, "part").where("p_partkey <= 3").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), F.lit("").alias("content"))
    return pipeline.run(pipeline.Corpus(files, e), [{"op": "sort"}, {"op": "deps", "direction": "depends_on", "transitive": True, "max_depth": 2}]).select("path")


@query("""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS path, event_id, event_type, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_id % 2 = 1),
l AS (SELECT CAST(user_id AS VARCHAR) AS path, event_id AS seq, event_type AS op, event_id AS hash FROM events WHERE event_id % 2 = 0), m AS (SELECT max(seq) AS m FROM l),
a AS (SELECT * FROM l UNION ALL SELECT path, m + n, CASE WHEN event_type = 'error' THEN 'tombstone' ELSE event_type END, CASE WHEN event_type = 'error' THEN 0 ELSE event_id END FROM e, m),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY seq DESC) AS r FROM a) SELECT path, seq, op, hash FROM r WHERE r <= 20""")
def append_versions(spark, d):
    e = _t(spark, d, "events")
    row = [F.col("user_id").cast("string").alias("path"), F.lit(1).cast("long").alias("agent"), F.lit(0).cast("long").alias("ts"), F.col("event_id").alias("hash"), F.lit(1).cast("long").alias("size")]
    log = e.where("event_id % 2 = 0").select(F.col("event_id").alias("seq"), F.col("event_type").alias("op"), *row)
    new = e.where("event_id % 2 = 1").select(F.col("event_id").alias("pos"), F.when(F.col("event_type") == "error", "tombstone").otherwise(F.col("event_type")).alias("op"), *row)
    return versions.append_versions(log, new, 20).select("path", "seq", "op", "hash")


@query("SELECT max(event_id) AS seq FROM events")
def current_seq(spark, d):
    return versions.current_seq(_versions(spark, d))


@query("SELECT event_id, CAST(sum(strlen(props)) OVER (ORDER BY event_id) - strlen(props) AS BIGINT) AS data_offset, CAST(strlen(props) AS BIGINT) AS data_len FROM events")
def data_log(spark, d):
    return logs.data_log(_t(spark, d, "events").select("event_id", F.col("event_id").alias("seq"), F.col("props").alias("diff"))).select("event_id", "data_offset", "data_len")


@query("""WITH a AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'crashed' WHEN 1 THEN 'gone' ELSE 'active' END AS state FROM customer), l AS (SELECT o_custkey AS agent_id, 'f' || o_orderkey AS path FROM orders)
SELECT l.* FROM l LEFT JOIN a ON a.id = agent_id WHERE coalesce(state, 'active') = 'active' AND NOT (agent_id = 2 AND path = 'f1')""")
def held_locks(spark, d):
    c = _t(spark, d, "customer")
    agents = c.select(F.col("c_custkey").alias("id"), F.when(c.c_custkey % 4 == 0, "crashed").when(c.c_custkey % 4 == 1, "gone").otherwise("active").alias("state"))
    locks = _t(spark, d, "orders").select(F.col("o_custkey").alias("agent_id"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"))
    return versions.release_lock(versions.held_locks(locks, agents), 2, "f1")


@query("SELECT c_custkey AS id, CASE WHEN c_custkey IN (3, 4) OR c_custkey % 4 <> 0 THEN 'active' ELSE 'crashed' END AS state, CASE WHEN c_custkey IN (3, 4) THEN 99 ELSE 1 END AS last_seen FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + k, 'active', 50 FROM range(1, 3) t(k)")
def agents_registered(spark, d):
    c = _t(spark, d, "customer")
    schema = [F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("name"), F.when(c.c_custkey % 4 == 0, "crashed").otherwise("active").alias("state"), F.lit(0).cast("long").alias("cursor"), F.lit(1).cast("long").alias("last_seen"), F.lit(0).cast("long").alias("edit_count")]
    return versions.heartbeat(versions.register(c.select(*schema), ["x", "y"], 50), [3, 4], 99).select("id", "state", "last_seen")


@query(f"""WITH {LINES}, {WORDS}, {TRI}, w AS (SELECT word, count(*) AS n FROM h GROUP BY word), wb AS (SELECT CAST(sum(strlen(word) + 8 * n) AS BIGINT) AS words FROM w), tb AS (SELECT CAST(10 * count(*) + 4 * count(DISTINCT tri) AS BIGINT) AS trigrams FROM tri)
SELECT words, trigrams, 0 AS sparse, words + trigrams AS total FROM wb, tb""".replace("w AS (SELECT DISTINCT", "wd AS (SELECT DISTINCT", 1).replace("FROM w WHERE length(word)", "FROM wd WHERE length(word)", 1))
def index_size(spark, d):
    files = _files(spark, d)
    return status.index_size(index.word_hits(files, parts=False), index.trigrams(files))


@query(f"""WITH s AS (SELECT count(*) AS n FROM part) SELECT max(event_id) AS seq, count(DISTINCT user_id) AS files, max(n) AS outlines, max(n) AS contents, max(n) AS trigram_files, 'ready' AS scan FROM events, s""")
def index_status(spark, d):
    files = _code(spark, d, "go")
    return status.status(files, _versions(spark, d), symbols.symbols(files), index.word_hits(files), index.trigrams(files)).drop("index_bytes")


@query(f"""WITH f AS (SELECT 'src/' || p_size || '/' || p_partkey || '.rb' AS path, {NAME} AS name FROM part),
o AS (SELECT path, '[{{"name":"require ''set''","kind":"import","line_start":1,"line_end":1}},{{"name":"' || name || '","kind":"struct_def","line_start":5,"line_end":9}},{{"name":"run?","kind":"function","line_start":6,"line_end":8}}]' AS value FROM f)
SELECT 'seq' AS section, '' AS key, '7' AS value UNION ALL SELECT 'tree', path, '{{"path":"' || path || '"}}' FROM f UNION ALL SELECT 'outlines', path, value FROM o UNION ALL SELECT 'dep_graph', path, '["set"]' FROM f""")
def json_snapshot(spark, d):
    files = _code(spark, d, "ruby")
    return snapshot.json_snapshot(files, symbols.symbols(files), outline.imports(files), 7).where("section <> 'symbol_index'")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'replaced' ELSE lang END AS lang FROM documents WHERE doc_id % 7 <> 3 OR doc_id % 5 = 0")
def overlay(spark, d):
    base = _t(spark, d, "documents").select(F.col("doc_id").alias("path"), "lang")
    changed = base.where("path % 5 = 0").withColumn("lang", F.lit("replaced"))
    return snapshot.overlay(base, changed, base.where("path % 7 = 3 and path % 5 <> 0")).withColumnRenamed("path", "doc_id")


@query("""WITH q AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), a AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')
SELECT CAST(a.user_id AS VARCHAR) AS session, CAST(q.event_id AS VARCHAR) AS query, CAST(a.event_id AS VARCHAR) AS path FROM a JOIN q ON a.user_id = q.user_id AND a.ts >= q.ts AND a.ts <= q.ts + INTERVAL 1 HOUR""")
def correlate_window(spark, d):
    e = _t(spark, d, "events")
    pick = lambda kind, name: e.where(F.col("event_type") == kind).select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("session"), F.col("event_id").cast("string").alias(name))
    return changes.correlate(pick("view", "query"), pick("click", "path"), "1 hour").select("session", "query", "path")


@query(f"WITH {LINES}, {HITS}, s AS (SELECT * FROM hits ORDER BY score DESC, path, line_num LIMIT 200), f AS (SELECT path, max(score) AS m, arg_max(line_num, (score, -line_num)) AS l FROM s GROUP BY path) SELECT path FROM f WHERE path LIKE '%/en/%' ORDER BY path LIMIT 10")
def pipeline_search_filter(spark, d):
    steps = [{"op": "search", "query": "tion", "limit": 200}, {"op": "filter", "glob": "**/en/*.md"}, {"op": "sort"}, {"op": "limit", "n": 10}]
    return pipeline.run(pipeline.Corpus(_files(spark, d)), steps).select("path")


@query(f"WITH {LINES}, p AS (SELECT path FROM files WHERE path LIKE 'src3/%' ORDER BY path LIMIT 5) SELECT path, line_num, line_text FROM lines JOIN p USING (path) WHERE line_num <= 3")
def pipeline_read(spark, d):
    steps = [{"op": "filter", "glob": "src3/**", "ext": ".md"}, {"op": "sort"}, {"op": "limit", "n": 5}, {"op": "read", "lines": 3}]
    return pipeline.run(pipeline.Corpus(_files(spark, d)), steps)


@query("SELECT source || '/' || lang || '/' || doc_id || '.md' AS path, CASE WHEN doc_id % 3 = 0 THEN 'unchanged' ELSE 'read' END AS state, CASE WHEN doc_id % 3 <> 0 THEN md5(string_split(text, chr(10))[1]) END AS first_line FROM documents")
def conditional_read(spark, d):
    """A third of the files is known by its hash, another by a wrong one."""
    files = _t(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"), F.col("text").alias("content"))
    known = files.where("doc_id % 3 < 2").select("path", F.when(F.col("doc_id") % 3 == 0, read.content_hash(F.col("content"))).otherwise("0").alias("hash"))
    return read.read_texts(files, 1, 1, numbered=False, known=known).select("path", "state", F.md5("text").alias("first_line"))
