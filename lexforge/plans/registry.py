"""Queries of the core operators over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions import inflect, similarity, tokens
from lexforge.operators import clustering, counting, index, lsi, search, sinks, spelling
from lexforge.plans import select
from lexforge.sources import corpus, dictionary, javalex, stopwords

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _words(spark: SparkSession, d: str) -> DataFrame:
    return corpus.text_tokens(_t(spark, d, "documents"))


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return stopwords.without_stop_words(_words(spark, d), stopwords.stop_words(spark))


def _postings(spark: SparkSession, d: str) -> DataFrame:
    return index.create_index(_clean(spark, d)).postings


def _binary(spark: SparkSession, d: str) -> DataFrame:
    return _postings(spark, d).withColumn("x", F.lit(1.0))


def _identifiers(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers in the texts of documents: letters, digits, _ and $ after a letter or _."""
    docs = _t(spark, d, "documents")
    return docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("id"))


def _java(spark: SparkSession, d: str) -> DataFrame:
    """The Java files of sources, the latest row of each id."""
    s = _t(spark, d, "sources").where(F.lower("path").endswith(".java"))
    return s.groupBy("source_id").agg(F.max_by("content", F.struct("committed_at", "content")).alias("content")).select(F.format_string("%012d", "source_id").alias("source_name"), "content")


_TOK = "tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word, unnest(range(len(regexp_extract_all(lower(text), '[a-z]+')))) AS i FROM documents)"
_STOP = f"st AS ({stopwords.values_sql()})"
_CLEAN = f"WITH {_TOK}, {_STOP}, cl AS (SELECT doc_id, word, i FROM tok WHERE length(word) > 1 AND word NOT IN (SELECT stop FROM st))"
_POST = f"{_CLEAN}, po AS (SELECT word, doc_id AS doc, count(*)::DOUBLE AS x FROM cl GROUP BY ALL)"
_FOLD = f"""{_CLEAN}, sc AS (SELECT stop FROM ({stopwords.values_sql(stopwords.COUNTING)})), cw AS (SELECT * FROM cl WHERE word NOT IN (SELECT stop FROM sc)),
 s0 AS (SELECT word, count(*) AS n, min((doc_id, i)) AS p FROM cw GROUP BY word), s1 AS (SELECT word, n, p, {inflect.sql('word', False)} AS single FROM s0),
 s2 AS (SELECT a.word, a.n, b.word AS up FROM s1 a LEFT JOIN s0 b ON a.single = b.word AND a.single <> a.word AND b.p < a.p),
 s3 AS (SELECT a.word, a.n, a.up, ((a.up IS NOT NULL)::INT + (b.up IS NOT NULL)::INT + (c.up IS NOT NULL)::INT) % 2 = 1 AS folds FROM s2 a LEFT JOIN s2 b ON a.up = b.word LEFT JOIN s2 c ON b.up = c.word),
 ro AS (SELECT word, n, CASE WHEN folds THEN up ELSE word END AS root FROM s3),
 cnts AS (SELECT root AS word, sum(n)::BIGINT AS cnt FROM ro GROUP BY root), fp AS (SELECT DISTINCT cw.word, doc_id AS doc FROM cw JOIN ro ON cw.word = ro.word AND ro.word = ro.root)"""
_SCORE = f"""{_FOLD}, nn AS (SELECT count(DISTINCT doc) AS n FROM fp), df AS (SELECT word, count(*) AS df FROM fp GROUP BY word),
 ra AS (SELECT fp.word, doc, 1 + ln(n) - ln(df) AS r FROM fp JOIN df USING (word), nn), we AS (SELECT word, doc, r / sum(r) OVER (PARTITION BY doc) AS w FROM ra), sco AS (SELECT word, sum(w) AS score FROM we GROUP BY word)"""
_ONE_KIND = "({w} <> '' AND (regexp_full_match(lower({w}), '[aeiuo]*') OR (NOT contains(lower({w}), 'ng') AND regexp_full_match(lower({w}), '.[^aeyiuo]*'))))"
_IDENT = "idn AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS id FROM documents)"


def _split_sql(c: str) -> str:
    return f"[x FOR x IN string_split(regexp_replace(regexp_replace({c}, '([^A-Z_])([A-Z])', '\\1_\\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1_\\2', 'g'), '_') IF trim(x) <> '']"


# ranked words


@query(f"{_SCORE} SELECT word, round(score, 6) AS score FROM sco ORDER BY sco.score DESC, word LIMIT 150")
def weighted_words_top150(spark, d):
    """The 150 words with the highest normalised tf-idf score."""
    return select.weighted_words(_clean(spark, d), select.clamp(None)).select("word", F.round("score", 6).alias("score"))


@query(f"{_SCORE} SELECT word, round(score, 6) AS score FROM sco")
def weighted_words_all(spark, d):
    return select.weighted_words(_clean(spark, d)).select("word", F.round("score", 6).alias("score"))


@query(f"{_FOLD} SELECT word, cnt FROM cnts ORDER BY cnt DESC, word LIMIT 50")
def frequent_words_top50(spark, d):
    return select.frequent_words(_clean(spark, d), 50)


@query(f"{_FOLD} SELECT word, cnt, count(fp.doc) AS n_docs FROM cnts LEFT JOIN fp USING (word) GROUP BY word, cnt")
def flatten_word_list(spark, d):
    return select.flatten_words(_clean(spark, d))


@query(f"{_CLEAN} SELECT word, count(*) AS cnt FROM cl GROUP BY word")
def count_without_folding(spark, d):
    return counting.count_words(_clean(spark, d), fold=False)[0]


@query(f"{_FOLD} SELECT word, root FROM ro WHERE word <> root")
def plural_folding(spark, d):
    words = stopwords.without_stop_words(_clean(spark, d), stopwords.stop_words(spark, stopwords.COUNTING))
    return counting.fold_roots(counting.word_stats(words)).where("word <> root").select("word", "root")


@query(f"{_FOLD} SELECT word, cnt FROM cnts ORDER BY cnt DESC, word LIMIT 25")
def frequency_strategy(spark, d):
    """A filter strategy handed to the flow."""
    return select.apply(_clean(spark, d), select.by_frequency(25))


@query(f"{_SCORE} SELECT word, round(score, 6) AS score FROM sco ORDER BY sco.score DESC, word LIMIT 25")
def weight_strategy(spark, d):
    return select.apply(_clean(spark, d), select.by_composite_weight(25)).select("word", F.round("score", 6).alias("score"))


# identifiers


@query(f"WITH {_IDENT}, pi AS (SELECT doc_id, unnest({_split_sql(chr(39).join(['regexp_replace(id, ', '(-?[0-9]+)|([+]1)', ', ', '', ', ', 'g', ')']))}) AS p FROM idn) SELECT doc_id, lower(p) AS piece, count(*) AS n FROM pi GROUP BY ALL")
def split_identifiers(spark, d):
    """Pieces of each document's identifiers."""
    ids = _identifiers(spark, d).select("doc_id", F.explode(tokens.camel_pieces(tokens.strip_digits(F.col("id")))).alias("p"))
    return ids.groupBy("doc_id", F.lower("p").alias("piece")).agg(F.count("*").alias("n"))


@query(f"WITH {_TOK} SELECT DISTINCT word, {_ONE_KIND.format(w='word')} AS flag FROM tok")
def consonant_vowel_filter(spark, d):
    return _words(spark, d).select("word").distinct().select("word", tokens.one_kind_of_letter(F.col("word")).alias("flag"))


@query(f"WITH {_IDENT} SELECT id, count(*) AS n FROM idn WHERE length(id) >= 4 GROUP BY id")
def short_filter(spark, d):
    return _identifiers(spark, d).where(tokens.long_enough(F.col("id"))).groupBy("id").agg(F.count("*").alias("n"))


@query(f"WITH {_IDENT} SELECT id, count(*) AS n FROM idn WHERE id LIKE '%Exception' OR id IN ('Throwable', 'Error') GROUP BY id")
def throwable_filter(spark, d):
    return _identifiers(spark, d).where(tokens.is_throwable(F.col("id"))).groupBy("id").agg(F.count("*").alias("n"))


@query(f"WITH {_IDENT} SELECT id, count(*) AS n FROM idn WHERE length(id) >= 4 AND NOT (NOT contains(rtrim(id, '_'), '_') AND {_ONE_KIND.format(w='id')}) AND NOT (id LIKE '%Exception' OR id IN ('Throwable', 'Error')) GROUP BY id")
def accepted_identifiers(spark, d):
    return _identifiers(spark, d).where(tokens.accepted(F.col("id"))).groupBy("id").agg(F.count("*").alias("n"))


@query(f"WITH {_IDENT}, di AS (SELECT DISTINCT id FROM idn WHERE regexp_matches(id, '[0-9]')) SELECT id, regexp_replace(id, '(-?[0-9]+)|([+]1)', '', 'g') AS stripped, regexp_full_match(id, '[0-9]+') AS number, regexp_matches(id, '^[0-9]') AS starts, regexp_matches(id, '[0-9]$') AS ends, regexp_replace(regexp_replace(id, '^[0-9]+', ''), '[0-9]+$', '') AS trimmed FROM di")
def number_functions(spark, d):
    i = F.col("id")
    ids = _identifiers(spark, d).select("id").distinct().where(i.rlike("[0-9]"))
    return ids.select("id", tokens.strip_digits(i).alias("stripped"), tokens.is_number(i).alias("number"), tokens.starts_with_number(i).alias("starts"), tokens.ends_with_number(i).alias("ends"), tokens.trim_numbers(i).alias("trimmed"))


# stop lists


@query(f"{_CLEAN} SELECT word, count(*) AS cnt FROM cl GROUP BY word")
def stopword_antijoin(spark, d):
    return _clean(spark, d).groupBy("word").agg(F.count("*").alias("cnt"))


@query(f"{_CLEAN} SELECT word, count(*) AS cnt FROM cl WHERE {inflect.sql('word', True)} NOT IN (SELECT stop FROM st) GROUP BY word")
def stopword_plural_antijoin(spark, d):
    return stopwords.without_stop_words(_words(spark, d), stopwords.stop_words(spark), plural=True).groupBy("word").agg(F.count("*").alias("cnt"))


@query(f"{_CLEAN} SELECT word, count(*) AS cnt FROM cl WHERE word NOT IN (SELECT lower(word) FROM dictionary) GROUP BY word")
def custom_stopwords(spark, d):
    """The dictionary's words as a custom stop list."""
    stops = stopwords.stop_words(spark, extra=_t(spark, d, "dictionary").select("word"))
    return stopwords.without_stop_words(_words(spark, d), stops).groupBy("word").agg(F.count("*").alias("cnt"))


@query(f"WITH {_TOK}, {_STOP} SELECT DISTINCT word, length(word) = 1 OR word IN (SELECT stop FROM st) AS stop FROM tok")
def is_stop_word(spark, d):
    words = sorted({w for n in stopwords.DEFAULT for w in stopwords.BUILT_IN[n]})
    return _words(spark, d).select("word").distinct().select("word", stopwords.is_stop_word(F.col("word"), words).alias("stop"))


@query(f"WITH {_TOK} SELECT tok.doc_id, word, count(*) AS cnt FROM tok JOIN documents USING (doc_id) WHERE lower(trim(source)) IN ('wiki', 'mail') GROUP BY ALL")
def whiteset_filter(spark, d):
    """Words of the sources in a white set; source plays the method."""
    docs = _t(spark, d, "documents").where(F.lower(F.trim("source")).isin("wiki", "mail"))
    return corpus.text_tokens(docs).groupBy(F.col("doc").alias("doc_id"), "word").agg(F.count("*").alias("cnt"))


# inflection

_DISTINCT = f"WITH {_TOK}, w AS (SELECT DISTINCT word FROM tok)"


@query(f"{_DISTINCT} SELECT word, {inflect.sql('word', True)} AS result FROM w")
def pluralize(spark, d):
    return _words(spark, d).select("word").distinct().select("word", inflect.plural_of("word").alias("result"))


@query(f"{_DISTINCT} SELECT word, {inflect.sql('word', False)} AS result FROM w")
def singularize(spark, d):
    return _words(spark, d).select("word").distinct().select("word", inflect.singular_of("word").alias("result"))


@query(f"{_DISTINCT} SELECT word, {inflect.sql('word', False)} = word AS singular, {inflect.sql('word', True)} = word AS plural FROM w")
def is_plural_singular(spark, d):
    return _words(spark, d).select("word").distinct().select("word", inflect.is_singular("word").alias("singular"), inflect.is_plural("word").alias("plural"))


@query(f"{_DISTINCT} SELECT word FROM w WHERE word IN ({', '.join(repr(x) for x in inflect.UNCOUNTABLE)})")
def uncountable(spark, d):
    return _words(spark, d).select("word").distinct().where(inflect.is_uncountable(F.col("word")))


# similarity of words

# a character that no dictionary word has equals none of them, so one byte stands for it: DuckDB counts bytes
_VALUE = "SELECT DISTINCT lower(trim(element)) AS w, regexp_replace(lower(trim(element)), '[^ -~]', chr(1), 'g') AS b FROM typed_words WHERE trim(element) <> ''"
_PAIR = f"WITH v AS ({_VALUE}), x AS (SELECT word AS s FROM dictionary), z AS (SELECT w, s, levenshtein(b, s)::INT AS dist, (1.0::FLOAT - (levenshtein(b, s)::DOUBLE / greatest(length(b), length(s)))::FLOAT) AS sim FROM v, x)"


def _pairs(spark, d):
    """Every distinct typed value with every dictionary word: the values are the stated query set, the words a fixed list of known size."""
    v = _t(spark, d, "typed_words").select(F.lower(F.trim("element")).alias("w")).where("w <> ''").distinct()
    words = sorted(r["word"] for r in _t(spark, d, "dictionary").select("word").limit(100_001).collect())
    if len(words) > 100_000:
        raise ValueError("the list of words is too long to be sent to the tasks")
    out = None
    for lo in range(0, max(1, len(words)), 2000):
        part = v.select("w", F.explode(F.array(*[F.lit(x) for x in words[lo : lo + 2000]]).cast("array<string>")).alias("s"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"{_PAIR} SELECT w, s, dist FROM z")
def edit_distance(spark, d):
    """All typed values and dictionary words."""
    return _pairs(spark, d).select("w", "s", similarity.distance(F.col("w"), F.col("s")).alias("dist"))


@query(f"{_PAIR} SELECT w, s, round(sim::DOUBLE, 5) AS sim FROM z WHERE sim > 0.3::FLOAT")
def similarity_gate(spark, d):
    """All typed values and dictionary words that are similar enough."""
    w, s = F.col("w"), F.col("s")
    return _pairs(spark, d).where(similarity.similar_enough(w, s)).select("w", "s", F.round(similarity.similarity(w, s).cast("double"), 5).alias("sim"))


# documents and index


@query("SELECT DISTINCT doc, regexp_extract(doc, '^(.*)#([^#]*)$', 1) AS path, regexp_extract(doc, '^(.*)#([^#]*)$', 2) AS method FROM docs WHERE contains(doc, '#') UNION SELECT doc, doc, '' FROM docs WHERE NOT contains(doc, '#')")
def parse_document(spark, d):
    c = F.col("doc")
    return _t(spark, d, "docs").select("doc", tokens.doc_path(c).alias("path"), tokens.doc_method(c).alias("method")).distinct()


@query("SELECT DISTINCT doc FROM docs")
def document_string(spark, d):
    c = F.col("doc")
    return _t(spark, d, "docs").select(tokens.doc_name(tokens.doc_path(c), tokens.doc_method(c)).alias("doc")).distinct()


@query(f"{_POST} SELECT word, doc, x FROM po")
def postings(spark, d):
    return _postings(spark, d).select("word", "doc", "x")


@query(f"{_POST} SELECT doc, string_agg(word, ' ' ORDER BY word) AS words FROM po GROUP BY doc")
def doc_to_words(spark, d):
    return index.doc_to_words(_postings(spark, d))


@query(f"{_POST} SELECT DISTINCT doc FROM po")
def distinct_docs(spark, d):
    return index.create_index(_clean(spark, d)).docs


@query(f"{_POST} SELECT DISTINCT word FROM po")
def distinct_words(spark, d):
    return index.create_index(_clean(spark, d)).terms


@query(f"{_POST} SELECT word, count(DISTINCT doc) AS df FROM po GROUP BY word")
def doc_frequency(spark, d):
    return index.doc_frequency(_postings(spark, d))


@query(f"{_POST} SELECT doc, sum(x) AS total FROM po GROUP BY doc")
def col_sums(spark, d):
    return index.col_sums(_postings(spark, d))


@query(f"{_POST} SELECT word, sum(x) AS total FROM po GROUP BY word")
def row_sums(spark, d):
    return index.row_sums(_postings(spark, d))


@query(f"{_POST}, nn AS (SELECT count(DISTINCT doc) AS n FROM po), df AS (SELECT word, count(DISTINCT doc) AS df FROM po GROUP BY word), ra AS (SELECT po.word, doc, x * (1 + ln(n) - ln(df)) AS r FROM po JOIN df USING (word), nn) SELECT word, doc, round(r / sum(r) OVER (PARTITION BY doc), 6) AS w FROM ra")
def tfidf_matrix(spark, d):
    return index.tfidf(_postings(spark, d)).select("word", "doc", F.round("w", 6).alias("w"))


@query(f"{_POST} SELECT word, doc, x FROM po WHERE doc <> 3")
def matrix_delete_col(spark, d):
    return index.delete_column(_postings(spark, d), 3)


@query(f"{_POST} SELECT word, doc, x / 4.0::DOUBLE AS x FROM po")
def matrix_div(spark, d):
    return index.divide(_postings(spark, d), 4)


@query(f"{_POST} SELECT doc AS word, word AS doc, x FROM po")
def matrix_transpose(spark, d):
    return index.transpose(_postings(spark, d))


@query(f"{_POST} SELECT word, doc, x FROM po WHERE word = 'cache' OR doc = 3")
def matrix_row_col(spark, d):
    p = _postings(spark, d)
    return index.row(p, "cache").unionByName(index.column(p, 3)).distinct()


_SHOWN = ("java", "python", "json", "xml", "markdown", "text", "none")


@query("WITH g AS (SELECT coalesce(repo, '-') AS word, CASE WHEN lang IS NULL THEN 'none' ELSE lower(lang) END AS doc, count(DISTINCT source_id)::DOUBLE AS x FROM sources GROUP BY ALL) SELECT printf('%15s', word) AS word, " + ", ".join(f"printf('%8.4f', coalesce(sum(x) FILTER (doc = '{n}'), 0.0)) AS D{i}" for i, n in enumerate(_SHOWN)) + " FROM g GROUP BY g.word")
def matrix_print(spark, d):
    """Files by repository and language as fixed-width text; a null repository prints as -."""
    s = _t(spark, d, "sources")
    m = s.groupBy(F.coalesce("repo", F.lit("-")).alias("word"), F.coalesce(F.lower("lang"), F.lit("none")).alias("doc")).agg(F.count_distinct("source_id").cast("double").alias("x"))
    return sinks.matrix_text(m, list(_SHOWN))


# vectors

_EMB = "WITH e AS (SELECT vec_id AS id, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings), nv AS (SELECT id, v, sqrt(list_sum([x * x FOR x IN v])) AS nm FROM e), pq AS (SELECT a.id AS i, b.id AS j, [abs(z[1] * z[2]) FOR z IN list_zip(a.v, b.v)] AS pr, a.nm * b.nm AS nn FROM nv a, nv b WHERE a.id % 50 = 0)"


def _embeddings(spark, d):
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


@query(f"{_EMB} SELECT i, j, round(list_sum(pr) / nn, 6) AS sim FROM pq")
def similarity_matrix(spark, d):
    """Column similarity of every 50th vector with all."""
    e = _embeddings(spark, d)
    return search.cross_similarity(e.where("id % 50 = 0"), e).select("i", "j", F.round("sim", 6).alias("sim"))


@query(f"{_EMB} SELECT i, j, round(list_max(pr) / nn, 6) AS sim FROM pq")
def max_product_similarity(spark, d):
    """Row similarity of every 50th vector with all."""
    e = _embeddings(spark, d)
    return search.cross_similarity(e.where("id % 50 = 0"), e, "max_product").select("i", "j", F.round("sim", 6).alias("sim"))



_KM = """WITH o AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS ord, [x::DOUBLE FOR x IN embedding] AS v FROM embeddings), c0 AS (SELECT ord - 1 AS g, v FROM o WHERE ord <= (SELECT floor(sqrt(count(*))) FROM o)),
 s1 AS (SELECT o.id, c.g, list_max([abs(z[1] * z[2]) FOR z IN list_zip(o.v, c.v)]) / (sqrt(list_sum([x * x FOR x IN o.v])) * sqrt(list_sum([x * x FOR x IN c.v]))) AS s FROM o, c0 c),
 a1 AS (SELECT id, CASE WHEN s > 0 THEN g ELSE 0 END AS g FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 11) DESC, g) AS k FROM s1) WHERE k = 1),
 m1 AS (SELECT g, p, avg(x) AS x FROM (SELECT a1.g, unnest(o.v) AS x, unnest(range(len(o.v))) AS p FROM a1 JOIN o USING (id)) GROUP BY g, p), n1 AS (SELECT g, list(x ORDER BY p) AS v FROM m1 GROUP BY g),
 c1 AS (SELECT c0.g, coalesce(n1.v, c0.v) AS v FROM c0 LEFT JOIN n1 USING (g)),
 s2 AS (SELECT o.id, c.g, list_max([abs(z[1] * z[2]) FOR z IN list_zip(o.v, c.v)]) / (sqrt(list_sum([x * x FOR x IN o.v])) * sqrt(list_sum([x * x FOR x IN c.v]))) AS s FROM o, c1 c),
 a2 AS (SELECT id, CASE WHEN s > 0 THEN g ELSE 0 END AS g FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(s, 11) DESC, g) AS k FROM s2) WHERE k = 1)"""


@query(f"{_KM} SELECT g::INT AS group_id, id AS vec_id FROM a2")
def kmeans_two_pass(spark, d):
    """Two passes of k-means over all embeddings, ids in order."""
    return clustering.kmeans(_embeddings(spark, d).withColumnRenamed("id", "item"))[0].select(F.col("group").alias("group_id"), F.col("item").alias("vec_id"))


@query(f"{_KM} SELECT g::INT AS group_id, '[' || string_agg(id::VARCHAR, ', ' ORDER BY id) || ']' AS items FROM a2 GROUP BY g")
def group_strings(spark, d):
    """Non-empty groups as text."""
    return clustering.group_strings(clustering.kmeans(_embeddings(spark, d).withColumnRenamed("id", "item"))[0]).select(F.col("group").alias("group_id"), "items")


# dictionary and spelling

_DICT = f"WITH ru AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS r FROM documents), pi AS (SELECT unnest({_split_sql('r')}) AS p FROM ru), di AS (SELECT lower(regexp_replace(regexp_replace(p, '^[0-9]+', ''), '[0-9]+$', '')) AS word, count(*) AS freq FROM pi WHERE length(p) > 2 AND NOT {_ONE_KIND.format(w='p')} AND NOT regexp_full_match(p, '[0-9]+') GROUP BY 1)"
_PB = "pb AS (SELECT prefix, arg_min(word, (-freq, word)) AS best FROM (SELECT word, freq, unnest([substr(word, 1, k) FOR k IN range(1, length(word) + 1)]) AS prefix FROM di WHERE word <> '') GROUP BY prefix)"
_UNK = "un AS (SELECT DISTINCT lower(trim(element)) AS word FROM typed_words WHERE trim(element) <> '' AND lower(trim(element)) NOT IN (SELECT word FROM di))"


def _dictionary(spark, d):
    return dictionary.build_dictionary(_t(spark, d, "documents"))


def _typed(spark, d):
    """All typed values that are not blank, whatever their characters."""
    return _t(spark, d, "typed_words").select(F.lower(F.trim("element")).alias("word")).where("word <> ''").distinct()


@query(f"{_DICT} SELECT word, freq FROM di")
def dictionary_build(spark, d):
    return _dictionary(spark, d)


@query(f"{_DICT} SELECT DISTINCT lower(trim(element)) AS word, lower(trim(element)) IN (SELECT word FROM di) AS known FROM typed_words WHERE trim(element) <> ''")
def dictionary_contains(spark, d):
    return dictionary.contains(_typed(spark, d), _dictionary(spark, d)).select("word", "known")


@query(f"{_DICT} SELECT word, freq FROM di WHERE word >= 'con' AND word < 'coo'")
def dictionary_prefix(spark, d):
    return dictionary.prefixed_by(_dictionary(spark, d), "con")


@query(f"{_DICT}, {_PB}, {_UNK} SELECT un.word, coalesce(a.best, b.best) AS completion FROM un LEFT JOIN pb a ON un.word = a.prefix LEFT JOIN pb b ON substr(un.word, 1, length(un.word) - 1) = b.prefix")
def prefix_completion(spark, d):
    dic = _dictionary(spark, d)
    unknown = dictionary.contains(_typed(spark, d), dic).where("NOT known")
    return spelling.prefix_completions(unknown, dic)


_NEAR = f"""WITH v AS ({_VALUE}), near AS (SELECT w AS word, word AS candidate, freq, damerau_levenshtein(b, word) AS edits FROM v JOIN dictionary ON abs(length(b) - length(word)) <= 2 AND damerau_levenshtein(b, word) <= 2),
 pb AS (SELECT prefix, arg_min(word, (-freq, word)) AS best FROM (SELECT word, freq, unnest([substr(word, 1, k) FOR k IN range(1, length(word) + 1)]) AS prefix FROM dictionary WHERE word <> '') GROUP BY prefix),
 un AS (SELECT v.w AS word, b, {_ONE_KIND.format(w='v.w')} AS bare, coalesce(p.best, q.best) AS completion FROM v LEFT JOIN pb p ON v.w = p.prefix LEFT JOIN pb q ON substr(v.w, 1, length(v.w) - 1) = q.prefix WHERE v.w NOT IN (SELECT word FROM dictionary)),
 e1 AS (SELECT word, arg_min(candidate, (-freq, candidate)) AS c FROM near WHERE edits = 1 GROUP BY word), e2 AS (SELECT word, arg_min(candidate, (-freq, candidate)) AS c FROM near WHERE edits > 0 GROUP BY word),
 won AS (SELECT un.word, un.b, x.c FROM un JOIN (SELECT * FROM e1 UNION ALL SELECT * FROM e2 UNION ALL SELECT word, completion FROM un WHERE completion IS NOT NULL) x ON un.word = x.word WHERE un.bare),
 top AS (SELECT won.word, arg_min(c, (-((1.0::FLOAT - (levenshtein(won.b, c)::DOUBLE / greatest(length(won.b), length(c)))::FLOAT)), -freq, c)) AS c FROM won JOIN dictionary ON c = dictionary.word GROUP BY won.word),
 fix AS (SELECT un.word, coalesce(CASE WHEN bare THEN top.c ELSE completion END, un.word) AS corrected FROM un LEFT JOIN top ON un.word = top.word UNION ALL SELECT w, w FROM v WHERE w IN (SELECT word FROM dictionary))"""


@query(f"{_NEAR} SELECT word, candidate FROM near WHERE edits <= 1")
def spell_edits1(spark, d):
    """Dictionary words up to one edit from each typed value."""
    return spelling.edit_candidates(_typed(spark, d), _t(spark, d, "dictionary")).where("edits = 1").select("word", "candidate")


@query(f"{_NEAR} SELECT word, candidate FROM near")
def spell_edits2(spark, d):
    """Dictionary words up to two edits from each typed value."""
    return spelling.edit_candidates(_typed(spark, d), _t(spark, d, "dictionary")).select("word", "candidate")


@query(f"{_NEAR} SELECT word, corrected FROM fix")
def spell_correct(spark, d):
    """Corrections of all typed values by the dictionary table."""
    return spelling.corrections(_typed(spark, d), _t(spark, d, "dictionary").select("word", "freq"))


@query(f"{_NEAR} SELECT fix.word, CASE WHEN fix.word = corrected OR (1.0::FLOAT - (levenshtein(b, corrected)::DOUBLE / greatest(length(b), length(corrected)))::FLOAT) > 0.3::FLOAT THEN corrected ELSE fix.word END AS corrected FROM fix JOIN v ON fix.word = v.w")
def spell_gated(spark, d):
    """The same, where the correction is similar enough."""
    return spelling.gated_corrections(_typed(spark, d), _t(spark, d, "dictionary").select("word", "freq"))


# search

_BIN = f"{_CLEAN}, po AS (SELECT DISTINCT word, doc_id AS doc, 1.0::DOUBLE AS x FROM cl)"
_KEYS = ("cache", "thread", "latency")
_KSQL = ", ".join(f"'{k}'" for k in _KEYS)


def _keywords(spark, words=_KEYS):
    return spark.createDataFrame([(w,) for w in words], "word string")


@query(f"{_BIN}, m AS (SELECT count(DISTINCT word) AS m FROM po WHERE word IN ({_KSQL})) SELECT DISTINCT word AS term, CASE WHEN m = 0 THEN 'nan'::DOUBLE WHEN word IN ({_KSQL}) THEN round(1.0::DOUBLE / m, 6) ELSE 0.0::DOUBLE END AS weight FROM po, m")
def query_vector(spark, d):
    return search.query_vector(_keywords(spark), index.create_index(_clean(spark, d)).terms).select("term", F.round("weight", 6).alias("weight"))


_SD = f"{_BIN}, m AS (SELECT count(DISTINCT word) AS m FROM po WHERE word IN ({_KSQL})), h AS (SELECT doc AS item, sum(CASE WHEN word IN ({_KSQL}) THEN x ELSE 0 END) AS hits, sqrt(sum(x * x)) AS nm FROM po GROUP BY doc), sc AS (SELECT item, hits / (sqrt(m) * nm) AS score FROM h, m)"


@query(f"{_SD} SELECT item, round(score, 6) AS score FROM sc WHERE score > 1e-12")
def search_docs_raw(spark, d):
    """Documents like three keywords, on the binary matrix."""
    return search.search_docs(_binary(spark, d), _keywords(spark), "x").select("item", F.round("score", 6).alias("score"))


@query(f"{_SD} SELECT item, round(score, 6) AS score FROM sc WHERE score > 1e-12 ORDER BY sc.score DESC, item DESC LIMIT 20")
def search_docs_top20(spark, d):
    return search.result(search.search_docs(_binary(spark, d), _keywords(spark), "x"), 20).select("item", F.round("score", 6).alias("score"))


@query(f"{_BIN}, m AS (SELECT count(DISTINCT doc) AS m FROM po WHERE doc % 50 = 0), h AS (SELECT word AS item, sum(CASE WHEN doc % 50 = 0 THEN x ELSE 0 END) AS hits, sqrt(sum(x * x)) AS nm FROM po GROUP BY word) SELECT item, round(hits / (sqrt(m) * nm), 6) AS score FROM h, m WHERE hits / (sqrt(m) * nm) > 1e-12")
def search_words_raw(spark, d):
    """Words like every 50th document."""
    docs = _t(spark, d, "documents").where("doc_id % 50 = 0").select("doc_id")
    return search.search_words(_binary(spark, d), docs, "x").select("item", F.round("score", 6).alias("score"))


@query(f"{_BIN} SELECT DISTINCT doc AS item, 'nan'::DOUBLE AS score FROM po")
def search_no_match(spark, d):
    """A keyword that matches nothing returns everything with NaN."""
    return search.search_docs(_binary(spark, d), _keywords(spark, ("zzzz",)), "x")


# latent semantic space of the ranked words


def _selected(spark, d) -> index.Index:
    return select.selected_index(select.counted(_clean(spark, d))[1])[1]


@query()
def lsi_matrix(spark, d):
    return _selected(spark, d).lsi.select("word", "doc", F.round("w", 6).alias("w"))


@query()
def lsi_older_variant(spark, d):
    return lsi.lsi_older(_selected(spark, d).postings).select("word", "doc", F.round("x", 6).alias("x"))


@query()
def search_docs_lsi(spark, d):
    return search.search_docs(_selected(spark, d).lsi, _keywords(spark)).select("item", F.round("score", 6).alias("score"))


@query()
def search_words_lsi(spark, d):
    docs = _t(spark, d, "documents").where("doc_id % 50 = 0").select("doc_id")
    return search.search_words(_selected(spark, d).lsi, docs).select("item", F.round("score", 6).alias("score"))


@query()
def word_groups(spark, d):
    return select.group_words(_selected(spark, d)).select(F.col("group").alias("group_id"), F.col("item").alias("word"))


@query()
def doc_groups(spark, d):
    return select.group_docs(_selected(spark, d))[0].select(F.col("group").alias("group_id"), F.col("item").alias("doc_id"))


# Java sources


@query()
def java_identifiers(spark, d):
    """Identifiers within the methods of all Java files."""
    return javalex.java_identifiers(_java(spark, d)).where("method IS NOT NULL").select("source_name", "pos", "package", "type", "method", "is_ctor", "identifier")


@query("SELECT count(*) AS total FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)")
def token_total(spark, d):
    return counting.token_total(_words(spark, d))


@query()
def java_words(spark, d):
    """Counted words of the Java files."""
    return select.flatten_words(select.extract(_java(spark, d)))


@query()
def java_select(spark, d):
    """Ranked words of the Java files, corrected by the dictionary."""
    words = select.extract(_java(spark, d), _t(spark, d, "dictionary").select("word", "freq"))
    return select.weighted_words(words, select.clamp(100)).select("word", F.round("score", 6).alias("score"))


@query()
def java_subtree(spark, d):
    """Identifiers of the sub-trees of methods called trim."""
    return corpus.scan_subtree(_java(spark, d), method="trim").groupBy("type", "identifier").agg(F.count("*").alias("n"))
