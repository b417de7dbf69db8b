"""Registered queries of the engine, each with DuckDB SQL for the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as A
from . import constants as K
from .functions import cleaning, detect, scoring
from .functions import compat as C
from .operators import adaptive, hierarchy, layout, lines, records, segment, similar, stats
from .plans.questions import parse_questions, raw_questions
from .sources import files as files_
from .sources.sinks import csv_rows, hierarchy_csv_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, and its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# SQL fragments that restate the dialect

_WS = r"\t-\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


def _fix(x: str) -> str:
    x = f"nfc_normalize({x})"
    for a, b in K.ENCODING_FIXES + K.NORMALIZATIONS:
        x = f"replace({x}, {'chr(0)' if a == chr(0) else _q(a)}, {_q(b)})"
    x = rf"regexp_replace({x}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', ' ', 'g')"
    return rf"regexp_replace(regexp_replace({x}, '\n{{3,}}', chr(10), 'g'), '[ \t]{{2,}}', ' ', 'g')"


def _clean(x: str) -> str:
    x = rf"regexp_replace({_fix(x)}, '\x{{3000}}{{2,}}', '　', 'g')"
    x = f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: {_trim('l')}), lambda l: l <> ''), chr(10))"
    return f"translate(translate({x}, '～·（）', '〜・()'), {_q(K.FULL_DIGITS)}, {_q(K.HALF_DIGITS)})"


def _count(x: str, word: str) -> str:
    return f"((length({x}) - length(replace({x}, {_q(word)}, ''))) // {len(word)})"


def _literal(v) -> str:
    return "NULL" if v is None else _q(v).replace("\n", "' || chr(10) || '") if isinstance(v, str) else str(v)


def _values(name: str, rows: list[tuple], columns: str) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows) + ")"


def _spread(rows: list[str]):
    """Texts for detectors, a row a part: one of the given in turn, every other round with the part's name behind it. The
    DataFrame (id, s) and its SQL as table t."""
    n = len(rows)
    pick = "[" + ", ".join(_literal(s) for s in rows) + f"][(p_partkey % {n})::INT + 1]"

    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = F.col("p_partkey")
        text = F.element_at(F.array(*map(F.lit, rows)), (key % n + 1).cast("int"))
        name = F.when(F.floor(key / n) % 2 == 1, F.concat(F.lit(" "), "p_name")).otherwise("")
        return A.table(spark, sf_dir, "part").select(key.alias("id"), F.concat(text, name).alias("s"))

    return make, f"t AS (SELECT p_partkey AS id, {pick} || CASE WHEN (p_partkey // {n}) % 2 = 1 THEN ' ' || p_name ELSE '' END AS s FROM part)"


# lines

_LINES = f"l0 AS (SELECT doc_id, unnest(list_transform(regexp_split_to_array(text, '\\n+'), lambda x, i: {{'i': i - 1, 'l': {_trim('x')}}})) AS u FROM documents), l1 AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY u.i) - 1 AS line_no, u.l AS raw FROM l0 WHERE u.l <> ''), l AS (SELECT doc_id, line_no, {_clean('raw')} AS line FROM l1)"


@query(f"WITH {_LINES} SELECT doc_id, line_no::INT AS line_no, line FROM l")
def document_lines(spark, sf_dir):
    return lines.split_lines(A.doc_texts(spark, sf_dir))


_MERGED = "m0 AS (SELECT *, (length(line) >= 20 OR regexp_matches(line, '^[0-9]{4,6}|[×〇○]$'))::INT AS keep FROM l), m1 AS (SELECT *, coalesce(sum(keep) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS g FROM m0)"


@query(f"WITH {_LINES}, {_MERGED} SELECT doc_id, g AS line_no, string_agg(line, ' ' ORDER BY line_no) AS line FROM m1 GROUP BY doc_id, g")
def merged_lines(spark, sf_dir):
    return lines.preprocess(A.doc_texts(spark, sf_dir))


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE length(line) < 3 OR regexp_matches(line, '^[0-9]+$') OR regexp_matches(line, '^[・●○▲△□■◆\\-=]+$') OR regexp_matches(line, '^(ページ|Page|[0-9]+/[0-9]+|第[0-9]+章)')) AS n_ignorable FROM l GROUP BY doc_id")
def ignorable_lines(spark, sf_dir):
    rows = lines.split_lines(A.doc_texts(spark, sf_dir))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(detect.is_ignorable(F.col("line"))).alias("n_ignorable"))


# cleaning

@query(f"SELECT doc_id, {_clean('text')} AS cleaned FROM documents")
def clean_documents(spark, sf_dir):
    return A.doc_texts(spark, sf_dir).select("doc_id", cleaning.clean(F.col("text")).alias("cleaned"))


_AWKWARD, _AWKWARD_SQL = _spread(["Ａ？B?  （１２）～○\x01x\n\n\n\n　　　　y·z", "···", "・・・???a", "　 全角　　空白　\t ", "問1．次の記述のうち正しいものはどれか。\n・短い\nこの行は二十文字以上の長さがあるので別の行になる", "解説：これは理由の説明です", "※注意 これは補足", "", "が\n\n３行目", "第12問 本文\n●箇条書きの長い行がここに続いて二十文字を超えます\n短い行"])


@query(f"WITH {_AWKWARD_SQL} SELECT id, {_clean('s')} AS once, {_clean(_clean('s'))} AS twice FROM t")
def clean_awkward(spark, sf_dir):
    s = F.col("s")
    return _AWKWARD(spark, sf_dir).select("id", cleaning.clean(s).alias("once"), cleaning.clean(cleaning.clean(s), normalise=False).alias("twice"))


_C3_LINES = rf"string_split(regexp_replace(regexp_replace({_clean('s')}, '(?m)^(?:問題?|第|Q|No\.?|【|〔|\()?([0-9]+)(?:問|】|〕|\)|\.|[{_WS}])?[{_WS}]*', '', 'g'), '(?m)^[{_WS}]*[・●○▲△□■◆]+[{_WS}]*', '', 'g'), chr(10))"


@query(f"""WITH {_AWKWARD_SQL}, p AS (SELECT id, {_C3_LINES} AS all_lines, s FROM t), c AS (SELECT *, list_filter(all_lines, lambda x: {_trim('x')} <> '') AS ls FROM p)
SELECT id, {_trim("CASE WHEN len(ls) > 1 THEN list_reduce(ls, lambda a, x: CASE WHEN length(x) < 20 THEN a || x ELSE a || ' ' || x END) ELSE array_to_string(all_lines, chr(10)) END")} AS question,
{_trim(f"regexp_replace(regexp_replace({_clean('s')}, '^(?:解説|説明|補足|理由|根拠)[:：]?[{_WS}]*', ''), '^[{_WS}]*[※注意]', '')")} AS explanation FROM c""")
def clean_parts(spark, sf_dir):
    s = F.col("s")
    return _AWKWARD(spark, sf_dir).select("id", cleaning.clean_question(s).alias("question"), cleaning.clean_explanation(s).alias("explanation"))


@query(r"""WITH c AS (SELECT doc_id, unnest(list_transform(string_split(text, ''), lambda x, i: {'c': x, 'i': i})) AS u FROM documents WHERE text <> ''),
g AS (SELECT doc_id, u.c AS c, u.i - row_number() OVER (PARTITION BY doc_id, u.c ORDER BY u.i) AS k FROM c WHERE u.c <> chr(10) AND u.c <> chr(13)),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM g GROUP BY doc_id, c, k HAVING count(*) >= 5) GROUP BY doc_id),
s AS (SELECT doc_id, text, length(text) AS n_chars, length(text) - length(replace(replace(text, '?', ''), chr(65533), '')) AS garbled, length(text) - length(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')) AS controls, (length(text) - length(regexp_replace(text, '[あ-んア-ヶ一-龠]', '', 'g'))) / length(text) AS jr FROM documents)
SELECT doc_id, greatest(0, least(100, 100 - (CASE WHEN n_chars < 10 THEN 30 ELSE 0 END) - garbled * 5 - controls * 3 - (CASE WHEN jr < 0.3 THEN 20 ELSE 0 END) - coalesce(n, 0) * 10))::INT AS score, garbled::INT AS garbled, coalesce(n, 0)::INT AS repeats, n_chars::INT AS n_chars FROM s LEFT JOIN r USING (doc_id)""")
def text_quality(spark, sf_dir):
    q = cleaning.text_quality(F.col("text"))
    return A.doc_texts(spark, sf_dir).select("doc_id", q["score"].alias("score"), q["garbled"].alias("garbled"), q["repeats"].alias("repeats"), q["n_chars"].alias("n_chars"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 50 THEN text ELSE substr(text, 1, 49) || '…' END AS excerpt,
replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#039;') AS html,
CASE WHEN contains(text, '"') OR contains(text, ',') OR contains(text, chr(10)) THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS csv,
least(greatest(n_chars, 100), 1000) AS clamped, (doc_id // 7)::INT AS chunk FROM documents""")
def text_scalars(spark, sf_dir):
    t = F.col("text")
    docs = A.table(spark, sf_dir, "documents")
    return docs.select("doc_id", cleaning.truncate(t, 50).alias("excerpt"), cleaning.escape_html(t).alias("html"), cleaning.escape_csv(t).alias("csv"), cleaning.clamp(F.col("n_chars"), 100, 1000).cast("long").alias("clamped"), cleaning.chunk_of(F.col("doc_id"), 7).alias("chunk"))


@query("""WITH u AS (SELECT doc_id, b, CASE WHEN b >= 1099511627776 THEN 4 WHEN b >= 1073741824 THEN 3 WHEN b >= 1048576 THEN 2 WHEN b >= 1024 THEN 1 ELSE 0 END AS i FROM (SELECT doc_id, (CASE WHEN doc_id % 6 = 5 THEN 0 ELSE n_chars * (1024 ** (doc_id % 6))::BIGINT END)::BIGINT AS b FROM documents))
SELECT doc_id, b AS bytes, CASE WHEN b = 0 THEN '0 Bytes' ELSE regexp_replace(printf('%.2f', b / pow(1024, i)), '\\.?0+$', '') || ' ' || ['Bytes', 'KB', 'MB', 'GB', 'TB'][i + 1] END AS label, CASE WHEN b = 0 THEN 0 ELSE round(512 * 100.0 / b, 1) END::DOUBLE AS percent FROM u""")
def file_sizes(spark, sf_dir):
    """Documents' lengths as sizes of every unit."""
    k = (F.col("doc_id") % 6).cast("int")
    docs = A.table(spark, sf_dir, "documents").select("doc_id", F.when(k == 5, F.lit(0)).otherwise(F.col("n_chars") * F.pow(F.lit(1024), k).cast("long")).cast("long").alias("bytes"))
    b = F.col("bytes")
    return docs.select("doc_id", "bytes", cleaning.format_file_size(b, to_even=True).alias("label"), cleaning.percentage(F.lit(512), b).alias("percent"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS label, regexp_extract(lower(o_orderpriority || '.Old.PDF'), '\\.([^.]+)$', 1) AS extension FROM orders")
def formatted_dates(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select("o_orderkey", cleaning.format_date(F.col("o_orderdate")).alias("label"), cleaning.file_extension(F.concat("o_orderpriority", F.lit(".Old.PDF"))).alias("extension"))


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)), 6) AS similarity
FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey
WHERE 1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)) >= 0.5""")
def similar_names(spark, sf_dir):
    """Edit distance inside blocks of equal type, size and brand."""
    p = A.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size", "p_brand")
    a, b = p.alias("a"), p.alias("b")
    near = cleaning.similarity(F.col("a.p_name"), F.col("b.p_name"))
    keys = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("p_type", "p_size", "p_brand")]
    rows = a.join(b, [*keys, F.col("a.p_partkey") < F.col("b.p_partkey")])
    return rows.where(near >= 0.5).select(F.col("a.p_partkey").alias("a"), F.col("b.p_partkey").alias("b"), F.round(near, 6).alias("similarity"))


@query("""WITH n AS (SELECT p_name || ' ' || p_type AS s, min(p_partkey) AS class_id, count(*) AS c FROM part GROUP BY s),
l AS (SELECT a.s AS s, sum(b.c) AS c FROM n a JOIN n b ON a.s <> b.s AND 100 * levenshtein(a.s, b.s) <= 20 * greatest(length(a.s), length(b.s)) GROUP BY a.s)
SELECT p_partkey, class_id, (n.c - 1 + coalesce(l.c, 0))::BIGINT AS n_links FROM part JOIN n ON p_name || ' ' || p_type = n.s LEFT JOIN l USING (s)""")
def near_names(spark, sf_dir):
    """Names and types alike to 80 percent, without any block: one row a part."""
    rows = A.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("name"))
    return similar.links(rows, "p_partkey", "name", 80)


# files and pages

_PAGE_FILES = "t AS (SELECT page_id, 'page' || page_id || ['.pdf', '.PDF', '.txt', '', '.pdf.exe'][(page_id % 5)::INT + 1] AS name, [NULL, 'application/pdf', 'text/plain'][(page_id % 3)::INT + 1] AS mime, (strlen(html) * 10000 * (page_id % 7))::BIGINT AS size FROM pages)"


def _page_files(spark, sf_dir):
    """Pages as files of several names, types and sizes, some beyond the limit."""
    key = F.col("page_id")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))
    return A.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("page"), key.cast("string"), pick([".pdf", ".PDF", ".txt", "", ".pdf.exe"])).alias("name"), pick([None, "application/pdf", "text/plain"]).alias("mime"), (F.octet_length("html") * 10000 * (key % 7)).cast("long").alias("size"))


@query(f"WITH {_PAGE_FILES} SELECT name, coalesce(mime = 'application/pdf', false) OR lower(name) LIKE '%.pdf' AS is_pdf, size <= 104857600 AS small_enough FROM t")
def file_validation(spark, sf_dir):
    return _page_files(spark, sf_dir).select("name", files_.is_pdf(F.col("name"), F.col("mime")).alias("is_pdf"), files_.is_small_enough(F.col("size")).alias("small_enough"))


@query(f"WITH {_PAGE_FILES}, v AS (SELECT * FROM t WHERE (coalesce(mime = 'application/pdf', false) OR lower(name) LIKE '%.pdf') AND size <= 104857600) SELECT count(*) AS files, sum(size)::BIGINT AS bytes, count(*) > 0 AND sum(size) <= count(*) * 104857600 AS valid FROM v")
def file_manifest(spark, sf_dir):
    new = _page_files(spark, sf_dir)
    return files_.check_inputs(files_.add_files(new.limit(0).withColumn("id", F.lit("")), new))


@query("SELECT p_partkey AS id, p_name AS name FROM part WHERE p_size > 25")
def remaining_files(spark, sf_dir):
    """A manifest without the files named for removal."""
    manifest = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), "p_size")
    return files_.remove_files(manifest, manifest.where("p_size <= 25")).select("id", "name")


def _pages(spark, sf_dir):
    t = A.table(spark, sf_dir, "conversations")
    ok = F.col("turn") % 7 != 6
    return t.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), ok.alias("success"), F.when(ok, F.col("text")).alias("text"), F.when(~ok, F.lit("page failed")).alias("error"))


_DOCS = f"p AS (SELECT conv_id AS doc_id, turn, turn % 7 <> 6 AS success, text FROM conversations), d0 AS (SELECT doc_id, coalesce(string_agg(text || chr(10) || chr(10), '' ORDER BY turn) FILTER (WHERE success), '') AS raw_text, count(*) AS page_count, bool_or(success) AS success, max(CASE WHEN NOT success THEN 'page failed' END) AS error FROM p GROUP BY doc_id), d AS (SELECT *, {_clean('raw_text')} AS text FROM d0)"


@query(f"WITH {_DOCS} SELECT doc_id, raw_text, text, page_count FROM d")
def assembled_pages(spark, sf_dir):
    return files_.assemble(_pages(spark, sf_dir))


_RESULTS = f"{_DOCS}, f AS (SELECT doc_id, success, page_count, length(text) AS text_length, CASE WHEN text = '' THEN 0 ELSE greatest(0, 100 - (CASE WHEN length(text) < 10 THEN 30 ELSE 0 END) - 20 - 10 * 0) END AS q0, text FROM d)"


@query(f"WITH {_RESULTS} SELECT count(*) AS total_files, count(*) FILTER (WHERE success) AS successful_files, count(*) FILTER (WHERE NOT success) AS failed_files, coalesce(sum(page_count) FILTER (WHERE success), 0)::BIGINT AS total_pages, coalesce(sum(text_length) FILTER (WHERE success), 0)::BIGINT AS total_text_length FROM f")
def extraction_totals(spark, sf_dir):
    return stats.extraction_stats(files_.file_results(_pages(spark, sf_dir))).select("total_files", "successful_files", "failed_files", "total_pages", "total_text_length")


_ISSUES = rf"list_filter([CASE WHEN length(text) < 10 THEN 'テキストが短すぎる' END, CASE WHEN (length(text) - length(regexp_replace(text, '[あ-んア-ヶ一-龠]', '', 'g'))) / length(text) < 0.3 THEN '日本語文字の比率が低い' END, '連続する同じ文字: ' || runs], lambda x: x IS NOT NULL)"
_RUNS_OF = "ch AS (SELECT doc_id, unnest(list_transform(string_split(text, ''), lambda x, i: {'c': x, 'i': i})) AS u FROM f WHERE text <> ''), gr AS (SELECT doc_id, u.c AS c, u.i AS i, u.i - row_number() OVER (PARTITION BY doc_id, u.c ORDER BY u.i) AS k FROM ch WHERE u.c <> chr(10) AND u.c <> chr(13)), ru AS (SELECT doc_id, string_agg(repeat(c, n::INT), ', ' ORDER BY i) AS runs FROM (SELECT doc_id, c, count(*) AS n, min(i) AS i FROM gr GROUP BY doc_id, c, k HAVING count(*) >= 5) GROUP BY doc_id)"


@query(f"WITH {_RESULTS}, {_RUNS_OF}, e AS (SELECT doc_id, CASE WHEN NOT success THEN 'page failed' WHEN text = '' THEN 'テキストが空' ELSE array_to_string({_ISSUES}, ' / ') END AS issues FROM f LEFT JOIN ru USING (doc_id)) SELECT * FROM e WHERE issues <> ''")
def extraction_issues(spark, sf_dir):
    """Issues of conversations as files; cleaned text holds no garbled or control characters."""
    found = stats.extraction_issues(files_.file_results(_pages(spark, sf_dir)))
    return found.select("doc_id", F.array_join("issues", " / ").alias("issues"))


@query(f"WITH {_RESULTS} SELECT 'simple' AS method, count(*) AS n FROM f WHERE success")
def extraction_methods(spark, sf_dir):
    return stats.histogram(files_.file_results(_pages(spark, sf_dir)).where("success"), "method", "unknown")


@query(f"""WITH {_RESULTS}, {_RUNS_OF}, n AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM gr GROUP BY doc_id, c, k HAVING count(*) >= 5) GROUP BY doc_id), b AS (SELECT conv_id AS doc_id, sum(strlen(text))::BIGINT AS size FROM conversations GROUP BY conv_id),
o AS (SELECT doc_id, (length(text) - length(regexp_replace(text, '[あ-んア-ヶ一-龠]', '', 'g'))) / length(text) < 0.3 AS foreign_text FROM f WHERE text <> '')
SELECT 'conversation ' || doc_id || '.pdf' AS name, CASE WHEN size >= 1024 THEN regexp_replace(printf('%.2f', size / 1024), '\\.?0+$', '') || ' KB' ELSE size || ' Bytes' END AS size, f.success, f.page_count, length(text)::INT AS text_length,
CASE WHEN text = '' THEN 0 ELSE greatest(0, 100 - CASE WHEN length(text) < 10 THEN 30 ELSE 0 END - CASE WHEN foreign_text THEN 20 ELSE 0 END - 10 * coalesce(n, 0)) END::DOUBLE AS quality, 'simple' AS method, 0.0::DOUBLE AS processing_time,
CASE WHEN text = '' THEN 'テキストが空' ELSE array_to_string({_ISSUES}, ' / ') END AS issues, CASE WHEN NOT f.success THEN d.error END AS error FROM f JOIN (SELECT doc_id, error FROM d) d USING (doc_id) JOIN b USING (doc_id) LEFT JOIN n USING (doc_id) LEFT JOIN o USING (doc_id) LEFT JOIN ru USING (doc_id)""")
def extraction_debug(spark, sf_dir):
    """All fields of a file in the debug report; conversations are the files."""
    name = F.concat(F.lit("conversation "), F.col("conv_id").cast("string"), F.lit(".pdf"))
    manifest = A.table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id"), name.alias("name")).agg(F.sum(F.octet_length("text")).alias("size"))
    shown, _ = stats.debug_info(files_.file_results(_pages(spark, sf_dir)), manifest, to_even=True)
    return shown.withColumn("issues", F.array_join("issues", " / "))


@query("SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 AND trim(text) <> '' THEN text END, CASE WHEN doc_id % 3 = 1 AND trim(lang) <> '' THEN lang END, CASE WHEN doc_id % 6 <> 5 THEN source END) AS text FROM documents")
def first_text(spark, sf_dir):
    """A text, else blanks or a language, else a source or nothing."""
    k = F.col("doc_id") % 3
    chain = [F.when(k == 0, F.col("text")).when(k == 1, F.lit(" ")), F.when(k == 1, F.col("lang")).otherwise(F.lit("")), F.when(F.col("doc_id") % 6 != 5, F.col("source"))]
    return A.table(spark, sf_dir, "documents").select("doc_id", files_.first_text(*chain).alias("text"))


# layout

_ITEMS = r"i0 AS (SELECT doc_id, u.i - 1 AS line_no, u.l AS line FROM (SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x, i: {'i': i, 'l': x})) AS u FROM documents)), i1 AS (SELECT doc_id, line_no, unnest(list_transform(string_split(line, ' '), lambda x, i: {'i': i - 1, 'w': x})) AS u FROM i0), it AS (SELECT doc_id, 1 AS page_no, line_no, u.i AS word_no, u.w AS str, 42.0 * u.i AS x, 800 - 14 * line_no AS y, CASE WHEN line_no % 5 = 0 THEN 14 ELSE 12 END AS font FROM i1)"
_FIXED = f"fx AS (SELECT *, {_fix('str')} AS t FROM it WHERE {_trim('str')} <> '')"


@query(f"WITH {_ITEMS}, {_FIXED} SELECT doc_id, page_no, string_agg(t, ' ' ORDER BY line_no, word_no) AS text FROM fx WHERE {_trim('t')} <> '' GROUP BY doc_id, page_no")
def layout_simple(spark, sf_dir):
    return layout.text_simple(A.layout_items(spark, sf_dir), normalise=False)


@query(f"""WITH {_ITEMS}, {_FIXED}, c AS (SELECT doc_id, page_no, floor(y / 5.0 + 0.5) * 5 AS gy, floor(x + 0.5) AS gx, string_agg(t, '' ORDER BY line_no, word_no) AS t FROM fx GROUP BY ALL),
r AS (SELECT doc_id, page_no, gy, string_agg(t, ' ' ORDER BY gx) AS t FROM c GROUP BY ALL) SELECT doc_id, page_no, string_agg(t, chr(10) ORDER BY gy DESC) AS text FROM r WHERE {_trim('t')} <> '' GROUP BY doc_id, page_no""")
def layout_structured(spark, sf_dir):
    return layout.text_structured(A.layout_items(spark, sf_dir), normalise=False)


_WIDTH = r"font * (0.5 * length(t) + 0.5 * (length(t) - length(regexp_replace(t, '[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FAF}\x{FF00}-\x{FFEF}]', '', 'g'))))"


@query(f"""WITH {_ITEMS}, {_FIXED}, w AS (SELECT *, {_WIDTH} AS w FROM fx WHERE {_trim('t')} <> ''),
g AS (SELECT *, x - (lag(x) OVER k + 2 * lag(w) OVER k) > font * 0.5 AS gap FROM w WINDOW k AS (PARTITION BY doc_id, line_no ORDER BY word_no)),
r AS (SELECT doc_id, page_no, line_no, string_agg(CASE WHEN coalesce(gap, false) THEN ' ' ELSE '' END || t, '' ORDER BY word_no) AS t FROM g GROUP BY ALL)
SELECT doc_id, page_no, string_agg(t, chr(10) ORDER BY line_no) AS text FROM r GROUP BY doc_id, page_no""")
def layout_improved(spark, sf_dir):
    return layout.text_improved(A.layout_items(spark, sf_dir), normalise=False)


_COMPLEX = f"full_items AS (SELECT * FROM it WHERE {_trim('str')} <> ''), dx AS (SELECT *, abs(x - lag(x) OVER (PARTITION BY doc_id ORDER BY line_no, word_no)) AS dx FROM full_items), cy AS (SELECT doc_id, page_no, count(*) AS n, count(DISTINCT y) / count(*) AS y_variation, count(DISTINCT font) AS fonts, var_pop(dx) AS dx_variance, avg((length(str) < 3)::INT) AS short_ratio FROM dx GROUP BY doc_id, page_no), cx AS (SELECT doc_id, page_no, coalesce(n, 0) AS n_items, y_variation, coalesce(fonts, 0) AS fonts, dx_variance, short_ratio FROM (SELECT DISTINCT doc_id, page_no FROM it) LEFT JOIN cy USING (doc_id, page_no)), sc AS (SELECT *, least(1, CASE WHEN y_variation > 0.1 THEN 0.3 ELSE 0 END + CASE WHEN fonts > 3 THEN 0.2 ELSE 0 END + CASE WHEN dx_variance > 1000 THEN 0.3 ELSE 0 END + CASE WHEN short_ratio > 0.3 THEN 0.2 ELSE 0 END)::DOUBLE AS score FROM cx)"


@query(f"WITH {_ITEMS}, {_COMPLEX} SELECT doc_id, page_no, n_items, fonts, round(y_variation, 6) AS y_variation, round(short_ratio, 6) AS short_ratio, round(score, 6) AS score FROM sc")
def layout_complexity(spark, sf_dir):
    return layout.complexity(A.layout_items(spark, sf_dir)).select("doc_id", "page_no", "n_items", "fonts", *(F.round(c, 6).alias(c) for c in ("y_variation", "short_ratio", "score")))


@query(f"WITH {_ITEMS}, {_COMPLEX} SELECT doc_id, CASE WHEN score > 0.7 THEN 'structured' WHEN score > 0.3 THEN 'improved' ELSE 'simple' END AS mode FROM sc WHERE doc_id IN (SELECT doc_id FROM it WHERE {_trim('str')} <> '')")
def layout_modes(spark, sf_dir):
    return layout.text_adaptive(A.layout_items(spark, sf_dir), normalise=False).select("doc_id", "mode")


@query(f"""WITH {_ITEMS} SELECT doc_id, page_no, line_no::INT AS block_no, coalesce(string_agg({_trim('str')}, ' ' ORDER BY word_no) FILTER (WHERE {_trim('str')} <> ''), '') AS text, min(x)::DOUBLE AS x, min(y)::DOUBLE AS y, (max(x + 6 * length(str)) - min(x))::DOUBLE AS width, count(*) AS item_count FROM it GROUP BY doc_id, page_no, line_no""")
def layout_blocks(spark, sf_dir):
    return layout.blocks(A.layout_items(spark, sf_dir)).select("doc_id", "page_no", F.col("block_no").cast("int").alias("block_no"), "text", "x", "y", "width", "item_count")


# detectors

def _pick(texts, i: str) -> str:
    return "[" + ", ".join(map(_q, texts)) + f"][({i})::INT + 1]"


_BODY = f"({_pick(A.QUIZ_HEADS, 'substr(p_brand, 7)::INT % 4')} || p_name || {_pick(A.QUIZ_TAILS, 'p_size % 3')})"
_OWN = [f"'{text}' || p_type || '{A.QUIZ_CHOICES[1]}'" for text in A.QUIZ_CHOICES[0]]
_FILE = f"p_brand || '/' || (p_partkey // {A.QUIZ_SPAN})"
_MARK = "CASE WHEN p_size % 2 = 1 THEN '〇' ELSE '×' END"


def _quiz_lines(spark, sf_dir):
    return A.quiz_texts(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query(f"SELECT (p_partkey + 10000)::INT AS number, {_BODY} || CASE WHEN p_size % 4 = 0 THEN '' ELSE {_MARK} END AS text, '番号のみ形式' AS pattern FROM part UNION ALL SELECT 1, {_OWN[0]}, '番号のみ形式' FROM part WHERE p_size % 4 = 0 UNION ALL SELECT 2, {_OWN[1]} || {_MARK}, '番号のみ形式' FROM part WHERE p_size % 4 = 0")
def question_numbers(spark, sf_dir):
    found = _quiz_lines(spark, sf_dir).select("doc_id", detect.question_number(F.col("line")).alias("q")).select("doc_id", "q.*")
    n = F.col("number")
    return found.select(F.when(n >= A.QUIZ_FIRST, A.quiz_number(n)).otherwise(n).alias("number"), "text", "pattern")


#: How a line may give its question's number, and the pattern that finds it.
_NUMBER_FORMS = [("問", " ", "標準問題形式"), ("第", "問 ", "第N問形式"), ("", ". ", "番号のみ形式"), ("(", ") ", "括弧番号形式"), ("【", "】", "四角括弧形式"), ("Q", " ", "Q番号形式"), ("", "。", "宅建形式1"), ("", "：", "宅建形式2"), ("12", "", "5桁問題番号"), ("[", "] ", "simple_number"), ("no ", " ", None)]
_NTH = f"(p_partkey % {len(_NUMBER_FORMS)})::INT + 1"


@query(f"""WITH f AS (SELECT p_partkey, {_NTH} AS k, 100 + p_partkey % 900 AS n, p_name || ' of ' || p_type AS body, [{', '.join(_literal(p) for _, _, p in _NUMBER_FORMS)}][{_NTH}] AS pattern FROM part)
SELECT p_partkey, CASE WHEN pattern = '5桁問題番号' THEN ('12' || n)::INT WHEN pattern IS NOT NULL THEN n::INT END AS number, CASE WHEN pattern IS NOT NULL THEN body END AS text, pattern FROM f""")
def question_forms(spark, sf_dir):
    """Numbers in every form that a line may give them in, and none."""
    pick = lambda i: F.element_at(F.array(*(F.lit(f[i]) for f in _NUMBER_FORMS)), (F.col("p_partkey") % len(_NUMBER_FORMS) + 1).cast("int"))
    line = F.concat(pick(0), (F.col("p_partkey") % 900 + 100).cast("string"), pick(1), "p_name", F.lit(" of "), "p_type")
    return A.table(spark, sf_dir, "part").select("p_partkey", detect.question_number(line).alias("q")).select("p_partkey", "q.number", "q.text", "q.pattern")


_MARKS, _MARKS_SQL = _spread(["答え：〇", "解答 ○", "×", " ○ ", "正解:③", "選択肢2が正解である", "文中に○がある", "なし", "A:×", "ANSWER ○", "答 ア", "正しい記述は〇である", "解説：理由はこれ", "ポイント: 大事", "解説：", "根拠 民法"])


@query(rf"""WITH {_MARKS_SQL} SELECT id, coalesce(nullif(regexp_extract(s, '(?i)(?:答え?|解答|正解|A|Answer)[:：]?[{_WS}]*([〇○×])', 1), ''), nullif(regexp_extract(s, '^([〇○×])[{_WS}]*$', 1), ''),
nullif(regexp_extract(s, '(?:答え?|解答|正解)[:：]?[{_WS}]*([①②③④⑤1-5アイウエオ])', 1), ''), nullif(regexp_extract(s, '([〇○×①②③④⑤1-5])[{_WS}]*(?:が正解|が正しい|が誤り)', 1), ''), replace(nullif(regexp_extract(s, '([〇○×])', 1), ''), '○', '〇')) AS answer,
coalesce(nullif({_trim(f"regexp_extract(s, '^(?:解説|説明|補足|理由|根拠)[:：]?[{_WS}]*(.+)', 1)")}, ''), nullif({_trim(f"regexp_extract(s, '^(?:ポイント|要点)[:：]?[{_WS}]*(.+)', 1)")}, '')) AS explanation,
replace(coalesce(nullif(regexp_extract(s, '^[答回正解][：:]\s*([○×〇])', 1), ''), nullif(regexp_extract(s, '^[答回正解]\s*([○×〇])', 1), ''), nullif(regexp_extract(s, '^([○×〇])\s*$', 1), ''), nullif(regexp_extract(s, '答え?[：:]?\s*([○×〇])', 1), ''), nullif(regexp_extract(s, '正解[：:]?\s*([○×〇])', 1), '')), '○', '〇') AS plain_answer FROM t""")
def answers(spark, sf_dir):
    s = F.col("s")
    return _MARKS(spark, sf_dir).select("id", detect.answer(s).alias("answer"), detect.explanation(s).alias("explanation"), detect.hier_answer(s).alias("plain_answer"))


_CHOICES, _CHOICES_SQL = _spread(["次のうち\n1. 最初の選択肢\n2. 二番目の選択肢\n3. 短い", "次\nア. 権利の移転\nイ. 義務の発生", "1. 一つだけの選択肢", "①甲の場合\n続きの行\n②乙の場合", "(1) 括弧の一番\n(2) 括弧の二番", "なし", "1. ab\n2. cd"])


_FORMS = rf"""w AS (SELECT id, s, unnest([('数字選択肢', '[1-9]\.', 1), ('アイウエ選択肢', '[アイウエオカキクケコ]\.', 2)]::STRUCT(n VARCHAR, p VARCHAR, k INT)[]) AS f FROM t),
h AS (SELECT id, f.k AS k, f.n AS format, regexp_extract_all(s, '(?m)^' || f.p || '[{_WS}]*.+$', 0) AS whole, regexp_extract_all(s, '(?m)^' || f.p || '[{_WS}]*(.+)$', 1) AS body FROM w),
g AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY k) AS nth FROM h WHERE len(whole) >= 2 AND len(list_filter(body, lambda b: length({_trim('b')}) > 3)) > 0)"""


@query(rf"""WITH {_CHOICES_SQL}, {_FORMS}
SELECT id, format, u.number AS number, u.body AS text FROM (SELECT id, format, unnest(list_filter(list_transform(whole, lambda x, i: {{'number': substr(x, 1, 1), 'body': {_trim('body[i]')}}}), lambda r: length(r.body) > 3)) AS u FROM g WHERE nth = 1)""")
def choices(spark, sf_dir):
    rows = _CHOICES(spark, sf_dir).select("id", F.explode(detect.choices(F.col("s"))).alias("c"))
    return rows.select("id", "c.format", "c.number", "c.text")


@query(rf"""WITH {_CHOICES_SQL}, {_FORMS}, k AS (SELECT id, list_filter(list_transform(body, lambda b: length({_trim('b')})), lambda n: n > 3) AS n FROM g WHERE nth = 1), c AS (SELECT id, coalesce(n, []) AS n FROM t LEFT JOIN k USING (id))
SELECT id, CASE WHEN len(n) = 0 THEN 0.5 WHEN len(n) = 1 THEN 0.3 WHEN len(n) <= 5 THEN 1.0 ELSE 0.2 END::DOUBLE AS count_score, CASE WHEN len(n) = 0 THEN 0.5 ELSE round(list_sum(list_transform(n, lambda x: CASE WHEN x > 15 THEN 0.8 WHEN x > 5 THEN 0.5 ELSE 0.0 END)) / len(n), 6) END::DOUBLE AS quality_score FROM c""")
def choice_scores(spark, sf_dir):
    c = detect.choices(F.col("s"))
    return _CHOICES(spark, sf_dir).select("id", scoring.choice_count_score(c).alias("count_score"), F.round(scoring.choice_quality_score(c), 6).alias("quality_score"))


_EVERY_FORM = rf"""l AS (SELECT id, u.i AS i, {_trim('u.l')} AS l FROM (SELECT id, unnest(list_transform(string_split(s, chr(10)), lambda x, i: {{'l': x, 'i': i}})) AS u FROM t)),
o AS (SELECT *, nullif(regexp_extract(l, '^([{K.CIRCLED}])[{_WS}]*(.+)', 1), '') AS symbol FROM l WHERE l <> ''),
n AS (SELECT *, count(symbol) OVER (PARTITION BY id ORDER BY i) AS island FROM o),
c AS (SELECT id, 0 AS k, '丸数字選択肢' AS pattern, max(symbol) AS symbol, string_agg(CASE WHEN symbol IS NULL THEN l ELSE regexp_extract(l, '^([{K.CIRCLED}])[{_WS}]*(.+)', 2) END, ' ' ORDER BY i) AS text FROM n WHERE island > 0 GROUP BY id, island),
w AS (SELECT id, s, unnest([('数字選択肢', '^([1-9])\.[{_WS}]*(.+)$', 1), ('アイウエ選択肢', '^([アイウエオカキクケコ])\.[{_WS}]*(.+)$', 2), ('括弧数字選択肢', '^\(([1-9])\)[{_WS}]*(.+)$', 3)]::STRUCT(n VARCHAR, p VARCHAR, k INT)[]) AS f FROM t),
b AS (SELECT id, f.k AS k, f.n AS pattern, unnest(regexp_extract_all(s, '(?m)' || f.p, 1)) AS symbol, unnest(regexp_extract_all(s, '(?m)' || f.p, 2)) AS text FROM w),
a AS (SELECT id, k, pattern, instr('{K.CIRCLED}', symbol) AS number, symbol, text FROM c UNION ALL SELECT id, k, pattern, coalesce(try_cast(symbol AS INT), instr('{K.KATAKANA_NUMBERS}', symbol)), CASE WHEN k = 3 THEN '(' || symbol || ')' ELSE symbol END, {_trim('text')} FROM b)"""


@query(f"WITH {_CHOICES_SQL}, {_EVERY_FORM} SELECT id, number::INT AS number, symbol, text, pattern FROM (SELECT *, min(k) OVER (PARTITION BY id) AS first FROM a) WHERE k = first")
def all_choices(spark, sf_dir):
    rows = _CHOICES(spark, sf_dir).select("id", F.explode(detect.all_choices(F.col("s"))).alias("c"))
    return rows.select("id", "c.number", "c.symbol", "c.text", "c.pattern")


_NAMES, _NAMES_SQL = _spread(["民法_101-150.pdf", "101-150.pdf", "90-120.pdf", "R5_a.pdf", "H29.pdf", "2020.pdf", "2015.pdf", "chapter3.pdf", "令和4年.pdf", "平成30.pdf", "農地法.pdf", "x_1～50.pdf", "none"])
_SECTION_FILE = " ".join(f"WHEN {' OR '.join(f'contains(lower(s), {_q(k)})' for k in w)} THEN {_q(n)}" for n, w, _ in K.SECTIONS)
_RANGE = r"try_cast(nullif(regexp_extract(s, '([0-9]+)[-_～〜]([0-9]+)', {}), '') AS BIGINT)"
_SECTION_RANGE = " ".join(f"WHEN {_RANGE.format(1)} >= {lo} AND {_RANGE.format(2)} <= {hi} THEN {_q(n)}" for n, _, (lo, hi) in K.SECTIONS)


@query(rf"""WITH {_NAMES_SQL} SELECT id, CASE {_SECTION_FILE} {_SECTION_RANGE} END AS section,
coalesce('R' || coalesce(nullif(regexp_extract(s, '[Rr]([0-9]+)|令和([0-9]+)', 1), ''), nullif(regexp_extract(s, '[Rr]([0-9]+)|令和([0-9]+)', 2), ''))::INT, 'H' || coalesce(nullif(regexp_extract(s, '[Hh]([0-9]+)|平成([0-9]+)', 1), ''), nullif(regexp_extract(s, '[Hh]([0-9]+)|平成([0-9]+)', 2), ''))::INT,
CASE WHEN nullif(regexp_extract(s, '20([0-9]{{2}})', 1), '')::INT >= 19 THEN 'R' || (regexp_extract(s, '20([0-9]{{2}})', 1)::INT - 18) END, 'R6') AS year FROM t""")
def file_names(spark, sf_dir):
    s = F.col("s")
    return _NAMES(spark, sf_dir).select("id", detect.section_from_file(s).alias("section"), detect.file_year(s).alias("year"))


@query("""SELECT year(o_orderdate)::INT AS y, CASE WHEN year(o_orderdate) < 2000 THEN NULL WHEN year(o_orderdate) % 100 >= 19 THEN 'R' || (year(o_orderdate) % 100 - 18) ELSE 'H' || (year(o_orderdate) % 100 + 12) END AS era, count(*) AS n FROM orders GROUP BY ALL""")
def order_eras(spark, sf_dir):
    rows = A.table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"))
    return rows.groupBy("y").agg(F.count("*").alias("n")).select("y", detect.line_year(F.col("y").cast("string")).alias("era"), "n")


_SECTIONS_SQL = ", ".join(f"({i}, {_q(n)}, {' + '.join(_count('s', k) for k in w)})" for i, (n, w, _) in enumerate(K.SECTIONS))
_BODIES, _BODIES_SQL = _spread(["民法の契約と免許", "免許の免許", "農地法と契約", "何もない", "固定資産税 農地法", "宅建業 免許 都市計画法 建築基準法 農地法"])


@query(f"WITH {_BODIES_SQL}, c AS (SELECT id, unnest([{_SECTIONS_SQL}]::STRUCT(i INT, n VARCHAR, c INT)[]) AS u FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY u.c DESC, u.i DESC) AS k FROM c) SELECT id, CASE WHEN u.c > 0 THEN u.n ELSE 'その他' END AS section FROM r WHERE k = 1")
def text_sections(spark, sf_dir):
    return _BODIES(spark, sf_dir).select("id", F.coalesce(detect.section_from_text(F.col("s")), F.lit(K.OTHER_SECTION)).alias("section"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 300 BETWEEN 1 AND 100 THEN '権利関係' WHEN o_orderkey % 300 BETWEEN 101 AND 150 THEN '宅建業法' WHEN o_orderkey % 300 BETWEEN 151 AND 200 THEN '法令上の制限' WHEN o_orderkey % 300 BETWEEN 201 AND 250 THEN '税・その他' END AS section FROM orders")
def number_sections(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select("o_orderkey", detect.section_from_number(F.col("o_orderkey") % 300).alias("section"))


_GUESSES, _GUESSES_SQL = _spread(["売主となる契約を締結することができる。", "登記をしてはならないとされ、禁止される。", "不適切で不可能か。", "正しいでしょうか", "適切でない", "必要な義務は有効で無効ではない", ""])
_UP = " + ".join(_count("s", k) for k in K.POSITIVE_KEYWORDS) + " + (contains(s, 'か。') OR contains(s, 'でしょうか') OR contains(s, 'ですか'))::INT"
_DOWN = " + ".join(_count("s", k) for k in K.NEGATIVE_KEYWORDS) + " + contains(s, 'ない')::INT"
_VOTE_UP, _VOTE_DOWN = (" + ".join(f"contains(s, {_q(k)})::INT" for k in w) for w in (K.POSITIVE_KEYWORDS, K.NEGATIVE_KEYWORDS))


@query(f"WITH {_GUESSES_SQL} SELECT id, CASE WHEN {_UP} > {_DOWN} THEN '〇' ELSE '×' END AS guess, CASE WHEN ({_VOTE_UP}) > ({_VOTE_DOWN}) AND ({_VOTE_UP}) >= 2 THEN '〇' WHEN ({_VOTE_DOWN}) > ({_VOTE_UP}) AND ({_VOTE_DOWN}) >= 2 THEN '×' END AS vote FROM t")
def guessed_answers(spark, sf_dir):
    s = F.col("s")
    return _GUESSES(spark, sf_dir).select("id", scoring.guess_answer(s).alias("guess"), detect.keyword_answer(s).alias("vote"))


_VOTE = f"CASE WHEN ({_VOTE_UP}) > ({_VOTE_DOWN}) AND ({_VOTE_UP}) >= 2 THEN '〇' WHEN ({_VOTE_DOWN}) > ({_VOTE_UP}) AND ({_VOTE_DOWN}) >= 2 THEN '×' END"


@query(rf"""WITH {_MARKS_SQL}, m AS (SELECT *, regexp_extract(s, '(?i)(?:答え?|解答|正解|A|Answer)[:：]?[{_WS}]*([〇○×])', 1) AS m1, regexp_extract(s, '^([〇○×])[{_WS}]*$', 1) AS m2, regexp_extract(s, '(?:答え?|解答|正解)[:：]?[{_WS}]*([①②③④⑤1-5アイウエオ])', 1) AS m3 FROM t)
SELECT id, coalesce(replace(nullif(m1, ''), '○', '〇'), replace(nullif(m2, ''), '○', '〇'), CASE WHEN m3 IN ('①', '②', '③', '④', '1', '2', '3', '4', 'ア', 'イ', 'ウ', 'エ') THEN m3 END, {_VOTE}) AS answer,
greatest(1.0, len(list_distinct(list_filter(list_transform(regexp_extract_all(s, '([0-9]+)', 1), lambda x: try_cast(x AS INT)), lambda n: n BETWEEN 1 AND 100))) / 3)::DOUBLE AS estimated FROM m""")
def normalised_answers(spark, sf_dir):
    """Marks normalised for four choices, else the keyword vote; a third of the different numbers found."""
    rows = _MARKS(spark, sf_dir)
    return rows.select("id", detect.best_answer(F.col("s"), F.lit(4)).alias("answer"), adaptive.estimated_count(F.col("s")).alias("estimated"))


# records

_STEPS = lambda n, steps, rest: "CASE " + " ".join(f"WHEN {n} < {k} THEN {v}" for k, v in steps) + f" ELSE {rest} END"
_TEXTS = " ".join(f"WHEN section = '{n}' THEN CASE WHEN answer = '〇' THEN '{yes}' ELSE '{no}' END" for n, (yes, no) in K.EXPLANATIONS.items())
_HINTS = " ".join(f"WHEN contains(s, '{k}') THEN '{v}'" for k, v in K.EXPLANATION_HINTS)
_OWN_CHOICES = f"{_OWN[0]} || '|' || {_OWN[1]}"
#: Records as the rules make them: answer by keywords, section by the file's words, explanation by template, scores by lengths.
_QUIZ = f"""pt AS (SELECT *, {_FILE} AS doc_id, {_BODY} || CASE WHEN p_size % 4 = 0 THEN ' ' || {_OWN[0]} || ' ' || {_OWN[1]} ELSE '' END AS s FROM part),
ct AS (SELECT doc_id, unnest([{_SECTIONS_SQL}]::STRUCT(i INT, n VARCHAR, c INT)[]) AS u FROM (SELECT doc_id, string_agg(s, ' ') AS s FROM pt GROUP BY doc_id)),
sec AS (SELECT doc_id, CASE WHEN u.c > 0 THEN u.n ELSE 'その他' END AS section FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY u.c DESC, u.i DESC) AS k FROM ct) WHERE k = 1),
q AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY p_partkey))::INT AS id, section, 'R5' AS year, (p_partkey + 10000)::INT AS question_number, s AS question, s, CASE WHEN {_UP} > {_DOWN} THEN '〇' ELSE '×' END AS answer, 'R5_' || p_brand || '.pdf' AS source, p_size, p_partkey, p_size % 4 = 0 AS chosen FROM pt JOIN sec USING (doc_id)),
e AS (SELECT *, CASE {_TEXTS} END || CASE {_HINTS} ELSE '' END AS explanation FROM q),
z AS (SELECT *, ({_STEPS('length(question)', [(1, 0.0), (10, 0.1), (20, 0.3), (50, 0.7), (200, 1.0), (500, 0.9)], 0.6)}) * 0.25 + CASE WHEN chosen THEN 1.0 ELSE 0.5 END * 0.2 + CASE WHEN chosen THEN 0.8 ELSE 0.5 END * 0.15 + 0.2 + ({_STEPS('length(explanation)', [(1, 0.0), (10, 0.2), (30, 0.5), (100, 0.8), (300, 1.0)], 0.9)}) * 0.1 + (CASE WHEN question_number <= 100 THEN 0.3 ELSE 0 END + CASE WHEN chosen THEN 0.2 ELSE 0.4 END) * 0.1 AS total FROM e),
s AS (SELECT * EXCLUDE (s), least(greatest(least(greatest(75 * (0.5 + total * 0.5), 75 * 0.7), 75 * 1.3), 0), 95)::DOUBLE AS confidence FROM z)"""


def _quiz(spark, sf_dir):
    return parse_questions(A.quiz_texts(spark, sf_dir)).withColumn("question_number", A.quiz_number(F.col("question_number")))


@query(f"WITH {_QUIZ} SELECT doc_id, id, section, year, question_number, question, answer, source, round(total, 6)::DOUBLE AS total, round(confidence, 6)::DOUBLE AS confidence FROM s")
def quiz_questions(spark, sf_dir):
    return _quiz(spark, sf_dir).select("doc_id", "id", "section", "year", "question_number", "question", "answer", "source", F.round("quality.total_score", 6).alias("total"), F.round("confidence", 6).alias("confidence"))


@query(f"WITH {_QUIZ} SELECT section, count(*) AS total, count(*) FILTER (WHERE answer = '〇') AS correct, round(avg(confidence), 6) AS average_confidence, round(count(*) FILTER (WHERE answer = '〇') * 100.0 / count(*), 1)::DOUBLE AS correct_rate FROM s GROUP BY section")
def quiz_section_report(spark, sf_dir):
    return stats.section_report(_quiz(spark, sf_dir)).withColumn("average_confidence", F.round("average_confidence", 6))


@query(f"SELECT {_FILE} AS doc_id, (p_partkey + 10000)::INT AS question_number, {_BODY} || CASE WHEN p_size % 4 = 0 THEN chr(10) || '1. ' || {_OWN[0]} || chr(10) || '2. ' || {_OWN[1]} ELSE '' END AS question, {_MARK} AS answer, 95.0::DOUBLE AS confidence FROM part")
def quiz_printed_answers(spark, sf_dir):
    return adaptive.answer_anchored(A.quiz_texts(spark, sf_dir)).select("doc_id", A.quiz_number(F.col("question_number")).alias("question_number"), "question", "answer", "confidence")


@query(f"SELECT {_FILE} AS doc_id, (p_partkey + 10000)::INT AS question_number, 'R5' AS year, {_BODY} AS question, {_MARK} AS answer FROM part")
def quiz_complete_records(spark, sf_dir):
    texts = A.quiz_texts(spark, sf_dir).withColumn("text", F.regexp_replace("text", r"(?m)^(\d{5,}) ", "$1 R5 "))
    return adaptive.complete_records(texts).select("doc_id", A.quiz_number(F.col("question_number")).alias("question_number"), "year", "question", "answer")


@query(f"WITH {_QUIZ} SELECT doc_id, count(*) AS total_questions, round(avg(confidence), 6) AS average_confidence, count(*) FILTER (WHERE confidence >= 80) AS high, count(*) FILTER (WHERE confidence >= 50 AND confidence < 80) AS medium, count(*) FILTER (WHERE confidence < 50) AS low, count(*) FILTER (WHERE answer = '〇') AS correct, count(*) FILTER (WHERE answer <> '〇') AS incorrect, count(*) FILTER (WHERE length(explanation) > 10) AS has_explanation, round(avg(length(question)), 6) AS average_question_length FROM s GROUP BY doc_id")
def quiz_parsing_stats(spark, sf_dir):
    out = stats.parsing_stats(_quiz(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("average_confidence", "average_question_length")})


@query(f"WITH {_QUIZ} SELECT count(*) AS total, count(*) FILTER (WHERE answer = '〇') AS correct, count(*) FILTER (WHERE answer = '×') AS incorrect, count(DISTINCT section) AS sections, round(avg(confidence), 6) AS average_confidence, floor(count(*) FILTER (WHERE answer = '〇') / count(*) * 100 + 0.5)::INT AS correct_percent, (SELECT section FROM s GROUP BY section ORDER BY count(*) DESC, min(doc_id) DESC LIMIT 1) AS main_section FROM s")
def quiz_overview(spark, sf_dir):
    return stats.overview(_quiz(spark, sf_dir)).select("total", "correct", "incorrect", "sections", F.round("average_confidence", 6).alias("average_confidence"), "correct_percent", "main_section")


@query(f"WITH {_QUIZ} SELECT section, doc_id, id, question_number, r::INT AS rank, greatest(n - 20, 0) AS overflow FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY doc_id, id) AS r, count(*) OVER (PARTITION BY section) AS n FROM s) WHERE r <= 20")
def quiz_preview(spark, sf_dir):
    return records.preview(_quiz(spark, sf_dir)).select("section", "doc_id", "id", "question_number", "rank", F.col("overflow").cast("long").alias("overflow"))


@query(f"WITH {_QUIZ} SELECT doc_id, id, question_number, section, round(confidence, 6)::DOUBLE AS confidence, CASE WHEN length(question) <= 50 THEN question ELSE substr(question, 1, 49) || '…' END AS excerpt FROM s WHERE confidence < 70 ORDER BY doc_id, id LIMIT 10")
def quiz_attention_list(spark, sf_dir):
    return stats.attention_list(_quiz(spark, sf_dir)).withColumn("confidence", F.round("confidence", 6))


@query(f"WITH p AS (SELECT {_FILE} AS doc_id, count(*) AS n, count(*) FILTER (WHERE p_size % 2 = 1) AS yes FROM part GROUP BY ALL) SELECT doc_id, n AS numbers, n AS answers, 0::BIGINT AS explanations, 0.7::DOUBLE AS reliability, '番号付き問題,○×問題' || CASE WHEN abs(2 * yes - n) / n < 0.3 THEN ',バランス型' ELSE '' END AS formats FROM p")
def quiz_pattern_reliability(spark, sf_dir):
    found = stats.pattern_reliability(raw_questions(A.quiz_texts(spark, sf_dir), answer_aware=True)[0])
    return found.withColumn("reliability", F.round("reliability", 6))


@query(f"""WITH {_QUIZ} SELECT id || ',' || section || ',' || year || ',' || question_number || ',' || question || ',' || answer || ',' || explanation || ',' || source || ',unknown,' || regexp_replace(round(confidence, 2)::VARCHAR, '\\.0$', '') || ',' AS value FROM s""")
def quiz_csv(spark, sf_dir):
    return csv_rows(_quiz(spark, sf_dir).withColumns({"created_at": F.lit(None).cast("timestamp"), "confidence": F.round("confidence", 2)}))


@query()
def document_candidates(spark, sf_dir):
    """Every pattern's score on plain documents and on quiz texts; look-ahead has no SQL here."""
    texts = A.doc_texts(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    found = adaptive.candidates(texts.unionByName(A.quiz_texts(spark, sf_dir).select("doc_id", "text")))
    return found.select("doc_id", "pattern_idx", "matches", "n_valid", F.round("score", 6).alias("score"))


def _fallback_texts(spark, sf_dir):
    p = A.table(spark, sf_dir, "part")
    body = F.concat(F.lit(A.QUIZ_HEAD), "p_name", F.lit(A.QUIZ_TAIL))
    n = F.col("p_partkey") % 999 + 1
    line = F.array(F.concat(F.lit("問"), n.cast("string"), F.lit(" "), body), F.concat(F.lit("答え："), F.when(F.col("p_size") % 2 == 1, "○").otherwise("×")), F.concat(F.lit("解説："), "p_type", F.lit("の説明である")), F.concat(F.lit("補足の本文 "), "p_name"))
    return p.select(A.quiz_file().alias("doc_id"), F.col("p_partkey"), F.posexplode(line).alias("i", "line")).select("doc_id", (F.col("p_partkey") * 4 + F.col("i")).alias("line_no"), "line")


@query(f"""SELECT {_FILE} AS doc_id, (row_number() OVER (PARTITION BY {_FILE} ORDER BY p_partkey))::INT AS id, (p_partkey % 999 + 1)::INT AS question_number, '{A.QUIZ_HEAD}' || p_name || '{A.QUIZ_TAIL}' || '補足の本文 ' || p_name AS question,
CASE WHEN p_size % 2 = 1 THEN '○' ELSE '×' END AS answer, p_type || 'の説明である' AS explanation, 100.0::DOUBLE AS confidence, '標準問題形式' AS pattern FROM part""")
def fallback_records(spark, sf_dir):
    rows = _fallback_texts(spark, sf_dir).withColumn("line", F.regexp_replace("line", "^補足の本文", "本文の補足"))
    out = segment.fallback_questions(rows)
    return out.select("doc_id", "id", "question_number", F.replace("question", F.lit("本文の補足"), F.lit("補足の本文")).alias("question"), "answer", "explanation", "confidence", "pattern")


@query("""WITH l AS (SELECT p_brand AS doc_id, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k, p_name FROM part)
SELECT doc_id, ((k - 1) % 900 + 1)::INT AS question_number, p_name || ' of ' || doc_id || ' ' || 'more about ' || p_name AS question, 30.0::DOUBLE AS confidence FROM l""")
def emergency_records(spark, sf_dir):
    """A brand a file, however many parts it has: numbers begin anew after 900, where a number too short for a record of its own
    ends the text."""
    from pyspark.sql import Window

    p = A.table(spark, sf_dir, "part")
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    n = (F.col("k") - 1) % 900 + 1
    line = F.array_compact(F.array(F.concat(n.cast("string"), F.lit(") "), "p_name", F.lit(" of "), "p_brand"), F.concat(F.lit("more about "), "p_name"), F.lit("答え：×"), F.when(n == 900, F.lit("901)"))))
    rows = p.withColumn("k", k).select(F.col("p_brand").alias("doc_id"), "k", F.posexplode(line).alias("i", "line"))
    out = segment.emergency_questions(rows.select("doc_id", (F.col("k") * 4 + F.col("i")).alias("line_no"), "line"))
    return out.select("doc_id", "question_number", "question", "confidence")


def _kinds(spark, sf_dir):
    """Files of four kinds, a part each: quiz lines, one question by lines, numbers in a foreign language, nothing at all."""
    k, key = F.col("p_partkey") % 4, F.col("p_partkey")
    quiz = F.concat_ws("\n", *(F.concat((key * 3 % 80000 + 10000 + i).cast("string"), F.lit(" 免許を受けた者は、"), "p_name", F.lit(f"について重要な事項の説明をする義務が第{c}項にある。〇")) for i, c in enumerate("一二三", 1)))
    texts = F.when(k == 0, quiz).when(k == 1, F.concat(F.lit("問3 この規定は"), "p_name", F.lit("に有効である\n答え：○\n解説：民法の規定による"))).when(k == 2, F.concat(F.lit("3: short English line on "), "p_name", F.lit("\n(4) another English line\nno number"))).otherwise("nothing at all")
    return A.table(spark, sf_dir, "part").select(key.alias("doc_id"), F.concat(F.lit("f"), key.cast("string"), F.lit(".pdf")).alias("file_name"), texts.alias("text"))


@query(r"""WITH f AS (SELECT p_partkey AS doc_id, p_partkey % 4 AS k, CASE p_partkey % 4 WHEN 0 THEN concat_ws(chr(10), (p_partkey * 3 % 80000 + 10000) || ' 〇', (p_partkey * 3 % 80000 + 10001) || ' 〇', (p_partkey * 3 % 80000 + 10002) || ' 〇') WHEN 1 THEN '問3 この規定は' || p_name || 'に有効である' WHEN 2 THEN '3: short English line on ' || p_name || chr(10) || '(4) another English line' || chr(10) || 'no number' ELSE 'nothing at all' END AS s FROM part)
SELECT doc_id, CASE WHEN k = 2 THEN 'pattern_match' ELSE 'adaptive' END AS method, CASE k WHEN 0 THEN len(regexp_extract_all(s, '[0-9]{5}[^〇×○]*[〇×○]')) WHEN 1 THEN len(regexp_extract_all(s, '^問[0-9]+')) ELSE len(regexp_extract_all(s, '(?m)^(?:[0-9]+[:：]|\([0-9]+\))')) END::BIGINT AS n FROM f WHERE regexp_matches(s, '[0-9]')""")
def orchestration(spark, sf_dir):
    """Which way each file's records are found: the best pattern, else the line parser, else the last resort."""
    return parse_questions(_kinds(spark, sf_dir)).groupBy("doc_id", F.coalesce("extraction_method", F.lit("adaptive")).alias("method")).agg(F.count("*").alias("n"))


# statistics over numbers, answers and records of any table

_NUMBERS = "n AS (SELECT o_custkey AS doc_id, (o_orderkey // 10)::INT AS value FROM orders), g AS (SELECT *, lag(value) OVER (PARTITION BY doc_id ORDER BY value) AS b FROM n)"


def _numbers(spark, sf_dir):
    return A.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.floor(F.col("o_orderkey") / 10).cast("int").alias("value"))


@query(f"WITH {_NUMBERS} SELECT doc_id, b + 1 AS gap_from, value - 1 AS gap_to FROM g WHERE value > b + 1")
def number_gaps(spark, sf_dir):
    return records.number_gaps(_numbers(spark, sf_dir))


@query(f"WITH {_NUMBERS} SELECT doc_id, min(value) AS min, max(value) AS max, max(value) - min(value) + 1 AS range, count(*) AS count, count(*) = count(DISTINCT value) AND count(*) = max(value) - min(value) + 1 AS sequential, count(*) FILTER (WHERE value > b + 1) AS n_gaps, round(count(*) / (max(value) - min(value) + 1), 6) AS completeness FROM g GROUP BY doc_id")
def number_distribution(spark, sf_dir):
    return stats.number_distribution(_numbers(spark, sf_dir)).withColumn("completeness", F.round("completeness", 6))


@query("WITH a AS (SELECT l_suppkey AS doc_id, CASE l_returnflag WHEN 'A' THEN '〇' WHEN 'R' THEN '×' ELSE '①' END AS v FROM lineitem) SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE v = '〇') AS correct, count(*) FILTER (WHERE v = '×') AS incorrect, round(count(*) FILTER (WHERE v = '〇') / count(*), 6) AS correct_ratio, round(count(*) FILTER (WHERE v = '×') / count(*), 6) AS incorrect_ratio, abs(count(*) FILTER (WHERE v = '〇') - count(*) FILTER (WHERE v = '×')) / count(*) < 0.3 AS balanced FROM a GROUP BY doc_id")
def answer_distribution(spark, sf_dir):
    rows = A.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.when(F.col("l_returnflag") == "A", "〇").when(F.col("l_returnflag") == "R", "×").otherwise("①").alias("value"))
    return stats.answer_distribution(rows).withColumns({c: F.round(c, 6) for c in ("correct_ratio", "incorrect_ratio")})


def _document_records(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    return d.select(F.col("source").alias("doc_id"), F.col("doc_id").alias("id"), F.col("lang").alias("section"), (F.col("n_chars") % 5).cast("int").alias("question_number"), F.col("text").alias("question"), F.when(F.col("n_chars") % 2 == 0, "〇").otherwise("×").alias("answer"), F.lit("").alias("explanation"), (F.col("n_chars") % 101).cast("double").alias("confidence"))


_RECORDS = "d AS (SELECT source AS doc_id, doc_id AS id, lang AS section, (n_chars % 5)::INT AS question_number, text AS question, CASE WHEN n_chars % 2 = 0 THEN '〇' ELSE '×' END AS answer, (n_chars % 101)::DOUBLE AS confidence FROM documents)"


@query(f"WITH {_RECORDS} SELECT doc_id, question_number, id FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, question_number, substr(question, 1, 50) ORDER BY id) AS k FROM d) WHERE k = 1")
def deduplicated_records(spark, sf_dir):
    return records.dedup_questions(_document_records(spark, sf_dir)).select("doc_id", "question_number", "id")


@query(f"WITH {_RECORDS} SELECT section, doc_id, id, r::INT AS rank, greatest(n - 20, 0) AS overflow FROM (SELECT *, row_number() OVER (PARTITION BY section ORDER BY doc_id, id) AS r, count(*) OVER (PARTITION BY section) AS n FROM d) WHERE r <= 20")
def section_preview(spark, sf_dir):
    return records.preview(_document_records(spark, sf_dir)).select("section", "doc_id", "id", "rank", F.col("overflow").cast("long").alias("overflow"))


@query(f"WITH {_RECORDS} SELECT section, count(*) AS total, count(*) FILTER (WHERE answer = '〇') AS correct, round(avg(confidence), 6) AS average_confidence, round(count(*) FILTER (WHERE answer = '〇') * 100.0 / count(*), 1)::DOUBLE AS correct_rate FROM d GROUP BY section")
def section_report(spark, sf_dir):
    return stats.section_report(_document_records(spark, sf_dir)).withColumn("average_confidence", F.round("average_confidence", 6))


@query(f"WITH {_RECORDS} SELECT count(*) AS total, count(*) FILTER (WHERE answer = '〇') AS correct, count(*) FILTER (WHERE answer = '×') AS incorrect, round(sum(confidence) / count(*), 1) AS average_confidence, count(*) FILTER (WHERE confidence < 70) AS attention, greatest(count(*) FILTER (WHERE confidence < 70) - 10, 0) AS not_listed FROM d")
def report_totals(spark, sf_dir):
    return stats.report_totals(_document_records(spark, sf_dir))


@query(f"WITH {_RECORDS}, i AS (SELECT doc_id, question_number, unnest([CASE WHEN confidence < 50 THEN '問' || question_number || ': 信頼度が低い (' || confidence::INT || '%)' END, CASE WHEN length(question) < 20 THEN '問' || question_number || ': 問題文が短い' END]) AS issue FROM d) SELECT * FROM i WHERE issue IS NOT NULL")
def record_issues(spark, sf_dir):
    return stats.quality_issues(_document_records(spark, sf_dir))


@query(f"WITH {_RECORDS} SELECT count(*) AS total, count(*) FILTER (WHERE answer = '〇') AS correct, count(DISTINCT section) AS sections, count(*) FILTER (WHERE confidence >= 80) AS high, count(*) FILTER (WHERE confidence >= 50 AND confidence < 80) AS medium, count(*) FILTER (WHERE confidence < 50) AS low, floor(count(*) FILTER (WHERE answer = '〇') / count(*) * 100 + 0.5)::INT AS correct_percent, (SELECT section FROM d GROUP BY section ORDER BY count(*) DESC, min(doc_id) DESC LIMIT 1) AS main_section FROM d")
def record_overview(spark, sf_dir):
    return stats.overview(_document_records(spark, sf_dir)).select("total", "correct", "sections", "high", "medium", "low", "correct_percent", "main_section")


@query("""WITH t AS (SELECT conv_id, count(*) FILTER (WHERE turn % 7 <> 6) AS s, count(*) FILTER (WHERE turn % 7 = 6) AS f, count(*) FILTER (WHERE contains(text, '?')) AS q FROM conversations GROUP BY conv_id)
SELECT conv_id, s AS successful_files, f AS failed_files, q AS questions, CASE WHEN s + f > 0 THEN round(s * 100.0 / (s + f), 6) ELSE 0 END::DOUBLE AS success_rate, CASE WHEN q = 0 THEN 'error' WHEN f = 0 THEN 'success' ELSE 'warning' END AS status FROM t""")
def extraction_status(spark, sf_dir):
    """Conversations as runs, their turns as files."""
    lost = F.col("turn") % 7 == 6
    runs = A.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(~lost).alias("successful_files"), F.count_if(lost).alias("failed_files"), F.count_if(F.contains("text", F.lit("?"))).alias("questions"))
    return stats.extraction_status(runs).withColumn("success_rate", F.round(F.col("success_rate").cast("double"), 6))


# hierarchy

def _hierarchy_texts(spark, sf_dir):
    """A region a document: its chapter, a section a nation, a question with year and answer a supplier."""
    s = A.table(spark, sf_dir, "supplier").join(A.table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(A.table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    bare = lambda c: F.regexp_replace(c, "_", "")
    item = F.concat((F.col("s_suppkey") % 1000 + 1).cast("string"), F.lit(" 業者は届け出をする。\nR"), (F.col("s_suppkey") % 6 + 1).cast("string"), F.when(F.col("s_acctbal") > 5000, F.lit("\n〇")).otherwise(F.lit("\n×")), F.lit("\n【解説】期間は短い\n"))
    head = F.concat(F.lit("第"), (F.col("r_regionkey") + 1).cast("string"), F.lit("章："), bare("r_name"), F.lit("\n"))
    section = F.concat(F.lit("Section "), F.col("n_nationkey").cast("string"), F.lit(" "), bare("n_name"), F.lit("\n"))
    joined = lambda rows: F.array_join(F.transform(F.array_sort(rows), lambda r: r["t"]), "\n")
    nations = s.groupBy("r_regionkey", head.alias("head"), "n_nationkey", section.alias("section")).agg(joined(F.collect_list(F.struct("s_suppkey", item.alias("t")))).alias("items"))
    docs = nations.groupBy("r_regionkey", "head").agg(joined(F.collect_list(F.struct("n_nationkey", F.concat("section", "items").alias("t")))).alias("sections"))
    return docs.select(F.col("r_regionkey").alias("doc_id"), F.concat("head", "sections").alias("text"))


_HIER = "h AS (SELECT (n_nationkey * 1000000 + s_suppkey // 1000)::BIGINT AS doc_id, replace(r_name, '_', '') AS level1, replace(n_name, '_', '') AS level2, s_suppkey, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


_REGIONS = "h AS (SELECT r_regionkey AS doc_id, replace(r_name, '_', '') AS level1, replace(n_name, '_', '') AS level2, s_suppkey, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


@query(f"""WITH {_REGIONS} SELECT doc_id, level1, level2, (s_suppkey % 1000 + 1)::VARCHAR AS number, 'R' || (s_suppkey % 6 + 1) AS year, '業者は届け出をする。' AS question, '】期間は短い' AS explanation, CASE WHEN s_acctbal > 5000 THEN '〇' ELSE '×' END AS answer FROM h""")
def hierarchy_records(spark, sf_dir):
    rows = hierarchy.parse_texts(_hierarchy_texts(spark, sf_dir))
    names = dict(zip(K.HIERARCHY_HEADERS, ["level1", "level2", "level3", "level4", "number", "year", "question", "explanation", "answer"], strict=True))
    return rows.withColumnsRenamed(names).select("doc_id", "level1", "level2", "number", "year", "question", "explanation", "answer")


@query(f"WITH {_HIER} SELECT concat_ws(',', level1, level2, '', '', s_suppkey % 1000 + 1, 'R' || (s_suppkey % 6 + 1), '業者は届け出をする。', '】期間は短い', CASE WHEN s_acctbal > 5000 THEN '〇' ELSE '×' END) AS value FROM h")
def hierarchy_csv(spark, sf_dir):
    return hierarchy_csv_rows(hierarchy.parse_texts(_hierarchy_texts(spark, sf_dir))).toDF("value")


@query(f"WITH {_HIER} SELECT level1, count(*) AS total, count(*) FILTER (WHERE s_acctbal > 5000) AS correct, count(*) FILTER (WHERE s_acctbal <= 5000) AS incorrect FROM h GROUP BY level1")
def hierarchy_summary(spark, sf_dir):
    return stats.hierarchy_summary(hierarchy.parse_texts(_hierarchy_texts(spark, sf_dir)))


@query("SELECT p_partkey AS doc_id, (p_partkey % 1000 + 1)::VARCHAR AS number, 'R6' AS year, 'about ' || p_name || '。 ' || p_type AS question, '×' AS answer FROM part WHERE p_size % 3 > 0")
def hierarchy_literal(spark, sf_dir):
    """With all lines joined first, a text is one record, or none where it has a heading."""
    text = F.concat(F.when(F.col("p_size") % 3 == 0, F.lit("第1章：総則\n")).otherwise(F.lit("")), (F.col("p_partkey") % 1000 + 1).cast("string"), F.lit(" about "), "p_name", F.lit("。\n"), "p_type")
    rows = hierarchy.parse_texts(A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("text")), literal=True)
    return rows.select("doc_id", F.col("問題番号").alias("number"), F.col("出題年度").alias("year"), F.col("問題").alias("question"), F.col("回答").alias("answer"))
