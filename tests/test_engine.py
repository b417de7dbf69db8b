"""Golden cases of the engine's operators, and every query against its SQL."""

import datetime
import random
import re
import time
import unicodedata
import zipfile
from xml.etree import ElementTree

import duckdb
import pytest
from pyspark.sql import functions as F

from shirabe import adapters
from shirabe import constants as K
from shirabe import queries
from shirabe.functions import cleaning, compat, detect, scoring
from shirabe.operators import adaptive, hierarchy, layout, lines, records, segment, similar, stats
from shirabe.plans.questions import parse_questions
from shirabe.sources import files, formats, sinks
from shirabe.streaming import lines as stream_lines
from shirabe.streaming.files import parse_stream, text_files

SF = "/root/testdata/sf0.001"
QUIZ = "10001 宅地建物取引業者は、自ら売主となる契約を締結することができる。×\n１０００２　免許を受けるには、重要事項の説明をする義務がある。○\n10003 宅建業者は登記をしてはならないとされており、これは禁止される。×"


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("s"))).collect()]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    if name not in queries.ORACLE_SQL:  # these have a mirror below
        assert name == "document_candidates" and got.count() > 0
        return
    want = con.sql(queries.ORACLE_SQL[name])
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    kinds = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "BOOLEAN": "boolean"}
    assert {c: kinds.get(str(t), str(t)) for c, t in zip(want.columns, want.types, strict=True)} == dict(got.dtypes)
    assert sorted(str(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(str(tuple(r[want.columns.index(c)] for c in cols)) for r in want.fetchall())


def compare(spark, con, name, folder):
    """A query against its SQL over tables of its own; con's views are over the same."""
    got, want = queries.QUERIES[name](spark, str(folder)), con.sql(queries.ORACLE_SQL[name])
    cols = sorted(want.columns)
    rows = sorted(str(tuple(r[c] for c in cols)) for r in got.collect())
    assert rows and rows == sorted(str(tuple(r[want.columns.index(c)] for c in cols)) for r in want.fetchall())


def tables(folder, **of):
    """A DuckDB connection to tables written to the folder, each given by its SQL."""
    c = duckdb.connect()
    for name, sql in of.items():
        c.sql(f"COPY ({sql}) TO '{folder}/{name}.parquet'")
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return c


def test_sizes_halfway_between_hundredths(spark, tmp_path):
    # 3712 = 3.625 KB, 1152 = 1.125 KB: the format takes them up, SQL's printf to the even hundredth
    sizes = lambda **how: [r[0] for r in spark.createDataFrame([(3712,), (1152,), (1157,), (1408,)], "b long").select(cleaning.format_file_size(F.col("b"), **how)).collect()]
    assert sizes() == ["3.63 KB", "1.13 KB", "1.13 KB", "1.38 KB"]
    assert sizes(to_even=True) == ["3.62 KB", "1.12 KB", "1.13 KB", "1.38 KB"]
    con = tables(tmp_path, documents="SELECT i AS doc_id, 128 * (i // 6) AS n_chars FROM range(6000) r(i)")
    compare(spark, con, "file_sizes", tmp_path)


@pytest.mark.parametrize("name", ["question_numbers", "quiz_complete_records", "quiz_printed_answers", "quiz_questions", "quiz_csv", "quiz_overview", "quiz_parsing_stats", "quiz_preview", "quiz_section_report"])
def test_quiz_numbers_beyond_five_digits(spark, tmp_path, name):
    # 200 parts on both sides of key 90000, behind which p_partkey + 10000 has six digits, and as many beyond 180000
    con = tables(tmp_path, part=f"SELECT p_partkey + k AS p_partkey, * EXCLUDE (p_partkey) FROM '{SF}/part.parquet', (VALUES (0), (89900), (180000)) s(k)")
    compare(spark, con, name, tmp_path)


def test_debug_report_of_sizes_halfway(spark, tmp_path):
    con = tables(tmp_path, conversations="SELECT i AS conv_id, j AS turn, repeat('ab', 32 * (i + 1)::INT) AS text FROM range(80) r(i), range(2) s(j)")
    compare(spark, con, "extraction_debug", tmp_path)


def test_adaptive_golden(spark):
    texts = spark.createDataFrame([(1, "宅建業.pdf", QUIZ)], "doc_id int, file_name string, text string")
    rows = parse_questions(texts).orderBy("id").collect()
    assert [(r["question_number"], r["answer"], len(r["question"]), round(r["quality"]["total_score"], 6), round(r["confidence"], 6)) for r in rows] == [(10001, "〇", 31, 0.67, 62.625), (10002, "〇", 25, 0.67, 62.625), (10003, "×", 31, 0.67, 62.625)]
    assert {(r["section"], r["year"]) for r in rows} == {("宅建業法", "R6")}
    joined = lines.joined_text(lines.preprocess(texts))
    scores = {r["pattern"]: (r["matches"], round(r["score"], 6)) for r in adaptive.candidates(joined).collect()}
    assert scores == {"番号のみ形式": (1, 38.490909), "5桁問題番号": (1, 39.490909), "宅建年度番号形式": (1, 39.990909), "複数行対応5桁": (3, 40.472727), "回答アンカー形式": (3, 40.972727), "DOTALL複数行": (3, 40.672727), "シンプル数字": (1, 37.490909)}
    assert [r["answer"] for r in parse_questions(texts, answer_aware=True).orderBy("id").collect()] == ["×", "〇", "×"]
    assert parse_questions(texts, min_confidence=63).count() == 0


def test_patterns_agree_with_a_mirror(spark):
    """Every question pattern gives what Python's re gives for the same dialect."""
    texts = [QUIZ, "問1 最初の問題。問2 次の問題", "第 3 問．本文です第4問 つぎ", "1. a b\n2) c", "(1) one (2) two", "【1】甲【2】乙", "Q1. abc Q2 def", "1： x 2:y", "12345 abc\n67890 def", "123 foo\n124 bar\n", "12345本文解説あと", "　12345　x〇y"]
    for name, _, pattern, flags in K.QUESTION_PATTERNS:
        rx = mirror_of(pattern, flags)
        java = F.lit(compat.to_java(pattern, flags))
        for k in (1, 2):
            assert column(spark, texts, lambda c, j=java, k=k: F.regexp_extract_all(c, j, F.lit(k))) == [[m[k] or "" for m in rx.finditer(t)] for t in texts], name
        found = column(spark, [*texts, "12345 a\x02b\n"], lambda c, p=pattern, f=flags: F.transform(adaptive._found(c, p, f), lambda z: z["t"]))
        assert found == [[(m[2] or "").strip() for m in rx.finditer(t)] for t in [*texts, "12345 a\x02b\n"]], name


def test_patterns_take_time_linear_in_the_text(spark):
    """Numbers without a mark behind them, marks alone, quiz lines: every pattern over 10 MB of text."""
    texts = {"numbers": "12345 abc def " * 700_000, "digits": "1" * 10_000_000, "marks": "あ〇" * 1_700_000, "quiz": "10001 宅建業者は免許を受けた場合に、説明をする義務がある。×\n" * 120_000}
    for name, text in texts.items():
        rows = spark.createDataFrame([(text,)], "text string")
        began = time.perf_counter()
        counts = rows.select(*(F.size(adaptive._found(F.col("text"), p, f)).alias(f"c{i}") for i, (_, _, p, f) in enumerate(K.QUESTION_PATTERNS))).first()
        assert time.perf_counter() - began < 90, name
        assert (counts["c11"], counts["c12"]) == ((120_000, 120_000) if name == "quiz" else (0, 0))


def test_folds_take_time_linear_in_the_lines(spark):
    lines_ = [f"行の続き{i}" + ("。" if i % 3 == 0 else "") for i in range(100_000)]
    rows = spark.createDataFrame([("問い", lines_)], "first string, lines array<string>")
    want, now = ["問い"], "問い"
    for x in lines_:
        want.append(x if now.endswith("。") else " " + x)
        now = x
    began = time.perf_counter()
    assert rows.select(segment.append_lines(F.col("first"), F.col("lines"))).first()[0] == "".join(want)
    text = "\n".join(f"{'①②③'[i % 3]}選択肢{i}\n\x01続き\x02a{i}" for i in range(50_000))
    got = column(spark, [text], detect.all_choices)[0]
    assert len(got) == 50_000 and tuple(got[1])[:3] == (2, "②", "選択肢1 \x01続き\x02a1") and time.perf_counter() - began < 60
    spoken = "1 本文の一行です。\n" + "解説 説明の行\n続く行です\n" * 20_000
    one = hierarchy.parse_texts(spark.createDataFrame([(1, spoken)], "doc_id int, text string")).first()
    assert one["解説"] == "説明の行 続く行です" and one["問題"].count("続く行です") == 20_000


def test_dedup_counts_utf16_units(spark):
    head = "あ" * 49
    texts = [head + "😀x", head + "😁y", head + "い1", head + "い2", "😀" * 25 + "a", "😀" * 25 + "b", "😀" * 24 + "ab"]
    rows = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(texts)], "doc_id int, question_number int, id int, question string")
    seen, want = set(), []
    for i, t in enumerate(texts):
        cut = t.encode("utf-16-be")[:100]
        if cut not in seen:
            seen.add(cut)
            want.append(i)
    assert sorted(r["id"] for r in records.dedup_questions(rows).collect()) == want == [0, 2, 4, 6]


def test_candidates_agree_with_a_mirror(spark):
    """Matches, valid rows and scores of every pattern on whole documents and quiz texts."""
    units = lambda s: len(s.encode("utf-16-le")) // 2
    docs = [(str(r["doc_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    docs += [(r["doc_id"], r["text"]) for r in queries.A.quiz_texts(spark, SF).collect()]
    want = set()
    for doc_id, text in docs:
        for i, (_, confidence, pattern, flags) in enumerate(K.QUESTION_PATTERNS):
            rows = [(int(m[1]), (m[2] or "").strip()) for m in mirror_of(pattern, flags).finditer(text or "")]
            valid = [t for n, t in rows if 1 <= n < 2**31 and units(t) >= 20 and re.search("[\u3040-\u309F\u30A0-\u30FF\u4E00-\u9FAF]", t)]
            if valid:
                score = len(valid) * 0.4 + len(valid) / len(rows) * 30 + len(rows) * 50 / units(text) * 0.2 + confidence * 10
                want.add((doc_id, i, len(rows), len(valid), round(min(score, 100), 6)))
    got = {tuple(r) for r in queries.QUERIES["document_candidates"](spark, SF).collect()}
    assert got == want and len(want) > 20


def mirror_of(pattern, flags):
    spaces = "\t-\r    -     　﻿"
    mirror = pattern.replace(r"[\s\S]", "(?s:.)")
    mirror = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(r"\s", spaces), mirror)
    mirror = re.sub(r"(?<!\[)\\s", f"[{spaces}]", mirror) if r"\s" in mirror else mirror
    mirror = mirror if "m" in flags else mirror.replace("$", r"\Z")
    return re.compile(mirror, re.ASCII | sum({"s": re.S, "i": re.I, "m": re.M}[f] for f in flags))


def test_dialect(spark):
    assert column(spark, ["　 a﻿", " ", "x"], compat.trim) == ["a", "", "x"]
    assert column(spark, ["😀a", "あ"], compat.length) == [3, 1]
    assert column(spark, ["a\n"], lambda c: compat.matches(c, "a$")) == [False]
    assert column(spark, ["が", "é"], cleaning.nfc) == [unicodedata.normalize("NFC", s) for s in ("が", "é")]


def test_nfc(spark):
    texts = ["e\u0301", "か\u3099", "ﬀ Å", "\u1100\u1161", "가\u11a8", "plain", "", "日本語 é ー～", "\u2126", "a\u0323\u0307"]
    assert column(spark, texts, cleaning.nfc) == [unicodedata.normalize("NFC", t) for t in texts]


def test_layout_golden(spark):
    rows = [("d", 1, i, *r, 1.0, 1.0) for i, r in enumerate([("宅建", 50.0, 700.0, 12.0), ("業法", 80.0, 701.0, 12.0), ("A", 120.0, 699.0, 12.0), ("次行", 50.0, 680.0, 10.0), ("x", 200.0, 680.0, 10.0)])]
    schema = "doc_id string, page_no int, item_idx int, str string, x double, y double, font_size double, width double, height double"
    items = spark.createDataFrame([*rows, ("d", 2, 0, None, None, None, None, None, None)], schema)
    first = items.where("page_no = 1")
    text = lambda f, i=items: [r["text"] for r in f(i).collect()]
    assert text(layout.text_structured) == ["宅建 業法 A\n次行 x"]
    assert text(layout.text_improved) == ["宅建業法A\n次行 x"]
    assert text(layout.text_simple) == ["宅建 業法 A 次行 x"]
    assert [(r["text"], r["mode"]) for r in layout.text_adaptive(first).collect()] == [("宅建 業法 A\n次行 x", "structured")]
    c = layout.complexity(first).first()
    assert (c["y_variation"], c["fonts"], c["dx_variance"], c["short_ratio"], c["score"]) == (0.8, 2, 2218.75, 1.0, 0.8)
    assert [(r["text"], r["item_count"]) for r in layout.blocks(first).orderBy("block_no").collect()] == [("宅建 業法 A", 3), ("次行 x", 2)]
    assert {m: layout.page_text(first, m).first()["text"] for m in ("simple", "structured")} == {"simple": "宅建 業法 A 次行 x", "structured": "宅建 業法 A\n次行 x"}


def improved_mirror(items):
    """The improved mode of one page in Python; items: (item_idx, str, x, y, font)."""
    down = sorted((r for r in items if r[1].strip()), key=lambda r: (-r[3], r[0]))
    bands = []
    for i, r in enumerate(down):
        if i == 0 or down[i - 1][3] - r[3] > layout.PRECISION:
            bands.append([])
        bands[-1].append(r)
    text, before, last, new = "", None, None, False
    for r in (r for band in bands for r in sorted(band, key=lambda r: (r[2], r[0]))):
        new |= before is not None and abs(r[3] - before[3]) > before[4] * layout.LINE_GAP
        t = r[1].replace("?", "")
        if t.strip():
            if last is not None:
                text += "\n" if new else " " if r[2] - (last[2] + last[4] * sum(2 if c > "\u3000" else 1 for c in last[1].replace("?", ""))) > r[4] * layout.CHAR_GAP else ""
            text, last, new = text + t, r, False
        before = r
    return text


def test_improved_layout_sorts_pages_without_windows(spark):
    rng = random.Random(7)
    pages = {p: [(i, rng.choice(["ab", "業法", "?", " ", "x?y", "longer word"]), float(rng.randint(0, 30) * 10), float(rng.choice([700, 698, 694, 680, 679, 640])), rng.choice([10.0, 12.0, 40.0])) for i in range(rng.choice([1, 3, 20]))] for p in range(200)}
    pages[200] = [(i, f"w{i}", float(i % 90) * 42, 90000.0 - 14 * (i // 90), 12.0) for i in range(9000)]  # more than a window keeps in memory
    items = spark.createDataFrame([("d", p, *r, 1.0, 1.0) for p, rows in pages.items() for r in rows], "doc_id string, page_no int, item_idx int, str string, x double, y double, font_size double, width double, height double")
    out = layout.text_improved(items)
    want = {p: improved_mirror(rows) for p, rows in pages.items()}
    assert {r["page_no"]: r["text"] for r in out.collect()} == {p: t for p, t in want.items() if t}
    # window buffers beside a sort that is being filled ran out of memory on long pages
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


def test_items_are_dealt_to_more_parts_than_rows(spark):
    assert adapters.layout_items(spark, SF).rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_complexity_of_short_and_blank_items(spark):
    pages = {1: ["long item"] * 15 + ["ab"] * 5, 2: ["long item"] * 13 + ["ab"] * 7, 3: ["long item"] * 15 + ["ab"] * 5 + [" "] * 10, 4: [" ", ""]}
    rows = [("d", p, i, s, 50.0, 700.0 + i * (s == ""), 12.0) for p, texts in pages.items() for i, s in enumerate(texts)]
    items = spark.createDataFrame(rows, "doc_id string, page_no int, item_idx int, str string, x double, y double, font_size double")
    got = {r["page_no"]: (r["n_items"], r["short_ratio"], r["score"]) for r in layout.complexity(items).collect()}
    assert got == {1: (20, 0.25, 0.0), 2: (20, 0.35, 0.2), 3: (20, 0.25, 0.0), 4: (0, None, 0.0)}


def test_order_eras_covers_all_orders(spark):
    sf = "/root/testdata/sf0.001"
    got = queries.QUERIES["order_eras"](spark, sf).collect()
    assert sum(r["n"] for r in got) == spark.read.parquet(f"{sf}/orders.parquet").count()
    assert all((r["era"] is None) == (r["y"] is None or r["y"] < 2000) for r in got)


def test_small_goldens(spark):
    data = [(1, i, s) for i, s in enumerate(["short", "tiny", "this is a long line over twenty chars", "12345", "end×", "x"])]
    merged = lines.merge_short_lines(spark.createDataFrame(data, "doc_id int, line_no int, line string"))
    assert [r["line"] for r in merged.orderBy("line_no").collect()] == ["short tiny this is a long line over twenty chars", "12345", "end×", "x"]
    assert column(spark, ["Ａ？B?  （１２）～○\u0001x\n\n\n\n　　　　y·z", "···"], cleaning.clean) == ["Ａ？B (12)〜〇 x\ny・z", "・・・"]
    assert column(spark, ["···"], lambda c: cleaning.clean(cleaning.clean(c))) == ["…"]
    assert column(spark, ["問1．次の記述のうち正しいものはどれか。\n・短い\nこの行は二十文字以上の長さがあるので別の行になる"], cleaning.clean_question) == ["．次の記述のうち正しいものはどれか。短い この行は二十文字以上の長さがあるので別の行になる"]
    assert column(spark, ["abc", "あいうえおかきくけこ", "aaaaa?bbbbbbbb", ""], lambda c: cleaning.text_quality(c)["score"]) == [50, 100, 55, 0]
    assert column(spark, [""], lambda c: cleaning.quality_issues(cleaning.text_quality(c))) == [["テキストが空"]]
    assert column(spark, ["正しい記述は〇である"], detect.answer) == ["〇"]
    assert column(spark, ["民法_101-150.pdf", "101-150.pdf", "90-120.pdf"], detect.section_from_file) == ["権利関係", "宅建業法", None]
    assert column(spark, ["R5_a.pdf", "H29.pdf", "2020.pdf", "2015.pdf", "chapter3.pdf"], detect.file_year) == ["R5", "H29", "R2", "R6", "R3"]
    assert column(spark, ["R5", "平成29年", "2020年", "2015年", "5年", "12年", "40年"], detect.line_year) == ["R5", "H29", "R2", "H27", "R5", "H12", None]
    assert column(spark, ["a.b*c"], cleaning.escape_regex) == [r"a\.b\*c"]
    one = spark.createDataFrame([((("x", None),),)], "s struct<a struct<b string, c string>>").select(cleaning.nested(F.col("s"), "a.b").alias("b"), cleaning.nested(F.col("s"), "a.c", F.lit("d")).alias("c"), cleaning.nested(cleaning.with_nested(F.col("s"), "a.c", F.lit("e")), "a.c").alias("e")).first()
    assert tuple(one) == ("x", "d", "e")
    numbers = spark.createDataFrame([(1, v) for v in (1, 2, 4, 4, 8)], "doc_id int, value int")
    r = stats.number_distribution(numbers).first()
    assert (r["min"], r["max"], r["range"], r["count"], r["sequential"], r["n_gaps"], r["completeness"]) == (1, 8, 8, 5, False, 2, 0.625)
    assert sorted(tuple(g)[1:] for g in records.number_gaps(numbers).collect()) == [(3, 3), (5, 7)]
    a = stats.answer_distribution(spark.createDataFrame([(1, v) for v in "〇〇×"], "doc_id int, value string")).first()
    assert (a["correct"], a["incorrect"], a["balanced"]) == (2, 1, False)


def test_hierarchy_golden(spark):
    text = "第1章：総則\nSection 2 免許\n1 免許は5年ごとに更新する。\nR5\n〇\n【解説】期間は5年である\n更新手続きを要する"
    texts = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert [tuple(r)[2:] for r in hierarchy.parse_texts(texts).collect()] == [("総則", "免許", "", "", "1", "R5", "免許は5年ごとに更新する。更新手続きを要する", "】期間は5年である 更新手続きを要する", "〇")]
    assert hierarchy.parse_texts(texts, literal=True).count() == 0
    one = spark.createDataFrame([(1, "1 本文の一行。\n続き")], "doc_id int, text string")
    assert [(r["問題"], r["出題年度"], r["回答"]) for r in hierarchy.parse_texts(one, literal=True).collect()] == [("本文の一行。 続き", "R6", "×")]


def test_hierarchy_covers_whole_regions(spark, tmp_path):
    """A region is one document over any span of keys, a section a nation; the headings stay those of each question."""
    duckdb.execute(f"COPY (SELECT i AS s_suppkey, (i % 25)::INT AS s_nationkey, (i * 37 % 10000)::DOUBLE AS s_acctbal FROM range(5000) t(i)) TO '{tmp_path}/supplier.parquet'")
    for t in ("nation", "region"):
        duckdb.execute(f"COPY (FROM '{SF}/{t}.parquet') TO '{tmp_path}/{t}.parquet'")
    texts = queries._hierarchy_texts(spark, str(tmp_path))
    assert texts.count() == texts.select("doc_id").distinct().count() == 5
    got = queries.hierarchy_records(spark, str(tmp_path))
    con = duckdb.connect()
    for t in ("supplier", "nation", "region"):
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL['hierarchy_records']})").fetchall()
    assert len(want) == 5000 and sorted(map(tuple, got.collect())) == sorted(want)


def line_machine(rows):
    """The fallback parser as a loop, over detectors given by the test."""
    out, now = [], None
    for kind, value in rows:
        if kind == "q":
            now = {"n": value[0], "t": value[1], "a": None, "e": "", "c": 70}
            out.append(now)
        elif now is None:
            continue
        elif kind == "a" and now["a"] is None:
            now["a"], now["c"] = value, now["c"] + 20
        elif kind == "e":
            now["e"], now["c"] = value, now["c"] + 10
        elif kind in "at" and len(value := value if kind == "t" else f"答え：{value}") >= 3:
            now["t"] += ("" if not now["t"] or now["t"][-1] in "。 " else " ") + value
    return [(q["n"], q["t"], q["a"], q["e"], q["c"]) for q in out if len(q["t"].strip()) >= 5]


def test_fallback_is_the_line_machine(spark):
    rng = __import__("random").Random(1)
    make = {"q": lambda i: ("q", (i + 1, f"本文その{i}は何である。")), "a": lambda i: ("a", rng.choice("〇×")), "e": lambda i: ("e", f"説明文{i}"), "t": lambda i: ("t", rng.choice(["続きの文", "終わる。", "ab"]))}
    show = {"q": lambda v: f"問{v[0]} {v[1]}", "a": lambda v: f"答え：{v}", "e": lambda v: f"補足：{v}", "t": lambda v: v}
    docs, want = [], {}
    for d in range(20):
        rows = [make[rng.choice("qaett")](i) for i in range(30)]
        docs += [(d, i, show[k](v)) for i, (k, v) in enumerate(rows)]
        want[d] = line_machine(rows)
    got = {d: [] for d in want}
    for r in segment.fallback_questions(spark.createDataFrame(docs, "doc_id int, line_no int, line string")).orderBy("doc_id", "id").collect():
        got[r["doc_id"]].append((r["question_number"], r["question"], r["answer"], r["explanation"], r["confidence"]))
    assert got == want


def test_records_without_answers_cover_whole_files(spark, tmp_path):
    """A brand is one file over any span of keys; its numbers begin anew after 900 without taking lines of the next."""
    duckdb.execute(f"COPY (SELECT i AS p_partkey, 'part ' || i AS p_name, 'Brand#' || (i % 2) AS p_brand FROM range(3700) t(i)) TO '{tmp_path}/part.parquet'")
    got = sorted(map(tuple, queries.emergency_records(spark, str(tmp_path)).collect()))
    sql = queries.ORACLE_SQL["emergency_records"].replace("FROM part", f"FROM '{tmp_path}/part.parquet'")
    assert got == sorted(duckdb.sql(sql).fetchall())
    assert len(got) == 3700 and {r[0] for r in got} == {"Brand#0", "Brand#1"} and {r[1] for r in got} == set(range(1, 901))


def test_invariants(spark):
    rows = parse_questions(queries.A.quiz_texts(spark, SF))
    assert rows.where("confidence < 0 or confidence > 95").count() == 0
    assert records.dedup_questions(rows).count() == rows.count()
    assert stats.section_report(rows).agg(F.sum("total")).first()[0] == rows.count()
    assert [r["question_number"] for r in records.sort_questions(rows.where("doc_id = 'Brand#1/0'")).collect()] == sorted(r["question_number"] for r in rows.where("doc_id = 'Brand#1/0'").collect())
    empty = spark.createDataFrame([], "doc_id int, file_name string, text string")
    assert parse_questions(empty).count() == 0
    assert parse_questions(spark.createDataFrame([(1, None, None), (2, "a", "")], "doc_id int, file_name string, text string")).count() == 0


def test_scores(spark):
    rows = spark.createDataFrame([(5, "短い", "〇", "")], "n int, t string, a string, e string")
    none = F.array().cast("array<struct<number:string,text:string,format:string>>")
    q = rows.select(scoring.quality(F.col("n"), F.col("t"), none, F.col("a"), F.col("e")).alias("q")).first()["q"]
    assert round(q["total_score"], 6) == round(0.1 * 0.25 + 0.5 * 0.2 + 0.5 * 0.15 + 0.2 + 0 + 0.7 * 0.1, 6)
    one = rows.select(adaptive.volume_score(F.lit(0.9), F.lit(0.5), F.lit(0)).alias("v"), adaptive.pattern_confidence(F.lit(0.9), F.array(F.lit(2), F.lit(1))).alias("s"), adaptive.pattern_confidence(F.lit(0.8), F.array(F.lit(2), F.lit(5))).alias("g")).first()
    assert (one["v"], one["s"], round(one["g"], 6)) == (0, 1.0, 0.85)


def every_choice(text):
    """The first of four forms that occurs: circled numbers with continued lines, digits, kana, digits in brackets."""
    out = []
    for line in map(str.strip, text.split("\n")):
        if m := re.match(r"([①②③④⑤⑥⑦⑧⑨⑩])\s*(.+)", line):
            out.append(["①②③④⑤⑥⑦⑧⑨⑩".index(m[1]) + 1, m[1], m[2]])
        elif out and line:
            out[-1][2] += " " + line
    if out:
        return [(*c, "丸数字選択肢") for c in out]
    for name, pattern in (("数字選択肢", r"^([1-9])\.\s*(.+?)(?=^[1-9]\.|$)"), ("アイウエ選択肢", r"^([アイウエオカキクケコ])\.\s*(.+?)(?=^[アイウエオカキクケコ]\.|$)"), ("括弧数字選択肢", r"^\(([1-9])\)\s*(.+?)(?=^\([1-9]\)|$)")):
        rows = [(int(m[1]) if m[1].isdigit() else "アイウエオ".find(m[1]) + 1, f"({m[1]})" if "括弧" in name else m[1], m[2].strip(), name) for m in re.finditer(pattern, text, re.M)]
        if rows:
            return rows
    return []


def test_choices_of_every_form(spark):
    golden = {"①甲の場合\n続きの行\n\n②乙の場合": [(1, "①", "甲の場合 続きの行", "丸数字選択肢"), (2, "②", "乙の場合", "丸数字選択肢")], "(1) 一番\n(2) 二番": [(1, "(1)", "一番", "括弧数字選択肢"), (2, "(2)", "二番", "括弧数字選択肢")], "カ. 六番": [(0, "カ", "六番", "アイウエ選択肢")], "①": [], "ア. x\n1. y": [(1, "1", "y", "数字選択肢")]}
    for text, want in golden.items():
        assert every_choice(text) == want
        assert [tuple(r)[:4] for r in column(spark, [text], detect.all_choices)[0]] == want
    rows = queries._CHOICES(spark, SF).collect()
    want = sorted((r["id"], *c) for r in rows for c in every_choice(r["s"]))
    assert sorted(tuple(r) for r in queries.QUERIES["all_choices"](spark, SF).collect()) == want and len({c[-1] for c in want}) == 4


def test_normalised_marks(spark):
    rows = spark.createDataFrame([("○", "correct_incorrect", 0), ("×", "correct_incorrect", 0), ("①", "correct_incorrect", 5), ("③", "multiple_choice", 3), ("④", "multiple_choice", 3), ("イ", "multiple_choice", 2), ("オ", "multiple_choice", 4), ("5", "multiple_choice", 5), ("6", "multiple_choice", 9), ("○", "in_text", 5)], "m string, k string, n int")
    assert [r[0] for r in rows.select(detect.normalise_answer(F.col("m"), F.col("k"), F.col("n"))).collect()] == ["〇", "×", None, "③", None, "イ", None, "5", None, None]
    assert column(spark, ["答え：③ 正しい・適切", "解答 ○", "正しい記述は必要", "誤っている", "不適切で禁止"], lambda c: detect.best_answer(c, F.lit(2))) == ["〇", "〇", "〇", None, "×"]


def test_choice_scores(spark):
    kind = "array<struct<number:string,text:string,format:string>>"
    rows = spark.createDataFrame([([("1", "x" * n, "f") for n in sizes],) for sizes in ([], [20], [20, 10], [3, 6, 16, 15, 5], [20] * 6)], f"c {kind}")
    got = rows.select(scoring.choice_count_score(F.col("c")).alias("n"), scoring.choice_quality_score(F.col("c")).alias("q"), scoring.format_score(F.lit(5), F.col("c")).alias("f"), scoring.format_score(F.lit(101), F.col("c")).alias("g")).collect()
    assert [r["n"] for r in got] == [0.5, 0.3, 1.0, 1.0, 0.2]
    assert [round(r["q"], 6) for r in got] == [0.5, 0.8, 0.65, round((0 + 0.5 + 0.8 + 0.5 + 0) / 5, 6), 0.8]
    assert [round(r["f"], 6) for r in got] == [0.7, 0.7, 0.5, 0.5, 0.5] and round(got[0]["g"], 6) == 0.4
    assert [r[0] for r in spark.createDataFrame([("",), ("〇",), ("ウ",), ("6",), (None,)], "a string").select(scoring.answer_score(F.col("a"))).collect()] == [0.0, 1.0, 1.0, 0.5, 0.0]


def test_reliability_and_formats(spark):
    raw = [(1, n, a, e) for n, a, e in [(1, "〇", "x"), (2, "×", ""), (3, None, None), (4, "〇", "y")]] + [(2, 1, "〇", ""), (2, 2, "〇", "")] + [(3, None, None, "e")] + [(4, 1, "〇", "e"), (4, 2, "×", "e")]
    got = {r["doc_id"]: (round(r["reliability"], 6), r["formats"]) for r in stats.pattern_reliability(spark.createDataFrame(raw, "doc_id int, question_number int, answer string, explanation string")).collect()}
    assert got == {1: (round(0.4 + 0.3 * 3 / 4 + 0.3 * 2 / 4, 6), "番号付き問題,○×問題,解説付き"), 2: (0.7, "番号付き問題,○×問題"), 3: (0.3, "解説付き"), 4: (1.0, "番号付き問題,○×問題,解説付き,バランス型")}


def test_issues_and_reports(spark):
    assert column(spark, ["aaaaa?あ", "あいう\x01えおかきくけこさ", "、、、、、、ああああああああ"], lambda c: cleaning.quality_issues(cleaning.text_quality(c))) == [["テキストが短すぎる", "文字化け文字が1個", "日本語文字の比率が低い", "連続する同じ文字: aaaaa"], ["制御文字が1個"], ["連続する同じ文字: 、、、、、、, ああああああああ"]]
    rows = spark.createDataFrame([(1, 7, "short", None, 40.0), (1, 8, "x" * 30, "", 49.5), (1, 9, "x" * 30, "〇", 50.0), (1, None, "x" * 30, "×", None)], "doc_id int, question_number int, question string, answer string, confidence double")
    assert sorted(r["issue"] for r in stats.quality_issues(rows).collect()) == sorted(["問7: 信頼度が低い (40%)", "問7: 問題文が短い", "問7: 答えが不明", "問8: 信頼度が低い (49.5%)", "問8: 答えが不明"])
    many = spark.createDataFrame([(1, i, i, "s", "q" * 60, "〇×"[i % 2], float(60 + i)) for i in range(25)], "doc_id int, id int, question_number int, section string, question string, answer string, confidence double")
    assert tuple(stats.report_totals(many).first()) == (25, 13, 12, 72.0, 10, 0) and tuple(stats.report_totals(many, n=4).first())[4:] == (10, 6)
    assert [r["id"] for r in stats.attention_list(many).collect()] == list(range(10))
    files_ = spark.createDataFrame([("a", True, ["x", "y"], None, 3, 10, 90.0, "simple", 1.0), ("b", True, [], None, 1, 5, 60.0, "simple", 2.0), ("c", False, [], "bad", 0, 0, 0.0, "simple", 0.0), ("d", False, None, "", 0, 0, 0.0, None, 0.0)], "doc_id string, success boolean, issues array<string>, error string, page_count int, text_length int, quality double, method string, processing_time double")
    assert {r["doc_id"]: r["issues"] for r in stats.extraction_issues(files_).collect()} == {"a": ["x", "y"], "c": ["bad"], "d": ["不明なエラー"]}
    s = stats.extraction_stats(files_).first()
    assert (s["successful_files"], s["failed_files"], s["total_pages"], s["total_text_length"], s["average_quality"], s["high"], s["medium"], s["low"], s["processing_time"]) == (2, 2, 4, 15, 75.0, 1, 1, 0, 3.0)
    manifest = spark.createDataFrame([("a", "a.pdf", 2048), ("b", "b.pdf", 5)], "doc_id string, name string, size long")
    shown, totals = stats.debug_info(files_, manifest, {"extractionMode": "simple", "debugMode": True})
    assert shown.columns == ["name", "size", "success", "page_count", "text_length", "quality", "method", "processing_time", "issues", "error"]
    assert {tuple(r)[:3] for r in shown.collect()} == {("a.pdf", "2 KB", True), ("b.pdf", "5 Bytes", True), (None, None, False)}
    assert [r["issues"] for r in stats.debug_info(files_)[0].where("name = 'd'").collect()] == [[]]
    assert totals.first()["config"] == {"extractionMode": "simple", "debugMode": "True"} and totals.drop("config").first() == s


def test_metadata_and_manifest(spark, tmp_path):
    def reader(content):
        if content == b"half":
            raise ValueError(7)
        if content == b"none":
            raise ValueError("no document")
        return 3, None, {"Title": "T", "Author": None, "CreationDate": "D:2024", "pdf:PDFVersion": "1.7"}

    rows = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"half")), ("c", bytearray(b"none"))], "doc_id string, content binary")
    got = {r["doc_id"]: tuple(r)[1:] for r in files.read_metadata(rows, reader).collect()}
    assert got == {"a": ("T", "", "", "", "", "D:2024", None, "1.7", 3, False), "b": (*[None] * 8, 7, False), "c": (*[None] * 9, False)}
    new = spark.createDataFrame([("a.pdf", None, 5), ("b.txt", None, 5), ("c.pdf", None, 6)], "name string, mime string, size long")
    manifest = spark.createDataFrame([("a.pdf", "1"), ("c.pdf", "2")], "name string, id string")
    assert [r["name"] for r in files.remove_files(manifest, manifest.where("name = 'a.pdf'")).collect()] == ["c.pdf"]
    assert [r["name"] for r in files.add_files(new.limit(0).withColumn("id", F.lit("")), new).orderBy("name").collect()] == ["a.pdf", "c.pdf"]
    order = spark.createDataFrame([(2, "b"), (0, "c"), (1, "a")], "file_idx int, x string")
    assert [r["x"] for r in files.in_order(order).collect()] == ["c", "a", "b"]


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


@pytest.mark.parametrize("percent", [51, 67, 80, 95, 100])
def test_alike_texts_without_blocks(spark, percent):
    """The pairs of all pairs, found among few of them."""
    rng = random.Random(percent)
    texts = {"a", "b", "ab", "日本語", "日本誤", "x" * 30, "x" * 29 + "y"}
    while len(texts) < 240:
        base = "".join(rng.choice("abcdefghij") for _ in range(rng.choice([6, 12, 25, 40])))
        texts.add(base)
        for _ in range(4):
            word = list(base)
            for _ in range(rng.randint(1, 6)):
                at = rng.randrange(len(word) + 1)
                word[at : at + rng.randint(0, 1)] = rng.choice([[], ["k"], ["a", "b"]])
            texts.add("".join(word))
    texts = sorted(texts - {""})
    limit = lambda a, b: (100 - percent) * max(len(a), len(b)) // 100
    want = {(a, b): edit_distance(a, b) for i, a in enumerate(texts) for b in texts[i + 1 :] if abs(len(a) - len(b)) <= limit(a, b)}
    want = {frozenset(k): v for k, v in want.items() if v <= limit(*k)}
    table = spark.createDataFrame([(t,) for t in [*texts, "", None]], "text string")
    got = similar.alike(table, percent).collect()
    assert {frozenset((r["a"], r["b"])): r["distance"] for r in got} == want and len(got) == len(want)
    if percent >= 80:
        assert similar.candidates(table, percent).count() < 0.05 * len(texts) ** 2 / 2
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0], texts[0], None, ""])], "k int, t string")
    counts = {r["k"]: (r["class_id"], r["n_links"]) for r in similar.links(rows, "k", "t", percent).collect()}
    near = sum(texts[0] in p for p in want)
    assert counts[0] == counts[len(texts)] == (0, near + 2) and counts[len(texts) + 2] == (None, 0) and counts[len(texts) + 3] == (len(texts) + 3, 0)


def test_planned_files(spark, tmp_path):
    """Names of any case, sizes and order are settled before a file is opened; partitions are bounded."""
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    for name, content in {"b.PDF": b"two", "a.pdf": b"one", "c.txt": b"no", "deep/d.Pdf": b"four", "e.pdf.exe": b"no"}.items():
        (folder / name).write_bytes(content)
    with open(folder / "z.pdf", "wb") as f:
        f.truncate(101 * 1024 * 1024)  # sparse; were it read, so would be the next, which can't be
    got = files.scan_files(spark, str(folder)).collect()
    assert [(r["file_idx"], r["name"], r["size"], bytes(r["content"])) for r in files.in_order(spark.createDataFrame(got)).collect()] == [(0, "a.pdf", 3, b"one"), (1, "b.PDF", 3, b"two"), (2, "d.Pdf", 4, b"four")]
    read = spark.read.format("document_files")
    assert read.option("partitionBytes", 4).load(str(folder)).rdd.getNumPartitions() == 3 and read.option("partitionBytes", 7).load(str(folder)).rdd.getNumPartitions() == 2
    assert {r["name"] for r in read.option("maxFileBytes", 3).load("file://" + str(folder)).collect()} == {"a.pdf", "b.PDF"}
    reader = formats.FileReader({"path": str(folder)})
    opened = []
    reader_fs, path = formats.file_system(str(folder))
    assert [f[1].rsplit("/", 1)[-1] for p in reader.partitions() for f in p.files] == ["a.pdf", "b.PDF", "d.Pdf"] and not opened and path
    (tmp_path / "none").mkdir()
    assert files.scan_files(spark, str(tmp_path / "none")).count() == 0


def test_one_file_exports(spark, tmp_path):
    day = datetime.date(2024, 3, 5)
    rows = spark.range(0, 1000, 1, 7).select(F.concat(F.lit("行"), F.col("id").cast("string")).alias("value"))
    sinks.write_csv(rows, str(tmp_path / "csv"), ["a"], "x", day)
    sinks.write_csv(rows.limit(0), str(tmp_path / "csv"), ["a", "b"], "none", day)
    assert sorted(f.name for f in (tmp_path / "csv").iterdir()) == ["none_2024-03-05.csv", "x_2024-03-05.csv"]
    assert (tmp_path / "csv" / "x_2024-03-05.csv").read_text(encoding="utf-8") == "\ufeffa\n" + "".join(f"行{i}\n" for i in range(1000))
    assert (tmp_path / "csv" / "none_2024-03-05.csv").read_text(encoding="utf-8") == "\ufeffa,b\n"
    bad = rows.select(F.when(F.col("value") == "行999", F.raise_error(F.lit("stop"))).otherwise(F.col("value")).alias("value"))
    with pytest.raises(Exception, match="stop"):
        sinks.write_csv(bad, str(tmp_path / "csv"), ["a"], "bad", day)
    assert len(list((tmp_path / "csv").iterdir())) == 2

    table = spark.createDataFrame([(1, "a<b>&\n\x01", 1.5, True, datetime.date(2024, 1, 2), [1, 2]), (None, None, None, None, None, None), (3, "  日本 ", float("nan"), False, None, [])], "i int, s string, d double, b boolean, day date, l array<int>").orderBy(F.col("i").asc_nulls_last())
    sinks.write_excel(table, str(tmp_path / "xlsx"), "x", day)
    sinks.write_excel(table.limit(0), str(tmp_path / "xlsx"), "none", day)
    sinks.write_excel(spark.range(0, 25, 1, 3), str(tmp_path / "xlsx"), "many", day, sheet_rows=11)
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}

    def sheets(name):
        with zipfile.ZipFile(tmp_path / "xlsx" / f"{name}_2024-03-05.xlsx") as book:
            assert book.testzip() is None
            for part in book.namelist():
                ElementTree.fromstring(book.read(part))
            own = sorted((n for n in book.namelist() if "/sheet" in n), key=lambda n: int(re.search(r"(\d+)\.xml", n)[1]))
            assert len(ElementTree.fromstring(book.read("xl/workbook.xml")).findall(".//m:sheet", ns)) == len(own)
            return [[["".join(c.itertext()) for c in row.findall("m:c", ns)] for row in ElementTree.fromstring(book.read(n)).findall(".//m:row", ns)] for n in own]

    assert sheets("x") == [[["i", "s", "d", "b", "day", "l"], ["1", "a<b>&\n_x0001_", "1.5", "1", "2024-01-02", "[1,2]"], ["3", "  日本 ", "nan", "0", "", "[]"], ["", "", "", "", "", ""]]]
    assert sheets("none") == [[["i", "s", "d", "b", "day", "l"]]]
    assert [[r[0] for r in s] for s in sheets("many")] == [["id", *map(str, range(10))], ["id", *map(str, range(10, 20))], ["id", *map(str, range(20, 25))]]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"page one|page two")
    (tmp_path / "in" / "b.pdf").write_bytes(b"broken")
    (tmp_path / "in" / "c.txt").write_bytes(b"no")

    def reader(content):
        if content == b"broken":
            raise ValueError("not a document" * 100)
        return [(i, t, None) for i, t in enumerate(content.decode().split("|"), 1)]

    pages = files.read_pages(files.scan_files(spark, str(tmp_path / "in")), reader)
    got = {r["doc_id"].rsplit("/", 1)[-1]: r for r in files.file_results(pages).collect()}
    assert (got["a.pdf"]["success"], got["a.pdf"]["text"], got["a.pdf"]["page_count"]) == (True, "page one\npage two", 2)
    assert (got["b.pdf"]["success"], got["b.pdf"]["error"]) == (False, "not a document" * 100) and got["a.pdf"]["processing_time"] > 0
    assert {r["doc_id"][-5:]: r["text"] for r in files.assemble(pages, max_pages=1).collect()} == {"a.pdf": "page one", "b.pdf": ""}

    texts = spark.createDataFrame([(1, 'R5_"q",x.pdf', QUIZ)], "doc_id int, file_name string, text string")
    rows = parse_questions(texts).withColumn("created_at", F.lit("2024-01-02 03:04:05").cast("timestamp"))
    sinks.write_csv(sinks.csv_rows(rows.orderBy("id")), str(tmp_path / "csv"))
    raw = next((tmp_path / "csv").glob("*.csv")).read_text(encoding="utf-8")
    assert raw.startswith("﻿" + ",".join(K.CSV_HEADERS) + "\n1,") and '"R5_""q"",x.pdf",unknown,62.62' in raw and "2024-01-02 03:04:05" in raw
    sinks.write_json(rows, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    sinks.save_options(spark, {"mode": "simple", "年": 1}, str(tmp_path / "opt"))
    assert sinks.load_options(spark, str(tmp_path / "opt"), {"x": 2}) == {"mode": "simple", "年": 1, "x": 2}
    assert sinks.load_options(spark, str(tmp_path / "none"), {"x": 2}) == {"x": 2}
    log = spark.createDataFrame([("2024-01-01 00:00:00", "info", "a"), ("2024-01-01 00:00:01", "warn", "b")], "ts string, level string, message string").withColumn("ts", F.to_timestamp("ts"))
    sinks.write_log(log, str(tmp_path / "log"), last=1)
    assert spark.read.text(str(tmp_path / "log")).collect()[0][0] == "[2024-01-01 00:00:01] [WARN] b"
    levels = hierarchy.parse_texts(spark.createDataFrame([(1, "1 一行の本文、です")], "doc_id int, text string"))
    assert sinks.hierarchy_csv_rows(levels).first()[0] == ",,,,1,R6,一行の本文、です,,×"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "宅建業.txt").write_text(QUIZ, encoding="utf-8")
    for _ in range(2):
        parse_stream(text_files(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3

def dealt(spark, lines_, folder, rng, ordered):
    """Lines in files, one a batch: (doc_id, line_no, line) with the last of each document marked."""
    last = {d: max(n for e, n, _ in lines_ if e == d) for d, _, _ in lines_}
    rows = sorted(((n, d, x) for d, n, x in lines_), key=lambda r: r[0] if ordered else 0)
    if not ordered:
        rng.shuffle(rows)
    folder.mkdir()
    cuts = sorted(rng.sample(range(1, len(rows)), 3))
    for i, (a, z) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        part = rows[a:z] + rows[a : min(a + 2, z - 1)] * ordered  # some come twice
        spark.createDataFrame([(d, n, x, n == last[d]) for n, d, x in part], "doc_id int, line_no int, line string, last boolean").coalesce(1).write.mode("append").json(str(folder))
        time.sleep(0.02)
    return spark.readStream.schema("doc_id int, line_no int, line string, last boolean").option("maxFilesPerTrigger", 1).json(str(folder))


@pytest.mark.parametrize("ordered", [True, False])
def test_line_parsers_over_streams(spark, tmp_path, ordered):
    """Records of files whose lines come in several batches are those of whole files, and the state goes with them."""
    stream_lines.use_state_store(spark)
    rng = random.Random(5 + ordered)
    kinds = {
        "fallback": (segment.fallback_questions, stream_lines.stream_fallback, ["問{i} 本文その{i}は何であるか。", "答え：〇", "答え：×", "解説：説明文{i}です", "続きの文{i}", "終わる{i}。", "ab", "12"]),
        "hierarchy": (hierarchy.parse_lines, stream_lines.stream_hierarchy, ["第{i}章：総則{i}", "Section {i} 免許", "●小さな項目{i}", "{i} 免許は更新する。", "{i}．二つ目の問い", "R5", "令和3年の問題", "〇", "正解：×", "【解説】期間は{i}である", "【解説】", "解説", "続きの文{i}", "終わる{i}。", "", " ", "ab"]),
    }
    for name, (whole, stream, shapes) in kinds.items():
        rows = [(d, n, rng.choice(shapes).format(i=n % 7 + 1)) for d in range(12) for n in range(rng.choice([1, 5, 40]))]
        want = sorted(map(str, whole(spark.createDataFrame(rows, "doc_id int, line_no int, line string")).collect()))
        out = stream(dealt(spark, rows, tmp_path / name, rng, ordered))
        run = out.writeStream.format("memory").queryName(f"{name}_{ordered}").outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}_state")).trigger(availableNow=True).start()
        run.awaitTermination(240)
        assert run.exception() is None and len(run.recentProgress) >= 4
        assert sorted(map(str, spark.table(f"{name}_{ordered}").select(whole(spark.createDataFrame(rows[:1], "doc_id int, line_no int, line string")).columns).collect())) == want and len(want) > 10
        assert run.lastProgress["stateOperators"][0]["numRowsTotal"] == 0
