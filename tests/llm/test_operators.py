"""The corpus operators against brute force, on small tables with every awkward case."""

import dataclasses
import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from shirabe.llm import bpe, common, covertree, fingerprint, htmltext, langid, licenses, linededup, minhash, packing, queries, toxicity
from shirabe.llm.graph import connected_components

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
# extra columns have the names that the operators use themselves
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines long, kept boolean, component long, node long, k1 long, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, True, 1, 1, 1, 0.5) for i, t in rows], SCHEMA)


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def corpus(seed=7):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(30, 120)) for _ in range(12)]
    lines = ["A shared line, longer.", "short", "  ANOTHER shared LINE here\t", "ünïcödé lïne", "кириллица да"]
    rows = [(None, base[0]), (None, None), (1, None), (2, ""), (3, "   \t\n "), (4, "one"), (5, "one"), (6, "One TWO"), (7, " one  two ")]
    for i in range(100):
        text = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            text[rng.randrange(len(text))] = "x" + str(rng.randrange(40))
        own = [" ".join(text)] + rng.sample(lines, rng.randint(0, 3))
        rng.shuffle(own)
        rows.append((10 + i, "\n".join(own)))
    rows += [(200, "a" * 5000 + "<|endoftext|>" + "é😀" * 900), (201, words(rng, 6000)), (10, base[3]), rows[12]]
    return rows


def components(ids, links):
    low = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    return low


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_intermediate_tables_are_deleted(spark):
    import glob

    folder = common.shared_dir(spark).removeprefix("file:")
    held = lambda: set(glob.glob(f"{folder}/cut-*"))
    docs, before = frame(spark, corpus()[:40]), held()
    for f in (lambda: minhash.near_duplicates(docs), lambda: packing.pack(docs, PATH), lambda: linededup.dedup_lines(docs), lambda: covertree.near_vectors(vectors(spark, [(1, [1.0, 2.0]), (2, [2.0, 4.0])]))):
        out = f()
        made = held() - before
        assert len(made) == 1 and out.count() > 0
        before = held()
    langid.fit(docs)
    toxicity.fit(docs, spark.createDataFrame([(11, 1), (12, 0)], "doc_id long, toxic int"))
    assert held() == before
    with common.scratch() as keep:
        inner = common.cut(docs)
        with common.scratch() as deeper:
            given = deeper(inner.where("doc_id = 11"))
        last = keep(given.select("doc_id"))
        assert len(held() - before) == 3
    assert len(held() - before) == 1 and last.count() == 1


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, 2000 + i) for i in range(500)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*edges, (None, 3), (5, 5)], "u long, v long")).collect()}
    want = components({x for e in edges for x in e}, edges)
    assert all(got.get(k, k) == v for k, v in want.items())


def test_minhash(spark):
    rows = corpus()
    got = minhash.near_duplicates(frame(spark, rows), percent=85).collect()
    assert len(got) == len(rows)
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    links = [(a, b) for (a, s), (b, t) in itertools.combinations(sets, 2) if s and t and 100 * len(s & t) >= 85 * len(s | t)]
    want = components({i for i, _ in sets}, links)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["kept"]) == (want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert sorted(r["n_shingles"] for r in got) == sorted(len(shingles(t)) for _, t in rows)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def test_minhash_straddling_group(spark):
    """A large group whose members are linked only here and there, so that stars don't find all links."""
    rng = random.Random(11)
    base = words(rng, 150).split()
    rows = []
    for i in range(400):
        text = list(base)
        for p in rng.sample(range(150), rng.randint(2, 4)):
            text[p] = "y" + str(rng.randrange(3))
        rows.append((i, " ".join(text)))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(frame(spark, rows), percent=85).collect()}
    sets = [(i, shingles(t)) for i, t in rows]
    links = [(a, b) for (a, s), (b, t) in itertools.combinations(sets, 2) if 100 * len(s & t) >= 85 * len(s | t)]
    assert got == components({i for i, _ in rows}, links)
    assert 1 < len(set(got.values())) < 400


def test_super_minhash_estimates_jaccard():
    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (60, 20, 20))
    sig = minhash.super_minhash(np.concatenate([common, a, common, b]), np.array([0, 80, 160]), 2000)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.04
    small = minhash.super_minhash(common[:3], np.array([0, 0, 1, 3]), 50)
    assert np.isinf(small[0]).all() and np.isfinite(small[1:]).all()


def line_dedup(rows):
    def key(line):
        k = "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
        return k if len(k) >= 10 else None

    low, high = {}, {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {None} if i is not None else ():
            low[k], high[k] = min(i, low.get(k, i)), max(i, high.get(k, i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or (k := key(x)) is None or low[k] == high[k] or low[k] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup_and_index(spark):
    rows = corpus()
    both = lambda df: sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect()), key=str)
    assert both(linededup.dedup_lines(frame(spark, rows))) == line_dedup(rows)
    assert linededup.dedup_lines(frame(spark, [])).count() == 0
    first, second = [r for r in rows if r[0] is not None and r[0] < 60], [r for r in rows if r[0] is not None and r[0] >= 60]
    cols = ["doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), "text"]
    index = linededup.LineIndex.build(frame(spark, first))
    before = both(index.rewrite(frame(spark, first)).select(*cols))
    larger = index.insert(frame(spark, second)).insert(frame(spark, second[:3]))
    assert both(larger.rewrite(frame(spark, first + second)).select(*cols)) == line_dedup(first + second)
    again = larger.delete(spark.createDataFrame([(i,) for i, _ in second], "doc_id long"))
    assert both(again.rewrite(frame(spark, first)).select(*cols)) == before == line_dedup(first)
    gone = larger.delete(spark.createDataFrame([(i,) for i, _ in first], "doc_id long"))
    assert both(gone.rewrite(frame(spark, second)).select(*cols)) == line_dedup(second)


def test_line_dedup_by_filters_alone(spark):
    """Without hot keys every shared line has to pass its shard's filter; an index without filters loses them all."""
    rows = corpus()
    both = lambda df: sorted(((r["doc_id"], r["__n_lines"], r["__n_dropped"], r["text"]) for r in df.collect()), key=str)
    index = linededup.LineIndex.build(frame(spark, rows), shard_keys=3)
    assert index.shards > 3 and index.filters.count() > 3
    assert both(index.rewrite(frame(spark, rows), hot_part=0)) == line_dedup(rows) == both(index.rewrite(frame(spark, rows)))
    blind = dataclasses.replace(index, cells=(index.cells[0].limit(0),))
    assert blind.drops(hot_part=0).count() == 0 < index.drops(hot_part=0).count()


def test_filters_are_dealt_by_postings(spark):
    """One shard of few shared keys and many postings: no task holds more than its share, and nothing is lost."""
    rng = np.random.default_rng(4)
    keys = rng.integers(-(2**62), 2**62, (20000, 2))
    docs = [(1, "\n".join(["a line that stands in both", *(f"line number {i} of the first" for i in range(3))])), (2, "a line that stands in both")]
    index = linededup.LineIndex.build(frame(spark, docs))
    assert index.shards == 1
    many = spark.createDataFrame([(i, int(a), int(b)) for i, (a, b) in enumerate(keys)], "doc_id long, k1 long, k2 long").unionByName(index.postings)
    got = index.may_be_shared(many, task_postings=500)
    read = index.may_be_shared(many.where("doc_id > 2"), task_postings=500)._jdf.queryExecution().analyzed().toString()
    assert "explode(sequence(0, " in read
    shared = {tuple(r) for r in index.postings.join(index.refs.where("n >= 2"), ["k1", "k2"]).select("doc_id", "k1", "k2").collect()}
    found = {tuple(r) for r in got.collect()}
    assert shared <= found and len(found) < 400 and len(shared) == 2
    parts = many.select(F.pmod("k2", F.lit(-(-many.count() // 500))).alias("p")).groupBy("p").count()
    assert parts.agg(F.max("count")).first()[0] < 650


def test_line_index_increments(spark):
    """Increments write their own rows only, filters hold what filters made anew hold, and former versions stay."""
    rows = [r for r in corpus() if r[0] is not None]
    first, second = [r for r in rows if r[0] < 60], [r for r in rows if r[0] >= 60]
    held = lambda index: {r["shard"]: linededup.CuckooFilter.from_bytes(bytes(r["cells"])).entries() for r in index.filters.collect()}
    table = lambda df: sorted(map(tuple, df.collect()))
    drops = lambda index: table(index.drops(hot_part=0))
    index = linededup.LineIndex.build(frame(spark, first), shard_keys=4)
    larger = index.insert(frame(spark, second))
    new = larger.added[-1].count()
    assert 0 < new < larger.postings.count() and larger.counts[-1].count() <= new
    whole = linededup.LineIndex.build(frame(spark, rows), shard_keys=4)
    assert table(larger.refs) == table(whole.refs) and table(larger.postings) == table(whole.postings) and drops(larger) == drops(whole)
    back = larger.delete(spark.createDataFrame([(i,) for i, _ in second] + [(777777,), (None,)], "doc_id long"))
    assert table(back.refs) == table(index.refs) and table(back.postings) == table(index.postings) and drops(back) == drops(index)
    if back.shards == index.shards:
        assert {k: v for k, v in held(back).items() if v} == held(index)
    assert held(larger.compact()) == held(whole) and drops(larger) == drops(whole)
    nothing = larger.insert(frame(spark, second[:4]))
    assert nothing.added[-1].count() == 0 and nothing.cells[-1].count() == 0
    once_more = back.insert(frame(spark, second))
    assert table(once_more.refs) == table(whole.refs) and drops(once_more) == drops(whole)


def test_cuckoo_filter():
    rng = np.random.default_rng(1)
    k = rng.integers(-(2**62), 2**62, (20000, 2))
    f = linededup.CuckooFilter(9000)
    f.insert(k[:10000, 0], k[:10000, 1])
    f = linededup.CuckooFilter.from_bytes(f.to_bytes())
    assert f.may_hold(k[:10000, 0], k[:10000, 1]).all()
    assert f.may_hold(k[10000:, 0], k[10000:, 1]).mean() < 0.01
    f.delete(k[:5000, 0], k[:5000, 1])
    assert f.may_hold(k[5000:10000, 0], k[5000:10000, 1]).all() and f.may_hold(k[:5000, 0], k[:5000, 1]).mean() < 0.01


AWKWARD = ["", " ", "a  b", "\n a", "a \n\nb ", "x<|endoftext|>y", "it's  we'll 've", "日本語のテキスト " * 30, "a" * 3000, "ab" * 5000, " x　y", "\x1c a\x1cb \x85c", "!?" * 1000, " " * 2000, "🏽", "1234567890" * 300]


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(PATH)


def test_bpe(spark, tokenizer):
    rng = random.Random(5)
    texts = [*AWKWARD, *(t for _, t in corpus()), *("".join(rng.choice(["a", "b", " ", "  ", "\n", "'s", "é", "1", "!", " the", "😀"]) for _ in range(rng.randint(0, 60))) for _ in range(300)), "".join(rng.choice("abcdefgh") for _ in range(30000))]
    rows = [(i, t) for i, t in enumerate(texts)]
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in rows}
    assert {r["doc_id"]: r["ids"] for r in bpe.encode(frame(spark, rows), PATH).collect()} == ids
    back = bpe.decode(bpe.encode(frame(spark, rows), PATH), PATH)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: tokenizer.decode(v, skip_special_tokens=False) for i, v in ids.items()}
    for r in bpe.round_trip(frame(spark, rows), PATH).collect():
        own = ids[r["doc_id"]]
        assert r["n_tokens"] == len(own) and r["ids_sha256"] == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((texts[r["doc_id"]] or "").encode()).hexdigest()
    assert bpe.round_trip(frame(spark, []), PATH).count() == 0


def test_texts_join_from_halves(tokenizer):
    """Long texts come from halves that fall anywhere, joined by windows far smaller than the texts."""
    rng = random.Random(41)
    model = bpe.Bpe(PATH)
    kinds = ["a", "b", " ", "  ", "\n", "'s", "é", "1", "!", " the", "😀", "don't", "日本", "\t", "x" * 30, " ", "_", "--"]
    mixed = ["".join(rng.choice(kinds) for _ in range(rng.randint(3000, 9000))) for _ in range(25)]
    plain = [words(rng, 6000) for _ in range(3)]
    odd = ["a" * 20000, "日本語" * 5000, " " * 10000, "'s" * 6000, "\n" * 9000, "ab1!" * 4000, "é" * 9000, "x<|endoftext|>" * 900, words(rng, 3000) + "<|endoftext|>" + " " * 5000 + "é" * 6000 + "<|endoftext|>" + "ab " * 4000,  "12" * 5000 + " x" * 3000]
    texts = [*mixed[:10], "", "short", *plain, *odd, *mixed[10:], "last"]
    ids, ends = model.encode_column(bpe.pa.array(texts))
    assert [ids[a:z].tolist() for a, z in itertools.pairwise(ends)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert model.text_joins > 100 and model.piece_joins > 100
    model.text_joins = model.again = 0
    model.encode_column(bpe.pa.array(plain))
    assert model.text_joins >= 3 * 7 and model.again < 400 * model.text_joins
    documents = pq.read_table("/root/testdata/sf0.01/documents.parquet")["text"].to_pylist()
    model.text_joins = 0
    ids, ends = model.encode_column(bpe.pa.array([t or "" for t in documents]))
    assert model.text_joins > 0
    for t, a, z in zip(documents, ends[:-1], ends[1:], strict=True):
        if len(t or "") > bpe.LEAF_CHARS:
            assert ids[a:z].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_bpe_refuses_other_files(tmp_path):
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"model": spec["model"] | {"merges": spec["model"]["merges"][::-1]}}):
        (tmp_path / "other.json").write_text(json.dumps(spec | change), encoding="utf-8")
        with pytest.raises(ValueError):
            bpe.Bpe(str(tmp_path / "other.json"))


def test_packing(spark, tokenizer):
    rows = [*corpus(), *((1000 + i, "a b c " * (i % 7)) for i in range(300))]
    got = packing.pack(frame(spark, rows), PATH, capacity=256).collect()
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    want = []
    for i, texts in ids.items():
        for own in texts:
            head = len(own) % 256 or 256
            for n, (a, z) in enumerate([(0, head), *((a, a + 256) for a in range(head, len(own), 256))]):
                want.append((i, n, a, z - a, zlib.crc32(np.array(own[a:z], "<u4").tobytes())))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    spans = defaultdict(list)
    for r in got:
        spans[r["sequence_id"]].append((r["offset"], r["offset"] + r["length"]))
    for own in spans.values():
        own.sort()
        assert own[0][0] == 0 and own[-1][1] <= 256 and all(a[1] == b[0] for a, b in itertools.pairwise(own))
    assert len(spans) <= -(-sum(r["length"] for r in got) // 256) + 3
    assert packing.pack(frame(spark, []), PATH).count() == 0


def test_plan_is_best_fit():
    rng = random.Random(2)
    for _ in range(30):
        cap = rng.choice([7, 20, 64])
        histogram = {rng.randint(1, cap): rng.randint(1, 40) for _ in range(10)}
        bins, used = [], {}
        for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
            fit = [i for i, b in enumerate(bins) if b >= n]
            if fit:
                bins[min(fit, key=lambda i: bins[i])] -= n
            else:
                bins.append(cap - n)
        for n, runs in packing.plan_runs(histogram, cap).items():
            for (rank, seq, each, at), end in zip(runs, [*(r[0] for r in runs[1:]), histogram[n]], strict=True):
                for k in range(end - rank):
                    slots = range(at + k % each * n, at + k % each * n + n)
                    own = used.setdefault(seq + k // each, set())
                    assert not own & set(slots) and slots[-1] < cap
                    own |= set(slots)
        assert len(used) == len(bins)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, True) for i, v in rows], "vec_id long, embedding array<float>, label int, kept boolean")


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(6, 16))
    data = np.concatenate([rng.normal(size=(200, 16)), *(c + rng.normal(size=(40, 16)) * s for c, s in zip(centers, [0.05, 0.2, 0.3, 0.35, 0.4, 0.6], strict=True))])
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)] + [(1000 + i, [float(x) for x in data[250] * 2]) for i in range(50)]
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [None] + [1.0] * 15), (2004, [float("nan")] + [1.0] * 15), (2005, [1.0, 2.0]), (2006, [float("inf")] * 16), (None, [1.0] * 16)]
    got = covertree.near_vectors(vectors(spark, rows + odd), 0.9, sample=64, max_leaves=8, part=100).collect()
    x = np.array([np.float32(v) for _, v in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    ids = [i for i, _ in rows]
    comp = components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near), strict=True)])
    want = {i: (int(n), comp[i], comp[i] == i) for i, n in zip(ids, near.sum(1), strict=True)} | {i: (0, i, True) for i, _ in odd}
    assert {r["vec_id"]: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    assert covertree.near_vectors(vectors(spark, [])).count() == 0
    assert covertree.near_vectors(vectors(spark, odd)).count() == len(odd)


def test_dual_traversal_prunes():
    rng = np.random.default_rng(6)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    clustered = unit(np.concatenate([c + rng.normal(size=(300, 8)) * 0.05 for c in rng.normal(size=(20, 8)) * 3]))
    groups = [2, 3, 4, 5, 6, 7, 400]
    planted = unit(np.concatenate([rng.normal(size=(800, 64)), *(rng.normal(size=(1, 64)) + 0.05 * rng.normal(size=(k, 64)) for k in groups), rng.normal(size=(1, 64)) + 0.33 * rng.normal(size=(200, 64))]))
    for x, cosine in ((clustered, 0.995), (planted, 0.9)):
        weight = rng.integers(1, 4, len(x))
        near = x @ x.T >= cosine
        np.fill_diagonal(near, False)
        tree = covertree.CoverTree(x)
        links = covertree.Links(weight)
        work = covertree.dual_traversal(tree, tree, cosine, links)
        root, u = links.roots(), np.arange(len(x))
        while (low := np.where(near | np.eye(len(x), dtype=bool), u[None, :], len(x)).min(1)).tolist() != u.tolist():
            u = low
        assert (links.count == near @ weight).all() and (root == u).all()
        assert work.multiplied < len(x) ** 2 / 4 and work.pruned + work.counted > 0
        # two trees: every link between their points, none of a tree with itself
        links = covertree.Links(np.concatenate([weight[::2], weight[1::2]]))
        covertree.dual_traversal(covertree.CoverTree(x[::2]), covertree.CoverTree(x[1::2]), cosine, links, len(x[::2]))
        across = near[::2, 1::2]
        assert (links.count == np.concatenate([across @ weight[1::2], across.T @ weight[::2]])).all()
    assert work.counted >= sum(k * k for k in groups) / 2  # groups of copies are counted, not multiplied


def test_cover_tree_levels():
    """Centers of a level lie apart, members within their center's measured radius, nodes hold what their children hold."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(300, 6)), *(rng.normal(size=(1, 6)) * 4 + 0.1 * rng.normal(size=(60, 6)) for _ in range(8))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    tree = covertree.CoverTree(x, leaf_points=8)
    assert sorted(tree.order) == list(range(len(x)))
    todo, depth = [tree.root], 0
    while todo:
        node = todo.pop()
        members = tree.order[node.first : node.last]
        far = np.linalg.norm(x[members] - x[node.center], axis=1)
        assert far.max() <= node.radius + 1e-6
        if node.children:
            depth += 1
            assert sorted(p for c in node.children for p in tree.order[c.first : c.last]) == sorted(members)
            level = [c.center for c in node.children if c.reach > tree.tight]
            gaps = np.linalg.norm(x[level][:, None] - x[level][None], axis=2) + 4 * np.eye(len(level))
            assert gaps.size == 0 or gaps.min() > max(c.reach for c in node.children) - 1e-9
            assert all(c.reach <= node.reach / 2 for c in node.children)
            todo += node.children
    assert depth > 8


def test_near_vectors_of_several_lengths_and_hot_groups(spark):
    rng = np.random.default_rng(12)
    rows, first = [], 0
    for size, groups in ((16, [1] * 60 + [2, 3, 7, 150]), (5, [1] * 20 + [4, 90]), (3, [2, 1])):
        for k in groups:
            center = rng.normal(size=size)
            for _ in range(k):
                rows.append((first, [float(x) for x in center + 0.05 * rng.normal(size=size)]))
                first += 1
    rows += [(first + k, rows[100][1]) for k in range(200)]  # a third are copies of one
    rows += [(3, rows[70][1]), (3, None), (9000, None), (9000, [0.0, 0.0])]  # repeated vec_ids
    got = covertree.near_vectors(vectors(spark, rows), 0.9, sample=100, max_leaves=6, part=40, populous=6).collect()
    ids = [i for i, _ in rows]
    unit = [None if v is None or not any(v) else np.float32(v).astype(float) / np.linalg.norm(np.float32(v).astype(float)) for _, v in rows]
    near = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    comp = components(set(ids), [(ids[a], ids[b]) for a, b in near])
    n_links = defaultdict(int)
    for a, b in near:
        n_links[a] += 1
        n_links[b] += 1
    want = sorted((i, n_links[k], comp[i], comp[i] == i) for k, (i, _) in enumerate(rows))
    assert sorted(tuple(r) for r in got) == want
    assert max(n_links.values()) > 200


def next_texts(rows):
    known = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0])
    return {a[0]: (a[1] or "", b[1] or "") for a, b in zip(known, known[1:] + known[:1], strict=True)}


def test_fingerprints(spark):
    rows = [r for i, r in enumerate(corpus()) if r[0] is not None and i < 111]
    got = fingerprint.with_next(frame(spark, rows), ranges=7, chars=4000).collect()
    pairs = next_texts(rows)
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r["fingerprint"] for r in got}
    order = sorted((i for i, _ in rows), reverse=True)
    after_id = dict(zip(order, order[1:] + order[:1], strict=True))
    for r in got:
        text, after = pairs[r["doc_id"]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert (r["n_chars"], r["edited_text"]) == (len(text), edited)
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (text == edited)
        # the strings alone give the likeness and the paragraphs that differ
        digests = [set(fingerprint.paragraph_digests(fingerprint.pa.array([t]))[0].tolist()) for t in (text, edited, after)]
        for other, string, value in ((digests[1], r["edited_fingerprint"], r["near_edited"]), (digests[2], by_id[after_id[r["doc_id"]]], r["near_next"])):
            near, mine, theirs = fingerprint.compare(r["fingerprint"], string)
            assert near == value == (1 - len(digests[0] ^ other) / (len(digests[0]) + len(other)) if digests[0] or other else 1.0)
            assert mine == sorted(digests[0] - other) and theirs == sorted(other - digests[0])
    by_text = defaultdict(set)
    for r in got:
        by_text[pairs[r["doc_id"]][0]].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and len({x for v in by_text.values() for x in v}) == len(by_text)
    assert fingerprint.with_next(frame(spark, [])).count() == 0
    alone = fingerprint.with_next(frame(spark, [(5, "a b")])).first()
    assert alone["near_next"] == 1 and alone["edited_text"] == "a a"
    many = [*corpus(), *((None, f"no id {i}") for i in range(60)), *((None, None) for _ in range(40))]
    assert fingerprint.with_next(frame(spark, many)).count() == len(many)


def test_fingerprints_find_the_changed_lines():
    """Lines are paragraphs (of one or several pieces): what a changed line adds and takes away comes out, and nothing else."""
    rng = random.Random(31)
    for n, changed in ((1, 1), (40, 1), (40, 7), (300, 300), (3000, 2)):
        line = lambda i: " ".join(f"{i}w{rng.randrange(10**9)}" for _ in range(10))
        old = [line(i) for i in range(n)]
        new = list(old)
        for i in rng.sample(range(n), changed):
            new[i] = line(i)
        pieces = lambda lines: {d for x in lines for d in fingerprint.paragraph_digests(fingerprint.pa.array([x + "\n"]))[0].tolist()}
        prints = []
        for lines in (old, new):
            text = "".join(x + "\n" for x in lines)
            prints.append(fingerprint.Prints.of(*fingerprint.paragraph_digests(fingerprint.pa.array([text]))).strings([text])[0])
        near, gone, come = fingerprint.compare(*prints)
        before, after = pieces(old), pieces(new)
        assert (gone, come) == (sorted(before - after), sorted(after - before))
        total = sum(len(fingerprint.paragraph_digests(fingerprint.pa.array([x + "\n"]))[0]) for x in old + new)
        assert near == 1 - (len(gone) + len(come)) / total
    with pytest.raises(ValueError):
        fingerprint.compare(prints[0], prints[1].replace("-3000-", "-2999-").replace(prints[1].split("-")[1], "1"))


def test_sketches_fold_and_peel():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 60, 900):
        a, b = (fingerprint._checked(rng.integers(1, 2**63, n, dtype=np.uint64)) for _ in range(2))
        common = fingerprint._checked(rng.integers(1, 2**63, 500, dtype=np.uint64))
        zero = lambda x: np.zeros(len(x), np.int64)
        one, two = (fingerprint.Sketches.of(np.concatenate([x, common]), zero(np.concatenate([x, common])), np.array([t])) for x, t in ((a, 12), (b, 10)))
        small = one.fold(np.array([10]))
        direct = fingerprint.Sketches.of(np.concatenate([a, common]), zero(np.concatenate([a, common])), np.array([10]))
        assert (small.count == direct.count).all() and (small.key == direct.key).all()
        gap = small.minus(two)
        assert abs(gap.guess()[0] - 2 * n) <= 0.2 * n + 3
        _, digest, sign, whole = gap.peel()
        assert whole.all() and set(digest[sign > 0].tolist()) == set(a.tolist()) and set(digest[sign < 0].tolist()) == set(b.tolist())


def language_rows(n=60, seed=1):
    rng = random.Random(seed)
    kinds = {"aa": "abcde", "bb": "fghij", "cc": "klmné"}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(kinds))
        rows.append((i, " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randint(2, 7))) for _ in range(40)), lang))
    return rows


def test_language_id(spark):
    rows = language_rows() + [(1000, None, "aa"), (1001, "123 !", "bb"), (1002, "", None), (None, "abc abc", "aa"), (1003, "abcde edcba", None)]
    docs = spark.createDataFrame([(i, t, g, 1.0) for i, t, g in rows], "doc_id long, text string, lang string, score double")
    got = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert len(got) == len(rows)
    for i, t, g in rows:
        assert got[i]["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i]["score"] <= 1
        if not re.search(r"[^\W\d_]", t or ""):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
        elif g:
            assert got[i]["lang_pred"] == g
    assert got[1003]["lang_pred"] == "aa"
    # very long and repeated rows are judged each, by the whole text
    long = spark.createDataFrame([(2000, "abc abd " * 200_000, None, 1.0), (1003, "abcde edcba", "zz", 1.0), (1003, "abcde edcba", None, 1.0)], docs.schema)
    more = sorted((r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(long, langid.fit(docs)).collect())
    assert more[0] == more[1] == (1003, "aa", got[1003]["score"]) and more[2][:2] == (2000, "aa")
    # labels of held-out rows change nothing
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, "zz").otherwise(F.col("lang")))
    again = {r["doc_id"]: r for r in langid.predict(docs, langid.fit(other)).collect()}
    assert again == got
    empty = docs.limit(0)
    assert langid.predict(empty, langid.fit(empty)).count() == 0
    assert {r["lang_pred"] for r in langid.predict(docs, langid.fit(empty)).collect()} == {"und"}


def test_language_profiles_by_counting(spark):
    """Profiles hold the most frequent n-grams of all rows that may be learned from, however many languages there are."""
    rng = random.Random(77)
    rows = language_rows(80, 4) + [(5000 + i, words(rng, 6), f"l{i:03}") for i in range(120)]
    docs = spark.createDataFrame([(i, t, g, 1.0) for i, t, g in rows], "doc_id long, text string, lang string, score double")
    model = langid.fit(docs, profile_size=30)
    code = lambda g: sum((0 if c == " " else ord(c)) << 21 * (len(g) - 1 - k) for k, c in enumerate(g)) | ((1 << 62) if len(g) == 2 else 0)
    counts = defaultdict(lambda: defaultdict(int))
    for i, text, lang in rows:
        if zlib.crc32(str(i).encode()) % 5:
            s = " " + re.sub(r"[^a-zé]+", " ", text.lower()) + " "
            for n in (1, 2, 3):
                for k in range(len(s) - n + 1):
                    g = s[k : k + n]
                    if g != " " and not (n == 3 and g[1] == " "):
                        counts[lang][code(g)] += 1
    assert model.languages == sorted(counts) and len(counts) > 80
    for k, lang in enumerate(model.languages):
        want = sorted(counts[lang], key=lambda g: (-counts[lang][g], g))[:30]
        own = {int(model.grams[j]): int(r) for j, r in enumerate(model.ranks[k][:-1]) if r >= 0}
        assert [g for g, _ in sorted(own.items(), key=lambda x: x[1])] == want


def test_rank_order_distance():
    rng = random.Random(8)
    text, profiles = words(rng, 80), {"x": words(rng, 200), "y": words(rng, 150)}

    def ranked(t):
        count = defaultdict(int)
        s = " " + re.sub(r"[^a-z]+", " ", t.lower()) + " "
        for n in (1, 2, 3):
            for i in range(len(s) - n + 1):
                g = s[i : i + n]
                if g != " " and not (n == 3 and g[1] == " "):
                    count[g] += 1
        code = lambda g: sum((0 if c == " " else ord(c)) << 21 * (len(g) - 1 - k) for k, c in enumerate(g)) | ((1 << 62) if len(g) == 2 else 0)
        return [code(g) for g in sorted(count, key=lambda g: (-count[g], code(g)))][:50]

    model = langid.Profiles.of({k: ranked(v) for k, v in profiles.items()}, 50)
    own = ranked(text)
    far = {k: sum(min(50, abs(ranked(v).index(g) - i)) if g in ranked(v) else 50 for i, g in enumerate(own)) for k, v in profiles.items()}
    best = min(far, key=lambda k: (far[k], k))
    assert model.predict(text) == (best, 1 - far[best] / (50 * len(own)))


def toxic_tables(spark, n=600, seed=3):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        text = words(rng, rng.randint(20, 60)).split()
        if toxic:
            for _ in range(3):
                text.insert(rng.randrange(len(text)), rng.choice(["zzidiot", "wretchzz", "qqscum"]) + rng.choice(["", "a", "bb"]))
        docs.append((i, " ".join(text)))
        if rng.random() < 0.5:
            labels.append((i, int(toxic)))
    truth = {i: any(k in t for k in ("zzidiot", "wretchzz", "qqscum")) for i, t in docs}
    return frame(spark, docs + [(5000, None), (5001, ""), (None, "zzidiot")]), spark.createDataFrame([*labels, (99999, 1), (None, 1)], "doc_id long, toxic int"), truth


def test_toxicity(spark):
    docs, labels, truth = toxic_tables(spark)
    got = {r["doc_id"]: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values()) and len(got) == len(truth) + 3
    wrong = [i for i, t in truth.items() if got[i]["predicted"] != t]
    assert len(wrong) <= 0.02 * len(truth)
    # very long and repeated rows: a word among very many does not make a text toxic, many do
    model = toxicity.fit(docs, labels)
    fine = words(random.Random(8), 4000)
    long = [(1, "zzidiot qqscum " * 100_000), (2, fine + " zzidiot " + fine), (3, "zzidiot wretchzz"), (3, "zzidiot wretchzz")]
    more = sorted((r["doc_id"], r["predicted"]) for r in toxicity.score(frame(spark, long), model).collect())
    assert more == [(1, 1), (2, 0), (3, 1), (3, 1)]
    none = toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 0")))
    assert {r["score"] for r in none.collect()} == {0.0}
    assert toxicity.score(docs.limit(0), toxicity.fit(docs.limit(0), labels)).count() == 0


def test_packed_grams():
    for text in ("", "a", "some words and words again", "日本語 text " * 50):
        buckets = toxicity.gram_buckets(text)
        here, counts = toxicity.unpack_grams(toxicity.pack_grams(buckets))
        assert np.repeat(here, counts).tolist() == sorted(buckets.tolist())


def test_nnpu_risk_and_gradient():
    """The risk by its definition, a row at a time, and its gradient by differences; below zero the rest is driven up."""
    rng = np.random.default_rng(3)
    loss = lambda z: float(np.log1p(np.exp(-z)))  # noqa: E731  of a row that should be positive
    signs = set()
    for prior in (0.1, 0.5, 0.9):
        for scale in (0.1, 1.0, 4.0):
            p, u, w = rng.random((7, 4)), rng.random((9, 4)) * (-1.0 if scale > 1 else 1.0), np.abs(rng.normal(size=4)) * scale

            def parts(w, p=p, u=u, prior=prior):
                up = prior * np.mean([loss(x @ w) for x in p])
                return up, np.mean([loss(-(x @ w)) for x in u]) - prior * np.mean([loss(-(x @ w)) for x in p])

            risk, rest, grad = toxicity.nnpu_risk(w, p, u, prior)
            up, own = parts(w)
            assert abs(rest - own) < 1e-9 and abs(risk - (up + max(0, own))) < 1e-9
            target = (lambda w, f=parts: sum(f(w))) if own >= 0 else (lambda w, f=parts: -f(w)[1])
            steps = np.eye(4) * 1e-6
            assert np.allclose(grad, [(target(w + d) - target(w - d)) / 2e-6 for d in steps], atol=1e-5)
            signs.add(own >= 0)
    assert signs == {True, False}


def test_nnpu_risk_corrects_for_the_prior():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    x = (rng.random((4000, 6)) < np.where(y[:, None], [0.9, 0.8, 0.5, 0.5, 0.5, 0.5], [0.1, 0.1, 0.5, 0.5, 0.5, 0.5])).astype(np.float32)
    w = toxicity.train_nnpu(x[y][:400], x, 0.3)
    assert ((x @ w[:-1] + w[-1] > 0) == y).mean() > 0.9


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>One<p>Two  <b>bold</b>\n text<br>next", "One\n\nTwo bold text\nnext"),
        ("<head><title>T</title><style>p{}</style></head><body>x<script>var t='</p>';</script>y</body>", "xy"),
        ("<div>a</div><div>b</div><div hidden>c</div><span style='display: none'>d</span>", "a\nb"),
        ("<ul><li>one<li>two<ol start=3><li>x<li>y</ol></ul>z", "- one\n- two\n\n  3. x\n  4. y\n\nz"),
        ("<table><tr><th>Name<th>N<tr><td>apple<td>10</table>", "Name   N\napple  10"),
        ("<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>日本</td><td>c</td></tr></table>", "a  b\n   日本  c"),
        ("<pre>  keep\n   this </pre>after", "  keep\n   this\n\nafter"),
        ("<h1>Head</h1>text<!-- no --><blockquote>q</blockquote>", "Head\n\ntext\n\n> q"),
        ("<dl><dt>t<dd>d</dl>1 < 2 <notatag", "t\n    d\n\n1 < 2"),
        ("<a href='x>y'>in</a><input type=hidden value=v><img alt=pic>", "inpic"),
        ("<div>" * 3000 + "deep", "deep"),
        ("<p class=\"a>one<p>two", "one\n\ntwo"),
    ],
)
def test_html(html, text):
    assert htmltext.html_text(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        ("a <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>tex</annotation></math> b", "a x=1 b"),
        ("<svg><title>no</title><defs><text>no</text></defs><text>one</text><path d='M0'/><text>two</text></svg>after", "one\ntwo\nafter"),
        ("<svg><defs/><text>one</text><p>out", "one\n\nout"),
        ("<svg><foreignObject><p>in</p></foreignObject><metadata>no</metadata></svg><metadata>yes</metadata>", "in\n\nyes"),
        ("<b>" * 250 + "<span hidden>no<i>no</i>no</span>yes<i hidden>no", "yes"),
        ("<div hidden>" + "<b>" * 250 + "<div>no</div>no" + "</b>" * 250 + "no</div>yes", "yes"),
        ("<ul><li>a" + "<b>" * 250 + "<ul><li hidden>no<li>yes</ul>" + "</b>" * 250 + "<li>z</ul>", "- a\n\n  - yes\n- z"),
    ],
)
def test_html_foreign_and_deep(html, text):
    assert htmltext.html_text(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        # an end tag reaches nothing beyond the cell it stands in
        ("<div><table><tr><td>a</div></td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table></div>", "a  b\nc  d"),
        ("<ul><li>x<table><tr><td>a</li></ul></span></td><td>b</table><li>y</ul>z", "- x\n\n  a  b\n- y\n\nz"),
        ("<div>a<span>b<p>c</span>d</p></div>", "ab\n\ncd"),
        # visibility is inherited and taken back
        ("<div style='visibility:hidden'>a<b style='visibility: visible'>c</b>d</div>e", "c\ne"),
        ("<table style='visibility:hidden'><tr><td>a<td style='visibility:visible'>b</table>", "b"),
        ("<p style='color:red; display:none'>a</p><p style='display:none;display:block'>b</p>", "b"),
        ("<span style='display:block'>a</span>b<div style='display:inline'>c</div>", "a\nbc"),
        ("a<details><summary>more</summary>hidden <p>text</details><details open><summary>s</summary>t</details>", "a\nmore\ns\nt"),
        ("<ol><li value=7>a<li>b<li hidden>no<li value=x>c</ol>", "7. a\n8. b\n9. c"),
        ("<ol reversed><li>a<li>b<li>c</ol><ol start=-1><li>x<li>y</ol>", "3. a\n2. b\n1. c\n\n-1. x\n0. y"),
        ("<input type=number value=5> <input type=password value=x> <input type=checkbox value=y><input value=z>", "5 z"),
        # heads end where a body must begin, CDATA is text in svg and math only
        ("<head><title>T</title>seen<p>too", "seen\n\ntoo"),
        ("<title>a</title><meta x><link y><a href=z>b</a>", "b"),
        ("a<![CDATA[no]]>b<svg><text><![CDATA[yes]]></text></svg>", "ab\nyes"),
        ("<blockquote><p>a<p>b<blockquote>c</blockquote></blockquote>d", "> a\n>\n> b\n>\n> > c\n\nd"),
        # spans
        ("<table><tr><td colspan=2>wide one<td>c<tr><td>a<td>b<td>c</table>", "wide one  c\na  b  c"),
        ("<table><tr><td colspan=1000 rowspan=9>x<td>y<tr><td>z</table>", "x  y\n   z"),
        ("<table><caption>Cap</caption><tr><td>a<br>b<td>c</table>", "Cap\na  c\nb"),
        # deep nesting loses nothing
        ("<div>" * 205 + "<p hidden>secret</p>seen", "seen"),
        ("<b>" * 5000 + "<ul><li>a<li hidden>no<li><table><tr><td>x<td>y</table></ul>" + "</b>" * 5000 + "<span hidden>no</span>z", "- a\n- x  y\n\nz"),
        ("<table><tr><td>a<td>" * 12 + "end", None),
    ],
)
def test_html_rules(html, text):
    got = htmltext.html_text(html)
    assert got == text if text is not None else got.split() == ["a"] * 12 + ["end"]


def test_html_counters():
    assert [htmltext.counter(n, "a") for n in (1, 26, 27, 52, 53, 702, 703, 0, -2)] == ["a", "z", "aa", "az", "ba", "zz", "aaa", "0", "-2"]
    assert [htmltext.counter(n, "I") for n in (1, 4, 9, 14, 40, 1994, 3999, 4000)] == ["I", "IV", "IX", "XIV", "XL", "MCMXCIV", "MMMCMXCIX", "4000"]
    assert htmltext.html_text("<ol type=a><li>x<li>y<li type=i value=4>z</ol><ol type=A start=28><li>q</ol>") == "a. x\nb. y\niv. z\n\nAB. q"


@pytest.mark.parametrize(("html", "text"), [('abc <a href="x', "abc"), ("abc </p", "abc"), ("abc <!-", "abc"), ("a < b", "a < b"), ("1 <2", "1 <2"), ("x <b>y</b> <i", "x y"), ("a < b <c d='>", "a < b")])
def test_html_tags_cut_off(html, text):
    assert htmltext.html_text(html) == text


def test_html_without_limits():
    """The exact way: wide tables are aligned, tables within tables too, lists nest without end."""
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    wide = "<table>" + row("a" * 500, "b") + row("c", "d") + "</table>"
    assert htmltext.html_text(wide, htmltext.EXACT) == "a" * 500 + "  b\n" + "c" + " " * 501 + "d"
    assert htmltext.html_text(wide) == "a" * 500 + "  b\nc  d"
    deep = "".join(f"<ul><li>{i}" for i in range(60))
    assert htmltext.html_text(deep, htmltext.EXACT).split("\n")[-1] == " " * 118 + "- 59" and htmltext.html_text(deep).split("\n")[-1] == " " * 80 + "- 59"
    nested = "<table>" + row("x", "yy") + row("zzz", "w") + "</table>"
    for _ in range(10):
        nested = "<table>" + row(nested, "e") + "</table>"
    assert htmltext.html_text(nested, htmltext.EXACT) == "x    yy  " + "e  " * 9 + "e\nzzz  w"


def test_html_query_has_no_limits(spark, tmp_path):
    """Wide tables, long indentation and many tables within tables look as narrow and shallow ones do."""
    row = lambda *cells: "<tr>" + "".join(f"<td>{c}</td>" for c in cells) + "</tr>"
    wide = "<table>" + row("a" * 500, "b") + row("c", "d") + "</table>"
    deep = "".join(f"<ul><li>{i}" for i in range(60))
    nested = "<table>" + row("x", "yy") + row("zzz", "w") + "</table>"
    for _ in range(20):
        nested = "<table>" + row(nested, "e") + "</table>"
    spark.createDataFrame([(1, "u", wide), (2, "u", deep), (3, "u", nested), *((i, "u", "<blockquote>x" * 1500) for i in range(4, 7))], "page_id long, url string, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r["text"] for r in queries.op4_html_extraction(spark, str(tmp_path)).collect()}
    assert got[1] == "a" * 500 + "  b\n" + "c" + " " * 501 + "d"
    assert got[2].split("\n") == [line for i in range(60) for line in ([""] if i else []) + ["  " * i + f"- {i}"]]
    quotes = "\n".join(line for i in range(1, 1501) for line in ([("> " * (i - 1)).rstrip(" ")] if i > 1 else []) + ["> " * i + "x"])
    assert [got[i] == quotes for i in range(4, 7)] == [True] * 3  # each of more than a batch
    assert got[3] == "x    yy  " + "e  " * 19 + "e\nzzz  w"


def test_html_without_limits_is_fast_on_deep_pages():
    began = __import__("time").perf_counter()
    assert htmltext.html_text("<ul><li>" * 50000 + "end", htmltext.EXACT) == "- " * 50000 + "end"
    assert htmltext.html_text("<table><tr><td>x" * 5000, htmltext.EXACT) == "\n".join("x" * 5000)
    assert __import__("time").perf_counter() - began < 10


def test_html_deep_pages_keep_every_word():
    for piece in ("<div>x ", "<ul><li>x ", "<blockquote>x ", "<table><tr><td>x<td>", "<b>x ", "<dl><dd>x ", "<table><tr><td rowspan=9 colspan=3>x "):
        got = htmltext.html_text(piece * 3000)
        assert got.count("x") == 3000 and max(map(len, got.split("\n"))) < 10000


def test_html_against_another_parser():
    """All text of the pages, in order, as the standard library's tokeniser finds it."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.off, self.words = [], []

        def handle_starttag(self, tag, attrs):
            a = dict(attrs)
            if self.off or tag in ("head", "script", "style", "template", "noscript") or "hidden" in a or "display:none" in a.get("style", "").replace(" ", ""):
                if tag not in htmltext.VOID:
                    self.off.append(tag)
            elif tag == "img":
                self.words += (a.get("alt") or "").split()
            elif tag in htmltext.BLOCK:
                self.words.append("")

        def handle_endtag(self, tag):
            if tag in self.off:
                del self.off[self.off.index(tag) :]

        def handle_data(self, data):
            if not self.off:
                self.words += data.split()

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    assert len(pages) > 100
    for page in pages:
        other = Words()
        other.feed(page or "")
        other.close()
        plain = lambda ws: "".join(w for w in ws if not re.fullmatch(r"-|>|\d+\.", w))
        assert plain(htmltext.html_text(page).split()) == plain(other.words)


@pytest.mark.parametrize("piece", ["<a \"", "<a '", "<a ", "<!", "&", "<a \"x\" ", "<table><tr><td>", "</p>", "<ul><li>", "<a b=\"'", "<title>", "<title>x</title>", "<p></span>", "<div></b>", "<blockquote>y", "<tr><td rowspan=65000 colspan=1000>x", "<table><tr><td>x</td><td>", "<details>"])
def test_html_is_fast_on_broken_pages(piece):
    began = __import__("time").perf_counter()
    htmltext.page_text(piece * 20000)
    assert __import__("time").perf_counter() - began < 20


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", "<title>A\n b</title>x"), (None, "u", None), (1, "u", "<p>")], "page_id long, url string, html string")
    assert sorted(((str(r["page_id"]), r["title"], r["text"]) for r in htmltext.extract(pages).collect()), key=str) == sorted([("1", "A b", "x"), ("None", None, ""), ("1", None, "")], key=str)
    assert htmltext.extract(pages.limit(0)).count() == 0
    clash = pages.withColumns({"title": F.lit(1), "text": F.lit("other"), "lines": F.lit(2.0)})
    assert sorted(map(str, htmltext.extract(clash).collect())) == sorted(map(str, htmltext.extract(pages).collect()))


def test_licenses(spark):
    notice = licenses.TEMPLATES["MIT-text"]
    commented = "\n".join(" * " + " ".join(notice.split()[i : i + 9]) for i in range(0, len(notice.split()), 9))
    edited = notice.split()
    edited[20:22] = ["changed", "by", "us"]
    rows = [(1, "words before. Licensed under the Apache License, version 2.0. words after"), (2, commented), (3, " ".join(edited) + " tail"), (4, "licensed under the moon, version 2"), (5, None), (6, ""), (7, "Released under the MIT license!\nx y z\nReleased under the MIT License."), (7, notice)]
    got = licenses.scan(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["license"]) for r in got) == [(1, "Apache-2.0"), (2, "MIT-text"), (3, "MIT-text"), (7, "MIT"), (7, "MIT"), (7, "MIT-text")]
    for r in got:
        assert r["coverage"] >= 0.8 and any(i == r["doc_id"] and (t or "")[r["start"] : r["end"]] == r["matched"] for i, t in rows)
    one = next(r for r in got if r["doc_id"] == 1)
    assert one["matched"] == "Licensed under the Apache License, version 2.0." and one["coverage"] == 1
    assert licenses.scan(frame(spark, [])).count() == 0


def most_in_order(template, text, shift, low, high, band=8):
    """Words matched in order within the band, by every choice: the most, then the shortest span, then the earliest."""
    best = {-1: (0, 0, 0)}  # last text place used -> (matched, -length, -first); of one place only the best matters
    firsts = {-1: None}
    for i, word in enumerate(template):
        new, new_firsts = dict(best), dict(firsts)
        for j in range(max(low, i + shift - band), min(high, i + shift + band + 1)):
            if text[j] == word:
                for k, (m, _, _) in best.items():
                    if k < j:
                        first = j if firsts[k] is None else firsts[k]
                        value = (m + 1, first - j - 1, -first)
                        if j not in new or value > new[j]:
                            new[j], new_firsts[j] = value, first
        best, firsts = new, new_firsts
    return max(best.values())


def test_alignment_against_every_choice():
    rng = random.Random(19)
    for _ in range(300):
        template = [rng.randrange(4) for _ in range(rng.randint(1, 14))]
        text = [rng.randrange(5) for _ in range(rng.randint(1, 40))]
        if rng.random() < 0.6:
            at = rng.randint(0, len(text))
            text[at:at] = [w for w in template if rng.random() < 0.9]
        shifts = np.arange(-3, len(text))
        low, high = rng.choice([0, 2]), rng.choice([len(text), max(0, len(text) - 2)])
        which, matched, first, past = licenses.align(np.array(template, np.uint64), np.array(text, np.uint64), shifts, 0.5 * len(template), low, high)
        got = dict(zip(shifts[which].tolist(), zip(matched.tolist(), first.tolist(), past.tolist(), strict=True), strict=True))
        for shift in shifts.tolist():
            m, length, begin = most_in_order(template, text, shift, low, high)
            if m and m >= 0.5 * len(template):
                assert got[shift] == (m, -begin, -begin - length)
            else:
                assert shift not in got


def test_licenses_without_index():
    """Damaged notices are found exactly where alignment at every place finds them."""
    rng = random.Random(23)
    index = licenses.Index()
    for t in range(len(index.names)):
        template, own = index.words[t], index.codes[t]
        n = len(template)
        for _ in range(6 if n < licenses.SHORT else 2):
            gone = set(rng.sample(range(n), rng.randint(0, n // 5))) if n < licenses.SHORT else set(range(rng.randrange(5), n, 5)) if n % 5 == 0 else set(range(4, n, 5))
            words = ["x"] * 40 + [w for p, w in enumerate(template) for w in (["y"] if p in gone else [*["z"] * (n < licenses.SHORT and p % 3 == 1), w])] + ["x"] * 40
            text = index.code(words)
            best = licenses.align(own, text, np.arange(len(words)), 0.8 * n)[1].max(initial=0)
            assert best >= 0.8 * n
            if n < licenses.SHORT:
                assert best == max(most_in_order(template, words, s, 0, len(words))[0] for s in range(20, 60))
            single = [(k, u, p) for k, w in enumerate(words) for u, p in index.word_at.get(int(text[k]), [])]
            grams, _ = licenses.gram_hashes(text, np.array([0, len(words)]), licenses.GRAM)
            hits = [(int(k), u, p) for k in index.hits(grams) for u, p in index.at[int(grams[k])]]
            only = [h for h in hits + single if h[1] == t]
            assert [round(c * n) for _, _, u, c in licenses.scan_words(text, only, index) if u == t] == [best], index.names[t]


def test_winnowing():
    """Every window holds a chosen place, the last smallest one; runs that matches keep, by counting."""
    rng = np.random.default_rng(3)
    for n, window in ((1, 2), (2, 2), (30, 2), (30, 5), (200, 7), (5, 9), (0, 3)):
        hashes = rng.integers(0, 6, n, dtype=np.uint64)
        want = {a + window - 1 - int(np.argmin(hashes[a : a + window][::-1])) for a in range(max(0, n - window + 1))} if n > window else {n - 1 - int(np.argmin(hashes[::-1]))} if n else set()
        assert set(licenses.winnow(hashes, window).tolist()) == want
    for n in (5, 15, 16, 23):
        lost = n - -(-8 * n // 10)
        longest = min(max(len(r) for r in "".join("x" if p in gone else "." for p in range(n)).split("x")) for gone in map(set, itertools.combinations(range(n), lost)))
        assert licenses.kept_run(n) == longest
    index = licenses.Index()
    held = sum(map(len, index.at.values()))
    assert held < 0.75 * sum(len(w) - 2 for t, w in enumerate(index.words) if not index.is_short(t))


def test_license_recall():
    """Edited licenses of every length: those at 0.8 of coverage that alignment at every place finds, the index finds too."""
    rng = random.Random(31)
    index = licenses.Index({k: v for k, v in licenses.ALL_TEMPLATES.items() if len(v) < 20000})
    found = asked = 0
    for t, words in enumerate(index.words):
        for _ in range(8 if len(words) < 500 else 1):
            rate, out = rng.choice([0.05, 0.1, 0.15, 0.19]), []
            for w in words:
                act = rng.random()
                out += [] if act < rate / 2 else ["changed"] if act < rate else [w, "inserted"] if act < rate * 1.3 else [w]
            text = index.code(["before"] * 12 + out + ["after"] * 12)
            shifts = np.arange(-8, len(text))
            if not len(licenses.align(index.codes[t], text, shifts, 0.8 * len(words))[0]):
                continue
            asked += 1
            grams, _ = licenses.gram_hashes(text, np.array([0, len(text)]), licenses.GRAM)
            hits = [(int(k), u, p) for k in index.hits(grams) for u, p in index.at[int(grams[k])]] + [(k, u, p) for k in index.hits(text, single=True).tolist() for u, p in index.word_at[int(text[k])]]
            found += bool(licenses.scan_words(text, [h for h in hits if h[1] == t], index))
    assert asked > 100 and found >= 0.99 * asked


def test_license_files_and_repeated_phrases(spark):
    whole = {k: v for k, v in licenses.ALL_TEMPLATES.items() if k.endswith("-license")}
    rows = [(i, "Copyright (c) 2020 Somebody\n\n" + v + "\nend of file") for i, v in enumerate(whole.values())]
    rows += [(100, " ".join(whole.values())), (101, " ".join([licenses.TEMPLATES["MIT-text"]] * 3))]
    got = sorted((r["doc_id"], r["license"], r["coverage"]) for r in licenses.scan(frame(spark, rows)).collect())
    assert got == sorted([*((i, k, 1.0) for i, k in enumerate(whole)), *((100, k, 1.0) for k in whole), *[(101, "MIT-text", 1.0)] * 3])
    began = __import__("time").perf_counter()
    licenses.scan(frame(spark, [(1, "to any person obtaining a copy of this software " * 5000), (2, "in the software without restriction including without limitation the rights to use " * 3000)])).collect()
    assert __import__("time").perf_counter() - began < 60


def test_licenses_short_and_alike(spark):
    rows = [(1, "Released under MIT License"), (2, "x Released under the terms of the MIT License. y"), *((3, licenses.TEMPLATES[k]) for k in ("GPL-3.0-notice", "CC-BY-4.0")), (4, "Released under the MIT License. Released under MIT License.")]
    got = licenses.scan(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["license"], r["coverage"]) for r in got) == [(1, "MIT", 0.8), (2, "MIT", 1.0), (3, "CC-BY-4.0", 1.0), (3, "GPL-3.0-notice", 1.0), (4, "MIT", 0.8), (4, "MIT", 1.0)]
    many = licenses.scan(frame(spark, [(1, "Released under the MIT License. " * 3000)])).collect()
    assert len(many) == 3000 and {r["coverage"] for r in many} == {1.0}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    got = queries.QUERIES[name](spark, sf).select(*want.columns)
    assert sorted(map(str, want.fetchall())) == sorted(str(tuple(r)) for r in got.collect())
