"""Whitening, Merkle manifests and WARC archives against brute force, on small tables with every awkward case."""

import base64
import glob
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest

from shirabe.llm import common, merkle, warc, whitening


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Merkle manifests


def tree(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
        out.append(nodes)
    return out


def climb(levels, place, digest):
    siblings = []
    for row in levels[:-1]:
        a, o = place - place % 3, place % 3
        run = row[a : a + 3]
        siblings += run[:o] + run[o + 1 :]
        digest = sha("".join(run[:o] + [digest] + run[o + 1 :]))
        place //= 3
    return siblings, digest


def leaf_of(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def manifest(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    members = {s: sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r))) for s in order}
    trees = {s: tree([leaf_of(r) for r in members[s]]) for s in order}
    top = tree([trees[s][-1][0] for s in order]) if order else []
    out = []
    for k, s in enumerate(order):
        for place, r in enumerate(members[s]):
            even = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            own, digest = climb(trees[s], place, leaf_of((*r[:4], r[4].replace("\n", ""))) if even else leaf_of(r))
            above, digest = climb(top, k, digest)
            out.append((r[0], leaf_of(r), trees[s][-1][0], top[-1][0], sha("".join(own + above)), digest, digest == top[-1][0]))
    return sorted(map(str, out))


KINDS = "doc_id long, source string, lang string, n_chars long, text string"


def awkward_rows(n=600, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice([None, i, i // 3, 5]), rng.choice([None, "a", "a", "a", "", "é", "z", f"src{i % 13}"]), rng.choice([None, "en"]), rng.choice([None, i]), rng.choice([None, "", f"x\ny{i}", "same", "日本\n", "long\n" * 3000])) for i in range(n)]
    return rows + [(7, "hot", None, 1, "t\n")] * 400 + [(i, f"one{i}", "en", 3, "x") for i in range(30)]


def test_merkle_manifest(spark):
    rows = awkward_rows()
    for part in (rows, rows[:1], rows[:2], rows[600:900], []):
        docs = spark.createDataFrame([(*r, 1, "g") for r in part], KINDS + ", place long, g string").repartition(5)
        assert sorted(str(tuple(r)) for r in merkle.manifest_of(docs).collect()) == manifest(part)


def test_merkle_store_by_levels(spark):
    """The store holds every node once below its level's folder; proofs and other fields, groups and orders."""
    docs = spark.createDataFrame([(f"k{i:04}", i % 2, "v" * (i % 7)) for i in range(1000)], "key string, side int, value string")
    with common.scratch():
        m = merkle.Manifest.build(docs, fields=("key", "value"), group="side", order="key")
        want = {side: tree([leaf_of((f"k{i:04}", "v" * (i % 7))) for i in range(side, 1000, 2)]) for side in (0, 1)}
        held = {(r["grp"], r["level"], r["place"]): r["digest"] for r in m.trees.nodes.collect()}
        assert held == {(side, level, p): d for side, levels in want.items() for level, row in enumerate(levels) for p, d in enumerate(row)}
        assert m.trees.nodes.count() == len(held) and m.root == tree([want[0][-1][0], want[1][-1][0]])[-1][0]
        folders = glob.glob(m.trees.path.removeprefix("file:") + "/level=*")
        assert sorted(int(f.rsplit("=", 1)[1]) for f in folders) == list(range(7))
        rows = merkle.verify(m.proofs(), m.root)
        assert rows.where("verified").count() == 1000
        wrong = rows.selectExpr("*", "sha2(id, 256) as other").drop("folded", "verified")
        assert merkle.verify(wrong, m.root, "other").where("verified").count() == 0


def test_merkle_fold_needs_every_sibling():
    levels = tree([sha(str(i)) for i in range(100)])
    for place in range(100):
        siblings, root = climb(levels, place, levels[0][place])
        assert merkle.fold(levels[0][place], "".join(siblings), [(place, 100), (0, 1)]) == root == levels[-1][0]
        damaged = "".join([sha("x"), *siblings[1:]])
        assert merkle.fold(levels[0][place], damaged, [(place, 100)]) != root


# WARC archives

PAGES = [
    (1, "http://a\r\nX: y", "<p>x</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"), (2, None, None), (3, "u", ""), (4, "u", "<p>x</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"),
    (None, "n", "only"), (None, "n", "only"), (None, "n", "é😀\n"), (9, "q", "é😀\n"), (8, "q", "é😀\n"), (8, "r", "é😀\n"), (10, "z", "\r"), (11, "z", "\n"), (12, "z", "\r\n" * 5),
    (13, "z", "x" * 300000), (14, "", "﻿bom"), (15, "z", "a\n" * 9), (16, "z", "no line end"), (16, "z", "no line end"), *((100 + i, "h", "hot") for i in range(300)),
]
PAGE = "page_id long, url string, html string, digest string, copies long, original long, value string"


def pages_of(spark, rows):
    return spark.createDataFrame([(*r, "d", 1, 2, "v") for r in rows], PAGE).repartition(5)


def revisits(rows, least):
    low, size = {}, lambda h: len((h or "").encode())
    for i, _, h in rows:
        if i is not None and size(h) >= least:
            low[h or ""] = min(i, low.get(h or "", i))
    out = []
    for i, _, h in rows:
        original = low.get(h or "") if size(h) >= least else None
        again = original is not None and i != original
        out.append((i, size(h), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "revisit" if again else "response", original if again else None))
    return sorted(map(str, out))


@pytest.mark.parametrize(("least", "broadcast"), [(0, 200_000), (4, 200_000), (0, 0)])
def test_warc_round_trip(spark, monkeypatch, least, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    assert sorted(str(tuple(r)) for r in warc.round_trip(pages_of(spark, PAGES), least).collect()) == revisits(PAGES, least)
    assert warc.round_trip(pages_of(spark, PAGES).limit(0)).count() == 0


def test_warc_archives_hold_payloads_once(spark, tmp_path):
    path = str(tmp_path / "archives")
    warc.write_archives(pages_of(spark, PAGES), path)
    raw = b"".join(gzip.open(f).read() for f in glob.glob(path + "/*.gz"))
    assert raw.count(b"hot\r\n\r\n") == 1 and raw.count(b"WARC-Type: revisit") == sum("revisit" in r for r in revisits(PAGES, 0))
    rows = {(r["page_id"], r["url"]): r for r in warc.read_records(spark, path, payload=True).where("page_id is not null").collect()}
    for i, url, html in PAGES:
        if i is None:
            continue
        r = rows[i, url.replace("\r", "%0D").replace("\n", "%0A") if url is not None else None]
        if r["record_type"] == "response":
            assert (r["payload"], r["payload_digest"], r["refers_to_id"]) == (html or "", r["declared_digest"], None)
        else:
            assert r["payload"] is None and r["refers_to_id"] in {x["record_id"] for x in rows.values() if x["record_type"] == "response" and x["payload"] == (html or "")}
    # archives in which the originals are missing
    records = warc.read_records(spark, path)
    alone = warc.resolve(records.where("record_type = 'revisit'")).collect()
    assert alone and all(r["payload_bytes"] is None and r["refers_to"] is None and r["payload_digest"] for r in alone)


def test_warc_parser():
    block = b"HTTP/1.1 200 OK\r\n\r\na\r\n\r\nb"
    raw = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    lines = (raw * 2).split(b"\n")[:-1]
    parser = warc.Parser("x")
    done = [d for line in lines if (d := parser.feed(line))]
    parser.close()
    assert [d[1] for d in done] == [block] * 2 and done[0][0]["warc-type"] == "response"
    for bad in (raw.replace(b"WARC/1.1", b"HTTP/1.1"), raw.replace(b"Content-Length", b"Length"), raw.replace(b": 25", b": 21"), raw[:-8], raw[:20] + b"\n"):
        parser = warc.Parser("x")
        with pytest.raises(ValueError, match="x: "):
            for line in bad.split(b"\n")[:-1]:
                parser.feed(line)
            parser.close()


# whitening


def whitened(rows, components=32):
    """Of vectors of one length: n, deviations, shares, whitened values up to the sign, by an eigendecomposition."""
    x = np.array([[int(np.floor(64 * float(c))) + 1000000 for c in v] for v in rows], dtype=object)
    n, sums = len(x), x.sum(0)
    centred = (n * x - sums).astype(float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    with np.errstate(invalid="ignore", divide="ignore"):
        return n, [int(v) for v in ((n * x - sums) ** 2).sum(1)], values[order] / values.sum(), centred @ axes[:, order] / np.sqrt(values[order])


def test_whitening(spark):
    rng = np.random.default_rng(5)
    many = rng.normal(size=(3000, 40)) @ rng.normal(size=(40, 40))
    rows = [(i, v.tolist(), 1, 0.5) for i, v in enumerate(many)] + [(9000, None, 1, 0.5), (9001, [1.0] * 39 + [None], 1, 0.5), (9002, [1.0] * 39 + [float("nan")], 1, 0.5), (9003, [float("-inf")] * 40, 1, 0.5), (9004, [], 1, 0.5), (9005, [1e17] * 40, 1, 0.5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long, whitened double").repartition(37)
    got = whitening.whiten(df).toPandas()
    n, deviations, explained, want = whitened(many)
    table = got.pivot(index="vec_id", columns="component", values="whitened")
    assert list(table.index) == list(range(3000)) and list(table.columns) == list(range(1, 33)) and set(got["n"]) == {n}
    w = table.to_numpy()
    assert np.abs(w - want * np.sign((w * want).sum(0))).max() < 1e-8
    assert got.groupby("vec_id")["deviation"].first().tolist() == deviations
    assert np.abs(got.groupby("component")["explained"].first() / explained - 1).max() < 1e-9 and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9


def test_whitening_of_odd_tables(spark):
    rows = [(1, [1.0, 2.0]), (6, [3.0, 3.0]), (None, [0.0, 5.0]), (6, [3.0, 3.0]), (7, [1.0, 1.0, 1.0]), (8, [2.0, 2.0, 3.0]), (10, [5.0, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = whitening.whiten(df).collect()
    assert sorted((str(r["vec_id"]), r["component"], r["n"]) for r in got) == sorted((str(i), k, 5 if len(v) == 2 else 2) for i, v in rows for k in range(1, len(v) + 1))
    two, three = ([r for r in got if r["n"] == n] for n in (5, 2))
    n, deviations, _, want = whitened([v for _, v in rows if len(v) == 2])
    by_id = {(r["vec_id"], r["component"]): r for r in two}
    for k in (1, 2):
        own = np.array([by_id[i, k]["whitened"] for i, v in rows if len(v) == 2])
        assert np.abs(np.abs(own) - np.abs(want[:, k - 1])).max() < 1e-12
    assert [by_id[i, 1]["deviation"] for i, v in rows if len(v) == 2] == deviations
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in three) and max(r["identity_error"] for r in three) < 1e-12
    same = whitening.whiten(spark.createDataFrame([(1, [4.0, 4.0])] * 3, "vec_id long, embedding array<float>")).collect()
    assert len(same) == 6 and {(r["whitened"], r["explained"], r["identity_error"], r["deviation"]) for r in same} == {(None, None, None, 0)}
    assert whitening.whiten(df.limit(0)).count() == 0
    big = whitening.whiten(spark.createDataFrame([(1, [1e14, 1.0]), (2, [-1e14, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in big} == {None} and {round(abs(r["whitened"]), 9) for r in big if r["component"] == 1} == {1.0}


def test_factors_merge_to_the_whole():
    """Triangular factors and moments of parts, merged in any tree, are those of all rows together."""
    x = np.random.default_rng(2).normal(size=(500, 6)) + 100
    parts = np.split(x - x.mean(0), [3, 70, 300])
    r = whitening._triangle(np.vstack([whitening._triangle(np.vstack([whitening._triangle(p) for p in parts[:2]])), *(whitening._triangle(p) for p in parts[2:])]))
    assert np.allclose(np.linalg.svd(r)[1], np.linalg.svd(x - x.mean(0))[1], rtol=1e-12)
    one = lambda p: (len(p), p.mean(0), (p - p.mean(0)).T @ (p - p.mean(0)))
    n, mean, m2 = whitening._moments(whitening._moments(one(x[:3]), one(x[3:200])), one(x[200:]))
    assert n == 500 and np.allclose(mean, x.mean(0)) and np.allclose(m2 / n, np.cov(x.T, bias=True))
