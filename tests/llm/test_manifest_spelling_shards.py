"""Merkle manifest, spelling variants and shards against brute force and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberflow.llm import differencing, merkle, spelling
from timberflow.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"
FIELDS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def runs(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + fanout])) for i in range(0, len(levels[-1]), fanout)])
    return levels


def siblings(levels, place, fanout):
    for level in levels[:-1]:
        begin = place // fanout * fanout
        yield "".join(level[begin:place]), "".join(level[place + 1 : begin + fanout])
        place //= fanout


def manifest_by_hand(rows, fanout=8):
    groups = {}
    for row in rows:
        groups.setdefault(row["lang"], []).append(row)
    names = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[name] = runs([leaf(r, r["text"]) for r in groups[name]], fanout)
    crown = runs([trees[name][-1][0] for name in names], fanout)
    out = []
    for j, name in enumerate(names):
        for i, row in enumerate(groups[name]):
            text = row["text"]
            if None not in (text, row["doc_id"]) and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0:
                text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
            at, proof = leaf(row, text), ""
            for left, right in [*siblings(trees[name], i, fanout), *siblings(crown, j, fanout)]:
                at, proof = sha(left + at + right), proof + left + right
            out.append((row["doc_id"], trees[name][0][i], trees[name][-1][0], crown[-1][0], sha(proof), at, at == crown[-1][0]))
    return sorted(out, key=str)


def documents(spark, rows):
    return spark.createDataFrame(rows, FIELDS)


@pytest.mark.parametrize("fanout", [2, 8])
@pytest.mark.parametrize("sizes", [[1], [1, 1], [8, 9], [1, 64, 65, 3, 2, 7, 10, 11, 17]])
def test_manifest_equals_recomputation(spark, sizes, fanout):
    rng = random.Random(sum(sizes))
    rows = []
    for g, size in enumerate(sizes):
        lang = None if g == 1 else f"l{g}é"
        rows += [(rng.randrange(10**6), rng.choice(["web", None]), lang, rng.randrange(99), rng.choice(["Ab É", "x" * 9, "", None, "ÀB CD"])) for _ in range(size)]
    rng.shuffle(rows)
    docs = documents(spark, rows)
    lowered = {"text": merkle.lower_ascii(F.col("text"))}
    got = merkle.verify(docs, lowered, F.crc32(F.col("doc_id").cast("string")) % 3 == 0, fanout).collect()
    assert sorted(map(tuple, got), key=str) == manifest_by_hand([r.asDict() for r in docs.collect()], fanout)


def test_manifest_on_odd_rows(spark):
    assert QUERIES["op11_merkle_manifest"](spark, SMALL).filter("verified").count() == 675
    rows = [(None, None, None, None, None)] * 3 + [(3, "s", "en", 1, "A"), (3, "s", "en", 1, "A"), (3, "s", "en", 1, "B"), (9, "s", "", 0, "Word " * 40_000)]
    docs = documents(spark, rows)
    want = manifest_by_hand([r.asDict() for r in docs.collect()])
    assert sorted(map(tuple, merkle.tampered(docs).collect()), key=str) == want
    clash = docs.selectExpr("*", "1 grp", "2 lo", "3 hi", "4 digest", "5 up", "6 bucket")
    assert sorted(map(tuple, merkle.tampered(clash).collect()), key=str) == want
    assert merkle.tampered(docs.limit(0)).collect() == [] == merkle.manifest(docs.limit(0)).collect()


def test_manifest_nodes_nest(spark):
    docs = documents(spark, [(k, "s", "a" if k % 3 else "b", k, f"text {k}") for k in range(300)])
    nodes = merkle.manifest(docs).toPandas()
    for _, group in nodes.groupby("grp"):
        for level, rows in group.groupby("level"):
            rows = rows.sort_values("lo")
            assert rows.lo.iloc[0] == 0 and (rows.lo.to_numpy()[1:] == rows.hi.to_numpy()[:-1]).all()
            assert ((rows.hi - rows.lo) <= 8**level).all()


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def variants_by_hand(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = None if doc_id is None else zlib.crc32(f"{doc_id}:{run}".encode())
            if h is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    out = {}
    for w, n in words.items():
        others = sorted(((-m, v) for v, m in words.items() if near(w, v)))
        form = others[0][1] if others and words[others[0][1]] >= 2 * n else None
        out[w] = [form, w, n, len(others), words.get(form)]
    for w in out:
        while out[out[w][1]][0] is not None:
            out[w][1] = out[out[w][1]][0]
    return sorted((w, *rest) for w, rest in out.items())


def as_rows(frame):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in frame.collect())


def typos(rng, word, letters="abàÿ"):
    at = rng.randrange(len(word))
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + rng.choice(letters) + word[at:], word[:at] + rng.choice(letters) + word[at + 1 :]])


@pytest.mark.parametrize("limits", [{}, {"letters": 60, "searches": 7}])
def test_variants_equal_all_pairs(spark, limits):
    rng = random.Random(5)
    rows = []
    for k in range(120):
        words = []
        for _ in range(rng.randint(0, 60)):
            word = "".join(rng.choice("abÀ") for _ in range(rng.randint(4, 7)))
            for _ in range(rng.choice([0, 0, 1, 2])):
                word = typos(rng, word) or word
            words += [word] * rng.choice([1, 1, 2, 9])
        rows.append((k, rng.choice([" ", "1", "×\n", "Ā"]).join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = variants_by_hand(rows)
    assert len(want) > 200 and sum(w[1] is not None for w in want) > 50 and any(w[1] not in (None, w[2]) for w in want)
    assert as_rows(spelling.variants(docs, **limits)) == want


def test_index_finds_each_edit():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(5, 9))) for _ in range(300)})
    index = spelling.TwoWay(words)
    for kind in (0, 1, -1):
        for side in (True, False):
            who, found = index.near(words, np.full(len(words), side), np.full(len(words), kind))
            got = {(words[q], words[v]) for q, v in zip(who, found, strict=True)}
            half = lambda w, v: w[: len(v) // 2] == v[: len(v) // 2] if side else w[-(len(v) - len(v) // 2) :] == v[-(len(v) - len(v) // 2) :]
            assert got == {(w, v) for w in words for v in words if len(v) == len(w) + kind and near(w, v) and half(w, v)}


def test_variants_on_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "letter " * 6), (None, "lettre letter"), (4, "x" * 20_000 + " " + "x" * 19_999), (4, "x" * 20_000), (5, "x" * 20_000 + " " + "x" * 19_999)]
    rows += [(6, "x" * 19_999), (7, "x" * 19_999), (8, "lettr lettr lettr 123 élève ÉLÈVE"), (9, "Tiny tiny tiny"), (9, "Tiny tiny tiny")]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, n int, word int, bucket int")
    assert as_rows(spelling.variants(docs)) == variants_by_hand(rows)
    assert spelling.variants(docs.limit(0)).collect() == []


def test_spelling_query_equals_all_rows(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert as_rows(QUERIES["op12_spelling_variants"](spark, "/root/testdata/sf0.001")) == variants_by_hand(rows)


def test_differencing_balances():
    rng = random.Random(8)
    assert sorted(differencing.difference([8, 7, 6, 5, 4], 2)) == [0, 0, 0, 1, 1]
    assert differencing.difference([], 4) == [] and differencing.difference([5], 3) == [0]
    for count, shards in ((400, 7), (3000, 40), (12, 5)):
        sizes = [int(rng.lognormvariate(6, 1)) + 1 for _ in range(count)]
        sums = np.bincount(differencing.difference(sizes, shards), sizes, shards)
        # No worse than the longest-first rule, and near equal where there are many items.
        longest = [0] * shards
        for size in sorted(sizes, reverse=True):
            longest[longest.index(min(longest))] += size
        assert sums.max() - sums.min() <= max(longest) - min(longest)
        if count > 100:
            assert sums.max() - sums.min() < 0.001 * sums.mean() or sums.max() == max(sizes)


def test_exchange_narrows_the_spread():
    rng = random.Random(9)
    for count, shards, large in ((64, 5, 30_000), (64, 5, 90_000_000), (200, 7, 1), (3, 5, 8)):
        sizes = sorted([rng.randint(7000, 9000) for _ in range(count)] + [large], reverse=True)
        before = differencing.difference(sizes, shards)
        after = differencing.exchange(sizes, before, shards)
        spread = lambda of: np.ptp(np.bincount(of, sizes, shards))
        assert len(after) == len(sizes) and set(after) <= set(range(shards)) and spread(after) <= spread(before)
        if large < 50_000 and count > 3:
            assert spread(after) < 0.01 * sum(sizes) / shards
    assert differencing.exchange([], [], 4) == [] and differencing.exchange([9, 1], [0, 0], 1) == [0, 0]
    assert sorted(differencing.exchange([5, 4, 1], [0, 0, 0], 2)) == [0, 0, 1]
    assert differencing.exchange([50, 50], [0, 1], 2) == [0, 1]
    assert differencing.exchange([90, 9, 1, 1], [0, 1, 1, 2], 3) == [0, 1, 1, 2]  # the largest shard is one item


def check_shards(got, rows, shards):
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    texts = {}
    for i, text in rows:
        data = (text or "").encode()
        texts.setdefault((str(i), len(data) + 16, zlib.crc32(data)), text or "")
    shard_of = {}
    for r in got:
        shard_of.setdefault(texts[str(r.doc_id), r.size, r.text_crc32], set()).add(r.shard)
    assert all(len(s) == 1 for s in shard_of.values())
    return sizes


def test_shards_of_the_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_differencing_shards"](spark, SMALL).collect()
    sizes = check_shards(got, rows, 40)
    assert len(sizes) == 40 and max(sizes.values()) - min(sizes.values()) < 0.002 * sum(sizes.values()) / 40
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_shards_on_odd_rows(spark):
    rng = random.Random(3)
    rows = [(k, "copy " * 50) for k in range(300)] + [(k, "w" * rng.randint(0, 90)) for k in range(300, 900)] + [(None, None), (None, ""), (5, None), (5, "copy " * 50), (901, "é" * 60_000)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, shard int, key int, item int")
    check_shards(differencing.assign(docs, 4).collect(), rows, 4)
    assert {(r.shard, r.slot) for r in differencing.assign(docs, 1).collect()} == {(0, k) for k in range(len(rows))}
    assert differencing.assign(docs.limit(0), 4).collect() == []
    with pytest.raises(ValueError):
        differencing.assign(docs, 0)


def test_bundled_groups_balance(spark, monkeypatch):
    monkeypatch.setattr(differencing, "GRAIN", 8)
    monkeypatch.setattr(differencing, "BUNDLES", 64)
    rng = random.Random(4)
    rows = [(k, f"{k} " + "w" * rng.randint(0, 300)) for k in range(3000)] + [(3000, "v" * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = check_shards(differencing.assign(docs, 5).collect(), rows, 5)
    assert max(sizes.values()) - min(sizes.values()) < 0.01 * sum(sizes.values()) / 5


def test_written_shards_read_back(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text {k % 17}", "en") for k in range(200)], "doc_id long, text string, lang string")
    differencing.write(docs, 3, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("doc_id", "text", "lang").collect())) == sorted(map(tuple, docs.collect()))
    assert all(r[0] == 1 for r in back.groupBy("text").agg(F.countDistinct("shard")).select(F.col("count(DISTINCT shard)")).collect())
