"""Operators on pairs and lines, and the pipeline, against brute force."""

import hashlib
import random
import re
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, embeddup, jaccard, linededup

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def union_find(n, pairs):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def grams(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def near_copies(rng, base, count, edits):
    out = []
    for _ in range(count):
        words = base[:]
        for _ in range(rng.randrange(1, edits + 1)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(40)]
    texts = [None, "", "  ", "one", "ONE", "one two three", "One two\tthree", "one two three four five", "é a b c d e", "é a b c d e f"]
    for size, count, edits in ((300, 60, 8), (120, 40, 4), (40, 20, 2), (12, 6, 1), (700, 5, 20)):
        texts += near_copies(rng, [word() for _ in range(size)], count, edits)
    texts += [" ".join([word() for _ in range(150)] + passage + [word() for _ in range(60)]) for _ in range(60)]
    texts += [texts[20]] * 5
    texts.append(" ".join(word() for _ in range(20_000)))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("small", "block"), [(12, 512), (2, 7)])
def test_jaccard_components(spark, monkeypatch, corpus, small, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "SMALL", small)
    sets = [grams(t) for t in corpus]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = union_find(len(sets), links)
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(corpus)], "doc_id long, text string, id string, n int").repartition(5)
    got = {r.id: r for r in jaccard.components(df).collect()}
    assert [got[i].component_id for i in range(len(corpus))] == want
    assert [got[i].n_shingles for i in range(len(corpus))] == [len(s) for s in sets]


@pytest.mark.parametrize("grown", [False, True])
def test_jaccard_between_batches(spark, grown):
    """60 sets tied in one batch, 3 sets in another that are similar to one of them that isn't sent on; ``grown``: as owners, the 60 being visitors."""
    size = next(u for u in jaccard.upper(80) if u > 250)
    base = [f"b{i}" for i in range(size + 4)]
    apart = [p for p in range(4, size - 4) if not 14 < p % 50 < 40]
    texts = []
    for i in range(60):
        words = base[:]
        if i != 40:
            words[apart[i]], words[apart[i + 70]] = f"x{i}", f"y{i}"
        texts.append(" ".join(words))
    for i in range(3):
        words = base[:]
        for k in range(5 + grown):
            at = 20 + 7 * i + 50 * k
            words[at : at + (not grown)] = [f"z{i}_{k}"]
        texts.append(" ".join(words))
    sets = [grams(t) for t in texts]
    assert {len(x) for x in sets[:60]} == {size} and all((len(x) > size) == grown for x in sets[60:])
    links = [(i, j) for i in range(63) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert all([j for k, j in links if k == i] == [40] for i in range(60, 63))
    rows = list(enumerate(texts))
    df = spark.createDataFrame(spark.sparkContext.parallelize([rows[:60], rows[60:]], 2).flatMap(lambda x: x), "doc_id long, text string")
    got = {r.id: r.component_id for r in jaccard.components(df).collect()}
    assert [got[i] for i in range(63)] == union_find(63, links) == [0] * 63


def test_jaccard_keeps_one(spark, corpus):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(corpus)], "doc_id long, text string")
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    found = jaccard.components(df).select("component_id").distinct().count()
    assert kept.count() == found


def test_jaccard_odd_tables(spark):
    schema = "doc_id long, text string"
    assert jaccard.components(spark.createDataFrame([], schema)).count() == 0
    rows = [(None, "a b c"), (None, None), (3, "a b c"), (3, "a b c"), (2, "a b c")]
    got = sorted((tuple(r) for r in jaccard.components(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == sorted([(None, 1, None), (None, 0, None), (3, 1, 2), (3, 1, 2), (2, 1, 2)], key=str)


def test_signatures_of_similar_sets_meet():
    rng = np.random.default_rng(1)
    for n in (4, 6, 9, 15, 30, 80, 200, 561, 2000):
        for _ in range(30):
            shared = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            most = n // 9
            extra = rng.integers(0, 1 << 63, most, dtype=np.uint64)
            a, b = np.unique(np.concatenate([shared, extra[: most // 2]])), np.unique(np.concatenate([shared, extra[most // 2 :]]))
            common_ = len(np.intersect1d(a, b))
            if 100 * common_ < 80 * (len(a) + len(b) - common_) or np.array_equal(a, b):
                continue
            sa, sb = jaccard.signatures(a), jaccard.signatures(b)
            assert len(np.intersect1d(sa >> np.uint64(1), sb >> np.uint64(1)))
            assert jaccard.similar(a, b)
            assert all(np.bitwise_count(jaccard.bitmap(a, k) ^ jaccard.bitmap(b, k)).sum() <= jaccard.most_apart(len(a) + len(b)) for k in (64, 256, 4096))
            assert jaccard.connect([a, b]) and not jaccard.connect([a, b], np.array([7, 7])) and not jaccard.connect([a, b], np.array([1, 2]), np.array([0, 0]))


def dedup_by_hand(rows):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                holders.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (i is not None and len(holders.get(key(x), ())) > 1 and min(holders[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return out


@pytest.fixture(scope="module")
def lined():
    rng = random.Random(12)
    pool = [f"line number {i} of the pool" for i in range(20)] + ["short", "ÄÖÜ äöü ß é", "  PADDED line here\t", "padded LINE here", "ninechars", "tenchars10", "éééééééééé", "ééééééééé", ""]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(6)))) for i in range(80)]
    return rows + [(5, "line number 1 of the pool\nx"), (None, "line number 1 of the pool"), (90, None), (91, "line number 2 of the pool\r\n\n")]


def test_line_dedup(spark, lined):
    df = spark.createDataFrame([(i, t, "g") for i, t in lined], "doc_id long, text string, gone string").withColumn("doc", F.lit(1)).repartition(4)
    got = linededup.dedup_lines(df)
    assert got.columns == df.columns
    assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == sorted((str(i), text) for i, _, _, text in dedup_by_hand(lined))


def test_line_dedup_query_columns(spark, lined, tmp_path):
    spark.createDataFrame(lined, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in linededup.op8_line_dedup(spark, str(tmp_path)).collect())
    assert got == sorted((str(i), n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in dedup_by_hand(lined))


def test_line_dedup_without_filters_is_the_same(spark, lined, monkeypatch):
    df = spark.createDataFrame(lined, "doc_id long, text string")
    first = sorted(str(r) for r in linededup.dedup_lines(df).collect())
    monkeypatch.setattr(linededup, "FILTER_BYTES", 0)
    assert sorted(str(r) for r in linededup.dedup_lines(df).collect()) == first


def test_postings_and_filters_are_reversible(spark, lined):
    df = spark.createDataFrame(lined, "doc_id long, text string")
    old, new = df.where("doc_id < 60"), df.where("doc_id >= 60")
    before = linededup.postings(old)
    after = linededup.change_postings(before, inserted=linededup.postings(new))
    table = lambda p: sorted(map(tuple, linededup.references(p).collect()))
    assert table(after) == table(linededup.postings(df))
    assert table(linededup.change_postings(after, deleted_ids=new.select("doc_id"))) == table(before)
    a, b = linededup.references(before).cache(), linededup.references(after).cache()
    added = b.join(a, ["h1", "h2"], "left_anti")
    filters = linededup.build_shards(a, 3)
    wide = linededup.update_shards(filters, added, a.limit(0), 3)
    back = linededup.update_shards(wide, added.limit(0), added, 3)

    def holds(fs, keys):
        found = {r.shard: linededup.CuckooFilter.from_bytes(bytes(r.filter)) for r in fs.collect()}
        return [bool(found[k.h1 % 3].contains(np.array([k.h1]), np.array([k.h2]))[0]) for k in keys.collect() if k.h1 % 3 in found]

    assert all(holds(wide, b)) and all(holds(back, a))
    assert sum(holds(back, added)) <= 1


def test_line_index_comes_and_goes(spark, monkeypatch):
    """Random insertions and deletions, some repeated, against counts made anew; filters broadcast and apart give the same drops."""
    rng = random.Random(9)
    text = lambda: "\n".join(f"a line of text number {rng.randrange(60)}" for _ in range(rng.randrange(1, 12)))
    docs = {i: text() for i in range(40)}
    frame = lambda ids: spark.createDataFrame([(i, docs[i]) for i in ids], "doc_id long, text string")
    present = set(range(15))
    index = linededup.LineIndex.build(linededup.postings(frame(present)))
    table = lambda d: sorted(map(tuple, d.collect()))
    drops = lambda: sorted((r.doc_id, tuple(sorted(map(tuple, r.gone)))) for r in index.drops().collect())
    first = table(index.counts), drops()
    for come, gone in (([20, 21, 3], []), ([], [0, 1, 3, 20]), ([0, 1, 3, 25], []), ([], [21, 25, 39])):
        index = index.insert(linededup.postings(frame(come))) if come else index.delete(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        present = present | set(come) - set(gone) if come else present - set(gone)
        assert table(index.counts) == table(linededup.counted(linededup.postings(frame(present))))
        filters = {r.shard: linededup.CuckooFilter.from_bytes(bytes(r.filter)) for r in index.filters.collect()}
        for h1, h2, refs, _ in table(index.counts):
            assert refs < 2 or filters[h1 % index.shards].contains(np.array([h1]), np.array([h2]))[0]
        want = drops()
        monkeypatch.setattr(linededup, "FILTER_BYTES", 0)
        monkeypatch.setattr(linededup, "CHUNK_ROWS", 7)
        assert drops() == want == sorted((r.doc_id, tuple(sorted(map(tuple, r.gone)))) for r in linededup.drops(index.posted, linededup.references(index.posted)).collect())
        monkeypatch.undo()
    assert (table(index.counts), drops()) == first


def test_cuckoo_filter():
    rng = np.random.default_rng(3)
    h = rng.integers(-(1 << 63), 1 << 63, (2, 5000))
    f = linededup.built(h[0][:4000], h[1][:4000])
    assert f.contains(h[0][:4000], h[1][:4000]).all() and f.contains(h[0][4000:], h[1][4000:]).sum() <= 5
    f.delete(h[0][:2000], h[1][:2000])
    assert f.contains(h[0][2000:4000], h[1][2000:4000]).all() and f.contains(h[0][:2000], h[1][:2000]).sum() <= 20
    assert linededup.CuckooFilter.from_bytes(f.to_bytes()).contains(h[0][2000:4000], h[1][2000:4000]).all()


def test_embedding_dedup(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 32))
    for i in range(100, 250):
        x[i] = x[i % 7] + rng.normal(size=32) * rng.choice([0.05, 0.15, 0.3])
    x[300] = x[301] = x[2]
    rows = [(i, [float(v) for v in r], "c") for i, r in enumerate(x)]
    rows += [(700, None, "c"), (701, [0.0] * 32, "c"), (702, [float("nan")] * 32, "c"), (703, [None] * 32, "c"), (None, rows[0][1], "c"), (704, [1.0, 2.0], "c"), (705, [2.0, 4.0], "c"), (5, rows[5][1], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rep string")
    got = embeddup.near_duplicates(df).collect()
    assert len(got) == len(rows)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    found = {r.vec_id: r for r in got}
    recall = sum(found[i].n_links for i in range(600)) / near.sum()
    assert 0.9 <= recall <= 1.0 and all(found[i].n_links <= near[i].sum() for i in range(600))
    want = union_find(600, [tuple(p) for p in np.argwhere(near)])
    assert np.mean([found[i].component_id == want[i] for i in range(600)]) > 0.97
    assert all((found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True) for i in (700, 701, 702, 703))
    assert (found[None].n_links, found[None].component_id, found[None].kept) == (0, None, True)
    assert found[705].component_id == 704 and found[704].n_links == 1 and not found[705].kept
    assert embeddup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_dedup_of_many_lengths(spark, monkeypatch):
    monkeypatch.setattr(embeddup, "MAX_LENGTHS", 3)
    rng = np.random.default_rng(9)
    rows, want = [], []
    for d in range(20, 28):
        x = rng.normal(size=d)
        rows += [list(x), list(x + rng.normal(size=d) * 0.05), list(3 * x), list(rng.normal(size=d))]
        want += [(2, len(want))] * 3 + [(0, len(want) + 3)]
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(rows)], "vec_id long, embedding array<double>")
    found = {r.vec_id: (r.n_links, r.component_id) for r in embeddup.near_duplicates(df).collect()}
    assert [found[i] for i in range(len(rows))] == want


def test_embedding_dedup_with_a_common_part(spark):
    """Pairs just over the threshold, all vectors about one direction: a mean of length 0.88."""
    rng = np.random.default_rng(11)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.normal(size=(1000, 64)) / 8 * 0.53 + np.eye(64)[0])
    u = rng.normal(size=x.shape)
    u = unit(u - (u * x).sum(1, keepdims=True) * x)
    y = 0.951 * x + np.sqrt(1 - 0.951**2) * u
    both = np.concatenate([x, y])
    assert 0.8 < np.linalg.norm(both.mean(0)) < 0.9
    near = both @ both.T >= 0.95
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(both)], "vec_id long, embedding array<double>")
    links = sum(r.n_links for r in embeddup.near_duplicates(df).collect())
    assert 0.97 <= links / near.sum() <= 1


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 430)] + [(7, 7), (None, 3)]
    want = union_find(431, [(a, b) for a, b in edges if a is not None])
    got = {r.id: r.component_id for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert got == {i: want[i] for i in nodes}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    every = common.connected_components(spark.createDataFrame([(2, 1)], "a long, b long"), spark.range(4).select(F.col("id")))
    assert {r.id: r.component_id for r in every.collect()} == {0: 0, 1: 1, 2: 1, 3: 3}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    clean = docs.where("n_chars > 400").count()
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert counts[0] >= clean * 0.95 and counts[1] == counts[0] and counts[2] <= counts[1] and counts[3] == counts[2]
    assert docs.select("doc_id").distinct().count() == counts[3]
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.select("doc_id").distinct().count() == counts[3] and sorted(got.columns) == sorted(docs.columns)


def test_pipeline_by_hand(spark, tmp_path):
    """Each stage of the pipeline on what the one before left, against plain versions; nulls, empty, long and repeated texts, columns with names of the stages' own."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    from tidemark.llm import bpe, langid

    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghinrst") for _ in range(rng.randrange(3, 9)))
    base = [word() for _ in range(200)]
    texts = [" ".join(word() for _ in range(60)) + "\nthis line is in many of the documents" for _ in range(25)] + near_copies(rng, base, 12, 10) + [" ".join(base)] * 3
    texts += [f"{word()} {word()} write to {word()}@example.org or 10.1.2.3 {word()}", " ".join(word() for _ in range(30_000)), None, "", "12 34", "x\n\nx"]
    rows = [(i, t, rng.choice(["en", "de", None]), None if i % 7 else "s", "g", 1.5, True, -i) for i, t in enumerate(texts)]
    rows.append(rows[3])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, gone string, label double, task boolean, id long")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = langid.train(docs)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/out/{name}")
        out = spark.read.parquet(f"{tmp_path}/out/{name}")
        had = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
        if name != "packing":
            assert out.columns == columns and all(r.id == -r.doc_id and (r.gone, r.label, r.task) == ("g", 1.5, True) for r in out.collect())
            got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        if name == "language_id":
            judged = {(r.doc_id, r.rejected) for r in langid.identify(docs, model).collect()}
            assert {i for i, _ in got} == {i for i, rejected in judged if not rejected} and len(got) >= 40 and not {i for i, t in had if t in (None, "", "12 34")} & {i for i, _ in got}
        elif name == "line_dedup":
            assert [(i, t or "") for i, t in got] == sorted(((i, t) for i, _, _, t in dedup_by_hand(had)), key=str)
        elif name == "ngram_jaccard":
            sets = [grams(t) for _, t in had]
            links = [(a, b) for a in range(len(had)) for b in range(a) if had[a][0] == had[b][0] or sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
            group = union_find(len(had), links)
            least = {g: min(had[k][0] for k in range(len(had)) if group[k] == g) for g in group}
            assert got == [x for k, x in enumerate(had) if x[0] == least[group[k]]] and len(got) <= len(had) - 8
        elif name == "pii":
            mail = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+|10\.1\.2\.3")
            assert len(got) == len(had) and not any(mail.search(t or "") for _, t in got) and any("[EMAIL]" in (t or "") and "[IP]" in t for _, t in got)
            assert all(a == b for a, b in zip(had, got, strict=True) if not mail.search(a[1] or ""))
        else:
            t = Tokenizer.from_file(bpe.default_path())
            t.no_truncation()
            t.no_padding()
            total = {}
            for r in out.collect():
                total[r.doc_id] = total.get(r.doc_id, 0) + r.length
            want = {}
            for i, x in had:
                want[i] = want.get(i, 0) + len(t.encode(x or "", add_special_tokens=False).ids) + 1
            assert total == want
        docs = out
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_line_dedup_of_long_texts(spark):
    """Fifty thousand lines, a line of a megabyte in three documents, and the same document twice."""
    many = "\n".join(f"line {i % 20_000} of a long document" for i in range(50_000))
    wide = "word " * 200_000
    rows = [(3, many), (1, "line 7 of a long document\nshort"), (5, wide + "\nend of five"), (2, wide), (4, "x\n" + wide.upper()), (3, many)]
    got = sorted((r.doc_id, r.text) for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == sorted((i, t) for i, _, _, t in dedup_by_hand(rows))
    assert linededup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_line_dedup_writes_few_files(spark, lined):
    """Hadoop's local file system starts shells for each file: one file of the postings that go, whatever the partitions, and nothing stays persisted."""
    common.ensure_checkpoint_dir(spark)
    folder = Path(urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get()).path)
    files = lambda: set(folder.rglob("part-*"))
    kept = lambda: set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    held, before = kept(), files()
    got = linededup.dedup_lines(spark.createDataFrame(lined, "doc_id long, text string").repartition(16))
    assert len(files() - before) == 1 and kept() <= held
    assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == sorted((str(i), text) for i, _, _, text in dedup_by_hand(lined))
