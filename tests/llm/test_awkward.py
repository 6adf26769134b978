"""Rows that no table should have: without ids or texts, repeated, tied, very long, beside columns named like the operators' own."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lattice.llm import common, exact, packing, quality, queries, repeats, sharding, urls
from tests.llm import brute

LOW = brute.LOWER
#: Names that the operators and stages use for columns of their own.
CLASHES = ("id", "mark", "gone", "mix", "part", "score", "size", "taken", "slot", "shard", "_at", "_of", "_name", "text_key", "m", "key", "runs", "d", "n_chars")


def passage(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def table():
    long = passage(1, 25_000)
    base = passage(2, 60)
    near = base.rsplit(" ", 2)[0] + " other words"
    return [
        (1, base, "a"), (2, base.upper(), "a"), (3, near, "b"), (4, passage(3, 50), None),
        (5, None, "a"), (6, "", "b"), (7, " \n\t", "b"), (None, base, "a"), (None, passage(4, 30), "a"),
        (8, passage(5, 40), "c"), (8, base, "c"), (9, passage(6, 20), "c"), (9, passage(6, 20), "c"),
        (10, long, "d"), (11, long + " tail", "d"), (12, "one", "a"), (13, "ONE", "a"),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(table(), "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    for c in CLASHES:
        df = df.withColumn(c, F.length("text").cast("long") if c == "n_chars" else F.lit(f"own {c}"))
    return df.repartition(3).cache()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def whole(rows):
    return Counter((i, t) for i, t, _ in rows)


def test_stage_of_quality(spark, docs, folder, monkeypatch):
    out = corpus_pipeline.good(spark, docs, folder)  # without labels all scores are 0.5
    assert out.columns == docs.columns and kept(out) == whole(table()) and {r.mark for r in out.select("mark").collect()} == {"own mark"}
    monkeypatch.setattr(quality, "fit_named", lambda *a: np.concatenate([np.zeros(1 << quality.BITS), [-9.0]]).astype(np.float32))
    assert corpus_pipeline.good(spark, docs, folder).count() == 0
    assert corpus_pipeline.good(spark, docs.limit(0), folder).count() == 0


def test_stage_of_exact_copies(spark, docs, folder):
    out = corpus_pipeline.distinct_texts(spark, docs, folder)
    low = lambda t: (t or "").translate(LOW)
    top = {}
    for i, t, _ in table():
        top[low(t)] = max((i is not None, i), top.get(low(t), (False, None)), key=lambda x: (x[0], x[1] or 0))
    want = whole([r for r in table() if top[low(r[1])] == (r[0] is not None, r[0])])
    assert out.columns == docs.columns and kept(out) == want
    assert kept(out)[9, passage(6, 20)] == 2 and kept(out)[8, passage(5, 40)] == 1 and (1, table()[0][1]) not in kept(out)
    assert corpus_pipeline.distinct_texts(spark, docs.limit(0), folder).count() == 0


def test_stage_of_near_copies(spark, docs, folder):
    out = corpus_pipeline.distinct_groups(spark, docs, folder)
    texts = dict((i, t) for i, t, _ in table() if i is not None)
    one = [(1, 1), (2, 1), (3, 1), (8, 1), (11, 10), (13, 12)]  # row, its group; 8 is of the first group by one of its texts
    assert 100 * len(brute.shingle_sets([(1, texts[1])])[1] & brute.shingle_sets([(3, texts[3])])[3]) >= 80 * len(brute.shingle_sets([(1, texts[1])])[1] | brute.shingle_sets([(3, texts[3])])[3])
    gone = {i for i, top in one if i != top}
    want = whole([r for r in table() if r[0] not in gone])
    got = kept(out)
    assert out.columns == docs.columns
    assert {k: n for k, n in got.items() if k[0] != 8} == {k: n for k, n in want.items()}
    assert (8, table()[0][1]) not in got and got[None, table()[0][1]] == 1
    assert corpus_pipeline.distinct_groups(spark, docs.limit(0), folder).count() == 0


def test_stage_of_the_mix(spark, docs, folder):
    out = corpus_pipeline.mixed(spark, docs, folder)
    assert out.columns == docs.columns
    words = lambda t: len(brute.WORD.findall(t or ""))
    size, taken = Counter(), Counter()
    for _, t, s in table():
        size[s] += words(t)
    rows = out.collect()
    for r in rows:
        taken[r.source] += words(r.text)
        assert r.text and r.n_chars == len(r.text) and any(t and t.startswith(r.text) for i, t, _ in table() if i == r.doc_id)
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, target, some = 1.5 * sum(size.values()), {}, set(order)
    while True:
        part = {s: left * weight[s] / sum(weight[x] for x in some) for s in some}
        full = {s for s in some if part[s] > 2 * size[s]}
        if not full:
            target |= part
            break
        for s in full:
            target[s] = 2 * size[s]
            left -= target[s]
        some -= full
    for s in order:  # the rows of 9 are alike, and taken as often as the one that is taken most
        assert abs(taken[s] - target[s]) <= 1 + (20 if s == "c" else 0)
    assert corpus_pipeline.mixed(spark, docs.limit(0), folder).count() == 0


def test_stage_of_packing(spark, docs, folder):
    got = corpus_pipeline.packed(spark, docs, folder).collect()
    import public_tokenizers
    from tokenizers import Tokenizer

    codec = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t, _ in table():
        want.update(brute.token_pieces([(i, t)], codec))
    assert Counter(tuple(r)[:5] for r in got) == want
    fill = Counter()
    for r in got:
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048 and len(fill) == -(-sum(fill.values()) // 2048)
    assert corpus_pipeline.packed(spark, docs.limit(0), folder).count() == 0


def test_scores_do_not_depend_on_neighbours(spark):
    sf = "/root/testdata/sf0.001"
    d, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scores = [{r.id: r.score for r in quality.classify(x, labels).collect()} for x in (d, d.repartition(7, "text"))]
    assert scores[0] == scores[1]


def test_quality_sample_is_bounded_in_bytes(spark):
    d = spark.createDataFrame([(i, passage(i, 100)) for i in range(60)], "id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "id long, label int")
    few, all_ = (quality.fit(d, labels, sample_bytes=n) for n in (3000, 1 << 30))
    assert 0 < np.count_nonzero(few) < np.count_nonzero(all_) / 3
    assert not np.count_nonzero(quality.fit(d, labels, sample_bytes=0))


def by_turns(shards, slots):
    """The table of slots, as the method says it: whole preference lists, and turns."""
    lists = []
    for s in shards:
        h = hashlib.sha256(s.encode()).digest()
        start, step = int.from_bytes(h[:8], "big") % slots, int.from_bytes(h[8:16], "big") % (slots - 1) + 1
        lists.append([(start + i * step) % slots for i in range(slots)])
    owner = {}
    while len(owner) < slots:
        for s, wanted in zip(shards, lists, strict=True):
            if len(owner) < slots:
                owner[next(x for x in wanted if x not in owner)] = s
    return [owner[i] for i in range(slots)]


def test_lookup_table():
    for names, slots in ((["a"], 2), (["x", "y", "z"], 101), ([f"s{i}" for i in range(13)], 499)):
        assert [names[s] for s in sharding.lookup_table(names, slots)] == by_turns(names, slots)


def test_sharding_with_clashing_columns(spark, docs):
    got = sharding.shard(docs, queries.SHARDS)
    assert got.columns == [c for c in docs.columns if c not in ("slot", "shard")] + ["slot", "shard"] and got.count() == len(table())
    by_own = sharding.shard(docs, queries.SHARDS, key_col="slot")
    assert by_own.select("slot").distinct().count() == 1
    assert sharding.shard(docs, queries.SHARDS, key_col="shard", slot_col="place").columns[-2:] == ["place", "shard"]


def test_urls_split_by_key(spark):
    rules = [(f"h{i}.com", "/a/" if i % 3 else "/", "block" if i % 2 else "allow") for i in range(90)] + [("com", "/a/b", "block")]
    pages = [(i, f"http://{'x.' * (i % 3)}H{i % 120}.com/a/{'b' if i % 5 == 0 else 'c'}?q") for i in range(400)] + [(400, None), (401, "http://" + "y." * 3000 + "h3.com/" + "z" * 5000), (1, "http://h1.com/a/")]
    d = spark.createDataFrame(pages, "page_id long, url string").withColumn("best", F.lit(1)).withColumn("host", F.lit("own"))
    one = sorted(map(tuple, urls.url_filter(d, rules).collect()), key=str)
    assert one == sorted(map(tuple, urls.url_filter(d, rules, most_keys=16).collect()), key=str)
    assert len(one) == len(pages) and {r[4] for r in one} == {"block", "allow"}
    assert [r[3] for r in one if r[0] == 401] == ["h3.com/"]
    assert {r[4] for r in urls.url_filter(d, []).collect()} == {"allow"}


def test_exact_of_null_ids_and_repeats(spark):
    d = spark.createDataFrame([(None, "A"), (None, "a"), (3, "b"), (3, "B"), (None, "b")], "doc_id long, text string")
    got = Counter((r.id, r.keep_id, r.group_size, r.kept) for r in exact.exact_dedup(d).collect())
    assert got == {(None, None, 2, True): 2, (3, 3, 3, True): 2, (None, 3, 3, False): 1}


def test_repeats_of_very_long_texts(spark):
    body = passage(7, 22_000)
    rows = [(1, body), (2, passage(8, 300) + " " + body[: len(body) // 2]), (3, body)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("m", F.lit(0)).withColumn("run", F.lit(0))
    got = {(r.id, r.n_symbols, r.n_removed, r.kept_sha256) for r in repeats.substring_dedup(d).collect()}
    assert got == brute.repeated_words(rows)
    got = {(r.id, r.n_symbols, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.byte_dedup(d).collect()}
    assert got == brute.repeated_bytes(rows)
    for f in (repeats.substring_dedup, repeats.byte_dedup):
        with pytest.raises(ValueError):
            f(d, window=4, gram=5)


def test_packing_of_repeated_rows(spark):
    d = spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "same text")], "doc_id long, text string")
    got = packing.pack(d).collect()
    assert len(got) == 3 and {(r.sequence_id, r.offset) for r in got} == {(got[0].sequence_id, i * got[0].length) for i in range(3)}


def test_intermediate_data_is_deleted(spark):
    df = common.cut(spark.range(10))
    path = df._cut_path.removeprefix("file://")
    import os

    assert os.path.isdir(path)
    common.release(df)
    assert not os.path.exists(path)
