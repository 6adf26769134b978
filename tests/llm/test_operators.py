"""The operators against brute force, on the small tables and on rows made to be awkward."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lattice.llm import ann, exact, jaccard, mixing, packing, quality, repeats, sharding, urls
from tests.llm import brute

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, source string, lang string, id long, n int, h1 string, runs string, weight double"


def awkward():
    rng = random.Random(5)
    words = ["alpha", "Beta", "gamma", "de", "x", "Straße", "naïve", "ÉTÉ", "日本", "\u00a0nb", "end."]
    text = lambda n: " ".join(rng.choice(words) + (str(rng.randrange(50)) if rng.random() < 0.6 else "") for _ in range(n))
    long, passage = text(6000), text(60)
    base = [text(n).split(" ") for n in (30, 80, 200)]
    rows = [None, "", " \t\n\x0b", "one", "two words", "ONE", "one", "a b c d e", "A B C D e", "e d c b a", long, long.upper(), long + " tail", "same " * 100, "same " * 70, "same same"]
    for b in base:
        for _ in range(30):  # near copies, more than a region pairs outright
            c = list(b)
            for _ in range(rng.randrange(4)):
                c[rng.randrange(len(c))] = text(1)
            rows.append(" ".join(c))
    rows += [f"{text(rng.randrange(1, 40))} {passage} {text(rng.randrange(1, 40))}" for _ in range(40)]
    rows += [passage, passage + " more", "<|endoftext|> in text", "\x00 nul \x00", "é" * 900, "é" * 901]
    return list(enumerate(rows))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, [None, "b", "a", "Z", "é"][i % 5], "en", -i, 0, "h", "r", 0.0) for i, t in awkward()]
    return spark.createDataFrame(rows, KIND).repartition(5, "doc_id").cache()


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_jaccard(docs):
    want, links = brute.jaccard(awkward())
    found, _ = jaccard.jaccard_join(docs)
    assert rows(found, "id", "n_shingles", "component_id") == want
    found, got = jaccard.jaccard_join(docs, all_links=True)
    assert rows(found, "id", "n_shingles", "component_id") == want
    sets = brute.shingle_sets(awkward())
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    assert rows(got, "a", "b") == {(a, b) for a, b in links if first[sets[a]] == a and first[sets[b]] == b and sets[a] != sets[b]}


def test_jaccard_on_documents(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    want, _ = brute.jaccard([(r.doc_id, r.text) for r in d.collect()])
    assert rows(jaccard.jaccard_join(d)[0], "id", "n_shingles", "component_id") == want


def hot_phrase():
    """Texts with one phrase, and short near copies that share it first, differ at the second place and share the third with nobody else."""
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    sets = lambda *texts: [s.tolist() for s in jaccard.sets_of(pa.array(texts), 5)]
    hot = min((fresh(5) for _ in range(300)), key=lambda w: sets(" ".join(w)))
    first = sets(" ".join(hot))[0][0]
    texts, copies = [], []
    while len(texts) < 60:
        t = " ".join(hot + fresh(9))
        if sets(t)[0][0] == first:
            texts.append(t)
    while len(copies) < 24:
        same = hot + fresh(8)
        a, b = " ".join(same + fresh(1)), " ".join(same + fresh(1))
        x, y = sets(a, b)
        if x[0] == y[0] == first and x[1] not in y and y[1] not in x and x[2] == y[2]:
            copies += [a, b]
    return list(enumerate(texts + copies))


def test_jaccard_of_short_copies_with_a_hot_phrase(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "_levels", lambda described: np.zeros(1 << jaccard.SKETCH_BITS, np.uint8))  # as in a corpus so large that the phrase is ordinary
    texts = hot_phrase()
    want, links = brute.jaccard(texts)
    assert len(links) == 12
    d = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    found, _ = jaccard.jaccard_join(d)
    assert rows(found, "id", "n_shingles", "component_id") == want
    found, got = jaccard.jaccard_join(d, all_links=True)
    assert rows(found, "id", "n_shingles", "component_id") == want and rows(got, "a", "b") == links


def test_exact(docs):
    groups = defaultdict(list)
    for i, t in awkward():
        groups[(t or "").translate(brute.LOWER)].append(i)
    want = {(i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert rows(exact.exact_dedup(docs), "id", "keep_id", "group_size", "kept", "text_sha256") == want


def test_exact_tells_clashing_chunks_apart(spark, monkeypatch):
    monkeypatch.setattr(exact.F, "xxhash64", lambda *c: F.length(F.concat_ws("", *(x.cast("string") if not isinstance(x, str) else F.col(x).cast("string") for x in c))).cast("long"))
    d = spark.createDataFrame([(1, "aaaa"), (2, "bbbb"), (3, "aaaa"), (4, "BBBB"), (5, "c")], "doc_id long, text string")
    assert rows(exact.exact_dedup(d), "id", "keep_id", "group_size") == {(1, 3, 2), (3, 3, 2), (2, 4, 2), (4, 4, 2), (5, 5, 1)}


def test_repeated_words(docs):
    assert rows(repeats.substring_dedup(docs), "id", "n_symbols", "n_removed", "kept_sha256") == brute.repeated_words(awkward())


def test_repeated_bytes(docs):
    assert rows(repeats.byte_dedup(docs), "id", "n_symbols", "n_removed", "n_spans", "kept_sha256") == brute.repeated_bytes(awkward())


def test_repeats_without_filter(docs, monkeypatch):
    monkeypatch.setattr(repeats, "key_filter", lambda *a: None)
    assert rows(repeats.substring_dedup(docs), "id", "n_symbols", "n_removed", "kept_sha256") == brute.repeated_words(awkward())


@pytest.mark.parametrize("together", [1, 3])
def test_repeats_of_crowded_anchors(docs, monkeypatch, together):
    monkeypatch.setattr(repeats, "TOGETHER", together)  # anchors grow, up to whole windows
    assert rows(repeats.substring_dedup(docs), "id", "n_symbols", "n_removed", "kept_sha256") == brute.repeated_words(awkward())
    assert rows(repeats.byte_dedup(docs), "id", "n_symbols", "n_removed", "n_spans", "kept_sha256") == brute.repeated_bytes(awkward())


def test_factors_are_cut_where_the_reference_ends():
    block = repeats.Block(3)
    a, b, c = b"a b c d e f".split(), b"x c d e f g".split(), b"b c d e f g h".split()
    assert block.parse(a) == [] and block.parse(b) == [(1, 2)]
    assert block.parse(c) == [(0, 3), (3, 1)]  # one factor up to the end of a, and one from b across it


def test_repeated_rows_are_no_repeats(spark):
    text = " ".join(f"w{i}" for i in range(60))
    d = spark.createDataFrame([(1, text), (1, text)], "doc_id long, text string")
    assert rows(repeats.substring_dedup(d), "id", "n_removed") == {(1, 0)}
    assert rows(repeats.byte_dedup(d, window=100, gram=16), "id", "n_removed") == {(1, 0)}


def test_mixing(docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(awkward())
    size = Counter()
    for r in got:
        size[r.source] += r.size
        assert r.size == len(brute.WORD.findall(dict(awkward())[r.id] or ""))
        assert 0 <= r.taken <= 2 * r.size
    order = sorted((s for s in size if s is not None)) + [None]
    weight, cap = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, {s: 2 * n for s, n in size.items()}
    target, left = {}, 1.5 * sum(size.values())
    open_ = set(order)
    while True:  # as the contract says it: share, stop at the cap, share the rest again
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > cap[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = cap[s]
            left -= cap[s]
        open_ -= full
    for s in order:
        mine = [r for r in got if r.source == s]
        assert {r.source_size for r in mine} == {size[s]}
        assert all(abs(r.target - target[s]) < 1e-6 for r in mine)
        assert abs(sum(r.taken for r in mine) - target[s]) <= 1
        assert max(r.taken // r.size for r in mine if r.size) - min(r.taken // r.size for r in mine if r.size) <= 1
    assert {tuple(r) for r in got} == {tuple(r) for r in mixing.mix(docs.repartition(3)).collect()}


def test_mixing_prefers_heavier(spark):
    d = spark.createDataFrame([(i, "w " * 10, "s" if i % 3 else "t") for i in range(3000)], "doc_id long, text string, source string")
    q = spark.createDataFrame([(i, 4.0 if i % 2 else 1.0) for i in range(3000)], "id long, w double")
    extra = Counter()
    for r in mixing.mix(d, q).collect():
        extra[r.id % 2] += r.taken - 10  # both sources take one whole epoch first
    assert extra[1] > 1.3 * extra[0]


def test_quality(spark):
    d, labels = spark.read.parquet(f"{SF}/../sf0.01/documents.parquet"), spark.read.parquet(f"{SF}/../sf0.01/labels.parquet")
    got = quality.classify(d, labels).join(labels.withColumnRenamed("doc_id", "id"), "id").where("held_out").collect()
    good, bad = [r.score for r in got if r.quality], [r.score for r in got if not r.quality]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc > 0.97
    assert all(r.predicted == (r.score >= 0.3) for r in got)


def test_quality_of_awkward_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2 if i % 7 else None) for i in range(120)] + [(None, 1)], "doc_id long, quality int")
    got = quality.classify(docs, some).collect()
    assert len(got) == len(awkward()) and all(0 <= r.score <= 1 for r in got)


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    got = packing.pack(docs).collect()
    assert {tuple(r)[:5] for r in got} == brute.token_pieces(awkward(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) + 1


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_crossover_makes_the_plan_of_the_real_table(spark, sf):
    table = spark.read.parquet(f"{SF}/../{sf}/documents.parquet")
    pieces = packing.in_batches(table.select(F.col("doc_id").alias("id"), "text"), packing._pieces(packing.vocabulary(), 2048), "id long, piece int, start long, length long, ids_crc32 long")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    bins, generation = packing.plan_bins(spark, counts, 2048)
    packer = packing.Packer(counts, 2048, 0)
    assert generation > 0  # no plan that an island started from
    assert packer.number(bins) <= packer.number(packer.seed_bins(0.0))  # nor worse than best-fit decreasing
    assert packer.number(bins) == packer.least
    assert min(packer.number(packing.Packer(counts, 2048, i).seed_bins(x)) for i in range(3) for x in packing.DISTURBED) > packer.least


def test_packing_is_no_worse_than_best_fit_with_a_group_of_like_lengths(spark):
    rng = np.random.default_rng(0)
    lengths = np.clip(rng.lognormal(6, 0.8, 20_000), 2, 2047).astype(int)
    lengths[:5000] = rng.integers(325, 336, 5000)
    counts = {int(k): int(n) for k, n in Counter(lengths.tolist()).items()}
    bins, generation = packing.plan_bins(spark, counts, 2048)
    packer = packing.Packer(counts, 2048, 0)
    assert generation > 0
    assert packer.number(bins) <= packer.number(packer.seed_bins(0.0))
    held = Counter()
    for content, n in bins.items():
        assert sum(content) <= 2048
        for k in content:
            held[k] += n
    assert held == counts


def test_packer_improves():
    rng = np.random.default_rng(3)
    counts = Counter(int(x) for x in rng.integers(300, 900, 400))
    packer = packing.Packer(counts, 1000, 1)
    a, b = packer.seed_bins(0.0), packer.seed_bins(0.3)
    child = packer.cross(a, b)
    for bins in (a, b, child):
        held = Counter()
        for content, n in bins.items():
            assert sum(content) <= 1000
            for k in content:
                held[k] += n
        assert held == counts


def test_sharding(spark, docs):
    names = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(names, 101)
    assert set(Counter(table).values()) <= {14, 15}
    got = sharding.shard(docs, names, slots=101).collect()
    for r in got:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:12], 16) % 101
        assert (r.slot, r.shard) == (slot, names[table[slot]])
    fewer = sharding.lookup_table(names[:-1], 101)
    assert sum(a == b for a, b in zip(table, fewer, strict=True)) > 60
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)


def test_nearest(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:300] = x[7]  # many alike
    x[5] = 0
    rows_ = [(i, [float(v) for v in x[i]], "e") for i in range(600)]
    rows_ += [(700, None, "e"), (750, [], "e"), (800, [1.0, None] * 8, "e"), (850, [float("nan")] * 16, "e"), (900, [float("inf")] * 16, "e"), (950, [1.0, 2.0], "e"), (951, [2.0, 4.0], "e")]
    d = spark.createDataFrame(rows_, "vec_id long, embedding array<float>, ids string").repartition(4)
    got = defaultdict(list)
    for r in ann.nearest(d, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    y = x.astype(np.float64)
    norm = np.sqrt((y * y).sum(1))
    fine = np.flatnonzero(norm > 0)
    assert set(got) == {*range(0, 600, 50), 950}
    assert got[950] == [(951, pytest.approx(1.0))]
    for q in range(0, 600, 50):
        c = np.array([(y[q] * y[j]).sum() / (norm[q] * norm[j]) for j in fine])
        c = [(-round(s, 12), int(j), s) for s, j in zip(c, fine, strict=True) if j != q]
        want = sorted(c)[:5]
        assert [v for v, _ in got[q]] == [j for _, j, _ in want]
        assert [s for _, s in got[q]] == pytest.approx([s for _, _, s in want], abs=1e-12)


def test_nearest_of_repeated_rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 8)).astype(np.float32)
    one = [(i, [float(v) for v in x[i]]) for i in range(40)]
    schema = "vec_id long, embedding array<float>"
    pick = ("query_id", "rank", "vec_id", "score")
    want = sorted(map(tuple, ann.nearest(spark.createDataFrame(one, schema), F.col("vec_id") % 10 == 0).select(*pick).collect()))
    y = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1)[:, None]
    assert [(q, v) for q, _, v, _ in want] == [(q, int(j)) for q in range(0, 40, 10) for j in [j for j in np.argsort(-(y @ y[q])) if j != q][:5]]
    for copies, parts in ((2, 1), (7, 1), (7, 5)):
        d = spark.createDataFrame(one * copies, schema).repartition(parts)
        assert sorted(map(tuple, ann.nearest(d, F.col("vec_id") % 10 == 0).select(*pick).collect())) == want
    scaled = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1.0, 1.0])], schema)  # an id with different vectors has a candidate for each, as in the SQL
    assert [tuple(r) for r in ann.nearest(scaled, F.col("vec_id") == 0, 3).orderBy("rank").select("rank", "vec_id").collect()] == [(1, 1), (2, 1), (3, 2)]


RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def test_urls(spark):
    list_ = [None, "", "no scheme", "http://", "http://a.com/en/1", "http://x.EXAMPLE.com/en/77?q=/en/", "http://example.com/en/", "https://com/en/", "ftp://dotcom/en/", "http://b.example.net/de/8#x", "http://net?/de/", "http://net/DE/", "a://b://example.org/es/", "http://example.org/es", "http://.org/es/1", "http://[x].com/en/\n"]
    d = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(list_)], "page_id long, url string, host string, rule string")

    def plain(u):
        rest = (u or "").split("://", 1)[1] if "://" in (u or "") else ""
        host = rest
        for c in "/?#":
            host = host.split(c)[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = host.translate(brute.LOWER)
        fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, "allow")

    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in urls.url_filter(d, RULES).collect()}
    assert got == {i: plain(u) for i, u in enumerate(list_)}


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"))
    listed = universe.where(F.crc32(F.col("key").cast("binary")) % 9 == 0)
    cascade = urls.build_cascade(listed, universe)
    wrong = universe.where(cascade.has(F.col("key")) != (F.crc32(F.col("key").cast("binary")) % 9 == 0))
    assert wrong.count() == 0 and len(cascade.levels) > 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], KIND)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [x.count() for x in jaccard.jaccard_join(none)] == [0, 0]
    for df in (exact.exact_dedup(none), repeats.substring_dedup(none), repeats.byte_dedup(none), mixing.mix(none), quality.classify(none, labels), packing.pack(none), sharding.shard(none, ["a"])):
        assert df.count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(vectors, F.col("vec_id") % 50 == 0).count() == 0
    assert urls.url_filter(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
