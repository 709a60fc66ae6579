"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import glob
import hashlib
import itertools
import os
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenaudit.llm import components, crosspolytope, html_template, lattice_lm, minhash, mixing, packing, token_counts, token_orc, topk, toxicity
from lumenaudit.llm.common import scratch_path, tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key string, bucket string, score string, band string, part string, ids string, h string, c string, before string"


def rows_of():
    rnd = random.Random(3)
    words = ["the", "an", "Den", "été", "loser", "x1", "straße", "über,", "it's", "日本", "🙂", "a", "b-c"]
    make = lambda n: " ".join(rnd.choice(words) + rnd.choice(["", "", "."]) for _ in range(n))
    base = make(60)
    texts = [None, "", " \t\n ", "one", "one two three four", base, base, base.upper(), base + " tail", base.replace("the", "THE") + " other end of it", make(9_000), "x" * 30_000, make(200), make(200), "a  b   c ", "<|endoftext|> x"]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, 0) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, "no id at all here now", None, None, None)]
    return [(*r, *["clash"] * 10) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))


def ids_of(lib, text):
    return lib.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_counts(docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs).collect())
    want = sorted((r[0] or -1, len((r[1] or "").encode()), n := len(sp.encode(r[1] or "")), n > 4096) for r in rows_of())
    assert got == want
    assert token_counts.count_tokens(none).count() == 0


def test_runs_of_spaces_are_counted_in_linear_time():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    c = token_counts.counter("piece_bpe_32k.model")
    assert c.ranks.runs is not None
    rnd = random.Random(2)
    texts = [" " * n + w for n in range(70) for w in ("", "the", "Zq", "\n", "日")] + [f"a{' ' * rnd.randrange(60)}b{' ' * rnd.randrange(60)}" for _ in range(300)]
    assert c.count(pa.array(texts)).tolist() == [len(sp.encode(t)) for t in texts]
    long = ["x" + " " * 100_000, " " * 100_001 + "the", " " * 100_002]
    began = time.time()
    got = c.count(pa.array(long)).tolist()
    assert time.time() - began < 1
    assert got == [len(sp.encode(t)) for t in long]


def test_packing_places_every_piece_once(docs, none):
    lib = library()
    got = packing.pack_documents(docs).collect()
    want = defaultdict(int)
    for r in rows_of():
        ids = [*ids_of(lib, r[1]), 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            part = ids[s : s + 2048]
            want[r[0], p, s, len(part), crc(part)] += 1
    have = defaultdict(int)
    by_sequence = defaultdict(list)
    for r in got:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(none).count() == 0


def test_sum_of_squares_rule():
    lengths = np.random.default_rng(1).integers(1, 21, 400)
    got, offset = packing.sum_of_squares(lengths, 20)
    gaps, n = [], [0] * 21
    for size, b in zip(lengths.tolist(), got.tolist()):
        options = {}
        for g in [*{x for x in gaps if x >= size}, 20]:
            m = n.copy()
            if g < 20:
                m[g] -= 1
            if g - size > 0:
                m[g - size] += 1
            options[g] = sum(x * x for x in m[1:20])
        g = 20 if b == len(gaps) else gaps[b]
        assert options[g] == min(options.values())
        if b == len(gaps):
            gaps.append(20)
        else:
            n[g] -= 1
        gaps[b] = g - size
        if gaps[b]:
            n[gaps[b]] += 1
    assert len(set(got.tolist())) <= 1.05 * np.ceil(lengths.sum() / 20) + 1


def test_token_orc_round_trip(spark, docs, none):
    lib = library()
    path = scratch_path(spark, "test-orc")
    token_orc.write_token_orc(docs, path, shard_rows=5)
    got = token_orc.token_digests(token_orc.read_token_orc(spark, path)).collect()
    want = sorted(((r[0] if r[0] is not None else -1), len(ids := [*ids_of(lib, r[1]), 2]), crc(ids)) for r in rows_of())
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [(r.doc_id if r.doc_id is not None else -1) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    assert [r.doc_id for r in token_orc.read_token_orc(spark, path, doc_ids=[3]).collect()] == [3]
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,4)" in token_orc.read_token_orc(spark, path, lo=4)._jdf.queryExecution().toString()
    # The files themselves, in the order of their names, have the ids at the places that the digests tell, for doc_ids of any type.
    for name, of in (("long", docs), ("string", docs.withColumn("doc_id", F.col("doc_id").cast("string")))):
        token_orc.write_token_orc(of, f"{path}-{name}", shard_rows=4)
        in_files, starts, at = [], defaultdict(list), 0
        for f in sorted(glob.glob(f"{path}-{name}/part-*")):
            for r in spark.read.orc(f).orderBy("row").collect():
                in_files.append((r.doc_id, at, len(r.ids), crc(r.ids)))
                at += len(r.ids)
        digests = [tuple(r) for r in token_orc.token_digests(token_orc.read_token_orc(spark, f"{path}-{name}")).collect()]
        assert sorted(digests, key=str) == sorted(in_files, key=str)
        ids = [r[0] for r in in_files]
        assert ids == sorted(ids, key=lambda i: (i is not None, i))
    token_orc.write_token_orc(none, path + "-none")
    assert token_orc.token_digests(token_orc.read_token_orc(spark, path + "-none")).count() == 0


def test_token_orc_metadata_skips_rows(spark):
    """Bloom filters and row indexes are in the files, and a read by doc_id takes no more than the row groups that may hold it."""
    n = 12_000
    d = spark.range(n).select((F.col("id") * 3).alias("doc_id"), F.lit("one two three").alias("text"))
    path = scratch_path(spark, "test-orc-skip")
    token_orc.write_token_orc(d, path, shard_rows=n)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    (file,) = [f for f in glob.glob(f"{path}/part-*") if os.path.getsize(f)]
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    assert reader.getRowIndexStride() == 1_000
    rows = reader.rows()
    column = 1  # doc_id: column 0 is the row itself
    included = spark.sparkContext._gateway.new_array(jvm.boolean, reader.getSchema().getMaximumId() + 1)
    included[column] = True
    index = rows.readRowIndex(0, included, included)
    assert index.getRowGroupIndex()[column].getEntryCount() >= 2 and index.getBloomFilterIndex()[column].getBloomFilterCount() >= 2
    rows.close()

    def scanned(df):
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            plan = df._jdf.queryExecution()
            assert plan.executedPlan().executeCollect() is not None
            scan = plan.executedPlan().collectLeaves().head()
            return scan.metrics().apply("numOutputRows").value()
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")

    assert scanned(token_orc.read_token_orc(spark, path)) == n
    assert 0 < scanned(token_orc.read_token_orc(spark, path, lo=3 * 5_200, hi=3 * 5_300)) <= 2_000  # by the row index
    assert scanned(token_orc.read_token_orc(spark, path, doc_ids=[3 * 5_200 + 1])) <= 1_000  # in the range of a row group, but in no document: by the Bloom filter, but for a false positive


def test_mixing(docs, none):
    got = mixing.mix_sources(docs).collect()
    sizes = [len((r[1] or "").encode().split()) for r in rows_of()]
    assert sorted(r["size"] for r in got) == sorted(sizes)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r["size"]
    total = 0
    for rows in by.values():
        assert sum(r.taken for r in rows) == int(rows[0].target) and rows[0].target <= 3 * rows[0].source_size
        total += rows[0].target
    assert abs(total - sum(sizes)) < 1e-6 * sum(sizes)
    again = mixing.mix_sources(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix_sources(none).count() == 0


def test_minhash_equals_brute_force(docs, none):
    got = minhash.near_duplicates(docs).collect()
    sets = {}
    for r in rows_of():
        w = (r[1] or "").encode().lower().split()
        sets[r[0]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    label = {i: i for i in sets if i is not None}
    for _ in label:
        for a in label:
            for b in label:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.component_id == label[r.doc_id] and r.kept == (label[r.doc_id] == r.doc_id)
    assert len(got) == len(rows_of())
    assert minhash.near_duplicates(none).count() == 0


def test_minhash_family_of_edited_copies(spark):
    rnd = random.Random(5)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        words = base.copy()
        for _ in range(rnd.randrange(0, 14)):
            words[rnd.randrange(120)] = f"e{rnd.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in rows}
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in label:
            for b in label:
                if a < b and label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    assert got == label


def two_texts_of_one_id():
    rnd = random.Random(8)
    a, b = (" ".join(f"{k}{rnd.randrange(10**6)}" for _ in range(80)) for k in "ab")
    return a, b, [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (0, "some other text that is like nothing else here"), (1, a), (7, None), (7, None)]


def test_minhash_links_each_text_of_a_repeated_id(spark):
    a, b, rows = two_texts_of_one_id()
    got = {(r.doc_id, r.text_md5): r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k[0]: r.component_id for k, r in got.items()} == {0: 0, 1: 1, 2: 1, 3: 1, 7: 7}
    assert all(r.component_id == 1 and r.kept for k, r in got.items() if k[0] == 1)
    assert {k[0] for k, r in got.items() if r.first} == {0, 1, 7}
    assert all(r.first for k, r in got.items() if k[0] == 1)  # the two texts are groups of their own
    # A near copy with a smaller id takes one of the two texts with it, not the other.
    rows = [(0, b + " tail"), (1, a), (1, b)]
    got = {(r.doc_id, r.text_md5): (r.component_id, r.first) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    assert got == {(0, md5(b + " tail")): (0, True), (1, md5(a)): (1, True), (1, md5(b)): (0, False)}


def test_pipeline_drops_rows_not_ids(spark, sf):
    import corpus_pipeline as P

    a, b, rows = two_texts_of_one_id()
    rows = [(0, b + " tail"), (1, a), (1, a), (1, b), (None, b), (4, None), (4, None)]
    d = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, text_md5 string, mix_size int")
    got = [(r.doc_id, r.text) for r in P.drop_near_duplicates(spark, d, sf).collect()]
    assert sorted(got, key=str) == sorted([(0, b + " tail"), (1, a), (None, b), (4, None)], key=str)


def test_mixed_documents_equal_the_copies_of_the_mix(spark):
    rnd = random.Random(12)
    rows = [(i % 300 if i % 7 else None, " ".join("w" * rnd.randrange(0, 9)), rnd.choice(["a", "b", "c", None]), "x", "y") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_size string, mix_cut string")
    want = defaultdict(int)
    for r in mixing.copies_of(mixing.mix_sources(d), keep=("source", "size")).collect():
        key = (r.doc_id, r.source, r["size"])
        want[key] = max(want[key], r.copies)
    rows_of_key = defaultdict(int)
    for i, t, s, *_ in rows:
        rows_of_key[i, s, len((t or "").split())] += 1
    got = defaultdict(int)
    out = mixing.mixed_documents(d)
    assert out.columns == d.columns
    for r in out.collect():
        got[r.doc_id, r.source, len((r.text or "").split())] += 1
    assert dict(got) == {k: want[k] * n for k, n in rows_of_key.items() if want[k]}
    assert mixing.mixed_documents(d.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long").repartition(7)
    got = {r.node: r.component for r in components.connected_components(e, "test").collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def vectors():
    rng = np.random.default_rng(7)
    centre = rng.normal(size=64)
    rows = [(i, (centre + rng.normal(size=64) * 0.1 * (i % 3)).tolist(), 1, "clash") for i in range(120)]
    rows += [(200 + i, rng.normal(size=64).tolist(), i % 2, "clash") for i in range(100)]
    rows += [(400, rows[0][1], 1, "x"), (401, rows[0][1], None, "x"), (402, None, 1, "x"), (403, [0.0] * 64, 1, "x"), (404, [float("nan")] * 64, 1, "x"), (405, [1.0] * 63 + [None], 1, "x"), (406, [1.0] * 3, 1, "x"), (407, [], 1, "x")]
    return [*rows, (None, rows[0][1], 1, "x"), rows[0]]


def test_near_embeddings_equal_brute_force(spark):
    rows = vectors()
    other = (np.array(rows[205][1]) * 2 + 0.001).tolist()
    rows += [(3, rows[205][1], 1, "x"), (500, other, 1, "x"), (501, rows[0][1], 1, "x")]  # 3 has two vectors: 500 is near the one, 501 the other
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, codes string")
    got = crosspolytope.near_embeddings(df).collect()
    ok = lambda v, lab, i: i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    good = [(i, np.array(v), lab) for i, v, lab, _ in rows if ok(v, lab, i)]
    near = [[p != q and lab == lab2 and len(v) == len(w) and v @ w / np.sqrt(v @ v) / np.sqrt(w @ w) >= 0.98 for q, (_, w, lab2) in enumerate(good)] for p, (_, v, lab) in enumerate(good)]
    label = [i for i, *_ in good]
    for _ in range(8):
        for p in range(len(good)):
            label[p] = min([label[p], *(label[q] for q in range(len(good)) if near[p][q])])
    want = Counter((i, sum(near[p]), label[p], i == label[p]) for p, (i, *_) in enumerate(good))
    want.update((i, 0, i, True) for i, v, lab, _ in rows if not ok(v, lab, i))
    assert Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == want
    assert {r.component_id for r in got if r.vec_id in (500, 501)} == {0, 3}
    assert len(got) == len(rows)
    assert crosspolytope.near_embeddings(df.limit(0)).count() == 0


def best_by_brute_force(rows, k):
    good = [(i, np.floor(64 * np.array(x)).astype(int)) for i, x, *_ in rows if i is not None and x is not None and all(e is not None and np.isfinite(e) for e in x)]
    dot = lambda a, b: int(a[: min(len(a), len(b))] @ b[: min(len(a), len(b))])
    pairs = defaultdict(list)
    for i, q in good:
        if i % 20 == 0:
            pairs[i] += [(-dot(q, d), j) for j, d in good if j != i]
    return sorted((i, n + 1, j, -s) for i, p in pairs.items() for n, (s, j) in enumerate(sorted(p)[:k]))


def test_top_k_equals_brute_force(spark):
    # Ties, repeated rows (also of queries), vectors of other sizes, an id that many rows share.
    rows = [(i, v, lab, "x") for i, v, lab, _ in vectors()] + [(1_000 + i, [0.5] * 64, 0, "x") for i in range(30)] + [(60, [float(i % 5)] * 10, 0, "x") for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, v string")
    v = topk.integer_vectors(df)
    got = topk.top_k(v, v.where("vec_id % 20 = 0"), k=5, block_rows=64, tile_rows=7).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == best_by_brute_force(rows, 5)
    assert topk.top_k(v.limit(0), v.limit(0)).count() == 0
    assert topk.top_k(v, v.limit(0)).count() == 0


def test_top_k_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.op3_top_k(spark, sf).collect()) == best_by_brute_force(rows, 20)


def test_top_k_skips_blocks_whose_bound_is_below_the_kth():
    rng = np.random.default_rng(3)
    # Ranges of documents that differ in size: only the first can serve.
    d = np.concatenate([rng.integers(50, 90, (topk.BLOCK, 8)), rng.integers(0, 40, (4 * topk.BLOCK, 8))])
    q = rng.integers(1, 9, (6, 8))
    row, vec, score, scored = topk.search(np.full(6, -1), q, np.arange(len(d)), d, 10, np.full(6, -(2**62)))
    assert scored == 6
    for i in range(6):
        s = d @ q[i]
        assert score[row == i].tolist() != [] and sorted(zip(-score[row == i], vec[row == i])) == sorted(zip(-s, range(len(d))))[:10]


def test_html():
    page = """<!doctype html><html><head><title>x</title><style>p{}</style></head><body><nav><a href=/>Menu</a></nav><div id="cookie-notice">We use</div><article><h1>A &amp; b</h1>
      <p>One <a href=x>two</a>three<!-- c --><br>four<p>five&nbsp;six<div class="ad">buy</div><ul><li>se<b>v</b>en<li>eight</ul><form>mail</form><section class="comments"><p>bad</p></section><script>x="</p>"</script></article><footer>f</footer>"""
    assert html_template.main_text(page, None, frozenset()) == "A & b One twothree four five six seven eight"
    assert html_template.main_text(None, None, frozenset()) == html_template.main_text("", None, frozenset()) == ""
    assert html_template.main_text("<p>cut off <b", None, frozenset()) == "cut off"


def test_html_names_drop_only_whole_names():
    page = """<body><div class="search">find</div><article class="post"><header class="entry-header"><h1>Head</h1></header><p class="notice">A notice.</p><div class="article-tags">Two tags</div><div class="related-work">Related work</div>
      <ul class="share-prices"><li>up</ul><div id="search-results">found <span class="ad">buy</span>it</div><div class="share">tweet</div><article class="comment"><p>bad</p></article></article><article class="comment">worse</article>"""
    assert html_template.main_text(page, None, frozenset()) == "Head A notice. Two tags Related work up found it"
    assert html_template.main_text("<div class='alert'>careful</div><div class='post-header'>Head</div><p>text</p>", None, frozenset()) == "Head text"


@pytest.mark.parametrize("name", ["share", "sharing", "social", "widget", "overlay", "subscribe", "subscription", "login", "menu", "pager"])
def test_html_paragraphs_named_by_their_subject(name):
    """Inside the article they are content, as a block of that name is not; outside they are none; adverts and comments never are."""
    page = f'<body><p class="{name}">Out.</p><article><h1>Head</h1><p class="{name}">In.</p><div class="{name}">Block.</div><p class="advert">Buy.</p><p class="reply">Me too.</p><p>{"End. " * 20}</p></article></body>'
    assert html_template.main_text(page, None, frozenset()) == "Head In. " + "End. " * 19 + "End."


def test_html_template_drops_such_paragraphs_where_pages_share_them(spark):
    rows = [(k, f"http://h/{k}", f'<body><article><h1>Head {k}</h1><p class="share">Share this story.</p><p class="menu">Menu of day {k}</p><p>{f"Story {k}. " * 30}</p></article></body>') for k in range(6)]
    got = {r.page_id: r.text for r in html_template.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Head {k} Menu of day {k} " + (f"Story {k}. " * 30).strip() for k in range(6)}


def test_html_template_of_a_host_without_article(spark):
    rows = [(i, f"https://h.example/{i}", f"<body><div class=top><p>Welcome to the site</p></div><div class=text><p>Body number {i} has words {'w' * i} of its own.</p></div><div class=end><p>All rights of the site</p></div></body>", "c") for i in range(8)]
    rows += [(90, None, None, "c"), (91, "https://h.example/0", rows[0][2], "c"), (92, "x", "<p>Alone</p>", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r.page_id: r.text for r in html_template.extract_main_text(df).collect()}
    assert got[3] == "Body number 3 has words www of its own." and got[90] == "" and got[91] == got[0] and got[92] == "Alone"
    assert html_template.extract_main_text(df.limit(0)).count() == 0


def test_html_template_inside_main(spark):
    page = lambda i, own: f"<html><body><main><div class=box><p>Share this page</p></div><h1>Head {i}</h1><p>{own}</p><div class=more><p>Read more on our site</p></div></main><article class=teaser><p>Teaser {i}</p></article></body>"
    rows = [(i, f"https://m.example/{i}", page(i, f"Story {i} tells of {'x' * i} things that no other page of the host has")) for i in range(8)]
    rows += [(20 + i, f"https://copies.example/{i}", page(0, "The same story at many addresses")) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_template.extract_main_text(df).collect()}
    assert got[3] == "Head 3 Story 3 tells of xxx things that no other page of the host has"
    assert "Head 0 The same story at many addresses" in got[22]  # what copies share is no template


def test_html_template_of_layouts_and_long_texts(spark):
    terms = "These are the terms of the site. " * 100
    rows = [(i, f"https://h.example/{i}", f"<body><div class=l{'abc'[i % 3]}><div class=text><p>Body {i} of x{'y' * i} its own</p><p>Welcome to part {i % 3}</p><div class=end><p>{terms}{i % 3}</p></div></div></div></body>") for i in range(18)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in html_template.extract_main_text(df).collect()} == {f"Body {i} of x{'y' * i} its own" for i in range(18)}


def test_html_template_alone_tells_the_article(spark, sf):
    """Without any name of a class or an element: menus, headers, footers, forms and the like are what a host's pages share, and the article is the slot."""
    rnd = random.Random(13)
    story = lambda: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    rows, want = [], {}
    for i in range(40):
        host, text = i % 2, [f"Title {story()[:20]}", story(), story()]
        menu = "".join(f"<li><a href=/{k}>Part {k} of {host}</a></li>" for k in range(8))
        body = f"<div class=x1><ul>{menu}</ul></div><div class=x2><h1>{text[0]}</h1><p>{text[1]}</p><div><p>Share this with friends</p></div><p>{text[2]}</p></div><div class=x3><p>About host {host}</p><form><p>Write to us</p></form></div>"
        rows.append((i, f"https://host{host}.example/{i}", f"<html><head><title>t</title></head><body>{body}</body></html>"))
        want[i] = " ".join(text)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_template.extract_main_text(df, names=False).collect()}
    assert got == want
    emptied = {i: html_template.main_text(page, None, frozenset(), names=False) for i, _, page in rows}
    assert all(emptied[i] != want[i] for i in want)  # nothing else would tell it
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    own, alone = ({r.page_id: r.text for r in html_template.extract_main_text(pages, names=n).collect()} for n in (True, False))
    host_of = {r.page_id: r.url.split("/")[2] for r in pages.collect()}
    on_large_hosts = [k for k, h in host_of.items() if Counter(host_of.values())[h] >= 5]
    assert all(own[k] == alone[k] for k in on_large_hosts)


def test_toxicity(spark, docs, none):
    rnd = random.Random(9)
    clean = lambda: " ".join(rnd.choice(["river", "stone", "house", "window", "garden", "bread", "letter"]) for _ in range(60))
    rows = []
    for i in range(600):
        t = clean()
        if i % 4 == 0:
            w = rnd.choice(["loser", "moron", "l0ser", "m0r0n", "looooser", "m.o.r.o.n"])
            t = t.replace("stone", w, 1) if "stone" in t else w + " " + t
        rows.append((i, t))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 600) if i % 3], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(d, labels).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    out = toxicity.score_toxicity(docs, labels).collect()
    assert len(out) == len(rows_of()) and all(0 <= r[-1] <= 1 for r in out)
    assert toxicity.score_toxicity(none, labels).count() == 0
    assert {r.score for r in toxicity.score_toxicity(d, labels.limit(0)).collect()} == {0.0}


def likely(spark):
    return toxicity.language_model(spark.createDataFrame([("loser moron pathetic window idiot stupid " * 50,)], "text string"))


def test_restore_picks_the_likely_word(spark):
    lm = likely(spark)
    for disguised, word in (("l0ser", "loser"), ("1d10t", "idiot"), ("m-o-r-o-n", "moron"), ("stuuuupid", "stupid"), ("p4th3tic", "pathetic")):
        assert toxicity.restore(disguised, lm) == word


def test_restore_equals_exhaustive_search(spark):
    lm = likely(spark)
    rnd = random.Random(1)
    words = ["".join(rnd.choice("lo0s3r.-1i!8aaée+|") for _ in range(rnd.randrange(1, 9))) for _ in range(150)]

    def paths(word):
        runs = [(m[1], len(m[0])) for m in toxicity._RUN.finditer(word)]
        return itertools.product(*(toxicity._arcs(*r) for r in runs))

    def score(path):
        symbols = [0, 0, *(z for _, zs, _ in path for z in zs), 0]
        return sum(lm[a, b, c] for a, b, c in zip(symbols, symbols[1:], symbols[2:])) - sum(cost for *_, cost in path)

    for w in words:
        best = max(score(p) for p in paths(w))
        got = toxicity.restore(w, lm)
        assert np.isclose(best, max(score(p) for p in paths(w) if "".join(x for x, *_ in p) == got))
    # A disguised word of any length is decoded whole: the same word behind many signs, and one with more of them than are kept before they are settled.
    assert toxicity.restore("." * 70 + "m0r0n", lm) == "moron" and toxicity.restore("-".join("m0r0n"), lm) == "moron"
    long = "l0s3r-m0r0n." * 300
    assert toxicity.restore(long, lm) == toxicity.restore(long, lm.tolist())
    assert len(toxicity.restore("10" * 2_000, lm)) == 4_000


def test_disguises_open_a_lattice(spark):
    clean = toxicity.Deobfuscator(likely(spark))

    def restored(text):
        ((_, out, bounds),) = clean.letters(pa.array([text, "next"]))
        return out[: bounds[1]].tobytes().decode()

    for text, word in (("a mor0n", "moron"), ("i...d...i...o...t", "idiot"), ("i. d. i. o. t.", "idiot"), ("i - d - i - o - t", "idiot"), ("so l 0 s e r", "loser"), ("mor0", "moro"), ("é d i o", "édio")):
        assert word in restored(text).split(), text
    assert restored("the end!! of a text. A b") == " the end   of a text  a b "


def test_toxicity_query_and_its_held_out_rows(spark, tmp_path):
    rnd = random.Random(10)
    rows = []
    for i in range(400):
        words = [rnd.choice(["river", "stone", "house", "window", "garden", "bread"]) for _ in range(40)]
        if i % 3 == 0:
            words[5] = rnd.choice(["loser", "m0ron", "moron", "l0ser"])
        rows.append((i, " ".join(words), "clash"))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "stone", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, score string").write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    seen = []
    for flip in (False, True):  # labels of held-out rows change no score
        labels = [(i, int((i % 3 == 0) != (flip and held(i)))) for i in range(400)]
        spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        got = toxicity.op1_toxicity(spark, str(tmp_path)).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        seen.append(sorted((r.doc_id or -1, r.score) for r in got))
    assert seen[0] == seen[1]
    own = toxicity.score_toxicity(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert own.columns == ["doc_id", "text", "score", "score_"] and own.where("score not in ('clash', 'x')").count() == 0


def test_lattice_lm(spark, docs, none):
    got = lattice_lm.score_texts(docs, chunk_bytes=20_000).collect()
    rows = rows_of()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    count, texts = defaultdict(int), 0
    for r in rows:
        if not held(r[0]):
            texts += 1
            for w in (r[1] or "").encode().lower().split():
                count[w] += 1
    n, v = sum(count.values()) + texts, len(count) + 1
    want = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        base = sum(np.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w) + np.log10((texts + 0.1) / (n + 0.1 * (v + 1)))
        want.append((-1 if r[0] is None else r[0], held(r[0]), len(w) + 1, sum(x in count and count[x] > 0 for x in w) + 1, n, round(base, 5)))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == sorted(want)
    assert all(r.score < 0 and np.isfinite(r.score) for r in got)
    whole = lattice_lm.score_texts(docs).collect()  # however the texts lie in chunks
    key = lambda r: (-1 if r.doc_id is None else r.doc_id, r.n_tokens, round(r.score, 6))
    assert sorted(map(key, whole)) == sorted(map(key, got))
    assert lattice_lm.score_texts(none).count() == 0


def test_lattice_lm_of_a_chunk_with_very_many_words(spark):
    """More distinct words than two bytes number, in a text of its own chunk; repeated words among them."""
    words = [f"w{k:x}" for k in range(70_000)]
    rows = [(1, " ".join(words + words[-5:])), (2, "w0 w0 w111ff new")]
    got = {r.doc_id: r for r in lattice_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string"), chunk_bytes=1_000).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 10 == 0]
    count = Counter(w for i, t in rows if i not in held for w in t.split())
    texts = len(rows) - len(held)
    n, v = sum(count.values()) + texts, len(count) + 1
    for i, t in rows:
        base = sum(np.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t.split()) + np.log10((texts + 0.1) / (n + 0.1 * (v + 1)))
        assert np.isclose(got[i].base_score, base) and got[i].n_tokens == len(t.split()) + 1 and got[i].n_known == sum(count[w] > 0 for w in t.split()) + 1
    whole = {r.doc_id: r.score for r in lattice_lm.score_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(np.isclose(whole[i], got[i].score) for i in whole)


def segmentations(word, pieces):
    """Sum of the products of weights over all segmentations of a word; a character that is no piece is spelled in bytes."""
    total = np.zeros(len(word) + 1)
    total[0] = 1
    for e in range(1, len(word) + 1):
        for s in range(e):
            part = word[s:e]
            if s and part[0] == "▁":
                p = np.prod([pieces[b] for b in part.encode()]) if len(part) == 1 else 0
            elif part in pieces:
                p = pieces[part]
            else:
                p = np.prod([pieces[b] for b in part.encode()]) if len(part) == 1 else 0
            total[e] += total[s] * p
    return total[-1]


def vocabulary_weights(logp):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    names = [sp.id_to_piece(i) for i in range(259, sp.get_piece_size())]
    names = [p for p in names if "▁" not in p[1:] and not any("A" <= c <= "Z" for c in p)]
    return {**{b: np.exp(logp[b]) for b in range(256)}, **{p: np.exp(w) for p, w in zip(names, logp[256:], strict=True)}}


def test_scores_equal_the_sum_over_all_segmentations_of_whole_documents(spark):
    texts = ["There was a river", "the there  the", "日本 über x▁y ▁", "", None, "zzzzqq there"]
    d = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lattice_lm.score_texts(d).collect()}
    learn = [t for i, t in enumerate(texts) if zlib.crc32(str(i + 1).encode()) % 10]
    count = Counter(w for t in learn for w in (t or "").lower().split())
    words = spark.createDataFrame([(w.encode(), n) for w, n in count.items()], "word binary, c long")
    voc = lattice_lm.vocabulary("piece_bpe_32k.model")
    logp = lattice_lm.tempered(voc.start, lattice_lm.fit_temperature(words, "piece_bpe_32k.model"))
    assert np.isclose(np.exp(logp).sum(), 1)
    pieces, times = vocabulary_weights(logp), Counter(count.values())
    n, less = sum(count.values()) + len(learn), (times[1] + 1) / (times[1] + 2 * times[2] + 2)
    share = lambda w: (max(count[w] - less, 0) + (less * len(count) + 0.999) * segmentations("▁" + w, pieces)) / (n + 1)
    for i, t in enumerate(texts):
        assert np.isclose(got[i + 1], np.log10((len(learn) + 0.001) / (n + 1)) + sum(np.log10(share(w)) for w in (t or "").lower().split()))


def test_a_word_alone_in_windows_and_among_others_has_the_same_sum(monkeypatch):
    voc = lattice_lm.vocabulary("piece_bpe_32k.model")
    logps = np.stack([lattice_lm.tempered(voc.start, t) for t in (0.5, 1.0)])
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("theraines▁日ü"), 60)).encode() for _ in range(20)]
    want = [[np.log(segmentations("▁" + w.decode(), vocabulary_weights(p))) for w in words] for p in logps]
    assert np.allclose(lattice_lm.log_probabilities(words, voc, logps), want)
    for window in (1 << 15, 17, 20, 61):
        monkeypatch.setattr(lattice_lm, "WINDOW", max(window, voc.longest + 1))
        assert np.allclose([lattice_lm.log_probabilities([w], voc, logps)[:, 0] for w in words], np.transpose(want))
    monkeypatch.undo()
    long = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 100_000)).encode()
    assert np.isfinite(lattice_lm.log_probabilities([long], voc, logps)).all()


def test_the_vocabulary_scores_decide_how_new_words_are_spelt(spark, sf):
    """Scores dealt out at random cost much for the words of held-out texts that training texts lack, each with its own temperature."""
    docs = [(r.doc_id, (r.text or "").encode().lower().split()) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    count = Counter(w for i, t in docs if not held(i) for w in t)
    new = sorted({w for i, t in docs if held(i) for w in t} - set(count))
    voc = lattice_lm.vocabulary("piece_bpe_32k.model")
    words = spark.createDataFrame(list(count.items()), "word binary, c long")
    assert lattice_lm.TEMPERATURES[0] < lattice_lm.fit_temperature(words, "piece_bpe_32k.model") < lattice_lm.TEMPERATURES[-1]

    def best(start):
        return max(lattice_lm.log_probabilities(new, voc, np.stack([lattice_lm.tempered(start, t) for t in (0.25, *lattice_lm.TEMPERATURES)])).mean(1)) / np.log(10)

    assert best(voc.start) - best(np.random.default_rng(0).permutation(voc.start)) > 1
    assert best(voc.start) - best(np.zeros(voc.size)) > 1


def test_scores_of_a_vocabulary_become_weights():
    logs = np.log(np.array([0.5, 0.3, 0.2]))
    assert np.allclose(lattice_lm.start_weights(logs), [0.5, 0.3, 0.2])
    ranks = lattice_lm.start_weights(np.array([-0.0, -1, -30_000, -1e9]))
    assert (np.diff(ranks) < 0).all() and np.isclose(ranks[0] / ranks[2], 3_001)


def test_pipeline_stages_on_a_small_table(spark, sf):
    import corpus_pipeline as P

    d = spark.read.parquet(f"{sf}/documents.parquet")
    t = P.drop_toxic(spark, d, sf)
    want = {r.doc_id for r in toxicity.score_toxicity(d, spark.read.parquet(f"{sf}/labels.parquet")).where("score < 0.5").collect()}
    assert {r.doc_id for r in t.collect()} == want and t.columns == d.columns
    doubled = d.unionByName(d.limit(20))
    kept = P.drop_near_duplicates(spark, doubled, sf)
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and set(ids) == {r.doc_id for r in minhash.near_duplicates(d).where("kept").collect()}
    mixed = P.mix(spark, d, sf)
    copies = {r.doc_id: r.copies for r in mixing.copies_of(mixing.mix_sources(d)).collect() if r.copies}
    got = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == copies and mixed.columns == d.columns
    packed = P.pack(spark, d, sf)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


def copies_by_brute_force(rows):
    """{(doc_id, text): copies} of the mix of (doc_id, text, source), in whole documents."""
    size = lambda t: len((t or "").encode().split())
    by = defaultdict(list)
    for i, t, s in rows:
        key = f"{'' if i is None else i}|{'' if t is None else hashlib.md5(t.encode()).hexdigest()}"
        by[s].append((hashlib.md5(key.encode()).hexdigest(), i, size(t), t))
    names = sorted(by, key=lambda s: (s is None, s))
    total = {s: sum(r[2] for r in by[s]) for s in names}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, left, open_ = {}, sum(total.values()), set(names)
    while open_:  # share what is left by weight; who is above the cap gets the cap
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if 3 * total[s] <= level * weight[s]]
        for s in over or open_:
            target[s] = 3 * total[s] if over else level * weight[s]
        if not over:
            break
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    out = Counter()
    for s in names:
        budget = int(np.floor(target[s]))
        epochs, before = (budget // total[s] if total[s] else 0), 0
        for _, i, n, t in sorted(by[s], key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])):
            out[i, t] += epochs + (n > 0 and (budget - epochs * total[s] - before) * 2 >= n)
            before += n
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline as P

    rnd = random.Random(14)
    word = lambda: "".join(rnd.choice("aeiourstln") for _ in range(5))
    rows = []
    for i in range(240):
        words = [word() for _ in range(rnd.choice([3, 30, 60, 2_500 if i % 40 == 0 else 80]))]
        if i % 4 == 0:
            words.insert(2, rnd.choice(["moron", "m0ron", "loser"]))
        rows.append((i, " ".join(words), rnd.choice(["a", "b", "c", "d", None])))
    rows += [(300 + k, rows[k][1] + " tail", "a") for k in range(5, 60, 7)] + [(400 + k, rows[k][1], "b") for k in range(3, 40, 9)] + [rows[9], (9, rows[10][1] + " more", "c"), (500, None, "a"), (501, "", None)]
    docs = spark.createDataFrame([(*r, "en", 0) for r in rows], "doc_id long, text string, source string, lang string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(240)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    toxic = {(r.doc_id, r.text) for r in toxicity.score_toxicity(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), "found").where("found >= 0.5").collect()}
    assert len(toxic) > 30
    clean = [r for r in rows if (r[0], r[1]) not in toxic]
    sets = []
    for _, t, _ in clean:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    group = list(range(len(clean)))
    for _ in range(4):
        for a in range(len(clean)):
            for b in range(len(clean)):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    kept, texts = [], lambda k: (clean[k][0], hashlib.md5((clean[k][1] or "").encode()).hexdigest())
    for g in set(group):
        kept.append(clean[min((k for k in range(len(clean)) if group[k] == g), key=texts)])
    lib, want = library(), Counter()
    for (i, t), n in copies_by_brute_force(kept).items():
        ids = [*ids_of(lib, t), 0]
        for p, s in enumerate(range(0, len(ids), 2048)):
            want[i, p, s, len(ids[s : s + 2048]), crc(ids[s : s + 2048])] += n
    got = P.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +want
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    assert all([o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] and sum(n for _, n in x) <= 2048 for x in filled.values())


def test_queries_read_whole_tables(spark, docs, tmp_path):
    """Each opN_ query on a folder of odd tables gives what brute force, or its operator that is tested above, gives."""
    from lumenaudit.llm import registry

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    q = {int(k[2:].split("_")[0]): f for k, f in registry.queries().items()}
    run = lambda n, columns: Counter(tuple(r) for r in q[n](spark, str(tmp_path)).select(*columns).collect())
    lib, texts = library(), [(r[0], r[1] or "") for r in rows_of()]
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    assert run(2, ["doc_id", "n_bytes", "n_tokens", "over_limit"]) == Counter((i, len(t.encode()), n := len(sp.encode(t)), n > 4096) for i, t in texts)
    want = Counter()
    for i, t in texts:
        ids = [*ids_of(lib, t), 0]
        want.update((i, p, s, len(ids[s : s + 2048]), crc(ids[s : s + 2048])) for p, s in enumerate(range(0, len(ids), 2048)))
    assert run(4, ["doc_id", "piece", "start", "length", "ids_crc32"]) == want
    got = sorted(q[5](spark, str(tmp_path)).collect(), key=lambda r: r.start)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, len(ids := [*ids_of(lib, t), 2]), crc(ids)) for i, t in texts)
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))] and [r.doc_id or -1 for r in got] == sorted(i or -1 for i, _ in texts)
    columns = ["doc_id", "n_shingles", "component_id", "kept"]
    assert run(7, columns) == Counter(tuple(r) for r in minhash.near_duplicates(docs).select(*columns).collect())
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    assert run(9, columns) == Counter(tuple(r) for r in mixing.mix_sources(docs).select(*columns).collect())
    scores = sorted((r.doc_id or -1, r.held_out, r.n_tokens, round(r.score, 6)) for r in q[10](spark, str(tmp_path)).collect())
    assert scores == sorted((r.doc_id or -1, r.held_out, r.n_tokens, round(r.score, 6)) for r in lattice_lm.score_texts(docs).collect())


def test_queries_have_every_operator():
    from lumenaudit.llm import registry

    assert {int(k[2:].split("_")[0]) for k in registry.queries()} == set(range(1, 14))


ODD = "abcXYZ 0129 '\t\n<|>étẞßÀÿ×÷!.,;:ªº²½́  ẞ日本語😀​İŉǅ'sS'RE'll\x00\x1c\x1f\x85▁▁"


def odd_texts(alphabet):
    rnd = random.Random(11)
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) + rnd.choice(["", "", " <|endoftext|>x"]) for _ in range(1_500)]


@pytest.mark.parametrize("alphabet", ["abcXYZ 0129 '\t\néÀÿ!.,;:'sS'RE'll\x00\x1c\x1f", ODD])
def test_encoder_and_counter_equal_the_libraries(alphabet):
    import sentencepiece

    from lumenaudit.llm.tokens import encoder

    texts = odd_texts(alphabet)
    flat, sizes = encoder("word_bpe_49k.json").encode(pa.array(texts))
    lib, at = library(), 0
    for t, n in zip(texts, sizes.tolist(), strict=True):
        assert flat[at : at + n].tolist() == ids_of(lib, t)
        at += n
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    assert token_counts.counter("piece_bpe_32k.model").count(pa.array(texts)).tolist() == [len(sp.encode(t)) for t in texts]


def test_groups_that_span_batches_stay_whole():
    from lumenaudit.llm.units import whole_groups

    rnd = random.Random(4)
    keys = sorted(rnd.randrange(12) for _ in range(200))
    cuts = [0, 3, 3, 50, 51, 120, 200]
    batches = (pa.RecordBatch.from_pydict({"k": keys[a:b], "i": list(range(a, b))}, pa.schema([("k", pa.int64()), ("i", pa.int64())])) for a, b in zip(cuts, cuts[1:]))
    seen = []
    for rows, heads in whole_groups(batches, ["k"]):
        k = rows.column("k").to_pylist()
        for a, b in zip(heads.tolist(), [*heads.tolist()[1:], len(k)]):
            assert len(set(k[a:b])) == 1
            seen.append((k[a], b - a))
    assert seen == sorted((k, keys.count(k)) for k in set(keys))


def test_mix_keys_of_rows_without_an_id_differ(spark):
    rows = [(None, f"w{k} " * 5, "a") for k in range(300)] + [(7, f"v{k} " * 5, "a") for k in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    keys = d.select(mixing._random_key(F.col("doc_id"), F.col("text")).alias("k")).distinct().count()
    mixed = mixing.mix_sources(d)
    assert keys == 600 and mixed.agg(F.sum("taken")).first()[0] == 3000 and mixed.count() == 600


def test_pipeline_with_nulls_clashing_names_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as P

    rnd = random.Random(8)
    make = lambda: " ".join("".join(rnd.choice("aeioulnrst") for _ in range(6)) for _ in range(40))
    base = make()
    rows = [(None, make(), "a", "x") for _ in range(30)] + [(None, base, "a", "x")] * 3 + [(k, base, "b", "y") for k in (4, 9)] + [(k, make(), None, None) for k in range(20, 60)] + [(70, None, "a", "x"), (71, "", "a", "x")]
    clash = ["text_md5", "dealt_by", "named", "mix_size", "mix_cut", "toxicity", "first", "size", "key"]
    schema = "doc_id long, text string, source string, lang string, " + ", ".join(f"{c} string" for c in clash)
    docs = spark.createDataFrame([(*r, *["clash"] * len(clash)) for r in rows], schema)
    for name, df in (("some", docs), ("none", docs.limit(0))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels = [(k, int(k % 3 == 0)) for k in range(20, 60)] if name == "some" else []
        spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    kept = P.drop_near_duplicates(spark, spark.read.parquet(f"{tmp_path}/some/documents.parquet"), f"{tmp_path}/some")
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter({None: 33, 4: 1, 70: 1, 71: 1, **{k: 1 for k in range(20, 60)}})
    assert P.run(spark, f"{tmp_path}/some").count() > 0
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(f"{tmp_path}/none/documents.parquet"), f"{tmp_path}/none").columns == docs.columns
    assert P.run(spark, f"{tmp_path}/none").count() == 0


def test_token_orc_stripes_are_read_in_parallel_and_skipped(spark):
    """A file has several stripes; tasks take them apart, and a range of doc_id reads those alone that hold it."""
    n = 8_000
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40)), lambda i: F.substring(F.sha1(F.concat_ws("-", "id", i)), 1, 4)), " ")
    path = scratch_path(spark, "test-orc-stripes")
    token_orc.write_token_orc(spark.range(n).select(F.col("id").alias("doc_id"), words.alias("text")), path, shard_rows=n, stripe_bytes=1 << 18)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    (file,) = [f for f in glob.glob(f"{path}/part-*") if os.path.getsize(f)]
    stripes = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(file), jvm.org.apache.orc.OrcFile.readerOptions(conf)).getStripes()
    assert stripes.size() >= 4 and sum(stripes.get(i).getNumberOfRows() for i in range(stripes.size())) == n
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(os.path.getsize(file) // 6))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        parts = token_orc.read_token_orc(spark, path).select("row", F.spark_partition_id().alias("part")).groupBy("part").agg(F.min("row").alias("lo"), F.max("row").alias("hi"), F.count("row").alias("n")).orderBy("lo").collect()
        assert len(parts) >= 4 and sum(r.n for r in parts) == n and all(r.hi - r.lo + 1 == r.n for r in parts)
        some = token_orc.read_token_orc(spark, path, lo=n - 500)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        plan = some._jdf.queryExecution().executedPlan()
        plan.executeCollect()
        assert 500 <= plan.collectLeaves().head().metrics().apply("numOutputRows").value() <= 2_000
        digests = sorted(tuple(r) for r in token_orc.token_digests(token_orc.read_token_orc(spark, path)).select("doc_id", "start", "n_tokens").collect())
        assert [d[0] for d in digests] == list(range(n)) and all(a[1] + a[2] == b[1] for a, b in zip(digests, digests[1:]))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_token_orc_shards_follow_bytes():
    assert [token_orc.n_shards_for(b) for b in (0, 1, 32 << 20, (32 << 20) + 1, 1 << 40, 8 << 40, 100 << 40)] == [1, 1, 1, 2, 1 << 15, 1 << 15, 100 << 10]
