"""Results against brute force, exact round trips and held-out accuracy."""

import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from stratocast.llm import arrays, crf, html, mixing, ngram, packing, rans, rules, simhash, topk, toxicity
from stratocast.llm.common import materialize
from stratocast.llm.queries import BYTE_BPE, QUERIES, WORD_BPE, _tokenizer
from stratocast.llm.tokens import Encoder

MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_top_k_equals_all_products(spark):
    rows = spark.read.parquet(f"{MID}/embeddings.parquet").orderBy("vec_id").collect()
    m = np.floor(np.array([r.embedding for r in rows], dtype=np.float64) * 64)
    ids = np.array([r.vec_id for r in rows])
    got = defaultdict(list)
    for r in sorted(QUERIES["op1_exact_topk"](spark, MID).collect(), key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.vec_id, r.score))
    for i in np.flatnonzero(ids % 20 == 0):
        s = m @ m[i]
        want = [(ids[j], int(s[j])) for j in np.lexsort((ids, -s)) if j != i][:20]
        assert got[ids[i]] == want


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_all_pairs(spark, texts):
    ids = sorted(texts)
    fp = np.array([brute_fingerprint(texts[i]) for i in ids], dtype=np.uint64)
    links = [(a, a + 1 + b) for a in range(len(ids)) for b in np.flatnonzero(np.bitwise_count(fp[a + 1 :] ^ fp[a]) <= 3)]
    want = {i: (f"{int(f):016x}", ids[r]) for i, f, r in zip(ids, fp, roots(len(ids), links), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op2_simhash"](spark, MID).collect()} == want


def test_crowded_buckets_lose_no_link(spark):
    rng = np.random.default_rng(1)
    flips = lambda top: np.uint64(1) << rng.integers(0, top, 1500).astype(np.uint64)
    fp = np.unique(np.r_[np.uint64(12345) ^ flips(64) ^ flips(64) ^ flips(64) ^ flips(20), rng.integers(0, 2**63, 500, dtype=np.uint64)])
    df = spark.createDataFrame([(int(v),) for v in fp.view(np.int64)], "fp long")
    got = defaultdict(set)
    for r in simhash.connected(simhash.hamming_links(df, group_rows=100)).collect():
        got[r.root].add(r.node)
    want = defaultdict(set)
    for i, r in enumerate(roots(len(fp), [(a, a + 1 + b) for a in range(len(fp)) for b in np.flatnonzero(np.bitwise_count(fp[a + 1 :] ^ fp[a]) <= 3)])):
        want[r].add(int(fp.view(np.int64)[i]))
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in want.values() if len(g) > 1}


def test_components_end_once_all_links_are_stars(spark, monkeypatch):
    """Stars need no round, and a chain and a crowded hub no more than they change in."""
    written = []
    monkeypatch.setattr(simhash, "materialize", lambda df, label: written.append(label) or materialize(df, label))
    links = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    stars = [(1, i) for i in range(2, 400)] + [(-7, 500), (-7, -7)]
    got = {r.node: r.root for r in simhash.connected(links(stars)).collect()}
    assert got == {x: min(pair) for pair in stars for x in pair} and "star" not in written
    chain = [(i, i + 1) for i in range(600, 640)] + [(i, 900) for i in range(640, 900)]
    assert {r.node: r.root for r in simhash.connected(links(chain)).collect()} == dict.fromkeys(range(600, 901), 600)
    assert simhash.connected(links([(3, 3)])).count() == 0


def test_rule_counts(spark, texts):
    for r in QUERIES["op3_quality_rules"](spark, MID).collect():
        text = texts[r.doc_id]
        words = text.encode().split()
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        times = Counter(windows)
        covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert r.n_words == len(words) and r.n_repeat_words == len(covered)
        assert r.word_chars == sum(len(w.decode()) for w in words)
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(words) < 50 or 2 * len(covered) > len(words)) and not (r.kept and r.base_failed)


def test_trees_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.random((600, 3))
    y = (x[:, 0] + 0.3 * rng.random(600) < 0.7).astype(int)
    model = rules.boost(x, y, [-1, 1, 0], trees=20)
    for f, sign in ((0, -1), (1, 1)):
        steps = np.tile(x[:50], (40, 1, 1))
        steps[:, :, f] = np.linspace(0, 1, 40)[:, None]
        p = np.stack([model.margin(s) for s in steps])
        assert (sign * np.diff(p, axis=0) >= -1e-12).all()
    assert ((model.probability(x) > 0.5) == y).mean() > 0.85


def slow_probability(model, x):
    total = model.base
    for root in model.roots:
        at = root
        while model.feature[at] >= 0:
            at = model.left[at] if x[model.feature[at]] <= model.threshold[at] else model.right[at]
        total += model.value[at]
    return 1 / (1 + math.exp(-total))


def test_verdicts_equal_a_walk_down_each_tree(spark, texts):
    docs, labels = (spark.read.parquet(f"{MID}/{t}.parquet") for t in ("documents", "labels"))
    model = rules.fit_rules(docs, labels)
    for r in rules.apply_rules(docs, model).collect():
        p = slow_probability(model, rules.features_of(np.array([rules.counts_of(texts[r.doc_id].encode())]))[0])
        assert r.score == pytest.approx(p) and r.kept == (not r.base_failed and p >= 0.5)
    for r in rules.keep_good(docs, model).select("doc_id", "text").limit(50).collect():
        assert slow_probability(model, rules.features_of(np.array([rules.counts_of(r.text.encode())]))[0]) >= 0.5


def test_rules_keep_held_out_good_documents(spark):
    """Over rows that the base rules do not fail, which the labels need not follow."""
    sf = "/root/testdata/sf0.1"
    rows = QUERIES["op3_quality_rules"](spark, sf).where("not base_failed and crc32(cast(cast(doc_id as string) as binary)) % 5 = 0")
    rows = rows.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("quality is not null").collect()
    assert len(rows) > 100 and sum(r.kept == (r.quality == 1) for r in rows) / len(rows) > 0.9


@pytest.mark.parametrize("name,label,floor", [("op6_quality_classifier", "quality", 0.95), ("op9_toxicity", "toxic", 0.9)])
def test_held_out_accuracy(spark, name, label, floor):
    scored = QUERIES[name](spark, "/root/testdata/sf0.1")
    rows = scored.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    for y in (0, 1):
        own = [r for r in rows if r[label] == y]
        assert sum(r.predicted == y for r in own) / len(own) > floor


def test_pu_steps_follow_the_risk():
    """The risk by its definition, row by row, and its derivative by differences; below zero the negative part's, reversed."""
    rng = np.random.default_rng(0)
    for shift, prior in ((0.0, 0.3), (-6.0, 0.9)):
        z = rng.normal(size=12)
        is_pos = np.arange(12) < 5
        z[~is_pos] += shift
        loss = lambda x: 1 / (1 + math.exp(x))

        def parts(z):
            plus = prior * sum(loss(x) for x in z[is_pos]) / 5
            minus = sum(loss(-x) for x in z[~is_pos]) / 7 - prior * sum(loss(-x) for x in z[is_pos]) / 5
            return plus, minus

        assert toxicity.pu_risk(z, is_pos, prior) == pytest.approx(parts(z))
        aim = (lambda z: sum(parts(z))) if parts(z)[1] >= 0 else (lambda z: -parts(z)[1])
        slopes = toxicity.pu_slopes(z, is_pos, prior)
        for i in range(12):
            step = np.eye(12)[i] * 1e-6
            assert slopes[i] == pytest.approx((aim(z + step) - aim(z - step)) / 2e-6, abs=1e-6)
    assert parts(z)[1] < 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    lengths, unary, move = np.array([3, 1, 4]), rng.normal(size=8), rng.normal(size=(2, 2))
    good, _, _ = crf.Chains(lengths).marginals(unary, move)
    at = 0
    for n in lengths:
        w = {k: math.exp(sum(unary[at + i] * k[i] for i in range(n)) + sum(move[k[i], k[i + 1]] for i in range(n - 1))) for k in itertools.product((0, 1), repeat=int(n))}
        for i in range(n):
            assert good[at + i] == pytest.approx(sum(x for k, x in w.items() if k[i]) / sum(w.values()))
        at += n


ODD = [
    "a", "The", "don't", "'s", "'", "word", "\u00e9", "\u00c9", "\u0130", "\u0130stanbul", "\u0301", "e\u0301", "\u00a0", "\u2003", "\u3000", "\x85", "\x1c", "\x0b", "\t", "\n", "\n\n", " ", "  ",
    "   ", "\r\n", "***", ".", ",", "...", "$$$", "1", "23", "\u00b2", "\u00bd", "\u00aa", "\u00df", "\u01c5", "\u4e2d\u6587", "\ud55c", "\u0391\u03a3", "\U0001f600", "<|endoftext|>", "<|startoftext|>", "<|", "|>",
    "_", "-", "\u2014", "\u00ab", "\u200b", "\u00ad", "\x00", "\x7f", "\u00b5", "\u017f", "\u212a",
]


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_encoder_equals_library(name, texts):
    """Random strings of odd parts, with a memory so small that it turns over, and whole documents."""
    own, library = Encoder(_tokenizer(name), most=100), Tokenizer.from_file(_tokenizer(name))
    rng = random.Random(5)
    made = ["".join(rng.choice(ODD) for _ in range(rng.randrange(9))) for _ in range(6000)]
    for some in (*np.array_split(np.array(made, dtype=object), 12), ["", "\u0130stanbul", " a", "a "], list(texts.values())[:100], [], [None, ""]):
        ids, counts = own.batch(pa.array(list(some), pa.string()))
        want = [e.ids for e in library.encode_batch([t or "" for t in some], add_special_tokens=False)]
        assert list(counts) == [len(w) for w in want] and list(ids) == [i for w in want for i in w]


def test_packing_covers_each_id_once(spark, texts):
    library = Tokenizer.from_file(_tokenizer(BYTE_BPE))
    rows = QUERIES["op4_packing"](spark, MID).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in list(texts.items())[::7]:
        ids, at = [*library.encode(text, add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)
    for placed in sequences.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at and length > 0
            at += length
        assert at <= 2048 and at & (at - 1) == 0
    assert len(pieces) == len(texts)


def test_token_files_round_trip(spark, texts):
    library = Tokenizer.from_file(_tokenizer(WORD_BPE))
    rows, at = {r.doc_id: r for r in QUERIES["op8_token_files"](spark, MID).collect()}, 0
    for doc_id in sorted(texts):
        ids = [*library.encode(texts[doc_id], add_special_tokens=False).ids, 1]
        assert (rows[doc_id].start, rows[doc_id].n_tokens, rows[doc_id].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_blocks_decode_from_checkpoints_and_fail_when_changed():
    rng = np.random.default_rng(0)
    ids = rng.integers(0, 500, 5000).astype(np.uint16)
    table = rans.Table.from_counts(np.bincount(ids, minlength=1 << 16))
    payload = rans.encode_block(table, ids, [1, None], np.array([2000, 3000]), lanes=16, every=50)
    head = rans.read_head(payload, table)
    parts = [rans.decode_block(table, head, m, m + 1 if m + 1 < len(head["marks"]) else None) for m in range(len(head["marks"]))]
    assert len(parts) > 3 and (np.concatenate(parts) == ids).all() and head["doc_ids"] == [1, None]
    broken = bytearray(payload)
    broken[len(payload) // 2] ^= 1
    with pytest.raises(ValueError):
        rans.read_head(bytes(broken), table)


def test_pages_give_their_articles(spark):
    docs = {"\n".join(x for x in (" ".join(y.split()) for y in r.text.split("\n")) if x) for r in spark.read.parquet(f"{MID}/documents.parquet").collect()}
    rows = QUERIES["op5_html_text"](spark, MID).collect()
    assert len(rows) == 250 and all(r.n_chars == len(r.text) for r in rows)
    assert sum(r.text.split("\n", 1)[-1] in docs for r in rows) >= 0.95 * len(rows)


def test_templates_go_and_copies_stay(spark):
    rows = [(i, f"http://h.example/{i}", f"<body><div><p>Site slogan</p></div><p>Text {i * i}</p></body>") for i in range(40)]
    rows += [(100 + i, "http://h.example/c", "<p>A copied article</p>") for i in range(30)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Text 9" and got[105] == "A copied article"


def test_furniture_without_tell_tale_names_goes_by_recurrence_alone(spark):
    """No element or name marks the furniture, with and without an article; hosts are spread over several salts."""
    top, foot = "<div><div class='x1'><span>Home of tales</span></div><p>Read us daily</p></div>", "<div><p>All rights kept</p></div>"
    rows = [(i, "http://plain.example/", f"<body>{top}<div><p>Tale {i * i}</p><p>It ends {i * 7}</p></div>{foot}</body>") for i in range(60)]
    rows += [(100 + i, "http://marked.example/", f"<body><article><p>Tale {i * i}</p><p>It ends {i * 7}</p><p>And more of {i}</p><p>Written by the desk</p></article></body>") for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages, pages_a_task=7).collect()}
    assert all(got[i] == f"Tale {i * i}\nIt ends {i * 7}" for i in range(60))
    assert all(got[100 + i] == f"Tale {i * i}\nIt ends {i * 7}\nAnd more of {i}" for i in range(60))
    for i, _, page in rows:  # what the page gives without its host's templates
        assert "Read us daily" in html.main_text(html.parse(page)) or "Written by the desk" in html.main_text(html.parse(page))


def test_copies_and_large_hosts_hide_no_template(spark):
    slogan, menu = "<div><p>Site slogan</p></div>", "<div><p>Section menu</p></div>"
    rows = [(i, "http://copies.example/", f"<body>{slogan}<p>Text {i * i}</p></body>") for i in range(20)]
    rows += [(100 + i, "http://copies.example/", f"<!-- {i} --><body>{slogan}<p>Copied</p></body>") for i in range(300)]
    rows += [(1000 + i, "http://large.example/", f"<body>{menu if i % 10 == 0 else ''}<p>Text {i * i}</p></body>") for i in range(1500)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Text 9" and got[150] == "Copied" and got[1010] == "Text 100"


def test_recurring_lines_in_articles_go_by_place(spark):
    def page(i):
        body = [f"<p>Paragraph {i} {j} of this article</p>" for j in range(6)]
        body.insert(i % 6 + 1 if i % 6 < 5 else 0, "<p>A shared sentence</p>")
        return f"<article>{''.join(body[: 3 + i % 5])}<p>Shared</p>{''.join(body[3 + i % 5 :])}<p>Subscribe now</p></article>"

    rows = [(i, "http://h.example/", page(i)) for i in range(40)]
    rows += [(100 + i, "http://n.example/", f"<article>{''.join(f'<p>Line {j} of a long copied story</p>' for j in range(6))}<p>{i}</p></article>") for i in range(40)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Subscribe" not in got[i] and "A shared sentence" in got[i] and "Shared" in got[i] and "of this article" in got[i] for i in range(40))
    assert all("Line 5 of" in got[100 + i] for i in range(40))


@pytest.mark.parametrize(
    "page",
    [
        "<div class='with-sidebar'><article><p>Real text</p></article></div>",
        "<div id='content-sidebar-wrap'><main><p>Real text</p></main></div><div class='sidebar'>Other</div>",
        "<article><div class='entry-header'><h1>Real text</h1></div></article>",
        "<article><section id='related-work'>Real text</section></article><nav>Menu</nav>",
        "<aside><article>Real text</article></aside>",
        "<div class='page-with-sidebar'><p>Real text</p></div>",
    ],
)
def test_names_alone_drop_no_article_text(page):
    assert html.main_text(html.parse(f"<body>{page}</body>")) == "Real text"


def test_mix_meets_targets(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    again = [sorted(map(tuple, mixing.mix(docs.repartition(n)).collect())) for n in (2, 5)]
    assert again[0] == again[1]
    source = {r.doc_id: r.source for r in docs.collect()}
    taken, target = Counter(), {}
    for doc_id, size, _, goal, words in again[0]:
        assert words in (0, size, 2 * size)
        taken[source[doc_id]] += words
        target[source[doc_id]] = goal
    assert all(abs(taken[s] - target[s]) <= 0.03 * target[s] for s in target)


def test_a_long_document_at_the_cut_leaves_no_gap(spark):
    """Repeated rows go together; whatever the order, each document not taken is longer than the words left open."""
    rows = [(i, "w " * (20 + i % 5)) for i in range(1000)] + [(i, "w " * 40) for i in range(1000, 1200) for _ in range(2)]
    rows += [(i, "w " * 20_000) for i in range(2000, 2003)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("a")).withColumn("lang", F.lit("en"))
    for seed in range(1, 7):
        out = mixing.mix(docs, share=0.5, seed=seed).collect()
        left = out[0].target - sum(r.taken for r in out)
        times = Counter(r.doc_id for r in out)
        assert left >= 0 and all(r.size * times[r.doc_id] > left for r in out if not r.taken)


def test_overlapping_sources_share_capacity():
    flow = mixing.min_cost_flow([100, 50, 30], [[0], [0, 1], [1]], [150, 90], 2)
    assert sum(sum(f.get(0, [0])) for f in flow) == 150 and sum(sum(f.get(1, [0])) for f in flow) == 90
    assert all(sum(sum(u) for u in f.values()) <= 2 * c for f, c in zip(flow, [100, 50, 30], strict=True))
    assert mixing.capped_shares([100, 10, 50], [3, 1, 2], 240, 2) == pytest.approx([132, 20, 88])


def test_flow_costs_what_the_best_enumerated_one_does():
    """All ways to send whole words from two patterns (one in both sources) to two sources, up to two uses each."""
    rng = random.Random(1)
    for _ in range(20):
        capacity, members, most = [rng.randint(1, 4), rng.randint(1, 4)], [[0], [0, 1]], 2
        quota = [rng.randint(0, 6), rng.randint(0, 6)]
        cost = lambda words, size: min(words, size) + 3 * max(words - size, 0)
        best = (-1, 0)
        for a in range(most * capacity[0] + 1):
            for b in range(most * capacity[1] + 1):
                for c in range(most * capacity[1] - b + 1):
                    if a + b <= quota[0] and c <= quota[1]:
                        best = max(best, (a + b + c, -cost(a, capacity[0]) - cost(b + c, capacity[1])))
        flow = mixing.min_cost_flow(capacity, members, quota, most)
        sent = [sum(sum(u) for u in f.values()) for f in flow]
        assert (sum(sent), -sum(cost(w, n) for w, n in zip(sent, capacity, strict=True))) == best
        assert all(sum(sum(f.get(s, [0])) for f in flow) <= quota[s] for s in (0, 1))


def test_packing_leaves_little_over(spark, texts):
    """No padding: but for each task's end, which is cut at powers of two, all sequences are full."""
    rows = QUERIES["op4_packing"](spark, MID).collect()
    filled = Counter()
    for r in rows:
        filled[r.sequence_id] += r.length
    short = [n for n in filled.values() if n < 2048]
    tasks = len({s >> 40 for s in filled})
    assert all(n & (n - 1) == 0 for n in filled.values()) and len(short) <= 11 * tasks
    assert sum(filled.values()) == sum({r.doc_id: r.doc_tokens for r in rows}.values())


def test_repeat_counts_come_near_the_least_squares():
    """The rounded counts use no piece twice, and leave hardly more than the unbounded least-squares fit does."""
    rng = np.random.default_rng(0)
    histogram = np.bincount(rng.integers(1, 64, 3000), minlength=65)
    pattern, length, times = packing.combinations(histogram, 64)
    counts = packing.repeat_counts(histogram, pattern, length, times)
    used = np.bincount(length, weights=times * counts[pattern], minlength=65)
    assert (used <= histogram).all() and used.sum() > 0.8 * histogram.sum()


@pytest.mark.parametrize("sizes", [{}, {"shard_bytes": 100_000, "chunk_bytes": 200_000, "fan": 4}])
def test_kneser_ney_equals_dictionaries(spark, texts, sizes):
    """Order 3 against plain dictionaries; the second run deals packets over several levels."""
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    model = ngram.train(docs, **sizes)
    words = {i: [*t.encode().lower().split(), None] for i, t in texts.items()}
    count, triple = Counter(), Counter()
    for i, w in words.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            count.update(w)
            triple.update(zip(["start", "start", *w], ["start", *w], w, strict=False))
    pair = Counter((v, w) for _, v, w in triple)
    single = Counter(w for _, w in pair)
    n, vocabulary = sum(count.values()), len(count)

    def level(counts):
        m = [0, *(sum(x == k for x in counts.values()) for k in (1, 2, 3, 4))]
        y = m[1] / (m[1] + 2 * m[2])
        cut = [0, *(k - (k + 1) * y * m[k + 1] / m[k] for k in (1, 2, 3))]
        stats = defaultdict(lambda: [0, 0, 0, 0])
        for gram, k in counts.items():
            context = gram[:-1] if isinstance(gram, tuple) else ()
            stats[context][0] += k
            stats[context][min(k, 3)] += 1
        return counts, cut, stats

    tables = [level(single), level(pair), level(triple)]

    def p(gram):
        counts, cut, stats = tables[len(gram) - 1]
        lower = p(gram[1:]) if len(gram) > 1 else 1 / (vocabulary + 1)
        if gram[:-1] not in stats:
            return lower
        c, k = stats[gram[:-1]], counts[gram if len(gram) > 1 else gram[0]]
        return max(k - cut[min(k, 3)], 0) / c[0] + sum(cut[j] * c[j] for j in (1, 2, 3)) / c[0] * lower

    assert sum(p(("the", "of", w)) for w in count) + p(("the", "of", "no such word")) == pytest.approx(1)
    for r in ngram.score(docs, model).collect():
        w = words[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (vocabulary + 1))) for x in w))
        assert r.score == pytest.approx(sum(math.log10(p(g)) for g in zip(["start", "start", *w], ["start", *w], w, strict=False)))


def test_packets_come_back_and_are_small():
    """Words by Zipf's law: under 3 bytes a triple, which needs codes by frequency (codes in the order of hashes, as whole numbers: 4.1)."""
    rng = np.random.default_rng(3)
    words = rng.integers(0, 2**64, 60_000, dtype=np.uint64, endpoint=False)
    picked = np.minimum(rng.zipf(1.25, 300_000), 70_000) - 1
    u, v, w = (np.where(i < 60_000, words[np.minimum(i, 59_999)], i.astype(np.uint64)) for i in (picked[:-2], picked[1:-1], picked[2:]))
    key, first, times = arrays.summed(arrays.mixed(u, v, w), np.ones(len(u), np.int64))
    u, v, w = u[first], v[first], w[first]
    code = ngram.Packets(words)
    packet = code.pack(u, v, w, times)
    a, b, c, n = code.unpack(packet)
    back, at, n = arrays.summed(arrays.mixed(a, b, c), n)
    assert (back == key).all() and (n == times).all() and (b[at] == v).all()
    assert len(packet) < 3 * len(key)
    for some in (words[:5], words[:0], np.r_[words[7:3:-1], np.uint64(9)]):
        count = np.arange(1, len(some) + 1)
        for x in (code, ngram.Packets(words[:0])):
            got = zip(*x.unpack_words(x.pack_words(some, count, count + 1)), strict=True)
            assert sorted(got) == sorted(zip(some, count, count + 1, strict=True))


def test_word_hashes_tell_words_apart():
    long = b"x" * 100
    some = [b" The  the\tTHE ", None, b"", b"ab ba a\x00 a", long + b" " + long + b"y " + long, b"\xc3\x89 \xc3\xa9"]
    hashes, counts = ngram.word_hashes(pa.array(some, pa.binary()))
    assert list(counts) == [4, 1, 1, 5, 4, 3]
    words = [w for t in some for w in [*(t or b"").lower().split(), None]]
    assert len(set(hashes.tolist())) == len(set(words)) and len({(h, w) for h, w in zip(hashes.tolist(), words, strict=True)}) == len(set(words))


def test_hash_arrays_give_back_their_counts(tmp_path):
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    values = np.stack([rng.integers(0, 3, len(keys)), rng.zipf(1.3, len(keys)) % 10**12], axis=1)
    arrays.save(f"{tmp_path}/a", arrays.build(keys, values) + arrays.build(keys[:0], values[:0]))
    loaded = arrays.mapped(f"{tmp_path}/a")
    absent = np.setdiff1d(rng.integers(0, 2**64, 5000, dtype=np.uint64), keys)
    got, hit = arrays.look_up(loaded[:7], np.r_[keys, absent])
    assert (got[: len(keys)] == values).all() and hit[: len(keys)].all() and not hit[len(keys) :].any()
    assert not arrays.look_up(loaded[7:], keys)[1].any()


def test_pipeline_equals_its_stages_by_hand(spark, small):
    """Each stage's verdicts, taken from the queries' operators over what is left, rebuilt row by row."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    schema = spark.read.parquet(f"{small}/documents.parquet").schema
    labels = spark.read.parquet(f"{small}/labels.parquet")
    table = lambda: spark.createDataFrame(list(docs.values()), schema)
    tox = toxicity.fit_toxicity(table(), labels)
    docs = {i: r for i, r in docs.items() if tox.scores([r.text.encode()])[0] < 0.5}
    trees = rules.fit_rules(table(), labels)
    docs = {i: r for i, r in docs.items() if rules._verdicts(trees, np.array([rules.counts_of(r.text.encode())]), 0.5)[2][0]}
    ids = sorted(docs)
    fp = np.array([brute_fingerprint(docs[i].text) for i in ids], dtype=np.uint64)
    links = [(a, b) for a in range(len(ids)) for b in range(a + 1, len(ids)) if np.bitwise_count(fp[a] ^ fp[b]) <= 3]
    docs = {i: docs[i] for i, r in zip(ids, roots(len(ids), links), strict=True) if ids[r] == i}
    want = Counter({r.doc_id: r.taken // r.size for r in mixing.mix(table()).collect() if r.taken})
    got = Counter(r.doc_id for r in corpus_pipeline.run(spark, small).collect() if r.start == 0)
    assert got == want


def test_bare_vertical_search_equals_products():
    rng = np.random.default_rng(3)
    c, q = rng.integers(-9, 9, (700, 13)).astype(float), rng.integers(-9, 9, (9, 13)).astype(float)
    ids = np.arange(700)
    qi, found, s = topk.branch_and_bound(ids, c, ids[:9], q, k=5, dim_block=3)
    for i in range(9):
        want = [(j, (c @ q[i])[j]) for j in np.lexsort((ids, -(c @ q[i]))) if j != i][:5]
        assert sorted(zip(found[qi == i], s[qi == i], strict=True)) == sorted(want)
