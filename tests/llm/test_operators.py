"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import bpe, chat, graph, html_text, jaccard, langid, line_dedup, mixing, quality, queries, sharding, topk

WS = " \t\n\x0b\x0c\r"
LONG = "word " * 40_000 + "end"
ODD = [None, "", " \t\n", "one", "one", "Ünï çødé \x85  x", "a" * 9000, LONG, "#*$ |<>\n#*$ |<>\n\n", "x\n" * 300]


def frame(spark, texts, start=0):
    """Rows (doc_id, text) with columns whose names clash with those that operators make."""
    rows = [(start + i if i != 3 else None, t, "en", "src", i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_lines long")


def words(text):
    out, now = [], ""
    for c in (text or "") + " ":
        if c in WS:
            out += [now] if now else []
            now = ""
        else:
            now += c
    return out


# Quality rules


def brute_quality(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    repeat = len(inside)
    failed = len(w) < 20 or 100 * repeat > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), repeat, failed


def test_quality_is_brute_force(spark):
    rng = random.Random(2)
    made = [" ".join(rng.choice(["a", "b", "c", "ab", "é"]) + ("\n" if rng.random() < 0.1 else "") for _ in range(rng.randint(0, 120))) for _ in range(60)]
    texts = [*ODD, *made, made[5] + "\n" + made[5]]
    got = quality.repetition_quality(frame(spark, texts)).collect()
    want = Counter(brute_quality(t) for t in texts)
    assert Counter((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and r.base_failed for r in got)
    assert quality.repetition_quality(frame(spark, texts).limit(0)).count() == 0


def test_quality_verdict():
    junk, clean = " ".join(w for w in ("thing", "other", "more", "last") for _ in range(7)), " ".join(f"w{i}" for i in range(200))
    got = quality.measure([junk, clean, clean + " " + " ".join(f"w{i}" for i in range(30))], quality.QualityRules())
    assert got["kept"].tolist() == [False, True, True]


# Sharding


def check_shards(rows, texts, shards):
    counts = Counter(r.shard for r in rows)
    assert max(counts[s] for s in range(shards)) - min(counts[s] for s in range(shards)) <= 1
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(counts[s]))
    assert Counter((r["size"], r.text_crc32) for r in rows) == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)


def test_sharding_law_and_groups(spark):
    texts = [*ODD, *[f"t{i}" for i in range(90)], *["copy"] * 7, *[None] * 3]
    rows = sharding.shard_documents(frame(spark, texts), 4).collect()
    check_shards(rows, texts, 4)
    assert len({r.shard for r in rows if r.text_crc32 == zlib.crc32(b"copy")}) == 1
    assert {r.law for r in rows} == {"rows"} and {r.grown_shard for r in rows} == {None}


def test_sharding_keeps_large_groups_whole(spark):
    sizes = {"a": 130, "b": 50, "c": 48, "d": 47, "e": 30, "f": 12}  # shards of 50 rows
    texts = [k for k, n in sizes.items() for _ in range(n)] + [f"single {i}" for i in range(83)]
    rows = sharding.shard_documents(frame(spark, texts), 8).collect()
    check_shards(rows, texts, 8)
    spans = {k: len({r.shard for r in rows if r.text_crc32 == zlib.crc32(k.encode())}) for k in sizes}
    assert spans == {"a": 3, "b": 1, "c": 1, "d": 1, "e": 1, "f": 1}


def test_sharding_cuts_few_links(spark, monkeypatch):
    """Links that end in two shards, by counting pairs of equal texts: groups up to a shard stay whole, stars of small ones too."""
    monkeypatch.setattr(sharding, "BUCKET", 8)  # groups become several stars
    rng = random.Random(1)
    texts = [f"g{k}" for k, n in enumerate([3, 5, 9, 17, 30, 41] * 4) for _ in range(n)] + [f"single {i}" for i in range(580)]
    rng.shuffle(texts)
    rows = sharding.shard_documents(frame(spark, texts), 8).collect()
    check_shards(rows, texts, 8)
    groups = {}
    for r in rows:
        groups.setdefault(r.text_crc32, []).append(r.shard)
    pairs = sum(len(x) * (len(x) - 1) // 2 for x in groups.values())
    cut = sum(a != b for x in groups.values() for i, a in enumerate(x) for b in x[:i])
    assert cut <= 0.05 * pairs, (cut, pairs)  # at random seven eighths would be cut


@pytest.mark.parametrize("texts", [[], ["a"], ["a"] * 50, ["a"] * 60 + [str(i) for i in range(60)]])
def test_sharding_extremes(spark, texts):
    check_shards(sharding.shard_documents(frame(spark, texts), 8).collect(), texts, 8)


def test_sharding_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET", 5)
    texts = ["a"] * 60 + ["b"] * 4 + [str(i) for i in range(60)]
    check_shards(sharding.shard_documents(frame(spark, texts), 8).collect(), texts, 8)


def test_quotas_hold():
    held, limits = [10, 10, 4], [10, 10, 12]
    flows = sharding.quotas({(0, 2): 6, (1, 2): 6, (2, 0): 4}, held, limits)
    after = [h - sum(n for (a, _), n in flows.items() if a == s) + sum(n for (_, b), n in flows.items() if b == s) for s, h in enumerate(held)]
    assert all(a <= limit for a, limit in zip(after, limits)) and sum(flows.values()) > 8


# Chat formatting


def test_chat_reads_back(spark):
    tricky = r"\### Assistant: </turn> ok"
    rows = [(1, 0, "user", tricky), (1, 1, "assistant", tricky), (2, 0, None, None), (2, 1, "tool <turn>", "\\\\n ### Text: </turn>"), (2, 2, "assistant", ""), (None, 0, "assistant", LONG), (3, 5, "assistant", "b"), (3, 1, "assistant", "a"), (3, 5, "assistant", "b"), (3, 7, "user", "one"), (3, 7, "user", "one"), (4, None, "user", "é\n")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, ids int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df, *queries.vocabulary()), *queries.vocabulary()).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        said = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        r = got.pop(conv)
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert not got
    assert chat.read_back(chat.format_turns(df.limit(0), *queries.vocabulary()), *queries.vocabulary()).count() == 0


def test_chat_tokens_render_to_what_is_counted():
    own = bpe.load(*queries.vocabulary())
    turns = [("user", "plain"), ("assistant", "é \U0001f600 </turn>\\"), ("tool", ""), (None, None)]
    ids, mask, ends = chat.assemble(own, turns, frozenset({"assistant"}))
    shown = chat.render(own, ids.tolist())
    assert shown == r"<turn>### User:plain</turn><turn>### Assistant:é 😀 \</turn>\\</turn><turn>### Role:tool### Text:</turn><turn>### Role:### Text:</turn>".replace(r"\U0001f600", "\U0001f600")
    assert chat.characters(own)[ids].sum() == len(shown)
    assert chat.unescape(own.decode(ids[mask].tolist()).decode()) == turns[1][1] and len(ends) == 5
    said = [chat.read_turn(own, ids[a:b], mask[a:b]) for a, b in zip(ends, ends[1:])]
    assert [(r, t) for r, t, _ in said] == [(r or "", t or "") for r, t in turns] and [x for *_, x in said] == ["", turns[1][1], "", ""]


def test_chat_escapes_are_reversible():
    rng = random.Random(1)
    for _ in range(500):
        t = "".join(rng.choice(["\\", "x", *chat.RESERVED]) for _ in range(rng.randint(0, 8)))
        assert chat.unescape(chat.escape(t)) == t


# Top k


def brute_top(rows, k):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, v in dict(x for x in good if x[0] % 100 == 0).items():
        scored = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in good if i != q and len(w) == len(v))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def test_top_k_is_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(40)]) for i in range(900)] + [(i, [0.5] * 40) for i in range(1000, 1105)]
    rows += [(None, [1.0] * 40), (1200, None), (1300, [1.0] * 39 + [None]), (1400, [1.0] * 39 + [float("nan")]), (1501, [float("inf")] * 40), (1600, [2.0, 3.0]), (1601, [1.0, 1.0]), (1700, [])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.vec_id % 100 == 0).collect()}
    assert got == brute_top(rows, 10)
    waves = {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.vec_id % 100 == 0, wave_bytes=2000).collect()}
    assert waves == got
    assert topk.top_k(df.limit(0), df.vec_id % 100 == 0).count() == 0


def test_top_k_prunes_huge_products_exactly(spark):
    rng = random.Random(6)
    rows = [(i, [float(rng.randint(-(2**24), 2**24)) for _ in range(20)]) for i in range(300)] + [(i, [2.0**24] * 20) for i in range(300, 320)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.vec_id % 100 == 0).collect()} == brute_top(rows, 10)


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e30, -1e30]), (1, [1e30, 1e30]), (2, [3e14, 7.0]), (3, [-1e30, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.vec_id % 100 == 0).collect()} == brute_top(rows, 10)


# Jaccard join


def brute_components(rows, width, percent):
    """(id, set size, links, component) of each row, by comparing all pairs of rows."""
    sets = []
    for _, t in rows:
        w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    up, links = list(range(len(rows))), Counter()

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[root(i)] = root(j)
                links.update((i, j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return Counter((d, len(sets[i]), links[i], least.get(root(i))) for i, (d, _) in enumerate(rows))


def near_copies(seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(n)] for n in (4, 12, 40, 150)]
    texts = [None, "", " ", "one", "ONE", "two words", "Two words", LONG]
    for b in base:
        for _ in range(14):
            c = list(b)
            for _ in range(rng.randint(0, max(1, len(b) // 20))):
                c[rng.randrange(len(c))] = rng.choice(["new", "W9", "zz"])
            texts.append(" ".join(c))
    return texts


@pytest.mark.parametrize("width, percent, block, most", [(3, 90, 1 << 21, 1 << 13), (5, 80, 1 << 21, 1 << 13), (3, 90, 300, 1 << 13), (3, 80, 1 << 21, 3)])
def test_jaccard_is_brute_force(spark, width, percent, block, most):
    texts = near_copies(width)
    rows = list(enumerate(texts))
    rows += [rows[10], (10, texts[40]), (11, "another text of this id"), (None, texts[12])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, n int")
    got = jaccard.jaccard_components(df, width, percent, block=block, most_sets=most).collect()
    assert Counter((r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in got) == brute_components(rows, width, percent)


def test_jaccard_takes_ids_of_text_and_shuffles_many(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST", 0)
    rows = [(f"d{i:03}", t) for i, t in enumerate(near_copies(7))]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = jaccard.jaccard_components(df, 3, 80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in got) == brute_components(rows, 3, 80)


@pytest.mark.parametrize("block", [1 << 21, 300])
def test_jaccard_join_has_every_link(spark, block):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base[:i] + [f"x{i}"] + base[i + 1 :]) for i in range(0, 60, 10)] * 2 + ["far away from all of it", None, ""]
    rows = [*enumerate(texts)]  # six near copies, twice each
    join = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80, block=block)
    grams = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} if (w := (t or "").split()) else set() for t in texts]
    linked = {(a, b) for a in range(len(texts)) for b in range(len(texts)) if a != b and grams[a] and 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b])}
    assert len(linked) == 12 * 11
    assert {(r.doc_id, r.n_links) for r in join.documents.collect()} == {(i, sum(a == i for a, _ in linked)) for i in range(len(texts))}
    links, rep = [(r.a, r.b) for r in join.links.collect()], {r.doc_id: r["class"] for r in join.members.collect()}
    assert len(links) == len(set(links)) == 6 * 5 // 2
    both = {*links, *((b, a) for a, b in links)}
    assert {(a, b) for a in rep for b in rep if a != b and (rep[a] == rep[b] or (rep[a], rep[b]) in both)} == linked


def test_sets_that_share_a_passage_are_not_searched_in_all_pairs_of_blocks(spark, monkeypatch):
    """A passage puts 60 texts into one candidate group of 12 blocks; only the three that link are searched."""
    rng, passage, seen, search = random.Random(3), [f"p{i}" for i in range(60)], spark.sparkContext.accumulator(0), jaccard._search

    def counted(*args):
        run = search(*args)

        def both(group):
            seen.add(group.num_rows)
            return run(group)

        return both

    monkeypatch.setattr(jaccard, "_search", counted)
    texts = [" ".join(passage + [f"w{rng.randrange(10**9)}" for _ in range(60)]) for _ in range(60)]
    texts += [texts[0] + " more", "less " + texts[0]]
    rows = [*enumerate(texts)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80, block=2000, most_sets=5).collect()
    assert Counter((r.doc_id, r.n_shingles, r.n_links, r.component_id) for r in got) == brute_components(rows, 5, 80)
    assert [r.doc_id for r in got if r.n_links] and seen.value <= 12


def test_ngrams_of_several_texts(monkeypatch):
    monkeypatch.setattr(jaccard, "COMMON", 5)
    rng = np.random.default_rng(8)
    for size in (1, 2, 3, 7, 1000):
        rows = np.sort(np.array([(r << 40) + (int(g) << 20) + n for r, g, n in zip(rng.integers(0, 2, 300).tolist(), rng.zipf(1.6, 300).clip(0, 99), rng.integers(0, 30, 300).tolist())]))
        cols = rows >> 40, (rows >> 20) & 0xFFFFF, rows & 0xFFFFF
        batches = [pa.RecordBatch.from_arrays([pa.array(c[i : i + size]) for c in cols], names=["root", "gram", "node"]) for i in range(0, 300, size)]
        got = [tuple(x.values()) for b in jaccard._common(iter(batches)) for x in b.to_pylist()]
        once = set(zip(*[c.tolist() for c in cols]))
        held = Counter(x[:2] for x in once)
        assert sorted(got) == sorted((*x, min(5, held[x[:2]])) for x in once if held[x[:2]] > 1)


def test_texts_of_many_ids_are_filtered_before_the_join(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST", 0)
    rows = spark.range(5000).selectExpr("CAST(id % 4000 AS STRING) AS doc", "CAST(id AS STRING) AS text")
    places = spark.range(0, 4000, 16).selectExpr("CAST(id AS STRING) AS doc", "id AS node")
    got = jaccard._with_texts(rows, places, places.count())
    assert sorted((r.doc, int(r.text), r.node) for r in got.collect()) == sorted((str(i % 4000), i, i % 4000) for i in range(5000) if i % 4000 % 16 == 0)


def test_copies_of_a_task_emit_signatures_once(spark):
    df = spark.createDataFrame([(i, "the same words again and again " * 3) for i in range(400)], "doc_id long, text string").coalesce(2)
    rows = df.selectExpr("doc_id AS row", "doc_id AS doc", "CAST(NULL AS INT) AS carry", "text").mapInArrow(jaccard._sets(3, 90), "row long, doc long, carry int, n long, lo long, hi long, signatures array<long>")
    assert rows.filter("signatures is not null").count() <= 2 and rows.count() == 400


def test_heap_merge():
    rng = np.random.default_rng(5)
    for _ in range(50):
        runs = [np.unique(rng.integers(0, 60, rng.integers(0, 30))) for _ in range(rng.integers(0, 70))]
        want = Counter(x for r in runs for x in r.tolist())
        ids, counts = jaccard.heap_merge(runs)
        assert ids.tolist() == sorted(want) and dict(zip(ids.tolist(), counts.tolist())) == want


def test_many_near_copies_take_little_time():
    """A group of 2,000 near copies: every pair is found, and the time is far under that of rewriting roots."""
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**62, 20, dtype=np.uint64)
    sets = [np.unique(np.append(base, rng.integers(0, 2**62, 1, dtype=np.uint64))) for _ in range(2000)]
    start = time.process_time()
    assert sum(len(x) for _, x in jaccard.t_occurrence(sets, 90, np.ones(2000, bool))) == 2000 * 1999 // 2
    assert time.process_time() - start < 20


def test_jaccard_edges(spark):
    df = spark.createDataFrame([(None, "a b c d"), (1, "a b c d")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in jaccard.jaccard_components(df).collect()), key=str) == [(1, 1), (None, None)]
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_signature(percent):
    rng, parts, links = np.random.default_rng(percent), jaccard.Parts(percent), 0
    for _ in range(3000):
        n = int(rng.choice([1, 2, 5, 9, 10, 19, 30, 100, 400]))
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[int(rng.integers(0, max(1, n // 5))) :], rng.integers(0, 2**63, int(rng.integers(0, max(1, n // 5))), dtype=np.uint64)]))
        same = len(np.intersect1d(a, b))
        if len(b) and 100 * same >= percent * (len(a) + len(b) - same):
            links += 1
            assert len(np.intersect1d(parts.signatures(a), parts.signatures(b)))
    assert links > 500


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 201), (201, 200)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)]
    rows = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    v, u = graph.forest(*(np.array(x) for x in zip(*edges)))
    assert {(r.v, r.root) for r in rows} == set(zip(v.tolist(), u.tolist()))
    assert len(rows) == len({r.v for r in rows})


# BPE


def test_bpe_is_the_library(spark):
    import tiktoken

    path, pattern = queries.vocabulary()
    own = bpe.load(path, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=own.ranks, special_tokens={})
    rng = random.Random(6)
    texts = [*ODD, "<|endoftext|>", "".join(rng.choice("abcdé ß\n") for _ in range(3000)), "".join(rng.choice("abcdefgh") for _ in range(700)), "՘\U00010d4a a࢏1", *["".join(chr(rng.choice((rng.randint(32, 127), rng.randint(0x80, 0xD7FF), rng.randint(0x10000, 0x10FFFF)))) for _ in range(200)) for _ in range(30)]]
    got = bpe.bpe_round_trip(frame(spark, texts), path, pattern, with_ids=True).collect()
    want = Counter()
    for t in texts:
        ids = library.encode_ordinary(t or "")
        want[(len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert Counter((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    assert bpe.bpe_round_trip(frame(spark, texts).limit(0), path, pattern).count() == 0


# HTML


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body class="home">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Menu</a></li></ul></nav><!-- no <p>no</p> --><div class="cookie-banner">We use cookies</div>
<article><h1>Head &amp; line</h1><p>First <b>bold</b>&nbsp;text.<br>Next</p><div class="ad">Buy</div><p><b>Un closed.<p>Last &#233;.</p></article>
<aside>Side</aside><form><p>Send</p></form><section class="comments"><p>A reader says much more than the article does, at length and again.</p></section><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    want = "Head & line\nFirst bold text.\nNext\nUn closed.\nLast é."
    pages = [PAGE, PAGE[: PAGE.index("</article>")], None, "", "plain &lt;text", "<p>a</p>" * 5000, "<script>only", PAGE]
    df = spark.createDataFrame([(i, f"u{i}", p, "x") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract_text(df).collect()}
    assert [got[i].text for i in range(8)] == [want, want, "", "", "plain <text", "\n".join(["a"] * 5000), "", want]
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_html_keeps_whole_articles():
    apart = '<div class="ad">buy</div><aside>side</aside><form>send</form>'
    assert html_text.main_text(f"<article><p>one</p>{apart}<p>two two</p>{apart}<p>three</p></article><p>more</p>") == "one\ntwo two\nthree"
    assert html_text.main_text("<main><h1>Head</h1><article><p>first part</p></article><section>mid</section><article><p>second</p></article></main>") == "Head\nfirst part\nmid\nsecond"
    assert html_text.main_text("<article>one article</article><article>much longer article</article>") == "one article\nmuch longer article"
    assert html_text.main_text("<article><h1>T</h1><figure><img src=x><figcaption>What it shows</figcaption></figure><p>text</p></article>") == "T\nWhat it shows\ntext"


def test_html_marks_spare_wrappers():
    for attributes in ('class="has-sidebar"', 'class="page-promo"', 'class="sidebar"', 'class="overflow-hidden"'):
        assert html_text.main_text(f"<body {attributes}><p>all the text</p></body>") == "all the text"
        assert html_text.main_text(f"<body><div {attributes}><p>all the text</p></div></body>") == "all the text"
    assert html_text.main_text('<p>the text</p><div class="cookie-bar">ok</div><div class="comments">says much more than the text</div>') == "the text"


def test_html_without_article():
    page = "<body><div class='menu'><a>x</a></div><div id=main><h1>T</h1><p>one two three</p><p>four</p></div><div class='comments'><p>long long long long long comment</p></div></body>"
    assert html_text.main_text(page) == "T\none two three\nfour"


PROSE = " ".join(["A sentence of the article."] * 20)
PAGES = [
    ("<html><head><title>x</title><body><p>hello there all</p></body>", "hello there all"),
    ("<div style='overflow:hidden'><p>hello there</p></div>", "hello there"),
    ("<div title='hidden gems'><p>hello there</p></div>", "hello there"),
    ("<div aria-hidden='false'><p>hello there</p></div>", "hello there"),
    ("<p>seen</p><div hidden><p>hello there</p></div><div aria-hidden=true>x</div><div style='color:red;display: none'>y</div>", "seen"),
    ("<article><div class='entry-header'><h1>T</h1></div><p>hello there</p></article>", "T\nhello there"),
    (f"<body><div class='article-header'><h1>T</h1></div><div class='article-body'><p>{PROSE}</p></div></body>", f"T\n{PROSE}"),
    (f"<div>Buy now</div><div>Offers</div><div><h1>Head</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE}</p><p>End.</p></div><div>Copyright 2020 Corp</div>", f"Head\n{PROSE}\nShort.\n{PROSE}\nEnd."),
    ("<p>a < b and c</p>", "a < b and c"),
    ("<p>x</p><div class=ad>buy<div>more</div></div><p>y</p>", "x\ny"),
    ("<ul class='menu'><li>a<li>b</ul><p>the text</p>", "the text"),
    ("<p>t1<p class='notice'>cookie<p>t2", "t1\nt2"),
    ("<p>text <!-- never closed <p>no", "text"),
    ("<p class=\"it's\">one</p><p title=don't>two</p>", "one\ntwo"),
    ("<p title=\"never closed>one</p><p>two</p>", "one\ntwo"),
    ("<p title='a > b'>one</p></div></div><p>two</p>", "one\ntwo"),
    ("<div class=ad><article><p>the ad was never closed</p></article>", "the ad was never closed"),
    ("<p>x</p><svg><title>drawn</title><text>drawn</text></svg><p>y</p>", "x\ny"),
    ("<p>line one<br>line   two &eacute;&#x41;&nbsp;</p>", "line one\nline two \u00e9A"),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_html_of_odd_pages(page, text):
    assert html_text.main_text(page) == text


def test_html_windows_are_brute_force():
    rng = np.random.default_rng(3)
    for n in range(0, 40):
        length = rng.choice([0, 0, 0, 3, 50, 400], n).astype(np.int64)
        sums = [int(length[i : i + html_text.WINDOW].sum()) for i in range(n)]
        assert html_text.windows(length).tolist() == sums
        full = [x > 0 and x * html_text.SHARE >= max(sums) for x in sums]
        inside = [any(a <= i < b for a, b in html_text.stretches(length)) for i in range(n)]
        assert inside == full and all(b > a for a, b in html_text.stretches(length))


@pytest.mark.parametrize("unit", ['<a "', '<a b="', "<a b='x", "<div class=ad>", "<title>", "</div>", "<p>", "<!-", "</", "<b", "<script", "<article>", "<div>"])
def test_html_takes_linear_time(unit):
    """A second is far over what a megabyte of a unit needs, and far under what its square would."""
    html_text.main_text(unit * 1000)
    start = time.process_time()
    html_text.main_text(unit * (200_000 // len(unit)) + ">")
    assert time.process_time() - start < 4


def planted(rng):
    """A page without article marks, its lines of prose, and all its lines."""
    words = lambda a, b: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "epsilon"]) for _ in range(rng.randint(a, b)))
    prose = [words(8, 60) + "." for _ in range(rng.randint(5, 14))]
    junk = [words(1, 3) for _ in range(6)]
    around = [f"<div class='c{k}'>{x}</div>" for k, x in enumerate(junk)]
    ads = [f"<div class='ad'>{words(5, 30)}</div>" for _ in prose]
    body = "".join(f"<p>{x}</p>" + (ads[k] if rng.random() < 0.3 else "") for k, x in enumerate(prose))
    menu = "".join(f"<li><a href=/{k}>{words(1, 3)}</a></li>" for k in range(9))
    return f"<ul>{menu}</ul>{''.join(around[:3])}<div id=c><h2>The title</h2>{body}</div>{''.join(around[3:])}<div class=comments><p>{words(30, 60)}</p></div>", ["The title", *prose]


def test_html_precision_and_recall():
    rng, hit, said, wanted = random.Random(4), 0, 0, 0
    for _ in range(200):
        page, prose = planted(rng)
        got = html_text.main_text(page).split("\n")
        both = sum((Counter(got) & Counter(prose)).values())
        hit, said, wanted = hit + both, said + len(got), wanted + len(prose)
    assert hit >= 0.98 * said and hit >= 0.98 * wanted, (hit / said, hit / wanted)


# Language ID


def test_language_id(spark):
    rng = random.Random(8)
    made = {"xx": ["lo", "mi", "ra"], "yy": ["gru", "sht", "pok"]}
    text = lambda k: " ".join("".join(rng.choice(made[k]) for _ in range(rng.randint(1, 4))) for _ in range(60))
    rows = [(i, text(k), k, "n") for i, k in enumerate(["xx", "yy"] * 40)] + [(900, None, "xx", "n"), (901, "12 34 !", "yy", "n"), (902, "", None, "n"), (None, text("xx"), None, "n"), (903, LONG, None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.identify(df, df.filter("doc_id < 40")).collect()}
    assert all(got[i].lang_pred == k for i, _, k, _ in rows[40:80])
    assert {got[i].lang_pred for i in (900, 901, 902)} == {"und"} and got[None].lang_pred == "xx"
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.lang_pred for r in langid.identify(df, df.limit(0)).collect()} == {"und"}
    assert langid.identify(df.limit(0), df).count() == 0


def brute_phrases(t, s):
    """One parse of the whole text t into the longest pieces of s; a symbol that s lacks is a piece."""
    n = i = 0
    while i < len(t):
        j = i
        while j < len(t) and t[i : j + 1] in s:
            j += 1
        n, i = n + 1, max(j, i + 1)
    return n


@pytest.mark.parametrize("stretch", [16, 256])
def test_phrases_are_those_of_one_parse(monkeypatch, stretch):
    """Whole texts of many stretches, periodic ones too, whose phrases meet late or never."""
    monkeypatch.setattr(langid, "STRETCH", stretch)
    rng = random.Random(2)
    seq = np.array([rng.choice([97, 98, 99]) for _ in range(400)], np.uint32)
    a, s = langid.Automaton(seq), "".join(map(chr, seq))
    for k in range(12):
        texts = ["".join(rng.choice("abcd" if k % 2 else "abc") for _ in range(rng.randint(0, 2000))) for _ in range(6)]
        texts += ["a" * 3000, "abcab" * 500, "abca" * 700, s * 5, ""]
        symbols = a.symbols(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32))
        assert a.phrases(symbols, np.array([len(t) for t in texts])).tolist() == [brute_phrases(t, s) for t in texts]


def test_wide_alphabets_stay_small():
    rng = np.random.default_rng(1)
    seq = rng.integers(0x4E00, 0x9FFF, 20_000).astype(np.uint32)
    a, s = langid.Automaton(seq), "".join(map(chr, seq))
    assert a.edges.keys.nbytes + a.edges.values.nbytes < 300 * len(seq)
    t = s[500:900] + "x" + s[40:60] + "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 300)))
    assert a.phrases(a.symbols(np.frombuffer(t.encode("utf-32-le"), np.uint32)), np.array([len(t)])).tolist() == [brute_phrases(t, s)]


def test_language_ties_and_bounds(spark):
    rows = [(1, "abc abc", "b"), (2, "abc abc", "a"), (3, "abc abc", None), (4, None, "a"), (5, "12", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(df, df).collect()}
    assert got == {1: ("a", 0.5), 2: ("a", 0.5), 3: ("a", 0.5), 4: ("und", 0.0), 5: ("und", 0.0)}
    with pytest.raises(ValueError):
        langid.identify(df, df, langid.Sample(languages=2))


def test_language_sample_is_bounded(spark):
    df = spark.createDataFrame([(i, f"word{i} " * 20, "x") for i in range(300)] + [(1000, "long " * 900, "x")], "doc_id long, text string, lang string")
    got = langid.learn(df, langid.Sample(documents=10, chars=2000), "doc_id", "text", "lang")
    assert 900 < len(got["x"]) <= 2000 and ord("g") not in got["x"]
    few = langid.learn(df, langid.Sample(documents=3, chars=9000), "doc_id", "text", "lang")
    assert 0 < len(few["x"]) <= 3 * 101


def test_language_accuracy(spark):
    """Held-out documents of the small table: some mix languages, so not all can be right."""
    out = queries.op8_language_id(spark, "/root/testdata/sf0.001").filter("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    one = out.join(truth, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert one >= 0.9


# Mixing


def plain_budget(leaves, amount, rule):
    """Budgets by finding, for each branch, the level at which its children's shares fill it."""

    def capacity(path):
        if any(rule.weights.get(path[:d], 1.0) <= 0 for d in range(1, len(path) + 1)):
            return 0
        return sum(n * rule.epochs for leaf, n in leaves.items() if leaf[: len(path)] == path and all(rule.weights.get(leaf[:d], 1.0) > 0 for d in range(1, len(leaf) + 1)))

    def deal(path, amount):
        if path in leaves:
            return {path: math.floor(amount + 1e-6)}
        below = sorted({leaf[: len(path) + 1] for leaf in leaves if leaf[: len(path)] == path}, key=str)
        low, high = 0.0, 1e12
        share = lambda t: [min(float(capacity(p)), t * rule.weights.get(p, 1.0)) for p in below]
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(share(mid)) < amount else (low, mid)
        return {k: v for p, x in zip(below, share(high)) for k, v in deal(p, x).items()}

    return deal((), min(amount, float(capacity(())))) if leaves else {}


def test_budget_is_the_plain_one():
    rng = random.Random(3)
    for _ in range(60):
        leaves = {(a, b, c): rng.randint(0, 3000) for a in "xy" for b in "pqr" for c in (None, "s", "t") if rng.random() < 0.8}
        weights = {(a,): rng.choice([0.0, 1.0, 2.5]) for a in "xy" if rng.random() < 0.5} | {(a, b): rng.choice([0.0, 0.3, 4.0]) for a in "xy" for b in "pqr" if rng.random() < 0.3}
        rule = mixing.Mixture(weights=weights, epochs=rng.randint(1, 3))
        amount = rng.random() * 1.5 * max(1, sum(leaves.values()))
        got, want = mixing.budget(leaves, amount, rule), plain_budget(leaves, amount, rule)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1 for k in got)


def test_budget_redistributes_to_siblings_first():
    leaves = {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 1000, ("b", "y"): 1000}
    got = mixing.budget(leaves, 400, mixing.Mixture(epochs=1))
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 100, ("b", "y"): 100}
    got = mixing.budget({("a", "x"): 10, ("b", "x"): 1000, ("c", "x"): 1000}, 300, mixing.Mixture(weights={("c",): 3.0}, epochs=2))
    assert got == {("a", "x"): 20, ("b", "x"): 70, ("c", "x"): 210}
    assert mixing.budget({("a",): 5}, 100, mixing.Mixture(weights={("a",): 0.0})) == {("a",): 0}
    assert mixing.budget({}, 10, mixing.Mixture()) == {}


@pytest.mark.parametrize("bucket", [5000, 3])
def test_mixing_is_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(0, 30)) if i % 17 else None, rng.choice(["en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", None]), 7) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, mix_epoch int")
    rule = mixing.Mixture(weights={("en",): 5.0}, share=0.9, epochs=3, seed=4)
    got = Counter((r.doc_id, r.mix_epoch) for r in mixing.mix(df, [df.lang, df.source], rule).collect())
    size, leaf = {r[0]: len((r[1] or "").split()) for r in rows}, {r[0]: (r[2], r[3]) for r in rows}
    leaves = Counter()
    for i in size:
        leaves[leaf[i]] += size[i]
    target = plain_budget(dict(leaves), rule.share * sum(leaves.values()), rule)
    want = Counter()
    for path, total in leaves.items():
        whole, rest = divmod(target[path], total)
        ids = [i for i in size if leaf[i] == path]
        at = {r.id: r.h for r in spark.createDataFrame([(i,) for i in ids], "id long").select("id", F.xxhash64(F.lit(rule.seed), F.lit(whole), "id").alias("h")).collect()}
        want.update((i, e) for i in ids for e in range(whole))
        held = 0
        for i in sorted(ids, key=at.get) if rest else []:
            if held + size[i] > rest:
                break
            held += size[i]
            want[(i, whole)] += 1
    assert got == want
    assert mixing.mix(df.limit(0), [df.lang, df.source], rule).count() == 0


def test_mixing_refuses_wide_trees(spark):
    df = spark.createDataFrame([(i, "a", str(i)) for i in range(9)], "doc_id long, text string, source string")
    with pytest.raises(ValueError):
        mixing.mix(df, [df.source], mixing.Mixture(most_leaves=5))


# Line dedup


def brute_lines(rows):
    key = lambda x: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x.strip(WS))
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if i is not None and len(key(x)) >= 40:
                held.setdefault(key(x), set()).add(i)
    out = Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(key(x), ())) < 5 or max(held[key(x)]) == i]
        out[(i, len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    return out


@pytest.mark.parametrize("most, per_task", [(64 << 20, 1 << 20), (1, 1 << 20), (1, 3)])
def test_line_dedup_is_brute_force(spark, monkeypatch, most, per_task):
    """By broadcast; and with hashes dealt to the shards, hot ones to several tasks."""
    monkeypatch.setattr(line_dedup, "LINES_PER_TASK", per_task)
    rng = random.Random(5)
    pool = [("é" if i % 3 else "X") * 20 + f" line {i} of the common ones here" for i in range(30)]
    texts = [*ODD, *["\n".join(rng.choice([" ", "", "\t"]) + rng.choice(pool) + rng.choice(["", "\r", " "]) for _ in range(rng.randint(0, 12))) for _ in range(60)], pool[0].upper(), "İ" * 40]
    df = frame(spark, texts)
    rows = [(r.doc_id, r.text) for r in df.collect()]
    df = df.union(df.filter("doc_id = 20"))
    rows += [r for r in rows if r[0] == 20]
    got = line_dedup.dedup_lines(df, keys_per_shard=4, broadcast_bytes=most).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in got) == brute_lines(rows)
    assert {c for c in got[0].asDict()} == {"doc_id", "text", "lang", "source", "n_lines", "n_dropped"}
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_perfect_hash():
    rng = np.random.default_rng(1)
    hi = np.unique(rng.integers(0, 2**64, 20_000, dtype=np.uint64))
    lo = rng.integers(0, 2**64, len(hi), dtype=np.uint64)
    lo[:50] = lo[0]  # keys that share a half
    h = line_dedup.PerfectHash(lo, hi)
    assert sorted(h.index(lo, hi).tolist()) == list(range(len(hi)))
    shard = line_dedup.Shard(lo, hi, np.arange(len(hi)), np.arange(len(hi)) * 3)
    n, keeper = shard.probe(lo, hi)
    assert n.tolist() == list(range(len(hi))) and keeper.tolist() == [3 * x for x in range(len(hi))]
    assert not shard.probe(lo, hi + np.uint64(1))[0].any()
    with pytest.raises(ValueError):
        line_dedup.PerfectHash(np.ones(2, np.uint64), np.ones(2, np.uint64))


def test_counts_in_the_arrays_decide(spark):
    line = "a line of more than forty characters that repeats here"
    df = spark.createDataFrame([(i, line) for i in range(4)] + [(9, "other")], "doc_id long, text string")
    keys = line_dedup.line_counts(df, "doc_id", "text", 40).filter("n > 1").collect()
    assert [(r.n, r.keeper) for r in keys] == [(4, 3)]
    assert {r.n_dropped for r in line_dedup.dedup_lines(df).collect()} == {0}
    assert sorted(r.n_dropped for r in line_dedup.dedup_lines(df, min_docs=4).collect()) == [0, 0, 1, 1, 1]
