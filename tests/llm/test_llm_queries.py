"""Registered queries against their SQL, and the pipeline's stages against plain versions, on the small tables."""

from collections import Counter

import pytest

from tallyspark.llm import queries

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(name, same):
    same(queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, out = docs.columns, docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = out
        out = spark.createDataFrame(stage(spark, before, SMALL).collect(), stage(spark, before, SMALL).schema)
        seen[name] = (before.collect(), out.collect())
        assert name == "bpe_tokens" or out.columns == columns
    before, after = seen["language_id"]
    assert {r.doc_id for r in before if any(c.isalpha() for c in r.text)} >= {r.doc_id for r in after} and len(after) > 0.99 * len(before)
    before, after = seen["line_dedup"]
    assert len(before) == len(after) and all(r.n_chars == len(r.text) for r in after)
    before, after = seen["near_duplicates"]
    grams = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := r.text.lower().split()) else set() for r in before}
    left, ids = {r.doc_id for r in after}, sorted(grams)
    close = lambda a, b: bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)
    for i, a in enumerate(ids):
        near = [b for b in ids if b != a and close(grams[a], grams[b])]
        assert near or a in left
        assert not (a in left and any(b in left for b in near))
    before, after = seen["source_mixing"]
    tokens = lambda rows: sum(len(r.text.split()) for r in rows)
    assert 0.85 * tokens(before) <= tokens(after) <= 0.95 * tokens(before) + 1
    before, after = seen["bpe_tokens"]
    assert Counter(r.doc_id for r in before) == Counter(r.doc_id for r in after)


def test_pipeline_run(spark):
    rows = corpus_pipeline.run(spark, SMALL)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and rows.count() > 100


ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, None), (4, "12 34 !", "de", "b"), (None, "no id has this text of some words here", "en", "a"),
    (5, "x " * 200_000, "en", "a"), (6, "one two three four five six seven eight", "en", "a"), (6, "one two three four five six seven eight", "en", "a"),
    (6, "quite another text under the same id as before", "en", "a"), (7, "one two three four five six seven eight", "en", "b"), (8, "one two three four five six seven eight nine", "en", "b"),
]
CLASHING = ["lang_pred", "score", "n_lines", "n_dropped", "mix_epoch", "component_id", "n", "carry", "row", "at"]


@pytest.fixture(scope="module")
def odd(spark):
    """Rows of null, empty, very long and repeated texts and ids, with columns whose names operators use too."""
    rows = [(*r, len(r[1] or ""), *[f"{c} {i}" for c in CLASHING]) for i, r in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in CLASHING))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, odd, name, stage):
    rows = stage(spark, odd, SMALL).collect()
    assert stage(spark, odd.limit(0), SMALL).count() == 0
    if name == "bpe_tokens":
        assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ODD)
        return
    assert all([*r.asDict()] == odd.columns for r in rows)
    before = {tuple(r) for r in odd.collect()}
    assert {tuple(r)[5:] for r in rows} <= {r[5:] for r in before}  # other columns come through untouched
    if name != "line_dedup":
        assert {tuple(r) for r in rows} <= before
    told = Counter((r.doc_id, (r.text or "")[:30]) for r in rows)
    if name == "language_id":
        assert {1, 2, 3, 4}.isdisjoint({r.doc_id for r in rows})
    if name == "line_dedup":
        assert len(rows) == len(ODD)
    if name == "near_duplicates":
        assert told[(6, ODD[6][1][:30])] == 1 and told[(6, ODD[8][1][:30])] == 1  # a copy goes, another text of the id stays
        assert {r.doc_id for r in rows} == {None, 1, 2, 3, 4, 5, 6}


def test_near_duplicates_with_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "BROADCAST", 0)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words[:k] + [f"new{k}"] + words[k + 1 :]) for k in range(0, 60, 12)]
    rows = [(i % 3, t) for i, t in enumerate(texts)] + [(9, "alone " + " ".join(words[:9])), (9, "apart " + " ".join(words[20:30]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, SMALL).collect()
    assert sorted(r.doc_id for r in got) == [0, 9, 9]
