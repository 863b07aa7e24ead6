import random

import corpus_pipeline
from glossweave.llm import near_copies
from tests.llm import plain

FOLDER = "/root/testdata/sf0.01"


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0


def _want(texts):
    sets = {i: plain.shingle_set(t) for i, t in texts.items()}
    return plain.components(
        sets, lambda a, b: min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b]))
        and _jaccard(sets[a], sets[b]) >= 0.8,
    )


def test_near_copies_against_all_pairs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    want = _want({d.doc_id: d.text for d in docs.collect()})
    got = {r.id: r.component for r in near_copies.near_copy_groups(docs).collect()}
    assert got == {i: c for i, c in want.items() if i != c}


def test_planted_copies(make_docs):
    pick = random.Random(1)
    words = [f"w{k}" for k in range(500)]
    base = [" ".join(pick.choices(words, k=120)) for _ in range(30)]
    rows = [(n, t, "en", "a") for n, t in enumerate(base)]
    for n, text in enumerate(base[:15]):
        changed = text.split()
        changed[60] = "changed"
        rows.append((100 + n, " ".join(changed), "en", "a"))
        rows.append((200 + n, text.upper(), "en", "a"))
        rows.append((300 + n, " ".join(text.split()[:60] + pick.choices(words, k=60)), "en", "a"))
    rows += [(0, base[0], "en", "a"), (400, None, "en", "a"), (401, "", "en", "a"), (None, base[1], "en", "a")]
    docs = make_docs(rows)
    for size in (8, 1024):
        kept = near_copies.drop_near_copies(docs, slice_rows=size).collect()
        ids = sorted(r.doc_id for r in kept if r.doc_id is not None)
        assert ids == sorted([*range(30), *range(300, 315), 400, 401])
    assert near_copies.drop_near_copies(docs.limit(0)).count() == 0


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, FOLDER)
        assert made.columns == docs.columns and made.dtypes == docs.dtypes, name
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert len(rows) > 300 and {"doc_id", "n_tokens"} <= set(rows[0].asDict())


def test_stages_on_odd_rows(spark, make_docs):
    docs = make_docs([(None, None, None, None), (1, "", "en", "a"), (1, "the cat at a@b.cd", "en", "a"), (2, "12", None, "b")])
    for d in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            d = stage(spark, d, FOLDER) if name != "tokens" else d
        assert corpus_pipeline.tokens(spark, d, FOLDER).count() == d.count()


def test_near_copies_meet_in_fingerprint_blocks(make_docs, monkeypatch):
    pick = random.Random(2)
    text = " ".join(pick.choices([f"w{k}" for k in range(5000)], k=4000))
    docs = make_docs([(1, text, "en", "a"), (2, text + " end", "en", "a"), (3, text[: len(text) // 2], "en", "a")])
    # Without parts to meet in, blocks of fingerprints alone bring the pair together.
    parts = near_copies.part_keys
    monkeypatch.setattr(near_copies, "part_keys", lambda shingles, similarity: parts(shingles, similarity)[:0])
    assert [(r.id, r.component) for r in near_copies.near_copy_groups(docs).collect()] == [(2, 1)]
