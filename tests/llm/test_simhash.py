from glossweave.llm import simhash
from glossweave.llm.components import connected_components
from glossweave.llm.queries import QUERIES
from tests.llm import plain

FOLDER = "/root/testdata/sf0.01"


def _same(rows, texts):
    marks = {i: plain.fingerprint(t) for i, t in texts.items() if i is not None}
    want = plain.components(marks, lambda a, b: (marks[a] ^ marks[b]).bit_count() <= 4)
    for r in rows:
        if r.doc_id is not None:
            assert r.fingerprint == f"{marks[r.doc_id]:016x}"
            assert r.component_id == want[r.doc_id]


def test_query_against_all_pairs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    rows = QUERIES["op3_simhash"](spark, FOLDER).collect()
    assert len(rows) == len(docs)
    _same(rows, {d.doc_id: d.text for d in docs})


def test_edges(spark, make_docs, folder_of):
    long = " ".join(f"w{k}" for k in range(40_000))
    docs = make_docs([None, "", "one", "ONE", "one two three", long, long + " x", " \t\n", "a b c d", "a b c d"])
    rows = QUERIES["op3_simhash"](spark, folder_of(documents=docs)).collect()
    assert len(rows) == 10
    _same(rows, {d.doc_id: d.text for d in docs.collect()})


def test_null_id_and_empty_table(spark, make_docs, folder_of):
    docs = make_docs([(None, "some words are here", None, None), (7, "some words are here", None, None)])
    rows = QUERIES["op3_simhash"](spark, folder_of(documents=docs)).collect()
    assert {r.component_id for r in rows} == {7}
    assert QUERIES["op3_simhash"](spark, folder_of(documents=docs.limit(0))).count() == 0


def test_large_bucket_is_cut_into_slices(spark):
    # A chain of fingerprints, each one bit from the next, all in the same buckets.
    marks = [(n, (1 << n) - 1) for n in range(20)] + [(100 + n, n << 50) for n in range(64)]
    df = spark.createDataFrame(marks, "id long, fp long")
    for rows in (5, 1000):
        links = simhash.fingerprint_links(df, 4, 7, rows)
        got = {r.node: r.component for r in connected_components(links, "a", "b").collect()}
        fp = dict(marks)
        want = plain.components(fp, lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
        assert all(got.get(i, i) == want[i] for i in fp)


def test_components(spark):
    chain = [(n, n + 1) for n in range(40)] + [(100, n) for n in range(101, 140)] + [(5, 5), (None, 1)]
    edges = spark.createDataFrame(chain, "a long, b long")
    got = {r.node: r.component for r in connected_components(edges, "a", "b").collect()}
    assert all(got[n] == 0 for n in range(41)) and all(got[n] == 100 for n in range(100, 140))
    assert connected_components(edges.limit(0), "a", "b").count() == 0
