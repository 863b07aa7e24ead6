from pyspark.sql import functions as F

from glossweave.llm import pii
from glossweave.llm.queries import QUERIES
from tests.llm import plain

FOLDER = "/root/testdata/sf0.01"
TRICKY = [
    None, "", "a@b.c_d@e.f x", "..a@b.co.uk@c.d", "me@host me@host. me@host.x-", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.1",
    "01.02.03.04 999.1.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "+1 (743) 555-3824",
    "+1 2 +12345678 +123456789 (1)", "++1234567890-", "é😀 4465758382889437 4465758382889437 x@y.z", "1" * 50_000,
    "1 " * 20_000, "a" * 50_000, "a." * 20_000, "x@" + "y." * 20_000 + "z", "+" + "1." * 30_000,
    "a%b@c.d,e+f@g.h", "1.1.1.1e@f.gg", "12345678901234567890",
]


def _same(rows, texts):
    for r in rows:
        want = plain.personal(texts[r.doc_id])
        assert r.base_sha256 == plain.sha(plain.listed(want)), texts[r.doc_id][:80]
        for kind in pii.KINDS:
            assert r[f"n_{kind}"] == sum(k == kind for k, _, _ in want)
        assert set(plain.listed(want).split(",")) - {""} <= set(r.spans.split(","))


def test_query_against_patterns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    rows = QUERIES["op5_pii"](spark, FOLDER).collect()
    assert len(rows) == len(docs)
    _same(rows, {d.doc_id: d.text for d in docs})


def test_edges(spark, make_docs, folder_of):
    docs = make_docs(TRICKY)
    rows = QUERIES["op5_pii"](spark, folder_of(documents=docs)).collect()
    assert len(rows) == len(TRICKY)
    _same(rows, {d.doc_id: d.text for d in docs.collect()})
    assert QUERIES["op5_pii"](spark, folder_of(documents=docs.limit(0))).count() == 0


def test_revealing_terms(make_docs):
    told = [f"text {n} says Zorblatt uses zor@example.com always and {n}" for n in range(5)]
    other = [f"always says nothing {n}" for n in range(30)] + ["Zorblatt", None]
    docs = make_docs(told + other).withColumn("spans", F.lit(1)).withColumn("text_key", F.lit("x"))
    found = pii.personal_spans(docs)
    assert sorted(found.columns) == sorted(docs.columns) and found.count() == docs.count()
    clean = found.select("doc_id", pii.sanitised(F.coalesce("text", F.lit("")), F.col("spans")).alias("t"))
    texts = {r.doc_id: r.t for r in clean.collect()}
    for n in range(5):
        assert "zor@" not in texts[n] and "[EMAIL]" in texts[n] and "Zorblatt" not in texts[n]
        assert "always" in texts[n]
    assert "Zorblatt" not in texts[35] and texts[10] == "always says nothing 5"


def test_revealing_terms_in_all_texts(make_docs):
    told = [f"text {n} says Quillon uses quill@example.com always" for n in range(10)]
    apart = [f"here {n} Quillon alone" for n in range(5)]
    docs = make_docs(told + apart + [f"always says nothing {n}" for n in range(3000)])
    clean = pii.personal_spans(docs).select("doc_id", pii.sanitised(F.col("text"), F.col("spans")).alias("t"))
    texts = {r.doc_id: r.t for r in clean.where("doc_id < 20").collect()}
    assert all("Quillon" not in texts[n] for n in range(15)) and texts[15] == "always says nothing 0"


def test_very_many_matches(make_docs):
    text = " ".join(f"é{n} write to u{n}@mail.example.com" for n in range(10_000))
    row = pii.personal_spans(make_docs([text])).withColumn("t", pii.sanitised(F.col("text"), F.col("spans"))).first()
    base = [s for s in row.spans if s["kind"] in pii.KINDS]
    assert [(s["kind"], s["start"], s["end"]) for s in base] == plain.personal(text)
    assert "@" not in row.t and row.t.count("[EMAIL]") == 10_000
