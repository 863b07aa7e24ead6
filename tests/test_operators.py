"""Memory, alignment, catalog, ledger, gate, links and translation on small tables."""

import random
import re
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from glossweave.functions.ratios import Pairs
from glossweave.operators import align, catalog, chapters, gate, ledger, links, memory
from glossweave.operators.covers import choose
from glossweave.operators.inference import call_model_once
from glossweave.operators.paragraphs import mark_repeats, number_elements
from glossweave.plans.translate import run_stats, translate_books, with_token_rate


def test_memory_upsert(spark):
    held = memory.build_memory(
        spark.createDataFrame([("a", "A", 1), ("b", "B", 2)], "original string, translated string, pos int"),
        ["pos"],
    )
    assert all(len(r.source_hash) == 32 for r in held.collect())
    news = spark.createDataFrame(
        [("a", "A1", 1), ("a", "A2", 2), ("c", "C", 3)], "source_text string, translated_text string, seq int"
    )
    got = {r.source_text: (r.translated_text, r.change) for r in memory.upsert(held, news, "seq").collect()}
    assert got == {"a": ("A2", "updated"), "b": ("B", "kept"), "c": ("C", "inserted")}


def test_fan_out_keeps_cached_originals(spark):
    ids = spark.createDataFrame([("b", "1", None), ("b", "2", "1"), ("b", "3", None)],
                                "book_id string, id string, original_id string")
    results = spark.createDataFrame([("b", "1", "one")], "book_id string, id string, translated string")
    got = {r.id: r.translated for r in memory.fan_out(ids, results, ["book_id"]).collect()}
    assert got == {"1": "one", "2": "one", "3": None}


def test_alignment_rules(spark):
    long = "This sentence is clearly longer than fifty characters, and it keeps going on and on for a while."
    segments = spark.createDataFrame(
        [
            ("b", 0, "Same  text", "first"), ("b", 1, "Same text", "last"),
            ("b", 2, long + " Tail one", "p1"), ("b", 3, long + " Tail two", "p2"),
            ("b", 4, "Part 1.Mindset", "心态"), ("b", 5, "Two words here", "两词"),
            ("b", 6, long.replace(",", ";").upper() + " X", "sig"),
            ("b", 7, "blank", ""), ("b", 8, "Tip", "自己的"),
        ],
        "book_id string, pos int, original string, translated string",
    )
    asked = spark.createDataFrame(
        [
            ("b", 0, "Same text"), ("b", 1, long + " Other tail"), ("b", 2, "Mindset"),
            ("b", 3, "Twowords here"), ("b", 4, "nothing"), ("b", 5, "Note"), ("b", 6, "x"),
            ("b", 7, "Tip"), ("b", 8, "blank"), ("b", 9, long.replace(",", ".").upper() + " X"),
        ],
        "book_id string, pos int, text string",
    )
    got = {r.pos: (r.translated, r.align_method) for r in align.cascade(asked, segments).collect()}
    assert got == {
        0: ("last", "exact"), 1: ("p1", "prefix"), 2: ("心态", "no_label"), 3: ("两词", "no_space"),
        4: (None, "none"), 5: ("注意", "exact"), 7: ("自己的", "exact"), 8: (None, "none"),
        9: ("sig", "signature"),
    }
    rate = align.match_rate(align.cascade(asked, segments)).first()
    assert (rate.checked, rate.matched, rate.samples) == (9, 7, ["nothing", "blank"])
    bare = {r.pos: r.align_method for r in align.cascade(asked, segments, labels=False, long_keys=False).collect()}
    assert bare[5] == "none" and bare[1] == "none"


def test_paragraph_numbers_and_repeats(spark):
    rows = [("i", 0, "li", "Figure 1"), ("i", 1, "p", "Some text"), ("i", 2, "p", "Figure 1"),
            ("i", 3, "h1", "Some text")]
    df = spark.createDataFrame(rows, "item string, pos int, tag string, text string")
    got = {r.pos: r.idx for r in number_elements(df, "item", "tag", "pos", 100, rows=2).collect()}
    assert got == {1: 0, 2: 1, 3: 2, 0: 3}
    marked = {r.pos: (r.first_pos, r.is_duplicate) for r in mark_repeats(df, "item", "pos").collect()}
    assert marked == {0: (0, False), 2: (0, True), 1: (1, False), 3: (3, False)}


def test_chapters_over_small_blocks(spark):
    nodes = [("b", 0, "p", "intro"), ("b", 1, "h1", "One"), ("b", 2, "p", "a"), ("b", 3, "p", "b" * 6000),
             ("b", 4, "h2", "Empty"), ("b", 5, "h1", "Two"), ("b", 6, "h2", "x" * 120), ("b", 7, "p", "c")]
    df = spark.createDataFrame(nodes, "book string, pos int, tag string, text string")
    lines = chapters.chapter_lines(df, "book", "pos", rows=2)
    got = chapters.chapters(lines, "book", "pos").orderBy("chapter_no").collect()
    assert [(r.chapter_no, r.title, r.n_lines) for r in got] == [(0, "前言", 1), (1, "One", 2), (3, "Two", 1)]
    assert len(got[1].content) == 5000 and got[2].content == "c\n"
    text = chapters.context(chapters.chapters(lines, "book", "pos"), "book", n=1).first().context
    assert text == "前言:\nintro\n"


def test_backfill_is_idempotent(spark):
    outputs = spark.createDataFrame(
        [("p", "pending", None), ("done", "published", None), ("clean", "pending", None), ("n", None, None)],
        "book_id string, publish_status string, publish_error string",
    )
    logs = spark.createDataFrame(
        [(1, "p", "publishing", "error", "old"), (2, "p", "publishing", "error", "x" * 1200),
         (3, "done", "publishing", "error", "e"), (4, "clean", "translating", "error", "e"),
         (5, "n", "publishing", "error", "e")],
        "id int, book_id string, stage string, status string, message string",
    ).withColumn("created_at", F.expr("timestamp_ntz '2024-01-01' + make_interval(0,0,0,id)"))
    assert ledger.unbackfilled(outputs, logs).count() == 1
    once = ledger.backfill_failed(outputs, logs)
    got = {r.book_id: r for r in once.collect()}
    assert got["p"].publish_status == "failed" and got["p"].publish_error == "x" * 1000
    assert got["n"].publish_status is None and got["done"].publish_status == "published"
    again = ledger.backfill_failed(once.drop("was_backfilled"), logs)
    assert again.where("was_backfilled").count() == 0
    assert again.drop("was_backfilled").exceptAll(once.drop("was_backfilled")).count() == 0


def test_token_cost(spark):
    usage = spark.createDataFrame([("b", "translation", 285686, 596770)],
                                  "book_id string, step string, input_tokens long, output_tokens long")
    assert ledger.with_cost(usage).first().cost == 1.479226
    got = {r.step: r.total_tokens for r in ledger.token_summary(usage, "book_id").collect()}
    assert got == {"translation": 882456, "TOTAL": 882456}


def test_stage_durations_over_small_blocks(spark):
    rows = [(1, "start", 0), (2, "success", 10), (3, "start", 20), (4, "start", 30), (5, "error", 31), (6, "error", 40)]
    logs = spark.createDataFrame([(i, "b", "s", st, t) for i, st, t in rows],
                                 "id int, book_id string, stage string, status string, t int")
    logs = logs.withColumn("created_at", F.expr("timestamp_ntz '2024-01-01' + make_interval(0,0,0,0,0,0,t)"))
    row = ledger.stage_durations(logs, rows=2).first()
    assert (row.runs, row.total_seconds, row.max_seconds) == (2, 11.0, 10.0)


def test_output_upsert_sets_nulls_and_creates(spark):
    held = spark.createDataFrame([("a", "x", "y")], "book_id string, c string, d string")
    changes = spark.createDataFrame(
        [("a", 1, "c", "1"), ("a", 2, "c", None), ("new", 1, "d", "2"), ("odd", 1, "zzz", "3")],
        "book_id string, seq int, column string, value string",
    )
    got = {r.book_id: (r.c, r.d) for r in catalog.upsert_outputs(held, changes, ["c", "d"]).collect()}
    assert got == {"a": (None, "y"), "new": (None, "2"), "odd": (None, None)}
    kept = catalog.delete_books({"t": held}, spark.createDataFrame([("a",)], "book_id string"))
    assert kept["t"].count() == 0


def test_gate(spark):
    rows = [("Hello World", "", "keep_original"), ("x" * 60, "y" * 3, "keep"), ("x" * 60, "y" * 200, "retry"),
            ("short text", "好", "keep"), ("x" * 40, "y" * 130, "keep"), ("x" * 60, "[段落 1] " + "y" * 40, "retry"),
            ("f(x) = " + "x" * 60, "=== " + "y" * 60, "ok"), ("x" * 60, "y" * 60, "ok")]
    df = spark.createDataFrame([(n, o, t, "tier2_normal") for n, (o, t, _) in enumerate(rows)],
                               "n int, original string, translated string, tier string")
    got = {r.n: r for r in gate.gate(df).collect()}
    assert [got[n].action for n in range(len(rows))] == [a for _, _, a in rows]
    assert got[0].final_text == "Hello World" and got[0].issues == ["空翻译"]


def test_translation_run(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(prompt):
        calls.add(1)
        if "FAIL" in prompt:
            if prompt.startswith("["):
                return "no marks at all"
            return "单独" + prompt
        if prompt.startswith("[1] "):
            return "\n".join(p.replace("] ", "] 译", 1) for p in prompt.split("\n\n"))
        if prompt.startswith("long"):
            return None
        return "译" + prompt

    rows = [("b", 0, "Figure 1"), ("b", 1, "plain words"), ("b", 2, "Figure 1"), ("b", 3, "long" * 60),
            ("c", 0, "FAIL here"), ("c", 1, "other FAIL"), ("b", 4, "known text")]
    paragraphs = spark.createDataFrame(rows, "book_id string, pos int, text string")
    held = memory.build_memory(
        spark.createDataFrame([("known text", "已知", 0), ("plain words", " ", 1)],
                              "original string, translated string, pos int"), ["pos"])
    run = translate_books(paragraphs, held, model)
    got = {(r.book_id, r.pos): (r.translated, r.origin) for r in run.segments.collect()}
    assert got == {
        ("b", 0): ("译Figure 1", "model"), ("b", 1): ("译plain words", "model"),
        ("b", 2): ("译Figure 1", "repeat"), ("b", 3): ("long" * 60, "model"),
        ("c", 0): ("单独FAIL here", "model"), ("c", 1): ("单独other FAIL", "model"),
        ("b", 4): ("已知", "memory"),
    }
    learned = {r.source_text: r.translated_text for r in run.memory.collect()}
    assert learned["plain words"] == "译plain words" and "long" * 60 not in learned
    assert run.failed_books.count() == 0
    made = calls.value
    stats = run_stats(run.segments, []).first()
    assert stats.failed == 1 and stats.api_calls == made
    usage = spark.createDataFrame([("b", 70, 30)], "book_id string, input_tokens long, output_tokens long")
    rate = with_token_rate(run_stats(run.segments, ["book_id"]), usage, ["book_id"])
    assert {r.book_id: r.avg_tokens for r in rate.collect()} == {"b": 33.3, "c": None}
    assert calls.value == made  # nothing was sent again


def test_all_blank_run(spark):
    paragraphs = spark.createDataFrame([("b", 0, "some words"), ("b", 1, "more words")],
                                       "book_id string, pos int, text string")
    empty = spark.createDataFrame([], "source_hash string, source_text string, translated_text string")
    run = translate_books(paragraphs, empty, lambda p: "")
    assert [r.book_id for r in run.failed_books.collect()] == ["b"]
    assert run.segments.count() == 0 and run.memory.count() == 0


def test_blank_book_beside_a_good_one(spark):
    rows = [("bad", 0, "mute one"), ("bad", 1, "held"), ("good", 0, "a word"), ("good", 1, "mute but alone")]
    paragraphs = spark.createDataFrame(rows, "book_id string, pos int, text string")
    held = memory.build_memory(
        spark.createDataFrame([("held", "H", 0)], "original string, translated string, pos int"), ["pos"])
    run = translate_books(paragraphs, held, lambda p: "" if "mute" in p else "T " + p)
    assert [(r.book_id, r.n_fresh) for r in run.failed_books.collect()] == [("bad", 1)]
    assert {r.book_id for r in run.segments.collect()} == {"good"}
    assert {r.source_text for r in run.memory.collect()} == {"held", "a word"}


def test_rerun_sends_only_what_is_open(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def make(broken):
        def model(prompt):
            calls.add(1)
            if broken and "second" in prompt:
                raise ValueError("no line")
            return prompt.replace("] ", "] T ") if prompt.startswith("[1] ") else "T " + prompt
        return model

    texts = ["first words here", "second words here", "first words here " * 40, "second " * 90, "first words here " * 40]
    rows = [(b, n, t) for b in ("a", "b") for n, t in enumerate(texts)]
    paragraphs = spark.createDataFrame(rows, "book_id string, pos int, text string")
    empty = spark.createDataFrame([], "source_hash string, source_text string, translated_text string")
    folder = str(tmp_path / "answers")
    run = translate_books(paragraphs, empty, make(True), answers=folder)
    got = {(r.book_id, r.pos): r for r in run.segments.collect()}
    assert all(bool(r.error) == ("second" in r.original) for r in got.values())
    assert got["a", 1].error == "ValueError: no line" and got["a", 1].translated == texts[1] and got["a", 1].failed
    first = calls.value
    stored = spark.read.parquet(folder).collect()
    assert first == len(stored) and any(r.error for r in stored)
    # What failed is sent again, nothing else; equal long texts were one call.
    again = translate_books(paragraphs, empty, make(False), answers=folder)
    got = {(r.book_id, r.pos): r for r in again.segments.collect()}
    assert all(r.error is None and r.translated == "T " + r.original for r in got.values())
    second = calls.value - first
    assert 0 < second < first
    once_more = translate_books(paragraphs, empty, make(True), answers=folder)
    assert once_more.segments.count() == len(rows) and calls.value == first + second


def test_answers_table_edges(spark, tmp_path):
    folder = str(tmp_path / "answers")
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "")], "id int, prompt string")
    calls = spark.sparkContext.accumulator(0)

    def model(prompt):
        calls.add(1)
        return prompt.upper() + "!"

    for _ in range(2):
        got = {r.id: (r.reply, r.error) for r in call_model_once(rows, model, "prompt", folder, "s").collect()}
        assert got == {1: ("X!", None), 2: ("X!", None), 3: (None, None), 4: ("!", None)}
        assert calls.value == 2
    assert call_model_once(rows.limit(0), model, "prompt", folder, "s").count() == 0
    assert call_model_once(rows, model, "prompt", folder, "other step").count() == 4 and calls.value == 4


def test_retry_is_accepted_when_long_enough(spark):
    text = "x" * 120

    def model(prompt):
        return "[1] " + "y" * 400 if prompt.startswith("[1]") else "z" * 240

    paragraphs = spark.createDataFrame([("b", 0, text)], "book_id string, pos int, text string")
    empty = spark.createDataFrame([], "source_hash string, source_text string, translated_text string")
    row = translate_books(paragraphs, empty, model).segments.first()
    assert (row.translated, row.action, row.failed) == ("z" * 240, "retry", False)


def _score(name, title):
    if name == title:
        return 1.0
    if name in title or title in name:
        return 0.8
    return SequenceMatcher(None, name, title).ratio()


def test_run_keeps_little_on_disk(spark, tmp_path):
    """Between the steps whole texts lie once: what was hit, what was answered, and no shuffle files."""
    rng = random.Random(4)
    rows = [("b", n, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789 ", k=400))) for n in range(3000)]
    paragraphs = spark.createDataFrame(rows, "book_id string, pos int, text string")
    held = memory.build_memory(
        spark.createDataFrame([(t, "T " + t, p) for _, p, t in rows[::3]], "original string, translated string, pos int"), ["pos"])
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        run = translate_books(paragraphs, held, lambda prompt: "T " + prompt)
        assert run.segments.where("translated = 'T ' || original").count() == 3000
        assert run.segments.where("origin = 'memory'").count() == 1000
        kept = sum(f.stat().st_size for f in tmp_path.rglob("*.parquet"))
    finally:
        if before:
            spark.sparkContext.setCheckpointDir(before)
    # A third of the texts as they are, the others with their answers: 5 / 3 of them, pressed.
    assert kept < 5 / 3 * sum(len(t) for _, _, t in rows)


def test_lookup_ships_a_built_memory_once(spark):
    entries = spark.range(50).selectExpr("id as pos", "concat('t', id % 40) as original", "'T' as translated")
    asked = spark.range(60).selectExpr("id", "concat('t', id) as text")
    found = memory.lookup(asked, memory.build_memory(entries, ["pos"]))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plan.count("Exchange hashpartitioning") == 2
    assert found.where("hit").count() == 40 and found.count() == 60


def test_hits_are_those_of_lookup(spark):
    """Also where entries repeat, have a blank answer, or the hash of another text."""
    texts = ["a", "b", "c", "d", None, "a", "e"]
    paragraphs = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    entries = [("a", "A"), ("a", "A2"), ("b", " "), ("c", None), ("e", "E")]
    held = spark.createDataFrame(entries, "source_text string, translated_text string").withColumn("source_hash", F.md5("source_text"))
    held = held.unionByName(spark.createDataFrame([("x", "D")], "source_text string, translated_text string").withColumn("source_hash", F.md5(F.lit("d"))))
    held = held.unionByName(spark.createDataFrame([(None, "N")], "source_text string, translated_text string").withColumn("source_hash", F.lit(None).cast("string")))
    looked = memory.lookup(paragraphs, held)
    assert sorted((r.n, r.translated) for r in looked.where("hit").collect()) == [(0, "A"), (0, "A2"), (5, "A"), (5, "A2"), (6, "E")]
    hits = memory.with_hits(paragraphs, memory.marks(held)).collect()
    assert len(hits) == len(texts) and {r.n for r in hits if r.hit} == {r.n for r in looked.where("hit").collect()}


def test_link_matching_is_exact(spark):
    rng = random.Random(5)
    words = ["deep", "work", "rust", "data", "mind", "set", "go", "art", "of", "war", "sea"]
    titles = [" ".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(60)] + [""]
    books = [(n, t, "completed" if n % 5 else "pending", n) for n, t in enumerate(titles)]
    names = ["_".join(rng.choices(words, k=rng.randint(1, 4))).title() + ".epub" for _ in range(40)] + ["", "zzqq"]
    found = links.match_links(
        spark.createDataFrame(list(enumerate(names)), "link_id long, filename string"),
        spark.createDataFrame(books, "book_id long, title string, status string, created_seq long"),
        slice_links=9, slice_titles=7,
    )
    import re

    for row in found.collect():
        name = re.sub(r"[_\-.]+", " ", row.filename.lower()).strip()
        best, at = 0, None
        for book_id, title, status, _ in sorted(books, key=lambda b: -b[3]):
            if row.filename and status == "completed":
                score = _score(name, title)
                if score > best and score >= 0.5:
                    best, at = score, book_id
        assert row.book_id == at, row
        assert at is None or abs(row.score - best) < 1e-12


def test_link_bands_lose_nothing(spark):
    """Against all pairs: any script, near misses, links with and without a good title."""
    rng = random.Random(11)
    letters = ["abcdefgh", "mnopqrstuv", "αβγδεζηθ", "书的数据分析指南", "xyz 0123456789"]
    titles = [
        "".join(rng.choices(rng.choice(letters) + " ", k=rng.choice([1, 3, 9, 14, 30, 80]))).strip()
        for _ in range(150)
    ]
    titles += [titles[3], titles[7] + "!"]
    names = []
    for title in titles[::3]:
        changed = list(title)
        for _ in range(rng.randint(0, 4)):
            if changed:
                changed[rng.randrange(len(changed))] = rng.choice("abcβ书x")
        names.append("".join(changed))
    names += ["".join(rng.choices("".join(letters), k=20)) for _ in range(20)] + [None, "", "__", names[0]]
    books = [(n, t, "completed", n % 40) for n, t in enumerate(titles)]
    books += [(900, None, "pending", 1), (901, titles[5] + "x", "failed", 99)]
    link_df = spark.createDataFrame(list(enumerate(names)), "link_id long, filename string")
    book_df = spark.createDataFrame(books, "book_id long, title string, status string, created_seq long")
    got = {r.link_id: r for r in links.match_links(link_df, book_df, slice_links=5, slice_titles=3).collect()}
    assert sorted(got) == list(range(len(names)))
    done = [(b, t.lower().strip(), seq) for b, t, status, seq in books if status == "completed"]
    for link_id, name in enumerate(names):
        key = re.sub(r"[_\-.]+", " ", (name or "").lower()).strip()
        scores = [(_score(key, t), seq, -b) for b, t, seq in done] if name else []
        best = max([s for s in scores if s[0] >= 0.5], default=None)
        row = got[link_id]
        assert (row.book_id, row.score) == ((-best[2], pytest.approx(best[0])) if best else (None, None)), row

    newest = links._newest(book_df)
    keyed = link_df.where(F.length("filename") > 0).select("link_id", F.lower("filename").alias("link_key"))
    wanted = links._floors(keyed, newest, links.keyed_matches(keyed, newest), 0.5)
    met = links.reachable_bands(wanted, links._banded(newest)).collect()
    assert met and all(r.bound >= r.floor for r in met)
    # Pairs that meet, of all pairs.
    assert sum(r.titles for r in met) < 0.5 * wanted.count() * newest.count()


def test_ratios_side_by_side_equal_those_one_by_one():
    rng = random.Random(3)
    firsts = ["".join(rng.choices("abc d", k=k)) for k in (0, 1, 9, 40, 63, 64)]
    seconds = ["".join(rng.choices("abcé😀q", k=k)) for k in (1, 2, 30, 64, 65, 199)] + firsts[1:]
    pairs = Pairs(firsts, seconds)
    at, to = (places.ravel() for places in np.indices((len(firsts), len(seconds))))
    want = [SequenceMatcher(None, firsts[a], seconds[b]).ratio() for a, b in zip(at, to)]
    assert pairs.ratios(at, to).tolist() == want
    for floor in (0.2, 0.5, 0.9):
        a, b, bound = pairs.reaching(np.full(len(firsts), floor))
        met = dict(zip(zip(a.tolist(), b.tolist()), bound.tolist()))
        assert all(met[a, b] >= r for a, b, r in zip(at.tolist(), to.tolist(), want) if r >= floor)


def test_short_links_are_not_compared_one_by_one(monkeypatch):
    """A cell of short texts calls no matcher per pair; longer texts still do."""
    rng = random.Random(8)
    titles = ["".join(rng.choices("abcdef ", k=rng.randint(1, 50))) for _ in range(40)] + ["x" * 250]
    names = ["".join(rng.choices("abcdef ", k=rng.randint(1, 60))) for _ in range(20)] + ["x" * 240 + "yz", titles[3] + "zz"]
    floors = [rng.choice([0.5, 0.6, 0.7]) for _ in names]
    title_rows = pd.DataFrame({"title_key": titles, "book_id": range(41), "created_seq": [n // 2 for n in range(41)]})
    link_rows = pd.DataFrame({"link_key": names, "floor": floors})
    want = []
    for name, floor in zip(names, floors):
        scores = [(SequenceMatcher(None, name, t).ratio(), n // 2, -n) for n, t in enumerate(titles)
                  if t not in name and name not in t]
        best = max([s for s in scores if s[0] >= floor], default=None)
        if best:
            want.append((name, best[0], best[1], -best[2]))
    asked = []
    monkeypatch.setattr(links, "SequenceMatcher", lambda _, a, b: asked.append((a, b)) or SequenceMatcher(None, a, b))
    got = links._match_cell(link_rows, title_rows)
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want) and len(want) > 3
    assert all(len(a) > 64 or len(b) >= 200 for a, b in asked)


def test_titles_inside_links_are_spread(spark):
    """No task makes the parts of all texts, however small the tables are."""
    titles = spark.range(40).selectExpr("concat('a longer title ', id) as title_key").coalesce(1)
    names = spark.range(40).selectExpr("concat('x a longer title ', id, ' y') as link_key").coalesce(1)
    found = links._inside(titles, "title_key", names, "link_key")
    pairs = {(r.title_key, r.link_key) for r in found.collect()}
    want = {(f"a longer title {n}", f"x a longer title {m} y") for n in range(40) for m in range(40) if str(m).startswith(str(n))}
    assert pairs == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") >= 4


@pytest.mark.parametrize("empty", ["links", "books"])
def test_links_of_empty_tables(spark, empty):
    link_df = spark.createDataFrame([(1, "deep_work.epub")], "link_id long, filename string")
    book_df = spark.createDataFrame(
        [(1, "deep work", "completed", 1)], "book_id long, title string, status string, created_seq long"
    )
    if empty == "links":
        assert links.match_links(link_df.limit(0), book_df).collect() == []
    else:
        (row,) = links.match_links(link_df, book_df.limit(0)).collect()
        assert (row.book_id, row.score) == (None, None)


def test_cover_order(spark):
    rows = [("a", "x.jpg", 5, 0, "i1", None, "i1"), ("a", "y.jpg", 9, 1, "i2", "cover-image", "i1"),
            ("b", "x.jpg", 5, 0, "i1", None, None), ("b", "y.png", 5, 1, "i2", "svg cover-image", None),
            ("c", "OEBPS/c.jpg", 1, 0, None, None, "c.jpg"), ("c", "z.jpg", 99, 1, None, None, "c.jpg"),
            ("d", "b.jpg", 7, 0, None, None, None), ("d", "a.jpg", 7, 1, None, None, None)]
    df = spark.createDataFrame(rows, "book_id string, member string, size long, nth int, manifest_id string, props string, meta_cover string")
    got = {r.book_id: (r.member, r.chosen_by) for r in choose(df).collect()}
    assert got == {"a": ("x.jpg", "package"), "b": ("y.png", "property"), "c": ("OEBPS/c.jpg", "known place"),
                   "d": ("a.jpg", "largest")}


def test_run_and_alignment_compute_their_paragraphs_once(spark):
    """The model run and the alignment's segments: a row that is costly to make is made once."""
    made = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            made.add(len(frame))
            yield frame

    rows = [("b", n, f"Line number {n} of this small book") for n in range(20)] + [("b", 20, "Chapter 1"), ("b", 21, "Chapter 1")]
    plain = spark.createDataFrame(rows, "book_id string, pos int, text string")
    costly = plain.mapInPandas(count, plain.schema)
    memory = spark.createDataFrame([], "source_hash string, source_text string, translated_text string")
    run = translate_books(costly, memory, lambda prompt: prompt.replace("] ", "] T "))
    assert run.segments.count() == 22 and run.failed_books.count() == 0
    assert made.value == 22
    segments = costly.select("book_id", "pos", F.col("text").alias("original"), F.col("text").alias("translated"))
    aligned = align.cascade(plain, segments).collect()
    assert {r.align_method for r in aligned} == {"exact"} and made.value == 44


@pytest.mark.parametrize("long_keys", [True, False])
def test_alignment_goes_in_turns(spark, tmp_path, monkeypatch, long_keys):
    """As in one go, but shuffle files of some books only; what was read is deleted."""
    rng = random.Random(9)
    lines = ["".join(rng.choices("abcdefghij ", k=rng.choice([3, 20, 70]))) for _ in range(40)] + ["tip", "n o t e"]
    rows = [(b, n, rng.choice(lines)) for b in [*range(30), None] for n in range(12)]
    segments = spark.createDataFrame(
        [(b, n, "Part 3. " + t if n % 5 == 4 else t, f"{b} {n}") for b, n, t in rows if b != 7],
        "book_id long, pos int, original string, translated string")
    asked = spark.createDataFrame(
        [(b, n, t.replace(" ", "") if n % 3 == 1 else t + " and more" if n % 3 == 2 else t) for b, n, t in rows],
        "book_id long, pos int, text string")
    got = []
    folder = spark.sparkContext.getCheckpointDir()
    for turns in (1, 5):
        monkeypatch.setattr(align, "slices_of", lambda *_: turns)
        spark.sparkContext.setCheckpointDir(str(tmp_path / str(turns)))
        try:
            got.append(sorted(map(str, align.cascade(asked, segments, long_keys=long_keys).collect())))
        finally:
            if folder:
                spark.sparkContext.setCheckpointDir(folder)
        tables = [d for d in (tmp_path / str(turns)).rglob("table-*") if any(d.rglob("*.parquet"))]
        assert len(tables) == 1  # the result
    assert got[0] == got[1] and len(got[0]) > 300
    assert {m for row in got[0] for m in ("exact", "none") if m in row} == {"exact", "none"}


def test_labels_make_no_long_keys(spark):
    rows = [(1, 0, "a long line of text " * 6, "x")]
    segments = spark.createDataFrame(rows, "book_id long, pos int, original string, translated string")
    (key,) = align.keyed_segments(segments, long_keys=False).collect()
    assert key.k1 and key.k4 and key.k2 is None and key.k3 is None
    (key,) = align.keyed_segments(segments).collect()
    assert key.k2 and key.k3
