"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate, line_dedup, quality_crf, quality_rules, sentencepiece_tokens, simhash, substring, token_blocks, toxicity, url_filter

SMALL = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 7919}" for i in range(60_000))
PASSAGE = " ".join(f"alpha{i}" for i in range(60))
ROWS = [
    (1, PASSAGE), (2, PASSAGE), (2, PASSAGE), (3, None), (4, ""), (5, " \n\t "), (6, "???"), (7, "one two"), (None, PASSAGE), (None, None),
    (8, LONG), (9, LONG + " tail"), (10, "a line\nb line\nc line\nd line"), (11, "x\na line\n\nb line\nc line\nend"),
]
CLASH = ["h", "pos", "starts", "run_doc", "run_starts", "rest", "quality", "keep", "group_id", "f0", "key", "a", "b", "node", "root", "removed_lines", "pattern", "ids", "item_id"]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    return df.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")} | {c: F.lit(7) for c in CLASH})


@pytest.fixture(scope="module")
def none(edge):
    return edge.limit(0)


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (7, 0, 1), (None, 1, None), (3, None, 0)], "doc_id long, quality int, toxic int")


def items(spark):
    return spark.createDataFrame([(1, PASSAGE), (2, None), (None, PASSAGE), (3, "too short"), (4, ""), (1, PASSAGE)], "item_id long, text string")


def test_token_blocks(edge, none):
    got = sorted(((r["doc_id"], r["ids"]) for r in token_blocks.decode(*token_blocks.encode(edge)).collect()), key=str)
    assert len(got) == len(ROWS) and sum(ids is None for _, ids in got) == 2 and ([i for d, i in got if d == 4] == [[]])
    blocks, freq = token_blocks.encode(none)
    assert blocks.count() == 0 and token_blocks.decode(blocks, freq).count() == 0


def test_url_filter(spark):
    urls = [(1, "http://www.A.com/x#f"), (2, "https://a.com/x"), (3, None), (4, ""), (5, "not a url"), (None, "http://b.com"), (1, "http://www.A.com/x#f")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumns({c: F.lit(1) for c in ("listed", "block", "w0", "canonical_url")})
    listed = spark.createDataFrame([("http://a.com/x",), (None,), ("http://a.com/x",)], "url string")
    for limit in (url_filter.FILTER_LIMIT, 0):
        got = url_filter.flag_listed(pages, listed, limit).collect()
        assert len(got) == len(urls) and {r["page_id"] for r in got if r["listed"]} == {1, 2}
        assert url_filter.flag_listed(pages, listed.limit(0), limit).filter("listed").count() == 0
        assert url_filter.flag_listed(pages.limit(0), listed, limit).count() == 0


def test_simhash(edge, none):
    got = {r["doc_id"]: (r["group_id"], r["links"]) for r in simhash.near_duplicates(edge).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 8: (8, 1), 9: (8, 1)}
    assert simhash.near_duplicates(none).count() == 0


def test_simhash_tells_texts_with_one_id_apart(spark):
    a, b = PASSAGE, " ".join(f"beta{i}" for i in range(60))
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (2, a), (4, None)], "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.near_duplicates(docs).collect()) == [(1, 1, 1), (2, 1, 1), (2, 2, 1), (3, 2, 1)]
    assert sorted(map(tuple, simhash.stage(spark, docs, SMALL).collect())) == [(1, a), (2, b), (4, None)]


def test_substring(edge, none):
    got = substring.repeated_passages(edge).collect()
    assert {r["doc_id"] for r in got} == {1, 2, 8, 9}
    assert {(r["start_word"], r["end_word"]) for r in got if r["doc_id"] < 3} == {(0, 60)}
    assert substring.repeated_passages(none).count() == 0


def test_substring_tells_texts_with_one_id_apart(spark):
    a, b = PASSAGE, " ".join(f"beta{i}" for i in range(70))
    docs = spark.createDataFrame([(1, a), (2, "x " + a), (2, b), (3, b)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["start_word"], r["end_word"], r["later_windows"]) for r in substring.repeated_passages(docs).collect())
    assert got == [(1, 0, 60, 0), (2, 0, 70, 0), (2, 1, 61, 11), (3, 0, 70, 21)]


def test_sentencepiece(edge, none):
    got = sentencepiece_tokens.encode(edge)
    assert got.count() == len(ROWS) and sentencepiece_tokens.decode(got).count() == len(ROWS)
    assert sentencepiece_tokens.encode(none).count() == 0


def test_decontamination(spark, edge, none):
    for limit in (decontaminate.VOCABULARY_LIMIT, 0):
        got = sorted(tuple(r) for r in decontaminate.contamination(edge, items(spark), limit).collect())
        assert got == [(1, 1, 1.0), (2, 1, 1.0)]
        assert decontaminate.contamination(none, items(spark), limit).count() == 0
        assert decontaminate.contamination(edge, items(spark).limit(0), limit).count() == 0


def test_decontamination_matches_each_text_by_itself(spark):
    """Two texts with one id, each with half of an item: no text holds it, whatever else is listed."""
    half = [" ".join(PASSAGE.split()[:30]), " ".join(PASSAGE.split()[30:])]
    docs = spark.createDataFrame([(1, half[0]), (1, half[1]), (2, PASSAGE), (2, "other words here"), (2, PASSAGE)], "doc_id long, text string")
    for listed in ([(1, PASSAGE)], [(1, PASSAGE), (2, "four words of prose")], [(1, PASSAGE), (1, "another text of the same item")]):
        bench = spark.createDataFrame(listed, "item_id long, text string")
        for limit in (decontaminate.VOCABULARY_LIMIT, 0):
            assert [tuple(r) for r in decontaminate.contamination(docs, bench, limit).collect()] == [(2, 1, 1.0)]


def test_quality(spark, edge, none):
    rules = quality_rules.quality(edge).collect()
    assert len(rules) == len(ROWS) and quality_rules.quality(none).count() == 0
    got = quality_crf.classify(edge, labels(spark)).collect()
    assert len(got) == len(ROWS) and all(r["quality"] == 0 and not r["keep"] for r in got if r["doc_id"] in (3, 4, 5))
    assert quality_crf.classify(none, labels(spark)).count() == 0
    assert quality_crf.classify(edge, labels(spark).limit(0)).count() == len(ROWS)


def test_toxicity(spark, edge, none):
    got = toxicity.score(edge, labels(spark)).collect()
    assert len(got) == len(ROWS) and not any(r["toxic"] for r in got)
    assert toxicity.score(none, labels(spark)).count() == 0
    assert toxicity.score(edge, labels(spark).limit(0)).count() == len(ROWS)


def test_line_dedup(edge, none):
    out = line_dedup.line_dedup(edge)
    assert set(out.columns) == set(edge.columns)
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == len(ROWS) and got[11]["text"] == "x\n\nend" and got[11]["removed_lines"] == 3 and got[10]["removed_lines"] == 0
    assert got[3]["text"] is None and got[8]["text"] == LONG and got[11]["starts"] == 7
    assert line_dedup.line_dedup(none).count() == 0


def test_line_dedup_tells_texts_with_one_id_apart(spark):
    lines = lambda words: words.replace(" ", "\n")
    docs = spark.createDataFrame([(1, lines("a b c")), (2, lines("a b c x")), (2, lines("u v w y")), (3, lines("u v w z")), (3, lines("u v w z"))], "doc_id long, text string")
    got = sorted(tuple(r) for r in line_dedup.line_dedup(docs).collect())
    assert got == [(1, lines("a b c"), 0), (2, lines("u v w y"), 0), (2, "x", 3), (3, "z", 3), (3, "z", 3)]


def test_line_dedup_of_single_long_lines(spark):
    long = " ".join(f"w{i}" for i in range(line_dedup.LONG_WORDS))
    half = " ".join(f"v{i}" for i in range(line_dedup.LONG_WORDS // 2))
    other = " ".join(f"u{i}" for i in range(line_dedup.LONG_WORDS - line_dedup.LONG_WORDS // 2))
    texts = [long, f"a\n{long}\nb", f"{half}\n{other}", f"c\n\n {half}\n{other}\nd", f"{half}\nx", f"{long} more", long.replace(" ", "\t", 1), f"{long}\n{long}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in line_dedup.line_dedup(docs).orderBy("doc_id").collect()]
    assert got == [long, "a\nb", texts[2], "c\n\nd", texts[4], texts[5], texts[6], ""]


HUGE = "\n".join(" ".join(f"huge{i}x{j}" for j in range(20)) for i in range(15_000)) + "\nyou are a moron"


@pytest.fixture(scope="module")
def huge(spark):
    """Texts longer than a kernel's slice, one with a copy and one with a benchmark item at its end."""
    from tidemark.llm import textkernel

    assert len(HUGE) > 1.5 * textkernel.SLICE_BYTES
    return spark.createDataFrame([(1, HUGE), (2, HUGE + "\ntail"), (3, " ".join(f"other{i}" for i in range(300_000)) + " " + PASSAGE), (4, "short")], "doc_id long, text string").coalesce(1)


def test_very_long_texts(spark, huge):
    pairs = lambda df: sorted(tuple(r) for r in df.collect())
    assert pairs(simhash.near_duplicates(huge)) == [(1, 1, 1), (2, 1, 1)]
    words = 300_000 + 4
    assert pairs(substring.repeated_passages(huge)) == [(1, 0, words, 0), (2, 0, words, words - 49)]
    assert pairs(decontaminate.contamination(huge, items(spark))) == [(3, 1, 1.0)]
    assert {r["doc_id"]: r["removed_lines"] for r in line_dedup.line_dedup(huge).select("doc_id", "removed_lines").collect()} == {1: 0, 2: 15_001, 3: 0, 4: 0}
    assert {r["doc_id"] for r in toxicity.score(huge, labels(spark)).collect() if r["toxic"]} == {1, 2}
    assert quality_rules.quality(huge).count() == quality_crf.classify(huge, labels(spark)).count() == 4
    blocks, freq = token_blocks.encode(huge)
    sizes = {r["doc_id"]: len(r["ids"]) for r in token_blocks.decode(blocks, freq).collect()}
    assert sizes[2] > sizes[1] > token_blocks.BLOCK_TOKENS > sizes[4]
    assert all(r["parity"] and r["round_trip"] for r in sentencepiece_tokens.encode(huge).select("parity", "round_trip").collect())


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, edge, none, name, stage):
    last = name == corpus_pipeline.STAGES[-1][0]
    for docs in (edge, none):
        out = stage(spark, docs, SMALL)
        assert last or out.columns == docs.columns
        assert out.count() <= docs.count()
    if name == "simhash_near_dedup":
        kept = sorted(r["doc_id"] or 0 for r in stage(spark, edge, SMALL).collect())
        assert kept == [0, 0, 1, 3, 4, 5, 6, 7, 8, 10, 11]


def test_pipeline_is_its_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        want = spark.createDataFrame(stage(spark, want, SMALL).toPandas(), docs.schema)
    want = sorted(map(str, corpus_pipeline.STAGES[-1][1](spark, want, SMALL).collect()))
    assert want and want == sorted(map(str, corpus_pipeline.run(spark, SMALL).collect()))
