"""Operators against brute force, round trips and held-out labels."""

import itertools

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, crf, decontaminate, line_dedup, quality_crf, quality_rules, rans, sentencepiece_tokens, simhash, substring, token_blocks, toxicity, url_filter, wfst
from tidemark.llm import textkernel as tk

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def all_hot(batches):
    """substring._probe, calling every suspected anchor hot."""
    for batch in probe(batches):
        yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("anchor"), pa.array(np.ones(batch.num_rows, bool))], ["part", "anchor", "hot"])


probe = substring._probe


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return con.execute(sql)


def test_rans_round_trip_and_checksum():
    rng = np.random.default_rng(1)
    tokens = np.minimum(rng.geometric(0.01, 300_000), 999).astype(np.int64)
    table = rans.Table.of(rans.scale(np.bincount(tokens, minlength=1000)))
    block = rans.encode(tokens, table)
    parts = [rans.decode_segment(block, table, i) for i in range(len(block.checksums))]
    assert np.array_equal(np.concatenate(parts), tokens) and len(parts) > 1
    last = rans.decode_segment(block, table, len(parts) - 1)  # a segment needs no other
    assert np.array_equal(last, parts[-1])
    broken = bytearray(block.stream)
    for i in range(0, len(broken), 7):
        broken[i] ^= 255
    block.stream = bytes(broken)
    with pytest.raises(Exception):
        [rans.decode_segment(block, table, i) for i in range(len(parts))]


def test_token_blocks_round_trip(docs):
    blocks, freq = token_blocks.encode(docs)
    got = {r["doc_id"]: r["ids"] for r in token_blocks.decode(blocks, freq).collect()}
    with open(token_blocks.RANKS, "rb") as f:
        enc, _ = token_blocks.encoder(f.read())
    want = {r["doc_id"]: enc.encode_ordinary(r["text"]) for r in docs.collect()}
    assert got == want
    # segment by segment, each in a task of its own, gives the same tokens
    size = {(r["block_id"], r["segment"]): r["ids"] for r in token_blocks.decode_segments(blocks, freq).collect()}
    for b in blocks.collect():
        tokens = sum((size[b["block_id"], i] for i in range(len(b["checkpoints"]))), [])
        assert tokens == [t for d in b["doc_ids"] for t in want[d]] and len(b["checkpoints"]) == -(-b["n_tokens"] // (256 * 512))


def test_token_block_query_decodes_by_itself(spark, docs):
    out = token_blocks.query(spark, SMALL)
    assert out.filter("frequencies is not null").count() == 1
    got = {r["doc_id"]: r["ids"] for r in token_blocks.decode(*token_blocks.load(out)).collect()}
    with open(token_blocks.RANKS, "rb") as f:
        enc, _ = token_blocks.encoder(f.read())
    assert got == {r["doc_id"]: enc.encode_ordinary(r["text"]) for r in docs.collect()}


def test_url_filter_is_exact_beside_and_beyond_the_filter(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    listed = url_filter.listed_urls(pages)
    near = url_filter.flag_listed(pages, listed)
    assert rows(near) == rows(url_filter.flag_listed(pages, listed, filter_limit=0))
    assert near.count() == pages.count() and near.filter("listed").count() > 0


def all_links(texts):
    """(index, least index of its group, documents linked) by comparing all pairs of texts."""
    prints = simhash.fingerprints(pa.array(texts, pa.string()))
    full = prints.any(axis=1)
    bits = sum(np.bitwise_count(prints[:, None, w] ^ prints[None, :, w]).astype(int) for w in range(simhash.LANES))
    shared = sum((prints[:, None].view(np.uint8)[:, :, p] == prints[None].view(np.uint8)[:, :, p]).astype(int) for p in range(simhash.PLACES))
    link = (bits <= simhash.VERIFY_BITS) & (shared >= simhash.MIN_SHARED) & full[:, None] & full
    assert (shared[bits <= simhash.SURE_BITS] >= simhash.MIN_SHARED).all()
    np.fill_diagonal(link, False)
    least = np.arange(len(texts))
    while True:  # least index over the links, until nothing changes
        low = np.minimum(least, np.where(link, least[None], len(texts)).min(axis=1, initial=len(texts)))
        if np.array_equal(low, least):
            break
        least = low
    return {(i, int(least[i]), int(n)) for i, n in enumerate(link.sum(axis=1)) if n}


@pytest.mark.parametrize("limits", [{}, {"pair_limit": 0}, {"block": 64}, {"block": 64, "pair_limit": 0}])
def test_simhash_links_equal_all_pairs(docs, limits):
    local = docs.orderBy("doc_id").toArrow()
    ids = local.column("doc_id").to_pylist()
    want = {(ids[i], ids[g], n) for i, g, n in all_links(local.column("text").to_pylist())}
    assert want and {tuple(r) for r in simhash.near_duplicates(docs, **limits).collect()} == want


def near_copies(n, words=150, changed=8, copies=1):
    rng = np.random.default_rng(6)
    texts = []
    for i in range(n):
        text = [f"w{k}" for k in range(words)]
        for k in rng.integers(0, words, changed).tolist():
            text[k] = f"x{i}y{k}"
        texts += [" ".join(text)] * copies
    return texts


@pytest.mark.parametrize("limits", [{}, {"block": 128}, {"block": 128, "pair_limit": 0}])
def test_simhash_links_in_lists_of_a_thousand(spark, limits):
    """One cluster of near copies, so that lists are long and blocks of them meet; some exact copies."""
    texts = near_copies(1000) + near_copies(100, changed=30, copies=2)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {tuple(r) for r in simhash.near_duplicates(df, **limits).collect()} == all_links(texts)


def test_stars_keep_components():
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 300, 200), rng.integers(0, 300, 200)
    root = np.arange(300)
    for x, y in zip(a, b):
        x, y = sorted((root[x], root[y]))
        root[root == y] = x
    left, right = simhash.stars(a, b)
    assert dict(zip(left.tolist(), right.tolist())) == {i: int(r) for i, r in enumerate(root) if r != i}


def test_every_choice_of_shared_bytes_meets_in_a_list():
    rng = np.random.default_rng(8)
    for size in (2, 3):
        posted = {tuple(k) for k in simhash.kinds(size).tolist()}
        for _ in range(300):
            shared = np.sort(rng.choice(simhash.PLACES, simhash.MIN_SHARED, replace=False)).tolist()
            assert any(c in posted for c in itertools.combinations(shared, size))


def test_simhash_recall_of_all_pairs_within_verify_bits(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    local = docs.orderBy("doc_id").toArrow()
    prints = simhash.fingerprints(local.column("text").combine_chunks())
    ids = local.column("doc_id").to_pylist()
    group = {r["doc_id"]: r["group_id"] for r in simhash.near_duplicates(docs).collect()}
    bits = sum(np.bitwise_count(prints[:, None, w] ^ prints[None, :, w]).astype(int) for w in range(simhash.LANES))
    full = prints.any(axis=1)
    a, b = np.nonzero(np.triu((bits > 0) & (bits <= simhash.VERIFY_BITS) & full[:, None] & full, 1))
    caught = [ids[x] in group and group[ids[x]] == group.get(ids[y]) for x, y in zip(a, b)]
    assert len(a) > 50 and np.mean(caught) >= 0.98


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 102), (102, 101)]
    got = dict(rows(components.components(spark.createDataFrame(edges, "a long, b long"))))
    assert got == {i: 1 for i in range(2, 41)} | {101: 100, 102: 100, 200: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substring_against_sql(docs):
    got = rows(substring.repeated_passages(docs).select("doc_id", "start_word", "end_word", "later_windows"))
    assert got == sorted(oracle(substring.SQL, documents=docs).fetchall()) and got

def test_substring_of_hot_windows(docs, monkeypatch):
    """Windows that are aggregated before the shuffle give the same rows."""
    want = rows(substring.repeated_passages(docs))
    monkeypatch.setattr(substring, "_probe", all_hot)
    assert rows(substring.repeated_passages(docs)) == want


def test_sketch_never_counts_too_low():
    rng = np.random.default_rng(9)
    anchor = rng.integers(1, 1 << 62, 5000).repeat(rng.integers(1, 4, 5000))
    shard = anchor % 3
    batch = pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(shard), pa.array(np.ones(len(anchor), np.int64))], ["anchor", "shard", "n"])
    halves = [batch.slice(0, len(anchor) // 2), batch.slice(len(anchor) // 2)]
    partial = pa.Table.from_batches([x for h in halves for x in substring._partial_sketches(iter([h]))]).sort_by([("shard", "ascending"), ("row", "ascending")])
    sketch = pa.Table.from_batches(substring._merge_sketches(iter(partial.to_batches())))
    asked = pa.RecordBatch.from_arrays([pa.array(shard), pa.array(anchor), pa.array(np.zeros(len(anchor), np.int32)), pa.array(np.ones(len(anchor), bool))], ["shard", "anchor", "part", "late"])
    table = pa.concat_tables([sketch.append_column("late", pa.array(np.zeros(sketch.num_rows, bool))), pa.Table.from_batches([asked])], promote_options="default").sort_by([("shard", "ascending"), ("late", "ascending")])
    found = pa.Table.from_batches(substring._probe(iter(table.combine_chunks().to_batches())))
    value, count = np.unique(anchor, return_counts=True)
    got = set(found.column("anchor").to_pylist())
    assert set(value[count > 1].tolist()) <= got and len(got) < 1.1 * (count > 1).sum()


def test_sentencepiece_parity_and_round_trip(docs):
    import sentencepiece

    encoded = sentencepiece_tokens.encode(docs)
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_tokens.MODEL)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in encoded.collect():
        assert r["ids"] == sp.encode(texts[r["doc_id"]])
    back = {r["doc_id"]: r["text"] for r in sentencepiece_tokens.decode(encoded).collect()}
    assert back == {k: sp.decode(sp.encode(v)) for k, v in texts.items()}


@pytest.mark.parametrize("text", ["", " ", "a", "  two  spaces ", "▁marks▁", "tab\tline\nend\r\n", "😀 \u0000 ñandú ﬁ Å", "<s> </s> <unk> <0x41>", "x" * 5000, "日本語テキスト" * 50])
def test_sentencepiece_hard_texts(text):
    import sentencepiece

    with open(sentencepiece_tokens.MODEL, "rb") as f:
        data = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    own = sentencepiece_tokens.build(sentencepiece_tokens.parse(data))
    assert own is not None
    assert list(sentencepiece_tokens.codec(data).encode([text])[0]) == sp.encode(text)


def unigram_model(data):
    """A unigram model's protobuf with the pieces of a BPE file, scored by their rank and length."""
    import struct

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    field = lambda number, value: varint(number << 3 | 2) + varint(len(value)) + value
    number = lambda n, value: varint(n << 3) + varint(value)
    m = sentencepiece_tokens.parse(data)
    out = b""
    for i, (p, k) in enumerate(zip(m.pieces, m.kinds)):
        score = -np.log(i + 2.0) - 0.01 * len(p) if k == sentencepiece_tokens.NORMAL else 0.0
        out += field(1, field(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + number(3, k))
    return out + field(2, number(3, 1) + number(35, 1)) + field(3, number(3, 1) + number(4, 0) + number(5, 1))


def test_unigram_parity_is_of_whole_texts(docs):
    import sentencepiece

    with open(sentencepiece_tokens.MODEL, "rb") as f:
        data = unigram_model(f.read())
    sp = sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    ids, ends, parity = sentencepiece_tokens.Codec(data).encode(texts)
    own = [x.tolist() for x in np.split(ids, ends[:-1])]
    assert [a == b for a, b in zip(own, sp.encode(texts))] == parity.tolist() and parity.mean() > 0.9


def test_parity_is_false_where_ids_differ(docs):
    with open(sentencepiece_tokens.MODEL, "rb") as f:
        c = sentencepiece_tokens.Codec(f.read())
    c.reference = type("Other", (), {"encode": lambda self, texts, num_threads: [[0]] * len(texts)})()
    _, _, parity = c.encode(["some words", "", "more"])
    assert parity.tolist() == [False, True, False]


def test_decontamination_against_sql_and_without_broadcast(spark, docs):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    cut = lambda df: sorted((r["doc_id"], r["item_id"], round(r["containment"], 9)) for r in df.collect())
    got = cut(decontaminate.contamination(docs, bench))
    want = oracle(decontaminate.SQL, documents=docs, benchmark=bench).fetchall()
    assert got == sorted((a, b, round(c, 9)) for a, b, c in want) and got
    assert got == cut(decontaminate.contamination(docs, bench, vocabulary_limit=0))


def test_quality_rules_agree_with_labels(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.quality(docs).join(labels, "doc_id").select("keep", "quality").toPandas()
    assert (got["keep"] == (got["quality"] == 1)).mean() > 0.85
    assert got[got["quality"] == 1]["keep"].mean() > 0.95


def test_expectation_maximisation_finds_accuracies():
    vote = np.array([[1] * 10, [-1] * 10, [0] * 10])
    share, accuracy = quality_rules.fit(vote, np.array([900.0, 100.0, 5.0]))
    p = quality_rules.posterior(vote, share, accuracy)
    assert p[0] > 0.9 and p[1] < 0.1 and abs(p[2] - share[0]) < 1e-9 and (accuracy[0] > 0.9).all()


def test_quality_rules_against_brute_force(spark, docs):
    """The query over documents one by one: the model's equations in plain loops, no patterns."""
    local = docs.orderBy("doc_id").limit(60).select("doc_id", "text").union(spark.createDataFrame([(-1, None), (-2, "")], "doc_id long, text string"))
    ids, texts = zip(*[tuple(r) for r in local.collect()])
    vote = [[int(v) for v in quality_rules.votes(pa.array([t], pa.string()))[0]] for t in texts]
    kinds, n = list(quality_rules.KINDS.values()), len(quality_rules.RULES)
    hope = [[0.99] * n] + [[0.3 if r in k else 0.8 for r in quality_rules.RULES] for k in kinds]
    accuracy, c = [list(h) for h in hope], 1 + len(kinds)
    p = []
    for v in vote:
        raw = [0.2] + [sum(v[quality_rules.RULES.index(r)] == -1 for r in k) / len(k) + 0.002 for k in kinds]
        p.append([x / sum(raw) for x in raw])
    for _ in range(quality_rules._ROUNDS):
        fresh = [[0.0] * n for _ in range(c)]
        for k in range(c):
            for r in range(n):
                good = sum(q[k] for q, v in zip(p, vote) if v[r] == 1)
                said = sum(q[k] for q, v in zip(p, vote) if v[r] != 0)
                fresh[k][r] = min(max((good + hope[k][r]) / (said + 1), 1e-4), 1 - 1e-4)
        share = [(sum(q[k] for q in p) + 1) / (len(vote) + c) for k in range(c)]
        moved = max(abs(fresh[k][r] - accuracy[k][r]) for k in range(c) for r in range(n))
        accuracy, p = fresh, []
        for v in vote:
            odds = [share[k] * np.prod([accuracy[k][r] if x == 1 else 1 - accuracy[k][r] if x == -1 else 1.0 for r, x in enumerate(v)]) for k in range(c)]
            p.append([o / sum(odds) for o in odds])
        if moved < quality_rules._TOLERANCE:
            break
    got = {r["doc_id"]: (r["p_quality"], r["keep"]) for r in quality_rules.quality(local).collect()}
    assert all(abs(got[i][0] - q[0]) < 1e-9 and got[i][1] == (q[0] >= quality_rules.KEEP) for i, q in zip(ids, p)) and len(got) == len(ids)


def test_quality_classifier_against_enumeration(spark, docs):
    """The query's result for texts of few lines: every labelling of the lines, weighed by its score."""
    labels_ = spark.read.parquet(f"{SMALL}/labels.parquet")
    weight, pair = quality_crf.train(docs, labels_)
    got = {r["doc_id"]: r["quality"] for r in quality_crf.classify(docs, labels_).collect()}
    seen = 0
    for r in docs.collect():
        x, ptr, length = quality_crf.line_features(pa.array([r["text"]]))
        if not 0 < len(x) <= 8:
            continue
        unary, total, mass = x @ weight, 0.0, np.zeros(len(x))
        for y in itertools.product((0, 1), repeat=len(x)):
            w = np.exp(sum(u for u, v in zip(unary, y) if v) + sum(pair[a, b] for a, b in zip(y, y[1:])))
            total, mass = total + w, mass + w * np.array(y)
        assert abs(got[r["doc_id"]] - (mass / total * length).sum() / max(length.sum(), 1)) < 1e-6
        seen += 1
    assert seen > 50


def test_repeated_labels_have_a_winner(spark):
    docs = spark.createDataFrame([(i, f"line {i}\n" * (1 + i % 3)) for i in range(20)] + [(3, "another text")], "doc_id long, text string")
    once = [(i, i % 2, i % 2) for i in range(20)]
    schema = "doc_id long, quality int, toxic int"
    for more in ([(5, 0, 1), (5, 1, 1)], [(5, 1, 1), (5, 0, 1)]):
        low = spark.createDataFrame([x for x in once if x[0] != 5] + [(5, 0, 1)], schema)
        many = spark.createDataFrame(once + more, schema)
        assert rows(quality_crf.classify(docs, many)) == rows(quality_crf.classify(docs, low))
        assert rows(toxicity.score(docs, many)) == rows(toxicity.score(docs, low))


def test_crf_marginals_against_enumeration():
    rng = np.random.default_rng(3)
    unary, pair, ptr = rng.normal(size=6), rng.normal(size=(2, 2)), np.array([0, 4, 4, 6])
    good, _, _ = crf.forward_backward(unary, ptr, pair)
    for lo, hi in zip(ptr[:-1], ptr[1:]):
        total, each = 0.0, np.zeros(hi - lo)
        for y in itertools.product((0, 1), repeat=int(hi - lo)):
            w = np.exp(sum(unary[lo + i] for i in range(hi - lo) if y[i]) + sum(pair[a, b] for a, b in zip(y, y[1:])))
            total, each = total + w, each + w * np.array(y)
        assert np.allclose(good[lo:hi], each / total) if hi > lo else True


def test_quality_classifier_held_out(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    odd = F.xxhash64("doc_id") % 2 != 0
    got = quality_crf.classify(docs, labels.filter(odd)).join(labels.filter(~odd).withColumnRenamed("quality", "truth"), "doc_id").toPandas()
    assert (got["keep"] == (got["truth"] == 1)).mean() > 0.9


def test_grammar_scores_clauses_not_words():
    insult = tk.hash_words(["moron"])
    lexicon = toxicity.Lexicon(insult, {})

    def said(text):
        _, _, out, _, _ = toxicity.matches(pa.array([text]), lexicon)
        return [toxicity.GRAMMAR.outputs[x] for x in out]

    assert "aimed insult" in said("you are a moron")
    assert said("a moron walked by") == ["insult"]
    assert said("you are not a moron") == ["denied"]
    assert set(said("she said you are a moron")) == {"quoted"}
    assert "aimed threat" in said("i will kill you")
    assert said("the frost will kill the crops") == ["threat"]
    assert said("you are kind. the frost came") == []
    for text in ('she said: "you are a moron"', "she said, you are a moron", "elle dit : \u00ab you are a moron \u00bb", 'he wrote "late, you are a moron, late"'):
        assert set(said(text)) == {"quoted"}, text
    assert "aimed insult" in said('she said "hello" and you are a moron') and "aimed insult" in said("she said so, you moron")
    assert "aimed insult" in said('she said: "you are late". you are a moron')
    assert said("you aren't a moron") == said("you aren\u2019t a moron") == said("tu n'es pas moron") == ["denied"]
    assert "aimed threat" in said("he is killing you")
    assert set(said('"you are a moron," she said')) == {"quoted"} and "aimed insult" in said('"you are a moron", late and she never said so')


def test_toxicity_against_brute_force(spark, docs):
    """Every word, break and mark of every text through the three machines one after another."""
    import re

    fixed = {w: name for name, text in toxicity._WORDS.items() for w in text.split()}
    texts = docs.select("doc_id", "text").toPandas()
    extra = ["she said: \"you are an idiot\", you moron", "you aren't stupid, you idiot", "kill. you", "I will kill you; not an idiot you scum", "dit, \u00absalope\u00bb idiot you", None, "", '"you idiot", late "you moron," he said', '"a" said "you idiot" she wrote', '"you idiot" and then later she said', 'idiot, he "said"']
    rows_ = [(int(a), b) for a, b in zip(texts["doc_id"], texts["text"])] + [(10_000 + i, t) for i, t in enumerate(extra)]

    def closed_by(tokens, at):
        """Whether the mark at a place opens a quotation that a later mark closes as an attributed one."""
        ends = [i for i in range(len(tokens)) if tokens[i] == "quote"]
        inside = False
        for e in reversed(ends):
            if e == at:
                return inside
            if inside:
                inside = False
            else:
                rest = tokens[e + 1 :]
                rest = rest[: rest.index("quote")] if "quote" in rest else rest
                inside = "report" in [x for x in rest if x != "break"][: toxicity.SCOPE]
        return inside

    def brute(text):
        text = re.sub("[\u201c\u201d\u201e\u00ab\u00bb]", '"', text or "").replace("\u2019", "'").lower()
        calm, clauses = 1.0, 0
        for sentence in re.split(r"[.!?\n]", text):
            tokens = []
            for x in re.finditer(r"[^\x00-/:-`{-\x7f]+|[,;:\"]", sentence):
                w = x.group()
                if w in ",;:":
                    tokens.append("break")
                elif w == '"':
                    tokens.append("quote")
                elif (w == "t" and sentence[: x.start()].endswith("n'")) or (w == "n" and sentence[x.end() :].startswith("'")):
                    tokens.append("negation")
                else:
                    tokens.append(fixed.get(w, "other"))
            for start in [i for i, x in enumerate(tokens) if x == "quote"]:
                # a quotation ends where a reporting verb comes within three words, with no mark between
                ahead = tokens[start + 1 :]
                ahead = ahead[: ahead.index("quote")] if "quote" in ahead else ahead
                words = [x for x in ahead if x != "break"][: toxicity.SCOPE]
                before = [i for i in range(start) if tokens[i] == "quote"]
                if "report" in words and not closed_by(tokens, start):
                    for i in range(before[-1] + 1 if before else 0, start):
                        tokens[i] = "cited" if tokens[i] in ("insult", "threat") else tokens[i]
            machines = [toxicity.negation(), toxicity.aim(), toxicity.report()]
            state, best = [m.start for m in machines], 0.0
            for x in [*tokens, "break"]:
                cost, broke = 0.0, x == "break"
                for i, m in enumerate(machines):
                    state[i], x, c = m.step(state[i], x)
                    cost += c
                if x != "none":
                    best = max(best, np.exp(-cost))
                if broke and best:
                    calm, clauses, best = calm * (1 - best), clauses + 1, 0.0
        return 1 - calm, clauses

    got = {r["doc_id"]: (r["toxicity"], r["clauses"]) for r in toxicity.score(spark.createDataFrame(rows_, "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")).collect()}
    want = {d: brute(t) for d, t in rows_}
    assert all(got[d][1] == want[d][1] and abs(got[d][0] - want[d][0]) < 1e-9 for d in want) and sum(n > 0 for _, n in want.values()) > 8


def test_composition_equals_cascade():
    a, b = toxicity.negation(), toxicity.aim()
    joined = wfst.compile_tables(a.then(b), toxicity.SYMBOLS)
    for word in itertools.product(range(len(toxicity.SYMBOLS)), repeat=4):
        s, t, want = a.start, b.start, []
        for x in word:
            s, middle, cost = a.step(s, toxicity.SYMBOLS[x])
            t, out, more = b.step(t, middle)
            want.append((out, cost + more))
        got, cost = wfst.run(joined, np.array(word), np.array([0, 4]))
        assert [(joined.outputs[x], c) for x, c in zip(got, cost)] == want


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"{MIDDLE}/{t}.parquet") for t in ("documents", "labels"))
    odd = F.xxhash64("doc_id") % 2 != 0
    got = toxicity.score(docs, labels.filter(odd)).withColumnRenamed("toxic", "found").join(labels.filter(~odd), "doc_id").toPandas()
    clean = got[got["toxic"] == 0]
    assert clean["found"].mean() < 0.05
    assert got[got["toxic"] == 1]["found"].mean() > 0.5


def test_toxicity_with_few_labels(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    got = toxicity.score(docs, labels).withColumnRenamed("toxic", "found").join(labels, "doc_id").toPandas()
    assert got[got["toxic"] == 1]["found"].mean() > 0.5 and got[got["toxic"] == 0]["found"].mean() < 0.05
    texts = spark.createDataFrame([(1, "you are an idiot"), (2, "du bist ein trottel"), (3, "tu es un connard"), (4, "eres un gilipollas"), (5, "you are early")], "doc_id long, text string")
    assert {r["doc_id"] for r in toxicity.score(texts, labels.limit(0)).collect() if r["toxic"]} == {1, 2, 3, 4}


def test_toxicity_learns_by_significance():
    hits, count = np.array([5, 5, 2, 40]), np.array([5, 5, 2, 60])
    assert toxicity.significant(hits, count, 0.1).tolist() == [True, True, True, True]
    assert not toxicity.significant(hits[:3], count[:3], 0.9).any()
    assert not toxicity.significant(np.full(1000, 2), np.full(1000, 2), 0.1).any()


def test_line_dedup_against_sql(docs):
    docs = docs.select("doc_id", "text")
    got = rows(line_dedup.line_dedup(docs))
    assert got == sorted(oracle(line_dedup.SQL, documents=docs).fetchall())
    assert any(r[2] for r in got)
