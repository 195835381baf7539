"""Toxicity by a weighted finite-state grammar of clauses."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import lgamma, log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import textkernel as tk
from tidemark.llm import wfst
from tidemark.runtime import ship, table

TRAIN_DOCS = 10_000  # labelled documents from which insults and weights are learned, at most
LEAST_SHARE = 0.97  # of a learned insult: toxic documents among all that have it
CHANCE = 0.05  # most words or stems of as many texts expected to be as toxic if labels fell at random
STEMS = (4, 5, 6, 7)  # bytes of word beginnings that may be insults
SCOPE = 3  # words that negation and targets reach
TOXIC = 0.5

SYMBOLS = ["other", "insult", "threat", "target", "negation", "report", "break", "quote", "cited"]
_WORDS = {
    "insult": "idiot idiots moron morons loser losers scum stupid imbecile imbeciles pathetic worthless disgusting dumbass asshole bastard bitch retard dimwit idiotin idioten dummkopf trottel vollidiot arschloch schlampe abschaum versager depp wichser hurensohn connard connasse salaud salope imbécile imbéciles crétin crétine abruti abrutie ordure idiote idiota idiotas imbécil estúpido estúpida gilipollas cabrón pendejo escoria",
    "threat": "kill killing hurt hurting destroy destroying murder murdering stab stabbing shoot shooting beat beating strangle töten töte umbringen schlagen schlage vernichten vernichte tuer tuerai frapper frapperai détruire détruirai buter matar mataré golpear golpearé destruir destruiré herir",
    "target": "you your yours yourself u du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre tú ti tus vosotros usted ustedes vuestro",
    "negation": "not never no without cannot nicht kein keine niemals nie ne jamais sans aucun nunca jamás sin tampoco ningún",
    "report": "said says saying say wrote writes quoted quotes called claimed claims reported reports replied shouted allegedly sagte sagt schrieb schreibt behauptete zitierte rief angeblich dit écrit prétend cria répondit selon dijo dice escribió gritó según afirmó",
}
#: Probabilities that the arcs of the grammar multiply along a path, before labels say more.
_ARC = {"match": 0.95, "unaimed insult": 0.74, "unaimed threat": 0.1, "denied": 0.2, "quoted": 0.3}
_COST = {k: -log(v) for k, v in _ARC.items()}
_PRIOR_DOCS = 5
_MATCHED = ("insult", "aimed insult", "threat", "aimed threat", "denied", "cited")


def negation() -> wfst.Transducer:
    """Insults and threats within SCOPE words of the clause after a negation come out denied."""

    def step(left: int, x: str) -> tuple[int, str, float]:
        if x == "negation":
            return SCOPE, x, 0.0
        if x == "break":
            return 0, x, 0.0
        denied = bool(left) and x in ("insult", "threat")
        return max(left - (x != "quote"), 0), "denied" if denied else x, _COST["denied"] if denied else 0.0

    return wfst.Transducer(0, step)


def aim() -> wfst.Transducer:
    """An insult near a target of its clause, or a threat before one, comes out aimed; where the
    target comes second, it is the target that does."""

    def step(state: tuple[int, int, int], x: str) -> tuple[tuple[int, int, int], str, float]:
        if x == "break":
            return (0, 0, 0), x, 0.0
        if x == "quote":
            return state, x, 0.0
        target, insult, threat = state
        calm = (max(target - 1, 0), max(insult - 1, 0), max(threat - 1, 0))
        if x == "target":
            out = "aimed threat" if threat else "aimed insult" if insult else "other"
            return (SCOPE, 0, 0), out, _COST["match"] if out != "other" else 0.0
        if x == "insult":
            aimed = "aimed insult" if target else "insult"
            return (calm[0], 0 if target else SCOPE, calm[2]), aimed, _COST["match"] + (0.0 if target else _COST["unaimed insult"])
        if x == "threat":
            return (calm[0], calm[1], SCOPE), "threat", _COST["match"] + _COST["unaimed threat"]
        return calm, x, _COST["match"] if x in ("denied", "cited") else 0.0

    return wfst.Transducer((0, 0, 0), step)


def report() -> wfst.Transducer:
    """Matches after a verb of reporting come out quoted: to the end of the clause, to the end of
    the next one if the verb ends its own ("she said: ..."), and to the closing mark if a quotation
    opens. State: (0 none, 1 just after the verb, 2 later; whether a reported quotation is open)."""

    def step(state: tuple[int, bool], x: str) -> tuple[tuple[int, bool], str, float]:
        said, opened = state
        if x == "report":
            return (1, opened), "none", 0.0
        if x == "quote":
            return ((0, False) if opened else (2, True) if said else (0, False)), "none", 0.0
        if x == "break":
            # "said:" reaches over its break, as does a quotation that opens right after it
            return (1 if said == 1 else 0, opened), "none", 0.0
        quoting = opened or said > 0 or x == "cited"
        to = (2 if said else 0, opened)
        if x in _MATCHED:
            return to, "quoted" if quoting else x, _COST["quoted"] if quoting else 0.0
        return to, "none", 0.0

    return wfst.Transducer((0, False), step)


def attribution() -> wfst.Transducer:
    """Reads a sentence backwards: insults and threats in a quotation that a verb of reporting follows
    within SCOPE words ("...", she said) come out cited."""

    def step(state: tuple[int, bool], x: str) -> tuple[tuple[int, bool], str, float]:
        left, inside = state
        if x == "report" and not inside:
            return (SCOPE, False), "none", 0.0
        if x == "quote":
            return (0, not inside and left > 0), "none", 0.0
        left = left if x == "break" else max(left - 1, 0)
        return (left, inside), "cited" if inside and x in ("insult", "threat") else "none", 0.0

    return wfst.Transducer((0, False), step)


ATTRIBUTION = wfst.compile_tables(attribution(), SYMBOLS)
GRAMMAR = wfst.compile_tables(negation().then(aim()).then(report()), SYMBOLS)
_BREAK, _QUOTE, _CITED = (SYMBOLS.index(x) for x in ("break", "quote", "cited"))


class Lexicon:
    """Symbol of each word: fixed words of the grammar, learned insults and learned stems."""

    def __init__(self, insults: np.ndarray, stems: dict[int, np.ndarray]):
        pairs = [(h, SYMBOLS.index(name)) for name, text in _WORDS.items() for h in tk.hash_words(text.split())]
        pairs += [(h, 1) for h in insults]
        pairs.sort(key=lambda x: (x[0], x[1] != 1))
        self.hashes = np.array([h for h, _ in pairs], np.uint64)
        self.codes = np.array([c for _, c in pairs], np.int64)
        self.mask = np.zeros(1 << 20, bool)
        self.mask[self.hashes >> np.uint64(44)] = True
        self.stems = {n: np.sort(h) for n, h in stems.items() if len(h)}

    def symbols(self, words: tk.Words) -> np.ndarray:
        out = np.zeros(len(words.hash), np.int64)
        maybe = np.flatnonzero(self.mask[words.hash >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.hashes, words.hash[maybe]), len(self.hashes) - 1)
        hit = self.hashes[at] == words.hash[maybe]
        out[maybe[hit]] = self.codes[at[hit]]
        for size, known in self.stems.items():
            prefix, where = begins(words, size)
            at = np.minimum(np.searchsorted(known, prefix), len(known) - 1)
            where = where[known[at] == prefix]
            out[where[out[where] == 0]] = 1
        # contractions fall into words at the apostrophe: n't and n' deny
        data, start, end = words.data, words.start, words.end
        single = np.flatnonzero(end - start == 1)
        t = single[(data[start[single]] == ord("t")) & (start[single] > 1)]
        out[t[(data[start[t] - 1] == ord("'")) & (data[start[t] - 2] == ord("n"))]] = SYMBOLS.index("negation")
        n = single[(data[start[single]] == ord("n")) & (end[single] < len(data))]
        out[n[data[end[n]] == ord("'")]] = SYMBOLS.index("negation")
        return out


def begins(words: tk.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `size` (at most 8) bytes of the words that have so many, as numbers; their places."""
    where = np.flatnonzero(words.end - words.start >= size)
    start = words.start[where]
    value = np.zeros(len(where), np.uint64)
    for i in range(size):
        value = value << np.uint64(8) | words.data[start + i].astype(np.uint64)
    return value, where


def sentences(words: tk.Words) -> np.ndarray:
    """Starts of the sentences among the words: a text begins one, and so does a word after
    punctuation that ends a sentence, or after a line's end."""
    total = np.zeros(len(words.data) + 1, np.int64)
    np.cumsum(np.isin(words.data, np.frombuffer(b".!?\n", np.uint8)), out=total[1:])
    fresh = np.ones(len(words.start), bool)
    fresh[1:] = total[words.start[1:]] > total[words.end[:-1]]
    fresh[words.ptr[:-1][np.diff(words.ptr) > 0]] = True
    return np.flatnonzero(fresh)


def plain_marks(col: pa.Array) -> pa.Array:
    """Typographic quotation marks and apostrophes as ASCII ones, so that they aren't parts of words."""
    return pc.replace_substring_regex(pc.replace_substring_regex(col, "[\u201c\u201d\u201e\u00ab\u00bb]", '"'), "\u2019", "'")


def matches(col: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, clause, output of the grammar, probability by its arcs) for each match, and the number
    of rows. The grammar reads sentences: their words, the breaks between clauses and quotation
    marks. Only sentences with an insult or a threat are run."""
    words = tk.Words(plain_marks(col))
    symbol = lexicon.symbols(words)
    rows = len(words.ptr) - 1
    start = sentences(words)
    trigger = np.flatnonzero((symbol == 1) | (symbol == 2))
    active = np.unique(np.searchsorted(start, trigger, "right") - 1)
    first = start[active]
    size = np.append(start, len(symbol))[active + 1] - first
    at = tk.ranges(first, size)
    # marks between the sentence's words, and before its first one as far as the word before
    marks = np.flatnonzero(np.isin(words.data, np.frombuffer(b",;:\"", np.uint8)))
    lead = np.where(first > 0, words.end[first - 1], 0)
    lead = np.maximum(lead, words.off[np.searchsorted(words.ptr, first, "right") - 1])
    lo, hi = np.searchsorted(marks, lead), np.searchsorted(marks, words.start[first + size - 1] if len(first) else lead)
    mark = tk.ranges(lo, hi - lo)
    kind = np.where(words.data[marks[mark]] == ord('"'), _QUOTE, _BREAK)
    order = np.argsort(np.concatenate([words.start[at], marks[mark]]), kind="stable")
    token = np.concatenate([symbol[at], kind])[order]
    place = np.concatenate([at, np.full(len(mark), -1)])[order]
    string = np.concatenate([np.repeat(np.arange(len(first)), size), np.repeat(np.arange(len(first)), hi - lo)])[order]
    ptr = np.searchsorted(string, np.arange(len(first) + 1))
    if (token == _QUOTE).any():
        backwards = np.repeat(ptr[:-1] + ptr[1:] - 1, np.diff(ptr)) - np.arange(len(token))
        seen, _ = wfst.run(ATTRIBUTION, token[backwards], ptr)
        token[backwards[seen != ATTRIBUTION.outputs.index("none")]] = _CITED
    out, cost = wfst.run(GRAMMAR, token, ptr)
    clause = np.cumsum(token == _BREAK) + string
    found = np.flatnonzero(out != GRAMMAR.outputs.index("none"))
    return np.searchsorted(words.ptr, place[found], "right") - 1, clause[found], out[found], np.exp(-cost[found]), rows


def distinct(texts: pa.Array) -> np.ndarray:
    """A mask that leaves out texts that are near copies of earlier ones: those that share one of
    four least hashes of their words taken ten by ten (five by five, three by three in short ones)."""
    seen: set[int] = set()
    keep = []
    for part in tk.slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
        words = tk.Words(part.column("text"))
        n = np.diff(words.ptr)
        least = np.zeros((len(n), 4), np.uint64)
        for size, rows in ((10, n >= 10), (5, (n >= 5) & (n < 10)), (3, (n >= 3) & (n < 5))):
            hashes, at = words.windows(size)
            row = words.row()[at]
            for k in range(4) if rows.any() else ():
                value = np.full(len(n), np.uint64(0xFFFFFFFFFFFFFFFF))
                np.minimum.at(value, row, tk.mix(hashes ^ np.uint64(k + 1)))
                least[rows, k] = value[rows]
        for values, count in zip(least.tolist(), n.tolist()):
            fresh = count < 3 or not any(v in seen for v in values)
            seen.update(values)
            keep.append(fresh)
    return np.array(keep, bool)


def significant(hits: np.ndarray, count: np.ndarray, share: float) -> np.ndarray:
    """Features that so many toxic texts hold hardly by chance: at most CHANCE of the features in
    at least as many texts are expected to, by the union bound C(count, hits) share^hits."""
    out = np.zeros(len(hits), bool)
    if not 0 < share < 1:
        return out
    tested = len(count) - np.searchsorted(np.sort(count), count)
    for i in np.flatnonzero(hits > share * count).tolist():
        n, h = float(count[i]), float(hits[i])
        out[i] = log(tested[i]) + lgamma(n + 1) - lgamma(h + 1) - lgamma(n - h + 1) + h * log(share) <= log(CHANCE)
    return out


def learn(texts: pa.Array, toxic: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
    """Insults, insulting stems by their bytes, and the grammar's weights, from labelled texts.

    An insult is a word, or a word beginning of STEMS bytes, of whose texts LEAST_SHARE are toxic
    and that stands out by significant(). The weight of an output scales the probability by its arcs:
    the share of toxic texts among those where it is the strongest match, over what the arcs say,
    drawn towards one by _PRIOR_DOCS texts."""
    alone = distinct(texts)  # the words of a toxic text that was copied often aren't insults
    texts, toxic = texts.filter(pa.array(alone)), toxic[alone]
    kinds = (0, *STEMS)
    seen: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {k: [] for k in kinds}
    batch = pa.RecordBatch.from_arrays([texts, pa.array(np.arange(len(texts)))], ["text", "n"])
    for part in tk.slices(batch, "text"):
        words = tk.Words(part.column("text"))
        row = words.row() + part.column("n")[0].as_py()
        for k in kinds:
            value, where = (words.hash, np.arange(len(row))) if k == 0 else begins(words, k)
            r = row[where]
            order = np.lexsort((value, r))
            v, r = value[order], r[order]
            fresh = np.ones(len(v), bool)
            fresh[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
            seen[k].append((v[fresh], toxic[r[fresh]]))
    learned = {}
    for k in kinds:
        value = np.concatenate([v for v, _ in seen[k]]) if seen[k] else np.zeros(0, np.uint64)
        bad = np.concatenate([t for _, t in seen[k]]) if seen[k] else np.zeros(0)
        unique, where, count = np.unique(value, return_inverse=True, return_counts=True)
        hits = np.bincount(where, weights=bad, minlength=len(unique))
        learned[k] = unique[(hits >= LEAST_SHARE * count) & significant(hits, count, toxic.mean() if len(toxic) else 1.0)]
    stems = {k: learned[k] for k in STEMS}
    lexicon = Lexicon(learned[0], stems)
    n, hit, said = (np.zeros(len(GRAMMAR.outputs)) for _ in range(3))
    base = 0
    for part in tk.slices(batch, "text"):
        row, _, out, chance, rows = matches(part.column("text"), lexicon)
        order = np.lexsort((-chance, row))
        best = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        np.add.at(n, out[best], 1)
        np.add.at(hit, out[best], toxic[base : base + rows][row[best]])
        np.add.at(said, out[best], chance[best])
        base += rows
    usual = np.where(n > 0, said / np.maximum(n, 1), 1.0)
    return learned[0], stems, (hit / usual + _PRIOR_DOCS) / (n + _PRIOR_DOCS)


def _learn_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [b for b in batches if b.num_rows]
    if parts:
        rows = pa.Table.from_batches(parts).sort_by("doc_id").combine_chunks()
        text = rows.column("text").combine_chunks()
        insults, stems, weight = learn(text, rows.column("toxic").to_numpy())
        for size, known in {0: insults, **stems}.items():
            yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([known.tobytes()], pa.binary()), pa.array([weight.tobytes()], pa.binary())], ["size", "known", "weight"])


def _score(lexicon: Lexicon, weight: np.ndarray) -> Callable:
    def one(part: pa.RecordBatch) -> pa.RecordBatch:
        row, clause, out, chance, rows = matches(part.column("text"), lexicon)
        # a clause scores its best match; a text, the chance that one of its clauses is toxic
        value = np.minimum(chance * weight[out], 0.999999)
        order = np.lexsort((-value, clause))
        row, clause, value = row[order], clause[order], value[order]
        first = np.ones(len(row), bool)
        first[1:] = clause[1:] != clause[:-1]
        row, value = row[first], value[first]
        calm = np.bincount(row, weights=np.log1p(-value), minlength=rows)
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(1 - np.exp(calm)), pa.array(np.bincount(row, minlength=rows).astype(np.int32))], ["doc_id", "toxicity", "clauses"])

    return tk.mapper(one, "text")


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, toxicity, clauses, toxic) for every document: the probability that one of its
    clauses is toxic, how many clauses matched the grammar, and toxicity >= TOXIC.

    The grammar composes three weighted transducers over classes of words, clause breaks and
    quotation marks: negation denies insults and threats in its reach, targets aim insults and
    threats near them, and verbs of reporting quote what follows, over a colon and to the closing
    mark; another one reads backwards and finds quotations that such a verb follows. Arcs have probabilities that multiply along a path. A clause scores its strongest match.
    Insults and a factor for each output are learned from `labels` (doc_id, toxic), on TRAIN_DOCS
    labelled documents at most, drawn by a hash of doc_id; the common insults and all other words of
    the grammar are fixed. A document labelled more than once counts as toxic if any label says so;
    of several texts with one doc_id the one of the least hash is learned from.

    Null and empty texts score 0. Repeated rows and null doc_ids each give their row; texts of any
    length are read whole. Other columns are ignored; without labels the fixed insults and threats
    match; an empty table of documents gives no rows.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    drawn = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    labelled = texts.filter("text is not null").join(F.broadcast(drawn), "doc_id")
    rows = labelled.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("toxic").alias("toxic"))
    # one task learns, so that the driver never holds the texts
    learned = rows.repartition(1).mapInArrow(_learn_batches, "size int, known binary, weight binary").collect()
    known = {r["size"]: np.frombuffer(r["known"], np.uint64) for r in learned}
    weight = np.frombuffer(learned[0]["weight"]) if learned else np.ones(len(GRAMMAR.outputs))
    lexicon = Lexicon(known.pop(0, np.zeros(0, np.uint64)), known)
    return texts.mapInArrow(_score(lexicon, weight), "doc_id long, toxicity double, clauses int").withColumn("toxic", F.col("toxicity") >= TOXIC)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "labels"))
