"""Toxicity by a weighted finite-state grammar of clauses.

Words become symbols: insults (learned, with a strength), threats, targets, negations, reports, quotes, breaks. Small
transducers rewrite the symbols one after the other: reported speech and negation turn insults and threats into weaker
ones, a target next to a threat makes it a directed threat, a target lifts its clause. Composed they are one weighted
machine, which runs over every clause that holds an insult or a threat and gives the clause a score; a text's clause
scores, not its words, go into a logistic score.

Insults are words and beginnings of words that stand in far more toxic than clean labelled documents. A word that is
known by itself goes by its own evidence, others by their longest known beginning: so a clean word does not suffer from
the toxic ones that it begins. What the clause scores mean is learned on scores of documents by lexicons that have not
seen them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldsong.llm.common import first_of_each, share_of_each, text_batches, written
from fieldsong.llm.quality import parting

#: Labelled documents of each label that the model is fitted on, at most.
FIT_DOCS = 2000
FOLDS = 4
THRESHOLD = 0.3
#: Beginnings of words that can be insults, in characters.
STEMS = range(3, 13)
#: Entries need so many toxic documents, such evidence (likelihood ratio) and such odds; no more than so many are kept of each kind.
LEAST_DOCS, LEAST_EVIDENCE, LEAST_ODDS, ENTRIES = 3, 12.0, 2.5, 20_000
#: A beginning has to be in so many times the toxic documents of any word that it begins.
ALONE = 1.25
#: A clean word is an exception to its beginning if so many documents have it.
EXCEPTION_DOCS = 4
#: Strengths are kept to quarters.
LEVELS, STEP = 24, 0.25
#: Words whose symbol a worker keeps, and words and features counted, before it starts afresh.
TABLE_WORDS, HELD_FEATURES = 300_000, 400_000

#: The grammar's closed word lists, in English, German, French and Spanish.
TARGETS = "you your yours yourself yourselves u ur he him his she her they them their these those du dich dir dein deine deinen ihr euch eure tu te toi ton ta tes vous votre vos il elle ils elles tú ti usted ustedes vosotros él ella ellos ellas".split()
NEGATIONS = "not never no nobody neither nor cannot isn't aren't wasn't weren't don't doesn't didn't won't can't nicht kein keine keinen niemals nie ne pas jamais aucun nunca jamás ningún tampoco".split()
REPORTS = "said says say saying told tells called calls calling wrote writes claimed claims quoted quotes alleged reported sagt sagte schrieb nannte behauptet dit disait écrit appelle appelait dijo dice escribió llamó".split()
THREATS = "kill hurt destroy murder stab shoot strangle beat burn töten umbringen schlagen erschießen verbrennen tuer frapper brûler étrangler matar golpear quemar disparar".split()
TURNS = "but however although aber jedoch sondern mais cependant pero sino".split()

OTHER, BREAK, QUOTE, TARGET, NEGATION, REPORT, THREAT, INSULT = range(8)
#: What the transducers write besides: a directed threat, and what is reported or negated.
DIRECTED, SOFT_INSULT, SOFT_THREAT, NO_INSULT, NO_THREAT = range(8, 13)
CLASSES = range(13)
#: Words that a negation reaches, and what each symbol counts (an insult by its strength, a directed threat by THREAT_STRENGTH).
REACH, THREAT_STRENGTH, LIFT = 3, 3.0, 1.5
COUNTS = {INSULT: 1.0, SOFT_INSULT: 0.6, NO_INSULT: 0.4, DIRECTED: 1.0, SOFT_THREAT: 0.0, NO_THREAT: 0.0, THREAT: 0.0}
FIXED = {w: k for words, k in ((TURNS, BREAK), (TARGETS, TARGET), (NEGATIONS, NEGATION), (REPORTS, REPORT), (THREATS, THREAT)) for w in words}
SIGNS = {c: BREAK for c in ".;!?\n…"} | {c: QUOTE for c in '"“”„«»'}
TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[.;!?\n…\"“”„«»]")
FIRST_LEVEL = INSULT
#: Symbols from FIRST_LEVEL on are insults, by strength. These make a clause, which stands between breaks, worth a look.
LIVE = re.compile(b"[" + re.escape(bytes([THREAT])) + b"-" + re.escape(bytes([FIRST_LEVEL + LEVELS])) + b"]")


class Transducer(NamedTuple):
    """arcs: (state, symbol read) to (state, symbol written, weight); ends: weight of a clause that ends in a state. It starts in state 0."""

    arcs: dict[tuple[int, int], tuple[int, int, float]]
    ends: dict[int, float]


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that reads what first reads and writes what second makes of what first writes; weights multiply."""
    seats, arcs, ends = {(0, 0): 0}, {}, {}
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        here = seats[x, y]
        ends[here] = first.ends[x] * second.ends[y]
        for c in CLASSES:
            if (x, c) in first.arcs:
                to_x, middle, w = first.arcs[x, c]
                if (y, middle) in second.arcs:
                    to_y, out, v = second.arcs[y, middle]
                    if (to_x, to_y) not in seats:
                        seats[to_x, to_y] = len(seats)
                        todo.append((to_x, to_y))
                    arcs[here, c] = seats[to_x, to_y], out, w * v
    return Transducer(arcs, ends)


def reported() -> Transducer:
    """After a word of reporting, or within quotes, insults and threats are others' words. State: 1 reported, 2 quoted, 3 both."""
    arcs = {}
    for s in range(4):
        for c in CLASSES:
            to = s | 1 if c == REPORT else s ^ 2 if c == QUOTE else s
            arcs[s, c] = to, {INSULT: SOFT_INSULT, THREAT: SOFT_THREAT}.get(c, c) if s else c, 1.0
    return Transducer(arcs, dict.fromkeys(range(4), 1.0))


def negated() -> Transducer:
    """Insults and threats up to REACH words after a negation are denied. State: words that it still reaches."""
    arcs = {}
    for s in range(REACH + 1):
        for c in CLASSES:
            out = {INSULT: NO_INSULT, SOFT_INSULT: NO_INSULT, THREAT: NO_THREAT, SOFT_THREAT: NO_THREAT}.get(c, c) if s else c
            arcs[s, c] = REACH if c == NEGATION else s if c == QUOTE else max(0, s - 1), out, 1.0
    return Transducer(arcs, dict.fromkeys(range(REACH + 1), 1.0))


def targeted() -> Transducer:
    """A threat and a target in one clause are a directed threat, in either order. State: 1 target seen, 2 threat waiting; a target lifts the clause."""
    arcs = {}
    for s in range(3):
        for c in CLASSES:
            if c == TARGET:
                arcs[s, c] = 1, DIRECTED if s == 2 else TARGET, 1.0
            elif c == THREAT:
                arcs[s, c] = (1, DIRECTED, 1.0) if s == 1 else (2, OTHER, 1.0)
            else:
                arcs[s, c] = s, c, 1.0
    return Transducer(arcs, {0: 1.0, 1: LIFT, 2: 1.0})


def counted() -> Transducer:
    """One state: what each symbol counts."""
    return Transducer({(0, c): (0, c, COUNTS.get(c, 0.0)) for c in CLASSES}, {0: 1.0})


def grammar() -> Transducer:
    return compose(compose(compose(reported(), negated()), targeted()), counted())


def machine() -> tuple[list[list[tuple[int, float]]], list[float]]:
    """The grammar as a table: state and symbol (insults by strength) to state and score; and the weight of each last state."""
    rules = grammar()
    table = []
    for s in range(len(rules.ends)):
        row = []
        for symbol in range(FIRST_LEVEL + LEVELS + 1):
            to, out, w = rules.arcs[s, min(symbol, INSULT)]
            strength = (symbol - FIRST_LEVEL) * STEP if symbol >= FIRST_LEVEL else THREAT_STRENGTH if out == DIRECTED else 0.0
            row.append((to, w * strength))
        table.append(row)
    return table, [rules.ends[s] for s in range(len(rules.ends))]


TABLE, ENDS = machine()


def clause_score(symbols: bytes) -> float:
    state, total = 0, 0.0
    for c in symbols:
        state, score = TABLE[state][c]
        total += score
    return total * ENDS[state]


def live_clauses(symbols: bytes) -> Iterator[tuple[int, int, float]]:
    """First and last symbol (not included) and score of each clause that scores."""
    stop = -1
    for m in LIVE.finditer(symbols):
        if m.start() >= stop:
            start, stop = symbols.rfind(BREAK, 0, m.start()) + 1, symbols.find(BREAK, m.start())
            stop = len(symbols) if stop < 0 else stop
            if (score := clause_score(symbols[start:stop])) > 0:
                yield start, stop, score


class Lexicon:
    """The symbol of any word: a sign, a word of the closed lists, an insult by its strength, or another."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        level = lambda x: FIRST_LEVEL + int(min(LEVELS, max(0, round(x / STEP))))
        self.words = {w: level(x) if x > 0 else OTHER for w, x in words.items()} | FIXED | SIGNS
        self.stems = {w: level(x) for w, x in stems.items()}
        self.longest = max(map(len, stems), default=0)
        self.seen: dict[str, int] = {}

    def symbol(self, word: str) -> int:
        if (k := self.words.get(word)) is not None:
            return k
        for n in range(min(self.longest, len(word) - 1), STEMS[0] - 1, -1):
            if (k := self.stems.get(word[:n])) is not None:
                return k
        return OTHER

    def symbols(self, text: str) -> bytes:
        """One byte a word or sign of the text, in lower case."""
        words = TOKEN.findall(text.lower())
        if len(self.seen) > TABLE_WORDS:
            self.seen = {}
        try:
            return bytes(map(self.seen.__getitem__, words))
        except KeyError:
            for w in set(words).difference(self.seen):
                self.seen[w] = self.symbol(w)
            return bytes(map(self.seen.__getitem__, words))

    def facts(self, text: str | None) -> list[float]:
        """What the logistic score sees: clause scores in sum, the highest, matched clauses, score a hundred words, words."""
        symbols = self.symbols(text or "")
        found = [score for _, _, score in live_clauses(symbols)]
        words = len(symbols) - symbols.count(BREAK) - symbols.count(QUOTE)
        return [sum(found), max(found, default=0.0), len(found), 100 * sum(found) / max(25, words), words]


FACTS = 5


class Model(NamedTuple):
    words: dict[str, float]
    stems: dict[str, float]
    mean: np.ndarray
    spread: np.ndarray
    slopes: np.ndarray
    offset: float


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def scored(model: Model, facts: np.ndarray) -> np.ndarray:
    return sigmoid(((np.log1p(facts) - model.mean) / model.spread) @ model.slopes + model.offset)


def held_out(doc_id: Column) -> Column:
    """Whether a document is not learned from: null ids, and those whose crc32 leaves 2 on division by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def features(text: str | None) -> set[str]:
    """The words of a text, and with a star behind the proper beginnings of words."""
    words = {w for w in set(TOKEN.findall((text or "").lower())) if w not in SIGNS and w not in FIXED and len(w) <= 64}
    return words | {f"{w[:n]}*" for w in words for n in STEMS if n < len(w)}


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> tuple[DataFrame, dict[int, int]]:
    """text, label, fold of at most FIT_DOCS labelled documents of each label, the same ones each time; and how many there are in all."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(doc_id).alias("l_id"), F.col(label).cast("int").alias("label")).distinct()
    own = docs.select(F.col(doc_id).alias("d_id"), F.col(text).alias("text"))
    pool = known.where(~held_out(F.col("l_id"))).join(own.select("d_id"), F.col("l_id") == F.col("d_id"), "left_semi")
    totals = {r.label: r.n for r in pool.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = pool.where(share_of_each(F.col("label"), totals, FIT_DOCS, F.col("l_id")))  # about 2 FIT_DOCS rows a label
    drawn = first_of_each(some, "label", [F.xxhash64(F.lit(12), "l_id"), F.col("l_id")], FIT_DOCS)
    return own.join(F.broadcast(drawn), F.col("d_id") == F.col("l_id")).select("text", "label", F.pmod(F.xxhash64(F.lit(13), "l_id"), F.lit(FOLDS)).cast("int").alias("fold")), totals


def feature_counts(rows: DataFrame) -> DataFrame:
    """feature, n0 ...: how many documents of each fold and label (clean ones of all folds first) have it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], int] = {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in held], pa.string()), pa.array([k for _, k in held], pa.int32()), pa.array(list(held.values()), pa.int64())], ["feature", "cell", "n"])

        for batch in batches:
            for t, y, f in zip(batch["text"], batch["label"].to_pylist(), batch["fold"].to_pylist()):
                for x in features(t.as_py()):
                    held[x, y * FOLDS + f] = held.get((x, y * FOLDS + f), 0) + 1
                if len(held) > HELD_FEATURES:
                    yield told()
                    held = {}
        yield told()

    text_batches()
    cells = rows.mapInArrow(count, "feature string, cell int, n long")
    return cells.groupBy("feature").agg(*[F.coalesce(F.sum(F.when(F.col("cell") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(2 * FOLDS)])


def odds(toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float) -> np.ndarray:
    return np.log((toxic + 0.5) / (all_toxic + 1)) - np.log((clean + 0.5) / (all_clean + 1))


def evidence(toxic: np.ndarray, clean: np.ndarray, all_toxic: float, all_clean: float) -> np.ndarray:
    """Likelihood ratio of a feature that depends on the label against one that does not."""
    n, share = toxic + clean, all_toxic / (all_toxic + all_clean)
    part = lambda x, e: np.where(x > 0, x * np.log(np.maximum(x, 1e-9) / np.maximum(e, 1e-9)), 0)
    return 2 * (part(toxic, n * share) + part(clean, n * (1 - share)))


def lexicon(names: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their strengths, from counts (clean, toxic) and the documents of each label."""
    clean, toxic = counts.T.astype(float)
    strength = odds(toxic, clean, totals[1], totals[0])
    good = (toxic >= LEAST_DOCS) & (strength >= LEAST_ODDS) & (evidence(toxic, clean, totals[1], totals[0]) >= LEAST_EVIDENCE)
    stem = np.array([x.endswith("*") for x in names], bool)
    stems = {x[:-1]: float(s) for x, s in zip(names[good & stem], strength[good & stem])}
    # A beginning that stands for one word alone says nothing of other words.
    seen = dict(zip(names[stem], toxic[stem]))
    for w, n in zip(names[good & ~stem], toxic[good & ~stem]):
        for k in STEMS:
            if k < len(w) and seen.get(f"{w[:k]}*", 0) < ALONE * n:
                stems.pop(w[:k], None)
    # Words that their documents show to be clean, whatever they begin with; of others too little is known, they go by their beginning.
    clear = ~stem & ~good & (toxic + clean >= EXCEPTION_DOCS) & (strength < LEAST_ODDS)
    words = {x: float(s) if g else 0.0 for x, s, g, c in zip(names, strength, good & ~stem, clear) if g or c}
    return words, stems


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """A model of labels(doc_id, toxic 0 or 1) on at most FIT_DOCS documents of each label, the same ones each time.

    Documents that are held out, unlabelled or have another label are not learned from, nor are null ids. A document
    that is labelled more than once counts as several, and so does one whose doc_id is repeated. Where there are no
    documents of one label, all texts score the share of label 1, or 0.5 if nothing is labelled.
    """
    some, totals = sample(docs, labels, doc_id, text, label)
    rows = written(some)
    sizes = {(r.label, r.fold): r.n for r in rows.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    flat = Model({}, {}, np.zeros(FACTS), np.ones(FACTS), np.zeros(FACTS), 0.0)
    if len(totals) < 2:
        share = totals.get(1, 0) / sum(totals.values()) if totals else 0.5
        return flat._replace(offset=float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -30, 30)))
    per_fold = np.array([[sizes.get((y, f), 0) for y in (0, 1)] for f in range(FOLDS)])  # fold x label
    whole = per_fold.sum(axis=0)
    counts = written(feature_counts(rows))
    clean, toxic = (sum((F.col(f"n{k}") for k in range(y * FOLDS, (y + 1) * FOLDS)), F.lit(0)) for y in (0, 1))
    strong = (F.log((toxic + 0.5) / float(whole[1] + 1)) - F.log((clean + 0.5) / float(whole[0] + 1))) >= LEAST_ODDS / 2
    picked = counts.where((toxic >= LEAST_DOCS) & strong).orderBy(toxic.desc(), "feature").limit(ENTRIES)
    kept = picked.toArrow()
    # Words that stems would catch though documents show that they are clean.
    stems = picked.where(F.col("feature").endswith("*")).select(F.col("feature").alias("stem"))
    plain = counts.where(~F.col("feature").endswith("*") & (clean + toxic >= EXCEPTION_DOCS) & ~(strong & (toxic >= LEAST_DOCS)))
    cut = plain.select("*", F.explode(F.transform(F.sequence(F.lit(STEMS[0]), F.lit(STEMS[-1])), lambda n: F.concat(F.substring("feature", 1, n), F.lit("*")))).alias("stem"))
    caught = cut.join(F.broadcast(stems), "stem", "left_semi").drop("stem").distinct().orderBy((clean + toxic).desc(), "feature").limit(ENTRIES).toArrow()
    table = pa.concat_tables([kept, caught.select(kept.column_names)]).sort_by("feature")
    names = np.array(table["feature"].to_pylist(), object)
    cells = np.stack([table[f"n{k}"].to_numpy() for k in range(2 * FOLDS)], axis=1).reshape(len(names), 2, FOLDS)
    lexicons = [lexicon(names, cells.sum(axis=2) - cells[:, :, f], whole - per_fold[f]) for f in range(FOLDS)]
    sent = rows.sparkSession.sparkContext.broadcast(lexicons)

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [Lexicon(*x) for x in sent.value]
        for batch in batches:
            facts = [own[f].facts(t.as_py()) for t, f in zip(batch["text"], batch["fold"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["label"], pa.array(facts, pa.list_(pa.float64()))], ["label", "facts"])

    seen = rows.mapInArrow(unseen, "label int, facts array<double>").toArrow()
    facts = np.array(seen["facts"].to_pylist(), float).reshape(-1, FACTS)
    truth = seen["label"].to_numpy().astype(float)
    order = np.lexsort((*facts.T, truth))  # sums do not depend on the order of tasks
    facts, truth = facts[order], truth[order]
    shares = np.where(truth == 1, totals[1] / max(1, whole[1]), totals[0] / max(1, whole[0]))
    words, stems_now = lexicon(names, cells.sum(axis=2), whole)
    model = fitted(flat._replace(words=words, stems=stems_now), facts, truth, shares)
    cut_at = parting(scored(model, facts), truth, shares)
    return model._replace(offset=model.offset + float(np.log(THRESHOLD / (1 - THRESHOLD)) - np.log(cut_at / (1 - cut_at))))


def fitted(model: Model, facts: np.ndarray, truth: np.ndarray, shares: np.ndarray, rounds: int = 40, ridge: float = 0.02) -> Model:
    """Logistic regression by Newton's steps."""
    x = np.log1p(facts)
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.concatenate([(x - mean) / spread, np.ones((len(x), 1))], axis=1)
    w, weight = np.zeros(FACTS + 1), shares / shares.sum()
    keep = np.diag([ridge] * FACTS + [1e-6])
    for _ in range(rounds):
        p = sigmoid(z @ w)
        step = np.linalg.solve((z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + keep, z.T @ (weight * (p - truth)) + keep @ w)
        w = w - step / max(1.0, np.abs(step).max())
    return model._replace(mean=mean, spread=spread, slopes=w[:FACTS], offset=float(w[FACTS]))


def toxicity(model: Model, text: Column) -> Column:
    """A text column's scores, 0 to 1, higher where label 1 is likelier. Null texts are as empty ones; equal texts have equal scores.

    The model, whose size its parameters bound, is broadcast.
    """
    sent = text_batches().sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        own = Lexicon(model.words, model.stems)
        for texts in batches:
            facts = np.array([own.facts(t.as_py()) for t in texts], float).reshape(-1, FACTS)
            yield pa.array(scored(model, facts), pa.float64())

    return F.arrow_udf(score, "double")(text)


def toxic_clauses(model: Model, text: Column) -> Column:
    """array<struct<start: int, stop: int, clause: string, score: double>>: the matched clauses of a text, places in characters of its lower case form."""
    sent = text_batches().sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("clause", pa.string()), ("score", pa.float64())]))

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        own = Lexicon(model.words, model.stems)
        for texts in batches:
            out = []
            for t in texts:
                low = (t.as_py() or "").lower()
                spots = [m.span() for m in TOKEN.finditer(low)]
                hits = [(spots[a][0], spots[b - 1][1], score) for a, b, score in live_clauses(own.symbols(low))]
                out.append([{"start": a, "stop": b, "clause": low[a:b], "score": s} for a, b, s in hits])
            yield pa.array(out, kind)

    return F.arrow_udf(find, "array<struct<start: int, stop: int, clause: string, score: double>>")(text)


def classify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= 0.3) for each row of docs; other columns are not read.

    Null texts are scored as empty ones, null doc_ids are held out, repeated rows are repeated, equal texts have equal
    scores whatever their length, and an empty table gives no rows.
    """
    out = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), toxicity(model, F.col(text)).alias("score"))
    return out.withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
