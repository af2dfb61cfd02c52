"""Toxicity by a weighted finite-state grammar over clauses.

A text is cut into clauses; each word becomes a class symbol (insult, harm,
intent, target, negation, reported speech, other).  Seven small transducers read
the same symbols, each rewriting what it recognises and passing the rest on with
a weight: negation and reported speech take insults and harm away, the insult
machine heaps insults that follow one another, the threat machine joins an
intent to the harm it announces, two target machines aim insults (a target
before) and let harm and insults strike (a target after), the last one turns
what is left into evidence.  Their composition is determinised once into one
table, and a clause is scored by the weight of its path.

No word condemns a text by itself: a lone insult stays below 0.7, harm without a
target weighs nothing.  An insult aimed at someone, an announced harm to someone
and repeated abuse, in one clause or in several different ones, cross it.

The insult lexicon is a small fixed list, plus words and stems (first letters,
whatever the ending) learned from labels.  What learned entries come to in clean
texts by chance, for each word of text, is taken off a text's evidence.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gritstone.llm.kernels import WORDS, chunks, mix64, shingle_hashes, splitmix, word_hashes
from gritstone.llm.sampling import local_rows, smallest_hashes
from gritstone.session import cut, spread

# Seed words of the grammar's classes in English, German, French and Spanish.
SEED_INSULTS = "idiot idiots moron morons stupid imbecile scum trash worthless pathetic loser losers clown disgusting dumbass bastard bitch asshole retard vermin subhuman dummkopf trottel abschaum idiota idiotas imbécil estúpido estúpida escoria connard connasse salaud crétin débile".split()
HARMS = "kill hurt shoot stab murder destroy strangle töten umbringen erschießen tuer frapper matar golpear".split()
INTENTS = "will gonna going shall want deserve should must werde werden wollen soll muss vais vas allons veux voy vas vamos quiero".split()
TARGETS = "you your you're u he she they them him her people everyone du dich dir ihr euch sie tu te toi vous ils elles tú usted ustedes ellos".split()
NEGATIONS = "not never no isn't aren't wasn't don't doesn't isnt nor nicht kein keine nie ne pas jamais nunca".split()
REPORTS = "said says wrote writes called calling quoted reported claimed told shouted shouts yelled screamed replied answered according sagte schrieb rief schrie berichtete nannte dit écrit crié déclaré dijo escribió gritó llamó".split()

OTHER, INSULT, HARM, INTENT, TARGET, NEGATION, REPORT = range(7)
SYMBOLS = 7
#: Labelled rows read for learning, and learned words and stems kept, at most.
SAMPLE_LABELS = 24_000
LEARNED = 2_000
LEAST_LOG_ODDS = 3.0
#: Letters of a stem, and the strength of one: three different words of a stem are what two plain insults are.
STEM = 5
STEM_STRENGTH = 0.52
#: Characters of a text that are in memory as words at once; a clause longer than that is read in parts.
SLICE = 1 << 20

_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;\n]+")
_END = re.compile(r"[.!?;\n\s]")
_SPAN = 4


@dataclass
class Transducer:
    """States 0..n-1; arcs[(state, symbol)] = (next state, output symbol, weight); missing arcs copy and go to default[state]."""

    arcs: dict = field(default_factory=dict)
    default: dict = field(default_factory=dict)

    def step(self, state: int, symbol: int) -> tuple[int, int, float]:
        return self.arcs.get((state, symbol)) or (self.default.get(state, 0), symbol, 0.0)


# Symbols between the transducers.
BLUNT, HEAPED, AIMED, THREAT, STRUCK, MENACE, DENIED, QUOTED = range(7, 15)
#: Evidence of what is left at the end, added over a clause.
EVIDENCE = {BLUNT: 0.8, HEAPED: 1.0, AIMED: 1.5, STRUCK: 0.9, MENACE: 2.5, DENIED: 0.1, QUOTED: 0.1}


def negation() -> Transducer:
    """Within _SPAN words after a negation an insult or harm is denied."""
    t = Transducer()
    for s in range(_SPAN):
        t.arcs[s, NEGATION] = (_SPAN - 1, NEGATION, 0.0)
        t.default[s] = max(0, s - 1)
        if s:
            t.arcs[s, INSULT] = t.arcs[s, HARM] = (s - 1, DENIED, 0.0)
    return t


def reported() -> Transducer:
    """After a reporting word, the rest of the clause is quoted."""
    t = Transducer(default={0: 0, 1: 1})
    t.arcs[0, REPORT] = t.arcs[1, REPORT] = (1, REPORT, 0.0)
    t.arcs[1, INSULT] = t.arcs[1, HARM] = t.arcs[1, DENIED] = (1, QUOTED, 0.0)
    return t


def insult() -> Transducer:
    """An insult is blunt, and heaped within _SPAN words after another one."""
    t = Transducer()
    for s in range(_SPAN + 1):
        t.default[s] = max(0, s - 1)
        t.arcs[s, INSULT] = (_SPAN, HEAPED if s else BLUNT, 0.0)
    return t


def threat() -> Transducer:
    """Harm within _SPAN words after an intent is a threat."""
    t = Transducer()
    for s in range(_SPAN + 1):
        t.default[s] = max(0, s - 1)
        t.arcs[s, INTENT] = (_SPAN, INTENT, 0.0)
        if s:
            t.arcs[s, HARM] = (s - 1, THREAT, 0.0)
    return t


def aim() -> Transducer:
    """An insult within _SPAN words after a target is aimed at it."""
    t = Transducer()
    for s in range(_SPAN + 1):
        t.arcs[s, TARGET] = (_SPAN, TARGET, 0.0)
        t.default[s] = max(0, s - 1)
        if s:
            t.arcs[s, BLUNT] = t.arcs[s, HEAPED] = (s - 1, AIMED, 0.0)
    return t


def strike() -> Transducer:
    """A target within two words after harm, a threat or a blunt insult is struck by it; a threat becomes a menace."""
    t = Transducer(default={0: 0, 1: 0, 2: 1, 3: 0, 4: 3})
    for s in range(5):
        t.arcs[s, HARM] = (2, OTHER, 0.0)
        t.arcs[s, THREAT] = (4, OTHER, 0.0)
        t.arcs[s, BLUNT] = (1, BLUNT, 0.0)
        if s:
            t.arcs[s, TARGET] = (0, STRUCK if s < 3 else MENACE, 0.0)
    return t


def weigh() -> Transducer:
    """The last one turns symbols into evidence."""
    return Transducer(arcs={(0, k): (0, k, w) for k, w in EVIDENCE.items()})


#: The machines in their order; those of CONTEXT look at the words around an insult or harm.
MACHINES = (negation, reported, insult, threat, aim, strike, weigh)
CONTEXT = (negation, reported, aim, strike)


def compose(machines: list[Transducer], symbols: range = range(SYMBOLS)) -> tuple[np.ndarray, np.ndarray]:
    """(next state, weight) tables of the machines run one into the next, reachable states only."""
    states = {(0,) * len(machines): 0}
    todo, rows = [(0,) * len(machines)], []
    for state in todo:
        row = []
        for symbol in symbols:
            out, total, after = symbol, 0.0, []
            for machine, s in zip(machines, state, strict=True):
                s, out, w = machine.step(s, out)
                after.append(s)
                total += w
            key = tuple(after)
            if key not in states:
                states[key] = len(states)
                todo.append(key)
            row.append((states[key], total))
        rows.append(row)
    return np.array([[c[0] for c in r] for r in rows]), np.array([[c[1] for c in r] for r in rows])


def grammar(machines=MACHINES) -> tuple[list[list[int]], list[list[float]]]:
    after, weight = compose([m() for m in machines])
    return after.tolist(), weight.tolist()


def base_classes() -> dict[str, int]:
    return {w: c for c, ws in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (INTENT, INTENTS), (HARM, HARMS), (INSULT, SEED_INSULTS)) for w in ws}


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """text in parts of at most size characters, cut behind the last clause end or blank of each."""
    at = 0
    while len(text) - at > size:
        ends = [m.end() for m in _END.finditer(text, at + size - size // 8, at + size)]
        stop = ends[-1] if ends else at + size
        yield text[at:stop]
        at = stop
    yield text[at:]


@dataclass
class Model:
    """classes maps a lower-case word to its symbol; words and stems are the learned insults with their strength, which
    scales their evidence; background is the evidence that a word of clean text carries by chance."""

    classes: dict[str, int]
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    background: float = 0.0
    machines: tuple = MACHINES

    def __post_init__(self) -> None:
        self.after, self.weight = grammar(self.machines)
        self.hot = frozenset(w for w, c in self.classes.items() if c in (INSULT, HARM)) | frozenset(self.words)

    def symbol(self, word: str) -> tuple[int, float]:
        """The word's class and strength; a class of the fixed lists goes before what was learned."""
        if word in self.classes:
            return self.classes[word], 1.0
        if word in self.words:
            return INSULT, self.words[word]
        strength = self.stems.get(word[:STEM]) if len(word) > STEM else None
        return (OTHER, 1.0) if strength is None else (INSULT, strength)

    def clauses(self, text: str) -> tuple[list[float], int]:
        """(evidence of each different clause that carries some, words of the text)."""
        found: dict[tuple[str, ...], float] = {}
        lone: dict[str, float] = {}
        total = 0
        for part in slices(text.lower()):
            words = _TOKEN.findall(part)
            total += len(words)
            if self.hot.isdisjoint(words) and (not self.stems or self.stems.keys().isdisjoint({w[:STEM] for w in words})):
                continue
            clause: list[str] = []
            for word in [*words, "."]:
                if word[0].isalpha():
                    clause.append(word)
                elif clause:
                    if not self.hot.isdisjoint(clause) or not self.stems.keys().isdisjoint({w[:STEM] for w in clause}):
                        key = tuple(clause)
                        if key not in found:
                            found[key] = self.path(clause)
                            # A lone word of the fixed list that is aimed at nobody tells once in a text, in whatever clauses it stands.
                            told = [w for w in clause if self.symbol(w)[0] == INSULT]
                            if len(told) == 1 and self.classes.get(told[0]) == INSULT and found[key] <= EVIDENCE[BLUNT]:
                                found[key], lone[told[0]] = 0.0, max(found[key], lone.get(told[0], 0.0))
                    clause = []
        return [w for w in (*found.values(), *lone.values()) if w > 0], total

    def path(self, clause: list[str]) -> float:
        state, total = 0, 0.0
        told = set()
        for word in clause:
            symbol, strength = self.symbol(word)
            # A learned word tells once in a clause: junk lines repeat one word.
            if strength != 1.0:
                symbol = OTHER if word in told else symbol
                told.add(word)
            total += self.weight[state][symbol] * strength
            state = self.after[state][symbol]
        return total

    def evidence(self, text: str) -> tuple[float, int]:
        """(what its clauses carry less what so many words carry by chance, number of clauses that carry some)."""
        found, words = self.clauses(text)
        return max(0.0, sum(found) - self.background * words), len(found)

    def score(self, text: str) -> float:
        """1 - exp(-evidence): 0 without a matched clause, below 1 always."""
        return 1.0 - math.exp(-self.evidence(text)[0])


def _words(text: str) -> tuple[set[str], int]:
    """(different words of two letters and more, all words)."""
    found: set[str] = set()
    total = 0
    for part in slices(text.lower()):
        words = _TOKEN.findall(part)
        total += len(words)
        found.update(w for w in words if len(w) > 1 and w[0].isalpha())
    return found, total


#: Bands of minima that find a text's near copies among the sample, and minima of a band.
_BANDS, _ROWS = 6, 3


def _family_keys(texts: list[bytes]) -> list[list[int]]:
    """_BANDS keys of each text; near copies share one, unlike texts hardly ever do."""
    seeds = splitmix(6_007, _BANDS * _ROWS)
    out: list[list[int]] = []
    for i, j in chunks(texts):
        shingles, bounds = shingle_hashes(*word_hashes(texts[i:j], WORDS), 3)
        keys = np.zeros((j - i, _BANDS), np.uint64)
        full = np.flatnonzero(np.diff(bounds) > 0)
        for k, seed in enumerate(seeds):
            if len(full):
                keys[full, k // _ROWS] = mix64(keys[full, k // _ROWS] ^ np.minimum.reduceat(mix64(shingles ^ seed), bounds[:-1][full]))
        out += keys.view(np.int64).tolist()
    return out


def _representatives(rows: pd.DataFrame) -> list:
    """One id of each family of near copies within a label."""
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    first: dict = {}
    for i, (label, keys) in enumerate(zip(rows["label"], rows["keys"], strict=True)):
        for band, key in enumerate(keys):
            a, b = find(i), find(first.setdefault((label, band, key), i))
            root[max(a, b)] = min(a, b)
    return [x for i, x in enumerate(rows["id"]) if find(i) == i]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE_LABELS) -> Model:
    """The grammar with insults learned from labelled documents.

    At most ``sample`` labelled rows are read, those with the smallest hashes of
    the id; of a repeated id's texts one counts, and so does one of each family
    of near copies within a label.  A word is learned if it is at least
    LEAST_LOG_ODDS more likely in a text of label 1 and occurs in enough of
    those; a stem, if that holds for texts with two of its words.  Neither may be
    in the fixed lists.  Null labels, ids and texts teach nothing; without labels
    the fixed lists are the model.  Other columns are not read.
    """
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    chosen = rows.groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("label"))
    limits = chosen.agg(F.count("*").alias("n")).select(F.lit(0).alias("grp"), "n", F.lit(sample).alias("most"))
    chosen = chosen.join(F.broadcast(smallest_hashes(chosen.select("id", F.lit(0).alias("grp")), limits).select("id")), "id", "left_semi")
    given = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [_words(t) for t in pdf["text"]]
            keys = _family_keys([t.encode("utf-8", "surrogatepass") for t in pdf["text"]])
            yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "keys": keys, "words": [" ".join(sorted(w)) for w, _ in found], "total": [n for _, n in found]})

    kind = dict(given.dtypes)["id"]
    seen = given.select("id", "label", "text").mapInPandas(read, f"id {kind}, label int, keys array<long>, words string, total long")
    seen = cut(seen.withColumn("row", F.monotonically_increasing_id()))
    each = seen.groupBy("id").agg(F.max("label").alias("label"), F.min(F.struct("keys", "row")).alias("t")).select(F.col("t.row").alias("id"), "label", "t.keys")
    rows = _representatives(each.orderBy("id").toPandas())
    base = base_classes()
    if not rows:
        return Model(base)
    single = seen.join(F.broadcast(local_rows(docs.sparkSession, [(int(i),) for i in rows], "row long")), "row", "left_semi").withColumn("words", F.split("words", " "))
    sizes = {r["label"]: (r["n"], r["total"]) for r in single.groupBy("label").agg(F.count("*").alias("n"), F.sum("total").alias("total")).collect()}
    (ones, _), (zeros, plain) = sizes.get(1, (0, 0)), sizes.get(0, (0, 0))
    least = max(5, math.ceil(0.003 * ones))
    one, stem = F.col("label") == 1, F.substring("word", 1, STEM)

    def likely(features: DataFrame, key: str) -> DataFrame:
        counts = features.groupBy(key).agg(F.count_if(one).alias("n1"), F.count_if(~one).alias("n0"), F.sum(F.when(~one, F.col("n")).otherwise(0)).alias("chance"))
        odds = F.log((F.col("n1") + 0.5) / (ones + 1.0)) - F.log((F.col("n0") + 0.5) / (zeros + 1.0))
        return counts.where(F.col("n1") >= least).withColumn("odds", odds)

    words = single.select("id", "label", F.explode("words").alias("word")).withColumn("n", F.lit(1))
    stems = words.where(F.char_length("word") > STEM).groupBy("id", "label", stem.alias("stem")).agg(F.count("*").alias("n"))
    order = F.desc(F.col("n1") * F.col("odds"))
    top = likely(words, "word").where(F.col("odds") >= LEAST_LOG_ODDS).orderBy(order, "word").limit(LEARNED).collect()
    heads = likely(stems.where("n > 1"), "stem").where(F.col("odds") >= LEAST_LOG_ODDS).orderBy(order, "stem").limit(LEARNED).select("stem").collect()
    learned = {r["word"]: min(1.25, max(0.85, r["odds"] / 5.0)) for r in top if r["word"] not in base}
    # A learned word of a learned stem is an insult of its own only if it is no chance neighbour of the stem's.
    found_stems = {r["stem"] for r in heads} - {w[:STEM] for w in base}
    learned = {w: s for w, s in learned.items() if w[:STEM] not in found_stems or len(w) <= STEM}
    bounded = local_rows(docs.sparkSession, [(s,) for s in sorted(found_stems)], "stem string")
    chance = stems.where(~one).join(F.broadcast(bounded), "stem", "left_semi").agg(F.sum("n")).first()[0] or 0
    by_word = sum(r["chance"] * learned[r["word"]] for r in top if r["word"] in learned)
    background = EVIDENCE[BLUNT] * (by_word + STEM_STRENGTH * chance) / max(1, plain)
    return Model(base, learned, dict.fromkeys(found_stems, STEM_STRENGTH), background)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = (), threshold: float = 0.7) -> DataFrame:
    """keep columns with score, predicted and n_clauses, one row per row of docs.

    Null and empty texts score 0.  Whole texts are read, clause by clause;
    clauses that are equal word by word count once.  Repeated and null ids, and
    equal rows, keep their rows: ids are not looked at.  Only keep and the text
    are read, so other columns may have any name; an empty table gives an empty
    result.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.classes, model.words, model.stems, model.background, model.machines))
    names = [f"k{i}" for i in range(len(keep))]
    given = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], F.col(text_col).cast("string").alias("body"))

    # Only the text goes to Python; kept columns wait on the JVM's side.
    @F.pandas_udf("score double, n_clauses int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Model(*shared.value)
        for column in batches:
            found = [model.evidence(x) if isinstance(x, str) else (0.0, 0) for x in column]
            total = np.array([e for e, _ in found], float)
            yield pd.DataFrame({"score": 1.0 - np.exp(-total), "n_clauses": np.array([n for _, n in found], np.int32)})

    out = spread(given).select(*names, run.asNondeterministic()("body").alias("r")).select(*names, "r.score", "r.n_clauses")
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_clauses")
