"""Toxicity by a weighted finite-state grammar over clauses.

A text is lower-cased words in clauses (which end at . ! ? ; : , and line ends). The lexicon
transducer maps a word to a symbol: insult, threat, target, negation, report or other. The negation
and report transducers rewrite what stands in their scope, and the target transducer turns an insult
or threat near a target into a directed one. They are composed into one machine, which reads each
clause that holds an insult or threat and counts what it puts out; a matched clause has a weight for
each kind, and the score of a text is the logistic of their sum. So a negated or quoted insult
counts as its own kind, not as an insult.

Learned from labelled rows: insults (words, and beginnings of words, that toxic rows have and others
don't) and the weights. The rows are at most ``LABELLED`` of those given, chosen by a hash of the id;
with fewer all are used. A beginning is learned only if a likelihood ratio rules chance out.

Nulls: a null text scores as an empty one, which has the score of a text without matches. Rows with
a null id or label don't teach. Repeated rows score alike. With no labelled rows the built-in
lexicon and weights stand. Other columns are ignored; columns called score or predicted are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import byte_view, crc_mod, mix64, only, released, slices, table, written
from quarry.llm.shingles import _BASE, _INVERSE, _SYMBOLS, _power, word_hashes

LABELLED = 20_000
PREFIXES = (4, 5, 6, 7, 8)  # bytes
LEAST_RATIO = 20.0  # log likelihood ratio that an entry needs
LEAST_ODDS = 20.0

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "insult", "threat", "target", "negation", "report", "other"
LEXICON = {
    INSULT: "idiot idiots moron morons stupid dumb scum trash loser losers clown worthless pathetic disgusting fool imbecile vermin filth dummkopf trottel idiota imbécil crétin connard salaud",
    THREAT: "kill hurt destroy beat punch shoot stab töten umbringen schlagen tuer frapper matar golpear",
    TARGET: "you your yours u they them their he she him her du dich dir sie ihr euch tu toi vous te tú usted ustedes ellos",
    NEGATION: "not no never nobody isn aren wasn don doesn didn won cannot nicht kein keine nie ne pas jamais nunca jamás",
    REPORT: "said says say told called calls wrote quoted reported alleged sagte sagt nannte dit disait dijo dice llamó",
}
KINDS = ("insult", "directed insult", "threat", "directed threat", "negated", "reported")
PRIOR = np.array([-3.0, 3.0, 4.0, 0.3, 3.0, -0.5, -0.5])  # of the intercept and the kinds
MOST = 3  # matches of a kind that ``features`` counts, unless told otherwise; the model counts all
SCOPE = 4  # words


@dataclass(frozen=True)
class Transducer:
    """A sequential transducer: (state, symbol) -> (state, symbols out). A pair that isn't listed
    goes to the state that ``default`` names and puts the symbol out as it is."""

    start: object
    arcs: dict
    default: dict

    def step(self, state, symbol):
        found = self.arcs.get((state, symbol))
        return found if found is not None else (self.default.get(state, state), (symbol,))


def compose(a: Transducer, b: Transducer, symbols) -> Transducer:
    """The transducer that reads ``symbols``, runs a, and runs b on what a puts out."""
    arcs, todo, seen = {}, [(a.start, b.start)], {(a.start, b.start)}
    while todo:
        x, y = todo.pop()
        for s in symbols:
            x2, middle = a.step(x, s)
            y2, out = y, ()
            for m in middle:
                y2, o = b.step(y2, m)
                out += o
            arcs[(x, y), s] = ((x2, y2), out)
            if (x2, y2) not in seen:
                seen.add((x2, y2))
                todo.append((x2, y2))
    return Transducer((a.start, b.start), arcs, {})


def _negation() -> Transducer:
    """Of the SCOPE words behind a negation, insults and threats come out as negated."""
    arcs, default = {}, {}
    for left in range(SCOPE + 1):
        arcs[left, NEGATION] = (SCOPE, (OTHER,))
        default[left] = max(0, left - 1)
        if left:
            for s in (INSULT, THREAT):
                arcs[left, s] = (left - 1, ("negated",))
    return Transducer(0, arcs, default)


def _report() -> Transducer:
    """Behind a word of reporting, to the clause's end, insults and threats come out as reported."""
    arcs = {(s, REPORT): (1, (OTHER,)) for s in (0, 1)}
    arcs |= {(1, s): (1, ("reported",)) for s in (INSULT, THREAT)}
    return Transducer(0, arcs, {})


def _target() -> Transducer:
    """An insult or threat within SCOPE words of a target is directed. States: words left of the
    target's scope; or an insult or threat that waits for a target."""
    arcs, default = {}, {}
    for left in range(SCOPE + 1):
        state = ("free", left)
        default[state] = ("free", max(0, left - 1))
        arcs[state, TARGET] = (("free", SCOPE), (OTHER,))
        for s in (INSULT, THREAT):
            arcs[state, s] = (("free", left - 1), (f"directed {s}",)) if left else (("held", s, SCOPE), ())
    for s in (INSULT, THREAT):
        for left in range(1, SCOPE + 1):
            state = ("held", s, left)
            after = ("held", s, left - 1) if left > 1 else ("free", 0)
            for symbol in (OTHER, NEGATION, REPORT, "negated", "reported"):
                arcs[state, symbol] = (after, (symbol,) if left > 1 else (s, symbol))
            arcs[state, TARGET] = (("free", SCOPE), (f"directed {s}", OTHER))
            for again in (INSULT, THREAT):
                arcs[state, again] = (("held", again, SCOPE), (s,))
            arcs[state, "end"] = (("free", 0), (s,))
    return Transducer(("free", 0), arcs, default)


SYMBOLS = (INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, "end")
GRAMMAR = compose(compose(_report(), _negation(), SYMBOLS), _target(), SYMBOLS)


def match(clause: list[str]) -> list[str]:
    """What the grammar puts out for a clause of symbols: the kinds of its matches."""
    state, out = GRAMMAR.start, []
    for symbol in (*clause, "end"):
        state, more = GRAMMAR.step(state, symbol)
        out.extend(m for m in more if m in KINDS)
    return out


@dataclass
class Lexicon:
    """Word and beginning hashes -> symbols; beginnings stand for insults."""

    words: np.ndarray
    symbols: np.ndarray
    prefixes: dict[int, np.ndarray]

    @classmethod
    def built_in(cls, words=(), prefixes=()):
        known: dict[int, int] = {}
        for number, symbol in enumerate(SYMBOLS[:5]):
            for h in word_hashes(pa.array(LEXICON[symbol].split()))[0].tolist():
                known.setdefault(h, number)
        known |= {int(h): 0 for h in words}
        keys = np.array(sorted(known), dtype=np.uint64)
        by_length: dict[int, list] = {}
        for length, h in prefixes:
            by_length.setdefault(length, []).append(h)
        return cls(keys, np.array([known[int(k)] for k in keys]), {n: np.array(sorted(v), dtype=np.uint64) for n, v in by_length.items()})


def _isin(values: np.ndarray, sorted_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_) or not len(values):
        return np.zeros(len(values), dtype=bool), np.zeros(len(values), dtype=np.int64)
    at = np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)
    return sorted_[at] == values, at


def _prefix_hashes(column: pa.Array):
    """A function of a length: hashes of the words' first bytes, with a mask of longer words."""
    flat, _ = byte_view(pc.utf8_lower(column.cast(pa.large_string())))
    with np.errstate(over="ignore"):
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(_SYMBOLS[flat] * _power(_INVERSE, max(1, len(flat)))[: len(flat)], out=sums[1:])
    power = _power(_BASE, len(flat) + 1)

    def of(length: int, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        longer = np.flatnonzero(last - first > length)
        p = first[longer]
        with np.errstate(over="ignore"):
            return mix64((sums[p + length] - sums[p]) * power[p + length]), longer

    return of, flat


_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?;:,\n"]] = True


def features(column: pa.Array, lexicon: Lexicon, most: int | None = MOST) -> np.ndarray:
    """Matches of each kind, at most ``most`` (None: all), in each text."""
    out = np.zeros((len(column), len(KINDS)), dtype=np.int64)
    column = column.fill_null("")
    hashes, owner, first, last = word_hashes(column)
    if not len(hashes):
        return out
    symbol = np.full(len(hashes), 5)
    known, at = _isin(hashes, lexicon.words)
    symbol[known] = lexicon.symbols[at[known]]
    of, flat = _prefix_hashes(column)
    for length, table_ in lexicon.prefixes.items():
        h, longer = of(length, first, last)
        symbol[longer[_isin(h, table_)[0] & (symbol[longer] == 5)]] = 0
    ends = np.concatenate([[0], np.cumsum(_ENDS[flat])])
    clause = np.cumsum((np.diff(ends[first], prepend=-1) != 0) | (np.diff(owner, prepend=-1) != 0)) - 1
    hit = np.zeros(clause[-1] + 1, dtype=bool)
    hit[clause[symbol <= 1]] = True
    begin = np.flatnonzero(np.diff(clause, prepend=-1))
    for c in np.flatnonzero(hit):
        a, b = begin[c], begin[c + 1] if c + 1 < len(begin) else len(clause)
        for kind in match([SYMBOLS[s] for s in symbol[a:b]]):
            out[owner[a], KINDS.index(kind)] += 1
    return out if most is None else np.minimum(out, most)


def _terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length or 0 for a whole word, hash, text): the distinct terms of each text."""
    hashes, owner, first, last = word_hashes(column.fill_null(""))
    of, _ = _prefix_hashes(column.fill_null(""))
    parts = [(np.zeros(len(hashes), np.int64), hashes, owner)]
    for length in PREFIXES:
        h, longer = of(length, first, last)
        parts.append((np.full(len(h), length), h, owner[longer]))
    kind, h, own = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((h, kind, own))
    kind, h, own = kind[order], h[order], own[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (kind[1:] != kind[:-1]) | (own[1:] != own[:-1])
    return kind[new], h[new], own[new]


def _term_counts(texts: DataFrame, wanted: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(kind, term, n): texts that have the term; of ``wanted`` ones if given."""

    @released("quarry.llm.shingles")
    def run(batches):
        for batch in slices(batches, "text"):
            kind, h, _ = _terms(batch.column(0))
            if wanted is not None:
                keep = np.zeros(len(h), dtype=bool)
                for k, table_ in wanted.items():
                    keep |= (kind == k) & _isin(h, table_)[0]
                kind, h = kind[keep], h[keep]
            order = np.lexsort((h, kind))
            kind, h = kind[order], h[order]
            at = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (kind[1:] != kind[:-1]))) if len(h) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(kind[at]), pa.array(h[at].view(np.int64)), pa.array(np.diff(np.append(at, len(h))))], names=["kind", "term", "n"])

    return texts.select("text").mapInArrow(run, "kind long, term long, n long").groupBy("kind", "term").agg(F.sum("n").alias("n"))


def weighed(counts: np.ndarray) -> np.ndarray:
    """What the model sees of matches: one counts 1, three 2, seven 3, with no end."""
    return np.log2(1.0 + counts)


def _fit(x: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression with a normal prior around PRIOR, by Newton's steps."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w, precision = PRIOR.copy(), np.full(x.shape[1], 0.5)
    precision[0] = 0.01
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        n = toxic + clean
        gradient = x.T @ (toxic - n * p) - precision * (w - PRIOR)
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(precision), gradient)
        w = w + step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> tuple[Lexicon, np.ndarray]:
    """The lexicon and the weights, from (doc_id, text) and (doc_id, toxic). At most about ``most``
    labelled rows are read, so what is broadcast is bounded by it."""
    known = only(labels, doc_id="long", toxic="int").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = written(known, "labels")
    n = known.count()
    share = min(1.0, most / max(n, 1))
    known = known.where((F.xxhash64("doc_id").bitwiseAND(0xFFFFFF) / float(1 << 24)) < share)
    sample = written(only(docs, doc_id="long", text="string").join(F.broadcast(known), "doc_id").select("text", (F.col("toxic") > 0).alias("toxic")), "labelled")
    sizes = {r.toxic: r.n for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return Lexicon.built_in(), PRIOR
    base = n_toxic / (n_toxic + n_clean)
    least = LEAST_RATIO / -np.log(base)
    likely = _term_counts(sample.where("toxic")).where(F.col("n") >= float(max(least, 0.002 * n_toxic))).collect()
    wanted = {k: np.array(sorted({r.term for r in likely if r.kind == k}), dtype=np.int64).view(np.uint64) for k in {r.kind for r in likely}}
    wanted = {k: np.sort(v) for k, v in wanted.items()}
    elsewhere = {(r.kind, r.term): r.n for r in _term_counts(sample.where("not toxic"), wanted).collect()}
    words, prefixes = [], []
    for r in likely:
        a, b = r.n, elsewhere.get((r.kind, r.term), 0)
        ratio = a * np.log(a / (a + b) / base) + (b * np.log(b / (a + b) / (1 - base)) if b else 0.0)
        odds = ((a + 0.5) / (n_toxic + 1)) / ((b + 0.5) / (n_clean + 1))
        if ratio >= LEAST_RATIO and odds >= LEAST_ODDS:
            h = int(np.int64(r.term).view(np.uint64))
            if r.kind:
                prefixes.append((r.kind, h))
            else:
                words.append(h)
    lexicon = Lexicon.built_in(words, prefixes)

    @released("quarry.llm.shingles")
    def count(batches):
        for batch in slices(batches, "text"):
            f = features(batch.column(0), lexicon, None)
            yield pa.RecordBatch.from_arrays([pa.array(list(f), pa.list_(pa.int64())), batch.column(1)], names=["found", "toxic"])

    rows = sample.select("text", "toxic").mapInArrow(count, "found array<long>, toxic boolean").groupBy("found").agg(F.count_if("toxic").alias("a"), F.count_if(~F.col("toxic")).alias("b")).collect()
    return lexicon, _fit(weighed(np.array([r.found for r in rows], float)), np.array([r.a for r in rows], float), np.array([r.b for r in rows], float))


def score(docs: DataFrame, model: tuple[Lexicon, np.ndarray]) -> DataFrame:
    """``docs`` with score and predicted added; needs a column text."""
    lexicon, weights = model
    docs = docs.drop("score", "predicted")
    place = docs.columns.index("text")

    @released("quarry.llm.shingles")
    def run(batches):
        for batch in slices(batches, "text"):
            x = weighed(features(batch.column(place), lexicon, None))
            s = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, score double, predicted int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = learn(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    return score(rows, model).drop("text")
