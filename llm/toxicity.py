"""Toxicity scores from a lexicon trie and Levenshtein automata (operator 6).

The lexicon is learned from labelled rows outside the held-out fold: words, and
word beginnings (stems), that toxic rows have significantly more often. A text's
words are held against it exactly, by stem, and through a Levenshtein automaton
of the word intersected with the lexicon's trie, which finds terms at one edit.
Each hit is weighed by its context: a window of words around it tells whether it
stands in quotation, or is attributed to somebody by a word of reporting before it in its sentence. A logistic model on
these counts, fitted on the same labelled rows, gives the score.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.batches import ids_and_texts, keyed, with_null_ids

#: Labelled rows per class that the model is fitted on (those of smallest hash of the id).
SAMPLE = 8_000
#: Least signed root of the log-likelihood ratio for a term, and least ratio of its rates in toxic and other rows.
LEAST_Z, LEAST_RATIO = 4.0, 8.0
STEMS = (4, 5, 6)
#: Letters from which on a term is also found at one edit.
FUZZY_FROM = 5
#: Words before and behind a hit that tell quotation from abuse.
WINDOW = 6
CACHE_WORDS = 600_000
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "“”„«»‘’…—–¡¿"
_OPEN, _CLOSE = "\"“„«‘", "\"”“»’"
_EXACT, _STEM, _FUZZY = 0, 1, 2
_PLAIN, _ATTRIBUTED, _QUOTED = 0, 1, 2
#: Words of reporting, which attribute what follows in their sentence to somebody.
REPORTING = {
    "said", "says", "saying", "wrote", "writes", "called", "calls", "quoted", "quotes", "quoting", "reported", "reports", "claimed", "according", "told", "replied", "shouted",
    "sagte", "sagt", "schrieb", "nannte", "laut", "zitierte", "dit", "disait", "écrit", "selon", "cité", "dijo", "dice", "escribió", "llamó", "según", "citó",
}
_FEATURES = 10


class Lexicon:
    """Terms and stems with their trie; finds the entry that a word stands for."""

    def __init__(self, terms: list[str], stems: list[str]):
        """All terms of FUZZY_FROM letters or more make the trie."""
        self.terms, self.stems = set(terms), set(stems)
        self.trie: dict = {}
        #: These terms, and each without any one letter: a word at one edit, or the word without one letter, is here.
        self.around: set[str] = set()
        for term in [t for t in terms if len(t) >= FUZZY_FROM]:
            node = self.trie
            for c in term:
                node = node.setdefault(c, {})
            node[""] = term
            self.around.add(term)
            self.around.update([term[:i] + term[i + 1 :] for i in range(len(term))])
        self.longest = max(map(len, self.around), default=0)
        self.hits: dict[str, tuple[int, str]] = {}
        self.clean: set[str] = set()

    def near(self, word: str) -> str | None:
        """A term of FUZZY_FROM letters or more at one edit from the word: the word's Levenshtein automaton, its
        states as bits of two rows (no edit, one edit), walks the trie."""
        n = len(word)
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        final = 1 << n
        stack = [(self.trie, 1, 3)]
        while stack:
            node, none, one = stack.pop()
            for c, child in node.items():
                if c == "":
                    if one & final and child != word:
                        return child
                    continue
                mask = masks.get(c, 0)
                same = (none & mask) << 1
                edit = (one & mask) << 1 | none | none << 1 | same << 1
                if edit:
                    stack.append((child, same, edit & (final << 1) - 1))
        return None

    def look_up(self, token: str) -> tuple[int, str] | None:
        word = token.strip(_EDGE)
        if word in self.terms:
            return _EXACT, word
        for k in STEMS:
            if word[:k] in self.stems and len(word) >= k:
                return _STEM, word[:k]
        if FUZZY_FROM - 1 <= len(word) <= self.longest + 1 and (word in self.around or any([word[:i] + word[i + 1 :] in self.around for i in range(len(word))])):
            if term := self.near(word):
                return _FUZZY, term
        return None

    def found(self, tokens: list[str]) -> set[str]:
        """The distinct tokens that stand for an entry; what each token stands for is kept per worker."""
        out = set()
        for token in set(tokens) - self.clean:
            hit = self.hits.get(token) or self.look_up(token)
            if hit:
                self.hits[token] = hit
                out.add(token)
            else:
                self.clean.add(token)
        if len(self.clean) > CACHE_WORDS:
            self.clean.clear()
        return out

    def features(self, text: str) -> list[float]:
        """Log counts of hits by kind and context, and the share of plain ones among the words."""
        tokens = text.lower().split()
        found = self.found(tokens)
        if not found:
            return [0.0] * _FEATURES
        counts = [[0, 0, 0], [0, 0, 0], [0, 0, 0]]
        for i, token in enumerate(tokens):
            if token in found:
                counts[self.hits[token][0]][context(tokens, i)] += 1
        total = sum(c[_PLAIN] for c in counts)
        return [math.log1p(n) for c in counts for n in c] + [100.0 * total / len(tokens)]


def context(tokens: list[str], at: int) -> int:
    """How the context window presents the word at ``at``."""
    return _QUOTED if quoted(tokens, at) else _ATTRIBUTED if attributed(tokens, at) else _PLAIN


def attributed(tokens: list[str], at: int) -> bool:
    """Whether a word of reporting stands before the word at ``at`` in the window, with no end of a sentence between."""
    for before in tokens[max(0, at - WINDOW) : at][::-1]:
        if before[-1] in ".!?":
            return False
        if before.strip(_EDGE) in REPORTING:
            return True
    return False


def quoted(tokens: list[str], at: int) -> bool:
    """Whether the context window shows the word at ``at`` to be in quotation: its own marks, or a mark that
    opens before it in the window and one that closes behind it."""
    token = tokens[at]
    opens = token[0] in _OPEN
    closes = token.rstrip(".,;:!?")[-1:] in _CLOSE
    if not opens:
        for before in tokens[max(0, at - WINDOW) : at][::-1]:
            if before.rstrip(".,;:!?")[-1:] in _CLOSE and len(before) > 1:
                break
            if before[0] in _OPEN:
                opens = True
                break
    if not closes:
        for behind in tokens[at + 1 : at + 1 + WINDOW]:
            if behind[0] in _OPEN and len(behind) > 1:
                break
            if behind.rstrip(".,;:!?")[-1:] in _CLOSE:
                closes = True
                break
    return opens and closes


def _fold(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(5))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each class that have a word or a stem, added up per batch before the shuffle."""
    for batch in batches:
        counts = {0: Counter(), 1: Counter()}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            words = {t.strip(_EDGE) for t in set(text.lower().split())}
            words = {w for w in words if len(w) > 2}
            counts[toxic].update(words)
            counts[toxic].update({f"{w[:k]}*" for w in words for k in STEMS if len(w) > k})
        for toxic, terms in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array(list(terms), pa.string()), pa.array([toxic] * len(terms), pa.int32()), pa.array(list(terms.values()), pa.int64())], names=["term", "toxic", "n"])


def _learn_lexicon(sample: DataFrame, sizes: tuple[int, int]) -> Lexicon:
    """All entries that are strong enough. They are words of the sample, whose size bounds what reaches the driver."""
    clean, toxic = (float(max(n, 1)) for n in sizes)
    counts = sample.mapInArrow(_term_counts, "term string, toxic int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).cast("double").alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).cast("double").alias("c")
    )
    expected = (F.col("t") + F.col("c")) / (clean + toxic)
    part = lambda x, size: F.when(F.col(x) > 0, F.col(x) * F.log(F.col(x) / (expected * size))).otherwise(0.0)
    ratio = (F.col("t") + 0.5) / (toxic + 1) / ((F.col("c") + 0.5) / (clean + 1))
    strong = counts.withColumn("z", F.sqrt(F.greatest(2 * (part("t", toxic) + part("c", clean)), F.lit(0.0)))).where((ratio >= LEAST_RATIO) & (F.col("z") >= LEAST_Z))
    rows = strong.orderBy(F.desc("z"), "term").select("term").collect()
    entries = [r["term"] for r in rows]
    return Lexicon([e for e in entries if not e.endswith("*")], [e[:-1] for e in entries if e.endswith("*")])


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps; the last coefficient is the intercept."""
    x = np.column_stack((x, np.ones(len(x))))
    beta = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


#: A worker's lexicon, by name, with what it has learned about tokens so far.
_KEPT: dict[str, Lexicon] = {}


def _scored(lexicon: Lexicon, beta: np.ndarray | None):
    """Features of every text, or their score under ``beta``."""
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _KEPT:
            _KEPT.clear()
            _KEPT[name] = lexicon
        tool = _KEPT[name]
        for batch in batches:
            rows = np.array([tool.features(t.as_py()) for t in batch.column("text")]).reshape(-1, _FEATURES)
            if beta is None:
                values = pa.array(rows.tolist(), pa.list_(pa.float64()))
            else:
                values = pa.array(1 / (1 + np.exp(-np.clip(rows @ beta[:-1] + beta[-1], -30, 30))), pa.float64())
            keep = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), values], names=[*keep, "value"])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[Lexicon, np.ndarray]:
    """Lexicon and coefficients from at most SAMPLE labelled rows of each class, none of the held-out fold."""
    spark = docs.sparkSession
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (_fold() != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    picked = [r for c in (0, 1) for r in known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()]
    if not picked or len(sizes) < 2:
        return Lexicon([], []), np.append(np.zeros(_FEATURES), 30.0 if sizes.get(1) else -30.0)
    # At most 2 * SAMPLE ids: bounded by the parameter.
    chosen = F.broadcast(spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in picked], "doc_id long, toxic int"))
    sample = ids_and_texts(docs, id_col, text_col).join(chosen, "doc_id").select("text", "toxic")
    got = [sum(r["toxic"] == c for r in picked) for c in (0, 1)]
    lexicon = _learn_lexicon(sample, (got[0], got[1]))
    rows = sample.mapInArrow(_scored(lexicon, None), "toxic int, value array<double>").groupBy("toxic", "value").count().collect()
    if not rows:
        return lexicon, np.append(np.zeros(_FEATURES), -30.0)
    y = np.array([r["toxic"] for r in rows], float)
    weight = np.array([r["count"] * sizes[r["toxic"]] / got[r["toxic"]] for r in rows])
    return lexicon, _fit(np.array([r["value"] for r in rows]), y, weight)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted of every row.

    held_out: crc32 of the id as text is divisible by 5; such labels teach nothing. score (0 to 1) is higher
    the likelier label 1 is, predicted is score >= 0.5. Only texts are inputs of a score. Defined cases: a null
    or empty text has no hits and the score of such texts; a null id comes back as null, with held_out false;
    repeated rows are scored each; without labels of both classes all scores are 0 (1 if all are toxic); an
    empty table gives an empty result. Other columns are ignored.
    """
    lexicon, beta = fit_toxicity(docs, labels, id_col, text_col, label_col)
    scored = keyed(docs, id_col, text_col).mapInArrow(_scored(lexicon, beta), "doc_id long, no_id boolean, value double")
    return with_null_ids(
        scored.select("doc_id", "no_id", ((_fold() == 0) & ~F.col("no_id")).alias("held_out"), F.col("value").alias("score"), (F.col("value") >= 0.5).cast("int").alias("predicted"))
    )
