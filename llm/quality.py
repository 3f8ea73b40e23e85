"""Quality rules: base statistics and tokeniser fertility (operator 1).

Each text is measured with public vocabularies of different make, word by word (a word
is encoded once per worker): characters per token, share of tokens that fall back to single bytes, and entropy of the
text's tokens. Languages and scripts differ in what is usual, so each (language, script) group has its own
rejection bands: the median of the group, and around it the larger of SPREADS median deviations and a floor. Short texts
vary more by chance, so a deviation counts by the root of n / (n + STEADY) for n tokens; of entropy, which long texts have
more of, only the lower limit holds. The bands come from all rows
that pass the base rules. Medians are read off histograms of rounded values, which are aggregated before any shuffle:
a group's histogram is bounded however many rows it has.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm.batches import NO_ID, ROW_KEYS, as_row_keys, chunks, column_bytes, cut, long_ids, with_null_ids, with_row_keys
from llm.packing import vocabulary_path
from llm.substring_dedup import _maybe_twice
from llm.vectext import BYTE_KEYS, RaggedCache, cover, distinct, owner, prefix_sums, ragged, range_hash, text_hash, unique_inverse, words_of
from llm.worker import give_back, kept_tool

LEAST_WORDS = 50
#: Percent of words in repeated three-word windows beyond which a text fails.
MOST_REPEATED = 50
#: Vocabularies by the name that their measures carry.
VOCABULARIES = {"piece": "piece_bpe_32k.model", "byte": "byte_bpe_50k.tiktoken"}
#: Median deviations that a measure may lie off its group's median, and tokens at which a deviation counts by 0.71.
SPREADS, STEADY = 5.5, 300
#: Least half-width of the bands, so that uniform groups don't reject their own variation: for characters
#: per token as a share of the median, for fallback as a share of tokens, for entropy in bits.
FLOORS = {"chars_per_token": 0.02, "fallback_share": 0.10, "token_entropy": 0.3}
#: Groups of fewer rows are held against the bands of all rows of their script.
LEAST_ROWS = 200
#: Groups whose bands are broadcast at most; beyond, rows meet their bands by a shuffle.
BROADCAST_GROUPS = 50_000
#: Words that a worker keeps encoded, by vocabulary.
CACHE_WORDS = 500_000
_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
#: Scripts by the first code points of their main blocks, in order of code points (fixed values).
SCRIPTS = [(0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x590, "hebrew"), (0x600, "arabic"), (0x900, "indic"), (0xE00, "south_east_asian"), (0x1100, "hangul"), (0x1E00, "latin"), (0x3040, "kana"), (0x4E00, "han"), (0xAC00, "hangul"), (0xD7B0, "other")]


class WordCounter:
    """Token ids of words under a SentencePiece (.model) or a tiktoken vocabulary, cached per worker. ``fallback`` tells the
    tokens that stand for one byte of a character outside ASCII, or for an unknown character."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            tool = sentencepiece.SentencePieceProcessor(model_file=path)
            self.fallback = np.array([tool.is_byte(i) or tool.is_unknown(i) for i in range(tool.vocab_size())])
            self.encode = lambda words: tool.encode(words, num_threads=1)
        else:
            import public_tokenizers
            import tiktoken

            with open(path) as lines:
                ranks = {base64.b64decode(token): int(rank) for token, rank in map(str.split, lines)}
            tool = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.fallback = np.zeros(max(ranks.values()) + 1, dtype=bool)
            self.fallback[[rank for token, rank in ranks.items() if len(token) == 1 and token >= b"\x80"]] = True
            self.encode = lambda words: [tool.encode_ordinary(f" {w}") for w in words]
        self.cache = RaggedCache(CACHE_WORDS)

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words end to end, and the number of tokens of each word."""
        distinct, example, place = unique_inverse(hashes)
        raw = data.tobytes()

        def make(new: np.ndarray) -> list[list[int]]:
            at = example[new]
            return self.encode([raw[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])

        first, count = self.cache.rows(distinct, make)
        return self.cache.flat[ragged(first[place], count[place])], count[place]


def _grouped_repeats(values: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of values that their document has more than once, and those of all but the first of each."""
    twice = _maybe_twice(values) if len(values) else np.empty(0, np.int64)
    order = twice[np.lexsort((twice, values[twice], doc[twice]))]
    same = (values[order[1:]] == values[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    many = np.zeros(len(order), dtype=bool)
    many[1:] |= same
    many[:-1] |= same
    return order[many], order[1:][same]


def _scripts(data: np.ndarray, bounds: np.ndarray) -> list[str]:
    """The script that most letters of each document belong to, by lead bytes."""
    n = len(bounds) - 1
    names = [s for _, s in SCRIPTS]
    kinds = sorted({*names, "none"})
    letter = ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
    doc = owner(bounds)
    votes = np.zeros((n, len(kinds)), np.int64)
    votes[:, kinds.index("latin")] = np.bincount(doc[letter], minlength=n)
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        padded = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.int64)
        b0, b1, b2 = padded[lead], padded[lead + 1] & 0x3F, padded[lead + 2] & 0x3F
        point = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1, np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | b1 << 6 | b2, 0x20000))
        which = np.searchsorted([p for p, _ in SCRIPTS], point, side="right") - 1
        np.add.at(votes, (doc[lead], np.array([kinds.index(s) for s in names])[which]), 1)
    votes[:, kinds.index("none")] = 0
    best = votes.argmax(axis=1)
    return [kinds[b] if v else "none" for b, v in zip(best.tolist(), votes.max(axis=1).tolist(), strict=True)]


def measure(data: np.ndarray, bounds: np.ndarray, counters: dict[str, WordCounter]) -> dict[str, np.ndarray]:
    """All measures of the documents of a chunk."""
    n = len(bounds) - 1
    starts, ends, first = words_of(data, bounds)
    sums = prefix_sums(BYTE_KEYS[data])
    hashes = text_hash(data, sums, starts, ends)
    doc = owner(first)
    n_words = np.diff(first)
    is_char = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = np.bincount(doc, is_char[ends] - is_char[starts], minlength=n).astype(np.int64)
    symbols = np.diff(np.concatenate(([0], np.cumsum(_SYMBOLS[data])))[bounds])
    # Words in three-word windows that the text has twice or more.
    word_sums = prefix_sums(hashes | np.uint64(1))
    at = np.arange(max(0, len(starts) - 2))
    at = at[doc[at] == doc[at + 2]] if len(at) else at
    many, _ = _grouped_repeats(range_hash(word_sums, at, at + 3), doc[at])
    covered = cover(len(starts), at[many], 3)
    repeat_words = np.bincount(doc[covered], minlength=n)
    # Lines with a word that equal an earlier line of the text.
    breaks = data == 0x0A
    opens = distinct(np.concatenate((bounds[:-1], np.flatnonzero(breaks) + 1)))
    opens = opens[opens < len(data)]
    line_doc = np.searchsorted(bounds, opens, side="right") - 1
    closes = np.concatenate((opens[1:], [len(data)]))
    closes = closes - (breaks[closes - 1] if len(opens) else 0)
    worded = np.searchsorted(starts, closes) > np.searchsorted(starts, opens)
    opens, closes, line_doc = opens[worded], closes[worded], line_doc[worded]
    _, again = _grouped_repeats(text_hash(data, sums, opens, closes), line_doc)
    dup_lines = np.bincount(line_doc[again], minlength=n)
    out = {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeat_words}
    for name, counter in counters.items():
        ids, per_word = counter.ids(data, starts, ends, hashes)
        token_doc = np.repeat(doc, per_word)
        tokens = np.bincount(token_doc, minlength=n)
        fallback = np.bincount(token_doc[counter.fallback[ids]], minlength=n) if len(ids) else np.zeros(n, int)
        ranked = np.sort(token_doc.astype(np.int64) << 32 | ids)
        head = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.empty(0, np.int64)
        count = np.diff(np.concatenate((head, [len(ranked)]))) if len(head) else head
        whole = np.maximum(tokens, 1)
        entropy = np.log2(whole) - np.bincount(ranked[head] >> 32, count * np.log2(np.maximum(count, 1)), minlength=n) / whole
        out |= {f"{name}_tokens": tokens, f"{name}_chars_per_token": chars / whole, f"{name}_fallback_share": fallback / whole, f"{name}_token_entropy": np.maximum(entropy, 0.0)}
    return out


def _measured(docs: DataFrame, vocabularies: dict[str, str]) -> DataFrame:
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    numbers = [*((c, "long") for c in counts), *(pair for v in vocabularies for pair in ((f"{v}_tokens", "long"), *((f"{v}_{m}", "double") for m in FLOORS)))]
    kinds = {"long": pa.int64(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = kept_tool(("words", *vocabularies.items()), lambda: {name: WordCounter(path) for name, path in vocabularies.items()})
        for batch in batches:
            data, at = column_bytes(batch.column("text"))
            for lo, hi, part, bounds in chunks(data, at, 1 << 20):
                found = measure(part, bounds, counters)
                cols = [*(batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "no_id", "mark", "lang")), pa.array(_scripts(part, bounds), pa.string())]
                cols += [pa.array(found[name], kinds[kind]) for name, kind in numbers]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "no_id", "mark", "lang", "script", *(name for name, _ in numbers)])
        give_back()

    return docs.mapInArrow(run, "doc_id long, no_id boolean, mark long, lang string, script string, " + ", ".join(f"{name} {kind}" for name, kind in numbers))


def _medians(rows: DataFrame, keys: list[str], values: dict[str, Column], suffix: str) -> DataFrame:
    """keys, n_rows and the lower median of each value to three decimals, by group."""
    listed = F.array(*[F.struct(F.lit(name).alias("name"), F.round(value, 3).alias("value")) for name, value in values.items()])
    counted = rows.select(*keys, F.explode(listed).alias("m")).groupBy(*keys, F.col("m.name").alias("name"), F.col("m.value").alias("value")).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*keys, "name")
    ranked = counted.withColumns({"below": F.sum("n").over(group.orderBy("value")), "n_rows": F.sum("n").over(group)}).where(2 * F.col("below") >= F.col("n_rows"))
    return ranked.groupBy(*keys).agg(F.max("n_rows").alias("n_rows"), *[F.min(F.when(F.col("name") == name, F.col("value"))).alias(f"{name}{suffix}") for name in values])


def _with_bands(rows: DataFrame, bands: DataFrame, keys: list[str]) -> DataFrame:
    """rows with their group's bands; broadcast only if the groups are few."""
    return rows.join(F.broadcast(bands) if bands.count() <= BROADCAST_GROUPS else bands, keys, "left")


def _bands(rows: DataFrame, keys: list[str], measures: dict[str, str], name: str) -> DataFrame:
    """Median and median deviation of each measure (with its column of token numbers), by group."""
    medians = cut(_medians(rows, keys, {m: F.col(m) for m in measures}, "_mid"), f"medians-{name}")
    met = _with_bands(rows, medians.drop("n_rows"), keys)
    spreads = _medians(met, keys, {m: _deviation(m, tokens, F.col(f"{m}_mid")) for m, tokens in measures.items()}, "_dev").drop("n_rows")
    return cut(medians.join(spreads, keys), f"bands-{name}")


def _deviation(measure: str, tokens: str, middle: Column) -> Column:
    return F.abs(F.col(measure) - middle) * F.sqrt(F.col(tokens) / (F.col(tokens) + F.lit(STEADY)))


def _judged(docs: DataFrame, vocabularies: dict[str, str] | None, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, list[str]]:
    """Every row's measures and verdict, with ``mark``, a hash of the text; and the names of the vocabularies' columns."""
    vocabularies = vocabularies or {name: vocabulary_path(file) for name, file in VOCABULARIES.items()}
    measures = {f"{v}_{m}": f"{v}_tokens" for v in vocabularies for m in FLOORS}
    lang = F.coalesce(docs[lang_col].cast("string"), F.lit("")) if lang_col in docs.columns else F.lit("")
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    own_id = long_ids(docs, id_col)
    own = docs.select(F.coalesce(own_id, F.lit(NO_ID)).alias("doc_id"), own_id.isNull().alias("no_id"), text.alias("text"), F.xxhash64(text).alias("mark"), lang.alias("lang"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    rows = cut(_measured(own, vocabularies).withColumn("base_failed", failed), "fertility")
    usable = rows.where("NOT base_failed")
    bands = _bands(usable, ["lang", "script"], measures, "languages")
    wider = _bands(usable, ["script"], measures, "scripts")
    wider = wider.select("script", *[F.col(c).alias(f"wide_{c}") for c in wider.columns if c != "script"])
    joined = _with_bands(_with_bands(rows, bands, ["lang", "script"]), wider, ["script"])
    enough = F.coalesce(F.col("n_rows") >= LEAST_ROWS, F.lit(False))
    inside = F.lit(True)
    for name, tokens in measures.items():
        mid, dev = (F.when(enough, F.col(f"{name}_{c}")).otherwise(F.col(f"wide_{name}_{c}")) for c in ("mid", "dev"))
        floor = next(f for m, f in FLOORS.items() if name.endswith(m))
        least = F.lit(floor) * mid if name.endswith("chars_per_token") else F.lit(floor)
        within = _deviation(name, tokens, mid) <= F.greatest(F.lit(SPREADS) * dev, least)
        # Entropy grows with length, so that only too little of it tells something.
        inside = inside & ((within | (F.col(name) > mid)) if name.endswith("token_entropy") else within)
    columns = [c for v in vocabularies for c in (f"{v}_tokens", *(f"{v}_{m}" for m in FLOORS))]
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(False))), columns


def quality_rules(docs: DataFrame, vocabularies: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Base statistics, fertility measures and verdict of every row.

    doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, script, and for each vocabulary
    (name: path) its tokens, chars_per_token, fallback_share and token_entropy. kept is false if base_failed (fewer than
    LEAST_WORDS words, or more than MOST_REPEATED % of words in repeated three-word windows) or if a measure lies outside
    the band of the row's (language, script), or of its script where that group has fewer than LEAST_ROWS rows. Defined
    cases: a null or empty text has no words, measures 0, and fails; a null or missing language is a language of its own;
    null ids come back as null; repeated rows are judged each; an empty table gives an empty result. Other columns are ignored.
    """
    out, columns = _judged(docs, vocabularies, id_col, text_col, lang_col)
    return with_null_ids(out).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "script", *columns)


def passing(docs: DataFrame, vocabularies: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns.

    Defined cases: as in quality_rules; null and empty texts go; repeated rows stay or go together unless their languages
    differ, in which case all stay if one does; an empty table stays empty.
    """
    kept = as_row_keys(_judged(docs, vocabularies, id_col, text_col, lang_col)[0].where("kept"))
    return with_row_keys(docs, id_col, text_col).join(kept, ROW_KEYS, "left_semi").select(*docs.columns)
