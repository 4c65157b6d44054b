"""Text analysis as a plan: tokens with positions, stop words, stems.

Tokenizers are column expressions: a text becomes an array of terms, in which a null keeps the place of what was left
out. Stemming is the one part that needs Python: it maps the arrays of an Arrow batch through their distinct words, of
which each worker remembers the stems, so that a text is read once and no word is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions import stemmers, stopwords, tokenizers

PRE, POST, BOTH = "pre-stem", "post-stem", "both"


@dataclass(frozen=True)
class Analyzer:
    """How texts become terms.

    stop_mode: pre-stem compares words, post-stem compares stems with the list as it stands, both compares words with
    the list and stems with the stemmed list. query_stop_words are removed from queries alone. position_gaps: whether
    a removed word leaves its place empty.
    """

    tokenizer: str = "pisa"
    stemmer: str | None = None
    language: str = "english"
    stop_words: tuple[str, ...] = ()
    query_stop_words: tuple[str, ...] = ()
    stop_mode: str = PRE
    position_gaps: bool = True
    name: str | None = None
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    def __post_init__(self) -> None:
        tokenizers.choose(self.tokenizer)
        stemmers.stemmer(self.stemmer, self.language)
        if self.stop_mode not in (PRE, POST, BOTH):
            raise ValueError(f"unknown stop word mode '{self.stop_mode}', expected one of: {PRE}, {POST}, {BOTH}")

    @property
    def degraded(self) -> str | None:
        """What this analysis can't do for its language; nothing where it is complete."""
        return tokenizers.DEGRADED.get(self.tokenizer) if self.language in tokenizers.NEEDS_SEGMENTATION else None

    def to_json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> Analyzer:
        got = json.loads(text)
        return Analyzer(**got | {k: tuple(got[k]) for k in ("stop_words", "query_stop_words")})

    # --- plans

    def arrays(self, docs: DataFrame, key: str = "doc_id", text: str = "text", for_query: bool = False) -> DataFrame:
        """key, words: the terms of each text in their places; null where one was left out, unless gaps are closed."""
        words = set(self.stop_words) | (set(self.query_stop_words) if for_query else set())
        without = lambda array, listed: F.transform(array, lambda w: F.when(~w.isin(sorted(listed)), w))
        array = tokenizers.TOKENIZERS[self.tokenizer](F.col(text))
        if words and self.stop_mode in (PRE, BOTH):
            array = without(array, words)
        rows = docs.select(F.col(key).cast("bigint").alias(key), array.alias("words"))
        if self.stemmer and self.stemmer != "none":
            rows = stemmed(rows, self.stemmer, self.language)
        if words and self.stop_mode != PRE:
            rows = rows.withColumn("words", without(F.col("words"), words if self.stop_mode == POST else {self.stem(w) for w in words}))
        return rows if self.position_gaps else rows.withColumn("words", F.filter("words", F.isnotnull))

    def tokens(self, docs: DataFrame, key: str = "doc_id", text: str = "text", for_query: bool = False, lengths: bool = False) -> DataFrame:
        """key, pos, term (and dl, how many terms the text keeps): a row for each term that stays."""
        rows, own = self.arrays(docs, key, text, for_query), []
        if lengths:  # taken below the explode: once for each text
            rows, own = rows.withColumn("dl", F.size(F.filter("words", F.isnotnull)).cast("int")), ["dl"]
        return rows.select(key, *own, F.posexplode("words").alias("pos", "term")).where("term is not null").select(key, "pos", "term", *own)

    def stem(self, word: str) -> str:
        f = stemmers.stemmer(self.stemmer, self.language)
        return f(word) if f else word

    def query_terms(self, queries: DataFrame, qid: str = "qid", text: str = "text") -> DataFrame:
        """qid, term, weight: how often each term occurs in the query's text."""
        found = self.tokens(queries, qid, text, for_query=True)
        return found.groupBy(F.col(qid).alias("qid"), "term").agg(F.count("*").cast("double").alias("weight"))

    def resolve_words(self, spark: SparkSession, words: Iterable[str]) -> dict[str, list[tuple[int, str]]]:
        """For each word of a query its analysed tokens; none for a stop word. One job for all words."""
        words = sorted(set(words))
        if not words:
            return {}
        frame = spark.createDataFrame(list(enumerate(words)), "qid bigint, text string")
        out: dict[str, list[tuple[int, str]]] = {w: [] for w in words}
        for r in self.tokens(frame, "qid", "text", for_query=True).collect():
            out[words[r["qid"]]].append((r["pos"], r["term"]))
        return {w: sorted(t) for w, t in out.items()}


#: Words whose stems a worker remembers at most, and texts that are mapped at once.
REMEMBERED, TEXTS = 1_000_000, 512


def stemmed(rows: DataFrame, name: str, language: str) -> DataFrame:
    """rows (a number and an array of words) with stems for words; a stem of nothing is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, known = stemmers.stemmer(name, language), {}
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                column = part.column(1)
                coded = column.flatten().dictionary_encode()
                if len(known) > REMEMBERED:
                    known.clear()
                found = []
                for w in coded.dictionary.to_pylist():
                    if w not in known:
                        known[w] = f(w) or None
                    found.append(known[w])
                ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(found, pa.string()).take(coded.indices))], names=part.schema.names)

    key, words = rows.columns
    return rows.mapInArrow(run, f"`{key}` bigint, `{words}` array<string>")


#: Presets: what each pipeline means.
_PIPELINES = {
    "pyserini": {"stemmer": "porter", "tokenizer": "lucene-english", "family": "lucene", "at_query": False, "position_gaps": True},
    "terrier": {"stemmer": "snowball", "tokenizer": "pisa", "family": "terrier", "at_query": False, "position_gaps": False},
    "terrier-pisa": {"stemmer": "snowball", "tokenizer": "pisa", "family": "terrier", "at_query": True, "position_gaps": False},
}
#: Fixed analysis by language: tokenizer and stemmer.
_CHAINS = {lang: ("lucene-standard", lang) for lang in ("arabic", "persian", "hindi", "bengali", "telugu", "indonesian", "german", "spanish", "french", "finnish", "russian", "swedish", "thai")} | {"english": ("lucene-english", "porter"), "chinese": ("cjk", None), "japanese": ("cjk", "japanese"), "korean": ("cjk", None), "thai": ("icu", None)}


def chain(language: str, stop_words: bool | str | Iterable[str] | None = None) -> Analyzer:
    """The usual analysis of a language; languages without one raise."""
    name = tokenizers.language(language)
    if name not in _CHAINS:
        raise ValueError(f"no analyzer for {name}")
    tokenizer, stem = _CHAINS[name]
    has_list = name in stopwords._LISTS
    return Analyzer(tokenizer, stem, name, tuple(stopwords.resolve(stop_words, "lucene" if has_list else None, name)), name=f"{name}-analyzer")


def pipeline(
    name: str | None = None,
    *,
    stemmer: str | None = None,
    language: str = "english",
    tokenizer: str | None = None,
    stop_words: bool | str | Iterable[str] | None = None,
    query_stop_words: Iterable[str] = (),
    stop_mode: str | None = None,
    position_gaps: bool | None = None,
) -> Analyzer | None:
    """A preset with what is given put in its place; without a preset and a stemmer there is no analysis at all."""
    full = tokenizers.language(language)
    if name is None:
        if stemmer is None:
            return None
        words = stopwords.resolve(stop_words, None, full)
        named = stop_words is None or isinstance(stop_words, bool | str)
        return Analyzer(tokenizers.choose(tokenizer, full), stemmer, full, tuple(words), tuple(query_stop_words), stop_mode or (PRE if named else BOTH), True if position_gaps is None else position_gaps)
    if name not in _PIPELINES:
        raise ValueError(f"unknown pipeline '{name}', expected one of: {', '.join(_PIPELINES)}")
    preset = _PIPELINES[name]
    words = tuple(stopwords.resolve(stop_words, preset["family"], full))
    at_query = tuple(query_stop_words) + (words if preset["at_query"] else ())
    return Analyzer(
        tokenizers.choose(tokenizer or preset["tokenizer"], full), stemmer or preset["stemmer"], full, () if preset["at_query"] else words, at_query, stop_mode or PRE,
        preset["position_gaps"] if position_gaps is None else position_gaps, name,
    )
