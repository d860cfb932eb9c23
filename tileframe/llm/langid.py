"""Language identification by compression.

Each learned language has a raw-content zstandard dictionary. A text, in lower case and
with one space for whatever is not a letter, is cut into pieces of ``PIECE_BYTES`` that are
compressed with every dictionary; the language whose sizes add up to the least is chosen. ``rejected`` marks texts whose runner-up
is within ``MIN_MARGIN`` of the best.

The dictionaries are fitted on a bounded sample of whole texts: labelled documents in the
order of a hash of the id, as long as a language's texts stay within ``SAMPLE_CHARS``
characters together (longer single texts are passed over), of the ``LANGUAGES`` languages
with the most labelled documents. The dictionaries are the only thing that goes to every
task: LANGUAGES x SAMPLE_CHARS characters at most.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is
everything where no language was learned, an empty table among them; a very long text is
judged whole, piece by piece; a null language is not learned from; equal sizes go to the
language whose dictionary holds more of the text's words, then to the first by name;
repeated ids are judged row by row, and null ids like others; other columns are ignored.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

SAMPLE_CHARS = 128_000
LANGUAGES = 256
#: Rows of a language that are looked at for the sample, by their hash.
LOOKED_AT = 2000
PIECE_BYTES = 2048
LEVEL = 9
MIN_MARGIN = 0.01
#: A byte of difference as a difference of log-probability.
BYTE_WEIGHT = 0.7
HOLDOUT = 3
UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double, margin double, rejected boolean"


def fit(labelled: DataFrame, sample_chars: int = SAMPLE_CHARS, languages: int = LANGUAGES) -> dict[str, bytes]:
    """Dictionary of each language from doc_id, text, lang."""
    usable = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    place = F.crc32(F.concat(F.lit("lid:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    # At most `languages` rows, so they are broadcast. A threshold on the hash leaves about
    # LOOKED_AT rows a language, so that no window gets a whole language.
    near = usable.withColumn("place", place).join(F.broadcast(counts), "lang").filter(F.col("place") <= F.lit(2**32) * F.lit(LOOKED_AT) / F.col("n"))
    order = ("place", "doc_id", F.xxhash64("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    few = near.withColumn("rank", rank).filter(F.col("rank") <= LOOKED_AT).select("lang", "text", "rank", F.length("text").alias("chars"))
    fits = few.filter(F.col("chars") <= sample_chars)
    upto = F.sum("chars").over(Window.partitionBy("lang").orderBy("rank"))
    chosen = fits.withColumn("upto", upto).filter(F.col("upto") <= sample_chars)
    parts: dict[str, list] = {}
    for r in chosen.select("lang", "rank", "text").collect():
        parts.setdefault(r["lang"], []).append((r["rank"], r["text"]))
    return {lang: "\n".join(letters(text) for _, text in sorted(own)).encode("utf-8", "replace") for lang, own in sorted(parts.items())}


def letters(text: str) -> str:
    """Lower case, one space for each run of what is not a letter."""
    import regex

    return regex.sub(r"\P{L}+", " ", text.lower())


class Classifier:
    """Judges texts; made once a task."""

    def __init__(self, dictionaries: dict[str, bytes]):
        import regex
        import zstandard

        self.letter = regex.compile(r"\p{L}")
        self.langs = sorted(dictionaries)
        self.content = [dictionaries[lang] for lang in self.langs]
        self.compressors = []
        for data in self.content:
            known = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            known.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(dict_data=known, level=LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False))

    def sizes(self, data: bytes) -> list[int]:
        pieces = [data[k : k + PIECE_BYTES] for k in range(0, len(data), PIECE_BYTES)]
        return [sum(len(c.compress(piece)) for piece in pieces) for c in self.compressors]

    def judge(self, text: str | None) -> tuple[str, float, float, bool]:
        if text is None or not self.langs or not self.letter.search(text):
            return UNKNOWN, 0.0, 0.0, True
        data = letters(text).encode("utf-8", "replace")
        sizes = self.sizes(data)
        best = min(sizes)
        tied = [k for k, n in enumerate(sizes) if n == best]
        if len(tied) > 1:
            words = set(data.split())
            tied.sort(key=lambda k: -sum(b" " + w + b" " in self.content[k] for w in words))
        rest = [n for k, n in enumerate(sizes) if k != tied[0]]
        margin = (min(rest) - best) / best if rest else 1.0
        score = 1 / (1 + sum(math.exp(-BYTE_WEIGHT * (n - best)) for n in rest))
        return self.langs[tied[0]], score, margin, margin < MIN_MARGIN


def classify(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """doc_id, lang_pred, score, margin, rejected of every row."""
    known = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def run(batches):
        judge = Classifier(known.value).judge
        for batch in batches:
            found = [judge(t) for t in batch.column(1).to_pylist()]
            columns = list(zip(*found, strict=True)) or [[], [], [], []]
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], ["doc_id", "lang_pred", "score", "margin", "rejected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.bare(common.table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    dictionaries = fit(docs.filter(common.crc_mod(F.col("doc_id"), HOLDOUT) != 1))
    judged = classify(docs, dictionaries)
    return judged.withColumn("held_out", common.crc_mod(F.col("doc_id"), HOLDOUT) == 1).select("doc_id", "held_out", "lang_pred", "score", "rejected")
