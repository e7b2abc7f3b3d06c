"""Quality rules: counts on whole texts, and how well public tokenisers fit each text.

Fertility is measured with two vocabularies. One with byte fallback gives characters per piece and
the share of pieces that are single fallback bytes; a byte-level one for many languages gives
characters per token and the entropy of the text's tokens in bits. Words are tokenised once for each
batch, each with the space before it, and weighted by their counts.

Rejection bands:
* by script (that of most letters): wide ones on all measures, which turn away what no ordinary prose
  shows (strings of symbols, texts of one repeated word). The least entropy is lower for texts of few
  tokens, in proportion to the logarithm of their number.
* by language: fit_bands() takes them from all rows labelled as good: least characters
  per token, and least entropy by number of tokens, each at the quantile FALSE_REJECTION.
  Junk is spelt out in more and fewer kinds of tokens than prose of its language. Languages with fewer
  than FEW such rows have the script's bands alone, as have tables without labels.

Cases: a null or unknown language, or a table without that column, leaves the script's band alone
(`en-GB` counts as `en`). Null, empty and wordless texts have zero counts and fail the base rule of too few words.
Repeated rows give repeated results. Of repeated ids among labelled rows the least measures count.
Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
PIECES, TOKENS = "piece_bpe_32k.model", "byte_bpe_multi_50k.tiktoken"

#: script: (least, most characters per piece; most fallback share; least entropy in bits)
BANDS: dict[str, tuple[float, float, float, float]] = {
    "latin": (1.1, 8.0, 0.10, 3.5),
    "cyrillic": (1.2, 8.0, 0.10, 3.5),
    "greek": (0.8, 8.0, 0.30, 3.5),
    "han": (0.3, 4.0, 0.70, 3.5),
    "other": (0.2, 8.0, 0.95, 3.0),
}
#: The least entropy of a text of n tokens is at most this share of log2(n), the most it could have.
SHARE = 0.6
#: Labelled rows that a class of length or a language must have; the share of good rows that each bound turns away.
FEW, FALSE_REJECTION = 50, 0.0025
#: Least numbers of tokens of the classes of length.
LENGTHS = (0, 64, 128, 256, 512, 1024)
#: language: (least characters per token, least entropy by class of length).
Floors = dict[str, tuple[float, tuple[float, ...]]]
#: Unicode blocks of the scripts (first, last code point).
BLOCKS = {"latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)], "greek": [(0x370, 0x3FF)], "cyrillic": [(0x400, 0x52F)], "han": [(0x3040, 0x30FF), (0x3400, 0x9FFF)]}
#: Words and tokens that a task remembers before it starts afresh.
MEMO_WORDS, MEMO_TOKENS = 200_000, 4_000_000


@lru_cache(maxsize=2)
def _models(pieces: str, tokens: str):
    import base64

    import public_tokenizers
    import sentencepiece
    import tiktoken

    with open(tokens, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return sentencepiece.SentencePieceProcessor(model_file=pieces), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Vocabulary(dict):
    """Word -> number, with characters, pieces, fallback bytes and tokens of each; a memo that is emptied when it grows too large."""

    def __init__(self, paths: tuple[str, str]):
        super().__init__()
        self.pieces, self.tokens = _models(*paths)
        self.byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.vocab_size())])
        self._reset()

    def _reset(self) -> None:
        self.clear()
        self.table, self.ids, self.ends = np.zeros((0, 4), np.int64), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def learn(self, words: list[bytes]) -> None:
        """Enter all words."""
        if len(self) > MEMO_WORDS or len(self.ids) > MEMO_TOKENS:
            self._reset()
        new = [w for w in words if w not in self]
        if not new:
            return
        texts = [w.decode() for w in new]
        pieces = self.pieces.encode(texts, num_threads=1)
        tokens = list(map(self.tokens.encode_ordinary, [" " + t for t in texts]))
        chars, n, k = (np.fromiter(map(len, x), np.int64, len(new)) for x in (texts, pieces, tokens))
        fallback = np.add.reduceat(self.byte[np.fromiter(chain.from_iterable(pieces), np.int32, n.sum())].astype(np.int64), np.cumsum(n) - n)
        self.update(zip(new, range(len(self), len(self) + len(new)), strict=True))
        self.table = np.concatenate([self.table, np.stack([chars, n, fallback, k], axis=1)])
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(tokens), np.int32, k.sum())])
        self.ends = np.cumsum(self.table[:, 3])

    def fertility(self, numbers: np.ndarray) -> tuple[int, int, float, float, int, float, float]:
        """(characters, tokens, characters per token, entropy, pieces, characters per piece, fallback share) of a text of known words."""
        if not len(numbers):
            return 0, 0, 0.0, 0.0, 0, 0.0, 0.0
        kinds, times = np.unique(numbers, return_counts=True)
        chars, pieces, fallback, tokens = (self.table[kinds] * times[:, None]).sum(0).tolist()
        each = self.table[kinds, 3]
        at = np.arange(each.sum()) + np.repeat(self.ends[kinds] - np.cumsum(each), each)
        counts = np.bincount(self.ids[at], np.repeat(times, each))
        p = counts[counts > 0] / tokens
        return chars, tokens, chars / tokens, float(-(p * np.log2(p)).sum()), pieces, chars / pieces, fallback / pieces


def script_of(text: str) -> str:
    """The script of most letters; 'other' if none has any."""
    if text.isascii():
        return "latin" if any(map(str.isalpha, text)) else "other"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = {name: sum(int(((points >= a) & (points <= b)).sum()) for a, b in blocks) for name, blocks in BLOCKS.items()}
    best = max(counts, key=counts.get)
    return best if counts[best] else "other"


def repeated_words(words: np.ndarray) -> int:
    """Words (as numbers) inside windows of WINDOW words that occur twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    known, ids = np.unique(words, return_inverse=True)
    if len(known) == len(words):
        return 0
    # ranks of pairs, of pairs of pairs, then of five words: exact at every step
    rank = ids
    for length in (1, 2):
        _, rank = np.unique(rank[:-length] * (rank.max() + 1) + rank[length:], return_inverse=True)
    _, rank, count = np.unique(rank[:n] * (len(known) + 1) + ids[WINDOW - 1 :], return_inverse=True, return_counts=True)
    marks = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(count[rank] > 1)
    np.add.at(marks, starts, 1)
    np.add.at(marks, starts + WINDOW, -1)
    return int((np.cumsum(marks) > 0).sum())


def duplicate_lines(raw: bytes) -> int:
    seen: set[bytes] = set()
    extra = 0
    for line in raw.split(b"\n"):
        if line in seen:
            extra += 1
        elif line.strip(b" \t\n\x0b\x0c\r"):
            seen.add(line)
    return extra


NAMES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, n_tokens long, chars_per_token double, token_entropy double, n_pieces long, chars_per_piece double, fallback_share double"


def _measure(batches: Iterator[pa.RecordBatch], paths: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    known = Vocabulary(paths)
    kinds = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[n.split()[1]] for n in NAMES.split(", ")]
    for batch in batches:
        rows = []
        texts = batch.column(1).to_pylist()
        raws = [(t or "").encode() for t in texts]
        split = [raw.split() for raw in raws]
        known.learn(list(set().union(*split)))
        for text, raw, words in zip(texts, raws, split, strict=True):
            numbers = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            chars, *measures = known.fertility(numbers)
            rows.append((len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), duplicate_lines(raw), repeated_words(numbers), script_of(text or ""), *measures))
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names=["id", "language", *(n.split()[0] for n in NAMES.split(", "))])


def vocabulary_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(PIECES), public_tokenizers.path(TOKENS)


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", paths: tuple[str, str] | None = None) -> DataFrame:
    """(id, language, counts, fertility, base_failed) for each row of `docs`."""
    small_batches(docs.sparkSession)
    language = (F.col(lang_col) if lang_col in docs.columns else F.lit(None)).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.lower(F.regexp_extract(F.coalesce(language, F.lit("")), "^([A-Za-z]+)", 1)).alias("language"))
    kind = rows.schema["id"].dataType.simpleString()
    measured = rows.mapInArrow(partial(_measure, paths=paths or vocabulary_paths()), f"id {kind}, language string, {NAMES}")
    return measured.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _lowest(rows: DataFrame, share: float) -> DataFrame:
    """(language, kind, value): of each language and kind with FEW rows or more the value at the quantile `share`, the lower one if it is between two.

    Rows are sorted by range over all tasks and numbered by the counts of the ranges before, so no language is in one task.
    """
    kind = ["language", "kind"]
    dealt = materialize(rows.repartitionByRange(*kind, "value").withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy(*kind, "_range").agg(F.count("*").alias("_k"))
    of_kind = Window.partitionBy(*kind)
    so_far = of_kind.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_k").over(so_far), F.lit(0))).withColumn("_n", F.sum("_k").over(of_kind)).where(F.col("_n") >= FEW)
    at = F.floor(F.lit(share) * (F.col("_n") - 1)) - F.col("_before")
    wanted = counts.select(*kind, "_range", at.alias("_at")).where((F.col("_at") >= 0) & (F.col("_at") < F.col("_k")))
    within = F.row_number().over(Window.partitionBy(*kind, "_range").orderBy("value")) - 1
    return dealt.withColumn("_within", within).join(F.broadcast(wanted), [*kind, "_range"]).where("_within = _at").select(*kind, "value")


def bands_of(measured: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_fit: int | None = None, key: str = "id") -> Floors:
    """Bands of the languages, from all measured rows whose label is 1 and which pass the base rule; from `max_fit` of them if that is given.

    `key` is what the labels' `id_col` says of a measured row. Numbers alone are shuffled, no texts.
    """
    good = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("key")).distinct()
    if max_fit is not None:
        good = good.orderBy(F.xxhash64("key"), "key").limit(max_fit)
    found = measured.where(~F.col("base_failed")).select(F.col(key).alias("key"), "language", "n_tokens", "chars_per_token", "token_entropy").join(good, "key", "left_semi")
    found = found.groupBy("key").agg(F.min(F.struct("language", "n_tokens", "chars_per_token", "token_entropy")).alias("m")).select("m.*").where("language <> ''")
    # kind: the class of length of an entropy, or -1 for characters per token
    length = sum((F.when(F.col("n_tokens") >= n, 1).otherwise(0) for n in LENGTHS), F.lit(-1))
    each = F.array(F.struct(F.lit(-1).alias("kind"), F.col("chars_per_token").alias("value")), F.struct(length.alias("kind"), F.col("token_entropy").alias("value")))
    # as many rows as there are languages and classes come back
    least: dict[str, dict[int, float]] = {}
    for language, kind, value in _lowest(found.select("language", F.explode(each).alias("x")).select("language", "x.kind", "x.value"), FALSE_REJECTION).collect():
        least.setdefault(language, {})[kind] = value
    return {language: (by[-1], tuple(by.get(k, 0.0) for k in range(len(LENGTHS)))) for language, by in least.items()}


def fit_bands(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", max_fit: int | None = None, paths: tuple[str, str] | None = None
) -> Floors:
    """`bands_of` the measures of `docs`. Where the rows are judged afterwards, `fitted_quality` measures them once for both."""
    return bands_of(measures(docs, id_col, text_col, lang_col, paths), labels, id_col, label_col, max_fit)


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", floors: Floors | None = None, bands: dict[str, tuple[float, float, float, float]] | None = None, paths: tuple[str, str] | None = None
) -> DataFrame:
    """The counts, base_failed, the measures, band_failed (script, language or null) and kept, for each row of `docs`."""
    return judge(measures(docs, id_col, text_col, lang_col, paths), id_col, floors, bands)


def fitted_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_id: str = "doc_id", key: str = "id", passed: bool = False, **columns) -> DataFrame:
    """`quality` with the bands that `labels` give. Each text is tokenised once: measures lie in a shared scratch table, from which the bands come and the rows are judged.

    The table has the ids and numbers; whole rows, if these are the ids. With `passed`, rows that fail the base rule are left out.
    """
    measured = measures(docs, id_col, **columns)
    measured = materialize(measured.where(~F.col("base_failed")) if passed else measured)
    return judge(measured, id_col, bands_of(measured, labels, label_id, key=key))


def judge(measured: DataFrame, id_col: str = "doc_id", floors: Floors | None = None, bands: dict[str, tuple[float, float, float, float]] | None = None) -> DataFrame:
    """band_failed and kept for rows of `measures`."""
    fits = F.lit(False)
    for script, (least, most, fallback, entropy) in (bands or BANDS).items():
        floor = F.least(F.lit(entropy), SHARE * F.log2(F.greatest("n_tokens", F.lit(1))))
        fits = fits | ((F.col("script") == script) & F.col("chars_per_piece").between(least, most) & (F.col("fallback_share") <= fallback) & (F.col("token_entropy") >= floor))
    low = F.lit(False)
    for language, (ratio, entropies) in (floors or {}).items():
        floor = F.lit(0.0)
        for length, least in zip(LENGTHS, entropies, strict=True):
            floor = F.when(F.col("n_tokens") >= length, least).otherwise(floor)  # the longest class that fits
        low = low | ((F.col("language") == language) & ((F.col("chars_per_token") < ratio) | (F.col("token_entropy") < floor)))
    judged = measured.withColumn("band_failed", F.when(~fits, "script").when(low, "language"))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("band_failed").isNull()).drop("language").withColumnRenamed("id", id_col)
