"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: a slot holds a mask with a
bit for each language, and the AND of the slots of an n-gram is the set of
languages that contain it.  Per language the bits of a text's n-grams are
counted, the hits that the filter's false positives explain are taken off, and
the highest corrected count decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbside.llm._common import free_names, own, stored
from kerbside.llm.sharding import unit_hash

SIZES = (3, 4)
#: Hash functions of the filter.
HASHES = 3
PIECE = 400_000
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)
_letters: list = []


def letters():
    """A table from code point to itself if it is a letter, else to the blank."""
    if not _letters:
        import numpy as np

        _letters.append(np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.uint32))
    return _letters[0]


def pieces(text: str) -> Iterator[str]:
    """The text in pieces of at most PIECE characters, cut at blanks where there are any."""
    at = 0
    while len(text) - at > PIECE:
        stop = text.rfind(" ", at + 1, at + PIECE) + 1 or at + PIECE
        yield text[at:stop]
        at = stop
    yield text[at:]


def ngrams(texts: list[str]):
    """(hash, index of the text) of every n-gram inside a word, the blanks at its ends included."""
    import numpy as np

    coded = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    if not coded:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    owner = np.repeat(np.arange(len(coded), dtype=np.int32), [len(c) for c in coded])
    codes = letters()[np.concatenate(coded)]
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
    codes, owner = codes[keep].astype(np.uint64), owner[keep]
    inner = codes != 32
    hashes, owners = [], []
    for n in SIZES:
        k = len(codes) - n + 1
        if k <= 0:
            continue
        ok = owner[:k] == owner[n - 1 :]
        for j in range(1, n - 1):
            ok &= inner[j : j + k]
        at = np.flatnonzero(ok)
        h = np.full(len(at), n, np.uint64)
        for j in range(n):
            h = (h ^ codes[at + j]) * np.uint64(_MIX[j])
            h ^= h >> np.uint64(29)
        hashes.append(h)
        owners.append(owner[at])
    return np.concatenate(hashes), np.concatenate(owners)


def batches_of(texts: list[str]) -> Iterator[tuple[list[str], list[int]]]:
    """Pieces of texts, PIECE characters at a time, with the index of the text of each."""
    held, ids, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in pieces(text):
            if held and size + len(piece) > PIECE:
                yield held, ids
                held, ids, size = [], [], 0
            held.append(piece)
            ids.append(i)
            size += len(piece)
    if held:
        yield held, ids


@dataclass(frozen=True)
class LanguageModel:
    """languages, most frequent first; filter: slices x slots masks of 64 languages each."""

    languages: tuple[str, ...]
    filter: object = field(compare=False, repr=False)
    rates: tuple[float, ...] = ()

    def masks(self, h):
        """Per slice the mask of the languages that contain each n-gram."""
        import numpy as np

        out = None
        for j in range(HASHES):
            got = self.filter[:, slots_of(h, j, self.filter.shape[1])]
            out = got if out is None else out & got
        return out

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        import numpy as np

        count, total = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for part, ids in batches_of(texts):
            h, owner = ngrams(part)
            rows = np.array(ids)[owner]
            total += np.bincount(rows, minlength=len(texts))
            masks = self.masks(h)
            for i in range(len(self.languages)):
                hit = (masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)
                count[:, i] += np.bincount(rows, hit.astype(float), minlength=len(texts))
        rate = np.array(self.rates)
        fixed = np.clip((count - total[:, None] * rate) / np.maximum(1 - rate, 1e-9), 0, None)
        best = fixed.argmax(1)
        score = np.clip(fixed[np.arange(len(texts)), best] / np.maximum(total, 1), 0, 1)
        lettered = [bool((letters()[np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)] != 32).any()) for t in texts]
        return [self.languages[b] if ok else "und" for b, ok in zip(best, lettered, strict=True)], [
            float(s) if ok else 0.0 for s, ok in zip(score, lettered, strict=True)
        ]


def held_out(key: Column) -> Column:
    """Rows nothing is learnt from: crc32 of the key as text leaves 1 modulo 3; a null key is never one."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def slots_of(h, j: int, slots: int):
    """Places of n-gram hashes in a filter of ``slots`` under hash function ``j``."""
    import numpy as np

    return (((h * np.uint64(_MIX[j] | 1)) >> np.uint64(24)) % np.uint64(slots)).astype(np.int64)


def fit_languages(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    per_language: int = 2000,
    slots: int | None = None,
    share_of_best: float = 0.1,
    least: int = 1,
) -> LanguageModel | None:
    """Learn the filter from rows that are not held out; None if there are none.

    About ``per_language`` rows of each language at most are read, whole, chosen
    by a hash of the key.  A language contains an n-gram if the sample has it
    there, ``least`` times or more, at ``share_of_best`` or more of the rate of
    the language that has it most: a word lent to another language would else be
    that one's too.  Every such n-gram goes into the filter.  The filter is put together on the executors, as the OR of masks by
    slot; the driver gets its words alone.  Without ``slots`` there are eight to
    sixteen for each n-gram of the language with the most, so that the size
    follows the sample, which is bounded.

    Rows with a null text, language or key: the first two teach nothing, the
    last is never held out.  Repeated rows count each.
    """
    import numpy as np

    rows = df.select(F.col(key).alias("_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("_id"))
    )
    size = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not size:
        return None
    names = sorted(size, key=lambda x: (-size[x], x))
    number = {x: i for i, x in enumerate(names)}
    slices = (len(names) + 63) // 64
    share = F.element_at(F.create_map(*[x for k, v in size.items() for x in (F.lit(k), F.lit(per_language / v))]), F.col("lang"))
    chosen = rows.where(unit_hash(F.concat(F.lit("lang:"), F.coalesce(F.col("_id").cast("string"), F.lit("")), F.lit(":"), F.crc32("text").cast("string"))) < share)

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts, own = batch.column(0).to_pylist(), [number[x] for x in batch.column(1).to_pylist()]
            for part, ids in batches_of(texts):
                h, owner = ngrams(part)
                of = np.array([own[i] for i in ids], np.int32)[owner]
                for i in np.unique(of):
                    grams, n = np.unique(h[of == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(grams.view(np.int64)), pa.array(np.full(len(grams), i, np.int32)), pa.array(n.astype(np.int64))],
                        names=["gram", "lang", "n"],
                    )

    counts = chosen.select("text", "lang").mapInArrow(count, "gram bigint, lang int, n bigint").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counts = stored(counts, "ngrams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return LanguageModel(tuple(names), np.zeros((slices, slots or 64), np.uint64), (0.0,) * len(names))
    per = F.element_at(F.create_map(*[x for k, v in totals.items() for x in (F.lit(k), F.lit(float(v)))]), F.col("lang"))
    rated = counts.withColumn("rate", F.col("n") / per)
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"))
    kept = stored(rated.join(best, "gram").where((F.col("n") >= least) & (F.col("rate") >= share_of_best * F.col("best"))).select("gram", "lang"), "contained")
    if slots is None:
        most = max((r["count"] for r in kept.groupBy("lang").count().collect()), default=1)
        slots = 1 << (8 * most - 1).bit_length()

    def spread(batches: Iterator, slots=slots) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            grams, own = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            at = np.concatenate([slots_of(grams, j, slots) for j in range(HASHES)])
            bits = np.uint64(1) << (own % 64).astype(np.uint64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(np.tile(own // 64, HASHES).astype(np.int32)), pa.array(np.tile(bits, HASHES).view(np.int64))],
                names=["slot", "slice", "bits"],
            )

    words = kept.mapInArrow(spread, "slot bigint, slice int, bits bigint").groupBy("slice", "slot").agg(F.bit_or("bits").alias("mask"))
    table = np.zeros((slices, slots), np.uint64)
    for r in words.toLocalIterator():
        table[r["slice"], r["slot"]] = r["mask"] % (1 << 64)
    fill = [float(((table[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean()) for i in range(len(names))]
    return LanguageModel(tuple(names), table, tuple(f**HASHES for f in fill))


def predict_language(df: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` (string) and ``lang_score`` (double), replacing columns so named.

    ``und`` with score 0 for a null text, one without a letter, or without a
    model.  A text with letters but no known n-gram gets the most frequent
    language with score 0; ties go to the more frequent language.  Texts are
    read whole, long ones in pieces of PIECE characters.  The prediction depends
    on the text alone, so repeated rows get the same; all other columns stay,
    and an empty table gives an empty table.
    """
    plain = df.drop("lang_pred", "lang_score")
    (mark,) = free_names(df, "_judged")
    if model is None:
        return plain.withColumns({"lang_pred": F.lit("und"), "lang_score": F.lit(0.0)})
    shared = df.sparkSession.sparkContext.broadcast(model)  # slots x slices x 8 bytes, by the size of the sample

    @F.pandas_udf("p string, s double")
    def judge(texts):
        import pandas as pd

        lang, score = shared.value.predict(list(texts))
        return pd.DataFrame({"p": lang, "s": score})

    judged = plain.withColumn(mark, judge.asNondeterministic()(F.coalesce(F.col(text), F.lit(""))))
    return judged.select(*own(plain), F.col(f"{mark}.p").alias("lang_pred"), F.col(f"{mark}.s").alias("lang_score"))
