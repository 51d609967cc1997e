"""Language ID by rank-order profiles.

A profile is the ranked list of a language's most frequent letter n-grams. A text is ranked the same way, and
the language whose ranks differ least in total (the out-of-place distance) is its prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqframe.llm.text import blocks

#: Longest n-gram, and n-grams kept in a profile and in a text's ranking.
N, TOP = 3, 300

#: Languages a model may hold. It bounds what the driver and the tasks keep: MAX_LANGS * TOP rows.
MAX_LANGS = 1000

UNDETERMINED = "und"

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Which code points are letters."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def _ranked(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, n-gram and count of every distinct n-gram of each text, ordered by document and n-gram.

    Letters are lower-cased, all else between them is one blank, and texts begin and end with a blank. An n-gram
    is packed into 21 bits a character, so its number means the same in every block.
    """
    joined = "\0" + "\0\0".join(t.replace("\0", " ") for t in texts).lower() + "\0"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[codes]
    border = codes == 0
    keep = letter | border
    keep[1:] |= letter[:-1]
    codes, border, letter = codes[keep], border[keep], letter[keep]
    alphabet = np.flatnonzero(np.bincount(codes[letter], minlength=33))
    number = np.ones(0x110000, np.uint8 if len(alphabet) < 250 else np.uint32)  # 1 is the blank, 0 no character
    number[alphabet] = np.arange(2, len(alphabet) + 2)
    width = int(len(alphabet) + 1).bit_length()
    kind = np.uint32 if width * N + len(texts).bit_length() <= 32 else np.uint64
    g = number[codes].astype(kind)
    base = (np.cumsum(border) >> 1).astype(kind) << kind(width * N)
    double = ~(letter[1:] | letter[:-1])
    ok, keys = letter, []
    for n in range(1, N + 1):
        base = base[: len(g) - n + 1] | (g[n - 1 :] << kind(width * (N - n)))
        if n > 1:
            ok = ok[:-1] & ~double[n - 2 :] if n > 2 else ~double
        keys.append(base[ok])
    key = np.concatenate(keys)
    key.sort()
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(key)])
    key = key[first].astype(np.int64)
    gram = np.zeros(len(key), np.int64)
    table = np.r_[0, 32, alphabet]
    for n in range(N):
        gram = (gram << 21) | table[(key >> (width * (N - 1 - n))) & ((1 << width) - 1)]
    return key >> (width * N), gram, count


def _parts(column: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Slices of at most about two million bytes, and few enough texts for the packed keys."""
    for at, to, _, _ in blocks(column):
        for a in range(at, to, 2000):
            b = min(to, a + 2000)
            yield a, b, [t or "" for t in column[a:b].to_pylist()]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP) -> DataFrame:
    """Profiles of all languages: lang, gram, rank (from 0), the ``top`` most frequent n-grams of each.

    Rows without a language or text teach nothing. Equal counts are ranked by the n-gram. An empty table
    gives no profile. Counts are added up inside each task before they are shuffled by n-gram, and languages are cut
    to ``top`` rows before one task ranks them.
    """

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, lang_of = np.unique(np.array(batch.column(1).to_pylist(), dtype=object).astype(str), return_inverse=True)
            for a, b, texts in _parts(batch.column(0)):
                doc, gram, n = _ranked(texts)
                frame = pd.DataFrame({"l": lang_of[a:b][doc], "gram": gram, "n": n}).groupby(["l", "gram"], as_index=False)["n"].sum()
                frame["l"] = langs[frame["l"]]
                yield pa.RecordBatch.from_pandas(frame.rename(columns={"l": "lang"}), preserve_index=False)

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    found = rows.mapInArrow(counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found.createOrReplaceTempView("_gram_counts")
    return found.sparkSession.sql(
        f"""select lang, gram, cast(r - 1 as int) as rank from
            (select *, row_number() over (partition by lang order by n desc, gram) as r from _gram_counts) where r <= {int(top)}"""
    )


def predict(
    docs: DataFrame,
    profiles: DataFrame,
    id_cols: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    top: int = TOP,
) -> DataFrame:
    """Adds lang_pred and score (1: all ranks agree, 0: nothing in common) to ``id_cols``; one narrow pass.

    NULL text, empty text and text without a letter are ``und`` with score 0, as is every text if there are
    no profiles. Equal distances go to the alphabetically first language. Each input row gives one row, repeated rows too; columns
    other than those named are not read.
    """
    bound = MAX_LANGS * top
    rows = profiles.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs = sorted({r["lang"] for r in rows})
    known = np.array(sorted({r["gram"] for r in rows}), np.int64)
    ranks = np.full((len(langs), len(known) + 1), -1, np.int64)
    for r in rows:
        ranks[langs.index(r["lang"]), np.searchsorted(known, r["gram"])] = r["rank"]

    def score(texts: list[str]) -> tuple[list[str], np.ndarray]:
        doc, gram, count = _ranked(texts)
        most = int(count.max(initial=1))
        if len(texts) * (most + 1) < 2**31:  # by document, falling count, n-gram, in one word
            order = (doc * (most + 1) + (most - count)) << 32 | np.arange(len(doc))
            order.sort()
            order &= 0xFFFFFFFF
        else:
            order = np.lexsort((gram, -count, doc))
        doc, gram = doc[order], gram[order]
        starts = np.searchsorted(doc, np.arange(len(texts) + 1))
        place = np.arange(len(doc)) - starts[doc]
        use = place < top
        doc, gram, place = doc[use], gram[use], place[use]
        total = np.bincount(doc, minlength=len(texts)).astype(float)
        pred, best = np.full(len(texts), UNDETERMINED, object), np.full(len(texts), np.inf)
        at = np.minimum(np.searchsorted(known, gram), max(len(known) - 1, 0))
        at = np.where(known[at] == gram, at, len(known)) if len(known) else np.zeros(len(gram), np.int64)
        for i, lang in enumerate(langs):
            theirs = ranks[i, at]
            apart = np.where(theirs < 0, top, np.abs(place - theirs))
            distance = np.bincount(doc, weights=apart, minlength=len(texts))
            better = (total > 0) & (distance < best)
            pred[better], best[better] = lang, distance[better]
        return list(pred), np.where(np.isfinite(best), 1 - best / np.maximum(total * top, 1), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in _parts(batch.column(batch.num_columns - 1)):
                pred, value = score(texts)
                yield pa.RecordBatch.from_arrays(
                    [c.slice(a, b - a) for c in batch.columns[:-1]] + [pa.array(pred, pa.string()), pa.array(value, pa.float64())],
                    [*batch.schema.names[:-1], "lang_pred", "score"],
                )

    picked = docs.select(*[F.col(c) for c in id_cols], F.col(text_col).alias("_text"))
    schema = picked.drop("_text").schema.add("lang_pred", "string").add("score", "double")
    return picked.mapInArrow(run, schema)


def fold(id_col: Column, parts: int, held: int) -> Column:
    """True for the rows that learning must not see: crc32 of the id as text, modulo ``parts``, is ``held``. NULL ids are seen by neither."""
    return F.crc32(id_col.cast("string").cast("binary")) % parts == held
