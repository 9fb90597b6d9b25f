"""Language identification by hierarchical discrimination.

Level one tells the language *family*, level two separates the languages of
that family from each other by one linear support vector machine for each
pair (each pair's machine votes with its margin).  A family's machine stands
against all other families.  All machines see the same features: shares of
byte 1- to 4-grams of the lower-cased text, hashed into a fixed number of
buckets, as square roots and with unit length.

The families of well-known languages are listed; any other code is a family
of its own, so a new label needs no change.

The machines are fitted to about ``sample`` documents of each language and
``SAMPLE_TOTAL`` of all at most, chosen by a hash of the id; prediction covers every row and whole texts.

``und`` with score 0 is the answer for a null text, a text without a letter,
and when nothing was learned.  Rows with a null label are not learned from.
Repeated rows get equal answers; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.common import add_fields, bounded_sample, held_out, load
from tessera.llm.linear import fit_hinge, fit_sigmoid, sigmoid

#: Documents of each language, and of all together, that the fit uses at most, about; one takes 32 kB on the driver.
SAMPLE, SAMPLE_TOTAL = 800, 16_000
BITS = 13
UNKNOWN = "und"

#: Families of ISO 639-1 codes.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "da", "sv", "no", "nb", "nn", "is", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ca", "gl", "ro", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "baltic": ("lt", "lv"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "ky", "tk"),
    "indic": ("hi", "bn", "mr", "ne", "pa", "gu", "ur", "sa"),
    "dravidian": ("ta", "te", "kn", "ml"),
    "semitic": ("ar", "he", "mt", "am"),
    "malayic": ("id", "ms", "jv", "su"),
    "sinitic": ("zh",),
    "japonic": ("ja",),
    "koreanic": ("ko",),
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}


def has_letter(text: str) -> bool:
    """Whether any character is of the Unicode category L."""
    return any(map(str.isalpha, text))


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], f"={lang}")


_MULT = (np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F]) | 1).astype(np.uint32)


def features(col: pa.Array, bits: int = BITS) -> Iterator[np.ndarray]:
    """For each text a unit vector over the hashed byte n-grams."""
    data, off = W.text_bytes(col)
    size = 1 << bits
    for a, b in W.slices(off, 1 << 20):
        part = W._FOLD[data[off[a] : off[b]]]
        part = np.where(W.WHITESPACE[part] == 0, 32, part).astype(np.uint32)
        codes, h = [], np.zeros(len(part), np.uint32)
        for n in range(4):
            # h: hash of the n + 1 bytes from here; the last n of a document would run into the next
            h = (h[: len(part) - n] * np.uint32(257) + part[n:] + np.uint32(1)) if n else part + np.uint32(1)
            codes.append((h * _MULT[n]) >> np.uint32(32 - bits))
        for i in range(a, b):
            x, y = off[i] - off[a], off[i + 1] - off[a]
            counts = np.zeros(size)
            for n in range(4):
                if y - n > x:
                    counts += np.bincount(codes[n][x : y - n], minlength=size)
            v = np.sqrt(counts)
            yield (v / (np.sqrt(counts.sum()) or 1.0)).astype(np.float32)


@dataclass
class Model:
    """``family_w``: a row for each family; ``pairs[family]``: (first, second, weights, slope, shift) of each pair."""

    families: list[str]
    members: dict[str, list[str]]
    family_w: np.ndarray
    family_fit: list[tuple[float, float]]
    pairs: dict[str, list[tuple[int, int, np.ndarray, float, float]]]

    def predict(self, v: np.ndarray) -> tuple[str, float]:
        x = np.append(v, 1.0)
        if len(self.families) > 1:
            p = np.array([float(sigmoid(a * m + b)) for m, (a, b) in zip(self.family_w @ x, self.family_fit, strict=True)])
            best = int(np.argmax(p))
            chance = float(p[best] / max(p.sum(), 1e-12))
        else:
            best, chance = 0, 1.0
        name = self.families[best]
        langs = self.members[name]
        if len(langs) == 1:
            return langs[0], chance
        votes = np.zeros(len(langs))
        for i, j, w, slope, shift in self.pairs[name]:
            q = float(sigmoid(slope * float(w @ x) + shift))
            votes[i] += q
            votes[j] += 1 - q
        k = int(np.argmax(votes))
        return langs[k], chance * float(votes[k] / (len(langs) - 1))


def _machine(x: list[np.ndarray], y: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, float, float]:
    """A hinge-loss machine with its sigmoid from margins of the half that each of two half machines did not see."""
    at, size = slice(0, len(x[0])), len(x[0])
    n1, n0 = max(1, int((y > 0).sum())), max(1, int((y < 0).sum()))
    weights = (len(y) / (2 * n0), len(y) / (2 * n1))
    fit = lambda rows: fit_hinge([(at, x[i]) for i in rows], y[rows], size, cost=10.0, passes=12, class_weights=weights)
    margins = np.zeros(len(y))
    for h in (0, 1):
        seen, unseen = np.flatnonzero(half != h), np.flatnonzero(half == h)
        if len(set(y[seen])) < 2:
            seen = np.arange(len(y))
        w = fit(seen)
        for i in unseen:
            margins[i] = float(w[:-1] @ x[i] + w[-1])
    return fit(np.arange(len(y))).astype(np.float32), *fit_sigmoid(margins, (y > 0).astype(int), np.where(y > 0, weights[1], weights[0]))


def fit_languages(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """The machines, from rows of ``docs(doc_id, text, lang)`` that are not held out; None without any."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", "lang", "text", F.xxhash64("doc_id", "text").alias("draw"))
    chosen, counts = bounded_sample(known, "lang", "draw", sample, SAMPLE_TOTAL)
    # Rows are drawn by id and text, and equal rows count once, so no id can bring more than its share.
    chosen = chosen.dropDuplicates(["doc_id", "lang", "draw"])
    if not counts:
        return None

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for lang, half, text, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), features(b.column(2)), strict=True):
                if has_letter(text):
                    at = np.flatnonzero(v).astype(np.int16)
                    rows.append({"lang": lang, "half": half, "at": at.tobytes(), "v": v[at].astype(np.float16).tobytes()})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("lang", pa.string()), ("half", pa.int32()), ("at", pa.binary()), ("v", pa.binary())]))

    half = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(2)).cast("int").alias("half")
    rows = chosen.select("lang", half, "text").mapInArrow(extract, "lang string, half int, at binary, v binary").toPandas()
    if not len(rows):
        return None
    rows = rows.sort_values(["lang", "half", "at", "v"], kind="stable").reset_index(drop=True)
    dense = []
    for at, v in zip(rows["at"], rows["v"], strict=True):
        x = np.zeros(1 << BITS, np.float32)
        x[np.frombuffer(at, np.int16).astype(int)] = np.frombuffer(v, np.float16)
        dense.append(x)
    lang, halves = rows["lang"].to_numpy(), rows["half"].to_numpy()
    members: dict[str, list[str]] = defaultdict(list)
    for code in sorted(set(lang)):
        members[family(code)].append(code)
    families = sorted(members)
    of = np.array([family(x) for x in lang])
    weights, fits = [], []
    for name in families if len(families) > 1 else ():
        w, a, b = _machine(dense, np.where(of == name, 1, -1), halves)
        weights.append(w)
        fits.append((a, b))
    pairs = {}
    for name in families:
        pairs[name] = []
        for i, j in combinations(range(len(members[name])), 2):
            rows_ij = np.flatnonzero((lang == members[name][i]) | (lang == members[name][j]))
            pairs[name].append((i, j, *_machine([dense[r] for r in rows_ij], np.where(lang[rows_ij] == members[name][i], 1, -1), halves[rows_ij])))
    return Model(families, dict(members), np.array(weights), fits, pairs)


def identify_language(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,lang_score:double>")
    def identify(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        for col in texts:
            langs, scores = [], []
            for x, v in zip(col, features(col), strict=True):
                plain = x.as_py()
                lang, score = m.predict(v) if m is not None and plain and has_letter(plain) else (UNKNOWN, 0.0)
                langs.append(lang)
                scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "lang_score"])

    return add_fields(docs, identify(F.col(text)), ("lang_pred", "lang_score"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``."""
    docs = load(spark, sf_dir, "documents")
    found = identify_language(docs.select("doc_id", "text"), fit_languages(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
