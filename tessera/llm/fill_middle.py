"""Fill-in-middle: a text is cut into units, two of their ends are drawn, and the three parts change places.

The units come from the ``Split`` pre-tokenizer of the tokenizers library with
isolated regex matches: it needs no training and gives the offsets of every
unit in code points.  The number of offsets is n; the ends of the prefix and
of the middle are looked up in the offsets by the two drawn ranks.  A text of
more than ``WINDOW`` code points is matched in windows that end where no unit
can go on (after ``cut_after``), since the library keeps some 50 bytes for each
code point that it looks at.

The draws are the first four 8-digit groups of the hex sha256 of
``seed:doc_id``, so a rerun gives the same rows.  Forms:

* ``psm``: P prefix S suffix M middle,
* ``spm``: S suffix P prefix M middle,
* ``plain``: the text as it is, where it is empty, holds a sentinel, or was
  not drawn (``rate`` of 100).

``restored_text`` is the inverse, a column expression.

Null text counts as empty, so it is plain with n 0; a null id draws as an
empty one.  Rows of one id and text get equal results; ids of any type are
taken as text.  Result columns replace input columns of the same name, other
columns pass through.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import add_fields, fresh_name, load

#: A unit is a line with its end, or the last line without one.
LINES = r"[^\n]*\n|[^\n]+"
SENTINELS = ("<P>", "<S>", "<M>")
#: Code points that the library looks at together.
WINDOW = 500_000
FIELDS = ("n", "form", "prefix_chars", "middle_chars", "output")


def windows(text: str, cut_after: str | None, size: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Ranges of the text that end after ``cut_after`` or at its end; a stretch without it stays whole."""
    at = 0
    while at < len(text):
        end = len(text)
        if cut_after is not None and end - at > size:
            found = text.rfind(cut_after, at, at + size)
            if found < 0:
                found = text.find(cut_after, at + size - len(cut_after) + 1)
            end = found + len(cut_after) if found >= 0 else end
        yield at, end
        at = end


def unit_ends(splitter, text: str, cut_after: str | None = "\n", size: int = WINDOW) -> np.ndarray:
    """The end of every unit of the text, in code points."""
    ends = [np.zeros(0, np.int64)]
    for a, b in windows(text, cut_after, size):
        whole = a == 0 and b == len(text)
        found = splitter.pre_tokenize_str(text if whole else text[a:b])
        ends.append(np.fromiter((e for _, (_, e) in found), np.int64, len(found)) + a)
    return np.concatenate(ends)


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """No sentinel can arise where a part of a text meets another sentinel: each starts with a character that none has elsewhere."""
    later = {c for s in sentinels for c in s[1:]}
    if len(set(sentinels)) < 3 or any(not s or s[0] in later for s in sentinels):
        raise ValueError("three different sentinels are needed, whose first characters stand nowhere else in them")


def draws(key: str, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50, units: str = LINES, cut_after: str | None = "\n", sentinels: tuple[str, str, str] = SENTINELS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``n, form, prefix_chars, middle_chars, output``; see the module.

    ``units`` is the pattern of a unit, ``cut_after`` a string after which no
    match of it goes on (None: texts are matched as a whole).
    """
    check_sentinels(sentinels)
    first, second, third = sentinels

    @F.arrow_udf("struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>")
    def transform(columns: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        splitter = Split(Regex(units), behavior="isolated")
        for column, *drawn in columns:
            h1, h2, h3, h4 = (d.to_numpy() for d in drawn)
            n, form, prefix, middle, output = [], [], [], [], []
            for i, value in enumerate(column):
                t = value.as_py() or ""
                ends = np.concatenate((np.zeros(1, np.int64), unit_ends(splitter, t, cut_after)))
                count = len(ends) - 1
                n.append(count)
                if not t or h3[i] % 100 >= rate or any(s in t for s in sentinels):
                    kind, a, b, made = "plain", None, None, t
                else:
                    low, high = sorted((int(h1[i] % (count + 1)), int(h2[i] % (count + 1))))
                    a, b = int(ends[low]), int(ends[high])
                    kind = "spm" if h4[i] % 100 < spm_rate else "psm"
                    made = "".join((second, t[b:], first, t[:a], third, t[a:b]) if kind == "spm" else (first, t[:a], second, t[b:], third, t[a:b]))
                form.append(kind)
                prefix.append(a)
                middle.append(None if a is None else b - a)
                output.append(made)
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())], list(FIELDS))

    return add_fields(docs, transform(F.col(f"`{text}`").cast("string"), *draws(key, seed)), FIELDS)


def restored_text(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``fill_in_middle`` made ``output`` of."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels), 4)
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` transformed, with digests of the output and of the text that it gives back."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    done = fill_in_middle(docs)
    back = fresh_name(done, "_back")
    made = done.withColumn(back, restored_text(F.col("output"), F.col("form")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(F.col(back), 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u FROM documents),
e AS (SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:n], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256, sha256(t) AS restored_sha256 FROM g"""
