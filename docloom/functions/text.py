"""Text functions: tokens of mixed scripts, aliases and slugs."""

from __future__ import annotations

import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Characters that NFKC leaves alone wherever they stand: most of Latin, Greek, Cyrillic, kana, CJK and common signs.
_SETTLED = r"\x00-\x7F\u00A1-\u00A7\u00A9\u00AB-\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0391-\u03CE\u0400-\u0482\u048A-\u052F\u2013\u2014\u2018-\u201E\u2020-\u2022\u20AC\u3001-\u3029\u3041-\u3096\u30A1-\u30FA\u3400-\u4DBF\u4E00-\u9FFF"
#: Texts of a batch that are Python objects at a time.
_PIECE = 64
_CJK = "\u3400-\u4DBF\u4E00-\u9FFF"


def nfkc(text: Column) -> Column:
    """Unicode's compatible composed form; only texts with a character that it may change leave the JVM."""

    def run(texts: pa.Array) -> pa.Array:
        some = (texts.slice(low, _PIECE).to_pylist() for low in range(0, len(texts), _PIECE))
        return pa.concat_arrays([pa.array([t if t is None else unicodedata.normalize("NFKC", t) for t in piece], pa.string()) for piece in some] or [pa.array([], pa.string())])

    return F.coalesce(F.arrow_udf(run, "string")(F.when(unsettled(text), text)), text)


def _folded(text: Column) -> Column:
    """NFKC, case-folded, letters and digits of any script only."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "".join(c for c in unicodedata.normalize("NFKC", t).casefold() if c.isalnum()), na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def _ascii(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode(), na_action="ignore")

    return F.pandas_udf(run, "string")(text)


def _is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unsettled(text: Column) -> Column:
    """Whether NFKC may change the text; false for null. ASCII texts, told by their sizes, are not searched."""
    return F.coalesce((F.octet_length(text) != F.length(text)) & text.rlike(f"[^{_SETTLED}]"), F.lit(False))


def settled_tokens(text: Column) -> Column:
    """As ``tokens``, of texts that NFKC does not change; nothing leaves the JVM, and each text is tested for CJK once."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit("[a-z0-9_]+"), F.lit(0))

    def of_run(run: Column) -> Column:
        n = F.length(run)
        single = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(run, i, F.lit(1)))
        double = F.when(n > 1, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.concat(single, double)

    runs = F.regexp_extract_all(low, F.lit(f"[{_CJK}]+"), F.lit(0))
    all_ = F.when(text.rlike(f"[{_CJK}]"), F.concat(words, F.flatten(F.transform(runs, of_run)))).otherwise(words)
    return F.coalesce(all_, F.array().cast("array<string>"))


def tokens(text: Column) -> Column:
    """NFKC, lower case, words of a-z, 0-9 and _, then each CJK run's characters and bigrams; null has none."""
    return settled_tokens(nfkc(text))


def term_counts(words: Column) -> Column:
    """array of (token, tf) of an array of tokens, by sorting it: a repeated token is a run whose end gives its count."""

    def of_sorted(s: Column) -> Column:
        n = F.size(s)
        ends = F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.element_at(s, i) != F.element_at(s, F.least(i + 1, n))))
        return _let(ends, lambda e: F.transform(e, lambda i, k: F.struct(F.element_at(s, i).alias("token"), (i - F.when(k > 0, F.get(e, k - 1)).otherwise(0)).cast("long").alias("tf"))))

    return F.when(F.size(words) > 0, _let(F.sort_array(words), of_sorted)).otherwise(F.array().cast("array<struct<token:string,tf:bigint>>"))


def alias_key(text: Column) -> Column:
    """An alias without case, blanks and signs; texts beyond ASCII by Unicode's rules."""
    return F.when(_is_ascii(text), F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")).otherwise(_folded(text))


def slug(text: Column, page_id: Column) -> Column:
    """ASCII letters and digits joined by -, 'entity' where none are left, and 8 digits of the page id."""
    plain = F.when(_is_ascii(text), text).otherwise(_ascii(text))
    base = F.trim(F.regexp_replace(F.lower(plain), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.concat_ws("-", F.when(base == "", "entity").otherwise(base), F.substring(page_id, -8, 8))
