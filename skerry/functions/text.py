"""Tokenizers as Column expressions; only stemming leaves the JVM (an Arrow UDF over the distinct tokens of a batch)."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# English words that carry no topic.
STOP_WORDS = tuple(
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()
)
#: Languages with stop words: those of English above, the others as Spark ML has them.
LANGUAGES = ("Danish", "Dutch", "English", "Finnish", "French", "German", "Hungarian", "Italian", "Norwegian", "Portuguese", "Russian", "Spanish", "Swedish", "Turkish")
BASES = ("simple", "whitespace", "raw", "ngram")
UNSUPPORTED = ("icu", "jieba", "lindera")


@dataclass(frozen=True)
class Tokenizer:
    base_tokenizer: str = "simple"
    language: str = "English"
    max_token_length: int | None = 40
    lower_case: bool = True
    stem: bool = True
    remove_stop_words: bool = True
    custom_stop_words: Sequence[str] | None = None
    ascii_folding: bool = True
    ngram_min_length: int = 3
    ngram_max_length: int = 3
    prefix_only: bool = False
    with_position: bool = field(default=False, compare=False)

    def __post_init__(self) -> None:
        if self.base_tokenizer.split("/")[0].split("-")[0] in UNSUPPORTED:
            raise NotImplementedError(f"tokenizer {self.base_tokenizer} needs a dictionary that isn't here")
        if self.base_tokenizer not in BASES:
            raise ValueError(f"tokenizer is one of {BASES}")
        if self.language != "English" and self.stem:
            raise NotImplementedError(f"no stemmer for {self.language}: turn it off")
        if self.language not in LANGUAGES and self.remove_stop_words and self.custom_stop_words is None:
            raise NotImplementedError(f"no stop words for {self.language}: turn them off or give some")
        if not 1 <= self.ngram_min_length <= self.ngram_max_length:
            raise ValueError("ngram lengths must be 1 <= min <= max")

    @property
    def stop_words(self) -> tuple[str, ...]:
        if not self.remove_stop_words:
            return ()
        if self.custom_stop_words is not None:
            return tuple(self.custom_stop_words)
        return STOP_WORDS if self.language == "English" else _stop_words_of(self.language, self.ascii_folding)

    def tokens(self, text: Column) -> Column:
        """array<string> of a text, null for null.  Terms keep their order; removed ones leave no gap."""
        # case and marks are folded on the whole text, inside generated code; one pass over the tokens drops the rest
        folded = F.lower(text) if self.lower_case else text
        folded = fold_ascii(folded) if self.ascii_folding else folded
        out = {"simple": lambda: F.split(folded, r"[^\p{L}\p{M}\p{N}]+"), "whitespace": lambda: F.split(folded, r"\s+"), "raw": lambda: F.array(folded), "ngram": lambda: self._grams(folded)}[self.base_tokenizer]()
        longest, stop = self.max_token_length, list(self.stop_words)
        if longest or stop:
            fits = lambda t: F.length(t).between(1, longest) if longest else F.length(t) > 0
            out = F.filter(out, lambda t: fits(t) & ~t.isin(stop) if stop else fits(t))
        else:
            out = F.array_remove(out, "")
        out = F.when(text.isNotNull(), out)
        return stem_all(out) if self.stem else out

    def _grams(self, text: Column) -> Column:
        sizes = F.array(*[F.lit(n) for n in range(self.ngram_min_length, self.ngram_max_length + 1)])
        if self.prefix_only:
            return F.flatten(F.transform(F.split(text, r"[^\p{L}\p{M}\p{N}]+"), lambda w: F.transform(F.filter(sizes, lambda n: n <= F.length(w)), lambda n: F.substring(w, F.lit(1), n))))
        starts = lambda n: F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(sizes, lambda n: F.transform(starts(n), lambda i: F.substring(text, i, n))))

    def of(self, spark, text: str) -> list[str]:
        """The tokens of one text."""
        return spark.range(1).select(self.tokens(F.lit(text)).alias("t")).first().t


def _stop_words_of(language: str, folded: bool) -> tuple[str, ...]:
    """Spark ML's list of a language, with the forms that folding makes of its words."""
    from pyspark.ml.feature import StopWordsRemover

    words = StopWordsRemover.loadDefaultStopWords(language.lower())
    plain = [unicodedata.normalize("NFD", w).encode("ascii", "ignore").decode() for w in words] if folded else []
    return tuple(dict.fromkeys([*words, *[w for w in plain if w]]))


def _folds() -> tuple[str, str]:
    """Letters with marks (Latin-1, Extended-A) and the letters they stand on."""
    pairs = [(c, unicodedata.normalize("NFD", c)[0]) for c in map(chr, range(0xC0, 0x180))]
    pairs = [(c, b) for c, b in pairs if b != c and b.isascii()]
    return "".join(c for c, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _folds()


def fold_ascii(text: Column) -> Column:
    out = F.translate(text, _MARKED + "øØłŁđĐ", _PLAIN + "oOlLdD")
    for letter, plain in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE")):
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def _measure(stem: str) -> int:
    """How often vowels are followed by consonants."""
    kinds = ["v" if _vowel(stem, i) else "c" for i in range(len(stem))]
    return sum(a == "v" and b == "c" for a, b in zip(kinds, kinds[1:], strict=False))


def _vowel(word: str, i: int) -> bool:
    return word[i] in "aeiou" or (word[i] == "y" and i > 0 and not _vowel(word, i - 1))


def _has_vowel(stem: str) -> bool:
    return any(_vowel(stem, i) for i in range(len(stem)))


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant, the last not w, x or y."""
    n = len(word)
    return n >= 3 and not _vowel(word, n - 1) and _vowel(word, n - 2) and not _vowel(word, n - 3) and word[-1] not in "wxy"


# The suffix tables of Porter's published algorithm.
_STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def porter(word: str) -> str:
    """Porter's stemmer (1980) for lower-case ASCII words; others stay."""
    if len(word) < 3 or not word.isascii() or not word.isalpha():
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            w = cut + "e"
        elif len(cut) > 1 and cut[-1] == cut[-2] and not _vowel(cut, len(cut) - 1) and cut[-1] not in "lsz":
            w = cut[:-1]
        else:
            w = cut + "e" if _measure(cut) == 1 and _short(cut) else cut
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in (_STEP_2, _STEP_3):
        end = max((s for s in table if w.endswith(s)), key=len, default=None)
        if end is not None and _measure(w[: -len(end)]) > 0:
            w = w[: -len(end)] + table[end]
    end = max((s for s in _STEP_4 if w.endswith(s)), key=len, default=None)
    if end is not None and _measure(w[: -len(end)]) > 1 and (end != "ion" or w[: -len(end)].endswith(("s", "t"))):
        w = w[: -len(end)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w


@functools.lru_cache(maxsize=1 << 18)
def _stem(word: str) -> str:
    return porter(word)


def stem_all(tokens: Column) -> Column:
    """Stems of array<string>: each distinct token of an Arrow batch is stemmed once, and remembered by the worker for the next."""

    @F.arrow_udf("array<string>")
    def run(column: pa.Array) -> pa.Array:
        coded = column.flatten().dictionary_encode()
        stems = pa.array([None if t is None else _stem(t) for t in coded.dictionary.to_pylist()], pa.string())
        lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))).astype(np.int32))
        return pa.ListArray.from_arrays(offsets, stems.take(coded.indices), mask=column.is_null())

    return run(tokens)
