"""Vowel marks of texts against a reference: one alignment of letters and words a pair, which all measures read; and the
return of predicted marks into texts.

Only two steps run in Python: canonical composition, and the alignment of two lists (difflib's, as reports use it).
"""

from __future__ import annotations

import difflib
import re
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import text as T
from .ranking import first_k

# Vowel marks, letters, the mark of a doubled letter, forms of one letter, digits.
MARKS, LETTERS, DOUBLED = "ً-ْٰ", "ء-غف-يٱ", "ّ"
VOWELS = "ً-ِ"
FORMS, PLAIN = "أإآٱ", "اااا"
NUMERALS = "0123456789٠١٢٣٤٥٦٧٨٩"

_OPS = ("equal", "replace", "delete", "insert")
_PLACES = ("i", "i_end", "j", "j_end")


def _nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; null stays null."""
    return text.str.normalize("NFC")


def _blocks(split):
    """An Arrow function of two columns of texts: the blocks (op, i, i_end, j, j_end) that lead from the parts of one to those of the other.

    A batch's blocks are five numbers each, whatever the texts' lengths; equal texts are one block.
    """

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        flat, offsets, absent = array("i"), array("i", [0]), []
        for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True):
            absent.append(x is None or y is None)
            if not absent[-1]:
                x, y = split(x), split(y)
                if x == y:
                    flat.extend((0, 0, len(x), 0, len(y)) if x else ())
                else:
                    for op, *places in difflib.SequenceMatcher(a=x, b=y, autojunk=False).get_opcodes():
                        flat.extend((_OPS.index(op), *places))
            offsets.append(len(flat) // 5)
        numbers = np.array(flat, np.int32).reshape(-1, 5)
        fields = pa.StructArray.from_arrays([pa.array(c) for c in numbers.T.copy()], names=["op", *_PLACES])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), fields, mask=pa.array(absent, pa.bool_()))

    return run


# Spark may copy an expression into the body of a lambda, where no Python can run; it copies none that it must take for random.
_BLOCK_TYPE = ArrayType(StructType([StructField(c, IntegerType()) for c in ("op", *_PLACES)]))
_composed_once = F.pandas_udf(_nfc, StringType()).asNondeterministic()
_letters_aligned, _words_aligned = (F.arrow_udf(_blocks(split), _BLOCK_TYPE).asNondeterministic() for split in (str, str.split))


def word_units(text) -> Column:
    """Words of a composed text, each an array of (letter, marks): the marks that stand right before a letter, a doubling first."""

    def unit(u: Column) -> Column:
        marks = F.substring(u, F.lit(1), F.length(u) - 1)
        ordered = F.when(marks.contains(DOUBLED), F.concat(F.lit(DOUBLED), F.regexp_replace(marks, DOUBLED, ""))).otherwise(marks)
        return F.struct(F.right(u, F.lit(1)).alias("letter"), ordered.alias("marks"))

    runs = F.regexp_extract_all(T.as_column(text), F.lit(f"[{MARKS}{LETTERS}]+"), 0)
    words = F.transform(runs, lambda w: F.transform(F.regexp_extract_all(w, F.lit(f"[{MARKS}]*[{LETTERS}]"), 0), unit))
    return F.filter(words, lambda w: F.size(w) > 0)


def _with_end(words: Column) -> Column:
    """The words' units in a row, each with `last`: it ends its word, where the mark tells the case."""
    return F.flatten(F.transform(words, lambda w: F.transform(w, lambda u, i: F.struct(u["letter"].alias("letter"), u["marks"].alias("marks"), (i == F.size(w) - 1).alias("last")))))


def _letters(text) -> Column:
    """The letters of a composed text in a row, forms of one letter as one."""
    return F.translate(F.regexp_replace(T.as_column(text), f"[^{LETTERS}]+", ""), FORMS, PLAIN)


def _bare_words(text) -> Column:
    """The words of a composed text without marks, parted by blanks, forms of one letter as one."""
    return F.translate(F.regexp_replace(F.regexp_replace(T.as_column(text), f"[{MARKS}]+", ""), f"[^{LETTERS}]+", " "), FORMS, PLAIN)


def _table(blocks: str, a: Column, b: Column) -> Column:
    """(op, from, to) of each step of the blocks over the arrays a and b: pairs as far as both sides reach, then what is left of one."""

    def steps(sides: Column, x: Column) -> Column:
        pairs = F.least(x["i_end"] - x["i"], x["j_end"] - x["j"])

        def step(k: Column) -> Column:
            i, j = F.when(x["i"] + k < x["i_end"], x["i"] + k), F.when(x["j"] + k < x["j_end"], x["j"] + k)
            op = F.when(k < pairs, F.get(F.array(*map(F.lit, _OPS)), x["op"])).when(i.isNotNull(), "delete").otherwise("insert")
            return F.struct(op.alias("op"), F.get(sides["a"], i).alias("from"), F.get(sides["b"], j).alias("to"))

        return F.transform(F.sequence(F.lit(0), F.greatest(x["i_end"] - x["i"], x["j_end"] - x["j"]) - 1), step)

    return T.let(F.struct(a.alias("a"), b.alias("b")), lambda sides: F.flatten(F.transform(blocks, lambda x: steps(sides, x))))


def with_alignment(rows: DataFrame, reference: str, output: str) -> DataFrame:
    """rows with `letters`, an array of (op, from, to) over the letters of both texts as (letter, marks, last), and `words`,
    one of (op, from, to) over their words as arrays of (letter, marks).

    op is equal, replace, delete or insert; a side that is not there is null. Forms of one letter align as equal. Null
    texts have null alignments.
    """
    # Only texts pass through the Python steps; the units, many times longer, are made after them.
    composed = rows.withColumns({"_ta": _composed_once(F.col(reference).cast("string")), "_tb": _composed_once(F.col(output).cast("string"))})
    blocks = composed.withColumns({"_sl": _letters_aligned(_letters("_ta"), _letters("_tb")), "_sw": _words_aligned(_bare_words("_ta"), _bare_words("_tb"))})
    words = blocks.withColumns({"_a": word_units("_ta"), "_b": word_units("_tb")})
    tables = {"letters": _table("_sl", _with_end(F.col("_a")), _with_end(F.col("_b"))), "words": _table("_sw", F.col("_a"), F.col("_b"))}
    return words.withColumns(tables).drop("_ta", "_tb", "_a", "_b", "_sl", "_sw")


def _wrong_marks(x: Column, with_case: bool) -> Column:
    """A letter of the reference without a partner, or with other marks; without case, marks at words' ends do not count."""
    marks = lambda u: u["marks"] if with_case else F.when(u["last"], "").otherwise(u["marks"])
    return x["from"].isNotNull() & (x["to"].isNull() | (marks(x["from"]) != marks(x["to"])))


def _wrong_word(x: Column) -> Column:
    plain = lambda w: F.transform(w, lambda u: F.struct(F.translate(u["letter"], FORMS, PLAIN), u["marks"]))
    return x["from"].isNotNull() & (x["to"].isNull() | (plain(x["from"]) != plain(x["to"])))


def _base(side: str) -> Column:
    """The letters of one side as they are written."""
    return F.transform(F.filter("letters", lambda x: x[side].isNotNull()), lambda x: x[side]["letter"])


def corrupted() -> Column:
    """Whether the output has other letters than the reference, forms of one letter told apart."""
    return _base("from") != _base("to")


def error_rates(rows: DataFrame, by: list[str], reference: str, output: str) -> DataFrame:
    """by, der, der_no_case, wer, corrupt_rate, letters, words, n: the shares of letters and words whose marks are wrong, of
    letters without the case endings, and of texts whose letters changed. A share of nothing is 0; pairs with a null text
    are left out.
    """
    count = lambda c, f: F.size(F.filter(c, f))
    e = with_alignment(rows.where(F.col(reference).isNotNull() & F.col(output).isNotNull()), reference, output).select(
        *by, count("letters", lambda x: x["from"].isNotNull()).alias("letters"), count("letters", lambda x: _wrong_marks(x, True)).alias("wrong"), count("letters", lambda x: _wrong_marks(x, False)).alias("wrong_no_case"),
        count("words", lambda x: x["from"].isNotNull()).alias("words"), count("words", _wrong_word).alias("wrong_words"), corrupted().cast("int").alias("corrupt"),
    )
    rate = lambda c, of: F.sum(c) / F.greatest(F.lit(1), F.sum(of))
    return e.groupBy(*by).agg(
        rate("wrong", "letters").alias("der"), rate("wrong_no_case", "letters").alias("der_no_case"), rate("wrong_words", "words").alias("wer"), F.avg("corrupt").alias("corrupt_rate"),
        F.sum("letters").alias("letters"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("n"),
    )


def first_error() -> Column:
    """Struct (kind, letter, expected, got) of the first error of an aligned row; null where both texts agree.

    kind: `length` (letters inserted or deleted; numbers of letters), `variant` (another form of a letter), `letter`
    (another letter), or `marks`.
    """
    error = lambda kind, letter, expected, got: F.struct(F.lit(kind).alias("kind"), letter.cast("string").alias("letter"), expected.cast("string").alias("expected"), got.cast("string").alias("got"))
    plain = lambda c: F.translate(c, FORMS, PLAIN)
    none = F.lit(None)

    def found(p: Column) -> Column:
        differ = F.filter(F.arrays_zip(p["a"].alias("a"), p["b"].alias("b")), lambda x: x["a"] != x["b"])
        first, marks = F.get(differ, F.lit(0)), F.get(F.filter("letters", lambda x: x["from"].isNotNull() & x["to"].isNotNull() & (x["from"]["marks"] != x["to"]["marks"])), F.lit(0))
        of_letters = F.when(plain(first["a"]) == plain(first["b"]), error("variant", first["a"], first["a"], first["b"])).otherwise(error("letter", first["a"], first["a"], first["b"]))
        return (
            F.when(F.size(p["a"]) != F.size(p["b"]), error("length", none, F.size(p["a"]), F.size(p["b"]))).when(first.isNotNull(), of_letters)
            .when(marks.isNotNull(), error("marks", marks["from"]["letter"], marks["from"]["marks"], marks["to"]["marks"]))
        )

    return T.let(F.struct(_base("from").alias("a"), _base("to").alias("b")), found)


def error_examples(rows: DataFrame, by: list[str], reference: str, output: str, order: str, k: int = 5) -> DataFrame:
    """by, order, both texts and error: the first k pairs of each group that differ, in the given order."""
    marked = with_alignment(rows, reference, output).withColumn("error", first_error()).where("error is not null")
    return first_k(marked.select(*by, order, reference, output, "error"), by, [F.col(order)], k)


def _known(letters: str) -> str:
    return "".join(map(re.escape, letters + NUMERALS))


def prediction_input(text, letters: str) -> Column:
    """What a model that knows `letters` is given: the text without marks and unknown signs, digits as `#`."""
    bare = T.strip_marks(text)
    return F.regexp_replace(F.regexp_replace(bare, f"[^{_known(letters)}]", ""), f"[{NUMERALS}]", "#")


def restored(text, marks, letters: str) -> Column:
    """The text without its own marks and with `marks` (an array) after the known signs, one each in order.

    Signs that the model does not know stay where they are and take no mark; predictions that are missing are empty, and
    those too many are dropped. Marks of a letter stand in canonical order, a doubling after the vowel. A null text is
    null; a null array restores no marks.
    """
    known = f"[{_known(letters)}]"
    bare = T.strip_marks(text)

    def put(p: Column) -> Column:
        units = F.regexp_extract_all(p["bare"], F.lit(f"(?s){known}[^{_known(letters)}]*"), 0)
        signed = F.transform(units, lambda u, i: F.concat(F.left(u, F.lit(1)), F.coalesce(F.get(p["marks"], i), F.lit("")), F.substring(u, F.lit(2), F.length(u))))
        return F.concat(F.regexp_extract(p["bare"], f"(?s)^[^{_known(letters)}]*", 0), F.array_join(signed, ""))

    given = F.coalesce(T.as_column(marks), F.array().cast("array<string>"))
    whole = F.when(bare.isNotNull(), T.let(F.struct(bare.alias("bare"), given.alias("marks")), put))
    return F.regexp_replace(whole, f"({DOUBLED}+)([{VOWELS}]+)", "$2$1")


def with_predictions(rows: DataFrame, text: str, predictions: DataFrame, letters: str, name: str = "restored") -> DataFrame:
    """rows with their text restored from `predictions` (input, marks), looked up by what the model is given; without one, without marks."""
    looked_up = rows.withColumn("_input", prediction_input(text, letters)).join(predictions.select(F.col("input").alias("_input"), F.col("marks").alias("_marks")).dropDuplicates(["_input"]), "_input", "left")
    return looked_up.withColumn(name, restored(text, "_marks", letters)).drop("_input", "_marks")
