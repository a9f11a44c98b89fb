"""Text pieces shared by the operators."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: ASCII white space; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"


def whole(text) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Words of a text that is not null."""
    return F.array_remove(F.split(text, SPACE + "+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often it is used."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def running_sums(lengths: Column, block: int = 256) -> Column:
    """Sums of the first 1, 2, ... elements of an integer array.

    Blocks keep the work per element bounded, so that an array of a million elements is no
    matter. The array must be cheap to refer to: a column or a variable of ``let``.
    """
    total = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    n_blocks = F.floor((F.size(lengths) + block - 1) / block).cast("int")
    sums = F.transform(F.sequence(F.lit(0), n_blocks - 1),
                       lambda j: total(F.slice(lengths, j * block + 1, block)))

    def with_sums(sums):
        before = F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda j: total(F.slice(sums, F.lit(1), j)))
        return let(before, lambda before: F.transform(
            F.sequence(F.lit(0), F.size(lengths) - 1),
            lambda i: F.get(before, F.floor(i / block).cast("int"))
            + total(F.slice(lengths, F.floor(i / block).cast("int") * block + 1, i % block + 1))))

    return F.when(F.size(lengths) > 0, let(sums, with_sums)).otherwise(F.array().cast("array<bigint>"))
