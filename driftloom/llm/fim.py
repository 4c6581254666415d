"""Fill-in-middle transformation by escaped marker injection, in column expressions only.

A text is cut into units: white space with the word after it, or white space at the end. Two control characters play a part:
``_CUT`` divides units and ``_ESC`` escapes. Both are escaped in the text first, so each ``_CUT`` that is there after
``regexp_replace`` has appended one to every unit is a unit's end, and their number is the number of units. ``substring_index``
then extracts prefix, middle and suffix by the ranks of their units, which are unescaped and put together in the chosen order.
Escaping replaces characters that are not white space by others that are not, so units stay the same.

Random choices are hashes of seed and id: they don't depend on partitions, order or reruns. Every row is a row of its own: no
shuffle, no Python worker, and a task never holds more than a few copies of one text.

Defined results: a null text is empty, and an empty text is plain; a null id hashes as the seed alone; repeated rows get equal
results, ties can't arise; texts may be as long as a row can be (the expressions are linear in them); an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of prefix, suffix and middle in the output.
MARKS = ("<P>", "<S>", "<M>")
SEED, PERCENT, SPM_PERCENT = 42, 50, 80
_CUT, _ESC = "\x01", "\x02"
#: Possessive, so a run of white space at the end is not tried again from each of its places.
_UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"


def _escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_ESC), F.lit(_ESC + "e")), F.lit(_CUT), F.lit(_ESC + "c"))


def _unescape(text: Column) -> Column:
    """The text of some units, without the marks between them."""
    text = F.replace(text, F.lit(_CUT))
    return F.replace(F.replace(text, F.lit(_ESC + "c"), F.lit(_CUT)), F.lit(_ESC + "e"), F.lit(_ESC))


def _draw(digest: str, k: int) -> Column:
    """The k-th group of eight hex digits as a number."""
    return F.conv(F.substring(F.col(digest), 8 * k - 7, 8), 16, 10).cast("long")


def _first(text: str, rank: Column | str) -> Column:
    """The first ``rank`` units."""
    return F.expr(f"substring_index({text}, '{_CUT}', cast({rank} as int))")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc_id, text, n (units), form (plain, psm or spm), prefix, middle, suffix (null if plain), output: one row for each row.

    Of a hundred documents ``percent`` are transformed, of these ``spm_percent`` of a hundred with the suffix first.
    Texts that hold a mark stay plain, so every output can be undone (``restore``).
    """
    p, s, m = (F.lit(x) for x in marks)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({
        "marked": F.regexp_replace(_escape(F.col("text")), _UNIT, "$0" + _CUT),
        "digest": F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256),
    })
    rows = rows.withColumn("n", (F.length("marked") - F.length(F.replace(F.col("marked"), F.lit(_CUT)))).cast("long"))
    marked = F.contains(F.col("text"), p) | F.contains(F.col("text"), s) | F.contains(F.col("text"), m)
    plain = (F.col("n") == 0) | marked | (_draw("digest", 3) % 100 >= percent)
    cuts = [_draw("digest", k) % (F.col("n") + 1) for k in (1, 2)]
    rows = rows.withColumns({
        "form": F.when(plain, "plain").when(_draw("digest", 4) % 100 < spm_percent, "spm").otherwise("psm"),
        "low": F.least(*cuts), "high": F.greatest(*cuts),
    })
    split = F.col("form") != "plain"
    rows = rows.withColumns({
        "prefix": F.when(split, _unescape(_first("marked", "low"))),
        "middle": F.when(split, _unescape(F.expr(f"substring_index(substring_index(marked, '{_CUT}', cast(high as int)), '{_CUT}', cast(low - high as int))"))),
        # what follows the last mark is empty and counts as a part
        "suffix": F.when(split, _unescape(_first("marked", "high - n - 1"))),
    })
    out = F.when(~split, F.col("text")).when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).otherwise(F.concat(s, "suffix", p, "prefix", m, "middle"))
    return rows.select("doc_id", "text", "n", "form", "prefix", "middle", "suffix", out.alias("output"))


def restore(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``output`` was made from; null if its marks are not those of ``form``."""
    p, s, m = marks

    def undo(first: str, second: str, prefix_first: bool) -> Column:
        # no mark overlaps itself, and parts hold none: the first occurrence is the mark
        head = F.substring_index(output, second, 1)
        rest = F.substr(output, F.length(head) + len(second) + 1)
        one = F.substr(head, F.lit(len(first) + 1))
        two = F.substring_index(rest, m, 1)
        middle = F.substr(rest, F.length(two) + len(m) + 1)
        found = F.startswith(output, F.lit(first)) & F.contains(output, F.lit(second)) & F.contains(rest, F.lit(m))
        return F.when(found, F.concat(one, middle, two) if prefix_first else F.concat(two, middle, one))

    return F.when(form == "plain", output).when(form == "psm", undo(p, s, True)).when(form == "spm", undo(s, p, False))


def digests(made: DataFrame) -> DataFrame:
    """What the query returns of ``fill_in_middle``'s rows: sizes and digests instead of texts."""
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
