"""Fill-in-middle: texts cut into units at zero-width boundaries, their prefix, middle and suffix put in another order.

A unit grammar is a set of alternatives made of character classes, such as ``[A-Za-z]+|[^A-Za-z]``. It is translated
to one zero-width regex over two neighbouring characters: a boundary lies between any two of them that no unit
may hold side by side. Splitting there keeps every character, so the pieces of a text are its units and joining them
gives it back. Only DataFrame functions run here; a text of any length is one row, cut by one pass of the regex.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.native import table, text_of

#: Words of ASCII letters and single other characters; lines with their ends; single characters.
WORDS, LINES, CHARACTERS = r"[A-Za-z]+|[^A-Za-z]", r"[^\n]*[\n]|[^\n]+", r"[\s\S]"
MARKS = ("<P>", "<S>", "<M>")

_PART = re.compile(r"(\[(?:\\.|[^\]\\])+\])([+*]?)")


def boundary(grammar: str) -> str:
    """The zero-width regex that matches wherever one unit of the grammar ends and the next begins.

    Alternatives are sequences of classes, each once, ``+`` or ``*``. Every character must belong to a unit, and whether two neighbours share one must
    follow from the two alone, as it does where classes of different alternatives don't overlap.
    """
    together = []
    for unit in grammar.split("|"):
        parts = _PART.findall(unit)
        if "".join(a + b for a, b in parts) != unit or not parts:
            raise ValueError(f"not a sequence of character classes: {unit}")
        for i, (left, times) in enumerate(parts):
            if times:
                together.append((left, left))
            for right, may in parts[i + 1 :]:
                together.append((left, right))
                if may != "*":
                    break
    return r"(?<=[\s\S])(?=[\s\S])" + "".join(f"(?!(?<={a}){b})" for a, b in dict.fromkeys(together))


def units(text: Column, grammar: str = WORDS) -> Column:
    """The array of a text's units; none for the empty text, which splitting would return as one piece."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", grammar: str = WORDS, seed: int = 1, transformed: int = 90, suffix_first: int = 20, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """doc, text, n (units), form, prefix_chars, middle_chars, output: one row for each input row.

    The cuts and the form follow from the SHA-256 of ``seed:doc_id``, so they are the same wherever and how often they are made.
    ``transformed`` of a hundred documents are taken apart, ``suffix_first`` of a hundred of those as spm. A text that is empty or holds one of
    the marks stays plain, whatever was drawn, and its prefix_chars and middle_chars are null. A null text is the
    empty text and a null id has no digits. Repeated rows give repeated results, an empty table none; other columns are left out.
    """
    if any(mark.find(first, 0 if mark[0] != first else 1) >= 0 for first in {x[0] for x in marks} for mark in marks) or len(set(marks)) < 3:
        raise ValueError("the first character of a mark must not occur later in any mark")
    p, s, m = (F.lit(x) for x in marks)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)

    def drawn(k: int) -> Column:
        return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long")

    t = F.col("text")
    x = docs.select(F.col(doc_id).alias("doc"), text_of(text).alias("text"), *(drawn(k).alias(f"h{k + 1}") for k in range(4)))
    x = x.withColumn("units", units(t, grammar)).withColumn("n", F.size("units").cast("long"))
    one, two = (F.col(h) % (F.col("n") + 1) for h in ("h1", "h2"))
    plain = (t == "") | t.contains(marks[0]) | t.contains(marks[1]) | t.contains(marks[2]) | (F.col("h3") % 100 >= transformed)
    x = x.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm"))
    x = x.withColumn("low", F.least(one, two).cast("int")).withColumn("high", F.greatest(one, two).cast("int"))
    x = x.withColumn("prefix", F.array_join(F.slice("units", F.lit(1), F.col("low")), ""))
    x = x.withColumn("middle", F.array_join(F.slice("units", F.col("low") + 1, F.col("high") - F.col("low")), ""))
    x = x.withColumn("suffix", F.array_join(F.slice("units", F.col("high") + 1, F.col("n").cast("int") - F.col("high")), ""))
    a, b, c = F.col("prefix"), F.col("middle"), F.col("suffix")
    cut = F.col("form") != "plain"
    return x.select(
        "doc", "text", "n", "form", F.when(cut, F.char_length(a).cast("long")).alias("prefix_chars"), F.when(cut, F.char_length(b).cast("long")).alias("middle_chars"),
        F.when(~cut, t).when(F.col("form") == "psm", F.concat(p, a, s, c, m, b)).otherwise(F.concat(s, c, p, a, m, b)).alias("output"),
    )


def restored(form: Column, output: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output was made from. Marks start with a character that no mark holds elsewhere, so no text beside a mark can feign one."""
    parts = F.split(output, "|".join(re.escape(x) for x in marks), -1)  # nothing stands before the first mark
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document, null and empty texts included (n = 0, plain)."""
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        F.col("doc").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )


ORACLE = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || substr(h, 1, 8) AS UBIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS UBIGINT) AS h2,
    CAST('0x' || substr(h, 17, 8) AS UBIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS UBIGINT) AS h4
  FROM cut),
placed AS (
  SELECT doc_id, t, n, u, CAST(least(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS low, CAST(greatest(h1 % (n + 1), h2 % (n + 1)) AS BIGINT) AS high,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:low], ''), '') AS p, coalesce(array_to_string(u[low + 1:high], ''), '') AS m, coalesce(array_to_string(u[high + 1:n], ''), '') AS s
  FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts"""
