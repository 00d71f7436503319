"""A lexicon as an index: texts are cut into word n-grams that are joined with the lexicon's terms.

The plan has no expression per term, so a lexicon of 100,000 terms is one join. It finds what ``has_term`` finds: a term occurs where its
words stand next to each other, parted as in the term (any blanks count as one), with no word character before or after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedfold.functions.text import SPACE_CLASS, WORD_CLASS, has_term, strip
from feedfold.session import join_dimension

_WORD = f"[{WORD_CLASS}]+"


def _pieces(text: Column) -> dict[str, Column]:
    """Words in lower case, and what stands before each and after the last, blanks as one space."""
    low = F.lower(text)
    return {"words": F.regexp_extract_all(low, F.lit(f"({_WORD})"), 1),
            "gaps": F.split(F.regexp_replace(low, f"[{SPACE_CLASS}]+", " "), _WORD)}


def _grams(n: int) -> Column:
    """Every run of ``n`` words with what parts them."""
    words, gaps = F.col("words"), F.col("gaps")

    def gram(word: Column, i: Column) -> Column:
        return F.concat(word, *[x for j in range(1, n) for x in (F.get(gaps, i + j), F.get(words, i + j))])

    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - (n - 1), F.lit(0))), gram)


def lexicon_index(table: DataFrame) -> DataFrame:
    """(gram, n_words, entries) of a lexicon table's terms; a gram has an entry per signal and spelling.

    Terms that begin or end with other signs than word characters are left out, as no run of words is one (see ``plain_terms``).
    """
    terms = table.select("signal", "term", "position", strip(F.col("term")).alias("flat")).filter(_is_wordy("flat"))
    cut = terms.select("signal", "term", "position", *[c.alias(n) for n, c in _pieces(F.col("flat")).items()])
    gram = F.array_join(F.flatten(F.zip_with(F.slice("gaps", 1, F.size("words")), F.col("words"), lambda g, w: F.array(g, w))), "")
    return cut.select(gram.alias("gram"), F.size("words").alias("n_words"), F.struct("signal", "position", "term").alias("entry")).groupBy(
        "gram", "n_words").agg(F.sort_array(F.collect_set("entry")).alias("entries"))


def _is_wordy(term: str) -> Column:
    return F.col(term).rlike(f"\\A[{WORD_CLASS}](?:.*[{WORD_CLASS}])?\\z")


def plain_terms(table: DataFrame) -> list[tuple[str, str, int]]:
    """The terms (signal, term, position) that only a pattern finds: those with other signs at their ends."""
    flat = table.withColumn("flat", strip(F.col("term")))
    return [(r.signal, r.term, r.position) for r in flat.filter(~_is_wordy("flat") & (F.col("flat") != "")).collect()]


def indexed_terms(rows: DataFrame, key: str, text: Column, table: DataFrame) -> DataFrame:
    """(key, signal, position, term) once for every term of the lexicon ``table`` that a row's text holds."""
    index = lexicon_index(table)
    lengths = sorted(r.n_words for r in index.select("n_words").distinct().collect())
    edged = plain_terms(table)
    found = []
    if lengths:
        cut = rows.select(key, *[c.alias(n) for n, c in _pieces(text).items()])
        grams = F.array_distinct(F.concat(*[_grams(n) for n in lengths]))  # no run of words that is as long as no term
        found.append(join_dimension(cut.select(key, F.explode(grams).alias("gram")), index.select("gram", "entries"), ["gram"])
                     .select(key, F.explode("entries").alias("entry")).select(key, "entry.*"))
    if edged:
        hits = F.array_compact(F.array(*[F.when(has_term(text, (t,)), F.struct(
            F.lit(s).alias("signal"), F.lit(p).alias("position"), F.lit(t).alias("term"))) for s, t, p in edged]))
        found.append(rows.select(key, F.explode(hits).alias("entry")).select(key, "entry.*"))
    if not found:
        return rows.select(key, F.lit("").alias("signal"), F.lit(0).alias("position"), F.lit("").alias("term")).limit(0)
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def matched_by_index(rows: DataFrame, key: str, text: Column, table: DataFrame) -> DataFrame:
    """(key, matched): per row a MAP of every signal to the terms found, in lexicon order; equals ``matched_terms``.

    A row has at most as many terms as the lexicon, so its lists are bounded.
    """
    signals = sorted(r.signal for r in table.select("signal").distinct().collect())
    hits = indexed_terms(rows, key, text, table).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("signal", "position", "term"))).alias("hits"))
    none = F.array().cast("array<struct<signal:string,position:int,term:string>>")

    def of(signal: str) -> Column:
        return F.transform(F.filter("hits", lambda h: h["signal"] == signal), lambda h: h["term"])

    found = [of(s) for s in signals]
    return rows.select(key).join(hits, key, "left").withColumn("hits", F.coalesce("hits", none)).select(
        key, F.map_from_arrays(F.array(*[F.lit(s) for s in signals]), F.array(*found)).alias("matched"))
